"""Structured collections: annotation files of several formats, also as members of archives, joined with their tables and named by one or more fields.

Every format comes to rows with ``origin`` (split, row, file, identity, group). The identity is the group and the row's id: the value at ``id_path``, the values at ``identity_fields`` as a JSON list, or the row's
place in its file, which `numbered` finds without a sort in one task. An archive's member is read in one task, which hands on its records one by one as JSON; an archive is the row that holds it, so members are bounded by it.
"""

from __future__ import annotations

import csv
import io
import json
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.session import Tables
from tessera.sources.digest import numbered
from tessera.sources.mapping import nested

FORMATS = ("json", "jsonl", "csv", "parquet", "text", "text_lines")


@dataclass(frozen=True)
class Lookup:
    """A table that an entry's rows are joined with: each row has one at ``on`` = ``key`` (any number, as a list, with ``many``), in the field ``name``. Rows of the table that nothing joins are refused unless ``unused``."""

    table: DataFrame
    on: str
    key: str
    name: str
    many: bool = False
    unused: bool = False


@dataclass(frozen=True)
class Entry:
    """A file of annotations. ``member``: of a ZIP archive at the path. ``schema``: of a record (for json and jsonl). ``key_field``: records are an object's values, and the field gets their keys. ``columns``: records are
    arrays of so many values."""

    path: str
    split: str
    format: str = "json"
    schema: str | T.StructType | None = None
    member: str | None = None
    records_key: str | None = None
    key_field: str | None = None
    columns: list[str] | None = None
    identity_prefix: str | None = None
    lookups: list[Lookup] = field(default_factory=list)


def _struct(e: Entry) -> T.StructType:
    if e.format in ("text", "text_lines"):
        return T._parse_datatype_string("text string" if e.format == "text" else "line long, text string")  # type: ignore[return-value]
    if e.schema is None:
        raise ValueError(f"{e.path}: a format without types of its own needs a schema")
    return e.schema if isinstance(e.schema, T.StructType) else T._parse_datatype_string(e.schema)  # type: ignore[return-value]


def _at(data: object, path: str | None) -> object:
    for step in path.split(".") if path else []:
        if not isinstance(data, dict) or step not in data:
            raise ValueError(f"there is no {path}")
        data = data[step]
    return data


def records_in(data: bytes, kind: str, records_key: str | None, key_field: str | None, columns: list[str] | None) -> Iterator[object]:
    """The records of a file's bytes."""
    text = data.decode("utf-8-sig")
    if kind == "text":
        yield {"text": text}
        return
    if kind == "text_lines":
        yield from ({"line": i, "text": x} for i, x in enumerate(text.splitlines(), 1) if x.strip())
        return
    if kind == "csv":
        yield from csv.DictReader(io.StringIO(text, newline=""))
        return
    found: object = [json.loads(x) for x in text.split("\n") if x.strip()] if kind == "jsonl" else _at(json.loads(text), records_key)
    if key_field:
        if not isinstance(found, dict) or any(not isinstance(v, dict) or key_field in v for v in found.values()):
            raise ValueError("keyed records are objects without a field of the key's name")
        found = [{key_field: k, **v} for k, v in found.items()]
    if columns:
        if not isinstance(found, list) or any(not isinstance(r, list) or len(r) != len(columns) for r in found):
            raise ValueError(f"records are arrays of {len(columns)} values")
        found = [dict(zip(columns, r, strict=True)) for r in found]
    if not isinstance(found, list) or any(not isinstance(r, dict) for r in found):
        raise ValueError("annotations are a list of objects")
    yield from found


def _whole(spark: SparkSession, e: Entry) -> DataFrame:
    """(row, and the record's columns) of a file that one task reads: a member, or a JSON document."""
    member, kind, options = e.member, e.format, (e.records_key, e.key_field, e.columns)

    def read(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for content in pdf["content"]:
                data = bytes(content)
                if member:
                    with zipfile.ZipFile(io.BytesIO(data)) as archive:
                        if member not in archive.namelist():
                            raise ValueError(f"the archive has no member {member}")
                        data = archive.read(member)
                found, first = [], 0
                for r in records_in(data, kind, *options):
                    found.append(json.dumps(r))
                    if len(found) == 1000:
                        yield pd.DataFrame({"row": range(first, first + len(found)), "json": found})
                        found, first = [], first + len(found)
                yield pd.DataFrame({"row": range(first, first + len(found)), "json": found})

    rows = spark.read.format("binaryFile").load(e.path).select("content").mapInPandas(read, "row long, json string")
    return rows.select("row", F.from_json("json", _struct(e), {"mode": "FAILFAST"}).alias("r")).select("row", "r.*")


def _split(spark: SparkSession, e: Entry, tables: Tables) -> DataFrame:
    """(row, and the record's columns) of a file that many tasks read."""
    if e.format == "parquet":
        return spark.read.parquet(e.path).select(F.col("_metadata.row_index").alias("row"), "*")
    if e.format == "csv":
        rows = spark.read.csv(e.path, header=True, quote='"', escape='"', multiLine=True, encoding="UTF-8")  # one task a file
        return rows.withColumn("row", F.monotonically_increasing_id()).select("row", *[f"`{c}`" for c in rows.columns])
    if e.format == "jsonl":
        rows = spark.read.schema(_struct(e)).option("mode", "FAILFAST").json(e.path)
    else:
        rows = spark.read.text(e.path).withColumnRenamed("value", "text")
    # pieces of a file by their place in it, and lines within a piece
    place = rows.select("*", F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_nth"))
    out = numbered(place, tables, "_block", "_nth", name="row").drop("_block", "_nth")
    if e.format == "text_lines":  # blank lines count as lines, but are no records
        lines = out.where(F.trim("text") != "").select((F.col("row") + 1).alias("line"), "text", F.col("row").alias("_at"))
        out = numbered(lines, tables, "_at", name="row").drop("_at")
    return out


def _looked_up(rows: DataFrame, lookup: Lookup) -> DataFrame:
    if lookup.name in rows.columns:
        raise ValueError(f"the rows have a field {lookup.name} already")
    on = nested(rows.schema, lookup.on)
    key = nested(lookup.table.schema, lookup.key)
    table = lookup.table.select(key.alias("_key"), F.struct(*[f"`{c}`" for c in lookup.table.columns]).alias(lookup.name))
    if lookup.many:
        table = table.groupBy("_key").agg(F.collect_list(lookup.name).alias(lookup.name))
    bad = table.agg(F.count_if(F.col("_key").isNull()).alias("missing"), (F.count("_key") - F.count_distinct("_key")).alias("repeated")).first()
    if bad["missing"] or bad["repeated"]:
        raise ValueError(f"{lookup.name}: the table has keys that are missing or there twice")
    if not lookup.unused and table.join(rows.select(on.alias("_on")).distinct(), F.col("_key") == F.col("_on"), "left_anti").head(1):
        raise ValueError(f"{lookup.name}: the table has rows that nothing joins")
    kept = rows.withColumn("_on", on)
    if kept.join(table, F.col("_on") == F.col("_key"), "left_anti").head(1):
        raise ValueError(f"{lookup.name}: a row has no match in the table")
    return kept.join(table, F.col("_on") == F.col("_key")).drop("_on", "_key")


def identity(schema: T.StructType, prefix: str, *, id_path: str | None = None, fields: list[str] | None = None) -> Column:
    """`prefix:id`; of several fields a JSON list, none of which may be missing."""
    if fields:
        parts = [F.regexp_extract(F.to_json(F.array(nested(schema, f))), r"(?s)^\[(.*)\]$", 1) for f in fields]
        missing = F.lit(False)
        for f in fields:
            missing = missing | nested(schema, f).isNull()
        named = F.concat(F.lit("["), F.concat_ws(",", *parts), F.lit("]"))
        named = F.when(missing, F.raise_error(F.lit("a field of the identity is missing")).cast("string")).otherwise(named)
    else:
        named = F.coalesce(nested(schema, id_path).cast("string") if id_path else F.lit(None), F.col("row").cast("string"))
    return F.concat(F.lit(f"{prefix}:"), named)


def read_collection(spark: SparkSession, entries: list[Entry], *, id_path: str | None = None, identity_fields: list[str] | None = None) -> DataFrame:
    """The records of all entries with ``origin``; columns that an entry lacks are null. Identities that occur twice are refused."""
    tables, out = Tables(spark, "collection"), None
    for e in entries:
        if e.format not in FORMATS:
            raise ValueError(f"unknown format {e.format}; there are {FORMATS}")
        one_task = e.member or e.format in ("json", "text") or e.key_field or e.columns
        rows = _whole(spark, e) if one_task else _split(spark, e, tables)
        if clash := {"origin"} & set(rows.columns):
            raise ValueError(f"{e.path}: the field {clash} is reserved")
        rows = tables.write(rows)
        for lookup in e.lookups:
            rows = tables.write(_looked_up(rows, lookup))
        group = e.identity_prefix or e.split
        origin = F.struct(F.lit(e.split).alias("split"), "row", F.lit(e.member or e.path).alias("file"), identity(rows.schema, group, id_path=id_path, fields=identity_fields).alias("identity"), F.lit(group).alias("group"))
        rows = rows.select(*[c for c in rows.columns if c != "row"], origin.alias("origin"))
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    if out is None:
        raise ValueError("a collection has at least one file")
    out = tables.write(out)
    twice = out.groupBy("origin.identity").count().where("count > 1").head(1)
    if twice:
        raise ValueError(f"the identity {twice[0][0]} is there {twice[0][1]} times")
    return out
