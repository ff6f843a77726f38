"""Selections of records: frozen once, exported without what is private, and imported with their checksums."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.snapshot import digest, write_text

NAME = re.compile(r"[A-Za-z0-9_.-]{1,100}")


def checked(selection: DataFrame, records: DataFrame) -> DataFrame:
    """check, rows: repeated ids and places of a selection (ord, id), gaps in its places, ids without a record; all are 0 for a good one."""
    ids = selection.groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    twice = ids.agg(F.count_if(F.col("n") > 1).alias("rows")).select(F.lit("repeated ids").alias("check"), "rows")
    places = selection.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("ord").alias("d"), F.min("ord").alias("lo"), F.max("ord").alias("hi"))
    gaps = places.select(F.lit("places that aren't 0 to n - 1").alias("check"), F.coalesce((F.col("n") - F.col("d")) + F.col("lo") + (F.col("hi") + 1 - F.col("d")), F.lit(0)).cast("long").alias("rows"))
    unknown = ids.join(records.select("id"), "id", "left_anti").agg(F.count(F.lit(1)).alias("rows")).select(F.lit("unknown ids").alias("check"), "rows")
    return twice.unionByName(gaps).unionByName(unknown)


def public(selection: DataFrame, records: DataFrame, *, private: tuple[str, ...] = ("human",), assets: str | None = "assets") -> DataFrame:
    """The selection's records in its order (``ord``), without the private columns, and without the places and metadata of assets.

    Annotations of the human namespace go too, if there are annotations."""
    out = selection.select("ord", "id").join(records.drop(*private), "id")
    if assets and assets in records.columns:
        fields = [f.name for f in records.schema[assets].dataType.elementType.fields]
        kinds = {f.name: f.dataType for f in records.schema[assets].dataType.elementType.fields}
        out = out.withColumn(assets, F.transform(assets, lambda a: F.struct(*[F.lit(None).cast(kinds[f]).alias(f) if f in ("uri", "metadata") else a[f].alias(f) for f in fields])))
    if "annotations" in records.columns:
        out = out.withColumn("annotations", F.filter("annotations", lambda a: ~a["namespace"].eqNullSafe(F.lit("human"))))
    return out.orderBy("ord")


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def freeze(selection: DataFrame, folder: str, name: str) -> DataFrame:
    """Writes a selection (ord, id) under a name once. Freezing the same again changes nothing; other ids under the name are refused."""
    if not NAME.fullmatch(name):
        raise ValueError("a selection's name has 1 to 100 letters, digits, dots, lines or dashes")
    spark, path = selection.sparkSession, f"{folder}/{name}"
    rows = selection.select(F.col("ord").cast("long").alias("ord"), F.col("id").cast("string").alias("id"))
    if _exists(spark, f"{path}/manifest.json"):
        new, old = digest(rows).first(), _manifest(spark, path)
        if (new["count"], new["digest"]) != (old["count"], old["digest"]):
            raise ValueError("selections are immutable; use a new name")
        return frozen(spark, folder, name)
    rows.write.mode("errorifexists").parquet(f"{path}/ids")
    d = digest(spark.read.parquet(f"{path}/ids")).first()
    write_text(spark, f"{path}/manifest.json", json.dumps({"kind": "selection", "count": d["count"], "digest": d["digest"]}))
    return frozen(spark, folder, name)


def _manifest(spark: SparkSession, path: str) -> dict:
    return json.loads("".join(r[0] for r in spark.read.text(f"{path}/manifest.json").collect()))


def frozen(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A frozen selection (ord, id); refused if it isn't what its manifest says."""
    path = f"{folder}/{name}"
    rows, m = spark.read.parquet(f"{path}/ids"), _manifest(spark, path)
    d = digest(rows).first()
    if (d["count"], d["digest"]) != (m["count"], m["digest"]):
        raise ValueError("the selection's ids do not match their checksum")
    return rows


def export(selection: DataFrame, records: DataFrame, path: str, **options: object) -> None:
    """Writes the ids and the public records of a selection, with a manifest of counts and digests. What exists is never overwritten."""
    spark = records.sparkSession
    bad = {r["check"]: r["rows"] for r in checked(selection, records).collect() if r["rows"]}
    if bad:
        raise ValueError(f"invalid selection: {bad}")
    if _exists(spark, path):
        raise ValueError(f"{path} exists")
    tables = {"selection": selection.select("ord", "id"), "records": public(selection, records, **options)}
    manifest = {}
    for name, rows in tables.items():
        rows.write.parquet(f"{path}/{name}")
        d = digest(spark.read.parquet(f"{path}/{name}")).first()
        manifest[name] = {"count": d["count"], "digest": d["digest"]}
    write_text(spark, f"{path}/manifest.json", json.dumps({"kind": "selection", "tables": manifest}, sort_keys=True))


def load(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(selection, records) of an export. Refused if a table isn't what the manifest says, or if there are files that it doesn't name."""
    m = _manifest(spark, path)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = {f.getPath().getName() for f in where.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(where)}
    there = {f for f in there if not f.startswith(".")}
    if m.get("kind") != "selection" or there != {*m["tables"], "manifest.json"}:
        raise ValueError(f"unexpected files: {sorted(there)}")
    out = []
    for name in ("selection", "records"):
        rows = spark.read.parquet(f"{path}/{name}")
        d = digest(rows).first()
        if {"count": d["count"], "digest": d["digest"]} != m["tables"][name]:
            raise ValueError(f"{name} isn't what the manifest says")
        out.append(rows)
    return out[0], out[1]
