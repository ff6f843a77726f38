"""Readers of structured files to tables, typed casts, profiles and canonical records."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.session import Tables

IMAGES = r"(?i)\.(png|jpe?g|gif|webp|bmp|tiff?)$"


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """One object a line, blank lines left out, with a declared schema; a line that isn't an object fails."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_json(spark: SparkSession, path: str, schema: T.StructType | str, records_key: str | None = None) -> DataFrame:
    """A list of records, or the list under ``records_key`` of an object."""
    reader = spark.read.option("multiLine", True).option("mode", "FAILFAST")
    if not records_key:
        return reader.schema(schema).json(path)
    schema = schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)
    nested: T.DataType = T.ArrayType(schema)
    for part in reversed(records_key.split(".")):
        nested = T.StructType([T.StructField(part, nested)])
    return reader.schema(nested).json(path).select(F.explode(records_key).alias("_r")).select("_r.*")


def read_csv(spark: SparkSession, path: str, dtypes: dict[str, str] | None = None, delimiter: str = ",") -> DataFrame:
    """Texts by header; ``dtypes`` (number, boolean) are cast. A number column all of whose values are integers of 64 bits has integers, others have doubles. A value that can't be cast is refused, with its row (from 0) in the file.

    With ``dtypes`` the file is read once for all checks."""
    rows = spark.read.csv(path, header=True, sep=delimiter, quote='"', escape='"', multiLine=True, encoding="UTF-8")
    if not dtypes:
        return rows
    own = rows.select("*", F.col("_metadata.file_path").alias("_file"), F.monotonically_increasing_id().alias("_nth"))  # a file is one task
    text = lambda c: F.trim(F.col(f"`{c}`"))
    value = lambda c: text(c).try_cast("double") if dtypes[c] == "number" else F.lower(text(c)).isin("true", "false")
    bad = lambda c: (F.coalesce(text(c), F.lit("")) != "") & ((value(c).isNull() | F.isnan(value(c))) if dtypes[c] == "number" else ~value(c))
    checked = [c for c, d in dtypes.items() if d in ("number", "boolean")]
    if unknown := {d for d in dtypes.values()} - {"number", "boolean", "string"}:
        raise ValueError(f"unknown dtypes {sorted(unknown)}")
    first = [F.min(F.when(bad(c), F.struct("_file", "_nth", F.lit(i), F.col(f"`{c}`").alias("value")))).alias(f"b{i}") for i, c in enumerate(checked)]
    whole = [F.coalesce(F.bool_and(F.when(F.coalesce(text(c), F.lit("")) != "", text(c).rlike(r"^[+-]?\d+$") & text(c).try_cast("long").isNotNull())), F.lit(False)).alias(f"i{i}") for i, c in enumerate(checked)]
    start = own.groupBy("_file").agg(F.min("_nth").alias("_start"))
    found = own.agg(*first, *whole).first()
    if worst := min((found[f"b{i}"] for i in range(len(checked)) if found[f"b{i}"]), default=None):
        at = worst["_nth"] - start.where(F.col("_file") == worst["_file"]).first()["_start"]
        c = checked[worst[2]]
        raise ValueError(f"row {at} of {worst['_file']}: column {c!r} is not a {dtypes[c]}: {worst['value']!r}")
    kinds = {c: "long" if found[f"i{i}"] and dtypes[c] == "number" else None for i, c in enumerate(checked)}
    return rows.withColumns({c: F.when(text(c) != "", text(c).cast("long")) if kinds.get(c) else typed(F.col(f"`{c}`"), d) for c, d in dtypes.items()})


def typed(text: Column, dtype: str) -> Column:
    """A text as a number or a boolean; blank is null; anything else is an error."""
    t = F.trim(text)
    if dtype == "string":
        return text
    value = t.try_cast("double") if dtype == "number" else F.when(F.lower(t) == "true", True).when(F.lower(t) == "false", False)
    bad = (F.coalesce(t, F.lit("")) != "") & (value.isNull() | (F.isnan(value) if dtype == "number" else F.lit(False)))
    return F.when(bad, F.raise_error(F.concat(F.lit(f"not a {dtype}: "), text)).cast("double" if dtype == "number" else "boolean")).otherwise(value)


def read_shards(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Parquet files as one table with ``origin_file`` and ``origin_row``; columns are the union of the files'."""
    rows = spark.read.option("mergeSchema", True).parquet(*paths)
    return rows.select("*", F.col("_metadata.file_name").alias("origin_file"), F.col("_metadata.row_index").alias("origin_row"))


def seek(rows: DataFrame, start: int, count: int) -> DataFrame:
    """Rows ``start`` on of one file: a range of row indices, which the scan prunes by."""
    return rows.where(F.col("origin_row").between(start, start + count - 1))


def inferred_dtype(kind: T.DataType) -> str | None:
    """The dtype of a column by its type: integers of 64 bits are objects, as they may not fit a double."""
    if isinstance(kind, T.NullType):
        return None
    if isinstance(kind, T.BooleanType):
        return "boolean"
    if isinstance(kind, (T.FloatType, T.DoubleType, T.ByteType, T.ShortType, T.IntegerType)):
        return "number"
    return "string" if isinstance(kind, T.StringType) else "array" if isinstance(kind, T.ArrayType) else "object"


def profile(rows: DataFrame) -> DataFrame:
    """column, nonnull, distinct, numeric, boolean, average_length, image_like, role.

    Roles: media if 90% look like image names; text at 40 characters on average; category if values repeat and are few. Rows are dealt over the tasks first, whatever files they come from, so that no task counts the values of a whole
    file; a value of a column is one row with its count from there on."""
    spark = rows.sparkSession
    texts = [F.trim(F.col(f"`{c}`").cast("string")) for c in rows.columns]
    dealt = rows.select(*[t.alias(f"t{i}") for i, t in enumerate(texts)])
    dealt = dealt.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), F.xxhash64(*dealt.columns))
    each = dealt.select(F.posexplode(F.array(*dealt.columns)).alias("at", "t")).groupBy("at", F.when(F.col("t") != "", F.col("t")).alias("t")).agg(F.count(F.lit(1)).alias("n"))
    has, n = F.col("t").isNotNull(), F.col("n")
    total = lambda c: F.coalesce(F.sum(F.when(c, n)), F.lit(0))
    x = each.groupBy("at").agg(F.sum("n").alias("rows"), total(has).alias("nonnull"), F.count("t").alias("distinct"), total(has & F.col("t").try_cast("double").isNotNull()).alias("_f"), total(has & F.lower("t").isin("true", "false")).alias("_b"), (F.sum(F.length("t") * n) / F.nullif(total(has), F.lit(0))).alias("average_length"), total(has & F.col("t").rlike(IMAGES)).alias("_m"))
    names = spark.createDataFrame(list(enumerate(rows.columns)), "at int, column string")
    x = names.join(x, "at", "left").na.fill(0, ["rows", "nonnull", "distinct", "_f", "_b", "_m"])  # of an empty table too
    number, boolean, media = (F.col("nonnull") > 0) & (F.col("_f") == F.col("nonnull")), (F.col("nonnull") > 0) & (F.col("_b") == F.col("nonnull")), (F.col("nonnull") > 0) & (F.col("_m") >= 0.9 * F.col("nonnull"))
    few = (F.col("distinct") > 0) & (F.col("distinct") < F.col("nonnull")) & (F.col("distinct") <= F.least(F.lit(50.0), F.greatest(F.lit(10.0), 0.2 * F.col("rows"))))
    role = F.when(media, "media").when(boolean, "boolean").when(number, "number").when(F.col("average_length") >= 40, "text").when(few, "category").otherwise("string")
    return x.select("column", "nonnull", "distinct", number.alias("numeric"), boolean.alias("boolean"), "average_length", media.alias("image_like"), role.alias("role"))


def described(rows: DataFrame, *, id_column: str | None = None, most_distinct: int = 1000) -> DataFrame:
    """column, dtype, missing, distinct (null over ``most_distinct``), sample, role: what a table is offered as. ``profile`` and, besides, the column that names the rows (refused if it doesn't tell them apart), the first column of
    media and of text, and labels: categories that are neither.

    The sample is the least value, the greatest one, and the one of least hash, 80 characters of each."""
    if id_column is not None and id_column not in rows.columns:
        raise ValueError(f"the table has no column named {id_column}")
    found = profile(rows).withColumn("at", F.array_position(F.lit(rows.columns), F.col("column")))
    texts = {c: F.when(F.trim(F.col(f"`{c}`").cast("string")) != "", F.col(f"`{c}`").cast("string")) for c in rows.columns}
    samples = rows.agg(F.count(F.lit(1)).alias("rows"), *[F.array_distinct(F.array_compact(F.array(F.min(t), F.max(t), F.min_by(t, F.xxhash64(t))))).alias(f"s{i}") for i, t in enumerate(texts.values())])
    each = samples.select("rows", F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.transform(f"s{i}", lambda x: F.substring(x, 1, 80)).alias("sample")) for i, c in enumerate(texts)])).alias("x")).select("rows", "x.*")
    known = {r["column"]: r for r in found.join(each, "column").collect()}  # a row for each column
    if id_column is not None and known[id_column]["distinct"] < known[id_column]["rows"]:
        raise ValueError(f"the column {id_column} is not unique, so it cannot name rows")
    first = lambda role: next((c for c in rows.columns if known[c]["role"] == role and c != id_column), None)
    media, text = first("media"), first("text")
    out = []
    for c in rows.columns:
        r = known[c]
        dtype = "boolean" if r["boolean"] else "number" if r["numeric"] else "string"
        label = dtype == "string" and r["role"] == "category" and c not in (id_column, media, text)
        role = "id" if c == id_column else "media" if c == media else "text" if c == text else "label" if label else None
        out.append((c, "category" if label else dtype, r["rows"] - r["nonnull"], r["distinct"] if r["distinct"] <= most_distinct else None, r["sample"], role))
    return rows.sparkSession.createDataFrame(out, "column string, dtype string, missing long, distinct long, sample array<string>, role string")


def named_groups(path: Column, pattern: str) -> dict[str, Column]:
    """The named groups of a pattern, as columns; null where the path doesn't match."""
    groups = re.compile(pattern).groupindex
    java = pattern.replace("(?P<", "(?<")
    return {n: F.when(path.rlike(java), F.regexp_extract(path, java, i)) for n, i in groups.items()}


def media_table(spark: SparkSession, path: str, pattern: str, glob: str = "*") -> DataFrame:
    """One row for each file: path, bytes, sha256 and the named groups of ``pattern``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"), *[c.alias(n) for n, c in named_groups(F.col("path"), pattern).items()])


def keyed_rows(rows: DataFrame, mapping: str, key_name: str) -> DataFrame:
    """A map column's entries as rows, the key as a column."""
    return rows.select(*[c for c in rows.columns if c != mapping], F.explode(mapping).alias(key_name, "_v")).select("*", "_v.*").drop("_v")


def named_arrays(rows: DataFrame, array: str, names: list[str]) -> DataFrame:
    """The elements of an array column as named columns."""
    return rows.select("*", *[F.get(array, F.lit(i)).alias(n) for i, n in enumerate(names)]).drop(array)


def follow_references(rows: DataFrame, id_column: str, pointer: str) -> DataFrame:
    """id and ``target``: where the chain of pointers from each row ends; null if it ends nowhere, in a cycle or at an id that isn't there.

    Pointers double in each round, and each round is a written table. Rows that have come to an end rest; rounds go on until none are left, or the others have gone further than there are rows, as only cycles do."""
    tables = Tables(rows.sparkSession, "references")
    at = tables.write(rows.select(F.col(id_column).alias("id"), F.coalesce(pointer, id_column).alias("to"), F.col(pointer).isNull().alias("ended")))
    steps, total = 1, at.count()
    while steps <= total and at.where(~F.col("ended") & F.col("to").isNotNull()).head(1):
        hop = at.select(F.col("id").alias("to"), F.col("to").alias("next"), F.col("ended").alias("there"))
        new = tables.write(at.join(hop, "to", "left").select("id", F.when(F.col("ended"), F.col("to")).otherwise(F.col("next")).alias("to"), (F.col("ended") | F.coalesce("there", F.lit(False))).alias("ended")))
        tables.drop(at)
        at, steps = new, 2 * steps
    return at.select("id", F.when(F.col("ended"), F.col("to")).alias("target"))


def to_records(rows: DataFrame, dataset: str, release: str, unit: str, source_id: str, *, text: str | None = None, question: str | None = None, choices: str | None = None, media: list[str] | None = None) -> DataFrame:
    """The canonical shape: id, dataset_id, release_id, unit, text, question, choices, assets and the source columns as JSON."""
    from tessera.model import record_id

    col = lambda c, kind="string": F.col(c).cast(kind) if c else F.lit(None).cast(kind)
    assets = F.filter(F.array(*[F.struct(F.lit(m).alias("source_field"), F.lit(i).alias("order"), F.col(m).alias("uri")) for i, m in enumerate(media or [])]), lambda a: a["uri"].isNotNull()) if media else F.array().cast("array<struct<source_field: string, order: int, uri: string>>")
    return rows.select(record_id(F.lit(dataset), F.lit(release), unit, F.col(source_id).cast("string")).alias("id"), F.lit(dataset).alias("dataset_id"), F.lit(release).alias("release_id"), F.lit(unit).alias("unit"), col(text).alias("text"), col(question).alias("question"), (F.col(choices).cast("array<string>") if choices else F.array().cast("array<string>")).alias("choices"), assets.alias("assets"), F.to_json(F.struct(*sorted(rows.columns))).alias("source_json"))
