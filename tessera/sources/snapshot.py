"""Snapshots as immutable Parquet: validated when built, verified when opened; digests of tables."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.model import Field, Snapshot
from tessera.sources.digest import ordered_digest

MAX_RECORD_BYTES = 16 << 20


def digest(rows: DataFrame) -> DataFrame:
    """count and a digest that doesn't depend on the rows' order: the sum of a hash of each row as JSON, columns by name."""
    h = F.xxhash64(F.to_json(F.struct(*[f"`{c}`" for c in sorted(rows.columns)]), {"ignoreNullFields": "false"}))
    return rows.agg(F.count(F.lit(1)).alias("count"), F.coalesce(F.sum(h.cast("decimal(20,0)")), F.lit(0)).cast("string").alias("digest"))


def problems(records: DataFrame, fields: dict[str, Field], max_record_bytes: int = 2_000_000) -> DataFrame:
    """check, rows: empty or repeated ids, records that are too large, numbers that aren't finite; one pass and one count of ids."""
    size = F.octet_length(F.to_json(F.struct("*")))
    numbers = [F.col(f"`{f.column}`") for f in fields.values() if f.dtype == "number"]
    odd = F.lit(False)
    for c in numbers:
        odd = odd | F.coalesce(F.isnan(c) | (F.abs(c) == float("inf")), F.lit(False))
    one = records.agg(F.count_if(F.coalesce(F.trim("id"), F.lit("")) == "").alias("empty ids"), F.count_if(size > min(max_record_bytes, MAX_RECORD_BYTES)).alias("too large"), F.count_if(odd).alias("not finite"))
    single = one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("check"), F.col(f"`{n}`").alias("rows")) for n in one.columns])).alias("x")).select("x.*")
    twice = records.groupBy("id").count().where("count > 1").agg(F.count(F.lit(1)).alias("rows")).select(F.lit("repeated ids").alias("check"), "rows")
    return single.unionByName(twice)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where, False)
    out.write(bytearray(text.encode()))
    out.close()


def build(records: DataFrame, fields: dict[str, Field], path: str, *, snapshot_id: str, unit: str, expected_count: int | None = None, order: list[str] | None = None, max_record_bytes: int = 2_000_000, max_bytes: int | None = None) -> Snapshot:
    """Writes a snapshot: refused as a whole if a record is invalid or the count isn't the expected one. ``max_bytes``: only the first records in order that are of so many bytes together.

    ``row_ordinal`` numbers the rows in the order given (else by id), and files are sorted by it."""
    spark = records.sparkSession
    bad = {r["check"]: r["rows"] for r in problems(records, fields, max_record_bytes).collect() if r["rows"]}
    if bad:
        raise ValueError(f"invalid records: {bad}")
    by = order or ["id"]
    if max_bytes is not None:
        records = within_bytes(records, by[0], max_bytes)
    # numbers by range: sort within range partitions, and start each at the count of those before it
    parts = records.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_part", F.spark_partition_id()).withColumn("_nth", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
    staging = f"{path}.staging"
    parts.write.mode("overwrite").parquet(staging)
    written = spark.read.parquet(staging)
    counts = written.groupBy("_part").count().orderBy("_part").collect()  # a row for each partition
    starts, total = [], 0
    for r in counts:
        starts.append((r["_part"], total))
        total += r["count"]
    if expected_count is not None and total != expected_count:
        raise ValueError(f"{total} records; {expected_count} were expected")
    offsets = spark.createDataFrame(starts or [(0, 0)], "_p int, _start long")
    out = written.join(F.broadcast(offsets), F.col("_part") == F.col("_p")).withColumn("row_ordinal", F.col("_start") + F.col("_nth")).drop("_part", "_p", "_nth", "_start")
    out.sortWithinPartitions("row_ordinal").write.mode("errorifexists").option("compression", "zstd").parquet(f"{path}/data")
    d = digest(spark.read.parquet(f"{path}/data")).first()
    manifest = {"snapshot_id": snapshot_id, "unit": unit, "count": total, "digest": d["digest"], "fields": [{"id": f.id, "dtype": f.dtype, "column": f.column, "ops": list(f.ops), "kinds": sorted(f.kinds)} for f in fields.values()]}
    write_text(spark, f"{path}/manifest.json", json.dumps(manifest, sort_keys=True))
    staged = spark._jvm.org.apache.hadoop.fs.Path(staging)
    staged.getFileSystem(spark._jsc.hadoopConfiguration()).delete(staged, True)
    return open_snapshot(spark, path)


def open_snapshot(spark: SparkSession, path: str, *, verify: bool = False) -> Snapshot:
    """Opens a snapshot by its manifest; ``verify`` counts and digests the rows again."""
    m = json.loads("".join(r[0] for r in spark.read.text(f"{path}/manifest.json").collect()))
    rows = spark.read.parquet(f"{path}/data")
    if verify:
        d = digest(rows).first()
        if (d["count"], d["digest"]) != (m["count"], m["digest"]):
            raise ValueError("the snapshot isn't what its manifest says")
    fields = {f["id"]: Field(f["id"], f["dtype"], f["column"], tuple(f["ops"]), frozenset(f["kinds"])) for f in m["fields"]}
    return Snapshot(rows, fields, m["snapshot_id"], m["unit"], "complete", m["count"])


def write_rows(rows: DataFrame, path: str, fmt: str, *, order: list[str] | None = None, pinned: tuple[int, str] | None = None) -> tuple[int, str]:
    """Rows as jsonl, parquet or csv, and (count, digest) of what is read back: with ``order`` the ordered digest. What differs from ``pinned`` is refused, and stays unnamed by any manifest."""
    spark = rows.sparkSession
    if fmt == "jsonl":
        rows.write.option("ignoreNullFields", "false").json(path)
        back = spark.read.schema(rows.schema).json(path)
    elif fmt == "parquet":
        rows.write.option("compression", "zstd").parquet(path)
        back = spark.read.parquet(path)
    elif fmt == "csv":
        text = rows.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in rows.columns])
        text.write.csv(path, header=True, quote='"', escape='"', emptyValue="")
        back = spark.read.csv(path, header=True, quote='"', escape='"', multiLine=True, schema=text.schema).na.fill("")
    else:
        raise ValueError(f"unknown format {fmt}")
    d = (ordered_digest(back, *order) if order else digest(back)).first()
    if pinned and (d["count"], d["digest"]) != tuple(pinned):
        raise ValueError(f"{d['count']} rows with the digest {d['digest']} were written; the recipe pins {pinned}")
    return d["count"], d["digest"]


def within_bytes(records: DataFrame, order: str, max_bytes: int) -> DataFrame:
    """The first records in order whose JSON is of ``max_bytes`` together at most.

    Sizes are added up by range partitions first, and within those that the bound falls in by a window each; no task sorts all records."""
    sized = records.withColumn("_size", F.octet_length(F.to_json(F.struct(*records.columns)))).repartitionByRange(order).withColumn("_part", F.spark_partition_id())
    sums = sized.groupBy("_part").agg(F.sum("_size").alias("_sum"))  # a row for each partition
    ahead = F.coalesce(F.sum("_sum").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select(F.col("_part").alias("_p"), ahead.alias("_ahead")).where(F.col("_ahead") < max_bytes)
    rows = sized.join(F.broadcast(sums), F.col("_part") == F.col("_p"))
    upto = F.sum("_size").over(Window.partitionBy("_part").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("_upto", F.col("_ahead") + upto).where(F.col("_upto") <= max_bytes).select(*records.columns)


def bundle_problems(ids: DataFrame, vectors: DataFrame) -> DataFrame:
    """check, rows: repeated ids on either side, ids without a vector, vectors of another length than the first's, and vectors that aren't finite."""
    size = F.size("vector")
    finite = F.coalesce(F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))), F.lit(False))
    one = vectors.agg(F.count_if(~finite).alias("not finite"), F.max(size).alias("hi"), F.min(size).alias("lo")).select(F.explode(F.array(F.struct(F.lit("not finite").alias("check"), F.col("not finite").alias("rows")), F.struct(F.lit("lengths differ").alias("check"), F.when(F.col("hi") != F.col("lo"), 1).otherwise(0).cast("long").alias("rows")))).alias("x")).select("x.*")
    twice = lambda df, name: df.groupBy("id").count().where("count > 1").agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("check"), "rows")
    missing = ids.join(vectors.select("id"), "id", "left_anti").agg(F.count(F.lit(1)).alias("rows")).select(F.lit("ids without a vector").alias("check"), "rows")
    return one.unionByName(twice(ids, "repeated ids")).unionByName(twice(vectors, "repeated vectors")).unionByName(missing)


def bundle(ids: DataFrame, vectors: DataFrame, scalars: DataFrame | None = None, *, check: bool = True) -> DataFrame:
    """ord, id, vector and scalar columns of a selection, in one table. What ``bundle_problems`` finds is refused; ``check=False`` only builds the plan."""
    if check:
        bad = {r["check"]: r["rows"] for r in bundle_problems(ids, vectors).collect() if r["rows"]}
        if bad:
            raise ValueError(f"invalid bundle: {bad}")
    out = ids.join(vectors, "id", "left")
    return out.join(scalars, "id", "left") if scalars is not None else out
