"""What is made of results: statuses, detector views, flattening, summaries, research imports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

STATUSES = ("completed", "failed", "not_applicable", "skipped", "not_scheduled")


def with_status(selection: DataFrame, items: DataFrame, absent: str = "not_scheduled") -> DataFrame:
    """Each id of the selection with its item's columns; ids without an item have the status ``absent``, which is neither zero nor failed."""
    return selection.join(items, "id", "left").withColumn("status", F.coalesce("status", F.lit(absent)))


def progress(items: DataFrame) -> DataFrame:
    """status, items, bytes."""
    return items.groupBy("status").agg(F.count(F.lit(1)).alias("items"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"))


def completed_only(items: DataFrame, outputs: list[str]) -> DataFrame:
    """Scalar outputs of completed items; those of others, and non-finite ones, are null."""
    own = lambda c: F.when((F.col("status") == "completed") & ~F.isnan(F.col(c).cast("double")), F.col(c))
    return items.withColumns({c: own(c) for c in outputs})


def _distinct_originals(assets: Column) -> Column:
    """Completed assets, the first one of each file."""
    done = F.filter(assets, lambda a: a["status"] == "completed")
    key = lambda a: F.coalesce(F.concat(F.lit("sha256:"), a["file_sha256"]), F.concat(F.lit("asset:"), a["asset_id"]))
    keys = F.transform(done, key)
    return F.filter(F.transform(done, lambda a, i: F.struct(a.alias("a"), (F.array_position(keys, key(a)) == i + 1).alias("first"))), lambda x: x["first"])


def detector_view(items: DataFrame, threshold: float, upstream: float, assets: str = "assets") -> DataFrame:
    """Detections at ``threshold`` or over it, with counts that are null where an asset isn't complete. Items that aren't completed stay as they are."""
    if not 0 <= upstream <= threshold <= 1:
        raise ValueError("a view can't show what the run before it left out")
    kept = F.transform(assets, lambda a: a.withField("detections", F.filter(a["detections"], lambda d: d["score"] >= threshold)))
    out = items.withColumn(assets, kept)
    boxes = F.flatten(F.transform(_distinct_originals(F.col(assets)), lambda x: x["a"]["detections"]))
    complete = (F.size(assets) > 0) & F.forall(assets, lambda a: a["status"] == "completed")
    done = F.col("status") == "completed"
    return out.withColumns({"complete": F.when(done, complete), "detection_count": F.when(done & complete, F.size(boxes)), "max_score": F.when(done, F.array_max(F.transform(boxes, lambda b: b["score"]))), "person_count": F.when(done & complete, F.size(F.filter(boxes, lambda b: b["class"] == "person")))})


def run_summary(items: DataFrame, top: int = 10) -> DataFrame:
    """kind, key, value: reasons of failures (the most frequent), token sums without negative ones, mean latency, verdicts."""
    reasons = items.where("status = 'failed'").groupBy(F.col("reason").alias("key")).agg(F.count(F.lit(1)).cast("double").alias("value")).orderBy(F.desc("value"), "key").limit(top).select(F.lit("reason").alias("kind"), "key", "value")
    sums = items.agg(F.sum(F.when(F.col("tokens") >= 0, F.col("tokens"))).cast("double").alias("t"), F.avg("latency").alias("l"))
    totals = sums.select(F.explode(F.array(F.struct(F.lit("tokens").alias("key"), F.col("t").alias("value")), F.struct(F.lit("latency").alias("key"), F.col("l").alias("value")))).alias("x")).select(F.lit("total").alias("kind"), "x.key", "x.value")
    verdicts = items.where("verdict is not null").groupBy(F.col("verdict").alias("key")).agg(F.count(F.lit(1)).cast("double").alias("value")).select(F.lit("verdict").alias("kind"), "key", "value")
    return reasons.unionByName(totals).unionByName(verdicts)


def tag_spread(items: DataFrame, columns: list[str], top: int = 12) -> DataFrame:
    """column, value, count: the most frequent values of each of the tag columns of completed items; texts and booleans, missing ones left out."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value")) for c in columns])
    counts = items.where("status = 'completed'").select(F.explode(pairs).alias("x")).where("x.value is not null").groupBy("x.column", "x.value").agg(F.count(F.lit(1)).alias("count"))
    nth = F.row_number().over(Window.partitionBy("column").orderBy(F.desc("count"), "value"))
    return counts.withColumn("_nth", nth).where(F.col("_nth") <= top).drop("_nth")


def mean_by(rows: DataFrame, field: str, score: str, top: int = 50) -> DataFrame:
    """The most frequent values of a field with count and mean score."""
    return rows.groupBy(field).agg(F.count(F.lit(1)).alias("count"), F.avg(score).alias("mean")).orderBy(F.desc("count"), field).limit(top)


def import_research(selection: DataFrame, values: DataFrame, kind: str, *, bounds: tuple[float, float] | None = None, allowed: list[str] | None = None) -> DataFrame:
    """id, status, value of an outside result over a selection; ids it lacks are not_applicable. What ``invalid`` finds is refused."""
    bad = invalid(selection, values, kind, bounds=bounds, allowed=allowed).limit(1).collect()
    if bad:
        raise ValueError(f"{bad[0]['problem']}: {bad[0]['id']}")
    return selection.join(values.select("id", "value"), "id", "left").select("id", F.when(F.col("value").isNotNull(), "completed").otherwise("not_applicable").alias("status"), "value")


def invalid(selection: DataFrame, values: DataFrame, kind: str, *, bounds: tuple[float, float] | None = None, allowed: list[str] | None = None) -> DataFrame:
    """id, problem of outside results: unknown or repeated ids, values of the wrong kind or out of bounds."""
    unknown = values.join(selection, "id", "left_anti").select("id", F.lit("unknown id").alias("problem"))
    twice = values.groupBy("id").count().where("count > 1").select("id", F.lit("repeated id").alias("problem"))
    v = F.col("value")
    if kind == "scalar":
        low, high = bounds or (float("-inf"), float("inf"))
        bad = F.isnan(v.cast("double")) | ~v.cast("double").between(low, high) | (F.abs(v.cast("double")) == float("inf"))
    elif kind == "categorical":
        bad = ~v.isin(allowed or []) if allowed else F.lit(False)
    elif kind == "region":
        bad = ~((v["x2"] > v["x1"]) & (v["y2"] > v["y1"]))
    elif kind == "vector":  # of finite numbers, and of one length
        size = values.where(v.isNotNull()).agg(F.min(F.size("value"))).first()[0]
        bad = (F.size(v) == 0) | (F.size(v) != F.lit(size)) | F.exists(v, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    elif kind == "response":
        bad = F.trim(v.cast("string")) == ""
    else:
        raise ValueError(f"unknown kind {kind}")
    return unknown.unionByName(twice).unionByName(values.where(v.isNotNull() & bad).select("id", F.lit("invalid value").alias("problem")))


def scalar_columns(rows: DataFrame, coords: str = "coords") -> DataFrame:
    """x, y and (null for two dimensions) z from a coordinate array; vectors aren't scalar results."""
    return rows.withColumns({n: F.get(coords, F.lit(i)) for i, n in enumerate("xyz")}).drop(coords)


def row_activations(rows: DataFrame, array: str, id_column: str = "id") -> DataFrame:
    """least, most, mean, nonzero and a digest of each row's numbers, given as texts."""
    x = F.transform(array, lambda v: v.try_cast("double"))
    return rows.select(id_column, F.array_min(x).alias("least"), F.array_max(x).alias("most"), (F.aggregate(x, F.lit(0.0), lambda a, b: a + b) / F.size(x)).alias("mean"), F.size(F.filter(x, lambda v: v != 0)).alias("nonzero"), F.sha2(F.array_join(array, ","), 256).alias("digest"))


def asset_estimate(records: DataFrame, assets: str = "assets") -> DataFrame:
    """references, unique_assets (by content, else by id), known_bytes."""
    a = records.select(F.explode(assets).alias("a")).select(F.coalesce("a.sha256", "a.id").alias("key"), F.col("a.bytes").alias("bytes"))
    return a.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("bytes").alias("bytes")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("references"), F.count(F.lit(1)).alias("unique_assets"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("known_bytes"))
