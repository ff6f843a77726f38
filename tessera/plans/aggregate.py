"""Distributions of fields over a matched population, and comparisons of two fields."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.scalars import payload
from tessera.model import Field, Query, Snapshot
from tessera.plans.query import matching

MAX_FIELDS, MAX_TOP = 12, 200


def _fields(snapshot: Snapshot, field_ids: list[str]) -> list[Field]:
    if not 1 <= len(field_ids) <= MAX_FIELDS:
        raise ValueError(f"1 to {MAX_FIELDS} fields")
    return [snapshot.columns[f] for f in field_ids]


def numeric(snapshot: Snapshot, query: Query, field_ids: list[str]) -> DataFrame:
    """field_id, denominator, missing, present, min, max, mean of number fields; one pass for all. The query's sample doesn't apply."""
    fields = _fields(snapshot, field_ids)
    if other := [f.id for f in fields if f.dtype != "number"]:
        raise ValueError(f"not numbers: {other}")
    rows = matching(snapshot, query)
    aggs = [F.count(F.lit(1)).alias("denominator")]
    for i, f in enumerate(fields):
        c = F.col(f"`{f.column}`")
        aggs += [F.count(c).alias(f"n{i}"), F.min(c).alias(f"lo{i}"), F.max(c).alias(f"hi{i}"), F.avg(c).alias(f"mean{i}")]
    one = rows.agg(*aggs)
    each = [F.struct(F.lit(f.id).alias("field_id"), (F.col("denominator") - F.col(f"n{i}")).alias("missing"), F.col(f"n{i}").alias("present"), F.col(f"lo{i}").cast("double").alias("min"), F.col(f"hi{i}").cast("double").alias("max"), F.col(f"mean{i}").alias("mean")) for i, f in enumerate(fields)]
    return one.select("denominator", F.explode(F.array(*each)).alias("x")).select("x.field_id", "denominator", "x.missing", "x.present", "x.min", "x.max", "x.mean")


def display(field: Field) -> Column:
    """A value as a category shows it: without its tag."""
    c = F.col(f"`{field.column}`")
    return payload(c) if field.dtype == "category" else c.cast("string")


def categorical(snapshot: Snapshot, query: Query, field_ids: list[str], top: int = 24) -> DataFrame:
    """field_id, value, count, missing, denominator, truncated: the most frequent values of each field, count falling and value rising; one pass for all."""
    if not 1 <= top <= MAX_TOP:
        raise ValueError(f"top is 1 to {MAX_TOP}")
    fields = _fields(snapshot, field_ids)
    pairs = F.array(*[F.struct(F.lit(f.id).alias("field_id"), display(f).alias("value")) for f in fields])
    counts = matching(snapshot, query).select(F.explode(pairs).alias("x")).groupBy("x.field_id", "x.value").agg(F.count(F.lit(1)).alias("count"))
    of_field = Window.partitionBy("field_id")
    out = counts.withColumn("denominator", F.sum("count").over(of_field)).withColumn("missing", F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("count"))).over(of_field), F.lit(0)))
    out = out.where(F.col("value").isNotNull()).withColumn("_nth", F.row_number().over(of_field.orderBy(F.desc("count"), "value"))).withColumn("truncated", F.count(F.lit(1)).over(of_field) > top)
    return out.where(F.col("_nth") <= top).select("field_id", "value", "count", "missing", "denominator", "truncated")


def envelope(snapshot: Snapshot, query: Query, field_ids: list[str], top: int = 24) -> DataFrame:
    """field_id, kind (numeric, categorical or unsupported), denominator, missing, present, min, max, mean, counts (value, count; most frequent first), truncated.

    All fields that are asked for have a row, in their order. Structured fields are unsupported. ``warnings`` says what the counts aren't."""
    fields = _fields(snapshot, field_ids)
    kind = {f.id: "numeric" if f.dtype == "number" else "unsupported" if f.dtype in ("array", "object") else "categorical" for f in fields}
    wanted = F.explode(F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(f.id).alias("field_id"), F.lit(kind[f.id]).alias("kind")) for i, f in enumerate(fields)])).alias("x")
    out = matching(snapshot, query).agg(F.count(F.lit(1)).alias("denominator")).select("denominator", wanted).select("x.*", "denominator")
    parts = []
    if numbers := [f for f in field_ids if kind[f] == "numeric"]:
        n = numeric(snapshot, query, numbers)
        parts.append(n.select("field_id", "missing", "present", "min", "max", "mean", F.lit(None).cast("array<struct<value: string, count: bigint>>").alias("counts"), F.lit(None).cast("boolean").alias("truncated")))
    if values := [f for f in field_ids if kind[f] == "categorical"]:
        c = categorical(snapshot, query, values, top)
        listed = F.transform(F.sort_array(F.collect_list(F.struct((-F.col("count")).alias("o"), "value"))), lambda x: F.struct(x["value"].alias("value"), (-x["o"]).alias("count")))
        c = c.groupBy("field_id").agg(F.max("missing").alias("missing"), F.max("denominator").alias("_d"), listed.alias("counts"), F.bool_or("truncated").alias("truncated"))  # ``top`` values a field
        none = F.lit(None).cast("double")
        parts.append(c.select("field_id", "missing", (F.col("_d") - F.col("missing")).alias("present"), none.alias("min"), none.alias("max"), none.alias("mean"), "counts", "truncated"))
    if parts:
        out = out.join(F.broadcast(reduce(DataFrame.unionByName, parts)), "field_id", "left")  # a row for each field
    else:
        out = out.select("*", *[F.lit(None).cast(t).alias(n) for n, t in (("missing", "long"), ("present", "long"), ("min", "double"), ("max", "double"), ("mean", "double"), ("counts", "array<struct<value: string, count: bigint>>"), ("truncated", "boolean"))])
    # a field without any value has no row among the categories
    out = out.withColumn("missing", F.when(F.col("kind") == "categorical", F.coalesce("missing", "denominator")).otherwise(F.col("missing")))
    out = out.withColumn("present", F.when(F.col("kind") == "categorical", F.coalesce("present", F.lit(0))).otherwise(F.col("present")))
    return out.select("ord", "field_id", "kind", "denominator", "missing", "present", "min", "max", "mean", "counts", "truncated").orderBy("ord")


def warnings(snapshot: Snapshot, query: Query) -> list[str]:
    """What a reader of ``envelope`` must know."""
    out = ["the query's sample doesn't apply: counts are of all that the filter matches"] if query.sample else []
    return out + ([] if snapshot.population_scope == "complete" else [f"counts are of a {snapshot.population_scope} snapshot, not of the whole population"])


def tool(rows: DataFrame, column: str, scope: DataFrame | None = None, top: int = 50) -> DataFrame:
    """denominator, missing, mean, min, max, counts of a column over the records (id) of ``scope``: numbers have a mean and bounds, other values the most frequent
    of them as texts. Numbers that aren't finite make a column one of texts."""
    if scope is not None:
        rows = rows.join(scope.select("id").distinct(), "id", "left_semi")
    is_number = dict(rows.dtypes)[column] in ("tinyint", "smallint", "int", "bigint", "float", "double")
    v = F.col(f"`{column}`")
    x = v.cast("double")
    finite = F.lit(is_number) & x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")) if is_number else F.lit(False)
    counts = rows.groupBy(v.cast("string").alias("value")).agg(F.count(F.lit(1)).alias("count"), F.count_if(finite).alias("f"), F.sum(F.when(finite, x)).alias("s"), F.min(F.when(finite, x)).alias("lo"), F.max(F.when(finite, x)).alias("hi"))
    first = counts.where("value is not null").orderBy(F.desc("count"), "value").limit(top).agg(F.sort_array(F.collect_list(F.struct((-F.col("count")).alias("o"), "value"))).alias("t"))
    one = counts.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("denominator"), F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("count"))), F.lit(0)).alias("missing"), F.sum("f").alias("f"), F.sum("s").alias("s"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    numbers = (F.col("f") > 0) & (F.col("f") == F.col("denominator") - F.col("missing"))
    listed = F.transform("t", lambda p: F.struct(p["value"].alias("value"), (-p["o"]).alias("count")))
    return one.withColumn("_k", F.lit(1)).join(first.withColumn("_k", F.lit(1)), "_k").select("denominator", "missing", F.when(numbers, F.col("s") / F.col("f")).alias("mean"), F.when(numbers, F.col("lo")).alias("min"), F.when(numbers, F.col("hi")).alias("max"), F.when(~F.coalesce(numbers, F.lit(False)), listed).alias("counts"))  # one row each


def coded(snapshot: Snapshot, ids: DataFrame, field_id: str, top: int = 24) -> DataFrame:
    """ord, id, code for (ord, id): codes of the most frequent values from 0, the others get ``top``, missing values and unknown ids -1."""
    field = snapshot.columns[field_id]
    values = ids.join(snapshot.records.select(F.col("id").alias("_id"), display(field).alias("value")), F.col("id") == F.col("_id"), "left")
    counts = values.where("value is not null").groupBy("value").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "value").limit(top)
    codes = counts.select(F.col("value").alias("_v"), (F.row_number().over(Window.orderBy(F.desc("n"), "value")) - 1).alias("_code"))  # at most ``top`` rows
    out = values.join(F.broadcast(codes), F.col("value") == F.col("_v"), "left")
    return out.select("ord", "id", F.coalesce("_code", F.when(F.col("value").isNotNull(), F.lit(top)), F.lit(-1)).cast("int").alias("code"))


def correlation(rows: DataFrame, left: str, right: str) -> DataFrame:
    """pairs, missing_left, missing_right, pearson: null under two pairs or without variance."""
    a, b = F.col(left).cast("double"), F.col(right).cast("double")
    both = a.isNotNull() & b.isNotNull()
    x, y = F.when(both, a), F.when(both, b)
    got = rows.agg(F.count_if(both).alias("pairs"), F.count_if(a.isNull()).alias("missing_left"), F.count_if(b.isNull()).alias("missing_right"), F.corr(x, y).alias("_r"), F.stddev_pop(x).alias("_sx"), F.stddev_pop(y).alias("_sy"))
    return got.select("pairs", "missing_left", "missing_right", F.when((F.col("pairs") >= 2) & (F.col("_sx") > 0) & (F.col("_sy") > 0), F.col("_r")).alias("pearson"))


def crosstab(rows: DataFrame, left: str, right: str) -> DataFrame:
    """left_value, right_value, count of the pairs that are present; values are tagged categories or texts, so that 1 and "1" differ."""
    present = rows.where(F.col(left).isNotNull() & F.col(right).isNotNull())
    return present.groupBy(F.col(left).alias("left_value"), F.col(right).alias("right_value")).agg(F.count(F.lit(1)).alias("count"))


def grouped_numeric(rows: DataFrame, group: str, value: str, *, accuracy: int | None = None) -> DataFrame:
    """group_value, count, mean, median, min, max.

    The exact median holds a group's different values in one task; with ``accuracy`` it is a value whose rank is off by a share of 1 / accuracy at most, from sketches of a bounded size."""
    v = F.col(value).cast("double")
    present = rows.where(F.col(group).isNotNull() & v.isNotNull())
    return present.groupBy(F.col(group).alias("group_value")).agg(F.count(F.lit(1)).alias("count"), F.avg(v).alias("mean"), (F.percentile(v, 0.5) if accuracy is None else F.percentile_approx(v, 0.5, accuracy)).alias("median"), F.min(v).alias("min"), F.max(v).alias("max"))


def facet(rows: DataFrame, *columns: str) -> DataFrame:
    """facet, value, count: how many rows have each value in each of the array columns."""
    parts = [rows.select(F.lit(c).alias("facet"), F.explode(F.array_distinct(c)).alias("value")) for c in columns]
    return reduce(DataFrame.unionByName, parts).groupBy("facet", "value").agg(F.count(F.lit(1)).alias("count"))
