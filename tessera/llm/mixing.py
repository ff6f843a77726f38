"""Mixing sources to target weights, with DataFrame operations only.

Each row gets a hash-random key; within its source it stands at its key's place, and the words before it are a prefix sum
over key ranges (sums of ranges first, then sums within a range). A source's budget takes whole epochs and then the prefix
that fills the rest, the last row in part, so that the budget is met to the word.

Budgets: the sources, by code point with null last, have the weights in turn, and share the words of all sources by them;
none gets over ``max_epochs`` times its own words, and what is over is shared again by weight until none is above. That is a
common level times the weight, cut at the caps; the level is the largest of those that result from capping the sources one
by one by growing cap per weight.

Scale: two shuffles of (id, source, size, key), none of texts. A source of any share is dealt over 4096 key ranges, and only
sums of sources and ranges meet in one task. The key is of the id and the text, so that rows without an id, or of one id, are spread too.

Nulls: a null text has no words; a null source is a source of its own; a null id has a key too. Repeated rows are rows of
their own. Rows of equal keys stand by id, a null one last, then by size; sources that are capped at the same level go by code point. Only a text's length in words and its hash are kept. Rows without words take nothing. An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm._common import Scratch, n_words

#: Key ranges of each source: the key's first 12 of 60 bits.
RANGE_BITS, KEY_BITS = 12, 60


def targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), max_epochs: int = 3) -> DataFrame:
    """``sizes`` (source, source_size) with the weight and the target (double) of each source."""
    every = Window.partitionBy()
    w = F.element_at(F.array(*[F.lit(x).cast("long") for x in weights]), ((F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1) % len(weights) + 1).cast("int"))
    out = sizes.withColumn("weight", w).withColumn("_cap", F.col("source_size") * F.lit(max_epochs)).withColumn("_ratio", F.col("_cap").cast("double") / F.col("weight"))
    before = Window.orderBy("_ratio", F.asc_nulls_last("source")).rowsBetween(Window.unboundedPreceding, -1)
    capped, used = F.coalesce(F.sum("_cap").over(before), F.lit(0)), F.coalesce(F.sum("weight").over(before), F.lit(0))
    level = (F.sum("source_size").over(every) - capped).cast("double") / (F.sum("weight").over(every) - used)
    out = out.withColumn("_level", level).withColumn("_level", F.max("_level").over(every))
    return out.select("source", "source_size", "weight", F.least(F.col("_cap").cast("double"), F.col("weight") * F.col("_level")).alias("target"))


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (5, 2, 1), max_epochs: int = 3, seed: int = 42) -> DataFrame:
    """A row for each row: doc_id, source, size, source_size, target, taken (words, repeats counted), before (words of the source's rows ahead of it)."""
    scratch = Scratch(docs.sparkSession, "mix")
    key = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.coalesce(F.md5(text_col), F.lit("")))), 1, KEY_BITS // 4), 16, 10).cast("long")
    base = scratch.write(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"), key.alias("_key")))
    base = base.withColumn("_range", F.shiftright("_key", KEY_BITS - RANGE_BITS).cast("int"))
    ranges = base.groupBy("source", "_range").agg(F.sum("size").alias("_sum"))
    ahead = F.coalesce(F.sum("_sum").over(Window.partitionBy("source").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    goals = targets(ranges.groupBy("source").agg(F.sum("_sum").alias("source_size")), weights, max_epochs)
    ranges = ranges.withColumn("_ahead", ahead).join(goals.withColumnRenamed("source", "_of"), F.col("source").eqNullSafe(F.col("_of")))
    ranges = ranges.select(F.col("source").alias("_s"), F.col("_range").alias("_g"), "_ahead", "source_size", "target")
    within = Window.partitionBy("source", "_range").orderBy("_key", F.asc_nulls_last("doc_id"), "size").rowsBetween(Window.unboundedPreceding, 0)
    out = base.withColumn("_within", F.sum("size").over(within) - F.col("size"))
    out = out.join(ranges, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_range") == F.col("_g")))
    budget = F.floor("target")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.greatest("source_size", F.lit(1)))).otherwise(F.lit(0)).cast("long")
    epochs = F.least(epochs, F.lit(max_epochs))
    out = out.withColumn("before", F.col("_ahead") + F.col("_within"))
    rest = budget - epochs * F.col("source_size") - F.col("before")
    taken = F.col("size") * epochs + F.greatest(F.lit(0), F.least(F.col("size"), rest))
    return out.select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"), "before")
