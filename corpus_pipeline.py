"""From documents to shards of training data, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet, and read again as the next one's docs.
A row's identity within a stage is a hash of all its columns, so that null and repeated ids are told apart; rows that are equal
in every column are copies of one another. A stage carries a row as one struct, so that no column's name clashes with its own.

Nulls: a null text is an empty one: it isn't toxic, is like other texts without words, holds no benchmark item, has no words to mix (and
so isn't taken), and has one byte to shard. Null ids, languages and sources are values like others. Empty tables of labels or benchmark reject
nothing; an empty table of documents stays empty. Ties go to the smallest id, a null one last, and then to the row's hash.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm import decontamination, mixing, sharding, simhash, toxicity
from tessera.llm._common import Scratch

def _identified(docs: DataFrame) -> DataFrame:
    """(row: its identity, doc: the row itself, doc_id, text, source)."""
    return docs.select(F.xxhash64(*docs.columns).alias("row"), F.struct(*docs.columns).alias("doc"), "doc_id", "text", "source")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents whose toxicity is at the threshold or over it. Without labels of both kinds, all documents score the share of toxic labels."""
    s = toxicity.Settings()
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    model = toxicity.train(docs, labels, ~held_out, s, in_task=True)
    rows = docs.select(F.struct(*docs.columns).alias("doc"), "text")
    return toxicity.score(rows, model, score_col="score").where(F.col("score") < s.threshold).select("doc.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingle sets with a similarity of 0.8 or more) the row of smallest id stays."""
    rows = _identified(docs)
    # the operator's rows name themselves by (doc_id, row), so that the smallest is the one to stay
    of = simhash.near_copies(rows.select(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row").alias("id"), "text"), width=5, similarity=0.8, id_col="id")
    keep = of.groupBy("root").agg(F.min("doc_id").alias("k")).select(F.col("k.row").alias("kept"))
    return rows.join(keep, F.col("row") == F.col("kept")).dropDuplicates(["row"]).select("doc.*")


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that contain a benchmark item of five words or more: shorter ones are in clean documents too."""
    rows = _identified(docs)
    found = decontamination.contained(rows.select("row", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), shortest=5, id_col="row")
    leaks = found.select(F.col("doc_id").alias("leak")).distinct()
    return rows.join(leaks, F.col("row") == F.col("leak"), "left_anti").select("doc.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: its whole epochs, and once more if it is within its source's last part of one."""
    rows = _identified(docs)
    mixed = mixing.mix(rows.select("row", "text", "source"), id_col="row")
    times = mixed.where("taken > 0").groupBy(F.col("doc_id").alias("id")).agg(F.sum(F.ceil(F.col("taken") / F.col("size"))).cast("int").alias("times"))
    out = rows.join(times, F.col("row") == F.col("id")).dropDuplicates(["row"])
    return out.select("doc", F.explode(F.sequence(F.lit(1), F.col("times")))).select("doc.*")


def pack_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows with their shard and their slot in it; columns of these names give way."""
    rows = _identified(docs)
    nth = lambda key, *by: F.row_number().over(Window.partitionBy(key).orderBy(*by))  # noqa: E731  copies of one row: few, as mixing repeats a row three times at most
    placed = sharding.shard(rows.select("row", "text"), id_col="row").select(F.col("doc_id").alias("id"), "shard", "slot")
    placed = placed.withColumn("m", nth("id", "shard", "slot"))
    out = rows.withColumn("n", nth("row", "doc_id")).join(placed, (F.col("row") == F.col("id")) & (F.col("n") == F.col("m")))
    own = [F.col(f"doc.`{c}`").alias(c) for c in docs.columns if c not in ("shard", "slot")]
    return out.select(*own, "shard", "slot")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_copies),
    ("decontamination", drop_benchmark_leaks),
    ("mixing", mix_sources),
    ("sharding", pack_shards),
]

#: SQL can express neither the classifier nor the components; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "pipeline")
    for _, stage in STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
