"""The catalogue of datasets: its versions, search, facets and orders."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.text import contains_all_words

#: What of a dataset can be browsed, from the most on.
COVERAGE = ("full", "preview", "on_request", "elsewhere", "metadata")


def scan(spark: SparkSession, path: str) -> DataFrame:
    """The catalogue's entries, a JSON document each; entries without a dataset, release or snapshot id are refused."""
    out = spark.read.option("multiLine", True).json(path)
    keys = ["dataset_id", "release_id", "snapshot_id"]
    bad = out.where(reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])).limit(1).collect()
    if bad:
        raise ValueError(f"an entry lacks an id: {bad[0]}")
    return out


def versions(entries: DataFrame) -> DataFrame:
    """``entries`` with ``active``: the newest release of each dataset (``released``, then ids decide); the others are retained."""
    newest = Window.partitionBy("dataset_id").orderBy(F.desc_nulls_last("released"), F.desc("release_id"), F.desc("snapshot_id"))
    return entries.withColumn("active", F.row_number().over(newest) == 1)


def version(entries: DataFrame, dataset: str, release: str | None = None, snapshot: str | None = None) -> DataFrame:
    """The dataset's active version, or the one that is named; a retained version is found by its ids only."""
    rows = versions(entries.where(F.col("dataset_id") == dataset))
    if release is None and snapshot is None:
        return rows.where("active")
    for column, value in (("release_id", release), ("snapshot_id", snapshot)):
        rows = rows.where(F.col(column) == value) if value is not None else rows
    return rows


def search(entries: DataFrame, term: str) -> DataFrame:
    """Entries in whose names, ids, aliases, descriptions, tasks and labels each word of the term occurs, whatever the case."""
    lists = [F.array_join(F.coalesce(c, F.array().cast("array<string>")), " ") for c in ("aliases", "tasks", "labels")]
    return entries.where(contains_all_words(F.concat_ws(" ", "name", "dataset_id", lists[0], "description", *lists[1:]), term))


def with_facets(entries: DataFrame, *, modality: list[str] = [], task: list[str] = [], access: list[str] = [], coverage: list[str] = [], annotations: bool = False) -> DataFrame:  # noqa: B006
    """Entries that have one of the values of each facet that is asked for. An entry that says nothing of its access is unverified."""
    out = entries
    for column, values in (("modalities", modality), ("tasks", task)):
        if values:
            out = out.where(F.arrays_overlap(column, F.array(*map(F.lit, values))))
    if access:
        out = out.where(F.coalesce("access", F.lit("unverified")).isin(access))
    if coverage:
        out = out.where(F.col("coverage").isin(coverage))
    return out.where(F.size("labels") > 0) if annotations else out


def ordered(entries: DataFrame, by: str | None = None) -> DataFrame:
    """By name; by how much of a dataset can be browsed, then name; or as it is."""
    if by is None:
        return entries
    name = [F.lower("name"), F.col("name"), F.col("dataset_id")]
    if by == "name":
        return entries.orderBy(*name)
    if by == "coverage":
        place = F.array_position(F.array(*map(F.lit, COVERAGE)), F.col("coverage"))
        return entries.orderBy(F.when(place > 0, place).otherwise(len(COVERAGE) + 1), *name)
    raise ValueError(f"unknown order {by}")


def previews(records: DataFrame, dataset: str = "dataset_id", order: str = "row_ordinal", *, most: int = 4, length: int = 220) -> DataFrame:
    """dataset, kind, tiles, modality: of each dataset the places of its first ``most`` different images, or, without any, the first texts of as many records: a record's question, else its text, its first asset's text,
    its first turn's, of ``length`` characters. Records with a source status give no text. The modality is that of the first asset that has one.

    Columns that the records lack (question, text, assets, conversation, source_status) count as missing."""
    none = lambda c: F.col(c) if c in records.columns else F.lit(None).cast("string")
    kinds = dict(records.dtypes)
    assets = F.posexplode("assets").alias("p", "a") if "assets" in records.columns else None
    filled = lambda c: F.when(F.trim(c) != "", F.substring(F.trim(c), 1, length))
    inner = lambda c, f: F.get(F.filter(F.transform(c, lambda x: filled(x[f])), lambda x: x.isNotNull()), F.lit(0))
    text = F.coalesce(filled(none("question")), filled(none("text")), *([inner("assets", "text")] if "assets" in kinds and "text:" in kinds["assets"] else []), *([inner("conversation", "content")] if "conversation" in kinds else []))
    place = lambda *by: F.row_number().over(Window.partitionBy(dataset).orderBy(*by))
    texts = records.where(none("source_status").isNull()).select(dataset, order, text.alias("tile")).where("tile is not null").withColumn("n", place(order)).where(F.col("n") <= most)
    listed = lambda df, name: df.groupBy(dataset).agg(F.transform(F.sort_array(F.collect_list(F.struct("n", "tile"))), lambda x: x["tile"]).alias(name))
    out = records.select(dataset).distinct().join(listed(texts, "texts"), dataset, "left")
    if assets is None:
        return out.select(dataset, F.when(F.col("texts").isNotNull(), "text").alias("kind"), F.coalesce("texts", F.array().cast("array<string>")).alias("tiles"), F.when(F.col("texts").isNotNull(), "text").alias("modality"))
    each = records.select(dataset, order, assets).select(dataset, order, "p", "a.id", "a.modality", "a.uri")
    images = each.where("modality = 'image' and uri <> ''").groupBy(dataset, F.coalesce("id", F.lit("")).alias("id")).agg(F.min(F.struct(order, "p", "uri")).alias("x"))
    images = images.select(dataset, "x.*").withColumn("n", place(order, "p")).where(F.col("n") <= most).withColumnRenamed("uri", "tile")
    modality = each.where("modality <> ''").groupBy(dataset).agg(F.min_by("modality", F.struct(order, "p")).alias("modality"))
    out = out.join(listed(images, "images"), dataset, "left").join(modality, dataset, "left")
    kind = F.when(F.col("images").isNotNull(), "image").when(F.col("texts").isNotNull(), "text")
    return out.select(dataset, kind.alias("kind"), F.coalesce("images", "texts", F.array().cast("array<string>")).alias("tiles"), F.coalesce("modality", F.when(kind == "text", "text")).alias("modality"))
