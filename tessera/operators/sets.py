"""Concatenation, membership, equality of id sets, asset units and their connected components."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.operators.sampling import first_per_group
from tessera.session import Tables, checkpoint_dir
from tessera.sources.digest import numbered


def concatenate(parts: dict[str, DataFrame], ordinal: str) -> DataFrame:
    """All rows with ``origin`` (the part) and ``origin_index``; columns that a part lacks are null. Order: (origin_index, ordinal)."""
    each = [df.withColumn("origin", F.lit(n)).withColumn("origin_index", F.lit(i)) for i, (n, df) in enumerate(parts.items())]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), each)


def membership(subjects: DataFrame, chosen: DataFrame) -> DataFrame:
    """ord, id, selected: 1 for the subjects (ord, id) among the chosen ids."""
    mark = chosen.select(F.col("id").alias("_id")).distinct().withColumn("_in", F.lit(1))
    return subjects.join(mark, F.col("id") == F.col("_id"), "left").select("ord", "id", F.coalesce("_in", F.lit(0)).alias("selected"))


def difference(requested: DataFrame, given: DataFrame) -> DataFrame:
    """id, problem: requested ids that aren't given, given ones that weren't requested, and repeated ones; empty if each is there once."""
    counts = given.groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    both = requested.select("id").distinct().withColumn("asked", F.lit(True)).join(counts, "id", "full")
    problem = F.when(F.col("n").isNull(), "missing").when(F.col("asked").isNull(), "unexpected").when(F.col("n") > 1, "repeated")
    return both.select("id", problem.alias("problem")).where("problem is not null")


def asset_units(records: DataFrame, assets: str = "assets", order: str = "row_ordinal") -> DataFrame:
    """One row for each asset id, from the first record that has it: asset fields, and the record's id as ``record_id``."""
    rows = records.select(F.col("id").alias("record_id"), F.col(order).alias("_o"), F.posexplode(assets).alias("_p", "asset"))
    first = first_per_group(rows.withColumn("_a", F.col("asset.id")), "_a", "_o", "_p")
    return first.select("asset.*", "record_id")


def asset_components(links: DataFrame, record: str, asset: str) -> DataFrame:
    """(record, component): records that share assets, directly or not; the component is its smallest record.

    Smallest labels travel record to asset to record, and jump over labels, until none changes; each round is a pair of
    aggregations. The number of rounds is logarithmic in the length of a chain of records."""
    spark = links.sparkSession
    checkpoint_dir(spark)
    edges = links.select(F.col(record).alias("r"), F.col(asset).alias("a")).distinct().checkpoint()
    labels = edges.select("r").distinct().withColumn("c", F.col("r"))
    while True:
        by_asset = edges.join(labels, "r").groupBy("a").agg(F.min("c").alias("m"))
        near = edges.join(by_asset, "a").groupBy("r").agg(F.min("m").alias("m"))
        moved = labels.join(near, "r").select("r", F.least("c", "m").alias("c"), F.col("c").alias("old"))
        # a record also takes its label's label
        hop = moved.select(F.col("r").alias("h"), F.col("c").alias("hc"))
        moved = moved.join(hop, F.col("c") == F.col("h"), "left").select("r", F.least("c", F.coalesce("hc", "c")).alias("c"), "old").checkpoint()
        changed = moved.where("c <> old").limit(1).count()
        labels = moved.select("r", "c")
        if not changed:
            return labels.select(F.col("r").alias(record), F.col("c").alias("component"))


def _ends(sizes: np.ndarray, most: int, ahead: np.ndarray) -> np.ndarray:
    """For each place of ``sizes`` the one where the next batch begins, if one begins here; ``ahead``: the sizes that follow, ``most`` at most."""
    upto = np.concatenate([[0], np.cumsum(np.concatenate([sizes, ahead]))])
    at = np.arange(len(sizes))
    return np.maximum(np.searchsorted(upto, upto[at] + most, side="right") - 1, at + 1)


def component_batches(labelled: DataFrame, component: str, order: str, *, most: int = 16, piece: int = 65_536) -> DataFrame:
    """The rows with ``batch`` (from 0): components one after the other, in the order of their first rows, each batch as many as fit into ``most`` rows; a component is never split, and a larger one is a batch by itself.

    Where a batch ends follows from where it begins, and at most ``most`` components are in one. So a piece of successive components is entered at one of its first ``most`` places, and for each of them
    a task finds where it is left, and after how many batches. The driver follows these, ``most`` numbers a piece, and the pieces' batches are told by tasks again."""
    spark, tables = labelled.sparkSession, Tables(labelled.sparkSession, "batches")
    piece = max(piece, most)
    sizes = labelled.groupBy(component).agg(F.count(F.lit(1)).alias("size"), F.min(order).alias("first"))
    at = tables.write(numbered(sizes, tables, "first", component, name="at").select(F.col(component).alias("_c"), "size", "at"))
    # a piece also gets the first places of the next one, which its last batch may take in
    own = at.select(F.floor(F.col("at") / piece).alias("piece"), "at", "size")
    next_ones = own.where((F.col("at") % piece < most) & (F.col("piece") > 0)).withColumn("piece", F.col("piece") - 1)
    pieces = own.unionByName(next_ones)

    def steps(pdf: pd.DataFrame) -> tuple[int, int, np.ndarray]:
        pdf = pdf.sort_values("at")
        k = int(pdf["piece"].iloc[0])
        n = int((pdf["at"] // piece == k).sum())
        values = np.minimum(pdf["size"].to_numpy(), most + 1)
        return k, n, _ends(values[:n], most, values[n:])

    def passed(pdf: pd.DataFrame) -> pd.DataFrame:
        k, n, ends = steps(pdf)
        out, count = np.arange(n + most), np.zeros(n + most, dtype=np.int64)  # where a batch that begins here leads to outside of the piece
        for i in range(n - 1, -1, -1):
            out[i], count[i] = out[ends[i]], count[ends[i]] + 1
        m = min(most, n)
        return pd.DataFrame({"piece": k, "entry": np.arange(m), "leave": out[:m] - n, "batches": count[:m]})

    ways = {(r["piece"], r["entry"]): (r["leave"], r["batches"]) for r in pieces.groupBy("piece").applyInPandas(passed, "piece long, entry int, leave int, batches long").collect()}
    starts, k, entry, batch = [], 0, 0, 0
    while (k, entry) in ways:
        starts.append((k, entry, batch))
        entry, more = ways[k, entry]
        k, batch = k + 1, batch + more
    known = spark.createDataFrame(starts, "piece long, entry int, batch long")

    def told(pdf: pd.DataFrame) -> pd.DataFrame:
        k, n, ends = steps(pdf)
        entry, batch = int(pdf["entry"].iloc[0]), int(pdf["batch"].iloc[0])
        begins = []
        while entry < n:
            begins.append(entry)
            entry = int(ends[entry])
        return pd.DataFrame({"begin": k * piece + np.array(begins, dtype=np.int64), "batch": batch + np.arange(len(begins))})

    named = tables.write(pieces.join(F.broadcast(known), "piece").groupBy("piece").applyInPandas(told, "begin long, batch long"))
    # a place is of the last batch that begins at it or before it, fewer than ``most`` places away
    reach = named.select("batch", F.col("begin"), F.explode(F.sequence(F.col("begin"), F.col("begin") + most - 1)).alias("at"))
    of = at.hint("merge").join(reach.groupBy("at").agg(F.max("batch").alias("batch")), "at").select("_c", "batch")
    return labelled.hint("merge").join(of, F.col(component).eqNullSafe(F.col("_c"))).drop("_c")


def duplicate_files(files: DataFrame, path: str, digest: str) -> DataFrame:
    """digest, paths (sorted), copies: files of equal content."""
    return files.groupBy(digest).agg(F.sort_array(F.collect_list(path)).alias("paths"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
