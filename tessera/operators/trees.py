"""Clusters merged bottom-up: the whole tree of up to ``exact_limit`` rows, in rounds that merge all clusters that are each other's nearest.

The distances of a cluster to all others are one row of a table, so that a round is a shuffle of rows and no task or driver holds the matrix; rows and columns of merged clusters are
joined by the update of their linkage (of Lance and Williams). Ward, average, complete and single linkage are reducible: two clusters that are each other's nearest stay so whatever else
is merged, so the rounds make the tree that merging the nearest two one after the other makes, and cutting it after its lowest merges gives the same clusters. The driver holds one nearest
cluster for each cluster (``exact_limit`` at most); once ``SMALL`` clusters are left, their matrix goes there for the last rounds.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.operators import metric as metric_space
from tessera.operators.vectors import k_means, merge_clusters
from tessera.session import Tables

CHUNK, SMALL, LINKAGES = 1024, 2000, ("ward", "average", "complete", "single")
BATCH_BYTES, BATCH = 16 << 20, "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def small_batches(spark: SparkSession, numbers: int) -> Iterator[None]:
    """Rows of so many numbers go to Python tasks in batches of about ``BATCH_BYTES``."""
    before = spark.conf.get(BATCH)
    spark.conf.set(BATCH, str(max(BATCH_BYTES // (8 * max(numbers, 1)), 1)))
    try:
        yield
    finally:
        spark.conf.set(BATCH, before)


def joined(linkage: str, x: np.ndarray, y: np.ndarray, gap: np.ndarray | float, nx: np.ndarray | float, ny: np.ndarray | float, w: np.ndarray | float) -> np.ndarray:
    """Distances from the union of two clusters, given those from each (x, y), their own (gap), their sizes and those of the others (w)."""
    if linkage == "ward":
        return ((w + nx) * x + (w + ny) * y - w * gap) / (w + nx + ny)
    if linkage == "average":
        return (nx * x + ny * y) / (nx + ny)
    return np.maximum(x, y) if linkage == "complete" else np.minimum(x, y)


def pairs_of(nearest: np.ndarray, gap: np.ndarray) -> np.ndarray:
    """The clusters (a, b) that are each other's nearest, a < b; the closest two where rounding leaves none."""
    at = np.arange(len(nearest))
    a = at[(nearest[nearest] == at) & (at < nearest)]
    if not len(a):
        i = int(gap.argmin())
        return np.array([sorted((i, int(nearest[i])))])
    return np.stack([a, nearest[a]], axis=1)


def columns_joined(linkage: str, rows: np.ndarray, row_sizes: np.ndarray, sizes: np.ndarray, pairs: np.ndarray, gap: np.ndarray) -> np.ndarray:
    """Rows of distances, with the columns of each pair as one, in the place of its first."""
    a, b = pairs.T
    rows = rows.copy()
    rows[:, a] = joined(linkage, rows[:, a], rows[:, b], gap[a], sizes[a], sizes[b], row_sizes[:, None])
    return np.delete(rows, b, axis=1)


class Tree:
    """What the driver knows: the clusters so far by their first row, their sizes and heights, and all merges."""

    def __init__(self, n: int):
        self.first, self.sizes, self.height, self.merges = np.arange(n), np.ones(n), np.zeros(n), []

    def merge(self, pairs: np.ndarray, gap: np.ndarray) -> None:
        a, b = pairs.T
        height = np.maximum(gap[a], np.maximum(self.height[a], self.height[b]))
        self.merges += zip(height.tolist(), self.first[a].tolist(), self.first[b].tolist(), strict=True)
        self.first[a] = np.minimum(self.first[a], self.first[b])
        self.sizes[a] += self.sizes[b]
        self.height[a] = height
        self.first, self.sizes, self.height = (np.delete(x, b) for x in (self.first, self.sizes, self.height))

    def cut(self, n: int, clusters: int) -> np.ndarray:
        """The cluster of each row after the lowest n - clusters merges, numbered by their first rows."""
        parent = np.arange(n)

        def find(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for _, a, b in sorted(self.merges, key=lambda m: m[0])[: n - clusters]:  # equal heights stay in the order of the rounds
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
        return np.unique([find(i) for i in range(n)], return_inverse=True)[1]


def _matrix(rows: DataFrame, linkage: str, tables: Tables) -> DataFrame:
    """at, gaps: each row's distances to all rows, from blocks of CHUNK rows on either side."""
    chunks = rows.withColumn("c", F.floor(F.col("at") / CHUNK))
    last = chunks.agg(F.max("c")).first()[0]
    others = lambda low, high: F.explode(F.sequence(low, high))
    left, right = chunks.select("at", "v", F.col("c").alias("i"), others(F.col("c"), F.lit(last)).alias("j")), chunks.select("at", "v", F.col("c").alias("j"), others(F.lit(0).cast("long"), F.col("c")).alias("i"))
    left, right = left.toDF(*left.columns), right.toDF(*right.columns)

    def compare(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        a, b = a.sort_values("at"), b.sort_values("at")
        gap = metric_space.products(metric_space.stacked(a["v"]), metric_space.stacked(b["v"]))
        gap = gap**2 / 2 if linkage == "ward" else gap
        gap[a["at"].to_numpy()[:, None] == b["at"].to_numpy()[None, :]] = np.inf
        i, j = int(a["i"].iloc[0]), int(a["j"].iloc[0])
        if i == j:
            gap = np.minimum(gap, gap.T)
        out = [pd.DataFrame({"at": a["at"], "chunk": j, "gaps": list(gap)})]
        if i != j:
            out.append(pd.DataFrame({"at": b["at"], "chunk": i, "gaps": list(gap.T.copy())}))
        return pd.concat(out)

    pieces = left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInPandas(compare, "at long, chunk long, gaps array<double>")
    whole = F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("chunk", "gaps"))), lambda x: x["gaps"]))
    return tables.write(pieces.groupBy("at").agg(whole.alias("gaps")))


def _nearest(matrix: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    def least(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            gaps = [np.asarray(g) for g in pdf["gaps"]]
            yield pd.DataFrame({"at": pdf["at"], "near": [int(g.argmin()) for g in gaps], "gap": [float(g.min()) for g in gaps]})

    found = matrix.mapInPandas(least, "at long, near long, gap double").toPandas().sort_values("at")
    return found["near"].to_numpy(), found["gap"].to_numpy()


def _round(matrix: DataFrame, tree: Tree, linkage: str, pairs: np.ndarray, gap: np.ndarray) -> DataFrame:
    """The matrix after the merges of ``pairs``."""
    sizes = tree.sizes.copy()
    new = np.ones(len(sizes), dtype=np.int64)
    new[pairs[:, 1]] = 0
    new = np.cumsum(new) - 1
    new[pairs[:, 1]] = new[pairs[:, 0]]

    def named(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            yield pdf.assign(new=new[pdf["at"].to_numpy()])

    def contract(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("at")
        at, rows = pdf["at"].to_numpy(), metric_space.stacked(pdf["gaps"])
        row, size = rows[0], sizes[at].sum()
        if len(at) == 2:
            row = joined(linkage, rows[0], rows[1], gap[at[0]], sizes[at[0]], sizes[at[1]], sizes)
            row[at] = np.inf
        row = columns_joined(linkage, row[None, :], np.array([size]), sizes, pairs, gap)
        row[0, pdf["new"].iloc[0]] = np.inf
        return pd.DataFrame({"at": pdf["new"].iloc[:1], "gaps": list(row)})

    return matrix.mapInPandas(named, "at long, gaps array<double>, new long").groupBy("new").applyInPandas(contract, "at long, gaps array<double>")


def _finish(matrix: np.ndarray, tree: Tree, linkage: str) -> None:
    """The last rounds, over a matrix of SMALL clusters at most."""
    np.fill_diagonal(matrix, np.inf)
    while len(matrix) > 1:
        near, gap = matrix.argmin(axis=1), matrix.min(axis=1)
        pairs, sizes = pairs_of(near, gap), tree.sizes.copy()
        a, b = pairs.T
        matrix[a] = joined(linkage, matrix[a], matrix[b], gap[a][:, None], sizes[a][:, None], sizes[b][:, None], sizes[None, :])
        matrix[a, a] = matrix[a, b] = np.inf
        tree.merge(pairs, gap)
        matrix = columns_joined(linkage, np.delete(matrix, b, axis=0), tree.sizes, sizes, pairs, gap)
        np.fill_diagonal(matrix, np.inf)


def hierarchical_clusters(vectors: DataFrame, clusters: int, *, linkage: str = "ward", exact_limit: int = 20_000, micro_clusters: int = 2000, seed: int = 0) -> DataFrame:
    """id, cluster (numbered by their smallest ids), two_stage: the rows merged into ``clusters`` by euclidean distances.

    Over ``exact_limit`` rows the rows come in micro-clusters by k-means first, and ``two_stage`` says so. Null vectors take no part."""
    if linkage not in LINKAGES:
        raise ValueError(f"unknown linkage {linkage}; there are {LINKAGES}")
    tables = Tables(vectors.sparkSession, "trees")
    rows = tables.write(vectors.select("id", F.col("vector").cast("array<double>").alias("v")).where("v is not null"))
    n = rows.count()
    if not 1 <= clusters <= n:
        raise ValueError("clusters must be within 1 and the number of rows")
    if n > exact_limit:
        micro = k_means(rows.withColumnRenamed("v", "vector"), min(max(micro_clusters, clusters), n), seed=seed)
        return merge_clusters(micro, clusters, linkage).withColumn("two_stage", F.lit(True))
    placed = tables.write(rows.select("id", "v", (F.row_number().over(Window.orderBy("id")) - 1).cast("long").alias("at")))  # of exact_limit rows at most
    with small_batches(rows.sparkSession, n):
        tree, matrix = Tree(n), _matrix(placed, linkage, tables)
        while len(tree.sizes) > max(SMALL, 1):
            near, gap = _nearest(matrix)
            pairs = pairs_of(near, gap)
            after = tables.write(_round(matrix, tree, linkage, pairs, gap))
            tree.merge(pairs, gap)
            tables.drop(matrix)
            matrix = after
        _finish(np.stack([np.asarray(r["gaps"]) for r in sorted(matrix.collect())]), tree, linkage)
    of = tree.cut(n, clusters)
    names = rows.sparkSession.createDataFrame(pd.DataFrame({"at": np.arange(n), "cluster": of}), "at long, cluster int")
    return placed.join(names, "at").select("id", "cluster", F.lit(False).alias("two_stage"))
