"""Vectors: validation, exact retrieval, neighbours, outliers, projection, clusters and their summaries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.clustering import BisectingKMeans, KMeans
from pyspark.ml.feature import PCA, Normalizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.scalars import cosine_distance, euclidean_distance, finite, norm
from tessera.operators import metric as metric_space
from tessera.session import Tables

MAX_DIM = 4096


def problems(vectors: DataFrame, *, dim: int, unit: bool = False, nonzero: bool = True, tolerance: float = 1e-5) -> DataFrame:
    """id, problem: repeated ids, and vectors of another length, with non-finite or missing numbers, zero, or not of unit norm."""
    n = norm(F.col("vector"))
    one = F.when(F.col("vector").isNull(), "missing").when(F.size("vector") != min(dim, MAX_DIM), "length").when(~finite(F.col("vector")), "not finite")
    if nonzero:
        one = one.when(n == 0, "zero")
    if unit:
        one = one.when(F.abs(n - 1) > tolerance, "norm")
    bad = vectors.select("id", one.alias("problem")).where("problem is not null")
    twice = vectors.groupBy("id").count().where("count > 1").select("id", F.lit("repeated").alias("problem"))
    return bad.unionByName(twice)


def fitted(selection: DataFrame, vectors: DataFrame, *, space: str, run: str, most: int = 2_000_000) -> tuple[DataFrame, DataFrame]:
    """(ord, id, vector of the selected records that have one, in the selection's order; ord, id of those that haven't). Vectors need the names of their space and run, one length and finite numbers; a selection without any, or with over ``most``, is refused."""
    if not space or not run:
        raise ValueError("vectors need the names of their space and of the run that made them")
    own = vectors.select(F.col("id").alias("_id"), "vector")
    both = selection.select("ord", "id").join(own, F.col("id") == F.col("_id"), "left")
    good = F.coalesce(finite(F.col("vector")), F.lit(False))
    got = both.agg(F.count("_id").alias("n"), F.min(F.size("vector")).alias("lo"), F.max(F.size("vector")).alias("hi"), F.count_if(F.col("_id").isNotNull() & ~good).alias("odd")).first()
    if not got["n"]:
        raise ValueError("no selected record has a vector")
    if got["n"] > most or got["odd"] or got["lo"] != got["hi"] or not 1 <= got["lo"] <= MAX_DIM:
        raise ValueError("the vectors are too many, not finite, or not of one length")
    return both.where("_id is not null").select("ord", "id", "vector").orderBy("ord"), both.where("_id is null").select("ord", "id")


def similar(vectors: DataFrame, query: list[float] | None = None, record: object = None, *, k: int = 10, metric: str = "cosine", eligible: DataFrame | None = None) -> DataFrame:
    """id, distance of the k nearest to a vector or a record, which isn't in its own result; eligible ids are settled before the ranking.

    Each task keeps k rows; the query is one literal."""
    if (query is None) == (record is None):
        raise ValueError("give a vector or a record")
    if query is None:
        row = vectors.where(F.col("id") == F.lit(record)).select("vector").head()
        if row is None or row[0] is None:
            raise ValueError(f"no vector for {record}")
        query = list(row[0])
    if not all(np.isfinite(query)):
        raise ValueError("the query isn't finite")
    rows = vectors.where(F.col("id") != F.lit(record)) if record is not None else vectors
    if eligible is not None:
        rows = rows.join(eligible.select("id").distinct(), "id", "left_semi")
    distance = {"cosine": cosine_distance, "euclidean": euclidean_distance}[metric]
    return rows.select("id", distance(F.col("vector"), F.array(*[F.lit(float(x)) for x in query])).alias("distance")).orderBy("distance", "id").limit(k)


def neighbours(vectors: DataFrame, k: int, *, metric: str = "euclidean") -> DataFrame:
    """id, rank, neighbour, distance: the k nearest other rows of each row, exactly; ties go to the smaller id. Null vectors take no part.

    Equal vectors are compared once. Of the blocks of a metric partition only those are compared that can hold a row's nearest."""
    tables = Tables(vectors.sparkSession, "neighbours")
    rows = vectors.select("id", F.col("vector").cast("array<double>").alias("v")).where("v is not null")
    rows = tables.write(rows)
    classes = tables.write(rows.groupBy("v").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n")))
    near = metric_space.nearest(metric_space.partition(classes.select("id", "v"), tables, unit=metric == "cosine"), k, tables)
    order = Window.partitionBy("id").orderBy("distance", "neighbour")
    nth = F.row_number().over(order)
    if classes.where("n > 1").head(1):
        # of a class as many members count as can be among the nearest; a row takes its class's list without itself
        named = rows.join(classes.select(F.col("v").alias("_v"), F.col("id").alias("class")), F.col("v") == F.col("_v")).select("id", "class")
        members = named.withColumn("nth", F.row_number().over(Window.partitionBy("class").orderBy("id"))).where(F.col("nth") <= k + 1)
        lists = near.select("id", F.col("neighbour").alias("class"), "distance").unionByName(classes.select("id", F.col("id").alias("class"), F.lit(0.0).alias("distance")))
        lists = lists.join(members.select("class", F.col("id").alias("neighbour")), "class").withColumn("rank", nth).where(F.col("rank") <= k + 1)
        near = named.join(lists.select(F.col("id").alias("class"), "neighbour", "distance"), "class").where("id <> neighbour").select("id", "neighbour", "distance")
        near = near.withColumn("rank", nth).where(F.col("rank") <= k)
    distance = F.col("distance") * F.col("distance") / 2 if metric == "cosine" else F.col("distance")
    return near.select("id", "rank", "neighbour", distance.alias("distance"))


def outlier_scores(vectors: DataFrame, k: int = 5, *, metric: str = "euclidean") -> DataFrame:
    """id, outlier_score: the distance to the k-th nearest other row."""
    return neighbours(vectors, k, metric=metric).where(F.col("rank") == k).select("id", F.col("distance").alias("outlier_score"))


def project(vectors: DataFrame, components: int = 2) -> tuple[DataFrame, list[float]]:
    """(id, coords), and the explained shares of variance. Coordinates are centred; the largest one of each component is positive."""
    rows = vectors.select("id", array_to_vector(F.col("vector").cast("array<double>")).alias("v"))
    model = PCA(k=components, inputCol="v", outputCol="p").fit(rows)
    raw = model.transform(rows).select("id", vector_to_array("p").alias("p"))
    means = raw.agg(*[F.avg(F.col("p")[i]) for i in range(components)]).first()
    shifted = raw.select("id", *[(F.col("p")[i] - F.lit(means[i])).alias(f"c{i}") for i in range(components)])
    ends = shifted.agg(*[F.max_by(f"c{i}", F.struct(F.abs(F.col(f"c{i}")), F.col("id"))) for i in range(components)]).first()
    signs = [-1.0 if e is not None and e < 0 else 1.0 for e in ends]
    return shifted.select("id", F.array(*[F.col(f"c{i}") * s for i, s in enumerate(signs)]).alias("coords")), list(map(float, model.explainedVariance))


def k_means(vectors: DataFrame, clusters: int, *, metric: str = "euclidean", seed: int = 0, iterations: int = 100) -> DataFrame:
    """id, cluster, vector (of unit norm for cosine)."""
    rows = vectors.select("id", array_to_vector(F.col("vector").cast("array<double>")).alias("raw"))
    rows = Normalizer(inputCol="raw", outputCol="v").transform(rows) if metric == "cosine" else rows.withColumnRenamed("raw", "v")
    model = KMeans(k=clusters, featuresCol="v", predictionCol="cluster", seed=seed, maxIter=iterations, tol=1e-6).fit(rows)
    return model.transform(rows).select("id", "cluster", vector_to_array("v").alias("vector"))


def bisecting_clusters(vectors: DataFrame, clusters: int, *, seed: int = 0) -> DataFrame:
    """id, cluster by top-down splits: the hierarchical clustering that scales; not the same as merging bottom-up."""
    rows = vectors.select("id", array_to_vector(F.col("vector").cast("array<double>")).alias("v"))
    return BisectingKMeans(k=clusters, featuresCol="v", predictionCol="cluster", seed=seed).fit(rows).transform(rows).select("id", "cluster")


def merge_clusters(labelled: DataFrame, clusters: int, linkage: str = "average") -> DataFrame:
    """id, cluster: small clusters (from ``k_means`` with many of them, at most 2,000) merged bottom-up by their centroids until ``clusters`` are left.

    Only centroids and sizes reach the driver."""
    stats = labelled.select("cluster", F.posexplode("vector").alias("i", "x")).groupBy("cluster", "i").agg(F.avg("x").alias("x"), F.count(F.lit(1)).alias("n"))
    found = stats.groupBy("cluster").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("c"), F.max("n").alias("n")).orderBy("cluster").limit(2001).collect()
    if len(found) > 2000:
        raise ValueError("at most 2,000 clusters to merge")
    of = _merged(np.array([r["c"] for r in found]).reshape(len(found), -1), np.array([r["n"] for r in found], dtype=float), clusters, linkage)
    names = labelled.sparkSession.createDataFrame([(r["cluster"], int(c)) for r, c in zip(found, of, strict=True)], "_c int, _to int")  # at most 2,000 rows
    return labelled.join(F.broadcast(names), F.col("cluster") == F.col("_c")).select("id", F.col("_to").alias("cluster"))


def _merged(centres: np.ndarray, sizes: np.ndarray, clusters: int, linkage: str) -> np.ndarray:
    """The merged cluster of each small one, numbered by its first. Their matrix is that of at most 2,000 centroids."""
    from tessera.operators.trees import Tree, _finish

    n = len(centres)
    square = np.maximum((centres**2).sum(1)[:, None] + (centres**2).sum(1) - 2 * centres @ centres.T, 0)
    gap = square * sizes[:, None] * sizes / (sizes[:, None] + sizes) if linkage == "ward" else np.sqrt(square)
    tree = Tree(n)
    if linkage == "ward":
        tree.sizes = sizes.copy()
    _finish(np.minimum(gap, gap.T), tree, linkage)
    return tree.cut(n, clusters)


def cluster_summaries(labelled: DataFrame, exemplars: int = 5, *, metric: str = "euclidean") -> DataFrame:
    """cluster, size, mean_distance, exemplars (ids nearest to the centroid), centre. Noise (-1) is a row of its size alone.

    For cosine, vectors and centroids are of unit norm, and distances are euclidean between them; a centroid of norm zero stays as it is."""
    unit = lambda c: F.when(norm(c) > 0, F.transform(c, lambda x: x / norm(c))).otherwise(c)
    noise = labelled.where("cluster < 0").agg(F.count(F.lit(1)).alias("size")).where("size > 0")
    rows = labelled.where("cluster >= 0").withColumn("vector", F.col("vector").cast("array<double>"))
    rows = rows.withColumn("vector", unit(F.col("vector"))) if metric == "cosine" else rows
    parts = rows.select("cluster", F.posexplode("vector").alias("i", "x")).groupBy("cluster", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    centres = parts.groupBy("cluster").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("centre")).withColumnRenamed("cluster", "_c")
    centres = centres.withColumn("centre", unit(F.col("centre"))) if metric == "cosine" else centres
    gap = rows.join(centres, F.col("cluster") == F.col("_c")).select("cluster", "id", euclidean_distance(F.col("vector"), F.col("centre")).alias("gap"))
    nth = F.row_number().over(Window.partitionBy("cluster").orderBy("gap", "id"))
    near = gap.withColumn("nth", nth).where(F.col("nth") <= exemplars).groupBy("cluster").agg(F.transform(F.sort_array(F.collect_list(F.struct("nth", "id"))), lambda s: s["id"]).alias("exemplars"))
    out = gap.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"), F.avg("gap").alias("mean_distance")).join(near, "cluster").join(centres.withColumnRenamed("_c", "cluster"), "cluster")
    return out.unionByName(noise.withColumn("cluster", F.lit(-1)), allowMissingColumns=True)


def silhouette(labelled: DataFrame, *, most: int = 4000, seed: int = 0) -> float | None:
    """The mean silhouette (euclidean) of a seeded sample of at most ``most`` rows without noise; None under two clusters."""
    from tessera.operators.sampling import sha_rank

    some = labelled.where("cluster >= 0").orderBy(sha_rank(seed, F.col("id")), "id").limit(most).select("id", "cluster", F.col("vector").alias("v"))
    sizes = {r[0]: r[1] for r in some.groupBy("cluster").count().collect()}
    if len(sizes) < 2:
        return None
    pdf = some.toPandas()  # the sample is bounded
    shared = labelled.sparkSession.sparkContext.broadcast((pdf["id"].to_numpy(), pdf["cluster"].to_numpy(), np.stack(pdf["v"].to_numpy())))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        _, labels, all_v = shared.value
        names = np.unique(labels)
        for b in batches:
            v = np.stack(b["v"].to_numpy())
            d = np.sqrt(np.maximum((v**2).sum(1)[:, None] + (all_v**2).sum(1) - 2 * v @ all_v.T, 0))
            sums = np.stack([d[:, labels == n].sum(1) for n in names], axis=1)
            count = np.array([(labels == n).sum() for n in names])
            own = np.searchsorted(names, b["cluster"].to_numpy())
            row = np.arange(len(b))
            inner = sums[row, own] / np.maximum(count[own] - 1, 1)
            other = sums / count
            other[row, own] = np.inf
            outer = other.min(axis=1)
            yield pd.DataFrame({"s": np.where(count[own] > 1, (outer - inner) / np.maximum(np.maximum(inner, outer), 1e-300), 0.0)})

    return some.mapInPandas(score, "s double").agg(F.avg("s")).first()[0]


def _forest(near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, columns) of links of a spanning forest of those that ``near`` has between its rows and columns."""
    x, y = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    row_left, column_left = near.any(axis=1), near.any(axis=0)
    while row_left.any():
        todo = [(True, int(row_left.argmax()))]
        row_left[todo[0][1]] = False
        while todo:
            is_row, at = todo.pop()
            left = column_left if is_row else row_left
            new = np.flatnonzero((near[at] if is_row else near[:, at]) & left)
            left[new] = False
            same = np.full(len(new), at)
            x.append(same if is_row else new)
            y.append(new if is_row else same)
            todo += [(not is_row, int(n)) for n in new]
    return np.concatenate(x), np.concatenate(y)


def _least_reached(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest of 0 to n - 1 that the links a-b lead to, for each."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while not np.array_equal(new, hop := new[new]):
            new = hop
        if np.array_equal(new, label):
            return label
        label = new


def density_clusters(vectors: DataFrame, min_points: int, radius: float, *, metric: str = "euclidean") -> DataFrame:
    """id, cluster (-1: noise): connected core points, at one level of the density hierarchy (``density.hierarchy`` has all of them).

    A core point has ``min_points`` rows (itself included) within the radius. Core points within it of each other are one cluster;
    other points take the cluster of their nearest core point in reach. Equal vectors are one point of their number. A point that has as many
    rows in reach in its own block is a core point; those of the others are counted in all blocks that can hold some. Core points of a block are linked, then those of successive blocks; the greatest cluster so far is never compared
    with itself: each link that is left has an end outside of it. So the work beyond the blocks grows with the points that are neither crowded nor in the greatest cluster."""
    from tessera.operators.sets import asset_components

    tables = Tables(vectors.sparkSession, "density")
    rows = tables.write(vectors.select("id", F.col("vector").cast("array<double>").alias("v")))
    points = rows.where("v is not null").groupBy("v").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"))
    within = np.sqrt(2 * radius) if metric == "cosine" else radius
    part = metric_space.partition(points.select("id", "v", "n"), tables, unit=metric == "cosine")
    points, kind = part.rows, dict(part.rows.dtypes)["id"]
    reach_of = np.full(part.blocks, within)
    pairs = tables.write(part.pairs(reach_of))

    def reach(a: pd.DataFrame, b: pd.DataFrame) -> np.ndarray:
        distance = metric_space.products(metric_space.stacked(a["v"]), metric_space.vectors_of(b))
        distance[a["id"].to_numpy()[:, None] == b["id"].to_numpy()[None, :]] = 0
        return distance

    def strips(pdf: pd.DataFrame) -> list[pd.DataFrame]:
        pdf.attrs["stacked"] = metric_space.stacked(pdf["v"])
        return [pdf.iloc[at : at + metric_space.STRIP].reset_index(drop=True) for at in range(0, len(pdf), metric_space.STRIP)]

    def counted(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"id": a["id"], "n": (reach(a, b) <= within) @ b["n"].to_numpy()})

    def counted_at_home(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.concat([counted(a, pdf) for a in strips(pdf)])

    def linked_at_home(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id").reset_index(drop=True)
        at, ends = 0, []
        for a in strips(pdf):
            x, y = _forest(reach(a, pdf) <= within)
            ends.append((x + at, y))
            at += len(a)
        i, j = (np.concatenate([e[side] for e in ends]) for side in (0, 1))
        return pdf.assign(comp=pdf["id"].to_numpy()[_least_reached(len(pdf), i, j)])[["id", "block", "v", "comp"]]

    def linked(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        """Links between the clusters so far: a spanning forest."""
        mine, i = np.unique(a["comp"].to_numpy(), return_inverse=True)
        theirs, j = np.unique(b["comp"].to_numpy(), return_inverse=True)
        row, column = np.nonzero(reach(a, b) <= within)
        met = np.zeros((len(mine), len(theirs)), dtype=bool)
        met[i[row], j[column]] = True
        met &= mine[:, None] != theirs[None, :]
        x, y = _forest(met)
        return pd.DataFrame({"comp": mine[x], "other": theirs[y]})

    def united(core: DataFrame, links: DataFrame) -> DataFrame:
        """``core`` with the smallest of the clusters that links lead to."""
        links = tables.write(links.where("comp <> other").select(F.least("comp", "other").alias("comp"), F.greatest("comp", "other").alias("other")).distinct())
        if not links.head(1):
            return core
        pair = F.concat_ws("~", F.col("comp").cast("string"), F.col("other").cast("string")).alias("pair")
        of = asset_components(links.select("comp", pair).unionByName(links.select(F.col("other").alias("comp"), pair)), "comp", "pair").withColumnRenamed("component", "_least")
        return tables.write(core.join(of, "comp", "left").withColumn("comp", F.coalesce("_least", "comp")).drop("_least"))

    def nearest(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        distance, ids = reach(a, b), b["id"].to_numpy()
        order = np.argsort(ids, kind="stable")  # the first of equal distances has the smallest id
        at = order[distance[:, order].argmin(axis=1)]
        out = pd.DataFrame({"id": a["id"], "neighbour": ids[at], "distance": distance[np.arange(len(a)), at]})
        return out[out["distance"] <= within]

    home = points.groupBy("block").applyInPandas(counted_at_home, f"id {kind}, n long").where(F.col("n") >= min_points).select("id")
    dense = tables.write(home)
    asks = tables.write(points.join(dense, "id", "left_anti"))
    if part.blocks > 1 and asks.head(1):
        dense = tables.write(dense.unionByName(part.compared(asks, points, pairs, counted, f"id {kind}, n long", few=True).groupBy("id").agg(F.sum("n").alias("n")).where(F.col("n") >= min_points).select("id")))
    edge = tables.write(asks.join(dense, "id", "left_anti"))
    core = tables.write(points.join(dense, "id", "left_semi").select("id", "v", "block").groupBy("block").applyInPandas(linked_at_home, f"id {kind}, block long, v array<double>, comp {kind}"))
    if part.blocks > 1:
        core = united(core, part.compared(core, core, pairs.where("j = i + 1"), linked, f"comp {kind}, other {kind}"))
        greatest = core.groupBy("comp").count().orderBy(F.desc("count"), "comp").first()
        rest = tables.write(core.where(F.col("comp") != greatest["comp"])) if greatest else core
        if rest.head(1):
            core = united(core, part.compared(rest, core, pairs, linked, f"comp {kind}, other {kind}", few=True))
    of_core = core.select("id", F.col("comp").alias("cluster"))
    near = part.compared(edge, core, pairs, nearest, f"id {kind}, neighbour {kind}, distance double", few=True).groupBy("id").agg(F.min_by("neighbour", F.struct("distance", "neighbour")).alias("neighbour"))
    near = near.join(of_core.withColumnRenamed("id", "neighbour"), "neighbour").select("id", F.col("cluster").alias("near_cluster"))
    named = rows.where("v is not null").groupBy("v").agg(F.min("id").alias("id")).withColumnRenamed("id", "class")
    found = named.join(of_core.withColumnRenamed("id", "class"), "class", "left").join(near.withColumnRenamed("id", "class"), "class", "left").select(F.col("v").alias("_v"), F.coalesce("cluster", "near_cluster").alias("cluster"))
    return rows.join(found, F.col("v") == F.col("_v"), "left").select("id", F.coalesce("cluster", F.lit(-1)).alias("cluster"))
