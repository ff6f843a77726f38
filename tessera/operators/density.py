"""Density clusters of all levels: the hierarchy of mutual reachability, condensed, and its most stable clusters.

1. A point's core distance reaches ``min_samples`` rows, itself included. Two points are as far apart as the greatest of their distance and their core distances.
2. The minimum spanning tree of these distances grows in Boruvka rounds: each component takes its least edge to another one, in the order of
   (distance, smaller point, greater point), so that no circle can close. A point's list of near points gives its least edge whenever that is shorter than anything outside the list can
   be; the others look for it in the blocks of the metric partition that can have a shorter one than their component has found.
3. The tree's edges are taken from the shortest on, in bands of about ``BAND`` edges that one task each merges; between bands points take on their component's name. Edges of one
   length go at once, so that the result doesn't depend on their order. A component is a cluster from ``min_cluster_size`` rows on; a point leaves its cluster, seen from the top, at the
   length at which it joined it. Stabilities add up on the way.
4. A cluster is chosen if it is at least as stable as the chosen ones within it together; the whole is never one. A point's probability is the share of its density (one over
   the length) in the greatest of its cluster.

Equal vectors are one point of their number. Null vectors are noise.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.operators import metric as metric_space
from tessera.session import Tables

BAND, MORE = 100_000, 8


def _reaches(part: metric_space.Partition, min_samples: int, tables: Tables) -> tuple[DataFrame, DataFrame]:
    """(points with ``core`` and ``last``, how near what isn't in their list can be; lists of near points)."""
    k = min_samples - 1 + MORE
    near = metric_space.nearest(part, k, tables)
    sizes = part.rows.select(F.col("id").alias("neighbour"), "n")
    lists = tables.write(near.join(sizes, "neighbour").select("id", "rank", "neighbour", "distance", "n"))
    upto = F.sum("n").over(Window.partitionBy("id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    own = part.rows.select("id", F.col("n").alias("own"))
    found = lists.withColumn("upto", upto).join(own, "id").where(F.col("upto") + F.col("own") >= min_samples).groupBy("id").agg(F.min("distance").alias("core"))
    ends = lists.groupBy("id").agg(F.max("rank").alias("ranks"), F.max("distance").alias("end"))
    points = part.rows.join(found, "id", "left").join(ends, "id", "left")
    core = F.when(F.col("n") >= min_samples, 0.0).otherwise(F.coalesce("core", F.lit(float("inf"))))
    last = F.when(F.col("ranks") >= k, F.greatest(core, "end")).otherwise(float("inf"))
    return tables.write(points.select("id", "v", "n", "block", core.alias("core"), last.alias("last"))), lists


def _edges(points: DataFrame, lists: DataFrame, tables: Tables) -> DataFrame:
    """lo, hi, w: the distances of listed pairs."""
    cores = points.select("id", "core")
    both = lists.join(cores, "id").join(cores.select(F.col("id").alias("neighbour"), F.col("core").alias("other")), "neighbour")
    return tables.write(both.select("id", "neighbour", F.greatest("distance", "core", "other").alias("w"), F.least("id", "neighbour").alias("lo"), F.greatest("id", "neighbour").alias("hi")))


def _searched(part: metric_space.Partition, points: DataFrame, labels: DataFrame, asks: DataFrame, tables: Tables) -> DataFrame:
    """comp, w, lo, hi, other: least edges of points (id, comp, bound), among all that are no longer than the bound."""
    here = points.join(labels, "id").select("id", "v", "core", "block", "comp")
    left = tables.write(asks.select("id", "bound").join(here, "id").where("bound >= core"))
    reach = np.full(part.blocks, -np.inf)
    for r in left.groupBy("block").agg(F.max("bound").alias("b")).collect():
        reach[r["block"]] = r["b"]

    def compare(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        x, y = metric_space.stacked(a["v"]), metric_space.vectors_of(b)
        ids, others, cores, theirs = a["id"].to_numpy(), b["id"].to_numpy(), a["core"].to_numpy(), b["core"].to_numpy()
        gap = np.maximum(np.maximum(metric_space.products(x, y), cores[:, None]), theirs[None, :])
        comp, to = a["comp"].to_numpy(), b["comp"].to_numpy()
        gap[comp[:, None] == to[None, :]] = np.inf
        least = np.minimum(a["bound"].to_numpy(), gap.min(axis=1)) + metric_space.slack(x, y)
        row, column = np.nonzero((gap <= least[:, None]) & np.isfinite(gap))
        w = np.maximum(np.maximum(metric_space.apart(x[row], y[column]), cores[row]), theirs[column])
        out = pd.DataFrame({"comp": comp[row], "w": w, "lo": np.minimum(ids[row], others[column]), "hi": np.maximum(ids[row], others[column]), "other": to[column]})
        return out.sort_values(["comp", "w", "lo", "hi"]).drop_duplicates("comp")

    return part.compared(left, here, part.pairs(reach), compare, "comp long, w double, lo long, hi long, other long")


def _roots(parents: DataFrame, tables: Tables) -> DataFrame:
    """comp, root: where the pointers (comp, other) of a forest lead to, whose roots are the smaller ones of two that point at each other."""
    back = parents.select(F.col("comp").alias("other"), F.col("other").alias("back"))
    at = tables.write(parents.join(back, "other", "left").select("comp", F.when((F.col("back") == F.col("comp")) & (F.col("comp") < F.col("other")), F.col("comp")).otherwise(F.col("other")).alias("root")))
    while True:
        onward = at.select(F.col("comp").alias("root"), F.col("root").alias("next"))
        hop = tables.write(at.join(onward, "root").select("comp", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved")))
        tables.drop(at)
        at = hop
        if not at.where("moved").head(1):
            return at.drop("moved")


def spanning_tree(part: metric_space.Partition, min_samples: int, tables: Tables) -> tuple[DataFrame, DataFrame]:
    """(points: id, v, n, block, core, last; the tree: lo, hi, w) of the partition's rows (id: long, v, n)."""
    points, lists = _reaches(part, min_samples, tables)
    listed = _edges(points, lists, tables)
    tables.drop(lists)
    labels = tables.write(points.select("id", F.col("id").alias("comp")))
    tree = None
    while True:
        anchor = labels.join(points, "id").agg(F.min_by(F.struct("id", "v", "core", "comp"), "id").alias("a"), F.count_distinct("comp").alias("comps")).first()
        if anchor["comps"] < 2:
            break
        mine, theirs = labels.select("id", "comp"), labels.select(F.col("id").alias("neighbour"), F.col("comp").alias("other"))
        found = listed.join(mine, "id").join(theirs, "neighbour").where("comp <> other").groupBy("comp").agg(F.min(F.struct("w", "lo", "hi", "other")).alias("e")).select("comp", "e.*")
        found = tables.write(found)
        # who can have a shorter one outside of its list; a component without any looks as far as the tree's first point, or from there to the nearest component
        a = anchor["a"]
        gap = F.greatest(F.sqrt(F.aggregate(F.zip_with("v", F.array(*[F.lit(float(x)) for x in a["v"]]), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)) * (1 + 1e-9), F.col("core"), F.lit(a["core"]))
        some = labels.join(points, "id").where(F.col("comp") != a["comp"]).groupBy("comp").agg(F.min(gap).alias("far"))
        far = tables.write(some)
        least = far.agg(F.min("far")).first()[0]
        bounds = labels.join(found.select("comp", "w"), "comp", "left").join(far, "comp", "left").select("id", "comp", F.coalesce("w", "far", F.lit(least)).alias("bound"))
        asks = bounds.join(points.select("id", "last"), "id").where("last <= bound").select("id", "comp", "bound")
        asks = tables.write(asks)
        if asks.head(1):
            more = _searched(part, points, labels, asks, tables)
            found = tables.write(found.unionByName(more).groupBy("comp").agg(F.min(F.struct("w", "lo", "hi", "other")).alias("e")).select("comp", "e.*"))
        new = found.select("lo", "hi", "w").distinct()
        tree = tables.write(new if tree is None else tree.unionByName(new))
        roots = _roots(found.select("comp", "other"), tables)
        labels = tables.write(labels.join(roots, "comp", "left").select("id", F.coalesce("root", "comp").alias("comp")))
    return points, tree if tree is not None else tables.write(points.select(F.col("id").alias("lo"), F.col("id").alias("hi"), F.col("core").alias("w")).limit(0))


STATE = "size long, cluster long, fallen double, inner double, densest double"
STEP = f"kind string, root long, into long, density double, ok boolean, {STATE}"


def merged(edges: pd.DataFrame, states: pd.DataFrame, least: int, first: int) -> pd.DataFrame:
    """A band of edges (lo, hi: roots, w) merged into components (root and STATE); new clusters are numbered from ``first`` on.

    Rows of three kinds: `root`, a root that was, the one it is now, and that one's state; `leaf`, a root whose rows leave a cluster at a density; `cluster`, a cluster that ended in another one."""
    state = {r.root: [r.size, None if pd.isna(r.cluster) else int(r.cluster), r.fallen, r.inner, r.densest] for r in states.itertuples()}
    parent = {r: r for r in state}
    parts: dict[int, list[int]] = {r: [r] for r, s in state.items() if s[1] is None}  # roots that haven't joined a cluster
    out: list[tuple] = []

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    edges = edges.sort_values(["w", "lo", "hi"], kind="stable")
    lo, hi, w = edges["lo"].tolist(), edges["hi"].tolist(), edges["w"].tolist()
    at = 0
    while at < len(w):
        to = at
        groups: dict[int, set[int]] = {}  # root so far -> the components it is of now
        while to < len(w) and w[to] == w[at]:
            a, b = find(lo[to]), find(hi[to])
            one = groups.pop(a, {a})
            if a != b:
                one |= groups.pop(b, {b})
                parent[max(a, b)] = min(a, b)
            groups[min(a, b)] = one
            to += 1
        density = np.inf if w[at] == 0 else 1 / w[at]
        for root, members in groups.items():
            big = [m for m in members if state[m][1] is not None]
            small = [m for m in members if state[m][1] is None]
            size = sum(state[m][0] for m in members)
            loose = sum(state[m][0] for m in small)
            if size < least:
                new = [size, None, 0.0, 0.0, 0.0]
                parts[root] = [p for m in small for p in parts.pop(m)]
            else:
                if len(big) == 1:
                    _, cluster, fallen, inner, densest = state[big[0]]
                    new = [size, cluster, fallen + (density * loose if loose else 0.0), inner, densest]
                else:
                    cluster, first = first, first + 1
                    inner = 0.0
                    for m in big:
                        own = state[m][2] - density * state[m][0]
                        ok = not state[m][3] > own
                        inner += own if ok else state[m][3]
                        out.append(("cluster", state[m][1], cluster, state[m][4], ok, *[None] * 5))
                    new = [size, cluster, density * size, inner, density]
                out += [("leaf", p, cluster, density, None, *[None] * 5) for m in small for p in parts.pop(m)]
            for m in members:
                del state[m]
            state[root] = new
        at = to
    out += [("root", r, find(r), None, None, *state[find(r)]) for r in states["root"]]
    return pd.DataFrame(out, columns=[x.split()[0] for x in STEP.split(", ")])


def _condensed(points: DataFrame, tree: DataFrame, least: int, tables: Tables) -> tuple[DataFrame, DataFrame]:
    """(id, cluster, density: where each point left; cluster, parent, ok, densest)."""
    # the rows of one point become a component at its core distance
    alone = points.where(F.col("n") >= least).select(F.col("id").alias("lo"), F.col("id").alias("hi"), F.col("core").alias("w"))
    edges = tables.write(tree.unionByName(alone).where(F.col("w") < float("inf")))
    bands = max(-(-edges.count() // BAND), 1)
    cuts = sorted(set(edges.approxQuantile("w", [i / bands for i in range(1, bands)], 0.1 / bands))) if bands > 1 else []
    band = sum((F.when(F.col("w") > c, 1).otherwise(0) for c in cuts), F.lit(0))
    edges = edges.withColumn("band", band)
    nodes = tables.write(points.select("id", F.col("id").alias("root"), F.lit(None).cast("long").alias("cluster"), F.lit(None).cast("double").alias("density")))
    states = tables.write(points.select(F.col("id").alias("root"), F.col("n").alias("size"), F.lit(None).cast("long").alias("cluster"), *[F.lit(0.0).alias(c) for c in ("fallen", "inner", "densest")]))
    ended = None
    for b in range(len(cuts) + 1):
        name = lambda c: nodes.select(F.col("id").alias(c), F.col("root").alias(f"{c}_root"))  # noqa: E731, B023
        here = edges.where(F.col("band") == b).select("lo", "hi", "w").join(name("lo"), "lo").join(name("hi"), "hi")
        here = tables.write(here.select(F.col("lo_root").alias("lo"), F.col("hi_root").alias("hi"), "w"))
        touched = here.select(F.col("lo").alias("root")).unionByName(here.select(F.col("hi").alias("root"))).distinct()
        now = states.join(touched, "root")
        def step(e: pd.DataFrame, s: pd.DataFrame) -> pd.DataFrame:
            return merged(e, s, least, b << 32)  # noqa: B023  it is pickled before the next band

        # a band has about BAND edges, and so at most twice as many roots
        here, now = here.withColumn("one", F.pmod("lo", F.lit(1))), now.withColumn("one", F.pmod("root", F.lit(1)))
        here, now = here.toDF(*here.columns), now.toDF(*now.columns)
        done = tables.write(here.groupBy("one").cogroup(now.groupBy("one")).applyInPandas(step, STEP))
        gone = done.where("kind = 'cluster'").select(F.col("root").alias("cluster"), F.col("into").alias("parent"), "ok", F.col("density").alias("densest"))
        ended = gone if ended is None else ended.unionByName(gone)
        moved = done.where("kind = 'root'").select("root", "into")
        left = done.where("kind = 'leaf'").select("root", F.col("into").alias("_c"), F.col("density").alias("_d"))
        nodes = tables.write(nodes.join(moved, "root", "left").join(left, "root", "left").select("id", F.coalesce("into", "root").alias("root"), F.coalesce("cluster", "_c").alias("cluster"), F.coalesce("density", "_d").alias("density")))
        fresh = done.where("kind = 'root'").groupBy("into").agg(F.first(F.struct("size", "cluster", "fallen", "inner", "densest")).alias("s")).select(F.col("into").alias("root"), "s.*")
        states = tables.write(states.join(touched, "root", "left_anti").unionByName(fresh))
    top = states.where("cluster is not null").select("cluster", F.lit(None).cast("long").alias("parent"), F.lit(False).alias("ok"), "densest")
    return nodes.select("id", "cluster", "density"), tables.write(ended.unionByName(top))


def _chosen(clusters: DataFrame, tables: Tables) -> DataFrame:
    """cluster, chosen: the topmost good cluster that each is in, if any. Pointers double until all have come to the top."""
    at = clusters.select("cluster", F.col("parent").alias("up"), F.when(F.col("ok"), F.col("cluster")).alias("chosen"))
    at = tables.write(at)
    while at.where("up is not null").head(1):
        above = at.select(F.col("cluster").alias("up"), F.col("up").alias("upper"), F.col("chosen").alias("higher"))
        new = tables.write(at.join(above, "up", "left").select("cluster", F.col("upper").alias("up"), F.coalesce("higher", "chosen").alias("chosen")))
        tables.drop(at)
        at = new
    return at.select("cluster", "chosen")


def hierarchy(vectors: DataFrame, *, min_cluster_size: int = 15, min_samples: int | None = None, metric: str = "cosine") -> DataFrame:
    """id, cluster (-1: noise), probability. Clusters are numbered by their smallest id. Cosine works on directions, as euclidean distance."""
    if min_cluster_size < 2 or (min_samples is not None and min_samples < 1):
        raise ValueError("clusters have two rows at least, and a core distance reaches one")
    if metric not in ("cosine", "euclidean"):
        raise ValueError(f"unknown metric {metric}")
    tables = Tables(vectors.sparkSession, "hierarchy")
    rows = tables.write(vectors.select("id", F.col("vector").cast("array<double>").alias("v")))
    classes = rows.where("v is not null").groupBy("v").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))
    classes = tables.write(classes.select(F.monotonically_increasing_id().alias("id"), "v", "n", "first"))
    part = metric_space.partition(classes.select("id", "v", "n"), tables, unit=metric == "cosine")
    points, tree = spanning_tree(part, min_samples or min_cluster_size, tables)
    left, clusters = _condensed(points, tree, min_cluster_size, tables)
    chosen = _chosen(clusters, tables)
    densest = clusters.select(F.col("cluster").alias("chosen"), "densest")
    inside = left.join(chosen, "cluster").join(densest, "chosen")
    share = F.when(F.col("density") >= F.col("densest"), 1.0).otherwise(F.col("density") / F.col("densest"))
    inside = tables.write(inside.select("id", "chosen", share.alias("probability")).join(classes.select("id", "v", "first"), "id"))
    names = inside.groupBy("chosen").agg(F.min("first").alias("first"))  # a row for each cluster that was chosen
    names = names.select("chosen", (F.row_number().over(Window.orderBy("first")) - 1).alias("cluster"))
    found = inside.join(names, "chosen").select(F.col("v").alias("_v"), "cluster", "probability")
    out = rows.join(found, F.col("v") == F.col("_v"), "left")
    return out.select("id", F.coalesce("cluster", F.lit(-1)).alias("cluster"), F.coalesce("probability", F.lit(0.0)).alias("probability"))
