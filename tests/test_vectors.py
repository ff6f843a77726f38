"""Neighbours over a metric partition, the density hierarchy and exact trees of clusters against brute force."""

import numpy as np
import pytest

from tessera.operators import density, metric, trees, vectors
from tessera.session import Tables


def cloud(seed, n=500, dim=4, copies=True):
    rng = np.random.default_rng(seed)
    x = [rng.normal(rng.uniform(-6, 6, size=dim), rng.uniform(0.1, 0.9), size=(n // 8, dim)) for _ in range(6)]
    x.append(rng.uniform(-9, 9, size=(n - 6 * (n // 8), dim)))
    x = np.concatenate(x)
    if copies:
        x[20:45], x[100:104], x[-3:] = x[19], x[99], x[-4]
    return x[rng.permutation(len(x))]


def table(spark, x, kind="long"):
    return spark.createDataFrame([(f"r{i:04}" if kind == "string" else i, v.tolist()) for i, v in enumerate(x)], f"id {kind}, vector array<double>").repartition(3)


def gaps(x):
    return np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))


@pytest.mark.parametrize("kind", ["euclidean", "cosine"])
def test_neighbours_with_copies_and_small_blocks(spark, monkeypatch, kind):
    monkeypatch.setattr(metric, "BLOCK", 32)
    x = cloud(1)
    full = gaps(x) if kind == "euclidean" else gaps(x / np.linalg.norm(x, axis=1, keepdims=True)) ** 2 / 2
    np.fill_diagonal(full, np.inf)
    got = {}
    for r in vectors.neighbours(table(spark, x), 7, metric=kind).collect():
        got.setdefault(r.id, {})[r["rank"]] = (r.neighbour, r.distance)
    for i in range(len(x)):
        order = sorted(range(len(x)), key=lambda j: (full[i, j], j))[:7]
        assert np.allclose([got[i][k + 1][1] for k in range(7)], full[i, order], atol=1e-9)
        if kind == "euclidean":
            assert [got[i][k + 1][0] for k in range(7)] == order


def test_blocks_far_apart_are_left_out(spark, monkeypatch):
    monkeypatch.setattr(metric, "BLOCK", 25)
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(c, 0.2, size=(100, 3)) for c in ((0, 0, 0), (30, 0, 0), (0, 30, 0), (0, 0, 30))])
    tables = Tables(spark, "test")
    part = metric.partition(table(spark, x).withColumnRenamed("vector", "v"), tables)
    assert part.blocks >= 12
    rows = {r.id: (r.block, np.array(r.v)) for r in part.rows.collect()}
    reach = np.full(part.blocks, 1.5)
    pairs = {(r.i, r.j) for r in part.pairs(reach).collect()}
    assert len(pairs) < part.blocks**2 / 2
    full = gaps(np.array([rows[i][1] for i in range(len(x))]))
    for i, j in zip(*np.nonzero(full <= 1.5)):
        assert (rows[i][0], rows[j][0]) in pairs
    once = {(r.i, r.j) for r in part.pairs(reach, once=True).collect()}
    assert once == {(i, j) for i, j in pairs if j >= i}
    tables.close()


def by_definition(x, least, samples):
    """(label, probability) of each row, from the top down over all distances; labels are the smallest rows of the clusters."""
    d = gaps(x)
    core = np.sort(d, axis=1)[:, samples - 1]
    w = np.maximum(np.maximum(d, core[:, None]), core[None, :])

    def components(rows, below):
        left, out = set(rows), []
        while left:
            todo = [left.pop()]
            one = set(todo)
            while todo:
                i = todo.pop()
                new = {j for j in left if w[i, j] < below}
                left -= new
                one |= new
                todo += new
            out.append(sorted(one))
        return out

    near, there, lengths = w[0].copy(), np.zeros(len(x), dtype=bool), []  # only lengths of a spanning tree split anything
    there[0] = True
    for _ in range(len(x) - 1):
        at = int(np.where(there, np.inf, near).argmin())
        lengths.append(near[at])
        there[at] = True
        near = np.minimum(near, w[at])
    levels = np.unique(lengths)[::-1]
    clusters = []  # birth, rows with the densities at which they leave, inner ones

    def descend(rows, birth, at):
        me = {"birth": birth, "left": {}, "inner": [], "rows": rows}
        while at < len(levels):
            parts = components(rows, levels[at])
            lam = 1 / levels[at] if levels[at] else np.inf
            at += 1
            if len(parts) == 1:
                continue
            big = [p for p in parts if len(p) >= least]
            me["left"] |= {i: lam for p in parts if len(p) < least for i in p}
            if len(big) != 1:
                if big:
                    me["split"] = lam
                    me["inner"] = [descend(p, lam, at) for p in big]
                break
            rows = big[0]
        clusters.append(me)
        return me

    top = descend(list(range(len(x))), 0.0, 0)

    def stability(c):
        own = sum(v - c["birth"] for v in c["left"].values()) + sum((c["split"] - c["birth"]) * len(i["rows"]) for i in c["inner"])
        inner = sum(stability(i) for i in c["inner"])
        c["ok"] = c is not top and not inner > own
        return own if c["ok"] else inner

    stability(top)
    label, share = np.full(len(x), -1), np.zeros(len(x))

    def mark(c, of):
        if of is None and c["ok"]:
            of = c
        if of is not None:
            most = max([*of["left"].values(), of.get("split", 0)])
            for i, v in c["left"].items():
                label[i], share[i] = min(of["rows"]), 1.0 if v >= most else v / most
        for i in c["inner"]:
            mark(i, of)

    mark(top, None)
    return label, share


@pytest.mark.parametrize(("seed", "least", "samples", "band", "copies"), [(3, 12, 5, 500_000, False), (4, 20, 20, 60, True), (5, 5, 3, 97, True)])
def test_hierarchy_by_definition(spark, monkeypatch, seed, least, samples, band, copies):
    monkeypatch.setattr(metric, "BLOCK", 64)
    monkeypatch.setattr(density, "BAND", band)
    x = cloud(seed, 300 if band < 1000 else 500, copies=copies)
    label, share = by_definition(x, least, samples)
    got = {r.id: r for r in density.hierarchy(table(spark, x), min_cluster_size=least, min_samples=samples, metric="euclidean").collect()}
    names = {}
    for i in range(len(x)):
        names.setdefault(got[i].cluster, int(label[i]))
        assert names[got[i].cluster] == label[i], i
    assert len(set(names.values())) == len(names) and [names[c] for c in sorted(names)] == sorted(names.values()) and len(names) > 3
    assert np.allclose([got[i].probability for i in range(len(x))], share, atol=1e-9)


def test_hierarchy_of_odd_tables(spark):
    few = spark.createDataFrame([("a", [0.0, 1.0]), ("b", None), ("c", [1.0, 0.0])], "id string, vector array<double>")
    assert {(r.id, r.cluster, r.probability) for r in density.hierarchy(few, min_cluster_size=3).collect()} == {("a", -1, 0.0), ("b", -1, 0.0), ("c", -1, 0.0)}
    assert density.hierarchy(few.limit(0)).count() == 0
    with pytest.raises(ValueError):
        density.hierarchy(few, min_cluster_size=1)


def test_merged_at_one_length_does_not_depend_on_order():
    import pandas as pd

    rng = np.random.default_rng(6)
    n = 80
    lo = np.array([rng.integers(i) for i in range(1, n)])
    edges = pd.DataFrame({"lo": lo, "hi": np.arange(1, n), "w": rng.integers(1, 5, size=n - 1) / 4})
    states = pd.DataFrame({"root": np.arange(n), "size": 1, "cluster": None, "fallen": 0.0, "inner": 0.0, "densest": 0.0})
    of = lambda e: sorted((r.root, r.density) for r in density.merged(e, states, 4, 0).itertuples() if r.kind == "leaf")
    assert of(edges) == of(edges.sample(frac=1, random_state=1)) and len(of(edges)) == n


def one_after_the_other(x, clusters, linkage):
    groups = [[i] for i in range(len(x))]
    full = gaps(x)

    def between(a, b):
        if linkage == "ward":
            return len(a) * len(b) / (len(a) + len(b)) * ((x[a].mean(0) - x[b].mean(0)) ** 2).sum()
        return {"average": np.mean, "complete": np.max, "single": np.min}[linkage](full[np.ix_(a, b)])

    while len(groups) > clusters:
        _, i, j = min((between(a, b), i, j) for i, a in enumerate(groups) for j, b in enumerate(groups[:i]))
        groups[j] += groups.pop(i)
    return {frozenset(g) for g in groups}


@pytest.mark.parametrize("linkage", trees.LINKAGES)
def test_trees_like_merging_one_after_the_other(spark, monkeypatch, linkage):
    monkeypatch.setattr(trees, "SMALL", 25)
    monkeypatch.setattr(trees, "CHUNK", 20)
    x = cloud(7, 90, dim=3, copies=False)
    got = trees.hierarchical_clusters(table(spark, x, "string"), 6, linkage=linkage).collect()
    of = {}
    for r in got:
        assert not r.two_stage
        of.setdefault(r.cluster, set()).add(int(r.id[1:]))
    assert set(map(frozenset, of.values())) == one_after_the_other(x, 6, linkage)
    assert [min(of[c]) for c in sorted(of)] == sorted(min(g) for g in of.values())


def test_trees_of_odd_tables(spark):
    x = np.repeat(np.arange(5.0), 3)[:, None] * [1.0, 0.0]
    got = trees.hierarchical_clusters(table(spark, x), 5, linkage="average").collect()
    assert {r.cluster for r in got} == set(range(5)) and all(r.cluster == r.id // 3 for r in got)
    assert {r.cluster for r in trees.hierarchical_clusters(table(spark, x[:1]), 1).collect()} == {0}
    for bad in (0, 16):
        with pytest.raises(ValueError):
            trees.hierarchical_clusters(table(spark, x), bad)
    rough = trees.hierarchical_clusters(table(spark, cloud(8, 200)), 3, exact_limit=100, micro_clusters=20).collect()
    assert len(rough) == 200 and all(r.two_stage for r in rough) and len({r.cluster for r in rough}) == 3


def test_close_rows_are_found_whatever_their_scale():
    rng = np.random.default_rng(9)
    for scale, shift, dim in ((1e25, 0.0, 4), (1e-25, 0.0, 4), (1.0, 0.0, 5), (1e-6, 0.0, 64), (1e6, 0.0, 3), (1.0, 300.0, 700)):
        x, y = (scale * rng.normal(size=(n, dim)) + shift for n in (40, 500))
        d = np.sqrt(((x[:, None] - y[None]) ** 2).sum(-1))
        found = set(zip(*(c.tolist() for c in metric.close(x, y, 6, None))))
        assert all((i, j) in found for i in range(40) for j in np.argsort(d[i])[:6])
        reach = np.sort(d, axis=1)[:, 3]
        reach[0] = np.inf
        found = set(zip(*(c.tolist() for c in metric.close(x, y, 6, reach))))
        assert all((i, j) in found for i in range(40) for j in np.argsort(d[i])[: 4 if i else 6])
