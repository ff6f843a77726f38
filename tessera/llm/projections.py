"""Near copies among vectors by sorted projection passes.

In each pass a vector has a code of some random hashes, one after the other: after a random rotation, the component that is largest in size, and its sign. Vectors
are ordered by their codes byte by byte, and each is compared, in double precision, with those in its own block of ``BLOCK`` places and in the next one. Links of all passes
make the components. A pair that shares a window in several passes counts in the first of them, which both sides tell from their blocks; so pairs are
counted where they meet, and never listed: a block hands on a number for each vector, and a spanning forest of its links.

The number of passes follows from the number of vectors, so that a pair right at the threshold is found with the chance ``recall`` at every size: two such vectors have
the same hash with a chance that is estimated once for the dimension; the hashes that it takes to fill only a window give the chance of a pass.

Windows are bounded; groups beyond them go another way, in which nothing is compared twice: equal vectors are one with their number, and a *ball* is a group of vectors
within half the threshold's angle of one centre, which link to each other by the triangle inequality. Centres come from the crowded vectors of the blocks, and
are merged in rounds; whether a vector is in a ball is tested against its centre. A ball's members count each other by its size, and windows leave them out.

Nulls: vectors that are null, zero, empty or hold null or non-finite components link with nothing: no links, a component of their own, kept. So do vectors of different
lengths. A null id takes part, is never the smallest, and is kept if its component has no id. Rows with one id are rows of their own. An empty table gives an empty one.
"""

from __future__ import annotations

import math
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import components as links_of
from tessera.llm._common import Scratch, attached, parts

BLOCK, CROWD, SEED = 512, 64, 29


@cache
def rotation(dim: int, which: int) -> np.ndarray:
    return np.linalg.qr(np.random.default_rng([SEED, dim, which]).standard_normal((dim, dim)))[0].astype(np.float32)


def hashed(vectors: np.ndarray, which: int) -> np.ndarray:
    """Twice the place of the component that is largest in size after a rotation, plus one where it is negative."""
    turned = vectors.astype(np.float32) @ rotation(vectors.shape[1], which)
    at = np.abs(turned).argmax(axis=1)
    return 2 * at + (turned[np.arange(len(at)), at] < 0)


def codes(vectors: np.ndarray, which: int, hashes: int) -> list[bytes]:
    """The hashes of pass ``which``, as bytes in whose order the vectors are sorted."""
    found = np.stack([hashed(vectors, which * hashes + i) for i in range(hashes)], axis=1).astype(">u2")
    return [x.tobytes() for x in found]


@cache
def agreement(dim: int, cosine: float) -> float:
    """The chance that two vectors of this cosine have the same hash, from 20,000 random pairs."""
    rng = np.random.default_rng([SEED, dim])
    x, y = rng.standard_normal((2, 20_000, dim))
    if dim == 1:
        return 1.0
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y -= (x * y).sum(axis=1, keepdims=True) * x
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    return float((hashed(x, 0) == hashed(cosine * x + math.sqrt(1 - cosine**2) * y, 0)).mean())


def passes_for(n: int, dim: int, cosine: float, recall: float) -> int:
    """Passes over ``n`` vectors after which a pair of this cosine has met with the chance ``recall``."""
    needed = math.log(max(n / BLOCK, 1)) / math.log(2 * max(dim, 2))
    once = min(max(agreement(dim, cosine) ** needed, 1e-3), 0.9)
    return math.ceil(math.log(1 - recall) / math.log(1 - once))


def unit(packed: pd.Series) -> np.ndarray:
    v = np.stack([np.frombuffer(x, dtype=np.float64) for x in packed])
    v = v / np.abs(v).max(axis=1, keepdims=True)  # so that squares neither vanish nor overflow
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def crowds(v: np.ndarray, cosine: float, inner: float, least: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(centre, its members' places): greedy balls around the means of the most linked vectors and their partners."""
    near = v @ v.T >= cosine
    free, out = np.ones(len(v), dtype=bool), []
    degree = near.sum(axis=1)
    while free.any():
        degree = np.where(free, (near & free).sum(axis=1), 0)
        at = int(degree.argmax())
        if degree[at] < least:
            break
        partners = near[at] & free
        centre = v[partners].mean(axis=0)
        centre /= np.linalg.norm(centre)
        members = free & (v @ centre >= inner)
        if members.sum() >= least:
            out.append((centre, np.flatnonzero(members)))
            free &= ~members
        else:
            free &= ~partners  # too loose for a ball: windows see to them
    return out


def _placed(scratch: Scratch, coded: DataFrame) -> DataFrame:
    """node, which, block: the places of (which, dim, code, node) in the order of all codes, in blocks of BLOCK."""
    spark = coded.sparkSession
    order = ["which", "dim", "code", "node"]
    at = scratch.write(coded.repartitionByRange(parts(spark), *order).sortWithinPartitions(*order).select("which", "node", F.monotonically_increasing_id().alias("at")))
    part = F.shiftrightunsigned("at", 33)
    sizes = sorted((r[0], r[1]) for r in at.groupBy(part.alias("part")).count().collect())  # one for each task
    starts, total = {}, 0
    for p, n in sizes:
        starts[p] = total
        total += n
    if not starts:
        return at.select("node", "which", F.lit(0).cast("long").alias("block"))
    start = F.create_map(*[F.lit(x) for kv in starts.items() for x in kv])[part]
    place = start + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    return at.select("node", "which", F.floor(place / BLOCK).alias("block"))


def _balls(scratch: Scratch, placed: DataFrame, classes: DataFrame, cosine: float, inner: float) -> DataFrame | None:
    """node, ball: at most one ball for each vector, by its centre; None if nothing is crowded."""

    def find(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for dim, part in pdf.groupby("dim"):
            for centre, members in crowds(unit(part["v"]), cosine, inner, CROWD):
                nodes = part["node"].to_numpy()[members]
                name = int(part["which"].iloc[0]) << 52 | int(part["block"].iloc[0]) << 12 | len(out)
                out.append(pd.DataFrame({"node": nodes, "pivot": name, "centre": [centre.tobytes()] + [None] * (len(nodes) - 1), "n": len(nodes), "dim": int(dim)}))
        return pd.concat(out) if out else pd.DataFrame({"node": [], "pivot": [], "centre": [], "n": [], "dim": []})

    found = scratch.write(placed.join(classes.select("node", "dim", "v"), "node").groupBy("which", "block").applyInPandas(find, "node long, pivot long, centre binary, n long, dim int"))
    centres = scratch.write(found.where("centre is not null").groupBy("pivot").agg(F.first("centre").alias("centre"), F.first("n").alias("n"), F.first("dim").alias("dim")))
    count = centres.count()
    if not count:
        return None
    # centres of one group are merged in rounds, block by block in the order of their codes; those left over are balls of their own
    names = centres.select("pivot", F.col("pivot").alias("ball"))

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, part in pdf.sort_values(["n", "pivot"], ascending=[False, True]).groupby("dim"):
            v, pivots, n = unit(part["centre"]), part["pivot"].to_numpy(), part["n"].to_numpy()
            free = np.ones(len(v), dtype=bool)
            for i in range(len(v)):
                if free[i]:
                    same = free & (v @ v[i] >= tight)
                    centre = (v[same] * n[same, None]).sum(axis=0)
                    free &= ~same
                    out.append(pd.DataFrame({"pivot": pivots[same], "into": pivots[i], "centre": [(centre / np.linalg.norm(centre)).tobytes()] * int(same.sum()), "n": int(n[same].sum()), "dim": int(part["dim"].iloc[0])}))
        return pd.concat(out)

    tight, turn = math.cos(math.acos(inner) / 2), 0  # within half a ball's radius
    while True:
        coded = centres.select(F.lit(0).alias("which"), "dim", "pivot", "centre").mapInPandas(lambda it, t=turn: (p.assign(code=_codes_by_dim(p["centre"], p["dim"], 1000 + t, 2)).drop(columns="centre") for p in it), "which int, dim int, pivot long, code binary")
        at = _placed(scratch, coded.withColumnRenamed("pivot", "node"))
        merged = scratch.write(centres.join(at.select(F.col("node").alias("pivot"), "block"), "pivot").groupBy("block").applyInPandas(merge, "pivot long, into long, centre binary, n long, dim int"))
        names = scratch.write(names.join(merged.select(F.col("pivot").alias("ball"), "into"), "ball").select("pivot", F.col("into").alias("ball")))
        centres = scratch.write(merged.where("pivot = into").select("pivot", "centre", "n", "dim"))
        before, count, turn = count, centres.count(), turn + 1
        if count == before or count == 1:
            break

    def tested(it):
        for pdf in it:
            v, c = unit(pdf["v"]), unit(pdf["centre"])
            yield pdf.loc[(v * c).sum(axis=1) >= inner, ["node", "ball", "n"]]

    member = found.select("node", "pivot").join(names, "pivot").select("node", "ball").distinct()
    # a centre is joined to its members' vectors as often as it has them: hot ones go to each task
    crowd = member.join(classes.select("node", "v"), "node")
    sized = centres.select(F.col("pivot").alias("ball"), "centre", "n")
    inside = attached(crowd, sized, "ball", max(classes.count(), 1)).select("node", "ball", "v", "centre", "n").mapInPandas(tested, "node long, ball long, n long")
    return scratch.write(inside.groupBy("node").agg(F.max_by("ball", F.struct("n", "ball")).alias("ball")))


def _codes_by_dim(packed: pd.Series, dims: pd.Series, which: int, hashes: int) -> np.ndarray:
    out = np.empty(len(packed), dtype=object)
    for dim in dims.unique():
        at = np.flatnonzero(dims.to_numpy() == dim)
        out[at] = codes(unit(packed.iloc[at]), which, hashes)
    return out


def near_vectors(table: DataFrame, *, cosine: float = 0.95, recall: float = 0.995, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id, kept: the vectors that link with a cosine of ``cosine`` or more, one row each."""
    scratch = Scratch(table.sparkSession, "projections")
    inner = math.cos(math.acos(cosine) / 2) + 1e-9  # of a ball's members with its centre: by the triangle inequality any two have the cosine
    v = F.col(vector_col).cast("array<double>")
    whole = F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0), F.lit(False))
    rows = table.select(F.col(id_col).cast("long").alias("id"), F.when(whole, v).alias("x"))

    def pack(it):
        for pdf in it:
            yield pdf.assign(v=[None if x is None else np.asarray(x, dtype=np.float64).tobytes() for x in pdf["x"]]).drop(columns="x")

    rows = scratch.write(rows.mapInPandas(pack, "id long, v binary"))
    equal = rows.where("v is not null").groupBy("v").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("least"))
    classes = scratch.write(equal.select(F.monotonically_increasing_id().alias("node"), "v", (F.length("v") / 8).cast("int").alias("dim"), "n", "least"))
    total, dim = classes.agg(F.count(F.lit(1)), F.max("dim")).first()
    if not total:
        return rows.select(F.col("id").alias("vec_id"), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    passes = passes_for(total, dim, cosine, recall)
    hashes = math.ceil(math.log(max(total, 2)) / math.log(2 * max(dim, 2))) + 1

    def coded(it):
        for pdf in it:
            for which in range(passes):
                yield pd.DataFrame({"which": which, "dim": pdf["dim"], "node": pdf["node"], "code": _codes_by_dim(pdf["v"], pdf["dim"], which, hashes)})

    placed = _placed(scratch, classes.select("node", "dim", "v").mapInPandas(coded, "which int, dim int, node long, code binary"))
    balls = _balls(scratch, placed, classes, cosine, inner)
    homes = placed.groupBy("node").agg(F.transform(F.sort_array(F.collect_list(F.struct("which", "block"))), lambda x: x["block"]).alias("homes"))
    members = classes.join(homes, "node")
    members = members.join(balls, "node", "left") if balls is not None else members.withColumn("ball", F.lit(None).cast("long"))
    members = scratch.write(members)

    # each block meets itself and the next one
    home = F.posexplode("homes").alias("which", "home")
    windows = members.select("node", "v", "dim", "n", "homes", "ball", home).select("*", F.explode(F.array("home", F.col("home") - 1)).alias("block"))

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"node": [], "other": [], "n": []})]
        for _, part in pdf.groupby("dim"):
            own = (part["home"] == part["block"]).to_numpy()
            x, left = part[own], np.flatnonzero(own)
            if not len(x):
                continue
            vectors, which = unit(part["v"]), int(part["which"].iloc[0])
            met = vectors[left] @ vectors.T >= cosine
            node = part["node"].to_numpy()
            met &= node[left][:, None] != node[None, :]
            met[:, left] &= np.triu(np.ones((len(left), len(left)), dtype=bool), 1)
            homes = np.stack(part["homes"].to_numpy())
            ball = pd.factorize(part["ball"])[0]  # -1: none
            met &= (ball[left][:, None] != ball[None, :]) | (ball[left][:, None] < 0)
            a, b = np.nonzero(met)
            new = ~(np.abs(homes[left[a], :which] - homes[b, :which]) <= 1).any(axis=1) if which else np.ones(len(a), dtype=bool)
            a, b = left[a[new]], b[new]
            if len(a):
                n = part["n"].to_numpy()
                links = np.bincount(a, weights=n[b], minlength=len(part)) + np.bincount(b, weights=n[a], minlength=len(part))
                some = np.flatnonzero(links)
                label = links_of.local(len(part), a, b)
                other = np.where(label[some] != some, node[label[some]], -1)
                out.append(pd.DataFrame({"node": node[some], "other": other, "n": links[some].astype(np.int64)}))
        return pd.concat(out)

    met = scratch.write(windows.groupBy("which", "block").applyInPandas(compare, "node long, other long, n long"))
    links = met.where("other >= 0").select(F.col("node").alias("a"), F.col("other").alias("b"))
    found = met.groupBy("node").agg(F.sum("n").alias("more"))
    if balls is not None:
        crowd = scratch.write(members.where("ball is not null").groupBy("ball").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("size"), F.min("node").alias("first")))
        stars = attached(members.where("ball is not null").select("node", "ball"), crowd.withColumnRenamed("rows", "n"), "ball", total)
        stars = scratch.write(stars.select("node", "first", "size"))
        links = links.unionByName(stars.where("node <> first").select(F.col("node").alias("a"), F.col("first").alias("b")))
    roots = links_of.components(links)
    done = members.select("node", "v", "n", "least").join(found, "node", "left").join(roots, "node", "left")
    done = done.join(stars.select("node", "size"), "node", "left") if balls is not None else done.withColumn("size", F.lit(None).cast("long"))
    done = scratch.write(done.select("v", "n", "least", F.coalesce("root", "node").alias("root"), (F.coalesce("size", "n") - 1 + F.coalesce("more", F.lit(0))).cast("long").alias("n_links")))
    tops = done.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("n"))
    done = scratch.write(attached(done.select("root", "v", "n_links", F.col("n").alias("rows")), tops, "root", total).select("v", "n_links", "component_id", F.col("rows").alias("n")))
    out = attached(rows.where("v is not null"), done, "v", rows.count())
    alone = rows.where("v is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = out.select("id", "n_links", "component_id").unionByName(alone)
    return out.select(F.col("id").alias("vec_id"), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
