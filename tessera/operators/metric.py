"""A metric partition of vectors: bounded blocks, and which pairs of them can hold rows within a distance, by the triangle inequality.

Each row goes to the nearest of some pivots; the rows of one pivot are split by their distance to it, and again by a hash where many are as far. A block
keeps the least and the greatest distance of its rows to each pivot. Two rows are at least as far apart as their distances to a pivot differ, so a pair of
blocks whose ranges are further apart than the reach asked for is left out, which is a proof and no estimate.

Bounds: blocks have about ``BLOCK`` rows, or more where there would be over ``MOST_BLOCKS`` of them. The driver holds ``PIVOTS`` vectors, and two numbers for each block and pivot.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.session import Tables

BLOCK, PIVOTS, RINGS, MOST_BLOCKS = 4096, 64, 256, 16_384
#: Rows that are compared with others at once; blocks on either side of a group, and numbers that those on the right hold together, at most.
STRIP, TALL, WIDE, HELD = 256, 2, 8, 4 << 20
#: Distances that are held at once, unless 16 rows have more.
CELLS = 2 << 20


def stacked(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


def vectors_of(rows: pd.DataFrame) -> np.ndarray:
    """The vectors of rows that are compared."""
    known = rows.attrs.get("stacked")
    return stacked(rows["v"]) if known is None else known


def products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distances of all rows of ``x`` from all of ``y``, by one matrix product: right but for rounding, see ``slack``."""
    return np.sqrt(np.maximum((x**2).sum(1)[:, None] + (y**2).sum(1) - 2 * x @ y.T, 0))


def slack(x: np.ndarray, y: np.ndarray) -> float:
    """More than rounding moves a distance of ``products``."""
    return 1e-6 * float(np.sqrt(max((x**2).sum(1).max(), (y**2).sum(1).max()))) + 1e-300


def apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distances row by row, of the same last bit in either order and whatever else is compared."""
    return np.concatenate([np.sqrt(((x[i : i + 65536] - y[i : i + 65536]) ** 2).sum(axis=1)) for i in range(0, len(x), 65536)] or [np.zeros(0)])


def close(x: np.ndarray, y: np.ndarray, n: int, reach: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """(rows of x, rows of y): pairs among which are the ``n`` nearest rows of y of each row of x, or all of those within its ``reach`` if that is fewer. A single-precision product finds them, with room for its rounding."""
    scale = max(np.abs(x).max(), np.abs(y).max()) or 1.0  # so that squares neither vanish nor overflow
    x, y = x / scale, y / scale
    square = (x**2).sum(axis=1)
    room = np.float32(4e-7 * (x.shape[1] + 8) * max(square.max(), (y**2).sum(axis=1).max()) + 1e-30)
    ahead = np.column_stack([-2 * x, np.ones(len(x))]).astype(np.float32)
    gap = ahead @ np.column_stack([y, (y**2).sum(axis=1)]).astype(np.float32).T  # squares of distances, less those of x
    if reach is None:
        return np.nonzero(gap <= np.partition(gap, n - 1, axis=1)[:, n - 1 : n] + room)
    near = gap <= (np.where(np.isfinite(reach), reach / scale, 1e15) ** 2 - square).astype(np.float32)[:, None] + room
    crowded = np.flatnonzero(np.count_nonzero(near, axis=1) > 8 * n)  # the others have few as it is
    if len(crowded):
        near[crowded] &= gap[crowded] <= np.partition(gap[crowded], n - 1, axis=1)[:, n - 1 : n] + room
    return np.nonzero(near)


class Partition:
    """``rows``: the given columns and ``block``; ``low`` and ``high``: a row for each block, a column for each pivot."""

    def __init__(self, rows: DataFrame, low: np.ndarray, high: np.ndarray, margin: float, wide: int = 1):
        self.rows, self.low, self.high, self.margin, self.blocks, self.wide = rows, low, high, margin, len(low), wide

    def pairs(self, reach: np.ndarray, *, once: bool = False, apart_from: DataFrame | None = None) -> DataFrame:
        """i, j: the blocks j that can have a row within ``reach[i]`` of one of block i. ``once``: only j >= i, by the greater reach."""
        low, high, margin, spark = self.low, self.high, self.margin, self.rows.sparkSession

        def bounded(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in it:
                for i in pdf["id"]:
                    gap = np.maximum(low - high[i], low[i] - high).max(axis=1) - margin
                    near = gap <= (np.maximum(reach, reach[i]) if once else reach[i])
                    j = np.flatnonzero(near)
                    yield pd.DataFrame({"i": int(i), "j": j[j >= i] if once else j})

        tasks = max(min(self.blocks // 16, 1000), 1)
        out = spark.range(0, self.blocks, 1, tasks).mapInPandas(bounded, "i long, j long")
        return out if apart_from is None else out.join(apart_from, ["i", "j"], "left_anti")

    def compared(self, left: DataFrame, right: DataFrame, pairs: DataFrame, compare: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str, *, few: bool = False) -> DataFrame:
        """What ``compare`` gives for strips of the rows of each block and those of the blocks that it is paired with. Both sides have a column ``block``.

        A few blocks on either side are one group, so that rows travel less often and fewer are handed on; two blocks that aren't paired may meet in one, where nothing is near.
        ``few``: the left side is a part of the rows; as many blocks of it are one group as together have a block's rows, so that the right side travels as often as the left one is large."""
        names = [x.split()[0] for x in schema.split(", ")]
        tall = min(TALL, self.wide)
        if few:
            group, held, of = 0, 0, []
            for r in left.groupBy("block").count().orderBy("block").collect():  # a row for each block
                if held and held + r["count"] > tall * BLOCK:
                    group, held = group + 1, 0
                held += r["count"]
                of.append((r["block"], group))
            pairs = pairs.join(F.broadcast(self.rows.sparkSession.createDataFrame(of, "i long, gi long")), "i")
        else:
            pairs = pairs.withColumn("gi", F.floor(F.col("i") / tall))
        pairs = pairs.select("i", "j", "gi", F.floor(F.col("j") / self.wide).alias("gj"))
        here = left.join(pairs.select(F.col("i").alias("block"), "gi", "gj").distinct(), "block")
        there = right.join(pairs.select(F.col("j").alias("block"), "gi", "gj").distinct(), "block")

        def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
            if not len(b):
                return pd.DataFrame({n: [] for n in names})
            b.attrs["stacked"] = stacked(b["v"])  # once for all strips
            strip = max(min(STRIP, CELLS // len(b)), 16)
            out = [compare(a.iloc[at : at + strip].reset_index(drop=True), b) for at in range(0, len(a), strip)]
            return pd.concat(out) if out else pd.DataFrame({n: [] for n in names})

        here, there = here.toDF(*here.columns), there.toDF(*there.columns)
        return here.groupBy("gi", "gj").cogroup(there.groupBy("gi", "gj")).applyInPandas(run, schema)


def partition(vectors: DataFrame, tables: Tables, *, unit: bool = False) -> Partition:
    """The partition of rows (id, v: array<double>, and more) without nulls; ``unit``: by their directions, zero vectors as they are."""
    kinds = dict(vectors.dtypes)
    schema = ", ".join(f"`{c}` {t}" for c, t in vectors.dtypes)

    def scaled(v: np.ndarray) -> np.ndarray:
        n = np.linalg.norm(v, axis=1, keepdims=True)
        return v / np.where(n > 0, n, 1) if unit else v

    total = vectors.count()
    size = max(BLOCK, -(-total // MOST_BLOCKS))
    wanted = max(-(-total // size), 1)
    chosen = vectors.orderBy(F.xxhash64("id"), "id").limit(min(PIVOTS, wanted)).select("v").collect()
    if not chosen:
        return Partition(vectors.withColumn("block", F.lit(0).cast("long")), np.zeros((1, 1)), np.zeros((1, 1)), 0.0)
    pivots = scaled(np.array([r["v"] for r in chosen], dtype=np.float64))

    def celled(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            v = scaled(stacked(pdf["v"]))
            gap = products(v, pivots)
            at = gap.argmin(axis=1)
            yield pdf.assign(v=list(v), cell=at, far=gap[np.arange(len(at)), at])

    rows = tables.write(vectors.mapInPandas(celled, f"{schema}, cell int, far double"))
    cuts = [i / RINGS for i in range(1, RINGS)]
    edges: dict[int, list[float]] = {}
    for r in rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("far", cuts, 10_000).alias("q")).collect():
        rings = min(-(-r["n"] // size), RINGS)
        edges[r["cell"]] = sorted({r["q"][max(round(j * RINGS / rings) - 1, 0)] for j in range(1, rings)})

    def ringed(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            yield pdf.assign(ring=[int(np.searchsorted(edges[c], f)) for c, f in zip(pdf["cell"], pdf["far"], strict=True)]).drop(columns="far")

    rows = rows.mapInPandas(ringed, f"{schema}, cell int, ring int")
    counts = rows.groupBy("cell", "ring").count().collect()  # about as many as there are blocks
    base, places = 0, []
    for r in sorted(counts):
        parts = -(-r["count"] // size)
        places.append((r["cell"], r["ring"], base, parts))
        base += parts
    of = rows.sparkSession.createDataFrame(places, "cell int, ring int, base long, parts long")
    rows = rows.join(F.broadcast(of), ["cell", "ring"]).withColumn("block", F.col("base") + F.pmod(F.xxhash64("id"), F.col("parts"))).select(*kinds, "block")
    rows = tables.write(rows)

    def ranged(pdf: pd.DataFrame) -> pd.DataFrame:
        v = stacked(pdf["v"])
        gap = products(v, pivots)
        return pd.DataFrame({"block": pdf["block"].iloc[:1], "low": [gap.min(axis=0)], "high": [gap.max(axis=0)], "norm": [float(np.sqrt((v**2).sum(axis=1).max()))]})

    stats = rows.select("block", "v").groupBy("block").applyInPandas(ranged, "block long, low array<double>, high array<double>, norm double").collect()
    low, high = np.full((base, len(pivots)), np.inf), np.full((base, len(pivots)), -np.inf)
    for r in stats:
        low[r["block"]], high[r["block"]] = r["low"], r["high"]
    return Partition(rows, low, high, 4e-6 * max(r["norm"] for r in stats), max(1, min(WIDE, HELD // (size * pivots.shape[1]))))


def nearest(part: Partition, k: int, tables: Tables) -> DataFrame:
    """id, rank, neighbour, distance: the k nearest other rows of each row (ties to the smaller id), exactly; only pairs of blocks are compared that can have one."""
    kind = dict(part.rows.dtypes)["id"]
    schema = f"id {kind}, neighbour {kind}, distance double"

    def least(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        """Of rows with a ``reach``, or of rows of one block, the k nearest."""
        x, y = stacked(a["v"]), vectors_of(b)
        row, column = close(x, y, min(k + 1, len(b)), a["reach"].to_numpy() if "reach" in a else None)
        ids, others = a["id"].to_numpy(), b["id"].to_numpy()
        met = ids[row] == others[column]
        if "reach" in a:  # rows of one block have met
            met |= a["block"].to_numpy()[row] == b["block"].to_numpy()[column]
        row, column = row[~met], column[~met]
        out = pd.DataFrame({"row": row, "id": ids[row], "neighbour": others[column], "distance": apart(x[row], y[column])}).sort_values(["row", "distance", "neighbour"])
        return out[out.groupby("row").cumcount() < k][["id", "neighbour", "distance"]]

    def at_home(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.concat([least(pdf.iloc[at : at + STRIP].reset_index(drop=True), pdf) for at in range(0, len(pdf), STRIP)])

    rows = part.rows.select("id", "v", "block")
    found = tables.write(rows.groupBy("block").applyInPandas(at_home, schema))
    if part.blocks > 1:
        # no row's k nearest are further than the k-th in its own block
        bound = found.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.max("distance").alias("reach")).where(F.col("n") >= k).select("id", "reach")
        asks = tables.write(rows.join(bound, "id", "left").na.fill(float("inf"), ["reach"]))
        reach = np.full(part.blocks, -np.inf)
        for r in asks.groupBy("block").agg(F.max("reach").alias("reach")).collect():
            reach[r["block"]] = r["reach"]
        own = part.rows.sparkSession.range(part.blocks).select(F.col("id").alias("i"), F.col("id").alias("j"))
        found = found.unionByName(part.compared(asks, rows, part.pairs(reach, apart_from=own), least, schema))
    nth = F.row_number().over(Window.partitionBy("id").orderBy("distance", "neighbour"))
    return found.withColumn("rank", nth).where(F.col("rank") <= k).select("id", "rank", "neighbour", "distance")
