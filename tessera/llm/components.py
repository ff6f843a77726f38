"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._common import Scratch, parts


def local(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest reachable node of each of the nodes 0 to n - 1 over the links a-b."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while not np.array_equal(new, hop := new[new]):
            new = hop
        if np.array_equal(new, label):
            break
        label = new
    return label


def spanning(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning forest over the links a-b of any ids: one of each node to the smallest that it reaches, the smaller id first."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    label = local(len(nodes), at[: len(a)], at[len(a) :])
    member = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[label[member]], nodes[member]


class Forest:
    """A task's links, held as a spanning forest: of links among the same nodes, which a task finds again and again, few are handed on.
    At most ``most`` are held; a forest of over half as many is handed on, and another one begun."""

    def __init__(self, most: int = 1 << 19):
        self.most, self.held = most, 0
        self.a: list[np.ndarray] = []
        self.b: list[np.ndarray] = []

    def add(self, a: np.ndarray, b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        self.a.append(a)
        self.b.append(b)
        self.held += len(a)
        if self.held > self.most:
            a, b = next(self.rest())
            if len(a) > self.most // 2:
                yield a, b
            else:
                self.a, self.b, self.held = [a], [b], len(a)

    def rest(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        empty = np.zeros(0, np.int64)
        a, b = np.concatenate([empty, *self.a]), np.concatenate([empty, *self.b])
        self.a, self.b, self.held = [], [], 0
        yield spanning(a, b)


def _star(links: DataFrame, large: bool) -> DataFrame:
    """One phase over rows (a, b), dealt by a: links to the smallest neighbour m of a, in one pass over sorted rows. Large: of the neighbours that are larger
    than a; small: of all those that are smaller, and of a."""
    if large:
        links = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node = least = before = None  # of the row before
        for batch in batches:
            a, b = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if not len(a):
                continue
            first = np.append(node is None or a[0] != node, a[1:] != a[:-1])
            again = np.append(not first[0] and b[0] == before, ~first[1:] & (b[1:] == b[:-1]))
            at = np.maximum.accumulate(np.where(first, np.arange(len(a)), -1))
            m = np.where(at >= 0, b[np.maximum(at, 0)], 0 if least is None else least)
            node, least, before = a[-1], m[-1], b[-1]
            if large:
                keep = ~again & (b > a)
                x, y = b[keep], np.minimum(m, a)[keep]
            else:
                keep = ~again & (b != m)
                x, y = np.concatenate([b[keep], a[first]]), np.concatenate([m[keep], m[first]])
            yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], names=["a", "b"])

    return links.repartition(parts(links.sparkSession), "a").sortWithinPartitions("a", "b").mapInArrow(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(node, root) for each node of ``links`` (a, b: long) that isn't the smallest of its component; root is that smallest node.

    Each round is written to the shared folder. In a large star a node links its larger neighbours to its smallest one, in a
    small star the smaller ones; the links end as stars after a logarithmic number of rounds in practice. A node's
    neighbours pass by in sorted order, and are never held or listed in a row."""
    scratch = Scratch(links.sparkSession, "components")

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    at = scratch.write(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = state(at)
    while seen[0]:
        large = scratch.write(_star(at, True))
        small = scratch.write(_star(large, False).distinct())
        scratch.drop(large)
        scratch.drop(at)
        at, last = small, seen
        seen = state(at)
        if seen == last:
            break
    return at.select(F.col("a").alias("node"), F.col("b").alias("root"))
