"""Divergence of sources: how far the terms of each source of a language are from those of the others, and by which terms.

A numpy table over the bytes of all texts of a chunk tells letters from the rest and lowers A to Z; from its boundaries come slices, which
xxhash groups, and which are then held against the first of their group byte by byte. Counts of a chunk go on as one row for each group
and term. Kept terms are dealt over blocks; a block of a language is a sparse matrix in rows of sources, whose sums of divergences come from
``reduceat``, and the blocks' sums are added up. All numbers are integers: counts of any size go through Python's, what is left fits in 64 bits.

Scale: texts are read once and never shuffled; a chunk hands on each of its terms once a group. A block holds about ``ENTRIES`` counts and a row for
each source of its language. The result has a row for each ordered pair of sources of a language, as the contract asks, and blocks hand on as many.
The tokens of a chunk take about ten times its bytes; a text over ``CHUNK`` bytes is a chunk by itself.

Nulls: a null text, language or source is an empty one. Texts without terms count as members of their group. Repeated rows count as often as they occur,
whatever their ids. Ties of values go to the smaller item. An empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm._common import Scratch

CHUNK, ENTRIES, SCALE = 4 << 20, 200_000, 1_000_000_000
#: The byte that a term's byte counts as; 0 for bytes that end terms: all of ASCII but its letters.
LOWERED = np.arange(256, dtype=np.uint8)
LOWERED[:128] = 0
LOWERED[ord("a") : ord("z") + 1] = LOWERED[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)


def slices(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lowered bytes, start and end of each term in them); no term crosses the offsets of the texts."""
    low = LOWERED[data]
    inside = np.zeros(len(low) + 1, dtype=bool)
    inside[:-1] = low != 0
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    bounds = offsets[(offsets > 0) & (offsets < len(low))]
    first[bounds] |= inside[bounds]
    start = np.flatnonzero(first)
    last = ~inside
    last[bounds] = True
    stops = np.flatnonzero(last)
    return low, start, stops[np.searchsorted(stops, start, side="right")]


def grouped(low: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the place of the first slice of each distinct term, the term of each slice): equal hashes first, then equal bytes."""
    raw, digest = low.tobytes(), xxhash.xxh3_64_intdigest
    h = np.fromiter((digest(raw[s:e]) for s, e in zip(start.tolist(), end.tolist(), strict=True)), np.uint64, len(start))
    _, first, of = np.unique(h, return_index=True, return_inverse=True)
    if not same_bytes(low, start, end, first[of]):  # two terms of one hash: tell the slices apart by their bytes
        known: dict[bytes, int] = {}
        of = np.fromiter((known.setdefault(raw[s:e], len(known)) for s, e in zip(start.tolist(), end.tolist(), strict=True)), np.int64, len(start))
        first = np.unique(of, return_index=True)[1]
    return first, of


def same_bytes(low: np.ndarray, start: np.ndarray, end: np.ndarray, other: np.ndarray) -> bool:
    """Whether each slice has the bytes of the slice at the place ``other``."""
    length = end - start
    if not np.array_equal(length, length[other]):
        return False
    for at in range(0, len(start), 1 << 19):
        n = length[at : at + (1 << 19)]
        within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        if not np.array_equal(low[np.repeat(start[at : at + len(n)], n) + within], low[np.repeat(start[other[at : at + len(n)]], n) + within]):
            return False
    return True


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, source, term, count, documents of each chunk; a null term stands for a group that is there."""
    for batch in batches:
        text, lang, source = (pc.fill_null(batch.column(i).cast(pa.large_string()), "") for i in range(3))
        ends = np.concatenate([[0], np.cumsum(pc.binary_length(text).to_numpy())])
        at = 0
        while at < len(text):
            to = max(int(np.searchsorted(ends, ends[at] + CHUNK, side="right")) - 1, at + 1)
            yield _chunk(text[at:to], lang[at:to], source[at:to])
            at = to


def _chunk(text: pa.Array, lang: pa.Array, source: pa.Array) -> pa.RecordBatch:
    offsets = np.frombuffer(text.buffers()[1], dtype=np.int64)[text.offset : text.offset + len(text) + 1]
    held = text.buffers()[2]
    data = np.frombuffer(held, dtype=np.uint8)[offsets[0] : offsets[-1]] if held is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    groups: dict[tuple[str, str], int] = {}
    group = np.array([groups.setdefault(x, len(groups)) for x in zip(lang.to_pylist(), source.to_pylist(), strict=True)])
    low, start, end = slices(data, offsets)
    first, of = grouped(low, start, end)
    doc = np.searchsorted(offsets, start, side="right") - 1
    n = max(len(first), 1)
    in_doc, times = np.unique(doc * n + of, return_counts=True)
    key, where = np.unique(group[in_doc // n] * n + in_doc % n, return_inverse=True)
    count, docs = np.bincount(where, weights=times, minlength=len(key)).astype(np.int64), np.bincount(where, minlength=len(key))
    raw = low.tobytes()
    terms = pa.array([raw[s:e].decode("utf-8", "replace") for s, e in zip(start[first].tolist(), end[first].tolist(), strict=True)], pa.string())
    names = list(groups)
    of_group = np.concatenate([key // n, np.arange(len(names))])
    pad = len(names)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([names[g][0] for g in of_group.tolist()], pa.string()), pa.array([names[g][1] for g in of_group.tolist()], pa.string()),
            pa.concat_arrays([terms.take(pa.array(key % n)), pa.nulls(pad, pa.string())]),
            pa.array(np.concatenate([count, np.zeros(pad, np.int64)])), pa.array(np.concatenate([docs, np.zeros(pad, np.int64)])),
        ],
        names=["lang", "source", "term", "count", "docs"],
    )


def shares(count: np.ndarray, total: int, terms: int) -> np.ndarray:
    """1 + floor(SCALE * (count + 2) / (total + 2 * terms)) for each count, exactly."""
    values, of = np.unique(count, return_inverse=True)
    return np.array([1 + SCALE * (int(c) + 2) // (int(total) + 2 * int(terms)) for c in values], dtype=np.int64)[of]


def gap(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def between_rows(indptr: np.ndarray, columns: np.ndarray, p: np.ndarray, empty: np.ndarray, width: int) -> np.ndarray:
    """The sums of gaps over all columns between each two rows of a sparse matrix: row i has ``p`` at its ``columns``, and ``empty[i]`` elsewhere."""
    n = len(empty)
    out, there = np.zeros((n, n), dtype=np.int64), np.diff(indptr) > 0
    row_of = np.repeat(np.arange(n), np.diff(indptr))
    for i in range(n):
        own = np.full(width, empty[i])
        own[columns[indptr[i] : indptr[i + 1]]] = p[indptr[i] : indptr[i + 1]]
        values, times = np.unique(own, return_counts=True)
        for j in range(0, n, 1024):  # as if all rows were empty
            out[i, j : j + 1024] = (gap(values[:, None], empty[None, j : j + 1024]) * times[:, None]).sum(axis=0)
        if there.any():  # and what the entries make of it
            mine = own[columns]
            out[i, there] += np.add.reduceat(gap(mine, p) - gap(mine, empty[row_of]), indptr[:-1][there])
    return out


def _block(entries: pd.DataFrame, groups: pd.DataFrame) -> pd.DataFrame:
    """lang, source, item, value: the part of a block of terms in the divergence of each two sources of its language."""
    groups = groups.sort_values("source")
    names, n = groups["source"].to_numpy(), len(groups)
    if not n:
        return pd.DataFrame({"lang": [], "source": [], "item": [], "value": []})
    total, terms = groups["total"].to_numpy(), int(groups["terms"].iloc[0])
    value = np.zeros((n, n), dtype=np.int64)
    if len(entries):
        row = pd.Series(np.arange(n), index=names).loc[entries["source"]].to_numpy()
        column, known = pd.factorize(entries["term"])
        order = np.argsort(row, kind="stable")
        row, column, count = row[order], column[order], entries["count"].to_numpy()[order]
        indptr = np.searchsorted(row, np.arange(n + 1))
        p = np.concatenate([shares(count[a:b], t, terms) for a, b, t in zip(indptr[:-1], indptr[1:], total, strict=True)])
        empty = np.array([shares(np.zeros(1, np.int64), t, terms)[0] for t in total])
        value = between_rows(indptr, column, p, empty, len(known))
    x, y = np.nonzero(~np.eye(n, dtype=bool))
    return pd.DataFrame({"lang": groups["lang"].iloc[0], "source": names[x], "item": names[y], "value": value[x, y]})


def audit(docs: DataFrame, *, least: int = 10, top: int = 10) -> DataFrame:
    """lang, source, part, item, value, rank: `pair`, the divergence from each other source of the language; `term`, the ``top`` terms that a source has more of than its language."""
    scratch = Scratch(docs.sparkSession, "divergence")
    read = docs.select(*[F.col(c).cast("string").alias(c) for c in ("text", "lang", "source")])
    counted = read.mapInArrow(_counted, "lang string, source string, term string, count long, docs long")
    counts = scratch.write(counted.groupBy("lang", "source", "term").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs")))
    kept = counts.where("term is not null").groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("count").alias("all")).where(F.col("docs") >= least).drop("docs")
    entries = scratch.write(counts.drop("docs").join(kept, ["lang", "term"]))
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("all").alias("lang_total"))
    own = entries.groupBy("lang", "source").agg(F.sum("count").alias("total"))
    groups = counts.where("term is null").select("lang", "source").join(own, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["total", "terms", "lang_total"])
    groups = scratch.write(groups)

    blocks = max(-(-entries.count() // ENTRIES), 1)
    dealt = entries.select("lang", "source", "term", "count", F.pmod(F.xxhash64("term"), F.lit(blocks)).alias("block"))
    everywhere = groups.select("lang", "source", "total", "terms", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"))
    sums = dealt.groupBy("lang", "block").cogroup(everywhere.groupBy("lang", "block")).applyInPandas(_block, "lang string, source string, item string, value long")
    pairs = sums.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    nth = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", nth.alias("rank"))

    wide = entries.join(groups, ["lang", "source"])
    share = lambda count, total: F.expr(f"1 + cast(1000000000 as decimal(10,0)) * cast({count} + 2 as decimal(19,0)) div cast({total} + 2 * terms as decimal(20,0))")
    wide = wide.select("lang", "source", F.col("term").alias("item"), share("count", "total").alias("p"), share("all", "lang_total").alias("q")).where("p > q")
    wide = wide.select("lang", "source", "item", F.expr("(p - q) * (p - q) div (p + q)").alias("value"))
    terms = wide.withColumn("rank", nth).where(F.col("rank") <= top).select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")
    return pairs.unionByName(terms)
