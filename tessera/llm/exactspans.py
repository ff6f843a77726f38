"""Removal of repeated byte strings of ``LENGTH`` bytes, found by sorting suffixes column by column.

A byte goes if it is covered by a string of LENGTH bytes that also starts earlier, in a document with a smaller id or before it
in the same document.

1. Each string has one anchor: its leftmost K-byte substring of least hash. Equal strings have equal anchors at the same place,
   so only strings around anchors that occur twice can repeat. Anchors are counted by one shuffle of their hashes.
2. The strings of an anchor's occurrence make up a context of at most 2 LENGTH - K bytes. Equal contexts are one, with their
   first place; later places of a context go as a whole.
3. The distinct contexts of a task, aligned at their anchors, are a collection of short documents. Column-wise construction:
   from the last column to the first, one symbol of each context is inserted. The symbols that stand before the suffixes sorted so far
   are the collection's Burrows-Wheeler column; a stable counting sort by them gives the order of the longer suffixes, and the
   common prefix of two that are neighbours now is one more than the least common prefix between their places in the round before. Runs of
   neighbours whose common prefixes reach LENGTH are the repeated strings; of each run, the earliest stays.
4. Ranges of each document are joined with its text, which loses them.

What differs from a construction over whole documents: that takes as many rounds as the longest text has bytes, and each of them
reads and writes the transform and the common prefixes of all documents as external files. Here the collection is first cut down to contexts of
at most 180 columns, and dealt by anchors, so that the state of a round (one order and one list of common prefixes, for ``HELD`` contexts or
those of one anchor) is held in memory; the sequential files are the written tables before and after. The README has figures.

Scale: texts travel once, hashes of about one in 41 positions once, and only contexts of anchors that repeat. An anchor's places are
counted before they are joined, so that a very common one isn't gathered; nor is one with over ``CROWDED`` distinct contexts, whose
strings are compared by a shuffle on themselves.

Nulls: a null text is empty. A null id has the place of the smallest long. Rows of equal id are ordered by a hash of their text; rows that
are equal in both are one document, and have the same result. Texts under LENGTH bytes stay. An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._bytes import leftmost_minima, pieces, prefix_sums, ranges
from tessera.llm._common import Scratch, attached, parts

LENGTH, K, CROWDED, HELD = 100, 20, 20_000, 20_000
SPREAD = LENGTH - K  #: most bytes of a string before or after its anchor
FIRST_ID = -(1 << 63)


def anchored(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(hash, text, position in the text, first and last string that has it as its anchor, part's bytes from the first to the last string's end as (start, end) in ...)."""
    for data, start, of, off in pieces(texts, LENGTH - 1):
        if len(data) < LENGTH:
            continue
        sums = prefix_sums(data)
        at = np.arange(len(data) - K + 1)
        h = ranges(sums, at, at + K)
        anchor = leftmost_minima(h, SPREAD + 1)
        part = np.repeat(np.arange(len(of)), np.diff(start))[: len(anchor)]
        p = np.flatnonzero(np.arange(len(anchor)) + LENGTH <= start[part + 1])
        if not len(p):
            continue
        new = np.flatnonzero(np.diff(anchor[p], prepend=-1) != 0)
        new = np.union1d(new, np.flatnonzero(np.diff(part[p], prepend=-1) != 0))
        last = np.append(new[1:], len(p)) - 1
        lo, hi, a = p[new], p[last], anchor[p[new]]
        yield h[a].view(np.int64), part[lo], of, (off - start[:-1])[part[lo]], np.stack([lo, hi, a]), data


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(FIRST_ID)).alias("d"), F.xxhash64(text).alias("k"), text.alias("t"), F.col(id_col).cast("long").alias("id"))


def _anchor_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        d, k = b.column(0).to_numpy(), b.column(1).to_numpy()
        for h, part, of, _, _, _ in anchored(b.column(2)):
            text = of[part]
            yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(d[text]), pa.array(k[text])], names=["h", "d", "k"])


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (d, k, t, hs) to the contexts of those anchors whose hashes are in hs: a row for each place (x is null), and, with
    their bytes and their first places so far, the distinct ones of up to ``HELD`` at a time."""
    kept: dict[bytes, tuple[int, int, bytes, tuple[int, int, int]]] = {}
    names, kinds = ["h", "c", "a", "x", "d", "k", "lo", "n"], [pa.int64(), pa.binary(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int32()]

    def distinct() -> pa.RecordBatch:
        rows = [(h, c, a, x, *first, len(x)) for c, (h, a, x, first) in kept.items()]
        kept.clear()
        return pa.RecordBatch.from_arrays([pa.array(col, kind) for col, kind in zip(zip(*rows, strict=True) if rows else [()] * 8, kinds, strict=True)], names=names)

    for b in batches:
        d, k, wanted = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(3)
        sets: dict[int, np.ndarray] = {}
        for h, part, of, shift, (lo, hi, a), data in anchored(b.column(2)):
            text = of[part]
            keep = np.zeros(len(h), dtype=bool)
            edge = np.flatnonzero(np.diff(text, prepend=-1, append=-1))
            for x, y in zip(edge[:-1], edge[1:], strict=True):
                i = int(text[x])
                if i not in sets:
                    sets.clear()
                    sets[i] = np.sort(wanted[i].values.to_numpy())
                at = np.searchsorted(sets[i], h[x:y])
                keep[x:y] = sets[i][np.minimum(at, len(sets[i]) - 1)] == h[x:y]
            raw = data.tobytes()
            for s in range(0, len(keep), 4096):
                j = s + np.flatnonzero(keep[s : s + 4096])
                if not len(j):
                    continue
                ctx = [raw[x : y + LENGTH] for x, y in zip(lo[j].tolist(), hi[j].tolist(), strict=True)]
                before = (a - lo)[j].astype(np.int32)
                key = [hashlib.md5(bytes([n]) + c).digest() for n, c in zip(before.tolist(), ctx, strict=True)]
                places = [d[text[j]], k[text[j]], (lo + shift)[j]]
                for hh, cc, aa, xx, *at in zip(h[j].tolist(), key, before.tolist(), ctx, *(v.tolist() for v in places), strict=True):
                    if cc not in kept or tuple(at) < kept[cc][3]:
                        kept[cc] = (hh, aa, xx, tuple(at))
                nulls = pa.nulls(len(j), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(h[j]), pa.array(key, pa.binary()), pa.array(before), nulls, *(pa.array(v) for v in places), pa.array((hi - lo)[j] + LENGTH, pa.int32())], names=names)
                if len(kept) >= HELD:
                    yield distinct()
    yield distinct()


def inserted(symbols: np.ndarray, order: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One round: the order of the suffixes that are longer by ``symbols``, and the common prefixes of neighbours."""
    n = len(order)
    before = symbols[order]  # the Burrows-Wheeler column
    place = np.argsort(before, kind="stable")
    least = [common]  # least[k][i]: the least of 2^k common prefixes from i on
    while 2 << (len(least) - 1) <= n:
        step = 1 << (len(least) - 1)
        least.append(np.minimum(least[-1][:-step], least[-1][step:]))
    x, y = place[:-1] + 1, place[1:]
    now = np.zeros(n, dtype=np.int16)
    same = np.flatnonzero((before[place[1:]] == before[place[:-1]]) & (before[place[1:]] > 0))
    x, y = x[same], y[same]  # the least of common[x .. y]
    level = np.frexp((y - x + 1).astype(np.float64))[1] - 1
    found = np.empty(len(same), dtype=np.int16)
    for k in np.unique(level):
        at = np.flatnonzero(level == k)
        found[at] = np.minimum(least[k][x[at]], least[k][y[at] - (1 << k) + 1])
    now[same + 1] = np.minimum(found + 1, LENGTH)
    return order[place], now


def repeated(contexts: list[bytes], before: np.ndarray, rank: np.ndarray) -> list[list[tuple[int, int]]]:
    """For each context, the ranges of its bytes that strings cover which occur in a context of smaller rank. before: bytes ahead of the anchor."""
    n, width = len(contexts), 2 * SPREAD + K
    columns = np.zeros((width, n), dtype=np.uint16)  # symbols are bytes plus one; 0 is none, and is like nothing
    length = np.array([len(c) for c in contexts])
    start = SPREAD - before
    flat = np.frombuffer(b"".join(contexts), dtype=np.uint8)
    row = np.repeat(np.arange(n), length)
    columns[np.arange(len(flat)) - np.repeat(np.cumsum(length) - length, length) + start[row], row] = flat.astype(np.uint16) + 1
    order, common = np.arange(n), np.zeros(n, dtype=np.int16)  # common[i]: the common prefix, up to LENGTH, of the suffixes at i - 1 and i
    goes = np.zeros((SPREAD + 1, n), dtype=bool)
    for c in range(width - 1, -1, -1):  # insert column c
        order, common = inserted(columns[c], order, common)
        if c <= SPREAD:
            runs = np.flatnonzero(common < LENGTH)
            if len(runs) < n:
                least = np.repeat(np.minimum.reduceat(rank[order], runs), np.diff(np.append(runs, n)))
                goes[c, order] = rank[order] > least
    out: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    edges = np.diff(np.pad(goes.astype(np.int8), ((1, 1), (0, 0))), axis=0)
    starts, ends = np.nonzero(edges.T == 1), np.nonzero(edges.T == -1)
    for i, x, y in zip(starts[0].tolist(), starts[1].tolist(), ends[1].tolist(), strict=True):
        out[i].append((x - int(start[i]), y - 1 + LENGTH - int(start[i])))
    return out


RANGES = "array<struct<s: int, e: int>>"


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contexts (h, c, a, x, d, k, lo), sorted by h, c and place, to (c, fd, fk, flo, ranges); the first row of each context is the one."""
    held: list[pa.RecordBatch] = []
    last = b""

    def done(t: pa.Table) -> pa.RecordBatch:
        d, k, lo, a = (t.column(n).to_numpy() for n in ("d", "k", "lo", "a"))
        rank = np.empty(len(d), dtype=np.int64)
        rank[np.lexsort((lo + a, k, d))] = np.arange(len(d))
        found = repeated(t.column("x").to_pylist(), a.astype(np.int64), rank) if len(d) else []
        kind = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))
        values = pa.array([[{"s": s, "e": e} for s, e in r] for r in found], kind)
        cols = [t.column(n).combine_chunks() if isinstance(t.column(n), pa.ChunkedArray) else t.column(n) for n in ("c", "d", "k", "lo")]
        return pa.RecordBatch.from_arrays([*(x.chunk(0) if isinstance(x, pa.ChunkedArray) else x for x in cols), values], names=["c", "fd", "fk", "flo", "ranges"])

    rows = 0
    for b in batches:
        keys = b.column("c").to_pylist()
        b = b.filter(pa.array([x != y for x, y in zip([last, *keys[:-1]], keys, strict=True)], pa.bool_()))
        last = keys[-1] if keys else last
        held.append(b)
        rows += b.num_rows
        if rows >= HELD:
            t = pa.Table.from_batches(held)
            h = t.column("h").to_numpy()  # sorted
            cut = int(np.searchsorted(h, h[-1]))  # the last anchor may go on
            if cut:
                yield done(t.slice(0, cut))
                t = t.slice(cut).combine_chunks()
            held, rows = t.to_batches(), t.num_rows
    if rows:
        yield done(pa.Table.from_batches(held))


def _strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for d, t, r in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), strict=True):
            data = t.as_buffer().to_pybytes()
            spans: list[list[int]] = []
            for x in sorted((x["s"], x["e"]) for x in r or ()):
                if spans and x[0] <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], x[1])
                else:
                    spans.append([*x])
            kept, at = hashlib.sha256(), 0
            for s, e in spans:
                kept.update(data[at:s])
                at = e
            kept.update(data[at:])
            out.append((d, len(data), sum(e - s for s, e in spans), len(spans), kept.hexdigest(), [{"s": s, "e": e} for s, e in spans]))
        cols = [*zip(*out, strict=True)] if out else [()] * 6
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])


def _crowded(distinct: DataFrame) -> DataFrame:
    """The same as ``_compare`` for anchors of very many contexts: each string of theirs is a row, and the earliest of equal ones stays."""
    one = distinct.groupBy("c").agg(F.min(F.struct("d", "k", "lo", "x")).alias("f")).select("c", "f.*")
    many = one.withColumn("o", F.explode(F.sequence(F.lit(0), F.octet_length("x") - LENGTH)))
    at = F.struct("d", "k", (F.col("lo") + F.col("o")).alias("p"))
    many = many.select("c", "d", "k", "lo", "o", at.alias("at"), F.expr(f"substring(x, o + 1, {LENGTH})").alias("w"))
    least = many.groupBy("w").agg(F.min("at").alias("least")).withColumnRenamed("w", "lw")
    many = many.join(least, F.col("w") == F.col("lw")).withColumn("later", F.col("at") > F.col("least"))
    covered = F.when(F.col("later"), F.struct(F.col("o").alias("s"), (F.col("o") + LENGTH).alias("e")))
    many = many.groupBy("c", "d", "k", "lo").agg(F.collect_list(covered).cast(RANGES).alias("ranges"))
    return many.select("c", F.col("d").alias("fd"), F.col("k").alias("fk"), F.col("lo").alias("flo"), "ranges")


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (removed ranges of bytes)."""
    rows = _rows(docs, id_col, text_col)
    scratch = Scratch(docs.sparkSession, "spans")
    hashes = scratch.write(rows.select("d", "k", "t").mapInArrow(_anchor_hashes, "h long, d long, k long"))
    counts = scratch.write(hashes.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    twice = attached(hashes, counts, "h", hashes.count())
    wanted = twice.groupBy("d", "k").agg(F.collect_set("h").alias("hs")).select(F.col("d").alias("wd"), F.col("k").alias("wk"), "hs")
    contexts = rows.join(wanted, (F.col("d") == F.col("wd")) & (F.col("k") == F.col("wk"))).select("d", "k", "t", "hs")
    contexts = scratch.write(contexts.mapInArrow(_contexts, "h long, c binary, a int, x binary, d long, k long, lo long, n int"))
    scratch.drop(hashes)
    scratch.drop(counts)
    distinct = contexts.where("x is not null").drop("n")
    crowd = scratch.write(distinct.select("h", "c").distinct().groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > CROWDED).select(F.col("h").alias("ch")))
    tasks = parts(docs.sparkSession)
    first = "c binary, fd long, fk long, flo long, ranges " + RANGES
    few = distinct.join(crowd, F.col("h") == F.col("ch"), "left_anti").repartition(tasks, "h").sortWithinPartitions("h", "c", "d", "k", "lo")
    few = scratch.write(few.select("h", "c", "a", "x", "d", "k", "lo").mapInArrow(_compare, first))
    many = scratch.write(_crowded(distinct.join(crowd, F.col("h") == F.col("ch"), "left_semi")))
    found = few.unionByName(many).withColumnRenamed("c", "fc")
    own = (F.col("d") == F.col("fd")) & (F.col("k") == F.col("fk")) & (F.col("lo") == F.col("flo"))
    whole = F.array(F.struct(F.lit(0).alias("s"), F.col("n").alias("e")))
    places = contexts.where("x is null").select("c", "d", "k", "lo", "n")
    places = places.join(found, F.col("c") == F.col("fc")).withColumn("r", F.when(own, F.col("ranges")).otherwise(whole)).where(F.size("r") > 0)
    places = places.select("d", "k", F.transform("r", lambda x: F.struct((x["s"] + F.col("lo")).alias("s"), (x["e"] + F.col("lo")).alias("e"))).alias("r"))
    spans = scratch.write(places.groupBy("d", "k").agg(F.flatten(F.collect_list("r")).alias("r")).select(F.col("d").alias("sd"), F.col("k").alias("sk"), "r"))
    for used in (contexts, crowd, few, many):
        scratch.drop(used)
    out = rows.join(spans, (F.col("d") == F.col("sd")) & (F.col("k") == F.col("sk")), "left").select("id", "t", "r")
    return out.mapInArrow(_strip, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<s: long, e: long>>")
