"""SimHash near-duplicates by anchor-point covering.

A fingerprint has 64 bits: bit j is 1 if it is set in over half of the XXH64 values (seed 42) of the text's word shingles.
Two fingerprints link at ``bits`` or fewer differing bits.

Anchors: a fingerprint is cut into two halves of 32 bits. If two fingerprints differ in at most ``bits`` bits, then in one of
the halves they differ in at most t = bits // 2. The anchors of a half are the words of a covering code: the direct sum of
the binary Golay code (23 bits, covering radius 3), the Hamming code (7 bits, radius 1) and 2 free bits (radius 0). A half is
replicated to every anchor within, in each part, the covering radius, plus (t + 1) // 2 in all. That is enough: take the
point midway between two halves; it is at most (t + 1) // 2 from both, and its nearest anchor is within the covering radius of
it, hence near both. So no link is lost, and replication is about 20 rows a fingerprint at 4 bits, in place of the far more
that the whole threshold on one side would take. Fingerprints at the same anchor are then compared; each anchor yields the
links of a spanning forest and not all pairs.

Scale: equal fingerprints are one, so copies cost one fingerprint. A row at an anchor is 16 bytes. An anchor with over
``CHUNK`` fingerprints is cut into chunks, and each pair of chunks is compared on its own. Components are found by joins.
The number of comparisons grows with the square of the number of distinct fingerprints, divided by about 2600.

Nulls: a null text is an empty one. Texts without words have the fingerprint 0, which links like any other. Rows with a null
id get a fingerprint and the component of their fingerprint, and never name a component; a component that only holds null
ids is null. Repeated rows have the same result. Of equal ids none comes first, as all have one result. A text is held as a whole in one task, as its words' hashes. An empty table gives an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import cache
from itertools import combinations, product, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm._bytes import mixed
from tessera.llm._common import Scratch, attached, parts
from tessera.llm.components import Forest, components, local

#: Fingerprints of one anchor that are compared in one piece, at most.
CHUNK = 4096
SEED = 42


def fingerprint(text: bytes, width: int) -> int:
    h = shingle_hashes(text, width)
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > len(h)).view(np.uint64)[0])


def fingerprints(docs: DataFrame, width: int = 4, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp: the fingerprint's bits as a long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [fingerprint(b.column(1)[i].as_py() or b"", width) for i in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.array(fps, dtype=np.uint64).view(np.int64))], names=["doc_id", "fp"])

    chosen = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("_t"))
    return chosen.mapInArrow(run, f"doc_id {dict(chosen.dtypes)['doc_id']}, fp long")


@cache
def _errors(kind: str, most: int) -> tuple[np.ndarray, list[list[tuple[int, int]]]]:
    """For a part of the code: the syndrome of each bit, and for each syndrome the error patterns (pattern, weight) of weight up to ``most``."""
    if kind == "golay":  # the cyclic code of length 23 with generator x^11 + x^9 + x^7 + x^6 + x^5 + x + 1
        n, checks, columns = 23, 11, []
        for i in range(n):
            r = 1 << i
            for k in range(n - 1, checks - 1, -1):
                if r >> k & 1:
                    r ^= 0b101011100011 << (k - checks)
            columns.append(r)
    else:  # the Hamming code: the syndromes of single errors are all that aren't zero
        n, checks = 7, 3
        columns = list(range(1, 8))
    table: list[list[tuple[int, int]]] = [[] for _ in range(1 << checks)]
    for weight in range(most + 1):
        for at in combinations(range(n), weight):
            s = 0
            for i in at:
                s ^= columns[i]
            table[s].append((sum(1 << i for i in at), weight))
    return np.array(columns), table


@cache
def _moves(extra: int) -> list[np.ndarray]:
    """For each syndrome of a half (Golay: 11 bits, Hamming: 3 bits), what to xor the half with to get its anchors: all that are
    within the covering radius in each part, plus ``extra`` in all."""
    _, golay = _errors("golay", 3 + extra)
    _, hamming = _errors("hamming", 1 + extra)
    free = [(p, bin(p).count("1")) for p in range(4)]
    out = []
    for g, h in product(golay, hamming):
        out.append(np.array([p | q << 23 | r << 30 for p, x in g for q, y in h for r, z in free if max(0, x - 3) + max(0, y - 1) + z <= extra], dtype=np.uint64))
    return out


def anchors(half: np.ndarray, extra: int) -> tuple[np.ndarray, np.ndarray]:
    """For an array of 32-bit halves: (positions, anchors), a pair for each replica."""
    s = np.zeros(len(half), dtype=np.int64)
    for kind, shift, scale in (("golay", 0, 8), ("hamming", 23, 1)):
        for i, c in enumerate(_errors(kind, 0)[0]):
            s ^= (half >> np.uint64(shift + i) & np.uint64(1)).astype(np.int64) * int(c) * scale
    moves = _moves(extra)
    count = np.array([len(m) for m in moves])
    start = np.concatenate([[0], np.cumsum(count)[:-1]])
    flat = np.concatenate(moves)
    at = np.repeat(np.arange(len(half)), count[s])
    nth = np.arange(len(at)) - np.repeat(np.cumsum(count[s]) - count[s], count[s])
    return at, half[at] ^ flat[start[s][at] + nth]


def links_of_sorted(key: np.ndarray, fp: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning forest among fingerprints of equal key; rows are sorted by key."""
    a: list[np.ndarray] = []
    b: list[np.ndarray] = []
    live, shift, held = np.arange(len(key)), 0, 0

    def forest() -> tuple[np.ndarray, np.ndarray]:
        label = local(len(key), np.concatenate([np.zeros(0, int), *a]), np.concatenate([np.zeros(0, int), *b]))
        member = np.flatnonzero(label != np.arange(len(key)))
        return label[member], member

    while len(live):
        shift += 1
        live = live[: np.searchsorted(live, len(key) - shift)]
        live = live[key[live] == key[live + shift]]
        hit = live[np.bitwise_count(fp[live] ^ fp[live + shift]) <= bits]
        if len(hit):
            a.append(hit)
            b.append(hit + shift)
            held += len(hit)
        if held > 1 << 20:
            x, y = forest()
            a[:], b[:], held = [x], [y], 0
    return forest()


def _compared(placed: DataFrame, link: Callable[..., tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """(a, b): distinct links, a < b, that hold together what those among the rows of each anchor do. ``placed``: anchor, then the node's id and further columns,
    all long; ``link`` gets sorted anchors and those columns, and returns positions. Two nodes meet at many anchors, and at each one may link to others: a task
    hands on a spanning forest over the links of all its anchors, by smallest ids, so that tasks that see the same group hand on the same links."""
    names = placed.columns[1:]
    node = names[0]
    crowded = placed.groupBy("anchor").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > CHUNK).withColumnRenamed("anchor", "_a")
    n = F.coalesce(F.ceil(F.col("_n") / CHUNK), F.lit(1)).cast("int")
    own = F.pmod(F.xxhash64(node), n).cast("int")
    placed = placed.join(crowded, F.col("anchor") == F.col("_a"), "left").withColumn("_other", F.explode(F.sequence(F.lit(0), n - 1)))
    key = F.when(F.col("_a").isNull(), F.xxhash64("anchor")).otherwise(F.xxhash64("anchor", F.least(own, "_other"), F.greatest(own, "_other")))
    placed = placed.select(key.alias("key"), *names).repartition(parts(placed.sparkSession), "key").sortWithinPartitions("key")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64)] * (len(names) + 1)
        forest = Forest()

        def done(cols: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            a, b = link(cols[0], *(c.view(np.uint64) for c in cols[1:]))
            return forest.add(cols[1][a], cols[1][b])

        def batch_of(links: tuple[np.ndarray, np.ndarray]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x) for x in links], names=["a", "b"])

        for batch in batches:
            held = [np.concatenate([x, batch.column(i).to_numpy()]) for i, x in enumerate(held)]
            cut = int(np.searchsorted(held[0], held[0][-1])) if len(held[0]) else 0  # the last key may go on in the next batch
            if cut >= 1 << 15:
                yield from map(batch_of, done([x[:cut] for x in held]))
                held = [x[cut:] for x in held]
        yield from map(batch_of, done(held))
        yield from map(batch_of, forest.rest())

    return placed.mapInArrow(compare, "a long, b long").distinct()


def candidate_links(fps: DataFrame, bits: int) -> DataFrame:
    """(a, b): links between fingerprints of ``fps`` (fp: long, distinct) at ``bits`` or fewer differing bits; a spanning forest for each anchor."""
    extra = (bits // 2 + 1) // 2

    def replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy().view(np.uint64)
            for i in range(0, len(fp), 1 << 14):
                x = fp[i : i + (1 << 14)]
                for side in (0, 1):
                    at, anchor = anchors(x >> np.uint64(32 * side) & np.uint64(0xFFFFFFFF), extra)
                    yield pa.RecordBatch.from_arrays([pa.array((anchor | np.uint64(side << 32)).view(np.int64)), pa.array(x[at].view(np.int64))], names=["anchor", "fp"])

    return _compared(fps.mapInArrow(replicate, "anchor long, fp long"), lambda key, fp: links_of_sorted(key, fp, bits))


def near_duplicates(docs: DataFrame, *, width: int = 4, bits: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row: doc_id, fp (long), root (a fingerprint that names the component), component_id: the smallest id among the rows that links reach."""
    scratch = Scratch(docs.sparkSession, "simhash")
    rows = scratch.write(fingerprints(docs, width, id_col=id_col, text_col=text_col))
    distinct = scratch.write(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(candidate_links(distinct.select("fp"), bits))
    of = distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    names = of.groupBy("root").agg(F.min("least").alias("component_id")).withColumnRenamed("root", "_r")
    of = of.join(names, F.col("root") == F.col("_r")).select(F.col("fp").alias("_f"), "root", "component_id")
    return rows.join(of, F.col("fp") == F.col("_f")).select("doc_id", "fp", "root", "component_id")


# Near copies by the similarity of their shingle sets


WIDE, VIEWS, WIDE_BITS = 4, 11, 64
#: Sets of up to this many shingles are found by their shingles, and their fingerprints may differ in ``SHORT_BITS``; sets that are verified in one piece.
SHORT, SHORT_BITS, SETS, LEADERS = 24, 96, 256, 3
WIDE_COLUMNS = [f"f{i}" for i in range(WIDE)]


def shingle_hashes(text: bytes, width: int) -> np.ndarray:
    """XXH64 values of the word shingles, repeats included; under ``width`` words, of the whole sequence; none without words."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    shingles = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False)) if len(words) >= width else [b" ".join(words)]
    return np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), dtype=np.uint64)


def wide_fingerprint(h: np.ndarray) -> np.ndarray:
    """WIDE words of majority bits over the distinct shingles' hashes; each word by another mixing of them."""
    out = np.zeros(WIDE, dtype=np.uint64)
    for w in range(WIDE if len(h) else 0):
        m = mixed(h + np.uint64(0x9E3779B97F4A7C15 * w % (1 << 64)))
        ones = np.zeros(64, dtype=np.int64)
        for i in range(0, len(m), 1 << 16):
            ones += np.unpackbits(m[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int32)
        out[w] = np.packbits(2 * ones > len(m)).view(np.uint64)[0]
    return out


def wide_forest(key: np.ndarray, most: np.ndarray, words: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning forest among fingerprints of equal key (sorted) that differ in ``most`` bits or fewer."""
    a, b, held = [np.zeros(0, int)], [np.zeros(0, int)], 0

    def forest() -> tuple[np.ndarray, np.ndarray]:
        label = local(len(key), np.concatenate(a), np.concatenate(b))
        member = np.flatnonzero(label != np.arange(len(key)))
        return label[member], member

    live, shift = np.arange(len(key)), 0
    while len(live):
        shift += 1
        live = live[: np.searchsorted(live, len(key) - shift)]
        live = live[key[live] == key[live + shift]]
        near = live[sum(np.bitwise_count(w[live] ^ w[live + shift]).astype(np.int64) for w in words) <= most[live]]
        a.append(near)
        b.append(near + shift)
        held += len(near)
        if held > 1 << 20:
            x, y = forest()
            a[:], b[:], held = [x], [y], 0
    return forest()


def similar(sets: list[np.ndarray], similarity: float, first: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning forest among sets of hashes with a Jaccard similarity of ``similarity`` or more; each set, or each of the ``first`` ones, is compared with all others."""
    size = np.array([len(x) for x in sets])
    flat, start = np.unique(np.concatenate(sets), return_inverse=True)[1], np.cumsum(size) - size
    seen = np.zeros(len(flat) + 1, dtype=np.int64)
    label = np.arange(len(sets))
    for i in range(len(sets) if first is None else first):
        own = flat[start[i] : start[i] + size[i]]
        seen[own] = 1
        both = np.add.reduceat(seen[flat], start)
        seen[own] = 0
        for old in np.unique(label[both >= similarity * (size + size[i] - both)]):
            if old != label[i]:
                low, high = min(old, label[i]), max(old, label[i])
                label[label == high] = low
    member = np.flatnonzero(label != np.arange(len(sets)))
    return label[member], member


def near_copies(docs: DataFrame, *, width: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row: doc_id, node (equal for equal fingerprints), root (names the component).

    Links are pairs whose sets of word shingles have a Jaccard similarity of ``similarity`` or more. Candidates come from anchors: at 0.8 two fingerprints
    of 256 bits differ in 39 bits on average, with a deviation of 6; ``WIDE_BITS`` are allowed, 4 deviations more. Anchors are the words of
    the Golay code on each of ``VIEWS`` blocks of 23 bits, and a fingerprint is at all anchors within the covering radius plus one. Two
    that differ in a block by two bits or fewer share an anchor in it, others often. Sets of up to ``SHORT`` shingles deviate more, and those
    that they can be like are besides at anchors of their own, the least of their hashes, of which two sets that are alike share one. Each
    anchor yields the links of a spanning forest. What candidates link makes up a group. In a group of up to ``SETS`` sets every two are compared. In a larger one all are
    compared with ``LEADERS`` of them; those that are like the one with most links are its star, and need no comparison with each other. The rest, few in a family of one
    template, is compared with all, in pieces of ``SETS``. So a link is never judged by its fingerprints, nor left out for another that fails, but between two that hang together already.

    Nulls: null texts are empty ones; texts without words are one group. Equal ids are told apart by their texts; rows with a null id take part. An
    empty table gives an empty table."""
    scratch = Scratch(docs.sparkSession, "copies")
    id_type = docs.select(F.col(id_col)).schema[0].dataType.simpleString()
    most_short = int(SHORT / similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [np.unique(shingle_hashes(b.column(1)[i].as_py() or b"", width)) for i in range(b.num_rows)]
            f = np.array([wide_fingerprint(h) for h in sets], dtype=np.uint64).reshape(-1, WIDE).view(np.int64)
            # two sets that are alike share one of this many of their least hashes
            first = [h[: len(h) - math.ceil(similarity * len(h) - 1e-9) + 1].view(np.int64) if len(h) <= most_short else h[:0] for h in sets]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(f[:, i]) for i in range(WIDE)), pa.array(first, pa.list_(pa.int64())), b.column(2)], names=["doc_id", *WIDE_COLUMNS, "first", "th"])

    chosen = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("_t"), F.xxhash64(F.col(text_col).cast("binary")).alias("th"))
    rows = chosen.mapInArrow(run, f"doc_id {id_type}, " + ", ".join(f"{c} long" for c in WIDE_COLUMNS) + ", first array<long>, th long")
    rows = scratch.write(rows.withColumn("node", F.xxhash64(*WIDE_COLUMNS, "first")))
    nodes = scratch.write(rows.groupBy("node", *WIDE_COLUMNS, "first").agg(F.min(F.struct("doc_id", "th")).alias("of")))

    def replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns, patterns = _errors("golay", 4)
        moves = [np.array([p for p, _ in m], dtype=np.uint64) for m in patterns]
        count = np.array([len(m) for m in moves])
        start, flat = np.cumsum(count) - count, np.concatenate(moves)
        names = ["anchor", "node", "most", *WIDE_COLUMNS]
        for batch in batches:
            first = batch.column(WIDE + 1)
            at = np.repeat(np.arange(batch.num_rows), pc.list_value_length(first).to_numpy())
            cols = [batch.column(j).to_numpy()[at] for j in range(WIDE + 1)]
            short = mixed(first.flatten().to_numpy().view(np.uint64)) | np.uint64(1 << 63)  # apart from those of the views
            yield pa.RecordBatch.from_arrays([pa.array(short.view(np.int64)), pa.array(cols[0]), pa.array(np.full(len(at), SHORT_BITS)), *(pa.array(x) for x in cols[1:])], names=names)
            for i in range(0, batch.num_rows, 1 << 13):
                part = [batch.column(j).to_numpy()[i : i + (1 << 13)] for j in range(WIDE + 1)]
                f = [x.view(np.uint64) for x in part[1:]]
                for view in range(VIEWS):
                    word, bit = divmod(23 * view, 64)
                    block = f[word] >> np.uint64(bit)
                    if bit > 41:
                        block = block | f[word + 1] << np.uint64(64 - bit)
                    block = block & np.uint64((1 << 23) - 1)
                    s = np.zeros(len(block), dtype=np.int64)
                    for j, c in enumerate(columns):
                        s ^= (block >> np.uint64(j) & np.uint64(1)).astype(np.int64) * int(c)
                    at = np.repeat(np.arange(len(block)), count[s])
                    nth = np.arange(len(at)) - np.repeat(np.cumsum(count[s]) - count[s], count[s])
                    anchor = (block[at] ^ flat[start[s][at] + nth] | np.uint64(view << 23)).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(part[0][at]), pa.array(np.full(len(at), WIDE_BITS)), *(pa.array(x[at]) for x in part[1:])], names=names)

    placed = nodes.select("node", *WIDE_COLUMNS, "first").mapInArrow(replicate, "anchor long, node long, most long, " + ", ".join(f"{c} long" for c in WIDE_COLUMNS))
    links = _compared(placed, lambda key, node, most, *words: wide_forest(key, most.view(np.int64), list(words)))
    groups = scratch.write(components(links))
    groups = groups.unionByName(groups.select(F.col("root").alias("node"), "root").distinct())
    counts = groups.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / SETS).cast("int").alias("pieces"))
    members = groups.join(counts, "root").join(nodes.select("node", F.col("of.doc_id").alias("_d"), F.col("of.th").alias("_th")), "node")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array([np.unique(shingle_hashes(t.as_py() or b"", width)).tobytes() for t in b.column(3)], pa.binary())], names=["node", "root", "pieces", "hs"])

    held = chosen.join(members, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("th") == F.col("_th"))).select("node", "root", "pieces", "_t").mapInArrow(sets, "node long, root long, pieces int, hs binary").dropDuplicates(["node"])
    held = scratch.write(held)
    large = held.where("pieces > 1")

    def like_leaders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            like = []
            for node, h, names, others in zip(b.column(0).to_pylist(), b.column(2), b.column(3).to_pylist(), b.column(4), strict=True):
                own = np.frombuffer(h.as_py(), dtype=np.uint64)
                found = []
                for name, o in zip(names, others, strict=True):
                    other = np.frombuffer(o.as_py(), dtype=np.uint64)
                    both = len(np.intersect1d(own, other, assume_unique=True))
                    if name == node or both and both >= similarity * (len(own) + len(other) - both):
                        found.append(name)
                like.append(found)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(like, pa.list_(pa.int64()))], names=["node", "root", "like"])

    total = nodes.count()
    nth = F.row_number().over(Window.partitionBy("root").orderBy("node"))
    leaders = large.withColumn("nth", nth).where(F.col("nth") <= LEADERS).groupBy("root").agg(F.sort_array(F.collect_list(F.struct("nth", "node", "hs"))).alias("x"), F.max("pieces").alias("p"))
    leaders = scratch.write(leaders.select("root", F.transform("x", lambda x: x["node"]).alias("leaders"), F.transform("x", lambda x: x["hs"]).alias("sets"), (F.col("p") * SETS).cast("long").alias("n")))
    liked = scratch.write(attached(large.select("root", "node", "hs"), leaders, "root", total).select("node", "root", "hs", "leaders", "sets").mapInArrow(like_leaders, "node long, root long, like array<long>"))
    votes = liked.select("root", F.explode("like").alias("leader")).groupBy("root", "leader").count()
    best = votes.groupBy("root").agg(F.max_by("leader", F.struct("count", "leader")).alias("leader"))
    counted = liked.join(best, "root").select("root", "node", (~F.array_contains("like", F.col("leader"))).alias("rest"))
    sizes = counted.groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.ceil(F.count_if("rest") / SETS).cast("int").alias("some"), F.ceil(F.count(F.lit(1)) / SETS).cast("int").alias("all")).where("some > 0")
    told = scratch.write(counted.select("node", "rest"))
    sizes = scratch.write(sizes)
    spread = attached(large.join(told, "node").select("root", "node", "hs", "rest"), sizes, "root", total)
    piece = lambda c: F.pmod(F.xxhash64("node"), F.col(c))
    pieces = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c).cast("long") - 1))
    asking = spread.where("rest").withColumn("y", pieces("all")).select(F.xxhash64("root", piece("some"), "y").alias("key"), "node", "hs", F.lit(0).alias("side"))
    asked = spread.withColumn("x", pieces("some")).select(F.xxhash64("root", "x", piece("all")).alias("key"), "node", "hs", F.lit(1).alias("side"))
    whole = held.where("pieces = 1").select(F.xxhash64("root").alias("key"), "node", "hs", F.lit(2).alias("side"))
    dealt = whole.unionByName(asking).unionByName(asked).repartition(parts(docs.sparkSession), "key").sortWithinPartitions("key", "side")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes_of: list[int] = []
        hs: list[np.ndarray] = []
        last, sides = None, [0, 0, 0]
        forest = Forest()  # of pieces: each meets many others, and each time may link the same sets otherwise

        def batch_of(a: np.ndarray, b: np.ndarray, whole: bool = False) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(np.full(len(a), whole))], names=["a", "b", "whole"])

        def done() -> Iterator[pa.RecordBatch]:
            if len(hs) > 1:
                a, b = similar(hs, similarity, None if sides[2] else sides[0])
                n = np.array(nodes_of, dtype=np.int64)
                if sides[2]:
                    yield batch_of(n[a], n[b], True)
                else:
                    for x, y in forest.add(n[a], n[b]):
                        yield batch_of(x, y)

        for b in batches:
            for key, node, h, side in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3).to_pylist(), strict=True):
                if key != last:
                    yield from done()
                    nodes_of, hs, last, sides = [], [], key, [0, 0, 0]
                if h.as_py():  # an empty set is like no other
                    nodes_of.append(node)
                    hs.append(np.frombuffer(h.as_py(), dtype=np.uint64))
                    sides[side] += 1
        yield from done()
        for x, y in forest.rest():
            yield batch_of(x, y)

    verified = scratch.write(dealt.mapInArrow(verify, "a long, b long, whole boolean").where("a <> b"))
    # the leaders that a set is like are linked with the first of them, and so is the set: a link for each set, and few besides
    stars = liked.where(F.size("like") > 0).select(F.col("like")[0].alias("a"), F.explode(F.array_union("like", F.array("node"))).alias("b")).where("a <> b").withColumn("whole", F.lit(False))
    verified = verified.unionByName(stars)
    # a group in one piece has its stars; those of several pieces are put together
    roots = verified.where("whole").select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(components(verified.where("not whole").select("a", "b")))
    return rows.join(roots.withColumnRenamed("node", "_node"), F.col("node") == F.col("_node"), "left").select("doc_id", "node", F.coalesce("root", "node").alias("root"))
