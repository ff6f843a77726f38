"""Scoring texts with a class-based bigram model whose classes come from exchange clustering.

log10 P(text) is the sum over its tokens of log10 P(class | context) P(token | class); tokens are the lower-cased (A to Z)
words and one end. The context is the class of the token before, whatever its frequency; a token that training never saw is the
context "other", and a text starts in the context "start". Both factors are smoothed: transitions towards the classes' shares, emissions by
adding one for each token type of the class and one for tokens that training never saw, which any class may emit. All of a
context's probabilities, an unseen token's included, add up to one.

Exchange: the most frequent tokens begin in one class each, all others in classes by a hash. A token's counts by the classes before
and after it decide which class makes the training text likelier, given the counts of the classes. In each of ``STEPS`` steps over all
pairs of tokens, half of the vocabulary (by a hash, in turn) moves at once; the classes of the likeliest step are taken.

Scale: texts are read once, into blocks of ``HELD_TOKENS`` tokens or a little more, as numbers; these are dealt as they are written, and don't travel. The vocabulary is dealt by hash
over buckets of about ``BUCKET_BYTES`` of text. A block sends each bucket one message a step: for each of the bucket's tokens the classes before and
after its places, one byte each, or, for ``OFTEN`` places or more, their counts by class. A bucket adds them up, moves its tokens, and sends each
block the classes of the block's tokens, one byte each. So a token of any frequency costs a block a bounded message, no task
holds more than a block or a bucket, and neither vocabulary nor pairs are ever rows. Only the class-by-class counts, of fixed size, reach
the driver and the tasks whole. Scoring goes over the same blocks, which get the classes and counts of their own tokens.

Nulls: a null text is an empty one and has one token, the end. Rows with a null id have the crc32 of the empty text, and take
part. Repeated rows count and are scored as often as they occur. Of classes that are as good the first is taken, of tokens that are as frequent the smaller one. A text of more than ``HELD_TOKENS`` tokens goes over several blocks. An empty table gives an empty table; without training rows,
all tokens are unseen and the score is the base score.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm._common import Scratch, parts

#: Classes; steps of their tokens' moves.
CLASSES, STEPS = 32, 6
HELD_TOKENS, BUCKET_BYTES, OFTEN = 1_000_000, 16 << 20, 256
#: The end token; no word has a line feed in it.
END = b"\n"
OTHER, START = CLASSES, CLASSES + 1
CONTEXTS = CLASSES + 2
KINDS = 128  #: over all contexts and classes; a power of two
AT_ONCE = 1 << 15  #: tokens whose counts by kind are held at once
WEIGHT = 5.0  #: of the classes' shares in a transition


def tokens(text: bytes | None) -> list[bytes]:
    out = (text or b"").lower().split()
    out.append(END)
    return out


def hashed(words: Iterable[bytes]) -> np.ndarray:
    """The words' 64-bit hashes."""
    return np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64)


def _batch(columns: dict[str, tuple[list, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in columns.values()], names=list(columns))


def _ints(value: pa.Scalar, kind: type = np.int32) -> np.ndarray:
    return np.frombuffer(value.as_buffer(), dtype=kind)


# What a block is written as; ``kind`` tells: SEQUENCE (a: numbers of all tokens, -1 before each text, b: places in it that train, in order of their tokens, c: how many
# each token has, as itself and as the one before, d: first token of each bucket), WORDS (bucket, a: its words here, b and c: how many places they have), TEXT (doc_id, held_out,
# row, start, n: where it is in the sequence, split). The block's tokens are numbered by bucket, and in it those under OFTEN come first.
SEQUENCE, WORDS, TEXT = range(3)


def _read(docs: DataFrame, buckets: int) -> DataFrame:
    """``docs`` (doc_id, t: binary, held_out) as blocks."""
    schema = f"kind int, block long, bucket int, doc_id {dict(docs.dtypes)['doc_id']}, held_out boolean, row long, start long, n long, split boolean, a binary, b binary, c binary, d binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: defaultdict[bytes, int] = defaultdict()
        ids.default_factory = ids.__len__  # a new token gets the next number
        seq: list[np.ndarray] = []
        live: list[np.ndarray] = []  # the place's token trains, and was not counted in the block before
        texts: list[tuple] = []
        block = row = TaskContext.get().partitionId() << 32
        held = at = 0
        kinds = None

        def add(numbers: np.ndarray, counts: bool) -> None:
            nonlocal at
            seq.append(numbers)
            live.append(np.full(len(numbers), counts))
            at += len(numbers)

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal at
            words, flat, counted = list(ids), np.concatenate(seq), np.concatenate(live)
            n, h = len(words), hashed(words)
            bucket = (h % np.uint64(buckets)).astype(np.int64)
            pos = np.flatnonzero(counted & (flat >= 0))
            order = np.lexsort((np.arange(n), np.bincount(flat[pos], minlength=n) >= OFTEN, bucket))
            number = np.empty(n + 1, dtype=np.int32)
            number[order], number[n] = np.arange(n), -1
            flat = number[flat]  # -1 stays
            if flat[0] >= 0 and counted[1]:
                pos = np.append(0, pos)  # the token before, of a text that goes on: it has no place here, but what follows it has
            places = pos[np.argsort(flat[pos], kind="stable")].astype(np.int32)
            follow = places[np.append(flat, -1)[places + 1] >= 0]
            had = [np.bincount(flat[x], minlength=n).astype(np.int32) for x in (places[places > 0], follow)]
            first = np.searchsorted(bucket[order], np.arange(buckets + 1)).astype(np.int32)
            empty = {"kind": SEQUENCE, "block": block}
            rows = [empty | {"a": flat.tobytes(), "b": places.tobytes(), "c": np.concatenate(had).tobytes(), "d": first.tobytes()}]
            for u in np.flatnonzero(np.diff(first)).tolist():
                lo, hi = first[u], first[u + 1]
                said = b"\n".join(b"" if words[i] == END else words[i] for i in order[lo:hi].tolist())
                rows.append(empty | {"kind": WORDS, "bucket": u, "a": said, "b": had[0][lo:hi].tobytes(), "c": had[1][lo:hi].tobytes()})
            yield pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in rows], f.type) for f in kinds], schema=kinds)
            cols = [*zip(*texts, strict=True)] or [()] * 6
            told = dict(zip(("doc_id", "held_out", "row", "start", "n", "split"), cols, strict=True)) | {"kind": [TEXT] * len(texts), "block": [block] * len(texts)}
            yield pa.RecordBatch.from_arrays([pa.array(told[f.name], f.type) if f.name in told else pa.nulls(len(texts), f.type) for f in kinds], schema=kinds)
            ids.clear()
            for x in (seq, live, texts):
                x.clear()
            at = 0

        for b in batches:
            if kinds is None:
                of = {"kind": pa.int32(), "block": pa.int64(), "bucket": pa.int32(), "doc_id": b.schema.field("doc_id").type, "held_out": pa.bool_(), "row": pa.int64(), "start": pa.int64(), "n": pa.int64(), "split": pa.bool_()}
                kinds = pa.schema([*of.items(), *((c, pa.binary()) for c in "abcd")])
            for doc_id, text, out in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), strict=True):
                words = tokens(text.as_py())
                add(np.array([-1]), False)
                for i in range(0, len(words), HELD_TOKENS):
                    piece = words[i : i + HELD_TOKENS]
                    texts.append((doc_id, out, row, at, len(piece), len(words) > HELD_TOKENS))
                    add(np.fromiter(map(ids.__getitem__, piece), dtype=np.int64, count=len(piece)), not out)
                    held += len(piece)
                    if held >= HELD_TOKENS:
                        yield from flush()
                        held, block = 0, block + 1
                        if i + HELD_TOKENS < len(words):
                            add(np.array([ids[piece[-1]]]), False)
                row += 1
        if seq:
            yield from flush()

    return docs.mapInArrow(run, schema)


def _vocabulary(blocks: DataFrame) -> DataFrame:
    """Buckets from blocks: (bucket, block, a: the number in the bucket of each of the block's tokens, b and c: their places in the block), and, with block -1, (a: all
    words, b: their places in training, c: whose turn they have)."""

    def gather(t: pa.Table) -> pa.Table:
        ids: defaultdict[bytes, int] = defaultdict()
        ids.default_factory = ids.__len__
        rows = sorted(zip(t.column("block").to_pylist(), t.column("a").to_pylist(), t.column("b").to_pylist(), t.column("c").to_pylist(), strict=True))
        out = []
        for block, said, b, c in rows:
            words = said.split(b"\n")
            out.append((block, np.fromiter(map(ids.__getitem__, words), dtype=np.int32, count=len(words)), b, c))
        total = np.zeros(len(ids), dtype=np.int64)
        for _, i, b, _ in out:
            total[i] += np.frombuffer(b, np.int32)
        turn = (hashed(ids) >> np.uint64(7) & np.uint64(1)).astype(np.uint8)
        out.append((-1, b"\n".join(ids), total, turn))
        block, a, b, c = zip(*out, strict=True)
        raw = lambda x: pa.array([v if isinstance(v, bytes) else v.tobytes() for v in x], pa.binary())
        return pa.table({"bucket": pa.array([t.column("bucket")[0].as_py()] * len(out), pa.int32()), "block": pa.array(block, pa.int64()), "a": raw(a), "b": raw(b), "c": raw(c)})

    return blocks.where(F.col("kind") == WORDS).select("bucket", "block", "a", "b", "c").groupBy("bucket").applyInArrow(gather, "bucket int, block long, a binary, b binary, c binary")


PLACED = "bucket int, block long, cls binary"


def _rows_of(bucket: int, state: dict[int, tuple], cls: np.ndarray) -> pa.Table:
    """The classes of a bucket's tokens as each block needs them, and (block -1) all of them."""
    cls = cls.astype(np.uint8)
    said = [(k, cls[v[0]].tobytes()) for k, v in state.items()] + [(-1, cls.tobytes())]
    return pa.table({"bucket": pa.array([bucket] * len(said), pa.int32()), "block": pa.array([k for k, _ in said], pa.int64()), "cls": pa.array([c for _, c in said], pa.binary())})


def _state(t: pa.Table) -> tuple[dict[int, tuple], tuple | None]:
    """Of a bucket's rows: by block (numbers, places, places that are followed), and what is of the bucket itself (a, b, c)."""
    rows = dict(zip(t.column("block").to_pylist(), zip(*(t.column(x) for x in "abc"), strict=True), strict=True))
    own = rows.pop(-1, None)
    return {k: tuple(_ints(x) for x in v) for k, v in rows.items()}, own


def _first(vocabulary: DataFrame) -> DataFrame:
    """The classes that tokens begin in, as ``PLACED``."""

    def top(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for words, c in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                words, c = words.split(b"\n"), _ints(c, np.int64)
                for i in np.argpartition(-c, min(CLASSES, len(c) - 1))[: CLASSES + 1].tolist():
                    yield _batch({"w": ([words[i]], pa.binary()), "c": ([c[i]], pa.int64())})

    own = vocabulary.where("block = -1").select("a", "b").mapInArrow(top, "w binary, c long")
    head = {bytes(r["w"]): i for i, r in enumerate(own.orderBy(F.desc("c"), "w").limit(CLASSES // 2).collect())}

    def place(t: pa.Table) -> pa.Table:
        state, own = _state(t)
        words = own[0].as_py().split(b"\n")
        spread = CLASSES // 2 + (hashed(words) >> np.uint64(9)) % np.uint64(CLASSES - CLASSES // 2)
        cls = np.array([head.get(w, s) for w, s in zip(words, spread.tolist(), strict=True)])
        return _rows_of(t.column("bucket")[0].as_py(), state, cls)

    return vocabulary.groupBy("bucket").applyInArrow(place, PLACED)


def _told(blocks: DataFrame, placed: DataFrame) -> DataFrame:
    """The blocks' messages: (bucket, block, a and b: the classes before and after each place, of the tokens under OFTEN, c: counts by kind of the others); bucket -1: counts
    of contexts and classes."""

    def tell(pairs: pa.Table, vocab: pa.Table) -> pa.Table:
        if not pairs.num_rows or not vocab.num_rows:
            return pa.table({"bucket": pa.array([], pa.int32()), "block": pa.array([], pa.int64()), **{x: pa.array([], pa.binary()) for x in "abc"}})
        seq, places, had, first = (_ints(pairs.column(x)[0]) for x in "abcd")
        before, after = seq[places[places > 0] - 1], np.append(seq, -1)[places + 1]
        after = after[after >= 0]
        n = len(had) // 2
        cls = np.full(n + 1, START, dtype=np.uint8)  # -1, the start, is last
        for u, c in zip(vocab.column("bucket").to_pylist(), vocab.column("cls"), strict=True):
            cls[first[u] : first[u + 1]] = _ints(c, np.uint8)
        was, next_ = cls[before], cls[after] + np.uint8(CONTEXTS)
        counts = np.bincount(was.astype(np.int64) * CLASSES + np.repeat(cls[:n], had[:n]), minlength=CONTEXTS * CLASSES)
        ends = [np.concatenate([[0], np.cumsum(x)]) for x in (had[:n], had[n:])]
        out: list[tuple] = [(-1, b"", b"", counts.tobytes())]
        for u in np.flatnonzero(np.diff(first)).tolist():
            lo, hi = int(first[u]), int(first[u + 1])
            mid = lo + int(np.searchsorted(had[lo:hi] >= OFTEN, True))
            cells = np.zeros((hi - mid) * KINDS, dtype=np.int64)
            for x, e, of in ((was, ends[0], had[mid:hi]), (next_, ends[1], had[n + mid : n + hi])):
                cells += np.bincount(np.repeat(np.arange(hi - mid) * KINDS, of) + x[e[mid] : e[hi]], minlength=len(cells))
            out.append((u, was[ends[0][lo] : ends[0][mid]].tobytes(), next_[ends[1][lo] : ends[1][mid]].tobytes(), cells.astype(np.int32).tobytes()))
        bucket, a, b, c = zip(*out, strict=True)
        return pa.table({"bucket": pa.array(bucket, pa.int32()), "block": pa.array([pairs.column("block")[0].as_py()] * len(out), pa.int64()), **{x: pa.array(v, pa.binary()) for x, v in zip("abc", (a, b, c), strict=True)}})

    pairs = blocks.where(F.col("kind") == SEQUENCE).select("block", "a", "b", "c", "d")
    return pairs.groupBy("block").cogroup(placed.where("block >= 0").groupBy("block")).applyInArrow(tell, "bucket int, block long, a binary, b binary, c binary")


def _moved(told: DataFrame, vocabulary: DataFrame, placed: DataFrame, counts: np.ndarray, turn: int) -> DataFrame:
    """``PLACED``: the tokens of this turn in the class that is best for their counts before and after them, the others where they are."""
    before = np.log((counts + 0.1) / (counts.sum(axis=0) + 0.1 * CONTEXTS))
    after = np.log((counts[:CLASSES] + 0.1) / (counts[:CLASSES].sum(axis=1, keepdims=True) + 0.1 * CLASSES)).T
    gain = np.zeros((KINDS, CLASSES))
    gain[:CONTEXTS], gain[CONTEXTS : CONTEXTS + CLASSES] = before, after

    def move(messages: pa.Table, own: pa.Table) -> pa.Table:
        state, (_, _, turns) = _state(own.filter(own.column("cls").is_null()))
        cls = _ints(own.filter(own.column("cls").is_valid()).column("cls")[0], np.uint8)
        keys: list[np.ndarray] = []
        often: list[tuple[np.ndarray, np.ndarray]] = []
        for block, *said in zip(messages.column("block").to_pylist(), *(messages.column(x) for x in "abc"), strict=True):
            i, *had = state[block]
            mid = int(np.searchsorted(had[0] >= OFTEN, True))
            for x, of in zip(said[:2], had, strict=True):
                keys.append(np.repeat(i[:mid].astype(np.int64) * KINDS, of[:mid]) + _ints(x, np.uint8))
            often.append((i[mid:], _ints(said[2]).reshape(-1, KINDS)))
        key = np.concatenate(keys or [np.zeros(0, np.int64)])
        key.sort()
        best = np.empty(len(cls), dtype=np.int64)
        for s in range(0, len(cls), AT_ONCE):
            size = min(AT_ONCE, len(cls) - s)
            some = key[np.searchsorted(key, s * KINDS) : np.searchsorted(key, (s + size) * KINDS)]
            cells = np.bincount(some - s * KINDS, minlength=size * KINDS).reshape(-1, KINDS)
            for i, c in often:
                here = (i >= s) & (i < s + size)
                cells[i[here] - s] += c[here]
            best[s : s + size] = (cells @ gain).argmax(axis=1)
        cls = np.where(_ints(turns, np.uint8) == turn % 2, best, cls)
        return _rows_of(own.column("bucket")[0].as_py(), state, cls)

    state = vocabulary.select("bucket", "block", F.when(F.col("block") >= 0, F.col("a")).alias("a"), F.when(F.col("block") >= 0, F.col("b")).alias("b"), "c", F.lit(None).cast("binary").alias("cls"))
    none = F.lit(None).cast("binary")
    own = state.unionByName(placed.where("block = -1").select("bucket", "block", none.alias("a"), none.alias("b"), none.alias("c"), "cls"))
    return told.where("bucket >= 0").groupBy("bucket").cogroup(own.groupBy("bucket")).applyInArrow(move, PLACED)


def _matrix(told: DataFrame) -> np.ndarray:
    """Counts of contexts and classes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((CONTEXTS, CLASSES), dtype=np.int64)
        for b in batches:
            for c in b.column(0):
                counts += _ints(c, np.int64).reshape(CONTEXTS, CLASSES)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(CLASSES)), *(pa.array(x) for x in counts)], names=["cls", *(f"k{i}" for i in range(CONTEXTS))])

    counts = np.zeros((CONTEXTS, CLASSES))
    partial = told.where("bucket = -1").select("c").mapInArrow(run, ", ".join(["cls long", *(f"k{i} long" for i in range(CONTEXTS))]))
    for r in partial.groupBy("cls").agg(*(F.sum(f"k{i}") for i in range(CONTEXTS))).collect():  # a row for each class
        counts[:, r[0]] = r[1:]
    return counts


def likelihood(counts: np.ndarray) -> float:
    """What of the training text's log likelihood depends on the classes: the sum of n log(n / (n of the context times n of the class))."""
    room = counts.sum(axis=1, keepdims=True) * counts.sum(axis=0)
    seen = counts > 0
    return float((counts[seen] * np.log(counts[seen] / room[seen])).sum())


def _learned(docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame, DataFrame, list[float], np.ndarray]:
    """(blocks, vocabulary, the classes of the likeliest step as ``PLACED``, the likelihood of each step's classes, the counts of the likeliest)."""
    size = docs.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    blocks = scratch.write_dealt(_read(docs, max(-(-size // BUCKET_BYTES), parts(docs.sparkSession))), "block", "kind")
    vocabulary = scratch.write(_vocabulary(blocks))
    placed, best, history = scratch.write(_first(vocabulary)), None, []
    for step in range(STEPS + 1):
        told = scratch.write(_told(blocks, placed))
        counts = _matrix(told)
        history.append(likelihood(counts))
        last = placed
        if step < STEPS:
            placed = scratch.write(_moved(told, vocabulary, last, counts, step))
        scratch.drop(told)
        if best is None or history[-1] > best[0]:  # tokens move at once, so that a step may be worse
            if best is not None:
                scratch.drop(best[1])
            best = (history[-1], last, counts)
        elif last is not placed:
            scratch.drop(last)
    return blocks, vocabulary, best[1], history, best[2]


def _words(vocabulary: DataFrame, placed: DataFrame) -> DataFrame:
    """(w, c, cls) of all tokens that train."""

    def tell(t: pa.Table, p: pa.Table) -> pa.Table:
        if not t.num_rows:
            return pa.table({"w": pa.array([], pa.binary()), "c": pa.array([], pa.int64()), "cls": pa.array([], pa.int32())})
        words, c, cls = t.column("a")[0].as_py().split(b"\n"), _ints(t.column("b")[0], np.int64), _ints(p.column("cls")[0], np.uint8)
        keep = np.flatnonzero(c)
        return pa.table({"w": pa.array([words[i] or END for i in keep.tolist()], pa.binary()), "c": pa.array(c[keep]), "cls": pa.array(cls[keep].astype(np.int32))})

    own = vocabulary.where("block = -1").select("bucket", "a", "b")
    return own.groupBy("bucket").cogroup(placed.where("block = -1").select("bucket", "cls").groupBy("bucket")).applyInArrow(tell, "w binary, c long, cls int")


def train(docs: DataFrame, *, text_col: str = "text") -> tuple[DataFrame, list[float], np.ndarray, np.ndarray]:
    """(w, c, cls) of all tokens of ``docs``; the likelihood of each step's classes; the counts of contexts and classes; types by class."""
    rows = docs.select(F.lit(None).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("t"), F.lit(False).alias("held_out"))
    _, vocabulary, placed, history, counts = _learned(rows, Scratch(docs.sparkSession, "classlm"))
    table = _words(vocabulary, placed)
    return table, history, counts, _types(table)


def _types(table: DataFrame) -> np.ndarray:
    types = np.zeros(CLASSES)
    for r in table.groupBy("cls").agg(F.count(F.lit(1))).collect():
        types[r[0]] = r[1]
    return types


class Model:
    """The probabilities, as logarithms to base 10. ``go``: context x class, ``room``: of a class's emissions, ``unseen``: of a token that training never saw, by context."""

    def __init__(self, counts: np.ndarray, types: np.ndarray):
        self.total, self.vocabulary = int(counts.sum()), int(types.sum())
        by_class, by_context = counts.sum(axis=0), counts.sum(axis=1)
        share = (by_class + 1) / (by_class.sum() + CLASSES)
        move = (counts + WEIGHT * share) / (by_context[:, None] + WEIGHT)
        room = by_class + types + 1
        self.go, self.room, self.unseen = np.log10(move), np.log10(room), np.log10((move / room).sum(axis=1))
        self.base_room = np.log10(self.total + self.vocabulary + 1)


def score(docs: DataFrame, held_out: Column, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; learned from the rows that aren't held out."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("t"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    scratch = Scratch(docs.sparkSession, "classlm")
    blocks, vocabulary, placed, _, counts = _learned(rows, scratch)
    m = Model(counts, _types(_words(vocabulary, placed)))
    doc_type = dict(rows.dtypes)["doc_id"]

    def counted(t: pa.Table, p: pa.Table) -> pa.Table:
        state, (_, c, _) = _state(t)
        total = _ints(c, np.int64)
        by_block = dict(zip(p.column("block").to_pylist(), p.column("cls").to_pylist(), strict=True))
        bucket = t.column("bucket")[0].as_py()
        return pa.table({"block": pa.array(list(state), pa.int64()), "bucket": pa.array([bucket] * len(state), pa.int32()), "cls": pa.array([by_block[k] for k in state], pa.binary()), "n": pa.array([total[v[0]].tobytes() for v in state.values()], pa.binary())})

    known = vocabulary.groupBy("bucket").cogroup(placed.groupBy("bucket")).applyInArrow(counted, "block long, bucket int, cls binary, n binary")

    def scored(t: pa.Table, vocab: pa.Table) -> pa.Table:
        texts, sequence = t.filter(t.column("a").is_null()).sort_by("start"), t.filter(t.column("a").is_valid())
        n = start = np.zeros(0, np.int64)
        sums = [np.zeros(0), np.zeros(0), np.zeros(0)]
        if texts.num_rows:
            seq = _ints(sequence.column("a")[0])
            vocab = vocab.sort_by("bucket")
            cls = np.concatenate([_ints(x, np.uint8) for x in vocab.column("cls")]).astype(np.int64)
            c = np.concatenate([_ints(x, np.int64) for x in vocab.column("n")])
            emit, context = np.log10(c + 1.0), np.append(np.where(c > 0, cls, OTHER), START)
            n, start = texts.column("n").to_numpy(), texts.column("start").to_numpy()
            at, before = seq[1:], context[seq[:-1]]  # what is first is of no text
            seen = c[at] > 0
            one = np.where(seen, m.go[before, cls[at]] + emit[at] - m.room[cls[at]], m.unseen[before])
            base = emit[at] - m.base_room
            bounds = np.stack([start - 1, start - 1 + n], axis=1).ravel()  # between two texts is a -1
            sums = [np.add.reduceat(np.append(x, 0), bounds)[::2] for x in (seen.astype(np.int64), base, one)]
        cols = [texts.column("row"), texts.column("doc_id"), texts.column("held_out"), texts.column("split"), pa.array(n), pa.array(sums[0].astype(np.int64)), pa.array(sums[1]), pa.array(sums[2])]
        return pa.table(cols, names=["row", "doc_id", "held_out", "split", "n_tokens", "n_known", "base_score", "score"])

    schema = f"row long, doc_id {doc_type}, held_out boolean, split boolean, n_tokens long, n_known long, base_score double, score double"
    asked = blocks.where(F.col("kind").isin(TEXT, SEQUENCE)).select("block", "doc_id", "held_out", "row", "start", "n", "split", "a")
    out = scratch.write(asked.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(scored, schema))
    for used in (blocks, vocabulary, placed):
        scratch.drop(used)
    numbers = ["n_tokens", "n_known", "base_score", "score"]
    whole = out.where("not split").select("doc_id", "held_out", *numbers)
    joined = out.where("split").groupBy("row", "doc_id", "held_out").agg(*(F.sum(x).alias(x) for x in numbers)).select("doc_id", "held_out", *numbers)
    score_col = F.col("score") if m.total else F.col("base_score")
    return whole.unionByName(joined).select("doc_id", "held_out", "n_tokens", "n_known", F.lit(m.total).cast("long").alias("train_tokens"), "base_score", score_col.alias("score"))
