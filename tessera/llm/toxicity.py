"""Toxicity: embeddings of subword bags, averaged into a linear softmax.

A word's vector is the mean of the vectors of its character n-grams (with marks for its start and end) and of itself, each
found by a hash; a text's vector is the mean over its words (and ``pad`` zero vectors); a softmax over two classes follows. Vectors and softmax are
trained jointly in numpy. A misspelling that training never saw shares most of its n-grams with words that it saw.

The model is fitted on a bounded sample of the labelled rows (``max_rows``, ``max_bytes``), and it is itself of fixed size
(``buckets`` x ``dim``), so each task holds the same whatever the corpus measures; with ``in_task`` one task draws, one fits, and the driver
gets a number for each bucket. Scoring is one pass over
whole texts without a shuffle. Because the softmax is linear in the mean, a word counts through one number; each task
computes it once per distinct word of a batch.

Nulls and empty texts: the text has no words, and its score is that of the bias alone. Rows with a null label, and ids
without a label, don't train. A text is held as a whole in one task. Repeated ids train as often as they occur, and each row is scored. With no usable label of
either class, the score is the share of label 1 (0.0 with no labels).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm._common import Scratch


@dataclass(frozen=True)
class Settings:
    max_rows: int = 5000  #: labelled rows that train, at most; half of it for the rarer class, if it has so many
    max_bytes: int = 48 << 20  #: of their texts together
    buckets: int = 1 << 17
    dim: int = 8
    shortest: int = 3
    longest: int = 6
    pad: int = 10  #: zero vectors that each mean takes in besides, so that a very short text stays near the bias
    epochs: int = 8
    rate: float = 1.0
    seed: int = 7
    threshold: float = 0.7


def subwords(words: list[str], s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of all words, the whole word among them, and for each the position of its word."""
    marked = [f"<{w}>" for w in words]
    length = np.fromiter(map(len, marked), dtype=np.int64, count=len(marked))
    code = np.frombuffer("".join(marked).encode("utf-32-le", "replace"), dtype=np.uint32).astype(np.uint64)
    of = np.repeat(np.arange(len(words)), length)
    end = np.repeat(np.cumsum(length), length)
    start = end - np.repeat(length, length)
    at, mix, mask = np.arange(len(code)), np.uint64(0x9E3779B97F4A7C15), np.uint64(s.buckets - 1)
    buckets, owners = [], []
    h = np.zeros(len(code), dtype=np.uint64)
    for n in range(1, s.longest + 1):
        h = h[: len(code) - n + 1] * np.uint64(0x100000001B3) + code[n - 1 :]  # the n-gram that starts here
        if n >= s.shortest:
            fits = at[: len(h)] + n <= end[: len(h)]
            buckets.append(((h[fits] * mix) >> np.uint64(40)) & mask)
            owners.append(of[: len(h)][fits])
    power = np.uint64(31) ** (at - start).astype(np.uint64)
    whole = np.add.reduceat(code * power, np.cumsum(length) - length) if len(words) else np.zeros(0, np.uint64)
    buckets.append(((whole * mix) >> np.uint64(40)) & mask)
    owners.append(np.arange(len(words)))
    return np.concatenate(buckets).astype(np.int64), np.concatenate(owners)


def words_of(text: str | None) -> list[str]:
    """Lower-cased (A to Z) words between ASCII white space."""
    return [w.decode() for w in (text or "").encode("utf-8", "replace").lower().split()]


class Model:
    """``table`` holds a vector for each bucket, ``out`` the softmax weights of the two classes, ``bias`` their biases."""

    def __init__(self, table: np.ndarray, out: np.ndarray, bias: np.ndarray, s: Settings):
        self.s, self.bias = s, float(bias[1] - bias[0])
        self.gain = (table @ (out[:, 1] - out[:, 0])).astype(np.float32)  # what a bucket adds to the difference of the two logits

    @classmethod
    def of(cls, gain: np.ndarray, bias: float, s: Settings) -> Model:
        """A model that was fitted elsewhere."""
        m = cls.__new__(cls)
        m.s, m.bias, m.gain = s, bias, gain
        return m

    def score(self, texts: list[str | None]) -> np.ndarray:
        docs = [words_of(t) for t in texts]
        known: dict[str, int] = {}
        ids = [np.fromiter((known.setdefault(w, len(known)) for w in d), dtype=np.int64, count=len(d)) for d in docs]
        at, of = subwords(list(known), self.s)
        each = np.bincount(of, self.gain[at], len(known)) / np.maximum(np.bincount(of, minlength=len(known)), 1)
        z = np.array([each[i].sum() / (len(i) + self.s.pad) for i in ids]) + self.bias
        return 1 / (1 + np.exp(-z))


def fit(texts: list[str | None], labels: list[int], s: Settings, prior: float) -> Model:
    """Stochastic gradient descent with Adagrad steps. ``prior``: the share of label 1 among all labelled rows, which the rows' weights restore."""
    rng = np.random.default_rng(s.seed)
    y = np.array(labels, dtype=np.int64)
    share = y.mean() if len(y) else 0.0
    table, out = (rng.random((s.buckets, s.dim), dtype=np.float32) - 0.5) / s.dim, np.zeros((s.dim, 2), dtype=np.float32)
    bias = np.log(np.clip([1 - prior, prior], 1e-9, 1)).astype(np.float64)
    if share in (0.0, 1.0) or not len(y):
        return Model(table * 0, out, bias, s)
    out[:, 1] = rng.normal(0, 0.3, s.dim)
    out[:, 0] = -out[:, 1]
    rows: list[tuple[np.ndarray, np.ndarray]] = []
    for t in texts:
        bag = Counter(words := words_of(t))
        at, of = subwords(list(bag), s)
        share_of = np.array([*bag.values()], dtype=np.float64) / np.maximum(np.bincount(of, minlength=len(bag)), 1) / (len(words) + s.pad)
        at, back = np.unique(at, return_inverse=True)
        rows.append((at.astype(np.int32), np.bincount(back, share_of[of], len(at)).astype(np.float32)))
    per_class = np.array([(1 - prior) / (1 - share), prior / share])
    g_table, g_out = np.full(s.buckets, 1e-6, np.float32), np.full((s.dim, 2), 1e-6, np.float32)
    for _ in range(s.epochs):
        for i in rng.permutation(len(rows)):
            at, weight = rows[i]
            h = weight @ table[at]
            z = h @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            d = p * per_class[y[i]]
            d[y[i]] -= per_class[y[i]]
            step = (out @ d).astype(np.float32)
            grad = np.outer(h, d).astype(np.float32)
            g_out += grad * grad
            out -= s.rate * 0.2 * grad / np.sqrt(g_out)
            bias -= 0.01 * d
            if len(at):
                g_table[at] += weight * weight * float(step @ step) / s.dim
                table[at] -= (s.rate * 0.2 * weight / np.sqrt(g_table[at]))[:, None] * step
    return Model(table, out, bias, s)


def sample(docs: DataFrame, labels: DataFrame, usable: Column, s: Settings, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> tuple[DataFrame, float]:
    """The rows that train, (_id, _t: text, _y: label, _c: times), and the share of label 1 among all labelled rows.

    They are ``max_rows`` rows and ``max_bytes`` of text at most, however often an id or a row repeats: rows are drawn by keys of
    their own (id, text and place among equal ones), and those that would pass the bytes are passed over, not what comes after them. A task draws them; the driver gets two counts."""
    lab = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y")).where(F.col("_y").isin(0, 1) & F.col("_id").isNotNull())
    own = docs.where(usable).select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t"), F.coalesce(F.octet_length(text_col), F.lit(0)).alias("_n"), F.xxhash64(id_col, text_col).alias("_h"))
    # equal rows with an equal label are one with a number of times, so that a repeated row is one key
    lab = own.groupBy("_id", "_h").agg(F.count(F.lit(1)).alias("_c"), F.max("_n").alias("_n")).join(lab.groupBy("_id", "_y").agg(F.count(F.lit(1)).alias("_l")), "_id")
    scratch = Scratch(docs.sparkSession, "toxicity")
    lab = scratch.write(lab.select("_id", "_h", "_y", "_n", (F.col("_c") * F.col("_l")).alias("_c")))
    counts = {r["_y"]: r["n"] for r in lab.groupBy("_y").agg(F.sum("_c").alias("n")).collect()}
    total = sum(counts.values())
    keyed = lab.withColumn("_k", F.sha2(F.concat_ws(":", F.lit(s.seed), "_id", "_h"), 256)).select("_k", "_id", "_h", "_n", "_y", "_c")
    first = lambda label: keyed.where(F.col("_y") == label).orderBy("_k", "_id", "_h").limit(s.max_rows)  # noqa: E731  each task keeps max_rows at most; keys, no texts

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: dict[int, list[tuple]] = {0: [], 1: []}
        for b in batches:
            kind = b.schema.field(1).type
            for *key, y, c in zip(*(x.to_pylist() for x in b.columns), strict=True):
                keys[y].append((*key, c))
        drawn = {y: [(*k, i) for *k, c in sorted(keys[y]) for i in range(min(c, s.max_rows))][: s.max_rows] for y in (0, 1)}
        rare = 1 if len(drawn[1]) <= len(drawn[0]) else 0
        half = drawn[rare][: s.max_rows // 2]
        some = sorted([(*k, rare) for k in half] + [(*k, 1 - rare) for k in drawn[1 - rare][: s.max_rows - len(half)]])
        left, times = s.max_bytes, Counter()
        for _, i, h, n, _, y in some:
            if n <= left:
                left -= n
                times[i, h, y] += 1
        if times:
            i, h, y = zip(*times, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(i, kind), pa.array(h, pa.int64()), pa.array(y, pa.int32()), pa.array([*times.values()], pa.int32())], names=["_id", "_h", "_y", "_c"])

    schema = T.StructType([T.StructField("_id", own.schema["_id"].dataType), T.StructField("_h", T.LongType()), T.StructField("_y", T.IntegerType()), T.StructField("_c", T.IntegerType())])
    chosen = scratch.write(first(0).unionByName(first(1)).repartition(1).mapInArrow(draw, schema))
    scratch.drop(lab)
    found = own.join(F.broadcast(chosen), ["_id", "_h"]).groupBy("_id", "_h", "_y", "_c").agg(F.min("_t").alias("_t"))
    return found.select("_id", "_t", "_y", "_c"), counts.get(1, 0) / total if total else 0.0


def fit_rows(rows: list[tuple], s: Settings, prior: float) -> Model:
    """``fit`` for rows of ``sample`` in any order."""
    rows = sorted((i, t or "", y) for i, t, y, c in rows for _ in range(c))
    return fit([t for _, t, _ in rows], [y for _, _, y in rows], s, prior)


def train(docs: DataFrame, labels: DataFrame, usable: Column, s: Settings = Settings(), *, in_task: bool = False, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Fits the model on the labelled rows of ``docs`` for which ``usable`` (a condition on the id column) holds, as ``sample`` draws them.

    ``in_task``: a task holds the sample and fits, and the driver gets the model alone; otherwise the driver does."""
    rows, prior = sample(docs, labels, usable, s, id_col=id_col, text_col=text_col, label_col=label_col)
    if not in_task:
        return fit_rows([tuple(r) for r in rows.collect()], s, prior)  # max_rows, and max_bytes in all

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = fit_rows([r for b in batches for r in zip(*(x.to_pylist() for x in b.columns), strict=True)], s, prior)
        yield pa.RecordBatch.from_arrays([pa.array([m.gain.tobytes()], pa.binary()), pa.array([m.bias])], names=["gain", "bias"])

    fitted = rows.repartition(1).mapInArrow(run, "gain binary, bias double").collect()  # of fixed size
    return Model.of(np.frombuffer(fitted[0]["gain"], dtype=np.float32), fitted[0]["bias"], s) if fitted else fit([], [], s, prior)


def score(docs: DataFrame, model: Model, *, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with a column ``score_col`` (double, 0 to 1) after its own; one pass, whole texts."""
    schema, at = docs.schema, docs.columns.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size: one float per bucket

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            for start in range(0, b.num_rows, 512):
                part = b.slice(start, 512)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(m.score(part.column(at).to_pylist()), pa.float64())], names=[*part.schema.names, score_col])

    return docs.mapInArrow(scored, type(schema)([*schema.fields]).add(score_col, "double"))
