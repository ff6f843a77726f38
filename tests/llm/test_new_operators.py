"""Source divergence, spelling variants and sorted projections against brute force, with nulls, ties, repeated rows, empty tables and clashing names."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import divergence, projections, spellings

SCHEMA = "doc_id long, text string, lang string, source string, term string, count long, docs long, word string, n long, form string, block long"


def lowered(t):
    return (t or "").translate({c: c + 32 for c in range(65, 91)})


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(11)
    base = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(3, 9))) for _ in range(120)]
    word = lambda: rng.choice(base) if rng.random() < 0.8 else (lambda w, i: w[:i] + rng.choice(["", "x", "É", "zz"]) + w[i + 1 :])(rng.choice(base), rng.randrange(3))
    texts = [" ".join(word() for _ in range(rng.randint(1, 60))) for _ in range(90)]
    texts += ["", None, "123 ... \n", "Zoè zoÈ 漢字, mixed-Case CASE", "abcde" * 3000, texts[0], texts[0].upper()] + [texts[5]] * 12
    rows = [(i, t, ("en", "de", None, "fr")[i % 7 % 4], ("a", "b", "c", None)[i % 5 % 4], "t", 3, 4, "w", 5, "f", 6) for i, t in enumerate(texts)]
    rows += [(None, "one without an id abcde", "en", "a", *rows[0][4:]), rows[3], rows[3], (900, None, "xx", "only", *rows[0][4:]), (901, "7", "xx", "other", *rows[0][4:])]
    return rows


@pytest.fixture(scope="module")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, SCHEMA).repartition(3)


def test_divergence(docs, corpus):
    count, seen, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for r in corpus:
        lang, source, terms = r[2] or "", r[3] or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lowered(r[1]))
        groups[lang].add(source)
        count[lang, source].update(terms)
        seen[lang].update(set(terms))
    want = set()
    for lang, sources in groups.items():
        kept = [t for t, n in seen[lang].items() if n >= 10]
        whole = Counter()
        for s in sources:
            whole.update(count[lang, s])
        share = lambda c, t: 1 + 10**9 * (c[t] + 2) // (sum(c[x] for x in kept) + 2 * len(kept))
        f = lambda p, q: (p - q) ** 2 // (p + q)
        for s in sources:
            pairs = sorted((-sum(f(share(count[lang, s], t), share(count[lang, o], t)) for t in kept), o.encode()) for o in sources - {s})
            want |= {(lang, s, "pair", o.decode(), -v, i + 1) for i, (v, o) in enumerate(pairs)}
            p, q = {t: share(count[lang, s], t) for t in kept}, {t: share(whole, t) for t in kept}
            best = sorted((-f(p[t], q[t]), t.encode()) for t in kept if count[lang, s][t] and p[t] > q[t])[:10]
            want |= {(lang, s, "term", t.decode(), -v, i + 1) for i, (v, t) in enumerate(best)}
    got = [tuple(r) for r in divergence.audit(docs).select("lang", "source", "part", "item", "value", "rank").collect()]
    assert len(got) == len(want) and set(got) == want
    assert any(x[2] == "term" for x in want) and any(x[0] == "xx" and x[4] == 0 for x in want)
    assert divergence.audit(docs.limit(0)).count() == 0


def test_divergence_in_many_blocks_and_chunks(docs, monkeypatch):
    want = sorted(map(tuple, divergence.audit(docs).collect()))
    monkeypatch.setattr(divergence, "ENTRIES", 7)
    assert sorted(map(tuple, divergence.audit(docs).collect())) == want
    monkeypatch.setattr(divergence, "CHUNK", 100)
    batch = pa.RecordBatch.from_arrays([pa.array(["Aa b", None, "", "aa"]), pa.array(["x", None, "y", "x"]), pa.array(["s", "s", None, "s"])], names=["text", "lang", "source"])
    total = Counter()
    for out in divergence._counted(iter([batch, batch])):
        for r in out.to_pylist():
            total[r["lang"], r["source"], r["term"]] += r["count"] * 100 + r["docs"]
    assert total == {("x", "s", "aa"): 404, ("x", "s", "b"): 202, ("x", "s", None): 0, ("", "s", None): 0, ("y", "", None): 0}


def test_slices_of_one_hash_are_told_apart(monkeypatch):
    class Same:
        @staticmethod
        def xxh3_64_intdigest(_):
            return 1

    raw = np.frombuffer("aa b aa ccé b".encode(), dtype=np.uint8)
    low, start, end = divergence.slices(raw, np.array([0, 4, len(raw)]))
    monkeypatch.setattr(divergence, "xxhash", Same)
    first, of = divergence.grouped(low, start, end)
    assert [bytes(low[start[first[i]] : end[first[i]]]).decode() for i in of] == ["aa", "b", "aa", "ccé", "b"]
    crossing = divergence.slices(np.frombuffer(b"abcd", dtype=np.uint8), np.array([0, 0, 2, 2, 4, 4]))
    assert crossing[1].tolist() == [0, 2] and crossing[2].tolist() == [2, 4]


def test_shares_and_gaps_are_exact():
    counts = np.array([0, 1, 10**13, 7, 0])
    assert divergence.shares(counts, 10**14 + 3, 10**9).tolist() == [1 + 10**9 * (c + 2) // (10**14 + 3 + 2 * 10**9) for c in counts.tolist()]
    rng = np.random.default_rng(1)
    n, width = 5, 40
    dense = rng.integers(1, 10**9, size=(n, width)) * (rng.random((n, width)) < 0.3)
    dense[2] = 0
    empty = rng.integers(1, 10**6, size=n)
    indptr = np.concatenate([[0], np.cumsum((dense > 0).sum(axis=1))])
    got = divergence.between_rows(indptr, np.nonzero(dense)[1], dense[dense > 0], empty, width)
    full = np.where(dense > 0, dense, empty[:, None])
    assert all(got[i, j] == sum((int(a) - int(b)) ** 2 // (int(a) + int(b)) for a, b in zip(full[i], full[j])) for i in range(n) for j in range(n))


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) == len(a):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def forms(n):
    of = {w: [v for v in n if near(w, v)] for w in n}
    form = {}
    for w in n:
        best = min(of[w], key=lambda v: (-n[v], v.encode()), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    def root(w):
        return w if form[w] is None else root(form[w])
    return {(w, form[w], root(w), n[w], len(of[w]), n[form[w]] if form[w] else None) for w in n}


def counted(rows):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lowered(run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    return {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}


def test_spellings(docs, corpus):
    n = counted(r[:2] for r in corpus)
    got = [tuple(r) for r in spellings.group(docs).select("word", "form", "root", "n", "n_near", "form_n").collect()]
    want = forms(n)
    assert len(got) == len(want) and set(got) == want and any(x[4] for x in want)
    assert spellings.group(docs.limit(0)).count() == 0


def test_words_of_few_letters_and_long_chains_of_forms(spark):
    """Masks of words over two letters have four values: bands are as hot as they get. Forms follow one another seven times."""
    rng = random.Random(5)
    n = {"".join(rng.choice("ab") for _ in range(rng.randint(5, 11))): rng.randint(3, 40) for _ in range(700)}
    chain = "qqqqqqqq"
    for i in range(8):
        n["r" * i + chain[i:]] = 3 * 2**i
    n |= {"×÷àÀÿ": 3, "×÷àÀ": 3, "×÷áÀÿ": 9, "long" * 5000: 5, "long" * 5000 + "x": 20}
    table = spark.createDataFrame(list(n.items()), "word string, n long")
    found = {frozenset((r.a, r.b)) for r in spellings.near_words(table).collect()}
    words = list(n)
    want = {frozenset((a, b)) for i, a in enumerate(words) for b in words[:i] if abs(len(a) - len(b)) <= 1 and near(a, b)}
    assert found == want and spellings.near_words(table).count() == len(want)
    rows = [(1, " ".join(" ".join([w] * k) for w, k in n.items() if "q" in w or "r" in w)), (2, None)]
    of = {r.word: r for r in spellings.group(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {tuple(of[w][c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for w in of} == forms(counted(rows))
    steps = lambda w: 0 if of[w].form is None else 1 + steps(of[w].form)
    assert max(map(steps, of)) >= 5


def linked(ids, x, cosine=0.95):
    """(links, smallest reachable id) of each row, by all pairs."""
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    link = unit @ unit.T >= cosine
    np.fill_diagonal(link, False)
    label = np.arange(len(x))
    while True:
        new = np.array([min([label[i], *label[link[i]]]) for i in range(len(x))])
        if np.array_equal(new, label):
            break
        label = new
    least = {k: min((i for i, m in zip(ids, label) if m == k and i is not None), default=None) for k in set(label.tolist())}
    return link.sum(axis=1), [least[k] for k in label.tolist()]


def vectors(seed=3):
    rng = np.random.default_rng(seed)
    x = [rng.standard_normal((900, 24))]
    for size, noise in ((300, 0.08), (150, 0.02), (40, 0.1), (3, 0.05), (60, 0.18)):
        x.append(rng.standard_normal(24) + noise * rng.standard_normal((size, 24)))
    x = np.concatenate(x)
    x[10:300] = x[5]  # copies
    return x


def test_sorted_projections(spark, monkeypatch):
    monkeypatch.setattr(projections, "BLOCK", 64)
    monkeypatch.setattr(projections, "CROWD", 16)
    x = vectors()
    ids = [None if i == 7 else 2000 - i if i < 1900 else 5 for i in range(len(x))]
    odd = [(5000, None), (5001, [0.0] * 24), (5002, [float("nan")] + [1.0] * 23), (5003, [None] + [1.0] * 23), (5004, []), (5005, [1.0, 2.0]), (5006, [2.0, 4.0]), (None, None), (5007, [float("inf")] * 24), (5008, [1e-200] * 24), (5009, [1e200] * 24), (3, None)]
    rows = [(i, v.tolist(), 1, "b", 2, 3) for i, v in zip(ids, x)] + [(i, v, 1, "b", 2, 3) for i, v in odd]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, n long, ball string, node long, block long").repartition(4)
    got = defaultdict(list)
    for r in projections.near_vectors(df).collect():
        got[r.vec_id].append(r)
        assert r.kept == (r.vec_id == r.component_id)
    assert sum(map(len, got.values())) == len(rows)
    n, least = linked(ids, x)
    once = [k for k, i in enumerate(ids) if Counter(ids)[i] == 1 and i is not None]
    found, there = sum(got[ids[k]][0].n_links for k in once), sum(int(n[k]) for k in once)
    assert all(got[ids[k]][0].n_links <= n[k] for k in once) and found >= 0.97 * there
    assert sum(got[ids[k]][0].component_id == least[k] for k in once) >= 0.99 * len(once)
    for i in (5000, 5001, 5002, 5003, 5004, 5007):
        assert (got[i][0].n_links, got[i][0].component_id) == (0, i)
    assert (got[5005][0].n_links, got[5006][0].component_id) == (1, 5005) and (got[5008][0].n_links, got[5009][0].component_id) == (1, 5008)
    assert projections.near_vectors(df.limit(0)).count() == 0
    assert {r.n_links for r in projections.near_vectors(df.where("embedding is null")).collect()} == {0}


def test_a_group_far_beyond_the_windows_is_counted_whole(spark, monkeypatch):
    monkeypatch.setattr(projections, "BLOCK", 32)
    monkeypatch.setattr(projections, "CROWD", 8)
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.standard_normal(48) + 0.06 * rng.standard_normal((1500, 48)), rng.standard_normal((500, 48))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(3)
    got = {r.vec_id: r for r in projections.near_vectors(df).collect()}
    n, least = linked(range(len(x)), x)
    assert sum(r.n_links for r in got.values()) >= 0.98 * n.sum() and all(got[i].n_links <= n[i] for i in got)
    assert [got[i].component_id for i in range(len(x))] == least


def test_passes_grow_with_the_rows_only_by_their_logarithm():
    at = [projections.passes_for(n, 64, 0.95, 0.99) for n in (10**3, 10**5, 10**7, 10**10)]
    assert at == sorted(at) and at[0] >= 2 and at[-1] < 60


def test_what_operators_wrote_is_removed(spark, tmp_path):
    from tessera.llm._common import Scratch

    scratch = Scratch(spark, "t")
    written, dealt = scratch.write(spark.range(3)), scratch.write_dealt(spark.range(9), "id")
    assert written.count() == 3 and dealt.count() == 9
    names = scratch.names
    Scratch.close_all()
    assert not Scratch.open and not any(spark.catalog.tableExists(n) for n in names)
    with pytest.raises(Exception):  # noqa: B017
        spark.read.parquet(scratch.base).count()
