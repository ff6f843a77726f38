"""The operators on small tables with nulls, empty and long texts, ties, repeated rows and clashing names, against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import classlm, decontamination, exactspans, extraction, mixing, nearest, passages, sharding, simhash, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, fp long, shard int, score double, h long, w string, t string, row long"


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(7)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    out = [text(rng.randint(1, 120)) for _ in range(40)]
    passage = text(60)
    out += [text(20) + " " + passage + "\n" + text(15) for _ in range(4)]
    out += [out[3]] * 5 + [out[10] + " extra", out[10].upper()] + ["", " \t", "one", None, None, "é ü 漢字 " * 40, text(6000)]
    return out, passage


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en", ("a", "b", None, "c")[i % 4 if i % 5 else 0], 1, 2, 3, 4, 0.5, 6, "w", "t", 7) for i, t in enumerate(texts[0])]
    rows += [(None, "no id here at all", "en", "b", *rows[0][4:]), rows[5], rows[5]]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def n_words(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


def test_sharding(docs, empty):
    rows, got = docs.collect(), sharding.shard(docs).collect()
    assert sorted((r.doc_id if r.doc_id is not None else -1, len((r.text or "").encode()) + 1, None if r.text is None else zlib.crc32(r.text.encode())) for r in rows if r.text is not None) == sorted((r.doc_id if r.doc_id is not None else -1, r["size"], r.text_crc32) for r in got if r.text_crc32 is not None)
    assert len(got) == len(rows) and {r.law for r in got} == {"bytes"}
    for s in range(16):
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots)))
    assert sharding.shard(empty).count() == 0


def test_sharding_against_its_laws(spark):
    rng = random.Random(9)
    rows = [(i, f"text {rng.randrange(150)} " * rng.randint(1, 9)) for i in range(1200)] + [(None, "a copy without an id")] * 1500 + [(7, "one id")] * 400
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = sharding.shard(df).select("doc_id", "size", "text_crc32", "shard", "slot").collect()
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == Counter((i, len(t) + 1, zlib.crc32(t.encode())) for i, t in rows)
    size, count, places = Counter(), Counter(), {}
    for r in got:
        size[r.shard] += r["size"]
        count[r.shard] += 1
        places.setdefault(r.text_crc32, set()).add(r.shard)
        assert r.slot >= 0
    assert len({(r.shard, r.slot) for r in got}) == len(got) and all(max(r.slot for r in got if r.shard == s) + 1 == count[s] for s in range(16))
    assert len(size) == 16 and max(size.values()) <= 1.1 * min(size.values()) and max(count.values()) <= 1.3 * min(count.values())
    whole = Counter(t for _, t in rows)
    for t, n in whole.items():  # equal texts stay together unless they are over a shard's whole share
        if n * 16 <= len(rows) and n * (len(t) + 1) * 16 <= sum(size.values()) and n * n_words(t) * 16 <= sum(n_words(x) for _, x in rows):
            assert len(places[zlib.crc32(t.encode())]) == 1


def test_a_third_in_one_group_is_split(spark):
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("same text here")).otherwise(F.concat(F.lit("text "), F.col("id") * 7919)).alias("text"))
    load = [r["b"] for r in sharding.shard(rows).groupBy("shard").agg(F.sum("size").alias("b")).collect()]
    assert len(load) == 16 and max(load) < 1.25 * min(load)


def test_nearest(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 16)).astype(np.float32)
    x[50:60] = x[40]
    rows = [(i, v.tolist(), "x") for i, v in enumerate(x)] + [(1000, None, "x"), (1001, [0.0] * 16, "x"), (1002, [float("nan")] * 16, "x"), (1003, [None, 1.0], "x"), (1004, [], "x"), (1005, [1.0, 2.0], "x"), (None, [1.0] * 16, "x"), (280, x[280].tolist(), "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, id string")
    got = nearest.search(df, F.col("vec_id") % 20 == 0).collect()
    full = x.astype(float) @ x.astype(float).T
    for q in range(0, 300, 20):
        order = sorted((i for i in range(300) if i != q), key=lambda i: (-full[q, i], i))
        mine = [r for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q]
        if q != 280 and 280 not in order[:21]:
            assert [r["rank"] for r in mine] == list(range(1, 21))
            assert len({r.vec_id for r in mine} & set(order[:20])) >= 19
    assert {r.query_id for r in got} == set(range(0, 300, 20))
    assert nearest.search(df.limit(0), F.lit(True)).count() == 0


def test_simhash_against_all_pairs(docs, empty):
    rows, got = docs.collect(), {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    fp = {r.doc_id: simhash.fingerprint((r.text or "").encode(), 4) for r in rows}
    root = {d: d for d in fp if d is not None}
    changed = True
    while changed:
        changed = False
        for a in root:
            for b in root:
                if bin(fp[a] ^ fp[b]).count("1") <= 4 and root[b] < root[a]:
                    root[a], changed = root[b], True
    for d, r in got.items():
        assert r.fp & 0xFFFFFFFFFFFFFFFF == fp[d]
        if d is not None:
            assert r.component_id == root[d]
    assert simhash.near_duplicates(empty).count() == 0


def test_crowded_anchors_are_cut(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CHUNK", 4)
    base = 0x0123456789ABCDEF
    fps = [(base ^ (1 << i) ^ (1 << (i * 7 % 60)),) for i in range(40)] + [((base * 31 + i * 2654435761 * 65537) % (1 << 62),) for i in range(40)]
    df = spark.createDataFrame(sorted(set(fps)), "fp long")
    links = simhash.candidate_links(df, 4).collect()
    v = sorted({f[0] for f in fps})
    full = [(i, j) for i in range(len(v)) for j in range(i) if bin(v[i] ^ v[j]).count("1") <= 4]
    from tessera.llm.components import local

    at = {x: i for i, x in enumerate(v)}
    want = local(len(v), np.array([x for x, _ in full]), np.array([y for _, y in full]))
    got = local(len(v), np.array([at[r.a] for r in links]), np.array([at[r.b] for r in links]))
    assert (want == got).all()


def shingle_set(t, k=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def test_decontamination_against_all_pairs(spark, docs, empty, texts):
    passage = texts[1].split()
    shorter = [(20, "one"), (21, " ".join(passage[7:10])), (22, "ONE\n"), (23, " ".join(passage[2:6])), (24, "  "), (25, passage[30])]
    items = [*shorter, (0, " ".join(passage[:20])), (1, " ".join(passage[5:30]).upper()), (2, " ".join(passage[:12] + ["zzz"] + passage[13:58])), (3, "too short"), (4, None), (5, texts[0][0]), (6, "never seen words in any text at all"), (None, texts[0][1]), (7, texts[0][-1][:400])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.n_shared, r.n_item) for r in decontamination.contained(docs, bench).collect()}
    want = {}
    for r in docs.collect():
        for i, t in items:
            k = min(5, max(n_words(t), 1))
            b, d = shingle_set(t, k), shingle_set(r.text, k)
            if r.doc_id is not None and i is not None and b and len(b & d) >= 0.8 * len(b):
                want[(r.doc_id, i)] = (len(b & d), len(b))
    assert got == want and len(want) >= 20 and {i for _, i in want} >= {20, 21, 22, 23, 25}
    long = {(r.doc_id, r.item_id) for r in decontamination.contained(docs, bench, shortest=5).collect()}
    assert long == {(d, i) for d, i in want if n_words(dict(items)[i]) >= 5}
    assert decontamination.contained(empty, bench).count() == decontamination.contained(docs, bench.limit(0)).count() == 0


def test_decontamination_of_large_sets(spark, monkeypatch):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(4000)]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(15, 60)))) for i in range(60)]
    docs = [(0, " ".join(t for _, t in items)), (1, " ".join(t for _, t in items[:7])), (2, items[3][1])]
    got = {(r.doc_id, r.item_id) for r in decontamination.contained(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {(0, i) for i in range(60)} | {(1, i) for i in range(7)} | {(2, 3)}


def test_passages(docs, empty, texts):
    got = passages.shared_passages(docs).collect()
    same = [i for i, t in enumerate(texts[0]) if t and texts[1] in t]
    flagged = {r.doc_id for r in got}
    assert set(same[1:]) <= flagged
    for r in got:
        a, b = ((texts[0][x] or "").lower().split() for x in (r.doc_id, r.ref_doc_id))
        assert r.identity >= 0.8 and r.end - r.start >= 30 and len(set(a[r.start : r.end]) & set(b[r.ref_start : r.ref_end])) >= 0.6 * len(set(a[r.start : r.end]))
    assert passages.shared_passages(empty).count() == 0


@pytest.mark.parametrize("between", [20, 60, 100, 125])
def test_two_passages_of_one_chain(spark, between):
    rng = random.Random(between)
    fresh = lambda n, kind: [f"{kind}{rng.randrange(10**9)}" for _ in range(n)]
    for first, second in ((60, 60), (200, 45)):
        head, foot = fresh(first, "h"), fresh(second, "f")
        docs = [[*fresh(9, f"d{i}"), *head, *fresh(between + i, f"m{i}"), *foot, *fresh(7, f"e{i}")] for i in range(2)]
        got = passages.shared_passages(spark.createDataFrame([(i, " ".join(d)) for i, d in enumerate(docs)], "doc_id long, text string")).collect()
        covered = {w for r in got for w in range(r.start, r.end)}
        assert {i for i, w in enumerate(docs[1]) if w in set(docs[0])} <= covered
        assert all(r.identity >= 0.8 and r.end - r.start >= 30 and r.agreeing == len(set(docs[1][r.start : r.end]) & set(docs[0][r.ref_start : r.ref_end])) for r in got)


def local_alignments(a, b):
    """Brute force: the best local alignments (agreeing words 1, edits -2) of the words of two texts, with 24 or more: [(start, end) in b]."""
    score = np.zeros((len(a) + 1, len(b) + 1))
    back = np.zeros(score.shape, dtype=np.int64)
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            ways = (0, score[i - 1, j - 1] + (1 if a[i - 1] == b[j - 1] else -2), score[i - 1, j] - 2, score[i, j - 1] - 2)
            back[i, j] = int(np.argmax(ways))
            score[i, j] = ways[back[i, j]]
    i, j = (int(v) for v in np.unravel_index(score.argmax(), score.shape))
    if score[i, j] < 24:
        return []
    end = j
    while back[i, j]:
        i, j = i - (back[i, j] in (1, 2)), j - (back[i, j] in (1, 3))
    return [(j, end)]


def covered_share(rows, texts_of, pairs):
    """Of the passages that brute force finds, the share whose words the rows cover to 0.8 in the second text."""
    spans = {}
    for r in rows:
        spans.setdefault(r.doc_id, set()).update(range(r.start, r.end))
        spans.setdefault(r.ref_doc_id, set()).update(range(r.ref_start, r.ref_end))
    hits = all_of = 0
    for i, j in pairs:
        for s, e in local_alignments(texts_of[i], texts_of[j]):
            if e - s >= 36:
                all_of += 1
                hits += len(set(range(s, e)) & spans.get(j, set())) >= 0.8 * (e - s)
    return hits, all_of


def test_edited_passages_against_brute_force(spark):
    rng = random.Random(21)
    common = ["the", "of", "and", "to", "in"]
    word = lambda: rng.choice(common) if rng.random() < 0.3 else f"w{rng.randrange(5000)}"

    def edited(passage, share):
        out = []
        for w in passage:
            x = rng.random()
            out += [] if x < share / 3 else [word()] if x < 2 * share / 3 else [w, word()] if x < share else [w]
        return out

    docs, pairs = [], []
    for g in range(40):
        passage = [word() for _ in range(rng.randint(45, 90))]
        for _ in range(2):
            docs.append([word() for _ in range(rng.randint(0, 50))] + edited(passage, (0, 0.03, 0.06, 0.1)[g % 4] / 2) + [word() for _ in range(rng.randint(0, 50))])
        pairs.append((len(docs) - 2, len(docs) - 1))
    got = passages.shared_passages(spark.createDataFrame([(i, " ".join(d)) for i, d in enumerate(docs)], "doc_id long, text string")).collect()
    hits, all_of = covered_share(got, docs, pairs)
    assert all_of >= 30 and hits >= 0.9 * all_of
    assert {(r.ref_doc_id, r.doc_id) for r in got} <= set(pairs)  # nothing that isn't planted


def test_a_passage_whose_pieces_are_elsewhere_too(spark):
    rng = random.Random(4)
    fresh = lambda n: [f"x{rng.randrange(10**9)}" for _ in range(n)]
    for others in (3, 30):  # pieces that are rare, and pieces that are common
        passage, docs = fresh(60), []
        for at in (0, 20, 40):
            docs += [[*fresh(20), *passage[at : at + 20], *fresh(20)] for _ in range(others)]
        docs += [[*fresh(30), *passage, *fresh(25)] for _ in range(2)]
        got = passages.shared_passages(spark.createDataFrame([(i, " ".join(d)) for i, d in enumerate(docs)], "doc_id long, text string")).collect()
        n = len(docs)
        mine = [r for r in got if r.doc_id == n - 1 and r.ref_doc_id == n - 2]
        assert mine and max(r.end - r.start for r in mine) == 60 and all((r.start, r.end) == (30, 90) for r in mine)


def test_a_passage_whose_pieces_stand_apart_in_the_same_documents(spark):
    """Eight documents have three pieces of 20 words far from each other, two have them in a row: in all of 12 draws the two meet, or meet one that has all 60 words."""
    rows, n = [], 0
    for draw in range(12):
        rng = random.Random(draw)
        word = lambda: f"{draw}w{rng.randrange(10**6)}"  # noqa: E731, B023
        text = lambda k: [word() for _ in range(k)]  # noqa: E731, B023
        pieces = [text(20) for _ in range(3)]
        for _ in range(8):
            rows.append((draw * 1000 + n % 8, " ".join([*text(10), *pieces[0], *text(80), *pieces[1], *text(80), *pieces[2], *text(10)])))
            n += 1
        edit = text(1) if draw % 3 == 0 else []
        rows += [(draw * 1000 + 100, " ".join([*text(40), *sum(pieces, []), *text(40)])), (draw * 1000 + 101, " ".join([*text(30), *pieces[0], *edit, *pieces[1], *pieces[2], *text(50)]))]
    got = passages.shared_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    for draw in range(12):
        mine = [r for r in got if (r.doc_id, r.ref_doc_id) == (draw * 1000 + 101, draw * 1000 + 100)]
        assert mine and max(r.agreeing for r in mine) >= 58, draw


def test_many_documents_share_passages(spark):
    rng = random.Random(5)
    fresh = lambda n: [f"y{rng.randrange(10**9)}" for _ in range(n)]
    head, foot = fresh(45), fresh(50)
    docs = [[*(head if i % 3 else fresh(5)), *fresh(40 + i % 7), *(foot if i % 2 else [])] for i in range(60)] + [[*head, *fresh(9)]] * 3
    got = passages.shared_passages(spark.createDataFrame([(i, " ".join(d)) for i, d in enumerate(docs)], "doc_id long, text string")).collect()
    spans = {}
    for r in got:
        spans.setdefault(r.doc_id, set()).update(range(r.start, r.end))
        spans.setdefault(r.ref_doc_id, set()).update(range(r.ref_start, r.ref_end))
    for i, d in enumerate(docs[:60]):
        want = (set(range(45)) if i % 3 else set()) | (set(range(len(d) - 50, len(d))) if i % 2 else set())
        assert spans.get(i, set()) == want
    assert {(r.doc_id, r.ref_doc_id) for r in got if r.ref_doc_id == 60} == {(61, 60), (62, 60)} and spans[60] >= set(range(54))


def test_pairs_kept():
    rng = np.random.default_rng(2)
    for _ in range(200):
        a, b = (rng.integers(0, 5, rng.integers(0, 14)).astype(np.uint32) for _ in range(2))
        got = passages.pairs_kept(a, b)
        assert len(got) == passages.agreeing(a, b) and all(a[i] == b[j] for i, j in got)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(got, got[1:], strict=False))


def spans_by_force(rows):
    seen, want = set(), {}
    for d, t in rows:
        b = t.encode()
        goes = bytearray(len(b))
        for i in range(len(b) - 99):
            if b[i : i + 100] in seen:
                goes[i : i + 100] = b"\1" * 100
            seen.add(b[i : i + 100])
        kept = bytes(x for x, y in zip(b, goes, strict=True) if not y)
        want[d] = (len(b), sum(goes), len(bytes(goes).replace(b"\0", b" ").split()), hashlib.sha256(kept).hexdigest())
    return want


def test_exact_spans(docs, empty):
    want = spans_by_force(sorted({(r.doc_id if r.doc_id is not None else -1, r.text or "") for r in docs.collect()}))
    got = exactspans.remove_repeats(docs).collect()
    assert len(got) == docs.count()
    assert {(r.doc_id if r.doc_id is not None else -1): (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == want
    assert sum(w[1] for w in want.values()) > 400
    assert exactspans.remove_repeats(empty).count() == 0


@pytest.mark.parametrize("crowded", [2, 20_000])
def test_exact_spans_of_crowded_anchors(spark, monkeypatch, crowded):
    """Strings that stand in many different surroundings, compared in their collection and by a shuffle."""
    monkeypatch.setattr(exactspans, "CROWDED", crowded)
    rng = random.Random(8)
    noise = lambda n: "".join(rng.choice("abcdefghij \n") for _ in range(n))
    lines = [noise(n) for n in (70, 99, 100, 101, 150, 400)]
    rows = [(i, "".join(x for _ in range(rng.randint(0, 5)) for x in (noise(rng.randint(0, 90)), rng.choice(lines)))) for i in range(60)]
    rows += [(-(1 << 63), lines[-1] + "x"), (100, "a" * 700), (101, "a" * 350 + "b" + "a" * 350), (102, ("ab" * 300)), (103, "é" * 120 + lines[3])]
    got = exactspans.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == spans_by_force(sorted(rows))


def test_extraction(spark):
    page = "<body><nav>Menu</nav><article><h1>T{0}</h1><p>Text &eacute; {0}</article><div class=share>Share</div></body>"
    rows = [(i, f"http://h{i % 3}.org/x", page.format(i), "host", "w") for i in range(12)] + [(12, None, None, "h", "w"), (13, "not a url", "", "h", "w"), (None, "http://h1.org", "x & y", "h", "w")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host string, wrapper string")
    got = {r.page_id: r for r in extraction.main_text(df).collect()}
    assert all(got[i].text == f"T{i}\nText é {i}" and got[i].n_chars == len(got[i].text) for i in range(12))
    assert got[12].text == got[13].text == "" and got[None].text == "x & y"
    assert extraction.main_text(df.limit(0)).count() == 0


def test_extraction_of_the_tables_against_their_articles(spark):
    """The pages of the smallest tables are plain: the article element's blocks, read by a regular expression."""
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").union(spark.read.parquet("/root/testdata/sf0.01/pages.parquet").withColumn("page_id", F.col("page_id") + 10**6))
    import html as h

    got, n = {r.page_id: r for r in extraction.main_text(pages.repartition(5)).collect()}, 0
    for r in pages.collect():
        inner = re.search(r"<article>(.*)</article>", r.html or "", re.S)
        if inner:
            blocks = re.split(r"</?(?:p|h1|h2|ul|li|div|blockquote)(?:\s[^>]*)?>", inner[1])
            want = [t for t in (" ".join(h.unescape(re.sub(r"<[^>]*>", "", b.replace("<br>", " "))).split()) for b in blocks) if t]
            assert got[r.page_id].text.split("\n") == want and got[r.page_id].n_chars == len(got[r.page_id].text)
            n += 1
    assert n > 200


def test_mixing(docs, empty):
    got = mixing.mix(docs).collect()
    assert len(got) == docs.count()
    sizes, taken, goal = Counter(), Counter(), {}
    for r in got:
        sizes[r.source] += r["size"]
        taken[r.source] += r.taken
        goal[r.source] = r.target
        assert 0 <= r.taken <= 3 * r["size"]
    assert sum(sizes.values()) == sum(n_words(r.text) for r in docs.collect())
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, free, left = {}, set(order), float(sum(sizes.values()))
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * sizes[s]}
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
        free -= over
    assert all(math.isclose(goal[s], target[s], abs_tol=1e-6) and taken[s] == math.floor(goal[s]) for s in order)
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.before)
    assert sorted(got, key=key) == sorted(mixing.mix(docs.repartition(5)).collect(), key=key)
    assert mixing.mix(empty).count() == 0


def test_language_model(docs, empty):
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 7 == 2
    got = classlm.score(docs, held).collect()
    rows = docs.collect()
    out = lambda r: zlib.crc32(str("" if r.doc_id is None else r.doc_id).encode()) % 7 == 2
    counts = Counter()
    for r in rows:
        if not out(r):
            counts.update([*(r.text or "").encode().lower().split(), b"\n"])
    n, v = sum(counts.values()), len(counts)
    want = Counter()
    for r in rows:
        toks = [*(r.text or "").encode().lower().split(), b"\n"]
        base = sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in toks)
        want[(r.doc_id, out(r), len(toks), sum(counts[t] > 0 for t in toks), n, round(base, 6))] += 1
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)
    assert classlm.score(empty, held).count() == 0
    alone = classlm.score(docs, F.lit(True)).collect()
    assert all(r.train_tokens == 0 and r.n_known == 0 for r in alone)


def test_language_model_adds_up(docs):
    _, _, counts, types = classlm.train(docs.where("doc_id < 30"), text_col="text")
    by_class = counts.sum(0)
    share = (by_class + 1) / (by_class.sum() + classlm.CLASSES)
    move = (counts + classlm.WEIGHT * share) / (counts.sum(1)[:, None] + classlm.WEIGHT)
    assert np.allclose(move.sum(1), 1) and by_class.sum() == counts.sum() and types.sum() > 50
    # all seen types and one unseen type: (sum of c + 1, plus 1) / room is one in each class
    room = by_class + types + 1
    assert np.allclose((by_class + types) / room + 1 / room, 1)


@pytest.mark.parametrize(("held_tokens", "often"), [(2_000_000, 256), (500, 3), (90, 40)])
def test_language_model_scores_against_brute_force(docs, monkeypatch, held_tokens, often):
    """The scores from the classes and counts, in plain Python; blocks of any size, and texts over several of them, give the same."""
    monkeypatch.setattr(classlm, "HELD_TOKENS", held_tokens)
    monkeypatch.setattr(classlm, "OFTEN", often)
    held = F.coalesce(F.col("doc_id") % 5 == 2, F.lit(False))
    rows = [(r.doc_id, r.doc_id is not None and r.doc_id % 5 == 2, classlm.tokens((r.text or "").encode())) for r in docs.collect()]
    table, _, counts, types = classlm.train(docs.where(~held))
    cls, c, pairs = {}, Counter(), Counter()
    for r in table.collect():
        cls[bytes(r.w)], c[bytes(r.w)] = r.cls, r.c
    train = [t for _, out, t in rows if not out]
    assert c == Counter(w for t in train for w in t)
    for t in train:
        pairs.update(zip([classlm.START, *(cls[w] for w in t)], [cls[w] for w in t], strict=False))
    assert {(i, j): n for (i, j), n in np.ndenumerate(counts) if n} == pairs
    n, k = sum(c.values()), classlm.CLASSES
    of_class = Counter(cls[w] for t in train for w in t)
    of_context = Counter()
    for (i, _), x in pairs.items():
        of_context[i] += x
    share = [(of_class[j] + 1) / (n + k) for j in range(k)]
    move = lambda i, j: (pairs[i, j] + classlm.WEIGHT * share[j]) / (of_context[i] + classlm.WEIGHT)
    want = Counter()
    for doc_id, out, t in rows:
        total, before = 0.0, classlm.START
        for w in t:
            if w in c:
                total += math.log10(move(before, cls[w]) * (c[w] + 1) / (of_class[cls[w]] + types[cls[w]] + 1))
                before = cls[w]
            else:
                total += math.log10(sum(move(before, j) / (of_class[j] + types[j] + 1) for j in range(k)))
                before = classlm.OTHER
        want[doc_id, out, len(t), sum(w in c for w in t), n, round(total, 5)] += 1
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.score, 5)) for r in classlm.score(docs, held).collect()) == want


def test_language_model_is_better_than_its_base_on_held_out_texts(spark):
    rng = random.Random(2)
    nouns, verbs = [f"n{i}" for i in range(150)], [f"v{i}" for i in range(150)]
    text = lambda: " ".join(w for _ in range(rng.randint(3, 9)) for w in ("the", rng.choice(nouns), rng.choice(verbs), "a", rng.choice(nouns)))
    df = spark.createDataFrame([(i, text()) for i in range(600)], "doc_id long, text string")
    got = classlm.score(df, F.col("doc_id") % 4 == 0).where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b"), F.sum("n_tokens").alias("n")).first()
    assert got.s > got.b + 0.4 * got.n  # over a factor of 2.5 in perplexity


def test_language_model_contexts_are_all_tokens(spark):
    rng = random.Random(11)
    # two kinds of rare words in turn: every token is a context by its class, and after a word of one kind comes the other
    rows = [(i, " ".join(f"{'xy'[j % 2]}{rng.randrange(300)}" for j in range(20))) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    table, history, counts, types = classlm.train(df)
    cls, c = {bytes(r["w"]): r["cls"] for r in table.collect()}, Counter()
    for _, t in rows:
        at = [classlm.START, *(cls[w] for w in classlm.tokens(t.encode()))]
        c.update(zip(at[:-1], at[1:], strict=True))
    assert {(i, j): n for (i, j), n in np.ndenumerate(counts) if n} == c and types.sum() == len(cls)
    assert max(history) > history[0] and math.isclose(classlm.likelihood(counts), max(history))
    # a context that tells the kinds apart is worth log 2 for each of the 19 pairs of a text
    assert max(history) - history[0] > 0.8 * 300 * 19 * math.log(2)


def test_toxicity(spark, docs, empty):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(20)) + (" awfulword" if i % 4 == 0 else "")) for i in range(200)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(0, 120)] + [(5, None), (None, 1), (9999, 1)], "doc_id long, toxic int")
    s = toxicity.Settings(buckets=1 << 12, max_rows=100)
    m = toxicity.train(d, labels, F.col("doc_id") < 100, s)
    got = {r.doc_id: r.score for r in toxicity.score(d, m, score_col="p").withColumnRenamed("p", "score").collect()}
    assert all((got[i] > 0.5) == (i % 4 == 0) for i in range(100, 200))
    assert toxicity.score(docs, m, score_col="_s").count() == docs.count() and toxicity.score(empty, m, score_col="_s").count() == 0
    none = toxicity.train(d, labels.limit(0), F.lit(True), s)
    assert {r.score for r in toxicity.score(d, none).select("score").distinct().collect()} != set()


def test_the_toxicity_sample_is_bounded(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(toxicity, "fit", lambda texts, labels, s, prior: seen.append((texts, labels, prior)) or toxicity.Model(np.zeros((8, 2)), np.zeros((2, 2)), np.zeros(2), s))
    rows = [(1, "the same row")] * 3000 + [(2, f"text {i}") for i in range(3000)] + [(i, "x" * 100) for i in range(3, 40)] + [(40, "y" * 5000), (41, None), (None, "no id")]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    labels = spark.createDataFrame([(i, int(i % 4 == 1)) for i in range(1, 42)] + [(2, 0), (None, 1)], "doc_id long, toxic int")
    s = toxicity.Settings(max_rows=100, max_bytes=4000)
    toxicity.train(d, labels, F.lit(True), s)
    texts, y, prior = seen[-1]
    assert 50 <= len(texts) <= 100 and sum(len(t) for t in texts) <= 4000 and {0, 1} == set(y) and "y" * 5000 not in texts
    want = sum(1 for i, _ in rows if i is not None and i % 4 == 1), sum(2 if i == 2 else 1 for i, _ in rows if i is not None)
    assert math.isclose(prior, want[0] / want[1])
    toxicity.train(d.repartition(3), labels, F.lit(True), s)
    assert seen[-1] == seen[-2]
    toxicity.train(d, labels.where("toxic = 0"), F.lit(True), s)
    assert set(seen[-1][1]) == {0} and seen[-1][2] == 0.0


def test_the_driver_gets_no_texts_of_the_toxicity_sample(spark, monkeypatch):
    """A task draws and fits; the model is the one that the driver would fit, and no row of the sample comes to the driver."""
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(20)) + (" awfulword" if i % 4 == 0 else "")) for i in range(120)] + [(7, None), (None, "no id")]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(100)] + [(8, 0)], "doc_id long, toxic int")
    s = toxicity.Settings(buckets=1 << 10, max_rows=60, max_bytes=4000)
    here = toxicity.train(d, labels, F.lit(True), s)
    got, collect = [], type(d).collect
    monkeypatch.setattr(type(d), "collect", lambda self: got.append((self.columns, rows := collect(self))) or rows)
    there = toxicity.train(d, labels, F.lit(True), s, in_task=True)
    assert [(c, len(r)) for c, r in got] == [(["_y", "n"], 2), (["gain", "bias"], 1)]
    assert np.allclose(there.gain, here.gain, atol=1e-6) and math.isclose(there.bias, here.bias, abs_tol=1e-9) and there.gain.any()
    none = toxicity.train(d, labels.limit(0), F.lit(True), s, in_task=True)
    assert none.bias == toxicity.train(d, labels.limit(0), F.lit(True), s).bias and not none.gain.any()
