"""The pipeline's stages on a small corpus, each on its own input, against brute force."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import mixing, simhash, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))


def shingle_set(t, k=5):
    w = words(t)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(11)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 8))) for _ in range(500)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [text(25) for _ in range(6)]
    texts = [text(rng.randint(30, 150)) for _ in range(120)]
    for i in range(40):
        texts.append(text(60) + " vileword " + text(20) + " vileword")
    base = text(120).split()
    for _ in range(20):  # near copies: one word changed, at most 10 of 126 shingles apart
        copy = list(base)
        copy[rng.randrange(len(copy))] = "changed"
        texts.append(" ".join(copy))
    texts += [texts[0]] * 4
    texts += [text(50) + " " + it.upper() + " " + text(30) for it in items]
    texts += ["", None, None, "one", text(4000)]
    rows = [(i, t, "en", ("a", "b", None, "c")[i % 4 if i % 3 else 0], 7) for i, t in enumerate(texts)] + [(None, text(40), "en", "b", 1), (3, texts[3], "en", "c", 2)]
    d = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([*enumerate(items), (90, None), (None, text(30))], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame([(i, 1, int(120 <= i < 160)) for i in range(0, 160)] + [(None, 1, 1), (5000, 0, None)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d, spark.read.parquet(f"{d}/documents.parquet"), items


def counted(df):
    return Counter(tuple(r) for r in df.collect())


def test_near_copies_against_all_pairs(corpus):
    _, docs, _ = corpus
    rows = [r for r in docs.collect() if r.doc_id is not None]
    sets = [shingle_set(r.text) for r in rows]
    at = list(range(len(rows)))

    def root(i):
        while at[i] != i:
            i = at[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both >= 0.8 * len(sets[i] | sets[j]):
                at[max(root(i), root(j))] = min(root(i), root(j))
    got = simhash.near_copies(docs.where("doc_id is not null"))
    of = {}
    for r in got.collect():
        of.setdefault(r.root, set()).add(r.doc_id)
    want = {}
    for i, r in enumerate(rows):
        want.setdefault(root(i), set()).add(r.doc_id)
    assert sorted(map(sorted, of.values())) == sorted(map(sorted, want.values()))


def roots_of(sets, similarity=0.8):
    at = list(range(len(sets)))

    def root(i):
        while at[i] != i:
            i = at[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and both >= similarity * len(sets[i] | sets[j]):
                at[max(root(i), root(j))] = min(root(i), root(j))
    return [root(i) for i in range(len(sets))]


def test_near_copies_right_at_the_threshold(spark, monkeypatch):
    """Families of variants around 0.8, and very short texts, where 0.8 is a word more or less; groups in several pieces."""
    monkeypatch.setattr(simhash, "SETS", 16)
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(10**6)}"
    texts = []
    for _ in range(12):  # a base of 100 words; each variant has 1 or 2 words changed, so that two have a similarity of 0.81 or less
        base = [word() for _ in range(100)]
        for n in range(25):
            v = list(base)
            for at in rng.sample(range(100), 1 + n % 2):
                v[at] = word()
            texts.append(v)
    for n in range(5, 34):  # one word more
        base = [word() for _ in range(n)]
        texts += [base, [*base, word()], [word(), *base]]
    texts += [[], ["one"], ["one"], ["two"], ["a", "b"], ["a", "b", "c"]]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    want, got = {}, {}
    for i, r in enumerate(roots_of([shingle_set(" ".join(t)) for t in texts])):
        want.setdefault(r, set()).add(i)
    for r in simhash.near_copies(df).collect():
        got.setdefault(r.root, set()).add(r.doc_id)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))
    assert len(want) < len(texts) - 100


def test_stages(spark, corpus, monkeypatch):
    d, docs, items = corpus
    monkeypatch.setattr(toxicity.Settings, "epochs", 30, raising=False)
    stages = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "mixing", "sharding"]

    clean = stages["toxicity"](spark, docs, d)
    assert clean.schema == docs.schema and not counted(clean) - counted(docs)

    unique = stages["near_duplicates"](spark, docs, d)
    assert unique.schema == docs.schema and not counted(unique) - counted(docs)
    ids = {r.doc_id for r in unique.collect()}
    assert {160} == ids & set(range(160, 180)) and {0} == ids & {0, 180, 181, 182, 183} and set(range(1, 120)) <= ids

    apart = stages["decontamination"](spark, docs, d)
    want = Counter()
    for r in docs.collect():
        if not any(len(shingle_set(r.text) & shingle_set(t)) >= 0.8 * len(shingle_set(t)) for t in items):
            want[tuple(r)] += 1
    assert counted(apart) == want and sum(want.values()) == docs.count() - 6

    mixed = stages["mixing"](spark, docs, d)
    goal = {r.source: int(r.target) for r in mixing.mix(docs).select("source", "target").distinct().collect()}
    size = {s: Counter() for s in goal}
    for r in docs.collect():
        size[r.source][tuple(r)] = len(words(r.text))
    got = counted(mixed)
    assert mixed.schema == docs.schema and set(got) <= set(counted(docs))
    for s, own in size.items():  # whole epochs of each source, and then some of its documents once more
        epochs, total = goal[s] // sum(own.values()), sum(n * got[k] for k, n in own.items())
        assert goal[s] <= total < goal[s] + max(own.values()) and {got[k] for k, n in own.items() if n} <= {epochs, epochs + 1}

    sharded = stages["sharding"](spark, docs, d)
    assert counted(sharded.select(*docs.columns)) == counted(docs)
    for s in range(16):
        slots = sorted(r.slot for r in sharded.where(F.col("shard") == s).collect())
        assert slots == list(range(len(slots)))


def test_stages_survive_nulls_and_clashing_names(spark, corpus):
    d, docs, _ = corpus
    names = ["row", "doc", "id", "_id", "_n", "_m", "times", "kept", "leak", "score", "shard", "slot", "taken", "size", "node", "root"]
    odd = spark.createDataFrame([(None, None, None, None, None), (None, "", "en", None, 0), (1, None, None, "a", None), (1, None, None, "a", None), (2, "some words here", None, None, 3)], SCHEMA)
    wide = docs.limit(30).unionByName(odd).withColumns({n: F.lit(i) for i, n in enumerate(names)})
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, wide, d)
        assert set(out.columns) == set(wide.columns) and out.count() > 0, name
        if name != "sharding":
            assert out.columns == wide.columns and not set(counted(out)) - set(counted(wide))
    assert counted(corpus_pipeline.pack_shards(spark, odd, d).select(*odd.columns)) == counted(odd)


def test_run_is_its_stages_and_survives_an_empty_table(spark, corpus, tmp_path):
    d, docs, _ = corpus
    out = corpus_pipeline.run(spark, d)
    assert set(out.columns) == {*docs.columns, "shard", "slot"} and out.count() > 50
    kept = {r.doc_id for r in out.collect()}
    assert not kept & set(range(161, 180)) and not kept & {181, 182, 183}
    e = str(tmp_path)
    docs.limit(0).write.parquet(f"{e}/documents.parquet")
    for t in ("benchmark", "labels"):
        spark.read.parquet(f"{d}/{t}.parquet").limit(0).write.parquet(f"{e}/{t}.parquet")
    assert corpus_pipeline.run(spark, e).count() == 0
