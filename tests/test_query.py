"""Golden semantics of filters, sorts, samples, pages and aggregates, held against plain Python."""

import itertools
import json

import pytest
from pyspark.sql import functions as F

from tessera.functions import scalars
from tessera.model import Field, Query, Snapshot, content_id
from tessera.plans import aggregate, query as plan
from tessera.plans.predicate import compile_filter, validate

ROWS = [("r0", 0, "s:A", 1.0, True, "Alpha BLUE"), ("r1", 1, "s:B", 2.0, False, "beta"), ("r2", 2, "s:A", None, None, None), ("r3", 3, None, 4.0, True, "Straße .* α")]


@pytest.fixture(scope="module")
def snap(spark):
    rows = spark.createDataFrame(ROWS, "id string, row_ordinal long, f_0 string, f_1 double, f_2 boolean, text string").withColumn("search_text", F.lower(F.coalesce("text", F.lit(""))))
    fields = [Field("source.label", "category", "f_0", kinds=frozenset("s")), Field("source.score", "number", "f_1"), Field("source.flag", "boolean", "f_2"), Field("source.meta.key", "string", "text")]
    return Snapshot(rows, {f.id: f for f in fields}, "s1")


def leaf(field, op, value):
    return {"field_id": field, "op": op, "value": value}


def ids(snap, **kw):
    return [r.id for r in plan.run(snap, Query("s1", **kw)).rows.orderBy("position").collect()]


@pytest.mark.parametrize(("tree", "want"), [
    (leaf("source.score", "is_null", True), ["r2"]),
    (leaf("source.score", "ne", 0), ["r0", "r1", "r3"]),
    ({"not": leaf("source.score", "eq", 1)}, ["r1", "r2", "r3"]),
    (leaf("source.label", "contains", ".*"), []),
    (leaf("source.meta.key", "contains", ".*"), ["r3"]),
    (leaf("source.meta.key", "contains", "STRASSE"), []),
    ({"or": [leaf("source.label", "eq", "A"), leaf("source.score", "gt", 3)]}, ["r0", "r2", "r3"]),
    (leaf("source.label", "eq", 1), []),
    (leaf("source.label", "in", []), []),
    (leaf("source.label", "in", [None, "B"]), ["r1"]),
    (leaf("source.flag", "eq", True), ["r0", "r3"]),
    (leaf("source.score", "eq", None), []),
])
def test_filters(snap, tree, want):
    assert ids(snap, filter=tree) == want


@pytest.mark.parametrize("tree", [
    leaf("source.score", "eq", "1"), leaf("source.flag", "gt", True), leaf("source.label", "gt", 1), leaf("nowhere", "eq", 1), leaf("source.score", "like", 1),
    {"and": []}, {"and": [leaf("source.score", "eq", 1)], "or": []}, leaf("source.score", "eq", 2**60), leaf("source.score", "is_null", 1), {"field_id": "source.score", "op": "eq", "value": 1, "sql": "x"},
    leaf("source.score", "eq", float("nan")), leaf("source.label", "in", list(range(1001))),
])
def test_refused(snap, tree):
    with pytest.raises(ValueError):
        compile_filter(tree, snap.columns)


def test_depth_and_nodes(snap):
    deep = leaf("source.score", "eq", 1)
    for _ in range(10):
        deep = {"not": deep}
    for tree in (deep, {"or": [leaf("source.score", "eq", 1)] * 64}):
        with pytest.raises(ValueError):
            validate(tree, snap.columns)


def test_sort_has_missing_values_last(snap):
    assert ids(snap, sort=({"field_id": "source.score", "direction": "desc"},)) == ["r3", "r1", "r0", "r2"]
    assert ids(snap, sort=({"field_id": "source.score"},))[-1] == "r2"
    assert ids(snap) == ["r0", "r1", "r2", "r3"]
    assert ids(snap, search="BLUE") == ["r0"]


def test_pages_and_cursors(snap):
    q = Query("s1", limit=3)
    one = plan.run(snap, q)
    assert (one.matched_count, one.returned_count) == (4, 3)
    two = plan.run(snap, Query("s1", limit=3, cursor=one.cursor))
    assert [r.id for r in two.rows.collect()] == ["r3"] and two.cursor is None
    with pytest.raises(ValueError):
        plan.run(snap, Query("s1", limit=3, search="x", cursor=one.cursor))
    with pytest.raises(ValueError):
        plan.run(snap, Query("other"))


def fnv(text):
    h = 2166136261
    for b in text.encode():
        h = (h ^ b) * 16777619 & 0xFFFFFFFF
    return h


def test_fnv(spark):
    words = ["hello", "héllo", "", "a:b", "-17:α"]
    got = spark.createDataFrame([(w,) for w in words], "w string").select("w", scalars.fnv1a(F.col("w")).alias("h")).collect()
    assert {r.w: r.h for r in got} == {w: fnv(w) for w in words}
    assert fnv("hello") == 1335831723


def test_samples_against_python(spark):
    rows = [(f"toy:{i:04d}", i, None if i % 7 == 0 else f"s:{i % 5}") for i in range(300)]
    df = spark.createDataFrame(rows, "id string, row_ordinal long, f_0 string").withColumn("search_text", F.lit(""))
    snap = Snapshot(df.repartition(7), {"source.g": Field("source.g", "category", "f_0", kinds=frozenset("s"))}, "t")
    rank = lambda i: (fnv(f"-17:{i}"), i)
    got = [r.id for r in plan.run(snap, Query("t", limit=37, sample={"method": "random", "seed": -17, "size": 37})).rows.orderBy("position").collect()]
    assert got == sorted((r[0] for r in rows), key=rank)[:37]
    strata = {}
    for r in sorted(rows, key=lambda r: rank(r[0])):
        strata.setdefault(json.dumps(r[2] and r[2][2:]), []).append(r[0])
    turns = [x for t in itertools.zip_longest(*(strata[k] for k in sorted(strata))) for x in t if x]
    got = [r.id for r in plan.run(snap, Query("t", limit=37, sample={"method": "stratified", "field_id": "source.g", "seed": -17, "size": 37})).rows.orderBy("position").collect()]
    assert got == turns[:37]


def test_numeric_categories(spark):
    df = spark.createDataFrame([("a", 0, "n:2.0"), ("b", 1, "n:10.0"), ("c", 2, "n:1.0")], "id string, row_ordinal long, f_0 string").withColumn("search_text", F.lit(""))
    snap = Snapshot(df, {"source.label": Field("source.label", "category", "f_0", kinds=frozenset("n"))}, "s1")
    assert ids(snap, sort=({"field_id": "source.label"},)) == ["c", "a", "b"]
    assert ids(snap, filter=leaf("source.label", "eq", 2)) == ["a"]
    assert ids(snap, filter=leaf("source.label", "eq", "2")) == []
    assert ids(snap, filter=leaf("source.label", "contains", "2")) == []
    mixed = Snapshot(df, {"source.label": Field("source.label", "category", "f_0", kinds=frozenset("ns"))}, "s1")
    with pytest.raises(ValueError):
        ids(mixed, sort=({"field_id": "source.label"},))


def test_aggregates(snap):
    n = aggregate.numeric(snap, Query("s1"), ["source.score"]).first()
    assert (n.denominator, n.missing, n.min, n.max, round(n.mean, 6)) == (4, 1, 1.0, 4.0, 2.333333)
    c = aggregate.categorical(snap, Query("s1"), ["source.label"], top=1).collect()
    assert [(r.value, r["count"], r.missing, r.truncated) for r in c] == [("A", 2, 1, True)]


def test_content_ids():
    assert content_id({"b": 1, "a": "é"}) == content_id({"a": "é", "b": 1}) and len(content_id([])) == 24
