"""Described tables, typed cells, previews, fitted vectors, filtered draws, tool search and byte budgets."""

import pytest
from pyspark.sql import functions as F

from tessera.model import Field
from tessera.operators import catalogue, sampling, vectors
from tessera.plans import query
from tessera.sources import files, snapshot


def test_integers_stay_integers_and_errors_name_the_row(spark, tmp_path):
    (tmp_path / "a.csv").write_text('n,x,b\n1,2.5,True\n,3,\n-7,4,false\n"9223372036854775807",,FALSE\n')
    df = files.read_csv(spark, str(tmp_path / "a.csv"), {"n": "number", "x": "number", "b": "boolean"})
    assert dict(df.dtypes) == {"n": "bigint", "x": "double", "b": "boolean"}
    assert [tuple(r) for r in df.collect()] == [(1, 2.5, True), (None, 3.0, None), (-7, 4.0, False), (2**63 - 1, None, False)]
    (tmp_path / "b.csv").write_text('n,t\n1,"two\nlines"\n2,x\nten,y\nx,z\n')
    with pytest.raises(ValueError, match=r"row 2 of .*b\.csv: column 'n' is not a number: 'ten'"):
        files.read_csv(spark, str(tmp_path / "b.csv"), {"n": "number"})
    (tmp_path / "c.csv").write_text("n\n99999999999999999999\n")
    assert dict(files.read_csv(spark, str(tmp_path / "c.csv"), {"n": "number"}).dtypes) == {"n": "double"}
    with pytest.raises(ValueError, match="unknown dtypes"):
        files.read_csv(spark, str(tmp_path / "c.csv"), {"n": "date"})


def test_described(spark):
    rows = [(f"k{i}", i % 3, ["red", "blue"][i % 2], f"p/{i}.png", "long text " * 5 + str(i), None if i % 4 else "true") for i in range(40)]
    df = spark.createDataFrame(rows, "key string, n int, colour string, file string, body string, flag string")
    got = {r.column: r for r in files.described(df, id_column="key", most_distinct=30).collect()}
    assert {c: (r.dtype, r.role) for c, r in got.items()} == {"key": ("string", "id"), "n": ("number", None), "colour": ("category", "label"), "file": ("string", "media"), "body": ("string", "text"), "flag": ("boolean", None)}
    assert got["flag"].missing == 30 and got["key"].distinct is None and got["n"].distinct == 3 and set(got["colour"].sample) == {"red", "blue"}
    for bad in ("n", "none"):
        with pytest.raises(ValueError):
            files.described(df, id_column=bad)


def test_previews(spark):
    asset = lambda i, m="image", u="x", t=None: (i, m, u, t)
    rows = [
        ("a", 0, "q", None, [asset("1", u="u1"), asset("1", u="again"), asset("2", "audio")], None, None), ("a", 1, None, None, [asset(str(i), u=f"v{i}") for i in range(3, 9)], None, None),
        ("b", 0, " ", "t" * 300, [], None, None), ("b", 1, None, None, [asset("9", "text", None, "from asset")], None, None), ("b", 2, "bad page", None, [], None, "error"), ("b", 3, None, None, None, [("user", " "), ("user", "said")], None),
        ("c", 0, None, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, "dataset_id string, row_ordinal int, question string, text string, assets array<struct<id: string, modality: string, uri: string, text: string>>, conversation array<struct<role: string, content: string>>, source_status string")
    got = {r.dataset_id: (r.kind, r.tiles, r.modality) for r in catalogue.previews(df).collect()}
    assert got == {"a": ("image", ["u1", "v3", "v4", "v5"], "image"), "b": ("text", ["t" * 220, "from asset", "said"], "text"), "c": (None, [], None)}
    plain = catalogue.previews(df.select("dataset_id", "row_ordinal", "question", "text")).collect()
    assert {r.dataset_id: (r.kind, len(r.tiles)) for r in plain} == {"a": ("text", 1), "b": ("text", 2), "c": (None, 0)}


def test_fitted(spark):
    selection = spark.createDataFrame([(2, "c"), (0, "a"), (1, "b"), (3, "a")], "ord int, id string")
    v = spark.createDataFrame([("a", [1.0, 2.0]), ("c", [3.0, 4.0]), ("z", [5.0])], "id string, vector array<double>")
    have, lack = vectors.fitted(selection, v, space="s", run="r")
    assert [(r.ord, r.id, r.vector[0]) for r in have.collect()] == [(0, "a", 1.0), (2, "c", 3.0), (3, "a", 1.0)] and [tuple(r) for r in lack.collect()] == [(1, "b")]
    z = spark.createDataFrame([("b", [float("nan"), 0.0])], v.schema)
    for bad in (v.where("id = 'z'"), v.union(z), v.union(spark.createDataFrame([("b", [1.0])], v.schema))):
        with pytest.raises(ValueError):
            vectors.fitted(selection, bad, space="s", run="r")
    with pytest.raises(ValueError):
        vectors.fitted(selection, v, space="", run="r")


def test_filtered_draws(spark, tmp_path):
    path = str(tmp_path / "p")
    spark.range(3000).repartitionByRange(2, "id").write.option("parquet.block.size", 5000).option("parquet.block.size.row.check.min", 100).parquet(path)
    whole = sampling.draw_row_groups(spark, path, 2000, 4, 10**9).orderBy("nth").collect()
    got = sampling.draw_filtered(spark, path, 25, 4, 10**9, F.col("id") % 10 == 3).orderBy("nth").collect()
    assert [r.id for r in got] == [r.id for r in whole if r.id % 10 == 3][:25]
    with pytest.raises(ValueError, match="asked for"):
        sampling.draw_filtered(spark, path, 25, 4, 10**9, F.col("id") < 20)
    with pytest.raises(ValueError, match="asked for"):
        sampling.draw_filtered(spark, path, 25, 4, 10**9, F.col("id") % 10 == 3, max_candidates=100)


def test_tool_search(spark):
    df = spark.createDataFrame([("a", "The Cat", None), ("b", None, "a cat?"), ("c", "dog", "x"), ("d", "caT", "x")], "id string, text string, question string")
    ids = lambda d: sorted(r.id for r in d.collect())
    approved = spark.createDataFrame([("a",), ("c",), ("a",)], "id string")
    assert ids(query.tool_search(df, "CAT")) == ["a", "b", "d"] and ids(query.tool_search(df, "cat", approved)) == ["a"] and ids(query.tool_search(df, "", approved)) == ["a", "c"]


def test_a_snapshot_within_bytes(spark, tmp_path):
    rows = spark.range(100).select(F.concat(F.lit("r"), F.lpad("id", 3, "0")).alias("id"), F.col("id").cast("double").alias("f_0"))
    size = len('{"id":"r000","f_0":0.0}')
    s = snapshot.build(rows.repartition(4), {"source.n": Field("source.n", "number", "f_0")}, str(tmp_path / "s"), snapshot_id="s", unit="example", max_bytes=size * 10)
    assert sorted(r.id for r in s.records.collect()) == [f"r{i:03}" for i in range(10)] and s.count == 10


def test_medians_from_sketches(spark):
    from tessera.plans import aggregate

    df = spark.range(9001).select((F.col("id") % 2).alias("g"), (F.col("id") * 1.0).alias("v"))
    exact = {r.group_value: r for r in aggregate.grouped_numeric(df, "g", "v").collect()}
    for r in aggregate.grouped_numeric(df, "g", "v", accuracy=500).collect():
        assert abs(r.median - exact[r.group_value].median) <= 9001 / 500 + 2 and r["count"] == exact[r.group_value]["count"]
