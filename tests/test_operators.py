import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.model import Field
from tessera.operators import catalogue, joins, metric, results, sampling, selections, sets, subsets, vectors
from tessera.registry import CONVERTERS, PROCESSORS, Registry
from tessera.sources import binary, files, mapping, snapshot
from tessera.streaming import incremental


def test_strict_join(spark):
    left, right = spark.createDataFrame([(1, "a"), (2, "b")], "k int, x string"), spark.createDataFrame([(1, "p"), (2, "q")], "j int, y string")
    assert joins.strict_join(left, right, ["k"], ["j"]).count() == 2
    for bad in (right.where("j = 1"), right.union(right), right.union(spark.createDataFrame([(9, "z")], right.schema)), right.withColumnRenamed("y", "x")):
        with pytest.raises(ValueError):
            joins.strict_join(left, bad, ["k"], ["j"])
    many = joins.strict_join(left, right.union(right), ["k"], ["j"], many="ys")
    assert [len(r.ys) for r in many.collect()] == [2, 2]


def test_overlay_keeps_all_rows(spark):
    base = spark.createDataFrame([(1,), (2,), (None,)], "k int")
    over = spark.createDataFrame([("1", "u"), ("1", "v"), ("7", "w")], "k string, v string")
    got = {r.k: len(r.overlay) for r in joins.overlay_join(base, over, "k", "k").collect()}
    assert got == {1: 2, 2: 0, None: 0}
    report = {r.check: r.rows for r in joins.overlay_report(base, over, "k", "k").collect()}
    assert report == {"duplicate_base_keys": 0, "unmatched_overlay": 1, "multiply_matched_overlay": 0, "overlay_without_key": 0, "base_without_key": 1}


def test_samples_do_not_depend_on_order(spark):
    rows = spark.range(500).select(F.col("id"), (F.col("id") % 37).alias("g"))
    one = sampling.bottom_k(rows, "g", "id", 10, 3).orderBy("rank").collect()
    two = sampling.bottom_k(rows.orderBy(F.rand(1)).repartition(9), "g", "id", 10, 3).orderBy("rank").collect()
    assert one == two and len({r.g for r in one}) == 10
    kept = None
    for part in range(4):
        kept = incremental.merge_bottom_k(kept, rows.where(F.col("id") % 4 == part), "g", "id", 10, 3)
    assert sorted(r.id for r in kept.collect()) == sorted(r.id for r in one)


def test_components(spark):
    rows = [(i, i // 2) for i in range(12)] + [(i + 1, 100 + i) for i in (1, 3)] + [(i + 2, 100 + i) for i in (0, 1, 3)]
    want = {i: i for i in range(12)}
    for _ in range(20):
        for a in {x[1] for x in rows}:
            group = [x[0] for x in rows if x[1] == a]
            want |= dict.fromkeys(group, min(want[g] for g in group))
    got = sets.asset_components(spark.createDataFrame(rows, "r long, a long"), "r", "a").collect()
    assert {r.r: r.component for r in got} == want


def test_vectors_against_numpy(spark):
    rng = np.random.default_rng(52)
    x = rng.normal(size=(137, 11))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<double>")
    d = np.linalg.norm(x - x[5], axis=1)
    d[5] = np.inf
    got = [r.id for r in vectors.similar(df, record=5, k=13, metric="euclidean").collect()]
    assert got == np.argsort(d)[:13].tolist()
    full = np.linalg.norm(x[:, None] - x, axis=2)
    np.fill_diagonal(full, np.inf)
    score = {r.id: r.outlier_score for r in vectors.outlier_scores(df, 5).collect()}
    assert np.allclose([score[i] for i in range(137)], np.sort(full, axis=1)[:, 4])
    coords, shares = vectors.project(df, 2)
    c = x - x.mean(0)
    s = np.linalg.svd(c, full_matrices=False)
    got = np.array([r.coords for r in coords.orderBy("id").collect()])
    assert np.allclose(np.abs(got), np.abs(c @ s[2][:2].T), atol=1e-6) and np.allclose(shares, (s[1] ** 2 / (s[1] ** 2).sum())[:2])


def test_clusters(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(c, 0.1, size=(30, 3)) for c in (0, 4, 8)])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<double>")
    for labels in (vectors.k_means(df, 3, seed=1), vectors.density_clusters(df, 4, 1.0), vectors.merge_clusters(vectors.k_means(df, 9, seed=1), 3, "ward")):
        got = {r.id: r.cluster for r in labels.select("id", "cluster").collect()}
        assert len({got[i] for i in range(90)}) == 3 and all(got[i] == got[i // 30 * 30] for i in range(90))
    assert vectors.silhouette(vectors.k_means(df, 3, seed=1)) > 0.9


def test_answers(spark):
    rows = [("two  dogs.", ["2 dogs"] * 3 + ["a cat"] * 7, 0.9), ("Cat", ["Cat"] * 10, 1.0), ("x", ["y"] * 10, 0.0), ("the cat", ["cat", "dog"], (0 + 1 / 3) / 2)]
    df = spark.createDataFrame(rows, "c string, a array<string>, want double").select(text.vqa_accuracy(F.col("c"), F.col("a")).alias("got"), "want")
    assert all(abs(r.got - r.want) < 1e-12 for r in df.collect())
    one = spark.createDataFrame([('\n Final Answer: "blue" \nno',)], "t string").select(text.clean_answer(F.col("t")).alias("a"), text.json_reply(F.lit('so ```json\n{"v": 1}\n``` {"v": 2}'), "v int").alias("j")).first()
    assert one.a == "blue"


def test_detector_view(spark):
    box = [{"score": 0.9, "class": "person"}, {"score": 0.4, "class": "cat"}]
    asset = lambda s, h: {"status": s, "file_sha256": h, "asset_id": "x", "detections": box}
    rows = [(1, "completed", [asset("completed", "h"), asset("completed", "h")]), (2, "completed", [asset("completed", "h"), asset("failed", "i")]), (3, "failed", [])]
    df = spark.createDataFrame(rows, "id int, status string, assets array<struct<status: string, file_sha256: string, asset_id: string, detections: array<struct<score: double, class: string>>>>")
    got = {r.id: (r.detection_count, r.person_count) for r in results.detector_view(df, 0.5, 0.3).collect()}
    assert got == {1: (1, 1), 2: (None, None), 3: (None, None)}
    with pytest.raises(ValueError):
        results.detector_view(df, 0.2, 0.3)


def test_snapshot_round_trip(spark, tmp_path):
    rows = spark.range(200).select(F.concat(F.lit("r"), F.lpad("id", 4, "0")).alias("id"), (F.col("id") * 1.5).alias("f_0"), F.lit("").alias("search_text"))
    fields = {"source.score": Field("source.score", "number", "f_0")}
    s = snapshot.build(rows.repartition(5), fields, str(tmp_path / "s"), snapshot_id="s", unit="example", expected_count=200, order=["id"])
    assert [r.row_ordinal for r in s.records.orderBy("id").collect()] == list(range(200))
    assert snapshot.open_snapshot(spark, str(tmp_path / "s"), verify=True).count == 200
    for bad in (rows.union(rows.limit(1)), rows.withColumn("f_0", F.lit(float("nan")))):
        with pytest.raises(ValueError):
            snapshot.build(bad, fields, str(tmp_path / "t"), snapshot_id="t", unit="example")
    a, b = snapshot.digest(rows).first(), snapshot.digest(rows.repartition(3)).first()
    assert a == b
    assert snapshot.write_rows(rows, str(tmp_path / "j"), "jsonl") == (a["count"], a["digest"])


def test_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text('n,flag,t\n1,TRUE,"x, ""y"""\n,false,\n')
    got = files.read_csv(spark, str(tmp_path / "a.csv"), {"n": "number", "flag": "boolean"}).collect()
    assert [(r.n, r.flag, r.t) for r in got] == [(1.0, True, 'x, "y"'), (None, False, None)]
    (tmp_path / "b.csv").write_text("n\nten\n")
    with pytest.raises(Exception, match="not a number"):
        files.read_csv(spark, str(tmp_path / "b.csv"), {"n": "number"}).collect()
    (tmp_path / "c.json").write_text('{"data": {"rows": [{"a": 1}, {"a": 2}]}}')
    assert [r.a for r in files.read_json(spark, str(tmp_path / "c.json"), "a int", "data.rows").collect()] == [1, 2]
    refs = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b"), ("d", "e"), ("e", "d")], "id string, to string")
    assert {r.id: r.target for r in files.follow_references(refs, "id", "to").collect()} == {"a": "a", "b": "a", "c": "a", "d": None, "e": None}
    assert {r.column: r.role for r in files.profile(spark.createDataFrame([(f"{i % 3}k", i, f"p/{i}.png") for i in range(60)], "c string, n int, m string")).collect()} == {"c": "category", "n": "number", "m": "media"}


def test_binary(spark, tmp_path):
    (tmp_path / "x.idx").write_bytes(b"\0\0\x08\x02" + (3).to_bytes(4, "big") + (2).to_bytes(4, "big") + bytes(range(6)))
    assert [bytes(r.pixels) for r in binary.read_idx(spark, str(tmp_path / "x.idx")).orderBy("ordinal").collect()] == [b"\0\1", b"\2\3", b"\4\5"]
    (tmp_path / "y.bin").write_bytes(b"\7ab\x08cd")
    assert [(r.label, bytes(r.pixels)) for r in binary.read_fixed(spark, str(tmp_path / "y.bin"), 3).orderBy("ordinal").collect()] == [(7, b"ab"), (8, b"cd")]


def test_stream_counts_like_a_table(spark, tmp_path):
    rows = spark.range(100).select(F.timestamp_seconds(F.col("id") * 60).alias("ts"), (F.col("id") % 3).cast("string").alias("event_type"), F.col("id").cast("double").alias("value"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = incremental.windowed_counts(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("counts").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    key = lambda r: (r.start, r.event_type)
    assert sorted(spark.table("counts").collect(), key=key) == sorted(incremental.windowed_counts(rows).collect(), key=key)


def test_density_clusters_link_all_in_reach(spark, monkeypatch):
    rng = np.random.default_rng(4)
    near = np.concatenate([rng.normal(scale=1e-3, size=(60, 2)), rng.normal(scale=1e-3, size=(60, 2)) + [0.9, 0]])  # more than 50 on each side
    x = np.concatenate([near, np.repeat([[5.0, 5.0]], 60, axis=0), np.repeat([[5.9, 5.0]], 60, axis=0), rng.uniform(-10, 10, size=(150, 2))])
    gap = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    core = (gap <= 1).sum(1) >= 5
    label = np.where(core, np.arange(len(x)), -1)
    for _ in range(len(x)):
        label = np.where(core, np.where((gap <= 1) & core, label, len(x)).min(1), -1)
    far = np.where(core, gap, np.inf)
    want = np.where(core, label, np.where(far.min(1) <= 1, label[far.argmin(1)], -1))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<double>")
    for block in (4096, 64):
        monkeypatch.setattr(metric, "BLOCK", block)
        got = {r["id"]: r["cluster"] for r in vectors.density_clusters(df, 5, 1.0).collect()}
        groups = lambda of: {frozenset(i for i in range(len(x)) if of[i] == c) for c in {of[i] for i in range(len(x))} - {-1}}
        assert groups(got) == groups(want) and len(got) == len(x)
        assert got[0] == got[119] and got[120] == got[239]


def test_class_groups_are_checked(spark):
    rows = spark.createDataFrame([(i, i % 5) for i in range(20)] + [(20, None)], "id int, label int")
    G = subsets.ClassGroup
    for bad in ([], [G("a", 2, 1)], [G("a", 0, 3), G("b", 3, 4)], [G("", 0, 1)], [G("a", -1, 1)], [G(str(i), i, i) for i in range(33)]):
        with pytest.raises(ValueError):
            subsets.with_class_groups(rows, "label", bad)
    groups = [G("b", 3, 4), G("a", 0, 1)]
    got = {r.id: r.class_group for r in subsets.with_class_groups(rows, "label", groups, provenance="p").collect()}
    assert set(got) == {i for i in range(20) if i % 5 != 2} and got[3].id == 0 and got[5]["name"] == "a" and got[5].native_label == 0
    assert subsets.population(rows, subsets.in_any_group("label", groups), 21, 16) == 16
    for counts in ((21, 15), (20, 16), (16, 21)):
        with pytest.raises(ValueError):
            subsets.population(rows, subsets.in_any_group("label", groups), *counts)
    with pytest.raises(ValueError):
        subsets.with_class_groups(rows.withColumn("class_group", F.lit(1)), "label", groups)


def test_attached_results_give_way_to_nothing(spark):
    records = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "id string, `prediction.x.score` int")
    got = joins.attach_results(records, "x", spark.createDataFrame([("a", 9), ("b", None), ("z", 5)], "id string, score int"), ["score"], asset_records=spark.createDataFrame([("asset-1",), ("a",)], "id string"))
    assert {r[0]: r[1] for r in got.collect()} == {"a": 9, "b": None, "c": 3, "asset-1": None}
    ids = spark.createDataFrame([(0, "b"), (1, "q"), (2, "a"), (3, "b")], "ord int, id string")
    assert [tuple(r) for r in joins.column_of_ids(ids, records, "prediction.x.score").collect()] == [(0, "b", 2), (1, "q", None), (2, "a", 1), (3, "b", 2)]


def test_graph_refuses_what_does_not_fit(spark):
    images = spark.createDataFrame([(1,), (2,)], "image_id int")
    qas, regions = spark.createDataFrame([(10, 1), (11, 2)], "qa_id int, image_id int"), spark.createDataFrame([(20, 1), (21, 2)], "region_id int, image_id int")
    links = spark.createDataFrame([(10, 20), (77, 21), (11, 88), (99, 98)], "qa_id int, region_id int")
    got = joins.assemble_graph(images, {}, {}, qas, regions, links).collect()
    assert {(r.image_id, tuple(sorted((r.qa_to_region or {}).items())), r.orphan_qa, r.orphan_region) for r in got} == {(1, ((10, 20),), None, None), (2, ((11, 88), (77, 21)), None, None), (None, (), 99, 98)}
    for bad in ((images, {}, {}, qas, regions, spark.createDataFrame([(10, 21)], links.schema)), (images, {}, {}, qas.union(qas), regions, links), (images.where("image_id = 1"), {}, {}, qas, regions, links), (images, {"t": qas.union(spark.createDataFrame([(5, 1)], qas.schema))}, {}, qas, regions, links)):
        with pytest.raises(ValueError):
            joins.assemble_graph(*bad)


def test_selections_are_frozen_and_exported(spark, tmp_path):
    folder = str(tmp_path)
    ids = spark.createDataFrame([(0, "b"), (1, "a")], "ord long, id string")
    assert selections.freeze(ids, folder, "one").count() == selections.freeze(ids.orderBy("id"), folder, "one").count() == 2
    for other, name in ((ids.where("ord = 0"), "one"), (ids, "a/b")):
        with pytest.raises(ValueError):
            selections.freeze(other, folder, name)
    asset = [("where", {"k": "v"}, "image")]
    records = spark.createDataFrame([("a", asset, "h", [("human", 1), ("source", 2)]), ("b", asset, None, []), ("c", [], None, [])], "id string, assets array<struct<uri: string, metadata: map<string, string>, kind: string>>, human string, annotations array<struct<namespace: string, n: int>>")
    selections.export(ids, records, f"{folder}/out")
    got_ids, got = selections.load(spark, f"{folder}/out")
    assert got_ids.count() == 2 and "human" not in got.columns
    rows = {r.id: r for r in got.collect()}
    assert set(rows) == {"a", "b"} and rows["a"].assets[0].uri is None and rows["a"].assets[0].metadata is None and rows["a"].assets[0].kind == "image" and [x.n for x in rows["a"].annotations] == [2]
    with pytest.raises(ValueError):
        selections.export(ids, records, f"{folder}/out")
    with pytest.raises(ValueError):
        selections.export(ids.union(spark.createDataFrame([(2, "unknown")], ids.schema)), records, f"{folder}/other")
    records.write.parquet(f"{folder}/out/stray")
    with pytest.raises(ValueError):
        selections.load(spark, f"{folder}/out")


def test_row_groups_are_those_of_the_footers(spark, tmp_path):
    import hashlib

    import pyarrow as pa
    import pyarrow.parquet as pq

    for f, n in (("x.parquet", 100), ("y.parquet", 35)):
        pq.write_table(pa.table({"v": range(n)}), tmp_path / f, row_group_size=10)
    known = sampling.parquet_row_groups(spark, str(tmp_path))
    assert [(n, g) for n, g, _, _ in known] == [("x.parquet", i) for i in range(10)] + [("y.parquet", i) for i in range(4)] and known[-1][2:] == (30, 5)
    rank = lambda *p: hashlib.sha256(":".join(map(str, (7, *p))).encode()).hexdigest()
    want = set()
    for i, (name, g, first, rows) in enumerate(sorted(known, key=lambda k: rank("row_group", k[0], k[1]))[:4]):
        want |= {(name, g, r, first + r) for r in sorted(range(rows), key=lambda r: rank("row", name, g, r))[: 2 + (i < 2)]}
    got = sampling.fixed_row_groups(spark, str(tmp_path), 4, 10, 7).collect()
    assert {(r.origin_file, r.origin_group, r.origin_row, r.v) for r in got} == want and len(got) == 10
    for args in ((15, 20, 7), (4, 40, 7)):
        with pytest.raises(ValueError):
            sampling.fixed_row_groups(spark, str(tmp_path), *args)
    with pytest.raises(ValueError):
        sampling.fixed_row_groups(spark, str(tmp_path), 4, 10, 7, most_per_group=2)


def test_fields_from_templates(spark):
    rows = spark.createDataFrame([("7_x", {"b": {"c": "deep"}}, "pre/a"), (None, {}, None)], "s string, m map<string, map<string, string>>, p string")
    got = rows.select(mapping.stem(F.col("s"), "_", 3), mapping.nested(rows.schema, "m.b.c"), mapping.nested(rows.schema, "s.b"), mapping.without_prefix(F.col("p"), "pre/"), mapping.templated("a{s}", {"s": F.col("s")})).collect()
    assert [tuple(r) for r in got] == [("007", "deep", None, "a", "a7_x"), (None, None, None, None, None)]
    assert mapping.roles(["caption", "Options", "x"], {"question": "x"}) == {"text": "caption", "question": "x", "choices": "Options"}
    with pytest.raises(ValueError):
        mapping.templated("{no}", {})
    for bad in (mapping.without_prefix(F.col("p"), "other/"), mapping.joined_parts(F.array("s", F.lit(None).cast("string"))), mapping.choices(F.array("s"), correct=1)[1]):
        with pytest.raises(Exception, match="prefix|missing|isn't in"):
            rows.where("s is not null").select(bad).collect()


def test_registries(spark):
    own = Registry("converter")

    @own.register("double")
    def double(rows, *, column):
        return rows.withColumn(column, F.col(column) * 2)

    assert own.call("double", spark.range(3), column="id").agg(F.sum("id")).first()[0] == 6 and own.options("double") == {"column": None}
    for call in (lambda: own.call("other", spark.range(1)), lambda: own.call("double", spark.range(1)), lambda: own.call("double", spark.range(1), column="id", more=1), lambda: own.register("double")(double)):
        with pytest.raises(ValueError):
            call()
    assert "k_means" in PROCESSORS.known and CONVERTERS.options("records")["text"] is None


def test_research_kinds(spark):
    chosen = spark.createDataFrame([("a",), ("b",)], "id string")
    vectors_of = lambda rows: spark.createDataFrame(rows, "id string, value array<double>")
    assert {r.id: r.status for r in results.import_research(chosen, vectors_of([("a", [1.0, 2.0])]), "vector").collect()} == {"a": "completed", "b": "not_applicable"}
    for kind, bad in (("vector", vectors_of([("a", [1.0]), ("b", [1.0, 2.0])])), ("vector", vectors_of([("a", [float("nan")])])), ("vector", vectors_of([("q", [1.0])])), ("response", spark.createDataFrame([("a", "  ")], "id string, value string")), ("scalar", spark.createDataFrame([("a", 1.0), ("a", 2.0)], "id string, value double"))):
        with pytest.raises(ValueError):
            results.import_research(chosen, bad, kind)


def test_catalogue_versions(spark):
    rows = [("d", "1", "s1", 1), ("d", "2", "s2", 2), ("e", "1", "t1", None)]
    entries = spark.createDataFrame(rows, "dataset_id string, release_id string, snapshot_id string, released int")
    assert {r.snapshot_id for r in catalogue.versions(entries).where("active").collect()} == {"s2", "t1"}
    assert catalogue.version(entries, "d", release="1").first().snapshot_id == "s1" and catalogue.version(entries, "d").first().snapshot_id == "s2"


@pytest.mark.parametrize("linkage", ["average", "complete", "single", "ward"])
def test_merged_clusters_against_brute_force(linkage):
    rng = np.random.default_rng(0)
    c, n = rng.normal(size=(25, 3)), rng.integers(1, 9, 25).astype(float)

    def gap(a, b):
        if linkage == "ward":
            x, y = ((c[s] * n[s][:, None]).sum(0) / n[s].sum() for s in (a, b))
            return n[a].sum() * n[b].sum() / (n[a].sum() + n[b].sum()) * ((x - y) ** 2).sum()
        return {"average": np.mean, "complete": max, "single": min}[linkage]([np.linalg.norm(c[i] - c[j]) for i in a for j in b])

    parts = [[i] for i in range(25)]
    while len(parts) > 6:
        i, j = min(((i, j) for i in range(len(parts)) for j in range(i + 1, len(parts))), key=lambda p: gap(parts[p[0]], parts[p[1]]))
        parts[i] += parts.pop(j)
    got = vectors._merged(c, n, 6, linkage)
    assert {frozenset(np.flatnonzero(got == k).tolist()) for k in got} == {frozenset(p) for p in parts}
