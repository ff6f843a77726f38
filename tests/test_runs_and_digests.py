"""Ordered digests, Arrow shards, runs that go on, and draws under a byte budget."""

import hashlib
import json
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators import sampling
from tessera.sources import digest, snapshot
from tessera.sources.arrow_shards import Shard, read_arrow_shards, read_parquet_shards
from tessera.streaming.resumable import ResumableRun


def tree(rows, fanout):
    level = [hashlib.sha256(json.dumps(r, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest() for r in rows]
    once = True
    while once or len(level) > 1:
        once = False
        level = [hashlib.sha256("".join(level[i : i + fanout]).encode()).hexdigest() for i in range(0, len(level), fanout)]
    return level[0]


@pytest.mark.parametrize("n", [1, 2, 7, 8, 65, 300])
def test_ordered_digest(spark, monkeypatch, n):
    monkeypatch.setattr(digest, "FANOUT", 8)
    rows = [{"b": i, "a": None if i % 3 else f"é{i}", "c": [i, 1]} for i in range(n)]
    df = lambda r: spark.createDataFrame([(x["b"], x["a"], x["c"]) for x in r], "b long, a string, c array<long>").repartition(3)
    first = digest.ordered_digest(df(rows), "b").first()
    assert (first["count"], first["digest"]) == (n, tree(rows, 8))
    if n in (7, 65):
        changed = [dict(r) for r in rows]
        changed[3]["a"] = "other"
        assert digest.ordered_digest(df(changed), "b").first()["digest"] == tree(changed, 8) != first["digest"]
        swapped = [dict(r) for r in rows]
        swapped[1]["c"], swapped[2]["c"] = swapped[2]["c"], swapped[1]["c"]
        assert digest.ordered_digest(df(swapped), "b").first()["digest"] != first["digest"]
        assert digest.verified(df(rows), ["b"], count=n, digest=first["digest"]).count() == n
        for count, value in ((n + 1, first["digest"]), (n, "0" * 64)):
            with pytest.raises(ValueError, match="pins"):
                digest.verified(df(rows), ["b"], count=count, digest=value)


def test_digests_of_no_rows_and_of_equal_ones(spark):
    none = spark.range(0)
    assert tuple(digest.ordered_digest(none, "id").first()) == (0, hashlib.sha256(b"").hexdigest())
    twice = spark.createDataFrame([(1, "x"), (1, "y"), (1, "x")], "k int, v string")
    assert digest.ordered_digest(twice.repartition(3), "k").first() == digest.ordered_digest(twice.coalesce(1), "k").first()
    with pytest.raises(ValueError):
        digest.ordered_digest(none)


@pytest.mark.parametrize("fmt", ["jsonl", "parquet", "csv"])
def test_written_rows_have_the_digest_of_what_is_read(spark, tmp_path, fmt):
    rows = spark.createDataFrame([(i, None if i % 2 else f"t{i}") for i in range(50)], "k long, t string").repartition(4)
    read = rows if fmt != "csv" else rows.select(F.col("k").cast("string").alias("k"), F.coalesce("t", F.lit("")).alias("t"))
    want = tuple(digest.ordered_digest(read, "k").first())
    assert snapshot.write_rows(rows, str(tmp_path / "a"), fmt, order=["k"]) == want
    assert snapshot.write_rows(rows.repartition(2), str(tmp_path / "b"), fmt, order=["k"], pinned=want) == want
    with pytest.raises(ValueError, match="pins"):
        snapshot.write_rows(rows.where("k > 0"), str(tmp_path / "c"), fmt, order=["k"], pinned=want)


def test_columns_are_discovered(spark):
    records = spark.createDataFrame([({"b": "1"},), ({"a": "2", "c": None},), ({},)], "record map<string, string>")
    assert [(r.a, r.b, r.c) for r in digest.discovered(records).collect()] == [(None, "1", None), ("2", None, None), (None, None, None)]


def shard(path, batches, stream=False):
    schema = batches[0].schema
    with pa.OSFile(str(path), "wb") as f, (pa.ipc.new_stream if stream else pa.ipc.new_file)(f, schema) as w:
        for b in batches:
            w.write_batch(b)
    return hashlib.sha256(path.read_bytes()).hexdigest()


def test_arrow_shards(spark, tmp_path):
    batch = lambda **c: pa.RecordBatch.from_pydict(c)
    one = [batch(a=[1, 2], t=["x", None]), batch(a=[3], t=["z"]), batch(a=[4, 5, 6], t=["u", "v", "w"])]
    kinds = pa.schema({"a": pa.float64(), "extra": pa.list_(pa.int64())})
    two = [pa.RecordBatch.from_pydict(b, kinds) for b in ({"a": [1.5], "extra": [[1, 2]]}, {"a": [None, 2.5], "extra": [None, []]})]
    pins = [shard(tmp_path / "1.arrow", one), shard(tmp_path / "2.arrows", two, stream=True), shard(tmp_path / "3.arrow", [batch(t=["last"])])]
    shards = [Shard(str(tmp_path / "1.arrow"), pins[0], "train", "g"), Shard(f"file://{tmp_path}/2.arrows", pins[1], "test"), Shard(str(tmp_path / "3.arrow"), pins[2])]
    df = read_arrow_shards(spark, shards, rows_per_task=2)
    assert df.rdd.getNumPartitions() == 4  # rows 0-1, 2-5, the stream, the last shard
    got = sorted(df.collect(), key=lambda r: r.ordinal)
    assert [r.ordinal for r in got] == list(range(10))
    assert [r.a for r in got] == [1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 1.5, None, 2.5, None]
    assert [r.t for r in got] == ["x", None, "z", "u", "v", "w", None, None, None, "last"] and [r.extra for r in got][6:9] == [[1, 2], None, []]
    assert [(r.origin.shard, r.origin.row, r.origin.split, r.origin.group) for r in got][4:8] == [(0, 4, "train", "g"), (0, 5, "train", "g"), (1, 0, "test", None), (1, 1, "test", None)]
    assert got[9].origin.file == shards[2].path and got[9].origin.sha256 == pins[2]
    with pytest.raises(Exception, match="differs from its pin"):
        read_arrow_shards(spark, [shards[0], Shard(shards[1].path, pins[0])])
    text = shard(tmp_path / "4.arrow", [batch(a=["no number"])])
    with pytest.raises(ValueError, match="no common type"):
        read_arrow_shards(spark, [shards[0], Shard(str(tmp_path / "4.arrow"), text)])
    with pytest.raises(ValueError, match="pins"):
        read_arrow_shards(spark, [Shard(str(tmp_path / "1.arrow"), "")])


def test_parquet_shards(spark, tmp_path):
    import pyarrow.parquet as pq

    tables = [pa.table({"a": [1, 2, 3]}), pa.table({"a": [4], "b": ["x"]}), pa.table({"b": ["y", None]})]
    shards = []
    for i, t in enumerate(tables):
        pq.write_table(t, tmp_path / f"p {2 - i}.parquet", row_group_size=2)  # the order is the list's, not the names'
        shards.append(Shard(str(tmp_path / f"p {2 - i}.parquet"), hashlib.sha256((tmp_path / f"p {2 - i}.parquet").read_bytes()).hexdigest(), "train" if i else None))
    shards = [Shard(s.path.replace(" ", "_"), s.sha256, s.split) for s in shards]
    for i in range(3):
        (tmp_path / f"p {i}.parquet").rename(tmp_path / f"p_{i}.parquet")
    got = sorted(read_parquet_shards(spark, shards).collect(), key=lambda r: r.ordinal)
    assert [(r.ordinal, r.a, r.b, r.origin.shard, r.origin.row, r.origin.split) for r in got] == [(0, 1, None, 0, 0, None), (1, 2, None, 0, 1, None), (2, 3, None, 0, 2, None), (3, 4, "x", 1, 0, "train"), (4, None, "y", 2, 0, "train"), (5, None, None, 2, 1, "train")]
    assert got[3].origin.file == shards[1].path and got[3].origin.sha256 == shards[1].sha256
    with pytest.raises(Exception, match="differs from its pin"):
        read_parquet_shards(spark, [Shard(shards[0].path, shards[1].sha256)])


def test_a_stopped_run_goes_on(spark, tmp_path):
    items = tmp_path / "items"
    for i in range(5):  # items come again in later files
        spark.range(i * 10 - 3 if i else 0, i * 10 + 10).selectExpr("cast(id as string) as id", "id * 2 as value").coalesce(1).write.mode("append").parquet(str(items))
    seen = spark.sparkContext.accumulator(0)
    broken = tmp_path / "broken"

    def process(df):
        if (out := tmp_path / "runs" / "r1" / "results").exists() and len(list(out.glob("batch=*"))) == 2 and not broken.exists():
            broken.write_text("once")
            df.count()
            raise RuntimeError("the driver was killed")

        def work(it):
            for pdf in it:
                seen.add(len(pdf))
                yield pdf[pdf["id"] != "7"].assign(value=pdf["value"] + 1)

        return df.mapInPandas(work, "id string, value long")

    run = lambda: ResumableRun(spark, "r1", str(items), T._parse_datatype_string("id string, value long"), process, str(tmp_path / "runs"))
    with pytest.raises(Exception, match="killed"):
        run().complete()
    half = {r.record_id for r in run().results().collect()}
    before = seen.value
    assert 0 < len(half) < 50
    assert {(r.status, r["items"]) for r in run().progress(50).collect()} >= {("queued", 50 - len(half))}
    got = run().complete().collect()  # as a new driver would
    assert sorted(int(r.record_id) for r in got) == list(range(50)) and {r.run_id for r in got} == {"r1"}
    assert all(r.result.value == 2 * int(r.record_id) + 1 for r in got if r.status == "completed")
    assert [r.record_id for r in got if r.status == "failed"] == ["7"]
    assert seen.value - before == 50 - len(half)  # nothing that was there is computed again
    again = seen.value
    assert run().complete().count() == 50 and seen.value == again
    other = ResumableRun(spark, "r2", str(items), T._parse_datatype_string("id string, value long"), lambda df: df, str(tmp_path / "runs"), files_per_batch=3)
    assert other.complete().count() == 50
    with pytest.raises(ValueError):
        ResumableRun(spark, "a/b", str(items), T.StructType(), process, str(tmp_path))


def test_a_run_is_cancelled(spark, tmp_path):
    import time

    items = tmp_path / "items"
    for i in range(3):
        spark.range(i * 10, i * 10 + 10).selectExpr("cast(id as string) as id").coalesce(1).write.mode("append").parquet(str(items))
    slow = tmp_path / "slow"
    slow.write_text("")

    def process(df):
        def work(it):
            for pdf in it:
                for _ in range(600):
                    if not slow.exists():
                        break
                    time.sleep(0.1)
                yield pdf

        return df.mapInPandas(work, "id string").withColumn("x", F.lit(1))

    run = ResumableRun(spark, "c", str(items), T._parse_datatype_string("id string"), process, str(tmp_path / "runs"))
    query = run.start()
    time.sleep(6)
    began = time.time()
    run.cancel(query)
    assert time.time() - began < 30 and not query.isActive
    slow.unlink()
    assert run.complete().count() == 30


def drawn_one_by_one(groups, count, seed, budget):
    starts, total = [], 0
    for g in groups:
        starts.append(total)
        total += g[3]
    left, admitted, out, seen, i = budget, set(), [], set(), 0
    while len(out) < count and i < 100_000:
        at = int(hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), 16) % total
        i += 1
        g = max(k for k, s in enumerate(starts) if s <= at and groups[k][3])
        if g not in admitted:
            if groups[g][2] > left:
                continue
            admitted.add(g)
            left -= groups[g][2]
        if at not in seen:
            seen.add(at)
            out.append((groups[g][0], groups[g][1], at - starts[g]))
    return out


@pytest.mark.parametrize(("count", "budget"), [(40, 10**9), (25, 900), (10_000, 1200), (3, 1), (17, 450)])
def test_draws_under_a_budget(spark, count, budget):
    rng = random.Random(3)
    groups = [(f"f{i // 4}", i % 4, rng.choice([50, 200, 500]), rng.choice([0, 5, 30, 60])) for i in range(14)]
    if budget == 1:
        groups = [(f, g, 1 if i == 3 else b, 8 if i == 3 else r) for i, (f, g, b, r) in enumerate(groups)]
    got = sampling.budgeted_draw(spark, groups, count, 5, budget, max_draws=100_000).orderBy("nth").collect()
    assert [(r.origin_file, r.origin_group, r.origin_row) for r in got] == drawn_one_by_one(groups, count, 5, budget)


def test_drawn_rows_are_those_of_the_files(spark, tmp_path):
    spark.range(4000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("t")).repartitionByRange(3, "id").write.option("parquet.block.size", 20_000).option("parquet.block.size.row.check.min", 100).parquet(str(tmp_path / "p"))
    sizes = sampling.parquet_row_groups(spark, str(tmp_path / "p"), sizes=True)
    assert len(sizes) > 3
    budget = sum(g[2] for g in sizes) // 2
    got = sampling.draw_row_groups(spark, str(tmp_path / "p"), 30, 9, budget).orderBy("nth").collect()
    assert [(r.origin_file, r.origin_group, r.origin_row) for r in got] == drawn_one_by_one(sizes, 30, 9, budget)
    first = {(f, g): n for f, g, n, _ in sampling.parquet_row_groups(spark, str(tmp_path / "p"))}
    files = {f: [r.id for r in spark.read.parquet(str(tmp_path / "p" / f)).collect()] for f in {g[0] for g in sizes}}
    assert all(files[r.origin_file][first[r.origin_file, r.origin_group] + r.origin_row] == r.id for r in got)
    for bad in ((0, 1, 5), (1, -1, 5), (1, 1, 0)):
        with pytest.raises(ValueError):
            sampling.draw_row_groups(spark, str(tmp_path / "p"), *bad)
