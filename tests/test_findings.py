"""What a reviewer found on larger tables, each on small ones of the same kind."""

import duckdb
import numpy as np
import pytest

from tessera import queries
from tessera.llm import components, simhash


def agrees(spark, folder, name, **tables):
    """The query against its SQL, over tables given as DuckDB queries."""
    con = duckdb.connect()
    for table, sql in tables.items():
        con.sql(f"create table {table} as {sql}")
        con.sql(f"copy {table} to '{folder}/{table}.parquet'")
    df = queries.QUERIES[name](spark, str(folder))
    rel = con.sql(queries.ORACLE_SQL[name])
    want = [tuple(r[rel.columns.index(c)] for c in df.columns) for r in rel.fetchall()]
    assert want and sorted(map(repr, map(tuple, df.collect()))) == sorted(map(repr, want))


def test_an_image_without_a_list(spark, tmp_path):
    agrees(
        spark, tmp_path, "graph_assembled", nation="select 0::int as n_nationkey, 'n' as n_name", customer="select i::bigint as c_custkey, 'c' as c_name, 0::int as c_nationkey from range(3) t(i)",
        orders="select i::bigint as o_orderkey, (i % 2)::bigint as o_custkey, 1.0::double as o_totalprice from range(5) t(i)", supplier="select i::bigint as s_suppkey from range(3) t(i)",
    )


PARTS = """select (k + d)::bigint as p_partkey, 'ring ' || d as p_name, 'Brand#' || d % 2 as p_brand, 'SMALL' as p_type, 30::int as p_size from (values (5), (999998), (1234560)) a(k), range(3) t(d)"""


@pytest.mark.parametrize("name", ["catalogue_search", "catalogue_facets"])
def test_releases_of_keys_over_six_digits(spark, tmp_path, name):
    agrees(spark, tmp_path, name, part=PARTS)


def test_the_newest_release_is_of_the_greatest_key(spark, tmp_path):
    agrees(spark, tmp_path, "catalogue_order", part=PARTS)


def test_profile_deals_rows_over_tasks(spark):
    from tessera.sources import files

    rows = spark.createDataFrame([("1", " a ", None), ("1.5", "", "true"), ("2", "a", "FALSE"), ("2", "b", None)], "x string, y string, z string").coalesce(1)
    got = {r["column"]: r.asDict() for r in files.profile(rows).collect()}
    assert [got[c]["nonnull"] for c in "xyz"] == [4, 3, 2] and [got[c]["distinct"] for c in "xyz"] == [3, 2, 2]
    assert got["x"]["numeric"] and got["z"]["boolean"] and got["x"]["average_length"] == 1.5 and got["y"]["role"] == "category"
    none = files.profile(rows.limit(0)).collect()
    assert [(r.column, r.nonnull, r.distinct, r.numeric, r.average_length) for r in none] == [(c, 0, 0, False, None) for c in "xyz"]
    plan = files.profile(rows)._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and "Expand" not in plan  # the values of a file's rows are not counted where it is read


@pytest.mark.parametrize("piece", [16, 50, 65_536])
def test_batches_go_on_over_pieces(spark, piece):
    import random

    from tessera.operators import sets

    rng = random.Random(piece)
    sizes = [rng.choice([1, 1, 1, 2, 3, 7, 15, 16, 17, 30]) for _ in range(240)]
    rows = [(i, c) for i, c in enumerate(c for c, n in enumerate(sizes) for _ in range(n))]
    want, used, batch = {}, 0, -1
    for c, n in enumerate(sizes):
        if batch < 0 or used + n > 16:
            batch, used = batch + 1, 0
        used += n
        want[c] = batch
    got = sets.component_batches(spark.createDataFrame(rows, "ord long, component long").repartition(3), "component", "ord", piece=piece).collect()
    assert len(got) == len(rows) and all(r.batch == want[r.component] for r in got)


def test_objects_of_alike_images_are_listed_once(spark, tmp_path):
    agrees(
        spark, tmp_path, "captions_with_objects", nation="select i::int as n_nationkey, 'n' || i as n_name from range(3) t(i)", customer="select i::bigint as c_custkey, 'c' || i as c_name, (i % 25)::int as c_nationkey from range(28) t(i) where i % 25 < 3",
        orders="select i::bigint as o_orderkey, (i % 2 + 25 * (i % 3 // 2))::bigint as o_custkey, 'x' as o_orderpriority from range(12) t(i)", supplier="select i::bigint as s_suppkey, (i % 2 * 2)::int as s_nationkey from range(25) t(i)",
    )
    s = spark.read.parquet(f"{tmp_path}/supplier.parquet")
    plan = queries.QUERIES["captions_with_objects"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert s.count() == 25 and "concat_ws(-" not in plan  # no object for each pair of a supplier and an image


@pytest.mark.parametrize(("operator", "most"), [("near_copies", 7), ("near_duplicates", 9)])
def test_links_of_a_large_group_are_few(spark, monkeypatch, operator, most):
    """In a group of near copies each meets the others at dozens of anchors; what goes to the components is a few links for each, however large the group."""
    rng = np.random.default_rng(3)
    base = [f"w{n}" for n in rng.integers(0, 10**6, 100)]
    texts = [(i, " ".join([*base[: i % 100], f"x{n}", *base[i % 100 + 1 :]])) for i, n in enumerate(rng.integers(0, 10**6, 1200).tolist())]
    counts = []

    def counted(links):
        counts.append(links.count())
        return components.components(links)

    monkeypatch.setattr(simhash, "components", counted)
    df = spark.createDataFrame(texts, "doc_id long, text string")
    rows = getattr(simhash, operator)(df).collect()
    assert len({r.root for r in rows}) < 150
    assert 0 < max(counts) < most * len(texts), counts
