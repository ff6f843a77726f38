"""Digests of rows in order: a tree of hashes over range partitions, so that no task sees all rows.

A row's hash is the SHA-256 of its canonical JSON: columns by name, nulls written. Rows are numbered in their order; ``FANOUT`` successive hashes, written one after the other, make
the hash of the next level, up to one. One changed, missing or swapped row changes it; files and partitions don't. Rows that are equal in the order's columns go by their hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.session import Tables

FANOUT = 1024
INDEX_BITS = 33  # of the numbers within a partition that monotonically_increasing_id gives


def canonical(columns: list[str]) -> Column:
    return F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(columns)]), {"ignoreNullFields": "false"})


def numbered(rows: DataFrame, tables: Tables, *by: str | Column, name: str = "position") -> DataFrame:
    """``rows`` with their places (from 0) in the order of ``by``: sorted by range, and each range starts at the count of those before it."""
    ranged = rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn(name, F.monotonically_increasing_id())
    written = tables.write(ranged)
    part = F.shiftrightunsigned(name, INDEX_BITS)
    starts, total = [(0, 0)], 0
    for r in sorted(written.groupBy(part.alias("part")).count().collect()):  # a row for each range
        starts.append((r["part"], total))
        total += r["count"]
    starts = rows.sparkSession.createDataFrame(list(dict(starts).items()), "_part long, _start long")
    out = written.join(F.broadcast(starts), part == F.col("_part"))
    return out.withColumn(name, F.col("_start") + F.col(name).bitwiseAND(F.lit((1 << INDEX_BITS) - 1))).drop("_part", "_start")


def ordered_digest(rows: DataFrame, *order: str) -> DataFrame:
    """count, digest of the rows in the order of some columns; the empty table's digest is that of nothing."""
    if not order:
        raise ValueError("an ordered digest needs columns to order by")
    tables = Tables(rows.sparkSession, "digest")
    keys = [F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(order)]
    leaves = rows.select(*keys, F.sha2(canonical(rows.columns), 256).alias("h"))
    at = tables.write(numbered(leaves, tables, *[f"_{i}" for i in range(len(order))], "h").select("position", "h"))
    count = left = at.count()
    while left > 1 or left == count == 1:
        joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("position", "h"))), lambda x: x["h"]), "")  # of FANOUT hashes
        at = tables.write(at.groupBy(F.floor(F.col("position") / FANOUT).alias("position")).agg(F.sha2(joined, 256).alias("h")))
        left = -(-left // FANOUT)
        if count == 1:
            break
    return at.agg(F.lit(count).cast("long").alias("count"), F.coalesce(F.max("h"), F.sha2(F.lit(""), 256)).alias("digest"))


def verified(rows: DataFrame, order: list[str], *, count: int, digest: str) -> DataFrame:
    """``rows``, if they are as many and have the digest that a recipe pins; else they are refused."""
    found = ordered_digest(rows, *order).first()
    if found["count"] != count:
        raise ValueError(f"there are {found['count']:,} rows; the recipe pins {count:,}")
    if found["digest"] != digest:
        raise ValueError("the rows differ from the digest that the recipe pins")
    return rows


def discovered(records: DataFrame, column: str = "record") -> DataFrame:
    """Records (maps from names to texts) as a table with the union of their names as columns, in order; names that a record lacks are null."""
    names = sorted(r[0] for r in records.select(F.explode(F.map_keys(column))).distinct().collect())  # the columns' names
    return records.select(*[F.col(column)[n].alias(n) for n in names])
