"""Deterministic samples that don't depend on the order or the partitions of their input."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.session import Tables
from tessera.sources.digest import numbered


def sha_rank(seed: int | str, *parts: str | Column) -> Column:
    """sha256 of ``seed:part:part``; its hex digits sort as the number does."""
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]), 256)


def first_per_group(rows: DataFrame, group: str, *order: str | Column) -> DataFrame:
    """The first row of each group; tasks keep one row a group before the shuffle."""
    nth = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return rows.withColumn("_nth", nth).where("_nth = 1").drop("_nth")


def bottom_k(rows: DataFrame, group: str, id_column: str, k: int, seed: int) -> DataFrame:
    """k groups of least hash, one row (of least hash) from each; with ``rank``."""
    ranked = rows.withColumn("_g", sha_rank(seed, F.col(group))).withColumn("_r", sha_rank(seed, "record", F.col(id_column)))
    one = first_per_group(ranked, group, "_r", id_column)
    top = one.orderBy("_g", group).limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy("_g", group)) - 1).drop("_g", "_r")


def stratified_bottom_k(rows: DataFrame, stratum: str, values: list, id_column: str, k: int, seed: int) -> DataFrame:
    """ceil(k / strata) rows of least hash of each declared stratum, taken in turn up to k; rows of other strata are refused by ``undeclared``."""
    pool = math.ceil(k / len(values))
    ranked = rows.where(F.col(stratum).isin(values)).withColumn("_r", sha_rank(seed, F.col(id_column)))
    ranked = ranked.withColumn("_nth", F.row_number().over(Window.partitionBy(stratum).orderBy("_r", id_column))).where(F.col("_nth") <= pool)
    place = F.array_position(F.array(*map(F.lit, values)), F.col(stratum))
    return ranked.withColumn("_place", place).orderBy("_nth", "_place").limit(k).drop("_r", "_nth", "_place")


def undeclared(rows: DataFrame, stratum: str, values: list) -> DataFrame:
    return rows.where(~F.coalesce(F.col(stratum).isin(values), F.lit(False))).select(stratum).distinct()


def interleave(rows: DataFrame, group: str, *order: str) -> DataFrame:
    """``turn`` from 0: the first row of each group in turn, then the second ones; ``nth`` from 1 is a row's number in its group. Groups take turns by name, a null one first.

    A turn is the row's place in the order of ``nth`` and group, which ranges number; a window holds the rows of a group alone."""
    nth = rows.withColumn("nth", F.row_number().over(Window.partitionBy(group).orderBy(*order)))
    return numbered(nth, Tables(rows.sparkSession, "interleave"), "nth", F.asc_nulls_first(group), name="turn")


def asset_first(rows: DataFrame, asset: str, id_column: str, size: int, seed: int) -> DataFrame:
    """Distinct assets first (one row each), then other rows up to ``size``, both by hash."""
    ranked = rows.withColumn("_r", sha_rank(seed, F.col(id_column)))
    ranked = ranked.withColumn("_again", F.row_number().over(Window.partitionBy(asset).orderBy("_r", id_column)) > 1)
    ranked = ranked.withColumn("_again", F.when(F.col(asset).isNull(), True).otherwise(F.col("_again")))
    return ranked.orderBy("_again", "_r", id_column).limit(size).drop("_r", "_again")


def fixed_groups(rows: DataFrame, group: str, row: str, groups: int, size: int, seed: int) -> DataFrame:
    """Rows from ``groups`` row groups: groups by hash, and from each its quota (the first ones get one more) by hash of the row."""
    names = rows.select(group).distinct().withColumn("_g", sha_rank(seed, "row_group", F.col(group))).orderBy("_g").limit(groups)
    names = names.select(F.col(group).alias("_name"), (F.row_number().over(Window.orderBy("_g")) - 1).alias("_i"))  # ``groups`` rows
    base, extra = divmod(size, groups)
    quota = F.lit(base) + F.when(F.col("_i") < extra, 1).otherwise(0)
    picked = rows.join(F.broadcast(names), F.col(group) == F.col("_name"))
    nth = F.row_number().over(Window.partitionBy(group).orderBy(sha_rank(seed, "row", F.col(group), F.col(row)), row))
    return picked.withColumn("_nth", nth).where(F.col("_nth") <= quota).drop("_name", "_i", "_nth")


def parquet_row_groups(spark: SparkSession, path: str, *, sizes: bool = False) -> list[tuple[str, int, int, int]]:
    """(file, row group, its first row in the file, rows) of the Parquet files at a path, from their footers; no data is read. ``sizes``: compressed bytes in place of the first row."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(conf)
    files = sorted((f.getPath() for f in fs.listStatus(where) if f.getPath().getName().endswith(".parquet")), key=lambda p: p.getName())
    out = []
    for f in files:
        reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(f, conf))
        try:
            first = 0
            for i, block in enumerate(reader.getFooter().getBlocks()):
                out.append((f.getName(), i, block.getCompressedSize() if sizes else first, block.getRowCount()))
                first += block.getRowCount()
        finally:
            reader.close()
    return out


def fixed_row_groups(spark: SparkSession, path: str, groups: int, size: int, seed: int, *, most_per_group: int | None = None) -> DataFrame:
    """Rows from ``groups`` of the row groups at a path, with origin_file, origin_group and origin_row: groups by hash, and from each its quota (the first ones
    give one more) by hash of the row. The rows are named by the footers alone, and the scan reads the row groups that hold them."""
    known = parquet_row_groups(spark, path)
    base, extra = divmod(size, groups)
    if not 1 <= groups <= len(known):
        raise ValueError(f"there are {len(known)} row groups")
    if most_per_group is not None and base + (extra > 0) > most_per_group:
        raise ValueError(f"a row group would give over {most_per_group} rows")
    rank = lambda *parts: hashlib.sha256(":".join(map(str, (seed, *parts))).encode()).hexdigest()
    chosen = []
    for place, (name, group, first, rows) in enumerate(sorted(known, key=lambda g: (rank("row_group", g[0], g[1]), g[0], g[1]))[:groups]):
        quota = base + (place < extra)
        if rows < quota:
            raise ValueError(f"row group {group} of {name} has {rows} rows, and {quota} are taken from each")
        chosen.append((name, group, first, first + rows - 1, quota))
    asked = spark.createDataFrame(chosen, "_file string, origin_group int, _first long, _last long, _quota long")  # a row for each of ``groups``
    rows = spark.read.parquet(path).select("*", F.col("_metadata.file_name").alias("origin_file"), F.col("_metadata.row_index").alias("_index"))
    inside = rows.join(F.broadcast(asked), (F.col("origin_file") == F.col("_file")) & F.col("_index").between(F.col("_first"), F.col("_last"))).withColumn("origin_row", F.col("_index") - F.col("_first"))
    ranked = sha_rank(seed, "row", F.col("origin_file"), F.col("origin_group"), F.col("origin_row"))
    nth = F.row_number().over(Window.partitionBy("origin_file", "origin_group").orderBy(ranked, "origin_row"))
    return inside.withColumn("_nth", nth).where(F.col("_nth") <= F.col("_quota")).drop("_file", "_first", "_last", "_quota", "_index", "_nth")


def budgeted_draw(spark: SparkSession, groups: list[tuple[str, int, int, int]], count: int, seed: int, byte_budget: int, *, max_draws: int = 20_000_000) -> DataFrame:
    """nth, origin_file, origin_group, origin_row of ``count`` rows drawn without replacement from row groups (file, group, bytes, rows).

    Draw i names the position sha256("seed:i") modulo all rows. A row group comes in with the first draw that names it if its bytes still fit into the budget, and stays out else, as
    what is left of the budget never grows; a position that came already is passed over. Draws are made in Spark, of which the driver sees the first of each row group; more are made until
    there are enough rows, or all rows that the budget lets in, or ``max_draws``."""
    if seed < 0 or byte_budget < 1 or count < 1:
        raise ValueError("the seed is zero or more, the budget and the count are one or more")
    starts = np.concatenate([[0], np.cumsum([g[3] for g in groups])]).astype(np.int64)
    total = int(starts[-1])
    if total < 1 or any(g[2] < 0 or g[3] < 0 for g in groups):
        raise ValueError("there are no rows to draw from")

    def drawn(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            at = np.array([int(hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), 16) % total for i in pdf["id"]], dtype=np.int64)
            group = np.searchsorted(starts, at, side="right") - 1
            yield pd.DataFrame({"i": pdf["id"], "g": group, "row": at - starts[group]})

    draws = min(max(4 * count, 1000), max_draws)
    while True:
        made = spark.range(draws).mapInPandas(drawn, "i long, g int, row long")
        left, admitted = byte_budget, []
        for r in made.groupBy("g").agg(F.min("i").alias("i")).orderBy("i").collect():  # a row for each row group
            if groups[r["g"]][2] <= left:
                left -= groups[r["g"]][2]
                admitted.append(r["g"])
        names = spark.createDataFrame([(g, groups[g][0], groups[g][1]) for g in admitted], "g int, origin_file string, origin_group int")
        rows = made.join(F.broadcast(names), "g").groupBy("origin_file", "origin_group", F.col("row").alias("origin_row")).agg(F.min("i").alias("i"))
        found = rows.count()
        if found >= count or draws >= max_draws or len(admitted) == len(groups) and found == total:
            break
        if admitted and found == sum(groups[g][3] for g in admitted) and min((g[2] for i, g in enumerate(groups) if i not in set(admitted)), default=left + 1) > left:
            break  # the budget lets nothing more in
        draws = min(4 * draws, max_draws)
    nth = F.row_number().over(Window.orderBy("i"))  # of ``count`` rows
    return rows.orderBy("i").limit(count).select(nth.alias("nth"), "origin_file", "origin_group", "origin_row")


def draw_row_groups(spark: SparkSession, path: str, count: int, seed: int, byte_budget: int) -> DataFrame:
    """The rows that ``budgeted_draw`` names from the Parquet files at a path, with nth, origin_file, origin_group and origin_row."""
    known = parquet_row_groups(spark, path)
    sizes = parquet_row_groups(spark, path, sizes=True)
    named = budgeted_draw(spark, sizes, count, seed, byte_budget)
    starts = spark.createDataFrame([(f, g, first) for f, g, first, _ in known], "_file string, _group int, _first long")  # a row for each row group
    named = named.join(F.broadcast(starts), (F.col("origin_file") == F.col("_file")) & (F.col("origin_group") == F.col("_group")))
    named = named.select("nth", "origin_file", "origin_group", "origin_row", (F.col("_first") + F.col("origin_row")).alias("_index"))
    rows = spark.read.parquet(path).select("*", F.col("_metadata.file_name").alias("_name"), F.col("_metadata.row_index").alias("_at"))
    return rows.join(named, (F.col("_name") == F.col("origin_file")) & (F.col("_at") == F.col("_index"))).drop("_name", "_at", "_index")


def draw_filtered(spark: SparkSession, path: str, count: int, seed: int, byte_budget: int, condition: Column, *, max_candidates: int = 100_000) -> DataFrame:
    """The first ``count`` rows, in the order in which ``draw_row_groups`` draws them, for which ``condition`` holds; refused if ``max_candidates`` draws and the budget don't give as many."""
    asked = min(4 * count, max_candidates)
    while True:
        drawn = draw_row_groups(spark, path, asked, seed, byte_budget)
        kept = drawn.where(condition)
        found = kept.count()
        if found >= count:
            return kept.orderBy("nth").limit(count)
        if asked >= max_candidates or drawn.count() < asked:
            raise ValueError(f"{found} rows pass the filter within the bounds; {count} are asked for")
        asked = min(4 * asked, max_candidates)


def shards(names: list[str], count: int, seed: int) -> list[str]:
    """``count`` of the shard names, by hash."""
    return sorted(names, key=lambda n: hashlib.sha256(f"{seed}:{n}".encode()).hexdigest())[:count]


def drawn_positions(total: int, count: int, seed: int) -> list[int]:
    """``count`` different positions below ``total``, in the order in which hashes of 0, 1, ... name them."""
    out: dict[int, None] = {}
    i = 0
    while len(out) < min(count, total):
        out[int(hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), 16) % total] = None
        i += 1
    return list(out)


def draw_rows(rows: DataFrame, ordinal: str, total: int, count: int, seed: int, condition: Column | None = None) -> DataFrame:
    """The rows at ``drawn_positions`` of those for which ``condition`` holds; positions are numbers that a filter leaves as they are."""
    if condition is None:
        drawn = rows.sparkSession.createDataFrame([(p,) for p in drawn_positions(total, count, seed)], "_p long")
        return rows.join(drawn, F.col(ordinal) == F.col("_p"), "left_semi")
    kept = rows.where(condition)
    return kept.withColumn("_r", sha_rank(seed, F.col(ordinal))).orderBy("_r", ordinal).limit(count).drop("_r")


def first_usable(rows: DataFrame, usable: Column, count: int, *order: str) -> DataFrame:
    """The first ``count`` rows in order whose media can be used."""
    return rows.where(usable).orderBy(*order).limit(count)
