"""Sharding as vector bin packing: bytes, tokens and rows are balanced jointly.

The groups to place are equal texts. A group goes to the shard where the dot product of its (bytes, tokens, rows), each as a
share of the total, with the shard's residual capacity is highest; larger groups go first.

Scale: one pass reduces each text to a digest and three numbers, one shuffle adds them up by digest. Groups are dealt by
digest over up to 4096 tiles, and each tile packs its own against its part of the capacity; groups too heavy for a tile, of
which there are at most 3 x shards x tiles by pigeonhole, are packed before, against the whole capacity. A group of more
than a shard's whole capacity in any measure can stay whole in no even layout; it is cut into pieces of equal numbers of rows, dealt by
a row's place in its group (counts by the task that read it, added up), whatever its id. Slots are counted by (shard, row hash) and
added up, so that neither a group nor a shard is sorted in one task.

Nulls: a null text has no bytes (size 1), no tokens, and no digest; all null texts are a group of their own. Rows of a null or repeated
id are rows of their own, as are repeated rows. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm._common import Scratch, n_bytes, n_words

#: Groups of a tile, about; tiles at most; rows of a slot range, about.
TILE_GROUPS, MOST_TILES, SLOT_ROWS = 20_000, 4096, 400


def pack(weights: np.ndarray, capacity: np.ndarray, turn: int = 0) -> np.ndarray:
    """The shard of each group. weights: groups x 3, capacity: shards x 3. ``turn`` decides which shard a tie goes to."""
    scale = np.maximum(capacity.sum(axis=0), 1e-12)
    w, residual = weights / scale, np.roll(capacity / scale, -turn, axis=0)
    shards = np.empty(len(w), dtype=np.int32)
    for i in np.lexsort((np.arange(len(w)), -w.max(axis=1))) if len(w) else ():
        shards[i] = at = int((residual @ w[i]).argmax())
        residual[at] -= w[i]
    return (shards + turn) % len(capacity)


def _packer(residual: np.ndarray, light: np.ndarray) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def run(tile: pd.DataFrame) -> pd.DataFrame:
        tile = tile.sort_values(["_key", "_piece"], na_position="first", ignore_index=True)
        w = tile[["_b", "_t", "_r"]].to_numpy(dtype=float)
        shards = pack(w, residual * (w.sum(axis=0) / np.maximum(light, 1e-12)), int(tile["_tile"].iloc[0]) % len(residual))
        return pd.DataFrame({"_key": tile["_key"], "_piece": tile["_piece"], "_b": tile["_b"], "_t": tile["_t"], "_r": tile["_r"], "shard": shards})

    return run


def shard(docs: DataFrame, shards: int = 16, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row: doc_id, size, text_crc32, law ("bytes"), shard, slot, grown_shard (null)."""
    scratch = Scratch(docs.sparkSession, "shard")
    text = F.col(text_col)
    rows = scratch.write(docs.select(F.col(id_col).alias("doc_id"), (n_bytes(text) + 1).alias("size"), F.crc32(text).alias("text_crc32"), n_words(text).alias("_tokens"), F.unhex(F.md5(text)).alias("_key"), F.spark_partition_id().alias("_task"), F.monotonically_increasing_id().alias("_row")))
    groups = rows.groupBy("_key").agg(F.sum("size").alias("_b"), F.sum("_tokens").alias("_t"), F.count(F.lit(1)).alias("_r"))
    total = groups.agg(F.sum("_b"), F.sum("_t"), F.sum("_r"), F.count(F.lit(1))).first()
    whole, n = np.array([x or 0 for x in total[:3]], dtype=float), total[3]
    tiles = min(max(-(-n // TILE_GROUPS), 1), MOST_TILES)
    share = F.greatest(*[F.col(c) / F.lit(max(x, 1.0)) for c, x in zip(("_b", "_t", "_r"), whole, strict=True)])  # of the total, in the measure where it is largest
    groups = groups.withColumn("_share", share)
    pieces = F.when(F.col("_share") > 1.0 / shards, F.least(F.ceil(F.col("_share") * (4 * shards)), F.col("_r"))).otherwise(F.lit(1)).cast("int")
    groups = groups.withColumn("_n", pieces).withColumn("_piece", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    for c in ("_b", "_t", "_r"):
        groups = groups.withColumn(c, F.col(c) / F.col("_n"))
    groups = groups.withColumn("_tile", F.when(F.col("_share") > 1.0 / (shards * tiles), F.lit(-1)).otherwise(F.pmod(F.xxhash64("_key"), F.lit(tiles))).cast("int")).drop("_share", "_n")
    groups = scratch.write(groups)
    schema = "_key binary, _piece int, _b double, _t double, _r double, shard int"
    even = np.tile(whole / shards, (shards, 1))
    heavy = scratch.write(groups.where("_tile = -1").groupBy("_tile").applyInPandas(_packer(even, whole), schema))
    load = heavy.groupBy("shard").agg(F.sum("_b"), F.sum("_t"), F.sum("_r")).collect()  # a row for each shard at most
    residual = even.copy()
    for r in load:
        residual[r[0]] -= r[1:]
    light = groups.where("_tile >= 0").groupBy("_tile").applyInPandas(_packer(residual, whole - sum((np.array(r[1:], dtype=float) for r in load), np.zeros(3))), schema)
    placed = light.unionByName(heavy).groupBy("_key").agg(F.transform(F.sort_array(F.collect_list(F.struct("_piece", "shard"))), lambda x: x["shard"]).alias("_shards")).withColumnRenamed("_key", "_k")
    placed = scratch.write(placed)  # at most 4 x shards pieces of a group
    joined = rows.join(placed, F.col("_key").eqNullSafe(F.col("_k"))).drop("_k")
    whole_group, cut = joined.where(F.size("_shards") == 1).withColumn("_nth", F.lit(0)), joined.where(F.size("_shards") > 1)
    reads = cut.groupBy("_key", "_task").agg(F.count(F.lit(1)).alias("_c"))  # of at most 3 x shards groups
    ahead = F.coalesce(F.sum("_c").over(Window.partitionBy("_key").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    reads = reads.select(F.col("_key").alias("_k"), F.col("_task").alias("_p"), ahead.alias("_ahead"))
    cut = cut.withColumn("_nth", F.row_number().over(Window.partitionBy("_key", "_task").orderBy("_row")))
    cut = cut.join(reads, F.col("_key").eqNullSafe(F.col("_k")) & (F.col("_task") == F.col("_p"))).withColumn("_nth", F.col("_ahead") + F.col("_nth")).select(*whole_group.columns)
    at = (F.col("_nth") % F.size("_shards")).cast("int")
    joined = whole_group.unionByName(cut).select("doc_id", "size", "text_crc32", "_row", F.get("_shards", at).alias("shard"))
    ranges = min(max(int(whole[2]) // (shards * SLOT_ROWS), 1), 1 << 16)
    joined = scratch.write(joined.withColumn("_range", F.pmod(F.xxhash64(F.lit(11), "_row"), F.lit(ranges)).cast("int")))
    for used in (rows, groups, heavy, placed):
        scratch.drop(used)
    counts = joined.groupBy("shard", "_range").agg(F.count(F.lit(1)).alias("_c"))
    counts = counts.select(F.col("shard").alias("_s"), F.col("_range").alias("_g"), F.coalesce(F.sum("_c").over(Window.partitionBy("shard").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_ahead"))
    place = F.row_number().over(Window.partitionBy("shard", "_range").orderBy("_row"))
    out = joined.withColumn("_place", place).join(counts, (F.col("shard") == F.col("_s")) & (F.col("_range") == F.col("_g")))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("_ahead") + F.col("_place") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
