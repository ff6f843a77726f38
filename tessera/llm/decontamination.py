"""Benchmark decontamination: size-partitioned MinHash containment search, with DataFrame operations only.

An item is in a document if the document has at least ``threshold`` of the item's distinct word shingles. Texts are
lower-cased (A to Z), words are runs without ASCII white space; shingles are compared by 64-bit hashes of their words. An item of fewer words than a
shingle is a shingle of its own, and is in a document that has its words one after the other; documents have shingles of the lengths that such items have.

1. Each document's set is restricted to shingles that the benchmark has. That leaves every containment as it is, and makes
   a long document as small as what it shares with the benchmark. Documents with equal sets are one from here on.
2. The sets are partitioned by size, with powers of two as upper bounds u. In a partition, an item of q shingles that is
   contained to ``threshold`` has a Jaccard similarity of at least t q / (u + q - t q) with the set, and so shares one of its
   first b MinHash values with it but for a chance of at most ``miss``, if b is chosen for that similarity.
3. Where b would be over ``HASHES``, all shingles of the item stand for its hash values, so that nothing is missed there.
4. Sets that share a value with an item are verified by their exact containment.

Scale: one pass makes the shingles of a document in its row. The benchmark's shingles are broadcast if they are counted to be
``BROADCAST_ROWS`` or fewer, and joined by a shuffle beyond that; what is left of the documents is small.

Nulls: null texts have no words; an item without words is in nothing. Items under ``shortest`` words, if that is asked for, take no part. Rows with a null id take no
part; rows of one id are one document, or one item. A text is held as a whole in its row. Empty tables give an empty table.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm._common import ascii_lower

HASHES, BROADCAST_ROWS = 128, 2_000_000


def shingles(words: Column, width: int) -> Column:
    """Hashes of the shingles of an array of words, repeats included; none if there are fewer words."""
    return F.when(F.size(words) >= width, F.transform(F.sequence(F.lit(0), F.size(words) - width), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(width)]))).otherwise(F.array().cast("array<long>"))


def _words(df: DataFrame, id_col: str, text_col: str, name: str) -> DataFrame:
    return df.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias(name), F.array_remove(F.split(ascii_lower(F.col(text_col)), r"[\x20\x09-\x0D]+"), "").alias("w"))


def contained(docs: DataFrame, benchmark: DataFrame, *, width: int = 5, threshold: float = 0.8, miss: float = 1e-9, shortest: int = 1, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """A row for each document and item that it contains: doc_id, item_id, n_item (the item's distinct shingles), n_shared, containment."""
    of_item = _words(benchmark, item_col, item_text_col, "item_id").where(F.size("w") >= shortest)
    short = sorted(r[0] for r in of_item.where(F.size("w").between(1, width - 1)).select(F.size("w")).distinct().collect())  # under ``width`` lengths
    hashes = F.when(F.size("w") >= width, shingles(F.col("w"), width))
    for m in short:
        hashes = hashes.when(F.size("w") == m, shingles(F.col("w"), m))
    items = of_item.where(F.size("w") > 0).select("item_id", F.explode(hashes).alias("h")).groupBy("item_id").agg(F.collect_set("h").alias("hs")).withColumn("q", F.size("hs"))
    vocabulary = items.select(F.explode("hs").alias("h")).distinct()
    if vocabulary.count() <= BROADCAST_ROWS:
        vocabulary = F.broadcast(vocabulary)
    all_widths = [shingles(F.col("w"), m) for m in (*short, width)]
    found = _words(docs, id_col, text_col, "doc_id").where(F.size("w") >= min([*short, width])).select("doc_id", F.explode(F.concat(*all_widths) if short else all_widths[0]).alias("h")).join(vocabulary, "h", "left_semi")
    of_doc = found.groupBy("doc_id").agg(F.sort_array(F.collect_set("h")).alias("hs"))
    of_doc = of_doc.withColumn("set", F.sha2(F.array_join(F.transform("hs", lambda h: F.hex(h)), ","), 256))
    sets = of_doc.groupBy("set").agg(F.first("hs").alias("hs")).withColumn("part", F.ceil(F.log2(F.size("hs"))).cast("int"))

    def value(i: Column) -> Column:
        return F.array_min(F.transform("hs", lambda h: F.xxhash64(h, i)))

    hashed = F.explode(F.sequence(F.lit(0), F.lit(HASHES - 1)))
    keys = sets.withColumn("i", hashed).select("set", "part", "i", value(F.col("i")).alias("v"))
    keys = keys.unionByName(sets.select("set", "part", F.lit(-1).alias("i"), F.explode("hs").alias("v")))
    u, q, t = F.pow(F.lit(2.0), F.col("part")), F.col("q"), F.lit(threshold)
    similarity = F.least(t * q / (u + q - t * q), F.lit(1 - 1e-12))
    wanted = items.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(40)))).withColumn("b", F.ceil(F.lit(math.log(miss)) / F.log1p(-similarity)).cast("long"))
    wanted = wanted.where(u * 2 > t * q)  # smaller sets can't hold so much of the item
    asked = wanted.where(F.col("b") <= HASHES).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("b").cast("int") - 1))).select("item_id", "part", "i", value(F.col("i")).alias("v"))
    asked = asked.unionByName(wanted.where(F.col("b") > HASHES).select("item_id", "part", F.lit(-1).alias("i"), F.explode("hs").alias("v")))
    pairs = keys.join(asked, ["part", "i", "v"]).select("set", "item_id").distinct()
    verified = pairs.join(sets.select("set", "hs"), "set").join(items.select("item_id", F.col("hs").alias("_hs"), "q"), "item_id")
    verified = verified.withColumn("n_shared", F.size(F.array_intersect("hs", "_hs")).cast("long")).where(F.col("n_shared") >= F.lit(threshold) * F.col("q"))
    out = of_doc.select("doc_id", "set").join(verified, "set")
    return out.select("doc_id", "item_id", F.col("q").cast("long").alias("n_item"), "n_shared", (F.col("n_shared") / F.col("q")).alias("containment"))
