"""Approximate nearest neighbours by randomly rotated one-bit codes.

A vector is rotated by a random orthogonal matrix and kept as one sign bit a component, with two scalars: its norm and the
inner product of its direction with its code. From these, the inner product of a query with the vector is estimated without
bias, and the error is at most ``epsilon`` times a known deviation but for a small chance. Vectors whose upper bound reaches
the score of the k-th best vector found so far are reranked by the exact inner product in double precision.

Scale: queries and vectors are dealt over blocks of about ``QUERY_BLOCK`` and ``BLOCK`` rows, and each pair of blocks is one
group of bounded size; it returns k rows a query, and the best k of these are the result. Vectors travel once for each block of
queries. With queries in proportion to the rows the work is that of their product, but per vector and query it is 64 sign
bits against a rotated query, as one matrix product, and a comparison; only what passes the bound reads the vector itself.

Nulls: vectors that are null, zero, empty or hold null or non-finite components take no part, neither do null ids. Vectors of
different lengths never meet. Of the rows with a repeated id, each is a candidate, and the smallest vector asks. Ties go to the
smaller id. An empty table gives an empty table.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm._common import Scratch

QUERY_BLOCK, BLOCK, SEED = 8192, 8192, 13


@cache
def rotation(dim: int) -> np.ndarray:
    return np.linalg.qr(np.random.default_rng(SEED).standard_normal((dim, dim)))[0]


def encode(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(packed sign bits, norms, inner products of directions and codes)."""
    norm = np.linalg.norm(vectors, axis=1)
    turned = (vectors / norm[:, None]) @ rotation(vectors.shape[1])
    bits = turned >= 0
    return np.packbits(bits, axis=1), norm, np.abs(turned).sum(axis=1) / np.sqrt(vectors.shape[1])


def exact(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Row-wise inner products, added up from the first component on."""
    return np.cumsum(queries * vectors, axis=1)[:, -1]


def best(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, codes: np.ndarray, norm: np.ndarray, fit: np.ndarray, k: int, epsilon: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query ids, ids, scores): up to k nearest of ``vectors`` for each query."""
    dim, n = queries.shape[1], len(ids)
    signs = (np.unpackbits(codes, axis=1, count=dim).astype(np.float32) * 2 - 1) / np.float32(np.sqrt(dim))
    scale = (norm / fit).astype(np.float32)
    slack = (epsilon * norm * np.sqrt(np.maximum(1 - fit**2, 0)) / fit / np.sqrt(max(dim - 1, 1))).astype(np.float32)
    length = np.linalg.norm(queries, axis=1)
    turned = ((queries / length[:, None]) @ rotation(dim)).astype(np.float32)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for start in range(0, len(queries), 256):
        q, own = queries[start : start + 256], ids[None, :] == query_ids[start : start + 256, None]
        estimate = (turned[start : start + 256] @ signs.T) * scale
        estimate[own] = -np.inf
        bound = np.full(len(q), -np.inf)
        if n > 8 * k:
            head = np.argpartition(-estimate, 5 * k, axis=1)[:, : 5 * k]
            score = exact(np.repeat(q, 5 * k, axis=0), vectors[head.ravel()]).reshape(head.shape)
            score[np.take_along_axis(own, head, axis=1)] = -np.inf
            bound = -np.partition(-score, k - 1, axis=1)[:, k - 1]
        reach = (estimate + slack) * length[start : start + 256, None].astype(np.float32) >= (bound - 1e-6 * np.abs(bound))[:, None].astype(np.float32)
        reach &= ~own
        for i in range(len(q)):
            col = np.flatnonzero(reach[i])
            score = vectors[col] @ q[i]
            if len(col) > k:  # the last bits of a product depend on where its row stands: what is near the k-th is added up again
                col = col[score >= -np.partition(-score, k - 1)[k - 1] - 1e-9 * length[start + i] * norm[col]]
            score = exact(np.broadcast_to(q[i], (len(col), dim)), vectors[col]) if len(col) else np.zeros(0)
            order = np.lexsort((ids[col], -score))[:k]
            found.append((np.full(len(order), query_ids[start + i]), ids[col[order]], score[order]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def search(table: DataFrame, is_query: Column, k: int = 20, *, epsilon: float = 3.5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k rows with the largest inner products that were found for each query."""
    scratch = Scratch(table.sparkSession, "nearest")
    v = F.col(vector_col).cast("array<double>")
    whole = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    usable = table.where(F.col(id_col).isNotNull() & F.coalesce(whole, F.lit(False))).select(F.col(id_col).cast("long").alias("id"), v.alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    schema = "id long, v array<double>, asks boolean, dim int, code binary, norm double, fit double"

    def code(batches):
        for pdf in batches:
            dims = pdf["v"].map(len)
            for dim, part in pdf.groupby(dims.values):
                bits, norm, fit = encode(np.stack(part["v"].to_numpy()))
                yield part.assign(dim=np.int32(dim), code=[b.tobytes() for b in bits], norm=norm, fit=fit)

    index = scratch.write(usable.mapInPandas(code, schema))
    asked, rows = index.agg(F.count_if("asks"), F.count(F.lit(1))).first()
    q_blocks, blocks = max(-(-asked // QUERY_BLOCK), 1), max(-(-rows // BLOCK), 1)
    block = lambda n, salt: F.pmod(F.xxhash64(F.lit(salt), "id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    queries = index.where("asks").groupBy("id").agg(F.min("v").alias("v"))
    queries = queries.select("id", "v", F.size("v").alias("dim"), block(q_blocks, 1).alias("qb"), every(blocks).alias("cb"))
    rows_of = index.select("id", "v", "dim", "code", "norm", "fit", block(blocks, 2).alias("cb"), every(q_blocks).alias("qb"))

    def pair(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if q.empty or c.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64"})
        codes = np.stack([np.frombuffer(x, dtype=np.uint8) for x in c["code"]])
        a, b, s = best(q["id"].to_numpy(), np.stack(q["v"].to_numpy()), c["id"].to_numpy(), np.stack(c["v"].to_numpy()), codes, c["norm"].to_numpy(), c["fit"].to_numpy(), k, epsilon)
        return pd.DataFrame({"query_id": a, "vec_id": b, "score": s})

    keys = ["dim", "qb", "cb"]
    near = queries.groupBy(*keys).cogroup(rows_of.groupBy(*keys)).applyInPandas(pair, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
