"""Approximate nearest neighbours: a block matrix join of int8 tiles.

Queries and vectors are dealt to blocks; every pair of a query block and a
vector block is one tile. Both sides are quantised to int8 with a scale per
vector, so a tile is one integer matrix product. The quantisation error of
every product is bounded, ``|q.v - q'.v'| <= s_v/2 |q|_1 + s_q/2 |v'|_1``:
a pair whose upper bound lies under the k-th best lower bound of its tile
can't be among the k best and is dropped; the survivors are computed again
in double precision and kept in heaps of k, which are merged per query.
Because the bounds are proven, the result is exact for any data; recall is 1.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tuneframe.llm.topk import usable

STRIP = 256


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows as ``scale * int8``."""
    scale = np.abs(x).max(axis=1) / 127.0
    return np.rint(x / scale[:, None]).astype(np.int8), scale


def exact(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Inner products in double precision, summed in the order of the components."""
    out = np.zeros(len(v))
    for j in range(v.shape[1]):
        out = out + q[j] * v[:, j]
    return out


def tile(qid: np.ndarray, q: np.ndarray, vid: np.ndarray, v: np.ndarray, k: int) -> Iterator[tuple[int, int, float]]:
    """The k best of one vector block for every query of one query block."""
    iv, sv = quantise(v)
    fv, l1 = iv.astype(np.float32), np.abs(iv.astype(np.float64)).sum(1) * sv
    for a in range(0, len(q), STRIP):
        part = q[a : a + STRIP]
        iq, sq = quantise(part)
        # At most 127 * 127 a component: exact in single precision up to a thousand components, bounded beyond.
        whole = (iq.astype(np.float32) @ fv.T).astype(np.float64)
        near = whole * sq[:, None] * sv[None, :]
        slip = 0.5 * np.abs(part).sum(1)[:, None] * sv[None, :] + 0.5 * sq[:, None] * l1[None, :]
        slip = slip * (1 + 1e-5) + np.abs(near) * (1e-6 * max(1, q.shape[1] / 1024)) + 1e-300
        for i in range(len(part)):
            own = vid != qid[a + i]
            low = np.where(own, near[i] - slip[i], -np.inf)
            bar = np.partition(low, len(low) - k)[len(low) - k] if len(low) > k else -np.inf
            at = np.flatnonzero(own & (near[i] + slip[i] >= bar))
            scores = exact(part[i], v[at])
            heap: list[tuple[float, int]] = []
            for s, w in zip(scores.tolist(), vid[at].tolist(), strict=True):
                if len(heap) < k:
                    heapq.heappush(heap, (s, -w))
                else:
                    heapq.heappushpop(heap, (s, -w))
            for s, w in heap:
                yield int(qid[a + i]), -w, s


def neighbours(queries: DataFrame, vectors: DataFrame, k: int = 20, query_block: int = 4096, vector_block: int = 8192) -> DataFrame:
    """The k nearest of ``vectors(id, vec)`` for each of ``queries(id, vec)`` but itself, by inner product.

    Returns ``query_id, rank, vec_id, score``, nearest first, ties to the
    smaller id; the score is the product of the original vectors in double
    precision. Null, empty, zero vectors, vectors with null, NaN or infinite
    components and null ids take no part. A query meets vectors of its own length only. Rows
    that repeat an id are candidates of their own; a repeated query is
    answered once. Empty tables give no rows.
    """
    def valid(df):
        some = F.exists("vec", lambda x: x != 0)
        return df.filter(usable(F.col("vec")) & some & F.col("id").isNotNull()).select(
            F.col("id").cast("long").alias("id"), F.size("vec").alias("dim"),
            F.transform("vec", lambda x: x.cast("double")).alias("vec"))

    q, v = valid(queries).dropDuplicates(["id"]), valid(vectors)
    n_q, n_v = max(1, -(-q.count() // query_block)), max(1, -(-v.count() // vector_block))

    def numbers(n, name):
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)

    # A fixed hash deals rows to blocks; equal vectors have different ids, so a hot vector is spread.
    q = q.withColumn("qb", F.pmod(F.xxhash64(F.lit(5), "id"), F.lit(n_q)).cast("int")).select("*", numbers(n_v, "vb"))
    v = v.withColumn("vb", F.pmod(F.xxhash64(F.lit(9), "id"), F.lit(n_v)).cast("int")).select("*", numbers(n_q, "qb"))

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        rows: list[tuple[int, int, float]] = []
        if len(left) and len(right):
            a, b = (np.array(x["vec"].tolist(), dtype=np.float64) for x in (left, right))
            rows = list(tile(left["id"].to_numpy(), a, right["id"].to_numpy(), b, k))
        return pd.DataFrame({"query_id": pd.Series([r[0] for r in rows], dtype="int64"),
                             "vec_id": pd.Series([r[1] for r in rows], dtype="int64"),
                             "score": pd.Series([r[2] for r in rows], dtype="float64")})

    key = ["dim", "qb", "vb"]
    found = q.groupBy(*key).cogroup(v.groupBy(*key)).applyInPandas(run, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
