"""Exact top-k search by inner product: a pivot-distance index.

Vectors are scaled to integers. One more coordinate, ``sqrt(M^2 - |v|^2)``
with ``M`` the longest vector, turns the largest inner product into the
smallest distance, so the triangle inequality holds. Every vector is keyed
by its nearest pivot and its distance to it; a ring of distances around a
pivot is an annulus. A query visits annuli in the order of the lower bound
``max(0, d(q, p) - outer, inner - d(q, p))``: first as many as hold k
candidates, which gives it a k-th distance, then all that are not farther
than that distance.

Large annuli are split by a hash of the id, so a vector that fills a third
of the table is spread over many tasks. The annuli list is bounded by
``max_pivots ** 2``; it alone is broadcast.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tuneframe.llm.common import cut

SLACK = 1e-6


def usable(vec: Column) -> Column:
    """A vector takes part if neither it nor a component is null, NaN or infinite, and it isn't empty."""
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return vec.isNotNull() & (F.size(vec) > 0) & ~bad


def stack(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype="<i8").reshape(len(column), -1)


def products(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Integer inner products; floating point carries them exactly while they stay under 2**53."""
    a, b = (float(np.abs(x.astype(np.float64)).max(initial=0)) for x in (q, v))
    if a * b * q.shape[1] < 2.0**53:
        return np.rint(q.astype(np.float64) @ v.astype(np.float64).T).astype(np.int64)
    return q @ v.T


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best by score, then by smaller id."""
    return np.lexsort((ids, -scores))[:k]


def choose_pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """Farthest-first pivots from a sample in the widened space."""
    picked = [0]
    far = np.linalg.norm(sample - sample[0], axis=1)
    while len(picked) < min(count, len(sample)) and far.max() > 0:
        picked.append(int(far.argmax()))
        far = np.minimum(far, np.linalg.norm(sample - sample[picked[-1]], axis=1))
    return sample[picked]


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    sq = (a**2).sum(1)[:, None] + (b**2).sum(1)[None, :] - 2 * a @ b.T
    return np.sqrt(np.maximum(sq, 0))


def search(queries: DataFrame, vectors: DataFrame, k: int = 10, scale: int = 1024, sample: int = 2048,
           part_rows: int = 4096, query_rows: int = 2048, max_pivots: int = 64) -> DataFrame:
    """The k best of ``vectors(id, vec)`` for each of ``queries(id, vec)`` but itself, exactly.

    Returns ``query_id, rank, vec_id, score``; the score is the integer inner
    product of ``floor(scale * x)``, ties go to the smaller id. Queries with
    fewer candidates get all. Vectors that are null, empty or hold null, NaN
    or infinite components take no part, nor do null ids. A query meets vectors of its own
    length only. Rows that repeat an id are candidates of their own (but a
    query never meets its own id). Integers are 64 bits: exact while a
    product stays under 2**63. ``sample`` bounds the rows that pivots are
    chosen from; every row is indexed, whatever its distance.
    """
    def whole(df):
        ok = df.filter(usable(F.col("vec")) & F.col("id").isNotNull())
        ints = F.transform("vec", lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long"))
        return ok.select(F.col("id").cast("long").alias("id"), F.size("vec").alias("dim"), ints.alias("v"))

    spark = vectors.sparkSession
    # As many annuli as fill about a thousand rows each, up to max_pivots ** 2: a bounded list at any size.
    pivots = rings = min(max_pivots, max(4, math.ceil(math.sqrt(vectors.count() / 1024))))
    out_schema = "query_id long, vec_id long, score long"
    base = whole(vectors)
    square = F.aggregate(F.transform("v", lambda x: x.cast("double") * x), F.lit(0.0), lambda a, b: a + b)
    stats = {r["dim"]: r["m"] for r in base.groupBy("dim").agg(F.max(square).alias("m")).collect()}
    # A bounded, seeded sample per vector length (there is one length in a sound table).
    chosen = {}
    for dim in stats:
        some = base.filter(F.col("dim") == dim).orderBy(F.xxhash64("id"), "id").limit(sample)
        chosen[dim] = [r["v"] for r in some.select("v").collect()]

    def widen(v: np.ndarray, dim: int) -> np.ndarray:
        f = v.astype(np.float64)
        return np.hstack([f, np.sqrt(np.maximum(stats[dim] - (f**2).sum(1), 0))[:, None]])

    points = {d: choose_pivots(widen(np.array(rows, dtype=np.int64), d), pivots) for d, rows in chosen.items()}
    # Rings cut the widest possible distance evenly: two points are at most 2 M apart.
    width = {d: max(1e-9, 2 * math.sqrt(stats[d]) * 1.0000001 / rings) for d in points}

    def assign(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for dim, g in pdf.groupby("dim"):
                v = np.array(g["v"].tolist(), dtype=np.int64)
                w = widen(v, dim)
                d = distances(w, points[dim])
                pivot = d.argmin(1)
                # Taken anew from differences: precise also for points next to a pivot.
                near = np.linalg.norm(w - points[dim][pivot], axis=1)
                yield pd.DataFrame({"id": g["id"].to_numpy(), "dim": dim, "pivot": pivot.astype(np.int32), "dist": near,
                                    "ring": np.floor(near / width[dim]).astype(np.int32),
                                    "v": [x.astype("<i8").tobytes() for x in v]})

    index = cut(base.mapInPandas(assign, "id long, dim int, pivot int, dist double, ring int, v binary"))
    key = ["dim", "pivot", "ring"]
    per = index.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.min("dist").alias("a"), F.max("dist").alias("b")).collect()
    annuli: dict[int, dict[str, np.ndarray]] = {}
    for dim in points:
        own = [r for r in per if r["dim"] == dim]
        annuli[dim] = {c: np.array([r[c] for r in own]) for c in ("pivot", "ring", "n", "a", "b")}
        annuli[dim]["splits"] = -(-annuli[dim]["n"] // part_rows)
    n_queries = queries.count()
    chunks = max(1, -(-n_queries // query_rows))

    def visit(it: Iterator[pd.DataFrame], first: bool) -> Iterator[pd.DataFrame]:
        """The annuli each query visits; first: the nearest that hold k candidates, else the rest within its bound."""
        for pdf in it:
            for dim, g in pdf.groupby("dim"):
                if dim not in points:
                    continue
                ring = annuli[dim]
                v = np.array(g["v"].tolist(), dtype=np.int64)
                f = v.astype(np.float64)
                # The query's own extra coordinate is 0.
                w = np.hstack([f, np.zeros((len(f), 1))])
                d = np.sqrt(((w[:, None, :] - points[dim][None, :, :]) ** 2).sum(2)) if len(w) < 64 else distances(w, points[dim])
                d = d[:, ring["pivot"]]
                slack = SLACK * (1 + d) + 1e-3
                low = np.maximum(0, np.maximum(d - ring["b"], ring["a"] - d) - slack)
                order = np.argsort(low, axis=1, kind="stable")
                rows = []
                for i in range(len(g)):
                    o = order[i]
                    start = int(np.searchsorted(np.cumsum(ring["n"][o]), k + 1)) + 1
                    if first:
                        o = o[:start]
                    else:
                        kth = g["kth"].iloc[i]
                        bound = np.inf if np.isnan(kth) else math.sqrt(max(0.0, float((f[i] ** 2).sum()) + stats[dim] - 2 * kth)) * (1 + SLACK) + 1e-3
                        o = o[start:]
                        o = o[low[i][o] <= bound]
                    raw = v[i].astype("<i8").tobytes()
                    for j in o:
                        for part in range(int(ring["splits"][j])):
                            rows.append((g["id"].iloc[i], dim, int(ring["pivot"][j]), int(ring["ring"][j]), part, g["kth"].iloc[i], raw))
                yield pd.DataFrame(rows, columns=["query_id", "dim", "pivot", "ring", "part", "kth", "v"])

    splits = spark.createDataFrame(
        [(int(d), int(a["pivot"][j]), int(a["ring"][j]), int(a["splits"][j])) for d, a in annuli.items() for j in range(len(a["n"]))],
        "dim int, pivot int, ring int, splits int")
    placed = index.join(F.broadcast(splits), key)  # at most max_pivots ** 2 rows
    placed = placed.withColumn("part", F.pmod(F.xxhash64(F.lit(3), "id"), F.col("splits")).cast("int"))
    key = [*key, "part"]

    def scan(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        """The k best of one annulus for each query that visits it, unless its bound rules them out."""
        ids, v = right["id"].to_numpy(), None
        got = []
        if len(left) and len(right):
            v = stack(right["v"])
            scores = products(stack(left["v"]), v)
            for i, (q, kth) in enumerate(zip(left["query_id"], left["kth"], strict=True)):
                ok = ids != q
                if not np.isnan(kth):
                    ok &= scores[i] >= kth
                at = np.flatnonzero(ok)
                top = at[best(scores[i][at], ids[at], k)]
                got.append(pd.DataFrame({"query_id": q, "vec_id": ids[top], "score": scores[i][top]}))
        if not got:
            return pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="int64")})
        return pd.concat(got)

    visit_schema = "query_id long, dim int, pivot int, ring int, part int, kth double, v binary"

    def pass_over(asked: DataFrame, first: bool) -> DataFrame:
        plan = asked.mapInPandas(lambda it: visit(it, first), visit_schema)
        plan = plan.withColumn("chunk", F.pmod(F.xxhash64("query_id"), F.lit(chunks)).cast("int"))
        side = placed if chunks == 1 else placed.crossJoin(F.broadcast(spark.range(chunks).select(F.col("id").cast("int").alias("chunk"))))
        side = side.withColumn("chunk", F.lit(0)) if chunks == 1 else side
        return plan.groupBy(*key, "chunk").cogroup(side.groupBy(*key, "chunk")).applyInPandas(scan, out_schema)

    asked = whole(queries).dropDuplicates(["id"])
    one = cut(pass_over(asked.withColumn("kth", F.lit(float("nan"))), True))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = one.withColumn("rank", F.row_number().over(order))
    bound = ranked.filter(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").cast("double").alias("kth"))
    two = pass_over(asked.join(bound, "id", "left").select("id", "dim", "v", F.coalesce("kth", F.lit(float("nan"))).alias("kth")), False)
    merged = one.union(two).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return merged.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
