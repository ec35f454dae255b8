"""Half-open bucket labels and zero-filled histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Histogram edges (lo, hi); hi None is the open last bucket.
TOKEN_BUCKETS = [(0, 128), (128, 256), (256, 512), (512, 1024), (1024, 2048), (2048, None)]
TURN_BUCKETS = [(0, 2), (2, 4), (4, 8), (8, 16), (16, None)]


def bucket_labels(buckets) -> list[str]:
    return [f"{lo}-{hi}" if hi is not None else f"{lo}+" for lo, hi in buckets]


def histogram(df: DataFrame, col, buckets, by: list[str] | None = None) -> DataFrame:
    """Long-form histogram ``(*by, bucket, bucket_order, n)``; empty buckets are 0.

    One aggregate with a ``count_if`` per bucket (partial aggregation, no
    shuffle of rows), then ``stack`` to long form.
    """
    by = by or []
    c = F.col(col) if isinstance(col, str) else col
    labels = bucket_labels(buckets)
    aggs = []
    for i, ((lo, hi), label) in enumerate(zip(buckets, labels)):
        cond = c >= lo if hi is None else (c >= lo) & (c < hi)
        aggs.append(F.count_if(cond).alias(f"_b{i}"))
    wide = df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)
    pairs = ", ".join(f"'{label}', {i}, _b{i}" for i, label in enumerate(labels))
    return wide.select(
        *by, F.expr(f"stack({len(labels)}, {pairs}) as (bucket, bucket_order, n)")
    ).withColumn("bucket_order", F.col("bucket_order").cast("int"))
