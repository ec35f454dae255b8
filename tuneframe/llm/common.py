"""Helpers shared by the operators: tables, lineage cuts, ranks and components."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
ASCII_SPACE = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, else one under the warehouse."""
    path = spark.sparkContext.getCheckpointDir()
    if not path:
        path = spark.conf.get("spark.checkpoint.dir", None)
        if not path:
            path = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
        spark.sparkContext.setCheckpointDir(path)
        path = spark.sparkContext.getCheckpointDir()
    return path


def cut(df: DataFrame) -> DataFrame:
    """Evaluate ``df`` once into the shared checkpoint folder and drop its lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder for written tables in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/llm/{name}-{uuid.uuid4().hex[:12]}"


#: Bytes of rows that Spark hands to a Python worker at once.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Whole texts go to Python workers some megabytes at a time, not ten thousand rows at a time."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.set(key, str(BATCH_BYTES))


def slices(batches, rows: int = 256):
    """Arrow batches in smaller pieces: what a worker holds besides a batch stays small, and goes back when the task ends."""
    lean()
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)
    give_back()


def lean() -> None:
    """Blocks of a megabyte and more that a worker frees go back to the system at once.

    The C library would raise its own bound to 32 MB and keep as much; several
    workers share an executor's memory and live on between tasks.
    """
    for option in (_MMAP_THRESHOLD, _TRIM_THRESHOLD):
        if _LIBC is not None:
            _LIBC.mallopt(option, 1 << 20)


def give_back() -> None:
    """Return what a finished task no longer uses."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


def _libc():
    try:
        found = ctypes.CDLL(None)
        return found if hasattr(found, "mallopt") and hasattr(found, "malloc_trim") else None
    except OSError:
        return None


# Option numbers of the C library's mallopt.
_TRIM_THRESHOLD, _MMAP_THRESHOLD = -1, -3
_LIBC = _libc()


def ascii_lower(col: Column) -> Column:
    """A-Z to a-z and nothing else. ``lower`` does just that when every character is ASCII."""
    return F.when(F.octet_length(col) == F.char_length(col), F.lower(col)).otherwise(
        F.translate(col, UPPER, LOWER)
    )


def slots(df: DataFrame, groups: Sequence[str], order: Sequence[str], name: str = "slot",
          rows_per_bucket: int = 4_000, size: str | None = None) -> DataFrame:
    """Number the rows of each group from 0 without holding a group in one task.

    Rows are dealt by a hash of ``order`` to buckets of about
    ``rows_per_bucket`` rows, numbered inside their bucket, and moved up by
    what the lower buckets of the group hold. The number of buckets follows
    the largest group, so a group with a third of all rows has as many
    buckets as it needs. With ``size`` the result is the exclusive running
    sum of that column instead of a running count. ``df`` is read three
    times, so it should be cheap or a lineage cut. ``groups`` must not hold
    nulls. Rows equal in ``order`` are numbered among themselves in any order.
    """
    groups, order = list(groups), list(order)
    most = df.groupBy(*groups).count().agg(F.max("count")).first()[0] or 0
    buckets = max(1, -(-most // rows_per_bucket))
    value = F.lit(1).cast("long") if size is None else F.col(size).cast("long")
    keyed = df.withColumn("_bucket", F.pmod(F.xxhash64(F.lit(17), *order), F.lit(buckets)).cast("int"))
    keyed = keyed.withColumn("_value", value)
    keys = [*groups, "_bucket"]
    per = keyed.groupBy(*keys).agg(F.sum("_value").alias("_sum")).withColumn("_block", F.expr("_bucket div 4096"))
    # Two levels of running sums: no frame spans more than 4096 buckets of a group.
    low = Window.partitionBy(*groups, "_block").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    high = Window.partitionBy(*groups).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    top = per.groupBy(*groups, "_block").agg(F.sum("_sum").alias("_top"))
    top = top.withColumn("_up", F.coalesce(F.sum("_top").over(high), F.lit(0))).drop("_top")
    per = per.withColumn("_low", F.coalesce(F.sum("_sum").over(low), F.lit(0))).join(top, [*groups, "_block"])
    start = per.select(*keys, (F.col("_low") + F.col("_up")).alias("_before"))
    inner = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = keyed.join(start, keys)
    out = out.withColumn(name, (F.col("_before") + F.coalesce(F.sum("_value").over(inner), F.lit(0))).cast("long"))
    return out.drop("_bucket", "_value", "_before")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components: ``edges(a, b)`` -> ``(node, component)``, the smallest node reachable.

    Alternating star contraction: each round hangs every node and its
    neighbours on the smallest node around it; a path of n nodes needs
    O(log^2 n) rounds. Every round is a grouped minimum (combined before the
    shuffle) and an equi-join that AQE may split, so a node with very many
    links costs no more than its links. Raises if ``rounds`` do not suffice.
    """
    e = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    for _ in range(rounds):
        # Large star: every neighbour above a node hangs on the smallest node around it.
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.alias("x").join(low.alias("y"), F.col("x.u") == F.col("y.u")).filter(F.col("x.v") > F.col("x.u"))
        # No more rows than links; those that repeat go once, below.
        large = large.select(F.col("x.v").alias("u"), F.col("y.m").alias("v")).filter("u <> v")
        # Small star: a node and its lower neighbours hang on the lowest of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.alias("x").join(least.alias("y"), F.col("x.u") == F.col("y.u"))
        pairs = small.select(F.col("x.v").alias("u"), F.col("y.m").alias("v")).union(
            least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        e = cut(pairs)
        # Settled when every node hangs on one node that hangs on none: a further round would change nothing.
        ends = e.select(F.col("u").alias("x"), F.lit(1).alias("up")).union(e.select(F.col("v").alias("x"), F.lit(0).alias("up")))
        ends = ends.groupBy("x").agg(F.sum("up").alias("ups"), F.min("up").alias("least"))
        if not ends.agg(F.max((F.col("ups") > F.col("least")).cast("int"))).first()[0]:
            break
    else:
        raise RuntimeError(f"components did not settle within {rounds} rounds")
    tops = e.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(tops)
