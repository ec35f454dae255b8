"""A dense, file-order record index without a Python RDD.

Rows of one file split sit contiguously in one partition, so
``monotonically_increasing_id`` is consecutive within a split. The parsed
records are written once to the shared checkpoint folder; the index and all
that follows read them there, so the input is scanned and parsed once. One
aggregate gives, per split ``(file, block start)``, its row count and first
id. Offsets come in two levels: a running sum over the splits of each file,
and one over the files (a row per file, like the file listing that Spark
keeps anyway). They are joined back by 96-bit hashes of the file and the
block start: broadcast while they are few, as the records are then indexed
where they lie, each time they are read.
``idx = offset + (id - first id)``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tuneframe.session import materialize

SPLIT = ["_f1", "_f2", "_block"]
#: Splits whose offsets are broadcast, some 50 bytes each; those of more are left to the planner.
BROADCAST_SPLITS = 100_000


def with_index(df: DataFrame, cap: int | None = None) -> DataFrame:
    """Add ``idx`` (0..n-1 in file order) to a frame carrying ``_file``/``_block``.

    The rows of a split must come in their order. ``cap`` keeps the first
    ``cap`` records (off by default: the reference's row cap was a memory
    guard, not semantics).
    """
    keyed = df.withColumn("_f1", F.xxhash64("_file")).withColumn("_f2", F.hash("_file"))
    keyed = keyed.withColumn("_at", F.monotonically_increasing_id())
    keyed = materialize(keyed)
    per = keyed.groupBy(*SPLIT).agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"), F.first("_file").alias("_file"))
    inside = Window.partitionBy("_f1", "_f2").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
    files = per.groupBy("_f1", "_f2").agg(F.sum("_n").alias("_n"), F.first("_file").alias("_file"))
    files = files.select("_f1", "_f2", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_files"))
    splits = per.select(*SPLIT, "_first", F.coalesce(F.sum("_n").over(inside), F.lit(0)).alias("_splits"))
    offsets = splits.join(files, ["_f1", "_f2"]).select(*SPLIT, (F.col("_files") + F.col("_splits") - F.col("_first")).alias("_off"))
    # The planner takes the offsets for as large as the input and would move all records to them.
    offsets = materialize(offsets)
    if offsets.count() <= BROADCAST_SPLITS:
        offsets = F.broadcast(offsets)
    out = keyed.join(offsets, SPLIT).withColumn("idx", (F.col("_off") + F.col("_at")).cast("bigint"))
    if cap is not None:
        out = out.filter(F.col("idx") < int(cap))
    return out.select("idx", *[c for c in df.columns if c not in ("_file", "_block")])
