"""Session configuration and shared storage locations."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

# Runtime SQL settings every operator relies on. They are set on the session
# the caller hands us; nothing here creates or stops a session.
RUNTIME_CONF = {
    # Records are dynamic JSON: a duplicated key keeps its last value.
    "spark.sql.variant.allowDuplicateKeys": "true",
    # Casts and divisions are written for ANSI rules.
    "spark.sql.ansi.enabled": "true",
    # Event times are epoch seconds; render and bucket them in UTC.
    "spark.sql.session.timeZone": "UTC",
    # Runtime re-planning: coalesce small shuffles, split skewed join sides.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Generated methods above 8 KB of bytecode are not JIT-compiled by the
    # JVM; fall back to per-expression code instead of running them interpreted.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # Whole texts go to Python workers 4 MB at a time, not ten thousand rows at a time.
    "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20),
}


def configure(spark: SparkSession) -> SparkSession:
    for key, value in RUNTIME_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def builder(master: str = "local[8]", shuffle_partitions: int = 8):
    """A builder for tests and the bench; clusters bring their own session."""
    b = (
        SparkSession.builder.master(master)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in RUNTIME_CONF.items():
        b = b.config(key, value)
    return b


def parallelism(spark: SparkSession) -> int:
    """Cluster parallelism (falls back to the shuffle partition setting)."""
    try:
        return int(spark.sparkContext.defaultParallelism)
    except Exception:  # noqa: BLE001 - sessions without a SparkContext
        return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names for checkpoints.

    Read from the running context or ``spark.checkpoint.dir``; where neither
    is set, a folder under the shared warehouse.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - the server side owns the checkpoint folder
        return spark.conf.get("spark.checkpoint.dir", "")
    path = sc.getCheckpointDir()
    if not path:
        path = spark.conf.get("spark.checkpoint.dir", None)
        if not path:
            # Shared like the warehouse; a folder of one machine would be lost to the others.
            path = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
        sc.setCheckpointDir(path)
        path = sc.getCheckpointDir() or path
    return path


# Whether a query's shuffle files go when it ends, instead of when the driver happens to collect its garbage.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df, free_shuffles: bool = False):
    """Checkpoint ``df`` eagerly into the shared checkpoint folder (lineage cut).

    With ``free_shuffles`` what this run shuffled is deleted at its end.
    """
    spark = df.sparkSession
    checkpoint_dir(spark)
    if not free_shuffles:
        return df.checkpoint(eager=True)
    before = spark.conf.get(FREE_SHUFFLES, None)
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        # The setting holds for frames made under it.
        return df.select("*").checkpoint(eager=True)
    finally:
        if before is None:
            spark.conf.unset(FREE_SHUFFLES)
        else:
            spark.conf.set(FREE_SHUFFLES, before)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint location for written tables."""
    base = checkpoint_dir(spark).rstrip("/")
    return f"{base}/tuneframe/{name}-{uuid.uuid4().hex[:12]}"
