"""M1, M3, M4, M6, M10 as Structured Streaming queries over run event logs.

* run state (M3 + M4): one streaming aggregate keyed by ``run_id`` in update
  mode; the same folds as the batch operators, so the state store holds one
  row per run. Each micro-batch's changed runs are appended under
  ``batch_id=<n>/`` (overwritten on replay, so the sink is idempotent);
  readers take the newest update per run.
* gradient alerts (M6): a windowed aggregate holds the points of a run's
  hour until the watermark has passed it; then they are compared in time
  order and the hour's edges handed on. So a point that arrives late, but
  before its hour is closed, is compared with the point it follows, and a
  run's state is spread over its hours.
* late and repeated events (M10): each micro-batch is split at the watermark
  of the batches before; what is older goes to a side output, which a reader
  merges later. Nothing is lost.
* routing (M1): ``foreachBatch`` writes each event kind to its own folder.
* telemetry (G2, G3): the same update sink for the latest reading per device;
  watermark + tumbling windows in append mode for rollups.

The file source reads each file once: writers must rotate files (a file
appended to after it was read is not re-read); append-only logs are read by
the batch path instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tuneframe.operators.runs import (
    POINT_SECONDS,
    alert_of,
    dedupe_events,
    event_order,
    newest_metric,
    read_run_events,
    state_columns,
    status_columns,
    status_folds,
    with_event_time,
)

EVENT_KEY = ["run_id", "event", "step", "ts"]
STATE_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
# Points that wait for the watermark lie on disk, not in the executors' heap.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

def stream_events(spark: SparkSession, path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """S11 streaming: event files under ``run_<id>/`` folders."""
    opts = {}
    if max_files_per_trigger:
        opts["maxFilesPerTrigger"] = str(int(max_files_per_trigger))
    return with_event_time(read_run_events(spark, path, streaming=True, **opts))


def dedupe_late(events: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """M10 inside a query: drop re-delivered events.

    An event is known for ``delay`` after it; one that arrives later than
    that behind the newest event is dropped. :func:`start_event_log` keeps
    those too.
    """
    return events.withWatermark("event_time", delay).dropDuplicatesWithinWatermark(EVENT_KEY)


def _same_event(a: str, b: str):
    cond = F.lit(True)
    for c in EVENT_KEY:
        cond = cond & F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}"))
    return cond


def start_event_log(events: DataFrame, sink: str, checkpoint: str, delay: str = "10 minutes", available_now: bool = False) -> StreamingQuery:
    """Every event once to ``<sink>/events``, split into punctual (``late=false``) and late ones.

    An event is late when it is older than the newest event of the batches
    before by more than ``delay``. Punctual events are checked against what
    was written within the delay; late ones can repeat anything and are
    checked when :func:`merge_late` reads them. A batch writes its own
    folders, so a replay overwrites them: the events first, then the mark
    that later batches read.
    """

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = batch.dropDuplicates(EVENT_KEY)
        newest = None
        if batch_id > 0:
            newest = spark.read.parquet(f"{sink}/marks/batch_id={batch_id - 1}").first()["newest"]
        if newest is not None:
            mark = F.lit(newest) - F.expr(f"INTERVAL {delay}")
            rows = rows.withColumn("late", F.coalesce(F.col("event_time") < mark, F.lit(False)))
            known = read_event_log(spark, sink).filter(~F.col("late") & (F.col("batch_id") < batch_id))
            known = known.filter(F.col("event_time").isNull() | (F.col("event_time") >= mark)).select(*EVENT_KEY)
            punctual = rows.filter(~F.col("late")).alias("a").join(known.alias("b"), _same_event("a", "b"), "left_anti")
            rows = punctual.unionByName(rows.filter("late"))
        else:
            rows = rows.withColumn("late", F.lit(False))
        path = f"{sink}/events/batch_id={batch_id}"
        rows.write.mode("overwrite").partitionBy("late").parquet(path)
        written = spark.read.schema(batch.schema).parquet(path).agg(F.greatest(F.max("event_time"), F.lit(newest)).alias("newest"))
        written.write.mode("overwrite").parquet(f"{sink}/marks/batch_id={batch_id}")

    w = events.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="5 seconds")
    return w.start()


def read_event_log(spark: SparkSession, sink: str) -> DataFrame:
    """What :func:`start_event_log` wrote, with ``late`` and ``batch_id``."""
    # Folder names are texts or numbers for the reader.
    return spark.read.parquet(f"{sink}/events").withColumn("late", F.col("late").cast("boolean"))


def merge_late(log: DataFrame) -> DataFrame:
    """The whole event log once: punctual events, and those late ones that no other event equals."""
    late = dedupe_events(log.filter("late"))
    new = late.alias("a").join(log.filter("NOT late").select(*EVENT_KEY).alias("b"), _same_event("a", "b"), "left_anti")
    return log.filter("NOT late").unionByName(new)


def run_state_aggregate(events: DataFrame) -> DataFrame:
    """M3 + M4 as one aggregate (valid on batch and streaming frames)."""
    at = event_order()
    agg = events.withColumn("_at", at).withColumn("_metric_at", F.when(F.col("event") == "metric", at)).groupBy("run_id").agg(
        *newest_metric(F.col("_metric_at")), *status_folds(F.col("_at")), F.max("ts").alias("last_ts")
    )
    return agg.select("run_id", *state_columns(), *status_columns(), "last_ts")


def start_run_state(events: DataFrame, sink: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Run the state aggregate; append changed runs per micro-batch."""
    return start_update_sink(run_state_aggregate(events), sink, checkpoint, available_now)


def read_run_state(spark: SparkSession, sink: str) -> DataFrame:
    """Newest update per run from the append-only state sink."""
    return read_latest_updates(spark, sink, ["run_id"])


def point_stream(events: DataFrame, delay: str = "10 minutes", width: float = POINT_SECONDS) -> DataFrame:
    """M6 streaming: every point with the one before it in its bucket of time, and the buckets' edges.

    Points are given out when the watermark passes the end of their bucket;
    those whose bucket is closed when they come are left to the late side of
    :func:`start_event_log`. A point that no one follows and that can't alert
    inside its bucket stays behind.
    """
    span = F.window("event_time", f"{round(width * 1e6)} microseconds")
    point = F.struct("ts", F.coalesce(F.col("step"), F.lit(0)).cast("bigint").alias("step"), "grad_norm")
    held = events.withWatermark("event_time", delay).filter(F.col("event") == "metric").groupBy("run_id", span.alias("_w")).agg(
        F.array_sort(F.collect_list(point)).alias("_p")
    )
    # A bucket's points in time order, each with the one before.
    ordered = F.transform("_p", lambda x, i: F.struct(
        x["step"].alias("step"), x["ts"].alias("ts"), x["grad_norm"].alias("grad_norm"), F.get("_p", i - 1)["grad_norm"].alias("grad_norm_prev"),
        (i == 0).alias("first"), (i == F.size("_p") - 1).alias("last")))
    bucket = F.floor(F.unix_micros("_w.start") / F.lit(width * 1e6)).cast("bigint").alias("bucket")
    out = held.select("run_id", bucket, F.inline(ordered))
    alert = alert_of(F.col("grad_norm"), F.col("grad_norm_prev"))
    return out.filter(F.col("first") | F.col("last") | alert.isNotNull())


def start_grad_alerts(
    events: DataFrame, sink: str, checkpoint: str, delay: str = "10 minutes", width: float = POINT_SECONDS, available_now: bool = False
) -> StreamingQuery:
    """M6: run :func:`point_stream` into a Parquet folder; :func:`read_grad_alerts` reads the alerts."""
    conf = events.sparkSession.conf
    before = conf.get(STATE_PROVIDER)
    conf.set(STATE_PROVIDER, ROCKSDB)
    try:
        return start_to_table(point_stream(events, delay, width), sink, checkpoint, available_now=available_now)
    finally:
        conf.set(STATE_PROVIDER, before)


def read_grad_alerts(spark: SparkSession, sink: str) -> DataFrame:
    """Alerts of all closed buckets: those inside a bucket as they are, the first
    point of a bucket against the last one of the run's bucket before."""
    got = spark.read.parquet(sink)
    edge = got.filter(F.col("first") | F.col("last"))
    over = Window.partitionBy("run_id").orderBy("bucket", F.col("first").desc())
    first = edge.withColumn("grad_norm_prev", F.lag("grad_norm").over(over)).filter("first")
    rows = got.filter("NOT first").unionByName(first)
    kind = alert_of(F.col("grad_norm"), F.col("grad_norm_prev"))
    return rows.select("run_id", "step", "ts", "grad_norm", kind.alias("alert")).filter(F.col("alert").isNotNull())


def start_router(events: DataFrame, out_dir: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """M1: each event kind to ``<out>/<kind>/batch_id=<n>`` (idempotent per batch)."""

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").partitionBy("event").parquet(f"{out_dir}/batch_id={batch_id}")

    w = events.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="5 seconds")
    return w.start()


def start_to_table(df: DataFrame, path: str, checkpoint: str, mode: str = "append", available_now: bool = True) -> StreamingQuery:
    """Append-mode results to a Parquet folder (exactly-once via the file sink log)."""
    w = df.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="5 seconds")
    return w.start()


def start_update_sink(agg: DataFrame, sink: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Any update-mode aggregate to append-only per-batch folders (idempotent by batch id)."""

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(f"{sink}/batch_id={batch_id}")

    w = agg.writeStream.outputMode("update").foreachBatch(write_batch).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="5 seconds")
    return w.start()


def read_latest_updates(spark: SparkSession, sink: str, keys: list[str]) -> DataFrame:
    """Newest update per key from an append-only update sink."""
    u = spark.read.parquet(sink)
    cols = [c for c in u.columns if c not in (*keys, "batch_id")]
    latest = u.groupBy(*keys).agg(F.max_by(F.struct(*cols), "batch_id").alias("_s"))
    return latest.select(*keys, *[F.col(f"_s.{c}").alias(c) for c in cols])
