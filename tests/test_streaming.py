"""Streaming results equal the batch operators on the same event log."""

from pyspark.sql import functions as F

from tests.conftest import SF001
from tuneframe.operators import runs as M
from tuneframe.plans import fixtures as X
from tuneframe.plans import queries as Q


def rows(df, cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_grad_alerts_stream_equals_batch(spark):
    batch = M.grad_alerts(X.run_events(spark, SF001))
    stream = Q.REGISTRY["stream_grad_alerts"](spark, SF001)
    cols = ["run_id", "step", "grad_norm", "alert"]
    assert rows(stream, cols) == rows(batch, cols)


def test_run_state_stream_equals_batch(spark):
    ev = X.run_events(spark, SF001)
    batch = M.latest_state(ev).join(M.run_status(ev), "run_id")
    stream = Q.REGISTRY["stream_run_state"](spark, SF001)
    cols = ["run_id", "current_step", "total_steps", "loss", "progress_pct", "status"]
    assert rows(stream, cols) == rows(batch, cols)


def test_read_run_events_skips_malformed(spark, tmp_dir):
    import os

    os.makedirs(f"{tmp_dir}/run_7")
    with open(f"{tmp_dir}/run_7/events.jsonl", "w") as f:
        f.write('{"event": "started", "ts": 1.0, "run_id": 7}\n\nnot json\n{"event": "metric", "ts": 2.0, "step": 1, "loss": 0.5}\n')
    ev = M.read_run_events(spark, tmp_dir)
    got = sorted((r.run_id, r.event) for r in ev.collect())
    assert got == [(7, "metric"), (7, "started")]
    assert M.dedupe_events(ev.unionByName(ev)).count() == 2
    assert ev.select(F.col("run_id")).distinct().count() == 1


def write_events(path, rows):
    import json
    import os

    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write("".join(json.dumps(r) + "\n" for r in rows))


def test_late_points_are_compared_with_the_point_they_follow(spark, tmp_dir):
    """Two deliveries, the second with points from among the first's; alerts equal the batch's."""
    import random

    from tuneframe.streaming import runs as ST

    rnd = random.Random(8)
    rows = [{"event": "metric", "run_id": k % 3, "ts": 1.7e9 + 40.0 * k, "step": k, "grad_norm": rnd.choice([1e-5, 1.0, 4.0, 11.0, 40.0, None])}
            for k in range(400)]
    rnd.shuffle(rows)
    closing = [{"event": "metric", "run_id": 0, "ts": 1.7e9 + 1e7, "step": 10_000, "grad_norm": 1.0}]
    src, out, ck = f"{tmp_dir}/in", f"{tmp_dir}/out", f"{tmp_dir}/ck"
    for n, part in enumerate((rows[:250], rows[250:], closing)):
        write_events(f"{src}/run_x/{n}.jsonl", part)
        ST.start_grad_alerts(ST.stream_events(spark, src), out, ck, "1 day", 3600.0, available_now=True).awaitTermination()
    got = ST.read_grad_alerts(spark, out)
    batch = M.grad_alerts(M.read_run_events(spark, src))
    cols = ["run_id", "step", "grad_norm", "alert"]
    assert rows_of(got, cols) == rows_of(batch, cols) and got.count() > 50


def rows_of(df, cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_late_events_go_to_a_side_output_and_come_back(spark, tmp_dir):
    from tuneframe.streaming import runs as ST

    src, out, ck = f"{tmp_dir}/in", f"{tmp_dir}/out", f"{tmp_dir}/ck"

    def e(ts, step, event="metric"):
        return {"event": event, "run_id": 1, "ts": ts, "step": step}

    day = 86_400.0
    batches = [[e(10 * day, 1), e(10 * day, 1), e(10 * day + 60, 2)], [e(10 * day, 1), e(10 * day + 50, 3), e(8.8 * day, 4), e(8.8 * day, 4)],
               [e(8.8 * day, 4), e(12 * day, 5), e(10 * day + 60, 2)], [e(10 * day + 60, 2), e(11.5 * day, 6)]]
    for n, part in enumerate(batches):
        write_events(f"{src}/run_1/{n}.jsonl", part)
        ST.start_event_log(ST.stream_events(spark, src), out, ck, "24 hours", available_now=True).awaitTermination()
    log = ST.read_event_log(spark, out)
    assert sorted(r.step for r in log.filter("NOT late").collect()) == [1, 2, 3, 5, 6]
    # Late events may repeat each other, or a punctual one, until they are merged.
    assert sorted(r.step for r in log.filter("late").collect()) == [2, 4, 4]
    merged = ST.merge_late(log)
    assert rows_of(merged, ["step", "late"]) == [(1, False), (2, False), (3, False), (4, True), (5, False), (6, False)]
    assert rows_of(merged, ["run_id", "event", "step", "ts"]) == rows_of(M.dedupe_events(M.read_run_events(spark, src)), ["run_id", "event", "step", "ts"])


def event_table(spark, tmp_dir, rows):
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_dir}/tables/events.parquet")
    return f"{tmp_dir}/tables"


def test_a_delivery_makes_no_file_per_run(spark, tmp_dir, monkeypatch):
    """300 runs: the log's files are as many as the tasks that write them, and no event is lost."""
    import datetime
    import glob

    from tuneframe import session

    monkeypatch.setattr(session, "scratch_path", lambda spark, name: f"{tmp_dir}/{name}")
    at = datetime.datetime(2024, 1, 10)
    rows = [(i, at + datetime.timedelta(minutes=11 * i), i % 300 if i % 97 else None, ("click", "view", "purchase", "click")[i // 300], float(i % 90), '{"k": 7}')
            for i in range(1200)]
    sf = event_table(spark, tmp_dir, rows)
    cols = ["run_id", "current_step", "total_steps", "loss", "progress_pct", "status"]
    ev = X.run_events(spark, sf)
    named = F.coalesce("run_id", F.lit(-1)).alias("run_id")
    state = Q.REGISTRY["stream_run_state"](spark, sf).select(named, *cols[1:])
    batch = M.latest_state(ev).alias("a").join(M.run_status(ev).alias("b"), F.col("a.run_id").eqNullSafe(F.col("b.run_id"))).drop(F.col("b.run_id"))
    assert rows_of(state.na.fill(-1.0, ["loss"]), cols) == rows_of(batch.select(named, *cols[1:]).na.fill(-1.0, ["loss"]), cols)
    assert len(glob.glob(f"{tmp_dir}/events/**/*.json", recursive=True)) <= 2 * 8


def test_point_stream_runs_no_python_and_takes_what_an_open_bucket_still_gets(spark, tmp_dir):
    """A point behind the watermark counts as long as its bucket is open; points lie in state without a Python worker per run."""
    from tuneframe.streaming import runs as ST

    def e(ts, step, g):
        return {"event": "metric", "run_id": 4, "ts": 1.7e9 + ts, "step": step, "grad_norm": g}

    src, out, ck = f"{tmp_dir}/in", f"{tmp_dir}/out", f"{tmp_dir}/ck"
    parts = [[e(100.0, 1, 1.0), e(400.0, 3, 20.0)], [e(200.0, 2, 30.0)], [e(1e6, 9, 1.0)]]
    assert 1.7e9 // 3600 == (1.7e9 + 400) // 3600
    for n, part in enumerate(parts):
        write_events(f"{src}/{n}.jsonl", part)
        q = ST.start_grad_alerts(ST.stream_events(spark, src), out, ck, "10 seconds", 3600.0, available_now=True)
        q.awaitTermination()
        assert "TransformWithState" not in q._jsq.explainInternal(False)
    assert rows_of(ST.read_grad_alerts(spark, out), ["step", "alert"]) == [(2, "explosion")]
