"""P7 objective routing and M10 duplicate / late events on a stream."""

import json
import os

import pytest

from tuneframe.operators import prepare as PR
from tuneframe.sources.readers import records_from_lines
from tuneframe.streaming import runs as ST


def records(spark, rows):
    return records_from_lines(spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(rows)], "idx long, value string"))


def test_prepare_routes_by_objective(spark):
    chat = records(spark, [{"messages": [{"role": "user", "content": f"q{i}"}, {"role": "assistant", "content": "a"}]} for i in range(30)])
    sft = PR.prepare(chat, "sft", "chatml")
    assert {r.split: r["count"] for r in sft.groupBy("split").count().collect()} == {"train": 28, "eval": 2}
    pref = records(spark, [{"prompt": "p", "chosen": "c", "rejected": "r"}, {"prompt": "p2", "chosen": "c2"}])
    assert PR.prepare(pref, "dpo", "preference").count() == 1
    assert PR.prepare(pref, "kto", "preference").count() == 2
    with pytest.raises(ValueError, match="orpo"):
        PR.prepare(pref, "orpo", "preference")
    with pytest.raises(ValueError, match="nothing to train on"):
        PR.prepare(records(spark, [{"prompt": "only"}]), "dpo", "preference")


def test_stream_drops_redelivered_events_and_keeps_late_ones(spark, tmp_dir):
    src = f"{tmp_dir}/in/run_3"
    os.makedirs(src)
    first = [{"event": "metric", "ts": 1000.0 + i, "step": i, "loss": 1.0} for i in range(5)]
    with open(f"{src}/a.jsonl", "w") as f:
        f.write("\n".join(json.dumps(e) for e in first) + "\n")
    out, ck = f"{tmp_dir}/out", f"{tmp_dir}/ck"

    def run():
        stream = ST.dedupe_late(ST.stream_events(spark, f"{tmp_dir}/in"), "10 minutes")
        ST.start_to_table(stream.drop("event_time"), out, ck).awaitTermination()

    run()
    # second delivery: two re-sent events and one late (older) new event
    again = first[:2] + [{"event": "metric", "ts": 990.0, "step": 99, "loss": 2.0}]
    with open(f"{src}/b.jsonl", "w") as f:
        f.write("\n".join(json.dumps(e) for e in again) + "\n")
    run()
    got = sorted(r.step for r in spark.read.parquet(out).collect())
    assert got == [0, 1, 2, 3, 4, 99]


def test_missing_step_keeps_the_one_before(spark):
    from pyspark.sql import functions as F

    from tuneframe.operators.runs import METRIC_FIELDS, latest_state

    rows = [("r", "metric", 1.0, 5, 0.5, 10), ("r", "metric", 2.0, None, None, None), ("s", "metric", 1.0, None, None, 4)]
    df = spark.createDataFrame(rows, "run_id string, event string, ts double, step long, epoch double, total_steps long")
    for c in METRIC_FIELDS:
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None).cast("double"))
    got = {r.run_id: (r.current_step, r.current_epoch, r.total_steps) for r in latest_state(df).collect()}
    assert got == {"r": (5, 0.5, 10), "s": (0, 0.0, 4)}
