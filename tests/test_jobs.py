"""Ingest and repair jobs: one registry row per job, whatever is run again."""

import json
import os

import pytest
from pyspark.sql import functions as F

from tuneframe import jobs
from tuneframe.operators import repair as R
from tuneframe.sources import readers as S


def write(path, lines):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write("\n".join(lines) + "\n")
    return path


def chat(*turns):
    return json.dumps({"messages": [{"role": r, "content": c} for r, c in turns]})


ROWS = [
    chat(("user", "hi"), ("assistant", "hello")),
    chat(("user", "hi"), ("assistant", " hello ")),
    chat(("assistant", "lost"), ("user", "a"), ("user", "b"), ("assistant", "c")),
    chat(("user", "unanswered")),
    chat(("user", "x\x07"), ("assistant", "�")),
    "not json",
    '{"messages": 7}',
]


def test_ingest_registers_once(spark, tmp_dir):
    path = write(f"{tmp_dir}/in/chat.jsonl", ROWS)
    for _ in range(2):
        row = jobs.ingest(spark, path, f"{tmp_dir}/data", f"{tmp_dir}/reg", "job-1", "chat").collect()
    assert len(row) == 1 and S.read_registry(spark, f"{tmp_dir}/reg").count() == 1
    r = row[0]
    assert (r.name, r.format, r.row_count, r.repaired_from) == ("chat", "chatml", 6, None)
    # Five records vote, one has a number for its list.
    assert r.confidence == round(5 / 6, 4)
    stats, report = json.loads(r.stats_json), json.loads(r.report_json)
    assert stats["num_examples"] == 6 and stats["duplicate_examples"] == 1
    counts = {c["category"]: c["count"] for c in report["categories"]}
    assert counts == {"missing_fields": 0, "invalid_conversation": 1, "duplicate_samples": 1, "role_mismatch": 1, "empty_responses": 1,
                      "broken_utf8": 1, "unsupported_tokens": 1}
    assert report["num_examples_checked"] == 6 and report["issues_found"] == 6
    assert next(c["sample_indices"] for c in report["categories"] if c["category"] == "duplicate_samples") == "1"
    assert spark.read.parquet(r.path).count() == 6


def test_ingest_without_records_registers_nothing(spark, tmp_dir):
    path = write(f"{tmp_dir}/in/empty.jsonl", ["", "nope"])
    with pytest.raises(ValueError, match="no records"):
        jobs.ingest(spark, path, f"{tmp_dir}/data", f"{tmp_dir}/reg", "job-1", "empty")
    assert not os.path.exists(f"{tmp_dir}/reg")
    with pytest.raises(ValueError, match="Supported"):
        jobs.ingest(spark, f"{tmp_dir}/x.xml", f"{tmp_dir}/data", f"{tmp_dir}/reg", "job-1", "x")


def test_repair_job_writes_describes_and_registers(spark, tmp_dir):
    path = write(f"{tmp_dir}/in/chat.jsonl", ROWS)
    jobs.ingest(spark, path, f"{tmp_dir}/data", f"{tmp_dir}/reg", "job-1", "chat")
    for _ in range(2):
        got = jobs.repair_dataset(spark, f"{tmp_dir}/reg", "job-1", f"{tmp_dir}/data", "job-2").collect()
    assert len(got) == 1 and S.read_registry(spark, f"{tmp_dir}/reg").count() == 2
    r = got[0]
    assert (r.name, r.format, r.repaired_from, r.row_count) == ("chat (repaired)", "chatml", "job-1", 3)
    summary = json.loads(r.repair_json)
    assert summary["input_count"] == 6 and summary["duplicates_removed"] == 1 and summary["empty_responses_removed"] == 1
    assert summary["roles_fixed"] == summary["merged_turns"] == 1 and summary["output_count"] == 3
    lines = [json.loads(x.value)["messages"] for x in spark.read.text(r.source_path).collect()]
    assert [m[0]["content"] for m in lines] == ["hi", "a\nb", "x\x07"]
    stats = json.loads(r.stats_json)
    assert stats["num_examples"] == 3 and stats["duplicate_examples"] == 0 and stats["empty_count"] == 0


def test_repair_of_nothing(spark, tmp_dir):
    path = write(f"{tmp_dir}/in/chat.jsonl", [chat(("user", "unanswered"))])
    jobs.ingest(spark, path, f"{tmp_dir}/data", f"{tmp_dir}/reg", "job-1", "chat")
    with pytest.raises(ValueError, match="left no examples"):
        jobs.repair_dataset(spark, f"{tmp_dir}/reg", "job-1", f"{tmp_dir}/data", "job-2")
    with pytest.raises(ValueError, match="no dataset"):
        jobs.repair_dataset(spark, f"{tmp_dir}/reg", "job-9", f"{tmp_dir}/data", "job-2")
    assert S.read_registry(spark, f"{tmp_dir}/reg").count() == 1


def test_summary_by_group(spark):
    rows = [(g, i, [("user", "q"), ("assistant", "same")], False) for i, g in enumerate("aabbb")]
    df = spark.createDataFrame(rows, "g string, idx long, messages array<struct<role:string,content:string>>, norm_error boolean")
    got = {r.g: (r.input_count, r.duplicates_removed, r.output_count) for r in R.repair_summary(df, by=["g"]).collect()}
    assert got == {"a": (2, 1, 1), "b": (3, 2, 1)}
    kept = R.repair(df, by=["g"]).orderBy("idx").collect()
    assert [(r.g, r.idx) for r in kept] == [("a", 0), ("b", 2)]
    assert R.repair_summary(df, by=["g"]).filter(F.col("g") == "c").count() == 0
