"""Ingest and repair as jobs: files in, a written dataset and one registry row out.

Each job writes its data once and collects its counters while it writes
(``DataFrame.observe``); profile and report are read off the written rows.
Data lies in a folder named after the job, the registry row is written last,
so a job that is run again, or was lost half way, replaces what it left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tuneframe.operators import detect as D
from tuneframe.operators import normalize as N
from tuneframe.operators import profile as P
from tuneframe.operators import repair as R
from tuneframe.operators import validate as V
from tuneframe.operators.langid import LanguageModel
from tuneframe.session import materialize
from tuneframe.sources.readers import read_dataset, read_registry, register_dataset

ROW_FLAGS = [c for c in V.CATEGORIES if c != "duplicate_samples"]


def _write_rows(rows: DataFrame, path: str) -> dict:
    """Write rows with their V1-V6 flags; the counters are collected on the way."""
    seen = Observation()
    counted = rows.observe(seen, F.count(F.lit(1)).alias("rows"), *[F.count_if(c).alias(c) for c in ROW_FLAGS])
    counted.write.mode("overwrite").parquet(path)
    return seen.get


def _as_json(row: DataFrame) -> str | None:
    got = row.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("j")).first()
    return got["j"] if got else None


def _describe(rows: DataFrame, languages: LanguageModel | None) -> tuple[str, str]:
    """T10 and V8 of the written rows, as JSON."""
    stats = _as_json(P.profile(rows.select("idx", "messages", "norm_error"), languages=languages))
    flags = V.mark_duplicates(rows.select("idx", *ROW_FLAGS, "content_hash"))
    report = V.validation_report(flags)
    line = F.struct("category_order", "category", "count", "sample_indices")
    whole = report.agg(F.max("num_examples_checked").alias("num_examples_checked"), F.max("issues_found").alias("issues_found"),
                       F.transform(F.array_sort(F.collect_list(line)), lambda x: x.dropFields("category_order")).alias("categories"))
    return stats, _as_json(whole)


def _entry(spark: SparkSession, **fields) -> DataFrame:
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in fields.items()])


def ingest(
    spark: SparkSession,
    path: str,
    data_dir: str,
    registry: str,
    job_id: str,
    name: str,
    fmt: str | None = None,
    languages: LanguageModel | None = None,
) -> DataFrame:
    """S6 -> F2 -> N8 -> V9 -> S8 -> T10, V8 -> S10: returns the registry row.

    ``fmt`` overrides the file suffix. The input is scanned once; a file
    without records raises and registers nothing.
    """
    records = read_dataset(spark, path, fmt)
    found = D.detect_format(records)
    detected = found.first()
    messages = N.to_messages(D.attach_format(records, found))
    rows = V.flag_rows(messages).select("idx", "messages", "norm_error", *ROW_FLAGS, "content_hash")
    target = f"{data_dir.rstrip('/')}/job_id={job_id}"
    counted = _write_rows(rows, target)
    if not counted["rows"]:
        raise ValueError("dataset has no records")
    stats, report = _describe(spark.read.parquet(target), languages)
    register_dataset(registry, job_id, _entry(
        spark, name=name, source_path=path, path=target, format=detected["format"], confidence=detected["confidence"],
        row_count=counted["rows"], stats_json=stats, report_json=report, repair_json=None, repaired_from=None))
    return read_registry(spark, registry).filter(F.col("job_id") == job_id)


def repair_dataset(
    spark: SparkSession,
    registry: str,
    source_job: str,
    data_dir: str,
    job_id: str,
    opts: R.RepairOptions = R.RepairOptions(),
    languages: LanguageModel | None = None,
) -> DataFrame:
    """Repair a registered dataset, write it as JSONL, describe and register the result.

    The chain runs once: its per-record stages are kept in the checkpoint
    folder, and rows and summary are read off them. Chunks are numbered in
    the order of their records, or of the shuffle where one is asked for.
    Nothing left to keep raises and registers nothing.
    """
    source = read_registry(spark, registry).filter(F.col("job_id") == source_job).first()
    if source is None:
        raise ValueError(f"no dataset is registered for job {source_job}")
    stages = materialize(R.repair_stages(spark.read.parquet(source["path"]), opts))
    summary = _as_json(R.summary_of(stages, opts))
    kept = R.repaired(stages, opts)
    if not opts.shuffle:
        kept = kept.orderBy("idx", "chunk")
    lines = f"{data_dir.rstrip('/')}/job_id={job_id}/jsonl"
    seen = Observation()
    kept.select(F.to_json(F.struct("messages")).alias("value")).observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").text(lines)
    if not seen.get["rows"]:
        raise ValueError("repair left no examples")
    records = read_dataset(spark, lines, ".jsonl")
    found = D.detect_format(records)
    detected = found.first()
    messages = N.to_messages(D.attach_format(records, found))
    rows = V.flag_rows(messages).select("idx", "messages", "norm_error", *ROW_FLAGS, "content_hash")
    target = f"{data_dir.rstrip('/')}/job_id={job_id}/rows"
    counted = _write_rows(rows, target)
    stats, report = _describe(spark.read.parquet(target), languages)
    register_dataset(registry, job_id, _entry(
        spark, name=f"{source['name']} (repaired)", source_path=lines, path=target, format=detected["format"],
        confidence=detected["confidence"], row_count=counted["rows"], stats_json=stats, report_json=report,
        repair_json=summary, repaired_from=source_job))
    return read_registry(spark, registry).filter(F.col("job_id") == job_id)
