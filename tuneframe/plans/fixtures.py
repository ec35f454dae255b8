"""Inputs derived from the given tables by deterministic DataFrame code.

The given conversations are clean, so defects are injected by rules keyed on
``conv_id`` over the *whole* table (nothing is sampled away). Every derived
input grows with the tables it comes from.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tuneframe.session import configure

# Deals every scanned table to so many partitions, where a session sets it: a
# file of one row group is one task otherwise. Unset, scans stay as planned.
SCAN_PARTITIONS = "spark.tuneframe.scanPartitions"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    configure(spark)
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    n = spark.conf.get(SCAN_PARTITIONS, None)
    return df.repartition(int(n)) if n else df


def dirty_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations with equal adjacent roles, blank answers, control
    characters, replacement characters, lost first turns and exact copies."""
    c = table(spark, sf_dir, "conversations")
    cid, turn, role, text = F.col("conv_id"), F.col("turn"), F.col("role"), F.col("text")
    dirty = c.filter(~((cid % 10 == 0) & (turn == 0))).select(
        cid,
        turn,
        F.when((cid % 13 == 3) & (turn == 1), F.lit("user")).otherwise(role).alias("role"),
        F.when((cid % 11 == 2) & (role == "assistant"), F.lit("  "))
        .when(cid % 17 == 4, F.concat(text, F.lit("\x07")))
        .when(cid % 19 == 5, F.concat(text, F.lit("�")))
        .otherwise(text)
        .alias("text"),
    )
    copies = c.filter(cid % 7 == 1).select((cid + 1000000).alias("conv_id"), turn, role, text)
    return dirty.unionByName(copies)


def documents_as_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as a raw-text dataset: one ``{"text": ...}`` record per doc."""
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").alias("idx"),
        F.to_json(F.struct("text")).alias("raw"),
        F.expr("to_variant_object(named_struct('text', text))").alias("v"),
        F.lit("raw_text").alias("fmt"),
    )


# ------------------------------------------------------------ format fixtures

# Dataset code used to interleave the formats into one mixed file.
FORMAT_CODES = {
    "sharegpt": 0,
    "chatml": 1,
    "alpaca": 2,
    "llama": 3,
    "preference": 4,
    "raw_text": 5,
    "unknown": 6,
}


def _folded(spark, sf_dir):
    from tuneframe.operators.normalize import fold_turns

    return fold_turns(table(spark, sf_dir, "conversations"))


def preference_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in one pair: an even id is chosen over the odd id after it."""
    d = table(spark, sf_dir, "documents").select(F.expr("doc_id div 2").alias("_k"), "doc_id", "text", "lang")
    even = d.filter(F.col("doc_id") % 2 == 0).alias("e")
    odd = d.filter(F.col("doc_id") % 2 == 1).alias("o")
    return even.join(odd, F.col("e._k") == F.col("o._k"), "full_outer").select(
        (F.coalesce("e._k", "o._k") * 2).alias("idx"),
        F.concat(F.lit("Write a text in "), F.coalesce("e.lang", "o.lang"), F.lit(".")).alias("prompt"),
        F.coalesce("e.text", F.lit("")).alias("chosen"),
        F.coalesce("o.text", F.lit("")).alias("rejected"),
    )


def format_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(dataset, idx, value)``: one JSON line per record for every format."""
    m = _folded(spark, sf_dir)
    sharegpt = m.select(
        F.lit("sharegpt").alias("dataset"),
        "idx",
        F.expr(
            "to_json(named_struct('conversations', transform(messages, x -> named_struct("
            "'from', CASE x.role WHEN 'user' THEN 'human' WHEN 'assistant' THEN 'gpt' ELSE x.role END, "
            "'value', x.content))))"
        ).alias("value"),
    )
    chatml = m.select(F.lit("chatml").alias("dataset"), "idx", F.to_json(F.struct("messages")).alias("value"))
    # One record per user turn; a turn's place in its conversation stays below a million.
    asked = m.select(
        "idx",
        F.expr(
            "inline(transform(filter(sequence(0, size(messages) - 1), i -> messages[i].role = 'user'), i -> named_struct("
            "'place', i, 'instruction', messages[i].content, "
            "'output', CASE WHEN get(messages, i + 1).role = 'assistant' THEN get(messages, i + 1).content ELSE '' END)))"
        ),
    )
    alpaca = asked.select(
        F.lit("alpaca").alias("dataset"),
        (F.col("idx") * 1000000 + F.col("place")).alias("idx"),
        F.expr(
            "to_json(named_struct('instruction', instruction, "
            "'input', CASE WHEN idx % 3 = 0 THEN concat('Context ', idx) END, 'output', output))"
        ).alias("value"),
    )
    pair = (
        "transform(filter(sequence(1, size(messages)), i -> messages[i - 1].role = 'user'), i -> concat("
        "'[INST] ', CASE WHEN i > 1 AND messages[i - 2].role = 'system' "
        "THEN concat('<<SYS>>', messages[i - 2].content, '<</SYS>> ') ELSE '' END, "
        "messages[i - 1].content, ' [/INST] ', "
        "CASE WHEN i < size(messages) AND messages[i].role = 'assistant' THEN messages[i].content ELSE '' END))"
    )
    llama = m.select(
        F.lit("llama").alias("dataset"),
        "idx",
        F.to_json(F.struct(F.expr(f"array_join({pair}, ' ')").alias("text"))).alias("value"),
    )
    prefs = preference_pairs(spark, sf_dir).select(
        F.lit("preference").alias("dataset"),
        "idx",
        F.to_json(F.struct("prompt", "chosen", "rejected")).alias("value"),
    )
    docs = table(spark, sf_dir, "documents")
    raw = docs.select(F.lit("raw_text").alias("dataset"), F.col("doc_id").alias("idx"), F.to_json(F.struct("text")).alias("value"))
    unknown = docs.select(
        F.lit("unknown").alias("dataset"), F.col("doc_id").alias("idx"), F.to_json(F.struct("doc_id", "source")).alias("value")
    )
    parts = [sharegpt, chatml, alpaca, llama, prefs, raw, unknown]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _mixed_idx():
    """A record's place where all formats are interleaved in one dataset (``idx * 8 + format code``)."""
    code = F.element_at(F.create_map(*[x for k, c in FORMAT_CODES.items() for x in (F.lit(k), F.lit(c))]), F.col("dataset"))
    return F.col("idx") * 8 + code


def mixed_lines(lines: DataFrame) -> DataFrame:
    """All formats interleaved in one dataset."""
    return lines.select(F.lit("mixed").alias("dataset"), _mixed_idx().alias("idx"), "value")


def mixed_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parsed records ``(dataset, idx, raw, v)`` of the mixed dataset alone."""
    from tuneframe.sources.readers import records_from_lines

    return records_from_lines(mixed_lines(format_lines(spark, sf_dir)))


def format_records(spark: SparkSession, sf_dir: str, with_mixed: bool = True) -> DataFrame:
    """Parsed records ``(dataset, idx, raw, v)`` for every format, plus
    ``mixed``: all of them interleaved. Each line is derived and parsed once,
    and its record comes out in both datasets."""
    from tuneframe.sources.readers import records_from_lines

    recs = records_from_lines(format_lines(spark, sf_dir))
    if not with_mixed:
        return recs
    own, mixed = F.struct("dataset", "idx"), F.struct(F.lit("mixed").alias("dataset"), _mixed_idx().alias("idx"))
    return recs.select(F.inline(F.array(own, mixed)), "raw", "v")


# ------------------------------------------------------------ run event logs

# How event types of ``events`` stand in for run events.
RUN_EVENT_KIND = {
    "click": "metric",
    "view": "checkpoint",
    "error": "error",
    "signup": "stage",
    "purchase": "done",
}


def run_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D9 run events derived from ``events`` (run = user, step = event id)."""
    e = table(spark, sf_dir, "events")
    kind = F.element_at(F.create_map(*[x for k, v in RUN_EVENT_KIND.items() for x in (F.lit(k), F.lit(v))]), F.col("event_type"))
    k = F.get_json_object("props", "$.k").cast("int")
    step = F.col("event_id")
    metric = kind == "metric"
    v = F.col("value")
    from tuneframe.operators.runs import conform_events

    return conform_events(e.select(
        F.col("user_id").alias("run_id"),
        kind.alias("event"),
        (F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)).alias("ts"),
        step.alias("step"),
        (step / F.lit(1000.0)).alias("epoch"),
        F.when(metric, v).alias("loss"),
        F.when(metric & (step % 5 == 0), v).alias("eval_loss"),
        F.when(metric, F.lit(0.0002) * k / F.lit(100.0)).alias("learning_rate"),
        F.when(metric, F.when(step % 7 == 0, F.lit(None)).when(step % 11 == 0, F.lit(1e-5)).otherwise(v / 10.0)).alias(
            "grad_norm"
        ),
        F.when(metric, v / 50.0).alias("gpu_mem_used_gb"),
        F.when(metric, F.when(k > 20, k * 100).otherwise(0)).cast("bigint").alias("total_steps"),
        F.when(kind == "error", F.concat(F.lit("error "), F.col("event_id").cast("string"))).alias("message"),
        F.when(kind == "stage", F.concat(F.lit("stage_"), (k % 4).cast("string"))).alias("stage"),
    ))


def run_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of all statuses: run (user, day of the week) with queued, preparing, cancelled and exit events among the others."""
    ev = run_events(spark, sf_dir)
    n = F.col("step") % 23
    kind = F.when(n == 0, "queued").when(n == 1, "preparing").when(n == 2, "started").when(n == 3, "cancelled")
    kind = kind.when(n.isin(4, 5), "process_exit").when(n == 6, "done").otherwise(F.col("event"))
    lines = F.concat_ws("", F.transform(F.sequence(F.lit(1), F.col("step") % 60), lambda i: F.concat(i.cast("string"), F.lit("\n"))))
    out = ev.withColumn("run_id", F.col("run_id") * 7 + F.col("step") % 7).withColumn("event", kind)
    out = out.withColumn("returncode", F.when(n == 4, (F.col("step") % 2).cast("int")).when((n == 5) & (F.col("step") % 3 > 0), F.lit(0)))
    out = out.withColumn("message", F.when((F.col("event") == "error") & (F.col("step") % 4 > 0), F.concat(F.lit("e"), F.col("step"))))
    out = out.withColumn("message", F.when((F.col("event") == "error") & (F.col("step") % 8 == 0), F.lit("")).otherwise(F.col("message")))
    return out.withColumn("output", F.when((n < 6) & (F.col("step") % 5 > 0) & (F.col("step") % 60 > 0), lines))


# ------------------------------------------------------------ catalog, sizing

BASE_TS = "2024-01-01 00:00:00"


def model_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model catalog derived from ``part`` (repo = name + key)."""
    p = table(spark, sf_dir, "part")
    key = F.col("p_partkey")
    size = F.col("p_size").cast("bigint")
    hidden = (F.lit(512) * (size % 8 + 1)).cast("bigint")
    vocab = F.when(key % 4 == 0, F.lit(None).cast("bigint")).otherwise(F.lit(32000) + (key % 5) * 1000).cast("bigint")
    params = F.when(key % 9 == 0, F.lit(None).cast("bigint")).otherwise(size * 1000000000)
    even = key % 2 == 0
    config = F.when(
        even,
        F.to_json(
            F.struct(
                F.array(F.lit("LlamaForCausalLM")).alias("architectures"),
                F.lit("llama").alias("model_type"),
                hidden.alias("hidden_size"),
                size.alias("num_hidden_layers"),
                vocab.alias("vocab_size"),
                F.lit(4096).alias("max_position_embeddings"),
                params.alias("num_parameters"),
            )
        ),
    ).otherwise(
        F.to_json(
            F.struct(
                F.array(F.lit("GPT2LMHeadModel")).alias("architectures"),
                F.lit("gpt2").alias("model_type"),
                hidden.alias("n_embd"),
                size.alias("n_layer"),
                F.lit(2048).alias("n_positions"),
                params.alias("num_parameters"),
            )
        )
    )
    tag2 = (
        F.when(F.col("p_type") == "PROMO", "Vision-encoder")
        .when(F.col("p_type") == "LARGE", "image-text-to-text")
        .when(F.col("p_type") == "SMALL", "tiny-VL")
        .when(F.col("p_type") == "MEDIUM", "vision")
        .otherwise("text-generation")
    )
    return p.select(
        F.concat(F.regexp_replace("p_name", " ", "-"), F.lit("-"), key.cast("string")).alias("repo_id"),
        F.initcap("p_name").alias("display_name"),
        F.col("p_brand").alias("family"),
        params.alias("param_count"),
        hidden.alias("hidden_size"),
        size.alias("num_layers"),
        vocab.alias("vocab_size"),
        F.array(F.lower("p_type"), tag2).alias("tags"),
        F.when(key % 4 == 1, "image-text-to-text").otherwise("text-generation").alias("pipeline_tag"),
        ((F.col("p_retailprice") * 100).cast("bigint") + key).alias("downloads"),
        (F.to_timestamp(F.lit(BASE_TS)) + F.make_interval(mins=key.cast("int"))).alias("created_at"),
        F.parse_json(config).alias("config"),
        key.alias("_key"),
    )


def model_library(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Downloaded / bookmarked state for a third of the catalog."""
    m = model_catalog(spark, sf_dir).filter(F.col("_key") % 3 == 0)
    k = F.col("_key")
    return m.select(
        "repo_id",
        (k % 2 == 0).alias("downloaded"),
        (k % 5 == 0).alias("bookmarked"),
        F.when(k % 4 == 0, F.col("created_at") + F.expr("INTERVAL 1 DAY")).alias("last_used_at"),
        F.concat(F.lit("models/"), F.col("repo_id")).alias("local_path"),
        "_key",
    )


def dataset_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One registry row per ``documents`` source, scored in one grouped job."""
    from tuneframe.operators.normalize import to_messages
    from tuneframe.operators.profile import quality_score, record_metrics

    d = table(spark, sf_dir, "documents")
    recs = d.select(
        "source",
        F.col("doc_id").alias("idx"),
        F.to_json(F.struct("text")).alias("raw"),
        F.expr("to_variant_object(named_struct('text', text))").alias("v"),
        F.lit("raw_text").alias("fmt"),
    )
    prof = quality_score(record_metrics(to_messages(recs), ["source"]), by=["source"])
    sid = F.regexp_extract("source", r"(\d+)$", 1).cast("bigint")
    return prof.select(
        sid.alias("dataset_id"),
        F.col("source").alias("name"),
        "num_examples",
        "quality_score",
        (F.to_timestamp(F.lit(BASE_TS)) + F.make_interval(hours=sid.cast("int"))).alias("created_at"),
    )


def runs_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per run: created at its first event, dataset by run id."""
    from tuneframe.operators.runs import run_status

    ev = run_events(spark, sf_dir)
    first = ev.groupBy("run_id").agg(F.min("ts").alias("_t"))
    st = run_status(ev)
    return first.join(st, "run_id").select(
        "run_id",
        (F.col("run_id") % 25).alias("dataset_id"),
        F.timestamp_micros((F.col("_t") * 1e6).cast("bigint")).alias("created_at"),
        "status",
    )


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host snapshots with one or two devices, scaled from ``events``."""
    e = table(spark, sf_dir, "events")
    v = F.col("value")
    eid = F.col("event_id")

    def gpu(i: int):
        return F.struct(
            F.lit(i).alias("index"),
            F.lit(f"GPU-{i}").alias("name"),
            (v / 5.0 + i).alias("utilization_pct"),
            (v * 1e7).cast("bigint").alias("memory_used_bytes"),
            F.lit(8 * 1024**3).cast("bigint").alias("memory_total_bytes"),
            F.when((eid % 3 == 0) & F.lit(i == 1), F.lit(None).cast("double")).otherwise(v * 1000.0).alias("power_mw"),
            (F.lit(30.0) + v / 10.0).alias("temperature_c"),
            F.when(eid % 5 > 0, F.lit(350000)).alias("power_limit_mw"),
            F.when(eid % 7 > 0, (eid % 100).cast("int")).alias("fan_speed_pct"),
        )

    return e.select(
        F.col("ts").cast("timestamp").alias("ts"),
        (F.col("user_id") % 8).alias("host"),
        (v / 5.0).alias("cpu_pct"),
        F.lit(64 * 1024**3).cast("bigint").alias("ram_total"),
        (F.lit(64 * 1024**3) - (v * 1e8).cast("bigint")).cast("bigint").alias("ram_available"),
        (eid * 1000000).alias("disk_used"),
        F.lit(2 * 1024**4).cast("bigint").alias("disk_total"),
        F.when(eid % 2 == 0, F.array(gpu(0))).otherwise(F.array(gpu(0), gpu(1))).alias("gpus"),
    )
