"""Registered queries: ``name -> (spark, sf_dir) -> DataFrame``.

Each reads the given tables (or data Spark derives from them) in full and
returns a flat result whose column names match the DuckDB oracle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tuneframe.operators import normalize as N
from tuneframe.operators import profile as P
from tuneframe.operators import repair as R
from tuneframe.operators import detect as D
from tuneframe.operators import prepare as PR
from tuneframe.operators import tokens as K
from tuneframe.operators import runs as M
from tuneframe.operators import catalog as C
from tuneframe.operators import sizing as Z
from tuneframe.operators import telemetry as G
from tuneframe.operators import langid as LI
from tuneframe.streaming import runs as ST
from tuneframe.operators import validate as V
from tuneframe.plans import fixtures as X
from tuneframe.session import materialize

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def register(name: str):
    def deco(fn: Query) -> Query:
        REGISTRY[name] = fn
        return fn

    return deco


# ---------------------------------------------------------------- step 1: N11, V


@register("fold_turns")
def q_fold_turns(spark, sf):
    folded = N.fold_turns(X.table(spark, sf, "conversations"))
    return N.explode_messages(folded).withColumnRenamed("pos", "pos")


def _dirty_flags(spark, sf) -> DataFrame:
    return V.flag_records(N.fold_turns(X.dirty_conversations(spark, sf)))


def _flag_query(col: str) -> Query:
    def q(spark, sf):
        return _dirty_flags(spark, sf).filter(F.col(col)).select("idx")

    return q


for _name, _col in [
    ("flag_role_mismatch", "role_mismatch"),
    ("flag_empty", "empty_responses"),
    ("flag_control", "unsupported_tokens"),
    ("flag_utf8", "broken_utf8"),
    ("duplicates", "duplicate_samples"),
]:
    register(_name)(_flag_query(_col))


@register("validation_report")
def q_validation_report(spark, sf):
    return V.validation_report(_dirty_flags(spark, sf))


# ---------------------------------------------------------------- step 2: T


def _dirty_metrics(spark, sf):
    return P.record_metrics(N.fold_turns(X.dirty_conversations(spark, sf)))


def _doc_metrics(spark, sf):
    return P.record_metrics(N.to_messages(X.documents_as_records(spark, sf)))


@register("turn_stats")
def q_turn_stats(spark, sf):
    return P.turn_stats(_dirty_metrics(spark, sf))


@register("role_counts")
def q_role_counts(spark, sf):
    return P.role_counts(_dirty_metrics(spark, sf))


@register("assistant_user_ratio")
def q_ratio(spark, sf):
    return P.assistant_user_ratio(_dirty_metrics(spark, sf))


@register("dup_ratio")
def q_dup_ratio(spark, sf):
    return P.duplicate_stats(_dirty_metrics(spark, sf))


@register("doc_dup_ratio")
def q_doc_dup_ratio(spark, sf):
    return P.duplicate_stats(_doc_metrics(spark, sf))


@register("token_stats")
def q_token_stats(spark, sf):
    return P.token_stats(_doc_metrics(spark, sf))


@register("token_hist")
def q_token_hist(spark, sf):
    return P.token_histogram(_doc_metrics(spark, sf))


@register("turn_hist")
def q_turn_hist(spark, sf):
    return P.turn_histogram(_dirty_metrics(spark, sf))


@register("entropy")
def q_entropy(spark, sf):
    return P.entropy(_doc_metrics(spark, sf))


@register("entropy_conversations")
def q_entropy_conv(spark, sf):
    return P.entropy(_dirty_metrics(spark, sf))


@register("quality_score")
def q_quality(spark, sf):
    return P.quality_score(_dirty_metrics(spark, sf))


@register("profile")
def q_profile(spark, sf):
    return P.profile(N.fold_turns(X.dirty_conversations(spark, sf))).drop(
        "role_counts", "token_histogram", "turn_histogram"
    )


@register("profile_maps")
def q_profile_maps(spark, sf):
    """T10's maps of T2, T5 and T6 in long form."""
    p = P.profile(N.fold_turns(X.dirty_conversations(spark, sf)))
    maps = ["role_counts", "token_histogram", "turn_histogram"]
    parts = F.array(*[F.struct(F.lit(m).alias("report"), F.col(m).alias("m")) for m in maps])
    long = p.select(F.explode(parts).alias("p")).select("p.report", F.explode("p.m").alias("key", "n"))
    return long.withColumn("n", F.col("n").cast("bigint"))


# ---------------------------------------------------------------- step 3: R

REPAIR_OPTS = R.RepairOptions(max_turn_chars=200, split_oversized=2)


def _dirty_msgs(spark, sf):
    return N.fold_turns(X.dirty_conversations(spark, sf))


@register("fix_roles")
def q_fix_roles(spark, sf):
    s = R.repair_stages(_dirty_msgs(spark, sf), R.RepairOptions(merge_consecutive_same_role=False))
    return s.select("idx", F.size(F.col("chunks")[0]).cast("bigint").alias("n_turns"), "roles_fixed")


@register("merge_turns")
def q_merge_turns(spark, sf):
    s = R.repair_stages(_dirty_msgs(spark, sf), R.RepairOptions(remove_empty_responses=False))
    return N.explode_messages(s.select("idx", F.col("chunks")[0].alias("messages")))


@register("drop_empty")
def q_drop_empty(spark, sf):
    s = R.repair_stages(_dirty_msgs(spark, sf))
    return s.filter(F.col("usable") & ~F.col("empty_removed")).select("idx")


@register("truncate")
def q_truncate(spark, sf):
    opts = R.RepairOptions(max_turn_chars=200, remove_duplicates=False)
    return N.explode_messages(R.repair(_dirty_msgs(spark, sf), opts).select("idx", "messages"))


@register("split")
def q_split(spark, sf):
    opts = R.RepairOptions(split_oversized=2, remove_duplicates=False)
    out = R.repair(_dirty_msgs(spark, sf), opts)
    return out.select("idx", F.col("chunk").cast("bigint").alias("chunk"), F.size("messages").cast("bigint").alias("n_msgs"))


def _repaired_rows(df):
    return df.select(
        "idx",
        F.col("chunk").cast("bigint").alias("chunk"),
        F.size("messages").cast("bigint").alias("n_msgs"),
        F.col("messages")[0]["content"].alias("first_content"),
    )


@register("dedupe")
def q_dedupe(spark, sf):
    return _repaired_rows(R.repair(_dirty_msgs(spark, sf), REPAIR_OPTS))


@register("repair_shuffle")
def q_repair_shuffle(spark, sf):
    opts = R.RepairOptions(max_turn_chars=200, split_oversized=2, shuffle=True)
    return _repaired_rows(R.repair(_dirty_msgs(spark, sf), opts))


@register("repair_summary")
def q_repair_summary(spark, sf):
    return R.repair_summary(_dirty_msgs(spark, sf), REPAIR_OPTS)


# ---------------------------------------------------------------- step 4: S, F, N


def _all_formats(spark, sf):
    """Every fixture dataset parsed once and checkpointed: the union of
    seven derivations would otherwise carry a copy of each downstream
    projection into every branch."""
    return materialize(X.format_records(spark, sf))


@register("detect_format")
def q_detect_format(spark, sf):
    return D.detect_format(_all_formats(spark, sf), by=["dataset"]).drop("scores")


@register("format_scores")
def q_format_scores(spark, sf):
    """votes for every format, the zeros too."""
    d = D.detect_format(_all_formats(spark, sf), by=["dataset"])
    return d.select("dataset", F.explode("scores").alias("format", "votes")).withColumn("votes", F.col("votes").cast("bigint"))


def _normalize_query(dataset: str) -> Query:
    def q(spark, sf):
        if dataset == "mixed":
            recs = materialize(X.mixed_records(spark, sf))
        else:
            recs = X.format_records(spark, sf, with_mixed=False).filter(F.col("dataset") == dataset)
        fmt = None if dataset == "mixed" else dataset
        return N.explode_messages(N.to_messages(recs.drop("dataset"), fmt))

    return q


for _fmt in ["sharegpt", "chatml", "alpaca", "llama", "preference", "raw_text", "unknown", "mixed"]:
    register(f"normalize_{_fmt}")(_normalize_query(_fmt))


@register("jsonl_roundtrip")
def q_jsonl_roundtrip(spark, sf):
    """S9 -> S1 -> S7: write the ShareGPT lines as JSONL, read them back,
    index them in file order and normalise."""
    from tuneframe.session import scratch_path, materialize
    from tuneframe.sources.readers import read_jsonl

    lines = X.format_lines(spark, sf).filter(F.col("dataset") == "sharegpt").orderBy("idx")
    path = scratch_path(spark, "sharegpt-jsonl")
    lines.select("value").write.text(path)
    recs = read_jsonl(spark, path)
    msgs = N.to_messages(recs, "sharegpt").select("idx", "messages")
    return N.explode_messages(msgs).select(F.col("idx").alias("file_idx"), "pos", "role", "content")


# ---------------------------------------------------------------- step 5: P


def _fixture(spark, sf, dataset):
    return X.format_records(spark, sf, with_mixed=False).filter(F.col("dataset") == dataset).drop("dataset")


@register("sft_texts")
def q_sft_texts(spark, sf):
    return PR.sft_texts(_fixture(spark, sf, "chatml"), "chatml")


@register("sft_texts_alpaca")
def q_sft_texts_alpaca(spark, sf):
    return PR.sft_texts(_fixture(spark, sf, "alpaca"), "alpaca")


@register("sft_texts_sharegpt")
def q_sft_texts_sharegpt(spark, sf):
    return PR.sft_texts(_fixture(spark, sf, "sharegpt"), "sharegpt")


@register("train_eval_split")
def q_train_eval_split(spark, sf):
    return PR.train_eval_split(PR.sft_texts(_fixture(spark, sf, "chatml"), "chatml")).select("idx", "rank", "split")


@register("preference_triples")
def q_preference_triples(spark, sf):
    return PR.preference_triples(_fixture(spark, sf, "preference"))


@register("kto_unpivot")
def q_kto(spark, sf):
    return PR.kto_rows(PR.preference_triples(_fixture(spark, sf, "preference")))


@register("pack_examples")
def q_pack(spark, sf):
    texts = PR.sft_texts(_fixture(spark, sf, "chatml"), "chatml")
    sized = texts.withColumn("n_tokens", K.whitespace_token_count(F.col("text")))
    return PR.pack(sized, "n_tokens", 512)


# ---------------------------------------------------------------- step 6: K


def _chatml_tokens(spark, sf):
    return K.token_counts(N.to_messages(_fixture(spark, sf, "chatml"), "chatml"))


@register("token_analysis")
def q_token_analysis(spark, sf):
    return K.token_analysis(_chatml_tokens(spark, sf), max_seq_len=256)


@register("truncation_sampled")
def q_truncation(spark, sf):
    a = K.token_analysis(_chatml_tokens(spark, sf), max_seq_len=256, sample_size=50)
    return a.select(
        "sampled_examples",
        "total_examples",
        "estimated_total_tokens",
        "sampled_examples_over_limit",
        "fraction_over_limit",
        "estimated_total_over_limit",
    )


@register("token_hist_rendered")
def q_token_hist_rendered(spark, sf):
    return K.token_histogram(_chatml_tokens(spark, sf))


@register("runtime_estimate")
def q_runtime(spark, sf):
    a = K.token_analysis(_chatml_tokens(spark, sf), max_seq_len=256)
    return K.runtime_estimate(a, epochs=3.0, target_tokens=1_000_000).select(
        "estimated_total_tokens",
        "total_training_tokens",
        "assumed_tokens_per_sec",
        "estimate_runtime_hours",
        "estimated_epochs_for_target_tokens",
    )


@register("encode_rows")
def q_encode_rows(spark, sf):
    docs = X.table(spark, sf, "documents").select(F.col("doc_id").alias("idx"), "text")
    vocab = K.build_vocabulary(docs)
    return K.encode_rows(docs, vocab)


# ---------------------------------------------------------------- step 7: M


@register("metric_history")
def q_metric_history(spark, sf):
    return M.metric_points(X.run_events(spark, sf)).drop("ts")


@register("latest_state")
def q_latest_state(spark, sf):
    return M.latest_state(X.run_events(spark, sf))


@register("run_status")
def q_run_status(spark, sf):
    return M.run_status(X.run_events(spark, sf))


@register("run_status_lifecycle")
def q_run_status_lifecycle(spark, sf):
    """M4 with queued, preparing, cancelled and exits between the worker's own events."""
    return M.run_status(X.run_lifecycle(spark, sf))


@register("grad_anomaly")
def q_grad_anomaly(spark, sf):
    return M.grad_alerts(X.run_events(spark, sf)).select("run_id", "step", "grad_norm", "alert")


@register("checkpoint_log")
def q_checkpoint_log(spark, sf):
    return M.checkpoint_log(X.run_events(spark, sf))


@register("best_checkpoint")
def q_best_checkpoint(spark, sf):
    return M.best_checkpoint(X.run_events(spark, sf)).select("run_id", "step", "eval_loss", "is_best")


@register("retention")
def q_retention(spark, sf):
    return M.retention(M.checkpoint_log(X.run_events(spark, sf)), 3).select("run_id", "step", "path")


@register("log_tail")
def q_log_tail(spark, sf):
    return M.log_tail(X.run_events(spark, sf)).select("run_id", "ts", "line")


@register("dedupe_events")
def q_dedupe_events(spark, sf):
    ev = X.run_events(spark, sf)
    doubled = ev.unionByName(ev.filter(F.col("event") == "metric"))
    return M.dedupe_events(doubled).groupBy("event").agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- step 8: C, Z, G

TS_FMT = "yyyy-MM-dd HH:mm:ss"


def _ts(c: str):
    return F.date_format(F.col(c), TS_FMT)


def _models(spark, sf):
    return Z.with_param_count(Z.flatten_config(X.model_catalog(spark, sf).drop("hidden_size", "vocab_size", "param_count", "num_layers")))


@register("vision_flag")
def q_vision(spark, sf):
    m = X.model_catalog(spark, sf)
    return m.select("repo_id", C.is_vision(F.col("tags"), F.col("repo_id")).alias("is_vision"))


@register("catalog_left_join")
def q_catalog_left_join(spark, sf):
    j = C.catalog_with_library(X.model_catalog(spark, sf).drop("config"), X.model_library(spark, sf))
    return j.select("repo_id", "downloaded", "bookmarked")


@register("list_models")
def q_list_models(spark, sf):
    j = C.catalog_with_library(X.model_catalog(spark, sf).drop("config"), X.model_library(spark, sf))
    j = j.withColumn("is_vision", C.is_vision(F.col("tags"), F.col("repo_id")))
    return C.list_models(j, bookmarked_only=True, vision=False).select("repo_id", _ts("created_at").alias("created_at"))


@register("recent_models")
def q_recent(spark, sf):
    lib = X.model_library(spark, sf)
    return C.recent_models(lib, 10).select("repo_id", _ts("last_used_at").alias("last_used_at"))


@register("model_search")
def q_search(spark, sf):
    return C.search_models(X.model_catalog(spark, sf), "red", limit=20).select("repo_id", "downloads")


@register("upsert_models")
def q_upsert(spark, sf):
    cat = X.model_catalog(spark, sf)
    current = cat.filter(F.col("_key") % 2 == 0).select(
        "repo_id",
        "display_name",
        F.lit(None).cast("string").alias("architecture"),
        "param_count",
        F.lit(2048).cast("bigint").alias("context_length"),
        F.lit("").alias("license"),
        C.is_vision(F.col("tags"), F.col("repo_id")).alias("is_vision"),
        F.lit(None).cast("string").alias("local_path"),
        F.lit(False).alias("downloaded"),
        (F.col("_key") % 10 == 0).alias("bookmarked"),
    )
    lib = X.model_library(spark, sf).join(cat.select("repo_id", "tags", "family"), "repo_id")
    downloads = lib.select(
        "repo_id",
        F.when(F.col("_key") % 2 == 1, F.concat(F.lit("New "), F.col("repo_id"))).otherwise(F.lit("")).alias("display_name"),
        F.col("family").alias("architecture"),
        F.lit(0).cast("bigint").alias("param_count"),
        F.when(F.col("_key") % 4 == 0, F.lit(4096)).otherwise(F.lit(0)).cast("bigint").alias("context_length"),
        F.lit("apache-2.0").alias("license"),
        "tags",
        "local_path",
    )
    return C.upsert_models(current, downloads)


@register("list_datasets")
def q_list_datasets(spark, sf):
    reg = X.dataset_registry(spark, sf)
    return C.list_datasets(reg).select("dataset_id", "name", "num_examples", "quality_score", "quality_band")


@register("runs_with_dataset")
def q_runs_with_dataset(spark, sf):
    runs = X.runs_table(spark, sf)
    ds = X.dataset_registry(spark, sf).select("dataset_id", "name")
    return C.runs_with_dataset(runs, ds).select("run_id", "dataset_id", "name", "status")


@register("orphan_runs")
def q_orphans(spark, sf):
    runs = X.runs_table(spark, sf)
    ds = X.dataset_registry(spark, sf).select("dataset_id")
    return C.orphan_runs(runs, ds).select("run_id", "dataset_id")


@register("dashboard")
def q_dashboard(spark, sf):
    runs = X.runs_table(spark, sf)
    models = C.catalog_with_library(X.model_catalog(spark, sf).drop("config"), X.model_library(spark, sf))
    return C.dashboard(runs, models)


@register("newest_runs")
def q_newest_runs(spark, sf):
    return C.newest_runs(X.runs_table(spark, sf), 6).select("run_id", _ts("created_at").alias("created_at"), "status")


@register("list_runs")
def q_list_runs(spark, sf):
    return C.list_runs(X.runs_table(spark, sf)).select("run_id", _ts("created_at").alias("created_at"), "status")


@register("param_estimate")
def q_param_estimate(spark, sf):
    return _models(spark, sf).select(
        "repo_id", "architecture", "hidden_size", "num_layers", "context_length", "param_count", "param_count_is_estimate"
    )


@register("vram_matrix")
def q_vram(spark, sf):
    return Z.vram_matrix(_models(spark, sf), Z.method_dtype_grid())


@register("fit_tiers")
def q_fit(spark, sf):
    v = Z.vram_matrix(_models(spark, sf), Z.method_dtype_grid())
    return Z.smallest_fit(v).select("repo_id", "method", "dtype", "total_estimated_gb", "smallest_tier_gb")


def _fleet(spark, sf):
    return G.latest_devices(G.device_rows(X.telemetry(spark, sf)))


@register("fit_hosts")
def q_fit_hosts(spark, sf):
    v = Z.vram_matrix(_models(spark, sf), Z.method_dtype_grid())
    out = Z.fit_devices(v, _fleet(spark, sf)).filter("models_that_fit > 0")
    return out.select("host", "device", "method", "dtype", "models_that_fit", "largest_param_count")


@register("fit_estimates")
def q_fit_estimates(spark, sf):
    """Z4 per estimate: the devices that hold it and the smallest of them."""
    v = Z.vram_matrix(_models(spark, sf), Z.method_dtype_grid())
    out = Z.fit_hosts(v, _fleet(spark, sf))
    return out.select("repo_id", "method", "dtype", "total_estimated_gb", "devices_that_fit", "smallest_free_gb")


@register("hparams_chosen")
def q_hparams_chosen(spark, sf):
    """Z5 with the method given for two models of three."""
    m = _models(spark, sf).filter(F.col("param_count").isNotNull()).select("repo_id", "param_count")
    given = F.when(F.col("param_count") % 3 == 0, "full").when(F.col("param_count") % 3 == 1, "qlora")
    return Z.suggest_hyperparams(m, F.lit(16.0), given).drop("rationale")


@register("hparams")
def q_hparams(spark, sf):
    m = _models(spark, sf).filter(F.col("param_count").isNotNull()).select("repo_id", "param_count")
    out = Z.suggest_hyperparams(m, F.lit(24.0))
    return out.drop("rationale")


@register("telemetry_devices")
def q_telemetry_devices(spark, sf):
    d = G.device_rows(X.telemetry(spark, sf))
    return d.withColumn("ts", _ts("ts"))


@register("latest_devices")
def q_latest_devices(spark, sf):
    d = G.latest_devices(G.device_rows(X.telemetry(spark, sf)))
    return d.select("host", "device", _ts("ts").alias("ts"), "utilization_pct", "power_w", "ram_used_gb")


@register("telemetry_rollup")
def q_rollup(spark, sf):
    r = G.rollup(G.device_rows(X.telemetry(spark, sf)), "1 minute")
    return _rollup_out(r)


def _rollup_out(r):
    avgs = [c for c in r.columns if c.startswith("avg_")]
    for c in avgs:
        r = r.withColumn(c, F.round(c, 6))
    return r.withColumn("window_start", _ts("window_start")).withColumn("window_end", _ts("window_end"))


# ---------------------------------------------------------------- streaming = batch


def _write_event_log(spark, sf, path, before: bool):
    ev = X.run_events(spark, sf)
    cut = F.col("ts") < F.lit(1705276800.0)  # 2024-01-15 00:00:00 UTC: two deliveries
    _deliver(ev.filter(cut if before else ~cut), path)


def _deliver(events, path):
    """One delivery of a log: every line names its run, so there are as many files as tasks and not one per run."""
    events.repartition(F.xxhash64("step", "ts")).write.mode("append").json(path)


def _two_deliveries(spark, sf, run):
    """Deliver the log in two rounds; the same checkpoint carries state across."""
    from tuneframe.session import scratch_path

    src, ck = scratch_path(spark, "events"), scratch_path(spark, "ckpt")
    out = scratch_path(spark, "out")
    for before in (True, False):
        _write_event_log(spark, sf, src, before)
        q = run(ST.stream_events(spark, src), out, ck)
        q.awaitTermination()
    return out


@register("stream_run_state")
def q_stream_run_state(spark, sf):
    out = _two_deliveries(spark, sf, lambda ev, o, ck: ST.start_run_state(ev, o, ck, available_now=True))
    return ST.read_run_state(spark, out).select("run_id", "current_step", "total_steps", "loss", "progress_pct", "status")


@register("stream_grad_alerts")
def q_stream_grad_alerts(spark, sf):
    """M6 on a stream: the log in shuffled files, then one event far ahead that closes all buckets."""
    src, ck, out = _scratch(spark, "events"), _scratch(spark, "ckpt"), _scratch(spark, "out")
    ev = X.run_events(spark, sf)
    closing = ev.filter("event = 'metric'").orderBy(F.col("ts").desc()).limit(1).withColumn("ts", F.col("ts") + 400 * 86400.0)
    for part in (ev, closing):
        _deliver(part, src)
        ST.start_grad_alerts(ST.stream_events(spark, src), out, ck, "365 days", 30 * 86400.0, available_now=True).awaitTermination()
    return ST.read_grad_alerts(spark, out).select("run_id", "step", "grad_norm", "alert")


@register("stream_late_events")
def q_stream_late_events(spark, sf):
    """M10 on a stream: every 50th event comes again or only after the newest one, up to a day and more late."""
    src, ck, out = _scratch(spark, "events"), _scratch(spark, "ckpt"), _scratch(spark, "out")
    ev = X.run_events(spark, sf)
    for part in (ev.filter("step % 50 <> 7"), ev.filter("step % 50 IN (7, 8)")):
        _deliver(part, src)
        ST.start_event_log(ST.stream_events(spark, src), out, ck, "27 hours", available_now=True).awaitTermination()
    return ST.merge_late(ST.read_event_log(spark, out)).select("run_id", "event", "step", "ts", "late")


@register("stream_telemetry_rollup")
def q_stream_rollup(spark, sf):
    """G3 on a stream: tumbling windows in update mode, so open windows count too."""
    from tuneframe.session import scratch_path

    src, ck, out = scratch_path(spark, "telemetry"), scratch_path(spark, "ckpt"), scratch_path(spark, "out")
    snaps = X.telemetry(spark, sf)
    snaps.write.parquet(src)
    stream = spark.readStream.schema(snaps.schema).parquet(src)
    r = G.rollup(G.device_rows(stream), "1 minute", watermark="0 seconds")
    ST.start_update_sink(r, out, ck).awaitTermination()
    return _rollup_out(ST.read_latest_updates(spark, out, ["host", "device", "window_start"]))


# ---------------------------------------------------------------- U2, T9


def _doc_texts(spark, sf):
    return X.table(spark, sf, "documents").select(F.col("doc_id").alias("idx"), "text", "lang")


@register("langid_documents")
def q_langid(spark, sf):
    docs = _doc_texts(spark, sf)
    return LI.detect_languages(docs, LI.fit_langid(docs, fit_rows=None))


@register("lang_distribution")
def q_lang_distribution(spark, sf):
    docs = _doc_texts(spark, sf)
    return LI.language_distribution(docs, LI.fit_langid(docs))


@register("lang_distribution_by_source")
def q_lang_distribution_by_source(spark, sf):
    """T9 with ``by``: the languages of every source."""
    docs = X.table(spark, sf, "documents").select(F.col("doc_id").alias("idx"), "text", "lang", "source")
    return LI.language_distribution(docs, LI.fit_langid(docs), by=["source"])


# ---------------------------------------------------------------- remaining K, P, V by dataset


@register("generation_prompts")
def q_generation_prompts(spark, sf):
    m = N.to_messages(_fixture(spark, sf, "chatml"), "chatml")
    return m.select("idx", K.render(F.col("messages"), generation_prompt=True, system_prompt="You are helpful.").alias("prompt"))


@register("vocab_lookup")
def q_vocab_lookup(spark, sf):
    """K9: ids of the words used in conversations (by the documents
    vocabulary), mapped back to their text."""
    docs = X.table(spark, sf, "documents").select(F.col("doc_id").alias("idx"), "text")
    vocab = K.build_vocabulary(docs, specials=["<pad>", "<eos>"])
    conv_words = X.table(spark, sf, "conversations").select(F.explode(K.words(F.col("text"))).alias("token")).distinct()
    ids = conv_words.join(vocab, "token").select("id")
    return K.lookup_ids(vocab, ids).select("id", "token", "is_special")


@register("token_lookup")
def q_token_lookup(spark, sf):
    """K9 the other way: every word of the conversations with its id, null where the vocabulary hasn't it."""
    docs = X.table(spark, sf, "documents").select(F.col("doc_id").alias("idx"), "text")
    vocab = K.build_vocabulary(docs, specials=["<pad>", "<eos>"])
    words = X.table(spark, sf, "conversations").select("conv_id", "turn", F.posexplode(K.words(F.col("text"))).alias("pos", "token"))
    return K.lookup_tokens(vocab, words).select("conv_id", "turn", "pos", "token", "id")


def _bytes_encoder():
    return lambda text: list(text.encode())


@register("chat_template")
def q_chat_template(spark, sf):
    """K1 by a template and K8 by a plug-in tokenizer, here one id per byte."""
    m = N.fold_turns(X.table(spark, sf, "conversations"))
    out = K.encoded_prompts(m, K.tokenizer_udf(_bytes_encoder), K.CHATML, generation_prompt=True)
    as_hex = F.array_join(F.transform("ids", lambda i: F.lpad(F.hex(i), 2, "0")), "")
    return out.select("idx", "prompt", F.size("ids").cast("bigint").alias("n_tokens"), as_hex.alias("ids"))


@register("chat_template_inst")
def q_chat_template_inst(spark, sf):
    """K1 by a template that puts the system text into the first user turn."""
    m = N.fold_turns(X.table(spark, sf, "conversations"))
    return m.select("idx", K.render(F.col("messages"), template=K.INST).alias("prompt"))


@register("limit_tokens")
def q_limit_tokens(spark, sf):
    c = X.table(spark, sf, "conversations").select("conv_id", "turn", K.words(F.col("text")).alias("tokens"))
    out = PR.limit_tokens(c, "tokens", 16)
    return out.select(
        "conv_id", "turn", F.size("tokens").cast("bigint").alias("n_tokens"), F.element_at("tokens", -1).alias("last_token")
    )


@register("validate_by_dataset")
def q_validate_by_dataset(spark, sf):
    """Ingest path per dataset: detect -> attach format -> normalise -> flag -> report.

    The records are derived twice, for the votes and for the flags; kept, they
    would hold every text four times and more. What is kept are the flags.
    """
    recs = X.format_records(spark, sf)
    fmt = D.detect_format(recs, by=["dataset"])
    msgs = N.to_messages(D.attach_format(recs, fmt, by=["dataset"]))
    msgs = msgs.select("dataset", "idx", "raw", "v", "fmt", "messages", "norm_error")
    flags = V.flag_records(msgs, by=["dataset"], keep=["dataset", "idx"])
    return V.validation_report(flags, by=["dataset"])


# ---------------------------------------------------------------- S3-S5 round trips


def _scratch(spark, name):
    from tuneframe.session import scratch_path

    return scratch_path(spark, name)


@register("csv_roundtrip")
def q_csv_roundtrip(spark, sf):
    """S3: the alpaca fixture as CSV (header, quoted multi-line cells) -> read -> normalise."""
    from tuneframe.sources.readers import read_csv

    recs = _fixture(spark, sf, "alpaca")
    cols = recs.select(
        "idx",
        F.expr("try_variant_get(v, '$.instruction', 'string')").alias("instruction"),
        F.expr("try_variant_get(v, '$.input', 'string')").alias("input"),
        F.expr("try_variant_get(v, '$.output', 'string')").alias("output"),
    )
    path = _scratch(spark, "alpaca-csv")
    cols.orderBy("idx").write.option("header", True).option("escape", '"').option("multiLine", True).csv(path)
    back = read_csv(spark, path)
    out = N.explode_messages(N.to_messages(back, "alpaca"))
    return out.select(F.col("idx").alias("file_idx"), "pos", "role", "content")


@register("txt_roundtrip")
def q_txt_roundtrip(spark, sf):
    """Document texts as a text file, one record per non-blank line."""
    from tuneframe.sources.readers import read_txt

    path = _scratch(spark, "docs-txt")
    X.table(spark, sf, "documents").orderBy("doc_id").select("text").write.text(path)
    back = read_txt(spark, path)
    return back.select(F.col("idx").alias("line_idx"), F.expr("try_variant_get(v, '$.text', 'string')").alias("text"))


@register("parquet_roundtrip")
def q_parquet_roundtrip(spark, sf):
    """Folded conversations written as a ``messages`` parquet dataset."""
    from tuneframe.sources.readers import read_parquet

    path = _scratch(spark, "conv-parquet")
    N.fold_turns(X.table(spark, sf, "conversations")).orderBy("idx").select("messages").write.parquet(path)
    back = read_parquet(spark, path)
    fmt = D.detect_format(back)
    msgs = N.to_messages(D.attach_format(back, fmt))
    return N.explode_messages(msgs).select(F.col("idx").alias("file_idx"), "pos", "role", "content")


@register("stream_latest_devices")
def q_stream_latest_devices(spark, sf):
    """G2 on a stream: newest reading per device, delivered in two rounds."""
    src, ck, out = _scratch(spark, "telemetry"), _scratch(spark, "ckpt"), _scratch(spark, "out")
    snaps = X.telemetry(spark, sf)
    cut = F.col("ts") < F.lit("2024-01-15 00:00:00").cast("timestamp")
    for part in (snaps.filter(cut), snaps.filter(~cut)):
        part.write.mode("append").parquet(src)
        stream = spark.readStream.schema(snaps.schema).parquet(src)
        agg = G.latest_devices(G.device_rows(stream))
        ST.start_update_sink(agg, out, ck).awaitTermination()
    d = ST.read_latest_updates(spark, out, ["host", "device"])
    return d.select("host", "device", _ts("ts").alias("ts"), "utilization_pct", "power_w", "ram_used_gb")


@register("validation_report_turns")
def q_validation_report_turns(spark, sf):
    """The flagship report computed on the turn table without folding."""
    from tuneframe.operators.turns import flag_turns

    return V.validation_report(flag_turns(X.dirty_conversations(spark, sf)))


@register("preview_chat")
def q_preview_chat(spark, sf):
    """The first 20 records of a JSONL file, shown as chat messages."""
    from tuneframe.sources.readers import preview, read_jsonl

    path = _scratch(spark, "chatml-jsonl")
    X.format_lines(spark, sf).filter(F.col("dataset") == "chatml").orderBy("idx").select("value").write.text(path)
    head = preview(read_jsonl(spark, path), 20)
    out = N.explode_messages(N.to_messages(head, "chatml"))
    return out.select(F.col("idx").alias("file_idx"), "pos", "role", "content")


# ---------------------------------------------------------------- jobs, routes, strict and broken records


def _ingest_dirty(spark, sf, times: int = 1):
    """The dirty conversations as a JSONL file, ingested by one job: ``(data, registry)`` folders."""
    from tuneframe.jobs import ingest

    src, data, registry = (_scratch(spark, n) for n in ("dirty-jsonl", "datasets", "registry"))
    lines = _dirty_msgs(spark, sf).orderBy("idx").select(F.to_json(F.struct("messages")).alias("value"))
    lines.write.text(src)
    for _ in range(times):
        ingest(spark, src, data, registry, "dirty-1", "dirty", ".jsonl")
    return data, registry


@register("ingest_registry")
def q_ingest_registry(spark, sf):
    """Two files of different kinds ingested; a rerun of a job adds no row."""
    from tuneframe.jobs import ingest
    from tuneframe.sources.readers import read_registry

    data, registry = _ingest_dirty(spark, sf, times=2)
    src = _scratch(spark, "docs-txt")
    X.table(spark, sf, "documents").orderBy("doc_id").select("text").write.text(src)
    ingest(spark, src, data, registry, "docs-1", "docs", "txt")
    return read_registry(spark, registry).select("job_id", "name", "format", "confidence", "row_count", "repaired_from")


@register("ingest_report")
def q_ingest_report(spark, sf):
    """T10 and V8 as the registry holds them."""
    from tuneframe.sources.readers import read_registry

    _, registry = _ingest_dirty(spark, sf)
    stats = F.from_json("stats_json", "quality_score double, duplicate_examples long, entropy_score double, avg_turns double")
    report = F.from_json("report_json", "issues_found long, num_examples_checked long, categories array<struct<category:string,count:long>>")
    row = read_registry(spark, registry).select(stats.alias("s"), report.alias("r"))
    return row.select("s.*", "r.issues_found", "r.num_examples_checked", F.explode("r.categories").alias("c")).select(
        "c.category", "c.count", "issues_found", "num_examples_checked", "quality_score", "duplicate_examples", "entropy_score", "avg_turns")


@register("repair_registry")
def q_repair_registry(spark, sf):
    """The repaired dataset, written, described and registered."""
    from tuneframe.jobs import repair_dataset
    from tuneframe.sources.readers import read_registry

    data, registry = _ingest_dirty(spark, sf)
    repair_dataset(spark, registry, "dirty-1", data, "dirty-2", REPAIR_OPTS)
    summary = F.from_json("repair_json", "input_count long, roles_fixed long, merged_turns long, duplicates_removed long, "
                          "empty_responses_removed long, turns_truncated long, examples_split long, output_count long")
    stats = F.from_json("stats_json", "num_examples long, duplicate_examples long, empty_count long")
    row = read_registry(spark, registry).filter(F.col("repaired_from").isNotNull())
    return row.select("job_id", "name", "format", "row_count", "repaired_from", summary.alias("r"), stats.alias("s")).select(
        "job_id", "name", "format", "row_count", "repaired_from", "r.*", "s.num_examples", "s.duplicate_examples")


@register("repair_summary_by_dataset")
def q_repair_summary_by(spark, sf):
    """R8 with ``by``: a summary per tenth of the conversations."""
    m = _dirty_msgs(spark, sf).withColumn("dataset", F.col("idx") % 10)
    return R.repair_summary(m, REPAIR_OPTS, by=["dataset"])


@register("json_documents")
def q_json_documents(spark, sf):
    """Documents of a hundred records each, as lists and in wrappers, with keys in an order of their own."""
    from tuneframe.sources.readers import read_json

    rec = F.concat(F.lit('{"source" : "'), "source", F.lit('",  "doc_id":'), F.col("doc_id").cast("string"), F.lit(', "a": [1,  2]}'))
    rows = X.table(spark, sf, "documents").select(F.expr("doc_id div 100").alias("part"), "doc_id", rec.alias("rec"))
    docs = rows.groupBy("part").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "rec"))), lambda x: x["rec"]), " ,\n").alias("l"))
    doc = F.when(F.col("part") % 2 == 0, F.concat(F.lit(" ["), "l", F.lit("] "))).otherwise(
        F.concat(F.lit('{"meta": {"data": 1}, "records": [ '), "l", F.lit(' ], "n": 1}')))
    path = _scratch(spark, "documents-json")
    docs.select("part", doc.alias("value")).write.partitionBy("part").text(path)
    recs = N.to_messages(read_json(spark, path), "unknown")
    return N.explode_messages(recs.withColumn("doc_id", F.expr("try_variant_get(v, '$.doc_id', 'bigint')")), ["doc_id"])


@register("strict_records")
def q_strict_records(spark, sf):
    """The trainer's reader on a JSONL file."""
    from tuneframe.sources.readers import read_training_records

    path = _scratch(spark, "chatml") + ".jsonl"
    X.format_lines(spark, sf).filter(F.col("dataset") == "chatml").orderBy("idx").select("value").write.text(path)
    out = N.explode_messages(N.to_training_messages(read_training_records(spark, path), "chatml"))
    return out.select(F.col("idx").alias("file_idx"), "pos", "role", "content")


@register("norm_errors")
def q_norm_errors(spark, sf):
    """Conversations with a number, zero, null, true or text where the list belongs."""
    from tuneframe.sources.readers import records_from_lines

    kinds = ["7", "0", "null", "true", '"text"', "1.5", "false", "[]"]
    broken = F.element_at(F.array(*[F.lit(k) for k in kinds]), (F.col("idx") % len(kinds)).cast("int") + 1)
    lines = _folded_conversations(spark, sf).select("idx", F.concat(F.lit('{"conversations": '), broken, F.lit("}")).alias("value"))
    return N.to_messages(records_from_lines(lines), "sharegpt").select("idx", "norm_error", F.size("messages").alias("n_messages"))


def _folded_conversations(spark, sf):
    return N.fold_turns(X.table(spark, sf, "conversations"))


@register("event_routes")
def q_event_routes(spark, sf):
    """M1: every event kind in a frame of its own."""
    out = None
    for kind, df in M.route(X.run_lifecycle(spark, sf)).items():
        part = df.groupBy("run_id").agg(F.lit(kind).alias("route"), F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"))
        out = part if out is None else out.unionByName(part)
    return out


@register("prepare_objectives")
def q_prepare_objectives(spark, sf):
    """What each objective trains on."""
    sft = PR.prepare(_fixture(spark, sf, "chatml"), "sft", "chatml").select(F.lit("sft").alias("objective"), F.col("split").alias("part"))
    dpo = PR.prepare(_fixture(spark, sf, "preference"), "dpo", "preference").select(F.lit("dpo").alias("objective"), F.lit("pair").alias("part"))
    kto = PR.prepare(_fixture(spark, sf, "preference"), "kto", "preference").select(
        F.lit("kto").alias("objective"), F.col("label").cast("string").alias("part"))
    return sft.unionByName(dpo).unionByName(kto).groupBy("objective", "part").agg(F.count(F.lit(1)).alias("n"))


@register("profile_languages")
def q_profile_languages(spark, sf):
    """T10 with T9: the languages of the profile."""
    docs = _doc_texts(spark, sf)
    msgs = N.to_messages(X.documents_as_records(spark, sf))
    p = P.profile(msgs, languages=LI.fit_langid(docs))
    return p.select("num_examples", F.explode("languages").alias("language", "n"))
