"""Plan shape (pruning, pushdown, shuffles) and the plug-in / job surfaces."""

import os

from pyspark.sql import functions as F

from tests.conftest import SF001, SF01
from tuneframe.operators import langid
from tuneframe.operators import normalize as N
from tuneframe.operators import repair as R
from tuneframe.operators import tokens as K
from tuneframe.plans import fixtures as X
from tuneframe.sources import readers as S
from tuneframe.streaming import runs as ST


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_fold_prunes_columns_and_shuffles_once(spark):
    c = spark.read.parquet(f"{SF01}/conversations.parquet")
    p = plan(N.fold_turns(c.filter(F.col("conv_id") < 50)))
    assert "ReadSchema: struct<conv_id:bigint,turn:bigint,role:string,text:string>" in p
    assert "PushedFilters: [IsNotNull(conv_id), LessThan(conv_id,50)]" in p
    assert p.count("Exchange hashpartitioning") == 1


def test_preview_filter_reaches_the_scan(spark, tmp_dir):
    spark.range(100).selectExpr("id AS idx", "cast(id AS string) AS raw").write.parquet(f"{tmp_dir}/idx")
    p = plan(S.preview(spark.read.parquet(f"{tmp_dir}/idx"), 20))
    assert "LessThan(idx,20)" in p


def test_scans_are_dealt_only_where_the_session_asks(spark):
    assert "Exchange" not in plan(X.table(spark, SF001, "documents"))
    spark.conf.set(X.SCAN_PARTITIONS, "6")
    try:
        assert "RoundRobinPartitioning(6)" in plan(X.table(spark, SF001, "documents"))
    finally:
        spark.conf.unset(X.SCAN_PARTITIONS)


def test_tokenizer_plugin_is_batched(spark):
    def make():
        vocab = {}

        def enc(text):
            return [vocab.setdefault(w, len(vocab)) for w in text.split()]

        return enc

    enc = K.tokenizer_udf(make)
    m = N.fold_turns(X.table(spark, SF001, "conversations"))
    tc = K.token_counts(m, encoder=enc)
    base = K.token_counts(m)
    a = {r.idx: r.n_tokens for r in tc.select("idx", "n_tokens").collect()}
    b = {r.idx: r.n_tokens for r in base.select("idx", "n_tokens").collect()}
    assert a == b


def test_detector_plugin_is_batched(spark):
    def make():
        words = {"the": "en", "der": "de"}

        def detect(text):
            return next((words[w] for w in text.split() if w in words), None)

        return detect

    df = spark.createDataFrame([(1, "the cat"), (2, "der Hund"), (3, "???"), (4, None)], "idx long, text string")
    out = langid.detect_with_udf(df, langid.detector_udf(make))
    assert "ArrowEvalPython" in plan(out)
    assert {r["idx"]: r["language"] for r in out.collect()} == {1: "en", 2: "de", 3: None, 4: None}


def test_registry_keeps_one_row_per_job(spark, tmp_dir):
    def entry(n):
        return spark.createDataFrame([("fixed", f"{tmp_dir}/in", f"{tmp_dir}/out", "chatml", 1.0, n, "{}", "{}", None, "1")], S.REGISTRY_SCHEMA)

    S.register_dataset(f"{tmp_dir}/registry", "a", entry(1))
    S.register_dataset(f"{tmp_dir}/registry", "a", entry(2))
    S.register_dataset(f"{tmp_dir}/registry", "b", entry(3))
    assert sorted((r.job_id, r.row_count) for r in S.read_registry(spark, f"{tmp_dir}/registry").collect()) == [("a", 2), ("b", 3)]


def test_router_writes_each_kind(spark, tmp_dir):
    ev = X.run_events(spark, SF001)
    src = f"{tmp_dir}/events"
    ev.repartition("run_id").write.partitionBy("run_id").json(src)
    q = ST.start_router(ST.stream_events(spark, src), f"{tmp_dir}/routed", f"{tmp_dir}/ck", available_now=True)
    q.awaitTermination()
    routed = spark.read.parquet(f"{tmp_dir}/routed")
    got = {r.event: r["count"] for r in routed.groupBy("event").count().collect()}
    exp = {r.event: r["count"] for r in ev.groupBy("event").count().collect()}
    assert got == exp
    assert os.path.isdir(f"{tmp_dir}/routed/batch_id=0")


def test_encoded_texts_leave_a_worker_in_pieces():
    """The ids of a batch of texts are not held all at once."""
    import pandas as pd

    from tuneframe.operators import tokens as K

    enc = K.tokenizer_udf(lambda: lambda t: list(t.encode()))
    out = list(enc.func(iter([pd.Series(["ab", None] * 500), pd.Series([], dtype=object)])))
    assert max(len(s) for s in out) <= K.ENCODE_ROWS and sum(len(s) for s in out) == 1000
    assert out[0].iloc[0] == [97, 98] and out[0].iloc[1] == []
