"""Detection and validation by dataset: whole records are neither kept on disk nor dealt out by dataset."""

import os
import random
import time

from pyspark.sql import functions as F

from tuneframe.operators import detect as D
from tuneframe.operators import validate as V
from tuneframe.plans.queries import REGISTRY
from tuneframe.session import FREE_SHUFFLES, checkpoint_dir, materialize


def folder_bytes(path):
    path = path.removeprefix("file:")
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names)


def shuffle_numbers(spark):
    """The shuffles that have files here."""
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    names = [files.apply(i).getName() for i in range(files.size())]
    return {int(n.split("_")[1]) for n in names if n.startswith("shuffle_")}


def big_tables(spark, path):
    """20 documents and 4 conversations of random letters; one document and one conversation twice."""
    rng = random.Random(4)
    text = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz     ", k=60_000))
    texts = [text() for _ in range(19)]
    docs = [(i, t, "en", f"source_{i % 2}") for i, t in enumerate([*texts, texts[0]])]
    asked = [text() for _ in range(3)]
    turns = [(c, k, role, t) for c, t in enumerate([*asked, asked[0]]) for k, role in enumerate(["user", "assistant"])]
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string").coalesce(2).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(turns, "conv_id bigint, turn int, role string, text string").coalesce(2).write.parquet(f"{path}/conversations.parquet")


def test_validate_by_dataset_keeps_no_texts(spark, tmp_dir):
    big_tables(spark, tmp_dir)
    kept = folder_bytes(checkpoint_dir(spark))
    got = {(r.dataset, r.category): r for r in REGISTRY["validate_by_dataset"](spark, tmp_dir).collect()}
    assert len(got) == 8 * len(V.CATEGORIES)
    seen = {d: r.num_examples_checked for (d, _), r in got.items()}
    assert seen == {"sharegpt": 4, "chatml": 4, "alpaca": 4, "llama": 4, "preference": 10, "raw_text": 20, "unknown": 20, "mixed": 66}
    twice = {d: (r["count"], r.sample_indices) for (d, c), r in got.items() if c == "duplicate_samples"}
    assert twice["raw_text"] == (1, "19") and twice["sharegpt"] == (1, "3") and twice["preference"] == (0, "")
    # Mixed: a conversation reads the same in its four formats, but for the input that alpaca adds to 0 and its copy 3; and one document.
    assert twice["mixed"][0] == 5 + 3 + 3 + 1
    assert folder_bytes(checkpoint_dir(spark)) - kept < 100_000


def test_format_by_dataset_is_broadcast_once_counted(spark, monkeypatch):
    # A frame made of rows has no size that the planner knows.
    rows = [("a", 1, '{"text": "x"}'), ("a", 2, '{"text": "y"}'), ("b", 1, '{"messages": [{"role": "user", "content": "z"}]}')]
    recs = spark.createDataFrame([*rows, (None, 1, '{"text": "w"}')], "dataset string, idx bigint, raw string").withColumn("v", F.parse_json("raw"))
    attach = lambda: D.attach_format(recs, D.detect_format(recs, by=["dataset"]), by=["dataset"])
    known = {("a", 1, "raw_text"), ("a", 2, "raw_text"), ("b", 1, "chatml"), (None, 1, None)}
    found = lambda df: {(r.dataset, r.idx, r.fmt) for r in df.collect()}
    small = attach()
    plan = small._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan
    assert found(small) == known
    monkeypatch.setattr(D, "BROADCAST_DATASETS", 1)
    assert found(attach()) == known


def test_materialize_frees_what_it_shuffled(spark):
    df = spark.range(1000).groupBy(F.pmod(F.xxhash64("id"), F.lit(10)).alias("k")).count()
    setting, number = spark.conf.get(FREE_SHUFFLES, None), spark.sparkContext._jsc.sc().newShuffleId
    first = number()
    freed = materialize(df, free_shuffles=True)
    after = number()
    assert after > first + 1 and spark.conf.get(FREE_SHUFFLES, None) == setting
    ends = time.time() + 20
    while (left := shuffle_numbers(spark) & set(range(first, after))) and time.time() < ends:
        time.sleep(0.2)
    assert not left
    assert sorted(map(tuple, freed.collect())) == sorted(map(tuple, df.collect()))
