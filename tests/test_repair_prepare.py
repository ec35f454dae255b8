"""Repair properties, preparation invariants and the dirty-fixture counts."""

import json
from collections import Counter

from pyspark.sql import functions as F

from tests.conftest import SF01
from tuneframe.operators import detect as D
from tuneframe.operators import normalize as N
from tuneframe.operators import prepare as PR
from tuneframe.operators import profile as P
from tuneframe.operators import repair as R
from tuneframe.operators import validate as V
from tuneframe.plans import fixtures as X
from tuneframe.sources.readers import records_from_lines


def msgs(spark, rows):
    data = [(i, [(r, c) for r, c in m], False) for i, m in enumerate(rows)]
    return spark.createDataFrame(data, "idx long, messages array<struct<role:string,content:string>>, norm_error boolean")


def test_dirty_fixture_counts(spark):
    rep = V.validation_report(V.flag_records(N.fold_turns(X.dirty_conversations(spark, SF01))))
    got = {r.category: r["count"] for r in rep.collect()}
    assert got["role_mismatch"] == 16 and got["empty_responses"] == 12
    assert got["broken_utf8"] == 5 and got["unsupported_tokens"] == 6 and got["duplicate_samples"] == 11


def test_merge_strips_at_each_merge(spark):
    df = msgs(spark, [[("assistant", "lead"), ("user", "a "), ("user", "  "), ("user", "b"), ("assistant", "x"), ("system", "s"), ("system", "t")]])
    out = R.repair(df, R.RepairOptions(remove_duplicates=False)).collect()[0].messages
    assert [(m.role, m.content) for m in out] == [("user", "a\nb"), ("assistant", "x"), ("system", "s"), ("system", "t")]


def test_repair_idempotent_and_counts_balance(spark):
    base = N.fold_turns(X.dirty_conversations(spark, SF01))
    opts = R.RepairOptions(max_turn_chars=300)
    once = R.repair(base, opts).select("idx", "messages", F.lit(False).alias("norm_error"))
    twice = R.repair(once, opts)
    a = sorted((r.idx, json.dumps([tuple(m) for m in r.messages])) for r in once.collect())
    b = sorted((r.idx, json.dumps([tuple(m) for m in r.messages])) for r in twice.collect())
    assert a == b
    s = R.repair_summary(base, opts).collect()[0]
    assert s.input_count == s.output_count + s.duplicates_removed + s.empty_responses_removed


def test_split_and_dedupe_order(spark):
    df = msgs(spark, [[("user", "a"), ("assistant", "b"), ("user", "a"), ("assistant", "b")], [("user", "a"), ("assistant", "b")]])
    out = R.repair(df, R.RepairOptions(split_oversized=2)).collect()
    assert sorted((r.idx, r.chunk) for r in out) == [(0, 0)]
    s = R.repair_summary(df, R.RepairOptions(split_oversized=2)).collect()[0]
    assert (s.examples_split, s.duplicates_removed, s.output_count) == (1, 2, 1)


def test_shuffle_is_a_deterministic_permutation(spark):
    base = N.fold_turns(X.dirty_conversations(spark, SF01))
    o = R.RepairOptions(shuffle=True)
    a = [r.idx for r in R.repair(base, o).collect()]
    b = [r.idx for r in R.repair(base, o).collect()]
    plain = sorted(r.idx for r in R.repair(base).collect())
    assert a == b and sorted(a) == plain and a != plain


def test_split_950_50(spark):
    df = spark.range(1000).withColumnRenamed("id", "idx")
    counts = {r.split: r["count"] for r in PR.train_eval_split(df).groupBy("split").count().collect()}
    assert counts == {"train": 950, "eval": 50}
    small = spark.range(20).withColumnRenamed("id", "idx")
    assert PR.train_eval_split(small).filter("split = 'eval'").count() == 1
    assert PR.train_eval_split(small, min_rows=20).filter("split = 'eval'").count() == 0
    assert PR.train_eval_split(small.filter("idx < 0")).count() == 0


def test_packing_lays_examples_end_to_end(spark):
    lens = [5, 300, 1200, 512, 1, 0, 700, 512, 100, None] * 20
    # Ids far apart, so that the running total crosses blocks.
    df = spark.createDataFrame([(i * 30_011, n) for i, n in enumerate(lens)], "idx long, n long")
    want, at = [], 0
    for i, n in enumerate(lens):
        start, end = at, at + (n or 0)
        at = end
        for k in range(start // 512, max(end - 1, start) // 512 + 1):
            lo, hi = max(start, k * 512), min(end, (k + 1) * 512)
            want.append((k, i * 30_011, lo - k * 512, hi - lo))
    for parts in (1, 7):
        got = [tuple(r) for r in PR.pack(df.repartition(parts), "n", 512).collect()]
        assert sorted(got) == sorted(want)
    assert PR.pack(df.filter("idx < 0"), "n", 512).collect() == []


def test_long_records_and_late_format_changes_count(spark):
    long = " ".join(f"w{i}" for i in range(6000))
    recs = records_from_lines(spark.createDataFrame([(0, json.dumps({"text": long}))], "idx long, value string"))
    m = N.to_messages(recs, "raw_text")
    assert P.entropy(P.record_metrics(m)).collect()[0].distinct_words == 6000
    assert P.entropy(P.record_metrics(m), words_per_record=5000).collect()[0].distinct_words == 5000
    lines = [json.dumps({"text": "plain"})] * 200 + [json.dumps({"instruction": "i", "output": "o"})] * 300
    many = records_from_lines(spark.createDataFrame(list(enumerate(lines)), "idx long, value string"))
    d = D.detect_format(many).collect()[0]
    assert (d.format, d.sampled, d.votes, d.confidence) == ("alpaca", 500, 300, 0.6)
    assert D.detect_format(many, sample=200).collect()[0].format == "raw_text"


def test_profile_of_no_records(spark):
    none = records_from_lines(spark.createDataFrame([], "idx long, value string"))
    rm = P.record_metrics(N.to_messages(none, "raw_text"))
    p = P.profile(N.to_messages(none, "raw_text")).collect()[0]
    assert (p.num_examples, p.quality_score, p.duplicate_ratio, p.avg_turns, p.role_counts) == (0, 0.0, 0.0, None, {})
    q = P.quality_score(rm).collect()[0]
    assert (q.num_examples, q.duplicate_ratio, q.quality_score) == (0, 0.0, 0.0)


def test_falsy_values_make_no_turn(spark):
    recs = [
        ({"instruction": "i", "input": [], "output": 0}, [("user", "i")]),
        ({"instruction": "i", "input": False, "output": {}}, [("user", "i")]),
        ({"instruction": "i", "input": "0", "output": "false"}, [("user", "i\n\n0"), ("assistant", "false")]),
        ({"instruction": "i", "input": 7, "output": 0.0}, [("user", "i\n\n7")]),
        ({"prompt": 0, "instruction": "q", "chosen": "c", "rejected": "r"}, [("user", "q"), ("assistant", "c")]),
        ({"prompt": [], "chosen": "c", "rejected": "r"}, [("assistant", "c")]),
    ]
    lines = [(i, json.dumps(r)) for i, (r, _) in enumerate(recs)]
    got = N.to_messages(records_from_lines(spark.createDataFrame(lines, "idx long, value string")))
    by = {r.idx: [(m.role, m.content) for m in r.messages] for r in got.collect()}
    assert by == {i: w for i, (_, w) in enumerate(recs)}


def test_kto_positives_first(spark):
    lines = spark.createDataFrame(
        [(0, json.dumps({"prompt": "p", "chosen": "c", "rejected": "r"})), (1, json.dumps({"prompt": "q", "chosen": "c2", "rejected": None}))],
        "idx long, value string",
    )
    k = PR.kto_rows(PR.preference_triples(records_from_lines(lines))).orderBy("ord", "idx").collect()
    assert [(r.completion, r.label) for r in k] == [("c", True), ("r", False)]


def brute_merge(turns):
    out = []
    for role, content in turns:
        if out and out[-1][0] == role and role != "system":
            out[-1] = (role, (out[-1][1] + "\n" + content).strip())
        else:
            out.append((role, content))
    return out


def test_merge_equals_the_step_by_step_fold(spark):
    import random

    rnd = random.Random(5)
    texts = ["", " ", "a", " a", "a ", " a  ", "\n", "b\n", "\u3000x\u3000", "two\nlines "]
    rows = [[(rnd.choice(["user", "user", "assistant", "system"]), rnd.choice(texts)) for _ in range(rnd.randint(0, 9))] for _ in range(600)]
    got = msgs(spark, rows).select("idx", F.expr(R.merge_expr("messages")).alias("m")).collect()
    assert {r.idx: [tuple(m) for m in r.m] for r in got} == {i: brute_merge(t) for i, t in enumerate(rows)}


def test_merge_is_linear(spark):
    """Ten thousand turns of one role, and a hundred thousand, in about ten times the time."""
    import time

    def seconds(n):
        df = msgs(spark, [[("user", f"turn {i} ") for i in range(n)]]).cache()
        df.count()
        start = time.monotonic()
        r = df.select(F.expr(R.merge_expr("messages")).alias("m")).first()
        took = time.monotonic() - start
        assert len(r.m) == 1 and r.m[0].content == "turn 0 \n" + "\n".join(f"turn {i}" for i in range(1, n))
        return took

    seconds(10_000)
    assert seconds(100_000) < 40 * max(0.25, seconds(10_000))


def test_keyed_counts_of_odd_words_and_roles(spark):
    """Words are lower-cased one by one: capitals outside ASCII, a final sigma and words that look like tags among them."""
    texts = [
        [("user", "ΟΔΟΣ ΟΔΟΣ\u0085ΣΑΣ\x1cİz İz"), ("a b", "hash tokens 7 empty Empty")],
        [("user", "  ")],
        [],
        [("user", "x ΑΣ　X role user"), ("user", None)],
    ]
    rm = P.record_metrics(msgs(spark, texts))
    want = Counter()
    for r in rm.collect():
        text = " ".join(m.content for m in r.messages if m.content is not None)
        rows = [("turns", str(r.n_turns)), ("tokens", str(r.n_tokens)), *[("word", w.lower()) for w in text.split()]]
        rows += [("empty", "")] * r.is_empty + [("role_mismatch", "")] * bool(r.is_role_mismatch) + [("role", m.role) for m in r.messages]
        rows += [("hash", bytes(r.content_hash).hex().upper())] if r.content_hash is not None else []
        want.update(rows)
    assert {(r.kind, r.key): r.c for r in P.keyed_counts(rm).collect()} == want
    few = P.keyed_counts(rm, words_per_record=1).filter("kind = 'word'").collect()
    assert {r.key: r.c for r in few} == {"οδος": 1, "x": 1}


def test_profile_splits_a_text_once(spark):
    """F7 and F11 of round 3: texts were split twice, and every counted word went through the last aggregate."""
    df = msgs(spark, [[("user", "a b a"), ("assistant", "c")], [("user", "a b a"), ("assistant", "c")]])
    rm = P.record_metrics(df)
    plan = P.keyed_counts(rm)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1
    p = P.profile(df).first()
    assert (p.num_examples, p.duplicate_examples, p.min_tokens, p.max_tokens, p.role_counts) == (2, 1, 4, 4, {"user": 2, "assistant": 2})
    assert p.entropy_score == round(1.5 / __import__("math").log2(3), 4)
