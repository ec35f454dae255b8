"""F1 and N1-N8 on edge records, against messages written out by hand."""

import json

import pytest
from pyspark.sql import functions as F

from tuneframe.operators import detect as D
from tuneframe.operators import normalize as N
from tuneframe.sources.readers import records_from_lines

# (record, format it is read as, its messages)
CASES = [
    ({"conversations": [{"from": "human", "value": "hi"}, {"from": "gpt", "value": "yo"}]}, "sharegpt",
     [("user", "hi"), ("assistant", "yo")]),
    ({"conversations": [{"role": "USER", "content": "a"}, "junk", {"from": "bot", "value": "b"}]}, "sharegpt",
     [("user", "a"), ("assistant", "b")]),
    ({"conversations": []}, "sharegpt", []),
    ({"messages": [{"role": "system", "content": "s"}, {"role": "user", "content": None}]}, "chatml",
     [("system", "s"), ("user", "")]),
    ({"prompt": "q", "chosen": "c", "rejected": "r"}, "preference", [("user", "q"), ("assistant", "c")]),
    ({"instruction": "do it", "input": "ctx", "output": "ok"}, "alpaca", [("user", "do it\n\nctx"), ("assistant", "ok")]),
    ({"instruction": "do", "response": "resp"}, "alpaca", [("user", "do"), ("assistant", "resp")]),
    ({"text": "[INST] <<SYS>> be kind <</SYS>> hello [/INST] hi there"}, "llama",
     [("system", "be kind"), ("user", "hello"), ("assistant", "hi there")]),
    ({"text": "[INST] one [/INST] two [INST] three [/INST] four"}, "llama",
     [("user", "one"), ("assistant", "two"), ("user", "three"), ("assistant", "four")]),
    ({"text": "plain text"}, "raw_text", [("user", "plain text")]),
]

VOTES = [
    ({"conversations": [{"from": "human", "value": "x"}]}, "sharegpt"),
    ({"messages": [{"role": "user", "content": "x"}]}, "chatml"),
    ({"prompt": "p", "chosen": "c", "rejected": "r"}, "preference"),
    ({"instruction": "i", "output": "o"}, "alpaca"),
    ({"text": "[INST] a [/INST] b"}, "llama"),
    ({"text": "plain"}, "raw_text"),
    ({"a": 1, "b": "x"}, "unknown"),
]


def records(spark, rows):
    return records_from_lines(spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(rows)], "idx long, value string"))


@pytest.mark.parametrize("fmt", sorted({f for _, f, _ in CASES}))
def test_messages_of_each_format(spark, fmt):
    cases = [(r, m) for r, f, m in CASES if f == fmt]
    got = {r.idx: r.messages for r in N.to_messages(records(spark, [r for r, _ in cases]), fmt).collect()}
    for i, (record, want) in enumerate(cases):
        assert [(m.role, m.content) for m in got[i]] == want, record


def test_votes(spark):
    got = {r.idx: r.vote for r in D.classify_records(records(spark, [r for r, _ in VOTES])).collect()}
    assert {i: v or "unknown" for i, v in got.items()} == {i: v for i, (_, v) in enumerate(VOTES)}


def test_conversion_error_flag(spark):
    errs = {r.idx: r.norm_error for r in N.to_messages(records(spark, [{"text": "a"}, {"conversations": 5}, {}]), "unknown").collect()}
    assert [i for i, e in errs.items() if e] == [1]


def test_detect_format_ties_and_confidence(spark):
    # two alpaca, two sharegpt votes -> tie goes to alpaca (declared first)
    rows = [
        {"instruction": "a", "output": "b"},
        {"conversations": [{"from": "human", "value": "x"}]},
        {"instruction": "c", "response": "d"},
        {"conversations": [{"role": "user", "value": "y"}]},
        {"nothing": 1},
    ]
    lines = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(rows)], "idx long, value string")
    d = D.detect_format(records_from_lines(lines)).collect()[0]
    assert (d.format, d.confidence, d.sampled, d.votes) == ("alpaca", 0.4, 5, 2)
    empty = records_from_lines(spark.createDataFrame([(0, '{"z": 1}')], "idx long, value string"))
    d2 = D.detect_format(empty).collect()[0]
    assert (d2.format, d2.confidence) == ("unknown", 0.0)


def test_training_normaliser_differs(spark):
    rec = {"conversations": [{"from": "tool", "value": "t"}, {"from": "human", "value": "h"}]}
    lines = spark.createDataFrame([(0, json.dumps(rec))], "idx long, value string")
    r = records_from_lines(lines)
    train = N.to_training_messages(r, "sharegpt").collect()[0].messages
    view = N.to_messages(r, "sharegpt").collect()[0].messages
    assert [m.role for m in train] == ["tool", "user"]
    assert [m.role for m in view] == ["user", "user"]


def test_records_are_parsed_once(spark):
    """One parse per line, no regex over it; the mixed dataset shares the records of the others."""
    from tests.conftest import SF001
    from tuneframe.plans import fixtures as X
    from tuneframe.sources.readers import records_from_lines

    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    odd = ["　\x1c {\"text\": \"a \"}\x85 \n", "   ", "[1] \r\n", "\x0b7", "{\"a\": ", ""]
    lines = spark.createDataFrame(list(enumerate(odd)), "idx long, value string")
    recs = records_from_lines(lines)
    assert [r.raw for r in recs.orderBy("idx").collect()] == ['{"text": "a "}', '{"value":[1]}', '{"value":7}']
    one = plan(records_from_lines(spark.range(3).select(F.concat(F.lit("["), "id", F.lit("]")).alias("value"))))
    assert one.count("parseJson") == 1 and "regexp_replace" not in one
    alone, all_of_them = plan(X.format_records(spark, SF001, with_mixed=False)), plan(X.format_records(spark, SF001))
    assert all_of_them.count("Relation [") == alone.count("Relation [") and all_of_them.count("parseJson") == 1


def test_inst_tags_sql_equals_the_pattern(spark):
    from tuneframe.functions.text import INST_TAG_PATTERN, has_inst_tags_sql

    texts = ["", "INST]", "[INST]x", "a[/INST]", "<", "<<SYS>>", "x<</SYS>>", "<|a|>", "<|a\n|>", "<| |", "é<|é|>é", "[INST", "[/INST] <|x|>", None]
    df = spark.createDataFrame([(t,) for t in texts], "x string")
    got = df.select(F.expr(has_inst_tags_sql("x")).alias("a"), F.col("x").rlike(INST_TAG_PATTERN).alias("b")).collect()
    assert [r.a for r in got] == [r.b for r in got]
