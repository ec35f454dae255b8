"""Chat reconstruction and vector search against brute force, and odd rows."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tuneframe.llm import ann, chat, topk

EVENT = "conv_id long, seq long, kind string, turn long, role string, text string"

# ---------------------------------------------------------------- chat


def brute_fold(events):
    """Event by event in the order of ``seq``."""
    out = {}
    for conv in {e[0] for e in events}:
        turns, roles = {}, {}
        for _, _, kind, turn, role, text in sorted((e for e in events if e[0] == conv), key=lambda e: e[1]):
            if kind not in ("message", "delta", "edit", "regenerate"):
                continue
            if role:
                roles[turn] = role
            if kind in ("edit", "regenerate"):
                turns = {t: x for t, x in turns.items() if t <= turn}
            if kind == "delta":
                turns[turn] = turns.get(turn, "") + (text or "")
            else:
                turns[turn] = "" if kind == "regenerate" else text or ""
        for t, x in turns.items():
            out[conv, t] = (roles.get(t, ""), x)
    return out


def random_log(seed, convs=120):
    rng = random.Random(seed)
    rows = []
    for conv in range(convs):
        for seq in rng.sample(range(1000), rng.randint(1, 16)):
            kind = rng.choice(["message", "delta", "delta", "delta", "edit", "regenerate", "noise"])
            rows.append((conv, seq, kind, rng.randint(0, 3), rng.choice([None, "", "user", "assistant"]), rng.choice([None, "", "a", "<|im_end|>", "b\n"])))
    return rows


def test_edits_deltas_and_regenerations_equal_the_fold(spark):
    for seed in (1, 2):
        rows = random_log(seed)
        got = chat.reconstruct(spark.createDataFrame(rows, EVENT).repartition(5)).collect()
        assert {(r.conv_id, r.turn): (r.role, r.text) for r in got} == brute_fold(rows)
        assert len(got) == len({(r.conv_id, r.turn) for r in got})


def test_a_delta_after_an_edit_stays(spark):
    log = [(1, 0, "message", 0, "user", "q"), (1, 1, "message", 1, "assistant", "a"), (1, 2, "message", 2, "user", "old"),
           (1, 3, "edit", 0, None, "Q"), (1, 4, "delta", 2, None, "new"), (1, 5, "regenerate", 1, "assistant", "x"), (1, 6, "delta", 1, None, "A")]
    got = {r.turn: (r.role, r.text) for r in chat.reconstruct(spark.createDataFrame(log[:5], EVENT)).collect()}
    assert got == {0: ("user", "Q"), 2: ("user", "new")}
    got = {r.turn: (r.role, r.text) for r in chat.reconstruct(spark.createDataFrame(log, EVENT)).collect()}
    assert got == {0: ("user", "Q"), 1: ("assistant", "A")}


TEXTS = ["", "plain", "<|im_end|>", "<\\|im_start|>", "<\\\\|", "a<|b|>c<|", "%0A\n%", "<|im_end|>\n<|im_start|>assistant\nok<|im_end|>\n", "é 日", "x" * 20_000]


def test_render_reads_back_whatever_a_text_holds(spark):
    rows = []
    for conv, first in enumerate(TEXTS):
        rows += [(conv, 0, "system" if conv % 2 else first[:50], first), (conv, 1, "assistant", TEXTS[-1 - conv]), (conv, 2, "a\nb%", first), (conv, 3, "assistant", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat.read_back(chat.render(df)).collect()
    for r in out:
        mine = [(x[2], x[3]) for x in rows if x[0] == r.conv_id]
        assert [(t.role, t.text) for t in r.turns] == mine
        assert list(r.loss) == [t for role, t in mine if role == "assistant"]
        assert r.formatted.count("<|im_start|>") == r.formatted.count("<|im_end|>") == len(mine)


def test_chat_odd_rows(spark):
    rows = [(None, None, "message", None, None, None), (None, 3, "delta", None, "user", "x"), (1, None, "delta", 0, None, "first"),
            (1, 1, "delta", 0, None, "second"), (1, 1, "delta", 0, None, "second"), (2, 1, "edit", 5, "user", "only"), (3, 1, "unknown", 0, "u", "t")]
    df = spark.createDataFrame(rows, EVENT).withColumn("_parts", F.lit(1)).withColumn("loss", F.lit(2))
    got = {(r.conv_id, r.turn): (r.role, r.text) for r in chat.reconstruct(df).collect()}
    assert got == {(None, None): ("user", "x"), (1, 0): ("", "firstsecondsecond"), (2, 5): ("user", "only")}
    assert chat.format_conversations(df.limit(0)).count() == 0
    turns = spark.createDataFrame([(1, 0, "user", "a"), (1, 0, "user", "a"), (1, None, None, None)], "conv_id long, turn long, role string, text string")
    back = chat.read_back(chat.format_conversations(chat.messages_as_events(turns))).first()
    assert [(t.role, t.text) for t in back.turns] == [("", ""), ("user", "a"), ("user", "a")]


# ---------------------------------------------------------------- vector search

NAN, INF = float("nan"), float("inf")


def vectors(seed=3, n=400, dims=6):
    rng = random.Random(seed)
    rows = [(i, [rng.gauss(0, 1) if rng.random() < 0.7 else 0.25 for _ in range(dims)]) for i in range(n)]
    rows += [(n + i, rows[7][1]) for i in range(60)]  # a hot vector
    rows += [(5, [9.0] * dims), (5, [9.0] * dims), (20, [-9.0] * dims)]  # repeated ids
    odd = [(900, None), (901, []), (902, [NAN] * dims), (903, [INF] + [0.0] * (dims - 1)), (904, [None] + [1.0] * (dims - 1)), (None, [1.0] * dims)]
    odd += [(1000, [1.0] * (dims + 1)), (1001, [2.0] * (dims + 1)), (2000, [0.0] * dims)]
    return rows, odd


def usable(v):
    return v and all(x is not None and math.isfinite(x) for x in v)


def brute_search(queries, rows, k, score, zero=True):
    good = [(i, v) for i, v in rows if i is not None and usable(v) and (zero or any(v))]
    out, seen = [], set()
    for q, v in queries:
        if q is None or not usable(v) or not (zero or any(v)):
            continue
        found = sorted((-score(v, w), i) for i, w in good if i != q and len(w) == len(v))[:k]
        out += [(q, r, i, -s) for r, (s, i) in enumerate(found, 1)]
        seen.add(q)
    return out


def frame(spark, rows):
    df = spark.createDataFrame(rows, "id long, vec array<double>")
    return df.withColumn("score", F.lit("x")).withColumn("dim", F.lit("y")).repartition(3)


def whole(a, b):
    return sum(math.floor(1024 * x) * math.floor(1024 * y) for x, y in zip(a, b, strict=True))


def product(a, b):
    out = 0.0
    for x, y in zip(a, b, strict=True):
        out += x * y
    return out


@pytest.mark.parametrize("op", ["topk", "ann"])
def test_search_equals_all_pairs(spark, op):
    rows, odd = vectors()
    every = rows + odd
    # A repeated id as a query stands for several vectors: queries are unique here.
    queries = [r for r in every if r[0] is not None and r[0] % 10 == 0 and r[0] != 20] + [odd[5]]
    run, score, zero = (topk.search, whole, True) if op == "topk" else (ann.neighbours, product, False)
    small = {"part_rows": 50, "query_rows": 16} if op == "topk" else {"query_block": 16, "vector_block": 64}
    want = brute_search(queries, every, 7, score, zero)
    got = run(frame(spark, queries), frame(spark, every), 7, **small)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    # Copies of one id tie with themselves; ids and scores are all that is told.
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


@pytest.mark.parametrize("op", ["topk", "ann"])
def test_search_of_little(spark, op):
    run = topk.search if op == "topk" else ann.neighbours
    one = frame(spark, [(1, [1.0, 2.0])])
    none = one.limit(0)
    assert run(one, one).count() == run(none, one).count() == run(one, none).count() == run(none, none).count() == 0
    two = frame(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, [1.0])])
    assert [(r.query_id, r.vec_id) for r in run(two, two).orderBy("query_id").collect()] == [(1, 2), (2, 1)]
    odd = frame(spark, [(1, None), (2, [NAN])])
    assert run(odd, odd).count() == 0
