"""Fold-free validation equals the folded path, including a huge conversation."""

import random

from tests.conftest import SF01
from tuneframe.operators import normalize as N
from tuneframe.operators import validate as V
from tuneframe.operators.turns import flag_turns
from tuneframe.plans import fixtures as X

CATS = V.CATEGORIES


def as_map(df):
    return {r.idx: tuple(bool(r[c]) for c in CATS) for r in df.collect()}


def test_turn_flags_equal_fold_flags(spark):
    turns = X.dirty_conversations(spark, SF01)
    assert as_map(flag_turns(turns, block=2)) == as_map(V.flag_records(N.fold_turns(turns)))


def test_hot_conversation(spark):
    rnd = random.Random(2)
    rows = []
    for c in range(40):
        n = 3000 if c == 0 else rnd.randint(1, 6)
        for t in range(n):
            role = ["user", "assistant"][t % 2] if not (c % 5 == 1 and t == 2) else "user"
            rows.append((c, t * 3, role, f"text {c % 7} {t}"))
    rows += [(1000, t, r, x) for (c, t, r, x) in rows if c == 0]  # exact copy of the hot one
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = as_map(flag_turns(turns, block=128))
    assert got == as_map(V.flag_records(N.fold_turns(turns)))
    assert got[1000][CATS.index("duplicate_samples")] is True
