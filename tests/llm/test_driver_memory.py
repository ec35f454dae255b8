"""What the driver holds while the pipeline's stages run."""

import random
import tracemalloc

from tuneframe.llm import ngram_join, toxicity
from tuneframe.llm.common import components


def _peak(work) -> float:
    tracemalloc.start()
    try:
        work()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_token_counters_reach_the_driver_part_by_part(spark):
    docs = spark.createDataFrame([(k, f"one two three four five six {k}") for k in range(20)], "doc_id long, text string")
    # 2 ** 22 counters of 8 bytes are 34 MB at once, and as much again per step of their ranks.
    assert _peak(lambda: ngram_join.classes(docs).count()) < 30


def test_fit_holds_each_word_once():
    pick = random.Random(3)
    words = ["".join(pick.choices("abcdefghij", k=24)) for _ in range(300)]
    rows = [(" ".join(pick.choices(words, k=1500)) + (" scoundrel" * 20 if y else ""), y, 1.0) for y in (0, 1) for _ in range(100)]
    n = sum(len(t.split()) for t, _, _ in rows)
    found = []
    assert _peak(lambda: found.append(toxicity.fit(rows, rounds=2))) < 250 * n / 1e6
    assert found[0].weight


def test_a_star_needs_no_round_that_confirms(spark):
    edges = spark.createDataFrame([(k, 0) for k in range(1, 9)] + [(20, 21)], "a long, b long")
    got = {r["node"]: r["component"] for r in components(edges, rounds=1).collect()}
    assert got == {**dict.fromkeys(range(9), 0), 20: 20, 21: 20}
