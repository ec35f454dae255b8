"""Toxicity and the n-gram join against brute force, and odd rows."""

import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF001
from tuneframe.llm import ngram_join as J
from tuneframe.llm import toxicity as T
from tuneframe.llm.bytehash import word_hashes
from tuneframe.llm.common import table
from tuneframe.llm.queries import op4_toxicity, op7_ngram_join

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def brute_chain(score, move, start):
    n = len(score)
    total, mark, pair = 0.0, np.zeros(n), np.zeros((2, 2, max(0, n - 1)))
    for s in itertools.product((0, 1), repeat=n):
        w = start[s[0]] + sum(score[t] * s[t] for t in range(n)) + sum(move[s[t - 1]][s[t]] for t in range(1, n))
        w = math.exp(w)
        total += w
        mark += w * np.array(s)
        for t in range(1, n):
            pair[s[t - 1], s[t], t - 1] += w
    return mark / total, pair / total


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(0)
    old, T.STRIP = T.STRIP, 3
    try:
        for _ in range(20):
            lengths = rng.integers(1, 7, size=4)
            score, move, start = rng.normal(size=lengths.sum()) * 3, rng.normal(size=(2, 2)), rng.normal(size=2)
            first = np.zeros(lengths.sum(), bool)
            first[np.cumsum([0, *lengths[:-1]])] = True
            p, both = T.marginals(score, first, move, start)
            at = 0
            for n in lengths:
                mark, pair = brute_chain(score[at : at + n], move, start)
                assert p[at : at + n] == pytest.approx(mark)
                assert both[:, :, at : at + n - 1] == pytest.approx(pair)
                at += n
            assert T.token_probability(score, first, move, start) == pytest.approx(p)
    finally:
        T.STRIP = old


def test_fit_finds_toxic_words_and_spans(spark):
    rng = random.Random(4)
    plain = ["lorem", "ipsum", "dolor", "amet", "velit", "sed", "quis", "Nulla", "über"]
    rows = []
    for i in range(300):
        words = [rng.choice(plain) for _ in range(rng.randrange(20, 60))]
        if i % 5 == 0:
            for _ in range(3):
                words[rng.randrange(len(words))] = rng.choice(["Vilebad", "vilebadly", "grubby"])
        rows.append((i, " ".join(words) + ".", int(i % 5 == 0)))
    model = T.fit([(t, y, 1.0) for i, t, y in rows if i % 4])
    odd = [(1000, None), (1001, ""), (1002, "vilebads lorem İ Vilebad grubby"), (1002, "x"), (None, "\x00 \n"), (1003, "lorem " * 20000)]
    df = spark.createDataFrame([(i, t, "c") for i, t, _ in rows] + [(i, t, "c") for i, t in odd], "doc_id long, text string, score string")
    got = [r for r in T.tag(df, model, carry=["score"]).collect()]
    assert len(got) == len(rows) + len(odd) and {r["carry_0"] for r in got} == {"c"}
    scores = {r["id"]: r["score"] for r in got if r["id"] is not None and r["id"] < 1000}
    assert all((scores[i] >= 0.5) == bool(y) for i, _, y in rows)
    spans = {r["id"]: [(s["start"], s["end"]) for s in r["spans"]] for r in got}
    for i, t, y in rows:
        assert [t[a:b].lower() in ("vilebad", "vilebadly", "grubby") or " " in t[a:b] for a, b in spans[i]] == [True] * len(spans[i])
        assert bool(spans[i]) == bool(y)
    assert spans[1000] == spans[1001] == []
    assert T.tag(df.limit(0), model).count() == 0


def test_spans_are_places_in_the_text_as_it_is():
    p = np.array([0.0, 0, 0, 0.9, 0.9, 0])
    text = "İstanbul is nice hate stuff bad"
    (span,) = T.offsets(text, p)
    assert text[span["start"] : span["end"]] == "hate stuff"
    assert len(T.tokens(text)) == len(p) and T.tokens("ẞ ΟΔΟΣ É") == ["ß", "οδος", "é"] and T.tokens(None) == []
    assert T.offsets("a b", np.zeros(2)) == []


def test_query_scores_equal_enumeration(spark):
    """op4's operator on short texts: scores and spans from all labellings of each text."""
    rows = [("good vile day", 1, 1.0), ("vile vile", 1, 1.0), ("good day", 0, 1.0), ("day after day", 0, 1.0)] * 12
    model = T.fit(rows)
    texts = ["vile day", "good vile vile day", "day", "", None, "Vile good 12 day-vile"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in T.tag(df, model).collect():
        words = T.tokens(texts[r["id"]])
        own = np.zeros(0)
        if words:
            own = brute_chain([model.token(w) for w in words], model.move, model.start)[0]
        assert r["score"] == pytest.approx(model.score(own), abs=1e-9)
        hot = [k for k, x in enumerate(own) if x > 0.5]
        assert sum(len(T.TOKEN.findall((texts[r["id"]] or "")[s["start"] : s["end"]])) for s in r["spans"]) == len(hot)


def test_fit_without_a_class():
    assert T.fit([]).score(np.zeros(0)) == pytest.approx(0.5)
    assert T.fit([("a b", 0, 1.0)] * 9).score(np.zeros(3)) < 0.1


def test_held_out_accuracy(spark):
    got = {r["doc_id"]: r for r in op4_toxicity(spark, "/root/testdata/sf0.01").collect()}
    labels = {r["doc_id"]: r["toxic"] for r in table(spark, "/root/testdata/sf0.01", "labels").collect()}
    assert len(got) == table(spark, "/root/testdata/sf0.01", "documents").count()
    held = [(got[i]["predicted"], y) for i, y in labels.items() if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i in got)
    assert sum(p == y for p, y in held) / len(held) > 0.95
    assert all(0 <= r["score"] <= 1 for r in got.values())


# ---------------------------------------------------------------- join


def shingle_set(text, n):
    words = WORDS.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1)))


def brute_classes(rows, n, percent):
    sets = [shingle_set(t, n) for _, t in rows]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                up[find(i)] = find(j)
    least = {}
    for k, (i, _) in enumerate(rows):
        r = find(k)
        if i is not None:
            least[r] = min(i, least.get(r, i))
    return sorted(((i, len(sets[k]), least.get(find(k))) for k, (i, _) in enumerate(rows)), key=repr)


def ours(df, **kw):
    return sorted(((r["id"], r["n_shingles"], r["component"]) for r in J.classes(df, **kw).collect()), key=repr)


def corpus(seed, families=6, per=14, words=40):
    """Families of edited copies around the threshold, over a shared vocabulary with very frequent passages."""
    rng = random.Random(seed)
    vocab = [f"w{k}" for k in range(400)]
    passage = [rng.choice(vocab) for _ in range(12)]
    rows, i = [], 0
    for _ in range(families):
        base = [rng.choice(vocab) for _ in range(rng.randrange(8, words))] + passage
        for _ in range(per):
            w = list(base)
            for _ in range(rng.randrange(0, 4)):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            rows.append((i, " ".join(w)))
            i += 1
    return rows


@pytest.mark.parametrize("share,block", [(1.0, 1 << 24), (0.0, 1 << 24), (0.05, 2000)])
def test_classes_equal_brute_force(spark, share, block):
    rows = corpus(int(share * 10) + 1) + [(900, None), (901, ""), (902, " \t\n"), (903, "A b"), (904, "a B"), (905, "a b c"), (906, "a b c d e f g"),
                          (907, "a b c d e f g"), (907, "a b c d e f g"), (None, "a b c d e f g"), (None, "lone words in a row here"), (908, "long " * 5000)]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, node int, component string")
    old = J.SKETCH_BITS
    J.SKETCH_BITS = 14
    try:
        got = ours(df, words=4, percent=85, frequent_share=share, block_bytes=block)
    finally:
        J.SKETCH_BITS = old
    assert got == brute_classes(rows, 4, 85)


def test_signatures_meet_every_link():
    """Any two sets over the threshold share a signature, whatever tokens count as frequent."""
    rng = random.Random(9)
    for _ in range(400):
        n = rng.randrange(4, 60)
        base = rng.sample(range(10_000), n)
        other = base[:]
        for _ in range(rng.randrange(0, max(1, n // 5))):
            kind = rng.random()
            if kind < 0.4 and len(other) > 1:
                other.pop(rng.randrange(len(other)))
            elif kind < 0.7:
                other.append(rng.randrange(10_000, 20_000))
            else:
                other[rng.randrange(len(other))] = rng.randrange(10_000, 20_000)
        a, b = (np.unique(J.scramble(np.array(s, dtype=np.uint64)) >> np.uint64(16)) for s in (base, other))
        both = len(np.intersect1d(a, b))
        if n < 4 or 100 * both < 80 * (len(a) + len(b) - both):
            continue
        level = np.uint64(rng.choice([0, 20, 60, 90, 100]))
        sa, sb = (set(J.signatures(s, np.where(s % np.uint64(100) < level, 200, s % np.uint64(7)), 200, 80).tolist()) for s in (a, b))
        assert sa & sb


def test_query_equals_brute_force(spark):
    rows = [(r["doc_id"], r["text"]) for r in table(spark, SF001, "documents").collect()]
    got = sorted((tuple(r) for r in op7_ngram_join(spark, SF001).collect()), key=repr)
    assert got == brute_classes(rows, 4, 85)


def test_word_hashes_follow_the_words():
    rng = random.Random(2)
    for _ in range(200):
        text = "".join(rng.choice("abAB é\t\n\x0b\x1c ß") for _ in range(rng.randrange(0, 40)))
        words = WORDS.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text))
        got = word_hashes(text.encode()).tolist()
        assert len(got) == len(words)
        pairs = set(zip(words, got))
        assert len(pairs) == len(set(words)) == len(set(got))


def test_join_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert J.classes(empty).count() == 0
    assert J.one_of_each(empty).count() == 0


def test_one_of_each_keeps_the_smallest(spark):
    rows = corpus(3) + [(900, None), (901, ""), (5, "repeated row"), (5, "repeated row")]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, lang string")
    kept = J.one_of_each(df).collect()
    want = {(i, c) for i, _, c in brute_classes(rows, 5, 80) if i == c}
    assert {r["doc_id"] for r in kept} == {i for i, _ in want}
    assert len(kept) == len({(r["doc_id"], r["text"]) for r in kept})


def test_pairs_find_every_link():
    """Two sets of at least the similarity share a signature, for every percent that is taken on; others raise."""
    rng = random.Random(9)
    taken = [p for p in range(1, 101) if J.covered(p)]
    assert set(range(70, 101)) <= set(taken) and min(taken) >= 62
    for percent in taken:
        for _ in range(120):
            n = rng.choice([2, 3, 4, 5, 6, 7, 8, 9, 10, 13, 20, 33, 60])
            base = [rng.getrandbits(48) for _ in range(3 * n)]
            x, y = set(base[:n]), set(base[:n])
            while True:
                drop, add = rng.random() < 0.5, base[n + rng.randrange(2 * n)]
                z = set(y)
                if drop and z:
                    z.discard(rng.choice(sorted(z)))
                else:
                    z.add(add)
                if not z or 100 * len(x & z) < percent * len(x | z):
                    break
                y = z
            if min(len(x), len(y)) * (100 - percent) < percent:
                # Sets this small only link with their equals.
                assert x == y or max(len(x), len(y)) * (100 - percent) >= percent
                if x != y and min(len(x), len(y)) * (100 - percent) < percent:
                    assert 100 * len(x & y) < percent * len(x | y)
                continue
            rank = {t: rng.choice([0, 150, 250, 255]) if percent % 2 else 255 for t in x | y}
            a, b = ([np.array(sorted(s), dtype=np.uint64), np.array([rank[t] for t in sorted(s)])] for s in (x, y))
            assert set(J.signatures(*a, 200, percent).tolist()) & set(J.signatures(*b, 200, percent).tolist()), (percent, n)


@pytest.mark.parametrize("percent", [0, 30, 50, 61, 101])
def test_percents_that_pairs_cannot_answer_raise(spark, percent):
    with pytest.raises(ValueError, match="percent"):
        J.classes(spark.createDataFrame([(1, "a b c")], "doc_id long, text string"), percent=percent)


def test_classes_of_copies_and_near_copies(spark):
    """A third exact copies, a third near copies, small blocks: brute force, and copies are signed once a task."""
    rng = random.Random(2)
    words = [f"w{i}" for i in range(500)]
    base = [rng.choice(words) for _ in range(120)]
    rows = [(i, " ".join(base)) for i in range(120)]
    for i in range(120, 240):
        near = list(base)
        near[rng.randrange(120)] = f"x{i}"
        rows.append((i, " ".join(near)))
    rows += [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 60)))) for i in range(240, 360)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_id", F.lit(1)).withColumn("node", F.lit(2))
    got = J.classes(df, words=4, percent=85, block_bytes=20_000).collect()
    assert sorted((r["id"], r["n_shingles"], r["component"]) for r in got) == sorted(brute_classes(rows, 4, 85))
    kept = J.one_of_each(df, words=4, percent=85)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({r["component"] for r in got})
