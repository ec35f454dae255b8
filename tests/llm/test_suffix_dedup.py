"""Suffix-array dedup against brute force."""

import hashlib
import os
import random
import uuid

import pytest

from tests.conftest import SF001
from tuneframe.llm import suffix_dedup as S
from tuneframe.llm.common import table
from tuneframe.llm.queries import op10_suffix_dedup


def brute_suffixes(strings, cap):
    order = sorted(((s[i:], k, i) for k, s in enumerate(strings) for i in range(len(s) + 1)), key=lambda x: (x[0], x[1]))
    out, before = [], None
    for suffix, k, i in order:
        n = 0
        if before is not None:
            while n < min(len(before), len(suffix)) and before[n] == suffix[n]:
                n += 1
        out.append((k, i, min(n, cap)))
        before = suffix
    return out


def test_construction_equals_sorted_suffixes():
    rng = random.Random(7)
    for _ in range(120):
        strings = [bytes(rng.choice(b"ab\x00\xff") for _ in range(rng.randrange(1, 12))) for _ in range(rng.randrange(1, 8))]
        owner, at, lcp = S.common_prefixes(strings, 6)
        assert list(zip(owner.tolist(), at.tolist(), lcp.tolist())) == brute_suffixes(strings, 6)


def brute(rows, length):
    """``rows`` in order: (n_bytes, n_removed, n_spans, digest)."""
    seen, out = set(), []
    for _, text in rows:
        raw = (text or "").encode()
        gone = [False] * len(raw)
        for i in range(len(raw) - length + 1):
            s = raw[i : i + length]
            if s in seen:
                gone[i : i + length] = [True] * length
            seen.add(s)
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        out.append((len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def ours(df, **kw):
    return [(r["id"], r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(bytes(r["kept"])).hexdigest())
            for r in S.dedup_substrings(df, **kw).collect()]


def test_edited_copies_equal_brute_force(spark):
    rng = random.Random(11)
    passage = "".join(rng.choice("abcde ") for _ in range(60))
    base = ["".join(rng.choice("abcde fé") for _ in range(rng.randrange(10, 300))) for _ in range(6)]
    rows = []
    for i in range(80):
        t = list(rng.choice(base))
        for _ in range(rng.randrange(0, 4)):
            if t:
                t[rng.randrange(len(t))] = rng.choice("xyz")
        k = rng.randrange(len(t) + 1)
        rows.append((i, "".join(t[:k]) + (passage if rng.random() < 0.5 else "") + "".join(t[k:])))
    rows += [(80, None), (81, ""), (82, "a" * 500), (83, "ab" * 300), (84, "a" * 99), (85, "é" * 400), (86, base[0] * 3)]
    df = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, bytes string").repartition(5)
    for length, anchor in ((20, 8), (40, 32)):
        got = sorted(ours(df, length=length, anchor=anchor, ))
        assert got == [(i, *b) for (i, _), b in zip(rows, brute(rows, length))]


def hot_edges(rng, n):
    """Documents around one passage: at each of its edges very many different segments share an anchor."""
    passage = "".join(rng.choice("abcdefgh ") for _ in range(90))
    made = lambda k: "".join(rng.choice("abcdefgh ") for _ in range(k))
    rows = []
    for i in range(n):
        t = made(rng.randrange(20, 60)) + passage + made(rng.randrange(20, 60))
        rows.append((i, t if rng.random() < 0.8 else t + passage[: rng.randrange(20, 90)] + t[:50]))
    return rows


def test_anchors_with_many_segments_equal_brute_force(spark):
    rows = hot_edges(random.Random(5), 150)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for length, anchor, most in ((20, 8, 1), (20, 8, 16), (40, 16, 8), (40, 32, 64)):
        got = sorted(ours(df, length=length, anchor=anchor, collection_rows=most))
        assert got == [(i, *b) for (i, _), b in zip(rows, brute(rows, length))], (length, anchor, most)


def test_no_collection_outgrows_its_bound(spark, tmp_dir, monkeypatch):
    """Documents around one passage: however many share an anchor and a side, no task gets them as one group."""
    made = S._collection

    def noted(length):
        run = made(length)

        def counted(pdf):
            with open(f"{tmp_dir}/{uuid.uuid4().hex}", "w") as f:
                f.write(str(len(pdf)))
            return run(pdf)
        return counted

    monkeypatch.setattr(S, "_collection", noted)
    rows = hot_edges(random.Random(6), 300)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(ours(df, length=40, anchor=16, collection_rows=20))
    assert got == [(i, *b) for (i, _), b in zip(rows, brute(rows, 40))]
    assert max((int(open(f"{tmp_dir}/{x}").read()) for x in os.listdir(tmp_dir)), default=0) <= 4 * 20


def test_query_equals_brute_force(spark):
    rows = sorted((r["doc_id"], r["text"]) for r in table(spark, SF001, "documents").collect())
    got = sorted(map(tuple, op10_suffix_dedup(spark, SF001).collect()))
    assert got == [(i, *b) for (i, _), b in zip(rows, brute(rows, 100))]


def test_shared_and_null_ids_are_ordered_by_text(spark):
    long = "".join(chr(97 + k * k % 26) for k in range(150))
    rows = [(None, "z" + long), (3, long), (3, long), (3, "a" + long), (5, long), (-7, "q" + long)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    rank = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    want = sorted(((i, *b) for (i, _), b in zip(rank, brute(rank, 100))), key=repr)
    assert sorted(ours(df), key=repr) == want


def test_nothing(spark):
    assert S.dedup_substrings(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    one = spark.createDataFrame([(1, "short")], "doc_id long, text string")
    assert ours(one)[0][:4] == (1, 5, 0, 0)


@pytest.mark.parametrize("n", [1, 2, 64, 65, 200])
def test_leftmost_minimum(n):
    import numpy as np

    rng = np.random.default_rng(n)
    h = rng.integers(0, 5, size=300).astype(np.uint64)
    got = S.window_min_first(h, n)
    assert got.tolist() == [i + int(np.argmin(h[i : i + n])) for i in range(300 - n + 1)]


def test_dense_numbers_of_wide_and_skewed_ids(spark):
    low, high = -(2**63), 2**63 - 1
    ids = [None, low, low + 1, high, high - 1, 0, *range(5000), *range(10**15, 10**15 + 300)]
    df = spark.createDataFrame([(i,) for i in ids], "id long").distinct()
    want = {i: k for k, i in enumerate(sorted(set(ids), key=lambda i: (i is not None, i or 0)), 1)}
    for share in (50, 10**6):
        assert {r["id"]: r["rank"] for r in S._dense(df, share).collect()} == want
    assert S._dense(df.limit(0)).count() == 0
    one = spark.createDataFrame([(None,)], "id long")
    assert [tuple(r) for r in S._dense(one).collect()] == [(None, 1)]


def test_a_round_sorts_only_what_is_new(monkeypatch):
    whole = []
    kept = S.last_first
    monkeypatch.setattr(S, "last_first", lambda symbol: whole.append(len(symbol)) or kept(symbol))
    strings = [b"banana bandana", b"", b"banana", bytes(range(256)), b"aaaaaaa"]
    owner, at, lcp = S.common_prefixes(strings, 5)
    # The whole transform is sorted once, to read off whose suffixes they are; not in every round.
    assert whole == [sum(map(len, strings)) + len(strings)]
    found = [strings[k][i:] for k, i in zip(owner, at, strict=True)]
    order = sorted((s[i:], k) for k, s in enumerate(strings) for i in range(len(s) + 1))
    assert list(zip(found, owner.tolist(), strict=True)) == order
    same = [next((n for n, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b))) for a, b in zip(found, found[1:])]
    assert lcp[1:].tolist() == [min(5, n) for n in same]
