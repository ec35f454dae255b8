"""Vector codes, ranked lexical search and URL filters against brute force, and odd rows."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF001
from tuneframe.llm import lexical, url_filter, vector_codes
from tuneframe.llm.common import table
from tuneframe.llm.queries import op11_vector_codes, op12_lexical_search, op13_url_filter

# ---------------------------------------------------------------- vector codes


def brute_nearest(x, book):
    d = ((x[:, None, :] - book[None, :, :]) ** 2).sum(2)
    return d.argmin(1), d.min(1)


def brute_codes(rows, parts=4, entries=256, rounds=4):
    """``rows``: (id, vector) of one length; the contract word by word."""
    x = np.floor(1024 * np.array([v for _, v in rows], dtype=np.float64)).astype(np.int64)
    first = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0], rows[i][1]))[:entries]
    cut = [(p[0], p[-1] + 1) for p in np.array_split(np.arange(x.shape[1]), parts)]
    books = [x[first, a:b].copy() for a, b in cut]
    for _ in range(rounds):
        for p, (a, b) in enumerate(cut):
            code, _ = brute_nearest(x[:, a:b], books[p])
            for e in range(len(books[p])):
                mine = x[code == e, a:b]
                if len(mine):
                    books[p][e] = mine.sum(0) // len(mine)
    found = [brute_nearest(x[:, a:b], books[p]) for p, (a, b) in enumerate(cut)]
    codes = ["".join(f"{int(c[i]):02x}" for c, _ in found) for i in range(len(rows))]
    return codes, sum(d for _, d in found), books


def test_slices_find_the_nearest_entry():
    rng = np.random.default_rng(1)
    for n, dims, spread in ((1, 3, 5), (7, 2, 3), (64, 4, 9), (65, 1, 40), (256, 16, 300), (200, 5, 2)):
        book = rng.integers(-spread, spread + 1, size=(n, dims))
        x = rng.integers(-2 * spread, 2 * spread + 1, size=(150, dims))
        x[:20] *= 1000
        code, d = vector_codes.SliceIndex(book).nearest(x)
        want, far = brute_nearest(x, book)
        assert (code == want).all() and (d == far).all()
    none = vector_codes.SliceIndex(book).nearest(x[:0])
    assert len(none[0]) == len(none[1]) == 0


def test_vector_codes_of_the_table(spark):
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in table(spark, SF001, "embeddings").collect()]
    codes, error, books = brute_codes([(i, v) for i, v, _ in rows])
    digest = hashlib.sha256(",".join(str(v) for b in books for v in b.ravel().tolist()).encode()).hexdigest()
    by_label = Counter()
    for (_, _, label), e in zip(rows, error.tolist(), strict=True):
        by_label[label] += e
    want = {i: (c, e, by_label[label], digest) for (i, _, label), c, e in zip(rows, codes, error.tolist(), strict=True)}
    got = op11_vector_codes(spark, SF001).collect()
    assert len(got) == len(rows)
    assert {r["vec_id"]: (r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in got} == want


def test_vector_codes_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = [(i % 40, [float((i * k) % 11) / 7 - 1 for k in range(1, 7)], i % 3 or None) for i in range(90)]
    good += [(None, [0.5] * 6, None), (1, [0.25] * 6, 1)]
    odd = [(200, None, 1), (201, [], 1), (202, [nan] * 6, 1), (203, [1.0, inf] + [0.0] * 4, 1),
           (204, [1.0, None] + [0.0] * 4, 1), (205, [1.0] * 5, 1)]
    df = spark.createDataFrame(good + odd, "vec_id long, embedding array<double>, label int")
    df = df.withColumn("id", F.lit("x")).withColumn("code", F.lit(1)).withColumn("carry_0", F.lit(2)).withColumn("_group", F.lit(3))
    out, books = vector_codes.compress(df, entries=16, id_col="vec_id", vec_col="embedding", carry=["label", "id", "_group"])
    codes, error, want = brute_codes([(i, v) for i, v, _ in good], entries=16)
    assert all((a == b).all() for a, b in zip(books, want, strict=True))
    got = out.collect()
    assert sorted((str(r["id"]), r["code"], r["error"]) for r in got) == sorted(
        (str(i), c, e) for (i, _, _), c, e in zip(good, codes, error.tolist(), strict=True))
    assert {r["carry_1"] for r in got} == {"x"}
    sums = vector_codes.with_group_error(out, "carry_0", "total").collect()
    assert len(sums) == len(good)
    for r in sums:
        assert r["total"] == sum(x["error"] for x in got if x["carry_0"] == r["carry_0"])
    huge = spark.createDataFrame([(1, [1e300, 0.0, 0.0, -1e300]), (2, [0.0] * 4)], "id long, vec array<double>")
    out, books = vector_codes.compress(huge)
    assert books[0][0, 0] == vector_codes.LIMIT and {r["error"] for r in out.collect()} == {0}
    out, books = vector_codes.compress(huge.limit(0))
    assert out.count() == 0 and books == [] and out.columns == ["id", "code", "error"]
    with pytest.raises(ValueError):
        vector_codes.compress(huge, entries=300)


# ---------------------------------------------------------------- lexical search

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_rank(docs, items, k=20):
    """``docs``: (id, text) rows; ``items``: (id, text) rows."""
    bags = [Counter(t.translate(LOWER) for t in TERM.findall(text or "")) for _, text in docs]
    n_docs, length = sum(1 for b in bags if b), sum(sum(b.values()) for b in bags)
    df = Counter(t for b in bags for t in b)
    out = []
    for item, text in set(items):
        asked, scored = Counter(t.translate(LOWER) for t in TERM.findall(text or "")), []
        for (doc, _), bag in zip(docs, bags, strict=True):
            n, score = sum(bag.values()), 0
            for t, c in asked.items():
                if bag[t]:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    m = 100 - 25 + (25 * n * n_docs) // length
                    score += c * w * ((10**9 * bag[t]) // (1000 * bag[t] + 12 * m))
            if score > 0:
                scored.append((-score, doc is None, doc or 0, doc))
        out += [(item, r, d[3], -d[0]) for r, d in enumerate(sorted(scored)[:k], 1)]
    return out


def rows_of(df):
    return sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in df.collect()), key=repr)


def test_terms():
    for text in ("", "a", "Él  nacío-EN_1999", "\x00x\x1cY\x85z", "日本 語\tİ", "\u00a0", "é" * 5000 + "B"):
        assert [t.decode() for t in lexical.terms(text)] == [t.translate(LOWER) for t in TERM.findall(text)]
    assert lexical.terms(None) == []


def test_lexical_search_of_the_table(spark):
    docs = [(r["doc_id"], r["text"]) for r in table(spark, SF001, "documents").collect()]
    items = [(r["item_id"], r["text"]) for r in table(spark, SF001, "benchmark").collect()]
    assert rows_of(op12_lexical_search(spark, SF001)) == sorted(brute_rank(docs, items), key=repr)


def odd_search(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(60)] + ["É", "é", "x" * 3000]
    docs = [(i, " ".join(rng.choices(words, [1 / (j + 1) for j in range(63)], k=rng.randint(1, 40)))) for i in range(400)]
    docs += [(i, docs[0][1]) for i in range(1000, 1100)] + [(5, "w59 w59"), (5, "w59"), (None, "w59 w59"), (None, None), (7, ""), (8, "--")]
    docs += [(9, "w1 " * 50_000 + "rare")]
    items = [(i, " ".join(rng.choices(words, k=rng.randint(1, 12)))) for i in range(25)]
    items += [(1, "w59"), (1, "w59"), (2, "w58 w58 w58 w0"), (None, "rare"), (3, None), (4, ""), (6, "nowhere"), (7, docs[0][1]),
              (8, "w0 " * 3000 + "W1")]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("id", F.lit("a")).withColumn("rank", F.lit(0))
    q = spark.createDataFrame(items, "item_id long, text string").withColumn("block", F.lit("a")).withColumn("before", F.lit(0))
    return docs, items, d.repartition(3), q


def test_lexical_search_odd_rows(spark):
    docs, items, d, q = odd_search(spark)
    want = sorted(brute_rank(docs, items), key=repr)
    assert rows_of(lexical.rank(d, q)) == want
    # Many blocks of items, and many small blocks of documents that hand a bar on.
    old = lexical.BLOCK_DOCS, lexical.BLOCK_POSTINGS
    lexical.BLOCK_DOCS, lexical.BLOCK_POSTINGS = 50, 300
    try:
        assert rows_of(lexical.rank(d, q, block_terms=200)) == want
    finally:
        lexical.BLOCK_DOCS, lexical.BLOCK_POSTINGS = old
    assert lexical.rank(d.limit(0), q).count() == lexical.rank(d, q.limit(0)).count() == 0
    assert lexical.rank(d, q.filter("text = 'nowhere'")).count() == 0


def test_nra_reads_no_further_than_it_must():
    """A clear winner is settled before the long list of a common term is read."""
    n = 5000
    term = np.concatenate([np.zeros(n, dtype=np.int64), [1], [2]])
    doc = np.concatenate([np.arange(n), [7], [7]])
    tf = np.concatenate([1 + np.arange(n) % 3, [30], [30]]).astype(np.int64)
    p = lexical.Postings(term, doc, tf, np.full(n, 100, dtype=np.int64))
    reads, read = [], p.read

    def counted(a, b):
        reads.append(int((b - a).sum()))
        return read(a, b)

    p.read = counted
    found, score = lexical.nra(p, np.array([1, 2]), np.array([9000, 9000]), 1, 0)
    assert found.tolist() == [7] and sum(reads) == 2
    found, score = lexical.nra(p, np.array([0, 1]), np.array([3, 9000]), 1, 0)
    assert found.tolist() == [7] and score[0] == 9000 * (30 * 10**9 // (30_000 + 1200)) + 3 * (2 * 10**9 // (2000 + 1200))


# ---------------------------------------------------------------- URL filters

RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def brute_judge(url, rules, default="allow"):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest).group(0)
    path = re.match(r"[^?#]*", rest[len(host):]).group(0)
    host = host.translate(LOWER)
    fits = []
    for h, p, v in rules:
        if not h or p is None or v not in ("allow", "block") or (p and not p.startswith("/")):
            continue
        h = h.translate(LOWER)
        if (host == h or host.endswith("." + h)) and path.startswith(p):
            fits.append((len(h + p), len(h), v == "block", h + p))
    if not fits:
        return host, path, None, default
    best = max(fits)
    return host, path, best[3], "block" if best[2] else "allow"


def test_url_filter_of_the_table(spark):
    rows = {r["page_id"]: r["url"] for r in table(spark, SF001, "pages").collect()}
    got = op13_url_filter(spark, SF001).collect()
    assert len(got) == len(rows)
    assert {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in got} == {
        i: brute_judge(u, RULES) for i, u in rows.items()}
    assert {r["verdict"] for r in got} == {"allow", "block"}


URLS = [None, "", "no scheme", "http://", "http:///x", "HTTP://A.Example.NET/en/x", "http://example.net", "http://example.net/",
        "http://example.net?q=/en/", "http://xexample.net/en/", "http://example.net/en", "http://example.net/en/#/de/", "http://net/",
        "http://b.org/fr/", "http://org/fr/?x", "http://org/FR/", "a://b://example.com/de/", "http://example.com/de/é?",
        "http://É.example.com/de/İ", "http://example.com:80/de/", "http://.net/", "http://net./", "x://net/\nen/", "http://a.b/c/d", "http://a.b/c/",
        "http://" + "a." * 5000 + "net/" + "p/" * 5000, "http://example.com/de/" + "y" * 100_000]


def test_url_filter_odd_rows(spark):
    rules = [*RULES, ("", "/", "block"), ("Example.COM", "/de/é", "allow"), (None, "/", "block"), ("net", None, "block"), ("com", "/", "deny"),
             ("a.b", "/c/", "allow"), ("a.b", "/c/", "block"), ("b", "/c/d", "allow"), ("org", "fr", "block"), ("b.org", "", "block")]
    pages = [(i, u) for i, u in enumerate(URLS)] + [(None, URLS[5]), (3, URLS[5]), (3, URLS[5])]
    df = spark.createDataFrame(pages, "page_id long, url string")
    for c in ("id", "host", "path", "weight", "rule", "prefix", "digest", "salt"):
        df = df.withColumn(c, F.lit("clash"))
    r = spark.createDataFrame(rules, "host string, path string, verdict string")
    want = sorted(((i, u, *brute_judge(u, rules)) for i, u in pages), key=repr)
    for out in (url_filter.judge(df, r), url_filter.judge(df, r.union(r), broadcast_rules=0, salts=3)):
        assert sorted((tuple(x) for x in out.collect()), key=repr) == want
        assert out.columns == ["id", "url", "host", "path", "rule", "verdict"]
    assert url_filter.judge(df.limit(0), r).count() == 0
    none = url_filter.judge(df, r.limit(0), default="block").collect()
    assert len(none) == len(pages) and {(x["rule"], x["verdict"]) for x in none} == {(None, "block")}
    plan = url_filter.judge(df, r)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan
