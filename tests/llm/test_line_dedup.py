"""Line dedup of derived frames and in several batches against brute force."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tuneframe.llm import line_dedup as L

LINES = [f"line {k:02d} " + "x" * 40 for k in range(30)]


def made(seed, ids):
    rng = random.Random(seed)
    return [(i, "\n".join(rng.sample(LINES, rng.randrange(0, 6)) + [f"only {i} " + "y" * 40])) for i in ids]


def brute(rows, least=5):
    holders = defaultdict(list)
    for i, t in rows:
        for line in set(t.split("\n")):
            holders[line].append(i)
    return {i: "\n".join(x for x in t.split("\n") if len(x) < 40 or len(holders[x]) < least or max(holders[x]) == i) for i, t in rows}


def ours(df, **kw):
    return {r["id"]: r["text"] for r in L.dedup_lines(df, **kw).collect()}


@pytest.fixture(scope="module")
def many_files(spark):
    import tempfile

    path = tempfile.mkdtemp(prefix="tuneframe-test-", dir="/tmp") + "/docs"
    spark.createDataFrame(made(1, range(60)), "doc_id long, text string").repartition(6).write.parquet(path)
    assert len(spark.read.parquet(path).inputFiles()) > 1
    return spark.read.parquet(path)


def test_derived_frames_over_many_files_equal_brute_force(spark, many_files):
    rows, more = made(1, range(60)), made(2, range(100, 120))
    assert ours(many_files) == brute(rows)
    assert ours(many_files.filter("doc_id % 3 = 0")) == brute([r for r in rows if r[0] % 3 == 0])
    assert ours(many_files.union(spark.createDataFrame(more, "doc_id long, text string"))) == brute(rows + more)
    assert ours(many_files.select(F.col("text").alias("words"), F.col("doc_id").alias("key")), id_col="key", text_col="words") == brute(rows)


def test_several_batches_tell_new_lines_from_known_ones(spark):
    parts = [made(10 + k, range(20 * k, 20 * k + 20)) for k in range(5)] + [[(100, LINES[0]), (None, LINES[0])]]
    frames = [spark.createDataFrame(p, "doc_id long, text string") for p in parts]
    store, before, total, newest = L.LineRuns(spark, fanout=2), set(), Counter(), {}
    for part, frame in zip(parts, frames):
        held = Counter(x for _, t in part for x in set(t.split("\n")))
        new = store.add(frame).collect()
        assert sorted(r["holders"] for r in new) == sorted(n for x, n in held.items() if x not in before)
        before |= set(held)
        total += held
        newest |= {x: max([i for i, t in part if i is not None and x in t.split("\n")] + [newest.get(x, -1)]) for x in held}
        # Every line is in one run.
        keys = [(r["h1"], r["h2"]) for r in store.runs().collect()]
        assert len(keys) == len(set(keys)) == len(before)
    assert len(store.levels) > 2 and store.made > len(parts)
    often = sorted(r["newest"] for r in store.frequent(5).collect())
    assert often == sorted(newest[x] for x, n in total.items() if n >= 5)
    rows = [r for p in parts for r in p if r[0] is not None]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert ours(df) == ours(df, batch_count=7, fanout=3) == brute(rows)


def test_a_table_of_one_file_goes_through_several_runs(spark, monkeypatch):
    seen, add = [], L.LineRuns.add

    def noted(self, docs, *cols):
        new = add(self, docs, *cols)
        seen.append((self.made, new.count()))
        return new

    monkeypatch.setattr(L.LineRuns, "add", noted)
    rows = made(3, range(40))
    assert ours(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)) == brute(rows)
    assert len(seen) == 4 and seen[-1][0] > 4
    assert sum(n for _, n in seen) == len({x for _, t in rows for x in t.split("\n")})


def test_clashing_names_and_odd_texts(spark):
    line = "this line is long enough to be counted as one of its kind"
    rows = [(i, t) for i, t in enumerate([line, "a\n" + line, line.upper() + "\nb", "  " + line + "\r", line + "\n" + line, None, "", "\n\n",
                                          "x" * 100_000 + "\n" + line])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for c in ("n_lines", "n_dropped", "N_Dropped_", "id", "row", "gone", "h1", "k", "t", "pos", "a.b"):
        df = df.withColumn(c, F.lit("mine"))
    out = L.dedup_lines(df, keep_columns=True)
    assert out.columns == df.columns + ["n_lines_", "n_dropped__"]
    got = {r["doc_id"]: r for r in out.collect()}
    assert {got[0][c] for c in df.columns[2:]} == {"mine"}
    assert [got[i]["text"] for i in range(8)] == ["", "a", "b", "", "", "", "", "\n\n"]
    assert got[8]["text"] == rows[8][1] and got[4]["n_dropped__"] == 2 and got[5]["n_lines_"] == 1
    assert L.dedup_lines(df.limit(0), keep_columns=True).count() == 0
