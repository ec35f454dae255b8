"""In-place detection, held-out accuracy, groups, odd texts."""

import hashlib

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF01
from tuneframe.operators import langid as LI
from tuneframe.operators import normalize as N
from tuneframe.operators import profile as P
from tuneframe.plans import fixtures as X
from tuneframe.plans import queries as Q


@pytest.fixture(scope="module")
def docs(spark):
    return X.table(spark, SF01, "documents").select(F.col("doc_id").alias("idx"), "text", "lang", "source")


@pytest.fixture(scope="module")
def model(docs):
    return LI.fit_langid(docs, fit_rows=50)


def test_held_out_accuracy(docs, model):
    """Texts that the model was not fitted on are labelled right nearly always."""
    by_lang = {}
    for r in docs.filter("text IS NOT NULL AND lang IS NOT NULL").select("idx", "lang").collect():
        by_lang.setdefault(r.lang, []).append((hashlib.md5(str(r.idx).encode()).hexdigest(), r.idx))
    fitted = {i for rows in by_lang.values() for _, i in sorted(rows)[:50]}
    out = LI.detect_languages(docs.filter(F.length("text") >= 40), model).join(docs.select("idx", "lang"), "idx").collect()
    held = [r for r in out if r.idx not in fitted]
    assert len(held) > 500
    assert sum(r.language == r.lang for r in held) / len(held) > 0.97


def test_detection_shuffles_nothing(docs, model):
    plan = LI.detect_languages(docs, model)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Generate" not in plan
    assert model.weights.shape == (LI.CELLS, len(model.languages))


def test_brute_force_scores(spark, model):
    texts = ["Der schnelle Fuchs", "a" * 7, "x", "", None, "été  \n ÉTÉ", "the " * 50_000]
    df = spark.createDataFrame(list(enumerate(texts)), "idx long, text string")
    got = {r.idx: (r.language, r.score) for r in LI.detect_languages(df, model).collect()}
    for i, t in enumerate(texts):
        s = " " + " ".join((t or "").lower().replace("\n", " ").split(" ")).strip(" ") + " "
        s = " " + __import__("re").sub(r"[\x09-\x0D\x20]+", " ", (t or "").lower()) + " " if t is not None else ""
        total, known = list(map(int, model.prior)), False
        for k in range(len(s) - 2):
            a, b, c = LI.CELL_FACTORS
            row = model.weights[(ord(s[k]) * a + ord(s[k + 1]) * b + ord(s[k + 2]) * c) % LI.CELLS]
            known = known or bool(row.any())
            total = [x + int(y) for x, y in zip(total, row, strict=True)]
        best = max(range(len(total)), key=lambda j: (total[j], -j))
        assert got[i] == ((model.languages[best], total[best]) if known else (None, None))


def test_distribution_by_group_sample_and_top(spark, docs, model):
    whole = LI.language_distribution(docs, model).collect()
    assert sum(r.n for r in whole) == whole[0].sampled
    by = LI.language_distribution(docs, model, by=["source"]).collect()
    assert sum(r.n for r in by) == whole[0].sampled
    for r in by:
        assert r.sampled == sum(x.n for x in by if x.source == r.source)
    few = LI.language_distribution(docs, model, by=["source"], sample=20, top=1).collect()
    assert len(few) == len({r.source for r in few}) and all(r.sampled <= 20 for r in few)
    assert LI.language_distribution(docs.limit(0), model).count() == 0
    short = spark.createDataFrame([(0, "  abc  "), (1, None)], "idx long, text string")
    assert LI.language_distribution(short, model).count() == 0


def test_profile_with_languages(spark, docs, model):
    msgs = N.to_messages(X.documents_as_records(spark, SF01)).join(docs.select("idx", "source"), "idx")
    p = P.profile(msgs, languages=model).first()
    assert p.languages == {r.language: r.n for r in LI.language_distribution(docs, model).collect()}
    by = {r.source: r.languages for r in P.profile(msgs, by=["source"], languages=model).collect()}
    want = {}
    for r in LI.language_distribution(docs, model, by=["source"]).collect():
        want.setdefault(r.source, {})[r.language] = r.n
    assert by == want


def test_too_many_languages(spark):
    df = spark.createDataFrame([(i, "some text here", f"l{i}") for i in range(LI.MAX_LANGUAGES + 1)], "idx long, text string, lang string")
    with pytest.raises(ValueError, match="languages"):
        LI.fit_langid(df)


def test_documents_are_judged_by_all_labelled_texts(spark, tmp_dir, monkeypatch):
    """F4 of round 3: 300 texts of one language and 100 of another; none is left out of the fit."""
    rows = [(i, f"the words of text {i}" if i % 4 else f"die Worte von Text {i}", "de" if i % 4 == 0 else "en") for i in range(400)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_dir}/documents.parquet")
    seen = []
    monkeypatch.setattr(LI, "detect_languages", lambda docs, model: seen.append(model) or docs)
    Q.REGISTRY["langid_documents"](spark, tmp_dir)
    assert seen[0].languages == ("de", "en") and seen[0].prior.tolist() == [-1387, -288]


def test_sample_is_that_of_the_smallest_digests(spark):
    """Keys that repeat or are null are put in order by their texts, as before."""
    rows = [(None if i < 3 else i // 2, f"text {i:03d} " + "abc"[i % 3] * (i % 7), "en") for i in range(60)]
    df = spark.createDataFrame(rows, "idx long, text string, lang string")
    digest = lambda k: "" if k is None else hashlib.md5(str(k).encode()).hexdigest()
    first = sorted(((digest(k), t) for k, t, _ in rows))[:10]
    whole = LI.fit_langid(spark.createDataFrame([(i, t, "en") for i, (_, t) in enumerate(first)], "idx long, text string, lang string"), fit_rows=None)
    assert (LI.fit_langid(df, fit_rows=10).weights == whole.weights).all()


def test_texts_reach_python_workers_some_megabytes_at_a_time(spark, docs):
    from collections.abc import Iterator

    import pandas as pd

    def lengths(batches):
        for s in batches:
            yield s.map(lambda t: len(s))

    lengths.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    big = spark.range(0, 48, 1, 1).select(F.repeat(F.lit("x"), 1 << 20).alias("t"))
    assert big.select(F.max(F.pandas_udf(lengths, "long")("t"))).first()[0] <= 8


def test_distribution_asks_the_detector_once(spark, docs, model):
    """F7 of round 3: texts were labelled twice, once for the counts and once for their total."""
    for by in (None, ["source"]):
        out = LI.language_distribution(docs, model, by=by)
        out.collect()
        assert out._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1


def test_cells_of_the_largest_code_points(spark):
    text = "\U0010ffff\U0010fffe�\U0001f600 aé" * 7
    a, b, c = LI.CELL_FACTORS
    want = [(ord(x) * a + ord(y) * b + ord(z) * c) % LI.CELLS for x, y, z in zip(text, text[1:], text[2:])]
    assert [int(x) for at in LI.cells(text) for x in at] == want
