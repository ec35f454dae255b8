"""U2 + T9: language detection in place, and the language report.

The built-in detector is a character-trigram naive Bayes model over hashed
cells, so its size is fixed: ``CELLS`` rows and a column per language.

* fit: the labelled texts are counted where they lie, all of them or
  ``fit_rows`` per language, by the MD5 of the key; tasks send one number per
  cell and language;
* apply: every text is scored where it lies against the table, which travels
  once with the function. No row is made per trigram and nothing shuffles.

Weights are integers (1000 times the logarithm, rounded down), so scores are
sums of integers: equal on every engine, whatever the order of the terms.
Whole texts are used; nothing is truncated. Another detector is plugged in
through :func:`detector_udf` and :func:`detect_with_udf`.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from tuneframe.functions.text import py_strip
from tuneframe.operators.ordered import top_k_per_group

CELLS = 1 << 18
#: Code points of a trigram are weighed by these and added up modulo ``CELLS``.
CELL_FACTORS = (92_821, 486_187, 1)
#: Labelled texts per language that the model is fitted on.
FIT_ROWS = 100
MAX_LANGUAGES = 64
SCALE = 1000
# Texts are taken in pieces of this many code points: memory stays bounded for very long ones.
PIECE = 1 << 16
# Fixed value: texts shorter than this (after strip) are not labelled.
MIN_CHARS = 8


def normal_text(text: Column) -> Column:
    """Lower-cased, white space collapsed, padded by a space on both sides."""
    return F.concat(F.lit(" "), F.regexp_replace(F.lower(text), r"[\x09-\x0D\x20]+", " "), F.lit(" "))


def cells(text: str) -> Iterator[np.ndarray]:
    """The cells of a text's overlapping trigrams, piece by piece."""
    a, b, c = CELL_FACTORS
    for at in range(0, max(1, len(text) - 2), PIECE):
        piece = text[at : at + PIECE + 2]
        code = np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), dtype="<u4")
        if len(code) > 2:
            # 32-bit products wrap around at a multiple of CELLS, a power of two.
            yield ((code[:-2] * np.uint32(a) + code[1:-1] * np.uint32(b) + code[2:] * np.uint32(c)) & np.uint32(CELLS - 1)).astype(np.intp)


@dataclass(frozen=True)
class LanguageModel:
    """``weights[cell, language]`` (zero where no language has the cell) and a prior per language."""

    languages: tuple[str, ...]
    weights: np.ndarray
    prior: np.ndarray

    def score(self, text: str | None) -> tuple[str | None, int | None]:
        """The likeliest language and its score; the first by name on ties, none without a known trigram."""
        total, known = self.prior.copy(), False
        for at in cells(text or ""):
            # A row per language: the table lies column by column, and a row's sum runs along memory.
            rows = self.weights.T.take(at, axis=1)
            part = rows.sum(axis=1, dtype=np.int64)
            known = known or bool(part.any()) or bool(rows.any())
            total += part
        if not known:
            return None, None
        best = int(total.argmax())
        return self.languages[best], int(total[best])

    def column(self, text: Column) -> Column:
        """``struct(language, score)`` of a text column."""
        model = self

        def detect(batches):
            for s in batches:
                yield pd.DataFrame([model.score(t) for t in s], columns=["language", "score"]).astype({"score": "Int64"})

        detect.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
        return pandas_udf(detect, "language string, score long")(normal_text(text))


def fit_langid(labelled: DataFrame, key: str = "idx", text: str = "text", lang: str = "lang", fit_rows: int | None = FIT_ROWS) -> LanguageModel:
    """Fit on at most ``fit_rows`` texts of each language, those with the smallest MD5 of ``key``; on all with None.

    A cell weighs ``floor(1000 * (ln(c + 1) - ln(n + v)))`` for a language
    that has ``c`` trigrams there and ``n`` in all, with ``v`` the cells that
    any language has; the prior is ``floor(1000 * ln(share of the texts))``.
    Null labels and texts take no part.
    """
    lab = labelled.filter(F.col(lang).isNotNull() & F.col(text).isNotNull())
    lab = lab.select(F.col(lang).alias("lang"), F.md5(F.col(key).cast("string").cast("binary")).alias("_by"), F.col(text).alias("text"))
    if fit_rows is not None:
        # The keys alone tell how far the sample goes; only the texts up to there are normalised and put in order.
        upto = top_k_per_group(lab.select("lang", "_by"), ["lang"], [F.col("_by")], int(fit_rows)).groupBy("lang").agg(F.max("_by").alias("_upto"))
        lab = lab.join(F.broadcast(upto), "lang").filter(F.col("_by").isNull() | (F.col("_by") <= F.col("_upto"))).drop("_upto")
    sample = lab.withColumn("text", normal_text(F.col("text")))
    if fit_rows is not None:
        sample = top_k_per_group(sample, ["lang"], [F.col("_by"), F.col("text")], int(fit_rows))
    sample = sample.select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, np.ndarray] = {}
        docs: dict[str, int] = {}
        for batch in batches:
            for name, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if name not in found:
                    found[name] = np.zeros(CELLS, dtype=np.int64)
                docs[name] = docs.get(name, 0) + 1
                for at in cells(t.as_py()):
                    np.add.at(found[name], at, 1)
        for name, have in found.items():
            used = np.flatnonzero(have)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * (len(used) + 1), pa.string()), pa.array([-1, *used], pa.int32()), pa.array([docs[name], *have[used]], pa.int64())],
                names=["lang", "cell", "n"])

    counts = sample.mapInArrow(count, "lang string, cell int, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n")).toArrow()
    languages = tuple(sorted(set(counts["lang"].to_pylist())))
    if len(languages) > MAX_LANGUAGES:
        raise ValueError(f"{len(languages)} languages: the table holds {MAX_LANGUAGES}")
    have, docs = np.zeros((CELLS, len(languages)), dtype=np.int64), np.zeros(len(languages), dtype=np.int64)
    column = np.array([languages.index(x) for x in counts["lang"].to_pylist()], dtype=np.int64)
    cell, n = counts["cell"].to_numpy(), counts["n"].to_numpy()
    have[cell[cell >= 0], column[cell >= 0]] = n[cell >= 0]
    docs[column[cell < 0]] = n[cell < 0]
    seen = have.any(axis=1)
    weights = np.zeros(have.shape, dtype=np.int16, order="F")
    log = {v: math.log(v + 1) for v in np.unique(have).tolist()}
    for k in range(len(languages)):
        unseen = math.log(int(have[:, k].sum()) + int(seen.sum()))
        floor = {v: math.floor(SCALE * (x - unseen)) for v, x in log.items()}
        weights[seen, k] = [floor[v] for v in have[seen, k].tolist()]
    prior = np.array([math.floor(SCALE * math.log(d / docs.sum())) for d in docs.tolist()], dtype=np.int64)
    return LanguageModel(languages, weights, prior)


def detect_languages(texts: DataFrame, model: LanguageModel, key: str = "idx", text: str = "text", by: list[str] | None = None) -> DataFrame:
    """``(*by, key, language, score)`` of every row; language and score are null without a known trigram."""
    found = texts.select(*(by or []), key, model.column(F.col(text)).alias("_d"))
    return found.select(*(by or []), key, "_d.language", "_d.score")


def detector_udf(make_detector: Callable[[], Callable[[str], str | None]]):
    """U2 plug-in: wrap a detector factory as an Arrow-batched iterator UDF.

    ``make_detector`` runs once per Python worker (not per row); the returned
    function maps one text to its language or None. A null text counts as empty.
    """
    # Annotations are strings in this module, and the UDF's kind is read off them.
    def detect(batches):
        found = make_detector()
        for s in batches:
            yield s.map(lambda t: found(t or "")).astype(object)

    detect.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return pandas_udf(detect, "string")


def detect_with_udf(texts: DataFrame, detector, key: str = "idx", text: str = "text") -> DataFrame:
    """``key, language`` by a plugged-in detector (:func:`detector_udf`)."""
    return texts.select(key, detector(F.col(text)).alias("language"))


def language_distribution(
    records_text: DataFrame,
    model: LanguageModel,
    key: str = "idx",
    text: str = "text",
    by: list[str] | None = None,
    sample: int | None = None,
    top: int | None = None,
) -> DataFrame:
    """Over all texts with at least 8 characters after strip: languages with
    counts and the number of texts labelled. ``(*by, language, n, sampled)``;
    none -> no rows. ``sample`` reads the first texts of each group in file
    order and ``top`` keeps its most frequent languages, where that is asked
    for.
    """
    by = by or []
    head = records_text.select(*by, key, F.col(text).alias("_t"))
    if sample is not None:
        head = top_k_per_group(head, by, [F.col(key)], int(sample)) if by else head.orderBy(key).limit(int(sample))
    # Generated rows: the filter stays behind them, so each text is made and stripped once and not again for the test.
    head = head.select(*by, key, F.inline(F.array(F.struct(py_strip(F.col("_t")).alias("_t"))))).filter(F.char_length("_t") >= MIN_CHARS)
    # Counting leaves out what has no language; a filter ahead of it would ask the detector twice.
    counts = detect_languages(head, model, key, "_t", by).groupBy(*by, "language").agg(F.count("language").alias("n")).filter("n > 0")
    # A row per group and language: the total comes from these rows, not from the texts again. A group has a name.
    for b in by:
        counts = counts.filter(F.col(b).isNotNull())
    out = counts.withColumn("sampled", F.sum("n").over(Window.partitionBy(*by)))
    if top is not None:
        order = [F.col("n").desc(), F.col("language")]
        out = out.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("_r") <= int(top))
    return out.select(*by, "language", F.col("n").cast("bigint").alias("n"), F.col("sampled").cast("bigint").alias("sampled"))


def language_map(records: DataFrame, model: LanguageModel, by: list[str] | None = None, key: str = "idx", text: str = "text") -> DataFrame:
    """T9 as T10 shows it: ``(*by, languages map<string,long>)``, one row per group with a labelled text."""
    d = language_distribution(records, model, key, text, by)
    return d.groupBy(*(by or [])).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("language", "n")))).alias("languages"))
