"""Ranked lexical search: NRA over impact-sorted postings.

Documents are tokenised once per block of items and kept as term numbers
and counts of the terms that some item holds. Tasks index blocks of
documents: every term's postings sorted by impact, as one array of sorted
numbers. An item is answered by sequential reads alone: all its lists are
read down to a falling level of impact. A document's lower score is what
was read of it; its upper score adds, for each list it wasn't met in, the
impact at which that list stands. Reading goes on until no document that
may be among the k best has an open interval, so membership, ties and
scores are final. The k-th best score of a task's earlier blocks is the bar
for its later ones; a document under the bar is out.

Blocks of documents are of fixed size, so a task is bounded at any corpus;
lists of common terms are spread over all blocks. Items are taken in blocks
that hold a bounded number of terms, so what is sent to the tasks doesn't
grow with them.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tuneframe.llm.common import scratch, slices, slots, small_batches

DOC_BITS, IMPACT_BITS = 14, 20
BLOCK_DOCS = 1 << DOC_BITS
BLOCK_POSTINGS = 2_000_000

_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms(text: str | None) -> list[bytes]:
    """Maximal runs of ASCII letters, digits and all signs beyond ASCII, A-Z lower-cased, as UTF-8."""
    return (text or "").encode("utf-8", "replace").translate(_TABLE).split()


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


class Postings:
    """Impact-sorted postings of one block of documents.

    One sorted array of numbers: term, falling impact, document. The impact
    is ``(10**9 * tf) div (1000 * tf + 12 * m)``, below 2**20.
    """

    def __init__(self, term: np.ndarray, doc: np.ndarray, tf: np.ndarray, m: np.ndarray):
        impact = (1_000_000_000 * tf) // (1000 * tf + 12 * m[doc])
        top = (1 << IMPACT_BITS) - 1
        self.key = np.sort((term << (IMPACT_BITS + DOC_BITS)) | ((top - impact) << DOC_BITS) | doc)
        self.docs = len(m)

    def level(self, term: np.ndarray, impact: np.ndarray) -> np.ndarray:
        """Where each term's postings of at least ``impact`` end."""
        top = (1 << IMPACT_BITS) - 1
        need = np.clip(top - impact, -1, top)
        return np.searchsorted(self.key, ((term << IMPACT_BITS) + need + 1) << DOC_BITS, "left")

    def read(self, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Postings of the ranges: list, document and impact."""
        n = end - begin
        which = np.repeat(np.arange(len(n)), n)
        at = np.arange(n.sum()) + np.repeat(begin - np.concatenate([[0], np.cumsum(n)[:-1]]), n)
        key = self.key[at]
        return which, key & ((1 << DOC_BITS) - 1), ((1 << IMPACT_BITS) - 1) - ((key >> DOC_BITS) & ((1 << IMPACT_BITS) - 1))


def _sum(at: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    """Integer sums by position; floating point carries them exactly while they stay under 2**53."""
    if float(values.max(initial=0)) * len(values) < 2.0**53:
        return np.bincount(at, weights=values, minlength=size).astype(np.int64)
    out = np.zeros(size, dtype=np.int64)
    np.add.at(out, at, values)
    return out


def nra(postings: Postings, term: np.ndarray, factor: np.ndarray, k: int, bar: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents and scores of all that may be among the k best: every score is final.

    ``factor`` multiplies a term's impacts. Documents that can't reach
    ``bar`` are out; more than k come back where scores tie.
    """
    start = postings.level(term, np.full(len(term), 1 << IMPACT_BITS))
    stop = postings.level(term, np.zeros(len(term), dtype=np.int64))
    live = stop > start
    term, factor, start, stop = term[live], factor[live], start[live], stop[live]
    lower = np.zeros(postings.docs, dtype=np.int64)
    if not len(term):
        return np.zeros(0, dtype=np.int64), lower[:0]
    top = (1 << IMPACT_BITS) - 1

    def next_impact(at: np.ndarray) -> np.ndarray:
        """What the next posting of each list adds at most; nothing when the list is read."""
        key = postings.key[np.minimum(at, len(postings.key) - 1)]
        return np.where(at < stop, factor * (top - ((key >> DOC_BITS) & top)), 0)

    at = start.copy()
    standing = next_impact(at)
    level = int(standing.max())
    seen: list[tuple[np.ndarray, np.ndarray]] = []
    while True:
        level //= 4
        to = np.maximum(at, np.minimum(stop, postings.level(term, -(-max(level, 1) // factor) if level else np.zeros_like(factor))))
        which, doc, impact = postings.read(at, to)
        lower += _sum(doc, factor[which] * impact, postings.docs)
        seen.append((which, doc))
        at, standing = to, next_impact(to)
        open_ = np.full(postings.docs, standing.sum(), dtype=np.int64)
        for w, d in seen:
            open_ -= _sum(d, standing[w], postings.docs)
        floor = max(bar, 1)
        if np.count_nonzero(lower) >= k:
            floor = max(floor, int(np.partition(lower, len(lower) - k)[len(lower) - k]))
        may = lower + open_ >= floor
        if not (open_[may] > 0).any():
            found = np.flatnonzero(may & (lower > 0))
            return found, lower[found]


def count_terms(docs: DataFrame, vocabulary: list[bytes]) -> DataFrame:
    """``id, n, terms, counts``: the numbers and counts of the vocabulary's terms in each whole text.

    ``n`` counts all terms of the text with repeats.
    """
    number = {t: i for i, t in enumerate(vocabulary)}
    ints = pa.list_(pa.int32())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            n, ids, tfs = [], [], []
            for text in batch.column(1):
                every = terms(text.as_py())
                have = [(number[t], c) for t, c in Counter(every).items() if t in number]
                n.append(len(every))
                ids.append([i for i, _ in have])
                tfs.append([c for _, c in have])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, ints), pa.array(tfs, ints)],
                                             names=["id", "n", "terms", "counts"])

    return docs.mapInArrow(run, "id long, n long, terms array<int>, counts array<int>")


def frequencies(counted: DataFrame, vocabulary: int) -> np.ndarray:
    """How many documents hold each term; a task sends one number per term."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(vocabulary, dtype=np.int64)
        for batch in batches:
            df += np.bincount(batch.column(0).flatten().to_numpy(), minlength=vocabulary)
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(df[at], pa.int64())], names=["term", "df"])

    sums = counted.select("terms").mapInArrow(run, "term int, df long").groupBy("term").agg(F.sum("df").alias("df"))
    out = np.zeros(vocabulary, dtype=np.int64)
    for r in sums.collect():
        out[r["term"]] = r["df"]
    return out


Query = tuple[int, int | None, np.ndarray, np.ndarray]


def _answers(counted: DataFrame, queries: list[Query], n_docs: int, length: int, k: int) -> DataFrame:
    """``query, item_id, doc_id, score``: the k best of every block of documents for (number, id, terms, factors)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bars = [0] * len(queries)
        best: list[list[int]] = [[] for _ in queries]
        held: list[tuple] = []
        docs = rows = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal held, docs, rows
            ids = np.concatenate([h[0] for h in held])
            null = np.concatenate([h[1] for h in held])
            n = np.concatenate([h[2] for h in held])
            doc = np.repeat(np.arange(docs), np.concatenate([h[3] for h in held]))
            m = np.array([75 + (25 * int(v) * n_docs) // length for v in n], dtype=np.int64)
            block = Postings(np.concatenate([h[4] for h in held]), doc, np.concatenate([h[5] for h in held]), m)
            held, docs, rows = [], 0, 0
            for i, (number, item, term, factor) in enumerate(queries):
                found, score = nra(block, term, factor, k, bars[i])
                if not len(found):
                    continue
                first = np.lexsort((ids[found], null[found], -score))[:k]
                found, score = found[first], score[first]
                best[i] = sorted([*best[i], *score.tolist()], reverse=True)[:k]
                if len(best[i]) == k:
                    bars[i] = best[i][-1]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number] * len(found), pa.int64()), pa.array([item] * len(found), pa.int64()),
                     pa.array(ids[found], pa.int64(), mask=null[found]), pa.array(score, pa.int64())],
                    names=["query", "item_id", "doc_id", "score"])

        for batch in slices(batches, 2048):
            batch = batch.filter(pc.greater(pc.list_value_length(batch.column(2)), 0))
            if not batch.num_rows:
                continue
            null = np.asarray(batch.column(0).is_null())
            lists, tf = batch.column(2), batch.column(3).flatten().to_numpy().astype(np.int64)
            size = np.asarray(pc.list_value_length(lists)).astype(np.int64)
            if docs and (docs + batch.num_rows > BLOCK_DOCS or rows + len(tf) > BLOCK_POSTINGS):
                yield from flush()
            held.append((batch.column(0).fill_null(0).to_numpy(), null, batch.column(1).to_numpy(), size,
                         lists.flatten().to_numpy().astype(np.int64), tf))
            docs, rows = docs + batch.num_rows, rows + len(tf)
        if docs:
            yield from flush()

    return counted.mapInArrow(run, "query long, item_id long, doc_id long, score long")


def rank(docs: DataFrame, items: DataFrame, k: int = 20, doc_id: str = "doc_id", doc_text: str = "text",
         item_id: str = "item_id", item_text: str = "text", block_terms: int = 100_000) -> DataFrame:
    """The k best documents of every item: ``item_id, rank, doc_id, score``, ties to the smaller doc_id.

    N counts the documents with a term, L their terms, n those of one
    document, df the documents that hold a term, tf how often. A term weighs
    ``floor(1000 ln((2N + 2) / (2 df + 1)))``; ``m = 75 + (25 n N) div L``;
    the score sums ``weight * ((10**9 tf) div (1000 tf + 12 m))`` over the
    item's terms, repeats included. Documents with a score of 0 don't rank.

    Null and empty texts hold no terms: such items get no rows. Items that
    repeat id and text are answered once; different texts under one id are
    answered each on its own. Documents that repeat are documents of their
    own; a null doc_id ranks behind its equals. Empty tables give no rows.
    Other columns are not read.

    Items are answered in blocks of about ``block_terms`` terms; each block
    reads the documents again.
    """
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.col(f"`{doc_id}`").cast("long").alias("id"), F.col(f"`{doc_text}`").alias("text"))
    asked = items.select(F.col(f"`{item_id}`").cast("long").alias("id"), F.col(f"`{item_text}`").alias("text"))
    asked = asked.filter("text <> ''").distinct()
    # No more terms than half the bytes and one; blocks are cut at multiples of the running sum.
    asked = asked.withColumn("most", F.expr("octet_length(text) div 2 + 1"))
    path = scratch(spark, "lexical-items")
    placed = slots(asked, [], ["id", "text"], name="before", size="most")
    placed.withColumn("block", F.expr(f"before div {int(block_terms)}")).select("id", "text", "block").write.parquet(path)
    numbered = spark.read.parquet(path)
    last = numbered.agg(F.max("block")).first()[0]
    out = None
    for block in range(0 if last is None else last + 1):
        rows = [(r["id"], Counter(terms(r["text"]))) for r in numbered.filter(F.col("block") == block).orderBy("id", "text").collect()]
        vocabulary = sorted({t for _, c in rows for t in c})
        if not vocabulary:
            continue
        kept = scratch(spark, "lexical-docs")
        count_terms(texts, vocabulary).write.parquet(kept)
        counted = spark.read.parquet(kept)
        total = counted.filter("n > 0").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("terms")).first()
        if not total["docs"]:
            continue
        weights = [weight(total["docs"], int(d)) for d in frequencies(counted, len(vocabulary))]
        number = {t: i for i, t in enumerate(vocabulary)}
        queries: list[Query] = []
        for q, (item, have) in enumerate(rows):
            used = [(number[t], c * weights[number[t]]) for t, c in have.items() if weights[number[t]] > 0]
            if used:
                queries.append((q, item, *(np.array(x, dtype=np.int64) for x in zip(*used, strict=True))))
        if not queries:
            continue
        found = _answers(counted, queries, total["docs"], total["terms"], k)
        best = Window.partitionBy("query").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
        ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
        part = ranked.select("item_id", "rank", "doc_id", "score")
        out = part if out is None else out.union(part)
    return out if out is not None else spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
