"""Toxicity: a linear-chain conditional random field tags toxic spans.

Labels are per document, so tokens are labelled first: a token of a toxic
document is toxic if one of its features (the word or a prefix of it) is far
more frequent among the tokens of toxic documents than among clean ones;
every other token is clean. A two-state chain field is fitted to these
labelled tokens. Forward-backward marginals over whole documents give each
token's probability; a document's score is a logistic function of their sum,
their density and the length, and offending offsets are the spans of tokens
that are more likely toxic than not.

The field is fitted on the driver on a bounded sample of labelled rows
(``sample`` documents a class, of at most ``sample_bytes`` each); scoring
covers every text in full, on the executors.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from tuneframe.llm.common import give_back, slices, small_batches

TOKEN = re.compile(r"[^\W\d_]+")


def tokens(text: str | None) -> list[str]:
    """The words of the text as it is, lower-cased: where lower-casing changes the length, word by word."""
    text = text or ""
    low = text.lower()
    return TOKEN.findall(low) if len(low) == len(text) else [w.lower() for w in TOKEN.findall(text)]


PREFIXES = range(3, 8)
STRIP = 64
#: Bytes of words whose scores a task keeps.
CACHE_BYTES = 16 << 20


def features(word: str) -> list[str]:
    """The word and its prefixes; ``word`` is lower case."""
    return ["=" + word, *("^" + word[:n] for n in PREFIXES if n <= len(word))]


# ---------------------------------------------------------------- the chain


def _scan(first: np.ndarray, emit: np.ndarray, move: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Normalised forward vectors (2, n) of a chain that starts anew wherever ``first`` is set.

    ``emit`` (2, n), ``move`` (2, 2) and ``start`` (2,) are potentials. The
    chain is cut into strips that run side by side: once from either state,
    which tells what a strip makes of any state before it, and once more
    from the state that the strips before it lead to.
    """
    n = emit.shape[1]
    rows = -(-n // STRIP)
    pad = rows * STRIP - n

    def strips(x, fill):
        return np.ascontiguousarray(np.append(x, np.full(pad, fill, x.dtype)).reshape(rows, STRIP).T)

    e0, e1, new = strips(emit[0], 1.0), strips(emit[1], 1.0), strips(first, False)
    some = new.any(axis=1)
    (t00, t01), (t10, t11) = move.tolist()
    b0, b1 = start.tolist()

    def step(x, y, j):
        u, v = (x * t00 + y * t10) * e0[j], (x * t01 + y * t11) * e1[j]
        if some[j]:
            both = x + y
            u, v = np.where(new[j], both * b0 * e0[j], u), np.where(new[j], both * b1 * e1[j], v)
        return u, v

    x, y = np.ones(rows), np.zeros(rows)
    if rows > 1:
        p, q, r, s = np.ones(rows), np.zeros(rows), np.zeros(rows), np.ones(rows)
        for j in range(STRIP):
            p, q = step(p, q, j)
            r, s = step(r, s, j)
            top = np.maximum(np.maximum(p, q), np.maximum(r, s))
            p, q, r, s = p / top, q / top, r / top, s / top
        a, b, xs, ys = 1.0, 0.0, [], []
        for k, l, m, o in zip(p.tolist(), q.tolist(), r.tolist(), s.tolist(), strict=True):
            xs.append(a)
            ys.append(b)
            a, b = a * k + b * m, a * l + b * o
            a, b = a / (a + b), b / (a + b)
        x, y = np.array(xs), np.array(ys)
    out = np.empty((2, STRIP, rows))
    for j in range(STRIP):
        x, y = step(x, y, j)
        total = x + y
        x, y = x / total, y / total
        out[0, j], out[1, j] = x, y
    return out.transpose(0, 2, 1).reshape(2, -1)[:, :n]


def _both_ways(score: np.ndarray, first: np.ndarray, move: np.ndarray, start: np.ndarray):
    """Forward and backward vectors, both (2, n), and the token potentials."""
    s = np.clip(score, -40, 40)
    emit = np.exp(np.stack([np.minimum(0, -s), np.minimum(0, s)]))
    t, b = np.exp(move), np.exp(start)
    fwd = _scan(first, emit, t, b)
    # Backwards the same recursion runs on the reversed chain; the token's own potential is taken out again.
    last = np.append(first[1:], True)[::-1]
    bwd = _scan(last, emit[:, ::-1], t.T, np.ones(2))[:, ::-1] / emit
    return fwd, bwd, emit, t


def token_probability(score: np.ndarray, first: np.ndarray, move: np.ndarray, start: np.ndarray) -> np.ndarray:
    """``P(toxic)`` of every token.

    ``score`` is each token's log potential of being toxic against clean,
    ``first`` marks the first token of each document, ``move`` and ``start`` are log potentials.
    """
    if not len(score):
        return np.zeros(0)
    fwd, bwd, _, _ = _both_ways(score, first, move, start)
    p = fwd * bwd
    return p[1] / p.sum(0)


def marginals(score: np.ndarray, first: np.ndarray, move: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``P(toxic)`` of every token, and ``P(both states)`` of neighbours, (2, 2, n - 1), zero across documents."""
    if not len(score):
        return np.zeros(0), np.zeros((2, 2, 0))
    fwd, bwd, emit, t = _both_ways(score, first, move, start)
    p = fwd * bwd
    into = emit[:, 1:] * bwd[:, 1:]
    # In place: a long chain's pairs are held once.
    pair = np.empty((2, 2, len(score) - 1))
    for i in (0, 1):
        for j in (0, 1):
            np.multiply(fwd[i, :-1], t[i, j], out=pair[i, j])
            pair[i, j] *= into[j]
    pair /= pair.sum((0, 1))
    pair[:, :, first[1:]] = 0.0
    return p[1] / p.sum(0), pair


@dataclass
class Tagger:
    """Weights of the field and of the document score."""

    weight: dict[str, float] = field(default_factory=dict)
    bias: float = -6.0
    move: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    start: np.ndarray = field(default_factory=lambda: np.zeros(2))
    document: np.ndarray = field(default_factory=lambda: np.array([-2.0, 0, 0, 0, 0]))

    def token(self, word: str) -> float:
        w = self.weight
        return self.bias + sum(w.get(f, 0.0) for f in features(word))

    def describe(self, p: np.ndarray) -> np.ndarray:
        """What the document score looks at; defined for texts without tokens, too."""
        n, total = len(p), float(p.sum())
        return np.array([1.0, math.log1p(total), min(1.0, 20 * total / max(1, n)), float(p.max(initial=0.0)), math.log1p(n) / 10])

    def score(self, p: np.ndarray) -> float:
        z = float(np.clip(self.describe(p) @ self.document, -35, 35))
        return 1 / (1 + math.exp(-z))


# ---------------------------------------------------------------- fitting


def fit(rows: list[tuple[str, int, float]], rounds: int = 40, seed: int = 1) -> Tagger:
    """Fit to ``(text, toxic, weight)`` rows; without rows of both kinds every score is the base rate.

    ``weight`` says how many documents a row stands for.
    """
    model = Tagger()
    pos = sum(w for _, y, w in rows if y)
    neg = sum(w for _, y, w in rows if not y)
    rate = (pos + 0.5) / (pos + neg + 1)
    model.document = np.array([math.log(rate / (1 - rate)), 0, 0, 0, 0])
    if not pos or not neg:
        return model
    # Words as ids of distinct words from the start: the driver holds each word once.
    vocab: dict[str, int] = {}
    docs = [np.array([vocab.setdefault(w, len(vocab)) for w in tokens(t)], dtype=np.int32) for t, _, _ in rows]
    listed = list(vocab)
    toxic = np.array([y for _, y, _ in rows], dtype=bool)
    weight = np.array([w for _, _, w in rows])

    # Features that set tokens of toxic documents apart: by rate, and in several documents.
    seen = [Counter(), Counter()]
    held: Counter = Counter()
    size = [1.0, 1.0]
    for words, y in zip(docs, toxic, strict=True):
        per: Counter = Counter()
        for w, n in zip(*(x.tolist() for x in np.unique(words, return_counts=True)), strict=True):
            for f in features(listed[w]):
                per[f] += n
        seen[int(y)].update(per)
        size[int(y)] += len(words)
        if y:
            held.update(per.keys())
    least = max(3, 0.005 * toxic.sum())
    lift = {}
    for f, n in seen[1].items():
        if held[f] >= least:
            up = math.log((n + 0.5) / size[1]) - math.log((seen[0][f] + 0.5) / size[0])
            if up > math.log(6):
                lift[f] = up
    if not lift:
        return model

    # Only words with a telling feature have more than the bias.
    names = sorted(lift)
    number = {f: k for k, f in enumerate(names)}
    active = [[number[f] for f in features(w) if f in number] for w in listed]
    ids = np.concatenate(docs).astype(np.int64)
    lengths = np.array([len(w) for w in docs])
    owner = np.repeat(np.arange(len(docs)), lengths)
    first = np.diff(owner, prepend=-1) > 0
    marked = np.array([bool(a) for a in active])
    y = marked[ids] & toxic[owner]
    # Clean documents count as often as they stand for, scaled so that the sum is the sample's size.
    w = (weight / weight.mean())[owner]
    flat_word = np.repeat(np.arange(len(active)), [len(a) for a in active])
    flat_feat = np.array([f for a in active for f in a], dtype=np.int64)

    theta = np.zeros(len(names) + 1 + 4 + 2)
    theta[: len(names)] = 0.2
    theta[len(names)] = -4.0
    mom, var = np.zeros_like(theta), np.zeros_like(theta)
    n_f = len(names)
    scale = w.sum()
    pairs = np.flatnonzero(~first)
    gold = np.zeros((2, 2))
    np.add.at(gold, (y[pairs - 1].astype(int), y[pairs].astype(int)), w[pairs])
    gold_start = np.array([w[first & ~y].sum(), w[first & y].sum()])
    gold_word = np.bincount(ids, weights=w * y, minlength=len(active))
    for k in range(1, rounds + 1):
        per_word = theta[n_f] + np.bincount(flat_word, weights=theta[flat_feat], minlength=len(active))
        move, start = theta[n_f + 1 : n_f + 5].reshape(2, 2), theta[n_f + 5 :]
        p, both = marginals(per_word[ids], first, move, start)
        gap = gold_word - np.bincount(ids, weights=w * p, minlength=len(active))
        grad = np.zeros_like(theta)
        grad[:n_f] = np.bincount(flat_feat, weights=gap[flat_word], minlength=n_f)
        grad[n_f] = gap.sum()
        grad[n_f + 1 : n_f + 5] = (gold - np.multiply(both, w[1:], out=both).sum(2)).ravel()
        grad[n_f + 5 :] = gold_start - np.array([(w * (1 - p))[first].sum(), (w * p)[first].sum()])
        grad = grad / scale * 100
        grad[:n_f] -= 0.002 * theta[:n_f]
        grad[n_f + 1 :] -= 0.002 * theta[n_f + 1 :]
        mom, var = 0.9 * mom + 0.1 * grad, 0.99 * var + 0.01 * grad**2
        theta = theta + 0.15 * (mom / (1 - 0.9**k)) / (np.sqrt(var / (1 - 0.99**k)) + 1e-6)
    model.weight = {f: float(theta[k]) for k, f in enumerate(names)}
    model.bias = float(theta[n_f])
    model.move, model.start = theta[n_f + 1 : n_f + 5].reshape(2, 2).copy(), theta[n_f + 5 :].copy()

    # The document score: weighted logistic regression on what the marginals say.
    per_word = model.bias + np.bincount(flat_word, weights=theta[flat_feat], minlength=len(active))
    p = token_probability(per_word[ids], first, model.move, model.start)
    ends = np.cumsum(lengths)
    x = np.array([model.describe(p[e - n : e]) for e, n in zip(ends, lengths, strict=True)])
    t, v = toxic.astype(float), weight / weight.sum() * len(weight)
    beta = model.document.copy()
    for _ in range(50):
        q = 1 / (1 + np.exp(-np.clip(x @ beta, -35, 35)))
        h = (x * (v * q * (1 - q))[:, None]).T @ x + np.diag([1e-4, 0.05, 0.05, 0.05, 0.05])
        g = x.T @ (v * (t - q)) - np.array([0, 0.05, 0.05, 0.05, 0.05]) * beta
        change = np.linalg.solve(h, g)
        beta = beta + np.clip(change, -4, 4)
        if np.abs(change).max() < 1e-8:
            break
    model.document = beta
    del docs, vocab, listed, active, seen, held
    give_back()
    return model


def training_rows(docs: DataFrame, labels: DataFrame, sample: int = 800, sample_bytes: int = 20_000,
                  id_col: str = "doc_id", text_col: str = "text") -> list[tuple[str, int, float]]:
    """A seeded, bounded sample of labelled documents: ``sample`` a class, each text once.

    ``labels(id, toxic)``; labels that are null, or disagree within a document, are left out.
    """
    y = labels.select(F.col(id_col).alias("id"), F.col("toxic").cast("int").alias("toxic")).filter("id is not null")
    y = y.groupBy("id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("_m")).filter("toxic = _m").drop("_m")
    size = {r["toxic"]: r["count"] for r in y.groupBy("toxic").count().collect()}
    text = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter(F.octet_length("text") <= sample_bytes)
    out = []
    for kind in (1, 0):
        n = size.get(kind, 0)
        if not n:
            continue
        # Twice as many ids as needed, as some texts are too long or repeat; 16 bytes each.
        ids = y.filter(F.col("toxic") == kind).select("id").orderBy(F.xxhash64("id"), "id").limit(2 * sample)
        got = text.join(F.broadcast(ids), "id").dropDuplicates(["text"]).orderBy(F.xxhash64("id"), "id").limit(sample).collect()
        out += [(r["text"], kind, n / max(1, len(got))) for r in got]
    return out


# ---------------------------------------------------------------- scoring


def tag(docs: DataFrame, model: Tagger, id_col: str = "doc_id", text_col: str = "text", spans: bool = True,
        carry: list[str] | None = None, batch_tokens: int = 50_000) -> DataFrame:
    """Score every whole text: ``id, score`` and, with ``spans``, the offending ``(start, end)`` code points.

    Null and empty texts have no tokens and get the score of an empty
    document. ``carry`` names columns of ``docs`` to hand through, as
    ``carry_0, carry_1, ..``, so no name can clash. Rows that repeat are scored as rows of their own;
    an empty table gives no rows.
    """
    carry = carry or []
    small_batches(docs.sparkSession)
    fields = [StructField("id", LongType()), StructField("score", DoubleType())]
    if spans:
        fields.append(StructField("spans", ArrayType(StructType([StructField("start", LongType()), StructField("end", LongType())]))))
    fields += [StructField(f"carry_{i}", docs.schema[c].dataType) for i, c in enumerate(carry)]
    picked = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"),
                         *[F.col(f"`{c}`").alias(f"carry_{i}") for i, c in enumerate(carry)])

    class Scores(dict):
        held = 0

        def __missing__(self, word):
            # A short word takes about as much again as the cache's entry for it.
            self.held += 200 + 4 * len(word)
            if self.held > CACHE_BYTES:
                self.clear()
                self.held = 200 + 4 * len(word)
            s = self[word] = model.token(word)
            return s

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Scores()
        for batch in slices(batches):
            scores, found = [], []
            todo: list[tuple[str, list[str]]] = []
            waiting = 0

            def flush():
                nonlocal todo, waiting
                lengths = [len(w) for _, w in todo]
                flat = np.fromiter((known[w] for _, ws in todo for w in ws), dtype=np.float64, count=sum(lengths))
                first = np.zeros(len(flat), dtype=bool)
                starts = np.cumsum([0, *lengths[:-1]]) if lengths else []
                for s, n in zip(starts, lengths, strict=True):
                    if n:
                        first[s] = True
                p = token_probability(flat, first, model.move, model.start)
                for (text, _), s, n in zip(todo, starts, lengths, strict=True):
                    own = p[s : s + n]
                    scores.append(model.score(own))
                    if spans:
                        found.append(offsets(text, own))
                todo, waiting = [], 0

            for text in batch.column(1):
                t = text.as_py() or ""
                words = tokens(t)
                todo.append((t if spans else "", words))
                waiting += len(words)
                if waiting >= batch_tokens:
                    flush()
            flush()
            cols = [batch.column(0), pa.array(scores, pa.float64())]
            names = ["id", "score"]
            if spans:
                cols.append(pa.array(found, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))))
                names.append("spans")
            for i in range(len(carry)):
                cols.append(batch.column(2 + i))
                names.append(f"carry_{i}")
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return picked.mapInArrow(run, StructType(fields))


def offsets(text: str, p: np.ndarray) -> list[dict[str, int]]:
    """Spans of neighbouring tokens that are more likely toxic than not, as places in the text as it is."""
    hot = np.flatnonzero(p > 0.5)
    if not len(hot):
        return []
    places = [m.span() for m in TOKEN.finditer(text)]
    out: list[dict[str, int]] = []
    before = -2
    for k in hot.tolist():
        start, end = places[k]
        if k == before + 1:
            out[-1]["end"] = end
        else:
            out.append({"start": start, "end": end})
        before = k
    return out
