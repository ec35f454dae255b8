"""Packing: best-fit decreasing with a segment tree over remaining capacities.

Every document is tokenized whole, ends with the separator id and is cut
into full windows and one rest. Full windows are sequences by themselves;
rests are packed best-fit decreasing: a segment tree whose leaves are the
capacities 1..window finds the tightest open sequence that still holds the
piece. Pieces are dealt by hash to buckets of a fixed number of tokens, so
a bucket is one small task at any corpus size, and only lengths move: the
ids stay where they were made.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tuneframe.llm.common import cut, slices, small_batches

#: Bytes that a generation of words, or of pieces, may take; a task has two of each, a worker between tasks one.
CACHE_BYTES = 56 << 20


class CapacityTree:
    """How many open sequences have each remaining capacity; finds the tightest that fits."""

    def __init__(self, window: int):
        self.width = 1
        while self.width <= window:
            self.width *= 2
        self.open = [0] * (2 * self.width)

    def add(self, capacity: int, n: int) -> None:
        k = self.width + capacity
        while k:
            self.open[k] += n
            k //= 2

    def tightest(self, need: int) -> int | None:
        """Smallest capacity of at least ``need`` with an open sequence."""
        k = self.width + need
        if self.open[k]:
            return need
        while k > 1:
            if k % 2 == 0 and self.open[k + 1]:
                k += 1
                while k < self.width:
                    k = 2 * k if self.open[2 * k] else 2 * k + 1
                return k - self.width
            k //= 2
        return None


def best_fit_decreasing(lengths, window: int) -> list[tuple[int, int]]:
    """``(sequence, offset)`` of each piece; pieces must not exceed the window."""
    tree = CapacityTree(window)
    at: dict[int, list[int]] = {}
    out: list[tuple[int, int]] = [(0, 0)] * len(lengths)
    made = 0
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        need = int(lengths[i])
        capacity = tree.tightest(need)
        if capacity is None:
            sequence, capacity = made, window
            made += 1
        else:
            sequence = at[capacity].pop()
            tree.add(capacity, -1)
        out[i] = (sequence, window - capacity)
        if capacity > need:
            at.setdefault(capacity - need, []).append(sequence)
            tree.add(capacity - need, 1)
    return out


def _byte_letters() -> list[str]:
    """The printable stand-in of each byte that byte-level vocabularies use: itself, or the next free letter from 256."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, free = [], 256
    for b in range(256):
        out.append(chr(b if b in plain else free))
        free += b not in plain
    return out


class Kept(dict):
    """Ids by text, computed when first asked for, in two generations of bounded bytes.

    When the young one is full it becomes the old one; what is asked for
    again comes back from there. So what is frequent stays, whatever passes.
    """

    def __init__(self, make):
        super().__init__()
        self.make, self.old, self.held = make, {}, 0

    def __missing__(self, text: str) -> bytes:
        ids = self.old.get(text)
        if ids is None:
            ids = self.make(text)
        # A text, its ids and about 200 bytes around them.
        self.held += 200 + len(text) + len(ids)
        if self.held > CACHE_BYTES:
            self.old, self.held = self.copy(), 0
            self.clear()
        self[text] = ids
        return ids


class WordEncoder:
    """Token ids of a blank-separated word as little-endian bytes, in a bounded cache.

    The vocabulary's pre-tokenizer never joins across a blank, so a text's
    ids are the ids of its words one after the other. Words of ASCII signs
    and Western letters are cut into the pre-tokenizer's pieces here and only
    new pieces are merged by the vocabulary; any other word, and words that
    could hold a special token, go through the whole tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.words, self.pieces = Kept(self.word), Kept(self.piece)
        # Fixed values of the vocabulary's pre-tokenizer, for lower-case letters of the safe alphabet.
        self.cut = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+").findall
        self.safe = re.compile("[!-~À-ÖØ-öø-ÿ]*").fullmatch
        self.letter = _byte_letters()

    def piece(self, piece: str) -> bytes:
        letters = piece if piece.isascii() else "".join(self.letter[b] for b in piece.encode())
        return b"".join(t.id.to_bytes(4, "little") for t in self.model.tokenize(letters))

    def word(self, word: str) -> bytes:
        if self.safe(word) and "<|" not in word:
            return b"".join(map(self.pieces.__getitem__, self.cut(word.lower())))
        return np.asarray(self.tokenizer.encode(word, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.words.__getitem__, text.replace("\n", " ").split(" ")))


ENCODERS: dict[str, WordEncoder] = {}


def encoder_of(path: str) -> WordEncoder:
    """One encoder per Python worker: its cache outlives a task."""
    if path not in ENCODERS:
        ENCODERS[path] = WordEncoder(path)
    return ENCODERS[path]


def cut_pieces(docs: DataFrame, tokenizer: str, end_id: int = 2, window: int = 4096, ids: bool = False,
               id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenize and cut: ``id, start, length, ids_crc32, doc_tokens`` and, on demand, the ``ids`` themselves.

    A null text is an empty one: it has the separator only.
    """
    end = np.asarray([end_id], dtype="<u4").tobytes()
    schema = "id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(tokenizer)
        for batch in slices(batches):
            cols: list[list] = [[] for _ in range(5 + ids)]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = encoder.encode(text.as_py() or "") + end
                n = len(raw) // 4
                for start in range(0, n, window):
                    part = raw[4 * start : 4 * (start + window)]
                    row = (doc, start, len(part) // 4, zlib.crc32(part), n, part)
                    for c, v in zip(cols, row, strict=False):
                        c.append(v)
            types = [pa.int64()] * 5 + [pa.binary()] * ids
            names = ["id", "start", "length", "ids_crc32", "doc_tokens", "ids"][: 5 + ids]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)
        encoder.words.old, encoder.pieces.old = {}, {}

    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def place(pieces: DataFrame, window: int = 4096, bucket_tokens: int = 2_000_000) -> DataFrame:
    """Add ``sequence_id, offset`` to pieces that have ``id, start, length, ids_crc32``.

    Buckets follow the corpus' tokens, about ``bucket_tokens`` each; a
    sequence id is its bucket and its number there. Pieces that are equal are
    dealt apart by their place among the rows. ``pieces`` is read twice and
    must give the same rows in the same places: a lineage cut.
    """
    total = pieces.agg(F.sum("length")).first()[0] or 0
    buckets = max(1, -(-total // bucket_tokens))
    row = F.monotonically_increasing_id()
    dealt = pieces.withColumn("bucket", F.pmod(F.xxhash64("id", "start", "ids_crc32", row), F.lit(buckets)).cast("long"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "id", "start", "ids_crc32"], ascending=[False, True, True, True], kind="stable")
        put = best_fit_decreasing(pdf["length"].tolist(), window)
        pdf["sequence_id"] = [(int(b) << 32) + s for b, (s, _) in zip(pdf["bucket"], put, strict=True)]
        pdf["offset"] = [o for _, o in put]
        return pdf.drop(columns="bucket")

    schema = ", ".join(f"{n} {t}" for n, t in pieces.dtypes) + ", sequence_id long, offset long"
    return dealt.groupBy("bucket").applyInPandas(run, schema)


def pack(docs: DataFrame, tokenizer: str, end_id: int = 2, window: int = 4096, bucket_tokens: int = 2_000_000,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Where every token of every document goes: one row per piece.

    ``id, start, length, ids_crc32, doc_tokens, sequence_id, offset``. Each
    document is its token ids and ``end_id``; every id lies in exactly one
    piece, pieces of a sequence are gapless from offset 0. Overlong documents
    give full windows first. Null and empty texts hold the separator only,
    repeated rows are packed as rows of their own, an empty table gives no
    rows. Other columns are not read.
    """
    return place(cut(cut_pieces(docs, tokenizer, end_id, window, False, id_col, text_col)), window, bucket_tokens)


def sequences(docs: DataFrame, tokenizer: str, end_id: int = 2, window: int = 4096, bucket_tokens: int = 2_000_000,
              pad_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The packed training sequences: ``sequence_id, ids`` (little-endian unsigned 32-bit), ``tokens``.

    A sequence is padded to the window unless its length is a power of two.
    """
    made = cut(cut_pieces(docs, tokenizer, end_id, window, True, id_col, text_col))
    placed = place(made.drop("ids"), window, bucket_tokens)
    # Equal pieces of repeated rows are interchangeable: they are numbered on both sides.
    key = ["id", "start", "ids_crc32", "length"]
    a = placed.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy("sequence_id", "offset")))
    b = made.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy("doc_tokens")))
    cond = F.col("a._n") == F.col("b._n")
    for c in key:
        cond = cond & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    rows = a.alias("a").join(b.alias("b"), cond).select("a.sequence_id", "a.offset", "a.length", "b.ids")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("offset")
        raw, n = b"".join(pdf["ids"]), int(pdf["length"].sum())
        if n & (n - 1):
            raw += np.full(window - n, pad_id, dtype="<u4").tobytes()
        return pd.DataFrame({"sequence_id": [pdf["sequence_id"].iloc[0]], "ids": [raw], "tokens": [n]})

    return rows.groupBy("sequence_id").applyInPandas(run, "sequence_id long, ids binary, tokens long")
