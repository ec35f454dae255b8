"""Suffix-array dedup: column-wise multi-document construction of a collection's BWT and common prefixes.

Every byte covered by a string of ``length`` bytes that also starts earlier
(smaller id, or same document and earlier start) is removed.

1. *Segments.* Of each string's ``anchor``-byte substrings the one with the smallest
   hash (the leftmost of them) is its anchor. Consecutive starts with the
   same anchor form one segment, about one in 35 bytes; equal strings have
   equal anchors, so they meet wherever their segments meet. Segments are
   known by a hash of their bytes, and copies of a segment are combined
   before anything else, first inside a task, so that a hot passage costs a
   few rows a task: the first holder stays, all others are repeats.
2. *Collections.* A string reaches at least ``(length - anchor) / 2`` bytes
   beyond its anchor on one of its sides. Only segments that share the anchor
   and that much of a side with another segment lend their bytes. They are
   dealt to collections by anchor, many anchors to a collection of bounded
   size; the segments of an anchor with more than that are taken apart into
   their strings, which are compared by a 128-bit hash each, copies combined
   inside a task first. A collection's Burrows-Wheeler
   transform is built column by column: each round inserts the next symbol
   of every segment, from the last to the first, into the transform and the
   array of common prefixes, which are kept in sequential files and merged
   in one pass per round.
3. *Runs.* Neighbours in the finished order whose common prefix reaches
   ``length`` are equal strings; all but the earliest start are repeats.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from contextlib import closing

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tuneframe.llm.bytehash import Prefix, scramble
from tuneframe.llm.common import cut, scratch, slices

def window_min_first(h: np.ndarray, w: int) -> np.ndarray:
    """Position of the smallest value of every ``w`` neighbours, the leftmost of equal ones."""
    least, pos = h, np.arange(len(h), dtype=np.int32)
    have = 1
    while have < w:
        step = min(have, w - have)
        n = len(least) - step
        later = least[step:] < least[:n]
        least, pos = np.where(later, least[step:], least[:n]), np.where(later, pos[step:], pos[:n])
        have += step
    return pos.astype(np.int64)


def segments_of(raw: bytes, length: int, anchor: int) -> tuple[np.ndarray, ...]:
    """``(first start, starts, anchor hash, segment hash, sides)`` of each run of starts with the same anchor.

    Segments are copies if both hashes agree, 32 bits and 64 bits of bases of their own. ``sides`` are 16 bits for
    the bytes before the anchor and 16 for those behind it, 0 where the segment ends before.
    """
    data = np.frombuffer(raw, np.uint8)
    if len(data) < length:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int32)
    near, far = Prefix(data, 0), Prefix(data, 1)
    h = near.grams(anchor)
    at = window_min_first(h, length - anchor + 1)
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    starts = np.diff(np.concatenate([first, [len(at)]]))
    end, mid = first + starts + length - 1, at[first]
    side = -(-(length - anchor) // 2)

    def beside(a: np.ndarray, ok: np.ndarray) -> np.ndarray:
        a = np.where(ok, a, 0)
        return np.where(ok, np.maximum((near.part(a, a + side) >> np.uint64(48)).astype(np.uint32), np.uint32(1)), np.uint32(0))

    left, right = beside(mid - side, mid - side >= first), beside(mid + anchor, mid + anchor + side <= end)
    # The anchor is the window's smallest hash, so its upper bits are not spread evenly.
    mark = scramble(h[mid]).astype(np.uint32).view(np.int32)
    return first, starts, mark, far.part(first, end).view(np.int64), (left << np.uint32(16) | right).view(np.int32)


# ---------------------------------------------------------------- column-wise construction


class ColumnFiles:
    """The transform, its last-first links and the common prefixes of the order so far, as sequential files: read from one, written to the other."""

    def __init__(self, folder: str, names: tuple[str, ...] = ("symbol", "link", "lcp")):
        self.turn, self.rows = 0, 0
        self.files = {(name, t): open(f"{folder}/{name}{t}", "w+b", buffering=0) for name in names for t in (0, 1)}

    def write(self, **arrays: np.ndarray) -> None:
        self.turn ^= 1
        for name, a in arrays.items():
            file, left = self.files[name, self.turn], memoryview(np.ascontiguousarray(a)).cast("B")
            file.seek(0)
            while len(left):
                left = left[file.write(left):]
            self.rows = len(a)

    def read(self, name: str, kind) -> np.ndarray:
        file, out = self.files[name, self.turn], np.empty(self.rows, kind)
        file.seek(0)
        left = memoryview(out).cast("B")
        while len(left):
            left = left[file.readinto(left):]
        return out

    def close(self) -> None:
        for file in self.files.values():
            file.close()


MOVED_AT_ONCE = 1 << 14  # links moved up at once: what that takes stays in the processor's cache


def common_prefixes(strings: list[bytes], cap: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted suffixes of a collection: ``(string, start, common prefix with the one before)``.

    Built column by column from the right. In round r every string of at
    least r bytes inserts its suffix of length r. The place of a suffix
    follows from the place of the one a byte shorter: it lies behind all
    suffixes with a smaller first byte, and among those with the same first
    byte in the order of what follows (the last-first mapping). That mapping is
    kept sorted beside the transform, as pairs of a suffix's first byte and
    the place of the suffix a byte shorter, so that a round finds the places
    of its suffixes by halving and moves the rest up; it sorts only what is
    new. Ends sort
    before any byte, and equal suffixes by string. Common prefixes are
    carried along: that of a new pair is one more than the smallest between
    the two shorter suffixes, and is kept up to ``cap``; only the new
    suffixes and those right behind them form new pairs. Whose suffixes they
    are is read off the finished transform, from the ends on.
    """
    m = len(strings)
    lengths = np.array([len(s) for s in strings], dtype=np.int64)
    width = int(lengths.max(initial=0))
    # Symbols are numbered from 1 as they occur; 0 stands before a string's first byte.
    present = np.unique(np.frombuffer(b"".join(strings), np.uint8))
    kind = np.uint8 if len(present) < 256 else np.int16
    code = np.zeros(256, kind)
    code[present] = np.arange(1, len(present) + 1)
    # Column r holds the r-th byte from the end of each string, 0 beyond its first.
    column = np.zeros((width + 1, m), dtype=kind)
    bits = int(m + lengths.sum()).bit_length()
    wide = np.int32 if bits + len(present).bit_length() < 32 else np.int64
    low = wide((1 << bits) - 1)
    for k, s in enumerate(strings):
        column[: len(s), k] = code[np.frombuffer(s, np.uint8)[::-1]]
    with tempfile.TemporaryDirectory() as folder, closing(ColumnFiles(folder)) as files:
        # Round 0: the ends. symbol[i] is the byte before suffix i; an end's link is its own place, below all others.
        files.write(symbol=column[0], link=np.arange(m, dtype=wide), lcp=np.zeros(m, np.int16))
        live = np.flatnonzero(lengths > 0)
        place = live  # where each live string's latest suffix stands
        for r in range(1, width + 1):
            symbol, link, lcp = files.read("symbol", kind), files.read("link", wide), files.read("lcp", np.int16)
            added = column[r - 1, live].astype(wide) << bits | place.astype(wide)
            order = np.argsort(added)
            live, added = live[order], added[order]
            new = np.searchsorted(link, added) + np.arange(len(added))
            total = len(symbol) + len(added)
            keep = np.ones(total, bool)
            keep[new] = False
            out_symbol, out_link, out_lcp = np.empty(total, kind), np.empty(total, wide), np.empty(total, np.int16)
            out_symbol[keep], out_link[keep], out_lcp[keep] = symbol, link, lcp
            out_symbol[new], out_link[new] = column[r, live], added
            behind = new + 1
            behind = behind[np.append(behind[:-1] != new[1:], behind[-1:] < total)]
            pair = np.sort(np.concatenate([new, behind]))
            out_lcp[pair] = pair_prefixes(lcp, out_link, pair, bits, cap)
            # Links are places in the order before this round: each moves up by what came in below it.
            up = np.repeat(np.arange(len(new) + 1, dtype=wide), np.diff(new - np.arange(len(new)), prepend=0, append=len(symbol)))
            for k in range(0, total, MOVED_AT_ONCE):
                some = out_link[k : k + MOVED_AT_ONCE]
                some += up[some & low]
            files.write(symbol=out_symbol, link=out_link, lcp=out_lcp)
            more = lengths[live] > r
            live, place = live[more], new[more]
        symbol, lcp = files.read("symbol", kind), files.read("lcp", np.int16)
    rank = last_first(symbol)
    owner, size = np.empty(len(symbol), np.int64), np.empty(len(symbol), np.int64)
    live = at = np.arange(m)
    for r in range(width + 1):
        owner[at], size[at] = live, r
        more = lengths[live] > r
        live, at = live[more], rank[at[more]]
    return owner, lengths[owner] - size, lcp.astype(np.int64)


def last_first(symbol: np.ndarray) -> np.ndarray:
    """Each position's rank in the order of their symbols: in the finished transform, where the suffix a byte longer stands."""
    rank = np.empty(len(symbol), np.int64)
    rank[np.argsort(symbol, kind="stable")] = np.arange(len(symbol))
    return rank


def pair_prefixes(lcp: np.ndarray, link: np.ndarray, pair: np.ndarray, bits: int, cap: int) -> np.ndarray:
    """Common prefixes of the suffixes at ``pair`` with those a place before: 0 across first bytes.

    ``link`` holds their first bytes and, in the lower ``bits``, places in the shorter order that ``lcp`` belongs to.
    """
    out = np.zeros(len(pair), np.int16)
    above, own = link[pair - 1], link[pair]
    ok = np.flatnonzero(above >> bits == own >> bits)
    if len(ok):
        low = (1 << bits) - 1
        lo, hi = (above[ok] & low) + 1, own[ok] & low
        # reduceat over pairs of borders; from the last range to the first, so that what lies between costs nothing.
        order = np.argsort(-lo)
        borders = np.empty(2 * len(ok), np.int64)
        borders[0::2], borders[1::2] = lo[order], hi[order] + 1
        smallest = np.minimum.reduceat(np.append(lcp, np.int16(0)), borders)[0::2]
        out[ok[order]] = np.minimum(smallest + 1, cap)
    return out


def earlier_starts(strings: list[bytes], doc: np.ndarray, start: np.ndarray, length: int) -> list[np.ndarray]:
    """Per string: its starts whose ``length`` bytes also start earlier in another string (or this one).

    ``doc, start`` place the string's first holder.
    """
    owner, at, lcp = common_prefixes(strings, length)
    sizes = np.array([len(s) for s in strings])
    run = np.cumsum(lcp < length)
    whole = sizes[owner] - at >= length
    owner, at, run = owner[whole], at[whole], run[whole]
    order = np.lexsort((start[owner] + at, doc[owner], run))
    later = np.r_[False, run[order][1:] == run[order][:-1]] if len(order) else np.zeros(0, bool)
    picked = order[later]
    owner, at = owner[picked], at[picked]
    by_owner = np.lexsort((at, owner))
    return np.split(at[by_owner], np.cumsum(np.bincount(owner, minlength=len(strings)))[:-1])


# ---------------------------------------------------------------- the operator


def _rows(columns: dict, types: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns.values(), types, strict=True)], names=list(columns))


SEGMENTS_HELD = 1 << 18  # segments that a scan task combines at once, some 20 MB


def _segment_rows(length: int, anchor: int):
    """Scan step: one narrow row per segment: ``doc, place, mark, seg, sides``.

    ``place`` is the first start times 2**16 plus the number of starts; it is
    negative for segments with an earlier holder among the rows at hand.
    """
    def combined(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        doc, start, starts, mark, seg, sides = (np.concatenate([p[k] for p in parts]) for k in range(6))
        order = np.lexsort((start, doc, seg, mark))
        copy = np.zeros(len(order), bool)
        m, s = mark[order], seg[order]
        copy[order[1:]] = (m[1:] == m[:-1]) & (s[1:] == s[:-1])
        place = (start << 16 | starts) * np.where(copy, -1, 1)
        return pa.RecordBatch.from_arrays([pa.array(c) for c in (doc, place, mark, seg, sides)], names=["doc", "place", "mark", "seg", "sides"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in slices(batches):
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = segments_of(text.as_py() or b"", length, anchor)
                parts.append((np.full(len(found[0]), doc, np.int64), *found))
                held += len(found[0])
                if held >= SEGMENTS_HELD:
                    yield combined(parts)
                    parts, held = [], 0
        if held:
            yield combined(parts)
    return run


def _collection(length: int):
    """One collection: the different segments of its anchors, each with its first holder."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        strings = pdf["bytes"].tolist()
        doc, start = pdf["doc"].to_numpy(), pdf["start"].to_numpy()
        gone = earlier_starts(strings, doc, start, length)
        out = {"doc": [], "at": [], "n": []}
        for k, x in enumerate(gone):
            if len(x):
                cuts = np.flatnonzero(np.r_[True, x[1:] != x[:-1] + 1])
                ends = np.r_[cuts[1:], len(x)]
                out["doc"] += [doc[k]] * len(cuts)
                out["at"] += (start[k] + x[cuts]).tolist()
                out["n"] += (ends - cuts).tolist()
        return pd.DataFrame({k: pd.Series(v, dtype="int64") for k, v in out.items()})
    return run


STRINGS_HELD = 1 << 18  # strings that a task combines at once, some 20 MB


def _string_rows(length: int):
    """Strings of segments: ``doc, at, n, h1, h2, copy``.

    A row is the first holder of a string among those at hand, known by two
    64-bit hashes, or a run of ``n`` strings that all have an earlier holder
    among them (``copy``).
    """
    def combined(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        doc, at, h1, h2 = (np.concatenate([p[k] for p in parts]) for k in range(4))
        order = np.lexsort((at, doc, h2, h1))
        copy = np.zeros(len(order), bool)
        x, y = h1[order], h2[order]
        copy[order[1:]] = (x[1:] == x[:-1]) & (y[1:] == y[:-1])
        gone = np.flatnonzero(copy)
        gone = gone[np.lexsort((at[gone], doc[gone]))]
        d, a = doc[gone], at[gone]
        cuts = np.flatnonzero(np.r_[True, (d[1:] != d[:-1]) | (a[1:] != a[:-1] + 1)]) if len(gone) else gone
        n, first = np.diff(np.append(cuts, len(gone))), ~copy
        columns = {"doc": np.r_[doc[first], d[cuts]], "at": np.r_[at[first], a[cuts]], "n": np.r_[np.ones(first.sum(), np.int64), n],
                   "h1": np.r_[h1[first], np.zeros(len(cuts), np.int64)], "h2": np.r_[h2[first], np.zeros(len(cuts), np.int64)],
                   "copy": np.r_[np.zeros(first.sum(), bool), np.ones(len(cuts), bool)]}
        return _rows(columns, [pa.int64()] * 5 + [pa.bool_()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in slices(batches):
            for doc, start, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                data = np.frombuffer(text, np.uint8)
                h1, h2 = (Prefix(data, k).grams(length).view(np.int64) for k in (0, 1))
                parts.append((np.full(len(h1), doc, np.int64), start + np.arange(len(h1)), h1, h2))
                held += len(h1)
                if held >= STRINGS_HELD:
                    yield combined(parts)
                    parts, held = [], 0
        if held:
            yield combined(parts)
    return run


def repeated_spans(docs: DataFrame, length: int = 100, anchor: int = 32, collection_rows: int = 1024) -> DataFrame:
    """Runs of repeated starts of ``docs(doc, bytes)``: ``doc, at, n`` says that the strings at
    ``at .. at + n - 1`` also start earlier. ``doc`` is a dense order of the documents, unique.
    """
    if not 0 < anchor <= length < 1 << 16:
        raise ValueError("0 < anchor <= length < 65536")
    spark = docs.sparkSession
    scanned = docs.select("doc", "bytes").mapInArrow(_segment_rows(length, anchor), "doc long, place long, mark int, seg long, sides int")
    # One shuffle by anchor, which every window below keeps. Copies told apart in the scan are spread.
    scanned = scanned.withColumn("mark", F.when(F.col("place") < 0, F.hash("doc", "place")).otherwise(F.col("mark")))
    told = scanned.repartition("mark").withColumn("copy", F.col("place") < 0)
    held = Window.partitionBy("mark", "copy", "seg").orderBy("doc", "place")
    told = told.withColumn("copy", F.col("copy") | F.lag("seg").over(held).isNotNull())
    # All that are no copies differ within their anchor. Who shares a side with another one?
    for name, value in (("left", F.shiftrightunsigned("sides", 16)), ("right", F.col("sides").bitwiseAND(0xFFFF))):
        told = told.withColumn(name, value)
        w = Window.partitionBy("mark", "copy", name).orderBy("seg")
        near = F.lag("seg").over(w).isNotNull() | F.lead("seg").over(w).isNotNull()
        told = told.withColumn(name, F.when(near & (F.col(name) > 0) & ~F.col("copy"), F.col(name)))
    path = scratch(spark, "segments")
    told = told.filter("copy or left is not null or right is not null")
    told.select("doc", "place", "mark", "left", "right", "copy").write.parquet(path)
    told = spark.read.parquet(path).withColumn("place", F.abs("place"))
    told = told.withColumn("start", F.shiftright("place", 16)).withColumn("starts", F.col("place").bitwiseAND(0xFFFF))
    copies = told.filter("copy").select("doc", F.col("start").alias("at"), F.col("starts").alias("n"))
    needed = told.filter("not copy").withColumn("mark", F.col("mark").cast("long"))
    n = needed.count()
    if not n:
        return copies
    # An anchor with more segments than a collection should hold is no collection of its own, however many
    # share a side: its segments are taken apart into strings.
    many = cut(needed.groupBy("mark").count().filter(F.col("count") > collection_rows).select("mark", F.lit(True).alias("many")))
    if not many.limit(1).count():
        return copies.union(_in_collections(docs, needed, n, length, collection_rows))
    needed = needed.join(many, "mark", "left")
    few = needed.filter("many is null")
    lent = _lent(docs, needed.filter("many"), length).select("doc", "start", "bytes")
    strings = lent.mapInArrow(_string_rows(length), "doc long, at long, n long, h1 long, h2 long, copy boolean")
    # Copies told apart are spread; of any other string a task keeps one row.
    strings = strings.withColumn("h1", F.when(F.col("copy"), F.xxhash64("doc", "at")).otherwise(F.col("h1")))
    held = Window.partitionBy("h1", "h2", "copy").orderBy("doc", "at")
    again = strings.withColumn("again", F.col("copy") | F.lag("doc").over(held).isNotNull()).filter("again").select("doc", "at", "n")
    # A string that is not the first of its collection is a repeat in every copy of its segment, which the
    # copies' rows say already.
    return copies.union(again).union(_in_collections(docs, few, n, length, collection_rows))


def _lent(docs: DataFrame, needed: DataFrame, length: int) -> DataFrame:
    """The bytes of segments that differ, ``doc, start, mark, bytes``: each document lends them in one pass."""
    asked = needed.groupBy("doc").agg(F.collect_list(F.struct("start", "starts", "mark")).alias("asked"))
    lent = docs.join(asked, "doc").select("doc", "bytes", F.explode("asked").alias("a"))
    return lent.select("doc", F.col("a.start").alias("start"), F.col("a.mark").alias("mark"),
                       F.substring("bytes", (F.col("a.start") + 1).cast("int"), (F.col("a.starts") + length - 1).cast("int")).alias("bytes"))


def _in_collections(docs: DataFrame, needed: DataFrame, n: int, length: int, collection_rows: int) -> DataFrame:
    """Repeats among the segments of anchors that fit a collection; ``n`` segments at most."""
    lent = _lent(docs, needed, length).withColumn("part", F.pmod(F.xxhash64("mark"), F.lit(max(1, -(-n // collection_rows)))))
    return lent.groupBy("part").applyInPandas(_collection(length), "doc long, at long, n long")


def dedup_substrings(docs: DataFrame, length: int = 100, anchor: int = 32, id_col: str = "doc_id", text_col: str = "text",
                    collection_rows: int = 1024) -> DataFrame:
    """Remove repeated bytes: ``id, n_bytes, n_removed, n_spans, kept`` (binary), and ``spans (start, end)``.

    Every byte covered by a ``length``-byte string that also starts earlier
    (smaller id, or same document and earlier start) goes; matches never
    cross documents, overlaps count, and strings are judged on the input.
    A null text is empty. Rows that share an id are ordered by text; a null
    id comes before all others. Empty tables give no rows; other columns are not read.
    """
    raw = F.coalesce(F.encode(F.col(f"`{text_col}`"), "UTF-8"), F.lit(b""))
    base = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), raw.alias("bytes"))
    # Documents are told apart by id and text; ids alone are the order whenever they are unique.
    twice = base.select("id").groupBy("id").count().filter("count > 1 or id is null").limit(1).count()
    if twice:
        key = Window.partitionBy("id").orderBy("bytes")
        base = cut(base.withColumn("_n", F.row_number().over(key)))
        span = base.agg(F.max("_n")).first()[0]
        rank = _dense(cut(base.select("id").distinct()))
        base = base.alias("b").join(rank.alias("r"), F.col("b.id").eqNullSafe(F.col("r.id"))).select(
            F.col("b.id").alias("id"), "bytes", (F.col("r.rank") * span + F.col("_n")).alias("doc"))
        base = cut(base)
    else:
        # The same two columns for both joins below, so that they share one shuffle of the texts.
        base = base.select(F.col("id").alias("doc"), "bytes").filter("doc is not null")
    runs = repeated_spans(base, length, anchor, collection_rows)
    gone = runs.groupBy("doc").agg(F.sort_array(F.collect_set(F.struct("at", "n"))).alias("runs"))
    joined = base.join(gone, "doc", "left").select("id" if twice else F.col("doc").alias("id"), "bytes", "runs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = {"id": batch.column(0).to_pylist(), "n_bytes": [], "n_removed": [], "n_spans": [], "kept": [], "spans": []}
            for data, runs_ in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                spans: list[list[int]] = []
                for r in runs_ or []:
                    a, b = r["at"], r["at"] + r["n"] + length - 1
                    if spans and a <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], b)
                    else:
                        spans.append([a, b])
                kept, at = [], 0
                for a, b in spans:
                    kept.append(data[at:a])
                    at = b
                kept.append(data[at:])
                out["n_bytes"].append(len(data))
                out["n_removed"].append(sum(b - a for a, b in spans))
                out["n_spans"].append(len(spans))
                out["kept"].append(b"".join(kept))
                out["spans"].append([{"start": a, "end": b} for a, b in spans])
            yield _rows(out, [pa.int64()] * 4 + [pa.binary(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))])

    return joined.mapInArrow(run, "id long, n_bytes long, n_removed long, n_spans long, kept binary, spans array<struct<start: long, end: long>>")


def _dense(ids: DataFrame, share: int = 4096) -> DataFrame:
    """Order-preserving numbers of distinct ids, null first.

    Two levels of ranges: quantiles of the ids cut them into ranges of about
    ``share`` ids, however the ids lie; a window numbers each range, and the
    ranges' counts (one row per range) move it up.
    """
    n = ids.count()
    steps = min(10_000, max(1, n // share))
    shares = [k / steps for k in range(1, steps)] or [0.5]
    bounds = ids.agg(F.percentile_approx("id", shares, 10 * steps).alias("q")).first()["q"] or []
    keyed = ids.filter("id IS NOT NULL").withColumn("_b", _below(sorted(set(bounds)), "id"))
    per = {r["_b"]: r["count"] for r in keyed.groupBy("_b").count().collect()}  # at most steps rows
    at = n - sum(per.values())  # the null, if there is one
    before = []
    for b in sorted(per):
        before.append((b, at))
        at += per[b]
    spark = ids.sparkSession
    side = spark.createDataFrame(before, "_b int, _before long")
    w = Window.partitionBy("_b").orderBy("id")
    out = keyed.join(F.broadcast(side), "_b").select("id", (F.col("_before") + F.row_number().over(w)).alias("rank"))
    return out.union(ids.filter("id IS NULL").select("id", F.lit(1).cast("long").alias("rank")))


def _below(bounds: list[int], column: str) -> Column:
    """How many of the sorted ``bounds`` lie below the column, by halving."""
    if not bounds:
        return F.lit(0)
    listed = "array(" + ", ".join(f"bigint('{b}')" for b in bounds) + ")"
    step = "lo + shiftleft(1, s)"
    return F.expr(f"aggregate(sequence({len(bounds).bit_length() - 1}, 0, -1), 0, (lo, s) -> "
                  f"CASE WHEN {step} <= {len(bounds)} AND element_at({listed}, {step}) < {column} THEN {step} ELSE lo END)")
