"""Vector code compression: product codes whose nearest entries are found by slices and bitmasks.

A vector becomes integers and is cut into parts; each part position has a
codebook, fitted in rounds. The nearest entry of a part is found exactly by
slicing: in every dimension the entries' coordinates are sorted, and each
prefix of the sorted list carries a mask of the entries in it, as 64-bit
words. A radius around the part's coordinate is a range of the list, the
two ends' masks give the entries in the range, and the masks of all
dimensions are ANDed. What is left lies in a box around the part; distances
are computed for these candidates only. If the nearest of them is farther
than the radius, or none is left, the radius grows and the part is looked
up again, so every entry within the final distance, ties included, has been
compared.

Codebooks are of fixed size; they travel with the tasks. Tasks send sums
per entry, not vectors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tuneframe.llm.common import cut, slices
from tuneframe.llm.topk import usable

#: Components are held within this, so that no sum of squares leaves 64 bits.
LIMIT = 2**26
BROADCAST_GROUPS = 100_000


class SliceIndex:
    """Exact nearest entry, ties to the lower index, of one codebook (entries x dimensions, integers)."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        n, dims = entries.shape
        self.words = -(-n // 64)
        order = np.argsort(entries, axis=0, kind="stable")
        self.coords = np.take_along_axis(entries, order, axis=0).T.copy()
        bits = np.zeros((dims, n + 1, self.words), dtype=np.uint64)
        at = np.arange(n)
        for j in range(dims):
            bits[j, at + 1, order[:, j] // 64] = np.left_shift(np.uint64(1), (order[:, j] % 64).astype(np.uint64))
        self.prefix = np.bitwise_or.accumulate(bits, axis=1)
        # The first radius: the usual distance between an entry and the nearest other one.
        square = ((entries[:, None, :] - entries[None, :, :]) ** 2).sum(2) if n > 1 else np.ones((1, 1), dtype=np.int64)
        np.fill_diagonal(square, np.iinfo(np.int64).max)
        near = square.min(1)
        near = near[near < np.iinfo(np.int64).max]
        self.radius = max(1, int(np.sqrt(np.median(near)))) if len(near) else 1

    def box(self, x: np.ndarray, radius: np.ndarray) -> np.ndarray:
        """Masks of the entries within ``radius`` of ``x`` in every dimension."""
        out = np.full((len(x), self.words), np.iinfo(np.uint64).max, dtype=np.uint64)
        for j in range(x.shape[1]):
            low = np.searchsorted(self.coords[j], x[:, j] - radius, "left")
            high = np.searchsorted(self.coords[j], x[:, j] + radius, "right")
            out &= self.prefix[j, high] ^ self.prefix[j, low]
        return out

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index and squared distance of the nearest entry for each row of ``x``, some rows at a time."""
        step = max(1, 2**20 // self.entries.size)
        done = [self._nearest(x[a : a + step]) for a in range(0, len(x), step)]
        return tuple(np.concatenate([d[i] for d in done] or [np.zeros(0, dtype=np.int64)]) for i in (0, 1))

    def _nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        code, best = np.zeros(len(x), dtype=np.int64), np.full(len(x), np.iinfo(np.int64).max)
        todo, radius = np.arange(len(x)), np.full(len(x), self.radius, dtype=np.int64)
        while len(todo):
            masks = self.box(x[todo], radius)
            inside = np.unpackbits(masks.astype("<u8").view(np.uint8), axis=1, bitorder="little")
            row, entry = np.nonzero(inside)
            distance = ((x[todo[row]] - self.entries[entry]) ** 2).sum(1)
            some = np.flatnonzero(np.bincount(row, minlength=len(todo)))
            if len(row):
                first = np.concatenate([[0], np.flatnonzero(np.diff(row)) + 1])
                low = np.minimum.reduceat(distance, first)
                # Entries of a row come in order: the first that has the least distance is the lowest index.
                hit = np.flatnonzero(distance == np.repeat(low, np.diff([*first, len(row)])))
                rows, at = np.unique(row[hit], return_index=True)
                code[todo[rows]], best[todo[rows]] = entry[hit[at]], low
            reach = np.ceil(np.sqrt(best[todo].astype(np.float64))).astype(np.int64) + 1
            done = np.zeros(len(todo), dtype=bool)
            done[some] = best[todo[some]] <= radius[some] ** 2
            wider = np.where(best[todo] < np.iinfo(np.int64).max, np.maximum(reach, radius + 1), radius * 2)
            todo, radius = todo[~done], wider[~done]
        return code, best


def cuts(dims: int, parts: int) -> list[tuple[int, int]]:
    """Consecutive parts of equal length; where ``parts`` don't divide, the first ones hold one component more."""
    short, more = divmod(dims, parts)
    ends = np.cumsum([short + (k < more) for k in range(parts)]).tolist()
    return list(zip([0, *ends[:-1]], ends, strict=True))


def integers(values: np.ndarray, scale: int) -> np.ndarray:
    return np.clip(np.floor(scale * values.astype(np.float64)), -LIMIT, LIMIT).astype(np.int64)


def _vectors(column, dims: int, scale: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return integers(flat, scale).reshape(-1, dims)


def fit(vectors: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> list[np.ndarray]:
    """Codebooks by part position, from ``vectors(id, vec)``: usable rows of one length.

    They start as the parts of the ``entries`` smallest ids; each round moves
    an entry to the floor of the mean of the parts nearest to it, and leaves
    an entry without parts where it is. The rows of each round are summed by
    entry where they lie.
    """
    seeds = vectors.orderBy(F.col("id").asc_nulls_last(), "vec").limit(entries).collect()
    if not seeds:
        return []
    first = integers(np.array([r["vec"] for r in seeds]), scale)
    dims = first.shape[1]
    where = cuts(dims, parts)
    books = [first[:, a:b].copy() for a, b in where]
    for _ in range(rounds):
        indexes = [SliceIndex(b) for b in books]

        def run(batches: Iterator[pa.RecordBatch], indexes=indexes) -> Iterator[pa.RecordBatch]:
            sums = [np.zeros((len(i.entries), i.entries.shape[1] + 1), dtype=np.int64) for i in indexes]
            for batch in slices(batches):
                x = _vectors(batch.column(0), dims, scale)
                for total, index, (a, b) in zip(sums, indexes, where, strict=True):
                    code, _ = index.nearest(x[:, a:b])
                    np.add.at(total, code, np.c_[x[:, a:b], np.ones(len(x), dtype=np.int64)])
            for part, total in enumerate(sums):
                used = np.flatnonzero(total[:, -1])
                width = total.shape[1]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(used) * width, part), pa.int32()), pa.array(np.repeat(used, width), pa.int32()),
                     pa.array(np.tile(np.arange(width), len(used)), pa.int32()), pa.array(total[used].ravel(), pa.int64())],
                    names=["part", "entry", "position", "total"])

        made = vectors.select("vec").mapInArrow(run, "part int, entry int, position int, total long")
        # At most parts * entries * (dimensions of a part + 1) rows: the codebooks' own size.
        new = made.groupBy("part", "entry", "position").agg(F.sum("total").alias("total")).collect()
        totals = [np.zeros((len(b), b.shape[1] + 1), dtype=np.int64) for b in books]
        for r in new:
            totals[r["part"]][r["entry"], r["position"]] = r["total"]
        for book, total in zip(books, totals, strict=True):
            used = total[:, -1] > 0
            book[used] = total[used, :-1] // total[used, -1:]
    return books


def books_digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all components in decimal, by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(str(v) for b in books for v in b.ravel().tolist()).encode()).hexdigest()


def encode(vectors: DataFrame, books: list[np.ndarray], scale: int = 1024, carry: list[str] | None = None) -> DataFrame:
    """``id, code, error`` and the carried columns as ``carry_0, ..`` for every row of ``vectors(id, vec)``."""
    carry = carry or []
    where = cuts(sum(b.shape[1] for b in books), len(books))
    dims = where[-1][1]
    indexes = [SliceIndex(b) for b in books]
    kept = vectors.select("vec", "id", *[F.col(f"`{c}`").alias(f"carry_{i}") for i, c in enumerate(carry)])
    names = [*kept.columns[1:], "code", "error"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            x = _vectors(batch.column(0), dims, scale)
            error, codes = np.zeros(len(x), dtype=np.int64), []
            for index, (a, b) in zip(indexes, where, strict=True):
                code, d = index.nearest(x[:, a:b])
                codes.append(code)
                error += d
            text = [bytes(row).hex() for row in np.array(codes).T.astype(np.uint8)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(text, pa.string()), pa.array(error, pa.int64())], names=names)

    fields = ", ".join(f"{n} {t}" for n, t in kept.dtypes[1:])
    return kept.mapInArrow(run, f"{fields}, code string, error long")


def compress(vectors: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024,
             id_col: str = "id", vec_col: str = "vec", carry: list[str] | None = None) -> tuple[DataFrame, list[np.ndarray]]:
    """Fit codebooks on all vectors and encode all: ``(id, code, error, carry_0, ..)`` and the codebooks.

    A component x becomes floor(scale * x), held within 2**26 either way.
    ``code`` has two hex digits per part; ``error`` is the sum of the squared
    distances. Rows whose vector is null, empty or holds a null, NaN or
    infinite component take no part, nor do vectors of another length than
    that of the smallest usable id. Null ids come last; rows that repeat are
    rows of their own; fewer rows than ``entries`` give that many entries;
    an empty table gives no rows and no codebooks. ``entries`` is 256 at
    most. Other columns are read only where ``carry`` names them.
    """
    if not 1 <= entries <= 256:
        raise ValueError("entries must be 1 to 256")
    carry = carry or []
    good = vectors.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vec_col}`").alias("vec"),
                          *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(carry)]).filter(usable(F.col("vec")))
    head = good.orderBy(F.col("id").asc_nulls_last(), "vec").select(F.size("vec")).first()
    if head is None:
        empty = good.select("id", *[F.col(f"c{i}").alias(f"carry_{i}") for i in range(len(carry))],
                            F.lit("").alias("code"), F.lit(0).cast("long").alias("error"))
        return empty.limit(0), []
    good = good.filter(F.size("vec") == head[0])
    books = fit(good, parts, entries, rounds, scale)
    return encode(good, books, scale, [f"c{i}" for i in range(len(carry))]), books


def with_group_error(codes: DataFrame, group: str, name: str) -> DataFrame:
    """Add the error summed over the rows that share ``group``; nulls are one group.

    Sums are combined before the shuffle. Up to 100,000 groups are sent to
    the rows; more are joined by a shuffle, where AQE splits a hot group.
    ``codes`` is read twice: hand in a lineage cut.
    """
    sums = cut(codes.groupBy(F.col(group).alias("_group")).agg(F.sum("error").alias(name)))
    if sums.count() <= BROADCAST_GROUPS:
        sums = F.broadcast(sums)
    return codes.join(sums, F.col(group).eqNullSafe(F.col("_group"))).drop("_group")
