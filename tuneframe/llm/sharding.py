"""Sharding: minimax contiguous partition of ordered atomic groups (native).

Documents with equal text form one atomic group, so copies never end up on
both sides of a shard border. Groups are ordered by a fixed 64-bit hash of
their text, which makes every shard an unbiased slice of the corpus. The
smallest feasible shard capacity is found by binary search, each candidate
checked greedily, and the order is cut there.

At scale the groups stay distributed. The driver sees a radix histogram of
the order: the bytes in each of 65,536 key ranges, and, only around the few
places where the search has not decided yet, of their sub-ranges. It bounds
the greedy position from below (cuts at range borders) and above (cuts
anywhere), so a capacity is accepted or refused only when that is proven.
"""

from __future__ import annotations

import bisect
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tuneframe.llm.common import cut, slots

BITS = 16


class Cells:
    """Key ranges in order; ``(first key, level, weight, groups)``. Keys run from 0 to 2**64 - 1."""

    def __init__(self, rows: list[tuple[int, int, int, int]]):
        self.rows = sorted(rows)
        self.start = [0]
        for r in self.rows:
            self.start.append(self.start[-1] + r[2])
        self.total = self.start[-1]

    def floor(self, at: int) -> int:
        """Largest range border at or below ``at``."""
        return self.start[bisect.bisect_right(self.start, at) - 1]

    def ceil(self, at: int) -> int:
        return self.start[min(bisect.bisect_left(self.start, at), len(self.start) - 1)]

    def reach(self, at: int) -> int:
        """No group border at or below ``at`` lies above this: a range of one group can't be cut."""
        if at >= self.total:
            return self.total
        k = bisect.bisect_right(self.start, at) - 1
        return self.start[k] if self.rows[k][3] == 1 else at

    def greedy(self, capacity: int, shards: int) -> list[tuple[int, int]]:
        """Bounds of the greedy position after each shard."""
        low = high = 0
        out = []
        for _ in range(shards):
            low, high = min(self.floor(low + capacity), self.total), self.reach(high + capacity)
            out.append((low, high))
        return out

    def undecided(self, bounds: list[tuple[int, int]]) -> list[int]:
        """Ranges of several groups between the two bounds of any position."""
        hit = set()
        for low, high in bounds:
            a = bisect.bisect_right(self.start, low) - 1
            b = bisect.bisect_left(self.start, min(high + 1, self.total))
            hit.update(k for k in range(a, min(b, len(self.rows))) if self.rows[k][3] > 1)
        return sorted(hit)


def search(cells: Cells, shards: int, refine: Callable[[Cells, list[int]], Cells], at_least: int) -> tuple[int, Cells]:
    """The smallest capacity for which ``shards`` contiguous shards hold everything."""
    low = max(at_least, -(-cells.total // shards)) - 1  # infeasible
    high = max(cells.total, low + 1)  # feasible
    while True:
        # Bounds that are proven on the ranges known so far.
        a, b = low, high
        while a + 1 < b:
            mid = (a + b) // 2
            if cells.greedy(mid, shards)[-1][0] >= cells.total:
                b = mid
            else:
                a = mid
        high = b
        a, b = low, high
        while a + 1 < b:
            mid = (a + b) // 2
            if cells.greedy(mid, shards)[-1][1] < cells.total:
                a = mid
            else:
                b = mid
        low = a
        if low + 1 >= high:
            return high, cells
        least, most = cells.greedy(low + 1, shards), cells.greedy(high - 1, shards)
        need = cells.undecided([(x[0], y[1]) for x, y in zip(least, most, strict=True)])
        if not need:
            return high, cells
        cells = refine(cells, need)


def even_cuts(cells: Cells, capacity: int, shards: int) -> list[int]:
    """Range indices where shards 1.. start: as even as the capacity allows."""
    # Smallest position from which the rest fits into the shards that are left.
    back = [cells.total]
    for _ in range(shards - 1):
        back.append(cells.ceil(max(0, back[-1] - capacity)))
    back = back[::-1]  # back[j]: what follows fits into the last shards - 1 - j shards
    cuts, at = [], 0
    for j in range(shards - 1):
        want = at + (cells.total - at) / (shards - j)
        k = bisect.bisect_left(cells.start, want)
        near = min((x for x in (k - 1, k) if 0 <= x < len(cells.start)), key=lambda x: abs(cells.start[x] - want))
        at = min(max(cells.start[near], back[j], at), cells.floor(at + capacity))
        cuts.append(bisect.bisect_left(cells.start, at))
    return cuts


def _radix(groups: DataFrame, level: int) -> DataFrame:
    """Weight and number of groups by the leading ``BITS * level`` bits of the key."""
    shift = 64 - BITS * level
    # An unsigned order: the sign bit of the hash is turned over.
    return groups.groupBy(F.shiftright(F.col("key"), shift).alias("cell")).agg(
        F.sum("weight").alias("weight"), F.count(F.lit(1)).alias("groups")
    )


def minimax(groups: DataFrame, shards: int) -> tuple[int, list[int]]:
    """Smallest capacity and the first keys of shards 1.. for ``groups(key, weight)``.

    ``groups`` holds one row per atomic group, read a few times. Empty input
    gives capacity 0.
    """
    def rows(df, level):
        shift = 64 - BITS * level
        return [((r["cell"] << shift) + (1 << 63), level, r["weight"], r["groups"]) for r in df.collect()]

    most = groups.agg(F.max("weight")).first()[0]
    if most is None:
        return 0, []

    def refine(cells: Cells, need: list[int]) -> Cells:
        keep = [r for k, r in enumerate(cells.rows) if k not in set(need)]
        new = []
        for level in sorted({cells.rows[k][1] for k in need}):
            shift = 64 - BITS * level
            chosen = [(cells.rows[k][0] - (1 << 63)) >> shift for k in need if cells.rows[k][1] == level]
            part = groups.filter(F.shiftright(F.col("key"), shift).isin(chosen))
            new += rows(_radix(part, level + 1), level + 1)
        return Cells(keep + new)

    capacity, cells = search(Cells(rows(_radix(groups, 1), 1)), shards, refine, most)
    firsts = []
    for k in even_cuts(cells, capacity, shards):
        firsts.append(cells.rows[k][0] - (1 << 63) if k < len(cells.rows) else None)
    return capacity, firsts


def shard_documents(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Put every row into one of ``shards`` contiguous shards of near equal bytes.

    Returns ``id, size, text_crc32, key, shard, slot``. ``size`` is the UTF-8
    length plus 1, ``key`` the order of the groups, ``slot`` the gapless
    position inside the shard. Documents with equal text share a shard; a
    null text counts as an empty one. Two different texts with equal 64-bit
    hash would share a shard as well, which breaks no rule. Repeated rows
    stay rows of their own. A group heavier than an even share makes its
    shard that heavy; the others share the rest evenly. An empty table gives
    no rows. Other columns of ``docs`` are not read, so their names can't clash.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = cut(docs.select(
        F.col(id_col).alias("id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).cast("long").alias("text_crc32"),
        F.xxhash64(text).alias("key"),
    ))
    groups = cut(base.groupBy("key").agg(F.sum("size").alias("weight")))
    _, firsts = minimax(groups, shards)
    shard = F.lit(0)
    for first in firsts:
        if first is not None:
            shard = shard + F.when(F.col("key") >= F.lit(first), 1).otherwise(0)
    return slots(base.withColumn("shard", shard.cast("int")), ["shard"], ["id", "key"])
