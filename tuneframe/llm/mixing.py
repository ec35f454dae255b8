"""Mixing sources to target weights: Sainte-Lague apportionment of equal-token blocks.

The mix is a sequence of seats, blocks of equally many words for all
sources. Seats are awarded to sources one by one by highest quotient
``target / (2 * awarded + 1)``; shard ``k`` of the mix is the ``k``-th interval
of that sequence, which gives integer quotas per shard. The seat is small
enough for the smallest target to be several of them.

Each source is laid out as one line of words in a seeded order and cut into
stretches, which a seeded permutation puts in order: an affine map modulo
their number, so selection needs no sort. A source's seats are filled with
the words of that order, from its beginning and over again, so it gives just
as many words as it was awarded, and the words between two quotas are a
shard's. Only the last stretch may be taken in part.
"""

from __future__ import annotations

import heapq
import math
import random
import re
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from tuneframe.llm.common import WORD, cut, slices, slots, small_batches

#: Seats that the smallest target is worth at least.
LEAST_SEATS = 8


def targets(sizes: list[int], weights: list[float], limit: float = 3.0) -> list[float]:
    """Share all words by weight; nobody above ``limit`` times its size, the excess reshared."""
    left, out = float(sum(sizes)), [0.0] * len(sizes)
    open_ = list(range(len(sizes)))
    while open_:
        unit = sum(weights[i] for i in open_)
        over = [i for i in open_ if left * weights[i] / unit > limit * sizes[i]]
        if not over:
            for i in open_:
                out[i] = left * weights[i] / unit
            break
        for i in over:
            out[i] = limit * sizes[i]
        # Recomputed from the whole, so rounding does not pile up.
        open_ = [i for i in open_ if i not in set(over)]
        left = max(0.0, float(sum(sizes)) - sum(out[i] for i in range(len(sizes)) if i not in set(open_)))
    return out


def sainte_lague(votes: list[float], seats: int, caps: list[int]) -> list[int]:
    """Seats by highest quotients ``votes / (2 * seats + 1)``, none above its cap; ties to the lower index.

    A divisor close to the last quotient gives nearly all seats at once, the
    few that are left are awarded one by one.
    """
    live = [i for i, v in enumerate(votes) if v > 0 and caps[i] > 0]
    given = [0] * len(votes)
    seats = min(seats, sum(caps[i] for i in live))
    if seats <= 0:
        return given

    def at(divisor: float) -> list[int]:
        return [min(caps[i], math.floor(votes[i] / divisor + 0.5)) for i in live]

    low, high = 0.0, 4.0 * max(votes) + 1.0  # low: too many seats; high: none
    for _ in range(200):
        mid = (low + high) / 2
        if mid in (low, high) or mid == 0:
            break
        if sum(at(mid)) > seats:
            low = mid
        else:
            high = mid
    for i, n in zip(live, at(high), strict=True):
        # One fewer where the divisor is so close that rounding could have given a seat too many.
        given[i] = max(0, n - 1)
    heap = [(-votes[i] / (2 * given[i] + 1), i) for i in live if given[i] < caps[i]]
    heapq.heapify(heap)
    for _ in range(seats - sum(given)):
        _, i = heapq.heappop(heap)
        given[i] += 1
        if given[i] < caps[i]:
            heapq.heappush(heap, (-votes[i] / (2 * given[i] + 1), i))
    return given


def permutation(blocks: int, seed: str) -> tuple[int, int]:
    """``(a, c)``: ``(a * block + c) mod blocks`` visits every block once. ``a`` stays below 2**20."""
    rng = random.Random(seed)
    a, c = rng.randrange(1, 1 << 20), rng.randrange(max(1, blocks))
    while math.gcd(a, max(1, blocks)) != 1:
        a = a % (1 << 20) + 1
    return a, c


def seat_of(goal: list[float], block: int) -> int:
    """Words of a seat: ``block``, or what makes the smallest target ``LEAST_SEATS`` seats."""
    least = min((g for g in goal if g > 0), default=0.0)
    return max(1, min(block, math.floor(least / LEAST_SEATS)))


def plan(spark, sources: list[tuple[str | None, int]], block: int, shards: int, seed: int, limit: int = 3) -> DataFrame:
    """One row per source: its target, its seats in all and per shard, its words in the mix, its permutation.

    ``sources`` are ``(name, words)``. They are ranked by code point, null
    last, and weigh 1, 2, 3, repeating. The list is the mixture's own recipe
    (one entry per source, never per document) and lives on the driver.
    """
    # Python orders strings by code point.
    ranked = sorted(sources, key=lambda s: (s[0] is None, s[0] or ""))
    sizes, weights = [s[1] for s in ranked], [float(1 + i % 3) for i in range(len(ranked))]
    goal = targets(sizes, weights, float(limit))
    seat = seat_of(goal, block)
    caps = [-(-limit * n // seat) for n in sizes]
    seats = round(sum(goal) / seat)
    upto = [sainte_lague(goal, round(seats * k / shards), caps) for k in range(shards + 1)]
    rows = []
    for i, (name, n) in enumerate(ranked):
        blocks = max(1, -(-n // block))
        a, c = permutation(blocks, f"{seed}/{name!r}")
        # A source at its limit ends with a seat in part.
        bounds = [min(u[i] * seat, limit * n) for u in upto]
        quota = [upto[k + 1][i] - upto[k][i] for k in range(shards)]
        rows.append((name, i, n, goal[i], seat, upto[-1][i], bounds[-1], block, blocks, a, c, quota, bounds))
    return spark.createDataFrame(rows, "source string, source_rank int, source_size long, target double, seat long, quota long, words long, "
                                 "block long, blocks long, a long, c long, shard_quota array<long>, bounds array<long>")


# The stretch b of a line has ``len`` words and stands at ``at`` in its source's order.
_LEN = "least(block, source_size - b * block)"
_RANK = "pmod(a * b + c, blocks)"
_AT = f"""({_RANK}) * block - CASE WHEN pmod(a * (blocks - 1) + c, blocks) < {_RANK}
          THEN blocks * block - source_size ELSE 0 END"""
# Of it, the document has the words from ``low`` to ``high``; turn t takes those that stand before the source's words end.
_LOW = "greatest(position - b * block, 0L)"
_HIGH = f"least(position + size - b * block, {_LEN})"
_WORDS = f"least({_HIGH}, words - t * source_size - ({_AT})) - {_LOW}"
_TAKES = f"""filter(flatten(transform(
  CASE WHEN size > 0 THEN sequence(position div block, (position + size - 1) div block) ELSE cast(array() AS array<bigint>) END,
  b -> transform(sequence(0, {{turns}} - 1), t -> named_struct(
    'turn', t, 'start', b * block + {_LOW} - position, 'words', {_WORDS},
    'shard', size(filter(slice(bounds, 1, size(bounds) - 1), x -> x <= t * source_size + ({_AT}) + {_LOW})) - 1)))), x -> x.words > 0)"""


def mix(docs: DataFrame, block: int = 64, shards: int = 8, seed: int = 7, id_col: str = "doc_id",
        text_col: str = "text", source_col: str = "source", limit: int = 3) -> tuple[DataFrame, DataFrame]:
    """``(documents, plan)``: what the mix takes of every document, and the recipe.

    The documents have ``id, source, text_hash, size, source_size, target,
    position, takes, taken``: ``position`` is the document's first word on its
    source's line, ``takes`` the stretches of it that the mix takes, each
    with the turn through the source, its first word, its words and the
    shard that its first word falls to, ``taken`` its words in the mix, repeats counted. A source gives at
    most ``limit`` times its words, so no document is taken more often.
    ``block`` is the length of a stretch and the most that a seat is worth.
    Null texts have no words; a null source is a source of
    its own, last. Repeated rows count as rows of their own and lie next to
    each other; equal rows are interchangeable. Empty tables give no rows.
    ``docs`` may have any other columns.
    """
    spark = docs.sparkSession
    text = F.col(f"`{text_col}`")
    base = cut(docs.select(
        F.col(f"`{id_col}`").alias("id"), F.col(f"`{source_col}`").cast("string").alias("source"),
        F.xxhash64(text).alias("text_hash"),
        F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
    ))
    sources = [(r["source"], r["n"]) for r in base.groupBy("source").agg(F.sum("size").alias("n")).collect()]
    recipe = plan(spark, sources, block, shards, seed, limit)
    # One row per source, and the list has just passed through the driver: safe to broadcast.
    side = F.broadcast(recipe.drop("shard_quota"))
    known = base.alias("d").join(side.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source")))
    known = known.select("d.*", *[f"s.{c}" for c in recipe.columns if c not in ("source", "shard_quota")])
    known = known.withColumn("_seeded", F.xxhash64(F.lit(seed), "id", "text_hash"))
    laid = slots(known, ["source_rank"], ["_seeded", "id", "text_hash"], name="position", size="size")
    out = laid.withColumn("takes", F.expr(_TAKES.format(turns=int(limit))))
    taken = F.aggregate("takes", F.lit(0).cast("long"), lambda n, x: n + x["words"])
    return out.withColumn("taken", taken).select(
        "id", "source", "text_hash", "size", "source_size", "target", "position", "takes", "taken"), recipe


def mixed_texts(docs: DataFrame, block: int = 1024, shards: int = 8, seed: int = 7, id_col: str = "doc_id",
                text_col: str = "text", source_col: str = "source", shard_col: str | None = None) -> DataFrame:
    """The mix itself: a row for each turn that takes words of a document, with all columns of ``docs``.

    The text is the document's own from the first to the last word of each
    stretch that is taken, stretches joined by a line feed where words lie
    between them; a turn that takes all words keeps the text as it is.
    Documents without words are not taken. With ``shard_col`` there is a row
    for each turn and shard, and a last column of that name with the shard.
    Columns of ``docs`` may have any names.
    """
    taken, _ = mix(docs, block, shards, seed, id_col, text_col, source_col)
    # The caller's columns travel in one struct: no name of theirs meets one of ours.
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.xxhash64(F.col(f"`{text_col}`")).alias("h"),
                       F.col(f"`{id_col}`").alias("i"), F.col(f"`{source_col}`").cast("string").alias("s"))
    # Equal rows are interchangeable; they are told apart by their number.
    same = taken.groupBy("id", "text_hash", "source").count().filter("count > 1").limit(1).count()
    left, right = rows.withColumn("n", F.lit(1)), taken.withColumn("n", F.lit(1))
    if same:
        left = rows.withColumn("n", F.row_number().over(Window.partitionBy("i", "h", "s").orderBy("h")))
        right = taken.withColumn("n", F.row_number().over(Window.partitionBy("id", "text_hash", "source").orderBy("position")))
    right = right.filter("taken > 0").select("id", "text_hash", "source", "n", "takes")
    joined = left.alias("l").join(right.alias("r"), (F.col("l.h") == F.col("r.text_hash")) & (F.col("l.n") == F.col("r.n"))
                                  & F.col("l.i").eqNullSafe(F.col("r.id")) & F.col("l.s").eqNullSafe(F.col("r.source")))
    at = docs.columns.index(text_col)
    picked = joined.select(*[F.col(f"l.row.`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)], F.col("r.takes").alias("takes"))

    def run(batches):
        for batch in slices(batches):
            keep, texts, where = [], [], []
            for k, (text, takes) in enumerate(zip(batch.column(at).to_pylist(), batch.column(-1).to_pylist(), strict=True)):
                for _, shard, made in passes(text, takes, shard_col is not None):
                    keep.append(k)
                    texts.append(made)
                    where.append(shard)
            cols = [c.take(pa.array(keep, pa.int64())) for c in batch.columns[:-1]]
            cols[at] = pa.array(texts, pa.string())
            if shard_col is not None:
                cols.append(pa.array(where, pa.int32()))
            yield pa.RecordBatch.from_arrays(cols, names=[f"c{i}" for i in range(len(cols))])

    small_batches(docs.sparkSession)
    fields = [StructField(f"c{i}", f.dataType) for i, f in enumerate(docs.schema)]
    names = list(docs.columns)
    if shard_col is not None:
        fields.append(StructField(f"c{len(fields)}", IntegerType()))
        names.append(shard_col)
    out = picked.mapInArrow(run, StructType(fields))
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)])


def passes(text: str, takes: list[dict], by_shard: bool = False) -> list[tuple[int, int | None, str]]:
    """``(turn, shard, text)`` of what each turn, or each turn and shard, takes of a text."""
    words = [m.span() for m in re.finditer(WORD, text)]
    groups: dict[tuple[int, int | None], list[list[int]]] = defaultdict(list)
    for x in sorted(takes, key=lambda x: (x["turn"], x["start"])):
        runs = groups[x["turn"], x["shard"] if by_shard else None]
        if runs and runs[-1][1] == x["start"]:
            runs[-1][1] += x["words"]
        else:
            runs.append([x["start"], x["start"] + x["words"]])
    out = []
    for (turn, shard), runs in groups.items():
        whole = runs == [[0, len(words)]]
        out.append((turn, shard, text if whole else "\n".join(text[words[a][0] : words[b - 1][1]] for a, b in runs)))
    return out
