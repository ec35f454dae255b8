"""The ordered auto-repair chain.

fix roles -> merge same-role runs -> drop empty answers -> truncate turns ->
split oversized -> drop duplicate chunks -> (shuffle). Stages R1-R5 are one
projection of higher-order functions per record; R6 is one hash aggregate on
the 32-byte content hash whose minimum combines map-side, so a hash copied a
billion times still leaves each task with one candidate. The summary is a
second aggregate over per-record stage flags (no accumulators: they
over-count when tasks are retried). :mod:`tuneframe.jobs` writes the repaired
dataset and registers it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tuneframe.functions.messages import MESSAGE_TYPE, content_hash
from tuneframe.functions.text import WS_CHARS
from tuneframe.operators.validate import empty_response
from tuneframe.functions.joins import attach_row


@dataclass(frozen=True)
class RepairOptions:
    fix_roles: bool = True
    merge_consecutive_same_role: bool = True
    remove_duplicates: bool = True
    remove_empty_responses: bool = True
    max_turn_chars: int | None = None
    split_oversized: int | None = None
    shuffle: bool = False
    shuffle_seed: int = 42


def _ws_sql() -> str:
    return "'" + WS_CHARS.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _bound(m: str, body: str) -> str:
    """``body`` over ``mm``, with ``m`` stated once: long expressions don't multiply in the plan."""
    return f"get(transform(array({m}), mm -> {body}), 0)"


def fix_roles_expr(m: str) -> str:
    """Drop leading turns whose role is not system/user."""
    first_ok = "array_position(transform(mm, x -> x.role IN ('system', 'user')), true)"
    rest = f"transform(array({first_ok}), k -> CASE WHEN k = 0 THEN slice(mm, 1, 0) ELSE slice(mm, k, size(mm) - k + 1) END)"
    return _bound(m, f"get({rest}, 0)")


def merge_expr(m: str) -> str:
    """R2: merge adjacent equal non-system roles; the merged content is stripped after every step.

    First the positions where a run begins, then one slice and one join per
    run, linear in the number of turns. Stripping after every step means:
    blank contents vanish, all others lose their trailing white space when
    the next one is joined on, and the run its leading one; only a first
    content that the second follows at once keeps its trailing white space.
    """
    ws = _ws_sql()
    begins = "filter(sequence(1, size(mm)), i -> i = 1 OR mm[i - 1].role = 'system' OR mm[i - 1].role <> mm[i - 2].role)"
    # A run's role and contents, by the position it begins at and the one the next begins at.
    run = (
        "named_struct('role', mm[b - 1].role, 'c', "
        "transform(slice(mm, b, coalesce(try_element_at(bs, j + 2), size(mm) + 1) - b), x -> x.content))"
    )
    full = f"filter(r.c, c -> btrim(c, {ws}) <> '')"
    first = f"btrim(r.c[0], {ws}) <> '' AND btrim(r.c[1], {ws}) <> ''"
    joined = f"ltrim({ws}, array_join(transform({full}, (c, k) -> CASE WHEN k = 0 AND {first} THEN c ELSE rtrim({ws}, c) END), '\n'))"
    merged = f"named_struct('role', r.role, 'content', CASE WHEN size(r.c) = 1 THEN r.c[0] ELSE {joined} END)"
    runs = f"flatten(transform(array({begins}), bs -> transform(transform(bs, (b, j) -> {run}), r -> {merged})))"
    return _bound(m, f"CASE WHEN size(mm) < 2 THEN mm ELSE {runs} END")


def truncate_expr(m: str, n: int) -> str:
    """Cut every content to ``n`` code points."""
    return f"transform({m}, x -> named_struct('role', x.role, 'content', substring(x.content, 1, {int(n)})))"


def split_expr(m: str, n: int) -> str:
    """Consecutive chunks of ``n`` turns."""
    n = int(n)
    cut = f"transform(sequence(0, size(mm) - 1, {n}), i -> slice(mm, i + 1, {n}))"
    return _bound(m, f"CASE WHEN size(mm) > {n} THEN {cut} ELSE array(mm) END")


def repair_stages(df: DataFrame, opts: RepairOptions = RepairOptions(), by: list[str] | None = None) -> DataFrame:
    """R1-R5 per record, with the per-record flags the summary counts.

    Returns ``(*by, idx, chunks, roles_fixed, merged, empty_removed, n_truncated,
    n_split, usable)``; ``usable`` is false for records that had no messages.
    """
    by = by or []
    m0 = F.coalesce(
        F.when(~F.coalesce(F.col("norm_error"), F.lit(False)), F.col("messages")), F.expr(f"cast(array() AS {MESSAGE_TYPE})")
    )
    s = df.select(*by, "idx", m0.alias("m0"))
    s = s.withColumn("usable", F.size("m0") > 0)
    s = s.withColumn("m1", F.expr(fix_roles_expr("m0")) if opts.fix_roles else F.col("m0"))
    s = s.withColumn("roles_fixed", F.col("usable") & (F.size("m1") != F.size("m0")))
    s = s.withColumn("m2", F.expr(merge_expr("m1")) if opts.merge_consecutive_same_role else F.col("m1"))
    s = s.withColumn("merged", F.col("usable") & (F.size("m2") < F.size("m1")))
    s = s.withColumn(
        "empty_removed",
        F.col("usable") & empty_response(F.col("m2")) if opts.remove_empty_responses else F.lit(False),
    )
    if opts.max_turn_chars:
        n = int(opts.max_turn_chars)
        s = s.withColumn("n_truncated", F.size(F.filter("m2", lambda x: F.char_length(x["content"]) > n)))
        s = s.withColumn("m3", F.expr(truncate_expr("m2", n)))
    else:
        s = s.withColumn("n_truncated", F.lit(0)).withColumn("m3", F.col("m2"))
    if opts.split_oversized:
        k = int(opts.split_oversized)
        s = s.withColumn("chunks", F.expr(split_expr("m3", k)))
    else:
        s = s.withColumn("chunks", F.array("m3"))
    s = s.withColumn("n_split", F.greatest(F.size("chunks") - 1, F.lit(0)))
    live = F.col("usable") & ~F.col("empty_removed")
    return s.select(
        *by,
        "idx",
        "chunks",
        "usable",
        "roles_fixed",
        "merged",
        "empty_removed",
        F.when(live, F.col("n_truncated")).otherwise(0).cast("bigint").alias("n_truncated"),
        F.when(live, F.col("n_split")).otherwise(0).cast("bigint").alias("n_split"),
    )


def _chunks(stages: DataFrame, by: list[str] | None = None) -> DataFrame:
    live = stages.filter(F.col("usable") & ~F.col("empty_removed"))
    return live.select(*(by or []), "idx", F.posexplode("chunks").alias("chunk", "messages")).filter(F.size("messages") > 0)


def dedupe_chunks(chunks: DataFrame, by: list[str] | None = None) -> DataFrame:
    """First chunk in (idx, chunk) order survives per content hash.

    Only hashes and places are compared: place is one number, so its minimum
    per hash combines map-side. What is joined back are the hashes that
    occur more than once, mostly few: AQE broadcasts them, and messages move
    only where the list is long (a hot hash is then a skewed partition that
    AQE splits).
    """
    by = by or []
    place = F.col("idx").cast("decimal(20,0)") * F.lit(2**31) + F.col("chunk")
    marked = chunks.withColumn("_h", content_hash("messages")).withColumn("_at", place)
    again = marked.groupBy(*by, "_h").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n")
    out = marked.join(again, [*by, "_h"], "left")
    return out.filter(F.col("_first").isNull() | (F.col("_at") == F.col("_first"))).select(*chunks.columns)


def shuffle_order(df: DataFrame, seed: int = 42) -> DataFrame:
    """A seeded deterministic permutation (not Python's generator order)."""
    return df.orderBy(F.xxhash64(F.lit(int(seed)), "idx", "chunk"), "idx", "chunk")


def repair(df: DataFrame, opts: RepairOptions = RepairOptions(), by: list[str] | None = None) -> DataFrame:
    """R9 rows: ``(*by, idx, chunk, messages)`` after the whole chain."""
    return repaired(repair_stages(df, opts, by), opts, by)


def repaired(stages: DataFrame, opts: RepairOptions = RepairOptions(), by: list[str] | None = None) -> DataFrame:
    """The rows of :func:`repair` from the output of :func:`repair_stages`."""
    out = _chunks(stages, by)
    if opts.remove_duplicates:
        out = dedupe_chunks(out, by)
    if opts.shuffle:
        out = shuffle_order(out, opts.shuffle_seed)
    return out


def repair_summary(df: DataFrame, opts: RepairOptions = RepairOptions(), by: list[str] | None = None) -> DataFrame:
    """One row of counters per group."""
    return summary_of(repair_stages(df, opts, by), opts, by)


def summary_of(stages: DataFrame, opts: RepairOptions = RepairOptions(), by: list[str] | None = None) -> DataFrame:
    """R8 from the output of :func:`repair_stages`.

    Without ``by`` there is one row, also for no records.
    """
    by = by or []
    rec = stages.groupBy(*by).agg(
        F.count(F.lit(1)).alias("input_count"),
        F.count_if("roles_fixed").alias("roles_fixed"),
        F.count_if("merged").alias("merged_turns"),
        F.count_if("empty_removed").alias("empty_responses_removed"),
        F.coalesce(F.sum("n_truncated"), F.lit(0)).alias("turns_truncated"),
        F.coalesce(F.sum("n_split"), F.lit(0)).alias("examples_split"),
    )
    chunks = _chunks(stages, by)
    if opts.remove_duplicates:
        per_hash = chunks.groupBy(*by, content_hash("messages").alias("_h")).agg(F.count(F.lit(1)).alias("_c"))
        ch = per_hash.groupBy(*by).agg(F.sum(F.col("_c") - 1).alias("duplicates_removed"), F.count(F.lit(1)).alias("output_count"))
    else:
        ch = chunks.groupBy(*by).agg(F.lit(0).alias("duplicates_removed"), F.count(F.lit(1)).alias("output_count"))
    out = rec.join(ch, by, "left") if by else attach_row(rec, ch)
    cols = [
        "input_count",
        "roles_fixed",
        "merged_turns",
        "duplicates_removed",
        "empty_responses_removed",
        "turns_truncated",
        "examples_split",
    ]
    return out.select(
        *by,
        *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in cols],
        F.lit(bool(opts.shuffle)).alias("shuffled"),
        F.coalesce("output_count", F.lit(0)).cast("bigint").alias("output_count"),
    )
