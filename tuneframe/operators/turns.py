"""V1-V9 directly on a long turn table, without folding conversations.

``fold_turns`` puts one conversation into one array (one task per
conversation). This path keeps turns as rows, so even a conversation with
a third of all turns is processed by many tasks:

* position and previous role of each turn: :func:`ordered.carry_scan`, which
  deals a conversation's turns by blocks of turn numbers, so the texts move
  once and a hot conversation spreads over many tasks;
* per-conversation flags: ``bool_or`` aggregates (partial, map-side);
* content hash: an order-aware multiset hash, two exact DECIMAL sums of
  64-bit hashes of ``(position, role, stripped text)``; equal ordered turn
  lists give equal sums, so duplicates need no fold either.

The flags equal :func:`validate.flag_records` on the folded table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tuneframe.functions.text import CONTROL_CHAR_PATTERN, py_strip
from tuneframe.operators.ordered import carry_scan
from tuneframe.operators.validate import mark_duplicates

HASH_SEEDS = (17, 31)
# Turn numbers that one window task takes of a conversation.
TURN_BLOCK = 4096


def flag_turns(
    turns: DataFrame,
    key: str = "conv_id",
    order: str = "turn",
    role: str = "role",
    text: str = "text",
    block: int = TURN_BLOCK,
) -> DataFrame:
    """Per-conversation flags ``(idx, <categories>, content_hash)``."""
    t = turns.select(
        F.col(key).alias("idx"),
        F.col(order).alias("_o"),
        F.coalesce(F.col(role), F.lit("user")).alias("role"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    t = carry_scan(t, ["idx"], ["_o"], block, last=["role"], position="pos")
    stripped = py_strip(F.col("text"))
    part = [F.col("pos"), F.col("role"), stripped]
    hashes = [F.sum(F.xxhash64(F.lit(seed), *part).cast("decimal(38,0)")).alias(f"_h{i}") for i, seed in enumerate(HASH_SEEDS)]
    g = t.groupBy("idx").agg(
        F.bool_or((F.col("pos") == 1) & ~F.col("role").isin("system", "user")).alias("_first_bad"),
        F.bool_or((F.col("role_prev") == F.col("role")) & (F.col("role") != "system")).alias("_adjacent"),
        F.bool_or(F.col("role") == "assistant").alias("_has_assistant"),
        F.bool_or((F.col("role") == "assistant") & (stripped == "")).alias("_blank"),
        F.bool_or(F.instr(F.col("text"), "�") > 0).alias("broken_utf8"),
        F.bool_or(F.col("text").rlike(CONTROL_CHAR_PATTERN)).alias("unsupported_tokens"),
        *hashes,
    )
    flags = g.select(
        "idx",
        F.lit(False).alias("missing_fields"),
        F.lit(False).alias("invalid_conversation"),
        (F.col("_first_bad") | F.coalesce(F.col("_adjacent"), F.lit(False))).alias("role_mismatch"),
        (~F.col("_has_assistant") | F.col("_blank")).alias("empty_responses"),
        "broken_utf8",
        "unsupported_tokens",
        F.struct("_h0", "_h1").alias("content_hash"),
    )
    return mark_duplicates(flags)
