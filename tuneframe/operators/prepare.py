"""Training-set preparation.

SFT: trainer normaliser -> drop empty examples -> render -> head/tail split.
DPO/KTO: strict triples, KTO unpivots them. The split needs each example's
rank in file order: a running total over blocks of ids, without a sort of
the whole data. Vocabularies rank by :func:`dense_rank`, a range-partitioned
sort plus per-partition offsets, materialised once with ``checkpoint`` so both
evaluations agree even if executors are lost.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tuneframe.operators.normalize import get_str, to_training_messages
from tuneframe.session import materialize, parallelism
from tuneframe.operators.tokens import render
from tuneframe.functions.joins import attach_row

DEFAULT_EVAL_RATIO = 0.05
# Ids that one window task takes in a running total.
TOTAL_BLOCK = 1 << 16


def sft_texts(records: DataFrame, fmt: str) -> DataFrame:
    """``(idx, text)`` rendered prompts of non-empty examples (N10 + K1)."""
    m = to_training_messages(records, fmt)
    keep = m.filter(F.exists("messages", lambda x: x["content"] != F.lit("")))
    return keep.select("idx", render(F.col("messages")).alias("text"))


def dense_rank(df: DataFrame, order: str = "idx", partitions: int | None = None) -> DataFrame:
    """``rank`` = 0..n-1 by ``order`` without a single-task window.

    Range partitioning spreads the sort; per-partition counts (one row per
    partition) give the offsets. The sorted frame is checkpointed so the
    ranks are fixed once computed.
    """
    n = partitions or parallelism(df.sparkSession)
    s = (
        df.repartitionByRange(n, order)
        .sortWithinPartitions(order)
        .withColumn("_p", F.spark_partition_id())
        .withColumn("_mid", F.monotonically_increasing_id())
    )
    s = materialize(s)
    per = s.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"), F.min("_mid").alias("_first"))
    w = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offs = per.withColumn("_off", F.coalesce(F.sum("_n").over(w), F.lit(0)))
    out = s.join(F.broadcast(offs.select("_p", "_first", "_off")), "_p")
    return out.withColumn("rank", (F.col("_off") + F.col("_mid") - F.col("_first")).cast("bigint")).drop(
        "_p", "_mid", "_first", "_off"
    )


def running_total(df: DataFrame, value, name: str, order: str = "idx") -> DataFrame:
    """Adds ``name``: the sum of ``value`` over all rows before this one, by the
    unique integer id ``order`` (a file-order index).

    Ids fall into blocks of 65,536: a window inside each block, and a running
    sum over the blocks' totals (a row per block of ids, not per row). The same
    on every cluster, whatever its partitions.
    """
    b = df.withColumn("_blk", F.floor(F.col(order) / TOTAL_BLOCK)).withColumn("_val", value)
    inside = Window.partitionBy("_blk").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    blocks = b.groupBy("_blk").agg(F.sum("_val").alias("_sum"))
    blocks = blocks.select("_blk", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_off"))
    here = b.withColumn("_in", F.coalesce(F.sum("_val").over(inside), F.lit(0)))
    out = here.join(blocks, "_blk").withColumn(name, (F.col("_off") + F.col("_in")).cast("bigint"))
    return out.drop("_blk", "_val", "_in", "_off")


def train_eval_split(
    df: DataFrame, ratio: float = DEFAULT_EVAL_RATIO, order: str = "idx", min_rows: int | None = None
) -> DataFrame:
    """head/tail split in file order; adds ``rank`` and ``split`` = train | eval.

    The first ``max(1, int(n * (1 - ratio)))`` examples train, the rest eval.
    With ``min_rows``, data of no more rows than that trains as a whole.
    """
    ranked = running_total(df, F.lit(1).cast("bigint"), "rank", order)
    n = df.agg(F.count(F.lit(1)).alias("_total"))
    cut = F.greatest(F.lit(1), F.floor(F.col("_total") * F.lit(1.0 - ratio)).cast("bigint"))
    if min_rows is not None:
        cut = F.when(F.col("_total") > int(min_rows), cut).otherwise(F.col("_total"))
    j = attach_row(ranked, n)
    return j.withColumn("split", F.when(F.col("rank") < cut, "train").otherwise("eval")).drop("_total")


def preference_triples(records: DataFrame) -> DataFrame:
    """Rows whose prompt, chosen and rejected are all present and non-null."""
    cols = {k: F.expr(get_str("v", k)) for k in ("prompt", "chosen", "rejected")}
    df = records.select("idx", *[c.alias(k) for k, c in cols.items()])
    return df.filter(F.col("prompt").isNotNull() & F.col("chosen").isNotNull() & F.col("rejected").isNotNull())


def kto_rows(triples: DataFrame) -> DataFrame:
    """(prompt, completion, label): every chosen (true) before every rejected."""
    pos = triples.select("idx", "prompt", F.col("chosen").alias("completion"), F.lit(True).alias("label"))
    neg = triples.select("idx", "prompt", F.col("rejected").alias("completion"), F.lit(False).alias("label"))
    return pos.unionByName(neg).withColumn("ord", F.when(F.col("label"), 0).otherwise(1))


def limit_tokens(df: DataFrame, col: str, max_len: int) -> DataFrame:
    """P5: cut token sequences to ``max_len``."""
    return df.withColumn(col, F.slice(F.col(col), 1, int(max_len)))


def _div(total, limit: int):
    """Whole quotient of 64-bit numbers."""
    return F.call_function("div", total, F.lit(limit))


def pack(df: DataFrame, length_col: str, max_len: int) -> DataFrame:
    """Examples in file order laid end to end and cut every ``max_len`` tokens.

    One row per piece ``(pack_id, idx, offset, len)``: an example may straddle
    sequences; one without tokens (or of null length) gives a piece of length 0.
    """
    limit = int(max_len)
    size = F.coalesce(F.col(length_col).cast("bigint"), F.lit(0))
    s = running_total(df.select("idx", size.alias("_len")), F.col("_len"), "_start")
    last = F.greatest(F.col("_start") + F.col("_len") - 1, F.col("_start"))
    pieces = s.withColumn("pack_id", F.explode(F.sequence(_div(F.col("_start"), limit), _div(last, limit))))
    begin = F.greatest(F.col("_start"), F.col("pack_id") * limit)
    end = F.least(F.col("_start") + F.col("_len"), (F.col("pack_id") + 1) * limit)
    return pieces.select("pack_id", "idx", (begin - F.col("pack_id") * limit).alias("offset"), (end - begin).alias("len"))


def prepare(records: DataFrame, objective: str, fmt: str, ratio: float = DEFAULT_EVAL_RATIO) -> DataFrame:
    """Route by objective; raises for objectives that are not supported."""
    if objective == "sft":
        out = train_eval_split(sft_texts(records, fmt), ratio)
    elif objective == "dpo":
        out = preference_triples(records)
    elif objective == "kto":
        out = kto_rows(preference_triples(records))
    elif objective == "orpo":
        raise ValueError("objective orpo has no data preparation; dpo and kto have")
    else:
        raise ValueError(f"Unsupported training objective: {objective}")
    if out.isEmpty():
        raise ValueError("the records hold nothing to train on")
    return out
