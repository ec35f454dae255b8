"""Per-record format classification and the dataset format vote.

F1 is one ``CASE`` over VARIANT predicates. F2 lets every record vote: tasks
count their own votes per dataset and ship a row per dataset and format.
Where a ``sample`` is asked for, the first records in file order vote: without
``by`` a ``TakeOrdered``, with ``by`` a ``row_number() <= n`` with a partial
``WindowGroupLimit``. The winner is joined back to the records (one row per
dataset): a single one without a driver round trip, those of several datasets
once they are counted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tuneframe.functions.text import has_inst_tags_sql
from tuneframe.operators.normalize import FORMATS, has, is_object
from tuneframe.functions.joins import attach_row
from tuneframe.session import materialize

# Up to so many datasets, of a name and a format each, are broadcast.
BROADCAST_DATASETS = 1_000_000


def _obj_with(item: str, keys: list[str]) -> str:
    ks = " OR ".join(has(item, k) for k in keys)
    return f"({is_object(item)} AND ({ks}))"


def classify_sql(v: str = "v", raw: str = "raw") -> str:
    """the format this record votes for, or NULL (ordered, falling through)."""
    conv = f"try_variant_get({v}, '$.conversations', 'array<variant>')"
    msgs = f"try_variant_get({v}, '$.messages', 'array<variant>')"
    nkeys = f"size(try_variant_get({v}, '$', 'map<string,variant>'))"
    text_is_str = f"(schema_of_variant(try_variant_get({v}, '$.text', 'variant')) = 'STRING')"
    text = f"try_variant_get({v}, '$.text', 'string')"
    return (
        f"CASE WHEN size({conv}) > 0 AND forall({conv}, c -> {_obj_with('c', ['from', 'role'])}) THEN 'sharegpt' "
        f"WHEN size({msgs}) > 0 AND forall({msgs}, c -> {_obj_with('c', ['role'])}) THEN 'chatml' "
        f"WHEN {has(v, 'chosen')} AND {has(v, 'rejected')} THEN 'preference' "
        f"WHEN {has(v, 'instruction')} AND ({has(v, 'output')} OR {has(v, 'response')}) THEN 'alpaca' "
        f"WHEN {has(v, 'text')} AND {nkeys} <= 2 AND {text_is_str} AND {has_inst_tags_sql(text)} THEN 'llama' "
        f"WHEN {has(v, 'text')} AND {nkeys} <= 2 AND {text_is_str} THEN 'raw_text' "
        f"END"
    )


def classify_records(records: DataFrame) -> DataFrame:
    return records.withColumn("vote", F.expr(classify_sql()))


def _head(records: DataFrame, by: list[str], n: int) -> DataFrame:
    """First ``n`` records in file order: ``TakeOrdered`` without groups, else
    ``row_number() <= n`` (partial ``WindowGroupLimit`` before the shuffle)."""
    if not by:
        return records.orderBy("idx").limit(n)
    w = Window.partitionBy(*by).orderBy("idx")
    return records.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).drop("_r")


def detect_format(records: DataFrame, by: list[str] | None = None, sample: int | None = None) -> DataFrame:
    """F2 + F3: ``(*by, format, confidence, sampled, votes, scores)``.

    Ties go to the earlier format in declared order; no votes -> unknown with
    confidence 0.0; the denominator counts records that voted for nothing.
    """
    by = by or []
    head = records.select(*by, "idx", "raw", "v")
    if sample is not None:
        head = _head(head, by, int(sample))
    voted = head.select(*by, F.expr(classify_sql()).alias("vote"))
    rank = F.array_position(F.array(*[F.lit(f) for f in FORMATS]), F.col("vote"))
    per = voted.groupBy(*by, "vote").agg(F.count(F.lit(1)).alias("n"))
    agg = per.groupBy(*by).agg(
        F.sum("n").alias("sampled"),
        F.max_by(
            F.struct(F.col("vote"), F.col("n")),
            F.when(F.col("vote").isNotNull(), F.struct(F.col("n"), -rank)),
        ).alias("_best"),
        F.create_map(
            *[x for f in FORMATS for x in (F.lit(f), F.coalesce(F.sum(F.when(F.col("vote") == f, F.col("n"))), F.lit(0)))]
        ).alias("scores"),
    )
    best_n = F.coalesce(F.col("_best.n"), F.lit(0))
    fmt = F.when(best_n > 0, F.col("_best.vote")).otherwise(F.lit("unknown"))
    return agg.select(
        *by,
        fmt.alias("format"),
        F.when(best_n > 0, F.round(best_n / F.col("sampled"), 4)).otherwise(F.lit(0.0)).alias("confidence"),
        F.col("sampled").cast("bigint").alias("sampled"),
        best_n.cast("bigint").alias("votes"),
        "scores",
    )


def attach_format(records: DataFrame, detected: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Attach the detected format as column ``fmt`` (one row per dataset).

    With ``by`` the detection is evaluated once and its rows are counted: its
    size as estimated grows with the records that voted, and a join planned
    by that would shuffle whole records to a task per dataset.
    """
    by = by or []
    d = detected.select(*by, F.col("format").alias("fmt"))
    if not by:
        return attach_row(records.drop("fmt"), d)
    d = materialize(d, free_shuffles=True)
    return records.drop("fmt").join(F.broadcast(d) if d.count() <= BROADCAST_DATASETS else d, on=by, how="left")
