"""V1-V9: per-record quality flags and the validation report.

Every flag is a projection except ``duplicate_samples``, which needs the
smallest record index per content hash: a hash aggregate with map-side
partial aggregation, joined back on the record index and the hash. A hot hash
(one text copied a billion times) costs that join nothing, since its records
differ in their index.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tuneframe.functions.messages import content_hash
from tuneframe.functions.text import CONTROL_CHAR_PATTERN, py_strip
from tuneframe.operators.normalize import has, is_empty_object
from tuneframe.session import materialize

# Report categories in report order.
CATEGORIES = [
    "missing_fields",
    "role_mismatch",
    "invalid_conversation",
    "duplicate_samples",
    "empty_responses",
    "broken_utf8",
    "unsupported_tokens",
]
SAMPLE_SIZE = 5


def role_mismatch(messages: Column) -> Column:
    """V3: first role not system/user, or two equal adjacent non-system roles."""
    m = messages
    first_bad = ~F.try_element_at(m, F.lit(1))["role"].isin("system", "user")
    adjacent = F.exists(
        F.sequence(F.lit(2), F.greatest(F.size(m), F.lit(2))),
        lambda i: (i <= F.size(m))
        & (F.try_element_at(m, i)["role"] == F.try_element_at(m, i - 1)["role"])
        & (F.try_element_at(m, i)["role"] != F.lit("system")),
    )
    return first_bad | adjacent


def empty_response(messages: Column) -> Column:
    """V4: no assistant turn, or an assistant turn that is blank after strip."""
    m = messages
    no_assistant = ~F.exists(m, lambda x: x["role"] == F.lit("assistant"))
    blank = F.exists(m, lambda x: (x["role"] == F.lit("assistant")) & (py_strip(x["content"]) == F.lit("")))
    return no_assistant | blank


def broken_utf8(messages: Column) -> Column:
    """V5: a replacement character in any content."""
    return F.exists(messages, lambda x: F.instr(x["content"], "�") > 0)


def unsupported_tokens(messages: Column) -> Column:
    """V6: C0 control characters other than tab, newline and carriage return."""
    return F.exists(messages, lambda x: x["content"].rlike(CONTROL_CHAR_PATTERN))


def missing_fields_expr(fmt: str = "fmt", v: str = "v") -> str:
    """V1: required keys of the *dataset* format."""
    return (
        f"CASE WHEN {fmt} = 'alpaca' THEN NOT {has(v, 'instruction')} "
        f"WHEN {fmt} = 'sharegpt' THEN NOT {has(v, 'conversations')} "
        f"WHEN {fmt} IN ('chatml', 'openai') THEN NOT {has(v, 'messages')} "
        f"WHEN {fmt} = 'preference' THEN NOT ({has(v, 'chosen')} AND {has(v, 'rejected')}) "
        f"ELSE false END"
    )


def flag_records(df: DataFrame, by: list[str] | None = None, keep: list[str] | None = None) -> DataFrame:
    """V9: row-level flags for V1-V7 over ``(idx, messages, norm_error[, v, raw, fmt])``.

    Adds boolean columns named after ``CATEGORIES`` plus ``content_hash``. With
    ``keep`` only these columns go along, and the rows are evaluated once into
    the checkpoint folder: V7 and V8 read them several times.
    """
    rows = flag_rows(df)
    if keep is not None:
        rows = materialize(rows.select(*keep, *[c for c in rows.columns if c not in df.columns]), free_shuffles=True)
    return mark_duplicates(rows, by=by)


def flag_rows(df: DataFrame) -> DataFrame:
    """The flags that a record has by itself, V1-V6, and its ``content_hash``: one projection."""
    has_record = "v" in df.columns
    m = F.col("messages")
    empty_record = (
        F.expr(f"v IS NULL OR {is_empty_object('v')}") if has_record else F.lit(False)
    )
    invalid = empty_record | F.coalesce(F.col("norm_error"), F.lit(False)) | m.isNull() | (F.size(m) == 0)
    missing = (
        F.when(empty_record, F.lit(False)).otherwise(F.expr(missing_fields_expr()))
        if has_record and "fmt" in df.columns
        else F.lit(False)
    )
    keep = [c for c in df.columns]
    base = df.select(
        *keep,
        missing.alias("missing_fields"),
        invalid.alias("invalid_conversation"),
    )
    ok = ~F.col("invalid_conversation")
    return base.select(
        *keep,
        "missing_fields",
        "invalid_conversation",
        (ok & role_mismatch(m)).alias("role_mismatch"),
        (ok & empty_response(m)).alias("empty_responses"),
        (ok & broken_utf8(m)).alias("broken_utf8"),
        (ok & unsupported_tokens(m)).alias("unsupported_tokens"),
        F.when(ok, content_hash(m)).alias("content_hash"),
    )


def mark_duplicates(
    df: DataFrame, hash_col: str = "content_hash", order: str = "idx", by: list[str] | None = None
) -> DataFrame:
    """V7: second and later records with an equal hash (first by ``order`` is clean).

    ``groupBy(hash).min(order)`` combines map-side, so the shuffle carries one
    row per (partition, hash); firsts are joined back on ``(order, hash)``, a
    key that no two records of a group share.
    """
    keys = [*(by or []), hash_col]
    firsts = df.filter(F.col(hash_col).isNotNull()).groupBy(*keys).agg(F.min(order).alias(order)).withColumn("_first", F.lit(True))
    out = df.join(firsts, on=[*keys, order], how="left").select(*df.columns, "_first")
    return out.withColumn("duplicate_samples", F.col(hash_col).isNotNull() & F.col("_first").isNull()).drop("_first")


def validation_report(flags: DataFrame, by: list[str] | None = None) -> DataFrame:
    """V8 in long form: ``(*by, category, count, sample_indices)`` plus totals.

    Two passes over the flags: one aggregate for the counts, and one exploded
    ``(category, idx)`` pass for the first five indices per category. The
    latter is ``row_number() <= 5`` per category, which Spark plans with a
    partial ``WindowGroupLimit`` before the shuffle: each task ships at most
    five indices per category, however many records a category holds.
    ``issues_found`` / ``num_examples_checked`` repeat on every row.
    """
    by = by or []
    counts = flags.groupBy(*by).agg(
        F.count(F.lit(1)).alias("num_examples_checked"),
        *[F.count_if(F.col(c)).alias(c) for c in CATEGORIES],
    )
    stack = ", ".join(f"'{c}', {i}, `{c}`" for i, c in enumerate(CATEGORIES))
    long = counts.select(
        *by,
        "num_examples_checked",
        sum((F.col(c) for c in CATEGORIES), F.lit(0)).alias("issues_found"),
        F.expr(f"stack({len(CATEGORIES)}, {stack}) as (category, category_order, count)"),
    )
    samples = first_indices(flags, by)
    out = long.join(samples, on=[*by, "category"], how="left")
    return out.select(
        *by,
        "category",
        F.col("category_order").cast("int").alias("category_order"),
        F.col("count").cast("bigint").alias("count"),
        F.coalesce(F.col("sample_indices"), F.lit("")).alias("sample_indices"),
        F.col("issues_found").cast("bigint").alias("issues_found"),
        F.col("num_examples_checked").cast("bigint").alias("num_examples_checked"),
    )


def first_indices(flags: DataFrame, by: list[str] | None = None, k: int = SAMPLE_SIZE) -> DataFrame:
    """The ``k`` smallest flagged indices per (group, category), comma-joined."""
    by = by or []
    cats = F.filter(
        F.array(*[F.when(F.col(c), F.lit(c)) for c in CATEGORIES]), lambda x: x.isNotNull()
    )
    ex = flags.select(*by, "idx", F.explode(cats).alias("category"))
    w = Window.partitionBy(*by, "category").orderBy("idx")
    top = ex.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k)
    return top.groupBy(*by, "category").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("idx")), lambda x: x.cast("string")), ",").alias(
            "sample_indices"
        )
    )


def validate(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Flags then report for a messages DataFrame."""
    return validation_report(flag_records(df, by), by)
