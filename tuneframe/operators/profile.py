"""Dataset profile (turns, roles, duplicates, sizes, entropy, quality).

One record-level projection feeds three kinds of aggregate: record-level
(``agg`` over all rows), role-level (``explode`` + ``groupBy(role)``) and
word-level (``explode`` + ``groupBy(word)``). Every aggregate is partial
before its shuffle, so hot roles, words and hashes cost one row per task.
All reports take ``by`` so one job profiles many datasets at once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tuneframe.functions.buckets import TOKEN_BUCKETS, TURN_BUCKETS, bucket_labels, histogram
from tuneframe.functions.messages import content_hash, empty_messages, join_content
from tuneframe.functions.text import n_words, words
from tuneframe.operators.validate import empty_response, role_mismatch
from tuneframe.functions.joins import attach_row
from tuneframe.operators.langid import LanguageModel, language_map

# Quality weights.
EMPTY_WEIGHT, DUP_WEIGHT, ROLE_WEIGHT = 40.0, 30.0, 30.0


def record_metrics(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Per record: turns, approximate tokens, empty/role flags, content hash.

    Records whose conversion failed count as having no messages.
    """
    by = by or []
    m = F.coalesce(F.when(~F.coalesce(F.col("norm_error"), F.lit(False)), F.col("messages")), empty_messages())
    base = df.select(*by, "idx", m.alias("messages"))
    has_msgs = F.size("messages") > 0
    return base.select(
        *by,
        "idx",
        "messages",
        F.size("messages").cast("bigint").alias("n_turns"),
        n_words(join_content("messages", " ")).cast("bigint").alias("n_tokens"),
        empty_response(F.col("messages")).alias("is_empty"),
        (has_msgs & role_mismatch(F.col("messages"))).alias("is_role_mismatch"),
        F.when(has_msgs, content_hash("messages")).alias("content_hash"),
    )


def turn_stats(rm: DataFrame, by: list[str] | None = None) -> DataFrame:
    """T1."""
    by = by or []
    g = rm.groupBy(*by)
    return g.agg(
        F.round(F.avg("n_turns"), 3).alias("avg_turns"),
        F.min("n_turns").alias("min_turns"),
        F.max("n_turns").alias("max_turns"),
    )


def role_counts(rm: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Messages per role (long form)."""
    by = by or []
    return (
        rm.select(*by, F.explode("messages").alias("m"))
        .groupBy(*by, F.col("m.role").alias("role"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def assistant_user_ratio(rm: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Assistant / user turns, 4 dp; null without user turns."""
    by = by or []
    roles = F.transform("messages", lambda x: x["role"])
    per = rm.select(
        *by,
        F.size(F.filter(roles, lambda r: r == "user")).alias("_u"),
        F.size(F.filter(roles, lambda r: r == "assistant")).alias("_a"),
    )
    agg = per.groupBy(*by).agg(F.sum("_u").alias("user_turns"), F.sum("_a").alias("assistant_turns"))
    return agg.select(
        *by,
        F.col("user_turns").cast("bigint").alias("user_turns"),
        F.col("assistant_turns").cast("bigint").alias("assistant_turns"),
        F.when(F.col("user_turns") > 0, F.round(F.col("assistant_turns") / F.col("user_turns"), 4)).alias(
            "assistant_user_ratio"
        ),
    )


def duplicate_stats(rm: DataFrame, by: list[str] | None = None) -> DataFrame:
    """T4: extra copies among records with messages; ratio over all records."""
    by = by or []
    per_hash = (
        rm.groupBy(*by, "content_hash")
        .agg(F.count(F.lit(1)).alias("_c"))
        .select(
            *by,
            F.when(F.col("content_hash").isNotNull(), F.greatest(F.col("_c") - 1, F.lit(0))).otherwise(0).alias("_extra"),
            F.col("_c"),
        )
    )
    agg = per_hash.groupBy(*by).agg(F.sum("_extra").alias("duplicate_examples"), F.sum("_c").alias("num_examples"))
    return agg.select(
        *by,
        F.coalesce("num_examples", F.lit(0)).cast("bigint").alias("num_examples"),
        F.coalesce("duplicate_examples", F.lit(0)).cast("bigint").alias("duplicate_examples"),
        F.round(_share(F.col("duplicate_examples"), F.col("num_examples")), 4).alias("duplicate_ratio"),
    )


def token_stats(rm: DataFrame, by: list[str] | None = None) -> DataFrame:
    """T5 summary: avg (2 dp), min, max of whitespace token counts."""
    by = by or []
    return rm.groupBy(*by).agg(
        F.round(F.avg("n_tokens"), 2).alias("avg_tokens"),
        F.min("n_tokens").alias("min_tokens"),
        F.max("n_tokens").alias("max_tokens"),
    )


def token_histogram(rm: DataFrame, by: list[str] | None = None) -> DataFrame:
    """T5 buckets."""
    return histogram(rm, "n_tokens", TOKEN_BUCKETS, by)


def turn_histogram(rm: DataFrame, by: list[str] | None = None) -> DataFrame:
    """T6 buckets."""
    return histogram(rm, "n_turns", TURN_BUCKETS, by)


def _record_words(words_per_record: int | None):
    w = words(join_content("messages", " "))
    return w if words_per_record is None else F.slice(w, 1, int(words_per_record))


def entropy(rm: DataFrame, by: list[str] | None = None, words_per_record: int | None = None) -> DataFrame:
    """Normalised Shannon entropy of all lower-cased words.

    ``words_per_record`` keeps only a record's first words where that is asked for.

    ``H = log2(N) - sum(c log2 c) / N`` over word counts ``c``: one
    ``groupBy(word)`` (partial aggregation absorbs hot words) and one global
    aggregate; no window, no collect.
    """
    by = by or []
    counts = (
        rm.select(*by, F.explode(_record_words(words_per_record)).alias("w"))
        .groupBy(*by, F.lower("w").alias("w"))
        .agg(F.count(F.lit(1)).alias("c"))
    )
    agg = counts.groupBy(*by).agg(
        F.sum("c").alias("_n"),
        F.count(F.lit(1)).alias("_d"),
        F.sum(F.col("c") * F.log2("c")).alias("_s"),
    )
    h = F.log2("_n") - F.col("_s") / F.col("_n")
    norm = F.when(F.col("_d") > 1, h / F.log2("_d")).otherwise(h)
    return agg.select(
        *by,
        F.col("_d").cast("bigint").alias("distinct_words"),
        F.coalesce(F.round(norm, 4), F.lit(0.0)).alias("entropy_score"),
    )


def _record_totals(rm: DataFrame, by: list[str]) -> DataFrame:
    return rm.groupBy(*by).agg(
        F.count(F.lit(1)).alias("num_examples"),
        F.count_if("is_empty").alias("empty_count"),
        F.count_if("is_role_mismatch").alias("role_mismatch_count"),
    )


def _share(part, n):
    """``part / n``; 0 of no records."""
    return F.coalesce(F.try_divide(part, n), F.lit(0.0))


def _clamped(score, n):
    """Score within 0 to 100; 0 without records."""
    return F.when(n > 0, F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.round(score, 2)))).otherwise(F.lit(0.0))


def quality_score(rm: DataFrame, by: list[str] | None = None) -> DataFrame:
    """100 - 40 empty - 30 duplicate(ratio, 4 dp) - 30 role mismatch, clamped; 0 without records."""
    by = by or []
    tot = _record_totals(rm, by)
    dup = duplicate_stats(rm, by).select(*by, "duplicate_ratio")
    j = attach_row(tot, dup) if not by else tot.join(dup, on=by)
    n = F.col("num_examples")
    score = (
        F.lit(100.0)
        - _share(F.col("empty_count"), n) * EMPTY_WEIGHT
        - F.col("duplicate_ratio") * DUP_WEIGHT
        - _share(F.col("role_mismatch_count"), n) * ROLE_WEIGHT
    )
    return j.select(
        *by,
        F.col("num_examples").cast("bigint").alias("num_examples"),
        F.col("empty_count").cast("bigint").alias("empty_count"),
        F.col("role_mismatch_count").cast("bigint").alias("role_mismatch_count"),
        F.col("duplicate_ratio"),
        _clamped(score, n).alias("quality_score"),
    )


def keyed_counts(rm: DataFrame, by: list[str] | None = None, words_per_record: int | None = None) -> DataFrame:
    """Everything T1-T8 need, counted in ONE shuffle.

    Each record emits tagged keys ``(kind, key)``: its turn count, its token
    count, its empty / role-mismatch flags, its roles, its content hash and
    its lower-cased words. One ``groupBy(by, kind, key)`` with
    partial aggregation counts them (hot words and hashes combine map-side);
    the statistics are then read off these value distributions.

    Up to the count a tagged key is one string, ``kind key``; a word is its
    own, as it holds no space. A text is lower-cased and split once: that
    gives the words one by one, and moves no white space. The keys are a
    column of their own, so that exploding and counting them is one
    generated loop.
    """
    by = by or []

    def tag(kind: str, key):
        return F.concat(F.lit(f"{kind} "), key.cast("string"))

    record = rm.select(
        *by, "n_turns", "is_empty", "is_role_mismatch", "content_hash", "messages",
        words(F.lower(join_content("messages", " "))).alias("_words"))
    own = F.array(
        tag("turns", F.col("n_turns")),
        tag("tokens", F.size("_words")),
        F.when(F.col("is_empty"), F.lit("empty ")),
        F.when(F.col("is_role_mismatch"), F.lit("role_mismatch ")),
        tag("hash", F.hex("content_hash")),
    )
    roles = F.transform("messages", lambda m: tag("role", m["role"]))
    w = F.col("_words") if words_per_record is None else F.slice("_words", 1, int(words_per_record))
    # Every record has keys, so an outer explode adds no row; for an inner one the planner would make all keys twice, to see whether there are any.
    t = record.select(*by, F.concat(F.array_compact(own), roles, w).alias("_keys")).select(*by, F.explode_outer("_keys").alias("_t"))
    counts = t.groupBy(*by, "_t").agg(F.count(F.lit(1)).alias("c"))
    # Only a role can be null.
    tagged = F.instr("_t", " ") > 0
    kind = F.when(F.col("_t").isNull(), F.lit("role")).when(tagged, F.substring_index("_t", " ", 1)).otherwise(F.lit("word"))
    key = F.when(tagged, F.expr("substr(_t, instr(_t, ' ') + 1)")).otherwise(F.col("_t"))
    return counts.select(*by, kind.alias("kind"), key.alias("key"), "c")


def profile(
    df: DataFrame, by: list[str] | None = None, words_per_record: int | None = None, languages: LanguageModel | None = None
) -> DataFrame:
    """One row per group with T1-T8 (T2/T5/T6 as maps), and T9's map with a model of ``languages``.

    Without records the one ungrouped row has counts and a quality of 0.

    One pass over the records and one shuffle (:func:`keyed_counts`). Hashes
    and words are summed up where they were counted, to one row each; what
    is left, the other keys, goes through a single small aggregate of
    filtered sums.
    """
    by = by or []
    kind, key, c = F.col("kind"), F.col("key"), F.col("c")
    few = F.when(~kind.isin("hash", "word"), key).alias("key")
    kc = keyed_counts(record_metrics(df, by), by, words_per_record).groupBy(*by, "kind", few).agg(
        F.sum(c).alias("c"), F.count(F.lit(1)).alias("distinct"), F.sum(c - 1).alias("extra"), F.sum(c * F.log2(c)).alias("clog"))
    num = F.expr("try_cast(key AS double)")

    def s(cond):
        return F.sum(F.when(cond, c))

    hist = []
    for name, k, buckets in (("token_histogram", "tokens", TOKEN_BUCKETS), ("turn_histogram", "turns", TURN_BUCKETS)):
        pairs = []
        for (lo, hi), label in zip(buckets, bucket_labels(buckets)):
            cond = (kind == k) & (num >= lo) & ((num < hi) if hi is not None else F.lit(True))
            pairs += [F.lit(label), F.coalesce(s(cond), F.lit(0)).cast("bigint")]
        hist.append(F.create_map(*pairs).alias(name))
    g = kc.groupBy(*by) if by else kc.groupBy()
    a = g.agg(
        s(kind == "turns").alias("_n"),
        F.sum(F.when(kind == "turns", num * c)).alias("_turns"),
        F.min(F.when(kind == "turns", num)).alias("_min_turns"),
        F.max(F.when(kind == "turns", num)).alias("_max_turns"),
        F.sum(F.when(kind == "tokens", num * c)).alias("_tokens"),
        F.min(F.when(kind == "tokens", num)).alias("_min_tokens"),
        F.max(F.when(kind == "tokens", num)).alias("_max_tokens"),
        s(kind == "empty").alias("_empty"),
        s(kind == "role_mismatch").alias("_rm"),
        s((kind == "role") & (key == "user")).alias("_u"),
        s((kind == "role") & (key == "assistant")).alias("_a"),
        F.map_from_entries(F.collect_list(F.when(kind == "role", F.struct(key, c)))).alias("role_counts"),
        F.sum(F.when(kind == "hash", F.col("extra"))).alias("_dup"),
        s(kind == "word").alias("_wn"),
        F.sum(F.when(kind == "word", F.col("distinct"))).alias("_wd"),
        F.sum(F.when(kind == "word", F.col("clog"))).alias("_ws"),
        *hist,
    )
    n = F.coalesce(F.col("_n"), F.lit(0))
    empty_count = F.coalesce(F.col("_empty"), F.lit(0))
    rm_count = F.coalesce(F.col("_rm"), F.lit(0))
    dup = F.coalesce(F.col("_dup"), F.lit(0))
    ratio = F.round(_share(dup, n), 4)
    score = (
        F.lit(100.0)
        - _share(empty_count, n) * EMPTY_WEIGHT
        - ratio * DUP_WEIGHT
        - _share(rm_count, n) * ROLE_WEIGHT
    )
    h = F.log2("_wn") - F.col("_ws") / F.col("_wn")
    entropy_score = F.coalesce(F.round(F.when(F.col("_wd") > 1, h / F.log2("_wd")).otherwise(h), 4), F.lit(0.0))
    out = a.select(
        *by,
        n.cast("bigint").alias("num_examples"),
        empty_count.cast("bigint").alias("empty_count"),
        rm_count.cast("bigint").alias("role_mismatch_count"),
        ratio.alias("duplicate_ratio"),
        _clamped(score, n).alias("quality_score"),
        F.round(F.try_divide(F.col("_turns"), n), 3).alias("avg_turns"),
        F.col("_min_turns").cast("bigint").alias("min_turns"),
        F.col("_max_turns").cast("bigint").alias("max_turns"),
        F.when(F.col("_u") > 0, F.round(F.coalesce(F.col("_a"), F.lit(0)) / F.col("_u"), 4)).alias("assistant_user_ratio"),
        dup.cast("bigint").alias("duplicate_examples"),
        F.round(F.try_divide(F.col("_tokens"), n), 2).alias("avg_tokens"),
        F.col("_min_tokens").cast("bigint").alias("min_tokens"),
        F.col("_max_tokens").cast("bigint").alias("max_tokens"),
        entropy_score.alias("entropy_score"),
        "role_counts",
        "token_histogram",
        "turn_histogram",
    )
    if languages is None:
        return out
    texts = df.select(*by, "idx", join_content(F.col("messages"), " ").alias("text"))
    found = language_map(texts, languages, by)
    return out.join(found, by, "left") if by else attach_row(out, found)
