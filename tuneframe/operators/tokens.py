"""Prompt rendering, token counts, sizing and runtime estimates.

Prompts are rendered by :func:`render` or by a :class:`ChatTemplate`, which
becomes one Catalyst expression. The default tokenizer is whitespace words (a
Catalyst expression, no Python). A real tokenizer plugs in through
:func:`tokenizer_udf`: an iterator-form Arrow UDF that loads the tokenizer
once per Python worker and encodes whole batches. Everything around the token counts (histograms, truncation,
extrapolation, estimates) is a built-in aggregate over one row per record.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from tuneframe.functions.buckets import TOKEN_BUCKETS, histogram
from tuneframe.functions.text import py_strip, words
from tuneframe.functions.joins import attach_row

# Assumed adapter-training throughput and default sequence length.
DEFAULT_TOKENS_PER_SEC = 2000.0
DEFAULT_MAX_SEQ_LEN = 2048
# Encoded texts leave a Python worker so many at a time: the ids of a batch are far larger than its texts.
ENCODE_ROWS = 256


@dataclass(frozen=True)
class ChatTemplate:
    """How a tokenizer's vendor lays out a conversation.

    ``turns`` maps a role to the text before and after its content; a role
    that isn't listed is laid out by ``other``, or left out where that is
    None. With ``system_in_user`` (text before and after) a system message
    that comes first goes into the first user turn, before its content.
    ``strip`` trims contents, ``begin`` opens the prompt and ``generation``
    is what asks for an answer. :meth:`column` turns all that into one
    expression: a loop over the messages with a test per role.
    """

    turns: dict[str, tuple[str, str]] = field(default_factory=dict)
    other: tuple[str, str] | None = None
    begin: str = ""
    generation: str = ""
    system_in_user: tuple[str, str] | None = None
    strip: bool = False

    def column(self, messages: Column, generation_prompt: bool = False) -> Column:
        """The prompt; empty for no messages, a null role or content counts as empty."""
        def content(x):
            c = F.coalesce(x["content"], F.lit(""))
            return py_strip(c) if self.strip else c

        role = lambda x: F.coalesce(x["role"], F.lit(""))
        system, rest, first = F.lit(""), messages, F.lit(0)
        if self.system_in_user is not None:
            head = F.get(messages, 0)
            leads = F.coalesce(role(head) == "system", F.lit(False))
            before, after = self.system_in_user
            text = F.coalesce(head["content"], F.lit(""))
            system = F.when(leads, F.concat(F.lit(before), py_strip(text) if self.strip else text, F.lit(after))).otherwise(F.lit(""))
            rest = F.when(leads, F.slice(messages, 2, F.greatest(F.size(messages) - 1, F.lit(0)))).otherwise(messages)
            first = F.array_position(F.transform(rest, lambda x: role(x)), "user") - 1

        def lay(pair: tuple[str, str], x, inner):
            def part(text: str):
                pieces = [F.lit(t) for t in text.split(ROLE_MARK)]
                return F.concat(pieces[0], *[c for p in pieces[1:] for c in (role(x), p)])

            return F.concat(part(pair[0]), inner, part(pair[1]))

        def turn(x, i):
            out = F.lit("") if self.other is None else lay(self.other, x, content(x))
            for name, pair in reversed(self.turns.items()):
                inner = content(x)
                if name == "user" and self.system_in_user is not None:
                    inner = F.concat(F.when(i == first, system).otherwise(F.lit("")), inner)
                out = F.when(role(x) == name, lay(pair, x, inner)).otherwise(out)
            return out

        text = F.concat(F.lit(self.begin), F.array_join(F.transform(rest, turn), ""))
        if generation_prompt:
            text = F.concat(text, F.lit(self.generation))
        return F.when(F.coalesce(F.size(messages), F.lit(0)) < 1, F.lit("")).otherwise(text)


# Stands for the role in the texts before and after a content.
ROLE_MARK = "{role}"
# Two layouts that are in public use.
CHATML = ChatTemplate(other=(f"<|im_start|>{ROLE_MARK}\n", "<|im_end|>\n"), generation="<|im_start|>assistant\n")
INST = ChatTemplate(
    turns={"user": ("<s>[INST] ", " [/INST]"), "assistant": (" ", " </s>")},
    system_in_user=("<<SYS>>\n", "\n<</SYS>>\n\n"),
    strip=True,
)


def render(
    messages: Column, generation_prompt: bool = False, system_prompt: str | None = None, template: ChatTemplate | None = None
) -> Column:
    """K1/K2: ``role: content`` lines joined by newlines ('' for no messages), or the layout of ``template``.

    K2 prepends an optional system turn and asks for an answer: by
    ``\\nassistant:``, or as the template does.
    """
    m = messages
    if system_prompt:
        m = F.concat(F.array(F.struct(F.lit("system").alias("role"), F.lit(system_prompt).alias("content"))), m)
    if template is not None:
        return template.column(m, generation_prompt)
    text = F.array_join(F.transform(m, lambda x: F.concat(x["role"], F.lit(": "), x["content"])), "\n")
    if generation_prompt:
        text = F.concat(text, F.lit("\nassistant:"))
    return F.coalesce(text, F.lit(""))


def whitespace_token_count(text: Column) -> Column:
    """K3 with the built-in tokenizer."""
    return F.size(words(text)).cast("bigint")


def tokenizer_udf(make_encoder: Callable[[], Callable[[str], list[int]]]):
    """Wrap a tokenizer factory as an Arrow-batched iterator UDF.

    ``make_encoder`` runs once per Python worker (not per row); the returned
    function maps one text to its token ids.
    """
    @pandas_udf(T.ArrayType(T.LongType()))
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = make_encoder()
        for s in batches:
            for k in range(0, len(s), ENCODE_ROWS):
                yield s.iloc[k : k + ENCODE_ROWS].map(lambda t: [int(i) for i in enc(t or "")])

    return encode


def token_counts(df: DataFrame, encoder=None, template: ChatTemplate | None = None) -> DataFrame:
    """Per record: ``prompt`` and ``n_tokens`` (K1 + K3), by a tokenizer's own ``template`` where it has one."""
    prompt = render(F.col("messages"), template=template)
    out = df.withColumn("prompt", prompt)
    if encoder is None:
        return out.withColumn("n_tokens", whitespace_token_count(F.col("prompt")))
    return out.withColumn("n_tokens", F.size(encoder(F.col("prompt"))).cast("bigint"))


def head_sample(df: DataFrame, sample_size: int | None) -> DataFrame:
    """K6: the first ``sample_size`` records in file order (None = all)."""
    return df if sample_size is None else df.filter(F.col("idx") < int(sample_size))


def token_analysis(
    tc: DataFrame,
    max_seq_len: int = DEFAULT_MAX_SEQ_LEN,
    sample_size: int | None = None,
    by: list[str] | None = None,
) -> DataFrame:
    """K4-K7: one row per group.

    ``tc`` is the output of :func:`token_counts`. Totals are over all
    records; statistics over the head sample, extrapolated when sampled.
    """
    by = by or []
    total = tc.groupBy(*by).agg(F.count(F.lit(1)).alias("total_examples"))
    s = head_sample(tc, sample_size)
    st = s.groupBy(*by).agg(
        F.count(F.lit(1)).alias("sampled_examples"),
        F.sum("n_tokens").alias("_sum"),
        F.min("n_tokens").alias("min_tokens"),
        F.max("n_tokens").alias("max_tokens"),
        F.count_if(F.col("n_tokens") > int(max_seq_len)).alias("over_limit"),
        F.min_by(F.struct("prompt", "n_tokens"), "idx").alias("_first"),
    )
    j = total.join(st, on=by, how="left") if by else attach_row(total, st)
    n = F.col("sampled_examples")
    scale = F.when((n > 0) & (n < F.col("total_examples")), F.col("total_examples") / n).otherwise(F.lit(1.0))
    frac = F.when(n > 0, F.col("over_limit") / n)
    return j.select(
        *by,
        F.col("sampled_examples").cast("bigint").alias("sampled_examples"),
        F.col("total_examples").cast("bigint").alias("total_examples"),
        F.coalesce(F.round(F.col("_sum") / n, 2), F.lit(0.0)).alias("avg_tokens_per_example"),
        F.coalesce(F.col("min_tokens"), F.lit(0)).cast("bigint").alias("min_tokens"),
        F.coalesce(F.col("max_tokens"), F.lit(0)).cast("bigint").alias("max_tokens"),
        F.round(F.coalesce(F.col("_sum"), F.lit(0)) * scale).cast("bigint").alias("estimated_total_tokens"),
        F.lit(int(max_seq_len)).cast("bigint").alias("max_seq_len"),
        F.coalesce(F.col("over_limit"), F.lit(0)).cast("bigint").alias("sampled_examples_over_limit"),
        F.coalesce(F.round(frac, 4), F.lit(0.0)).alias("fraction_over_limit"),
        F.coalesce(F.round(frac * F.col("total_examples")), F.lit(0)).cast("bigint").alias("estimated_total_over_limit"),
        F.col("_first.prompt").alias("first_prompt"),
        F.coalesce(F.col("_first.n_tokens"), F.lit(0)).cast("bigint").alias("first_token_count"),
    )


def token_histogram(tc: DataFrame, by: list[str] | None = None) -> DataFrame:
    """K4 histogram with the T5 buckets."""
    return histogram(tc, "n_tokens", TOKEN_BUCKETS, by)


def runtime_estimate(
    analysis: DataFrame,
    epochs: float = 1.0,
    tokens_per_sec: float = DEFAULT_TOKENS_PER_SEC,
    target_tokens: int | None = None,
    batch_size: int = 1,
) -> DataFrame:
    """K10/K11 as expressions on the K4 row(s)."""
    tps = max(float(tokens_per_sec), 1e-6)
    tokens = F.col("estimated_total_tokens")
    train = tokens * F.lit(float(epochs))
    out = analysis.select(
        *[c for c in analysis.columns if c not in ("first_prompt",)],
        F.lit(int(batch_size)).alias("batch_size"),
        F.lit(float(epochs)).alias("epochs"),
        F.round(train).cast("bigint").alias("total_training_tokens"),
        F.lit(tps).alias("assumed_tokens_per_sec"),
        F.round(train / F.lit(tps) / F.lit(3600.0), 3).alias("estimate_runtime_hours"),
    )
    if target_tokens:
        out = out.withColumn(
            "estimated_epochs_for_target_tokens",
            F.when(tokens <= 0, F.lit(0.0)).otherwise(F.round(F.lit(float(target_tokens)) / tokens, 4)),
        )
    return out


def build_vocabulary(texts: DataFrame, text_col: str = "text", specials: list[str] | None = None) -> DataFrame:
    """``vocab(id, token, is_special)`` for the whitespace tokenizer.

    Ids: specials first, then words by descending frequency (ties by text).
    Ranking uses a range-partitioned sort with per-partition offsets.
    """
    from tuneframe.operators.prepare import dense_rank

    specials = specials or []
    counts = (
        texts.select(F.explode(words(F.col(text_col))).alias("token"))
        .groupBy("token")
        .agg(F.count(F.lit(1)).alias("_c"))
        .withColumn("_k", F.struct((-F.col("_c")).alias("c"), F.col("token")))
    )
    ranked = dense_rank(counts, "_k")
    words_v = ranked.select(
        (F.col("rank") + len(specials)).alias("id"), "token", F.lit(False).alias("is_special")
    )
    if not specials:
        return words_v
    spark = texts.sparkSession
    sp = spark.createDataFrame([(i, t, True) for i, t in enumerate(specials)], "id bigint, token string, is_special boolean")
    return sp.unionByName(words_v)


def encode_rows(df: DataFrame, vocab: DataFrame, text_col: str = "text", key: str = "idx") -> DataFrame:
    """K8: per text, its ordered tokens ``(key, pos, id, token, is_special)``.

    An equi-join on the token text; the vocabulary grows with the data, so
    Spark picks the join strategy from its size (AQE may broadcast it).
    """
    toks = df.select(key, F.posexplode(words(F.col(text_col))).alias("pos", "token"))
    return toks.join(vocab, on="token", how="left").select(key, "pos", "id", "token", "is_special")


def encoded_prompts(df: DataFrame, encoder, template: ChatTemplate | None = None, generation_prompt: bool = False) -> DataFrame:
    """K8 with a plug-in tokenizer: ``idx, prompt, ids`` of every record's rendered messages."""
    prompt = render(F.col("messages"), generation_prompt, template=template)
    return df.select("idx", prompt.alias("prompt")).withColumn("ids", encoder(F.col("prompt")))


def lookup_tokens(vocab: DataFrame, tokens: DataFrame, encoder=None) -> DataFrame:
    """K9: token text -> ``id`` by the vocabulary, or ``ids`` by a plug-in tokenizer (a text may be several)."""
    if encoder is not None:
        return tokens.withColumn("ids", encoder(F.col("token")))
    return tokens.join(vocab.select("token", "id"), on="token", how="left")


def lookup_ids(vocab: DataFrame, ids: DataFrame) -> DataFrame:
    """K9: id -> token text."""
    return ids.join(vocab, on="id", how="left")
