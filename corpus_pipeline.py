"""The corpus pipeline: five stages over ``documents``, each one of the operators.

Every stage takes ``(spark, docs, sf_dir)``, works on all that its
predecessor kept and is written and read again before the next one. All but
the last return the columns of ``documents``.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tuneframe.llm import line_dedup, mixing, ngram_join, packing, toxicity
from tuneframe.llm.common import give_back, scratch, table
from tuneframe.llm.queries import held_out, word_bpe

# The rows of the last stage follow a fitted model and seeded choices: nothing that SQL states.
ORACLE_SQL = None
MIX_BLOCK = 1024


def _columns(like: DataFrame, df: DataFrame) -> DataFrame:
    """The columns of ``documents`` in their order; ``n_chars`` follows the text."""
    return df.withColumn("n_chars", F.char_length(F.coalesce("text", F.lit(""))).cast("long")).select(*[F.col(f"`{c}`") for c in like.columns])


def _fresh(stage):
    """Before a stage the driver gives back what earlier ones left: frames that nothing uses hold their plans and broadcasts."""
    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        give_back()
        return stage(spark, docs, sf_dir)
    return run_stage


@_fresh
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score of 0.5 or more go. Fitted on the labelled rows that are not held out."""
    model = toxicity.fit(toxicity.training_rows(docs, table(spark, sf_dir, "labels").filter(~held_out())))
    scored = toxicity.tag(docs, model, spans=False, carry=docs.columns).filter(F.col("score") < 0.5)
    return scored.select(*[F.col(f"carry_{i}").alias(c) for i, c in enumerate(docs.columns)])


@_fresh
def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of 40 or more characters held by 5 or more documents stay in one of them."""
    return _columns(docs, line_dedup.dedup_lines(docs, keep_columns=True))


@_fresh
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays: five-word shingles, similarity 0.8."""
    return ngram_join.one_of_each(docs)


@_fresh
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: a row per document and pass, holding the words that pass takes."""
    return _columns(docs, mixing.mixed_texts(docs, block=MIX_BLOCK))


@_fresh
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where every token of the mix goes, in sequences of 4096."""
    return packing.pack(docs, word_bpe()).withColumnRenamed("id", "doc_id")


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", dedup_lines),
    ("n-gram join", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        path = scratch(spark, f"pipeline-{k}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
