"""Chat formatting: event-sourced reconstruction, then a reversible template (native).

A conversation is stored as a log of events. Messages are rebuilt from the
log (streamed deltas, edits, regenerations) and rendered with turn marks;
control strings inside texts are escaped so that the output can be read
back exactly.

Events: ``conv_id, seq, kind, turn, role, text``.

* ``message`` starts turn ``turn`` with ``role`` and ``text`` (a reset)
* ``delta`` appends ``text`` to the turn
* ``edit`` replaces the turn's text (a reset) and discards later turns logged before it
* ``regenerate`` empties the turn (a reset), later deltas refill it; it discards later turns logged before it

Unknown kinds are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
RESETS = ("message", "edit", "regenerate")


def escape(col: Column) -> Column:
    """One backslash into every ``<|`` (after those already there); afterwards no control string is left."""
    return F.regexp_replace(col, r"<(\\*)\|", r"<\\$1|")


def unescape(col: Column) -> Column:
    return F.regexp_replace(col, r"<\\(\\*)\|", r"<$1|")


def escape_role(col: Column) -> Column:
    """A role must not hold the line break that ends it."""
    return escape(F.replace(F.replace(col, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def unescape_role(col: Column) -> Column:
    return F.replace(F.replace(unescape(col), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def reconstruct(events: DataFrame) -> DataFrame:
    """Fold a log to its final messages: ``conv_id, turn, role, text``.

    Partitioned by conversation once; all steps below keep that partitioning.
    Ties in ``seq`` are broken by kind, role and text. A turn without a
    reset starts empty at its first delta. Null roles and texts are empty;
    null ids form a conversation, or a turn, of their own (a null turn comes
    first). Events with a null ``seq`` count as the oldest.
    """
    e = events.select(
        "conv_id", F.coalesce(F.col("seq").cast("long"), F.lit(-(2**63))).alias("seq"), "kind", "turn",
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    ).filter(F.col("kind").isin(*RESETS, "delta")).repartition("conv_id")
    reset = F.col("kind").isin(*RESETS)
    w = Window.partitionBy("conv_id", "turn")
    e = e.withColumn("_reset", F.max(F.when(reset, F.col("seq"))).over(w))
    live = F.col("_reset").isNull() | (F.col("seq") >= F.col("_reset"))
    part = F.when(live & (F.col("kind") != "regenerate"),
                  F.struct(F.col("seq"), F.when(F.col("kind") == "delta", 1).otherwise(0).alias("late"), "text"))
    told = F.when(F.col("role") != "", F.struct(F.col("seq"), F.col("role")))
    branch = F.max(F.when(F.col("kind").isin("edit", "regenerate"), F.col("seq")))
    turns = e.groupBy("conv_id", "turn").agg(
        F.sort_array(F.collect_list(part)).alias("_parts"), F.max(told).alias("_role"),
        F.coalesce(F.first("_reset"), F.min("seq")).alias("_since"), branch.alias("_branch"),
    )
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    turns = turns.withColumn("_cut", F.max("_branch").over(before))
    # Of a turn that was under way before the cut, what was logged after it stays.
    whole = F.col("_cut").isNull() | (F.col("_since") > F.col("_cut"))
    turns = turns.withColumn("_parts", F.when(whole, F.col("_parts")).otherwise(F.filter("_parts", lambda p: p["seq"] > F.col("_cut"))))
    turns = turns.filter(whole | (F.size("_parts") > 0))
    return turns.select(
        "conv_id", "turn", F.coalesce(F.col("_role.role"), F.lit("")).alias("role"),
        F.array_join(F.transform("_parts", lambda p: p["text"]), "").alias("text"),
    )


def messages_as_events(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                       text_col: str = "text") -> DataFrame:
    """Finished turns as the log that streaming them would have left.

    Each row starts an empty message and streams its text in two deltas. Rows
    that repeat a turn number stay turns of their own: they are ordered by
    turn, role and text and numbered anew.
    """
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    t = rows.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"),
                    F.col(text_col).alias("text"))
    t = t.repartition("conv_id").withColumn("turn", F.row_number().over(w).cast("long"))
    text = F.coalesce("text", F.lit(""))
    half = F.floor(F.char_length(text) / 2).cast("int")
    events = F.array(
        F.struct(F.lit(0).alias("n"), F.lit("message").alias("kind"), F.lit("").alias("text")),
        F.struct(F.lit(1).alias("n"), F.lit("delta").alias("kind"), F.substring(text, F.lit(1), half).alias("text")),
        F.struct(F.lit(2).alias("n"), F.lit("delta").alias("kind"),
                 F.substring(text, half + 1, F.char_length(text)).alias("text")),
    )
    return t.withColumn("e", F.explode(events)).select(
        "conv_id", (F.col("turn") * 3 + F.col("e.n")).alias("seq"), F.col("e.kind").alias("kind"), "turn", "role",
        F.col("e.text").alias("text"),
    )


def render(messages: DataFrame, learn: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row per conversation: ``conv_id, formatted, loss_spans``.

    A turn reads ``<|im_start|>role\\ntext<|im_end|>\\n``. ``loss_spans`` are
    ``(turn, start, length)`` in code points, ``turn`` counted from 0 and
    ``start`` from that turn's start mark: the text of each turn whose role is in ``learn``.
    """
    head = F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n"))
    body = escape(F.col("text"))
    m = messages.select(
        "conv_id", F.struct("turn", F.concat(head, body, F.lit(END + "\n")).alias("text"), F.col("role").alias("role"),
                            F.char_length(head).alias("start"), F.char_length(body).alias("length")).alias("m"))
    c = m.groupBy("conv_id").agg(F.sort_array(F.collect_list("m")).alias("m"))
    numbered = F.transform("m", lambda x, k: F.struct(x["role"].alias("role"), k.cast("int").alias("turn"),
                                                      x["start"].alias("start"), x["length"].alias("length")))
    spans = F.transform(F.filter(numbered, lambda x: x["role"].isin(*learn)),
                        lambda x: F.struct(x["turn"].alias("turn"), x["start"].alias("start"), x["length"].alias("length")))
    return c.select("conv_id", F.array_join(F.transform("m", lambda x: x["text"]), "").alias("formatted"),
                    spans.alias("loss_spans"))


def read_back(formatted: DataFrame) -> DataFrame:
    """Invert ``render``: adds ``turns`` (``role, text``) and ``loss`` (the texts under the mask, unescaped)."""
    # Texts hold no control string, so the marks split exactly.
    chunks = F.split(F.col("formatted"), r"<\|im_start\|>", -1)
    f = formatted.withColumn("_chunks", F.slice(chunks, F.lit(2), F.greatest(F.size(chunks) - 1, F.lit(0))))

    def turn(c):
        role = F.substring_index(c, "\n", 1)
        skip = F.char_length(role) + 2
        return F.struct(unescape_role(role).alias("role"),
                        unescape(F.substring(c, skip, F.char_length(c) - skip - len(END))).alias("text"))

    def masked(s):
        c = F.get(F.col("_chunks"), s["turn"])
        return unescape(F.substring(c, s["start"] - len(START) + 1, s["length"]))

    return f.withColumn("turns", F.transform("_chunks", turn)).withColumn(
        "loss", F.transform("loss_spans", masked)).drop("_chunks")


def format_conversations(events: DataFrame) -> DataFrame:
    """Reconstruct and render a log; empty logs give no rows."""
    return render(reconstruct(events))
