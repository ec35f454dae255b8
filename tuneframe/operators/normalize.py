"""Records of any supported format -> canonical chat messages.

A record DataFrame carries ``idx BIGINT`` (file order), ``raw STRING`` (the
record as JSON text) and ``v VARIANT`` (the parsed object). Every branch is a
higher-order-function expression over the VARIANT, so normalisation is one
projection inside whole-stage codegen: no Python, no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tuneframe.functions.messages import MESSAGE_TYPE
from tuneframe.functions.text import WS_CHARS, has_inst_tags_sql

# Dataset formats in their declared order (ties in the format
# vote go to the earlier one).
FORMATS = ["alpaca", "sharegpt", "chatml", "openai", "llama", "preference", "raw_text", "unknown"]

# ShareGPT speaker names and the canonical role they map to;
# any other speaker becomes "user".
SHAREGPT_ROLES = {
    "human": "user",
    "user": "user",
    "gpt": "assistant",
    "chatgpt": "assistant",
    "assistant": "assistant",
    "system": "system",
    "bot": "assistant",
}
# Roles kept by the chat-format normaliser; others become "user".
CHAT_ROLES = ["system", "user", "assistant", "tool"]
# The training normaliser's smaller ShareGPT map (other
# speakers pass through unchanged).
TRAIN_SHAREGPT_ROLES = {"human": "user", "gpt": "assistant", "system": "system"}


def _sql_str(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _strip(e: str) -> str:
    return f"btrim({e}, {_sql_str(WS_CHARS)})"


def _map_lit(d: dict) -> str:
    return "map(" + ", ".join(f"{_sql_str(k)}, {_sql_str(v)}" for k, v in d.items()) + ")"


def has(obj: str, key: str) -> str:
    """Key presence (an explicit JSON null counts as present)."""
    return f"(try_variant_get({obj}, '$.{key}', 'variant') IS NOT NULL)"


def get_str(obj: str, key: str) -> str:
    """The value as text; objects and arrays render as JSON, null as SQL NULL."""
    return f"try_variant_get({obj}, '$.{key}', 'string')"


def get_truthy(obj: str, key: str) -> str:
    """:func:`get_str`, but SQL NULL for ``""``, ``false``, zero, ``[]`` and ``{}`` (a text ``"0"`` is kept)."""
    text = get_str(obj, key)
    first = f"left(to_json(try_variant_get({obj}, '$.{key}', 'variant')), 1)"
    return (
        f"CASE WHEN {text} = '' THEN NULL "
        f"WHEN {text} RLIKE '^(false|\\\\[\\\\]|\\\\{{\\\\}}|-?0([.]0*)?([eE][-+]?[0-9]+)?)$' AND {first} <> '\"' THEN NULL "
        f"ELSE {text} END"
    )


def is_object(e: str) -> str:
    """Whether a VARIANT is an object, by its type alone: no member is read."""
    return f"(try_variant_get({e}, '$', 'struct<>') IS NOT NULL)"


def is_empty_object(e: str) -> str:
    """Whether a VARIANT is ``{{}}``; only the members' names are read."""
    return f"(coalesce(size(try_variant_get({e}, '$', 'map<string,variant>')), -1) = 0)"


def _truthy_scalar_non_list(e: str) -> str:
    # A number or true in place of a list: iterating it is a conversion error.
    return (
        f"({e} IS NOT NULL AND schema_of_variant({e}) IN ('BIGINT','DOUBLE','FLOAT','BOOLEAN') "
        f"AND coalesce(try_variant_get({e}, '$', 'double'), 0D) <> 0D)"
        f" OR ({e} IS NOT NULL AND schema_of_variant({e}) LIKE 'DECIMAL%'"
        f" AND coalesce(try_variant_get({e}, '$', 'double'), 0D) <> 0D)"
    )


def _msg(role: str, content: str) -> str:
    return f"named_struct('role', {role}, 'content', {content})"


def _empty() -> str:
    return f"cast(array() as {MESSAGE_TYPE})"


# --------------------------------------------------------------------------
# Branch expressions (SQL text over column ``v``)
# --------------------------------------------------------------------------


def sharegpt_sql(v: str = "v") -> str:
    """N1."""
    arr = f"try_variant_get({v}, '$.conversations', 'array<variant>')"
    speaker = (
        f"lower(coalesce(nullif({get_str('c', 'from')}, ''), nullif({get_str('c', 'role')}, ''), 'user'))"
    )
    role = f"coalesce(try_element_at({_map_lit(SHAREGPT_ROLES)}, {speaker}), 'user')"
    content = (
        f"CASE WHEN {has('c', 'value')} THEN coalesce({get_str('c', 'value')}, '') "
        f"WHEN {has('c', 'content')} THEN coalesce({get_str('c', 'content')}, '') ELSE '' END"
    )
    return (
        f"coalesce(transform(filter({arr}, c -> {is_object('c')}), c -> {_msg(role, content)}), {_empty()})"
    )


def chatml_sql(v: str = "v") -> str:
    """N2."""
    arr = f"try_variant_get({v}, '$.messages', 'array<variant>')"
    raw_role = f"lower(coalesce({get_str('c', 'role')}, 'user'))"
    roles = ", ".join(_sql_str(r) for r in CHAT_ROLES)
    role = f"CASE WHEN {raw_role} IN ({roles}) THEN {raw_role} ELSE 'user' END"
    content = f"coalesce({get_str('c', 'content')}, '')"
    return f"coalesce(transform(filter({arr}, c -> {is_object('c')}), c -> {_msg(role, content)}), {_empty()})"


def preference_sql(v: str = "v") -> str:
    """Prompt turn, then the chosen answer (list roles kept verbatim)."""
    prompt = (
        f"coalesce({get_truthy(v, 'prompt')}, {get_truthy(v, 'instruction')}, {get_truthy(v, 'input')}, '')"
    )
    chosen_arr = f"try_variant_get({v}, '$.chosen', 'array<variant>')"
    item_role = f"coalesce({get_str('c', 'role')}, 'assistant')"
    item_content = f"coalesce({get_str('c', 'content')}, '')"
    list_part = (
        f"transform(filter({chosen_arr}, c -> {is_object('c')}), c -> {_msg(item_role, item_content)})"
    )
    chosen_text = f"coalesce({get_str(v, 'chosen')}, '')"
    one_part = f"array({_msg(_sql_str('assistant'), chosen_text)})"
    return (
        f"concat(CASE WHEN {prompt} <> '' THEN array({_msg(_sql_str('user'), prompt)}) ELSE {_empty()} END, "
        f"CASE WHEN {chosen_arr} IS NOT NULL THEN {list_part} ELSE {one_part} END)"
    )


def alpaca_sql(v: str = "v") -> str:
    """N4."""
    instruction = f"coalesce({get_str(v, 'instruction')}, '')"
    inp = f"coalesce({get_truthy(v, 'input')}, '')"
    output = (
        f"coalesce(CASE WHEN {has(v, 'output')} THEN {get_truthy(v, 'output')} "
        f"ELSE {get_truthy(v, 'response')} END, '')"
    )
    joined = f"concat({instruction}, {_sql_str(chr(10) * 2)}, {inp})"
    user = f"CASE WHEN {inp} <> '' THEN {_strip(joined)} ELSE {instruction} END"
    return (
        f"concat(array({_msg(_sql_str('user'), user)}), "
        f"CASE WHEN {output} <> '' THEN array({_msg(_sql_str('assistant'), output)}) ELSE {_empty()} END)"
    )


LLAMA_PAIR = r"(?sU)\[INST\](.*?)\[/INST\](.*?)(?=\[INST\]|$)"
LLAMA_SYS = r"(?sU)^<<SYS>>(.*?)<</SYS>>(.*)$"


def llama_text_sql(text: str) -> str:
    """N5 over a string expression."""
    users = f"regexp_extract_all({text}, {_sql_str(LLAMA_PAIR)}, 1)"
    answers = f"regexp_extract_all({text}, {_sql_str(LLAMA_PAIR)}, 2)"
    u = _strip("p.u")
    sys_hit = f"({u} RLIKE {_sql_str(LLAMA_SYS)})"
    sys_txt = _strip(f"regexp_extract({u}, {_sql_str(LLAMA_SYS)}, 1)")
    rest = _strip(f"regexp_extract({u}, {_sql_str(LLAMA_SYS)}, 2)")
    user_txt = f"CASE WHEN {sys_hit} THEN {rest} ELSE {u} END"
    a = _strip("p.a")
    per_pair = (
        f"concat(CASE WHEN {sys_hit} THEN array({_msg(_sql_str('system'), sys_txt)}) ELSE {_empty()} END, "
        f"CASE WHEN {user_txt} <> '' THEN array({_msg(_sql_str('user'), user_txt)}) ELSE {_empty()} END, "
        f"CASE WHEN {a} <> '' THEN array({_msg(_sql_str('assistant'), a)}) ELSE {_empty()} END)"
    )
    pairs = f"transform(arrays_zip({users}, {answers}), z -> named_struct('u', z['0'], 'a', z['1']))"
    return (
        f"CASE WHEN size({users}) > 0 THEN flatten(transform({pairs}, p -> {per_pair})) "
        f"ELSE array({_msg(_sql_str('user'), text)}) END"
    )


def llama_sql(v: str = "v") -> str:
    return llama_text_sql(f"coalesce({get_str(v, 'text')}, '')")


def raw_text_sql(v: str = "v") -> str:
    """N6."""
    text = f"coalesce({get_str(v, 'text')}, '')"
    return f"array({_msg(_sql_str('user'), text)})"


def unknown_sql(v: str = "v", raw: str = "raw") -> str:
    """The record's own JSON text as one user turn; empty record -> none."""
    return f"CASE WHEN {v} IS NULL OR {is_empty_object(v)} THEN {_empty()} ELSE array({_msg(_sql_str('user'), raw)}) END"


def _tags_sql(v: str) -> str:
    return has_inst_tags_sql(f"coalesce({get_str(v, 'text')}, '')")


def messages_sql(fmt: str = "fmt", v: str = "v", raw: str = "raw") -> str:
    """Dispatch on dataset format OR on the record's own keys."""
    return (
        f"CASE WHEN {fmt} = 'sharegpt' OR {has(v, 'conversations')} THEN {sharegpt_sql(v)} "
        f"WHEN {fmt} IN ('chatml', 'openai') OR {has(v, 'messages')} THEN {chatml_sql(v)} "
        f"WHEN {fmt} = 'preference' OR ({has(v, 'chosen')} AND {has(v, 'rejected')}) THEN {preference_sql(v)} "
        f"WHEN {fmt} = 'alpaca' OR {has(v, 'instruction')} THEN {alpaca_sql(v)} "
        f"WHEN {fmt} = 'llama' OR ({has(v, 'text')} AND {_tags_sql(v)}) THEN {llama_sql(v)} "
        f"WHEN {has(v, 'text')} THEN {raw_text_sql(v)} "
        f"ELSE {unknown_sql(v, raw)} END"
    )


def norm_error_sql(fmt: str = "fmt", v: str = "v") -> str:
    """The branch taken would fail (e.g. ``conversations`` is a number)."""
    conv = f"try_variant_get({v}, '$.conversations', 'variant')"
    msgs = f"try_variant_get({v}, '$.messages', 'variant')"
    return (
        f"CASE WHEN {fmt} = 'sharegpt' OR {has(v, 'conversations')} THEN {_truthy_scalar_non_list(conv)} "
        f"WHEN {fmt} IN ('chatml', 'openai') OR {has(v, 'messages')} THEN {_truthy_scalar_non_list(msgs)} "
        f"ELSE false END"
    )


def to_messages(records: DataFrame, fmt: str | Column | None = None) -> DataFrame:
    """N8 + N9: add ``messages`` and ``norm_error``.

    ``fmt`` is a literal format name, a column (e.g. from a broadcast one-row
    detection result) or None to use an existing ``fmt`` column / key sniffing.
    """
    df = records
    if fmt is None and "fmt" not in df.columns:
        df = df.withColumn("fmt", F.lit("unknown"))
    elif isinstance(fmt, str):
        df = df.withColumn("fmt", F.lit(fmt))
    elif fmt is not None:
        df = df.withColumn("fmt", fmt)
    err = F.expr(norm_error_sql())
    return df.withColumn("norm_error", err).withColumn(
        "messages", F.when(err, F.lit(None).cast(MESSAGE_TYPE)).otherwise(F.expr(messages_sql()))
    )


def to_training_messages(records: DataFrame, fmt: str) -> DataFrame:
    """The trainer's own, format-driven normaliser (no key sniffing)."""
    if fmt == "sharegpt":
        speaker = get_str("c", "from")
        role = f"coalesce(try_element_at({_map_lit(TRAIN_SHAREGPT_ROLES)}, {speaker}), {speaker}, 'user')"
        content = f"coalesce({get_str('c', 'value')}, '')"
        e = (
            f"transform(coalesce(try_variant_get(v, '$.conversations', 'array<variant>'), array()), "
            f"c -> {_msg(role, content)})"
        )
    elif fmt in ("chatml", "openai"):
        role = f"coalesce({get_str('c', 'role')}, 'user')"
        content = f"coalesce({get_str('c', 'content')}, '')"
        e = (
            f"transform(coalesce(try_variant_get(v, '$.messages', 'array<variant>'), array()), "
            f"c -> {_msg(role, content)})"
        )
    elif fmt == "alpaca":
        instruction = f"coalesce({get_str('v', 'instruction')}, '')"
        inp = f"coalesce({get_str('v', 'input')}, '')"
        joined = f"concat({instruction}, {_sql_str(chr(10) * 2)}, {inp})"
        user = f"CASE WHEN {inp} <> '' THEN {_strip(joined)} ELSE {instruction} END"
        output = f"coalesce({get_str('v', 'output')}, '')"
        e = f"array({_msg(_sql_str('user'), user)}, {_msg(_sql_str('assistant'), output)})"
    elif fmt == "preference":
        prompt = f"coalesce({get_str('v', 'prompt')}, '')"
        e = f"array({_msg(_sql_str('user'), prompt)})"
    else:
        e = raw_text_sql("v")
    return records.withColumn("messages", F.expr(e).cast(MESSAGE_TYPE))


# --------------------------------------------------------------------------
# Long turn tables
# --------------------------------------------------------------------------


def fold_turns(
    turns: DataFrame,
    key: str = "conv_id",
    order: str = "turn",
    role: str = "role",
    text: str = "text",
) -> DataFrame:
    """``(key, order, role, text)`` rows -> one ``messages`` array per key.

    One hash shuffle on ``key``; the order comes from ``order``, never from
    arrival. A conversation is one record, so its turns form one group by
    definition (bounded by the record, not by the data set).
    """
    t = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(role).alias("r"), F.col(text).alias("t"))))
    return (
        turns.select(key, order, role, text)
        .groupBy(key)
        .agg(t.alias("_turns"))
        .select(
            F.col(key).alias("idx"),
            F.transform(
                "_turns",
                lambda x: F.struct(
                    F.coalesce(x["r"], F.lit("user")).alias("role"),
                    F.coalesce(x["t"], F.lit("")).alias("content"),
                ),
            ).alias("messages"),
            F.lit(False).alias("norm_error"),
        )
    )


def explode_messages(df: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """One row per message ``(*keep, pos, role, content)``."""
    keep = keep if keep is not None else ["idx"]
    return df.select(*keep, F.posexplode("messages").alias("pos", "m")).select(
        *keep, "pos", F.col("m.role").alias("role"), F.col("m.content").alias("content")
    )
