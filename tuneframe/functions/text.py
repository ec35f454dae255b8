"""String expressions with Python ``str`` semantics, kept JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python's str.isspace() accepts, i.e. what
# str.strip() and str.split() treat as whitespace.
WS_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# The same set as a Java regex character class (one or more).
WS_REGEX = (
    "[\\t\\n\\x0b\\x0c\\r\\x1c-\\x1f \\x85\\xa0\\u1680\\u2000-\\u200a"
    "\\u2028\\u2029\\u202f\\u205f\\u3000]+"
)

# The chat-tag pattern that marks llama-style text.
INST_TAG_PATTERN = r"\[/?INST\]|<\|.*?\|>|<<SYS>>|<</SYS>>"
# Control characters that count as unsupported tokens.
CONTROL_CHAR_PATTERN = "[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def py_strip(col) -> Column:
    """``str.strip()``: remove the whitespace set from both ends."""
    return F.btrim(_c(col), F.lit(WS_CHARS))


def words(col) -> Column:
    """``str.split()``: whitespace runs split, no empty pieces."""
    return F.filter(F.split(_c(col), WS_REGEX), lambda w: w != F.lit(""))


def n_words(col) -> Column:
    return F.size(words(col))


# The literal alternatives of INST_TAG_PATTERN; the remaining one,
# ``<\|.*?\|>``, can only match where ``<|`` occurs.
INST_TAG_LITERALS = ["[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]


def has_inst_tags_sql(text: str) -> str:
    """F4 as SQL: substring tests first, the regex only behind ``<|``.

    Equal to ``text RLIKE INST_TAG_PATTERN`` but avoids a lazy scan from
    every ``<`` of long texts. The text is evaluated once, and one that holds
    neither ``INST]`` nor ``<`` is searched for these two alone.
    """
    inst, rest = [" OR ".join(f"contains(t, '{x}')" for x in INST_TAG_LITERALS if ("INST" in x) == k) for k in (True, False)]
    regex = "(contains(t, '<|') AND t RLIKE '<\\\\|.*?\\\\|>')"
    return f"exists(array({text}), t -> (contains(t, 'INST]') AND ({inst})) OR (contains(t, '<') AND ({rest} OR {regex})))"


def has_inst_tags(col) -> Column:
    """llama chat tags anywhere in the text ('.' excludes newline)."""
    c = _c(col)
    lits = None
    for lit in INST_TAG_LITERALS:
        hit = F.instr(c, lit) > 0
        lits = hit if lits is None else lits | hit
    return lits | ((F.instr(c, "<|") > 0) & c.rlike(r"<\|.*?\|>"))
