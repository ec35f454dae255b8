"""Expressions over canonical ``messages: array<struct<role,content>>``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tuneframe.functions.text import py_strip

MESSAGE_TYPE = "array<struct<role:string,content:string>>"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def msg(role, content) -> Column:
    return F.struct(_c(role).alias("role"), _c(content).alias("content"))


def empty_messages() -> Column:
    return F.expr(f"cast(array() as {MESSAGE_TYPE})")


def join_content(messages, sep: str) -> Column:
    """Contents joined with ``sep``."""
    return F.array_join(F.transform(_c(messages), lambda m: m["content"]), sep)


def content_hash(messages) -> Column:
    """32-byte SHA-256 of the ordered (role, stripped content) list.

    Only equality matters. JSON text delimits fields collision-free, and the
    binary digest keeps the shuffle key at 32 bytes whatever the text size.
    """
    canon = F.transform(
        _c(messages),
        lambda m: F.struct(py_strip(m["content"]).alias("content"), m["role"].alias("role")),
    )
    return F.unhex(F.sha2(F.to_json(canon), 256))
