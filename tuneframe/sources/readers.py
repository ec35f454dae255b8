"""Dataset files -> record DataFrames ``(idx, raw, v)``; sinks.

Records stay dynamic: ``v`` is a VARIANT object and ``raw`` its JSON text, so
a missing key and an explicit null stay different (schema inference would
merge them). Every reader is a plain ``spark.read`` plus projections; the
file-order index is added by :func:`tuneframe.sources.index.with_index`.
JSON documents are sliced into their elements' own text, so ``raw`` keeps key
order and spacing.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tuneframe.functions.messages import empty_messages
from tuneframe.functions.text import WS_REGEX, py_strip
from tuneframe.session import configure
from tuneframe.sources.index import with_index

SUPPORTED_SUFFIXES = [".csv", ".json", ".jsonl", ".parquet", ".txt"]
# Wrapper keys tried, in order, for a JSON document object.
JSON_WRAPPER_KEYS = ["data", "examples", "records", "rows"]


def _order_cols():
    return [
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
    ]


def records_from_lines(lines: DataFrame, value: str = "value", strict: bool = False) -> DataFrame:
    """S1 core: JSON text lines -> ``(raw, v)``; keeps any other columns.

    Lines are stripped; blank lines skipped; malformed lines skipped (or an
    error when ``strict``); invalid UTF-8 becomes U+FFFD; non-object values
    are wrapped as ``{"value": x}``.
    """
    text = F.expr(f"make_valid_utf8({value})")
    others = [c for c in lines.columns if c != value]
    df = lines.select(*others, py_strip(text).alias("_line")).filter(F.col("_line") != "")
    parse = "parse_json(_line)" if strict else "try_parse_json(_line)"
    # Generated rows: the filter stays behind them, so each line is parsed once and not again for the test.
    df = df.select(*others, F.inline(F.array(F.struct("_line", F.expr(parse).alias("_v"))))).filter(F.col("_v").isNotNull())
    # Valid JSON text without white space around it is an object if it begins like one.
    is_obj = F.left(F.col("_line"), F.lit(1)) == "{"
    wrapped_raw = F.concat(F.lit('{"value":'), F.col("_line"), F.lit("}"))
    return df.select(
        *others,
        F.when(is_obj, F.col("_line")).otherwise(wrapped_raw).alias("raw"),
        F.when(is_obj, F.col("_v")).otherwise(F.expr("to_variant_object(named_struct('value', _v))")).alias("v"),
    )


def read_jsonl(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """S1 (and S12 with ``strict``): one JSON value per line."""
    configure(spark)
    lines = spark.read.text(path).select("value", *_order_cols())
    return with_index(records_from_lines(lines, strict=strict))


_SPACE = re.compile(r"[ \t\n\r]*")


def _no_constant(name: str):
    raise ValueError(f"{name} is not JSON")


def element_slices(doc: str, wrapper_keys: list[str], bare: bool) -> list[tuple[int, int]]:
    """Where the records of a JSON document begin and end.

    A list holds one per element; an object holds those of the list under
    the first of ``wrapper_keys`` that has one, else, with ``bare``, itself;
    any other value holds none. Raises ``ValueError`` for malformed text.
    """
    decode = json.JSONDecoder(parse_constant=_no_constant).raw_decode

    def skip(at: int) -> int:
        return _SPACE.match(doc, at).end()

    def sign(at: int) -> str:
        return doc[at : at + 1]

    def items(at: int) -> tuple[list[tuple[int, int]], int]:
        found, at = [], skip(at + 1)
        while sign(at) != "]" or found:
            end = decode(doc, at)[1]
            found.append((at, end))
            at = skip(end)
            if sign(at) == "]":
                break
            if sign(at) != ",":
                raise ValueError(f"no comma at {at}")
            at = skip(at + 1)
        return found, at + 1

    start = at = skip(0)
    found: list[tuple[int, int]] = []
    if sign(at) == "[":
        found, at = items(at)
    elif sign(at) == "{":
        lists: dict[str, list[tuple[int, int]] | None] = {}
        at = skip(at + 1)
        while sign(at) != "}" or lists:
            if sign(at) != '"':
                raise ValueError(f"no key at {at}")
            key, at = decode(doc, at)
            at = skip(at)
            if sign(at) != ":":
                raise ValueError(f"no colon at {at}")
            at = skip(at + 1)
            # The last of several equal keys counts.
            lists[key] = None
            if key in wrapper_keys and sign(at) == "[":
                lists[key], at = items(at)
            else:
                at = decode(doc, at)[1]
            at = skip(at)
            if sign(at) == "}":
                break
            if sign(at) != ",":
                raise ValueError(f"no comma at {at}")
            at = skip(at + 1)
        at += 1
        wrapped = [k for k in wrapper_keys if lists.get(k) is not None]
        found = lists[wrapped[0]] if wrapped else [(start, at)] if bare else []
    else:
        at = decode(doc, at)[1]
    if skip(at) != len(doc):
        raise ValueError(f"more text at {at}")
    return found


# Sliced elements leave a worker in batches of about this many characters.
SLICE_CHARS = 1 << 22


def read_json(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """One JSON document per file: a list, a wrapper object or one record.

    ``raw`` is the element's own text. A malformed document holds no records
    (an error when ``strict``). ``wholetext`` makes each file one row (one
    task per file), so prefer JSONL for large inputs.
    """
    configure(spark)
    docs = spark.read.text(path, wholetext=True).select(F.expr("make_valid_utf8(value)").alias("_doc"), *_order_cols())
    # The trainer's reader takes no single record: an object without the wrapper key holds none.
    keys, bare = (["data"], False) if strict else (JSON_WRAPPER_KEYS, True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, file, block in zip(*[batch.column(i) for i in range(3)], strict=True):
                text = doc.as_py()
                try:
                    places = element_slices(text, keys, bare)
                except (ValueError, RecursionError):
                    if strict:
                        raise
                    places = []
                held: list[str] = []
                size = 0
                for k, (a, b) in enumerate(places):
                    held.append(text[a:b])
                    size += b - a
                    if size >= SLICE_CHARS or k == len(places) - 1:
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(held, pa.string()), pa.array([file.as_py()] * len(held), pa.string()),
                             pa.array([block.as_py()] * len(held), pa.int64())],
                            names=["value", "_file", "_block"])
                        held, size = [], 0

    sliced = docs.mapInArrow(run, "value string, _file string, _block long")
    return with_index(records_from_lines(sliced, strict=strict))


def read_csv(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """S3: header names fields, every value a string (empty -> ''); the fields that a short row lacks are null.

    Spark's reader makes no difference between an empty field and a missing
    one, but keeps the text of a row that has too few fields: its separators
    outside quotes tell how many it has. A surplus is left out. Quoted line
    breaks need the whole file in one task; ``multi_line=False`` splits files.
    """
    configure(spark)
    options = dict(header=True, multiLine=multi_line, escape='"', quote='"', mode="PERMISSIVE")
    names, kept = spark.read.csv(path, inferSchema=False, **options).columns, "_short_row_"
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*names, kept]])
    df = spark.read.schema(schema).option("columnNameOfCorruptRecord", kept).csv(path, **options)
    bare = F.regexp_replace(F.col(kept), '"([^"]|"")*"', "")
    present = F.coalesce(F.char_length(bare) - F.char_length(F.replace(bare, F.lit(","), F.lit(""))) + 1, F.lit(len(names)))
    fields = [F.coalesce(F.col(f"`{c}`"), F.when(present > i, F.lit(""))).alias(c) for i, c in enumerate(names)]
    s = df.select(F.struct(*fields).alias("_r"), *_order_cols())
    return with_index(
        s.select(
            "_file",
            "_block",
            F.to_json("_r", {"ignoreNullFields": "false"}).alias("raw"),
            F.expr("to_variant_object(_r)").alias("v"),
        )
    )


def read_txt(spark: SparkSession, path: str) -> DataFrame:
    """One ``{"text": line}`` per non-blank line; inner spaces kept."""
    configure(spark)
    lines = spark.read.text(path).select(F.expr("make_valid_utf8(value)").alias("text"), *_order_cols())
    lines = lines.filter(~F.col("text").rlike(f"^({WS_REGEX})?$"))
    return with_index(
        lines.select(
            "_file",
            "_block",
            F.to_json(F.struct("text")).alias("raw"),
            F.expr("to_variant_object(named_struct('text', text))").alias("v"),
        )
    )


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    """Every column is a present key, even when null."""
    configure(spark)
    df = spark.read.parquet(path)
    cols = df.columns
    r = F.struct(*[F.col(f"`{c}`") for c in cols])
    s = df.select(r.alias("_r"), *_order_cols())
    return with_index(
        s.select(
            "_file",
            "_block",
            F.to_json("_r", {"ignoreNullFields": "false"}).alias("raw"),
            F.expr("to_variant_object(_r)").alias("v"),
        )
    )


def read_dataset(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    """Dispatch on the lower-cased file suffix."""
    suffix = fmt or ("." + path.rsplit(".", 1)[-1].lower() if "." in path.rsplit("/", 1)[-1] else "")
    if not suffix.startswith("."):
        suffix = "." + suffix
    readers = {
        ".jsonl": read_jsonl,
        ".json": read_json,
        ".csv": read_csv,
        ".txt": read_txt,
        ".parquet": read_parquet,
    }
    if suffix not in readers:
        raise ValueError(f"Unsupported file type '{suffix}'. Supported: {SUPPORTED_SUFFIXES}")
    return readers[suffix](spark, path)


def read_training_records(spark: SparkSession, path: str) -> DataFrame:
    """JSONL/JSON only; a malformed line fails the job; wrapper key ``data``."""
    if path.lower().endswith(".jsonl"):
        return read_jsonl(spark, path, strict=True)
    if path.lower().endswith(".json"):
        return read_json(spark, path, strict=True)
    raise ValueError(f"Unsupported dataset file for training: {path}")


def require_rows(df: DataFrame) -> DataFrame:
    """Zero records is a user error."""
    if df.isEmpty():
        raise ValueError("dataset has no records")
    return df


def preview(records: DataFrame, n: int = 20, as_: str = "raw") -> DataFrame:
    """First ``n`` (1-1000) records in file order (an index filter, no sort).

    ``as_="raw"`` shows ``(idx, raw)``, ``as_="chat"`` the messages of each
    record, by its ``fmt`` column or else by its own keys.
    """
    if not 1 <= int(n) <= 1000:
        raise ValueError(f"preview shows 1 to 1000 records, not {n}")
    head = records.filter(F.col("idx") < int(n))
    if as_ == "raw":
        return head
    if as_ == "chat":
        from tuneframe.operators.normalize import to_messages

        return to_messages(head).select("idx", F.coalesce("messages", empty_messages()).alias("messages"))
    raise ValueError(f"a preview is raw or chat, not {as_!r}")


# ------------------------------------------------------------------ sinks


def write_jsonl(messages: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One ``{"messages": [...]}`` object per line, UTF-8, non-ASCII kept."""
    messages.select(F.to_json(F.struct("messages")).alias("value")).write.mode(mode).text(path)


def write_parquet(messages: DataFrame, path: str, mode: str = "errorifexists") -> None:
    messages.write.mode(mode).parquet(path)


REGISTRY_SCHEMA = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("source_path", T.StringType()),
        T.StructField("path", T.StringType()),
        T.StructField("format", T.StringType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("row_count", T.LongType()),
        T.StructField("stats_json", T.StringType()),
        T.StructField("report_json", T.StringType()),
        T.StructField("repair_json", T.StringType()),
        T.StructField("repaired_from", T.StringType()),
    ]
)


def register_dataset(registry_path: str, job_id: str, entry: DataFrame) -> None:
    """One registry row per job, in a folder of the job's own.

    A job that runs again overwrites its row, and a row is seen only once it
    is written whole; so nothing is registered twice and nothing in halves.
    """
    entry.select(*[F.col(f.name).cast(f.dataType) for f in REGISTRY_SCHEMA.fields]).coalesce(1).write.mode("overwrite").parquet(
        f"{registry_path.rstrip('/')}/job_id={job_id}"
    )


def read_registry(spark: SparkSession, registry_path: str) -> DataFrame:
    """The registry's rows with their ``job_id``."""
    schema = T.StructType([*REGISTRY_SCHEMA.fields, T.StructField("job_id", T.StringType())])
    return spark.read.schema(schema).parquet(registry_path)
