"""File sources, the dense record index, and sinks."""

from tuneframe.sources.index import with_index  # noqa: F401
from tuneframe.sources.readers import (  # noqa: F401
    preview,
    read_csv,
    read_dataset,
    read_json,
    read_jsonl,
    read_parquet,
    read_training_records,
    read_txt,
    records_from_lines,
    register_dataset,
    require_rows,
    write_jsonl,
    write_parquet,
)
