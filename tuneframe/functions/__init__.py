"""Shared Catalyst expressions (X1-X6, F4) used by every operator."""

from tuneframe.functions.text import (  # noqa: F401
    has_inst_tags,
    py_strip,
    words,
    n_words,
    WS_CHARS,
    WS_REGEX,
)
from tuneframe.functions.messages import (  # noqa: F401
    content_hash,
    join_content,
    msg,
    empty_messages,
)
from tuneframe.functions.buckets import (  # noqa: F401
    TOKEN_BUCKETS,
    TURN_BUCKETS,
    bucket_labels,
    histogram,
)
