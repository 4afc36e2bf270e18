"""Raw bytes of Arrow columns."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def text_and_offsets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string or binary column and the borders of its rows in them.

    Spark sends either the usual types, with 32-bit offsets, or the large ones.
    """
    kind = column.type
    if pa.types.is_large_binary(kind) or pa.types.is_large_string(kind):
        width = np.int64
    elif pa.types.is_binary(kind) or pa.types.is_string(kind):
        width = np.int32
    else:
        raise TypeError(f"a string or binary column is needed, got {kind}")
    _, offsets, data = column.buffers()
    borders = np.frombuffer(offsets, width)[column.offset : column.offset + len(column) + 1]
    text = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return text[borders[0] : borders[-1]], borders - borders[0]
