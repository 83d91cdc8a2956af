"""Arrow batches in bounded parts: what a worker holds beside a batch is what one part takes, whatever the batch's size."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes and rows that are worked on together.
PART_BYTES, PART_ROWS = 1 << 20, 256


def parts(*columns: pa.Array) -> Iterator[tuple[pa.Array, ...]]:
    """Slices of columns, bounded by rows and by the bytes of the first one (texts); a longer text is a slice of its own."""
    ends = np.cumsum(np.r_[0, pc.fill_null(pc.binary_length(columns[0]), 0).to_numpy(zero_copy_only=False).astype(np.int64)])
    first, n = 0, len(columns[0])
    while first < n:
        upto = min(max(first + 1, int(np.searchsorted(ends, ends[first] + PART_BYTES, side="right")) - 1), first + PART_ROWS, n)
        yield tuple(c.slice(first, upto - first) for c in columns)
        first = upto


def as_column(values: Sequence, kind: pa.DataType) -> pa.Array:
    """Texts, bytes (either may be null), booleans or numbers as a column, copied once. `pa.array` imports pandas, grows buffers by doubling, and never frees a memoryview."""
    if not (pa.types.is_string(kind) or pa.types.is_binary(kind)):
        data = np.packbits(values, bitorder="little") if pa.types.is_boolean(kind) else np.array(values, str(kind))
        return pa.Array.from_buffers(kind, len(values), [None, pa.py_buffer(data)])
    raw = [v.encode() if isinstance(v, str) else b"" if v is None else v for v in values]
    ends = np.cumsum([0, *map(len, raw)], dtype=np.int64)
    if ends[-1] > np.iinfo(np.int32).max:
        raise ValueError(f"{ends[-1]} bytes are too many for a column")
    there = pa.py_buffer(np.packbits([v is not None for v in values], bitorder="little")) if None in values else None
    return pa.Array.from_buffers(kind, len(raw), [there, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(b"".join(raw))])
