"""Arrow batches in bounded parts, and what a worker keeps from task to task."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on together.
PART = 1 << 20
_kept: list[tuple[object, object]] = []


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of texts put together, and where each begins and ends. Null is empty."""
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    if column.null_count:
        column = pc.fill_null(column, "")
    offsets = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def parts_of(batch: pa.RecordBatch, size: int = PART, rows: int = 1024, column: str = "text") -> Iterator[pa.RecordBatch]:
    """A batch in slices of at most `rows` rows and about `size` bytes of a column; a longer text is a slice of its own."""
    cuts, first = raw(batch[column])[1], 0
    while first < batch.num_rows:
        upto = max(first + 1, int(np.searchsorted(cuts, cuts[first] + size, side="right")) - 1)
        upto = min(upto, first + rows, batch.num_rows)
        yield batch.slice(first, upto - first)
        first = upto


def kept(key: object, make: Callable[[], object]) -> object:
    """What this worker keeps under `key` until another key is asked for: a worker serves one operator after the other, and holds the tables of one."""
    if not _kept or _kept[0][0] != key:
        _kept.clear()
        pa.default_memory_pool().release_unused()
        _kept.append((key, make()))
    return _kept[0][1]
