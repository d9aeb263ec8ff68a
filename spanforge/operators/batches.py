"""Arrow batches of bounded size, into Python and out of it."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

#: Rows, and bytes of text unless one row has more, that are handled together inside
#: one Arrow batch; bounds what Python holds at a time.
SLICE_ROWS, SLICE_BYTES = 256, 1 << 23
#: Rows, and bytes unless one row has more, of a batch that Python gives back.
OUT_ROWS, OUT_BYTES = 8192, 4 << 20
#: Bytes of an Arrow batch on its way to Python; the setting, and its value by default.
ARROW_BYTES, _ARROW_KEY, _ARROW_DEFAULT = 4 << 20, "spark.sql.execution.arrow.maxBytesPerBatch", 64 << 20


def bound_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches in bytes, unless the session has its own bound.

    By default a batch has 10000 rows or 64 MB; buffers of that size, doubled while they
    grow, are held by every task of an executor and by its Python worker.
    """
    if spark.conf.get(_ARROW_KEY) in (f"{_ARROW_DEFAULT}b", str(_ARROW_DEFAULT)):
        spark.conf.set(_ARROW_KEY, str(ARROW_BYTES))


def _is_bytes(kind: pa.DataType) -> bool:
    return pa.types.is_string(kind) or pa.types.is_binary(kind) or pa.types.is_large_string(kind) or pa.types.is_large_binary(kind)


def text_bytes(batch: pa.RecordBatch, without: int | None = None) -> np.ndarray:
    """Bytes of each row's strings, but those of one column."""
    held = np.zeros(batch.num_rows, np.int64)
    for i, c in enumerate(batch.columns):
        if i != without and _is_bytes(c.type):
            held += pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False)
    return held


def slices(batches: Iterable[pa.RecordBatch], rows: int = SLICE_ROWS, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        upto, low = np.cumsum(text_bytes(batch)), 0
        while low < batch.num_rows:
            room = int(np.searchsorted(upto, (upto[low - 1] if low else 0) + size, "right"))
            high = min(max(room, low + 1), low + rows, batch.num_rows)
            yield batch.slice(low, high - low)
            low = high


def _width(value: object) -> int:
    if isinstance(value, str | bytes):
        return len(value)
    return 8 * len(value) if isinstance(value, list | np.ndarray) else 0


def packed(rows: Iterable[tuple], kinds: list[pa.DataType], names: list[str], more: Callable[[tuple], int] | None = None) -> Iterator[pa.RecordBatch]:
    """Batches of the rows, which are taken one at a time: no more of them is held than a batch.

    ``more`` gives the bytes that a row takes besides its own values.
    """
    held, size = [], 0

    def made() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in held], kind) for k, kind in enumerate(kinds)], names)

    for row in rows:
        held.append(row)
        size += sum(map(_width, row)) + (more(row) if more else 0)
        if len(held) >= OUT_ROWS or size >= OUT_BYTES:
            yield made()
            held, size = [], 0
    if held:
        yield made()
