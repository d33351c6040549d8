"""Arrow batches as Python values, few rows and few bytes at a time."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute

#: Rows and bytes that a mapped function holds as Python objects at once; one longer value stands alone.
ROWS = 256
BYTES = 8 << 20


def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """The rows of two-column batches (key, text or bytes) as lists of few rows and few bytes; nulls are None."""
    for batch in batches:
        sizes = pa.compute.binary_length(batch.column(1)).to_pylist()
        start = 0
        while start < batch.num_rows:
            end, held = start + 1, sizes[start] or 0
            while end < batch.num_rows and end - start < ROWS and (held := held + (sizes[end] or 0)) <= BYTES:
                end += 1
            part = batch.slice(start, end - start)
            yield list(zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True))
            start = end
