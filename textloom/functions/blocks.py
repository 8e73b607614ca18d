"""Texts in blocks of bounded size, so that a task's Python memory does not follow the rows of an Arrow batch."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 20


def text_blocks(batches: Iterator[pa.Array], size: int = BLOCK_BYTES) -> Iterator[list[str]]:
    """The texts in lists of at most ``size`` bytes (one text at least); a missing text is empty."""
    for column in batches:
        ends = np.cumsum(pc.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
        start, before = 0, 0
        while start < len(column):
            stop = max(start + 1, int(np.searchsorted(ends, before + size, side="right")))
            yield [t or "" for t in column.slice(start, stop - start).to_pylist()]
            start, before = stop, int(ends[stop - 1])
