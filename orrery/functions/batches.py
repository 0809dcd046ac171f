"""Arrow batches in pieces of bounded work."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Entries of a list column that a piece has at most, unless one row has more.
ENTRIES = 1 << 17


def pieces(batches, column: int, most: int = ENTRIES) -> Iterator[pa.RecordBatch]:
    """The rows of the batches, in slices whose lists in that column have at most so
    many entries in all. Ten thousand rows are one batch, however long their lists:
    what a worker makes of them at once would grow with the table's texts."""
    for b in batches:
        ends, start = b.column(column).offsets.to_numpy().astype(np.int64), 0
        while start < b.num_rows:
            stop = max(start + 1, int(np.searchsorted(ends, ends[start] + most, side="right")) - 1)
            yield b.slice(start, stop - start)
            start = stop
