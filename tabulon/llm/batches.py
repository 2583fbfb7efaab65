"""Arrow batches in pieces, so that a Python worker holds few texts as objects at a time."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa

#: Rows that are turned into Python objects together.
ROWS = 512


def slices(batches: Iterator[pa.RecordBatch], rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for begin in range(0, batch.num_rows, rows):
            yield batch.slice(begin, rows)
