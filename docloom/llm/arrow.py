"""Row-wise Arrow maps in bounded blocks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

#: Text bytes handed to a function at once: bounds a worker's memory whatever the batch.
BLOCK_BYTES = 1 << 20


def blocks(batch: pa.RecordBatch, column: int, limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of ``batch`` whose values in ``column`` take about ``limit`` bytes (one row at least)."""
    sizes = batch.column(column)
    if batch.num_rows == 0:
        return
    lengths = pa.compute.binary_length(sizes).fill_null(0).to_numpy(zero_copy_only=False) if not pa.types.is_list(sizes.type) else pa.compute.list_value_length(sizes).fill_null(0).to_numpy(zero_copy_only=False) * 4
    ends = lengths.cumsum(dtype="int64")
    start, n = 0, batch.num_rows
    while start < n:
        base = int(ends[start - 1]) if start else 0
        stop = max(start + 1, int(ends.searchsorted(base + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def add_columns(df: DataFrame, column: str, schema: str, make: Callable, keep: list[str] | None = None, setup: Callable | None = None, limit: int = BLOCK_BYTES) -> DataFrame:
    """``df``'s columns (or those in ``keep``) with the columns of ``schema``.

    ``make(values, state)`` gets an Arrow array of ``column`` and returns Arrow
    arrays in ``schema``'s order; ``setup()`` makes the state once a task. A
    column of ``df`` that has the name of a new one is replaced. A block has
    about ``limit`` bytes of ``column``.
    """
    added = StructType.fromDDL(schema)
    taken = {c.lower() for c in added.names}
    names = [c for c in (df.columns if keep is None else keep) if c.lower() not in taken]
    inputs = [*names, *([column] if column not in names else [])]
    at, n_keep = inputs.index(column), len(names)
    out = StructType([df.schema[c] for c in names] + list(added.fields))
    fields = [*names, *added.names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = setup() if setup else None
        for batch in batches:
            for part in blocks(batch, at, limit):
                made = make(part.column(at), state)
                yield pa.RecordBatch.from_arrays([*part.columns[:n_keep], *made], names=fields)

    return df.select(*inputs).mapInArrow(run, out)
