"""Arrow batches as flat byte buffers, in slices of bounded size."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Bytes of text that a slice holds; a longer text makes a slice of its own.
SLICE_BYTES = 2 << 20


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts and where each begins (n + 1 offsets); null counts as empty."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[offsets[0]:offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with at most ``limit`` bytes of ``column``, or one row."""
    _, offsets = flat(batch.column(column))
    start = 0
    while start < batch.num_rows:
        end = int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1
        end = min(max(end, start + 1), batch.num_rows)
        yield batch.slice(start, end - start)
        start = end


def map_slices(
    df: DataFrame, column: str, schema: T.StructType, make: Callable[[], Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]]],
    limit: int = SLICE_BYTES,
) -> DataFrame:
    """Run one function per task over slices of its batches; ``make`` builds the function inside the task."""

    def run(batches):
        step = make()
        for batch in batches:
            for part in slices(batch, column, limit):
                yield from step(part)

    return df.mapInArrow(run, schema)


def batch_of(schema: T.StructType, columns: dict) -> pa.RecordBatch:
    """Columns (arrays or lists) in the order and with the types of a Spark schema."""
    target = to_arrow_schema(schema)
    out = []
    for field in target:
        value = columns[field.name]
        if not isinstance(value, pa.Array):
            value = pa.array(value, type=field.type)
        out.append(value if value.type == field.type else value.cast(field.type))
    return pa.RecordBatch.from_arrays(out, schema=target)
