"""Helpers for operators that see rows as Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

#: Bytes of text that are worked on at once, so that memory doesn't follow the batch or the text length times a constant.
SLICE_BYTES = 1 << 20


def map_rows(df: DataFrame, f: Callable[[list[dict[str, list]]], dict[str, object]], schema: str, text: str = "text") -> DataFrame:
    """f over slices of df's rows (columns as lists; text as bytes, null as empty); f returns columns of schema."""
    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            column = batch.column(names.index(text)).cast(pa.large_binary())
            sizes = np.diff(np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]) if len(column) else np.zeros(0, np.int64)
            part = (np.cumsum(sizes) - sizes) // SLICE_BYTES
            edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(column)]
            for a, b in zip(edges, edges[1:], strict=False):
                if a == b:
                    continue
                cols = {n: batch.column(i).slice(a, b - a).to_pylist() for i, n in enumerate(names) if n != text}
                cols[text] = [x or b"" for x in column.slice(a, b - a).to_pylist()]
                out = f(cols)
                yield pa.RecordBatch.from_arrays([x if isinstance(x := out[c.name], pa.Array) else pa.array(x, c.type) for c in arrow], schema=arrow)

    return df.mapInArrow(run, schema)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, ... of each (start, length), one after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


def texts(docs: DataFrame, *carry: str) -> DataFrame:
    return docs.select(*[F.col(f"`{c}`") for c in carry], F.col("text"))
