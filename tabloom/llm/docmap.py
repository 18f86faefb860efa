"""Adding columns to documents by a numpy kernel over their text buffer."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.llm.bytekit import PIECE_BYTES, pieces

#: (bytes, offsets, the piece's rows) -> new columns
Kernel = Callable[[np.ndarray, np.ndarray, pa.RecordBatch], list[pa.Array]]


def add_columns(docs: DataFrame, kernel: Kernel, fields: list[T.StructField], text: str = "text", drop: tuple[str, ...] = (), most: int = PIECE_BYTES, reads: tuple[str, ...] = ()) -> DataFrame:
    """docs without the columns `drop`, and with the kernel's columns; no shuffle.

    A null text comes to the kernel as an empty one. Columns of docs that have the name of a new one
    are replaced; the kernel sees the old ones only if `reads` names them.
    """
    new = {f.name for f in fields}
    work = docs.select(*(F.col(f"`{c}`") for c in docs.columns if c not in new or c == text or c in reads))
    kept = [c for c in work.columns if c not in drop and c not in new]
    schema = T.StructType([work.schema[c] for c in kept] + fields)
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, end, data, off in pieces(batch.column(text), most):
                rows = batch.slice(start, end - start)
                made = kernel(data, off, rows)
                yield pa.RecordBatch.from_arrays([rows.column(c) for c in kept] + made, names=names)

    return work.mapInArrow(run, schema)


def explode_rows(docs: DataFrame, kernel: Callable[[np.ndarray, np.ndarray, pa.RecordBatch], list[pa.Array]], schema: T.StructType, text: str = "text", most: int = PIECE_BYTES) -> DataFrame:
    """Rows of `schema` that the kernel makes from each piece of documents, any number of them."""
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, end, data, off in pieces(batch.column(text), most):
                made = kernel(data, off, batch.slice(start, end - start))
                for at in range(0, len(made[0]), 100_000):
                    yield pa.RecordBatch.from_arrays([x.slice(at, 100_000) for x in made], names=names)

    return docs.mapInArrow(run, schema)
