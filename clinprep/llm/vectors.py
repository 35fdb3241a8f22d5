"""Embedding rows packed into integer matrix blocks.

Components are scaled and floored to whole numbers, so whatever is computed from them is exact.
A task gathers the rows it reads into blocks of at most ``BLOCK_ROWS`` rows of one length, by
rising id; nothing is shuffled, and a block holds the bytes of its ids, labels and matrix.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clinprep.llm.common import arrow_schema, in_small_batches

BLOCK_ROWS = 1 << 16
BLOCK_BYTES = 32 << 20
LARGEST = 2.0 ** 62
SCHEMA = "block long, n int, width int, ids binary, labels binary, kind string, cells binary, sums array<long>"


def usable(vector: str) -> Column:
    """Vectors that are not null and have finite entries only."""
    return F.col(vector).isNotNull() & F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))


def packed(rows: DataFrame, id_col: Column, label: Column, vector: str, scale: int, shift: int = 0,
           block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Blocks of ``floor(scale * component) + shift``, and their sums by component.

    Rows need usable vectors. A value of 2**62 or more is an error: no exact result fits a long.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, number = arrow_schema(SCHEMA), TaskContext.get().partitionId() << 32
        waiting: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}

        def block(width):
            nonlocal number
            ids, labels, cells = map(np.concatenate, zip(*waiting.pop(width)))
            order = np.argsort(ids, kind="stable")
            cells = cells[order]
            kind = next(k for k in ("<i2", "<i4", "<i8") if not cells.size or max(cells.max(), -cells.min()) <= np.iinfo(k).max)
            row = [number, len(ids), width, ids[order].tobytes(), labels[order].tobytes(), kind,
                   cells.astype(kind).tobytes(), cells.sum(0).tolist()]
            number += 1
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, schema.types)], schema=schema)

        for batch in batches:
            ids, labels = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
            lengths = batch.column(2).value_lengths().to_numpy(zero_copy_only=False)
            values = np.floor(batch.column(2).flatten().to_numpy(zero_copy_only=False) * scale)
            if values.size and np.abs(values).max() + abs(shift) >= LARGEST:
                raise ValueError("vector components are too large for exact scores")
            values = values.astype(np.int64) + shift
            of = np.repeat(lengths, lengths)
            for width in np.unique(lengths).tolist():
                here = lengths == width
                waiting.setdefault(width, []).append((ids[here], labels[here], values[of == width].reshape(here.sum(), width)))
                most = min(block_rows, max(1, BLOCK_BYTES // (8 * max(width, 1))))
                if sum(len(part[0]) for part in waiting[width]) >= most:
                    yield block(width)
        for width in list(waiting):
            yield block(width)

    return in_small_batches(rows.select(
        id_col.cast("long").alias("id"), label.cast("long").alias("label"), F.col(vector).cast("array<double>").alias("vector"))).mapInArrow(run, SCHEMA)


def unpacked(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, labels and integer matrix of a block."""
    cells = np.frombuffer(row["cells"], row["kind"]).reshape(row["n"], row["width"])
    return np.frombuffer(row["ids"], np.int64), np.frombuffer(row["labels"], np.int64), cells
