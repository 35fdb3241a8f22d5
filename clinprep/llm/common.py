"""What the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clinprep.sources.files import stored

__all__ = ["BLANK_FREE", "RollingHash", "arrow_map", "arrow_schema", "ascii_words", "in_batches", "in_small_batches", "load", "mix64",
           "scalar", "sorted_groups", "stored", "word_counts"]

#: A run of anything but ASCII white space, in Java's regular expressions.
BLANK_FREE = r"[^\x20\x09-\x0D]+"

_LETTERS_DIGITS = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
    for b in range(256))


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def in_small_batches(df: DataFrame) -> DataFrame:
    """The frame; Python workers of its session get at most some megabytes at once from now on.

    Spark's default of 10,000 rows makes batches of whole texts that take hundreds of megabytes
    in an executor, off its heap and in its workers.
    """
    conf = df.sparkSession.conf
    conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    return df


def word_counts(text: str) -> Column:
    """Number of blank-free runs of a text column; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(BLANK_FREE)), F.lit(0)).cast("long")


def ascii_words(text: str | None) -> list[bytes]:
    """Words of ASCII letters (lower-cased), digits and all other characters, as UTF-8."""
    return (text or "").encode().translate(_LETTERS_DIGITS).split()


def arrow_map(df: DataFrame, columns: list[str], schema: str,
              work: Callable[..., dict[str, list]]) -> DataFrame:
    """``work`` applied to Arrow batches of ``columns``, narrow and streaming.

    ``work`` gets one Python list per column and returns one list per output column.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = None
        for batch in batches:
            if batch.num_rows:
                kinds = kinds or arrow_schema(schema)
                yield pa.RecordBatch.from_pydict(work(*[c.to_pylist() for c in batch.columns]), schema=kinds)

    return in_small_batches(df.select(*columns)).mapInArrow(run, schema)


def arrow_schema(schema: str) -> pa.Schema:
    """Arrow types of a short DDL string such as ``a long, b array<string>``."""
    plain = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(),
             "boolean": pa.bool_(), "binary": pa.binary()}

    def kind(name: str) -> pa.DataType:
        return pa.list_(kind(name[6:-1])) if name.startswith("array<") else plain[name]

    fields = [part.strip().split(" ") for part in schema.split(",")]
    return pa.schema([(name, kind(of)) for name, of in fields])


def scalar(df: DataFrame):
    """The single value of a one-row, one-column aggregate."""
    return df.first()[0]


def mix64(values: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit values (the finalizer of splitmix64)."""
    v = values.astype(np.uint64, copy=True)
    v ^= v >> np.uint64(30)
    v *= np.uint64(0xBF58476D1CE4E5B9)
    v ^= v >> np.uint64(27)
    v *= np.uint64(0x94D049BB133111EB)
    v ^= v >> np.uint64(31)
    return v


class RollingHash:
    """64-bit hashes of byte ranges by differences of one running polynomial sum.

    The sum over a buffer gives the hash of every range of it in a few vector operations.
    The hash of a range depends on its bytes only, not on where they stand.
    """

    BASE = 0x9E3779B97F4A7C15 | 1

    def __init__(self):
        self._powers = np.ones(1, np.uint64)
        self._inverse = np.ones(1, np.uint64)

    def _grow(self, size: int) -> None:
        if len(self._powers) < size:
            size = 1 << (size - 1).bit_length()
            for name, base in (("_powers", self.BASE), ("_inverse", pow(self.BASE, -1, 1 << 64))):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))

    def ranges(self, data: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hash of ``data[start:end]`` for each pair."""
        self._grow(len(data) + 1)
        total = np.zeros(len(data) + 1, np.uint64)
        values = _BYTE_VALUES[np.frombuffer(data, np.uint8)]
        np.cumsum(values * self._powers[:len(data)], out=total[1:])
        return mix64((total[ends] - total[starts]) * self._inverse[starts] + (ends - starts).astype(np.uint64))


_BYTE_VALUES = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """``(key, rows)`` of input that is sorted by its first ``keys`` columns; only one group is held."""
    key, rows = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if row[:keys] != key:
                if rows:
                    yield key, rows
                key, rows = row[:keys], []
            rows.append(row[keys:])
    if rows:
        yield key, rows


def in_batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 2000) -> Iterator[pa.RecordBatch]:
    """Rows as Arrow batches."""
    waiting = []
    for row in rows:
        waiting.append(row)
        if len(waiting) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*waiting), schema.types)], schema=schema)
            waiting = []
    if waiting:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*waiting), schema.types)], schema=schema)
