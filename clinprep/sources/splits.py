"""Units of a text that may span lines, read in splits.

A delimiter inside quotes does not end a unit: a line break in a quoted CSV cell, a brace in a
JSON string. Whether a split begins inside quotes depends on all text before it, so files are
read in two passes. The first counts, per split, whether the quotes are odd in number; a
running total over the splits of a file, a short table, gives the state each of them begins
in. In the second pass every split puts its units together on its own. What is open at its
end, and what it closes or carries on from before, are fragments, at most two for each split,
and only these are brought together.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

WHOLE, OPENS, INSIDE, CLOSES = 0, 1, 2, 3
PIECE_SCHEMA = "file string, block long, kind int, leads boolean, unit string"


def odd_quotes(text: Column) -> Column:
    """Whether a text has an odd number of double quotes."""
    return (F.length(text) - F.length(F.replace(text, F.lit('"'), F.lit("")))) % 2 == 1


def odd_json_quotes(text: Column) -> Column:
    """The same for JSON text, in which a backslash protects what follows it."""
    return odd_quotes(F.regexp_replace(text, r"\\.", ""))


def pieces(spark: SparkSession, path: str, delimiter: str, odd: Column) -> DataFrame:
    """``file, block, value, odd``: the text between delimiters, in the order of the splits."""
    return spark.read.option("lineSep", delimiter).text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value", odd.alias("odd"))


def open_splits(found: DataFrame) -> dict[tuple[str, int], bool]:
    """Splits that begin or end inside quotes, and whether they begin there.

    At most as many rows come to the driver as Spark plans splits there.
    """
    upto = Window.partitionBy("file").orderBy("block")
    turns = found.groupBy("file", "block").agg((F.count_if("odd") % 2).alias("turn"))
    states = turns.withColumn("ends", F.sum("turn").over(upto) % 2 == 1).withColumn("begins", F.col("ends") != (F.col("turn") == 1))
    return {(r.file, r.block): r.begins for r in states.where("begins or ends").select("file", "block", "begins").collect()}


def units(spark: SparkSession, path: str, delimiter: str = "\n", odd: Column | None = None) -> DataFrame:
    """``file, leads, unit``: the text between delimiters outside quotes; ``leads`` marks the first of a file.

    Delimiters inside a unit are kept. Quotes that are never closed make the rest of their file
    one unit.
    """
    found = pieces(spark, path, delimiter, odd_quotes(F.col("value")) if odd is None else odd)
    opened = spark.sparkContext.broadcast(open_splits(found))

    def put_together(fragments: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            return _put_together(batches, opened.value, delimiter, fragments)
        return run

    whole = found.mapInArrow(put_together(False), PIECE_SCHEMA).select("file", "leads", "unit")
    if not opened.value:
        return whole
    parts = found.mapInArrow(put_together(True), PIECE_SCHEMA)
    # what closes a unit comes before what opens one in the same split
    order = Window.partitionBy("file").orderBy("block", F.desc("kind"))
    numbered = parts.withColumn("number", F.sum((F.col("kind") == OPENS).cast("int")).over(order))
    joined = numbered.groupBy("file", "number").agg(
        F.bool_or("leads").alias("leads"),
        F.array_sort(F.collect_list(F.struct("block", (-F.col("kind")).alias("order"), "unit"))).alias("parts"))
    return whole.unionByName(joined.select("file", "leads", F.array_join(F.col("parts.unit"), delimiter).alias("unit")))


def _put_together(batches: Iterator[pa.RecordBatch], opened: dict, delimiter: str, fragments: bool) -> Iterator[pa.RecordBatch]:
    """Units of the splits of a task, or the fragments at their ends."""
    schema = pa.schema([("file", pa.string()), ("block", pa.int64()), ("kind", pa.int32()), ("leads", pa.bool_()), ("unit", pa.string())])
    split, waiting, inside, begun_here, leads, out = None, [], False, True, False, []

    def fragment(kind):
        if fragments and waiting:
            out.append((*split, kind, leads, delimiter.join(waiting)))

    for batch in batches:
        for file, block, value, odd in zip(*(c.to_pylist() for c in batch.columns)):
            if (file, block) != split:
                if inside:
                    fragment(OPENS if begun_here else INSIDE)
                split, waiting = (file, block), []
                inside = opened.get(split, False)
                begun_here, leads = not inside, block == 0
            waiting.append(value)
            inside ^= odd
            if not inside:
                if not begun_here:
                    fragment(CLOSES)
                elif not fragments:
                    out.append((file, block, WHOLE, leads, delimiter.join(waiting)))
                waiting, begun_here, leads = [], True, False
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), schema.types)], schema=schema)
            out = []
    if inside:
        fragment(OPENS if begun_here else INSIDE)
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), schema.types)], schema=schema)


def read_quoted_csv(spark: SparkSession, path: str, columns: list[str], sep: str = ",") -> DataFrame:
    """Text columns, found by header name, of CSV files whose quoted cells may hold line breaks.

    Quotes are doubled inside cells. Every file has a header, and all headers must be equal.
    Files are read in splits. Blank lines between rows are skipped, missing cells are null.
    """
    rows = units(spark, path)
    text = F.regexp_replace("unit", r"\r$", "")
    rows = rows.select("leads", F.when(F.col("leads"), F.regexp_replace(text, "^\ufeff", "")).otherwise(text).alias("unit"))
    options = {"sep": sep, "quote": '"', "escape": '"', "multiLine": "true", "maxCharsPerColumn": "-1"}
    headers = [r.unit for r in rows.where("leads").select("unit").distinct().limit(2).collect()]
    if not headers:
        return spark.createDataFrame([], T.StructType([T.StructField(c, T.StringType()) for c in columns]))
    if len(headers) > 1:
        raise ValueError(f"{path} has files with different headers: {headers}")
    names = spark.range(1).select(F.from_csv(F.lit(headers[0]), ", ".join(f"c{i} string" for i in range(headers[0].count(sep) + 1)), options)).first()[0]
    names = [n for n in names if n is not None]
    missing = [c for c in columns if c not in names]
    if missing:
        raise ValueError(f"{path} lacks columns {missing}; its header has {names}")
    schema = ", ".join(f"c{i} string" for i in range(len(names)))
    parsed = rows.where(~F.col("leads") & (F.col("unit") != "")).select(F.from_csv("unit", schema, options).alias("row"))
    return parsed.select(*[F.col(f"row.c{names.index(c)}").alias(c) for c in columns])
