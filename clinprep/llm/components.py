"""Connected components by alternating large and small stars. DataFrame functions only.

Both steps connect every node to the smallest node it can see (Kiveris et al., 2014). Each
is one aggregation and one join; a node with very many links is the many side of a join with
one row per node, which adaptive execution can split. Rounds are written to the shared
folder; the driver only learns a count and a checksum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clinprep.llm.common import stored


def _smallest(edges: DataFrame) -> DataFrame:
    """Edges ``a, b`` with ``low``: the smallest of ``a`` and the ``b`` of ``a``."""
    low = edges.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
    return edges.join(low, "a")


def large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return _smallest(both).where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("low").alias("b"))


def small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    seen = _smallest(down)
    return seen.select(F.explode(F.array(F.struct("a", F.col("low").alias("b")), F.struct(F.col("b").alias("a"), F.col("low").alias("b")))).alias("e")).select("e.*")


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` of every node with an edge ``a, b``; the root is the smallest node it is connected to."""
    now = stored(edges.where(F.col("a") != F.col("b")).select("a", "b").distinct(), "edges")
    state = None
    while True:
        now = stored(small_star(large_star(now)).where(F.col("a") != F.col("b")).distinct(), "edges")
        found = now.select(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(found) == state:
            break
        state = tuple(found)
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
