"""Hard negatives: rows of another label that score just below an anchor's positives.

Scores are exact integer inner products, taken in a residue number system. Component matrices
are reduced modulo several primes below 1024, with residues around zero, so that a float32
matrix product over ``SLICE`` components stays below 2**24 and is exact; the Chinese remainder
theorem (mixed radix, digit by digit) then gives the signed score. There are as many primes as
the largest components of the two blocks call for.

All rows are packed into blocks where they are read, the anchors (a stated query set) into
blocks of their own. Each block of rows has a place, each block of anchors is sent to every place, and
the two meet there by an ordinary join; only the best of a pair of blocks leave the task. A
first round finds each anchor's positives, a second one the rows in the score window under
each positive. A task holds one block of either kind and the scores of ``STRIP`` rows.

Cases: rows with a null id, label or vector, or with a null or non-finite entry, take no part;
"other rows" are those of another id; ties go to the smaller id; repeated rows each count, and
a repeated anchor gets its rows each time; vectors of unlike length are compared as if the
shorter were filled up with zeros; a negative positive score has no window; empty tables and anchors without
positives or negatives give no rows; only the named columns are read, so others may clash.
Scores of 2**56 and more are an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clinprep.llm.common import arrow_schema, stored
from clinprep.llm.vectors import packed, unpacked, usable

SLICE = 64
STRIP = 4096
ANCHOR_ROWS = 512
MAX_SCORE = 1 << 56


@cache
def primes() -> list[int]:
    """Primes below 1024, largest first: 64 products of two residues around zero stay below 2**24."""
    return [p for p in range(1023, 2, -1) if all(p % q for q in range(2, int(p ** 0.5) + 1))]


def moduli(bound: int) -> list[int]:
    """Enough primes to tell all integers from ``-bound`` to ``bound`` apart."""
    product, chosen = 1, []
    for p in primes():
        if product > 2 * bound:
            break
        chosen.append(p)
        product *= p
    return chosen


def centred(values: np.ndarray, p: int) -> np.ndarray:
    """Residues from ``-(p - 1) / 2`` to ``(p - 1) / 2``."""
    rest = values % p
    return np.where(rest > p // 2, rest - p, rest)


def exact_product(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """``left @ right.T`` of integer matrices, exactly, from float32 products modulo primes."""
    width = min(left.shape[1], right.shape[1])
    left, right = left[:, :width].astype(np.int64), right[:, :width].astype(np.int64)
    if not left.size or not right.size:
        return np.zeros((len(left), len(right)), np.int64)
    bound = width * int(np.abs(left).max()) * int(np.abs(right).max())
    if bound >= MAX_SCORE:
        raise ValueError("scores of 2**56 or more")
    total, base = np.zeros((len(left), len(right)), np.int64), 1
    for p in moduli(bound):
        a, b = centred(left, p).astype(np.float32), centred(right, p).astype(np.float32)
        rest = np.zeros(total.shape, np.int64)
        for at in range(0, width, SLICE):
            rest += (a[:, at:at + SLICE] @ b[:, at:at + SLICE].T).astype(np.int64)
        total += centred((rest - total) * pow(base, -1, p), p) * base
        base *= p
    return total


def best(scores: np.ndarray, ids: np.ndarray, count: int) -> np.ndarray:
    """Positions of the first ``count`` by falling score, then rising id."""
    near = np.arange(len(scores))
    if len(scores) > 4 * count:
        near = np.flatnonzero(scores >= np.partition(scores, len(scores) - count)[len(scores) - count])
    return near[np.lexsort((ids[near], -scores[near]))[:count]]


def strips(block: dict, anchors: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Ids, labels and scores against the anchors, some rows at a time."""
    ids, labels, cells = unpacked(block)
    for at in range(0, len(ids), STRIP):
        yield ids[at:at + STRIP], labels[at:at + STRIP], exact_product(anchors, cells[at:at + STRIP])


def positives_in(anchors: dict, block: dict, count: int) -> Iterator[tuple]:
    """``index, ids, scores``: the first rows of each anchor's label in the block."""
    own, kinds, cells = unpacked(anchors)
    found = [(np.zeros(0, np.int64),) * 2 for _ in own]
    for ids, labels, scores in strips(block, cells):
        members = {kind: np.flatnonzero(labels == kind) for kind in set(kinds.tolist())}
        for i, (me, kind) in enumerate(zip(own.tolist(), kinds.tolist())):
            at = members[kind]
            at = at[ids[at] != me]
            if len(at):
                both = np.concatenate([found[i][0], ids[at]]), np.concatenate([found[i][1], scores[i, at]])
                first = best(both[1], both[0], count)
                found[i] = both[0][first], both[1][first]
    for i, (ids, scores) in enumerate(found):
        if len(ids):
            yield i, ids.tolist(), scores.tolist()


def negatives_in(anchors: dict, block: dict, count: int, low: int, high: int) -> Iterator[tuple]:
    """``index, place, ids, scores``: the first rows under each positive in the block.

    ``positives`` of the anchor block lists ``index, place, score``.
    """
    own, kinds, cells = unpacked(anchors)
    wanted: dict[int, list[tuple[int, int]]] = {}
    for p in anchors["positives"]:
        if p["score"] >= 0:
            wanted.setdefault(p["index"], []).append((p["place"], p["score"]))
    found = {(i, place): (np.zeros(0, np.int64),) * 2 for i, places in wanted.items() for place, _ in places}
    for ids, labels, scores in strips(block, cells):
        others = {kind: labels != kind for kind in set(kinds.tolist())}
        for i, places in wanted.items():
            line = scores[i]
            least, most = min(s for _, s in places), max(s for _, s in places)
            at = np.flatnonzero(others[int(kinds[i])] & (line * 100 >= low * least) & (line * 100 <= high * most))
            at = at[np.lexsort((ids[at], -line[at]))]
            sorted_ids, sorted_scores = ids[at], line[at]
            for place, score in places:
                start = np.searchsorted(-100 * sorted_scores, -high * score)
                end = np.searchsorted(-100 * sorted_scores, -low * score, "right")
                if start < end:
                    take = slice(start, min(end, start + count))
                    before = found[i, place]
                    both = np.concatenate([before[0], sorted_ids[take]]), np.concatenate([before[1], sorted_scores[take]])
                    first = best(both[1], both[0], count)
                    found[i, place] = both[0][first], both[1][first]
    for (i, place), (ids, scores) in found.items():
        if len(ids):
            yield i, place, ids.tolist(), scores.tolist()


def meeting(blocks: DataFrame, anchors: DataFrame, places: int, extra: list[str]) -> DataFrame:
    """Every block of rows beside every block of anchors."""
    rows = blocks.select(F.pmod(F.xxhash64("block"), F.lit(places)).alias("_place"), F.struct("block", "n", "width", "ids", "labels", "kind", "cells").alias("rows"))
    sent = anchors.select(F.struct("block", "n", "width", "ids", "labels", "kind", "cells", *extra).alias("anchors"),
                          F.explode(F.sequence(F.lit(0).cast("long"), F.lit(places - 1).cast("long"))).alias("_place"))
    return rows.join(sent, "_place").select("rows", "anchors")


def by_pair(pairs: DataFrame, schema: str, work) -> DataFrame:
    """``work(anchors, rows)`` for each pair of blocks, its tuples as rows after the anchor block's number."""
    def run(batches):
        out = arrow_schema(schema)
        for batch in batches:
            for i in range(batch.num_rows):
                anchors, rows = batch.column(1)[i].as_py(), batch.column(0)[i].as_py()
                found = [(anchors["block"], *row) for row in work(anchors, rows)]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), out.types)], schema=out)

    return pairs.mapInArrow(run, schema)


def merged(partial: DataFrame, keys: list[str], count: int) -> DataFrame:
    """``keys`` with ``best``: the first of all blocks, as structs of negated score and id."""
    pairs = F.transform(F.arrays_zip("ids", "scores"), lambda x: F.struct((-x["scores"]).alias("negated"), x["ids"].alias("id")))
    lists = partial.groupBy(*keys).agg(F.flatten(F.collect_list(pairs)).alias("_all"))
    return lists.select(*keys, F.slice(F.array_sort("_all"), 1, count).alias("best"))


def mine(vectors: DataFrame, anchor: Column, id_col: str = "vec_id", vector: str = "embedding", label: Column | None = None,
         scale: int = 256, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``anchor`` marks the query rows and ``label`` is a whole number. Negatives score from ``low``
    to ``high`` per cent of the positive.
    """
    label = F.col("label") if label is None else label
    rows = vectors.where(F.col(id_col).isNotNull() & label.isNotNull() & usable(vector))
    blocks = stored(packed(rows, F.col(id_col), label, vector, scale), "vector-blocks")
    asked = rows.where(anchor)
    parts = max(1, -(-asked.count() // ANCHOR_ROWS))
    anchors = stored(packed(asked.repartition(parts), F.col(id_col), label, vector, scale, block_rows=ANCHOR_ROWS), "anchor-blocks")
    places = max(1, blocks.count())

    found = by_pair(meeting(blocks, anchors, places, []), "block long, index int, ids array<long>, scores array<long>",
                    lambda a, r: positives_in(a, r, positives))
    chosen = merged(found, ["block", "index"], positives)
    chosen = stored(chosen.select("block", "index", F.posexplode("best").alias("place", "hit")).select(
        "block", "index", "place", F.col("hit.id").alias("positive_id"), (-F.col("hit.negated")).alias("positive_score")), "positives")

    # at most ANCHOR_ROWS anchors and their few positives in a block
    listed = chosen.groupBy("block").agg(F.collect_list(F.struct("index", "place", F.col("positive_score").alias("score"))).alias("positives"))
    second = by_pair(meeting(blocks, anchors.join(listed, "block"), places, ["positives"]),
                     "block long, index int, place int, ids array<long>, scores array<long>",
                     lambda a, r: negatives_in(a, r, negatives, low, high))
    hard = merged(second, ["block", "index", "place"], negatives).join(chosen, ["block", "index", "place"])
    names = anchors.select("block", "ids").mapInArrow(_anchor_ids, "block long, index int, anchor_id long")
    return hard.join(names, ["block", "index"]).select(
        "anchor_id", "positive_id", F.posexplode("best").alias("_at", "_hit"), "positive_score").select(
        "anchor_id", "positive_id", (F.col("_at") + 1).alias("rank"), F.col("_hit.id").alias("negative_id"), "positive_score",
        (-F.col("_hit.negated")).alias("negative_score"))


def _anchor_ids(batches):
    for batch in batches:
        for block, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            own = np.frombuffer(ids, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), block)), pa.array(np.arange(len(own), dtype=np.int32)), pa.array(own)],
                                             names=["block", "index", "anchor_id"])
