"""Set similarity join of documents by chosen paths (after Christiani, Pagh and Sivertsen).

A document is its set of five-word shingles; two documents are linked if the Jaccard
similarity of their sets is ``threshold`` or more.

1. *Sets.* Each document gets a 128-bit key of its set and ``COORDINATES`` minwise values.
   Documents with equal sets become one node.
2. *Paths.* In each run all nodes start in one bucket. A bucket picks one or two coordinates
   (1/threshold on average) and splits its nodes by their values there, so a linked pair is
   expected to stay together once at each level. Buckets of one node end; small ones are
   compared; larger ones are split again. A bucket that hardly shrinks, or is at the last
   level, holds similar documents and is compared as it is.
3. *Comparison.* In small buckets sketches of one byte per coordinate rule most pairs out;
   what remains connected is a candidate group, named by its members, so the same group found
   by several runs is compared once. Groups that share nodes are put together up to ``BLOCK``
   nodes, so most sets are sent once. Groups above ``BLOCK`` nodes are cut into pairs of
   blocks, so no task holds an unbounded group. Then the sets themselves are compared.
4. *Classes.* Comparisons return, for each node, the number of its links and one node of its
   connected part, never pairs; a link in several groups counts in the first that both its
   nodes share. Connected components of these give the classes.

Runs are repeated until the chance that a pair at the threshold survives one of them reaches
``recall`` at the last level, averaged over the number of coordinates in which such a pair
agrees; pairs above it, and all that is less deep, do better.

Cases: null texts, and texts without words, are in no link and have themselves as class; a
text of one to four words is one shingle; equal sets are one class without being expanded
(``n_copies``); repeated rows are copies; an empty table gives none; a null id takes part,
and classes are named by the smallest id that is not null; only the named columns are read.
"""

from __future__ import annotations

import hashlib
from math import comb

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clinprep.llm.common import RollingHash, arrow_schema, ascii_words, in_batches, in_small_batches, mix64, scalar, sorted_groups, stored
from clinprep.llm.components import components

SHINGLE = 5
THRESHOLD = 0.8
RECALL = 0.999
COORDINATES = 64
LEAF = 128
BLOCK = 1024
DEPTH = 6
SHRINKS = 0.7  # a bucket of more than this share of its parent is dense
STEP_BYTES = 1 << 20
SMALL_TABLE = 500_000  # documents with copies up to which their ids are broadcast: about 25 MB

_MULTIPLIERS = mix64(np.arange(1, COORDINATES + 1, dtype=np.uint64)) | np.uint64(1)


def word_sets(texts: list[str | None], size: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    roll, out, waiting, total = RollingHash(), [], [], 0

    def flush():
        data = b"\n".join(b" ".join(w) for w in waiting)
        at = np.frombuffer(data, np.uint8)
        gaps = np.flatnonzero((at == 32) | (at == 10))
        starts, ends = np.concatenate(([0], gaps + 1)), np.concatenate((gaps, [len(data)]))
        last = np.cumsum([max(1, len(w)) for w in waiting])
        begin, end = [], []
        for words, b in zip(waiting, last.tolist()):
            a, n = b - max(1, len(words)), max(1, len(words) - size + 1)
            begin.append(np.arange(a, a + n))
            end.append(np.minimum(begin[-1] + size, b) - 1)
        lengths = [len(b) for b in begin]
        hashes = roll.ranges(data, starts[np.concatenate(begin)], ends[np.concatenate(end)])
        for words, part in zip(waiting, np.split(hashes, np.cumsum(lengths)[:-1])):
            out.append(np.unique(part) if words else np.zeros(0, np.uint64))
        waiting.clear()

    for text in texts:
        words = ascii_words(text)
        waiting.append(words)
        total += sum(map(len, words)) + len(words)
        if total >= STEP_BYTES:
            flush()
            total = 0
    if waiting:
        flush()
    return out


def minwise(sets: list[np.ndarray]) -> np.ndarray:
    """Minwise values of non-empty sets, one row each."""
    starts = np.concatenate(([0], np.cumsum([len(s) for s in sets])[:-1]))
    joined = np.concatenate(sets)
    out = np.empty((len(sets), COORDINATES), np.uint32)
    for i, multiplier in enumerate(_MULTIPLIERS):
        out[:, i] = np.minimum.reduceat(((joined * multiplier) >> np.uint64(32)).astype(np.uint32), starts)
    return out


def set_key(values: np.ndarray) -> bytes:
    return hashlib.blake2b(values.tobytes(), digest_size=16).digest()


def chance(similarity: float, threshold: float, depth: int) -> float:
    """Probability that a pair of some similarity shares a bucket after ``depth`` splits."""
    two, gone = 1 / threshold - 1, 0.0
    for _ in range(depth):
        stays = 1 - similarity + similarity * gone
        gone = (1 - two) * stays + two * stays * stays
    return 1 - gone


def recall_of(runs: int, similarity: float, threshold: float, depth: int) -> float:
    """Probability that such a pair meets in one of the runs, which all use the same coordinates."""
    n = COORDINATES
    return sum(comb(n, k) * similarity ** k * (1 - similarity) ** (n - k) * (1 - (1 - chance(k / n, threshold, depth)) ** runs)
               for k in range(n + 1))


def runs_for(recall: float, threshold: float) -> int:
    """The runs that reach a recall at the deepest level."""
    if not recall < 1:
        raise ValueError("no number of runs finds every pair: the recall must be below 1")
    runs = 1
    while recall_of(runs, threshold, threshold, DEPTH) < recall:
        runs += 1
    return runs


def children(buckets: np.ndarray, values: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and buckets after one split; a bucket's coordinates depend on nothing but the bucket."""
    h = mix64(buckets ^ np.uint64(0x5851F42D4C957F2D))
    two = (h >> np.uint64(40)).astype(np.float64) / (1 << 24) < 1 / threshold - 1
    rows = np.arange(len(buckets))
    first = (h % np.uint64(COORDINATES)).astype(np.int64)
    step = 1 + ((h >> np.uint64(16)) % np.uint64(COORDINATES - 1)).astype(np.int64)
    second = (first + step) % COORDINATES
    rows = np.concatenate((rows, rows[two]))
    picked = np.concatenate((first, second[two]))
    return rows, mix64(mix64(buckets[rows] + picked.astype(np.uint64)) ^ values[rows, picked])


def local_roots(linked: np.ndarray) -> np.ndarray:
    """For each row of a symmetric boolean matrix the smallest row it is connected to."""
    root = np.arange(len(linked))
    while True:
        low = np.where(linked, root[None, :], len(linked)).min(axis=1)
        new = np.minimum(root, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def similar(sets: list[np.ndarray], threshold: float) -> np.ndarray:
    """Boolean matrix of pairs with that Jaccard similarity, without the diagonal."""
    n, sizes = len(sets), np.array([len(s) for s in sets], np.float32)
    if n == 2:
        common = np.zeros((2, 2), np.float32)
        common[0, 1] = common[1, 0] = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
    else:
        joined = np.concatenate(sets)
        owner = np.repeat(np.arange(n), [len(s) for s in sets])
        order = np.argsort(joined, kind="stable")
        joined, owner = joined[order], owner[order]
        new = np.ones(len(joined), bool)
        new[1:] = joined[1:] != joined[:-1]
        column = np.cumsum(new) - 1
        shared = np.bincount(column)[column] > 1
        owner, column = owner[shared], np.unique(column[shared], return_inverse=True)[1]
        common = np.zeros((n, n), np.float32)
        width = max(1, (8 << 20) // n)
        upto = np.searchsorted(column, np.arange(0, (column[-1] if len(column) else 0) + width + 1, width))
        for k, (a, b) in enumerate(zip(upto[:-1], upto[1:])):
            part = np.zeros((n, min(width, int(column[-1]) + 1 - k * width) if b > a else 1), np.float32)
            part[owner[a:b], column[a:b] - k * width] = 1
            common += part @ part.T
    out = common >= threshold * (sizes[:, None] + sizes[None, :] - common) - 1e-4
    np.fill_diagonal(out, False)
    return out


def document_sets(docs: DataFrame, id_col: str, text: str, size: int) -> DataFrame:
    """``id, version, n_shingles, key, values``: key and minwise values are null without words.

    ``version`` is a hash of the text.
    """
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a in range(0, len(texts), 1000):
                sets = word_sets(texts[a:a + 1000], size)
                some = [s for s in sets if len(s)]
                rows = iter(minwise(some)) if some else iter(())
                yield pa.RecordBatch.from_arrays([
                    batch.column(0)[a:a + 1000], batch.column(2)[a:a + 1000], pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([set_key(s) if len(s) else None for s in sets], pa.binary()),
                    pa.array([next(rows).tobytes() if len(s) else None for s in sets], pa.binary())],
                    names=["id", "version", "n_shingles", "key", "values"])

    kind = docs.schema[id_col].dataType
    return in_small_batches(docs.select(id_col, text, F.xxhash64(text))).mapInArrow(run, T.StructType([
        T.StructField("id", kind), T.StructField("version", T.LongType()), T.StructField("n_shingles", T.LongType()),
        T.StructField("key", T.BinaryType()), T.StructField("values", T.BinaryType())]))


def split(rows: DataFrame, threshold: float) -> DataFrame:
    """One level down: ``bucket, parent, key`` from ``bucket, size, key, values``."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                buckets = batch.column(0).to_numpy().astype(np.uint64)
                values = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint32).reshape(len(buckets), -1)
                source, found = children(buckets, values, threshold)
                take = pa.array(source)
                yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int64)), batch.column(1).take(take), batch.column(2).take(take)],
                                                 names=["bucket", "parent", "key"])

    return rows.select("bucket", "size", "key", "values").mapInArrow(run, "bucket long, parent long, key binary")


def candidate_groups(nodes: DataFrame, threshold: float, runs: int) -> DataFrame:
    """``group, key``: groups of nodes to compare."""
    import pyarrow as pa

    roots = F.array(*[F.lit(int(r)) for r in mix64(np.arange(1, runs + 1, dtype=np.uint64)).astype(np.int64)])
    rows = nodes.select(F.explode(roots).alias("bucket"), F.lit(1 << 62).alias("size"), "key", "values")
    small, dense, alive = [], [], nodes.select("key", "values")
    for depth in range(1, DEPTH + 1):
        level = stored(split(rows, threshold), "paths")
        sizes = level.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
        sized = stored(level.join(sizes, "bucket"), "paths")
        is_small, is_dense = F.col("size") <= LEAF, (F.col("size") > F.col("parent") * SHRINKS) | F.lit(depth == DEPTH)
        small.append(sized.where(is_small))
        dense.append(sized.where(~is_small & is_dense))
        large = sized.where(~is_small & ~is_dense).select("bucket", "size", "key")
        if large.isEmpty():
            break
        # the values of nodes that are in no large bucket are not sent again
        alive = stored(alive.join(large.select("key").distinct(), "key", "left_semi"), "alive")
        rows = large.join(alive, "key")
    leaves, rest = small[0], dense[0]
    for more, other in zip(small[1:], dense[1:]):
        leaves, rest = leaves.unionByName(more), rest.unionByName(other)
    least = int(COORDINATES * (threshold - 4 * (threshold * (1 - threshold) / COORDINATES) ** 0.5))
    schema = "group long, key binary"

    def sift(batches):
        def found():
            for _, members in sorted_groups(batches, 1):
                keys = [m[0] for m in members]
                marks = np.frombuffer(b"".join(m[1] for m in members), np.uint8).reshape(len(keys), -1)
                linked = np.stack([(marks == one).sum(axis=1) for one in marks]) >= least
                np.fill_diagonal(linked, False)
                root = local_roots(linked)
                for r in np.flatnonzero(np.bincount(root) > 1).tolist():
                    group = sorted(keys[i] for i in np.flatnonzero(root == r).tolist())
                    name = int.from_bytes(hashlib.blake2b(b"".join(group), digest_size=8).digest(), "big", signed=True)
                    yield from ((name, key) for key in group)

        yield from in_batches(found(), arrow_schema(schema))

    def low_bytes(batches):
        for batch in batches:
            marks = [np.frombuffer(v, np.uint32).astype(np.uint8).tobytes() for v in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(marks, pa.binary())], names=["key", "marks"])

    marked = nodes.select("key", "values").mapInArrow(low_bytes, "key binary, marks binary")
    sifted = (leaves.select("bucket", "key").join(marked, "key").select("bucket", "key", "marks")
              .repartition("bucket").sortWithinPartitions("bucket", "key").mapInArrow(sift, schema))
    # a dense bucket that several runs find with the same members is one group
    digest = F.xxhash64(F.count("*"), F.bit_xor(F.xxhash64("key")), F.bit_xor(F.xxhash64(F.lit(1), "key")))
    named = rest.select("bucket", "key").join(rest.groupBy("bucket").agg(digest.alias("group")), "bucket").select("group", "key")
    return sifted.unionByName(named).distinct()


def together(groups: DataFrame) -> DataFrame:
    """``group, key``: groups that share nodes as one where that has at most ``BLOCK`` nodes, the others as they are."""
    groups = stored(groups, "groups")
    lowest = groups.groupBy("group").agg(F.min("key").alias("low"))
    roots = components(groups.join(lowest, "group").select(F.col("key").alias("a"), F.col("low").alias("b")))
    few = roots.groupBy("root").agg(F.count("*").alias("n")).where(F.col("n") <= BLOCK).select("root")
    named = roots.join(few, "root").select(F.col("node").alias("key"), F.xxhash64("root").alias("whole"))
    return groups.join(named, "key", "left").select(F.coalesce("whole", "group").alias("group"), "key").distinct()


def compare(groups: DataFrame, docs: DataFrame, nodes: DataFrame, id_col: str, text: str, size: int, threshold: float) -> DataFrame:
    """``key, root, n_links`` for each group (or pair of blocks) in which a node has links."""
    import pyarrow as pa

    groups = stored(together(groups), "groups")
    sizes = groups.groupBy("group").agg(F.count("*").alias("n"))
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("key"), blocks).cast("int")
    # with the sizes, so that the sets are in no further join
    of_node = groups.join(sizes, "group").groupBy("key").agg(F.sort_array(F.collect_list(F.struct("group", "n"))).alias("in"))
    wanted = of_node.join(nodes.select("key", "id"), "key").select(
        "key", F.col("in.group").alias("groups"), F.col("in.n").alias("sizes"), F.col("id").alias("node_id"))

    def sets_of(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 1000):
                part = batch.slice(a, 1000)
                sets = word_sets(part.column(3).to_pylist(), size)
                # another document of the same id may have another set
                ok = [i for i, (s, key) in enumerate(zip(sets, part.column(0).to_pylist())) if len(s) and set_key(s) == key]
                yield pa.RecordBatch.from_arrays(
                    [part.column(c).take(pa.array(ok, pa.int64())) for c in range(3)] + [pa.array([sets[i].tobytes() for i in ok], pa.binary())],
                    names=["key", "groups", "sizes", "members"])

    texts = docs.select(F.col(id_col).alias("node_id"), F.col(text).alias("text"))
    filled = (texts.join(wanted, texts.node_id.eqNullSafe(wanted.node_id)).select("key", "groups", "sizes", "text")
              .mapInArrow(sets_of, "key binary, groups array<long>, sizes array<long>, members binary"))
    dealt = (
        filled.select("key", "groups", "members", F.explode(F.arrays_zip("groups", "sizes")).alias("in"))
        .select("key", "groups", "members", F.col("in.groups").alias("group"), F.col("in.sizes").alias("n"))
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        .select("group", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "key", "groups", "members"))
    schema = "key binary, root binary, n_links long"

    def links(batches):
        def found():
            for (group, i, j), rows in sorted_groups(batches, 3):
                rows = list({r[1]: r for r in rows}.values())  # a repeated row brings its set twice
                sets = [np.frombuffer(r[3], np.uint64) for r in rows]
                if len(sets) < 2:
                    continue
                linked = similar(sets, threshold)
                if i != j:
                    own = np.array([r[0] for r in rows])
                    linked &= own[:, None] != own[None, :]
                earlier = sorted({g for r in rows for g in r[2] if g < group})
                first = linked
                if earlier:
                    at = {g: k for k, g in enumerate(earlier)}
                    inside = np.zeros((len(rows), len(earlier)), np.float32)
                    for k, r in enumerate(rows):
                        inside[k, [at[g] for g in r[2] if g < group]] = 1
                    first = linked & (inside @ inside.T == 0)
                roots, counts = local_roots(linked), first.sum(axis=1)
                for k in np.flatnonzero(linked.any(axis=1)).tolist():
                    yield rows[k][1], rows[roots[k]][1], int(counts[k])

        yield from in_batches(found(), arrow_schema(schema))

    order = ["group", "i", "j"]
    return dealt.repartition(*order).sortWithinPartitions(*order, "key").mapInArrow(links, schema)


def _joined(docs: DataFrame, id_col: str, text: str, size: int, threshold: float, recall: float) -> tuple:
    """All documents with their sets' keys, the nodes, the links found, and the root of each linked node."""
    runs = runs_for(recall, threshold)
    every = stored(document_sets(docs, id_col, text, size), "sets")
    nodes = stored(every.where("key is not null").groupBy("key").agg(
        F.min("id").alias("id"), F.count("*").alias("n_copies"), F.first("values").alias("values")), "nodes")
    found = stored(compare(candidate_groups(nodes, threshold, runs), docs, nodes, id_col, text, size, threshold), "links")
    return every, nodes, found, components(found.select(F.col("key").alias("a"), F.col("root").alias("b")))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", size: int = SHINGLE,
                    threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """``id, n_shingles, class_id, n_links, n_copies`` for every row.

    ``class_id`` is the smallest id of the class; ``n_links`` counts linked sets other than
    the own one, ``n_copies`` the documents with the own set.
    """
    every, nodes, found, roots = _joined(docs, id_col, text, size, threshold, recall)
    counts = found.groupBy("key").agg(F.sum("n_links").alias("n_links"))
    placed = nodes.select("key", "id", "n_copies").join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn(
        "root", F.coalesce("root", "key"))
    names = placed.groupBy("root").agg(F.min("id").alias("class_id"))
    classes = (placed.join(names, "root").join(counts, "key", "left")
               .select("key", "class_id", "n_copies", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")))
    return every.join(classes, "key", "left").select(
        F.col("id").alias(id_col), "n_shingles", F.when(F.col("key").isNull(), F.col("id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("n_copies", F.lit(1)).cast("long").alias("n_copies"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text: str = "text", size: int = SHINGLE,
                threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """The documents that remain if one of each class stays (that of the smallest id), all columns as they were.

    Documents without words all stay. A row repeated as a whole counts as a copy.
    """
    every, _, _, roots = _joined(docs, id_col, text, size, threshold, recall)
    placed = every.where("key is not null").join(roots.withColumnRenamed("node", "key"), "key", "left").select(
        F.coalesce("root", "key").alias("root"), F.struct(F.col("id").isNull().alias("absent"), "id", "version").alias("at"))
    stays = placed.groupBy("root").agg(F.min("at").alias("stays"), F.count("*").alias("n"))
    marked = stored(placed.join(stays, "root").where("n > 1").select(
        F.col("at.id").alias("__id"), F.col("at.version").alias("__version"), (F.col("at") == F.col("stays")).alias("__stays"))
        .groupBy("__id", "__version").agg(F.max("__stays").alias("__stays"), F.count("*").alias("__n")), "copies")
    if scalar(marked.select(F.count("*"))) <= SMALL_TABLE:
        marked = F.broadcast(marked)
    rows = docs.select(F.struct(*docs.columns).alias("__row"), F.col(id_col).alias("__own"), F.xxhash64(text).alias("__text"))
    found = rows.join(marked, rows["__own"].eqNullSafe(marked["__id"]) & (rows["__text"] == marked["__version"]), "left")
    found = found.where(F.coalesce("__stays", F.lit(True)))
    once = found.where(F.coalesce("__n", F.lit(1)) == 1).select("__row")
    # the same row given several times: any one of them
    again = found.where("__n > 1").groupBy("__id", "__version").agg(F.first("__row").alias("__row")).select("__row")
    return once.unionByName(again).select("__row.*")
