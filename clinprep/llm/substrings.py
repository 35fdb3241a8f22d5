"""Exact substring deduplication with a count-min prefilter.

A window is ``window`` consecutive words of one document; each word covered by a window that
also starts anywhere else is removed.

1. *Batches.* Documents are packed, as words, into batches of bounded size, written to the
   shared folder as a table bucketed by batch number, so later steps meet a batch without
   moving it.
2. *Sketch.* A batch hashes its windows (rolling hashes in numpy) to the cells of a count-min
   row and sends its occupied cells, sorted and difference-coded, with a bit for those it
   counts twice or more; a cell is thus sent once by a batch, however hot. The row is cut
   into shards by leading bits. A shard adds up the sketches of all batches and answers each
   with one bit per cell: counted at least twice. Counts are never too low, so no repeated
   window is lost. The row has 64 cells or more for each window, so about one window in 64
   passes by chance. (As sketches travel sparse, a second row would cost more than the few
   bits that make the one row as selective.)
3. *Exact pass.* The windows that passed are grouped by a 128-bit digest of their words, in
   the same way: digests out, bits back.
4. A last pass over the batches applies the bits.

Shards and batches have bounded sizes; their numbers grow with the input. Nothing is
collected but the number of windows.

Cases: null, empty and short texts keep all their words; a repeated row repeats all of its
windows; an empty table gives none; only the named columns are read, so others may clash.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clinprep.llm.common import RollingHash, in_small_batches, scalar, stored
from clinprep.session import scratch_dir

WINDOW = 35
BATCH_BYTES = 16 << 20
STEP_BYTES = 1 << 20  # hashed at once
SHARD_WINDOWS = 1 << 21
CELLS_A_WINDOW = 6  # bits: 64 cells

Columns = tuple[np.ndarray, ...]  # the parts of a key, most significant first


def pack_words(docs: DataFrame, id_col: str, text: str, window: int, batch_bytes: int) -> DataFrame:
    """Batches ``batch, ids, sizes, words, windows``: documents as words joined by spaces."""
    import pyarrow as pa

    def run(batches):
        import zstandard

        number, pack = TaskContext.get().partitionId() << 32, zstandard.ZstdCompressor(level=3)
        ids, texts, total, id_kind = [], [], 0, None

        def packed():
            counts = [len(t.split(b" ")) if t else 0 for t in texts]
            return pa.RecordBatch.from_arrays([
                pa.array([number], pa.int64()), pa.array([ids], pa.list_(id_kind)), pa.array([counts], pa.list_(pa.int32())),
                pa.array([pack.compress(b"\n".join(texts))], pa.binary()),
                pa.array([sum(max(0, n - window + 1) for n in counts)], pa.int64())],
                names=["batch", "ids", "sizes", "words", "windows"])

        for batch in batches:
            id_kind = id_kind or batch.schema.field(0).type
            for doc, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids.append(doc)
                texts.append(b" ".join((body or "").encode().split()))
                total += len(texts[-1]) + 1
                if total >= batch_bytes:
                    yield packed()
                    ids, texts, total, number = [], [], 0, number + 1
        if ids:
            yield packed()

    return in_small_batches(docs.select(id_col, text)).mapInArrow(run, T.StructType([
        T.StructField("batch", T.LongType()), T.StructField("ids", T.ArrayType(docs.schema[id_col].dataType)),
        T.StructField("sizes", T.ArrayType(T.IntegerType())), T.StructField("words", T.BinaryType()),
        T.StructField("windows", T.LongType())]))


def bucketed(batches: DataFrame) -> DataFrame:
    """The batches as a table in the shared folder, bucketed by number."""
    spark = batches.sparkSession
    name = f"batches_{uuid.uuid4().hex}"
    (batches.write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), "batch").option("compression", "none")
     .option("path", scratch_dir(spark, name)).saveAsTable(name))
    return spark.table(name)


class Windows:
    """The windows of a batch: word positions and, per window, a 64-bit hash of its words."""

    def __init__(self, words: bytes, sizes: list[int], window: int):
        import zstandard

        self.texts = zstandard.ZstdDecompressor().decompress(words).split(b"\n")
        self.window = window
        roll, hashes, self.spans = RollingHash(), [], []  # spans: document, first words' starts and ends
        waiting, size = [], 0
        for doc, n in enumerate(sizes):
            if n >= window:
                waiting.append(doc)
                size += len(self.texts[doc]) + 1
                if size >= STEP_BYTES:
                    hashes.append(self._hash(roll, waiting))
                    waiting, size = [], 0
        if waiting:
            hashes.append(self._hash(roll, waiting))
        self.hashes = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)

    def _hash(self, roll: RollingHash, docs: list[int]) -> np.ndarray:
        data = b"\n".join(self.texts[d] for d in docs)
        at = np.frombuffer(data, np.uint8)
        gaps = np.flatnonzero((at == 32) | (at == 10))
        starts, ends = np.concatenate(([0], gaps + 1)), np.concatenate((gaps, [len(data)]))
        last = np.flatnonzero(np.concatenate((at[gaps] == 10, [True])))  # last word of each document
        first = np.concatenate(([0], last[:-1] + 1))
        inside = np.ones(len(starts), bool)
        for k in range(1, self.window):
            inside[last - k + 1] = False  # no window starts so late in a document
        begin = np.flatnonzero(inside)
        for doc, a, b in zip(docs, first, last):
            offset = starts[a]
            self.spans.append((doc, starts[a:b + 1] - offset, ends[a:b + 1] - offset))
        return roll.ranges(data, starts[begin], ends[begin + self.window - 1])

    def digests(self, chosen: np.ndarray) -> Columns:
        """128-bit digests of the chosen windows (a mask), as two columns."""
        out, upto = [], 0
        for doc, starts, ends in self.spans:
            n = len(starts) - self.window + 1
            text = self.texts[doc]
            for i in np.flatnonzero(chosen[upto:upto + n]).tolist():
                out.append(hashlib.blake2b(text[starts[i]:ends[i + self.window - 1]], digest_size=16).digest())
            upto += n
        both = np.frombuffer(b"".join(out), ">u8").astype(np.uint64).reshape(-1, 2)
        return both[:, 0], both[:, 1]

    def removed(self, repeated: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Documents with a repeated window and, per word, whether it is covered by one."""
        upto = 0
        for doc, starts, _ in self.spans:
            n = len(starts) - self.window + 1
            at = np.flatnonzero(repeated[upto:upto + n])
            upto += n
            if len(at):
                change = np.zeros(len(starts) + 1, np.int32)
                np.add.at(change, at, 1)
                np.add.at(change, at + self.window, -1)
                yield doc, np.cumsum(change[:-1]) > 0


def distinct(columns: Columns) -> tuple[Columns, np.ndarray, np.ndarray]:
    """Sorted distinct keys, whether each occurs repeatedly, and the place of each input among them."""
    order = np.lexsort(columns[::-1])
    ordered = [c[order] for c in columns]
    new = np.ones(len(order), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in ordered])
    place = np.empty(len(order), np.int64)
    place[order] = np.cumsum(new) - 1
    return tuple(c[new] for c in ordered), np.bincount(place, minlength=int(new.sum())) > 1, place


def encode(columns: Columns, repeats: np.ndarray) -> bytes:
    """Keys with ascending first column: differences by byte plane, other columns as they are."""
    import zstandard

    first = np.diff(columns[0], prepend=np.uint64(0))
    planes = first.astype(">u8").view(np.uint8).reshape(-1, 8).T.tobytes()
    return zstandard.compress(planes + b"".join(c.tobytes() for c in columns[1:]) + np.packbits(repeats).tobytes(), 1)


def decode(blob: bytes, n: int, width: int) -> tuple[Columns, np.ndarray]:
    import zstandard

    data = zstandard.decompress(blob)
    planes = np.frombuffer(data, np.uint8, 8 * n).reshape(8, n).T
    columns = [np.cumsum(np.ascontiguousarray(planes).view(">u8").reshape(n).astype(np.uint64))]
    columns += [np.frombuffer(data, np.uint64, n, 8 * n * k) for k in range(1, width)]
    return tuple(columns), np.unpackbits(np.frombuffer(data, np.uint8, -1, 8 * n * width), count=n).astype(bool)


def answers(parts: list[tuple[int, Columns, np.ndarray]]) -> Iterator[tuple[int, np.ndarray]]:
    """For each batch's keys in a shard: which are counted at least twice over all batches."""
    width = len(parts[0][1])
    _, _, place = distinct(tuple(np.concatenate([p[1][k] for p in parts]) for k in range(width)))
    counts = np.bincount(place, weights=1 + np.concatenate([p[2] for p in parts]))
    often, upto = counts[place] >= 2, 0
    for batch, columns, _ in parts:
        yield batch, often[upto:upto + len(columns[0])]
        upto += len(columns[0])


SENT = "shard long, batch long, n int, keys binary"


def sent_keys(batch: int, columns: Columns, bits: int):
    """One row for each shard that the batch has keys of; shards are leading bits of the first column."""
    import pyarrow as pa

    keys, repeats, _ = distinct(columns)
    shards = keys[0] >> np.uint64(64 - bits) if bits else np.zeros(len(keys[0]), np.uint64)
    cuts = np.flatnonzero(np.diff(shards, prepend=shards[:1] + np.uint64(1)))
    rows = []
    for a, b in zip(cuts, np.append(cuts[1:], len(shards))):
        rows.append((int(shards[a]), batch, int(b - a), encode(tuple(k[a:b] for k in keys), repeats[a:b])))
    return pa.RecordBatch.from_arrays(
        [pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.binary()))],
        names=["shard", "batch", "n", "keys"])


def counted_twice(sent: DataFrame, width: int) -> DataFrame:
    """``batch, bits``: for the sorted distinct keys of each batch, whether the merged count is 2 or more."""
    import pyarrow as pa

    def run(batches):
        shard, parts = None, []

        def answer():
            found = list(answers(parts))
            return pa.RecordBatch.from_arrays([
                pa.array([shard] * len(found), pa.int64()), pa.array([b for b, _ in found], pa.int64()),
                pa.array([len(m) for _, m in found], pa.int32()), pa.array([np.packbits(m).tobytes() for _, m in found], pa.binary())],
                names=["shard", "batch", "n", "bits"])

        for rows in batches:
            for at, batch, n, blob in zip(*(c.to_pylist() for c in rows.columns)):
                if at != shard and parts:
                    yield answer()
                    parts = []
                shard = at
                parts.append((batch, *decode(blob, n, width)))
        if parts:
            yield answer()

    replies = sent.repartition("shard").sortWithinPartitions("shard", "batch").mapInArrow(run, "shard long, batch long, n int, bits binary")
    return replies.groupBy("batch").agg(F.sort_array(F.collect_list(F.struct("shard", "n", "bits"))).alias("bits"))


def answered(columns: Columns, replies: list[dict] | None) -> np.ndarray:
    """The bits of a batch's replies for each of its keys, repeats included."""
    _, _, place = distinct(columns)
    if not len(place):
        return np.zeros(0, bool)
    bits = np.concatenate([np.unpackbits(np.frombuffer(r["bits"], np.uint8), count=r["n"]) for r in replies])
    return bits[place].astype(bool)


def shard_bits(keys: int, shard_keys: int) -> int:
    return max(0, (max(keys, 1) // shard_keys).bit_length())


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text: str = "text", window: int = WINDOW,
                     batch_bytes: int = BATCH_BYTES, shard_windows: int = SHARD_WINDOWS) -> DataFrame:
    """``id, n_words, n_removed, kept`` with the kept words joined by one space."""
    import pyarrow as pa

    packed = bucketed(pack_words(docs, id_col, text, window, batch_bytes))
    n = scalar(packed.select(F.coalesce(F.sum("windows"), F.lit(0))))
    bits = shard_bits(n, shard_windows)
    row_bits = np.uint64(64 - min(64, n.bit_length() + CELLS_A_WINDOW))

    def cells(windows: Windows) -> Columns:
        """Cells of the count-min row, left-aligned in 64 bits."""
        return ((windows.hashes >> row_bits) << row_bits,)

    def send_cells(batches):
        for rows in batches:
            for batch, sizes, words in zip(*(rows.column(c).to_pylist() for c in ("batch", "sizes", "words"))):
                yield sent_keys(batch, cells(Windows(words, sizes, window)), bits)

    likely = stored(counted_twice(packed.select("batch", "sizes", "words").mapInArrow(send_cells, SENT), 1), "likely")

    def send_digests(batches):
        for rows in batches:
            for batch, sizes, words, replies in zip(*(rows.column(c).to_pylist() for c in ("batch", "sizes", "words", "bits"))):
                windows = Windows(words, sizes, window)
                yield sent_keys(batch, windows.digests(answered(cells(windows), replies)), bits)

    asked = packed.select("batch", "sizes", "words").join(likely, "batch")
    certain = counted_twice(asked.mapInArrow(send_digests, SENT), 2).withColumnRenamed("bits", "exact")

    def keep(batches):
        for rows in batches:
            for ids, sizes, words, replies, exact in zip(*(rows.column(c).to_pylist() for c in ("ids", "sizes", "words", "bits", "exact"))):
                windows = Windows(words, sizes, window)
                chosen = answered(cells(windows), replies)
                repeated = np.zeros(len(chosen), bool)
                repeated[chosen] = answered(windows.digests(chosen), exact)
                kept, gone = list(windows.texts), [0] * len(ids)
                for doc, covered in windows.removed(repeated):
                    gone[doc] = int(covered.sum())
                    kept[doc] = b" ".join([w for w, out in zip(kept[doc].split(b" "), covered.tolist()) if not out])
                for a in range(0, len(ids), 2000):
                    b = a + 2000
                    yield pa.RecordBatch.from_arrays([
                        pa.array(ids[a:b], rows.schema.field("ids").type.value_type), pa.array(sizes[a:b], pa.int64()),
                        pa.array(gone[a:b], pa.int64()), pa.array([k.decode() for k in kept[a:b]], pa.string())],
                        names=[id_col, "n_words", "n_removed", "kept"])

    return packed.join(likely, "batch", "left").join(certain, "batch", "left").select(
        "ids", "sizes", "words", "bits", "exact").mapInArrow(keep, T.StructType([
            docs.schema[id_col], T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()),
            T.StructField("kept", T.StringType())]))
