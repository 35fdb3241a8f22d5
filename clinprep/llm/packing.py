"""Token ids packed into fixed-length rows by best-fit decreasing.

Documents are tokenised and packed where they are read: a task gathers documents up to a
number of tokens, packs them and writes the rows out, so memory is bounded, nothing is
shuffled and no key can be hot. Some thousand documents at a time leave almost no padding.

A document longer than a row is cut into full rows and a rest; no token is lost, and every
segment records its document and the token it begins at. Rests and short documents are
packed longest first, each into the row with the least space that still holds it. A segment
tree over the possible space left (0 to ``capacity``) finds that space in logarithmic time.

A packed row has ``input_ids`` and ``position_ids`` as little-endian binary (``token_bytes``
wide; a row of the id and position matrices, padded), ``cu_seqlens`` (cumulative segment
lengths from 0), and one ``doc_ids`` and ``starts`` entry for each segment. Positions start
again at 0 with each segment.

Cases: null and empty texts give a segment of length 0, so each document is found in the
output; repeated rows are packed each; ties keep the order read; an empty table gives no
row; only the named columns are read, so others may clash.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from clinprep.llm.common import in_small_batches

CAPACITY = 4096
GROUP_TOKENS = 4 << 20  # tokens that a task packs together
ROWS_OUT = 256
SPACE = "▁"
STRETCH = re.compile(f"{SPACE}+[^{SPACE}]*")
REMEMBERED = 420_000


class PieceEncoder:
    """Ids of a sentencepiece BPE model, as bytes, word by word with a bounded memory.

    No piece has a space after another character, so words are encoded independently.
    """

    def __init__(self, model_file: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.kind = np.dtype("<u2" if self.model.get_piece_size() <= 1 << 16 else "<u4")
        self.code = "H" if self.kind.itemsize == 2 else "I"
        self.known: dict[str, bytes] = {}

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if text[0] == " " or "  " in text or SPACE in text:
            words = [s[1:] for s in STRETCH.findall(SPACE + text.replace(" ", SPACE))]
        else:
            words = text.split(" ")
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        new = list(set(words).difference(known))
        if new:
            for word, ids in zip(new, self.model.encode(new, num_threads=1)):
                # a space alone would be taken for an empty text
                ids = ids if word else [self.model.piece_to_id(SPACE)]
                known[word] = struct.pack(f"<{len(ids)}{self.code}", *ids)
        return b"".join(map(known.__getitem__, words))


class SpaceTree:
    """Segment tree over space left: which values occur among the open rows."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.open = [0] * (2 * self.size)

    def change(self, space: int, by: int) -> None:
        node = space + self.size
        while node:
            self.open[node] += by
            node >>= 1

    def least(self, needed: int) -> int | None:
        """Smallest occurring space of ``needed`` or more."""
        node = needed + self.size
        if self.open[node]:
            return needed
        while node > 1:
            if node % 2 == 0 and self.open[node + 1]:
                node += 1
                while node < self.size:
                    node = 2 * node if self.open[2 * node] else 2 * node + 1
                return node - self.size
            node >>= 1
        return None


def best_fit_decreasing(lengths: list[int], capacity: int) -> list[list[int]]:
    """Rows as lists of positions in ``lengths``, none of which exceeds ``capacity``."""
    tree, rows, with_space = SpaceTree(capacity), [], {}
    for item in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        space = tree.least(lengths[item])
        if space is None:
            space, row = capacity, len(rows)
            rows.append([])
        else:
            row = with_space[space].pop()
            tree.change(space, -1)
        rows[row].append(item)
        left = space - lengths[item]
        with_space.setdefault(left, []).append(row)
        tree.change(left, 1)
    return rows


def cut(length: int, capacity: int) -> list[tuple[int, int]]:
    """Start and end of the segments of a document."""
    return [(a, min(a + capacity, length)) for a in range(0, max(length, 1), capacity)]


def packed_rows(group: list[tuple[object, np.ndarray]], capacity: int, pad: int) -> Iterator[dict]:
    """Packed rows of some documents' ids."""
    segments = [(doc, ids, a, b) for doc, ids in group for a, b in cut(len(ids), capacity)]
    for row in best_fit_decreasing([b - a for _, _, a, b in segments], capacity):
        parts = [segments[i] for i in row]
        ends = np.cumsum([0] + [b - a for _, _, a, b in parts])
        kind = parts[0][1].dtype
        ids = np.full(capacity, pad, kind)
        positions = np.zeros(capacity, kind if capacity <= 1 << 16 else np.dtype("<u4"))
        for (_, whole, a, b), at in zip(parts, ends):
            ids[at:at + b - a] = whole[a:b]
            positions[at:at + b - a] = np.arange(b - a)
        yield {"n_tokens": int(ends[-1]), "cu_seqlens": ends.tolist(), "doc_ids": [p[0] for p in parts],
               "starts": [p[2] for p in parts], "input_ids": ids.tobytes(), "position_ids": positions.tobytes()}


def pack_documents(docs: DataFrame, model_file: str, id_col: str = "doc_id", text: str = "text",
                   capacity: int = CAPACITY, pad: int = 0, group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """``row_id, n_tokens, cu_seqlens, doc_ids, starts, input_ids, position_ids, token_bytes``.

    ``model_file`` must be readable on the executors; ``capacity`` is at most 65,536 tokens.
    """
    import pyarrow as pa

    if not 0 < capacity <= 1 << 16:
        raise ValueError("capacity must be from 1 to 65536")
    longs, ints = pa.list_(pa.int64()), pa.list_(pa.int32())

    def run(batches):
        encoder, number = PieceEncoder(model_file), TaskContext.get().partitionId() << 32
        group, tokens, id_kind = [], 0, None

        def rows():
            nonlocal number
            waiting = []
            for row in packed_rows(group, capacity, pad):
                waiting.append(row | {"row_id": number, "token_bytes": encoder.kind.itemsize})
                number += 1
                if len(waiting) == ROWS_OUT:
                    yield pa.RecordBatch.from_pylist(waiting, schema=out)
                    waiting = []
            if waiting:
                yield pa.RecordBatch.from_pylist(waiting, schema=out)

        for batch in batches:
            if id_kind is None:
                id_kind = batch.schema.field(0).type
                out = pa.schema([("row_id", pa.int64()), ("n_tokens", pa.int64()), ("cu_seqlens", ints), ("doc_ids", pa.list_(id_kind)),
                                 ("starts", longs), ("input_ids", pa.binary()), ("position_ids", pa.binary()), ("token_bytes", pa.int32())])
            for doc, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                group.append((doc, np.frombuffer(encoder.encode(body), encoder.kind)))
                tokens += len(group[-1][1])
                if tokens >= group_tokens:
                    yield from rows()
                    group, tokens = [], 0
        if group:
            yield from rows()

    return in_small_batches(docs.select(id_col, text)).mapInArrow(run, T.StructType([
        T.StructField("row_id", T.LongType()), T.StructField("n_tokens", T.LongType()),
        T.StructField("cu_seqlens", T.ArrayType(T.IntegerType())), T.StructField("doc_ids", T.ArrayType(docs.schema[id_col].dataType)),
        T.StructField("starts", T.ArrayType(T.LongType())), T.StructField("input_ids", T.BinaryType()),
        T.StructField("position_ids", T.BinaryType()), T.StructField("token_bytes", T.IntegerType())]))


def write_packed(packed: DataFrame, path: str) -> None:
    """Packed rows as Parquet: the binary columns are the rows of the id and position matrices."""
    packed.write.mode("error").parquet(path)


def matrix(rows: list, column: str = "input_ids") -> np.ndarray:
    """Collected or read rows as one matrix."""
    return np.stack([np.frombuffer(r[column], f"<u{r['token_bytes']}") for r in rows])
