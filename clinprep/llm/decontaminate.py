"""Benchmark decontamination with an Aho-Corasick automaton over test questions and answers.

Items are cut into windows of ten normalised words. All windows go into one automaton whose
alphabet is the words of the items, so a text is scanned once, word by word, and a match
gives word positions. Words are found at known offsets, so hit words map back to spans of
the original text.

The windows are counted first. Only a bounded number goes into one automaton; a larger
benchmark is cut into blocks by window hash, and the text passes one scan per block.
Scans are narrow: no shuffle, whatever the keys.

Cases: null and empty texts have no words; an item without words has no window; a window
that several items share marks them all; repeated rows are scanned one by one; an empty
table or benchmark gives no hits; only the named columns are read, so others may clash.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clinprep.llm.common import arrow_map, ascii_words, in_small_batches, stored

WINDOW = 10
MAX_WINDOWS = 200_000  # windows in one automaton: about 2 million nodes
WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")  # the words of ascii_words, in the original


def item_windows(items: DataFrame, item_id: str = "item_id", text: str = "text",
                 window: int = WINDOW, shortest: int = 1) -> DataFrame:
    """``item, words`` for each window; an item with fewer words is one window."""
    def work(ids, texts):
        out = {"item": [], "words": []}
        for name, body in zip(ids, texts):
            words = [w.decode() for w in ascii_words(body)]
            if len(words) >= shortest and words:
                for i in range(max(1, len(words) - window + 1)):
                    out["item"].append(name)
                    out["words"].append(" ".join(words[i:i + window]))
        return out

    named = items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("null")).alias("item"), F.col(text).alias("text"))
    return arrow_map(named, ["item", "text"], "item string, words string", work)


def build_automaton(windows: list[tuple[str, list[str]]]):
    """Automaton over word numbers, the numbers, and the items of each window."""
    import ahocorasick

    numbers: dict[bytes, int] = {}
    automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
    for words, names in windows:
        key = tuple(numbers.setdefault(w.encode(), len(numbers) + 1) for w in words.split(" "))
        automaton.add_word(key, (len(key), names))
    automaton.make_automaton()
    return automaton, numbers


def runs(marked: bytearray) -> list[tuple[int, int]]:
    """Start and end of each run of ones."""
    return [m.span() for m in re.finditer(b"\x01+", marked)]


def scan(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text: str = "text",
         item_id: str = "item_id", item_text: str = "text", window: int = WINDOW,
         shortest: int = 1, max_windows: int = MAX_WINDOWS, keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (the id by default) with ``n_words, n_hit, items`` and the hit spans.

    ``items`` has the sorted ids, as strings, of items with an occurring window; ``starts``
    and ``ends`` are code points of the original text, end exclusive, one pair for each run
    of hit words.
    """
    return _scanned(docs, items, text, item_id, item_text, window, shortest, max_windows, [id_col] if keep is None else keep
                    ).select("_row.*", "n_words", "n_hit", "items", "starts", "ends")


def clean_documents(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id",
                    item_text: str = "text", window: int = WINDOW, shortest: int = 1,
                    max_windows: int = MAX_WINDOWS) -> DataFrame:
    """The documents without any hit, all columns as they were."""
    found = _scanned(docs, items, text, item_id, item_text, window, shortest, max_windows, docs.columns)
    return found.where(F.col("n_hit") == 0).select("_row.*")


def _scanned(docs, items, text, item_id, item_text, window, shortest, max_windows, keep) -> DataFrame:
    shared = stored(
        item_windows(items, item_id, item_text, window, shortest)
        .groupBy("words").agg(F.sort_array(F.collect_set("item")).alias("names")), "windows")
    blocks = max(1, -(-shared.count() // max_windows))
    out = docs.select(
        F.struct(*keep).alias("_row"), F.col(text).alias("_text"), F.lit(0).cast("long").alias("n_words"),
        F.array().cast("array<long>").alias("hit_from"), F.array().cast("array<long>").alias("hit_to"),
        F.array().cast("array<string>").alias("items"))
    for block in range(blocks):
        out = _scan_block(out, shared.where(F.pmod(F.xxhash64("words"), F.lit(blocks)) == block), block == blocks - 1)
    return out.select(
        "_row", "n_words",
        F.aggregate(F.zip_with("hit_to", "hit_from", lambda b, a: b - a), F.lit(0).cast("long"), lambda s, x: s + x).alias("n_hit"),
        "items", "starts", "ends")


def _scan_block(out: DataFrame, windows: DataFrame, last_pass: bool) -> DataFrame:
    """One pass over the text; the hits of earlier passes are carried along and merged."""
    import pyarrow as pa

    automaton_of = out.sparkSession.sparkContext.broadcast([(r.words, r.names) for r in windows.collect()])
    carried = ["_row"] if last_pass else ["_row", "_text"]
    names = ["n_words", "hit_from", "hit_to", "items", "starts", "ends"]
    longs = pa.list_(pa.int64())

    def run(batches):
        automaton, numbers = build_automaton(automaton_of.value)
        number = numbers.get
        for batch in batches:
            got = {n: [] for n in names}
            texts, before, upto, known = (batch.column(i).to_pylist() for i in (1, 3, 4, 5))
            for body, old_from, old_to, old in zip(texts, before, upto, known):
                words = ascii_words(body)
                keys = tuple([number(w, 0) for w in words])
                found, marked = set(old), None
                if numbers and keys and len(words) and any(keys):
                    for last, (size, items) in automaton.iter(keys):
                        marked = marked or bytearray(len(words))
                        marked[last - size + 1:last + 1] = b"\x01" * size
                        found.update(items)
                if marked is None and not old_from:
                    spans, places = [], []
                else:
                    marked = marked or bytearray(len(words))
                    for a, b in zip(old_from, old_to):
                        marked[a:b] = b"\x01" * (b - a)
                    spans = runs(marked)
                    at = [m.span() for m in WORD.finditer(body)]
                    places = [(at[a][0], at[b - 1][1]) for a, b in spans]
                got["n_words"].append(len(words))
                got["hit_from"].append([a for a, _ in spans])
                got["hit_to"].append([b for _, b in spans])
                got["items"].append(sorted(found))
                got["starts"].append([a for a, _ in places])
                got["ends"].append([b for _, b in places])
            kinds = [pa.int64(), longs, longs, pa.list_(pa.string()), longs, longs]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(n) for n in carried], *[pa.array(got[n], k) for n, k in zip(names, kinds)]],
                names=carried + names)

    schema = T.StructType([out.schema[c] for c in carried])
    for name in names:
        one = T.StringType() if name == "items" else T.LongType()
        schema.add(name, one if name == "n_words" else T.ArrayType(one))
    return in_small_batches(out.select("_row", "_text", "n_words", "hit_from", "hit_to", "items")).mapInArrow(
        run, schema)
