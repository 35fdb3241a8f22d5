"""Toxicity from a weighted lexicon, matched with one Aho-Corasick automaton.

Texts are folded before matching: lower case, characters that look like plain Latin letters
(Cyrillic, Greek, full width) replaced by them, and digits and signs that stand for letters
read as letters; ``i``, ``l``, ``1``, ``!`` and ``|`` become one. Accents are letters of their
languages and stay. Folding keeps the number of characters. An entry of the lexicon is a word
or a beginning of words; the longest entry that a word starts with counts, if the original
has a letter there. A word inside an exception phrase does not count.

Learning, outside the held-out fifth (CRC-32 of the id as text, modulo 5): at most
``PER_CLASS`` labelled ids of each class, by hash (a documented bound), and the texts under
them. The evidence of an entry is the number of documents of either class that have it, at
most one for each context (the words around its first place), so that copies of one text
count once. It enters the lexicon if its share among toxic documents is too high for chance, over
all entries tried; the weight is the logarithm of the ratio of shares. Pairs of words with a
lexicon word that are as frequent in clean documents as in toxic ones become exception phrases.

A document's density is the sum of its weights by its number of words. The score is a rising
map from density to the share of toxic documents (pooled adjacent violators on the sample,
weighed back to the class sizes).

Cases: null texts and texts without words have density 0; a null toxic label is no label, and
of several labels of an id the highest holds; null ids have no label; without labels of both
classes no word is learned and every score is the share of toxic labels, or 0; repeated rows
give repeated rows; an empty table gives none; only the named columns are read, so others may
clash.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clinprep.llm.common import in_small_batches, stored
from clinprep.llm.language import held_out

PER_CLASS = 4000
STEMS = range(3, 8)  # letters of the beginnings that are tried
MAX_WORDS = 5000
ONE_ENTRY = 0.8
LEAST_WEIGHT = 1.5  # four to five times as frequent in toxic documents
MAX_EXCEPTIONS = 5000
CHANCE = 0.01  # that any word at all enters the lexicon by chance
STEPS = 16  # steps of the map from density to score

# Characters that look like, or stand for, Latin letters.
LOOKALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "х": "x", "у": "y", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "һ": "h", "к": "k",
    "м": "m", "т": "t", "в": "b", "н": "h", "α": "a", "ο": "o", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ρ": "p", "τ": "t", "υ": "u",
    "χ": "x", "η": "n", "ı": "i", "ɑ": "a", "ɡ": "g", "ø": "o", "ł": "l", "đ": "d",
}
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "i"}

SIGNS = "".join(c for c in SUBSTITUTES if not c.isalnum())
WORD = re.compile(r"[^\W\d_]+")


def folding() -> dict[int, str]:
    """The whole folding as a table of single characters."""
    plain = {c: chr(c).lower() for c in range(0x250) if len(chr(c).lower()) == 1}
    wide = {c: chr(c - 0xFEE0).lower() for c in range(0xFF01, 0xFF5F)}
    alike = {ord(c): letter for seen, letter in LOOKALIKES.items() for c in (seen, seen.upper()) if len(c) == 1}
    read = {code: SUBSTITUTES.get(letter, letter) for code, letter in (plain | wide | alike).items()}
    return {code: "i" if letter == "l" else letter for code, letter in read.items() if letter != chr(code) or letter == "l"}


FOLDING = folding()


def fold(text: str) -> str:
    """Folded text, of as many characters."""
    return text.translate(FOLDING)


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def words_of(text: str) -> list[str]:
    """Folded words of which the original has a letter; signs at either end of one are punctuation."""
    folded, out = fold(text), []
    for m in WORD.finditer(folded):
        seen = text[m.start():m.end()]
        if not seen.isalpha():
            if not has_letter(seen):
                continue
            left = len(seen) - len(seen.lstrip(SIGNS))
            out.append(m.group()[left:len(seen.rstrip(SIGNS))])
        else:
            out.append(m.group())
    return out


def entries_of(word: str) -> list[str]:
    """What a word may enter the lexicon as: itself, marked by a blank, or its beginnings."""
    return [word + " ", *(word[:k] for k in STEMS if k <= len(word))]


@dataclass
class Lexicon:
    """Weights of folded words, folded exception phrases, and the map from density to score."""
    weights: dict[str, float] = field(default_factory=dict)  # whole words end with a blank
    exceptions: list[str] = field(default_factory=list)
    densities: list[float] = field(default_factory=lambda: [0.0])
    shares: list[float] = field(default_factory=lambda: [0.0])

    def automaton(self):
        """Words, beginnings and exception phrases in one automaton: text to ``(letters, whole, beginning)`` weights."""
        import ahocorasick

        entries: dict[str, list] = {}
        for entry, weight in self.weights.items():
            entries.setdefault(entry.strip(), [None, None, False])[0 if entry.endswith(" ") else 1] = weight
        for phrase in self.exceptions:
            entries.setdefault(phrase, [None, None, False])[2] = True
        matcher = ahocorasick.Automaton()
        for text, (whole, begins, excuse) in entries.items():
            matcher.add_word(text, (len(text), whole, begins, excuse))
        if len(matcher):
            matcher.make_automaton()
        return matcher

    def score(self, density: float) -> float:
        return float(np.interp(density, self.densities, self.shares))


def matches(text: str, matcher) -> list[tuple[int, int, float]]:
    """``start, end, weight`` of lexicon entries in a text, those in exception phrases left out."""
    if not len(matcher):
        return []
    folded = fold(text)
    found, excused = {}, []
    for last, (size, whole, begins, excuse) in matcher.iter(folded):
        start, end = last - size + 1, last + 1
        if start and text[start - 1].isalnum():
            continue
        ended = not text[end:end + 1].isalnum()
        if excuse and ended:
            excused.append((start, end))
        weight = whole if ended and whole is not None else begins
        if weight is not None and has_letter(text[start:end]):
            found[start] = start, end, weight  # ends come in rising order, so the longest stays
    out = list(found.values())
    if not excused:
        return out
    # phrases come by rising end and are short, so only few can hold a word
    reach = max(e - s for s, e in excused)
    ends = [e for _, e in excused]
    return [m for m in out if not any(
        s <= m[0] and m[1] <= e for s, e in excused[bisect_left(ends, m[1]):bisect_right(ends, m[1] + reach)])]


def density(text: str | None, matcher) -> float:
    if not text:
        return 0.0
    weight = sum(m[2] for m in matches(text, matcher))
    return weight / max(1, len(text.split())) if weight else 0.0


# --- learning -----------------------------------------------------------------

def sample_of_labels(docs: DataFrame, labels: DataFrame, id_col: str, text: str, toxic: str, per_class: int):
    """``toxic, text`` of the documents under at most ``per_class`` ids of each class, and the sizes of the classes."""
    known = labels.where(F.col(toxic).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
    by_id = known.groupBy(F.col(id_col).alias("_id")).agg((F.max(toxic) > 0).alias("toxic"))
    sizes = {r.toxic: r.n for r in by_id.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    draw = F.xxhash64(F.lit("toxic"), F.col("_id").cast("string"))
    chosen = by_id.where(F.col("toxic")).orderBy(draw, "_id").limit(per_class).unionByName(
        by_id.where(~F.col("toxic")).orderBy(draw, "_id").limit(per_class))
    sample = docs.where(F.col(text).isNotNull() & ~held_out(id_col)).join(
        F.broadcast(chosen), F.col(id_col) == F.col("_id")).select("toxic", F.col(text).alias("text"))
    return sample, sizes


def _first_places(batches):
    """``entry, context, toxic`` of each different entry of a document, at its first place."""
    for batch in batches:
        entries, contexts, kinds = [], [], []
        for kind, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            row = words_of(body)
            words, first = set(), {}
            for i, word in enumerate(row):
                if word not in words:
                    words.add(word)
                    context = " ".join(row[max(0, i - 1):i + 2])
                    for entry in entries_of(word):
                        first.setdefault(entry, context)
            entries += first.keys()
            contexts += first.values()
            kinds += [kind] * len(first)
        yield pa.RecordBatch.from_arrays([pa.array(entries, pa.string()), pa.array(contexts, pa.string()), pa.array(kinds, pa.bool_())],
                                         names=["entry", "context", "toxic"])


def _evidence(t, c, of_t: int, of_c: int):
    """Half the likelihood ratio of ``t`` toxic and ``c`` clean documents against equal shares."""
    n = t + c
    def part(k, share):
        return F.when(k > 0, k * F.log(k / (n * share))).otherwise(0.0)
    return part(t, of_t / (of_t + of_c)) + part(c, of_c / (of_t + of_c))


def learn_words(sample: DataFrame, n_toxic: int, n_clean: int, chance: float = CHANCE) -> dict[str, float]:
    places = in_small_batches(sample).mapInArrow(_first_places, "entry string, context string, toxic boolean")
    # one for each entry and context, so that copies count once
    once = places.groupBy("entry", F.xxhash64("context").alias("context")).agg(F.bool_or("toxic").alias("_t"), F.bool_or(~F.col("toxic")).alias("_c"))
    counts = stored(once.groupBy("entry").agg(F.count_if("_t").alias("t"), F.count_if("_c").alias("c")), "toxic-words")
    tried = counts.count()
    if not tried:
        return {}
    ratio = F.log((F.col("t") + 0.5) / (n_toxic + 1)) - F.log((F.col("c") + 0.5) / (n_clean + 1))
    evidence = _evidence(F.col("t"), F.col("c"), n_toxic, n_clean)
    rows = counts.where(evidence > math.log(tried / chance)).select("entry", "t", ratio.alias("weight"), evidence.alias("evidence")).where(
        F.col("weight") > LEAST_WEIGHT).orderBy(F.desc("evidence"), "entry").limit(MAX_WORDS).collect()
    # a beginning that one longer entry accounts for is left to that entry
    most: dict[str, int] = {}
    for r in rows:
        for k in STEMS:
            if k < len(r.entry):
                most[r.entry[:k]] = max(most.get(r.entry[:k], 0), r.t)
    return {r.entry: r.weight for r in rows if most.get(r.entry, 0) < ONE_ENTRY * r.t}


def learn_exceptions(sample: DataFrame, weights: dict[str, float], n_toxic: int, n_clean: int) -> list[str]:
    """Pairs of neighbouring words around lexicon words that are no sign of toxicity."""
    if not weights:
        return []

    def listed(word):
        return any(entry in weights for entry in entries_of(word))

    def pairs(batches):
        for batch in batches:
            found = [(a + " " + b, kind) for kind, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
                     for row in [words_of(body)] for a, b in set(zip(row, row[1:])) if listed(a) or listed(b)]
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.bool_())],
                                             names=["phrase", "toxic"])

    counts = in_small_batches(sample).mapInArrow(pairs, "phrase string, toxic boolean").groupBy("phrase").agg(
        F.count_if("toxic").alias("t"), F.count_if(~F.col("toxic")).alias("c"))
    rows = counts.where((F.col("c") >= 3) & (F.col("c") * n_toxic >= F.col("t") * n_clean)).orderBy(
        F.desc("c"), "phrase").limit(MAX_EXCEPTIONS).collect()
    return [r.phrase for r in rows]


def rising(density: np.ndarray, toxic: np.ndarray, weight: np.ndarray, steps: int = STEPS) -> tuple[list[float], list[float]]:
    """A rising map from density to the share of toxic documents, as points to interpolate."""
    order = np.argsort(density, kind="stable")
    density, toxic, weight = density[order], toxic[order], weight[order]
    zeros = int(np.searchsorted(density, 0.0, "right"))
    groups = [g for g in [np.arange(zeros), *np.array_split(np.arange(zeros, len(density)), steps)] if len(g)]
    # least and largest density, weight and toxic weight; neighbours out of order are pooled
    pools: list[tuple[float, float, float, float]] = []
    for g in groups:
        pool = density[g[0]], density[g[-1]], weight[g].sum(), (weight[g] * toxic[g]).sum()
        while pools and pools[-1][3] / pools[-1][2] >= pool[3] / pool[2]:
            low, _, w, t = pools.pop()
            pool = low, pool[1], w + pool[2], t + pool[3]
        pools.append(pool)
    shares = [(t + 0.01) / (w + 0.02) for _, _, w, t in pools]
    xs, ys = [], []
    for i, (low, high, _, _) in enumerate(pools):  # a slope within each pool keeps unlike densities apart
        before, after = shares[max(i - 1, 0)], shares[i + 1] if i + 1 < len(pools) else (1 + shares[i]) / 2
        xs += [float(low), float(high) + 1e-9]
        ys += [float(shares[i] - (shares[i] - before) / 4), float(shares[i] + (after - shares[i]) / 4 * (high > low))]
    return xs, ys


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", toxic: str = "toxic",
          per_class: int = PER_CLASS) -> Lexicon:
    sample, sizes = sample_of_labels(docs, labels, id_col, text, toxic, per_class)
    n_toxic, n_clean = sizes.get(True, 0), sizes.get(False, 0)
    if not n_toxic or not n_clean:
        return Lexicon(shares=[float(n_toxic > 0)])
    sample = stored(sample, "toxic-sample")
    taken = {r.toxic: r.n for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    weights = learn_words(sample, max(1, taken.get(True, 0)), max(1, taken.get(False, 0)))
    lexicon = Lexicon(weights, learn_exceptions(sample, weights, n_toxic=max(1, taken.get(True, 0)), n_clean=max(1, taken.get(False, 0))))

    def seen(batches):
        matcher = lexicon.automaton()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([density(t, matcher) for t in batch.column(1).to_pylist()], pa.float64())],
                                             names=["toxic", "density"])

    # documents with equal densities are one row, so copies of an id add nothing to the driver
    points = in_small_batches(sample).mapInArrow(seen, "toxic boolean, density double").groupBy(
        "toxic", F.bround("density", 6).alias("density")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "density").limit(4 * per_class).collect()
    kinds = np.array([p.toxic for p in points], float)
    back = {kind: sizes[kind] / max(1, taken.get(kind, 0)) for kind in (True, False)}
    weight = np.array([p.n * back[p.toxic] for p in points])
    lexicon.densities, lexicon.shares = rising(np.array([p.density for p in points]), kinds, weight)
    return lexicon


# --- scoring ------------------------------------------------------------------

def score(docs: DataFrame, lexicon: Lexicon, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (all by default) with ``n_matches, density, score, predicted``."""
    rows = docs.select(F.struct(*(docs.columns if keep is None else keep)).alias("_row"), F.col(text).alias("_text"))
    held = docs.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches):
        known = held.value
        matcher = known.automaton()
        for batch in batches:
            found = []
            for body in batch.column(1).to_pylist():
                hits = matches(body, matcher) if body else []
                found.append((len(hits), sum(h[2] for h in hits) / max(1, len(body.split())) if hits else 0.0))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.float64()),
                 pa.array([known.score(f[1]) for f in found], pa.float64())], names=["_row", "n_matches", "density", "score"])

    schema = T.StructType([rows.schema["_row"], T.StructField("n_matches", T.LongType()), T.StructField("density", T.DoubleType()),
                           T.StructField("score", T.DoubleType())])
    return in_small_batches(rows).mapInArrow(run, schema).select(
        "_row.*", "n_matches", "density", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
