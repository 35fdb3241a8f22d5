"""Token counts by a compiled finite-state transducer for BPE with byte fallback.

**Compilation.** For a byte-pair vocabulary whose pieces win by score, the encoding of a
string is the encoding of the string without its last token, plus that token; and a sequence
is an encoding exactly if each pair of neighbours is. So while reading, the last token after
one more character is the vocabulary piece ending there that forms a valid pair with the
last token before it. That needs the last tokens at the few previous places from where the
characters read begin some piece: a finite state. States are numbered as they are first met (the full
table would be far larger than what texts visit) and each transition is annotated with the
change in the number of emitted tokens. A character outside the vocabulary is written as one
token per UTF-8 byte and joins with nothing, and a space after a non-space begins a new
token: both lead back to the start state.

**Composition.** Long texts are cut into chunks. What a chunk does to any entry state is its
state map: the characters before its first return to the start state, the tokens counted
after that, and the characters since its last return. Two neighbouring maps compose by
running the joint once (tail of the left, head of the right), which is associative, so the
maps of a document are combined pairwise, level by level, as in a parallel scan. Chunks are
counted on any executor; only their small maps meet per document.

Words recur, so the count of a stretch between two returns is remembered, in bounded tables.

Cases: null and empty texts have 0 tokens and bytes; repeated rows give repeated rows; an
empty table gives none; only the named columns are read, so others may clash.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clinprep.llm.common import in_small_batches

CHUNK = 1 << 15  # code points
LIMIT = 4096
SPACE = "▁"
STATES = 250_000  # states kept by a worker before it starts over: some 100 MB
WARM_UP = (2000, 4096)  # texts, and characters of each, that transitions are compiled for beforehand
WORDS = 600_000  # remembered stretches


class Vocabulary:
    """Scores of the pieces of a sentencepiece BPE model, and exact merging by score."""

    def __init__(self, model_file: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.scores = {
            model.id_to_piece(i): model.get_score(i) for i in range(model.get_piece_size())
            if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i) or model.is_unused(i))}
        # what a later character may still turn into a piece
        self.beginnings = {piece[:i] for piece in self.scores for i in range(len(piece))}
        self.characters = {c for piece in self.scores for c in piece}

    def merge(self, text: str) -> list[str]:
        """Pieces of a short string: the best-scored neighbours first, the leftmost of ties."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = self.scores.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if best is None:
                return parts
            parts[at:at + 2] = [parts[at] + parts[at + 1]]


class Transducer:
    """``step[state][character]`` is the next state and the change in the number of tokens.

    State 0 is the start. A state stands for the recent characters that begin some piece, and
    for each place among them the last token before it and the number of tokens up to it,
    relative to now.
    """

    START = ("", ("",), (0,))  # recent characters; token and count before each number of them

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.pairs: dict[tuple[str, str], bool] = {}
        self.remembered: dict[str, int] = {}
        self.numbers = {self.START: 0}
        self.states = [self.START]
        self.step: list[dict[str, tuple[int, int]]] = [{}]

    def parts(self) -> tuple[dict, dict]:
        """All content as plain containers."""
        return vars(self.vocabulary), {k: v for k, v in vars(self).items() if k != "vocabulary"}

    @classmethod
    def of_parts(cls, parts: tuple[dict, dict]) -> Transducer:
        """A transducer over the same containers: what it compiles stays in them."""
        made, vocabulary = cls.__new__(cls), Vocabulary.__new__(Vocabulary)
        vars(vocabulary).update(parts[0])
        vars(made).update(parts[1], vocabulary=vocabulary)
        return made

    def clear(self) -> None:
        self.pairs.clear()
        self.numbers.clear()
        self.numbers[self.START] = 0
        self.states[:] = [self.START]
        self.step[:] = [{}]

    def valid(self, left: str, right: str) -> bool:
        known = self.pairs.get((left, right))
        if known is None:
            known = self.pairs[left, right] = self.vocabulary.merge(left + right) == [left, right]
        return known

    def compile(self, state: int, char: str) -> tuple[int, int]:
        """Add one transition."""
        if char not in self.vocabulary.characters:
            move = self.step[state][char] = 0, len(char.encode())
            return move
        recent, tokens, counts = self.states[state]
        joined = recent + char
        for size in range(len(joined), 0, -1):
            token = joined[-size:]
            if token in self.vocabulary.scores or size == 1:
                before = tokens[size - 1]
                if not before or self.valid(before, token):
                    change = counts[size - 1] + 1
                    break
        # a place matters only while the characters since then begin some piece
        live = [size == 0 or joined[-size:] in self.vocabulary.beginnings for size in range(len(joined) + 1)]
        longest = max(size for size, is_live in enumerate(live) if is_live)
        new = (joined[len(joined) - longest:],
               tuple(t if is_live else None for t, is_live in zip((token, *tokens), live[:longest + 1])),
               tuple(c if is_live else 0 for c, is_live in zip((0, *(c - change for c in counts)), live[:longest + 1])))
        number = self.numbers.setdefault(new, len(self.states))
        if number == len(self.states):
            self.states.append(new)
            self.step.append({})
        self.step[state][char] = number, change
        return number, change

    def run(self, stretch: str) -> int:
        """Tokens of a stretch read from the start state."""
        step, state, total = self.step, 0, 0
        for char in stretch:
            move = step[state].get(char) or self.compile(state, char)
            state = move[0]
            total += move[1]
        return total

    def count(self, stretch: str) -> int:
        """As ``run``, remembering short stretches."""
        known = self.remembered.get(stretch)
        if known is None:
            if len(self.states) > STATES:
                self.clear()
            known = self.run(stretch)
            if len(stretch) <= 64:
                if len(self.remembered) > WORDS:
                    self.remembered.clear()
                self.remembered[stretch] = known
        return known


def warmed_up(vocabulary: Vocabulary, texts: list[str]) -> Transducer:
    """A transducer with the transitions that some texts need; others are added when met."""
    transducer = Transducer(vocabulary)
    for text in texts:
        compose_all(transducer, [state_map(transducer, SPACE + text.replace(" ", SPACE), True)])
    transducer.remembered.clear()
    return transducer


RETURN = re.compile(f"(?<=[^{SPACE}])(?={SPACE})")


def state_map(transducer: Transducer, chunk: str, first: bool) -> tuple[bool, str, int, str]:
    """``(returns, head, tokens, tail)`` of a chunk of marked text.

    Without a return the whole chunk is its head. The first chunk begins in the start state.
    """
    cut = chunk.find(SPACE, 1)
    while cut > 0 and chunk[cut - 1] == SPACE:
        cut = chunk.find(SPACE, cut + 1)
    if cut < 0:
        return (True, "", 0, chunk) if first else (False, chunk, 0, "")
    # plain words between single spaces are split fast; runs of spaces go with the next word
    head, rest = ("", chunk) if first else (chunk[:cut], chunk[cut:])
    if SPACE * 2 in rest:
        stretches = RETURN.split(rest)
        tail = stretches.pop()
    else:
        lead, *words = rest.split(SPACE)
        stretches = [lead] if lead else []
        stretches += [SPACE + w for w in words]
        tail = stretches.pop()
    get, total = transducer.remembered.get, 0
    for stretch in stretches:
        known = get(stretch)
        total += transducer.count(stretch) if known is None else known
    return True, head, total, tail


def compose(transducer: Transducer, left: tuple, right: tuple) -> tuple:
    """The state map of two neighbouring chunks."""
    returns, head, total, tail = left
    returns2, head2, total2, tail2 = right
    joint = (tail if returns else head) + head2
    # the cut itself may be a return: between a non-space and a space
    if not returns2:
        inner = _cut_returns(joint)
        if len(inner) == 1:
            return (True, head, total, joint) if returns else (False, joint, 0, "")
        first, *middle, last = inner
        counted = sum(map(transducer.count, middle))
        if returns:
            return True, head, total + transducer.count(first) + counted, last
        return True, first, counted, last
    inner = _cut_returns(joint)
    if returns:
        return True, head, total + sum(map(transducer.count, inner)) + total2, tail2
    return True, inner[0], sum(map(transducer.count, inner[1:])) + total2, tail2


def _cut_returns(joint: str) -> list[str]:
    return RETURN.split(joint) if joint else [""]


def compose_all(transducer: Transducer, maps: list[tuple]) -> int:
    """Tokens of a document: neighbouring maps are combined pairwise, level by level."""
    while len(maps) > 1:
        maps = [compose(transducer, *maps[i:i + 2]) if i + 1 < len(maps) else maps[i]
                for i in range(0, len(maps), 2)]
    _, _, total, tail = maps[0]
    return total + transducer.count(tail)


def count_tokens(docs: DataFrame, model_file: str, id_col: str = "doc_id", text: str = "text",
                 chunk: int = CHUNK, limit: int = LIMIT) -> DataFrame:
    """``id, n_bytes, n_tokens, over_limit`` for every row, by a sentencepiece BPE model.

    ``model_file`` must be readable on the executors.
    """
    import pyarrow as pa

    body = F.coalesce(F.col(text), F.lit(""))
    pieces = F.greatest(F.lit(1), F.ceil(F.length("_body") / chunk)).cast("int")
    chunks = (
        docs.select(F.col(id_col).alias("_id"), body.alias("_body"), F.xxhash64(id_col, text).alias("_n"))
        .select("_id", "_n", F.octet_length("_body").cast("long").alias("n_bytes"), pieces.alias("_of"), "_body",
                F.explode(F.sequence(F.lit(0), pieces - 1)).alias("_chunk"))
        .select("_id", "_n", "n_bytes", "_of", "_chunk",
                F.when(F.col("_of") == 1, F.col("_body"))
                .otherwise(F.substring("_body", F.col("_chunk") * chunk + 1, F.lit(chunk))).alias("_body")))
    carried = ["_id", "_n", "n_bytes", "_of", "_chunk"]
    map_names = ["returns", "head", "total", "tail"]
    map_kinds = [pa.bool_(), pa.string(), pa.int64(), pa.string()]

    some = docs.select(F.substring(text, 1, WARM_UP[1])).limit(WARM_UP[0]).collect()
    compiled = docs.sparkSession.sparkContext.broadcast(
        warmed_up(Vocabulary(model_file), [r[0] or "" for r in some]).parts())

    def scan(batches):
        # a worker process keeps the value, and so what a task compiles, for its next tasks
        transducer = Transducer.of_parts(compiled.value)
        for batch in batches:
            maps = []
            for part, at, of in zip(*(batch.column(c).to_pylist() for c in ("_body", "_chunk", "_of"))):
                marked = part.replace(" ", SPACE)
                if at == 0 and part:
                    marked = SPACE + marked
                found = state_map(transducer, marked, at == 0)
                maps.append((True, "", compose_all(transducer, [found]), "") if of == 1 else found)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in carried],
                 *[pa.array([m[i] for m in maps], k) for i, k in enumerate(map_kinds)]], names=carried + map_names)

    schema = T.StructType([chunks.schema[c] for c in carried])
    for name, kind in zip(map_names, (T.BooleanType(), T.StringType(), T.LongType(), T.StringType())):
        schema.add(name, kind)
    mapped = in_small_batches(chunks).mapInArrow(scan, schema)

    def gather(batches):
        """Rows of a document stand together, by chunk; a repeated row has each chunk as often."""
        transducer, key, of, maps, times = None, None, 1, {}, 0

        def total():
            nonlocal transducer
            if of == 1:
                return maps[0][2]
            transducer = transducer or Transducer.of_parts(compiled.value)
            return compose_all(transducer, [maps[i] for i in range(of)])

        for batch in batches:
            out = []
            for row, n, size, parts, at, *found in zip(*(batch.column(c).to_pylist() for c in carried + map_names)):
                if (row, n, size) != key:
                    if key:
                        out += [(key[0], key[2], total())] * times
                    key, of, maps, times = (row, n, size), parts, {}, 0
                maps[at] = tuple(found)
                times += at == 0
            yield as_batch(out, batch.schema.field("_id").type)
        if key:
            yield as_batch([(key[0], key[2], total())] * times, batch.schema.field("_id").type)

    def as_batch(rows, id_kind):
        ids, sizes, counts = zip(*rows) if rows else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(ids, id_kind), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64())],
                                          names=[id_col, "n_bytes", "n_tokens"])

    order = ["_n", "_id", "n_bytes", "_chunk"]
    counted = mapped.repartition("_n").sortWithinPartitions(*order).mapInArrow(gather, T.StructType([
        docs.schema[id_col], T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())]))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
