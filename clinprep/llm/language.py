"""Language identification by compression.

Per language, whole normalised texts of a bounded sample of labelled documents make one
zstandard raw-content dictionary. A text is compressed with each dictionary in turn; the
language of the smallest result wins. The margin is how much smaller it is than the second,
relative to the second; where it is narrow the document is rejected.

Texts are normalised to lower-case words of letters; all of them are compressed, in pieces of
``PIECE`` bytes. Within a piece what recurs soon costs next to nothing, so short pieces let each
part of a text count by its length; all pieces count.

Learning: documents with a language and a text, outside the held-out fifth (CRC-32 of the id
as text, modulo 5). Their ids and languages are counted first; then about ``PER_LANGUAGE``
documents each are chosen by hash, read, and dealt out until a dictionary is full. These are
documented bounds: ``PER_LANGUAGE`` texts and ``DICTIONARY`` bytes for each language. All
else covers all documents.

Cases: null text or no letter gives ``und``, score 0, rejected; no labelled document at all
gives ``und`` everywhere; one language alone wins with score 1; ties go to the first language
by name and are rejected; repeated rows give repeated rows; an empty table gives none; only
the named columns are read, so others may clash.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clinprep.llm.common import in_small_batches

PER_LANGUAGE = 400
DICTIONARY = 96 << 10
PIECE = 1 << 10
MIN_MARGIN = 0.002
MAX_LANGUAGES = 500
UNKNOWN = "und"
WORD = re.compile(r"[^\W\d_]+")
#: Digits that follow each piece: with them even a single word is coded, where alone it would be stored as it is.
TAIL = b" " + b" ".join(b"%d %d" % (i * 7919 % 9973, i) for i in range(12))


def held_out(id_col: str) -> Column:
    """The fifth of documents that nothing is learned from."""
    return F.crc32(F.encode(F.coalesce(F.col(id_col).cast("string"), F.lit("")), "UTF-8")) % 5 == 0


def normalised(text: str | None) -> bytes:
    """Lower-case words of letters; digits of any kind, such as superscripts, are no letters."""
    words = WORD.findall((text or "").lower())
    return " ".join([w if w.isalpha() else "".join(filter(str.isalpha, w)) for w in words]).strip().encode()


def learn(docs: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang",
          per_language: int = PER_LANGUAGE, size: int = DICTIONARY) -> dict[str, bytes]:
    """Dictionary content of each language: at most ``size`` bytes for at most ``MAX_LANGUAGES``."""
    usable = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & ~held_out(id_col))
    counts = {r.lang: r.n for r in usable.groupBy(F.col(lang).alias("lang")).agg(F.count("*").alias("n"))
              .orderBy(F.desc("n"), "lang").limit(MAX_LANGUAGES + 1).collect()}
    if not counts:
        return {}
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    # by hash of the id, so the choice does not depend on the order of rows
    draw = F.pmod(F.xxhash64(F.lit("sample"), F.col(id_col).cast("string")), F.lit(1 << 40))
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1 << 40, (per_language << 40) // n))])
    chosen = usable.where(draw < share[F.col(lang)]).select(F.col(lang).alias("lang"), draw.alias("draw"), F.col(text).alias("text"))

    def fill(batches):
        """Texts of one language, in the order of the draw, until the dictionary is full."""
        import pyarrow as pa

        content: dict[str, list[bytes]] = {}
        for batch in batches:
            for name, body in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                parts = content.setdefault(name, [])
                if sum(map(len, parts)) < size:
                    parts.append(normalised(body))
        full = {k: b" ".join(v)[:size] for k, v in content.items()}
        yield pa.RecordBatch.from_arrays([pa.array(full.keys(), pa.string()), pa.array(full.values(), pa.binary())],
                                         names=["lang", "content"])

    filled = chosen.repartition("lang").sortWithinPartitions("lang", "draw", "text").mapInArrow(
        fill, "lang string, content binary")
    return {r.lang: bytes(r.content) for r in filled.collect() if r.content}


def compressors(dictionaries: dict[str, bytes]) -> list[tuple[str, object]]:
    """A compressor for each language, by name; all with the same search."""
    import zstandard as z

    search = z.ZstdCompressionParameters.from_level(
        3, strategy=z.STRATEGY_GREEDY, min_match=4, window_log=18, search_log=3, chain_log=17, hash_log=17,
        target_length=32, write_content_size=0, write_checksum=0, write_dict_id=0)
    out = []
    for name in sorted(dictionaries):
        content = z.ZstdCompressionDict(dictionaries[name], dict_type=z.DICT_TYPE_RAWCONTENT)
        content.precompute_compress(compression_params=search)
        out.append((name, z.ZstdCompressor(compression_params=search, dict_data=content)))
    return out


def classify(body: bytes, packers: list[tuple[str, object]], piece: int = PIECE) -> tuple[str, float]:
    """Language and margin of a normalised text."""
    if not body or not packers:
        return UNKNOWN, 0.0
    pieces = [body[i:i + piece] + TAIL for i in range(0, len(body), piece)]
    sizes = sorted((sum(len(packer.compress(p)) for p in pieces), name) for name, packer in packers)
    if len(sizes) == 1:
        return sizes[0][1], 1.0
    return sizes[0][1], 1 - sizes[0][0] / sizes[1][0]


def identify(docs: DataFrame, dictionaries: dict[str, bytes], text: str = "text",
             keep: list[str] | None = None, min_margin: float = MIN_MARGIN) -> DataFrame:
    """``keep`` columns (all by default) with ``lang_pred, score, rejected``."""
    return _identified(docs, dictionaries, text, docs.columns if keep is None else keep, min_margin).select(
        "_row.*", "lang_pred", "score", "rejected")


def known_language(docs: DataFrame, dictionaries: dict[str, bytes], text: str = "text",
                   min_margin: float = MIN_MARGIN) -> DataFrame:
    """The documents that are not rejected, all columns as they were."""
    return _identified(docs, dictionaries, text, docs.columns, min_margin).where(~F.col("rejected")).select("_row.*")


def _identified(docs, dictionaries, text, keep, min_margin) -> DataFrame:
    content = docs.sparkSession.sparkContext.broadcast(dictionaries)
    rows = docs.select(F.struct(*keep).alias("_row"), F.col(text).alias("_text"))

    def run(batches):
        import pyarrow as pa

        packers = compressors(content.value)
        for batch in batches:
            found = [classify(normalised(t), packers) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                names=["_row", "lang_pred", "score"])

    schema = T.StructType([rows.schema["_row"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return in_small_batches(rows).mapInArrow(run, schema).withColumn("rejected", F.col("score") < min_margin)
