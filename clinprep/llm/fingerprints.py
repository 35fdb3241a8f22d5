"""Document fingerprints: threshold-scaled sketches. DataFrame functions only.

A text is cut into shingles of five words; each is hashed, and a sketch keeps every distinct
hash below a fixed fraction of the hash range. So sketches of different texts are samples of
one hash space: the sketch of a union is the union of the sketches, and the share of one
sketch found in another estimates how much of one text is contained in the other, however
unequal the two are. A text of which no hash falls below the threshold keeps its smallest
one, so that short texts have a fingerprint too.

Words are runs of letters, digits and non-ASCII characters in lower case. A text of fewer
than five words, but some, is one shingle.

Cases: null and empty texts have an empty sketch, and a likeness of 0 to everything;
repeated rows give repeated rows; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Callable
from math import ceil, log2

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clinprep.functions.exprs import let

SHINGLE = 5
FRACTION = 1 / 8
CELL_ROWS = 4000
MAX_CELLS = 20_000


def shingle_hashes(text: Column, size: int = SHINGLE) -> Column:
    """Hashes of all word shingles, in order, with repeats."""
    def of_words(words: Column) -> Column:
        n = F.size(words)
        many = F.transform(F.sequence(F.lit(0), n - size), lambda i: F.xxhash64(
            *[F.get(words, i + k) for k in range(size)]))
        return (F.when(n >= size, many).when(n > 0, F.array(F.xxhash64(F.array_join(words, " "))))
                .otherwise(F.array().cast("array<long>")))

    split = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    return let(F.array_remove(split, ""), of_words)


def sketch(text: Column, fraction: float = FRACTION, size: int = SHINGLE) -> Column:
    """Sorted distinct hashes in the lowest ``fraction`` of the range; the smallest if none is."""
    limit = -(1 << 63) + int(fraction * (1 << 64))

    def pick(hashes: Column) -> Column:
        low = F.array_sort(F.array_distinct(F.filter(hashes, lambda h: h < limit)))
        return let(low, lambda kept: F.when((F.size(kept) > 0) | (F.size(hashes) == 0), kept)
                   .otherwise(F.array(F.array_min(hashes))))

    return let(shingle_hashes(text, size), pick)


def merged(a: Column, b: Column) -> Column:
    """Sketch of the union of two texts."""
    return F.array_sort(F.array_union(a, b))


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of the shingle sets of two sketches."""
    both = F.size(F.array_intersect(a, b)).cast("double")
    all_ = F.size(a) + F.size(b) - both
    return F.when(all_ > 0, both / all_).otherwise(F.lit(0.0))


def containment(a: Column, b: Column) -> Column:
    """Estimated share of the shingles of ``a`` that occur in ``b``."""
    return F.when(F.size(a) > 0, F.size(F.array_intersect(a, b)) / F.size(a)).otherwise(F.lit(0.0))


def printed(sketch_col: Column) -> Column:
    """A sketch as text: 16 hexadecimal digits for each hash."""
    return F.array_join(F.transform(sketch_col, lambda h: F.lpad(F.hex(h), 16, "0")), "")


def fingerprint(docs: DataFrame, text: str = "text", out: str = "sketch",
                fraction: float = FRACTION, size: int = SHINGLE) -> DataFrame:
    return docs.withColumn(out, sketch(F.col(text), fraction, size))


def with_next(docs: DataFrame, id_col: str, tie: str, derive: Callable[[DataFrame], DataFrame],
              payload: list[str], out: str = "next") -> DataFrame:
    """Each row with a struct of the payload of the next row by descending id, after the last the first.

    ``derive`` adds columns row by row; it is applied once to each row before the window.

    Ids are cut into cells of equal counts by approximate quantiles. A window runs within a
    cell; the first row of each cell (one row a cell) is copied to the end of the cell before.
    Null ids come last; rows of one id are in the order of a hash of column ``tie``.
    """
    n, low = docs.select(F.count("*"), F.min(id_col)).first()
    cells = min(MAX_CELLS, max(1, ceil(n / CELL_ROWS)))
    cuts = []
    if low is not None and cells > 1:
        found = docs.select(F.percentile_approx(id_col, [i / cells for i in range(1, cells)], max(10_000, 10 * cells))).first()[0]
        cuts = sorted(set(found))
    place = F.lit(len(cuts)) - _cuts_upto(F.col(id_col), cuts)  # 0 has the largest ids
    rows = docs.select(
        *docs.columns, F.coalesce(place, F.lit(len(cuts))).alias("__cell"), F.lit(0).alias("__copy"),
        F.xxhash64(tie).alias("__tie"))
    order = [F.col(id_col).desc_nulls_last(), F.col("__tie")]
    heads = (
        rows.groupBy("__cell").agg(F.min(F.struct(
            F.col(id_col).isNull().alias("absent"), F.bitwise_not(F.col(id_col)).alias("minus"), F.col("__tie").alias("tie"))).alias("__first"))
        .withColumn("__before", F.coalesce(
            F.lag("__cell").over(Window.partitionBy(F.lit(0)).orderBy("__cell")),
            F.max("__cell").over(Window.partitionBy(F.lit(0)))))
    )
    first = rows.join(F.broadcast(heads.select("__cell", "__before", "__first")), "__cell").where(
        F.col(id_col).eqNullSafe(F.bitwise_not(F.col("__first.minus"))) & (F.col("__tie") == F.col("__first.tie")))
    # of equal rows any one will do
    first = first.groupBy("__before").agg(*[F.first(c).alias(c) for c in docs.columns], F.first("__tie").alias("__tie")).select(
        *docs.columns, F.col("__before").alias("__cell"), F.lit(1).alias("__copy"), "__tie")
    window = Window.partitionBy("__cell").orderBy("__copy", *order)
    return (
        derive(rows.unionByName(first))
        .withColumn(out, F.lead(F.struct(*payload)).over(window))
        .where(F.col("__copy") == 0).drop("__cell", "__copy", "__tie")
    )


def _cuts_upto(value: Column, cuts: list) -> Column:
    """How many of the sorted cuts are at most the value: binary search, so many cuts cost little."""
    if not cuts:
        return F.lit(0)
    held = F.array(*[F.lit(c) for c in cuts])

    def halve(s: Column, _: Column) -> Column:
        middle = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        upper = F.get(held, middle) <= value
        live = s["lo"] < s["hi"]
        return F.struct(F.when(live & upper, middle + 1).otherwise(s["lo"]).alias("lo"),
                        F.when(live & ~upper, middle).otherwise(s["hi"]).alias("hi"))

    start = F.struct(F.lit(0).alias("lo"), F.lit(len(cuts)).alias("hi"))
    steps = F.sequence(F.lit(1), F.lit(ceil(log2(len(cuts) + 1)) + 1))
    return F.when(value.isNotNull(), F.aggregate(steps, start, halve, lambda s: s["lo"]))


def edit_trial(docs: DataFrame, id_col: str = "doc_id", text: str = "text", fraction: float = FRACTION,
               size: int = SHINGLE) -> DataFrame:
    """How fingerprints respond to an edit, for each document.

    The edited text has its last third replaced by as many first characters of the next
    document by descending id (by all of it if it is shorter).
    """
    texts = docs.select(id_col, F.coalesce(F.col(text), F.lit("")).alias("__text"))
    third = F.floor(F.col("n_chars") / 3).cast("int")
    edited = F.concat(F.substring("__text", F.lit(1), F.col("n_chars").cast("int") - third),
                      F.substring("__next.__text", F.lit(1), third))
    return (
        with_next(texts, id_col, "__text", lambda rows: fingerprint(rows, "__text", "__sketch", fraction, size),
                  ["__text", "__sketch"], "__next")
        .withColumn("n_chars", F.length("__text").cast("long"))
        .withColumn("__edited", edited)
        .withColumn("__edited_sketch", sketch(F.col("__edited"), fraction, size))
        .select(id_col, "n_chars", F.sha2("__edited", 256).alias("edited_sha256"),
                printed(F.col("__sketch")).alias("fingerprint"), printed(F.col("__edited_sketch")).alias("edited_fingerprint"),
                likeness(F.col("__sketch"), F.col("__edited_sketch")).alias("near_edited"),
                likeness(F.col("__sketch"), F.col("__next.__sketch")).alias("near_next"))
    )
