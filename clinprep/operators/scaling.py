"""Building blocks that keep joins, ranks and windows even under hot keys.

None of them drops, caps or samples rows, and none puts an unbounded group in one task.
"""

from __future__ import annotations

from math import floor

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clinprep.functions.exprs import let, seeded_hash
from clinprep.sources.files import stored

SALTS = 64  # parts of a hot key; pass more for clusters of more than some thousand cores
HOT_SHARE, HOT_ROWS = 0.01, 10_000  # a key with more than this share of the rows, and so many rows, is hot
RANK_DIGITS = 3  # leading hex digits of the md5 order: 4096 buckets at least, each sorted alone
SORTED_ROWS = 1 << 16  # rows that one task sorts at once, or about as many


def hot_keys(many: DataFrame, key: str, share: float = HOT_SHARE, least: int = HOT_ROWS) -> list:
    """Keys with more than ``share`` of the rows, and ``least`` rows: fewer than ``1 / share`` values."""
    counts = many.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n"))
    top = [(r[0], r[1]) for r in counts.where(F.col("_n") >= least).orderBy(F.desc("_n")).limit(int(1 / share)).collect()]
    total = many.count() if top else 0
    return [k for k, n in top if n > share * total]


def salted_join(many: DataFrame, one: DataFrame, key: str, spread: list[str],
                how: str = "inner", salts: int = SALTS) -> DataFrame:
    """Join ``many`` to ``one`` (unique on ``key``) with the rows of hot keys spread out.

    The hot keys are measured first. Only their rows are spread, and only their rows of the
    unique side repeated ``salts`` times; without hot keys this is a plain join. Spreading also
    keeps a later aggregation on the key from being computed where the join left the rows: it
    gets its own exchange with partial aggregation in front. ``spread`` names the columns
    that tell the rows of one key apart; the salt is a hash of them, so a recomputed task
    repeats it. Null keys match nothing and are spread too.
    """
    hot = hot_keys(many, key)
    if not hot:
        return many.join(one, key, how)
    is_hot = F.col(key).isin(hot)
    salt = F.when(is_hot | F.col(key).isNull(), F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int")).otherwise(F.lit(0))
    left = many.withColumn("_salt", salt)
    right = one.withColumn("_salt", F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))))
    return left.join(right, [key, "_salt"], how).drop("_salt")


def rank_digits(rows: int, most: int = SORTED_ROWS) -> int:
    """Leading hex digits of the md5 order that leave at most about ``most`` rows in a bucket."""
    digits = RANK_DIGITS
    while rows > most * 16 ** digits:
        digits += 1
    return digits


def seeded_rank(df: DataFrame, id_col: str, seed: int, by: list[str] | None = None,
                out: str = "rank", digits: int | None = None) -> DataFrame:
    """Rank rows 1..n per ``by`` in seeded md5 order of a unique id, without a global sort.

    Rows are counted per leading digits of the hash; the counts give every bucket its offset,
    and only the rows of one bucket are sorted together. The rows are counted first to find
    how many digits that takes, unless ``digits`` says so.
    """
    by = by or []
    digits = digits or rank_digits(df.count())
    ranked = df.withColumn("_order", seeded_hash(seed, id_col)).withColumn(
        "_bucket", F.substring("_order", 1, digits))
    counts = ranked.groupBy(*by, "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*by, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*by, "_bucket").orderBy("_order", id_col)
    numbered = ranked.withColumn("_row", F.row_number().over(inside))
    return (
        numbered.join(offsets, [*by, "_bucket"])
        .withColumn(out, F.col("_before") + F.col("_row"))
        .drop("_order", "_bucket", "_before", "_row")
    )


def order_cutoff(df: DataFrame, id_col: str, seed, count: int, most: int = SORTED_ROWS) -> str | None:
    """The md5 order value of the ``count``-th id; None when ``count`` is 0 or there are fewer.

    ``seeded_hash(seed, id) <= cutoff`` then selects exactly ``count`` ids, row by row and
    without joining the selection back. Radix selection: ids are counted by the next digits of
    the hash, and the search goes down into the bucket with the wanted rank until that holds
    at most ``most`` ids, which are sorted. A level brings at most 4096 counts to the driver.
    """
    if count <= 0:
        return None
    order, start, left = seeded_hash(seed, id_col), "", count
    while True:
        depth = len(start) + RANK_DIGITS
        counts = df.where(order.startswith(start)).groupBy(F.substring(order, 1, depth).alias("digits")).agg(F.count("*").alias("n"))
        for digits, n in sorted((r.digits, r.n) for r in counts.collect()):
            if n >= left:
                break
            left -= n
        else:
            return None
        start = digits
        if n <= most or len(start) >= 32:  # beyond that all ids are equal
            break
    found = df.where(order.startswith(start)).agg(F.array_sort(F.collect_set(order)).alias("all") if len(start) >= 32 else F.array_sort(F.collect_list(order)).alias("all"))
    return found.select(F.get("all", 0 if len(start) >= 32 else left - 1)).first()[0]


def permuted(index: Column, size: Column, *key, rounds: int = 8) -> Column:
    """``index`` mapped one to one onto the whole numbers below ``size`` (under 2**53), in an order that ``key`` draws.

    A Feistel network on ``left * b + right`` with ``a * b`` just above ``size``; a value beyond
    ``size`` goes through it again until it is below. That takes at most as many turns as
    there are values beyond; above 40 (from ``size`` 1,600 on) a turn fails with a chance under
    1/40, so more are never met and would be an error.
    """
    size = size.cast("long")
    a = F.greatest(F.ceil(F.sqrt(size)), F.lit(1)).cast("long")
    b = F.floor((size + a - 1) / a).cast("long")

    def turn(value: Column) -> Column:
        # the half to change comes first, with its range; the halves change places at each step
        start = F.struct(F.floor(value / b).cast("long").alias("of"), F.pmod(value, b).alias("by"), a.alias("n"), b.alias("m"))

        def step(at, i):
            drawn = F.pmod(F.xxhash64(*key, i, at["by"]), at["n"])
            return F.struct(at["by"].alias("of"), F.pmod(at["of"] + drawn, at["n"]).alias("by"), at["m"].alias("n"), at["n"].alias("m"))

        return F.aggregate(F.sequence(F.lit(0), F.lit(2 * rounds - 1)), start, step, lambda at: at["of"] * b + at["by"])

    beyond = a * b - size
    turns = F.when(beyond > 0, F.sequence(F.lit(1).cast("long"), F.least(beyond, F.lit(40).cast("long")))).otherwise(F.array().cast("array<bigint>"))
    found = F.aggregate(turns, turn(index.cast("long")), lambda value, _: F.when(value < size, value).otherwise(turn(value)))
    return let(found, lambda value: F.when(value < size, value).otherwise(F.raise_error(F.lit("no place below the size")).cast("long")))


def hot_aware_join(many: DataFrame, one: DataFrame, key: str, rows: Column, spread: list[str],
                   share: float = 0.001) -> DataFrame:
    """Inner join ``many`` to ``one`` (unique on ``key``), with hot keys served by broadcast.

    ``rows`` is a column of ``one``: how many rows of ``many`` carry the key. Keys above
    ``share`` of all rows number fewer than ``1/share``, so they may be broadcast; their
    rows then take no part in the shuffle under one key. All other keys join as usual.
    """
    payload = [c for c in one.columns if c != key]
    counted = one.withColumn("_rows", rows)
    total = counted.select(F.sum("_rows")).scalar()
    hot = counted.where(F.col("_rows") > total * share).select(
        key, F.struct(*payload).alias("_hot"))
    marked = many.join(F.broadcast(hot), key, "left").withColumn(
        "_join", F.when(F.col("_hot").isNull(), F.col(key).cast("string"))
        .otherwise(F.concat(F.lit("~"), F.xxhash64(*spread).cast("string"))))
    rest = counted.select(F.col(key).cast("string").alias("_join"), F.struct(*payload).alias("_rest"))
    return (
        marked.join(rest, "_join", "left")
        .withColumn("_found", F.coalesce("_hot", "_rest"))
        .where(F.col("_found").isNotNull())
        .select(*many.columns, "_found.*")
    )


def once_per_value(df: DataFrame, column: str, values: dict[str, Column], most: int = 200_000) -> DataFrame:
    """``df`` with columns that depend on ``column`` alone, worked out once for each different value.

    The different values make a table of their own, which is broadcast up to ``most`` rows
    (counted); beyond that it is joined, with the rows of frequent values spread. The columns
    are null where ``column`` is.
    """
    table = stored(df.where(F.col(column).isNotNull()).select(column).distinct().select(column, *[v.alias(n) for n, v in values.items()]), "values")
    if table.count() <= most:
        joined = df.join(F.broadcast(table), column, "left")
    else:
        joined = salted_join(df, table, column, [c for c in df.columns if c != column] or [column], "left")
    return joined.select(*df.columns, *values)


def share_count(df: DataFrame, share: float) -> int:
    """``floor(share * n)`` of the frame (nudged against binary error)."""
    return floor(share * df.count() + 1e-9)


def last_in_window(queries: DataFrame, facts: DataFrame, by: list[str], query_pos: Column,
                   fact_pos: Column, width: int, tie: Column, payload: list[str]) -> DataFrame:
    """Last fact at or before each query position, at most ``width`` back; no pairs are formed.

    Positions are longs. Both sides are cut into cells of ``width``, so a query only needs
    its own cell and the one before. Facts at the same position are reduced first (largest
    ``tie`` wins), so a cell holds at most one fact per position however hot its key is,
    and cells of one key spread over the cluster. Facts are then sent to their own and the
    next cell and one ordered pass per cell carries the last fact to each query.

    ``queries`` needs to be unique on ``by`` and position. Returns ``by``, ``_pos`` and
    the payload columns for the queries that have a fact.
    """
    reduced = (
        facts.select(*by, fact_pos.alias("_pos"), tie.alias("_tie"), *payload)
        .where(F.col("_pos").isNotNull())
        .groupBy(*by, "_pos")
        .agg(F.max_by(F.struct(*payload), F.col("_tie")).alias("_fact"))
        .withColumn("_cell", F.explode(F.array(
            F.floor(F.col("_pos") / width), F.floor(F.col("_pos") / width) + 1)))
        .select(*by, "_cell", "_pos", F.lit(0).alias("_kind"),
                F.struct(F.col("_pos").alias("_at"), "_fact").alias("_seen"))
    )
    asked = queries.select(*by, query_pos.alias("_pos")).select(
        *by, F.floor(F.col("_pos") / width).alias("_cell"), "_pos", F.lit(1).alias("_kind"),
        F.lit(None).cast(reduced.schema["_seen"].dataType).alias("_seen"))
    upto = (Window.partitionBy(*by, "_cell").orderBy("_pos", "_kind")
            .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    carried = reduced.unionByName(asked).withColumn(
        "_last", F.last("_seen", ignorenulls=True).over(upto))
    return (
        carried.where((F.col("_kind") == 1) & (F.col("_last._at") >= F.col("_pos") - width))
        .select(*by, "_pos", "_last._fact.*")
    )
