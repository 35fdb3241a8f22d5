"""Mixing sources to target weights by systematic sampling. DataFrame functions only.

Each source gets a target number of words; every document of the source then has the same
expected number of copies, target over source size. The documents of a source are put in a
fixed order (by size band, then by a seeded hash), the expected copies are summed along it,
one random offset per source is added, and a document is emitted once for each integer
boundary that its interval crosses. Ordering by size keeps the words taken near the target.

Along the order the prefix sum is rate times rank, so it needs ranks only. These come from
counts per (source, size band, leading hash digits): offsets are summed over bands, then
over digits, and only the rows of one small bucket are sorted together. A hot source is
thus spread over its bands and digits.

Cases: null or blank text has size 0; null sources form one source, last in order; a null id
hashes like an empty string; repeated rows are sampled one by one; an empty table gives none;
extra columns stay, also ones named like the working columns (these begin with two underscores).
"""

from __future__ import annotations

from math import ceil, log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clinprep.llm.common import scalar, stored, word_counts

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2.0
SEED = 1
ROWS_PER_DIGITS = 1 << 20  # a hash digit more for each 16-fold of this many rows
SMALL_TABLE = 20_000  # bucket rows up to which the bucket table is broadcast


def source_targets(totals: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """Targets of sources, one row per source: ``source, source_size`` in, ``target`` added.

    Sources by code point, null last, weigh ``weights`` repeating and share ``share`` of all
    sizes. A target stops at ``most`` times its source; the excess goes to the others by weight.
    In the order of cap over weight the capped sources come first, so the level is that of the
    first source that the remaining share does not fill.
    """
    everything = Window.partitionBy(F.lit(0))
    place = F.row_number().over(everything.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (place % len(weights) + 1).cast("int"))
    by_fill = everything.orderBy(F.col("_cap") / F.col("_weight"), F.col("source").asc_nulls_last())
    upto = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    filled = (
        totals.withColumn("_weight", weight)
        .withColumn("_cap", F.col("source_size") * F.lit(most))
        .withColumn("_total", F.sum("source_size").over(everything) * F.lit(share))
        .withColumn("_left", F.col("_total") - F.coalesce(F.sum("_cap").over(upto), F.lit(0.0)))
        .withColumn("_weights", F.sum("_weight").over(by_fill.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("_open", F.col("_left") * F.col("_weight") <= F.col("_cap") * F.col("_weights"))
    )
    return (
        filled.withColumn("_level", F.min(F.when(F.col("_open"), F.struct(
            F.col("_cap") / F.col("_weight"), F.col("source").isNull(), "source", "_left", "_weights"))).over(everything))
        .withColumn("target", F.when(F.coalesce("_open", F.lit(False)),
                                     F.col("_level._left") * F.col("_weight") / F.col("_level._weights"))
                    .otherwise(F.col("_cap")))
        .select("source", "source_size", "target")
    )


def _order(id_col: str, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source",
                weights=WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = SEED,
                keep: list[str] | None = None) -> DataFrame:
    """All documents with ``size, source_size, target, copies, taken`` (of ``keep`` columns, else all)."""
    mixed = _mixed(docs, id_col, text, source, weights, share, most, seed, docs.columns if keep is None else keep)
    return mixed.select("__row.*", F.col("__size").alias("size"), F.col("__total").alias("source_size"),
                        F.col("__target").alias("target"), F.col("__copies").alias("copies"),
                        (F.col("__copies") * F.col("__size")).alias("taken"))


def mixed_copies(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source",
                 weights=WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = SEED) -> DataFrame:
    """The documents of the mix, each as often as it is taken, all columns as they were."""
    mixed = _mixed(docs, id_col, text, source, weights, share, most, seed, docs.columns).where(F.col("__copies") > 0)
    return mixed.select("__row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__copies")))).select("__row.*")


def _mixed(docs, id_col, text, source, weights, share, most, seed, keep) -> DataFrame:
    length = F.length(F.bin("__size"))
    sized = docs.withColumn("__size", word_counts(text)).select(
        F.struct(*keep).alias("__row"), F.col(id_col).alias("__id"), F.col(source).alias("__source"), "__size",
        F.coalesce(F.concat(F.lit("s"), F.col(source)), F.lit("n")).alias("__key"),
        _order(id_col, seed).alias("__order"),
        (length * 16 + F.expr("shiftright(__size, cast(greatest(length(bin(__size)) - 4, 0) as int))")).cast("int").alias("__band"))
    rows = scalar(docs.select(F.count("*")))
    digits = max(1, ceil(log(max(rows, 1) / ROWS_PER_DIGITS, 16)))
    sized = sized.withColumn("__digits", F.substring("__order", 1, digits))
    buckets = stored(
        sized.groupBy("__key", "__source", "__band", "__digits")
        .agg(F.count("*").alias("__n"), F.sum("__size").alias("__sum")), "mix")
    bands = buckets.groupBy("__key", "__source", "__band").agg(F.sum("__n").alias("__n"), F.sum("__sum").alias("__sum"))
    by_band = Window.partitionBy("__key").orderBy("__band").rowsBetween(Window.unboundedPreceding, -1)
    by_digits = Window.partitionBy("__key", "__band").orderBy("__digits").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}/"), F.coalesce("source", F.lit("")))), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    targets = source_targets(
        bands.groupBy("__source").agg(F.sum("__sum").alias("source_size")).withColumnRenamed("__source", "source"),
        weights, share, most,
    ).select(F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n")).alias("__key"),
             F.col("source_size").alias("__total"), F.col("target").alias("__target"), offset.alias("__offset"))
    plan = (
        buckets.select("__key", "__band", "__digits", F.coalesce(F.sum("__n").over(by_digits), F.lit(0)).alias("__inside"))
        .join(bands.select("__key", "__band", F.coalesce(F.sum("__n").over(by_band), F.lit(0)).alias("__before")), ["__key", "__band"])
        .join(targets, "__key")
    )
    if scalar(buckets.select(F.count("*"))) <= SMALL_TABLE:
        plan = F.broadcast(plan)
    bucket = ["__key", "__band", "__digits"]
    rank = F.row_number().over(Window.partitionBy(*bucket).orderBy("__order", "__id"))
    rate = F.when(F.col("__total") > 0, F.col("__target") / F.col("__total")).otherwise(F.lit(0.0))
    crossed = F.floor(F.col("__offset") + F.col("__rate") * F.col("__rank")) - F.floor(
        F.col("__offset") + F.col("__rate") * (F.col("__rank") - 1))
    return (
        sized.withColumn("__in_bucket", rank).join(plan, bucket)
        .withColumn("__rank", F.col("__before") + F.col("__inside") + F.col("__in_bucket"))
        .withColumn("__rate", rate)
        # rounding of rate times rank could add a boundary that the interval is too short for
        .withColumn("__copies", F.least(crossed, F.ceil("__rate")).cast("long"))
        .select("__row", "__size", "__total", "__target", "__copies")
    )


def oracle(seed: int = SEED) -> str:
    """The mix of table ``documents`` in SQL, with the weights and limits of this module's defaults."""
    return rf"""
with recursive d as (
  select doc_id, source, coalesce('s' || source, 'n') as k, md5('{seed}:' || coalesce(cast(doc_id as varchar), '')) as o,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size from documents),
t as (select k, source, sum(size)::bigint as source_size from d group by all),
w as (select *, case (row_number() over (order by source nulls last) - 1) % 3 when 0 then 5 when 1 then 2 else 1 end as weight from t),
-- round n: the excess of the sources above their cap is shared again by weight
s(n, capped) as (
  select 0, cast([] as varchar[])
  union all
  select n + 1, (select coalesce(list(k), cast([] as varchar[])) from w where list_contains(s.capped, k) or
      ((select sum(source_size) * 1.5 from w) - coalesce((select sum(source_size * 2.0) from w where list_contains(s.capped, k)), 0)) * weight
      > source_size * 2.0 * (select sum(weight) from w where not list_contains(s.capped, k)))
  from s where n < (select count(*) from w)),
f as (select capped from s order by n desc limit 1),
g as (
  select w.*, case when list_contains(capped, k) then source_size * 2.0 else
    ((select sum(source_size) * 1.5 from w) - coalesce((select sum(source_size * 2.0) from w where list_contains(capped, k)), 0))
    * weight / (select sum(weight) from w where not list_contains(capped, k)) end::double as target
  from w, f),
r as (
  select doc_id, size, source_size, target, case when source_size > 0 then target / source_size else 0 end as rate,
    (('0x' || substr(md5('{seed}/' || coalesce(g.source, '')), 1, 8))::bigint)::double / 4294967296.0 as u,
    row_number() over (partition by d.k order by length(bin(size)) * 16 + (size >> greatest(length(bin(size)) - 4, 0)), o, doc_id) as place
  from d join g using (k))
select doc_id, size, source_size, target,
  (least(floor(u + rate * place) - floor(u + rate * (place - 1)), ceil(rate)) * size)::bigint as taken from r"""
