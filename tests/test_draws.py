"""Drawing and ranking: keyed permutations, radix selection, and cells that stay small."""

import collections
import hashlib

import pytest
from pyspark.sql import functions as F

from clinprep.operators import corpus, scaling


def test_permutations_are_one_to_one(spark):
    sizes = [*range(1, 40), 100, 1599, 1601, 4999]
    rows = spark.createDataFrame([(n,) for n in sizes], "size long").withColumn("i", F.explode(F.sequence(F.lit(0), F.col("size") - 1)))
    got = rows.withColumn("to", scaling.permuted(F.col("i"), F.col("size"), F.lit("k"), F.col("size")))
    found = got.groupBy("size").agg(F.count_distinct("to").alias("n"), F.min("to").alias("low"), F.max("to").alias("high"), F.count_if(F.expr("i = to")).alias("same"))
    for r in found.collect():
        assert (r.n, r.low, r.high) == (r.size, 0, r.size - 1)
        assert r.same < 10 or r.size < 20


def test_large_sizes(spark):
    size = (1 << 40) + 12345
    got = spark.range(20_000).select(scaling.permuted(F.col("id"), F.lit(size), F.lit(1)).alias("to"))
    r = got.agg(F.count_distinct("to").alias("n"), F.max("to").alias("high"), F.avg("to").alias("mean")).first()
    assert r.n == 20_000 and r.high < size and abs(r.mean / size - 0.5) < 0.02


@pytest.mark.parametrize("size", [5, 12, 50])
def test_batches_are_drawn_like_free_samples(spark, size):
    """Each item, and each pair of items, comes about as often as in independent draws."""
    steps, n = 20_000, 4
    drawn = spark.range(steps).withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).select(
        "id", scaling.permuted(F.col("slot"), F.lit(size), F.lit(42), F.lit("A"), F.col("id")).alias("item"))
    batches = drawn.groupBy("id").agg(F.array_sort(F.collect_list("item")).alias("items")).collect()
    items, pairs = collections.Counter(), collections.Counter()
    for r in batches:
        assert len(set(r["items"])) == n
        items.update(r["items"])
        pairs.update((a, b) for k, a in enumerate(r["items"]) for b in r["items"][k + 1:])
    want = steps * n / size
    assert len(items) == size and sum((c - want) ** 2 / want for c in items.values()) < 2.5 * size + 15
    number = size * (size - 1) // 2
    want = steps * n * (n - 1) / 2 / number
    assert len(pairs) == number and sum((c - want) ** 2 / want for c in pairs.values()) < 1.6 * number + 25


def test_batches_without_weights_repeat_no_row(spark):
    samples = spark.range(60).select(F.col("id").alias("k"), F.when(F.col("id") < 40, "A").otherwise("B").alias("stage"))
    plan = corpus.schedule(spark, 30, 16)
    rows = corpus.batches(plan, samples, "k").collect()
    assert len(rows) == 30 * 16
    for part in ("A", "synthetic", "B"):
        keys = [(r.step, r.k) for r in rows if r.part == part]
        assert len(set(keys)) == len(keys) > 0
    first = {(r.step, frozenset(x.k for x in rows if x.step == r.step and x.part == "A")) for r in rows}
    assert len({ids for _, ids in first}) == 30


def test_pools_smaller_than_a_batch_are_used_up(spark):
    samples = spark.createDataFrame([(1, "A"), (2, "A"), (3, "B")], "k long, stage string")
    rows = corpus.batches(corpus.schedule(spark, 2, 16), samples, "k").collect()
    assert collections.Counter((r.step, r.part) for r in rows) == {(s, p): 2 if p == "A" else 1 for s in (0, 1) for p in ("A", "synthetic", "B")}


@pytest.mark.parametrize("most", [1, 3, 1 << 16])
def test_radix_selection(spark, most):
    ids = spark.range(9_000).select(F.col("id").alias("k"))
    order = sorted(hashlib.md5(f"3:{k}".encode()).hexdigest() for k in range(9_000))
    for n in (1, 2, 4_500, 8_999, 9_000):
        assert scaling.order_cutoff(ids, "k", 3, n, most=most) == order[n - 1]
    assert scaling.order_cutoff(ids, "k", 3, 0) is None and scaling.order_cutoff(ids, "k", 3, 9_001) is None


def test_radix_selection_among_equal_ids(spark):
    ids = spark.range(50).select(F.lit(7).alias("k"))
    assert scaling.order_cutoff(ids, "k", 3, 20, most=4) == hashlib.md5(b"3:7").hexdigest()


def test_buckets_follow_the_number_of_rows(spark):
    assert [scaling.rank_digits(n) for n in (0, 10 ** 6, 10 ** 9, 10 ** 10)] == [3, 3, 4, 5]
    ids = spark.range(500).select(F.col("id").alias("k"))
    rows = {d: sorted(map(tuple, scaling.seeded_rank(ids, "k", 7, digits=d).collect())) for d in (1, 3, 6)}
    assert rows[1] == rows[3] == rows[6] and sorted(r for _, r in rows[1]) == list(range(1, 501))


# --- weighted draws

def uniform_draws(spark, n):
    return spark.range(n).select(F.col("id").alias("draw"), corpus.uniform(1, "id").alias("u"))


def test_crowds_of_small_weights_are_split(spark):
    """Half a million items in one part in two million of the interval."""
    n = 500_000
    items = spark.range(n + 1).select(F.col("id").alias("k"), F.when(F.col("id") == n, 1.0).otherwise(1e-12).alias("weight"))
    placed = corpus.draw_cells(items, "k", uniform_draws(spark, 4_000))
    largest = placed.groupBy("_grid", "_bucket").count().agg(F.max("count")).first()[0]
    assert largest < 1_500
    picks = corpus.weighted_draws(items, "k", uniform_draws(spark, 4_000)).groupBy("k").count().collect()
    assert {r.k: r["count"] for r in picks} == {n: 4_000}


def test_heavy_items_are_split_by_draws(spark):
    items = spark.createDataFrame([(1, 1.0), (2, 1e6), (3, 1.0)], "k long, weight double")
    placed = corpus.draw_cells(items, "k", uniform_draws(spark, 20_000))
    assert placed.groupBy("_grid", "_bucket").count().agg(F.max("count")).first()[0] < 200


@pytest.mark.parametrize("weights", [[1.0] * 50, [2.0 ** -k for k in range(80)], [1e-300] * 30 + [1.0] + [1e-300] * 30, [0.0, 1.0, 0.0, 3.0]])
def test_draws_against_a_plain_search(spark, weights):
    items = spark.createDataFrame(list(enumerate(weights)), "k long, weight double")
    spans = sorted((r.low, r.high, r.k) for r in corpus.cumulative_weight(items, "k").collect() if r.low < r.high)
    assert spans[0][0] == 0 and all(a[1] == b[0] for a, b in zip(spans, spans[1:])) or len(weights) > 4
    got = corpus.weighted_draws(items, "k", uniform_draws(spark, 3_000)).collect()
    us = {r.draw: r.u for r in uniform_draws(spark, 3_000).collect()}
    assert len(got) == 3_000
    for r in got:
        low, high = next((a, b) for a, b, k in spans if k == r.k)
        assert low - 1e-12 <= us[r.draw] < high + 1e-12


def test_draws_from_nothing(spark):
    items = spark.createDataFrame([], "k long, weight double")
    assert [r.k for r in corpus.weighted_draws(items, "k", uniform_draws(spark, 3)).collect()] == [None] * 3


@pytest.mark.parametrize("most", [0, 200_000])
def test_codes_are_looked_at_once(spark, most):
    """Broadcast or joined, with a hot code and codes that are null."""
    rows = spark.range(30_000).select("id", F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 7 == 0, None).otherwise(
        (F.col("id") % 50).cast("string")).alias("code"))
    looked = spark.sparkContext.accumulator(0)

    @F.udf("int")
    def length(code):
        looked.add(1)
        return len(code)

    got = scaling.once_per_value(rows, "code", {"n": length(F.col("code"))}, most=most)
    assert got.columns == ["id", "code", "n"] and got.count() == 30_000
    assert got.where("n is distinct from length(code)").count() == 0
    assert looked.value <= 51


def test_flags_of_codes(spark):
    from clinprep import vocab
    from clinprep.operators import ehr, labels

    name, prefixes = next(iter(vocab.ACUTE_CODES.items()))
    rows = spark.createDataFrame([(1, prefixes[0] + "9"), (1, None), (2, None), (3, "ZZZ"), (3, " " + prefixes[-1])], "hadm_id long, icd_code string")
    got = {r.hadm_id: r.asDict() for r in ehr.condition_flags(rows, ["hadm_id"]).collect()}
    assert got[1][name] and got[3][name] and not any(v for k, v in got[2].items() if k != "hadm_id")
    prefix, kind = vocab.ICD_PREFIX_CLASS[0]
    assert labels.icd_classes(rows.unionByName(spark.createDataFrame([(4, prefix.lower())], rows.schema)), "hadm_id").where(f"hadm_id = 4 and {kind} = 1").count() == 1
