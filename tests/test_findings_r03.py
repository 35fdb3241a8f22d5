"""Inputs on which the queries of the third review round failed."""

import math
from fractions import Fraction

from pyspark.sql import Window
from pyspark.sql import functions as F

from clinprep.functions.exprs import seeded_hash
from clinprep.operators import corpus, ehr, evaluate
from clinprep.sources import files


def test_bmi_of_a_height_of_zero_is_what_the_division_gives(spark):
    rows = [(k, vital, value) for k, weight, height in [(1, 70.0, 0.0), (2, 0.0, 0.0), (3, 80.0, 200.0), (4, None, 0.0)]
            for vital, value in [("weight", weight), ("height", height)]]
    got = {r.subject_id: r.bmi for r in ehr.derived_vitals(
        spark.createDataFrame(rows, "subject_id long, vital string, valuenum double"), ["subject_id"]).collect()}
    assert got[1] == math.inf and math.isnan(got[2]) and got[3] == 20.0 and got[4] is None


def test_cumulative_weights_are_exact(spark):
    """Within the last place of a double, in whatever order the weights are added."""
    n = 60_000
    items = spark.range(n).select(F.col("id").alias("k"), F.when(F.col("id") % 7 == 0, 2.7).otherwise(1.1).alias("weight"))
    got = sorted((r.high, r.weight) for r in corpus.cumulative_weight(items, "k").collect())
    total, running = sum(Fraction(w) for _, w in got), Fraction(0)
    for high, weight in got:
        running += Fraction(weight)
        assert abs(high - running / total) < 3e-16


def test_reports_are_read_once(spark):
    import __spark_entry__ as entry
    got = entry.queries()["S3_report_corpus"](spark, "/root/testdata/sf0.001")
    assert got._jdf.queryExecution().sparkPlan().toString().count("FileScan binaryFile") == 1
    assert got.count() == got.where("stem_is_key and n_of_key = 1").count() == 200


def test_written_reports_come_back(spark, tmp_path):
    texts = ["one", None, "two\nlines\n", "", "é ❤"] * 3
    reports = spark.createDataFrame([(t,) for t in texts], "report string").coalesce(1)
    files.write_reports(reports, f"{tmp_path}/reports", per_folder=4)
    got = files.read_reports(spark, f"{tmp_path}/reports").orderBy("study_id").collect()
    assert [r.report for r in got] == [(t or "") + "\n" for t in texts]


def test_ngrams_of_a_pair_never_become_rows(spark):
    rows = [(1, "a b a b a", "a b b a b a a"), (2, None, "a b"), (3, "a", None), (4, "", ""), (5, "x", "x y z w v")]
    pairs = spark.createDataFrame(rows, "k long, reference string, prediction string")
    for scored in (evaluate.bleu(pairs, ["k"]), evaluate.rouge_n(pairs, ["k"])):
        plan = scored._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Generate" not in plan
    counts = {r.k: r for r in evaluate.gram_overlap(pairs.select("k", evaluate.words(F.col("reference")).alias("ref_tokens"),
                                                                 evaluate.words(F.col("prediction")).alias("pred_tokens")), ["k"], [1, 2]).collect()}
    assert tuple(counts[1]) == (1, 5, 5, 7, 4, 4, 6) and tuple(counts[5]) == (5, 1, 1, 5, 0, 0, 4)
    assert all(tuple(counts[k])[1:] == (0,) * 6 for k in (2, 3, 4))


def test_demo_sample_sorts_only_what_it_may_take(spark):
    """40 of 300,000 rows of one stage, against a plain sort; no task gets all of a stage."""
    n = 300_000
    samples = spark.range(n).select(F.col("id").alias("k"), F.when(F.col("id") % 9 > 0, "A").when(F.col("id") % 2 == 0, "B").alias("stage"))
    picked = corpus.demo_sample(samples, "k")
    order = Window.partitionBy("stage").orderBy(seeded_hash(42, "k"), "k")
    want = samples.withColumn("n", F.row_number().over(order)).where("n <= 40").select("k", "stage")
    assert sorted(map(str, picked.select("k", "stage").collect())) == sorted(map(str, want.collect())) and picked.count() == 120
    assert "LeftSemi" in picked._jdf.queryExecution().optimizedPlan().toString()


def test_deduplication_by_subject_keeps_no_contexts(spark):
    import __spark_entry__ as entry
    got = entry.queries()["W1_context_dedup_subject"](spark, "/root/testdata/sf0.001")
    assert spark.read.parquet(*got.inputFiles()).columns == ["study_id", "subject_id"]


def test_only_events_near_a_window_are_joined_with_admissions(spark, monkeypatch):
    """Open ends, null times and subjects without a stay; far events never reach the shuffle."""
    stays = spark.createDataFrame(
        [(k, k % 50, f"2024-0{1 + k // 50}-01", None if k % 50 == 7 else f"2024-0{1 + k // 50}-20") for k in range(100)] + [(900, None, "2024-01-01", None)],
        "hadm_id long, subject_id long, a string, d string").select(
        "hadm_id", "subject_id", F.col("a").cast("timestamp").alias("admittime"), F.col("d").cast("timestamp").alias("dischtime"))
    events = spark.range(6000).select(
        F.col("id").alias("event_id"), F.when(F.col("id") % 101 != 0, F.col("id") % 60).alias("subject_id"),
        F.when(F.col("id") % 97 != 0, F.timestamp_seconds(F.lit(1_672_531_200) + F.col("id") * 10_800)).alias("charttime"))
    seen, plain = [], ehr.salted_join
    monkeypatch.setattr(ehr, "salted_join", lambda many, *rest: seen.append(many.count()) or plain(many, *rest))
    for before, after in ((0, 0), (30, 7), (30, None)):
        got = {(r.event_id, r.hadm_id) for r in ehr.in_admission(events, stays, before, after).collect()}
        last = stays.where("hadm_id between 50 and 99")
        end = F.lit(None).cast("timestamp") if after is None else F.col("dischtime") + F.expr(f"INTERVAL {after} DAYS")
        want = events.join(last, "subject_id").where(
            (F.col("charttime") >= F.col("admittime") - F.expr(f"INTERVAL {before} DAYS")) & (end.isNull() | (F.col("charttime") <= end)))
        assert got == {(r.event_id, r.hadm_id) for r in want.collect()} and len(got) > 0
    assert seen[0] < 400 and seen[1] < 900 and all(n < 6000 for n in seen)


def test_records_join_narrow_rows(spark):
    import __spark_entry__ as entry
    plan = entry.queries()["T10_compact_ehr"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    lines = plan.splitlines()
    joins = [i for i, line in enumerate(lines) if "Join " in line]
    maps = [i for i, line in enumerate(lines) if "map(BNP" in line]
    assert maps and max(maps) < min(joins) and plan.count("Generate explode") == 1 and "Union" not in plan


def test_facts_reach_each_moment_without_a_wide_row_each(spark):
    """Against brute force, with facts at the moment itself; facts of cells without a moment are left out before."""
    from clinprep.plans.context import facts_at_time
    day = 86_400
    facts = spark.range(3000).select(
        (F.col("id") % 5).alias("subject_id"), F.element_at(F.array(*[F.lit(s) for s in ("ICU|a", "lab|b", "oxygen", "other")]), (F.col("id") % 4 + 1).cast("int")).alias("slot"),
        F.element_at(F.array(*[F.lit(s) for s in ("vital", "lab", "oxygen", "lab")]), (F.col("id") % 4 + 1).cast("int")).alias("kind"),
        F.timestamp_seconds(F.col("id") * 7_200).alias("charttime")).withColumn("fact", F.struct("charttime"))
    moments = spark.createDataFrame([(k, t * 3_600) for k in range(7) if k != 3 for t in (0, 20, 21, 600, 601, 900, 5000)], "subject_id long, t long").select(
        "subject_id", F.timestamp_seconds("t").alias("study_time"))
    slots = ["ICU|a", "lab|b", "oxygen"]
    out = facts_at_time(moments, facts, slots)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan and "collect_list" in plan
    got = {(r.subject_id, r.study_time): tuple(r[f"s{i}"] and r[f"s{i}"].charttime for i in range(3)) for r in out.collect()}
    seen = [(r.subject_id, r.slot, r.charttime) for r in facts.collect()]
    back = dict(zip(slots, (7 * day, 2 * day, day)))
    for r in moments.collect():
        want = tuple(max((t for k, s, t in seen if k == r.subject_id and s == slot and t <= r.study_time
                          and (r.study_time - t).total_seconds() <= back[slot]), default=None) for slot in slots)
        assert got.pop((r.subject_id, r.study_time)) == want
    assert not got


def test_batches_are_drawn_by_all_tasks(spark):
    """The steps come from several partitions, and the slots of all steps are not broadcast."""
    plan = corpus.schedule(spark, 9000, 10)
    assert [r.step for r in plan.select("step").orderBy("step").collect()] == list(range(9000))
    parts = [r["count"] for r in plan.groupBy(F.spark_partition_id()).count().collect()]
    assert max(parts) < 9000 and (len(parts) > 1)
    assert corpus.schedule(spark, 0, 4).count() == 0 and corpus.schedule(spark, 1, 4).count() == 1
    samples = spark.range(400).select("id", F.when(F.col("id") % 2 == 0, "A").otherwise("B").alias("stage"))
    out = corpus.batches(plan, samples, "id")
    assert out._jdf.queryExecution().sparkPlan().toString().count("SortMergeJoin") == 3
    whole = out.groupBy("step").agg(F.count("*").alias("n")).agg(F.count("*"), F.min("n"), F.max("n")).first()
    assert tuple(whole) == (9000, 10, 10)
