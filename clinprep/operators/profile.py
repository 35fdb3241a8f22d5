"""Counts and coverage reports. Each is one aggregation over a bounded set of names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _report_rows():
    """All rows of a report; their number is bounded by the vocabularies."""
    return Window.partitionBy(F.lit(1))


def label_distribution(rows: DataFrame) -> DataFrame:
    """Count per label and value, from long label rows."""
    return rows.groupBy("label", "value").agg(F.count("*").alias("n"))


def map_distribution(records: DataFrame, labels: str) -> DataFrame:
    """The same from a label map column."""
    # the outer form keeps Spark from repeating a computed map in a size filter
    rows = records.select(F.explode_outer(labels).alias("label", "value"))
    return label_distribution(rows.where(F.col("label").isNotNull()))


def view_counts(records: DataFrame) -> DataFrame:
    return records.groupBy("view").agg(F.count("*").alias("n"))


def length_profile(records: DataFrame, text: str) -> DataFrame:
    """Mean, shortest and longest text in characters."""
    # the aggregates skip nulls themselves; a filter would evaluate a computed text twice
    sizes = records.select(F.length(text).cast("long").alias("size"))
    return sizes.agg(
        F.count("size").alias("n"), F.avg("size").alias("mean_chars"),
        F.min("size").alias("min_chars"), F.max("size").alias("max_chars"))


def _named(metric: str, names: Column) -> Column:
    return F.transform(names, lambda n: F.struct(F.lit(metric).alias("metric"), n.alias("name")))


def _one(metric: str, name: Column, present: Column) -> Column:
    return F.array(F.when(present, F.struct(F.lit(metric).alias("metric"), name.alias("name"))))


def context_coverage(contexts: DataFrame) -> DataFrame:
    """Coverage of age, sex, vitals, labs, flags, admissions and oxygen in one pass."""
    e = F.col("ehr_json")
    rows = F.array_compact(F.concat(
        _one("total", F.lit("any"), F.lit(True)),
        _one("age", F.lit("known"), e["Age"] > 0),
        _one("sex", e["Sex"], e["Sex"].isNotNull()),
        _one("admission", F.lit("any"), e["hadm_id"].isNotNull()),
        _one("oxygen", F.lit("any"), e["O2_device"].isNotNull()),
        _named("vital", F.map_keys(e["Vitals"])),
        _named("lab", F.map_keys(e["Labs"])),
        _named("flag", F.map_keys(F.map_filter("icd_json", lambda _, v: v))),
    ))
    age = F.when(F.col("r.metric") == "age", F.col("age"))
    counted = contexts.select(e["Age"].alias("age"), F.explode_outer(rows).alias("r")).groupBy(
        F.col("r.metric").alias("metric"), F.col("r.name").alias("name")).agg(
        F.count("*").alias("n"), F.round(F.avg(age), 4).alias("mean"),
        F.min(age).cast("long").alias("low"), F.max(age).cast("long").alias("high"))
    total = F.max(F.when(F.col("metric") == "total", F.col("n"))).over(_report_rows())
    return counted.withColumn("percent", F.round(F.lit(100.0) * F.col("n") / total, 4)).where(
        F.col("metric") != "total").select("metric", "name", "n", "percent", "mean", "low", "high")


def stage_coverage(samples: DataFrame, top: int = 10) -> DataFrame:
    """Share of stage-B samples with vitals, labs and conditions, and the most frequent names."""
    p = F.col("patient_data")

    def any_in(col):
        return F.coalesce(F.size(col), F.lit(0)) > 0

    rows = F.array_compact(F.concat(
        _one("total", F.lit("any"), F.lit(True)),
        _one("with_vitals", F.lit("any"), any_in(p["Vitals"])),
        _one("with_labs", F.lit("any"), any_in(p["Labs"])),
        _one("with_chronic", F.lit("any"), any_in(p["Chronic_conditions"])),
        F.coalesce(_named("vital", F.map_keys(p["Vitals"])), F.array()),
        F.coalesce(_named("lab", F.map_keys(p["Labs"])), F.array()),
    ))
    counted = samples.where(F.col("stage") == "B").select(F.explode_outer(rows).alias("r")).groupBy(
        F.col("r.metric").alias("metric"), F.col("r.name").alias("name")).agg(F.count("*").alias("n"))
    total = F.max(F.when(F.col("metric") == "total", F.col("n"))).over(_report_rows())
    place = F.row_number().over(Window.partitionBy("metric").orderBy(F.desc("n"), "name"))
    return counted.withColumn("percent", F.round(F.lit(100.0) * F.col("n") / total, 4)).withColumn(
        "_place", place).where(F.col("_place") <= top).drop("_place")


def split_summary(samples: DataFrame) -> DataFrame:
    """Records, stages, EHR presence and suspect values per split."""
    q = F.col("data_quality")
    return samples.groupBy("split").agg(
        F.count("*").alias("total"), F.count_if(F.col("stage") == "A").alias("stage_a"),
        F.count_if(F.col("stage") == "B").alias("stage_b"), F.count_if(q["has_ehr_data"]).alias("with_ehr"),
        F.count_if(q["has_suspect_values"]).alias("with_suspect"))


def condition_frequencies(samples: DataFrame, conditions: Column) -> DataFrame:
    """How many stage-B samples carry each condition."""
    return samples.where(F.col("stage") == "B").select(F.explode(conditions).alias("name")).groupBy(
        "name").agg(F.count("*").alias("n"))


def positive_frequencies(samples: DataFrame, labels: str) -> DataFrame:
    """How many stage-B samples are positive for each finding."""
    rows = samples.where(F.col("stage") == "B").select(F.explode_outer(labels).alias("name", "value"))
    return rows.where(F.col("value") == 1).groupBy("name").agg(F.count("*").alias("n"))


def issue_summary(issues: DataFrame) -> DataFrame:
    """Quality-control issues per severity and rule."""
    return issues.groupBy("severity", "rule").agg(F.count("*").alias("n"))
