"""Quality control: every check is an array of issues on its row, then one summary.

An issue is ``struct(severity, rule, subject)``; the functions return the array column, so
checks combine by concatenation without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clinprep import vocab
from clinprep.functions.exprs import compare, first_match

ISSUE = "array<struct<severity:string,rule:string,subject:string>>"


def _issue(severity: str, rule: str, subject) -> Column:
    name = F.lit(subject) if isinstance(subject, str) else subject
    return F.struct(F.lit(severity).alias("severity"), F.lit(rule).alias("rule"), name.alias("subject"))


def _collect(*cases) -> Column:
    """Issues whose condition holds."""
    return F.array_compact(F.array(*[F.when(c, issue) for c, issue in cases])).cast(ISSUE)


def label_issues(labels: Column, low: Column, negative_values: tuple[int, ...] = vocab.NEGATIVES) -> Column:
    """Labels against the (lower-cased) text.

    ``negative_values`` are the values a clearly negated finding may have: by default the
    one that label reconciliation writes and the older -1.
    """
    other = F.exists(F.map_entries(labels), lambda e: (e["key"] != "No Finding") & (e["value"] == 1))
    found = [_collect(((F.try_element_at(labels, F.lit("No Finding")) == 1) & other,
                       _issue("ERROR", "no_finding_with_positive", "No Finding")))]
    for name, pattern in vocab.QC_NEGATED.items():
        value = F.try_element_at(labels, F.lit(name))
        issues = F.array(_issue("ERROR", "negated_but_not_negative", name))
        if 0 not in negative_values:
            issues = F.when(value == 0, F.concat(issues, F.array(_issue("WARN", "negated_but_zero", name)))).otherwise(issues)
        # the text is searched once, and only where the value makes it matter
        hit = value.isNotNull() & ~value.isin(*negative_values) & low.rlike("(?i)" + pattern)
        found.append(F.when(hit, issues).otherwise(F.array()).cast(ISSUE))
    return F.concat(*found)


def vital_issues(name: Column, value: Column) -> Column:
    """Impossible or implausible vital reading of a long row."""
    cases = []
    for vital, low, low_allowed, high, severity in vocab.QC_VITALS:
        bad = (value < low) if low_allowed else (value <= low)
        if high is not None:
            bad = bad | (value > high)
        cases.append(((name == vital) & bad, _issue(severity, "vital_out_of_range", vital)))
    return _collect(*cases)


def lab_issues(name: Column, value: Column, unit: Column) -> Column:
    """Wrong unit, implausible value, or value outside the broad sanity range."""
    known = name.isin([r[0] for r in vocab.QC_LABS])
    expected = first_match((name == lab, F.lit(u)) for lab, u, _, _ in vocab.QC_LABS)
    outside = first_match(((name == lab), ~value.between(lo, hi)) for lab, _, lo, hi in vocab.QC_LABS)
    wrong_unit = known & (unit != "") & (unit != expected)
    critical = first_match((((name == lab) & (unit == u)), F.lit(True)) for lab, u in vocab.QC_UNIT_ERRORS)
    critical = F.coalesce(critical, F.lit(False))
    cases = [
        (wrong_unit & critical, _issue("ERROR", "invalid_unit", name)),
        (wrong_unit & ~critical, _issue("WARN", "unexpected_unit", name)),
    ]
    for lab, op, bound in vocab.QC_VALUE_ERRORS:
        cases.append(((name == lab) & compare(value, op, bound), _issue("ERROR", "implausible_value", name)))
    cases.append((outside, _issue("WARN", "outside_sanity_range", name)))
    return _collect(*cases)


def structure_issues(stage: Column, patient: Column) -> Column:
    """Stage domain, required patient fields of stage B, BMI given twice."""
    is_b = stage == "B"
    has = patient.isNotNull()
    cases = [
        (stage.isNull() | ~stage.isin("A", "B"), _issue("ERROR", "unknown_stage", F.coalesce(stage, F.lit("null")))),
        (is_b & ~has, _issue("ERROR", "patient_data_missing", "patient_data")),
    ]
    for field in ("subject_id", "Age", "Sex"):
        cases.append((is_b & has & patient[field].isNull(), _issue("ERROR", "patient_field_missing", field)))
    twice = F.map_contains_key(patient["Vitals"], "bmi") & F.map_contains_key(patient["Vitals"], "BMI")
    cases.append((twice, _issue("WARN", "bmi_twice", "BMI")))
    return _collect(*cases)


def record_issues(records: DataFrame) -> DataFrame:
    """Add ``issues`` of all row-local checks to nested records."""
    data = F.col("patient_data")
    nothing = F.array().cast(ISSUE)

    def over(entries, check):
        return F.coalesce(F.flatten(F.transform(F.map_entries(entries), check)), nothing)

    staged = records.withColumn("_low", F.lower(F.coalesce("impression", F.lit(""))))
    return staged.withColumn("issues", F.concat(
        label_issues(F.col("chexpert_labels"), F.col("_low")),
        over(data["Vitals"], lambda e: vital_issues(e["key"], e["value"]["value"])),
        over(data["Labs"], lambda e: lab_issues(e["key"], e["value"]["value"], e["value"]["unit"])),
        structure_issues(F.col("stage"), data),
    )).drop("_low")


def missing_image_issues(records: DataFrame, files: DataFrame, key: str) -> DataFrame:
    """Issue rows for records whose image is not in the inventory."""
    gone = records.select(key, F.col("image_path").alias("path")).where(F.col("path").isNotNull()).join(
        files.select("path"), "path", "left_anti")
    return gone.select(key, F.lit("WARN").alias("severity"), F.lit("image_missing").alias("rule"), F.col("path").alias("subject"))


def issue_rows(df: DataFrame, key: list[str], issues: Column | str = "issues") -> DataFrame:
    col = F.col(issues) if isinstance(issues, str) else issues
    rows = df.select(*key, F.explode_outer(col).alias("_i")).where(F.col("_i").isNotNull())
    return rows.select(*key, "_i.*")
