"""Patient context from event tables: admissions, time windows, latest valid measurements.

Canonical form is long (one row per measurement); nested maps are built only in
``nested_context``. Time windows come in three modes, as parameters:

* study time given: a look-back from the study (``*_at_study``),
* else the latest admission of the subject (``*_at_admission``),
* else, for vitals, the last 90 days before ``as_of`` (``recent_vitals``).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clinprep import vocab
from clinprep.functions import measure
from clinprep.functions.exprs import decode, literal_map, micros, vocabulary_join
from clinprep.operators.scaling import last_in_window, once_per_value, salted_join
from clinprep.sources.files import stored

SECOND = 1_000_000  # positions are microseconds
DAY = 86_400 * SECOND
HOUR = 3_600 * SECOND
WINDOW_BUCKETS = 1 << 18  # buckets of subjects whose window bounds are broadcast


def demographics(studies: DataFrame, patients: DataFrame, as_recorded: bool = True) -> DataFrame:
    """Age and sex per study; a study without a patient is dropped.

    ``as_recorded=False`` reads age 0 as unknown and every gender but ``M`` as ``F``.
    """
    sex = F.col("gender") if as_recorded else F.when(F.col("gender") == "M", "M").otherwise("F")
    age = F.col("anchor_age") if as_recorded else F.nullif(F.col("anchor_age"), F.lit(0))
    one = patients.select("subject_id", sex.alias("sex"), age.alias("age"))
    return salted_join(studies, one, "subject_id", ["study_id"])


def latest_admission(admissions: DataFrame) -> DataFrame:
    """The latest admission per subject; the higher ``hadm_id`` breaks a tie."""
    rest = [c for c in admissions.columns if c != "subject_id"]
    return (
        admissions.groupBy("subject_id")
        .agg(F.max_by(F.struct(*rest), F.struct("admittime", "hadm_id")).alias("_a"))
        .select("subject_id", "_a.*")
    )


# --- item dictionaries --------------------------------------------------------

def name_items(events: DataFrame, items: dict, out: str) -> DataFrame:
    """Keep events whose item is in a fixed dictionary and add its name."""
    rows = [(int(k), v) for k, v in items.items()]
    return vocabulary_join(events, rows, f"itemid long, {out} string", "itemid")


def join_items(events: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Keep events whose item is in a dictionary table of any size.

    No broadcast hint: Spark broadcasts the table when its measured size allows.
    """
    return events.join(dictionary, "itemid")


def vital_items(d_items: DataFrame) -> DataFrame:
    """Item id to vital name by label pattern (the last matching pattern counts)."""
    named = d_items.select("itemid", measure.vital_code_of_label(F.col("label")).alias("vital"))
    return named.where(F.col("vital").isNotNull())


# --- time windows -------------------------------------------------------------

def in_admission(events: DataFrame, admissions: DataFrame, before_days: int = 0,
                 after_days: int | None = 0) -> DataFrame:
    """Events inside the window of their subject's latest admission.

    ``after_days=None``, or a null discharge, leaves the end open. Inclusive on both sides.
    Events outside every window of their subject's hash bucket are left out by broadcast; only
    the others are stored, measured for hot subjects and joined.
    """
    last = stored(latest_admission(admissions), "last")
    start = F.col("admittime") - F.expr(f"INTERVAL {before_days} DAYS")
    end = F.lit(None).cast("timestamp") if after_days is None else F.col("dischtime") + F.expr(f"INTERVAL {after_days} DAYS")
    near = stored(_near_windows(events, last, start, end), "near")
    joined = salted_join(near, last, "subject_id", ["charttime"])
    return joined.where((F.col("charttime") >= start) & (end.isNull() | (F.col("charttime") <= end)))


def _near_windows(events: DataFrame, windows: DataFrame, start: Column, end: Column) -> DataFrame:
    """Events between the first start and the last end (null: open) of the windows in their subject's bucket.

    A superset of the events inside their own window, from at most ``WINDOW_BUCKETS`` rows.
    """
    bucket = F.pmod(F.xxhash64("subject_id"), F.lit(WINDOW_BUCKETS)).alias("_bucket")
    bounds = windows.select(bucket, start.alias("_start"), end.alias("_end")).groupBy("_bucket").agg(
        F.min("_start").alias("_start"), F.max("_end").alias("_end"), F.bool_or(F.col("_end").isNull()).alias("_open"))
    inside = (F.col("charttime") >= F.col("_start")) & (F.col("_open") | (F.col("charttime") <= F.col("_end")))
    return events.select("*", bucket).join(F.broadcast(bounds), "_bucket").where(inside).select(*events.columns)


def recent(events: DataFrame, as_of: Column, days: int = vocab.RECENT_VITAL_DAYS) -> DataFrame:
    return events.where(F.col("charttime") >= as_of - F.expr(f"INTERVAL {days} DAYS"))


def at_study(studies: DataFrame, events: DataFrame, name: str, names: list[str] | None,
             lookback: int, tie: list[str], payload: list[str], pick: str = "latest") -> DataFrame:
    """One event per study and name in ``[study_time - lookback, study_time]``.

    ``names`` is the controlled vocabulary of ``name``; null takes one event of any name.
    ``pick="oldest"`` looks forward from the start of the window instead. The result keeps
    ``study_id``, the name and the payload.
    """
    asked_at = micros("study_time")
    if pick == "latest":
        query_pos, fact_pos, tie_col = asked_at, micros("charttime"), F.struct(*tie)
    else:
        query_pos, fact_pos = -(asked_at - lookback), -micros("charttime")
        tie_col = F.struct(*[-F.col(c) for c in tie])
    placed = studies.withColumn("_pos", query_pos)
    moments = placed.select("subject_id", "_pos").distinct()
    by = ["subject_id"]
    if names is not None:
        moments = moments.withColumn(name, F.explode(F.array(*[F.lit(n) for n in names])))
        by = ["subject_id", name]
    found = last_in_window(moments, events, by, F.col("_pos"), fact_pos, lookback, tie_col, payload)
    return placed.join(found, ["subject_id", "_pos"]).drop("_pos")


# --- vitals -------------------------------------------------------------------

def plausible_vitals(events: DataFrame, only_source: str | None = "ICU") -> DataFrame:
    """Drop readings outside the physiological limits (of one source, or of all)."""
    fine = measure.vital_plausible(F.col("vital"), F.col("valuenum"))
    if only_source is not None:
        fine = fine | (F.col("source") != only_source)
    return events.where(fine)


def _earliness(pick: str) -> Column:
    time = micros("charttime")
    return time if pick == "oldest" else -time


def pick_vitals(events: DataFrame, keys: list[str], tie: str, pick: str = "latest") -> DataFrame:
    """One reading per key and vital: the latest, or the oldest."""
    id_order = F.col(tie) if pick == "oldest" else -F.col(tie)
    return _reduce_vitals(events, keys, F.struct(_earliness(pick), id_order))


def merge_vital_sources(events: DataFrame, keys: list[str], tie: str,
                        icu_pick: str = "latest") -> DataFrame:
    """One reading per key and vital over all sources: ICU before ward before outpatient.

    Within a source the latest reading counts (for the ICU optionally the oldest). Source,
    time and id form one sort key, so a single aggregation replaces three passes.
    """
    priority = decode(vocab.SOURCE_PRIORITY, F.col("source"))
    oldest = (F.col("source") == "ICU") & F.lit(icu_pick == "oldest")
    time, ident = micros("charttime"), F.col(tie)
    order = F.struct(priority, F.when(oldest, time).otherwise(-time),
                     F.when(oldest, ident).otherwise(-ident))
    return _reduce_vitals(events, keys, order)


def _reduce_vitals(events: DataFrame, keys: list[str], order: Column) -> DataFrame:
    rest = [c for c in ("valuenum", "value_text", "unit", "charttime", "source", "event_id")
            if c in events.columns]
    return (
        events.groupBy(*keys, "vital")
        .agg(F.min_by(F.struct(*rest), order).alias("_v"))
        .select(*keys, "vital", "_v.*")
    )


def numeric_or_text(events: DataFrame, raw: str = "value") -> DataFrame:
    """Split a mixed reading into ``valuenum`` and, where it is no number, ``value_text``."""
    number = F.col(raw).try_cast("double")
    have = F.coalesce(F.col("valuenum"), number) if "valuenum" in events.columns else number
    return events.withColumn("valuenum", have).withColumn(
        "value_text", F.when(F.col("valuenum").isNull(), F.col(raw)))


def outpatient_vitals(omr: DataFrame) -> DataFrame:
    """Outpatient results by result name as vitals of source OMR."""
    named = omr.withColumn("vital", decode(vocab.OUTPATIENT_VITALS, F.col("result_name")))
    kept = named.where(F.col("vital").isNotNull() & F.col("result_value").isNotNull())
    return numeric_or_text(kept, "result_value").withColumn("source", F.lit("OMR")).withColumn(
        "unit", F.lit("unknown")).withColumn("charttime", F.col("chartdate").cast("timestamp"))


def derived_vitals(vitals: DataFrame, keys: list[str]) -> DataFrame:
    """BMI (weight in kg, height in cm) and ``systolic/diastolic`` text per key.

    A height of 0 is divided by like any other: the BMI is infinite and stands out.
    """
    names = ["weight", "height", "systolic_bp", "diastolic_bp"]
    wide = vitals.where(F.col("vital").isin(names)).groupBy(*keys).agg(
        *[F.max(F.when(F.col("vital") == n, F.col("valuenum"))).alias(n) for n in names])
    return wide.select(
        *keys,
        measure.bmi_from_cm(F.col("weight"), F.col("height"), any_height=True).alias("bmi"),
        measure.pressure_text(F.col("systolic_bp"), F.col("diastolic_bp")).alias("blood_pressure"),
    )


# --- labs ---------------------------------------------------------------------

def checked_labs(labs: DataFrame) -> DataFrame:
    """Apply the unit rules of extraction; add the range text and the in-range flag."""
    lab, value, unit = F.col("lab"), F.col("valuenum"), F.col("valueuom")
    kept = labs.where(measure.extraction_lab_kept(lab, value, unit))
    out = kept.withColumns({
        "valuenum": measure.extraction_lab_value(lab, value, unit),
        "valueuom": measure.extraction_lab_unit(lab, value, unit)})
    if {"ref_range_lower", "ref_range_upper"} <= set(labs.columns):
        low, high = F.col("ref_range_lower"), F.col("ref_range_upper")
        has = low.isNotNull() & high.isNotNull() & F.col("valuenum").isNotNull()
        out = out.withColumn("reference_range", F.when(
            has, F.concat_ws("-", low.cast("string"), high.cast("string")))
        ).withColumn("normal_range", F.when(has, F.col("valuenum").between(low, high)))
    return out


def latest_labs(labs: DataFrame, keys: list[str], tie: list[str]) -> DataFrame:
    """Latest valid reading per key and lab; labs whose every reading fell away are left out."""
    rest = [c for c in labs.columns if c not in {*keys, "lab"}]
    return (
        labs.groupBy(*keys, "lab")
        .agg(F.max_by(F.struct(*rest), F.struct("charttime", *tie)).alias("_l"))
        .select(*keys, "lab", "_l.*")
    )


# --- oxygen, diagnoses --------------------------------------------------------

def latest_oxygen(events: DataFrame, keys: list[str], tie: str) -> DataFrame:
    """``{type}: {value}`` of the latest oxygen reading per key."""
    text = F.concat(F.coalesce(F.col("device_type"), F.lit("Unknown")), F.lit(": "), F.col("value"))
    usable = events.where(F.col("value").isNotNull() & (F.col("value") != ""))
    return usable.groupBy(*keys).agg(
        F.max_by(text, F.struct("charttime", tie)).alias("o2_device"))


def condition_masks(diagnoses: DataFrame, strip_dots: bool = True, out: str = "conditions") -> DataFrame:
    """Conditions of each code as bits, in the order of ``condition_names``; each code is looked at once."""
    groups = {**vocab.ACUTE_CODES, **vocab.CHRONIC_CODES}
    tests = measure.code_groups(F.col("icd_code"), groups, strip_dots)
    mask = reduce(lambda a, b: a.bitwiseOR(b), [F.when(test, F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, test in enumerate(tests.values())])
    return once_per_value(diagnoses, "icd_code", {out: mask})


def condition_names() -> list[str]:
    return [*vocab.ACUTE_CODES, *vocab.CHRONIC_CODES]


def has_condition(mask: Column, i: int) -> Column:
    return F.coalesce(mask.bitwiseAND(F.lit(1 << i).cast("long")) != 0, F.lit(False))


def condition_flags(diagnoses: DataFrame, keys: list[str], strip_dots: bool = True) -> DataFrame:
    """One boolean per condition and key: any code starts with a prefix of its group."""
    masks = condition_masks(diagnoses.select(*keys, "icd_code"), strip_dots, "_mask").groupBy(*keys).agg(F.bit_or("_mask").alias("_mask"))
    return masks.select(*keys, *[has_condition(F.col("_mask"), i).alias(name) for i, name in enumerate(condition_names())])


def with_condition_flags(df: DataFrame, flags: DataFrame, key: str, spread: list[str]) -> DataFrame:
    """Attach flags; all are false where there is no admission or no code."""
    names = condition_names()
    joined = salted_join(df, flags, key, spread, "left")
    return joined.select(*df.columns, *[F.coalesce(F.col(n), F.lit(False)).alias(n) for n in names])


def chronic_conditions() -> Column:
    """True flags among the chronic names, as a list in fixed order."""
    return F.array_compact(F.array(*[F.when(F.col(n), F.lit(n)) for n in vocab.CHRONIC_CODES]))


# --- context ------------------------------------------------------------------

def literal_flags(names) -> Column:
    return F.create_map(*[c for n in names for c in (F.lit(n), F.col(n))])


# --- time offsets -------------------------------------------------------------

def hours_from_study(event_time: Column, study_time: Column) -> Column:
    """Signed hours from the study to the event (negative: before the study)."""
    return (micros(event_time) - micros(study_time)) / F.lit(float(HOUR))
