"""The two correction passes over nested records, each one chain of row-local steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clinprep.functions import text
from clinprep.operators import records as r
from clinprep.sources.files import BAD_RECORD


def first_pass(samples: DataFrame, negative_value: int = 0, match: str = "exact",
               relabel: bool = False, on_error: str = "drop_measurement") -> DataFrame:
    """Labels, redaction marks, paths, stage, patient data; audit fields are still in place.

    Keeps what the run statistics need beside the record: the stage and labels before, and
    the number of measurements dropped. ``on_error="drop_record"`` leaves out records with
    an impossible vital instead of the vital alone.
    """
    said = [c for c in ("impression", "findings", "report") if c in samples.columns]
    told = F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in ("impression", "findings") if c in said])
    out = samples.withColumn("stage_before", F.col("stage")).withColumn(
        "labels_before", F.col("chexpert_labels")).withColumn("_told", told)
    out = r.reconcile_labels(out, report="_told", negative_value=negative_value).drop("_told")
    for column in said:
        out = out.withColumn(column, text.redaction_marks(F.col(column)))
    out = out.withColumn("image_path", text.strip_path_prefix(F.col("image_path")))
    out = out.transform(r.stage_by_content)
    out = out.transform(lambda d: r.correct_lab_map(d, match, relabel))
    out = out.transform(r.correct_vital_map).transform(r.parse_oxygen)
    if on_error == "drop_record":
        out = out.where(F.col("n_vitals_dropped") == 0)
    return out


AUDIT_COLUMNS = ("stage_before", "labels_before", "n_labs_dropped", "n_vitals_dropped")


def finish_first_pass(corrected: DataFrame) -> DataFrame:
    """Records for the model: audit columns and fields removed."""
    return r.strip_audit(corrected.drop(*AUDIT_COLUMNS))


def first_pass_statistics(corrected: DataFrame) -> DataFrame:
    """Run statistics of the first pass in one aggregation."""
    p = F.col("patient_data")

    def count_true(entries):
        return F.coalesce(F.size(F.filter(F.map_values(entries), lambda v: F.coalesce(v["corrected"], F.lit(False)))), F.lit(0))

    def same(a, b):
        return F.to_json(F.array_sort(F.map_entries(a))) == F.to_json(F.array_sort(F.map_entries(b)))

    def total(col):
        return F.coalesce(F.sum(col), F.lit(0)).cast("long")

    return corrected.agg(
        F.count("*").alias("total_records"),
        total(count_true(p["Labs"])).alias("corrected_labs"),
        total(count_true(p["Vitals"])).alias("corrected_vitals"),
        F.count_if(F.coalesce(p["O2_device"]["corrected"], F.lit(False))).alias("corrected_o2_devices"),
        F.count_if(~same("labels_before", "chexpert_labels")).alias("label_fixes"),
        F.count_if(F.col("stage_before") != F.col("stage")).alias("stage_fixes"),
        total(F.col("n_labs_dropped")).alias("dropped_labs"),
        total(F.col("n_vitals_dropped")).alias("dropped_vitals"),
        F.count_if((count_true(p["Labs"]) + count_true(p["Vitals"]) + F.coalesce(p["O2_device"]["corrected"], F.lit(False)).cast("int")
                    + F.coalesce("n_labs_dropped", F.lit(0)) + F.coalesce("n_vitals_dropped", F.lit(0))) > 0).alias("corrected_records"),
    )


def file_pass_statistics(records: DataFrame, **options) -> DataFrame:
    """Statistics of a first pass over records read with ``read_jsonl(..., bad_records=True)``.

    A malformed line is an error and a dropped record, and is not in ``total_records``;
    ``on_error="drop_record"`` drops further records.
    """
    good = records.where(F.col(BAD_RECORD).isNull()).drop(BAD_RECORD)
    read = records.agg(F.count_if(F.col(BAD_RECORD).isNotNull()).alias("errors"),
                       F.count_if(F.col(BAD_RECORD).isNull()).alias("_good"))
    done = first_pass_statistics(first_pass(good, **options))
    # one row each
    return done.crossJoin(read).withColumn("dropped_records", F.col("errors") + F.col("_good") - F.col("total_records")).drop("_good")


def second_pass(samples: DataFrame) -> DataFrame:
    """Stage, contradictions, sentinels, ranges, units, oxygen, ICD, offsets, uncertainty, flags."""
    return (
        samples.transform(r.stage_by_presence)
        .transform(r.negate_contradictions)
        .transform(r.remove_sentinels)
        .transform(r.flag_ranges)
        .transform(r.normalize_vital_map)
        .transform(r.normalize_oxygen)
        .transform(r.add_icd_codes)
        .transform(r.add_default_offsets)
        .transform(r.settle_uncertain)
        .transform(r.quality_flags)
    )


def full_pass(samples: DataFrame) -> DataFrame:
    """Both passes in the order they depend on each other."""
    return samples.transform(first_pass).transform(finish_first_pass).transform(second_pass)
