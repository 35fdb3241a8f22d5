"""Correction of long measurement tables (one row per reading).

Columns: ``lab_name, value, unit, ref_low, ref_high`` for labs, ``vital, value, unit`` for
vitals. All rules are row-local expressions; only ``canonical_labs`` and the INR check
group readings of one record.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clinprep import vocab
from clinprep.functions import measure
from clinprep.functions.exprs import vocabulary_join


def canonical_names(labs: DataFrame, match: str = "exact") -> DataFrame:
    """Add ``info`` (canonical name, unit, range); null for unknown labs."""
    staged = labs.withColumn("_low", F.lower("lab_name"))
    if match != "exact":
        return staged.withColumn("info", measure.canonical_lab(F.col("_low"), match)).drop("_low")
    rows = {row[0].lower(): (row[0].lower(), row[1:]) for row in reversed(vocab.CANONICAL_LABS)}
    schema = "_low string, info struct<canonical_name:string,unit:string,low:double,high:double>"
    return vocabulary_join(staged, list(rows.values()), schema, "_low", "left").drop("_low")


def extreme_values(labs: DataFrame, match: str = "exact") -> DataFrame:
    """Add the reason why a reading is dropped before conversion, if any."""
    return canonical_names(labs, match).withColumn(
        "reason", measure.extreme_reason(F.col("info.canonical_name"), F.col("value")))


def converted_units(labs: DataFrame, match: str = "exact", relabel: bool = False) -> DataFrame:
    """Add ``converted`` (value, unit, error, unresolved) for labs of known type."""
    named = canonical_names(labs, match).withColumn("_low", F.lower("lab_name"))
    return named.withColumn("converted", measure.convert_lab(
        F.col("_low"), F.col("value"), F.col("unit"), F.col("info.unit"), relabel)).drop("_low")


def corrected_labs(labs: DataFrame, match: str = "exact", relabel: bool = False) -> DataFrame:
    """Add ``corrected``: canonical name, value, unit, range flag and audit fields."""
    return converted_units(labs, match, relabel).withColumn("corrected", measure.corrected_lab(
        F.col("lab_name"), F.col("value"), F.col("unit"), F.col("info"), F.col("converted"),
        F.col("ref_low"), F.col("ref_high"))).drop("info", "converted")


def canonical_labs(corrected: DataFrame, keys: list[str], ordinal: list[str]) -> DataFrame:
    """One kept reading per key and canonical lab: the last in record order."""
    # dropped readings have no order value, so they never win; filtering them first would
    # make Spark evaluate all rules a second time inside the filter
    order = F.when(~F.col("corrected.dropped"), F.struct(*ordinal))
    return (
        corrected.withColumn("canonical_name", F.col("corrected.canonical_name"))
        .groupBy(*keys, "canonical_name")
        .agg(F.max_by(F.col("corrected"), order).alias("lab"))
        .where(F.col("lab").isNotNull())
    )


def corrected_vitals(vitals: DataFrame) -> DataFrame:
    return vitals.withColumn("corrected", measure.correct_vital(F.col("vital"), F.col("value"), F.col("unit")))


def without_sentinels(labs: DataFrame, keys: list[str]) -> DataFrame:
    """Drop placeholder readings; an INR goes when the PT of the same record contradicts it.

    Only INR readings above their limit meet the (reduced) PT side; all others are decided
    on their own row.
    """
    name, value = F.col("lab_name"), F.col("value")
    pt = labs.where(name == "PT").groupBy(*keys).agg(F.max("value").alias("_pt"))
    inr_high = (name == "INR") & (value > 5)
    plain = labs.where(~F.coalesce(inr_high, F.lit(False))).where(
        ~measure.lab_sentinel(name, value, measure.no_number()))
    checked = labs.where(inr_high).join(pt, keys, "left").where(
        ~measure.lab_sentinel(name, value, F.col("_pt"))).drop("_pt")
    return plain.unionByName(checked)


def flagged_ranges(labs: DataFrame) -> DataFrame:
    """Add ``normal_range`` and ``value_is_suspect``."""
    value, low, high = F.col("value"), F.col("ref_low"), F.col("ref_high")
    return labs.withColumn("normal_range", value.between(low, high)).withColumn(
        "value_is_suspect", measure.lab_suspect(F.col("lab_name"), value, low, high))


def corrected_oxygen(rows: DataFrame, text: str = "o2") -> DataFrame:
    return rows.withColumn("oxygen", measure.oxygen_device(F.col(text)))
