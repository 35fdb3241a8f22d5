"""The patient-context build: warehouse tables in, one nested record per study out.

All measurements become facts of one shape, told apart by a *slot* (a vital of one source, a
lab, the oxygen device). A study whose time is known looks back from it; any other takes the
window of its subject's latest admission; without one, recent vitals and any lab count:

| | study time ``t`` | admission | neither |
|---|---|---|---|
| ICU and ward vitals | 7 days up to ``t`` | 30 days before to 7 days after, open without a discharge | last 90 days |
| outpatient vitals | by date, 7 days up to the day of ``t`` | from the day of admission | any |
| labs | 48 hours up to ``t`` | from admission | any |
| oxygen | 24 hours up to ``t`` | from admission | any |

The first kind is one ordered pass over the facts of a subject and time cell, for all slots
at once; the others are one aggregation per subject. Facts of subjects without a study, and of cells
without one, are left out before. Nothing is exploded by slot, no pairs of
study and event are formed, and what a record needs is then picked from its own row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clinprep import vocab
from clinprep.functions import measure
from clinprep.functions.exprs import micros
from clinprep.operators import ehr
from clinprep.operators.scaling import salted_join
from clinprep.sources.files import stored

DERIVED_UNITS = {"bmi": "kg/m²", "blood_pressure": "mmHg"}
_LONGEST = (vocab.VITAL_LOOKBACK_DAYS + 1) * ehr.DAY  # a day more: outpatient windows go by date


def context_facts(vitals: DataFrame, labs: DataFrame, oxygen: DataFrame, lab_tie: list[str]) -> DataFrame:
    """``subject_id, slot, kind, charttime, fact``: one usable measurement for each slot and instant."""
    def fact(value=None, text=None, unit=None, source=None, reference_range=None, normal_range=None) -> Column:
        return F.struct(
            F.col("charttime"), (F.lit(None) if value is None else value).cast("double").alias("value"),
            (F.lit(None) if text is None else text).cast("string").alias("text"),
            (F.lit(None) if unit is None else unit).cast("string").alias("unit"),
            (F.lit(None) if source is None else source).cast("string").alias("source"),
            (F.lit(None) if reference_range is None else reference_range).cast("string").alias("reference_range"),
            (F.lit(None) if normal_range is None else normal_range).cast("boolean").alias("normal_range"))

    def rows(df: DataFrame, slot: Column, kind: Column, tie: list[str], of: Column) -> DataFrame:
        ids = F.array(*[F.col(c).cast("long") for c in tie])
        return df.where(F.col("charttime").isNotNull()).select(
            "subject_id", slot.alias("slot"), kind.alias("kind"), "charttime", ids.alias("tie"), of.alias("fact"))

    text = F.col("value_text") if "value_text" in vitals.columns else None
    seen = rows(ehr.plausible_vitals(vitals), F.concat_ws("|", "source", "vital"),
                F.when(F.col("source") == "OMR", "dated").otherwise("vital"), ["event_id"],
                fact(F.col("valuenum"), text, F.col("unit"), F.col("source")))
    checked = ehr.checked_labs(labs)
    ranged = "reference_range" in checked.columns
    measured = rows(checked, F.concat_ws("|", F.lit("lab"), "lab"), F.lit("lab"), lab_tie,
                    fact(F.col("valuenum"), None, F.col("valueuom"), None, F.col("reference_range") if ranged else None,
                         F.col("normal_range") if ranged else None))
    stated = oxygen.where(F.col("value").isNotNull() & (F.col("value") != ""))
    device = rows(stated, F.lit("oxygen"), F.lit("oxygen"), ["event_id"],
                  fact(None, F.concat(F.coalesce("device_type", F.lit("Unknown")), F.lit(": "), "value")))
    every = seen.unionByName(measured).unionByName(device)
    return every.groupBy("subject_id", "slot", "kind", "charttime").agg(F.max_by("fact", "tie").alias("fact"))


def facts_at_time(moments: DataFrame, facts: DataFrame, slots: list[str]) -> DataFrame:
    """The last fact of each slot at each moment (``subject_id, study_time``), in columns ``s0, s1, ...``.

    Only facts of cells with a moment take part, and the wide pass has one row for each moment.
    """
    cell = F.floor(F.col("_pos") / _LONGEST)
    placed = moments.withColumn("_pos", micros("study_time")).withColumn("_cell", cell)
    told = facts.where(F.col("slot").isin(slots)).withColumn("_pos", micros("charttime")).withColumn("_cell", F.explode(F.array(cell, cell + 1))).join(
        placed.select("subject_id", "_cell").distinct(), ["subject_id", "_cell"], "left_semi").select(
        "subject_id", "_cell", "_pos", F.lit(0).alias("_asks"), "slot", F.struct("kind", "fact").alias("_fact"),
        F.lit(None).cast("timestamp").alias("study_time"))
    asked = placed.select(
        "subject_id", "_cell", "_pos", F.lit(1).alias("_asks"),
        F.lit(None).cast("string").alias("slot"), F.lit(None).cast(told.schema["_fact"].dataType).alias("_fact"), "study_time")
    cells = Window.partitionBy("subject_id", "_cell").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # a fact belongs to the first moment at or after it; of each slot the last one there is kept
    numbered = told.unionByName(asked).withColumn("_moment", F.sum("_asks").over(cells.orderBy(F.desc("_pos"), F.desc("_asks"))))
    latest = numbered.where("_moment > 0").groupBy("subject_id", "_cell", "_moment", "slot").agg(
        F.max_by("_fact", "_pos").alias("_fact"), F.max("study_time").alias("study_time"))
    each = latest.groupBy("subject_id", "_cell", "_moment").agg(F.max("study_time").alias("study_time"), F.map_from_entries(
        F.collect_list(F.when(F.col("slot").isNotNull(), F.struct("slot", "_fact")))).alias("_facts"))
    last = each.select("subject_id", "study_time", *[
        F.last(F.try_element_at("_facts", F.lit(s)), ignorenulls=True).over(cells.orderBy(F.desc("_moment"))).alias(f"s{i}") for i, s in enumerate(slots)])
    t = F.col("study_time")

    def fresh(name: str) -> Column:
        kind, seen = F.col(name)["kind"], F.col(name)["fact"]
        bound = (F.when(kind == "vital", t - F.expr(f"INTERVAL {vocab.VITAL_LOOKBACK_DAYS} DAYS"))
                 .when(kind == "dated", F.date_trunc("day", t - F.expr(f"INTERVAL {vocab.VITAL_LOOKBACK_DAYS} DAYS")))
                 .when(kind == "lab", t - F.expr(f"INTERVAL {vocab.LAB_LOOKBACK_HOURS} HOURS"))
                 .otherwise(t - F.expr(f"INTERVAL {vocab.OXYGEN_LOOKBACK_HOURS} HOURS")))
        return F.when(seen["charttime"] >= bound, seen).alias(name)

    return last.select("subject_id", "study_time", *[fresh(f"s{i}") for i in range(len(slots))])


def facts_of_admission(subjects: DataFrame, facts: DataFrame, slots: list[str], as_of: Column) -> DataFrame:
    """The last fact of each slot in the admission window (``subject_id, admittime, dischtime``, both may be null)."""
    admit, seen = F.col("admittime"), F.col("charttime")
    in_stay = (seen >= admit - F.expr("INTERVAL 30 DAYS")) & (
        F.col("dischtime").isNull() | (seen <= F.col("dischtime") + F.expr("INTERVAL 7 DAYS")))
    recent = seen >= as_of - F.expr(f"INTERVAL {vocab.RECENT_VITAL_DAYS} DAYS")
    inside = (F.when(F.col("kind") == "vital", F.when(admit.isNull(), recent).otherwise(in_stay))
              .when(F.col("kind") == "dated", admit.isNull() | (seen >= F.date_trunc("day", admit)))
              .otherwise(admit.isNull() | (seen >= admit)))
    kept = salted_join(facts, subjects, "subject_id", ["slot", "charttime"]).where(inside)
    return kept.groupBy("subject_id").agg(*[
        F.max_by(F.when(F.col("slot") == s, F.col("fact")), F.when(F.col("slot") == s, F.col("charttime"))).alias(f"s{i}")
        for i, s in enumerate(slots)])


def merged_vitals(slots: list[str], names: list[str]) -> Column:
    """Vitals of a row by name: ICU before ward before outpatient, and what is derived from them."""
    at = {s: F.col(f"s{i}") for i, s in enumerate(slots)}
    best = {n: F.coalesce(*[at[f"{source}|{n}"] for source in vocab.SOURCE_PRIORITY]) for n in names}
    best = {n: F.when(c.isNotNull(), _vital(c["value"], c["text"], c["unit"], c["charttime"], c["source"])) for n, c in best.items()}
    if {"weight", "height"} <= set(names):
        bmi = measure.bmi_from_cm(best["weight"]["valuenum"], best["height"]["valuenum"])
        best["bmi"] = F.when(bmi.isNotNull(), _vital(bmi, F.lit(None), F.lit(DERIVED_UNITS["bmi"]), best["weight"]["charttime"], F.lit("calculated")))
    if {"systolic_bp", "diastolic_bp"} <= set(names):
        text = measure.pressure_text(best["systolic_bp"]["valuenum"], best["diastolic_bp"]["valuenum"])
        best["blood_pressure"] = F.when(text.isNotNull(), _vital(
            F.lit(None), text, F.lit(DERIVED_UNITS["blood_pressure"]), best["systolic_bp"]["charttime"], F.lit("combined")))
    return _known(best)


def _vital(value: Column, text: Column, unit: Column, time: Column, source: Column) -> Column:
    return F.struct(value.cast("double").alias("valuenum"), text.cast("string").alias("value_text"), unit.alias("unit"),
                    time.alias("charttime"), source.alias("source"))


def _known(cells: dict[str, Column]) -> Column:
    """A map of the cells that are not null."""
    return F.map_from_entries(F.filter(F.array(*[F.struct(F.lit(n).alias("key"), c.alias("value")) for n, c in cells.items()]),
                                       lambda e: e["value"].isNotNull()))


def build_context(studies: DataFrame, patients: DataFrame, admissions: DataFrame,
                  vitals: DataFrame, labs: DataFrame, oxygen: DataFrame, diagnoses: DataFrame,
                  vital_names: list[str], lab_names: list[str], lab_tie: list[str],
                  as_of: Column | None = None) -> DataFrame:
    """``study_id, subject_id, ehr_json, icd_json`` for every study with a patient.

    ``studies(study_id, subject_id, study_time)``, the time may be null; ``vitals(event_id,
    subject_id, vital, source, valuenum, unit, charttime)`` of all sources; ``labs(subject_id,
    lab, valuenum, valueuom, charttime, ...)``; ``oxygen(event_id, subject_id, device_type,
    value, charttime)``. ``as_of`` is the end of the last-resort window (default: now).
    """
    as_of = F.current_timestamp() if as_of is None else as_of
    slots = [f"{source}|{n}" for source in vocab.SOURCE_PRIORITY for n in vital_names] + [f"lab|{n}" for n in lab_names] + ["oxygen"]
    studied = studies.select("subject_id").distinct()
    vitals, labs, oxygen = (df.join(studied, "subject_id", "left_semi") for df in (vitals, labs, oxygen))
    facts = stored(context_facts(vitals, labs, oxygen, lab_tie), "facts")  # read by both kinds of windows
    last = ehr.latest_admission(admissions).select("subject_id", "hadm_id", "admission_type", "admittime", "dischtime")
    people = ehr.demographics(studies, patients).join(last, "subject_id", "left")
    timed = people.where(F.col("study_time").isNotNull())
    untimed = people.where(F.col("study_time").isNull())
    at_time = facts_at_time(studies.where(F.col("study_time").isNotNull()).select("subject_id", "study_time").distinct(), facts, slots)
    windows = studies.where(F.col("study_time").isNull()).select("subject_id").distinct().join(
        last.select("subject_id", "admittime", "dischtime"), "subject_id", "left")
    of_stay = facts_of_admission(windows, facts, slots, as_of)
    rows = timed.join(at_time, ["subject_id", "study_time"], "left").unionByName(untimed.join(of_stay, "subject_id", "left"))

    flags = ehr.condition_flags(diagnoses, ["hadm_id"])
    names = [*vocab.ACUTE_CODES, *vocab.CHRONIC_CODES]
    flagged = rows.join(flags, "hadm_id", "left").withColumns({n: F.coalesce(F.col(n), F.lit(False)) for n in names})
    at = {s: F.col(f"s{i}") for i, s in enumerate(slots)}
    lab_cells = {n: F.when(at[f"lab|{n}"].isNotNull(), F.struct(
        at[f"lab|{n}"]["value"].alias("value"), at[f"lab|{n}"]["unit"].alias("unit"), at[f"lab|{n}"]["charttime"].alias("charttime"),
        at[f"lab|{n}"]["reference_range"].alias("reference_range"), at[f"lab|{n}"]["normal_range"].alias("normal_range"))) for n in lab_names}
    return flagged.select(
        "study_id", "subject_id",
        F.struct(F.col("age").alias("Age"), F.col("sex").alias("Sex"), "hadm_id", "admission_type",
                 merged_vitals(slots, vital_names).alias("Vitals"), _known(lab_cells).alias("Labs"),
                 at["oxygen"]["text"].alias("O2_device"), ehr.chronic_conditions().alias("Chronic_conditions")).alias("ehr_json"),
        ehr.literal_flags(names).alias("icd_json"))
