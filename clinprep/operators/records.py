"""Operators on nested sample records: text assembly, corrections, stages, quality flags.

Every operator here is row-local (higher-order functions over the maps of one record), so
none of them shuffles, and all stay usable on a streaming frame.

A record has ``image_path, impression, chexpert_labels, stage, patient_data`` and, after
the passes, ``icd_labels`` and ``data_quality``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clinprep import vocab
from clinprep.functions import labels as lb
from clinprep.functions import measure, text


def _last_wins(entries: Column, key: str = "key") -> Column:
    """Drop entries that a later entry with the same key replaces (short arrays)."""
    return F.filter(entries, lambda e, i: ~F.exists(
        F.slice(entries, i + 2, F.size(entries)), lambda later: later[key] == e[key]))


def _patient(df: DataFrame, **fields) -> DataFrame:
    """Replace fields of ``patient_data`` (a null struct stays null)."""
    data = F.col("patient_data")
    new = data
    for name, col in fields.items():
        new = new.withField(name, col)
    return df.withColumn("patient_data", F.when(data.isNotNull(), new))


def field_names(df: DataFrame, path: str) -> list[str]:
    """Names of a struct (or of the struct a map holds) at a dotted path; empty if absent."""
    kind: T.DataType = df.schema
    for part in path.split("."):
        if not isinstance(kind, T.StructType) or part not in kind.names:
            return []
        kind = kind[part].dataType
    if isinstance(kind, T.MapType):
        kind = kind.valueType
    return kind.names if isinstance(kind, T.StructType) else []


# --- text assembly ------------------------------------------------------------

def pick_ehr_fields(df: DataFrame, out: str = "ehr") -> DataFrame:
    """The patient fields meant for the prompt, as JSON; an empty object without patient data."""
    have = [c for c in vocab.EHR_FIELDS if c in field_names(df, "patient_data")]
    return df.withColumn(out, F.to_json(F.struct(*[F.col(f"patient_data.{c}").alias(c) for c in have])))


def compact_ehr(df: DataFrame, out: str = "ehr_context") -> DataFrame:
    """Short vital names, labs under their canonical name with unit, time offsets if known.

    Without patient data it is an empty object.
    """
    p = F.col("patient_data")
    vital_fields, lab_fields = field_names(df, "patient_data.Vitals"), field_names(df, "patient_data.Labs")
    named = F.filter(
        F.transform(F.map_entries(p["Vitals"]), lambda e: F.struct(
            text.short_vital_name(e["key"]).alias("key"), e["value"].alias("value"))),
        lambda e: e["key"].isNotNull())
    values = F.transform(named, lambda e: F.struct(e["key"].alias("key"), e["value"]["value"].alias("value")))
    offset = next((c for c in ("delta_hours_from_cxr",) if c in vital_fields), None)
    if offset:
        deltas = F.filter(F.transform(named, lambda e: F.struct(
            F.concat(e["key"], F.lit("_delta_hours")).alias("key"), e["value"][offset].alias("value"))),
            lambda e: e["value"].isNotNull())
        values = F.concat(values, deltas)

    def lab(e):
        v = e["value"]
        name = F.coalesce(v["canonical_name"], e["key"]) if "canonical_name" in lab_fields else e["key"]
        parts = [v["value"].alias("value"), v["unit"].alias("unit")]
        if "delta_hours_from_cxr" in lab_fields:
            parts.append(v["delta_hours_from_cxr"].alias("delta_hours"))
        return F.struct(name.alias("key"), F.struct(*parts).alias("value"))

    labs = F.transform(F.map_entries(p["Labs"]), lab)
    staged = df.withColumn("_vitals", values).withColumn("_labs", labs)
    ehr = F.struct(
        p["Age"].alias("Age"), p["Sex"].alias("Sex"),
        F.when(F.size("_vitals") > 0, F.map_from_entries(_last_wins(F.col("_vitals")))).alias("Vitals"),
        F.when(F.size("_labs") > 0, F.map_from_entries(_last_wins(F.col("_labs")))).alias("Labs"),
        F.when(F.size(p["Chronic_conditions"]) > 0, p["Chronic_conditions"]).alias("Chronic"))
    return staged.withColumn(out, F.to_json(ehr)).drop("_vitals", "_labs")


def prompts(df: DataFrame) -> DataFrame:
    """Add ``prompt`` and ``target`` text for both stages."""
    out = df if "ehr_context" in df.columns else compact_ehr(df)
    if "icd_labels" in df.columns:
        icd = lb.icd_map_from_codes(F.coalesce("icd_labels", F.array()))
    else:
        icd = F.create_map(*[c for n in vocab.ICD_CLASSES for c in (F.lit(n), F.lit(0))])
    labels, said = F.col("chexpert_labels"), F.col("impression")
    target = F.when(F.col("stage") == "A", text.stage_a_target(said, labels)).otherwise(
        text.stage_b_target(said, labels, F.col("_icd")))
    return out.withColumn("_icd", icd).withColumn(
        "prompt", text.prompt(F.col("stage"), F.coalesce("ehr_context", F.lit("{}")))
    ).withColumn("target", target).drop("_icd")


def strip_audit(df: DataFrame, *columns: str) -> DataFrame:
    """Remove audit fields at any depth of the given (or all nested) columns."""
    def clean(col: Column, kind: T.DataType) -> Column:
        if isinstance(kind, T.StructType):
            drop = [n for n in kind.names if n in vocab.AUDIT_FIELDS]
            out = col
            for f in kind.fields:
                if f.name not in drop and isinstance(f.dataType, (T.StructType, T.MapType, T.ArrayType)):
                    out = out.withField(f.name, clean(col[f.name], f.dataType))
            out = out.dropFields(*drop) if drop else out
            return F.when(col.isNotNull(), out)
        if isinstance(kind, T.MapType) and isinstance(kind.valueType, T.StructType):
            return F.transform_values(col, lambda _, v: clean(v, kind.valueType))
        if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
            return F.transform(col, lambda v: clean(v, kind.elementType))
        return col

    names = columns or df.columns
    return df.select(*[
        clean(F.col(f.name), f.dataType).alias(f.name) if f.name in names else F.col(f.name)
        for f in df.schema.fields
        if f.name not in vocab.AUDIT_FIELDS
    ])


# --- labels and text ----------------------------------------------------------

def reconcile_labels(df: DataFrame, labels: str = "chexpert_labels", report: str = "impression",
                     negative_value: int = vocab.CLEAR_NEGATIVE) -> DataFrame:
    """Bring label maps in line with the report text.

    Conflicting No Finding, devices named in the text, denied fractures, clear negatives,
    clear positives (unless just negated), No Finding against findings named in the text,
    No Finding recomputed, values outside the domain to uncertain. A clear negative is
    written as ``negative_value``: 0, or -1 for the older meaning.
    """
    staged = df.withColumn("_low", F.lower(F.coalesce(report, F.lit("")))).withColumn("_found", lb.RECONCILING.searched(F.col("_low")))
    holds = lb.RECONCILING.within(F.col("_low"), F.col("_found"))
    values = lb.reconciled_values(F.col(labels), holds, negative_value)
    names = list(values)
    staged = staged.select("*", F.struct(*[v.alias(n) for n, v in values.items()]).alias("_new"))
    touched = F.map_from_entries(F.filter(
        F.array(*[F.struct(F.lit(n).alias("key"), F.col("_new")[n].alias("value")) for n in names]),
        lambda e: e["value"].isNotNull()))
    rest = F.map_filter(labels, lambda k, _: ~k.isin([*names, "No Finding"]))
    staged = staged.withColumn("_others", F.map_concat(rest, touched))
    value = lb.reconciled_no_finding(F.col(labels), holds, F.col("_others"))
    staged = staged.withColumn("_nf", value)
    whole = F.when(F.col("_nf").isNull(), F.col("_others")).otherwise(
        F.map_concat("_others", F.create_map(F.lit("No Finding"), F.col("_nf"))))
    return staged.withColumn(labels, F.transform_values(whole, lambda _, v: lb.in_domain(v))).drop(
        "_low", "_found", "_new", "_others", "_nf")


def negate_contradictions(df: DataFrame, labels: str = "chexpert_labels", report: str = "impression") -> DataFrame:
    staged = df.withColumn("_low", F.lower(F.coalesce(report, F.lit("")))).withColumn("_found", lb.DENYING.searched(F.col("_low")))
    return staged.withColumn(labels, lb.negation_conflicts(F.col(labels), lb.DENYING.within(F.col("_low"), F.col("_found")))).drop("_low", "_found")


def settle_uncertain(df: DataFrame, labels: str = "chexpert_labels") -> DataFrame:
    return df.withColumn(labels, lb.uncertain_to_negative(F.col(labels)))


def add_icd_codes(df: DataFrame) -> DataFrame:
    """Codes from conditions and findings for stage B rows that have none."""
    have = F.col("icd_labels") if "icd_labels" in df.columns else F.lit(None).cast(
        "array<struct<code:string,description:string,confidence:double>>")
    made = lb.icd_codes(F.col("patient_data.Chronic_conditions"), F.col("chexpert_labels"))
    return df.withColumn("icd_labels", F.when((F.col("stage") == "B") & have.isNull(), made).otherwise(have))


# --- stages and flags ---------------------------------------------------------

def stage_by_presence(df: DataFrame) -> DataFrame:
    """A row with patient data is stage B, one without is stage A; other stages stay."""
    has = F.col("patient_data").isNotNull()
    stage = F.col("stage")
    return df.withColumn("stage", F.when(has & (stage == "A"), "B").when(~has & (stage == "B"), "A").otherwise(stage))


def stage_by_content(df: DataFrame) -> DataFrame:
    """Stage B needs an admission, subject, age and sex, and any lab or vital; else A."""
    p = F.col("patient_data")
    measured = (F.coalesce(F.size(p["Labs"]), F.lit(0)) > 0) | (F.coalesce(F.size(p["Vitals"]), F.lit(0)) > 0)
    known = p["hadm_id"].isNotNull() & p["subject_id"].isNotNull() & p["Age"].isNotNull() & p["Sex"].isNotNull()
    fits = F.coalesce(known & measured, F.lit(False))
    return df.withColumn("stage", F.when((F.col("stage") == "B") & ~fits, "A").otherwise(F.col("stage")))


def quality_flags(df: DataFrame) -> DataFrame:
    suspect = F.lit(False)
    if "value_is_suspect" in field_names(df, "patient_data.Labs"):
        suspect = F.coalesce(F.exists(F.map_values("patient_data.Labs"),
                                      lambda v: F.coalesce(v["value_is_suspect"], F.lit(False))), F.lit(False))
    has_icd = (F.coalesce(F.size("icd_labels"), F.lit(0)) > 0) if "icd_labels" in df.columns else F.lit(False)
    return df.withColumn("data_quality", F.struct(
        F.col("patient_data").isNotNull().alias("has_ehr_data"), has_icd.alias("has_icd_labels"),
        suspect.alias("has_suspect_values"), F.coalesce("stage", F.lit("unknown")).alias("stage")))


# --- first pass over measurements ---------------------------------------------

def correct_lab_map(df: DataFrame, match: str = "exact", relabel: bool = False) -> DataFrame:
    """Canonical names, converted units, audit fields; dropped labs leave, the last duplicate stays.

    Adds ``n_labs_dropped`` for the run statistics.
    """
    labs = F.map_entries("patient_data.Labs")
    fields = field_names(df, "patient_data.Labs")

    def bound(v, name):
        return v[name] if name in fields else measure.no_number()

    named = F.transform(labs, lambda e: F.struct(F.lower(e["key"]).alias("low"), e["key"].alias("key"), e["value"].alias("value")))
    looked_up = F.transform(named, lambda e: F.struct(
        e["key"].alias("name"), e["low"].alias("low_name"), e["value"]["value"].alias("value"), e["value"]["unit"].alias("unit"),
        bound(e["value"], "ref_low").alias("low"), bound(e["value"], "ref_high").alias("high"),
        measure.canonical_lab(e["low"], match).alias("info")))
    converted = F.transform(looked_up, lambda e: F.struct(
        e.alias("e"), measure.convert_lab(e["low_name"], e["value"], e["unit"], e["info"]["unit"], relabel).alias("c")))
    done = F.transform(converted, lambda x: measure.corrected_lab(
        x["e"]["name"], x["e"]["value"], x["e"]["unit"], x["e"]["info"], x["c"], x["e"]["low"], x["e"]["high"]))
    staged = df.withColumn("_done", done).withColumn(
        "_kept", F.filter("_done", lambda e: ~e["dropped"]))
    unique = _last_wins(F.col("_kept"), "canonical_name")
    as_map = F.map_from_entries(F.transform(unique, lambda e: F.struct(e["canonical_name"].alias("key"), e.alias("value"))))
    return _patient(staged, Labs=as_map).withColumn(
        "n_labs_dropped", F.coalesce(F.size("_done") - F.size("_kept"), F.lit(0))).drop("_done", "_kept")


_VITAL = "struct<value:double,unit:string,corrected:boolean,original_value:double,original_unit:string,error:string,source:string>"


def correct_vital_map(df: DataFrame) -> DataFrame:
    """Metric units, recomputed BMI, consistent temperatures; impossible readings leave.

    Adds ``n_vitals_dropped`` for the run statistics.
    """
    fields = field_names(df, "patient_data.Vitals")
    entries = F.transform(F.map_entries("patient_data.Vitals"), lambda e: F.struct(
        e["key"].alias("key"),
        measure.correct_vital(e["key"], e["value"]["value"], e["value"]["unit"]).withField(
            "source", e["value"]["source"] if "source" in fields else measure.no_text()).cast(_VITAL).alias("value")))
    staged = df.withColumn("_all", entries).withColumn(
        "_fine", F.filter("_all", lambda e: e["value"]["error"].isNull()))

    def last_value(test):
        hits = F.filter("_fine", test)
        return F.try_element_at(hits, F.lit(-1))["value"]["value"]

    def unit_in(e, *units):
        return F.lower(F.coalesce(e["value"]["unit"], F.lit(""))).isin(*units)

    staged = (
        staged
        .withColumn("_kg", last_value(lambda e: (F.lower(e["key"]) == "weight") & (e["value"]["unit"] == "kg")))
        .withColumn("_m", last_value(lambda e: (F.lower(e["key"]) == "height") & (e["value"]["unit"] == "m")))
        .withColumn("_f", last_value(lambda e: F.lower(e["key"]).contains("temp") & unit_in(e, "f", "fahrenheit")))
        .withColumn("_c", last_value(lambda e: F.lower(e["key"]).contains("temp") & unit_in(e, "c", "celsius")))
    )

    def made(key, value, unit, source=None, original=None):
        cell = F.struct(
            value.alias("value"), F.lit(unit).alias("unit"), F.lit(True).alias("corrected"),
            (original if original is not None else measure.no_number()).alias("original_value"),
            (F.lit(unit) if original is not None else measure.no_text()).alias("original_unit"),
            measure.no_text().alias("error"),
            (F.lit(source) if source else measure.no_text()).alias("source")).cast(_VITAL)
        return F.array(F.struct(F.lit(key).alias("key"), cell.alias("value")))

    has_bmi = F.coalesce((F.col("_kg") != 0) & (F.col("_m") != 0), F.lit(False))
    bmi = F.when(F.col("_m") <= 0, 0.0).otherwise(F.try_divide(F.col("_kg"), F.col("_m") * F.col("_m")))
    no_bmi = F.filter("_fine", lambda e: ~F.lower(e["key"]).isin("bmi", "bmi_calculated"))
    with_bmi = F.when(has_bmi, F.concat(no_bmi, made("BMI", bmi, "kg/m²", "recalculated"))).otherwise(F.col("_fine"))
    expected = (F.col("_f") - 32) * 5 / 9
    off = F.coalesce((F.abs(F.col("_c") - expected) > 0.5) & F.col("_f").between(95, 105), F.lit(False))
    staged = staged.withColumn("_v", with_bmi)
    fixed = F.when(off, F.concat(
        F.filter("_v", lambda e: e["key"] != "temperature_c"),
        made("temperature_c", expected, "C", None, F.col("_c")))).otherwise(F.col("_v"))
    return _patient(staged, Vitals=F.map_from_entries(fixed)).withColumn(
        "n_vitals_dropped", F.coalesce(F.size("_all") - F.size("_fine"), F.lit(0))).drop(
        "_all", "_fine", "_kg", "_m", "_f", "_c", "_v")


def parse_oxygen(df: DataFrame) -> DataFrame:
    """Free oxygen text to device, flow and fraction; an already structured device stays."""
    if field_names(df, "patient_data.O2_device"):
        return df
    return _patient(df, O2_device=measure.oxygen_device(F.col("patient_data.O2_device")))


# --- second pass over measurements --------------------------------------------

def remove_sentinels(df: DataFrame) -> DataFrame:
    """Remove placeholder labs, conversion artifacts and an INR that contradicts PT."""
    labs = F.col("patient_data.Labs")
    pt = F.try_element_at(labs, F.lit("PT"))["value"]
    return _patient(df, Labs=F.map_filter(labs, lambda k, v: ~measure.lab_sentinel(k, v["value"], pt)))


def flag_ranges(df: DataFrame) -> DataFrame:
    """Recompute the in-range flag and mark suspect values."""
    def flagged(k, v):
        low = F.coalesce(v["ref_low"], F.lit(vocab.DEFAULT_RANGE[0]))
        high = F.coalesce(v["ref_high"], F.lit(vocab.DEFAULT_RANGE[1]))
        return v.withField("normal_range", v["value"].between(low, high)).withField(
            "value_is_suspect", measure.lab_suspect(k, v["value"], low, high))

    return _patient(df, Labs=F.transform_values("patient_data.Labs", flagged))


def normalize_vital_map(df: DataFrame) -> DataFrame:
    """Celsius, metres, kilograms, no text pressure, BMI recomputed.

    Vitals are reduced to value, unit, source and time offset.
    """
    fields = field_names(df, "patient_data.Vitals")
    cell = "struct<value:double,unit:string,source:string,delta_hours:double>"

    def shaped(value, unit, source, offset):
        return F.struct(value.alias("value"), unit.alias("unit"), source.alias("source"), offset.alias("delta_hours")).cast(cell)

    def given(v, name, kind):
        return v[name] if name in fields else F.lit(None).cast(kind)

    both = F.map_contains_key("patient_data.Vitals", "temperature_c")

    def normal(e):
        v, k = e["value"], e["key"]
        value, unit = v["value"], v["unit"]
        fahrenheit = k == "temperature_f"
        new_value = (F.when(fahrenheit, F.round((value - 32) * 5 / 9, 1))
                     .when((k == "height") & (unit == "cm"), value / 100)
                     .when((k == "weight") & (unit == "lbs"), value * vocab.LBS_TO_KG).otherwise(value))
        new_unit = (F.when(fahrenheit, "°C").when((k == "height") & (unit == "cm"), "m")
                    .when((k == "weight") & (unit == "lbs"), "kg").otherwise(unit))
        offset = given(v, "delta_hours", "double")
        offset = F.when(fahrenheit, F.coalesce(offset, F.lit(vocab.VITAL_DELTA_HOURS))).otherwise(offset)
        return F.struct(F.when(fahrenheit, "temperature_c").otherwise(k).alias("key"),
                        shaped(new_value, new_unit, given(v, "source", "string"), offset).alias("value"))

    kept = F.filter(F.map_entries("patient_data.Vitals"), lambda e: ~(
        ((e["key"] == "temperature_f") & both) | ((e["key"] == "blood_pressure") & e["value"]["value"].isNull())))
    staged = df.withColumn("_v", F.map_from_entries(F.transform(kept, normal)))
    m = F.try_element_at(F.col("_v"), F.lit("height"))["value"]
    kg = F.try_element_at(F.col("_v"), F.lit("weight"))["value"]
    bmi = F.when(m > 0, F.round(F.try_divide(kg, m * m), 2))
    added = F.map_concat(
        F.map_filter("_v", lambda k, _: k != "BMI"),
        F.create_map(F.lit("BMI"), shaped(bmi, F.lit("kg/m²"), F.lit("recalculated"), F.lit(vocab.VITAL_DELTA_HOURS))))
    return _patient(staged, Vitals=F.when(bmi.isNotNull(), added).otherwise(F.col("_v"))).drop("_v")


def normalize_oxygen(df: DataFrame) -> DataFrame:
    o = F.col("patient_data.O2_device")
    return _patient(df, O2_device=F.when(o.isNotNull(), measure.normal_oxygen(o["device"], o["flow_lpm"], o["fio2"])))


def add_default_offsets(df: DataFrame) -> DataFrame:
    """Placeholder time offsets for records without event times; device none becomes unknown."""
    def with_offset(hours):
        return lambda _, v: v.withField("delta_hours", F.lit(hours))

    o = F.col("patient_data.O2_device")
    device = F.when(o["device"] == "none", "unknown").otherwise(o["device"])
    return _patient(
        df,
        Vitals=F.transform_values("patient_data.Vitals", with_offset(vocab.VITAL_DELTA_HOURS)),
        Labs=F.transform_values("patient_data.Labs", with_offset(vocab.LAB_DELTA_HOURS)),
        O2_device=F.when(o.isNotNull(), o.withField("device", device)))
