"""Correction operators: C4-C15, C17-C20, A15, A16."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.bindings import view
from checks.labels import L3_CASES, _l4_sql
from checks.records import RECORD_VIEWS, records
from checks.registry import check
from checks.text import IMPRESSION_SQL
from clinprep import vocab
from clinprep.operators import correct, profile
from clinprep.operators import records as rec
from clinprep.plans import passes
from clinprep.session import scratch_dir
from clinprep.sources import files

LAB_IDS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
_CANON = ", ".join(f"({i}, '{n}', '{c}', '{u}', {lo}::DOUBLE, {hi}::DOUBLE)" for i, (n, c, u, lo, hi) in enumerate(vocab.CANONICAL_LABS))
CANON = f"canon AS (SELECT * FROM (VALUES {_CANON}) AS t(pos, name, canonical_name, target, low, high))"
NAMES = "names AS (SELECT DISTINCT lab_name FROM labs)"
EXACT = f"""{CANON}, {NAMES}, info AS (SELECT n.lab_name, arg_min(canonical_name, pos) AS canonical_name, arg_min(target, pos) AS target,
            arg_min(low, pos) AS low, arg_min(high, pos) AS high FROM names n JOIN canon c ON lower(n.lab_name) = lower(c.name) GROUP BY 1)"""
CONTAINS = EXACT.replace("lower(n.lab_name) = lower(c.name)", "contains(lower(c.name), lower(n.lab_name)) OR contains(lower(n.lab_name), lower(c.name))")


@check("C4_canonical_exact", views=("labs",), sql=f"""
    WITH {EXACT} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, canonical_name, target AS unit, low, high
    FROM labs l LEFT JOIN info i ON l.lab_name = i.lab_name""")
def _(spark, sf):
    out = correct.canonical_names(view(spark, sf, "labs"))
    return out.select(*LAB_IDS, "info.canonical_name", "info.unit", "info.low", "info.high")


@check("C4_canonical_contains", views=("labs",), sql=f"""
    WITH {CONTAINS} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, canonical_name, target AS unit, low, high
    FROM labs l LEFT JOIN info i ON l.lab_name = i.lab_name""")
def _(spark, sf):
    out = correct.canonical_names(view(spark, sf, "labs"), "contains")
    return out.select(*LAB_IDS, "info.canonical_name", "info.unit", "info.low", "info.high")


EXTREME = """CASE WHEN canonical_name = 'BUN' AND value > 200 THEN 'extreme BUN' WHEN canonical_name = 'PLT' AND value < 10 THEN 'critically low PLT'
             WHEN canonical_name = 'BNP' AND value > 100000 THEN 'extreme BNP' END"""


@check("C5_extreme_labs", views=("labs",), sql=f"""
    WITH {EXACT} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {EXTREME} AS reason FROM labs l LEFT JOIN info i ON l.lab_name = i.lab_name""")
def _(spark, sf):
    return correct.extreme_values(view(spark, sf, "labs")).select(*LAB_IDS, "reason")


# unit rules as they apply to the labs of the binding view
ERROR = """CASE WHEN unit = target THEN CASE WHEN lower(l.lab_name) IN ('cl', 'chloride') AND unit = 'mEq/L' AND NOT value BETWEEN 50 AND 150 THEN 'impossible value'
                     WHEN lower(l.lab_name) IN ('hco3', 'co2') AND unit = 'mEq/L' AND NOT value BETWEEN 10 AND 50 THEN 'impossible value'
                     WHEN lower(l.lab_name) = 'pt' AND unit = 'sec' AND NOT value BETWEEN 5 AND 50 THEN 'impossible value' END
                WHEN canonical_name = 'PLT' AND unit = 'm/uL' AND value >= 1 THEN 'meaningless unit'
                WHEN canonical_name = 'BNP' AND unit = 'mg/dL' THEN 'meaningless unit' WHEN canonical_name = 'BUN' AND unit = 'mEq/L' THEN 'meaningless unit'
                WHEN canonical_name = 'WBC' AND unit = '%' THEN 'meaningless unit' WHEN canonical_name = 'INR' AND unit = 'K/uL' THEN 'meaningless unit' END"""
FACTOR = """CASE WHEN canonical_name = 'PLT' AND unit = 'm/uL' THEN 1000::DOUBLE WHEN canonical_name = 'BUN' AND unit = 'mmol/L' THEN 2.8::DOUBLE
                 WHEN canonical_name = 'CRP' AND unit = '%' THEN 10::DOUBLE WHEN canonical_name = 'HCO3' AND unit = 'mg/dL' THEN 0.23::DOUBLE
                 WHEN canonical_name = 'Cl' AND unit = 'mg/dL' THEN 0.28::DOUBLE WHEN canonical_name = 'ALT' AND unit = 'mg/dL' THEN 16.67::DOUBLE END"""


def _convert_sql(relabel):
    other = "target" if relabel else "unit"
    return f"""
    WITH {EXACT}, e AS (SELECT l.*, i.canonical_name, i.target, i.low, i.high, {ERROR} AS error, {FACTOR} AS factor
                        FROM labs l JOIN info i ON l.lab_name = i.lab_name)
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, error,
           round(CASE WHEN error IS NULL THEN CASE WHEN unit = target THEN value ELSE value * coalesce(factor, 1) END END, 6) AS value,
           CASE WHEN error IS NOT NULL OR unit = target OR factor IS NOT NULL THEN target ELSE {other} END AS unit FROM e"""


def _converted(spark, sf, relabel):
    out = correct.converted_units(view(spark, sf, "labs"), relabel=relabel).where(F.col("info").isNotNull())
    return out.select(*LAB_IDS, "converted.error", F.round("converted.value", 6).alias("value"), "converted.unit")


@check("C6_unit_conversion", views=("labs",), sql=_convert_sql(False))
def _(spark, sf):
    return _converted(spark, sf, False)


@check("C6_unit_conversion_relabel", views=("labs",), sql=_convert_sql(True))
def _(spark, sf):
    return _converted(spark, sf, True)


C7_SQL = f"""
    WITH {EXACT}, e AS (SELECT l.*, i.canonical_name, i.target, i.low, i.high, {EXTREME} AS extreme, {ERROR} AS error, {FACTOR} AS factor
                        FROM labs l LEFT JOIN info i ON l.lab_name = i.lab_name),
    v AS (SELECT *, CASE WHEN canonical_name IS NULL OR unit = target THEN value ELSE value * coalesce(factor, 1) END AS new_value,
                 CASE WHEN canonical_name IS NULL THEN unit WHEN unit = target OR factor IS NOT NULL THEN target ELSE unit END AS new_unit
          FROM e WHERE extreme IS NULL AND error IS NULL),
    r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, coalesce(canonical_name, lab_name)
                 ORDER BY l_linenumber DESC, l_partkey DESC, l_suppkey DESC) AS rn FROM v)
    SELECT l_orderkey, coalesce(canonical_name, lab_name) AS canonical_name, round(new_value, 6) AS value, new_unit AS unit,
           CASE WHEN canonical_name IS NOT NULL THEN new_value BETWEEN low AND high END AS normal_range, unit <> new_unit AS corrected
    FROM r WHERE rn = 1"""


@check("C7_canonical_labs", views=("labs",), sql=C7_SQL)
def _(spark, sf):
    out = correct.canonical_labs(correct.corrected_labs(view(spark, sf, "labs")), ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey"])
    return out.select("l_orderkey", "canonical_name", F.round("lab.value", 6).alias("value"), "lab.unit", "lab.normal_range", "lab.corrected")


@check("C8_vital_units", views=("vitals",), sql="""
    SELECT event_id, round(CASE WHEN vital = 'respiratory_rate' AND value = 0 THEN NULL WHEN vital = 'height' AND unit = 'inch' THEN value * 0.0254::DOUBLE
                WHEN vital = 'height' AND unit = 'cm' THEN value * 0.01::DOUBLE WHEN vital = 'temperature' AND unit = 'F' THEN (value - 32) * 5 / 9 ELSE value END, 6) AS value,
           CASE WHEN vital = 'height' AND unit IN ('inch', 'cm') THEN 'm' WHEN vital = 'weight' AND unit = 'unknown' THEN 'kg'
                WHEN vital = 'temperature' THEN 'C' ELSE unit END AS unit,
           vital = 'respiratory_rate' AND value = 0 AS rejected FROM vitals""")
def _(spark, sf):
    out = correct.corrected_vitals(view(spark, sf, "vitals"))
    return out.select("event_id", F.round("corrected.value", 6).alias("value"), "corrected.unit",
                      F.col("corrected.error").isNotNull().alias("rejected"))


# records with readings under both temperature names and kilograms, derived from the record view
def metric_records(spark, sf):
    base = records(spark, sf)
    v = F.col("patient_data.Vitals")

    def cell(name, value, unit):
        return F.create_map(F.lit(name), F.struct(value.alias("value"), F.lit(unit).alias("unit")))

    kg = F.try_element_at(v, F.lit("weight"))["value"]
    whole = F.map_concat(F.map_filter(v, lambda k, _: k != "weight"),
                         cell("weight", kg, "kg"), cell("bmi", F.lit(1.0), "x"),
                         cell("temperature_c", F.col("study_id") % 5 + 34.0, "C"))
    changed = F.when(F.size(v) > 0, F.col("patient_data").withField("Vitals", whole)).otherwise(F.col("patient_data"))
    return base.withColumn("patient_data", changed)


REC_WIDE = """w AS (SELECT study_id, max(value) FILTER (vital = 'temperature_f') AS f, max(value) FILTER (vital = 'height') AS cm,
                          max(value) FILTER (vital = 'weight') AS kg FROM rec_vitals GROUP BY 1)"""


@check("C9_bmi", views=RECORD_VIEWS, sql=f"""
    WITH {REC_WIDE} SELECT r.study_id, round(kg / ((cm * 0.01::DOUBLE) * (cm * 0.01::DOUBLE)), 6) AS bmi, false AS old_kept
    FROM rec r LEFT JOIN w ON r.study_id = w.study_id""")
def _(spark, sf):
    out = rec.correct_vital_map(metric_records(spark, sf))
    v = F.col("patient_data.Vitals")
    return out.select("study_id", F.round(F.try_element_at(v, F.lit("BMI"))["value"], 6).alias("bmi"),
                      F.coalesce(F.map_contains_key(v, "bmi"), F.lit(False)).alias("old_kept"))


@check("C10_temperature_consistency", views=RECORD_VIEWS, sql=f"""
    WITH {REC_WIDE}, t AS (SELECT *, study_id % 5 + 34.0::DOUBLE AS c, (f - 32) * 5 / 9 AS e FROM w)
    SELECT r.study_id, round(CASE WHEN abs(c - e) > 0.5 AND f BETWEEN 95 AND 105 THEN e ELSE c END, 6) AS temperature_c
    FROM rec r LEFT JOIN t ON r.study_id = t.study_id""")
def _(spark, sf):
    out = rec.correct_vital_map(metric_records(spark, sf))
    return out.select("study_id", F.round(F.try_element_at(
        F.col("patient_data.Vitals"), F.lit("temperature_c"))["value"], 6).alias("temperature_c"))


@check("C11_oxygen_text", views=("o2_text",), sql="""
    WITH t AS (SELECT event_id, lower(o2) AS o2, contains(o2, ':') AS colon, trim(split_part(lower(o2), ':', 1)) AS lead,
                      try_cast(trim(split_part(o2, ':', 2)) AS DOUBLE) AS num FROM o2_text),
         d AS (SELECT *, CASE WHEN contains(lead, 'none') THEN 'none' WHEN contains(lead, 'nc') THEN 'NC' WHEN contains(lead, 'bipap') THEN 'BiPAP'
                              WHEN contains(lead, 'trach') THEN 'Trach' ELSE 'none' END AS dev,
                      CASE WHEN contains(o2, 'none') THEN 'none' WHEN contains(o2, 'nc') THEN 'NC' WHEN contains(o2, 'bipap') THEN 'BiPAP'
                              WHEN contains(o2, 'trach') THEN 'Trach' ELSE 'none' END AS any_dev FROM t)
    SELECT event_id, CASE WHEN colon AND num IS NOT NULL AND dev <> 'none' THEN dev ELSE any_dev END AS device,
           CASE WHEN colon AND dev = 'NC' THEN num END AS flow_lpm,
           CASE WHEN colon AND dev IN ('BiPAP', 'Trach') THEN CASE WHEN num > 1 THEN num / 100 ELSE num END END AS fio2 FROM d""")
def _(spark, sf):
    out = correct.corrected_oxygen(view(spark, sf, "o2_text"))
    return out.select("event_id", "oxygen.device", "oxygen.flow_lpm", "oxygen.fio2")


SENTINEL_SQL = """
    WITH pt AS (SELECT l_orderkey, max(value) AS pt FROM clean_labs WHERE lab_name = 'PT' GROUP BY 1)
    SELECT c.l_orderkey, l_linenumber, l_partkey, l_suppkey FROM clean_labs c LEFT JOIN pt ON c.l_orderkey = pt.l_orderkey
    WHERE NOT ((lab_name = 'BNP' AND value = 100000) OR (lab_name = 'BUN' AND value = 200)
        OR (lab_name = 'ALT' AND (value IN (3.334::DOUBLE, 5.001::DOUBLE, 8.335::DOUBLE, 13.336::DOUBLE) OR value < 5))
        OR (lab_name = 'INR' AND value > 5 AND coalesce(pt.pt, 0) > 30))"""


@check("C12_sentinel_labs", views=("clean_labs",), sql=SENTINEL_SQL)
def _(spark, sf):
    return correct.without_sentinels(view(spark, sf, "clean_labs"), ["l_orderkey"]).select(*LAB_IDS)


@check("C12_sentinel_records", views=RECORD_VIEWS, sql="""
    WITH p AS (SELECT study_id, value AS pt FROM rec_labs WHERE lab = 'PT')
    SELECT l.study_id, l.lab, l.value FROM rec_labs l JOIN p ON l.study_id = p.study_id
    WHERE NOT ((lab = 'BNP' AND value = 100000) OR (lab = 'BUN' AND value = 200) OR (lab = 'INR' AND value > 5 AND pt > 30))""")
def _(spark, sf):
    out = rec.remove_sentinels(records(spark, sf))
    return out.select("study_id", F.explode_outer("patient_data.Labs").alias("lab", "v")).where("lab IS NOT NULL").select("study_id", "lab", "v.value")


@check("C13_range_flags", views=("clean_labs",), sql="""
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, value BETWEEN ref_low AND ref_high AS normal_range,
           (lab_name = 'BNP' AND value = 100000) OR (lab_name = 'BUN' AND value = 200) OR (lab_name = 'PLT' AND value = 1000000)
           OR value < ref_low - 0.5 * (ref_high - ref_low) OR value > ref_high + 0.5 * (ref_high - ref_low) AS value_is_suspect FROM clean_labs""")
def _(spark, sf):
    return correct.flagged_ranges(view(spark, sf, "clean_labs")).select(*LAB_IDS, "normal_range", "value_is_suspect")


@check("C14_vital_normalization", views=RECORD_VIEWS, sql=f"""
    WITH {REC_WIDE}
    SELECT study_id, 'temperature_c' AS vital, round((f - 32) * 5 / 9, 1) AS value, '°C' AS unit FROM w
    UNION ALL SELECT study_id, 'height', round(cm / 100, 6), 'm' FROM w
    UNION ALL SELECT study_id, 'weight', round(kg * 0.453592::DOUBLE, 6), 'kg' FROM w
    UNION ALL SELECT study_id, 'BMI', round((kg * 0.453592::DOUBLE) / ((cm / 100) * (cm / 100)), 2), 'kg/m²' FROM w
    UNION ALL SELECT study_id, vital, value, unit FROM rec_vitals WHERE vital = 'respiratory_rate'""")
def _(spark, sf):
    out = rec.normalize_vital_map(records(spark, sf))
    return out.select("study_id", F.explode_outer("patient_data.Vitals").alias("vital", "v")).where("vital IS NOT NULL").select(
        "study_id", "vital", F.round("v.value", 6).alias("value"), "v.unit")


@check("C15_oxygen_vocabulary", views=("o2_text",), sql="""
    WITH t AS (SELECT event_id, event_id % 11 AS k, CAST(event_id % 130 AS DOUBLE) AS x FROM o2_text)
    SELECT event_id, CASE k WHEN 3 THEN 'NC' WHEN 4 THEN 'NRB' WHEN 5 THEN 'HFNC' WHEN 6 THEN 'BiPAP' WHEN 7 THEN 'BiPAP'
                            WHEN 8 THEN 'ETT' WHEN 9 THEN 'Trach' WHEN 10 THEN 'ETT' ELSE 'none' END AS device,
           CASE WHEN x <> 0 THEN x END AS flow_lpm, CASE WHEN x > 1 THEN x / 100 WHEN x <> 0 THEN x END AS fio2 FROM t""")
def _(spark, sf):
    from clinprep.functions.measure import normal_oxygen
    names = F.array(*[F.lit(n) for n in vocab.OXYGEN_NAMES])
    x = (F.col("event_id") % 130).cast("double")
    out = view(spark, sf, "o2_text").select("event_id", normal_oxygen(
        F.get(names, (F.col("event_id") % 11).cast("int")), x, x).alias("o"))
    return out.select("event_id", "o.device", "o.flow_lpm", "o.fio2")


@check("C17_stage_by_presence", views=RECORD_VIEWS, sql="""
    SELECT study_id, CASE WHEN age IS NOT NULL AND stage = 'A' THEN 'B' WHEN age IS NULL AND stage = 'B' THEN 'A' ELSE stage END AS stage FROM rec""")
def _(spark, sf):
    return rec.stage_by_presence(records(spark, sf)).select("study_id", "stage")


@check("C18_stage_by_content", views=RECORD_VIEWS, sql="""
    SELECT study_id, CASE WHEN stage = 'B' AND NOT (hadm_id IS NOT NULL AND age IS NOT NULL AND n_labs + n_vitals > 0) THEN 'A' ELSE stage END AS stage FROM rec""")
def _(spark, sf):
    return rec.stage_by_content(records(spark, sf)).select("study_id", "stage")


SUSPECT = """(lab = 'BNP' AND value = 100000) OR (lab = 'BUN' AND value = 200) OR value < 0 OR value > 40"""


@check("C19_quality_flags", views=RECORD_VIEWS, sql=f"""
    WITH s AS (SELECT study_id, bool_or({SUSPECT}) AS suspect FROM rec_labs GROUP BY 1)
    SELECT r.study_id, r.age IS NOT NULL AS has_ehr_data, coalesce(s.suspect, false) AS has_suspect_values, r.stage, r.study_id % 3 = 1 AS has_icd_labels
    FROM rec r LEFT JOIN s ON r.study_id = s.study_id""")
def _(spark, sf):
    icd = F.when(F.col("study_id") % 3 == 1, F.create_map(F.lit("Pneumonia"), F.lit(0)))
    out = rec.quality_flags(rec.flag_ranges(records(spark, sf).withColumn("icd_labels", icd)))
    q = F.col("data_quality")
    return out.select("study_id", q["has_icd_labels"].alias("has_icd_labels"), q["has_ehr_data"].alias("has_ehr_data"), q["has_suspect_values"].alias("has_suspect_values"), q["stage"].alias("stage"))


@check("A16_split_summary", views=RECORD_VIEWS, sql=f"""
    WITH s AS (SELECT study_id, bool_or({SUSPECT}) AS suspect FROM rec_labs GROUP BY 1)
    SELECT CASE WHEN r.study_id % 4 = 0 THEN 'val' ELSE 'train' END AS split, count(*) AS total, count(*) FILTER (stage = 'A') AS stage_a,
           count(*) FILTER (stage = 'B') AS stage_b, count(age) AS with_ehr, count(*) FILTER (coalesce(s.suspect, false)) AS with_suspect
    FROM rec r LEFT JOIN s ON r.study_id = s.study_id GROUP BY 1""")
def _(spark, sf):
    flagged = rec.quality_flags(rec.flag_ranges(records(spark, sf)))
    return profile.split_summary(flagged.withColumn("split", F.when(F.col("study_id") % 4 == 0, "val").otherwise("train")))


# --- whole passes -------------------------------------------------------------

A15_SQL = """
    WITH l AS (SELECT study_id, count(*) FILTER ((lab = 'BUN' AND value > 200) OR (lab = 'BNP' AND value > 100000) OR (lab = 'PT' AND value NOT BETWEEN 5 AND 50)) AS dl FROM rec_labs GROUP BY 1),
         v AS (SELECT study_id, count(*) FILTER (vital = 'respiratory_rate' AND value = 0) AS dv, count(*) FILTER (vital = 'height') AS cv FROM rec_vitals GROUP BY 1)
    SELECT count(*) AS total_records, 0::BIGINT AS corrected_labs, coalesce(sum(cv), 0)::BIGINT AS corrected_vitals,
           count(*) FILTER (age IS NOT NULL AND o2 IN ('nc: 2', 'bipap: 40')) AS corrected_o2_devices,
           count(*) FILTER (stage = 'B' AND NOT (hadm_id IS NOT NULL AND age IS NOT NULL AND n_labs + n_vitals > 0)) AS stage_fixes,
           coalesce(sum(dl), 0)::BIGINT AS dropped_labs, coalesce(sum(dv), 0)::BIGINT AS dropped_vitals,
           count(*) FILTER (coalesce(dl, 0) + coalesce(dv, 0) + coalesce(cv, 0) > 0 OR (age IS NOT NULL AND o2 IN ('nc: 2', 'bipap: 40'))) AS corrected_records {more}
    FROM rec r LEFT JOIN l ON r.study_id = l.study_id LEFT JOIN v ON r.study_id = v.study_id"""


@check("A15_pass_statistics", views=RECORD_VIEWS, sql=A15_SQL.format(more=""))
def _(spark, sf):
    return passes.first_pass_statistics(passes.first_pass(records(spark, sf))).drop("label_fixes")


# one line in nine is cut short, one in ten is blank
@check("A15_file_statistics", views=RECORD_VIEWS, sql=A15_SQL.format(more=""", (SELECT count(*) FROM rec WHERE study_id % 9 = 4) AS errors,
           (SELECT count(*) FROM rec WHERE study_id % 9 = 4) AS dropped_records""") + " WHERE r.study_id % 9 <> 4")
def _(spark, sf):
    path = scratch_dir(spark, "records")
    line = F.to_json(F.struct("*"))
    cut = F.when(F.col("study_id") % 9 == 4, F.substring(line, 1, 40)).otherwise(line)
    records(spark, sf).select(F.concat(cut, F.when(F.col("study_id") % 10 == 0, "\n").otherwise("")).alias("value")).write.text(path)
    read = files.read_jsonl(spark, path, records(spark, sf).schema, bad_records=True)
    return passes.file_pass_statistics(read).drop("label_fixes")


@check("C20_first_pass")
def _(spark, sf):
    out = passes.finish_first_pass(passes.first_pass(records(spark, sf)))
    return out.select("study_id", "stage", "image_path", "impression", F.to_json("patient_data").alias("patient_data"))


@check("C20_full_pass")
def _(spark, sf):
    out = passes.full_pass(records(spark, sf))
    return out.select("study_id", "stage", F.to_json("patient_data").alias("patient_data"),
                      F.to_json("icd_labels").alias("icd_labels"), F.to_json("data_quality").alias("data_quality"))


# the full pass in long form: what each step leaves of labs, vitals, labels, codes and the record

PASS_SQL = f"""
    WITH canon AS (SELECT * FROM (VALUES {_CANON}) AS t(pos, name, canonical_name, target, low, high)),
    kept AS (SELECT r.study_id, r.lab, r.value, r.unit, c.low, c.high FROM rec_labs r JOIN canon c ON c.name = r.lab
             WHERE NOT (lab = 'PT' AND value NOT BETWEEN 5 AND 50) AND NOT (lab = 'BUN' AND value > 200) AND NOT (lab = 'BNP' AND value > 100000)),
    pt AS (SELECT study_id, value AS pt FROM kept WHERE lab = 'PT'),
    lab AS (SELECT k.*, value BETWEEN low AND high AS normal_range, value < low - 0.5 * (high - low) OR value > high + 0.5 * (high - low) AS suspect
            FROM kept k LEFT JOIN pt ON k.study_id = pt.study_id
            WHERE NOT (lab = 'BNP' AND value = 100000) AND NOT (lab = 'BUN' AND value = 200) AND NOT (lab = 'INR' AND value > 5 AND coalesce(pt, 0) > 30)),
    staged AS (SELECT *, CASE WHEN stage = 'B' AND NOT (hadm_id IS NOT NULL AND age IS NOT NULL AND n_labs + n_vitals > 0) THEN 'A' ELSE stage END AS by_content FROM rec),
    done AS (SELECT *, CASE WHEN age IS NOT NULL AND by_content = 'A' THEN 'B' WHEN age IS NULL AND by_content = 'B' THEN 'A' ELSE by_content END AS last_stage FROM staged)"""
_LABELS_SQL = f"""
    WITH first AS ({_l4_sql(0)}), {IMPRESSION_SQL},
    told AS (SELECT f.study_id, label, value, lower(coalesce(impression, '')) AS low FROM first f JOIN imp i ON f.study_id = i.study_id),
    denied AS (SELECT study_id, label, CASE {L3_CASES} ELSE value END AS value FROM told)"""


def full(spark, sf):
    # stored, so that Spark does not copy the pass into the filters of each explode
    return files.stored(passes.full_pass(records(spark, sf)), "passed")


@check("C20_full_pass_labs", views=RECORD_VIEWS, sql=f"""{PASS_SQL}
    SELECT study_id, lab, value, unit, low, high, normal_range, suspect, -4.0::DOUBLE AS delta_hours FROM lab""")
def _(spark, sf):
    rows = full(spark, sf).select("study_id", F.explode("patient_data.Labs").alias("lab", "v"))
    return rows.select("study_id", "lab", "v.value", "v.unit", F.col("v.ref_low").alias("low"), F.col("v.ref_high").alias("high"), "v.normal_range",
                       F.col("v.value_is_suspect").alias("suspect"), "v.delta_hours")


@check("C20_full_pass_vitals", views=RECORD_VIEWS, sql=f"""
    WITH {REC_WIDE}, m AS (SELECT *, cm * 0.01::DOUBLE AS m, kg * 0.453592::DOUBLE AS real_kg FROM w),
    v AS (SELECT study_id, 'temperature_c' AS vital, round((f - 32) * 5 / 9, 1) AS value, '°C' AS unit FROM m
          UNION ALL SELECT study_id, 'height', round(m, 6), 'm' FROM m UNION ALL SELECT study_id, 'weight', round(real_kg, 6), 'kg' FROM m
          UNION ALL SELECT study_id, 'BMI', round(real_kg / (m * m), 2), 'kg/m²' FROM m
          UNION ALL SELECT study_id, vital, value, unit FROM rec_vitals WHERE vital = 'respiratory_rate' AND value <> 0)
    SELECT *, CASE WHEN vital = 'BMI' THEN 'recalculated' END AS source, -2.0::DOUBLE AS delta_hours FROM v""")
def _(spark, sf):
    rows = full(spark, sf).select("study_id", F.explode("patient_data.Vitals").alias("vital", "v"))
    return rows.select("study_id", "vital", F.round("v.value", 6).alias("value"), "v.unit", "v.source", "v.delta_hours")


@check("C20_full_pass_labels", views=("reports", "finding_rows"), sql=f"""{_LABELS_SQL}
    SELECT study_id, label, CASE WHEN value = -1 THEN 0 ELSE value END::INT AS value FROM denied""")
def _(spark, sf):
    return full(spark, sf).select("study_id", F.explode("chexpert_labels").alias("label", "value"))


@check("C20_full_pass_codes", views=RECORD_VIEWS + ("reports", "finding_rows"), sql=f"""{PASS_SQL}, l AS ({_LABELS_SQL} SELECT * FROM denied),
    c AS (SELECT study_id, CASE condition WHEN 'hypertension' THEN 'I10' ELSE 'E11.9' END AS code, condition AS description, 0.8::DOUBLE AS confidence
          FROM done WHERE last_stage = 'B' AND age IS NOT NULL AND condition IN ('hypertension', 'diabetes')
          UNION ALL
          SELECT d.study_id, CASE label WHEN 'Pneumonia' THEN 'J18.9' WHEN 'Pleural Effusion' THEN 'J94.8' WHEN 'Pneumothorax' THEN 'J93.9' ELSE 'J81.1' END,
                 CASE label WHEN 'Pleural Effusion' THEN 'Pleural effusion' WHEN 'Edema' THEN 'Pulmonary edema' ELSE label END,
                 CASE label WHEN 'Edema' THEN 0.8::DOUBLE ELSE 0.9::DOUBLE END
          FROM done d JOIN l ON d.study_id = l.study_id
          WHERE d.last_stage = 'B' AND l.value = 1 AND label IN ('Pneumonia', 'Pleural Effusion', 'Pneumothorax', 'Edema'))
    SELECT * FROM c""")
def _(spark, sf):
    return full(spark, sf).select("study_id", F.explode("icd_labels").alias("c")).select("study_id", "c.code", "c.description", "c.confidence")


@check("C20_full_pass_records", views=RECORD_VIEWS, sql=f"""{PASS_SQL}, s AS (SELECT study_id, bool_or(suspect) AS suspect FROM lab GROUP BY 1)
    SELECT d.study_id, last_stage AS stage, age, CASE WHEN age IS NOT NULL THEN sex END AS sex, CASE WHEN age IS NOT NULL THEN hadm_id END AS hadm_id,
           CASE WHEN age IS NOT NULL THEN condition END AS condition, CASE WHEN age IS NOT NULL THEN CASE WHEN o2 = 'bipap: 40' THEN 'BiPAP' ELSE 'unknown' END END AS device,
           CASE WHEN age IS NOT NULL AND o2 = 'nc: 2' THEN 2.0::DOUBLE END AS flow_lpm, CASE WHEN age IS NOT NULL AND o2 = 'bipap: 40' THEN 0.4::DOUBLE END AS fio2,
           age IS NOT NULL AS has_ehr_data, coalesce(s.suspect, false) AS has_suspect_values
    FROM done d LEFT JOIN s ON d.study_id = s.study_id""")
def _(spark, sf):
    p, q = F.col("patient_data"), F.col("data_quality")
    # not stored: nothing is exploded, and what is not asked for is not worked out
    return passes.full_pass(records(spark, sf)).select(
        "study_id", "stage", p["Age"].alias("age"), p["Sex"].alias("sex"), p["hadm_id"].alias("hadm_id"), F.get(p["Chronic_conditions"], 0).alias("condition"),
        p["O2_device"]["device"].alias("device"), p["O2_device"]["flow_lpm"].alias("flow_lpm"), p["O2_device"]["fio2"].alias("fio2"),
        q["has_ehr_data"].alias("has_ehr_data"), q["has_suspect_values"].alias("has_suspect_values"))
