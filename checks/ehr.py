"""Patient context operators: J5-J9, A1, A3-A10, A13, C1-C3, C16, W6."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.bindings import view
from checks.registry import check
from clinprep import vocab
from clinprep.functions import measure
from clinprep.functions.exprs import micros
from clinprep.operators import ehr, profile
from clinprep.plans.context import build_context

LAB_IDS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
LAB_ITEMS = {0: "BNP", 1: "Platelet Count", 2: "BUN", 3: "WBC Count", 4: "INR", 5: "CRP", 6: "Chloride"}
CHART_NAMES = ["heart_rate", "o2_saturation", "respiratory_rate", "temperature_f"]

LAST_ADMISSION = """
    SELECT hadm_id, subject_id, admittime, dischtime, admission_type FROM (
        SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY admittime DESC, hadm_id DESC) AS rn
        FROM admissions) x WHERE rn = 1"""
# extraction-time unit rules, written out once for the SQL side
CHECKED_LABS = """
    SELECT * REPLACE (CASE WHEN lab = 'Platelet Count' AND lower(valueuom) = 'm/ul' THEN valuenum * 1000
                           WHEN lab = 'CRP' AND valueuom = 'mg/dL' THEN valuenum * 10 ELSE valuenum END AS valuenum,
                      CASE WHEN valuenum IS NULL THEN valueuom
                           WHEN lab = 'Platelet Count' AND lower(valueuom) = 'm/ul' THEN 'K/uL'
                           WHEN lab = 'CRP' AND valueuom = 'mg/dL' THEN 'mg/L' ELSE valueuom END AS valueuom)
    FROM named WHERE valuenum IS NULL OR NOT (
        (lab = 'BNP' AND valueuom = 'mg/dL') OR (lab = 'BUN' AND valueuom = 'mEq/L')
        OR (lab = 'WBC Count' AND valueuom = '%') OR (lab = 'INR' AND valueuom = 'K/uL')
        OR (lab = 'Platelet Count' AND lower(valueuom) = 'm/ul' AND valuenum >= 1))"""
NAMED_LABS = "SELECT e.*, i.lab FROM labevents e JOIN lab_items i ON e.itemid = i.itemid"
PLAUSIBLE = """
    (vital <> 'respiratory_rate' OR valuenum <> 0) AND (vital <> 'o2_saturation' OR valuenum BETWEEN 0 AND 100)
    AND (vital <> 'heart_rate' OR valuenum BETWEEN 20 AND 300) AND (vital <> 'temperature_f' OR valuenum BETWEEN 86 AND 113)"""


def named_labs(spark, sf):
    return ehr.name_items(view(spark, sf, "labevents"), LAB_ITEMS, "lab")


# --- demographics, admissions -------------------------------------------------

@check("J5_demographics", views=("patients", "studies"), sql="""
    SELECT s.study_id, s.subject_id, CASE WHEN p.gender = 'M' THEN 'M' ELSE 'F' END AS sex,
           nullif(p.anchor_age, 0) AS age
    FROM studies s JOIN patients p ON s.subject_id = p.subject_id""")
def _(spark, sf):
    out = ehr.demographics(view(spark, sf, "studies"), view(spark, sf, "patients"), as_recorded=False)
    return out.select("study_id", "subject_id", "sex", "age")


@check("A1_latest_admission", views=("admissions",), sql=f"""
    WITH last AS ({LAST_ADMISSION})
    SELECT subject_id, hadm_id, epoch_us(admittime) AS admit_us, admission_type FROM last""")
def _(spark, sf):
    out = ehr.latest_admission(view(spark, sf, "admissions"))
    return out.select("subject_id", "hadm_id", micros("admittime").alias("admit_us"), "admission_type")


# --- windows ------------------------------------------------------------------

@check("J6_window_study", views=("studies", "chartevents"), sql="""
    WITH j AS (SELECT s.study_id, c.vital, c.event_id, c.valuenum,
                      row_number() OVER (PARTITION BY s.study_id, c.vital ORDER BY c.charttime DESC, c.event_id DESC) AS rn
               FROM studies s JOIN chartevents c ON s.subject_id = c.subject_id
                AND c.charttime BETWEEN s.study_time - INTERVAL 7 DAY AND s.study_time)
    SELECT study_id, vital, event_id, valuenum FROM j WHERE rn = 1""")
def _(spark, sf):
    out = ehr.at_study(view(spark, sf, "studies"), view(spark, sf, "chartevents"), "vital", CHART_NAMES,
                       vocab.VITAL_LOOKBACK_DAYS * ehr.DAY, ["event_id"], ["event_id", "valuenum"])
    return out.select("study_id", "vital", "event_id", "valuenum")


@check("J6_window_study_48h", views=("studies", "chartevents"), sql="""
    WITH j AS (SELECT s.study_id, c.vital, c.event_id,
                      row_number() OVER (PARTITION BY s.study_id, c.vital ORDER BY c.charttime DESC, c.event_id DESC) AS rn
               FROM studies s JOIN chartevents c ON s.subject_id = c.subject_id
                AND c.charttime BETWEEN s.study_time - INTERVAL 48 HOUR AND s.study_time)
    SELECT study_id, vital AS lab, event_id FROM j WHERE rn = 1""")
def _(spark, sf):
    events = view(spark, sf, "chartevents").withColumnRenamed("vital", "lab")
    out = ehr.at_study(view(spark, sf, "studies"), events, "lab", CHART_NAMES,
                       vocab.LAB_LOOKBACK_HOURS * ehr.HOUR, ["event_id"], ["event_id"])
    return out.select("study_id", "lab", "event_id")


@check("J6_window_admission", views=("labevents", "admissions"), sql=f"""
    WITH last AS ({LAST_ADMISSION})
    SELECT e.l_orderkey, e.l_linenumber, e.l_partkey, e.l_suppkey, e.subject_id, a.hadm_id
    FROM labevents e JOIN last a ON e.subject_id = a.subject_id
    WHERE e.charttime BETWEEN a.admittime AND a.dischtime""")
def _(spark, sf):
    out = ehr.in_admission(view(spark, sf, "labevents"), view(spark, sf, "admissions"))
    return out.select(*LAB_IDS, "subject_id", "hadm_id")


@check("J6_window_admission_open", views=("labevents", "admissions"), sql=f"""
    WITH last AS ({LAST_ADMISSION})
    SELECT a.hadm_id, count(*) AS n, min(epoch_us(e.charttime)) AS first_us, max(epoch_us(e.charttime)) AS last_us
    FROM labevents e JOIN last a ON e.subject_id = a.subject_id
    WHERE e.charttime >= a.admittime - INTERVAL 30 DAY GROUP BY a.hadm_id""")
def _(spark, sf):
    out = ehr.in_admission(view(spark, sf, "labevents"), view(spark, sf, "admissions"),
                           vocab.ADMISSION_BEFORE_DAYS, None)
    time = micros("charttime")
    return out.groupBy("hadm_id").agg(F.count("*").alias("n"), F.min(time).alias("first_us"), F.max(time).alias("last_us"))


@check("J6_window_recent", views=("labevents",), sql="""
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM labevents
    WHERE charttime >= TIMESTAMP '1998-01-01 00:00:00' - INTERVAL 90 DAY""")
def _(spark, sf):
    as_of = F.lit("1998-01-01 00:00:00").cast("timestamp")
    return ehr.recent(view(spark, sf, "labevents"), as_of).select(*LAB_IDS)


# --- item dictionaries --------------------------------------------------------

@check("J7_item_names", views=("labevents", "lab_items"), sql=f"""
    WITH named AS ({NAMED_LABS})
    SELECT lab, count(*) AS n, count(valuenum) AS n_numeric FROM named GROUP BY lab""")
def _(spark, sf):
    out = ehr.join_items(view(spark, sf, "labevents"), view(spark, sf, "lab_items"))
    return out.groupBy("lab").agg(F.count("*").alias("n"), F.count("valuenum").alias("n_numeric"))


@check("J7_item_names_fixed", views=("labevents", "lab_items"), sql=f"""
    WITH named AS ({NAMED_LABS}) SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, lab FROM named""")
def _(spark, sf):
    return named_labs(spark, sf).select(*LAB_IDS, "lab")


J8_SQL = """
    WITH p AS (SELECT * FROM (VALUES
        (0, 'heart_rate', 'heart.*rate'), (1, 'respiratory_rate', 'respiratory.*rate'),
        (2, 'o2_saturation', 'spo2|o2.*saturation'),
        (3, 'systolic_bp', 'systolic.*blood.*pressure|art.*bp.*systolic|arterial.*blood.*pressure.*systolic'),
        (4, 'diastolic_bp', 'diastolic.*blood.*pressure|art.*bp.*diastolic|arterial.*blood.*pressure.*diastolic'),
        (5, 'mean_bp', 'mean.*arterial|blood.*pressure.*mean|arterial.*blood.*pressure.*mean'),
        (6, 'temperature_c', 'temperature.*c'), (7, 'temperature_f', 'temperature.*f'),
        (8, 'weight', 'weight'), (9, 'height', 'height')) AS t(pos, vital, pattern))
    SELECT itemid, arg_max(vital, pos) AS vital FROM vital_labels, p
    WHERE regexp_matches(lower(label), pattern) GROUP BY itemid"""


@check("J8_item_patterns", views=("vital_labels",), sql=J8_SQL)
def _(spark, sf):
    return ehr.vital_items(view(spark, sf, "vital_labels"))


# --- vitals -------------------------------------------------------------------

@check("C2_vital_limits", views=("chartevents",), sql=f"""
    SELECT event_id, vital, valuenum FROM chartevents WHERE source <> 'ICU' OR ({PLAUSIBLE})""")
def _(spark, sf):
    return ehr.plausible_vitals(view(spark, sf, "chartevents")).select("event_id", "vital", "valuenum")


def _pick_sql(order: str) -> str:
    return f"""
    WITH j AS (SELECT *, row_number() OVER (PARTITION BY subject_id, vital ORDER BY charttime {order}, event_id {order}) AS rn
               FROM chartevents WHERE source = 'ICU' AND ({PLAUSIBLE}))
    SELECT subject_id, vital, event_id, valuenum FROM j WHERE rn = 1"""


def _icu(spark, sf, pick):
    icu = view(spark, sf, "chartevents").where(F.col("source") == "ICU")
    return ehr.pick_vitals(ehr.plausible_vitals(icu), ["subject_id"], "event_id", pick).select(
        "subject_id", "vital", "event_id", "valuenum")


@check("A3_icu_vitals_oldest", views=("chartevents",), sql=_pick_sql("ASC"))
def _(spark, sf):
    return _icu(spark, sf, "oldest")


@check("A3_icu_vitals_latest", views=("chartevents",), sql=_pick_sql("DESC"))
def _(spark, sf):
    return _icu(spark, sf, "latest")


@check("A3_icu_vitals_oldest_in_window", views=("studies", "chartevents"), sql=f"""
    WITH j AS (SELECT s.study_id, c.vital, c.event_id,
                      row_number() OVER (PARTITION BY s.study_id, c.vital ORDER BY c.charttime, c.event_id) AS rn
               FROM studies s JOIN chartevents c ON s.subject_id = c.subject_id
                AND c.charttime BETWEEN s.study_time - INTERVAL 7 DAY AND s.study_time
               WHERE c.source = 'ICU' AND ({PLAUSIBLE}))
    SELECT study_id, vital, event_id FROM j WHERE rn = 1""")
def _(spark, sf):
    icu = ehr.plausible_vitals(view(spark, sf, "chartevents").where(F.col("source") == "ICU"))
    out = ehr.at_study(view(spark, sf, "studies"), icu, "vital", CHART_NAMES,
                       vocab.VITAL_LOOKBACK_DAYS * ehr.DAY, ["event_id"], ["event_id"], pick="oldest")
    return out.select("study_id", "vital", "event_id")


@check("A4_ward_outpatient_vitals", views=("chartevents",), sql="""
    WITH t AS (SELECT subject_id, vital, source, event_id, charttime,
                      CASE WHEN event_id % 4 = 0 THEN NULL ELSE valuenum END AS valuenum,
                      CASE WHEN event_id % 4 = 0 THEN 'text ' || CAST(event_id AS VARCHAR) END AS value_text
               FROM chartevents WHERE source <> 'ICU'),
         j AS (SELECT *, row_number() OVER (PARTITION BY subject_id, source, vital ORDER BY charttime DESC, event_id DESC) AS rn FROM t)
    SELECT subject_id, source, vital, event_id, valuenum, value_text FROM j WHERE rn = 1""")
def _(spark, sf):
    events = view(spark, sf, "chartevents").where(F.col("source") != "ICU")
    raw = F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("text "), F.col("event_id").cast("string"))).otherwise(
        F.col("valuenum").cast("string"))
    mixed = ehr.numeric_or_text(events.withColumn("value", raw).drop("valuenum"))
    out = ehr.pick_vitals(mixed.withColumnRenamed("source", "place"), ["subject_id", "place"], "event_id")
    return out.select("subject_id", F.col("place").alias("source"), "vital", "event_id", "valuenum", "value_text")


@check("A5_source_priority", views=("chartevents",), sql=f"""
    WITH j AS (SELECT *, row_number() OVER (PARTITION BY subject_id, vital
                 ORDER BY CASE source WHEN 'ICU' THEN 0 WHEN 'Ward' THEN 1 ELSE 2 END, charttime DESC, event_id DESC) AS rn
               FROM chartevents WHERE source <> 'ICU' OR ({PLAUSIBLE}))
    SELECT subject_id, vital, source, event_id, valuenum FROM j WHERE rn = 1""")
def _(spark, sf):
    out = ehr.merge_vital_sources(ehr.plausible_vitals(view(spark, sf, "chartevents")), ["subject_id"], "event_id")
    return out.select("subject_id", "vital", "source", "event_id", "valuenum")


@check("C3_derived_vitals", views=("chartevents",), sql="""
    WITH t AS (SELECT subject_id, CASE vital WHEN 'heart_rate' THEN 'weight' WHEN 'o2_saturation' THEN 'height'
                      WHEN 'respiratory_rate' THEN 'systolic_bp' ELSE 'diastolic_bp' END AS vital, valuenum, charttime, event_id FROM chartevents),
         l AS (SELECT subject_id, vital, arg_max(valuenum, (charttime, event_id)) AS v FROM t GROUP BY ALL),
         w AS (SELECT subject_id, max(v) FILTER (vital = 'weight') AS w, max(v) FILTER (vital = 'height') AS h,
                      max(v) FILTER (vital = 'systolic_bp') AS s, max(v) FILTER (vital = 'diastolic_bp') AS d FROM l GROUP BY 1)
    SELECT subject_id, round(w / ((CASE WHEN h < 3 THEN h * CAST(2.54 AS DOUBLE) ELSE h END / 100) * (CASE WHEN h < 3 THEN h * CAST(2.54 AS DOUBLE) ELSE h END / 100)), 1) AS bmi,
           CAST(CAST(trunc(s) AS BIGINT) AS VARCHAR) || '/' || CAST(CAST(trunc(d) AS BIGINT) AS VARCHAR) AS blood_pressure FROM w""")
def _(spark, sf):
    names = {"heart_rate": "weight", "o2_saturation": "height", "respiratory_rate": "systolic_bp", "temperature_f": "diastolic_bp"}
    events = view(spark, sf, "chartevents").replace(names, subset="vital")
    return ehr.derived_vitals(ehr.pick_vitals(events, ["subject_id"], "event_id"), ["subject_id"])


@check("C16_time_offset", views=("studies", "chartevents"), sql="""
    WITH j AS (SELECT s.study_id, s.study_time, c.vital, c.charttime,
                      row_number() OVER (PARTITION BY s.study_id, c.vital ORDER BY c.charttime DESC, c.event_id DESC) AS rn
               FROM studies s JOIN chartevents c ON s.subject_id = c.subject_id
                AND c.charttime BETWEEN s.study_time - INTERVAL 7 DAY AND s.study_time)
    SELECT study_id, vital, round((epoch_us(charttime) - epoch_us(study_time)) / CAST(3600000000 AS DOUBLE), 4) AS delta_hours
    FROM j WHERE rn = 1""")
def _(spark, sf):
    out = ehr.at_study(view(spark, sf, "studies"), view(spark, sf, "chartevents").withColumn("event_time", F.col("charttime")),
                       "vital", CHART_NAMES, vocab.VITAL_LOOKBACK_DAYS * ehr.DAY, ["event_id"], ["event_time"])
    return out.select("study_id", "vital", F.round(
        ehr.hours_from_study(F.col("event_time"), F.col("study_time")), 4).alias("delta_hours"))


# --- labs ---------------------------------------------------------------------

@check("C1_extraction_lab_rules", views=("labevents", "lab_items"), sql=f"""
    WITH named AS ({NAMED_LABS}), checked AS ({CHECKED_LABS})
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, lab, round(valuenum, 6) AS valuenum, valueuom,
           CASE WHEN ref_range_upper IS NOT NULL AND valuenum IS NOT NULL
                THEN CAST(ref_range_lower AS VARCHAR) || '-' || CAST(ref_range_upper AS VARCHAR) END AS reference_range,
           CASE WHEN ref_range_upper IS NOT NULL THEN valuenum BETWEEN ref_range_lower AND ref_range_upper END AS normal_range
    FROM checked""")
def _(spark, sf):
    out = ehr.checked_labs(named_labs(spark, sf))
    return out.select(*LAB_IDS, "lab", F.round("valuenum", 6).alias("valuenum"), "valueuom", "reference_range", "normal_range")


@check("A7_latest_valid_lab", views=("labevents", "lab_items", "admissions"), sql=f"""
    WITH named AS ({NAMED_LABS}), checked AS ({CHECKED_LABS}), last AS ({LAST_ADMISSION}),
         j AS (SELECT c.*, a.hadm_id, row_number() OVER (PARTITION BY c.subject_id, c.lab
                 ORDER BY c.charttime DESC, c.l_orderkey DESC, c.l_linenumber DESC, c.l_partkey DESC, c.l_suppkey DESC) AS rn
               FROM checked c JOIN last a ON c.subject_id = a.subject_id
               WHERE c.charttime BETWEEN a.admittime AND a.dischtime)
    SELECT subject_id, hadm_id, lab, round(valuenum, 6) AS valuenum, valueuom, epoch_us(charttime) AS chart_us FROM j WHERE rn = 1""")
def _(spark, sf):
    return _latest_labs(spark, sf).select(
        "subject_id", "hadm_id", "lab", F.round("valuenum", 6).alias("valuenum"), "valueuom",
        micros("charttime").alias("chart_us"))


def _latest_labs(spark, sf):
    """The flagship composition: name, window, check, reduce."""
    window = ehr.in_admission(named_labs(spark, sf), view(spark, sf, "admissions"))
    labs = ehr.checked_labs(window.drop("admittime", "dischtime", "admission_type"))
    return ehr.latest_labs(labs, ["subject_id"], LAB_IDS)


# --- oxygen, diagnoses --------------------------------------------------------

def _oxygen_events(spark, sf):
    kind = F.when(F.col("event_id") % 2 == 0, "Oxygen_Device").when(F.col("event_id") % 3 == 0, "Oxygen_Device_Flow")
    return view(spark, sf, "chartevents").select(
        "subject_id", "event_id", "charttime", kind.alias("device_type"), F.col("vital").alias("value"))


OXYGEN = """SELECT subject_id, event_id, charttime, coalesce(CASE WHEN event_id % 2 = 0 THEN 'Oxygen_Device'
            WHEN event_id % 3 = 0 THEN 'Oxygen_Device_Flow' END, 'Unknown') || ': ' || vital AS o2_device FROM chartevents"""


@check("A8_latest_oxygen", views=("chartevents",), sql=f"""
    WITH o AS ({OXYGEN}) SELECT subject_id, arg_max(o2_device, (charttime, event_id)) AS o2_device FROM o GROUP BY 1""")
def _(spark, sf):
    return ehr.latest_oxygen(_oxygen_events(spark, sf), ["subject_id"], "event_id")


GROUP_ROWS = ", ".join(
    f"('{name}', '{p}')" for name, ps in {**vocab.ACUTE_CODES, **vocab.CHRONIC_CODES}.items() for p in ps)
FLAG_NAMES = [*vocab.ACUTE_CODES, *vocab.CHRONIC_CODES]


@check("J9_code_groups", views=("diagnoses",), sql=f"""
    WITH g AS (SELECT * FROM (VALUES {GROUP_ROWS}) AS t(condition, prefix))
    SELECT DISTINCT d.hadm_id, d.icd_code, g.condition FROM diagnoses d JOIN g
    ON starts_with(replace(d.icd_code, '.', ''), replace(g.prefix, '.', ''))""")
def _(spark, sf):
    hits = F.array_compact(F.array(*[F.when(ehr.has_condition(F.col("conditions"), i), F.lit(n)) for i, n in enumerate(ehr.condition_names())]))
    return ehr.condition_masks(view(spark, sf, "diagnoses")).select("hadm_id", "icd_code", F.explode(hits).alias("condition")).distinct()


def _flags_sql(clean: str) -> str:
    cols = ", ".join(f"coalesce(bool_or(g.condition = '{n}'), false) AS {n}" for n in FLAG_NAMES)
    return f"""
    WITH g AS (SELECT * FROM (VALUES {GROUP_ROWS}) AS t(condition, prefix))
    SELECT d.hadm_id, {cols} FROM diagnoses d LEFT JOIN g ON starts_with({clean.format('d.icd_code')}, {clean.format('g.prefix')})
    GROUP BY d.hadm_id"""


@check("A6_condition_flags", views=("diagnoses",), sql=_flags_sql("replace({}, '.', '')"))
def _(spark, sf):
    return ehr.condition_flags(view(spark, sf, "diagnoses"), ["hadm_id"])


@check("A6_condition_flags_dotted", views=("diagnoses",), sql=_flags_sql("{}"))
def _(spark, sf):
    return ehr.condition_flags(view(spark, sf, "diagnoses"), ["hadm_id"], strip_dots=False)


@check("A10_chronic_conditions", views=("diagnoses",), sql=f"""
    WITH g AS (SELECT * FROM (VALUES {", ".join(f"('{n}', '{p}')" for n, ps in vocab.CHRONIC_CODES.items() for p in ps)}) AS t(condition, prefix))
    SELECT DISTINCT d.hadm_id, g.condition FROM diagnoses d JOIN g ON starts_with(replace(d.icd_code, '.', ''), replace(g.prefix, '.', ''))""")
def _(spark, sf):
    flags = ehr.condition_flags(view(spark, sf, "diagnoses"), ["hadm_id"])
    return flags.select("hadm_id", F.explode(ehr.chronic_conditions()).alias("condition"))


# --- context ------------------------------------------------------------------

VITAL_NAMES = [*CHART_NAMES, "weight", "height", "systolic_bp", "diastolic_bp"]


def context(spark, sf):
    """A9 over studies with and without a time, admissions with and without a discharge."""
    charted = view(spark, sf, "chartevents").where("source <> 'OMR'").withColumn("unit", F.lit("unknown")).withColumn("value_text", F.lit(None).cast("string"))
    clinic = ehr.outpatient_vitals(view(spark, sf, "omr")).select(
        "event_id", "subject_id", "vital", "source", "valuenum", "charttime", "unit", "value_text")
    return build_context(
        view(spark, sf, "context_studies"), view(spark, sf, "patients"), view(spark, sf, "open_admissions"),
        charted.unionByName(clinic), named_labs(spark, sf), _oxygen_events(spark, sf), view(spark, sf, "diagnoses"),
        VITAL_NAMES, list(LAB_ITEMS.values()), LAB_IDS, as_of=F.lit("2024-03-20").cast("timestamp_ntz"))


CONTEXT_VIEWS = ("context_studies", "patients", "admissions", "open_admissions", "chartevents", "omr", "labevents", "lab_items", "diagnoses")
# each measurement beside each study of its subject, kept by the window of its kind
CONTEXT_CTES = f"""
    named AS ({NAMED_LABS}), checked AS ({CHECKED_LABS}), last AS ({LAST_ADMISSION.replace("FROM admissions", "FROM open_admissions")}),
    base AS (SELECT s.study_id, s.subject_id, s.study_time, p.gender AS sex, p.anchor_age AS age, a.hadm_id, a.admission_type, a.admittime, a.dischtime
             FROM context_studies s JOIN patients p ON s.subject_id = p.subject_id LEFT JOIN last a ON s.subject_id = a.subject_id),
    v AS (SELECT event_id, subject_id, vital, source, valuenum, NULL AS txt, charttime FROM chartevents WHERE source = 'Ward' OR (source = 'ICU' AND {PLAUSIBLE})
          UNION ALL SELECT event_id, subject_id, CASE result_name WHEN 'Weight' THEN 'weight' WHEN 'Height' THEN 'height' WHEN 'Systolic Blood Pressure' THEN 'systolic_bp'
                ELSE 'diastolic_bp' END, 'OMR', try_cast(result_value AS DOUBLE), CASE WHEN try_cast(result_value AS DOUBLE) IS NULL THEN result_value END, chartdate::TIMESTAMP
          FROM omr WHERE result_name <> 'eGFR'),
    vit AS (SELECT * FROM (SELECT b.study_id, c.vital, c.valuenum, c.txt, c.source, c.charttime,
                row_number() OVER (PARTITION BY b.study_id, c.vital ORDER BY CASE c.source WHEN 'ICU' THEN 0 WHEN 'Ward' THEN 1 ELSE 2 END, c.charttime DESC, c.event_id DESC) AS rn
            FROM base b JOIN v c ON b.subject_id = c.subject_id AND CASE
                WHEN c.source = 'OMR' THEN CASE WHEN b.study_time IS NOT NULL THEN c.charttime::DATE BETWEEN (b.study_time - INTERVAL 7 DAY)::DATE AND b.study_time::DATE
                    WHEN b.admittime IS NOT NULL THEN c.charttime::DATE >= b.admittime::DATE ELSE true END
                WHEN b.study_time IS NOT NULL THEN c.charttime BETWEEN b.study_time - INTERVAL 7 DAY AND b.study_time
                WHEN b.admittime IS NOT NULL THEN c.charttime >= b.admittime - INTERVAL 30 DAY AND (b.dischtime IS NULL OR c.charttime <= b.dischtime + INTERVAL 7 DAY)
                ELSE c.charttime >= TIMESTAMP '2024-03-20' - INTERVAL 90 DAY END) x WHERE rn = 1),
    wide AS (SELECT study_id, max(valuenum) FILTER (vital = 'weight') AS w, max(valuenum) FILTER (vital = 'height') AS h,
                max(valuenum) FILTER (vital = 'systolic_bp') AS s, max(valuenum) FILTER (vital = 'diastolic_bp') AS d FROM vit GROUP BY 1),
    o AS ({OXYGEN}),
    oxy AS (SELECT b.study_id, arg_max(o.o2_device, (o.charttime, o.event_id)) AS o2_device FROM base b JOIN o ON b.subject_id = o.subject_id
            AND CASE WHEN b.study_time IS NOT NULL THEN o.charttime BETWEEN b.study_time - INTERVAL 24 HOUR AND b.study_time
                     WHEN b.admittime IS NOT NULL THEN o.charttime >= b.admittime ELSE true END GROUP BY 1),
    lab AS (SELECT * FROM (SELECT b.study_id, c.lab, c.valuenum, c.valueuom, c.charttime, row_number() OVER (PARTITION BY b.study_id, c.lab
                ORDER BY c.charttime DESC, c.l_orderkey DESC, c.l_linenumber DESC, c.l_partkey DESC, c.l_suppkey DESC) AS rn
            FROM checked c JOIN base b ON c.subject_id = b.subject_id AND CASE WHEN b.study_time IS NOT NULL THEN c.charttime BETWEEN b.study_time - INTERVAL 48 HOUR AND b.study_time
                     WHEN b.admittime IS NOT NULL THEN c.charttime >= b.admittime ELSE true END) x WHERE rn = 1),
    g AS (SELECT * FROM (VALUES {GROUP_ROWS}) AS t(condition, prefix)),
    flag AS (SELECT DISTINCT d.hadm_id, g.condition FROM diagnoses d JOIN g ON starts_with(replace(d.icd_code, '.', ''), replace(g.prefix, '.', ''))),
    rows_ AS (SELECT study_id, 'vital' AS kind, vital AS name, valuenum AS value, coalesce(source || '/' || txt, source) AS note, charttime AS at FROM vit
             UNION ALL SELECT study_id, 'vital', 'bmi', round(w / ((h * CASE WHEN h < 3 THEN 2.54 ELSE 1 END / 100) ^ 2), 1), 'calculated', NULL FROM wide WHERE w IS NOT NULL AND h > 0
             UNION ALL SELECT study_id, 'vital', 'blood_pressure', NULL, 'combined/' || s::BIGINT || '/' || d::BIGINT, NULL FROM wide WHERE s IS NOT NULL AND d IS NOT NULL
             UNION ALL SELECT study_id, 'lab', lab, valuenum, valueuom, charttime FROM lab
             UNION ALL SELECT study_id, 'oxygen', o2_device, NULL, NULL, NULL FROM oxy
             UNION ALL SELECT b.study_id, 'flag', f.condition, NULL, NULL, NULL FROM base b JOIN flag f ON b.hadm_id = f.hadm_id)"""


@check("A9_nested_context", views=CONTEXT_VIEWS, sql=f"""
    WITH {CONTEXT_CTES}
    SELECT b.study_id, b.subject_id, b.sex, b.age, b.hadm_id, b.admission_type, r.kind, r.name, round(r.value, 6) AS value, r.note
    FROM base b LEFT JOIN rows_ r ON b.study_id = r.study_id""")
def _(spark, sf):
    ctx = context(spark, sf)
    e = F.col("ehr_json")
    none = F.lit(None).cast("string")

    def cell(kind, name, value=F.lit(None).cast("double"), note=none):
        return F.struct(F.lit(kind).alias("kind"), name.alias("name"), value.alias("value"), note.alias("note"))

    rows = F.concat(
        F.transform(F.map_entries(e["Vitals"]), lambda v: cell("vital", v["key"], v["value"]["valuenum"], F.concat_ws("/", v["value"]["source"], v["value"]["value_text"]))),
        F.transform(F.map_entries(e["Labs"]), lambda v: cell("lab", v["key"], v["value"]["value"], v["value"]["unit"])),
        F.when(e["O2_device"].isNotNull(), F.array(cell("oxygen", e["O2_device"]))).otherwise(F.array().cast("array<struct<kind:string,name:string,value:double,note:string>>")),
        F.transform(F.filter(F.map_entries("icd_json"), lambda v: v["value"]), lambda v: cell("flag", v["key"])),
    )
    return ctx.select("study_id", "subject_id", e["Sex"].alias("sex"), e["Age"].alias("age"), e["hadm_id"].alias("hadm_id"),
                      e["admission_type"].alias("admission_type"), F.explode_outer(rows).alias("r")).select(
        "study_id", "subject_id", "sex", "age", "hadm_id", "admission_type", "r.kind", "r.name",
        F.round("r.value", 6).alias("value"), "r.note")


@check("A13_context_coverage", views=CONTEXT_VIEWS, sql=f"""
    WITH {CONTEXT_CTES}, t AS (SELECT count(*) AS n FROM base),
    m AS (SELECT kind AS metric, name, count(*) AS n FROM rows_ WHERE kind IN ('vital', 'lab', 'flag') GROUP BY 1, 2
          UNION ALL SELECT 'sex', sex, count(*) FROM base GROUP BY 2
          UNION ALL SELECT 'admission', 'any', count(hadm_id) FROM base
          UNION ALL SELECT 'oxygen', 'any', count(*) FROM oxy
          UNION ALL SELECT 'age', 'known', count(*) FROM base WHERE age > 0)
    SELECT metric, name, m.n, round(100.0::DOUBLE * m.n / t.n, 4) AS percent,
           CASE WHEN metric = 'age' THEN (SELECT round(avg(age), 4) FROM base WHERE age > 0) END AS mean,
           CASE WHEN metric = 'age' THEN (SELECT min(age)::BIGINT FROM base WHERE age > 0) END AS low,
           CASE WHEN metric = 'age' THEN (SELECT max(age)::BIGINT FROM base WHERE age > 0) END AS high
    FROM m, t""")
def _(spark, sf):
    return profile.context_coverage(context(spark, sf))


@check("W6_low_ehr", views=CONTEXT_VIEWS, sql=f"""
    WITH {CONTEXT_CTES}, c AS (SELECT study_id, count(*) FILTER (kind = 'vital') AS v, count(*) FILTER (kind = 'lab') AS l FROM rows_ GROUP BY 1)
    SELECT b.study_id, coalesce(c.v, 0) <= 2 AND coalesce(c.l, 0) <= 2 AS low_ehr FROM base b LEFT JOIN c ON b.study_id = c.study_id""")
def _(spark, sf):
    from clinprep.operators.corpus import is_low_ehr
    ctx = context(spark, sf)
    return ctx.select("study_id", is_low_ehr(F.col("ehr_json.Vitals"), F.col("ehr_json.Labs")).alias("low_ehr"))
