"""Binding views: the given tables seen in the shapes the operators work on.

Each view is one SELECT that means the same on Spark and on DuckDB; ``{name}`` stands for
a given table or another view. All views cover whole tables and whole texts.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]

VIEWS = {
    "patients": """
        SELECT c_custkey AS subject_id, CASE WHEN c_custkey % 2 = 0 THEN 'M' ELSE 'F' END AS gender,
               CAST(c_custkey % 90 AS INT) AS anchor_age FROM {customer}""",
    "admissions": """
        SELECT o_orderkey AS hadm_id, o_custkey AS subject_id, o_orderdate AS admittime,
               o_orderdate + INTERVAL '365' DAY AS dischtime, o_orderpriority AS admission_type
        FROM {orders}""",
    "labevents": """
        SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey, o.o_custkey AS subject_id,
               CAST(l.l_partkey % 8 AS INT) AS itemid,
               CASE WHEN l.l_suppkey % 11 = 0 THEN NULL
                    WHEN l.l_linenumber % 6 = 4 THEN l.l_discount * 20 ELSE l.l_quantity END AS valuenum,
               CASE CAST(l.l_linenumber % 6 AS INT) WHEN 1 THEN 'mg/dL' WHEN 2 THEN 'mEq/L' WHEN 3 THEN 'K/uL'
                    WHEN 4 THEN 'M/uL' WHEN 5 THEN '%' ELSE 'pg/mL' END AS valueuom,
               CAST(10 AS DOUBLE) AS ref_range_lower,
               CASE WHEN l.l_partkey % 3 = 0 THEN NULL ELSE CAST(30 AS DOUBLE) END AS ref_range_upper,
               l.l_shipdate AS charttime
        FROM {lineitem} l JOIN {orders} o ON l.l_orderkey = o.o_orderkey""",
    "lab_items": """
        SELECT * FROM (VALUES (0, 'BNP'), (1, 'Platelet Count'), (2, 'BUN'), (3, 'WBC Count'),
                              (4, 'INR'), (5, 'CRP'), (6, 'Chloride')) AS t(itemid, lab)""",
    "labs": """
        SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
               CASE CAST(l_partkey % 12 AS INT) WHEN 0 THEN 'BNP' WHEN 1 THEN 'Platelet Count' WHEN 2 THEN 'BUN'
                    WHEN 3 THEN 'WBC' WHEN 4 THEN 'INR' WHEN 5 THEN 'PTT' WHEN 6 THEN 'Chloride'
                    WHEN 7 THEN 'PT' WHEN 8 THEN 'CO2' WHEN 9 THEN 'Alkaline Phosphatase'
                    WHEN 10 THEN 'CRP' ELSE 'ALT' END AS lab_name,
               CASE WHEN l_suppkey % 17 = 0 THEN CAST(200 AS DOUBLE)
                    WHEN l_suppkey % 19 = 0 THEN CAST(100000 AS DOUBLE) ELSE l_quantity END AS value,
               CASE CAST(l_linenumber % 7 AS INT) WHEN 0 THEN 'mg/dL' WHEN 1 THEN 'mEq/L' WHEN 2 THEN 'K/uL'
                    WHEN 3 THEN 'sec' WHEN 4 THEN '%' WHEN 5 THEN 'm/uL' ELSE 'mmol/L' END AS unit,
               CAST(10 AS DOUBLE) AS ref_low, CAST(30 AS DOUBLE) AS ref_high
        FROM {lineitem}""",
    "clean_labs": """
        SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
               CASE CAST(l_partkey % 6 AS INT) WHEN 0 THEN 'BNP' WHEN 1 THEN 'BUN' WHEN 2 THEN 'ALT'
                    WHEN 3 THEN 'INR' WHEN 4 THEN 'PT' ELSE 'PLT' END AS lab_name,
               CASE WHEN l_suppkey % 17 = 0 THEN CAST(200 AS DOUBLE)
                    WHEN l_suppkey % 19 = 0 THEN CAST(100000 AS DOUBLE)
                    WHEN l_suppkey % 13 = 0 THEN CAST(3.334 AS DOUBLE) ELSE l_quantity END AS value,
               CAST(10 AS DOUBLE) AS ref_low, CAST(20 AS DOUBLE) AS ref_high
        FROM {lineitem}""",
    "studies": """
        SELECT event_id AS study_id, user_id AS subject_id, ts AS study_time
        FROM {events} WHERE event_type = 'signup'""",
    # a third of the studies without a time; outpatient results by date, some of them text
    "context_studies": """
        SELECT event_id AS study_id, user_id AS subject_id, CASE WHEN event_id % 3 <> 1 THEN ts END AS study_time
        FROM {events} WHERE event_type = 'signup'""",
    "omr": """
        SELECT event_id, user_id AS subject_id, CASE CAST(event_id % 5 AS INT) WHEN 0 THEN 'Weight' WHEN 1 THEN 'Height'
               WHEN 2 THEN 'Systolic Blood Pressure' WHEN 3 THEN 'Diastolic Blood Pressure' ELSE 'eGFR' END AS result_name,
               CASE WHEN event_id % 13 = 0 THEN 'refused' ELSE CAST(CAST(round(value) AS BIGINT) + 1 AS STRING) END AS result_value,
               CAST(ts AS DATE) AS chartdate
        FROM {events} WHERE event_type <> 'signup'""",
    # some stays have no discharge
    "open_admissions": """
        SELECT hadm_id, subject_id, CAST(admittime AS TIMESTAMP) + INTERVAL '8500' DAY AS admittime,
               CASE WHEN hadm_id % 4 <> 0 THEN CAST(dischtime AS TIMESTAMP) + INTERVAL '8500' DAY END AS dischtime, admission_type
        FROM {admissions}""",
    "chartevents": """
        SELECT event_id, user_id AS subject_id,
               CASE event_type WHEN 'error' THEN 'heart_rate' WHEN 'click' THEN 'o2_saturation'
                    WHEN 'view' THEN 'respiratory_rate' ELSE 'temperature_f' END AS vital,
               CASE CAST(event_id % 3 AS INT) WHEN 0 THEN 'ICU' WHEN 1 THEN 'Ward' ELSE 'OMR' END AS source,
               value AS valuenum, ts AS charttime
        FROM {events} WHERE event_type <> 'signup'""",
    "vitals": """
        SELECT event_id, user_id AS subject_id,
               CASE event_type WHEN 'error' THEN 'height' WHEN 'click' THEN 'weight' WHEN 'view' THEN 'temperature'
                    WHEN 'signup' THEN 'heart_rate' ELSE 'respiratory_rate' END AS vital,
               CASE WHEN event_type = 'purchase' AND event_id % 7 = 0 THEN CAST(0 AS DOUBLE) ELSE value END AS value,
               CASE event_type WHEN 'error' THEN CASE CAST(event_id % 3 AS INT) WHEN 0 THEN 'cm' WHEN 1 THEN 'inch' ELSE 'm' END
                    WHEN 'click' THEN CASE CAST(event_id % 3 AS INT) WHEN 0 THEN 'lbs' WHEN 1 THEN 'unknown' ELSE 'kg' END
                    WHEN 'view' THEN CASE WHEN event_id % 2 = 0 THEN 'F' ELSE 'C' END ELSE 'bpm' END AS unit
        FROM {events}""",
    "o2_text": """
        SELECT event_id, concat(CASE CAST(user_id % 5 AS INT) WHEN 0 THEN 'nc' WHEN 1 THEN 'bipap'
               WHEN 2 THEN 'Oxygen_Device' WHEN 3 THEN 'trach' ELSE 'none' END,
               CASE WHEN event_id % 4 = 3 THEN ' ' ELSE ': ' END, regexp_extract(props, '([0-9]+)', 1)) AS o2
        FROM {events}""",
    "d_items": "SELECT p_partkey AS itemid, lower(p_name) AS label FROM {part}",
    "vital_labels": """
        SELECT p_partkey AS itemid, concat(CASE CAST(p_partkey % 9 AS INT) WHEN 0 THEN 'Heart Rate '
               WHEN 1 THEN 'Respiratory Rate ' WHEN 2 THEN 'SpO2 ' WHEN 3 THEN 'Art BP Systolic '
               WHEN 4 THEN 'Temperature Celsius ' WHEN 5 THEN 'Temperature Fahrenheit '
               WHEN 6 THEN 'Daily Weight ' WHEN 7 THEN 'Mean Arterial Height ' ELSE '' END, p_name) AS label
        FROM {part}""",
    "diagnoses": """
        SELECT l_orderkey AS hadm_id, CASE CAST(l_partkey % 8 AS INT) WHEN 0 THEN 'J18.9' WHEN 1 THEN 'J93.0'
               WHEN 2 THEN 'I10' WHEN 3 THEN 'I50.9' WHEN 4 THEN 'E11.9' WHEN 5 THEN 'J810'
               WHEN 6 THEN 'S22.4' ELSE 'Z00' END AS icd_code,
               l_discount * 10 AS confidence
        FROM {lineitem}""",
    "reports": """
        SELECT doc_id AS study_id, source, concat('FINAL REPORT', chr(10), ' FINDINGS: ', chr(10), text, chr(10),
               CASE WHEN doc_id % 5 = 0 THEN '' ELSE concat(' IMPRESSION: ', chr(10),
               CASE CAST(doc_id % 4 AS INT) WHEN 0 THEN 'No pneumothorax. Dictated by Dr. '
                    WHEN 1 THEN 'Small pleural effusion, no edema. ' WHEN 2 THEN 'Pacemaker in place ___. [**Name**] '
                    ELSE 'Pneumonia is doubtful. No fracture. ' END, text) END) AS report
        FROM {documents}""",
    "label_rows": """
        SELECT doc_id AS study_id, 'quality' AS label, quality AS value FROM {labels}
        UNION ALL SELECT doc_id, 'toxic', toxic FROM {labels}""",
    "inventory": """
        SELECT doc_id AS study_id, concat('files/files/p', CAST(doc_id % 10 AS STRING), '/p',
               CAST(doc_id % 50 AS STRING), '/s', CAST(doc_id AS STRING), '/', md5(CAST(doc_id AS STRING)),
               CASE WHEN doc_id % 3 = 0 THEN '_lateral.dcm' ELSE '.dcm' END) AS path
        FROM {documents}""",
    "samples": """
        SELECT o_orderkey AS sample_id, o_custkey AS subject_id,
               CASE WHEN o_orderstatus = 'F' THEN 'A' ELSE 'B' END AS stage,
               o_orderpriority AS condition, CAST(o_orderkey % 4 AS INT) AS n_vitals,
               CAST(o_custkey % 5 AS INT) AS n_labs FROM {orders}""",
    "pairs": """
        SELECT a.conv_id, a.turn, a.text AS reference, b.text AS prediction
        FROM {conversations} a JOIN {conversations} b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1""",
    "generated": """
        SELECT conv_id AS study_id, turn, concat(CASE WHEN turn % 3 = 0 THEN '1) ' ELSE '' END, 'IMPRESSION: ', text,
               chr(10), chr(10), '2) CheXpert: {{"Edema": ', CAST(turn % 2 AS STRING),
               CASE WHEN conv_id % 4 = 0 THEN ',}}' ELSE '}}' END,
               CASE WHEN conv_id % 3 = 0 THEN '' WHEN conv_id % 3 = 1 THEN concat(chr(10), chr(10), '3) ICD: {{"Pneumonia": 1}}')
                    ELSE concat(chr(10), chr(10), '3) ICD: {{oops}}') END) AS output
        FROM {conversations}""",
}
# one row per finding beside every document: a row generator, written per dialect
FINDING_NAMES = [
    "No Finding", "Edema", "Pneumonia", "Pneumothorax", "Pleural Effusion", "Fracture",
    "Support Devices", "Lung Opacity",
]
_NAMES = ", ".join(f"'{n}'" for n in FINDING_NAMES)
SPARK_FORM = {"finding_rows": f"""
    SELECT d.doc_id AS study_id, t.label, CAST((d.doc_id * 7 + t.pos * 5 + d.n_chars) % 3 - 1 AS INT) AS value
    FROM {{documents}} d LATERAL VIEW posexplode(array({_NAMES})) t AS pos, label"""}
DUCK_FORM = {"finding_rows": f"""
    SELECT d.doc_id AS study_id, t.label, CAST((d.doc_id * 7 + (t.i - 1) * 5 + d.n_chars) % 3 - 1 AS INT) AS value
    FROM {{documents}} d, unnest([{_NAMES}]) WITH ORDINALITY AS t(label, i)"""}


# three voting runs per study and finding
SPARK_FORM["votes"] = f"""
    SELECT study_id, stage, run, label, CAST((study_id * 7 + run * (n_chars % 4) + pos * 5 + n_chars) % 3 - 1 AS INT) AS value
    FROM (SELECT d.doc_id AS study_id, d.n_chars, CASE WHEN d.doc_id % 2 = 0 THEN 'A' ELSE 'B' END AS stage, t.pos, t.label, r.run
          FROM {{documents}} d LATERAL VIEW posexplode(array({_NAMES})) t AS pos, label
          LATERAL VIEW explode(array(0, 1, 2)) r AS run) x"""
DUCK_FORM["votes"] = f"""
    SELECT d.doc_id AS study_id, CASE WHEN d.doc_id % 2 = 0 THEN 'A' ELSE 'B' END AS stage, CAST(r.run AS INT) AS run,
           t.label, CAST((d.doc_id * 7 + r.run * (d.n_chars % 4) + (t.i - 1) * 5 + d.n_chars) % 3 - 1 AS INT) AS value
    FROM {{documents}} d, unnest([{_NAMES}]) WITH ORDINALITY AS t(label, i), unnest([0, 1, 2]) AS r(run)"""


# truth with labels missing, and predictions with labels, and whole studies, missing
for _form in (SPARK_FORM, DUCK_FORM):
    _form["truth_rows"] = """
    SELECT study_id, stage, label, value AS truth FROM {votes} v WHERE run = 0 AND (study_id + length(label)) % 11 <> 0"""
    _form["pred_rows"] = """
    SELECT study_id, run, label, value FROM {votes} v
    WHERE run > 0 AND (study_id * 3 + run) % 7 <> 0 AND (study_id + length(label)) % 5 <> 0"""


def _text(name: str, spark: bool) -> str:
    forms = SPARK_FORM if spark else DUCK_FORM
    return forms.get(name) or VIEWS[name]


def _needs(text: str) -> list[str]:
    return re.findall(r"(?<!\{)\{(\w+)\}", text)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A binding view as a DataFrame over the parquet files of ``sf_dir``."""
    return spark.sql(_spark_sql(sf_dir, name))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _spark_sql(sf_dir: str, name: str) -> str:
    text = _text(name, spark=True)
    parts = {
        n: f"parquet.`{sf_dir}/{n}.parquet`" if n in TABLES else f"({_spark_sql(sf_dir, n)})"
        for n in _needs(text)
    }
    return text.format(**parts)


def with_views(sql: str, views: tuple[str, ...]) -> str:
    """Put the needed binding views in front of a DuckDB statement."""
    ctes = []
    for name in views:
        text = _text(name, spark=False)
        ctes.append(f"{name} AS ({text.format(**{n: n for n in _needs(text)})})")
    if not ctes:
        return sql
    body = sql.strip()
    if body.upper().startswith("WITH RECURSIVE"):
        return "WITH RECURSIVE " + ", ".join(ctes) + ", " + body[14:]
    if body.upper().startswith("WITH"):
        return "WITH " + ", ".join(ctes) + ", " + body[4:]
    return "WITH " + ", ".join(ctes) + " " + body
