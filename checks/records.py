"""Nested sample records built from the documents table, and their long SQL form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.bindings import DUCK_FORM, SPARK_FORM, view
from clinprep.functions import text

# long form of the patient data of a record, in each dialect
_REC = """
    SELECT doc_id AS study_id, CASE WHEN doc_id % 3 = 0 THEN 'A' WHEN doc_id % 11 = 0 THEN 'C' ELSE 'B' END AS stage,
           CASE WHEN doc_id % 5 = 0 THEN NULL ELSE CAST(20 + n_chars % 70 AS INT) END AS age,
           CASE WHEN doc_id % 2 = 0 THEN 'M' ELSE 'F' END AS sex,
           CASE WHEN doc_id % 7 = 0 THEN NULL ELSE doc_id + 1000 END AS hadm_id,
           CASE CAST(doc_id % 4 AS INT) WHEN 0 THEN 'nc: 2' WHEN 1 THEN 'bipap: 40' WHEN 2 THEN NULL ELSE 'room air' END AS o2,
           CASE WHEN doc_id % 2 = 0 THEN 'ELECTIVE' ELSE 'URGENT' END AS admission_type,
           CASE CAST(doc_id % 3 AS INT) WHEN 0 THEN 'hypertension' WHEN 1 THEN 'diabetes' ELSE 'liver_disease' END AS condition,
           CAST(CASE WHEN doc_id % 5 = 0 THEN 0 WHEN doc_id % 13 = 0 THEN 0 ELSE 4 END AS INT) AS n_vitals,
           CAST(CASE WHEN doc_id % 5 = 0 THEN 0 WHEN doc_id % 13 = 0 THEN 0 ELSE 5 END AS INT) AS n_labs
    FROM {documents}"""
_VITAL_ROWS = [  # name, short name, value, unit
    ("temperature_f", "TempF", "CAST(90 + n_chars % 20 AS DOUBLE)", "F"),
    ("height", "Height", "CAST(150 + doc_id % 50 AS DOUBLE)", "cm"),
    ("weight", "Weight", "CAST(100 + n_chars % 90 AS DOUBLE)", "lbs"),
    ("respiratory_rate", "RR", "CAST(doc_id % 17 AS DOUBLE)", "bpm"),
]
_LAB_ROWS = [
    ("BNP", "CASE WHEN doc_id % 9 = 0 THEN CAST(100000 AS DOUBLE) ELSE CAST(n_chars AS DOUBLE) END", "pg/mL"),
    ("BUN", "CASE WHEN doc_id % 8 = 0 THEN CAST(200 AS DOUBLE) ELSE CAST(n_chars % 60 AS DOUBLE) END", "mg/dL"),
    ("INR", "CAST(doc_id % 12 AS DOUBLE)", "ratio"),
    ("PT", "CAST(n_chars % 70 AS DOUBLE)", "sec"),
    ("CRP", "CAST(n_chars % 300 AS DOUBLE)", "mg/L"),
]
_HAS = "doc_id % 5 <> 0 AND doc_id % 13 <> 0"


def _union(rows, head):
    return " UNION ALL ".join(f"SELECT doc_id AS study_id, {head(r)} FROM {{documents}} WHERE {_HAS}" for r in rows)


_VITALS = _union(_VITAL_ROWS, lambda r: f"'{r[0]}' AS vital, '{r[1]}' AS short, {r[2]} AS value, '{r[3]}' AS unit")
_LABS = _union(_LAB_ROWS, lambda r: f"'{r[0]}' AS lab, {r[1]} AS value, '{r[2]}' AS unit")
for _forms in (SPARK_FORM, DUCK_FORM):
    _forms.update({"rec": _REC, "rec_vitals": _VITALS, "rec_labs": _LABS})
RECORD_VIEWS = ("rec", "rec_vitals", "rec_labs")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One nested record per document: text, labels, stage and (for most) patient data.

    The maps of measurements are built from their few inputs after the joins, which sort narrow rows.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.col("doc_id").alias("study_id"), "n_chars")

    def cell(name, **fields):
        return [F.lit(name), F.struct(*[v.alias(k) for k, v in fields.items()])]

    lab_cells, vital_cells = [], []
    for name, value, unit in _LAB_ROWS:
        lab_cells += cell(name, canonical_name=F.lit(name), value=F.expr(value), unit=F.lit(unit),
                          ref_low=F.lit(10.0), ref_high=F.lit(30.0))
    for name, _, value, unit in _VITAL_ROWS:
        vital_cells += cell(name, value=F.expr(value), unit=F.lit(unit))
    head = view(spark, sf_dir, "rec")
    some = lambda c: F.map_filter(c, lambda k, v: F.expr(_HAS))
    data = F.struct(
        F.col("study_id").alias("subject_id"), F.col("age").alias("Age"), F.col("sex").alias("Sex"),
        "hadm_id", "admission_type",
        some(F.create_map(*vital_cells)).alias("Vitals"), some(F.create_map(*lab_cells)).alias("Labs"),
        F.col("o2").alias("O2_device"), F.array("condition").alias("Chronic_conditions"))
    said = view(spark, sf_dir, "reports").select(
        "study_id", F.col("report"), text.extract_impression(F.col("report")).alias("impression"))
    labels = view(spark, sf_dir, "finding_rows").groupBy("study_id").agg(
        F.map_from_entries(F.collect_list(F.struct("label", "value"))).alias("chexpert_labels"))
    paths = view(spark, sf_dir, "inventory").select("study_id", F.col("path").alias("image_path"))
    return (
        head.join(docs, "study_id").join(said, "study_id").join(labels, "study_id").join(paths, "study_id")
        .select("study_id", "image_path", "impression", "chexpert_labels", "stage",
                F.when(F.col("age").isNotNull(), data).alias("patient_data"))
    )
