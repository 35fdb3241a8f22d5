"""Quality control: Q1-Q5, A18."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.bindings import view
from checks.labels import with_text
from checks.records import RECORD_VIEWS, records
from checks.registry import check
from checks.text import IMPRESSION_SQL
from clinprep import vocab
from clinprep.operators import profile, qc
from clinprep.session import scratch_dir
from clinprep.sources import files

NEGATED = "CASE label " + " ".join(
    f"WHEN '{n}' THEN regexp_matches(low, '(?i){p}')" for n, p in vocab.QC_NEGATED.items()) + " ELSE false END"


@check("Q1_label_text_issues", views=("reports", "finding_rows"), sql=f"""
    WITH {IMPRESSION_SQL}, j AS (SELECT f.study_id, label, value, lower(coalesce(impression, '')) AS low FROM finding_rows f JOIN imp i ON f.study_id = i.study_id),
    n AS (SELECT *, {NEGATED} AS negated FROM j),
    nf AS (SELECT study_id FROM j GROUP BY 1 HAVING max(value) FILTER (label = 'No Finding') = 1 AND max(value) FILTER (label <> 'No Finding') = 1)
    SELECT study_id, 'ERROR' AS severity, 'no_finding_with_positive' AS rule, 'No Finding' AS subject FROM nf
    UNION ALL SELECT study_id, 'ERROR', 'negated_but_not_negative', label FROM n WHERE negated AND value <> -1
    UNION ALL SELECT study_id, 'WARN', 'negated_but_zero', label FROM n WHERE negated AND value = 0""")
def _(spark, sf):
    staged = with_text(spark, sf).withColumn("low", F.lower(F.coalesce("impression", F.lit(""))))
    staged = staged.withColumn("issues", qc.label_issues(F.col("labels"), F.col("low"), negative_values=(-1,)))
    return qc.issue_rows(staged, ["study_id"])


@check("Q2_vital_issues", views=("chartevents",), sql="""
    WITH v AS (SELECT event_id, CASE vital WHEN 'temperature_f' THEN 'mean_bp' ELSE vital END AS vital, valuenum - 50 AS x FROM chartevents)
    SELECT event_id, CASE WHEN vital IN ('respiratory_rate', 'o2_saturation') THEN 'ERROR' ELSE 'WARN' END AS severity, 'vital_out_of_range' AS rule, vital AS subject
    FROM v WHERE (vital = 'respiratory_rate' AND x <= 0) OR (vital = 'o2_saturation' AND x NOT BETWEEN 0 AND 100)
        OR (vital = 'heart_rate' AND x NOT BETWEEN 20 AND 220) OR (vital = 'mean_bp' AND x NOT BETWEEN 30 AND 200)""")
def _(spark, sf):
    rows = view(spark, sf, "chartevents").replace({"temperature_f": "mean_bp"}, subset="vital")
    return qc.issue_rows(rows, ["event_id"], qc.vital_issues(F.col("vital"), F.col("valuenum") - 50))


_QC = ", ".join(f"('{n}', '{u}', {lo}::DOUBLE, {hi}::DOUBLE)" for n, u, lo, hi in vocab.QC_LABS)
Q3_SQL = f"""
    WITH r AS (SELECT * FROM (VALUES {_QC}) AS t(lab, expected, lo, hi)),
    l AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN lab_name = 'Platelet Count' THEN 'PLT' ELSE lab_name END AS lab, value, unit FROM labs),
    j AS (SELECT l.*, r.expected, r.lo, r.hi FROM l JOIN r ON l.lab = r.lab)
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN (lab = 'BNP' AND unit = 'mg/dL') OR (lab = 'BUN' AND unit = 'mEq/L') THEN 'ERROR' ELSE 'WARN' END AS severity,
           CASE WHEN (lab = 'BNP' AND unit = 'mg/dL') OR (lab = 'BUN' AND unit = 'mEq/L') THEN 'invalid_unit' ELSE 'unexpected_unit' END AS rule, lab AS subject FROM j WHERE unit <> expected
    UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, 'ERROR', 'implausible_value', lab FROM j WHERE (lab = 'BNP' AND value > 100000) OR (lab = 'PLT' AND value < 10)
    UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, 'WARN', 'outside_sanity_range', lab FROM j WHERE value < lo OR value > hi"""


def _lab_issues(spark, sf):
    rows = view(spark, sf, "labs").replace({"Platelet Count": "PLT"}, subset="lab_name")
    return qc.issue_rows(rows, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"],
                         qc.lab_issues(F.col("lab_name"), F.col("value"), F.col("unit")))


@check("Q3_lab_issues", views=("labs",), sql=Q3_SQL)
def _(spark, sf):
    return _lab_issues(spark, sf)


@check("A18_issue_summary", views=("labs",), sql=f"SELECT severity, rule, count(*) AS n FROM ({Q3_SQL}) q GROUP BY 1, 2")
def _(spark, sf):
    return profile.issue_summary(_lab_issues(spark, sf))


@check("Q4_structure_issues", views=RECORD_VIEWS + ("inventory",), sql="""
    SELECT study_id, 'ERROR' AS severity, 'unknown_stage' AS rule, stage AS subject FROM rec WHERE stage NOT IN ('A', 'B')
    UNION ALL SELECT study_id, 'ERROR', 'patient_data_missing', 'patient_data' FROM rec WHERE stage = 'B' AND age IS NULL
    UNION ALL SELECT study_id, 'WARN', 'image_missing', path FROM inventory WHERE study_id % 7 = 0""")
def _(spark, sf):
    recs = records(spark, sf)
    rows = qc.issue_rows(recs, ["study_id"], qc.structure_issues(F.col("stage"), F.col("patient_data")))
    stock = view(spark, sf, "inventory").where("study_id % 7 <> 0")
    return rows.unionByName(qc.missing_image_issues(recs, stock, "study_id"))


# all row-local checks of a record together: labels, vitals, labs, structure
@check("Q4_record_issues", views=("reports", "finding_rows", *RECORD_VIEWS), sql=f"""
    WITH {IMPRESSION_SQL}, j AS (SELECT f.study_id, label, value, lower(coalesce(impression, '')) AS low FROM finding_rows f JOIN imp i ON f.study_id = i.study_id),
    n AS (SELECT *, {NEGATED} AS negated FROM j),
    r AS (SELECT * FROM (VALUES {_QC}) AS t(lab, expected, lo, hi)), l AS (SELECT x.*, r.expected, r.lo, r.hi FROM rec_labs x JOIN r ON x.lab = r.lab)
    SELECT study_id, 'ERROR' AS severity, 'no_finding_with_positive' AS rule, 'No Finding' AS subject
    FROM j GROUP BY 1 HAVING max(value) FILTER (label = 'No Finding') = 1 AND max(value) FILTER (label <> 'No Finding') = 1
    UNION ALL SELECT study_id, 'ERROR', 'negated_but_not_negative', label FROM n WHERE negated AND value NOT IN (-1, 0)
    UNION ALL SELECT study_id, 'ERROR', 'vital_out_of_range', vital FROM rec_vitals WHERE vital = 'respiratory_rate' AND value <= 0
    UNION ALL SELECT study_id, CASE WHEN (lab = 'BNP' AND unit = 'mg/dL') OR (lab = 'BUN' AND unit = 'mEq/L') THEN 'ERROR' ELSE 'WARN' END,
           CASE WHEN (lab = 'BNP' AND unit = 'mg/dL') OR (lab = 'BUN' AND unit = 'mEq/L') THEN 'invalid_unit' ELSE 'unexpected_unit' END, lab FROM l WHERE unit <> expected
    UNION ALL SELECT study_id, 'ERROR', 'implausible_value', lab FROM l WHERE lab = 'BNP' AND value > 100000
    UNION ALL SELECT study_id, 'WARN', 'outside_sanity_range', lab FROM l WHERE value < lo OR value > hi
    UNION ALL SELECT study_id, 'ERROR', 'unknown_stage', stage FROM rec WHERE stage NOT IN ('A', 'B')
    UNION ALL SELECT study_id, 'ERROR', 'patient_data_missing', 'patient_data' FROM rec WHERE stage = 'B' AND age IS NULL""")
def _(spark, sf):
    return qc.issue_rows(qc.record_issues(records(spark, sf)), ["study_id"])


@check("Q5_malformed_lines", sql="""
    WITH l AS (SELECT doc_id % 16 AS part, doc_id, row_number() OVER (PARTITION BY doc_id % 16 ORDER BY doc_id) AS line_number FROM documents)
    SELECT part, line_number FROM l WHERE doc_id % 6 = 0""")
def _(spark, sf):
    path = scratch_dir(spark, "lines")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    body = F.to_json(F.struct("doc_id", "text", "lang"))
    line = F.when(F.col("doc_id") % 6 == 0, F.concat(body, F.lit(","))).when(F.col("doc_id") % 6 == 1, F.lit("  ")).otherwise(body)
    # one file per part, in document order
    part = (F.col("doc_id") % 16).alias("part")
    docs.select(part, "doc_id", line.alias("value")).repartition("part").sortWithinPartitions("part", "doc_id").select(
        "part", "value").write.partitionBy("part").text(path)
    bad = files.malformed_lines(spark, path)
    return bad.select(F.regexp_extract("file", r"part=(\d+)", 1).cast("long").alias("part"), "line_number")
