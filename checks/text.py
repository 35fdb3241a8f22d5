"""Text, path and prompt operators: T1-T12, and the report corpus profile A12."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.bindings import FINDING_NAMES, view
from checks.records import RECORD_VIEWS, records
from checks.registry import check
from clinprep import vocab
from clinprep.functions import text
from clinprep.operators import corpus, profile
from clinprep.operators.records import compact_ehr, pick_ehr_fields, prompts, strip_audit

# the same section rules in RE2, where a lookbehind becomes a literal in front of the group
UP = "upper(replace(report, 'ß', 'ss'))"


def _sections(heading):
    bodies = [rf"(?s){heading}:(.*?)(?:\n[A-Z ]+:|\z)", rf"(?s){heading}(.*?)(?:\n[A-Z ]+:|\z)",
              rf"(?s){heading}:(.*?)(?:\n[A-Z]{{2,}}|\z)"]
    return [f"trim(regexp_extract(u, '{b}', 1), ' ' || chr(10))" for b in bodies]


def _clean(col):
    out = rf"regexp_replace({col}, '\[\*\*.*?\*\*\]', '', 'g')"
    for lead in ("Dictated by", "Electronically signed by", "Date:"):
        out = rf"regexp_replace({out}, '(?i){lead}.*?\.', '', 'g')"
    return rf"trim(regexp_replace({out}, '\s+', ' ', 'g'))"


IMPRESSION_SQL = f"""u AS (SELECT study_id, {UP} AS u FROM reports),
    s AS (SELECT study_id, list_filter([{', '.join(_sections('IMPRESSION') + _sections('FINDINGS'))}], lambda x: length(x) > 10)[1] AS body FROM u),
    imp AS (SELECT study_id, {_clean('body')} AS impression FROM s)"""


def impressions(spark, sf):
    return view(spark, sf, "reports").select("study_id", text.extract_impression(F.col("report")).alias("impression"))


@check("T1_section_extraction", views=("reports",), sql=f"WITH {IMPRESSION_SQL} SELECT study_id, impression FROM imp")
def _(spark, sf):
    return impressions(spark, sf)


@check("T2_text_cleaning", views=("reports",), sql=f"SELECT study_id, {_clean('report')} AS cleaned FROM reports")
def _(spark, sf):
    return view(spark, sf, "reports").select("study_id", text.clean_text(F.col("report")).alias("cleaned"))


@check("T3_redaction_marks", views=("reports",), sql=r"""
    SELECT study_id, regexp_replace(replace(report, '___', '[REDACTED]'), '\[REDACTED\]+', '[REDACTED]', 'g') AS report FROM reports""")
def _(spark, sf):
    return view(spark, sf, "reports").select("study_id", text.redaction_marks(F.col("report")).alias("report"))


@check("T4_path_prefix", views=("inventory",), sql="""
    SELECT study_id, CASE WHEN starts_with(path, 'files/files/') THEN substr(path, 13)
                          WHEN starts_with(path, 'files/') THEN substr(path, 7) ELSE path END AS path FROM inventory""")
def _(spark, sf):
    return view(spark, sf, "inventory").select("study_id", text.strip_path_prefix(F.col("path")).alias("path"))


@check("T5_path_parts", views=("inventory",), sql="""
    SELECT study_id, replace(path, '.dcm', '.jpg') AS image_path,
           replace(split_part(path, '/', 6), '.dcm', '') AS image_id, split_part(path, '/', 5) AS study FROM inventory""")
def _(spark, sf):
    p = text.jpg_path(F.col("path"))
    return view(spark, sf, "inventory").select(
        "study_id", p.alias("image_path"), text.image_id(p).alias("image_id"), text.study_of_path(p).alias("study"))


@check("T6_view_inference", views=("inventory",), sql="""
    SELECT study_id, CASE WHEN contains(lower(path), 'pa') OR contains(lower(path), 'posteroanterior') THEN 'PA'
        WHEN contains(lower(path), 'ap') OR contains(lower(path), 'anteroposterior') THEN 'AP'
        WHEN contains(lower(path), 'lat') THEN 'LATERAL' WHEN contains(lower(path), 'portable') THEN 'PORTABLE' ELSE 'PA' END AS view
    FROM inventory""")
def _(spark, sf):
    return view(spark, sf, "inventory").select("study_id", text.view_of_path(F.col("path")).alias("view"))


@check("T7_frontal_filter", views=("inventory",), sql="""
    SELECT study_id, path FROM inventory WHERE NOT contains(path, '_lateral')""")
def _(spark, sf):
    return view(spark, sf, "inventory").where(text.view_of_path(F.col("path")).isin(vocab.FRONTAL_VIEWS)).select("study_id", "path")


@check("T8_stage_filter", views=("samples",), sql="SELECT sample_id, stage FROM samples WHERE stage = 'B'")
def _(spark, sf):
    return corpus.by_stage(view(spark, sf, "samples"), "stage_b").select("sample_id", "stage")


@check("T9_ehr_fields", views=RECORD_VIEWS, sql="""
    SELECT study_id, age, CASE WHEN age IS NOT NULL THEN sex END AS sex, CASE WHEN age IS NOT NULL THEN n_vitals END AS n_vitals,
           CASE WHEN age IS NOT NULL THEN n_labs END AS n_labs, age IS NOT NULL AND o2 IS NOT NULL AS has_o2 FROM rec""")
def _(spark, sf):
    picked = pick_ehr_fields(records(spark, sf))
    whole = F.from_json("ehr", "Age int, Sex string, Vitals map<string,string>, Labs map<string,string>, O2_device string, hadm_id long")
    e = picked.select("study_id", whole.alias("e"))
    return e.where("e.hadm_id IS NULL").select(
        "study_id", F.col("e.Age").alias("age"), F.col("e.Sex").alias("sex"),
        F.size("e.Vitals").cast("int").alias("n_vitals"), F.size("e.Labs").cast("int").alias("n_labs"),
        F.col("e.O2_device").isNotNull().alias("has_o2"))


@check("T10_compact_ehr", views=RECORD_VIEWS, sql="""
    SELECT r.study_id, v.short AS name, v.value, NULL::VARCHAR AS unit FROM rec r JOIN rec_vitals v ON r.study_id = v.study_id
    UNION ALL SELECT r.study_id, l.lab, l.value, l.unit FROM rec r JOIN rec_labs l ON r.study_id = l.study_id
    UNION ALL SELECT study_id, 'no patient data', NULL, NULL FROM rec WHERE age IS NULL""")
def _(spark, sf):
    out = compact_ehr(records(spark, sf))
    whole = F.from_json("ehr_context", "Vitals map<string,double>, Labs map<string,struct<value:double,unit:string>>")

    def cell(name, value=F.lit(None).cast("double"), unit=F.lit(None).cast("string")):
        return F.struct(name.alias("name"), value.alias("value"), unit.alias("unit"))

    def cells(entries, of):
        return F.coalesce(F.transform(F.map_entries(entries), of), F.array())

    e = out.select("study_id", "ehr_context", whole.alias("e"))
    rows = F.when(F.col("ehr_context") == "{}", F.array(cell(F.lit("no patient data")))).otherwise(F.concat(
        cells(F.col("e.Vitals"), lambda v: cell(v["key"], v["value"])),
        cells(F.col("e.Labs"), lambda v: cell(v["key"], v["value"]["value"], v["value"]["unit"]))))
    # outer, so that no filter inferred from the explode works the array out again
    return e.select("study_id", F.explode_outer(rows).alias("r")).where("r IS NOT NULL").select("study_id", "r.name", "r.value", "r.unit")


_FINDINGS_JSON = " || ', ' || ".join(
    "'\"" + n + "\": ' || " + (f"coalesce(max(value) FILTER (label = '{n}'), 0)::VARCHAR" if n in FINDING_NAMES else "'0'")
    for n in vocab.FINDINGS)


@check("T11_target_text", views=("finding_rows", "reports"), sql=f"""
    WITH {IMPRESSION_SQL}, j AS (SELECT study_id, '{{' || {_FINDINGS_JSON} || '}}' AS js FROM finding_rows GROUP BY study_id)
    SELECT i.study_id, '1) IMPRESSION: ' || impression || chr(10) || chr(10) || '2) CheXpert: ' || js AS target
    FROM imp i JOIN j ON i.study_id = j.study_id""".replace("{{", "{").replace("}}", "}"))
def _(spark, sf):
    rows = view(spark, sf, "finding_rows").groupBy("study_id").agg(
        F.map_from_entries(F.collect_list(F.struct("label", "value"))).alias("labels"))
    return impressions(spark, sf).join(rows, "study_id").select(
        "study_id", text.stage_a_target(F.col("impression"), F.col("labels")).alias("target"))


def _quoted(text):
    return "'" + text.replace("'", "''") + "'"


_NO_ICD = "{" + ", ".join(f'"{n}": 0' for n in vocab.ICD_CLASSES) + "}"


@check("T11_prompt_text", views=("finding_rows", "reports", *RECORD_VIEWS), sql=f"""
    WITH {IMPRESSION_SQL}, j AS (SELECT study_id, '[' || {_FINDINGS_JSON} || ']' AS js FROM finding_rows GROUP BY study_id),
    v AS (SELECT study_id, string_agg('"' || short || '":' || value::VARCHAR, ',' ORDER BY CASE short WHEN 'TempF' THEN 0 WHEN 'Height' THEN 1 WHEN 'Weight' THEN 2 ELSE 3 END) AS t
          FROM rec_vitals GROUP BY 1),
    l AS (SELECT study_id, string_agg('"' || lab || '":[!"value":' || value::VARCHAR || ',"unit":"' || unit || '"!]', ',' ORDER BY CASE lab WHEN 'BNP' THEN 0 WHEN 'BUN' THEN 1
                WHEN 'INR' THEN 2 WHEN 'PT' THEN 3 ELSE 4 END) AS t FROM rec_labs GROUP BY 1),
    e AS (SELECT r.study_id, r.stage, CASE WHEN r.age IS NULL THEN '[!!]' ELSE '[!"Age":' || r.age::VARCHAR || ',"Sex":"' || r.sex || '"' || coalesce(',"Vitals":[!' || v.t || '!]', '')
            || coalesce(',"Labs":[!' || l.t || '!]', '') || ',"Chronic":["' || r.condition || '"]!]' END AS ehr
          FROM rec r LEFT JOIN v ON r.study_id = v.study_id LEFT JOIN l ON r.study_id = l.study_id)
    SELECT e.study_id, e.stage, CASE WHEN e.stage = 'A' THEN {_quoted(vocab.PROMPT_A)} ELSE {_quoted(vocab.PROMPT_B_HEAD)} || replace(replace(ehr, '[!', chr(123)), '!]', chr(125))
           || {_quoted(vocab.PROMPT_B_TAIL)} END AS prompt,
           '1) IMPRESSION: ' || impression || chr(10) || chr(10) || '2) CheXpert: ' || chr(123) || js[2:-2] || chr(125)
           || CASE WHEN e.stage = 'A' THEN '' ELSE chr(10) || chr(10) || '3) ICD: ' || {_quoted(_NO_ICD)} END AS target
    FROM e JOIN imp i ON e.study_id = i.study_id JOIN j ON e.study_id = j.study_id""")
def _(spark, sf):
    return prompts(records(spark, sf)).select("study_id", "stage", "prompt", "target")


@check("T12_strip_audit", views=RECORD_VIEWS, sql="SELECT study_id, lab, value, unit FROM rec_labs")
def _(spark, sf):
    marked = records(spark, sf).withColumn("Labs", F.transform_values(
        "patient_data.Labs", lambda _, v: v.withField("corrected", F.lit(True)).withField("error", F.lit("x"))))
    clean = strip_audit(marked, "Labs")
    return clean.select("study_id", F.explode("Labs").alias("lab", "v")).select("study_id", "lab", "v.value", "v.unit")


@check("A12_corpus_profile", views=("reports",), sql=f"""
    WITH {IMPRESSION_SQL} SELECT count(*) AS n, round(avg(length(impression)), 6) AS mean_chars,
        min(length(impression)) AS min_chars, max(length(impression)) AS max_chars FROM imp WHERE impression IS NOT NULL""")
def _(spark, sf):
    out = profile.length_profile(impressions(spark, sf), "impression")
    return out.withColumn("mean_chars", F.round("mean_chars", 6))


@check("A12_view_counts", views=("inventory",), sql="""
    SELECT CASE WHEN contains(path, '_lateral') THEN 'LATERAL' ELSE 'PA' END AS view, count(*) AS n FROM inventory GROUP BY 1""")
def _(spark, sf):
    return profile.view_counts(view(spark, sf, "inventory").withColumn("view", text.view_of_path(F.col("path"))))
