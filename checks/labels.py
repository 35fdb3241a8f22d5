"""Label operators: L1-L12, S4, A11."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.bindings import FINDING_NAMES, view
from checks.records import RECORD_VIEWS, records
from checks.registry import check
from checks.text import IMPRESSION_SQL, impressions
from clinprep import vocab
from clinprep.functions import labels as lb
from clinprep.functions.parse import typed_map
from clinprep.operators import labels, profile
from clinprep.operators import records as rec
from clinprep.session import scratch_dir
from clinprep.sources import files


def finding_maps(spark, sf):
    return labels.label_maps(view(spark, sf, "finding_rows"))


def with_text(spark, sf):
    return finding_maps(spark, sf).join(impressions(spark, sf), "study_id")


def long(df, column):
    # the outer form keeps Spark from repeating the whole label expression in a size filter
    return df.select("study_id", F.explode_outer(column).alias("label", "value")).where(F.col("label").isNotNull())


# --- L1, L2, S4, A11 ----------------------------------------------------------

WIDE = """
    SELECT CASE WHEN doc_id % 29 = 0 THEN NULL ELSE doc_id - doc_id % 4 END AS study_id, doc_id AS ordinal,
           CASE WHEN doc_id % 10 = 9 THEN NULL ELSE CAST(CAST(doc_id % 10 - 3 AS DOUBLE) / 2 AS {text}) END AS number,
           CASE CAST(n_chars % 9 AS INT) WHEN 0 THEN 'Positive ' WHEN 1 THEN 'no' WHEN 2 THEN 'unknown' WHEN 3 THEN '2'
                WHEN 4 THEN '-1' WHEN 5 THEN 'maybe' WHEN 6 THEN NULL WHEN 7 THEN 'YES' ELSE '0' END AS word
    FROM {documents}"""


@check("L1_label_normalization", sql=f"""
    WITH w AS ({WIDE.format(text='VARCHAR', documents='documents')}),
         l AS (SELECT * FROM w WHERE study_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY study_id ORDER BY ordinal DESC) = 1)
    SELECT study_id::VARCHAR AS study_id, 'number' AS label, CASE WHEN number IS NULL THEN -1 WHEN number::DOUBLE < 0 THEN -1
           WHEN number::DOUBLE = 0 THEN 0 WHEN number::DOUBLE <= 1 THEN 1 ELSE 2 END AS value FROM l
    UNION ALL
    SELECT study_id::VARCHAR, 'word', CASE trim(lower(word)) WHEN 'positive' THEN 1 WHEN 'yes' THEN 1 WHEN '1' THEN 1
           WHEN 'no' THEN 0 WHEN '0' THEN 0 WHEN '2' THEN 2 ELSE -1 END FROM l""")
def _(spark, sf):
    wide = spark.sql(WIDE.format(text="STRING", documents=f"parquet.`{sf}/documents.parquet`"))
    return labels.label_table(wide, ["number", "word"])


@check("L1_missing_ids", sql="SELECT count(*) AS missing_study_ids FROM documents WHERE doc_id % 29 = 0")
def _(spark, sf):
    wide = spark.sql(WIDE.format(text="STRING", documents=f"parquet.`{sf}/documents.parquet`"))
    return wide.agg(labels.missing_ids(wide))


@check("L2_label_domain", views=("finding_rows",), sql="""
    SELECT study_id, label, value * 3 AS value FROM finding_rows WHERE value * 3 NOT IN (-1, 0, 1, 2)""")
def _(spark, sf):
    rows = view(spark, sf, "finding_rows").withColumn("value", F.col("value") * 3)
    return labels.out_of_domain(rows)


@check("S4_map_table", views=("label_rows",), sql="SELECT study_id, label, value FROM label_rows")
def _(spark, sf):
    path = scratch_dir(spark, "maps")
    files.write_map_table(labels.label_maps(view(spark, sf, "label_rows")), path)
    return labels.explode_labels(files.read_map_table(spark, path))


def _map_document(spark, sf, gap: str, between: str):
    """The label maps written as one JSON document in parts, and read again from them."""
    path = scratch_dir(spark, "document")
    maps = labels.label_maps(view(spark, sf, "label_rows")).select(
        F.col("study_id"), F.to_json(F.transform_values("labels", lambda _, v: v.cast("string"))).alias("body"))
    body = F.regexp_replace(F.regexp_replace("body", r'":"(-?[0-9]+)"', rf'":{gap}$1'), ",", "," + between)
    line = F.concat(F.lit('"'), F.col("study_id").cast("string"), F.lit(f'":{gap}'), body)
    # each partition writes its studies; the braces of the document are rows of their own
    first, last = (spark.range(1).select(F.lit(brace).alias("value")) for brace in "{}")
    studies = maps.select(F.concat(F.lit(between), line, F.lit(",")).alias("value"))
    first.unionByName(studies).unionByName(last).write.text(path)
    read = files.import_map_document(spark, path).withColumn("study_id", F.col("study_id").cast("long"))
    return labels.explode_labels(read)


@check("S4_map_document", views=("label_rows",), sql="SELECT study_id, label, value FROM label_rows")
def _(spark, sf):
    return _map_document(spark, sf, "", "")


@check("S4_map_document_indented", views=("label_rows",), sql="SELECT study_id, label, value FROM label_rows")
def _(spark, sf):
    return _map_document(spark, sf, " ", "\n    ")


@check("A11_label_distribution", views=("finding_rows",), sql="""
    SELECT label, value, count(*) AS n FROM finding_rows GROUP BY ALL""")
def _(spark, sf):
    return profile.label_distribution(view(spark, sf, "finding_rows"))


# --- L3-L6 --------------------------------------------------------------------

def _any(words, col="low"):
    return "(" + " OR ".join("contains({}, '{}')".format(col, w.replace("'", "''")) for w in words) + ")"


L3_CASES = " ".join(
    f"WHEN label = '{n}' AND value = 1 AND {_any(w)} THEN 0" for n, w in vocab.NEGATION_PATTERNS.items())


@check("L3_negation_conflicts", views=("reports", "finding_rows"), sql=f"""
    WITH {IMPRESSION_SQL}, j AS (SELECT f.study_id, label, value, lower(coalesce(impression, '')) AS low
                                 FROM finding_rows f JOIN imp i ON f.study_id = i.study_id)
    SELECT study_id, label, CASE {L3_CASES} ELSE value END AS value FROM j""")
def _(spark, sf):
    return long(rec.negate_contradictions(with_text(spark, sf), "labels"), "labels")


def _l4_sql(negative):
    cases = " ".join(
        f"WHEN label = '{n}' AND value IN (0, 1) AND {_any(w)} THEN {negative} "
        f"WHEN label = '{n}' AND value IN (-1, 0) AND {_any(vocab.CLEAR_POSITIVES[n])} THEN 1"
        for n, w in vocab.CLEAR_NEGATIVES.items() if n in FINDING_NAMES)
    return f"""
    WITH {IMPRESSION_SQL}, j AS (SELECT f.study_id, label, value, lower(coalesce(impression, '')) AS low
                                 FROM finding_rows f JOIN imp i ON f.study_id = i.study_id),
    st AS (SELECT study_id, label, value AS old, low, CASE {cases}
              WHEN label = 'Fracture' AND value = 1 AND {_any(vocab.FRACTURE_DENIALS)} THEN 0
              WHEN label = 'Support Devices' AND value = -1 AND {_any(vocab.DEVICE_WORDS)} THEN 1 ELSE value END AS v FROM j),
    a AS (SELECT study_id, bool_or(v = 1) AS pos FROM st s WHERE label <> 'No Finding' GROUP BY 1)
    SELECT s.study_id, label, CAST(CASE WHEN label = 'No Finding' THEN CASE WHEN a.pos THEN 0 ELSE 1 END ELSE v END AS INT) AS value
    FROM st s JOIN a ON s.study_id = a.study_id"""


@check("L4_label_reconciliation", views=("reports", "finding_rows"), sql=_l4_sql(0))
def _(spark, sf):
    return long(rec.reconcile_labels(with_text(spark, sf), "labels"), "labels")


@check("L4_label_reconciliation_minus_one", views=("reports", "finding_rows"), sql=_l4_sql(-1))
def _(spark, sf):
    return long(rec.reconcile_labels(with_text(spark, sf), "labels", negative_value=-1), "labels")


@check("L5_uncertainty_policy", views=("finding_rows",), sql="""
    SELECT study_id, label, CASE WHEN value = -1 THEN 0 ELSE value END AS value FROM finding_rows""")
def _(spark, sf):
    return long(rec.settle_uncertain(finding_maps(spark, sf), "labels"), "labels")


@check("L6_target_vector", views=("finding_rows",), sql=f"""
    WITH n AS (SELECT unnest([{', '.join(f"'{n}'" for n in vocab.FINDINGS)}]) AS label),
         s AS (SELECT DISTINCT study_id FROM finding_rows)
    SELECT s.study_id, n.label, CASE WHEN f.value = 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS value,
           CASE WHEN f.value = -1 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS mask
    FROM s CROSS JOIN n LEFT JOIN finding_rows f ON f.study_id = s.study_id AND f.label = n.label""")
def _(spark, sf):
    return finding_maps(spark, sf).select("study_id", F.explode(lb.dense_vector(F.col("labels"))).alias("v")).select("study_id", "v.*")


# --- L7-L9 --------------------------------------------------------------------

def _icd_sql(rows, test, more=""):
    cols = ", ".join(f"max(CASE WHEN c.icd = '{n}' THEN 1 ELSE 0 END) AS {n}" for n in vocab.ICD_CLASSES)
    values = ", ".join(f"({i}, '{p}', '{c}')" for i, (p, c) in enumerate(rows))
    return f"""
    WITH p AS (SELECT * FROM (VALUES {values}) AS t(pos, prefix, icd)),
         d AS (SELECT DISTINCT icd_code FROM diagnoses),
         m AS (SELECT icd_code, arg_min(icd, pos) AS icd FROM d JOIN p ON {test} GROUP BY 1),
         c AS (SELECT g.hadm_id, CASE WHEN {more or 'true'} THEN m.icd END AS icd FROM diagnoses g LEFT JOIN m ON g.icd_code = m.icd_code)
    SELECT hadm_id, {cols} FROM c GROUP BY hadm_id"""


@check("L7_icd_classes", views=("diagnoses",), sql=_icd_sql(vocab.ICD_PREFIX_CLASS, "starts_with(d.icd_code, p.prefix)"))
def _(spark, sf):
    return labels.icd_classes(view(spark, sf, "diagnoses"), "hadm_id")


@check("L8_icd_classes_fragment", views=("diagnoses",), sql=_icd_sql(
    vocab.ICD_FRAGMENT_CLASS, "contains(d.icd_code, p.prefix)", "g.confidence > 0.5"))
def _(spark, sf):
    return labels.icd_classes(view(spark, sf, "diagnoses"), "hadm_id", match="fragment")


@check("L9_icd_from_record", views=RECORD_VIEWS + ("finding_rows",), sql="""
    SELECT study_id, CASE condition WHEN 'hypertension' THEN 'I10' ELSE 'E11.9' END AS code, condition AS description, 0.8::DOUBLE AS confidence
    FROM rec WHERE stage = 'B' AND age IS NOT NULL AND condition IN ('hypertension', 'diabetes')
    UNION ALL
    SELECT r.study_id, CASE label WHEN 'Pneumonia' THEN 'J18.9' WHEN 'Pleural Effusion' THEN 'J94.8' WHEN 'Pneumothorax' THEN 'J93.9' ELSE 'J81.1' END,
           CASE label WHEN 'Pleural Effusion' THEN 'Pleural effusion' WHEN 'Edema' THEN 'Pulmonary edema' ELSE label END,
           CASE label WHEN 'Edema' THEN 0.8::DOUBLE ELSE 0.9::DOUBLE END
    FROM rec r JOIN finding_rows f ON r.study_id = f.study_id
    WHERE r.stage = 'B' AND f.value = 1 AND label IN ('Pneumonia', 'Pleural Effusion', 'Pneumothorax', 'Edema')""")
def _(spark, sf):
    out = rec.add_icd_codes(records(spark, sf))
    return out.select("study_id", F.explode("icd_labels").alias("c")).select("study_id", "c.code", "c.description", "c.confidence")


# --- L10-L12 ------------------------------------------------------------------

VOTED = """k AS (SELECT study_id, run, label, {value} AS value FROM votes WHERE {where}), n AS (SELECT study_id, count(DISTINCT run) AS n FROM k GROUP BY 1)"""
TALLY = """SELECT k.study_id, label, CAST(CASE WHEN sum(CASE WHEN value > 0 THEN 1 ELSE 0 END) >= greatest(1, ceil(any_value(n) * 0.34::DOUBLE)) THEN 1
           {negative} ELSE 0 END AS INT) AS value FROM k JOIN n ON k.study_id = n.study_id GROUP BY 1, 2"""
NEGATIVE = "WHEN sum(CASE WHEN value < 0 THEN 1 ELSE 0 END) >= greatest(1, ceil(any_value(n) * 0.34::DOUBLE)) THEN -1"
# labels that some runs leave out vote for nothing, but the runs count
LEFT_OUT = "CASE WHEN (study_id + length(label) + run) % 4 <> 0 THEN value END"


@check("L10_finding_votes", views=("votes",), sql=f"WITH {VOTED.format(value='value', where='true')} {TALLY.format(negative=NEGATIVE)}")
def _(spark, sf):
    return labels.aggregate_votes(view(spark, sf, "votes").drop("stage"))


@check("L10_icd_votes", views=("votes",), sql=f"WITH {VOTED.format(value='value', where='true')} {TALLY.format(negative='')}")
def _(spark, sf):
    return labels.aggregate_votes(view(spark, sf, "votes").drop("stage"), negative_share=None)


@check("L10_absent_labels", views=("votes",), sql=f"WITH {VOTED.format(value=LEFT_OUT, where='true')} {TALLY.format(negative=NEGATIVE)}")
def _(spark, sf):
    return labels.aggregate_votes(view(spark, sf, "votes").withColumn("value", F.expr(LEFT_OUT)).drop("stage"))


@check("L10_vote_fallback", views=("votes", "finding_rows"), sql=f"""
    WITH {VOTED.format(value='value', where="stage = 'A'")} {TALLY.format(negative=NEGATIVE)}
    UNION ALL SELECT study_id, label, value FROM finding_rows WHERE study_id NOT IN (SELECT study_id FROM k)""")
def _(spark, sf):
    voted = labels.aggregate_votes(view(spark, sf, "votes").where("stage = 'A'").drop("stage"))
    rows = view(spark, sf, "finding_rows")
    return labels.votes_or_fallback(rows.select("study_id").distinct(), voted, rows)


# votes as JSON values: numbers and booleans count, text and NaN do not
@check("L11_vote_values", views=("pairs",), sql="""
    SELECT conv_id, turn, CAST(CASE CAST(conv_id % 6 AS INT) WHEN 0 THEN -1 WHEN 1 THEN sign(turn) WHEN 2 THEN 1 ELSE 0 END AS INT) AS vote,
           CAST(CASE CAST(conv_id % 6 AS INT) WHEN 1 THEN sign(turn) WHEN 2 THEN 1 ELSE 0 END AS INT) AS icd_vote,
           CAST(sign(turn - 1) AS INT) AS number_vote, 0 AS text_vote FROM pairs""")
def _(spark, sf):
    kind = F.col("conv_id") % 6
    raw = F.when(kind == 0, F.concat(F.lit("-"), F.col("turn").cast("string"), F.lit(".5"))).when(kind == 1, F.col("turn").cast("string")).when(
        kind == 2, "true").when(kind == 3, '"yes"').when(kind == 4, '"1"').otherwise("NaN")
    value = typed_map(F.concat(F.lit('{"v": '), raw, F.lit("}")))["v"]
    return view(spark, sf, "pairs").select(
        "conv_id", "turn", lb.variant_vote(value).alias("vote"), lb.variant_vote(value, False).alias("icd_vote"),
        lb.vote_value(F.col("turn") - 1).alias("number_vote"), lb.vote_value(F.lit("1")).alias("text_vote"))


def _keyword_sql():
    finding, icd = {}, {}
    for w, n in vocab.KEYWORD_FINDINGS:
        finding.setdefault(n, []).append(w)
    for w, n in vocab.KEYWORD_ICD:
        icd.setdefault(n, []).append(w)
    fluid = "(stage = 'B' AND bnp >= 1200 AND contains(lower(admission_type), 'elective'))"
    extra = {"Edema": fluid, "Pleural Effusion": fluid,
             "Support Devices": "(stage = 'B' AND coalesce(device, '') NOT IN ('', 'unknown', 'room air', 'none'))"}
    icd_extra = {"Pulmonary_Edema": fluid, "Pleural_Effusion": fluid,
                 "Pneumonia": "(stage = 'B' AND crp >= 150 AND contains(low, 'pneumonia'))"}
    rows = []
    for n in vocab.FINDINGS:
        if n == "No Finding":
            continue
        test = " OR ".join(([_any(finding[n])] if n in finding else []) + ([extra[n]] if n in extra else [])) or "false"
        rows.append(f"SELECT study_id, 'finding' AS kind, '{n}' AS label, CASE WHEN low <> '' AND ({test}) THEN 1 ELSE coalesce(m['{n}'], 0) END AS value, low, m FROM b")
    icd_rows = []
    for n in vocab.ICD_CLASSES:
        test = " OR ".join(([f"(stage = 'B' AND {_any(icd[n])})"] if n in icd else []) + ([icd_extra[n]] if n in icd_extra else [])) or "false"
        icd_rows.append(f"SELECT study_id, 'icd' AS kind, '{n}' AS label, CASE WHEN low <> '' AND ({test}) THEN 1 ELSE 0 END AS value FROM b")
    return f"""
    WITH {IMPRESSION_SQL}, f AS (SELECT study_id, map(list(label), list(value)) AS m FROM finding_rows GROUP BY 1),
    l AS (SELECT study_id, max(value) FILTER (lab = 'BNP') AS bnp, max(value) FILTER (lab = 'CRP') AS crp FROM rec_labs GROUP BY 1),
    b AS (SELECT r.study_id, r.stage, CASE WHEN r.age IS NOT NULL THEN r.admission_type END AS admission_type,
                 CASE WHEN r.age IS NOT NULL THEN r.o2 END AS device, l.bnp, l.crp, f.m,
                 lower(coalesce(i.impression, '')) AS low
          FROM rec r JOIN imp i ON r.study_id = i.study_id JOIN f ON r.study_id = f.study_id LEFT JOIN l ON r.study_id = l.study_id),
    fr AS ({' UNION ALL '.join(rows)}),
    nf AS (SELECT study_id, 'finding' AS kind, 'No Finding' AS label,
                  CASE WHEN any_value(low) = '' THEN coalesce(any_value(m)['No Finding'], 0) WHEN bool_or(value <> 0) THEN 0 ELSE 1 END AS value FROM fr GROUP BY 1)
    SELECT study_id, kind, label, CAST(value AS INT) AS value FROM fr UNION ALL SELECT study_id, kind, label, CAST(value AS INT) FROM nf
    UNION ALL {' UNION ALL '.join(icd_rows).replace("THEN 1 ELSE 0 END AS value", "THEN 1 ELSE 0 END::INT AS value")}"""


@check("L12_keyword_rules", views=RECORD_VIEWS + ("reports", "finding_rows"), sql=_keyword_sql())
def _(spark, sf):
    p = F.col("patient_data")

    def lab(name):
        return F.try_element_at(p["Labs"], F.lit(name))["value"]

    base = records(spark, sf).select(
        "study_id", "stage", "impression", F.col("chexpert_labels").alias("findings"),
        F.create_map(*[c for n in vocab.ICD_CLASSES for c in (F.lit(n), F.lit(0))]).alias("icd"),
        lab("BNP").alias("bnp"), lab("CRP").alias("crp"), p["admission_type"].alias("admission_type"), p["O2_device"].alias("device"))
    out = labels.keyword_labels(base)

    def cells(kind, col):
        return F.transform(F.map_entries(col), lambda e: F.struct(
            F.lit(kind).alias("kind"), e["key"].alias("label"), e["value"].alias("value")))

    rows = F.concat(cells("finding", "findings"), cells("icd", "icd"))
    return out.select("study_id", F.explode_outer(rows).alias("r")).where("r IS NOT NULL").select("study_id", "r.*")
