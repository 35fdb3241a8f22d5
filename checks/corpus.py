"""Corpus operators: J1-J4, A2, A14, A17, S9, W1-W13."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from checks.bindings import view
from checks.ehr import CONTEXT_CTES, CONTEXT_VIEWS, context
from checks.records import RECORD_VIEWS, records
from checks.registry import check
from checks.text import IMPRESSION_SQL, impressions
from clinprep.operators import corpus, labels, profile
from clinprep.sources.files import stored


# --- manifest -----------------------------------------------------------------

@check("J1_study_metadata", views=("inventory", "reports"), sql="""
    SELECT i.study_id, i.path, r.source, r.source || 'x' AS path_y FROM inventory i LEFT JOIN (SELECT * FROM reports WHERE source <> 'src1') r ON i.study_id = r.study_id""")
def _(spark, sf):
    left = view(spark, sf, "inventory").withColumn("study_id", F.col("study_id").cast("string"))
    right = view(spark, sf, "reports").where("source <> 'src1'").select(
        F.col("study_id").cast("string").alias("study_id"), "source", F.concat("source", F.lit("x")).alias("path"))
    return corpus.study_metadata(left, right)


# every eleventh study has no report text, files exist for studies not divisible by 7
MANIFEST_SQL = f"""
    WITH {IMPRESSION_SQL}, lab AS (SELECT DISTINCT study_id FROM label_rows),
    img AS (SELECT study_id, replace(path, '.dcm', '.jpg') AS image_path FROM inventory WHERE study_id % 17 <> 0),
    c AS (SELECT i.study_id, i.study_id % 50 AS subject_id, p.impression, lab.study_id AS has_labels, img.image_path,
                 CASE WHEN p.impression IS NULL OR i.study_id % 11 = 0 THEN 'no_impression' WHEN lab.study_id IS NULL THEN 'no_chexpert'
                      WHEN img.image_path IS NULL THEN 'no_image' WHEN i.study_id % 7 = 0 THEN 'missing_file'
                      WHEN contains(img.image_path, '_lateral') THEN 'non_frontal' END AS reason
          FROM inventory i LEFT JOIN imp p ON i.study_id = p.study_id LEFT JOIN lab ON i.study_id = lab.study_id LEFT JOIN img ON i.study_id = img.study_id)"""


def candidates(spark, sf):
    stock = view(spark, sf, "inventory")
    studies = stock.select("study_id", (F.col("study_id") % 50).alias("subject_id"))
    said = impressions(spark, sf).where("study_id % 11 <> 0").select(
        F.concat(F.lit("s"), F.col("study_id").cast("string")).alias("study_id"), "impression")
    maps = labels.label_maps(view(spark, sf, "label_rows"))
    images = stock.where("study_id % 17 <> 0").withColumn("ordinal", F.col("study_id"))
    files = stock.where("study_id % 7 <> 0").select(F.replace("path", F.lit(".dcm"), F.lit(".jpg")).alias("path"))
    return corpus.manifest_candidates(studies, said, maps, images, files)


@check("J2_manifest", views=("reports", "label_rows", "inventory"), sql=f"""
    {MANIFEST_SQL} SELECT study_id, subject_id, image_path, replace(split_part(image_path, '/', 6), '.jpg', '') AS image_id, 'PA' AS view, impression
    FROM c WHERE reason IS NULL""")
def _(spark, sf):
    return corpus.manifest(candidates(spark, sf)).drop("chexpert")


@check("J3_rejections", views=("reports", "label_rows", "inventory"), sql=f"""
    {MANIFEST_SQL} SELECT reason, count(*) AS n FROM (SELECT reason FROM c WHERE reason IS NOT NULL
        UNION ALL SELECT 'no_image' FROM c WHERE reason IN ('missing_file', 'non_frontal')) x GROUP BY 1""")
def _(spark, sf):
    return corpus.rejections(candidates(spark, sf))


@check("A2_first_record", views=("inventory",), sql="""
    SELECT split_part(path, '/', 4) AS subject, arg_min(path, study_id) AS path, count(*) AS n_records FROM inventory GROUP BY 1""")
def _(spark, sf):
    records_ = view(spark, sf, "inventory").withColumn("subject", F.split("path", "/")[3]).withColumn("ordinal", F.col("study_id"))
    return corpus.first_record(records_, "subject", "ordinal").select("subject", "path", "n_records")


@check("S9_existing_files", views=("inventory", "label_rows"), sql="""
    SELECT study_id, path FROM inventory WHERE study_id IN (SELECT study_id FROM label_rows)""")
def _(spark, sf):
    return corpus.existing(view(spark, sf, "inventory"), _files(spark, sf)).select("study_id", "path")


@check("S9_missing_files", views=("inventory", "label_rows"), sql="""
    SELECT study_id, path FROM inventory WHERE study_id NOT IN (SELECT study_id FROM label_rows)""")
def _(spark, sf):
    return corpus.missing(view(spark, sf, "inventory"), _files(spark, sf)).select("study_id", "path")


def _files(spark, sf):
    known = view(spark, sf, "label_rows").select("study_id").distinct()
    return view(spark, sf, "inventory").join(known, "study_id", "left_semi").select("path")


# --- context deduplication, stages --------------------------------------------

GROUPS = f"""{CONTEXT_CTES}, k AS (
    SELECT b.study_id, b.subject_id, concat_ws('|', b.subject_id::VARCHAR, coalesce(b.hadm_id::VARCHAR, ''), b.age::VARCHAR, b.sex,
           (SELECT coalesce(string_agg(r.kind || r.name || coalesce(r.value::VARCHAR, '') || coalesce(r.note, '') || coalesce(r.at::VARCHAR, ''), ';' ORDER BY r.kind, r.name), '') FROM rows_ r
            WHERE r.study_id = b.study_id AND (r.kind IN ('vital', 'lab')))) AS key FROM base b)"""


@check("W1_context_dedup_subject", views=CONTEXT_VIEWS, sql=f"""
    WITH {GROUPS} SELECT study_id, min(study_id) OVER (PARTITION BY subject_id) AS representative, count(*) OVER (PARTITION BY subject_id) AS n_same FROM k""")
def _(spark, sf):
    # only the ids decide, so only they are kept of the contexts
    return corpus.representative_map(stored(context(spark, sf).select("study_id", "subject_id"), "context"), by="subject")


@check("W1_context_dedup_full", views=CONTEXT_VIEWS, sql=f"""
    WITH {GROUPS} SELECT study_id, min(study_id) OVER (PARTITION BY key) AS representative, count(*) OVER (PARTITION BY key) AS n_same FROM k""")
def _(spark, sf):
    return corpus.representative_map(stored(context(spark, sf), "context"))


def _manifest_of_studies(spark, sf):
    return view(spark, sf, "studies").select(
        "study_id", "subject_id", F.concat(F.lit("p/s"), F.col("study_id").cast("string")).alias("image_path"),
        F.lit("IMPRESSION").alias("impression"), F.create_map(F.lit("Edema"), (F.col("study_id") % 2).cast("int")).alias("chexpert"))


@check("W2_stage_a", views=("studies",), sql="""
    SELECT study_id, 'p/s' || study_id::VARCHAR AS image_path, CAST(study_id % 2 AS INT) AS edema, 'A' AS stage FROM studies""")
def _(spark, sf):
    out = corpus.stage_a(_manifest_of_studies(spark, sf))
    return out.select("study_id", "image_path", F.col("chexpert_labels")["Edema"].alias("edema"), "stage")


@check("J4_stage_b", views=CONTEXT_VIEWS, sql=f"""
    WITH {CONTEXT_CTES}, r AS (SELECT study_id, min(study_id) OVER (PARTITION BY subject_id) AS representative FROM base)
    SELECT r.study_id, b.subject_id, b.age, b.sex, b.hadm_id, b.admission_type, 'B' AS stage,
           (SELECT count(*) FROM rows_ x WHERE x.study_id = r.representative AND kind = 'vital')::INT AS n_vitals,
           (SELECT count(*) FROM rows_ x WHERE x.study_id = r.representative AND kind = 'lab')::INT AS n_labs
    FROM r JOIN base b ON r.representative = b.study_id""")
def _(spark, sf):
    ctx = stored(context(spark, sf), "context")
    mapping = corpus.representative_map(ctx, by="subject")
    out = corpus.stage_b(_manifest_of_studies(spark, sf), mapping, corpus.deduplicate(ctx, mapping))
    p = F.col("patient_data")
    return out.select("study_id", "subject_id", p["Age"].alias("age"), p["Sex"].alias("sex"), p["hadm_id"].alias("hadm_id"),
                      p["admission_type"].alias("admission_type"), "stage", F.size(p["Vitals"]).alias("n_vitals"), F.size(p["Labs"]).alias("n_labs"))


# --- split, mix, samples ------------------------------------------------------

@check("W3_patient_split", views=("samples",), sql="""
    WITH g AS (SELECT subject_id, row_number() OVER (ORDER BY md5('42:' || subject_id::VARCHAR), subject_id) AS rn, count(*) OVER () AS n
               FROM (SELECT DISTINCT subject_id FROM samples) x)
    SELECT s.sample_id, s.stage, CASE WHEN g.rn <= floor(g.n * 0.15::DOUBLE + 1e-9) THEN 'val' ELSE 'train' END AS split
    FROM samples s JOIN g ON s.subject_id = g.subject_id""")
def _(spark, sf):
    return corpus.with_split(view(spark, sf, "samples")).select("sample_id", "stage", "split")


@check("W4_union_shuffle", views=("samples",), sql="""
    SELECT sample_id, stage, row_number() OVER (ORDER BY md5('42:' || sample_id::VARCHAR), sample_id) AS position FROM samples""")
def _(spark, sf):
    from clinprep.operators.scaling import seeded_rank
    s = view(spark, sf, "samples")
    both = corpus.by_stage(s, "stage_a").unionByName(corpus.by_stage(s, "stage_b"))
    return seeded_rank(both, "sample_id", 42, out="position").select("sample_id", "stage", "position")


@check("W4_shuffled_order", views=("samples",), sql="""
    SELECT sample_id, stage, row_number() OVER (ORDER BY md5('42:' || sample_id::VARCHAR), sample_id) AS position FROM samples""")
def _(spark, sf):
    # where a row stands: its place in its part of the sorted output, after the parts before
    order = corpus.shuffled(view(spark, sf, "samples"), "sample_id").select("sample_id", "stage", F.monotonically_increasing_id().alias("id"))
    placed = stored(order, "order").withColumn("part", F.shiftright("id", 33))
    parts = placed.groupBy("part").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = parts.select("part", "first", before.alias("before"))
    return placed.join(F.broadcast(offsets), "part").select("sample_id", "stage", (F.col("before") + F.col("id") - F.col("first") + 1).alias("position"))


DEMO_SQL = """
    WITH r AS (SELECT sample_id, stage, row_number() OVER (PARTITION BY stage ORDER BY md5('42:' || sample_id::VARCHAR), sample_id) AS n FROM samples)
    SELECT sample_id, stage, 'demo_' || lower(stage) || '_' || printf('%03d', n) AS demo_id,
           CASE WHEN stage = 'B' THEN 'demo_ehr/demo_b_' || printf('%03d', n) || '_ehr.json' END AS ehr_json_path FROM r WHERE n <= {n}"""


@check("W5_demo_sample", views=("samples",), sql=DEMO_SQL.format(n=40))
def _(spark, sf):
    return corpus.demo_sample(view(spark, sf, "samples"), "sample_id").select("sample_id", "stage", "demo_id", "ehr_json_path")


@check("W5_demo_sample_large", views=("samples",), sql=DEMO_SQL.format(n=2000))
def _(spark, sf):
    return corpus.demo_sample(view(spark, sf, "samples"), "sample_id", n_per_stage=2000).select("sample_id", "stage", "demo_id", "ehr_json_path")


@check("W7_strip_minimal", views=RECORD_VIEWS, sql="SELECT study_id, age, CASE WHEN age IS NOT NULL THEN sex END AS sex FROM rec")
def _(spark, sf):
    out = records(spark, sf).withColumn("p", corpus.strip_patient(F.col("patient_data")))
    return out.select("study_id", F.col("p.Age").alias("age"), F.col("p.Sex").alias("sex"))


@check("W7_strip_defaults", views=RECORD_VIEWS, sql="""
    SELECT study_id, CASE WHEN age IS NULL THEN 0 ELSE study_id END AS subject_id, coalesce(age, 0) AS age,
           CASE WHEN age IS NULL THEN 'Unknown' ELSE sex END AS sex, 0 AS measurements FROM rec""")
def _(spark, sf):
    out = records(spark, sf).withColumn("p", corpus.strip_patient(F.col("patient_data"), keep_containers=True))
    n = F.coalesce(F.size("p.Vitals"), F.lit(0)) + F.coalesce(F.size("p.Labs"), F.lit(0)) + F.size("p.Chronic_conditions")
    return out.select("study_id", F.col("p.subject_id").alias("subject_id"), F.col("p.Age").alias("age"), F.col("p.Sex").alias("sex"), n.alias("measurements"))


MIX_SQL = """
    WITH c AS (SELECT count(*) FILTER (stage = 'A') AS na, count(*) FILTER (stage = 'B') AS nb,
                      count(*) FILTER (stage = 'B' AND n_vitals <= 2 AND n_labs <= 2) AS nl FROM samples),
    pool AS (SELECT s.sample_id FROM samples s, c WHERE stage = 'B' AND (c.nl < c.na OR (n_vitals <= 2 AND n_labs <= 2))),
    syn AS (SELECT sample_id, row_number() OVER (ORDER BY md5('7s:' || sample_id::VARCHAR)) AS rn, count(*) OVER () AS n FROM pool),
    keep AS (SELECT sample_id, row_number() OVER (ORDER BY md5('7b:' || sample_id::VARCHAR)) AS rn FROM samples WHERE stage = 'B')
    SELECT sample_id, 'A' AS part FROM samples WHERE stage = 'A'
    UNION ALL SELECT sample_id, 'synthetic' FROM syn, c WHERE rn <= least(syn.n, c.na)
    UNION ALL SELECT sample_id, 'B' FROM keep, c WHERE rn <= greatest(1, floor(c.nb * 0.65::DOUBLE + 1e-9))"""


@check("W8_epoch_mix", views=("samples",), sql=MIX_SQL)
def _(spark, sf):
    low = (F.col("n_vitals") <= 2) & (F.col("n_labs") <= 2)
    return corpus.epoch_mix(view(spark, sf, "samples"), "sample_id", low, seed=5, epoch=2).select("sample_id", "part")


# --- weights ------------------------------------------------------------------

FREQ = "f AS (SELECT condition AS name, count(*) AS n FROM weighted WHERE stage = 'B' GROUP BY 1)"
# an uneven spread of conditions, so that the boost for rare classes applies
WEIGHTED = """weighted AS (SELECT sample_id, stage, n_labs, CASE WHEN sample_id % 40 = 0 THEN 'rare' WHEN sample_id % 7 = 0 THEN 'some' ELSE 'common' END AS condition FROM samples)"""
WEIGHTS = """w AS (SELECT name, n, CASE WHEN n < 0.1 * max(n) OVER () THEN 3 ELSE 1 END * sqrt(max(n) OVER () / n::DOUBLE) AS weight FROM f)"""


def weighted(spark, sf):
    name = F.when(F.col("sample_id") % 40 == 0, "rare").when(F.col("sample_id") % 7 == 0, "some").otherwise("common")
    return view(spark, sf, "samples").select("sample_id", "stage", "n_labs", name.alias("condition"),
                                             F.create_map(F.lit("Edema"), F.lit(1), F.lit("Fracture"), (F.col("n_labs") == 2).cast("int"),
                                                          F.lit("Pneumothorax"), (F.col("n_labs") >= 3).cast("int")).alias("labels"))


def condition_weights(spark, sf):
    return corpus.class_weights(profile.condition_frequencies(weighted(spark, sf), F.array("condition")), 3.0)


@check("A17_condition_frequencies", views=("samples",), sql=f"WITH {WEIGHTED}, {FREQ} SELECT name, n FROM f")
def _(spark, sf):
    return profile.condition_frequencies(weighted(spark, sf), F.array("condition"))


@check("A17_positive_frequencies", views=("samples",), sql="""
    SELECT name, n FROM (SELECT 'Edema' AS name, count(*) AS n FROM samples WHERE stage = 'B'
        UNION ALL SELECT 'Fracture', count(*) FROM samples WHERE stage = 'B' AND n_labs = 2
        UNION ALL SELECT 'Pneumothorax', count(*) FROM samples WHERE stage = 'B' AND n_labs >= 3) x""")
def _(spark, sf):
    return profile.positive_frequencies(weighted(spark, sf), "labels")


@check("W9_class_weights", views=("samples",), sql=f"""
    WITH {WEIGHTED}, {FREQ}, {WEIGHTS} SELECT name, n, round(weight, 6) AS weight FROM w""")
def _(spark, sf):
    return condition_weights(spark, sf).withColumn("weight", F.round("weight", 6))


LABEL_WEIGHTS = """
    lf AS (SELECT 'Edema' AS name, count(*) AS n FROM weighted WHERE stage = 'B' UNION ALL SELECT 'Fracture', count(*) FROM weighted WHERE stage = 'B' AND n_labs = 2
           UNION ALL SELECT 'Pneumothorax', count(*) FROM weighted WHERE stage = 'B' AND n_labs >= 3),
    lw AS (SELECT name, CASE WHEN n < 0.1 * max(n) OVER () THEN 2 ELSE 1 END * sqrt(max(n) OVER () / n::DOUBLE) AS weight FROM lf),
    raw AS (SELECT s.sample_id, w.weight * (SELECT weight FROM lw WHERE name = 'Edema')
                * CASE WHEN n_labs = 2 THEN (SELECT weight FROM lw WHERE name = 'Fracture') ELSE 1 END
                * CASE WHEN n_labs >= 3 THEN (SELECT weight FROM lw WHERE name = 'Pneumothorax') ELSE 1 END AS r
            FROM weighted s JOIN w ON s.condition = w.name WHERE s.stage = 'B')"""


def row_weights(spark, sf):
    b = weighted(spark, sf).where("stage = 'B'")
    positives = F.map_keys(F.map_filter("labels", lambda _, v: v == 1))
    finding = corpus.class_weights(profile.positive_frequencies(weighted(spark, sf), "labels"), 2.0)
    return corpus.row_weights(b, [(F.array("condition"), condition_weights(spark, sf)), (positives, finding)])


@check("W10_row_weights", views=("samples",), sql=f"""
    WITH {WEIGHTED}, {FREQ}, {WEIGHTS}, {LABEL_WEIGHTS}
    SELECT sample_id, round(r, 6) AS raw_weight, round(r / (SELECT sum(r) FROM raw) * 1000000, 4) AS weight_ppm FROM raw""")
def _(spark, sf):
    return row_weights(spark, sf).select("sample_id", F.round("raw_weight", 6).alias("raw_weight"), F.round(F.col("weight") * 1000000, 4).alias("weight_ppm"))


@check("W11_rare_label_weights", views=("samples",), sql="""
    WITH r AS (SELECT sample_id, CASE WHEN n_labs = 2 THEN 5.0::DOUBLE WHEN n_labs >= 3 THEN 25.0::DOUBLE ELSE 1.0::DOUBLE END AS w FROM samples)
    SELECT sample_id, round(w / (SELECT avg(w) FROM r), 6) AS weight FROM r""")
def _(spark, sf):
    base = weighted(spark, sf).withColumn("icd", F.create_map(F.lit("Pneumothorax"), (F.col("n_labs") >= 3).cast("int")))
    return corpus.rare_label_weights(base, "labels", "icd").select("sample_id", F.round("weight", 6).alias("weight"))


# each draw falls into the span of one item on the cumulative weights
@check("W12_weighted_draws", views=("samples",), sql=f"""
    WITH {WEIGHTED}, {FREQ}, {WEIGHTS}, {LABEL_WEIGHTS},
    o AS (SELECT sample_id, r / (SELECT sum(r) FROM raw) AS w, md5('42:' || sample_id::VARCHAR) AS h FROM raw),
    c AS (SELECT sample_id, sum(w) OVER (ORDER BY h, sample_id ROWS UNBOUNDED PRECEDING) AS high FROM o),
    d AS (SELECT sample_id AS draw, ('0x' || substr(md5('42:' || sample_id::VARCHAR), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u FROM samples)
    SELECT d.draw, c.sample_id FROM d ASOF JOIN c ON d.u < c.high""")
def _(spark, sf):
    items = row_weights(spark, sf).select("sample_id", "weight")
    # as many draws as there are samples: one per row of the table
    draws = view(spark, sf, "samples").select(F.col("sample_id").alias("draw")).withColumn("u", corpus.uniform(42, "draw"))
    return corpus.weighted_draws(items, "sample_id", draws)


@check("W12_cumulative_weight", views=("samples",), sql=f"""
    WITH {WEIGHTED}, {FREQ}, {WEIGHTS}, {LABEL_WEIGHTS},
    o AS (SELECT sample_id, r / (SELECT sum(r) FROM raw) AS w, md5('42:' || sample_id::VARCHAR) AS h FROM raw)
    SELECT sample_id, round(sum(w) OVER (ORDER BY h, sample_id ROWS UNBOUNDED PRECEDING), 6) AS high FROM o""")
def _(spark, sf):
    items = row_weights(spark, sf).select("sample_id", "weight")
    return corpus.cumulative_weight(items, "sample_id").select("sample_id", F.round("high", 6).alias("high"))


# --- curriculum ---------------------------------------------------------------

# the number of steps grows with the samples: one step per 32 of them
SCHEDULE_SQL = """
    WITH t AS (SELECT count(*) // 32 AS steps FROM samples),
    p AS (SELECT i AS step, i / t.steps::DOUBLE AS progress FROM t, generate_series(0, t.steps - 1) AS g(i))
    SELECT step, floor({a} * 32)::BIGINT AS n_a, floor({s} * 32)::BIGINT AS n_synthetic,
           32 - floor({a} * 32)::BIGINT - floor({s} * 32)::BIGINT AS n_b FROM p"""


def _steps(spark, sf):
    return view(spark, sf, "samples").select(F.expr("count(*) div 32")).scalar()


@check("W13_schedule", views=("samples",), sql=SCHEDULE_SQL.format(
    a="CASE WHEN progress < 0.5 THEN 0.5::DOUBLE ELSE 0.2::DOUBLE END", s="CASE WHEN progress < 0.5 THEN 0.2::DOUBLE ELSE 0.1::DOUBLE END"))
def _(spark, sf):
    return corpus.schedule(spark, _steps(spark, sf), 32)


@check("W13_schedule_steps", views=("samples",), sql=SCHEDULE_SQL.format(
    a="CASE WHEN progress < 0.15 THEN 0.2::DOUBLE WHEN progress < 0.4 THEN 0.15::DOUBLE ELSE 0.12::DOUBLE END",
    s="CASE WHEN progress < 0.15 THEN 0.05::DOUBLE WHEN progress < 0.4 THEN 0.03::DOUBLE ELSE 0.01::DOUBLE END"))
def _(spark, sf):
    return corpus.schedule(spark, _steps(spark, sf), 32, early=None)


@check("W13_batches", views=("samples",), sql=f"""
    WITH s AS ({SCHEDULE_SQL.format(a="CASE WHEN progress < 0.5 THEN 0.5::DOUBLE ELSE 0.2::DOUBLE END", s="CASE WHEN progress < 0.5 THEN 0.2::DOUBLE ELSE 0.1::DOUBLE END")})
    SELECT step, 'A' AS part, n_a AS n, n_a AS n_distinct FROM s UNION ALL SELECT step, 'synthetic', n_synthetic, n_synthetic FROM s
    UNION ALL SELECT step, 'B', n_b, NULL FROM s""")
def _(spark, sf):
    s = view(spark, sf, "samples")
    out = corpus.batches(corpus.schedule(spark, _steps(spark, sf), 32), s, "sample_id", row_weights(spark, sf).select("sample_id", "weight"))
    counted = out.groupBy("step", "part").agg(F.count("*").alias("n"), F.count_distinct("sample_id").alias("d"))
    return counted.select("step", "part", "n", F.when(F.col("part") != "B", F.col("d")).alias("n_distinct"))


# --- profiles -----------------------------------------------------------------

@check("A14_stage_coverage", views=RECORD_VIEWS, sql="""
    WITH b AS (SELECT * FROM rec WHERE stage = 'B'), t AS (SELECT count(*) AS n FROM b),
    m AS (SELECT 'total' AS metric, 'any' AS name, count(*) AS n FROM b
          UNION ALL SELECT 'with_vitals', 'any', count(*) FROM b WHERE n_vitals > 0
          UNION ALL SELECT 'with_labs', 'any', count(*) FROM b WHERE n_labs > 0
          UNION ALL SELECT 'with_chronic', 'any', count(*) FROM b WHERE age IS NOT NULL
          UNION ALL SELECT 'vital', v.vital, count(*) FROM b JOIN rec_vitals v ON b.study_id = v.study_id GROUP BY 2
          UNION ALL SELECT 'lab', l.lab, count(*) FROM b JOIN rec_labs l ON b.study_id = l.study_id GROUP BY 2)
    SELECT metric, name, m.n, round(100.0::DOUBLE * m.n / t.n, 4) AS percent FROM m, t""")
def _(spark, sf):
    return profile.stage_coverage(records(spark, sf))
