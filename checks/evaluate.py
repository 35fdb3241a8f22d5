"""Parsing and scoring: V1-V13, J10, J11, S6."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.bindings import view
from checks.registry import check
from clinprep import vocab
from clinprep.operators import evaluate as ev
from clinprep.sources import files

# --- parsing ------------------------------------------------------------------

@check("V1_parse_blocks", views=("generated",), sql=r"""
    WITH b AS (SELECT study_id, turn, output, regexp_extract(output, '(?is)CheXpert:\s*(\{.*?\})', 1) AS f,
                      regexp_extract(output, '(?is)ICD:\s*(\{.*?\})', 1) AS i FROM generated)
    SELECT study_id, turn, trim(regexp_extract(output, '(?is)Impression:\s*(.*?)(?:\n\n|\nCheXpert:|\z)', 1), ' ' || chr(10)) AS impression,
           CASE WHEN json_valid(f) AND NOT regexp_matches(f, ',\s*\}') THEN json_extract_string(f, '$.Edema') END AS edema,
           CASE WHEN json_valid(i) THEN json_extract_string(i, '$.Pneumonia') END AS pneumonia FROM b""")
def _(spark, sf):
    out = ev.parse_blocks(view(spark, sf, "generated"))
    return out.select("study_id", "turn", "impression", F.try_element_at("findings", F.lit("Edema")).alias("edema"),
                      F.try_element_at("icd", F.lit("Pneumonia")).alias("pneumonia"))


@check("V1_parse_numbered", views=("generated",), sql=r"""
    WITH b AS (SELECT study_id, turn, output, regexp_extract(output, '(?s)2\) CheXpert:\s*(\{.*?\})', 1) AS f FROM generated)
    SELECT study_id, turn, CASE WHEN contains(output, '1) IMPRESSION:')
                THEN trim(regexp_extract(output, '(?s)1\) IMPRESSION:\s*(.+?)(?:\n\n|\n2\)|\z)', 1), ' ' || chr(10)) ELSE '' END AS impression,
           CASE WHEN json_valid(f) AND NOT regexp_matches(f, ',\s*\}') THEN json_extract_string(f, '$.Edema') END AS edema FROM b""")
def _(spark, sf):
    out = ev.parse_blocks(view(spark, sf, "generated"), variant="numbered")
    return out.select("study_id", "turn", "impression", F.try_element_at("findings", F.lit("Edema")).alias("edema"))


# one in four studies has values that are no numbers, one in eleven repeats a key
OBJECT = """SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'A' ELSE 'B' END AS stage,
    concat('Answer: ', CASE WHEN conv_id % 5 = 0 THEN 'none' ELSE concat('{{"impression": "', CASE WHEN conv_id % 3 = 0 THEN '' ELSE concat(' said ', CAST(turn AS {t})) END,
    '", "chexpert": {{"Edema": ', CASE WHEN conv_id % 11 = 0 THEN '7, "Edema": ' ELSE '' END, CAST(turn % 3 - 1 AS {t}),
    ', "Fracture": ', CASE CAST(conv_id % 4 AS INT) WHEN 0 THEN '"yes"' WHEN 1 THEN 'true' WHEN 2 THEN 'NaN' ELSE '"1"' END, '}}, "icd": {{"Pneumonia": ', CAST(turn AS {t}), CASE WHEN conv_id % 7 = 0 THEN ',' ELSE '' END, '}}}} tail }} {{') END, text) AS output
    FROM {c}"""


@check("V2_parse_object", sql=f"""
    WITH o AS ({OBJECT.format(t='VARCHAR', c='conversations')}), v AS (SELECT *, conv_id % 5 <> 0 AND conv_id % 7 <> 0 AS valid FROM o)
    SELECT conv_id, turn, valid, CASE WHEN valid AND conv_id % 3 <> 0 THEN 'said ' || turn::VARCHAR ELSE trim(output, ' ' || chr(10)) END AS impression,
           CAST(CASE WHEN valid THEN sign(turn % 3 - 1) ELSE 0 END AS INT) AS edema, CAST(CASE WHEN valid AND conv_id % 4 = 1 THEN 1 ELSE 0 END AS INT) AS fracture,
           CAST(CASE WHEN valid AND stage = 'B' AND turn > 0 THEN 1 ELSE 0 END AS INT) AS pneumonia FROM v""")
def _(spark, sf):
    texts = spark.sql(OBJECT.format(t="STRING", c=f"parquet.`{sf}/conversations.parquet`"))
    out = ev.parse_object(texts)
    return out.select("conv_id", "turn", "valid", "impression", F.col("findings")["Edema"].alias("edema"),
                      F.col("findings")["Fracture"].alias("fracture"), F.col("icd")["Pneumonia"].alias("pneumonia"))


@check("V3_json_validity", views=("generated",), sql=r"""
    SELECT turn, round(avg(CASE WHEN json_valid(regexp_extract(output, '(?is)CheXpert:\s*(\{.*?\})', 1)) AND NOT regexp_matches(regexp_extract(output, '(?is)CheXpert:\s*(\{.*?\})', 1), ',\s*\}') THEN 1.0::DOUBLE ELSE 0 END), 6) AS chexpert_valid_rate,
           round(avg(CASE WHEN NOT contains(output, 'ICD:') OR json_valid(regexp_extract(output, '(?is)ICD:\s*(\{.*?\})', 1)) THEN 1.0::DOUBLE ELSE 0 END), 6) AS icd_valid_rate
    FROM generated GROUP BY turn""")
def _(spark, sf):
    out = ev.json_validity(view(spark, sf, "generated"), by=["turn"])
    return out.select("turn", *[F.round(c, 6).alias(c) for c in ("chexpert_valid_rate", "icd_valid_rate")])


@check("V4_json_repair", views=("generated",), sql=r"""
    WITH r AS (SELECT study_id, turn, output, CASE WHEN study_id % 2 = 0 THEN 0 ELSE 1 END AS good FROM generated)
    SELECT study_id, turn, CASE WHEN good = 1 THEN regexp_replace(regexp_replace(output, '(?s)2\) CheXpert: \{.*?\}', '2) CheXpert: {"Edema": 9, "k": "$1"}', 'g'),
           '(?s)3\) ICD: \{.*?\}', '3) ICD: {"Pneumonia": 0}', 'g') ELSE output END AS repaired FROM r""")
def _(spark, sf):
    g = view(spark, sf, "generated")
    fixes = g.select("study_id", "turn", F.when(F.col("study_id") % 2 == 0, F.lit('2) CheXpert: {"Edema": 9,} 3) ICD: {"Pneumonia": 0}')).otherwise(
        F.lit('2) CheXpert: {"Edema": 9, "k": "$1"}\n3) ICD: {"Pneumonia": 0}')).alias("repair"))
    return ev.repair(g, fixes, ["study_id", "turn"]).select("study_id", "turn", "repaired")


# --- text scores --------------------------------------------------------------

WORDS = "list_filter(string_split(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: x <> '')"
TOKENS = r"list_filter(regexp_split_to_array({0}, '[\s\x{{1c}}-\x{{1f}}\x{{85}}\x{{a0}}]+'), lambda x: x <> '')"


def _grams(orders):
    parts = []
    for side in ("r", "p"):
        for n in orders:
            gram = " || ' ' || ".join(f"{side}[i + {k}]" for k in range(n))
            parts.append(f"SELECT conv_id, turn, {n} AS n, unnest(list_transform(range(1, len({side}) - {n} + 2), lambda i: {gram})) AS gram, '{side}' AS side FROM w")
    return f"""g AS ({' UNION ALL '.join(parts)}),
    c AS (SELECT conv_id, turn, n, gram, count(*) FILTER (side = 'r') AS r, count(*) FILTER (side = 'p') AS p FROM g GROUP BY ALL),
    o AS (SELECT conv_id, turn, n, sum(least(r, p))::DOUBLE AS hit, sum(r)::DOUBLE AS r, sum(p)::DOUBLE AS p FROM c GROUP BY ALL)"""


ROUGE_SQL = f"""
    WITH w AS (SELECT conv_id, turn, {WORDS.format('reference')} AS r, {WORDS.format('prediction')} AS p FROM pairs), {_grams([1, 2])},
    f AS (SELECT conv_id, turn, n, CASE WHEN hit > 0 THEN 2 * hit / (r + p) ELSE 0 END AS f FROM o)
    SELECT w.conv_id, w.turn, round(coalesce(a.f, 0), 6) AS rouge1, round(coalesce(b.f, 0), 6) AS rouge2
    FROM w LEFT JOIN f a ON w.conv_id = a.conv_id AND w.turn = a.turn AND a.n = 1 LEFT JOIN f b ON w.conv_id = b.conv_id AND w.turn = b.turn AND b.n = 2"""


@check("V5_rouge", views=("pairs",), sql=ROUGE_SQL)
def _(spark, sf):
    out = ev.rouge_n(view(spark, sf, "pairs"), ["conv_id", "turn"])
    return out.select("conv_id", "turn", F.round("rouge1", 6).alias("rouge1"), F.round("rouge2", 6).alias("rouge2"))


@check("V5_rouge_mean", views=("pairs",), sql=f"""
    SELECT round(avg(rouge1), 5) AS rouge1, round(avg(rouge2), 5) AS rouge2 FROM ({ROUGE_SQL}) q""")
def _(spark, sf):
    out = ev.rouge_n(view(spark, sf, "pairs"), ["conv_id", "turn"])
    return out.agg(F.round(F.avg("rouge1"), 5).alias("rouge1"), F.round(F.avg("rouge2"), 5).alias("rouge2"))


# the last row of the table of common subsequence lengths, folded word by word
@check("V6_rouge_l", views=("pairs",), sql=f"""
    WITH w AS (SELECT conv_id, turn, {WORDS.format('reference')} AS r, {WORDS.format('prediction')} AS p FROM pairs),
    l AS (SELECT conv_id, turn, len(r) AS nr, len(p) AS np, CASE WHEN len(r) = 0 OR len(p) = 0 THEN 0 ELSE list_reduce(
            list_prepend(list_transform(range(0, len(p) + 1), lambda k: 0::BIGINT), list_transform(r, lambda x: [hash(x) % 9007199254740993])),
            lambda row, x: list_reduce(list_prepend([0::BIGINT], list_transform(range(1, len(p) + 1), lambda k: [k])),
              lambda done, k: list_append(done, greatest(done[len(done)], row[k[1] + 1], CASE WHEN hash(p[k[1]]) % 9007199254740993 = x[1] THEN row[k[1]] + 1 ELSE 0 END)))
          )[-1] END AS hit FROM w)
    SELECT conv_id, turn, round(CASE WHEN hit > 0 THEN 2.0::DOUBLE * hit / (nr + np) ELSE 0 END, 6) AS rougeL FROM l""")
def _(spark, sf):
    out = ev.rouge_l(view(spark, sf, "pairs"), ["conv_id", "turn"])
    return out.select("conv_id", "turn", F.round("rougeL", 6).alias("rougeL"))


def _bleu_sql(lower):
    def text(c):
        return f"lower({c})" if lower else c
    return f"""
    WITH w AS (SELECT conv_id, turn, {TOKENS.format(text('reference'))} AS r, {TOKENS.format(text('prediction'))} AS p FROM pairs), {_grams([1, 2, 3, 4])},
    k AS (SELECT w.conv_id, w.turn, len(w.r)::DOUBLE AS lr, len(w.p)::DOUBLE AS lp, n.n FROM w, range(1, 5) AS n(n)),
    l AS (SELECT k.*, coalesce(o.hit, 0) AS hit, ln(CASE WHEN coalesce(o.hit, 0) = 0 THEN 0.1::DOUBLE ELSE o.hit END / greatest(1, coalesce(o.p, 0))) * 0.25 AS part
          FROM k LEFT JOIN o ON k.conv_id = o.conv_id AND k.turn = o.turn AND k.n = o.n)
    SELECT conv_id, turn, round(CASE WHEN max(hit) FILTER (n = 1) = 0 THEN 0 ELSE CASE WHEN any_value(lp) > any_value(lr) THEN 1 ELSE exp(1 - any_value(lr) / any_value(lp)) END * exp(sum(part)) END, 6) AS bleu
    FROM l GROUP BY 1, 2"""


@check("V7_bleu", views=("pairs",), sql=_bleu_sql(False))
def _(spark, sf):
    return ev.bleu(view(spark, sf, "pairs"), ["conv_id", "turn"]).withColumn("bleu", F.round("bleu", 6))


@check("V7_bleu_lower", views=("pairs",), sql=_bleu_sql(True))
def _(spark, sf):
    return ev.bleu(view(spark, sf, "pairs"), ["conv_id", "turn"], lower=True).withColumn("bleu", F.round("bleu", 6))


# --- label metrics ------------------------------------------------------------

NAMES = ["No Finding", "Edema", "Pneumonia", "Pneumothorax", "Pleural Effusion", "Fracture", "Support Devices", "Lung Opacity"]
# the same rows read as diagnoses: one condition for each finding name
CONDITIONS = {"No Finding": "pneumonia", "Edema": "pleural_effusion", "Pneumonia": "pneumothorax", "Pneumothorax": "pulmonary_embolism",
              "Pleural Effusion": "chf_exacerbation", "Fracture": "pulmonary_edema", "Support Devices": "rib_fracture", "Lung Opacity": "lung_mass"}
VOTE_VIEWS = ("votes", "truth_rows", "pred_rows")


def runs(spark, sf, names=NAMES, eligible=False, rename=None):
    """Truth beside the predictions of both runs."""
    truth, pred = view(spark, sf, "truth_rows"), view(spark, sf, "pred_rows")
    if rename:
        label = F.create_map(*[F.lit(x) for pair in rename.items() for x in pair])[F.col("label")]
        truth, pred = truth.withColumn("label", label), pred.withColumn("label", label)
    return ev.attach_truth(truth, pred, names, eligible=eligible)


TRUTH = f"""n AS (SELECT unnest({NAMES}) AS label), r AS (SELECT unnest([1, 2])::INT AS run),
    y AS (SELECT DISTINCT study_id, stage FROM truth_rows), z AS (SELECT DISTINCT study_id, run FROM pred_rows),
    t AS (SELECT y.study_id, y.stage, r.run, n.label, a.truth, p.value AS pred, z.run IS NOT NULL AS predicted
          FROM y CROSS JOIN r CROSS JOIN n LEFT JOIN truth_rows a ON a.study_id = y.study_id AND a.label = n.label
          LEFT JOIN pred_rows p ON p.study_id = y.study_id AND p.run = r.run AND p.label = n.label
          LEFT JOIN z ON z.study_id = y.study_id AND z.run = r.run)"""
PRF = """round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp)::DOUBLE ELSE 0 END, 6) AS {0}precision, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn)::DOUBLE ELSE 0 END, 6) AS {0}recall,
         round(CASE WHEN tp > 0 THEN 2 * tp / (2 * tp + fp + fn)::DOUBLE ELSE 0 END, 6) AS {0}f1"""
COUNTS = """count(*) FILTER (coalesce(truth, 0) = 1 AND coalesce(pred, 0) = 1) AS tp, count(*) FILTER (coalesce(truth, 0) <> 1 AND coalesce(pred, 0) = 1) AS fp,
         count(*) FILTER (coalesce(truth, 0) = 1 AND coalesce(pred, 0) <> 1) AS fn"""


def rounded(df, keep, digits=6):
    return df.select(*keep, *[F.round(c, digits).alias(c) for c in df.columns if c not in keep])


@check("J10_attach_truth", views=VOTE_VIEWS, sql=f"WITH {TRUTH} SELECT study_id, stage, run, label, truth, pred FROM t")
def _(spark, sf):
    return runs(spark, sf)


MICRO_SQL = f"""
    WITH {TRUTH}, e AS (SELECT * FROM t WHERE predicted),
    s AS (SELECT run, 'stage' || stage AS scope, truth, pred FROM e UNION ALL SELECT run, 'overall', truth, pred FROM e),
    c AS (SELECT run, scope, {COUNTS} FROM s GROUP BY 1, 2) SELECT run, scope, {PRF.format('micro_')} FROM c"""


@check("V8_micro_scores", views=VOTE_VIEWS, sql=MICRO_SQL)
def _(spark, sf):
    return rounded(ev.micro_scores(runs(spark, sf, eligible=True), ["run"]), ["run", "scope"])


MACRO = f"""
    WITH {TRUTH}, c AS (SELECT run, label, {COUNTS} FROM t WHERE {{where}} GROUP BY 1, 2), s AS (SELECT run, label, {PRF.format('')} FROM c)"""


@check("V9_finding_macro_f1", views=VOTE_VIEWS, sql=MACRO.format(where="truth <> -1") + " SELECT run, label, precision, recall, f1 FROM s")
def _(spark, sf):
    # findings as words, as the reports of a run give them
    def word(c):
        return ev.word_value(F.when(F.col(c) == 1, "Positive").when(F.col(c) == 0, "Negative").when(F.col(c) == -1, "Uncertain"))
    rows = runs(spark, sf).withColumn("truth", word("truth")).withColumn("pred", word("pred"))
    return rounded(ev.label_scores(rows, ["run"], skip_uncertain=True), ["run", "label"])


@check("V10_icd_macro_f1", views=VOTE_VIEWS, sql=MACRO.format(where="true") + """
    SELECT run, round(avg(precision), 5) AS macro_precision, round(avg(recall), 5) AS macro_recall, round(avg(f1), 5) AS macro_f1 FROM s GROUP BY 1""")
def _(spark, sf):
    rows = runs(spark, sf, vocab.ICD_CONDITIONS, rename=CONDITIONS)
    return rounded(ev.macro_scores(ev.label_scores(rows, ["run"]), ["run"]), ["run"], 5)


ACCURACY = "avg(CASE WHEN coalesce(truth, 0) = coalesce(pred, 0) THEN 1.0::DOUBLE ELSE 0 END)"


@check("V11_sample_accuracy", views=VOTE_VIEWS, sql=f"""
    WITH {TRUTH} SELECT study_id, run, round({ACCURACY}, 6) AS accuracy, count(*) AS n_labels FROM t GROUP BY 1, 2""")
def _(spark, sf):
    return rounded(ev.sample_accuracy(runs(spark, sf), ["study_id", "run"]), ["study_id", "run", "n_labels"])


@check("V11_class_hits", views=VOTE_VIEWS, sql=f"""
    WITH {TRUTH} SELECT run, label, round({ACCURACY}, 6) AS hit_rate FROM t GROUP BY 1, 2""")
def _(spark, sf):
    return rounded(ev.class_hits(runs(spark, sf), ["run"]), ["run", "label"])


@check("V12_metric_summary", views=VOTE_VIEWS, sql=f"""
    WITH {TRUTH}, a AS (SELECT study_id, run, stage, {ACCURACY} AS accuracy, study_id % 9 <> 0 AS ok FROM t GROUP BY 1, 2, 3),
    s AS (SELECT 'overall' AS scope, * FROM a UNION ALL SELECT 'stage_' || lower(stage), * FROM a)
    SELECT run, scope, count(*) AS total_samples, count(*) FILTER (ok) AS successful_samples, count(*) FILTER (NOT ok) AS failed_samples,
           round(avg(accuracy) FILTER (ok), 6) AS accuracy, round(stddev_pop(accuracy) FILTER (ok), 6) AS accuracy_std FROM s GROUP BY 1, 2""")
def _(spark, sf):
    scored = ev.sample_accuracy(runs(spark, sf), ["study_id", "stage", "run"])
    out = ev.metric_summary(scored.withColumn("success", F.col("study_id") % 9 != 0), ["accuracy"], by=["run"])
    return rounded(out, ["run", "scope", "total_samples", "successful_samples", "failed_samples"])


AB = f"""
    WITH {TRUTH}, c AS (SELECT run, label, {COUNTS} FROM t GROUP BY 1, 2),
    s AS (SELECT run, label, CASE WHEN tp + fp > 0 THEN tp / (tp + fp)::DOUBLE ELSE 0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn)::DOUBLE ELSE 0 END AS r,
                 CASE WHEN tp > 0 THEN 2 * tp / (2 * tp + fp + fn)::DOUBLE ELSE 0 END AS f FROM c),
    j AS (SELECT a.label, a.f AS f1_off, b.f AS f1_on, a.p AS precision_off, b.p AS precision_on, a.r AS recall_off, b.r AS recall_on
          FROM s a JOIN s b ON a.label = b.label AND a.run = 1 AND b.run = 2)"""


@check("V13_compare_runs", views=VOTE_VIEWS, sql=AB + """
    SELECT label, round(f1_off, 6) AS f1_off, round(f1_on, 6) AS f1_on, round(precision_off, 6) AS precision_off, round(precision_on, 6) AS precision_on,
           round(recall_off, 6) AS recall_off, round(recall_on, 6) AS recall_on, round(f1_on - f1_off, 6) AS delta_f1 FROM j""")
def _(spark, sf):
    return rounded(ev.compare_runs(runs(spark, sf), 1, 2), ["label"])


MACRO_AB = AB + """
    SELECT round(avg(f1_off), 6) AS macro_f1_off, round(avg(f1_on), 6) AS macro_f1_on, round(avg(precision_off), 6) AS macro_precision_off,
           round(avg(precision_on), 6) AS macro_precision_on, round(avg(recall_off), 6) AS macro_recall_off, round(avg(recall_on), 6) AS macro_recall_on,
           round(avg(f1_on) - avg(f1_off), 6) AS macro_f1_delta FROM j"""


@check("V13_compare_macro", views=VOTE_VIEWS, sql=MACRO_AB)
def _(spark, sf):
    return rounded(ev.compare_macro(ev.compare_runs(runs(spark, sf), 1, 2)), [])


@check("J11_differing_labels", views=("votes",), sql="""
    SELECT a.study_id, a.label, a.value AS value_off, b.value AS value_on FROM votes a JOIN votes b
    ON a.study_id = b.study_id AND a.label = b.label AND a.run = 1 AND b.run = 2 WHERE a.value <> b.value""")
def _(spark, sf):
    return ev.differing_labels(view(spark, sf, "votes"), 1, 2)


# --- metric sinks -------------------------------------------------------------

@check("S6_metrics_csv", views=VOTE_VIEWS, sql=MICRO_SQL)
def _(spark, sf):
    metrics = rounded(ev.micro_scores(runs(spark, sf, eligible=True), ["run"]), ["run", "scope"])
    schema = metrics.schema
    return files.round_trip(metrics, "metrics", files.write_metrics_wide,
                            lambda s, p: files.read_csv_table(s, p, schema))


@check("S6_metrics_long", views=VOTE_VIEWS, sql=f"""
    SELECT metric, value FROM (UNPIVOT ({MACRO_AB}) ON COLUMNS(*) INTO NAME metric VALUE value) u""")
def _(spark, sf):
    return files.long_metrics(rounded(ev.compare_macro(ev.compare_runs(runs(spark, sf), 1, 2)), []))
