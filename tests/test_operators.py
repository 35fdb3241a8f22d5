"""Operators on literal rows: nulls, ties, boundaries, hot keys, brute-force comparisons."""

import random

import pytest
from pyspark.sql import functions as F

from clinprep import vocab
from clinprep.functions import labels as lb
from clinprep.functions import measure, parse, text
from clinprep.operators import corpus, correct, ehr, evaluate, records, scaling
from clinprep.plans import passes
from clinprep.schemas import sample_record
from clinprep.sources import files


def one(df):
    return df.collect()[0]


# --- scaling blocks -----------------------------------------------------------

@pytest.mark.parametrize("pick", ["latest", "oldest"])
def test_window_lookup_equals_brute_force_under_a_hot_key(spark, pick):
    rnd = random.Random(3)
    hour = 3_600
    events = [(i, 1 if i % 3 else rnd.randrange(2, 9), rnd.choice("ab"), rnd.randrange(0, 400) * hour) for i in range(900)]
    asked = [(i, rnd.choice([1, 1, 2, 3, 99]), rnd.randrange(0, 420) * hour) for i in range(200)]
    width = 48 * hour
    ev = spark.createDataFrame(events, "event_id long, subject_id long, name string, at long").withColumn(
        "charttime", F.timestamp_seconds("at"))
    st = spark.createDataFrame(asked, "study_id long, subject_id long, at long").select(
        "study_id", "subject_id", F.timestamp_seconds("at").alias("study_time"))
    got = ehr.at_study(st, ev, "name", ["a", "b"], width * ehr.SECOND, ["event_id"], ["event_id"], pick)
    want = set()
    for sid, subject, t in asked:
        for name in "ab":
            inside = [(at, e) for e, s, n, at in events if s == subject and n == name and t - width <= at <= t]
            if inside:
                best = max(inside) if pick == "latest" else min(inside)
                want.add((sid, name, best[1]))
    assert {(r.study_id, r.name, r.event_id) for r in got.collect()} == want


def test_window_bounds_are_inclusive(spark):
    st = spark.sql("SELECT 1L study_id, 1L subject_id, TIMESTAMP '2024-01-08 00:00:00' study_time")
    ev = spark.sql("SELECT * FROM VALUES (1L, 1L, 'a', TIMESTAMP '2024-01-01 00:00:00') t(event_id, subject_id, name, charttime)")
    assert ehr.at_study(st, ev, "name", ["a"], 7 * ehr.DAY, ["event_id"], ["event_id"]).count() == 1
    assert ehr.at_study(st, ev, "name", ["a"], 7 * ehr.DAY - 1, ["event_id"], ["event_id"]).count() == 0


def test_seeded_rank_is_a_permutation_in_hash_order(spark):
    ids = spark.range(5000).withColumnRenamed("id", "k")
    rows = scaling.seeded_rank(ids, "k", 7).withColumn("h", F.md5(F.concat(F.lit("7:"), F.col("k").cast("string")))).orderBy("rank").collect()
    assert [r["rank"] for r in rows] == list(range(1, 5001))
    assert [r.h for r in rows] == sorted(r.h for r in rows)


def test_joins_for_hot_keys_keep_all_rows(spark):
    many = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id")).cast("long").alias("k"))
    sides = many.groupBy("k").agg(F.count("*").alias("n")).withColumn("v", F.col("k") * 2)
    plain = sorted(map(tuple, many.join(sides.select("k", "v"), "k").select("id", "k", "v").collect()))
    salted = scaling.salted_join(many, sides.select("k", "v"), "k", ["id"]).select("id", "k", "v")
    hot = scaling.hot_aware_join(many, sides, "k", F.col("n"), ["id"]).select("id", "k", "v")
    assert sorted(map(tuple, salted.collect())) == plain
    assert sorted(map(tuple, hot.collect())) == plain


# --- text and labels ----------------------------------------------------------

REPORTS = [
    ("FINDINGS: \n Lungs clear and expanded.\n IMPRESSION: \n No acute process today.", "NO ACUTE PROCESS TODAY."),
    ("FINDINGS: Stable heart and lungs.\nIMPRESSION: short", "STABLE HEART AND LUNGS."),
    ("", None), ("IMPRESSION: tiny", None), (None, None),
    ("IMPRESSION: Seen [**Hosp**] effusion. Dictated by Dr X. Date: 1 May.\nNOTIFICATION: x", "SEEN EFFUSION."),
    ("IMPRESSION: Wide blank and more", "WIDE BLANK AND MORE"),
]


def test_impressions(spark):
    df = spark.createDataFrame([(i, r) for i, (r, _) in enumerate(REPORTS)], "i int, report string")
    got = df.select("i", text.extract_impression(F.col("report")).alias("x")).orderBy("i").collect()
    assert [r.x for r in got] == [w for _, w in REPORTS]


def test_paths_and_redaction(spark):
    r = one(spark.sql("SELECT 'files/files/p1/p2/s33/a.b.dcm' p, 'seen ___ and [REDACTED]]]' t").select(
        text.strip_path_prefix(F.col("p")).alias("a"), text.image_id(F.col("p")).alias("b"),
        text.study_of_path(text.strip_path_prefix(F.col("p"))).alias("c"), text.redaction_marks(F.col("t")).alias("d")))
    assert tuple(r) == ("p1/p2/s33/a.b.dcm", "a.b", "s33", "seen [REDACTED] and [REDACTED]")


@pytest.mark.parametrize("raw,want", [
    (None, -1), ("-1", -1), ("0", 0), ("0.4", 1), ("1.0", 1), ("1.5", 2), ("-7", -1), ("7", 2),
    ("Yes ", 1), ("negative", 0), ("maybe", -1), ("uncertain", -1), ("nan", -1)])
def test_label_values(spark, raw, want):
    assert one(spark.createDataFrame([(raw,)], "v string").select(lb.label_value(F.col("v")).alias("x"))).x == want


@pytest.mark.parametrize("labels,said,want", [
    ({"No Finding": 1, "Edema": 1}, "x", {"No Finding": 0, "Edema": 1}),
    ({"Pneumonia": 1, "No Finding": 0}, "There is no pneumonia.", {"Pneumonia": 0, "No Finding": 1}),
    ({"Pneumonia": -1, "No Finding": 0}, "There is no pneumonia.", {"Pneumonia": 1, "No Finding": 0}),
    ({"Support Devices": -1}, "PICC in place", {"Support Devices": 1, "No Finding": 0}),
    ({"Fracture": 1}, "no fracture seen", {"Fracture": 0, "No Finding": 1}),
    ({"Lung Lesion": 2, "No Finding": -1}, "lesion", {"Lung Lesion": -1, "No Finding": 0}),
    ({"Cardiomegaly": 0}, None, {"Cardiomegaly": 0, "No Finding": 1}),
])
def test_reconcile_labels(spark, labels, said, want):
    df = spark.createDataFrame([(labels, said)], "chexpert_labels map<string,int>, impression string")
    once = records.reconcile_labels(df)
    assert one(once).chexpert_labels == want


def test_icd_classes_first_prefix(spark):
    df = spark.createDataFrame([([("I51.9",), ("j18.1",), ("J98.11",)],), ([],)], "c array<struct<code:string>>")
    rows = [r.m for r in df.select(lb.icd_map_from_codes(F.col("c")).alias("m")).collect()]
    assert {k for k, v in rows[0].items() if v} == {"Pneumonia", "Atelectasis"}
    assert set(rows[1].values()) == {0}


# --- measurements -------------------------------------------------------------

@pytest.mark.parametrize("name,value,unit,want", [
    ("BNP", 100001.0, "pg/mL", None), ("BNP", 100000.0, "pg/mL", (100000.0, "pg/mL", False)),
    ("BUN", 10.0, "mmol/L", (28.0, "mg/dL", False)), ("BUN", 10.0, "mEq/L", None),
    ("PLT", 10.0, "K/uL", (10.0, "K/uL", False)), ("PLT", 9.9, "K/uL", None), ("PLT", 20.0, "m/uL", None),
    ("Chloride", 50.0, "mEq/L", (50.0, "mEq/L", False)), ("Chloride", 49.0, "mEq/L", None),
    ("Chloride", 100.0, "mEq/L", (100.0, "mEq/L", True)), ("Albumin", 9.0, "IU/L", (4.0, "g/dL", True)),
    ("Sodium", 140.0, "furlong", (140.0, "furlong", True)), ("PT", 50.0, "sec", (50.0, "sec", False)),
])
def test_corrected_labs(spark, name, value, unit, want):
    df = spark.createDataFrame([(name, value, unit, None, None)], "lab_name string, value double, unit string, ref_low double, ref_high double")
    r = one(correct.corrected_labs(df)).corrected
    assert (None if r.dropped else (round(r.value, 6), r.unit, r.normal_range)) == want


def test_unknown_unit_can_be_relabelled_and_unknown_lab_is_kept(spark):
    df = spark.createDataFrame([("Sodium", 140.0, "furlong", 1.0, 2.0), ("Zinc", 5.0, "x", None, None)],
                               "lab_name string, value double, unit string, ref_low double, ref_high double")
    rows = {r.lab_name: r.corrected for r in correct.corrected_labs(df, relabel=True).collect()}
    assert rows["Sodium"].unit == "mEq/L" and not rows["Sodium"].unit_unresolved
    assert (rows["Zinc"].ref_low, rows["Zinc"].ref_high, rows["Zinc"].error) == (0.0, 1000.0, "unknown lab")


def test_extraction_rules_fall_through_to_the_next_older_reading(spark):
    labs = spark.createDataFrame([
        (1, "BNP", 5.0, "mg/dL", "2024-01-03"), (1, "BNP", 9.0, "pg/mL", "2024-01-02"), (1, "INR", 3.0, "K/uL", "2024-01-02"),
        (1, "Platelet Count", 0.2, "M/uL", "2024-01-02"), (1, "CRP", 2.0, "mg/dL", "2024-01-02"), (1, "CRP", None, "mg/dL", "2024-01-01")],
        "subject_id int, lab string, valuenum double, valueuom string, charttime string")
    got = {r.lab: (r.valuenum, r.valueuom) for r in ehr.latest_labs(ehr.checked_labs(labs), ["subject_id"], []).collect()}
    assert got == {"BNP": (9.0, "pg/mL"), "Platelet Count": (200.0, "K/uL"), "CRP": (20.0, "mg/L")}


@pytest.mark.parametrize("said,want", [
    (None, ("none", None, None)), ("nc: 2", ("NC", 2.0, None)), ("BiPAP: 40", ("BiPAP", None, 0.4)),
    ("cpap: 0.5", ("CPAP", None, 0.5)), ("Oxygen_Device: 40", ("none", None, None)), ("trach", ("Trach", None, None)),
    ("nc: lots", ("NC", None, None)), ("nasal cannula", ("none", None, None))])
def test_oxygen_text(spark, said, want):
    r = one(spark.createDataFrame([(said,)], "o string").select(measure.oxygen_device(F.col("o")).alias("x"))).x
    assert (r.device, r.flow_lpm, r.fio2) == want


@pytest.mark.parametrize("vital,value,fine", [
    ("heart_rate", 20.0, True), ("heart_rate", 19.9, False), ("heart_rate", 300.0, True), ("o2_saturation", 100.1, False),
    ("respiratory_rate", 0.0, False), ("temperature_c", 45.0, True), ("temperature_f", 85.0, False), ("weight", -1.0, True), ("heart_rate", None, True)])
def test_vital_limits(spark, vital, value, fine):
    df = spark.createDataFrame([(vital, value)], "v string, x double")
    assert one(df.select(measure.vital_plausible(F.col("v"), F.col("x")).alias("ok"))).ok is fine


# --- records ------------------------------------------------------------------

RECORD = [(1, "files/files/a.jpg", "No pneumonia. ___", {"Pneumonia": 1, "No Finding": 0}, "B", (
    7, 60, "F", 9, "URGENT",
    {"temperature_f": (98.6, "F", None, None), "temperature_c": (30.0, "C", None, None), "height": (170.0, "cm", None, None),
     "weight": (70.0, "unknown", None, None), "respiratory_rate": (0.0, "bpm", None, None)},
    {"WBC Count": ("WBC", 5.0, "K/uL", None, None, None, None, None), "BNP": ("BNP", 5.0, "mg/dL", None, None, None, None, None)},
    "nc: 2", ["hypertension"])), (2, "b.jpg", "Fine", {}, "B", None)]


def test_first_pass(spark):
    df = spark.createDataFrame(RECORD, sample_record())
    done = passes.first_pass(df)
    stats = one(passes.first_pass_statistics(done))
    assert (stats.total_records, stats.stage_fixes, stats.dropped_labs, stats.dropped_vitals) == (2, 1, 1, 1)
    rows = {r.study_id: r for r in passes.finish_first_pass(done).collect()}
    p = rows[1].patient_data
    assert rows[1].image_path == "a.jpg" and rows[1].impression == "No pneumonia. [REDACTED]"
    assert rows[1].chexpert_labels == {"Pneumonia": 0, "No Finding": 1} and rows[2].stage == "A"
    assert set(p.Labs) == {"WBC"} and "corrected" not in p.Labs["WBC"].asDict()
    assert set(p.Vitals) == {"temperature_f", "temperature_c", "height", "weight", "BMI"}
    assert round(p.Vitals["temperature_c"].value, 4) == 37.0 and round(p.Vitals["BMI"].value, 4) == 24.2215
    assert (p.O2_device.device, p.O2_device.flow_lpm) == ("NC", 2.0)


def test_full_pass_is_stable(spark):
    df = spark.createDataFrame(RECORD, sample_record())
    once = passes.full_pass(df)
    again = passes.second_pass(once)
    cols = ["study_id", "stage", F.to_json("chexpert_labels"), F.to_json("patient_data.Labs"), F.to_json("icd_labels")]
    assert sorted(map(tuple, once.select(*cols).collect())) == sorted(map(tuple, again.select(*cols).collect()))
    assert one(once.where("study_id = 1")).data_quality.has_ehr_data


def test_duplicate_canonical_labs_keep_the_last(spark):
    labs = {"Sodium": ("Na", 1.0, "mEq/L", None, None, None, None, None), "Na": ("Na", 2.0, "mEq/L", None, None, None, None, None)}
    row = (1, "a", "x", {}, "B", (1, 1, "F", 1, "U", {}, labs, None, []))
    got = one(records.correct_lab_map(spark.createDataFrame([row], sample_record()))).patient_data.Labs
    assert {k: v.value for k, v in got.items()} == {"Na": 2.0}


# --- corpus -------------------------------------------------------------------

def test_split_keeps_groups_together_and_has_the_exact_size(spark):
    df = spark.range(4000).select(F.col("id").alias("sample_id"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 500).alias("subject_id"))
    sides = corpus.with_split(df).groupBy("subject_id").agg(F.count_distinct("split").alias("n"), F.first("split").alias("s")).collect()
    assert all(r.n == 1 for r in sides)
    assert sum(r.s == "val" for r in sides) == int(len(sides) * 0.15)


def test_weighted_draws_follow_the_weights(spark):
    items = spark.createDataFrame([(i, 1.0) for i in range(99)] + [(99, 99.0)], "k long, weight double")
    draws = spark.range(4000).select(F.col("id").alias("draw"), corpus.uniform(1, "id").alias("u"))
    got = corpus.weighted_draws(items, "k", draws, cells=64).collect()
    assert len(got) == 4000 and all(r.k is not None for r in got)
    assert 0.45 < sum(r.k == 99 for r in got) / 4000 < 0.55
    spans = corpus.cumulative_weight(items, "k").collect()
    picked = {r.draw: r.k for r in got}
    for d in draws.limit(200).collect():
        assert picked[d.draw] == next(s.k for s in spans if s.low - 1e-12 <= d.u < s.high + 1e-12 and picked[d.draw] == s.k)


def test_manifest_counts_every_reason(spark):
    studies = spark.createDataFrame([(i, 1) for i in range(1, 7)], "study_id long, subject_id long")
    said = spark.createDataFrame([(f"s{i}", "text") for i in (2, 3, 4, 5, 6)], "study_id string, impression string")
    maps = spark.createDataFrame([(i, {"Edema": 1}) for i in (3, 4, 5, 6)], "study_id long, labels map<string,int>")
    images = spark.createDataFrame([(4, "x/lateral.dcm", 0), (4, "x/q.dcm", 1), (5, "y/gone.dcm", 2), (6, "z/pa.dcm", 3)],
                                   "study_id long, path string, ordinal long")
    have = spark.createDataFrame([("x/lateral.jpg",), ("z/pa.jpg",)], "path string")
    c = corpus.manifest_candidates(studies, said, maps, images, have)
    assert {r.reason: r.n for r in corpus.rejections(c).collect()} == {
        "no_impression": 1, "no_chexpert": 1, "no_image": 3, "non_frontal": 2, "missing_file": 1}
    assert [r.image_id for r in corpus.manifest(c).collect()] == ["pa"]


# --- parsing and scoring ------------------------------------------------------

@pytest.mark.parametrize("body,fine", [
    ('{"a": 1}', True), ('{"a": 1,}', False), ("{'a': 1}", False), ('{"a": 1} x', False), ("[1]", False), ("", False), (None, False), ('{"a": 1}, {}', False)])
def test_strict_json(spark, body, fine):
    assert one(spark.createDataFrame([(body,)], "b string").select(parse.is_json_object(F.col("b")).alias("x"))).x is fine


@pytest.mark.parametrize("said,want", [
    ('x {"a": {"b": 1}} y {}', '{"a": {"b": 1}}'), ("none", None), ("{ {", None), ("} {} z", "{}"), ('{"s": "}"}', '{"s": "}')])
def test_first_balanced_object(spark, said, want):
    assert one(evaluate.first_object(spark.createDataFrame([(said,)], "output string"))).object == want


def _lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], (last + 1 if x == y else max(row[j], row[j - 1]))
    return row[-1]


def test_rouge_l_equals_dynamic_programming(spark):
    rnd = random.Random(1)
    rows = [(i, " ".join(rnd.choice("abcde") for _ in range(rnd.randrange(0, 90))),
             " ".join(rnd.choice("abcdef") for _ in range(rnd.randrange(0, 90)))) for i in range(60)]
    df = spark.createDataFrame(rows, "k int, reference string, prediction string")
    got = {r.k: r.rougeL for r in evaluate.rouge_l(df, ["k"]).collect()}
    for k, a, b in rows:
        a, b = a.split(), b.split()
        n = _lcs(a, b)
        assert got[k] == pytest.approx(2 * n / (len(a) + len(b)) if n else 0.0)


def test_bleu_and_rouge_on_known_pairs(spark):
    df = spark.createDataFrame([(1, "the cat sat on the mat", "the cat sat on the mat"), (2, "a b c", "x y z"), (3, "a b", "a a a b")],
                               "k int, reference string, prediction string")
    bleu = {r.k: r.bleu for r in evaluate.bleu(df, ["k"]).collect()}
    rouge = {r.k: (r.rouge1, r.rouge2) for r in evaluate.rouge_n(df, ["k"]).collect()}
    assert bleu[1] == pytest.approx(1.0) and bleu[2] == 0.0
    # precisions 2/4, 1/3, 0.1/2, 0.1/1; the prediction is longer, so no brevity penalty
    assert bleu[3] == pytest.approx((0.5 * (1 / 3) * 0.05 * 0.1) ** 0.25)
    assert rouge[1] == (1.0, 1.0) and rouge[3][0] == pytest.approx(2 * 2 / 6)


def test_scores_from_published_counts(spark):
    # stage B of the four-row evaluation: 3 hits, none wrong, 2 missed; overall 3 hits, 2 wrong, 4 missed
    rows = [("B", 1, 1)] * 3 + [("B", 1, 0)] * 2 + [("A", 0, 1)] * 2 + [("A", 1, 0)] * 2 + [("B", 0, 0)] * 5
    df = spark.createDataFrame([(i, "x", s, t, p) for i, (s, t, p) in enumerate(rows)], "study_id int, label string, stage string, truth int, pred int")
    got = {r.scope: (round(r.micro_f1, 2), round(r.micro_precision, 2), round(r.micro_recall, 2)) for r in evaluate.micro_scores(df).collect()}
    assert got["stageB"] == (0.75, 1.0, 0.6) and got["overall"] == (0.5, 0.6, 0.43) and got["stageA"] == (0.0, 0.0, 0.0)


# --- files --------------------------------------------------------------------

def test_jsonl_skips_blank_lines_and_reports_bad_ones(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"study_id": 1}\n\n{"study_id": 2\n{"study_id": 3} x\n')
    rows = files.malformed_lines(spark, str(tmp_path)).collect()
    assert sorted(r.line_number for r in rows) == [3, 4]


def test_reports_are_read_whole_and_bad_bytes_dropped(spark, tmp_path):
    (tmp_path / "p1").mkdir()
    (tmp_path / "p1" / "s5.txt").write_bytes(b"IMPRESSION: \xffok\nline two")
    r = one(files.read_reports(spark, str(tmp_path)))
    assert (r.study_id, r.report) == ("s5", "IMPRESSION: ok\nline two")


def test_map_document_is_read_in_pieces(spark, tmp_path):
    import json

    doc = {str(i): {"Edema": i % 3 - 1, "Lung Opacity": 1} for i in range(50)}
    (tmp_path / "d.json").write_text(json.dumps(doc, indent=2))
    got = {r.study_id: r.labels for r in files.import_map_document(spark, str(tmp_path / "d.json")).collect()}
    assert got == doc


def test_sidecars_try_the_other_prefix(spark):
    rows = spark.createDataFrame([(1, "a.json"), (2, "b.json"), (3, "c.json"), (4, None)], "study_id int, ehr_json_path string")
    have = spark.createDataFrame([("a.json", "A"), ("evaluation/a.json", "x"), ("evaluation/b.json", "B")], "path string, record string")
    assert {r.study_id: r.record for r in files.attach_sidecars(rows, have).collect()} == {1: "A", 2: "B", 3: None, 4: None}


def test_vocabularies_are_complete():
    assert (len(vocab.FINDINGS), len(vocab.ICD_CLASSES), len(vocab.LAB_ITEMS)) == (12, 8, 27)
    assert len(vocab.ACUTE_CODES) == len(vocab.CHRONIC_CODES) == 8
