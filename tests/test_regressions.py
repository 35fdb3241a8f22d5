"""Literal rows for inputs outside the shape that the queries write themselves."""

import json

import pytest
from pyspark.sql import functions as F

from clinprep import vocab
from clinprep.functions import labels as lb
from clinprep.functions import parse
from clinprep.operators import corpus, ehr, evaluate, labels, qc, records, scaling
from clinprep.plans.context import build_context
from clinprep.schemas import WAREHOUSE
from clinprep.sources import files


@pytest.mark.parametrize("layout", [{"indent": 2}, {"indent": 4}, {"separators": (",", ":")}, {}])
def test_label_document_in_any_layout(spark, tmp_path, layout):
    document = {f"s{i}": {"Edema": i % 3 - 1, "No Finding": None, 'a "b"': 1} for i in range(50)}
    (tmp_path / "map.json").write_text(json.dumps(document, **layout))
    got = {r.study_id: r.labels for r in files.import_map_document(spark, str(tmp_path / "map.json")).collect()}
    assert got == document


@pytest.mark.parametrize("text", ['{"s1": {"Edema": }}', '{"s1": 5, "s2": {"Edema": 1}}', 'nonsense'])
def test_broken_label_document_is_an_error(spark, tmp_path, text):
    (tmp_path / "map.json").write_text(text)
    with pytest.raises(Exception, match="not a study"):
        files.import_map_document(spark, str(tmp_path / "map.json")).collect()


def test_csv_columns_by_name(spark, tmp_path):
    (tmp_path / "labevents.csv").write_text(
        "labevent_id,subject_id,specimen_id,itemid,charttime,value,valuenum,valueuom,ref_range_lower,ref_range_upper,flag\n"
        "1,10,77,50912,2150-01-02 03:04:05,1.5,1.5,mg/dL,0.5,1.2,abnormal\n")
    row = files.read_csv_table(spark, str(tmp_path / "labevents.csv"), WAREHOUSE["labevents"]).first()
    assert (row.subject_id, row.itemid, row.valuenum, row.flag) == (10, 50912, 1.5, "abnormal") and row.charttime.year == 2150
    (tmp_path / "patients.csv").write_text("subject_id,gender\n1,M\n")
    with pytest.raises(ValueError, match="anchor_age"):
        files.read_csv_table(spark, str(tmp_path / "patients.csv"), WAREHOUSE["patients"])


def test_demo_ids_above_999_differ(spark):
    rows = spark.range(3000).select(F.col("id").alias("sample_id"), F.lit("B").alias("stage"))
    assert corpus.demo_sample(rows, "sample_id", n_per_stage=2000).select("demo_id").distinct().count() == 2000


def test_cutoff_takes_exactly_so_many(spark):
    ids = spark.range(500).select(F.col("id").alias("k"))
    for n in (0, 1, 7, 500, 501):
        cutoff = scaling.order_cutoff(ids, "k", 3, n)
        taken = 0 if cutoff is None else ids.where(scaling.seeded_hash(3, "k") <= F.lit(cutoff)).count()
        assert taken == (n if n <= 500 else 0)


def test_missing_predictions_count_as_negative(spark):
    truth = spark.createDataFrame([(1, "A", "Edema", 1), (2, "A", "Edema", 1), (3, "B", "Edema", 1)], "study_id long, stage string, label string, truth int")
    pred = spark.createDataFrame([(1, 1, "Edema", 1)], "study_id long, run int, label string, value int")
    rows = evaluate.attach_truth(truth, pred, ["Edema", "Fracture"])
    assert rows.count() == 6
    score = evaluate.label_scores(rows, ["run"]).where("label = 'Edema'").first()
    assert (score.precision, score.recall) == (1.0, pytest.approx(1 / 3))
    assert evaluate.sample_accuracy(rows, ["study_id"]).where("study_id = 2").first().n_labels == 2
    eligible = evaluate.attach_truth(truth, pred, ["Edema", "Fracture"], eligible=True)
    assert {r.study_id for r in eligible.collect()} == {1}


@pytest.mark.parametrize("value,vote", [('"yes"', 0), ('"1"', 0), ('"nan"', 0), ("NaN", 0), ("true", 1), ("false", 0), ("2", 1), ("-0.5", -1), ("null", 0)])
def test_only_numbers_and_booleans_vote(spark, value, vote):
    text = f'Answer: {{"impression": "x", "chexpert": {{"Edema": 5, "Edema": {value}}}, "icd": {{}}}} end'
    out = evaluate.parse_object(spark.createDataFrame([(text, "A")], "output string, stage string")).first()
    assert out.valid and out.findings["Edema"] == vote
    assert spark.range(1).select(lb.vote_value(F.lit("1")).alias("v")).first().v == 0


@pytest.mark.parametrize("body,edema", [('{"Edema": 1, "Edema": 0}', "0"), ('{"Edema": NaN}', "NaN"), ('{"Edema": 1} x', None), ("{'Edema': 1}", None)])
def test_repeated_keys_and_nan_are_valid(spark, body, edema):
    got = spark.createDataFrame([(body,)], "b string").select(parse.json_map(F.col("b")).alias("m")).first().m
    assert (got is None) == (edema is None)
    if edema is not None:
        assert got["Edema"].strip('"') == edema


def test_reconciled_negatives_raise_no_issue(spark):
    df = spark.createDataFrame([("No pleural effusion. No pneumothorax.", {"Pleural Effusion": 1, "Pneumothorax": 0})], "impression string, chexpert_labels map<string,int>")
    done = records.reconcile_labels(df)
    assert done.first().chexpert_labels["Pleural Effusion"] == vocab.CLEAR_NEGATIVE
    issues = done.select(qc.label_issues(F.col("chexpert_labels"), F.lower("impression")).alias("i")).first().i
    assert issues == []


def test_vote_threshold_counts_runs_of_the_study(spark):
    # five runs, of which one has the label: 1 < ceil(5 * 0.34)
    rows = [(1, run, "Other", 0) for run in range(5)] + [(1, 0, "Edema", 1)]
    out = labels.aggregate_votes(spark.createDataFrame(rows, "study_id long, run int, label string, value int"))
    assert {r.label: r.value for r in out.collect()} == {"Other": 0, "Edema": 0}


def test_repeated_label_rows_make_one_map(spark):
    rows = spark.createDataFrame([(1, "Edema", 0), (1, "Edema", 1), (1, "Edema", 1)], "study_id long, label string, value int")
    assert labels.label_maps(rows).first().labels == {"Edema": 1}


def test_ids_that_are_no_numbers_stay(spark):
    manifest = spark.createDataFrame([("1", "a"), ("x", "b"), (None, "c")], "study_id string, path string")
    studies = spark.createDataFrame([(1, "m"), (None, "n")], "study_id long, name string")
    got = {r.path: r.name for r in corpus.study_metadata(manifest, studies).collect()}
    assert got == {"a": "m", "b": None, "c": None}


def test_hot_and_null_keys_join_once(spark, monkeypatch):
    monkeypatch.setattr(scaling, "hot_keys", lambda many, key: [0])
    many = spark.range(400).select("id", F.when(F.col("id") % 4 == 1, None).otherwise(F.col("id") % 2 * 7).alias("k"))
    one = spark.createDataFrame([(0, "zero"), (7, "seven")], "k long, v string")
    got = scaling.salted_join(many, one, "k", ["id"], "left")
    assert got.count() == 400 and got.where("v is null").count() == 100 and got.where("v = 'zero'").count() == 200


def test_plain_join_without_hot_keys(spark):
    many, one = spark.range(50).withColumnRenamed("id", "k"), spark.range(50).withColumnRenamed("id", "k")
    plan = scaling.salted_join(many, one, "k", ["k"])._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan


def test_context_windows(spark):
    studies = spark.createDataFrame([(1, 1, "2024-01-10 12:00:00"), (2, 1, None), (3, 2, None)], "study_id long, subject_id long, t string").select(
        "study_id", "subject_id", F.col("t").cast("timestamp").alias("study_time"))
    patients = spark.createDataFrame([(1, "M", 60), (2, "F", 50)], "subject_id long, gender string, anchor_age int")
    stays = spark.createDataFrame([(9, 1, "2024-01-09 00:00:00", None, "URGENT")], "hadm_id long, subject_id long, a string, d string, admission_type string").select(
        "hadm_id", "subject_id", F.col("a").cast("timestamp").alias("admittime"), F.col("d").cast("timestamp").alias("dischtime"), "admission_type")
    vital = "event_id long, subject_id long, vital string, source string, valuenum double, t string"
    vitals = spark.createDataFrame([
        (1, 1, "heart_rate", "Ward", 70.0, "2024-01-10 11:00:00"), (2, 1, "heart_rate", "ICU", 80.0, "2024-01-03 11:00:00"),
        (3, 1, "heart_rate", "ICU", 90.0, "2024-02-10 00:00:00"), (4, 1, "weight", "OMR", 80.0, "2024-01-03 00:00:00"),
        (5, 1, "height", "OMR", 200.0, "2024-01-04 00:00:00"), (6, 2, "heart_rate", "ICU", 60.0, "2023-01-01 00:00:00"),
        (7, 2, "heart_rate", "Ward", 61.0, "2024-01-30 00:00:00")], vital).withColumn("charttime", F.col("t").cast("timestamp")).withColumn("unit", F.lit("u"))
    labs = spark.createDataFrame([(1, "CRP", 5.0, "mg/L", "2024-01-09 12:00:00", 1), (1, "CRP", 6.0, "mg/L", "2024-01-11 00:00:00", 2)],
                                 "subject_id long, lab string, valuenum double, valueuom string, t string, i long").withColumn("charttime", F.col("t").cast("timestamp"))
    oxygen = spark.createDataFrame([(1, 1, "Oxygen_Device", "nc", "2024-01-09 11:00:00")], "event_id long, subject_id long, device_type string, value string, t string").withColumn(
        "charttime", F.col("t").cast("timestamp"))
    codes = spark.createDataFrame([(9, "J18.9")], "hadm_id long, icd_code string")
    got = {r.study_id: r.ehr_json for r in build_context(
        studies, patients, stays, vitals, labs, oxygen, codes, ["heart_rate", "weight", "height"], ["CRP"], ["i"],
        as_of=F.lit("2024-02-01").cast("timestamp")).collect()}
    # at the study: no lab from after the image, outpatient results by date, oxygen too old
    assert got[1].Vitals["heart_rate"].valuenum == 70.0 and got[1].Labs["CRP"].value == 5.0 and got[1].O2_device is None
    assert got[1].Vitals["weight"].valuenum == 80.0 and got[1].Vitals["bmi"].valuenum == 20.0
    # in an admission without a discharge the window stays open
    assert got[2].Vitals["heart_rate"].valuenum == 90.0 and got[2].Labs["CRP"].value == 6.0 and got[2].O2_device == "Oxygen_Device: nc"
    # without an admission: the last 90 days
    assert got[3].hadm_id is None and got[3].Vitals["heart_rate"].valuenum == 61.0


def test_open_discharge_keeps_events(spark):
    stays = spark.createDataFrame([(9, 1, "2024-01-09", None)], "hadm_id long, subject_id long, a string, d string").select(
        "hadm_id", "subject_id", F.col("a").cast("timestamp").alias("admittime"), F.col("d").cast("timestamp").alias("dischtime"))
    events = spark.createDataFrame([(1, "2024-03-01"), (1, "2024-01-01")], "subject_id long, t string").select("subject_id", F.col("t").cast("timestamp").alias("charttime"))
    assert ehr.in_admission(events, stays, 0, 0).count() == 1


def test_malformed_lines_are_kept_apart(spark, tmp_path):
    (tmp_path / "r.jsonl").write_text('{"study_id": 1}\n\n{"study_id": 2\n{"study_id": 3}\n')
    from pyspark.sql import types as T
    schema = T.StructType([T.StructField("study_id", T.LongType())])
    assert files.read_jsonl(spark, str(tmp_path), schema).count() == 2
    rows = files.read_jsonl(spark, str(tmp_path), schema, bad_records=True)
    assert [r[files.BAD_RECORD] for r in rows.where("study_id is null").collect()] == ['{"study_id": 2']


def test_sidecars_and_inventory(spark, tmp_path):
    (tmp_path / "demo_ehr").mkdir()
    (tmp_path / "demo_ehr" / "a.json").write_text('{\n "x": 1}')
    (tmp_path / "notes.txt").write_text("n")
    got = files.read_sidecars(spark, str(tmp_path)).collect()
    assert [(r.path, json.loads(r.record)) for r in got] == [("demo_ehr/a.json", {"x": 1})]
    assert {r.path for r in files.file_inventory(spark, str(tmp_path)).collect()} == {"demo_ehr/a.json", "notes.txt"}


def test_bleu_splits_at_no_break_spaces(spark):
    row = spark.range(1).select(evaluate.tokens(F.lit("a b  c")).alias("t")).first()
    assert row.t == ["a", "b", "c"]


@pytest.mark.parametrize("gap, between", [("", ""), (" ", "\n    ")])
def test_label_documents_are_written_by_partition(spark, tmp_path, monkeypatch, gap, between):
    from checks import labels

    path = tmp_path / "document"
    monkeypatch.setattr(labels, "scratch_dir", lambda *_: str(path))
    rows = [(study, label, 1) for study in range(40) for label in ("Edema", "Fracture")]
    monkeypatch.setattr(labels, "view", lambda *_: spark.createDataFrame(rows, "study_id long, label string, value int"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = labels._map_document(spark, "", gap, between).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted((r.study_id, r.label, r.value) for r in got) == rows
    assert sum("Edema" in f.read_text() for f in path.glob("*.txt")) > 1
