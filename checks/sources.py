"""Sources and sinks: S1-S3, S5, S7, S8. Each writes given data to scratch space and reads it back."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from checks.bindings import view
from checks.records import RECORD_VIEWS, records
from checks.registry import check
from clinprep import schemas
from clinprep.functions.exprs import micros
from clinprep.session import scratch_dir
from clinprep.sources import files


@check("S1_warehouse_csv", views=("admissions", "patients"), sql="""
    SELECT a.hadm_id, a.subject_id, epoch_us(a.admittime) AS admit_us, epoch_us(a.dischtime) AS disch_us, a.admission_type, p.gender,
           CASE WHEN p.subject_id % 9 <> 0 THEN p.anchor_age END AS anchor_age
    FROM admissions a JOIN patients p ON a.subject_id = p.subject_id""")
def _(spark, sf):
    folder = scratch_dir(spark, "warehouse")
    gz = {"header": True, "compression": "gzip", "timestampFormat": "yyyy-MM-dd HH:mm:ss.SSSSSS"}
    admissions = view(spark, sf, "admissions").select(
        "subject_id", "hadm_id", F.col("admittime").cast("timestamp"), F.col("dischtime").cast("timestamp"), "admission_type",
        F.lit("EMERGENCY, \"ROOM\"").alias("admission_location"))
    # real exports have other columns in front and between, and their own order
    admissions = admissions.select(F.lit(7).alias("row_id"), "dischtime", "subject_id", F.lit("x").alias("insurance"), "admittime", "hadm_id",
                                   "admission_location", "admission_type")
    admissions.write.options(**gz).csv(f"{folder}/admissions.csv.gz")
    # a cell that is not a number must become null and leave the rest of the row alone
    age = F.when(F.col("subject_id") % 9 == 0, F.lit("n/a")).otherwise(F.col("anchor_age").cast("string"))
    view(spark, sf, "patients").withColumn("anchor_age", age).select("anchor_age", F.lit(2180).alias("anchor_year"), "gender", "subject_id").write.options(**gz).csv(f"{folder}/patients.csv.gz")
    got = files.load_warehouse(spark, folder, schemas.WAREHOUSE)
    a = got["admissions"]
    return a.join(got["patients"], "subject_id").select(
        "hadm_id", "subject_id", micros("admittime").alias("admit_us"), micros("dischtime").alias("disch_us"),
        "admission_type", "gender", "anchor_age")


@check("S2_jsonl_reader", views=RECORD_VIEWS, sql="""
    SELECT r.study_id, r.stage, r.age, r.o2, l.lab, l.value FROM rec r LEFT JOIN rec_labs l ON r.study_id = l.study_id WHERE r.age IS NOT NULL""")
def _(spark, sf):
    back = _round_trip(spark, sf)
    p = F.col("patient_data")
    return back.where(p.isNotNull()).select("study_id", "stage", p["Age"].alias("age"), p["O2_device"].alias("o2"),
                                            F.explode_outer(p["Labs"]).alias("lab", "v")).select("study_id", "stage", "age", "o2", "lab", "v.value")


def _round_trip(spark, sf):
    """Records as JSON lines, with a blank line after each of them."""
    path = scratch_dir(spark, "jsonl")
    lines = records(spark, sf).select(F.concat(F.to_json(F.struct("*")), F.lit("\n")).alias("value"))
    lines.write.text(path)
    return files.read_jsonl(spark, path, schemas.sample_record())


@check("S3_report_corpus", views=("reports",), sql="SELECT report, true AS stem_is_key, 1::BIGINT AS n_of_key FROM reports")
def _(spark, sf):
    path = scratch_dir(spark, "reports")
    # one text file per report
    files.write_reports(view(spark, sf, "reports").select("report"), f"{path}/p10")
    got = files.read_reports(spark, path)
    stem = F.concat("study_id", F.lit(".txt")) == F.substring_index("source_file", "/", -1)
    # the key names one report; the files are read once
    return got.withColumn("stem_is_key", stem).withColumn("n_of_key", F.count("*").over(Window.partitionBy("study_id"))).select(
        F.regexp_replace("report", r"\n\z", "").alias("report"), "stem_is_key", "n_of_key")


@check("S5_jsonl_sink", views=RECORD_VIEWS, sql="SELECT study_id, stage, CASE WHEN study_id % 4 = 0 THEN 'val' ELSE 'train' END AS split FROM rec")
def _(spark, sf):
    path = scratch_dir(spark, "curriculum")
    split = F.when(F.col("study_id") % 4 == 0, "val").otherwise("train")
    files.write_jsonl(records(spark, sf).withColumn("split", split), path, ["split", "stage"])
    schema = schemas.sample_record().add("split", T.StringType())
    return files.read_jsonl(spark, path, schema).select("study_id", "stage", "split")


@check("S7_eval_manifest", views=("finding_rows",), sql="""
    SELECT study_id, label, value, CASE WHEN study_id % 2 = 0 THEN 0 ELSE 1 END::INT AS n_codes FROM finding_rows""")
def _(spark, sf):
    path = scratch_dir(spark, "manifest")
    rows = view(spark, sf, "finding_rows").groupBy("study_id").agg(
        F.array_join(F.array_sort(F.collect_list(F.concat(F.lit("'"), "label", F.lit("': "), F.col("value").cast("string")))), ", ").alias("body"))
    icd = F.when(F.col("study_id") % 2 == 1, F.lit("[{'code': 'I10', 'description': 'a, \"b\"', 'confidence': 0.8}]"))
    out = rows.select(
        F.col("study_id").cast("string"), F.lit("p/x.jpg").alias("image_path"), F.lit("A").alias("stage"), F.lit(None).cast("string").alias("ehr_json_path"),
        F.lit('SAID "SO",\nTWICE').alias("ground_truth_impression"), F.concat(F.lit("{"), "body", F.lit("}")).alias("ground_truth_chexpert"),
        icd.alias("ground_truth_icd"), F.lit("1").alias("subject_id"))
    out = out.select(F.lit("n").alias("note"), *reversed(out.columns))
    out.write.option("header", True).option("quote", '"').option("escape", '"').csv(path)
    back = files.read_eval_manifest(spark, path)
    return back.where(F.col("ground_truth_impression") == 'SAID "SO",\nTWICE').select(
        F.col("study_id").cast("long").alias("study_id"), F.size("icd").alias("n_codes"),
        F.explode_outer("findings").alias("label", "value")).select("study_id", "label", "value", "n_codes")


@check("S8_sidecars", views=("samples",), sql="""
    SELECT sample_id, CASE WHEN stage = 'B' AND subject_id % 3 <> 2 THEN subject_id END AS found FROM samples""")
def _(spark, sf):
    path = scratch_dir(spark, "sidecars")
    s = view(spark, sf, "samples")
    subjects = s.select("subject_id").distinct().withColumn("part", F.col("subject_id") % 16)
    subjects.select(F.to_json(F.struct("subject_id")).alias("value"), "part").repartition("part").write.partitionBy("part").text(path)
    # sidecar files named after their subject: a third under the path, a third under the prefix, a third missing
    stock = spark.read.text(path).select(F.get_json_object("value", "$.subject_id").cast("long").alias("id"), F.col("value").alias("record"))
    name = F.concat(F.when(F.col("id") % 3 == 0, F.lit("")).when(F.col("id") % 3 == 1, F.lit("evaluation/")), F.lit("demo_ehr/"), F.col("id").cast("string"), F.lit(".json"))
    sidecars = stock.where("id % 3 <> 2").select(name.alias("path"), "record")
    wanted = F.when(F.col("stage") == "B", F.concat(F.lit("demo_ehr/"), F.col("subject_id").cast("string"), F.lit(".json")))
    out = files.attach_sidecars(s.withColumn("ehr_json_path", wanted), sidecars, spread="sample_id")
    return out.select("sample_id", F.get_json_object("record", "$.subject_id").cast("long").alias("found"))
