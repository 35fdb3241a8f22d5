"""Inputs on which the queries of the fourth review round failed."""

import os

from clinprep.sources import files


def test_many_reports_are_listed_and_read_by_tasks(spark, tmp_path, monkeypatch):
    """The same rows as from Spark's reader, which lists the files on the driver."""
    texts = {"a.txt": b"one", "b.TXT": b"no", "sub/_c=1.txt": b"three", "sub/deep/er/d.txt": b"f\xffour\n", "sub/.e.txt": b"no", "_f.txt": b"no",
             "_out/g.txt": b"no", "sub/h.txt.gz": b"no", "sp ace/é %20.txt": b"five", "sub/empty.txt": b"", "sub/i.txt": "❤".encode() * 9}
    for name, text in texts.items():
        path = tmp_path / "reports" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(text)
    os.mkdir(tmp_path / "reports" / "empty")
    few = files.read_reports(spark, f"{tmp_path}/reports")
    assert "FileScan binaryFile" in few._jdf.queryExecution().sparkPlan().toString()
    monkeypatch.setattr(files, "LISTED", 3)
    monkeypatch.setattr(files, "BATCH_BYTES", 20)
    for folder in (f"{tmp_path}/reports", f"file://{tmp_path}/reports/"):
        many = files.read_reports(spark, folder)
        assert "binaryFile" not in many._jdf.queryExecution().sparkPlan().toString() and many.schema == few.schema
        assert sorted(map(tuple, many.collect())) == sorted(map(tuple, few.collect())) and few.count() == 5


def test_many_reports_are_few_tasks(spark, tmp_path, monkeypatch):
    reports = spark.range(900).selectExpr("concat('report ', id)").coalesce(2)
    files.write_reports(reports, f"{tmp_path}/reports", per_folder=100)
    monkeypatch.setattr(files, "LISTED", 800)
    got = files.read_reports(spark, f"{tmp_path}/reports")
    assert got.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism and got.count() == got.distinct().count() == 900
    monkeypatch.setattr(files, "READ_FILES", 30)
    assert files.read_reports(spark, f"{tmp_path}/reports").rdd.getNumPartitions() == 30
