"""Texts whose units span lines and splits: against readers that see the whole file."""

import csv
import io
import json
import random

import pytest
from pyspark.sql import functions as F

from clinprep.sources import files, splits


@pytest.fixture(params=[64, 1024])
def split_size(spark, request):
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(request.param))
    yield request.param
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


def cells(rng, i):
    """Cells with quotes, line breaks, separators and blanks, often where a split is cut."""
    parts = ["x", ",", '"', "\n", "\n\n", '""', "\r\n", " ", "é", "'a': 1", "end"]
    return [str(i), "".join(rng.choice(parts) for _ in range(rng.randrange(60))) + "|", f"p/{i}.jpg"]


def written(rows, quoting=csv.QUOTE_MINIMAL, newline="\n"):
    out = io.StringIO()
    csv.writer(out, lineterminator=newline, quoting=quoting).writerows(rows)
    return out.getvalue()


@pytest.mark.parametrize("newline, quoting", [("\n", csv.QUOTE_MINIMAL), ("\r\n", csv.QUOTE_MINIMAL), ("\n", csv.QUOTE_ALL)])
def test_quoted_csv_equals_a_reader_of_the_whole(spark, tmp_path, split_size, newline, quoting):
    rng = random.Random(4)
    want = []
    for name in "abc":
        rows = [cells(rng, i) for i in range(rng.randrange(30, 90))]
        want += rows
        (tmp_path / f"{name}.csv").write_text(written([["id", "text", "path"], *rows], quoting, newline), newline="")
    got = splits.read_quoted_csv(spark, str(tmp_path), ["path", "id", "text"])
    if split_size < 1024:
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 50
    assert sorted((r.id, r.text, r.path) for r in got.collect()) == sorted(map(tuple, want))


def test_one_cell_over_many_splits(spark, tmp_path, split_size):
    long = "\n".join(f'line {i}, "quoted"' for i in range(400))
    (tmp_path / "a.csv").write_text(written([["id", "text"], ["1", "a"], ["2", long], ["3", ""], ["4", "\n"]]))
    got = {r.id: r.text for r in splits.read_quoted_csv(spark, str(tmp_path), ["id", "text"]).collect()}
    assert got == {"1": "a", "2": long, "3": None, "4": "\n"}


def test_blank_lines_missing_cells_and_a_mark_in_front(spark, tmp_path, split_size):
    (tmp_path / "a.csv").write_text('﻿id,"te\nxt"\n\n1,a\n\n2\n"3",""""\n')
    got = {r.id: r["te\nxt"] for r in splits.read_quoted_csv(spark, str(tmp_path), ["id", "te\nxt"]).collect()}
    assert got == {"1": "a", "2": None, "3": '"'}


def test_headers_must_agree_and_name_the_columns(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,text\n1,a\n")
    with pytest.raises(ValueError, match="lacks columns"):
        splits.read_quoted_csv(spark, str(tmp_path), ["id", "body"])
    (tmp_path / "b.csv").write_text("text,id\n1,a\n")
    with pytest.raises(ValueError, match="different headers"):
        splits.read_quoted_csv(spark, str(tmp_path), ["id", "text"])


def test_files_without_rows(spark, tmp_path):
    (tmp_path / "a.csv").write_text("")
    assert splits.read_quoted_csv(spark, str(tmp_path), ["id"]).count() == 0
    (tmp_path / "a.csv").write_text("id,text\n")
    assert splits.read_quoted_csv(spark, str(tmp_path), ["id"]).count() == 0


@pytest.mark.parametrize("size", [64, 1 << 20])
def test_quotes_never_closed_make_one_unit(spark, tmp_path, size):
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    (tmp_path / "a.txt").write_text('a\nb "open\n' + "c\n" * 400)
    (tmp_path / "b.txt").write_text("d\ne\n")
    got = sorted(r.unit for r in splits.units(spark, str(tmp_path)).collect())
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == ["a", 'b "open\n' + "c\n" * 399 + "c", "d", "e"]


# --- label documents ----------------------------------------------------------

KEYS = ["s}", "{s", 'say "so"', "back\\slash", "br{a}ce", "é\n", "tab\t}", "\\\"}", "plain", ", {", " "]


@pytest.mark.parametrize("layout", [{"indent": 2}, {"separators": (",", ":")}, {"ensure_ascii": False}, {}])
def test_label_documents_with_any_keys(spark, tmp_path, split_size, layout):
    rng = random.Random(9)
    document = {f"{rng.choice(KEYS)}{i}": {f"{rng.choice(KEYS)}{j}": rng.choice([-1, 0, 1, None]) for j in range(rng.randrange(4))} for i in range(120)}
    (tmp_path / "map.json").write_text(json.dumps(document, **layout), encoding="utf-8")
    got = {r.study_id: r.labels for r in files.import_map_document(spark, str(tmp_path / "map.json")).collect()}
    assert got == document


@pytest.mark.parametrize("text", ['{"s1": {"a": 1}, "s2": {"b": {"c": 1}}}', '{"s1": {"a": 1}} x', '{"s1": {"a": 1}, "s2": {"b}: 1}}', '{s1: {"a": 1}}'])
def test_other_documents_are_errors(spark, tmp_path, split_size, text):
    (tmp_path / "map.json").write_text(text)
    with pytest.raises(Exception, match="not a study"):
        files.import_map_document(spark, str(tmp_path / "map.json")).collect()


@pytest.mark.parametrize("text", ["{}", "", "{\n}\n"])
def test_empty_documents(spark, tmp_path, text):
    (tmp_path / "map.json").write_text(text)
    assert files.import_map_document(spark, str(tmp_path / "map.json")).count() == 0


def test_manifests_are_read_in_splits(spark, tmp_path, split_size):
    rows = [[f"s{i}", "p.jpg", "A", "", f'SAID "SO",\nTWICE {i}\n', "{'Edema': 1, 'Fracture': -1}",
             "[{'code': 'I10', 'description': 'a, \"b\"', 'confidence': 0.8}]" if i % 2 else "", str(i)] for i in range(50)]
    (tmp_path / "m.csv").write_text(written([files.MANIFEST_FIELDS, *rows]))
    got = files.read_eval_manifest(spark, str(tmp_path)).collect()
    assert {r.study_id: r.ground_truth_impression for r in got} == {r[0]: r[4] for r in rows}
    assert all(r.findings == {"Edema": 1, "Fracture": -1} and len(r.icd) == int(r.study_id[1:]) % 2 for r in got)
    assert got[0].__fields__.count("findings") == 1


def test_states_come_from_all_splits_before(spark, tmp_path):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64")
    try:
        (tmp_path / "a.txt").write_text('"' + "x\n" * 100 + '"\n' + "y\n" * 100)
        found = splits.pieces(spark, str(tmp_path), "\n", splits.odd_quotes(F.col("value")))
        assert sorted((block, begins) for (_, block), begins in splits.open_splits(found).items()) == [(0, False), (64, True), (128, True), (192, True)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
