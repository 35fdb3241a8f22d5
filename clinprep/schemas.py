"""Explicit schemas of the warehouse tables and of the record files."""

from __future__ import annotations

from pyspark.sql import types as T


def _schema(ddl: dict[str, str]) -> T.StructType:
    kinds = {"long": T.LongType(), "int": T.IntegerType(), "string": T.StringType(),
             "double": T.DoubleType(), "timestamp": T.TimestampType(), "date": T.DateType()}
    return T.StructType([T.StructField(name, kinds[kind]) for name, kind in ddl.items()])


_EVENT = {"subject_id": "long", "itemid": "long", "value": "string", "valuenum": "double",
          "valueuom": "string", "charttime": "timestamp"}

# the tables that are queried, with the columns the operators read
WAREHOUSE = {
    "patients": _schema({"subject_id": "long", "gender": "string", "anchor_age": "int"}),
    "admissions": _schema({
        "subject_id": "long", "hadm_id": "long", "admittime": "timestamp", "dischtime": "timestamp",
        "admission_type": "string", "admission_location": "string"}),
    "diagnoses_icd": _schema({"subject_id": "long", "hadm_id": "long", "icd_code": "string", "icd_version": "int"}),
    "labevents": _schema({**_EVENT, "ref_range_lower": "double", "ref_range_upper": "double", "flag": "string"}),
    "chartevents": _schema(_EVENT),
    "vitalsign": _schema(_EVENT),
    "d_items": _schema({"itemid": "long", "label": "string"}),
    "d_labitems": _schema({"itemid": "long", "label": "string"}),
    "omr": _schema({"subject_id": "long", "result_name": "string", "result_value": "string", "chartdate": "date"}),
}

LABELS = T.MapType(T.StringType(), T.IntegerType())
VITAL = T.StructType([
    T.StructField("value", T.DoubleType()), T.StructField("unit", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("delta_hours", T.DoubleType())])
LAB = T.StructType([
    T.StructField("canonical_name", T.StringType()), T.StructField("value", T.DoubleType()),
    T.StructField("unit", T.StringType()), T.StructField("ref_low", T.DoubleType()),
    T.StructField("ref_high", T.DoubleType()), T.StructField("normal_range", T.BooleanType()),
    T.StructField("value_is_suspect", T.BooleanType()), T.StructField("delta_hours", T.DoubleType())])


def sample_record(oxygen_text: bool = True) -> T.StructType:
    """A training sample; oxygen is free text before the first pass and a struct after it."""
    oxygen: T.DataType = T.StringType() if oxygen_text else T.StructType([
        T.StructField("device", T.StringType()), T.StructField("flow_lpm", T.DoubleType()),
        T.StructField("fio2", T.DoubleType())])
    patient = T.StructType([
        T.StructField("subject_id", T.LongType()), T.StructField("Age", T.IntegerType()),
        T.StructField("Sex", T.StringType()), T.StructField("hadm_id", T.LongType()),
        T.StructField("admission_type", T.StringType()),
        T.StructField("Vitals", T.MapType(T.StringType(), VITAL)),
        T.StructField("Labs", T.MapType(T.StringType(), LAB)),
        T.StructField("O2_device", oxygen),
        T.StructField("Chronic_conditions", T.ArrayType(T.StringType()))])
    return T.StructType([
        T.StructField("study_id", T.LongType()), T.StructField("image_path", T.StringType()),
        T.StructField("impression", T.StringType()), T.StructField("chexpert_labels", LABELS),
        T.StructField("stage", T.StringType()), T.StructField("patient_data", patient)])
