"""Label tables: wide to long, validation, votes, ICD classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clinprep import vocab
from clinprep.functions import labels as lb
from clinprep.functions import measure
from clinprep.operators.corpus import last_record
from clinprep.operators.scaling import once_per_value


def label_table(wide: DataFrame, label_columns: list[str], id_col: str = "study_id",
                ordinal: str = "ordinal") -> DataFrame:
    """Long ``study_id, label, value`` from a wide label table.

    Rows without an id are left out (``missing_ids`` counts them); of duplicate ids the
    later row counts. Duplicates are reduced while the table is still wide.
    """
    text_id = F.col(id_col).cast("string")
    clean = F.regexp_replace(text_id, r"\.0+$", "")
    known = wide.where(F.col(id_col).isNotNull()).select(
        clean.alias("study_id"), ordinal, *[lb.label_value(F.col(c).cast("string")).alias(c) for c in label_columns])
    return last_record(known, "study_id", ordinal).unpivot(
        ["study_id"], label_columns, "label", "value")


def missing_ids(wide: DataFrame, id_col: str = "study_id") -> Column:
    return F.count_if(F.col(id_col).isNull()).alias("missing_study_ids")


def label_maps(rows: DataFrame) -> DataFrame:
    """One ``map<label, value>`` per study; the array is bounded by the label vocabulary.

    Of repeated rows of a label the largest value counts.
    """
    once = rows.groupBy("study_id", "label").agg(F.max("value").alias("value"))
    return once.groupBy("study_id").agg(
        F.map_from_entries(F.collect_list(F.struct("label", "value"))).alias("labels"))


def explode_labels(maps: DataFrame, labels: str = "labels") -> DataFrame:
    rows = maps.select("study_id", F.explode_outer(labels).alias("label", "value"))
    return rows.where(F.col("label").isNotNull())


def out_of_domain(rows: DataFrame) -> DataFrame:
    """Label rows whose value is not allowed, over the whole table."""
    return rows.where(F.col("value").isNull() | ~F.col("value").isin(vocab.LABEL_DOMAIN))


def aggregate_votes(votes: DataFrame, positive_share: float = vocab.VOTE_SHARE,
                    negative_share: float | None = vocab.VOTE_SHARE) -> DataFrame:
    """One value per study and label from the votes of all runs.

    Enough positive votes give 1, else enough negative votes -1, else 0. Enough is a share of
    the runs of the study, so a run that leaves a label out counts as a vote for neither.
    ``negative_share=None`` is the ICD form: 0 or 1 only.
    """
    keys = [c for c in ("study_id", "stage", "label") if c in votes.columns]
    runs = votes.groupBy("study_id").agg(F.count_distinct("run").alias("n"))
    value = lb.vote_value(F.col("value"), negative_share is not None)
    tally = votes.select(*keys, value.alias("v")).groupBy(*keys).agg(
        F.count_if(F.col("v") > 0).alias("positive"), F.count_if(F.col("v") < 0).alias("negative")).join(runs, "study_id")

    def needed(share):
        return F.greatest(F.lit(1).cast("long"), F.ceil(F.col("n") * F.lit(share)))

    out = F.when(F.col("positive") >= needed(positive_share), 1)
    if negative_share is not None:
        out = out.when(F.col("negative") >= needed(negative_share), -1)
    return tally.select(*keys, out.otherwise(0).alias("value"))


def votes_or_fallback(studies: DataFrame, voted: DataFrame, fallback: DataFrame) -> DataFrame:
    """Voted labels; studies without any vote take the (sign of the) fallback value."""
    without = studies.join(voted.select("study_id").distinct(), "study_id", "left_anti")
    filled = fallback.join(without.select("study_id"), "study_id").select(
        "study_id", "label", lb.vote_value(F.col("value")).alias("value"))
    return voted.select("study_id", "label", "value").unionByName(filled)


def icd_classes(codes: DataFrame, key: str, match: str = "prefix", min_confidence: float = 0.5) -> DataFrame:
    """0/1 per ICD class and key from a code table; each code is classed once, then one aggregation."""
    rows = codes.select(key, "icd_code", *(["confidence"] if match == "fragment" else []))
    found = once_per_value(rows, "icd_code", {"icd": measure.icd_class(F.col("icd_code"), match=match)})
    if match == "fragment":
        found = found.withColumn("icd", F.when(F.col("confidence") > min_confidence, F.col("icd")))
    return found.groupBy(key).agg(*[
        F.coalesce(F.max((F.col("icd") == c).cast("int")), F.lit(0)).alias(c) for c in vocab.ICD_CLASSES])


def keyword_labels(df: DataFrame, report: str = "impression", ehr: bool = True) -> DataFrame:
    """Apply keyword and patient-data rules to ``findings`` and ``icd`` map columns.

    With ``ehr`` the frame also has ``bnp``, ``crp``, ``admission_type`` and ``device``.
    """
    staged = df.withColumn("_low", F.lower(F.coalesce(report, F.lit("")))).withColumn("_found", lb.KEYWORDS.searched(F.col("_low")))
    holds = lb.KEYWORDS.within(F.col("_low"), F.col("_found"))

    def given(name, kind):
        return F.col(name) if ehr else F.lit(None).cast(kind)

    return staged.withColumn("_k", lb.apply_keywords(
        F.col("findings"), F.col("icd"), F.col("_low"), holds, F.col("stage"), given("bnp", "double"),
        given("crp", "double"), given("admission_type", "string"), given("device", "string"))
    ).withColumn("findings", F.col("_k.findings")).withColumn("icd", F.col("_k.icd")).drop("_low", "_found", "_k")
