"""Scoring: joining predictions to truth, parsing, text overlap, label metrics, comparisons."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from clinprep import vocab
from clinprep.functions import parse
from clinprep.functions.labels import variant_vote
from clinprep.functions.text import collapse_blanks, strip

# --- predictions --------------------------------------------------------------

MAX_RUNS = 1000  # each study is repeated for each run


def attach_truth(truth: DataFrame, predictions: DataFrame, names: list[str], runs: list | None = None,
                 eligible: bool = False, pred: str = "value") -> DataFrame:
    """``study_id, stage, run, label, truth, pred`` for each study with truth, each run and each name.

    ``truth`` is long (``study_id, stage, label, truth``), ``predictions`` too (``study_id,
    run, label, value``). Both are brought to one map per study first, bounded by ``names``, so
    a label or a whole study without a prediction stays, with a null ``pred``. ``eligible``
    keeps only studies with some label on both sides. Without ``runs`` those of the
    predictions are taken; more than ``MAX_RUNS`` are an error.
    """
    def as_map(rows: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
        known = rows.where(F.col("label").isin(names)).groupBy(*keys, "label").agg(F.max(value).alias("_v"))
        return known.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("label", "_v"))).alias(out))

    if runs is None:
        runs = sorted(r.run for r in predictions.select("run").distinct().limit(MAX_RUNS + 1).collect())
    if len(runs) > MAX_RUNS:
        raise ValueError(f"more than {MAX_RUNS} runs; pass them in parts")
    studies = truth.groupBy("study_id").agg(F.min("stage").alias("stage")).join(
        as_map(truth, ["study_id"], "truth", "_truth"), "study_id", "left")
    wanted = studies.withColumn("run", F.explode(F.array(*[F.lit(r) for r in runs])))
    both = wanted.join(as_map(predictions, ["study_id", "run"], pred, "_pred"), ["study_id", "run"], "inner" if eligible else "left")
    if eligible:
        both = both.where(F.size("_truth") > 0)
    label = F.explode(F.array(*[F.lit(n) for n in names])).alias("label")
    return both.select("study_id", "stage", "run", label, "_truth", "_pred").select(
        "study_id", "stage", "run", "label", F.try_element_at("_truth", F.col("label")).alias("truth"),
        F.try_element_at("_pred", F.col("label")).alias("pred"))


def word_value(raw: Column) -> Column:
    """A finding given as a word: 1, 0 or -1; -1 for any other word or none."""
    return F.coalesce(F.when(raw == "Positive", 1).when(raw == "Negative", 0), F.lit(-1))


def parse_blocks(df: DataFrame, text: str = "output", variant: str = "plain") -> DataFrame:
    """Add ``impression``, ``findings`` and ``icd`` read from headed blocks; bad JSON is null."""
    t = F.col(text)
    return (
        df.withColumn("impression", parse.impression_of(t, variant))
        .withColumn("_f", parse.block(t, parse.FINDING_BLOCK[variant]))
        .withColumn("_i", parse.block(t, parse.ICD_BLOCK[variant]))
        .withColumn("findings", parse.json_map(F.col("_f")))
        .withColumn("icd", parse.json_map(F.col("_i"))).drop("_f", "_i")
    )


def first_object(df: DataFrame, text: str = "output", out: str = "object") -> DataFrame:
    """Add the first brace-balanced block of the text; null if there is none."""
    staged = df.withColumn("_pieces", parse.brace_pieces(F.col(text)))
    staged = staged.withColumn("_taken", parse.pieces_to_close(F.col("_pieces")))
    return staged.withColumn(out, F.when(
        F.col("_taken").isNotNull(), F.array_join(F.slice("_pieces", 1, F.col("_taken")), ""))).drop("_pieces", "_taken")


def parse_object(df: DataFrame, text: str = "output", stage: str = "stage") -> DataFrame:
    """Add ``impression, findings, icd, valid`` from the first balanced block, typed and complete.

    Text without a valid block becomes the impression; stage A has no ICD values.
    """
    staged = first_object(df, text, "_object").withColumn("valid", parse.is_json_object(F.col("_object")))
    staged = staged.withColumn("_top", F.when(F.col("valid"), parse.last_of_key(F.from_json("_object", parse.JSON_MAP))))
    for key in ("chexpert", "icd"):
        staged = staged.withColumn(f"_{key}", parse.typed_map(F.try_element_at("_top", F.lit(key))))
    said = strip(F.coalesce(
        F.nullif(F.try_element_at("_top", F.lit("impression")), F.lit("")),
        F.try_element_at("_top", F.lit("Impression")), F.lit("")))

    def filled(payload, names, allow_negative, on):
        cells = []
        for n in names:
            vote = variant_vote(F.try_element_at(F.col(payload), F.lit(n)), allow_negative)
            cells += [F.lit(n), F.when(on, vote).otherwise(0)]
        return F.create_map(*cells)

    staged = staged.withColumn("_said", said)
    return (
        staged.withColumn("impression", F.when(F.col("_said") != "", F.col("_said")).otherwise(strip(F.col(text))))
        .withColumn("findings", filled("_chexpert", vocab.FINDINGS, True, F.lit(True)))
        .withColumn("icd", filled("_icd", vocab.ICD_CLASSES, False, F.col(stage) == "B"))
        .drop("_object", "_top", "_chexpert", "_icd", "_said")
    )


def json_validity(df: DataFrame, text: str = "output", by: list[str] | None = None) -> DataFrame:
    """Share of texts with a valid finding block, and with a valid or absent ICD block."""
    t = F.col(text)
    staged = df.withColumn("_f", parse.block(t, parse.FINDING_BLOCK["plain"])).withColumn(
        "_i", parse.block(t, parse.ICD_BLOCK["plain"]))
    finding = parse.is_json_object(F.col("_f"))
    icd = parse.is_json_object(F.col("_i")) | ~t.contains("ICD:")
    return staged.groupBy(*(by or [])).agg(
        F.avg(finding.cast("double")).alias("chexpert_valid_rate"), F.avg(icd.cast("double")).alias("icd_valid_rate"))


def repair(df: DataFrame, fixes: DataFrame, keys: list[str]) -> DataFrame:
    """``output`` with its blocks replaced by the valid blocks of ``repair``."""
    joined = df.join(fixes.select(*keys, "repair"), keys, "left")
    return joined.withColumn("repaired", F.coalesce(
        parse.repaired(F.col("output"), F.col("repair")), F.col("output"))).drop("repair")


# --- text overlap -------------------------------------------------------------

def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits (ROUGE)."""
    low = F.regexp_replace(F.lower(text), "[^a-z0-9]+", " ")
    return F.filter(F.split(low, " "), lambda w: w != "")


def tokens(text: Column, lower: bool = False) -> Column:
    """Blank-separated tokens (BLEU)."""
    base = collapse_blanks(F.lower(text) if lower else text)
    return F.filter(F.split(base, " "), lambda w: w != "")


def gram_overlap(pairs: DataFrame, keys: list[str], orders: list[int]) -> DataFrame:
    """Clipped n-gram overlap per pair, from token arrays ``ref_tokens`` and ``pred_tokens``.

    One row per pair with ``overlap_n, ref_n, pred_n`` per order. The n-grams of a pair are
    counted where it is and never become rows, so nothing is shuffled.
    """
    both = F.col("ref_tokens").isNotNull() & F.col("pred_tokens").isNotNull()

    def number(col: str, n: int) -> Column:
        return F.when(both, F.greatest(F.size(col) - (n - 1), F.lit(0))).otherwise(0).cast("long")

    counted = pairs.withColumn("_shared", _shared_grams(orders)("ref_tokens", "pred_tokens"))
    per_order = []
    for i, n in enumerate(orders):
        per_order += [F.get("_shared", i).cast("long").alias(f"overlap_{n}"), number("ref_tokens", n).alias(f"ref_{n}"),
                      number("pred_tokens", n).alias(f"pred_{n}")]
    return counted.select(*keys, *per_order)


def _shared_grams(orders: list[int]):
    """Number of n-grams that two token arrays share, repeats clipped, for each of the orders."""
    @F.pandas_udf(ArrayType(IntegerType()))
    def shared(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        def grams(words, n):
            return Counter(zip(*(words[i:] for i in range(n))))

        def of_pair(ref, pred):
            if ref is None or pred is None:
                return [0] * len(orders)
            return [(grams(ref, n) & grams(pred, n)).total() for n in orders]

        for refs, preds in batches:
            yield pd.Series([of_pair(list(r) if r is not None else None, list(p) if p is not None else None) for r, p in zip(refs, preds)], dtype=object)

    return shared


def _f1(overlap: Column, ref: Column, pred: Column) -> Column:
    """Harmonic mean of precision and recall; 0 when nothing overlaps."""
    return F.when(overlap > 0, F.lit(2.0) * overlap / (ref + pred)).otherwise(0.0)


def rouge_n(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """ROUGE-1 and ROUGE-2 F1 per pair of ``reference`` and ``prediction``."""
    staged = pairs.select(*keys, words(F.col("reference")).alias("ref_tokens"), words(F.col("prediction")).alias("pred_tokens"))
    counts = gram_overlap(staged, keys, [1, 2])
    return counts.select(*keys, *[
        _f1(F.col(f"overlap_{n}"), F.col(f"ref_{n}"), F.col(f"pred_{n}")).alias(f"rouge{n}") for n in (1, 2)])


def bleu(pairs: DataFrame, keys: list[str], lower: bool = False) -> DataFrame:
    """Sentence BLEU-4 per pair: clipped precisions, brevity penalty, and 0.1 in place of a zero count."""
    staged = pairs.select(*keys, tokens(F.col("reference"), lower).alias("ref_tokens"),
                          tokens(F.col("prediction"), lower).alias("pred_tokens"))
    c = gram_overlap(staged, keys, [1, 2, 3, 4])
    logs = F.lit(0.0)
    for n in (1, 2, 3, 4):
        hits = F.col(f"overlap_{n}").cast("double")
        total = F.greatest(F.lit(1), F.col(f"pred_{n}"))
        logs = logs + F.ln(F.when(hits == 0, F.lit(0.1)).otherwise(hits) / total) * 0.25
    ref, pred = F.col("ref_1"), F.col("pred_1")
    brevity = F.when(pred > ref, 1.0).otherwise(F.exp(F.lit(1.0) - F.try_divide(ref, pred)))
    return c.select(*keys, F.when(F.col("overlap_1") == 0, 0.0).otherwise(brevity * F.exp(logs)).alias("bleu"))


@F.pandas_udf(IntegerType())
def _lcs_length(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Longest common subsequence of two token arrays, one machine word of tokens at a time.

    The bit-vector recurrence works on one integer per pair (one bit per reference token),
    so whole texts stay cheap where a nested fold over columns grows quadratically.
    """
    def length(ref, pred):
        masks: dict[str, int] = {}
        for i, word in enumerate(ref):
            masks[word] = masks.get(word, 0) | (1 << i)
        full = (1 << len(ref)) - 1
        free = full
        for word in pred:
            hit = free & masks.get(word, 0)
            free = ((free + hit) | (free - hit)) & full
        return len(ref) - free.bit_count()

    for refs, preds in batches:
        yield pd.Series([length(r, p) for r, p in zip(refs, preds)], dtype="int32")


def rouge_l(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """ROUGE-L F1 per pair, over whole texts."""
    staged = pairs.select(*keys, words(F.col("reference")).alias("_r"), words(F.col("prediction")).alias("_p"))
    scored = staged.withColumn("_lcs", _lcs_length("_r", "_p"))
    return scored.select(*keys, _f1(F.col("_lcs"), F.size("_r"), F.size("_p")).alias("rougeL"))


# --- label metrics ------------------------------------------------------------

def _safe(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def _prf(tp: Column, fp: Column, fn: Column) -> tuple[Column, Column, Column]:
    return _safe(tp, tp + fp), _safe(tp, tp + fn), _safe(2 * tp, 2 * tp + fp + fn)


def _confusion(truth: Column, pred: Column) -> list[Column]:
    """Counts of hits and errors; a missing value is negative."""
    truth, pred = F.coalesce(truth, F.lit(0)), F.coalesce(pred, F.lit(0))
    return [
        F.count_if((truth == 1) & (pred == 1)).alias("tp"),
        F.count_if((truth != 1) & (pred == 1)).alias("fp"),
        F.count_if((truth == 1) & (pred != 1)).alias("fn"),
    ]


def micro_scores(rows: DataFrame, by: list[str] | None = None, stage: str = "stage") -> DataFrame:
    """Micro precision, recall and F1 overall and per stage (and per ``by``, such as the run or block).

    ``rows`` are those of ``attach_truth(..., eligible=True)``. Each stage is counted once;
    the overall line is the sum of stages.
    """
    by = by or []
    counts = rows.groupBy(*by, stage).agg(*_confusion(F.col("truth"), F.col("pred")))
    scopes = F.array(F.lit("overall"), F.concat(F.lit("stage"), F.col(stage)))
    total = counts.select(*by, F.explode(scopes).alias("scope"), "tp", "fp", "fn").groupBy(*by, "scope").agg(
        *[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    p, r, f = _prf(F.col("tp"), F.col("fp"), F.col("fn"))
    return total.select(*by, "scope", p.alias("micro_precision"), r.alias("micro_recall"), f.alias("micro_f1"))


def label_scores(rows: DataFrame, by: list[str] | None = None, labels: list[str] | None = None,
                 skip_uncertain: bool = False) -> DataFrame:
    """Precision, recall and F1 per label (and per ``by``).

    ``skip_uncertain`` leaves out rows whose truth is -1; a missing prediction is negative.
    """
    keep = rows if labels is None else rows.where(F.col("label").isin(labels))
    if skip_uncertain:
        keep = keep.where(F.coalesce(F.col("truth"), F.lit(-1)) != -1)
    counts = keep.groupBy(*(by or []), "label").agg(*_confusion(F.col("truth"), F.col("pred")))
    p, r, f = _prf(F.col("tp"), F.col("fp"), F.col("fn"))
    return counts.select(*(by or []), "label", p.alias("precision"), r.alias("recall"), f.alias("f1"))


def macro_scores(scores: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Unweighted mean over labels."""
    return scores.groupBy(*(by or [])).agg(
        F.avg("precision").alias("macro_precision"), F.avg("recall").alias("macro_recall"), F.avg("f1").alias("macro_f1"))


def sample_accuracy(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Share of labels a study got right."""
    hit = (F.coalesce("truth", F.lit(0)) == F.coalesce("pred", F.lit(0))).cast("double")
    return rows.groupBy(*keys).agg(F.avg(hit).alias("accuracy"), F.count("*").alias("n_labels"))


def class_hits(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Share of studies a label was right for (per ``by``)."""
    hit = (F.coalesce("truth", F.lit(0)) == F.coalesce("pred", F.lit(0))).cast("double")
    return rows.groupBy(*(by or []), "label").agg(F.avg(hit).alias("hit_rate"))


def metric_summary(scored: DataFrame, metrics: list[str], stage: str = "stage", success: str = "success",
                   by: list[str] | None = None) -> DataFrame:
    """Mean and population deviation of each metric overall and per stage (and per ``by``), with sample counts.

    The scope is an array on the row, so one aggregation serves all scopes.
    """
    scopes = F.array(F.lit("overall"), F.concat(F.lit("stage_"), F.lower(stage)))
    by = by or []
    rows = scored.select(*by, F.explode(scopes).alias("scope"), F.col(success).alias("ok"), *metrics)
    cols = [F.count("*").alias("total_samples"), F.count_if("ok").alias("successful_samples"),
            F.count_if(~F.col("ok")).alias("failed_samples")]
    for m in metrics:
        value = F.when(F.col("ok"), F.col(m))
        cols += [F.avg(value).alias(m), F.stddev_pop(value).alias(f"{m}_std")]
    return rows.groupBy(*by, "scope").agg(*cols)


# --- comparisons --------------------------------------------------------------

def compare_runs(rows: DataFrame, off, on) -> DataFrame:
    """Scores per label of two runs side by side, with the change in F1."""
    scores = label_scores(rows.where(F.col("run").isin(off, on)), ["run"])
    picked = []
    for name, run in (("off", off), ("on", on)):
        for m in ("f1", "precision", "recall"):
            picked.append(F.coalesce(F.max(F.when(F.col("run") == run, F.col(m))), F.lit(0.0)).alias(f"{m}_{name}"))
    wide = scores.groupBy("label").agg(*picked)
    return wide.withColumn("delta_f1", F.col("f1_on") - F.col("f1_off"))


def compare_macro(per_label: DataFrame) -> DataFrame:
    """One row: macro averages of both runs and their difference."""
    names = [f"{m}_{r}" for m in ("f1", "precision", "recall") for r in ("off", "on")]
    out = per_label.agg(*[F.avg(n).alias(f"macro_{n}") for n in names])
    return out.withColumn("macro_f1_delta", F.col("macro_f1_on") - F.col("macro_f1_off"))


def differing_labels(rows: DataFrame, off, on) -> DataFrame:
    """Labels whose prediction changed between two runs of the same study.

    Both runs meet in one aggregation per study and label instead of a self-join.
    """
    both = rows.where(F.col("run").isin(off, on)).groupBy("study_id", "label").agg(
        F.max(F.when(F.col("run") == off, F.col("value"))).alias("value_off"),
        F.max(F.when(F.col("run") == on, F.col("value"))).alias("value_on"))
    return both.where(F.col("value_off") != F.col("value_on"))
