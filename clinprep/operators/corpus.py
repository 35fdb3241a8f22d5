"""Corpus assembly: manifest joins, context deduplication, stages, splits and sampling."""

from __future__ import annotations

from math import floor

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clinprep import vocab
from clinprep.functions import text
from clinprep.functions.exprs import literal_map, scalar, seeded_hash, spread_nulls
from clinprep.operators.scaling import (
    hot_aware_join, order_cutoff, permuted, rank_digits, seeded_rank, share_count,
)
from clinprep.sources.files import stored

# --- manifest -----------------------------------------------------------------


def study_metadata(manifest: DataFrame, studies: DataFrame) -> DataFrame:
    """Left join of study metadata on a numeric study id; clashing names get ``_y``."""
    clash = (set(manifest.columns) & set(studies.columns)) - {"study_id"}
    right = studies.select("study_id", *[
        F.col(c).alias(f"{c}_y" if c in clash else c) for c in studies.columns if c != "study_id"])
    numeric = F.col("study_id").try_cast("long")
    # ids that are no numbers match nothing; their rows are dealt out by what they say
    left = manifest.withColumn("_key", spread_nulls(numeric, "study_id", *[c for c in manifest.columns if c != "study_id"])).withColumn("study_id", numeric)
    known = right.withColumn("_key", F.col("study_id").try_cast("long").cast("string")).where("_key is not null").drop("study_id")
    return left.join(known, "_key", "left").drop("_key")


def first_record(records: DataFrame, key: str, ordinal: str) -> DataFrame:
    """First record per key in file order, with the number of records of the key."""
    rest = [c for c in records.columns if c != key]
    return records.groupBy(key).agg(
        F.min_by(F.struct(*rest), F.col(ordinal)).alias("_r"), F.count("*").alias("n_records"),
    ).select(key, "_r.*", "n_records")


def last_record(records: DataFrame, key: str, ordinal: str) -> DataFrame:
    """Last record per key in file order (a later duplicate replaces an earlier one)."""
    rest = [c for c in records.columns if c != key]
    return records.groupBy(key).agg(
        F.max_by(F.struct(*rest), F.col(ordinal)).alias("_r")).select(key, "_r.*")


def existing(records: DataFrame, files: DataFrame, path: str = "path") -> DataFrame:
    """Records whose file is in the inventory ``files(path)``."""
    return records.join(files.select(F.col("path").alias(path)), path, "left_semi")


def missing(records: DataFrame, files: DataFrame, path: str = "path") -> DataFrame:
    return records.join(files.select(F.col("path").alias(path)), path, "left_anti")


def manifest_candidates(studies: DataFrame, impressions: DataFrame, labels: DataFrame,
                        images: DataFrame, files: DataFrame | None = None,
                        ordinal: str = "ordinal") -> DataFrame:
    """Every study with whatever it has of impression, labels and first image, and why it fails.

    ``impressions`` is keyed ``s`` + study id; ``labels`` and ``images`` by study id.
    The image side is reduced to one row per study before the join, so a study with very
    many images costs no more than any other.
    """
    first = first_record(images.select("study_id", "path", ordinal), "study_id", ordinal)
    first = first.select("study_id", text.jpg_path(F.col("path")).alias("image_path"), "n_records")
    said = impressions.select(
        F.regexp_replace("study_id", "^s", "").try_cast("long").alias("study_id"), "impression")
    joined = (
        studies.join(said, "study_id", "left")
        .join(labels.select("study_id", F.col("labels").alias("chexpert")), "study_id", "left")
        .join(first, "study_id", "left")
    )
    present = F.lit(True)
    if files is not None:
        known = files.select(F.col("path").alias("_path"), F.lit(True).alias("_present"))
        keyed = joined.withColumn("_path", spread_nulls(F.col("image_path"), "study_id"))
        joined = keyed.join(known, "_path", "left").drop("_path")
        present = F.coalesce("_present", F.lit(False))
    view = text.view_of_path(F.col("image_path"))
    return joined.withColumn("image_id", text.image_id(F.col("image_path"))).withColumn("view", view).withColumn(
        "reason",
        F.when(F.col("impression").isNull(), "no_impression")
        .when(F.col("chexpert").isNull(), "no_chexpert")
        .when(F.col("image_path").isNull(), "no_image")
        .when(~present, "missing_file")
        .when(~F.col("view").isin(vocab.FRONTAL_VIEWS), "non_frontal"),
    ).drop("_present")


def manifest(candidates: DataFrame) -> DataFrame:
    return candidates.where(F.col("reason").isNull()).select(
        "image_path", "image_id", "study_id", "subject_id", "view", "impression", "chexpert")


def rejections(candidates: DataFrame) -> DataFrame:
    """Count per rejection reason.

    A missing file or a side view counts once per image of the study, and the study then
    also counts as having no image.
    """
    per_image = F.col("reason").isin("missing_file", "non_frontal")
    counted = F.array(F.struct(F.col("reason").alias("reason"),
                               F.when(per_image, F.col("n_records")).otherwise(1).cast("long").alias("n")))
    also = F.array(F.struct(F.lit("no_image").alias("reason"), F.lit(1).cast("long").alias("n")))
    rows = candidates.where(F.col("reason").isNotNull()).select(
        F.explode(F.when(per_image, F.concat(counted, also)).otherwise(counted)).alias("r"))
    return rows.groupBy("r.reason").agg(F.sum("r.n").alias("n"))


# --- context deduplication ----------------------------------------------------

def canonical_map(col: Column) -> Column:
    """Text form of a map that does not depend on entry order."""
    return F.to_json(F.array_sort(F.map_entries(col)))


def context_key(by: str = "full") -> Column:
    """Key under which contexts count as the same: the whole content, or the subject alone."""
    if by == "subject":
        return F.col("subject_id").cast("string")
    e = F.col("ehr_json")
    parts = [F.col("subject_id"), e["hadm_id"], e["Age"], e["Sex"], canonical_map(e["Vitals"]),
             canonical_map(e["Labs"]), F.to_json(e["Chronic_conditions"])]
    return F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def representative_map(contexts: DataFrame, by: str = "full") -> DataFrame:
    """``study_id, representative, n_same``: the lowest study id stands for equal contexts."""
    keyed = contexts.select("study_id", context_key(by).alias("key"))
    groups = keyed.groupBy("key").agg(F.min("study_id").alias("representative"), F.count("*").alias("n_same"))
    return hot_aware_join(keyed, groups, "key", F.col("n_same"), ["study_id"]).drop("key")


def deduplicate(contexts: DataFrame, mapping: DataFrame) -> DataFrame:
    """The contexts that represent a group."""
    own = mapping.where(F.col("study_id") == F.col("representative")).select("study_id", "n_same")
    return contexts.join(own, "study_id")


def stage_a(manifest_rows: DataFrame) -> DataFrame:
    return manifest_rows.select("study_id", "subject_id", "image_path", "impression",
                                F.col("chexpert").alias("chexpert_labels"), F.lit("A").alias("stage"))


def stage_b(manifest_rows: DataFrame, mapping: DataFrame, deduplicated: DataFrame) -> DataFrame:
    """Manifest rows with the representative context of their study; unmatched rows drop out."""
    matched = manifest_rows.join(mapping.select("study_id", "representative"), "study_id")
    e = F.col("ehr_json")
    data = deduplicated.select(
        F.col("study_id").alias("representative"), "n_same",
        F.struct("subject_id", e["Age"].alias("Age"), e["Sex"].alias("Sex"), e["hadm_id"].alias("hadm_id"),
                 e["admission_type"].alias("admission_type"), e["Vitals"].alias("Vitals"),
                 e["Labs"].alias("Labs"), e["O2_device"].alias("O2_device"),
                 e["Chronic_conditions"].alias("Chronic_conditions")).alias("patient_data"))
    joined = hot_aware_join(matched, data, "representative", F.col("n_same"), ["study_id"])
    return joined.select("study_id", "subject_id", "image_path", "impression",
                         F.col("chexpert").alias("chexpert_labels"), F.lit("B").alias("stage"), "patient_data")


# --- split and mix ------------------------------------------------------------

def with_split(samples: DataFrame, group: str = "subject_id", share: float = vocab.VALIDATION_SHARE,
               seed: int = 42) -> DataFrame:
    """Add ``split``: the first ``floor(share * groups)`` groups in seeded order validate.

    One split serves both stages, so no group is ever on both sides. The cut is a single
    value, applied row by row: the samples are neither shuffled nor joined.
    """
    groups = samples.select(group).distinct()
    cutoff = order_cutoff(groups, group, seed, share_count(groups, share))
    chosen = F.coalesce(seeded_hash(seed, group) <= F.lit(cutoff), F.lit(False))
    return samples.withColumn("split", F.when(chosen, "val").otherwise("train"))


def shuffled(samples: DataFrame, id_col: str, seed: int = 42) -> DataFrame:
    """Reproducible random order (a range-partitioned sort by seeded hash)."""
    return samples.orderBy(seeded_hash(seed, id_col), id_col)


def demo_sample(samples: DataFrame, id_col: str, n_per_stage: int = 40, seed: int = 42) -> DataFrame:
    """``n`` samples of each stage, numbered ``demo_a_001`` and so on.

    Rows are counted per stage and leading digits of the hash; only those of the first buckets,
    which together hold ``n``, are sorted.
    """
    order, digits = seeded_hash(seed, id_col), rank_digits(samples.count())
    bucket = F.substring(order, 1, digits)
    before = Window.partitionBy("_stage").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = samples.groupBy(F.col("stage").alias("_stage"), bucket.alias("_bucket")).agg(F.count("*").alias("_n"))
    first = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).where(F.col("_before") < n_per_stage)
    near = samples.join(F.broadcast(first), F.col("stage").eqNullSafe(F.col("_stage")) & (bucket == F.col("_bucket")), "left_semi")
    picked = near.withColumn("_n", F.row_number().over(Window.partitionBy("stage").orderBy(order, id_col))).where(F.col("_n") <= n_per_stage)
    name = F.concat(F.lit("demo_"), F.lower("stage"), F.lit("_"), F.format_string("%03d", "_n"))
    sidecar = F.when(F.col("stage") == "B", F.concat(F.lit("demo_ehr/"), name, F.lit("_ehr.json")))
    return picked.withColumn("demo_id", name).withColumn("ehr_json_path", sidecar).drop("_n")


def by_stage(samples: DataFrame, stage: str = "both") -> DataFrame:
    """``stage_a``, ``stage_b`` or ``both``."""
    wanted = {"stage_a": ["A"], "stage_b": ["B"]}.get(stage)
    return samples if wanted is None else samples.where(F.col("stage").isin(wanted))


def is_low_ehr(vitals: Column, labs: Column) -> Column:
    return (F.coalesce(F.size(vitals), F.lit(0)) <= 2) & (F.coalesce(F.size(labs), F.lit(0)) <= 2)


def strip_patient(patient: Column, keep_containers: bool = False) -> Column:
    """Patient data without measurements: age and sex only, or empty containers with defaults."""
    if not keep_containers:
        minimal = F.struct(patient["Age"].alias("Age"), patient["Sex"].alias("Sex"))
        return F.when(patient.isNotNull(), minimal)
    return F.struct(
        F.coalesce(patient["subject_id"], F.lit(0)).alias("subject_id"),
        F.coalesce(patient["Age"], F.lit(0)).alias("Age"),
        F.coalesce(patient["Sex"], F.lit("Unknown")).alias("Sex"),
        F.map_filter(patient["Vitals"], lambda k, v: F.lit(False)).alias("Vitals"),
        F.map_filter(patient["Labs"], lambda k, v: F.lit(False)).alias("Labs"),
        F.lit(None).cast("string").alias("O2_device"),
        F.array().cast("array<string>").alias("Chronic_conditions"),
    )


def epoch_mix(samples: DataFrame, id_col: str, low_ehr: Column, seed: int, epoch: int = 0,
              share_b: float = vocab.STAGE_B_SHARE) -> DataFrame:
    """All stage A, as many synthetic stage-A rows as there are stage-A rows, and a share of B.

    Synthetic rows come from the low-EHR rows when there are enough, else from all of B.
    ``part`` says where a row came from; its patient data is stripped by the caller.
    The counts and two cut-offs are single values, so the mix itself is one scan without a shuffle.
    """
    seed = seed + epoch
    low = F.coalesce(low_ehr, F.lit(False))
    in_a, in_b = F.col("stage") == "A", F.col("stage") == "B"
    n_a, n_b, n_low = samples.agg(F.count_if(in_a), F.count_if(in_b), F.count_if(in_b & low)).first()
    in_pool = in_b & low if n_low >= n_a else in_b
    n_synthetic = min(n_low if n_low >= n_a else n_b, n_a)
    n_keep = max(1, floor(n_b * share_b + 1e-9))

    def first(pool: Column, key: str, count: int) -> Column:
        cutoff = order_cutoff(samples.where(pool), id_col, key, count)
        return F.coalesce(pool & (seeded_hash(key, id_col) <= F.lit(cutoff)), F.lit(False))

    parts = F.array_compact(F.array(
        F.when(in_a, "A"), F.when(first(in_pool, f"{seed}s", n_synthetic), "synthetic"), F.when(first(in_b, f"{seed}b", n_keep), "B")))
    mixed = samples.withColumn("part", F.explode(parts))
    return mixed.withColumn("stage", F.when(F.col("part") == "synthetic", F.lit("A")).otherwise(F.col("stage")))


# --- weights ------------------------------------------------------------------

def class_weights(frequencies: DataFrame, boost: float, name: str = "name", freq: str = "n") -> DataFrame:
    """sqrt(max/freq), boosted for classes rarer than a tenth of the most frequent one."""
    top = scalar(frequencies, F.max(freq))
    weight = F.sqrt(top / F.col(freq))
    return frequencies.withColumn(
        "weight", F.when(F.col(freq) < top * 0.1, weight * boost).otherwise(weight))


def row_weights(samples: DataFrame, classes: list[tuple[Column, DataFrame]], max_classes: int = 10_000) -> DataFrame:
    """Product of the weights of a row's classes, normalized to sum 1.

    ``classes`` pairs an array of class names with a weight table. A table of at most
    ``max_classes`` names (checked) becomes one map value, so the rows are not joined. The
    weights are stored once; the sum is taken from what is stored.
    """
    staged, weight = samples, F.lit(1.0)
    for i, (names, table) in enumerate(classes):
        known = {r.name: r.weight for r in table.select("name", "weight").limit(max_classes + 1).collect()}
        if len(known) > max_classes:
            raise ValueError(f"more than {max_classes} classes have weights")
        # a map column beside the rows, so the literal is not repeated inside the fold
        staged = staged.withColumn(f"_weights_{i}", literal_map(known) if known else F.lit(None).cast("map<string,double>"))

        def step(total, name, column=f"_weights_{i}"):
            return total * F.coalesce(F.try_element_at(F.col(column), name), F.lit(1.0))

        weight = weight * F.aggregate(names, F.lit(1.0), lambda total, name: step(total, name))
    weighted = stored(staged.withColumn("raw_weight", weight).drop(*[f"_weights_{i}" for i in range(len(classes))]), "weights")
    return weighted.withColumn("weight", F.col("raw_weight") / F.lit(weighted.agg(F.sum("raw_weight")).first()[0]))


def rare_label_weights(samples: DataFrame, labels: str, icd: str, boost: float = vocab.RARE_BOOST) -> DataFrame:
    """``boost`` per positive rare label, normalized to mean 1."""
    weight = F.lit(1.0)
    for col, names in ((labels, vocab.RARE_FINDINGS), (icd, vocab.RARE_ICD)):
        for n in names:
            hit = F.coalesce(F.try_element_at(F.col(col), F.lit(n)) == 1, F.lit(False))
            weight = weight * F.when(hit, boost).otherwise(1.0)
    weighted = samples.withColumn("raw_weight", weight)
    return weighted.withColumn("weight", F.col("raw_weight") / scalar(weighted, F.avg("raw_weight")))


def cumulative_weight(items: DataFrame, id_col: str, seed: int = 42) -> DataFrame:
    """Half-open share ``[low, high)`` of the unit interval per item, without a global sort."""
    spans, _ = _weight_spans(items, id_col, seed, rank_digits(items.count()))
    return spans.drop("_bucket", "_end")


def _weight_spans(items: DataFrame, id_col: str, seed: int, digits: int) -> tuple[DataFrame, DataFrame]:
    """Items with their spans, and buckets of leading digits with theirs.

    ``_end`` is where the next item begins, so that spans of doubles leave no gap.
    """
    # a weight is cut at a fixed binary place: sums of the upper parts are exact, whatever their
    # order, and those of the lower parts too small for their rounding to matter
    size = F.pow(F.lit(2.0), F.ceil(F.log2(scalar(items, F.sum("weight")))) + 1)
    parts = items.withColumn("_size", size).withColumn("_high", (F.col("weight") + F.col("_size")) - F.col("_size")).withColumn(
        "_low", F.col("weight") - F.col("_high")).drop("_size")
    spread = parts.withColumn("_order", seeded_hash(seed, id_col)).withColumn("_bucket", F.substring("_order", 1, digits))
    sums = spread.groupBy("_bucket").agg(F.sum("_high").alias("_high"), F.sum("_low").alias("_low"))
    upto = Window.partitionBy(F.lit(1)).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = scalar(parts, F.sum("_high") + F.sum("_low"))
    running = sums.select("_bucket", F.sum("_high").over(upto).alias("_to_high"), F.sum("_low").over(upto).alias("_to_low"))
    next_bucket = Window.partitionBy(F.lit(1)).orderBy("_bucket")
    buckets = running.select(
        "_bucket", F.lag("_to_high", 1, 0.0).over(next_bucket).alias("_before_high"), F.lag("_to_low", 1, 0.0).over(next_bucket).alias("_before_low"),
        F.when(F.lead("_bucket").over(next_bucket).isNull(), 1.0).otherwise((F.col("_to_high") + F.col("_to_low")) / total).alias("_stop")).withColumn(
        "_start", (F.col("_before_high") + F.col("_before_low")) / total)
    inside = Window.partitionBy("_bucket").orderBy("_order", id_col)
    sofar = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = spread.withColumns({"_upto_high": F.sum("_high").over(sofar), "_upto_low": F.sum("_low").over(sofar)}).withColumns({
        "_from_high": F.lag("_upto_high", 1, 0.0).over(inside), "_from_low": F.lag("_upto_low", 1, 0.0).over(inside),
        "_last": F.lead("_upto_high").over(inside).isNull()})
    spans = summed.join(F.broadcast(buckets) if digits <= 4 else buckets, "_bucket")

    def place(at: str) -> Column:
        return ((F.col("_before_high") + F.col(f"{at}_high")) + (F.col("_before_low") + F.col(f"{at}_low"))) / total

    return spans.withColumn("low", place("_from")).withColumn("high", place("_upto")).withColumn(
        "_end", F.when(F.col("_last"), F.col("_stop")).otherwise(F.col("high"))).select(
        *items.columns, "_bucket", "low", "high", "_end"), buckets


#: Draws, and items, that a cell of ``weighted_draws`` holds, on average.
CELL_DRAWS, CELL_ITEMS = 64, 1024


def weighted_draws(items: DataFrame, id_col: str, draws: DataFrame, cells: int | None = None,
                   seed: int = 42) -> DataFrame:
    """One item per draw, with replacement, in proportion to ``weight``.

    ``draws`` holds ``draw`` (unique, of any type) and ``u`` in [0, 1). One ordered pass per cell
    carries the item that covers each draw; no item-draw pairs are formed.
    """
    placed = draw_cells(items, id_col, draws, cells, seed)
    upto = Window.partitionBy("_grid", "_bucket").orderBy("_pos", "_kind", "_item", "draw").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    carried = placed.withColumn("_pick", F.last("_item", ignorenulls=True).over(upto))
    return carried.where(F.col("_kind") == 1).select("draw", F.col("_pick").alias(id_col))


def draw_cells(items: DataFrame, id_col: str, draws: DataFrame, cells: int | None = None, seed: int = 42) -> DataFrame:
    """Items (``_kind`` 0) and draws (1) side by side in cells that are small in both.

    The unit interval is cut twice: evenly, into ``cells`` (one for every 64 draws), which bounds
    the draws of a cell; and between buckets of items, of about a thousand each in the order of
    their spans, which bounds its items however small their weights are. An item marks every
    even cell that it reaches into. Items of a weight too small to move a double cover no draw.
    """
    items = stored(items.select(id_col, "weight"), "items")
    cells = cells or max(16, draws.count() // CELL_DRAWS)
    spans, buckets = _weight_spans(items, id_col, seed, rank_digits(items.count(), CELL_ITEMS))

    def cell(position) -> Column:
        return F.least(F.greatest(F.floor(position * cells), F.lit(0)), F.lit(cells - 1)).cast("long")

    marks = spans.where("low < _end").withColumn("_grid", F.explode(F.sequence(cell(F.col("low")), cell(F.col("_end"))))).select(
        "_grid", "_bucket", F.col("low").alias("_pos"), F.lit(0).alias("_kind"), F.col(id_col).alias("_item"),
        F.lit(None).cast(draws.schema["draw"].dataType).alias("draw"))
    # the buckets that reach into an even cell, few on average
    reaching = buckets.where("_start < _stop").withColumn("_grid", F.explode(F.sequence(cell(F.col("_start")), cell(F.col("_stop"))))).groupBy("_grid").agg(
        F.array_sort(F.collect_list(F.struct("_start", "_bucket"))).alias("_reaching"))
    begun = F.filter("_reaching", lambda b: b["_start"] <= F.col("u"))
    asked = draws.select("draw", "u", cell(F.col("u")).alias("_grid")).join(reaching, "_grid", "left").select(
        "_grid", F.try_element_at(begun, F.lit(-1))["_bucket"].alias("_bucket"), F.col("u").alias("_pos"), F.lit(1).alias("_kind"),
        F.lit(None).cast(items.schema[id_col].dataType).alias("_item"), "draw")
    return marks.unionByName(asked)


def uniform(seed: int, *cols) -> Column:
    """Reproducible number in [0, 1) from a seed and columns."""
    digits = F.substring(seeded_hash(seed, *cols), 1, 13)
    return F.conv(digits, 16, 10).cast("double") / F.lit(float(16 ** 13))


# --- curriculum schedule ------------------------------------------------------

def mix_ratios(progress: Column, split: float, early: tuple[float, float]) -> tuple[Column, Column]:
    """Stage-A and synthetic share at a training progress in [0, 1]."""
    late_a, late_s, _ = vocab.LATE_MIX
    return (F.when(progress < split, early[0]).otherwise(late_a),
            F.when(progress < split, early[1]).otherwise(late_s))


def stepped_ratios(progress: Column) -> tuple[Column, Column]:
    """Shares from the configured step table."""
    a = s = None
    for start, share_a, share_s in sorted(vocab.MIX_STEPS, reverse=True):
        a = F.when(progress >= start, share_a) if a is None else a.when(progress >= start, share_a)
        s = F.when(progress >= start, share_s) if s is None else s.when(progress >= start, share_s)
    return a, s


SCHEDULE_STARTS = 4096


def schedule(spark: SparkSession, total_steps: int | Column, batch_size: int, split: float = 0.5,
             early: tuple[float, float] | None = (0.5, 0.2)) -> DataFrame:
    """Rows per step and part; fractions are cut off and stage B takes the remainder.

    ``total_steps`` is a number, or a scalar subquery such as one on the number of samples.
    """
    total = F.lit(total_steps) if isinstance(total_steps, int) else total_steps
    progress = F.col("step") / F.col("total")
    a, s = mix_ratios(progress, split, early) if early is not None else stepped_ratios(progress)
    # many rows to start from, so that the steps come from all cores and not from one task
    starts = spark.range(SCHEDULE_STARTS).select("id", total.cast("long").alias("total")).where("id < total")
    steps = starts.select("total", F.explode(F.sequence(F.col("id"), F.col("total") - 1, F.lit(SCHEDULE_STARTS).cast("long"))).alias("step"))
    whole = steps.withColumn("n_a", F.floor(a * batch_size).cast("long")).withColumn(
        "n_synthetic", F.floor(s * batch_size).cast("long"))
    return whole.withColumn("n_b", F.lit(batch_size) - F.col("n_a") - F.col("n_synthetic")).drop("total")


def batches(plan: DataFrame, samples: DataFrame, id_col: str, weights: DataFrame | None = None,
            seed: int = 42) -> DataFrame:
    """``step, part, slot, id``: the rows of every batch.

    Stage A and synthetic rows are drawn without replacement within a batch and anew for each
    (a keyed permutation of the ranks); stage B rows with replacement by weight, or without
    weights like the others.
    """
    # one row per stage, so the broadcast side is bounded by the stage vocabulary
    sizes = samples.groupBy("stage").agg(F.count("*").alias("_size"))

    def slots(stage, count, part):
        n = F.col(count)
        rows = plan.where(n > 0).select("step", F.lit(stage).alias("stage"), F.lit(part).alias("part"),
                                        F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("slot"))
        return rows.join(F.broadcast(sizes), "stage").where(F.col("slot") < F.col("_size"))

    def ranked(stage, part, count):
        pool = seeded_rank(samples.where(F.col("stage") == stage).select(id_col), id_col, seed)
        place = permuted(F.col("slot"), F.col("_size"), F.lit(seed), F.lit(part), F.col("step"))
        # never null, and said so: else the filter that the join infers works out every place again
        wanted = slots(stage, count, part).withColumn("rank", F.coalesce(place + 1, F.lit(0).cast("long")))
        # the slots are exploded, so their estimated size is far too small: never to be broadcast
        return wanted.hint("merge").join(pool, "rank").select("step", "part", "slot", id_col)

    a = ranked("A", "A", "n_a")
    synthetic = ranked("B", "synthetic", "n_synthetic")
    if weights is None:
        return a.unionByName(synthetic).unionByName(ranked("B", "B", "n_b"))
    asked = slots("B", "n_b", "B").select(F.struct("step", "slot").alias("draw"), uniform(seed, "step", "slot").alias("u"))
    drawn = weighted_draws(weights, id_col, asked, seed=seed)
    b = drawn.select("draw.step", F.lit("B").alias("part"), "draw.slot", id_col)
    return a.unionByName(synthetic).unionByName(b)
