"""Readers and writers. Schemas are given, never inferred."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyarrow.fs import FileSelector, FileSystem, FileType
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clinprep.functions.exprs import spread_nulls
from clinprep.functions.parse import is_json, last_of_key
from clinprep.session import scratch_dir
from clinprep.sources.splits import odd_json_quotes, read_quoted_csv, units

BAD_RECORD = "_bad_record"


# --- warehouse tables ---------------------------------------------------------

def read_csv_table(spark: SparkSession, path: str, schema: T.StructType, **options) -> DataFrame:
    """A warehouse CSV (plain or gzip) as text columns, each cast where its value allows.

    Columns are found by the names in the header, in any order and among others; a missing
    one, or files of one folder with different headers, is an error. A cell that does not fit
    its type becomes null instead of failing the load, which is the text fallback and the
    typed load in one pass. Gzip files cannot be split: persist the result with
    ``store_table`` before using it more than once.
    """
    header = spark.read.options(header=True, **options).csv(path).columns
    missing = [f.name for f in schema.fields if f.name not in header]
    if missing:
        raise ValueError(f"{path} lacks columns {missing}; its header has {header}")
    texts = T.StructType([T.StructField(name, T.StringType()) for name in header])
    raw = spark.read.schema(texts).options(header=True, mode="PERMISSIVE", enforceSchema=False, **options).csv(path)
    return raw.select(*[
        F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name) if not isinstance(f.dataType, T.StringType) else F.col(f"`{f.name}`")
        for f in schema.fields])


def load_warehouse(spark: SparkSession, folder: str, schemas: dict[str, T.StructType]) -> dict[str, DataFrame]:
    """All tables that exist under ``folder``; missing files are skipped."""
    out = {}
    for name, schema in schemas.items():
        for suffix in (".csv.gz", ".csv"):
            path = f"{folder}/{name}{suffix}"
            if path_exists(spark, path):
                out[name] = read_csv_table(spark, path, schema)
                break
    return out


def store_table(df: DataFrame, path: str, cluster_by: str | None = None) -> DataFrame:
    """Persist as Parquet, optionally with the rows of neighbouring keys together.

    Range partitioning cuts by sampled quantiles; within files the rows are sorted, so
    later filters and joins on the key skip row groups.
    """
    out = df if cluster_by is None else df.repartitionByRange(cluster_by).sortWithinPartitions(cluster_by)
    out.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def qualified(spark: SparkSession, path: str) -> str:
    """The path as Spark's readers name it, without a slash at its end."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(target).toString().rstrip("/")


# --- JSON lines ---------------------------------------------------------------

def read_jsonl(spark: SparkSession, path: str, schema: T.StructType, bad_records: bool = False) -> DataFrame:
    """JSON lines with a given schema; blank lines are skipped, and so are malformed ones.

    ``bad_records`` keeps malformed lines as rows whose only value is the line, in column
    ``BAD_RECORD``, for the counts of a correction run.
    """
    raw = spark.read.text(path)
    folders = [c for c in raw.columns if c != "value"]  # columns that the folder names hold
    inside = [f for f in schema.fields if f.name not in folders]
    parsed = F.from_json("value", T.StructType([*inside, T.StructField(BAD_RECORD, T.StringType())]),
                         {"columnNameOfCorruptRecord": BAD_RECORD})
    rows = raw.where(F.trim("value") != "").select(*folders, parsed.alias("_row"))
    bad = F.col(f"_row.{BAD_RECORD}")
    columns = [F.col(f.name).cast(f.dataType).alias(f.name) if f.name in folders else F.col(f"_row.{f.name}") for f in schema.fields]
    return rows.select(*columns, bad.alias(BAD_RECORD)) if bad_records else rows.where(bad.isNull()).select(*columns)


def write_jsonl(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).json(path)


def malformed_lines(spark: SparkSession, path: str) -> DataFrame:
    """``file, line_number, line`` of lines that are not valid JSON (blank lines are fine).

    Large files stay split: a line knows its place within its split, and the splits before
    it in the file, a short table, supply the offset.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("id"), F.col("value").alias("line"))
    splits = lines.groupBy("file", "block").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = splits.withColumn("offset", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n")
    bad = malformed_in(lines).join(offsets, ["file", "block"])
    return bad.select("file", (F.col("offset") + F.col("id") - F.col("first") + 1).alias("line_number"), "line")


def malformed_in(lines: DataFrame, line: str = "line") -> DataFrame:
    """Rows whose text is neither blank nor one valid JSON value."""
    return lines.where((F.trim(line) != "") & ~is_json(F.col(line)))


# --- report corpus ------------------------------------------------------------

#: Files up to which Spark's reader takes a folder of reports: it lists them on the driver and
#: gives each task few of them, so beyond that tasks list and read.
LISTED = 1000
READ_BYTES, READ_FILES = 32 << 20, 4000  # of a task, on average
BATCH_BYTES, BATCH_FILES = 4 << 20, 500
LIST_ROWS = 10_000


def read_reports(spark: SparkSession, folder: str) -> DataFrame:
    """Every ``*.txt`` below the folder: file stem as study id, whole text, source file.

    Bytes that are not valid UTF-8 are dropped; empty files are passed over. Beyond ``LISTED`` files the folders are listed, and
    the files read, by tasks through ``pyarrow.fs``, so the driver holds nothing of a file. Where
    that cannot open the folder, or its name is a pattern, Spark's reader takes files of any number.
    """
    raw = read_by_tasks(spark, folder, ".txt")
    if raw is None:
        raw = (spark.read.format("binaryFile").option("recursiveFileLookup", True)
               .option("pathGlobFilter", "*.txt").load(folder))
    name = F.substring_index("path", "/", -1)
    # invalid bytes become the replacement mark, which is then removed
    valid = F.make_valid_utf8(F.col("content").cast("string"))
    body = F.replace(valid, F.lit("\ufffd"), F.lit(""))
    return raw.select(F.regexp_replace(name, r"\.txt$", "").alias("study_id"), body.alias("report"),
                      F.col("path").alias("source_file"))


def read_by_tasks(spark: SparkSession, folder: str, suffix: str) -> DataFrame | None:
    """``path, content`` of more than ``LISTED`` files; else, or if only Spark can open them, ``None``."""
    if any(c in folder for c in "*?[]{}\\%"):
        return None
    try:
        system, root = FileSystem.from_uri(folder)
        if system.get_file_info(root).type != FileType.Directory:
            return None
    except (pa.ArrowException, OSError):
        return None
    found = find_files(spark, folder, suffix).where("size > 0")
    n, size = found.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    if n <= LISTED:
        return None

    def read(batches):
        system, root = FileSystem.from_uri(folder)
        root = root.rstrip("/")
        for batch in batches:
            paths, contents, size = [], [], 0
            for path in batch.column(0).to_pylist():
                with system.open_input_stream(f"{root}/{path}", compression=None) as file:
                    content = file.read()
                if paths and size + len(content) > BATCH_BYTES or len(paths) == BATCH_FILES:
                    yield pa.record_batch({"path": pa.array(paths), "content": pa.array(contents, pa.binary())})
                    paths, contents, size = [], [], 0
                paths.append(path)
                contents.append(content)
                size += len(content)
            if paths:
                yield pa.record_batch({"path": pa.array(paths), "content": pa.array(contents, pa.binary())})

    parts = max(spark.sparkContext.defaultParallelism, size // READ_BYTES, n // READ_FILES)
    return found.select("path").repartition(parts).mapInArrow(read, "path string, content binary").select(
        F.concat(F.lit(f"{qualified(spark, folder)}/"), "path").alias("path"), "content")


def find_files(spark: SparkSession, folder: str, suffix: str) -> DataFrame:
    """``path`` relative to the folder, and ``size``, of the files below it with that end of their names.

    Tasks list the folders of one level after the other; what Spark's readers pass over is passed over.
    """
    def seen(name: str) -> bool:
        hidden = name.startswith(".") or name.endswith("._COPYING_") or name.startswith("_") and "=" not in name
        return not hidden or name.startswith(("_metadata", "_common_metadata"))

    def listed(batches):
        system, root = FileSystem.from_uri(folder)
        root = root.rstrip("/")
        for batch in batches:
            for inside in batch.column(0).to_pylist():
                # a folder that went away since its parent was listed holds nothing
                infos = system.get_file_info(FileSelector(f"{root}/{inside}", allow_not_found=True))
                for i in range(0, len(infos), LIST_ROWS):
                    some = [(f"{inside}{x.base_name}", x) for x in infos[i:i + LIST_ROWS] if seen(x.base_name)]
                    some = [(f"{path}/", None) if x.type == FileType.Directory else (path, x.size) for path, x in some
                            if x.type == FileType.Directory or x.base_name.endswith(suffix)]
                    yield pa.record_batch({"path": pa.array([p for p, _ in some], pa.string()), "size": pa.array([n for _, n in some], pa.int64())})

    folders, levels = spark.createDataFrame([("",)], "path string"), []
    most, n = 4 * spark.sparkContext.defaultParallelism, 1
    while n:
        levels.append(stored(folders.repartition(min(n, most)).mapInArrow(listed, "path string, size long"), "listing"))
        folders = levels[-1].where("size is null").select("path")
        n = folders.count()
    return reduce(DataFrame.unionByName, levels).where("size is not null")


def write_reports(reports: DataFrame, folder: str, per_folder: int = 1000) -> None:
    """One ``*.txt`` file per row of the one text column, with a line break at its end, in folders of ``per_folder``.

    Tasks write through ``pyarrow.fs``: Spark's writer opens every file with a permission, for which
    Hadoop's local file system starts a process. Names follow the place of a row, so a task
    that runs again replaces its own files.
    """
    def write(batches):
        task, n = TaskContext.get().partitionId(), 0
        system, root = FileSystem.from_uri(folder)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                inside = f"{root}/p{task:05d}/{n // per_folder:05d}"
                if n % per_folder == 0:
                    system.create_dir(inside)
                with system.open_output_stream(f"{inside}/s{task:05d}_{n:08d}.txt") as out:
                    out.write(((text or "") + "\n").encode())
                n += 1
        yield pa.record_batch({"files": pa.array([n], pa.int64())})

    reports.mapInArrow(write, "files long").write.format("noop").mode("overwrite").save()


def file_inventory(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """``path`` relative to the folder of every file below it; contents are not read."""
    found = (spark.read.format("binaryFile").option("recursiveFileLookup", True)
             .option("pathGlobFilter", pattern).load(folder).select("path"))
    root = folder.rstrip("/") + "/"
    return found.select(F.substring_index("path", root, -1).alias("path"))


# --- label maps ---------------------------------------------------------------

def write_map_table(maps: DataFrame, path: str) -> None:
    maps.write.mode("overwrite").parquet(path)


def read_map_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def import_map_document(spark: SparkSession, path: str) -> DataFrame:
    """One JSON document ``{study: {label: value}}``, in any layout, as ``study_id, labels``.

    A closing brace outside strings ends a study, so the document is read in splits and never
    as a whole; keys may hold braces, quotes and escapes. Text that is neither a study nor the
    document's own braces is an error; that the last braces are missing is not noticed. Of
    repeated labels the last counts.
    """
    chunks = units(spark, path, "}", odd_json_quotes(F.col("value"))).select(F.col("unit").alias("value")).where(~F.col("value").rlike(r"^[\s,]*$"))
    head = r'(?s)^[\s,]*\{?\s*"((?:[^"\\]|\\.)*+)"\s*:\s*(?=\{)'
    empty = F.col("value").rlike(r"^\s*\{\s*$")  # a document without studies
    body = F.concat(F.regexp_replace("value", head, ""), F.lit("}"))
    key = F.get(F.from_json(F.concat(F.lit('["'), F.regexp_extract("value", head, 1), F.lit('"]')), "array<string>"), 0)
    values = F.when(is_json(body), last_of_key(F.from_json(body, "map<string,double>")))
    labels = F.transform_values(values, lambda _, v: v.cast("int"))
    wrong = F.raise_error(F.concat(F.lit("not a study of a label document: "), F.substring("value", 1, 200)))
    return chunks.where(~empty).select(
        key.alias("study_id"),
        F.when(F.col("value").rlike(head) & values.isNotNull() & key.isNotNull(), labels).otherwise(wrong.cast("map<string,int>")).alias("labels"))


# --- evaluation manifest and sidecars -----------------------------------------

MANIFEST_FIELDS = ["study_id", "image_path", "stage", "ehr_json_path", "ground_truth_impression",
                   "ground_truth_chexpert", "ground_truth_icd", "subject_id"]


def quasi_json(col: Column, schema: str) -> Column:
    """Python-style text (single quotes) parsed as JSON; null stays null."""
    return F.from_json(col, schema, {"allowSingleQuotes": "true"})


def read_eval_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation manifest CSV, columns by header name, with its two quasi-JSON columns parsed.

    Quoted cells may hold line breaks; files are read in splits all the same.
    """
    return parse_manifest(read_quoted_csv(spark, path, MANIFEST_FIELDS))


def parse_manifest(raw: DataFrame) -> DataFrame:
    return raw.withColumn("findings", quasi_json(F.col("ground_truth_chexpert"), "map<string,int>")).withColumn(
        "icd", F.coalesce(
            quasi_json(F.col("ground_truth_icd"), "array<struct<code:string,description:string,confidence:double>>"),
            F.array())).drop("ground_truth_chexpert", "ground_truth_icd")


def read_sidecars(spark: SparkSession, folder: str) -> DataFrame:
    """JSON files below a folder, whole, keyed by their path relative to it."""
    raw = (spark.read.option("recursiveFileLookup", True)
           .option("pathGlobFilter", "*.json").text(folder, wholetext=True).select("_metadata.file_path", "value"))
    root = folder.rstrip("/") + "/"
    return raw.select(F.substring_index("file_path", root, -1).alias("path"), F.col("value").alias("record"))


def attach_sidecars(manifest: DataFrame, sidecars: DataFrame, path: str = "ehr_json_path",
                    prefix: str = "evaluation/", spread: str = "study_id") -> DataFrame:
    """Left join on the path as given, else on the path under the alternative prefix.

    Rows without a path match nothing; their keys are spread so that they do not gather.
    """
    given = F.col(path)
    keyed = manifest.withColumn("_key", spread_nulls(given, spread)).withColumn(
        "_other", spread_nulls(F.concat(F.lit(prefix), given), spread))
    first = sidecars.select(F.col("path").alias("_key"), F.col("record").alias("_first"))
    second = sidecars.select(F.col("path").alias("_other"), F.col("record").alias("_second"))
    return keyed.join(first, "_key", "left").join(second, "_other", "left").select(
        *manifest.columns, F.coalesce("_first", "_second").alias("record"))


# --- metric sinks -------------------------------------------------------------

def write_metrics_wide(metrics: DataFrame, path: str, single_file: bool = True) -> None:
    """Metrics as CSV: aggregates as one file; set ``single_file=False`` for rows per sample."""
    (metrics.coalesce(1) if single_file else metrics).write.mode("overwrite").csv(path, header=True)


def long_metrics(wide: DataFrame) -> DataFrame:
    """One ``metric, value`` row per numeric column of a one-row frame."""
    numeric = [f.name for f in wide.schema.fields if isinstance(f.dataType, T.NumericType)]
    return wide.select(*[F.col(c).cast("double").alias(c) for c in numeric]).unpivot([], numeric, "metric", "value")


def round_trip(df: DataFrame, label: str, write, read) -> DataFrame:
    """Write to fresh scratch space and read back."""
    path = scratch_dir(df.sparkSession, label)
    write(df, path)
    return read(df.sparkSession, path)


def stored(df: DataFrame, label: str) -> DataFrame:
    """The frame written to shared scratch space as Parquet and read back.

    Cuts the lineage of a frame that several later steps read, so it is computed once and
    a lost executor costs no recomputation.
    """
    return round_trip(df, label, lambda d, p: d.write.parquet(p), lambda s, p: s.read.parquet(p))
