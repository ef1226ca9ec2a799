"""Run-tree sources (A2-A6): run configs, evaluation artifacts, baselines and logs.

A results tree looks like ``<root>/run_001/run_config.json``, ``<root>/run_001/eval_mmlu.json``,
``<root>/run_001/stdout.log``. Each scan is one Spark file read over a glob; the run directory is
recovered from the file path (``_metadata.file_path``), and JSON is parsed with a typed schema.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Typed view of the keys the trainers write (actual and documented names).
RUN_CONFIG_SCHEMA = T.StructType([
    T.StructField("model", T.StringType()), T.StructField("model_name", T.StringType()),
    T.StructField("dataset", T.StringType()), T.StructField("dataset_name", T.StringType()),
    T.StructField("backend", T.StringType()), T.StructField("backend_resolved", T.StringType()),
    T.StructField("trainer", T.StringType()), T.StructField("max_steps", T.LongType()),
    T.StructField("batch_size", T.LongType()), T.StructField("gradient_accumulation_steps", T.LongType()),
    T.StructField("learning_rate", T.DoubleType()), T.StructField("max_seq_length", T.LongType()),
    T.StructField("lora_r", T.LongType()), T.StructField("lora_alpha", T.LongType()),
    T.StructField("train_loss", T.DoubleType()), T.StructField("train_time_seconds", T.DoubleType()),
    T.StructField("training_time", T.DoubleType()),
])
EVAL_KEYS = ["accuracy", "macro_f1", "f1", "score", "loss", "perplexity"]
EVAL_SCHEMA = T.StructType([T.StructField("benchmark", T.StringType())]
                           + [T.StructField(k, T.DoubleType()) for k in EVAL_KEYS]
                           + [T.StructField("correct", T.LongType()), T.StructField("total", T.LongType())])
_BOOL_SCHEMA = T.StructType([T.StructField(k, T.BooleanType()) for k in EVAL_KEYS])

# The run name is the directory holding the file: ``run_001`` (or ``run_dir=run_001`` when the
# tree was written by a partitioned Spark writer).
RUN_DIR_RE = r"(?:^|/)(?:run_dir=)?(run_[^/]+)/[^/]+$"


def _read_whole(spark: SparkSession, pattern: str, whole_file: bool = True) -> DataFrame:
    """``path, raw``: one row per file (pretty-printed JSON documents) or per line (JSON lines)."""
    df = spark.read.text(pattern, wholetext=whole_file)
    return df.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("raw"))


def _strip_scheme(c):
    return F.regexp_replace(c, "^file:(//)?", "")


def _exists(spark: SparkSession, pattern: str) -> bool:
    jvm = spark.sparkContext._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(pattern)
    fs = hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = fs.globStatus(hadoop_path)
    return found is not None and len(found) > 0


def _run_dir(path: Column, raw: Column) -> Column:
    """The run of a file: its folder's name, or the record's own field where many runs share a file."""
    return F.coalesce(F.nullif(F.regexp_extract(path, RUN_DIR_RE, 1), F.lit("")), F.get_json_object(raw, "$.run_dir"))


def from_tree(spark: SparkSession, root: str, files: str, runs: str = "*") -> DataFrame:
    """``run_dir, path, raw`` of a run tree's files through the ``run_tree`` source, for ``found`` of the scans
    below. ``runs``, patterns of run names, narrow the listing."""
    from tunedata.sources.run_tree import read_tree

    return read_tree(spark, root, files, runs=runs).select("run_dir", "path", F.col("value").alias("raw"))


def scan_run_configs(spark: SparkSession, root: str, mode: str = "PERMISSIVE", pattern: str | None = None,
                     whole_file: bool = True, found: DataFrame | None = None) -> DataFrame:
    """``run_dir, <typed config columns>, raw``; runs without ``run_config.json`` do not appear;
    a missing root gives an empty table. ``mode='FAILFAST'`` raises on malformed JSON. ``found`` are files
    read otherwise, as ``path, raw`` and possibly ``run_dir``."""
    pattern = pattern or f"{root.rstrip('/')}/run_*/run_config.json"
    cols = ["run_dir"] + RUN_CONFIG_SCHEMA.fieldNames() + ["raw", "_corrupt"]
    if found is None and not _exists(spark, pattern):
        return spark.createDataFrame([], T.StructType([T.StructField("run_dir", T.StringType())]
                                                      + list(RUN_CONFIG_SCHEMA.fields)
                                                      + [T.StructField("raw", T.StringType()),
                                                         T.StructField("_corrupt", T.BooleanType())]))
    files = _read_whole(spark, pattern, whole_file) if found is None else found
    run = F.col("run_dir") if "run_dir" in files.columns else _run_dir(F.col("path"), F.col("raw"))
    parsed = files.withColumn("c", F.from_json("raw", RUN_CONFIG_SCHEMA, {"mode": mode,
                                                                          "allowNonNumericNumbers": "true"}))
    valid = F.col("raw").rlike(r"^\s*\{[\s\S]*\}\s*$") & F.json_object_keys("raw").isNotNull()
    out = parsed.select(run.alias("run_dir"), "c.*", "raw",
                        (~F.coalesce(valid, F.lit(False))).alias("_corrupt"))
    return out.select(*cols) \
        .withColumn("model", F.coalesce("model", "model_name")) \
        .withColumn("dataset", F.coalesce("dataset", "dataset_name")) \
        .withColumn("train_time_seconds", F.coalesce("train_time_seconds", "training_time"))


def scan_eval_artifacts(spark: SparkSession, root: str, pattern: str | None = None,
                        whole_file: bool = True, found: DataFrame | None = None) -> DataFrame:
    """``run_dir, path, file_name, benchmark, <metrics>, raw`` for ``run_*/eval_*.json``.

    Booleans count as numbers for metrics (``true`` -> 1.0) and numeric strings do not."""
    pattern = pattern or f"{root.rstrip('/')}/run_*/eval_*.json"
    if found is None and not _exists(spark, pattern):
        return spark.createDataFrame([], "run_dir string, path string, file_name string, benchmark string, "
                                     + ", ".join(f"{k} double" for k in EVAL_KEYS)
                                     + ", correct bigint, total bigint, raw string")
    files = _read_whole(spark, pattern, whole_file) if found is None else found
    run = F.col("run_dir") if "run_dir" in files.columns else _run_dir(F.col("path"), F.col("raw"))
    opts = {"allowNonNumericNumbers": "true"}
    p = files.withColumn("e", F.from_json("raw", EVAL_SCHEMA, opts)) \
        .withColumn("b", F.from_json("raw", _BOOL_SCHEMA, opts))
    metrics = []
    for k in EVAL_KEYS:
        is_str = F.get_json_object("raw", f"$.{k}").isNotNull() & F.col("raw").rlike(f'"{k}"\\s*:\\s*"')
        num = F.when(is_str, F.lit(None)).otherwise(
            F.coalesce(F.col(f"e.{k}"), F.col(f"b.{k}").cast("double")))
        metrics.append(num.alias(k))
    clean = _strip_scheme(F.col("path"))
    return p.select(run.alias("run_dir"), clean.alias("path"),
                    F.element_at(F.split(clean, "/"), -1).alias("file_name"),
                    F.coalesce(F.col("e.benchmark"), F.regexp_extract(clean, r"eval_([^/]+)\.json$", 1))
                    .alias("benchmark"), *metrics, F.col("e.correct").alias("correct"),
                    F.col("e.total").alias("total"), "raw")


def scan_baselines(spark: SparkSession, project: str, pattern: str | None = None, whole_file: bool = True) -> DataFrame:
    """``benchmark, <metrics>`` from ``reports/baseline_{benchmark}.json``."""
    pattern = pattern or f"{project.rstrip('/')}/reports/baseline_*.json"
    if not _exists(spark, pattern):
        return spark.createDataFrame([], "benchmark string, " + ", ".join(f"{k} double" for k in EVAL_KEYS))
    files = _read_whole(spark, pattern, whole_file)
    e = files.withColumn("e", F.from_json("raw", EVAL_SCHEMA, {"allowNonNumericNumbers": "true"}))
    return e.select(F.coalesce(F.col("e.benchmark"), F.regexp_extract("path", r"baseline_([^/]+)\.json$", 1))
                    .alias("benchmark"), *[F.col(f"e.{k}").alias(k) for k in EVAL_KEYS])


def scan_run_logs(spark: SparkSession, root: str, files: str = "{stdout,stderr}.log") -> DataFrame:
    """``run_dir, file, line_no, line``: one row per line (never one string per run, so a huge log
    spreads over many tasks). ``line_no`` orders a run's lines, stdout before stderr: the file's rank
    above the byte offset at which the line's split begins and the line's place in it.

    ``files`` is a pattern of names. The driver lists ``root`` once, for the run folders; those are listed by a Spark job."""
    folders = f"{root.rstrip('/')}/{{run_*,run_dir=run_*}}"
    if not _exists(spark, folders):
        return spark.createDataFrame([], "run_dir string, file string, line_no bigint, line string")
    lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", files).text(folders)
    path = _strip_scheme(F.col("_metadata.file_path"))
    # Files of folders inside a run are listed too, but are no logs of it.
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    depth = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(folder).depth() + 2
    own = F.size(F.split(F.regexp_replace(path, "^[A-Za-z][A-Za-z0-9+.-]*://[^/]*", ""), "/")) == depth + 1
    return lines.where(own).select(F.regexp_extract(path, RUN_DIR_RE, 1).alias("run_dir"),
                        F.element_at(F.split(path, "/"), -1).alias("file"),
                        (F.when(F.col("_metadata.file_name").startswith("stderr"), 1 << 62).otherwise(0)
                         + F.col("_metadata.file_block_start") * 4096
                         + F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))).alias("line_no"),
                        F.col("value").alias("line"))


# The `key: value` and progress line formats the scripts print.
KEY_VALUE_RE = r"^\s*(\w+): (.*)$"
PROGRESS_RE = r"progress: (\d+)/(\d+), (accuracy|avg_loss): ([\d.]+)"


def parse_log_metrics(logs: DataFrame, line: str = "line") -> DataFrame:
    """``key: value`` lines -> ``run_dir, key, value, num_value`` (non-numeric -> null)."""
    k = F.regexp_extract(line, KEY_VALUE_RE, 1)
    v = F.regexp_extract(line, KEY_VALUE_RE, 2)
    keep = [c for c in logs.columns if c != line]
    return logs.where(F.col(line).rlike(KEY_VALUE_RE)).select(
        *keep, k.alias("key"), v.alias("value"), v.try_cast("double").alias("num_value"))


def parse_progress(logs: DataFrame, line: str = "line") -> DataFrame:
    """Progress lines -> ``done, total, metric, metric_value``."""
    keep = [c for c in logs.columns if c != line]
    return logs.where(F.col(line).rlike(PROGRESS_RE)).select(
        *keep, F.regexp_extract(line, PROGRESS_RE, 1).cast("bigint").alias("done"),
        F.regexp_extract(line, PROGRESS_RE, 2).cast("bigint").alias("total"),
        F.regexp_extract(line, PROGRESS_RE, 3).alias("metric"),
        F.regexp_extract(line, PROGRESS_RE, 4).try_cast("double").alias("metric_value"))
