"""Structured Streaming jobs (S family).

Each function takes a *streaming* DataFrame and returns a streaming DataFrame (or starts a
query), so the same transformation runs over a file/Kafka source on a cluster. ``drain`` runs a
query with ``availableNow`` into a checkpointed sink that the caller names: restarts resume
from the checkpoint, and lost executors only redo their tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tunedata.operators import quality as q
from tunedata.operators import runs as rn


def file_stream(spark: SparkSession, path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """Parquet file source with the schema taken from the existing files. ``path`` is a folder of files, or names
    one file: the source then watches its directory, filtered to that file name."""
    schema = spark.read.parquet(path).schema
    r = spark.readStream.schema(schema)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    directory, _, name = path.rstrip("/").rpartition("/")
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if "*" not in name and store.getFileStatus(where).isFile():
        return r.option("pathGlobFilter", name).parquet(directory)
    return r.parquet(path)


def event_time(df: DataFrame, col: str = "ts") -> DataFrame:
    """Watermarks need ``timestamp``; the events table stores ``timestamp_ntz``."""
    return df.withColumn(col, F.col(col).cast("timestamp"))


# ---------------------------------------------------------------- S1
def running_eval(correct_rows: DataFrame, key: str) -> DataFrame:
    """Running accuracy per key over arriving per-item results (``correct`` boolean)."""
    return correct_rows.groupBy(key).agg(F.count(F.lit(1)).alias("total"),
                                         F.sum(F.col("correct").cast("bigint")).alias("correct"),
                                         F.round(F.avg(F.col("correct").cast("double")), 6).alias("accuracy"))


def running_loss(scored: DataFrame, key: str) -> DataFrame:
    """Running token-weighted loss per key over arriving items (``loss``, ``n_tokens``)."""
    total = F.sum("n_tokens")
    return scored.groupBy(key).agg(F.count(F.lit(1)).alias("total"), total.alias("n_tokens"),
                                   F.round(F.sum(F.col("loss") * F.col("n_tokens")) / F.greatest(total, F.lit(1)), 6).alias("avg_loss"))


# ---------------------------------------------------------------- S2
def log_alerts(lines: DataFrame, delay: str = "1 hour") -> DataFrame:
    """One alert per (run, issue) from the diagnosis text rules, deduplicated within the watermark."""
    low = F.lower("line")
    oom = F.lit(False)
    for p in rn.OOM_PATTERNS:
        oom = oom | low.contains(p)
    nan = F.lit(False)
    for p in rn.INSTABILITY_PATTERNS:
        nan = nan | low.contains(p)
    issue = F.when(oom, F.lit(rn.ISSUE_OOM)).when(nan, F.lit(rn.ISSUE_NAN))
    alerts = lines.withColumn("issue", issue).where(F.col("issue").isNotNull())
    return (alerts.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["run_dir", "issue"])
            .select("run_dir", "issue", "ts"))


# ---------------------------------------------------------------- S3
def loss_windows(steps: DataFrame, size: str = "1 day", slide: str | None = None,
                 delay: str = "1 hour") -> DataFrame:
    """Mean loss per run and event-time window; rows later than the watermark are dropped."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    return (steps.withWatermark("ts", delay).groupBy("run_dir", w.alias("w"))
            .agg(F.count(F.lit(1)).alias("n"), F.avg("loss").alias("mean_loss")))


# ---------------------------------------------------------------- S4
def run_sessions(steps: DataFrame, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """Activity sessions per run: a gap longer than ``gap`` means a stalled or resumed run."""
    return (steps.withWatermark("ts", delay).groupBy("run_dir", F.session_window("ts", gap).alias("s"))
            .agg(F.count(F.lit(1)).alias("n_events")))


# ---------------------------------------------------------------- S6
def gate_and_split(docs: DataFrame, fraction: float = 0.05) -> DataFrame:
    """Incremental quality gate + split of arriving documents (stateless, append-only)."""
    from tunedata.operators.splits import split_column

    n = q.token_count("text")
    rep, ctl, moj = q.encoding_flags("text")
    ok = n.between(q.MIN_TOKENS, q.MAX_SEQ_LENGTH) & ~(rep | ctl | moj)
    return docs.where(ok).select("doc_id", F.col("text"), split_column("doc_id", fraction).alias("split"))


# ---------------------------------------------------------------- running a stream to completion
def drain(df: DataFrame, out: str, checkpoint: str | None = None, output_mode: str = "append", fmt: str = "parquet") -> str:
    """Run ``df`` with ``availableNow`` into ``out`` and return it. The same ``out`` and ``checkpoint``
    (by default beside it) resume where the last call stopped.

    Append mode uses the file sink (exactly once). Other modes write each micro-batch to its own folder
    ``batch=<id>``, or over the whole result in complete mode: a batch that is replayed after a
    failure replaces itself. ``latest`` reads update-mode output."""
    w = df.writeStream.option("checkpointLocation", checkpoint or out + "-checkpoint").trigger(availableNow=True)
    if output_mode == "append":
        query = w.outputMode("append").format(fmt).option("path", out).start()
    else:
        def write_batch(batch: DataFrame, batch_id: int) -> None:
            path = out if output_mode == "complete" else f"{out}/batch={batch_id}"
            batch.write.mode("overwrite").format(fmt).save(path)

        query = w.outputMode(output_mode).foreachBatch(write_batch).start()
    query.awaitTermination()
    return out


def latest(spark: SparkSession, out: str, key: str) -> DataFrame:
    """Each key's row of the last micro-batch that updated it."""
    rows = spark.read.parquet(out)
    cols = [c for c in rows.columns if c not in (key, "batch")]
    return rows.groupBy(key).agg(F.max_by(F.struct(*cols), "batch").alias("r")).select(key, "r.*")
