"""Sinks (A7-A9): evaluation results, prepared datasets and run records as partitioned tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tunedata.sources.run_tree import write_tree


def write_eval_results(df: DataFrame, path: str, fmt: str = "json", partition_by: str | None = "benchmark",
                       mode: str = "overwrite") -> None:
    """Evaluation rows; partitioned by benchmark so readers prune to the benchmarks they need."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(partition_by)
    w.format(fmt).save(path)


def write_prepared_dataset(df: DataFrame, path: str, partition_by: str | None = "split",
                           max_records_per_file: int | None = None, fmt: str = "parquet",
                           mode: str = "overwrite") -> None:
    """Formatted training rows, one directory per split; bounded file sizes on request."""
    w = df.write.mode(mode)
    if max_records_per_file:
        w = w.option("maxRecordsPerFile", max_records_per_file)
    if partition_by:
        w = w.partitionBy(partition_by)
    w.format(fmt).save(path)


#: Lines of a run that are dealt to one task; a run with more has as many files as it needs.
RUN_LINES = 4_000_000


def _tasks(df: DataFrame) -> int:
    """Tasks that write a tree. Its cost is its number of files, so that tasks are not merged by their bytes."""
    spark = df.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def write_run_records(df: DataFrame, path: str, mode: str = "append", by_run: bool = False) -> None:
    """Run configs appended as JSON lines with their ``run_dir``: as many files as the data has partitions, however
    many runs. ``by_run`` writes a folder per run (``run_dir=<name>/``) for tools that expect a tree."""
    if not by_run:
        df.write.mode(mode).json(path)
        return
    value = F.to_json(F.struct(*[c for c in df.columns if c != "run_dir"]))
    dealt = df.select("run_dir", value.alias("value")).repartition(_tasks(df), "run_dir").sortWithinPartitions("run_dir")
    write_tree(dealt, path, ".json", mode)


def write_run_logs(df: DataFrame, path: str, mode: str = "append", run_lines: int = RUN_LINES) -> None:
    """Log lines (``run_dir, line``) as a tree, a folder per run. The lines of a run are dealt to one task, so that a run
    has one file and not one of every task; a run of more than ``run_lines`` lines is dealt to several."""
    counts = df.groupBy(F.col("run_dir").alias("_run")).agg(F.count(F.lit(1)).alias("_lines"))
    long = counts.where(F.col("_lines") > run_lines).select("_run", F.ceil(F.col("_lines") / run_lines).alias("_parts"))
    part = F.pmod(F.xxhash64("_row"), F.coalesce("_parts", F.lit(1)))
    dealt = (df.withColumn("_row", F.monotonically_increasing_id()).join(long, F.col("run_dir").eqNullSafe(F.col("_run")), "left")
             .withColumn("_part", part).repartition(_tasks(df), "run_dir", "_part").sortWithinPartitions("run_dir"))
    write_tree(dealt.select("run_dir", F.col("line").alias("value")), path, ".txt", mode)
