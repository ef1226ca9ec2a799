"""Run trees of many runs: written by many tasks, one file a run, and read back whole."""

import json
from pathlib import Path

from pyspark.sql import functions as F

from tunedata.sources import runs as rs
from tunedata.sources import sinks


def test_logs_have_a_file_per_run(spark, tmp_path):
    """Each of 16 tasks holds lines of each of 40 runs."""
    logs = (spark.range(0, 4000, 1, 16).select(F.concat(F.lit("run_"), F.lpad((F.col("id") % 40).cast("string"), 6, "0")).alias("run_dir"),
                                               F.concat(F.lit("é: "), F.col("id").cast("string")).alias("line")))
    root = str(tmp_path / "tree")
    sinks.write_run_logs(logs, root)
    files = list(Path(root).glob("run_dir=run_*/*.txt"))
    assert len(files) == 40 and len({f.name for f in files}) > 1
    # A file of a folder inside a run is no log of it.
    (files[0].parent / "run_old").mkdir()
    (files[0].parent / "run_old" / "x.txt").write_text("not a line\n")
    got = rs.scan_run_logs(spark, root, files="*.txt")
    assert sorted((r["run_dir"], r["line"]) for r in got.collect()) == sorted((r["run_dir"], r["line"]) for r in logs.collect())


def test_long_runs_are_dealt(spark, tmp_path):
    logs = spark.range(0, 1000, 1, 4).select(F.when(F.col("id") < 900, "run_1").otherwise("run_2").alias("run_dir"), F.col("id").cast("string").alias("line"))
    root = str(tmp_path / "tree")
    sinks.write_run_logs(logs, root, run_lines=100)
    assert len(list(Path(root).glob("run_dir=run_1/*"))) > 1 and len(list(Path(root).glob("run_dir=run_2/*"))) == 1
    assert sorted(int(r["line"]) for r in rs.scan_run_logs(spark, root, files="*.txt").collect()) == list(range(1000))


def test_records_by_run_from_many_tasks(spark, tmp_path):
    """A grouped table is small in bytes and comes as one partition; its folders are still shared out."""
    configs = spark.range(300).groupBy(F.concat(F.lit("run_"), F.col("id").cast("string")).alias("run_dir")).agg(
        F.max("id").alias("max_steps"), F.max(F.when(F.col("id") > 5, "m")).alias("model"))
    root = str(tmp_path / "tree")
    sinks.write_run_records(configs, root, by_run=True)
    files = list(Path(root).glob("run_dir=run_*/*.json"))
    assert len(files) == 300 and len({f.name for f in files}) > 1
    assert json.loads(next(f for f in files if f.parent.name == "run_dir=run_3").read_text()) == {"max_steps": 3}
    got = rs.scan_run_configs(spark, root, found=rs.from_tree(spark, root, "part-*.json", runs="run_29*"))
    assert {(r["run_dir"], r["max_steps"]) for r in got.collect()} == {(f"run_{i}", i) for i in [29, *range(290, 300)]}
