"""A family: dataset readers, run-tree scans and sinks. Each query writes a table derived from
the provided data to the shared scratch folder, reads it back through the source under test,
and is compared with the table it wrote."""

from __future__ import annotations

from pyspark.sql import functions as F

from tunedata.operators import formatters as fm
from tunedata.operators import splits as sp
from tunedata.plans.registry import query
from tunedata.plans.views import Views, oracle
from tunedata.session import scratch_path
from tunedata.sources import runs as rs
from tunedata.sources import sinks
from tunedata.sources.datasets import read_dataset

_PAIRS_SQL = oracle("SELECT pair_id, instruction, output FROM sft_pairs", "sft_pairs")


def _pairs(spark, sf_dir):
    return Views(spark, sf_dir).sft_pairs.select("pair_id", "instruction", "output")


def _roundtrip(spark, sf_dir, suffix, write):
    path = scratch_path(spark, "pairs") + suffix
    write(_pairs(spark, sf_dir), path)
    df = read_dataset(spark, path)
    return df.select(F.col("pair_id").cast("bigint").alias("pair_id"), "instruction", "output")


@query("read_dataset_parquet", _PAIRS_SQL)
def read_dataset_parquet(spark, sf_dir):
    return _roundtrip(spark, sf_dir, ".parquet", lambda df, p: df.write.parquet(p))


@query("read_dataset_jsonl", _PAIRS_SQL)
def read_dataset_jsonl(spark, sf_dir):
    return _roundtrip(spark, sf_dir, ".jsonl", lambda df, p: df.write.json(p))


@query("read_dataset_json", _PAIRS_SQL)
def read_dataset_json(spark, sf_dir):
    return _roundtrip(spark, sf_dir, ".json", lambda df, p: df.write.json(p))


@query("read_dataset_csv", oracle("SELECT pair_id, nullif(instruction, '') AS instruction, nullif(output, '') AS output "
                                  "FROM sft_pairs", "sft_pairs"))
def read_dataset_csv(spark, sf_dir):
    """CSV has no distinct empty string: an empty field reads back as null (as pandas does)."""
    return _roundtrip(spark, sf_dir, ".csv",
                      lambda df, p: df.write.option("header", True).option("escape", '"').csv(p))


@query("read_dataset_txt", oracle("SELECT unnest(string_split(text, chr(10))) AS text FROM benchmark"))
def read_dataset_txt(spark, sf_dir):
    """One row per line of the written passages."""
    path = scratch_path(spark, "passages") + ".txt"
    Views(spark, sf_dir).benchmark.select("text").write.text(path)
    return read_dataset(spark, path)


@query("scan_run_configs", oracle(
    "SELECT run_dir, model, dataset, learning_rate, CAST(lora_r AS BIGINT) AS lora_r, "
    "CAST(lora_alpha AS BIGINT) AS lora_alpha, CAST(batch_size AS BIGINT) AS batch_size, train_loss "
    "FROM run_configs", "run_configs"))
def scan_run_configs(spark, sf_dir):
    root = scratch_path(spark, "results")
    c = Views(spark, sf_dir).run_configs.drop("run_no")
    sinks.write_run_records(c, root)
    s = rs.scan_run_configs(spark, root, pattern=f"{root}/*.json", whole_file=False)
    return s.select("run_dir", "model", "dataset", "learning_rate", "lora_r", "lora_alpha", "batch_size",
                    "train_loss")


@query("scan_eval_artifacts", oracle(
    "SELECT run_dir, benchmark, accuracy, loss FROM run_evals", "run_evals"))
def scan_eval_artifacts(spark, sf_dir):
    root = scratch_path(spark, "results")
    e = Views(spark, sf_dir).run_evals.drop("path")
    e.write.json(root)
    s = rs.scan_eval_artifacts(spark, root, pattern=f"{root}/*.json", whole_file=False)
    return s.select("run_dir", "benchmark", "accuracy", "loss")


@query("scan_run_tree", oracle(
    "SELECT run_dir, model, learning_rate, CAST(lora_r AS BIGINT) AS lora_r, train_loss FROM run_configs WHERE run_dir LIKE 'run_00000%'", "run_configs"))
def scan_run_tree(spark, sf_dir):
    """Configs of the runs that a pattern names, through the ``run_tree`` source."""
    root = scratch_path(spark, "tree")
    sinks.write_run_records(Views(spark, sf_dir).run_configs.drop("run_no"), root, by_run=True)
    s = rs.scan_run_configs(spark, root, found=rs.from_tree(spark, root, "part-*.json", runs="run_00000*"))
    return s.select("run_dir", "model", "learning_rate", "lora_r", "train_loss")


@query("scan_baselines", oracle(
    "SELECT category AS benchmark, round(avg(CASE WHEN list_position(choice_logits, list_max(choice_logits)) - 1 = answer "
    "THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM mc_predictions GROUP BY category", "mc_predictions"))
def scan_baselines(spark, sf_dir):
    """One JSON line per benchmark in a folder of part files, scanned like a baseline report."""
    from tunedata.operators.metrics import argmax_first

    m = Views(spark, sf_dir).mc_predictions
    rows = m.groupBy(F.col("category").alias("benchmark")).agg(
        F.round(F.avg((argmax_first("choice_logits") == F.col("answer")).cast("double")), 6).alias("accuracy"))
    root = scratch_path(spark, "project")
    rows.write.json(root)
    return rs.scan_baselines(spark, root, pattern=f"{root}/*.json", whole_file=False).select("benchmark", "accuracy")


@query("scan_run_logs", oracle("SELECT run_dir, line FROM run_logs", "run_logs"))
def scan_run_logs(spark, sf_dir):
    root = scratch_path(spark, "results")
    sinks.write_run_logs(Views(spark, sf_dir).run_logs.select("run_dir", "line"), root)
    s = rs.scan_run_logs(spark, root, files="*.txt")
    return s.select("run_dir", "line")


@query("parse_log_metrics", oracle(
    "SELECT run_dir, line_no, regexp_extract(line, '^\\s*(\\w+): (.*)$', 1) AS key, "
    "regexp_extract(line, '^\\s*(\\w+): (.*)$', 2) AS value, "
    "TRY_CAST(regexp_extract(line, '^\\s*(\\w+): (.*)$', 2) AS DOUBLE) AS num_value "
    "FROM run_logs WHERE regexp_matches(line, '^\\s*(\\w+): (.*)$')", "run_logs"))
def parse_log_metrics(spark, sf_dir):
    logs = Views(spark, sf_dir).run_logs.select("run_dir", "line_no", "line")
    return rs.parse_log_metrics(logs)


@query("parse_progress", oracle(
    "SELECT run_dir, line_no, CAST(regexp_extract(line, 'progress: (\\d+)/(\\d+), (accuracy|avg_loss): ([\\d.]+)', 1) "
    "AS BIGINT) AS done, CAST(regexp_extract(line, 'progress: (\\d+)/(\\d+), (accuracy|avg_loss): ([\\d.]+)', 2) "
    "AS BIGINT) AS total, regexp_extract(line, 'progress: (\\d+)/(\\d+), (accuracy|avg_loss): ([\\d.]+)', 3) "
    "AS metric, TRY_CAST(regexp_extract(line, 'progress: (\\d+)/(\\d+), (accuracy|avg_loss): ([\\d.]+)', 4) "
    "AS DOUBLE) AS metric_value FROM run_logs "
    "WHERE regexp_matches(line, 'progress: (\\d+)/(\\d+), (accuracy|avg_loss): ([\\d.]+)')", "run_logs"))
def parse_progress(spark, sf_dir):
    logs = Views(spark, sf_dir).run_logs.select("run_dir", "line_no", "line")
    return rs.parse_progress(logs)


@query("write_eval_results", oracle(
    "SELECT category AS benchmark, count(*) AS total, "
    "CAST(sum(CASE WHEN list_position(choice_logits, list_max(choice_logits)) - 1 = answer THEN 1 ELSE 0 END) "
    "AS BIGINT) AS correct FROM mc_predictions GROUP BY category", "mc_predictions"))
def write_eval_results(spark, sf_dir):
    from tunedata.operators.metrics import argmax_first

    m = Views(spark, sf_dir).mc_predictions
    res = m.groupBy(F.col("category").alias("benchmark")).agg(
        F.count(F.lit(1)).alias("total"),
        F.sum((argmax_first("choice_logits") == F.col("answer")).cast("bigint")).alias("correct"))
    path = scratch_path(spark, "evals")
    sinks.write_eval_results(res, path)
    back = spark.read.json(path)
    return back.select("benchmark", F.col("total").cast("bigint"), F.col("correct").cast("bigint"))


@query("write_prepared_dataset", oracle(
    "SELECT pair_id, '### Instruction:' || chr(10) || coalesce(instruction, '') || chr(10) || chr(10) || "
    "CASE WHEN input IS NOT NULL AND length(regexp_replace(input, '^\\s+|\\s+$', '', 'g')) > 0 "
    "THEN '### Input:' || chr(10) || input || chr(10) || chr(10) ELSE '' END || '### Response:' || chr(10) || "
    "coalesce(output, '') AS text, CASE WHEN (('0x' || substr(md5('3407:' || CAST(pair_id AS VARCHAR)), 1, 8))::BIGINT "
    "% 10000) < 500 THEN 'val' ELSE 'train' END AS split FROM sft_pairs", "sft_pairs"))
def write_prepared_dataset(spark, sf_dir):
    p = Views(spark, sf_dir).sft_pairs
    rows = sp.train_val_split(p.select("pair_id", fm.format_alpaca().alias("text")), "pair_id", fraction=0.05)
    path = scratch_path(spark, "prepared")
    sinks.write_prepared_dataset(rows, path, max_records_per_file=100000)
    return spark.read.parquet(path).select("pair_id", "text", "split")
