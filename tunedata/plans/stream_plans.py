"""S family: streaming jobs drained over file sources of the provided tables, compared with
their batch equivalents."""

from __future__ import annotations

from pyspark.sql import functions as F

from tunedata.operators.metrics import argmax_first
from tunedata.plans.registry import query
from tunedata.plans.views import FOUR_SCORES, PORTABLE, RUN_DIR_SQL, oracle
from tunedata.session import scratch_path
from tunedata.streaming import gate, jobs, plateau

def load_gate_oracle() -> str:
    """The batch gate's SQL: the stream has to come to the same verdicts, one file being one micro-batch."""
    from tunedata.plans import quality_plans  # noqa: F401
    from tunedata.plans.registry import REGISTRY

    return REGISTRY["quality_gate_rows"].oracle


D_TS = "strftime(%s, '%%Y-%%m-%%d %%H:%%M:%%S.%%f')"
S_TS = "yyyy-MM-dd HH:mm:ss.SSSSSS"


def _events(spark, sf_dir):
    return jobs.event_time(jobs.file_stream(spark, f"{sf_dir}/events.parquet"))


def _steps(spark, sf_dir):
    e = _events(spark, sf_dir)
    return e.select(F.expr(RUN_DIR_SQL).alias("run_dir"), "ts", F.col("value").alias("loss"), "event_id")


@query("stream_running_eval", oracle(
    "SELECT category, count(*) AS total, CAST(sum(CASE WHEN list_position(s, list_max(s)) - 1 = answer THEN 1 ELSE 0 END) "
    "AS BIGINT) AS correct, round(avg(CASE WHEN list_position(s, list_max(s)) - 1 = answer THEN 1.0 ELSE 0.0 END), 6) "
    "AS accuracy FROM (SELECT category, answer, choice_logits AS s FROM mc_predictions) t GROUP BY category", "mc_predictions"))
def stream_running_eval(spark, sf_dir):
    s = jobs.file_stream(spark, f"{sf_dir}/embeddings.parquet")
    rows = s.select(F.concat(F.lit("c"), F.col("label").cast("string")).alias("category"),
                    (argmax_first(F.expr(FOUR_SCORES)) == (F.col("label") % 4)).alias("correct"))
    out = jobs.drain(jobs.running_eval(rows, "category"), scratch_path(spark, "running-eval"), output_mode="update")
    return jobs.latest(spark, out, "category")


@query("stream_running_loss", oracle(
    "SELECT lang, count(*) AS total, sum(n_tokens)::BIGINT AS n_tokens, round(sum(loss * n_tokens) / greatest(sum(n_tokens), 1), 6) AS avg_loss "
    "FROM loss_items GROUP BY lang", "loss_items"))
def stream_running_loss(spark, sf_dir):
    """The average loss of each language as items arrive; only keys that a micro-batch touches are written."""
    items = spark.sql(PORTABLE["loss_items"][1], documents=jobs.file_stream(spark, f"{sf_dir}/documents.parquet"))
    out = jobs.drain(jobs.running_loss(items, "lang"), scratch_path(spark, "running-loss"), output_mode="update")
    return jobs.latest(spark, out, "lang")


@query("stream_log_alerts", oracle(
    "SELECT DISTINCT run_dir, CASE WHEN contains(lower(line), 'out of memory') OR contains(lower(line), 'cuda oom') "
    "THEN 'Run likely failed due to GPU memory pressure.' ELSE 'Numerical instability detected in the training logs.' "
    "END AS issue FROM run_logs WHERE contains(lower(line), 'out of memory') OR contains(lower(line), 'cuda oom') "
    "OR contains(lower(line), 'nan') OR contains(lower(line), 'inf')", "run_logs"))
def stream_log_alerts(spark, sf_dir):
    """The log view's projection applied to the event stream, then the alert rules."""
    lines = spark.sql(PORTABLE["run_logs"][1], events=_events(spark, sf_dir))
    out = jobs.drain(jobs.log_alerts(lines), scratch_path(spark, "log-alerts"), output_mode="append")
    return spark.read.parquet(out).select("run_dir", "issue")


@query("stream_loss_windows", oracle(
    f"SELECT {RUN_DIR_SQL} AS run_dir, {D_TS % 'time_bucket(INTERVAL 1 DAY, ts)'} AS window_start, count(*) AS n, "
    "round(avg(value), 6) AS mean_loss FROM events GROUP BY 1, time_bucket(INTERVAL 1 DAY, ts) "
    "HAVING time_bucket(INTERVAL 1 DAY, ts) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)"))
def stream_loss_windows(spark, sf_dir):
    """Append mode: a window comes out once the watermark has passed it; later rows are dropped."""
    out = jobs.drain(jobs.loss_windows(_steps(spark, sf_dir)), scratch_path(spark, "loss-windows"), output_mode="append")
    r = spark.read.parquet(out)
    return r.select("run_dir", F.date_format("w.start", S_TS).alias("window_start"), "n",
                    F.round("mean_loss", 6).alias("mean_loss"))


@query("stream_loss_sliding", oracle(
    f"SELECT {RUN_DIR_SQL} AS run_dir, {D_TS % 's'} AS window_start, count(*) AS n, round(avg(value), 6) AS mean_loss "
    "FROM (SELECT *, unnest([time_bucket(INTERVAL 12 HOUR, ts), time_bucket(INTERVAL 12 HOUR, ts) - INTERVAL 12 HOUR]) AS s FROM events) e "
    "GROUP BY 1, s HAVING s + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)"))
def stream_loss_sliding(spark, sf_dir):
    """Windows of a day that begin every twelve hours: each row counts in two."""
    out = jobs.drain(jobs.loss_windows(_steps(spark, sf_dir), "1 day", "12 hours"), scratch_path(spark, "loss-sliding"), output_mode="append")
    r = spark.read.parquet(out)
    return r.select("run_dir", F.date_format("w.start", S_TS).alias("window_start"), "n", F.round("mean_loss", 6).alias("mean_loss"))


@query("stream_run_sessions", oracle(
    f"SELECT run_dir, {D_TS % 'min(ts)'} AS session_start, {D_TS % '(max(ts) + INTERVAL 30 MINUTE)'} AS session_end, "
    "count(*) AS n_events FROM (SELECT run_dir, ts, sum(brk) OVER (PARTITION BY run_dir ORDER BY ts, event_id) AS sid "
    f"FROM (SELECT {RUN_DIR_SQL} AS run_dir, ts, event_id, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts, "
    "event_id) IS NULL OR ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) >= INTERVAL 30 MINUTE "
    "THEN 1 ELSE 0 END AS brk FROM events) a) b GROUP BY run_dir, sid "
    "HAVING max(ts) + INTERVAL 30 MINUTE <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)"))
def stream_run_sessions(spark, sf_dir):
    """Append mode: a session comes out, and leaves the state, once the watermark has passed its end."""
    out = jobs.drain(jobs.run_sessions(_steps(spark, sf_dir)), scratch_path(spark, "run-sessions"), output_mode="append")
    r = spark.read.parquet(out)
    return r.select("run_dir", F.date_format("s.start", S_TS).alias("session_start"),
                    F.date_format("s.end", S_TS).alias("session_end"), "n_events")


@query("stream_plateau_detector", oracle(
    "SELECT run_dir, min(loss) AS best_loss, count(*) - min(CASE WHEN loss = ml THEN rn END) AS steps_since_best, "
    "count(*) AS n_steps FROM (SELECT run_dir, loss, min(loss) OVER (PARTITION BY run_dir) AS ml, "
    "row_number() OVER (PARTITION BY run_dir ORDER BY step) AS rn FROM run_steps) t GROUP BY run_dir", "run_steps"))
def stream_plateau_detector(spark, sf_dir):
    steps = spark.sql(PORTABLE["run_steps"][1].replace("row_number() OVER (PARTITION BY user_id ORDER BY ts, "
                                                       "event_id) * 10", "event_id"),
                      events=_events(spark, sf_dir))
    with plateau.rocksdb_state(spark):
        out = jobs.drain(plateau.plateau_detector(steps), scratch_path(spark, "plateau"), output_mode="update")
    return jobs.latest(spark, out, "run_dir").drop("closed")


@query("stream_append_prepared", oracle(
    "SELECT doc_id, CASE WHEN (('0x' || substr(md5('3407:' || CAST(doc_id AS VARCHAR)), 1, 8))::BIGINT % 10000) "
    "< 500 THEN 'val' ELSE 'train' END AS split FROM (SELECT doc_id, text, CASE WHEN length(regexp_replace(text, "
    "'^[\\t\\n\\x{0B}\\f\\r\\x{1C}-\\x{1F} \\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}"
    "\\x{3000}]+|[\\t\\n\\x{0B}\\f\\r\\x{1C}-\\x{1F} \\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}"
    "\\x{202F}\\x{205F}\\x{3000}]+$', '', 'g')) = 0 THEN 0 ELSE len(regexp_split_to_array(regexp_replace(text, "
    "'^[\\t\\n\\x{0B}\\f\\r\\x{1C}-\\x{1F} \\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}"
    "\\x{3000}]+|[\\t\\n\\x{0B}\\f\\r\\x{1C}-\\x{1F} \\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}"
    "\\x{202F}\\x{205F}\\x{3000}]+$', '', 'g'), '[\\t\\n\\x{0B}\\f\\r\\x{1C}-\\x{1F} \\x{85}\\x{A0}\\x{1680}"
    "\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+')) END AS n FROM documents) d "
    "WHERE n BETWEEN 10 AND 2048 AND NOT contains(text, '�') "
    "AND NOT regexp_matches(text, '[\\x{00}-\\x{08}\\x{0B}\\x{0C}\\x{0E}-\\x{1F}]') "
    "AND NOT regexp_matches(text, 'Ã.|â€')"))
def stream_append_prepared(spark, sf_dir):
    docs = jobs.file_stream(spark, f"{sf_dir}/documents.parquet")
    out = jobs.drain(jobs.gate_and_split(docs), scratch_path(spark, "prepared-stream"), output_mode="append")
    return spark.read.parquet(out).select("doc_id", "split")


@query("stream_quality_gate", load_gate_oracle())
def stream_quality_gate(spark, sf_dir):
    """Kept and rejected rows of the documents as they arrive, by the rules of the batch gate."""
    docs = jobs.file_stream(spark, f"{sf_dir}/documents.parquet")
    out = gate.run_gate(docs, scratch_path(spark, "gated"))
    kept = spark.read.parquet(out + "/kept").select(F.col("id").alias("doc_id"), F.lit("kept").alias("reason"))
    return kept.unionByName(spark.read.parquet(out + "/rejected").select(F.col("id").alias("doc_id"), "reason"))
