"""G family: run catalog ranking, diagnosis, decisions and convergence over the run views."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tunedata.operators import runs as rn
from tunedata.operators.ordering import global_positions
from tunedata.plans.registry import query
from tunedata.plans.views import Views, oracle


def sq(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


# ---------------------------------------------------------------- shared DuckDB building blocks
D_PM = ("pm AS (SELECT run_dir, arg_min(name, path) AS metric_name, arg_min(val, path) AS primary_metric "
        "FROM (SELECT run_dir, path, CASE WHEN accuracy IS NOT NULL THEN 'accuracy' WHEN loss IS NOT NULL "
        "THEN 'loss' END AS name, CASE WHEN accuracy IS NOT NULL THEN accuracy WHEN loss IS NOT NULL THEN -loss "
        "END AS val FROM run_evals) e WHERE val IS NOT NULL GROUP BY run_dir)")
D_S = "s AS (SELECT c.*, pm.metric_name, pm.primary_metric FROM run_configs c LEFT JOIN pm USING (run_dir))"
D_M = "coalesce(primary_metric, '-inf'::DOUBLE)"
D_L = "coalesce(-train_loss, '-inf'::DOUBLE)"
D_ORDER = f"isnan({D_M}), {D_M} DESC, isnan({D_L}), {D_L} DESC, run_dir"
D_RANK = f"r AS (SELECT *, row_number() OVER (ORDER BY {D_ORDER}) AS rank FROM s)"
D_FLAGS = ("fl AS (SELECT run_dir, bool_or(contains(lower(line), 'out of memory') OR contains(lower(line), "
           "'cuda oom')) AS has_oom, bool_or(contains(lower(line), 'nan') OR contains(lower(line), 'inf')) "
           "AS has_nan_inf FROM run_logs GROUP BY run_dir)")


def d_diag(oom: str, nan: str, loss: str = "train_loss", metric: str = "primary_metric") -> tuple[str, str]:
    high = f"({loss} IS NOT NULL AND NOT isnan({loss}) AND {loss} > 3.0)"
    low = f"({metric} IS NOT NULL AND NOT isnan({metric}) AND {metric} < 0.25)"
    oom_c, nan_c = f"coalesce({oom}, false)", f"coalesce({nan}, false)"
    issues = (f"concat_ws(' | ', CASE WHEN {oom_c} THEN {sq(rn.ISSUE_OOM)} END, CASE WHEN {nan_c} THEN "
              f"{sq(rn.ISSUE_NAN)} END, CASE WHEN {high} THEN {sq(rn.ISSUE_LOSS)} END, CASE WHEN {low} THEN "
              f"{sq(rn.ISSUE_METRIC)} END)")
    actions = (f"concat_ws(' | ', CASE WHEN {oom_c} THEN {sq(' | '.join(rn.ACTIONS_OOM))} END, CASE WHEN {nan_c} "
               f"THEN {sq(' | '.join(rn.ACTIONS_NAN))} END, CASE WHEN {high} THEN {sq(' | '.join(rn.ACTIONS_LOSS))} "
               f"END, CASE WHEN {low} THEN {sq(' | '.join(rn.ACTIONS_METRIC))} END)")
    return (f"CASE WHEN {issues} = '' THEN {sq(rn.ISSUE_NONE)} ELSE {issues} END",
            f"CASE WHEN {actions} = '' THEN {sq(' | '.join(rn.ACTIONS_NONE))} ELSE {actions} END")


def ctes(*parts: str) -> str:
    return "WITH " + ", ".join(parts) + " "


VIEWS = ("run_configs", "run_evals", "run_logs")


# ---------------------------------------------------------------- Spark building blocks
def _summaries(spark, sf_dir):
    v = Views(spark, sf_dir)
    return rn.summaries(v.run_configs, v.run_evals)


def _ranked(spark, sf_dir):
    return rn.rank_runs(_summaries(spark, sf_dir))


def _diagnosed(spark, sf_dir, s=None, match="substring"):
    v = Views(spark, sf_dir)
    s = s if s is not None else _summaries(spark, sf_dir)
    return rn.diagnose_runs(s, rn.log_flags(v.run_logs, match=match))


def _joined(c):
    return F.array_join(c, " | ")


@query("load_run_summaries", oracle(
    ctes(D_PM, D_S) + "SELECT s.run_dir, CAST(coalesce(f.n, 0) AS BIGINT) AS n_evals, f.paths AS eval_paths, "
    "metric_name, round(primary_metric, 6) AS primary_metric FROM s LEFT JOIN (SELECT run_dir, count(*) AS n, "
    "string_agg(path, ',' ORDER BY path) AS paths FROM run_evals GROUP BY run_dir) f ON s.run_dir = f.run_dir",
    *VIEWS))
def load_run_summaries(spark, sf_dir):
    return _summaries(spark, sf_dir).select("run_dir", "n_evals", "eval_paths", "metric_name",
                                            F.round("primary_metric", 6).alias("primary_metric"))


@query("primary_metric", oracle(ctes(D_PM) + "SELECT run_dir, metric_name, round(primary_metric, 6) AS "
                                "primary_metric FROM pm", *VIEWS))
def primary_metric(spark, sf_dir):
    return rn.primary_metric(Views(spark, sf_dir).run_evals) \
        .withColumn("primary_metric", F.round("primary_metric", 6))


@query("rank_runs", oracle(ctes(D_PM, D_S, D_RANK) + "SELECT rank, run_dir, round(primary_metric, 6) AS "
                           "primary_metric, train_loss FROM r", *VIEWS))
def rank_runs(spark, sf_dir):
    return _ranked(spark, sf_dir).select("rank", "run_dir", F.round("primary_metric", 6).alias("primary_metric"),
                                         "train_loss")


@query("top_runs", oracle(ctes(D_PM, D_S, D_RANK) + "SELECT rank, run_dir, round(primary_metric, 6) AS "
                          "primary_metric FROM r WHERE rank <= 5", *VIEWS))
def top_runs(spark, sf_dir):
    """Top-k is the feature here: TakeOrderedAndProject keeps k rows per task, then k overall."""
    s = _summaries(spark, sf_dir)
    top = s.orderBy(*rn.rank_order()).limit(5)
    w = Window.orderBy(*rn.rank_order())  # over the 5 kept rows only
    return top.select(F.row_number().over(w).cast("bigint").alias("rank"), "run_dir",
                      F.round("primary_metric", 6).alias("primary_metric"))


@query("comparison_table", oracle(
    ctes(D_PM, D_S) + "SELECT run_dir, coalesce(model, '?') AS model, coalesce(dataset, '?') AS dataset, "
    "'huggingface' AS backend, coalesce(metric_name, 'none') AS metric_name, "
    "CASE WHEN primary_metric IS NULL THEN 'n/a' ELSE printf('%.4f', primary_metric) END AS metric_text, "
    "coalesce(CAST(train_loss AS VARCHAR), 'n/a') AS train_loss_text FROM s", *VIEWS))
def comparison_table(spark, sf_dir):
    s = _summaries(spark, sf_dir)
    backend = F.coalesce(*[F.col(c) for c in ("backend_resolved", "backend") if c in s.columns],
                         F.lit("huggingface"))
    return s.select("run_dir", F.coalesce("model", F.lit("?")).alias("model"),
                    F.coalesce("dataset", F.lit("?")).alias("dataset"), backend.alias("backend"),
                    F.coalesce("metric_name", F.lit("none")).alias("metric_name"),
                    F.when(F.col("primary_metric").isNull(), "n/a")
                    .otherwise(F.format_string("%.4f", "primary_metric")).alias("metric_text"),
                    F.coalesce(F.col("train_loss").cast("string"), F.lit("n/a")).alias("train_loss_text"))


_ISSUES, _ACTIONS = d_diag("fl.has_oom", "fl.has_nan_inf")


@query("diagnose_runs", oracle(
    ctes(D_PM, D_S, D_FLAGS) + f"SELECT s.run_dir, {_ISSUES} AS issues, {_ACTIONS} AS next_actions "
    "FROM s LEFT JOIN fl ON s.run_dir = fl.run_dir", *VIEWS))
def diagnose_runs(spark, sf_dir):
    d = _diagnosed(spark, sf_dir)
    return d.select("run_dir", _joined(F.col("issues")).alias("issues"),
                    _joined(F.col("next_actions")).alias("next_actions"))


_D_WORD_FLAGS = ("fl AS (SELECT run_dir, bool_or(regexp_matches(l, '(^|[^a-z0-9_])(out of memory|cuda oom)([^a-z0-9_]|$)')) AS has_oom, "
                 "bool_or(regexp_matches(l, '(^|[^a-z0-9_])(nan|inf)([^a-z0-9_]|$)')) AS has_nan_inf "
                 "FROM (SELECT run_dir, lower(line) AS l FROM run_logs) t GROUP BY run_dir)")


@query("diagnose_runs_word", oracle(
    ctes(D_PM, D_S, _D_WORD_FLAGS) + f"SELECT s.run_dir, {_ISSUES} AS issues, {_ACTIONS} AS next_actions "
    "FROM s LEFT JOIN fl ON s.run_dir = fl.run_dir", *VIEWS))
def diagnose_runs_word(spark, sf_dir):
    """The same diagnosis with whole words, so that "INFO starting" is no instability."""
    d = _diagnosed(spark, sf_dir, match="word")
    return d.select("run_dir", _joined(F.col("issues")).alias("issues"), _joined(F.col("next_actions")).alias("next_actions"))


@query("pick_diagnosis_target", oracle(
    ctes(D_PM, D_S, D_RANK, D_FLAGS) + f"SELECT r.run_dir, {_ISSUES} AS issues FROM r LEFT JOIN fl "
    "ON r.run_dir = fl.run_dir WHERE r.rank = 1", *VIEWS))
def pick_diagnosis_target(spark, sf_dir):
    s = _summaries(spark, sf_dir)
    d = _diagnosed(spark, sf_dir, rn.pick_run(s, "best"))
    return d.select("run_dir", _joined(F.col("issues")).alias("issues"))


@query("pick_diagnosis_latest", oracle(
    ctes(D_PM, D_S, D_FLAGS) + f"SELECT s.run_dir, {_ISSUES} AS issues FROM s LEFT JOIN fl ON s.run_dir = fl.run_dir "
    "ORDER BY TRY_CAST(regexp_extract(s.run_dir, '([0-9]+)$', 1) AS BIGINT) DESC NULLS LAST, s.run_dir DESC LIMIT 1", *VIEWS))
def pick_diagnosis_latest(spark, sf_dir):
    """The newest run instead of the best one; ``rn.pick_run`` also takes a run by name."""
    d = _diagnosed(spark, sf_dir, rn.pick_run(_summaries(spark, sf_dir), "latest"))
    return d.select("run_dir", _joined(F.col("issues")).alias("issues"))


_SHIP_ISSUES, _ = d_diag("false", "false")
SHIP_THRESHOLD = 0.3


@query("ship_decision", oracle(
    ctes(D_PM, D_S, D_RANK) + "SELECT run_dir, round(primary_metric, 6) AS primary_metric, "
    f"coalesce(primary_metric IS NOT NULL AND NOT isnan(primary_metric) AND primary_metric >= {SHIP_THRESHOLD}, false) "
    f"AS ready, {_SHIP_ISSUES} AS notes FROM r WHERE rank = 1", *VIEWS))
def ship_decision(spark, sf_dir):
    """Best run; ready iff its metric exists, is a number and reaches the threshold; notes are the
    diagnosis without log text."""
    best = _summaries(spark, sf_dir).orderBy(*rn.rank_order()).limit(1)
    m = F.col("primary_metric")
    issues, _a = rn.diagnosis(F.lit(False), F.lit(False), F.col("train_loss"), m)
    ready = F.coalesce(m.isNotNull() & ~F.isnan(m) & (m >= SHIP_THRESHOLD), F.lit(False))
    return best.select("run_dir", F.round(m, 6).alias("primary_metric"), ready.alias("ready"),
                       _joined(issues).alias("notes"))


@query("next_run_number", oracle(
    "SELECT printf('run_%03d', greatest(1, coalesce(max(TRY_CAST(regexp_extract(run_dir, '^run_(.*)$', 1) AS "
    "INTEGER)) + 1, 1))) AS next_run FROM run_configs", "run_configs"))
def next_run_number(spark, sf_dir):
    c = Views(spark, sf_dir).run_configs
    n = F.regexp_extract("run_dir", "^run_(.*)$", 1).try_cast("int")
    return c.agg(F.format_string("run_%03d", F.greatest(F.lit(1), F.coalesce(F.max(n) + 1, F.lit(1))))
                 .alias("next_run"))


@query("efficiency_rank", oracle(
    ctes(D_PM, D_S) + "SELECT run_dir, rank() OVER (ORDER BY train_time_seconds NULLS LAST) AS time_rank, "
    "round(primary_metric / (train_time_seconds / 3600.0), 6) AS metric_per_hour FROM s", *VIEWS))
def efficiency_rank(spark, sf_dir):
    """SQL ``rank()`` without a global window: global positions, then the first position of each
    distinct value (partial aggregate) joined back."""
    s = _summaries(spark, sf_dir).select("run_dir", "train_time_seconds", "primary_metric")
    pos = global_positions(s, [F.col("train_time_seconds").asc_nulls_last(), F.col("run_dir").asc()], "_pos")
    first = pos.groupBy(F.col("train_time_seconds").alias("_t")).agg(F.min("_pos").alias("time_rank"))
    return pos.join(first, F.col("train_time_seconds").eqNullSafe(F.col("_t"))).select(
        "run_dir", F.col("time_rank").cast("int").alias("time_rank"),
        F.round(F.col("primary_metric") / (F.col("train_time_seconds") / 3600.0), 6).alias("metric_per_hour"))


def _pct_rank(df, col):
    pos = global_positions(df, [F.col(col).asc(), F.col("run_dir").asc()], "_pos")
    first = pos.groupBy(col).agg(F.min("_pos").alias("_rk"))
    last = pos.agg(F.max("_pos")).scalar()  # the number of rows, as a scalar subquery
    return pos.join(first, col).select("run_dir", ((F.col("_rk") - 1) / F.greatest(last - 1, F.lit(1))).alias(f"{col}_pct"))


@query("overfit_signal", oracle(
    ctes(D_PM, D_S) + ", b AS (SELECT * FROM s WHERE train_loss IS NOT NULL AND primary_metric IS NOT NULL) "
    "SELECT run_dir, round(lp, 6) AS loss_pct, round(mp, 6) AS metric_pct, lp <= 0.25 AND mp <= 0.25 AS overfit "
    "FROM (SELECT run_dir, percent_rank() OVER (ORDER BY train_loss) AS lp, "
    "percent_rank() OVER (ORDER BY primary_metric) AS mp FROM b) t", *VIEWS))
def overfit_signal(spark, sf_dir):
    """Very low training loss together with a poor evaluation (bottom quartiles of both)."""
    s = _summaries(spark, sf_dir).where(F.col("train_loss").isNotNull() & F.col("primary_metric").isNotNull()) \
        .select("run_dir", "train_loss", "primary_metric")
    j = _pct_rank(s, "train_loss").join(_pct_rank(s, "primary_metric"), "run_dir")
    return j.select("run_dir", F.round("train_loss_pct", 6).alias("loss_pct"),
                    F.round("primary_metric_pct", 6).alias("metric_pct"),
                    ((F.col("train_loss_pct") <= 0.25) & (F.col("primary_metric_pct") <= 0.25)).alias("overfit"))


_DIFF_KEYS = ["model", "dataset", "learning_rate", "lora_r", "lora_alpha", "batch_size"]


def _config_diff(spark, sf_dir):
    c = Views(spark, sf_dir).run_configs
    p = rn.previous_by(c, "run_no", _DIFF_KEYS + ["run_dir"])
    changed = F.array_compact(F.array(*[
        F.when(F.col("prev_run_dir").isNotNull() & ~F.col(k).eqNullSafe(F.col("prev_" + k)), F.lit(k))
        for k in _DIFF_KEYS]))
    return p.withColumn("changed", changed)


_D_PREV = ("p AS (SELECT *, " + ", ".join(f"lag({k}) OVER (ORDER BY run_no) AS prev_{k}" for k in _DIFF_KEYS)
           + ", lag(run_dir) OVER (ORDER BY run_no) AS prev_run_dir FROM run_configs)")
_D_CHANGED = ("concat_ws(',', " + ", ".join(f"CASE WHEN prev_run_dir IS NOT NULL AND {k} IS DISTINCT FROM "
                                            f"prev_{k} THEN '{k}' END" for k in _DIFF_KEYS) + ")")
_D_NCHANGED = ("(" + " + ".join(f"CASE WHEN prev_run_dir IS NOT NULL AND {k} IS DISTINCT FROM prev_{k} THEN 1 "
                                f"ELSE 0 END" for k in _DIFF_KEYS) + ")")


@query("config_diff", oracle(
    ctes(_D_PREV) + f"SELECT run_dir, {_D_CHANGED} AS changed, CAST({_D_NCHANGED} AS BIGINT) AS n_changed, "
    f"{_D_NCHANGED} > 1 AS multi_change FROM p", "run_configs"))
def config_diff(spark, sf_dir):
    d = _config_diff(spark, sf_dir)
    return d.select("run_dir", F.array_join("changed", ",").alias("changed"),
                    F.size("changed").cast("bigint").alias("n_changed"), (F.size("changed") > 1).alias("multi_change"))


_DEF = [("learning_rate", 2e-4), ("lora_r", 16), ("lora_alpha", 16), ("batch_size", 4)]


@query("non_default_params", oracle(
    "SELECT run_dir, concat_ws(',', " + ", ".join(f"CASE WHEN {k} IS DISTINCT FROM {v} THEN '{k}' END" for k, v in _DEF)
    + ") AS non_default, CAST(" + " + ".join(f"CASE WHEN {k} IS DISTINCT FROM {v} THEN 1 ELSE 0 END" for k, v in _DEF)
    + " AS BIGINT) AS n_non_default FROM run_configs", "run_configs"))
def non_default_params(spark, sf_dir):
    c = Views(spark, sf_dir).run_configs
    diff = F.array_compact(F.array(*[F.when(~F.col(k).eqNullSafe(F.lit(rn.TRAINER_DEFAULTS[k])), F.lit(k))
                                     for k, _ in _DEF]))
    return c.select("run_dir", F.array_join(diff, ",").alias("non_default"),
                    F.size(diff).cast("bigint").alias("n_non_default"))


_D_MMLU = ("m AS (SELECT c.run_dir, c.run_no, e.accuracy FROM run_configs c JOIN run_evals e "
           "ON c.run_dir = e.run_dir AND e.benchmark = 'mmlu')")


@query("improvement_stall", oracle(
    ctes(_D_MMLU) + ", d AS (SELECT run_dir, accuracy - lag(accuracy) OVER (ORDER BY run_no) AS delta FROM m) "
    "SELECT run_dir, round(delta, 6) AS delta, coalesce(delta < 0.005 AND lag(delta) OVER (ORDER BY run_dir) "
    "< 0.005, false) AS stalled FROM d", "run_configs", "run_evals"))
def improvement_stall(spark, sf_dir):
    """Two consecutive improvements under 0.5 %: previous rows found by position joins."""
    v = Views(spark, sf_dir)
    m = v.run_configs.select("run_dir", "run_no").join(
        v.run_evals.where(F.col("benchmark") == "mmlu").select("run_dir", "accuracy"), "run_dir")
    p = rn.previous_by(m, "run_no", ["accuracy"])
    d = p.withColumn("delta", F.col("accuracy") - F.col("prev_accuracy"))
    prev = d.select((F.col("_pos") + 1).alias("_pos"), F.col("delta").alias("prev_delta"))
    j = d.join(prev, "_pos", "left")
    stalled = F.coalesce((F.col("delta") < 0.005) & (F.col("prev_delta") < 0.005), F.lit(False))
    return j.select("run_dir", F.round("delta", 6).alias("delta"), stalled.alias("stalled"))


def _segments(spark, sf_dir):
    """Mean loss of each fifth of a run's logged steps, in step order."""
    st = Views(spark, sf_dir).run_steps.select("run_dir", "step", "loss")
    cut = st.withColumn("segment", F.ntile(5).over(Window.partitionBy("run_dir").orderBy("step")))
    return cut.groupBy("run_dir", "segment").agg(F.avg("loss").alias("mean_loss"))


def _plateau(spark, sf_dir):
    g = _segments(spark, sf_dir).groupBy("run_dir").agg(
        F.max_by("mean_loss", "segment").alias("last_mean"),
        F.max(F.when(F.col("segment") == 4, F.col("mean_loss"))).alias("prev_mean"),
        F.min_by("mean_loss", "segment").alias("first_mean"))
    plateau = F.coalesce((F.col("prev_mean") - F.col("last_mean")) / F.abs(F.col("prev_mean")) < 0.01, F.lit(False))
    return g.withColumn("plateau", plateau)


_D_SEG = ("sg AS (SELECT run_dir, seg, avg(loss) AS mean_loss FROM (SELECT run_dir, loss, ntile(5) OVER "
          "(PARTITION BY run_dir ORDER BY step) AS seg FROM run_steps) t GROUP BY run_dir, seg), "
          "pl AS (SELECT run_dir, arg_max(mean_loss, seg) AS last_mean, max(CASE WHEN seg = 4 THEN mean_loss END) "
          "AS prev_mean, arg_min(mean_loss, seg) AS first_mean FROM sg GROUP BY run_dir)")


@query("loss_plateau", oracle(
    ctes(_D_SEG) + "SELECT run_dir, round(last_mean, 6) AS last_mean, round(prev_mean, 6) AS prev_mean, "
    "coalesce((prev_mean - last_mean) / abs(prev_mean) < 0.01, false) AS plateau FROM pl", "run_steps"))
def loss_plateau(spark, sf_dir):
    p = _plateau(spark, sf_dir)
    return p.select("run_dir", F.round("last_mean", 6).alias("last_mean"), F.round("prev_mean", 6).alias("prev_mean"),
                    "plateau")


def _oscillation(spark, sf_dir):
    """Sign changes of consecutive differences and spikes above 2x the mean of the previous five
    steps, by one window per run: a run's log is sorted once, whatever its logging interval or gaps."""
    by_step = Window.partitionBy("run_dir").orderBy("step")
    st = Views(spark, sf_dir).run_steps.select("run_dir", "step", "loss")
    d = (st.withColumn("diff", F.col("loss") - F.lag("loss").over(by_step))
         .withColumn("prev5_avg", F.avg("loss").over(by_step.rowsBetween(-5, -1)))
         .withColumn("prev_diff", F.lag("diff").over(by_step)))
    flip = (F.signum("diff") * F.signum("prev_diff") < 0)
    spike = F.col("loss") > 2 * F.col("prev5_avg")
    return d.groupBy("run_dir").agg(
        F.count(F.lit(1)).alias("n_steps"),
        F.sum(F.coalesce(flip, F.lit(False)).cast("bigint")).alias("sign_changes"),
        F.sum(F.coalesce(spike, F.lit(False)).cast("bigint")).alias("spikes"))


_D_OSC = ("os AS (SELECT run_dir, count(*) AS n_steps, CAST(sum(CASE WHEN sign(diff) * sign(pdiff) < 0 THEN 1 "
          "ELSE 0 END) AS BIGINT) AS sign_changes, CAST(sum(CASE WHEN loss > 2 * p5 THEN 1 ELSE 0 END) AS BIGINT) "
          "AS spikes FROM (SELECT run_dir, loss, diff, lag(diff) OVER (PARTITION BY run_dir ORDER BY step) AS pdiff, "
          "p5 FROM (SELECT run_dir, step, loss, loss - lag(loss) OVER (PARTITION BY run_dir ORDER BY step) AS diff, "
          "avg(loss) OVER (PARTITION BY run_dir ORDER BY step ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS p5 "
          "FROM run_steps) a) b GROUP BY run_dir)")
_D_OSC_FLAG = "(n_steps > 2 AND sign_changes / (n_steps - 2) > 0.5)"


@query("loss_oscillation", oracle(
    ctes(_D_OSC) + f"SELECT run_dir, sign_changes, spikes, {_D_OSC_FLAG} AS oscillating FROM os", "run_steps"))
def loss_oscillation(spark, sf_dir):
    o = _oscillation(spark, sf_dir)
    osc = (F.col("n_steps") > 2) & (F.col("sign_changes") / (F.col("n_steps") - 2) > 0.5)
    return o.select("run_dir", "sign_changes", "spikes", osc.alias("oscillating"))


@query("curve_class", oracle(
    ctes(_D_SEG, _D_OSC) + "SELECT pl.run_dir, CASE WHEN last_mean > first_mean * 1.5 THEN 'diverging' "
    f"WHEN {_D_OSC_FLAG} THEN 'oscillating' WHEN coalesce((prev_mean - last_mean) / abs(prev_mean) < 0.01, false) "
    "AND last_mean > 1.5 THEN 'underfit' ELSE 'good' END AS curve_class FROM pl JOIN os ON pl.run_dir = os.run_dir",
    "run_steps"))
def curve_class(spark, sf_dir):
    j = _plateau(spark, sf_dir).join(_oscillation(spark, sf_dir), "run_dir")
    osc = (F.col("n_steps") > 2) & (F.col("sign_changes") / (F.col("n_steps") - 2) > 0.5)
    cls = (F.when(F.col("last_mean") > F.col("first_mean") * 1.5, "diverging").when(osc, "oscillating")
           .when(F.col("plateau") & (F.col("last_mean") > 1.5), "underfit").otherwise("good"))
    return j.select("run_dir", cls.alias("curve_class"))


DEVICE_VRAM_GB = 24.0


@query("vram_pressure", oracle(
    "SELECT run_dir, max(TRY_CAST(regexp_extract(line, '^peak_vram_gb: (.*)$', 1) AS DOUBLE)) AS peak_vram_gb, "
    "max(TRY_CAST(regexp_extract(line, '^peak_vram_gb: (.*)$', 1) AS DOUBLE)) > 0.9 * 24.0 AS pressure "
    "FROM run_logs WHERE regexp_matches(line, '^peak_vram_gb: ') GROUP BY run_dir", "run_logs"))
def vram_pressure(spark, sf_dir):
    from tunedata.sources.runs import parse_log_metrics

    m = parse_log_metrics(Views(spark, sf_dir).run_logs).where(F.col("key") == "peak_vram_gb")
    g = m.groupBy("run_dir").agg(F.max("num_value").alias("peak_vram_gb"))
    return g.withColumn("pressure", F.col("peak_vram_gb") > 0.9 * DEVICE_VRAM_GB)


@query("good_loss_bad_eval", oracle(
    ctes(D_PM, D_S) + "SELECT run_dir, CAST(g.i AS INTEGER) AS step_no, g.action FROM s, (VALUES "
    + ", ".join(f"({i + 1}, {sq(a)})" for i, a in enumerate(rn.GOOD_LOSS_BAD_EVAL_STEPS))
    + ") AS g(i, action) WHERE train_loss < 1.0 AND primary_metric < 0.25 AND NOT isnan(primary_metric)", *VIEWS))
def good_loss_bad_eval(spark, sf_dir):
    s = _summaries(spark, sf_dir)
    bad = s.where((F.col("train_loss") < 1.0) & (F.col("primary_metric") < rn.LOW_METRIC)
                  & ~F.isnan("primary_metric"))
    steps = F.array(*[F.lit(a) for a in rn.GOOD_LOSS_BAD_EVAL_STEPS])
    return bad.select("run_dir", F.posexplode(steps).alias("i", "action")) \
        .select("run_dir", (F.col("i") + 1).cast("int").alias("step_no"), "action")


@query("release_checklist", oracle(
    ctes(D_PM, D_S, D_FLAGS) + ", bl AS (SELECT arg_min(accuracy, run_dir) AS b FROM run_evals WHERE benchmark = "
    "'mmlu'), mm AS (SELECT run_dir, accuracy FROM run_evals WHERE benchmark = 'mmlu'), "
    "ne AS (SELECT run_dir, count(*) AS n FROM run_evals GROUP BY run_dir) "
    "SELECT s.run_dir, coalesce(mm.accuracy > bl.b, false) AS beats_baseline, ne.n IS NOT NULL AS has_eval, "
    f"{_ISSUES} = {sq(rn.ISSUE_NONE)} AS no_failure, coalesce(mm.accuracy > bl.b, false) AND ne.n IS NOT NULL "
    f"AND {_ISSUES} = {sq(rn.ISSUE_NONE)} AS ready FROM s CROSS JOIN bl LEFT JOIN mm ON s.run_dir = mm.run_dir "
    "LEFT JOIN ne ON s.run_dir = ne.run_dir LEFT JOIN fl ON s.run_dir = fl.run_dir", *VIEWS))
def release_checklist(spark, sf_dir):
    v = Views(spark, sf_dir)
    d = _diagnosed(spark, sf_dir)
    mm = v.run_evals.where(F.col("benchmark") == "mmlu").select("run_dir", "accuracy")
    # The baseline is one number (the first run's evaluation): a scalar subquery.
    base = mm.agg(F.min_by("accuracy", "run_dir")).scalar()
    j = d.join(mm, "run_dir", "left")
    beats = F.coalesce(F.col("accuracy") > base, F.lit(False))
    has_eval = F.col("n_evals") > 0
    ok = F.array_join("issues", " | ") == rn.ISSUE_NONE
    return j.select("run_dir", beats.alias("beats_baseline"), has_eval.alias("has_eval"), ok.alias("no_failure"),
                    (beats & has_eval & ok).alias("ready"))


@query("run_trend", oracle(
    ctes(_D_PREV) + ", mm AS (SELECT run_dir, accuracy FROM run_evals WHERE benchmark = 'mmlu') "
    f"SELECT p.run_dir, {_D_CHANGED} AS changed, round(mm.accuracy, 6) AS metric, p.train_loss, "
    "round(mm.accuracy - lag(mm.accuracy) OVER (ORDER BY p.run_no), 6) AS metric_diff "
    "FROM p LEFT JOIN mm ON p.run_dir = mm.run_dir", "run_configs", "run_evals"))
def run_trend(spark, sf_dir):
    v = Views(spark, sf_dir)
    d = _config_diff(spark, sf_dir)
    mm = v.run_evals.where(F.col("benchmark") == "mmlu").select("run_dir", "accuracy")
    j = d.join(mm, "run_dir", "left")
    prev = j.select((F.col("_pos") + 1).alias("_pos"), F.col("accuracy").alias("_prev_acc"))
    k = j.join(prev, "_pos", "left")
    return k.select("run_dir", F.array_join("changed", ",").alias("changed"), F.round("accuracy", 6).alias("metric"),
                    "train_loss", F.round(F.col("accuracy") - F.col("_prev_acc"), 6).alias("metric_diff"))
