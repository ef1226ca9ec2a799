"""Run catalog (G family): primary metric, ranking, diagnosis and convergence checks over
run configs, evaluation artifacts, logs and step losses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tunedata.operators.ordering import global_positions

# Metric priority of the run comparison (loss is negated).
METRIC_PRIORITY = ["accuracy", "macro_f1", "f1", "score", "loss"]

# Diagnosis rules, messages and thresholds.
OOM_PATTERNS = ["out of memory", "cuda oom"]
INSTABILITY_PATTERNS = ["nan", "inf"]
HIGH_LOSS = 3.0
LOW_METRIC = 0.25
ISSUE_OOM = "Run likely failed due to GPU memory pressure."
ACTIONS_OOM = ["Halve batch size before changing other variables.",
               "Reduce max_seq_length if batch size is already minimal.",
               "Prefer 4-bit loading and gradient checkpointing on the next run."]
ISSUE_NAN = "Numerical instability detected in the training logs."
ACTIONS_NAN = ["Lower the learning rate before increasing steps.",
               "Inspect the dataset for malformed or extremely long records."]
ISSUE_LOSS = "Training loss is still high; the run may be undertrained or mismatched to the data."
ACTIONS_LOSS = ["Verify dataset formatting and consider more steps only after checking loss stability."]
ISSUE_METRIC = "Evaluation score is very low for a supposedly fine-tuned run."
ACTIONS_METRIC = ["Check chat template or prompt formatting alignment.",
                  "Confirm the evaluation matches the model's intended task."]
ISSUE_NONE = "No critical issue was inferred from the saved metrics."
ACTIONS_NONE = ["Use run comparison to decide whether to iterate or ship."]

# Defaults of the SFT trainer's hyperparameters.
TRAINER_DEFAULTS = {"learning_rate": 2e-4, "lora_r": 16, "lora_alpha": 16, "batch_size": 4, "max_steps": 200,
                    "gradient_accumulation_steps": 4, "max_seq_length": 2048, "lora_dropout": 0.0, "seed": 3407}

# Documented recovery order for "good loss, bad eval".
GOOD_LOSS_BAD_EVAL_STEPS = ["validate formatting and prompting", "inspect examples manually",
                            "compare against the base model"]

NEG_INF = float("-inf")


def eval_metric(evals: DataFrame) -> DataFrame:
    """Per evaluation file: the first numeric key in priority order (loss negated)."""
    present = [k for k in METRIC_PRIORITY if k in evals.columns]
    name = F.lit(None).cast("string")
    value = F.lit(None).cast("double")
    for k in reversed(present):
        v = F.col(k).cast("double")
        name = F.when(v.isNotNull(), F.lit(k)).otherwise(name)
        value = F.when(v.isNotNull(), -v if k == "loss" else v).otherwise(value)
    return evals.withColumn("metric_name", name).withColumn("metric_value", value)


def primary_metric(evals: DataFrame) -> DataFrame:
    """``run_dir, metric_name, primary_metric``: the first evaluation file by path that has a
    numeric metric decides (paths are unique, so ``min_by`` is deterministic)."""
    m = eval_metric(evals).where(F.col("metric_value").isNotNull())
    best = m.groupBy("run_dir").agg(F.min_by(F.struct("metric_name", "metric_value"), "path").alias("b"))
    return best.select("run_dir", F.col("b.metric_name").alias("metric_name"),
                       F.col("b.metric_value").alias("primary_metric"))


def summaries(configs: DataFrame, evals: DataFrame) -> DataFrame:
    """Every config left-joined to its evaluations and primary metric."""
    files = evals.groupBy("run_dir").agg(F.count(F.lit(1)).alias("n_evals"),
                                         F.array_join(F.array_sort(F.collect_list("path")), ",").alias("eval_paths"))
    return (configs.join(files, "run_dir", "left").join(primary_metric(evals), "run_dir", "left")
            .withColumn("n_evals", F.coalesce("n_evals", F.lit(0)).cast("bigint")))


def rank_order(metric: str = "primary_metric", loss: str = "train_loss") -> list[Column]:
    """Descending metric then descending -train_loss, ties by run_dir; missing -> -inf and NaN last."""
    m = F.coalesce(F.col(metric), F.lit(NEG_INF))
    l_ = F.coalesce(-F.col(loss), F.lit(NEG_INF))
    return [F.isnan(m).asc(), m.desc(), F.isnan(l_).asc(), l_.desc(), F.col("run_dir").asc()]


def rank_runs(s: DataFrame) -> DataFrame:
    keyed = s.withColumn("_m", F.coalesce(F.col("primary_metric"), F.lit(NEG_INF))) \
        .withColumn("_l", F.coalesce(-F.col("train_loss"), F.lit(NEG_INF))) \
        .withColumn("_mn", F.isnan("_m")).withColumn("_ln", F.isnan("_l"))
    order = [F.col("_mn").asc(), F.col("_m").desc(), F.col("_ln").asc(), F.col("_l").desc(),
             F.col("run_dir").asc()]
    return global_positions(keyed, order, "rank").drop("_m", "_l", "_mn", "_ln")


def seen(line: Column, patterns: list[str], match: str = "substring") -> Column:
    """Whether the lower-cased line has one of the patterns: anywhere (``substring``, as the reference has it, so that
    "info" counts as "inf"), or as a ``word`` of its own, not next to a letter or digit."""
    if match not in ("substring", "word"):
        raise ValueError(f"match is substring or word, not {match!r}")
    low = F.lower(line)
    if match == "word":
        return low.rlike("(?<![a-z0-9_])(" + "|".join(p.replace(".", "[.]") for p in patterns) + ")(?![a-z0-9_])")
    out = F.lit(False)
    for p in patterns:
        out = out | low.contains(p)
    return out


def log_flags(logs: DataFrame, line: str = "line", match: str = "substring") -> DataFrame:
    """Per run: OOM text seen, nan/inf seen."""
    oom, nan = seen(F.col(line), OOM_PATTERNS, match), seen(F.col(line), INSTABILITY_PATTERNS, match)
    return logs.groupBy("run_dir").agg(F.bool_or(oom).alias("has_oom"), F.bool_or(nan).alias("has_nan_inf"))


def _lits(xs: list[str]) -> list[Column]:
    return [F.lit(x) for x in xs]


def diagnosis(has_oom: Column, has_nan: Column, train_loss: Column, metric: Column) -> tuple[Column, Column]:
    """(issues, next_actions) arrays in rule order; NaN never passes a comparison."""
    high = train_loss.isNotNull() & ~F.isnan(train_loss) & (train_loss > HIGH_LOSS)
    low = metric.isNotNull() & ~F.isnan(metric) & (metric < LOW_METRIC)
    oom = F.coalesce(has_oom, F.lit(False))
    nan = F.coalesce(has_nan, F.lit(False))
    empty = F.array().cast("array<string>")
    issues = F.array_compact(F.array(F.when(oom, ISSUE_OOM), F.when(nan, ISSUE_NAN), F.when(high, ISSUE_LOSS),
                                     F.when(low, ISSUE_METRIC)))
    actions = F.concat(F.when(oom, F.array(*_lits(ACTIONS_OOM))).otherwise(empty),
                       F.when(nan, F.array(*_lits(ACTIONS_NAN))).otherwise(empty),
                       F.when(high, F.array(*_lits(ACTIONS_LOSS))).otherwise(empty),
                       F.when(low, F.array(*_lits(ACTIONS_METRIC))).otherwise(empty))
    none = F.size(issues) == 0
    return (F.when(none, F.array(F.lit(ISSUE_NONE))).otherwise(issues),
            F.when(none, F.array(*_lits(ACTIONS_NONE))).otherwise(actions))


def diagnose_runs(s: DataFrame, flags: DataFrame) -> DataFrame:
    j = s.join(flags, "run_dir", "left")
    issues, actions = diagnosis(F.col("has_oom"), F.col("has_nan_inf"), F.col("train_loss"),
                                F.col("primary_metric"))
    return j.withColumn("issues", issues).withColumn("next_actions", actions)


def previous_by(df: DataFrame, order: str, cols: list[str], prefix: str = "prev_") -> DataFrame:
    """Attach the previous row's ``cols`` in ``order`` by an equi-join on position - 1."""
    pos = global_positions(df, [F.col(order).asc()], "_pos")
    prev = pos.select((F.col("_pos") + 1).alias("_pos"), *[F.col(c).alias(prefix + c) for c in cols])
    return pos.join(prev, "_pos", "left")


def pick_run(summaries: DataFrame, which: str = "best") -> DataFrame:
    """One run: ``best`` by rank, ``latest`` by the number at the end of its name, or a run by name."""
    if which == "best":
        return summaries.orderBy(*rank_order()).limit(1)
    if which == "latest":
        number = F.regexp_extract("run_dir", "([0-9]+)$", 1).try_cast("bigint")
        return summaries.orderBy(number.desc_nulls_last(), F.col("run_dir").desc()).limit(1)
    return summaries.where(F.col("run_dir") == which)
