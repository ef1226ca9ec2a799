"""F family: evaluation metrics over predictions, per-item losses and run evaluations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tunedata.functions.strings import PY_WHITESPACE_CLASS
from tunedata.operators import bootstrap as bs
from tunedata.operators import metrics as mt
from tunedata.plans.registry import query
from tunedata.plans.views import Views, oracle

WS = PY_WHITESPACE_CLASS
D_PRED = "(list_position(choice_logits, list_max(choice_logits)) - 1)"
D_NONBLANK = f"length(regexp_replace(text, '^{WS}+|{WS}+$', '', 'g')) > 0"


def _preds(spark, sf_dir):
    m = Views(spark, sf_dir).mc_predictions
    return m.withColumn("pred", mt.argmax_first("choice_logits")) \
        .withColumn("correct", F.col("pred") == F.col("answer"))


@query("mcq_predict", oracle(f"SELECT item_id, CAST({D_PRED} AS INTEGER) AS pred, {D_PRED} = answer AS correct "
                             "FROM mc_predictions", "mc_predictions"))
def mcq_predict(spark, sf_dir):
    return _preds(spark, sf_dir).select("item_id", "pred", "correct")


_D_ACC = (f"CAST(sum(CASE WHEN {D_PRED} = answer THEN 1 ELSE 0 END) AS BIGINT) AS correct, count(*) AS total, "
          f"round(coalesce(sum(CASE WHEN {D_PRED} = answer THEN 1 ELSE 0 END) / count(*), 0.0), 6) AS accuracy")


@query("mcq_accuracy", oracle(f"SELECT {_D_ACC} FROM mc_predictions", "mc_predictions"))
def mcq_accuracy(spark, sf_dir):
    return _preds(spark, sf_dir).agg(*mt.accuracy_aggs(F.col("correct")))


def _group(category):
    n = F.substring(category, 2, 10).cast("int")
    return (F.when(n <= 2, "stem").when(n <= 5, "humanities").when(n <= 7, "social_sciences")
            .otherwise("other"))


_D_GROUP = ("CASE WHEN CAST(substr(category, 2) AS INTEGER) <= 2 THEN 'stem' WHEN CAST(substr(category, 2) AS "
            "INTEGER) <= 5 THEN 'humanities' WHEN CAST(substr(category, 2) AS INTEGER) <= 7 THEN 'social_sciences' "
            "ELSE 'other' END")


@query("accuracy_by_category", oracle(
    f"SELECT {_D_GROUP} AS subject_group, category, {_D_ACC} FROM mc_predictions GROUP BY ROLLUP ({_D_GROUP}, category)",
    "mc_predictions"))
def accuracy_by_category(spark, sf_dir):
    p = _preds(spark, sf_dir).withColumn("subject_group", _group(F.col("category")))
    return p.rollup("subject_group", "category").agg(*mt.accuracy_aggs(F.col("correct")))


@query("running_accuracy", oracle(
    "SELECT pos, round(c / pos, 6) AS value FROM (SELECT row_number() OVER (ORDER BY item_id) AS pos, "
    f"sum(CASE WHEN {D_PRED} = answer THEN 1 ELSE 0 END) OVER (ORDER BY item_id) AS c FROM mc_predictions) t "
    "WHERE pos % 100 = 0", "mc_predictions"))
def running_accuracy(spark, sf_dir):
    p = _preds(spark, sf_dir).select("item_id", "correct")
    return mt.running_metric(p, "item_id", mt.ACCURACY_EVERY, {"c": F.col("correct").cast("bigint")},
                             F.col("c") / F.col("pos"))


_D_LOSS = ("round(coalesce(sum(loss * n_tokens), 0) / greatest(coalesce(sum(n_tokens), 0), 1), 6)")


@query("corpus_loss", oracle(
    f"SELECT {_D_LOSS} AS loss, round(exp(least(coalesce(sum(loss * n_tokens), 0) / "
    f"greatest(coalesce(sum(n_tokens), 0), 1), 100)), 6) AS perplexity, count(*) AS total "
    f"FROM loss_items WHERE {D_NONBLANK}", "loss_items"))
def corpus_loss(spark, sf_dir):
    return mt.finish_loss(mt.token_weighted_loss(Views(spark, sf_dir).loss_items, "text", "loss", "n_tokens"))


@query("perplexity", oracle(
    "SELECT round(exp(least(coalesce(sum(loss * n_tokens), 0) / greatest(coalesce(sum(n_tokens), 0), 1), 100)), 6) "
    f"AS perplexity FROM loss_items WHERE {D_NONBLANK}", "loss_items"))
def perplexity(spark, sf_dir):
    return corpus_loss(spark, sf_dir).select("perplexity")


@query("running_loss", oracle(
    "SELECT pos, round(ln / greatest(n, 1), 6) AS value FROM (SELECT row_number() OVER (ORDER BY item_id) AS pos, "
    "sum(loss * n_tokens) OVER (ORDER BY item_id) AS ln, sum(n_tokens) OVER (ORDER BY item_id) AS n "
    f"FROM loss_items WHERE {D_NONBLANK}) t WHERE pos % 50 = 0", "loss_items"))
def running_loss(spark, sf_dir):
    li = Views(spark, sf_dir).loss_items
    from tunedata.functions.strings import is_blank

    scored = li.where(~is_blank("text")).select("item_id", "loss", "n_tokens")
    return mt.running_metric(scored, "item_id", mt.LOSS_EVERY,
                             {"ln": F.col("loss") * F.col("n_tokens"), "n": F.col("n_tokens")},
                             F.col("ln") / F.greatest(F.col("n"), F.lit(1)))


@query("loss_by_slice", oracle(
    f"SELECT lang, source, {_D_LOSS} AS loss, round(exp(least(coalesce(sum(loss * n_tokens), 0) / "
    f"greatest(coalesce(sum(n_tokens), 0), 1), 100)), 6) AS perplexity, count(*) AS total "
    f"FROM loss_items WHERE {D_NONBLANK} GROUP BY GROUPING SETS ((lang), (source), ())", "loss_items"))
def loss_by_slice(spark, sf_dir):
    from tunedata.functions.strings import is_blank

    li = Views(spark, sf_dir).loss_items.where(~is_blank("text"))
    g = li.groupingSets([["lang"], ["source"], []], "lang", "source").agg(
        F.sum(F.col("loss") * F.col("n_tokens")).alias("_ln"), F.sum("n_tokens").alias("_n"),
        F.count(F.lit(1)).alias("total"))
    return mt.finish_loss(g, "lang", "source")


@query("sampling_error", oracle(
    "SELECT category, round(p, 6) AS accuracy, n AS total, round(sqrt(p * (1 - p) / n), 6) AS std_error, "
    "round(1.96 * sqrt(p * (1 - p) / n), 6) AS ci95 FROM (SELECT category, count(*) AS n, "
    f"avg(CASE WHEN {D_PRED} = answer THEN 1.0 ELSE 0.0 END) AS p FROM mc_predictions GROUP BY category) t",
    "mc_predictions"))
def sampling_error(spark, sf_dir):
    g = _preds(spark, sf_dir).groupBy("category").agg(F.count(F.lit(1)).alias("total"),
                                                      F.avg(F.col("correct").cast("double")).alias("p"))
    se = F.sqrt(F.col("p") * (1 - F.col("p")) / F.col("total"))
    return g.select("category", F.round("p", 6).alias("accuracy"), "total", F.round(se, 6).alias("std_error"),
                    F.round(se * 1.96, 6).alias("ci95"))


def _d_bootstrap(key: str, num: str, den: str, rows: str) -> str:
    """The same replicates in DuckDB, one row per (row, replicate)."""
    pairs = ", ".join("{{'a': {}, 'c': {}}}".format(*bs.factors(b)) for b in range(bs.REPLICATES))
    p, low, high = bs.PRIME, (1 - bs.LEVEL) / 2, (1 + bs.LEVEL) / 2
    copies = " + ".join(f"CAST(d >= {t} AS BIGINT)" for t in bs.STEPS)
    return (f"WITH u AS (SELECT {key}, {num} AS num, {den} AS den, ('0x' || substr(md5('{bs.SEED}:' || CAST(item_id AS VARCHAR)), 1, 7))::BIGINT AS u FROM {rows}), "
            f"v AS (SELECT {key}, num, den, f.a AS b, (u * f.a + f.c) % {p} AS v FROM u, (SELECT unnest([{pairs}]) AS f)), "
            f"d AS (SELECT {key}, num, den, b, ((v * v % {p}) * (v * v % {p}) % {p}) * v % {p} AS d FROM v), "
            f"r AS (SELECT {key}, b, count(*) AS total, sum(num) / sum(den) AS value, sum(num * ({copies})) / sum(den * ({copies})) AS r FROM d GROUP BY {key}, b) "
            f"SELECT {key}, any_value(total) AS total, round(any_value(value), 6) AS value, round(stddev_pop(r), 6) AS std_error, "
            f"round(quantile_disc(r, {low}), 6) AS low, round(quantile_disc(r, {high}), 6) AS high FROM r GROUP BY {key}")


@query("bootstrap_interval", oracle(_d_bootstrap("category", f"CASE WHEN {D_PRED} = answer THEN 1 ELSE 0 END", "1", "mc_predictions"), "mc_predictions"))
def bootstrap_interval(spark, sf_dir):
    """Accuracy per category with the bootstrap's 95 % interval, beside ``sampling_error``'s formula."""
    return bs.bootstrap_ratio(_preds(spark, sf_dir), ["category"], "item_id", F.col("correct").cast("bigint"))


@query("bootstrap_loss", oracle(_d_bootstrap("lang", "loss * n_tokens", "n_tokens", f"(SELECT * FROM loss_items WHERE {D_NONBLANK})"), "loss_items"))
def bootstrap_loss(spark, sf_dir):
    """Token-weighted loss per language with its interval: rows are resampled, tokens go with them."""
    from tunedata.functions.strings import is_blank

    li = Views(spark, sf_dir).loss_items.where(~is_blank("text"))
    return bs.bootstrap_ratio(li, ["lang"], "item_id", F.col("loss") * F.col("n_tokens"), F.col("n_tokens"))


def _eval_metric(spark, sf_dir):
    e = Views(spark, sf_dir).run_evals
    return e.select("run_dir", "benchmark",
                    F.coalesce(F.col("accuracy"), -F.col("loss")).alias("metric"))


_D_METRIC = "(SELECT run_dir, benchmark, coalesce(accuracy, -loss) AS metric FROM run_evals)"


@query("baseline_delta", oracle(
    f"SELECT e.run_dir, e.benchmark, round(e.metric, 6) AS metric, round(b.baseline, 6) AS baseline, "
    f"round(e.metric - b.baseline, 6) AS delta, e.metric > b.baseline AS beats_baseline FROM {_D_METRIC} e "
    f"JOIN (SELECT benchmark, arg_min(metric, run_dir) AS baseline FROM {_D_METRIC} m GROUP BY benchmark) b "
    "ON e.benchmark = b.benchmark", "run_evals"))
def baseline_delta(spark, sf_dir):
    """Each benchmark's baseline is its evaluation of the first run; joined on benchmark."""
    m = _eval_metric(spark, sf_dir)
    base = m.groupBy("benchmark").agg(F.min_by("metric", "run_dir").alias("baseline"))
    j = m.join(base, "benchmark")
    return j.select("run_dir", "benchmark", F.round("metric", 6).alias("metric"),
                    F.round("baseline", 6).alias("baseline"),
                    F.round(F.col("metric") - F.col("baseline"), 6).alias("delta"),
                    (F.col("metric") > F.col("baseline")).alias("beats_baseline"))


def _arms(spark, sf_dir):
    cs = Views(spark, sf_dir).category_scores
    return cs.groupBy("category").agg(
        F.max(F.when(F.col("arm") == "baseline", F.col("accuracy"))).alias("baseline_accuracy"),
        F.max(F.when(F.col("arm") == "tuned", F.col("accuracy"))).alias("tuned_accuracy"))


_D_ARMS = ("(SELECT category, max(CASE WHEN arm = 'baseline' THEN accuracy END) AS baseline_accuracy, "
           "max(CASE WHEN arm = 'tuned' THEN accuracy END) AS tuned_accuracy FROM category_scores GROUP BY category)")


@query("forgetting_check", oracle(
    "SELECT category, round(baseline_accuracy, 6) AS baseline_accuracy, round(tuned_accuracy, 6) AS tuned_accuracy, "
    "round(baseline_accuracy - tuned_accuracy, 6) AS accuracy_drop, "
    f"baseline_accuracy - tuned_accuracy > 0.05 AS forgetting FROM {_D_ARMS} a", "category_scores"))
def forgetting_check(spark, sf_dir):
    a = _arms(spark, sf_dir)
    drop = F.col("baseline_accuracy") - F.col("tuned_accuracy")
    return a.select("category", F.round("baseline_accuracy", 6).alias("baseline_accuracy"),
                    F.round("tuned_accuracy", 6).alias("tuned_accuracy"), F.round(drop, 6).alias("accuracy_drop"),
                    (drop > mt.FORGETTING_DROP).alias("forgetting"))


@query("contamination_suspect", oracle(
    "SELECT category, round(tuned_accuracy - baseline_accuracy, 6) AS jump, "
    f"tuned_accuracy - baseline_accuracy > 0.10 AS suspect FROM {_D_ARMS} a", "category_scores"))
def contamination_suspect(spark, sf_dir):
    a = _arms(spark, sf_dir)
    jump = F.col("tuned_accuracy") - F.col("baseline_accuracy")
    return a.select("category", F.round(jump, 6).alias("jump"), (jump > mt.CONTAMINATION_JUMP).alias("suspect"))


@query("classification_metrics", oracle(
    "WITH p AS (SELECT answer AS y, " + D_PRED + " AS p FROM mc_predictions), "
    "cls AS (SELECT y AS c FROM p UNION SELECT p FROM p), "
    "per AS (SELECT CAST(c AS VARCHAR) AS cls, "
    "coalesce(sum(CASE WHEN p.p = c AND p.y = c THEN 1 ELSE 0 END) / nullif(sum(CASE WHEN p.p = c THEN 1 ELSE 0 END), 0), 0.0) AS prec, "
    "coalesce(sum(CASE WHEN p.p = c AND p.y = c THEN 1 ELSE 0 END) / nullif(sum(CASE WHEN p.y = c THEN 1 ELSE 0 END), 0), 0.0) AS rec, "
    "CAST(sum(CASE WHEN p.y = c THEN 1 ELSE 0 END) AS BIGINT) AS support FROM cls, p GROUP BY c), "
    "f AS (SELECT cls, prec, rec, CASE WHEN prec + rec = 0 THEN 0.0 ELSE 2 * prec * rec / (prec + rec) END AS f1, "
    "support FROM per) "
    "SELECT cls, round(prec, 6) AS precision, round(rec, 6) AS recall, round(f1, 6) AS f1, support FROM f "
    "UNION ALL SELECT 'macro', round(avg(prec), 6), round(avg(rec), 6), round(avg(f1), 6), "
    "CAST(sum(support) AS BIGINT) FROM f", "mc_predictions"))
def classification_metrics(spark, sf_dir):
    return mt.confusion_metrics(_preds(spark, sf_dir), "answer", "pred")


# Which published base model each synthetic run family stands for.
RUN_BASE_MODELS = [("base-0", "Llama 3.2 1B"), ("base-1", "Qwen 2.5 7B"), ("base-2", "Llama 3.1 8B"),
                   ("base-3", "Phi-4 (14B)")]


@query("expected_score_gap", oracle(
    "SELECT e.run_dir, a.base_model, round(e.accuracy, 6) AS accuracy, b.lo, b.hi, "
    "round(CASE WHEN b.lo IS NULL THEN NULL WHEN e.accuracy < b.lo THEN e.accuracy - b.lo "
    "WHEN e.accuracy > b.hi THEN e.accuracy - b.hi ELSE 0.0 END, 6) AS gap "
    "FROM run_evals e LEFT JOIN run_configs c ON e.run_dir = c.run_dir LEFT JOIN (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in RUN_BASE_MODELS) + ") AS a(model, base_model) "
    "ON c.model = a.model LEFT JOIN (VALUES " + ", ".join(f"('{m}', {lo}, {hi})" for m, lo, hi in mt.EXPECTED_MMLU)
    + ") AS b(base_model, lo, hi) ON a.base_model = b.base_model WHERE e.benchmark = 'mmlu'",
    "run_evals", "run_configs"))
def expected_score_gap(spark, sf_dir):
    v = Views(spark, sf_dir)
    alias = spark.createDataFrame(RUN_BASE_MODELS, "model string, base_model string")
    bands = spark.createDataFrame(mt.EXPECTED_MMLU, "base_model string, lo double, hi double")
    e = v.run_evals.where(F.col("benchmark") == "mmlu").select("run_dir", "accuracy")
    # A run whose base model has no published band stays, without a gap.
    j = (e.join(v.run_configs.select("run_dir", "model"), "run_dir", "left")
         .join(F.broadcast(alias), "model", "left").join(F.broadcast(bands), "base_model", "left"))
    acc = F.col("accuracy")
    gap = F.when(F.col("lo").isNull(), F.lit(None)).when(acc < F.col("lo"), acc - F.col("lo")).when(acc > F.col("hi"), acc - F.col("hi")).otherwise(0.0)
    return j.select("run_dir", "base_model", F.round(acc, 6).alias("accuracy"), "lo", "hi",
                    F.round(gap, 6).alias("gap"))


_CFG = ["model", "dataset", "learning_rate", "lora_r", "lora_alpha", "batch_size"]


@query("repeat_variance", oracle(
    "SELECT " + ", ".join(_CFG) + ", count(*) AS n_runs, round(max(accuracy) - min(accuracy), 6) AS spread, "
    "round(coalesce(stddev_samp(accuracy), 0.0), 6) AS stddev, CASE WHEN count(*) = 1 THEN 'single' "
    "WHEN max(accuracy) - min(accuracy) > 0.01 THEN 'real' ELSE 'noise' END AS verdict "
    "FROM run_configs c JOIN run_evals e ON c.run_dir = e.run_dir AND e.benchmark = 'mmlu' GROUP BY "
    + ", ".join(_CFG), "run_configs", "run_evals"))
def repeat_variance(spark, sf_dir):
    v = Views(spark, sf_dir)
    e = v.run_evals.where(F.col("benchmark") == "mmlu").select("run_dir", "accuracy")
    g = v.run_configs.join(e, "run_dir").groupBy(*_CFG).agg(
        F.count(F.lit(1)).alias("n_runs"), (F.max("accuracy") - F.min("accuracy")).alias("_s"),
        F.coalesce(F.stddev_samp("accuracy"), F.lit(0.0)).alias("_sd"))
    verdict = (F.when(F.col("n_runs") == 1, "single").when(F.col("_s") > mt.REPEAT_NOISE, "real")
               .otherwise("noise"))
    return g.select(*_CFG, "n_runs", F.round("_s", 6).alias("spread"), F.round("_sd", 6).alias("stddev"),
                    verdict.alias("verdict"))


@query("reward_accuracy", oracle(
    "SELECT step_bucket, count(*) AS n_pairs, round(avg(CASE WHEN chosen_reward > rejected_reward THEN 1.0 ELSE 0.0 "
    "END), 6) AS reward_accuracy, round(avg(chosen_reward - rejected_reward), 6) AS mean_margin "
    "FROM preference_scores GROUP BY step_bucket", "preference_scores"))
def reward_accuracy(spark, sf_dir):
    s = Views(spark, sf_dir).preference_scores
    return s.groupBy("step_bucket").agg(
        F.count(F.lit(1)).alias("n_pairs"),
        F.round(F.avg((F.col("chosen_reward") > F.col("rejected_reward")).cast("double")), 6).alias("reward_accuracy"),
        F.round(F.avg(F.col("chosen_reward") - F.col("rejected_reward")), 6).alias("mean_margin"))


@query("chosen_perplexity_ratio", oracle(
    "SELECT round(bl, 6) AS base_loss, round(tl, 6) AS tuned_loss, round(exp(least(bl, 100)), 6) AS base_ppl, "
    "round(exp(least(tl, 100)), 6) AS tuned_ppl, round(exp(least(tl, 100)) / exp(least(bl, 100)), 6) AS ratio "
    "FROM (SELECT sum(b.loss * b.n_tokens) / greatest(sum(b.n_tokens), 1) AS bl, "
    "sum(b.loss * (0.8 + (b.item_id % 5) * 0.1) * b.n_tokens) / greatest(sum(b.n_tokens), 1) AS tl "
    f"FROM loss_items b WHERE {D_NONBLANK.replace('text', 'b.text')}) t", "loss_items"))
def chosen_perplexity_ratio(spark, sf_dir):
    """Base and tuned per-item losses joined on item, aggregated twice, perplexity ratio."""
    from tunedata.functions.strings import is_blank

    li = Views(spark, sf_dir).loss_items.where(~is_blank("text"))
    base = li.select("item_id", "n_tokens", F.col("loss").alias("base_loss"))
    tuned = li.select("item_id", (F.col("loss") * (0.8 + (F.col("item_id") % 5) * 0.1)).alias("tuned_loss"))
    j = base.join(tuned, "item_id")
    a = j.agg((F.sum(F.col("base_loss") * F.col("n_tokens")) / F.greatest(F.sum("n_tokens"), F.lit(1))).alias("bl"),
              (F.sum(F.col("tuned_loss") * F.col("n_tokens")) / F.greatest(F.sum("n_tokens"), F.lit(1))).alias("tl"))
    bp, tp = F.exp(F.least("bl", F.lit(100.0))), F.exp(F.least("tl", F.lit(100.0)))
    return a.select(F.round("bl", 6).alias("base_loss"), F.round("tl", 6).alias("tuned_loss"),
                    F.round(bp, 6).alias("base_ppl"), F.round(tp, 6).alias("tuned_ppl"),
                    F.round(tp / bp, 6).alias("ratio"))
