"""H family: planning over sweep requests derived from the run owners in `events`."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tunedata.operators import runs as rn
from tunedata.operators import sweep as sw
from tunedata.plans.registry import query
from tunedata.plans.views import Views, oracle

GIB = 1073741824.0

# ------------------------------------------------------------------ DuckDB expressions
D_PROFILES = ("(VALUES " + ", ".join(f"('{b}', {str(c).lower()}, {s}, {bs}, {ga}, {lr}, {r}, {seq})"
                                     for b, c, s, bs, ga, lr, r, seq in sw.PROFILES)
              + ") AS p(p_budget, p_cuda, p_max_steps, p_batch_size, p_grad_accum, p_learning_rate, p_lora_r, "
                "p_max_seq_length)")
D_SIZE = ("coalesce(TRY_CAST(regexp_replace(list_filter(string_split(string_split(lower(model), '/')[-1], '-'), "
          "lambda t: regexp_matches(t, '^[0-9.]*[0-9][0-9.]*b$'))[1], 'b$', '') AS DOUBLE), 7.0)")
D_RQ = (f"rq AS (SELECT r.*, p.*, {D_SIZE} AS size_b FROM plan_requests r LEFT JOIN {D_PROFILES} "
        "ON r.budget = p.p_budget AND r.has_cuda = p.p_cuda)")


def d_hidden(s: str) -> str:
    # nearest of 1,3,7,8,13,34,70 with ties to the smaller size, as midpoint thresholds
    return (f"(CASE WHEN {s} <= 2 THEN 2048 WHEN {s} <= 5 THEN 3200 WHEN {s} <= 10.5 THEN 4096 "
            f"WHEN {s} <= 23.5 THEN 5120 WHEN {s} <= 52 THEN 6656 ELSE 8192 END)")


def d_parts(s: str, r: str, b: str, seq: str, q4: str = "true") -> dict[str, str]:
    h = d_hidden(s)
    w = f"({s} * 1e9 * (CASE WHEN {q4} THEN 0.5 ELSE 2.0 END) / {GIB})"
    a = f"(CAST({r} AS DOUBLE) * {h} * 2 * 7 * 2.0 / {GIB})"
    act = f"(CAST({b} AS DOUBLE) * {seq} * {h} * 4.0 / {GIB})"
    tot = f"(({w} + {a} + {a} * 2.0 + {a} + {act}) * 1.1)"
    return {"h": h, "w": w, "a": a, "act": act, "total": tot}


def d_total(s, r, b, seq, q4="true") -> str:
    return f"round({d_parts(s, r, b, seq, q4)['total']}, 1)"


def d_fit(s: str, r: str, b: str, seq: str, vram: str) -> str:
    levels = [f"({b} // {2 ** i})" for i in range(4)]
    whens = " ".join(f"WHEN {lv} >= 1 AND ({lv} = 1 OR {d_total(s, r, lv, seq)} <= {vram} * 0.9) THEN {lv}"
                     for lv in levels)
    return f"(CASE WHEN {vram} IS NULL THEN {b} {whens} ELSE 1 END)"


D_STEPS = ("(CASE WHEN dataset_rows IS NULL THEN p_max_steps WHEN dataset_rows < 500 THEN greatest(50, p_max_steps // 2) "
           "WHEN dataset_rows > 50000 THEN CAST(floor(p_max_steps * 1.5) AS INTEGER) ELSE p_max_steps END)")


# ------------------------------------------------------------------ Spark building blocks
def requests(spark, sf_dir) -> DataFrame:
    """Requests with their budget profile (6-row dimension, broadcast) and parsed model size."""
    r = Views(spark, sf_dir).plan_requests
    return (r.join(F.broadcast(sw.profiles(spark)), ["budget", "has_cuda"], "left")
            .withColumn("size_b", sw.parse_model_size("model")))


def planned(spark, sf_dir) -> DataFrame:
    """Adapted steps and VRAM-fitted batch per request."""
    rq = requests(spark, sf_dir)
    steps = sw.adapt_steps(F.col("p_max_steps"), F.col("dataset_rows"))
    batch = sw.fit_batch(F.col("size_b"), F.col("p_lora_r"), F.col("p_batch_size"), F.col("p_max_seq_length"),
                         F.col("available_vram_gb"))
    return rq.withColumn("steps", steps).withColumn("batch", batch)


@query("parse_model_size", oracle(f"SELECT request_id, model, {D_SIZE} AS model_size_b FROM plan_requests",
                                  "plan_requests"))
def parse_model_size(spark, sf_dir):
    r = Views(spark, sf_dir).plan_requests
    return r.select("request_id", "model", sw.parse_model_size("model").alias("model_size_b"))


@query("nearest_hidden_dim", oracle(
    f"SELECT request_id, {D_SIZE} AS model_size_b, {d_hidden(D_SIZE)} AS hidden_dim FROM plan_requests",
    "plan_requests"))
def nearest_hidden_dim(spark, sf_dir):
    r = Views(spark, sf_dir).plan_requests.withColumn("model_size_b", sw.parse_model_size("model"))
    return r.select("request_id", "model_size_b", sw.nearest_hidden_dim(F.col("model_size_b")).alias("hidden_dim"))


def _d_vram_cols(s, r, b, seq) -> str:
    p = d_parts(s, r, b, seq)
    return (f"{p['h']} AS hidden_dim, round({p['w']}, 2) AS model_weights_gb, round({p['a']}, 3) AS adapter_gb, "
            f"round({p['a']} * 2.0, 3) AS optimizer_gb, round({p['a']}, 3) AS gradient_gb, "
            f"round({p['act']}, 2) AS activation_gb, round({p['total']}, 1) AS total_gb")


@query("vram_sweep", oracle(
    "WITH " + D_RQ + " SELECT request_id, size_b AS model_size_b, "
    + _d_vram_cols("size_b", "p_lora_r", "p_batch_size", "p_max_seq_length") + " FROM rq", "plan_requests"))
def vram_sweep(spark, sf_dir):
    rq = requests(spark, sf_dir)
    est = sw.estimate_vram(F.col("size_b"), F.col("p_lora_r"), F.col("p_batch_size"), F.col("p_max_seq_length"),
                           F.lit(True))
    return rq.select("request_id", F.col("size_b").alias("model_size_b"), *[v.alias(k) for k, v in est.items()])


@query("budget_profile", oracle(
    "WITH " + D_RQ + " SELECT request_id, budget, p_max_steps AS max_steps, p_batch_size AS batch_size, "
    "p_grad_accum AS gradient_accumulation_steps, p_learning_rate AS learning_rate, p_lora_r AS lora_r, "
    "p_max_seq_length AS max_seq_length, CASE WHEN p_budget IS NULL THEN 'Unsupported budget profile: ' || budget "
    "END AS plan_error FROM rq", "plan_requests"))
def budget_profile(spark, sf_dir):
    rq = requests(spark, sf_dir)
    err = F.when(F.col("p_max_steps").isNull(), F.concat(F.lit("Unsupported budget profile: "), F.col("budget")))
    return rq.select("request_id", "budget", F.col("p_max_steps").alias("max_steps"),
                     F.col("p_batch_size").alias("batch_size"),
                     F.col("p_grad_accum").alias("gradient_accumulation_steps"),
                     F.col("p_learning_rate").alias("learning_rate"), F.col("p_lora_r").alias("lora_r"),
                     F.col("p_max_seq_length").alias("max_seq_length"), err.alias("plan_error"))


@query("adapt_steps", oracle("WITH " + D_RQ + f" SELECT request_id, dataset_rows, {D_STEPS} AS max_steps FROM rq",
                             "plan_requests"))
def adapt_steps(spark, sf_dir):
    p = planned(spark, sf_dir)
    return p.select("request_id", "dataset_rows", F.col("steps").alias("max_steps"))


_D_FIT = d_fit("size_b", "p_lora_r", "p_batch_size", "p_max_seq_length", "available_vram_gb")


@query("fit_batch", oracle(
    "WITH " + D_RQ + f" SELECT request_id, {_D_FIT} AS batch_size, {_D_FIT} <> p_batch_size AS reduced FROM rq",
    "plan_requests"))
def fit_batch(spark, sf_dir):
    p = planned(spark, sf_dir)
    return p.select("request_id", F.col("batch").alias("batch_size"),
                    (F.col("batch") != F.col("p_batch_size")).alias("reduced"))


@query("fits_device", oracle(
    "WITH " + D_RQ + " SELECT request_id, " + d_total("size_b", "p_lora_r", "p_batch_size", "p_max_seq_length")
    + " AS total_gb, CASE WHEN available_vram_gb IS NULL THEN 'unknown' WHEN "
    + d_total("size_b", "p_lora_r", "p_batch_size", "p_max_seq_length")
    + " <= available_vram_gb * 0.9 THEN 'fits' ELSE 'may OOM' END AS verdict FROM rq", "plan_requests"))
def fits_device(spark, sf_dir):
    rq = requests(spark, sf_dir)
    total = sw.estimate_vram(F.col("size_b"), F.col("p_lora_r"), F.col("p_batch_size"), F.col("p_max_seq_length"),
                             F.lit(True))["total_gb"]
    v = F.col("available_vram_gb")
    verdict = F.when(v.isNull(), "unknown").when(total <= v * sw.VRAM_SAFETY, "fits").otherwise("may OOM")
    return rq.select("request_id", total.alias("total_gb"), verdict.alias("verdict"))


# ------------------------------------------------------------------ run grids and the plan
def _grid(p: DataFrame) -> DataFrame:
    """Three proposed runs per request (SFT or preference family), exploded from an array."""
    steps, batch, lr = F.col("steps"), F.col("batch"), F.col("p_learning_rate")
    r, seq, acc = F.col("p_lora_r"), F.col("p_max_seq_length"), F.col("p_grad_accum")
    small = F.col("dataset_rows") < sw.SMALL_ROWS
    chat = F.col("dataset_format") == "chat"

    def run(i, name, trainer, method, beta, s, b, ga, l_, rr, sq_):
        s = F.when(small, F.least(s, steps)).otherwise(s)
        return F.struct(F.lit(i).alias("run_index"), F.lit(name).alias("name"), F.lit(trainer).alias("trainer"),
                        F.lit(method).cast("string").alias("method"), F.lit(beta).cast("double").alias("beta"),
                        s.cast("int").alias("max_steps"), b.cast("int").alias("batch_size"),
                        ga.cast("int").alias("gradient_accumulation_steps"), l_.cast("double").alias("learning_rate"),
                        rr.cast("int").alias("lora_r"), sq_.cast("int").alias("max_seq_length"))

    sft = F.array(
        run(1, "run_001", "sft", None, None, steps, batch, acc, F.when(chat, F.lit(1e-4)).otherwise(lr), r, seq),
        run(2, "run_002", "sft", None, None, steps, batch, acc, F.lit(1e-4), F.greatest(r, F.lit(32)), seq),
        run(3, "run_003", "sft", None, None, F.floor(steps * 1.5), batch, acc, lr, r, seq))
    pb = F.greatest(F.lit(1), F.floor(batch / 2))
    pseq = F.least(seq, F.lit(1024))
    none = F.lit(None).cast("int")
    pref = F.array(
        run(1, "run_001", "dpo", "dpo", 0.1, steps, pb, none, F.lit(5e-5), r, pseq),
        run(2, "run_002", "dpo", "dpo", 0.05, steps, pb, none, F.lit(5e-5), F.greatest(r, F.lit(32)), pseq),
        run(3, "run_003", "dpo", "orpo", 0.1, steps, pb, none, F.lit(1e-4), r, pseq))
    grid = F.when(F.col("dataset_format") == "preference", pref).otherwise(sft)
    return p.select("request_id", "dataset_format", "baseline_metric", "max_runs",
                    F.explode(grid).alias("run")).select("request_id", "dataset_format", "baseline_metric",
                                                         "max_runs", "run.*")


_RUN_COLS = ["request_id", "name", "trainer", "method", "beta", "max_steps", "batch_size",
             "gradient_accumulation_steps", "learning_rate", "lora_r", "max_seq_length"]


def _d_grid() -> str:
    s, b = D_STEPS, _D_FIT
    small = "(dataset_rows < 500)"

    def cap(x):
        return f"(CASE WHEN {small} THEN least({x}, {s}) ELSE {x} END)"

    pb, pseq = f"greatest(1, {b} // 2)", "least(p_max_seq_length, 1024)"
    sft = [("1", "'run_001'", "'sft'", "NULL", "NULL", cap(s), b, "p_grad_accum",
            "CASE WHEN dataset_format = 'chat' THEN 1e-4 ELSE p_learning_rate END", "p_lora_r", "p_max_seq_length"),
           ("2", "'run_002'", "'sft'", "NULL", "NULL", cap(s), b, "p_grad_accum", "1e-4", "greatest(p_lora_r, 32)",
            "p_max_seq_length"),
           ("3", "'run_003'", "'sft'", "NULL", "NULL", cap(f"floor({s} * 1.5)"), b, "p_grad_accum", "p_learning_rate",
            "p_lora_r", "p_max_seq_length")]
    pref = [("1", "'run_001'", "'dpo'", "'dpo'", "0.1", cap(s), pb, "NULL", "5e-5", "p_lora_r", pseq),
            ("2", "'run_002'", "'dpo'", "'dpo'", "0.05", cap(s), pb, "NULL", "5e-5", "greatest(p_lora_r, 32)", pseq),
            ("3", "'run_003'", "'dpo'", "'orpo'", "0.1", cap(s), pb, "NULL", "1e-4", "p_lora_r", pseq)]

    def sel(row, cond):
        i, n, t, m, be, st, bs, ga, lr, r, sq_ = row
        return (f"SELECT request_id, dataset_format, baseline_metric, max_runs, {i} AS run_index, {n} AS name, "
                f"{t} AS trainer, CAST({m} AS VARCHAR) AS method, CAST({be} AS DOUBLE) AS beta, "
                f"CAST({st} AS INTEGER) AS max_steps, CAST({bs} AS INTEGER) AS batch_size, "
                f"CAST({ga} AS INTEGER) AS gradient_accumulation_steps, CAST({lr} AS DOUBLE) AS learning_rate, "
                f"CAST({r} AS INTEGER) AS lora_r, CAST({sq_} AS INTEGER) AS max_seq_length FROM rq WHERE {cond}")

    return " UNION ALL ".join([sel(x, "dataset_format <> 'preference'") for x in sft]
                              + [sel(x, "dataset_format = 'preference'") for x in pref])


D_GRID = "g AS (" + _d_grid() + ")"


@query("sft_run_grid", oracle("WITH " + D_RQ + ", " + D_GRID + " SELECT " + ", ".join(_RUN_COLS)
                              + " FROM g WHERE trainer = 'sft'", "plan_requests"))
def sft_run_grid(spark, sf_dir):
    return _grid(planned(spark, sf_dir)).where(F.col("trainer") == "sft").select(*_RUN_COLS)


@query("preference_run_grid", oracle("WITH " + D_RQ + ", " + D_GRID + " SELECT " + ", ".join(_RUN_COLS)
                                     + " FROM g WHERE trainer = 'dpo'", "plan_requests"))
def preference_run_grid(spark, sf_dir):
    return _grid(planned(spark, sf_dir)).where(F.col("trainer") == "dpo").select(*_RUN_COLS)


@query("plan_runs", oracle(
    "WITH " + D_RQ + ", " + D_GRID + ", k AS (SELECT *, run_index - CASE WHEN baseline_metric > 0.6 THEN 1 ELSE 0 "
    "END AS kept_index FROM g WHERE NOT (coalesce(baseline_metric > 0.6, false) AND run_index = 1)) SELECT " + ", ".join(_RUN_COLS)
    + ", kept_index AS plan_position, true AS approval_required FROM k WHERE kept_index <= greatest(1, max_runs)",
    "plan_requests"))
def plan_runs(spark, sf_dir):
    """Skip the conservative run when the baseline is already strong (> 0.6; the grid always has
    three runs), then keep the first ``max(1, max_runs)``; every plan needs approval."""
    g = _grid(planned(spark, sf_dir))
    strong = F.coalesce(F.col("baseline_metric") > sw.STRONG_BASELINE, F.lit(False))
    k = g.where(~(strong & (F.col("run_index") == 1))) \
        .withColumn("plan_position", F.col("run_index") - F.when(strong, 1).otherwise(0))
    return k.where(F.col("plan_position") <= F.greatest(F.lit(1), F.col("max_runs"))) \
        .select(*_RUN_COLS, "plan_position", F.lit(True).alias("approval_required"))


# The planner's notes.
_PREFERENCE_NOTE = ("Preference-format dataset detected. All runs use DPO/ORPO via run_dpo_training — "
                    "not SFT. Use /run-dpo to execute approved runs.")


@query("plan_notes", oracle(
    "WITH " + D_RQ + f", n AS (SELECT *, {D_STEPS} AS steps, {_D_FIT} AS batch FROM rq) SELECT request_id, concat_ws(' | ', "
    "CASE WHEN dataset_rows < 500 THEN printf('Dataset is small (%d rows): halved max_steps to %d to avoid severe overfitting.', "
    "CAST(dataset_rows AS BIGINT), CAST(steps AS BIGINT)) WHEN dataset_rows > 50000 THEN "
    "printf('Dataset is large (%d rows): increased max_steps to %d.', CAST(dataset_rows AS BIGINT), CAST(steps AS BIGINT)) END, "
    "CASE WHEN batch <> p_batch_size THEN printf('Reduced batch_size from %d to %d to stay within %.1f GB VRAM.', "
    "CAST(p_batch_size AS BIGINT), CAST(batch AS BIGINT), available_vram_gb) END, "
    f"CASE WHEN dataset_format = 'preference' THEN '{_PREFERENCE_NOTE}' END, "
    "CASE WHEN baseline_metric > 0.6 THEN printf('Baseline metric is %.3f (>0.6): skipping the conservative run, "
    "starting with exploratory configs.', baseline_metric) END) AS notes FROM n", "plan_requests"))
def plan_notes(spark, sf_dir):
    """What the planner changed, and why, per request."""
    p = planned(spark, sf_dir)
    rows = F.col("dataset_rows").cast("bigint")
    notes = F.array_compact(F.array(
        F.when(rows < sw.SMALL_ROWS, F.format_string("Dataset is small (%d rows): halved max_steps to %d to avoid severe overfitting.",
                                                     rows, F.col("steps")))
        .when(rows > sw.LARGE_ROWS, F.format_string("Dataset is large (%d rows): increased max_steps to %d.", rows, F.col("steps"))),
        F.when(F.col("batch") != F.col("p_batch_size"), F.format_string(
            "Reduced batch_size from %d to %d to stay within %.1f GB VRAM.", "p_batch_size", "batch", "available_vram_gb")),
        F.when(F.col("dataset_format") == "preference", F.lit(_PREFERENCE_NOTE)),
        F.when(F.col("baseline_metric") > sw.STRONG_BASELINE, F.format_string(
            "Baseline metric is %.3f (>0.6): skipping the conservative run, starting with exploratory configs.", "baseline_metric"))))
    return p.select("request_id", F.array_join(notes, " | ").alias("notes"))


@query("lora_lint", oracle(
    "SELECT run_dir, concat_ws(' | ', CASE WHEN lora_alpha < lora_r THEN printf('lora_alpha (%d) < lora_r (%d): "
    "scaling is below 1.0, which weakens adaptation. Recommended: lora_alpha = 2 * lora_r.', lora_alpha, lora_r) END, "
    "CASE WHEN lora_alpha >= lora_r AND lora_alpha <> 2 * lora_r THEN printf('lora_alpha (%d) != 2 * lora_r (%d): "
    "setting lora_alpha = 2 * lora_r is the 2025 standard for optimal scaling.', lora_alpha, lora_r) END) AS warnings, "
    "CAST((CASE WHEN lora_alpha < lora_r THEN 1 ELSE 0 END) + (CASE WHEN lora_alpha >= lora_r AND lora_alpha <> "
    "2 * lora_r THEN 1 ELSE 0 END) AS BIGINT) AS n_warnings FROM run_configs", "run_configs"))
def lora_lint(spark, sf_dir):
    c = Views(spark, sf_dir).run_configs
    w = sw.lora_warnings(F.col("lora_r"), F.col("lora_alpha"))
    return c.select("run_dir", F.array_join(w, " | ").alias("warnings"), F.size(w).cast("bigint").alias("n_warnings"))


# Size of the base model each synthetic run family stands for (billions).
RUN_BASE_SIZES = [("base-0", 1.0), ("base-1", 7.0), ("base-2", 8.0), ("base-3", 14.0)]
# SFT learning-rate ranges by model size band [lo_b, hi_b).
SFT_LR_BANDS = [(0.0, 1.0, "<1B", 1e-4, 5e-4), (1.0, 3.0, "1B-3B", 1e-4, 4e-4), (3.0, 8.0, "3B-8B", 5e-5, 3e-4),
                (8.0, 13.0, "8B-13B", 2e-5, 2e-4), (13.0, 34.0, "13B-34B", 1e-5, 1e-4),
                (34.0, None, "34B+", 5e-6, 5e-5)]
# DPO and ORPO starting rates and the range to explore, by model size band [lo_b, hi_b).
# lo_b, hi_b, band, dpo_start, orpo_start, lo_lr, hi_lr
PREFERENCE_LR_BANDS = [(0.0, 1.0, "<1B", 1e-4, 2e-4, 5e-5, 3e-4), (1.0, 3.0, "1B-3B", 5e-5, 1e-4, 2e-5, 2e-4),
                       (3.0, 8.0, "3B-8B", 5e-5, 8e-5, 2e-5, 1e-4), (8.0, 13.0, "8B-13B", 2e-5, 4e-5, 5e-6, 5e-5),
                       (13.0, None, "13B+", 1e-5, 2e-5, 1e-6, 2e-5)]


def sized(runs: DataFrame) -> DataFrame:
    """Runs with ``size_b``: the size their base model stands for, else the one its name tells."""
    sizes = runs.sparkSession.createDataFrame(RUN_BASE_SIZES, "model string, known_b double")
    return (runs.join(F.broadcast(sizes), "model", "left")
            .withColumn("size_b", F.coalesce("known_b", sw.parse_model_size("model"))).drop("known_b"))


@query("lr_lint", oracle(
    "SELECT c.run_dir, c.size_b, b.band, c.learning_rate, b.lo_lr, b.hi_lr, "
    "c.learning_rate < b.lo_lr OR c.learning_rate > b.hi_lr AS outside FROM (SELECT c.*, coalesce(a.size_b, " + D_SIZE.replace("model", "c.model")
    + ") AS size_b FROM run_configs c LEFT JOIN (VALUES "
    + ", ".join(f"('{m}', {s})" for m, s in RUN_BASE_SIZES) + ") AS a(model, size_b) ON c.model = a.model) c "
    "JOIN (VALUES " + ", ".join(f"({lo}, {'NULL' if hi is None else hi}, '{n}', {l1}, {l2})"
                               for lo, hi, n, l1, l2 in SFT_LR_BANDS)
    + ") AS b(lo_b, hi_b, band, lo_lr, hi_lr) ON c.size_b >= b.lo_b AND (b.hi_b IS NULL OR c.size_b < b.hi_b)",
    "run_configs"))
def lr_lint(spark, sf_dir):
    """Range join of each run's model size to the learning-rate band table (6 rows, broadcast)."""
    c = Views(spark, sf_dir).run_configs
    bands = spark.createDataFrame(SFT_LR_BANDS, "lo_b double, hi_b double, band string, lo_lr double, hi_lr double")
    j = sized(c)
    cond = (j.size_b >= bands.lo_b) & (bands.hi_b.isNull() | (j.size_b < bands.hi_b))
    k = j.join(F.broadcast(bands), cond)
    return k.select("run_dir", "size_b", "band", "learning_rate", "lo_lr", "hi_lr",
                    ((F.col("learning_rate") < F.col("lo_lr")) | (F.col("learning_rate") > F.col("hi_lr")))
                    .alias("outside"))


@query("preference_lr_lint", oracle(
    "SELECT c.run_dir, b.band, c.learning_rate, b.dpo_start, b.orpo_start, b.lo_lr, b.hi_lr, "
    "c.learning_rate < b.lo_lr OR c.learning_rate > b.hi_lr AS outside FROM (SELECT c.*, coalesce(a.size_b, " + D_SIZE.replace("model", "c.model")
    + ") AS size_b FROM run_configs c LEFT JOIN (VALUES "
    + ", ".join(f"('{m}', {s})" for m, s in RUN_BASE_SIZES) + ") AS a(model, size_b) ON c.model = a.model) c JOIN (VALUES "
    + ", ".join(f"({lo}, {'NULL' if hi is None else hi}, '{n}', {d}, {o}, {l1}, {l2})"
                for lo, hi, n, d, o, l1, l2 in PREFERENCE_LR_BANDS)
    + ") AS b(lo_b, hi_b, band, dpo_start, orpo_start, lo_lr, hi_lr) ON c.size_b >= b.lo_b "
    "AND (b.hi_b IS NULL OR c.size_b < b.hi_b)", "run_configs"))
def preference_lr_lint(spark, sf_dir):
    """What each run's learning rate would be as a DPO or ORPO run: its band, starting rates and range."""
    bands = spark.createDataFrame(PREFERENCE_LR_BANDS, "lo_b double, hi_b double, band string, dpo_start double, "
                                  "orpo_start double, lo_lr double, hi_lr double")
    j = sized(Views(spark, sf_dir).run_configs)
    k = j.join(F.broadcast(bands), (j.size_b >= bands.lo_b) & (bands.hi_b.isNull() | (j.size_b < bands.hi_b)))
    lr = F.col("learning_rate")
    return k.select("run_dir", "band", "learning_rate", "dpo_start", "orpo_start", "lo_lr", "hi_lr",
                    ((lr < F.col("lo_lr")) | (lr > F.col("hi_lr"))).alias("outside"))


# The documented OOM recovery ladder, applied cumulatively (gradient checkpointing
# does not change the estimate's formula; it is kept as a step).
D_FLAGS_OOM = ("fl AS (SELECT run_dir, bool_or(contains(lower(line), 'out of memory') OR contains(lower(line), "
               "'cuda oom')) AS has_oom FROM run_logs GROUP BY run_dir)")
OOM_LADDER = ["halve batch_size", "halve batch_size again", "enable gradient checkpointing",
              "reduce max_seq_length to 1024", "reduce max_seq_length to 512", "halve lora_r",
              "enable 4-bit loading"]
DEVICE_GB = 24.0


def _ladder(batch, r):
    half, quarter = F.greatest(F.lit(1), F.floor(batch / 2)), F.greatest(F.lit(1), F.floor(batch / 4))
    hr = F.greatest(F.lit(8), F.floor(r / 2))
    rows = [(0, batch, 2048, r, False), (1, half, 2048, r, False), (2, quarter, 2048, r, False),
            (3, quarter, 2048, r, False), (4, quarter, 1024, r, False), (5, quarter, 512, r, False),
            (6, quarter, 512, hr, False), (7, quarter, 512, hr, True)]
    def as_col(x):
        return (F.lit(x) if isinstance(x, int) else x).cast("int")

    return F.array(*[F.struct(F.lit(i).alias("step"), as_col(b).alias("batch"), F.lit(s).alias("seq"),
                              as_col(x).alias("r"), F.lit(q).alias("q4")) for i, b, s, x, q in rows])


@query("oom_recovery_ladder", oracle(
    "WITH " + D_FLAGS_OOM + ", c AS (SELECT c.*, coalesce(a.size_b, " + D_SIZE.replace("model", "c.model") + ") AS size_b FROM run_configs c LEFT JOIN (VALUES "
    + ", ".join(f"('{m}', {s})" for m, s in RUN_BASE_SIZES) + ") AS a(model, size_b) ON c.model = a.model "
    "JOIN fl ON c.run_dir = fl.run_dir WHERE fl.has_oom), "
    "l AS (SELECT c.run_dir, s.step, s.action, CASE WHEN s.step = 0 THEN batch_size WHEN s.step = 1 THEN "
    "greatest(1, batch_size // 2) ELSE greatest(1, batch_size // 4) END AS b, CASE WHEN s.step <= 3 THEN 2048 "
    "WHEN s.step = 4 THEN 1024 ELSE 512 END AS sq, CASE WHEN s.step >= 6 THEN greatest(8, lora_r // 2) ELSE "
    "lora_r END AS rr, s.step = 7 AS q4, size_b FROM c, (VALUES (0, 'current config'), "
    + ", ".join(f"({i + 1}, '{a}')" for i, a in enumerate(OOM_LADDER)) + ") AS s(step, action)), "
    "t AS (SELECT *, " + d_total("size_b", "rr", "b", "sq", "q4") + " AS total_gb FROM l) "
    "SELECT run_dir, CAST(min(step) FILTER (WHERE total_gb <= 0.9 * 24.0) AS INTEGER) AS first_fit_step, "
    "arg_min(action, step) FILTER (WHERE total_gb <= 0.9 * 24.0) AS action, "
    "arg_min(total_gb, step) FILTER (WHERE total_gb <= 0.9 * 24.0) AS total_gb FROM t GROUP BY run_dir",
    "run_configs", "run_logs"))
def oom_recovery_ladder(spark, sf_dir):
    """For every run whose logs show OOM: the first rung of the ladder whose estimate fits 90 %
    of the device, evaluated per row over an array of candidate configs (no shuffle)."""
    v = Views(spark, sf_dir)
    oom = rn.log_flags(v.run_logs).where("has_oom").select("run_dir")
    c = sized(v.run_configs.join(oom, "run_dir", "left_semi"))
    actions = F.array(F.lit("current config"), *[F.lit(a) for a in OOM_LADDER])

    def with_total(x):
        total = sw.estimate_vram(F.col("size_b"), x["r"], x["batch"], x["seq"], x["q4"])["total_gb"]
        return x.withField("total_gb", total)

    ladder = _ladder(F.col("batch_size"), F.col("lora_r"))
    first = F.get(F.filter(F.transform(ladder, with_total), lambda x: x["total_gb"] <= 0.9 * DEVICE_GB), 0)
    return c.select("run_dir", first["step"].cast("int").alias("first_fit_step"),
                    F.element_at(actions, first["step"] + 1).alias("action"), first["total_gb"].alias("total_gb"))
