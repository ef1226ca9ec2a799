"""Planning over a sweep table (H family): VRAM estimate, budget profiles, batch fitting and the
run grids, as column arithmetic, broadcast dimension joins and ``explode`` -- no driver loops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Hidden size by approximate model size (billions of parameters).
HIDDEN_DIMS = [(1, 2048), (3, 3200), (7, 4096), (8, 4096), (13, 5120), (34, 6656), (70, 8192)]

# Budget profiles (with CUDA / without CUDA).
# budget, has_cuda, max_steps, batch_size, grad_accum, learning_rate, lora_r, max_seq_length
PROFILES = [
    ("quick", True, 100, 2, 8, 2e-4, 16, 1024),
    ("quick", False, 100, 1, 16, 2e-4, 16, 1024),
    ("balanced", True, 200, 4, 4, 2e-4, 16, 2048),
    ("balanced", False, 200, 1, 16, 2e-4, 16, 1024),
    ("thorough", True, 400, 4, 8, 1e-4, 32, 2048),
    ("thorough", False, 400, 1, 16, 1e-4, 32, 1024),
]
PROFILE_SCHEMA = ("budget string, has_cuda boolean, p_max_steps int, p_batch_size int, p_grad_accum int, "
                  "p_learning_rate double, p_lora_r int, p_max_seq_length int")

# Step adaptation, VRAM head-room and the planner's strong-baseline rule.
SMALL_ROWS = 500
LARGE_ROWS = 50000
MIN_STEPS = 50
VRAM_SAFETY = 0.90
STRONG_BASELINE = 0.6
DEFAULT_MODEL_B = 7.0


def profiles(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PROFILES, PROFILE_SCHEMA)


def hidden_dims(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(HIDDEN_DIMS, "size_b int, hidden_dim int")


def nearest_hidden_dim(size_b: Column) -> Column:
    """Nearest size bucket; on a tie the smaller bucket (listed first) wins.

    The dimension has 7 entries, so it is an expression over a literal array (no join)."""
    dims = F.array(*[F.struct(F.lit(s).alias("s"), F.lit(h).alias("h")) for s, h in HIDDEN_DIMS])
    best = F.aggregate(
        dims, F.struct(F.lit(float("inf")).alias("d"), F.lit(0).alias("h")),
        lambda acc, x: F.when(F.abs(x["s"] - size_b) < acc["d"],
                              F.struct(F.abs(x["s"] - size_b).cast("double").alias("d"), x["h"].alias("h")))
        .otherwise(acc))
    return best["h"]


def parse_model_size(model: str | Column) -> Column:
    """Last path part, lower-case, split on '-', first token '<digits/dots>b' -> float, else 7.0."""
    m = F.col(model) if isinstance(model, str) else model
    tokens = F.split(F.element_at(F.split(F.lower(m), "/"), -1), "-")
    tok = F.get(F.filter(tokens, lambda t: t.rlike(r"^[0-9.]*[0-9][0-9.]*b$")), 0)
    num = F.regexp_replace(tok, "b$", "").try_cast("double")
    return F.coalesce(num, F.lit(DEFAULT_MODEL_B))


def estimate_vram(size_b: Column, lora_r: Column, batch: Column, seq: Column,
                  load_in_4bit: Column, precision: Column | None = None, modules: int = 7) -> dict[str, Column]:
    """Heuristic VRAM breakdown in GB (weights, adapter, optimizer, gradient, activation, total)."""
    bpp = F.lit(2.0) if precision is None else F.when(precision == "fp32", F.lit(4.0)).otherwise(F.lit(2.0))
    weight_bytes = F.when(load_in_4bit, F.lit(0.5)).otherwise(bpp)
    gib = float(1024 ** 3)
    h = nearest_hidden_dim(size_b)
    weights = size_b * F.lit(1e9) * weight_bytes / gib
    adapter = lora_r.cast("double") * h * 2 * modules * 2.0 / gib
    optimizer = adapter * 2.0
    gradient = adapter
    activation = batch.cast("double") * seq * h * 4.0 / gib
    total = (weights + adapter + optimizer + gradient + activation) * 1.10
    return {"hidden_dim": h, "model_weights_gb": F.round(weights, 2), "adapter_gb": F.round(adapter, 3),
            "optimizer_gb": F.round(optimizer, 3), "gradient_gb": F.round(gradient, 3),
            "activation_gb": F.round(activation, 2), "total_gb": F.round(total, 1)}


def adapt_steps(steps: Column, rows: Column) -> Column:
    return (F.when(rows.isNull(), steps)
            .when(rows < SMALL_ROWS, F.greatest(F.lit(MIN_STEPS), F.floor(steps / 2).cast("int")))
            .when(rows > LARGE_ROWS, F.floor(steps * 1.5).cast("int"))
            .otherwise(steps))


def fit_batch(size_b: Column, lora_r: Column, batch: Column, seq: Column, vram: Column) -> Column:
    """Halve the batch until the rounded estimate fits 90 % of VRAM; batch 1 is not checked.

    Candidates ``batch >> i`` are generated as an array and the first fitting one is taken."""
    halvings = F.ceil(F.log2(F.greatest(batch, F.lit(1)))).cast("int")
    cands = F.transform(F.sequence(F.lit(0), halvings), lambda i: F.floor(batch / F.pow(F.lit(2), i)).cast("int"))
    cands = F.filter(cands, lambda b: b >= 1)

    def fits(b: Column) -> Column:
        total = estimate_vram(size_b, lora_r, b, seq, F.lit(True))["total_gb"]
        return (b == 1) | (total <= vram * VRAM_SAFETY)

    first_fit = F.get(F.filter(cands, fits), 0)
    return F.when(vram.isNull(), batch).otherwise(F.coalesce(first_fit, F.lit(1)))


def lora_warnings(r: Column, alpha: Column) -> Column:
    return F.array_compact(F.array(
        F.when(alpha < r, F.format_string(
            "lora_alpha (%d) < lora_r (%d): scaling is below 1.0, which weakens adaptation. "
            "Recommended: lora_alpha = 2 * lora_r.", alpha, r)),
        F.when((alpha >= r) & (alpha != r * 2), F.format_string(
            "lora_alpha (%d) != 2 * lora_r (%d): setting lora_alpha = 2 * lora_r is the 2025 standard "
            "for optimal scaling.", alpha, r))))
