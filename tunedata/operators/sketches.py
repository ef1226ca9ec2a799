"""Quantile sketches that are kept and merged: percentiles of a corpus without a rescan of its texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Size of a sketch: its largest rank error is ``rank_error(K)``, whatever the number of rows.
K = 4000


def rank_error(k: int = K) -> float:
    """Normalised rank error of a KLL sketch of size ``k`` with 99 % confidence, as its authors publish it."""
    return 2.296 / k ** 0.9723


def quantile_sketches(df: DataFrame, keys: list[str], value: Column, k: int = K) -> DataFrame:
    """``keys, n, sketch``: a KLL sketch (some tens of kilobytes) of the whole numbers ``value`` per group, built by partial
    aggregation. Rows with a null value are passed over."""
    rows = df.select(*keys, value.cast("bigint").alias("_v")).where("_v IS NOT NULL")
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.kll_sketch_agg_bigint("_v", k).alias("sketch"))


def merge_sketches(sketches: DataFrame, keys: list[str], k: int = K) -> DataFrame:
    """Sketches of coarser groups (no key: of everything) out of kept ones; merging again and again keeps the error."""
    return sketches.groupBy(*keys).agg(F.sum("n").alias("n"), F.kll_merge_agg_bigint("sketch", k).alias("sketch"))


def sketch_quantiles(sketches: DataFrame, keys: list[str], percents: tuple[float, ...]) -> DataFrame:
    """``keys, n, p, value``: for each share the least value whose rank reaches it."""
    at = F.array(*[F.lit(float(p)) for p in percents])
    pairs = F.arrays_zip(at.alias("p"), F.kll_sketch_get_quantile_bigint("sketch", at).alias("value"))
    return sketches.select(*keys, "n", F.inline(pairs).alias("p", "value"))


def within_bound(quantiles: DataFrame, df: DataFrame, keys: list[str], value: Column, k: int = K) -> DataFrame:
    """Adds ``within``: whether a value's exact rank in ``df`` is at most the bound away from ``p``. One pass over
    ``df`` counts distinct values, so that the join is on a value's count, not on rows."""
    counts = df.select(*keys, value.cast("bigint").alias("_v")).where("_v IS NOT NULL").groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_c"))
    q = quantiles.select(*[F.col(c).alias(f"_k_{c}") for c in keys], "n", "p", "value")
    same = F.lit(True)
    for c in keys:
        same = same & F.col(c).eqNullSafe(F.col(f"_k_{c}"))
    j = q.join(counts, same) if keys else q.join(counts, F.col("n") >= 0)
    below = F.sum(F.when(F.col("_v") < F.col("value"), F.col("_c")).otherwise(0)) / F.col("n")
    upto = F.sum(F.when(F.col("_v") <= F.col("value"), F.col("_c")).otherwise(0)) / F.col("n")
    eps = rank_error(k) + 1e-9
    return (j.groupBy(*[f"_k_{c}" for c in keys], "n", "p", "value").agg((below - eps).alias("_lo"), (upto + eps).alias("_hi"))
            .select(*[F.col(f"_k_{c}").alias(c) for c in keys], "n", "p", "value",
                    ((F.col("_lo") <= F.col("p")) & (F.col("p") <= F.col("_hi"))).alias("within")))
