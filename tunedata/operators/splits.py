"""Splits, sampling and mixing (E family): deterministic hash buckets instead of random splits,
so a split is reproducible across engines, re-runs and executor loss (no RNG state)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tunedata.functions.text import md5_bucket
from tunedata.operators.ordering import hash_prefix_block, positions_by_block

# Split policy of the reference docs and the trainer's default seed.
SEED = 3407
SMALL_NO_VAL_ROWS = 1000
LARGE_ROWS = 10000
STANDARD_VAL = 0.05
LARGE_VAL = 0.10
BUCKETS = 10000


def split_policy(n_rows: Column) -> Column:
    """Validation fraction: no split under 1K rows, 10 % over 10K, otherwise 5 %."""
    return (F.when(n_rows < SMALL_NO_VAL_ROWS, F.lit(0.0)).when(n_rows > LARGE_ROWS, F.lit(LARGE_VAL))
            .otherwise(F.lit(STANDARD_VAL)))


def policy_fraction(n_rows: int) -> float:
    if n_rows < SMALL_NO_VAL_ROWS:
        return 0.0
    return LARGE_VAL if n_rows > LARGE_ROWS else STANDARD_VAL


def split_column(key: str | Column, fraction: float | Column, seed: int = SEED) -> Column:
    """'val' when the key's md5 bucket falls under ``fraction``, else 'train'. Map-only."""
    k = F.col(key) if isinstance(key, str) else key
    frac = fraction if isinstance(fraction, Column) else F.lit(float(fraction))
    return F.when(md5_bucket(k, seed, BUCKETS) < frac * BUCKETS, F.lit("val")).otherwise(F.lit("train"))


def train_val_split(df: DataFrame, key: str, fraction: float | None = None, seed: int = SEED) -> DataFrame:
    """Adds ``split``. With ``fraction=None`` the policy is applied to the row count (one scalar
    count job; only the number travels to the driver)."""
    if fraction is None:
        fraction = policy_fraction(df.count())
    return df.withColumn("split", split_column(key, fraction, seed))


def leakage(df: DataFrame, split_col: str, text_col: str) -> DataFrame:
    """Validation rows whose text also occurs in train (semi-join on a content digest)."""
    keyed = df.withColumn("_k", F.sha2(F.col(text_col), 256))
    train = keyed.where(F.col(split_col) == "train").select("_k")
    return keyed.where(F.col(split_col) == "val").join(train, "_k", "left_semi").drop("_k")


def head_sample(df: DataFrame, order: str, n: int | None) -> DataFrame:
    """First ``min(n, rows)`` rows in ``order``; 0/None keeps all (TakeOrderedAndProject)."""
    return df if not n else df.orderBy(order).limit(n)


def shuffle_key(key: str | Column, seed: int = SEED) -> Column:
    k = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat(F.lit(f"{seed}:"), k.cast("string")))


def stratified_sample(df: DataFrame, stratum: str, key: str, k: int, seed: int = SEED) -> DataFrame:
    """Up to ``k`` rows per stratum, chosen by seeded hash order. The ``rn <= k`` filter lets
    Spark insert a per-partition group limit before the shuffle, so a huge stratum ships only
    k rows per map task."""
    w = Window.partitionBy(stratum).orderBy(shuffle_key(key, seed), F.col(key))
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k).drop("_rn")


def seeded_shuffle(df: DataFrame, key: str, seed: int = SEED, name: str = "shuffle_pos",
                   block_digits: int = 3) -> DataFrame:
    """Global position in seeded-hash order. Blocks are hash prefixes (uniform by construction),
    so every block holds ~rows/16**digits rows and no task sees the whole order."""
    keyed = df.withColumn("_sk", shuffle_key(key, seed))
    return positions_by_block(keyed, hash_prefix_block("_sk", block_digits), ["_sk", key], 16 ** block_digits, name).drop("_sk")


def mix_datasets(parts: list[tuple[str, DataFrame, float]], key: str, seed: int = SEED) -> DataFrame:
    """Union of sources, each kept at its weight by hash bucket, with a provenance column."""
    out = None
    for origin, df, weight in parts:
        kept = df if weight >= 1.0 else df.where(md5_bucket(F.col(key), seed, BUCKETS) < int(weight * BUCKETS))
        kept = kept.withColumn("origin", F.lit(origin))
        out = kept if out is None else out.unionByName(kept)
    return out


def batch_assignment(df: DataFrame, key: str, batch_size: int, grad_accum: int,
                     seed: int = SEED) -> DataFrame:
    """Row -> optimizer step and micro-batch of a seeded epoch order."""
    pos = seeded_shuffle(df, key, seed, "pos")
    eff = batch_size * grad_accum
    return pos.withColumn("step", F.floor((F.col("pos") - 1) / eff).cast("bigint")) \
        .withColumn("micro_batch", F.floor((F.col("pos") - 1) / batch_size).cast("bigint"))
