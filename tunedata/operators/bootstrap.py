"""Bootstrap intervals in one pass.

A resample of the rows is, to a close approximation, a Poisson(1) number of copies of each row. The
copies of replicate ``b`` follow from the row's id by a hash, so they are the same on every engine, in every retry
and whatever the partitions; each group keeps one running pair of sums per replicate, and the rows are
neither copied nor sorted."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REPLICATES = 100
LEVEL = 0.95
SEED = 3407
#: Draws are residues of this prime; the fifth power is a bijection of them, as 5 does not divide PRIME - 1.
PRIME = (1 << 31) - 1
#: Draws from here on have one copy more: the Poisson(1) distribution function in steps of 1 / PRIME.
STEPS = [math.floor(PRIME * sum(math.exp(-1) / math.factorial(i) for i in range(k + 1))) for k in range(9)]


def row_number_of(key: Column, seed: int = SEED) -> Column:
    """A residue per row id, from the first 7 hex digits of its md5."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string"))), 1, 7), 16, 10).cast("bigint")


def factors(replicate: int) -> tuple[int, int]:
    """The linear step of a replicate: powers of two generators modulo the prime."""
    return pow(48271, replicate + 1, PRIME), pow(69621, replicate + 1, PRIME)


def draws(number: str, replicates: int) -> Column:
    """The copies of a row in every replicate, as one array."""
    pairs = ", ".join("struct({}L as a, {}L as c)".format(*factors(b)) for b in range(replicates))
    power = f"transform(transform(array({pairs}), f -> ({number} * f.a + f.c) % {PRIME}L), v -> (v * v % {PRIME}L) * (v * v % {PRIME}L) % {PRIME}L * v % {PRIME}L)"
    return F.expr(f"transform({power}, d -> " + " + ".join(f"cast(d >= {t}L as int)" for t in STEPS) + ")")


def bootstrap_ratio(df: DataFrame, keys: list[str], row_id: str, numerator: Column, denominator: Column | None = None,
                    replicates: int = REPLICATES, level: float = LEVEL, seed: int = SEED) -> DataFrame:
    """``keys, total, value, std_error, low, high`` of ``sum(numerator) / sum(denominator)`` per group
    (without a denominator: the mean).

    ``low`` and ``high`` are the nearest-rank percentiles of the replicates' ratios, ``std_error`` their
    population deviation. A group whose denominator is 0 in a replicate passes that replicate over; rows with a
    null numerator or denominator are left out, rows that repeat an id are copied together; a null id
    counts as an id of its own."""
    den = F.lit(1) if denominator is None else denominator
    number = row_number_of(F.coalesce(F.col(row_id).cast("string"), F.lit("null")), seed)
    # A fixed-width array of copies is computed once per row; the sums below read its elements.
    rows = (df.select(*keys, numerator.alias("_num"), den.alias("_den"), number.alias("_u"))
            .where("_num is not null and _den is not null")
            .withColumn("_w", draws("_u", replicates)))
    sums = [F.count(F.lit(1)).alias("total"), F.sum("_num").alias("_sn"), F.sum("_den").alias("_sd")]
    for b in range(replicates):
        w = F.get("_w", F.lit(b))
        sums += [F.sum(F.col("_num") * w).alias(f"_n{b}"), F.sum(F.col("_den") * w).alias(f"_d{b}")]
    g = rows.groupBy(*keys).agg(*sums)
    ratios = F.array_sort(F.filter(F.array(*[F.try_divide(F.col(f"_n{b}").cast("double"), F.col(f"_d{b}")) for b in range(replicates)]),
                                   lambda r: r.isNotNull()))
    tail = (1 - level) / 2

    def rank(p: float) -> Column:
        return F.get("_r", F.greatest(F.ceil(F.size("_r") * F.lit(p) - 1e-9), F.lit(1)).cast("int") - 1)

    mean = F.aggregate("_r", F.lit(0.0), lambda s, r: s + r) / F.size("_r")
    square = F.aggregate("_r", F.lit(0.0), lambda s, r: s + (r - F.col("_m")) ** 2) / F.size("_r")
    return (g.select(*keys, "total", F.try_divide(F.col("_sn").cast("double"), F.col("_sd")).alias("value"), ratios.alias("_r"))
            .withColumn("_m", F.when(F.size("_r") > 0, mean))
            .select(*keys, "total", F.round("value", 6).alias("value"), F.round(F.sqrt(F.when(F.size("_r") > 0, square)), 6).alias("std_error"),
                    F.round(rank(tail), 6).alias("low"), F.round(rank(1 - tail), 6).alias("high")))
