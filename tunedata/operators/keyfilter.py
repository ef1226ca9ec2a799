"""Row filters by key that move no wide rows: a bounded Bloom filter in front of an exact join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of 64 bits in a filter: at most this many rows of 16 bytes, whatever the number of keys.
FILTER_WORDS = 1 << 18


def key_filter(keys: DataFrame, hashed: Column, words: int = FILTER_WORDS) -> DataFrame:
    """``(__tdk_word, __tdk_bits)`` of at most ``words`` rows, so its broadcast is bounded. A fuller
    filter lets more rows through to the exact join behind it; it never loses one."""
    bit = F.expr("shiftleft(1L, cast(__tdk_h & 63 as int))").alias("__tdk_bit")
    return (keys.select(hashed.alias("__tdk_h"))
            .select(F.shiftrightunsigned("__tdk_h", 6).bitwiseAND(F.lit(words - 1)).alias("__tdk_word"), bit)
            .groupBy("__tdk_word").agg(F.bit_or("__tdk_bit").alias("__tdk_bits")))


def mark_maybe(df: DataFrame, hashed: Column, bits: DataFrame, flag: str, words: int = FILTER_WORDS) -> DataFrame:
    """Add boolean ``flag``: false only where ``hashed`` is certainly not among the filter's keys."""
    test = "coalesce(shiftrightunsigned(__tdk_bits, cast(__tdk_h & 63 as int)) & 1, 0) = 1"
    return (df.withColumn("__tdk_h", hashed)
            .withColumn("__tdk_word", F.shiftrightunsigned("__tdk_h", 6).bitwiseAND(F.lit(words - 1)))
            .join(F.broadcast(bits), "__tdk_word", "left").withColumn(flag, F.expr(test))
            .drop("__tdk_h", "__tdk_word", "__tdk_bits"))


def rows_with(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The rows of ``df`` that may have a ``key`` of ``keys``; an exact join has to follow."""
    bits = key_filter(keys, F.xxhash64(key))
    return mark_maybe(df, F.xxhash64(key), bits, "__tdk_maybe").filter("__tdk_maybe").drop("__tdk_maybe")


def rows_without(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """``df`` less the rows whose ``key`` is in ``keys``. Only rows that pass the filter are shuffled
    for the anti-join. A null key is never matched."""
    gone = keys.select(F.col(key).alias("__tdk_gone")).filter("__tdk_gone is not null").distinct()
    marked = mark_maybe(df, F.xxhash64(key), key_filter(gone, F.xxhash64("__tdk_gone")), "__tdk_maybe")
    clear = marked.filter("not __tdk_maybe").drop("__tdk_maybe")
    unclear = marked.filter("__tdk_maybe").drop("__tdk_maybe")
    return clear.unionByName(unclear.join(gone, F.col(key) == F.col("__tdk_gone"), "left_anti"))


def written(df: DataFrame, name: str) -> DataFrame:
    """A lineage cut that survives lost executors: a table in the shared folder, read back."""
    from tunedata.session import scratch_path

    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
