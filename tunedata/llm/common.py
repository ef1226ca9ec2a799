"""Small helpers that several operators share. Helper columns beside a caller's own begin with __tdk."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tunedata.session import scratch_path

#: White space of the text contracts: space and the five ASCII control blanks.
BLANKS = r"[\x20\x09-\x0D]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def text_of(col: str | Column) -> Column:
    """The text, null counting as empty."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z only. ``lower`` has a fast path for pure ASCII, where it means the same."""
    return F.when(F.octet_length(col) == F.char_length(col), F.lower(col)).otherwise(
        F.translate(col, _UPPER, _UPPER.lower()))


def collapse_blanks(col: Column) -> Column:
    return F.regexp_replace(col, BLANKS, " ")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared checkpoint folder and read it back: a lineage cut that
    survives lost executors. The folder is the one the cluster names in spark.checkpoint.dir."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Words of 64 bits in a key filter. A filter has at most this many rows, whatever the key count.
FILTER_WORDS = 1 << 18


def key_filter(keys: DataFrame, hashed: Column, words: int = FILTER_WORDS) -> DataFrame:
    """A one-hash Bloom filter of ``hashed`` (bigint) as a table ``(__tdk_word, __tdk_bits)`` of at most
    ``words`` rows (16 bytes each), so that its broadcast is bounded whatever the number of keys.
    A fuller filter lets more rows through to the exact join behind it; it never loses one."""
    h = keys.select(hashed.alias("__tdk_h"))
    return (h.select(F.shiftrightunsigned("__tdk_h", 6).bitwiseAND(F.lit(words - 1)).alias("__tdk_word"),
                     F.expr("shiftleft(1L, cast(__tdk_h & 63 as int))").alias("__tdk_bit"))
            .groupBy("__tdk_word").agg(F.bit_or("__tdk_bit").alias("__tdk_bits")))


def mark_maybe(df: DataFrame, hashed: Column, bits: DataFrame, flag: str, words: int = FILTER_WORDS) -> DataFrame:
    """Add boolean ``flag``: false only where ``hashed`` is certainly not among the filter's keys."""
    return (df.withColumn("__tdk_h", hashed)
            .withColumn("__tdk_word", F.shiftrightunsigned("__tdk_h", 6).bitwiseAND(F.lit(words - 1)))
            .join(F.broadcast(bits), "__tdk_word", "left")
            .withColumn(flag, F.expr("coalesce(shiftrightunsigned(__tdk_bits, cast(__tdk_h & 63 as int)) & 1, 0) = 1"))
            .drop("__tdk_h", "__tdk_word", "__tdk_bits"))


def filter_words(bits: DataFrame, words: int = FILTER_WORDS) -> np.ndarray:
    """A key filter as an array of ``words`` words, for tasks in Python."""
    rows = bits.toArrow()
    found = np.zeros(words, np.int64)
    found[rows.column("__tdk_word").to_numpy()] = rows.column("__tdk_bits").to_numpy()
    return found.view(np.uint64)


def maybe_keys(hashed: np.ndarray, found: np.ndarray) -> np.ndarray:
    """What ``mark_maybe`` says of ``hashed`` (int64), by ``filter_words``."""
    h = hashed.view(np.uint64)
    return (found[(h >> np.uint64(6)) & np.uint64(len(found) - 1)] >> (h & np.uint64(63))) & np.uint64(1) == 1


def without_ids(docs: DataFrame, ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``docs`` less the rows whose id is in ``ids`` (a materialized one-column table). Only rows
    that pass the bounded key filter are shuffled for the exact anti-join; the others, text
    included, go straight through. A null id is never matched, so its row stays."""
    ids = ids.select(F.col(id_col).alias("__tdk_gone")).filter("__tdk_gone is not null").distinct()
    bits = key_filter(ids, F.xxhash64("__tdk_gone"))
    marked = mark_maybe(docs, F.xxhash64(id_col), bits, "__tdk_maybe")
    clear = marked.filter("not __tdk_maybe").drop("__tdk_maybe")
    unclear = (marked.filter("__tdk_maybe").drop("__tdk_maybe")
               .join(ids.hint("shuffle_hash"), F.col(id_col) == F.col("__tdk_gone"), "left_anti"))
    return clear.unionByName(unclear)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
