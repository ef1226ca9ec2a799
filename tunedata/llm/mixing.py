"""Mixing sources to target weights: fixed-length blocks, drawn per output shard and joined by index."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tunedata.llm.common import collapse_blanks, materialize, text_of

WEIGHTS = (5.0, 2.0, 1.0)
BLOCK_WORDS = 256
SHARD_SLOTS = 1024
#: No source is repeated more often than this.
MAX_EPOCHS = 3


def word_count(text: Column) -> Column:
    """Number of runs of non-blank characters."""
    t = F.trim(collapse_blanks(text))
    return F.when(t == "", 0).otherwise(F.octet_length(t) - F.octet_length(F.replace(t, F.lit(" "), F.lit(""))) + 1).cast("bigint")


def source_targets(sized: DataFrame, weights: Sequence[float] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``(src, source, source_size, target)``: one row per source. Sources in code-point order, null
    last, weigh ``weights`` in turn and share the total size; a target stops at ``max_epochs``
    times its source and the excess is reshared by weight until no target is above.

    Sorted by (cap / weight), the capped sources come first; the level of the others follows from
    running sums. The one-task window here sees one row per source, counts being pre-aggregated."""
    totals = sized.groupBy("src", "source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    n = len(weights)
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.row_number().over(by_name) - 1) % n + 1)
    t = totals.withColumn("w", w).withColumn("cap", F.col("source_size") * max_epochs)
    order = Window.orderBy(F.col("cap") / F.col("w"), "src")
    below = order.rowsBetween(Window.unboundedPreceding, -1)
    rest = order.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    t = (t.withColumn("total", F.sum("source_size").over(everything))
         .withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(below), F.lit(0))) / F.sum("w").over(rest))
         # The first source that its own level leaves below its cap sets the level for all.
         .withColumn("free", F.when(F.col("level") * F.col("w") <= F.col("cap"), F.row_number().over(order)))
         .withColumn("level", F.min_by("level", "free").over(everything)))
    return t.select("src", "source", "source_size",
                    F.least(F.col("cap").cast("double"), F.col("level") * F.col("w")).alias("target"))


def permuted(index: np.ndarray, size: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """The place of each index in the pseudorandom permutation of ``0..size-1`` that ``seed`` names:
    an invertible mix of the smallest power of two, walked on until it falls below ``size``."""
    bits = np.maximum(np.ceil(np.log2(np.maximum(size, 2))).astype(np.uint64), np.uint64(1))
    mask = (np.uint64(1) << bits) - np.uint64(1)
    half = (bits + np.uint64(1)) // np.uint64(2)
    x, todo = index.astype(np.uint64), np.arange(len(index))
    limit = size.astype(np.uint64)
    while len(todo):
        y, m, h, s = x[todo], mask[todo], half[todo], seed[todo].astype(np.uint64)
        for r in range(4):
            key = (s + np.uint64((r + 1) * 0x9E3779B97F4A7C15 % 2**64)) * np.uint64(0xBF58476D1CE4E5B9)
            y = (y * ((key >> np.uint64(20)) | np.uint64(1)) + (key >> np.uint64(7))) & m
            y ^= y >> h
        x[todo] = y
        todo = todo[y >= limit[todo]]
    return x.astype(np.int64)


def _permuted(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for index, size, seed in parts:
        yield pd.Series(permuted(index.to_numpy(np.int64), size.to_numpy(np.int64), seed.to_numpy(np.int64)))


def draw_slots(targets: DataFrame, block_words: int, shard_slots: int, seed: int) -> DataFrame:
    """``(src, shard, k, block, words)``: the k-th slot of a source lies in ``shard`` and takes the
    first ``words`` words of ``block``.

    Source counts per shard are a multinomial draw given the sources' totals, taken systematically:
    a source's running count over the shards is its share, rounded at an offset drawn per source.
    Each pass over a source is a permutation of its blocks, the last pass stops at the target."""
    t = (targets.filter("source_size > 0")
         .withColumn("want", F.round("target").cast("bigint"))
         .withColumn("blocks", F.ceil(F.col("source_size") / block_words).cast("bigint"))
         .withColumn("short", F.col("blocks") * block_words - F.col("source_size"))
         .withColumn("full", F.expr("want div source_size"))
         .withColumn("rest", F.expr("want % source_size"))
         .withColumn("slots", F.col("full") * F.col("blocks")
                     + F.least(F.col("blocks"), F.expr(f"(rest + short + {block_words - 1}) div {block_words}")))
         .withColumn("shards", F.greatest(F.lit(1), F.ceil(F.sum("slots").over(Window.partitionBy()) / shard_slots)).cast("bigint"))
         .withColumn("offset", F.pmod(F.xxhash64("src", F.lit(seed)), F.lit(1 << 20)) / float(1 << 20)))

    parts = max(1, int(targets.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def upto(j: str) -> Column:
        return F.least(F.col("slots"), F.floor(F.col("slots") * F.expr(j) / F.col("shards") + F.col("offset"))).cast("bigint")

    drawn = (t.withColumn("shard", F.explode(F.expr("sequence(0L, shards - 1)")))
             .withColumn("lo", F.when(F.col("shard") == 0, 0).otherwise(upto("shard")))
             .withColumn("hi", F.when(F.col("shard") == F.col("shards") - 1, F.col("slots")).otherwise(upto("shard + 1")))
             .filter("hi > lo").repartition(parts, "src", "shard"))  # sources are few, slots many
    slots = (drawn.withColumn("k", F.explode(F.expr("sequence(lo, hi - 1)")))
             .withColumn("pass", F.expr("k div blocks")).withColumn("at", F.expr("k % blocks"))
             .withColumn("block", F.pandas_udf(_permuted, "bigint")("at", "blocks", F.xxhash64("src", "pass", F.lit(seed)))))
    slots = materialize(slots.select("src", "shard", "k", "pass", "at", "block", "blocks", "short", "full", "rest"), "slots")
    # In the last pass the words before a slot depend on whether the short block came before it.
    cut = (slots.filter("pass = full and block = blocks - 1").select("src", F.col("at").alias("cut_at")))
    before = F.col("at") * block_words - F.when(F.col("cut_at") < F.col("at"), F.col("short")).otherwise(0)
    length = F.lit(block_words) - F.when(F.col("block") == F.col("blocks") - 1, F.col("short")).otherwise(0)
    words = F.when(F.col("pass") < F.col("full"), length).otherwise(
        F.greatest(F.lit(0), F.least(length, F.col("rest") - before)))
    return (slots.join(cut, "src", "left").select("src", "shard", "k", "block", words.cast("bigint").alias("words"))
            .filter("words > 0"))


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, block_words: int = BLOCK_WORDS,
        shard_slots: int = SHARD_SLOTS, seed: int = 7, max_epochs: int = MAX_EPOCHS, id_col: str = "doc_id",
        text_col: str = "text", source_col: str = "source") -> tuple[DataFrame, DataFrame]:
    """``(taken, pieces)``. ``taken``: one row per document, ``id, size, source, source_size, target,
    taken``. ``pieces``: the mix itself, ``shard, k, source, block, id, start, words``: the k-th slot
    of a source takes ``words`` words of a document from its word ``start`` on.

    A source's documents are laid end to end (in hash order of their ids) and cut into blocks. The
    running word counts come in two steps: inside each of about sqrt(rows) buckets of a source, and
    over the buckets' sums, so that a source holding a third of all rows is no task of its own.

    Defined cases: null or blank texts have size 0 and are taken 0 times; a null source is a source
    of its own, ordered last; rows that repeat an id are documents of their own; an empty table or
    one without words gives no pieces and targets of 0; other columns are ignored. Reruns agree,
    the result depends on the rows and the seed alone."""
    sized = materialize(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"),
                                    word_count(text_of(text_col)).alias("size"))
                        .withColumn("src", F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("-"))), "sized")
    buckets = 1 << max(0, math.ceil(math.log2(max(1, sized.count())) / 2))
    targets = materialize(source_targets(sized, weights, max_epochs), "targets")
    slots = draw_slots(targets, block_words, shard_slots, seed)

    rows = sized.withColumn("bucket", F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(buckets)))
    inside = Window.partitionBy("src", "bucket").orderBy("id", "size").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("src", "bucket").agg(F.sum("size").alias("n"))
    over = Window.partitionBy("src").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("src", "bucket", F.coalesce(F.sum("n").over(over), F.lit(0)).alias("base"))
    placed = (rows.withColumn("begin", F.coalesce(F.sum("size").over(inside), F.lit(0)))
              .join(sums, ["src", "bucket"]).withColumn("begin", F.col("begin") + F.col("base")).drop("base", "bucket"))
    placed = materialize(placed, "placed")
    cut = (placed.filter("size > 0")
           .withColumn("block", F.explode(F.expr(f"sequence(begin div {block_words}, (begin + size - 1) div {block_words})")))
           .withColumn("start", F.greatest(F.lit(0), F.col("block") * block_words - F.col("begin")))
           .withColumn("into", F.col("begin") + F.col("start") - F.col("block") * block_words)
           .withColumn("len", F.least(F.col("size") - F.col("start"), F.lit(block_words) - F.col("into"))))
    pieces = (cut.join(slots.withColumnRenamed("words", "room"), ["src", "block"])
              .withColumn("words", F.least(F.col("len"), F.col("room") - F.col("into"))).filter("words > 0")
              .select("shard", "k", "source", "block", "src", "id", "begin", "start", "words"))
    got = pieces.groupBy("src", "id", "begin").agg(F.sum("words").alias("taken"))
    rows = placed.join(got.select(F.col("src").alias("_s"), F.col("id").alias("_i"), F.col("begin").alias("_b"), "taken"),
                       (F.col("src") == F.col("_s")) & F.col("id").eqNullSafe(F.col("_i")) & (F.col("begin") == F.col("_b"))
                       & (F.col("size") > 0), "left")
    taken = rows.join(targets.drop("source"), "src").select(
        "id", "size", "source", "source_size", F.coalesce("target", F.lit(0.0)).alias("target"),
        F.coalesce("taken", F.lit(0)).cast("bigint").alias("taken"))
    return taken, pieces.drop("src", "begin")
