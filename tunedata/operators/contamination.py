"""Benchmark contamination (D17): training rows that contain a benchmark passage verbatim.

Candidates are exact with respect to the final ``contains`` test. If a document contains a passage, it
contains every word n-gram of the passage's *interior* (the words after the first and before the
last, which the document's own word boundaries cannot cut), so one of them per passage is enough
to find it: its anchor. A passage of one or two words has no interior; its anchor is its first few
characters. Documents' windows are hashed and joined to the anchors, and every candidate
is verified with ``contains``; only texts of candidate documents take part in that.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tunedata.functions.text import norm_words
from tunedata.operators.keyfilter import key_filter, rows_with, rows_without, written

DEFAULT_N = 13
#: Characters of the anchor of a passage without interior words.
CHARS = 8
#: Longs of the bitmap of the anchors' first units.
FIRST_WORDS = 1 << 12


def passage_anchors(bench: DataFrame, id_col: str, text_col: str, n: int = DEFAULT_N) -> DataFrame:
    """``item_id, unit, k, first, h``: one anchor per passage, ``unit`` word or char, of ``k`` units, the hash of its
    first unit and of all. It begins at the passage's longest word, which few places of a corpus
    have in common. Null and empty passages have none and are never found."""
    w = (bench.where(F.length(text_col) > 0).select(F.col(id_col).alias("item_id"), F.col(text_col).alias("t"), norm_words(text_col).alias("w"))
         .withColumn("inner", F.slice("w", 2, F.greatest(F.size("w") - 2, F.lit(0)))))
    word = w.where("size(inner) > 0").withColumn("unit", F.lit("word")).withColumn("k", F.least(F.lit(n), F.size("inner")))
    char = (w.where("size(inner) = 0").withColumn("inner", F.split("t", "")).withColumn("unit", F.lit("char"))
            .withColumn("k", F.least(F.lit(CHARS), F.size("inner"))))
    both = word.unionByName(char)
    starts = F.transform(F.slice("inner", F.lit(1), F.size("inner") - F.col("k") + 1), lambda x: F.length(x))
    both = both.withColumn("at", F.array_position(starts, F.array_max(starts)).cast("int"))
    both = both.withColumn("part", F.transform(F.slice("inner", F.col("at"), F.col("k")), lambda x: F.xxhash64(x)))
    return both.select("item_id", "unit", "k", F.get("part", F.lit(0)).alias("first"), _run_hash(F.col("part")).alias("h"))


def _run_hash(units: Column) -> Column:
    """Hash of a run of unit hashes, of any length."""
    return F.aggregate(units, F.lit(0).cast("bigint"), lambda h, x: F.xxhash64(h, x))


def _is_first(anchors: DataFrame, unit: str, k: int) -> Callable[[Column], Column]:
    """A test of a unit's hash against the first units of the anchors: a bitmap of at most ``FIRST_WORDS`` longs
    that goes into the plan as a constant. It lets a few others through and never loses one."""
    firsts = anchors.where((F.col("unit") == unit) & (F.col("k") == k))
    longs = [0] * FIRST_WORDS
    for r in key_filter(firsts, F.col("first"), FIRST_WORDS).collect():
        longs[r["__tdk_word"]] = r["__tdk_bits"]
    bits = F.split(F.lit(",".join(map(str, longs))), ",").cast("array<bigint>")

    def test(h: Column) -> Column:
        word = F.get(bits, F.shiftrightunsigned(h, 6).bitwiseAND(F.lit(FIRST_WORDS - 1)).cast("int"))
        return F.getbit(word, h.bitwiseAND(F.lit(63)).cast("int")) == 1

    return test


def contaminated_pairs(docs: DataFrame, bench: DataFrame, doc_id: str = "doc_id", doc_text: str = "text",
                       item_id: str = "item_id", item_text: str = "text", n: int = DEFAULT_N) -> DataFrame:
    """``doc_id, item_id`` for every document containing a passage verbatim. One pass over the texts: each
    unit is hashed once, only places that may begin an anchor are hashed in full, and only those are rows."""
    # Written, so that its measured size decides whether it is broadcast.
    anchors = written(passage_anchors(bench, item_id, item_text, n), "anchors")
    kinds = sorted((r["unit"], r["k"]) for r in anchors.select("unit", "k").distinct().collect())  # n + CHARS at most
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(doc_text).alias("_text"))
    if not kinds:
        return texts.join(anchors.select("item_id"), F.lit(False)).select("doc_id", "item_id")
    units = {"word": norm_words("_text"), "char": F.split("_text", "")}
    parts = texts.select("doc_id", *[F.transform(units[u], lambda x: F.xxhash64(x)).alias(u) for u in sorted({u for u, _ in kinds})])
    places = [_anchored(unit, k, _is_first(anchors, unit, k)) for unit, k in kinds]
    grams = parts.select("doc_id", F.inline(F.concat(*places)))
    cands = written(grams.join(anchors.drop("first"), ["unit", "k", "h"]).select("doc_id", "item_id").distinct(), "candidates")
    passages = bench.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("_passage"))
    checked = (rows_with(texts, cands.select("doc_id").distinct(), "doc_id").join(cands, "doc_id").join(passages, "item_id")
               .where(F.col("_text").contains(F.col("_passage"))))
    return checked.select("doc_id", "item_id")


def _anchored(unit: str, k: int, is_first: Callable[[Column], Column]) -> Column:
    """``unit, k, h`` of the windows of ``k`` units whose first unit begins an anchor."""
    last_start = F.size(unit) - F.lit(k)
    starts = F.when(last_start >= 0, F.sequence(F.lit(0), last_start)).otherwise(F.array().cast("array<int>"))
    found = F.filter(starts, lambda i: is_first(F.get(F.col(unit), i)))
    return F.coalesce(F.transform(found, lambda i: F.struct(F.lit(unit).alias("unit"), F.lit(k).alias("k"), _run_hash(
        F.slice(unit, i + 1, F.lit(k))).alias("h"))), F.array().cast("array<struct<unit:string,k:int,h:bigint>>"))


def decontaminate(docs: DataFrame, pairs: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    gone = written(pairs.select(F.col("doc_id").alias(doc_id)).distinct(), "contaminated")
    return rows_without(docs, gone, doc_id)
