"""Benchmark decontamination: a broadcast hash set of test n-grams against every token window.
DataFrame functions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tunedata.llm.common import ascii_lower, materialize, text_of, without_ids

#: Words: runs of digits, ASCII letters and everything beyond ASCII.
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_CASED_GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
NGRAM = 13
#: The n-gram table is broadcast up to this many bytes, and joined by a shuffle beyond.
BROADCAST_BYTES = 64 << 20
#: Hash that every document has once, so that documents without a hit come out of the join too.
_ALWAYS = 0


def words_of(text: Column) -> Column:
    return F.filter(F.split(ascii_lower(text_of(text)), _GAP), lambda w: w != "")


def _window_hashes(hashes: str, count: str, length: int) -> Column:
    """Hashes of all windows of ``length`` words, from the words' hashes."""
    def one(i: Column) -> Column:
        return F.xxhash64(F.lit(length), *[F.get(F.col(hashes), i + j) for j in range(length)])

    return F.when(F.col(count) >= length, F.transform(F.sequence(F.lit(0), F.col(count) - length), one)).otherwise(
        F.array().cast("array<bigint>"))


def test_ngrams(benchmark: DataFrame, n: int = NGRAM) -> DataFrame:
    """``(gram, length, gram_words, item_id)``: every window of ``n`` words of every item; an item
    of fewer words, but not none, is one window."""
    items = (benchmark.select("item_id", words_of(F.col("text")).alias("w")).filter("size(w) > 0")
             .withColumn("length", F.least(F.lit(n), F.size("w"))))
    grams = items.select("item_id", "length", F.explode(F.transform(
        F.sequence(F.lit(1), F.size("w") - F.col("length") + 1),
        lambda i: F.slice("w", i, F.col("length")))).alias("gram_words")).distinct()
    hashed = reduce(lambda otherwise, k: F.when(F.col("length") == k, F.xxhash64(
        F.lit(k), *[F.xxhash64(F.get("gram_words", F.lit(j))) for j in range(k)])).otherwise(otherwise),
        range(1, n + 1), F.lit(None).cast("bigint"))
    return grams.select(hashed.alias("gram"), "length", "gram_words", "item_id")


def contamination_hits(docs: DataFrame, benchmark: DataFrame, n: int = NGRAM, id_col: str = "doc_id",
                       text_col: str = "text", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """One row per document: ``id, text_key, n_words, n_hit, hit_words, items``.

    ``hit_words`` are the 0-based positions of words inside an occurrence of a window, ``items``
    the sorted ids (as strings) of items with an occurring window. Every window of every document
    is hashed from its words' hashes and looked up; hits are verified on the words themselves.
    The gram table is broadcast when its measured size is within ``broadcast_bytes``; a larger one
    is joined by a shuffle on the hash.

    Defined cases: a null text has no words; an item without words never hits; null item ids are
    left out of ``items`` but their windows hit; rows that repeat both id and text come out as often as they
    came in, rows that repeat only the id are rows of their own (``text_key``); texts of any length are read
    whole; empty tables give no hits or no rows; other columns are ignored."""
    hits = _distinct_hits(docs, benchmark, n, id_col, text_col, broadcast_bytes)
    return hits.withColumn("copies", F.explode(F.sequence(F.lit(1).cast("bigint"), "copies"))).drop("copies")


def _distinct_hits(docs: DataFrame, benchmark: DataFrame, n: int, id_col: str, text_col: str, broadcast_bytes: int) -> DataFrame:
    """One row per id and text, with ``copies``, how many rows have both."""
    grams = materialize(test_ngrams(benchmark, n), "test-ngrams")
    size = grams.agg(F.sum(F.size("gram_words") * 16 + F.octet_length(F.concat_ws("", "gram_words"))).alias("b"),
                     F.sort_array(F.collect_set("length")).alias("l")).first()  # n lengths at most
    lengths = list(size["l"] or [])
    always = grams.sparkSession.range(1).select(
        F.lit(_ALWAYS).cast("bigint").alias("gram"), F.lit(0).alias("length"),
        F.array().cast("array<string>").alias("gram_words"), F.lit(None).cast(benchmark.schema["item_id"].dataType).alias("item_id"))
    grams = grams.unionByName(always)
    grams = F.broadcast(grams) if (size["b"] or 0) <= broadcast_bytes else grams

    rows = (docs.select(F.col(id_col).alias("id"), F.xxhash64(text_of(text_col)).alias("text_key"),
                        words_of(F.col(text_col)).alias("w"))
            .withColumn("n_words", F.size("w"))
            .withColumn("h", F.transform("w", lambda x: F.xxhash64(x))))
    windows = [F.array(F.lit(_ALWAYS).cast("bigint")), *[_window_hashes("h", "n_words", k) for k in lengths]]
    rows = rows.select("id", "text_key", "n_words", "w", F.posexplode(F.concat(*windows)).alias("at", "window"))
    # The windows of each length follow one another, after the one that is always there.
    begins, start = {}, F.lit(1)
    for k in lengths:
        begins[k] = start
        start = start + F.greatest(F.lit(0), F.col("n_words") - (k - 1))
    begin = reduce(lambda o, k: F.when(F.col("length") == k, begins[k]).otherwise(o), lengths, F.lit(0))
    hits = (rows.join(grams, rows["window"] == grams["gram"])
            .withColumn("pos", F.col("at") - begin)
            .filter((F.col("length") == 0) & (F.col("at") == 0) | (F.col("length") > 0) & (F.col("pos") >= 0)
                    & (F.slice("w", F.greatest(F.col("pos"), F.lit(0)) + 1, F.col("length")) == F.col("gram_words"))))
    # All hits of a document come from one task: its lists are no longer than its own words ask.
    found = (hits.groupBy("id", "text_key", "n_words")
             .agg(F.count_if(F.col("length") == 0).alias("copies"),  # each row has one such window
                  F.collect_set(F.when(F.col("length") > 0, F.struct("pos", "length"))).alias("at"),
                  F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items")))
    covered = F.array_sort(F.array_distinct(F.flatten(F.transform(
        "at", lambda x: F.sequence(x["pos"], x["pos"] + x["length"] - 1)))))
    return found.select("id", "text_key", "copies", F.col("n_words").cast("bigint").alias("n_words"),
                        covered.alias("hit_words"), "items").withColumn("n_hit", F.size("hit_words").cast("bigint"))


#: A document is contaminated when at least this share of its words is hit (and one word at least).
MIN_SHARE = 20


def is_contaminated() -> Column:
    return (F.col("n_hit") > 0) & (F.col("n_hit") * MIN_SHARE >= F.col("n_words"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = NGRAM, mode: str = "documents",
                  id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``mode="documents"``: ``docs``, all columns, without the contaminated documents.
    ``mode="spans"``: every document, the hit words (each with the gap behind it) cut from its
    text. Clean documents stay as they are; a row with a null id is never removed."""
    hits = contamination_hits(docs, benchmark, n, id_col, text_col)
    if mode == "documents":
        gone = materialize(hits.filter(is_contaminated()).select(F.col("id").alias(id_col)), "contaminated")
        return without_ids(docs, gone, id_col)
    if mode != "spans":
        raise ValueError(f"mode must be documents or spans, not {mode!r}")
    cut = hits.filter("n_hit > 0").dropDuplicates(["id", "text_key"]).select(F.col("id").alias("__tdk_id"), F.col("text_key").alias("__tdk_key"), F.col("hit_words").alias("__tdk_hit"))
    joined = docs.join(cut, docs[id_col].eqNullSafe(cut["__tdk_id"]) & (F.xxhash64(text_of(docs[text_col])) == cut["__tdk_key"]), "left")
    # A piece is a word and the gap behind it; a leading gap stands alone in front.
    lead = F.regexp_extract(text_of(docs[text_col]), f"^{_CASED_GAP}*", 0)
    pieces = F.regexp_extract_all(text_of(docs[text_col]), F.lit(f"[^{_CASED_GAP[1:-1]}]+{_CASED_GAP}*"), F.lit(0))
    left = F.concat(lead, F.concat_ws("", F.filter(pieces, lambda p, i: ~F.array_contains("__tdk_hit", i))))
    return joined.select(*[F.when(F.col("__tdk_hit").isNull(), docs[c]).otherwise(left).alias(c) if c == text_col
                           else docs[c] for c in docs.columns])
