"""Token, n-gram and hashing expressions over whole texts (built-in functions only)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tunedata.functions.strings import col_, spaces_for_whitespace


def whitespace_tokens(c: str | Column) -> Column:
    """``s.split()``: split on runs of whitespace, no empty tokens; '' -> [].

    Whitespace is mapped to spaces with ``translate`` and split on a single space (no regex
    engine); the empty pieces between adjacent separators are filtered out."""
    return F.filter(F.split(spaces_for_whitespace(c), " "), lambda t: t != "")


def whitespace_token_count(c: str | Column) -> Column:
    """``len(s.split())`` as a bigint."""
    return F.size(whitespace_tokens(c)).cast("bigint")


def norm_words(c: str | Column) -> Column:
    """Lower-cased alphanumeric words: runs of anything else are separators."""
    # Runs of separators become one space; the empty pieces at either end go, so that the text is read once.
    return F.filter(F.split(F.regexp_replace(F.lower(col_(c)), r"[^\p{L}\p{N}]+", " "), " "), lambda w: w != "")


def space_words(c: str | Column) -> Column:
    """``lower(text)`` split on single spaces (the shingling tokenizer)."""
    return F.split(F.lower(col_(c)), " ")


def shingle_hashes(words: Column, k: int) -> Column:
    """Distinct 64-bit hashes of the k-word shingles of a word array. Pass a *column reference* to
    an array projected earlier, so the split runs once per row rather than once per window; the
    de-duplication runs on longs (hash-set path) rather than on strings."""
    last_start = F.size(words) - F.lit(k)
    starts = F.when(last_start >= 0, F.sequence(F.lit(0), last_start)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(k)])))


def md5_bucket(key: Column, seed: int | str, buckets: int = 10000) -> Column:
    """Reproducible bucket in [0, buckets): first 8 hex digits of md5(seed ':' key) mod buckets."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))
    return (F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") % F.lit(buckets)).cast("bigint")
