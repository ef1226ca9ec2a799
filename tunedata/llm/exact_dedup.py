"""Exact dedup by progressive refinement: length, then prefix hash, then full hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tunedata.llm.common import collapse_blanks, key_filter, mark_maybe, materialize, text_of, without_ids

#: Characters of the normalised text that the second level hashes.
PREFIX_CHARS = 256
SALTS = 32


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 prefix_chars: int = PREFIX_CHARS, carry: dict[str, Column] | None = None) -> DataFrame:
    """One row per input row: ``id_col, keep_id, group_size, kept`` and the ``carry`` columns.

    Texts are equal when identical after every run of blanks became one space. The levels are:

    1. ``groupBy(length)``: a length that one row has is done;
    2. ``groupBy(length, hash of the first prefix_chars)``: a prefix that one row has is done;
    3. only rows of the groups left get the SHA-256 of their whole text, and are grouped on it.

    Levels 1 and 2 aggregate counts, with map-side combine, so a group holding a third of all rows
    is one row per task. The groups left reach the second scan as a key filter of bounded size;
    a row that it lets through wrongly is merely hashed and found alone. No text is shuffled.

    Defined cases: a null text equals the empty text; rows that repeat a doc_id are labelled
    alike (each counts in group_size); null ids are passed over for ``keep_id`` unless the group
    has no other, and are kept only then; an empty table gives an empty result; other columns,
    also ones named like the helper columns, are ignored."""
    norm = collapse_blanks(text_of(text_col))
    length = F.octet_length("_norm")
    prefix = F.xxhash64(F.substring("_norm", 1, prefix_chars))
    carry = carry or {}

    seen = docs.select(norm.alias("_norm")).select(length.alias("_len"), prefix.alias("_pre"))
    prefixes = seen.groupBy("_len", "_pre").agg(F.count(F.lit(1)).alias("_n"))
    lengths = prefixes.groupBy("_len").agg(F.sum("_n").alias("_n")).filter("_n > 1").select("_len")
    left = prefixes.filter("_n > 1").join(lengths, "_len", "left_semi")
    bits = key_filter(left, F.xxhash64("_len", "_pre"))

    rows = docs.select(F.col(id_col).alias("_id"), norm.alias("_norm"),
                       *[c.alias(f"_carry_{k}") for k, c in carry.items()])
    rows = mark_maybe(rows, F.xxhash64(length, prefix), bits, "_maybe")
    # Rows that are done get a key of their own, so that they spread over the join below.
    rows = materialize(rows.select(
        "_id", F.when(F.col("_maybe"), F.sha2("_norm", 256)).alias("_full"), length.alias("_len"),
        *[f"_carry_{k}" for k in carry]), "exact-dedup")
    key = F.coalesce("_full", F.concat(F.lit("#"), F.coalesce(F.col("_id").cast("string"), F.lit("null"))))
    groups = (rows.filter("_full is not null").groupBy(F.col("_full").alias("_gfull"), F.col("_len").alias("_glen"))
              .agg(F.min("_id").alias("_keep"), F.count(F.lit(1)).alias("_n")).filter("_n > 1"))
    # A group of copies is dealt over SALTS tasks; the groups, one row each, are repeated for that.
    groups = groups.withColumn("_gsalt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = rows.withColumn("_key", key).withColumn("_salt", F.pmod(F.xxhash64("_id"), F.lit(SALTS)).cast("int"))
    joined = rows.join(groups, (rows["_key"] == groups["_gfull"]) & (rows["_len"] == groups["_glen"])
                       & (rows["_salt"] == groups["_gsalt"]), "left")
    keep = F.when(F.col("_n").isNull(), F.col("_id")).otherwise(F.col("_keep"))
    return joined.select(F.col("_id").alias(id_col), keep.alias("keep_id"),
                         F.coalesce("_n", F.lit(1)).cast("bigint").alias("group_size"),
                         F.col("_id").eqNullSafe(keep).alias("kept"),
                         *[F.col(f"_carry_{k}").alias(k) for k in carry])


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input rows, all columns, without those that equal a row with a smaller id."""
    gone = materialize(exact_groups(docs, id_col, text_col).filter("not kept").select(id_col), "exact-gone")
    return without_ids(docs, gone, id_col)
