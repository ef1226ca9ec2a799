"""The corpus pipeline: quality, exact copies, near copies, contamination, mixing.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is written as Parquet and read
again as the next stage's ``docs``. All but the last return the columns of their input; the last adds
how the mix uses each document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tunedata.llm.common import materialize, table
from tunedata.llm.decontaminate import decontaminate
from tunedata.llm.exact_dedup import drop_exact_copies
from tunedata.llm.minhash_dedup import drop_near_copies
from tunedata.llm.mixing import mix
from tunedata.llm.site_quality import drop_low_quality


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. Learns from the labels of the documents given."""
    return drop_low_quality(docs, table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the smallest id stays."""
    return drop_exact_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (four fifths of all five-word shingles in common, or
    more) stays, the one with the smallest id."""
    return drop_near_copies(docs, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which benchmark passages are a twentieth or more go."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, source, size, source_size, target, taken``: how many words the mix takes of each
    document (repeats counted)."""
    taken, _ = mix(docs)
    return taken.select(F.col("id").alias("doc_id"), "source", "size", "source_size", "target", "taken")


STAGES = [("quality", quality), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup),
          ("decontamination", decontamination), ("mixing", mixing)]

#: Classifier, near copies and permutations are beyond SQL; tests/llm holds them to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each written to the shared checkpoint folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
