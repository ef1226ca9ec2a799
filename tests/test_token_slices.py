"""A counter sees bounded slices of a batch, however many rows or bytes that holds."""

import pyarrow as pa
from pyspark.sql import functions as F

from tunedata.operators import ext


def test_slices():
    texts = ["a" * 10, None, "é" * 10, "", "b" * 100, "c", "d"]
    parts = [p.to_pylist() for p in ext.text_slices(pa.array(texts, pa.string()).slice(0), 30)]
    assert [t for p in parts for t in p] == texts
    assert parts == [["a" * 10, None, "é" * 10, ""], ["b" * 100], ["c", "d"]]
    assert list(ext.text_slices(pa.array([], pa.string()))) == []


def test_counter_sees_slices(spark):
    """2,000 texts of 10,000 bytes in one batch: no call gets all 20 MB of it. The counter tells what it got."""
    docs = spark.range(2000, numPartitions=1).select("id", F.repeat(F.lit("word "), 2000).alias("text"))
    got = docs.select(ext.token_counter(lambda s: s.str.len() * 0 + len(s))("text").alias("n")).agg(F.max("n")).first()[0]
    assert got <= 200
    rows = spark.createDataFrame([(" a b\t c ",), ("",), (None,), ("x",)], "text string")
    assert [r["n"] for r in rows.select(ext.token_counter(ext.whitespace_counter)("text").alias("n")).collect()] == [3, 0, 0, 1]
