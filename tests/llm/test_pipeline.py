"""The pipeline's stages on a small table, each held to its rule by brute force."""

import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    seen = docs.count()
    for k, (name, stage) in enumerate(p.STAGES):
        out = stage(spark, docs, SF)
        if k < len(p.STAGES) - 1:
            assert out.columns == columns, name
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.count() <= seen
        seen = docs.count()
    # The mix keeps to its targets and to three times each document.
    rows = docs.groupBy("source").agg(F.sum("taken").alias("t"), F.max("target").alias("want"), F.sum("size").alias("n"),
                                      F.max("source_size").alias("m")).collect()
    assert all(abs(r["t"] - r["want"]) <= 1 and r["n"] == r["m"] for r in rows)
    assert docs.filter("taken > 3 * size").count() == 0
    exact = spark.read.parquet(str(tmp_path / "exact_dedup"))
    assert exact.count() == exact.select(F.regexp_replace("text", r"[\x20\x09-\x0D]+", " ")).distinct().count()
    again = spark.read.parquet(str(tmp_path / "mixing"))
    assert p.run(spark, SF).exceptAll(again).count() == 0


def test_every_query_is_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert "pipeline" in names
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))


def test_entry_without_the_operators(monkeypatch):
    import builtins

    import __spark_entry__ as entry
    real = builtins.__import__

    def missing(name, globals=None, locals=None, fromlist=(), level=0):
        if name.startswith(("tunedata.llm", "corpus_pipeline")):
            raise ImportError(name)
        return real(name, globals, locals, fromlist, level)

    monkeypatch.setattr(builtins, "__import__", missing)
    assert entry._training_data() == ({}, {})
    assert len(entry.queries()) > 100 and not any(n.startswith("op") and n[2:3].isdigit() for n in entry.queries())


if __name__ == "__main__":
    pytest.main([__file__])
