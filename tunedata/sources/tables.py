"""Access to the provided parquet tables of one scale-factor directory."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

TABLE_NAMES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
               "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


class Tables:
    """Lazy handles on ``{sf_dir}/{name}.parquet``; each attribute is a plain parquet scan, so
    Catalyst prunes columns and pushes filters into the reader of every query built on it."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def table(self, name: str) -> DataFrame:
        if name not in TABLE_NAMES:
            raise KeyError(name)
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLE_NAMES:
            return self.table(name)
        raise AttributeError(name)

    @cached_property
    def all(self) -> dict[str, DataFrame]:
        return {n: self.table(n) for n in TABLE_NAMES}
