"""Registry of named queries: each is ``(spark, sf_dir) -> DataFrame`` plus an optional DuckDB
oracle statement over the same parquet tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    oracle: str | None


REGISTRY: dict[str, Query] = {}


def query(name: str, oracle: str | None = None):
    def deco(fn: Callable[[SparkSession, str], DataFrame]):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Query(name, fn, oracle)
        return fn

    return deco


def load_all() -> dict[str, Query]:
    # Importing the plan modules registers their queries.
    from tunedata.plans import (  # noqa: F401
        catalog_plans,
        dedup_plans,
        eval_plans,
        ext_plans,
        format_plans,
        quality_plans,
        run_plans,
        source_plans,
        split_plans,
        stream_plans,
        sweep_plans,
    )

    return REGISTRY
