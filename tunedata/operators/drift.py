"""Types per path of JSON columns, by VARIANT: rows whose key sets agree may still differ in types."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tunedata.operators.keyfilter import written

ROOT = "$"
MALFORMED = "malformed"


def kind(v: Column) -> Column:
    """object, array, string, number, boolean or null; other variant types by their own name."""
    s = F.schema_of_variant(v)
    return (F.when(s.startswith("OBJECT"), "object").when(s.startswith("ARRAY"), "array").when(s == "VOID", "null")
            .when(s.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), "number").otherwise(F.lower(s)))


def path_types(df: DataFrame, json_col: str) -> DataFrame:
    """``path, type, n_values`` over all rows and all depths: fields as ``$.a.b``, elements of an array as ``[]``.

    One level is one pass with a map-side combined count; the next level runs only where this one found
    objects or arrays, so a column nested d deep is read d times and no value is ever shuffled.
    Text that is no JSON counts at the root as ``malformed``; null rows count nowhere."""
    spark = df.sparkSession
    text = F.col(json_col)
    level = df.where(text.isNotNull()).select(F.lit(ROOT).alias("path"), F.try_parse_json(text).alias("v"))
    counts = []
    while True:
        typed = level.select("path", F.coalesce(kind(F.col("v")), F.lit(MALFORMED)).alias("type"))
        counts.append(written(typed.groupBy("path", "type").agg(F.count(F.lit(1)).alias("n_values")), "path-types"))
        if counts[-1].where("type IN ('object', 'array')").isEmpty():
            return reduce(DataFrame.unionByName, counts)
        level = spark.sql("SELECT concat(path, coalesce('.' || e.key, '[]')) AS path, e.value AS v FROM {level}, LATERAL variant_explode(v) AS e",
                          level=level)


def schema_drift(df: DataFrame, json_col: str) -> DataFrame:
    """``path, types, n_values, n_missing, drift``: a path drifts where it has values of more than one type,
    nulls aside. ``n_missing`` is how many objects at the path above lack the field. The tables joined
    have one row per path."""
    found = written(path_types(df, json_col), "paths")
    per_path = found.groupBy("path").agg(F.array_join(F.array_sort(F.collect_list("type")), ",").alias("types"), F.sum("n_values").alias("n_values"),
                                         (F.count_if(F.col("type") != "null") > 1).alias("drift"))
    parents = found.where("type = 'object'").select(F.col("path").alias("_above"), F.col("n_values").alias("_n"))
    above = F.when(~F.col("path").endswith("[]"), F.regexp_replace("path", r"\.[^.]*$", ""))
    j = per_path.join(parents, above.eqNullSafe(F.col("_above")) & (F.col("path") != ROOT), "left")
    missing = F.coalesce(F.col("_n") - F.col("n_values"), F.lit(0)).cast("bigint")
    return j.select("path", "types", "n_values", missing.alias("n_missing"), "drift")


def merged_schema(df: DataFrame, json_col: str) -> DataFrame:
    """One row: the schema that holds all rows' values (VARIANT where they disagree)."""
    return df.agg(F.schema_of_variant_agg(F.try_parse_json(F.col(json_col))).alias("schema"))
