"""Schema and format inference (B family) over a column catalog.

A catalog is a DataFrame ``(dataset, ordinal, column_name)``: one row per column of each dataset
(or of each heterogeneous JSON record). Every rule is a ``CASE`` over the per-dataset column set,
so the whole catalog is classified by one aggregation, however many datasets it lists.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Candidate field orders and required sets of the reference heuristics.
TEXT_FIELD_CANDIDATES = ["text", "content", "messages", "conversations", "prompt"]
TEXT_FIELD_FALLBACK = "instruction"
EVAL_TEXT_CANDIDATES = ["text", "content", "prompt", "instruction"]
PREFERENCE_REQUIRED = ["prompt", "chosen", "rejected"]
FORMAT_RECOMMENDATIONS = {
    "chat": "Validate chat template compatibility before training.",
    "preference": "Use preference-optimization tooling rather than plain SFT.",
    "instruction": "SFT is a sensible starting point for the first run.",
    "text": "SFT is a sensible starting point for the first run.",
    "unknown": "Manually map columns before starting the first experiment.",
}


def _has(cols: Column, name: str) -> Column:
    return F.array_contains(cols, F.lit(name))


def _has_all(cols: Column, names: list[str]) -> Column:
    return F.size(F.array_except(F.array(*[F.lit(n) for n in names]), cols)) == 0


def column_sets(catalog: DataFrame) -> DataFrame:
    """``dataset, cols`` (columns in ordinal order). One shuffle on ``dataset``; the column list
    of a dataset is its schema width, not its row count."""
    return (catalog.groupBy("dataset")
            .agg(F.array_sort(F.collect_list(F.struct("ordinal", "column_name"))).alias("_c"))
            .select("dataset", F.transform("_c", lambda x: x["column_name"]).alias("cols")))


def detect_format(cols: Column) -> Column:
    """chat | preference | instruction | text | unknown -- first rule that matches wins."""
    return (F.when(_has(cols, "messages") | _has(cols, "conversations"), "chat")
            .when(_has_all(cols, ["prompt", "chosen", "rejected"])
                  | _has_all(cols, ["question", "chosen", "rejected"]), "preference")
            .when(_has_all(cols, ["instruction", "output"]) | _has_all(cols, ["prompt", "completion"]),
                  "instruction")
            .when(_has(cols, "text") | _has(cols, "content"), "text")
            .otherwise("unknown"))


def first_present(cols: Column, candidates: list[str]) -> Column:
    """First candidate (in candidate order) that is a column, else null."""
    present = F.filter(F.array(*[F.lit(c) for c in candidates]), lambda c: F.array_contains(cols, c))
    return F.get(present, 0)


def infer_text_field(cols: Column) -> Column:
    return F.coalesce(first_present(cols, TEXT_FIELD_CANDIDATES),
                      F.when(_has(cols, TEXT_FIELD_FALLBACK), F.lit(TEXT_FIELD_FALLBACK)))


def eval_text_column(cols: Column) -> Column:
    """Custom-eval text column: first of text/content/prompt/instruction, else the first column."""
    return F.coalesce(first_present(cols, EVAL_TEXT_CANDIDATES), F.get(cols, 0))


def missing_preference_columns(cols: Column, rename_question: bool = False) -> Column:
    """Required columns that a preference set lacks; with ``rename_question``, ``question`` stands in for ``prompt``."""
    if rename_question:
        cols = F.when(_has(cols, "prompt"), cols).otherwise(F.transform(cols, lambda c: F.when(c == "question", "prompt").otherwise(c)))
    return F.array_except(F.array(*[F.lit(c) for c in PREFERENCE_REQUIRED]), cols)


def route_sft_formatter(cols: Column, text_field: str | Column = "auto") -> Column:
    """Formatter the SFT loader applies: alpaca | prompt_completion | messages | reject | passthrough.

    ``text_field='auto'`` resolves through :func:`infer_text_field`, falling back to 'text'."""
    if isinstance(text_field, str):
        f = (F.coalesce(infer_text_field(cols), F.lit("text")) if text_field == "auto"
             else F.lit(text_field))
    else:
        f = text_field
    no_text = ~_has(cols, "text")
    return (F.when(_has(cols, "instruction") & f.isin("text", "instruction") & no_text, "alpaca")
            .when(_has(cols, "prompt") & (_has(cols, "completion") | _has(cols, "output")) & no_text,
                  "prompt_completion")
            .when((_has(cols, "messages") | _has(cols, "conversations")) & no_text, "messages")
            .when(_has_all(cols, PREFERENCE_REQUIRED), "reject")
            .otherwise("passthrough"))


def doc_format_variant(cols: Column) -> Column:
    """Finer names of the documentation heuristics, first match wins."""
    return (F.when(_has(cols, "conversations"), "sharegpt")
            .when(_has(cols, "messages"), "messages")
            .when(_has_all(cols, ["instruction", "output"]), "alpaca")
            .when(_has(cols, "text") & (F.size(cols) == 1), "plain_text")
            .when(_has_all(cols, ["prompt", "completion"]), "prompt_completion")
            .otherwise("unknown"))


def format_recommendation(fmt: Column) -> Column:
    expr = F.when(F.lit(False), F.lit(None))
    for k, v in FORMAT_RECOMMENDATIONS.items():
        expr = expr.when(fmt == k, F.lit(v))
    return expr


def classify_catalog(catalog: DataFrame) -> DataFrame:
    """All catalog rules for every dataset in one pass."""
    s = column_sets(catalog)
    cols = F.col("cols")
    fmt = detect_format(cols)
    return s.select(
        "dataset", "cols",
        fmt.alias("format"),
        infer_text_field(cols).alias("suggested_text_field"),
        eval_text_column(cols).alias("eval_text_column"),
        missing_preference_columns(cols).alias("missing_preference"),
        route_sft_formatter(cols).alias("formatter"),
        doc_format_variant(cols).alias("variant"),
        format_recommendation(fmt).alias("recommendation"),
    )


def catalog_of(datasets: dict[str, DataFrame]) -> DataFrame:
    """Catalog rows for DataFrames already known to the session (schema metadata only)."""
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    rows = [(name, i + 1, c) for name, df in datasets.items() for i, c in enumerate(df.columns)]
    return spark.createDataFrame(rows, "dataset string, ordinal int, column_name string")


def json_keys(c: str | Column) -> Column:
    """Top-level keys of a JSON object string, in document order."""
    return F.json_object_keys(F.col(c) if isinstance(c, str) else c)


def schema_signatures(df: DataFrame, json_col: str) -> DataFrame:
    """Rows per distinct sorted key set: more than one row means the schema drifts."""
    return (df.select(F.array_join(F.array_sort(json_keys(json_col)), ",").alias("key_signature"))
            .groupBy("key_signature").agg(F.count(F.lit(1)).alias("n_rows")))


def sample_keys(df: DataFrame, json_col: str) -> DataFrame:
    """Sorted union of keys: distinct first (partial aggregation), then a tiny global collect."""
    keys = df.select(F.explode(json_keys(json_col)).alias("key")).distinct()
    return keys.agg(F.array_join(F.array_sort(F.collect_list("key")), ",").alias("sample_keys"))
