"""B family: format inference over the record catalog derived from `sft_pairs`."""

from __future__ import annotations

from pyspark.sql import functions as F

from tunedata.operators import catalog as cat
from tunedata.plans.registry import query
from tunedata.plans.views import Views, oracle

_COLS = "(SELECT dataset, list(column_name ORDER BY ordinal) AS cols FROM column_catalog GROUP BY dataset)"


def _h(x: str) -> str:
    return f"list_contains(cols, '{x}')"


def _all(*xs: str) -> str:
    return "(" + " AND ".join(_h(x) for x in xs) + ")"


_DUCK_FORMAT = (f"CASE WHEN {_h('messages')} OR {_h('conversations')} THEN 'chat' "
                f"WHEN {_all('prompt', 'chosen', 'rejected')} OR {_all('question', 'chosen', 'rejected')} "
                f"THEN 'preference' "
                f"WHEN {_all('instruction', 'output')} OR {_all('prompt', 'completion')} THEN 'instruction' "
                f"WHEN {_h('text')} OR {_h('content')} THEN 'text' ELSE 'unknown' END")


def _sets(spark, sf_dir):
    return cat.column_sets(Views(spark, sf_dir).column_catalog)


@query("detect_format", oracle(f"SELECT dataset, {_DUCK_FORMAT} AS format FROM {_COLS} s", "column_catalog"))
def detect_format(spark, sf_dir):
    return _sets(spark, sf_dir).select("dataset", cat.detect_format(F.col("cols")).alias("format"))


_DUCK_TEXT_FIELD = ("CASE " + " ".join(f"WHEN {_h(c)} THEN '{c}'" for c in
                                        ["text", "content", "messages", "conversations", "prompt",
                                         "instruction"]) + " END")


@query("infer_text_field", oracle(f"SELECT dataset, {_DUCK_TEXT_FIELD} AS suggested_text_field FROM {_COLS} s",
                                  "column_catalog"))
def infer_text_field(spark, sf_dir):
    return _sets(spark, sf_dir).select("dataset",
                                       cat.infer_text_field(F.col("cols")).alias("suggested_text_field"))


@query("eval_text_column", oracle(
    "SELECT dataset, CASE " + " ".join(f"WHEN {_h(c)} THEN '{c}'" for c in
                                        ["text", "content", "prompt", "instruction"])
    + f" ELSE cols[1] END AS eval_text_column FROM {_COLS} s", "column_catalog"))
def eval_text_column(spark, sf_dir):
    return _sets(spark, sf_dir).select("dataset", cat.eval_text_column(F.col("cols")).alias("eval_text_column"))


@query("validate_preference_schema", oracle(
    "SELECT dataset, concat_ws(',', " + ", ".join(f"CASE WHEN NOT {_h(c)} THEN '{c}' END" for c in
                                                    ["prompt", "chosen", "rejected"])
    + ") AS missing, CAST(" + " + ".join(f"CASE WHEN NOT {_h(c)} THEN 1 ELSE 0 END" for c in
                                          ["prompt", "chosen", "rejected"])
    + f" AS BIGINT) AS n_missing FROM {_COLS} s", "column_catalog"))
def validate_preference_schema(spark, sf_dir):
    m = cat.missing_preference_columns(F.col("cols"))
    return _sets(spark, sf_dir).select("dataset", F.array_join(m, ",").alias("missing"),
                                       F.size(m).cast("bigint").alias("n_missing"))


_DUCK_ROUTE = (
    "CASE WHEN " + _h("instruction") + " AND coalesce(" + _DUCK_TEXT_FIELD + ", 'text') IN ('text', 'instruction')"
    " AND NOT " + _h("text") + " THEN 'alpaca' "
    "WHEN " + _h("prompt") + " AND (" + _h("completion") + " OR " + _h("output") + ") AND NOT " + _h("text")
    + " THEN 'prompt_completion' "
    "WHEN (" + _h("messages") + " OR " + _h("conversations") + ") AND NOT " + _h("text") + " THEN 'messages' "
    "WHEN " + _all("prompt", "chosen", "rejected") + " THEN 'reject' ELSE 'passthrough' END")


@query("route_sft_formatter", oracle(f"SELECT dataset, {_DUCK_ROUTE} AS formatter FROM {_COLS} s",
                                     "column_catalog"))
def route_sft_formatter(spark, sf_dir):
    return _sets(spark, sf_dir).select("dataset", cat.route_sft_formatter(F.col("cols")).alias("formatter"))


@query("doc_format_variant", oracle(
    f"SELECT dataset, CASE WHEN {_h('conversations')} THEN 'sharegpt' WHEN {_h('messages')} THEN 'messages' "
    f"WHEN {_all('instruction', 'output')} THEN 'alpaca' WHEN {_h('text')} AND len(cols) = 1 THEN 'plain_text' "
    f"WHEN {_all('prompt', 'completion')} THEN 'prompt_completion' ELSE 'unknown' END AS variant "
    f"FROM {_COLS} s", "column_catalog"))
def doc_format_variant(spark, sf_dir):
    return _sets(spark, sf_dir).select("dataset", cat.doc_format_variant(F.col("cols")).alias("variant"))


_DUCK_RECO = ("CASE f WHEN 'chat' THEN '" + cat.FORMAT_RECOMMENDATIONS["chat"] + "' WHEN 'preference' THEN '"
              + cat.FORMAT_RECOMMENDATIONS["preference"] + "' WHEN 'instruction' THEN '"
              + cat.FORMAT_RECOMMENDATIONS["instruction"] + "' WHEN 'text' THEN '"
              + cat.FORMAT_RECOMMENDATIONS["text"] + "' ELSE '" + cat.FORMAT_RECOMMENDATIONS["unknown"] + "' END")


@query("format_recommendations", oracle(
    f"SELECT f AS format, {_DUCK_RECO} AS recommendation, count(*) AS n_datasets "
    f"FROM (SELECT {_DUCK_FORMAT} AS f FROM {_COLS} s) x GROUP BY f", "column_catalog"))
def format_recommendations(spark, sf_dir):
    fmt = cat.detect_format(F.col("cols"))
    return (_sets(spark, sf_dir).select(fmt.alias("format"))
            .groupBy("format").agg(F.count(F.lit(1)).alias("n_datasets"))
            .select("format", cat.format_recommendation(F.col("format")).alias("recommendation"),
                    "n_datasets"))


@query("schema_consistency", oracle(
    "SELECT array_to_string(list_sort(json_keys(props)), ',') AS key_signature, count(*) AS n_rows "
    "FROM events GROUP BY 1"))
def schema_consistency(spark, sf_dir):
    return cat.schema_signatures(Views(spark, sf_dir).events, "props")


@query("sample_keys", oracle(
    "SELECT array_to_string(list_sort(list(DISTINCT k)), ',') AS sample_keys "
    "FROM (SELECT unnest(json_keys(props)) AS k FROM events) t"))
def sample_keys(spark, sf_dir):
    return cat.sample_keys(Views(spark, sf_dir).events, "props")


_D_TYPES = ("SELECT CASE WHEN json_valid(props) THEN regexp_replace(t.fullkey, '\\[[0-9]+\\]', '[]', 'g') ELSE '$' END AS path, "
            "CASE WHEN t.type IS NULL THEN 'malformed' WHEN t.type = 'VARCHAR' THEN 'string' WHEN t.type IN ('UBIGINT', 'BIGINT', 'HUGEINT', 'DOUBLE') "
            "THEN 'number' ELSE lower(t.type) END AS type FROM events LEFT JOIN LATERAL (SELECT * FROM json_tree(CASE WHEN json_valid(props) THEN props END)) t ON TRUE "
            "WHERE props IS NOT NULL")


@query("schema_drift", oracle(
    f"WITH c AS (SELECT path, type, count(*) AS n FROM ({_D_TYPES}) t GROUP BY 1, 2), "
    "p AS (SELECT path, string_agg(type, ',' ORDER BY type) AS types, sum(n)::BIGINT AS n_values, count(*) FILTER (type <> 'null') > 1 AS drift FROM c GROUP BY path) "
    "SELECT p.path, p.types, p.n_values, coalesce(c.n - p.n_values, 0)::BIGINT AS n_missing, p.drift FROM p LEFT JOIN c ON c.type = 'object' "
    "AND p.path <> '$' AND NOT ends_with(p.path, '[]') AND c.path = regexp_replace(p.path, '\\.[^.]*$', '')"))
def schema_drift(spark, sf_dir):
    """Types per nested path, where ``schema_consistency`` compares key sets only."""
    from tunedata.operators import drift

    return drift.schema_drift(Views(spark, sf_dir).events, "props")

