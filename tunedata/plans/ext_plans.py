"""K family: user hooks (pandas UDF token counter, mapInPandas scorer, two-phase aggregator)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from tunedata.functions.strings import PY_WHITESPACE_CLASS
from tunedata.functions.strings import is_blank
from tunedata.operators import ext
from tunedata.operators import metrics as mt
from tunedata.plans.registry import query
from tunedata.plans.views import Views, oracle

WS = PY_WHITESPACE_CLASS
_D_STRIP = f"regexp_replace(text, '^{WS}+|{WS}+$', '', 'g')"


@query("token_counter_udf", oracle(
    f"SELECT doc_id, CAST(CASE WHEN length({_D_STRIP}) = 0 THEN 0 ELSE len(regexp_split_to_array({_D_STRIP}, "
    f"'{WS}+')) END AS BIGINT) AS n_tokens FROM documents"))
def token_counter_udf(spark, sf_dir):
    count = ext.token_counter(ext.whitespace_counter)
    return Views(spark, sf_dir).documents.select("doc_id", count(F.col("text")).alias("n_tokens"))


@query("score_with", oracle(
    "WITH l AS (SELECT answer, list_transform(choices, lambda c: CAST(length(c) AS DOUBLE)) AS lg FROM mcq_items) "
    "SELECT CAST(sum(CASE WHEN list_position(lg, list_max(lg)) - 1 = answer THEN 1 ELSE 0 END) AS BIGINT) AS correct, "
    "count(*) AS total, round(coalesce(sum(CASE WHEN list_position(lg, list_max(lg)) - 1 = answer THEN 1 ELSE 0 END) "
    "/ count(*), 0.0), 6) AS accuracy FROM l", "mcq_items"))
def score_with(spark, sf_dir):
    """Items scored in Arrow batches by a per-task scorer, then aggregated."""
    items = Views(spark, sf_dir).mcq_items.select("item_id", "answer", "choices")
    scored = ext.score_with(items, ext.longest_choice_scorer, "item_id long, answer int, choice_logits array<double>")
    return scored.agg(*mt.accuracy_aggs(mt.argmax_first("choice_logits") == F.col("answer")))


def _partial(b: pd.DataFrame) -> pd.DataFrame:
    b = b.assign(ln=b["loss"] * b["n_tokens"])
    g = b.groupby("lang", as_index=False, dropna=False).agg(ln=("ln", "sum"), n=("n_tokens", "sum"), rows=("loss", "size"))
    return g.astype({"ln": "float64", "n": "int64", "rows": "int64"})


def _combine(p: pd.DataFrame) -> pd.DataFrame:
    return p.groupby("lang", as_index=False, dropna=False).sum()


def _merge(p: pd.DataFrame) -> pd.DataFrame:
    ln, n = float(p["ln"].sum()), int(p["n"].sum())
    return pd.DataFrame({"lang": [p["lang"].iloc[0]], "loss": [round(ln / max(n, 1), 6)],
                         "total": [int(p["rows"].sum())]})


@query("pluggable_aggregate", oracle(
    "SELECT lang, round(sum(loss * n_tokens) / greatest(sum(n_tokens), 1), 6) AS loss, count(*) AS total "
    f"FROM loss_items WHERE length({_D_STRIP}) > 0 GROUP BY lang", "loss_items"))
def pluggable_aggregate(spark, sf_dir):
    li = Views(spark, sf_dir).loss_items.where(~is_blank("text")).select("lang", "loss", "n_tokens")
    return ext.two_phase_aggregate(li, "lang", _partial, _merge, "lang string, ln double, n long, rows long",
                                   "lang string, loss double, total long", _combine)
