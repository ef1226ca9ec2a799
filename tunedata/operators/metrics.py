"""Evaluation aggregates (F family): predictions, accuracy, token-weighted loss, perplexity,
breakdowns and comparisons. All are partial+final aggregates or small dimension joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tunedata.functions.strings import is_blank
from tunedata.operators.ordering import running_sums

# Evaluation constants of the reference.
LOSS_EXP_CAP = 100.0
ACCURACY_EVERY = 100
LOSS_EVERY = 50
FORGETTING_DROP = 0.05
CONTAMINATION_JUMP = 0.10
REPEAT_NOISE = 0.01

# Published base-model MMLU (5-shot) bands, as fractions (lo, hi).
EXPECTED_MMLU = [
    ("Llama 3.2 1B", 0.49, 0.49), ("Qwen 2.5 1.5B", 0.56, 0.60), ("Gemma 2 2B", 0.51, 0.51),
    ("Llama 3.2 3B", 0.62, 0.62), ("Phi-3 Mini (3.8B)", 0.69, 0.69), ("Phi-4 Mini (3.8B)", 0.67, 0.67),
    ("Mistral 7B v0.3", 0.63, 0.63), ("Qwen 2.5 7B", 0.74, 0.74), ("Llama 3.1 8B", 0.66, 0.68),
    ("Gemma 2 9B", 0.71, 0.71), ("Qwen 2.5 14B", 0.78, 0.78), ("Phi-4 (14B)", 0.85, 0.85),
]


def argmax_first(logits: str | Column) -> Column:
    """Index of the largest value; the first index wins on ties."""
    a = F.col(logits) if isinstance(logits, str) else logits
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def accuracy_aggs(correct: Column) -> list[Column]:
    c = F.sum(correct.cast("bigint"))
    n = F.count(F.lit(1))
    return [F.coalesce(c, F.lit(0)).cast("bigint").alias("correct"), n.alias("total"),
            F.round(F.coalesce(F.try_divide(c, n), F.lit(0.0)), 6).alias("accuracy")]


def token_weighted_loss(df: DataFrame, text: str, loss: str, n_tokens: str) -> DataFrame:
    """``Σ loss·n / max(Σ n, 1)`` over non-blank texts, with the number of scored rows."""
    scored = df.where(F.col(text).isNotNull() & ~is_blank(text))
    return scored.agg(F.sum(F.col(loss) * F.col(n_tokens)).alias("_ln"), F.sum(n_tokens).alias("_n"),
                      F.count(F.lit(1)).alias("total"))


def finish_loss(df: DataFrame, *keys: str) -> DataFrame:
    avg = F.coalesce(F.col("_ln"), F.lit(0.0)) / F.greatest(F.coalesce(F.col("_n"), F.lit(0)), F.lit(1))
    return df.select(*keys, F.round(avg, 6).alias("loss"),
                     F.round(F.exp(F.least(avg, F.lit(LOSS_EXP_CAP))), 6).alias("perplexity"), "total")


def running_metric(df: DataFrame, order: str, every: int, sums: dict[str, Column], value: Column) -> DataFrame:
    """Running metric at every ``every``-th row of a global order, via prefix sums over partitions."""
    c = running_sums(df, [order], sums)
    return c.where(F.col("pos") % every == 0).select("pos", F.round(value, 6).alias("value"))


def confusion_metrics(df: DataFrame, label: str, pred: str) -> DataFrame:
    """Per-class precision, recall, F1 and support from a confusion matrix, plus a macro row."""
    cm = df.groupBy(F.col(label).alias("y"), F.col(pred).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    tp = cm.where(F.col("y") == F.col("p")).select(F.col("y").alias("cls"), F.col("n").alias("tp"))
    pred_tot = cm.groupBy(F.col("p").alias("cls")).agg(F.sum("n").alias("pred_n"))
    true_tot = cm.groupBy(F.col("y").alias("cls")).agg(F.sum("n").alias("support"))
    j = true_tot.join(pred_tot, "cls", "full").join(tp, "cls", "left").fillna(0, ["tp", "pred_n", "support"])
    prec = F.coalesce(F.try_divide(F.col("tp"), F.col("pred_n")), F.lit(0.0))
    rec = F.coalesce(F.try_divide(F.col("tp"), F.col("support")), F.lit(0.0))
    f1 = F.when(prec + rec == 0, F.lit(0.0)).otherwise(2 * prec * rec / (prec + rec))
    per = j.select(F.col("cls").cast("string").alias("cls"), prec.alias("precision"), rec.alias("recall"),
                   f1.alias("f1"), F.col("support").cast("bigint").alias("support"))
    macro = per.agg(F.lit("macro").alias("cls"), F.avg("precision").alias("precision"),
                    F.avg("recall").alias("recall"), F.avg("f1").alias("f1"),
                    F.sum("support").cast("bigint").alias("support"))
    return per.unionByName(macro).select("cls", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")],
                                         "support")
