"""Dataset audit and quality checks (D family) as single-pass aggregates and column predicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tunedata.functions.strings import col_, is_blank, is_empty_value
from tunedata.functions.text import whitespace_token_count
from tunedata.operators import catalog as cat
from tunedata.operators.keyfilter import rows_without, written

# Audit thresholds and messages of the reference summary.
SMALL_DATASET_ROWS = 1000
LONG_VALUE_CHARS = 8000
PREVIEW_ROWS = 3
RISK_UNKNOWN = "Could not infer a canonical training format from the available columns."
RISK_SMALL = "Dataset is small; start conservatively and expect limited generalization."
RISK_EMPTY = "Some sample rows contain empty values in: "
RISK_LONG = "Very long sample values detected in: "
MIN_TOKENS = 10
MAX_SEQ_LENGTH = 2048

# The documented dataset size guideline bands (lower bound inclusive).
SIZE_BANDS = [(0, 100, "under 100"), (100, 500, "100-500"), (500, 1000, "500-1K"), (1000, 5000, "1K-5K"),
              (5000, 10000, "5K-10K"), (10000, 50000, "10K-50K"), (50000, None, "50K+")]

# Encoding-problem patterns (replacement char, C0 controls, UTF-8 read as Latin-1).
REPLACEMENT_CHAR = "�"
CONTROL_CHARS_RE = r"[\x{00}-\x{08}\x{0B}\x{0C}\x{0E}-\x{1F}]"
MOJIBAKE_RE = "Ã.|â€"


def _kind(dt: T.DataType) -> str:
    if isinstance(dt, T.StringType):
        return "string"
    if isinstance(dt, T.ArrayType):
        return "array"
    return "other"


def field_flags(df: DataFrame) -> list[Column]:
    """Per column: any empty value ("", None, []) and any string longer than 8000 chars."""
    out = []
    for f in df.schema.fields:
        k = _kind(f.dataType)
        out.append(F.max(is_empty_value(f.name, k).cast("int")).alias(f"e::{f.name}"))
        if k == "string":
            out.append(F.max((F.length(f.name) > LONG_VALUE_CHARS).cast("int")).alias(f"l::{f.name}"))
    return out


def _names_where(prefix: str, names: list[str]) -> Column:
    flagged = [F.when(F.col(f"`{prefix}::{n}`") == 1, F.lit(n)) for n in sorted(names)]
    return F.array_compact(F.array(*flagged)) if flagged else F.array().cast("array<string>")


def dataset_summary(df: DataFrame, name: str, split: str = "train", order_by: str | None = None,
                    mode: str = "preview", max_examples: int = PREVIEW_ROWS) -> DataFrame:
    """One-row audit: format, text field, risks, recommendations, sample keys.

    ``preview`` inspects the first ``max_examples`` rows by ``order_by`` (TakeOrderedAndProject),
    ``full`` inspects every row in the same aggregate that counts them."""
    cols = df.columns
    string_cols = [f.name for f in df.schema.fields if _kind(f.dataType) == "string"]
    flags = field_flags(df)
    if mode == "full":
        agg = df.agg(F.count(F.lit(1)).alias("num_rows"), *flags)
    else:
        if order_by is None:
            raise ValueError("preview mode needs an explicit order_by column")
        sample = df.orderBy(order_by).limit(max_examples)
        counted = df.agg(F.count(F.lit(1)).alias("num_rows"))
        flagged = sample.agg(*flags)
        # Two one-row aggregates combined by a union + max (no join needed).
        both = counted.unionByName(flagged, allowMissingColumns=True)
        agg = both.agg(F.max("num_rows").alias("num_rows"),
                       *[F.max(F.col(f"`{c}`")).alias(c) for c in flagged.columns])
    cols_lit = F.array(*[F.lit(c) for c in cols])
    fmt = cat.detect_format(cols_lit)
    empty = _names_where("e", cols)
    long_ = _names_where("l", string_cols)
    risks = F.array_compact(F.array(
        F.when(fmt == "unknown", F.lit(RISK_UNKNOWN)),
        F.when(F.col("num_rows") < SMALL_DATASET_ROWS, F.lit(RISK_SMALL)),
        F.when(F.size(empty) > 0, F.concat(F.lit(RISK_EMPTY), F.array_join(empty, ", "), F.lit("."))),
        F.when(F.size(long_) > 0, F.concat(F.lit(RISK_LONG), F.array_join(long_, ", "), F.lit("."))),
    ))
    return agg.select(
        F.lit(name).alias("dataset"), F.lit(split).alias("split"),
        F.col("num_rows").cast("bigint").alias("num_rows"),
        F.array_join(cols_lit, ",").alias("column_names"),
        fmt.alias("format"),
        cat.infer_text_field(cols_lit).alias("suggested_text_field"),
        risks.alias("risks"),
        F.array(cat.format_recommendation(fmt)).alias("recommendations"),
        F.lit(",".join(sorted(cols))).alias("sample_keys"),
    )


def empty_field_counts(df: DataFrame) -> DataFrame:
    """``column_name, n_empty`` over every row (one aggregate, then unpivot)."""
    aggs = [F.sum(is_empty_value(f.name, _kind(f.dataType)).cast("bigint")).alias(f.name)
            for f in df.schema.fields]
    wide = df.agg(*aggs)
    return wide.unpivot([], [f.name for f in df.schema.fields], "column_name", "n_empty") \
        .select("column_name", F.coalesce("n_empty", F.lit(0)).cast("bigint").alias("n_empty"))


def long_field_stats(df: DataFrame, limit: int = LONG_VALUE_CHARS) -> DataFrame:
    """``column_name, n_long, max_len`` for string columns."""
    names = [f.name for f in df.schema.fields if _kind(f.dataType) == "string"]
    aggs = []
    for n in names:
        aggs += [F.sum((F.length(n) > limit).cast("bigint")).alias(f"n::{n}"),
                 F.max(F.length(n)).cast("bigint").alias(f"m::{n}")]
    wide = df.agg(*aggs)
    return wide.select(F.explode(F.array(*[
        F.struct(F.lit(n).alias("column_name"), F.col(f"`n::{n}`").alias("n_long"),
                 F.col(f"`m::{n}`").alias("max_len")) for n in names])).alias("s")).select("s.*")


def size_band(n: Column) -> Column:
    expr = None
    for lo, hi, label in SIZE_BANDS:
        cond = (n >= lo) if hi is None else ((n >= lo) & (n < hi))
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr


def drop_empty_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """Keep rows whose listed columns are non-null and not blank after ``strip()``."""
    cond = F.lit(True)
    for c in columns:
        cond = cond & F.col(c).isNotNull() & ~is_blank(c)
    return df.where(cond)


def content_key(columns: list[str]) -> Column:
    """256-bit digest of the listed columns (null-safe, separator-safe)."""
    if len(columns) == 1:
        return F.sha2(F.coalesce(F.col(columns[0]).cast("string"), F.lit("\u0000null")), 256)
    return F.sha2(F.to_json(F.struct(*[F.col(c) for c in columns])), 256)


def exact_dedup(df: DataFrame, columns: list[str], id_col: str) -> DataFrame:
    """Keep the smallest ``id_col`` of every group of identical ``columns``.

    The group key is a digest, so the shuffle carries (digest, id) only; ``min`` aggregates
    map-side, so a hot duplicate group costs one row per map task, not one task for the group."""
    keyed = df.withColumn("_k", content_key(columns))
    keep = keyed.groupBy("_k").agg(F.min(id_col).alias(id_col)).select(id_col)
    return df.join(keep, id_col, "left_semi")


def duplicate_groups(df: DataFrame, columns: list[str]) -> DataFrame:
    """``_k, n`` for every content digest with more than one row."""
    return (df.select(content_key(columns).alias("_k")).groupBy("_k")
            .agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1))


def token_count(c: str | Column) -> Column:
    return whitespace_token_count(c)


def truncation(df: DataFrame, n: Column, dataset: str, kind: str, limit: int) -> DataFrame:
    """One row: how many rows have more than ``limit`` tokens and how many tokens that cuts off. ``n`` is any
    token count: words, or one of the token-counter hook."""
    return df.select(n.alias("n")).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum((F.col("n") > limit).cast("bigint")).alias("n_truncated"),
        F.sum(F.greatest(F.col("n") - limit, F.lit(0))).cast("bigint").alias("lost_tokens"),
    ).select(F.lit(dataset).alias("dataset"), F.lit(kind).alias("limit_kind"),
             F.lit(limit).cast("bigint").alias("token_limit"), "n_rows", "n_truncated", "lost_tokens")


def encoding_flags(c: str | Column) -> list[Column]:
    c = col_(c)
    return [F.instr(c, REPLACEMENT_CHAR) > 0, c.rlike(CONTROL_CHARS_RE), c.rlike(MOJIBAKE_RE)]


def gate_reasons(df: DataFrame, id_col: str, text_col: str, *carry: str) -> DataFrame:
    """``id, reason, digest`` and the columns ``carry``: the first check that a row fails on its own (null: none), in one pass."""
    n = token_count(text_col)
    rep, ctl, moj = encoding_flags(text_col)
    reason = (F.when(F.col(text_col).isNull() | is_blank(text_col), "empty")
              .when(n < MIN_TOKENS, "too_short").when(n > MAX_SEQ_LENGTH, "too_long").when(rep | ctl | moj, "encoding"))
    return df.select(F.col(id_col).alias("id"), reason.alias("reason"), content_key([text_col]).alias("digest"), *carry)


def gate_rows(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id_col, reason`` of every row, ``kept`` for those that pass and are the first of their text. Only
    (id, reason, digest) is shuffled."""
    rows = written(gate_reasons(df, id_col, text_col), "gate")
    first = rows.where("reason is null").groupBy("digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    j = rows.join(first.select(F.col("digest").alias("d"), "first"), (F.col("digest") == F.col("d")) & F.col("reason").isNull(), "left")
    out = F.coalesce("reason", F.when(F.col("id") > F.col("first"), "duplicate"), F.lit("kept"))
    return j.select(F.col("id").alias(id_col), out.alias("reason"))


def gate(df: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """The kept rows, all columns, and ``(id, reason)`` of the rejected ones."""
    rejected = written(gate_rows(df, id_col, text_col).where("reason <> 'kept'"), "rejected")
    return rows_without(df, rejected, id_col), rejected


def chat_structure(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role") -> DataFrame:
    """One row per conversation: does it start with a system turn, hold none later, alternate roles, end with
    the assistant and know only the three roles.

    The previous turn is the one before in order, whatever number it has, so a gap in the numbers
    hides nothing. Turns are put in order by range over (conversation, turn), and each partition compares
    neighbours; the first turn of a partition meets the last one of the partition before
    through a table of one row per partition. A conversation of any length thus takes many tasks."""
    from tunedata.operators.ordering import with_previous

    t = turns.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.col(role).alias("role"))
    t = with_previous(t, ["conv_id", "turn"], ["conv_id", "role"])
    same = F.col("prev_conv_id").eqNullSafe(F.col("conv_id"))
    known = F.col("role").isin("system", "user", "assistant")
    g = t.groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("n_turns"),
        F.min_by("role", "turn").alias("_first_role"),
        F.max_by("role", "turn").alias("_last_role"),
        F.coalesce(F.bool_or((F.col("role") == "system") & same), F.lit(False)).alias("_late_system"),
        F.coalesce(F.bool_or((F.col("prev_role") == F.col("role")) & same), F.lit(False)).alias("_repeat"),
        F.bool_and(known).alias("roles_known"))
    ends = F.col("_last_role") == "assistant"
    return g.select(F.col("conv_id").alias(conv), "n_turns", (F.col("_first_role") == "system").alias("starts_with_system"),
                    (~F.col("_late_system")).alias("system_only_first"), (~F.col("_repeat")).alias("alternates"),
                    ends.alias("ends_with_assistant"), "roles_known",
                    (ends & ~F.col("_repeat") & ~F.col("_late_system") & F.col("roles_known")).alias("valid"))


def pair_difference(chosen: str | Column, rejected: str | Column) -> list[Column]:
    """identical after normalisation, whitespace-token Jaccard, shorter/longer length ratio."""
    from tunedata.functions.text import whitespace_tokens

    def norm(x: Column) -> Column:
        return F.array_join(whitespace_tokens(F.lower(x)), " ")

    a, b = col_(chosen), col_(rejected)
    ta, tb = F.array_distinct(whitespace_tokens(a)), F.array_distinct(whitespace_tokens(b))
    inter = F.size(F.array_intersect(ta, tb))
    union = F.size(F.array_union(ta, tb))
    jac = F.when(union == 0, F.lit(1.0)).otherwise(inter / union)
    la, lb = F.length(a), F.length(b)
    ratio = F.when(F.greatest(la, lb) == 0, F.lit(1.0)).otherwise(F.least(la, lb) / F.greatest(la, lb))
    return [(norm(a) == norm(b)).alias("identical"), F.round(jac, 6).alias("jaccard"),
            F.round(ratio, 6).alias("length_ratio")]
