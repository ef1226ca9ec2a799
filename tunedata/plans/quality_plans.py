"""D family: audit, filters and quality aggregates over documents, pairs and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tunedata.functions.strings import PY_WHITESPACE_CLASS, is_blank
from tunedata.operators import language as lg
from tunedata.operators import quality as q
from tunedata.plans.registry import query
from tunedata.plans.views import Views, oracle

WS = PY_WHITESPACE_CLASS


def d_strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def d_tokens(x: str) -> str:
    return f"CASE WHEN length({d_strip(x)}) = 0 THEN [] ELSE regexp_split_to_array({d_strip(x)}, '{WS}+') END"


def d_ntok(x: str) -> str:
    return f"CAST(len({d_tokens(x)}) AS BIGINT)"


_SFT_COLS = ["pair_id", "conv_id", "instruction", "input", "output"]


def _d_empty(c: str) -> str:
    return f"({c} IS NULL)" if c in ("pair_id", "conv_id") else f"({c} IS NULL OR {c} = '')"


@query("dataset_summary", oracle(
    "WITH smp AS (SELECT * FROM sft_pairs ORDER BY pair_id LIMIT 3), "
    "fl AS (SELECT " + ", ".join(f"bool_or({_d_empty(c)}) AS e_{c}" for c in _SFT_COLS) + ", "
    + ", ".join(f"bool_or(length({c}) > 8000) AS l_{c}" for c in ("instruction", "input", "output"))
    + " FROM smp), "
    "em AS (SELECT concat_ws(', ', " + ", ".join(f"CASE WHEN e_{c} THEN '{c}' END" for c in sorted(_SFT_COLS))
    + ") AS e, concat_ws(', ', " + ", ".join(f"CASE WHEN l_{c} THEN '{c}' END" for c in
                                             sorted(["instruction", "input", "output"]))
    + ") AS l FROM fl), n AS (SELECT count(*) AS num_rows FROM sft_pairs) "
    "SELECT 'sft_pairs' AS dataset, 'train' AS split, n.num_rows, "
    "'pair_id,conv_id,instruction,input,output' AS column_names, 'instruction' AS format, "
    "'instruction' AS suggested_text_field, "
    f"concat_ws(' | ', CASE WHEN n.num_rows < 1000 THEN '{q.RISK_SMALL}' END, "
    f"CASE WHEN em.e <> '' THEN '{q.RISK_EMPTY}' || em.e || '.' END, "
    f"CASE WHEN em.l <> '' THEN '{q.RISK_LONG}' || em.l || '.' END) AS risks, "
    "'SFT is a sensible starting point for the first run.' AS recommendations, "
    "'conv_id,input,instruction,output,pair_id' AS sample_keys FROM n, em", "sft_pairs"))
def dataset_summary(spark, sf_dir):
    s = q.dataset_summary(Views(spark, sf_dir).sft_pairs, "sft_pairs", order_by="pair_id")
    return s.withColumn("risks", F.array_join("risks", " | ")) \
        .withColumn("recommendations", F.array_join("recommendations", " | "))


@query("dataset_summary_full", oracle(
    "WITH smp AS (SELECT * FROM sft_pairs ORDER BY pair_id), "
    "fl AS (SELECT " + ", ".join(f"bool_or({_d_empty(c)}) AS e_{c}" for c in _SFT_COLS) + ", "
    + ", ".join(f"bool_or(length({c}) > 8000) AS l_{c}" for c in ("instruction", "input", "output"))
    + " FROM smp), "
    "em AS (SELECT concat_ws(', ', " + ", ".join(f"CASE WHEN e_{c} THEN '{c}' END" for c in sorted(_SFT_COLS))
    + ") AS e, concat_ws(', ', " + ", ".join(f"CASE WHEN l_{c} THEN '{c}' END" for c in
                                             sorted(["instruction", "input", "output"]))
    + ") AS l FROM fl), n AS (SELECT count(*) AS num_rows FROM sft_pairs) "
    "SELECT 'sft_pairs' AS dataset, 'train' AS split, n.num_rows, "
    "'pair_id,conv_id,instruction,input,output' AS column_names, 'instruction' AS format, "
    "'instruction' AS suggested_text_field, "
    f"concat_ws(' | ', CASE WHEN n.num_rows < 1000 THEN '{q.RISK_SMALL}' END, "
    f"CASE WHEN em.e <> '' THEN '{q.RISK_EMPTY}' || em.e || '.' END, "
    f"CASE WHEN em.l <> '' THEN '{q.RISK_LONG}' || em.l || '.' END) AS risks, "
    "'SFT is a sensible starting point for the first run.' AS recommendations, "
    "'conv_id,input,instruction,output,pair_id' AS sample_keys FROM n, em", "sft_pairs"))
def dataset_summary_full(spark, sf_dir):
    s = q.dataset_summary(Views(spark, sf_dir).sft_pairs, "sft_pairs", mode="full")
    return s.withColumn("risks", F.array_join("risks", " | ")) \
        .withColumn("recommendations", F.array_join("recommendations", " | "))


@query("preview_rows", oracle("SELECT doc_id, lang, source, n_chars FROM documents ORDER BY doc_id LIMIT 3"))
def preview_rows(spark, sf_dir):
    return Views(spark, sf_dir).documents.select("doc_id", "lang", "source", "n_chars") \
        .orderBy("doc_id").limit(q.PREVIEW_ROWS)


@query("empty_fields", oracle(
    " UNION ALL ".join(f"SELECT '{c}' AS column_name, CAST(sum(CASE WHEN {_d_empty(c)} THEN 1 ELSE 0 END) "
                       f"AS BIGINT) AS n_empty FROM sft_pairs" for c in _SFT_COLS), "sft_pairs"))
def empty_fields(spark, sf_dir):
    return q.empty_field_counts(Views(spark, sf_dir).sft_pairs)


@query("long_fields", oracle(
    " UNION ALL ".join(f"SELECT '{c}' AS column_name, CAST(sum(CASE WHEN length({c}) > 8000 THEN 1 ELSE 0 END) "
                       f"AS BIGINT) AS n_long, CAST(max(length({c})) AS BIGINT) AS max_len FROM documents"
                       for c in ("text", "lang", "source"))))
def long_fields(spark, sf_dir):
    return q.long_field_stats(Views(spark, sf_dir).documents.select("text", "lang", "source"))


_SIZED = ["documents", "conversations", "benchmark", "labels", "events", "lineitem", "sft_pairs"]


def _counts(spark, sf_dir):
    v = Views(spark, sf_dir)
    parts = [v.get(t).agg(F.count(F.lit(1)).alias("num_rows")).select(F.lit(t).alias("table_name"), "num_rows")
             for t in _SIZED]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("size_risk", oracle(
    " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS num_rows, count(*) < 1000 AS small FROM {t}"
                       for t in _SIZED), "sft_pairs"))
def size_risk(spark, sf_dir):
    return _counts(spark, sf_dir).withColumn("small", F.col("num_rows") < q.SMALL_DATASET_ROWS)


_D_BAND = ("CASE WHEN num_rows < 100 THEN 'under 100' WHEN num_rows < 500 THEN '100-500' "
           "WHEN num_rows < 1000 THEN '500-1K' WHEN num_rows < 5000 THEN '1K-5K' WHEN num_rows < 10000 "
           "THEN '5K-10K' WHEN num_rows < 50000 THEN '10K-50K' ELSE '50K+' END")


@query("size_band", oracle(
    f"SELECT table_name, num_rows, {_D_BAND} AS band FROM ("
    + " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS num_rows FROM {t}" for t in _SIZED)
    + ") c", "sft_pairs"))
def size_band(spark, sf_dir):
    """Range join of per-table counts to the band dimension (7 rows, broadcast)."""
    bands = spark.createDataFrame([(lo, hi, lbl) for lo, hi, lbl in q.SIZE_BANDS],
                                  "lo bigint, hi bigint, band string")
    c = _counts(spark, sf_dir)
    cond = (c.num_rows >= bands.lo) & (bands.hi.isNull() | (c.num_rows < bands.hi))
    return c.join(F.broadcast(bands), cond, "left").select("table_name", "num_rows", "band")


@query("drop_empty_rows", oracle(
    f"SELECT pair_id FROM sft_pairs WHERE instruction IS NOT NULL AND length({d_strip('instruction')}) > 0 "
    f"AND output IS NOT NULL AND length({d_strip('output')}) > 0", "sft_pairs"))
def drop_empty_rows(spark, sf_dir):
    return q.drop_empty_rows(Views(spark, sf_dir).sft_pairs, ["instruction", "output"]).select("pair_id")


@query("exact_dedup", oracle("SELECT min(doc_id) AS doc_id FROM documents GROUP BY text"))
def exact_dedup(spark, sf_dir):
    return q.exact_dedup(Views(spark, sf_dir).documents, ["text"], "doc_id").select("doc_id")


@query("exact_dedup_pairs", oracle("SELECT min(pair_id) AS pair_id FROM sft_pairs GROUP BY instruction, output",
                                   "sft_pairs"))
def exact_dedup_pairs(spark, sf_dir):
    return q.exact_dedup(Views(spark, sf_dir).sft_pairs, ["instruction", "output"], "pair_id").select("pair_id")


@query("duplicate_report", oracle(
    "SELECT CAST(count(*) AS BIGINT) AS dup_groups, CAST(coalesce(sum(n), 0) AS BIGINT) AS dup_rows, "
    "CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS redundant_rows "
    "FROM (SELECT count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1) g"))
def duplicate_report(spark, sf_dir):
    g = q.duplicate_groups(Views(spark, sf_dir).documents, ["text"])
    return g.agg(F.count(F.lit(1)).alias("dup_groups"),
                 F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("dup_rows"),
                 F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("bigint").alias("redundant_rows"))


@query("length_filter", oracle(
    f"SELECT doc_id, n_tokens FROM (SELECT doc_id, {d_ntok('text')} AS n_tokens FROM documents) t "
    "WHERE n_tokens BETWEEN 10 AND 2048"))
def length_filter(spark, sf_dir):
    d = Views(spark, sf_dir).documents.select("doc_id", q.token_count("text").alias("n_tokens"))
    return d.where(F.col("n_tokens").between(q.MIN_TOKENS, q.MAX_SEQ_LENGTH))


@query("length_distribution", oracle(
    f"SELECT CAST(floor(log2(n + 1)) AS BIGINT) AS bucket, count(*) AS n_docs, min(n) AS min_tokens, "
    f"max(n) AS max_tokens FROM (SELECT {d_ntok('text')} AS n FROM documents) t GROUP BY 1"))
def length_distribution(spark, sf_dir):
    d = Views(spark, sf_dir).documents.select(q.token_count("text").alias("n"))
    return (d.groupBy(F.floor(F.log2(F.col("n") + 1)).cast("bigint").alias("bucket"))
            .agg(F.count(F.lit(1)).alias("n_docs"), F.min("n").alias("min_tokens"),
                 F.max("n").alias("max_tokens")))


@query("length_moments", oracle(
    "SELECT count(*) AS n_docs, round(avg(n), 6) AS mean_tokens, round(stddev_pop(n), 6) AS std_tokens, "
    "round(sum(pow((n - mu) / sd, 3)) / count(*), 6) AS skewness "
    f"FROM (SELECT *, avg(n) OVER () AS mu, stddev_pop(n) OVER () AS sd FROM (SELECT {d_ntok('text')} AS n FROM documents) t) s"))
def length_moments(spark, sf_dir):
    """Mean, population std-dev and skewness by Spark's own single-pass central moments."""
    d = Views(spark, sf_dir).documents.select(q.token_count("text").cast("double").alias("n"))
    return d.agg(F.count(F.lit(1)).alias("n_docs"), F.round(F.avg("n"), 6).alias("mean_tokens"),
                 F.round(F.stddev_pop("n"), 6).alias("std_tokens"), F.round(F.skewness("n"), 6).alias("skewness"))


_PERCENTS = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)


@query("length_percentiles", oracle(
    " UNION ALL ".join(f"SELECT CAST({p} AS DOUBLE) AS p, round(quantile_cont(n, {p}), 6) AS n_tokens FROM "
                       f"(SELECT {d_ntok('text')} AS n FROM documents) t" for p in _PERCENTS)))
def length_percentiles(spark, sf_dir):
    """Exact percentiles: Spark's aggregate counts distinct lengths, so its state is bounded by the
    longest text. ``approx_percentile`` is the cheaper choice where a small error will do."""
    d = Views(spark, sf_dir).documents.select(q.token_count("text").alias("n"))
    found = d.agg(F.percentile("n", F.array(*[F.lit(p) for p in _PERCENTS])).alias("v"))
    pairs = F.arrays_zip(F.array(*[F.lit(p) for p in _PERCENTS]).alias("p"), F.col("v"))
    return found.select(F.explode(pairs).alias("x")).select(F.col("x.p").alias("p"), F.round(F.col("x.v"), 6).alias("n_tokens"))


@query("length_sketch", oracle(" UNION ALL ".join(
    f"SELECT {key} AS source, count(*) AS n, CAST({p} AS DOUBLE) AS p, quantile_disc(n, {p}) AS value, TRUE AS within "
    f"FROM (SELECT source, {d_ntok('text')} AS n FROM documents) t {group}"
    for p in _PERCENTS for key, group in (("source", "GROUP BY source"), ("'*'", "")))))
def length_sketch(spark, sf_dir):
    """Percentiles of lengths out of kept sketches: one per language and source, merged to sources, then
    to the corpus (``*``). Up to ``sk.K`` rows a sketch is exact; ``within`` holds beyond as well."""
    from tunedata.operators import sketches as sk
    from tunedata.operators.keyfilter import written

    lengths = written(Views(spark, sf_dir).documents.select("lang", "source", q.token_count("text").alias("n")), "lengths")
    kept = written(sk.quantile_sketches(lengths, ["lang", "source"], F.col("n")), "length-sketches")
    by_source = written(sk.merge_sketches(kept, ["source"]), "source-sketches")
    per = sk.within_bound(sk.sketch_quantiles(by_source, ["source"], _PERCENTS), lengths, ["source"], F.col("n"))
    whole = sk.merge_sketches(by_source, []).withColumn("source", F.lit("*"))
    every = sk.within_bound(sk.sketch_quantiles(whole, ["source"], _PERCENTS), lengths.withColumn("source", F.lit("*")), ["source"], F.col("n"))
    return per.unionByName(every)


@query("truncation_report", oracle(
    f"SELECT 'documents' AS dataset, 'sft' AS limit_kind, CAST(2048 AS BIGINT) AS token_limit, count(*) AS n_rows, "
    f"CAST(sum(CASE WHEN n > 2048 THEN 1 ELSE 0 END) AS BIGINT) AS n_truncated, "
    f"CAST(sum(greatest(n - 2048, 0)) AS BIGINT) AS lost_tokens "
    f"FROM (SELECT {d_ntok('text')} AS n FROM documents) t UNION ALL "
    f"SELECT 'preference_pairs', 'prompt', CAST(512 AS BIGINT), count(*), "
    f"CAST(sum(CASE WHEN p > 512 THEN 1 ELSE 0 END) AS BIGINT), CAST(sum(greatest(p - 512, 0)) AS BIGINT) "
    f"FROM (SELECT {d_ntok('prompt')} AS p FROM preference_pairs) a UNION ALL "
    f"SELECT 'preference_pairs', 'sequence', CAST(1024 AS BIGINT), count(*), "
    f"CAST(sum(CASE WHEN p > 1024 THEN 1 ELSE 0 END) AS BIGINT), CAST(sum(greatest(p - 1024, 0)) AS BIGINT) "
    f"FROM (SELECT {d_ntok('prompt')} + {d_ntok('chosen')} AS p FROM preference_pairs) b", "preference_pairs"))
def truncation_report(spark, sf_dir):
    v = Views(spark, sf_dir)

    pp = v.preference_pairs
    return (q.truncation(v.documents, q.token_count("text"), "documents", "sft", q.MAX_SEQ_LENGTH)
            .unionByName(q.truncation(pp, q.token_count("prompt"), "preference_pairs", "prompt", 512))
            .unionByName(q.truncation(pp, q.token_count("prompt") + q.token_count("chosen"), "preference_pairs",
                                      "sequence", 1024)))


@query("bpe_token_counts")
def bpe_token_counts(spark, sf_dir):
    """Subword tokens of every whole text, by merges learned on the same corpus."""
    from tunedata.operators import bpe

    d = Views(spark, sf_dir).documents
    merges = bpe.learn_merges(d, "text")
    return d.select("doc_id", q.token_count("text").alias("n_words"), bpe.token_column(merges, "text").alias("n_tokens"))


@query("bpe_truncation_report")
def bpe_truncation_report(spark, sf_dir):
    """The truncation report on subword counts instead of words."""
    from tunedata.operators import bpe

    d = Views(spark, sf_dir).documents
    return q.truncation(d, bpe.token_column(bpe.learn_merges(d, "text"), "text"), "documents", "sft", q.MAX_SEQ_LENGTH)


@query("language_mix", oracle(
    "SELECT lang, count(*) AS n_docs, round(count(*) / sum(count(*)) OVER (), 6) AS share "
    "FROM documents GROUP BY lang"))
def language_mix(spark, sf_dir):
    from pyspark.sql import Window

    g = Views(spark, sf_dir).documents.groupBy("lang").agg(F.count(F.lit(1)).alias("n_docs"))
    # The window runs over the aggregated result: one row per language.
    return g.withColumn("share", F.round(F.col("n_docs") / F.sum("n_docs").over(Window.partitionBy()), 6))


_D_OTHERS = lg.ALPHABET[1:] + "".join(c.upper() for c in lg.ALPHABET[1:] if len(c.upper()) == 1)
_D_DETECT = (
    f"t AS (SELECT doc_id, lang, regexp_replace(text, '[^{_D_OTHERS}]', ' ', 'gs') AS x, "
    f"('0x' || substr(md5('lang:' || CAST(doc_id AS VARCHAR)), 1, 8))::BIGINT % 10000 < {lg.HELD_OUT} AS held_out FROM documents), "
    "g AS (SELECT doc_id, lang, held_out, unnest(list_transform(range(1, length(x) - 1), lambda i: lower(x[i:i + 2]))) AS gram FROM t), "
    "dg AS (SELECT doc_id, lang, held_out, gram, count(*) AS n FROM g GROUP BY ALL), "
    "c AS (SELECT lang, gram, sum(n) AS n FROM dg WHERE NOT held_out GROUP BY ALL), "
    "tot AS (SELECT lang, sum(n) AS total FROM c GROUP BY lang), "
    "p AS (SELECT k.gram, tot.lang AS cand, log10((coalesce(c.n, 0) + 0.5) / (total + 0.5 * " + str(len(lg.ALPHABET) ** 3) + ")) AS w "
    "FROM (SELECT DISTINCT gram FROM dg) k CROSS JOIN tot LEFT JOIN c ON c.gram = k.gram AND c.lang = tot.lang), "
    "s AS (SELECT doc_id, cand, sum(n * w) AS score, sum(n)::BIGINT AS n_grams FROM dg JOIN p ON dg.gram = p.gram GROUP BY ALL), "
    "b AS (SELECT doc_id, n_grams, list(cand ORDER BY score DESC, cand)[1] AS detected, list(score ORDER BY score DESC) AS o FROM s GROUP BY ALL), "
    "r AS (SELECT t.doc_id, t.lang, b.detected, round((o[1] - o[2]) / b.n_grams, 6) AS margin, coalesce(b.n_grams, 0) AS n_grams, t.held_out "
    "FROM t LEFT JOIN b ON t.doc_id = b.doc_id)")


@query("language_detect", oracle(f"WITH {_D_DETECT} SELECT * FROM r"))
def language_detect(spark, sf_dir):
    """The language that each whole text looks like, with the lead over the next."""
    return lg.detect_languages(Views(spark, sf_dir).documents)


@query("language_mismatch", oracle(
    f"WITH {_D_DETECT} SELECT lang, held_out, count(*) AS n_docs, count(detected) AS n_judged, "
    "count(*) FILTER (detected <> lang) AS n_mismatch, round(count(*) FILTER (detected = lang) / nullif(count(detected), 0), 6) AS accuracy "
    "FROM r GROUP BY lang, held_out"))
def language_mismatch(spark, sf_dir):
    """Rows whose text looks like another language than the given one, by language, learned from and held out."""
    d = lg.detect_languages(Views(spark, sf_dir).documents)
    same = F.col("detected") == F.col("lang")
    return d.groupBy("lang", "held_out").agg(
        F.count(F.lit(1)).alias("n_docs"), F.count("detected").alias("n_judged"), F.count_if(~same).alias("n_mismatch"),
        F.round(F.try_divide(F.count_if(same), F.count("detected")), 6).alias("accuracy"))


@query("language_filter", oracle("SELECT doc_id FROM documents WHERE lang = 'en'"))
def language_filter(spark, sf_dir):
    return Views(spark, sf_dir).documents.where(F.col("lang") == "en").select("doc_id")


@query("encoding_issues", oracle(
    "SELECT source, count(*) AS n_docs, "
    "CAST(sum(CASE WHEN contains(text, '�') THEN 1 ELSE 0 END) AS BIGINT) AS n_replacement, "
    f"CAST(sum(CASE WHEN regexp_matches(text, '{q.CONTROL_CHARS_RE}') THEN 1 ELSE 0 END) AS BIGINT) AS n_control, "
    f"CAST(sum(CASE WHEN regexp_matches(text, '{q.MOJIBAKE_RE}') THEN 1 ELSE 0 END) AS BIGINT) AS n_mojibake "
    "FROM documents GROUP BY source"))
def encoding_issues(spark, sf_dir):
    rep, ctl, moj = q.encoding_flags("text")
    return Views(spark, sf_dir).documents.groupBy("source").agg(
        F.count(F.lit(1)).alias("n_docs"), F.sum(rep.cast("bigint")).alias("n_replacement"),
        F.sum(ctl.cast("bigint")).alias("n_control"), F.sum(moj.cast("bigint")).alias("n_mojibake"))


def _d_norm(x: str) -> str:
    return f"array_to_string({d_tokens('lower(' + x + ')')}, ' ')"


@query("pair_difference", oracle(
    "SELECT pair_id, " + _d_norm("chosen") + " = " + _d_norm("rejected") + " AS identical, "
    "round(CASE WHEN len(list_distinct(list_concat(ta, tb))) = 0 THEN 1.0 ELSE "
    "len(list_intersect(ta, tb)) / len(list_distinct(list_concat(ta, tb))) END, 6) AS jaccard, "
    "round(CASE WHEN greatest(length(chosen), length(rejected)) = 0 THEN 1.0 ELSE "
    "least(length(chosen), length(rejected)) / greatest(length(chosen), length(rejected)) END, 6) AS length_ratio "
    f"FROM (SELECT *, list_distinct({d_tokens('chosen')}) AS ta, list_distinct({d_tokens('rejected')}) AS tb "
    "FROM preference_pairs) p", "preference_pairs"))
def pair_difference(spark, sf_dir):
    p = Views(spark, sf_dir).preference_pairs
    return p.select("pair_id", *q.pair_difference("chosen", "rejected"))


@query("chat_structure_check", oracle(
    "SELECT conv_id, count(*) AS n_turns, "
    "arg_min(role, turn) = 'system' AS starts_with_system, "
    "NOT bool_or(role = 'system' AND turn > first_turn) AS system_only_first, "
    "NOT bool_or(prev_role = role) AS alternates, "
    "arg_max(role, turn) = 'assistant' AS ends_with_assistant, "
    "bool_and(role IN ('system', 'user', 'assistant')) AS roles_known, "
    "arg_max(role, turn) = 'assistant' AND NOT bool_or(prev_role = role) "
    "AND NOT bool_or(role = 'system' AND turn > first_turn) "
    "AND bool_and(role IN ('system', 'user', 'assistant')) AS valid "
    "FROM (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS prev_role, "
    "min(turn) OVER (PARTITION BY conv_id) AS first_turn FROM conversations) t GROUP BY conv_id"))
def chat_structure_check(spark, sf_dir):
    return q.chat_structure(Views(spark, sf_dir).conversations)


@query("quality_label_profile", oracle(
    "SELECT lang, source, count(*) AS n_docs, count(l.doc_id) AS n_labeled, "
    "round(avg(l.quality), 6) AS quality_rate, round(avg(l.toxic), 6) AS toxic_rate "
    "FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY CUBE (lang, source)"))
def quality_label_profile(spark, sf_dir):
    v = Views(spark, sf_dir)
    j = v.documents.select("doc_id", "lang", "source").join(
        v.labels.select(F.col("doc_id").alias("l_doc_id"), "quality", "toxic"),
        F.col("doc_id") == F.col("l_doc_id"), "left")
    return j.cube("lang", "source").agg(
        F.count(F.lit(1)).alias("n_docs"), F.count("l_doc_id").alias("n_labeled"),
        F.round(F.avg("quality"), 6).alias("quality_rate"), F.round(F.avg("toxic"), 6).alias("toxic_rate"))


@query("quality_gate", oracle(
    f"SELECT coalesce(reason, 'kept') AS reason, count(*) AS n_rows FROM ("
    f"SELECT CASE WHEN length({d_strip('text')}) = 0 THEN 'empty' "
    f"WHEN {d_ntok('text')} < 10 THEN 'too_short' WHEN {d_ntok('text')} > 2048 THEN 'too_long' "
    f"WHEN contains(text, '�') OR regexp_matches(text, '{q.CONTROL_CHARS_RE}') "
    f"OR regexp_matches(text, '{q.MOJIBAKE_RE}') THEN 'encoding' "
    f"WHEN doc_id <> min(doc_id) OVER (PARTITION BY text) THEN 'duplicate' END AS reason FROM documents) g "
    f"GROUP BY 1"))
def quality_gate(spark, sf_dir):
    """One pass of the pre-training checks with the first failing reason per row."""
    rows = q.gate_reasons(Views(spark, sf_dir).documents, "doc_id", "text")
    # Copies have one digest and one reason: all but one of a digest's passing rows are duplicates.
    g = rows.groupBy("digest", "reason").agg(F.count(F.lit(1)).alias("n"))
    parts = F.when(F.col("reason").isNotNull(), F.array(F.struct(F.col("reason"), F.col("n")))).otherwise(
        F.array(F.struct(F.lit("kept").alias("reason"), F.lit(1).cast("bigint").alias("n")),
                F.struct(F.lit("duplicate").alias("reason"), (F.col("n") - 1).alias("n"))))
    return (g.select(F.inline(parts)).where("n > 0").groupBy("reason").agg(F.sum("n").alias("n_rows")))


@query("quality_gate_rows", oracle(
    f"SELECT doc_id, coalesce(reason, 'kept') AS reason FROM (SELECT doc_id, "
    f"CASE WHEN length({d_strip('text')}) = 0 THEN 'empty' "
    f"WHEN {d_ntok('text')} < 10 THEN 'too_short' WHEN {d_ntok('text')} > 2048 THEN 'too_long' "
    f"WHEN contains(text, '�') OR regexp_matches(text, '{q.CONTROL_CHARS_RE}') "
    f"OR regexp_matches(text, '{q.MOJIBAKE_RE}') THEN 'encoding' "
    f"WHEN doc_id <> min(doc_id) OVER (PARTITION BY text) THEN 'duplicate' END AS reason FROM documents) g"))
def quality_gate_rows(spark, sf_dir):
    """Kept and rejected rows with their reason; ``q.gate`` returns the rows themselves."""
    return q.gate_rows(Views(spark, sf_dir).documents, "doc_id", "text")
