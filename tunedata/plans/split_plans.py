"""E family: splits, samples, mixtures and batch plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from tunedata.operators import splits as sp
from tunedata.operators import sweep as sw
from tunedata.plans.registry import query
from tunedata.plans.views import Views, oracle


def d_bucket(key: str, seed: int = sp.SEED) -> str:
    return f"(('0x' || substr(md5('{seed}:' || CAST({key} AS VARCHAR)), 1, 8))::BIGINT % 10000)"


def d_policy(n: str) -> str:
    return f"(CASE WHEN {n} < 1000 THEN 0.0 WHEN {n} > 10000 THEN 0.10 ELSE 0.05 END)"


_POLICY_TABLES = ["documents", "conversations", "benchmark", "labels", "events", "lineitem", "sft_pairs"]


@query("split_policy", oracle(
    "SELECT table_name, num_rows, " + d_policy("num_rows") + " AS val_fraction FROM ("
    + " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS num_rows FROM {t}" for t in _POLICY_TABLES)
    + ") c", "sft_pairs"))
def split_policy(spark, sf_dir):
    v = Views(spark, sf_dir)
    out = None
    for t in _POLICY_TABLES:
        c = v.get(t).agg(F.count(F.lit(1)).alias("num_rows")).select(F.lit(t).alias("table_name"), "num_rows")
        out = c if out is None else out.unionByName(c)
    return out.withColumn("val_fraction", sp.split_policy(F.col("num_rows")))


@query("train_val_split", oracle(
    f"SELECT doc_id, CASE WHEN {d_bucket('doc_id')} < {d_policy('(SELECT count(*) FROM documents)')} * 10000 "
    "THEN 'val' ELSE 'train' END AS split FROM documents"))
def train_val_split(spark, sf_dir):
    return sp.train_val_split(Views(spark, sf_dir).documents.select("doc_id"), "doc_id")


@query("conversation_split", oracle(
    f"SELECT conv_id, turn, CASE WHEN {d_bucket('conv_id')} < 1000 THEN 'val' ELSE 'train' END AS split "
    "FROM conversations"))
def conversation_split(spark, sf_dir):
    """Every turn takes its conversation's bucket: computed per row, no grouping or shuffle."""
    c = Views(spark, sf_dir).conversations.select("conv_id", "turn")
    return sp.train_val_split(c, "conv_id", fraction=0.10)


@query("split_leakage", oracle(
    f"WITH s AS (SELECT doc_id, text, CASE WHEN {d_bucket('doc_id')} < 1000 THEN 'val' ELSE 'train' END AS split "
    "FROM documents) SELECT v.doc_id FROM s v WHERE v.split = 'val' "
    "AND EXISTS (SELECT 1 FROM s t WHERE t.split = 'train' AND t.text = v.text)"))
def split_leakage(spark, sf_dir):
    d = sp.train_val_split(Views(spark, sf_dir).documents.select("doc_id", "text"), "doc_id", fraction=0.10)
    return sp.leakage(d, "split", "text").select("doc_id")


@query("head_sample", oracle("SELECT item_id, question FROM mcq_items ORDER BY item_id LIMIT 25", "mcq_items"))
def head_sample(spark, sf_dir):
    return sp.head_sample(Views(spark, sf_dir).mcq_items.select("item_id", "question"), "item_id", 25)


@query("stratified_sample", oracle(
    "SELECT item_id, category FROM (SELECT item_id, category, row_number() OVER (PARTITION BY category "
    "ORDER BY md5('3407:' || CAST(item_id AS VARCHAR)), item_id) AS rn FROM mc_predictions) t WHERE rn <= 20",
    "mc_predictions"))
def stratified_sample(spark, sf_dir):
    m = Views(spark, sf_dir).mc_predictions.select("item_id", "category")
    return sp.stratified_sample(m, "category", "item_id", 20)


@query("seeded_shuffle", oracle(
    "SELECT doc_id, row_number() OVER (ORDER BY md5('3407:' || CAST(doc_id AS VARCHAR)), doc_id) AS shuffle_pos "
    "FROM documents"))
def seeded_shuffle(spark, sf_dir):
    return sp.seeded_shuffle(Views(spark, sf_dir).documents.select("doc_id"), "doc_id")


@query("mix_datasets", oracle(
    "SELECT 'task' AS origin, pair_id AS row_id, CAST(length(instruction) AS BIGINT) AS n_chars FROM sft_pairs "
    f"UNION ALL SELECT 'general', doc_id, n_chars FROM documents WHERE {d_bucket('doc_id')} < 3000",
    "sft_pairs"))
def mix_datasets(spark, sf_dir):
    v = Views(spark, sf_dir)
    task = v.sft_pairs.select(F.col("pair_id").alias("row_id"), F.length("instruction").cast("bigint")
                              .alias("n_chars"))
    general = v.documents.select(F.col("doc_id").alias("row_id"), "n_chars")
    return sp.mix_datasets([("task", task, 1.0), ("general", general, 0.3)], "row_id") \
        .select("origin", "row_id", "n_chars")


@query("epochs_and_batches", oracle(
    "SELECT request_id, CAST(p_batch_size * p_grad_accum AS BIGINT) AS effective_batch, "
    "round(CAST(p_max_steps AS DOUBLE) * p_batch_size * p_grad_accum / dataset_rows, 6) AS epochs "
    "FROM plan_requests r JOIN (VALUES " + ", ".join(
        f"('{b}', {str(c).lower()}, {s}, {bs}, {ga})" for b, c, s, bs, ga, *_ in sw.PROFILES)
    + ") AS p(budget, has_cuda, p_max_steps, p_batch_size, p_grad_accum) "
    "ON r.budget = p.budget AND r.has_cuda = p.has_cuda", "plan_requests"))
def epochs_and_batches(spark, sf_dir):
    r = Views(spark, sf_dir).plan_requests
    j = r.join(F.broadcast(sw.profiles(spark)), ["budget", "has_cuda"])
    eff = F.col("p_batch_size") * F.col("p_grad_accum")
    return j.select("request_id", eff.cast("bigint").alias("effective_batch"),
                    F.round(F.col("p_max_steps").cast("double") * eff / F.col("dataset_rows"), 6).alias("epochs"))


@query("batch_assignment", oracle(
    "SELECT doc_id, pos, CAST((pos - 1) // 16 AS BIGINT) AS step, CAST((pos - 1) // 4 AS BIGINT) AS micro_batch "
    "FROM (SELECT doc_id, row_number() OVER (ORDER BY md5('3407:' || CAST(doc_id AS VARCHAR)), doc_id) AS pos "
    "FROM documents) t"))
def batch_assignment(spark, sf_dir):
    return sp.batch_assignment(Views(spark, sf_dir).documents.select("doc_id"), "doc_id", 4, 4)
