"""Registered queries of the operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tunedata.llm.common import collapse_blanks, table, text_of

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return deco


@register("op9_exact_dedup", """
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS norm FROM documents),
g AS (SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.norm) AS text_sha256
FROM t JOIN g ON t.norm = g.norm
""")
def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tunedata.llm.exact_dedup import exact_groups

    digest = F.sha2(collapse_blanks(text_of("text")), 256)
    return exact_groups(table(spark, sf_dir, "documents"), carry={"text_sha256": digest}).select(
        "doc_id", "keep_id", "group_size", "kept", "text_sha256")


@register("op3_decontamination", """
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[i : i + least(13, len(w)) - 1], ' ') AS gram
       FROM (SELECT item_id, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
ns AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS gram
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, ns WHERE len(w) >= n)),
h AS (SELECT doc_id, i, dw.n, item_id FROM dw JOIN bw ON dw.gram = bw.gram AND dw.n = bw.n),
p AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY doc_id),
it AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS items FROM h GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(p.n_hit, 0) AS n_hit, coalesce(it.n_items, 0) AS n_items,
       sha256(coalesce(it.items, '')) AS items_sha256, coalesce(p.n_hit, 0) > 0 AND 20 * coalesce(p.n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN p ON d.doc_id = p.doc_id LEFT JOIN it ON d.doc_id = it.doc_id
""")
def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tunedata.llm.decontaminate import contamination_hits, is_contaminated

    hits = contamination_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return hits.select(F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
                       F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
                       is_contaminated().alias("contaminated"))


URL_RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"),
             ("allow", "com/fr/"), ("block", "com/de/")]


@register("op1_url_filter", """
WITH u AS (SELECT page_id,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
r AS (SELECT * FROM (VALUES ('allow', 'org/', 'org', '/'), ('block', 'example.org/es/', 'example.org', '/es/'),
    ('block', 'example.org/en/1', 'example.org', '/en/1'), ('allow', 'com/fr/', 'com', '/fr/'),
    ('block', 'com/de/', 'com', '/de/')) AS t(action, rule, rhost, rpath)),
m AS (SELECT u.page_id, max_by(struct_pack(action := r.action, rule := r.rule), length(r.rhost) * 100000 + length(r.rpath)) AS hit
      FROM u JOIN r ON (u.host = r.rhost OR ends_with(u.host, '.' || r.rhost)) AND starts_with(u.path, r.rpath) GROUP BY u.page_id)
SELECT u.page_id, u.host, u.path, m.hit.rule AS rule, coalesce(m.hit.action, 'allow') AS verdict
FROM u LEFT JOIN m ON u.page_id = m.page_id
""")
def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tunedata.llm.url_filter import filter_urls

    return filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES).select(
        "page_id", "host", "path", "rule", "verdict")


@register("op7_mixing")
def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tunedata.llm.mixing import mix

    taken, _ = mix(table(spark, sf_dir, "documents"))
    return taken.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


@register("op10_quality_classifier")
def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tunedata.llm.site_quality import score_quality

    scored = score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.withColumnRenamed("id", "doc_id")


@register("op6_html_extract")
def op6_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tunedata.llm.html_extract import extract_text

    found = extract_text(table(spark, sf_dir, "pages"))
    return found.select(F.col("id").alias("page_id"), "url", "text", F.char_length("text").cast("bigint").alias("n_chars"))


@register("op8_minhash_near_dedup")
def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tunedata.llm.minhash_dedup import near_components

    return near_components(table(spark, sf_dir, "documents"), percent=85).withColumnRenamed("id", "doc_id")


@register("op4_toxicity")
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tunedata.llm.toxicity import score

    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).withColumnRenamed("id", "doc_id")


@register("op5_lm_score")
def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tunedata.llm.lm_score import score

    return score(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


@register("op2_span_dedup")
def op2_span_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tunedata.llm.span_dedup import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


# CRC-32 of a decimal id, bit by bit; levels of a tree as lists; a fold per document up those lists.
@register("op13_merkle_manifest", """
WITH RECURSIVE d AS (
    SELECT doc_id, lang, CASE WHEN doc_id IS NULL THEN FALSE ELSE xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT)),
            lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda r, z: xor(r >> 1, 3988292384 * (r & 1)))), 4294967295) % 7 = 0 END AS hit,
        [CASE WHEN doc_id IS NULL THEN '-' ELSE strlen(doc_id::VARCHAR) || ':' || doc_id END, coalesce(strlen(source) || ':' || source, '-'), coalesce(strlen(lang) || ':' || lang, '-')] AS head,
        coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS n0, coalesce(strlen((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1), '-') AS n1,
        coalesce(strlen(text) || ':' || text, '-') AS body FROM documents),
leaves AS (SELECT doc_id, coalesce('=' || lang, '') AS tree, sha256(array_to_string(head, '') || n0 || body) AS leaf,
        sha256(array_to_string(head, '') || CASE WHEN hit THEN n1 ELSE n0 END || body) AS now FROM d),
placed AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM leaves),
lv AS (SELECT tree, 0 AS lvl, list(leaf ORDER BY pos) AS nodes FROM placed GROUP BY tree
    UNION ALL
    SELECT tree, lvl + 1, list_transform(range(0, len(nodes), 2), lambda i: sha256(array_to_string(nodes[i + 1 : i + 2], ''))) FROM lv WHERE len(nodes) > 1),
subs AS (SELECT tree, lvl AS height, nodes[1] AS subroot, row_number() OVER (ORDER BY tree) - 1 AS pos FROM lv WHERE len(nodes) = 1),
fv AS (SELECT 0 AS lvl, list(subroot ORDER BY pos) AS nodes FROM subs
    UNION ALL
    SELECT lvl + 1, list_transform(range(0, len(nodes), 2), lambda i: sha256(array_to_string(nodes[i + 1 : i + 2], ''))) FROM fv WHERE len(nodes) > 1),
top AS (SELECT nodes[1] AS root FROM fv WHERE len(nodes) = 1),
steps AS (SELECT p.tree, p.pos, lv.lvl, (p.pos >> lv.lvl) % 2 = 1 AS odd, lv.nodes[xor(p.pos >> lv.lvl, 1) + 1] AS sib
        FROM placed p JOIN lv ON p.tree = lv.tree WHERE len(lv.nodes) > 1
    UNION ALL
    SELECT p.tree, p.pos, s.height + fv.lvl, (s.pos >> fv.lvl) % 2 = 1, fv.nodes[xor(s.pos >> fv.lvl, 1) + 1]
        FROM placed p JOIN subs s ON p.tree = s.tree CROSS JOIN fv WHERE len(fv.nodes) > 1),
paths AS (SELECT p.doc_id, p.tree, p.leaf, p.now, coalesce(list(struct_pack(odd := s.odd, sib := coalesce(s.sib, '')) ORDER BY s.lvl) FILTER (s.lvl IS NOT NULL), []) AS path
        FROM placed p LEFT JOIN steps s ON p.tree = s.tree AND p.pos = s.pos GROUP BY p.doc_id, p.tree, p.leaf, p.now, p.pos),
folds AS (SELECT doc_id, tree, leaf, now, path, 0 AS done FROM paths
    UNION ALL
    SELECT doc_id, tree, leaf, CASE WHEN path[done + 1].odd THEN sha256(path[done + 1].sib || now) ELSE sha256(now || path[done + 1].sib) END, path, done + 1
        FROM folds WHERE done < len(path))
SELECT f.doc_id, f.leaf, s.subroot, t.root, sha256(array_to_string(list_transform(f.path, lambda x: x.sib), '')) AS proof_sha256,
    f.now AS folded_root, f.now = t.root AS verified
FROM folds f JOIN subs s ON f.tree = s.tree CROSS JOIN top t WHERE f.done = len(f.path)
""")
def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tunedata.llm.merkle import build_manifest, check_leaves

    tampered = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    manifest = build_manifest(table(spark, sf_dir, "documents"), changed={"n_chars": F.col("n_chars") + 1}, when=tampered)
    return check_leaves(manifest).withColumnRenamed("id", "doc_id")


@register("op12_embedding_whitening")
def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tunedata.llm.whitening import whiten

    found = whiten(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")
    return found.withColumn("deviation", F.col("deviation").try_cast("bigint"))


@register("op11_personal_data")
def op11_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tunedata.llm.pii import find_personal

    found = find_personal(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_email", "n_ip", "n_card", "n_phone",
                        F.sha2("base", 256).alias("base_sha256"), "spans", "n_added")
