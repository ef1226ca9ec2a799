"""D10, D11, D17: near-duplicates, their clusters, and benchmark contamination."""

from __future__ import annotations

from tunedata.operators import contamination as ct
from tunedata.operators import dedup as dd
from tunedata.plans.registry import query
from tunedata.plans.views import Views, oracle

_D_REPS = "reps AS (SELECT min(doc_id) AS doc_id, text FROM documents GROUP BY text)"
_D_SH = ("sh AS (SELECT DISTINCT doc_id, s FROM (SELECT doc_id, unnest(list_transform(range(1, len(w) - 3), "
         "lambda i: array_to_string(w[i:i + 4], ' '))) AS s FROM (SELECT doc_id, string_split(lower(text), ' ') AS w "
         "FROM reps) x) y)")
_D_PAIRS = ("n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id), "
            "pr AS (SELECT a.doc_id AS doc_a, b.doc_id AS doc_b, count(*) AS inter FROM sh a JOIN sh b "
            "ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2), "
            "nd AS (SELECT doc_a, doc_b, inter / (na.n + nb.n - inter) AS jac FROM pr JOIN n na ON pr.doc_a = na.doc_id "
            "JOIN n nb ON pr.doc_b = nb.doc_id WHERE inter / (na.n + nb.n - inter) >= 0.7)")


@query("near_dup_pairs", oracle(
    f"WITH {_D_REPS}, {_D_SH}, {_D_PAIRS} SELECT doc_a, doc_b, round(jac, 6) AS jaccard FROM nd"))
def near_dup_pairs(spark, sf_dir):
    return dd.near_dup_pairs(Views(spark, sf_dir).documents.select("doc_id", "text"))


@query("near_dup_clusters", oracle(
    f"WITH RECURSIVE {_D_REPS}, {_D_SH}, {_D_PAIRS}, "
    "e AS (SELECT doc_a AS a, doc_b AS b FROM nd UNION SELECT doc_b, doc_a FROM nd), "
    "reach(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM reach r JOIN e ON r.b = e.a), "
    "comp AS (SELECT a AS node, least(a, min(b)) AS component FROM reach GROUP BY a), "
    "m AS (SELECT d.doc_id, coalesce(c.component, r.doc_id) AS cluster_id FROM documents d JOIN reps r "
    "ON d.text = r.text LEFT JOIN comp c ON c.node = r.doc_id) "
    "SELECT doc_id, cluster_id FROM m WHERE cluster_id IN (SELECT cluster_id FROM m GROUP BY cluster_id "
    "HAVING count(*) > 1)"))
def near_dup_clusters(spark, sf_dir):
    return dd.near_dup_clusters(Views(spark, sf_dir).documents.select("doc_id", "text"))


@query("contamination", oracle(
    "SELECT d.doc_id, b.item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)"))
def contamination(spark, sf_dir):
    v = Views(spark, sf_dir)
    return ct.contaminated_pairs(v.documents.select("doc_id", "text"), v.benchmark.select("item_id", "text"))


@query("decontaminated", oracle(
    "SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM benchmark b WHERE contains(d.text, b.text))"))
def decontaminated(spark, sf_dir):
    v = Views(spark, sf_dir)
    docs = v.documents.select("doc_id", "text")
    pairs = ct.contaminated_pairs(docs, v.benchmark.select("item_id", "text"))
    return ct.decontaminate(docs, pairs).select("doc_id")
