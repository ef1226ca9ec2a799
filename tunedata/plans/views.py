"""Stand-in views: shapes the reference works on (instruction pairs, run catalogs, eval items),
derived from the provided tables with SQL so that their size grows with the input.

Each view is SQL over ``{name}`` placeholders. On Spark the placeholders are bound to DataFrames
(``spark.sql(text, name=df)``), so every view is an ordinary Catalyst plan over parquet scans. The
same text (or a DuckDB-specific form where array syntax differs) feeds the oracle side as CTEs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tunedata.sources.tables import TABLE_NAMES, Tables

#: Tokens of an item that an evaluation scores: the reference's evaluator truncates its inputs there, so a longer
#: text has a loss over its first tokens only. Evaluations with another limit set another number.
EVAL_MAX_TOKENS = 2048

RUN_DIR_SQL = "concat('run_', lpad(CAST(user_id AS STRING), 6, '0'))"

# name -> (dependencies, portable SQL)
# Four scores from a whole embedding: the sums of its quarters.
FOUR_SCORES = ("transform(sequence(0, 3), k -> aggregate(slice(embedding, k * (size(embedding) div 4) + 1, size(embedding) div 4), "
               "CAST(0 AS DOUBLE), (a, x) -> a + CAST(x AS DOUBLE)))")
D_FOUR_SCORES = "[" + ", ".join(
    f"list_sum(list_transform(embedding[{k} * (len(embedding) // 4) + 1:{k + 1} * (len(embedding) // 4)], lambda x: CAST(x AS DOUBLE)))"
    for k in range(4)) + "]"


PORTABLE: dict[str, tuple[tuple[str, ...], str]] = {
    "sft_pairs": (("conversations",), """
WITH t AS (
  SELECT conv_id, turn, role, text,
         lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS nrole,
         lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS ntext
  FROM {conversations}),
s AS (
  SELECT conv_id, min(CASE WHEN role = 'system' THEN text END) AS sys
  FROM {conversations} GROUP BY conv_id),
p AS (
  SELECT t.conv_id * 100 + t.turn AS pair_id, t.conv_id AS conv_id, t.text AS instruction,
         s.sys AS sys, t.ntext AS output
  FROM t JOIN s ON t.conv_id = s.conv_id
  WHERE t.role = 'user' AND t.nrole = 'assistant')
SELECT pair_id, conv_id, instruction,
       CASE WHEN sys IS NOT NULL THEN sys WHEN pair_id % 5 = 0 THEN '   ' ELSE '' END AS input,
       CASE WHEN pair_id % 37 = 0 THEN '' ELSE output END AS output
FROM p"""),
    "preference_pairs": (("sft_pairs",), """
SELECT pair_id, conv_id, instruction AS prompt, output AS chosen,
       first_value(output) OVER (PARTITION BY conv_id ORDER BY pair_id DESC) AS rejected
FROM {sft_pairs}"""),
    "preference_scores": (("preference_pairs",), """
SELECT pair_id, pair_id % 10 AS step_bucket,
       CAST(length(chosen) AS DOUBLE) / 100 AS chosen_reward,
       CAST(length(rejected) AS DOUBLE) / 100 AS rejected_reward
FROM {preference_pairs}"""),
    "loss_items": (("documents",), f"""
SELECT doc_id AS item_id, lang, source, text,
       least(length(text) - length(replace(text, ' ', '')) + 1, {EVAL_MAX_TOKENS}) AS n_tokens,
       CAST(n_chars % 700 AS DOUBLE) / 100 + CAST(0.5 AS DOUBLE) AS loss
FROM {{documents}}"""),
    "run_steps": (("events",), f"""
SELECT {RUN_DIR_SQL} AS run_dir, user_id AS run_no,
       row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) * 10 AS step,
       ts, value AS loss
FROM {{events}}"""),
    "run_configs": (("events",), f"""
SELECT {RUN_DIR_SQL} AS run_dir, user_id AS run_no,
       concat('base-', CAST(user_id % 4 AS STRING)) AS model,
       concat('ds-', CAST(user_id % 3 AS STRING)) AS dataset,
       CASE WHEN user_id % 3 = 0 THEN CAST(0.0002 AS DOUBLE) ELSE CAST(0.0001 AS DOUBLE) END AS learning_rate,
       CASE user_id % 3 WHEN 0 THEN 8 WHEN 1 THEN 16 ELSE 32 END AS lora_r,
       CASE WHEN user_id % 2 = 0 THEN 16 ELSE 32 END AS lora_alpha,
       CASE WHEN user_id % 6 = 0 THEN 2 ELSE 4 END AS batch_size,
       CASE WHEN user_id % 17 = 0 THEN NULL ELSE max(value) / 100 END AS train_loss,
       count(*) * 10 AS train_time_seconds
FROM {{events}} GROUP BY user_id"""),
    "run_evals": (("events",), f"""
SELECT run_dir, concat(run_dir, '/eval_mmlu.json') AS path, 'mmlu' AS benchmark,
       accuracy, CAST(NULL AS DOUBLE) AS loss
FROM (SELECT {RUN_DIR_SQL} AS run_dir, user_id,
             CAST(sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) AS DOUBLE) / count(*) AS accuracy
      FROM {{events}} GROUP BY user_id) a
WHERE user_id % 5 <> 0
UNION ALL
SELECT {RUN_DIR_SQL},
       concat({RUN_DIR_SQL}, '/eval_custom.json'), 'custom',
       CAST(NULL AS DOUBLE), min(value)
FROM {{events}} WHERE user_id % 7 = 0 GROUP BY user_id"""),
    "run_logs": (("events",), f"""
SELECT {RUN_DIR_SQL} AS run_dir, event_id AS line_no, ts,
       CASE WHEN event_type = 'error' AND event_id % 40 = 0 THEN 'RuntimeError: CUDA out of memory'
            WHEN event_type = 'error' AND event_id % 40 = 1 THEN 'train_loss: nan'
            WHEN event_type = 'error' THEN 'warning: retry'
            WHEN event_type = 'purchase' THEN concat('peak_vram_gb: ', CAST(CAST(value AS DECIMAL(10,2)) AS STRING))
            WHEN event_type = 'click' THEN concat('  progress: ', CAST(event_id % 1000 AS STRING), '/1000, accuracy: 0.4200')
            WHEN event_type = 'signup' AND event_id % 50 = 0 THEN 'INFO starting'
            ELSE concat('step: ', CAST(event_id AS STRING)) END AS line
FROM {{events}}"""),
    # Sweep requests, one per run owner in `events`: the planner's inputs vary with the row.
    "plan_requests": (("events",), """
SELECT user_id AS request_id,
       CASE user_id % 5 WHEN 0 THEN 'org/Llama-3.2-1B' WHEN 1 THEN 'org/Qwen2.5-7B'
            WHEN 2 THEN 'org/big-70b' WHEN 3 THEN 'org/Phi-3-mini' ELSE 'org/odd-1.2.3b' END AS model,
       concat('ds-', CAST(user_id % 4 AS STRING)) AS dataset,
       CASE user_id % 4 WHEN 0 THEN 'instruction' WHEN 1 THEN 'chat' WHEN 2 THEN 'text'
            ELSE 'preference' END AS dataset_format,
       count(*) * CASE user_id % 3 WHEN 0 THEN 3 WHEN 1 THEN 300 ELSE 1000 END AS dataset_rows,
       user_id % 3 <> 2 AS has_cuda,
       CASE WHEN user_id % 3 = 2 THEN CAST(NULL AS DOUBLE) WHEN user_id % 2 = 0 THEN CAST(6 AS DOUBLE)
            ELSE CAST(24 AS DOUBLE) END AS available_vram_gb,
       CASE WHEN user_id % 9 < 3 THEN 'quick' WHEN user_id % 9 < 6 THEN 'balanced' ELSE 'thorough' END AS budget,
       CASE WHEN user_id % 27 < 9 THEN CAST(NULL AS DOUBLE) WHEN user_id % 27 < 18 THEN CAST(0.4 AS DOUBLE)
            ELSE CAST(0.72 AS DOUBLE) END AS baseline_metric,
       CAST(user_id % 4 AS INT) AS max_runs
FROM {events} GROUP BY user_id"""),
}

# The column layouts of the dataset shapes the reference recognises, used to
# derive one mixed-format record catalog from `sft_pairs` (record i takes layout i % 13).
CATALOG_LAYOUTS = [
    ["instruction", "input", "output"],
    ["instruction", "output", "content"],
    ["prompt", "completion"],
    ["prompt", "output"],
    ["messages", "source"],
    ["conversations"],
    ["messages", "prompt", "completion"],
    ["prompt", "chosen", "rejected"],
    ["question", "chosen", "rejected"],
    ["text", "prompt", "chosen", "rejected"],
    ["text"],
    ["content"],
    ["a", "b"],
]


def _spark_array_literal(layouts: list[list[str]]) -> str:
    return "array(" + ", ".join(
        "array(" + ", ".join(f"'{c}'" for c in layout) + ")" for layout in layouts) + ")"


def _duck_list_literal(layouts: list[list[str]]) -> str:
    return "[" + ", ".join("[" + ", ".join(f"'{c}'" for c in layout) + "]" for layout in layouts) + "]"


# name -> (dependencies, Spark SQL, DuckDB SQL) where array syntax differs between engines.
SPLIT: dict[str, tuple[tuple[str, ...], str, str]] = {
    "chat_rows": (("conversations",),
        """SELECT conv_id, transform(array_sort(collect_list(struct(turn, role, text))),
                  x -> struct(x.role AS role, x.text AS content)) AS messages
           FROM {conversations} GROUP BY conv_id""",
        """SELECT conv_id, list({'role': role, 'content': text} ORDER BY turn) AS messages
           FROM conversations GROUP BY conv_id"""),
    "mcq_items": (("benchmark",),
        """SELECT item_id, text AS question, transform(sequence(0, 3), k -> array_join(slice(split(text, ' '),
                  k * (size(split(text, ' ')) + 3) div 4 + 1, (k + 1) * (size(split(text, ' ')) + 3) div 4
                  - k * (size(split(text, ' ')) + 3) div 4), ' ')) AS choices,
                  CAST(item_id % 4 AS INT) AS answer FROM {benchmark}""",
        """SELECT item_id, text AS question, [""" + ", ".join(
            f"array_to_string(string_split(text, ' ')[{k} * (len(string_split(text, ' ')) + 3) // 4 + 1:"
            f"{k + 1} * (len(string_split(text, ' ')) + 3) // 4], ' ')" for k in range(4)) + """] AS choices,
                  CAST(item_id % 4 AS INT) AS answer FROM benchmark"""),
    "mc_predictions": (("embeddings",),
        """SELECT vec_id AS item_id, CAST(label % 4 AS INT) AS answer,
                  concat('c', CAST(label AS STRING)) AS category,
                  """ + FOUR_SCORES + """ AS choice_logits FROM {embeddings}""",
        """SELECT vec_id AS item_id, CAST(label % 4 AS INT) AS answer,
                  concat('c', CAST(label AS STRING)) AS category,
                  """ + D_FOUR_SCORES + """ AS choice_logits FROM embeddings"""),
    "category_scores": (("mc_predictions",),
        """SELECT category, CASE WHEN item_id % 2 = 0 THEN 'baseline' ELSE 'tuned' END AS arm,
                  avg(CASE WHEN array_position(choice_logits, array_max(choice_logits)) - 1 = answer
                      THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END) AS accuracy, count(*) AS total
           FROM {mc_predictions} GROUP BY 1, 2""",
        """SELECT category, CASE WHEN item_id % 2 = 0 THEN 'baseline' ELSE 'tuned' END AS arm,
                  avg(CASE WHEN list_position(choice_logits, list_max(choice_logits)) - 1 = answer
                      THEN 1.0 ELSE 0.0 END) AS accuracy, count(*) AS total
           FROM mc_predictions GROUP BY 1, 2"""),
    "column_catalog": (("sft_pairs",),
        f"""SELECT concat('rec_', CAST(pair_id AS STRING)) AS dataset, CAST(p.pos + 1 AS INT) AS ordinal,
                   p.col AS column_name
            FROM {{sft_pairs}}
            LATERAL VIEW posexplode(element_at({_spark_array_literal(CATALOG_LAYOUTS)},
                                               CAST(pair_id % {len(CATALOG_LAYOUTS)} AS INT) + 1)) p AS pos, col""",
        f"""SELECT 'rec_' || CAST(pair_id AS VARCHAR) AS dataset, CAST(g.i AS INTEGER) AS ordinal,
                   layout[g.i] AS column_name
            FROM (SELECT pair_id, {_duck_list_literal(CATALOG_LAYOUTS)}[pair_id % {len(CATALOG_LAYOUTS)} + 1] AS layout
                  FROM sft_pairs) s, generate_series(1, len(layout)) AS g(i)"""),
}


def _deps(name: str) -> tuple[str, ...]:
    if name in PORTABLE:
        return PORTABLE[name][0]
    return SPLIT[name][0]


class Views:
    """Spark side: each view is built once per instance from its dependencies."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.tables = Tables(spark, sf_dir)
        self._cache: dict[str, DataFrame] = {}

    def get(self, name: str) -> DataFrame:
        if name in TABLE_NAMES:
            return self.tables.table(name)
        if name not in self._cache:
            deps = {d: self.get(d) for d in _deps(name)}
            text = PORTABLE[name][1] if name in PORTABLE else SPLIT[name][1]
            self._cache[name] = self.spark.sql(text, **deps)
        return self._cache[name]

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.get(name)


def duck_ctes(*names: str) -> str:
    """``WITH`` clause defining the named views (and their dependencies) for DuckDB."""
    ordered: list[str] = []

    def visit(n: str) -> None:
        if n in TABLE_NAMES or n in ordered:
            return
        for d in _deps(n):
            visit(d)
        ordered.append(n)

    for n in names:
        visit(n)
    parts = []
    for n in ordered:
        if n in PORTABLE:
            deps = PORTABLE[n][0]
            text = PORTABLE[n][1].format(**{d: d for d in deps})
        else:
            text = SPLIT[n][2]
        parts.append(f"{n} AS ({text})")
    return ("WITH " + ",\n".join(parts) + "\n") if parts else ""


def oracle(sql: str, *views: str) -> str:
    """Prefix an oracle query with the CTEs of the views it reads (merging a leading WITH)."""
    head = duck_ctes(*views)
    body = sql.strip()
    if head and body[:5].upper() == "WITH ":
        return head.rstrip() + ",\n" + body[5:]
    return head + body
