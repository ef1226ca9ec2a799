"""C family: row formatters over instruction pairs, chat rows and multiple-choice items."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tunedata.functions.strings import PY_WHITESPACE_CLASS
from tunedata.operators import formatters as fm
from tunedata.plans.registry import query
from tunedata.plans.views import Views, oracle

WS = PY_WHITESPACE_CLASS
D_STRIP = f"regexp_replace(%s, '^{WS}+|{WS}+$', '', 'g')"
NL = "chr(10)"


def d_strip(x: str) -> str:
    return D_STRIP % x


def d_cap(x: str) -> str:
    return f"(upper(left({x}, 1)) || lower(substring({x}, 2)))"


def chat_rows(spark, sf_dir) -> DataFrame:
    return fm.turns_to_messages(Views(spark, sf_dir).conversations)


@query("format_alpaca", oracle(
    f"SELECT pair_id, '### Instruction:' || {NL} || coalesce(instruction, '') || {NL} || {NL} || "
    f"CASE WHEN input IS NOT NULL AND length({d_strip('input')}) > 0 "
    f"THEN '### Input:' || {NL} || input || {NL} || {NL} ELSE '' END || "
    f"'### Response:' || {NL} || coalesce(output, '') AS text FROM sft_pairs", "sft_pairs"))
def format_alpaca(spark, sf_dir):
    p = Views(spark, sf_dir).sft_pairs
    return p.select("pair_id", fm.format_alpaca("instruction", "input", "output").alias("text"))


def _pc_input(spark, sf_dir) -> DataFrame:
    p = Views(spark, sf_dir).sft_pairs
    return p.select("pair_id", F.when(F.col("pair_id") % 3 == 0, F.lit(None)).otherwise(F.col("input"))
                    .alias("prompt"), "instruction", "output")


@query("format_prompt_completion", oracle(
    f"SELECT pair_id, '### Prompt:' || {NL} || coalesce(nullif(prompt, ''), nullif(instruction, ''), '') "
    f"|| {NL} || {NL} || '### Response:' || {NL} || coalesce(nullif(output, ''), '') AS text "
    f"FROM (SELECT pair_id, CASE WHEN pair_id % 3 = 0 THEN NULL ELSE input END AS prompt, instruction, output "
    f"FROM sft_pairs) s", "sft_pairs"))
def format_prompt_completion(spark, sf_dir):
    df = _pc_input(spark, sf_dir)
    return df.select("pair_id", fm.format_prompt_completion(df.columns).alias("text"))


def sharegpt_rows(spark, sf_dir) -> DataFrame:
    """ShareGPT-keyed chat rows (``from``/``value``) with some blank speaker names, from turns."""
    c = Views(spark, sf_dir).conversations
    frm = (F.when(F.col("turn") % 7 == 3, F.lit(""))
           .when(F.col("role") == "user", F.lit("human"))
           .when(F.col("role") == "assistant", F.lit("gpt")).otherwise(F.col("role")))
    return (c.groupBy("conv_id")
            .agg(F.array_sort(F.collect_list(F.struct("turn", frm.alias("from"), F.col("text").alias("value"))))
                 .alias("_t"))
            .select("conv_id", F.transform("_t", lambda x: F.struct(x["from"].alias("from"),
                                                                    x["value"].alias("value")))
                    .alias("conversations")))


_D_SHAREGPT = ("(SELECT conv_id, string_agg(CASE WHEN turn % 7 = 3 THEN 'user' WHEN role = 'user' THEN 'human' "
               "WHEN role = 'assistant' THEN 'gpt' ELSE role END, ',' ORDER BY turn) AS roles, "
               "CAST(count(*) AS BIGINT) AS n_messages, CAST(sum(length(text)) AS BIGINT) AS content_chars "
               "FROM conversations GROUP BY conv_id) s")


@query("normalize_messages", oracle(f"SELECT conv_id, n_messages, roles, content_chars FROM {_D_SHAREGPT}"))
def normalize_messages(spark, sf_dir):
    rows = sharegpt_rows(spark, sf_dir)
    m = fm.normalize_messages("conversations", fm.element_fields_of(rows, "conversations"))
    return rows.select("conv_id", m.alias("m")).select(
        "conv_id", F.size("m").cast("bigint").alias("n_messages"),
        F.array_join(F.transform("m", lambda x: x["role"]), ",").alias("roles"),
        F.aggregate("m", F.lit(0).cast("bigint"), lambda acc, x: acc + F.length(x["content"])).alias(
            "content_chars"))


@query("map_role_names", oracle(
    "SELECT conv_id, string_agg(CASE WHEN turn % 7 = 3 THEN 'user' ELSE role END, ',' ORDER BY turn) AS roles "
    "FROM conversations GROUP BY conv_id"))
def map_role_names(spark, sf_dir):
    rows = sharegpt_rows(spark, sf_dir)
    m = fm.normalize_messages("conversations", fm.element_fields_of(rows, "conversations"))
    mapped = fm.map_role_names(m, {"human": "user", "gpt": "assistant"})
    return rows.select("conv_id", F.array_join(F.transform(mapped, lambda x: x["role"]), ",").alias("roles"))


@query("format_messages", oracle(
    f"SELECT conv_id, coalesce(string_agg('### ' || {d_cap('role')} || ':' || {NL} || text, {NL} || {NL} "
    f"ORDER BY turn) FILTER (WHERE text <> ''), '') AS text FROM conversations GROUP BY conv_id"))
def format_messages(spark, sf_dir):
    rows = chat_rows(spark, sf_dir)
    return rows.select("conv_id", fm.format_messages(rows, "messages").alias("text"))


@query("render_chat_template", oracle(
    "SELECT conv_id, '<|begin_of_text|>' || string_agg('<|start_header_id|>' || role || '<|end_header_id|>' "
    f"|| {NL} || {NL} || text || '<|eot_id|>', '' ORDER BY turn) AS text "
    "FROM conversations GROUP BY conv_id"))
def render_chat_template(spark, sf_dir):
    rows = chat_rows(spark, sf_dir)
    norm = fm.normalize_messages("messages", fm.element_fields_of(rows, "messages"))
    return rows.select("conv_id", fm.render_chat_template(norm, "llama3").alias("text"))


# Published layouts written as templates; they give the text of the named ones.
SHIPPED_TEMPLATES = {
    "llama3": "{{ bos_token }}{% for message in messages %}{{ '<|start_header_id|>' + message['role'] + '<|end_header_id|>\\n\\n' + message['content'] + '<|eot_id|>' }}"
              "{% endfor %}{% if add_generation_prompt %}{{ '<|start_header_id|>assistant<|end_header_id|>\\n\\n' }}{% endif %}",
    "chatml": "{% for message in messages %}{{'<|im_start|>' + message.role + '\\n' + message.content + '<|im_end|>' + '\\n'}}{% endfor %}"
              "{% if add_generation_prompt %}{{ '<|im_start|>assistant\\n' }}{% endif %}",
    "zephyr": "{% for message in messages %}\n{% if message['role'] == 'user' %}\n{{ '<|user|>\\n' + message['content'] + eos_token + '\\n' }}"
              "{% elif message['role'] == 'system' %}\n{{ '<|system|>\\n' + message['content'] + eos_token + '\\n' }}"
              "{% else %}{{ '<|' ~ message['role'] ~ '|>\\n' ~ message['content'] ~ eos_token ~ '\\n' }}{% endif %}\n{% endfor %}",
}
_D_TURNS = "FROM conversations GROUP BY conv_id"


@query("compile_chat_template", oracle(
    "SELECT conv_id, 'llama3' AS layout, '<|begin_of_text|>' || string_agg('<|start_header_id|>' || role || '<|end_header_id|>' || "
    f"{NL} || {NL} || text || '<|eot_id|>', '' ORDER BY turn) AS text {_D_TURNS} UNION ALL "
    f"SELECT conv_id, 'chatml', string_agg('<|im_start|>' || role || {NL} || text || '<|im_end|>' || {NL}, '' ORDER BY turn) || '<|im_start|>assistant' || {NL} {_D_TURNS} UNION ALL "
    f"SELECT conv_id, 'zephyr', string_agg('<|' || role || '|>' || {NL} || text || '</s>' || {NL}, '' ORDER BY turn) {_D_TURNS}"))
def compile_chat_template(spark, sf_dir):
    """Templates as models ship them, turned into column expressions."""
    from tunedata.operators import chat_templates as ctp

    rows = chat_rows(spark, sf_dir)
    norm = rows.select("conv_id", fm.normalize_messages("messages", fm.element_fields_of(rows, "messages")).alias("m"))
    texts = {"llama3": ctp.compile_template(SHIPPED_TEMPLATES["llama3"], F.col("m"), bos_token="<|begin_of_text|>"),
             "chatml": ctp.compile_template(SHIPPED_TEMPLATES["chatml"], F.col("m"), add_generation_prompt=True),
             "zephyr": ctp.compile_template(SHIPPED_TEMPLATES["zephyr"], F.col("m"), eos_token="</s>")}
    return norm.select("conv_id", F.inline(F.array(*[F.struct(F.lit(k).alias("layout"), t.alias("text")) for k, t in texts.items()])))


@query("register_chat_template", oracle(
    "SELECT conv_id, '<s>' || string_agg('[' || role || '] ' || text || ';', '' ORDER BY turn) AS text "
    "FROM conversations GROUP BY conv_id"))
def register_chat_template(spark, sf_dir):
    """A caller's own template."""
    rows = chat_rows(spark, sf_dir)
    norm = fm.normalize_messages("messages", fm.element_fields_of(rows, "messages"))
    own = fm.chat_template("<s>", "[", "] ", ";")
    return rows.select("conv_id", fm.render_chat_template(norm, own).alias("text"))


@query("register_formatter", oracle("SELECT 'doc: ' || text AS text FROM documents"))
def register_formatter(spark, sf_dir):
    """A caller's own formatter for one route."""
    own = {"passthrough": lambda df, field: F.concat(F.lit("doc: "), F.col(field))}
    return fm.format_sft(Views(spark, sf_dir).documents, formatters=own)


@query("slugify", oracle(
    "SELECT page_id, coalesce(nullif(regexp_replace(regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), "
    "'ml-rd-project') AS slug FROM pages"))
def slugify(spark, sf_dir):
    from tunedata.functions.strings import slugify as slug

    return Views(spark, sf_dir).pages.select("page_id", slug("url").alias("slug"))


@query("turns_to_messages", oracle(
    "SELECT conv_id, CAST(count(*) AS BIGINT) AS n_messages, string_agg(role, ',' ORDER BY turn) AS roles, "
    "arg_min(text, turn) AS first_content FROM conversations GROUP BY conv_id"))
def turns_to_messages(spark, sf_dir):
    rows = chat_rows(spark, sf_dir)
    return rows.select("conv_id", F.size("messages").cast("bigint").alias("n_messages"),
                       F.array_join(F.transform("messages", lambda x: x["role"]), ",").alias("roles"),
                       F.get("messages", 0)["content"].alias("first_content"))


@query("history_to_messages", oracle(
    "SELECT conv_id, CAST(sum(CASE WHEN rn > 1 AND output <> '' THEN 2 ELSE 1 END) AS BIGINT) AS n_messages, "
    "coalesce(string_agg(CASE WHEN output <> '' THEN 'user,assistant' ELSE 'user' END, ',' ORDER BY pair_id) "
    "FILTER (WHERE rn > 1) || ',', '') || 'user' AS roles, "
    "arg_min(instruction, rn) AS last_message "
    "FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY pair_id DESC) AS rn FROM sft_pairs) s "
    "GROUP BY conv_id", "sft_pairs"))
def history_to_messages(spark, sf_dir):
    p = Views(spark, sf_dir).sft_pairs
    g = p.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(
        "pair_id", F.col("instruction").alias("user"), F.col("output").alias("bot")))).alias("pairs"))
    hist = F.slice("pairs", 1, F.size("pairs") - 1)
    msg = F.element_at("pairs", -1)["user"]
    m = fm.history_to_messages(hist, msg)
    return g.select("conv_id", F.size(m).cast("bigint").alias("n_messages"),
                    F.array_join(F.transform(m, lambda x: x["role"]), ",").alias("roles"),
                    msg.alias("last_message"))


def _d_choice(i: int, letter: str) -> str:
    return f"CASE WHEN len(choices) >= {i} THEN '{letter}. ' || choices[{i}] || {NL} ELSE '' END"


@query("format_mcq_prompt", oracle(
    f"SELECT item_id, 'Question: ' || question || {NL} || "
    + " || ".join(_d_choice(i + 1, L) for i, L in enumerate("ABCD"))
    + " || 'Answer:' AS prompt FROM mcq_items", "mcq_items"))
def format_mcq_prompt(spark, sf_dir):
    m = Views(spark, sf_dir).mcq_items
    return m.select("item_id", fm.format_mcq_prompt("question", "choices").alias("prompt"))


@query("passthrough_text", oracle("SELECT text FROM documents"))
def passthrough_text(spark, sf_dir):
    return fm.format_sft(Views(spark, sf_dir).documents)


@query("project_text_only", oracle(
    f"SELECT '### Instruction:' || {NL} || coalesce(instruction, '') || {NL} || {NL} || "
    f"CASE WHEN input IS NOT NULL AND length({d_strip('input')}) > 0 "
    f"THEN '### Input:' || {NL} || input || {NL} || {NL} ELSE '' END || "
    f"'### Response:' || {NL} || coalesce(output, '') AS text FROM sft_pairs", "sft_pairs"))
def project_text_only(spark, sf_dir):
    p = Views(spark, sf_dir).sft_pairs.select("instruction", "input", "output")
    return fm.format_sft(p)


@query("preference_rows", oracle("SELECT prompt, chosen, rejected FROM preference_pairs", "preference_pairs"))
def preference_rows(spark, sf_dir):
    return fm.preference_rows(Views(spark, sf_dir).preference_pairs)


@query("preference_rows_question", oracle("SELECT prompt, chosen, rejected FROM preference_pairs", "preference_pairs"))
def preference_rows_question(spark, sf_dir):
    """A question/chosen/rejected set through the rename option."""
    asked = Views(spark, sf_dir).preference_pairs.withColumnRenamed("prompt", "question")
    return fm.preference_rows(asked, rename_question=True)
