"""The reference's own test cases, re-expressed over DataFrames, plus the semantic quirks."""

import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from tunedata.operators import catalog as cat
from tunedata.operators import quality as q
from tunedata.operators import runs as rn
from tunedata.operators import sweep as sw
from tunedata.operators.formatters import format_messages, format_sft, turns_to_messages
from tunedata.sources import runs as rs
from tunedata.sources.datasets import read_dataset


def _one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


# ------------------------------------------------------------------ dataset summary / format
def test_summary_detects_instruction(spark):
    df = spark.createDataFrame([(i, f"Name a river {i}", "", f"river {i}") for i in range(420)],
                               "id long, instruction string, input string, output string")
    s = _one(q.dataset_summary(df.drop("id"), "local", order_by="instruction"))
    assert s.format == "instruction"
    assert any("small" in r for r in s.risks)
    assert s.recommendations == ["SFT is a sensible starting point for the first run."]
    assert "input" in " ".join(s.risks)  # '' is an empty value


def test_summary_detects_chat(spark):
    df = spark.createDataFrame([([{"role": "user", "content": f"Which day? {k}"}, {"role": "assistant", "content": "Monday"}],
                                 "x") for k in range(1500)],
                               "messages array<struct<role:string,content:string>>, source string")
    s = _one(q.dataset_summary(df, "chat", order_by="source"))
    assert s.format == "chat"
    assert s.recommendations == ["Validate chat template compatibility before training."]
    assert not any("small" in r for r in s.risks)


def test_preference_format_and_missing(spark):
    c = cat.catalog_of({"p": spark.createDataFrame([("a", "b", "c")], "prompt string, chosen string, rejected string"),
                        "q": spark.createDataFrame([("a", "b", "c")], "question string, chosen string, rejected string")})
    r = {x.dataset: x for x in cat.classify_catalog(c).collect()}
    assert r["p"].format == "preference" and r["q"].format == "preference"
    assert r["q"].missing_preference == ["prompt"]  # quirk Q9


# ------------------------------------------------------------------ VRAM and LoRA
@pytest.mark.parametrize("size,q4,batch,seq,lo,hi,expect", [
    (7.0, True, 4, 2048, 3, 25, 3.7), (1.0, False, 4, 2048, 1.5, 12, 2.1), (70.0, True, 1, 512, 30, 1e9, 35.9)])
def test_vram_estimates(spark, size, q4, batch, seq, lo, hi, expect):
    df = spark.range(1).select(F.lit(size).alias("s"))
    est = sw.estimate_vram(F.col("s"), F.lit(16), F.lit(batch), F.lit(seq), F.lit(q4))
    total = _one(df.select(est["total_gb"].alias("t"))).t
    assert lo <= total <= hi and total == expect


@pytest.mark.parametrize("r,alpha,n", [(16, 8, 1), (16, 24, 1), (16, 32, 0), (32, 64, 0)])
def test_lora_warnings(spark, r, alpha, n):
    w = _one(spark.range(1).select(sw.lora_warnings(F.lit(r), F.lit(alpha)).alias("w"))).w
    assert len(w) == n


def test_parse_model_size_quirks(spark):
    df = spark.createDataFrame([("org/Llama-3.2-1B",), ("x/odd-1.2.3b",), ("x/Phi-3-mini",), ("a/b-70b",)], "m string")
    got = [r.s for r in df.select(sw.parse_model_size("m").alias("s")).collect()]
    assert got == [1.0, 7.0, 7.0, 70.0]  # Q13: 1.2.3b falls back to 7.0


def test_nearest_hidden_dim_ties(spark):
    df = spark.createDataFrame([(2.0,), (10.5,), (5.0,)], "s double")
    got = [r.h for r in df.select(sw.nearest_hidden_dim(F.col("s")).alias("h")).collect()]
    assert got == [2048, 4096, 3200]


# ------------------------------------------------------------------ plan (through the registered plan)
def test_plan_rules(spark):
    from tunedata.plans import sweep_plans as sp

    g = sp._grid(sp.planned(spark, "/root/testdata/sf0.01"))
    rows = g.collect()
    chat = [r for r in rows if r.dataset_format == "chat" and r.name == "run_001"]
    assert chat and all(r.learning_rate == 1e-4 for r in chat)
    pref = [r for r in rows if r.dataset_format == "preference"]
    assert pref and all(r.trainer == "dpo" and r.method in ("dpo", "orpo") for r in pref)


# ------------------------------------------------------------------ run tree: rank, diagnosis, quirks
def _write(path, obj):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as fh:
        fh.write(obj if isinstance(obj, str) else json.dumps(obj, indent=2))


@pytest.fixture(scope="module")
def tree():
    root = tempfile.mkdtemp(prefix="tunedata-runs-")
    # Three runs over the same notes: the last two tie on the metric, so that the lower loss decides.
    _write(f"{root}/run_001/run_config.json", {"model": "org/tiny-1b", "dataset": "field-notes", "train_loss": 0.37})
    _write(f"{root}/run_001/eval_mmlu.json", {"accuracy": 0.268})
    _write(f"{root}/run_002/run_config.json", {"model": "org/tiny-1b", "dataset": "field-notes", "train_loss": 2.71})
    _write(f"{root}/run_002/eval_mmlu.json", {"accuracy": 0.633})
    _write(f"{root}/run_008/run_config.json", {"model": "org/mid-8b", "dataset": "field-notes", "train_loss": 0.92})
    _write(f"{root}/run_008/eval_mmlu.json", {"accuracy": 0.633})
    _write(f"{root}/run_003/run_config.json", '{"model": "a", "train_loss": NaN}')
    _write(f"{root}/run_004/run_config.json", {"model": "a", "train_loss": 1.0})
    _write(f"{root}/run_004/eval_custom.json", {"benchmark": "custom", "loss": 2.0, "perplexity": 7.4})
    _write(f"{root}/run_004/eval_mmlu.json", {"accuracy": 0.9})
    _write(f"{root}/run_005/run_config.json", {"model": "a"})
    _write(f"{root}/run_005/eval_mmlu.json", {"accuracy": True})
    _write(f"{root}/run_006/run_config.json", {"model": "a"})
    _write(f"{root}/run_006/eval_mmlu.json", {"accuracy": "0.9"})
    _write(f"{root}/run_x/eval_mmlu.json", {"accuracy": 0.99})
    _write(f"{root}/run_10/run_config.json", {"model": "b"})
    _write(f"{root}/run_9/run_config.json", {"model": "b"})
    _write(f"{root}/run_7/run_config.json", "{not json")
    _write(f"{root}/run_001/stdout.log", "epoch 0 of 2\n[rank 3] allocator gave up: GPU out of memory (wanted 1.50 GiB)\n")
    _write(f"{root}/run_002/stdout.log", "INFO checkpoint written after 40 s\n")
    return root


def test_rank_prefers_accuracy(spark, tree):
    c = rs.scan_run_configs(spark, tree)
    e = rs.scan_eval_artifacts(spark, tree)
    ranked = rn.rank_runs(rn.summaries(c, e).where(F.col("run_dir").isin("run_001", "run_002", "run_008")))
    order = [r.run_dir for r in ranked.orderBy("rank").collect()]
    assert order == ["run_008", "run_002", "run_001"]


def test_primary_metric_quirks(spark, tree):
    e = rs.scan_eval_artifacts(spark, tree)
    pm = {r.run_dir: (r.metric_name, r.primary_metric) for r in rn.primary_metric(e).collect()}
    assert pm["run_004"] == ("loss", -2.0)  # Q2: eval_custom.json sorts first
    assert pm["run_005"] == ("accuracy", 1.0)  # Q3: booleans count as numbers
    assert "run_006" not in pm  # numeric strings do not


def test_scan_skips_runs_without_config_and_flags_corrupt(spark, tree):
    c = {r.run_dir: r for r in rs.scan_run_configs(spark, tree).collect()}
    assert "run_x" not in c
    assert c["run_7"]._corrupt  # Q18: malformed JSON is kept and flagged
    assert c["run_003"].train_loss != c["run_003"].train_loss  # NaN parsed


def test_run_order_is_string_order(spark, tree):
    c = rs.scan_run_configs(spark, tree).where(F.col("run_dir").isin("run_10", "run_9"))
    assert [r.run_dir for r in c.orderBy("run_dir").collect()] == ["run_10", "run_9"]  # Q16


def test_oom_diagnosis_and_info_quirk(spark, tree):
    c = rs.scan_run_configs(spark, tree)
    e = rs.scan_eval_artifacts(spark, tree)
    d = {r.run_dir: r for r in rn.diagnose_runs(rn.summaries(c, e), rn.log_flags(rs.scan_run_logs(spark, tree)))
         .collect()}
    assert rn.ISSUE_OOM in d["run_001"].issues
    assert d["run_001"].next_actions[0] == "Halve batch size before changing other variables."
    assert rn.ISSUE_NAN in d["run_002"].issues  # Q1: "INFO" contains "inf"
    assert rn.ISSUE_LOSS not in d["run_003"].issues  # Q4: NaN is not > 3.0


def test_missing_root_is_empty(spark):
    assert rs.scan_run_configs(spark, "/nonexistent/results").count() == 0


# ------------------------------------------------------------------ formatters
def test_capitalize_not_initcap(spark):
    df = spark.createDataFrame([(1, 0, "tool caller", "x"), (1, 1, "assistant", "")],
                               "conv_id long, turn long, role string, text string")
    rows = turns_to_messages(df)
    text = _one(rows.select(format_messages(rows, "messages").alias("t"))).t
    assert text == "### Tool caller:\nx"  # Q6; the empty message is dropped


def test_format_sft_routes(spark):
    alp = spark.createDataFrame([("i", None, "o")], "instruction string, input string, output string")
    assert _one(format_sft(alp)).text == "### Instruction:\ni\n\n### Response:\no"  # Q7: null input
    pc = spark.createDataFrame([("", "i", "c")], "prompt string, instruction string, completion string")
    with pytest.raises(ValueError):
        format_sft(spark.createDataFrame([("p", "c", "r")], "prompt string, chosen string, rejected string"))
    assert _one(format_sft(pc.drop("instruction"))).text.startswith("### Prompt:\n\n")


# ------------------------------------------------------------------ dataset readers
def test_read_dataset_suffixes(spark):
    d = tempfile.mkdtemp(prefix="tunedata-ds-")
    _write(f"{d}/a.json", '[{"text": "x"}, {"text": "y"}]')
    _write(f"{d}/b.jsonl", '{"text": "x"}\n{"text": "y"}\n')
    _write(f"{d}/c.csv", 'text,n\n"multi\nline",1\nplain,2\n')
    _write(f"{d}/d.txt", "one\n\nthree\n")
    _write(f"{d}/e.xml", "<x/>")
    spark.createDataFrame([("x",)], "text string").write.parquet(f"{d}/f.parquet")
    assert read_dataset(spark, f"{d}/a.json").count() == 2
    assert read_dataset(spark, f"{d}/b.jsonl").count() == 2
    assert read_dataset(spark, f"{d}/c.csv").count() == 2
    assert [r.text for r in read_dataset(spark, f"{d}/d.txt").collect()] == ["one", "", "three"]
    assert read_dataset(spark, f"{d}/f.parquet").count() == 1
    with pytest.raises(ValueError):
        read_dataset(spark, f"{d}/e.xml")


# ------------------------------------------------------------------ properties
def test_split_is_disjoint_and_covering(spark):
    from tunedata.operators.splits import train_val_split

    df = spark.range(5000).withColumnRenamed("id", "k")
    s = train_val_split(df, "k", fraction=0.1)
    assert s.count() == 5000
    assert set(r.split for r in s.select("split").distinct().collect()) == {"train", "val"}
    again = train_val_split(df, "k", fraction=0.1)
    assert s.exceptAll(again).count() == 0  # deterministic


def test_dedup_idempotent(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "id long, text string")
    once = q.exact_dedup(df, ["text"], "id")
    assert sorted(r.id for r in once.collect()) == [1, 3]
    assert q.exact_dedup(once, ["text"], "id").count() == 2
