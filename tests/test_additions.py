"""Bootstrap intervals, prefix sums over partitions, plateau state, and the other additions of this round."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tunedata.operators import bootstrap as bs
from tunedata.operators import ordering
from tunedata.streaming import jobs, plateau


def test_bootstrap_copies_are_poisson(spark):
    """Copies have mean and variance 1, and replicates are not alike."""
    w = np.array([r[0] for r in spark.range(4000).select(bs.row_number_of(F.col("id")).alias("u"))
                  .select(bs.draws("u", 20)).collect()])
    assert abs(w.mean() - 1) < 0.02 and abs(w.var() - 1) < 0.05
    assert np.abs(np.corrcoef(w.T) - np.eye(20)).max() < 0.08
    assert abs((w == 0).mean() - np.exp(-1)) < 0.01


def test_bootstrap_against_the_formula(spark):
    rows = spark.range(3000).select("id", F.lit("a").alias("g"), (F.col("id") % 10 < 3).cast("int").alias("hit"))
    r = bs.bootstrap_ratio(rows, ["g"], "id", F.col("hit")).first()
    assert r["total"] == 3000 and r["value"] == 0.3 and r["low"] < 0.3 < r["high"]
    assert abs(r["std_error"] / np.sqrt(0.3 * 0.7 / 3000) - 1) < 0.25
    plan = bs.bootstrap_ratio(rows, ["g"], "id", F.col("hit"))._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Expand" not in plan


def test_bootstrap_edges(spark):
    rows = spark.createDataFrame([(1, "a", 1.0, 0.0), (2, "b", None, 1.0), (None, "c", 2.0, 4.0), (None, "c", 2.0, 4.0)],
                                 "id bigint, g string, n double, d double")
    got = {r["g"]: r for r in bs.bootstrap_ratio(rows, ["g"], "id", F.col("n"), F.col("d")).collect()}
    assert set(got) == {"a", "c"} and got["a"]["value"] is None and got["a"]["low"] is None
    assert got["c"]["value"] == got["c"]["low"] == got["c"]["high"] == 0.5
    assert bs.bootstrap_ratio(rows.limit(0), ["g"], "id", F.col("n")).count() == 0


@pytest.mark.parametrize("fan,broadcast", [(256, 1 << 14), (2, 1 << 14), (2, 0)])
def test_prefix_sums_over_wide_ids(spark, monkeypatch, fan, broadcast):
    """Ids up to 10**15 with gaps; blocks follow partitions, scanned in several levels."""
    monkeypatch.setattr(ordering, "FAN", fan)
    monkeypatch.setattr(ordering, "BROADCAST_BLOCKS", broadcast)
    ids = sorted({int(i) ** 3 % 10 ** 15 for i in range(1, 90000, 450)})
    df = spark.createDataFrame([(i, i % 7) for i in ids], "id bigint, v bigint").repartition(5)
    got = {r["id"]: (r["pos"], r["s"]) for r in ordering.running_sums(df, ["id"], {"s": F.col("v")}).collect()}
    total, want = 0, {}
    for k, i in enumerate(ids):
        total += i % 7
        want[i] = (k + 1, total)
    assert got == want
    assert {r["id"]: r["pos"] for r in ordering.global_positions(df, [F.col("id").desc()]).collect()} == {i: len(ids) - k for k, i in enumerate(ids)}
    prev = {r["id"]: r["prev_id"] for r in ordering.with_previous(df, ["id"], ["id"]).collect()}
    assert prev == {b: a for a, b in zip([None, *ids], ids)}
    none = df.limit(0)
    assert ordering.running_sums(none, ["id"], {"s": F.col("v")}).count() == ordering.with_previous(none, ["id"], ["id"]).count() == 0


def test_chat_gaps(spark):
    """A gap in the turn numbers hides nothing."""
    from tunedata.operators.quality import chat_structure

    turns = [(1, 0, "user"), (1, 2, "user"), (1, 3, "assistant"), (2, 5, "system"), (2, 9, "user"), (2, 11, "assistant"),
             (3, 0, "user"), (3, 1, "assistant"), (3, 2, "system"), (4, 0, "tool"), (4, 1, "assistant"), (5, 0, None), (5, 1, None)]
    got = {r["conv_id"]: (r["starts_with_system"], r["system_only_first"], r["alternates"], r["valid"])
           for r in chat_structure(spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string")).collect()}
    assert got[1] == (False, True, False, False) and got[2] == (True, True, True, True)
    assert got[3] == (False, False, True, False) and got[4] == (False, True, True, False) and got[5][2]


def test_plateau_closes_idle_runs(spark, tmp_path):
    """An event-time timer closes a run that logs nothing for a day; its state goes and it starts anew."""
    source, out = str(tmp_path / "in"), str(tmp_path / "out")

    def put(*rows):
        (spark.createDataFrame(rows, "run_dir string, step bigint, loss double, t string")
         .select("run_dir", "step", "loss", F.col("t").cast("timestamp").alias("ts")).coalesce(1).write.mode("append").parquet(source))

    put(("a", 1, 2.0, "2024-01-01 00:00:00"), ("a", 70000, 3.0, "2024-01-01 01:00:00"), ("a", -5, 4.0, "2024-01-01 01:00:00"))
    put(("b", 1, 1.0, "2024-01-05 00:00:00"), ("b", 2, None, "2024-01-05 00:00:00"), ("b", None, 0.1, "2024-01-05 00:00:00"))
    put(("b", 3, 1.5, "2024-01-05 00:10:00"))
    put(("a", 9, 9.0, "2024-01-05 00:10:00"))
    with plateau.rocksdb_state(spark):
        jobs.drain(plateau.plateau_detector(jobs.file_stream(spark, source, 1), idle="1 day"), out, output_mode="update")
    rows = sorted((r["batch"], r["run_dir"], r["best_loss"], r["steps_since_best"], r["n_steps"], r["closed"])
                  for r in spark.read.parquet(out).collect())
    closed = [r[1:] for r in rows if r[-1]]
    assert closed == [("a", 2.0, 1, 3, True)]
    assert ("b", 1.0, 2, 3, False) in [r[1:] for r in rows]
    assert rows[-1][1:] == ("a", 9.0, 0, 1, False)


def test_schema_drift(spark):
    """A planted type change, a missing field, arrays, nulls, deeper objects and text that is no JSON."""
    from tunedata.operators import drift

    rows = ['{"a": 1, "b": {"c": "x"}, "e": [1, "y"]}', '{"a": "1", "b": {"c": null}}', '{"a": 2.5, "b": {}}', "no json", None, "[{}]"]
    df = spark.createDataFrame([(r, "x") for r in rows], "j string, path string")
    got = {r["path"]: tuple(r)[1:] for r in drift.schema_drift(df, "j").collect()}
    assert got == {"$": ("array,malformed,object", 5, 0, True), "$.a": ("number,string", 3, 0, True), "$.b": ("object", 3, 0, False),
                   "$.b.c": ("null,string", 2, 1, False), "$.e": ("array", 1, 2, False), "$.e[]": ("number,string", 2, 0, True), "$[]": ("object", 1, 0, False)}
    assert drift.schema_drift(df.limit(0), "j").count() == 0
    assert drift.merged_schema(df.where("j like '{%'"), "j").first()[0] == "OBJECT<a: VARIANT, b: OBJECT<c: STRING>, e: ARRAY<VARIANT>>"


def test_sketches_merge_twice(spark):
    """Small sketches of many days, merged to months, then to all: the error stays within the bound."""
    from tunedata.operators import sketches as sk

    df = spark.range(60000).select((F.col("id") % 30).alias("day"), (F.xxhash64("id") % 5000 + F.col("id") % 7).alias("v"))
    days = sk.quantile_sketches(df, ["day"], F.col("v"), 200)
    months = sk.merge_sketches(days.withColumn("month", F.col("day") % 3), ["month"], 200)
    whole = sk.merge_sketches(months, [], 200).withColumn("g", F.lit(1))
    q = sk.sketch_quantiles(whole, ["g"], (0.01, 0.25, 0.5, 0.75, 0.99))
    exact = sorted(r["v"] for r in df.select("v").collect())
    for r in q.collect():
        rank = np.searchsorted(exact, r["value"], side="right") / len(exact)
        assert r["n"] == 60000 and abs(rank - r["p"]) < 2 * sk.rank_error(200)
    wide = sk.within_bound(q, df.withColumn("g", F.lit(1)), ["g"], F.col("v"), 60)  # a wider bound than its own
    assert all(r["within"] for r in wide.collect())
    off = q.withColumn("value", F.col("value") + 2000)
    assert not any(r["within"] for r in sk.within_bound(off, df.withColumn("g", F.lit(1)), ["g"], F.col("v"), 200).where("p < 0.9").collect())
    assert sk.quantile_sketches(df.limit(0), ["day"], F.col("v")).count() == 0


def test_languages(spark):
    """Learned from short rows, found in others; awkward texts are not judged, nothing to learn from gives nulls."""
    from tunedata.operators import language as lg

    words = {"en": "the and with that from this have which their would there", "de": "der und mit dass von diese haben welche nicht ihre werden",
             "fr": "les et avec que dans cette avoir leur serait où être"}
    rows = [(i, " ".join(words[g].split()[(i * k) % 11] for k in range(1, 9)), g) for i, g in enumerate(list(words) * 40)]
    odd = [(1000, None, "en"), (1001, "", "en"), (1002, "ab", "en"), (1003, "日本語日本語", "en"), (1004, "UND MIT DASS VON DIESE", "en"), (None, "les et avec que dans cette", None)]
    df = spark.createDataFrame(rows + odd, "doc_id bigint, text string, lang string").repartition(4)
    got = {r["doc_id"]: r for r in lg.detect_languages(df).collect()}
    assert len(got) == len(rows) + len(odd)
    held = [got[i] for i, _, _ in rows if got[i]["held_out"]]
    assert len(held) > 10 and all(r["detected"] == r["lang"] for r in held)
    assert all(got[i]["detected"] is None and got[i]["n_grams"] == 0 for i in (1000, 1001, 1002))
    assert got[1004]["detected"] == "de" and got[None]["detected"] == "fr" and got[1003]["n_grams"] == 4
    bare = lg.detect_languages(df.withColumn("lang", F.lit(None).cast("string")))
    assert all(r["detected"] is None and r["margin"] is None for r in bare.collect())
    assert lg.detect_languages(df.limit(0)).count() == 0


def brute_merges(texts, merges, per_round):
    import collections

    words = collections.Counter(w for t in texts for w in (t or "").split())
    cut = {w: list(w) for w in words}
    found = []
    while len(found) < merges:
        pairs = collections.Counter()
        for w, n in words.items():
            for p in zip(cut[w], cut[w][1:]):
                pairs[p] += n
        used, taken = set(), []
        for (a, b), n in sorted(pairs.items(), key=lambda x: (-x[1], x[0])):
            if n >= 2 and len(taken) < min(per_round, merges - len(found)) and not {a, b, a + b} & used:
                taken.append((a, b))
                used |= {a, b, a + b}
        if not taken:
            break
        found += taken
        for a, b in taken:
            for w, s in cut.items():
                out, i = [], 0
                while i < len(s):
                    if i + 1 < len(s) and (s[i], s[i + 1]) == (a, b):
                        out.append(a + b)
                        i += 2
                    else:
                        out.append(s[i])
                        i += 1
                cut[w] = out
    return found, {w: len(s) for w, s in cut.items()}


@pytest.mark.parametrize("per_round", [1, 4])
def test_bpe_against_brute_force(spark, per_round):
    from tunedata.operators import bpe

    texts = [None, "", "  ", "aaaa aaa aa a", "low lower lowest newest widest " * 3, "été été étés", "a\x02b a\x02b x\ty", "😀😀 😀😀", "newer lower " * 5]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").repartition(3)
    want, sizes = brute_merges([t.replace("\x02", "�") if t else t for t in texts], 25, per_round)
    merges = bpe.learn_merges(df, "text", 25, per_round)
    assert merges == want and len(merges) > 5
    got = {r["doc_id"]: r["n"] for r in df.select("doc_id", bpe.token_column(merges, "text").alias("n")).collect()}
    assert got == {i: sum(sizes[w] for w in (t or "").replace("\x02", "�").split()) for i, t in enumerate(texts)}
    assert bpe.learn_merges(df.limit(0), "text") == []
    assert bpe.learn_merges(df, "text", 10_000)  # runs out of pairs and stops


def test_gate_stream(spark, tmp_path):
    """A copy in a later batch is rejected, also after a restart; a replayed batch changes nothing."""
    from tunedata.streaming import gate

    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    a, b, c = (" ".join([w] * 12) for w in ("ab", "cd", "ef"))

    def put(*rows):
        spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1).write.mode("append").parquet(source)

    def go():
        gate.run_gate(jobs.file_stream(spark, source, 1), out, form=lambda t: F.concat(F.lit("doc: "), t))
        kept = sorted((r["id"], r["text"], r["batch"]) for r in spark.read.parquet(out + "/kept").collect())
        return kept, sorted((r["id"], r["reason"], r["batch"]) for r in spark.read.parquet(out + "/rejected").collect())

    put((5, a), (3, a), (1, None), (2, "too short"), (9, b))
    put((4, a), (6, c), (7, " ".join(["x"] * 3000)), (8, b + " �"))
    kept, rejected = go()
    assert kept == [(3, "doc: " + a, 0), (6, "doc: " + c, 1), (9, "doc: " + b, 0)]
    assert rejected == [(1, "empty", 0), (2, "too_short", 0), (4, "duplicate", 1), (5, "duplicate", 0), (7, "too_long", 1), (8, "encoding", 1)]
    put((10, c), (11, a), (12, c + " new"))
    kept2, rejected2 = go()
    assert kept2 == sorted([*kept, (12, "doc: " + c + " new", 2)]) and rejected2 == sorted([*rejected, (10, "duplicate", 2), (11, "duplicate", 2)])
    again = spark.createDataFrame([(10, None, c), (11, None, a), (12, None, c + " new"), (10, "duplicate", None), (11, "duplicate", None), (12, "kept", None)],
                                  "id bigint, verdict string, text string")
    gate.write_gated(again, 2, out, lambda t: F.concat(F.lit("doc: "), t))
    assert go() == (kept2, rejected2)


def test_chat_templates(spark):
    """Named layouts written as templates give the same text; shipped constructs; what is outside the subset falls back."""
    from tunedata.operators import chat_templates as ctp
    from tunedata.operators import formatters as fm
    from tunedata.plans.format_plans import SHIPPED_TEMPLATES

    rows = [[("system", "be brief"), ("user", " hi "), ("assistant", "yo")], [("user", "it's"), ("tool", ""), ("user", None)], []]
    df = spark.createDataFrame([([dict(role=r, content=c) for r, c in m],) for m in rows], "m array<struct<role:string,content:string>>").coalesce(1)

    def text(template, **kw):
        return [r[0] for r in df.select(ctp.compile_template(template, F.col("m"), **kw)).collect()]

    named = lambda name: [r[0] for r in df.select(fm.render_chat_template(F.transform("m", lambda x: x.withField("content", F.coalesce(x["content"], F.lit("")))), name)).collect()]
    assert text(SHIPPED_TEMPLATES["llama3"], bos_token="<|begin_of_text|>") == named("llama3")
    assert text(SHIPPED_TEMPLATES["chatml"]) == named("chatml") and text(SHIPPED_TEMPLATES["zephyr"], eos_token="</s>") == named("zephyr")
    system = ("{%- if messages[0]['role'] == 'system' %}\n    {%- set system_message = messages[0]['content'] | trim %}\n    {%- set loop_messages = messages[1:] %}\n"
              "{%- else %}\n    {%- set system_message = '' %}{%- set loop_messages = messages %}{%- endif %}")
    system += "{%- for m in loop_messages %}\n{%- if loop.first and system_message %}<<{{ system_message }}>>{%- endif %}{{ m.role[0] if false else m.role }}:{{ m.content }};\n{%- endfor %}"
    with pytest.raises(ctp.Unsupported):
        text(system)  # m.role[0]
    assert text(system.replace("m.role[0] if false else ", "")) == ["<<be brief>>user: hi ;assistant:yo;", "user:it's;tool:;user:;", ""]
    inst = ("{{ bos_token }}{% for message in messages[1:] if true %}{% endfor %}",
            "{{ bos_token }}{%- for m in messages -%}\n  {%- if m.role == 'user' and not loop.first -%} [U{{ loop.index }}] {{ m.content.strip() }}"
            "{%- elif loop.last or m['role'] in ['tool', 'system'] -%} ({{ m['role'] | upper }}) {%- else -%} ? {%- endif -%}\n{%- endfor -%} {{ messages | length }}")
    with pytest.raises(ctp.Unsupported):
        text(inst[0])
    assert text(inst[1], bos_token="<s>") == ["<s>(SYSTEM)[U2] hi(ASSISTANT)3", "<s>?(TOOL)[U3] 3", "<s>0"]
    assert text("{# note #}{% set x = 'a' ~ 'b' %}{{ x if messages else 'none' }}{{ nothing }}{% if y is defined %}y{% else %}n{% endif %}") == ["abn", "abn", "nonen"]
    assert text("{% if messages[0].role == 'system' %}{{ messages[0]['content'] }}|{% endif %}{% for m in messages[1:] %}{{ loop.index0 }}{{ m.role }};{% endfor %}") == [
        "be brief|0user;1assistant;", "0tool;1user;", ""]
    fallback = [r[0] for r in df.select(ctp.render_template("{% macro x() %}{% endmacro %}", F.col("m"))).collect()]
    assert fallback == [r[0] for r in df.select(fm.render_messages("m")).collect()]
    for bad in ("{% if a %}", "{{ raise_exception('x') }}", "{{ messages[i] }}", "{% for a in b %}{% endfor %}", "{{ m. }}", "{% break %}"):
        with pytest.raises(ctp.Unsupported):
            text(bad)


def test_run_tree_source(spark, tmp_path):
    """A pattern of run names opens only their files; a stream picks up new runs and goes on after a restart."""
    import time

    from tunedata.sources import run_tree
    from tunedata.sources import runs as rs

    root = tmp_path / "results"

    def put(run, name, text):
        (root / run).mkdir(parents=True, exist_ok=True)
        (root / run / name).write_bytes(text if isinstance(text, bytes) else text.encode())

    assert run_tree.read_tree(spark, str(root)).count() == 0
    put("run_001", "run_config.json", '{"model": "m1",\n "lora_r": 4}')
    put("run_001", "eval_mmlu.json", '{"accuracy": true}')
    put("run_001", "stdout.log", b"one\r\ntwo\xff\n\nfour")
    put("run_dir=run_002", "run_config.json", "broken")
    put("other", "run_config.json", "{}")
    put("run_003", "run_config.json", "{}")
    tree = rs.from_tree(spark, str(root), "run_config.json")
    configs = rs.scan_run_configs(spark, str(root), found=tree)
    assert [(r["run_dir"], r["model"], r["lora_r"]) for r in configs.where("run_dir = 'run_001'").collect()] == [("run_001", "m1", 4)]
    assert {r["run_dir"]: r["_corrupt"] for r in configs.where("run_dir in ('run_001', 'run_002')").collect()} == {"run_001": False, "run_002": True}
    assert {r["run_dir"] for r in configs.collect()} == {"run_001", "run_002", "run_003"}
    reader = run_tree.RunTreeReader({"path": str(root), "runs": "run_001, run_9*"})
    assert [p.folders for p in reader.partitions()] == [[str(root / "run_001")]]
    one = rs.scan_run_configs(spark, str(root), found=rs.from_tree(spark, str(root), "run_config.json", runs="run_001"))
    assert [r["run_dir"] for r in one.collect()] == ["run_001"]
    assert rs.scan_eval_artifacts(spark, str(root), found=rs.from_tree(spark, str(root), "eval_*.json")).first()["accuracy"] == 1.0
    logs = run_tree.read_tree(spark, str(root), "*.log", lines=True).orderBy("line_no").collect()
    assert [(r["line_no"], r["value"]) for r in logs] == [(0, "one"), (1, "two�"), (2, ""), (3, "four")]

    out = str(tmp_path / "out")

    def drain():
        time.sleep(0.3)
        jobs.drain(run_tree.stream_tree(spark, str(root), settle_ms=50), out)
        return sorted((r["run_dir"], r["value"]) for r in spark.read.parquet(out).collect())

    first = [("run_001", '{"accuracy": true}'), ("run_001", '{"model": "m1",\n "lora_r": 4}'), ("run_002", "broken"), ("run_003", "{}")]
    assert drain() == first
    put("run_004", "run_config.json", "{}")
    assert drain() == [*first, ("run_004", "{}")] == drain()


def test_clusters_of_a_family(spark):
    """A family of near copies is one cluster without all its pairs being compared; a chain and strangers beside it."""
    from tunedata.operators import dedup as dd

    rng = np.random.default_rng(4)
    base = [f"w{i}" for i in range(80)]
    texts, k = {}, 0
    for _ in range(400):  # each copy has one word of its own
        words = list(base)
        words[int(rng.integers(0, 80))] = f"x{k}"
        texts[k], k = " ".join(words), k + 1
    chain = [f"c{i}" for i in range(100)]
    for step in range(12):
        texts[k], k = " ".join(chain[step * 3:step * 3 + 60]), k + 1
    for _ in range(50):
        texts[k], k = " ".join(f"v{i}" for i in rng.integers(0, 3000, 60)), k + 1
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").repartition(4)
    got = {r["doc_id"]: r["cluster_id"] for r in dd.near_dup_clusters(docs).collect()}
    sets = {i: {tuple(t.split()[j:j + 5]) for j in range(len(t.split()) - 4)} for i, t in texts.items()}
    label = {i: i for i in sets}
    for i in sets:
        for j in sets:
            if i < j and len(sets[i] & sets[j]) >= 0.7 * len(sets[i] | sets[j]):
                a, b = label[i], label[j]
                label = {n: min(a, b) if c in (a, b) else c for n, c in label.items()}
    size = {c: sum(v == c for v in label.values()) for c in label.values()}
    assert got == {i: c for i, c in label.items() if size[c] > 1}


def test_combined_partials(spark):
    """One partial per task and key, whatever the batches; null keys are a group."""
    import pandas as pd

    from tunedata.operators import ext

    def partial(b):
        return b.groupby("g", as_index=False, dropna=False).agg(n=("v", "size"), s=("v", "sum"), parts=("v", lambda v: 1))

    def combine(p):
        assert p.groupby("g", dropna=False).size().max() <= max(ext.HELD, ext.SALTS) + 1
        return p.groupby("g", as_index=False, dropna=False).sum().assign(parts=1)

    def merge(p):
        return pd.DataFrame({"g": p["g"].iloc[:1], "n": [int(p["n"].sum())], "s": [int(p["s"].sum())], "parts": [len(p)]})

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        df = spark.range(20000).select(F.when(F.col("id") % 9 > 0, "hot").alias("g"), F.col("id").alias("v")).repartition(6)
        rows = ext.two_phase_aggregate(df, "g", partial, merge, "g string, n long, s long, parts long", "g string, n long, s long, parts long", combine).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    got = {r["g"]: r for r in rows}
    assert got["hot"]["n"] + got[None]["n"] == 20000 and got["hot"]["s"] == sum(i for i in range(20000) if i % 9) and got["hot"]["parts"] <= 6


def test_encoding_faults(spark):
    """Each kind of fault is found, and clean text is not."""
    from tunedata.operators import quality as q

    texts = {1: "fine é ü 日本 \t\n\r", 2: "bad � char", 3: "bell \x07", 4: "null \x00", 5: "cafÃ© au lait", 6: "itâ€™s", 7: "Ã", 8: None}
    df = spark.createDataFrame(list(texts.items()), "i int, text string")
    rep, ctl, moj = q.encoding_flags("text")
    got = {r[0]: tuple(r)[1:] for r in df.select("i", rep, ctl, moj).collect()}
    assert got[1] == got[7] == (False, False, False) and got[2] == (True, False, False)
    assert got[3] == got[4] == (False, True, False) and got[5] == got[6] == (False, False, True) and got[8] == (None, None, None)


def test_word_match(spark):
    from tunedata.operators import runs as rn

    logs = [("a", "INFO starting inference"), ("b", "loss: NaN"), ("c", "grad=inf,"), ("d", "CUDA out of memory."), ("e", "finance nano")]
    df = spark.createDataFrame(logs, "run_dir string, line string")
    plain = {r["run_dir"]: (r["has_oom"], r["has_nan_inf"]) for r in rn.log_flags(df).collect()}
    words = {r["run_dir"]: (r["has_oom"], r["has_nan_inf"]) for r in rn.log_flags(df, match="word").collect()}
    assert plain["a"][1] and plain["e"][1] and not words["a"][1] and not words["e"][1]
    assert words["b"][1] and words["c"][1] and words["d"] == (True, False)
    with pytest.raises(ValueError):
        rn.log_flags(df, match="other")


def test_question_stands_in_for_prompt(spark):
    from tunedata.operators import catalog as cat
    from tunedata.operators import formatters as fm

    df = spark.createDataFrame([("q", "c", "r")], "question string, chosen string, rejected string")
    with pytest.raises(ValueError):
        fm.preference_rows(df)
    assert tuple(fm.preference_rows(df, rename_question=True).first()) == ("q", "c", "r")
    cols = F.array(*[F.lit(c) for c in df.columns])
    got = spark.range(1).select(cat.missing_preference_columns(cols), cat.missing_preference_columns(cols, True)).first()
    assert got[0] == ["prompt"] and got[1] == []


def test_file_stream_reads_folders(spark, tmp_path):
    """A table may be one file or a folder of that name; an empty stream still leaves both gate tables."""
    from tunedata.streaming import gate

    folder = str(tmp_path / "docs.parquet")
    spark.createDataFrame([(i, " ".join([f"w{i}"] * 12)) for i in range(8)], "doc_id bigint, text string").repartition(3).write.parquet(folder)
    out = gate.run_gate(jobs.file_stream(spark, folder), str(tmp_path / "out"))
    assert spark.read.parquet(out + "/kept").count() == 8 and spark.read.parquet(out + "/rejected").count() == 0
    part = next(p for p in (tmp_path / "docs.parquet").iterdir() if p.name.endswith(".parquet"))
    one = gate.run_gate(jobs.file_stream(spark, str(part)), str(tmp_path / "one"))
    assert 0 < spark.read.parquet(one + "/kept").count() < 8
