"""No silent cuts: loops run to their end, short passages are found, order of arrival does not matter,
folders of JSON arrays are read, and runs without a mapped model stay."""

import json

import pytest
from pyspark.sql import functions as F

from tunedata.operators import contamination as ct
from tunedata.operators import dedup as dd
from tunedata.operators import quality as q
from tunedata.operators import sweep as sw
from tunedata.operators.components import connected_components
from tunedata.sources import runs as rs
from tunedata.sources.datasets import read_dataset
from tunedata.streaming import jobs, plateau


@pytest.mark.parametrize("n", [2, 41, 400])
def test_components_of_a_chain(spark, n):
    """A chain in an order that makes plain label passing slow, beside a star."""
    ids = [(i * 7919) % 100_003 for i in range(n)]
    edges = [(a, b) for a, b in zip(ids, ids[1:])] + [(200_000, 200_001 + k) for k in range(30)] + [(5, 5), (None, 3)]
    got = {r["node"]: r["component"] for r in
           connected_components(spark.createDataFrame(edges, "src bigint, dst bigint")).collect()}
    assert {got[i] for i in ids} == {min(ids)}
    assert all(got[200_001 + k] == 200_000 for k in range(30)) and None not in got


def test_components_of_nothing(spark):
    assert connected_components(spark.createDataFrame([], "src bigint, dst bigint")).count() == 0


def test_near_duplicates_against_all_pairs(spark):
    words = [f"w{i}" for i in range(60)]
    texts = {1: " ".join(words), 2: " ".join(words[:55]), 3: " ".join(words), 4: " ".join(words[5:]), 5: "a b", 6: "a b",
             7: " ".join(f"z{i}" for i in range(60)), 8: " ".join(words[:30])}
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    sets = {i: {tuple(t.split(" ")[k:k + 5]) for k in range(len(t.split(" ")) - 4)} for i, t in texts.items()}
    want = {(a, b) for a in sets for b in sets if a < b and texts[a] != texts[b] and sets[a] and sets[b]
            and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.7 and {a, b} & {3} == set()}
    got = {(r["doc_a"], r["doc_b"]) for r in dd.near_dup_pairs(docs).collect()}
    assert got == want and want
    clusters = {r["doc_id"]: r["cluster_id"] for r in dd.near_dup_clusters(docs).collect()}
    assert clusters == {1: 1, 2: 1, 3: 1, 4: 1, 5: 5, 6: 5}


def test_short_passages_are_found(spark):
    bench = spark.createDataFrame([(1, "hello"), (2, "hello world"), (3, "one two three four"), (4, None), (5, "")],
                                  "item_id bigint, text string")
    docs = spark.createDataFrame([(1, "say hello world"), (2, "othello worlds"), (3, "xone two three fours"), (4, "hell"), (5, None)],
                                 "doc_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]) for r in ct.contaminated_pairs(docs, bench).collect()}
    assert got == {(1, 1), (1, 2), (2, 1), (2, 2), (3, 3)}
    assert {r["doc_id"] for r in ct.decontaminate(docs, ct.contaminated_pairs(docs, bench)).collect()} == {4, 5}


def test_gate_gives_the_rows(spark):
    long = " ".join(["word"] * 20)
    docs = spark.createDataFrame([(1, long, 1), (2, long, 2), (3, "", 3), (4, "short", 4), (5, long + " �", 5),
                                  (6, long + " \x01", 6), (7, long + " Ã©", 7), (8, None, 8)], "doc_id bigint, text string, x int")
    kept, rejected = q.gate(docs, "doc_id", "text")
    assert [tuple(r) for r in kept.collect()] == [(1, long, 1)]
    assert {r["doc_id"]: r["reason"] for r in rejected.collect()} == {
        2: "duplicate", 3: "empty", 4: "too_short", 5: "encoding", 6: "encoding", 7: "encoding", 8: "empty"}


def test_json_arrays_in_a_folder(spark, tmp_path):
    (tmp_path / "a.json").write_text(" " * 5000 + json.dumps([{"x": 1}, {"x": 2}], indent=1))
    (tmp_path / "b.json").write_text('{"x": 3}\n{"x": 4, "y": "z"}\n')
    folder = tmp_path / "set.json"
    folder.mkdir()
    for name in ("a.json", "b.json"):
        (folder / name).write_text((tmp_path / name).read_text())
    for ref in (str(folder), str(tmp_path / "[ab].json")):
        assert sorted(r["x"] for r in read_dataset(spark, ref).collect()) == [1, 2, 3, 4]


def test_halving_reaches_one(spark):
    row = spark.range(1).select(sw.fit_batch(F.lit(7.0), F.lit(16), F.lit(1 << 20), F.lit(2048), F.lit(6.0)).alias("b")).first()
    assert row["b"] == 32  # 15 halvings


def test_stdout_comes_before_stderr(spark, tmp_path):
    run = tmp_path / "run_001"
    run.mkdir()
    (run / "stdout.log").write_text("a\nb\n")
    (run / "stderr.log").write_text("\n".join(f"e{i}" for i in range(500)))
    lines = [r["line"] for r in rs.scan_run_logs(spark, str(tmp_path)).orderBy("line_no").collect()]
    assert lines == ["a", "b", *[f"e{i}" for i in range(500)]]


def test_plateau_over_batches_and_a_restart(spark, tmp_path):
    """Steps out of order over three micro-batches, then a restart with one more file."""
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    loss = {1: 3.0, 2: 1.0, 3: 5.0, 4: 6.0, 5: 7.0}

    def put(*steps):
        rows = [("run_1", s, loss[s]) for s in steps]
        spark.createDataFrame(rows, "run_dir string, step bigint, loss double").coalesce(1).write.mode("append").parquet(source)

    def go():
        with plateau.rocksdb_state(spark):
            jobs.drain(plateau.plateau_detector(jobs.file_stream(spark, source, 1)), out, output_mode="update")
        return [tuple(r)[:4] for r in jobs.latest(spark, out, "run_dir").select("run_dir", "best_loss", "steps_since_best", "n_steps").collect()]

    for steps in ((3, 4), (1, 2), (2, 5)):  # step 2 comes twice
        put(*steps)
    assert go() == [("run_1", 1.0, 3, 5)]
    loss[6] = 0.5
    put(6)
    assert go() == [("run_1", 0.5, 0, 6)]


def test_late_rows_are_dropped(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for day, run in (("01", "a"), ("03", "a"), ("03", "a"), ("01", "late"), ("09", "a")):
        (spark.createDataFrame([(run, 1.0, f"2024-01-{day} 12:00:00")], "run_dir string, loss double, t string")
         .select("run_dir", "loss", F.col("t").cast("timestamp").alias("ts")).coalesce(1).write.mode("append").parquet(source))
    jobs.drain(jobs.loss_windows(jobs.file_stream(spark, source, 1)), out)
    assert sorted(r["run_dir"] for r in spark.read.parquet(out).collect()) == ["a", "a"]


def test_own_formatter_and_template(spark):
    from tunedata.operators import formatters as fm

    df = spark.createDataFrame([("x",)], "text string")
    own = {"passthrough": lambda d, field: F.upper(field)}
    assert fm.format_sft(df, formatters=own).first()["text"] == "X" and fm.format_sft(df).first()["text"] == "x"
