import hashlib
import json

import pytest
from pyspark.sql import functions as F

from lodestone.functions import text
from lodestone.sources import files


def test_manifest_order_and_checks(spark, tmp_path):
    ids = ["b", "a", "c"]
    good = tmp_path / "m.json"
    good.write_text(json.dumps({"question_ids": ids, "question_ids_sha256": hashlib.sha256("\n".join(ids).encode()).hexdigest()}))
    assert [r.question_id for r in files.manifest(spark, str(good)).orderBy("pos").collect()] == ids
    for i, bad in enumerate([{"ids": ["a", "a"]}, {"ids": []}, [1], {"ids": ["a"], "sha256": "0"}]):
        (p := tmp_path / f"{i}.json").write_text(json.dumps(bad))
        with pytest.raises(ValueError):
            files.manifest(spark, str(p))


def test_cohort_leaves_out_other_manifests(spark):
    q = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "question_id string, n long")
    m = spark.createDataFrame([(0, "c"), (1, "a")], "pos long, question_id string")
    assert [(r.pos, r.question_id) for r in files.cohort(q, m, [m.where("pos = 1")]).collect()] == [(0, "c")]


def test_first_that_loads(spark, tmp_path):
    spark.range(3).write.parquet(f"{tmp_path}/b")
    assert files.first_that_loads(spark, [f"{tmp_path}/a", f"{tmp_path}/b"]).count() == 3
    with pytest.raises(ValueError, match="no source"):
        files.first_that_loads(spark, [f"{tmp_path}/a"])


def test_json_lines_skip_blanks_and_refuse_what_is_no_json(spark, tmp_path):
    (p := tmp_path / "l.jsonl").write_text('{"run_id": "r", "em": 1.0}\n\n{"run_id": "s"}\n')
    assert sorted(r.run_id for r in files.json_lines(spark, str(p)).collect()) == ["r", "s"]
    p.write_text('{"run_id": "r"}\nnot-json\n')
    with pytest.raises(Exception):
        files.json_lines(spark, str(p)).collect()
    assert [r.line for r in files.bad_lines(spark, str(p)).collect()] == ["not-json"]


def test_run_violations(spark):
    answers = spark.createDataFrame([("r", "q", "a b", "a b", 1.0, 1.0), ("r", "p", "x", "y", 1.0, 0.0)], "run_id string, question_id string, predicted_answer string, gold_answer string, em double, f1 double")
    calls = spark.createDataFrame([("q", "s", 0), ("q", "s", 0)], "question_id string, stage string, call_index long")
    p, g = F.col("predicted_answer"), F.col("gold_answer")
    found = files.run_violations(answers, calls, text.exact_match(p, g), text.token_f1(p, g))
    assert {k: v.count() for k, v in found.items()} == {"calls_once": 1, "answers_once": 0, "metrics_match": 1, "one_run": 0}


def test_discovery_refuses_two_halves(spark):
    meta = spark.createDataFrame([("r", False, "a", 5), ("r", True, "b", 5), ("s", True, "c", 5), ("t", False, "d", 4)], "run_id string, timing_mode boolean, path string, n long")
    assert [tuple(r) for r in files.discover(meta, n=5).collect()] == [("r", "a", "b")]
    with pytest.raises(Exception, match="two artifacts"):
        files.discover(meta.unionAll(meta)).collect()


def test_completed_runs(spark, tmp_path):
    (tmp_path / "r.jsonl").write_text("x")
    meta = spark.createDataFrame([("r", "r.jsonl", hashlib.sha256(b"x").hexdigest()), ("s", "r.jsonl", "0")], "run_id string, file string, sha256 string")
    answers = spark.createDataFrame([("r", "a"), ("r", "b"), ("s", "a"), ("s", "b")], "run_id string, question_id string")
    selected = answers.select("question_id").distinct()
    done = lambda sel: [r.run_id for r in files.completed(meta, files.file_hashes(spark, str(tmp_path)), answers, sel).collect()]
    assert done(selected) == ["r"] and done(selected.where("question_id = 'a'")) == []


def test_reports(spark, tmp_path):
    files.report({"means": spark.createDataFrame([("a", 1.5), ("b", None)], "run string, f1 double")}, str(tmp_path))
    assert json.loads((tmp_path / "report.json").read_text())["means"][0] == {"run": "a", "f1": 1.5}
    assert "| a | 1.5 |" in (tmp_path / "report.md").read_text() and "| b | - |" in (tmp_path / "report.md").read_text()
    with pytest.raises(ValueError):
        files.markdown("t", spark.range(5), most=4)


def test_streams_read_tables_that_are_files_folders_or_empty_folders(spark, tmp_path):
    from lodestone.plans import source_queries

    rows = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "x", "b"), (2, 1, "x", "c"), (3, 0, "x", "d")], "conv_id long, turn int, role string, text string")
    want = {1: 2, 3: 1}
    rows.repartition(3).write.parquet(f"{tmp_path}/many/conversations.parquet")
    rows.toPandas().astype({"turn": "int32"}).to_parquet(tmp_path / "conversations.parquet", index=False)
    rows.limit(0).write.parquet(f"{tmp_path}/none/conversations.parquet")
    for folder, expected in (("many", want), (".", want), ("none", {})):
        assert {r.conv_id: r.executed for r in source_queries.stream_histories(spark, f"{tmp_path}/{folder}").collect()} == expected
