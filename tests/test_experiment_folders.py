"""Experiment folders: written, read back by the scans, staged and committed, left alone by a job that fails."""

import json

import pytest
from pyspark.sql import functions as F

from quillmark.plans import migration
from quillmark.sources import experiments, results


@pytest.fixture
def parts(spark):
    return {
        "metadata": spark.createDataFrame([("e1", "e1", "m", "nq", 5), ("e2", "e2", "m", "hotpotqa", None)], "experiment string, name string, model string, dataset string, top_k int"),
        "results": spark.createDataFrame([("e1", {"f1": 0.5}, 12.0), ("e2", {"f1": 0.75}, 3.0)], "experiment string, metrics map<string,double>, duration_seconds double"),
        "predictions": spark.createDataFrame([("e1", 1, "q1", "p1", {"f1": 1.0}), ("e1", 0, 'q "0"', "é\n", {"f1": 0.0}), ("e2", 7, "q", "p", None), ("e1", 1, "q1", "p1", {"f1": 1.0})], "experiment string, idx long, question string, prediction string, metrics map<string,double>"),
        "questions": spark.createDataFrame([("e1", 0, 'q "0"'), ("e1", 1, "q1")], "experiment string, idx long, question string"),
        "states": spark.createDataFrame([("e1", "complete"), ("e2", "failed")], "experiment string, phase string"),
    }


def test_written_folders_are_what_the_scans_read(spark, tmp_path, parts):
    experiments.write_study(str(tmp_path), **parts)
    assert sorted(p.name for p in tmp_path.iterdir()) == ["e1", "e2"]
    assert sorted(p.name for p in (tmp_path / "e1").iterdir()) == [f"{x}.json" for x in sorted(experiments.PARTS)]
    found = results.load_all(spark, str(tmp_path)).collect()
    assert [(r["name"], r["model"], r["dataset"], r["f1"], r["top_k"]) for r in found] == [("e1", "m", "nq", 0.5, 5)]
    assert {r["name"] for r in results.failed(spark, str(tmp_path)).collect()} == {"e2"}
    own = results.predictions(spark, str(tmp_path)).orderBy("experiment", "idx").collect()
    assert [(r["experiment"], r["idx"], r["question"], r["prediction"]) for r in own] == [("e1", 0, 'q "0"', "é\n"), ("e1", 1, "q1", "p1"), ("e2", 7, "q", "p")]
    asked = json.loads((tmp_path / "e1" / "questions.json").read_text())
    assert asked == {"experiment": "e1", "questions": [{"idx": 0, "question": 'q "0"'}, {"idx": 1, "question": "q1"}], "count": 2}
    assert json.loads((tmp_path / "e2" / "metadata.json").read_text())["timestamp"]
    assert {tuple(r) for r in experiments.completed(spark, str(tmp_path)).collect()} == {("e1", 0), ("e1", 1), ("e2", 7)}


def test_partitions_are_groups_of_folders(spark, tmp_path):
    rows = [(f"x{k:02d}", "state", json.dumps({"phase": "init", "k": k})) for k in range(10)]
    experiments.register(spark)
    spark.createDataFrame(rows, experiments.SCHEMA).write.format("experiments").mode("append").save(str(tmp_path))
    (tmp_path / "_tainted").mkdir()
    (tmp_path / "_tainted" / "state.json").write_text("{}")
    (tmp_path / "x00" / "notes.txt").write_text("no part")
    read = experiments.read_files(spark, str(tmp_path), group=3)
    assert read.rdd.getNumPartitions() == 4 and sorted(map(tuple, read.collect())) == rows
    assert experiments.read_part(spark, str(tmp_path), "state", "phase string, k int").agg(F.sum("k")).first()[0] == 45


def test_a_failed_job_leaves_the_old_files(spark, tmp_path, parts):
    experiments.write_study(str(tmp_path), **parts)
    before = {p: p.read_text() for p in tmp_path.rglob("*.json")}
    for bad in ([("e1", "results", "{}"), ("e9", "results", "no json")], [("e1", "results", "{}"), ("e1", "results", "{}")], [("e1", "results", "{}"), ("../e", "results", "{}")]):
        with pytest.raises(Exception, match="(?i)json|twice|name|fail|abort|expect"):
            spark.createDataFrame(bad, experiments.SCHEMA).repartition(2).write.format("experiments").mode("append").save(str(tmp_path))
        assert {p: p.read_text() for p in tmp_path.rglob("*.json")} == before and not list(tmp_path.glob("_staged*"))


def test_append_replaces_files_and_overwrite_removes_experiments(spark, tmp_path, parts):
    experiments.write_study(str(tmp_path), **parts)
    again = parts["states"].filter("experiment = 'e2'").withColumn("phase", F.lit("complete"))
    experiments.write_study(str(tmp_path), states=again)
    assert results.states(spark, str(tmp_path)).filter("phase = 'complete'").count() == 2 and (tmp_path / "e2" / "results.json").exists()
    experiments.write_study(str(tmp_path), mode="overwrite", states=again)
    assert [p.name for p in tmp_path.iterdir()] == ["e2"]
    with pytest.raises(ValueError, match="no part"):
        experiments.study_files()


def test_large_predictions_are_pieces(spark, tmp_path, monkeypatch):
    """Over the bound an experiment's predictions and questions are several files, which all readers join; fewer of them replace them."""
    monkeypatch.setattr(experiments, "PIECE", 2000)
    rows = spark.range(300).select(F.when(F.col("id") < 290, "big").otherwise("small").alias("experiment"), F.col("id").alias("idx"), F.lit("q").alias("question"), F.lit("[ERROR: x]").alias("prediction"), F.create_map(F.lit("f1"), F.lit(0.5)).alias("metrics"))
    states = spark.createDataFrame([("big", "complete")], "experiment string, phase string")
    experiments.write_study(str(tmp_path), predictions=rows, questions=rows.select("experiment", "idx", "question"), states=states)
    files = sorted(p.name for p in (tmp_path / "big").glob("predictions*"))
    assert len(files) > 5 and "predictions.json" in files and max(p.stat().st_size for p in (tmp_path / "big").iterdir()) < 5000
    assert [p.name for p in (tmp_path / "small").glob("predictions*")] == ["predictions.json"]
    assert experiments.completed(spark, str(tmp_path)).distinct().count() == 300
    assert results.item_scores(spark, str(tmp_path)).select("idx").distinct().count() == 300
    assert experiments.read_part(spark, str(tmp_path), "questions", "count int").agg(F.sum("count")).first()[0] == 300
    repairs = migration.plan_repairs(experiments.read_files(spark, str(tmp_path))).collect()
    assert [(r["file"], json.loads(r["content"])["error"]) for r in repairs] == [("state", "290 predictions have errors")]
    experiments.write_study(str(tmp_path), predictions=rows.filter("idx < 3"))
    assert [p.name for p in (tmp_path / "big").glob("predictions*")] == ["predictions.json"] and experiments.completed(spark, str(tmp_path)).filter("experiment = 'big'").count() == 3
