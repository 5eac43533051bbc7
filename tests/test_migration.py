"""Migrations: the plan is what is applied, a second run changes nothing, collisions keep their names, the old version stays."""

import json

import pytest

from quillmark.plans import migration
from quillmark.sources import experiments, results

META = {"type": "rag", "model": "org/m-1", "prompt": "concise", "dataset": "nq", "retriever": "dense_bge", "top_k": 5}


@pytest.fixture
def study(spark, tmp_path):
    rows = [
        ("old_a", "metadata", META | {"name": "old_a"}), ("old_a", "results", {"metrics": {"bertscore_f1": 0.5, "f1": 0.2}, "metadata": {"name": "old_a"}, "name": "old_a"}),
        ("old_a", "predictions", {"predictions": [{"idx": 2, "prediction": "z"}, {"idx": 1, "prediction": "x"}, {"idx": 2, "prediction": "y"}], "aggregate_metrics": {"bertscore_f1": 0.5}}),
        ("old_a", "agent_checkpoint", {}), ("old_a", "state", {"phase": "complete"}),
        ("old_b", "metadata", META | {"top_k": 3}), ("old_b", "predictions", {"predictions": [{"idx": 1, "prediction": "[ERROR: x]"}]}), ("old_b", "state", {"phase": "complete", "updated_at": "t"}),
        ("old_c", "metadata", META | {"top_k": 3}), ("old_d", "metadata", {"type": "rag", "model": "m"}), ("old_e", "metadata", META | {"type": "direct"}),
    ]
    experiments.register(spark)
    spark.createDataFrame([(e, f, json.dumps(c)) for e, f, c in rows], experiments.SCHEMA).write.format("experiments").mode("append").save(str(tmp_path))
    (tmp_path / "old_d" / "results.json").write_text("no json")
    return tmp_path


def _read(spark, path) -> dict:
    return {(r["experiment"], r["file"]): r["content"] for r in migration.files_of(spark, str(path)).collect()}


def test_repairs(spark, study):
    before = {p: p.read_text() for p in study.rglob("*.json")}
    dry = sorted(tuple(r) for r in migration.plan_repairs(migration.files_of(spark, str(study))).collect())
    done = sorted(tuple(r) for r in migration.apply(spark, str(study), migration.plan_repairs).collect())
    assert dry == done and [(r[0], r[1]) for r in done] == [("old_a", "agent_checkpoint"), ("old_a", "predictions"), ("old_a", "results"), ("old_b", "state")]
    now = _read(spark, study)
    assert ("old_a", "agent_checkpoint") not in now and now["old_d", "results"] == "no json" and len(now) == 11
    assert [(p["idx"], p["prediction"]) for p in json.loads(now["old_a", "predictions"])["predictions"]] == [(1, "x"), (2, "y")]
    assert json.loads(now["old_a", "results"])["metrics"]["bertscore"] == json.loads(now["old_a", "predictions"])["aggregate_metrics"]["bertscore"] == 0.5
    assert json.loads(now["old_b", "state"]) == {"phase": "failed", "updated_at": "t", "error": "1 predictions have errors"}
    assert all(p.read_text() == text for p, text in before.items()), "the first state stays"
    version = migration.current(str(study))
    assert migration.apply(spark, str(study), migration.plan_repairs).collect() == [] and migration.current(str(study)) == version and _read(spark, study) == now
    assert {r["name"] for r in results.failed(spark, version).collect()} == {"old_b"}


def test_names_and_collisions(spark, study):
    plan = {r["experiment"]: (r["new_experiment"], r["collides"]) for r in migration.names(migration.files_of(spark, str(study))).collect()}
    assert set(plan) == {"old_a", "old_b", "old_c", "old_e"} and plan["old_b"][0] == plan["old_c"][0] and (plan["old_b"][1], plan["old_c"][1]) == (False, True)
    assert plan["old_a"][0].startswith("rag_m1_nq_") and plan["old_e"][0].startswith("direct_m1_nq_")
    migration.apply(spark, str(study), migration.plan_names)
    now = _read(spark, study)
    assert {e for e, _ in now} == {plan["old_a"][0], plan["old_b"][0], plan["old_e"][0], "old_c", "old_d"}
    assert json.loads(now[plan["old_a"][0], "results"])["metadata"]["name"] == json.loads(now[plan["old_a"][0], "metadata"])["name"] == plan["old_a"][0]
    again = {r["experiment"]: r["collides"] for r in migration.names(migration.files_of(spark, str(study))).collect()}
    assert again == {"old_c": True} and migration.apply(spark, str(study), migration.plan_names).collect() == [] and _read(spark, study) == now


def test_a_run_stopped_before_its_manifest_is_none(spark, study, monkeypatch):
    before = _read(spark, study)
    monkeypatch.setattr(migration, "_swap", lambda *_: (_ for _ in ()).throw(KeyboardInterrupt()))
    with pytest.raises(KeyboardInterrupt):
        migration.apply(spark, str(study), migration.plan_repairs)
    assert _read(spark, study) == before
    monkeypatch.undo()
    migration.apply(spark, str(study), migration.plan_repairs)
    migration.apply(spark, str(study), migration.plan_names)
    assert migration.current(str(study)).endswith("_v2") and ("old_a", "state") not in _read(spark, study)
