"""The running best by keyed state and the streamed index: restarts, dropped state, batches that fail midway."""

import json
from pathlib import Path

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillmark.operators import inverted
from quillmark.streaming import best, vectors

TRIALS = "model string, value double, trial string, ts timestamp"


def _drop(folder: Path, name: str, rows: list[dict]) -> None:
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(map(json.dumps, rows)))


def _trial(model, value, trial, hour):
    return {"model": model, "value": value, "trial": trial, "ts": f"2026-01-{1 + hour // 24:02d}T{hour % 24:02d}:00:00Z"}


def test_running_best_goes_on_and_forgets(spark, tmp_path):
    """A restart goes on from the state; a key that is not heard of for a day is dropped and begins anew."""
    source, out, check = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "check")

    def run() -> dict:
        best.keep_best(spark.readStream.schema(TRIALS).json(str(source)), out, check).awaitTermination()
        return {r["key"]: (r["best"], r["trial"], r["n"], r["dropped"]) for r in best.latest(spark, out).collect()}

    _drop(source, "a.json", [_trial("m", 0.2, "t1", 0), _trial("m", 0.5, "t3", 1), _trial("m", 0.5, "t2", 1), _trial("k", None, "t9", 1), _trial("k", 0.1, "t4", 1), _trial(None, 0.3, "t5", 1)])
    assert run() == {"m": (0.5, "t2", 3, False), "k": (0.1, "t4", 1, False), "None": (0.3, "t5", 1, False)}
    assert run()["m"] == (0.5, "t2", 3, False)  # nothing new
    _drop(source, "b.json", [_trial("m", 0.4, "t6", 10), _trial("m", 0.9, "t7", 11)])
    assert run()["m"] == (0.9, "t7", 5, False)
    _drop(source, "c.json", [_trial("k", 0.0, "t8", 60)])
    run()
    _drop(source, "d.json", [_trial("k", 0.05, "t10", 61)])
    after = run()
    assert after["m"] == (0.9, "t7", 5, True) and after["None"][3] and after["k"][:2] in ((0.1, "t4"), (0.05, "t10"))
    _drop(source, "e.json", [_trial("m", 0.1, "t11", 62)])
    assert run()["m"] == (0.1, "t11", 1, False)


def test_state_is_read_by_key(spark, tmp_path):
    _drop(tmp_path / "in", "a.json", [_trial("m", 0.2, "t1", 0)])
    plan = best.updates(spark.readStream.schema(TRIALS).json(str(tmp_path / "in")))
    assert plan.isStreaming and [f.name for f in plan.schema] == ["key", "best", "trial", "n", "seen", "dropped"]
    assert best.latest(spark, str(tmp_path / "nowhere")).collect() == []


def _embed(text):
    @F.pandas_udf("array<double>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: [float(t.count(c)) + 0.1 for c in "aeiounst"])

    return run(text)


def _docs(k: int) -> list[dict]:
    return [{"id": f"d{k}-{i}", "text": " ".join(f"word{(i * 7 + j * k) % 50} stones and oats" for j in range(40))} for i in range(20)]


def test_a_batch_that_fails_midway_is_there_once(spark, tmp_path, monkeypatch):
    """The second batch fails after its rows are assigned; the restart takes it again, and no chunk is lost or there twice."""
    source, path, check = tmp_path / "in", f"file://{tmp_path}/index", str(tmp_path / "check")
    run = lambda: vectors.build_index(spark.readStream.schema("id string, text string").json(str(source)), path, check, _embed, lists=4, size=200).awaitTermination()
    _drop(source, "a.json", _docs(1))
    run()
    index, add = inverted.Inverted(spark, path), inverted.add_batch
    centres = index.centres()

    def broken(index, rows, batch):
        rows.limit(5).write.mode("overwrite").parquet(f"{index.path}/lists/batch={batch}/_temporary/0")
        raise RuntimeError("lost")

    _drop(source, "b.json", _docs(2))
    monkeypatch.setattr(inverted, "add_batch", broken)
    with pytest.raises(Exception, match="lost"):
        run()
    one = index.table().count()
    assert index.table().select("batch").distinct().count() == 1
    monkeypatch.setattr(inverted, "add_batch", add)
    run()
    rows = index.table()
    assert rows.count() == rows.select("chunk_id").distinct().count() == 2 * one and (index.centres() == centres).all()
    assert rows.filter("text is null or size(v) <> 8 or size(embedding) <> 8").isEmpty()
    vectors.index_batch(index, spark.createDataFrame(_docs(2)), 1, _embed, size=200)  # the same batch a third time
    assert index.table().count() == 2 * one
    asked = index.table().limit(3).select(F.col("doc_id").alias("query_id"), "embedding")
    assert inverted.search(index, asked, 1, probes=4).filter("score > 0.999").count() == 3
