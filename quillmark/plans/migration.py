"""Migrations of a study's experiment folders: a plan of changes as a table, then a new version of the study.

A plan says for each file what becomes of it and why. Applying it copies the study into a version's folder with the changes in it and then
names that version in the manifest, which is replaced by one rename; whoever reads ``current`` sees the old version or the new one. Plans of a study that
needs nothing are empty, and then nothing is written, so a second run changes nothing. What a name stands for already is found before anything is written: such experiments
keep their old name.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmark.functions.names import direct_name, rag_name
from quillmark.session import stored
from quillmark.sources.experiments import _system, part_of, read_files, write_files
from quillmark.sources.results import METADATA

MANIFEST = "_manifest.json"
PLAN = "experiment string, file string, new_experiment string, content string, reason string"
#: A stale file of an agent that is no part of an experiment.
CHECKPOINT = "agent_checkpoint"


def current(path: str) -> str:
    """The folder of the version that the manifest names; the study's own without one."""
    system, root = _system(path)
    at = f"{root}/{MANIFEST}"
    if system.get_file_info(at).type != fs.FileType.File:
        return path
    with system.open_input_stream(at) as f:
        return f"{path}/{json.loads(f.read())['version']}"


def _swap(path: str, version: str) -> None:
    system, root = _system(path)
    with system.open_output_stream(f"{root}/{MANIFEST}.next") as f:
        f.write(json.dumps({"version": version}).encode())
    system.move(f"{root}/{MANIFEST}.next", f"{root}/{MANIFEST}")


def _failed(prediction: dict) -> bool:
    return any(mark in str(prediction.get("prediction", "")) for mark in ("[ERROR", "[ABORTED"))


def _with_bertscore(metrics: dict | None) -> bool:
    if metrics and "bertscore_f1" in metrics and "bertscore" not in metrics:
        metrics["bertscore"] = metrics["bertscore_f1"]
        return True
    return False


def _repairs(file: str, content: str) -> tuple[str | None, str | None, int]:
    """(reason or None, new content or None, failed predictions) of one file; a prediction's repeats are in one file."""
    if file == CHECKPOINT:
        return "stale checkpoint", None, 0
    part = part_of(file)
    if part not in ("predictions", "results"):
        return None, None, 0
    try:
        data = json.loads(content)
    except ValueError:
        return None, None, 0
    if part == "results":
        return ("bertscore", json.dumps(data), 0) if file == part and _with_bertscore(data.get("metrics")) else (None, None, 0)
    rows, why = data.get("predictions", []), []
    last = {r.get("idx"): r for r in rows}
    if len(last) < len(rows):
        data["predictions"] = [last[i] for i in sorted(last, key=lambda i: (i is not None, i or 0))]
        why.append(f"{len(rows) - len(last)} repeated predictions")
    if _with_bertscore(data.get("aggregate_metrics")):
        why.append("bertscore")
    return (", ".join(why) or None, json.dumps(data) if why else None, sum(map(_failed, data.get("predictions", []))))


def _failed_state(content: pd.Series, bad: pd.Series) -> pd.Series:
    """The state of an experiment that is complete but has failed predictions; null for any other."""

    def one(text: str, n: int) -> str | None:
        try:
            state = json.loads(text)
        except ValueError:
            return None
        return json.dumps(state | {"phase": "failed", "error": f"{n} predictions have errors"}) if state.get("phase") == "complete" else None

    return pd.Series([one(*row) for row in zip(content, bad, strict=True)], dtype=object)


def plan_repairs(files: DataFrame) -> DataFrame:
    """The plan (experiment, file, new_experiment, content, reason) that repairs experiments: stale checkpoints go, of predictions of one idx the last stays, the score missing under
    its own name is set, a complete experiment with failed predictions has failed. content null removes a file. Files that are no JSON are left alone. Files are looked at one by one, and
    an experiment's failed predictions are added up over its files."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for own in batches:
            found = [(e, f, *_repairs(f, c)) for e, f, c in zip(own["experiment"], own["file"], own["content"], strict=True)]
            yield pd.DataFrame(found, columns=["experiment", "file", "reason", "content", "bad"])

    each = files.mapInPandas(run, "experiment string, file string, reason string, content string, bad long")
    own = each.filter("reason is not null").select("experiment", "file", F.col("experiment").alias("new_experiment"), "content", "reason")
    bad = each.groupBy("experiment").agg(F.sum("bad").alias("bad")).filter("bad > 0")
    states = files.filter("file = 'state'").join(bad, "experiment").withColumn("new", F.pandas_udf(_failed_state, "string")("content", "bad")).filter("new is not null")
    return own.unionByName(states.select("experiment", "file", F.col("experiment").alias("new_experiment"), F.col("new").alias("content"), F.lit("complete with failed predictions").alias("reason")))


def names(files: DataFrame) -> DataFrame:
    """(experiment, new_experiment, collides) of experiments whose metadata give another name than their folder's. A name that a folder has already, or that an earlier one
    of the plan takes, collides."""
    more = ", rrf_k int, alpha double, agent_params string"
    meta = files.filter("file = 'metadata'").select("experiment", F.from_json("content", METADATA + more).alias("m")).select("experiment", "m.*")
    kind = F.coalesce("exp_type", "type")
    given = lambda *columns: F.array_min(F.array(*(F.coalesce(F.col(c), F.lit("")) != "" for c in columns)))
    direct = direct_name(F.col("model"), F.col("prompt"), F.col("dataset"))
    rag = rag_name(*(F.col(c) for c in ("model", "prompt", "dataset", "retriever")), F.coalesce("top_k", F.lit(5)), F.coalesce("query_transform", F.lit("none")), F.coalesce("reranker", F.lit("none")), F.col("rrf_k"), F.col("alpha"), F.col("agent_type"), F.col("agent_params"))
    new = F.when(kind.isNull() | ~given("model", "prompt", "dataset"), None).when(kind == "direct", direct).when(given("retriever"), rag)
    told = meta.withColumn("new_experiment", new).filter(F.col("new_experiment").isNotNull() & (F.col("new_experiment") != F.col("experiment")))
    taken = files.select(F.col("experiment").alias("new_experiment"), F.lit(True).alias("taken")).distinct()
    turn = F.row_number().over(Window.partitionBy("new_experiment").orderBy("experiment"))
    return told.select("experiment", "new_experiment").join(taken, "new_experiment", "left").select("experiment", "new_experiment", (F.col("taken").isNotNull() | (turn > 1)).alias("collides"))


def _renamed(new: pd.Series, file: pd.Series, content: pd.Series) -> pd.Series:
    def one(name: str, part: str, text: str) -> str:
        if part not in ("metadata", "results"):
            return text
        data = json.loads(text) | {"name": name}
        if part == "results" and isinstance(data.get("metadata"), dict):
            data["metadata"]["name"] = name
        return json.dumps(data)

    return pd.Series([one(*row) for row in zip(new, file, content, strict=True)])


def plan_names(files: DataFrame) -> DataFrame:
    """The plan that gives experiments the names of their metadata, in their files as well; those that collide keep theirs."""
    renamed = F.pandas_udf(_renamed, "string")
    todo = names(files).filter("not collides").select("experiment", "new_experiment")
    return files.join(todo, "experiment").select("experiment", "file", "new_experiment", renamed("new_experiment", "file", "content").alias("content"), F.lit("name").alias("reason"))


def apply(spark: SparkSession, path: str, plan: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Makes a version of the study at path with the plan's changes, unless there are none, and returns the plan's rows. The study's first state stays as it lies; the plan
    is kept beside its version."""
    files = read_files(spark, current(path))
    version = f"_v{int(current(path).rpartition('/_v')[2]) + 1 if '/_v' in current(path)[len(path) :] else 1}"
    system, root = _system(path)
    if system.get_file_info(f"{root}/{version}").type == fs.FileType.Directory:  # left by a run that was stopped before its manifest
        system.delete_dir(f"{root}/{version}")
    changes = stored(plan(files), f"{path}/_plan{version}")
    if changes.isEmpty():
        return changes
    new = changes.select("experiment", "file", "new_experiment", F.col("content").alias("new_content"), F.lit(True).alias("changed"))
    both = files.join(new, ["experiment", "file"], "left").filter("changed is null or new_content is not null")
    made = both.select(F.coalesce("new_experiment", "experiment").alias("experiment"), "file", F.coalesce("new_content", "content").alias("content"))
    write_files(made, f"{path}/{version}", "overwrite", checked=False)
    _swap(path, version)
    return changes


def files_of(spark: SparkSession, path: str) -> DataFrame:
    """(experiment, file, content) of the study's current version."""
    return read_files(spark, current(path))
