"""Readers of experiment results, with explicit schemas.

A study folder has a folder for each experiment with JSON files: state, metadata, results or a summary, predictions. All files of a kind are one scan, and the parts of an experiment are joined
on its folder. A missing metric is 0.0 but for the judge's, which stays null.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.functions.names import parse_experiment, retriever_parts

# Folders that hold no experiments, and phases of experiments without results.
SKIPPED = ("_archived_fake_reranked", "_tainted", "_collisions", "_incomplete", "analysis", "__pycache__", ".ipynb_checkpoints")
NOT_DONE = ("failed", "generating", "init")
METRICS = {"f1": ("f1",), "exact_match": ("exact_match",), "bertscore_f1": ("bertscore_f1", "bertscore"), "bleurt": ("bleurt",)}

METADATA = "name string, type string, exp_type string, model string, dataset string, prompt string, quantization string, retriever string, top_k int, batch_size int, num_questions int, reranker string, query_transform string, agent_type string, duration double, throughput_qps double, timestamp string"
RESULTS = f"{METADATA}, metrics map<string,double>, results map<string,double>, overall_metrics map<string,double>, metadata struct<{METADATA.replace(' string', ':string').replace(' int', ':int').replace(' double', ':double')}>, num_examples int, duration_seconds double"
STATE = "phase string, started_at string, updated_at string, error string, metrics_computed array<string>"
DOC = "struct<rank:int,doc_id:string,content:string,score:double>"
PREDICTION = f"idx bigint, question string, prediction string, expected array<string>, references array<string>, metrics map<string,double>, prompt string, retrieved_docs array<{DOC}>, doc_scores array<double>"


def _depth(spark: SparkSession, root: str) -> int:
    """How many folders deep root lies."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).depth()


def _files(spark: SparkSession, root: str, pattern: str, schema: str) -> DataFrame:
    """JSON files of a name anywhere under root but in skipped folders and what they hold, with the folder of each and its level under root."""
    rows = spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", pattern).option("mode", "PERMISSIVE").json(root)
    parts = F.split(F.regexp_replace("_metadata.file_path", "^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", ""), "/")
    above = F.slice(parts, _depth(spark, root) + 2, F.greatest(F.lit(0), F.size(parts) - F.lit(_depth(spark, root) + 2)))
    rows = rows.select("*", F.element_at(parts, -2).alias("folder"), F.array_join(F.slice(parts, 1, F.size(parts) - 1), "/").alias("path"), above.alias("above"))
    # Spark lists no folder that begins with _ or . itself; the rule is stated all the same.
    kept = rows.filter(~F.exists("above", lambda p: F.rlike(p, F.lit(r"^[_.]")) | p.isin(*SKIPPED)))
    return kept.withColumn("level", F.size("above")).drop("above")


def metric_value(metrics: Column, name: str) -> Column:
    """A metric under its names, 0.0 without; zero under one name gives way to the next. The judge's stays null."""
    if name == "llm_judge":
        return F.coalesce(F.nullif(F.try_element_at(metrics, F.lit("llm_judge_qa")), F.lit(0.0)), F.try_element_at(metrics, F.lit("llm_judge")))
    return F.coalesce(*(F.try_element_at(metrics, F.lit(k)) for k in METRICS[name]), F.lit(0.0))


def _flat(rows: DataFrame, metrics: Column) -> DataFrame:
    parts = retriever_parts(F.col("retriever"))
    fields = ("type", "model", "dataset", "prompt", "quantization")
    columns = {f: F.coalesce(F.col(f), F.lit("unknown")) for f in fields} | {m: metric_value(metrics, m) for m in (*METRICS, "llm_judge")}
    return rows.withColumns(columns).withColumn("parts", parts).select("name", *fields, "retriever", "top_k", *METRICS, "llm_judge", F.coalesce("duration", F.lit(0.0)).alias("duration"), "parts.corpus", "parts.embedding_model", "parts.chunk_strategy", "parts.chunk_size")


def _judged(spark: SparkSession, root: str) -> DataFrame:
    """(folder, judge): the judge's metric of the experiments that lie right under root and have a summary file; of several the first by name."""
    summary = _files(spark, root, "*_summary.json", "overall_metrics map<string,double>, llm_judge_qa double, llm_judge double").withColumn("file", F.col("_metadata.file_name")).filter("level = 1")
    of = lambda name: F.when(F.col("overall_metrics").isNotNull(), F.try_element_at("overall_metrics", F.lit(name))).otherwise(F.col(name))
    return summary.groupBy("folder").agg(F.min_by(F.coalesce(F.nullif(of("llm_judge_qa"), F.lit(0.0)), of("llm_judge")), "file").alias("judge"))


def from_comparison(spark: SparkSession, path: str) -> DataFrame:
    """Experiments of a comparison file: a list under ``experiments``; metrics under ``results`` or ``metrics``. Where an experiment has a folder with a
    summary file beside the comparison, the judge's metric is the summary's."""
    rows = spark.read.schema(f"experiments array<struct<{RESULTS}>>").option("multiLine", True).json(path).select(F.explode("experiments").alias("e")).select("e.*")
    rows = rows.join(_judged(spark, path.rpartition("/")[0]), F.col("name") == F.col("folder"), "left")
    chosen = F.when(F.size("results") > 0, F.col("results")).otherwise(F.col("metrics"))
    others = F.map_filter(F.coalesce(chosen, F.create_map().cast("map<string,double>")), lambda k, _: k != "llm_judge_qa")
    judged = F.when(F.col("judge").isNotNull(), F.map_concat(others, F.create_map(F.lit("llm_judge_qa"), "judge"))).otherwise(chosen)
    return _flat(rows.withColumn("name", F.coalesce("name", F.lit("unknown"))), judged)


def from_directories(spark: SparkSession, root: str, also_skip: tuple[str, ...] = ()) -> DataFrame:
    """Experiments of a study folder that are done: no state, or a phase that is not in NOT_DONE. Results come from results.json, or else a summary file."""
    state = _files(spark, root, "state.json", STATE).select("path", "phase")
    meta = _files(spark, root, "metadata.json", METADATA).drop("folder")
    results = _files(spark, root, "results.json", RESULTS)
    summary = _files(spark, root, "*_summary.json", RESULTS).join(results.select("path"), "path", "left_anti")
    both = results.unionByName(summary)
    own = lambda c: F.coalesce(F.col(f"m.{c}"), F.col(f"r.metadata.{c}"), F.col(f"r.{c}"))
    joined = both.alias("r").join(meta.alias("m"), "path", "left").join(state.alias("s"), "path", "left").filter(F.col("phase").isNull() | ~F.col("phase").isin(*NOT_DONE, *also_skip))
    first = lambda *cs: F.coalesce(*(F.when(F.size(c) > 0, F.col(c)) for c in cs))
    columns = [F.coalesce(own("name"), F.col("folder")).alias("name"), *(own(c).alias(c) for c in ("type", "exp_type", "model", "dataset", "prompt", "quantization", "retriever", "top_k", "reranker", "query_transform", "agent_type")), F.coalesce(F.col("r.duration_seconds"), own("duration")).alias("duration"), first("r.metrics", "r.results", "r.overall_metrics").alias("metrics")]
    rows = joined.select(*columns)
    return _flat(rows.withColumn("type", F.coalesce("type", "exp_type")), F.col("metrics"))


def load_all(spark: SparkSession, root: str) -> DataFrame:
    """Experiments of the first that exists of study_summary.json, comparison.json and the folders."""
    jvm = spark._jvm
    for name in ("study_summary.json", "comparison.json"):
        path = jvm.org.apache.hadoop.fs.Path(f"{root}/{name}")
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            return from_comparison(spark, f"{root}/{name}")
    return from_directories(spark, root)


def for_analysis(spark: SparkSession, root: str) -> DataFrame:
    """As from_directories without experiments whose metrics are being computed; what metadata lacks is told by the name."""
    rows = from_directories(spark, root, ("computing_metrics",))
    told = rows.withColumn("told", parse_experiment(F.col("name")))
    known = lambda c: F.when(F.col(c) != "unknown", F.col(c))
    return told.select("name", F.coalesce(known("type"), "told.exp_type").alias("exp_type"), F.col("told.model_short").alias("model_short"), F.coalesce(known("dataset"), "told.dataset").alias("dataset"), F.coalesce(known("prompt"), "told.prompt").alias("prompt"), "told.retriever_type", "told.embedding_model", F.coalesce("top_k", "told.top_k").alias("top_k"), "told.query_transform", "told.reranker", "told.agent_type", *METRICS, "llm_judge")


def failed(spark: SparkSession, root: str) -> DataFrame:
    """(name, phase, error) of experiments that failed or report an error."""
    rows = _files(spark, root, "state.json", STATE)
    return rows.filter((F.col("phase") == "failed") | F.col("error").isNotNull()).select(F.col("folder").alias("name"), "phase", "error")


def states(spark: SparkSession, root: str) -> DataFrame:
    return _files(spark, root, "state.json", STATE).select(F.col("folder").alias("name"), "phase", "error", "metrics_computed")


def predictions(spark: SparkSession, root: str) -> DataFrame:
    """(experiment, idx, question, prediction, references, metrics, prompt, retrieved_docs): older files give expected answers and plain scores, and no idx. Large
    ones are in pieces."""
    rows = _files(spark, root, "predictions{,-[0-9][0-9][0-9][0-9][0-9]*}.json", f"predictions array<struct<{PREDICTION}>>").select("folder", F.posexplode("predictions").alias("at", "p"))
    docs = F.transform("p.doc_scores", lambda s, i: F.struct((i + 1).alias("rank"), F.lit(None).cast("string").alias("doc_id"), F.lit(None).cast("string").alias("content"), s.alias("score")))
    return rows.select(F.col("folder").alias("experiment"), F.coalesce("p.idx", F.col("at").cast("long")).alias("idx"), "p.question", "p.prediction", F.coalesce("p.references", "p.expected").alias("references"), "p.metrics", "p.prompt", F.coalesce("p.retrieved_docs", docs).alias("retrieved_docs"))


def item_scores(spark: SparkSession, root: str, metric: str = "f1") -> DataFrame:
    """(experiment, idx, question, prediction, score) of predictions that have the metric."""
    rows = predictions(spark, root).withColumn("score", F.try_element_at("metrics", F.lit(metric)))
    return rows.filter("score is not null").select("experiment", "idx", "question", "prediction", "score")


def evaluate_predictions(spark: SparkSession, root: str, names: list[str]) -> DataFrame:
    """(experiment, idx, names): metrics of stored predictions. References are arrays throughout, so several answers to a question count by their best."""
    from quillmark.operators.metrics import contexts_of, evaluate

    rows = predictions(spark, root).withColumn("contexts", contexts_of(F.col("retrieved_docs")))
    return evaluate(rows, names).select("experiment", "idx", *names)


def metric_of(spark: SparkSession, root: str, metric: str = "f1") -> DataFrame:
    """(name, value): of results, or else the mean over the predictions that have it."""
    from_items = item_scores(spark, root, metric).groupBy(F.col("experiment").alias("name")).agg(F.avg("score").alias("mean"))
    stored = _files(spark, root, "results.json", RESULTS).select(F.col("folder").alias("name"), F.try_element_at("metrics", F.lit(metric)).alias("stored"))
    return stored.join(from_items, "name", "full").select("name", F.coalesce("stored", "mean").alias("value")).filter("value is not null")


def matching(rows: DataFrame, pattern: str, name: str = "name") -> DataFrame:
    """Rows whose name fits a glob of * and ?, or contains the pattern if it has neither."""
    if not set(pattern) & set("*?"):
        return rows.filter(F.contains(F.col(name), F.lit(pattern)))
    regex = "".join({"*": ".*", "?": "."}.get(c, re.escape(c)) for c in pattern)
    return rows.filter(F.rlike(name, F.lit(f"^{regex}$")))


def write_experiments(rows: DataFrame, path: str) -> None:
    """One Parquet table, a folder for each experiment; a failed job leaves the old one."""
    rows.write.mode("overwrite").partitionBy("experiment").parquet(path)


def write_traces(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def write_report(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).csv(path)
