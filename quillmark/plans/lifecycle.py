"""State, health and repair of experiments, as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.functions.names import parse_experiment
from quillmark.operators.ranking import best

# Phases in their order; failed comes before all.
PHASES = {"failed": -1, "init": 0, "generating": 1, "generated": 2, "computing_metrics": 3, "complete": 4}
FAILURES = {"out_of_memory": "out of memory|oom", "context_length": "context length|maximum context|too long", "timeout": "timed? ?out", "connection": "connection|unreachable"}


def phase_number(phase: Column) -> Column:
    out = F.lit(None).cast("int")
    for name, number in PHASES.items():
        out = F.when(phase == name, number).otherwise(out)
    return out


def proven_phase(phase: Column, has_questions: Column, has_predictions: Column, has_results: Column) -> Column:
    """The phase, or the last one that the files prove if that is earlier; failed stays."""
    proven = F.when(has_results, "complete").when(has_predictions, "generated").when(has_questions, "generating").otherwise("init")
    return F.when(phase == "failed", phase).when(phase_number(phase).isNull() | (phase_number(phase) > phase_number(proven)), proven).otherwise(phase)


def health(states: DataFrame, questions: DataFrame, predictions: DataFrame) -> DataFrame:
    """(experiment, phase, missing_predictions, missing_metrics, healthy) of states (experiment, phase, requested, computed), with the questions (experiment, idx) that have no prediction (experiment, idx) and the metrics
    not computed. Healthy: complete and nothing missing."""
    missing = questions.join(predictions, ["experiment", "idx"], "left_anti").groupBy("experiment").agg(F.count("*").alias("missing"))
    out = states.join(missing, "experiment", "left").select("experiment", "phase", F.coalesce("missing", F.lit(0)).alias("missing_predictions"), F.size(F.array_except("requested", "computed")).alias("missing_metrics"))
    return out.withColumn("healthy", (F.col("phase") == "complete") & (F.col("missing_predictions") == 0) & (F.col("missing_metrics") == 0))


def unfinished(states: DataFrame) -> DataFrame:
    return states.filter(F.coalesce(F.col("phase"), F.lit("init")) != "complete")


def failure_patterns(rows: DataFrame, patterns: dict[str, str] | None = None) -> DataFrame:
    """(pattern, n) of errors (error) that match each pattern, case aside."""
    found = rows.agg(*(F.count_if(F.rlike("error", F.lit(f"(?i){p}"))).alias(name) for name, p in (patterns or FAILURES).items()))
    return found.unpivot([], found.columns, "pattern", "n")


def resolve_names(rows: DataFrame, name: str = "new_name", metric: str = "f1", tolerance: float = 0.01) -> DataFrame:
    """(..., winner, agree): of experiments with one corrected name the complete one with the best metric wins; agree: whether their metrics lie within the tolerance."""
    ranges = rows.groupBy(name).agg((F.max(metric) - F.min(metric) <= tolerance).alias("agree"))
    order = [F.desc((F.col("phase") == "complete").cast("int")), F.desc_nulls_last(metric), F.asc("id")]
    winners = best(rows, [name], order, 1).select(name, F.col("id").alias("winner"))
    return rows.join(winners, name).join(ranges, name)


def repaired(metadata: DataFrame) -> DataFrame:
    """metadata (name, model, dataset, prompt, ...) with nulls filled from what the name tells."""
    told = metadata.withColumn("told", parse_experiment(F.col("name")))
    fields = {"dataset": "dataset", "prompt": "prompt", "top_k": "top_k", "retriever_type": "retriever_type", "query_transform": "query_transform", "reranker": "reranker", "agent_type": "agent_type"}
    return told.withColumns({c: F.coalesce(F.col(c), F.col(f"told.{f}")) for c, f in fields.items() if c in metadata.columns}).drop("told")


def check_vectors(cache: DataFrame, dim: int, unit: bool = True) -> DataFrame:
    """One row (n, duplicates, wrong_size, not_finite, zero, not_unit) over cached vectors (key, v)."""
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda acc, x: acc + x.cast("double") * x))
    rows = cache.select("key", (F.size("v") != dim).alias("size"), bad.alias("bad"), F.forall("v", lambda x: x == 0).alias("zero"), (F.abs(length - 1) > 1e-3).alias("far"))
    counts = rows.agg(F.count("*").alias("n"), F.count_if("size").alias("wrong_size"), F.count_if("bad").alias("not_finite"), F.count_if("zero").alias("zero"), F.count_if("far" if unit else F.lit(False)).alias("not_unit"))
    twice = cache.groupBy("key").agg(F.count("*").alias("c")).agg(F.coalesce(F.sum(F.col("c") - 1), F.lit(0)).alias("duplicates"))
    return counts.crossJoin(twice)  # one row each


def cache_stats(cache: DataFrame, by: str, size: Column) -> DataFrame:
    """(by, entries, bytes)."""
    return cache.groupBy(by).agg(F.count("*").alias("entries"), F.sum(size.cast("long")).alias("bytes"))
