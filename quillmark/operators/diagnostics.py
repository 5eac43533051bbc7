"""Retrieval and generation diagnostics: whether the answer was in the context, and what became of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The steps that an agent's trace must have.
EXPECTED_STEPS = {"direct_llm": ("batch_generate",), "fixed_rag": ("batch_search", "batch_generate"), "iterative_rag": ("batch_search", "batch_sufficiency", "batch_generate"), "self_rag": ("batch_assess", "batch_generate")}


def retrieval_stats(items: DataFrame, by: str = "experiment") -> DataFrame:
    """(by, total, both, context_only, correct_only, neither, recall, accuracy, given_context, bottleneck) of items (by, in_context, correct): the
    bottleneck is retrieval if less than half of the contexts hold the answer, generation if less than half of those lead to it, else balanced."""
    c, r = F.col("in_context"), F.col("correct")
    counts = items.groupBy(by).agg(F.count("*").alias("total"), F.count_if(c & r).alias("both"), F.count_if(c & ~r).alias("context_only"), F.count_if(~c & r).alias("correct_only"), F.count_if(~c & ~r).alias("neither"))
    return _rates(counts)


def _rates(counts: DataFrame) -> DataFrame:
    seen = F.col("both") + F.col("context_only")
    recall, given = seen / F.col("total"), F.coalesce(F.try_divide(F.col("both"), seen), F.lit(0.0))
    label = F.when(recall < 0.5, "retrieval").when(given < 0.5, "generation").otherwise("balanced")
    return counts.select("*", recall.alias("recall"), ((F.col("both") + F.col("correct_only")) / F.col("total")).alias("accuracy"), given.alias("given_context"), label.alias("bottleneck"))


def micro(stats: DataFrame) -> DataFrame:
    """One row: sums over experiments, and rates of the sums."""
    return _rates(stats.agg(*(F.sum(x).alias(x) for x in ("total", "both", "context_only", "correct_only", "neither"))))


def quadrant(in_context: Column, correct: Column) -> Column:
    return F.when(in_context & correct, "both").when(in_context, "context_only").when(correct, "correct_only").otherwise("neither")


def quadrant_shares(items: DataFrame, stratum: str = "dataset") -> DataFrame:
    """(quadrant, share): shares in each stratum, averaged over the strata."""
    names = ("both", "context_only", "correct_only", "neither")
    q = quadrant(F.col("in_context"), F.col("correct"))
    per = items.groupBy(stratum).agg(*(F.avg((q == n).cast("int")).alias(n) for n in names))
    return per.agg(*(F.avg(n).alias(n) for n in names)).unpivot([], list(names), "quadrant", "share")


def rank_change(docs: DataFrame, by: str = "dataset") -> DataFrame:
    """(mean_change, median_change, improved, mean_final, n) of answer-bearing documents (by, retrieval_rank, rank): by group, then their means; n is added."""
    change = F.col("retrieval_rank") - F.col("rank")
    per = docs.groupBy(by).agg(F.avg(change).alias("m"), F.median(change).alias("d"), F.avg((change > 0).cast("double")).alias("i"), F.avg("rank").alias("f"), F.count("*").alias("n"))
    return per.agg(F.avg("m").alias("mean_change"), F.avg("d").alias("median_change"), F.avg("i").alias("improved"), F.avg("f").alias("mean_final"), F.sum("n").alias("n"))


def conditional_accuracy(items: DataFrame, by: list[str]) -> DataFrame:
    """(by, n, recall, with_context, without_context)."""
    c, r = F.col("in_context"), F.col("correct").cast("int")
    return items.groupBy(*by).agg(F.count("*").alias("n"), F.avg(c.cast("int")).alias("recall"), F.avg(F.when(c, r)).alias("with_context"), F.avg(F.when(~c, r)).alias("without_context"))


def retriever_profile(items: DataFrame, metric: str = "f1") -> DataFrame:
    """(retriever, recall, accuracy, f1, given_context, n, experiments): means over datasets; counts and distinct experiments are added."""
    c, r = F.col("in_context"), F.col("correct").cast("int")
    per = items.groupBy("retriever", "dataset").agg(F.avg(c.cast("int")).alias("a"), F.avg(r).alias("b"), F.avg(metric).alias("c"), F.avg(F.when(c, r)).alias("d"), F.count("*").alias("n"), F.countDistinct("experiment").alias("e"))
    return per.groupBy("retriever").agg(F.avg("a").alias("recall"), F.avg("b").alias("accuracy"), F.avg("c").alias("f1"), F.avg("d").alias("given_context"), F.sum("n").alias("n"), F.sum("e").alias("experiments"))


def first_answer_rank(docs: DataFrame, by: list[str]) -> DataFrame:
    """(by, first_rank, reciprocal): the best rank of a document with the answer (by, rank, has_answer); null and 0 without any."""
    out = docs.groupBy(*by).agg(F.min(F.when(F.col("has_answer"), F.col("rank"))).alias("first_rank"))
    return out.withColumn("reciprocal", F.coalesce(1.0 / F.col("first_rank"), F.lit(0.0)))


def hits_at(first: DataFrame, ks: list[int]) -> DataFrame:
    """One row: mean reciprocal rank, median first rank, and the share of queries with the answer among the first k."""
    return first.agg(F.avg("reciprocal").alias("mrr"), F.median("first_rank").alias("median_rank"), *(F.avg(F.coalesce((F.col("first_rank") <= k).cast("int"), F.lit(0))).alias(f"hit_{k}") for k in ks))


def trace_steps(steps: DataFrame) -> DataFrame:
    """(type, n, total_ms, avg_ms) of steps (type, timing_ms); timings of zero are not measured ones."""
    timed = F.when(F.col("timing_ms") > 0, F.col("timing_ms"))
    return steps.groupBy("type").agg(F.count("*").alias("n"), F.coalesce(F.sum(timed), F.lit(0.0)).alias("total_ms"), F.coalesce(F.avg(timed), F.lit(0.0)).alias("avg_ms"))


def missing_steps(spark, steps: DataFrame) -> DataFrame:
    """(experiment, agent_type, step): steps that an experiment's agent must have and that its trace (experiment, agent_type, type) lacks."""
    wanted = spark.createDataFrame([(a, s) for a, ss in EXPECTED_STEPS.items() for s in ss], "agent_type string, step string")
    experiments = steps.select("experiment", "agent_type").distinct().join(F.broadcast(wanted), "agent_type")
    return experiments.join(steps.select("experiment", F.col("type").alias("step")).distinct(), ["experiment", "step"], "left_anti").select("experiment", "agent_type", "step")
