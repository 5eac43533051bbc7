"""Experiment grids, samples of them, and which of them can and need to run.

Grids are products of option lists, made by exploding arrays in one row, so no join is planned. Sampling orders by a hash of the name and a seed:
the same on any cluster, for any partitioning.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmark.functions.names import direct_name, rag_name
from quillmark.operators.ranking import best

RAG_OPTIONS = ("model", "dataset", "prompt", "retriever", "top_k", "query_transform", "reranker")
DIRECT_OPTIONS = ("model", "dataset", "prompt")


def product(spark: SparkSession, options: dict[str, list]) -> DataFrame:
    """Every combination of the options."""
    kinds = {k: "int" if v and all(isinstance(x, int) for x in v) else "double" if v and all(isinstance(x, (int, float)) for x in v) else "string" for k, v in options.items()}
    rows = spark.range(1).select()
    for k, v in options.items():
        rows = rows.select("*", F.explode(F.array(*(F.lit(x) for x in v)).cast(f"array<{kinds[k]}>")).alias(k))
    return rows


def products(tables: list[DataFrame]) -> DataFrame:
    """Every combination of the rows of small option tables; the product is the result asked for."""
    return reduce(DataFrame.crossJoin, tables)


def rag_specs(grid: DataFrame, rrf_ks: list[int], alphas: list[float]) -> DataFrame:
    """Specs of a grid of RAG_OPTIONS: a hybrid retriever once for each constant and weight, others once; with names."""
    hybrid = F.contains(F.col("retriever"), F.lit("hybrid"))
    rows = grid.select("*", F.explode(F.when(hybrid, F.array(*map(F.lit, rrf_ks))).otherwise(F.array(F.lit(None).cast("int")))).alias("rrf_k"))
    rows = rows.select("*", F.explode(F.when(hybrid, F.array(*map(F.lit, alphas))).otherwise(F.array(F.lit(None).cast("double")))).alias("alpha"))
    none = F.lit(None).cast("string")
    name = rag_name(*(F.col(c) for c in ("model", "prompt", "dataset", "retriever", "top_k", "query_transform", "reranker", "rrf_k", "alpha")), none, none)
    return rows.withColumn("exp_type", F.lit("rag")).withColumn("name", name)


def direct_specs(grid: DataFrame) -> DataFrame:
    return grid.withColumn("exp_type", F.lit("direct")).withColumn("name", direct_name(F.col("model"), F.col("prompt"), F.col("dataset")))


def singletons(rows: DataFrame, datasets: list[str], defaults: dict[str, object]) -> DataFrame:
    """Specs given one by one: nulls take the defaults, and each runs on every dataset, named after it."""
    filled = rows.withColumns({k: F.coalesce(F.col(k), F.lit(v)) for k, v in defaults.items() if k in rows.columns})
    fanned = filled.drop("dataset").select("*", F.explode(F.array(*map(F.lit, datasets))).alias("dataset"))
    return fanned.withColumn("name", F.concat_ws("_", "name", "dataset"))


def all_specs(*parts: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def _order(key: str, seed: int) -> Column:
    return F.sha2(F.concat(F.col(key).cast("string"), F.lit(f"#{seed}")), 256)


def sample(rows: DataFrame, n: int, key: str = "name", seed: int = 42) -> DataFrame:
    """n rows without replacement."""
    return rows.orderBy(_order(key, seed), key).limit(n)


def stratified_sample(rows: DataFrame, strata: list[str], n: int, key: str = "name", seed: int = 42) -> DataFrame:
    """One row of each stratum, in the order of the strata, up to n, and then any others."""
    first = F.row_number().over(Window.partitionBy(*strata).orderBy(_order(key, seed), key)) == 1
    ranked = rows.withColumn("first", first).withColumn("hash", _order(key, seed))
    order = [F.desc("first"), *(F.when(F.col("first"), F.col(s)).asc() for s in strata), F.asc("hash"), F.asc(key)]
    return ranked.orderBy(*order).limit(n).drop("first", "hash")


def not_run(specs: DataFrame, done: DataFrame, key: str = "name") -> DataFrame:
    return specs.join(done.select(key), key, "left_anti")


def round_robin(fixed: DataFrame, epochs: int, seed: int = 42) -> DataFrame:
    """(epoch, turn, ...): every combination of the fixed dimensions once an epoch, in another order each."""
    key = F.sha2(F.concat_ws("|", F.lit(seed).cast("string"), F.col("epoch").cast("string"), *(F.col(c).cast("string") for c in fixed.columns)), 256)
    rows = fixed.select("*", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))).alias("epoch"))
    return rows.withColumn("turn", F.row_number().over(Window.partitionBy("epoch").orderBy(key)) - 1)


def in_space(rows: DataFrame, space: dict[str, list]) -> Column:
    """Whether a row's options are in the space: an option without values is free, null counts as none. Direct rows answer for model, dataset and
    ``direct_prompt`` alone."""
    inside = lambda c, values: F.coalesce(F.col(c).cast("string"), F.lit("none")).isin(*map(str, values)) if values else F.lit(True)
    common = inside("model", space.get("model")) & inside("dataset", space.get("dataset"))
    own = reduce(Column.__and__, (inside(c, space.get(c)) for c in ("retriever", "top_k", "prompt", "query_transform", "reranker", "agent_type") if c in rows.columns), F.lit(True))
    return common & F.when(F.col("exp_type") == "direct", inside("prompt", space.get("direct_prompt"))).otherwise(own)


def outside_report(rows: DataFrame, space: dict[str, list]) -> DataFrame:
    """(dimension, n, values): for each dimension how many rows are outside the space, and their values."""
    none = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("none"))
    failing = F.array_compact(F.array(*(F.when(~none(c).isin(*map(str, v)), F.struct(F.lit(c).alias("dimension"), none(c).alias("value"))) for c, v in space.items() if v and c in rows.columns)))
    long = rows.select(F.explode(failing).alias("x"))
    return long.groupBy("x.dimension").agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_set("x.value")), ",").alias("values"))


def feasible(rows: DataFrame, limits: DataFrame, chars_per_token: float = 4.0, overhead: int = 500, buffer: int = 256) -> DataFrame:
    """Rows whose context fits: chunk characters over characters a token, times top_k, and overhead, within the model's limit (model, context) less a buffer. Models without a limit pass."""
    need = F.col("chunk_chars") / chars_per_token * F.col("top_k") + overhead
    return rows.join(limits, "model", "left").filter(F.col("context").isNull() | (need <= F.col("context") - buffer))


def context_risk(rows: DataFrame, limits: DataFrame, chars_per_token: float = 4.0, overhead: int = 500, share: float = 0.9) -> DataFrame:
    """(..., tokens, headroom_pct): rows that take over nine tenths of their model's limit."""
    tokens = F.col("chunk_chars") / chars_per_token * F.col("top_k") + overhead
    both = rows.join(limits, "model").withColumn("tokens", tokens)
    return both.filter(F.col("tokens") > share * F.col("context")).withColumn("headroom_pct", (F.col("context") - F.col("tokens")) / F.col("context") * 100)


def warm_start(results: DataFrame, space: dict[str, list], params: list[str], metric: str) -> DataFrame:
    """Completed results in the space with a metric, the best of equal parameters: what a search may start from."""
    ok = results.filter((F.col("phase") == "complete") & F.col(metric).isNotNull()).filter(in_space(results, space))
    return best(ok, params, [F.desc(metric), F.asc("id")], 1).drop("rank")
