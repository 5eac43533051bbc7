"""Agents as dataflow: control loops over retrieval and a model.

A model is a pandas UDF from a prompt column to a response column, so it loads once for each worker and failures are rows. Loops run a
fixed most number of rounds over DataFrames with the open queries; each round is checkpointed into the shared folder, so plans stay short.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.functions.parse import confidence, passages, sufficient, verification
from quillmark.functions.prompts import prompt
from quillmark.operators.ranking import best
from quillmark.session import ensure_checkpoints

Model = Callable[[Column], Column]
#: From (query_id, text) to hits (query_id, doc_id, text, score, rank).
Search = Callable[[DataFrame], DataFrame]


def model_slot(f: Callable[[pd.Series], pd.Series]) -> Model:
    """A model from a function over batches of prompts. A batch that fails gives rows that begin ``[ERROR:``."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            try:
                yield f(batch)
            except Exception as e:
                yield pd.Series([f"[ERROR: {e}]"] * len(batch))

    return run


def guarded(f: Callable[[pd.Series], pd.Series], most_failures: int = 5, size: int = 32) -> Model:
    """A model in batches of size: a failed batch gives error rows; after most_failures in a row a task calls the model no more and its rows begin ``[ABORTED:``."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        failures = 0
        for batch in batches:
            out = []
            for k in range(0, len(batch), size):
                part = batch.iloc[k : k + size]
                if failures >= most_failures:
                    out.append(pd.Series(["[ABORTED: too many failures]"] * len(part)))
                    continue
                try:
                    out.append(f(part).reset_index(drop=True))
                    failures = 0
                except Exception as e:
                    failures += 1
                    out.append(pd.Series([f"[ERROR: {e}]"] * len(part)))
            yield pd.concat(out, ignore_index=True) if out else pd.Series([], dtype="object")

    return run


def direct(queries: DataFrame, model: Model, style: str = "concise") -> DataFrame:
    """(query_id, prompt, prediction)."""
    return queries.select("query_id", prompt(F.col("text"), None, style).alias("prompt")).withColumn("prediction", model(F.col("prompt")))


def _context(hits: DataFrame) -> DataFrame:
    """(query_id, docs): the hits of a query, best first; a query has at most the k that search returns."""
    docs = F.array_sort(F.collect_list(F.struct("rank", "doc_id", "text", "score")))
    return hits.groupBy("query_id").agg(docs.alias("docs"))


def rag(queries: DataFrame, search: Search, model: Model, style: str = "concise", rerank: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(query_id, docs, prompt, prediction): retrieve, rerank if asked, generate. Queries without hits get an empty context."""
    hits = search(queries)
    hits = rerank(hits) if rerank else hits
    both = queries.join(_context(hits), "query_id", "left")
    context = F.coalesce(passages(F.col("docs")), F.lit(""))
    return both.select("query_id", "docs", prompt(F.col("text"), context, style).alias("prompt")).withColumn("prediction", model(F.col("prompt")))


def iterative(queries: DataFrame, search: Search, judge: Model, refine: Model, model: Model, k: int = 5, rounds: int = 2, style: str = "concise") -> DataFrame:
    """(query_id, iterations, docs, prompt, prediction): rounds of retrieval for the queries whose context is not sufficient yet.

    Documents of all rounds are merged by text, the first occurrence counts. Sufficiency is judged on the 2k best by score; the final context is the first 2k in the
    order in which they came."""
    ensure_checkpoints(queries.sparkSession)
    columns = ["query_id", "doc_id", "text", "score", "round", "rank"]
    open_ = queries.select("query_id", "text", F.col("text").alias("ask"))
    docs, settled = None, None
    for r in range(1, rounds + 1):
        hits = search(open_.select("query_id", F.col("ask").alias("text"))).withColumn("round", F.lit(r)).select(*columns)
        all_hits = hits if docs is None else docs.unionByName(hits)
        docs = best(all_hits, ["query_id", "text"], [F.asc("round"), F.asc("rank")], 1, name="seen").select(*columns).checkpoint()
        top = best(docs, ["query_id"], [F.desc("score"), F.asc("doc_id")], 2 * k, name="place").select("query_id", F.col("place").alias("rank"), "doc_id", "text", "score")
        asked = open_.join(_context(top), "query_id", "left").withColumn("context", F.coalesce(passages(F.col("docs")), F.lit("")))
        judged = asked.withColumn("enough", sufficient(judge(prompt(F.col("text"), F.col("context")))) | F.lit(r == rounds)).checkpoint()
        done = judged.filter("enough").select("query_id", F.lit(r).alias("iterations"))
        settled = done if settled is None else settled.unionByName(done)
        open_ = judged.filter("not enough").select("query_id", "text", refine(prompt(F.col("text"), F.col("context"))).alias("ask")).checkpoint()
    final = best(docs, ["query_id"], [F.asc("round"), F.asc("rank")], 2 * k, name="place").select("query_id", F.col("place").alias("rank"), "doc_id", "text", "score")
    both = queries.join(settled, "query_id").join(_context(final), "query_id", "left")
    return both.select("query_id", "iterations", "docs", prompt(F.col("text"), F.coalesce(passages(F.col("docs")), F.lit("")), style).alias("prompt")).withColumn("prediction", model(F.col("prompt")))


def self_reflective(queries: DataFrame, search: Search, assess: Model, model: Model, verify: Model | None = None, threshold: float = 0.7, style: str = "concise") -> DataFrame:
    """(query_id, confidence, route, docs, prediction): retrieve only where the model's confidence is up to the threshold; an answer that is not
    supported by its context gives way to the direct one, without documents."""
    ensure_checkpoints(queries.sparkSession)
    assessed = queries.withColumn("confidence", confidence(assess(prompt(F.col("text"))))).checkpoint()
    sure = direct(assessed.filter(F.col("confidence") > threshold), model, style).withColumn("route", F.lit("direct")).withColumn("docs", F.lit(None))
    unsure = assessed.filter(F.col("confidence") <= threshold)
    found = rag(unsure, search, model, style).withColumn("route", F.lit("rag"))
    if verify is not None:
        told = found.withColumn("verdict", verification(verify(F.concat_ws("\n", F.col("prompt"), F.col("prediction"))))).checkpoint()
        back = direct(unsure.join(told.filter("verdict = 'NOT_SUPPORTED'").select("query_id"), "query_id", "left_semi"), model, style).withColumn("route", F.lit("fallback"))
        found = told.filter("verdict <> 'NOT_SUPPORTED'").drop("verdict").unionByName(back.withColumn("docs", F.lit(None)))
    return found.unionByName(sure).join(assessed.select("query_id", "confidence"), "query_id").select("query_id", "confidence", "route", "docs", "prediction")


def pending(queries: DataFrame, done: DataFrame, key: str = "query_id") -> DataFrame:
    """Queries without a result yet."""
    return queries.join(done.select(key), key, "left_anti")
