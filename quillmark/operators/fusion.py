"""Rank fusion, merging of expanded queries, reranking, and the embedding and retrieval caches as joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.functions.text import normalize_context, overlap, sentences, text_hash, words
from quillmark.operators.ranking import best, top

RRF, CANDIDATES, RERANK_FACTOR = 60, 3, 4


def rrf(dense: DataFrame, sparse: DataFrame, k: int, alpha: float = 0.5, constant: int = RRF) -> DataFrame:
    """(query_id, doc_id, score, rank): reciprocal ranks, from 1, of two hit lists (ranks from 0) weighed alpha and 1 - alpha. A
    document of one list has that term alone, which is 0 for a weight of 0."""
    term = lambda w: (F.lit(float(w)) / (constant + 1 + F.col("rank"))).alias("part")
    parts = dense.select("query_id", "doc_id", term(alpha)).unionByName(sparse.select("query_id", "doc_id", term(1 - alpha)))
    return top(parts.groupBy("query_id", "doc_id").agg(F.sum("part").alias("score")), k)


def candidates(k: int) -> int:
    """Hits that fusion takes of each list."""
    return CANDIDATES * k


def fetch_k(explicit: Column, top_k: Column, reranker: Column) -> Column:
    """What to retrieve: as given, or four times top_k for a reranker, or null."""
    return F.coalesce(explicit, F.when(F.coalesce(reranker, F.lit("none")) != "none", top_k * RERANK_FACTOR))


def merge_expansions(hits: DataFrame, k: int) -> DataFrame:
    """(query_id, doc_id, score, rank) of hits (query_id, expansion, doc_id, text, score, rank): of each text the first
    occurrence, by expansion and rank, then the k best."""
    hashed = hits.select("query_id", "expansion", "doc_id", "score", "rank", F.sha2("text", 256).alias("of"))  # texts stay out of the shuffle
    first = best(hashed, ["query_id", "of"], [F.asc("expansion"), F.asc("rank")], 1, name="seen")
    return top(first.select("query_id", "doc_id", "score"), k)


def sentence_expansions(queries: DataFrame, most: int = 3) -> DataFrame:
    """(query_id, expansion, text): a query and its first sentences, as a stand-in for a model's variations."""
    texts = F.concat(F.array("text"), F.slice(sentences(F.col("text")), 1, most))
    return queries.select("query_id", F.posexplode(texts).alias("expansion", "text"))


def model_expansions(queries: DataFrame, expand) -> DataFrame:
    """(query_id, expansion, text): the original, numbered 0, and what a model makes of it: expand is a pandas UDF from a text to an array of texts (a
    hypothetical document, variations). Repeats of the original are left out."""
    new = F.filter(expand(F.col("text")), lambda t: F.lower(F.trim(t)) != F.lower(F.trim("text")))
    return queries.select("query_id", F.posexplode(F.concat(F.array("text"), F.coalesce(new, F.array().cast("array<string>")))).alias("expansion", "text"))


def overlap_score(query: Column, text: Column) -> Column:
    """Share of the query's distinct words in the text."""
    return overlap(words(normalize_context(query)), words(normalize_context(text)))


def rerank(hits: DataFrame, queries: DataFrame, docs: DataFrame, k: int, score: Column | None = None) -> DataFrame:
    """(query_id, doc_id, retrieval_score, retrieval_rank, rerank_score, rank): hits (query_id, doc_id, score, rank) scored again on (query, text);
    ranks from 1. score: a Column over ``query`` and ``text``, by default their overlap; a model goes in as a pandas UDF."""
    pairs = hits.join(queries.select("query_id", F.col("text").alias("query")), "query_id").join(docs.select("doc_id", "text"), "doc_id")
    again = score if score is not None else overlap_score(F.col("query"), F.col("text"))
    scored = pairs.select("query_id", "doc_id", F.col("score").alias("retrieval_score"), (F.col("rank") + 1).alias("retrieval_rank"), F.round(again, 9).alias("rerank_score"))
    return best(scored, ["query_id"], [F.desc("rerank_score"), F.asc("retrieval_rank")], k, base=1)


def cache_key(retriever: Column, alpha: Column, rrf_k: Column) -> Column:
    """Name under which results are cached: retriever, and for a hybrid its weight and constant."""
    hybrid = F.concat(retriever, F.lit("_a"), F.format_string("%.2f", alpha), F.lit("_c"), rrf_k.cast("string"))
    return F.when(alpha.isNull(), retriever).otherwise(hybrid)


def cache_split(rows: DataFrame, cache: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows that the cache has, with its values, and those that it lacks. A row without ``text_hash`` gets it from ``text``."""
    rows = rows if "text_hash" in rows.columns else rows.withColumn("text_hash", text_hash(F.col("text")))
    return rows.join(cache, keys), rows.join(cache, keys, "left_anti")


def cache_put(cache: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The cache with those of new whose keys it lacks, the first of repeated keys."""
    return cache.unionByName(new.dropDuplicates(keys).join(cache, keys, "left_anti").select(*cache.columns))
