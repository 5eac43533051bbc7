"""The queries of the training-data operators, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillmark.llm import divergence, embedding_dedup, html, language, lines, mixing, nearest, packing, pipeline, rules, simhash, substrings, tries, urls

Query = Callable[[SparkSession, str], DataFrame]


def _over(table: str, operator: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: operator(spark.read.parquet(f"{sf_dir}/{table}.parquet"))


def queries() -> dict[str, Query]:
    return {
        "op1_mixing": _over("documents", mixing.op1),
        "op2_embedding_near_dedup": _over("embeddings", embedding_dedup.op2),
        "op4_nearest_neighbours": _over("embeddings", nearest.op4),
        "op3_language_id": _over("documents", language.op3),
        "op5_url_filter": _over("pages", urls.op5),
        "op6_substring_dedup": _over("documents", substrings.op6),
        "op7_packing": _over("documents", packing.op7),
        "op8_simhash_near_dedup": _over("documents", simhash.op8),
        "op9_html_extraction": _over("pages", html.op9),
        "pipeline": pipeline.run,
        "op10_line_dedup": _over("documents", lines.op10),
        "op11_source_divergence": _over("documents", divergence.op11),
        "op12_quality_rules": _over("documents", rules.op12),
        "op13_prefix_trie": _over("conversations", tries.op13),
    }


def oracle_sql() -> dict[str, str]:
    return {"op5_url_filter": urls.OP5_SQL, "op6_substring_dedup": substrings.OP6_SQL, "op10_line_dedup": lines.OP10_SQL, "op11_source_divergence": divergence.OP11_SQL, "op12_quality_rules": rules.OP12_SQL, "op13_prefix_trie": tries.OP13_SQL}
