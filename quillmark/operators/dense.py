"""Dense indexes and exact search in them.

Queries are taken in blocks of ``QUERY_BLOCK``, so what is sent to the tasks has a fixed bound. Each task scores an Arrow batch against
a block as one matrix product and keeps the k best of its own; those few rows are then ranked for each query.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.functions.text import unit
from quillmark.operators.ranking import DIGITS, best, top

QUERY_BLOCK = 2048
_HIT = "query_id long, doc_id long, score double"


def build(vectors: DataFrame) -> DataFrame:
    """(doc_id, v): vectors of length one (a zero vector stays zero), as doubles."""
    return vectors.select("doc_id", unit(F.col("embedding")).alias("v"))


def _matrix(column: pa.Array) -> np.ndarray:
    if pc.count_distinct(pc.list_value_length(column)).as_py() > 1:
        raise ValueError("the index holds vectors of different lengths")
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _whole(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The rows whose vector is there, without a null in it."""
    column = batch.column(1)
    if column.null_count or column.flatten().null_count:
        return batch.filter(pa.array([v is not None and None not in v for v in column.to_pylist()]))
    return batch


def _scored(sent, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, queries = sent.value
        held = [np.zeros((0,), np.int64), np.zeros((0,), np.int64), np.zeros((0,))]
        for batch in map(_whole, batches):
            if not batch.num_rows:
                continue
            docs, scores = batch.column(0).to_numpy(), np.round(queries @ _matrix(batch.column(1)).T, DIGITS)
            most = min(k, len(docs))
            cut = -np.partition(-scores, most - 1, axis=1)[:, most - 1]
            q, d = np.nonzero(scores >= cut[:, None])  # ties at the cut stay until ids are compared
            q, s, d = (np.concatenate(x) for x in zip(held, (q, scores[q, d], docs[d]), strict=True)) if len(held[0]) else (q, scores[q, d], docs[d])
            order = np.lexsort((d, -s, q))
            q, s, d = q[order], s[order], d[order]
            keep = np.arange(len(q)) - np.searchsorted(q, q) < k
            held = [q[keep], s[keep], d[keep]]
        q, s, d = held
        yield pa.RecordBatch.from_arrays([pa.array(ids[q.astype(np.int64)]), pa.array(d.astype(np.int64)), pa.array(s.astype(np.float64))], names=["query_id", "doc_id", "score"])

    return run


def search(index: DataFrame, queries: DataFrame, k: int = 10, base: int = 0) -> DataFrame:
    """(query_id, doc_id, score, rank): the k largest inner products of each query (query_id, embedding), scaled to length one, with
    the index (doc_id, v). Vectors that are null or hold a null take no part; vectors of different lengths are an error."""
    spark = index.sparkSession
    asked = queries.filter(F.col("embedding").isNotNull() & ~F.exists("embedding", lambda x: x.isNull())).select("query_id", unit(F.col("embedding")).alias("v"))
    blocks = max(1, ceil(asked.count() / QUERY_BLOCK))
    found = spark.createDataFrame([], _HIT)
    for b in range(blocks):
        own = sorted((r["query_id"], r["v"]) for r in asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).collect())
        if own:
            sent = spark.sparkContext.broadcast((np.array([x[0] for x in own], np.int64), np.array([x[1] for x in own])))
            found = found.unionByName(index.select(F.col("doc_id").cast("long").alias("doc_id"), "v").mapInArrow(_scored(sent, k), _HIT))
    return top(found, k, base=base)


def search_sharded(index: DataFrame, queries: DataFrame, k: int = 10, shards: int = 4) -> DataFrame:
    """As search, over an index in shards by hash: k of each shard, then the k best."""
    parts = [search(index.filter(F.pmod(F.xxhash64("doc_id"), F.lit(shards)) == s), queries, k).drop("rank") for s in range(shards)]
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    return top(found, k)


def search_hierarchical(children: DataFrame, queries: DataFrame, k: int = 5, more: int = 5) -> DataFrame:
    """(query_id, doc_id, score, matched_child, rank): the k parents of the best children among each query's ``more`` times k. children:
    (doc_id, parent_id, v)."""
    hits = search(children, queries, k * more).drop("rank").join(children.select("doc_id", "parent_id"), "doc_id")
    first = best(hits, ["query_id", "parent_id"], [F.desc("score"), F.asc("doc_id")], 1)
    parents = first.select("query_id", F.col("parent_id").alias("doc_id"), "score", F.col("doc_id").alias("matched_child"))
    return top(parents, k)
