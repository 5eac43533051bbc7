"""A proximity graph over dense vectors as a table, and greedy search in it for all queries at once.

The first links are the best among vectors that share one of their nearest pivots. Then the graph is built by rounds: each vector's neighbours, and those that name it one, are compared
with each other, and every vector keeps the ``degree`` best it has met. A round ships only what gathers around vectors that have met someone new, in single precision, as links alone are chosen by it. Rounds end
when few links change. No vector gathers more than twice ``degree`` others, however many name it a neighbour, so a round costs n times degree vectors of shuffle at most and no task holds
a hub. An upper level of entries, a sample by hash of ``ENTRIES`` vectors at most, is sent to the tasks; queries begin at their nearest entries.

Search goes in rounds, too: each query's best ``width`` vectors so far are followed to their neighbours, which are scored, until none of them is new.
A vector that fell out of the best never comes back, so nothing but the best is remembered.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmark.functions.text import dot
from quillmark.operators.inverted import _matrix, normal
from quillmark.operators.ranking import DIGITS, top
from quillmark.session import new_folder, stored

DEGREE, WIDTH = 16, 128
ENTRIES, STARTS = 4096, 8
#: Vectors to a pivot of the first links; pivots at most; nearest pivots whose others a vector meets; vectors that meet in one group at most, about.
BUCKET, PIVOTS, NEAREST, MOST = 64, 4096, 12, 1024
#: Rounds at most; share of links whose change is few.
ROUNDS, SETTLED = 12, 0.005
SEARCH_ROUNDS = 64


@dataclass(frozen=True)
class Graph:
    """Tables in a folder: ``nodes`` (doc_id, v, near) and ``entries`` (doc_id, v)."""

    spark: SparkSession
    path: str

    def nodes(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/nodes")

    def entries(self) -> tuple[np.ndarray, np.ndarray]:
        rows = self.spark.read.parquet(f"{self.path}/entries").orderBy("doc_id").collect()  # ENTRIES at most
        return np.array([r["doc_id"] for r in rows], np.int64), np.array([r["v"] for r in rows])


_LINK = "a long, b long, s double"


def _among(degree: int):
    """Links (a, b, s) among the vectors of each group [(id, v, least, new)] of which one is new: those of a's best that are above its ``least`` score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for group in batch.column(0):
                own = group.values
                ids, v, least, new = own.field("id").to_numpy(), _matrix(own.field("v")).astype(np.float64), own.field("least").to_numpy(), own.field("new").to_numpy(zero_copy_only=False)
                s = np.round(v @ v.T, DIGITS)
                s[(ids[:, None] == ids[None, :]) | ~(new[:, None] | new[None, :])] = -np.inf
                if len(ids) > degree + 1:
                    s[s < -np.partition(-s, degree - 1, axis=1)[:, degree - 1 : degree]] = -np.inf
                i, j = np.nonzero(s > least[:, None])
                out.append((ids[i], ids[j], s[i, j]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["a", "b", "s"])

    return run


def _grouped(rows: DataFrame, by: list[str], degree: int) -> DataFrame:
    """rows: (by, id, v, least, new)."""
    return rows.groupBy(*by).agg(F.collect_list(F.struct("id", "v", "least", "new")).alias("own")).select("own").mapInArrow(_among(degree), _LINK)


def _kept(links: DataFrame, degree: int, by: str = "a") -> DataFrame:
    """The ``degree`` best links of each a (or b), ties to the smaller id."""
    other = "b" if by == "a" else "a"
    w = Window.partitionBy(by).orderBy(F.desc("s"), other)
    return links.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= degree).drop("r")


def _merged(links: DataFrame, degree: int) -> DataFrame:
    """The ``degree`` best links of each a, each once, by one exchange."""
    return _kept(links.repartition("a").groupBy("a", "b").agg(F.max("s").alias("s")), degree)


def _pivoted(sent):
    """Each vector's nearest pivots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots = sent.value
        for batch in batches:
            v = _matrix(batch.column(1))
            if len(v):
                at = np.argpartition(-(v @ pivots.T), min(NEAREST, len(pivots)) - 1, axis=1)[:, :NEAREST]
                ends = pa.array(np.arange(len(v) + 1, dtype=np.int32) * at.shape[1])
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(ends, pa.array(at.reshape(-1)))], names=["id", "v", "pivots"])

    return run


def build(vectors: DataFrame, path: str, degree: int = DEGREE, rounds: int = ROUNDS) -> Graph:
    """The graph of vectors (doc_id, embedding), ids unlike and not null, in the folder ``path``. A vector links to at most ``degree`` others and to as many that name it a neighbour.
    Vectors that are null, empty or hold a null are left out; a single vector has no neighbour."""
    spark = vectors.sparkSession
    work = new_folder(spark, "graph")
    rows = stored(normal(vectors), f"{work}/vectors")
    n = rows.count()
    first = rows.select("doc_id", "v", F.xxhash64("doc_id").alias("h")).orderBy("h", "doc_id")
    pivots = np.array([r["v"] for r in first.limit(min(PIVOTS, max(1, n // BUCKET))).collect()])
    pivots = np.unique(pivots, axis=0) if len(pivots) else pivots  # copies are one pivot
    near = rows.select(F.col("doc_id").alias("id"), "v").mapInArrow(_pivoted(spark.sparkContext.broadcast(pivots)), "id long, v array<double>, pivots array<long>")
    near = stored(near.withColumn("v", F.col("v").cast("array<float>")), f"{work}/near")
    each = near.select(F.explode("pivots").alias("pivot"))
    parts = each.groupBy("pivot").agg(F.ceil(F.count("*") / MOST).alias("parts"))  # a row for each pivot
    none = F.lit(float("-inf"))
    met = near.select("id", "v", F.explode("pivots").alias("pivot")).join(F.broadcast(parts), "pivot").withColumn("part", F.pmod(F.xxhash64("id", "pivot"), F.col("parts")))
    met = _grouped(met.select("pivot", "part", "id", "v", none.alias("least"), F.lit(True).alias("new")), ["pivot", "part"], degree)
    links = stored(_merged(met, degree), f"{work}/links-0")
    own, before = near.select("id", "v"), None
    for k in range(1, rounds + 1):
        least = links.groupBy("a").agg(F.when(F.count("*") >= degree, F.min("s")).otherwise(float("-inf")).alias("least"))
        back = _kept(links, degree, "b").select(F.col("b").alias("u"), F.col("a").alias("id"))
        members = links.select(F.col("a").alias("u"), F.col("b").alias("id")).unionByName(back).unionByName(own.select(F.col("id").alias("u"), "id"))
        members = stored(members.groupBy("u").agg(F.collect_set("id").alias("ids")), f"{work}/members-{k}")
        # What has met around a vector before needs no second meeting.
        known = members.join(before.withColumnRenamed("ids", "old"), "u", "left") if before is not None else members.withColumn("old", F.lit(None).cast("array<long>"))
        fresh = known.withColumn("unmet", F.array_except("ids", F.coalesce("old", F.array().cast("array<long>")))).filter(F.size("unmet") > 0)
        asked = fresh.select("u", F.explode("ids").alias("id"), "unmet").select("u", "id", F.array_contains("unmet", F.col("id")).alias("new"))
        its = own.join(least, own["id"] == least["a"], "left").select("id", "v", F.coalesce("least", none).alias("least"))
        met = _grouped(asked.join(its, "id"), ["u"], degree)
        new = stored(_merged(links.unionByName(met), degree), f"{work}/links-{k}")
        changed = new.join(links, ["a", "b"], "left_anti").count()
        links, before = new, members
        if changed <= SETTLED * n * degree:
            break
    both = links.select("a", "b").unionByName(_kept(links, degree, "b").select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    near = both.groupBy("a").agg(F.sort_array(F.collect_list("b")).alias("near"))
    nodes = rows.join(near, rows["doc_id"] == near["a"], "left").select("doc_id", "v", F.coalesce("near", F.array().cast("array<long>")).alias("near"))
    stored(nodes, f"{path}/nodes")
    stored(first.limit(int(min(ENTRIES, max(64, 4 * n**0.5)))).select("doc_id", "v"), f"{path}/entries")
    return Graph(spark, path)


def _begun(sent, starts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, entries = sent.value
        for batch in batches:
            q = _matrix(batch.column(1))
            if len(q):
                s = np.round(q @ entries.T, DIGITS)
                at = np.argpartition(-s, min(starts, len(ids)) - 1, axis=1)[:, :starts]
                row = np.repeat(np.arange(len(q)), at.shape[1])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(ids[at.reshape(-1)]), pa.array(s[row, at.reshape(-1)])], names=["query_id", "doc_id", "score"])

    return run


def search(graph: Graph, queries: DataFrame, k: int = 10, width: int = WIDTH, rounds: int = SEARCH_ROUNDS) -> DataFrame:
    """(query_id, doc_id, score, rank): the k best inner products of each query (query_id, embedding), ids unlike, that greedy search with ``width`` open vectors finds. Ends after
    ``rounds`` rounds at the latest."""
    spark, work = graph.spark, new_folder(graph.spark, "walk")
    asked = stored(normal(queries, "query_id"), f"{work}/asked")
    nodes, (ids, entries) = graph.nodes(), graph.entries()
    hit = "query_id long, doc_id long, score double"
    if not len(ids):
        return top(spark.createDataFrame([], hit), k)
    begun = asked.mapInArrow(_begun(spark.sparkContext.broadcast((ids, entries)), STARTS), hit)
    state = stored(begun.withColumn("done", F.lit(False)), f"{work}/state-0")
    for r in range(1, rounds + 1):
        ahead = state.filter("not done")
        if ahead.isEmpty():
            break
        onward = ahead.select("query_id", "doc_id").join(nodes.select("doc_id", "near"), "doc_id").select("query_id", F.explode("near").alias("doc_id")).distinct()
        onward = onward.join(state.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti")
        scored = onward.join(nodes.select("doc_id", F.col("v").alias("dv")), "doc_id").join(asked, "query_id").select("query_id", "doc_id", F.round(dot(F.col("v"), F.col("dv")), DIGITS).alias("score"), F.lit(False).alias("done"))
        best = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
        known = state.withColumn("done", F.lit(True)).unionByName(scored)
        state = stored(known.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= width).drop("r"), f"{work}/state-{r}")
    return top(state.drop("done"), k)
