"""Inverted lists over dense vectors, plain or with product-quantised codes, as tables in a folder.

A coarse quantiser of unit vectors is trained by k-means whose sums are formed in the tasks. Every vector belongs to the list of its nearest
centre, which is a folder of the table; a search probes each query's nearest lists, reads the folders of probed lists alone and
meets queries and vectors by a join on the list. With codes, what a vector differs from its centre by is cut into stretches of coordinates, each replaced by the
number of its nearest codeword; scores are sums of table look-ups, and the best candidates are scored again on their vectors.

Training takes a sample of a stated size (``TRAIN`` vectors a list, ``MOST_TRAIN`` at most); every vector is indexed. Centres and codebooks are bounded
(4,096 lists, 256 words) and sent to the tasks; nothing else is. A list longer than ``PART`` is several parts, and queries meet
it in blocks of ``QUERY_BLOCK``, so no task holds more, however hot a list is.

A build works in batches. The first is what the quantiser learns from; each batch is a folder of its own that is complete or absent, so a
build that was stopped goes on with the batches that are missing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmark.functions.text import dot, unit
from quillmark.operators.ranking import DIGITS, top
from quillmark.session import exists, new_folder, stored

#: Vectors to a list, at most, that the quantiser learns from, and in all; rounds of k-means.
TRAIN, MOST_TRAIN, ROUNDS = 256, 1_048_576, 8
#: Vectors of a list, and queries, that meet in one task.
PART, QUERY_BLOCK = 65_536, 2048
#: Batches of a build at most. Each is several jobs and a file for each list, so beyond that a larger table has larger batches.
MOST_BATCHES = 16
#: Words of a codebook; candidates a result that are scored on their vectors.
WORDS, RERANK = 256, 10


def lists_for(n: int) -> int:
    return min(4096, max(64, int(2 * n**0.5)))


def probes_for(lists: int) -> int:
    return max(1, min(128, lists // 4))


@dataclass(frozen=True)
class Inverted:
    """An index in a folder: tables ``centres`` (list, v), ``codebooks`` (sub, word, v) if it has codes, and ``lists`` in folders of batch and list."""

    spark: SparkSession
    path: str

    def table(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/lists").withColumn("list", F.col("list").cast("long"))

    def centres(self) -> np.ndarray:
        return np.array([r["v"] for r in self.spark.read.parquet(f"{self.path}/centres").orderBy("list").collect()])

    def codebooks(self) -> np.ndarray | None:
        """(subspaces, words, coordinates), or None if vectors are kept as they are."""
        if not exists(self.spark, f"{self.path}/codebooks"):
            return None
        rows = self.spark.read.parquet(f"{self.path}/codebooks").orderBy("sub", "word").collect()
        return np.array([r["v"] for r in rows]).reshape(rows[-1]["sub"] + 1, -1, len(rows[0]["v"]))

    def bytes(self) -> int:
        """Size of the files of the lists."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/lists")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).getContentSummary(path).getLength()


def normal(vectors: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, v): vectors (key, embedding) of length one; those that are null, empty or hold a null are left out."""
    whole = F.col("embedding").isNotNull() & (F.size("embedding") > 0) & ~F.exists("embedding", lambda x: x.isNull())
    return vectors.filter(whole).select(F.col(key).cast("long").alias(key), unit(F.col("embedding")).alias("v"))


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat, n = column.flatten().to_numpy(zero_copy_only=False), len(column)
    if n and len(flat) % n:
        raise ValueError("vectors of different lengths")
    return flat.reshape(n, -1)


def _lists(rows: np.ndarray) -> pa.ListArray:
    n, d = rows.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * d), pa.array(np.ascontiguousarray(rows, np.float64).reshape(-1)))


def _sums(sent):
    """Of each task and list the sum of its vectors and their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = sent.value
        total, n = np.zeros_like(centres), np.zeros(len(centres), np.int64)
        for batch in batches:
            v = _matrix(batch.column(0))
            if len(v):
                at = (v @ centres.T).argmax(axis=1)
                np.add.at(total, at, v)
                n += np.bincount(at, minlength=len(n))
        had = np.nonzero(n)[0]
        yield pa.RecordBatch.from_arrays([pa.array(had), pa.array(n[had]), _lists(total[had])], names=["list", "n", "v"])

    return run


def _add(table: pa.Table) -> pa.Table:
    total, n = _matrix(table["v"]).sum(axis=0), table["n"].to_numpy().sum()
    return pa.table({"list": table["list"].slice(0, 1), "n": [n], "v": _lists(total[None])})


def train_centres(sample: DataFrame, lists: int, rounds: int = ROUNDS) -> np.ndarray:
    """(lists, dim) centres of length one, by k-means of the sample's unit vectors (doc_id, v). Sums are formed in tasks and added up for each list; an
    empty list keeps its centre. Begins with the ``lists`` vectors that come first by hash; fewer vectors make fewer lists."""
    spark = sample.sparkSession
    first = sample.select("doc_id", "v", F.xxhash64("doc_id").alias("h")).orderBy("h", "doc_id").limit(lists).collect()
    if not first:
        raise ValueError("no vector to learn from")
    centres = np.array([r["v"] for r in first])
    for _ in range(rounds):
        parts = sample.select("v").mapInArrow(_sums(spark.sparkContext.broadcast(centres)), "list long, n long, v array<double>")
        for r in parts.groupBy("list").applyInArrow(_add, "list long, n long, v array<double>").collect():  # a row for each list
            v = np.array(r["v"])
            centres[r["list"]] = v / max(np.linalg.norm(v), 1e-12)
    return centres


def _words(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    """k-means of one stretch of coordinates, by Euclidean distance."""
    rng = np.random.default_rng(seed)
    words = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        at = (x @ words.T - 0.5 * (words**2).sum(axis=1)).argmax(axis=1)
        n = np.bincount(at, minlength=k)
        total = np.zeros_like(words)
        np.add.at(total, at, x)
        words[n > 0] = total[n > 0] / n[n > 0, None]
    return words


def _rests(sent, subs: int):
    """What each vector differs from its centre by, a row for each stretch of coordinates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = sent.value
        for batch in batches:
            v = _matrix(batch.column(0))
            if len(v):
                rest = v - centres[(v @ centres.T).argmax(axis=1)]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(subs, dtype=np.int64), len(v))), _lists(np.concatenate(np.split(rest, subs, axis=1)))], names=["sub", "v"])

    return run


def train_codebooks(sample: DataFrame, centres: np.ndarray, subs: int, words: int = WORDS, rounds: int = 2 * ROUNDS) -> np.ndarray:
    """(subs, words, dim / subs): a codebook for each stretch of coordinates, each learnt in a task of its own from the bounded sample."""
    if centres.shape[1] % subs:
        raise ValueError(f"{subs} stretches do not divide {centres.shape[1]} coordinates")

    def learn(key: tuple, table: pa.Table) -> pa.Table:
        sub = key[0].as_py()
        found = _words(_matrix(table["v"]), words, rounds, sub)
        return pa.table({"sub": np.full(words, sub), "word": np.arange(words), "v": _lists(found)})

    rests = sample.select("v").mapInArrow(_rests(sample.sparkSession.sparkContext.broadcast(centres), subs), "sub long, v array<double>")
    rows = rests.groupBy("sub").applyInArrow(learn, "sub long, word long, v array<double>").orderBy("sub", "word").collect()
    return np.array([r["v"] for r in rows]).reshape(subs, words, -1)


def encode(rest: np.ndarray, books: np.ndarray) -> np.ndarray:
    """(n, subs) numbers of the nearest words."""
    parts = np.split(rest, len(books), axis=1)
    return np.stack([(x @ w.T - 0.5 * (w**2).sum(axis=1)).argmax(axis=1) for x, w in zip(parts, books, strict=True)], axis=1).astype(np.uint8)


def _assign(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, books = sent.value
        for batch in batches:
            v = _matrix(batch.column(1))
            if len(v):
                at = (v @ centres.T).argmax(axis=1)
                kept = batch.column(1) if books is None else pa.array([c.tobytes() for c in encode(v - centres[at], books)], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(at), kept, *batch.columns[2:]], names=["doc_id", "list", "kept", *batch.schema.names[2:]])

    return run


def assigned(rows: DataFrame, centres: np.ndarray, books: np.ndarray | None) -> DataFrame:
    """(doc_id, list, v and other columns) of unit vectors (doc_id, v and others), or with codebooks (doc_id, list, code and others)."""
    name, kind = ("v", "array<double>") if books is None else ("code", "binary")
    more = [c for c in rows.columns if c not in ("doc_id", "v")]
    schema = T.StructType([*T._parse_datatype_string(f"doc_id long, list long, kept {kind}").fields, *(rows.schema[c] for c in more)])
    sent = rows.sparkSession.sparkContext.broadcast((centres, books))
    return rows.select("doc_id", "v", *more).mapInArrow(_assign(sent), schema).withColumnRenamed("kept", name)


def _sample(rows: DataFrame, n: int, most: int) -> DataFrame:
    """About ``most`` of n rows, by hash of their ids, always the same."""
    return rows if n <= most else rows.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(most / n * (1 << 30)))


def train(rows: DataFrame, path: str, lists: int | None = None, subs: int = 0, total: int | None = None) -> None:
    """Writes centres, and with ``subs`` stretches codebooks, learnt from unit vectors (doc_id, v); of ``total`` vectors in the end, if these are but the first."""
    n = rows.count()
    lists = lists or lists_for(total or n)
    sample = stored(_sample(rows, n, min(MOST_TRAIN, TRAIN * lists)), f"{path}/sample")
    spark, centres = rows.sparkSession, train_centres(sample, lists)
    if subs:
        books = train_codebooks(_sample(sample, n, MOST_TRAIN // 16), centres, subs)
        words = [(s, w, books[s, w].tolist()) for s in range(len(books)) for w in range(books.shape[1])]
        stored(spark.createDataFrame(words, "sub long, word long, v array<double>").coalesce(1), f"{path}/codebooks")
    stored(spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "list long, v array<double>").coalesce(1), f"{path}/centres")


def add_batch(index: Inverted, rows: DataFrame, batch: int) -> None:
    """Assigns unit vectors (doc_id, v and other columns) and writes them as the batch, in place of what an earlier try of it left."""
    out = stored(assigned(rows, index.centres(), index.codebooks()), new_folder(index.spark, "assigned"))
    parts = out.groupBy("list").agg(F.ceil(F.count("*") / PART).alias("parts"))
    out = out.join(F.broadcast(parts), "list")  # a row for each list, 4,096 at most
    out = out.withColumn("part", F.pmod(F.xxhash64("doc_id"), "parts")).drop("parts")
    out.repartition("list", "part").write.mode("overwrite").partitionBy("list").parquet(f"{index.path}/lists/batch={batch}")


def build(vectors: DataFrame, path: str, lists: int | None = None, subs: int = 0, batch_rows: int | None = None, stop: Callable[[int], None] | None = None) -> Inverted:
    """The index of vectors (doc_id, embedding) in the folder ``path``, with ``subs`` bytes a vector if given, else with whole vectors.

    With ``batch_rows`` the vectors are dealt into batches of about as many by hash, or of more where that would be over ``MOST_BATCHES``; the first is learnt from. What an earlier, stopped build left in the folder is kept: the quantiser
    if it is there, and complete batches. ``stop`` is called before each batch. Ids are not null; a repeated id is several vectors, with codes alike in their scores' rank only."""
    rows, index = normal(vectors), Inverted(vectors.sparkSession, path)
    total = rows.count()
    batches = min(MOST_BATCHES, max(1, ceil(total / batch_rows))) if batch_rows else 1
    at = F.pmod(F.xxhash64(F.lit("batch"), "doc_id"), F.lit(batches))
    for b in range(batches):
        own = rows.filter(at == b)
        if not exists(index.spark, f"{path}/centres/_SUCCESS"):
            train(own, path, lists, subs, total)
        if not exists(index.spark, f"{path}/lists/batch={b}/_SUCCESS"):
            if stop:
                stop(b)
            add_batch(index, own, b)
    return index


def _probes(sent, probes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = sent.value
        for batch in batches:
            q = _matrix(batch.column(1))
            if len(q):
                near = np.argpartition(-(q @ centres.T), min(probes, len(centres)) - 1, axis=1)[:, :probes]
                row = np.repeat(np.arange(len(q)), near.shape[1])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(near.reshape(-1).astype(np.int64)), batch.column(1).take(pa.array(row))], names=["query_id", "list", "v"])

    return run


def _meet(sent, k: int):
    """The k best of a part of a list for each query of a block."""

    def run(key: tuple, asked: pa.Table, held: pa.Table) -> pa.Table:
        centres, books = sent.value
        empty = pa.table({"query_id": pa.array([], pa.int64()), "doc_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        if not len(asked) or not len(held):
            return empty
        q, docs = _matrix(asked["v"]), held["doc_id"].to_numpy()
        if books is None:
            scores = q @ _matrix(held["v"]).T
        else:
            codes = np.frombuffer(b"".join(held["code"].to_pylist()), np.uint8).reshape(len(docs), -1)
            scores = np.repeat((q @ centres[key[0].as_py()])[:, None], len(docs), axis=1)
            for sub, words in enumerate(books):
                scores += (np.split(q, len(books), axis=1)[sub] @ words.T)[:, codes[:, sub]]
        scores = np.round(scores, DIGITS)
        most = min(k, len(docs))
        cut = -np.partition(-scores, most - 1, axis=1)[:, most - 1]
        i, d = np.nonzero(scores >= cut[:, None])  # ties at the cut stay until ids are compared
        order = np.lexsort((docs[d], -scores[i, d], i))
        i, d = i[order], d[order]
        keep = np.arange(len(i)) - np.searchsorted(i, i) < k
        i, d = i[keep], d[keep]
        return pa.table({"query_id": asked["query_id"].to_numpy()[i], "doc_id": docs[d], "score": scores[i, d]})

    return run


def search(index: Inverted, queries: DataFrame, k: int = 10, probes: int | None = None, vectors: DataFrame | None = None, rerank: int = RERANK) -> DataFrame:
    """(query_id, doc_id, score, rank): the k best inner products of each query (query_id, embedding) found in its ``probes`` nearest lists, all lists
    if it says as many. With codes, ``rerank`` times k candidates are scored again on ``vectors`` (doc_id, embedding)."""
    spark, asked = index.spark, normal(queries, "query_id")
    centres, books = index.centres(), index.codebooks()
    if books is not None and vectors is None:
        raise ValueError("codes are scored again on vectors, which are not given")
    probes = min(probes or probes_for(len(centres)), len(centres))
    probing = asked.mapInArrow(_probes(spark.sparkContext.broadcast(centres), probes), "query_id long, list long, v array<double>")
    counts = [(r["list"], ceil(r["n"] / QUERY_BLOCK)) for r in probing.groupBy("list").agg(F.count("*").alias("n")).collect()]  # 4,096 lists at most
    held = index.table().filter(F.col("list").isin([c[0] for c in counts])) if len(counts) < len(centres) else index.table()
    blocks = F.broadcast(spark.createDataFrame(counts, "list long, blocks long"))
    parts = index.table().select("list", F.col("batch").alias("in_batch"), F.col("part").alias("in_part")).distinct()
    kept = "v" if books is None else "code"
    left = probing.join(parts, "list").join(blocks, "list").select(F.col("list").alias("in_list"), "in_batch", "in_part", F.pmod(F.xxhash64("query_id"), "blocks").alias("in_block"), "query_id", "v")
    right = held.join(blocks, "list").select("list", "batch", "part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), "doc_id", kept)
    sent, most = spark.sparkContext.broadcast((centres, books)), k if books is None else k * rerank
    found = left.groupBy("in_list", "in_batch", "in_part", "in_block").cogroup(right.groupBy("list", "batch", "part", "block")).applyInArrow(_meet(sent, most), "query_id long, doc_id long, score double")
    if books is not None:
        best = top(found, most).select("query_id", "doc_id")
        own, its = normal(vectors).select("doc_id", F.col("v").alias("dv")), asked.select("query_id", F.col("v").alias("qv"))
        found = best.join(own, "doc_id").join(its, "query_id").select("query_id", "doc_id", dot(F.col("qv"), F.col("dv")).alias("score"))
    return top(found, k)
