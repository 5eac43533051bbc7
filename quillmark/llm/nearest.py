"""Approximate nearest neighbours by randomly rotated one-bit codes.

A vector less the centroid, scaled to length one and rotated, is kept as the signs of its components, packed in words, and two
scalars: its distance from the centroid, and its inner product with the sign vector. A query is rotated alike and its components are
rounded to ``BITS`` bits, packed in as many planes of words. The inner product of query and signs is then a sum of bit counts of
plane and code; with the scalars it estimates that of query and vector without bias. The scalar also bounds the error, and the step of the rounding
bounds its own, each with a chance set by ``EPSILON``. Only vectors whose lower bound of distance does not exceed the k-th smallest distance
known are reranked on their original components.

Distances are kept in terms of the larger of the two lengths, so nothing over- or underflows. Queries go over the index in blocks of at
most about ``QUERY_BLOCK``, so what a job sends to its tasks is bounded.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmark.llm.common import Scratch, did, undid
from quillmark.llm.vectors import dimension, matrix, valid

K, EPSILON, QUERY_BLOCK, BITS = 10, 3.0, 4096, 6


def rotation(dim: int, seed: int = 42) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


def _length(r: np.ndarray) -> np.ndarray:
    """Euclidean lengths of rows; from scaled rows where squares would over- or underflow."""
    with np.errstate(over="ignore", under="ignore"):
        out = np.sqrt((r * r).sum(axis=-1))
    odd = ~np.isfinite(out) | (out < 1e-140)
    if odd.any():
        top = np.maximum(np.abs(r[odd]).max(axis=-1, initial=0.0), 5e-324)
        out[odd] = top * np.sqrt(((r[odd] / top[:, None]) ** 2).sum(axis=-1))
    return out


def _difference(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """x - y, and whether it had to be halved to be finite."""
    with np.errstate(over="ignore"):
        r = x - y
    odd = ~np.isfinite(r).all(axis=-1)
    if odd.any():
        r[odd] = x[odd] / 2 - (y[odd] if y.ndim == x.ndim else y) / 2
    return r, odd


def encode(x: np.ndarray, centroid: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed signs, distances from the centroid, and inner products with the unit sign vectors."""
    r, _ = _difference(x, centroid)
    norm = _length(r)
    turned = (r / np.maximum(norm, 5e-324)[:, None]) @ turn
    return np.packbits(turned > 0, axis=1), norm, np.abs(turned).sum(axis=1) / np.sqrt(x.shape[1])


def _words(codes: np.ndarray) -> np.ndarray:
    """(n, words) of rows of bytes, padded."""
    return np.ascontiguousarray(np.pad(codes, ((0, 0), (0, -codes.shape[1] % 8)))).view(np.uint64)


class Asked:
    """Queries, less the centroid and rotated: their lengths, and the planes of their rounded components."""

    def __init__(self, turned: np.ndarray):
        self.dim = turned.shape[1]
        self.own = _length(turned)
        unit = turned / np.maximum(self.own, 5e-324)[:, None]
        self.low = unit.min(axis=1, initial=0.0)
        self.step = np.maximum(unit.max(axis=1, initial=0.0) - self.low, 1e-300) / ((1 << BITS) - 1)
        levels = np.rint((unit - self.low[:, None]) / self.step[:, None]).astype(np.int64)
        self.levels = levels.sum(axis=1)
        self.planes = [_words(np.packbits((levels >> b & 1).astype(np.uint8), axis=1)) for b in range(BITS)]

    def inner(self, codes: np.ndarray, part: slice) -> np.ndarray:
        """Inner products of rounded unit queries and unit sign vectors, (queries, vectors), from bit counts."""
        hits = np.zeros((self.planes[0][part].shape[0], len(codes)), np.int64)
        for b, plane in enumerate(self.planes):
            for w in range(codes.shape[1]):
                hits += np.bitwise_count(plane[part, None, w] & codes[None, :, w]).astype(np.int64) << b
        ones = np.bitwise_count(codes).sum(axis=1, dtype=np.int64)
        # Signs are 2 x - 1 and components low + step * level, so the sum over components is linear in the counts.
        low, step = self.low[part, None], self.step[part, None]
        return (low * (2 * ones - self.dim) + step * (2 * hits - self.levels[part, None])) / np.sqrt(self.dim)


def distance_bounds(codes: np.ndarray, norm: np.ndarray, inner: np.ndarray, asked: Asked, part: slice = slice(None), epsilon: float = EPSILON) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of distances (queries, vectors); codes in words."""
    own = asked.own[part, None]
    top = np.maximum(np.maximum(own, norm), 5e-324)
    a, b = own / top, norm / top
    safe = np.maximum(inner, 1e-12)
    guess = asked.inner(codes, part) / safe
    error = epsilon * (np.sqrt(np.maximum(0, 1 - safe * safe)) / np.sqrt(max(1, asked.dim - 1)) + asked.step[part, None] / np.sqrt(12)) / safe
    # A length, so never under the difference of the two lengths; the slack covers rounding.
    square = a * a + b * b
    low = np.sqrt(np.maximum(np.maximum(square - 2 * a * b * (guess + error), (a - b) ** 2) - 1e-9, 0))
    high = np.sqrt(np.maximum(square - 2 * a * b * np.maximum(guess - error, -1.0), 0) + 1e-9)
    return low * top, high * top


def bounds(codes: np.ndarray, norm: np.ndarray, inner: np.ndarray, queries: np.ndarray, epsilon: float = EPSILON) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of squared distances; codes in bytes; queries: less the centroid and rotated."""
    low, high = distance_bounds(_words(codes), norm, inner, Asked(queries), epsilon=epsilon)
    return low * low, high * high


def _encoded(dim: int, centroid: np.ndarray, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = rotation(dim, seed)
        for batch in batches:
            codes, norm, inner = encode(matrix(batch.column(2), dim), centroid, turn)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x.tobytes() for x in codes], pa.binary()), pa.array(norm), pa.array(inner), batch.column(2)], names=["vid", "named", "code", "norm", "inner_", "v"])

    return run


def _sums(dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                mean = (matrix(batch.column(0), dim) / batch.num_rows).sum(axis=0)
                yield pa.RecordBatch.from_arrays([pa.array([mean.tolist()], pa.list_(pa.float64())), pa.array([batch.num_rows], pa.int64())], names=["v", "n"])

    return run


def _mean(vectors: DataFrame, dim: int) -> np.ndarray:
    parts = vectors.select("v").mapInArrow(_sums(dim), "v array<double>, n long").select("n", F.posexplode("v").alias("at", "x"))
    total = vectors.count()
    rows = parts.groupBy("at").agg(F.sum(F.col("x") * (F.col("n") / total)).alias("x")).collect()
    return np.array([r["x"] for r in sorted(rows, key=lambda r: r["at"])], np.float64)


class Index:
    """table: (vid, named, code, norm, inner_, v, row) of each vector that takes part; row tells rows apart, as ids may repeat."""

    def __init__(self, vectors: DataFrame, scratch: Scratch, seed: int = 42):
        """vectors: (vid, named, v, ok). The centroid is the mean of all vectors."""
        self.spark, self.seed = vectors.sparkSession, seed
        self.dim = dimension(vectors)
        rows = vectors.filter(F.col("ok") & (F.size("v") == self.dim)).select("vid", "named", "v")
        self.centroid = _mean(rows, self.dim)
        coded = rows.mapInArrow(_encoded(self.dim, self.centroid, seed), "vid long, named boolean, code binary, norm double, inner_ double, v array<double>")
        self.table = scratch.put(coded.withColumn("row", F.monotonically_increasing_id()), "index")

    def search(self, ids: np.ndarray, rows: np.ndarray, queries: np.ndarray, k: int = K) -> DataFrame:
        """(query, vid, score): for each query the k nearest of each partition's vectors but the query's own row."""
        less, _ = _difference(queries, self.centroid)
        top = np.maximum(np.abs(less).max(axis=1, keepdims=True, initial=0.0), 5e-324)
        # Lengths are put back after the turn, which so cannot overflow.
        turned = ((less / top) @ rotation(self.dim, self.seed)) * top
        sent = self.spark.sparkContext.broadcast((ids, rows, queries, turned))
        return self.table.select("vid", "code", "norm", "inner_", "v", "row").mapInArrow(_searched(sent, self.dim, k), "query long, vid long, score double")


def _searched(sent, dim: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, rows, queries, turned = sent.value
        asked = Asked(turned)
        worst = np.full(len(ids), np.inf)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # query number, score, vid

        def settle() -> None:
            q, s, v = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.lexsort((v, s, q))
            q, s, v = q[order], s[order], v[order]
            starts = np.searchsorted(q, np.arange(len(ids)))
            top = np.arange(len(q)) - starts[q] < k
            found[:] = [(q[top], s[top], v[top])]
            full = starts + k - 1
            ok = np.flatnonzero((full < len(q)) & (q[np.minimum(full, len(q) - 1)] == np.arange(len(ids))))
            worst[ok] = s[full[ok]]

        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                n = part.num_rows
                codes = _words(np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint8).reshape(n, -1))
                x, vid, row = matrix(part.column(4), dim), part.column(0).to_numpy(), part.column(5).to_numpy()
                norm, inner = part.column(2).to_numpy(), part.column(3).to_numpy()
                for b in range(0, len(ids), 512):
                    block = slice(b, b + 512)
                    low, high = distance_bounds(codes, norm, inner, asked, block)
                    mine = rows[block, None] == row[None, :]
                    high[mine] = np.inf
                    limit = worst[block]
                    if n > k:
                        limit = np.minimum(limit, np.partition(high, k - 1, axis=1)[:, k - 1])
                    # What is not bounded, as lengths near the largest double may not be, is reranked.
                    q, j = np.nonzero(~(low > limit[:, None] * (1 + 1e-9)) & ~mine)
                    for c in range(0, len(q), 1 << 15):
                        qc, jc = q[c : c + (1 << 15)] + b, j[c : c + (1 << 15)]
                        d, halved = _difference(queries[qc], x[jc])
                        score = _length(d) * np.where(halved, 2.0, 1.0)
                        good = score <= worst[qc]
                        found.append((qc[good], score[good], vid[jc[good]]))
                if found:
                    settle()
        if found:
            q, s, v = found[0]
            yield pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(v), pa.array(s)], names=["query", "vid", "score"])

    return run


def nearest(embeddings: DataFrame, every: int = 100, k: int = K, seed: int = 42) -> DataFrame:
    """(query, rank, vid, score): the k nearest rows of each row whose vec_id is divisible by ``every``.

    Nearness is the Euclidean distance in double precision, ties go to the smaller vid. The query's own row
    is no candidate; vectors that are null, zero, not finite or of another length than most are
    neither queries nor candidates. Of rows that share a query's id the one with the smallest vector is the query, the others are candidates. No rows, no result."""
    spark = embeddings.sparkSession
    scratch = Scratch(spark, "nearest")
    rows = embeddings.select(did("vec_id").alias("vid"), F.col("embedding").cast("array<double>").alias("v"), F.col("vec_id").isNotNull().alias("named")).withColumn("ok", valid(F.col("v")))
    index = Index(rows, scratch, seed)
    own = index.table.filter(F.col("named") & (F.col("vid") % every == 0)).groupBy("vid").agg(F.min(F.struct("v", "row")).alias("own"))
    blocks = max(1, ceil(own.count() / QUERY_BLOCK))
    asked = scratch.put(own.select("vid", "own.v", "own.row", F.pmod(F.xxhash64("vid"), F.lit(blocks)).alias("block")), "asked")
    parts = []
    for b in range(blocks):
        queries = sorted((r["vid"], r["row"], r["v"]) for r in asked.filter(F.col("block") == b).collect())
        if queries:
            ids, numbers = (np.array([x[c] for x in queries], np.int64) for c in (0, 1))
            parts.append(scratch.put(index.search(ids, numbers, np.array([x[2] for x in queries], np.float64), k), f"found-{b}"))
    if not parts:
        return spark.createDataFrame([], "query long, rank int, vid long, score double")
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    order = Window.partitionBy("query").orderBy("score", "vid")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query", "rank", "vid", "score")


def op4(embeddings: DataFrame) -> DataFrame:
    """query_id, rank, vec_id and score of the ten nearest of each query."""
    return nearest(embeddings).select(F.col("query").alias("query_id"), "rank", undid("vid").alias("vec_id"), "score")
