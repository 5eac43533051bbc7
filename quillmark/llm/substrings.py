"""Exact removal of repeated passages with a log-structured fingerprint index.

A window is ``WINDOW`` consecutive words. Its fingerprint in the index is the smallest of the
hashes of the runs of ``GRAM`` words inside it, so equal windows have equal fingerprints while
neighbouring windows mostly share theirs: about a fifth as many entries as windows, and none
missing. The index is a list of immutable runs, one for each batch of documents, each dealt by
fingerprint and sorted by it, with the first and last document of each fingerprint. A new batch
is summarised the same way and merge-joined with every run; fingerprints that occur in more than
one document are candidates. Candidates are verified on the text: the windows that carry one are
hashed whole (96 bits), and a window is repeated if a document with a smaller id has the same hash.
When ``fanout`` runs have gathered they are compacted into one, which the next batch meets. An index may be kept in a folder, with the fingerprints of its documents: a
later call then takes only the documents after them as new batches and joins these with the runs that are there.

A row whose whole text stands under a smaller id has all its windows there, so it needs no
verification. Verified windows are matched in ``slices`` of the hash, one after another, which bounds the
shuffle files that lie on disk at once.

Every group is reduced by partial aggregates before it is shuffled, and the reduced rows are written
before they are joined back: both sides of the join are then plain shuffles, whose large
partitions Spark splits. No group is collected.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.llm.common import Scratch, did, text_hash, undid

WINDOW, GRAM = 13, 6
#: In place of a start: every window of the row.
ALL = -1
#: Windows or fingerprints that a task holds before it hands them on.
HELD = 1 << 18
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _grams(words: list[bytes], size: int) -> np.ndarray:
    """64-bit hashes of the runs of size words."""
    hashes = np.array(list(map(xxhash.xxh3_64_intdigest, words)), np.uint64)
    n = len(hashes) - size + 1
    x = np.zeros(n, np.uint64)
    for k in range(size):
        x = x * _ODD + hashes[k : k + n]
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _window_prints(words: list[bytes], window: int, gram: int) -> np.ndarray:
    """The fingerprint of each window of a text of at least window words."""
    grams = _grams(words, gram).view(np.int64)
    span = window - gram + 1
    least = grams[: len(grams) - span + 1].copy()
    for k in range(1, span):
        np.minimum(least, grams[k : k + len(least)], out=least)
    return least


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").split()


def _prints(window: int, gram: int):
    def told(out: list[tuple[np.ndarray, int, int]]) -> pa.RecordBatch:
        sizes = [len(x[0]) for x in out]
        columns = [np.concatenate([x[0] for x in out]), *(np.repeat(np.array([x[k] for x in out], np.int64), sizes) for k in (1, 2))]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["g", "did", "tag"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held = [], 0
        for batch in batches:
            for i, tag, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if len(words := _words(text.as_py())) >= window:
                    out.append((np.unique(_window_prints(words, window, gram)), i, tag))
                    held += len(out[-1][0])
                    if held > HELD:
                        yield told(out)
                        out, held = [], 0
        if out:
            yield told(out)

    return run


def window_prints(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(g, did, tag): the distinct window fingerprints of each row."""
    return docs.select("did", "tag", "text").mapInArrow(_prints(window, gram), "g long, did long, tag long")


class FingerprintLog:
    """The index: runs of (g, lo, hi), the first and last did of each fingerprint.

    Batches are to come in ascending order of did for ``add`` to name every fingerprint that
    also lies in a smaller document; the order does not matter for which fingerprints are found.
    folder: where the index is kept, with a table of (g, did, tag) for each batch; ``commit`` makes what was added part of it, and what a
    call that failed has left is not read."""

    def __init__(self, spark: SparkSession, scratch: Scratch, fanout: int = 4, folder: str | None = None):
        self.spark, self.scratch, self.fanout = spark, scratch, fanout
        self.kept = Scratch(spark, "log", folder) if folder else None
        self.runs: list[tuple[str, DataFrame]] = []
        self.batches: list[str] = []
        self.upto: int | None = None
        self._made = 0
        states = [x for x in self.kept.names() if x.startswith("state-")] if self.kept else []
        if states:
            state = self.kept.read(states[-1]).first()
            self.runs = [(x, self.kept.read(x)) for x in state["runs"]]
            self.batches, self.upto, self._made = list(state["batches"]), state["upto"], state["made"]

    def _write(self, run: DataFrame) -> None:
        name = f"run-{self._made:06d}"
        self._made += 1
        self.runs.append((name, (self.kept or self.scratch).put(run.sortWithinPartitions("g"), name)))

    def prints(self) -> list[DataFrame]:
        """(g, did, tag) of the batches that the index was opened with."""
        return [self.kept.read(x) for x in self.batches] if self.kept else []

    def add(self, prints: DataFrame, more: bool = True) -> DataFrame:
        """Adds a batch of (g, did, ...) as a run, and compacts when it is time if more batches are to come. Returns (g): fingerprints of the batch that lie in two of
        its documents, or in it and in an earlier run under another did."""
        earlier = [run for _, run in self.runs]
        self._write(prints.groupBy("g").agg(F.min("did").alias("lo"), F.max("did").alias("hi")))
        own = self.runs[-1][1]
        found = own.filter("lo < hi").select("g")
        for run in earlier:
            met = own.join(run.select("g", F.col("lo").alias("lo0"), F.col("hi").alias("hi0")), "g")
            found = found.unionByName(met.filter("least(lo, lo0) < greatest(hi, hi0)").select("g"))
        found = self.scratch.put(found.distinct(), f"found-{self._made}")
        if more and len(self.runs) >= self.fanout:
            self.compact()
        return found

    def commit(self, prints: list[DataFrame], upto: int | None) -> None:
        """Keeps the runs, the prints of the new batches, and the last did of all as the folder's state; what it replaces goes after that."""
        for p in prints:
            self.batches.append(f"prints-{self._made:06d}")
            self._made += 1
            self.kept.put(p, self.batches[-1])
        state = [([name for name, _ in self.runs], self.batches, max(x for x in (upto, self.upto, -(2**63)) if x is not None), self._made + 1)]
        self.kept.put(self.spark.createDataFrame(state, "runs array<string>, batches array<string>, upto long, made long").coalesce(1), f"state-{self._made:06d}")
        wanted = {*state[0][0], *self.batches, f"state-{self._made:06d}"}
        self.kept.drop(*(x for x in self.kept.names() if x not in wanted))

    def drop(self) -> None:
        """Deletes the runs, unless the index is kept."""
        if not self.kept:
            self.scratch.drop(*(name for name, _ in self.runs))
        self.runs = []

    def compact(self) -> None:
        """Merges all runs into one."""
        old, self.runs = self.runs, []
        merged = old[0][1]
        for _, run in old[1:]:
            merged = merged.unionByName(run)
        self._write(merged.groupBy("g").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")))
        if not self.kept:
            self.scratch.drop(*(name for name, _ in old))


def _windows(window: int, gram: int):
    names = ["w", "x", "did", "tag", "at"]

    def told(out: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held = [[] for _ in names], 0
        for batch in batches:
            for i, tag, text, found in zip(*(c if k in (2, 3) else c.to_pylist() for k, c in enumerate(batch.columns)), strict=True):
                if len(words := _words(text.as_py())) < window:
                    continue
                at = np.flatnonzero(np.isin(_window_prints(words, window, gram), found.values.to_numpy()))
                line = memoryview(b" ".join(words))
                ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1  # of words in the line
                spans = zip((np.concatenate([[-1], ends])[at] + 1).tolist(), ends[at + window - 1].tolist(), strict=True)
                whole = np.frombuffer(b"".join(xxhash.xxh3_128_digest(line[a:b]) for a, b in spans), ">i8").reshape(-1, 2)
                for column, values in zip(out, (whole[:, 0].astype(np.int64), whole[:, 1].astype(np.int64).astype(np.int32), np.full(len(at), i), np.full(len(at), tag), at.astype(np.int32)), strict=True):
                    column.append(values)
                held += len(at)
                if held > HELD:
                    yield told(out)
                    out, held = [[] for _ in names], 0
        if out[0]:
            yield told(out)

    return run


def _covered(at: list[int], window: int, n: int) -> np.ndarray:
    """Which of n words the windows that start at the positions cover."""
    if at[0] == ALL:
        return np.full(n, n >= window)
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, np.minimum(np.array(at) + window, n), -1)
    return np.cumsum(edge[:n]) > 0


def _digests(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, at, out = batch.column(0), batch.column(2).to_pylist(), ([], [], [])
            for text, starts in zip(batch.column(1), at, strict=True):
                words, gone = _words(text.as_py()), 0
                n = len(words)
                if starts:
                    cover = _covered(starts, window, n)
                    gone = int(cover.sum())
                    words = [w for w, c in zip(words, cover.tolist(), strict=True) if not c]
                for column, value in zip(out, (n, gone, hashlib.sha256(b" ".join(words)).hexdigest()), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([ids, pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string())], names=["did", "n_words", "n_removed", "kept_sha256"])

    return run


def repeated_windows(docs: DataFrame, scratch: Scratch, batches: int = 2, slices: int = 4, window: int = WINDOW, gram: int = GRAM, log: FingerprintLog | None = None) -> DataFrame:
    """(did, tag, starts): the starts of a row's windows whose words also start a window in a document with a
    smaller did; ALL stands for each window. docs: (did, tag, text); tag tells rows of one id apart.

    Rows that share an id do not remove each other's windows. Documents go through the index
    in ``batches`` batches of ascending did; those that a kept log holds already are not added again."""
    log = log or FingerprintLog(docs.sparkSession, scratch)
    prints, found, begun = log.prints(), [], log.upto
    new = docs if begun is None else docs.filter(F.col("did") > begun)
    cuts = new.agg(F.percentile_approx("did", [k / batches for k in range(1, batches)], 1000).alias("c")).first()["c"] if batches > 1 else []
    edges = [begun, *sorted(set(cuts or [])), None]
    known = len(prints)
    for k in range(len(edges) - 1):
        batch = new
        if edges[k] is not None:
            batch = batch.filter(F.col("did") > edges[k])
        if edges[k + 1] is not None:
            batch = batch.filter(F.col("did") <= edges[k + 1])
        prints.append(scratch.put(window_prints(batch, window, gram), f"prints-{k}"))
        found.append(log.add(prints[-1], bool(log.kept) or k < len(edges) - 2))
    if log.kept:
        log.commit(prints[known:], new.agg(F.max("did").alias("m")).first()["m"])
    all_prints, all_found = reduce(DataFrame.unionByName, prints), reduce(DataFrame.unionByName, found)
    marked = all_prints.join(all_found.distinct(), "g").groupBy("did", "tag").agg(F.collect_set("g").alias("found"))
    copies = scratch.put(_copies(docs, scratch).filter("copy").select("did", "tag").distinct(), "copies")
    marked = scratch.put(marked.join(copies.hint("merge"), ["did", "tag"], "left_anti"), "marked")
    log.drop()
    scratch.drop(*(x for x in scratch.names() if x.startswith(("prints-", "found-"))))
    windows = scratch.put(docs.join(marked.hint("merge"), ["did", "tag"]).select("did", "tag", "text", "found").mapInArrow(_windows(window, gram), "w long, x int, did long, tag long, at int"), "windows")
    scratch.drop("marked")
    later = copies.select("did", "tag", F.array(F.lit(ALL)).alias("starts"))
    for k in range(slices):
        part = windows.filter(F.pmod("w", F.lit(slices)) == k)
        first = part.groupBy("w", "x").agg(F.min("did").alias("lo"), F.max("did").alias("hi")).filter("lo < hi").select("w", "x", "lo")
        own = part.join(scratch.put(first, f"first-{k}"), ["w", "x"]).filter("did > lo").groupBy("did", "tag").agg(F.collect_set("at").alias("starts"))
        later = later.unionByName(scratch.put(own, f"later-{k}"))
        scratch.drop(f"first-{k}")
    scratch.drop("windows")
    return later.groupBy("did", "tag").agg(F.sort_array(F.flatten(F.collect_list("starts"))).alias("starts"))


def _copies(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(did, tag, copy): whether a row's whole text stands under a smaller did."""
    rows = docs.select("did", "tag", F.hash("text").alias("th"), F.length("text").alias("n"))
    first = rows.groupBy("th", "tag", "n").agg(F.min("did").alias("lo"), F.max("did").alias("hi")).filter("lo < hi").select("th", "tag", "n", "lo")
    return rows.join(scratch.put(first, "whole"), ["th", "tag", "n"], "left").select("did", "tag", F.coalesce(F.col("did") > F.col("lo"), F.lit(False)).alias("copy"))


def _tagged(docs: DataFrame) -> DataFrame:
    return docs.select(did().alias("did"), text_hash().alias("tag"), F.col("text").cast("string").alias("text"))


def remove_repeats(docs: DataFrame, batches: int = 2, slices: int = 4, window: int = WINDOW, gram: int = GRAM, folder: str | None = None, fanout: int = 4) -> DataFrame:
    """(did, text, starts) of each row: its text, and the starts of its repeated windows
    (null if it has none, ALL for each window). Null ids sort last and count as one id; a null text has no words; a row with fewer words
    than a window has no window. An empty table gives an empty result.

    folder: where an index is kept from call to call. docs then holds the documents of earlier calls, too, whose texts candidates are verified
    on, and the new ones, whose ids are larger; only these go into the index, in ``batches`` batches, and only these are returned."""
    docs = _tagged(docs)
    scratch = Scratch(docs.sparkSession, "substrings")
    log = FingerprintLog(docs.sparkSession, scratch, fanout, folder)
    begun = log.upto
    starts = scratch.put(repeated_windows(docs, scratch, batches, slices, window, gram, log), "starts")
    asked = docs if begun is None else docs.filter(F.col("did") > begun)
    return asked.join(starts.hint("merge"), ["did", "tag"], "left").select("did", "text", "starts")


def op6(docs: DataFrame, batches: int = 3, fanout: int = 2) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of each row. The first two batches' runs are compacted before the third meets them; edges as in ``remove_repeats``."""
    return remove_repeats(docs, batches, fanout=fanout).mapInArrow(_digests(WINDOW), "did long, n_words long, n_removed long, kept_sha256 string").select(undid().alias("doc_id"), "n_words", "n_removed", "kept_sha256")


OP6_SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), starts AS (
  SELECT doc_id, unnest(range(1, len(words) - 11)) AS beg FROM w WHERE len(words) >= 13
), windows AS (
  SELECT s.doc_id, s.beg, array_to_string(w.words[s.beg:s.beg + 12], ' ') AS seq FROM starts s JOIN w USING (doc_id)
), firsts AS (
  SELECT seq, min(doc_id) AS lo FROM windows GROUP BY seq HAVING min(doc_id) < max(doc_id)
), gone AS (
  SELECT DISTINCT doc_id, beg + k AS place
  FROM (SELECT v.doc_id, v.beg FROM windows v JOIN firsts f USING (seq) WHERE v.doc_id > f.lo), (SELECT unnest(range(0, 13)) AS k)
), removed AS (
  SELECT doc_id, count(*) AS n, list(place) AS gone FROM gone GROUP BY doc_id
)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(r.n, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(array_to_string(CASE WHEN r.gone IS NULL THEN words
    ELSE list_transform(list_filter(list_zip(words, range(1, len(words) + 1)), lambda z: NOT list_contains(r.gone, z[2])), lambda z: z[1]) END, ' '), '')) AS kept_sha256
FROM w LEFT JOIN removed r USING (doc_id)
"""
