"""Mixing sources to target weights by blocks.

The words of a source, document after document, are cut into blocks of fixed length. Each output
shard draws multinomially how many of its slots each source gets, in proportion to what the sources owe, from a seed
of its own, so shards are drawn by tasks that know nothing of each other; a source's slots are numbered through over the
shards, those beyond what it owes go, and the last shard takes what is left, so totals come out. The t-th slot of a source is
mapped to a block by a pseudorandom permutation of the source's block numbers, a new one for
each pass over them, so no block is taken twice more than another. Slots and blocks are joined
by source and number.

Only figures for each source, of which there are at most ``MOST_SOURCES``, reach the driver.
Positions in a source come from sums over hash buckets, so a hot source has no single
ordered pass.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmark.llm.common import WORD, Scratch, did, n_words, others, text_hash, undid

BLOCK, MOST_SOURCES, MOST_SHARDS, SHARD_SLOTS = 128, 100_000, 4096, 1024
#: A source's blocks are as long as a fiftieth of it, BLOCK words at most: one length for each source, by one rule at every size.
LEAST_BLOCKS = 50
CAP = 3.0
CYCLE = (5.0, 2.0, 1.0)


def targets(sizes: list[float], weights: list[float], cap: float = CAP) -> list[float]:
    """Shares of the total by weight; what would pass cap times a size is shared among the others again."""
    left, out, open_ = float(sum(sizes)), [0.0] * len(sizes), list(range(len(sizes)))
    while open_:
        total = sum(weights[k] for k in open_)
        share = {k: left * weights[k] / total if total else 0.0 for k in open_}
        over = [k for k in open_ if share[k] > cap * sizes[k]]
        for k in over or open_:
            out[k] = cap * sizes[k] if over else share[k]
        if not over:
            break
        left -= sum(out[k] for k in over)
        open_ = [k for k in open_ if k not in set(over)]
    return out


def shard_draw(owed: np.ndarray, slots: int, seed: int, shard: int) -> np.ndarray:
    """Slots of each source in one shard."""
    return np.random.default_rng([seed, shard]).multinomial(slots, owed / owed.sum())


def shard_draws(owed: list[int], slots: int, seed: int) -> np.ndarray:
    """Slots of each source (columns) in each shard (rows), all in one place; columns sum to owed."""
    owed_ = np.array(owed, np.int64)
    shards = max(1, -(-int(owed_.sum()) // slots))
    rows = np.array([shard_draw(owed_, slots, seed, k) for k in range(shards - 1)], np.int64).reshape(-1, len(owed_))
    upto = np.minimum(np.cumsum(rows, axis=0), owed_)
    return np.diff(np.vstack([np.zeros_like(owed_), upto, owed_]), axis=0)


def _drawn(owed: np.ndarray, slots: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard in batch.column(0).to_pylist():
                draw = shard_draw(owed, slots, seed, shard)
                sid = np.flatnonzero(draw)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(sid), shard)), pa.array(sid), pa.array(draw[sid])], names=["shard", "sid", "count"])

    return run


def planned_slots(spark: SparkSession, owed: list[int], slots: int, seed: int) -> DataFrame:
    """(shard, sid, first, count): the slots of each source in each shard and the number of the first; ``shard_draws`` as a table.

    There are MOST_SHARDS shards at most, so a source has no more rows than that."""
    owed_ = np.array(owed, np.int64)
    total = int(owed_.sum())
    shards = max(1, ceil(total / slots))
    due = spark.createDataFrame([(k, n) for k, n in enumerate(owed) if n], "sid long, owed long")
    drawn = spark.range(0, shards - 1 if total else 0, numPartitions=max(1, min(shards // 16, 512))).mapInArrow(_drawn(owed_, slots, seed), "shard long, sid long, count long")
    before = Window.partitionBy("sid").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    placed = drawn.withColumn("first", F.coalesce(F.sum("count").over(before), F.lit(0))).join(F.broadcast(due), "sid").filter("first < owed")
    placed = placed.select("shard", "sid", "first", F.least("count", F.col("owed") - F.col("first")).alias("count"))
    sums = placed.groupBy("sid").agg(F.sum("count").alias("given"))
    rest = due.join(sums, "sid", "left").select(F.lit(shards - 1).cast("long").alias("shard"), "sid", F.coalesce("given", F.lit(0)).alias("first"), (F.col("owed") - F.coalesce("given", F.lit(0))).alias("count"))
    return placed.unionByName(rest.filter("count > 0"))


def permuted(t: np.ndarray, n: int, key: tuple[int, ...]) -> np.ndarray:
    """Images of numbers under n by a pseudorandom permutation: four Feistel rounds on the next even number of
    bits, repeated for images that are not under n."""
    half = np.uint64(max(1, (int(n - 1).bit_length() + 1) // 2))
    mask = (np.uint64(1) << half) - np.uint64(1)
    keys = np.random.default_rng(key).integers(1, 2**63, 4, dtype=np.uint64)
    x, open_ = t.astype(np.uint64), np.arange(len(t))
    while len(open_):
        left, right = x[open_] >> half, x[open_] & mask
        for k in keys:
            f = (right ^ k) * np.uint64(0x9E3779B97F4A7C15)
            f = (f ^ (f >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ ((f >> np.uint64(32)) & mask)
        x[open_] = (left << half) | right
        open_ = open_[x[open_] >= n]
    return x.astype(np.int64)


def _slots(seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, sid, first, count, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                t = np.arange(first, first + count)
                blocks = np.concatenate([permuted(t[t // n == p] % n, n, (seed, sid, int(p))) for p in np.unique(t // n)])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(count, shard)), pa.array(np.full(count, sid)), pa.array(t), pa.array(blocks)], names=["shard", "sid", "t", "block"])

    return run


@dataclass
class Mix:
    """sources: (sid, source, size, target, block_words, n_blocks) for each source; rows: (did, tag, sid, n) for each
    document; slots: (shard, sid, t, block) for each slot of the mix; parts: (sid, block, did, tag, first, words), the words of
    a document that a block holds."""

    sources: DataFrame
    rows: DataFrame
    slots: DataFrame
    parts: DataFrame


def cycled(sources: list[str | None]) -> list[float]:
    """Weights 5, 2, 1, repeating."""
    return [CYCLE[k % len(CYCLE)] for k in range(len(sources))]


def mix(docs: DataFrame, weights: Callable[[list[str | None]], list[float]] = cycled, cap: float = CAP, seed: int = 42, distinct: bool = False) -> Mix:
    """Mixes the sources of docs. weights gets the sources by code point, null last.

    A null source is a source; a null text has no words; documents without words take no slot. A source's
    blocks all have the same length but for the last. distinct: rows alike in id, source and text count once. Reruns give the same mix."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "mixing")
    sized = docs.select(did().alias("did"), text_hash().alias("tag"), F.col("source").cast("string").alias("source"), n_words(F.col("text")).alias("n"))
    sized = scratch.put(sized.distinct() if distinct else sized, "sized")
    sums = [(r["source"], int(r["size"]), r["rows"]) for r in sized.groupBy("source").agg(F.sum("n").alias("size"), F.count("*").alias("rows")).limit(MOST_SOURCES + 1).collect()]
    if len(sums) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    sums.sort(key=lambda x: (x[0] is None, x[0] or ""))
    names, sizes = [x[0] for x in sums], [x[1] for x in sums]
    wanted = targets(sizes, weights(names), cap)
    lengths = [max(1, min(BLOCK, size // LEAST_BLOCKS)) for size in sizes]
    counts = [ceil(size / length) for size, length in zip(sizes, lengths, strict=True)]
    owed = [min(round(w * n / size), int(cap * n)) if size else 0 for w, n, size in zip(wanted, counts, sizes, strict=True)]
    table = [(k, *x) for k, x in enumerate(zip(names, sizes, wanted, lengths, counts, strict=True))]
    sources = spark.createDataFrame(table, "sid long, source string, size long, target double, block_words long, n_blocks long")
    rows = sized.join(F.broadcast(sources), sized["source"].eqNullSafe(sources["source"])).select("did", "tag", "sid", "n", "block_words")

    buckets = max(1, min(1 << 20, ceil(sum(x[2] for x in sums) / 200)))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("did", "tag"), F.lit(buckets)))
    before = Window.partitionBy("sid").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = rows.groupBy("sid", "bucket").agg(F.sum("n").alias("m")).select("sid", "bucket", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("base"))
    above = Window.partitionBy("sid", "bucket").orderBy("did", "tag").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.filter("n > 0").withColumn("own", F.coalesce(F.sum("n").over(above), F.lit(0))).join(bases.hint("merge"), ["sid", "bucket"]).select("did", "tag", "sid", "n", "block_words", (F.col("base") + F.col("own")).alias("start"))
    blocks = placed.select("*", F.explode(F.expr("sequence(start div block_words, (start + n - 1) div block_words)")).alias("block"))
    begin, end = F.greatest("start", F.col("block") * F.col("block_words")), F.least(F.col("start") + F.col("n"), (F.col("block") + 1) * F.col("block_words"))
    parts = blocks.select("sid", "block", "did", "tag", (begin - F.col("start")).alias("first"), (end - begin).alias("words"))

    slots = max(SHARD_SLOTS, ceil(sum(owed) / MOST_SHARDS))
    plan = planned_slots(spark, owed, slots, seed).join(F.broadcast(sources.select("sid", F.col("n_blocks").alias("n"))), "sid").select("shard", "sid", "first", "count", "n")
    taken = scratch.put(plan, "plan").repartition("shard", "sid").mapInArrow(_slots(seed), "shard long, sid long, t long, block long")
    return Mix(sources, rows.select("did", "tag", "sid", "n"), taken, parts)


def _times(mixed: Mix) -> DataFrame:
    """(did, tag, sid, first, words, times): parts and how often the mix takes each."""
    times = mixed.slots.groupBy("sid", "block").agg(F.count("*").alias("times"))
    return mixed.parts.join(times.hint("merge"), ["sid", "block"]).select("did", "tag", "sid", "first", "words", "times")


def op1(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target (of its source) and taken (its words that the mix takes, repeats counted) of each row.

    A null text has size 0 and takes nothing; a null source is a source; rows of one id and text under two sources are two documents; rows
    alike in id, source and text share what is taken of them evenly. An empty table gives an empty result."""
    mixed = mix(docs)
    taken = _times(mixed).groupBy("did", "tag", "sid").agg(F.sum(F.col("words") * F.col("times")).alias("all"))
    # Rows alike in id, text and source share their sum; each gets its part.
    rows = mixed.rows.groupBy("did", "tag", "sid", "n").agg(F.count("*").alias("copies"))
    per = rows.join(taken.hint("merge"), ["did", "tag", "sid"], "left").join(F.broadcast(mixed.sources), "sid")
    share = F.expr("coalesce(`all`, 0L) div copies") + F.when(F.col("copy") < F.expr("coalesce(`all`, 0L) % copies"), 1).otherwise(0)
    return per.withColumn("copy", F.explode(F.expr("sequence(0L, copies - 1)"))).select(undid().alias("doc_id"), F.col("n").alias("size"), F.col("size").alias("source_size"), "target", share.cast("long").alias("taken"))


def _copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    word = re.compile(WORD)
    for batch in batches:
        row, text, parts = batch.columns
        picked, texts = [], []
        for k, (t, ps) in enumerate(zip(text, parts.to_pylist(), strict=True)):
            t = t.as_py() or ""
            spans = [m.span() for m in word.finditer(t)]
            times = np.zeros(len(spans), np.int64)
            for p in ps:
                times[p["first"] : p["first"] + p["words"]] += p["times"]
            for c in range(1, times.max(initial=0) + 1):
                edges = np.flatnonzero(np.diff(np.concatenate([[False], times >= c, [False]]).astype(np.int8))).reshape(-1, 2).tolist()
                picked.append(k)
                texts.append(t if edges == [[0, len(spans)]] else "\n".join(t[spans[a][0] : spans[b - 1][1]] for a, b in edges))
        yield pa.RecordBatch.from_arrays([row.take(pa.array(picked, pa.int64())), pa.array(texts, pa.string())], names=["row", "text"])


def mixed_documents(docs: DataFrame, weights: Callable[[list[str | None]], list[float]] = cycled, cap: float = CAP, seed: int = 42) -> DataFrame:
    """The mix as documents, columns of docs: a row for each time that blocks of a document are taken, with the words
    of the blocks taken that often; runs of blocks that do not touch are joined by a line feed. n_chars, if there is one, counts the new text.

    Rows alike in id, source and text are mixed as one document and then stay as many."""
    mixed = mix(docs, weights, cap, seed, distinct=True)
    takes = _times(mixed).groupBy("did", "tag", "sid").agg(F.collect_list(F.struct("first", "words", "times")).alias("parts"))
    named = mixed.sources.select("sid", F.col("source").alias("source_"))
    rows = docs.select(did().alias("did"), text_hash().alias("tag"), F.col("source").cast("string").alias("source_of"), others(docs).alias("row"), F.col("text").cast("string").alias("text"))
    rows = rows.join(F.broadcast(named), F.col("source_of").eqNullSafe(F.col("source_"))).select("did", "tag", "sid", "row", "text")
    schema = T.StructType([T.StructField("row", rows.schema["row"].dataType), T.StructField("text", T.StringType())])
    made = rows.join(takes.hint("merge"), ["did", "tag", "sid"]).select("row", "text", "parts").mapInArrow(_copies, schema)
    new = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return made.select(*(new[c].alias(c) if c in new else F.col(f"row.`{c}`").alias(c) for c in docs.columns))
