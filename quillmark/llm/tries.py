"""The trie of conversation prefixes, as a table, by the Cartesian tree of the LCP array of sorted conversations.

Conversations are sorted by their turns, each a 128-bit hash, so those that share a prefix are neighbours, and a node of the trie is an
interval of the order: all that share its turns. The LCP array holds how many turns each has in common with the one before it. An
interval that branches or at which conversations end is one between nearest smaller values of that array on both sides; nodes of the Cartesian tree with equal values
within it are one. Between an interval's depth and its parent's lie the depths at which nothing branches; they are expanded at the end.

The order is dealt out in blocks. A block finds, with a stack, the intervals whose nearest smaller values lie within it, each with all it holds. What is left of a block
is its chain of minima from the left and the intervals that are open at its end, no more than the depths of its
conversations. These remains are met in the order of blocks by one task that closes the rest. A chain of k minima takes conversations of k*k/2 turns, so over blocks
of T turns in all, P of them, remains have 2*sqrt(2*P*T) entries at most; they don't grow with the corpus as a whole.

A conversation is one row of 40 bytes a turn; its texts never are. The hash of the conversations that end at a node reads their ids in order, so a run of equal
conversations that goes through many blocks is read to its end by one task, a block's ids at a time.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmark.llm.common import Scratch, n_words

GROUP, MOST_HEAD = 20, 4
#: Hexadecimal digits of a turn's hash; bits of a place within a block.
DIGITS, PLACE = 32, 40
NONE = hashlib.sha256(b"").hexdigest()

_PART = T.StructType(
    [T.StructField("kind", T.StringType())]
    + [T.StructField(c, T.LongType()) for c in ("left", "n", "depth", "pdepth", "pleft", "conv_id", "n_children", "n_leaves", "below")]
    + [T.StructField("words", T.ArrayType(T.LongType())), T.StructField("ends", T.StringType()), T.StructField("rest", T.StringType())]
)


def common(a: str, b: str) -> int:
    """Turns that two sequences begin with alike."""
    low, high = 0, min(len(a), len(b)) // DIGITS
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[: mid * DIGITS] == b[: mid * DIGITS] else (low, mid - 1)
    return low


class Interval:
    """An open interval: its depth, the place it begins at, and what its closed children and its own conversations come to."""

    __slots__ = ("depth", "left", "at", "least", "children", "leaves", "below", "ids", "read")

    def __init__(self, depth: int, left: int, at: int, sums: tuple = (None, 0, 0, 0)):
        self.depth, self.left, self.at = depth, left, at
        self.least, self.children, self.leaves, self.below = sums
        self.ids: list[str] = []
        self.read = None

    def add(self, least: int | None, children: int, leaves: int, below: int) -> None:
        self.least = least if self.least is None else self.least if least is None else min(self.least, least)
        self.children, self.leaves, self.below = self.children + children, self.leaves + leaves, self.below + below

    def sums(self) -> tuple:
        return self.least, self.children, self.leaves, self.below

    def end(self, ids: str) -> None:
        """Reads on in the ids of the conversations that end here."""
        if ids:
            self.read = self.read or (hashlib.sha256(), [])
            self.read[0].update((("," if self.read[1] else "") + ids).encode())
            self.read[1][:] = [True]

    def hash(self) -> str:
        self.end(",".join(self.ids))
        self.ids = []
        return self.read[0].hexdigest() if self.read else NONE


def close(stack: list[Interval], shared: int, right: int, path: list[int], out: list[tuple], least_open: int) -> None:
    """Closes the intervals deeper than ``shared``, all but the lowest ``least_open`` ones. path: words up to each depth of what the open intervals hold."""
    while len(stack) > least_open and stack[-1].depth > shared:
        done = stack.pop()
        if stack[-1].depth < shared:
            stack.append(Interval(shared, done.left, done.at))
        up, n = stack[-1], right - done.at
        top = max(up.depth, 0)
        leaves, below = done.leaves or 1, done.below + (n - 1) * (path[done.depth] - path[top])
        words = path[top : done.depth + 1] if n > 1 else None
        out.append(("interval", done.left, n, done.depth, up.depth, up.left, done.least, done.children, leaves, done.below, words, done.hash(), None))
        up.add(done.least, 1, leaves, below)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), *[pa.int64()] * 9, pa.list_(pa.int64()), pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=_PART.names)


def _block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The intervals that close within a block, and one row of what is left of it."""
    base = TaskContext.get().partitionId() << PLACE
    stack: list[Interval] = []
    chain: list[list] = []
    out: list[tuple] = []
    begin, i, first, last, path = 0, -1, None, "", [0]
    remains = lambda x: [begin, x.depth, x.sums(), ",".join(x.ids)]
    for batch in batches:
        for conv, seq, words in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            i, here = i + 1, [0, *accumulate(words)]
            if first is None:
                first, stack = (seq, here), [Interval(len(words), base, 0)]
            else:
                shared = common(last, seq)
                close(stack, shared, i, path, out, 1)
                if stack[-1].depth > shared:
                    chain.append(remains(stack.pop()))
                    stack, begin = [Interval(shared, base, 0)], i
            if len(words) > stack[-1].depth:
                stack.append(Interval(len(words), base + i, i))
            stack[-1].add(conv, 0, 0, 0)
            stack[-1].ids += [str(conv)] if len(words) == stack[-1].depth else []
            last, path = seq, here
            if len(out) >= 4096:
                yield _batch(out)
                out = []
    if first is not None:
        chain.append(remains(stack[0]))
        rest = {"n": i + 1, "first": first, "last": (last, path), "chain": chain, "open": [[x.depth, x.at, x.sums(), ",".join(x.ids)] for x in stack[1:]]}
        yield _batch([*out, ("rest", base, i + 1, *[None] * 9, json.dumps(rest))])


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Closes, from the remains of all blocks in order, the intervals that reach over their ends; says where a block's chain begins in truth."""
    stack, out, at, last, path = [Interval(-1, -1, 0)], [], 0, "", [0]
    for batch in batches:
        for base, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            rest = json.loads(text)
            (seq, here), shared = rest["first"], common(last, rest["first"][0]) if at else -1
            for k, (begin, depth, sums, ids) in enumerate(rest["chain"]):
                close(stack, depth if k else shared, at + begin, here if k else path, out, 1)
                if depth > stack[-1].depth:
                    stack.append(Interval(depth, base, at))
                stack[-1].add(*sums)
                stack[-1].end(ids)
                out.append(("begin", base, None, depth, None, stack[-1].left, *[None] * 7))
            for depth, place, sums, ids in rest["open"]:
                stack.append(Interval(depth, base + place, at + place, tuple(sums)))
                stack[-1].end(ids)
            at, (last, path) = at + rest["n"], rest["last"]
            if len(out) >= 4096:
                yield _batch(out)
                out = []
    close(stack, -1, at, path, out, 1)
    if out:
        yield _batch(out)


def trie(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """The nodes of the trie of conversations. turns: (conv_id, order, key, words), key a hash of DIGITS hexadecimal digits, each conversation's turns sorted by order;
    conversations: (conv_id), also those without turns.

    (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of each node; without conversations there is none."""
    scratch = Scratch(turns.sparkSession, "trie")
    listed = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("order", "key", "words"))).alias("t"))
    rows = conversations.join(listed, "conv_id", "left").select("conv_id", F.coalesce("t", F.expr("cast(array() as array<struct<order:array<long>,key:string,words:long>>)")).alias("t"))
    rows = rows.select("conv_id", F.array_join("t.key", "").alias("seq"), F.col("t.words").alias("words"))
    blocks = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartitionByRange(blocks, "seq", "conv_id").sortWithinPartitions("seq", "conv_id")
    parts = scratch.put(rows.mapInArrow(_block, _PART), "parts")
    rests = parts.filter("kind = 'rest'").select("left", "rest").repartition(1).sortWithinPartitions("left")
    met = scratch.put(rests.mapInArrow(_meet, _PART), "met")

    begins = met.filter("kind = 'begin'").select(F.col("left").alias("pleft"), F.col("depth").alias("pdepth"), F.col("pleft").alias("truth"))
    found = parts.unionByName(met).filter("kind = 'interval'").drop("kind", "rest")
    found = found.join(begins, ["pleft", "pdepth"], "left").withColumn("pleft", F.coalesce("truth", "pleft")).drop("truth")
    found = scratch.put(found, "intervals")
    parents = found.select(F.col("left").alias("pleft"), F.col("depth").alias("pdepth"), F.col("conv_id").alias("parent"))
    nodes = found.join(parents, ["pleft", "pdepth"], "left").select("*", F.explode(F.sequence(F.col("pdepth") + 1, "depth")).alias("d"))
    own, d = F.col("d") == F.col("depth"), F.col("d")
    before = F.greatest(d - 1, F.lit(0)) - F.greatest("pdepth", F.lit(0))
    saved = F.when(F.col("n") > 1, (F.col("n") - 1) * (F.get("words", F.size("words") - 1) - F.get("words", before.cast("int")))).otherwise(0)
    return nodes.select(
        "conv_id",
        d.alias("depth"),
        F.when(d > F.col("pdepth") + 1, F.col("conv_id")).otherwise(F.col("parent")).alias("parent_conv_id"),
        F.col("n").alias("n_convs"),
        F.when(own, F.col("n_children")).otherwise(1).alias("n_children"),
        "n_leaves",
        (F.col("below") + saved).alias("saved_tokens"),
        F.when(own, F.col("ends")).otherwise(NONE).alias("ends_sha256"),
    )


def head_of(conv: Column) -> Column:
    """How many turns a conversation takes from its group's first one."""
    return F.crc32(conv.cast("string")) % MOST_HEAD


def numbered(conversations: DataFrame) -> DataFrame:
    """(conv_id, k, key, words): the turns of each conversation from 0, by turn (null first), then role, then text; each a hash of role and text, and the words of its text.

    A null role or text is empty. Rows without conv_id belong to no conversation and are left out; repeated rows are turns each."""
    own = conversations.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    key = F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"))
    return own.select("conv_id", (F.row_number().over(order).cast("long") - 1).alias("k"), key.alias("key"), n_words(F.col("text")).alias("words"))


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rebuilt turns (conv_id, order, key, words) and all conversations (conv_id): the first turns come from the conversation whose id is the
    multiple of GROUP at or, below zero, above; a conversation gives its own turns after as many. A group without that conversation gives none."""
    c = F.col("conv_id")
    all_ids, base = turns.select("conv_id").distinct(), c - c % GROUP
    order = lambda part, k: F.array(F.lit(part).cast("long"), k)
    own = turns.filter((base == c) | (F.col("k") >= head_of(c))).select("conv_id", order(1, F.col("k")).alias("order"), "key", "words")
    asking = all_ids.filter((base != c) & (head_of(c) > 0)).select("conv_id", base.alias("base"), head_of(c).alias("h"))
    heads = turns.filter((base == c) & (F.col("k") < MOST_HEAD - 1)).select(c.alias("base"), "k", "key", "words")
    taken = asking.join(heads, "base").filter("k < h").select("conv_id", order(0, F.col("k")).alias("order"), "key", "words")
    return own.unionByName(taken), all_ids


def op13(conversations: DataFrame) -> DataFrame:
    """The nodes of the trie of rebuilt conversations; edges as in ``numbered``. An empty table gives an empty result."""
    scratch = Scratch(conversations.sparkSession, "conversations")
    return trie(*rebuilt(scratch.put(numbered(conversations), "turns")))


OP13_SQL = rf"""
WITH t AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS k FROM conversations WHERE conv_id IS NOT NULL
), turns AS (
  SELECT c, k, md5(length(role) || ':' || role || text) AS key, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS w FROM t
), ids AS (
  SELECT c, c - c % {GROUP} AS base, xor(list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(CAST(c AS VARCHAR), ''), lambda s: [CAST(ord(s) AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))),
    lambda a, x: xor(xor(a, x) >> 1, 3988292384 * (xor(a, x) & 1))), 4294967295) % {MOST_HEAD} AS h FROM (SELECT DISTINCT c FROM turns)
), rebuilt AS (
  SELECT ids.c, 1 AS part, k, key, w FROM ids JOIN turns USING (c) WHERE base = c OR k >= h
  UNION ALL SELECT ids.c, 0, k, key, w FROM ids JOIN turns ON turns.c = base WHERE base <> ids.c AND k < h
), s AS (
  SELECT c, coalesce(keys, []) AS keys, coalesce(words, []) AS words FROM ids LEFT JOIN (SELECT c, list(key ORDER BY part, k) AS keys, list(w ORDER BY part, k) AS words FROM rebuilt GROUP BY c) USING (c)
), paths AS (
  SELECT c, unnest(range(len(keys) + 1)) AS d, keys, words FROM s
), pairs AS (
  SELECT c, d, array_to_string(keys[1:d], '') AS node, array_to_string(keys[1:d - 1], '') AS up, coalesce(words[d], 0) AS w, d = len(keys) AS ends FROM paths
), nodes AS (
  SELECT node, any_value(up) AS up, d, min(c) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(w) AS own, sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (ends), '')) AS ends FROM pairs GROUP BY node, d
), children AS (
  SELECT up, count(*) AS n FROM nodes WHERE d > 0 GROUP BY up
), sums AS (
  SELECT top, count(*) FILTER (leaf) AS n_leaves, sum(own) AS saved
  FROM (SELECT node, own, node NOT IN (SELECT up FROM children) AS leaf, unnest(list_transform(range(d + 1), lambda x: substr(node, 1, x * {DIGITS}))) AS top FROM nodes) GROUP BY top
)
SELECT v.conv_id, CAST(v.d AS BIGINT) AS depth, p.conv_id AS parent_conv_id, v.n_convs, coalesce(children.n, 0) AS n_children, sums.n_leaves, CAST(sums.saved AS BIGINT) AS saved_tokens, v.ends AS ends_sha256
FROM nodes v LEFT JOIN nodes p ON v.d > 0 AND p.node = v.up LEFT JOIN children ON children.up = v.node JOIN sums ON sums.top = v.node
"""
