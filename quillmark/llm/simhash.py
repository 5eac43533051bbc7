"""SimHash near-duplicates by pigeonhole blocks.

Fingerprints of 64 bits are split into one block more than the bits in which a pair may differ,
so a close pair has an equal block. Fingerprints are joined on blocks and the join verifies the
Hamming distance. Equal fingerprints are one node from the start, so groups of copies cost one
row. A block value that more than ``crowd`` fingerprints share is not joined with itself:
there each fingerprint is dealt to the midpoints at distance one outside the block. Two
fingerprints with an equal block are within distance two exactly if they share a midpoint, and a midpoint has
64 members at most, so crowded blocks cost a fixed number of rows for each fingerprint and lose
no link.

Two bits of 64 are a strict notion of a copy. For a similarity, such as a Jaccard index of 0.8 of the sets of five-word shingles, the share of
bits that differ is the angle between the sets over pi: 15 % there. ``similar_groups`` takes fingerprints of ``TABLES`` blocks of
``BLOCK_BITS`` for that, joins on blocks, and verifies the Hamming distance over all their bits, which tells the index to
about a hundredth.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.llm.common import Scratch, did, others, text_hash, undid
from quillmark.llm.components import components

#: (first bit, bits) of the pigeonhole blocks for pairs that differ in two bits at most.
BLOCKS = ((0, 22), (22, 21), (43, 21))


def simhash(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """Unsigned fingerprint of a whole text; 0 if it has no word."""
    words = (text or "").encode("utf-8", "replace").lower().split()  # for bytes: A-Z and ASCII white space
    if not words:
        return 0
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(b" ".join(words), seed)]
    else:
        digest = xxhash.xxh64_intdigest
        hashes = [digest(x, seed) for x in map(b" ".join, zip(*(words[k:] for k in range(shingle)), strict=False))]
    counts = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(np.array(hashes[k : k + (1 << 16)], "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def _fingerprints(shingle: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([simhash(x.as_py(), shingle, seed) for x in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], names=["did", "fp"])

    return run


#: Blocks of a wide fingerprint and their bits; together a multiple of 64.
TABLES, BLOCK_BITS = 144, 24
#: Fingerprints that share a block are compared in chunks of about this many.
PART = 4096
#: The blocks are compared in rounds that end at these and at the last, so that a round need not compare what is connected already.
ROUNDS = (16, 48, 96)
#: Standard deviations of the differing bits of a pair at the threshold that a pair may lie over their mean.
SPREAD = 2.0


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    """Distinct hashes of a text's shingles, lower case; of the whole if it has fewer words, none without words."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    digest = xxhash.xxh3_64_intdigest
    if len(words) <= shingle:
        return np.array([digest(b" ".join(words))] if words else [], np.uint64)
    return np.unique(np.array([digest(x) for x in map(b" ".join, zip(*(words[k:] for k in range(shingle)), strict=False))], np.uint64))


def wide_fingerprint(text: str | None, shingle: int = 5, bits: int = TABLES * BLOCK_BITS) -> bytes:
    """SimHash of a text's set of shingles over ``bits`` bits; zeros without words."""
    hashes = shingle_set(text, shingle)
    salts = np.random.default_rng(bits).integers(0, 2**63, bits // 64, dtype=np.uint64)
    counts = np.zeros(bits, np.int64)
    for k in range(0, len(hashes), 255):  # so that a byte holds the sum
        x = hashes[k : k + 255, None] ^ salts
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
        counts += np.unpackbits(x.view(np.uint8), axis=1).sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * counts > len(hashes)).tobytes()


def most_bits(similarity: float, bits: int = TABLES * BLOCK_BITS) -> int:
    """Bits in which sets of equal size with a Jaccard index of similarity differ, on average and SPREAD standard deviations more."""
    share = float(np.arccos(2 * similarity / (1 + similarity))) / np.pi
    return round(bits * share + SPREAD * (bits * share * (1 - share)) ** 0.5)


def _wide(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([wide_fingerprint(x.as_py(), shingle) for x in batch.column(2)], pa.binary())], names=["did", "th", "fp"])

    return run


def _blocks(begin: int, end: int):
    """(key, node, root) for the blocks from begin to end of (node, root, fp)."""
    tables = end - begin

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = 1 << np.arange(BLOCK_BITS - 1, -1, -1, dtype=np.int64)
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                n = part.num_rows
                prints = np.frombuffer(b"".join(part.column(2).to_pylist()), np.uint8).reshape(n, -1)[:, begin * BLOCK_BITS // 8 : end * BLOCK_BITS // 8]
                values = np.unpackbits(prints, axis=1).reshape(n, tables, BLOCK_BITS) @ powers
                keys = values + (np.arange(begin, end, dtype=np.int64) << BLOCK_BITS)
                yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1)), *(pa.array(np.repeat(part.column(c).to_numpy(), tables)) for c in (0, 1))], names=["key", "node", "root"])

    return run


def _verified(most: int):
    """Links of a spanning forest of the close pairs of each (key, i, j), from rows in that order."""

    def of(nodes: list[int], prints: list[bytes]) -> list[tuple[int, int]]:
        x = np.frombuffer(b"".join(prints), np.uint64).reshape(len(nodes), -1)
        # Each node is compared once with all that no group has taken yet, so close groups cost little.
        left, out = np.arange(len(nodes)), []
        while len(left):
            queue, left = [int(left[0])], left[1:]
            while queue and len(left):
                at = queue.pop()
                near = np.concatenate([np.bitwise_count(x[left[k : k + 1024]] ^ x[at]).sum(axis=1, dtype=np.int64) <= most for k in range(0, len(left), 1024)])
                out += [(nodes[at], nodes[k]) for k in left[near].tolist()]
                queue += left[near].tolist()
                left = left[~near]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[tuple | None, list, list] = (None, [], [])

        def batch_of(out: list[tuple[int, int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([p[k] for p in out], pa.int64()) for k in (0, 1)], names=["a", "b"])

        for batch in batches:
            out = []
            for key, i, j, node, fp in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held[0] != (key, i, j):
                    if len(held[1]) > 1:
                        out += of(held[1], held[2])
                    held = ((key, i, j), [], [])
                held[1].append(node)
                held[2].append(fp)
            yield batch_of(out)
        if len(held[1]) > 1:
            yield batch_of(of(held[1], held[2]))

    return run


def _chunked(nodes: DataFrame, begin: int, end: int, scratch: Scratch, name: str) -> tuple[DataFrame, DataFrame]:
    """(key, n, c, first) of the blocks that nodes of unlike roots share, and (key, node, root, c, own) of their nodes, own being one of c chunks.

    Of the blocks, those from begin to end; in the last round also those before begin that have several chunks, as only these have something left."""
    last = end == TABLES
    blocks = nodes.mapInArrow(_blocks(0 if last else begin, end), "key long, node long, root long")
    shared = blocks.groupBy("key").agg(F.count("*").alias("n"), F.min("root").alias("lo"), F.max("root").alias("hi"), F.min("node").alias("first")).filter("lo < hi").filter((F.col("key") >= begin << BLOCK_BITS) | (F.col("n") > PART))
    shared = scratch.put(shared.select("key", "n", F.ceil(F.col("n") / PART).alias("c"), "first"), f"shared-{name}")
    chunks = blocks.join(shared.select("key", "c").hint("merge"), "key").withColumn("own", F.pmod(F.xxhash64("node"), F.col("c")))
    return shared, scratch.put(chunks, f"chunks-{name}")


def _chunk_rows(chunks: DataFrame, shared: DataFrame) -> DataFrame:
    """(key, i, j, node): each node in its own chunk, i = j, and the first node of a block in all of its chunks."""
    own = chunks.select("key", F.col("own").alias("i"), "node")
    first = shared.filter("c > 1").select("key", F.explode(F.expr("filter(sequence(0L, c - 1), t -> t <> pmod(xxhash64(first), c))")).alias("i"), F.col("first").alias("node"))
    return own.unionByName(first).select("key", "i", F.col("i").alias("j"), "node")


def _rest_rows(chunks: DataFrame, shared: DataFrame, scratch: Scratch) -> DataFrame:
    """(key, i, j, node): what is left to compare where nodes have roots. A block of one chunk is one tile. In others the nodes of the largest
    root, most of them as a rule, need not meet; the rest, dealt to chunks of its own, meets each of their chunks and each of its own."""
    crowd = chunks.filter("c > 1")
    largest = crowd.groupBy("key", "root").agg(F.count("*").alias("many")).groupBy("key").agg(F.max_by("root", F.struct("many", "root")).alias("big"), F.max("many").alias("many"))
    largest = scratch.put(largest.join(shared.select("key", "n").hint("merge"), "key").select("key", "big", F.ceil((F.col("n") - F.col("many")) / PART).alias("g")), "largest")
    dealt = crowd.join(largest.hint("merge"), "key")
    guests = dealt.filter("root <> big").withColumn("at", F.pmod(F.xxhash64("node", F.lit(1)), F.col("g")))
    among = "transform(filter(sequence(0L, g - 1), t -> t <> at), t -> struct(least(at, t) AS i, greatest(at, t) AS j))"
    guests = guests.withColumn("tile", F.explode(F.expr(f"concat({among}, transform(sequence(0L, c - 1), t -> struct(at AS i, g + t AS j)))")))
    members = dealt.filter("root = big").withColumn("tile", F.explode(F.expr("transform(sequence(0L, g - 1), t -> struct(t AS i, g + own AS j))")))
    single = chunks.filter("c = 1").select("key", F.lit(0).cast("long").alias("i"), F.lit(0).cast("long").alias("j"), "node")
    return single.unionByName(guests.select("key", "tile.i", "tile.j", "node")).unionByName(members.select("key", "tile.i", "tile.j", "node"))


def similar_groups(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """(did, th, component, first) for each row of docs: component is the smallest did reachable over pairs whose sets of shingles
    are similar; first is (did, th) of the row that stands for the group, the smallest, so it tells groups of one component apart.

    Of pairs at 0.8 all but six in a hundred share a block and all but one in forty of these are told; of pairs at 0.85 less than one in a hundred is missed; groups need no
    more than a chain of such pairs. Among n texts n * n / 2 ** 18 pairs or so share a block by chance, so BLOCK_BITS is to grow by two for each four times 100 million texts, and TABLES by a third.
    The first blocks are compared in chunks of PART and their links connected; after that only blocks with texts that are not connected yet are compared, what is not
    connected with all of a block, so no pair is lost and a large group of similar texts costs few rows for each text. Null and empty texts are alike. A null id sorts last. An empty table gives an empty result."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "similar")
    texts = docs.select(did().alias("did"), text_hash().alias("th"), F.col("text").cast("string").alias("text"))
    rows = scratch.put(texts.mapInArrow(_wide(shingle), "did long, th long, fp binary").withColumn("node", F.xxhash64("fp")), "rows")
    nodes = scratch.put(rows.groupBy("node").agg(F.min(F.struct("did", "th")).alias("least"), F.any_value("fp").alias("fp")), "nodes")

    def close(met: DataFrame, name: str) -> DataFrame:
        pairs = met.join(nodes.select("node", "fp").hint("merge"), "node").select("key", F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j"), "node", "fp")
        dealt = pairs.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "node")
        return scratch.put(dealt.mapInArrow(_verified(most_bits(similarity)), "a long, b long"), name)

    rooted, links, begin = nodes.select("node", F.col("node").alias("root"), "fp"), None, 0
    for turn, end in enumerate((*ROUNDS, TABLES)):
        last = end == TABLES
        shared, chunks = _chunked(rooted, begin, end, scratch, f"{turn}")
        found = close(_rest_rows(chunks, shared, scratch) if last else _chunk_rows(chunks, shared), f"close-{turn}")
        links, begin = found if links is None else links.unionByName(found), end
        roots = components(links, scratch, f"similar-{turn}")
        rooted = nodes.select("node", "fp").join(roots.select(F.col("a").alias("node"), "root").hint("merge"), "node", "left").select("node", F.coalesce("root", "node").alias("root"), "fp")
        scratch.drop(f"shared-{turn}", f"chunks-{turn}")
    found = nodes.select("node", "least").join(roots.select(F.col("a").alias("node"), "root").hint("merge"), "node", "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    least = scratch.put(found.groupBy("root").agg(F.min("least").alias("first")), "least")
    classes = scratch.put(found.join(least.hint("merge"), "root").select("node", "first"), "classes")
    return rows.select("did", "th", "node").join(classes.hint("merge"), "node").select("did", "th", F.col("first.did").alias("component"), "first")


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = 42) -> DataFrame:
    """(did, fp) for each row; fp is the fingerprint as a signed long."""
    return docs.select(did().alias("did"), F.col("text").cast("string").alias("text")).mapInArrow(_fingerprints(shingle, seed), "did long, fp long")


def links(prints: DataFrame, scratch: Scratch, crowd: int = 256) -> DataFrame:
    """(a, b): links between the distinct fingerprints fp at distance one or two; enough of them that what is
    reachable over all such pairs is reachable over these."""
    block = [F.struct(F.lit(k).alias("k"), (F.shiftrightunsigned("fp", at).bitwiseAND((1 << bits) - 1)).alias("v")) for k, (at, bits) in enumerate(BLOCKS)]
    blocks = prints.select("fp", F.explode(F.array(*block)).alias("x")).select("fp", (F.col("x.v") * len(BLOCKS) + F.col("x.k")).alias("key"), F.col("x.k").alias("k"))
    shared = blocks.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    blocks = scratch.put(blocks.join(scratch.put(shared, "shared").hint("merge"), "key"), "blocks")
    left = blocks.filter(F.col("n") <= crowd).select("key", F.col("fp").alias("a"))
    right = blocks.filter(F.col("n") <= crowd).select("key", F.col("fp").alias("b"))
    pairs = left.join(right, "key").filter((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2)).select("a", "b")
    bits = [F.array(F.lit(0).cast("long"), *(F.lit(1 << x if x < 63 else -(1 << 63)).cast("long") for x in range(64) if not at <= x < at + size)) for at, size in BLOCKS]
    crowded = blocks.filter(F.col("n") > crowd).select("fp", "k", F.explode(F.when(F.col("k") == 0, bits[0]).when(F.col("k") == 1, bits[1]).otherwise(bits[2])).alias("bit"))
    middles = crowded.select("fp", "k", F.col("fp").bitwiseXOR(F.col("bit")).alias("mid")).groupBy("k", "mid").agg(F.sort_array(F.collect_list("fp")).alias("all"))  # 44 at most
    stars = middles.filter(F.size("all") > 1).select(F.element_at("all", 1).alias("a"), F.explode(F.slice("all", 2, 64)).alias("b"))
    return pairs.unionByName(stars)


def near_duplicates(docs: DataFrame, shingle: int = 3, seed: int = 42, crowd: int = 256) -> DataFrame:
    """(did, fp, component) for each row of docs: component is the smallest did reachable over
    fingerprints that differ in two bits at most.

    Null and empty texts have fingerprint zero and are linked like any others. A null id sorts
    last. Repeated rows each give a row. An empty table gives none."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "simhash")
    rows = scratch.put(fingerprints(docs, shingle, seed), "rows")
    prints = scratch.put(rows.groupBy("fp").agg(F.min("did").alias("least")), "prints")
    roots = components(links(prints.select("fp"), scratch, crowd), scratch).select(F.col("a").alias("fp"), "root")
    found = prints.join(roots.hint("merge"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = found.groupBy("root").agg(F.min("least").alias("component"))
    classes = scratch.put(found.join(scratch.put(least, "least").hint("merge"), "root").select("fp", "component"), "classes")
    return rows.join(classes.hint("merge"), "fp").select("did", "fp", "component")


def op8(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id of each row."""
    return near_duplicates(docs).select(undid().alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), undid("component").alias("component_id"))


def deduplicate(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row of docs for each group of similar texts, that of the smallest did and then of the smallest text hash; rows are told
    apart by both, so rows that share an id, or have none, stay if their texts are of different groups. Columns as in docs."""
    groups = similar_groups(docs, shingle, similarity)
    keep = groups.filter((F.col("did") == F.col("first.did")) & (F.col("th") == F.col("first.th"))).select("did", "th").distinct()
    own = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    # Of rows alike in id and text that with the least other columns, so that a rerun keeps the same.
    order = F.to_json(others(docs), {"ignoreNullFields": "false"})
    rows = docs.select(did().alias("did"), text_hash().alias("th"), own.alias("row"), order.alias("order")).join(keep.hint("merge"), ["did", "th"])
    return rows.groupBy("did", "th").agg(F.min_by("row", "order").alias("row")).select("row.*")
