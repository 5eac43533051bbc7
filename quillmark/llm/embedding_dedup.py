"""Near-duplicate vectors by sorted projection passes.

Each pass gives a vector a key of 64 random one-bit hashes, signs of its projections, and orders the vectors by it, lexicographically.
Every vector is compared with its ``reach`` next ones in the order: cosine in double precision, so no false link. The order is dealt out in
stretches, each with the ``reach`` vectors that follow it, so windows go over the borders of partitions. Vectors whose keys begin alike are a run of the order. A run longer
than the reach is more than its windows show, so its pairs beyond the windows are compared too, in tiles of two chunks; a run that is shorter lies within its windows.

A pair is therefore found if the first ``bits`` hashes are equal in a pass, however many vectors share them, and often by windows without that. The number of bits is
at least one, and the one whose passes cost least, by how long the runs of the first passes are found to be; the number of passes follows from it and the threshold's angle.
A pair is counted in the first pass that compares it: every vector carries its places and runs of earlier passes, so whether one of them compared a pair is
arithmetic, and pairs are never gathered to tell. A stretch or tile adds up the counts of its vectors and passes on the links of a spanning
forest; the forests of all passes are united by connected components. Equal vectors are one node with a multiplicity. A few passes are dealt out at a time, so
that their copies of the vectors are gone from disk before the next.

Large groups of near copies make runs that only comparison empties. So before the passes, stretches of one
more order with ``DENSE`` vectors within half the threshold's angle of one of them name it a pivot; pivots that lie in
each other's cores are thinned out. Two vectors within half the angle of a pivot are within the whole angle of
each other, so a core's members are all linked, which needs a count and no comparison. Vectors within one and a half
times the angle of a pivot that are not in its core are compared with its members, block by block. So links of members are
complete however large a core is, and only the rest goes through the passes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from math import ceil, log, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmark.llm.common import Scratch, did, undid
from quillmark.llm.components import components
from quillmark.llm.vectors import dimension, matrix, unit, valid

COSINE, REACH, BLOCK = 0.9, 256, 4096
#: Vectors of a stretch of BLOCK that make a core; pivots that one task thins out or is sent at once.
DENSE, PIVOTS = 512, 4096
#: Passes whose runs are measured to choose the number of bits; comparisons that dealing out a vector costs as much as; passes dealt out at a time.
MEASURED, DEAL, AT_ONCE = 4, 256, 2
#: Kept off the borders of angles, against rounding.
SLACK = 1e-6
#: Chance of missing a pair at the threshold that the number of passes is chosen for.
MISS = 0.01


def passes_for(bits: int, cosine: float = COSINE) -> int:
    """Passes after which a pair at the threshold is missed with a chance of MISS at most: a pass finds it if all its bits are equal."""
    found = float(1 - np.arccos(cosine) / np.pi) ** bits
    return 1 if found >= 1 - MISS else ceil(log(MISS) / log(1 - found))


def _keys(dim: int, passes: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = np.random.default_rng(seed).normal(size=(passes, dim, 64))
        for batch in batches:
            x, n = unit(matrix(batch.column(1), dim)), batch.num_rows
            for p in range(passes):
                bits = np.packbits(x @ planes[p] > 0, axis=1)
                key = (bits.view(">u8")[:, 0].astype(np.uint64) ^ np.uint64(1 << 63)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, p, np.int32)), pa.array(key), batch.column(0)], names=["pass", "key", "rep"])

    return run


def _placed(keys: DataFrame, bits: int, scratch: Scratch) -> DataFrame:
    """(rep, ranks, runs): the place of each vector in the order of each pass, and the number of its run, the first ``bits`` hashes."""
    # Dealt by ranges of the order, so a partition is a stretch of it; partition numbers ascend with it.
    dealt = keys.repartitionByRange("pass", "key", "rep").sortWithinPartitions("pass", "key", "rep")
    order = scratch.put(dealt.withColumn("id", F.monotonically_increasing_id()), "order")
    pid = F.shiftright("id", 33)
    counts = order.groupBy("pass", pid.alias("pid")).agg(F.count("*").alias("m"), F.min("id").alias("least"))
    before = Window.partitionBy("pass").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("pass", "pid", "least", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("base"))
    place = F.struct("pass", (F.col("id") - F.col("least") + F.col("base")).alias("rank"), F.shiftright("key", 64 - bits).alias("run"))
    ranked = order.withColumn("pid", pid).join(bases, ["pass", "pid"]).select("rep", place.alias("place"))
    return ranked.groupBy("rep").agg(F.sort_array(F.collect_list("place")).alias("places")).select("rep", F.col("places.rank").alias("ranks"), F.col("places.run").alias("runs"))


def _bits_for(rest: DataFrame, dim: int, n: int, cosine: float, reach: int, seed: int) -> int:
    """The number of bits, one at least, whose passes cost least."""
    most = max(1, ceil(log2(max(n, 2))))
    keys = rest.select("rep", "v").mapInArrow(_keys(dim, MEASURED, seed), "pass int, key long, rep long")
    prefixes = keys.select("pass", "key", F.explode(F.sequence(F.lit(1), F.lit(most))).alias("bits")).select("pass", "bits", F.expr("shiftright(key, 64 - bits)").alias("run"))
    sizes = prefixes.groupBy("pass", "bits", "run").agg(F.count("*").cast("double").alias("m"))
    pairs = {r["bits"]: r["pairs"] / MEASURED for r in sizes.groupBy("bits").agg(F.sum(F.col("m") * F.col("m")).alias("pairs")).collect()}
    return min(pairs, key=lambda b: (passes_for(b, cosine) * (n * (reach + DEAL) + pairs[b]), b), default=1)


def _compare(dim: int, cosine: float, reach: int, p: int, window: bool):
    """Links of a stretch (window) or of a tile of a run, of the vectors of chunk ``i`` with those after them, or of chunk ``j``."""

    def run(key: tuple, group: pa.Table) -> pa.Table:
        i, j = key[-2].as_py(), key[-1].as_py()
        group = group.combine_chunks().sort_by([("chunk", "ascending"), ("rank", "ascending")])
        x = unit(matrix(group.column("v").combine_chunks(), dim))
        reps, mult = group.column("rep").to_numpy(), group.column("mult").to_numpy()
        ranks, runs = (group.column(c).combine_chunks().flatten().to_numpy().reshape(len(x), -1) for c in ("ranks", "runs"))
        at, own = ranks[:, p], int((group.column("chunk").to_numpy() == i).sum())
        links, root = np.zeros(len(x), np.int64), np.arange(len(x))
        for k in range(0, own, 256):
            end = min(k + 256, own)
            start, stop = (k, int(np.searchsorted(at, at[end - 1] + reach, "right"))) if window else (k if i == j else own, len(x))
            a, b = np.nonzero(x[k:end] @ x[start:stop].T >= cosine)
            a, b = a + k, b + start
            within = np.abs(at[a] - at[b]) <= reach
            fits = ((b > a) & within) if window else ((b > a) & ~within)
            a, b = a[fits], b[fits]
            for q in range(p):
                new = (np.abs(ranks[a, q] - ranks[b, q]) > reach) & (runs[a, q] != runs[b, q])
                a, b = a[new], b[new]
            np.add.at(links, a, mult[b])
            np.add.at(links, b, mult[a])
            bounds = np.append(np.unique(a, return_index=True)[1], len(a))
            for c, d in zip(bounds[:-1], bounds[1:], strict=True):
                to, roots = root[a[c]], root[b[c:d]]
                if (roots != to).any():
                    joined = np.zeros(len(x), bool)
                    joined[roots] = True
                    root[joined[root]] = to
        hit = np.flatnonzero(links)
        return pa.table({"rep": pa.array(reps[hit], pa.int64()), "n": pa.array(links[hit], pa.int64()), "other": pa.array(reps[root[hit]], pa.int64())})

    return run


def _passed(placed: DataFrame, p: int, long_runs: DataFrame, dim: int, cosine: float, reach: int, block: int) -> DataFrame:
    """Links (rep, n, other) that pass p is the first to compare."""
    know = [F.slice(c, 1, p + 1).alias(c) for c in ("ranks", "runs")]
    rows = placed.select("rep", "mult", "v", *know, F.get("ranks", F.lit(p)).alias("rank"), F.get("runs", F.lit(p)).alias("run"))
    columns, hit = ["i", "j", "rep", "mult", "v", "ranks", "runs", "rank", "chunk"], "rep long, n long, other long"
    own = F.floor(F.col("rank") / block)
    # A stretch and what follows it within reach: the vectors of the next stretches, in whose own groups they are again.
    ahead = F.greatest(F.floor((F.col("rank") - reach) / block), F.lit(0))
    dealt = rows.withColumn("i", F.explode(F.sequence(F.least(ahead, own), own))).withColumn("j", F.col("i")).withColumn("chunk", own)
    windows = dealt.select(*columns).groupBy("i", "j").applyInArrow(_compare(dim, cosine, reach, p, True), hit)
    # Members of a long run, dealt so that each pair of its chunks meets once.
    shared = rows.join(long_runs.filter(F.col("pass") == p).drop("pass"), "run").withColumn("chunk", F.pmod(F.xxhash64("rep"), F.col("c")))
    tiles = shared.withColumn("t", F.explode(F.expr("sequence(0L, c - 1)"))).withColumn("i", F.least("chunk", "t")).withColumn("j", F.greatest("chunk", "t"))
    beyond = tiles.select("run", *columns).groupBy("run", "i", "j").applyInArrow(_compare(dim, cosine, reach, p, False), hit)
    return windows.unionByName(beyond)


def _core_cosines(cosine: float) -> tuple[float, float]:
    """Cosines of half the threshold's angle, and of one and a half times it."""
    angle = float(np.arccos(cosine))
    return float(np.cos(angle / 2)) + SLACK, float(np.cos(min(np.pi, 1.5 * angle))) - SLACK


def _proposed(dim: int, core: float, dense: int):
    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks().sort_by("rep")
        x, reps = unit(matrix(group.column("v").combine_chunks(), dim)), group.column("rep").to_numpy()
        near = np.concatenate([x[k : k + 512] @ x.T >= core for k in range(0, len(x), 512)])
        picked, open_ = [], np.ones(len(x), bool)
        while open_.sum() >= dense:
            count = near[:, open_].sum(axis=1)
            best = int(count.argmax())
            if count[best] < dense:
                break
            picked.append(best)
            open_ &= ~near[best]
        return pa.table({"rep": pa.array(reps[picked], pa.int64()), "v": group.column("v").combine_chunks().take(pa.array(picked, pa.int64()))})

    return run


def _thinned(dim: int, core: float):
    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks().sort_by("rep")
        x, kept = unit(matrix(group.column("v").combine_chunks(), dim)), []
        for k in range(len(x)):
            if not kept or (x[kept] @ x[k]).max() < core:
                kept.append(k)
        return group.select(["rep", "v"]).take(pa.array(kept, pa.int64()))

    return run


def _near_pivots(sent, dim: int, near: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots, p = sent.value
        for batch in batches:
            for k in range(0, batch.num_rows, 1024):
                part = batch.slice(k, 1024)
                s = unit(matrix(part.column(2), dim)) @ p.T
                i, j = np.nonzero(s >= near)
                yield pa.RecordBatch.from_arrays([c.take(pa.array(i)) for c in part.columns] + [pa.array(pivots[j]), pa.array(s[i, j])], names=["rep", "mult", "v", "pivot", "cos"])

    return run


def _across(dim: int, cosine: float):
    def run(key: tuple, group: pa.Table) -> pa.Table:
        group = group.combine_chunks().sort_by("rep")
        member = group.column("member").to_numpy(zero_copy_only=False).astype(bool)
        x = unit(matrix(group.column("v").combine_chunks(), dim))
        reps, mult, free = group.column("rep").to_numpy(), group.column("mult").to_numpy(), group.column("free").to_numpy(zero_copy_only=False).astype(bool)
        inner, outer = np.flatnonzero(member), np.flatnonzero(~member)
        out: list[tuple[int, int, int]] = []
        back = np.zeros(len(inner), np.int64)
        for k in range(0, len(outer), 512):
            o = outer[k : k + 512]
            linked = x[o] @ x[inner].T >= cosine
            n = linked @ mult[inner]
            for i in np.flatnonzero(n):
                out.append((int(reps[o[i]]), int(n[i]), int(reps[inner[int(linked[i].argmax())]])))
            back += (linked[free[o]] * mult[o[free[o]]][:, None]).sum(axis=0)
        out += [(int(reps[inner[i]]), int(back[i]), int(reps[inner[i]])) for i in np.flatnonzero(back)]
        return pa.table({c: pa.array([r[k] for r in out], pa.int64()) for k, c in enumerate(("rep", "n", "other"))})

    return run


def _cores(classes: DataFrame, dim: int, n: int, cosine: float, block: int, dense: int, seed: int, scratch: Scratch) -> tuple[DataFrame, DataFrame] | None:
    """Links (rep, n, other) of the members of cores, and of others with them; and the members (rep). None if no stretch is dense."""
    core, near = _core_cosines(cosine)
    keys = classes.select("rep", "v").mapInArrow(_keys(dim, 1, seed + 1), "pass int, key long, rep long")
    order = _placed(keys, 1, scratch)
    stretches = classes.select("rep", "v").join(order, "rep").select("rep", "v", F.expr(f"ranks[0] div {block}").alias("stretch"))
    pivots = scratch.put(stretches.groupBy("stretch").applyInArrow(_proposed(dim, core, dense), "rep long, v array<double>"), "pivots-0")
    scratch.drop("order")
    left, turn = pivots.count(), 0
    if not left:
        return None
    while True:
        turn += 1
        groups = ceil(left / PIVOTS)
        thin = pivots.withColumn("g", F.pmod(F.xxhash64("rep", F.lit(turn)), F.lit(groups))).groupBy("g").applyInArrow(_thinned(dim, core), "rep long, v array<double>")
        pivots = scratch.put(thin, f"pivots-{turn}")
        before, left = left, pivots.count()
        if groups == 1 or left > 0.9 * before:
            break
    blocks = ceil(left / PIVOTS)
    parts = []
    for b in range(blocks):
        own = sorted((r["rep"], r["v"]) for r in pivots.filter(F.pmod(F.xxhash64("rep"), F.lit(blocks)) == b).collect())
        if own:
            sent = classes.sparkSession.sparkContext.broadcast((np.array([x[0] for x in own], np.int64), unit(np.array([x[1] for x in own], np.float64))))
            parts.append(scratch.put(classes.select("rep", "mult", "v").mapInArrow(_near_pivots(sent, dim, near), "rep long, mult long, v array<double>, pivot long, cos double"), f"near-{b}"))
    close = parts[0]
    for p in parts[1:]:
        close = close.unionByName(p)
    inside = close.filter(F.col("cos") >= core)
    members = scratch.put(inside.groupBy("rep").agg(F.min_by("pivot", F.struct(-F.col("cos"), F.col("pivot"))).alias("core"), F.first("mult").alias("mult")), "members")
    sizes = members.groupBy("core").agg(F.sum("mult").alias("size"), F.count("*").alias("many"), F.min("rep").alias("least"))
    sizes = scratch.put(sizes, "sizes")
    links = members.join(sizes, "core").select("rep", (F.col("size") - F.col("mult")).alias("n"), F.col("least").alias("other"))
    # Members and what is near them, dealt so that each pair of blocks meets once.
    named = close.join(members.select("rep", "core").hint("merge"), "rep", "left")
    outer = named.filter(F.col("core").isNull() | (F.col("core") != F.col("pivot"))).select("pivot", "rep", "mult", "v", F.lit(False).alias("member"), F.col("core").isNull().alias("free"))
    outer = scratch.put(outer, "outer")
    chunks = scratch.put(outer.groupBy("pivot").agg(F.count("*").alias("others")), "chunks")
    plan = sizes.select(F.col("core").alias("pivot"), F.ceil(F.col("many") / block).alias("m")).join(chunks.select("pivot", F.ceil(F.col("others") / block).alias("c")), "pivot")
    plan = scratch.put(plan, "plan")
    inner = named.filter(F.col("core") == F.col("pivot")).select("pivot", "rep", "mult", "v", F.lit(True).alias("member"), F.lit(False).alias("free"))
    hashed = lambda n: F.pmod(F.xxhash64("rep"), F.col(n)).cast("long")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n).cast("long") - 1))
    left_side = inner.join(plan, "pivot").withColumn("i", hashed("m")).withColumn("j", every("c"))
    right_side = outer.join(plan, "pivot").withColumn("j", hashed("c")).withColumn("i", every("m"))
    columns = ["pivot", "i", "j", "rep", "mult", "v", "member", "free"]
    met = left_side.select(*columns).unionByName(right_side.select(*columns)).groupBy("pivot", "i", "j").applyInArrow(_across(dim, cosine), "rep long, n long, other long")
    return scratch.put(links.unionByName(met), "core_links"), members.select("rep")


def near_duplicates(embeddings: DataFrame, cosine: float = COSINE, reach: int = REACH, block: int = BLOCK, passes: int | None = None, dense: int = DENSE, seed: int = 42) -> DataFrame:
    """(vid, n_links, component) for each row of (vec_id, embedding).

    reach: vectors that each is compared with in a pass's order; block: vectors of a stretch or chunk; dense: of a core.
    n_links: the other rows linked directly; component: the smallest vid reachable, vid being vec_id with null as
    the largest long. Vectors that are null, zero, not finite or of another length than most link with
    nothing. Rows with equal vectors are linked. Rows that share an id, or have none, and differ in vector are linked as
    their vectors are, each for itself. An empty table gives an empty result."""
    spark = embeddings.sparkSession
    scratch = Scratch(spark, "embeddings")
    rows = embeddings.select(did("vec_id").alias("vid"), F.col("embedding").cast("array<double>").alias("v")).withColumn("ok", valid(F.col("v")))
    dim = dimension(rows)
    rows = rows.withColumn("ok", F.col("ok") & (F.size("v") == dim))
    # Equal vectors have equal text forms; adding zero makes the two zeros one.
    rows = rows.withColumn("h", F.when(F.col("ok"), F.unhex(F.md5(F.array_join(F.transform("v", lambda x: F.hex((x + F.lit(0.0)).cast("string"))), ",")))))
    classes = rows.filter("ok").groupBy("h").agg(F.min("vid").alias("least"), F.count("*").alias("mult"), F.any_value("v").alias("v"))
    classes = scratch.put(classes.withColumn("rep", F.monotonically_increasing_id()), "classes")  # ids may repeat, so a number is the node
    n = classes.count()
    cores = _cores(classes, dim, n, cosine, block, dense, seed, scratch) if n >= dense else None
    rest = classes.select("rep", "mult", "v")
    if cores is not None:
        rest = scratch.put(rest.join(cores[1].hint("merge"), "rep", "left_anti"), "rest")
        n = rest.count()
    bits = _bits_for(rest, dim, n, cosine, reach, seed)
    passes = passes or passes_for(bits, cosine)
    places = _placed(rest.select("rep", "v").mapInArrow(_keys(dim, passes, seed), "pass int, key long, rep long"), bits, scratch)
    placed = scratch.put(rest.join(places.hint("merge"), "rep"), "placed")
    runs = placed.select(F.posexplode("runs").alias("pass", "run")).groupBy("pass", "run").agg(F.count("*").alias("m"))
    long_runs = scratch.put(runs.filter(F.col("m") > reach).select("pass", "run", F.ceil(F.col("m") / block).alias("c")), "long_runs")
    parts = []
    for p in range(0, passes, AT_ONCE):
        some = [_passed(placed, q, long_runs, dim, cosine, reach, block) for q in range(p, min(p + AT_ONCE, passes))]
        parts.append(scratch.put(reduce(DataFrame.unionByName, some), f"found-{p}"))
    found = reduce(DataFrame.unionByName, parts)
    if cores is not None:
        found = found.unionByName(cores[0])
    roots = components(found.select(F.col("rep").alias("a"), F.col("other").alias("b")), scratch)
    links = found.groupBy("rep").agg(F.sum("n").alias("n"))
    known = classes.select("h", "rep", "mult", "least").join(links.hint("merge"), "rep", "left").join(roots.select(F.col("a").alias("rep"), "root").hint("merge"), "rep", "left")
    known = scratch.put(known.select("h", (F.coalesce("n", F.lit(0)) + F.col("mult") - 1).alias("n_links"), "least", F.coalesce("root", "rep").alias("root")), "known")
    least = scratch.put(known.groupBy("root").agg(F.min("least").alias("component")), "least")
    figures = scratch.put(known.join(least.hint("merge"), "root").select("h", "n_links", "component"), "figures")
    done = rows.select("vid", "h").join(figures.hint("merge"), "h", "left")
    return done.select("vid", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component", "vid").alias("component"))


def op2(embeddings: DataFrame) -> DataFrame:
    """vec_id, n_links, component_id and kept of each row."""
    done = near_duplicates(embeddings)
    return done.select(undid("vid").alias("vec_id"), "n_links", undid("component").alias("component_id"), (F.col("vid") == F.col("component")).alias("kept"))
