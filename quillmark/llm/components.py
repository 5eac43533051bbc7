"""Connected components of a graph that lies in a table.

Alternating large-star and small-star rounds: each is a minimum per node and a join back, so no
group is ever collected. The minima are written before they are joined, so both sides of the join are
plain shuffles and a hub's rows are split (AQE skew join). Before the first round
every Arrow batch contracts its own links by union-find, which shortens long chains. Each round
is written as a table, so lineage stays short and a lost executor costs one round at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.llm.common import Scratch


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        root: dict[int, int] = {}

        def find(x: int) -> int:
            path = []
            while (up := root.get(x, x)) != x:
                path.append(x)
                x = up
            for y in path:
                root[y] = x
            return x

        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = find(a), find(b)
            if a != b:
                root[max(a, b)] = min(a, b)
        nodes = list(root)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([find(x) for x in nodes], pa.int64())], names=["a", "b"])


def _large_star(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """Links each larger neighbour of a node to the smallest of the node and its neighbours."""
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(scratch.put(least, name).hint("merge"), "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """Links a node and its smaller neighbours to the smallest of them. Needs a > b."""
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    least = scratch.put(least, name)
    rest = links.join(least.hint("merge"), "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return least.select("a", F.col("m").alias("b")).unionByName(rest).distinct()


def components(links: DataFrame, scratch: Scratch, name: str = "components", most_rounds: int = 60) -> DataFrame:
    """(a, root) for each node of links (a, b): the smallest node it is connected to.

    Self links and repeated links do no harm; nodes without links do not appear. An empty table
    gives an empty result. Raises if the rounds do not settle, rather than return half-merged
    groups (the number of rounds grows with the logarithm of the longest chain)."""
    links = links.select(F.greatest("a", "b").cast("long").alias("a"), F.least("a", "b").cast("long").alias("b")).filter("a > b")
    links = scratch.put(links.mapInArrow(_contract, "a long, b long").filter("a > b").distinct(), f"{name}-0")
    state = None
    for k in range(1, most_rounds + 1):
        links = scratch.put(_large_star(links, scratch, f"{name}-large-{k}"), f"{name}-mid-{k}")
        links = scratch.put(_small_star(links, scratch, f"{name}-small-{k}"), f"{name}-{k}")
        scratch.drop(f"{name}-{k - 1}", f"{name}-mid-{k}", f"{name}-large-{k}", f"{name}-small-{k}")
        now = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            return links.select("a", F.col("b").alias("root"))
        state = now
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
