"""Resampling tests for groups of any size, by Poisson weights.

A resample of n rows draws each of them a number of times that is nearly Poisson with mean one, so a resampled mean is a weighted one: each row has a weight for each draw, and the sums of weights and of
weighted values are formed where the rows are. No group is gathered. Weights follow from the row's key and the draw alone, so results
don't depend on how rows are dealt. Against resampling in numpy, as in ``statistics``, intervals and p values differ by the noise of the draws and by the
order of 1/n, as n itself varies; use those for groups under a few dozen rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import exp

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Weights that a task makes at once.
CELLS = 1 << 22
#: Chances of a weight of at most 0, 1, 2, ..., of a Poisson number with mean one, to the last that double precision tells from one.
_UPTO = np.cumsum([exp(-1.0) / np.prod(np.arange(1, k + 1, dtype=float)) for k in range(18)])


def weights(keys: np.ndarray, draws: np.ndarray) -> np.ndarray:
    """(keys, draws) Poisson numbers with mean one, a function of 64-bit key and draw."""
    with np.errstate(over="ignore"):
        x = keys.astype(np.int64).view(np.uint64)[:, None] + (draws.astype(np.uint64) + np.uint64(1))[None, :] * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return np.searchsorted(_UPTO, (x >> np.uint64(11)).astype(np.float64) / 2.0**53, side="right")


def _summed(times: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        step = max(1, CELLS // times)
        for batch in batches:
            groups, key, value = np.array(batch.column(0).to_pylist(), object), batch.column(1).to_numpy(), batch.column(2).to_numpy()
            for g in set(groups.tolist()):
                own = np.flatnonzero(groups == g)
                total = held.setdefault(g, np.zeros((2, times)))
                for k in range(0, len(own), step):
                    w = weights(key[own[k : k + step]], np.arange(times))
                    total += np.stack([w.sum(axis=0), value[own[k : k + step]] @ w])
            if len(held) * times > CELLS:
                yield from _told(held, times)
                held = {}
        yield from _told(held, times)

    return run


def _told(held: dict[str, np.ndarray], times: int) -> Iterator[pa.RecordBatch]:
    for g, (w, wx) in held.items():
        yield pa.RecordBatch.from_arrays([pa.array([g] * times, pa.string()), pa.array(np.arange(times, dtype=np.int32)), pa.array(w), pa.array(wx)], names=["g", "draw", "w", "wx"])


def draws(rows: DataFrame, by: list[str], metric: str, key: str, times: int, seed: int = 42) -> DataFrame:
    """(by, draw, m): the resampled mean of each group in each draw; a draw in which none of a group's rows has weight is left out. Rows without a value take no part.

    key: a column that tells rows apart; rows that share key and group have the same weights."""
    kept = rows.filter(F.col(metric).isNotNull()).select(F.to_json(F.struct(*by), {"ignoreNullFields": "false"}).alias("g"), F.xxhash64(F.lit(seed), *by, key).alias("k"), F.col(metric).cast("double").alias("x"))
    sums = kept.mapInArrow(_summed(times), "g string, draw int, w double, wx double").groupBy("g", "draw").agg(F.sum("w").alias("w"), F.sum("wx").alias("wx"))
    names = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in by)
    return sums.filter("w > 0").select(F.from_json("g", names).alias("b"), "draw", (F.col("wx") / F.col("w")).alias("m")).select("b.*", "draw", "m")


def _bounds(level: float) -> tuple[Column, Column]:
    return F.percentile("m", F.lit(0.5 - level / 2)).alias("low"), F.percentile("m", F.lit(0.5 + level / 2)).alias("high")


def interval(rows: DataFrame, by: str, metric: str, key: str, stratum: str | None = None, times: int = 1000, level: float = 0.95) -> DataFrame:
    """(by, mean, low, high, n): as ``statistics.bootstrap_ci``, percentile interval of the mean, or of the mean of stratum means; null bounds under three values."""
    own = rows.filter(F.col(by).isNotNull() & F.col(metric).isNotNull())
    groups = [by, stratum] if stratum else [by]
    means = own.groupBy(*groups).agg(F.avg(metric).alias("mean"), F.count("*").alias("n")).groupBy(by).agg(F.avg("mean").alias("mean"), F.sum("n").alias("n"))
    drawn = draws(own, groups, metric, key, times).groupBy(by, "draw").agg(F.avg("m").alias("m")).groupBy(by).agg(*_bounds(level))
    enough = lambda c: F.when(F.col("n") >= 3, F.col(c)).alias(c)
    return means.join(drawn, by, "left").select(F.col(by).cast("string").alias(by), "mean", enough("low"), enough("high"), "n")


def _p_value(diff: Column) -> Column:
    """Two-sided: twice the share of draws on the other side of zero, or at it."""
    return F.least(F.lit(1.0), 2 * F.avg(F.when(diff >= 0, F.col("m") <= 0).otherwise(F.col("m") >= 0).cast("double"))).alias("p")


def paired(pairs: DataFrame, by: str, a: str, b: str, key: str, times: int = 10_000, seed: int = 42) -> DataFrame:
    """(by, diff, low, high, p, n_a, n_b): as ``statistics.paired_bootstrap``, mean of b less a over resampled pairs."""
    own = pairs.select(by, key, (F.col(b).cast("double") - F.col(a).cast("double")).alias("d")).dropna(subset=[by, "d"])
    means = own.groupBy(by).agg(F.avg("d").alias("diff"), F.count("*").alias("n"))
    drawn = draws(own, [by], "d", key, times, seed).join(means, by).groupBy(by, "diff", "n").agg(*_bounds(0.95), _p_value(F.col("diff")))
    return drawn.select(F.col(by).cast("string").alias(by), "diff", "low", "high", "p", F.col("n").alias("n_a"), F.col("n").alias("n_b"))


def unpaired(rows: DataFrame, by: str, metric: str, key: str, kind: str = "exp_type", first: str = "direct", times: int = 10_000, seed: int = 42) -> DataFrame:
    """(by, diff, low, high, p, n_a, n_b): as ``statistics.unpaired_bootstrap``; null figures where one side is empty."""
    own = rows.filter(F.col(by).isNotNull() & F.col(metric).isNotNull()).withColumn("side", F.coalesce(F.col(kind) == first, F.lit(False)))
    of = lambda c, side: F.max(F.when(F.col("side") == side, F.col(c)))
    means = own.groupBy(by, "side").agg(F.avg(metric).alias("mean"), F.count("*").alias("n"))
    means = means.groupBy(by).agg((of("mean", False) - of("mean", True)).alias("diff"), F.coalesce(of("n", True), F.lit(0)).alias("n_a"), F.coalesce(of("n", False), F.lit(0)).alias("n_b"))
    drawn = draws(own, [by, "side"], metric, key, times, seed).groupBy(by, "draw").agg((of("m", False) - of("m", True)).alias("m")).filter("m is not null")
    figures = drawn.join(means, by).groupBy(by, "diff").agg(*_bounds(0.95), _p_value(F.col("diff"))).drop("diff")
    return means.join(figures, by, "left").select(F.col(by).cast("string").alias(by), "diff", "low", "high", "p", "n_a", "n_b")


def ranking(rows: DataFrame, by: str, metric: str, key: str, times: int = 200, seed: int = 42) -> DataFrame:
    """(by, usual_rank, share): as ``statistics.ranking_stability``."""
    drawn = draws(rows.filter(F.col(by).isNotNull()), [by], metric, key, times, seed)
    ranks = drawn.withColumn("r", F.row_number().over(Window.partitionBy("draw").orderBy(F.desc("m"), by)))
    counts = ranks.groupBy(by, "r").agg(F.count("*").alias("n"))
    return counts.groupBy(by).agg(F.max_by("r", F.struct("n", -F.col("r"))).alias("usual_rank"), (F.max("n") / times).alias("share"))
