"""Tests, effect sizes, correlations and resampling.

What SQL can say is expressions; resampling runs in numpy for each group, seeded by the group alone, so results do not depend on how
rows are dealt. A group's values for a resampling test are those of one comparison and are gathered in one task: such groups hold an
experiment's questions or configurations, not a corpus. ``MOST_VALUES`` is checked; beyond it use the normal approximations here.
``unpaired_bootstrap`` has no such limit: the values of its largest groups are counted and their resamples drawn in chunks of values.
"""

from __future__ import annotations

import math
import zlib
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark.operators.ranking import average_rank, ranked_columns
from quillmark.session import new_folder, stored

MOST_VALUES = 5_000_000
#: Draws of values that one task makes before a test's resamples are dealt into blocks, and blocks of a group at most.
BLOCK_DRAWS, BLOCKS = 1 << 30, 16
#: Values that come more often in a group drawn in chunks have their number in a resample drawn at once, which takes as long as some twenty draws.
OFTEN = 20
#: Other values are drawn from pieces of so many, which stay in a core's cache.
PIECE = 1 << 14


def normalize(rows: DataFrame, metric: str, by: str = "dataset", how: str = "zscore") -> DataFrame:
    """The metric standardised in each group, as metric_norm: z scores (sample deviation) or min-max; 0 where a group has no spread."""
    w = Window.partitionBy(by)
    x = F.col(metric)
    if how == "zscore":
        low, spread = F.avg(x).over(w), F.stddev_samp(x).over(w)
    else:
        low, spread = F.min(x).over(w), F.max(x).over(w) - F.min(x).over(w)
    return rows.withColumn("metric_norm", F.when(F.coalesce(spread, F.lit(0.0)) == 0, x * 0.0).otherwise((x - low) / spread))


def running_best(trials: DataFrame, value: str = "value", order: str = "number", by: list[str] | None = None) -> DataFrame:
    """running_best, and the trial's place, from 0, in its group. Trials of a study are one ordered sequence; ``by`` gives one for each model."""
    w = Window.partitionBy(*(by or [F.lit(0)])).orderBy(order)
    return trials.withColumn("running_best", F.max(value).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("place", F.row_number().over(w) - 1)


def rolling_mean(trials: DataFrame, value: str = "value", order: str = "number", by: list[str] | None = None, width: int = 20, least: int = 5) -> DataFrame:
    """rolling_mean of the last ``width`` values; null under ``least`` of them."""
    w = Window.partitionBy(*(by or [F.lit(0)])).orderBy(order).rowsBetween(1 - width, 0)
    return trials.withColumn("rolling_mean", F.when(F.count(value).over(w) >= least, F.avg(value).over(w)))


def percentile_rank(rows: DataFrame, value: str, by: list[str]) -> DataFrame:
    """pct: average rank over the number of values of the group."""
    return rows.withColumn("pct", average_rank(F.col(value), by) / F.count(value).over(Window.partitionBy(*by)))


def holm(tests: DataFrame, p: str = "p") -> DataFrame:
    """p_adjusted: p times what is left of the number of tests at its rank, 1 at most; no monotone step. Tests are the few comparisons of one table."""
    w = Window.partitionBy(F.lit(0))
    rank = F.row_number().over(w.orderBy(p, "test"))
    return tests.withColumn("p_adjusted", F.least(F.col(p) * (F.count("*").over(w) - rank + 1), F.lit(1.0)))


def spread_of(rows: DataFrame, by: list[str], metric: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.avg(metric).alias("m"), F.var_samp(metric).alias("v"), F.count(metric).alias("n"))


def cohens_d(m1: Column, v1: Column, n1: Column, m2: Column, v2: Column, n2: Column) -> Column:
    """Difference of means over the pooled sample deviation; 0 for groups under two or without spread."""
    pooled = F.sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / F.nullif(n1 + n2 - 2, F.lit(0)))
    return F.when((n1 < 2) | (n2 < 2) | (F.coalesce(pooled, F.lit(0.0)) == 0), 0.0).otherwise((m1 - m2) / pooled)


def t_statistic(m1: Column, v1: Column, n1: Column, m2: Column, v2: Column, n2: Column) -> Column:
    pooled = ((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)
    return (m1 - m2) / F.sqrt(pooled * (1.0 / n1 + 1.0 / n2))


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1 / ((1 - (a + b) * x / (a + 1)) or tiny)
    h = d
    for m in range(1, 300):
        for term in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / ((1 + term * d) or tiny)
            c = (1 + term / c) or tiny
            h *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return h


def beta_cdf(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def t_two_sided(t: float, df: float) -> float:
    return beta_cdf(df / 2, 0.5, df / (df + t * t))


def f_upper(f: float, df1: float, df2: float) -> float:
    return beta_cdf(df2 / 2, df1 / 2, df2 / (df2 + df1 * f))


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def _each(f, n: int):
    @F.pandas_udf("double")
    def p(*columns: pd.Series) -> pd.Series:
        rows = zip(*columns, strict=True)
        return pd.Series([None if any(pd.isna(x) for x in r) else f(*map(float, r)) for r in rows], dtype="float64")

    return p


def t_test_p(t: Column, df: Column) -> Column:
    return _each(t_two_sided, 2)(t, df)


def f_test_p(f: Column, df1: Column, df2: Column) -> Column:
    return _each(f_upper, 3)(f, df1.cast("double"), df2.cast("double"))


def normal_p(z: Column) -> Column:
    return _each(normal_two_sided, 1)(z)


def compare_types(rows: DataFrame, metric: str, by: list[str]) -> DataFrame:
    """(by, direct_mean, rag_mean, diff, d, effect, t, df): rag against direct in each group that has two rows of each."""
    from quillmark.functions.parse import effect_size

    part = lambda kind, s: spread_of(rows.filter(F.col("exp_type") == kind), by, metric).select(*by, *(F.col(c).alias(c + s) for c in ("m", "v", "n")))
    both = part("rag", "1").join(part("direct", "2"), by).filter("n1 >= 2 and n2 >= 2")
    c = [F.col(x) for x in ("m1", "v1", "n1", "m2", "v2", "n2")]
    d = cohens_d(*c)
    return both.select(*by, F.col("m2").alias("direct_mean"), F.col("m1").alias("rag_mean"), (F.col("m1") - F.col("m2")).alias("diff"), d.alias("d"), effect_size(d).alias("effect"), t_statistic(*c).alias("t"), (F.col("n1") + F.col("n2") - 2).alias("df"))


def anova(rows: DataFrame, factor: str, metric: str) -> DataFrame:
    """One row (f, df1, df2): of the one-way analysis of variance over levels of two rows at least."""
    g = spread_of(rows.filter(F.col(factor).isNotNull() & F.col(metric).isNotNull()), [factor], metric).filter("n >= 2")
    s = g.agg(F.sum(F.col("n") * F.col("m")).alias("nm"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("nmm"), F.sum((F.col("n") - 1) * F.col("v")).alias("within"), F.count("*").alias("k"))
    df1, df2 = F.col("k") - 1, F.col("n") - F.col("k")
    return s.select(((F.col("nmm") - F.col("nm") * F.col("nm") / F.col("n")) / df1 / (F.col("within") / df2)).alias("f"), df1.alias("df1"), df2.alias("df2"))


def mann_whitney(rows: DataFrame, metric: str, by: list[str], kind: str = "exp_type", first: str = "rag") -> DataFrame:
    """(by, u, n1, n2, z): U of the rows of the first kind against the others, average ranks, with the normal deviate (ties corrected, no continuity)."""
    own = F.col(kind) == first
    ties = F.count("*").over(Window.partitionBy(*by, metric))
    ranked = rows.filter(F.col(metric).isNotNull()).select(*by, own.alias("own"), average_rank(F.col(metric), by).alias("r"), ((ties.cast("double") * ties - 1.0)).alias("tie"))
    s = ranked.groupBy(*by).agg(F.sum(F.when(F.col("own"), F.col("r"))).alias("r1"), F.count_if("own").alias("n1"), F.count_if(~F.col("own")).alias("n2"), F.sum("tie").alias("ties")).filter("n1 > 0 and n2 > 0")
    u = F.col("r1") - F.col("n1") * (F.col("n1") + 1) / 2.0
    n = F.col("n1") + F.col("n2")
    sd = F.sqrt(F.col("n1") * F.col("n2") / 12.0 * ((n + 1) - F.col("ties") / (n * (n - 1.0))))
    return s.select(*by, u.alias("u"), "n1", "n2", F.try_divide(u - F.col("n1") * F.col("n2") / 2.0, sd).alias("z"))


def spearman_matrix(rows: DataFrame, metrics: list[str]) -> DataFrame:
    """(a, b, rho) over rows complete in all metrics; a before b."""
    whole = reduce(lambda d, m: d.filter(F.col(m).isNotNull()), metrics, rows).select(*metrics)
    # Written with their ranks' order, so neither is made again; the joins are left to Spark's size check, as most values may be distinct.
    whole = stored(whole.select(*(F.col(m).cast("double").alias(m) for m in metrics)), new_folder(rows.sparkSession, "metrics"))
    ranks = ranked_columns(whole, metrics)
    of = lambda m: ranks.filter(F.col("column") == m).select(F.col("value").alias(m), F.col("rank").alias(f"{m}|rank"))
    ranked = reduce(lambda d, m: d.join(of(m), m), metrics, whole).select(*(F.col(f"{m}|rank").alias(m) for m in metrics))
    pairs = [(a, b) for i, a in enumerate(metrics) for b in metrics[i + 1 :]]
    one = ranked.agg(*(F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs))
    return one.unpivot([], one.columns, "pair", "rho").select(F.split("pair", r"\|")[0].alias("a"), F.split("pair", r"\|")[1].alias("b"), "rho")


def spearman_pairwise(long: DataFrame, item: str, column: str, value: str, least: int = 3) -> DataFrame:
    """(a, b, n, rho): correlation of the columns of a long table over the items both have; ranks are taken anew for each pair."""
    left, right = long.select(item, F.col(column).alias("a"), F.col(value).alias("x")), long.select(item, F.col(column).alias("b"), F.col(value).alias("y"))
    both = left.join(right, item).filter("a < b and x is not null and y is not null")
    ranked = both.select("a", "b", average_rank(F.col("x"), ["a", "b"]).alias("x"), average_rank(F.col("y"), ["a", "b"]).alias("y"))
    return ranked.groupBy("a", "b").agg(F.count("*").alias("n"), F.corr("x", "y").alias("rho")).filter(F.col("n") >= least)


def correlation(rows: DataFrame, by: list[str], x: str, y: str, least: int = 5) -> DataFrame:
    """(by, n, pearson, spearman)."""
    whole = rows.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    ranked = whole.select(*by, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), average_rank(F.col(x), by).alias("rx"), average_rank(F.col(y), by).alias("ry"))
    return ranked.groupBy(*by).agg(F.count("*").alias("n"), F.corr("x", "y").alias("pearson"), F.corr("rx", "ry").alias("spearman")).filter(F.col("n") >= least)


def regression(rows: DataFrame, by: list[str], x: Column, y: Column) -> DataFrame:
    """(by, slope, intercept, r2, n); give log(x) for a log-linear one."""
    return rows.groupBy(*by).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"), F.regr_count(y, x).alias("n"))


def power(rows: DataFrame, by: str, metric: str) -> DataFrame:
    """(by, n, sd, detectable): the smallest effect that 2.8 standard errors of a difference show."""
    s = rows.groupBy(by).agg(F.count(metric).alias("n"), F.stddev_samp(metric).alias("sd"))
    return s.select(by, "n", "sd", (2.8 * F.col("sd") * F.sqrt(2.0 / F.col("n"))).alias("detectable"))


def controlled_effect(rows: DataFrame, factor: str, metric: str, controls: list[str]) -> DataFrame:
    """(level, mean, effect): marginal means of a factor's levels against that of its most frequent level (ties to the smaller)."""
    from quillmark.operators.compare import known, marginal_means

    means = marginal_means(rows, factor, metric, tuple(controls)).select(F.col(factor).alias("level"), "mean")
    base = known(rows, factor).groupBy(F.col(factor).alias("level")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "level").limit(1).select("level")
    reference = means.join(base, "level").select(F.col("mean").alias("base"))
    return means.crossJoin(F.broadcast(reference)).select("level", "mean", (F.col("mean") - F.col("base")).alias("effect"))  # reference is one row


def metric_comparison(rows: DataFrame, metrics: list[str]) -> DataFrame:
    """(metric, direct_mean, rag_mean, diff, d, effect, t, df): rag against direct for each metric."""
    long = rows.select("exp_type", *metrics).unpivot(["exp_type"], metrics, "metric", "value")
    return compare_types(long, "value", ["metric"])


def config_agreement(rows: DataFrame, keys: list[str], metric: str, least: int = 5) -> DataFrame:
    """(a, b, n, rho): rank correlation of the configurations two datasets share, ``least`` of them."""
    from quillmark.operators.compare import config_pairs

    ranked = config_pairs(rows, keys, metric).select("a", "b", average_rank(F.round("ma", 9), ["a", "b"]).alias("x"), average_rank(F.round("mb", 9), ["a", "b"]).alias("y"))
    return ranked.groupBy("a", "b").agg(F.count("*").alias("n"), F.corr("x", "y").alias("rho")).filter(F.col("n") >= least)


def universal_configs(rows: DataFrame, keys: list[str], metric: str) -> DataFrame:
    """(keys, min_pct, spread): of configurations in every dataset, the least percentile rank of their mean and its range."""
    from quillmark.operators.compare import known

    means = known(rows, "dataset").groupBy("dataset", *keys).agg(F.round(F.avg(metric), 9).alias("m"))
    ranked = percentile_rank(means, "m", ["dataset"])
    total = known(rows, "dataset").agg(F.countDistinct("dataset").alias("total"))
    out = ranked.groupBy(*keys).agg(F.count("*").alias("n"), F.min("pct").alias("min_pct"), (F.max("pct") - F.min("pct")).alias("spread"))
    return out.crossJoin(F.broadcast(total)).filter("n = total").select(*keys, "min_pct", "spread")  # total is one row


def level_pairs(rows: DataFrame, factor: str, metric: str, stratum: str = "dataset") -> DataFrame:
    """(a, b, diff, n_strata): difference of the means of two levels in each stratum, averaged over strata that have both."""
    means = rows.filter(F.col(factor).isNotNull() & F.col(stratum).isNotNull()).groupBy(stratum, factor).agg(F.avg(metric).alias("m"))
    a, b = means.select(stratum, F.col(factor).alias("a"), F.col("m").alias("ma")), means.select(stratum, F.col(factor).alias("b"), F.col("m").alias("mb"))
    return a.join(b, stratum).filter("a < b").groupBy("a", "b").agg(F.avg(F.col("mb") - F.col("ma")).alias("diff"), F.count("*").alias("n_strata"))


def _seed(*parts: object) -> int:
    return zlib.crc32("|".join(map(str, parts)).encode())


def _bounded(rows: DataFrame, by: str) -> DataFrame:
    """The rows, if no group is too large to resample in one task; groups are counted before any is gathered."""
    if rows.groupBy(by).count().filter(F.col("count") > MOST_VALUES).head(1):
        raise ValueError(f"a group has more than {MOST_VALUES} values to resample")
    return rows


def _values(group: pd.DataFrame, column: str) -> np.ndarray:
    return np.sort(group[column].dropna().to_numpy(np.float64))


def _resampled(values: np.ndarray, times: int, rng: np.random.Generator) -> np.ndarray:
    """Means of resamples, a few at a time."""
    step = max(1, 4_000_000 // max(1, len(values)))
    return np.concatenate([values[rng.integers(0, len(values), (min(step, times - k), len(values)))].mean(axis=1) for k in range(0, times, step)])


def bootstrap_ci(rows: DataFrame, by: str, metric: str, stratum: str | None = None, times: int = 1000, level: float = 0.95) -> DataFrame:
    """(by, mean, low, high, n): percentile interval of the mean, or of the mean of stratum means; null bounds under three values."""

    def interval(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        rng = np.random.default_rng(_seed(*key))
        parts = [_values(g, metric) for _, g in group.groupby(stratum)] if stratum else [_values(group, metric)]
        parts = [p for p in parts if len(p)]
        n = sum(map(len, parts))
        mean = float(np.mean([p.mean() for p in parts])) if parts else None
        if n < 3:
            return pd.DataFrame([(key[0], mean, None, None, n)])
        means = np.mean([_resampled(p, times, rng) for p in parts], axis=0)
        low, high = np.percentile(means, [50 * (1 - level), 50 * (1 + level)])
        return pd.DataFrame([(key[0], mean, low, high, n)])

    kept = rows.select(F.col(by).cast("string").alias(by), F.col(metric).cast("double").alias(metric), *([stratum] if stratum else [])).filter(F.col(by).isNotNull())
    return _bounded(kept, by).groupBy(by).applyInPandas(interval, f"{by} string, mean double, low double, high double, n long")


def _p_value(observed: float, draws: np.ndarray) -> float:
    return float(min(1.0, 2 * np.mean(draws <= 0 if observed >= 0 else draws >= 0)))


_TEST = "diff double, low double, high double, p double, n_a long, n_b long"


def paired_bootstrap(pairs: DataFrame, by: str, a: str, b: str, times: int = 10_000, seed: int = 42) -> DataFrame:
    """(by, diff, low, high, p, n_a, n_b): mean of b less a over resampled pairs; two-sided p."""

    def test(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        d = np.sort((group[b] - group[a]).dropna().to_numpy(np.float64))
        means = _resampled(d, times, np.random.default_rng(seed))
        low, high = np.percentile(means, [2.5, 97.5])
        return pd.DataFrame([(key[0], d.mean(), low, high, _p_value(d.mean(), means), len(d), len(d))])

    kept = pairs.select(F.col(by).cast("string").alias(by), F.col(a).cast("double").alias(a), F.col(b).cast("double").alias(b)).dropna()
    return _bounded(kept, by).groupBy(by).applyInPandas(test, f"{by} string, {_TEST}")


def _blocked(rows: DataFrame, by: str, times: int) -> DataFrame:
    """The rows once for each block of their group's resamples, with columns ``block`` and ``blocks``."""
    blocks = F.least(F.lit(BLOCKS), F.greatest(F.lit(1), F.ceil(F.count("*") * times / BLOCK_DRAWS))).cast("int").alias("blocks")
    counts = rows.groupBy(by).agg(blocks)
    return rows.join(F.broadcast(counts), by).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))  # a row for each group


def _dealt(totals: np.ndarray, chunk: int, times: int, seed: list[int]) -> np.ndarray:
    """How many draws of each resample fall to one of the chunks that have so many values. Halves are told apart by a binomial number seeded by the half, so tasks agree without meeting."""
    low, high, many = 0, len(totals), np.full(times, totals.sum())
    while high - low > 1:
        mid = (low + high) // 2
        left = np.random.default_rng([*seed, low, high]).binomial(many, totals[low:mid].sum() / totals[low:high].sum())
        low, high, many = (low, mid, left) if chunk < mid else (mid, high, many - left)
    return many


def _sums(values: np.ndarray, counts: np.ndarray, many: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Sums of so many draws of values that come so often, for each resample."""
    sums, total, often = np.zeros(len(many)), counts.sum(), counts > OFTEN
    for value, n in zip(values[often], counts[often], strict=True):
        k = rng.binomial(many, n / total)
        sums[k > 0] += k[k > 0] * value  # an infinite value that is not drawn adds nothing
        many, total = many - k, total - n
    rest = np.repeat(values[~often], counts[~often])
    for at in range(0, len(rest), PIECE):
        piece = rest[at : at + PIECE]
        own = rng.binomial(many, len(piece) / (len(rest) - at))
        sums += [piece[rng.integers(0, len(piece), k)].sum() for k in own]
        many = many - own
    return sums


def _unpaired_in_chunks(kept: DataFrame, by: str, metric: str, keys: list[str], times: int, seed: int) -> DataFrame:
    """unpaired_bootstrap of the groups with these keys, whatever their size. Equal values are counted where they are; a chunk of a side's distinct values, of about BLOCK_DRAWS draws, is a task.
    A resample's draws are dealt to the chunks by multinomial numbers and drawn in each, which is a resample of all values."""
    spark = kept.sparkSession
    valued = kept.select(F.col(by).alias("g"), "own", F.col(metric).alias("value")).filter(F.col("g").isin(keys) & F.col("value").isNotNull() & ~F.isnan("value"))
    counted = stored(valued.groupBy("g", "own", "value").agg(F.count("*").alias("n")), new_folder(spark, "counts"))
    chunks = F.ceil(F.sum(F.least("n", F.lit(OFTEN))) * max(times, 1024) / BLOCK_DRAWS).alias("chunks")  # of 2^20 values at most
    dealt = counted.join(F.broadcast(counted.groupBy("g", "own").agg(chunks)), ["g", "own"]).withColumn("chunk", F.pmod(F.xxhash64("value"), "chunks"))  # a row for each side of a group
    totals: dict[tuple[str, bool], np.ndarray] = {}
    for r in dealt.groupBy("g", "own", "chunks", "chunk").agg(F.sum("n").alias("n")).collect():  # a row for each task to come
        totals.setdefault((r["g"], r["own"]), np.zeros(r["chunks"], np.int64))[r["chunk"]] = r["n"]
    sizes = {g: tuple(int(totals[g, own].sum()) if (g, own) in totals else 0 for own in (True, False)) for g in keys}

    def draw(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        g, own, chunk = str(key[0]), bool(key[1]), int(key[2])
        part, own_seed = part.sort_values("value"), [seed, _seed(g), int(own)]
        values, counts = part["value"].to_numpy(np.float64), part["n"].to_numpy(np.int64)
        sums = _sums(values, counts, _dealt(totals[g, own], chunk, times, own_seed), np.random.default_rng([*own_seed, chunk]))
        return pd.DataFrame({"g": g, "own": own, "draw": np.arange(-1, times), "s": np.append(values @ counts, sums)})  # first that of the values themselves

    def test(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        n_a, n_b = sizes[str(key[0])]
        x, y = (rows[rows["own"] == own].sort_values("draw")["s"].to_numpy() / n for own, n in ((True, n_a), (False, n_b)))
        diff, draws = y[0] - x[0], y[1:] - x[1:]
        low, high = np.percentile(draws, [2.5, 97.5])
        return pd.DataFrame([(key[0], diff, low, high, _p_value(diff, draws), n_a, n_b)])

    both = [g for g in keys if min(sizes[g]) > 0]
    tasks = 2 * max(1, sum(len(t) for (g, _), t in totals.items() if g in both))  # few chunks meet in one
    drawn = dealt.filter(F.col("g").isin(both)).repartition(tasks, "g", "own", "chunk").groupBy("g", "own", "chunk").applyInPandas(draw, "g string, own boolean, draw int, s double")
    added = F.aggregate(F.array_sort(F.collect_list("s")), F.lit(0.0), lambda a, s: a + s).alias("s")  # in one order, however they come
    tested = drawn.groupBy("g", "own", "draw").agg(added).groupBy("g").applyInPandas(test, f"`{by}` string, {_TEST}")
    return tested.union(spark.createDataFrame([(g, None, None, None, None, *sizes[g]) for g in keys if g not in both], tested.schema))


def unpaired_bootstrap(rows: DataFrame, by: str, metric: str, kind: str = "exp_type", first: str = "direct", times: int = 10_000, seed: int = 42) -> DataFrame:
    """As paired_bootstrap, for the rows of the first kind and the others, resampled each. The resamples of a large group are dealt into blocks, each a task that has all values and a
    seed of its own; a group of one block has the draws of the seed. Groups of over MOST_VALUES, or of more than BLOCKS blocks, are counted and drawn in chunks of their values."""

    def draw(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        block, blocks = int(key[1]), int(group["blocks"].iloc[0])
        x, y = _values(group[group["own"]], metric), _values(group[~group["own"]], metric)
        if not len(x) or not len(y):
            return pd.DataFrame([(key[0], None, len(x), len(y), [])])
        rng = np.random.default_rng(seed if blocks == 1 else [seed, block])
        many = times * (block + 1) // blocks - times * block // blocks
        return pd.DataFrame([(key[0], y.mean() - x.mean(), len(x), len(y), _resampled(y, many, rng) - _resampled(x, many, rng))])

    def test(key: tuple, parts: pd.DataFrame) -> pd.DataFrame:
        diff, n_a, n_b = parts["diff"].iloc[0], parts["n_a"].iloc[0], parts["n_b"].iloc[0]
        draws = np.concatenate([np.asarray(d, float) for d in parts["draws"]])
        if not len(draws):
            return pd.DataFrame([(key[0], None, None, None, None, n_a, n_b)])
        low, high = np.percentile(draws, [2.5, 97.5])
        return pd.DataFrame([(key[0], diff, low, high, _p_value(diff, draws), n_a, n_b)])

    own = F.coalesce(F.col(kind) == first, F.lit(False)).alias("own")
    kept = rows.select(F.col(by).cast("string").alias(by), own, F.col(metric).cast("double").alias(metric)).filter(F.col(by).isNotNull())
    large = [r[0] for r in kept.groupBy(by).agg(F.count("*").alias("n")).filter((F.col("n") > MOST_VALUES) | (F.col("n") * times > BLOCKS * BLOCK_DRAWS)).select(by).collect()]
    few = kept.filter(~F.col(by).isin(large)) if large else kept
    drawn = _blocked(few, by, times).groupBy(by, "block").applyInPandas(draw, f"{by} string, diff double, n_a long, n_b long, draws array<double>")
    tested = drawn.groupBy(by).applyInPandas(test, f"{by} string, {_TEST}")
    return tested.union(_unpaired_in_chunks(kept, by, metric, large, times, seed)) if large else tested


def ranking_stability(rows: DataFrame, by: str, metric: str, times: int = 200, seed: int = 42) -> DataFrame:
    """(by, usual_rank, share): the rank by mean that a level has most often over resamples of each level, and how often. A level's resampled means are one row."""

    def means(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        values = _values(group, metric)
        return pd.DataFrame({"level": key[0], "draw": np.arange(times), "m": _resampled(values, times, np.random.default_rng(_seed(seed, *key)))})

    kept = rows.select(F.col(by).cast("string").alias("level"), F.col(metric).cast("double").alias(metric)).dropna()
    drawn = _bounded(kept, "level").groupBy("level").applyInPandas(means, "level string, draw int, m double")
    ranks = drawn.withColumn("r", F.row_number().over(Window.partitionBy("draw").orderBy(F.desc("m"), "level")))
    counts = ranks.groupBy("level", "r").agg(F.count("*").alias("n"))
    return counts.groupBy("level").agg(F.max_by("r", F.struct("n", -F.col("r"))).alias("usual_rank"), (F.max("n") / times).alias("share")).withColumnRenamed("level", by)


def agreement_matrix(rows: DataFrame, metrics: list[str], by: str = "model", stratum: str = "dataset") -> DataFrame:
    """(by, metric, diff, d, stars): rag less direct for each comparison and metric, averaged over strata, starred by Holm-adjusted t tests."""
    from quillmark.functions.parse import stars

    long = rows.select(by, stratum, "exp_type", *metrics).unpivot([by, stratum, "exp_type"], metrics, "metric", "value")
    per = compare_types(long, "value", [by, "metric", stratum])
    means = per.groupBy(by, "metric").agg(F.avg("diff").alias("diff"), F.avg("d").alias("d"))
    tests = compare_types(long, "value", [by, "metric"]).select(by, "metric", F.concat_ws("|", by, "metric").alias("test"), t_test_p(F.col("t"), F.col("df").cast("double")).alias("p"))
    return means.join(holm(tests), [by, "metric"]).select(by, "metric", "diff", "d", stars(F.col("p_adjusted")).alias("stars"))


def feature_importance(rows: DataFrame, factors: list[str], metric: str, trees: int = 50, seed: int = 42) -> DataFrame:
    """(factor, importance): of a random forest over the indexed levels."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import StringIndexer, VectorAssembler
    from pyspark.ml.regression import RandomForestRegressor

    coded = [f"{f}_code" for f in factors]
    data = rows.select(*(F.coalesce(F.col(f).cast("string"), F.lit("none")).alias(f) for f in factors), F.col(metric).alias("label")).dropna()
    stages = [StringIndexer(inputCols=factors, outputCols=coded, stringOrderType="alphabetAsc"), VectorAssembler(inputCols=coded, outputCol="features"), RandomForestRegressor(numTrees=trees, seed=seed, maxBins=256)]
    weights = Pipeline(stages=stages).fit(data).stages[-1].featureImportances.toArray()
    return rows.sparkSession.createDataFrame([(f, float(w)) for f, w in zip(factors, weights, strict=True)], "factor string, importance double")
