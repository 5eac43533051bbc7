"""Comparison of experiment results: groups, pivots, summaries, RAG against direct, and what explains the differences.

Results are rows with factor columns (model, dataset, exp_type, ...) and a metric, nulls for missing values: NaN is to be made null on
ingest. As grouping keys nulls are left out unless an operator says otherwise. All is aggregates with map-side partials; joins are to tables of a row for
each group, which Spark broadcasts only while they are small.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark.operators.ranking import average_rank, best

DEAD_BAND = 0.01

#: Columns of a pivot at most.
MOST_COLUMNS = 10_000


def known(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows of which no key is null."""
    return reduce(lambda d, k: d.filter(F.col(k).isNotNull()), keys, rows)


def rag(rows: DataFrame) -> DataFrame:
    return rows.filter("exp_type = 'rag'")


def direct(rows: DataFrame) -> DataFrame:
    return rows.filter("exp_type = 'direct'")


def compare(rows: DataFrame, by: str, metric: str) -> DataFrame:
    """mean, min, max, std (sample, 0 for one row) and count of each group, best mean first; null groups are ``none``."""
    groups = rows.groupBy(F.coalesce(F.col(by).cast("string"), F.lit("none")).alias(by))
    return groups.agg(F.avg(metric).alias("mean"), F.min(metric).alias("min"), F.max(metric).alias("max"), F.coalesce(F.stddev_samp(metric), F.lit(0.0)).alias("std"), F.count(metric).alias("count")).orderBy(F.desc("mean"))


def pivot(rows: DataFrame, row: str, column: str, metric: str, agg: str = "mean") -> DataFrame:
    """A column for each value of ``column``, numbers in order before texts. Any agg but mean, max, min takes a group's first value by metric.
    More than MOST_COLUMNS values are an error."""
    values = [r[0] for r in rows.select(F.col(column).cast("string")).distinct().filter(F.col(column).isNotNull()).limit(MOST_COLUMNS + 1).collect()]
    if len(values) > MOST_COLUMNS:
        raise ValueError(f"{column} has more than {MOST_COLUMNS} values")
    values.sort(key=lambda v: (not v.replace(".", "", 1).isdigit(), float(v) if v.replace(".", "", 1).isdigit() else 0.0, v))
    f = {"mean": F.avg, "max": F.max, "min": F.min}.get(agg, F.min)
    return rows.withColumn(column, F.col(column).cast("string")).groupBy(row).pivot(column, values).agg(f(metric))


def summary(rows: DataFrame, metrics: list[str]) -> DataFrame:
    """One row: count, sorted distinct models and datasets, distinct retrievers of rag rows, for each metric its mean and the id of its best row,
    and total hours of ``duration``."""
    distinct = lambda c, where=None: F.sort_array(F.collect_set(F.col(c) if where is None else F.when(where, F.col(c))))
    best_id = lambda m: F.max_by("id", F.struct(F.col(m), -F.col("id")))
    columns = [F.count("*").alias("n"), distinct("model").alias("models"), distinct("dataset").alias("datasets"), distinct("retriever", F.col("exp_type") == "rag").alias("retrievers")]
    columns += [c for m in metrics for c in (F.avg(m).alias(f"avg_{m}"), best_id(m).alias(f"best_{m}"))]
    return rows.agg(*columns, (F.sum("duration") / 3600).alias("hours"))


def stratified_mean(rows: DataFrame, by: str, metric: str, strata: list[str]) -> DataFrame:
    """(by, mean, n_strata): the mean over strata of the means in them."""
    inner = known(rows, by, *strata).groupBy(by, *strata).agg(F.avg(metric).alias("m"))
    return inner.groupBy(by).agg(F.avg("m").alias("mean"), F.count("m").alias("n_strata"))


def marginal_means(rows: DataFrame, factor: str, metric: str, controls: tuple[str, ...] = ("model", "dataset")) -> DataFrame:
    """stratified_mean over the combinations of the controls, rows with a null left out."""
    return stratified_mean(known(rows, metric), factor, metric, list(controls))


def frequency_weighted_mean(rows: DataFrame, by: str, metric: str, weigh: str) -> DataFrame:
    """(by, mean): rows weighed by the inverse frequency of ``weigh`` in their group. Weights are normalised over all rows, before those without a metric drop out."""
    weight = 1.0 / F.count("*").over(Window.partitionBy(by, weigh))
    rows = known(rows, by, weigh).withColumn("w", weight)
    return rows.groupBy(by).agg((F.sum(F.col("w") * F.col(metric)) / F.sum("w")).alias("mean"))


def with_baseline(rows: DataFrame, metric: str, keys: tuple[str, ...] = ("model", "dataset")) -> DataFrame:
    """The rag rows with the mean of the direct rows of their keys, and benefit and benefit_pct over it; null without a baseline."""
    base = known(direct(rows), *keys).groupBy(*keys).agg(F.avg(metric).alias("baseline"))
    joined = rag(rows).join(base, list(keys), "left").withColumn("benefit", F.col(metric) - F.col("baseline"))
    return joined.withColumn("benefit_pct", F.try_divide("benefit", "baseline") * 100)


def benefit_distribution(rows: DataFrame, metric: str) -> DataFrame:
    """One row: how many rag rows help, hurt or do neither by more than 0.01, shares in percent, means and extremes."""
    up, down = F.coalesce(F.col("benefit") > DEAD_BAND, F.lit(False)), F.coalesce(F.col("benefit") < -DEAD_BAND, F.lit(False))
    return with_baseline(rows, metric).agg(
        F.count_if(up).alias("n_helps"), F.count_if(down).alias("n_hurts"), F.count_if(~up & ~down).alias("n_neutral"),
        (F.avg(up.cast("int")) * 100).alias("pct_helps"), (F.avg(down.cast("int")) * 100).alias("pct_hurts"),
        F.avg(F.when(up, F.col("benefit"))).alias("mean_help"), F.avg(F.when(down, F.col("benefit"))).alias("mean_hurt"),
        F.max("benefit").alias("best"), F.min("benefit").alias("worst"),
    )


def best_rag_against_direct(rows: DataFrame, metric: str, k: int = 5, keys: tuple[str, ...] = ("model", "dataset")) -> DataFrame:
    """(keys, direct_mean, top_mean, best, advantage, advantage_pct, n): the k best rag rows of each group against its direct mean; groups that have both."""
    ranked = best(known(rag(rows), *keys), list(keys), [F.desc_nulls_last(metric), F.asc("id")], k)
    tops = ranked.groupBy(*keys).agg(F.avg(metric).alias("top_mean"), F.max(metric).alias("best"))
    both = known(rows, *keys).groupBy(*keys).agg(F.avg(F.when(F.col("exp_type") == "direct", F.col(metric))).alias("direct_mean"), F.count_if(F.col("exp_type") == "rag").alias("n"))
    gain = F.col("top_mean") - F.col("direct_mean")
    return tops.join(both.filter("direct_mean is not null"), list(keys)).select(*keys, "direct_mean", "top_mean", "best", gain.alias("advantage"), F.when(F.col("direct_mean") > 0, gain / F.col("direct_mean") * 100).otherwise(0.0).alias("advantage_pct"), "n")


def success_factors(rows: DataFrame, metric: str, factors: list[str], stratum: str = "dataset") -> DataFrame:
    """(factor, level, pct_helps, mean_benefit, std_benefit, mean_benefit_pct): means over strata, three decimals."""
    based = with_baseline(rows, metric)
    helps = F.coalesce(F.col("benefit") > DEAD_BAND, F.lit(False)).cast("int")
    long = _long(based, factors, "factor", "level", stratum, helps.alias("helps"), "benefit", "benefit_pct")
    inner = known(long, "level", stratum).groupBy("factor", "level", stratum).agg(F.avg("helps").alias("h"), F.avg("benefit").alias("b"), F.stddev_samp("benefit").alias("s"), F.avg("benefit_pct").alias("p"))
    return inner.groupBy("factor", "level").agg(*(F.round(F.avg(c), 3).alias(n) for c, n in (("h", "pct_helps"), ("b", "mean_benefit"), ("s", "std_benefit"), ("p", "mean_benefit_pct"))))


def _long(rows: DataFrame, factors: list[str], name: str = "factor", value: str = "level", *keep: Column | str) -> DataFrame:
    """A row for each factor of each row, with its level as text."""
    return rows.select(*keep, F.explode(F.create_map(*(x for f in factors for x in (F.lit(f), F.col(f).cast("string"))))).alias(name, value))


def variance_explained(rows: DataFrame, metric: str, factors: list[str], stratum: str | None = "dataset") -> DataFrame:
    """(factor, explained): percent of the metric's sample variance that lies between a factor's levels (weighed by n/N), in each
    stratum, then the mean over strata. Strata under three rows or without variance, and factors with one level, are left out."""
    rows = rag(rows).withColumn("stratum", F.col(stratum) if stratum else F.lit("all")).withColumn("metric", F.col(metric))
    whole = known(rows, "stratum").groupBy("stratum").agg(F.var_samp("metric").alias("var"), F.avg("metric").alias("grand"), F.count("*").alias("total")).filter("var <> 0 and total >= 3")
    long = _long(rows, factors, "factor", "level", "stratum", "metric")
    means = known(long, "level", "stratum").groupBy("factor", "level", "stratum").agg(F.avg("metric").alias("m"), F.count("*").alias("n"))
    between = means.join(whole, "stratum").groupBy("factor", "stratum").agg(F.count("*").alias("levels"), (F.sum(F.pow(F.col("m") - F.col("grand"), 2) * F.col("n") / F.col("total")) / F.first("var") * 100).alias("share"))
    return between.filter("levels > 1").groupBy("factor").agg(F.avg("share").alias("explained"))


def variance_explained_by_metric(rows: DataFrame, metrics: list[str], factors: list[str], stratum: str | None = "dataset") -> DataFrame:
    """(metric, factor, explained)."""
    return reduce(DataFrame.unionByName, (variance_explained(rows, m, factors, stratum).withColumn("metric", F.lit(m)) for m in metrics))


def interaction(rows: DataFrame, a: str, b: str, metric: str, stratum: str = "dataset") -> DataFrame:
    """(a, b, mean, std, count): means over strata of cell means and standard deviations; counts added."""
    cells = known(rag(rows), a, b, stratum).groupBy(a, b, stratum).agg(F.avg(metric).alias("m"), F.stddev_samp(metric).alias("s"), F.count(metric).alias("n"))
    return cells.groupBy(a, b).agg(F.avg("m").alias("mean"), F.avg("s").alias("std"), F.sum("n").alias("count"))


def synergy(rows: DataFrame, a: str, b: str, metric: str, stratum: str = "dataset") -> DataFrame:
    """(a, b, actual, expected, effect, synergy): cell means against the sum of main effects in each stratum of three rows at least, averaged.
    One pass over the rows by grouping sets."""
    sets = known(rag(rows), a, b, stratum).groupingSets([[stratum, a, b], [stratum, a], [stratum, b], [stratum]], stratum, a, b)
    means = sets.agg(F.avg(metric).alias("m"), F.count("*").alias("n"), F.grouping(a).alias("ga"), F.grouping(b).alias("gb"))
    part = lambda ga, gb: means.filter((F.col("ga") == ga) & (F.col("gb") == gb))
    cell = part(0, 0).select(stratum, a, b, F.col("m").alias("actual"))
    of_a, of_b = part(0, 1).select(stratum, a, F.col("m").alias("ma")), part(1, 0).select(stratum, b, F.col("m").alias("mb"))
    grand = part(1, 1).filter("n >= 3").select(stratum, F.col("m").alias("g"))
    both = cell.join(of_a, [stratum, a]).join(of_b, [stratum, b]).join(grand, stratum).withColumn("expected", F.col("ma") + F.col("mb") - F.col("g"))
    out = both.groupBy(a, b).agg(F.avg("actual").alias("actual"), F.avg("expected").alias("expected"), F.avg(F.col("actual") - F.col("expected")).alias("effect"))
    return out.withColumn("synergy", F.when(F.col("effect") > DEAD_BAND, "Synergistic").when(F.col("effect") < -DEAD_BAND, "Redundant").otherwise("Neutral"))


def sign_stability(rows: DataFrame, a: str, b: str, metric: str, stratum: str = "dataset") -> DataFrame:
    """(a, b, n_strata, spread, stable): whether a cell's interaction effect has one sign over strata, and its range."""
    sets = known(rag(rows), a, b, stratum)
    mean = lambda *keys: F.avg(metric).over(Window.partitionBy(*keys))
    cells = sets.select(stratum, a, b, (mean(stratum, a, b) - mean(stratum, a) - mean(stratum, b) + mean(stratum)).alias("e")).groupBy(stratum, a, b).agg(F.first("e").alias("e"))
    return cells.groupBy(a, b).agg(F.count("*").alias("n_strata"), (F.max("e") - F.min("e")).alias("spread"), ((F.min("e") > 0) | (F.max("e") < 0)).alias("stable"))


def question_difficulty(scores: DataFrame, metric: str, threshold: float = 0.5, keys: tuple[str, ...] = ("idx", "dataset")) -> DataFrame:
    """(keys, mean_score, std_score, pct_correct, n, difficulty) of each question: easy from 0.8 correct, hard up to 0.2."""
    right = (F.col(metric) >= threshold).cast("int")
    out = known(scores, metric, *keys).groupBy(*keys).agg(F.avg(metric).alias("mean_score"), F.stddev_samp(metric).alias("std_score"), F.avg(right).alias("pct_correct"), F.count("*").alias("n"))
    return out.withColumn("difficulty", F.when(F.col("pct_correct") >= 0.8, "easy").when(F.col("pct_correct") <= 0.2, "hard").otherwise("discriminating"))


def question_delta(scores: DataFrame, metric: str, keys: tuple[str, ...] = ("idx", "model", "dataset")) -> DataFrame:
    """The rows that are not direct with the direct mean of their question, and the difference; questions that have both."""
    base = known(direct(scores), *keys).groupBy(*keys).agg(F.avg(metric).alias("direct_mean"))
    return scores.filter("exp_type <> 'direct'").join(base, list(keys)).withColumn("delta", F.col(metric) - F.col("direct_mean"))


def help_rates(deltas: DataFrame, key: str = "idx", consistent: float = 0.8) -> DataFrame:
    """(key, n, helps, hurts, mean_delta, label): shares of a question's rows that help or hurt by over 0.01."""
    up, down = (F.col("delta") > DEAD_BAND).cast("int"), (F.col("delta") < -DEAD_BAND).cast("int")
    out = deltas.groupBy(key).agg(F.count("*").alias("n"), F.avg(up).alias("helps"), F.avg(down).alias("hurts"), F.avg("delta").alias("mean_delta"))
    return out.withColumn("label", F.when(F.col("helps") > consistent, "helped").when(F.col("hurts") > consistent, "hurt").otherwise("mixed"))


def delta_summary(deltas: DataFrame, by: str) -> DataFrame:
    return deltas.groupBy(by).agg(F.avg("delta").alias("mean"), F.max("delta").alias("best"), F.min("delta").alias("worst"), F.min_by("delta", "id").alias("first"), F.count("*").alias("n"))


def deduplicate(rows: DataFrame, keys: list[str], metric: str) -> DataFrame:
    """The best row by metric of each combination of keys, nulls being equal; a null metric counts -1, ties go to the smaller id."""
    return best(rows, keys, [F.desc(F.coalesce(metric, F.lit(-1.0))), F.asc("id")], 1).drop("rank")


def health_counts(states: DataFrame) -> DataFrame:
    """One row over (phase): totals of complete, failed, in progress and without state; other phases count in the total alone."""
    return states.agg(F.count("*").alias("total"), F.count_if(F.expr("phase = 'complete'")).alias("complete"), F.count_if(F.expr("phase = 'failed'")).alias("failed"), F.count_if(F.expr("phase in ('generating', 'computing_metrics')")).alias("in_progress"), F.count_if(F.expr("phase is null")).alias("no_state"))


def value_counts(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value, n) of each column's values that are not null."""
    return known(_long(rows, columns, "column", "value"), "value").groupBy("column", "value").agg(F.count("*").alias("n"))


def crosstab(rows: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b, n, share): counts and their share of a's rows."""
    counts = known(rows, a, b).groupBy(a, b).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(a)))


def top_sensitivity(rows: DataFrame, by: str, metric: str, stratum: str = "dataset") -> DataFrame:
    """(by, mean, low, high, n): stratified mean with a normal interval of its values."""
    flat = known(rows, by, stratum, metric).groupBy(by).agg(F.stddev_samp(metric).alias("sd"), F.count("*").alias("n"))
    half = F.lit(1.96) * F.col("sd") / F.sqrt("n")
    return stratified_mean(rows, by, metric, [stratum]).join(flat, by).select(by, "mean", (F.col("mean") - half).alias("low"), (F.col("mean") + half).alias("high"), "n")


def leaderboard(rows: DataFrame, by: str, metrics: list[str]) -> DataFrame:
    """(by, mean, std and count of each metric, avg_rank): ranks of the means, best first, ties averaged, over the metrics."""
    groups = known(rows, by).groupBy(by).agg(*(c for m in metrics for c in (F.avg(m).alias(f"{m}_mean"), F.stddev_samp(m).alias(f"{m}_std"), F.count(m).alias(f"{m}_count"))))
    ranks = [average_rank(-F.col(f"{m}_mean"), [F.lit(1)]) for m in metrics]
    return groups.withColumn("avg_rank", reduce(Column.__add__, ranks) / len(ranks))


def model_sensitivity(rows: DataFrame, metric: str, factor: str = "prompt") -> DataFrame:
    """(model, rag_effect, factor_range, best_level, std): means of rag less direct; range and best of the factor's means."""
    levels = known(rows, "model", factor).groupBy("model", factor).agg(F.avg(metric).alias("m"))
    ranges = levels.groupBy("model").agg((F.max("m") - F.min("m")).alias("factor_range"), F.max_by(factor, "m").alias("best_level"))
    means = known(rows, "model").groupBy("model").agg((F.avg(F.when(F.col("exp_type") == "rag", F.col(metric))) - F.avg(F.when(F.col("exp_type") == "direct", F.col(metric)))).alias("rag_effect"), F.stddev_samp(metric).alias("std"))
    return means.join(ranges, "model")


def potential(rows: DataFrame, factors: list[str], metric: str) -> DataFrame:
    """(factor, best_level, best_mean, gain, range): what the best level of a factor has over the mean of all."""
    long = _long(rows, factors, "factor", "level", F.col(metric).alias("metric"))
    means = known(long, "level").groupBy("factor", "level").agg(F.avg("metric").alias("m"))
    overall = rows.agg(F.avg(metric).alias("grand"))
    out = means.groupBy("factor").agg(F.max_by("level", "m").alias("best_level"), F.max("m").alias("best_mean"), (F.max("m") - F.min("m")).alias("range"))
    return out.crossJoin(F.broadcast(overall)).select("factor", "best_level", "best_mean", (F.col("best_mean") - F.col("grand")).alias("gain"), "range")  # overall is one row


def priorities(rows: DataFrame, factors: list[str], metric: str) -> DataFrame:
    """(factor, explained, gain, priority): what to try next, by variance explained and potential gain."""
    both = variance_explained(rows, metric, factors).join(potential(rag(rows), factors, metric), "factor")
    label = F.when((F.col("explained") > 10) & (F.col("gain") > 0.02), "high").when((F.col("explained") > 5) | (F.col("gain") > 0.01), "medium").otherwise("low")
    return both.select("factor", "explained", "gain", label.alias("priority"))


def beats_direct(rows: DataFrame, metric: str) -> DataFrame:
    """(model, n, pct_better): share of each model's rag rows over their baseline."""
    based = with_baseline(rows, metric).filter("baseline is not null")
    return based.groupBy("model").agg(F.count("*").alias("n"), (F.avg((F.col("benefit") > 0).cast("int")) * 100).alias("pct_better"))


def tiers(rows: DataFrame, metric: str, k: int = 5) -> DataFrame:
    """(model, dataset, best_direct, best_rag, top_mean, rag_wins)."""
    pairs = known(rows, "model", "dataset").groupBy("model", "dataset").agg(F.max(F.when(F.col("exp_type") == "direct", F.col(metric))).alias("best_direct"), F.max(F.when(F.col("exp_type") == "rag", F.col(metric))).alias("best_rag"))
    tops = best(known(rag(rows), "model", "dataset"), ["model", "dataset"], [F.desc_nulls_last(metric), F.asc("id")], k).groupBy("model", "dataset").agg(F.avg(metric).alias("top_mean"))
    return pairs.join(tops, ["model", "dataset"]).withColumn("rag_wins", F.col("best_rag") > F.col("best_direct"))


def coverage(rows: DataFrame, factors: list[str], first: int = 20) -> tuple[DataFrame, DataFrame]:
    """One row (theoretical, actual) and the first missing combinations, in order. The product of the factors' distinct values is what is asked for."""
    distinct = [known(rows, f).select(f).distinct() for f in factors]
    product = reduce(DataFrame.crossJoin, distinct)
    have = known(rows, *factors).select(*factors).distinct()
    counts = product.agg(F.count("*").alias("theoretical")).crossJoin(have.agg(F.count("*").alias("actual")))
    return counts, product.join(have, factors, "left_anti").orderBy(*factors).limit(first)


def cardinality(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(dimension, n, values): distinct values of each column, sorted."""
    long = _long(rows, columns, "dimension", "value")
    return known(long, "value").groupBy("dimension").agg(F.countDistinct("value").alias("n"), F.array_join(F.sort_array(F.collect_set("value")), ",").alias("values"))


def recipe(rows: DataFrame, factors: list[str], metric: str, share: int = 10) -> DataFrame:
    """(factor, level, agree): the mode of each dataset's top tenth, and how many datasets have the most common of those (ties to the smaller level)."""
    sized = known(rag(rows), "dataset").withColumn("most", F.greatest(F.lit(1), F.floor(F.count("*").over(Window.partitionBy("dataset")) / share)))
    tops = best(sized, ["dataset"], [F.desc_nulls_last(metric), F.asc("id")], 1 << 62).filter(F.col("rank") <= F.col("most"))
    long = _long(tops, factors, "factor", "level", "dataset")
    counts = known(long, "level").groupBy("dataset", "factor", "level").agg(F.count("*").alias("n"))
    modes = best(counts, ["dataset", "factor"], [F.desc("n"), F.asc("level")], 1)
    return best(modes.groupBy("factor", "level").agg(F.count("*").alias("agree")), ["factor"], [F.desc("agree"), F.asc("level")], 1).drop("rank")


def config_pairs(rows: DataFrame, keys: list[str], metric: str) -> DataFrame:
    """(a, b, keys, ma, mb): means of the configurations that two datasets share."""
    means = known(rows, "dataset").groupBy("dataset", *keys).agg(F.avg(metric).alias("m"))
    a, b = means.select(F.col("dataset").alias("a"), *keys, F.col("m").alias("ma")), means.select(F.col("dataset").alias("b"), *keys, F.col("m").alias("mb"))
    return a.join(b, keys).filter("a < b")


def in_all_datasets(rows: DataFrame, keys: list[str], metric: str) -> DataFrame:
    """(keys, n, mean, spread): configurations that every dataset has."""
    means = known(rows, "dataset").groupBy("dataset", *keys).agg(F.avg(metric).alias("m"))
    total = known(rows, "dataset").agg(F.countDistinct("dataset").alias("total"))
    return means.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("m").alias("mean"), (F.max("m") - F.min("m")).alias("spread")).crossJoin(F.broadcast(total)).filter("n = total").drop("total")  # total is one row


def interesting_questions(scores: DataFrame, metric: str, least: int = 5) -> DataFrame:
    """(idx, n, sd, gap, kind): questions of ``least`` rows that are controversial (population deviation over 0.3), or helped or hurt by rag by over 0.2."""
    gap = F.avg(F.when(F.col("exp_type") == "rag", F.col(metric))) - F.avg(F.when(F.col("exp_type") == "direct", F.col(metric)))
    out = scores.groupBy("idx").agg(F.count(metric).alias("n"), F.stddev_pop(metric).alias("sd"), gap.alias("gap")).filter(F.col("n") >= least)
    kind = F.when(F.col("gap") > 0.2, "helps").when(F.col("gap") < -0.2, "hurts").when(F.col("sd") > 0.3, "controversial")
    return out.withColumn("kind", kind).filter("kind is not null")


def hardest(scores: DataFrame, metric: str, n: int = 20, least: int = 5) -> DataFrame:
    out = scores.groupBy("idx").agg(F.count(metric).alias("n"), F.round(F.avg(metric), 9).alias("mean")).filter(F.col("n") >= least)
    return out.orderBy("mean", "idx").limit(n)


def histogram(rows: DataFrame, value: str, low: float, high: float, bins: int) -> DataFrame:
    """(bin, n) of equal bins over [low, high], the last one closed; values outside are left out."""
    inside = rows.filter((F.col(value) >= low) & (F.col(value) <= high))
    return inside.groupBy(F.least(F.floor((F.col(value) - low) / ((high - low) / bins)), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count("*").alias("n"))


def buckets(value: Column, cuts: list[float], labels: list[str]) -> Column:
    """The label of the interval (cut, next cut] that holds the value; null outside."""
    out = F.lit(None).cast("string")
    for low, high, label in zip(cuts, cuts[1:], labels, strict=False):
        out = F.when((value > low) & (value <= high), label).otherwise(out)
    return out


def length_stats(rows: DataFrame, by: str, value: str, clip: float) -> DataFrame:
    """(by, mean, median, std, q99, clipped): of lengths; the last is the mean of those cut at clip."""
    return rows.groupBy(by).agg(F.avg(value).alias("mean"), F.median(value).alias("median"), F.stddev_samp(value).alias("std"), F.percentile(value, 0.99).alias("q99"), F.avg(F.least(F.col(value).cast("double"), F.lit(clip))).alias("clipped"))
