"""Queries of statistics: ranks, windows over trials, effect sizes, correlations, resampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmark.operators import statistics as st
from quillmark.queries.bindings import RESULTS, SCORES, Query, results, rounded, scores, sql

CONFIG = ["model", "retriever"]


def _results(f) -> Query:
    return lambda spark, d: rounded(f(results(spark, d)))


def _scores(f) -> Query:
    return lambda spark, d: rounded(f(scores(spark, d)))


def _trials(f) -> Query:
    return lambda spark, d: rounded(f(scores(spark, d).select(F.col("id").alias("number"), "model", F.col("f1").alias("value"))))


def _p_values(spark, d):
    rows = st.compare_types(results(spark, d), "f1", ["model"])
    tests = rows.select(F.col("model").alias("test"), st.t_test_p(F.col("t"), F.col("df").cast("double")).alias("p"))
    return rounded(st.holm(tests), 6)


def _anova_p(spark, d):
    rows = st.anova(results(spark, d), "model", "f1")
    return rounded(rows.select("f", "df1", "df2", st.f_test_p(F.col("f"), F.col("df1"), F.col("df2")).alias("p")), 6)


def _holm_ranks(spark, d):
    return rounded(st.holm(scores(spark, d).groupBy(F.col("idx").cast("string").alias("test")).agg((F.avg("f1") / 50).alias("p"))))


_TRIALS = f"{SCORES}, trials AS (SELECT id AS number, model, f1 AS value FROM scores)"
_SPREAD = """SELECT {by}, avg(f1) FILTER (exp_type = 'rag') AS m1, var_samp(f1) FILTER (exp_type = 'rag') AS v1, count(f1) FILTER (exp_type = 'rag') AS n1,
  avg(f1) FILTER (exp_type = 'direct') AS m2, var_samp(f1) FILTER (exp_type = 'direct') AS v2, count(f1) FILTER (exp_type = 'direct') AS n2 FROM {source} GROUP BY {by}"""
_COMPARED = """c AS (SELECT *, (m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)) AS d, (m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2) * (1.0::DOUBLE / n1 + 1.0::DOUBLE / n2)) AS t FROM g WHERE n1 >= 2 AND n2 >= 2)
SELECT {by}, m2 AS direct_mean, m1 AS rag_mean, m1 - m2 AS diff, d, CASE WHEN abs(d) < 0.2 THEN 'negligible' WHEN abs(d) < 0.5 THEN 'small' WHEN abs(d) < 0.8 THEN 'medium' ELSE 'large' END AS effect, t, n1 + n2 - 2 AS df FROM c"""
_RANK = "rank() OVER ({p} ORDER BY {x}) + (count(*) OVER (PARTITION BY {k}{x}) - 1) / 2"


def _rank(x: str, by: str = "") -> str:
    return _RANK.format(p=f"PARTITION BY {by}" if by else "", x=x, k=f"{by}, " if by else "")


# Two-sided chance of |t| by the finite series for whole degrees of freedom, summed from its innermost term: in angle a with tan a = t / sqrt(df), even and odd df.
_SERIES = "list_reduce(list_prepend(1.0::DOUBLE, list_transform(range({last}, 0, -1), lambda j: ({above})::DOUBLE / ({below}) * df / (df + t * t))), lambda s, f: 1 + f * s)"
_EVEN, _ODD = _SERIES.format(last="(df - 2) // 2", above="2 * j - 1", below="2 * j"), _SERIES.format(last="(df - 3) // 2", above="2 * j", below="2 * j + 1")
_T_P = f"1 - CASE WHEN df % 2 = 0 THEN sin(atan(abs(t) / sqrt(df))) * {_EVEN} ELSE 2 / pi() * (atan(abs(t) / sqrt(df)) + CASE WHEN df > 1 THEN sin(atan(abs(t) / sqrt(df))) * cos(atan(abs(t) / sqrt(df))) * {_ODD} ELSE 0 END) END"
_LONG = "l AS (SELECT model, dataset, exp_type, 'f1' AS metric, f1 FROM results UNION ALL SELECT model, dataset, exp_type, 'em', em FROM results)"

QUERIES: dict[str, tuple[Query, str | None]] = {
    "zscore": (
        _results(lambda r: st.normalize(r, "f1").select("id", "metric_norm")),
        sql(f"WITH {RESULTS} SELECT id, (f1 - avg(f1) OVER (PARTITION BY dataset)) / stddev_samp(f1) OVER (PARTITION BY dataset) AS metric_norm FROM results", "metric_norm"),
    ),
    "minmax": (
        _results(lambda r: st.normalize(r, "f1", how="minmax").select("id", "metric_norm")),
        sql(f"WITH {RESULTS} SELECT id, (f1 - min(f1) OVER (PARTITION BY dataset)) / (max(f1) OVER (PARTITION BY dataset) - min(f1) OVER (PARTITION BY dataset)) AS metric_norm FROM results", "metric_norm"),
    ),
    "running_best": (
        _trials(lambda t: st.running_best(t, by=["model"]).select("number", "model", "running_best", "place")),
        sql(f"WITH {_TRIALS} SELECT number, model, max(value) OVER (PARTITION BY model ORDER BY number ROWS UNBOUNDED PRECEDING) AS running_best, CAST(row_number() OVER (PARTITION BY model ORDER BY number) - 1 AS INTEGER) AS place FROM trials", "running_best"),
    ),
    "running_best_all": (
        _trials(lambda t: st.running_best(t).select("number", "running_best")),
        sql(f"WITH {_TRIALS} SELECT number, max(value) OVER (ORDER BY number ROWS UNBOUNDED PRECEDING) AS running_best FROM trials", "running_best"),
    ),
    "rolling_mean": (
        lambda spark, d: rounded(st.rolling_mean(scores(spark, d).select(F.col("id").alias("number"), "model", F.col("f1").alias("value")), by=["model"]).select("number", "model", "rolling_mean"), 7),
        sql(f"WITH {_TRIALS} SELECT number, model, CASE WHEN count(value) OVER w >= 5 THEN avg(value) OVER w END AS rolling_mean FROM trials WINDOW w AS (PARTITION BY model ORDER BY number ROWS 19 PRECEDING)", "rolling_mean", digits=7),
    ),
    "percentile_rank": (
        _scores(lambda s: st.percentile_rank(s, "f1", ["dataset"]).select("id", "dataset", "pct")),
        sql(f"WITH {SCORES} SELECT id, dataset, ({_rank('f1', 'dataset')}) / count(*) OVER (PARTITION BY dataset) AS pct FROM scores", "pct"),
    ),
    "holm": (
        _holm_ranks,
        sql(f"WITH {SCORES}, t AS (SELECT CAST(idx AS VARCHAR) AS test, avg(f1) / 50 AS p FROM scores GROUP BY idx) SELECT test, p, least(p * (count(*) OVER () - row_number() OVER (ORDER BY p, test) + 1), 1.0) AS p_adjusted FROM t", "p", "p_adjusted"),
    ),
    "cohens_d": (
        _results(lambda r: st.compare_types(r, "f1", ["model", "dataset"])),
        sql(f"WITH {RESULTS}, g AS ({_SPREAD.format(by='model, dataset', source='results')}), {_COMPARED.format(by='model, dataset')}", "direct_mean", "rag_mean", "diff", "d", "t"),
    ),
    "metric_comparison": (
        _results(lambda r: st.metric_comparison(r, ["f1", "em"])),
        sql(f"WITH {RESULTS}, l AS (SELECT exp_type, 'f1' AS metric, f1 FROM results UNION ALL SELECT exp_type, 'em', em FROM results), g AS ({_SPREAD.format(by='metric', source='l')}), {_COMPARED.format(by='metric')}", "direct_mean", "rag_mean", "diff", "d", "t"),
    ),
    "anova_f": (
        lambda spark, d: rounded(st.anova(results(spark, d), "model", "f1"), 6),
        sql(f"WITH {RESULTS}, g AS (SELECT model, avg(f1) AS m, var_samp(f1) AS v, count(*) AS n FROM results GROUP BY model), s AS (SELECT sum(n * m) AS nm, sum(n) AS n, sum(n * m * m) AS nmm, sum((n - 1) * v) AS w, count(*) AS k FROM g) SELECT (nmm - nm * nm / n) / (k - 1) / (w / (n - k)) AS f, k - 1 AS df1, CAST(n - k AS BIGINT) AS df2 FROM s", "f", digits=6),
    ),
    "mann_whitney": (
        _results(lambda r: st.mann_whitney(r, "f1", ["dataset"])),
        sql(
            f"""WITH {RESULTS}, k AS (SELECT dataset, exp_type, {_rank('f1', 'dataset')} AS r, pow(count(*) OVER (PARTITION BY dataset, f1), 2) - 1 AS tie FROM results), s AS (SELECT dataset, sum(r) FILTER (exp_type = 'rag') AS r1, count(*) FILTER (exp_type = 'rag') AS n1, count(*) FILTER (exp_type <> 'rag') AS n2, sum(tie) AS ties FROM k GROUP BY dataset)
            SELECT dataset, r1 - n1 * (n1 + 1) / 2 AS u, n1, n2, (r1 - n1 * (n1 + 1) / 2 - n1 * n2 / 2) / sqrt(n1 * n2 / 12 * ((n1 + n2 + 1) - ties / ((n1 + n2) * (n1 + n2 - 1.0::DOUBLE)))) AS z FROM s""",
            "u", "z",
        ),
    ),
    "spearman_matrix": (
        _results(lambda r: st.spearman_matrix(r, ["f1", "em", "duration"])),
        sql(f"WITH {RESULTS}, k AS (SELECT {_rank('f1')} AS f1, {_rank('em')} AS em, {_rank('duration')} AS duration FROM results) SELECT 'f1' AS a, 'em' AS b, corr(f1, em) AS rho FROM k UNION ALL SELECT 'f1', 'duration', corr(f1, duration) FROM k UNION ALL SELECT 'em', 'duration', corr(em, duration) FROM k", "rho"),
    ),
    "spearman_pairwise": (
        _results(lambda r: st.spearman_pairwise(r.groupBy("prompt", "retriever", "model").agg(F.round(F.avg("f1"), 9).alias("f1")).select(F.concat_ws("-", "prompt", "retriever").alias("item"), "model", "f1"), "item", "model", "f1")),
        sql(
            f"""WITH {RESULTS}, l AS (SELECT prompt || '-' || retriever AS item, model, round(avg(f1), 9) AS f1 FROM results GROUP BY ALL), p AS (SELECT x.model AS a, y.model AS b, x.f1 AS x, y.f1 AS y FROM l x JOIN l y USING (item) WHERE x.model < y.model), k AS (SELECT a, b, {_rank('x', 'a, b')} AS x, {_rank('y', 'a, b')} AS y FROM p)
            SELECT a, b, count(*) AS n, corr(x, y) AS rho FROM k GROUP BY ALL HAVING count(*) >= 3""",
            "rho",
        ),
    ),
    "correlation": (
        _results(lambda r: st.correlation(r, ["model"], "f1", "em")),
        sql(f"WITH {RESULTS}, k AS (SELECT model, f1, em, {_rank('f1', 'model')} AS x, {_rank('em', 'model')} AS y FROM results) SELECT model, count(*) AS n, corr(f1, em) AS pearson, corr(x, y) AS spearman FROM k GROUP BY model HAVING count(*) >= 5", "pearson", "spearman"),
    ),
    "regression": (
        _results(lambda r: st.regression(r, ["model"], F.col("em"), F.col("f1"))),
        sql(f"WITH {RESULTS} SELECT model, regr_slope(f1, em) AS slope, regr_intercept(f1, em) AS intercept, regr_r2(f1, em) AS r2, CAST(regr_count(f1, em) AS BIGINT) AS n FROM results GROUP BY model", "slope", "intercept", "r2"),
    ),
    "regression_log": (
        _results(lambda r: st.regression(r, ["dataset"], F.log(F.col("duration") + 1), F.col("f1"))),
        sql(f"WITH {RESULTS} SELECT dataset, regr_slope(f1, ln(duration + 1)) AS slope, regr_intercept(f1, ln(duration + 1)) AS intercept, regr_r2(f1, ln(duration + 1)) AS r2, CAST(regr_count(f1, em) AS BIGINT) AS n FROM results GROUP BY dataset", "slope", "intercept", "r2"),
    ),
    "power_analysis": (
        _results(lambda r: st.power(r, "model", "f1")),
        sql(f"WITH {RESULTS} SELECT model, count(f1) AS n, stddev_samp(f1) AS sd, 2.8::DOUBLE * stddev_samp(f1) * sqrt(2.0::DOUBLE / count(f1)) AS detectable FROM results GROUP BY model", "sd", "detectable"),
    ),
    "controlled_effect": (
        _results(lambda r: st.controlled_effect(r, "prompt", "f1", ["model", "dataset"])),
        sql(
            f"""WITH {RESULTS}, m AS (SELECT prompt AS level, avg(m) AS mean FROM (SELECT prompt, model, dataset, avg(f1) AS m FROM results GROUP BY ALL) GROUP BY prompt), b AS (SELECT prompt AS level FROM results GROUP BY prompt ORDER BY count(*) DESC, prompt LIMIT 1)
            SELECT level, mean, mean - (SELECT mean FROM m JOIN b USING (level)) AS effect FROM m""",
            "mean", "effect",
        ),
    ),
    "config_agreement": (
        _results(lambda r: st.config_agreement(r, CONFIG, "f1")),
        sql(
            f"""WITH {RESULTS}, m AS (SELECT dataset, model, retriever, round(avg(f1), 9) AS m FROM results GROUP BY ALL), p AS (SELECT x.dataset AS a, y.dataset AS b, x.m AS x, y.m AS y FROM m x JOIN m y USING (model, retriever) WHERE x.dataset < y.dataset), k AS (SELECT a, b, {_rank('x', 'a, b')} AS x, {_rank('y', 'a, b')} AS y FROM p)
            SELECT a, b, count(*) AS n, corr(x, y) AS rho FROM k GROUP BY ALL HAVING count(*) >= 5""",
            "rho",
        ),
    ),
    "universal_configs": (
        _results(lambda r: st.universal_configs(r, CONFIG, "f1")),
        sql(
            f"""WITH {RESULTS}, m AS (SELECT dataset, model, retriever, round(avg(f1), 9) AS m FROM results GROUP BY ALL), k AS (SELECT *, ({_rank('m', 'dataset')}) / count(*) OVER (PARTITION BY dataset) AS pct FROM m)
            SELECT model, retriever, min(pct) AS min_pct, max(pct) - min(pct) AS spread FROM k GROUP BY ALL HAVING count(*) = (SELECT count(DISTINCT dataset) FROM results)""",
            "min_pct", "spread",
        ),
    ),
    "level_pairs": (
        _results(lambda r: st.level_pairs(r, "retriever", "f1")),
        sql(f"WITH {RESULTS}, m AS (SELECT dataset, retriever, avg(f1) AS m FROM results GROUP BY ALL) SELECT x.retriever AS a, y.retriever AS b, avg(y.m - x.m) AS diff, count(*) AS n_strata FROM m x JOIN m y USING (dataset) WHERE x.retriever < y.retriever GROUP BY ALL", "diff"),
    ),
    "t_test_p": (
        _p_values,
        sql(f"WITH {RESULTS}, g AS ({_SPREAD.format(by='model', source='results')}), x AS ({_COMPARED.format(by='model').replace('c AS (', 'SELECT * FROM (WITH c AS (', 1)})), p AS (SELECT model AS test, {_T_P} AS p FROM x) SELECT test, p, least(p * (count(*) OVER () - row_number() OVER (ORDER BY p, test) + 1), 1.0) AS p_adjusted FROM p", "p", "p_adjusted", digits=6),
    ),
    "anova_p": (
        _anova_p,
        sql(
            f"""WITH {RESULTS}, g AS (SELECT model, avg(f1) AS m, var_samp(f1) AS v, count(*) AS n FROM results GROUP BY model), s AS (SELECT sum(n * m) AS nm, sum(n) AS n, sum(n * m * m) AS nmm, sum((n - 1) * v) AS w, count(*) AS k FROM g),
            a AS (SELECT (nmm - nm * nm / n) / (k - 1) / (w / (n - k)) AS f, k - 1 AS df1, CAST(n - k AS BIGINT) AS df2 FROM s), x AS (SELECT *, df2 / (df2 + df1 * f) AS x FROM a)
            SELECT f, df1, df2, pow(x, df2 / 2.0::DOUBLE) * (1 + df2 / 2.0::DOUBLE * (1 - x)) AS p FROM x WHERE df1 = 4""",
            "f", "p", digits=6,
        ),
    ),
    "agreement_matrix": (
        _results(lambda r: st.agreement_matrix(r, ["f1", "em"])),
        sql(
            f"""WITH {RESULTS}, {_LONG}, g AS ({_SPREAD.format(by='model, metric, dataset', source='l')}), y AS ({_COMPARED.format(by='model, metric, dataset').replace('c AS (', 'SELECT * FROM (WITH c AS (', 1)})),
            g2 AS ({_SPREAD.format(by='model, metric', source='l')}), x AS ({_COMPARED.format(by='model, metric').replace('c AS (', 'SELECT * FROM (WITH c AS (', 1).replace('FROM g WHERE', 'FROM g2 WHERE')})),
            p AS (SELECT model, metric, {_T_P} AS p FROM x), h AS (SELECT model, metric, least(p * (count(*) OVER () - row_number() OVER (ORDER BY p, model || '|' || metric) + 1), 1.0) AS q FROM p)
            SELECT model, metric, avg(diff) AS diff, avg(d) AS d, any_value(CASE WHEN q < 0.001 THEN '***' WHEN q < 0.01 THEN '**' WHEN q < 0.05 THEN '*' ELSE 'ns' END) AS stars FROM y JOIN h USING (model, metric) GROUP BY model, metric""",
            "diff", "d",
        ),
    ),
    "bootstrap_ci": (_scores(lambda s: st.bootstrap_ci(s, "model", "f1", "dataset")), None),
    "paired_bootstrap": (_scores(lambda s: st.paired_bootstrap(s.groupBy("dataset", "idx").agg(F.avg(F.when(F.col("exp_type") == "direct", F.col("f1"))).alias("a"), F.avg(F.when(F.col("exp_type") == "rag", F.col("f1"))).alias("b")), "dataset", "a", "b")), None),
    "unpaired_bootstrap": (_scores(lambda s: st.unpaired_bootstrap(s, "dataset", "f1")), None),
    "ranking_stability": (_results(lambda r: st.ranking_stability(r, "model", "f1")), None),
    "feature_importance": (_results(lambda r: st.feature_importance(r, ["model", "retriever", "prompt"], "f1")), None),
}
