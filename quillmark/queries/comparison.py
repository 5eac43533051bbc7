"""Queries over results and scores: comparisons, what explains differences, and diagnostics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.functions import parse
from quillmark.operators import compare, diagnostics, ranking
from quillmark.queries.bindings import ITEMS, RESULTS, SCORES, Query, items, results, rounded, scores, sql

FACTORS = ["model", "retriever", "prompt", "top_k"]
CONFIG = ["model", "retriever", "prompt", "top_k"]


#: Decimals of means of few short decimals, which fall on the border between two roundings at fewer.
FINE = 12


def _results(f, digits: int = 9) -> Query:
    return lambda spark, d: rounded(f(results(spark, d)), digits)


def _scores(f, digits: int = 9) -> Query:
    return lambda spark, d: rounded(f(scores(spark, d)), digits)


def _items(f) -> Query:
    return lambda spark, d: rounded(f(items(spark, d)))


def _long(columns: list[str], keep: str = "", source: str = "results") -> str:
    return " UNION ALL ".join(f"SELECT {keep}{', ' if keep else ''}'{c}' AS factor, CAST({c} AS VARCHAR) AS level FROM {source}" for c in columns)


_BASED = f"""WITH {RESULTS}, base AS (SELECT model, dataset, avg(f1) AS baseline FROM results WHERE exp_type = 'direct' GROUP BY ALL),
based AS (SELECT r.*, baseline, f1 - baseline AS benefit, CASE WHEN baseline <> 0 THEN (f1 - baseline) / baseline * 100 END AS benefit_pct FROM results r LEFT JOIN base USING (model, dataset) WHERE exp_type = 'rag')"""
_DELTAS = f"""WITH {SCORES}, base AS (SELECT idx, model, dataset, avg(f1) AS direct_mean FROM scores WHERE exp_type = 'direct' GROUP BY ALL),
deltas AS (SELECT s.*, direct_mean, f1 - direct_mean AS delta FROM scores s JOIN base USING (idx, model, dataset) WHERE exp_type <> 'direct')"""
_EXPLAINED = f"""WITH {RESULTS}, r AS (SELECT * FROM results WHERE exp_type = 'rag'), whole AS (SELECT dataset, var_samp(f1) AS var, avg(f1) AS grand, count(*) AS total FROM r GROUP BY dataset HAVING var_samp(f1) <> 0 AND count(*) >= 3),
long AS ({_long(FACTORS, "dataset, f1", "r")}), means AS (SELECT factor, level, dataset, avg(f1) AS m, count(*) AS n FROM long GROUP BY ALL),
between_ AS (SELECT factor, dataset, count(*) AS levels, sum(pow(m - grand, 2) * n / total) / any_value(var) * 100 AS share FROM means JOIN whole USING (dataset) GROUP BY ALL),
explained AS (SELECT factor, avg(share) AS explained FROM between_ WHERE levels > 1 GROUP BY factor)"""
_POTENTIAL = f"""lv AS (SELECT factor, level, avg(f1) AS m FROM ({_long(FACTORS, "f1", "results WHERE exp_type = 'rag'")}) GROUP BY ALL),
potential AS (SELECT factor, arg_max(level, m) AS best_level, max(m) AS best_mean, max(m) - (SELECT avg(f1) FROM results WHERE exp_type = 'rag') AS gain, max(m) - min(m) AS range_ FROM lv GROUP BY factor)"""
_RATES = """(both_ + context_only) / total AS recall, (both_ + correct_only) / total AS accuracy, CASE WHEN both_ + context_only > 0 THEN both_ / (both_ + context_only) ELSE 0.0 END AS given_context"""
_STATS = f"""WITH {ITEMS}, counts AS (SELECT experiment, count(*) AS total, count(*) FILTER (in_context AND correct) AS both_, count(*) FILTER (in_context AND NOT correct) AS context_only,
  count(*) FILTER (NOT in_context AND correct) AS correct_only, count(*) FILTER (NOT in_context AND NOT correct) AS neither FROM items GROUP BY experiment)"""
_LABEL = "CASE WHEN recall < 0.5 THEN 'retrieval' WHEN given_context < 0.5 THEN 'generation' ELSE 'balanced' END AS bottleneck"


def _docs(rows: DataFrame) -> DataFrame:
    return rows.select("dataset", "idx", "rank", "retrieval_rank", F.col("correct").alias("has_answer"))


QUERIES: dict[str, tuple[Query, str | None]] = {
    "compare_by_model": (
        _results(lambda r: compare.compare(r, "model", "f1")),
        sql(f"""WITH {RESULTS} SELECT coalesce(model, 'none') AS model, avg(f1) AS mean, min(f1) AS min, max(f1) AS max, coalesce(stddev_samp(f1), 0.0) AS std, count(f1) AS count FROM results GROUP BY 1""", "mean", "min", "max", "std"),
    ),
    "pivot_model_dataset": (
        _results(lambda r: compare.pivot(r, "model", "top_k", "f1", "mean").withColumnsRenamed({"0": "k0", "1": "k1", "2": "k2"})),
        sql(f"""WITH {RESULTS} SELECT model, avg(f1) FILTER (top_k = 0) AS k0, avg(f1) FILTER (top_k = 1) AS k1, avg(f1) FILTER (top_k = 2) AS k2 FROM results GROUP BY model""", "k0", "k1", "k2"),
    ),
    "best_by": (
        _results(lambda r: ranking.best_by(r, "f1", 10, F.col("exp_type") == "rag").select("id", "model", "dataset", "f1")),
        sql(f"""WITH {RESULTS} SELECT id, model, dataset, f1 FROM results WHERE exp_type = 'rag' ORDER BY f1 DESC, id LIMIT 10""", "f1"),
    ),
    "summary": (
        _results(lambda r: compare.summary(r, ["f1", "em"]).withColumns({c: F.array_join(c, ",") for c in ("models", "datasets", "retrievers")})),
        sql(
            f"""WITH {RESULTS} SELECT count(*) AS n, string_agg(DISTINCT model, ',' ORDER BY model) AS models, string_agg(DISTINCT dataset, ',' ORDER BY dataset) AS datasets,
            string_agg(DISTINCT retriever, ',' ORDER BY retriever) FILTER (exp_type = 'rag') AS retrievers, avg(f1) AS avg_f1, arg_max(id, (f1, -id)) AS best_f1, avg(em) AS avg_em, arg_max(id, (em, -id)) AS best_em, sum(duration) / 3600 AS hours FROM results""",
            "avg_f1", "avg_em", "hours",
        ),
    ),
    "leaderboard": (
        _results(lambda r: compare.leaderboard(r, "model", ["f1", "em"])),
        sql(
            f"""WITH {RESULTS}, g AS (SELECT model, avg(f1) AS f1_mean, stddev_samp(f1) AS f1_std, count(f1) AS f1_count, avg(em) AS em_mean, stddev_samp(em) AS em_std, count(em) AS em_count FROM results GROUP BY model)
            SELECT *, (rank() OVER (ORDER BY -f1_mean) + (count(*) OVER (PARTITION BY f1_mean) - 1) / 2 + rank() OVER (ORDER BY -em_mean) + (count(*) OVER (PARTITION BY em_mean) - 1) / 2) / 2 AS avg_rank FROM g""",
            "f1_mean", "f1_std", "em_mean", "em_std", "avg_rank",
        ),
    ),
    "stratified_mean": (
        _results(lambda r: compare.stratified_mean(r, "retriever", "f1", ["dataset"])),
        sql(f"""WITH {RESULTS} SELECT retriever, avg(m) AS mean, count(m) AS n_strata FROM (SELECT retriever, dataset, avg(f1) AS m FROM results GROUP BY ALL) GROUP BY retriever""", "mean"),
    ),
    "marginal_means": (
        _results(lambda r: compare.marginal_means(r, "prompt", "f1")),
        sql(f"""WITH {RESULTS} SELECT prompt, avg(m) AS mean, count(m) AS n_strata FROM (SELECT prompt, model, dataset, avg(f1) AS m FROM results GROUP BY ALL) GROUP BY prompt""", "mean"),
    ),
    "weighted_mean": (
        _results(lambda r: compare.frequency_weighted_mean(r, "model", "f1", "dataset")),
        sql(f"""WITH {RESULTS} SELECT model, sum(f1 * w) / sum(w) AS mean FROM (SELECT *, 1.0::DOUBLE / count(*) OVER (PARTITION BY model, dataset) AS w FROM results) GROUP BY model""", "mean"),
    ),
    "rag_benefit": (
        _results(lambda r: compare.benefit_distribution(r, "f1")),
        sql(
            f"""{_BASED} SELECT count(*) FILTER (benefit > 0.01) AS n_helps, count(*) FILTER (benefit < -0.01) AS n_hurts, count(*) FILTER (NOT coalesce(benefit > 0.01, false) AND NOT coalesce(benefit < -0.01, false)) AS n_neutral,
            avg(CAST(coalesce(benefit > 0.01, false) AS INT)) * 100 AS pct_helps, avg(CAST(coalesce(benefit < -0.01, false) AS INT)) * 100 AS pct_hurts, avg(benefit) FILTER (benefit > 0.01) AS mean_help, avg(benefit) FILTER (benefit < -0.01) AS mean_hurt, max(benefit) AS best, min(benefit) AS worst FROM based""",
            "pct_helps", "pct_hurts", "mean_help", "mean_hurt", "best", "worst",
        ),
    ),
    "best_vs_direct": (
        _results(lambda r: compare.best_rag_against_direct(r, "f1"), FINE),
        sql(
            f"""WITH {RESULTS}, t AS (SELECT model, dataset, avg(f1) AS top_mean, max(f1) AS best FROM (SELECT *, row_number() OVER (PARTITION BY model, dataset ORDER BY f1 DESC, id) AS rn FROM results WHERE exp_type = 'rag') WHERE rn <= 5 GROUP BY ALL),
            b AS (SELECT model, dataset, avg(f1) FILTER (exp_type = 'direct') AS direct_mean, count(*) FILTER (exp_type = 'rag') AS n FROM results GROUP BY ALL)
            SELECT model, dataset, direct_mean, top_mean, best, top_mean - direct_mean AS advantage, CASE WHEN direct_mean > 0 THEN (top_mean - direct_mean) / direct_mean * 100 ELSE 0.0 END AS advantage_pct, n FROM t JOIN b USING (model, dataset) WHERE direct_mean IS NOT NULL""",
            "direct_mean", "top_mean", "best", "advantage", "advantage_pct", digits=FINE,
        ),
    ),
    "success_factors": (
        _results(lambda r: compare.success_factors(r, "f1", ["retriever", "prompt", "top_k"])),
        sql(
            f"""{_BASED}, l AS ({_long(["retriever", "prompt", "top_k"], "dataset, benefit, benefit_pct", "based")}), i AS (SELECT factor, level, dataset, avg(CAST(coalesce(benefit > 0.01, false) AS INT)) AS h, avg(benefit) AS b, stddev_samp(benefit) AS s, avg(benefit_pct) AS p FROM l GROUP BY ALL)
            SELECT factor, level, avg(h) AS pct_helps, avg(b) AS mean_benefit, avg(s) AS std_benefit, avg(p) AS mean_benefit_pct FROM i GROUP BY ALL""",
            "pct_helps", "mean_benefit", "std_benefit", "mean_benefit_pct", digits=3,
        ),
    ),
    "variance_decomposition": (_results(lambda r: compare.variance_explained(r, "f1", FACTORS)), sql(f"{_EXPLAINED} SELECT * FROM explained", "explained")),
    "variance_by_metric": (
        _results(lambda r: compare.variance_explained_by_metric(r, ["f1", "em"], FACTORS).select("metric", "factor", "explained")),
        sql(f"{_EXPLAINED} SELECT 'f1' AS metric, factor, explained FROM explained UNION ALL SELECT 'em', factor, explained FROM ({_EXPLAINED.replace('f1', 'em').replace('o_totalprice / 500000 AS em', 'o_totalprice / 500000 AS f1', 1)} SELECT * FROM explained)", "explained"),
    ),
    "interaction": (
        _results(lambda r: compare.interaction(r, "model", "retriever", "f1")),
        sql(f"""WITH {RESULTS} SELECT model, retriever, avg(m) AS mean, avg(s) AS std, CAST(sum(n) AS BIGINT) AS count FROM (SELECT model, retriever, dataset, avg(f1) AS m, stddev_samp(f1) AS s, count(f1) AS n FROM results WHERE exp_type = 'rag' GROUP BY ALL) GROUP BY ALL""", "mean", "std"),
    ),
    "synergy": (
        _results(lambda r: compare.synergy(r, "model", "retriever", "f1")),
        sql(
            f"""WITH {RESULTS}, r AS (SELECT * FROM results WHERE exp_type = 'rag'), g AS (SELECT dataset, avg(f1) AS g FROM r GROUP BY dataset HAVING count(*) >= 3), a AS (SELECT dataset, model, avg(f1) AS ma FROM r GROUP BY ALL), b AS (SELECT dataset, retriever, avg(f1) AS mb FROM r GROUP BY ALL),
            c AS (SELECT dataset, model, retriever, avg(f1) AS actual FROM r GROUP BY ALL), e AS (SELECT model, retriever, avg(actual) AS actual, avg(ma + mb - g) AS expected, avg(actual - (ma + mb - g)) AS effect FROM c JOIN a USING (dataset, model) JOIN b USING (dataset, retriever) JOIN g USING (dataset) GROUP BY ALL)
            SELECT *, CASE WHEN effect > 0.01 THEN 'Synergistic' WHEN effect < -0.01 THEN 'Redundant' ELSE 'Neutral' END AS synergy FROM e""",
            "actual", "expected", "effect",
        ),
    ),
    "sign_stability": (
        _results(lambda r: compare.sign_stability(r, "model", "retriever", "f1"), FINE),
        sql(
            f"""WITH {RESULTS}, r AS (SELECT * FROM results WHERE exp_type = 'rag'), g AS (SELECT dataset, avg(f1) AS g FROM r GROUP BY dataset), a AS (SELECT dataset, model, avg(f1) AS ma FROM r GROUP BY ALL), b AS (SELECT dataset, retriever, avg(f1) AS mb FROM r GROUP BY ALL),
            c AS (SELECT dataset, model, retriever, avg(f1) AS x FROM r GROUP BY ALL), e AS (SELECT model, retriever, x - ma - mb + g AS e FROM c JOIN a USING (dataset, model) JOIN b USING (dataset, retriever) JOIN g USING (dataset))
            SELECT model, retriever, count(*) AS n_strata, max(e) - min(e) AS spread, min(e) > 0 OR max(e) < 0 AS stable FROM e GROUP BY ALL""",
            "spread", digits=FINE,
        ),
    ),
    "question_difficulty": (
        _scores(lambda s: compare.question_difficulty(s, "f1"), FINE),
        sql(
            f"""WITH {SCORES}, g AS (SELECT idx, dataset, avg(f1) AS mean_score, stddev_samp(f1) AS std_score, avg(CAST(f1 >= 0.5 AS INT)) AS pct_correct, count(*) AS n FROM scores GROUP BY ALL)
            SELECT *, CASE WHEN pct_correct >= 0.8 THEN 'easy' WHEN pct_correct <= 0.2 THEN 'hard' ELSE 'discriminating' END AS difficulty FROM g""",
            "mean_score", "std_score", "pct_correct", digits=FINE,
        ),
    ),
    "question_delta": (
        _scores(lambda s: compare.question_delta(s, "f1").select("id", "idx", "model", "dataset", "direct_mean", "delta"), FINE),
        sql(f"{_DELTAS} SELECT id, idx, model, dataset, direct_mean, delta FROM deltas", "direct_mean", "delta", digits=FINE),
    ),
    "help_rates": (
        lambda spark, d: rounded(compare.help_rates(compare.question_delta(scores(spark, d), "f1")), 12),
        sql(
            f"""{_DELTAS}, g AS (SELECT idx, count(*) AS n, avg(CAST(delta > 0.01 AS INT)) AS helps, avg(CAST(delta < -0.01 AS INT)) AS hurts, avg(delta) AS mean_delta FROM deltas GROUP BY idx)
            SELECT *, CASE WHEN helps > 0.8 THEN 'helped' WHEN hurts > 0.8 THEN 'hurt' ELSE 'mixed' END AS label FROM g""",
            "helps", "hurts", "mean_delta", digits=12,
        ),
    ),
    "delta_summary": (
        _scores(lambda s: compare.delta_summary(compare.question_delta(s, "f1"), "model"), FINE),
        sql(f"{_DELTAS} SELECT model, avg(delta) AS mean, max(delta) AS best, min(delta) AS worst, arg_min(delta, id) AS first, count(*) AS n FROM deltas GROUP BY model", "mean", "best", "worst", "first", digits=FINE),
    ),
    "dedup_best": (
        _results(lambda r: compare.deduplicate(r, ["model", "dataset", "retriever", "prompt", "top_k"], "f1").select("id", "model", "dataset", "f1")),
        sql(f"""WITH {RESULTS} SELECT id, model, dataset, f1 FROM (SELECT *, row_number() OVER (PARTITION BY model, dataset, retriever, prompt, top_k ORDER BY coalesce(f1, -1) DESC, id) AS rn FROM results) WHERE rn = 1""", "f1"),
    ),
    "value_counts": (
        _results(lambda r: compare.value_counts(r, ["model", "dataset", "top_k"])),
        f"""WITH {RESULTS} SELECT factor AS "column", level AS value, count(*) AS n FROM ({_long(["model", "dataset", "top_k"])}) WHERE level IS NOT NULL GROUP BY ALL""",
    ),
    "crosstab_norm": (
        _results(lambda r: compare.crosstab(r, "model", "retriever")),
        sql(f"""WITH {RESULTS}, c AS (SELECT model, retriever, count(*) AS n FROM results GROUP BY ALL) SELECT *, n / sum(n) OVER (PARTITION BY model) AS share FROM c""", "share"),
    ),
    "top_sensitivity": (
        _results(lambda r: compare.top_sensitivity(r, "top_k", "f1")),
        sql(
            f"""WITH {RESULTS}, s AS (SELECT top_k, avg(m) AS mean FROM (SELECT top_k, dataset, avg(f1) AS m FROM results GROUP BY ALL) GROUP BY top_k), f AS (SELECT top_k, stddev_samp(f1) AS sd, count(*) AS n FROM results GROUP BY top_k)
            SELECT top_k, mean, mean - 1.96::DOUBLE * sd / sqrt(n) AS low, mean + 1.96::DOUBLE * sd / sqrt(n) AS high, n FROM s JOIN f USING (top_k)""",
            "mean", "low", "high",
        ),
    ),
    "model_sensitivity": (
        _results(lambda r: compare.model_sensitivity(r, "f1")),
        sql(
            f"""WITH {RESULTS}, l AS (SELECT model, prompt, avg(f1) AS m FROM results GROUP BY ALL), g AS (SELECT model, max(m) - min(m) AS factor_range, arg_max(prompt, m) AS best_level FROM l GROUP BY model),
            e AS (SELECT model, avg(f1) FILTER (exp_type = 'rag') - avg(f1) FILTER (exp_type = 'direct') AS rag_effect, stddev_samp(f1) AS std FROM results GROUP BY model) SELECT model, rag_effect, std, factor_range, best_level FROM e JOIN g USING (model)""",
            "rag_effect", "std", "factor_range",
        ),
    ),
    "improvement_potential": (
        _results(lambda r: compare.potential(compare.rag(r), FACTORS, "f1")),
        sql(f'WITH {RESULTS}, {_POTENTIAL} SELECT factor, best_level, best_mean, gain, range_ AS "range" FROM potential', "best_mean", "gain", '"range"'),
    ),
    "priorities": (
        _results(lambda r: compare.priorities(r, FACTORS, "f1")),
        sql(f"{_EXPLAINED}, {_POTENTIAL} SELECT factor, explained, gain, CASE WHEN explained > 10 AND gain > 0.02 THEN 'high' WHEN explained > 5 OR gain > 0.01 THEN 'medium' ELSE 'low' END AS priority FROM explained JOIN potential USING (factor)", "explained", "gain"),
    ),
    "beats_direct": (
        _results(lambda r: compare.beats_direct(r, "f1")),
        sql(f"{_BASED} SELECT model, count(*) AS n, avg(CAST(benefit > 0 AS INT)) * 100 AS pct_better FROM based WHERE baseline IS NOT NULL GROUP BY model", "pct_better"),
    ),
    "tier_wins": (
        _results(lambda r: compare.tiers(r, "f1"), FINE),
        sql(
            f"""WITH {RESULTS}, p AS (SELECT model, dataset, max(f1) FILTER (exp_type = 'direct') AS best_direct, max(f1) FILTER (exp_type = 'rag') AS best_rag FROM results GROUP BY ALL),
            t AS (SELECT model, dataset, avg(f1) AS top_mean FROM (SELECT *, row_number() OVER (PARTITION BY model, dataset ORDER BY f1 DESC, id) AS rn FROM results WHERE exp_type = 'rag') WHERE rn <= 5 GROUP BY ALL) SELECT *, best_rag > best_direct AS rag_wins FROM p JOIN t USING (model, dataset)""",
            "best_direct", "best_rag", "top_mean", digits=FINE,
        ),
    ),
    "grid_coverage_missing": (
        _results(lambda r: compare.coverage(r.withColumn("day", (F.col("id") % 997).cast("string")), ["model", "retriever", "prompt", "day"], 20)[1]),
        f"""WITH {RESULTS}, r AS (SELECT *, CAST(id % 997 AS VARCHAR) AS "day" FROM results) SELECT model, retriever, prompt, "day" FROM (SELECT DISTINCT model FROM r), (SELECT DISTINCT retriever FROM r), (SELECT DISTINCT prompt FROM r), (SELECT DISTINCT "day" FROM r) EXCEPT SELECT model, retriever, prompt, "day" FROM r ORDER BY ALL LIMIT 20""",
    ),
    "space_cardinality": (
        _results(lambda r: compare.cardinality(r, FACTORS)),
        f"""WITH {RESULTS} SELECT factor AS dimension, count(DISTINCT level) AS n, string_agg(DISTINCT level, ',' ORDER BY level) AS "values" FROM ({_long(FACTORS)}) GROUP BY factor""",
    ),
    "universal_recipe": (
        _results(lambda r: compare.recipe(r, FACTORS, "f1")),
        f"""WITH {RESULTS}, t AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY f1 DESC, id) AS rn, greatest(1, count(*) OVER (PARTITION BY dataset) // 10) AS most FROM results WHERE exp_type = 'rag'), tops AS (SELECT * FROM t WHERE rn <= most),
        c AS (SELECT dataset, factor, level, count(*) AS n FROM ({_long(FACTORS, "dataset", "tops")}) GROUP BY ALL), m AS (SELECT *, row_number() OVER (PARTITION BY dataset, factor ORDER BY n DESC, level) AS k FROM c), a AS (SELECT factor, level, count(*) AS agree FROM m WHERE k = 1 GROUP BY ALL)
        SELECT factor, level, agree FROM (SELECT *, row_number() OVER (PARTITION BY factor ORDER BY agree DESC, level) AS k FROM a) WHERE k = 1""",
    ),
    "config_pairs": (
        _results(lambda r: compare.config_pairs(r, CONFIG, "f1"), FINE),
        sql(f"""WITH {RESULTS}, m AS (SELECT dataset, model, retriever, prompt, top_k, avg(f1) AS m FROM results GROUP BY ALL) SELECT x.dataset AS a, y.dataset AS b, model, retriever, prompt, top_k, x.m AS ma, y.m AS mb FROM m x JOIN m y USING (model, retriever, prompt, top_k) WHERE x.dataset < y.dataset""", "ma", "mb", digits=FINE),
    ),
    "configs_in_all": (
        _results(lambda r: compare.in_all_datasets(r, CONFIG, "f1"), FINE),
        sql(f"""WITH {RESULTS}, m AS (SELECT dataset, model, retriever, prompt, top_k, avg(f1) AS m FROM results GROUP BY ALL) SELECT model, retriever, prompt, top_k, count(*) AS n, avg(m) AS mean, max(m) - min(m) AS spread FROM m GROUP BY ALL HAVING count(*) = (SELECT count(DISTINCT dataset) FROM results)""", "mean", "spread", digits=FINE),
    ),
    "interesting_questions": (
        _scores(lambda s: compare.interesting_questions(s, "f1")),
        sql(
            f"""WITH {SCORES}, g AS (SELECT idx, count(f1) AS n, stddev_pop(f1) AS sd, avg(f1) FILTER (exp_type = 'rag') - avg(f1) FILTER (exp_type = 'direct') AS gap FROM scores GROUP BY idx HAVING count(f1) >= 5)
            SELECT * FROM (SELECT *, CASE WHEN gap > 0.2 THEN 'helps' WHEN gap < -0.2 THEN 'hurts' WHEN sd > 0.3 THEN 'controversial' END AS kind FROM g) WHERE kind IS NOT NULL""",
            "sd", "gap",
        ),
    ),
    "hardest_questions": (
        _scores(lambda s: compare.hardest(s, "f1")),
        sql(f"""WITH {SCORES} SELECT idx, count(f1) AS n, round(avg(f1), 9) AS mean FROM scores GROUP BY idx HAVING count(f1) >= 5 ORDER BY mean, idx LIMIT 20""", "mean"),
    ),
    "score_histogram": (
        _scores(lambda s: compare.histogram(s, "f1", 0.0, 1.0, 20)),
        f"""WITH {SCORES} SELECT CAST(least(floor((f1 - 0.0) / ((1.0::DOUBLE - 0.0) / 20)), 19) AS INTEGER) AS bin, count(*) AS n FROM scores WHERE f1 BETWEEN 0 AND 1 GROUP BY 1""",
    ),
    "size_buckets": (
        _results(lambda r: r.groupBy(compare.buckets(F.col("em"), [-1.0, 0.0, 0.5, 1.0], ["low", "middle", "high"]).alias("bucket")).agg(F.count("*").alias("n"), F.avg("f1").alias("mean"))),
        sql(f"""WITH {RESULTS} SELECT CASE WHEN em > -1 AND em <= 0 THEN 'low' WHEN em > 0 AND em <= 0.5 THEN 'middle' WHEN em > 0.5 AND em <= 1 THEN 'high' END AS bucket, count(*) AS n, avg(f1) AS mean FROM results GROUP BY 1""", "mean"),
    ),
    "length_stats": (
        lambda spark, d: rounded(compare.length_stats(spark.read.parquet(f"{d}/conversations.parquet").select("role", F.length("text").cast("double").alias("n")), "role", "n", 500.0)),
        sql("""SELECT role, avg(n) AS mean, median(n) AS median, stddev_samp(n) AS std, quantile_cont(n, 0.99) AS q99, avg(least(n, 500.0::DOUBLE)) AS clipped FROM (SELECT role, CAST(length(text) AS DOUBLE) AS n FROM conversations) GROUP BY role""", "mean", "median", "std", "q99", "clipped"),
    ),
    "error_taxonomy": (
        lambda spark, d: spark.read.parquet(f"{d}/conversations.parquet").filter("role = 'assistant'").select("conv_id", "turn", parse.error_type(F.col("text"), F.when(F.col("conv_id") % 3 == 0, 0.6).when(F.col("conv_id") % 3 == 1, 0.2).otherwise(0.0)).alias("error_type")),
        """SELECT conv_id, turn, CASE WHEN conv_id % 3 = 0 THEN 'correct' WHEN trim(lower(text)) IN ('', 'n/a', 'none', 'unknown') THEN 'refusal/empty'
        WHEN regexp_matches(lower(text), 'i don''t know|i''m not sure|cannot determine|not enough information|i am not sure|unclear|i cannot|unable to') THEN 'refusal/hedging' WHEN conv_id % 3 = 1 THEN 'partial_match' WHEN length(trim(lower(text))) > 200 THEN 'over_verbose' ELSE 'wrong_answer' END AS error_type
        FROM conversations WHERE role = 'assistant'""",
    ),
    "retrieval_bottleneck": (
        _items(lambda i: diagnostics.retrieval_stats(i)),
        sql(f"{_STATS}, r AS (SELECT *, {_RATES} FROM counts) SELECT * RENAME (both_ AS \"both\"), {_LABEL} FROM r", "recall", "accuracy", "given_context"),
    ),
    "retrieval_micro": (
        _items(lambda i: diagnostics.micro(diagnostics.retrieval_stats(i))),
        sql(f"{_STATS}, c AS (SELECT {', '.join(f'CAST(sum({x}) AS BIGINT) AS {x}' for x in ('total', 'both_', 'context_only', 'correct_only', 'neither'))} FROM counts), r AS (SELECT *, {_RATES} FROM c) SELECT * RENAME (both_ AS \"both\"), {_LABEL} FROM r", "recall", "accuracy", "given_context"),
    ),
    "retrieval_quadrants": (
        _items(lambda i: diagnostics.quadrant_shares(i)),
        sql(f"WITH {ITEMS}, p AS (SELECT dataset, " + ", ".join(f"avg(CAST({c} AS INT)) AS {n}" for n, c in (("both_", "in_context AND correct"), ("context_only", "in_context AND NOT correct"), ("correct_only", "NOT in_context AND correct"), ("neither", "NOT in_context AND NOT correct"))) + " FROM items GROUP BY dataset) " + " UNION ALL ".join(f"SELECT '{n.rstrip('_')}' AS quadrant, avg({n}) AS share FROM p" for n in ("both_", "context_only", "correct_only", "neither")), "share"),
    ),
    "rank_change": (
        _items(lambda i: diagnostics.rank_change(_docs(i).filter("has_answer"))),
        sql(
            f"""WITH {ITEMS}, p AS (SELECT dataset, avg(retrieval_rank - rank) AS m, median(retrieval_rank - rank) AS d, avg(CAST(retrieval_rank > rank AS INT)) AS i, avg(rank) AS f, count(*) AS n FROM items WHERE correct GROUP BY dataset)
            SELECT avg(m) AS mean_change, avg(d) AS median_change, avg(i) AS improved, avg(f) AS mean_final, CAST(sum(n) AS BIGINT) AS n FROM p""",
            "mean_change", "median_change", "improved", "mean_final",
        ),
    ),
    "conditional_accuracy": (
        _items(lambda i: diagnostics.conditional_accuracy(i, ["experiment"])),
        sql(f"WITH {ITEMS} SELECT experiment, count(*) AS n, avg(CAST(in_context AS INT)) AS recall, avg(CAST(correct AS INT)) FILTER (in_context) AS with_context, avg(CAST(correct AS INT)) FILTER (NOT in_context) AS without_context FROM items GROUP BY experiment", "recall", "with_context", "without_context"),
    ),
    "retriever_profile": (
        _items(lambda i: diagnostics.retriever_profile(i)),
        sql(
            f"""WITH {ITEMS}, p AS (SELECT retriever, dataset, avg(CAST(in_context AS INT)) AS a, avg(CAST(correct AS INT)) AS b, avg(f1) AS c, avg(CAST(correct AS INT)) FILTER (in_context) AS d, count(*) AS n, count(DISTINCT experiment) AS e FROM items GROUP BY ALL)
            SELECT retriever, avg(a) AS recall, avg(b) AS accuracy, avg(c) AS f1, avg(d) AS given_context, CAST(sum(n) AS BIGINT) AS n, CAST(sum(e) AS BIGINT) AS experiments FROM p GROUP BY retriever""",
            "recall", "accuracy", "f1", "given_context",
        ),
    ),
    "first_answer_rank": (
        _items(lambda i: diagnostics.hits_at(diagnostics.first_answer_rank(_docs(i), ["dataset", "idx"]), [1, 3])),
        sql(
            f"""WITH {ITEMS}, f AS (SELECT dataset, idx, min(rank) FILTER (correct) AS r FROM items GROUP BY ALL) SELECT avg(coalesce(1.0::DOUBLE / r, 0.0)) AS mrr, median(r) AS median_rank, avg(coalesce(CAST(r <= 1 AS INT), 0)) AS hit_1, avg(coalesce(CAST(r <= 3 AS INT), 0)) AS hit_3 FROM f""",
            "mrr", "median_rank", "hit_1", "hit_3",
        ),
    ),
    "trace_steps": (
        _scores(lambda s: diagnostics.trace_steps(s.select(F.col("dataset").alias("type"), F.when(F.col("id") % 3 == 0, 0.0).otherwise(F.col("f1") * 100).alias("timing_ms")))),
        sql(f"""WITH {SCORES}, s AS (SELECT dataset AS type, CASE WHEN id % 3 = 0 THEN 0.0 ELSE f1 * 100 END AS t FROM scores) SELECT type, count(*) AS n, coalesce(sum(t) FILTER (t > 0), 0.0) AS total_ms, coalesce(avg(t) FILTER (t > 0), 0.0) AS avg_ms FROM s GROUP BY type""", "total_ms", "avg_ms"),
    ),
}
