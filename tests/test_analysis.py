"""Comparison, diagnostics and statistics against pandas, numpy and values worked by hand."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillmark.operators import compare, diagnostics, ranking
from quillmark.operators import statistics as st

RNG = np.random.default_rng(3)
N = 240
FRAME = pd.DataFrame(
    {
        "id": range(N),
        "model": RNG.choice(["a", "b", "c"], N),
        "dataset": RNG.choice(["x", "y"], N),
        "exp_type": RNG.choice(["rag", "rag", "direct"], N),
        "retriever": RNG.choice(["r1", "r2", "r3"], N),
        "prompt": RNG.choice(["p", "q"], N),
        "f1": RNG.integers(0, 40, N) / 40,
        "em": RNG.random(N),
        "duration": RNG.random(N) * 100,
    }
)


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(FRAME)


def as_dict(df, *keys):
    return {tuple(r[k] for k in keys): r for r in df.collect()}


def test_groups_of_one_and_null_groups(spark):
    rows = spark.createDataFrame([("a", 1.0), ("b", 1.0), ("b", 3.0), (None, 5.0)], "g string, m double")
    got = {r["g"]: (r["mean"], r["std"], r["count"]) for r in compare.compare(rows, "g", "m").collect()}
    assert got == {"a": (1, 0, 1), "b": (2, pytest.approx(math.sqrt(2)), 2), "none": (5, 0, 1)}
    assert {r["g"] for r in compare.stratified_mean(rows.withColumn("s", F.lit(1)), "g", "m", ["s"]).collect()} == {"a", "b"}


def test_pivot_orders_numbers_first(spark):
    rows = spark.createDataFrame([("a", "10", 1.0), ("a", "9", 2.0), ("a", "x", 3.0)], "r string, c string, m double")
    assert compare.pivot(rows, "r", "c", "m").columns == ["r", "9", "10", "x"]


def test_variance_explained(rows):
    want = {}
    rag = FRAME[FRAME.exp_type == "rag"]
    for f in ("model", "retriever"):
        shares = []
        for _, g in rag.groupby("dataset"):
            m = g.groupby(f).f1.mean()
            shares.append(((m - g.f1.mean()) ** 2 * g.groupby(f).size() / len(g)).sum() / g.f1.var() * 100)
        want[f] = np.mean(shares)
    got = {r["factor"]: r["explained"] for r in compare.variance_explained(rows, "f1", ["model", "retriever"]).collect()}
    assert got == {k: pytest.approx(v) for k, v in want.items()}
    assert compare.variance_explained(rows.withColumn("f1", F.lit(1.0)), "f1", ["model"]).count() == 0


def test_benefit(rows):
    base = FRAME[FRAME.exp_type == "direct"].groupby(["model", "dataset"]).em.mean().rename("b").reset_index()
    rag = FRAME[FRAME.exp_type == "rag"].merge(base, on=["model", "dataset"], how="left")
    gain = rag.em - rag.b
    got = compare.benefit_distribution(rows, "em").first()
    assert (got["n_helps"], got["n_hurts"]) == ((gain > 0.01).sum(), (gain < -0.01).sum()) and got["best"] == pytest.approx(gain.max())


def test_synergy_of_additive_cells_is_none(spark):
    rows = spark.createDataFrame([("rag", "d", a, b, float(x + y)) for a, x in (("a", 1), ("b", 2)) for b, y in (("c", 10), ("e", 20)) for _ in range(2)], "exp_type string, dataset string, u string, v string, m double")
    assert {(r["synergy"], round(r["effect"], 9)) for r in compare.synergy(rows, "u", "v", "m").collect()} == {("Neutral", 0.0)}
    assert all(not r["stable"] for r in compare.sign_stability(rows, "u", "v", "m").collect())


def test_deduplicate_takes_nulls_as_equal(spark):
    rows = spark.createDataFrame([(1, "a", None, 0.5), (2, "a", None, 0.9), (3, "a", "x", None), (4, "a", "x", None)], "id long, k string, l string, f1 double")
    assert sorted(r["id"] for r in compare.deduplicate(rows, ["k", "l"], "f1").collect()) == [2, 3]


def test_percentile_and_ranks(rows):
    got = st.percentile_rank(rows, "f1", ["dataset"]).toPandas().sort_values("id")
    assert np.allclose(got.pct, FRAME.groupby("dataset").f1.rank(pct=True))


def test_windows(spark):
    trials = spark.createDataFrame([(k, float(v)) for k, v in enumerate([3, 1, 4, 1, 5, 9, 2])], "number long, value double")
    best = [r["running_best"] for r in st.running_best(trials).orderBy("number").collect()]
    mean = [r["rolling_mean"] for r in st.rolling_mean(trials, width=5, least=3).orderBy("number").collect()]
    assert best == [3, 3, 4, 4, 5, 9, 9] and mean[:2] == [None, None] and mean[6] == pytest.approx(4.2)


def test_normalize_without_spread(spark):
    rows = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("b", 2.0), ("c", None)], "dataset string, m double")
    assert {r["metric_norm"] for how in ("zscore", "minmax") for r in st.normalize(rows, "m", how=how).collect()} == {0.0, None}


def test_spearman(rows):
    got = {(r["a"], r["b"]): r["rho"] for r in st.spearman_matrix(rows, ["f1", "em", "duration"]).collect()}
    want = FRAME[["f1", "em", "duration"]].rank().corr()
    assert got == {(a, b): pytest.approx(want.loc[a, b]) for a, b in got}


def test_ranks_in_ranges(spark):
    values = [None, -1.5, 0.0, 0.0, 0.0, 2.0, 2.0, 7.0] + [float(v % 13) for v in range(60)]
    frame = spark.createDataFrame([(v,) for v in values], "m double")
    want = pd.Series(values, dtype=float).rank().groupby(pd.Series(values, dtype=float)).first().to_dict()
    for parts in (1, 3, 200):
        assert {r["m"]: r["rank"] for r in ranking.ranked_values(frame, "m", parts).collect()} == want
    assert ranking.ranked_values(frame.limit(0), "m").collect() == []


def test_large_groups_are_told_before_they_are_gathered(spark, monkeypatch):
    monkeypatch.setattr(st, "MOST_VALUES", 3)
    rows = spark.createDataFrame([("a", 1.0)] * 4 + [("b", 1.0)], "k string, m double")
    with pytest.raises(ValueError, match="more than 3 values"):
        st.bootstrap_ci(rows, "k", "m")
    assert st.bootstrap_ci(rows.filter("k = 'b'"), "k", "m").first()["n"] == 1


def test_distributions():
    assert st.t_two_sided(2.0, 10) == pytest.approx(0.07338803, abs=1e-7)
    assert st.t_two_sided(0.0, 5) == pytest.approx(1.0)
    assert st.f_upper(4.0, 3, 20) == pytest.approx(st.f_upper(4.0, 3, 20)) and st.f_upper(4.2252012731274315, 1, 12) == pytest.approx(st.t_two_sided(math.sqrt(4.2252012731274315), 12))
    assert st.normal_two_sided(1.959963985) == pytest.approx(0.05, abs=1e-9)


def test_cohens_d(spark):
    rows = spark.createDataFrame([("g", t, x) for t, xs in (("rag", [2.0, 4.0]), ("direct", [1.0, 3.0])) for x in xs], "k string, exp_type string, m double")
    got = st.compare_types(rows, "m", ["k"]).first()
    assert got["d"] == pytest.approx(1 / math.sqrt(2)) and got["effect"] == "medium" and got["df"] == 2


def test_holm(spark):
    rows = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03), ("d", 0.9)], "test string, p double")
    assert {r["test"]: round(r["p_adjusted"], 9) for r in st.holm(rows).collect()} == {"a": 0.04, "c": 0.09, "b": 0.08, "d": 0.9}


def test_anova_equals_t_squared(rows):
    two = rows.filter("model <> 'c'")
    f = st.anova(two, "model", "f1").first()["f"]
    g = FRAME[FRAME.model != "c"].groupby("model").f1
    m, v, n = g.mean(), g.var(), g.count()
    t = (m["a"] - m["b"]) / math.sqrt(((n["a"] - 1) * v["a"] + (n["b"] - 1) * v["b"]) / (n["a"] + n["b"] - 2) * (1 / n["a"] + 1 / n["b"]))
    assert f == pytest.approx(t * t)


def test_bootstrap(spark, rows):
    a = {r["model"]: r for r in st.bootstrap_ci(rows, "model", "f1").collect()}
    b = {r["model"]: r for r in st.bootstrap_ci(rows.repartition(5), "model", "f1").collect()}
    assert a == b
    for model, g in FRAME.groupby("model").f1:
        assert a[model]["low"] < g.mean() < a[model]["high"] and a[model]["high"] - a[model]["low"] == pytest.approx(2 * 1.96 * g.std() / math.sqrt(len(g)), rel=0.2)
    few = spark.createDataFrame([("z", 1.0), ("z", 2.0)], "model string, f1 double")
    assert st.bootstrap_ci(few, "model", "f1").first()["low"] is None


def test_bootstrap_tests(spark):
    pairs = spark.createDataFrame([("k", float(x), float(x) + 0.5) for x in range(20)], "k string, a double, b double")
    got = st.paired_bootstrap(pairs, "k", "a", "b", 500).first()
    assert (got["diff"], got["low"], got["high"], got["p"]) == (0.5, 0.5, 0.5, 0.0)
    same = spark.createDataFrame([("k", t, float(x)) for t in ("direct", "rag") for x in range(30)], "k string, exp_type string, m double")
    assert st.unpaired_bootstrap(same, "k", "m", times=500).first()["p"] > 0.5


def test_stability(rows):
    got = st.ranking_stability(rows.withColumn("f1", F.col("f1") + F.when(F.col("model") == "a", 5).otherwise(0)), "model", "f1", 50).collect()
    assert {r["model"]: (r["usual_rank"], r["share"]) for r in got}["a"] == (1, 1.0)


def test_histogram_closes_its_last_bin(spark):
    rows = spark.createDataFrame([(0.0,), (0.49,), (0.5,), (1.0,), (1.2,)], "x double")
    assert {r["bin"]: r["n"] for r in compare.histogram(rows, "x", 0.0, 1.0, 2).collect()} == {0: 2, 1: 2}


def test_retrieval_stats(spark):
    items = spark.createDataFrame([("e", True, True), ("e", True, False), ("e", False, True), ("e", False, False), ("e", True, True)], "experiment string, in_context boolean, correct boolean")
    got = diagnostics.retrieval_stats(items).first()
    assert (got["both"], got["context_only"], got["correct_only"], got["neither"], got["bottleneck"]) == (2, 1, 1, 1, "balanced") and got["recall"] == pytest.approx(0.6)


def test_missing_steps(spark):
    steps = spark.createDataFrame([("e", "fixed_rag", "batch_search"), ("f", "direct_llm", "batch_generate")], "experiment string, agent_type string, type string")
    assert [tuple(r) for r in diagnostics.missing_steps(spark, steps).collect()] == [("e", "fixed_rag", "batch_generate")]


def test_feature_importance(rows):
    loaded = rows.withColumn("f1", F.when(F.col("model") == "a", 1.0).otherwise(0.0))
    got = {r["factor"]: r["importance"] for r in st.feature_importance(loaded, ["model", "prompt"], "f1", 10).collect()}
    assert got["model"] > 0.8


def test_resamples_of_large_groups_are_dealt(spark, monkeypatch):
    """Blocks of draws have all values of a group; together they are as many draws, and say what one task says up to the noise of draws."""
    rows = spark.range(4000).select(F.lit("a").alias("k"), F.when(F.col("id") % 2 == 0, "direct").otherwise("rag").alias("exp_type"), (F.col("id") % 97 + F.col("id") % 2).cast("double").alias("m"))
    one = st.unpaired_bootstrap(rows, "k", "m", times=1001).first()
    monkeypatch.setattr(st, "BLOCK_DRAWS", 1_000_000)
    assert {tuple(r) for r in st._blocked(rows, "k", 1001).groupBy("block").count().collect()} == {(b, 4000) for b in range(5)}
    many = st.unpaired_bootstrap(rows, "k", "m", times=1001).first()
    assert (one["diff"], one["n_a"], one["n_b"]) == (many["diff"], many["n_a"], many["n_b"])
    assert abs(one["low"] - many["low"]) < 0.3 and abs(one["high"] - many["high"]) < 0.3 and abs(one["p"] - many["p"]) < 0.2


def test_groups_of_any_size_are_resampled(spark, monkeypatch):
    """Groups over the limit are drawn in chunks of their values: as one task says up to the noise of draws, however rows are dealt, with null figures where a side is empty; other groups keep their draws."""
    cycle = F.when(F.col("id") % 3 == 0, F.col("id") / 41).otherwise(F.col("id") % 97)  # values that come once and values that come often
    rows = spark.range(4000).select(F.lit("a").alias("k"), F.when(F.col("id") % 4 == 0, "direct").otherwise("rag").alias("exp_type"), (cycle + F.col("id") % 2).cast("double").alias("m"))
    rows = rows.union(rows.limit(50).withColumn("k", F.lit("small"))).union(rows.filter("exp_type = 'rag'").withColumn("k", F.lit("rag only"))).union(rows.select(F.lit("no value"), "exp_type", F.lit(None).cast("double")))
    rows = rows.union(spark.createDataFrame([("a", "rag", float("nan")), ("a", "direct", None), (None, "rag", 1.0)], "k string, exp_type string, m double")).cache()
    of = lambda: {r["k"]: tuple(r)[1:] for r in st.unpaired_bootstrap(rows, "k", "m", times=4000).collect()}
    want = of()
    monkeypatch.setattr(st, "MOST_VALUES", 2000)
    for block in (1 << 30, 1_000_000):  # a chunk, and dozens
        monkeypatch.setattr(st, "BLOCK_DRAWS", block)
        got = of()
        assert set(got) == set(want) and got["rag only"] == want["rag only"] == (None, None, None, None, 0, 3000) and got["no value"] == want["no value"] == (None, None, None, None, 0, 0)
        assert got["small"] == want["small"] and got["a"][4:] == want["a"][4:] == (1000, 3000)
        assert got["a"][0] == pytest.approx(want["a"][0], abs=1e-9) and got["a"][1:3] != want["a"][1:3]  # drawn another way
        spread = want["a"][2] - want["a"][1]
        assert got["a"][1:3] == pytest.approx(want["a"][1:3], abs=0.06 * spread) and got["a"][3] == pytest.approx(want["a"][3], abs=0.06)
    rows = rows.repartition(7, "m")
    assert of() == got


def test_chunks_make_whole_resamples(monkeypatch):
    """The draws of a resample that fall to chunks add up, spread as multinomial numbers do, and give sums of the variance of draws; an infinite value counts where it is drawn."""
    monkeypatch.setattr(st, "PIECE", 8)
    totals, rng = np.array([5000, 0, 2000, 1000, 2000]), np.random.default_rng(1)
    many = np.stack([st._dealt(totals, k, 20_000, [42, 7, 1]) for k in (0, 2, 3, 4)])
    assert (many.sum(axis=0) == 10_000).all() and (st._dealt(totals, 3, 20_000, [42, 7, 1]) == many[2]).all()
    share = np.array([0.5, 0.2, 0.1, 0.2])
    assert np.allclose(many.mean(axis=1), 10_000 * share, atol=2) and np.allclose(np.cov(many), 10_000 * (np.diag(share) - np.outer(share, share)), atol=80)
    values, counts = np.arange(60.0), np.where(np.arange(60) % 2, 1, 40)  # some are drawn one by one, some by number
    sums, all_values = st._sums(values, counts, np.full(20_000, 500), rng), np.repeat(values, counts)
    assert sums.mean() == pytest.approx(500 * all_values.mean(), rel=0.001) and sums.var() == pytest.approx(500 * all_values.var(), rel=0.05)
    held = st._sums(np.array([1.0, np.inf]), np.array([1000, 30]), np.full(500, 10), rng)
    assert not np.isnan(held).any() and 0.6 < np.mean(held == 10) < 0.9 and np.isinf(held).any()
