"""Poisson weights against resampling in numpy, and that groups stay where they are."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmark.operators import poisson
from quillmark.operators import statistics as st


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(4)
    data = [(i, "ab"[i % 2], f"s{i % 3}", ["direct", "rag"][i % 5 > 1], float(rng.normal(0.5 + 0.1 * (i % 2) + 0.05 * (i % 5 > 1), 0.2))) for i in range(4000)]
    data += [(9001, "c", "s0", "rag", 0.5), (9002, "c", "s0", "rag", None), (9003, None, "s0", "rag", 0.1), (9004, "c", "s1", "rag", 0.7)]
    return spark.createDataFrame(data, "id long, model string, dataset string, exp_type string, f1 double").repartition(5).cache()


def test_weights_are_poisson():
    w = poisson.weights(np.arange(2000), np.arange(500))
    share = [np.mean(w == k) for k in range(5)]
    assert abs(w.mean() - 1) < 0.005 and abs(w.var() - 1) < 0.01 and np.allclose(share, [np.exp(-1) / f for f in (1, 1, 2, 6, 24)], atol=0.003)
    assert abs(np.corrcoef(w[:, 0], w[:, 1])[0, 1]) < 0.08 and (poisson.weights(np.array([7]), np.arange(500)) == w[7]).all()


@pytest.mark.parametrize("stratum", [None, "dataset"])
def test_intervals_agree(rows, stratum):
    got = {r["model"]: r for r in poisson.interval(rows, "model", "f1", "id", stratum, times=2000).collect()}
    want = {r["model"]: r for r in st.bootstrap_ci(rows, "model", "f1", stratum, times=2000).collect()}
    assert set(got) == set(want) == {"a", "b", "c"} and got["c"]["low"] is None and got["c"]["n"] == 2
    for m in "ab":
        assert got[m]["mean"] == pytest.approx(want[m]["mean"]) and got[m]["n"] == want[m]["n"]
        assert got[m]["low"] == pytest.approx(want[m]["low"], abs=0.001) and got[m]["high"] == pytest.approx(want[m]["high"], abs=0.001)


def test_tests_agree(rows):
    pairs = rows.withColumn("g", F.col("f1") + 0.003 * (F.col("id") % 7) - 0.009)
    for got, want in (
        (poisson.paired(pairs.filter("model is not null and model <> 'c'"), "model", "f1", "g", "id", times=2000), st.paired_bootstrap(pairs.filter("model <> 'c'"), "model", "f1", "g", times=2000)),
        (poisson.unpaired(rows, "model", "f1", "id", times=2000), st.unpaired_bootstrap(rows, "model", "f1", times=2000)),
    ):
        got, want = ({r["model"]: r for r in x.collect()} for x in (got, want))
        assert set(got) == set(want)
        for m in got:
            assert (got[m]["n_a"], got[m]["n_b"]) == (want[m]["n_a"], want[m]["n_b"])
            for c in ("diff", "low", "high", "p"):
                assert got[m][c] == want[m][c] or got[m][c] == pytest.approx(want[m][c], abs=0.03 if c == "p" else 0.002)


def test_ranking_agrees(rows):
    got = {r["model"]: (r["usual_rank"], r["share"]) for r in poisson.ranking(rows.filter("model <> 'c'"), "model", "f1", "id").collect()}
    assert got == {"b": (1, 1.0), "a": (2, 1.0)}


def test_no_group_is_gathered_and_dealing_does_not_show(rows):
    plan = poisson.interval(rows, "model", "f1", "id")._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroups" not in plan and "MapInArrow" in plan
    one, other = (sorted((r["model"], r["draw"], round(r["m"], 9)) for r in poisson.draws(d.filter("model is not null"), ["model"], "f1", "id", 20).collect()) for d in (rows, rows.repartition(1)))
    assert one == other
