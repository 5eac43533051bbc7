"""Inverted lists, plain and with codes: recall against exact search, pruned plans, stopped builds."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmark.operators import dense, inverted
from quillmark.session import new_folder


@pytest.fixture(scope="module")
def loose(spark):
    """4,000 vectors around 40 directions, 24 coordinates, and 60 queries near some of them."""
    rng = np.random.default_rng(5)
    around = rng.normal(size=(40, 24))
    v = around[rng.integers(0, 40, 4000)] + 0.7 * rng.normal(size=(4000, 24))
    vectors = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "doc_id long, embedding array<double>").repartition(4).cache()
    asked = spark.createDataFrame([(i, (v[i * 61] + 0.3 * rng.normal(size=24)).tolist()) for i in range(60)], "query_id long, embedding array<double>").cache()
    return vectors, asked


def _recall(found, exact) -> float:
    return found.join(exact, ["query_id", "doc_id"]).count() / exact.count()


def test_recall_of_lists(spark, loose):
    vectors, asked = loose
    index = inverted.build(vectors, new_folder(spark, "ivf"))
    exact = dense.search(dense.build(vectors), asked, 10)
    assert index.table().count() == 4000 and len(index.centres()) == inverted.lists_for(4000) == 126
    assert _recall(inverted.search(index, asked, 10), exact) >= 0.9
    all_lists = inverted.search(index, asked, 10, probes=126)
    assert all_lists.select("query_id", "doc_id", "rank").exceptAll(exact.select("query_id", "doc_id", "rank")).isEmpty()


def test_plan_reads_probed_lists_only(spark, loose):
    vectors, asked = loose
    index = inverted.build(vectors, new_folder(spark, "ivf"), lists=64)
    plan = inverted.search(index, asked.limit(1), 5, probes=3)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cast(list" in plan or "PartitionFilters: [list" in plan, plan


def test_hot_lists_are_split_and_queries_dealt(spark, loose, monkeypatch):
    vectors, asked = loose
    monkeypatch.setattr(inverted, "PART", 100)
    monkeypatch.setattr(inverted, "QUERY_BLOCK", 7)
    index = inverted.build(vectors, new_folder(spark, "ivf"), lists=2)
    assert index.table().groupBy("list", "part").count().agg(F.max("count")).first()[0] < 200
    exact = dense.search(dense.build(vectors), asked, 10).select("query_id", "doc_id", "rank")
    assert inverted.search(index, asked, 10, probes=2).select("query_id", "doc_id", "rank").exceptAll(exact).isEmpty()


def test_codes_are_small_and_found_again(spark, loose):
    vectors, asked = loose
    whole, coded = inverted.build(vectors, new_folder(spark, "ivf"), lists=64), inverted.build(vectors, new_folder(spark, "pq"), lists=64, subs=6)
    exact = dense.search(dense.build(vectors), asked, 10)
    assert _recall(inverted.search(coded, asked, 10, vectors=vectors), exact) >= 0.9
    assert coded.table().select(F.max(F.length("code"))).first()[0] == 6 and coded.bytes() < whole.bytes() / 2
    with pytest.raises(ValueError, match="scored again"):
        inverted.search(coded, asked)


def test_codes_are_nearest_words():
    rng = np.random.default_rng(1)
    rest, books = rng.normal(size=(50, 6)), rng.normal(size=(3, 17, 2))
    codes = inverted.encode(rest, books)
    plain = [[int(np.argmin(((books[s] - x[2 * s : 2 * s + 2]) ** 2).sum(axis=1))) for s in range(3)] for x in rest]
    assert codes.tolist() == plain


@pytest.mark.parametrize("subs", [0, 6])
def test_a_stopped_build_goes_on(spark, loose, subs):
    """Stopped before its third batch, a build keeps two, learns nothing anew, and ends in the table of one that ran through."""
    vectors, _ = loose
    path = new_folder(spark, "stopped")

    def stop(batch: int) -> None:
        if batch == 2:
            raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        inverted.build(vectors, path, lists=64, subs=subs, batch_rows=1000, stop=stop)
    half = inverted.Inverted(spark, path)
    before = half.centres()
    assert sorted(r[0] for r in half.table().select("batch").distinct().collect()) == [0, 1]
    begun = []
    done = inverted.build(vectors, path, lists=64, subs=subs, batch_rows=1000, stop=begun.append)
    assert begun == [2, 3] and (done.centres() == before).all()
    straight = inverted.build(vectors, new_folder(spark, "straight"), lists=64, subs=subs, batch_rows=1000)
    columns = ["doc_id", "list", "batch"] + (["code"] if subs else [])
    assert done.table().count() == 4000 and done.table().select(columns).exceptAll(straight.table().select(columns)).isEmpty()


def test_a_batch_tried_again_replaces_itself(spark, loose):
    vectors, _ = loose
    index = inverted.build(vectors, new_folder(spark, "again"), lists=64, batch_rows=2000)
    inverted.add_batch(index, inverted.normal(vectors).filter("doc_id < 100"), 7)
    inverted.add_batch(index, inverted.normal(vectors).filter("doc_id < 50"), 7)
    assert index.table().filter("batch = 7").count() == 50


def test_batches_do_not_grow_with_the_table(spark, loose):
    """4,000 vectors in batches of ten are no 400 batches, and all of them are in the index."""
    vectors, asked = loose
    begun = []
    index = inverted.build(vectors, new_folder(spark, "many"), lists=4, batch_rows=10, stop=begun.append)
    assert begun == list(range(inverted.MOST_BATCHES)) and index.table().select("doc_id").distinct().count() == 4000
    exact = dense.search(dense.build(vectors), asked, 10).select("query_id", "doc_id", "rank")
    assert inverted.search(index, asked, 10, probes=4).select("query_id", "doc_id", "rank").exceptAll(exact).isEmpty()


def test_odd_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, None), (3, [None, 1.0]), (4, [0.0, 0.0]), (5, []), (1, [1.0, 0.0])]
    index = inverted.build(spark.createDataFrame(rows, "doc_id long, embedding array<double>"), new_folder(spark, "odd"))
    asked = spark.createDataFrame([(9, [2.0, 0.0]), (8, None)], "query_id long, embedding array<double>")
    assert [(r["query_id"], r["doc_id"], r["score"]) for r in inverted.search(index, asked, 5, probes=64).orderBy("rank").collect()] == [(9, 1, 1.0), (9, 1, 1.0), (9, 4, 0.0)]
    with pytest.raises(ValueError, match="no vector"):
        inverted.build(spark.createDataFrame([], "doc_id long, embedding array<double>"), new_folder(spark, "none"))
    with pytest.raises(ValueError, match="divide"):
        inverted.build(spark.createDataFrame(rows, "doc_id long, embedding array<double>"), new_folder(spark, "three"), subs=3)
