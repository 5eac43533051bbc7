"""The proximity graph: recall against exact search, bounded degrees, odd vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmark.operators import dense, graph
from quillmark.session import new_folder


@pytest.fixture(scope="module")
def loose(spark):
    rng = np.random.default_rng(9)
    around = rng.normal(size=(15, 16))
    v = around[rng.integers(0, 15, 1200)] + 0.8 * rng.normal(size=(1200, 16))
    vectors = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "doc_id long, embedding array<double>").repartition(2).cache()
    asked = spark.createDataFrame([(i, (v[i * 29] + 0.3 * rng.normal(size=16)).tolist()) for i in range(40)], "query_id long, embedding array<double>").cache()
    return vectors, asked


def test_recall_and_degrees(spark, loose):
    vectors, asked = loose
    made = graph.build(vectors, new_folder(spark, "graph"), degree=12)
    exact = dense.search(dense.build(vectors), asked, 10)
    found = graph.search(made, asked, 10, width=48)
    assert found.join(exact, ["query_id", "doc_id"]).count() >= 0.9 * 400 and found.count() == 400
    nodes = made.nodes()
    assert nodes.count() == 1200 and nodes.agg(F.max(F.size("near"))).first()[0] <= 24
    links = nodes.select("doc_id", F.explode("near").alias("to"))
    assert links.filter("doc_id = to").isEmpty()
    true = dense.search(dense.build(vectors), vectors.select(F.col("doc_id").alias("query_id"), "embedding").filter("query_id < 100"), 13).filter("query_id <> doc_id")
    met = links.filter("doc_id < 100").join(true.select(F.col("query_id").alias("doc_id"), F.col("doc_id").alias("to")), ["doc_id", "to"]).count()
    assert met >= 0.9 * true.count()


def test_odd_vectors(spark):
    schema = "doc_id long, embedding array<double>"
    asked = spark.createDataFrame([(7, [1.0, 1.0]), (8, None)], "query_id long, embedding array<double>")
    some = graph.build(spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [0.0, 2.0])], schema), new_folder(spark, "graph"))
    assert [tuple(r) for r in graph.search(some, asked, 5).orderBy("rank").collect()] == [(7, 1, 0.707106781, 0), (7, 4, 0.707106781, 1), (7, 3, 0.0, 2)]
    none = graph.build(spark.createDataFrame([], schema), new_folder(spark, "graph"))
    assert graph.search(none, asked).collect() == []


def test_first_links_are_near(spark, loose):
    """One round after the first links finds nine in ten: a table of n vectors needs few rounds, each of which ships up to 33 vectors a vector."""
    vectors, _ = loose
    links = graph.build(vectors, new_folder(spark, "graph"), degree=12, rounds=1).nodes().filter("doc_id < 100").select("doc_id", F.explode("near").alias("to"))
    true = dense.search(dense.build(vectors), vectors.select(F.col("doc_id").alias("query_id"), "embedding").filter("query_id < 100"), 13).filter("query_id <> doc_id")
    assert links.join(true.select(F.col("query_id").alias("doc_id"), F.col("doc_id").alias("to")), ["doc_id", "to"]).count() >= 0.9 * true.count()


def test_vectors_that_have_met_are_not_compared_again():
    import pyarrow as pa

    own = [{"id": i, "v": [1.0, float(i)], "least": float("-inf"), "new": i == 2} for i in range(4)]
    kind = pa.list_(pa.struct([("id", pa.int64()), ("v", pa.list_(pa.float32())), ("least", pa.float64()), ("new", pa.bool_())]))
    (met,) = graph._among(3)(iter([pa.RecordBatch.from_arrays([pa.array([own], kind)], names=["own"])]))
    assert {(r["a"], r["b"]) for r in met.to_pylist()} == {(0, 2), (1, 2), (3, 2), (2, 0), (2, 1), (2, 3)}
