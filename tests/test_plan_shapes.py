"""Plans are the ones wanted: columns pruned, top-k cut before the shuffle, joins of small sides left to Spark's size check."""

import re

from pyspark.sql import functions as F

from quillmark import session
from quillmark.operators import compare, ranking, sparse
from quillmark.queries import bindings


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_scan_reads_what_is_asked(spark):
    text = plan(compare.compare(bindings.results(spark, "/root/testdata/sf0.001"), "model", "f1"))
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", text)
    assert any("o_totalprice" in s and "o_orderdate" not in s for s in schemas) and not any("c_name" in s for s in schemas)


def test_filters_reach_the_scan(spark, table):
    text = plan(table("orders").filter("o_orderkey > 10").groupBy("o_orderstatus").agg(F.count("*")))
    assert "GreaterThan(o_orderkey,10)" in text


def test_top_k_is_cut_before_the_shuffle(spark):
    rows = spark.range(1000).select((F.col("id") % 7).alias("q"), F.col("id"), F.rand(1).alias("s"))
    text = plan(ranking.best(rows, ["q"], [F.desc("s")], 3))
    assert text.count("WindowGroupLimit") == 2


def test_bm25_keeps_query_terms_only(spark, table):
    docs, asked = table("documents").select("doc_id", "text"), table("benchmark").select(F.col("item_id").alias("query_id"), "text")
    assert "LeftSemi" in plan(sparse.bm25(docs, asked)) and "Python" not in plan(sparse.bm25(docs, asked))


def test_postings_are_dealt_by_document_once(spark, table):
    docs, asked = table("documents").select("doc_id", "text"), table("benchmark").select(F.col("item_id").alias("query_id"), "text")
    for text in (plan(sparse.bm25(docs, asked)), plan(sparse.tfidf(docs, asked))):
        assert re.search(r"hashpartitioning\(doc_id#\d+L?, \d+\), REPARTITION", text) and not re.search(r"hashpartitioning\(doc_id#\d+L?, term", text)
        assert not re.search(r"DataFilters: \[[^\]]*regexp_extract_all", text)  # tokens are not made in the scan as well


def test_scans_of_one_file_are_spread(spark, table):
    docs = table("documents")
    assert docs.rdd.getNumPartitions() == 1 and session.spread(docs).rdd.getNumPartitions() == 4 and session.spread(docs.repartition(9)).rdd.getNumPartitions() == 9


def test_metrics_do_not_shuffle(spark):
    from quillmark.operators import metrics

    rows = spark.createDataFrame([(1, "a", ["a"], ["c"])], "pred_id long, prediction string, references array<string>, contexts array<string>")
    text = plan(metrics.evaluate(rows, list(metrics.REGISTRY)))
    assert "Exchange" not in text and "Python" not in text


def test_synergy_reads_its_rows_once(spark):
    rows = bindings.results(spark, "/root/testdata/sf0.001")
    compare.synergy(rows, "model", "retriever", "f1")
    assert "Expand" in plan(compare.synergy(rows, "model", "retriever", "f1"))


def test_tfidf_exchanges_texts_not_postings(spark, table):
    docs, asked = table("documents").select("doc_id", "text"), table("benchmark").select(F.col("item_id").alias("query_id"), "text")
    below = plan(sparse.tfidf(docs, asked)).split(", REPARTITION")[1:]
    assert below and all("Generate" not in x[: x.index("Scan")] for x in below)


def test_tfidf_of_rows_that_share_an_id(spark):
    docs = spark.createDataFrame([(1, "aa bb"), (1, "aa cc"), (2, "bb bb dd"), (3, None), (None, "dd")], "doc_id long, text string")
    merged = spark.createDataFrame([(1, "aa bb aa cc"), (2, "bb bb dd"), (3, ""), (None, "dd"), (4, None)], "doc_id long, text string")  # as many rows
    asked = spark.createDataFrame([(0, "aa bb bb"), (1, "dd zz"), (2, None)], "query_id long, text string")
    found, same = ([tuple(r) for r in sparse.tfidf(x, asked).orderBy("query_id", "rank").collect()] for x in (docs, merged))
    assert found == same and [(q, d) for q, d, *_ in found] == [(0, 2), (0, 1), (1, 2)]  # rows without an id are no hits


def test_asked_terms_are_picked_before_they_are_counted(spark, table, monkeypatch):
    docs, asked = table("documents").select("doc_id", "text"), table("benchmark").select(F.col("item_id").alias("query_id"), "text")
    picked = sparse.bm25(docs, asked, 3)
    lines = [x for x in plan(picked).splitlines() if "sort_array" in x]
    assert lines and all("filter(" in x and "IN" in x for x in lines)
    found = sorted(map(tuple, picked.collect()))
    monkeypatch.setattr(sparse, "MOST_PICKED", 1)  # more terms than are picked
    assert found == sorted(map(tuple, sparse.bm25(docs, asked, 3).collect()))
