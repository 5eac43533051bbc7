"""Chunkers, indexes, fusion, caches and agents on small inputs."""

import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmark.operators import agents, chunking, dense, fusion, ranking, sparse
from quillmark.sources import stores


def test_fixed_and_hard():
    assert chunking.hard("abcdefghij", 4, 1) == ["abcd", "defg", "ghij"]
    assert chunking.hard("", 4) == [] and chunking.fixed("", 4) == []
    assert chunking.fixed("aaa bbb ccc ddd", 9, 0) == ["aaa bbb", " ccc ddd"]
    assert chunking.fixed("a bbbbbbbbbbbb", 8, 0) == ["a bbbbbb", "bbbbbb"]


def test_sentences():
    text = "One is. Two is. Three is. Four is. Five is."
    assert chunking.sentence(text, 160) == ["One is. Two is.", "Three is. Four is.", "Five is."]
    assert chunking.sentence(text, 240, 80) == ["One is. Two is. Three is.", "Three is. Four is. Five is."]
    assert chunking.sentence("  ", 100) == []


def test_paragraphs():
    assert chunking.paragraph("aa\n\nbb\n \ncc", 5, 0) == ["aa\n\nbb", "cc"]
    assert chunking.paragraph("aa\n\nbb\n\ncc", 5, 2) == ["aa\n\nbb", "bb\n\ncc"]
    big = "First one here. Second one here. Third."
    assert chunking.paragraph(f"{big}\n\nx", 20, 0) == ["First one here.", "Second one here.", "Third.", "x"]
    assert chunking.paragraph(f"x\n\n{big}", 20, 0) == ["x", big]


def test_recursive():
    text = "Alpha beta gamma. Delta epsilon zeta.\nEta theta iota. Kappa lambda mu."
    for size in (8, 20, 40):
        pieces = chunking.recursive(text, size, 0)
        assert all(len(p) <= size for p in pieces) and re.sub(r"[\s.]", "", "".join(pieces)) == re.sub(r"[\s.]", "", text)
    lapped = chunking.recursive(text, 40, 10)
    assert lapped[1].startswith("zeta. ") or " " in lapped[1]
    assert chunking.recursive("x" * 25, 10, 2) == chunking.hard("x" * 25, 10, 2)
    assert chunking.recursive("  ", 5) == [] and len(chunking.recursive("a b " * 6000, 2, 0)) <= chunking.MOST_CHUNKS + 1
    with pytest.raises(ValueError):
        chunking.strategy("none")


@pytest.mark.parametrize("name", ["fixed", "sentence", "paragraph", "recursive", "hard"])
def test_chunk_operator_is_its_function(spark, table, name):
    docs = table("documents").select(F.col("doc_id").alias("id"), "text")
    got = {(r["parent_id"], r["chunk_index"]): (r["text"], r["total_chunks"]) for r in chunking.chunk(docs, name, 400, 40).collect()}
    want = {}
    for r in docs.collect():
        pieces = chunking.STRATEGIES[name](r["text"], 400, 40)
        want |= {(str(r["id"]), k): (p.strip(), len(pieces)) for k, p in enumerate(pieces) if len(p.strip()) >= 50}
    assert got == want


def test_hard_chunks_are_hard(spark, table):
    docs = table("documents").select(F.col("doc_id").alias("id"), "text")
    got: dict = {}
    for r in chunking.hard_chunks(docs, 300, 30).orderBy("id", "chunk_index").collect():
        got.setdefault(r["id"], []).append(r["text"])
    assert got == {r["id"]: chunking.hard(r["text"], 300, 30) for r in docs.collect()}


def test_hierarchy(spark, table):
    docs = table("documents").select(F.col("doc_id").alias("id"), "text").limit(30)
    rows = chunking.hierarchical(docs).collect()
    assert len({r["child_id"] for r in rows}) == len(rows) and all(r["child_id"].startswith(r["parent_id"] + "_child_") for r in rows)


TEXTS = ["cats chase mice", "dogs chase cats", "stock markets fell", "rain falls", "the moon landing"]


def test_bm25_by_hand(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    asked = spark.createDataFrame([(0, "chase cats"), (1, "unknown"), (2, "Moon")], "query_id long, text string")
    got = {(r["query_id"], r["doc_id"]): (r["score"], r["rank"]) for r in sparse.bm25(docs, asked, 5).collect()}
    lengths = [len(t.split()) for t in TEXTS]
    idf = math.log(1 + (5 - 2 + 0.5) / 2.5)
    want = 2 * idf / (1 + 1.5 * (0.25 + 0.75 * 3 / (sum(lengths) / 5)))
    assert set(got) == {(0, 0), (0, 1), (2, 4)}
    assert got[0, 0] == (pytest.approx(want, abs=1e-8), 0) and got[0, 1][1] == 1


def test_tfidf(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    asked = spark.createDataFrame([(0, "chase cats"), (1, "zzz")], "query_id long, text string")
    rows = sparse.tfidf(docs, asked, 10).collect()
    assert {r["doc_id"] for r in rows} == {0, 1} and all(0 < r["score"] <= 1 for r in rows)
    assert sparse.tfidf(docs, docs.select(F.col("doc_id").alias("query_id"), "text"), 1).agg(F.min("score")).first()[0] == pytest.approx(1)


def hits(spark, rows):
    return spark.createDataFrame(rows, "query_id long, doc_id long, score double, rank int")


def test_rrf(spark):
    d, s = hits(spark, [(0, 1, 0.9, 0), (0, 2, 0.8, 1)]), hits(spark, [(0, 1, 5.0, 0), (0, 3, 4.0, 1)])
    order = lambda a: [(r["doc_id"], r["score"]) for r in fusion.rrf(d, s, 5, a).orderBy("rank").collect()]
    assert order(0.5)[0] == (1, round(1 / 61, 9)) and [x for x, _ in order(0.5)] == [1, 2, 3]
    assert order(1.0) == [(1, round(1 / 61, 9)), (2, round(1 / 62, 9)), (3, 0.0)]
    assert order(0.0) == [(1, round(1 / 61, 9)), (3, round(1 / 62, 9)), (2, 0.0)]
    assert fusion.rrf(d.limit(0), s.limit(0), 5).collect() == []


def test_dense_search_is_exact(spark):
    rng = np.random.default_rng(0)
    x, q = rng.normal(size=(300, 8)), rng.normal(size=(7, 8))
    x[5] = x[6] = x[7]
    index = dense.build(spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "doc_id long, embedding array<double>"))
    asked = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(q)], "query_id long, embedding array<double>")
    s = np.round((q / np.linalg.norm(q, axis=1)[:, None]) @ (x / np.linalg.norm(x, axis=1)[:, None]).T, 9)
    want = {(k, int(j), r) for k in range(7) for r, j in enumerate(np.lexsort((np.arange(300), -s[k]))[:10])}
    assert {(r["query_id"], r["doc_id"], r["rank"]) for r in dense.search(index, asked).collect()} == want
    assert {(r["query_id"], r["doc_id"], r["rank"]) for r in dense.search_sharded(index, asked).collect()} == want
    assert dense.search(index, asked, 1000).count() == 2100


def test_hierarchical_search(spark):
    kids = spark.createDataFrame([(1, 10, [1.0, 0.0]), (2, 10, [0.9, 0.1]), (3, 20, [0.0, 1.0])], "doc_id long, parent_id long, v array<double>")
    asked = spark.createDataFrame([(0, [1.0, 0.0])], "query_id long, embedding array<double>")
    assert [(r["doc_id"], r["matched_child"], r["rank"]) for r in dense.search_hierarchical(kids, asked, 2).orderBy("rank").collect()] == [(10, 1, 0), (20, 3, 1)]


def test_vectors_without_values_take_no_part(spark):
    index = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [None, 1.0]), (4, [0.0, 1.0])], "doc_id long, v array<double>")
    asked = spark.createDataFrame([(0, [1.0, 0.0]), (1, None), (2, [None, 1.0])], "query_id long, embedding array<double>")
    assert [(r["query_id"], r["doc_id"], r["score"]) for r in dense.search(index, asked, 5).orderBy("rank").collect()] == [(0, 1, 1.0), (0, 4, 0.0)]
    ragged = spark.createDataFrame([(1, [1.0]), (2, [1.0, 0.0, 0.0])], "doc_id long, v array<double>").coalesce(1)
    with pytest.raises(Exception, match="different lengths"):
        dense.search(ragged, asked, 5).collect()


def test_expansions_keep_the_first(spark):
    rows = [(0, 0, 1, "same", 0.5, 0), (0, 1, 2, "same", 0.9, 0), (0, 1, 3, "other", 0.7, 1)]
    got = fusion.merge_expansions(spark.createDataFrame(rows, "query_id long, expansion int, doc_id long, text string, score double, rank int"), 5)
    assert [(r["doc_id"], r["score"]) for r in got.orderBy("rank").collect()] == [(3, 0.7), (1, 0.5)]


def test_rerank(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    asked = spark.createDataFrame([(0, "dogs chase")], "query_id long, text string")
    got = fusion.rerank(hits(spark, [(0, 0, 2.0, 0), (0, 1, 1.0, 1)]), asked, docs, 1).first()
    assert (got["doc_id"], got["rank"], got["retrieval_rank"], got["rerank_score"]) == (1, 1, 2, 1.0)


def test_ties(spark):
    rows = spark.createDataFrame([(k, float(s)) for k, s in enumerate([5, 4, 4, 3, 1])], "id long, s double")
    assert ranking.with_ties(rows, "s", 2).count() == 3
    assert [r["id"] for r in ranking.best_by(rows, "s", 2).collect()] == [0, 1]


def test_caches(spark, tmp_path):
    cache = stores.embedding_cache(spark, f"file://{tmp_path}/e")
    embed = F.udf(lambda t: [float(len(t))], "array<float>")
    texts = spark.createDataFrame([("a",), ("bb",), ("a",)], "text string")
    assert sorted(r["embedding"][0] for r in stores.embed_missing(texts, cache, "m", embed).collect()) == [1, 1, 2]
    cache.put(cache.table().withColumn("embedding", F.array(F.lit(9.0).cast("float"))))
    assert cache.table().count() == 2 and cache.table().agg(F.max(F.get("embedding", F.lit(0)))).first()[0] == 2
    assert cache.stats(F.size("embedding") * 4).first()["bytes"] == 8
    cache.clear("m")
    assert cache.table().count() == 0


def test_index_stores(spark, tmp_path):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    stores.save_sparse(sparse.postings(docs), f"file://{tmp_path}/s")
    assert stores.load_sparse(spark, f"file://{tmp_path}/s").postings.count() == sparse.postings(docs).postings.count()
    index = spark.createDataFrame([(1, [1.0])], "doc_id long, v array<double>")
    stores.save_dense(index, f"file://{tmp_path}/d", 2)
    assert stores.load_dense(spark, f"file://{tmp_path}/d").collect() == index.collect()
    assert stores.artifacts(spark, f"file://{tmp_path}") == ["d", "s"]


def test_agents(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    asked = spark.createDataFrame([(0, "chase cats"), (1, "moon"), (2, "zzz")], "query_id long, text string")
    search = lambda q: sparse.bm25(docs, q.select("query_id", "text"), 2).join(docs, "doc_id").select("query_id", "doc_id", "text", "score", "rank")
    says = lambda text: agents.model_slot(lambda p: p.map(lambda _: text))
    got = agents.iterative(asked, search, says("INSUFFICIENT"), says("moon"), says("x"), k=2, rounds=2).collect()
    assert {r["query_id"]: r["iterations"] for r in got} == {0: 2, 1: 2, 2: 2}
    assert {r["query_id"]: len(r["docs"]) for r in got} == {0: 3, 1: 1, 2: 1}
    assert {r["route"] for r in agents.self_reflective(asked, search, says("CONFIDENCE: 0.9"), says("x")).collect()} == {"direct"}
    back = agents.self_reflective(asked, search, says("CONFIDENCE: 0.1"), says("x"), says("NOT_SUPPORTED")).collect()
    assert {(r["route"], r["docs"]) for r in back} == {("fallback", None)}
    assert agents.pending(asked, asked.filter("query_id = 1")).count() == 2

    def fails(batch):
        raise ValueError("no")

    said = [r["prediction"] for r in agents.direct(spark.range(200).select(F.col("id").alias("query_id"), F.lit("q").alias("text")).coalesce(1), agents.guarded(fails, 2, 10)).collect()]
    assert sum(s.startswith("[ERROR: no") for s in said) == 20 and sum(s.startswith("[ABORTED:") for s in said) == 180


def test_stop_words_of_a_language(spark):
    docs = spark.createDataFrame([(1, "the cat and the dog"), (2, "a dog that is not there")], "doc_id long, text string")
    asked = spark.createDataFrame([(7, "the and that"), (8, "the dog")], "query_id long, text string")
    assert {"the", "and", "not"} <= set(sparse.stop_words_of()) and all(len(w) > 1 for w in sparse.stop_words_of())
    assert {r["query_id"] for r in sparse.tfidf(docs, asked).collect()} == {7, 8}
    assert {(r["query_id"], r["doc_id"]) for r in sparse.tfidf(docs, asked, stop_words="english").collect()} == {(8, 1), (8, 2)}


def test_counts_in_the_row(spark):
    rows = spark.createDataFrame([(["b", "a", "b", "c", "b"],), ([],), (["x"],)], "w array<string>")
    assert [[tuple(c) for c in r[0]] for r in rows.select(sparse._counts(F.col("w"))).collect()] == [[("a", 1), ("b", 3), ("c", 1)], [], [("x", 1)]]


def test_pieces_leave_in_bounded_batches(monkeypatch):
    """However many documents come at once, a task holds no more than some of their pieces."""
    import pyarrow as pa

    monkeypatch.setattr(chunking, "HELD", 1000)
    batch = pa.RecordBatch.from_arrays([pa.array(["a", "b", "c"]), pa.array(["One is here. " * 200, None, "Two. " * 100])], names=["id", "text"])
    out = list(chunking._rows(lambda t: chunking.sentence(t, 160), 1, None)(iter([batch])))
    assert len(out) > 2 and max(sum(map(len, b.column(3).to_pylist())) for b in out) < 1200
    assert sum(b.num_rows for b in out) == len(chunking.sentence("One is here. " * 200, 160)) + len(chunking.sentence("Two. " * 100, 160))


def test_postings_are_in_parts_by_size_of_the_texts(spark):
    """By their own small size they would be joined to few parts; and texts are dealt without a sort of whole rows."""
    docs = spark.createDataFrame([(1, "red fish"), (2, "blue fish fish")], "doc_id long, text string").coalesce(1)
    plan = sparse.postings(docs).postings._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and "RoundRobin" not in plan, plan


def test_a_saved_index_counts_terms_once(spark, tmp_path):
    docs = spark.createDataFrame([(1, "red fish"), (2, "blue fish fish"), (3, "")], "doc_id long, text string")
    seen = spark.sparkContext.accumulator(0)

    def passed(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    stores.save_sparse(sparse.postings(docs.mapInArrow(passed, docs.schema)), str(tmp_path))
    index = stores.load_sparse(spark, str(tmp_path))
    assert seen.value == 3
    assert {tuple(r) for r in index.terms.collect()} == {("red", 1), ("blue", 1), ("fish", 2)} and index.size.first()["n"] == 3 and index.postings.count() == 4
