"""Nulls in any column, empty and very long texts, repeated rows, empty tables and clashing names, for every operator."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillmark.llm import embedding_dedup, html, language, lines, mixing, nearest, packing, queries, simhash, substrings, urls

LONG = " ".join(f"w{k % 7919} long{k % 13}\nline" for k in range(60_000))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h string, at int, g long, did long, tag string, starts string, row string"
ROWS = [
    (1, "the cat sat on the mat and then it went to sleep again until noon came", "en", "b", None, "x", 1, 1, 1, "t", "s", "r"),
    (1, "the cat sat on the mat and then it went to sleep again until noon came", "en", "b", None, "x", 1, 1, 1, "t", "s", "r"),
    (1, "another text under the same id", "en", "b", 3, None, None, None, None, None, None, None),
    (2, None, None, None, None, None, None, None, None, None, None, None),
    (3, "", "en", "a", 0, None, None, None, None, None, None, None),
    (4, " \n\t ", "en", None, 4, None, None, None, None, None, None, None),
    (None, "the cat sat on the mat and then it went to sleep again until noon came", None, "b", 1, None, None, None, None, None, None, None),
    (None, "le chat est sur le tapis", "fr", "", 1, None, None, None, None, None, None, None),
    (7, LONG, "en", "c", 1, None, None, None, None, None, None, None),
    (8, LONG, "en", "c", 1, None, None, None, None, None, None, None),
    (9, "1234 !!", "en", "c", 1, None, None, None, None, None, None, None),
    (10, "a\nb\nc\na\nb\nc\nd", "en", "c", 1, None, None, None, None, None, None, None),
]
OVER_DOCUMENTS = {1: mixing.op1, 3: language.op3, 6: substrings.op6, 7: packing.op7, 8: simhash.op8, 10: lines.op10}
PER_ROW = (1, 3, 6, 8, 10)


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.mark.parametrize("n", OVER_DOCUMENTS)
def test_odd_documents(odd, n):
    rows = OVER_DOCUMENTS[n](odd).collect()
    if n in PER_ROW:
        assert len(rows) == len(ROWS)
        assert sorted(str(r["doc_id"]) for r in rows) == sorted(str(r[0]) for r in ROWS)


@pytest.mark.parametrize("n", OVER_DOCUMENTS)
def test_no_documents(odd, n):
    assert OVER_DOCUMENTS[n](odd.limit(0)).collect() == []


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages(spark, odd, name, stage):
    out = stage(spark, odd, "")
    assert stage(spark, odd.limit(0), "").collect() == []
    out.collect()
    if name != corpus_pipeline.STAGES[-1][0]:
        assert out.schema.names == odd.schema.names and [f.dataType for f in out.schema] == [f.dataType for f in odd.schema]


def test_odd_pages(spark):
    page = "<html><body><nav>m</nav><p>text " + "word " * 50_000 + "</p></body></html>"
    rows = [(1, "http://A.com/x/1", page, "h"), (1, "http://A.com/x/1", page, "h"), (2, None, None, None), (None, "nothing", "", None), (3, "http://", "<p>a", None), (4, "https://a.com?x", "<", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host string")
    done = {(r["page_id"], r["url"]): r for r in html.op9(pages).collect()}
    assert html.op9(pages).count() == 6 and done[(2, None)]["text"] == "" and done[(3, "http://")]["text"] == "a"
    judged = urls.op5(pages).collect()
    assert len(judged) == 6 and {r["verdict"] for r in judged} == {"allow"}
    assert {(r["host"], r["path"]) for r in judged} == {("a.com", "/x/1"), ("", ""), ("a.com", "")}
    assert html.op9(pages.limit(0)).collect() == [] and urls.op5(pages.limit(0)).collect() == []


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [1.0, None]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [1.0, 2.0, 3.0]), (9, []), (None, [0.0, 1.0]), (100, [0.0, -1.0]), (200, None)]
    vectors = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<double>, rep int, n int")
    found = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup.op2(vectors).collect()}
    assert len(found) == 13 and found[0] == (2, 0, True) and found[1] == (2, 0, False) and found[2] == (2, 0, False)
    assert all(found[k] == (0, k, True) for k in (3, 4, 5, 6, 7, 8, 9, None, 100, 200))
    near = nearest.op4(vectors).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["vec_id"]) for r in near] == [(0, 2), (0, 1), (0, 100), (0, None), (100, 0), (100, 2), (100, None), (100, 1)]
    assert embedding_dedup.op2(vectors.limit(0)).collect() == [] and nearest.op4(vectors.limit(0)).collect() == []
    assert nearest.op4(vectors.filter("vec_id = 4")).collect() == []


def test_removed_passages(odd):
    rows = {(r["doc_id"], r["n_words"]): r["n_removed"] for r in substrings.op6(odd).collect()}
    assert rows[(1, 16)] == 0 and rows[(None, 16)] == 16 and rows[(8, 180_000)] == 180_000 and rows[(7, 180_000)] == 0


def test_removed_lines(odd):
    done = lines.documents_without_repeats(odd)
    assert done.filter("doc_id = 10").first()["text"] == "a\nb\nc\nd"
    assert done.filter("doc_id = 8").first()["text"] == ""
    assert done.filter("doc_id = 2").first()["text"] is None and done.filter("doc_id = 4").first()["n_chars"] == 4


def test_one_of_each_group_stays(odd):
    kept = simhash.deduplicate(odd).select("doc_id", "text").collect()
    # Of twelve rows: the cat's text stays under 1, LONG under 7, one empty text under 2, and each unlike text of an id or of none.
    want = [(1, ROWS[0][1]), (1, ROWS[2][1]), (2, None), (None, ROWS[7][1]), (7, LONG), (9, ROWS[10][1]), (10, ROWS[11][1])]
    assert sorted(((r["doc_id"], r["text"]) for r in kept), key=str) == sorted(want, key=str)


def test_every_operator_has_its_query():
    names = queries.queries()
    assert all(sum(name.startswith(f"op{k}_") for name in names) == 1 for k in range(1, 11)) and "pipeline" in names
    assert set(queries.oracle_sql()) <= set(names)


def test_mixed_copies(spark, odd):
    done = mixing.mixed_documents(odd.select("doc_id", "text", F.lit("s").alias("source")).filter("doc_id in (7, 9)"))
    assert done.filter("doc_id = 7").first()["text"] == LONG
