"""Grids, lifecycle, readers of result folders and question sets, and streams."""

import json

import pytest
from pyspark.sql import functions as F

from quillmark.plans import grid, lifecycle
from quillmark.sources import corpora, results, stores
from quillmark.streaming import incremental

OPTIONS = {"model": ["hf:a/m-1", "hf:a/m-2"], "dataset": ["nq"], "prompt": ["p"], "retriever": ["dense_x", "hybrid_x"], "top_k": [3, 5], "query_transform": ["none"], "reranker": ["none"]}


def test_grid(spark):
    specs = grid.rag_specs(grid.product(spark, OPTIONS), [10, 60], [0.5])
    assert specs.count() == 4 + 8 and specs.select("name").distinct().count() == 12
    assert specs.filter("rrf_k is null").select("retriever").distinct().collect()[0][0] == "dense_x"
    direct = grid.direct_specs(grid.product(spark, {k: OPTIONS[k] for k in grid.DIRECT_OPTIONS}))
    assert grid.all_specs(specs, direct).count() == 14
    assert direct.filter(F.startswith("name", F.lit("direct_m1_nq_"))).count() == 1


def test_samples(spark):
    specs = grid.rag_specs(grid.product(spark, OPTIONS), [10, 60], [0.5])
    few = grid.sample(specs, 5)
    assert few.collect() == grid.sample(specs.repartition(3), 5).collect() and few.count() == 5
    assert grid.stratified_sample(specs, ["retriever", "top_k"], 4).select("retriever", "top_k").distinct().count() == 4
    assert grid.not_run(specs, few).count() == 7


def test_singletons(spark):
    rows = spark.createDataFrame([("s", None, 7)], "name string, prompt string, top_k int")
    got = grid.singletons(rows, ["nq", "x"], {"prompt": "concise", "top_k": 5}).orderBy("name").collect()
    assert [(r["name"], r["prompt"], r["top_k"]) for r in got] == [("s_nq", "concise", 7), ("s_x", "concise", 7)]


def test_round_robin(spark):
    fixed = grid.product(spark, {"a": ["x", "y", "z"]})
    got = grid.round_robin(fixed, 4)
    assert got.groupBy("epoch").agg(F.countDistinct("a").alias("n"), F.max("turn").alias("t")).filter("n = 3 and t = 2").count() == 4


def test_space(spark):
    rows = spark.createDataFrame([("m", "d", "rag", "p", None), ("m", "d", "direct", "q", None), ("z", "d", "rag", "p", None)], "model string, dataset string, exp_type string, prompt string, reranker string")
    space = {"model": ["m"], "prompt": ["p"], "reranker": ["none"], "direct_prompt": ["q"]}
    assert rows.filter(grid.in_space(rows, space)).count() == 2
    assert {r["dimension"]: (r["n"], r["values"]) for r in grid.outside_report(rows, space).collect()} == {"model": (1, "z"), "prompt": (1, "q")}


@pytest.mark.parametrize("phase, files, want", [("complete", (True, True, True), "complete"), ("complete", (True, True, False), "generated"), ("generating", (True, True, True), "generating"), ("failed", (True, True, True), "failed"), (None, (False, False, False), "init"), ("complete", (True, False, False), "generating")])
def test_phase(spark, phase, files, want):
    row = spark.range(1).select(lifecycle.proven_phase(F.lit(phase).cast("string"), *map(F.lit, files)).alias("p"))
    assert row.first()["p"] == want


def test_health(spark):
    states = spark.createDataFrame([("a", "complete", ["f1"], ["f1"]), ("b", "complete", ["f1", "em"], ["f1"]), ("c", "complete", ["f1"], ["f1"])], "experiment string, phase string, requested array<string>, computed array<string>")
    asked = spark.createDataFrame([(e, k) for e in "abc" for k in range(3)], "experiment string, idx long")
    done = asked.filter("not (experiment = 'c' and idx = 2)")
    got = {r["experiment"]: (r["missing_predictions"], r["missing_metrics"], r["healthy"]) for r in lifecycle.health(states, asked, done).collect()}
    assert got == {"a": (0, 0, True), "b": (0, 1, False), "c": (1, 0, False)}


def test_repair_and_failures(spark):
    meta = spark.createDataFrame([("rag_x_dense_bge_large_512_k5_raw_raw_concise_nq", None, "kept", None)], "name string, dataset string, prompt string, top_k int")
    got = lifecycle.repaired(meta).first()
    assert (got["dataset"], got["prompt"], got["top_k"]) == ("nq", "kept", 5)
    errors = spark.createDataFrame([("CUDA Out Of Memory",), ("request timed out",), ("?",)], "error string")
    assert {r["pattern"]: r["n"] for r in lifecycle.failure_patterns(errors).collect()}["out_of_memory"] == 1


def test_vectors_checked(spark):
    rows = spark.createDataFrame([("a", [1.0, 0.0]), ("a", [float("nan"), 0.0]), ("b", [0.0, 0.0]), ("c", [3.0])], "key string, v array<double>")
    got = lifecycle.check_vectors(rows, 2).first()
    assert (got["n"], got["duplicates"], got["wrong_size"], got["not_finite"], got["zero"]) == (4, 1, 1, 1, 1)


@pytest.fixture
def study(tmp_path):
    def write(folder, **files):
        (tmp_path / folder).mkdir()
        for name, content in files.items():
            (tmp_path / folder / f"{name}.json").write_text(json.dumps(content))

    write("one", state={"phase": "complete"}, metadata={"model": "m", "dataset": "nq", "type": "rag", "retriever": "simple_minilm_recursive_1024"}, results={"metrics": {"f1": 0.5, "llm_judge_qa": 0.0, "llm_judge": 0.4}, "duration_seconds": 3.0}, predictions={"predictions": [{"idx": 4, "question": "q", "prediction": "p", "expected": ["e"], "metrics": {"f1": 0.25}}]})
    write("two", metadata={"model": "m"}, two_summary={"results": {"exact_match": 0.2}}, predictions={"predictions": [{"question": "q", "prediction": "p", "references": ["r"], "doc_scores": [0.9, 0.8]}]})
    write("three", state={"phase": "failed", "error": "boom"}, results={"metrics": {"f1": 1.0}})
    write("four", state={"phase": "computing_metrics"}, results={"metrics": {"f1": 1.0}})
    write("_tainted", results={"metrics": {"f1": 1.0}})
    return f"file://{tmp_path}"


def test_results_of_folders(spark, study):
    got = {r["name"]: r for r in results.load_all(spark, study).collect()}
    assert sorted(got) == ["four", "one", "two"]
    one = got["one"]
    assert (one["f1"], one["llm_judge"], one["chunk_size"], one["corpus"], one["duration"], one["model"]) == (0.5, 0.4, 1024, "simple", 3.0, "m")
    assert (got["two"]["exact_match"], got["two"]["f1"], got["two"]["llm_judge"], got["two"]["dataset"]) == (0.2, 0.0, None, "unknown")
    assert sorted(r["name"] for r in results.for_analysis(spark, study).collect()) == ["one", "two"]
    assert [(r["name"], r["error"]) for r in results.failed(spark, study).collect()] == [("three", "boom")]


def test_predictions_old_and_new(spark, study):
    got = {r["experiment"]: r for r in results.predictions(spark, study).collect()}
    assert got["one"]["idx"] == 4 and got["one"]["references"] == ["e"]
    assert got["two"]["idx"] == 0 and [(d["rank"], d["score"]) for d in got["two"]["retrieved_docs"]] == [(1, 0.9), (2, 0.8)]
    assert [r["score"] for r in results.item_scores(spark, study).collect()] == [0.25]


def test_comparison_file_comes_first(spark, study):
    with open(study.removeprefix("file://") + "/comparison.json", "w") as file:
        json.dump({"experiments": [{"name": "c", "results": {"f1": 0.1}}, {"name": "d", "metrics": {"bertscore": 0.3}}]}, file)
    got = {r["name"]: r for r in results.load_all(spark, study).collect()}
    assert sorted(got) == ["c", "d"] and got["d"]["bertscore_f1"] == 0.3


def test_articles(spark):
    long = "x" * 120
    rows = spark.createDataFrame([(3, "B", long), (1, "A", long), (2, "A", long), (4, "C", "short"), (9, "d_d", long)], "at long, title string, text string")
    assert [(r["id"], r["title"]) for r in corpora.articles(rows, "at").orderBy("id").collect()] == [("wiki_1", "A"), ("wiki_2", "B"), ("wiki_3", "d_d")]
    allowed = spark.createDataFrame([("D d",)], "title string")
    assert [r["title"] for r in corpora.articles(rows, "at", allowed).collect()] == ["d_d"]
    assert corpora.articles(rows, "at", most=1).count() == 1


def test_rank_scores(spark, tmp_path):
    (tmp_path / "r.csv").write_text("page_name,score\nA_b,3\nC,2\nD,2\nE,bad\n")
    got = corpora.rank_scores(spark, f"file://{tmp_path}/r.csv")
    assert {r["title"] for r in corpora.top_titles(got, 2).collect()} == {"a b", "c", "d"}


def test_question_sets(spark):
    trivia = spark.sql("select 1 id, 'q' question, named_struct('value', 'V', 'aliases', array('V', 'W', '')) answer")
    assert sorted(corpora.trivia(trivia).first()["answers"]) == ["V", "W"]
    hotpot = spark.sql("select 1 id, 'q' question, 'a' answer, named_struct('title', array('T', 'U'), 'sentences', array(array('s.', ' t.'), array('u.'))) context")
    assert corpora.hotpot(hotpot).first()["context"] == "T: s. t.\n\nU: u."
    pubmed = spark.range(10).selectExpr("id", "'q' question", "if(id = 3, '', 'long') long_answer", "if(id = 3, null, 'yes') final_decision", "array('c') contexts")
    assert corpora.pubmed(pubmed).count() == 7 and corpora.pubmed(pubmed, split="test").count() == 1
    tech = spark.createDataFrame([(1, "q", "a", "Y", "", "doc"), (2, "q", "a", "N", "c", "doc")], "id long, question string, answer string, answerable string, context string, document string")
    assert [r["context"] for r in corpora.tech(tech).collect()] == ["doc"]
    nq = spark.createDataFrame([(1, "q", [" "]), (2, "q", ["a"])], "id long, question string, answer array<string>")
    assert corpora.with_answers(corpora.natural_questions(nq)).count() == 1


def test_question_store(spark, tmp_path):
    rows = spark.createDataFrame([("1", "q", ["a"], None)], corpora.QUESTION_SCHEMA)
    corpora.write_questions(rows, f"file://{tmp_path}/q")
    assert corpora.read_questions(spark, f"file://{tmp_path}/q").collect() == rows.collect()


def test_streams(spark, tmp_path):
    source, path = f"file://{tmp_path}/in", f"file://{tmp_path}"
    docs = spark.createDataFrame([(str(k), f"Sentence number {k} of a text that is long enough to be kept as a chunk.") for k in range(5)], "id string, text string")
    docs.write.parquet(source)
    for _ in range(2):
        stream = spark.readStream.schema("id string, text string").parquet(source)
        incremental.build_corpus(stream, f"{path}/out", f"{path}/c1").awaitTermination()
    assert spark.read.parquet(f"{path}/out").count() == 5
    docs.select(F.lit(9).cast("string").alias("id"), "text").limit(1).write.mode("append").parquet(source)
    incremental.build_corpus(spark.readStream.schema("id string, text string").parquet(source), f"{path}/out", f"{path}/c1").awaitTermination()
    assert spark.read.parquet(f"{path}/out").count() == 6

    cache = stores.embedding_cache(spark, f"{path}/cache")
    rows = lambda: spark.readStream.schema("id string, text string").parquet(source).select(F.md5("text").alias("text_hash"), F.array(F.lit(1.0).cast("float")).alias("embedding"), F.lit("m").alias("model"))
    incremental.fill_cache(rows(), cache, f"{path}/c2").awaitTermination()
    incremental.fill_cache(rows(), cache, f"{path}/c3").awaitTermination()
    assert cache.table().count() == 5

    incremental.save_results(spark.readStream.schema("id string, text string").parquet(source), f"{path}/r", f"{path}/c4", key="id").awaitTermination()
    assert spark.read.parquet(f"{path}/r").count() == 6
    incremental.running_best(spark.readStream.schema("id string, text string").parquet(source).select(F.lit("m").alias("model"), F.col("id").cast("double").alias("value")), f"{path}/c5", "best_now").awaitTermination()
    assert spark.table("best_now").first()["best"] == 9.0


def test_stored_predictions_evaluated(spark, study):
    got = {(r["experiment"], r["idx"]): r["f1"] for r in results.evaluate_predictions(spark, study, ["f1", "faithfulness"]).collect()}
    assert got == {("one", 4): 0.0, ("two", 0): 0.0}
    assert {r["name"]: r["value"] for r in results.metric_of(spark, study).collect()} == {"one": 0.5, "three": 1.0, "four": 1.0}


def test_skipped_folders_at_any_depth(spark, study):
    import pathlib

    root = pathlib.Path(study.removeprefix("file://"))
    for folder in ("analysis/deep/five", "group/six", "group/_collisions/seven"):
        (root / folder).mkdir(parents=True)
        (root / folder / "results.json").write_text(json.dumps({"metrics": {"f1": 0.7}}))
    assert sorted(r["name"] for r in results.load_all(spark, study).collect()) == ["four", "one", "six", "two"]


def test_comparison_takes_the_judge_of_summaries(spark, study):
    import pathlib

    root = pathlib.Path(study.removeprefix("file://"))
    (root / "one" / "one_summary.json").write_text(json.dumps({"overall_metrics": {"llm_judge_qa": 0.0, "llm_judge": 0.6}}))
    (root / "two" / "a_summary.json").write_text(json.dumps({"llm_judge_qa": 0.9}))
    (root / "comparison.json").write_text(json.dumps({"experiments": [{"name": "one", "results": {"f1": 0.1, "llm_judge_qa": 0.2}}, {"name": "two", "metrics": {"f1": 0.3}}, {"name": "gone", "results": {"llm_judge": 0.5}}]}))
    got = {r["name"]: (r["f1"], r["llm_judge"]) for r in results.load_all(spark, study).collect()}
    assert got == {"one": (0.1, 0.6), "two": (0.3, 0.9), "gone": (0.0, 0.5)}


def test_results_as_json_and_back(spark):
    row = ([{"document": {"id": "d", "text": "a \"b\"\n", "metadata": {"k": "v"}, "score": 0.5}, "score": 0.25, "rank": 1}, {"document": None, "score": None, "rank": 2}],)
    rows = spark.createDataFrame([row, ([],), (None,)], f"results {stores.RESULT}")
    assert rows.select(stores.decoded(stores.encoded(F.col("results"))).alias("results")).collect() == rows.collect()
    assert json.loads(rows.select(stores.encoded(F.col("results")).alias("j")).first()["j"])[0]["document"]["id"] == "d"


def test_hierarchical_and_retrieval_caches(spark, tmp_path):
    from quillmark.operators import chunking

    docs = spark.createDataFrame([(str(k), "Some sentence of a text here. " * 60) for k in range(3)], "id string, text string")
    families = chunking.hierarchical(docs)
    vectors = spark.createDataFrame([(1, 10, [1.0, 0.0])], "doc_id long, parent_id long, v array<double>")
    stores.save_hierarchical(families, vectors, f"{tmp_path}/h")
    parents, children, back = stores.load_hierarchical(spark, f"{tmp_path}/h")
    assert parents.count() == families.select("parent_id").distinct().count() and children.count() == families.count() and back.collect() == vectors.collect()
    cache = stores.retrieval_cache(spark, f"{tmp_path}/r")
    rows = spark.createDataFrame([("dense_a0.50", "q1", 5, [("d", "t", 0.5, 1)]), ("dense_a0.50", "q1", 5, [("x", "t", 0.1, 1)])], "retriever string, query_hash string, top_k int, results array<struct<doc_id:string,text:string,score:double,rank:int>>")
    cache.put(rows.limit(1))
    cache.put(rows)
    asked = spark.createDataFrame([("dense_a0.50", "q1", 5), ("dense_a0.50", "q1", 3)], "retriever string, query_hash string, top_k int")
    hits, misses = cache.get(asked)
    assert hits.count() == 1 and misses.first()["top_k"] == 3


def test_writers_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("one", "m", 0.5), ("two", "m", 0.25)], "name string, model string, f1 double")
    results.write_report(rows, f"{tmp_path}/report")
    assert sorted(spark.read.option("header", True).csv(f"{tmp_path}/report").columns) == ["f1", "model", "name"]
    results.write_experiments(rows.withColumnRenamed("name", "experiment"), f"{tmp_path}/experiments")
    assert sorted(r["experiment"] for r in spark.read.parquet(f"{tmp_path}/experiments").collect()) == ["one", "two"]
    for _ in range(2):
        results.write_traces(rows, f"{tmp_path}/traces")
    assert spark.read.json(f"{tmp_path}/traces").groupBy("name").count().collect()[0]["count"] == 2


def test_subset_of_questions(spark):
    rows = spark.createDataFrame([(str(k), f"q{k}") for k in range(20)], "id string, question string")
    few = corpora.subset(rows, 5)
    assert few.count() == 5 and few.collect() == corpora.subset(rows.repartition(3), 5).collect()


def test_pivot_of_too_many_columns(spark, monkeypatch):
    from quillmark.operators import compare

    monkeypatch.setattr(compare, "MOST_COLUMNS", 3)
    rows = spark.range(5).select(F.lit("r").alias("row"), F.col("id").alias("c"), F.lit(1.0).alias("m"))
    assert len(compare.pivot(rows.filter("c < 3"), "row", "c", "m").columns) == 4
    with pytest.raises(ValueError):
        compare.pivot(rows, "row", "c", "m")


def test_recursive_chunks_without_a_limit():
    from quillmark.operators import chunking

    text = "a b " * 6000
    assert len(chunking.recursive(text, 2)) == chunking.MOST_CHUNKS + 1
    assert len(chunking.recursive(text, 2, most=None)) == 12_000 and "".join(chunking.recursive(text, 2, most=None)) == text.replace(" ", "")


def test_dashes_of_transforms_count(spark):
    from quillmark.functions import names

    rows = spark.createDataFrame([("rag_m_dense_k5_hy-de_ms-marco_concise_nq",)], "n string")
    assert rows.select(names.without_unwired(F.col("n"))).first()[0] == "rag_m_dense_k5_hy-de_concise_nq"
