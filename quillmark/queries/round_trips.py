"""Queries that write a table into the shared folder, in the form of a cache, an index, a stream's sink or a study's folders, and read it back; and metrics of models, with functions of the texts
in the place of models."""

from __future__ import annotations

import asyncio
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.functions import text as tx
from quillmark.operators import dense, graph, inverted, metrics, neural, poisson, sparse
from quillmark.plans import migration
from quillmark.queries.bindings import PREDICTIONS, RESULTS, SCORES, Query, documents, predictions, queries, query_vectors, read, results, rounded, scores, sql, vectors
from quillmark.queries.retrieval import _DENSE_HITS, _INDEX, _UNIT, K, _ranked
from quillmark.session import new_folder
from quillmark.sources import corpora, experiments, stores
from quillmark.sources import results as study
from quillmark.streaming import best, incremental
from quillmark.streaming import vectors as streamed


def _ivf(spark: SparkSession, d: str) -> DataFrame:
    index = inverted.build(vectors(spark, d), new_folder(spark, "ivf"))
    return inverted.search(index, query_vectors(spark, d), K)


def _ivf_all(spark: SparkSession, d: str) -> DataFrame:
    index = inverted.build(vectors(spark, d), new_folder(spark, "ivf"), lists=16, batch_rows=150)
    return inverted.search(index, query_vectors(spark, d), K, probes=16)


def _pq(spark: SparkSession, d: str) -> DataFrame:
    index = inverted.build(vectors(spark, d), new_folder(spark, "pq"), subs=8)
    return inverted.search(index, query_vectors(spark, d), K, vectors=vectors(spark, d))


def _graph(spark: SparkSession, d: str) -> DataFrame:
    return graph.search(graph.build(vectors(spark, d), new_folder(spark, "graph")), query_vectors(spark, d), K)


def _saved_dense(spark: SparkSession, d: str) -> DataFrame:
    path = new_folder(spark, "dense")
    stores.save_dense(dense.build(vectors(spark, d)), path, shards=3)
    return stores.load_dense(spark, path).select("doc_id", F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x), 9).alias("total"))


def _saved_sparse(spark: SparkSession, d: str) -> DataFrame:
    path = new_folder(spark, "sparse")
    stores.save_sparse(sparse.postings(documents(spark, d)), path)
    index = stores.load_sparse(spark, path)
    return index.postings.join(index.terms, "term").crossJoin(F.broadcast(index.size)).groupBy("term").agg(F.max("df").alias("df"), F.sum("tf").alias("total"), F.max("n").alias("n"))  # size is one row


def _saved_families(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as parents, their turns as children."""
    path, turns = new_folder(spark, "families"), read(spark, d, "conversations").filter("text is not null")
    whole = turns.groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda t: t["text"]), "\n").alias("parent_text"))
    families = turns.join(whole, "conv_id").select(F.col("conv_id").alias("parent_id"), "parent_text", F.concat_ws("_", "conv_id", "turn").alias("child_id"), F.col("text").alias("child_text"))
    stores.save_hierarchical(families, dense.build(vectors(spark, d)).withColumn("parent_id", F.expr("doc_id div 5")), path)
    parents, children, own = stores.load_hierarchical(spark, path)
    counts = children.groupBy("parent_id").agg(F.count("*").alias("n_children"), F.sum(F.length("child_text")).alias("chars"))
    return parents.join(counts, "parent_id").join(own.groupBy("parent_id").agg(F.count("*").alias("n_vectors")), "parent_id", "left").select("parent_id", F.length("parent_text").alias("parent_chars"), "n_children", "chars", F.coalesce("n_vectors", F.lit(0)).alias("n_vectors"))


def _embedding_cache(spark: SparkSession, d: str) -> DataFrame:
    """Two puts that overlap; the second adds what is new."""
    cache = stores.embedding_cache(spark, new_folder(spark, "embeddings"))
    rows = read(spark, d, "embeddings").select(F.concat(F.lit("m"), F.col("label").cast("string")).alias("model"), tx.text_hash(F.col("vec_id").cast("string")).alias("text_hash"), "embedding", "vec_id")
    cache.put(rows.filter("vec_id % 3 <> 0"))
    cache.put(rows)
    return cache.stats(4 * F.size("embedding"))


def _retrieval_cache(spark: SparkSession, d: str) -> DataFrame:
    cache = stores.retrieval_cache(spark, new_folder(spark, "retrieval"))
    hits = dense.search(dense.build(vectors(spark, d)), query_vectors(spark, d), 3).join(documents(spark, d), "doc_id")
    listed = hits.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", F.col("doc_id").cast("string").alias("doc_id"), "text", "score"))).alias("r"))
    made = listed.select(F.lit("dense").alias("retriever"), tx.text_hash(F.col("query_id").cast("string")).alias("query_hash"), F.lit(3).alias("top_k"), F.transform("r", lambda x: F.struct(x["doc_id"].alias("doc_id"), x["text"].alias("text"), x["score"].alias("score"), x["rank"].alias("rank"))).alias("results"))
    cache.put(made)
    asked = queries(spark, d).select("query_id", F.lit("dense").alias("retriever"), tx.text_hash(F.col("query_id").cast("string")).alias("query_hash"), F.lit(3).alias("top_k"))
    found, missed = cache.get(asked)
    return found.select("query_id", F.size("results").alias("n"), F.get("results", F.lit(0))["doc_id"].alias("first")).unionByName(missed.select("query_id", F.lit(0).alias("n"), F.lit(None).cast("string").alias("first")))


def _questions(spark: SparkSession, d: str) -> DataFrame:
    """Items of the benchmark, their sentences as answers."""
    rows = queries(spark, d).select(F.col("query_id").alias("id"), F.col("text").alias("question"), tx.sentences(F.col("text")).alias("answer"))
    path = new_folder(spark, "questions")
    corpora.write_questions(corpora.natural_questions(rows), path)
    return corpora.read_questions(spark, path).select("id", F.size("answers").alias("n_answers"), F.md5(F.array_join("answers", "|")).alias("digest"))


def _scores_file(spark: SparkSession, d: str) -> DataFrame:
    """Sources with their sizes as a file of page scores."""
    path = new_folder(spark, "scores")
    read(spark, d, "documents").groupBy("source").agg(F.avg("n_chars").alias("wikirank_quality")).select(F.concat(F.lit(" "), F.upper("source"), F.lit("_page")).alias("page_name"), "wikirank_quality").write.option("header", True).csv(path)
    return rounded(corpora.rank_scores(spark, path))


def _report(spark: SparkSession, d: str) -> DataFrame:
    path = new_folder(spark, "report")
    study.write_report(results(spark, d).groupBy("model", "dataset").agg(F.count("*").alias("n")), path)
    return spark.read.option("header", True).schema("model string, dataset string, n long").csv(path)


def _traces(spark: SparkSession, d: str) -> DataFrame:
    path = new_folder(spark, "traces")
    rows = read(spark, d, "conversations").select("conv_id", "turn", "role", F.struct(F.length("text").alias("chars")).alias("output"))
    study.write_traces(rows.filter("role = 'user'"), path)
    study.write_traces(rows.filter("role <> 'user'"), path)
    return spark.read.schema("conv_id long, turn long, role string, output struct<chars:long>").json(path).groupBy("role").agg(F.count("*").alias("n"), F.sum("output.chars").alias("chars"))


def _written(spark: SparkSession, d: str) -> str:
    """A study of the scores: an experiment for each dataset and model, its predictions the scores of questions; those of one model failed."""
    path = new_folder(spark, "study")
    rows = scores(spark, d).withColumn("experiment", F.concat_ws("_", "dataset", "model"))
    names = rows.groupBy("experiment", "dataset", "model").agg(F.avg("f1").alias("f1"), F.count("*").alias("n"))
    experiments.write_study(
        path,
        metadata=names.select("experiment", F.col("experiment").alias("name"), F.lit("rag").alias("type"), "model", "dataset", F.lit("dense_bge_recursive_512").alias("retriever"), F.lit(5).alias("top_k")),
        results=names.filter("model <> 'm1'").select("experiment", F.create_map(F.lit("f1"), F.col("f1")).alias("metrics"), F.col("n").cast("double").alias("duration_seconds")),
        predictions=rows.select("experiment", F.col("id").alias("idx"), F.col("idx").cast("string").alias("question"), F.col("exp_type").alias("prediction"), F.array(F.col("exp_type")).alias("references"), F.create_map(F.lit("f1"), F.col("f1")).alias("metrics")),
        states=names.select("experiment", F.when(F.col("model") == "m2", "failed").otherwise("complete").alias("phase"), F.when(F.col("model") == "m2", "lost").alias("error")),
    )
    return path


def _migrated(spark: SparkSession, d: str) -> DataFrame:
    """A study whose results lack a score's own name, and whose experiments of one model are complete with failed predictions: the changes, which a second run finds no more."""
    path, rows = new_folder(spark, "study"), scores(spark, d).withColumn("experiment", F.concat_ws("_", "dataset", "model"))
    said = F.when((F.col("model") == "m2") & (F.col("id") % 2 == 0), "[ERROR: lost]").otherwise("said")
    experiments.write_study(
        path,
        results=rows.groupBy("experiment").agg(F.create_map(F.lit("bertscore_f1"), F.avg("f1")).alias("metrics")),
        predictions=rows.select("experiment", F.col("id").alias("idx"), said.alias("prediction")),
        states=rows.select("experiment").distinct().withColumn("phase", F.lit("complete")),
    )
    changed = migration.apply(spark, path, migration.plan_repairs)
    left = migration.apply(spark, path, migration.plan_repairs).count()
    return changed.select("experiment", "file", "reason", F.get_json_object("content", "$.error").alias("error"), F.lit(left).cast("long").alias("left"))


def _on_study(f: Callable[[SparkSession, str], DataFrame]) -> Query:
    return lambda spark, d: rounded(f(spark, _written(spark, d)))


_EXPERIMENTS = f"{SCORES}, e AS (SELECT dataset || '_' || model AS experiment, * FROM scores)"


def _stream(spark: SparkSession, d: str, table: str) -> DataFrame:
    return spark.readStream.schema(read(spark, d, table).schema).parquet(f"{d}/{table}.parquet*")


def _streamed_chunks(spark: SparkSession, d: str) -> DataFrame:
    out, check = new_folder(spark, "chunks"), new_folder(spark, "progress")
    incremental.build_corpus(_stream(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), "text"), out, check, name="hard").awaitTermination()
    rows = spark.read.parquet(out)
    return rows.groupBy(F.col("parent_id").cast("long").alias("id")).agg(F.count("*").alias("n_chunks"), F.sum(F.length("text")).alias("chars"))


def _streamed_results(spark: SparkSession, d: str) -> DataFrame:
    """Twice over the same results: the second adds nothing."""
    out, check = new_folder(spark, "sink"), new_folder(spark, "progress")
    rows = _stream(spark, d, "events").select(F.col("event_id").alias("idx"), "event_type", "value")
    for _ in range(2):
        incremental.save_results(rows, out, check).awaitTermination()
    return rounded(spark.read.parquet(out).groupBy("event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")), 4)


def _streamed_cache(spark: SparkSession, d: str) -> DataFrame:
    cache = stores.embedding_cache(spark, new_folder(spark, "cache"))
    rows = _stream(spark, d, "embeddings").select(F.lit("m").alias("model"), tx.text_hash(F.col("label").cast("string")).alias("text_hash"), "embedding")
    incremental.fill_cache(rows, cache, new_folder(spark, "progress")).awaitTermination()
    return cache.stats(F.size("embedding"))


def _streamed_best(spark: SparkSession, d: str) -> DataFrame:
    out = new_folder(spark, "best")
    rows = _stream(spark, d, "events").select(F.col("event_type").alias("model"), "value", F.col("event_id").cast("string").alias("trial"), F.col("ts").cast("timestamp").alias("ts"))
    best.keep_best(rows, out, new_folder(spark, "progress"), late="3650 days").awaitTermination()
    return rounded(best.latest(spark, out).select(F.col("key").alias("model"), "best", "trial", "n"))


def _streamed_index(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of documents, embedded by counts of letters, in an index that a stream builds."""
    path = new_folder(spark, "index")

    def embed(text):
        return F.transform(F.array(*map(F.lit, "aeioun")), lambda c: (F.length(text) - F.length(F.replace(text, c)) + 1).cast("double"))

    streamed.build_index(_stream(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), "text"), path, new_folder(spark, "progress"), embed, name="hard", lists=8).awaitTermination()
    rows = inverted.Inverted(spark, path).table()
    return rounded(rows.groupBy(F.col("parent_id").cast("long").alias("id")).agg(F.count("*").alias("n_chunks"), F.sum(F.get("embedding", F.lit(0))).alias("a_total")))


#: The pieces of whole documents that are not left out: windows of 512 with an overlap of 50, of 50 trimmed characters at least.
_HARD = r"""c AS (SELECT doc_id AS id, substr(text, beg + 1, 512) AS w FROM (SELECT doc_id, text, unnest(range(0, greatest(0, length(text) - 51) + 1, 462)) AS beg FROM documents WHERE length(text) > 0)),
t AS (SELECT id, regexp_replace(w, '^\s+|\s+$', '', 'g') AS text FROM c WHERE length(regexp_replace(w, '^\s+|\s+$', '', 'g')) >= 50)"""

_LETTERS = "abcde"


def letter_tokens(texts: list[str]) -> list[np.ndarray]:
    """For a model: of each word the counts of five letters, and one."""
    return [np.array([[*(w.count(c) for c in _LETTERS), 1] for w in t.split(" ") if w], float).reshape(-1, len(_LETTERS) + 1) for t in texts]


def overlap_nli(premises: list[str], claims: list[str]) -> list[dict[str, float]]:
    """For a model: the share of the claim's words in the premise, and half of what is missing."""
    out = []
    for p, c in zip(premises, claims, strict=True):
        own = set(c.split(" ")) - {""}
        share = round(len(own & set(p.split(" "))) / max(1, len(own)), 6)
        out.append({"entailment": share, "contradiction": round((1 - share) * 0.72, 6)})
    return out


async def length_score(text: str) -> float:
    """For a service: every eleventh length is refused."""
    await asyncio.sleep(0)
    if len(text) % 11 == 0:
        raise ValueError("refused")
    return len(text) % 7 / 7


def _bertscore(spark: SparkSession, d: str) -> DataFrame:
    return rounded(neural.bertscore(predictions(spark, d), letter_tokens), 6)


_NLI = rf"""{PREDICTIONS}, x AS (SELECT pred_id, prediction, unnest(contexts) AS premise, unnest(range(len(contexts))) AS pos FROM predictions), own AS (SELECT *, list_distinct(list_filter(string_split(prediction, ' '), lambda w: w <> '')) AS a FROM x WHERE trim(premise) <> ''),
s AS (SELECT pred_id, row_number() OVER (PARTITION BY pred_id ORDER BY pos) AS k, round(len(list_intersect(a, list_distinct(string_split(premise, ' '))))::DOUBLE / greatest(1, len(a)), 6) AS e FROM own)"""

QUERIES: dict[str, tuple[Query, str | None]] = {
    "ivf_topk": (_ivf, None),
    "ivf_all_lists_topk": (_ivf_all, f"WITH {_UNIT}, {_DENSE_HITS} {_ranked('dh', K)}"),
    "ivf_pq_topk": (_pq, None),
    "graph_topk": (_graph, None),
    "saved_dense": (_saved_dense, f"WITH {_UNIT} SELECT vec_id AS doc_id, round(list_sum(v), 9) AS total FROM u"),
    "saved_sparse": (_saved_sparse, f"WITH {_INDEX} SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS total, (SELECT n FROM size) AS n FROM p GROUP BY term"),
    "saved_families": (
        _saved_families,
        "SELECT conv_id AS parent_id, CAST(length(string_agg(text, chr(10) ORDER BY turn, text)) AS INTEGER) AS parent_chars, count(*) AS n_children, CAST(sum(length(text)) AS BIGINT) AS chars, coalesce((SELECT count(*) FROM embeddings WHERE vec_id // 5 = conv_id), 0) AS n_vectors FROM conversations WHERE text IS NOT NULL GROUP BY conv_id",
    ),
    "saved_embedding_cache": (_embedding_cache, "SELECT 'm' || label AS model, count(*) AS entries, CAST(sum(4 * len(embedding)) AS BIGINT) AS bytes FROM embeddings GROUP BY label"),
    "saved_retrieval_cache": (
        _retrieval_cache,
        f"WITH {_UNIT}, {_DENSE_HITS}, h AS ({_ranked('dh', 3)}), f AS (SELECT h.query_id, doc_id, rank FROM h JOIN documents USING (doc_id)) SELECT item_id AS query_id, CAST(count(doc_id) AS INTEGER) AS n, arg_min(CAST(doc_id AS VARCHAR), rank) AS first FROM benchmark LEFT JOIN f ON query_id = item_id GROUP BY item_id",
    ),
    "saved_questions": (
        _questions,
        r"WITH s AS (SELECT item_id, list_filter(list_transform(string_split_regex(text, '[.!?]+'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS a FROM benchmark) SELECT CAST(item_id AS VARCHAR) AS id, CAST(len(a) AS INTEGER) AS n_answers, md5(coalesce(array_to_string(a, '|'), '')) AS digest FROM s",
    ),
    "saved_scores": (_scores_file, sql("SELECT source || ' page' AS title, avg(n_chars) AS score FROM documents WHERE source IS NOT NULL GROUP BY source", "score")),
    "saved_report": (_report, f"WITH {RESULTS} SELECT model, dataset, count(*) AS n FROM results GROUP BY ALL"),
    "saved_traces": (_traces, "SELECT role, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM conversations GROUP BY role"),
    "study_results": (
        _on_study(lambda s, p: study.load_all(s, p).select("name", "model", "dataset", "f1", "top_k", "duration")),
        sql(f"WITH {_EXPERIMENTS} SELECT experiment AS name, any_value(model) AS model, any_value(dataset) AS dataset, avg(f1) AS f1, 5::INTEGER AS top_k, count(*)::DOUBLE AS duration FROM e WHERE model NOT IN ('m1', 'm2') GROUP BY experiment", "f1", "duration"),
    ),
    "study_failed": (_on_study(study.failed), f"WITH {_EXPERIMENTS} SELECT DISTINCT experiment AS name, 'failed' AS phase, 'lost' AS error FROM e WHERE model = 'm2'"),
    "study_item_scores": (
        _on_study(lambda s, p: study.item_scores(s, p).groupBy("experiment").agg(F.count("*").alias("n"), F.sum("idx").alias("idx_total"), F.avg("score").alias("score"))),
        sql(f"WITH {_EXPERIMENTS} SELECT experiment, count(*) AS n, CAST(sum(id) AS BIGINT) AS idx_total, avg(f1) AS score FROM e WHERE f1 IS NOT NULL GROUP BY experiment", "score"),
    ),
    "study_metrics_again": (
        _on_study(lambda s, p: study.evaluate_predictions(s, p, ["exact_match", "f1"]).groupBy("experiment").agg(F.count("*").alias("n"), F.avg("exact_match").alias("exact_match"), F.avg("f1").alias("f1"))),
        sql(f"WITH {_EXPERIMENTS} SELECT experiment, count(*) AS n, 1.0::DOUBLE AS exact_match, 1.0::DOUBLE AS f1 FROM e GROUP BY experiment", "exact_match", "f1"),
    ),
    "study_metric_of": (_on_study(study.metric_of), sql(f"WITH {_EXPERIMENTS} SELECT experiment AS name, avg(f1) AS value FROM e GROUP BY experiment", "value")),
    "study_completed": (
        _on_study(lambda s, p: experiments.completed(s, p).groupBy("experiment").agg(F.count("*").alias("n"), F.max("idx").alias("last"))),
        f"WITH {_EXPERIMENTS} SELECT experiment, count(*) AS n, max(id) AS last FROM e GROUP BY experiment",
    ),
    "study_repairs": (
        _migrated,
        f"""WITH {_EXPERIMENTS}, m AS (SELECT experiment, count(*) FILTER (model = 'm2' AND id % 2 = 0) AS bad FROM e GROUP BY experiment)
        SELECT experiment, 'results' AS file, 'bertscore' AS reason, NULL::VARCHAR AS error, 0::BIGINT AS left FROM m UNION ALL SELECT experiment, 'state', 'complete with failed predictions', bad || ' predictions have errors', 0 FROM m WHERE bad > 0""",
    ),
    "poisson_ci": (lambda s, d: rounded(poisson.interval(results(s, d), "model", "f1", "id", "dataset")), None),
    "poisson_paired": (lambda s, d: rounded(poisson.paired(results(s, d), "model", "em", "f1", "id", times=1000)), None),
    "poisson_unpaired": (lambda s, d: rounded(poisson.unpaired(results(s, d), "model", "f1", "id", times=1000)), None),
    "poisson_ranking": (lambda s, d: poisson.ranking(results(s, d), "retriever", "f1", "id"), None),
    "streamed_chunks": (_streamed_chunks, f"WITH {_HARD} SELECT id, count(*) AS n_chunks, CAST(sum(length(text)) AS BIGINT) AS chars FROM t GROUP BY id"),
    "streamed_results": (_streamed_results, sql("SELECT event_type, count(*) AS n, sum(value) AS total FROM events GROUP BY event_type", "total", digits=4)),
    "streamed_cache": (_streamed_cache, "SELECT 'm' AS model, count(DISTINCT label) AS entries, CAST(count(DISTINCT label) * max(len(embedding)) AS BIGINT) AS bytes FROM embeddings"),
    "streamed_best": (_streamed_best, sql("SELECT event_type AS model, max(value) AS best, min(CAST(event_id AS VARCHAR)) FILTER (value = m) AS trial, count(*) AS n FROM (SELECT *, max(value) OVER (PARTITION BY event_type) AS m FROM events) GROUP BY event_type", "best")),
    "streamed_index": (
        _streamed_index,
        sql(f"WITH {_HARD} SELECT id, count(*) AS n_chunks, sum(length(text) - length(replace(text, 'a', '')) + 1)::DOUBLE AS a_total FROM t GROUP BY id", "a_total"),
    ),
    "bertscore_letters": (
        _bertscore,
        sql(
            f"""WITH {PREDICTIONS}, vec AS (SELECT DISTINCT t, list_transform(list_filter(string_split(t, ' '), lambda w: w <> ''), lambda w: list_append(list_transform(string_split('{_LETTERS}', ''), lambda c: length(w) - length(replace(w, c, ''))), 1)) AS v FROM (SELECT prediction AS t FROM predictions UNION SELECT unnest(refs) FROM predictions)),
            n AS (SELECT t, list_transform(v, lambda x: list_transform(x, lambda y: y::DOUBLE / sqrt(list_inner_product(x::DOUBLE[], x::DOUBLE[])))) AS v FROM vec), r AS (SELECT pred_id, prediction, unnest(refs) AS ref, unnest(range(len(refs))) AS pos FROM predictions),
            w AS (SELECT pred_id, pos, a.v AS a, b.v AS b FROM r JOIN n a ON a.t = prediction JOIN n b ON b.t = ref),
            s AS (SELECT pred_id, pos, coalesce(list_avg(list_transform(a, lambda x: list_max(list_transform(b, lambda y: list_inner_product(x, y))))), 0) AS p, coalesce(list_avg(list_transform(b, lambda y: list_max(list_transform(a, lambda x: list_inner_product(x, y))))), 0) AS q FROM w),
            f AS (SELECT *, CASE WHEN p + q > 0 THEN 2 * p * q / (p + q) ELSE 0 END AS f FROM s QUALIFY row_number() OVER (PARTITION BY pred_id ORDER BY round(f, 12) DESC, pos) = 1)
            SELECT pred_id, coalesce(p, 0)::DOUBLE AS bertscore_precision, coalesce(q, 0)::DOUBLE AS bertscore_recall, coalesce(f, 0)::DOUBLE AS bertscore_f1 FROM predictions LEFT JOIN f USING (pred_id)""",
            "bertscore_precision", "bertscore_recall", "bertscore_f1", digits=6,
        ),
    ),
    "nli_faithfulness": (
        lambda s, d: rounded(neural.nli_faithfulness(predictions(s, d), overlap_nli)).select("pred_id", "faithfulness"),
        sql(f"WITH {_NLI}, m AS (SELECT pred_id, coalesce(arg_min(e, k) FILTER (e > 0.9), max(e)) AS e FROM s GROUP BY pred_id) SELECT pred_id, coalesce(e, 0.0)::DOUBLE AS faithfulness FROM predictions LEFT JOIN m USING (pred_id)", "faithfulness"),
    ),
    "nli_hallucination": (
        lambda s, d: rounded(neural.nli_hallucination(predictions(s, d), overlap_nli)),
        sql(
            f"WITH {_NLI}, m AS (SELECT pred_id, max(e) AS e, max(round((1 - e) * 0.72, 6)) AS c FROM s GROUP BY pred_id) SELECT pred_id, CASE WHEN trim(prediction) = '' THEN 0.0 WHEN c > 0.7 THEN c ELSE 1 - coalesce(e, 0.0) END::DOUBLE AS hallucination FROM predictions LEFT JOIN m USING (pred_id)",
            "hallucination",
        ),
    ),
    "limited_calls": (
        lambda s, d: rounded(predictions(s, d).select("pred_id", neural.limited(length_score, concurrent=8)("prediction").alias("r")).select("pred_id", "r.*")),
        sql(f"WITH {PREDICTIONS} SELECT pred_id, CASE WHEN length(prediction) % 11 = 0 THEN 0.0 ELSE (length(prediction) % 7)::DOUBLE / 7 END AS score, length(prediction) % 11 = 0 AS failed, 1::INTEGER AS attempts FROM predictions", "score"),
    ),
}
assert metrics  # registers the metrics that evaluate_predictions names
