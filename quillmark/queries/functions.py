"""Queries of the scalar functions, loaders and small operators, over columns of the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.functions import names, parse, prompts
from quillmark.functions import text as tx
from quillmark.operators import agents, compare, diagnostics, fusion, metrics
from quillmark.plans import grid, lifecycle
from quillmark.queries.bindings import PREDICTIONS, RESULTS, Query, documents, predictions, queries, read, results, rounded, sql
from quillmark.queries.retrieval import _ANSWER, _BM25_HITS, _INDEX, _NORM, _WORDS, _bm25, _ranked
from quillmark.sources import corpora
from quillmark.sources import results as result_files

_FUZZY = r"regexp_replace(regexp_replace(regexp_replace(lower({}), '^\s+|\s+$', '', 'g'), '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '\s+', ' ', 'g')"


def _parts(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "part")


def _normalised(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).select("doc_id", F.md5(tx.normalize_answer(F.col("text"))).alias("answer"), F.md5(tx.normalize_context(F.col("text"))).alias("context"), F.md5(tx.normalize_fuzzy(F.col("text"))).alias("fuzzy"), F.size(tx.words(F.col("text"))).alias("words"), F.size(tx.tokens(F.col("text"))).alias("tokens"), tx.text_hash(F.col("text")).alias("hash"))


def _correct(spark: SparkSession, d: str) -> DataFrame:
    rows = predictions(spark, d)
    return rows.select("pred_id", tx.is_correct(F.col("prediction"), F.col("references")).alias("correct"), tx.answer_in_prompt(F.col("references"), metrics.joined(F.col("contexts"))).alias("in_prompt"))


def _retrievers(spark: SparkSession, d: str) -> DataFrame:
    name = F.when(F.col("p_partkey") % 4 == 0, F.col("p_name")).otherwise(F.concat_ws("_", F.lower("p_type"), F.regexp_replace("p_brand", "#", ""), F.lit("recursive"), (F.col("p_size") * 64).cast("string"), F.lit("x")))
    return _parts(spark, d).select(F.col("p_partkey").alias("id"), names.retriever_parts(name).alias("p")).select("id", "p.*")


def _named(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.concat(F.lit("vllm:org/Model-"), F.col("n_nationkey").cast("string"), F.lit(".5B-Instruct")).alias("model"), F.concat(F.lit("p"), (F.col("n_regionkey")).cast("string")).alias("prompt"), F.lit("nq").alias("dataset"))
    return rows.select("id", names.model_short(F.col("model")).alias("short"), names.direct_name(F.col("model"), F.col("prompt"), F.col("dataset")).alias("name"), names.index_name(F.concat(F.lit("org/bge-large-"), F.col("prompt")), F.lit(512), F.lit(50), F.lit("en")).alias("index"))


def _passages(spark: SparkSession, d: str) -> DataFrame:
    hits = _bm25(spark, d, 3).join(documents(spark, d), "doc_id").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "text", "score"))).alias("docs"))
    return hits.select("query_id", F.md5(parse.passages(F.col("docs"))).alias("digest"), F.length(agents.prompt(F.lit("q"), parse.passages(F.col("docs")))).alias("chars"))


_SHOWN = {"style": "Give the name.", "stop_instruction": "Stop then.", "knowledge_instruction": "See the passages.", "examples": [{"question": f"what is {k}", "answer": f"number {k}"} for k in range(6)]}


def _layouts(spark: SparkSession, d: str) -> DataFrame:
    """Every type of prompt of every question, alone and with its passages."""
    hits = _bm25(spark, d, 3).join(documents(spark, d), "doc_id").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "text", "score"))).alias("docs"))
    rows = queries(spark, d).join(hits, "query_id", "left").select("query_id", "text", F.coalesce(parse.passages(F.col("docs")), F.lit("")).alias("context"))
    made = [F.struct(F.lit(k).alias("kind"), F.md5(prompts.prompt(F.col("text"), None, k, dataset=_SHOWN)).alias("direct"), F.md5(prompts.prompt(F.col("text"), F.col("context"), k, dataset=_SHOWN)).alias("given")) for k in prompts.STYLES]
    return rows.select("query_id", F.explode(F.array(*made)).alias("p")).select("query_id", "p.*")


_TEMPLATES = ", ".join("('" + "', '".join(x.replace("'", "''") for x in (k, prompts.template(k, False, _SHOWN), prompts.template(k, True, _SHOWN))) + "')" for k in prompts.STYLES)


def _expanded(spark: SparkSession, d: str) -> DataFrame:
    pairs = metrics.expand(predictions(spark, d).select("pred_id", "prediction", "references"))
    return rounded(metrics.aggregate(pairs.withColumn("score", F.length("reference") / (F.length("reference") + F.length("prediction")))))


def _quality(spark: SparkSession, d: str) -> DataFrame:
    hits = _bm25(spark, d, 5).join(documents(spark, d), "doc_id").groupBy("query_id").agg(F.collect_list(F.struct(F.col("text").alias("content"), "score")).alias("docs"))
    rows = queries(spark, d).join(hits, "query_id").select("query_id", metrics.retrieval_quality(F.col("docs"), F.array("text")).alias("q"))
    return rounded(rows.select("query_id", "q.*"), 6)


def _steps(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "conversations").select((F.col("conv_id") % 30).alias("experiment"), F.when(F.col("conv_id") % 3 == 0, "fixed_rag").when(F.col("conv_id") % 3 == 1, "iterative_rag").otherwise("direct_llm").alias("agent_type"), F.when(F.col("role") == "user", "batch_search").when(F.col("role") == "assistant", "batch_generate").otherwise("rerank").alias("type"))
    return diagnostics.missing_steps(spark, rows)


def _loaders(spark: SparkSession, d: str) -> DataFrame:
    turns = read(spark, d, "conversations").groupBy(F.col("conv_id").alias("id")).agg(F.sort_array(F.collect_list("role")).alias("aliases"), F.min("text").alias("question"))
    rows = corpora.trivia(turns.select("id", "question", F.struct(F.lit("user").alias("value"), "aliases").alias("answer")))
    return corpora.with_answers(rows).select("id", F.array_join(F.sort_array("answers"), ",").alias("answers"))


def _split(spark: SparkSession, d: str) -> DataFrame:
    rows = documents(spark, d).select(F.col("doc_id").alias("id"), F.lit("q").alias("question"), F.when(F.col("doc_id") % 3 == 0, "").otherwise("long").alias("long_answer"), F.when(F.col("doc_id") % 2 == 0, "yes").alias("final_decision"), F.array(F.lit("a"), F.lit("b")).alias("contexts"))
    parts = [corpora.pubmed(rows, split=s).select("id", F.get("answers", F.lit(0)).alias("answer"), F.length("context").alias("chars"), F.lit(s).alias("split")) for s in ("train", "validation", "test")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _contexts(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "region").select(F.col("r_regionkey").alias("id"), F.lit("q").alias("question"), F.col("r_name").alias("answer"), F.struct(F.array("r_name", F.lit("T")).alias("title"), F.array(F.array(F.lit("One."), F.lit(" Two.")), F.array(F.col("r_name"))).alias("sentences")).alias("context"))
    return corpora.hotpot(rows).select("id", "context", F.get("answers", F.lit(0)).alias("answer"))


def _tech(spark: SparkSession, d: str) -> DataFrame:
    rows = _parts(spark, d).select(F.col("p_partkey").alias("id"), F.lit("q").alias("question"), F.col("p_brand").alias("answer"), F.when(F.col("p_size") % 2 == 0, "Y").otherwise("N").alias("answerable"), F.when(F.col("p_size") % 3 == 0, "").otherwise(F.col("p_type")).alias("context"), F.col("p_name").alias("document"))
    return corpora.tech(rows).select("id", "context")


def _timings(spark: SparkSession, d: str) -> DataFrame:
    line = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("Phase [generating] completed in "), F.col("p_size").cast("string"), F.lit(".5s"))).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("bertscore done in "), F.col("p_size").cast("string"), F.lit("s"))).otherwise("nothing")
    return _parts(spark, d).select(F.col("p_partkey").alias("id"), parse.log_timings(line).alias("t")).filter("t is not null").select("id", "t.*")


def _variations(spark: SparkSession, d: str) -> DataFrame:
    response = F.concat(F.lit("Alternatives:\n1. "), F.col("p_name"), F.lit("\n- "), F.upper("p_type"), F.lit("\n\n* what is "), F.col("p_brand"), F.lit("\n2) fourth"))
    return _parts(spark, d).select(F.col("p_partkey").alias("id"), F.array_join(parse.variations(response, F.lower("p_type")), "|").alias("queries"))


def _labels(spark: SparkSession, d: str) -> DataFrame:
    x = F.col("p_size") / 50.0
    return _parts(spark, d).select(F.col("p_partkey").alias("id"), parse.stars(x / 10).alias("stars"), parse.effect_size(x - 0.5).alias("effect"), parse.metric_text(F.when(F.col("p_partkey") % 2 == 0, "f1").otherwise("seconds"), x).alias("shown"), parse.abstains(F.when(F.col("p_size") % 5 == 0, "Unknown.").when(F.col("p_size") % 5 == 1, "I do not know it").otherwise(F.col("p_name"))).alias("abstains"), tx.title_key(F.concat(F.lit(" "), F.replace("p_name", F.lit(" "), F.lit("_")))).alias("title"))


def _issues(spark: SparkSession, d: str) -> DataFrame:
    rows = _parts(spark, d).select(F.col("p_partkey").alias("id"), names.issues(F.when(F.col("p_size") % 2 == 0, "Hybrid_x").otherwise("dense"), F.when(F.col("p_size") % 3 == 0, "iterative_rag"), F.when(F.col("p_size") % 5 == 0, "hyde"), F.when(F.col("p_size") % 7 == 0, "bge"), F.col("p_size") % 4).alias("t"))
    return rows.select("id", F.array_join("t", ",").alias("tags"))


def _failures(spark: SparkSession, d: str) -> DataFrame:
    error = F.when(F.col("p_size") % 4 == 0, "CUDA OOM").when(F.col("p_size") % 4 == 1, "Request timed out").when(F.col("p_size") % 4 == 2, "maximum context reached").otherwise("?")
    return lifecycle.failure_patterns(_parts(spark, d).select(error.alias("error")))


def _spec_union(spark: SparkSession, d: str) -> DataFrame:
    base = grid.product(spark, {"model": ["a/x", "b/y"], "prompt": ["p", "q"]})
    direct = grid.direct_specs(base.crossJoin(read(spark, d, "region").select(F.col("r_name").alias("dataset"))))
    single = grid.singletons(spark.createDataFrame([("s", None), ("t", "z")], "name string, prompt string"), ["nq", "hq"], {"prompt": "concise"})
    return grid.all_specs(direct, single).groupBy("dataset").agg(F.count("*").alias("n"), F.count("model").alias("direct"), F.count_if(F.col("prompt") == "concise").alias("defaults"))


def _cache_put(spark: SparkSession, d: str) -> DataFrame:
    rows = documents(spark, d).select(F.col("doc_id") % 100, tx.text_hash(F.col("text"))).toDF("model", "text_hash")
    cache = rows.filter("model < 40").distinct()  # what the cache holds before the put
    return fusion.cache_put(cache, rows, ["model", "text_hash"]).groupBy("model").agg(F.count("*").alias("entries"))


QUERIES: dict[str, tuple[Query, str | None]] = {
    "normalised_texts": (
        _normalised,
        rf"""SELECT doc_id, md5({_ANSWER.format('text')}) AS answer, md5({_NORM.format('text')}) AS context, md5({_FUZZY.format('text')}) AS fuzzy, CAST(len({_WORDS.format('text')}) AS INTEGER) AS words, CAST(len(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]{{2,}}')) AS INTEGER) AS tokens, left(sha256(text), 32) AS hash FROM documents""",
    ),
    "fuzzy_correct": (
        _correct,
        rf"""WITH {PREDICTIONS}, n AS (SELECT pred_id, prediction, {_FUZZY.format('prediction')} AS p, {_FUZZY.format("coalesce(array_to_string(contexts, ' '), '')")} AS ctx, list_transform(refs, lambda r: {_FUZZY.format('r')}) AS rs FROM predictions)
        SELECT pred_id, prediction <> '' AND len(list_filter(rs, lambda a: a <> '' AND (contains(p, a) OR contains(a, p) OR (len({_WORDS.format('p')}) > 0 AND len(list_intersect(list_distinct({_WORDS.format('a')}), {_WORDS.format('p')}))::DOUBLE / greatest(len(list_distinct({_WORDS.format('a')})), 1) >= 0.5)))) > 0 AS correct,
          len(list_filter(rs, lambda a: length(a) >= 2 AND contains(ctx, a))) > 0 AS in_prompt FROM n""",
    ),
    "retriever_parts": (
        _retrievers,
        """SELECT p_partkey AS id, CASE WHEN p_partkey % 4 = 0 THEN 'unknown' ELSE lower(p_type) END AS corpus, CASE WHEN p_partkey % 4 = 0 THEN 'unknown' ELSE replace(p_brand, '#', '') END AS embedding_model, CASE WHEN p_partkey % 4 = 0 THEN 'unknown' ELSE 'recursive' END AS chunk_strategy, CAST(CASE WHEN p_partkey % 4 = 0 THEN 0 ELSE p_size * 64 END AS INTEGER) AS chunk_size FROM part""",
    ),
    "names_made": (
        _named,
        """SELECT n_nationkey AS id, left('Model' || n_nationkey || '5BI', 12) AS short, 'direct_' || left('Model' || n_nationkey || '5BI', 12) || '_nq_' || left(sha256('dataset=nq|model=vllm:org/Model-' || n_nationkey || '.5B-Instruct|prompt=p' || n_regionkey), 8) AS name, 'en_large_p' || n_regionkey || '_c512_o50' AS index FROM nation""",
    ),
    "passages": (
        _passages,
        f"""WITH {_INDEX}, {_BM25_HITS}, hits AS ({_ranked('bm', 3)}), t AS (SELECT query_id, string_agg('[' || (rank + 1) || '] ' || text, E'\\n\\n' ORDER BY rank) AS t FROM hits JOIN documents USING (doc_id) GROUP BY query_id)
        SELECT query_id, md5(t) AS digest, CAST({len(prompts.template("concise", True)) - len("{question}{context}") + 1} + length(t) AS INTEGER) AS chars FROM t""",
    ),
    "prompt_layouts": (
        _layouts,
        f"""WITH {_INDEX}, {_BM25_HITS}, hits AS ({_ranked('bm', 3)}), t AS (SELECT query_id, string_agg('[' || (rank + 1) || '] ' || text, E'\\n\\n' ORDER BY rank) AS t FROM hits JOIN documents USING (doc_id) GROUP BY query_id),
        k AS (SELECT * FROM (VALUES {_TEMPLATES}) v(kind, direct, given)) SELECT item_id AS query_id, kind, md5(replace(direct, '{{question}}', text)) AS direct, md5(replace(replace(given, '{{question}}', text), '{{context}}', coalesce(t, ''))) AS given FROM benchmark LEFT JOIN t ON query_id = item_id, k""",
    ),
    "multiref_expand": (
        _expanded,
        sql(f"WITH {PREDICTIONS}, e AS (SELECT pred_id, prediction, unnest(refs) AS r FROM predictions) SELECT p.pred_id, coalesce(max(length(r) / (length(r) + length(e.prediction))), 0.0) AS score FROM predictions p LEFT JOIN e USING (pred_id) GROUP BY p.pred_id", "score"),
    ),
    "retrieval_quality": (
        _quality,
        sql(f"""WITH {_INDEX}, {_BM25_HITS}, hits AS ({_ranked('bm', 5)}) SELECT query_id, avg(score) AS avg_score, max(score) AS max_score, min(score) AS min_score, CAST(count(*) AS INTEGER) AS n_docs, bool_or(contains(lower(d.text), lower(b.text))) AS has_answer FROM hits JOIN documents d USING (doc_id) JOIN benchmark b ON item_id = query_id GROUP BY query_id""", "avg_score", "max_score", "min_score", digits=6),
    ),
    "missing_steps": (
        _steps,
        """WITH s AS (SELECT DISTINCT conv_id % 30 AS experiment, CASE conv_id % 3 WHEN 0 THEN 'fixed_rag' WHEN 1 THEN 'iterative_rag' ELSE 'direct_llm' END AS agent_type, CASE role WHEN 'user' THEN 'batch_search' WHEN 'assistant' THEN 'batch_generate' ELSE 'rerank' END AS type FROM conversations),
        w AS (SELECT * FROM (VALUES ('direct_llm', 'batch_generate'), ('fixed_rag', 'batch_search'), ('fixed_rag', 'batch_generate'), ('iterative_rag', 'batch_search'), ('iterative_rag', 'batch_sufficiency'), ('iterative_rag', 'batch_generate')) t(agent_type, step))
        SELECT experiment, agent_type, step FROM (SELECT DISTINCT experiment, agent_type FROM s) JOIN w USING (agent_type) WHERE (experiment, step) NOT IN (SELECT experiment, type FROM s)""",
    ),
    "trivia_answers": (_loaders, """SELECT CAST(conv_id AS VARCHAR) AS id, string_agg(DISTINCT role, ',' ORDER BY role) AS answers FROM (SELECT conv_id, role FROM conversations UNION ALL SELECT conv_id, 'user' FROM conversations) GROUP BY conv_id"""),
    "position_split": (
        _split,
        """WITH n AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS k, count(*) OVER () AS t FROM documents), s AS (SELECT doc_id, CASE WHEN k <= floor(t * 0.8) THEN 'train' WHEN k <= floor(t * 0.9) THEN 'validation' ELSE 'test' END AS split, CASE WHEN doc_id % 3 <> 0 THEN 'long' WHEN doc_id % 2 = 0 THEN 'yes' END AS answer FROM n)
        SELECT CAST(doc_id AS VARCHAR) AS id, answer, CAST(4 AS INTEGER) AS chars, split FROM s WHERE answer IS NOT NULL""",
    ),
    "paragraph_contexts": (_contexts, """SELECT CAST(r_regionkey AS VARCHAR) AS id, r_name || ': One. Two.' || E'\\n\\nT: ' || r_name AS context, r_name AS answer FROM region"""),
    "context_fallback": (_tech, """SELECT CAST(p_partkey AS VARCHAR) AS id, CASE WHEN p_size % 3 = 0 THEN p_name ELSE p_type END AS context FROM part WHERE p_size % 2 = 0"""),
    "log_timings": (_timings, """SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN 'phase' ELSE 'metric' END AS kind, CASE p_partkey % 3 WHEN 0 THEN 'generating' ELSE 'bertscore' END AS name, p_size + CASE p_partkey % 3 WHEN 0 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS seconds FROM part WHERE p_partkey % 3 < 2"""),
    "query_variations": (_variations, """SELECT p_partkey AS id, lower(p_type) || '|' || p_name || '|what is ' || p_brand AS queries FROM part"""),
    "labels_of_numbers": (
        _labels,
        """SELECT p_partkey AS id, CASE WHEN p_size / 500.0::DOUBLE < 0.001 THEN '***' WHEN p_size / 500.0::DOUBLE < 0.01 THEN '**' WHEN p_size / 500.0::DOUBLE < 0.05 THEN '*' ELSE 'ns' END AS stars, CASE WHEN abs(p_size / 50.0::DOUBLE - 0.5) < 0.2 THEN 'negligible' WHEN abs(p_size / 50.0::DOUBLE - 0.5) < 0.5 THEN 'small' ELSE 'medium' END AS effect,
        CASE WHEN p_partkey % 2 = 0 THEN printf('f1=%.1f%%', p_size / 50.0::DOUBLE * 100) ELSE printf('seconds=%.3f', p_size / 50.0::DOUBLE) END AS shown, p_size % 5 < 2 AS abstains, lower(p_name) AS title FROM part""",
    ),
    "issue_tags": (
        _issues,
        """SELECT p_partkey AS id, concat_ws(',', CASE WHEN p_size % 2 = 0 THEN 'HYBRID_RRF' END, CASE WHEN p_size % 3 = 0 AND p_size % 4 > 1 AND p_size % 5 = 0 THEN 'ITERATIVE_HYDE' END, CASE WHEN p_size % 3 = 0 AND p_size % 4 > 1 AND p_size % 7 = 0 THEN 'ITERATIVE_RERANK' END) AS tags FROM part""",
    ),
    "failure_patterns": (
        _failures,
        """SELECT 'out_of_memory' AS pattern, count(*) FILTER (p_size % 4 = 0) AS n FROM part UNION ALL SELECT 'context_length', count(*) FILTER (p_size % 4 = 2) FROM part UNION ALL SELECT 'timeout', count(*) FILTER (p_size % 4 = 1) FROM part UNION ALL SELECT 'connection', CAST(0 AS BIGINT)""",
    ),
    "spec_union": (
        _spec_union,
        """SELECT r_name AS dataset, CAST(4 AS BIGINT) AS n, CAST(4 AS BIGINT) AS direct, CAST(0 AS BIGINT) AS defaults FROM region UNION ALL SELECT d, 2, 0, 1 FROM (SELECT unnest(['nq', 'hq']) AS d)""",
    ),
    "cache_put": (_cache_put, """SELECT doc_id % 100 AS model, count(DISTINCT text) AS entries FROM documents GROUP BY 1"""),
    "health_counts": (
        lambda s, d: compare.health_counts(results(s, d).select(F.when(F.col("top_k") == 0, "complete").when(F.col("top_k") == 1, F.when(F.col("exp_type") == "rag", "failed").otherwise("generating")).alias("phase"))),
        f"WITH {RESULTS} SELECT count(*) AS total, count(*) FILTER (top_k = 0) AS complete, count(*) FILTER (top_k = 1 AND exp_type = 'rag') AS failed, count(*) FILTER (top_k = 1 AND exp_type = 'direct') AS in_progress, count(*) FILTER (top_k = 2) AS no_state FROM results",
    ),
    "pending_queries": (
        lambda s, d: agents.pending(queries(s, d), _bm25(s, d, 1).filter("score > 20").select("query_id")).select("query_id"),
        f"WITH {_INDEX}, {_BM25_HITS}, hits AS ({_ranked('bm', 1)}) SELECT item_id AS query_id FROM benchmark WHERE item_id NOT IN (SELECT query_id FROM hits WHERE score > 20)",
    ),
    "name_filter": (
        lambda s, d: result_files.matching(_parts(s, d).select(F.col("p_partkey").alias("id"), "p_name"), "*e? w*", "p_name").select("id"),
        "SELECT p_partkey AS id FROM part WHERE p_name LIKE '%e_ w%'",
    ),
    "cache_keys": (
        lambda s, d: _parts(s, d).select(F.col("p_partkey").alias("id"), fusion.cache_key(F.col("p_type"), F.when(F.col("p_size") % 2 == 0, F.col("p_size") / 50.0), F.lit(60)).alias("key")),
        "SELECT p_partkey AS id, CASE WHEN p_size % 2 = 0 THEN p_type || printf('_a%.2f_c60', p_size / 50.0::DOUBLE) ELSE p_type END AS key FROM part",
    ),
    "trial_density": (
        lambda s, d: rounded(compare.stratified_mean(results(s, d), "prompt", "f1", ["top_k", "dataset"]).join(compare.crosstab(results(s, d), "prompt", "top_k").filter("top_k = 1").select("prompt", F.col("n").alias("tried")), "prompt")),
        sql(f"WITH {RESULTS}, m AS (SELECT prompt, avg(m) AS mean, count(m) AS n_strata FROM (SELECT prompt, top_k, dataset, avg(f1) AS m FROM results GROUP BY ALL) GROUP BY prompt) SELECT m.*, t.tried FROM m JOIN (SELECT prompt, count(*) AS tried FROM results WHERE top_k = 1 GROUP BY prompt) t USING (prompt)", "mean"),
    ),
    "error_filter": (
        lambda s, d: _parts(s, d).select(F.col("p_partkey").alias("id"), F.concat(F.when(F.col("p_size") % 3 == 0, "[ERROR: ").when(F.col("p_size") % 3 == 1, "[ABORTED: ").otherwise(""), F.col("p_name")).alias("prediction")).filter(~metrics.is_error(F.col("prediction"))).select("id"),
        "SELECT p_partkey AS id FROM part WHERE p_size % 3 <> 0",
    ),
    "metadata_repair": (
        lambda s, d: lifecycle.repaired(_parts(s, d).select(F.col("p_partkey").alias("id"), F.concat(F.lit("rag_x_dense_bge_large_512_k"), F.col("p_size").cast("string"), F.lit("_a_b_concise_nq")).alias("name"), F.when(F.col("p_size") % 2 == 0, "kept").alias("prompt"), F.lit(None).cast("string").alias("dataset"), F.lit(None).cast("int").alias("top_k"))).drop("name"),
        "SELECT p_partkey AS id, CASE WHEN p_size % 2 = 0 THEN 'kept' ELSE 'concise' END AS prompt, 'nq' AS dataset, CAST(p_size AS INTEGER) AS top_k FROM part",
    ),
}
