"""Queries of experiment planning, lifecycle, names, caches, agents and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.functions import names, parse, prompts
from quillmark.functions import text as tx
from quillmark.operators import agents, dense, fusion, sparse
from quillmark.plans import grid, lifecycle
from quillmark.queries.bindings import RESULTS, Query, documents, queries, read, results, rounded, sql, vectors
from quillmark.queries.retrieval import _BM25_HITS, _INDEX, _TOKENS, _ranked
from quillmark.streaming import incremental


def _distinct(spark: SparkSession, d: str, table: str, column: str, name: str) -> DataFrame:
    return read(spark, d, table).select(F.col(column).cast("string").alias(name)).distinct()


def _grid(spark: SparkSession, d: str) -> DataFrame:
    nations = read(spark, d, "nation").select(F.concat(F.lit("hf:org/"), F.col("n_name"), F.lit("-it")).alias("model"))
    datasets = _distinct(spark, d, "region", "r_name", "dataset")
    types = _distinct(spark, d, "part", "p_brand", "kind").select(F.concat(F.when(F.col("kind") < "Brand#3", "hybrid_").otherwise("dense_"), F.col("kind")).alias("retriever"))
    options = grid.product(spark, {"prompt": ["concise", "cot"], "top_k": [3, 5], "query_transform": ["none", "hyde"], "reranker": ["none", "bge"]})
    return grid.products([nations, datasets, types, options])


def _specs(spark: SparkSession, d: str) -> DataFrame:
    return grid.rag_specs(_grid(spark, d), [10, 60], [0.3, 0.7]).select("name", "model", "dataset", "retriever", "top_k", F.coalesce("rrf_k", F.lit(0)).alias("rrf_k"), F.coalesce("alpha", F.lit(0.0)).alias("alpha"))


_SPECS = """grid AS (SELECT 'hf:org/' || n_name || '-it' AS model, r_name AS dataset, CASE WHEN kind < 'Brand#3' THEN 'hybrid_' ELSE 'dense_' END || kind AS retriever, prompt, CAST(top_k AS INTEGER) AS top_k, query_transform, reranker
  FROM nation, (SELECT DISTINCT r_name FROM region), (SELECT DISTINCT p_brand AS kind FROM part), (SELECT unnest(['concise', 'cot']) AS prompt), (SELECT unnest([3, 5]) AS top_k), (SELECT unnest(['none', 'hyde']) AS query_transform), (SELECT unnest(['none', 'bge']) AS reranker)),
opts AS (SELECT *, unnest(CASE WHEN contains(retriever, 'hybrid') THEN [10, 60] ELSE [NULL] END) AS rrf_k FROM grid), both_ AS (SELECT *, unnest(CASE WHEN contains(retriever, 'hybrid') THEN [0.3::DOUBLE, 0.7::DOUBLE] ELSE [NULL::DOUBLE] END) AS alpha FROM opts),
specs AS (SELECT 'rag_' || left(replace(replace(replace(split_part(model, '/', 2), '-it', 'I'), '.', ''), '-', ''), 12) || '_' || dataset || '_' || left(sha256('agent_params=None|agent_type=None|alpha=' || coalesce(CAST(alpha AS VARCHAR), 'None') || '|model=' || model || '|prompt=' || prompt || '|qt=' || query_transform || '|retriever=' || retriever || '|rr=' || reranker || '|rrf_k=' || coalesce(CAST(rrf_k AS VARCHAR), 'None') || '|top_k=' || top_k), 8) AS name, * FROM both_)"""
_KEY = "sha256({} || '#42')"
_SPACE = {"model": ["AUTOMOBILE", "BUILDING", "MACHINERY"], "dataset": ["1-URGENT", "2-HIGH"], "prompt": ["p0", "p1"], "retriever": ["0", "1", "2"], "top_k": [0, 1], "direct_prompt": ["p0"]}


def _space(spark: SparkSession, d: str) -> DataFrame:
    rows = results(spark, d)
    return rows.filter(grid.in_space(rows, _SPACE)).select("id")


def _health(spark: SparkSession, d: str) -> DataFrame:
    turns = read(spark, d, "conversations").withColumn("experiment", F.col("conv_id") % 20)
    questions = turns.filter("role = 'user'").select("experiment", F.concat_ws("-", "conv_id", F.col("turn")).alias("idx"))
    done = turns.filter("role = 'assistant'").select("experiment", F.concat_ws("-", "conv_id", F.col("turn") - 1).alias("idx"))
    states = turns.select("experiment").distinct().select("experiment", F.when(F.col("experiment") % 3 == 0, "complete").otherwise("generated").alias("phase"), F.array(F.lit("f1"), F.lit("em")).alias("requested"), F.when(F.col("experiment") % 2 == 0, F.array(F.lit("f1"), F.lit("em"))).otherwise(F.array(F.lit("f1"))).alias("computed"))
    return lifecycle.health(states, questions, done)


def _names(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.concat_ws("_", F.when(F.col("p_partkey") % 3 == 0, "direct").otherwise("rag"), F.lit("vllm_gemma22bit"), F.when(F.col("p_partkey") % 2 == 0, "dense_bge_large_512").otherwise("hybrid_gte_qwen2_1024"), F.concat(F.lit("k"), (F.col("p_partkey") % 9 + 1).cast("string")), F.when(F.col("p_partkey") % 4 == 0, "hyde").otherwise("plain"), F.when(F.col("p_partkey") % 5 == 0, "bgev2").otherwise("raw"), F.lit("concise"), F.when(F.col("p_partkey") % 2 == 0, "nq").otherwise("triviaqa")).alias("name"))
    told = rows.withColumn("t", names.parse_experiment(F.col("name")))
    return told.select("id", "name", "t.exp_type", "t.dataset", "t.model_short", "t.prompt", F.coalesce("t.top_k", F.lit(0)).alias("top_k"), "t.retriever_type", "t.embedding_model", "t.query_transform", "t.reranker", "t.agent_type", names.without_unwired(F.col("name")).alias("clean"))


def _responses(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") / 40.0).alias("x"))
    said = rows.withColumn("r", F.concat(F.lit("Answer.\nConfidence: "), F.format_string("%.3f", "x"), F.when(F.col("id") % 3 == 0, " NOT_SUPPORTED").when(F.col("id") % 3 == 1, " partially_supported").otherwise(" INSUFFICIENT")))
    return said.select("id", parse.confidence(F.col("r")).alias("confidence"), parse.verification(F.col("r")).alias("verdict"), parse.sufficient(F.col("r")).alias("enough"), parse.judgement(F.when(F.col("id") % 2 == 0, "CORRECT. Yes").otherwise("I think this is\nincorrect")).alias("judged"))


def _search(spark: SparkSession, d: str, k: int = 5):
    docs = documents(spark, d)
    return lambda asked: sparse.bm25(docs, asked.select("query_id", "text"), k).join(docs, "doc_id").select("query_id", "doc_id", "text", "score", "rank")


def _last_word(asked):
    """Of the question."""
    return asked.str.rsplit("Question: ", n=1).str[-1].str.split("\n\n").str[0].str.split().str[-1]


def _length_says(asked):
    return asked.str.len().map(lambda n: "SUFFICIENT" if n % 2 else "INSUFFICIENT")


def _length_sure(asked):
    return asked.str.len().map(lambda n: f"CONFIDENCE: {n % 10 / 10}")


def _agent(spark: SparkSession, d: str, kind: str) -> DataFrame:
    asked, search, model = queries(spark, d), _search(spark, d), agents.model_slot(_last_word)
    if kind == "direct":
        return agents.direct(asked, model)
    if kind == "rag":
        return agents.rag(asked, search, model).select("query_id", F.size("docs").alias("n_docs"), "prediction")
    if kind == "iterative":
        return agents.iterative(asked, search, agents.model_slot(_length_says), model, model).select("query_id", "iterations", F.size("docs").alias("n_docs"), "prediction")
    return agents.self_reflective(asked, search, agents.model_slot(_length_sure), model).select("query_id", "confidence", "route", F.size("docs").alias("n_docs"))


_CONCISE = prompts.template("concise", False).replace("'", "''")
_ASKED = f"asked AS (SELECT item_id AS query_id, text, replace('{_CONCISE}', '{{question}}', text) AS prompt FROM benchmark)"
_GIVEN = len(prompts.template("concise", True)) - len("{question}{context}")
_LAST = r"list_filter(string_split_regex(text, '\s+'), lambda w: w <> '')[-1]"


def _events(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def _fetch(spark: SparkSession, d: str) -> DataFrame:
    rows = results(spark, d).select("id", "top_k", F.when(F.col("id") % 2 == 0, "bge").alias("reranker"), F.when(F.col("id") % 7 == 0, F.lit(50)).alias("explicit"))
    return rows.select("id", fusion.fetch_k(F.col("explicit"), F.col("top_k"), F.col("reranker")).alias("fetch_k")).fillna(0)


_LIMITS = [("AUTOMOBILE", 2048), ("BUILDING", 4096), ("MACHINERY", 1024)]


def _context(spark: SparkSession, d: str, f) -> DataFrame:
    limits = spark.createDataFrame(_LIMITS, "model string, context int")
    return f(results(spark, d).withColumn("chunk_chars", (F.col("id") % 5 + 1) * 1024).select("id", "model", "top_k", "chunk_chars"), limits)


_CONTEXT = RESULTS + ", limits AS (SELECT * FROM (VALUES " + ", ".join(f"('{m}', {n})" for m, n in _LIMITS) + ") t(model, context)), rows_ AS (SELECT id, model, top_k, (id % 5 + 1) * 1024 AS chunk_chars FROM results)"

QUERIES: dict[str, tuple[Query, str | None]] = {
    "grid_specs": (_specs, f"WITH {_SPECS} SELECT name, model, dataset, retriever, top_k, CAST(coalesce(rrf_k, 0) AS INTEGER) AS rrf_k, coalesce(alpha, 0.0) AS alpha FROM specs"),
    "random_sample": (lambda s, d: grid.sample(_specs(s, d), 50).select("name"), f"WITH {_SPECS} SELECT name FROM specs ORDER BY {_KEY.format('name')}, name LIMIT 50"),
    "stratified_sample": (
        lambda s, d: grid.stratified_sample(_specs(s, d), ["dataset", "retriever"], 60).select("name"),
        f"""WITH {_SPECS}, f AS (SELECT name, dataset, retriever, {_KEY.format('name')} AS h, row_number() OVER (PARTITION BY dataset, retriever ORDER BY {_KEY.format('name')}, name) = 1 AS first_ FROM specs)
        SELECT name FROM (SELECT *, row_number() OVER (ORDER BY first_ DESC, CASE WHEN first_ THEN dataset END, CASE WHEN first_ THEN retriever END, h, name) AS k FROM f) WHERE k <= 60""",
    ),
    "not_run": (
        lambda s, d: grid.not_run(_specs(s, d), grid.sample(_specs(s, d), 50)).groupBy("dataset").agg(F.count("*").alias("n")),
        f"WITH {_SPECS}, done AS (SELECT name FROM specs ORDER BY {_KEY.format('name')}, name LIMIT 50) SELECT dataset, count(*) AS n FROM specs WHERE name NOT IN (SELECT name FROM done) GROUP BY dataset",
    ),
    "round_robin": (lambda s, d: grid.round_robin(_distinct(s, d, "region", "r_name", "dataset"), 3), """SELECT r_name AS dataset, CAST(epoch AS INTEGER) AS epoch, CAST(row_number() OVER (PARTITION BY epoch ORDER BY sha256('42|' || epoch || '|' || r_name)) - 1 AS INTEGER) AS turn FROM (SELECT DISTINCT r_name FROM region), (SELECT unnest([0, 1, 2]) AS epoch)"""),
    "search_space_filter": (
        _space,
        f"""WITH {RESULTS} SELECT id FROM results WHERE model IN ('AUTOMOBILE', 'BUILDING', 'MACHINERY') AND dataset IN ('1-URGENT', '2-HIGH') AND CASE WHEN exp_type = 'direct' THEN prompt = 'p0' ELSE retriever IN ('0', '1', '2') AND top_k IN (0, 1) AND prompt IN ('p0', 'p1') END""",
    ),
    "outside_space": (
        lambda s, d: grid.outside_report(results(s, d), {k: v for k, v in _SPACE.items() if k != "direct_prompt"}),
        f"WITH {RESULTS} " + " UNION ALL ".join(f"""SELECT '{c}' AS dimension, count(*) AS n, string_agg(DISTINCT CAST({c} AS VARCHAR), ',' ORDER BY CAST({c} AS VARCHAR)) AS "values" FROM results WHERE CAST({c} AS VARCHAR) NOT IN ({', '.join(f"'{x}'" for x in v)}) HAVING count(*) > 0""" for c, v in _SPACE.items() if c != "direct_prompt"),
    ),
    "context_feasible": (lambda s, d: _context(s, d, grid.feasible).select("id"), f"WITH {_CONTEXT} SELECT id FROM rows_ LEFT JOIN limits USING (model) WHERE context IS NULL OR chunk_chars / 4.0 * top_k + 500 <= context - 256"),
    "context_risk": (
        lambda s, d: rounded(_context(s, d, grid.context_risk).select("id", "tokens", "headroom_pct")),
        sql(f"WITH {_CONTEXT} SELECT id, chunk_chars / 4.0::DOUBLE * top_k + 500 AS tokens, (context - (chunk_chars / 4.0::DOUBLE * top_k + 500)) / context * 100 AS headroom_pct FROM rows_ JOIN limits USING (model) WHERE chunk_chars / 4.0 * top_k + 500 > 0.9 * context", "tokens", "headroom_pct"),
    ),
    "warm_start": (
        lambda s, d: rounded(grid.warm_start(results(s, d).withColumn("phase", F.when(F.col("id") % 2 == 0, "complete").otherwise("failed")), {"model": _SPACE["model"]}, ["model", "dataset", "retriever"], "f1").select("id", "f1")),
        sql(f"WITH {RESULTS} SELECT id, f1 FROM results WHERE id % 2 = 0 AND model IN ('AUTOMOBILE', 'BUILDING', 'MACHINERY') QUALIFY row_number() OVER (PARTITION BY model, dataset, retriever ORDER BY f1 DESC, id) = 1", "f1"),
    ),
    "fetch_k": (_fetch, f"WITH {RESULTS} SELECT id, CAST(CASE WHEN id % 7 = 0 THEN 50 WHEN id % 2 = 0 THEN top_k * 4 ELSE 0 END AS INTEGER) AS fetch_k FROM results"),
    "health": (
        _health,
        """WITH t AS (SELECT *, conv_id % 20 AS experiment FROM conversations), m AS (SELECT experiment, count(*) AS missing FROM t u WHERE role = 'user' AND NOT EXISTS (SELECT 1 FROM t a WHERE a.role = 'assistant' AND a.conv_id = u.conv_id AND a.turn = u.turn + 1) GROUP BY experiment),
        s AS (SELECT DISTINCT experiment, CASE WHEN experiment % 3 = 0 THEN 'complete' ELSE 'generated' END AS phase, CAST(CASE WHEN experiment % 2 = 0 THEN 0 ELSE 1 END AS INTEGER) AS missing_metrics FROM t)
        SELECT experiment, phase, coalesce(missing, 0) AS missing_predictions, missing_metrics, phase = 'complete' AND coalesce(missing, 0) = 0 AND missing_metrics = 0 AS healthy FROM s LEFT JOIN m USING (experiment)""",
    ),
    "proven_phase": (
        lambda s, d: results(s, d).select("id", F.when(F.col("top_k") == 0, "complete").when(F.col("top_k") == 1, "computing_metrics").otherwise("failed").alias("phase"), (F.col("id") % 2 == 0).alias("p"), (F.col("id") % 5 == 0).alias("r")).select("id", lifecycle.proven_phase(F.col("phase"), F.lit(True), F.col("p"), F.col("r")).alias("phase")),
        f"""WITH {RESULTS}, x AS (SELECT id, CASE top_k WHEN 0 THEN 'complete' WHEN 1 THEN 'computing_metrics' ELSE 'failed' END AS phase, CASE top_k WHEN 0 THEN 4 WHEN 1 THEN 3 ELSE -1 END AS n, CASE WHEN id % 5 = 0 THEN 'complete' WHEN id % 2 = 0 THEN 'generated' ELSE 'generating' END AS proven, CASE WHEN id % 5 = 0 THEN 4 WHEN id % 2 = 0 THEN 2 ELSE 1 END AS pn FROM results)
        SELECT id, CASE WHEN phase = 'failed' THEN phase WHEN n > pn THEN proven ELSE phase END AS phase FROM x""",
    ),
    "resolve_names": (
        lambda s, d: lifecycle.resolve_names(results(s, d).select("id", F.concat_ws("-", "model", "dataset", "retriever").alias("new_name"), "f1", F.when(F.col("top_k") == 0, "complete").otherwise("failed").alias("phase"))).select("id", "new_name", "winner", "agree"),
        f"""WITH {RESULTS}, r AS (SELECT id, model || '-' || dataset || '-' || retriever AS new_name, f1, top_k = 0 AS done FROM results) SELECT id, new_name, first_value(id) OVER (PARTITION BY new_name ORDER BY CAST(done AS INT) DESC, f1 DESC, id) AS winner, max(f1) OVER (PARTITION BY new_name) - min(f1) OVER (PARTITION BY new_name) <= 0.01 AS agree FROM r""",
    ),
    "parse_names": (
        _names,
        """WITH n AS (SELECT p_partkey AS id, p_partkey % 3 = 0 AS direct, p_partkey % 2 = 0 AS dense, p_partkey % 4 = 0 AS hyde, p_partkey % 5 = 0 AS bge, CAST(p_partkey % 9 + 1 AS INTEGER) AS k FROM part),
        s AS (SELECT *, CASE WHEN direct THEN 'direct' ELSE 'rag' END || '_vllm_gemma22bit_' || CASE WHEN dense THEN 'dense_bge_large_512' ELSE 'hybrid_gte_qwen2_1024' END || '_k' || k AS head, CASE WHEN dense THEN 'concise_nq' ELSE 'concise_triviaqa' END AS tail FROM n)
        SELECT id, head || CASE WHEN hyde THEN '_hyde' ELSE '_plain' END || CASE WHEN bge THEN '_bgev2_' ELSE '_raw_' END || tail AS name, CASE WHEN direct THEN 'direct' ELSE 'rag' END AS exp_type, CASE WHEN dense THEN 'nq' ELSE 'triviaqa' END AS dataset, 'Gemma2-2B' AS model_short, 'concise' AS prompt,
          CASE WHEN NOT direct THEN k ELSE 0 END AS top_k, CASE WHEN NOT direct THEN CASE WHEN dense THEN 'dense' ELSE 'hybrid' END END AS retriever_type, CASE WHEN NOT direct THEN CASE WHEN dense THEN 'BGE-large' ELSE 'GTE-Qwen2-1.5B' END END AS embedding_model, CASE WHEN NOT direct AND hyde THEN 'hyde' ELSE 'none' END AS query_transform,
          CASE WHEN NOT direct AND bge THEN 'bge-v2' ELSE 'none' END AS reranker, CASE WHEN direct THEN 'direct_llm' ELSE 'fixed_rag' END AS agent_type, CASE WHEN hyde OR bge THEN head || CASE WHEN hyde THEN '' ELSE '_plain' END || CASE WHEN bge THEN '_' ELSE '_raw_' END || tail END AS clean FROM s""",
    ),
    "parse_responses": (
        lambda s, d: rounded(_responses(s, d)),
        sql("""SELECT p_partkey AS id, least(1.0::DOUBLE, round(p_size / 40.0::DOUBLE, 3)) AS confidence, CASE p_partkey % 3 WHEN 0 THEN 'NOT_SUPPORTED' WHEN 1 THEN 'PARTIALLY_SUPPORTED' ELSE 'UNKNOWN' END AS verdict, false AS enough, CASE WHEN p_partkey % 2 = 0 THEN 'correct' ELSE 'incorrect' END AS judged FROM part""", "confidence"),
    ),
    "check_vectors": (
        lambda s, d: lifecycle.check_vectors(vectors(s, d).select((F.col("doc_id") % 400).alias("key"), F.when(F.col("doc_id") % 50 == 0, F.transform("embedding", lambda x: x * 0)).when(F.col("doc_id") % 50 == 1, F.slice("embedding", 1, 10)).otherwise(F.col("embedding")).alias("v")), 64),
        """WITH v AS (SELECT vec_id % 400 AS key, CASE WHEN vec_id % 50 = 0 THEN list_transform(embedding, lambda x: x * 0) WHEN vec_id % 50 = 1 THEN embedding[1:10] ELSE embedding END AS v FROM embeddings)
        SELECT count(*) AS n, count(*) FILTER (len(v) <> 64) AS wrong_size, CAST(0 AS BIGINT) AS not_finite, count(*) FILTER (list_max(v) = 0 AND list_min(v) = 0) AS zero, count(*) FILTER (abs(sqrt(list_sum(list_transform(v, lambda x: x::DOUBLE * x))) - 1) > 0.001) AS not_unit, count(*) - count(DISTINCT key) AS duplicates FROM v""",
    ),
    "flatten_text": (
        lambda s, d: documents(s, d).select("doc_id", F.md5(tx.squeeze(F.trim(F.col("text")))).alias("h"), F.size(tx.sentences(F.col("text"))).alias("sentences"), tx.shorten(F.col("text"), 20).alias("short")),
        r"""SELECT doc_id, md5(regexp_replace(trim(text), '\s+', ' ', 'g')) AS h, CAST(len(list_filter(string_split_regex(text, '[.!?]+'), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g') <> '')) AS INTEGER) AS sentences, CASE WHEN length(text) > 20 THEN left(text, 20) || '...' ELSE text END AS short FROM documents""",
    ),
    "agent_direct": (lambda s, d: _agent(s, d, "direct"), f"WITH {_ASKED} SELECT query_id, prompt, {_LAST} AS prediction FROM asked"),
    "agent_rag": (
        lambda s, d: _agent(s, d, "rag"),
        f"WITH {_ASKED}, {_INDEX}, {_BM25_HITS}, hits AS ({_ranked('bm', 5)}), n AS (SELECT query_id, CAST(count(*) AS INTEGER) AS n_docs FROM hits GROUP BY query_id) SELECT query_id, n_docs, {_LAST} AS prediction FROM asked LEFT JOIN n USING (query_id)",
    ),
    "agent_iterative": (
        lambda s, d: _agent(s, d, "iterative"),
        rf"""WITH {_ASKED}, {_INDEX}, {_BM25_HITS}, one AS ({_ranked('bm', 5)}), first_ AS (SELECT query_id, doc_id, text, score, rank FROM one JOIN documents USING (doc_id) QUALIFY row_number() OVER (PARTITION BY query_id, text ORDER BY rank) = 1),
        placed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS place FROM first_), given AS (SELECT query_id, string_agg('[' || place || '] ' || text, chr(10) || chr(10) ORDER BY place) AS t FROM placed GROUP BY query_id),
        told AS (SELECT query_id, text, {_LAST} AS ask, ({_GIVEN} + length(text) + length(coalesce(t, ''))) % 2 = 1 AS enough FROM asked LEFT JOIN given USING (query_id)),
        q2 AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest({_TOKENS.format('ask')}) AS term FROM told WHERE NOT enough) GROUP BY ALL), {_BM25_HITS.replace('bm AS', 'bm2 AS').replace('JOIN q USING', 'JOIN q2 USING')}, two AS ({_ranked('bm2', 5)}),
        found AS (SELECT query_id, text FROM one JOIN documents USING (doc_id) UNION SELECT query_id, text FROM two JOIN documents USING (doc_id)), n AS (SELECT query_id, CAST(least(10, count(*)) AS INTEGER) AS n_docs FROM found GROUP BY query_id)
        SELECT query_id, CASE WHEN enough THEN 1 ELSE 2 END::INTEGER AS iterations, n_docs, ask AS prediction FROM told LEFT JOIN n USING (query_id)""",
    ),
    "agent_self": (
        lambda s, d: _agent(s, d, "self"),
        f"""WITH {_ASKED}, {_INDEX}, {_BM25_HITS}, hits AS ({_ranked('bm', 5)}), n AS (SELECT query_id, CAST(count(*) AS INTEGER) AS n FROM hits GROUP BY query_id), c AS (SELECT query_id, n, (length(prompt) % 10)::DOUBLE / 10 AS confidence FROM asked LEFT JOIN n USING (query_id))
        SELECT query_id, confidence, CASE WHEN confidence > 0.7 THEN 'direct' ELSE 'rag' END AS route, CASE WHEN confidence <= 0.7 THEN n END AS n_docs FROM c""",
    ),
    "event_tumbling": (
        lambda s, d: rounded(incremental.tumbling(_events(s, d), "ts", "event_type", "value").withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd")), 6),
        sql("SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS window_start, event_type, count(*) AS n, sum(value) AS total FROM events GROUP BY ALL", "total", digits=6),
    ),
    "event_sessions": (
        lambda s, d: incremental.sessions(_events(s, d), "ts", "user_id", "6 hours").groupBy("user_id").agg(F.count("*").alias("sessions"), F.max("n").alias("longest")),
        """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g), c AS (SELECT user_id, k, count(*) AS n FROM s GROUP BY ALL)
        SELECT user_id, count(*) AS sessions, max(n) AS longest FROM c GROUP BY user_id""",
    ),
    "dense_build": (
        lambda s, d: rounded(dense.build(vectors(s, d)).select("doc_id", tx.norm(F.col("v")).alias("length"), F.get("v", F.lit(0)).alias("first"))),
        sql("SELECT vec_id AS doc_id, 1.0::DOUBLE AS length, embedding[1]::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS first FROM embeddings", "length", '"first"'),
    ),
}
