"""Queries over documents, benchmark items and vectors: indexes, search, fusion, chunks, and scores of predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmark.functions import text as tx
from quillmark.operators import chunking, dense, fusion, metrics, ranking, sparse
from quillmark.queries.bindings import PREDICTIONS, Query, documents, predictions, queries, query_vectors, read, rounded, sql, vectors
from quillmark.sources import corpora

K = 10


def _bm25(spark: SparkSession, d: str, k: int = K) -> DataFrame:
    return sparse.bm25(documents(spark, d), queries(spark, d), k)


def _dense(spark: SparkSession, d: str, k: int = K) -> DataFrame:
    return dense.search(dense.build(vectors(spark, d)), query_vectors(spark, d), k)


# DuckDB: tokens of two word characters at least, in Unicode classes.
_TOKENS = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}_]{{2,}}')"
_INDEX = rf"""d AS (SELECT doc_id, {_TOKENS.format("text")} AS t FROM documents), size AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM d),
p AS (SELECT doc_id, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT doc_id, len(t) AS dl, unnest(t) AS term FROM d) GROUP BY doc_id, term),
df AS (SELECT term, count(*) AS df FROM p GROUP BY term), q AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT item_id AS query_id, unnest({_TOKENS.format("text")}) AS term FROM benchmark) GROUP BY ALL)"""
_BM25_HITS = """bm AS (SELECT query_id, doc_id, round(sum(qtf * ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * (tf / (tf + 1.5::DOUBLE * (1 - 0.75::DOUBLE + 0.75::DOUBLE * dl / avgdl)))), 9) AS score
FROM p JOIN df USING (term) JOIN q USING (term), size GROUP BY ALL)"""


def _ranked(hits: str, k: int, base: int = 0, doc: str = "doc_id") -> str:
    return f"SELECT query_id, {doc}, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, {doc}) - {1 - base} AS INTEGER) AS rank FROM {hits} WHERE true QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, {doc}) <= {k}"


_UNIT = """u AS (SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: x / greatest(sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 1e-12)) AS v FROM embeddings),
dq AS (SELECT item_id AS query_id, v FROM benchmark JOIN u ON vec_id = item_id)"""
_DENSE_HITS = "dh AS (SELECT query_id, vec_id AS doc_id, round(list_inner_product(dq.v, u.v), 9) AS score FROM dq, u)"
_NORM = r"trim(regexp_replace(regexp_replace(lower({}), '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '\s+', ' ', 'g'))"
_BARE = r"""translate(lower({}), '!"#$%&''()*+,-./:;<=>?@[\]^_`{{|}}~', '')"""
_ARTICLE = r"""'(^|[^\p{{L}}\p{{N}}_])(a|an|the)($|[^\p{{L}}\p{{N}}_])', '\1 \3', 'g'"""
# Twice, as a match takes the blank that the next article needs before it.
_ANSWER = rf"""trim(regexp_replace(regexp_replace(regexp_replace({_BARE}, {_ARTICLE}), {_ARTICLE}), '\s+', ' ', 'g'))"""
_WORDS = r"list_filter(string_split_regex({}, '\s+'), lambda w: w <> '')"


def _evaluated(*names: str) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return rounded(metrics.evaluate(predictions(spark, d), list(names)).select("pred_id", *names))

    return run


def _chunk_stats(name: str) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        docs = documents(spark, d).select(F.col("doc_id").alias("id"), "text")
        return chunking.chunk(docs, name).groupBy("parent_id").agg(F.count("*").alias("n_chunks"), F.sum(F.length("text")).cast("long").alias("chars"), F.max("total_chunks").alias("total"))

    return run


def _stats(pieces: str) -> str:
    """SQL of _chunk_stats: pieces is one of tables, the last (id, k, piece); pieces under 50 trimmed characters go after they are counted."""
    return rf"""WITH RECURSIVE {pieces}, t AS (SELECT id, regexp_replace(piece, '^\s+|\s+$', '', 'g') AS text, count(*) OVER (PARTITION BY id) AS total FROM pieces)
    SELECT CAST(id AS VARCHAR) AS parent_id, count(*) AS n_chunks, CAST(sum(length(text)) AS BIGINT) AS chars, CAST(max(total) AS INTEGER) AS total FROM t WHERE length(text) >= 50 GROUP BY id"""


def _hierarchy(spark: SparkSession, d: str) -> DataFrame:
    docs = documents(spark, d).select(F.col("doc_id").alias("id"), "text")
    return chunking.hierarchical(docs).groupBy("parent_id").agg(F.count("*").alias("n_children"), F.first(F.length("parent_text")).alias("parent_chars"))


def _hybrid(spark: SparkSession, d: str) -> DataFrame:
    more = fusion.candidates(5)
    return fusion.rrf(_dense(spark, d, more), _bm25(spark, d, more), 5, alpha=0.6)


def _hierarchical(spark: SparkSession, d: str) -> DataFrame:
    children = dense.build(vectors(spark, d)).withColumn("parent_id", F.expr("doc_id div 5"))
    return dense.search_hierarchical(children, query_vectors(spark, d), 5)


def _multiquery(spark: SparkSession, d: str) -> DataFrame:
    asked = fusion.sentence_expansions(queries(spark, d))
    keyed = asked.withColumn("key", F.col("query_id") * 100 + F.col("expansion"))
    hits = sparse.bm25(documents(spark, d), keyed.select(F.col("key").alias("query_id"), "text"), 5).withColumnRenamed("query_id", "key")
    named = hits.join(keyed.select("key", "query_id", "expansion"), "key").join(documents(spark, d), "doc_id")
    return fusion.merge_expansions(named, 5)


def _rerank(spark: SparkSession, d: str) -> DataFrame:
    return fusion.rerank(_bm25(spark, d), queries(spark, d), documents(spark, d), 5)


def _articles(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "documents").select(F.concat("lang", F.lit("_"), (F.col("doc_id") % 300).cast("string")).alias("title"), "text", F.col("doc_id").alias("at"))
    return corpora.articles(rows, "at").select("id", "title", F.length("text").alias("chars"))


def _top_sources(spark: SparkSession, d: str) -> DataFrame:
    scored = read(spark, d, "documents").join(read(spark, d, "labels"), "doc_id").groupBy("source").agg(F.sum("quality").alias("score"))
    return corpora.top_titles(scored.select(F.col("source").alias("title"), "score"), 5)


def _context(spark: SparkSession, d: str, *names: str) -> DataFrame:
    """Benchmark items as references, their best three documents as context."""
    hits = _bm25(spark, d, 3).join(documents(spark, d), "doc_id")
    given = hits.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"]).alias("contexts"))
    rows = queries(spark, d).join(given, "query_id", "left").select(F.col("query_id").alias("pred_id"), F.col("text").alias("prediction"), F.array("text").alias("references"), "contexts")
    return rounded(metrics.evaluate(rows, list(names)).select("pred_id", *names))


def _cache_misses(spark: SparkSession, d: str) -> DataFrame:
    docs = documents(spark, d).select("doc_id", tx.text_hash(F.col("text")).alias("text_hash"))
    return fusion.cache_split(docs, docs.filter("doc_id % 2 = 0").select("text_hash").distinct(), ["text_hash"])[1].groupBy().agg(F.count("*").alias("misses"), F.countDistinct("text_hash").alias("texts"))


def _cache_stats(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "documents").select("lang", tx.text_hash(F.col("text")).alias("h"), F.octet_length("text").alias("b")).dropDuplicates(["lang", "h"])
    return rows.groupBy("lang").agg(F.count("*").alias("entries"), F.sum(F.col("b").cast("long")).alias("bytes"))


QUERIES: dict[str, tuple[Query, str | None]] = {
    "bm25_topk": (_bm25, f"WITH {_INDEX}, {_BM25_HITS} {_ranked('bm', K)}"),
    "tfidf_topk": (
        lambda s, d: sparse.tfidf(documents(s, d), queries(s, d), K),
        f"""WITH {_INDEX}, voc AS (SELECT term, ln((1 + n)::DOUBLE / (1 + df)) + 1 AS idf FROM (SELECT term, sum(tf) AS total, count(*) AS df FROM p GROUP BY term ORDER BY total DESC, term LIMIT 50000), size),
        dv AS (SELECT doc_id, term, tf * idf AS w FROM p JOIN voc USING (term)), dn AS (SELECT doc_id, sqrt(sum(w * w)) AS l FROM dv GROUP BY doc_id), qv AS (SELECT query_id, term, qtf * idf AS w FROM q JOIN voc USING (term)), qn AS (SELECT query_id, sqrt(sum(w * w)) AS l FROM qv GROUP BY query_id),
        h AS (SELECT query_id, doc_id, round(sum((dv.w / dn.l) * (qv.w / qn.l)), 9) AS score FROM dv JOIN dn USING (doc_id) JOIN qv USING (term) JOIN qn USING (query_id) GROUP BY ALL) {_ranked('h', K)}""",
    ),
    "tfidf_english_topk": (lambda s, d: sparse.tfidf(documents(s, d), queries(s, d), K, stop_words="english"), None),  # the list is Spark's
    "matched_terms": (
        lambda s, d: sparse.matched_terms(documents(s, d), queries(s, d)),
        f"WITH {_INDEX} SELECT query_id, term, df, CAST(rn AS INTEGER) AS rank FROM (SELECT query_id, term, df, row_number() OVER (PARTITION BY query_id ORDER BY df, term) AS rn FROM q JOIN df USING (term)) WHERE rn <= 5",
    ),
    "dense_topk": (_dense, f"WITH {_UNIT}, {_DENSE_HITS} {_ranked('dh', K)}"),
    "dense_topk_sharded": (lambda s, d: dense.search_sharded(dense.build(vectors(s, d)), query_vectors(s, d), K), f"WITH {_UNIT}, {_DENSE_HITS} {_ranked('dh', K)}"),
    "hierarchical_topk": (
        _hierarchical,
        f"""WITH {_UNIT}, {_DENSE_HITS}, c AS ({_ranked('dh', 25)}), b AS (SELECT query_id, doc_id // 5 AS parent_id, score, doc_id, row_number() OVER (PARTITION BY query_id, doc_id // 5 ORDER BY score DESC, doc_id) AS rn FROM c),
        h AS (SELECT query_id, parent_id AS doc_id, score, doc_id AS matched_child FROM b WHERE rn = 1) SELECT query_id, doc_id, score, matched_child, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) - 1 AS INTEGER) AS rank FROM h QUALIFY rank < 5""",
    ),
    "hybrid_rrf": (
        _hybrid,
        f"""WITH {_INDEX}, {_BM25_HITS}, {_UNIT}, {_DENSE_HITS}, x AS ({_ranked('dh', 15)}), y AS ({_ranked('bm', 15)}), parts AS (SELECT query_id, doc_id, 0.6::DOUBLE / (61 + rank) AS part FROM x UNION ALL SELECT query_id, doc_id, (1 - 0.6::DOUBLE) / (61 + rank) FROM y),
        h AS (SELECT query_id, doc_id, round(sum(part), 9) AS score FROM parts GROUP BY ALL) {_ranked('h', 5)}""",
    ),
    "multiquery_merge": (
        _multiquery,
        rf"""WITH sents AS (SELECT item_id, text, list_filter(list_transform(string_split_regex(text, '[.!?]+'), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: s <> '')[1:3] AS ss FROM benchmark),
        ex AS (SELECT item_id, unnest(list_prepend(text, ss)) AS qtext, unnest(range(0, len(ss) + 1)) AS expansion FROM sents),
        {_INDEX.split(', q AS (')[0]}, q AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT item_id * 100 + expansion AS query_id, unnest({_TOKENS.format('qtext')}) AS term FROM ex) GROUP BY ALL), {_BM25_HITS}, hits AS ({_ranked('bm', 5)}),
        f AS (SELECT h.query_id // 100 AS query_id, doc_id, score, row_number() OVER (PARTITION BY h.query_id // 100, text ORDER BY h.query_id % 100, rank) AS rn FROM hits h JOIN documents USING (doc_id)), g AS (SELECT query_id, doc_id, score FROM f WHERE rn = 1) {_ranked('g', 5)}""",
    ),
    "rerank_overlap": (
        lambda s, d: rounded(_rerank(s, d)),
        rf"""WITH {_INDEX}, {_BM25_HITS}, hits AS ({_ranked('bm', K)}), w AS (SELECT query_id, doc_id, score AS retrieval_score, rank + 1 AS retrieval_rank, list_distinct({_WORDS.format(_NORM.format('b.text'))}) AS a, list_distinct({_WORDS.format(_NORM.format('d.text'))}) AS c FROM hits JOIN benchmark b ON item_id = query_id JOIN documents d USING (doc_id)),
        s AS (SELECT query_id, doc_id, retrieval_score, CAST(retrieval_rank AS INTEGER) AS retrieval_rank, round(CASE WHEN len(a) = 0 THEN 0.0 ELSE len(list_intersect(a, c))::DOUBLE / len(a) END, 9) AS rerank_score FROM w)
        SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, retrieval_rank) AS INTEGER) AS rank FROM s QUALIFY rank <= 5""",
    ),
    "em_f1_multiref": (
        _evaluated("exact_match", "f1"),
        rf"""WITH {PREDICTIONS}, n AS (SELECT pred_id, {_ANSWER.format('prediction')} AS p, list_transform(refs, lambda r: {_ANSWER.format('r')}) AS rs FROM predictions), r AS (SELECT pred_id, {_WORDS.format('p')} AS pw, p, unnest(rs) AS ref FROM n), w AS (SELECT pred_id, p, ref, pw, {_WORDS.format('ref')} AS rw FROM r),
        f AS (SELECT pred_id, CAST(p = ref AS INT)::DOUBLE AS em, coalesce(list_sum(list_transform(list_intersect(list_distinct(pw), list_distinct(rw)), lambda x: least(len(list_filter(pw, lambda y: y = x)), len(list_filter(rw, lambda y: y = x))))), 0) AS shared, len(pw) AS a, len(rw) AS b FROM w)
        SELECT pred_id, coalesce(max(em), 0.0) AS exact_match, round(coalesce(max(CASE WHEN a = 0 AND b = 0 THEN 1.0 WHEN shared = 0 THEN 0.0 ELSE 2.0::DOUBLE * shared / (a + b) END), 0.0), 9) AS f1 FROM predictions LEFT JOIN f USING (pred_id) GROUP BY pred_id""",
    ),
    "faithfulness_hallucination": (
        _evaluated("faithfulness", "hallucination"),
        rf"""WITH {PREDICTIONS}, w AS (SELECT pred_id, prediction, contexts, list_distinct({_WORDS.format('lower(prediction)')}) AS p, list_distinct({_WORDS.format("lower(coalesce(array_to_string(contexts, ' '), ''))")}) AS c FROM predictions),
        s AS (SELECT *, list_filter(p, lambda x: NOT list_contains({list(tx.FAITHFULNESS_STOP)}, x)) AS f, list_filter(p, lambda x: NOT list_contains({list(tx.HALLUCINATION_STOP)}, x)) AS h FROM w)
        SELECT pred_id, round(CASE WHEN len(f) = 0 THEN 0.0 ELSE len(list_intersect(f, c))::DOUBLE / len(f) END, 9) AS faithfulness,
          round(CASE WHEN trim(prediction) = '' THEN 0.0 WHEN len(contexts) = 0 THEN 1.0 WHEN len(h) > 0 THEN (len(h) - len(list_intersect(h, c)))::DOUBLE / len(h) ELSE 0.0 END, 9) AS hallucination FROM s""",
    ),
    "answer_in_context": (
        lambda s, d: _context(s, d, "answer_in_context"),
        rf"""WITH {_INDEX}, {_BM25_HITS}, hits AS ({_ranked('bm', 3)}), c AS (SELECT query_id, {_NORM.format("string_agg(text, ' ' ORDER BY rank)")} AS ctx FROM hits JOIN documents USING (doc_id) GROUP BY query_id)
        SELECT item_id AS pred_id, CASE WHEN length({_NORM.format('text')}) >= 2 AND contains(coalesce(ctx, ''), {_NORM.format('text')}) THEN 1.0 ELSE 0.0 END::DOUBLE AS answer_in_context FROM benchmark LEFT JOIN c ON query_id = item_id""",
    ),
    "context_recall": (
        lambda s, d: _context(s, d, "context_recall"),
        rf"""WITH {_INDEX}, {_BM25_HITS}, hits AS ({_ranked('bm', 3)}), c AS (SELECT query_id, {_NORM.format("string_agg(text, ' ' ORDER BY rank)")} AS ctx FROM hits JOIN documents USING (doc_id) GROUP BY query_id),
        b AS (SELECT item_id, text, ctx, list_distinct({_WORDS.format('ctx')}) AS seen FROM benchmark LEFT JOIN c ON query_id = item_id), s AS (SELECT item_id, ctx, seen, unnest(list_append(list_filter(string_split_regex(text, '[.!?]+'), lambda x: trim(x) <> ''), text)) AS sent, unnest(list_append(list_transform(list_filter(string_split_regex(text, '[.!?]+'), lambda x: trim(x) <> ''), lambda x: 0), 1)) AS whole FROM b),
        n AS (SELECT *, {_NORM.format('sent')} AS ns FROM s), f AS (SELECT *, list_distinct({_WORDS.format('ns')}) AS nw, len({_WORDS.format('ns')}) AS k FROM n), t AS (SELECT item_id, whole, k, ns <> '' AND (contains(ctx, ns) OR len(list_intersect(nw, seen))::DOUBLE / greatest(len(nw), 1) >= 0.8) AS told, ctx FROM f)
        SELECT item_id AS pred_id, round(coalesce(CASE WHEN any_value(ctx) IS NULL THEN 0.0 WHEN count(*) FILTER (whole = 0 AND k >= 3) > 0 THEN count(*) FILTER (whole = 0 AND k >= 3 AND told)::DOUBLE / count(*) FILTER (whole = 0 AND k >= 3) ELSE max(CAST(told AS INT)) FILTER (whole = 1)::DOUBLE END, 0.0), 9) AS context_recall FROM t GROUP BY item_id""",
    ),
    "hard_chunks": (
        lambda s, d: chunking.hard_chunks(documents(s, d).select(F.col("doc_id").alias("id"), "text"), 512, 50).select("id", "chunk_index", F.length("text").alias("chars"), F.md5("text").alias("digest")),
        """WITH c AS (SELECT doc_id AS id, text, unnest(range(0, greatest(0, length(text) - 51) + 1, 462)) AS beg FROM documents WHERE length(text) > 0) SELECT id, CAST(beg // 462 AS INTEGER) AS chunk_index, CAST(length(substr(text, beg + 1, 512)) AS INTEGER) AS chars, md5(substr(text, beg + 1, 512)) AS digest FROM c""",
    ),
    "chunk_fixed_stats": (
        _chunk_stats("fixed"),
        _stats(
            """c AS (SELECT doc_id AS id, 0 AS k, text, 0::BIGINT AS at_, CAST(length(text) AS BIGINT) AS n FROM documents WHERE length(text) > 0 UNION ALL
            SELECT id, k + 1, text, greatest(at_ + 1, at_ + w - 50), n FROM (SELECT *, CASE WHEN length(regexp_extract(substr(text, at_ + 1, 512), '(?s)^(.*) ', 1)) > 256 THEN length(regexp_extract(substr(text, at_ + 1, 512), '(?s)^(.*) ', 1)) ELSE 512 END AS w FROM c WHERE at_ + 512 < n) WHERE at_ + w < n),
            pieces AS (SELECT id, k, CASE WHEN at_ + 512 >= n OR length(regexp_extract(substr(text, at_ + 1, 512), '(?s)^(.*) ', 1)) <= 256 THEN substr(text, at_ + 1, 512) ELSE substr(text, at_ + 1, length(regexp_extract(substr(text, at_ + 1, 512), '(?s)^(.*) ', 1))) END AS piece FROM c)""",
        ),
    ),
    "chunk_sentence_stats": (
        _chunk_stats("sentence"),
        _stats(
            r"""s AS (SELECT doc_id AS id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\s+([A-Z])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS ss FROM documents),
            pieces AS (SELECT id, unnest(range((len(ss) + 5) // 6)) AS k, unnest(list_transform(range((len(ss) + 5) // 6), lambda k: array_to_string(ss[6 * k + 1:6 * k + 6], ' '))) AS piece FROM s)"""
        ),
    ),
    "chunk_paragraph_stats": (
        _chunk_stats("paragraph"),
        _stats(
            r"""p AS (SELECT doc_id AS id, list_filter(list_transform(string_split_regex(text, '\n\s*\n'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS ps FROM documents),
            c AS (SELECT id, 0 AS k, ps, []::VARCHAR[] AS held, []::VARCHAR[] AS made FROM p UNION ALL
              SELECT id, k + 1, ps, CASE WHEN fresh AND length(ps[k + 1]) > 512 THEN [] WHEN NOT fresh AND filled + length(ps[k + 1]) > 512 THEN list_append(CASE WHEN length(held[-1]) <= 50 THEN held[-1:] ELSE [] END, ps[k + 1]) ELSE list_append(held, ps[k + 1]) END,
                CASE WHEN fresh AND length(ps[k + 1]) > 512 THEN list_filter(list_transform(string_split(regexp_replace(ps[k + 1], '([.!?])\s+([A-Z])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '')
                  WHEN NOT fresh AND filled + length(ps[k + 1]) > 512 THEN [array_to_string(held, chr(10) || chr(10))] ELSE [] END
              FROM (SELECT *, len(held) = 0 AS fresh, coalesce(list_sum(list_transform(held, lambda x: length(x))), 0) AS filled FROM c WHERE k < len(ps))),
            pieces AS (SELECT id, k, unnest(made) AS piece FROM c UNION ALL SELECT id, k + 1, array_to_string(held, chr(10) || chr(10)) FROM c WHERE k = len(ps) AND len(held) > 0)"""
        ),
    ),
    "chunk_recursive_stats": (_chunk_stats("recursive"), None),
    "chunk_hierarchical": (_hierarchy, None),
    "corpus_dedup_filter": (
        _articles,
        """WITH t AS (SELECT lang || '_' || CAST(doc_id % 300 AS VARCHAR) AS title, text, doc_id FROM documents WHERE length(text) >= 100), f AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY title ORDER BY doc_id) = 1) SELECT 'wiki_' || CAST(row_number() OVER (ORDER BY doc_id) AS VARCHAR) AS id, title, CAST(length(text) AS INTEGER) AS chars FROM f""",
    ),
    "corpus_topk_sources_ties": (
        _top_sources,
        """WITH s AS (SELECT source AS title, CAST(sum(quality) AS BIGINT) AS score FROM documents JOIN labels USING (doc_id) GROUP BY source) SELECT title, score FROM s WHERE score >= (SELECT min(score) FROM (SELECT score FROM s ORDER BY score DESC LIMIT 5))""",
    ),
    "cache_misses": (_cache_misses, """WITH h AS (SELECT doc_id, left(sha256(text), 32) AS h FROM documents) SELECT count(*) AS misses, count(DISTINCT h) AS texts FROM h WHERE h NOT IN (SELECT h FROM h WHERE doc_id % 2 = 0)"""),
    "cache_stats": (_cache_stats, """SELECT lang, count(*) AS entries, CAST(sum(strlen(text)) AS BIGINT) AS bytes FROM (SELECT DISTINCT lang, text FROM documents) GROUP BY lang"""),
    "title_ranks": (
        lambda s, d: rounded(ranking.best(read(s, d, "documents").select("lang", "doc_id", "n_chars"), ["lang"], [F.desc("n_chars"), F.asc("doc_id")], 3)),
        """SELECT lang, doc_id, n_chars, CAST(row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS INTEGER) AS rank FROM documents QUALIFY rank <= 3""",
    ),
    "running_words": (
        lambda s, d: read(s, d, "conversations").select("conv_id", "turn", F.sum(F.size(tx.words(F.col("text")))).over(Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, 0)).alias("words")),
        rf"""SELECT conv_id, turn, CAST(sum(len({_WORDS.format('text')})) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING) AS BIGINT) AS words FROM conversations""",
    ),
}
