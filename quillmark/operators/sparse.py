"""Sparse indexes as plain tables, and search in them.

Only the postings of terms that some query has are counted for BM25: the query terms are joined to the exploded tokens
before anything is shuffled, if Spark finds them small enough to broadcast, and document lengths come from the arrays.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.functions.text import let, tokens
from quillmark.operators.ranking import best, top
from quillmark.session import spread

#: BM25 in its Lucene form.
K1, B = 1.5, 0.75
MOST_FEATURES = 50_000
#: Parts of postings to a part of the scan, of 128 MB at most.
PARTS = 8
#: Terms that are broadcast at most; 200,000 of some ten bytes.
MOST_SENT = 200_000
#: Terms that are looked for in the row at most.
MOST_PICKED = 20_000


def _sent(terms: DataFrame) -> tuple[DataFrame, bool]:
    """terms, to be broadcast if they are few enough, and whether they are."""
    few = terms.limit(MOST_SENT + 1).count() <= MOST_SENT
    return F.broadcast(terms) if few else terms, few


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, term, qtf) of queries (query_id, text)."""
    return queries.select("query_id", F.explode(tokens(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))


@dataclass
class Postings:
    """postings: (doc_id, term, tf, dl); terms: (term, df); size: one row (n, avgdl)."""

    postings: DataFrame
    terms: DataFrame
    size: DataFrame
    #: What the three are read off, (doc_id, term, tf, dl, whole), if they are not stored.
    counted: DataFrame | None = None


def _counts(words: Column) -> Column:
    """[(term, tf)] of an array of words: lengths of the runs of the sorted array, in the row."""

    def runs(ordered: Column) -> Column:
        begins = F.filter(F.sequence(F.lit(0), F.size(ordered) - 1), lambda i: (i == 0) | (F.get(ordered, i) != F.get(ordered, i - 1)))
        count = lambda at: F.transform(at, lambda i, k: F.struct(F.get(ordered, i).alias("term"), (F.coalesce(F.get(at, k + 1), F.size(ordered)) - i).cast("long").alias("tf")))
        return let(begins, count)

    return F.when(F.size(words) > 0, let(F.sort_array(words), runs)).otherwise(F.array().cast("array<struct<term:string,tf:bigint>>"))


def _picked(only: DataFrame) -> Column:
    """Of the column tokens those in ``only`` (term), so that the rest is not sorted and counted in vain; all of them if ``only`` has over MOST_PICKED terms. The join with ``only`` decides."""
    terms = [r["term"] for r in only.select("term").distinct().limit(MOST_PICKED + 1).collect()]
    if not terms or len(terms) > MOST_PICKED:
        return F.col("tokens")
    terms = [t for t in terms if t and "'" not in t and "\\" not in t]  # tokens have neither
    return F.expr(f"filter(tokens, t -> t in ('', {', '.join(f"'{t}'" for t in terms)}))") if terms else F.array().cast("array<string>")


def postings(docs: DataFrame, only: DataFrame | None = None) -> Postings:
    """Index of documents (doc_id, text); of the terms in ``only`` (term), if it is given. Documents without tokens count in n and avgdl. Rows that share an id
    count as a document each in n and avgdl, and as one in the postings, of the lengths of those that have the term.

    A document's terms are counted in its row. Its postings are dealt out by document, once, so that what is summed for each document or each query and document needs no further exchange. Each
    document also gives one row of no term, which carries its length, so that all three parts are read off that one exchange; each part uses all of its columns for that reason."""
    parts = _parts(docs)
    tokened = spread(docs.select("doc_id", "text")).select("doc_id", tokens(F.coalesce("text", F.lit(""))).alias("tokens"))
    whole = F.array(F.struct(F.lit("").alias("term"), F.lit(1).cast("long").alias("tf")))
    # No element is ever missing, and of an outer explode Spark infers no filter that would make the tokens once more in the scan.
    kept = F.col("tokens") if only is None else _picked(only)
    counted = tokened.select("doc_id", F.size("tokens").alias("dl"), F.explode_outer(F.concat(whole, _counts(kept))).alias("c")).select("doc_id", "dl", "c.term", "c.tf")
    if only is not None:
        wanted = only.select("term").unionByName(docs.sparkSession.range(1).select(F.lit("").alias("term"))).distinct()
        counted = counted.join(_sent(wanted)[0], "term", "left_semi")
    # Dealt by document, so this needs no exchange of its own; what each part takes of it is told above it, not pushed below into exchanges that differ.
    counted = counted.repartition(parts, "doc_id").groupBy("doc_id", "term").agg(F.sum("tf").alias("tf"), F.sum("dl").alias("dl"), F.max(F.col("term") == "").alias("whole"))
    return parts_of(counted)


def parts_of(rows: DataFrame) -> Postings:
    """The index whose counted rows are given."""
    of_term = ~F.col("whole") & (F.col("tf") > 0) & (F.col("dl") > 0)
    size = rows.filter(F.col("whole") & (F.col("tf") > 0) & (F.col("dl") >= 0)).agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("n"), (F.sum("dl") / F.sum("tf")).alias("avgdl"))
    own = rows.filter(of_term).select("doc_id", "term", "tf", "dl")
    return Postings(own, own.groupBy("term").agg(F.count_if((F.col("tf") > 0) & (F.col("dl") > 0)).alias("df")), size, rows)


def _parts(docs: DataFrame) -> int:
    """Parts follow from the size of the texts: by the size of what is counted Spark would join them to few, whose tasks grow with the corpus."""
    cores = docs.sparkSession.sparkContext.defaultParallelism
    return max(cores, PARTS * docs.rdd.getNumPartitions()) if not docs.isStreaming else cores


def _counted(docs: DataFrame) -> DataFrame:
    """(doc_id, term, tf) of all terms, dealt by document: a text is a fraction of its postings, so texts are what is exchanged."""
    dealt = docs.select("doc_id", "text").repartition(_parts(docs), "doc_id")
    # Of an outer explode Spark infers no filter that would make the tokens once more in the scan; that no term is null is said here, so that all uses read off one exchange.
    return dealt.select("doc_id", F.explode_outer(tokens(F.col("text"))).alias("term")).filter("term is not null").groupBy("doc_id", "term").agg(F.count("*").alias("tf"))


def bm25(docs: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, doc_id, score, rank): the k best documents of each query, ranks from 0, positive scores only. A term that a
    query repeats counts as often."""
    asked, sent = _sent(query_terms(queries))
    index = postings(docs, asked)
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = F.col("tf") / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    terms = F.broadcast(index.terms) if sent else index.terms  # no more than the queries have
    weighed = index.postings.join(terms, "term").crossJoin(F.broadcast(index.size)).select("doc_id", "term", (idf * weight).alias("w"))  # size is one row
    hits = weighed.join(asked, "term").groupBy("query_id", "doc_id").agg(F.sum(F.col("qtf") * F.col("w")).alias("score"))
    return top(hits.filter("score > 0"), k)


def stop_words_of(language: str = "english") -> tuple[str, ...]:
    """The stop words that Spark knows of a language, as tokens: those of two characters at least, and such parts of those with an apostrophe. Needs a session."""
    from pyspark.ml.feature import StopWordsRemover

    found = {part for word in StopWordsRemover.loadDefaultStopWords(language) for part in word.lower().split("'") if len(part) > 1}
    return tuple(sorted(found))


def tfidf(docs: DataFrame, queries: DataFrame, k: int = 10, features: int = MOST_FEATURES, stop_words: tuple[str, ...] | str = ()) -> DataFrame:
    """(query_id, doc_id, score, rank): cosine of tf-idf vectors over the ``features`` most frequent terms (ties by
    code point) that are no stop words, smoothed idf; positive scores only. stop_words: tokens, or the name of a language.

    Texts are dealt out by document, once, and their terms counted behind that, so lengths and what a query has in a document need no further exchange. The vocabulary has ``features`` rows at most and is
    broadcast up to MOST_FEATURES, as the queries' terms are up to MOST_SENT; a document's length and those of its terms that a query has come from one pass over its terms."""
    counted = _counted(docs)
    stop_words = stop_words_of(stop_words) if isinstance(stop_words, str) else stop_words
    if stop_words:
        counted = counted.filter(~F.col("term").isin(*stop_words))
    size = docs.agg(F.count("*").alias("n"))
    vocabulary = counted.groupBy("term").agg(F.sum("tf").alias("total"), F.count("*").alias("df")).orderBy(F.desc("total"), "term").limit(features)
    idf = F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1
    weighted = vocabulary.crossJoin(F.broadcast(size)).select("term", idf.alias("idf"))  # size is one row
    weighted = F.broadcast(weighted) if features <= MOST_FEATURES else weighted
    terms = query_terms(queries)
    few = _sent(terms)[1]
    sent = F.broadcast if few else lambda rows: rows
    asked = terms.join(weighted, "term").select("query_id", "term", (F.col("qtf") * F.col("idf")).alias("q"))
    own = asked.groupBy("query_id").agg(F.sqrt(F.sum(F.col("q") * F.col("q"))).alias("own"))
    asked = asked.join(sent(own), "query_id").select("query_id", "term", (F.col("q") / F.col("own")).alias("q"))
    wanted = terms.select("term", F.lit(True).alias("wanted")).distinct()
    raw = counted.join(weighted, "term").join(sent(wanted), "term", "left").select("doc_id", "term", (F.col("tf") * F.col("idf")).alias("w"), "wanted")
    lengths = raw.groupBy("doc_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("length"), F.collect_list(F.when(F.col("wanted"), F.struct("term", "w"))).alias("has"))
    # Rows without an id count, but are no hits; said so that no filter reaches one of the two uses of the exchange.
    has = lengths.select("doc_id", "length", F.explode(F.when(F.col("doc_id").isNotNull(), F.col("has"))).alias("h")).select("doc_id", "h.term", (F.col("h.w") / F.col("length")).alias("w"))
    dots = has.join(sent(asked), "term").groupBy("query_id", "doc_id").agg(F.sum(F.col("w") * F.col("q")).alias("score"))
    return top(dots.filter("score > 0"), k)


def matched_terms(docs: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, term, df, rank): the rarest terms of each query that the corpus has."""
    asked = query_terms(queries)
    return best(asked.join(postings(docs, asked).terms, "term"), ["query_id"], [F.asc("df"), F.asc("term")], k).select("query_id", "term", "df", "rank")
