"""Quality rules on DataFrame functions alone: figures of a text, and lines that many documents of a host share.

A document's source is its host. Lines are normalised (A-Z lower-cased, digits to 0, white space to one blank, trimmed) and
hashed; of each host's hashes the distinct documents are counted, copies of one text as one document, so that a page that was
crawled often does not make its own lines boilerplate. Lines in more documents than the limits allow go, and a document that keeps
less than ``LEAST_KEPT`` of its words is depleted and rejected, as is one that fails the figures of its own text.

Counts are of distinct (host, line, text) first and then of (host, line), each reduced on every machine before it is shuffled, so a line
that a third of all documents hold is a handful of partial counts. Only lines above the limits are joined back, each with its place.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.functions.text import let
from quillmark.llm.common import Scratch, did, others, text_hash

#: A line goes if it stands in more documents of its host than both limits: a number, and a share of the host's documents.
LINE_DOCS, LINE_SHARE = 10, 0.01
#: The share of words that must stay.
LEAST_KEPT = 0.5
#: Fewest words; largest share, in percent, of words in repeated windows; words of a window.
LEAST_WORDS, MOST_REPEATED, WINDOW = 10, 20, 5
BLANKS, SYMBOLS = " \t\n\x0b\x0c\r", "#*$%&|<>"
_FROM = string.ascii_uppercase + string.digits + BLANKS.replace("\n", "").replace(" ", "")
_TO = string.ascii_lowercase + "0" * 10 + " " * 4


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def repeated_words(words: Column, width: int = WINDOW) -> Column:
    """How many words stand in windows of ``width`` words that a text holds twice or more, the first included.

    Windows are compared by 64-bit hashes. They are sorted with their places, so equal ones are neighbours, which takes n log n steps
    however often a window repeats; texts whose hashes are all distinct are not sorted."""

    def covered(at: Column) -> Column:
        steps = F.transform(at, lambda p, k: F.least(F.coalesce(F.get(at, k + 1) - p, F.lit(width)), F.lit(width)))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

    def repeated(order: Column) -> Column:
        same = lambda s, k: (s["h"] == F.get(order, k - 1)["h"]) | (s["h"] == F.get(order, k + 1)["h"])
        return let(F.sort_array(F.transform(F.filter(order, same), lambda s: s["i"])), covered)

    def told(hashes: Column) -> Column:
        order = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), let(order, repeated)).otherwise(0)

    hashed = lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - width), lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(width))))
    return let(words, lambda w: F.when(F.size(w) > width, let(hashed(w), told)).otherwise(0)).cast("long")


def figures(docs: DataFrame) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed of each text; a null text has none of them and fails."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    full = F.filter(F.split(text, "\n"), lambda x: F.translate(x, BLANKS, "") != "")
    own = docs.select("*", words_of(text).alias("own_words"), full.alias("own_lines"))
    own = own.select(
        *docs.columns,
        F.size("own_words").cast("long").alias("n_words"),
        F.length(F.translate(text, BLANKS, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("own_lines") - F.size(F.array_distinct("own_lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("own_words")).alias("n_repeat_words"),
    )
    return own.withColumn("base_failed", (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words")))


def _lines(rows: DataFrame) -> DataFrame:
    """(did, th, host, at, h, h2, n): each line with a word, its place, 96 bits of its normalised form, and its words."""
    bare = F.regexp_replace(F.translate("text", _FROM, _TO), " {2,}", " ")
    lines = rows.select("did", "th", "host", F.posexplode(F.split(bare, "\n")).alias("at", "line")).withColumn("line", F.trim("line")).filter("line <> ''")
    return lines.select("did", "th", "host", "at", F.xxhash64("line").alias("h"), F.hash("line").alias("h2"), F.size(F.split("line", " ")).cast("long").alias("n"))


def frequent_lines(lines: DataFrame, line_docs: int = LINE_DOCS, line_share: float = LINE_SHARE) -> DataFrame:
    """(host, h, h2, docs) of the lines above the limits."""
    counts = lines.groupBy("host", "h", "h2").agg(F.countDistinct("th").alias("docs")).filter(F.col("docs") > line_docs)
    hosts = lines.groupBy("host").agg(F.countDistinct("th").alias("all_docs"))
    return counts.join(hosts, "host").filter(F.col("docs") > line_share * F.col("all_docs")).select("host", "h", "h2", "docs")


def judge(docs: DataFrame, line_docs: int = LINE_DOCS, line_share: float = LINE_SHARE, least_kept: float = LEAST_KEPT) -> DataFrame:
    """(row, text, the figures, n_removed, kept): the other columns of each row of docs as a struct, its text without frequent lines, the words
    that went with them, and the verdict.

    docs: doc_id, text, source and others. A null text stays null, has no lines and is rejected, as is an empty one. Without a source a
    document belongs to the host ''. Ids may be null or repeated: rows are told apart by id, text and source, and rows alike in all three
    get equal results. Only lines with a word count as such; of equal lines in one text each goes. An empty table gives an empty result."""
    scratch = Scratch(docs.sparkSession, "rules")
    rows = docs.select(others(docs).alias("row"), did().alias("did"), text_hash().alias("th"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("host"), F.col("text").cast("string").alias("text"))
    lines = _lines(rows)
    frequent = scratch.put(frequent_lines(lines, line_docs, line_share), "frequent")
    gone = lines.join(frequent, ["host", "h", "h2"]).select("did", "th", "host", "at", "n").distinct()
    gone = scratch.put(gone.groupBy("did", "th", "host").agg(F.sum("n").alias("n_removed"), F.collect_list("at").alias("gone")), "gone")
    done = figures(rows).join(gone.hint("merge"), ["did", "th", "host"], "left").withColumn("n_removed", F.coalesce("n_removed", F.lit(0)))
    lines_left = let(F.split("text", "\n"), lambda x: F.transform(F.array_except(F.sequence(F.lit(0), F.size(x) - 1), "gone"), lambda i: F.get(x, i)))
    text = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(lines_left, "\n"))
    kept = ~F.col("base_failed") & (F.col("n_words") - F.col("n_removed") >= least_kept * F.col("n_words"))
    return done.select("row", text.alias("text"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_removed", kept.alias("kept"))


def op12(docs: DataFrame) -> DataFrame:
    """doc_id, the figures, base_failed and kept of each row; edges as in ``judge``."""
    return judge(docs.select("doc_id", "text", "source")).select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


OP12_SQL = rf"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
  SELECT doc_id, unnest(range(1, len(w) - {WINDOW - 2})) AS i, unnest(list_transform(range(1, len(w) - {WINDOW - 2}), lambda i: array_to_string(w[i:i + {WINDOW - 1}], ' '))) AS seq FROM d WHERE len(w) > {WINDOW}
), twice AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, seq) AS n FROM windows
), repeated AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest(range({WINDOW})) AS k) WHERE n > 1 GROUP BY doc_id
), lines AS (
  SELECT doc_id, host, md5(text) AS th, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS at FROM d
), full_lines AS (
  SELECT * FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
), own AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM full_lines GROUP BY doc_id
), normal AS (
  SELECT doc_id, host, th, array_to_string(regexp_extract_all(translate(line, '{string.ascii_uppercase}0123456789', '{string.ascii_lowercase}0000000000'), '[^\x20\x09-\x0D]+'), ' ') AS line FROM full_lines
), counts AS (
  SELECT host, line, count(DISTINCT th) AS docs FROM normal GROUP BY host, line
), frequent AS (
  SELECT host, line FROM counts JOIN (SELECT host, count(DISTINCT th) AS all_docs FROM normal GROUP BY host) USING (host) WHERE docs > {LINE_DOCS} AND docs > {LINE_SHARE} * all_docs
), removed AS (
  SELECT doc_id, sum(len(string_split(line, ' '))) AS n FROM normal SEMI JOIN frequent USING (host, line) GROUP BY doc_id
), figured AS (
  SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(translate(text, '{SYMBOLS}', '')) AS BIGINT) AS n_symbols, coalesce(own.n_dup_lines, 0) AS n_dup_lines, CAST(coalesce(repeated.n, 0) AS BIGINT) AS n_repeat_words, coalesce(removed.n, 0) AS n_removed
  FROM d LEFT JOIN own USING (doc_id) LEFT JOIN repeated USING (doc_id) LEFT JOIN removed USING (doc_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed,
  NOT (n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words) AND n_words - n_removed >= {LEAST_KEPT} * n_words AS kept
FROM figured
"""
