"""Divergence audit of sources by joint count histograms.

Within a language, each pair of sources is compared by the smoothed frequencies of the terms that the language keeps.
A pair's terms are not compared one by one: how often each combination (count here, count there) occurs is tallied, and the
difference is evaluated once a combination and taken times its tally. Only terms that both sources have are met. Combinations with a zero are implied: a source's
own histogram of counts gives all its terms, the tally takes away those that the other has, and the terms that neither has are what is left of all.

Tasks count the terms of their texts before anything is shuffled, by (language, term), which no source makes hot. A term's counts
are met in lists of ``TILE`` sources at most, list by list, and a task tallies what it has met before it hands it on. The result has a row for each
pair of sources of a language, so that many are joined, and no more.
"""

from __future__ import annotations

import string
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark.llm.common import Scratch

LEAST_DOCS, SMOOTH, SCALE, MOST_TERMS = 30, 5, 1_000_000_000, 50
#: Sources of a list; combinations that a task tallies at once; bytes of text that a task counts at once.
TILE, CELLS, BYTES = 64, 1 << 20, 1 << 24
_LETTERS = string.ascii_letters.encode()
#: A-Z to a-z, other ASCII but letters to a blank; bytes of longer characters stay.
_TABLE = bytes(ord(chr(b).lower()) if b < 128 and b in _LETTERS else b if b >= 128 else 32 for b in range(256))


def terms_of(text: bytes) -> list[bytes]:
    """Runs of ASCII letters and of characters beyond ASCII, A-Z lower-cased."""
    return text.translate(_TABLE).split()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, docs) of the texts of a task, a stretch of texts at a time."""
    counts, docs, seen = defaultdict(Counter), defaultdict(Counter), 0

    def told() -> Iterator[pa.RecordBatch]:
        for group, own in counts.items():
            have, terms = docs[group], list(own)
            columns = [pa.array([g] * len(terms), pa.string()) for g in group]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(terms, pa.binary()).cast(pa.string()), pa.array(list(own.values()), pa.int64()), pa.array([have[t] for t in terms], pa.int64())], names=["lang", "source", "term", "n", "docs"]
            )

    for batch in batches:
        for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()), strict=True):
            terms = terms_of(text.as_py())
            counts[lang, source].update(terms)
            docs[lang, source].update(set(terms))
            seen += 6 * len(terms)
            if seen > BYTES:
                yield from told()
                counts, docs, seen = defaultdict(Counter), defaultdict(Counter), 0
    yield from told()


def kept_counts(docs: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(lang, source, term, n, total, head): counts of each language's kept terms, their counts in the whole language, and whether the row is its term's first."""
    counts = docs.mapInArrow(_count, "lang string, source string, term string, n long, docs long")
    counts = counts.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    term = Window.partitionBy("lang", "term")
    told = counts.select("lang", "source", "term", "n", F.sum("n").over(term).alias("total"), F.sum("docs").over(term).alias("docs"), (F.min("source").over(term) == F.col("source")).alias("head"))
    return told.filter(F.col("docs") >= least_docs).select("lang", "source", "term", "n", "total", "head")


def _frequency(n: Column, total: Column, v: Column) -> Column:
    """1 + floor(SCALE * (n + SMOOTH) / (total + SMOOTH * v)), in whole numbers."""
    above = ((n + SMOOTH).cast("decimal(19,0)") * F.lit(SCALE).cast("decimal(10,0)")).cast("decimal(38,0)")
    below = F.greatest(total + SMOOTH * v, F.lit(1)).cast("decimal(38,0)")
    return F.lit(1).cast("long") + F.call_function("div", above, below)


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From two lists of (source number, count) of a term each: tallies of (lang, a, b, x, y) for a < b, and what they take from the combinations with a zero."""
    met, size = [], 0

    def told() -> pa.RecordBatch:
        columns = {k: np.concatenate([m[k] for m in met]) for k in ("a", "b", "x", "y")}
        langs = pa.array([m["lang"] for m in met]).dictionary_encode()
        code = np.repeat(langs.indices.to_numpy(), [len(m["a"]) for m in met])
        table = pa.table(columns | {"lang": code, "m": np.ones(len(code), np.int64)})
        joint = table.group_by(["lang", "a", "b", "x", "y"], use_threads=False).aggregate([("m", "sum")])
        less, zero = pa.compute.negate(joint["m_sum"]), pa.array(np.zeros(len(joint), np.int64))
        parts = [joint, joint.set_column(4, "y", zero).set_column(5, "m_sum", less), joint.set_column(3, "x", zero).set_column(5, "m_sum", less), joint.set_column(3, "x", zero).set_column(4, "y", zero)]
        done = pa.concat_tables(parts).group_by(["lang", "a", "b", "x", "y"], use_threads=False).aggregate([("m_sum", "sum")]).combine_chunks()
        names = langs.dictionary.take(done["lang"].combine_chunks())
        return pa.RecordBatch.from_arrays([names, *(done[k].combine_chunks() for k in ("a", "b", "x", "y", "m_sum_sum"))], names=["lang", "a", "b", "x", "y", "m"])

    for batch in batches:
        for lang, one, other in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
            left, right = (np.stack([v.values.field(k).to_numpy() for k in (0, 1)]) for v in (one, other))
            i, j = np.nonzero(left[0][:, None] < right[0][None, :])
            if len(i):
                met.append({"lang": lang, "a": left[0][i], "b": right[0][j], "x": left[1][i], "y": right[1][j]})
                size += len(i)
            if size > CELLS:
                yield told()
                met, size = [], 0
    if met:
        yield told()


def pair_divergence(kept: DataFrame, groups: DataFrame, scratch: Scratch) -> DataFrame:
    """(lang, a, b, value) of each two sources a < b of a language, by number. groups: (lang, at, n, own, v): number, count and terms of a source, terms of its language."""
    lists = kept.join(groups.select("lang", "source", "at"), ["lang", "source"]).repartition("lang", "term")
    lists = lists.groupBy("lang", "term", (F.col("at") / TILE).cast("long").alias("tile")).agg(F.sort_array(F.collect_list(F.struct("at", "n"))).alias("list"))
    other = lists.select("lang", "term", F.col("tile").alias("tile2"), F.col("list").alias("list2"))
    met = lists.join(other, ["lang", "term"]).filter("tile <= tile2").select("lang", "list", "list2")
    joint = met.mapInArrow(_tally, "lang string, a long, b long, x long, y long, m long")
    zero = F.lit(0).cast("long")
    one, two = groups.select("lang", F.col("at").alias("a"), F.col("own").alias("own_a"), "v"), groups.select("lang", F.col("at").alias("b"), F.col("own").alias("own_b"))
    neither = one.join(two, "lang").filter("a < b").select("lang", "a", "b", zero.alias("x"), zero.alias("y"), (F.col("v") - F.col("own_a") - F.col("own_b")).alias("m"))
    hist = kept.groupBy("lang", "source", "n").agg(F.count("*").alias("m")).join(groups.select("lang", "source", "at"), ["lang", "source"]).select("lang", "at", "n", "m")
    alone = hist.join(groups.select("lang", F.col("at").alias("to")), "lang").filter("at <> to")
    first = F.col("at") < F.col("to")
    alone = alone.select("lang", F.least("at", "to").alias("a"), F.greatest("at", "to").alias("b"), F.when(first, F.col("n")).otherwise(zero).alias("x"), F.when(first, zero).otherwise(F.col("n")).alias("y"), "m")
    cells = joint.unionByName(neither).unionByName(alone).groupBy("lang", "a", "b", "x", "y").agg(F.sum("m").alias("m"))
    sides = [groups.select("lang", F.col("at").alias(k), F.col("n").alias(f"n_{k}"), *(["v"] if k == "a" else [])) for k in ("a", "b")]
    cells = cells.join(sides[0], ["lang", "a"]).join(sides[1], ["lang", "b"])
    f = F.abs(_frequency(F.col("x"), F.col("n_a"), F.col("v")) - _frequency(F.col("y"), F.col("n_b"), F.col("v")))
    return scratch.put(cells.groupBy("lang", "a", "b").agg(F.sum(F.col("m") * f).alias("value")), "pairs")


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, most_terms: int = MOST_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank): of each source the other sources of its language by divergence, and the terms that it has more often than its language.

    Null text, lang and source are ''. Each row is a document, rows alike included. A source without kept terms is compared, too; in a language that keeps
    none every value is 0. Equal values rank by the item's bytes. A source alone in its language has no pairs. An empty table gives an empty result."""
    scratch = Scratch(docs.sparkSession, "divergence")
    own = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    kept = scratch.put(kept_counts(own, least_docs), "kept")
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("n"), F.count("*").alias("own"))
    langs = kept.groupBy("lang").agg(F.sum("n").alias("all_n"), F.sum(F.col("head").cast("long")).alias("v"))
    groups = own.select("lang", "source").distinct().join(sums, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["n", "own", "all_n", "v"])
    number = F.row_number().over(Window.partitionBy("lang").orderBy("source")).cast("long") - 1
    groups = scratch.put(groups.withColumn("at", number), "groups")

    pairs = pair_divergence(kept, groups, scratch)
    both = pairs.select("lang", F.explode(F.array(F.struct(F.col("a").alias("at"), F.col("b").alias("to")), F.struct(F.col("b").alias("at"), F.col("a").alias("to")))).alias("p"), "value").select("lang", "p.*", "value")
    names = groups.select("lang", "at", "source")
    both = both.join(names, ["lang", "at"]).join(names.select("lang", F.col("at").alias("to"), F.col("source").alias("item")), ["lang", "to"])

    more = kept.join(groups.select("lang", "source", F.col("n").alias("own_n"), "all_n", "v"), ["lang", "source"])
    value = _frequency(F.col("n"), F.col("own_n"), F.col("v")) - _frequency(F.col("total"), F.col("all_n"), F.col("v"))
    more = more.select("lang", "source", F.col("term").alias("item"), value.alias("value")).filter("value > 0")

    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    shape = ["lang", "source", "part", "item", "value", "rank"]
    pair = both.withColumn("part", F.lit("pair")).withColumn("rank", rank).select(*shape)
    term = more.withColumn("part", F.lit("term")).withColumn("rank", rank).filter(F.col("rank") <= most_terms).select(*shape)
    return pair.unionByName(term)


def op11(docs: DataFrame) -> DataFrame:
    """lang, source, part, item, value and rank; edges as in ``audit``."""
    return audit(docs.select("lang", "source", "text"))


OP11_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS text FROM documents
), w AS (
  SELECT k, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d
), kept AS (
  SELECT lang, term, count(*) AS total FROM w GROUP BY lang, term HAVING count(DISTINCT k) >= {LEAST_DOCS}
), c AS (
  SELECT lang, source, term, count(*) AS n, any_value(total) AS total FROM w JOIN kept USING (lang, term) GROUP BY lang, source, term
), langs AS (
  SELECT lang, CAST(sum(total) AS HUGEINT) AS all_n, count(*) AS v FROM kept GROUP BY lang
), g AS (
  SELECT lang, source, CAST(coalesce(s.n, 0) AS HUGEINT) AS n, coalesce(all_n, 0) AS all_n, coalesce(v, 0) AS v
  FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN (SELECT lang, source, sum(n) AS n FROM c GROUP BY ALL) s USING (lang, source) LEFT JOIN langs USING (lang)
), p AS (
  SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS count, 1 + ({SCALE}::HUGEINT * (coalesce(c.n, 0) + {SMOOTH})) // (g.n + {SMOOTH} * v) AS p, 1 + ({SCALE}::HUGEINT * (kept.total + {SMOOTH})) // (all_n + {SMOOTH} * v) AS q
  FROM g JOIN kept USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term
), rows AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(f.value, 0) AS BIGINT) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT x.lang, x.source, y.source AS other, sum(abs(x.p - y.p)) AS value FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) f ON f.lang = a.lang AND f.source = a.source AND f.other = b.source
  UNION ALL SELECT lang, source, 'term', term, CAST(p - q AS BIGINT) FROM p WHERE count > 0 AND p > q
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS INTEGER) AS rank FROM rows
)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= {MOST_TERMS}
"""
