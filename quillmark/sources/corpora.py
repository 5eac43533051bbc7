"""Readers of corpora and question sets into one schema each: documents (id, title, text), questions (id, question, answers, context)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmark.functions.text import title_key
from quillmark.operators.ranking import with_ties

LEAST_CHARS = 100


def articles(rows: DataFrame, order: str, allowed: DataFrame | None = None, least: int = LEAST_CHARS, most: int | None = None) -> DataFrame:
    """(id, title, text) of (title, text, order): texts of ``least`` characters, the first of each title, of allowed titles (title) if given; ids ``wiki_1`` on, in
    source order. Numbering needs one order over what is kept: ``most`` bounds it, and without it ids come from a sort over all tasks."""
    kept = rows.filter(F.length("text") >= least).withColumn("key", title_key(F.col("title")))
    if allowed is not None:
        kept = kept.join(allowed.select(title_key(F.col("title")).alias("key")).distinct(), "key", "left_semi")
    first = kept.withColumn("rn", F.row_number().over(Window.partitionBy("title").orderBy(order))).filter("rn = 1")
    first = first.orderBy(order).limit(most) if most else first
    return numbered(first, order).select(F.concat(F.lit("wiki_"), F.col("number").cast("string")).alias("id"), "title", "text")


def numbered(rows: DataFrame, order: str, parts: int = 64) -> DataFrame:
    """number: 1 on, by order. Rows are dealt by hash of nothing but ranges: each range counts its own, and a sum over at most ``parts`` counts shifts it."""
    spans = rows.agg(F.min(order).alias("low"), F.max(order).alias("high"))
    ranged = rows.crossJoin(F.broadcast(spans)).withColumn("range", F.floor((F.col(order) - F.col("low")) * F.lit(float(parts)) / (F.col("high") - F.col("low") + 1)))  # spans is one row
    counts = ranged.groupBy("range").agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("range", "before")
    own = F.row_number().over(Window.partitionBy("range").orderBy(order))
    return ranged.withColumn("own", own).join(before, "range").withColumn("number", F.col("own") + F.col("before")).drop("range", "low", "high", "own", "before")


def rank_scores(spark: SparkSession, path: str, titles: tuple[str, ...] = ("page_name", "title", "name"), scores: tuple[str, ...] = ("wikirank_quality", "score", "rank")) -> DataFrame:
    """(title, score) of a CSV file with a header, under the first of the column names that it has; titles are normalised."""
    rows = spark.read.option("header", True).csv(path)
    pick = lambda names: next((n for n in names if n in rows.columns), None)
    title, score = pick(titles), pick(scores)
    if not title or not score:
        raise ValueError(f"no title or score among {rows.columns}")
    return rows.select(title_key(F.col(title)).alias("title"), F.col(score).try_cast("double").alias("score")).filter("title is not null and score is not null")


def top_titles(scores: DataFrame, k: int) -> DataFrame:
    """(title, score) of the k best, and those equal to the k-th."""
    return with_ties(scores, "score", k)


def _questions(rows: DataFrame, question: Column, answers: Column, context: Column | None = None) -> DataFrame:
    clean = F.filter(answers, lambda a: a.isNotNull() & (F.trim(a) != ""))
    return rows.select(F.col("id").cast("string").alias("id"), question.alias("question"), clean.alias("answers"), (context if context is not None else F.lit(None).cast("string")).alias("context"))


def natural_questions(rows: DataFrame) -> DataFrame:
    """Of (id, question, answer array)."""
    return _questions(rows, F.col("question"), F.col("answer"))


def trivia(rows: DataFrame) -> DataFrame:
    """Of (id, question, answer struct(value, aliases)): the aliases and the value, each once."""
    return _questions(rows, F.col("question"), F.array_distinct(F.concat(F.coalesce("answer.aliases", F.array().cast("array<string>")), F.array("answer.value"))))


def hotpot(rows: DataFrame) -> DataFrame:
    """Of (id, question, answer, context struct(title array, sentences array of arrays)): paragraphs ``title: sentences``, separated by blank lines."""
    paragraphs = F.transform(F.arrays_zip("context.title", "context.sentences"), lambda p: F.concat(p["title"], F.lit(": "), F.array_join(p["sentences"], "")))
    return _questions(rows, F.col("question"), F.array("answer"), F.array_join(paragraphs, "\n\n"))


def pubmed(rows: DataFrame, order: str = "id", split: str = "train") -> DataFrame:
    """Of (id, question, long_answer, final_decision, contexts): the long answer or else the decision; rows without either go. Splits by position: 80, 10, 10 percent."""
    low, high = {"train": (0.0, 0.8), "validation": (0.8, 0.9), "test": (0.9, 1.0)}[split]
    counted = numbered(rows, order).crossJoin(F.broadcast(rows.agg(F.count("*").alias("total"))))  # one row
    own = counted.filter((F.col("number") > F.floor(F.col("total") * low)) & (F.col("number") <= F.when(F.lit(high) == 1.0, F.col("total")).otherwise(F.floor(F.col("total") * high))))
    answer = F.coalesce(F.nullif("long_answer", F.lit("")), F.nullif("final_decision", F.lit("")))
    return _questions(own.filter(answer.isNotNull()), F.col("question"), F.array(answer), F.array_join("contexts", "\n\n"))


def tech(rows: DataFrame) -> DataFrame:
    """Of (id, question, answer, answerable, context, document): answerable ones, the document in place of a missing context."""
    ok = rows.filter(F.coalesce(F.upper(F.col("answerable").cast("string")).isin("Y", "YES", "TRUE", "1"), F.lit(False)))
    return _questions(ok, F.col("question"), F.array("answer"), F.coalesce(F.nullif("context", F.lit("")), "document"))


def with_answers(questions: DataFrame) -> DataFrame:
    """Questions with an answer that is not blank."""
    return questions.filter(F.exists("answers", lambda a: F.trim(a) != ""))


def subset(questions: DataFrame, n: int, seed: int = 42) -> DataFrame:
    from quillmark.plans.grid import sample

    return sample(questions, n, "id", seed)


QUESTION_SCHEMA = "id string, question string, answers array<string>, context string"


def write_questions(questions: DataFrame, path: str) -> None:
    questions.write.mode("overwrite").json(path)


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(QUESTION_SCHEMA).json(path)
