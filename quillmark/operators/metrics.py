"""Scores of predictions against references and context.

Each metric is a Column over one row; references are an array. Multi-reference metrics take the best over the array
inside the row, so nothing is exploded and nothing shuffled; explode and aggregate are there as operators of their own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.functions.text import FAITHFULNESS_STOP, HALLUCINATION_STOP, exact_match, let, normalize_context, overlap, sentences, token_f1, words

ERROR_PREFIX = "[ERROR:"
#: Metric name to a function of the columns prediction, references, contexts.
REGISTRY: dict[str, Callable[[Column, Column, Column], Column]] = {}


def metric(name: str) -> Callable:
    """Registers a metric: a function of (prediction, references, contexts) that gives a double."""

    def register(f: Callable[[Column, Column, Column], Column]) -> Callable[[Column, Column, Column], Column]:
        REGISTRY[name] = f
        return f

    return register


def is_error(prediction: Column) -> Column:
    """Failed predictions; aborted ones are not."""
    return F.coalesce(F.startswith(prediction, F.lit(ERROR_PREFIX)), F.lit(False))


def best_of(references: Column, score: Callable[[Column], Column]) -> Column:
    """The largest score over the references; 0 if there is none."""
    return F.coalesce(F.array_max(F.transform(references, score)), F.lit(0.0))


def expand(rows: DataFrame) -> DataFrame:
    """A row for each reference, with its number; predictions without references stay, with nulls."""
    return rows.select("*", F.posexplode_outer("references").alias("ref_no", "reference"))


def aggregate(scored: DataFrame, key: str = "pred_id") -> DataFrame:
    """(key, score): the best of a prediction's scores, 0 without any."""
    score = F.when(F.col("reference").isNotNull(), F.col("score")) if "reference" in scored.columns else F.col("score")
    return scored.groupBy(key).agg(F.coalesce(F.max(score), F.lit(0.0)).alias("score"))


@metric("exact_match")
def _exact(prediction: Column, references: Column, contexts: Column) -> Column:
    return best_of(references, lambda r: exact_match(prediction, r))


@metric("f1")
def _f1(prediction: Column, references: Column, contexts: Column) -> Column:
    return best_of(references, lambda r: token_f1(prediction, r))


def joined(contexts: Column) -> Column:
    return F.coalesce(F.array_join(contexts, " "), F.lit(""))


@metric("answer_in_context")
def _answer(prediction: Column, references: Column, contexts: Column) -> Column:
    """Whether a normalised reference of two characters at least is contained in the normalised context."""


    def fits(where: Column, reference: Column) -> Column:
        return let(normalize_context(reference), lambda r: (F.length(r) >= 2) & F.contains(where, r))

    return let(normalize_context(joined(contexts)), lambda where: F.coalesce(F.exists(references, lambda r: fits(where, r)), F.lit(False)).cast("double"))


@metric("context_recall")
def _recall(prediction: Column, references: Column, contexts: Column) -> Column:
    """Share of a reference's sentences of three words at least that the context contains, or shares four fifths of the words of; without
    such sentences the reference as a whole."""

    def told(where: Column, seen: Column, n: Column) -> Column:
        return (n != "") & (F.contains(where, n) | (overlap(words(n), seen) >= 0.8))

    def of(where: Column, seen: Column, reference: Column) -> Column:
        normalised = F.transform(sentences(reference), normalize_context)
        share = lambda long: F.size(F.filter(long, lambda n: told(where, seen, n))) / F.size(long).cast("double")
        whole = let(normalize_context(reference), lambda n: told(where, seen, n).cast("double"))
        return let(F.filter(normalised, lambda n: F.size(words(n)) >= 3), lambda long: F.when(F.size(long) > 0, share(long)).otherwise(whole))

    best = let(normalize_context(joined(contexts)), lambda where: let(F.array_distinct(words(where)), lambda seen: best_of(references, lambda r: of(where, seen, r))))
    return F.when(F.size(contexts) > 0, best).otherwise(0.0)


def _content(text: Column, stop: tuple[str, ...]) -> Column:
    return F.array_except(words(F.lower(text)), F.array(*map(F.lit, stop)))


@metric("faithfulness")
def _faithful(prediction: Column, references: Column, contexts: Column) -> Column:
    """Share of the prediction's distinct words, without stop words, that are in the context; 0 without any."""
    own = _content(prediction, FAITHFULNESS_STOP)
    return overlap(own, words(F.lower(joined(contexts))))


@metric("hallucination")
def _hallucinated(prediction: Column, references: Column, contexts: Column) -> Column:
    """Share of such words that are not; 0 for a blank prediction, 1 without context."""
    own = _content(prediction, HALLUCINATION_STOP)
    missing = F.size(F.array_except(own, words(F.lower(joined(contexts))))) / F.size(own).cast("double")
    return F.when(F.trim(prediction) == "", 0.0).when(F.coalesce(F.size(contexts), F.lit(0)) <= 0, 1.0).when(F.size(own) > 0, missing).otherwise(0.0)


def evaluate(rows: DataFrame, names: list[str], skip: tuple[str, ...] = ()) -> DataFrame:
    """rows (prediction, references, contexts, ...) without failed predictions, with a column for each metric that is not skipped.
    Context metrics are left out of a table without a contexts column."""
    rows = rows.filter(~is_error(F.col("prediction")))
    need = {"answer_in_context", "context_recall", "faithfulness", "hallucination"}
    if "contexts" not in rows.columns:
        names = [n for n in names if n not in need]
    contexts = F.col("contexts") if "contexts" in rows.columns else F.array().cast("array<string>")
    return rows.withColumns({n: REGISTRY[n](F.col("prediction"), F.col("references"), contexts) for n in names if n not in skip})


def contexts_of(retrieved: Column) -> Column:
    """The contents of retrieved documents."""
    return F.filter(F.transform(retrieved, lambda d: d["content"]), lambda c: F.coalesce(c, F.lit("")) != "")


def retrieval_quality(docs: Column, answers: Column) -> Column:
    """(avg, max, min, n, has_answer) of retrieved documents (content, score)."""
    scores = F.transform(docs, lambda d: d["score"])
    total = F.aggregate(scores, F.lit(0.0), lambda acc, x: acc + x)
    found = F.exists(answers, lambda a: F.exists(docs, lambda d: F.contains(F.lower(d["content"]), F.lower(a))))
    return F.struct(F.try_divide(total, F.size(scores)).alias("avg_score"), F.array_max(scores).alias("max_score"), F.array_min(scores).alias("min_score"), F.size(scores).alias("n_docs"), F.coalesce(found, F.lit(False)).alias("has_answer"))


def model_scores(rows: DataFrame, name: str, score: Callable[[Column, Column], Column], key: str = "pred_id") -> DataFrame:
    """(key, name): a model's best score of each prediction over its references, each pair a row for the model."""
    pairs = expand(rows.filter(~is_error(F.col("prediction"))).select(key, "prediction", "references"))
    scored = pairs.withColumn("score", F.when(F.col("reference").isNotNull(), score(F.col("prediction"), F.coalesce("reference", F.lit("")))))
    return aggregate(scored, key).withColumnRenamed("score", name)


def judged(rows: DataFrame, response: str = "response", binary: bool = True) -> DataFrame:
    """rows with the category and score that a judge's response tells."""
    from quillmark.functions.parse import judgement, judgement_score

    told = rows.withColumn("category", judgement(F.col(response), binary))
    return told.withColumn("score", judgement_score(F.col("category")))


def judge_shares(rows: DataFrame) -> DataFrame:
    """One row: mean score and the share of each category."""
    names = ("correct", "partially_correct", "incorrect")
    return rows.agg(F.avg("score").alias("score"), *(F.avg((F.col("category") == n).cast("int")).alias(n) for n in names))
