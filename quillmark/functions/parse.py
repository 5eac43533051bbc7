"""Parsers of model responses and log lines, and formatters, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What marks an answer that declines.
EMPTY_ANSWERS = ("", "n/a", "none", "unknown")
HEDGES = ("i don't know", "i'm not sure", "cannot determine", "not enough information", "i am not sure", "unclear", "i cannot", "unable to")
ABSTENTIONS = ("unknown", "unknown.", "n/a", "na", "none")
ABSTENTION_PATTERN = "i don't know|i do not know|unable to answer|insufficient information|not enough information"
#: Metrics that are shown in percent.
PERCENT = ("f1", "exact_match", "bertscore_f1", "bleurt", "llm_judge_qa")


def confidence(response: Column, default: float = 0.3) -> Column:
    """The number after ``CONFIDENCE:``, held within 0 and 1; the default if there is none (a negative number is none)."""
    found = F.regexp_extract(response, r"(?i)CONFIDENCE:\s*([0-9]*\.?[0-9]+)", 1).try_cast("double")
    return F.when(found.isNull(), default).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), found)))


def verification(response: Column) -> Column:
    up = F.upper(response)
    names = ("NOT_SUPPORTED", "PARTIALLY_SUPPORTED", "SUPPORTED")
    out = F.lit("UNKNOWN")
    for name in reversed(names):
        out = F.when(F.contains(up, F.lit(name)), name).otherwise(out)
    return out


def sufficient(response: Column) -> Column:
    up = F.upper(response)
    return F.coalesce(F.contains(up, F.lit("SUFFICIENT")) & ~F.contains(up, F.lit("INSUFFICIENT")), F.lit(False))


def variations(response: Column, original: Column, most: int = 3) -> Column:
    """The original query and the lines of a response that vary it: bullets and numbers off, headings dropped,
    cut to ``most``, none that is the original again (case aside)."""
    bare = F.transform(F.split(response, "\n"), lambda s: F.trim(F.regexp_replace(F.regexp_replace(F.trim(s), r"^[0-9]+[.)]\s*", ""), r"^[-*•]\s*", "")))
    lines = F.filter(bare, lambda s: (s != "") & ~F.rlike(F.lower(s), F.lit("^(alternative|question|version)")))
    new = F.filter(F.slice(lines, 1, most), lambda s: F.lower(s) != F.lower(F.trim(original)))
    return F.concat(F.array(original), new)


def judgement(response: Column, binary: bool = True) -> Column:
    """correct, partially_correct or incorrect: told by the first line, or else by the whole text. In binary mode partial is incorrect."""
    partial = "incorrect" if binary else "partially_correct"

    def told(text: Column) -> Column:
        return F.when(F.contains(text, F.lit("partial")), partial).when(F.rlike(text, F.lit(r"\bincorrect\b")), "incorrect").when(F.rlike(text, F.lit(r"\bcorrect\b")), "correct")

    whole = F.lower(F.coalesce(response, F.lit("")))
    first = F.trim(F.get(F.split(F.regexp_replace(whole, r"^\s+|\s+$", ""), "\n"), F.lit(0)))
    return F.coalesce(told(first), told(whole), F.lit("incorrect"))


def judgement_score(category: Column) -> Column:
    return F.when(category == "correct", 1.0).when(category == "partially_correct", 0.5).otherwise(0.0)


def clean_for_judge(text: Column, most: int = 500) -> Column:
    """Without anything after three dashes in a line, trimmed, cut."""
    return F.left(F.trim(F.regexp_replace(text, r"-{3,}.*", "")), F.lit(most))


def abstains(answer: Column) -> Column:
    """No answer, or one that declines."""
    low = F.lower(F.trim(answer))
    return F.coalesce((answer == "") | low.isin(*ABSTENTIONS) | F.rlike(low, F.lit(ABSTENTION_PATTERN)), F.lit(True))


def error_type(prediction: Column, f1: Column) -> Column:
    """The first that fits of: correct, refusal/empty, refusal/hedging, partial_match, over_verbose, wrong_answer."""
    low = F.lower(F.trim(F.coalesce(prediction, F.lit("None"))))
    hedged = F.exists(F.array(*map(F.lit, HEDGES)), lambda h: F.contains(low, h))
    return (
        F.when(f1 >= 0.5, "correct")
        .when(low.isin(*EMPTY_ANSWERS), "refusal/empty")
        .when(hedged, "refusal/hedging")
        .when(f1 > 0.0, "partial_match")
        .when(F.length(low) > 200, "over_verbose")
        .otherwise("wrong_answer")
    )


def log_timings(line: Column) -> Column:
    """(kind, name, seconds) of what a log line tells about time: a phase, a metric, a load or a batch; null for other lines."""
    kinds = {"phase": r"Phase \[(\w+)\] completed in ([0-9.]+)s", "metric": r"(\w+) done in ([0-9.]+)s", "load": r"(Generator) loaded in ([0-9.]+)s", "step": r"Step \[(\w+)\].*completed in ([0-9.]+)s"}
    out = F.lit(None)
    for kind, pattern in reversed(kinds.items()):
        told = F.struct(F.lit(kind).alias("kind"), F.regexp_extract(line, pattern, 1).alias("name"), F.regexp_extract(line, pattern, 2).try_cast("double").alias("seconds"))
        out = F.when(F.rlike(line, F.lit(pattern)), told).otherwise(out)
    return out


def stars(p: Column) -> Column:
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("ns")


def effect_size(d: Column) -> Column:
    size = F.abs(d)
    return F.when(size < 0.2, "negligible").when(size < 0.5, "small").when(size < 0.8, "medium").otherwise("large")


def passages(docs: Column, scores: bool = False) -> Column:
    """Numbered blocks of an array of (text, score), separated by blank lines."""

    def block(d: Column, i: Column) -> Column:
        head = F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "))
        tail = F.concat(F.lit(" (score: "), F.format_string("%.3f", d["score"]), F.lit(")")) if scores else F.lit("")
        return F.concat(head, d["text"], tail)

    return F.array_join(F.transform(docs, block), "\n\n")


def metric_text(name: Column, value: Column) -> Column:
    """``name=value``: some in percent with one decimal, others with three."""
    return F.when(name.isin(*PERCENT), F.format_string("%s=%.1f%%", name, value * 100)).otherwise(F.format_string("%s=%.3f", name, value))
