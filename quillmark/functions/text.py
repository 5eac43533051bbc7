"""Text functions as Column expressions. A word character is a letter or number of any script, or an underscore; white space is Unicode's, by the flag (?U)."""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_WORD = r"\p{L}\p{N}_"
# The words that the two overlap metrics ignore.
FAITHFULNESS_STOP = ("the", "a", "an", "is", "was", "are", "were", "be", "been", "in", "on", "at", "to", "for", "of", "and", "or", "but")
HALLUCINATION_STOP = (*FAITHFULNESS_STOP, "this", "that", "these", "those", "it", "its", "they", "their")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once. Inside a function over array elements an outer expression is computed anew for
    each element; a bound variable is not."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    """Split at white space; no empty words."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def squeeze(text: Column) -> Column:
    """Runs of white space become one blank."""
    return F.regexp_replace(text, r"(?U)\s+", " ")


def normalize_answer(text: Column) -> Column:
    """Lower case, no ASCII punctuation, no English articles, single blanks, trimmed."""
    bare = F.translate(F.lower(F.coalesce(text, F.lit(""))), string.punctuation, "")
    return F.trim(squeeze(F.regexp_replace(bare, f"(?<![{_WORD}])(a|an|the)(?![{_WORD}])", " ")))


def normalize_context(text: Column) -> Column:
    """Lower case, anything but word characters and white space to a blank, single blanks, trimmed."""
    return F.trim(squeeze(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), rf"(?U)[^{_WORD}\s]", " ")))


def normalize_fuzzy(text: Column) -> Column:
    """As normalize_context, but trimmed before punctuation goes, so a blank may stay at either end."""
    trimmed = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"(?U)^\s+|\s+$", "")
    return squeeze(F.regexp_replace(trimmed, rf"(?U)[^{_WORD}\s]", " "))


def sentences(text: Column) -> Column:
    """Parts between runs of . ! ?, trimmed, none empty."""
    parts = F.transform(F.split(text, "[.!?]+"), lambda s: F.regexp_replace(s, r"(?U)^\s+|\s+$", ""))
    return F.filter(parts, lambda s: s != "")


def tokens(text: Column) -> Column:
    """Lower-case tokens of two word characters at least, repeats included."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"([{_WORD}]{{2,}})"), F.lit(1))


def numbered(bag: Column) -> Column:
    """The words of a bag, each with the number of its occurrence, so that bags can be intersected as sets."""
    return let(F.sort_array(bag), lambda ordered: F.transform(ordered, lambda w, i: F.concat_ws(" ", w, (i - F.array_position(ordered, w)).cast("string"))))


def token_f1(prediction: Column, reference: Column) -> Column:
    """F1 of the bags of words of two normalised texts: 1 if both are empty, 0 if one is or they share none."""

    def of(p: Column, r: Column) -> Column:
        shared = F.size(F.array_intersect(p, r))
        return F.when((F.size(p) == 0) & (F.size(r) == 0), 1.0).when(shared == 0, 0.0).otherwise(2.0 * shared / (F.size(p) + F.size(r)))

    return let(numbered(words(normalize_answer(prediction))), lambda p: let(numbered(words(normalize_answer(reference))), lambda r: of(p, r)))


def exact_match(prediction: Column, reference: Column) -> Column:
    return (normalize_answer(prediction) == normalize_answer(reference)).cast("double")


def overlap(a: Column, b: Column) -> Column:
    """Share of the distinct words in array a that are in b; 0 if a is empty."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_distinct(a)).cast("double")), F.lit(0.0))


def text_hash(text: Column) -> Column:
    """First 32 hexadecimal digits of SHA-256."""
    return F.left(F.sha2(text, 256), F.lit(32))


def title_key(title: Column) -> Column:
    return F.lower(F.trim(F.replace(title, F.lit("_"), F.lit(" "))))


def answer_in_prompt(answers: Column, prompt: Column) -> Column:
    """Whether a normalised answer of two characters at least is contained in the normalised prompt."""

    def fits(where: Column, answer: Column) -> Column:
        return let(normalize_fuzzy(answer), lambda a: (F.length(a) >= 2) & F.contains(where, a))

    return let(normalize_fuzzy(prompt), lambda where: F.coalesce(F.exists(answers, lambda a: fits(where, a)), F.lit(False)))


def is_correct(prediction: Column, answers: Column, threshold: float = 0.5) -> Column:
    """Whether prediction and an answer contain one another, or share enough of the answer's words."""

    def fits(p: Column, a: Column) -> Column:
        shared = (F.size(words(p)) > 0) & (F.size(words(a)) > 0) & (overlap(words(a), words(p)) >= threshold)
        return (a != "") & (F.contains(p, a) | F.contains(a, p) | shared)

    told = let(normalize_fuzzy(prediction), lambda p: F.exists(answers, lambda answer: let(normalize_fuzzy(answer), lambda a: fits(p, a))))
    return F.coalesce((prediction != "") & told, F.lit(False))


def shorten(text: Column, most: int, mark: str = "...") -> Column:
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most)), F.lit(mark))).otherwise(text)


def dot(a: Column, b: Column) -> Column:
    """Inner product of two arrays in double precision, in order."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def unit(v: Column) -> Column:
    """v over its length, the length not under 1e-12."""
    return let(F.greatest(norm(v), F.lit(1e-12)), lambda length: F.transform(v, lambda x: x.cast("double") / length))
