"""The divergence audit and the quality rules against plain Python, and their edges."""

import random
import re
from collections import Counter

from pyspark.sql import functions as F

from quillmark.llm import divergence, rules

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def plain_audit(rows: list[tuple], least: int, most: int) -> set[tuple]:
    lower = lambda s: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower(text or ""))) for lang, source, text in rows]
    out = set()
    for lang in {d[0] for d in docs}:
        df = Counter(t for d in docs if d[0] == lang for t in set(d[2]))
        kept = [t for t in df if df[t] >= least]
        own = {s: Counter(t for d in docs if d[:2] == (lang, s) for t in d[2] if df[t] >= least) for s in {d[1] for d in docs if d[0] == lang}}
        whole = sum(own.values(), Counter())
        p = lambda c, t: 1 + 10**9 * (c[t] + 5) // (sum(c.values()) + 5 * len(kept))
        for s, c in own.items():
            pairs = [(o, sum(abs(p(c, t) - p(d, t)) for t in kept)) for o, d in own.items() if o != s]
            terms = [(t, p(c, t) - p(whole, t)) for t in kept if c[t] > 0 and p(c, t) > p(whole, t)]
            for part, items, end in (("pair", pairs, None), ("term", terms, most)):
                ranked = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:end]
                out |= {(lang, s, part, item, value, k) for k, (item, value) in enumerate(ranked, 1)}
    return out


def test_audit_is_the_plain_one(spark, monkeypatch):
    """Skewed sources, terms of every count, more sources than a list holds, tallies handed on early."""
    rng = random.Random(7)
    pool = [f"w{chr(97 + i)}É" for i in range(12)] + ["Ünd", "the", "A-b", "x1y"]
    rows = [(rng.choice(["en", "de", None]), f"s{min(int(rng.expovariate(0.4)), 9)}", " ".join(rng.choices(pool, k=rng.randrange(12)))) for _ in range(400)]
    rows += [("fr", "only", "rare words"), ("en", "void", None), ("en", None, ""), ("fr", "two", "12 34")]
    df = spark.createDataFrame(rows, "lang string, source string, text string")
    want = plain_audit(rows, 30, 5)
    assert {tuple(r) for r in divergence.audit(df, 30, 5).collect()} == want
    for name, value in (("TILE", 3), ("CELLS", 50), ("BYTES", 200)):
        monkeypatch.setattr(divergence, name, value)
    assert {tuple(r) for r in divergence.audit(df.repartition(5), 30, 5).collect()} == want


def test_combinations_with_a_zero_are_implied(spark):
    """Tallies of a pair add up to the kept terms, whichever of the two has them."""
    rows = [("en", s, t) for s, t in (("a", "one two two"), ("b", "two three"), ("c", "four"))]
    got = {tuple(r) for r in divergence.audit(spark.createDataFrame(rows, "lang string, source string, text string"), 1).collect()}
    assert got == plain_audit(rows, 1, 50)


def test_audit_of_odd_tables(spark):
    schema = "doc_id long, lang string, source string, text string, term string, n long, at long, value long"
    assert divergence.op11(spark.createDataFrame([], schema)).collect() == []
    odd = [(None, None, None, None, "x", 1, 1, 1), (None, None, "b", "word " * 5000, "x", 1, 1, 1)] + [(1, None, "b", "word", "y", 2, 2, 2)] * 29
    got = {tuple(r) for r in divergence.op11(spark.createDataFrame(odd, schema)).collect()}
    assert got == plain_audit([(r[1], r[2], r[3]) for r in odd], 30, 50) and {r[2] for r in got} == {"pair"}  # one source has all there is, as often as its language


def plain_figures(text: str | None) -> tuple:
    text = text or ""
    words = WORDS.findall(text)
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {i + k for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    n = len(words)
    return n, sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered), n < 10 or 100 * len(covered) > 20 * n


def plain_verdicts(rows: list[tuple], docs_limit: int, share: float) -> list[tuple]:
    norm = lambda x: " ".join(WORDS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else "0" if c in "0123456789" else c for c in x)))
    places: dict = {}
    hosts: dict = {}
    for _, source, text in rows:
        for line in (text or "").split("\n"):
            if norm(line):
                places.setdefault((source or "", norm(line)), set()).add(text)
                hosts.setdefault(source or "", set()).add(text)
    gone = {k for k, v in places.items() if len(v) > docs_limit and len(v) > share * len(hosts[k[0]])}
    out = []
    for doc, source, text in rows:
        own = plain_figures(text)
        lost = [x for x in (text or "").split("\n") if (source or "", norm(x)) in gone]
        left = None if text is None else "\n".join(x for x in text.split("\n") if x not in lost)
        removed = sum(len(WORDS.findall(x)) for x in lost)
        out.append((doc, left, *own, removed, not own[5] and own[0] - removed >= 0.5 * own[0]))
    return out


def test_rules_are_the_plain_ones(spark):
    """Repeated windows that overlap, shared lines in several forms, hosts of unlike size, repeated and missing ids, empty and long texts."""
    rng = random.Random(3)
    prose = lambda k: " ".join(f"w{rng.randrange(10**6)}" for _ in range(k))
    rows = [(i, rng.choice(["a", "b", None]), "\n".join([rng.choice(["Menu 12  Home", "menu 99 home", "About us", ""]), prose(rng.randrange(30)), "\tMENU 00 HOME ", prose(5)])) for i in range(90)]
    rows += [(100 + i, "a", "\n".join(["Menu 1 home and all the rest of it"] * 2 + [f"own {i} line"])) for i in range(20)]
    rows += [(1, "a", "a a a a a a a b " * 30), (1, "a", "a a a a a a a b " * 30), (None, "b", None), (None, "b", ""), (7, None, "#*$%&|<> é x\x0by\rz\n\n \nq"), (8, "c", prose(30_000) + " one two three four five" * 2)]
    got = rules.judge(spark.createDataFrame(rows, "doc_id long, source string, text string"), 10, 0.1)
    got = [(r["row"]["doc_id"], *r[1:]) for r in got.collect()]
    assert sorted(got, key=repr) == sorted(plain_verdicts(rows, 10, 0.1), key=repr)
    assert any(r[-2] for r in got) and any(not r[-1] and not r[-3] for r in got)


def test_copies_do_not_make_lines_frequent(spark):
    """A text that was taken in a hundred times is one document, so its lines stay."""
    text = "\n".join(" ".join(f"word{i}of{k}" for k in range(6)) for i in range(5))
    got = rules.op12(spark.createDataFrame([(i, "h", text) for i in range(100)], "doc_id long, source string, text string"))
    assert got.filter("kept").count() == 100


def test_rules_of_odd_tables_and_no_python(spark):
    schema = "doc_id long, text string, source string, lang string, at long, h long, n_words string, kept string"
    empty = rules.op12(spark.createDataFrame([], schema))
    assert empty.collect() == [] and dict(empty.dtypes)["kept"] == "boolean"
    one = spark.createDataFrame([(3, "few words", "s", "en", 1, 2, "x", "y")], schema)
    assert [tuple(r) for r in rules.op12(one).collect()] == [(3, 2, 8, 0, 0, 0, True, False)]
    assert "Python" not in rules.op12(one)._jdf.queryExecution().executedPlan().toString()


def test_repeated_windows_of_long_texts(spark):
    """Every window twice or more, in a text of 200,000 words: places are sorted, not searched."""
    words = [f"w{i % 50_000}" for i in range(200_000)]
    got = spark.createDataFrame([(" ".join(words),)], "t string").select(rules.repeated_words(rules.words_of(F.col("t"))).alias("n")).first()["n"]
    assert got == 200_000
