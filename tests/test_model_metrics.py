"""Token matching, entailment in rounds and limited calls, with models that are functions of their texts."""

import asyncio
import sys

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from quillmark.operators import neural

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the tasks know no test modules


def tokens(texts: list[str]) -> list[np.ndarray]:
    """A vector of letter counts for each word; long batches run out of memory."""
    if sum(map(len, texts)) > 60 and len(texts) > 1:
        raise RuntimeError("CUDA out of memory")
    return [np.array([[w.count(c) for c in "abcde"] for w in t.split()], float).reshape(-1, 5) for t in texts]


def plain(prediction: str, reference: str) -> tuple[float, float, float]:
    a, b = ([[w.count(c) for c in "abcde"] for w in t.split()] for t in (prediction, reference))
    if not a or not b:
        return 0.0, 0.0, 0.0
    cos = lambda x, y: sum(i * j for i, j in zip(x, y, strict=True)) / (max(sum(i * i for i in x) ** 0.5, 1e-12) * max(sum(j * j for j in y) ** 0.5, 1e-12))
    p = sum(max(cos(x, y) for y in b) for x in a) / len(a)
    r = sum(max(cos(x, y) for x in a) for y in b) / len(b)
    return p, r, 2 * p * r / (p + r) if p + r else 0.0


def test_token_matching_is_the_plain_one(spark):
    rows = [(k, p, r) for k, (p, r) in enumerate([("abc de bad", ["cab ed", "bad"]), ("", ["a"]), (None, ["b"]), ("zz a", []), ("a b", [None, "b a"]), ("[ERROR: x]", ["a"]), ("abcde " * 9, ["a " * 9, "edcba " * 20])])]
    got = {r[0]: tuple(round(x, 9) for x in r[1:]) for r in neural.bertscore(spark.createDataFrame(rows, "pred_id long, prediction string, references array<string>"), tokens).collect()}
    for k, p, refs in rows:
        want = max((plain(p or "", r or "") for r in refs or [""]), key=lambda s: s[2])
        assert k == 5 or got[k] == pytest.approx(tuple(round(x, 9) for x in want), abs=1e-8)
    assert 5 not in got and len(got) == 6


def test_batches_halve():
    sizes = []

    def run(part: list) -> list:
        sizes.append(len(part))
        if len(part) > 3:
            raise MemoryError
        return [x * x for x in part]

    assert neural.halving(run, list(range(10)), 16) == [x * x for x in range(10)] and sizes == [10, 8, 4, 2, 2, 2, 2, 2]
    with pytest.raises(RuntimeError, match="one item"):
        neural.halving(lambda part: (_ for _ in ()).throw(RuntimeError("out of memory")), [1])
    with pytest.raises(KeyError):
        neural.halving(lambda part: {}["x"], [1])


def nli(premises: list[str], claims: list[str]) -> list[dict[str, float]]:
    """Passages say their scores: 'e0.4 c0.2'."""
    return [{"ENTAILMENT": float(p.split("e")[1][:4]), "Contradiction": float(p.split("c")[1][:4]), "neutral": 0.99} for p in premises]


def test_entailment_in_rounds_is_the_plain_loop(spark):
    rng = np.random.default_rng(2)
    rows = [(k, f"claim {k}", [None if x < 0.1 else f"e{x:.2f} c{y:.2f}" for x, y in rng.random((int(rng.integers(0, 12)), 2))]) for k in range(60)]
    rows += [(60, "", ["e0.95 c0.90"]), (61, None, ["e0.50 c0.10"]), (62, "x", None), (63, "x", ["  "])]
    df = spark.createDataFrame(rows, "pred_id long, prediction string, contexts array<string>")
    faith = {r[0]: (r[1], r[2]) for r in neural.nli_faithfulness(df, nli).collect()}
    hall = {r[0]: r[1] for r in neural.nli_hallucination(df, nli).collect()}
    seen = everything = 0
    for k, p, contexts in rows:
        most = 0.0
        pairs = nli([c for c in contexts or [] if c and c.strip()], [])  if contexts else []
        for s in pairs:
            most = max(most, s["ENTAILMENT"])
            if most > 0.9:
                break
        assert faith[k][0] == pytest.approx(most), k
        against = max((s["Contradiction"] for s in pairs), default=0.0)
        want = 0.0 if not (p or "").strip() else against if against > 0.7 else 1 - max((s["ENTAILMENT"] for s in pairs), default=0.0)
        assert hall[k] == pytest.approx(want), k
        seen, everything = seen + faith[k][1], everything + len(pairs)
    assert seen < everything and len(faith) == len(hall) == len(rows)


def test_support_by_a_model(spark):
    rows = spark.createDataFrame([("yes, it is", ["a", "b", "c", "d"]), ("No.", []), ("maybe", ["a"]), (None, ["a"]), ("[ERROR: YES]", ["a"])], "r string, c array<string>")
    got = rows.select(neural.supported(F.col("r")), neural.support_prompt(F.lit("p"), F.col("c"))).collect()
    assert [r[0] for r in got] == [1.0, 0.0, 0.5, 0.5, 0.5] and "c\n\nAnswer:\np" in got[0][1] and "\nd" not in got[0][1]


def test_calls_are_bounded_and_tried_again(spark):
    """Rows keep their order; a limit is waited for, a refusal is not, and what fails for good is 0."""

    async def one(text: str, k: int) -> float:
        one.open = getattr(one, "open", 0) + 1
        tries = one.__dict__.setdefault("tries", {})
        tries[k] = tries.get(k, 0) + 1
        assert one.open <= 4, "too many at once"
        try:
            await asyncio.sleep(0.002)
            if text == "busy" and tries[k] < 3:
                raise RuntimeError("status 429")
            if text == "down":
                raise RuntimeError("503 unavailable")
            if text == "bad":
                raise ValueError("refused")
            return k / 10
        finally:
            one.open -= 1

    rows = spark.createDataFrame([(["ok", "busy", "down", "bad"][k % 4], k) for k in range(40)], "text string, k int").coalesce(1)
    got = rows.select("text", "k", neural.limited(one, concurrent=4, retries=2, delay=0.005)("text", "k").alias("s")).select("text", "k", "s.*").collect()
    want = {"ok": (False, 1), "busy": (False, 3), "down": (True, 3), "bad": (True, 1)}
    assert len(got) == 40 and all((r["failed"], r["attempts"]) == want[r["text"]] and r["score"] == (0.0 if r["failed"] else r["k"] / 10) for r in got)


def test_calls_are_spaced():
    import time

    async def one() -> float:
        return 1.0

    begin = time.monotonic()
    assert asyncio.run(neural._called(one, [()] * 5, 5, 3000, 0, 1.0)) == [(1.0, False, 1)] * 5
    assert time.monotonic() - begin >= 4 * 60 / 3000
