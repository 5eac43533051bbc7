"""Metrics whose scores come from models: token matching, entailment in rounds, calls of a limited service.

Models go in as plain functions; what is here is what is done with them: batches that halve when memory runs out, claims that drop out when they are settled, calls
that are spaced, bounded and tried again.
"""

from __future__ import annotations

import asyncio
import random
import time
from collections.abc import Awaitable, Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark.operators.metrics import is_error
from quillmark.session import new_folder, stored

#: Pairs of a model's batch at first; an entailment above it settles a claim; a contradiction above it decides.
BATCH, SETTLED, CONTRADICTED = 128, 0.9, 0.7

Tokens = Callable[[list[str]], list[np.ndarray]]
Pairs = Callable[[list[str], list[str]], list[dict[str, float]]]


def _out_of_memory(e: Exception) -> bool:
    return isinstance(e, MemoryError) or "out of memory" in str(e).lower()


def halving(run: Callable[[list], list], items: list, batch: int = BATCH) -> list:
    """run over the items in batches. A batch for which memory runs out is tried again at half the size, which then stays; one item that is too large is an error."""
    out: list = []
    while len(out) < len(items):
        try:
            out += run(items[len(out) : len(out) + batch])
        except Exception as e:
            if not _out_of_memory(e):
                raise
            if batch == 1:
                raise RuntimeError("out of memory with a batch of one item") from e
            batch //= 2
    return out


def matched(prediction: np.ndarray, reference: np.ndarray) -> tuple[float, float, float]:
    """Precision, recall and F1 of two matrices of token vectors: each token takes its nearest of the other side, by cosine. Without tokens on a side all are 0."""
    if not len(prediction) or not len(reference):
        return 0.0, 0.0, 0.0
    a, b = (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12) for x in (prediction, reference))
    s = a @ b.T
    p, r = float(s.max(axis=1).mean()), float(s.max(axis=0).mean())
    return p, r, 2 * p * r / (p + r) if p + r else 0.0


def bertscore(rows: DataFrame, tokens: Tokens, key: str = "pred_id", batch: int = BATCH) -> DataFrame:
    """(key, bertscore_precision, bertscore_recall, bertscore_f1) of rows (key, prediction, references): the reference with the best F1, the first of equal ones.

    tokens: from texts to a matrix of token vectors each, in a task. A pair is a row for the model, so a prediction with many references is not one batch. Null texts count as
    empty; failed predictions are left out; a prediction without references scores 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = sorted({t for c in (2, 3) for t in b.column(c).to_pylist()})
            vectors = dict(zip(texts, halving(tokens, texts, batch), strict=True))
            found = [matched(vectors[p], vectors[r]) for p, r in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array([f[k] for f in found], pa.float64()) for k in range(3))], names=[key, "at", "p", "r", "f"])

    kept = rows.filter(~F.coalesce(is_error(F.col("prediction")), F.lit(False)))
    pairs = kept.select(key, F.posexplode_outer("references").alias("at", "reference"), F.coalesce("prediction", F.lit("")).alias("prediction"))
    pairs = pairs.select(key, F.coalesce("at", F.lit(0)).alias("at"), "prediction", F.coalesce("reference", F.lit("")).alias("reference"))
    kind = rows.schema[key].dataType.simpleString()
    scored = pairs.mapInArrow(run, f"{key} {kind}, at int, p double, r double, f double")
    best = scored.groupBy(key).agg(F.max_by(F.struct("p", "r", "f"), F.struct("f", -F.col("at"))).alias("s"))
    return best.select(key, F.col("s.p").alias("bertscore_precision"), F.col("s.r").alias("bertscore_recall"), F.col("s.f").alias("bertscore_f1"))


def _pairs(rows: DataFrame, key: str) -> DataFrame:
    """(key, at, premise, claim): each passage with text, in order, with the prediction."""
    pairs = rows.select(key, F.coalesce("prediction", F.lit("")).alias("claim"), F.posexplode("contexts").alias("place", "premise")).filter(F.trim(F.coalesce("premise", F.lit(""))) != "")
    return pairs.select(key, (F.row_number().over(Window.partitionBy(key).orderBy("place")) - 1).alias("at"), "premise", "claim")


def entailed(pairs: DataFrame, nli: Pairs, key: str = "pred_id", batch: int = BATCH) -> DataFrame:
    """(key, at, entailment, contradiction) of pairs (key, at, premise, claim). nli: from premises and claims to scores by label; labels that contain the two words count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = lambda scores, word: max((s for label, s in scores.items() if word in label.lower()), default=0.0)
        for b in batches:
            asked = list(zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True))
            told = halving(lambda part: nli([p for p, _ in part], [c for _, c in part]), asked, batch)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array([float(of(s, w)) for s in told], pa.float64()) for w in ("entailment", "contradiction"))], names=[key, "at", "entailment", "contradiction"])

    kind = pairs.schema[key].dataType.simpleString()
    return pairs.select(key, F.col("at").cast("int").alias("at"), "premise", "claim").mapInArrow(run, f"{key} {kind}, at int, entailment double, contradiction double")


def nli_faithfulness(rows: DataFrame, nli: Pairs, key: str = "pred_id", settled: float = SETTLED) -> DataFrame:
    """(key, faithfulness, n_scored) of rows (key, prediction, contexts), keys unlike: the largest entailment of the prediction by its passages, up to the first above ``settled``.

    In rounds of 1, 1, 2, 4, ... passages; predictions that are settled are not asked again. n_scored: pairs that the model saw. Without a passage with text it is 0."""
    spark, work = rows.sparkSession, new_folder(rows.sparkSession, "nli")
    open_ = stored(_pairs(rows, key), f"{work}/pairs")
    rounds, begin, wide = [], 0, 1
    while not open_.isEmpty():
        # Written, so that the model is asked once.
        scored = stored(entailed(open_.filter(F.col("at") < begin + wide), nli, key), f"{work}/scored-{len(rounds)}")
        rounds.append(scored)
        done = scored.filter(F.col("entailment") > settled).select(key).distinct()
        begin, wide = begin + wide, max(1, begin + wide)
        open_ = stored(open_.filter(F.col("at") >= begin).join(done, key, "left_anti"), f"{work}/open-{len(rounds)}")
    found = spark.createDataFrame([], f"{key} {rows.schema[key].dataType.simpleString()}, at int, entailment double, contradiction double")
    for scored in rounds:
        found = found.unionByName(scored)
    first = F.min(F.when(F.col("entailment") > settled, F.col("at")))
    counted = found.groupBy(key).agg(first.alias("first"), F.count("*").alias("n"), F.max("entailment").alias("most"), F.min_by("entailment", F.when(F.col("entailment") > settled, F.col("at"))).alias("its"))
    return rows.select(key).join(counted, key, "left").select(key, F.coalesce(F.when(F.col("first").isNotNull(), F.col("its")).otherwise(F.col("most")), F.lit(0.0)).alias("faithfulness"), F.coalesce("n", F.lit(0)).alias("n_scored"))


def nli_hallucination(rows: DataFrame, nli: Pairs, key: str = "pred_id", contradicted: float = CONTRADICTED) -> DataFrame:
    """(key, hallucination) of rows (key, prediction, contexts), keys unlike: the largest contradiction by a passage if it is above ``contradicted``, else what the largest entailment
    leaves to 1. A blank prediction has 0, one without a passage with text 1."""
    scored = entailed(_pairs(rows, key), nli, key).groupBy(key).agg(F.max("entailment").alias("e"), F.max("contradiction").alias("c"))
    value = F.when(F.col("c") > contradicted, F.col("c")).otherwise(1.0 - F.coalesce("e", F.lit(0.0)))
    blank = F.trim(F.coalesce("prediction", F.lit(""))) == ""
    return rows.select(key, "prediction").join(scored, key, "left").select(key, F.when(blank, 0.0).otherwise(value).alias("hallucination"))


def support_prompt(prediction: Column, contexts: Column, most: int = 3) -> Column:
    """The question to a model whether the first passages support an answer."""
    passages = F.array_join(F.slice(contexts, 1, most), "\n\n")
    return F.concat(F.lit("Passages:\n"), passages, F.lit("\n\nAnswer:\n"), prediction, F.lit("\n\nDo the passages support every statement of the answer? Reply YES or NO only.\nReply:"))


def supported(response: Column) -> Column:
    """1 if the response says YES, 0 if NO, one half otherwise, also for a failed one."""
    told = F.upper(F.trim(F.coalesce(response, F.lit(""))))
    return F.when(is_error(response) | ~F.rlike(told, F.lit("YES|NO")), 0.5).when(F.contains(told, F.lit("YES")), 1.0).otherwise(0.0)


def retryable(e: Exception) -> bool:
    """A limit was hit or the server failed: the message holds 429 or begins with 5."""
    return "429" in str(e) or str(e).startswith("5")


async def _called(one: Callable[..., Awaitable[float]], rows: list[tuple], concurrent: int, per_minute: float, retries: int, delay: float) -> list[tuple[float, bool, int]]:
    gate, turn, last = asyncio.Semaphore(concurrent), asyncio.Lock(), [-1e9]

    async def spaced() -> None:
        async with turn:
            if (wait := last[0] + 60.0 / per_minute - time.monotonic()) > 0:
                await asyncio.sleep(wait)
            last[0] = time.monotonic()

    async def call(row: tuple) -> tuple[float, bool, int]:
        async with gate:
            for attempt in range(retries + 1):
                if per_minute:
                    await spaced()
                try:
                    return float(await one(*row)), False, attempt + 1
                except Exception as e:
                    if attempt == retries or not retryable(e):
                        return 0.0, True, attempt + 1
                await asyncio.sleep(delay * 2**attempt + random.random() * delay)
        raise AssertionError("not reached")

    return list(await asyncio.gather(*map(call, rows)))


def limited(one: Callable[..., Awaitable[float]], concurrent: int = 20, per_minute: float = 0, retries: int = 3, delay: float = 1.0) -> Callable[..., Column]:
    """A column of (score, failed, attempts) from an asynchronous call for each row, in the rows' order.

    concurrent, per_minute: of a task; with many tasks give each its share of the service's limits, 0 for none. A call is tried again after a limit or a server's failure, at most ``retries``
    times, after ``delay`` times 1, 2, 4, ... seconds and up to ``delay`` more. A row that fails for good has the score 0."""

    @F.pandas_udf("score double, failed boolean, attempts int")
    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for columns in batches:
            rows = list(zip(*(columns if isinstance(columns, tuple) else (columns,)), strict=True))
            yield pd.DataFrame(asyncio.run(_called(one, rows, concurrent, per_minute, retries, delay)), columns=["score", "failed", "attempts"])

    return run
