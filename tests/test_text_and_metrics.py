"""Text functions and metrics against values worked by hand and plain Python."""

import re
import string
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillmark.functions import names, parse, text
from quillmark.operators import metrics

TEXTS = ["The Cat, sat!", "  a  b\tthe\n", "", "Çà et là — l'été", "an. THE. x", "naïve café_1 ²", "Ünïcode a the theory"]


def one(spark, column, **values):
    row = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items()))
    return row.select(column.alias("out")).first()["out"]


@pytest.mark.parametrize("t", TEXTS)
def test_normalisers_equal_python(spark, t):
    bare = "".join(c for c in t.lower() if c not in string.punctuation)
    answer = " ".join(re.sub(r"\b(a|an|the)\b", " ", bare).split())
    assert one(spark, text.normalize_answer(F.col("t")), t=t) == answer
    assert one(spark, text.normalize_context(F.col("t")), t=t) == re.sub(r"\s+", " ", re.sub(r"[^\w\s]", " ", t.lower())).strip()
    assert one(spark, text.normalize_fuzzy(F.col("t")), t=t) == re.sub(r"\s+", " ", re.sub(r"[^\w\s]", " ", t.lower().strip()))
    assert one(spark, text.words(F.col("t")), t=t) == t.split()
    assert one(spark, text.tokens(F.col("t")), t=t) == re.findall(r"\b\w\w+\b", t.lower())
    assert one(spark, text.sentences(F.col("t")), t=t) == [s.strip() for s in re.split(r"[.!?]+", t) if s.strip()]


def f1(p, r):
    p, r = p.split(), r.split()
    shared = sum((Counter(p) & Counter(r)).values())
    if not p and not r:
        return 1.0
    return 2 * shared / (len(p) + len(r)) if shared else 0.0


@pytest.mark.parametrize("p, r", [("Paris is nice", "The capital is Paris"), ("x", "y"), ("", ""), ("", "y"), ("b b b c", "b b d"), ("the", "a")])
def test_token_f1(spark, p, r):
    clean = lambda t: re.sub(r"\b(a|an|the)\b", " ", t.lower())
    assert one(spark, text.token_f1(F.col("p"), F.col("r")), p=p, r=r) == pytest.approx(f1(clean(p), clean(r)))


def test_f1_worked_by_hand(spark):
    assert one(spark, text.token_f1(F.col("p"), F.col("r")), p="Paris is nice", r="The capital is Paris") == pytest.approx(2 / 3)


ROWS = [
    (1, "Paris", ["Paris", "City of Light"], ["Paris is the capital of France. It is large."]),
    (2, "[ERROR: failed]", ["x"], ["x"]),
    (3, "[ABORTED: failed]", ["x"], ["x"]),
    (4, "", [], None),
    (5, "blue whale", ["It is large. Blue whales eat krill daily."], ["it is large"]),
    (6, "the of", ["z"], []),
]
SCHEMA = "pred_id long, prediction string, references array<string>, contexts array<string>"


def test_metrics(spark):
    rows = spark.createDataFrame(ROWS, SCHEMA)
    got = {r["pred_id"]: r for r in metrics.evaluate(rows, list(metrics.REGISTRY)).collect()}
    assert sorted(got) == [1, 3, 4, 5, 6]
    assert (got[1]["exact_match"], got[1]["f1"], got[1]["answer_in_context"], got[1]["faithfulness"], got[1]["hallucination"]) == (1, 1, 1, 1, 0)
    assert got[4]["f1"] == 0 and got[4]["hallucination"] == 0 and got[4]["faithfulness"] == 0 and got[4]["context_recall"] == 0
    assert got[5]["context_recall"] == 0.5 and got[5]["hallucination"] == 1
    assert got[6]["hallucination"] == 1 and got[6]["faithfulness"] == 0


def test_expand_and_aggregate(spark):
    rows = spark.createDataFrame(ROWS, SCHEMA)
    scored = metrics.expand(rows).withColumn("score", text.token_f1(F.col("prediction"), F.col("reference")))
    best = {r["pred_id"]: r["score"] for r in metrics.aggregate(scored).collect()}
    assert best[1] == 1 and best[4] == 0


def test_metrics_without_contexts(spark):
    rows = spark.createDataFrame(ROWS, SCHEMA).drop("contexts")
    assert "context_recall" not in metrics.evaluate(rows, list(metrics.REGISTRY)).columns


def test_own_metric(spark):
    @metrics.metric("length")
    def length(prediction, references, contexts):
        return F.length(prediction).cast("double")

    try:
        assert metrics.evaluate(spark.createDataFrame(ROWS, SCHEMA), ["length"]).filter("pred_id = 1").first()["length"] == 5
    finally:
        del metrics.REGISTRY["length"]


@pytest.mark.parametrize("response, want", [("CONFIDENCE: 0.8", 0.8), ("confidence: 7", 1.0), ("CONFIDENCE: -1", 0.3), ("none", 0.3), ("Confidence: .5", 0.5)])
def test_confidence(spark, response, want):
    assert one(spark, parse.confidence(F.col("r")), r=response) == want


def test_parsers(spark):
    assert one(spark, parse.verification(F.col("r")), r="it is partially_supported") == "PARTIALLY_SUPPORTED"
    assert one(spark, parse.verification(F.col("r")), r="NOT_SUPPORTED and SUPPORTED") == "NOT_SUPPORTED"
    assert one(spark, parse.sufficient(F.col("r")), r="Insufficient") is False and one(spark, parse.sufficient(F.col("r")), r="sufficient") is True
    assert one(spark, parse.variations(F.col("r"), F.col("q")), r="Alternatives:\n1. What is A?\n- what is b?\n* C\n2) D", q="What is B?") == ["What is B?", "What is A?", "C"]
    assert one(spark, parse.judgement(F.col("r")), r="Well\nthat is correct") == "correct"
    assert one(spark, parse.judgement(F.col("r"), binary=False), r="PARTIALLY_CORRECT") == "partially_correct"
    assert one(spark, parse.judgement(F.col("r")), r="incorrect, not correct") == "incorrect"
    assert one(spark, parse.clean_for_judge(F.col("r")), r=" yes --- END ---") == "yes"
    assert one(spark, parse.log_timings(F.col("r")), r="Phase [generating] completed in 32.2s").asDict() == {"kind": "phase", "name": "generating", "seconds": 32.2}
    assert one(spark, parse.abstains(F.col("r")), r="I don't know.") is True and one(spark, parse.abstains(F.col("r")), r="Paris") is False
    assert one(spark, parse.metric_text(F.col("n"), F.lit(0.853)), n="f1") == "f1=85.3%"


@pytest.mark.parametrize(
    "name, want",
    [
        ("simple_minilm_recursive_1024", ("simple", "minilm", "recursive", 1024)),
        ("dense_bge_large_512", ("dense", "bge", "large", 512)),
        ("nothing", ("unknown", "unknown", "unknown", 0)),
        (None, ("unknown", "unknown", "unknown", 0)),
    ],
)
def test_retriever_parts(spark, name, want):
    assert tuple(one(spark, names.retriever_parts(F.col("n").cast("string")), n=name)) == want


def test_names(spark):
    assert one(spark, names.model_short(F.col("m")), m="vllm:Qwen/Qwen2.5-7B-Instruct") == "Qwen257BI"
    assert one(spark, names.model_short(F.col("m")), m="hf:google/gemma-2-2b-it") == "gemma22bI"
    assert one(spark, names.without_unwired(F.col("n")), n="rag_m_dense_k5_hyde_bge-v2_concise_nq") == "rag_m_dense_k5_concise_nq"
    assert one(spark, names.without_unwired(F.col("n")), n="rag_m_dense_k5_concise_nq") is None
    assert one(spark, names.chunk_size(F.col("n")), n="hier_2048p_448c") == "2048p/448c"
    assert one(spark, names.index_name(F.col("m"), F.lit(512), F.lit(50), F.lit("en")), m="BAAI/bge-large-en") == "en_large_en_c512_o50"
    told = one(spark, names.parse_experiment(F.col("n")), n="iterative_gemma2_9b_2iter_nq")
    assert (told["is_singleton"], told["model_short"], told["query_transform"], told["dataset"]) == (True, "Gemma2-9B", "iterative_2", "nq")
    tags = names.issues(F.lit("hybrid_x"), F.lit("iterative_rag"), F.lit("hyde"), F.lit("none"), F.lit(2))
    assert spark.range(1).select(tags.alias("t")).first()["t"] == ["HYBRID_RRF", "ITERATIVE_HYDE"]


def test_model_slots(spark):
    import pandas as pd

    from quillmark.operators import fusion

    @F.pandas_udf("double")
    def same_length(p: pd.Series, r: pd.Series) -> pd.Series:
        return (p.str.len() == r.str.len()).astype("float64")

    @F.pandas_udf("array<string>")
    def louder(t: pd.Series) -> pd.Series:
        return t.map(lambda x: [x.upper(), x + "!"])

    got = {r["pred_id"]: r["length"] for r in metrics.model_scores(spark.createDataFrame(ROWS, SCHEMA), "length", same_length).collect()}
    assert got == {1: 1.0, 3: 0.0, 4: 0.0, 5: 0.0, 6: 0.0}
    asked = spark.createDataFrame([(1, "q")], "query_id long, text string")
    assert [(r["expansion"], r["text"]) for r in fusion.model_expansions(asked, louder).collect()] == [(0, "q"), (1, "q!")]
    said = spark.createDataFrame([("correct",), ("partial",), ("?",), ("incorrect",)], "response string")
    assert metrics.judge_shares(metrics.judged(said)).first()["score"] == 0.25
    assert metrics.judge_shares(metrics.judged(said, binary=False)).first()["partially_correct"] == 0.25
