"""Layouts of prompts, filled in; examples from files."""

import json

import pytest
from pyspark.sql import functions as F

from quillmark.functions import prompts


def made(spark, *args, **more) -> str:
    return spark.range(1).select(prompts.prompt(*(F.lit(a) if isinstance(a, str) else a for a in args), **more)).first()[0]


def test_plain_layouts(spark):
    assert made(spark, "why?") == "Answer the question using your knowledge.\n\nQuestion: why?\n\nReply with just the answer. If you don't know, answer 'Unknown'.\nAnswer:"
    text = made(spark, "why?", "[1] so", kind="concise_strict")
    assert "\n\nRetrieved Passages:\n[1] so\n\nQuestion: why?\n\nGive ONLY the answer" in text and "own knowledge. Find the answer in the passages.\n\n" in text and "Examples" not in text
    bare = made(spark, "why?", "[1] so", kind="no such type")
    assert bare.startswith("Answer the question using the retrieved passages below. If the passages don't contain the answer, you may use your own knowledge.\n\nRetrieved") and bare.endswith("Question: why?\n\nIf you don't know, answer 'Unknown'.\nAnswer:")


def test_layouts_with_delimiters(spark):
    for kind, marks in {"structured": ["### Context\n[1] so\n\n### Question\nwhy?", "### Answer\n"], "extractive": ["---PASSAGES---\n[1] so\n---END PASSAGES---"], "cot": ["Reasoning:"], "cited": ["[1], [2]", "citation"]}.items():
        text = made(spark, "why?", "[1] so", kind=kind)
        assert all(m in text for m in marks) and "{" not in text
    assert set(prompts.STYLES) >= {"extractive_quoted", "cot_final", "concise_json", "fewshot", "fewshot_1", "fewshot_3"}


def test_examples_are_shown(spark, tmp_path):
    data = {"nq": {"style": "Only the name.", "stop_instruction": "Stop.", "knowledge_instruction": "Look.", "examples": [{"question": f"q{k}", "answer": f"a{k}"} for k in range(7)]}}
    (tmp_path / "e.json").write_text(json.dumps(data))
    (tmp_path / "e.yaml").write_text(json.dumps(data))  # JSON is YAML
    own = prompts.load_examples(str(tmp_path / "e.json"))["nq"]
    assert own == prompts.load_examples(f"file://{tmp_path}/e.yaml")["nq"]
    for kind, n in {"fewshot_1": 1, "fewshot_3": 3, "fewshot": 5, "concise": 0}.items():
        text = made(spark, "why {context}?", "so {question}", kind=kind, dataset=own)
        assert text.count("Q: ") == text.count("A: ") == n and ("Examples:\nQ: q0\nA: a0" in text) == (n > 0) and "Question: why {context}?" in text and "\nso {question}\n" in text
        assert (n > 0) == ("Only the name. Stop. If" in text) == ("own knowledge. Look.\n" in text)
    assert "Q: x\nA: y\n\nQuestion" in made(spark, "why?", kind="fewshot", examples=[("x", "y")])
    with pytest.raises(FileNotFoundError):
        prompts.load_examples(str(tmp_path / "none.json"))
