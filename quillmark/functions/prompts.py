"""Prompts as Column expressions: layouts with slots for instruction, examples, passages, question and rules.

A layout is a text with slots. What a prompt's type says is a row of the table below; a slot that stays empty takes its paragraph with it.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Style:
    """What a type asks for (style, stop), what it says of the passages (knowledge), the layout it takes with passages, and how many examples it shows."""

    style: str = ""
    stop: str = ""
    knowledge: str = ""
    layout: str = "passages"
    examples: int = 0


# What the types of prompts ask for.
STYLES = {
    "default": Style("Give only the answer, no explanations.", knowledge="Read the passages carefully to find the answer."),
    "concise": Style("Reply with just the answer.", knowledge="The answer can be found in the passages."),
    "concise_strict": Style(
        "Give ONLY the answer - a single word, name, date, or short phrase.",
        "STOP immediately after answering. Do NOT add explanations or follow-up questions.",
        "Find the answer in the passages.",
    ),
    "concise_json": Style('Reply with JSON: {"answer": "your answer here"}', knowledge="The answer can be found in the passages."),
    "structured": Style("Be concise.", layout="structured"),
    "extractive": Style("Extract the exact answer from the passages.", knowledge="Only use information from the passages.", layout="extractive"),
    "extractive_quoted": Style(
        "Copy the exact answer as it appears in the passages. Use quotation marks.",
        knowledge="The answer MUST appear verbatim in the passages. Quote it exactly.",
        layout="extractive",
    ),
    "cot": Style("Show your reasoning, then give a final answer.", layout="cot"),
    "cot_final": Style("Think step by step, then end with 'FINAL ANSWER: <your answer>'", layout="cot"),
    "cited": Style("Include passage citations [1], [2], etc.", layout="cited"),
    "fewshot": Style("Give a short, direct answer.", examples=5),
    "fewshot_1": Style("Give a short, direct answer.", examples=1),
    "fewshot_3": Style("Give a short, direct answer.", examples=3),
}

# The layouts.
UNKNOWN = "If you don't know, answer 'Unknown'."
LAYOUTS = {
    "direct": """Answer the question using your knowledge.

{examples}

Question: {question}

{rules}
Answer:""",
    "passages": """Answer the question using the retrieved passages below. If the passages don't contain the answer, you may use your own knowledge. {knowledge}

{examples}

Retrieved Passages:
{context}

Question: {question}

{rules}
Answer:""",
    "structured": """### Instruction
You are a helpful assistant that answers questions based on the provided context.
Read the context carefully and give a precise, concise answer.

### Context
{context}

### Question
{question}

### Requirements
- Answer based on the context above
- Be concise - give only the answer, no explanations
- If the answer is not in the context, say "Unknown"

### Answer
""",
    "extractive": """You are an extractive QA system. Your answer MUST be extracted directly from the given passages.
Do NOT use any knowledge outside of these passages.

---PASSAGES---
{context}
---END PASSAGES---

Question: {question}

Instructions:
1. Find the exact answer in the passages above
2. Copy the answer exactly as it appears
3. If the answer is NOT in the passages, respond with "Unknown"
4. Do NOT make up information or use external knowledge

Answer:""",
    "cot": """Answer the question by reasoning step-by-step through the provided passages.

Passages:
{context}

Question: {question}

Let's think through this step by step:
1. First, identify relevant information in the passages
2. Then, connect the facts to answer the question
3. Finally, give a concise final answer

Reasoning:""",
    "cited": """Answer the question using the numbered passages below. Include citation numbers in your answer.

{context}

Question: {question}

Instructions:
- Use [1], [2], etc. to cite which passage(s) support your answer
- Be concise but include the citation
- If no passage contains the answer, say "Unknown"

Answer:""",
}


def load_examples(path: str) -> dict[str, dict]:
    """What a file of examples says of each dataset: style, stop_instruction, knowledge_instruction, and examples with question and answer. JSON, or YAML where it can be read."""
    system, at = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    with system.open_input_stream(at) as f:
        text = f.read().decode()
    if path.endswith(".json"):
        return json.loads(text)
    try:
        import yaml
    except ImportError as e:
        raise ValueError("no reader of YAML here; give the examples as JSON") from e
    return yaml.safe_load(text) or {}


def style_of(kind: str, dataset: dict | None = None) -> Style:
    """The type's row; one that shows examples takes the dataset's texts where it has them. An unknown type asks for nothing."""
    own = STYLES.get(kind, Style())
    if not own.examples or not dataset:
        return own
    return Style(dataset.get("style", own.style), dataset.get("stop_instruction", ""), dataset.get("knowledge_instruction", ""), own.layout, own.examples)


def template(kind: str, passages: bool, dataset: dict | None = None, examples: list[tuple[str, str]] | None = None) -> str:
    """The type's layout, all but question and context filled in. examples: (question, answer), else the dataset's; as many as the type shows are taken."""
    style = style_of(kind, dataset)
    given = examples if examples is not None else [(e["question"], e["answer"]) for e in (dataset or {}).get("examples", [])]
    shown = "\n\n".join(f"Q: {q}\nA: {a}" for q, a in given[: style.examples])
    slots = {"examples": f"Examples:\n{shown}" if shown else "", "knowledge": style.knowledge, "rules": " ".join(x for x in (style.style, style.stop, UNKNOWN) if x)}
    text = LAYOUTS[style.layout if passages else "direct"]
    for name, value in slots.items():
        text = text.replace(f" {{{name}}}" if not value and name == "knowledge" else f"{{{name}}}\n\n" if not value else f"{{{name}}}", value)
    return text


def prompt(question: Column, context: Column | None = None, kind: str = "concise", examples: list[tuple[str, str]] | None = None, dataset: dict | None = None) -> Column:
    """The prompt of a question, with its passages if there are any to give."""
    parts = re.split(r"(\{question\}|\{context\})", template(kind, context is not None, dataset, examples))
    slots = {"{question}": question, "{context}": context}
    return F.concat(*(F.coalesce(slots[p], F.lit("")) if p in slots else F.lit(p) for p in parts))
