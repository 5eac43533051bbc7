"""A corpus pipeline of five stages, each an operator of this subpackage.

Every stage reads what the one before it wrote, all of it, and hands documents on; the last
gives packed pieces instead.

1. language: documents go that have no letter, or whose language is told with a score under one half.
2. lines: later occurrences of three-line windows are cut out of the texts.
3. near_duplicates: of each group of texts whose five-word shingles have a similarity of 0.8, as SimHash
   tells it, the document with the smallest id stays.
4. mix: documents as the mix takes them, sources weighing 5, 2, 1, repeating.
5. pack: pieces of token sequences of 2048.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillmark.llm import language, lines, mixing, packing, simhash
from quillmark.llm.common import Scratch


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs whose text is in a language that is told with a score of one half at least; null texts and texts without letters go. Rows
    without an id and rows that share one stay as they are. No rows, no result."""
    return language.documents_with_language(docs)


def cut_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs, all of them, without later occurrences of three consecutive lines; a null text stays null, a text that loses all its lines is
    empty. Rows alike in id and text don't cut each other. No rows, no result."""
    return lines.documents_without_repeats(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar texts, that of the smallest id, null last. Null and empty texts are one group. Rows that share
    an id stay if their texts are of different groups; rows alike in id and text are one. No rows, no result."""
    return simhash.deduplicate(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs as the mix takes them, a row for each time that blocks of a document are taken; documents without words are not taken. A null source
    is a source. No rows, no result."""
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 ids, as of op7: every row of docs, repeats included, null and empty texts as their end id. No rows, no result."""
    return packing.op7(docs)


STAGES = [
    ("language", keep_languages),
    ("lines", cut_repeated_lines),
    ("near_duplicates", drop_near_duplicates),
    ("mix", mix_sources),
    ("pack", pack_sequences),
]

#: SQL expresses neither the network, the fingerprints, the draws nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, over the whole documents table of sf_dir."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch.put(stage(spark, docs, sf_dir), name)
    return docs
