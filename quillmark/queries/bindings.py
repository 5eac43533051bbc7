"""How the catalogue's tables stand for the rows of an evaluation study, in Spark and in SQL.

results: orders with their customer and nation; scores: events as scores of questions; predictions: assistant turns with the user turns of their
conversation as references; documents, queries (benchmark) and vectors as they are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customer, nation = (read(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    rows = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.select(
        F.col("o_orderkey").alias("id"),
        F.col("c_mktsegment").alias("model"),
        F.col("o_orderpriority").alias("dataset"),
        F.when(F.col("o_orderstatus") == "F", "direct").otherwise("rag").alias("exp_type"),
        F.col("n_regionkey").cast("string").alias("retriever"),
        F.concat(F.lit("p"), (F.col("o_custkey") % 4).cast("string")).alias("prompt"),
        (F.col("o_orderkey") % 3).cast("int").alias("top_k"),
        (F.col("o_totalprice") / 500000).alias("f1"),
        (F.col("c_acctbal") / 10000).alias("em"),
        F.col("o_custkey").cast("double").alias("duration"),
    )


RESULTS = """results AS (
  SELECT o_orderkey AS id, c_mktsegment AS model, o_orderpriority AS dataset, CASE WHEN o_orderstatus = 'F' THEN 'direct' ELSE 'rag' END AS exp_type,
    CAST(n_regionkey AS VARCHAR) AS retriever, 'p' || CAST(o_custkey % 4 AS VARCHAR) AS prompt, CAST(o_orderkey % 3 AS INTEGER) AS top_k,
    o_totalprice / 500000 AS f1, c_acctbal / 10000 AS em, CAST(o_custkey AS DOUBLE) AS duration
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
)"""


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        F.col("user_id").alias("idx"),
        F.col("event_type").alias("dataset"),
        F.concat(F.lit("m"), (F.col("event_id") % 3).cast("string")).alias("model"),
        F.when(F.col("event_id") % 4 == 0, "direct").otherwise("rag").alias("exp_type"),
        F.least(F.lit(1.0), F.col("value") / 100).alias("f1"),
    )


SCORES = """scores AS (
  SELECT event_id AS id, user_id AS idx, event_type AS dataset, 'm' || CAST(event_id % 3 AS VARCHAR) AS model,
    CASE WHEN event_id % 4 = 0 THEN 'direct' ELSE 'rag' END AS exp_type, least(1.0::DOUBLE, value / 100) AS f1
  FROM events
)"""


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of scored experiments: whether the context had the answer, and whether it was given."""
    rows = scores(spark, sf_dir)
    return rows.select("id", "idx", "dataset", F.col("model").alias("retriever"), F.concat_ws("-", "dataset", "model").alias("experiment"), (F.col("idx") % 2 == 0).alias("in_context"), (F.col("f1") >= 0.5).alias("correct"), "f1", (F.col("id") % 7 + 1).cast("int").alias("retrieval_rank"), (F.col("id") % 5 + 1).cast("int").alias("rank"))


ITEMS = (
    SCORES
    + """, items AS (
  SELECT id, idx, dataset, model AS retriever, dataset || '-' || model AS experiment, idx % 2 = 0 AS in_context, f1 >= 0.5 AS correct, f1,
    CAST(id % 7 + 1 AS INTEGER) AS retrieval_rank, CAST(id % 5 + 1 AS INTEGER) AS rank
  FROM scores
)"""
)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", "text")


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")


def query_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors of the benchmark's item ids."""
    items_ = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"))
    return vectors(spark, sf_dir).join(items_, F.col("doc_id") == F.col("query_id")).select("query_id", "embedding")


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pred_id, prediction, references, contexts): contexts are the other assistant turns of the conversation."""
    turns = read(spark, sf_dir, "conversations")
    said = turns.groupBy("conv_id").agg(
        F.transform(F.sort_array(F.collect_list(F.when(F.col("role") == "user", F.struct("turn", "text")))), lambda t: t["text"]).alias("references"),
        F.transform(F.sort_array(F.collect_list(F.when(F.col("role") == "assistant", F.struct("turn", "text")))), lambda t: t["text"]).alias("answers"),
    )
    own = turns.filter("role = 'assistant'").select("conv_id", "turn", F.col("text").alias("prediction"))
    return own.join(said, "conv_id").select((F.col("conv_id") * 1000 + F.col("turn")).alias("pred_id"), "prediction", "references", F.filter("answers", lambda a: a != F.col("prediction")).alias("contexts"))


PREDICTIONS = """said AS (
  SELECT conv_id, coalesce(list(text ORDER BY turn, text) FILTER (role = 'user'), []) AS refs, coalesce(list(text ORDER BY turn, text) FILTER (role = 'assistant'), []) AS answers FROM conversations GROUP BY conv_id
), predictions AS (
  SELECT c.conv_id * 1000 + c.turn AS pred_id, c.text AS prediction, s.refs, list_filter(s.answers, lambda a: a <> c.text) AS contexts
  FROM conversations c JOIN said s USING (conv_id) WHERE c.role = 'assistant'
)"""


def rounded(df: DataFrame, digits: int = 9) -> DataFrame:
    """Doubles rounded, so that the order of additions does not show."""
    return df.select(*(F.round(F.col(f"`{c}`"), digits).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes))


def sql(body: str, *doubles: str, digits: int = 9) -> str:
    """body with its double columns rounded alike."""
    if not doubles:
        return body
    return f"SELECT * REPLACE ({', '.join(f'round({d}, {digits}) + 0.0 AS {d}' for d in doubles)}) FROM ({body})"
