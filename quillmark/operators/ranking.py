"""Ranks, top rows and their merges.

Scores are rounded to ``DIGITS`` decimals before they are ranked and ties go to the smaller id, so that the order of
additions on a cluster changes no result. ``row_number() <= k`` is cut to k rows for each key before the shuffle
(WindowGroupLimit), so a hot key ships k rows a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark.session import new_folder, stored

DIGITS = 9


def best(rows: DataFrame, by: list[str], order: list[Column], k: int, name: str = "rank", base: int = 1) -> DataFrame:
    """The first k rows of each key in the order, with their rank from base."""
    w = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= k).withColumn(name, F.col(name) - F.lit(1 - base))


def top(hits: DataFrame, k: int, query: str = "query_id", doc: str = "doc_id", base: int = 0) -> DataFrame:
    """The k best scores of each query, ranked."""
    return best(hits.withColumn("score", F.round("score", DIGITS)), [query], [F.desc("score"), F.asc(doc)], k, base=base)


def with_ties(rows: DataFrame, score: str, k: int) -> DataFrame:
    """Rows that are not under the k-th best score."""
    cut = rows.select(score).filter(F.col(score).isNotNull()).orderBy(F.desc(score)).limit(k).agg(F.min(score).alias("cut"))
    return rows.join(F.broadcast(cut), rows[score] >= F.col("cut")).drop("cut")  # one row


def best_by(rows: DataFrame, metric: str, n: int, where: Column | None = None, tie: str = "id") -> DataFrame:
    rows = rows if where is None else rows.filter(where)
    return rows.orderBy(F.desc_nulls_last(metric), F.asc(tie)).limit(n)


def ranked_columns(rows: DataFrame, columns: list[str], parts: int | None = None) -> DataFrame:
    """(column, value, n, rank): each distinct value of the columns, how often it occurs, and its average rank among all rows. A null is no value.

    Values are counted first, all columns in one pass, so a frequent one is a row. The counts are dealt out by ranges of their order and written; what lies before a range is a sum over one row a range."""
    parts = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    each = F.explode(F.array(*(F.struct(F.lit(i).alias("at"), F.col(c).cast("double").alias("value")) for i, c in enumerate(columns))))
    counts = rows.select(each.alias("c")).select("c.*").filter("value is not null").groupBy("at", "value").agg(F.count("*").alias("n"))
    dealt = counts.repartitionByRange(parts, "at", "value").sortWithinPartitions("at", "value").withColumn("range", F.spark_partition_id())
    order = stored(dealt, new_folder(rows.sparkSession, "ranks"))
    sums = order.groupBy("at", "range").agg(F.sum("n").alias("all"))
    before = sums.select("at", "range", (F.sum("all").over(Window.partitionBy("at").orderBy("range")) - F.col("all")).alias("before"))
    upto = F.sum("n").over(Window.partitionBy("at", "range").orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    name = F.element_at(F.array(*map(F.lit, columns)), F.col("at") + 1)
    ranked = order.withColumn("upto", upto).join(F.broadcast(before), ["at", "range"])  # a row for each range and column
    return ranked.select(name.alias("column"), "value", "n", (F.col("before") + F.col("upto") - (F.col("n") - 1) / 2.0).alias("rank"))


def ranked_values(rows: DataFrame, column: str, parts: int | None = None) -> DataFrame:
    """(column, rank): each value's average rank among all rows."""
    return ranked_columns(rows, [column], parts).select(F.col("value").alias(column), "rank")


def average_rank(value: Column, by: list[Column | str]) -> Column:
    """Ascending rank, from 1, ties sharing the mean of their ranks."""
    keys = list(by)
    return F.rank().over(Window.partitionBy(*keys).orderBy(value)) + (F.count("*").over(Window.partitionBy(*keys, value)) - 1) / 2.0
