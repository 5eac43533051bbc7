"""Indexes and caches as tables in a folder, and a catalog of them.

An index is one Parquet table for each part; files are its shards. A cache is partitioned by its first key, and a put adds what is not there yet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.functions.text import text_hash
from quillmark.operators.sparse import Postings, parts_of
from quillmark.session import new_folder, stored


def save_dense(index: DataFrame, path: str, shards: int | None = None) -> None:
    (index.repartition(shards, "doc_id") if shards else index).write.mode("overwrite").parquet(f"{path}/vectors")


def load_dense(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("doc_id long, v array<double>").parquet(f"{path}/vectors")


def save_sparse(index: Postings, path: str) -> None:
    """Postings sorted by term in each file, so a search reads the row groups of its terms. An index that is not stored is counted once, into a table that all parts are read off."""
    if index.counted is not None:
        index = parts_of(stored(index.counted, new_folder(index.counted.sparkSession, "counted")))
    index.postings.repartition("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/postings")
    index.terms.write.mode("overwrite").parquet(f"{path}/terms")
    index.size.write.mode("overwrite").parquet(f"{path}/size")


def load_sparse(spark: SparkSession, path: str) -> Postings:
    return Postings(*(spark.read.parquet(f"{path}/{part}") for part in ("postings", "terms", "size")))


def save_hierarchical(families: DataFrame, vectors: DataFrame, path: str) -> None:
    """families (parent_id, parent_text, child_id, child_text) as parents and children; vectors (doc_id, parent_id, v)."""
    families.select("parent_id", "parent_text").distinct().write.mode("overwrite").parquet(f"{path}/parents")
    families.select("child_id", "parent_id", "child_text").write.mode("overwrite").parquet(f"{path}/children")
    vectors.write.mode("overwrite").parquet(f"{path}/vectors")


def load_hierarchical(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return tuple(spark.read.parquet(f"{path}/{part}") for part in ("parents", "children", "vectors"))


class Cache:
    """Rows under keys in a folder. get joins; put appends the rows whose keys are new; the first of repeated keys stays."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], schema: str):
        self.spark, self.path, self.keys, self.schema = spark, path, keys, schema

    def table(self) -> DataFrame:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(self.path)

    def get(self, asked: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Hits with their values, and misses."""
        return asked.join(self.table(), self.keys), asked.join(self.table().select(*self.keys), self.keys, "left_anti")

    def put(self, rows: DataFrame) -> None:
        new = rows.dropDuplicates(self.keys).join(self.table().select(*self.keys), self.keys, "left_anti")
        columns = self.spark.createDataFrame([], self.schema).columns
        new.select(*columns).write.mode("append").partitionBy(self.keys[0]).parquet(self.path)

    def stats(self, size: Column) -> DataFrame:
        return self.table().groupBy(self.keys[0]).agg(F.count("*").alias("entries"), F.sum(size.cast("long")).alias("bytes"))

    def clear(self, first_key: str | None = None) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path if first_key is None else f"{self.path}/{self.keys[0]}={first_key}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def embedding_cache(spark: SparkSession, path: str) -> Cache:
    return Cache(spark, path, ["model", "text_hash"], "text_hash string, embedding array<float>, model string")


def retrieval_cache(spark: SparkSession, path: str) -> Cache:
    """Results under (retriever, query hash, top_k); retriever names are those of fusion.cache_key."""
    return Cache(spark, path, ["retriever", "query_hash", "top_k"], "query_hash string, top_k int, results array<struct<doc_id:string,text:string,score:double,rank:int>>, retriever string")


#: A cached result in JSON.
RESULT = "array<struct<document:struct<id:string,text:string,metadata:map<string,string>,score:double>,score:double,rank:int>>"


def encoded(results: Column) -> Column:
    """Results of a query as JSON text, with fields that are null as such."""
    return F.to_json(results, {"ignoreNullFields": "false"})


def decoded(text: Column) -> Column:
    """The results of JSON text; null if it is none."""
    return F.from_json(text, RESULT)


def embed_missing(texts: DataFrame, cache: Cache, model: str, embed) -> DataFrame:
    """(text, embedding): from the cache, or by embed (a pandas UDF over text) for what it lacks, which is put there."""
    asked = texts.select("text").distinct().select(F.lit(model).alias("model"), text_hash(F.col("text")).alias("text_hash"), "text")
    _, misses = cache.get(asked)
    cache.put(misses.withColumn("embedding", embed(F.col("text"))))
    hits, _ = cache.get(asked)
    return texts.join(hits.select("text", "embedding"), "text")


def artifacts(spark: SparkSession, root: str) -> list[str]:
    """Names of the folders under root."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in fs.listStatus(path) if s.isDirectory()) if fs.exists(path) else []
