"""What the training-data operators share: row keys, shared scratch tables, word rules.

Row keys. ``doc_id`` may be null or repeated. Operators work on ``did``, the id with null
replaced by the largest long (a null id sorts last), and tell rows that share an id apart by
``th``, the 64-bit hash of the text. Rows alike in both are interchangeable.

Extra columns. Operators select what they need by name first, so a column of any other name
in the input cannot clash with theirs; those that hand documents on rejoin them by key.
"""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.session import shared_dir

#: Words are the maximal runs of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
#: Stands for a null id.
NO_ID = 2**63 - 1

#: Spark's setting by which a query's shuffle files go when it ends.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scratch:
    """Intermediate tables, written as Parquet into the shared folder.

    Writing a table cuts the lineage and survives the loss of executors. ``drop`` deletes a
    table that nothing lazy needs any more; the rest goes when the driver's Python ends, unless a folder to keep is given."""

    def __init__(self, spark: SparkSession, name: str, folder: str | None = None):
        self.spark = spark
        self.root = folder or f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        if not folder:
            atexit.register(self._end)

    def put(self, df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
        path = f"{self.root}/{name}"
        writer = df.write.mode("overwrite")
        before = self.spark.conf.get(_CLEAN, "false")
        self.spark.conf.set(_CLEAN, "true")  # a table needs the shuffles it came from no more
        try:
            (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
        finally:
            self.spark.conf.set(_CLEAN, before)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            self._delete(f"{self.root}/{name}")

    def names(self) -> list[str]:
        """The finished tables in the folder."""
        jvm = self.spark._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.root)
        system = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        done = lambda p: system.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))
        return sorted(s.getPath().getName() for s in system.listStatus(root) if s.isDirectory() and done(s.getPath())) if system.exists(root) else []

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}")

    def _delete(self, path: str) -> None:
        jvm = self.spark._jvm
        hadoop = jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(hadoop, True)

    def _end(self) -> None:
        try:
            self._delete(self.root)
        except Exception:  # the session has ended: whoever owns the folder clears it
            return


def did(column: str = "doc_id") -> Column:
    return F.coalesce(F.col(column).cast("long"), F.lit(NO_ID))


def text_hash() -> Column:
    """64 bits of a row's text; tells rows of one id, or of none, apart."""
    return F.xxhash64(F.col("text").cast("string"))


def undid(column: str = "did") -> Column:
    return F.nullif(F.col(column), F.lit(NO_ID))


def others(docs: DataFrame) -> Column:
    """The columns of docs but its text, as a struct, so that the text crosses a shuffle once."""
    return F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text"))


def n_words(text: Column) -> Column:
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1))), F.lit(0)).cast("long")
