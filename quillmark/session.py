"""What operators need from the session: the folder that all machines share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that all machines of the cluster share (``spark.checkpoint.dir``), set as the checkpoint folder, too.

    Where the session names none a local master, as in tests, gets a temporary folder; a cluster gets an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _own:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        _own[app] = "file://" + tempfile.mkdtemp(prefix="quillmark-")
        spark.sparkContext.setCheckpointDir(_own[app])
    return _own[app]


ensure_checkpoints = shared_dir


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def new_folder(spark: SparkSession, name: str) -> str:
    """A new folder under the shared one for the tables of a job; it goes when the driver's Python ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def end() -> None:
        try:
            delete(spark, path)
        except Exception:  # the session has ended: whoever owns the folder clears it
            return

    atexit.register(end)
    return path


def stored(df: DataFrame, path: str, *partition_by: str) -> DataFrame:
    """df written as Parquet and read again, so that what follows starts from the table."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(rows: DataFrame) -> DataFrame:
    """rows in as many partitions as the cluster has cores at least. A file of one row group is one task however large its texts are; a table of many files stays as it is.

    Rows are dealt by hash of all their columns: for a deal without a key Spark sorts all rows of a task first, texts and all, and its memory grows with the file. Rows alike in all columns meet in one task."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    if rows.isStreaming or rows.rdd.getNumPartitions() >= cores:
        return rows
    return rows.withColumn("_dealt", F.xxhash64(*rows.columns)).repartition(cores, "_dealt").drop("_dealt")
