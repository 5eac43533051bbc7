"""Running best of arriving trials by keyed state with timers.

Each key's state is its best value, the trial that reached it, how many it has seen and when the last one came. A key for which nothing came for ``keep`` of event
time is dropped by its timer. Only keys that change give rows (update mode); they go to a table, a folder for each micro-batch, which a batch that is tried
again overwrites. ``latest`` reads the last row of each key.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from quillmark.session import exists

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_STATE = "best double, trial string, n long, seen long"
_OUT = "key string, best double, trial string, n long, seen timestamp, dropped boolean"


class Best(StatefulProcessor):
    """Rows (key, value, trial, ts) to (key, best, trial, n, seen, dropped): the largest value, ties to the smaller trial."""

    def __init__(self, keep_ms: int):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("best", _STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        best, trial, n, seen = self.state.get() if self.state.exists() else (None, None, 0, 0)
        for part in rows:
            part = part.dropna(subset=["value", "ts"])
            if part.empty:
                continue
            top = part.sort_values(["value", "trial"], ascending=[False, True]).iloc[0]
            if best is None or (-top["value"], top["trial"]) < (-best, trial):
                best, trial = float(top["value"]), str(top["trial"])
            n, seen = n + len(part), max(seen, int(part["ts"].max().timestamp() * 1000))
        if best is None:
            return
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(seen + self.keep_ms)
        self.state.update((best, trial, n, seen))
        yield self._row(key, best, trial, n, seen, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if self.state.exists():
            best, trial, n, seen = self.state.get()
            self.state.clear()
            yield self._row(key, best, trial, n, seen, True)

    def _row(self, key, best: float, trial: str, n: int, seen: int, dropped: bool) -> pd.DataFrame:
        return pd.DataFrame({"key": [str(key[0])], "best": [best], "trial": [trial], "n": [n], "seen": [pd.Timestamp(seen, unit="ms")], "dropped": [dropped]})

    def close(self) -> None:
        return


def updates(trials: DataFrame, by: str = "model", value: str = "value", trial: str = "trial", ts: str = "ts", late: str = "1 hour", keep_ms: int = 86_400_000) -> DataFrame:
    """The stream of changed rows (key, best, trial, n, seen, dropped) of a stream of trials. Rows without a value or a time count for nothing; a null key is the key 'None'.
    A key that comes again after it was dropped begins anew."""
    trials.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    rows = trials.select(F.coalesce(F.col(by).cast("string"), F.lit("None")).alias("key"), F.col(value).cast("double").alias("value"), F.col(trial).cast("string").alias("trial"), F.col(ts).alias("ts")).withWatermark("ts", late)
    return rows.groupBy("key").transformWithStateInPandas(statefulProcessor=Best(keep_ms), outputStructType=_OUT, outputMode="Update", timeMode="EventTime")


def keep_best(trials: DataFrame, path: str, checkpoint: str, **options) -> StreamingQuery:
    """Starts a stream of trials into the table of changes at ``path``, which takes what is there and ends. options: as of ``updates``."""

    def put(batch: DataFrame, number: int) -> None:
        batch.coalesce(1).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return updates(trials, **options).writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark: SparkSession, path: str) -> DataFrame:
    """(key, best, trial, n, seen, dropped): the last change of each key; none if nothing has come."""
    if not exists(spark, path):
        return spark.createDataFrame([], _OUT)
    rows = spark.read.schema(f"{_OUT}, batch long").parquet(path)
    return rows.groupBy("key").agg(F.max_by(F.struct("best", "trial", "n", "seen", "dropped"), F.struct("batch", "n", F.col("dropped").cast("int"))).alias("r")).select("key", "r.*")
