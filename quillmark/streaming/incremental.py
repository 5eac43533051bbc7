"""Incremental work as structured streams.

Each is a function from a stream to a started query that takes what is there and ends; checkpoints make a restart go on where it stopped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillmark.operators.chunking import chunk
from quillmark.sources.stores import Cache


def build_corpus(docs: DataFrame, path: str, checkpoint: str, name: str = "recursive", size: int = 512, overlap: int = 50) -> StreamingQuery:
    """Appends the chunks of arriving documents (id, text)."""
    return chunk(docs, name, size, overlap).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def fill_cache(rows: DataFrame, cache: Cache, checkpoint: str) -> StreamingQuery:
    """Puts arriving rows whose keys are new. A batch that is tried again adds nothing."""
    return rows.writeStream.foreachBatch(lambda batch, _: cache.put(batch)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def save_results(results: DataFrame, path: str, checkpoint: str, key: str = "idx", ts: str | None = None, delay: str = "1 day") -> StreamingQuery:
    """Appends arriving results, the first of each key. With an event time, keys are remembered for ``delay`` only."""
    first = results.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key]) if ts else results.dropDuplicates([key])
    return first.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def running_best(trials: DataFrame, checkpoint: str, table: str, by: str = "model", value: str = "value") -> StreamingQuery:
    """Keeps (by, best, n) up to date in a memory table, for a notebook over one study; ``best.keep_best`` forgets and writes a table."""
    best = trials.groupBy(by).agg(F.max(value).alias("best"), F.count("*").alias("n"))
    return best.writeStream.outputMode("complete").format("memory").queryName(table).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def tumbling(events: DataFrame, ts: str, by: str, value: str, width: str = "1 day", late: str | None = None) -> DataFrame:
    """(window_start, by, n, total): of a stream with a watermark of ``late``, or of a table."""
    rows = events.withWatermark(ts, late) if late else events
    out = rows.groupBy(F.window(ts, width), by).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("window.start").alias("window_start"), by, "n", "total")


def sessions(events: DataFrame, ts: str, by: str, gap: str = "30 minutes", late: str | None = None) -> DataFrame:
    """(by, session_start, n): events less than a gap apart."""
    rows = events.withWatermark(ts, late) if late else events
    out = rows.groupBy(F.session_window(ts, gap), by).agg(F.count("*").alias("n"))
    return out.select(by, F.col("session_window.start").alias("session_start"), "n")
