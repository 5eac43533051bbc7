"""An index of arriving documents: chunks, vectors and lists of a micro-batch are committed together.

A batch is one folder of the index's table, named by the batch's number. A batch that is tried again overwrites its own folder, so no row is there twice, and
one that failed midway has no finished folder, which readers and later batches pass over. The quantiser is learnt from the first batch that holds a vector and is
complete or absent, too.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillmark.operators import inverted
from quillmark.operators.chunking import chunk
from quillmark.session import exists, new_folder, stored


def index_batch(index: inverted.Inverted, docs: DataFrame, batch: int, embed: Callable[[Column], Column], lists: int | None = None, subs: int = 0, total: int | None = None, name: str = "recursive", size: int = 512, overlap: int = 50) -> None:
    """Chunks, embeds and assigns documents (id, text) as the batch of that number, in place of what an earlier try left. A chunk's row has its id, text, vector, and list or code."""
    pieces = chunk(docs, name, size, overlap)
    made = pieces.select(F.xxhash64("chunk_id").alias("doc_id"), "chunk_id", "parent_id", "text", embed(F.col("text")).alias("embedding"))
    made = stored(made, new_folder(index.spark, "embedded"))  # the model runs once
    whole = made.filter(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & ~F.exists("embedding", lambda x: x.isNull()))
    rows = whole.select("doc_id", inverted.unit(F.col("embedding")).alias("v"), "chunk_id", "parent_id", "text", "embedding")
    if not exists(index.spark, f"{index.path}/centres/_SUCCESS"):
        if rows.isEmpty():
            return
        inverted.train(rows.select("doc_id", "v"), index.path, lists, subs, total)
    inverted.add_batch(index, rows, batch)


def build_index(docs: DataFrame, path: str, checkpoint: str, embed: Callable[[Column], Column], **options) -> StreamingQuery:
    """Starts a stream of documents (id, text) into the index at ``path``, which takes what is there and ends. embed: a pandas UDF from text to a vector. options: as of ``index_batch``."""
    index = inverted.Inverted(docs.sparkSession, path)
    run = lambda batch, number: index_batch(index, batch, number, embed, **options)
    return docs.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
