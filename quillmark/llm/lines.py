"""Line deduplication by overlapping windows of three lines.

Lines are what stands between line feeds. Each three consecutive lines of a text are hashed
together; a window whose hash occurs before it in the corpus, in the order of (id, text hash,
position), is a later occurrence. The lines of all later occurrences of a text, merged, go.
The first occurrence is a minimum, so it is reduced on each machine before the shuffle, and the
reduced rows are written before they are joined back, so that both sides of the join are plain shuffles,
whose large partitions Spark splits. Texts meet what is cut from them in a merge join at every size, never by a
broadcast of a table that grows with the corpus.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmark.llm.common import Scratch, did, others, text_hash

WINDOW = 3


def later_windows(docs: DataFrame, scratch: Scratch, window: int = WINDOW) -> DataFrame:
    """(did, tag, starts): the first lines of a row's windows that occur before it. docs: (did, tag, text)."""
    lines = F.split("text", "\n")
    first = F.sequence(F.lit(0), F.size("lines") - window)
    hashed = F.transform(first, lambda i: F.unhex(F.md5(F.array_join(F.slice("lines", i + 1, window), "\n"))))
    windows = docs.select("did", "tag", lines.alias("lines")).filter(F.size("lines") >= window).select("did", "tag", F.posexplode(hashed).alias("at", "h"))
    place = F.struct("did", "tag", "at")
    least = windows.groupBy("h").agg(F.min(place).alias("least"), F.count("*").alias("n")).filter("n > 1").select("h", "least")
    return windows.join(scratch.put(least, "least"), "h").filter(place > F.col("least")).groupBy("did", "tag").agg(F.collect_set("at").alias("starts"))


def kept_lines(text: str | None, starts: list[int] | None, window: int = WINDOW) -> tuple[str | None, int, int]:
    """The text without the lines of the windows, its number of lines, and how many went."""
    if text is None:
        return None, 0, 0
    lines = text.split("\n")
    if not starts:
        return text, len(lines), 0
    gone = np.zeros(len(lines), bool)
    for k in range(window):
        gone[np.array(starts) + k] = True
    return "\n".join(x for x, g in zip(lines, gone.tolist(), strict=True) if not g), len(lines), int(gone.sum())


def _kept(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [kept_lines(t.as_py(), s.as_py(), window) for t, s in zip(batch.column(1), batch.column(2), strict=True)]
            columns = [batch.column(0), *(pa.array([x[k] for x in done], kind) for k, kind in enumerate((pa.string(), pa.int64(), pa.int64())))]
            yield pa.RecordBatch.from_arrays(columns, names=["row", "text", "n_lines", "n_removed"])

    return run


def deduplicate(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(row, text, n_lines, n_removed): the other columns of each row of docs as a struct, its text without later occurrences
    of windows, and counts of lines.

    A null text stays null and has no lines; texts of fewer than three lines have no window and stay as they are.
    Rows alike in id and text count as one place, so they do not remove each other. A null id
    sorts last. An empty table gives an empty result."""
    scratch = Scratch(docs.sparkSession, "lines")
    rows = docs.select(others(docs).alias("row"), did().alias("did"), text_hash().alias("tag"), F.col("text").cast("string").alias("text"))
    starts = scratch.put(later_windows(rows.select("did", "tag", "text"), scratch, window), "starts")
    schema = T.StructType([T.StructField("row", rows.schema["row"].dataType), T.StructField("text", T.StringType()), T.StructField("n_lines", T.LongType()), T.StructField("n_removed", T.LongType())])
    return rows.join(starts.hint("merge"), ["did", "tag"], "left").select("row", "text", "starts").mapInArrow(_kept(window), schema)


def documents_without_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs, same columns and rows, with later occurrences of line windows cut out of text; n_chars, if
    there is one, counts what is left. Rows that lose all their lines stay, with an empty text."""
    done = deduplicate(docs, window)
    left = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("row.n_chars")) if "n_chars" in docs.columns else None
    new = {"text": F.col("text"), "n_chars": left}
    return done.select(*(new[c].alias(c) if c in new else F.col(f"row.`{c}`").alias(c) for c in docs.columns))


def op10(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed and kept_sha256 (of the text that stays) of each row."""
    done = deduplicate(docs.select("doc_id", "text"))
    return done.select("row.doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


OP10_SQL = r"""
WITH l AS (
  SELECT doc_id, CASE WHEN text IS NULL THEN [] ELSE string_split(text, chr(10)) END AS lines FROM documents
), starts AS (
  SELECT doc_id, lines, unnest(range(1, len(lines) - 1)) AS beg FROM l WHERE len(lines) >= 3
), windows AS (
  SELECT doc_id, beg, array_to_string(lines[beg:beg + 2], chr(10)) AS seq FROM starts
), ranked AS (
  SELECT doc_id, beg, row_number() OVER (PARTITION BY seq ORDER BY doc_id, beg) AS rn FROM windows
), gone AS (
  SELECT doc_id, list(DISTINCT beg + k) AS gone FROM ranked, (SELECT unnest([0, 1, 2]) AS k) WHERE rn > 1 GROUP BY doc_id
)
SELECT l.doc_id, CAST(len(lines) AS BIGINT) AS n_lines, CAST(coalesce(len(g.gone), 0) AS BIGINT) AS n_removed,
  sha256(CASE WHEN g.gone IS NULL THEN array_to_string(lines, chr(10))
    ELSE coalesce(array_to_string(list_transform(list_filter(list_zip(lines, range(1, len(lines) + 1)), lambda z: NOT list_contains(g.gone, z[2])), lambda z: z[1]), chr(10)), '') END) AS kept_sha256
FROM l LEFT JOIN gone g USING (doc_id)
"""
