"""Packing token sequences by harmonic classes.

A class holds the lengths in (capacity / (k + 1), capacity / k]; its bins take exactly k pieces,
so workers fill bins without knowing of each other. Documents are cut so that pieces fill their
slot, capacity / k, to fifteen sixteenths at least: full sequences first, then, while what is left fills its
slot worse, a head of exactly the next smaller slot. Pieces are dealt to buckets of about
``bucket_rows`` by hash; in each bucket every class fills its bins, and the pieces that would
leave a bin incomplete (fewer than k for each class) go, longest first, where they fit.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import lru_cache
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.llm.common import Scratch, did, text_hash, undid

CAPACITY, END_ID, TOLERANCE = 2048, 1, 16


def _byte_alphabet() -> dict[str, int]:
    """The characters that stand for bytes in a byte-level vocabulary: printable ones for themselves,
    the others, in order, for the characters from 256 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


@lru_cache(maxsize=2)
def encoder(path: str) -> tiktoken.Encoding:
    """The byte-level vocabulary of a tokenizer file, for the fast encoder; ids are those of the file.
    Strings of the file's added tokens are those tokens."""
    import public_tokenizers

    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    special = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
    alphabet = _byte_alphabet()
    ranks = {bytes(alphabet[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
    return tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def cut(n: int, capacity: int = CAPACITY, tolerance: int = TOLERANCE) -> list[int]:
    """Lengths of the pieces of a document of n ids."""
    pieces, rest = [capacity] * (n // capacity), n % capacity
    while rest:
        k = capacity // rest
        slot = capacity // k
        if (slot - rest) * tolerance <= slot or k >= tolerance:
            pieces.append(rest)
            break
        pieces.append(capacity // (k + 1))
        rest -= pieces[-1]
    return pieces


def _pieces(path: str | None, capacity: int, tolerance: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = encoder(path or default_tokenizer())
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            for i, tag, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                ids = np.append(tokens.encode_to_numpy(text.as_py() or "", allowed_special="all"), END_ID).astype("<u4")
                start = 0
                for length in cut(len(ids), capacity, tolerance):
                    piece = ids[start : start + length]
                    for column, value in zip(out, (i, tag, start, length, zlib.crc32(piece.tobytes()), len(ids), piece.astype(np.int32) if with_ids else None), strict=True):
                        column.append(value)
                    start += length
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()))
            names = ("did", "tag", "start", "length", "ids_crc32", "doc_tokens", "ids")
            n = len(names) - (not with_ids)
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out[:n], kinds[:n], strict=True)], names=list(names[:n]))

    return run


def place(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Bins and offsets in them of the pieces of one bucket, by harmonic classes in the given order."""
    bins, offsets, made = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), 0
    rest: list[int] = []
    for k in np.unique(capacity // lengths) if len(lengths) else ():
        own = np.flatnonzero(capacity // lengths == k)
        whole = len(own) // k * k
        grid = own[:whole].reshape(-1, k)
        bins[grid] = made + np.arange(len(grid))[:, None]
        offsets[grid] = np.cumsum(lengths[grid], axis=1) - lengths[grid]
        made += len(grid)
        rest += own[whole:].tolist()
    used = np.zeros(len(rest), np.int64)
    top = 0
    for x in sorted(rest, key=lambda x: (-lengths[x], x)):
        fits = np.flatnonzero(used[:top] + lengths[x] <= capacity)
        at = int(fits[0]) if len(fits) else top
        top = max(top, at + 1)
        bins[x], offsets[x] = made + at, used[at]
        used[at] += lengths[x]
    return bins, offsets


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, tolerance: int = TOLERANCE, bucket_rows: int = 2000, with_ids: bool = False) -> DataFrame:
    """(did, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids]) of each piece.

    A document's ids are those of its text (null: none) and then END_ID. tokenizer: a
    byte-level BPE file, on each machine; by default the installed public one. Each id lies in one piece; sequences hold
    capacity ids at most. Repeated rows are packed each, as are rows without an id; an empty text is its end id. An empty table gives an empty result. Reruns give the same result."""
    scratch = Scratch(docs.sparkSession, "packing")
    rows = docs.select(did().alias("did"), text_hash().alias("tag"), F.col("text").cast("string").alias("text"))
    ids = ", ids array<int>" if with_ids else ""
    pieces = scratch.put(rows.mapInArrow(_pieces(tokenizer, capacity, tolerance, with_ids), f"did long, tag long, start long, length long, ids_crc32 long, doc_tokens long{ids}"), "pieces")
    buckets = max(1, ceil(pieces.count() / bucket_rows))
    light = pieces.select("did", "tag", "start", "length", "ids_crc32", "doc_tokens", *(["ids"] if with_ids else []), F.pmod(F.xxhash64("did", "tag", "start"), F.lit(buckets)).alias("bucket"))

    def fill(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["did", "tag", "start"], kind="stable")
        bins, offsets = place(group["length"].to_numpy(), capacity)
        return group.assign(sequence_id=group["bucket"].to_numpy() * (1 << 24) + bins, offset=offsets).drop(columns=["bucket", "tag"])

    return light.groupBy("bucket").applyInPandas(fill, f"did long, start long, length long, ids_crc32 long, doc_tokens long{ids}, sequence_id long, offset long")


def op7(docs: DataFrame) -> DataFrame:
    """Each piece of each document and its place."""
    return pack(docs).select(undid().alias("doc_id"), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
