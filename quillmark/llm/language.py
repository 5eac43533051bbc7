"""Language identification by a byte convolutional network, trained in numpy.

A text's UTF-8 bytes are cut into windows of fixed length. Bytes are embedded, filters of several
widths slide over them, each filter keeps its maximum over the window, and a softmax layer gives
the languages' probabilities; a text's are the means over its windows, by their bytes. Filters of all widths are one matrix
(narrow ones padded with zeros), so a batch of windows is a single product.

The network is fitted on a bounded sample: ``sample_docs`` documents in all, the same number for each language, chosen
by hash of the id, and ``windows_a_doc`` windows spread over each. Prediction reads whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmark.llm.common import others

LENGTH, EMBEDDED, WIDTHS, FILTERS = 256, 6, (2, 3, 4), 12
UNKNOWN = "und"
MOST_LANGUAGES = 400


class ByteNet:
    """embedding (256, e), filters (widest * e, f), bias (f), out (f, languages), out_bias."""

    def __init__(self, languages: list[str], seed: int = 42):
        rng = np.random.default_rng(seed)
        wide, f = max(WIDTHS), FILTERS * len(WIDTHS)
        self.languages = languages
        self.mask = np.repeat(np.concatenate([np.repeat((np.arange(wide) < w)[:, None], FILTERS, axis=1) for w in WIDTHS], axis=1), EMBEDDED, axis=0).astype(np.float32)
        self.p = {
            "embedding": rng.normal(0, 0.5, (256, EMBEDDED)),
            "filters": rng.normal(0, 0.3, (wide * EMBEDDED, f)) * self.mask,
            "bias": np.zeros(f),
            "out": rng.normal(0, 0.2, (f, len(languages))),
            "out_bias": np.zeros(len(languages)),
        }
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def _patches(self, windows: np.ndarray) -> np.ndarray:
        """(n, positions, widest * e): the embedded bytes under the filters."""
        x = self.p["embedding"][windows].reshape(len(windows), -1)
        wide = max(WIDTHS) * EMBEDDED
        view = np.lib.stride_tricks.sliding_window_view(x, wide, axis=1)[:, ::EMBEDDED]
        return np.ascontiguousarray(view)

    def _softmax(self, z: np.ndarray) -> np.ndarray:
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def probabilities(self, windows: np.ndarray, step: int = 256) -> np.ndarray:
        """(n, languages) for windows (n, LENGTH) of bytes."""
        out = np.zeros((len(windows), len(self.languages)), np.float32)
        for k in range(0, len(windows), step):
            top = (self._patches(windows[k : k + step]) @ self.p["filters"]).max(axis=1) + self.p["bias"]
            out[k : k + step] = self._softmax(np.maximum(top, 0) @ self.p["out"] + self.p["out_bias"])
        return out

    def gradients(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the mean cross entropy of windows x of languages y."""
        patches = self._patches(x)
        z = patches @ self.p["filters"]
        at = z.argmax(axis=1)
        top = np.take_along_axis(z, at[:, None, :], axis=1)[:, 0] + self.p["bias"]
        hidden = np.maximum(top, 0)
        d = self._softmax(hidden @ self.p["out"] + self.p["out_bias"])
        d[np.arange(len(y)), y] -= 1
        d /= len(y)
        dh = (d @ self.p["out"].T) * (top > 0)
        seen = patches[np.arange(len(x))[:, None], at]  # (n, f, widest * e): the patch that each filter chose
        de = np.zeros_like(self.p["embedding"])
        back = (dh[:, :, None] * self.p["filters"].T[None]).reshape(len(x), -1, max(WIDTHS), EMBEDDED)
        under = x[np.arange(len(x))[:, None, None], at[:, :, None] + np.arange(max(WIDTHS))]
        np.add.at(de, under.reshape(-1), back.reshape(-1, EMBEDDED))
        return {"embedding": de, "filters": np.einsum("nfp,nf->pf", seen, dh) * self.mask, "bias": dh.sum(0), "out": hidden.T @ d, "out_bias": d.sum(0)}

    def fit(self, windows: np.ndarray, labels: np.ndarray, epochs: int = 12, least_steps: int = 400, size: int = 128, rate: float = 0.01, seed: int = 42) -> None:
        """Adam on the cross entropy. Half of the windows of an epoch are cut short, as short texts are."""
        rng = np.random.default_rng(seed)
        first, second = ({k: np.zeros_like(v) for k, v in self.p.items()} for _ in range(2))
        t = 0
        epochs = max(epochs, -(-least_steps * size // max(1, len(windows))))
        total = epochs * max(1, -(-len(windows) // size))
        for _ in range(epochs):
            order = rng.permutation(len(windows))
            for k in range(0, len(order), size):
                x, y = windows[order[k : k + size]].copy(), labels[order[k : k + size]]
                cut = np.where(rng.random(len(x)) < 0.5, rng.integers(8, LENGTH + 1, len(x)), LENGTH)
                x[np.arange(LENGTH)[None, :] >= cut[:, None]] = 0
                grads = self.gradients(x, y)
                t += 1
                for name, g in grads.items():
                    first[name] += 0.1 * (g - first[name])
                    second[name] += 0.001 * (g * g - second[name])
                    step = rate * (1 - t / total) * (first[name] / (1 - 0.9**t)) / (np.sqrt(second[name] / (1 - 0.999**t)) + 1e-8)
                    self.p[name] -= step.astype(np.float32)


def windows_of(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The windows of a whole text (n, LENGTH), the last padded with zeros, and the bytes in each."""
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    n = max(1, -(-len(raw) // LENGTH))
    out = np.zeros(n * LENGTH, np.uint8)
    out[: len(raw)] = raw
    return out.reshape(n, LENGTH), np.minimum(LENGTH, np.maximum(1, len(raw) - np.arange(n) * LENGTH))


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def _spread(windows_a_doc: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, rows = [], []
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if has_letter(text.as_py()):
                    own, _ = windows_of(text.as_py())
                    for k in np.unique(np.linspace(0, len(own) - 1, windows_a_doc).round().astype(int)):
                        langs.append(lang)
                        rows.append(own[k].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(rows, pa.binary())], names=["lang", "window"])

    return run


def train(labelled: DataFrame, sample_docs: int = 2400, windows_a_doc: int = 4, seed: int = 42) -> ByteNet | None:
    """A network fitted on (key, lang, text); None if no row has a language and a letter.

    The MOST_LANGUAGES most frequent languages are learned, so a column with stray values stops nothing; sample_docs bounds what reaches the driver."""
    rows = labelled.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MOST_LANGUAGES).collect()}
    if not counts:
        return None
    quota = max(1, sample_docs // len(counts))
    # A cut at a hash first: about twice the quota is left of each language, however large the table.
    cuts = F.create_map(*(F.lit(x) for lang, n in counts.items() for x in (lang, int(min(1.0, (2 * quota + 20) / n) * (1 << 30)))))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("key"), "key")
    few = rows.filter(F.element_at(cuts, F.col("lang")).isNotNull() & (F.pmod(F.xxhash64("key", F.lit("cut")), F.lit(1 << 30)) < F.element_at(cuts, F.col("lang"))))
    chosen = few.withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= quota)
    sample = chosen.select("lang", "text").mapInArrow(_spread(windows_a_doc), "lang string, window binary").collect()
    if not sample:
        return None
    sample.sort(key=lambda r: (r["lang"], bytes(r["window"])))
    seen = sorted({r["lang"] for r in sample})
    net = ByteNet(seen, seed)
    net.fit(np.frombuffer(b"".join(bytes(r["window"]) for r in sample), np.uint8).reshape(-1, LENGTH), np.array([seen.index(r["lang"]) for r in sample]), seed=seed)
    return net


def judge(net: ByteNet | None, texts: list[str | None]) -> tuple[list[str], list[float]]:
    """The language and score of each whole text."""
    langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
    if net is None:
        return langs, scores
    k = 0
    while k < len(texts):
        group, windows, weights, held = [], [], [], 0
        while k < len(texts) and held < 4096:
            if has_letter(texts[k]):
                w, n = windows_of(texts[k])
                group.append(k)
                windows.append(w)
                weights.append(n)
                held += len(w)
            k += 1
        if not group:
            continue
        p = net.probabilities(np.concatenate(windows)).astype(np.float64) * np.concatenate(weights)[:, None]
        starts = np.cumsum([0, *map(len, weights)])[:-1]
        mean = np.add.reduceat(p, starts, axis=0) / np.array([x.sum() for x in weights])[:, None]
        for i, row in zip(group, mean, strict=True):
            best = int(row.argmax())
            langs[i], scores[i] = net.languages[best], float(min(1.0, max(0.0, row[best])))
    return langs, scores


def _judged(net: ByteNet | None, keep_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 1000):
                part = batch.slice(k, 1000)
                langs, scores = judge(net, part.column(1).to_pylist())
                columns = {"row": part.column(0), **({"text": part.column(1)} if keep_text else {}), "lang_pred": pa.array(langs, pa.string()), "score": pa.array(scores, pa.float64())}
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return run


def _key():
    return F.col("doc_id").cast("string")


def identify(docs: DataFrame, keep_text: bool = False) -> DataFrame:
    """(row, lang_pred, score): the other columns of each row of docs as a struct, the language of its whole text and the
    network's mean probability for it; and text, if it is to be kept.

    Learns from text and non-null lang of the rows whose crc32(doc_id as text) mod 3 is not 1; rows of a null id are
    neither learned from nor held out. A null text, one without letters, and every text if
    there is nothing to learn from, get `und` and 0. Texts of any length are read whole, in windows. Repeated rows get equal results. An empty table gives an empty result."""
    learn = docs.filter(F.crc32(_key()) % 3 != 1).select(_key().alias("key"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    net = train(learn)
    rows = docs.select(others(docs).alias("row"), F.col("text").cast("string").alias("text"))
    fields = [T.StructField("row", rows.schema["row"].dataType), *([T.StructField("text", T.StringType())] if keep_text else []), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    return rows.mapInArrow(_judged(net, keep_text), T.StructType(fields))


def op3(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of each row."""
    done = identify(docs.select("doc_id", "lang", "text"))
    held = F.coalesce(F.crc32(F.col("row.doc_id").cast("string")) % 3 == 1, F.lit(False))
    return done.select("row.doc_id", held.alias("held_out"), "lang_pred", "score")


def documents_with_language(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows of docs whose language was told with a score of at least ``least``."""
    kept = identify(docs, keep_text=True).filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least))
    return kept.select(*(F.col("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns))
