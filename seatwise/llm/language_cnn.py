"""Language identification by a byte convolutional network in numpy.

Windows of ``WINDOW`` bytes are embedded, passed through filters of widths 2, 3 and 4, max-pooled and
classified by softmax. A document's prediction is the mean over all windows of its whole text, weighted
by their bytes. Every label is learned. Training takes a bounded sample: of each label the ``DOCS_PER_LANGUAGE``
documents (fewer if there are so many labels that all would be more than ``SAMPLE_DOCS``, but at least one) with the
least hashes of id and text, and ``WINDOWS_PER_DOC`` windows spread over the whole text of each; documents whose
CRC-32 of the id is 2 modulo 4 are held out.

A null text, or one without a letter, is ``und`` with score 0; so is every text if there is nothing to
learn from. A null id is not held out and is not learned from. Rows are predicted one by one, so repeated
rows have equal predictions; other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from seatwise.llm.common import drop_worker_caches

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16  # of each width
EMBEDDED = 8
DOCS_PER_LANGUAGE = 600
SAMPLE_DOCS = 120_000
WINDOWS_PER_DOC = 4
EPOCHS = 5
BATCH = 64
UNKNOWN = "und"
LEAST_SCORE = 0.3  # for a document to be kept; a text without a letter has 0


@dataclass
class Network:
    """The trained weights; ``kernel`` has the filters of all widths, zero beyond their own width."""

    languages: list[str]
    embedding: np.ndarray
    kernel: np.ndarray
    bias: np.ndarray
    weights: np.ndarray
    offset: np.ndarray

    def _patches(self, windows: np.ndarray) -> np.ndarray:
        padded = np.pad(windows, ((0, 0), (0, max(WIDTHS) - 1)))
        embedded = self.embedding[padded]
        shape = (len(windows), windows.shape[1], max(WIDTHS) * EMBEDDED)
        return np.lib.stride_tricks.as_strided(embedded, shape, embedded.strides)

    def pooled(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The greatest response of each filter in each window, and where."""
        patches = np.ascontiguousarray(self._patches(windows)).reshape(-1, max(WIDTHS) * EMBEDDED)
        found = (patches @ self.kernel).reshape(len(windows), windows.shape[1], -1)
        at = found.argmax(axis=1)
        return np.take_along_axis(found, at[:, None], axis=1)[:, 0] + self.bias, at

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        patches = np.ascontiguousarray(self._patches(windows)).reshape(-1, max(WIDTHS) * EMBEDDED)
        most = (patches @ self.kernel).reshape(len(windows), windows.shape[1], -1).max(axis=1) + self.bias
        return softmax(np.maximum(most, 0) @ self.weights + self.offset)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def filter_mask() -> np.ndarray:
    """Ones where a filter of its width has weights."""
    widths = np.repeat(WIDTHS, FILTERS)
    return np.repeat([[float(k < w) for w in widths] for k in range(max(WIDTHS))], EMBEDDED, axis=0)


def gradients_of(net: Network, x: np.ndarray, y: np.ndarray, mask: np.ndarray) -> dict[str, np.ndarray]:
    """Of the mean cross entropy; they go back through the greatest response of each filter."""
    wide, n = max(WIDTHS), FILTERS * len(WIDTHS)
    most, at = net.pooled(x)
    hidden = np.maximum(most, 0)
    error = softmax(hidden @ net.weights + net.offset)
    error[np.arange(len(y)), y] -= 1
    error /= len(y)
    back = (error @ net.weights.T) * (most > 0)
    padded = np.pad(x, ((0, 0), (0, wide - 1)))
    seen = padded[np.arange(len(y))[:, None, None], at[:, :, None] + np.arange(wide)]
    patches = net.embedding[seen].reshape(len(y), n, -1)
    into = (back[:, :, None] * net.kernel.T[None]).reshape(-1, EMBEDDED)
    embedding = np.zeros_like(net.embedding)
    np.add.at(embedding, seen.reshape(-1), into)
    return {
        "embedding": embedding,
        "kernel": np.einsum("bf,bfk->kf", back, patches) * mask,
        "bias": back.sum(axis=0),
        "weights": hidden.T @ error,
        "offset": error.sum(axis=0),
    }


def train(windows: np.ndarray, labels: np.ndarray, languages: list[str], seed: int = 7) -> Network:
    """Adam on the cross entropy."""
    rng = np.random.default_rng(seed)
    wide, n = max(WIDTHS), FILTERS * len(WIDTHS)
    mask = filter_mask()
    net = Network(
        languages,
        rng.normal(0, 0.5, (256, EMBEDDED)).astype(np.float32),
        (rng.normal(0, 0.3, (wide * EMBEDDED, n)) * mask).astype(np.float32),
        np.zeros(n, np.float32),
        rng.normal(0, 0.2, (n, len(languages))).astype(np.float32),
        np.zeros(len(languages), np.float32),
    )
    names = ["embedding", "kernel", "bias", "weights", "offset"]
    moments = {k: [np.zeros_like(getattr(net, k)), np.zeros_like(getattr(net, k))] for k in names}
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(windows))
        for start in range(0, len(order), BATCH):
            some = order[start : start + BATCH]
            x, y = windows[some], labels[some]
            gradients = gradients_of(net, x, y, mask)
            step += 1
            for k, g in gradients.items():
                m, v = moments[k]
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                change = 0.01 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
                setattr(net, k, (getattr(net, k) - change).astype(np.float32))
    return net


def windows_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of the texts, the text and the number of bytes of each."""
    lengths = np.array([len(t) for t in texts], np.int64)
    counts = -(-lengths // WINDOW)
    flat = np.zeros(int(counts.sum()) * WINDOW, np.uint8)
    at = 0
    for text, count in zip(texts, counts.tolist()):
        flat[at : at + len(text)] = np.frombuffer(text, np.uint8)
        at += count * WINDOW
    owner = np.repeat(np.arange(len(texts)), counts)
    first = np.cumsum(counts) - counts
    weight = np.minimum(lengths[owner] - (np.arange(len(owner)) - first[owner]) * WINDOW, WINDOW)
    return flat.reshape(-1, WINDOW), owner, weight


def _held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    per_language: int = DOCS_PER_LANGUAGE,
) -> Network | None:
    """The network trained on the sample; None if no labelled text has a letter."""
    named = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")
    )
    learned = named.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~_held_out())
    learned = learned.where(F.col("text").rlike(r"\p{L}"))
    place = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / float(1 << 30)
    learned = learned.withColumn("place", place)
    counts = learned.groupBy("lang").agg(F.count("*").alias("n"), F.min("place").alias("least")).collect()
    if not counts:
        return None
    taken = max(1, min(per_language, SAMPLE_DOCS // len(counts)))
    # before any text is sorted: the least of each label, and about twice as many as needed, all of rare labels
    shares = [(r["lang"], max(r["least"], (2 * taken + 60) / r["n"])) for r in counts]
    shares = docs.sparkSession.createDataFrame(shares, "lang string, share double")
    # one row per label, which the driver has held
    drawn = learned.join(F.broadcast(shares), "lang").where("place <= share")
    order = W.partitionBy("lang").orderBy("place", "doc_id")
    sample = drawn.withColumn("taken", F.row_number().over(order)).where(F.col("taken") <= taken)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                data = text.encode()
                for start in np.linspace(0, max(0, len(data) - WINDOW), WINDOWS_PER_DOC).astype(int).tolist():
                    found.append((data[start : start + WINDOW], lang))
            columns = [pa.array([f[0] for f in found], pa.binary()), pa.array([f[1] for f in found], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["data", "lang"])

    rows = sample.select("text", "lang").mapInArrow(cut, "data binary, lang string").collect()
    rows = sorted((bytes(r["data"]), r["lang"]) for r in rows)
    languages = sorted({lang for _, lang in rows})
    windows = np.zeros((len(rows), WINDOW), np.uint8)
    for k, (data, _) in enumerate(rows):
        windows[k, : len(data)] = np.frombuffer(data, np.uint8)
    return train(windows, np.array([languages.index(lang) for _, lang in rows]), languages)


def predict_texts(net: Network, texts: list[bytes]) -> tuple[list[str], list[float]]:
    windows, owner, weight = windows_of(texts)
    total = np.zeros((len(texts), len(net.languages)))
    for start in range(0, len(windows), 256):
        some = slice(start, start + 256)
        np.add.at(total, owner[some], net.probabilities(windows[some]) * weight[some, None])
    total /= np.maximum(total.sum(axis=1, keepdims=True), 1e-12)
    best = total.argmax(axis=1)
    return [net.languages[k] for k in best], np.clip(total[np.arange(len(best)), best], 0, 1).tolist()


def classifier(net: Network | None):
    """A function of a text column that gives struct(lang_pred, score)."""
    if net is None:
        return lambda _: F.struct(F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))

    @F.pandas_udf("lang_pred string, score double")
    def classify(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        drop_worker_caches()
        for batch in batches:
            lang, score = [UNKNOWN] * len(batch), [0.0] * len(batch)
            for start in range(0, len(batch), 1024):
                some = batch.iloc[start : start + 1024]
                known = [(start + k, text.encode()) for k, text in enumerate(some) if text is not None]
                for (k, _), found, sure in zip(known, *predict_texts(net, [text for _, text in known])):
                    lang[k], score[k] = found, sure
            yield pd.DataFrame({"lang_pred": lang, "score": score})

    return lambda text: classify(F.when(text.rlike(r"\p{L}"), text))


def predict(docs: DataFrame, net: Network | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: doc_id, held_out, lang_pred, score. Only the text decides."""
    named = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    found = named.select("doc_id", _held_out().alias("held_out"), classifier(net)(F.col("text")).alias("found"))
    return found.select("doc_id", "held_out", "found.lang_pred", "found.score")


def identify_languages(docs: DataFrame) -> DataFrame:
    return predict(docs, fit(docs))


def keep_identified(docs: DataFrame, least_score: float = LEAST_SCORE) -> DataFrame:
    """The rows of ``docs``, all columns, whose text has a letter and a language of at least that score.

    If no row has a label to learn from, nothing can be told apart, and every text with a letter stays.
    """
    net = fit(docs)
    if net is None:
        return docs.where(docs["text"].rlike(r"\p{L}"))
    return docs.where(classifier(net)(docs["text"])["score"] >= least_score)
