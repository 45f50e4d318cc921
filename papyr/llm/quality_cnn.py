"""Quality classifier: a byte-level convolutional network in numpy.

Learned filters slide over the bytes of overlapping chunks that cover the whole document. Each filter is max-pooled
within a chunk; a chunk's pooled values give a logit, and the mean over the chunks gives one probability. A filter is
held as one table of 257 rows a tap (the bytes and a pad), so that its convolution is a sum of look-ups.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from papyr.llm.common import held_out
from papyr.llm.labelled import sample_labelled

TAPS, FILTERS, CHUNK, STRIDE, PAD = 5, 16, 384, 320, 256
#: Bounds of the fit: labelled documents a class, all of whose chunks are learned from, and passes.
SAMPLE_DOCS, EPOCHS = 1500, 6
#: Byte positions convolved at once, and chunks of a training batch at once.
BLOCK, CHUNKS_AT_ONCE = 1 << 16, 256


@dataclass(frozen=True)
class ByteCNN:
    """tables: (tap, byte or pad, filter); bias, out: (filter,); out_bias: log-odds with no evidence."""

    tables: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    out_bias: float

    def scores(self, texts: list[bytes | None]) -> np.ndarray:
        """Probability of label 1 for each whole text; null and empty texts are one chunk of padding."""
        sums, counts = np.zeros(len(texts)), np.zeros(len(texts))
        parts, begins, stops, owner, size = [], [], [], [], 0

        def flush() -> None:
            logits = self._logits(np.concatenate(parts + [np.full(TAPS, PAD, np.uint16)]), np.array(begins), np.array(stops))
            np.add.at(sums, owner, logits)
            np.add.at(counts, owner, 1)

        lead = np.full(TAPS - 1, PAD, np.uint16)
        for i, text in enumerate(texts):
            raw = np.frombuffer(text or b"", np.uint8).astype(np.uint16) if text else np.full(1, PAD, np.uint16)
            chunks = chunk_starts(len(raw))
            for at in range(0, len(chunks), BLOCK // STRIDE):
                own = chunks[at : at + BLOCK // STRIDE]
                lo, hi = own[0], min(own[-1] + CHUNK, len(raw))
                head = raw[max(lo - TAPS + 1, 0) : lo]
                parts += [lead[len(head) :], head, raw[lo:hi]]
                begins += [size + c - lo for c in own]
                stops += [size + min(c + CHUNK, hi) - lo for c in own]
                owner += [i] * len(own)
                size += TAPS - 1 + hi - lo
                if size >= BLOCK:
                    flush()
                    parts, begins, stops, owner, size = [], [], [], [], 0
        if parts:
            flush()
        return 1 / (1 + np.exp(-(sums / np.maximum(counts, 1) + self.out_bias)))

    def _logits(self, x: np.ndarray, begins: np.ndarray, stops: np.ndarray) -> np.ndarray:
        m = len(x) - TAPS + 1
        acc = self.tables[0].take(x[:m], axis=0)
        for j in range(1, TAPS):
            acc += self.tables[j].take(x[j : j + m], axis=0)
        best = np.maximum.reduceat(acc, np.stack([begins, stops], 1).ravel(), axis=0)[::2]
        return np.maximum(best + self.bias, 0) @ self.out


def chunk_starts(n: int) -> list[int]:
    """Starts of the overlapping chunks that cover ``n`` bytes."""
    return list(range(0, max(n - CHUNK + STRIDE, 1), STRIDE))


def training_chunks(raw: np.ndarray, starts: list[int]) -> np.ndarray:
    """The chunks of a text's bytes at ``starts``, each with its lead-in, padded to one length."""
    out = np.full((len(starts), TAPS - 1 + CHUNK), PAD, np.uint16)
    for k, s in enumerate(starts):
        own = raw[max(s - TAPS + 1, 0) : s + CHUNK]
        skip = max(TAPS - 1 - s, 0)
        out[k, skip : skip + len(own)] = own
    return out


def _blocks(texts: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All chunks of several texts, ``CHUNKS_AT_ONCE`` at a time, and the text that each is of."""
    parts, owner = [], []
    for i, raw in enumerate(texts):
        starts = chunk_starts(len(raw))
        for at in range(0, len(starts), CHUNKS_AT_ONCE):
            own = starts[at : at + CHUNKS_AT_ONCE]
            if len(owner) + len(own) > CHUNKS_AT_ONCE and owner:
                yield np.concatenate(parts), np.array(owner)
                parts, owner = [], []
            parts.append(training_chunks(raw, own))
            owner += [i] * len(own)
    if owner:
        yield np.concatenate(parts), np.array(owner)


def gradients(w: dict[str, np.ndarray], texts: list[np.ndarray], labels: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
    """Of the weighted cross-entropy of a batch of whole texts, over all their chunks; memory by ``CHUNKS_AT_ONCE``.

    First each chunk's pooled values and where its filters peak (the bytes under the peaks alone are kept), then, with
    the texts' logits known, the derivatives.
    """
    peaks, pooled, owners = [], [], []
    for x, owner in _blocks(texts):
        acc = w["tables"][0].take(x[:, :CHUNK], axis=0)
        for j in range(1, TAPS):
            acc += w["tables"][j].take(x[:, j : j + CHUNK], axis=0)
        acc[x[:, TAPS - 1 :] == PAD] = -1e9
        acc[x[:, TAPS - 1] == PAD, 0] = 0  # the empty text
        where = acc.argmax(1)
        rows = np.arange(len(x))[:, None]
        peaks.append(np.stack([x[rows, where + j] for j in range(TAPS)]))
        pooled.append(np.take_along_axis(acc, where[:, None], 1)[:, 0] + w["bias"])
        owners.append(owner)
    peak, best, owner = np.concatenate(peaks, axis=1), np.concatenate(pooled), np.concatenate(owners)
    sizes = np.bincount(owner, minlength=len(texts))
    logit = np.bincount(owner, np.maximum(best, 0) @ w["out"], len(texts)) / sizes + w["out_bias"][0]
    off = ((1 / (1 + np.exp(-logit)) - labels) * weight / len(texts)).astype(np.float32)
    chunk_off = (off / sizes)[owner][:, None].astype(np.float32)
    back = chunk_off * w["out"] * (best > 0)
    grad = {"tables": np.zeros_like(w["tables"]), "bias": back.sum(0), "out": (chunk_off * np.maximum(best, 0)).sum(0), "out_bias": off.sum(keepdims=True)}
    cells = peak.astype(np.int64) * FILTERS + np.arange(FILTERS)
    for j in range(TAPS):
        grad["tables"][j] = np.bincount(cells[j].ravel(), back.ravel(), 257 * FILTERS).reshape(257, FILTERS)
    grad["tables"][:, PAD] = 0
    return grad


def fit(texts: list[bytes], labels: np.ndarray, prior: float, epochs: int = EPOCHS, seed: int = 10, rate: float = 0.02, batch: int = 64) -> ByteCNN:
    """Fit on all bytes of the texts and 0/1 labels by Adam; the classes weigh alike, and ``prior`` then shifts the log-odds."""
    rng = np.random.default_rng(seed)
    raw = [np.frombuffer(t, np.uint8).astype(np.uint16) if t else np.full(1, PAD, np.uint16) for t in texts]
    w = {
        "tables": rng.normal(0, 0.15, (TAPS, 257, FILTERS)).astype(np.float32),
        "bias": np.zeros(FILTERS, np.float32),
        "out": (rng.normal(0, 0.3, FILTERS)).astype(np.float32),
        "out_bias": np.zeros(1, np.float32),
    }
    w["tables"][:, PAD] = 0
    if len(set(labels.tolist())) < 2:
        return ByteCNN(w["tables"], w["bias"], w["out"] * 0, _log_odds(prior))
    weight = np.where(labels == 1, 0.5 / max((labels == 1).mean(), 1e-9), 0.5 / max((labels == 0).mean(), 1e-9))
    first, second, step = {k: np.zeros_like(v) for k, v in w.items()}, {k: np.zeros_like(v) for k, v in w.items()}, 0
    for _ in range(epochs):
        for at in np.array_split(rng.permutation(len(raw)), max(len(raw) // batch, 1)):
            step += 1
            for k, g in gradients(w, [raw[i] for i in at], labels[at], weight[at]).items():
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.001 * (g * g - second[k])
                w[k] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-7)
    return ByteCNN(w["tables"], w["bias"], w["out"], float(w["out_bias"][0]) + _log_odds(prior))


def _log_odds(p: float) -> float:
    p = min(max(p, 0.02), 0.98)
    return float(np.log(p / (1 - p)))


def score_column(spark: SparkSession, model: ByteCNN, text: Column) -> Column:
    shipped = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series(shipped.value.scores([None if t is None else bytes(t) for t in s]), dtype=float)

    return score(F.coalesce(text, F.lit("")).cast("binary"))


def classify_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", modulus: int = 3, remainder: int = 1, per_class: int = SAMPLE_DOCS) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted.

    Learns from all bytes of at most about ``per_class`` labelled, not held-out documents of each class; every text is
    scored whole. Null texts score like the empty text. Rows with a null id are scored and count as held out. Without labels
    of both classes every score is the labels' share of 1 (0.5 without any). Repeated rows get equal scores; other
    columns are ignored.
    """
    rows, prior = sample_labelled(docs, labels, label_col, per_class, modulus, remainder, id_col, text_col)
    sample = rows.select("id", F.col("text").cast("binary").alias("text"), "label").toPandas().sort_values("id")
    model = fit([bytes(t) for t in sample["text"]], sample["label"].to_numpy(), prior)
    scored = docs.select(docs[id_col].alias("doc_id"), held_out(docs[id_col], modulus, remainder).alias("held_out"), score_column(docs.sparkSession, model, docs[text_col]).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
