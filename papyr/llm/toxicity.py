"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the mean of the vectors of its character n-grams (its edges included), so that a misspelling shares most
vectors with the word that it hides. Words are averaged over the whole text and over short windows that slide over all
of it: the text's margin and that of its most toxic window, in which a single insult in a long text is not averaged
away, give one calibrated probability.
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

GRAMS = (3, 5, 7)
BUCKET_BITS, DIMENSIONS, WINDOW = 19, 8, 4
#: Documents of the sample that must share an n-gram before it gets a vector.
MIN_DOCS = 3
CALIBRATE_ONE_IN = 5
#: Bounds of the fit: labelled documents of each class, and passes.
SAMPLE_DOCS, EPOCHS = 1500, 6
#: Bytes worked on at once.
BLOCK = 1 << 20
#: ASCII punctuation separates words like white space does.
_TO_SPACE = bytes(32 if chr(c).isspace() or (c < 128 and not chr(c).isalnum()) else c for c in range(256))
_TO_SPACE = _TO_SPACE[:128] + bytes(range(128, 256))


def _stream(text: str | None) -> bytes:
    """Lower-cased words between single spaces, with a space at either end; empty if there is no word."""
    words = (text or "").lower().encode("utf-8", "replace").translate(_TO_SPACE).split()
    return b" " + b" ".join(words) + b" " if words else b""


def _grams(b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length where the n-grams of words begin, and their buckets."""
    space, whole = b == 32, np.uint64(0x9E3779B97F4A7C15)
    for n in GRAMS:
        m = len(b) - n + 1
        if m <= 0:
            continue
        ok = ~space[1 : 1 + m].copy()
        for j in range(2, n - 1):
            ok &= ~space[j : j + m]
        at = np.flatnonzero(ok)
        h = np.full(len(at), n, np.uint64)
        for j in range(n):
            h = (h << np.uint64(8)) | b[at + j]
        yield at, ((h * whole) >> np.uint64(64 - BUCKET_BITS)).astype(np.int32)


def word_grams(stream: bytes) -> tuple[np.ndarray, np.ndarray, int]:
    """Buckets of all n-grams of the stream's words, the word of each, and the number of words."""
    b = np.frombuffer(stream, np.uint8)
    space = b == 32
    word = np.cumsum(space) - 1  # a word owns the space before it
    n_words = int(space.sum()) - 1
    buckets, owners = [], []
    for at, found in _grams(b):
        buckets.append(found)
        owners.append(word[at])
    if not buckets:
        return np.empty(0, np.int32), np.empty(0, np.int64), max(n_words, 0)
    return np.concatenate(buckets), np.minimum(np.concatenate(owners), max(n_words - 1, 0)), max(n_words, 0)


def _word_values(gram_values: np.ndarray, stream: bytes) -> np.ndarray:
    """Mean value of each word's n-grams; 0 for a word without (a single character)."""
    buckets, owner, n = word_grams(stream)
    sums = np.bincount(owner, gram_values[buckets], n)
    return sums / np.maximum(np.bincount(owner, minlength=n), 1)


def _window_means(values: np.ndarray) -> np.ndarray:
    """Means of all windows of ``WINDOW`` values; of all values where there are fewer."""
    if len(values) <= WINDOW:
        return values.mean(keepdims=True) if len(values) else np.zeros(1)
    total = np.concatenate(([0.0], np.cumsum(values)))
    return (total[WINDOW:] - total[:-WINDOW]) / WINDOW


@dataclass(frozen=True)
class SubwordToxicity:
    """gram_values: an n-gram's vector times the difference of the two softmax rows.

    weights: of the largest window margin, of the whole text's margin, of one (calibration).
    """

    gram_values: np.ndarray
    weights: np.ndarray

    def margins(self, texts: list[str | None]) -> np.ndarray:
        """(text, 2): the largest margin of a window and the margin of the whole text; 0 without words."""
        top, sums, counts = np.full(len(texts), -np.inf), np.zeros(len(texts)), np.zeros(len(texts))
        some, size = [], 0

        def flush() -> None:
            values = _word_values(self.gram_values, b"".join(s for _, s in some))
            at = 0
            for i, stream in some:
                n = stream.count(b" ") - 1
                own = values[at : at + n]
                top[i], sums[i], counts[i] = _window_means(own).max(), own.sum(), n
                at += n + 1  # between two streams stands an empty word

        for i, text in enumerate(texts):
            stream = _stream(text)
            if len(stream) > BLOCK:
                top[i], sums[i], counts[i] = self._long(stream)
            elif stream:
                some.append((i, stream))
                size += len(stream)
            if size >= BLOCK // 4:
                flush()
                some, size = [], 0
        if some:
            flush()
        return np.stack([np.where(np.isinf(top), 0.0, top), sums / np.maximum(counts, 1)], 1)

    def _long(self, stream: bytes) -> tuple[float, float, int]:
        """Largest margin of a window, sum of the words' values and number of words, ``BLOCK`` bytes at a time.

        The sums of a word and the values of a window that a cut parts are carried on, so cuts change nothing.
        """
        top, total, words = -np.inf, 0.0, 0
        open_sum, open_count, last = 0.0, 0, np.empty(0)
        b = np.frombuffer(stream, np.uint8)
        for at in range(0, len(b), BLOCK):
            word = np.cumsum(b[at : at + BLOCK] == 32)  # 0: the word that the block before left open
            n = int(word[-1]) + 1
            sums, counts = np.zeros(n), np.zeros(n, np.int64)
            for starts, buckets in _grams(b[at : at + BLOCK + max(GRAMS) - 1]):
                inside = np.searchsorted(starts, len(word))
                owner = word[starts[:inside]]
                sums += np.bincount(owner, self.gram_values[buckets[:inside]], n)
                counts += np.bincount(owner, minlength=n)
            sums[0] += open_sum
            counts[0] += open_count
            open_sum, open_count = sums[-1], counts[-1]
            done = (sums / np.maximum(counts, 1))[0 if at else 1 : -1]
            total, words = total + done.sum(), words + len(done)
            last = np.concatenate((last, done))
            if len(last) >= WINDOW:
                top, last = max(top, _window_means(last).max()), last[len(last) - WINDOW + 1 :]
        return (top if words >= WINDOW else last.mean()), total, words

    def scores(self, texts: list[str | None]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margins(texts) @ self.weights[:2] + self.weights[2], -30, 30)))


def fit(texts: list[str], labels: np.ndarray, prior: float, epochs: int = EPOCHS, seed: int = 7, rate: float = 0.3, batch: int = 96) -> SubwordToxicity:
    """Train vectors and softmax together (Adagrad) on whole texts and on windows, which are chosen anew every pass.

    From the second pass on a text also stands for its most toxic window so far, one of label 0 for a random one too.
    N-grams of fewer than ``MIN_DOCS`` texts keep a zero vector. Every ``CALIBRATE_ONE_IN``-th text is left out, to
    weigh the two margins on it, the classes alike. ``prior``, the labels' share of 1, is the score of all texts
    where labels are of one kind only.
    """
    rng = np.random.default_rng(seed)
    apart = np.arange(len(texts)) % CALIBRATE_ONE_IN == 0
    grams = [_by_word(t) if not a else _by_word(None) for t, a in zip(texts, apart, strict=True)]
    spread = np.zeros(1 << BUCKET_BITS, np.int32)
    for b, _, _ in grams:
        spread[np.unique(b)] += 1
    frequent = spread >= MIN_DOCS
    vectors = np.where(frequent[:, None], rng.normal(0, 0.02, (len(spread), DIMENSIONS)), 0).astype(np.float32)
    rows = rng.normal(0, 0.5, (1, DIMENSIONS)).astype(np.float32) * np.array([[-1], [1]], np.float32)
    bias = np.zeros(2, np.float32)
    seen, seen_rows = np.full(vectors.shape, 1e-6, np.float32), np.full(rows.shape, 1e-2, np.float32)
    both = len(set(labels.tolist())) == 2
    for epoch in range(epochs if both else 0):
        v, windows = vectors @ (rows[1] - rows[0]), []  # (text, first word, words)
        for i, g in enumerate(grams):
            if g[2]:
                windows.append((i, 0, g[2]))
            if g[2] and epoch:
                means = _window_means(_values_by_word(v, g))
                windows.append((i, int(means.argmax()), min(WINDOW, g[2])))
                if labels[i] == 0:
                    windows.append((i, int(rng.integers(len(means))), min(WINDOW, g[2])))
        windows = np.array(windows)
        y = labels[windows[:, 0]]
        weigh = np.where(y == 1, 0.5 / max((y == 1).mean(), 1e-9), 0.5 / max((y == 0).mean(), 1e-9))
        for part in np.array_split(rng.permutation(len(windows)), max(len(windows) // batch, 1)):
            idx, weight, owner = _bags(grams, windows[part], frequent)
            vec = vectors[idx] * weight[:, None]
            h = np.stack([np.bincount(owner, vec[:, j], len(part)) for j in range(DIMENSIONS)], 1).astype(np.float32)
            z = h @ rows.T + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(part)), y[part]] -= 1
            g = (p * weigh[part][:, None]).astype(np.float32)
            back, g_rows = g @ rows, g.T @ h
            order = np.argsort(idx, kind="stable")
            first = np.flatnonzero(np.r_[True, np.diff(idx[order]) > 0])
            touched = idx[order][first]
            g_vec = np.add.reduceat((back[owner] * weight[:, None])[order], first, axis=0)
            seen[touched] += g_vec**2
            vectors[touched] -= rate * g_vec / np.sqrt(seen[touched] + 1e-4)
            seen_rows += g_rows**2
            rows -= 0.1 * rate * g_rows / np.sqrt(seen_rows)
            bias -= 0.01 * rate * g.mean(0)
    v = (vectors @ (rows[1] - rows[0])).astype(np.float32)
    if not both or len(set(labels[apart].tolist())) < 2:
        return SubwordToxicity(v, np.array([0, 0, np.log(max(prior, 0.02) / max(1 - prior, 0.02))]))
    margins = SubwordToxicity(v, np.zeros(3)).margins([t for t, a in zip(texts, apart, strict=True) if a])
    return SubwordToxicity(v, _calibrate(margins, labels[apart]))


def _by_word(text: str | None) -> tuple[np.ndarray, np.ndarray, int]:
    """Buckets of a text's n-grams in the order of its words, where each word's begin, and the number of words."""
    buckets, word, n = word_grams(_stream(text))
    order = np.argsort(word, kind="stable")
    return buckets[order], np.searchsorted(word[order], np.arange(n + 1)), n


def _values_by_word(v: np.ndarray, grams: tuple) -> np.ndarray:
    b, cut, _ = grams
    total = np.concatenate(([0.0], np.cumsum(v[b])))
    return (total[cut[1:]] - total[cut[:-1]]) / np.maximum(np.diff(cut), 1)


def _bags(grams: list, windows: np.ndarray, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The windows' n-grams that have a vector, the weight of each in its window's mean, and the window of each."""
    idx, weight, owner = [], [], []
    for k, (i, a, size) in enumerate(windows):
        b, cut, _ = grams[i]
        own, per_word = b[cut[a] : cut[a + size]], np.diff(cut[a : a + size + 1])
        idx.append(own)
        weight.append(np.repeat(1 / (np.maximum(per_word, 1) * size), per_word))
        owner.append(np.full(len(own), k))
    idx, weight, owner = np.concatenate(idx), np.concatenate(weight).astype(np.float32), np.concatenate(owner)
    some = frequent[idx]
    return idx[some], weight[some], owner[some]


def _calibrate(x: np.ndarray, y: np.ndarray, steps: int = 60) -> np.ndarray:
    """Logistic fit of y on the columns of x and one by Newton steps, the classes weighing alike, with a light ridge."""
    weight = np.where(y == 1, 0.5 / (y == 1).mean(), 0.5 / (y == 0).mean())
    center, spread = x.mean(0), np.maximum(x.std(0), 1e-9)
    a, t, ridge = np.c_[(x - center) / spread, np.ones(len(x))], np.zeros(x.shape[1] + 1), np.r_[np.ones(x.shape[1]), 0]
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ t, -30, 30)))
        hess = (a * (weight * p * (1 - p))[:, None]).T @ a + np.diag(ridge + 1e-3)
        t -= np.linalg.solve(hess, a.T @ (weight * (p - y)) + ridge * t)
    return np.r_[t[:-1] / spread, t[-1] - (t[:-1] * center / spread).sum()]


def score_column(spark: SparkSession, model: SubwordToxicity, text: Column) -> Column:
    shipped = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series(shipped.value.scores(s.tolist()), dtype=float)

    return score(F.coalesce(text, F.lit("")))


def classify_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", modulus: int = 5, remainder: int = 0, per_class: int = SAMPLE_DOCS) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted.

    Learns from at most about ``per_class`` labelled, not held-out documents of each class; every text is scored
    whole. Null, empty and wordless texts have margin 0, that is, no evidence. Rows with a null id are scored and
    count as held out. Without labels of both classes every score is the labels' share of 1. Repeated rows get equal
    scores; other columns are ignored.
    """
    rows, prior = sample_labelled(docs, labels, label_col, per_class, modulus, remainder, id_col, text_col)
    sample = rows.toPandas().sort_values("id")
    model = fit(sample["text"].tolist(), sample["label"].to_numpy(), prior)
    scored = docs.select(docs[id_col].alias("doc_id"), held_out(docs[id_col], modulus, remainder).alias("held_out"), score_column(docs.sparkSession, model, docs[text_col]).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
