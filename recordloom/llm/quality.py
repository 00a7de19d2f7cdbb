"""Quality classifier: logistic regression on hashed word n-grams, trained by follow-the-regularised-leader.

Features of a text are the hashes of its words and word pairs, and of one to three neighbouring word
shapes (letters, capitals and digits as classes, runs as one), so that noise in unseen words is seen too;
a repeated word gives one common feature.  They are presence features scaled to length one; four more tell
which tenth or so of the n-grams are repeated or different.  A score is the logistic function of a sparse
dot product.  The model is ``BUCKETS`` weights, fitted in one task on
a bounded sample (see labelled.SAMPLE, SAMPLE_CHARS) and sent to the tasks that score.

Cases: a null or empty text has no n-grams and gets a score of its own share features and the bias; repeated rows get
equal scores; without usable labels every score is 0.5; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import give_back
from .labelled import SAMPLE, sample, within

BUCKETS, SHARES = 1 << 20, 4
CLASSES = bytes(97 if 97 <= b <= 122 or b >= 128 else 65 if 65 <= b <= 90 else 48 if 48 <= b <= 57 else b for b in range(256))
A, B, C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def features(text: str) -> np.ndarray:
    """Distinct buckets, sorted; the last SHARES are those of the text's n-gram shares."""
    raw = text.encode("utf-8", "surrogatepass")
    words = np.fromiter(map(crc32, raw.lower().split()), np.uint64)
    if not len(words):
        return BUCKETS - SHARES * 16 + 16 * np.arange(SHARES)
    classes = np.frombuffer(raw.translate(CLASSES), np.uint8)
    shapes = np.fromiter(map(crc32, classes[np.append(True, classes[1:] != classes[:-1])].tobytes().split()), np.uint64)
    pairs = words[:-1] * A + words[1:] * B
    pairs[words[:-1] == words[1:]] = np.uint64(1)
    found = [words * A, pairs, shapes * C + A, shapes[:-1] * C + shapes[1:] * A + B, shapes[:-2] * C + shapes[1:-1] * A + shapes[2:] * B + C]
    ngrams = np.unique((np.concatenate(found) * C >> np.uint64(44)).astype(np.int64))
    # of all: words that repeat the one before, different words, different pairs, different shapes
    shares = np.array([(words[:-1] == words[1:]).mean() if len(words) > 1 else 0.0, *(len(np.unique(x)) / max(1, len(x)) for x in (words, pairs, shapes))])
    return np.append(ngrams[ngrams < BUCKETS - SHARES * 16], BUCKETS - SHARES * 16 + 16 * np.arange(SHARES) + 1 + (shares * 14).astype(np.int64))


class Leader:
    """Follow-the-regularised-leader with per-coordinate rates; the last coordinate is the bias."""

    def __init__(self, buckets: int = BUCKETS, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.05, l2: float = 0.5):
        self.z, self.n = np.zeros(buckets + 1), np.zeros(buckets + 1)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at=slice(None)) -> np.ndarray:
        z = self.z[at]
        return np.where(np.abs(z) <= self.l1, 0.0, (np.sign(z) * self.l1 - z) / ((self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2))

    def learn(self, at: np.ndarray, y: int) -> None:
        x = np.full(len(at) + 1, 1 / math.sqrt(len(at)))
        x[-1 - SHARES :] = 1
        at = np.append(at, len(self.z) - 1)
        w = self.weights(at)
        g = (1 / (1 + math.exp(-max(-30.0, min(30.0, float(w @ x))))) - y) * x
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g


def score(weights: np.ndarray, text: str | None) -> float:
    at = features(text or "")
    w = weights[at].astype(np.float64)
    s = float(weights[-1]) + float(w[-SHARES:].sum()) + float(w[:-SHARES].sum()) / math.sqrt(len(at))
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, s))))


def fit(rows: DataFrame, epochs: int = 3) -> np.ndarray:
    """Weights from rows (text, y), in one task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = [(features(t).astype(np.int32), y) for t, y in within(pair for b in batches for pair in zip(b["text"], b["y"], strict=True))]
        model = Leader()
        for k in range(epochs):
            for j in np.random.default_rng(k).permutation(len(seen)):
                model.learn(*seen[j])
        yield pd.DataFrame({"w": [model.weights().astype(np.float32).tobytes()]})
        give_back()

    found = rows.mapInPandas(run, "w binary").collect()
    return np.frombuffer(bytes(found[0].w), np.float32) if found else np.zeros(BUCKETS + 1, np.float32)


def score_documents(docs: DataFrame, labels: DataFrame, label: str, learn: Column, n: int = SAMPLE) -> DataFrame:
    """doc_id, score."""
    weights = docs.sparkSession.sparkContext.broadcast(fit(sample(docs, labels, label, learn, n)))
    kept = docs.select("doc_id", F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w = weights.value
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "score": [score(w, t) for t in b["text"]]})
        give_back()

    return kept.mapInPandas(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")
