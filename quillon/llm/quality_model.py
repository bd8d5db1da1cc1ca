"""Quality classifier: logistic regression over hashed word n-grams, trained by FTRL-proximal.

Words are runs of letters and digits and runs of other visible characters, with
their case; a text's features are its words and word pairs (and, for a word said
again, the pair "same word"), hashed into 2^``bits`` buckets and weighted by
their share of the text. Training follows the
regularised leader per coordinate on a bounded sample of labels (the
``train_rows`` least by a hash of doc_id) on the driver; scoring is a sparse dot
product in one pass over the documents with the weights, whose size is fixed.

Cases: a null or empty text has no features and gets the bias alone; labels that
are null or of unknown documents are not used; a doc_id with two labels is
learned with both, one with several texts with each; with no labels at all every score
is 0.5; texts of any length are read whole; equal texts have equal scores; an
empty table gives no rows; further columns, lang and source among them, are
ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 18
#: Bound of the training sample; each row sends about 10 KB of features to the driver.
TRAIN_ROWS = 4000
EPOCHS = 4
ALPHA, BETA, L1, L2 = 0.3, 1.0, 1.0, 0.1
#: Features are shares of a text; this brings them near 1.
SCALE = 100.0
FOLDS, THRESHOLD = 5, 0.3
_WORD = re.compile(r"[^\W_]+|[^\w\s]+|_+")


_AGAIN = np.uint64(0x2545F4914F6CDD1D)


class _Hashes(dict):
    """Hash of a word, kept for a bounded number of words."""

    def __missing__(self, word: str) -> int:
        h = zlib.crc32(word.encode("utf-8", "surrogatepass"))
        if len(self) < 300_000:
            self[word] = h
        return h


_hashes = _Hashes()


def features(text: str, bits: int = BITS) -> np.ndarray:
    """Bucket of every word and word pair of ``text``, repeats included."""
    found = _WORD.findall(text)
    h = np.fromiter(map(_hashes.__getitem__, found), np.uint64, len(found))
    pairs = (h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]) * np.uint64(0xC2B2AE3D27D4EB4F)
    single = h * np.uint64(0xFF51AFD7ED558CCD)
    # a word said again at once, or after one other, is one and the same word pair whatever the word
    again = [np.full(np.count_nonzero(h[d:] == h[:-d]), _AGAIN * np.uint64(d), np.uint64) for d in (1, 2)]
    return (np.concatenate([single, pairs, *again]) >> np.uint64(64 - bits)).astype(np.int64)


class FTRL:
    """Per-coordinate follow-the-regularised-leader (McMahan et al., 2013); the last coordinate is the bias."""

    def __init__(self, size: int, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2):
        self.z, self.n = np.zeros(size + 1), np.zeros(size + 1)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= self.l1, 0.0, (np.sign(z) * self.l1 - z) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, at: np.ndarray, x: np.ndarray, y: int) -> None:
        w = self.weights(at)
        g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - y) * x
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g


def held_out(doc_id) -> F.Column:
    return F.crc32(F.col(doc_id).cast("string")) % FOLDS == 0


def fit(documents: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, bits: int = BITS) -> np.ndarray:
    """Weights (the bias last) from at most ``train_rows`` labelled documents outside the held-out fold."""
    usable = labels.filter(F.col("quality").isNotNull() & ~held_out("doc_id")).select("doc_id", "quality").distinct()
    sample = usable.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(train_rows)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            rows = [np.unique(features(t.as_py() or "", bits), return_counts=True) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([r[0].astype("<i4").tobytes() for r in rows], pa.binary()), pa.array([r[1].astype("<i4").tobytes() for r in rows], pa.binary())], names=["doc_id", "quality", "buckets", "counts"])

    # at most train_rows rows of 12 bytes are broadcast
    joined = documents.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("doc_id", "text", "quality")
    rows = joined.mapInArrow(run, "doc_id long, quality int, buckets binary, counts binary").collect()
    rows.sort(key=lambda r: (zlib.crc32(b"%d" % r[0]), r[0], r[1]))
    model, size = FTRL(1 << bits), 1 << bits
    data = []
    for _, y, buckets, counts in rows:
        c = np.frombuffer(counts, "<i4")
        data.append((np.append(np.frombuffer(buckets, "<i4"), size), np.append(SCALE * c / max(1, c.sum()), 1.0), int(y > 0)))
    for _ in range(EPOCHS):
        for at, x, y in data:
            model.learn(at, x, y)
    return model.weights().astype(np.float32)


def score(df: DataFrame, weights: np.ndarray, bits: int = BITS) -> DataFrame:
    """``df(doc_id, text)`` as doc_id, held_out, score, predicted."""
    shared = df.sparkSession.sparkContext.broadcast(weights)  # 4 * 2^bits bytes

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        w = shared.value
        for batch in batches:
            margin = np.empty(batch.num_rows)
            for i, text in enumerate(batch.column(1)):
                at = features(text.as_py() or "", bits)
                margin[i] = float(w[-1]) + (SCALE * float(w[at].mean(dtype=np.float64)) if len(at) else 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(margin, -35, 35))))], names=["doc_id", "score"])

    scored = df.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
