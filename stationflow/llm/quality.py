"""Quality classifier: averaged vectors of hashed word and character n-grams.

Every document is the mean of the vectors of its words, word pairs, and runs of
three and four bytes; a softmax over two classes follows. The vectors are
learned by stochastic gradient descent in numpy. Once learned, a feature
only counts by its vector's share of the difference of the two outputs, so
scoring looks up one number a feature. Null and empty texts have no features
and get the learned base rate. Rows are scored one by one: repeated rows,
null ids and extra columns pass through; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .common import slices

BUCKETS = 1 << 17
DIM = 8
SAMPLE_DOCS = 3_000
SAMPLE_TEXT_CHARS = 30_000
EPOCHS = 5
LEAST_STEPS = 500
RATE = 40.0
BATCH = 32
SLICE_CHARS = 1_000_000
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _mix(x: np.ndarray, salt: int, buckets: int) -> np.ndarray:
    """Bucket of each number."""
    x = (x + x.dtype.type(salt)) * x.dtype.type(0x9E3779B1)
    x ^= x >> x.dtype.type(15)
    x *= x.dtype.type(0x85EBCA77)
    x ^= x >> x.dtype.type(16)
    return (x & x.dtype.type(buckets - 1)).astype(np.int32)


def features(texts: list[str], buckets: int = BUCKETS) -> list[tuple[np.ndarray, np.ndarray]]:
    """Families of features: the buckets in the order of the texts, and how many each text has.

    Words are runs of bytes over 0x20. A word equal to the one before makes
    the pair a back reference, the same feature for every word.
    """
    data = [t.encode("utf-8", "replace") for t in texts]
    sizes = np.array([len(d) for d in data], dtype=np.int64)
    raw = np.frombuffer(b"\x00".join(data) + b"\x00", dtype=np.uint8)
    ends = np.cumsum(sizes + 1)
    found = []
    b = raw.astype(np.uint32)
    for n in (3, 4):
        gram = b[: max(0, len(b) - n + 1)].copy()
        for i in range(1, n):
            gram |= b[i : i + len(gram)] << np.uint32(8 * i)
        full = np.ones(len(gram), dtype=bool)  # grams that reach over the end of their text fall out
        for i in range(n):
            over = ends - 1 - i
            full[over[(over >= 0) & (over < len(gram))]] = False
        found.append((_mix(gram[full], n, buckets), np.maximum(sizes - n + 1, 0)))
    letter = raw > 32
    edge = np.diff(np.concatenate([[False], letter, [False]]).astype(np.int8))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    number = np.diff(np.concatenate([[0], np.searchsorted(start, ends)]))
    with np.errstate(over="ignore"):
        power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(b) - 1, _BASE)]))
        back = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(b) - 1, _INVERSE)]))
        sums = np.concatenate([[np.uint64(0)], np.cumsum((b + np.uint64(1)) * power)])
        word = (sums[end] - sums[start]) * back[start]
        pair = word[:-1] * _BASE + word[1:]
    word ^= word >> np.uint64(32)
    pair ^= pair >> np.uint64(32)
    follows = np.ones(max(0, len(word) - 1), dtype=bool)
    firsts = (np.cumsum(number) - number)[number > 0]
    follows[firsts[firsts > 0] - 1] = False
    pair = np.where(word[1:] == word[:-1], np.uint64(7), pair)
    found.append((_mix(word, 11, buckets), number))
    found.append((_mix(pair[follows], 12, buckets), np.maximum(number - 1, 0)))
    return found


@dataclass
class Model:
    """``weights``: share of each feature in the logit of class 1; ``bias``: the rest."""

    weights: np.ndarray
    bias: float

    def scores(self, texts: list[str]) -> np.ndarray:
        out = np.empty(len(texts))
        for lo, hi in slices([len(t) for t in texts], SLICE_CHARS):
            total, n = np.zeros(hi - lo), np.zeros(hi - lo)
            for f, counts in features(texts[lo:hi], len(self.weights)):
                sums = np.concatenate([[0.0], np.cumsum(self.weights[f])])
                to = np.cumsum(counts)
                total += sums[to] - sums[to - counts]
                n += counts
            out[lo:hi] = total / np.maximum(n, 1)
        return 1 / (1 + np.exp(-(out + self.bias)))


def train(texts: list[str], labels: list[int], seed: int = 1) -> Model:
    """Fit vectors and softmax by minibatch gradient descent with a falling rate."""
    if not texts:
        return Model(np.zeros(BUCKETS), 0.0)
    rng = np.random.default_rng(seed)
    y = np.array(labels, dtype=np.int64)
    prior = np.clip(np.bincount(y, minlength=2) / len(y), 0.01, 0.99)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    out = np.zeros((DIM, 2), dtype=np.float32)
    bias = np.log(prior).astype(np.float32)
    rows = []
    for t in texts:
        f, n = np.unique(np.concatenate([x for x, _ in features([t])]), return_counts=True)
        rows.append((f.astype(np.int32), (n / max(1, n.sum())).astype(np.float32)))
    batches, step = -(-len(rows) // BATCH), 0
    epochs = max(EPOCHS, -(-LEAST_STEPS // batches))
    steps = epochs * batches
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for lo in range(0, len(order), BATCH):
            take = order[lo : lo + BATCH]
            rate = RATE * (1 - step / steps)
            step += 1
            f = np.concatenate([rows[i][0] for i in take])
            share = np.concatenate([rows[i][1] for i in take])
            sizes = np.array([len(rows[i][0]) for i in take])
            of = np.repeat(np.arange(len(take)), sizes)
            hidden = np.zeros((len(take), DIM), dtype=np.float32)
            np.add.at(hidden, of, vectors[f] * share[:, None])
            logits = hidden @ out + bias
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(take)), y[take]] -= 1
            p /= len(take)
            back = p @ out.T
            out -= np.float32(rate * 0.1) * (hidden.T @ p)
            bias -= np.float32(rate * 0.005) * p.sum(axis=0)
            np.add.at(vectors, f, np.float32(-rate) * back[of] * share[:, None])
    return Model((vectors @ (out[:, 1] - out[:, 0])).astype(np.float64), float(bias[1] - bias[0]))


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE_DOCS) -> Model:
    """Fit on a bounded sample of labelled rows: ``labels`` has ``doc_id`` and ``quality`` (0 or 1).

    About ``sample`` labels, drawn by a hash of their ids at a rate set by the
    count of all of them, meet their documents. Of a drawn text the first
    ``SAMPLE_TEXT_CHARS`` characters are learned from; scores see whole texts.
    """
    marks = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).where(
        F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1)
    ).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    n = marks.count()
    few = marks.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int((1 << 20) * min(1.0, sample / max(1, n))))
    rows = (
        docs.select("doc_id", F.col("text").cast("string").alias("text"))
        .where(F.length("text") > 0).join(few, "doc_id").withColumn("text", F.left("text", F.lit(SAMPLE_TEXT_CHARS)))
        .orderBy(F.xxhash64("doc_id"), "text").limit(2 * sample).select("text", "quality").collect()
    )
    return train([r.text for r in rows], [r.quality for r in rows])


def score(text: Column, model: Model) -> Column:
    """Probability of label 1."""

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(model.scores([t or "" for t in texts]))

    return run(text)
