"""What the trained text classifiers share: a bounded labelled sample, Adam, and the split of texts into byte words."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import _LOWER, mix, span_hashes

_TOKEN = np.zeros(256, dtype=bool)
_TOKEN[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def labelled_sample(docs: DataFrame, labels: DataFrame, target: str, learn: Column, per_class: int, key: str = "doc_id", text: str = "text") -> tuple[list[str], np.ndarray]:
    """Texts and 0/1 labels of at most ``per_class`` rows of each class, the first by a hash of the id among the
    labelled rows where ``learn`` holds. Ids are chosen from the label table alone; only the chosen texts move."""
    known = labels.select(F.col(f"`{key}`").cast("long").alias("k"), F.col(f"`{target}`").cast("int").alias("y")).where(F.col("k").isNotNull() & learn).distinct()
    chosen = None
    for c in (0, 1):
        part = known.where(F.col("y") == c).orderBy(F.xxhash64("k"), "k").limit(per_class)
        chosen = part if chosen is None else chosen.union(part)
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("k"), F.col(f"`{text}`").cast("string").alias("text")).join(F.broadcast(chosen), "k").where("text is not null")
    got = sorted({(r["k"], r["text"], r["y"]) for r in rows.collect()})  # at most 2 * per_class ids
    return [t for _, t, _ in got], np.array([y for _, _, y in got], dtype=np.float32)


def schedule(sizes: np.ndarray, batch: int, epochs: int, rng, least_steps: int = 240, most_epochs: int = 60):
    """(share of training done, rows of a batch), again and again: batches of about ``batch`` in size, smaller where
    that would give under 12, and more epochs where the sample is so small that there would be few steps."""
    batch = max(1, min(batch, int(sizes.sum()) // 12))
    per_epoch = max(1, int(sizes.sum()) // batch)
    epochs = min(most_epochs, max(epochs, -(-least_steps // per_epoch)))
    for epoch in range(epochs):
        order = rng.permutation(len(sizes))
        for rows in np.split(order, np.flatnonzero(np.diff(np.cumsum(sizes[order]) // batch)) + 1):
            yield epoch / epochs, rows


class Adam:
    def __init__(self, weights: dict[str, np.ndarray], rate: float):
        self.w, self.rate, self.t = weights, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in weights.items()}
        self.v = {k: np.zeros_like(v) for k, v in weights.items()}

    def step(self, grads: dict[str, np.ndarray]) -> None:
        self.t += 1
        fix = self.rate * np.sqrt(1 - 0.999**self.t) / (1 - 0.9**self.t)
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
        scale = np.float32(min(1.0, 5.0 / (norm + 1e-9)))
        for k, g in grads.items():
            g = g * scale
            self.m[k] += 0.1 * (g - self.m[k])
            self.v[k] += 0.001 * (g * g - self.v[k])
            self.w[k] -= (fix * self.m[k] / (np.sqrt(self.v[k]) + 1e-8)).astype(np.float32)


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


class ByteWords:
    """Words (runs of letters, digits and non-ASCII bytes; ASCII lower-cased) of a slice of texts."""

    def __init__(self, texts: pa.Array):
        data = [(t or "").encode("utf-8") for t in texts.to_pylist()]
        joined = np.frombuffer(b" " + b" ".join([*data, b""]), dtype=np.uint8)
        token = _TOKEN[joined]
        self.bytes = np.where(token, _LOWER[joined], 0).astype(np.uint8)
        edge = np.diff(np.concatenate(([False], token, [False])).astype(np.int8))
        self.begin, self.end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        starts = 1 + np.concatenate(([0], np.cumsum([len(d) + 1 for d in data])))
        owner = np.searchsorted(starts, self.begin, side="right") - 1
        self.counts = np.bincount(owner, minlength=len(data))[: len(data)]
        h = span_hashes(self.bytes, self.begin, self.end)
        self.hashes, first, self.place = np.unique(h, return_index=True, return_inverse=True)
        self.first_begin, self.first_end = self.begin[first], self.end[first]

    def trigrams(self, buckets: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashed byte trigrams of every distinct word, its edges included, and where each word's begin."""
        sizes = self.first_end - self.first_begin
        heads = np.concatenate(([0], np.cumsum(sizes)))[:-1]
        at = np.repeat(self.first_begin - heads, sizes) + np.arange(int(sizes.sum()))
        b = self.bytes.astype(np.uint64)
        code = (b[at - 1] << np.uint64(16)) | (b[at] << np.uint64(8)) | b[at + 1]
        return (mix(code + np.uint64(7)) % np.uint64(buckets)).astype(np.int64), heads
