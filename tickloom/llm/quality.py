"""Quality: a byte-level convolutional network over overlapping chunks that cover the whole text.

Bytes are embedded and ``FILTERS`` learned filters of ``WIDTH`` bytes slide over the text, ``STRIDE`` bytes a
step. Their rectified outputs are max-pooled over chunks of two blocks, one chunk starting every block, so that
chunks overlap by half and every byte is covered. A hidden layer reads each chunk; its units are pooled over
the chunks of the text by maximum and by mean and combined into one probability. Training is plain numpy back-
propagation with Adam on a bounded labelled sample (``PER_CLASS`` texts of each class).

Rows: null texts count as empty; an empty text is one chunk of padding and scored like any other; null ids and
repeated rows are kept; other columns are ignored; with fewer than one labelled text of each class all scores
are the share of good labels.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tickloom.llm.common import keyed_text, map_slices
from tickloom.llm.learning import Adam, schedule, sigmoid

WIDTH, STRIDE, DIM, FILTERS = 8, 2, 8, 24
BLOCK = 48  # filter places in a block; a chunk is two blocks, 192 bytes
HIDDEN = 16
PER_CLASS = 1000  # labelled texts of each class that are learned from
EPOCHS, BATCH_BYTES, RATE, SEED = 10, 120_000, 0.01, 2


class Chunks:
    """Bytes of a slice of texts, a row for each block: its own bytes and the next ones its last places reach into. Each
    text begins a block; past its last block there is padding, whatever text comes next."""

    def __init__(self, texts: pa.Array):
        span = BLOCK * STRIDE
        data = [(t or "").encode("utf-8") for t in texts.to_pylist()]
        self.blocks = np.array([max(1, -(-len(d) // span)) for d in data])
        self.first = np.concatenate(([0], np.cumsum(self.blocks)))
        flat = np.zeros(int(self.first[-1]) * span, dtype=np.uint8)
        for d, b in zip(data, self.first):
            flat[b * span : b * span + len(d)] = np.frombuffer(d, dtype=np.uint8)
        self.last = np.zeros(int(self.first[-1]), dtype=bool)
        self.last[self.first[1:] - 1] = True
        own = flat.reshape(-1, span)
        self.bytes = np.zeros((len(own), span + WIDTH - STRIDE), dtype=np.uint8)
        self.bytes[:, :span] = own
        self.bytes[:-1, span:] = own[1:, : WIDTH - STRIDE]
        self.bytes[self.last, span:] = 0


class Net:
    def __init__(self, seed: int = SEED):
        g = np.random.default_rng(seed)
        f = lambda *s, scale: (g.standard_normal(s) * scale).astype(np.float32)
        self.w = {
            "byte": f(256, DIM, scale=0.5), "conv": f(WIDTH * DIM, FILTERS, scale=0.25), "cb": np.zeros(FILTERS, np.float32), "h": f(FILTERS, HIDDEN, scale=0.2), "hb": np.zeros(HIDDEN, np.float32),
            "out": f(2 * HIDDEN, scale=0.3), "bias": np.zeros(1, np.float32),
        }

    def places(self, rows: np.ndarray) -> np.ndarray:
        """Inputs of the filter places of some blocks: WIDTH embedded bytes each."""
        e = self.w["byte"][rows]
        view = np.lib.stride_tricks.as_strided(e, (len(rows), BLOCK, WIDTH * DIM), (e.strides[0], e.strides[1] * STRIDE, e.strides[2]))
        return view.reshape(-1, WIDTH * DIM)

    def pooled(self, c: Chunks, keep: bool = False):
        """Largest filter output in each block, and where it is (counted in places)."""
        w, total = self.w, len(c.last)
        most = np.empty((total, FILTERS), np.float32)
        where = np.empty((total, FILTERS), np.int64) if keep else None
        for b in range(0, total, 256):
            n = min(256, total - b)
            y = (self.places(c.bytes[b : b + n]) @ w["conv"]).reshape(n, BLOCK, FILTERS)
            most[b : b + n] = y.max(axis=1)
            if keep:
                where[b : b + n] = y.argmax(axis=1) + (np.arange(b, b + n) * BLOCK)[:, None]
        return most + w["cb"], where

    def run(self, c: Chunks, keep: bool = False):
        w = self.w
        block, where = self.pooled(c, keep)
        follows = np.concatenate((block[1:], block[-1:]))
        second = ~c.last[:, None] & (follows > block)
        chunk = np.maximum(np.where(second, follows, block), 0)
        hidden = np.tanh(chunk @ w["h"] + w["hb"])
        heads = c.first[:-1]
        top = np.maximum.reduceat(hidden, heads, axis=0)
        mean = np.add.reduceat(hidden, heads, axis=0) / c.blocks[:, None]
        both = np.concatenate((top, mean), axis=1)
        return both @ w["out"] + w["bias"][0], (where, second, chunk, hidden, top, both) if keep else None

    def gradients(self, c: Chunks, kept, dlogit: np.ndarray) -> dict[str, np.ndarray]:
        w = self.w
        where, second, chunk, hidden, top, both = kept
        of = np.repeat(np.arange(len(c.blocks)), c.blocks)
        dboth = dlogit[:, None] * w["out"]
        is_top = hidden == top[of]
        ties = np.add.reduceat(is_top.astype(np.float32), c.first[:-1], axis=0)
        dh = dboth[of, :HIDDEN] * is_top / ties[of] + dboth[of, HIDDEN:] / c.blocks[of][:, None]
        dpre = dh * (1 - hidden * hidden)
        dchunk = (dpre @ w["h"].T) * (chunk > 0)
        row = np.arange(len(second))[:, None] + second
        place = np.take_along_axis(where, row, axis=0)
        dconv, dbyte = np.zeros_like(w["conv"]), np.zeros_like(w["byte"])
        for f in range(FILTERS):
            some = np.flatnonzero(dchunk[:, f])
            d = dchunk[some, f]
            block, inner = np.divmod(place[some, f][:, None], BLOCK)
            raw = c.bytes[block, inner * STRIDE + np.arange(WIDTH)]
            dconv[:, f] = (w["byte"][raw].reshape(len(some), WIDTH * DIM) * d[:, None]).sum(axis=0)
            per_byte = np.zeros((256, WIDTH), np.float32)
            np.add.at(per_byte, (raw, np.arange(WIDTH)[None]), d[:, None])
            dbyte += per_byte @ w["conv"][:, f].reshape(WIDTH, DIM)
        return {"out": both.T @ dlogit, "bias": np.array([dlogit.sum()], np.float32), "h": chunk.T @ dpre, "hb": dpre.sum(axis=0), "conv": dconv, "cb": dchunk.sum(axis=0), "byte": dbyte}


def train(texts: list[str], labels: np.ndarray, seed: int = SEED) -> Net | float:
    """A trained network, or the share of good labels where one class is missing."""
    if len(labels) == 0 or labels.min() == labels.max():
        return float(labels.mean()) if len(labels) else 0.0
    net = Net(seed)
    opt = Adam(net.w, RATE)
    rng = np.random.default_rng(seed)
    weight = np.where(labels == 1, 0.5 / labels.mean(), 0.5 / (1 - labels.mean()))
    size = np.array([len(t) + 100 for t in texts])
    for done, batch in schedule(size, BATCH_BYTES, EPOCHS, rng):
        opt.rate = RATE * (1.0 if done < 0.7 else 0.3)
        c = Chunks(pa.array([texts[i] for i in batch]))
        logits, kept = net.run(c, keep=True)
        d = ((sigmoid(logits) - labels[batch]) * weight[batch] / len(batch)).astype(np.float32)
        opt.step(net.gradients(c, kept, d))
    return net


def score_texts(net: Net | float, texts: pa.Array) -> np.ndarray:
    return np.full(len(texts), net) if isinstance(net, float) else sigmoid(net.run(Chunks(texts))[0].astype(np.float64))


def score(df: DataFrame, net: Net | float, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, score) of every row; the network travels with the task and has a fixed size."""
    sent = df.sparkSession.sparkContext.broadcast(net)

    def run(part: pa.RecordBatch):
        return {"id": part.column("id"), "score": score_texts(sent.value, part.column("text"))}

    return map_slices(keyed_text(df, key, text), run, "id long, score double")
