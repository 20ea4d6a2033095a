"""Toxicity: a bidirectional gated recurrent network with attention pooling over character and word inputs.

Every word enters as the embedding of its hash beside the mean embedding of its character trigrams. Texts are
cut into windows of ``WINDOW`` words, one starting every half window, which together cover the whole text; a
forward and a backward GRU read each window, attention pools their states, and the pooled state gives the
window's logit. A text's score is the sigmoid of its largest window logit. Training is plain numpy back-
propagation with Adam on a bounded labelled sample (``PER_CLASS`` texts of each class); the gradient is shared
among a text's windows by the softmax of their logits, as only some of a toxic text's windows are toxic.

Rows: null texts and texts without a word score 0; null ids and repeated rows are kept; other columns are
ignored; with fewer than one labelled text of each class all scores are the share of toxic labels.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tickloom.llm.common import filter_slices, keyed_text, map_slices
from tickloom.llm.learning import Adam, ByteWords, schedule, sigmoid

WINDOW = 24
STEP = WINDOW // 2
HIDDEN = 8
WORD_BUCKETS, TRIGRAM_BUCKETS, DIM = 8192, 4096, 8
PER_CLASS = 900  # labelled texts of each class that are learned from
EPOCHS, BATCH_WINDOWS, RATE, SEED = 6, 900, 0.02, 1
AT_ONCE = 4096  # windows scored together
_KEEP = 20.0  # update gate of padding: the state stays


def windows(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word indices by window, -1 where padded; text of each window) for texts of ``counts`` words."""
    per = np.where(counts > 0, np.maximum(1, -(-(counts - WINDOW) // STEP) + 1), 0)
    text = np.repeat(np.arange(len(counts)), per)
    nth = np.arange(len(text)) - np.repeat(np.concatenate(([0], np.cumsum(per)))[:-1], per)
    local = nth[:, None] * STEP + np.arange(WINDOW)[None]
    head = np.concatenate(([0], np.cumsum(counts)))[:-1]
    return np.where(local < counts[text][:, None], local + head[text][:, None], -1), text


class Net:
    def __init__(self, seed: int = SEED):
        g = np.random.default_rng(seed)
        f = lambda *s, scale: (g.standard_normal(s) * scale).astype(np.float32)
        h = HIDDEN
        self.w = {
            "word": f(WORD_BUCKETS, DIM, scale=0.3), "char": f(TRIGRAM_BUCKETS, DIM, scale=0.5), "x": f(2 * DIM, 6 * h, scale=0.35), "xb": np.zeros(6 * h, np.float32),
            "uf": f(h, 3 * h, scale=0.3), "ub": f(h, 3 * h, scale=0.3), "att": f(2 * h, scale=0.3), "out": f(2 * h, scale=0.5), "bias": np.full(1, -1.0, np.float32),
        }

    def inputs(self, words: ByteWords):
        """Gate inputs of every distinct word, with padding as the last row."""
        bucket = (words.hashes % np.uint64(WORD_BUCKETS)).astype(np.int64)
        grams, heads = words.trigrams(TRIGRAM_BUCKETS)
        sizes = np.diff(np.append(heads, len(grams))).astype(np.float32)
        chars = np.add.reduceat(self.w["char"][grams], heads, axis=0) / sizes[:, None] if len(heads) else np.zeros((0, DIM), np.float32)
        e = np.concatenate((self.w["word"][bucket], chars), axis=1)
        gates = np.concatenate((e @ self.w["x"] + self.w["xb"], np.zeros((1, 6 * HIDDEN), np.float32)))
        gates[-1, :HIDDEN] = gates[-1, 3 * HIDDEN : 4 * HIDDEN] = _KEEP
        return gates, (bucket, grams, heads, sizes, e)

    def run(self, gates: np.ndarray, at: np.ndarray, keep: bool = False):
        """Logits of windows ``at`` (rows of ``gates``); with ``keep`` also what back-propagation needs."""
        h, n = HIDDEN, len(at)
        pad = len(gates) - 1
        forward, backward = np.ascontiguousarray(gates[:, : 3 * h]), np.ascontiguousarray(gates[:, 3 * h :])
        state = np.zeros((n, 2, h), np.float32)
        states = np.empty((n, WINDOW, 2, h), np.float32)
        x, g = np.empty((n, 2, 3 * h), np.float32), np.empty((n, 2, 3 * h), np.float32)
        saved = []
        for t in range(WINDOW):
            np.take(forward, at[:, t], axis=0, out=x[:, 0])
            np.take(backward, at[:, WINDOW - 1 - t], axis=0, out=x[:, 1])
            g[:, 0] = state[:, 0] @ self.w["uf"]
            g[:, 1] = state[:, 1] @ self.w["ub"]
            zr = x[:, :, : 2 * h] + g[:, :, : 2 * h]
            np.negative(zr, out=zr)
            np.exp(zr, out=zr)
            zr += 1
            np.reciprocal(zr, out=zr)
            z, r = zr[:, :, :h], zr[:, :, h:]
            inner = g[:, :, 2 * h :]
            new = np.tanh(x[:, :, 2 * h :] + r * inner)
            if keep:
                saved.append((z, r, new, state, inner.copy()))
            state = new + z * (state - new)
            states[:, t, 0], states[:, WINDOW - 1 - t, 1] = state[:, 0], state[:, 1]
        flat = states.reshape(n, WINDOW, 2 * h)
        e = flat @ self.w["att"]
        e[at == pad] = -1e9
        a = np.exp(e - e.max(axis=1, keepdims=True))
        a /= a.sum(axis=1, keepdims=True)
        pooled = (a[:, :, None] * flat).sum(axis=1)
        logits = pooled @ self.w["out"] + self.w["bias"][0]
        return logits, (saved, flat, a, pooled) if keep else None

    def gradients(self, words: ByteWords, wanted, extra, at: np.ndarray, kept, dlogit: np.ndarray) -> dict[str, np.ndarray]:
        h, w = HIDDEN, self.w
        saved, flat, a, pooled = kept
        bucket, grams, heads, sizes, e = extra
        out = {"out": pooled.T @ dlogit, "bias": np.array([dlogit.sum()], np.float32)}
        dpool = dlogit[:, None] * w["out"]
        da = flat @ dpool[:, :, None]
        da = da[:, :, 0]
        de = a * (da - (a * da).sum(axis=1, keepdims=True))
        dflat = (a[:, :, None] * dpool[:, None] + de[:, :, None] * w["att"]).reshape(len(at), WINDOW, 2, h)
        out["att"] = np.einsum("nt,ntk->k", de, flat)
        dgates = np.zeros_like(wanted)
        carry = np.zeros((len(at), 2, h), np.float32)
        duf, dub = np.zeros_like(w["uf"]), np.zeros_like(w["ub"])
        all_f, all_b = np.empty((WINDOW, len(at), 3 * h), np.float32), np.empty((WINDOW, len(at), 3 * h), np.float32)
        for t in range(WINDOW - 1, -1, -1):
            z, r, new, before, inner = saved[t]
            d = carry
            d[:, 0] += dflat[:, t, 0]
            d[:, 1] += dflat[:, WINDOW - 1 - t, 1]
            dz, dn = d * (before - new) * z * (1 - z), d * (1 - z) * (1 - new * new)
            dr = dn * inner * r * (1 - r)
            dg = np.concatenate((dz, dr, dn * r), axis=2)
            dx = np.concatenate((dz, dr, dn), axis=2)
            carry = d * z
            carry[:, 0] += dg[:, 0] @ w["uf"].T
            carry[:, 1] += dg[:, 1] @ w["ub"].T
            duf += before[:, 0].T @ dg[:, 0]
            dub += before[:, 1].T @ dg[:, 1]
            all_f[t], all_b[WINDOW - 1 - t] = dx[:, 0], dx[:, 1]
        flat_at = at.T.ravel()
        order = np.argsort(flat_at, kind="stable")
        starts = np.flatnonzero(np.diff(flat_at[order], prepend=-1))
        both = np.concatenate((all_f.reshape(-1, 3 * h), all_b.reshape(-1, 3 * h)), axis=1)[order]
        dgates[flat_at[order][starts]] = np.add.reduceat(both, starts, axis=0)
        dgates = dgates[:-1]
        out |= {"uf": duf, "ub": dub, "x": e.T @ dgates, "xb": dgates.sum(axis=0)}
        demb = dgates @ w["x"].T
        dword = np.zeros_like(w["word"])
        np.add.at(dword, bucket, demb[:, :DIM])
        dchar = np.zeros_like(w["char"])
        np.add.at(dchar, grams, np.repeat(demb[:, DIM:] / sizes[:, None], sizes.astype(np.int64), axis=0))
        return out | {"word": dword, "char": dchar}


def train(texts: list[str], labels: np.ndarray, seed: int = SEED) -> Net | float:
    """A trained network, or the share of positive labels where one class is missing."""
    if len(labels) == 0 or labels.min() == labels.max():
        return float(labels.mean()) if len(labels) else 0.0
    net = Net(seed)
    opt = Adam(net.w, RATE)
    rng = np.random.default_rng(seed)
    weight = np.where(labels == 1, 0.5 / labels.mean(), 0.5 / (1 - labels.mean()))
    size = np.array([max(1, len(t) // (6 * STEP)) for t in texts])
    for done, batch in schedule(size, BATCH_WINDOWS, EPOCHS, rng):
        opt.rate = RATE * (1.0 if done < 0.6 else 0.3)
        words = ByteWords(pa.array([texts[i] for i in batch]))
        index, text = windows(words.counts)
        if not len(index):
            continue
        gates, extra = net.inputs(words)
        at = np.where(index >= 0, words.place[np.maximum(index, 0)], len(gates) - 1)
        logits, kept = net.run(gates, at, keep=True)
        heads = np.flatnonzero(np.diff(text, prepend=-1))
        whose = text[heads]
        top = np.maximum.reduceat(logits, heads)
        spread = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(text))))
        share = np.exp(logits - top[spread])
        share /= np.add.reduceat(share, heads)[spread]
        y, c = labels[batch][whose], weight[batch][whose]
        dtop = ((sigmoid(top) - y) * c).astype(np.float32) / len(heads)
        opt.step(net.gradients(words, gates, extra, at, kept, (share * dtop[spread]).astype(np.float32)))
    return net


def score_texts(net: Net | float, texts: pa.Array) -> np.ndarray:
    if isinstance(net, float):
        return np.full(len(texts), net)
    words = ByteWords(texts)
    out = np.full(len(texts), -30.0)
    index, text = windows(words.counts)
    if len(index):
        gates, _ = net.inputs(words)
        for start in range(0, len(index), AT_ONCE):
            part = index[start : start + AT_ONCE]
            at = np.where(part >= 0, words.place[np.maximum(part, 0)], len(gates) - 1)
            logits, _ = net.run(gates, at)
            np.maximum.at(out, text[start : start + AT_ONCE], logits)
    return np.where(words.counts > 0, sigmoid(out), 0.0)


def score(df: DataFrame, net: Net | float, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, score) of every row; the network travels with the task and has a fixed size."""
    sent = df.sparkSession.sparkContext.broadcast(net)

    def run(part: pa.RecordBatch):
        return {"id": part.column("id"), "score": score_texts(sent.value, part.column("text"))}

    return map_slices(keyed_text(df, key, text), run, "id long, score double")


def clean(df: DataFrame, net: Net | float, threshold: float = 0.7, text: str = "text") -> DataFrame:
    """The rows that score below ``threshold``, all columns as they are."""
    sent = df.sparkSession.sparkContext.broadcast(net)
    return filter_slices(df, lambda part: score_texts(sent.value, part.column(part.schema.get_field_index(text))) < threshold, text)
