"""Language identification by hyperdimensional profiles.

Every letter owns a random vector of +1 and -1 drawn from its code point. A trigram is bound by multiplying its
letters' vectors, each permuted (rolled) by its place; a text bundles (adds) its trigrams; a language prototype
bundles the texts known to be in it, each text with weight one. A text gets the language whose prototype has
the largest cosine. Letters are lower-cased, every run of other characters is one space.

All labelled rows are used: prototypes are sums built inside the tasks and added by an aggregate; what the
driver receives is one vector per language. Rows: null texts and texts without a letter are ``und`` with score
0; null labels are not learned from; ties go to the language first in order; without any labelled row all are
``und``. Null ids and repeated rows are kept, other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import filter_slices, keyed_text, map_slices

DIMS = 1024
UNKNOWN = "und"
SEED = 20
KEEP = 24_000  # trigram vectors remembered by a worker
BLOCK = 8192  # distinct trigrams worked on at once

_LETTER: list[np.ndarray] = []
_VECTORS: dict[int, np.ndarray] = {}
_TRIGRAMS: dict[int, int] = {}
_BOUND = np.zeros((0, DIMS), dtype=np.int8)


def letters() -> np.ndarray:
    """Which code points are letters."""
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000))
    return _LETTER[0]


def letter_vector(code: int) -> np.ndarray:
    if code not in _VECTORS:
        _VECTORS[code] = np.random.default_rng([SEED, code]).integers(0, 2, DIMS, dtype=np.int8) * np.int8(2) - np.int8(1)
    return _VECTORS[code]


def bind(trigrams: np.ndarray) -> np.ndarray:
    """Vectors of trigrams, packed as three code points of 21 bits."""
    global _BOUND
    new = [t for t in trigrams.tolist() if t not in _TRIGRAMS]
    if len(_TRIGRAMS) + len(new) > KEEP:
        _TRIGRAMS.clear()
        _BOUND = _BOUND[:0]
        new = trigrams.tolist()
    if new:
        grown = np.empty((len(_BOUND) + len(new), DIMS), dtype=np.int8)
        grown[: len(_BOUND)] = _BOUND
        for k, t in enumerate(new, len(_BOUND)):
            a, b, c = t >> 42, t >> 21 & 0x1FFFFF, t & 0x1FFFFF
            grown[k] = np.roll(letter_vector(a), 2) * np.roll(letter_vector(b), 1) * letter_vector(c)
            _TRIGRAMS[t] = k
        _BOUND = grown
    return _BOUND[[_TRIGRAMS[t] for t in trigrams.tolist()]]


def trigrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct trigrams, for each occurrence its place among them, and its text)."""
    lowered = [(t or "").lower() for t in texts]
    codes = np.frombuffer(("\n" + "\n".join(lowered) + "\n").encode("utf-32-le"), dtype=np.uint32)
    lengths = np.fromiter((len(t) + 1 for t in lowered), dtype=np.int64, count=len(lowered))
    owner = np.repeat(np.arange(len(lowered)), lengths)
    owner = np.concatenate((owner, owner[-1:]))
    letter = letters()[codes]
    bound = np.zeros(len(codes), dtype=bool)  # the first character of every text's share, so that no run spans two texts
    bound[np.concatenate(([0], np.cumsum(lengths)))[:-1]] = True
    keep = letter | bound | np.concatenate(([True], letter[:-1]))
    packed = np.where(letter, codes, 32)[keep].astype(np.int64)
    owner = owner[keep]
    if len(packed) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    same = (owner[:-2] == owner[2:]) | (packed[2:] == 32) & (owner[:-2] == owner[1:-1])
    some = same & (packed[1:-1] != 32) | same & (packed[:-2] != 32) & (packed[2:] != 32)
    used = np.zeros(0x110000, dtype=bool)
    used[packed] = True
    alphabet = np.flatnonzero(used)
    size = len(alphabet)
    short = np.zeros(0x110000, dtype=np.int64)
    short[alphabet] = np.arange(size)
    small = short[packed]
    grams = ((small[:-2] * size + small[1:-1]) * size + small[2:])[some]
    if size <= 128:  # few letters: a table over all possible trigrams instead of a sort
        seen = np.zeros(size**3, dtype=np.int32)
        seen[grams] = 1
        distinct = np.flatnonzero(seen)
        seen[distinct] = np.arange(len(distinct))
        place = seen[grams]
    else:
        distinct, place = np.unique(grams, return_inverse=True)
    a, b, c = alphabet[distinct // size // size], alphabet[distinct // size % size], alphabet[distinct % size]
    return a << 42 | b << 21 | c, place, owner[:-2][some]


def bundled(place: np.ndarray, group: np.ndarray, weights: np.ndarray | None, found: np.ndarray, groups: int) -> np.ndarray:
    """Sums of trigram vectors by group, worked on in blocks of distinct trigrams: memory is a block's vectors and its
    counts, however many different trigrams a text has."""
    if len(found) <= BLOCK:
        counts = np.bincount(group * len(found) + place, weights=weights, minlength=groups * len(found)).reshape(groups, -1)
        return counts.astype(np.float32) @ bind(found).astype(np.float32)
    order = np.argsort(place, kind="stable")
    place, group, weights = place[order], group[order], None if weights is None else weights[order]
    out = np.zeros((groups, DIMS), dtype=np.float32)
    for first in range(0, len(found), BLOCK):
        last = min(first + BLOCK, len(found))
        a, b = np.searchsorted(place, (first, last))
        counts = np.bincount(group[a:b] * (last - first) + place[a:b] - first, weights=None if weights is None else weights[a:b], minlength=groups * (last - first)).reshape(groups, -1)
        out += counts.astype(np.float32) @ bind(found[first:last]).astype(np.float32)
    return out


def has_letter(texts: list[str | None]) -> list[bool]:
    return [any(map(str.isalpha, t)) if t else False for t in texts]


def learn(df: DataFrame, label: str = "lang", text: str = "text") -> dict[str, np.ndarray]:
    """Unit prototypes by language, from all rows with a text and a label."""
    rows = df.select(F.col(f"`{text}`").cast("string").alias("text"), F.col(f"`{label}`").cast("string").alias("label")).where("text is not null and label is not null")

    def run(part: pa.RecordBatch):
        labels = part.column("label").to_pylist()
        names = sorted(set(labels))
        of = np.array([names.index(x) for x in labels])
        found, place, owner = trigrams(part.column("text").to_pylist())
        if not len(found):
            return None
        per_text = np.bincount(owner, minlength=len(of))
        return {"label": names, "bundle": list(bundled(place, of[owner], 1.0 / per_text[owner], found, len(names)).astype(np.float64))}

    parts = map_slices(rows, run, "label string, bundle array<double>")
    sums = parts.select("label", F.posexplode("bundle").alias("at", "x")).groupBy("label", "at").agg(F.sum("x").alias("x"))
    out: dict[str, np.ndarray] = {}
    for r in sums.collect():  # DIMS numbers per language
        out.setdefault(r["label"], np.zeros(DIMS))[r["at"]] = r["x"]
    return {k: (v / (np.linalg.norm(v) or 1)).astype(np.float32) for k, v in sorted(out.items())}


def classify(texts: list[str | None], names: list[str], matrix: np.ndarray | None) -> tuple[list[str], np.ndarray]:
    """Language and score of each text."""
    known = np.array(has_letter(texts), dtype=bool)
    if matrix is None:
        return [UNKNOWN] * len(texts), np.zeros(len(texts))
    found, place, owner = trigrams(texts)
    cosines = np.zeros((len(texts), len(names)))
    if len(found):
        bundles = bundled(place, owner, None, found, len(texts))
        size = np.linalg.norm(bundles, axis=1, keepdims=True)
        cosines = (bundles / np.where(size > 0, size, 1)) @ matrix
    best = cosines.argmax(axis=1)
    score = np.where(known, np.clip(cosines[np.arange(len(texts)), best], 0, 1), 0.0)
    return [names[b] if k else UNKNOWN for b, k in zip(best, known)], score.astype(np.float64)


def predict(df: DataFrame, prototypes: dict[str, np.ndarray], key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, lang_pred, score): score is the cosine, not below 0."""
    names = list(prototypes)
    matrix = np.stack([prototypes[n] for n in names], axis=1) if names else None

    def run(part: pa.RecordBatch):
        found, score = classify(part.column("text").to_pylist(), names, matrix)
        return {"id": part.column("id"), "lang_pred": found, "score": score}

    return map_slices(keyed_text(df, key, text), run, "id long, lang_pred string, score double", rows=256)


def known_language(df: DataFrame, prototypes: dict[str, np.ndarray], text: str = "text") -> DataFrame:
    """The rows whose text has a letter, all columns as they are: a text with letters always gets the nearest language, however
    small the cosine, and is kept too where no language was learned."""
    names = list(prototypes)
    matrix = np.stack([prototypes[n] for n in names], axis=1) if names else None

    def keep(part: pa.RecordBatch):
        texts = part.column(part.schema.get_field_index(text)).to_pylist()
        if matrix is None:
            return np.array(has_letter(texts), dtype=bool)
        found, _ = classify(texts, names, matrix)
        return np.array([f != UNKNOWN for f in found], dtype=bool)

    return filter_slices(df, keep, text, rows=256)
