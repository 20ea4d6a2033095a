"""BPE encoding and decoding with forced boundaries.

A merge only ever builds a vocabulary token. So where two neighbouring bytes stand inside no token at all, no
merge can cross, and the text may be cut there with certainty. Words are cut at all such places, every
fragment is merged on its own (once per distinct fragment), and the results are concatenated.

Rows: null or empty texts encode to no tokens; repeated rows give repeated results; null ids are kept; other
columns are ignored. A text of any length is encoded whole; merging a fragment takes n log n steps.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import struct
import unicodedata
from collections.abc import Iterable

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tickloom.llm.common import keyed_text, map_slices

WORD_END = "</w>"
KEEP_WORDS = 400_000  # words and fragments remembered by a worker before the older half is forgotten

# White space, letters and numbers as the vocabulary's own pattern means them.
_SPACE = "\t-\r \x85\xa0  -     　"
_ANY = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^" + _SPACE + r"\p{L}\p{N}]+")
_L, _N = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ɏ", "0-9\xb2\xb3\xb9\xbc-\xbe"
_LATIN = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[{_N}]|[^{_SPACE}{_L}{_N}]+")
_BEYOND_LATIN = re.compile("[^\x00-ɏ]")


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies (a public convention): printable
    Latin-1 characters stand for themselves, the others follow from 256 upwards."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = {b: chr(b) for b in shown}, 256
    for b in range(256):
        if b not in out:
            out[b] = chr(extra)
            extra += 1
    return [out[b] for b in range(256)]


class Remembered(dict):
    """A mapping that works out missing values and forgets all when it grows past a bound."""

    def __init__(self, make, most: int = KEEP_WORDS):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, key):
        if len(self) >= self.most:
            for old in list(self)[: self.most // 2]:
                del self[old]
        value = self[key] = self.make(key)
        return value


class Codec:
    """Encoder and decoder of one vocabulary file (word-end BPE over byte letters)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in [*self.ids.items(), *self.special.items()]}
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.rank = {p: k for k, p in enumerate(pairs)}
        self.letters = byte_letters()
        self._split_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.inside = self._pairs_inside()
        self.fragment = Remembered(self._merge)
        self.word = Remembered(self._word)
        self.both = Remembered(self._both)

    def _pairs_inside(self) -> set[tuple[str, str]]:
        """Every pair of neighbouring symbols inside some token; the last symbol of a word carries the word end."""
        out = set()
        for token in self.ids:
            ends = token.endswith(WORD_END)
            s = list(token.removesuffix(WORD_END))
            if ends and s:
                s[-1] += WORD_END
            out.update(zip(s, s[1:]))
        return out

    def fragments(self, word: str) -> Iterable[tuple[str, ...]]:
        """The symbols of a word, cut where no token has the two neighbours inside."""
        s = [self.letters[b] for b in word.encode("utf-8")]
        if not s:
            return
        s[-1] += WORD_END
        start = 0
        for i in range(1, len(s)):
            if (s[i - 1], s[i]) not in self.inside:
                yield tuple(s[start:i])
                start = i
        yield tuple(s[start:])

    def _merge(self, symbols: tuple[str, ...]) -> tuple[int, ...]:
        """Merge the best-ranked neighbours, the leftmost first, until none is left."""
        s = list(symbols)
        if len(s) <= 48:
            rank, never = self.rank.get, 1 << 60
            ranks = [rank(p, never) for p in zip(s, s[1:])]
            while ranks and (best := min(ranks)) < never:
                at = ranks.index(best)
                s[at : at + 2] = [s[at] + s[at + 1]]
                del ranks[at]
                if at:
                    ranks[at - 1] = rank((s[at - 1], s[at]), never)
                if at < len(ranks):
                    ranks[at] = rank((s[at], s[at + 1]), never)
            return tuple(self.ids[x] for x in s)
        after, before = list(range(1, len(s))) + [-1], list(range(-1, len(s) - 1))
        heap = [(self.rank[p], i, *p) for i, p in enumerate(zip(s, s[1:])) if p in self.rank]
        heapq.heapify(heap)
        while heap:
            _, i, left, right = heapq.heappop(heap)
            j = after[i]
            if s[i] != left or j < 0 or s[j] != right:
                continue
            s[i], s[j] = left + right, None
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b >= 0 and (s[a], s[b]) in self.rank:
                    heapq.heappush(heap, (self.rank[s[a], s[b]], a, s[a], s[b]))
        return tuple(self.ids[x] for x in s if x is not None)

    def _word(self, word: str) -> tuple[int, ...]:
        if word in self.special:
            return (self.special[word],)
        cut = list(self.fragments(word))
        return self._merge(cut[0]) if len(cut) == 1 else tuple(i for f in cut for i in self.fragment[f])

    def _both(self, word: str) -> tuple[bytes, str]:
        """The ids as little-endian 32-bit integers, and the decoded tokens."""
        ids = self._word(word)
        return struct.pack(f"<{len(ids)}I", *ids), " ".join(map(self.tokens.__getitem__, ids))

    def words(self, text: str) -> list[str]:
        """The pieces of a text that are encoded one by one: composed, lower-cased, without white space."""
        out: list[str] = []
        for part in self._split_special.split(text) if self._split_special and "<|" in text else (text,):
            if part in self.special:
                out.append(part)
                continue
            part = unicodedata.normalize("NFC", part).replace("Σ", "σ").lower()
            out += (_ANY if _BEYOND_LATIN.search(part) else _LATIN).findall(part)
        return out

    def encode(self, text: str | None) -> list[int]:
        return [i for w in self.words(text or "") for i in self.word[w]]

    def decode(self, ids: Iterable[int]) -> str:
        """Tokens with a space between them: this vocabulary names no decoder of its own."""
        return " ".join(self.tokens[i] for i in ids)


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """One codec per worker and file."""
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def encode(df: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, ids array<int>, decoded string) of every row."""

    def run(part: pa.RecordBatch):
        c = codec(path)
        words = [c.words(t or "") for t in part.column("text").to_pylist()]
        return {"id": part.column("id"), "ids": [[i for w in ws for i in c.word[w]] for ws in words], "decoded": [c.decode(i for w in ws for i in c.word[w]) for ws in words]}

    return map_slices(keyed_text(df, key, text), run, "id long, ids array<int>, decoded string")


def digests(df: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): the same encoding, hashed inside the task so that the ids of a
    corpus need not leave it."""

    def run(part: pa.RecordBatch):
        c = codec(path)
        counts, ids, shown = [], [], []
        for t in part.column("text").to_pylist():
            both = list(map(c.both.__getitem__, c.words(t or "")))
            packed = b"".join([p for p, _ in both])
            counts.append(len(packed) // 4)
            ids.append(hashlib.sha256(packed).hexdigest())
            shown.append(hashlib.sha256(" ".join([s for _, s in both]).encode("utf-8")).hexdigest())
        return {"id": part.column("id"), "n_tokens": counts, "ids_sha256": ids, "decoded_sha256": shown}

    return map_slices(keyed_text(df, key, text), run, "id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
