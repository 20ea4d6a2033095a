"""License scan: base phrases, and an exact set-similarity join of text blocks with license templates.

A block (line) matches a template when at least ``threshold`` of the template's distinct words stand in it. The
words of all templates are put in one global order, rarest in the corpus first. A block that reaches the
threshold must hold one of the template's first ``size - needed + 1`` words (prefix filter), at least ``needed``
words (length filter), and where the first shared word stands in both orders must leave room for ``needed``
shared words (positional filter). What passes is counted exactly, so the filters never lose a match.

A notice wrapped over several lines is found by windows of the words of a paragraph (lines up to one without words):
``SLACK`` times as long as the template, one at every word of it (long templates: at every 32nd part). A window
matches when the same share of distinct words stands in it and as large a share of the template's words in order, so
that pieces of different notices do not add up. The paragraph passes the filters above first, and windows are taken
only for templates that no line of the text reaches.

Templates are a parameter of checked size that travels with the task; word frequencies are counted over all
texts by an aggregate of one row per template word. Rows: null texts are empty; empty texts have no words, no
labels, score 0 and null places; null ids and repeated rows are kept; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import keyed_text, map_slices

# Phrases the base scan must find, and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
# Templates of license notices and permission texts (public wording), by the label they give.
TEMPLATES = {
    "apache-2.0": "licensed under the apache license version 2 0",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "cc-by-nc-4.0": "licensed under cc by nc 4 0",
    "gpl-3.0": "this work is licensed under the gnu general public license version 3",
    "isc": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    "mit-notice": "released under the mit license",
    "mit-text": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
}
THRESHOLD = 0.8
SLACK = 1.1  # words of a window by words of its template: a notice may have a few words between its own
MAX_TEMPLATE_BYTES = 8 << 20

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_IS_WORD = np.zeros(256, dtype=bool)
_IS_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


def lowered(text: str | None) -> bytes:
    """UTF-8 with A-Z in lower case and nothing else changed."""
    return (text or "").encode("utf-8").lower()


def needed(size: int, threshold: float) -> int:
    return max(1, math.ceil(threshold * size - 1e-9))


def word_counts(df: DataFrame, vocabulary: set[bytes]) -> dict[bytes, int]:
    """How often each template word stands in the corpus."""

    def run(part: pa.RecordBatch):
        seen = Counter(_WORD.findall(b"\n".join(map(lowered, part.column("text").to_pylist()))))
        some = {w: seen[w] for w in vocabulary if w in seen}
        return {"word": [w.decode() for w in some], "n": list(some.values())}

    rows = map_slices(df, run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()  # a row per template word
    return {r["word"].encode(): r["n"] for r in rows}


class Wrapped:
    """A template in its own order, to be found in windows of a paragraph."""

    def __init__(self, words: list[int], threshold: float):
        self.words, self.distinct = len(words), len(set(words))
        self.least, self.in_order = needed(self.distinct, threshold), needed(self.words, threshold)
        self.step = max(1, self.words // 32)
        self.window = math.ceil(SLACK * self.words) + self.step - 1
        self.places: dict[int, int] = {}
        for k, w in enumerate(words):
            self.places[w] = self.places.get(w, 0) | 1 << k

    def common(self, window: list[int | None]) -> int:
        """Length of the longest common subsequence with the template, by bits."""
        every = (1 << self.words) - 1
        open_ = every
        for w in window:
            met = open_ & self.places.get(w, 0)
            open_ = ((open_ + met) | (open_ - met)) & every
        return self.words - open_.bit_count()

    def find(self, ranks: list[int | None]) -> tuple[float, int] | None:
        """(share of distinct words, first word) of the best matching window, the first of equal ones."""
        best = None
        held: Counter = Counter()
        end = 0
        for start in range(0, len(ranks), self.step):
            while end < min(start + self.window, len(ranks)):
                if ranks[end] in self.places:
                    held[ranks[end]] += 1
                end += 1
            if len(held) >= self.least and (best is None or len(held) > best[0]) and self.common(ranks[start:end]) >= self.in_order:
                best = len(held), start
                if len(held) == self.distinct:
                    break
            for w in ranks[start : start + self.step]:
                if w in held:
                    held[w] -= 1
                    if not held[w]:
                        del held[w]
        return best and (best[0] / self.distinct, best[1])


class Join:
    """The templates in global order with their prefixes indexed."""

    def __init__(self, templates: dict[str, str], counts: dict[bytes, int], threshold: float):
        order = sorted({w for t in templates.values() for w in _WORD.findall(lowered(t))}, key=lambda w: (counts.get(w, 0), w))
        self.rank = {w: k for k, w in enumerate(order)}
        self.templates, self.prefix, self.wrapped = [], {}, {}
        for label in sorted(templates):
            words = sorted({self.rank[w] for w in _WORD.findall(lowered(templates[label]))})
            if not words:
                continue
            least = needed(len(words), threshold)
            for place, word in enumerate(words[: len(words) - least + 1]):
                self.prefix.setdefault(word, []).append((len(self.templates), place))
            self.templates.append((label, frozenset(words), least))
            self.wrapped[label] = Wrapped([self.rank[w] for w in _WORD.findall(lowered(templates[label]))], threshold)
        self.starts = [order[k] for k in self.prefix]

    def block(self, words: list[bytes]) -> dict[str, float]:
        """Label and containment of every template that the block reaches."""
        ranks = sorted({self.rank[w] for w in words if w in self.rank})
        found, tried = {}, set()
        for at, word in enumerate(ranks):
            for k, place in self.prefix.get(word, ()):
                if k in tried:
                    continue
                tried.add(k)  # the first shared word decides: all others come later in both orders
                label, all_words, least = self.templates[k]
                if len(ranks) < least or min(len(all_words) - place, len(ranks) - at) < least:
                    continue
                shared = len(all_words.intersection(ranks))
                if shared >= least:
                    found[label] = shared / len(all_words)
        return found

    def paragraph(self, words: list[bytes], reached: set[str]) -> dict[str, tuple[float, int]]:
        """Label, containment and first word of the best window of every further template."""
        labels = self.block(words).keys() - reached
        ranks = [self.rank.get(w) for w in words] if labels else []
        some = {label: self.wrapped[label].find(ranks) for label in sorted(labels)}
        return {label: x for label, x in some.items() if x}


def scan(df: DataFrame, key: str = "doc_id", text: str = "text", phrases: dict[str, str] | None = None, templates: dict[str, str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """(id, n_words, n_base, first_word, last_word, base_labels, labels, score, blocks): ``blocks`` lists the
    (first) line and label of every matching block or window; score is the largest containment, 1 where a base phrase stands."""
    phrases = PHRASES if phrases is None else phrases
    templates = TEMPLATES if templates is None else templates
    if sum(len(t) for t in templates.values()) > MAX_TEMPLATE_BYTES:
        raise ValueError("templates do not fit a task; scan them in several calls")
    rows = keyed_text(df, key, text)
    vocabulary = {w for t in templates.values() for w in _WORD.findall(lowered(t))}
    join = Join(templates, word_counts(rows, vocabulary), threshold)
    wanted = [(_WORD.findall(lowered(p)), label) for p, label in sorted(phrases.items())]

    def look(data: bytes) -> tuple:
        words, blocks, bounds, paragraphs = [], [], [], [[]]
        for number, line in enumerate(data.split(b"\n")):
            some = _WORD.findall(line)
            words += some
            blocks += [(number, label, c) for label, c in join.block(some).items()]
            if some:
                paragraphs[-1].append((number, some))
            elif paragraphs[-1]:
                paragraphs.append([])
        reached = {label for _, label, _ in blocks}
        for lines in paragraphs:
            if len(lines) > 1:
                numbers = [number for number, some in lines for _ in some]
                blocks += [(numbers[at], label, c) for label, (c, at) in join.paragraph([w for _, some in lines for w in some], reached).items()]
        base = set()
        places: list[int] = []
        for phrase, label in wanted:
            first, n = phrase[0], len(phrase)
            at = -1
            while True:
                try:
                    at = words.index(first, at + 1)
                except ValueError:
                    break
                if words[at : at + n] == phrase:
                    places.append(at)
                    base.add(label)
        bounds = (min(places), max(places)) if places else (None, None)
        score = 1.0 if places else max((c for _, _, c in blocks), default=0.0)
        labels = sorted(base | {label for _, label, _ in blocks})
        return len(places), *bounds, ",".join(sorted(base)), ",".join(labels), score, [{"line": n, "label": label} for n, label, _ in blocks]

    nothing = (0, None, None, "", "", 0.0, [])

    def run(part: pa.RecordBatch):
        texts = list(map(lowered, part.column("text").to_pylist()))
        joined = np.frombuffer(b" ".join([b"", *texts]), dtype=np.uint8)
        word = _IS_WORD[joined]
        begins = np.concatenate(([0], np.cumsum(word[1:] & ~word[:-1])))
        ends = np.cumsum([len(t) + 1 for t in texts]) - 1
        counts = np.diff(np.concatenate(([0], begins[ends])))
        out = []
        for t in texts:
            likely = any(w in t for w in join.starts) or any(all(w in t for w in p) for p, _ in wanted)
            out.append(look(t) if likely else nothing)
        n, first, last, base, labels, score, blocks = map(list, zip(*out))
        return {"id": part.column("id"), "n_words": counts, "n_base": n, "first_word": first, "last_word": last, "base_labels": base, "labels": labels, "score": score, "blocks": blocks}

    schema = "id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, blocks array<struct<line: long, label: string>>"
    return map_slices(rows, run, schema)
