import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tickloom.llm import divergence, exact_dedup

from .conftest import ODD

WHITE = re.compile(r"[\x20\x09-\x0D]")


def plain_duplicates(rows):
    """(id, keep_id, group_size, sha) of every row and, per group, that one row stays."""
    groups = defaultdict(list)
    for r in rows:
        groups[WHITE.sub("", r[1] or "")].append(r)
    out, kept = [], {}
    for body, members in groups.items():
        keep = min(members, key=lambda r: (-len(r[1] or ""), r[0] is None, r[0] or 0))[0]
        sha = hashlib.sha256(body.encode()).hexdigest()
        kept[sha] = keep
        out += [(r[0], keep, len(members), sha) for r in members]
    return sorted(out, key=str), kept


def check_duplicates(docs, rows, **how):
    found = exact_dedup.duplicates(docs(rows), **how).collect()
    want, kept = plain_duplicates(rows)
    assert sorted(((r.id, r.keep_id, r.group_size, r.text_sha256) for r in found), key=str) == want
    assert Counter(r.text_sha256 for r in found if r.kept) == Counter(dict.fromkeys(kept, 1))
    assert all(r.id == r.keep_id for r in found if r.kept)


def test_duplicates_of_odd_rows(docs):
    check_duplicates(docs, ODD + [(10, "wo rd"), (11, "w ord\n"), (None, " word"), (12, " ")])
    check_duplicates(docs, [])


def test_no_break_space_is_text(docs):
    check_duplicates(docs, [(1, "a b"), (2, "ab"), (3, "a b"), (4, "a\x1fb"), (5, "a\x0bb")])


@pytest.mark.parametrize("digest", [lambda b: b"one", lambda b: bytes([len(b) % 3])])
def test_collisions_split_groups(docs, digest):
    rows = [(i, f"text {i % 7}" + " " * (i % 4)) for i in range(60)] + [(5, "text 5"), (5, "text 5")]
    check_duplicates(docs, rows, digest=digest)


def test_a_large_group_is_dealt_out(docs, monkeypatch):
    monkeypatch.setattr(exact_dedup, "ROWS_A_TASK", 8)
    check_duplicates(docs, [(i, "the same text" if i % 3 else f"own {i}") for i in range(300)])


TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def plain_audit(rows, least):
    counts, docs_of, groups = defaultdict(Counter), defaultdict(Counter), set()
    for r in rows:
        r = [*r, None, None][:4]
        text, lang, source = (x or "" for x in r[1:4])
        groups.add((lang, source))
        terms = TERM.findall(text.translate(LOWER))
        counts[lang, source].update(terms)
        docs_of[lang].update(set(terms))
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in docs_of[lang].items() if n >= least]
        sources = sorted(s for a, s in groups if a == lang)
        share = {}
        for s in [*sources, None]:
            n = {t: counts[lang, s][t] if s is not None else sum(counts[lang, x][t] for x in sources) for t in kept}
            total = sum(n.values()) + 2 * len(kept)
            share[s] = {t: 1 + 10**9 * (n[t] + 2) // total for t in kept}
        for s in sources:
            pairs = [(o, sum((share[s][t] - share[o][t]) ** 2 // (share[s][t] + share[o][t]) for t in kept)) for o in sources if o != s]
            own = [t for t in kept if counts[lang, s][t] and share[s][t] > share[None][t]]
            terms = [(t, (share[s][t] - share[None][t]) ** 2 // (share[s][t] + share[None][t])) for t in own]
            for part, items in (("pair", pairs), ("term", terms)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, x, v, k) for k, (x, v) in enumerate(items, 1) if part == "pair" or k <= 10]
    return sorted(out)


def check_audit(docs, rows, least, **how):
    found = divergence.audit(docs(rows), least_docs=least, **how)
    assert found.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(tuple(r) for r in found.collect()) == plain_audit(rows, least)


def made_rows(n=200, seed=4):
    rng = np.random.default_rng(seed)
    words = [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(8) for j in range(8)] + ["Ärger", "naïve", "日本", "ÉCLAIR", "x"]
    rows = []
    for i in range(n):
        pick = rng.choice(len(words), int(rng.integers(0, 40)), p=(p := rng.dirichlet(np.ones(len(words)) * 0.1)) / p.sum())
        rows.append((i, " ".join(words[k].upper() if k % 5 == 0 else words[k] for k in pick) + "1,2", ["en", "de", None, "rare"][0 if i % 3 else i % 4], f"s{i % 7}" if i % 11 else None))
    return rows


@pytest.mark.parametrize("how", [{}, {"shard": 5}])
def test_audit_equals_a_plain_count(docs, how):
    check_audit(docs, made_rows(), 10, **how)


def test_audit_with_blocks_of_sources(docs, monkeypatch):
    monkeypatch.setattr(divergence, "BLOCK", 3)
    rows = [(i, f"aa bb{chr(97 + i % 9)} " * (i % 5), "en", f"s{i % 11}") for i in range(90)]
    counts = Counter((r[3], t) for r in rows for t in r[1].split())
    sources = sorted({r[3] for r in rows})
    total = {s: sum(n for (a, _), n in counts.items() if a == s) for s in sources}
    terms = len({t for _, t in counts})
    left = pa.table({"lang": ["en"] * len(counts), "source": [s for s, _ in counts], "term": [t for _, t in counts], "n": list(counts.values())})
    right = pa.table({"lang": ["en"] * len(sources), "source": sources, "total": [total[s] for s in sources], "v": [terms] * len(sources), "of_lang": [sum(total.values())] * len(sources)})
    found = divergence._shard_sums(left, right).to_pylist()
    want = {(r[1], r[2], r[3]): r[4] for r in plain_audit(rows, 1)}
    assert {(r["source"], r["part"], r["item"]): r["value"] for r in found} == want


def test_audit_of_odd_rows(docs):
    check_audit(docs, ODD, 1)
    check_audit(docs, ODD, 10)
    check_audit(docs, [], 1)


def test_shares_beyond_64_bits():
    count, total = np.array([7 * 10**14, 3]), np.array([8 * 10**15, 8 * 10**15])
    assert divergence.share(count, total).tolist() == [1 + 10**9 * int(c) // int(t) for c, t in zip(count, total)]
