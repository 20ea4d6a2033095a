"""Hashing of words and shingles, components, BPE, licenses, languages."""

import hashlib
import random
import re
import struct

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.conftest import ODD
from tickloom.llm import bpe, langid, licenses
from tickloom.llm.common import distinct_by_owner, shingles_of, slices, words_of
from tickloom.llm.graph import components
from tickloom.llm.queries import tokenizer_path


def test_words_are_those_of_a_plain_split():
    texts = ["A b  c\n\x0bd", "", None, "ä Ä a", "B B", "\x1cb\x1c b"]
    hashes, counts = words_of(pa.array(texts))
    plain = [(t or "").encode().lower().split() for t in texts]
    assert counts.tolist() == [len(p) for p in plain]
    names = [w for p in plain for w in p]
    seen = {}
    for h, w in zip(hashes.tolist(), names):
        assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


def test_shingles_match_a_plain_version():
    rng = random.Random(1)
    texts = [" ".join(rng.choice("abcde") for _ in range(rng.randint(0, 30))) for _ in range(200)]
    h, _, owner = shingles_of(pa.array(texts), 3)
    h, at = distinct_by_owner(h, owner, len(texts))
    names = {}
    for i, t in enumerate(texts):
        w = t.split()
        want = {tuple(w[j : j + 3]) for j in range(len(w) - 2)} if len(w) >= 3 else ({tuple(w)} if w else set())
        assert at[i + 1] - at[i] == len(want)
        names[i] = (set(h[at[i] : at[i + 1]].tolist()), want)
    for i in range(0, 200, 7):
        for j in range(0, 200, 11):
            assert len(names[i][0] & names[j][0]) == len(names[i][1] & names[j][1])


def test_slices_keep_all_rows_and_long_texts_whole():
    batch = pa.RecordBatch.from_arrays([pa.array(["x" * n for n in (5, 5_000_000, 1, 2, 3)] + [None])], names=["text"])
    parts = list(slices(iter([batch, batch.slice(0, 0)]), limit=10, rows=2))
    assert [t for p in parts for t in p.column(0).to_pylist()] == batch.column(0).to_pylist()
    assert max(p.num_rows for p in parts) <= 2


def test_components_match_union_find(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(70)] + [(7, 7), (None, 3)]
    parent = list(range(1200))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {x: root(x) for e in edges if None not in e for x in e if root(x) != x}
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    t.no_truncation()
    t.no_padding()
    return t


def test_bpe_equals_the_library(spark, docs, library):
    rng = random.Random(3)
    odd = ["It's we'll DON'T İstanbul ΣΑΣ ½", "<|endoftext|> a <|startoftext|>b", "a" * 3000, "?!" * 200, "\x1c\x85b\xa0c d👍🏽", "".join(chr(rng.randrange(32, 0x2FFF)) for _ in range(500))]
    rows = ODD + [(100 + i, t) for i, t in enumerate(odd)]
    got = sorted((r["id"] is None, r["id"] or 0, r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.digests(docs(rows), tokenizer_path()).collect())
    want = []
    for i, t in rows:
        e = library.encode(t or "", add_special_tokens=False).ids
        shown = library.decode(e, skip_special_tokens=False)
        want.append((i is None, i or 0, len(e), hashlib.sha256(struct.pack(f"<{len(e)}I", *e)).hexdigest(), hashlib.sha256(shown.encode()).hexdigest()))
    assert got == sorted(want)
    full = bpe.encode(docs(rows[-6:]), tokenizer_path()).collect()
    assert all(r["ids"] == library.encode(t, add_special_tokens=False).ids and r["decoded"] == library.decode(r["ids"], skip_special_tokens=False) for r, (_, t) in zip(sorted(full), rows[-6:]))
    assert bpe.digests(docs([]), tokenizer_path()).count() == 0


def test_forced_boundaries_cut_only_where_no_token_reaches():
    c = bpe.codec(tokenizer_path())
    for word in ("zzqxjk", "hello", "xq'", "日本語"):
        parts = list(c.fragments(word))
        assert sum(map(len, parts)) == len(word.encode())
        assert tuple(i for p in parts for i in c._merge(p)) == c._merge(tuple(s for p in parts for s in p))


def test_license_join_equals_brute_force(spark, docs):
    rng = random.Random(4)
    words = sorted({w for t in licenses.TEMPLATES.values() for w in t.split()}) + ["x", "y", "z"]
    rows = []
    for i in range(300):
        lines = []
        for _ in range(rng.randint(0, 4)):
            t = rng.choice([*licenses.TEMPLATES.values(), *licenses.PHRASES, "plain words only"]).split()
            lines.append(" ".join(rng.choice(words) if rng.random() < 0.15 else w for w in t).title())
        rows.append((i, "\n".join(lines)))
    got = {r["id"]: r for r in licenses.scan(docs(rows)).collect()}
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    for i, t in rows:
        low = t.lower()
        all_words = word.findall(low)
        places = [(k, label) for p, label in licenses.PHRASES.items() for k in range(len(all_words)) if all_words[k : k + len(p.split())] == p.split()]
        found = {label for _, label in places}
        best = 0.0
        for line in low.split("\n"):
            have = set(word.findall(line))
            for label, t2 in licenses.TEMPLATES.items():
                share = len(have & set(t2.split())) / len(set(t2.split()))
                if share >= licenses.THRESHOLD - 1e-9:
                    found.add(label)
                    best = max(best, share)
        r = got[i]
        assert (r["n_words"], r["n_base"], r["labels"]) == (len(all_words), len(places), ",".join(sorted(found)))
        assert (r["first_word"], r["last_word"]) == ((min(places)[0], max(places)[0]) if places else (None, None))
        assert abs(r["score"] - (1.0 if places else best)) < 1e-12
    odd = licenses.scan(docs(ODD)).collect()
    assert len(odd) == len(ODD) and all(r["labels"] == "" and r["score"] == 0 for r in odd)
    assert licenses.scan(docs([])).count() == 0


def test_languages(spark, docs):
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("the cat and the dog sat there", "en"), ("der hund und die katze sind hier", "de"), ("el perro y la casa son grandes", "es")] * 20)]
    protos = langid.learn(docs(rows))
    assert list(protos) == ["de", "en", "es"]
    again = langid.learn(docs(rows).repartition(7))
    assert all(np.allclose(protos[k], again[k], atol=1e-6) for k in protos)
    found = {r["id"]: r for r in langid.predict(docs([(1, "the dog and cat"), (2, "die katze und der hund"), (3, "la casa y el perro")]), protos).collect()}
    assert [found[i]["lang_pred"] for i in (1, 2, 3)] == ["en", "de", "es"]
    odd = langid.predict(docs(ODD), protos).collect()
    assert len(odd) == len(ODD) and sorted(r["id"] for r in odd if r["lang_pred"] == "und") == [1, 2, 3, 8]
    assert all(0 <= r["score"] <= 1 for r in odd)
    nothing = langid.learn(docs([(1, "text without a label")]))
    assert nothing == {} and [r["lang_pred"] for r in langid.predict(docs([(1, "text")]), nothing).collect()] == ["und"]
    kept = langid.known_language(docs(ODD), protos)
    assert kept.columns == docs([]).columns and kept.count() == len(ODD) - 4


def test_trigrams_do_not_span_texts():
    found, place, owner = langid.trigrams(["ab", "", "c", None, "1 2"])
    shown = {(o, "".join(chr(int(found[p]) >> s & 0x1FFFFF) for s in (42, 21, 0))) for p, o in zip(place, owner)}
    assert {t for o, t in shown if o == 0} == {" ab", "ab "} and {t for o, t in shown if o == 2} == {" c "}
    assert {o for o, _ in shown} == {0, 2}
