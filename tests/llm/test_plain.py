"""Learned operators against plain versions of their own, and their accuracy on held-out rows of the sample tables."""

import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.conftest import ODD
from tickloom.llm import embed_dups, html_wrap, langid, learning, quality, queries, toxicity
from tickloom.llm.common import mix, span_hashes, table

TEXTS = ["some words here that are read by it, one after the other. " * 9, "Other TEXT", "x", "", None, "né 日本 a1_b2", "w " * 25]


def squash(x):
    return 1 / (1 + math.exp(-x))


def plain_toxicity(net, text):
    """Word by word and window by window: two gated units that read in opposite directions, attention, the largest logit."""
    w, h = {k: v.astype(float) for k, v in net.w.items()}, toxicity.HIDDEN
    words = [m.encode() for m in re.findall(r"[0-9A-Za-z\u0080-\U0010FFFF]+", text or "")]
    words = [bytes(b + 32 if 65 <= b <= 90 else b for b in x) for x in words]
    if not words:
        return 0.0
    inputs = []
    for x in words:
        bucket = int(span_hashes(np.frombuffer(x, np.uint8), np.array([0]), np.array([len(x)]))[0] % np.uint64(toxicity.WORD_BUCKETS))
        edged = b"\0" + x + b"\0"
        codes = np.array([edged[i] << 16 | edged[i + 1] << 8 | edged[i + 2] for i in range(len(x))], np.uint64)
        grams = (mix(codes + np.uint64(7)) % np.uint64(toxicity.TRIGRAM_BUCKETS)).astype(int)
        inputs.append(np.concatenate((w["word"][bucket], w["char"][grams].mean(axis=0))) @ w["x"] + w["xb"])

    def read(gates, u, side):
        state, out = np.zeros(h), []
        for g in gates:
            a = g[side * 3 * h : (side + 1) * 3 * h]
            r = state @ u
            z, reset = 1 / (1 + np.exp(-(a[:h] + r[:h]))), 1 / (1 + np.exp(-(a[h : 2 * h] + r[h : 2 * h])))
            new = np.tanh(a[2 * h :] + reset * r[2 * h :])
            state = z * state + (1 - z) * new
            out.append(state)
        return out

    logits, at = [], 0
    while True:
        part = inputs[at : at + toxicity.WINDOW]
        states = np.concatenate((read(part, w["uf"], 0), read(part[::-1], w["ub"], 1)[::-1]), axis=1)
        e = np.exp(states @ w["att"])
        logits.append((e / e.sum()) @ states @ w["out"] + w["bias"][0])
        if at + toxicity.WINDOW >= len(words):
            return squash(max(logits))
        at += toxicity.STEP


def plain_quality(net, text):
    """Every filter at every place of the padded bytes; chunks of two blocks, one begun at every block."""
    w = {k: v.astype(float) for k, v in net.w.items()}
    data, span = (text or "").encode(), quality.BLOCK * quality.STRIDE
    blocks = max(1, -(-len(data) // span))
    padded = data + bytes(blocks * span - len(data) + quality.WIDTH)
    most = []
    for b in range(blocks):
        places = [np.concatenate([w["byte"][x] for x in padded[at : at + quality.WIDTH]]) @ w["conv"] + w["cb"] for at in range(b * span, (b + 1) * span, quality.STRIDE)]
        most.append(np.max(places, axis=0))
    chunks = [np.maximum(most[b] if b + 1 == blocks else np.maximum(most[b], most[b + 1]), 0) for b in range(blocks)]
    hidden = np.tanh(np.array(chunks) @ w["h"] + w["hb"])
    return squash(np.concatenate((hidden.max(axis=0), hidden.mean(axis=0))) @ w["out"] + w["bias"][0])


@pytest.mark.parametrize("module,plain", [(toxicity, plain_toxicity), (quality, plain_quality)])
def test_scores_are_those_of_a_plain_forward_pass(module, plain):
    net = module.Net(5)
    got = module.score_texts(net, pa.array(TEXTS))
    assert got == pytest.approx([plain(net, t) for t in TEXTS], abs=2e-4)


def plain_grams(text):
    """Trigrams of letters, other runs as one space; a trigram is no two spaces side by side."""
    letters = "".join(c if c.isalpha() else " " for c in (text or "").lower())
    padded = " " + " ".join(letters.split()) + " "
    grams = [padded[i : i + 3] for i in range(len(padded) - 2)]
    return [g for g in grams if "  " not in g]


def plain_bundle(text):
    """One vector bound for each trigram, and all of them added."""
    out = np.zeros(langid.DIMS)
    for a, b, c in plain_grams(text):
        out += np.roll(langid.letter_vector(ord(a)), 2).astype(int) * np.roll(langid.letter_vector(ord(b)), 1) * langid.letter_vector(ord(c))
    return out


def test_languages_equal_plain_hypervectors(spark, docs, monkeypatch):
    known = [(i, t, lang) for i, (t, lang) in enumerate([("the cat and the dog sat there", "en"), ("der hund und die katze sind hier", "de"), ("el perro y la casa son grandes", "es"), ("a dog, 2 cats", "en")])]
    plain = {}
    for _, t, lang in known:
        plain[lang] = plain.get(lang, 0) + plain_bundle(t) / len(plain_grams(t))
    plain = {k: v / np.linalg.norm(v) for k, v in sorted(plain.items())}
    learned = langid.learn(docs(known))
    assert all(np.allclose(learned[k], plain[k], atol=1e-5) for k in plain)
    texts = ["The DOG", "la casa", "katze?!", "zzz", "日本 x"]
    cosines = [[float(plain_bundle(t) @ v) / np.linalg.norm(plain_bundle(t)) for v in plain.values()] for t in texts]
    want = {i: (list(plain)[int(np.argmax(c))], max(0.0, max(c))) for i, c in enumerate(cosines)}
    for block in (langid.BLOCK, 7):
        monkeypatch.setattr(langid, "BLOCK", block)
        names = list(learned)
        found, score = langid.classify(texts, names, np.stack([learned[n] for n in names], axis=1))
        assert [(f, round(s, 4)) for f, s in zip(found, score)] == [(want[i][0], round(want[i][1], 4)) for i in range(len(texts))]


def test_many_different_letters_stay_in_bounds():
    import tracemalloc

    rng = np.random.default_rng(1)
    text = "".join(map(chr, rng.integers(0x4E00, 0x9FA5, 400_000)))
    langid.bind(np.zeros(0, np.int64))
    tracemalloc.start()
    langid.classify([text], ["en"], np.ones((langid.DIMS, 1), np.float32))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 300e6


def held_out(spark, sf, target, module, threshold, classes):
    """(share of right ones of each class) on the held-out labelled rows."""
    d = f"/root/testdata/{sf}"
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    net = module.train(*learning.labelled_sample(docs, labels, target, queries.not_held_out(), module.PER_CLASS))
    asked = [(r["text"], r[target]) for r in docs.select("doc_id", "text").join(labels, "doc_id").where(f"{target} is not null").collect() if zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1]
    score = module.score_texts(net, pa.array([t for t, _ in asked]))
    truth = np.array([y for _, y in asked])
    return {c: float(((score >= threshold) == c)[truth == c].mean()) for c in classes}


def test_quality_of_held_out_documents(spark):
    assert min(held_out(spark, "sf0.01", "quality", quality, 0.5, (0, 1)).values()) >= 0.95


def test_toxicity_of_held_out_documents(spark):
    found = held_out(spark, "sf0.1", "toxic", toxicity, 0.7, (0, 1))
    assert found[1] >= 0.85 and found[0] >= 0.95, found


def test_language_of_held_out_documents(spark):
    found = [r for r in queries.op9_language(spark, "/root/testdata/sf0.01").where("held_out").collect()]
    lang = {r["doc_id"]: r["lang"] for r in table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "lang").collect()}
    assert np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in found]) >= 0.98


def test_clean_documents_of_odd_rows(spark, docs):
    net = toxicity.Net(2)
    frame = docs(ODD)
    kept = toxicity.clean(frame, net, 0.7)
    assert kept.columns == frame.columns
    score = {(r["id"]): r["score"] for r in toxicity.score(frame, net).collect()}
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(r[0]) for r in ODD if score[r[0]] < 0.7)
    assert toxicity.clean(docs([]), net).count() == 0 and toxicity.clean(frame, 0.0).count() == len(ODD)


# ---- pages ----


def table_alignment(x, y):
    best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i in range(len(x) - 1, -1, -1):
        for j in range(len(y) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if x[i] == y[j] else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < len(x) and j < len(y):
        if x[i] == y[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def test_alignment_is_that_of_the_whole_table():
    rng = random.Random(1)
    for size in [*[rng.randint(0, 30) for _ in range(300)], 260]:
        a, b = ([rng.choice("abcdefg"[: rng.randint(1, 7)]) for _ in range(size)] for _ in range(2))
        if a != b:
            assert html_wrap._matched([[c] for c in a], [[c] for c in b]) == table_alignment(a, b)


@pytest.mark.parametrize("html,want", [
    ("<div>" * 600 + "<p>deep</p>" + "</div>" * 600 + "<p>after</p>", "deep\nafter"),
    ("<div>" * 60_000 + "deep" + "</div>" * 60_000, "deep"),
    ("<article><p>a</p><script>var x=1;<p>b</p>", "a"),
    ("<article><p>a</p><script src='x'/>bad()</script><p>b</p></article>", "a\nb"),
    ("<article><p>a</p><svg width='1'/><p>b</p></article>", "a\nb"),
])
def test_pages_that_are_deep_or_cut_off(spark, html, want):
    frame = spark.createDataFrame([(1, "http://h/p", html)], "page_id long, url string, html string")
    assert html_wrap.main_text(frame).first()["text"] == want


# ---- vectors ----


def test_vectors_of_doubles_keep_their_digits(spark):
    def at(cosine):
        return [cosine, math.sqrt(1 - cosine * cosine)]

    rows = [(1, [1.0, 0.0], 7), (2, at(0.98 + 1e-10), 7), (3, at(0.98 - 1e-10)[:1] + [-at(0.98 - 1e-10)[1]], 7), (4, [1e300, 0.0], 7)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label long")
    found = {r["id"]: (r["n_links"], r["component_id"]) for r in embed_dups.link(frame).collect()}
    assert found == {1: (2, 1), 2: (2, 1), 3: (0, 3), 4: (2, 1)}
