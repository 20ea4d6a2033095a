"""Near-duplicate joins, decontamination, shards, pages, classifiers and the pipeline against plain versions."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import types as T

from tests.llm.conftest import ODD
from tickloom.llm import decontaminate, embed_dups, html_wrap, jaccard_join, quality, shards, toxicity


def shingle_set(text, k):
    w = (text or "").encode().lower().split()
    return {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def classes(items, linked):
    parent = list(range(len(items)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(items)):
        for b in range(a):
            if linked(items[a], items[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return [root(i) for i in range(len(items))]


def near_copies(seed, families=12, words=(1, 300)):
    rng = random.Random(seed)
    rows = []
    for _ in range(families):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.randint(*words))]
        for _ in range(rng.randint(1, 14)):
            t = [w if rng.random() > rng.choice([0, 0.005, 0.02, 0.05]) else f"w{rng.randrange(5000)}" for w in base]
            if rng.random() < 0.3:
                t += [f"w{rng.randrange(5000)}" for _ in range(rng.randint(1, 5))]
            rows.append(" ".join(t))
    return [(i, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize("k,num,den,seed,block", [(3, 90, 100, 1, 384), (5, 8, 10, 2, 3), (1, 5, 10, 3, 384)])
def test_jaccard_join_equals_brute_force(spark, docs, monkeypatch, k, num, den, seed, block):
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    rows = near_copies(seed) + [(5000 + i, t) for i, t in enumerate(["a b c d e f g", "a b c d e f", "x", "x", "", None, "a b c d e f g h"])]
    sets = [shingle_set(t, k) for _, t in rows]
    want = classes(sets, lambda a, b: a and b and den * len(a & b) >= num * len(a | b))
    got = {r["id"]: r for r in jaccard_join.near_duplicates(docs(rows), k, num, den).collect()}
    assert {i: got[i]["n_shingles"] for i, _ in rows} == {i: len(s) for (i, _), s in zip(rows, sets)}
    assert {i: got[i]["component_id"] for i, _ in rows} == {rows[a][0]: rows[c][0] for a, c in enumerate(want)}


@pytest.mark.parametrize("num,den", [(9, 10), (8, 10)])
@pytest.mark.parametrize("rows", [10, 10**10])
def test_every_linked_pair_shares_an_entry(num, den, rows):
    """For both allocations, in the worst case of differences spread over all segments."""
    rule = jaccard_join.Rule(3, num, den, rows)
    rng = np.random.default_rng(1)
    weights = set()

    def kept(tokens, rule):
        """What is left after every view leaves out what it may, by an order all sets share."""
        out = set()
        for _, spare, found in jaccard_join.entries(tokens, len(tokens), rule):
            out |= set(sorted(found.tolist(), key=lambda e: e * 2654435761 % 2**32)[spare:])
        return out

    for size in [*range(1, 40), 57, 80, 129, 300, 700]:
        a = rng.integers(0, 2**63, size).astype(np.uint64)
        for _ in range(6):
            drop = int(rng.integers(0, max(1, size * (den - num) // den + 1)))
            add = int(rng.integers(0, max(1, size * (den - num) // den + 1)))
            b = np.concatenate((a[drop:], rng.integers(0, 2**63, add).astype(np.uint64)))
            if len(b) and rule.linked(size - drop, size, len(b)):
                assert kept(a, rule) & kept(b, rule)
        weights.add(rule.plan(rule.band(size))[0])
    assert rows == 10 or weights == {1, 2} or 2 in weights


def test_jaccard_join_on_odd_rows(spark, docs):
    got = jaccard_join.near_duplicates(docs(ODD)).collect()
    assert len(got) == len(ODD)
    assert {r["id"]: r["component_id"] for r in got} == {None: None, 1: 1, 2: 2, 3: 3, 4: 4, 5: 5, 6: 5, 7: 7, 8: 8, 9: 9}
    assert jaccard_join.near_duplicates(docs([])).count() == 0
    kept = jaccard_join.one_of_each(docs(ODD))
    assert kept.columns == docs([]).columns
    assert sorted((r["doc_id"] or -1) for r in kept.collect()) == [-1, 1, 2, 3, 4, 5, 7, 8, 9]


def test_sketches_lose_no_link():
    """Sketches differ in no more bits than their sets do in elements, also when the wider one is folded, and tell strangers apart."""
    rng = np.random.default_rng(5)
    rule = jaccard_join.Rule(5, 8, 10, 10)
    sets = [rng.integers(0, 2**63, n).astype(np.uint64) for n in (1, 31, 33, 60, 70, 400, 500, 520, 5000)]
    sets += [np.concatenate((s[len(s) // 9 :], rng.integers(0, 2**63, len(s) // 10).astype(np.uint64))) for s in sets]
    at = np.concatenate(([0], np.cumsum([len(s) for s in sets])))
    kept = jaccard_join.sketches(np.concatenate(sets), at)
    to = np.concatenate(([0], np.cumsum([len(k) for k in kept])))
    data = np.frombuffer(b"".join(kept), np.uint8)
    n = np.array([len(s) for s in sets])
    for i, s in enumerate(sets):
        for j, t in enumerate(sets[:i]):
            words = jaccard_join._folded(data, to, np.array([i, j]))
            differ = int(np.bitwise_count(np.bitwise_xor(*words[min(words)])).sum())
            assert differ <= len(set(s.tolist()) ^ set(t.tolist()))
            if i - j != 9 and min(n[i], n[j]) > 300 and 10 * min(n[i], n[j]) >= 8 * max(n[i], n[j]):
                assert not rule.possible(differ, n[i], n[j])


def test_texts_with_a_common_passage_are_no_family(spark, docs, monkeypatch):
    """Texts go to the tasks that count shingles only where their sketches let them be linked, in blocks of any size."""
    sent = []
    rng = random.Random(3)
    passage = [f"p{i}" for i in range(60)]
    rows = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(40)) + " " + " ".join(passage) for _ in range(300)]
    rows += [rows[i] + f" x{i}" for i in range(0, 60, 3)]
    rows = list(enumerate(rows))
    sets = [shingle_set(t, 5) for _, t in rows]
    want = classes(sets, lambda a, b: 10 * len(a & b) >= 8 * len(a | b))
    keep = jaccard_join.materialize
    monkeypatch.setattr(jaccard_join, "materialize", lambda df, label: (sent.append(df.count()) if label == "dealt" else None, keep(df, label))[1])
    for crowd, few in ((4096, 64), (40, 64), (40, 2)):
        monkeypatch.setattr(jaccard_join, "CROWD", crowd)
        monkeypatch.setattr(jaccard_join, "FEW", few)
        got = {r["id"]: r["component_id"] for r in jaccard_join.near_duplicates(docs(rows), 5, 8, 10).collect()}
        assert got == {rows[a][0]: rows[c][0] for a, c in enumerate(want)}
    assert sent == [40] * 3


VECTORS = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType()), T.StructField("node", T.StringType())])


def test_embedding_join_equals_brute_force(spark):
    rng = np.random.default_rng(7)
    rows = []
    for dims in (64, 12):
        base = rng.standard_normal((25, dims))
        for i in range(250):
            v = base[i % 25] + rng.standard_normal(dims) * rng.choice([0, 0.1, 0.2, 0.25])
            rows.append((len(rows), [float(np.float32(x)) for x in v * rng.choice([1e-3, 1, 1e4])], int(rng.integers(0, 2))))
    rows += [(900, None, 1), (901, [0.0] * 64, 1), (902, [float("nan")] * 64, 1), (903, rows[0][1], None), (904, [], 1), (905, [None] * 64, 0), (906, [float("inf")] + [0.0] * 63, 0), (None, rows[0][1], rows[0][2])]
    got = embed_dups.link(spark.createDataFrame([(*r, "x") for r in rows], VECTORS)).collect()

    def linked(a, b):
        if a[2] is None or a[2] != b[2] or a[0] in range(900, 907) or b[0] in range(900, 907) or len(a[1]) != len(b[1]):
            return False
        u, v = np.array(a[1]), np.array(b[1])
        return u @ v / np.linalg.norm(u) / np.linalg.norm(v) >= 0.98

    want = classes(rows, linked)
    assert len(got) == len(rows)
    by = {r["id"]: r for r in got}
    for a, row in enumerate(rows):
        assert by[row[0]]["n_links"] == sum(linked(row, o) for b, o in enumerate(rows) if a != b)
        assert by[row[0]]["component_id"] == rows[want[a]][0]
    assert embed_dups.link(spark.createDataFrame([], VECTORS)).count() == 0


def test_matches_equal_exact_containment(spark, docs, monkeypatch):
    monkeypatch.setattr(decontaminate, "ITEMS_AT_ONCE", 7)
    rng = random.Random(2)
    word = lambda: f"w{rng.randrange(3000)}"
    items = [(i, " ".join(word() for _ in range(rng.choice([1, 4, 5, 9, 30, 90])))) for i in range(30)] + [(30, None), (31, "")]
    rows = list(ODD)
    for i in range(60):
        text = [word() for _ in range(rng.randint(0, 3000))]
        for _ in range(2):
            at = rng.randint(0, len(text))
            text[at:at] = [w if rng.random() > 0.01 else word() for w in items[rng.randrange(30)][1].split()]
        rows.append((1000 + i, " ".join(text)))
    want = {}
    for i, t in rows:
        have = shingle_set(t, 5)
        for j, q in items:
            s = shingle_set(q, 5)
            if s and len(s & have) >= 0.8 * len(s) - 1e-9:
                want[i, j] = (len(s), len(s & have))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["id"], r["item_id"]): (r["n_item"], r["n_common"]) for r in decontaminate.matches(docs(rows), bench).collect()}
    assert got == want and want
    kept = decontaminate.clean(docs(rows), bench)
    assert kept.columns == docs([]).columns
    assert sorted(r["doc_id"] or -1 for r in kept.collect()) == sorted(i or -1 for i, _ in rows if i not in {a for a, _ in want})
    assert decontaminate.matches(docs(rows), bench.limit(0)).count() == 0 and decontaminate.clean(docs([]), bench).count() == 0


def test_shards(spark, docs):
    rng = random.Random(3)
    rows = ODD[:-3] + [(i, f"text {i} " * rng.randint(0, 60), rng.choice(["en", "de", None]), rng.choice(["a", "b", None])) for i in range(100, 1500)] + [(2000 + i, "copy of one text " * 20, "en", f"s{i}") for i in range(900)]
    got = shards.kd_shards(docs(rows).drop("shard"), shards=7).collect()
    size = lambda t: len((t or "").encode()) + 1
    assert len(got) == len(rows) and {r["shard"] for r in got} == set(range(7))
    assert sorted((r["size"], r["text_crc32"]) for r in got) == sorted((size(r[1]), zlib.crc32((r[1] or "").encode())) for r in rows)
    total, longest = sum(size(r[1]) for r in rows), max(size(r[1]) for r in rows)
    for k in range(7):
        mine = [r for r in got if r["shard"] == k]
        assert sorted(r["slot"] for r in mine) == list(range(len(mine)))
        assert abs(sum(r["size"] for r in mine) - total / 7) <= 0.02 * total + longest
    again = shards.kd_shards(docs(rows).drop("shard").repartition(5), shards=7).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    assert shards.kd_shards(docs([]), shards=8).count() == 0
    by_bytes = shards.kd_shards(docs(rows), target_bytes=total // 4 + 1).select("shard").distinct().count()
    assert by_bytes == 4


def _plain_tree(rows, leaves, whole):
    """The same tree by sorting each node's rows: [(keys, tie, size, doc_id)] -> shard by place in ``rows``."""
    out = {}

    def split(mine, first, h):
        if h == 1 or not mine:
            out.update((i, first) for i in mine)
            return
        spans = [max(rows[i][0][d] >> 32 for i in mine) - min(rows[i][0][d] >> 32 for i in mine) for d in range(4)]
        d = spans.index(max(spans))
        weight = sum(rows[i][2] for i in mine)
        need = weight * (h // 2) // h
        room = weight - need
        lefts, rights, best = set(), set(), None
        while True:
            prior, found = 0, None
            free = sorted((i for i in mine if rows[i][0][d] not in lefts | rights), key=lambda i: rows[i][0][d])
            for key in dict.fromkeys(rows[i][0][d] for i in free):
                some = [i for i in free if rows[i][0][d] == key]
                w = sum(rows[i][2] for i in some)
                if prior + w >= need:
                    found = key, some, w
                    break
                prior += w
            if found is None or need <= 0:
                cut, miss = (0 if need <= 0 else 1 << 62, 0), abs(need - prior)
            else:
                key, some, w = found
                cut, miss = ((key, 0), need - prior) if need - prior <= prior + w - need else ((key + 1, 0), prior + w - need)
                if miss and w > whole:
                    at = prior
                    for i in sorted(some, key=lambda i: rows[i][1]):
                        if at + rows[i][2] >= need:
                            cut = (key, rows[i][1] + (need - at > at + rows[i][2] - need))
                            break
                        at += rows[i][2]
                    miss = -1
            if best is None or miss < best[0]:
                best = miss, cut, set(lefts), set(rights)
            if found is None or need <= 0 or miss <= 0 or len(lefts) + len(rights) == shards.TRIES:
                break
            if w <= need and (2 * (need - prior) >= w or w > room):
                lefts.add(key)
                need -= w
            elif w <= room:
                rights.add(key)
                room -= w
            else:
                break
        _, cut, lefts, rights = best
        left = {i for i in mine if rows[i][0][d] in lefts or (rows[i][0][d] not in rights and (rows[i][0][d], rows[i][1]) < cut)}
        split([i for i in mine if i in left], first, h // 2)
        split([i for i in mine if i not in left], first + h // 2, h - h // 2)

    split(list(range(len(rows))), 0, leaves)
    return out


def test_shards_equal_a_plain_tree(spark, docs):
    rng = random.Random(8)
    texts = [f"text {i} " * rng.randint(1, 40) for i in range(60)]
    rows = [(i, rng.choice(texts), rng.choice(["en", "de", None]), rng.choice(["a", "b", "c"])) for i in range(400)] + [(900 + i, "one heavy text " * 9, "en", f"s{i % 7}") for i in range(300)]
    table = docs(rows)
    known = [((r["k0"], r["k1"], r["k2"], r["k3"]), r["tie"], r["size"], r["doc_id"]) for r in shards.metadata(table).collect()]
    total = sum(r[2] for r in known)
    for leaves in (3,):
        want = _plain_tree(known, leaves, total / leaves)
        got = {r["doc_id"]: r["shard"] for r in shards.kd_shards(table, shards=leaves, tolerance=0).collect()}
        assert got == {known[i][3]: shard for i, shard in want.items()}


def test_equal_texts_stay_together(spark, docs):
    """No group that fits a shard is cut, however heavy; one that fits none is cut and spread; many leaves."""
    rng = random.Random(4)
    rows = [(i, f"word{i} " * rng.randint(5, 30), "en", "a") for i in range(600)]
    rows += [(1000 + 100 * g + i, f"copies of group {g} " * 12, "en", f"s{i % 3}") for g in range(5) for i in range(20 + 9 * g)] + [(3000 + i, "everywhere the same words " * 4, None, None) for i in range(900)]
    total = sum(len(r[1]) + 1 for r in rows)
    text = {r[0]: r[1] for r in rows}
    for leaves in (8,):
        got = shards.kd_shards(docs(rows), shards=leaves).collect()
        groups, held = {}, Counter()
        for r in got:
            groups.setdefault(text[r["doc_id"]], []).append(r)
            held[r["shard"]] += r["size"]
        cut = {t for t, g in groups.items() if len({r["shard"] for r in g}) > 1}
        assert all(sum(r["size"] for r in groups[t]) > total / leaves for t in cut) and len(cut) <= 1
        assert all(abs(held[k] - total / leaves) <= 0.05 * total / leaves for k in range(leaves))
    many = shards.kd_shards(docs(rows[:600]), shards=60, tolerance=0.5).select("shard").distinct().count()
    assert many == 60


def test_pages(spark):
    page = lambda i, body: f"<html><head><title>t{i}</title><script>x='</p>'</script></head><body><nav><a>menu {i}</a></nav>{body}<footer>foot {i}</footer></body></html>"
    rows = [(i, "http://a.example/x", page(i, f"<article><h1>Title {i}</h1>" + "".join(f"<p>part {j}  of\n{i} &amp; <b>bold</b>" for j in range(i % 4 + 1)) + '<div class="comments"><p>no</p></div></article>')) for i in range(40)]
    rows += [(100 + i, f"http://b{i % 3}.example", page(i, f'<div class="menu">x</div><div id="post-{i}"><h2>Head {i}</h2><p>{"body " * 30}</p><p>{"tail " * 30}</p></div><aside>side</aside><form>f</form>')) for i in range(9)]
    rows += [(200, None, None), (201, "x", ""), (202, "http://a.example", "plain text only"), (203, "http://a.example", "<article>" + "<p>deep" * 5000), (None, "http://a.example", "<article>x</article>")]
    got = {r["id"]: r["text"] for r in html_wrap.main_text(spark.createDataFrame([(*r, "q") for r in rows], "page_id long, url string, html string, text string")).collect()}
    assert len(got) == len(rows)
    for i in range(40):
        assert got[i] == "\n".join([f"Title {i}"] + [f"part {j} of {i} & bold" for j in range(i % 4 + 1)])
    for i in range(9):
        assert got[100 + i] == f"Head {i}\n" + " ".join(["body"] * 30) + "\n" + " ".join(["tail"] * 30)
    assert (got[200], got[201], got[202], got[None]) == ("", "", "plain text only", "x") and got[203] == "\n".join(["deep"] * 5000)
    assert html_wrap.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_wrapper_has_no_unions():
    a, b = html_wrap.stream("<body><h1>x</h1><p>1</p><p>2</p></body>"), html_wrap.stream("<body><div>d</div><p>1</p></body>")
    assert html_wrap.expression(html_wrap.align(a, b)) == "<body>(<h1>#</h1>)?(<div>#</div>)?(<p>#</p>)+</body>"


@pytest.mark.parametrize("module", [toxicity, quality])
def test_gradients_are_those_of_the_loss(module):
    import pyarrow as pa

    net = module.Net(3)
    texts = pa.array(["some words here that are read by it, " * 5, "other text", "x"])
    weights = np.array([0.5, -1.0, 0.25])

    def loss():
        if module is quality:
            return float(weights @ net.run(quality.Chunks(texts))[0])
        words = module.ByteWords(texts)
        index, text = module.windows(words.counts)
        gates, _ = net.inputs(words)
        at = np.where(index >= 0, words.place[np.maximum(index, 0)], len(gates) - 1)
        return float(net.run(gates, at)[0] @ weights[text])

    if module is quality:
        c = quality.Chunks(texts)
        grads = net.gradients(c, net.run(c, keep=True)[1], weights.astype(np.float32))
    else:
        words = module.ByteWords(texts)
        index, text = module.windows(words.counts)
        gates, extra = net.inputs(words)
        at = np.where(index >= 0, words.place[np.maximum(index, 0)], len(gates) - 1)
        grads = net.gradients(words, gates, extra, at, net.run(gates, at, keep=True)[1], weights[text].astype(np.float32))
    for name, g in grads.items():
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        old = net.w[name][at]
        net.w[name][at] = old + 1e-2
        up = loss()
        net.w[name][at] = old - 1e-2
        down = loss()
        net.w[name][at] = old
        assert abs((up - down) / 2e-2 - g[at]) <= 0.03 * abs(g[at]) + 2e-3, name


@pytest.mark.parametrize("module", [toxicity, quality])
def test_classifiers_on_odd_rows(spark, docs, module):
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(300)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(5, 150))) for _ in range(240)]
    y = np.array([i % 2 for i in range(240)], dtype=np.float32)
    bad = lambda t: t + " vilething " + " ".join(rng.choice(words) for _ in range(9)) if module is toxicity else " ".join(w + "$$$" for w in t.split())
    texts = [bad(t) if c else t for t, c in zip(texts, y)]
    net = module.train(texts[:180], y[:180])
    out = {r["id"]: r["score"] for r in module.score(docs(list(enumerate(texts[180:]))), net).collect()}
    assert np.mean([(out[i] >= 0.5) == (y[180 + i] == 1) for i in range(60)]) >= 0.9
    odd = module.score(docs(ODD), net).collect()
    assert len(odd) == len(ODD) and all(0 <= r["score"] <= 1 for r in odd)
    assert module.score(docs([]), net).count() == 0
    assert module.train([], np.zeros(0)) == 0.0 and module.train(["a"], np.ones(1)) == 1.0
    assert [r["score"] for r in module.score(docs([(1, None)]), 0.25).collect()] == [0.25]
