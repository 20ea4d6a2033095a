"""How far the sources of a language stand apart in their words: an audit of counts, all in exact integers.

A term is a run of letters (ASCII letters lower-cased, every character from U+0080 on). Inside ``mapInArrow`` the
texts of a slice go through Arrow compute alone: ascii_lower, split_pattern_regex, dictionary_encode and two hash
group_bys give the counts of (language, source, term) and in how many documents of the slice a term stands. Spark
sums these partial counts, first inside each task, so neither a frequent term nor a large source is a task of its own.
A language keeps the V terms that stand in at least ``least_docs`` of its documents.

With N the group's kept occurrences, a term's share is p = 1 + floor(10^9 (count + 2) / (N + 2 V)) and two shares
diverge by f = floor((p - q)^2 / (p + q)). The kept counts are dealt by term into columnar shards of about ``SHARD``
terms of a language; every shard gets the totals of the language's sources (one row each), lays its counts out as
arrays, source by term, and returns partial sums of f for every two sources and its own ten best terms of each source.
Sources beyond ``BLOCK`` are worked on block against block, so the arrays stay bounded; terms that neither block
has are a product instead of columns. The result has a row for each two sources of a language because that is the
audit asked for; no documents or terms are ever paired.

Null text, language and source count as ''. A group without terms, or whose terms are all rare, still has its rows
in part ``pair``; a language without kept terms has value 0 everywhere and no rows in part ``term``. Repeated rows
count as often as they stand; a document is a row. An empty table gives an empty result. Counts are exact up to
9 * 10^15 words of a language. The memory of a slice is some twelve times its text (about 4 MB, or one longer text).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.common import map_slices, small
from tickloom.session import materialize

BREAKS = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"  # what stands between terms
SLICE = 4 << 20
ROWS = 8192
SHARD = 4096  # terms of a columnar shard
BLOCK = 256  # sources worked on at once
SCALE = 1_000_000_000
TOP = 10


def _partial_counts(part: pa.RecordBatch) -> dict | None:
    """Counts of one slice: (lang, source, term, n, docs)."""
    lang, source, text = (pc.fill_null(part.column(i), "") for i in range(3))
    words = pc.split_pattern_regex(pc.ascii_lower(text), BREAKS)
    doc, term = pc.list_parent_indices(words), pc.list_flatten(words)
    full = pc.not_equal(pc.binary_length(term), 0)
    doc, term = doc.filter(full), term.filter(full).dictionary_encode()
    if len(doc) == 0:
        return None
    pairs = pa.table({"doc": doc.cast(pa.int32()), "code": term.indices}).group_by(["doc", "code"]).aggregate([([], "count_all")])
    group = _group_codes(lang, source)
    table = pa.table({"group": pa.array(group[pairs["doc"].to_numpy()]), "code": pairs["code"], "n": pairs["count_all"]})
    found = table.group_by(["group", "code"]).aggregate([("n", "sum"), ([], "count_all")])
    one_of = np.zeros(group.max() + 1, np.int64)
    one_of[group] = np.arange(len(group))
    at = pa.array(one_of[found["group"].to_numpy()])
    return {"lang": lang.take(at), "source": source.take(at), "term": term.dictionary.take(found["code"].combine_chunks()), "n": found["n_sum"].combine_chunks(), "docs": found["count_all"].combine_chunks()}


def _group_codes(lang: pa.Array, source: pa.Array) -> np.ndarray:
    a, b = lang.dictionary_encode(), source.dictionary_encode()
    return np.asarray(a.indices).astype(np.int64) * max(len(b.dictionary), 1) + np.asarray(b.indices)


def share(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(10^9 count / total) without overflow: three digits of base 1000 at a time."""
    whole, rest = np.divmod(count, total)
    out = whole * SCALE
    for unit in (1_000_000, 1_000, 1):
        digit, rest = np.divmod(rest * 1000, total)
        out += digit * unit
    return out + 1


def apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


def _shard_sums(counts: pa.Table, totals: pa.Table) -> pa.Table:
    """Partial results of one shard of a language: ``counts`` (source, term, n), ``totals`` (source, total, v, of_lang)."""
    lang = totals["lang"][0].as_py()
    sources = totals["source"].combine_chunks()
    order = np.asarray(pc.sort_indices(sources.cast(pa.binary())))
    sources = sources.take(pa.array(order))
    total, v = totals["total"].to_numpy()[order], int(totals["v"][0].as_py())
    m = total + 2 * v
    m_lang = int(totals["of_lang"][0].as_py()) + 2 * v
    terms = counts["term"].combine_chunks().dictionary_encode()
    row = np.asarray(pc.index_in(counts["source"].combine_chunks(), value_set=sources)).astype(np.int64)
    column, n = np.asarray(terms.indices).astype(np.int64), counts["n"].to_numpy()
    n_terms, n_sources = len(terms.dictionary), len(sources)
    in_lang = np.zeros(n_terms, np.int64)
    np.add.at(in_lang, column, n)
    at = np.argsort(row, kind="stable")
    row, column, n = row[at], column[at], n[at]
    starts = np.searchsorted(row, np.arange(n_sources + 1))
    zero = share(np.full(n_sources, 2, np.int64), m)

    def dense(block: range, columns: np.ndarray) -> np.ndarray:
        place = np.full(n_terms, -1, np.int64)
        place[columns] = np.arange(len(columns))
        a, b = starts[block.start], starts[block.stop]
        c = np.full((len(block), len(columns)), 2, np.int64)
        c[row[a:b] - block.start, place[column[a:b]]] += n[a:b]
        return share(c, m[block.start : block.stop, None])

    out = {k: [] for k in ("source", "part", "item", "value")}

    def add(source, part, item, value):
        out["source"].append(source), out["part"].append(pa.array([part] * len(value), pa.string())), out["item"].append(item), out["value"].append(pa.array(value))

    blocks = [range(i, min(i + BLOCK, n_sources)) for i in range(0, n_sources, BLOCK)]
    for one in blocks:
        for other in blocks[blocks.index(one) :]:
            has = np.zeros(n_terms, bool)
            for b in (one, other):
                has[column[starts[b.start] : starts[b.stop]]] = True
            columns = np.flatnonzero(has)
            p = dense(one, columns)
            q = p if other is one else dense(other, columns)
            for i, s in enumerate(one):
                value = apart(p[i][None, :], q).sum(axis=1) + (n_terms - len(columns)) * apart(zero[s], zero[other.start : other.stop])
                to = np.arange(other.start, other.stop)
                to, value = to[to != s], value[to != s]
                add(sources.take(pa.array(np.full(len(to), s))), "pair", sources.take(pa.array(to)), value)
                if other is not one:
                    add(sources.take(pa.array(to)), "pair", sources.take(pa.array(np.full(len(to), s))), value)
    p, q = share(n + 2, m[row]), share(in_lang + 2, np.int64(m_lang))[column]
    more = np.flatnonzero(p > q)
    value = apart(p[more], q[more])
    if len(more):
        named = pa.table({"s": row[more], "v": value, "t": terms.dictionary.take(pa.array(column[more])).cast(pa.binary())})
        named = named.take(pc.sort_indices(named, sort_keys=[("s", "ascending"), ("v", "descending"), ("t", "ascending")]))
        s = named["s"].to_numpy()
        best = np.arange(len(s)) - np.searchsorted(s, s) < TOP
        named = named.filter(pa.array(best))
        add(sources.take(named["s"].combine_chunks()), "term", named["t"].combine_chunks().cast(pa.string()), named["v"].to_numpy())
    columns = {k: pa.chunked_array(x, type=pa.int64() if k == "value" else pa.string()) for k, x in out.items()}
    return pa.table({"lang": pa.array([lang] * len(columns["value"]), type=pa.string()), **columns})


def audit(docs: DataFrame, least_docs: int = 10, shard: int = SHARD) -> DataFrame:
    """(lang, source, part, item, value, rank); see the module for the definitions."""
    rows = docs.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    partial = map_slices(rows, _partial_counts, "lang string, source string, term string, n long, docs long", limit=SLICE, rows=ROWS)
    counts = materialize(partial.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "audit-counts")
    kept = materialize(counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= least_docs).select("lang", "term"), "audit-terms")
    size = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"))
    mine = materialize(counts.join(kept, ["lang", "term"]).select("lang", "source", "term", "n"), "audit-kept")
    per_source = mine.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = small(rows.groupBy("lang", "source").agg(F.lit(0).alias("none")).drop("none").join(per_source, ["lang", "source"], "left").fillna(0, ["total"]), "audit-groups")
    of_lang = small(groups.groupBy("lang").agg(F.sum("total").alias("of_lang")).join(size, "lang", "left").fillna(0, ["v"]).withColumn("shards", F.ceil(F.col("v") / F.lit(shard)).cast("int")), "audit-langs")
    dealt = mine.join(of_lang.select("lang", "shards"), "lang").select("lang", "source", "term", "n", F.pmod(F.xxhash64("term"), F.col("shards")).cast("int").alias("shard"))
    totals = groups.join(of_lang.where("shards > 0"), "lang").select("lang", "source", "total", "v", "of_lang", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"))
    sums = dealt.groupBy("lang", "shard").cogroup(totals.groupBy("lang", "shard")).applyInArrow(_shard_sums, "lang string, source string, part string, item string, value long")
    sums = materialize(sums, "audit-sums")
    pairs = sums.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    empty = groups.join(of_lang.where("v = 0"), "lang").select("lang", "source")
    bare = empty.join(empty.withColumnRenamed("source", "item"), "lang").where("source <> item").select("lang", "source", F.lit("pair").alias("part"), "item", F.lit(0).cast("long").alias("value"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), F.asc("item"))
    ranked = pairs.union(bare).withColumn("rank", F.row_number().over(order))
    terms = sums.where("part = 'term'").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= TOP)
    return ranked.union(terms)
