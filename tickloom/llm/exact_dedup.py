"""Exact duplicates: rows grouped by a 128-bit content hash, bytes compared inside the groups.

Two texts are equal when they are identical after every white-space character (space, tab to carriage return) is
deleted. One pass makes a narrow table of hashes, whose counts (partial sums first, so a group that holds a third of
all rows is no task of its own) tell which hashes stand more than once. Only the texts of those are read again. Every
one of them is compared byte for byte with its group's first text; groups are dealt over as many tasks as their size
asks for, the first text going to each. Rows that differ form the groups of a further round, so that a collision of
the hash splits a group and never joins two texts.

Of equal texts the row with the most code points in the original text stays, then the smallest id; a null id comes
after all others. Repeated rows (same id, same text) are one group of which exactly one row stays. A null text
counts as empty, and empty texts (also those of white space only) are equal. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import keyed_text, map_slices, small
from tickloom.session import materialize

ROWS_A_TASK = 2048  # rows of one group that are compared with one copy of its first text
LAST_ID = (1 << 63) - 1
WHITE = b" \t\n\v\f\r"


def md5(data: bytes) -> bytes:
    return hashlib.md5(data, usedforsecurity=False).digest()


def squeezed(texts: pa.Array) -> list[bytes]:
    """Each text's bytes without white space; a null is empty."""
    return [(x or b"").translate(None, WHITE) for x in texts.cast(pa.binary()).to_pylist()]


def _hashed(texts: DataFrame, digest: Callable[[bytes], bytes], with_text: bool) -> DataFrame:
    """(id, n_chars, h, sha, and the squeezed text if asked for) of every row."""

    def kernel(part):
        text = part.column(1)
        bodies = squeezed(text)
        out = {"id": part.column(0), "n_chars": pa.compute.fill_null(pa.compute.utf8_length(text), 0), "h": [digest(b) for b in bodies], "sha": [hashlib.sha256(b).hexdigest() for b in bodies]}
        return out | ({"body": bodies} if with_text else {})

    return map_slices(texts, kernel, "id long, n_chars long, h binary, sha string" + (", body binary" if with_text else ""))


def _settled(rows: DataFrame) -> DataFrame:
    """(id, n_chars, h, sha, level, row): rows with equal (h, level) have equal bytes. ``rows`` also has ``body`` and
    its group's ``copies`` and ``best``, the order of the row that stays."""
    done, left, level = [], rows, 0
    while True:
        first = left.where(F.struct(-F.col("n_chars"), F.coalesce("id", F.lit(LAST_ID))) == F.col("best")) if level == 0 else left
        one = first.groupBy("h").agg(F.min("body").alias("first_body"), F.max("copies").alias("copies"))
        spread = F.greatest(F.lit(1), F.ceil(F.col("copies") / F.lit(ROWS_A_TASK))).cast("int")
        one = one.select("h", "first_body", F.explode(F.sequence(F.lit(0), spread - 1)).alias("deal"))
        mine = left.withColumn("deal", F.pmod(F.xxhash64("id", "sha", "n_chars"), spread).cast("int"))
        compared = materialize(mine.join(one, ["h", "deal"]).select("id", "n_chars", "h", "sha", "copies", "best", (F.col("body") == F.col("first_body")).alias("same"), F.when(F.col("body") != F.col("first_body"), F.col("body")).alias("body")), "dedup-compared")
        done.append(compared.where("same").select("id", "n_chars", "h", "sha", F.lit(level).alias("level"), F.monotonically_increasing_id().alias("row")))
        left, level = compared.where("not same").drop("same"), level + 1
        if left.isEmpty():
            break
    out = done[0]
    for d in done[1:]:
        out = out.union(d)
    return out


def duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", digest: Callable[[bytes], bytes] = md5) -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256) of every row; ``digest`` is the content hash that groups."""
    texts = keyed_text(docs, key, text)
    narrow = materialize(_hashed(texts, digest, False), "dedup-hashes")
    order = F.struct((-F.col("n_chars")).alias("n"), F.coalesce("id", F.lit(LAST_ID)).alias("i"))
    again = small(narrow.groupBy("h").agg(F.count(F.lit(1)).alias("copies"), F.min(order).alias("best")).where("copies > 1"), "dedup-groups")
    single = narrow.join(again.select("h"), "h", "left_anti").select("id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.col("sha").alias("text_sha256"))
    rows = materialize(_hashed(texts, digest, True).join(again, "h"), "dedup-texts")
    found = materialize(_settled(rows), "dedup-found")
    best = F.min(F.struct((-F.col("n_chars")).alias("n"), F.coalesce("id", F.lit(LAST_ID)).alias("i"), F.col("row").alias("row"), F.col("id").alias("id"))).alias("stays")
    groups = small(found.groupBy("h", "level").agg(F.count(F.lit(1)).alias("group_size"), best), "dedup-kept")
    member = found.join(groups, ["h", "level"]).select("id", F.col("stays.id").alias("keep_id"), "group_size", (F.col("row") == F.col("stays.row")).alias("kept"), F.col("sha").alias("text_sha256"))
    return single.union(member)
