"""Connected components of a table of links, as alternating star steps with a written table per round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.session import materialize


def _stars(edges: DataFrame, larger: bool) -> DataFrame:
    """One star step. ``larger``: every node sends its neighbours above it to the least node around it; else
    it sends itself and its neighbours below it there. The least node is a partial aggregate joined back, so a
    node with very many links is neither one group nor one task."""
    if larger:
        around = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = around.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        out = around.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        out = down.join(least, "u").select(F.explode(F.array(F.col("u"), F.col("v"))).alias("a"), F.col("m").alias("b"))
    return out.where("a <> b").distinct()


def components(edges: DataFrame, label: str = "links", rounds: int = 60) -> DataFrame:
    """(node, component): component is the least node reachable by ``edges`` (a, b). Nodes without a link to
    another node are not listed. Null ends and self-links are ignored; an empty table gives an empty one.

    Rounds grow with the logarithm of the longest chain. Every round is written to the shared folder; only a
    count and a checksum reach the driver."""
    current = materialize(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), label)
    seen = None
    for _ in range(rounds):
        check = current.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if check[0] == 0 or check == seen:
            break
        seen = check
        current = materialize(_stars(_stars(current, True), False), label)
    else:
        raise RuntimeError("links did not settle")
    return current.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component"))


def with_roots(found: DataFrame) -> DataFrame:
    """Adds the components' own nodes, which ``components`` leaves out."""
    return found.union(found.select(F.col("component").alias("node"), "component").distinct())
