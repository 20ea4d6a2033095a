"""Evaluation of predictions: ranking measures, masked losses, means by treatment.

Ranking measures look at pairs, but no pair is ever produced: equal rows are counted once, values are cut
in ranges, and pairs across ranges follow from counts alone.
"""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.operators.columns import positions
from tickloom.session import materialize


def auc(df: DataFrame, y: str, score: str) -> DataFrame:
    """Share of (positive, negative) pairs scored in order, ties one half."""
    counted = df.groupBy(F.col(score).alias("_s")).agg(
        F.count_if(F.col(y) > 0).alias("pos"), F.count_if(F.col(y) <= 0).alias("neg")
    )
    placed = positions(counted, [], "_s", ["neg"])
    wins = F.sum(F.col("pos") * (F.col("neg_before") + F.col("neg") / 2.0))
    return placed.agg(F.try_divide(wins, F.sum("pos").cast("double") * F.sum("neg")).alias("auc"))


def _ranges(cells: DataFrame, count: int, value: str, out: str, size: int) -> DataFrame:
    """(value, out): ascending ranges of about ``size`` cells. A value with more cells than that is a range of its own
    (odd numbers); the ranges between are even and hold fewer than twice as many."""
    placed = positions(cells.groupBy(value).agg(F.count(F.lit(1)).alias("_c")), [], value, ["_c"], at_most=count)
    return placed.select(value, (F.floor(F.col("_c_before") / size) * 2 + (F.col("_c") > size).cast("int")).alias(out))


def _ordered_pairs(a: np.ndarray, b: np.ndarray, n: np.ndarray) -> float:
    """Weighted pairs with a_i < a_j and b_i < b_j, by merging halves."""
    order = np.lexsort((-b, a))
    b, n = b[order], n[order].astype("float64")

    def count(lo: int, hi: int) -> float:
        if hi - lo <= 64:
            x, m = b[lo:hi], n[lo:hi]
            return float((np.triu(x[:, None] < x[None, :], 1) * m[:, None] * m[None, :]).sum())
        mid = (lo + hi) // 2
        inner = count(lo, mid) + count(mid, hi)
        left = np.argsort(b[lo:mid], kind="stable")
        below = np.concatenate([[0.0], np.cumsum(n[lo:mid][left])])
        at = np.searchsorted(b[lo:mid][left], b[mid:hi], side="left")
        return inner + float((n[mid:hi] * below[at]).sum())

    return count(0, len(b))


CELLS_PER_RANGE = 20_000


def regression_auc(df: DataFrame, y: str, score: str, size: int = CELLS_PER_RANGE) -> DataFrame:
    """Exact share of unequal-label pairs whose scores are ordered alike, score ties one half.

    Equal rows are one counted cell; labels and scores are cut into ranges of about ``size`` cells. Pairs in
    different ranges of both are found by a sweep over the bits of the score's range number: at the highest bit in
    which two numbers differ they share all bits above, so for each bit one aggregate (bits above, label range) counts
    zeros and ones, and a running sum over the label ranges gives how many zeros lie before the ones. Rows
    are at most the cells times the bits. Pairs that share a label range, or a score range only, are
    counted inside that range by merging; a range that is one repeated value has none.
    """
    rows = df.select(F.col(y).cast("double").alias("y"), F.col(score).cast("double").alias("s")).where("y is not null and s is not null")
    cells = materialize(rows.groupBy("y", "s").agg(F.count(F.lit(1)).alias("n")), "cells")
    count = cells.count()
    laid = cells.join(_ranges(cells, count, "y", "yr", size), "y").join(_ranges(cells, count, "s", "sr", size), "s")
    laid = materialize(laid.select("y", "s", "n", "yr", "sr"), "pairs")

    grid = laid.groupBy("yr", "sr").agg(F.sum("n").cast("double").alias("n"))
    bits = int(grid.agg(F.max("sr")).first()[0] or 0).bit_length()
    levels = grid.select("*", F.explode(F.sequence(F.lit(1), F.lit(max(1, bits)))).alias("level"))
    above, bit = F.expr("shiftright(sr, level)"), F.expr("shiftright(sr, level - 1) & 1")
    swept = levels.groupBy("level", above.alias("above"), "yr").agg(F.sum(F.when(bit == 0, F.col("n")).otherwise(0.0)).alias("zeros"), F.sum(F.when(bit == 1, F.col("n")).otherwise(0.0)).alias("ones"))
    earlier = Window.partitionBy("level", "above").orderBy("yr").rowsBetween(Window.unboundedPreceding, -1)
    across = swept.withColumn("before", F.sum("zeros").over(earlier)).agg(F.sum(F.col("ones") * F.col("before")).alias("c"))

    def inside(a: str, b: str):
        def per_range(pdf: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"c": [_ordered_pairs(pdf[a].to_numpy(), pdf[b].to_numpy(), pdf["n"].to_numpy())]})

        return per_range

    in_y = laid.filter(F.col("yr") % 2 == 0).groupBy("yr").applyInPandas(inside("y", "s"), "c double")
    in_s = laid.filter(F.col("sr") % 2 == 0).groupBy("sr").applyInPandas(inside("yr", "s"), "c double")
    ordered = across.unionByName(in_y).unionByName(in_s).agg(F.coalesce(F.sum("c"), F.lit(0.0)).alias("ordered"))

    def pairs(by: list[str]) -> DataFrame:
        sums = laid.groupBy(*by).agg(F.sum("n").cast("double").alias("m")) if by else laid.agg(F.sum("n").cast("double").alias("m"))
        return sums.agg(F.sum(F.col("m") * F.col("m")).alias("q"))

    parts = (
        ordered.select(F.lit("ordered").alias("k"), F.col("ordered").alias("v"))
        .unionByName(pairs([]).select(F.lit("all").alias("k"), F.col("q").alias("v")))
        .unionByName(pairs(["y"]).select(F.lit("y").alias("k"), F.col("q").alias("v")))
        .unionByName(pairs(["s"]).select(F.lit("s").alias("k"), F.col("q").alias("v")))
        .unionByName(pairs(["y", "s"]).select(F.lit("ys").alias("k"), F.col("q").alias("v")))
    )

    def part(k: str) -> Column:
        return F.max(F.when(F.col("k") == k, F.col("v")))

    unequal, tied = (part("all") - part("y")) / 2, (part("s") - part("ys")) / 2
    return parts.agg(F.try_divide(part("ordered") + tied / 2, unequal).alias("regauc"), unequal.alias("pairs"))


def regression_auc_sampled(df: DataFrame, y: str, score: str, rounds: int = 10000, seed: int = 11, draws: DataFrame | None = None) -> DataFrame:
    """The same from ``rounds`` random pairs: first row uniform, second uniform among the rows of another label.

    Rows are placed by (label, score) through counts of distinct cells, so repeated rows are one cell, however
    many. The rows of a label are one stretch of places; the second draw counts the places outside that
    stretch, so it never has to be repeated. ``draws`` (u, v in [0, 1)) replaces the random numbers.
    """
    rows = df.select(F.col(y).alias("y"), F.col(score).alias("s")).filter("y is not null and s is not null")
    cells = materialize(rows.groupBy("y", "s").agg(F.count(F.lit(1)).alias("n")), "cells")
    labels = positions(cells.groupBy("y").agg(F.sum("n").alias("_ny")), [], "y", ["_ny"])
    placed = positions(cells, ["y"], "s", ["n"]).join(labels, "y")
    first = F.col("_ny_before") + F.col("n_before")
    placed = materialize(placed.select("y", "s", "_ny", F.col("_ny_before").alias("_ystart"), first.alias("_from"), (first + F.col("n") - 1).alias("_to")), "placed")
    total, count, kinds = cells.agg(F.sum("n"), F.count(F.lit(1)), F.count_distinct("y")).first()
    if kinds < 2:
        raise ValueError("all labels are equal: there is no pair to draw")
    step = max(1, total // count)  # cells are found by the stretches of places they reach into, about one a cell
    bins = placed.withColumn("_bin", F.explode(F.sequence(F.floor(F.col("_from") / step), F.floor(F.col("_to") / step))))

    def look_up(drawn: DataFrame, place: str, names: dict[str, str]) -> DataFrame:
        found = drawn.withColumn("_bin", F.floor(F.col(place) / step)).join(bins, "_bin").filter(F.col(place).between(F.col("_from"), F.col("_to")))
        return found.select(*drawn.columns, *[F.col(c).alias(n) for c, n in names.items()])

    if draws is None:
        draws = df.sparkSession.range(rounds).select(F.rand(seed).alias("u"), F.rand(seed + 1).alias("v"))
    one = look_up(materialize(draws.select(F.floor(F.col("u") * total).alias("_i"), "v"), "draws"), "_i", {"y": "yi", "s": "si", "_ny": "_n", "_ystart": "_start"})
    other = F.floor(F.col("v") * (total - F.col("_n")))
    two = one.withColumn("_j", F.when(other < F.col("_start"), other).otherwise(other + F.col("_n")))
    pairs = look_up(two, "_j", {"y": "yj", "s": "sj"})
    dy, ds = F.col("yi") - F.col("yj"), F.col("si") - F.col("sj")
    same = F.when(dy * ds > 0, 1.0).when(ds == 0, 0.5).otherwise(0.0)
    return pairs.agg((F.sum(same) / F.count(F.lit(1))).alias("regauc"), F.count(F.lit(1)).alias("pairs"))


# -- losses ---------------------------------------------------------------------------------------


def clamp_logit(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(-50.0)), F.lit(50.0))


def logloss(logit: Column, label: Column) -> Column:
    x = clamp_logit(logit)
    return F.greatest(x, F.lit(0.0)) - x * label + F.log1p(F.exp(-F.abs(x)))


def half_square(logit: Column, label: Column) -> Column:
    return F.pow(label - clamp_logit(logit), F.lit(2.0)) * 0.5


def _log_total(logits: Column) -> Column:
    """log Σ exp; clamped logits cannot overflow, so no shift by the maximum is needed."""
    return F.log(F.aggregate(logits, F.lit(0.0), lambda acc, v: acc + F.exp(clamp_logit(v))))


def _chosen(values: Column, label: Column) -> Column:
    return F.element_at(values, label.cast("int") + 1)


def _weights(class_weight: list[float], label: Column) -> Column:
    return _chosen(F.array(*[F.lit(float(w)) for w in class_weight]), label)


def cross_entropy(logits: Column, label: Column, class_weight: list[float] | None = None) -> Column:
    loss = _log_total(logits) - clamp_logit(_chosen(logits, label))
    return loss if class_weight is None else loss * _weights(class_weight, label)


def focal(logits: Column, label: Column, class_weight: list[float], gamma: float = 2.0, zero_extra: float = 1.05) -> Column:
    ce = cross_entropy(logits, label)
    weight = _weights(class_weight, label) * F.pow(1 - F.exp(-ce), F.lit(gamma))
    return F.when(label == 0, weight * zero_extra).otherwise(weight) * ce


def distilled(logits: Column, label: Column, buckets: int = 50, top: float = 1.0) -> Column:
    """Cross-entropy against a label spread over buckets, sharper for small labels. The spread sums to
    one, so the loss is the log total less the spread-weighted mean logit: one pass over the buckets."""
    step = top / (buckets - 1)
    pairs = F.transform(
        logits,
        lambda v, i: F.struct(F.exp(-F.abs(label - i * step) / (F.sqrt(label) + 1e-6)).alias("p"), clamp_logit(v).alias("v")),
    )
    zero = F.struct(F.lit(0.0).alias("p"), F.lit(0.0).alias("pv"))
    sums = F.aggregate(
        pairs,
        zero,
        lambda acc, x: F.struct((acc["p"] + x["p"]).alias("p"), (acc["pv"] + x["p"] * x["v"]).alias("pv")),
        lambda acc: acc["pv"] / acc["p"],
    )
    return _log_total(logits) - sums


def probability(logit: Column) -> Column:
    """Prediction of a log loss head."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-clamp_logit(logit)))


def class_shares(logits: Column) -> Column:
    """Prediction of a cross-entropy or focal head: softmax of the clamped logits."""
    total = _log_total(logits)
    return F.transform(logits, lambda v: F.exp(clamp_logit(v) - total))


def bucket_expectation(logits: Column, buckets: int = 50, top: float = 1.0) -> Column:
    """Prediction of a distilled head: the mean of the bucket labels under the softmax."""
    step = top / (buckets - 1)
    weighted = F.transform(class_shares(logits), lambda p, i: p * i * step)
    return F.aggregate(weighted, F.lit(0.0), lambda a, v: a + v)


def masked_mean(loss: Column, mask: Column | None = None, weight: float = 1.0) -> Column:
    """Sum over the mask, over its size or 1."""
    m = F.lit(1.0) if mask is None else mask.cast("double")
    return F.sum(loss * weight * m) / F.greatest(F.sum(m), F.lit(1.0))


def targeted_loss(t_pred: Column, y0: Column, y1: Column, t: Column, y: Column, eps: float, weight: float = 1.0) -> Column:
    """Targeted regularisation: the error after a push along the treatment residual."""
    p = (t_pred + 0.01) / 1.02
    h = t / p - (1 - t) / (1 - p)
    pushed = t * y1 + (1 - t) * y0 + h * eps
    return F.pow(y - pushed, F.lit(2.0)) * weight


def means_by_treatment(df: DataFrame, treatment: str, pred: str, label: str) -> DataFrame:
    return df.groupBy(treatment).agg(F.avg(pred).alias("pred_mean"), F.avg(label).alias("label_mean"), F.count(F.lit(1)).alias("n"))
