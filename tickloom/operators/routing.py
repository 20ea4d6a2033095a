"""Routing of new orders to accounts, in id order, without a group that holds a whole direction.

Accounts of a direction are numbered by (balance, name) and cut into ranges of ``size``. What the sequential rule (each
order takes the free account with the smallest sufficient balance) gives is found in parallel steps:

1. *In its own range*, an order wins only against orders of that range. Orders are dealt into pieces of at most
   ``piece``; each piece keeps who would win there, and the winners of several pieces are dealt again. Who loses once
   loses in its range (a larger set of earlier rivals never helps) and goes on to the next range.
2. *Carried orders* need less than any balance of the ranges they reach. So of the range's own winners and the carried
   orders together simply the first by id win, as many as the range has accounts, and the others are carried on. Which
   those are follows from counts: ids are cut into ascending buckets, the driver carries (range, bucket) counts along
   the ranges, and every bucket then settles by itself which of its orders stop where.
3. *Accounts*: inside a range its winners (never more than it has accounts) take accounts in id order, each by a
   next-free search over the sorted balances.

Every group is bounded by ``size``, ``piece`` or a bucket of about ``piece`` orders. The driver holds one number per range
and one count per range and bucket that occur together.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.operators.ledger import NO_ACCOUNT_REASON
from tickloom.operators.settle import eligible_accounts, needs
from tickloom.session import materialize

SIZE = 4096  # accounts of a range
PIECE = 50_000  # orders of a group


def _ranges(eligible: DataFrame, size: int) -> DataFrame:
    """(direction, account, available, nth, range): accounts numbered from 0 by (available, account). Sorted by range
    over many tasks; numbers continue from the counts of the tasks before."""
    key = ["direction", "available", "account"]
    cut = materialize(eligible.where("available is not null").select(*key).repartitionByRange(*key).withColumn("task", F.spark_partition_id()), "routing-accounts")
    before = Window.partitionBy("direction").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    tasks = cut.groupBy("direction", "task").agg(F.count(F.lit(1)).alias("n")).select("direction", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("direction", "task").orderBy("available", "account")) - 1
    nth = cut.withColumn("inside", inside).join(tasks, ["direction", "task"]).withColumn("nth", F.col("inside") + F.col("before"))
    return materialize(nth.select(*key, "nth", F.floor(F.col("nth") / F.lit(size)).cast("int").alias("range")), "routing-ranges")


def _bounds(ladder: DataFrame) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Per direction the highest balance and the number of accounts of every range."""
    rows = ladder.groupBy("direction", "range").agg(F.max("available").alias("high"), F.count(F.lit(1)).alias("n")).orderBy("direction", "range").toPandas()
    return {d: (g["high"].to_numpy(), g["n"].to_numpy()) for d, g in rows.groupby("direction")}


def _first_range(asked: DataFrame, bounds: dict) -> DataFrame:
    """Adds ``range``: the first range that holds a sufficient balance, null if none does."""

    def find(frames):
        for pdf in frames:
            out = np.full(len(pdf), -1)
            for direction, (high, _) in bounds.items():
                mine = ((pdf["direction"] == direction) & pdf["_margin"].notna()).to_numpy()
                at = np.searchsorted(high, pdf["_margin"].to_numpy(dtype=float)[mine], side="left")
                out[mine] = np.where(at < len(high), at, -1)
            yield pd.DataFrame({"id": pdf["id"], "direction": pdf["direction"], "_margin": pdf["_margin"], "range": out})

    found = asked.select("id", "direction", "_margin").mapInPandas(find, "id bigint, direction string, _margin double, range int")
    return found.withColumn("range", F.when(F.col("range") >= 0, F.col("range")))


def _dealt(orders: DataFrame, ladder: DataFrame, piece: int) -> tuple[DataFrame, DataFrame]:
    """Orders of a range in pieces of about ``piece``, and the range's accounts for every piece."""
    pieces = orders.groupBy("direction", "range").agg(F.ceil(F.count(F.lit(1)) / F.lit(piece)).cast("int").alias("pieces"))
    mine = orders.join(pieces, ["direction", "range"]).withColumn("piece", F.pmod(F.xxhash64("id"), F.col("pieces")).cast("int"))
    theirs = ladder.join(pieces, ["direction", "range"]).withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))).drop("pieces")
    return mine, theirs


def next_free(margins: list[float], balances: np.ndarray) -> list[int]:
    """For each margin in turn, the place of the smallest free balance that suffices, -1 if there is none."""
    n = len(balances)
    free = list(range(n + 1))  # free[i]: a place to look at next; a free place points to itself
    out = []
    for at in np.searchsorted(balances, margins, side="left").tolist():
        root = at
        while free[root] != root:
            root = free[root]
        while free[at] != root:
            free[at], at = root, free[at]
        if root == n:
            out.append(-1)
        else:
            out.append(root)
            free[root] = root + 1
    return out


def _native_winners(posed: DataFrame, ladder: DataFrame, piece: int) -> tuple[DataFrame, DataFrame]:
    """Who wins and who loses in the order's own range, carried orders left aside."""

    def walk(orders: pd.DataFrame, accounts: pd.DataFrame) -> pd.DataFrame:
        orders = orders.sort_values("id")
        got = next_free(orders["_margin"].tolist(), np.sort(accounts["available"].to_numpy()))
        return pd.DataFrame({"id": orders["id"], "direction": orders["direction"], "_margin": orders["_margin"], "range": orders["range"], "pieces": orders["pieces"], "won": np.array(got) >= 0})

    lost, left, before = [], posed, None
    while True:
        mine, theirs = _dealt(left, ladder, piece)
        found = materialize(mine.groupBy("direction", "range", "piece").cogroup(theirs.groupBy("direction", "range", "piece")).applyInPandas(walk, "id bigint, direction string, _margin double, range int, pieces int, won boolean"), "routing-native")
        lost.append(found.where("not won").select("id", "direction", "_margin", "range"))
        left = found.where("won").select("id", "direction", "_margin", "range")
        open_ranges, rows = found.where("pieces > 1").select("direction", "range").distinct(), left.count()
        if open_ranges.isEmpty():
            break
        if rows == before:  # every piece is full of winners: larger pieces
            piece *= 2
        before = rows
    losers = lost[0]
    for x in lost[1:]:
        losers = losers.union(x)
    return left, losers


def _stops(waiting: DataFrame, sizes: dict[str, np.ndarray]) -> DataFrame:
    """(id, direction, _margin, stop): the range in which each order wins, null if in none. ``waiting`` has ``enter``."""
    cut = materialize(waiting.repartitionByRange("direction", "id").withColumn("bucket", F.spark_partition_id()), "routing-waiting")
    counts = cut.groupBy("direction", "enter", "bucket").agg(F.count(F.lit(1)).alias("n")).toPandas()
    plan = {}
    for direction, mine in counts.groupby("direction"):
        buckets = sorted(mine["bucket"].unique())
        place = {b: i for i, b in enumerate(buckets)}
        arrive: dict[int, list] = {}
        for r in mine.itertuples():
            arrive.setdefault(r.enter, []).append((place[r.bucket], r.n))
        here, steps = np.zeros(len(buckets), np.int64), []
        for n in sizes[direction]:
            for b, more in arrive.get(len(steps), ()):
                here[b] += more
            total = np.cumsum(here)
            split = int(np.searchsorted(total, n, side="left")) if len(total) and total[-1] > n else len(buckets)
            taken = int(n - (total[split - 1] if split else 0)) if split < len(buckets) else 0
            steps.append((buckets[split] if split < len(buckets) else None, taken))
            here[:split] = 0
            if split < len(buckets):
                here[split] -= taken
        plan[direction] = steps

    def settle(orders: pd.DataFrame) -> pd.DataFrame:
        orders = orders.sort_values(["enter", "id"])
        enter, ids = orders["enter"].tolist(), orders["id"].tolist()
        bucket, stop, at, heap = orders["bucket"].iloc[0], np.full(len(orders), -1), 0, []
        for k, (split, taken) in enumerate(plan[orders["direction"].iloc[0]]):
            if at == len(ids) and not heap:
                break
            while at < len(ids) and enter[at] == k:
                heapq.heappush(heap, (ids[at], at))
                at += 1
            if heap and (split is None or bucket <= split):
                for _ in range(taken if bucket == split else len(heap)):
                    stop[heapq.heappop(heap)[1]] = k
        return pd.DataFrame({"id": orders["id"], "direction": orders["direction"], "_margin": orders["_margin"], "stop": stop})

    return cut.groupBy("direction", "bucket").applyInPandas(settle, "id bigint, direction string, _margin double, stop int").where("stop >= 0")


def assignments(posed: DataFrame, eligible: DataFrame, size: int = SIZE, piece: int = PIECE) -> DataFrame:
    """(id, account) of the orders (id, direction, _margin) that get one. Ids are distinct."""
    ladder = _ranges(eligible, size)
    bounds = _bounds(ladder)
    placed = _first_range(posed, bounds).where("range is not null")
    won, lost = _native_winners(placed, ladder, piece)
    waiting = won.withColumn("enter", F.col("range")).union(lost.withColumn("enter", F.col("range") + 1)).drop("range")
    stops = _stops(waiting, {d: n for d, (_, n) in bounds.items()})

    def take(orders: pd.DataFrame, accounts: pd.DataFrame) -> pd.DataFrame:
        orders, accounts = orders.sort_values("id"), accounts.sort_values("nth")
        got = np.array(next_free(orders["_margin"].tolist(), accounts["available"].to_numpy()), dtype=int)
        return pd.DataFrame({"id": orders["id"].to_numpy()[got >= 0], "_account": accounts["account"].to_numpy()[got[got >= 0]]})

    return stops.groupBy("direction", "stop").cogroup(ladder.groupBy("direction", "range")).applyInPandas(take, "id bigint, _account string")


def candidates(orders: DataFrame, eligible: DataFrame, total_btc: float, mark_price: float, size: int = SIZE, piece: int = PIECE) -> DataFrame:
    """Per new order: how many accounts could take it and the smallest balance among them, before any
    order of the round has taken one. One row per order throughout; no order-account pairs."""
    asked = needs(orders.filter(F.col("status") == "NEW"), total_btc, mark_price)
    ladder = _ranges(eligible, size)
    placed = materialize(_first_range(asked, _bounds(ladder)), "routing-placed")
    totals = ladder.groupBy("direction").agg(F.count(F.lit(1)).alias("total"))
    mine, theirs = _dealt(placed.where("range is not null"), ladder, piece)

    def look(orders: pd.DataFrame, accounts: pd.DataFrame) -> pd.DataFrame:
        accounts = accounts.sort_values("nth")
        at = np.searchsorted(accounts["available"].to_numpy(), orders["_margin"].to_numpy(), side="left") if len(orders) else np.zeros(0, int)
        return pd.DataFrame({"id": orders["id"], "direction": orders["direction"], "below": accounts["nth"].to_numpy()[at], "first_choice": accounts["account"].to_numpy()[at]})

    by = ("direction", "range", "piece")
    found = mine.groupBy(*by).cogroup(theirs.groupBy(*by)).applyInPandas(look, "id bigint, direction string, below bigint, first_choice string")
    found = found.join(totals, "direction").select("id", "direction", (F.col("total") - F.col("below")).cast("bigint").alias("n_accounts"), "first_choice")
    none = placed.where("range is null").select("id", "direction", F.lit(0).cast("bigint").alias("n_accounts"), F.lit(None).cast("string").alias("first_choice"))
    return found.union(none)


def route(orders: DataFrame, accounts: DataFrame, total_btc: float, mark_price: float, size: int = SIZE, piece: int = PIECE) -> DataFrame:
    """Assign new orders in id order, each to the free account with the smallest sufficient balance. An account takes
    one order per direction. Orders without an account, or without a quantity, are FAILED with the reason."""
    eligible = eligible_accounts(accounts, orders)
    asked = materialize(needs(orders.filter(F.col("status") == "NEW"), total_btc, mark_price), "routing-asked")
    rows = asked.join(assignments(asked.filter(F.col("_qty") > 0), eligible, size, piece), "id", "left")
    empty = F.col("_qty") <= 0
    taken = F.col("_account").isNotNull()
    zero = F.concat(F.lit("Calculated order quantity= "), F.col("_qty").cast("string"), F.lit(" is zero or negative"))
    return rows.select(
        "id",
        "direction",
        F.when(taken, "ASSIGNED").otherwise("FAILED").alias("status"),
        F.col("_account").alias("assigned_account"),
        F.when(taken, F.col("_qty")).alias("quantity"),
        F.when(empty, zero).when(~taken, F.lit(NO_ACCOUNT_REASON)).alias("failed_reason"),
    )
