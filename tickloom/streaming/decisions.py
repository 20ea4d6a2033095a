"""Streaming decisions: the rolling score queue and the last hour's valid decisions live in keyed state.

Everything that depends on one row alone is computed by expressions before the stateful step: for either
direction, whether the row would pass all checks after the threshold. The state then only ranks the score
and applies the moving threshold.
"""

from __future__ import annotations

import pickle
from bisect import bisect_left, insort
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from tickloom.operators import decide
from tickloom.operators.decide import NO_QUANTILE, StrategyConfig

STATE_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
FRAME_ROWS = 100_000
OUT = "symbol string, id bigint, sec bigint, final_score double, quantile double, direction string, is_valid boolean"


def with_outcomes(preds: DataFrame, cfg: StrategyConfig, strategy: str) -> DataFrame:
    """Row-wise part: score, and for each direction whether the later checks would pass. Predictions that carry
    a ``final_score`` are decoded already."""
    decoded = preds if "final_score" in preds.columns else decide.decode(preds, strategy)
    out = decoded.withColumn("quantile", F.lit(0.0))
    base = out.columns
    for d in ("LONG", "SHORT"):
        done = decide.finish(out.withColumn("direction", F.lit(d)), cfg, strategy)
        out = done.select(*base, F.col("is_valid").alias(f"ok_{d}"))
        base = out.columns
    return out.select("symbol", "id", F.unix_timestamp("timestamp").alias("sec"), "timestamp", "final_score", "ok_LONG", "ok_SHORT")


class Decider(StatefulProcessor):
    """State of a symbol: the last ``queue_length`` scores as a ring (place to score, so a batch rewrites only the places
    it fills), how many scores there have been, and the accepted decisions of the last hour.

    The rows of a micro-batch come in no order. Up to ``frame_rows`` of them are sorted in memory; beyond that they
    are laid by hour into a map state, which the store may put on disk, and taken out hour by hour, so memory follows
    one hour of one symbol and not the batch."""

    def __init__(self, cfg: StrategyConfig, strategy: str, frame_rows: int = FRAME_ROWS):
        self.cfg, self.strategy, self.frame_rows = cfg, strategy, frame_rows

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.ring = handle.getMapState("ring", "place int", "score double")
        self.total = handle.getValueState("total", "n bigint")
        self.recent = handle.getListState("recent", "direction string, sec bigint")
        self.inbox = handle.getMapState("inbox", "hour bigint, part int", "rows binary")

    def _in_order(self, frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, rows, hours, parts = [], 0, set(), 0
        for frame in frames:
            held.append(frame)
            rows += len(frame)
            if rows > self.frame_rows:
                both = pd.concat(held)
                for hour, part in both.groupby(both["sec"].fillna(0).astype("int64") // 3600):
                    self.inbox.updateValue((int(hour), parts), (pickle.dumps(part),))
                    hours.add((int(hour), parts))
                held, rows, parts = [], 0, parts + 1
        if not hours:
            if held:
                yield pd.concat(held).sort_values(["timestamp", "id"])
            return
        rest = pd.concat(held) if held else None
        by_hour: dict[int, list[int]] = {}
        for hour, part in sorted(hours):
            by_hour.setdefault(hour, []).append(part)
        left = {int(h): g for h, g in rest.groupby(rest["sec"].fillna(0).astype("int64") // 3600)} if rest is not None else {}
        for hour in sorted({*by_hour, *left}):
            stored = [pickle.loads(self.inbox.getValue((hour, part))[0]) for part in by_hour.get(hour, ())]
            for part in by_hour.get(hour, ()):
                self.inbox.removeKey((hour, part))
            yield pd.concat([*stored, *([left[hour]] if hour in left else [])]).sort_values(["timestamp", "id"])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        size = self.cfg.queue_length
        n = self.total.get()[0] if self.total.exists() else 0
        ring = {k[0]: v[0] for k, v in self.ring.iterator()}
        queue = deque(ring[i % size] for i in range(max(0, n - size), n))
        ranked, recent, fresh = sorted(queue), [(r[0], r[1]) for r in self.recent.get()], 0
        for frame in self._in_order(rows):
            out = []
            recent, more = self._walk(key[0], frame, queue, ranked, recent, out)
            fresh += more
            yield pd.DataFrame(out, columns=["symbol", "id", "sec", "final_score", "quantile", "direction", "is_valid"])
        for back, score in enumerate(list(queue)[::-1][: min(fresh, size)]):
            self.ring.updateValue(((n + fresh - 1 - back) % size,), (score,))
        self.total.update((n + fresh,))
        self.recent.put(recent) if recent else self.recent.clear()

    def _walk(self, symbol, frame, queue, ranked, recent, out) -> tuple[list, int]:
        """Decide the sorted rows; the accepted decisions of the last hour and how many scores were added."""
        cfg, fresh = self.cfg, 0
        first = self.strategy == "first"
        for r in frame.itertuples():
            score, at = r.final_score, r.sec
            if pd.isna(score):
                out.append((symbol, r.id, at, None, NO_QUANTILE, "", False))
                continue
            q = bisect_left(ranked, score) / cfg.queue_length if len(queue) == cfg.queue_length else NO_QUANTILE
            recent = [(d, s) for d, s in recent if s >= at - cfg.recent_seconds]
            n_long = sum(d == "LONG" for d, _ in recent)
            top = 1.0 - (1.0 - cfg.top_threshold) / (cfg.k * n_long + 1)
            bottom = cfg.bottom_threshold / (cfg.k * (len(recent) - n_long) + 1)
            direction = ""
            if q != NO_QUANTILE and q >= top and (not first or score > 0):
                direction = "LONG"
            elif q != NO_QUANTILE and q <= bottom and (not first or score < 0):
                direction = "SHORT"
            valid = bool(direction and getattr(r, f"ok_{direction}"))
            if valid:
                recent = [*recent, (direction, at)]
            out.append((symbol, r.id, at, score, q, direction, valid))
            queue.append(score)
            insort(ranked, score)
            fresh += 1
            if len(queue) > cfg.queue_length:
                ranked.pop(bisect_left(ranked, queue.popleft()))
        return recent, fresh

    def close(self) -> None:
        pass


def decide_stream(preds: DataFrame, cfg: StrategyConfig = StrategyConfig(), strategy: str = "ple", frame_rows: int = FRAME_ROWS) -> DataFrame:
    """Predictions stream to decisions. Rows of a micro-batch are decided in order of time; of more than ``frame_rows``
    of one symbol only an hour at a time is in memory."""
    ready = with_outcomes(preds, cfg, strategy)
    return ready.groupBy("symbol").transformWithStateInPandas(
        Decider(cfg, strategy, frame_rows), outputStructType=OUT, outputMode="Append", timeMode="None"
    )


def start(decisions: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    # several state variables per key need the RocksDB store
    decisions.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_PROVIDER)
    return (
        decisions.writeStream.format("parquet").outputMode("append").option("path", path)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
