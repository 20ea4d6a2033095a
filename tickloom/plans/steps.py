"""Jobs from configuration: named lists of steps, each a DataFrame-to-DataFrame function.

    {"default": "a", "methods": {"m": "b"}, "jobs": {"a": {"steps": [{"type": "..."}]}, "b": {...}}}

A step works on what the step before it made. ``"as": "x"`` names its result and ``"from": "x"`` takes an earlier named
result instead (``input`` is the job's own input), so a job can branch: scores, orders and records are written from one
decided table. A result that several steps take is written once to the shared folder.

The whole configuration is parsed, settings included, before any step runs; an error lists every fault.
"""

from __future__ import annotations

import inspect
import json
import os
from collections import Counter
from collections.abc import Callable, Mapping
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.session import materialize

Step = Callable[..., DataFrame]
INPUT, LAST = "input", ""


class ConfigError(ValueError):
    pass


def load(path: str) -> dict[str, Any]:
    if not os.path.exists(path):
        raise ConfigError(f"no such configuration: {path}")
    with open(path, encoding="utf-8") as f:
        try:
            return json.load(f)
        except json.JSONDecodeError as e:
            raise ConfigError(f"{path} is not JSON: {e}") from e


@dataclass(frozen=True)
class Stage:
    """One step of a job: the function that runs it and its settings."""

    fn: Step
    settings: dict[str, Any]
    source: str | None = None
    name: str | None = None


@dataclass(frozen=True)
class Plan:
    """A configuration in which every name leads somewhere and every step can be called."""

    jobs: dict[str, tuple[Stage, ...]]
    methods: dict[str, str]
    default: str


def _settings_fault(fn: Step, settings: dict[str, Any]) -> str | None:
    """Why a step cannot be called with these settings, from its own signature."""
    try:
        inspect.signature(fn).bind(None, **settings)
    except TypeError as e:
        return str(e)
    return None


def parse(config: Any, registry: Mapping[str, Step]) -> Plan:
    """The plan a configuration describes. All faults are gathered, each with its path, and raised together."""
    faults: list[str] = []

    def section(value: Any, path: str, kind: type, default: Any) -> Any:
        if isinstance(value, kind):
            return value
        faults.append(f"{path}: want {kind.__name__}, got {type(value).__name__}")
        return default

    top = section(config, "$", dict, {})
    jobs: dict[str, tuple[Stage, ...]] = {}
    for name, body in section(top.get("jobs"), "$.jobs", dict, {}).items():
        stages = []
        listed = section(section(body, f"$.jobs.{name}", dict, {}).get("steps"), f"$.jobs.{name}.steps", list, [])
        named = {INPUT}
        for at, item in enumerate(listed):
            path = f"$.jobs.{name}.steps.{at}"
            settings = dict(section(item, path, dict, {}))
            source, label = settings.pop("from", None), settings.pop("as", None)
            if source is not None and source not in named:
                faults.append(f"{path}.from: {source!r} is none of {sorted(named)}")
            if label is not None and (not isinstance(label, str) or label in named):
                faults.append(f"{path}.as: {label!r} is no new name")
            elif label is not None:
                named.add(label)
            fn = registry.get(str(settings.pop("type", "")))
            fault = f"no step of this type among {sorted(registry)}" if fn is None else _settings_fault(fn, settings)
            if fault:
                faults.append(f"{path}: {fault}")
            else:
                stages.append(Stage(fn, settings, source, label))
        if not listed:
            faults.append(f"$.jobs.{name}.steps: empty job")
        jobs[name] = tuple(stages)
    methods = section(top.get("methods", {}), "$.methods", dict, {})
    wanted = {"$.default": top.get("default"), **{f"$.methods.{m}": j for m, j in methods.items()}}
    faults += [f"{path}: {job!r} is not a job" for path, job in wanted.items() if not isinstance(job, str) or job not in jobs]
    if faults:
        raise ConfigError("; ".join(faults))
    return Plan(jobs, methods, top["default"])


def choose(plan: Plan, job: str | None = None, method: str | None = None) -> str:
    """An explicit job wins over a method, a method over the default."""
    for asked, known in ((job, {j: j for j in plan.jobs}), (method, plan.methods)):
        if name := (asked or "").strip():
            if name not in known:
                raise ConfigError(f"{name!r} is none of {sorted(known)}")
            return known[name]
    return plan.default


def need(df: DataFrame, *columns: str) -> DataFrame:
    """Steps state their input columns up front, so that a wrong order fails before a job starts."""
    gone = [c for c in columns if c not in df.columns]
    if gone:
        raise ConfigError(f"step needs columns {gone}, has {df.columns}")
    return df


def run(df: DataFrame, config: Any, registry: Mapping[str, Step], job: str | None = None, method: str | None = None) -> DataFrame:
    """The result of the job's last step."""
    return run_all(df, config, registry, job, method)[LAST]


def run_all(df: DataFrame, config: Any, registry: Mapping[str, Step], job: str | None = None, method: str | None = None) -> dict[str, DataFrame]:
    """Every named result of a job, and the last one under ``LAST``."""
    plan = parse(config, registry)
    stages = plan.jobs[choose(plan, job, method)]
    # a named result is also taken by the step after it, if that names no other source
    readers = Counter(s.source for s in stages) + Counter(a.name for a, b in zip(stages, stages[1:]) if b.source is None)
    made = {INPUT: df}
    for stage in stages:
        df = made[stage.source] if stage.source is not None else df
        df = df.transform(stage.fn, **stage.settings)
        if stage.name is not None:
            df = made[stage.name] = materialize(df, f"job-{stage.name}") if readers[stage.name] > 1 else df
    return made | {LAST: df}


# -- the shipped steps ----------------------------------------------------------------------------


def _klines(df: DataFrame, column: str = "klines") -> DataFrame:
    from tickloom.sources.bars import parse_klines

    return parse_klines(need(df, "symbol", column), column)


def _range(df: DataFrame, start: str, end: str) -> DataFrame:
    from tickloom.sources.bars import time_range

    return time_range(need(df, "timestamp"), start, end)


def _vectors(df: DataFrame, width: int = 111, history: int = 14000, config: dict | None = None) -> DataFrame:
    from tickloom.operators.features import feature_vectors

    return feature_vectors(need(df, "symbol", "timestamp", "open", "high", "low", "close", "volume"), width, history, config)


def _score(df: DataFrame, weights: str, model: str = "ple") -> DataFrame:
    from tickloom.operators.scoring import load_weights, score

    need(df, "symbol", "timestamp", "features")
    return score(df, model, load_weights(df.sparkSession, weights), keep=("symbol", "timestamp"))


def _decide(df: DataFrame, strategy: str = "ple", **settings) -> DataFrame:
    from tickloom.operators.decide import StrategyConfig, decide

    need(df, "symbol", "timestamp", "id", "cur_price")
    return decide(df, strategy, StrategyConfig(**settings))


def _price(df: DataFrame, bars: str) -> DataFrame:
    from tickloom.sources.bars import read_bars, with_current_price

    return with_current_price(need(df, "symbol"), read_bars(df.sparkSession, bars))


def _stats(df: DataFrame, window: int = 60) -> DataFrame:
    from tickloom.operators.features import previous_window_stats

    return previous_window_stats(need(df, "symbol", "timestamp", "open", "high", "low", "close", "volume"), window)


def _offline(df: DataFrame, config: dict | None = None, window: int = 50000, tail: int = 1440) -> DataFrame:
    from tickloom.operators.features import offline_matrix

    return offline_matrix(need(df, "symbol", "timestamp", "open", "high", "low", "close", "volume"), config, window, tail)


def _first_inputs(df: DataFrame, count: int) -> DataFrame:
    return need(df, "features").withColumn("features", F.slice(F.transform("features", lambda v: v.cast("double")), 1, count))


# Sinks write what they get and hand it on unchanged. ``batch`` makes a repeated run of a writer's batch do nothing.


def _write_orders(df: DataFrame, path: str, writer: str, batch: int | None = None) -> DataFrame:
    from tickloom.sources.ledgers import write_orders

    write_orders(df.sparkSession, path, need(df, "id", "symbol", "direction", "is_valid"), writer, batch)
    return df


def _write_scores(df: DataFrame, path: str, writer: str, batch: int | None = None) -> DataFrame:
    from tickloom.sources.ledgers import write_scores

    write_scores(df.sparkSession, path, need(df, "id", "symbol", "final_score", "is_valid"), writer, batch)
    return df


def _write_bars(df: DataFrame, path: str, writer: str, batch: int | None = None) -> DataFrame:
    from tickloom.sources.commits import commit_bars

    commit_bars(df.sparkSession, path, need(df, "symbol", "interval", "timestamp"), writer, batch)
    return df


def _write_records(df: DataFrame, path: str, model_name: str = "ple") -> DataFrame:
    from tickloom.sources.records import append_records, to_records

    need(df, "symbol", "timestamp", "features")
    defaults = {
        "request_id": F.concat_ws("_", "symbol", F.unix_timestamp("timestamp").cast("string")), "model_name": F.lit(model_name),
        "ohlcv_data": F.lit(None).cast("string"), "model_output": F.lit(None).cast("string"),
    }
    append_records(to_records(df.withColumns({c: v for c, v in defaults.items() if c not in df.columns})), path)
    return df


def _number(df: DataFrame) -> DataFrame:
    return df.withColumn("id", F.xxhash64("symbol", "timestamp"))


REGISTRY: dict[str, Step] = {
    "klines": _klines,
    "time_range": _range,
    "vectors": _vectors,
    "score": _score,
    "current_price": _price,
    "number": _number,
    "decide": _decide,
    "previous_window_stats": _stats,
    "offline": _offline,
    "first_inputs": _first_inputs,
    "write_orders": _write_orders,
    "write_scores": _write_scores,
    "write_bars": _write_bars,
    "write_records": _write_records,
}
