"""Rolling series as numpy arrays: the same vocabulary as ``rolling``, for one bounded group at a time.

A full feature set is a hundred formulas; as window expressions they cost the driver and the code generator
more than the data does. Here a formula runs unchanged on ``Values`` instead of ``Series``: Spark partitions,
shuffles and sorts the (symbol, chunk) groups, and one Arrow pass evaluates all formulas of a group. Missing
is NaN; comparisons with it are false, as an unknown condition is in ``rolling.when``.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from tickloom.functions import kernels


def _quotient(a, b):
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(np.equal(b, 0), np.nan, np.divide(a, np.where(np.equal(b, 0), 1.0, b)))


_OPS: dict[str, Callable] = {
    "+": np.add, "-": np.subtract, "*": np.multiply, "/": _quotient, "<": np.less, "<=": np.less_equal, ">": np.greater, ">=": np.greater_equal,
    "=": np.equal, "AND": np.logical_and, "OR": np.logical_or, "least": np.fmin, "pow": np.power,
}
_MAPS: dict[str, Callable] = {
    "sqrt": np.sqrt, "up": lambda x: np.maximum(x, 0.0), "down": lambda x: np.maximum(-x, 0.0), "neg": np.negative, "abs": np.abs, "sign": np.sign,
}


class Values:
    """A column of a group; its key names how it came about, so that equal parts are evaluated once."""

    __slots__ = ("key", "v")

    def __init__(self, key: str, v):
        self.key, self.v = key, v

    @staticmethod
    def of(x) -> "Values":
        """A column, a constant series or a number."""
        return x if isinstance(x, Values) else Values(str(getattr(x, "key", x)), float(getattr(x, "key", x)))

    def binary(self, other, op: str) -> "Values":
        right = Values.of(other)
        with np.errstate(invalid="ignore", over="ignore", divide="ignore"):
            return Values(f"({self.key} {op} {right.key})", _OPS[op](self.v, right.v))

    def __add__(self, o):
        return self.binary(o, "+")

    def __sub__(self, o):
        return self.binary(o, "-")

    def __mul__(self, o):
        return self.binary(o, "*")

    def __truediv__(self, o):
        return self.binary(o, "/")

    def __lt__(self, o):
        return self.binary(o, "<")

    def __le__(self, o):
        return self.binary(o, "<=")

    def __gt__(self, o):
        return self.binary(o, ">")

    def __ge__(self, o):
        return self.binary(o, ">=")

    def __and__(self, o):
        return self.binary(o, "AND")

    def __or__(self, o):
        return self.binary(o, "OR")

    def same(self, o):
        return self.binary(o, "=")

    def map(self, label: str, sql: str = "") -> "Values":
        with np.errstate(invalid="ignore"):
            return Values(f"{label}({self.key})", _MAPS[label](self.v))

    def __neg__(self):
        return self.map("neg")

    def abs(self):
        return self.map("abs")

    def sign(self):
        return self.map("sign")

    def fill(self, value: float = 0.0):
        return Values(f"fill{value}({self.key})", np.where(np.isnan(self.v), value, self.v))

    def clean(self):
        return Values(f"clean({self.key})", np.where(np.isfinite(self.v), self.v, 0.0))


def when(cond: Values, yes, no) -> Values:
    yes, no = Values.of(yes), Values.of(no)
    return Values(f"if({cond.key},{yes.key},{no.key})", np.where(cond.v, yes.v, no.v))


class ArrayRolling:
    """Windows over the rows of one group, in order."""

    def __init__(self, columns: dict[str, np.ndarray]):
        self.columns = {c: np.where(np.isfinite(v), v, np.nan) for c, v in columns.items()}
        self.rows = len(next(iter(columns.values()))) if columns else 0
        self._done: dict[tuple, Values] = {}

    def _once(self, name: str, xs: tuple[Values, ...], numbers: tuple, make: Callable[[], np.ndarray]) -> Values:
        key = (name, *[x.key for x in xs], *numbers)
        if key not in self._done:
            self._done[key] = Values(f"{name}[{','.join(x.key for x in xs)};{numbers}]", make())
        return self._done[key]

    def _full(self, x: Values) -> np.ndarray:
        return np.broadcast_to(np.asarray(x.v, dtype=float), (self.rows,))

    def source(self, column: str) -> Values:
        return Values(column, self.columns[column])

    def lag(self, x: Values, p: int = 1) -> Values:
        def make():
            out = np.full(self.rows, np.nan)
            if p < self.rows:
                out[p:] = self._full(x)[: self.rows - p]
            return out

        return self._once("lag", (x,), (p,), make)

    def delta(self, x: Values, p: int = 1) -> Values:
        return x - self.lag(x, p)

    def pct(self, x: Values, p: int = 1) -> Values:
        return x / self.lag(x, p) - 1.0

    def kernel(self, kind: str, x: Values, w: int, *params, other: Values | None = None) -> Values:
        xs = (x,) if other is None else (x, other)
        return self._once(kind, xs, (w, *params), lambda: kernels.evaluate(kind, self._full(x), w, params, None if other is None else self._full(other)))

    def sum(self, x, w):
        return self.kernel("sum", x, w)

    def mean(self, x, w):
        return self.kernel("mean", x, w)

    def std(self, x, w):
        return self.kernel("std", x, w)

    def skew(self, x, w):
        return self.kernel("skew", x, w)

    def corr(self, x, y, w):
        return self.kernel("corr", x, w, other=y)

    def cov(self, x, y, w):
        return self.kernel("cov", x, w, other=y)

    def min(self, x, w):
        return self.kernel("min", x, w)

    def max(self, x, w, native: bool = False):
        return self.kernel("max", x, w)

    def rank(self, x, w):
        return self.kernel("rank", x, w)

    def rank_below_top(self, x, top: int, w: int):
        return self.kernel("rank_below_top", x, w, top)

    def first_in(self, x, w):
        whole = self.kernel("min", x, w)
        return Values(f"first[{x.key};{w}]", np.where(np.isnan(whole.v), np.nan, self.lag(x, w - 1).v))
