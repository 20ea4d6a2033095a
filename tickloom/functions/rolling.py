"""Rolling series as Spark expressions.

``Rolling`` hands out ``Series``: SQL expressions that know which windowed columns they stand on (text,
because a full feature set is thousands of nodes, and a Column object each would cost the driver more
than the plan). Each distinct (function, inputs, width) is one hidden column, however many features use it, and all hidden
columns of one dependency level are computed by a single ``select`` - one Window node per level over the
same (symbol, chunk) exchange and sort.

Cost rules:

* sums, means, deviations, correlations, skewness: plain frames up to ``frame_limit`` rows; above it window sums
  that never subtract, in the Arrow pass (constant work per row whatever the width). Both forget a value as soon
  as it has left the window;
* min/max: plain frames up to ``extreme_limit`` rows; above it an Arrow kernel;
* rank of the last value: ``collect_list`` and a higher-order function up to ``rank_limit`` rows; above
  it an Arrow kernel. Spectral and wavelet measures are always kernels.

All kernels that read no other kernel run in one pass (``kernels.run``), between the frames they read and the
frames that read them; kernels that read kernels take another pass.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import wraps

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions import arrays, kernels
from tickloom.functions.layout import CHUNK


@dataclass(frozen=True)
class Series:
    key: str
    sql: str = field(compare=False, hash=False)
    deps: frozenset[str] = frozenset()
    lookback: int = 0

    @property
    def c(self) -> Column:
        return F.expr(self.sql)

    def _binary(self, other, op: str, sql: str | None = None) -> "Series":
        if isinstance(other, arrays.Values):
            return arrays.Values.of(self).binary(other, op)
        right = other if isinstance(other, Series) else number(other)
        text = (sql or f"({{}} {op} {{}})").format(self.sql, right.sql)
        return Series(f"({self.key} {op} {right.key})", text, self.deps | right.deps, max(self.lookback, right.lookback))

    def __add__(self, o):
        return self._binary(o, "+")

    def __sub__(self, o):
        return self._binary(o, "-")

    def __mul__(self, o):
        return self._binary(o, "*")

    def __truediv__(self, o):
        return self._binary(o, "/", "try_divide({}, {})")

    def __neg__(self):
        return self.map("neg", "(- {})")

    def __lt__(self, o):
        return self._binary(o, "<")

    def __le__(self, o):
        return self._binary(o, "<=")

    def __gt__(self, o):
        return self._binary(o, ">")

    def __ge__(self, o):
        return self._binary(o, ">=")

    def __and__(self, o):
        return self._binary(o, "AND")

    def __or__(self, o):
        return self._binary(o, "OR")

    def same(self, o):
        return self._binary(o, "=")

    def map(self, label: str, sql: str) -> "Series":
        """Row-wise SQL over this series, written ``{}``."""
        return Series(f"{label}({self.key})", sql.format(self.sql), self.deps, self.lookback)

    def abs(self):
        return self.map("abs", "abs({})")

    def sign(self):
        return self.map("sign", "signum({})")

    def fill(self, value: float = 0.0):
        return self.map(f"fill{value}", f"coalesce({{}}, {number(value).sql})")

    def clean(self):
        """Missing or infinite to 0."""
        return self.map("clean", "CASE WHEN abs({0}) < double('Infinity') THEN {0} ELSE 0.0D END")


def number(value) -> Series:
    return Series(repr(value), f"({float(value)!r}D)")


MISSING = Series("null", "CAST(NULL AS DOUBLE)")


def when(cond: Series, yes, no) -> Series:
    """``yes`` where the condition is true, ``no`` where it is false or unknown."""
    if isinstance(cond, arrays.Values):
        return arrays.when(cond, yes, no)
    yes = yes if isinstance(yes, Series) else number(yes)
    no = no if isinstance(no, Series) else number(no)
    return Series(
        f"if({cond.key},{yes.key},{no.key})",
        f"CASE WHEN {cond.sql} THEN {yes.sql} ELSE {no.sql} END",
        cond.deps | yes.deps | no.deps,
        max(cond.lookback, yes.lookback, no.lookback),
    )


def least(a: Series, b: Series) -> Series:
    if isinstance(a, arrays.Values):
        return a.binary(b, "least")
    return a._binary(b, "least", "least({}, {})")


def power(a: Series, b: Series) -> Series:
    if isinstance(a, arrays.Values):
        return a.binary(b, "pow")
    return a._binary(b, "pow", "pow({}, {})")


def once(fn):
    """Build a series once per (function, input keys, widths); building columns is the driver's cost."""

    @wraps(fn)
    def cached(self, *args, **kwargs):
        key = (fn.__name__, *[a.key if isinstance(a, Series) else a for a in args], *kwargs.items())
        if key not in self._built:
            self._built[key] = fn(self, *args, **kwargs)
        return self._built[key]

    return cached


@dataclass
class _Node:
    name: str
    sql: str | None
    deps: frozenset[str]
    kernel: kernels.Kernel | None = None


class Rolling:
    def __init__(
        self,
        keys: tuple[str, ...] = ("symbol", CHUNK),
        order: tuple[str, ...] = ("timestamp",),
        frame_limit: int = 32,
        extreme_limit: int = 64,
        rank_limit: int = 32,
    ):
        self.keys, self.order = keys, order
        self.frame_limit, self.extreme_limit, self.rank_limit = frame_limit, extreme_limit, rank_limit
        self._over_rows = f"PARTITION BY {', '.join(keys)} ORDER BY {', '.join(order)}"
        self._running = f"OVER ({self._over_rows} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
        self._nodes: dict[str, _Node] = {}
        self._built: dict[tuple, object] = {}

    # -- building blocks ------------------------------------------------------------------------

    def source(self, column: str) -> Series:
        return Series(column, f"`{column}`")

    def _hidden(self, key: str, sql: str | None, deps: frozenset[str], lookback: int, kernel=None) -> Series:
        node = self._nodes.get(key)
        if node is None:
            node = _Node(f"_r{len(self._nodes)}", sql, deps)
            if kernel:
                node.kernel = kernel(node.name)
            self._nodes[key] = node
        return Series(key, node.name, frozenset({key}), lookback)

    def previous(self, agg: str, x: Series, w: int) -> Series:
        """``agg`` (SQL with ``{}``) over the w rows before the current one."""
        over = f"OVER ({self._over_rows} ROWS BETWEEN {w} PRECEDING AND 1 PRECEDING)"
        return self._hidden(f"{agg}<[{x.key};{w}]", f"{agg.format(x.sql)} {over}", x.deps, x.lookback + w)

    def _over(self, fn: str, xs: tuple[Series, ...], w: int) -> Series:
        key = f"{fn}[{','.join(x.key for x in xs)};{w}]"
        deps = frozenset().union(*[x.deps for x in xs])
        back = max(x.lookback for x in xs) + w - 1
        sql = f"{fn}({', '.join(x.sql for x in xs)}) OVER ({self._over_rows} ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)"
        return self._hidden(key, sql, deps, back)

    def _run(self, agg: str, x: Series) -> Series:
        """``agg`` (SQL with ``{}``) from the chunk's first row to the current one."""
        return self._hidden(f"{agg}~[{x.key}]", f"{agg.format(x.sql)} {self._running}", x.deps, x.lookback)

    @once
    def lag(self, x: Series, p: int = 1) -> Series:
        return self._hidden(f"lag[{x.key};{p}]", f"lag({x.sql}, {p}) OVER ({self._over_rows})", x.deps, x.lookback + p)

    @once
    def delta(self, x: Series, p: int = 1) -> Series:
        return x - self.lag(x, p)

    @once
    def pct(self, x: Series, p: int = 1) -> Series:
        return x / self.lag(x, p) - 1.0

    @once
    def count(self, x: Series, w: int) -> Series:
        if w <= self.frame_limit:
            return self._over("count", (x,), w)
        running = self._run("count({})", x)
        return running - self.lag(running, w).fill()

    def _full(self, x: Series, w: int, value: Series) -> Series:
        out = when(self.count(x, w).same(float(w)), value, MISSING)
        return Series(value.key, out.sql, out.deps, max(out.lookback, x.lookback + w - 1))

    # -- moments: a plain frame, or window sums that never subtract in the Arrow pass -------------------

    @once
    def before(self, x: Series, w: int) -> tuple[Series, Series]:
        """Mean and deviation of the w rows before the current one, from the first row on."""
        if w <= self.frame_limit:
            return self.previous("avg({})", x, w), self.previous("stddev_samp({})", x, w)
        return self.kernel("before_mean", x, w + 1), self.kernel("before_std", x, w + 1)

    def spread(self, x: Series, w: int) -> Series:
        """Sample deviation of up to w rows, current one included, holes skipped."""
        return self._over("stddev_samp", (x,), w) if w <= self.frame_limit else self.kernel("spread", x, w)

    @once
    def sum(self, x: Series, w: int) -> Series:
        return self._full(x, w, self._over("sum", (x,), w)) if w <= self.frame_limit else self.kernel("sum", x, w)

    @once
    def mean(self, x: Series, w: int) -> Series:
        return self._full(x, w, self._over("avg", (x,), w)) if w <= self.frame_limit else self.kernel("mean", x, w)

    @once
    def std(self, x: Series, w: int) -> Series:
        return self._full(x, w, self._over("stddev_samp", (x,), w)) if w <= self.frame_limit else self.kernel("std", x, w)

    @once
    def _pair(self, x: Series, y: Series) -> tuple[Series, Series]:
        """Both series with a hole wherever either has one."""
        px = Series(f"({x.key}|{y.key})", f"CASE WHEN {y.sql} IS NOT NULL THEN {x.sql} END", x.deps | y.deps, max(x.lookback, y.lookback))
        py = Series(f"({y.key}|{x.key})", f"CASE WHEN {x.sql} IS NOT NULL THEN {y.sql} END", x.deps | y.deps, max(x.lookback, y.lookback))
        return px, py

    @once
    def corr(self, x: Series, y: Series, w: int) -> Series:
        if w > self.frame_limit:
            return self.kernel("corr", x, w, other=y)
        # not F.corr, which divides by zero on a constant window
        px, py = self._pair(x, y)
        spread = self._over("stddev_samp", (px,), w) * self._over("stddev_samp", (py,), w)
        return self._full(px, w, self._over("covar_samp", (x, y), w) / spread)

    @once
    def cov(self, x: Series, y: Series, w: int) -> Series:
        if w > self.frame_limit:
            return self.kernel("cov", x, w, other=y)
        return self._full(self._pair(x, y)[0], w, self._over("covar_samp", (x, y), w))

    # -- everything else ------------------------------------------------------------------------

    @once
    def min(self, x: Series, w: int) -> Series:
        return self._extreme("min", x, w)

    @once
    def max(self, x: Series, w: int, native: bool = False) -> Series:
        return self._extreme("max", x, w, native)

    def _extreme(self, fn: str, x: Series, w: int, native: bool = False) -> Series:
        if w <= self.extreme_limit or native:
            return self._full(x, w, self._over(fn, (x,), w))
        return self.kernel(fn, x, w)

    @once
    def skew(self, x: Series, w: int) -> Series:
        """Bias-adjusted skewness; 0 when the spread is numerically nil, as the reference has it."""
        if w > self.frame_limit:
            return self.kernel("skew", x, w)
        adjust = (w * (w - 1.0)) ** 0.5 / (w - 2.0)
        spread, skew = self._over("var_pop", (x,), w), self._over("skewness", (x,), w)
        return self._full(x, w, when(spread <= 1e-14, 0.0, skew * adjust))

    def product(self, x: Series, w: int) -> Series:
        if w > self.rank_limit:
            return self.kernel("product", x, w)
        return self._full(x, w, self._list(x, w).map("product", "aggregate({}, 1.0D, (_a, _v) -> _a * _v)"))

    def first_in(self, x: Series, w: int) -> Series:
        return self._full(x, w, self.lag(x, w - 1))

    def _list(self, x: Series, w: int) -> Series:
        return self._over("collect_list", (x,), w)

    @once
    def rank(self, x: Series, w: int) -> Series:
        """Average rank (1..w) of the newest value among the last w."""
        if w > self.rank_limit:
            return self.kernel("rank", x, w)
        values = self._list(x, w)
        less, equal = (f"size(filter({values.sql}, _v -> _v {op} {x.sql}))" for op in ("<", "="))
        out = Series(f"rank[{x.key};{w}]", f"({less} + ({equal} + 1) / 2.0D)", values.deps | x.deps, values.lookback)
        return self._full(x, w, out)

    def rank_below_top(self, x: Series, top: int, w: int) -> Series:
        """Rank over ``w`` rows of the distance to the highest value of the last ``top`` rows."""
        if w > self.rank_limit or top > self.extreme_limit:
            out = self.kernel("rank_below_top", x, w, top)
            return Series(out.key, out.sql, out.deps, out.lookback + top - 1)
        return self.rank(x - self.max(x, top), w)

    def arg(self, fn: str, x: Series, w: int) -> Series:
        """1-based position of the window's first maximum or minimum."""
        values = self._list(x, w)
        out = values.map(f"arg{fn}", f"double(array_position({{0}}, array_{fn}({{0}})))")
        return self._full(x, w, out)

    def kernel(self, kind: str, x: Series, w: int, *params, other: Series | None = None) -> Series:
        key = f"{kind}[{x.key};{w};{params}]" if other is None else f"{kind}[{x.key},{other.key};{w}]"
        deps = x.deps if other is None else x.deps | other.deps
        back = max(x.lookback, other.lookback if other else 0) + w - 1
        return self._hidden(key, None, deps, back, lambda name: kernels.Kernel(kind, name, x, w - 1 if kind.startswith("before") else w, params, other))

    # -- execution ------------------------------------------------------------------------------

    def _closure(self, roots: frozenset[str], stop: frozenset[str]) -> set[str]:
        seen, todo = set(), list(roots)
        while todo:
            key = todo.pop()
            if key in seen or key in stop:
                continue
            seen.add(key)
            todo.extend(self._nodes[key].deps)
        return seen

    def _compute(self, df: DataFrame, wanted: set[str], ready: frozenset[str]) -> DataFrame:
        done = set(ready)
        left = wanted - done
        while left:
            level = [k for k in self._nodes if k in left and self._nodes[k].deps <= done]
            df = df.selectExpr("*", *[f"{self._nodes[k].sql} AS {self._nodes[k].name}" for k in level])
            done |= set(level)
            left -= set(level)
        return df

    def select(self, df: DataFrame, outputs: dict[str, Series], keep: tuple[str, ...] | None = None) -> DataFrame:
        """``keep`` columns (default: all of ``df``) plus one column per output."""
        keep = tuple(df.columns) if keep is None else keep
        roots = frozenset().union(*[s.deps for s in outputs.values()]) if outputs else frozenset()
        used = self._closure(roots, frozenset())
        pending = {k for k in self._nodes if k in used and self._nodes[k].kernel}
        ready: frozenset[str] = frozenset()
        while pending:  # a pass per level of kernels that read kernels
            below = {k: self._closure(self._nodes[k].deps, ready) for k in pending}
            now = [k for k in self._nodes if k in pending and not below[k] & pending]
            staged = self._compute(df, set().union(*[below[k] for k in now]), ready)
            df = kernels.run(staged, [self._nodes[k].kernel for k in now], self.keys, self.order, df.columns)
            ready |= set(now)
            pending -= set(now)
        df = self._compute(df, self._closure(roots, ready), ready)
        return df.selectExpr(*[f"`{c}`" for c in keep], *[f"CAST({x.sql} AS DOUBLE) AS `{n}`" for n, x in outputs.items()])


def lookback(outputs: dict[str, Series]) -> int:
    """Rows of earlier context the outputs need: the halo of the chunk layout."""
    return max((s.lookback for s in outputs.values()), default=0)
