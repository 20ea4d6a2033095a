"""Null, NaN and infinity rules shared by every operator.

Missing numbers are NULL inside the library. NaN and the infinities become NULL before any frame sees
them, division never raises, and the rules that turn missing into zero are applied where an operator
says so and nowhere else.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

INF = float("inf")


def finite(x: Column) -> Column:
    """NaN and both infinities to NULL (NaN sorts above infinity, so one comparison does)."""
    return F.when(F.abs(x) < F.lit(INF), x)


def zero_missing(x: Column) -> Column:
    """NULL, NaN and the infinities to 0."""
    return F.coalesce(finite(x), F.lit(0.0))


def div(a: Column, b: Column) -> Column:
    """Division with NULL for a zero divisor."""
    return F.try_divide(a, b)


def clip(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(float(low))), F.lit(float(high)))


def zero_missing_columns(df: DataFrame, exclude: tuple[str, ...] = ()) -> DataFrame:
    """``zero_missing`` over every float or double column in one projection."""
    out = []
    for field in df.schema.fields:
        c = F.col(f"`{field.name}`")
        if field.name not in exclude and isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            c = zero_missing(c).alias(field.name)
        out.append(c)
    return df.select(*out)


def log1p_label(x: Column) -> Column:
    """Label transform: log1p with the negative side clamped to zero."""
    return F.log1p(F.greatest(x, F.lit(0.0)))


def expm1_label(x: Column, cap: float) -> Column:
    """Inverse of the label transform, scaled by 1/10 and clipped to [0, cap]."""
    return clip(F.expm1(x) / F.lit(10.0), 0.0, cap)


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def floor_to(x: Column, decimals: int = 3) -> Column:
    """Round down to a fixed number of decimals (order quantities never round up)."""
    factor = F.lit(float(10**decimals))
    return F.floor(x * factor).cast("double") / factor
