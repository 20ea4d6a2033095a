"""Small scalar helpers with the reference's names for things."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def minus_date(date: Column, days: int) -> Column:
    """``YYYY-MM-DD`` text, the given number of days earlier."""
    return F.date_format(F.date_sub(F.to_date(date, "yyyy-MM-dd"), days), "yyyy-MM-dd")


def plus_date(date: Column, days: int) -> Column:
    return F.date_format(F.date_add(F.to_date(date, "yyyy-MM-dd"), days), "yyyy-MM-dd")


def training_table(df, labels=("amplitude", "custom_std"), drop=("timestamp", "close_time"), scale: float = 1000.0):
    """Nulls to 0, helper columns dropped, labels times 1000."""
    out = df.drop(*drop).na.fill(0)
    return out.withColumns({c: F.col(c) * scale for c in labels if c in out.columns})
