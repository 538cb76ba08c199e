"""Small operators that the others share."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Added before rounding, so that values on a tie go the same way whatever the order of a sum.
NUDGE = 2.3e-10


def r6(x, digits: int = 6) -> Column:
    """Rounded, ties upward, with negative zero as zero."""
    x = F.col(x) if isinstance(x, str) else x
    return F.round(x + F.lit(NUDGE), digits) + F.lit(0.0)


def top(df: DataFrame, by: list, n: int) -> DataFrame:
    return df.orderBy(*by).limit(n)


def ranked(df: DataFrame, group, order: list, n: int | None = None, name: str = "rank") -> DataFrame:
    """Rows with their rank in the group from 1; the first n where n is given."""
    out = df.withColumn(name, F.row_number().over(Window.partitionBy(*([group] if isinstance(group, str) else group)).orderBy(*order)).cast("long"))
    return out.where(F.col(name) <= n) if n is not None else out


def share(df: DataFrame, value: str, group, name: str = "share") -> DataFrame:
    """Value over the sum of its group."""
    return df.withColumn(name, F.col(value) / F.sum(value).over(Window.partitionBy(*([group] if isinstance(group, str) else group))))


def shuffled(a: str, b: str) -> Column:
    """Repeatable order of pairs of ids, the same in any engine."""
    return (F.col(a) * 7919 + F.col(b) * 104729) % 100003


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def natural_join(a: DataFrame, b: DataFrame) -> DataFrame:
    """Join on all shared columns."""
    return a.join(b, [c for c in a.columns if c in b.columns])
