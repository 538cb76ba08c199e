"""Arithmetic and vector expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def leading_digit(n: Column) -> Column:
    """struct(lead, rest): 213 -> 2, 13; 0 -> 0, 0."""
    scale = F.pow(F.lit(10), F.floor(F.log10(F.greatest(n, F.lit(1)).cast("double")))).cast("long")
    return F.struct(F.floor(n / scale).cast("long").alias("lead"), (n % scale).alias("rest"))


def clip(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.least(x, F.lit(high)), F.lit(low))


def stored_score(pred: Column) -> Column:
    """Prediction on 0-10 as the app stores it, on 0-1."""
    return clip(pred - 2, 0.0, 10.0) / 8


def shown_score(stored: Column) -> Column:
    return F.bround(clip(stored * 8 + 2, 0.0, 10.0), 1)


def hex_rgb(code: Column) -> Column:
    """#rrggbb -> three numbers."""
    return F.array(*[F.conv(F.substring(code, at, 2), 16, 10).cast("long") for at in (2, 4, 6)])


def rating_rgb(p: Column) -> Column:
    """Red at 0 to green at 1."""
    return F.array((255 * (1 - p)).cast("long"), (255 * p).cast("long"), F.lit(0).cast("long"))


def zoom(extent: Column) -> Column:
    """Level at which a cluster of this extent fills the view; 16 for a single point."""
    return F.when(extent == 0, F.lit(16.0)).otherwise(clip(F.log2(350 / F.nullif(extent, F.lit(0.0))), 0.0, 5.0))


def point_size(n: Column, few: float = 150.0, many: float = 600.0, small: float = 2.5, large: float = 4.5) -> Column:
    """Size of a point, from large where there are few points to small where there are many."""
    return clip(F.lit(large) - (n - few) * (large - small) / (many - few), small, large)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine_distance(a: Column, b: Column) -> Column:
    return 1 - F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2.0))), F.lit(0.0), lambda s, x: s + x))
