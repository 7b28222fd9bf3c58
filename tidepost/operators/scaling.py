"""Min-max scaling with fitted bounds."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Bounds = Mapping[str, tuple[float, float]]


def fit_minmax(df: DataFrame, columns: Sequence[str]) -> Bounds:
    """Smallest and largest value per column (one row comes back)."""
    row = df.agg(*[f(F.col(c).cast("double")).alias(f"{f.__name__}_{i}")
                   for i, c in enumerate(columns) for f in (F.min, F.max)]).first()
    return {c: (row[f"min_{i}"], row[f"max_{i}"]) for i, c in enumerate(columns)}


def scaled(column: Column, low: float | None, high: float | None) -> Column:
    """0 for a constant column; values outside the fitted range are not clipped."""
    if low is None or high is None or high == low:
        return F.lit(0.0)
    return (column.cast("double") - F.lit(low)) / F.lit(high - low)


def apply_minmax(df: DataFrame, bounds: Bounds, suffix: str = "") -> DataFrame:
    return df.withColumns({c + suffix: scaled(F.col(c), low, high)
                           for c, (low, high) in bounds.items()})
