"""Column, key and parameter contracts checked at stage boundaries (AGG-26, PRJ-22, SET-04)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class ContractError(ValueError):
    """A table or a parameter breaks its contract."""


def missing_columns(df: DataFrame, required: Iterable[str]) -> list[str]:
    """Required names absent from ``df`` (SET-04), in sorted order."""
    return sorted(set(required) - set(df.columns))


def require_columns(df: DataFrame, required: Iterable[str], what: str = "table") -> DataFrame:
    """``df`` itself; raises when a required column is absent."""
    if gone := missing_columns(df, required):
        raise ContractError(f"{what}: missing columns {', '.join(gone)}")
    return df


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys held by more than one row with their row count ``n_rows``; null keys count as equal (AGG-26)."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).where("n_rows > 1")


def require_unique(df: DataFrame, keys: list[str], what: str = "table") -> DataFrame:
    """``df`` itself; raises when a key repeats. Runs one aggregation that stops at the first repeat."""
    if duplicate_keys(df, keys).limit(1).count():
        raise ContractError(f"{what}: key {', '.join(keys)} repeats")
    return df


def require_range(name: str, value: float, low: float | None = None, high: float | None = None, open_ends: bool = False) -> float:
    """``value`` itself; raises when it lies outside ``[low, high]`` or, with ``open_ends``, ``(low, high)``."""
    bad_low = low is not None and (value <= low if open_ends else value < low)
    bad_high = high is not None and (value >= high if open_ends else value > high)
    if bad_low or bad_high:
        raise ContractError(f"{name}={value} is outside {low}..{high}")
    return value
