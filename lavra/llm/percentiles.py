"""Problem 5: percentiles of very large columns, from value counts that combine.

Values are reduced to counts per group and value; the counts of days or partitions add up (``merge_counts``). The
percentiles come from cumulative frequencies: the values of a group are cut into ordered ranges, running sums within a
range get the offset of the ranges before it, and the first value that reaches a target rank is picked. They
are exact (linear between neighbours), so the error bound is zero. The counting itself is ``lavra.functions.stats``, where
the market operators use it too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lavra.functions.stats import group_value_counts, merge_counts, percentiles_from_counts

__all__ = ["group_value_counts", "latest_versions", "merge_counts", "off_by", "percentiles_from_counts"]


def latest_versions(df: DataFrame, keys: list[str], version: str, columns: list[str]) -> DataFrame:
    """The row of latest ``version`` per key, reduced to ``columns``. A null version is the oldest; of rows with
    one version the greatest in the order of ``columns`` counts."""
    newest = F.max(F.struct(F.col(version).alias("_version"), *[F.col(c) for c in columns if c not in keys]))
    return df.groupBy(*keys).agg(newest.alias("_row")).select(*[F.col(c) if c in keys else F.col(f"_row.{c}") for c in dict.fromkeys([*keys, *columns])])


def off_by(published: DataFrame, exact: DataFrame, keys: list[str], pairs: dict[str, tuple[str, float]], tolerance: float) -> DataFrame:
    """``keys, column_name`` of each published value that is off by more than ``tolerance`` of the percentile.

    ``pairs`` maps the published column to the counted column and its fraction. Null published values and
    groups without values are no finding.
    """
    cells = [
        F.struct(F.lit(p).alias("column_name"), F.lit(c).alias("source"), F.lit(float(q)).alias("fraction"), F.col(p).cast("double").alias("given"))
        for p, (c, q) in pairs.items()
    ]
    long = published.select(*keys, F.inline(F.array(*cells)))
    known = exact.select(*keys, F.col("column_name").alias("source"), "fraction", "percentile")
    both = long.join(known, [*keys, "source", "fraction"])
    return both.where(F.abs(F.col("given") - F.col("percentile")) > tolerance * F.abs("percentile")).select(*keys, "column_name")
