"""String similarity as Column expressions (STR-12)."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from lavra.session import ship_package


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence: one bit per character of ``a``, one addition per character of ``b``."""
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    every = (1 << len(a)) - 1
    row = every
    for c in b:
        if met := row & where.get(c, 0):
            row = (row + met | row - met) & every
    return len(a) - row.bit_count()


def lcs_length(a: Column, b: Column) -> Column:
    """``lcs`` of two columns, in Arrow batches; null where either is null."""
    ship_package()

    def lengths(left: pa.Array, right: pa.Array) -> pa.Array:
        return pa.array([None if x is None or y is None else lcs(x, y) for x, y in zip(left.to_pylist(), right.to_pylist())], pa.int32())

    return F.arrow_udf(lengths, "int")(a, b)


def indel_ratio(a: Column, b: Column) -> Column:
    """Normalised insert-and-delete similarity in per cent; two empty texts are alike, null gives null."""
    total = F.length(a) + F.length(b)
    return F.when(total == 0, 100.0).otherwise(lcs_length(a, b) * 200.0 / total)
