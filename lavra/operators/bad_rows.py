"""Problem 6: records that fail to parse, apart from the valid ones, with the reason.

Each distinct value of a checked column is cast once; values that fail form a dictionary of invalid values
with reasons, which is joined back to the records next to the structural checks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lavra.functions.dates import is_strict_date
from lavra.functions.numbers import is_strict_number
from lavra.functions.text import UNIT_NULL_TOKENS, strip
from lavra.operators.layouts import UNITS, TargetSchema, resolved_headers
from lavra.operators.records import FileLayout, parse_records
from lavra.session import materialize

#: Checked columns in the order in which their reasons are reported, with the notation they need.
UNIT_CHECKS = {"base_de_calculo": "number", "data_pagamento": "date", "area_constr_privativa": "number"}

VALID = {"number": is_strict_number, "date": is_strict_date}
STRUCTURE = "_structure"


def _long(lines: DataFrame, files: DataFrame, checks: dict[str, str], schema: TargetSchema, layout: FileLayout) -> DataFrame:
    """``file_id, line_no, column_name, value``: a row with the structural reason, or a row per checked value
    that is no null token."""
    records = parse_records(lines, resolved_headers(lines, files, schema, layout), layout)
    reason = F.when(F.col("record.bad_quoting"), "quoting").when(F.col("record.n_fields") != F.size("columns"), "field_count")
    cells = [
        F.struct(F.lit(c).alias("column_name"), strip(F.try_element_at("record.fields", F.nullif(F.array_position("columns", c), F.lit(0)).cast("int"))).alias("value"))
        for c in checks
    ]
    given = F.filter(F.array(*cells), lambda s: s["value"].isNotNull() & ~F.lower(s["value"]).isin(*UNIT_NULL_TOKENS))
    structural = F.array(F.struct(F.lit(STRUCTURE).alias("column_name"), reason.alias("value")))
    return records.select("file_id", "line_no", F.inline(F.when(reason.isNotNull(), structural).otherwise(given)))


def _valid(checks: dict[str, str]) -> Column:
    known = F.lit(True)
    for c, kind in checks.items():
        known = F.when(F.col("column_name") == c, VALID[kind](F.col("value"))).otherwise(known)
    return known


def invalid_values(long: DataFrame, checks: dict[str, str]) -> DataFrame:
    """``column_name, value, reason``: the dictionary of distinct checked values that do not cast."""
    distinct = long.where(F.col("column_name") != STRUCTURE).select("column_name", "value").distinct()
    return distinct.where(~F.coalesce(_valid(checks), F.lit(False))).withColumn("reason", F.concat(F.lit("bad_"), "column_name"))


def parse_failures(
    lines: DataFrame, files: DataFrame, checks: dict[str, str] = UNIT_CHECKS, schema: TargetSchema = UNITS, layout: FileLayout = FileLayout()
) -> DataFrame:
    """``file_id, line_no, reason`` of each record (header apart) that fails, with its first reason in the order
    quoting, field_count, then the checked columns.

    A record that occurs twice under one ``file_id`` and ``line_no`` gives one row. A null or empty record has
    one empty field. Without a header only the quoting is checked. Empty tables give no rows.
    """
    # Read by the dictionary, by the join with it and by the structural checks: parsed once, written once.
    long = materialize(_long(lines, files, checks, schema, layout))
    bad = invalid_values(long, checks).select("column_name", "value")
    order = {"quoting": 0, "field_count": 1} | {c: i + 2 for i, c in enumerate(checks)}
    rank = lambda c: F.coalesce(*[F.when(F.col(c) == r, i) for r, i in order.items()])
    structural = long.where(F.col("column_name") == STRUCTURE).select("file_id", "line_no", rank("value").alias("_rank"))
    typed = long.where(F.col("column_name") != STRUCTURE).join(bad, ["column_name", "value"]).select("file_id", "line_no", rank("column_name").alias("_rank"))
    worst = structural.unionByName(typed).groupBy("file_id", "line_no").agg(F.min("_rank").alias("_rank"))
    named = F.coalesce(*[F.when(F.col("_rank") == i, F.lit(r if i < 2 else f"bad_{r}")) for r, i in order.items()])
    return worst.select("file_id", "line_no", named.alias("reason"))


def valid_records(lines: DataFrame, failures: DataFrame, layout: FileLayout = FileLayout()) -> DataFrame:
    """The data lines without a failure, as they came."""
    keys = failures.select(F.col("file_id").alias(layout.file_id), F.col("line_no").alias(layout.line_no))
    return lines.where(F.col(layout.line_no) > 1).join(keys, [layout.file_id, layout.line_no], "left_anti")
