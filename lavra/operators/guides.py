"""Multi-row filings: rows of a file grouped behind their marker row, and one transaction per group
(WIN-01, WIN-02, WIN-04, AGG-02 .. AGG-04, PRJ-03, JN-05); ``units`` applies them to whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lavra.functions.text import ordered_distinct_join, stable_hash


def infer_groups(df: DataFrame, scope: list[str], order: list[str], marker: str) -> DataFrame:
    """WIN-01, WIN-02: adds ``guide_seq, flag_group_orphan, guide_rows, guide_base``.

    Within a scope (a file), in order, a row whose marker is not null begins group 1, 2, ...; rows without it
    follow. Rows before the first marker are orphans, groups -1, -2, ... of their own. A scope is one sorted
    stream by nature; all windows share its one exchange.
    """
    rows = Window.partitionBy(*scope).orderBy(*order)
    k = F.sum(F.col(marker).isNotNull().cast("int")).over(rows.rowsBetween(Window.unboundedPreceding, 0))
    df = df.withColumns({"_k": k, "_i": F.row_number().over(rows)})
    df = df.withColumn("guide_seq", F.when(F.col("_k") == 0, -F.col("_i")).otherwise(F.col("_k")).cast("long")).withColumn("flag_group_orphan", F.col("_k") == 0)
    group = Window.partitionBy(*scope, "guide_seq")
    return df.withColumns({"guide_rows": F.count(F.lit(1)).over(group), "guide_base": F.max(marker).over(group)}).drop("_k", "_i")


def reference_area(private: str, total: str, land: str) -> Column:
    """PRJ-03: the first area above zero; the land area, whatever it is, as the last resort."""
    good = lambda c: F.coalesce((F.col(c) > 0) & ~F.isnan(c), F.lit(False))
    return F.when(good(private), F.col(private)).when(good(total), F.col(total)).otherwise(F.col(land))


def content_duplicates(df: DataFrame, columns: list[str], scope: list[str] = []) -> DataFrame:
    """WIN-04, STR-10: adds ``record_content_id`` and ``flag_duplicado_exato`` (all rows of a content that
    occurs more than once in its scope). Counted by aggregation and joined back, so that a content held by very
    many rows is pre-aggregated; the join may split it."""
    hashed = df.withColumn("record_content_id", stable_hash([F.col(c) for c in columns], "unit_"))
    repeated = hashed.groupBy(*scope, "record_content_id").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n").withColumn("_dup", F.lit(True))
    return hashed.join(repeated, [*scope, "record_content_id"], "left").withColumn("flag_duplicado_exato", F.coalesce("_dup", F.lit(False))).drop("_dup")


def first_known(value: str, order: str) -> Column:
    """AGG-03: the first non-null value in row order."""
    return F.min_by(value, F.when(F.col(value).isNotNull(), F.col(order)))


def build_transactions(units: DataFrame, keys: list[str], order: str, texts: list[str] = [], firsts: list[str] = [], more: dict[str, Column] = {}) -> DataFrame:
    """AGG-01, AGG-02: one row per group with first known values, joined distinct texts, area sums and the area
    decision: all private areas if each unit has one, else the total or land area of a single unit. ``more`` adds
    aggregates by name."""
    pos = lambda c: F.when((F.col(c) > 0) & ~F.isnan(c), F.col(c))
    private, total, land = "area_constr_privativa", "area_constr_total", "area_total_terreno"
    rows = units.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_units"),
        F.min(order).alias("source_row_start"),
        F.max(order).alias("source_row_end"),
        *[first_known(c, order).alias(c) for c in firsts],
        *[ordered_distinct_join(F.col(c), F.col(order)).alias(c) for c in texts],
        F.sum(pos(private)).alias("area_constr_privativa_soma_m2"),
        F.count(pos(private)).alias("area_constr_privativa_n_validas"),
        F.max(pos(total)).alias("area_constr_total_max_m2"),
        F.max(pos(land)).alias("area_total_terreno_max_m2"),
        *[v.alias(name) for name, v in more.items()],
    )
    one = F.col("n_units") == 1
    cases = [
        (F.col("area_constr_privativa_n_validas") == F.col("n_units"), "area_constr_privativa_soma_m2", "sum_area_constr_privativa"),
        (one & F.col("area_constr_total_max_m2").isNotNull(), "area_constr_total_max_m2", "area_constr_total_single_unit"),
        (one & F.col("area_total_terreno_max_m2").isNotNull(), "area_total_terreno_max_m2", "area_total_terreno_single_unit"),
    ]
    area = F.coalesce(*[F.when(c, F.col(v)) for c, v, _ in cases])
    method = F.coalesce(*[F.when(c, F.lit(m)) for c, _, m in cases], F.lit("indeterminada_multiunit"))
    rows = rows.withColumns({"area_referencia_m2": area, "area_referencia_metodo": method, "flag_multiunit": F.col("n_units") > 1})
    if "base_de_calculo" in firsts:
        price = F.when((F.col("base_de_calculo") > 0) & ~F.isnan("base_de_calculo"), F.try_divide(F.col("base_de_calculo"), F.col("area_referencia_m2")))
        rows = rows.withColumn("valor_m2_base", price)
    return rows


def outer_summary(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """JN-05: full outer join of two summaries; null keys meet null keys."""
    from lavra.operators.quality import null_safe_join

    return null_safe_join(a, b, keys, "full")
