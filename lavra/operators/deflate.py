"""Price deflation with a chained monthly index (WIN-05, DT-03, PRJ-12, JN-07, NUM-09, AGG-18)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lavra.contracts import ContractError, require_columns
from lavra.functions.dates import period_of
from lavra.functions.stats import with_percentiles


#: More rows than this are no monthly index.
MOST_MONTHS = 12_000


def chained_index(monthly: DataFrame, period: str = "period", pct: str = "pct") -> DataFrame:
    """``period, pct, level``: the running product of ``1 + pct/100`` in period order. One row per month, so one
    task is enough."""
    w = Window.orderBy(period).rowsBetween(Window.unboundedPreceding, 0)
    return monthly.select(F.col(period).alias("period"), F.col(pct).cast("double").alias("pct"), F.exp(F.sum(F.log1p(F.col(pct).cast("double") / 100)).over(w)).alias("level"))


def resolve_reference(index: DataFrame, reference: str = "latest") -> DataFrame:
    """One row ``ref_period, ref_level``; ``latest`` or a ``yyyy-MM`` that the index must hold."""
    if reference == "latest":
        return index.agg(F.max("period").alias("ref_period"), F.max_by("level", "period").alias("ref_level"))
    if not index.where(F.col("period") == reference).limit(1).count():
        raise ContractError(f"reference period {reference} is not in the index")
    return index.where(F.col("period") == reference).agg(F.max("period").alias("ref_period"), F.max("level").alias("ref_level"))


def pick_date(df: DataFrame, primary: str, fallback: str, name: str = "data_deflacao") -> DataFrame:
    """PRJ-12: the first date that is known, where it came from, and flags."""
    origin = F.when(F.col(primary).isNotNull(), primary).when(F.col(fallback).isNotNull(), fallback).otherwise("missing")
    return df.withColumns({
        name: F.coalesce(primary, fallback), f"{name}_origem": origin,
        f"flag_{name}_fallback": F.col(primary).isNull() & F.col(fallback).isNotNull(), f"flag_{name}_ausente": F.col(primary).isNull() & F.col(fallback).isNull(),
    })


def deflate(df: DataFrame, index: DataFrame, date: str, amounts: list[str], reference: str = "latest") -> DataFrame:
    """NUM-09: adds ``<amount>_real``, the factor and flags. Rows of months without index keep null real values."""
    require_columns(df, [date, *amounts])
    ref = resolve_reference(index, reference)
    ends = index.agg(F.min("period").alias("_first"), F.max("period").alias("_last"))
    months = index.select(F.col("period").alias("_p"), F.col("level").alias("_level"))
    # An index has one row per month: checked, so it and the one-row tables may go to every task.
    if index.limit(MOST_MONTHS + 1).count() > MOST_MONTHS:
        raise ContractError(f"price index: more than {MOST_MONTHS} rows")
    joined = df.withColumn("period", period_of(F.col(date))).join(F.broadcast(months), F.col("period") == F.col("_p"), "left")
    joined = joined.crossJoin(F.broadcast(ref)).crossJoin(F.broadcast(ends))
    joined = joined.withColumn("deflation_factor", F.col("ref_level") / F.col("_level"))
    return joined.withColumns(
        {f"{a}_real": F.col(a) * F.col("deflation_factor") for a in amounts}
        | {
            "flag_ipca_disponivel": F.col("_level").isNotNull(),
            "flag_antes_cobertura": F.coalesce(F.col("period") < F.col("_first"), F.lit(False)),
            "flag_depois_cobertura": F.coalesce(F.col("period") > F.col("_last"), F.lit(False)),
        }
    ).drop("_p", "_level", "_first", "_last", "ref_level")


def deflation_summary(df: DataFrame, year: str, amount: str) -> DataFrame:
    """AGG-18: matched rows and medians per year."""
    rows = df.groupBy(year).agg(
        F.count(F.lit(1)).alias("transactions"),
        F.count_if("flag_ipca_disponivel").alias("matched"),
        F.round(F.avg(F.col("flag_ipca_disponivel").cast("double")) * 100, 3).alias("pct_matched"),
    )
    medians = {"median_nominal": amount, "median_real": f"{amount}_real", "median_factor": "deflation_factor"}
    return with_percentiles(rows, df, [year], {name: (F.col(c), 0.5) for name, c in medians.items()})


def stage_summary(df: DataFrame, year: str = "source_year", date: str = "data_correcao", base: str = "base_de_calculo", value_m2: str = "valor_m2_base", sample: str = "flag_amostra_mercado") -> DataFrame:
    """AGG-18: eleven measures per year of transactions that ``pick_date`` and ``deflate`` have been over, and the share of
    rows whose month the index has."""
    given = {
        "market_sample_transactions": F.count_if(sample), "correction_date_available": F.count_if(~F.col(f"flag_{date}_ausente")), "correction_date_fallback": F.count_if(f"flag_{date}_fallback"),
        "ipca_matched": F.count_if("flag_ipca_disponivel"), "base_real_calculated": F.count(f"{base}_real"), "value_m2_real_calculated": F.count(f"{value_m2}_real"),
    }
    rows = df.groupBy(year).agg(F.count(F.lit(1)).alias("transactions"), *[v.alias(n) for n, v in given.items()])
    rows = rows.withColumn("pct_ipca_matched", F.round(F.col("ipca_matched") * 100.0 / F.col("transactions"), 3))
    medians = {"median_base_nominal": base, "median_base_real": f"{base}_real", "median_value_m2_nominal": value_m2, "median_value_m2_real": f"{value_m2}_real"}
    return with_percentiles(rows, df, [year], {n: (F.col(c), 0.5) for n, c in medians.items()})
