"""Market indicators by any keys, coverage, growth, year-to-date comparison and territorial shares
(AGG-20, AGG-21, WIN-06, WIN-07, IND-01 .. IND-04)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lavra.contracts import require_columns
from lavra.functions.stats import with_percentiles


@dataclass(frozen=True)
class MarketColumns:
    """Names of the measured columns of a table of transactions."""

    date: str = "data_pagamento"
    fallback_year: str | None = "source_year"
    units: str = "n_units"
    base: str = "base_de_calculo_real"
    value_m2: str = "valor_m2_base_real"
    area: str = "area_referencia_m2"
    multiunit: str = "flag_multiunit_qc"
    sector: str = "sector_final_code"


MARKET = MarketColumns()


def flagged(flag: str) -> Column:
    """A nullable flag as a filter; null is false (PRJ-17)."""
    return F.coalesce(F.col(flag), F.lit(False))


def with_period(df: DataFrame, m: MarketColumns = MARKET) -> DataFrame:
    """Adds ``ano_analise`` and ``mes_analise``; without a date the year falls back and the month is null (PRJ-15)."""
    year = F.year(m.date)
    if m.fallback_year and m.fallback_year in df.columns:
        year = F.coalesce(year, F.col(m.fallback_year).cast("int"))
    return df.withColumns({"ano_analise": year, "mes_analise": F.month(m.date)})


def geographic_label(df: DataFrame, first: str, second: str, label: str = "bairro_analise") -> DataFrame:
    """Adds the first label that is known and where it came from: ``malha_pmpa``, ``censo`` or ``missing`` (PRJ-16)."""
    origin = F.when(F.col(first).isNotNull(), "malha_pmpa").when(F.col(second).isNotNull(), "censo").otherwise("missing")
    return df.withColumns({label: F.coalesce(first, second), f"{label}_origem": origin})


def market_metrics(df: DataFrame, keys: list[str], m: MarketColumns = MARKET) -> DataFrame:
    """The core cube: 16 metrics per group, and ``n_setores`` where the sector column exists.

    Null keys form groups. Quantiles are exact (linear between neighbours) and come from value counts, so that no task
    holds all values of a group.
    """
    require_columns(df, [*keys, m.base, m.value_m2, m.area], "transactions")
    units = F.coalesce(F.col(m.units).cast("long"), F.lit(1)) if m.units in df.columns else F.lit(1)
    multi = F.coalesce(F.col(m.multiunit), F.lit(False)) if m.multiunit in df.columns else F.lit(False)
    number = {k: F.col(c).cast("double") for k, c in (("b", m.base), ("v", m.value_m2), ("a", m.area))}
    grouped = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_transacoes"),
        F.sum(units).cast("long").alias("n_unidades"),
        F.sum(number["b"]).alias("base_total_real"),
        F.avg(number["b"]).alias("base_media_real"),
        F.avg(number["v"]).alias("valor_m2_medio_real"),
        F.avg(number["a"]).alias("area_media_m2"),
        (F.avg(multi.cast("double")) * 100).alias("pct_multiunit"),
        *([F.count_distinct(m.sector).alias("n_setores")] if m.sector in df.columns and m.sector not in keys else []),
    )
    names = {"b": ("base_p25_real", "base_mediana_real", "base_p75_real"), "v": ("valor_m2_p25_real", "valor_m2_mediano_real", "valor_m2_p75_real"), "a": ("area_p25_m2", "area_mediana_m2", "area_p75_m2")}
    return with_percentiles(grouped, df, keys, {name: (number[k], q) for k, of in names.items() for name, q in zip(of, (0.25, 0.5, 0.75))})


def year_coverage(df: DataFrame, as_of_year: int, area: list[str] = []) -> DataFrame:
    """Months seen per year (AGG-21). A year is incomplete with fewer than 12 months or if it is ``as_of_year``."""
    seen = df.where(F.col("ano_analise").isNotNull() & F.col("mes_analise").isNotNull())
    months = seen.groupBy(*area, "ano_analise").agg(
        F.count_distinct("mes_analise").alias("meses_observados"),
        F.min("mes_analise").alias("primeiro_mes_observado"),
        F.max("mes_analise").alias("ultimo_mes_observado"),
    )
    current = F.col("ano_analise") == as_of_year
    return months.withColumns({"flag_ano_corrente": current, "flag_ano_incompleto": (F.col("meses_observados") < 12) | current})


def change_pct(value: str, window) -> Column:
    """Change against the row before, in per cent; null without one or after zero."""
    before = F.lag(F.col(value).cast("double")).over(window)
    return (F.try_divide(F.col(value).cast("double"), before) - 1) * 100


GROWTH = {
    "n_transacoes": "variacao_transacoes_pct",
    "base_mediana_real": "variacao_base_mediana_real_pct",
    "valor_m2_mediano_real": "variacao_valor_m2_mediano_real_pct",
    "area_mediana_m2": "variacao_area_mediana_pct",
}
YTD_GROWTH = {
    "n_transacoes": "variacao_transacoes_ytd_pct",
    "valor_m2_mediano_real": "variacao_valor_m2_mediano_ytd_pct",
    "base_mediana_real": "variacao_base_mediana_ytd_pct",
}


def with_growth(yearly: DataFrame, coverage: DataFrame, area: list[str] = []) -> DataFrame:
    """Joins the coverage and adds yearly growth (WIN-06): against the row before, and only where that row's
    year and the row's own are complete. Windows run over one row per year, not over transactions."""
    both = yearly.join(coverage, [*area, "ano_analise"], "left")
    w = Window.partitionBy(*area).orderBy("ano_analise")
    whole = ~F.coalesce("flag_ano_incompleto", F.lit(True)) & ~F.coalesce(F.lag("flag_ano_incompleto").over(w), F.lit(True))
    return both.withColumns({target: F.when(whole, change_pct(source, w)) for source, target in GROWTH.items()})


def city_year(sample: DataFrame, as_of_year: int, area: list[str] = []) -> DataFrame:
    """IND-01."""
    return with_growth(market_metrics(sample, [*area, "ano_analise"]), year_coverage(sample, as_of_year, area), area)


def city_month(sample: DataFrame, area: list[str] = []) -> DataFrame:
    """IND-02: by month, with the label ``yyyy-MM``."""
    seen = sample.where(F.col("ano_analise").isNotNull() & F.col("mes_analise").isNotNull())
    monthly = market_metrics(seen, [*area, "ano_analise", "mes_analise"])
    return monthly.withColumn("periodo", F.format_string("%d-%02d", "ano_analise", "mes_analise"))


def ytd_comparable(sample: DataFrame, as_of_year: int, area: list[str] = []) -> DataFrame:
    """IND-03: all years up to the last month of the latest year; years that end before it are left out."""
    coverage = year_coverage(sample, as_of_year, area)
    last = coverage.groupBy(*area).agg(F.max_by("ultimo_mes_observado", "ano_analise").alias("mes_limite_comparavel"))
    years = (coverage.join(last, area) if area else coverage.crossJoin(F.broadcast(last))).where("ultimo_mes_observado >= mes_limite_comparavel")
    years = years.select(*area, "ano_analise", "mes_limite_comparavel")
    part = sample.join(years, [*area, "ano_analise"]).where(F.col("mes_analise").between(1, F.col("mes_limite_comparavel")))
    result = market_metrics(part, [*area, "ano_analise", "mes_limite_comparavel"])
    w = Window.partitionBy(*area).orderBy("ano_analise")
    label = F.format_string("jan-%02d", "mes_limite_comparavel")
    return result.withColumns({"periodo_comparavel": label} | {target: change_pct(source, w) for source, target in YTD_GROWTH.items()})


def territorial_year(sample: DataFrame, city: DataFrame, coverage: DataFrame, territory: str, area: list[str] = []) -> DataFrame:
    """IND-04: by year and territory, with shares of the city's totals and the year's coverage."""
    rows = market_metrics(sample.where(F.col(territory).isNotNull() & F.col("ano_analise").isNotNull()), [*area, "ano_analise", territory])
    totals = city.select(*area, "ano_analise", F.col("n_transacoes").alias("_n"), F.col("base_total_real").alias("_b"))
    rows = rows.join(totals, [*area, "ano_analise"], "left").withColumns({
        "participacao_transacoes_cidade_pct": F.try_divide(F.col("n_transacoes") * 100.0, F.col("_n").cast("double")),
        "participacao_base_cidade_pct": F.try_divide(F.col("base_total_real") * 100.0, F.col("_b")),
    }).drop("_n", "_b")
    kept = coverage.select(*area, "ano_analise", "meses_observados", "ultimo_mes_observado", "flag_ano_incompleto")
    return rows.join(kept, [*area, "ano_analise"], "left")


def top_territories(rows: DataFrame, metric: str, k: int, least: int = 50, by: list[str] = ["ano_analise"], name: str = "sector_final_code") -> DataFrame:
    """SRT-03: the ``k`` territories of greatest metric per group among those with enough transactions."""
    w = Window.partitionBy(*by).orderBy(F.col(metric).desc_nulls_last(), name)
    return rows.where(F.col("n_transacoes") >= least).withColumn("posicao", F.row_number().over(w)).where(F.col("posicao") <= k)


def common_scale(rows: DataFrame, metric: str, low: float = 0.02, high: float = 0.98) -> DataFrame:
    """AGG-24: ``scale_min, scale_max`` across all years: the outer percentiles, or the extremes where those
    coincide."""
    v = F.col(metric).cast("double")
    s = with_percentiles(rows.agg(F.min(v).alias("lo"), F.max(v).alias("hi")), rows, [], {"ql": (v, low), "qh": (v, high)})
    apart = F.col("ql") < F.col("qh")
    return s.select(F.when(apart, F.col("ql")).otherwise(F.col("lo")).alias("scale_min"), F.when(apart, F.col("qh")).otherwise(F.col("hi")).alias("scale_max"))


def common_volume_scale(rows: DataFrame, count: str = "n_transacoes", high: float = 0.98) -> DataFrame:
    """AGG-24: ``scale_min, scale_max`` of counts across all years: from 0 to the upper percentile, 1 at least."""
    s = with_percentiles(rows.agg(F.count(F.lit(1)).alias("_n")), rows, [], {"_q": (F.col(count).cast("double"), high)})
    return s.select(F.lit(0.0).alias("scale_min"), F.greatest(F.lit(1.0), F.coalesce("_q", F.lit(1.0))).alias("scale_max"))


def masked(rows: DataFrame, metric: str, least: int, count: str = "n_transacoes") -> DataFrame:
    """PRJ-21: the metric null where the count is below ``least``; a null count keeps it."""
    return rows.withColumn(metric, F.when(~F.coalesce(F.col(count) < least, F.lit(False)), F.col(metric)))


def latest_complete_year(coverage: DataFrame, area: list[str] = []) -> DataFrame:
    """STA-09: ``area, ano_analise, flag_ano_incompleto``: the last year that is complete, else the last one."""
    best = F.max(F.struct(~F.coalesce("flag_ano_incompleto", F.lit(False)), F.col("ano_analise")))
    found = coverage.where("ano_analise is not null").groupBy(*area).agg(best.alias("_b")) if area else coverage.where("ano_analise is not null").agg(best.alias("_b"))
    return found.where("_b is not null").select(*area, F.col("_b.ano_analise").alias("ano_analise"), (~F.col("_b.col1")).alias("flag_ano_incompleto"))


def on_mesh(mesh: DataFrame, payload: DataFrame, keys: list[str], years: DataFrame) -> DataFrame:
    """JN-11, RPT-02: every region of the mesh in every year, with the payload's row where there is one. ``years`` is one
    column ``ano_analise``: a calendar's few rows."""
    every = mesh.crossJoin(F.broadcast(years.agg(F.sort_array(F.collect_set("ano_analise")).alias("_years")))).withColumn("ano_analise", F.explode("_years")).drop("_years")
    return every.join(payload, [*keys, "ano_analise"], "left")


def in_order(rows: DataFrame, by: list[str], descending: list[str] = []) -> DataFrame:
    """SRT-01: the order of published tables: ``by`` rising, nulls last, then ``descending`` falling."""
    return rows.orderBy(*[F.col(c).asc_nulls_last() for c in by], *[F.col(c).desc_nulls_last() for c in descending])


LABELS = {True: "sim", False: "nao"}
QUADRANTS = {1: "HH", 2: "LH", 3: "LL", 4: "HL"}


def labelled(value: Column, labels: dict, missing: str | None = None) -> Column:
    """COND-02: the label of a value; ``missing`` for null and for values without label."""
    return F.coalesce(*[F.when(value == k, F.lit(v)) for k, v in labels.items()], F.lit(missing))


def chart_tables(yearly: DataFrame, monthly: DataFrame, ytd: DataFrame, territories: DataFrame, area: list[str] = [], k: int = 15, least: int = 50, name: str = "sector_final_code") -> dict[str, DataFrame]:
    """RPT-01: the small tables behind the charts, in the order in which they are drawn: transactions and price by year,
    by month, up to the comparable month, and the top territories."""
    by = [*area, "ano_analise"]
    return {
        "transactions_by_year": in_order(yearly.select(*by, "n_transacoes", "flag_ano_incompleto"), by), "value_m2_by_year": in_order(yearly.select(*by, "valor_m2_mediano_real", "flag_ano_incompleto"), by),
        "monthly": in_order(monthly.select(*by, "mes_analise", "periodo", "n_transacoes", "valor_m2_mediano_real"), [*by, "mes_analise"]),
        "ytd": in_order(ytd.select(*by, "periodo_comparavel", "n_transacoes", "variacao_transacoes_ytd_pct"), by),
        "top": in_order(top_territories(territories, "valor_m2_mediano_real", k, least, by, name).select(*by, name, "posicao", "n_transacoes", "valor_m2_mediano_real"), [*by, "posicao"]),
    }
