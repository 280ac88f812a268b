"""Queries of the market, guide, geocoding and spatial operators over the test tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lavra.functions import numbers, similarity, text
from lavra.functions.dates import parse_date
from lavra.functions.stats import with_percentiles
from lavra.operators import census, deflate, guides, indicators, points, quality, resolve, spatialstats
from lavra.plans.registry import Registry, table
from lavra.streaming import monthly

MARKET = Registry()
AS_OF_YEAR = 2026
AREA = ["cod_municipio"]
SAMPLE_COLUMNS = [
    "source_year", "data_pagamento", "n_units", "base_de_calculo_real", "area_referencia_m2", "valor_m2_base_real", "sector_final_code",
    "flag_use_market_analysis", "flag_use_spatial_analysis",
]

LATEST = """latest AS (SELECT *, n_units > 1 AS flag_multiunit_qc, coalesce(year(data_pagamento), source_year) AS ano_analise, month(data_pagamento) AS mes_analise
  FROM transactions_qc QUALIFY row_number() OVER (PARTITION BY cod_municipio, transaction_id ORDER BY carga_em DESC NULLS LAST) = 1)"""
METRICS = """count(*) AS n_transacoes, CAST(sum(coalesce(n_units, 1)) AS BIGINT) AS n_unidades, round(sum(base_de_calculo_real), 2) AS base_total_real,
  CAST(CAST(avg(base_de_calculo_real) AS FLOAT) AS DOUBLE) AS base_media_real, round(median(base_de_calculo_real), 6) AS base_mediana_real,
  round(quantile_cont(base_de_calculo_real, 0.25), 6) AS base_p25_real, round(quantile_cont(base_de_calculo_real, 0.75), 6) AS base_p75_real,
  CAST(CAST(avg(valor_m2_base_real) AS FLOAT) AS DOUBLE) AS valor_m2_medio_real, round(median(valor_m2_base_real), 6) AS valor_m2_mediano_real,
  round(quantile_cont(valor_m2_base_real, 0.25), 6) AS valor_m2_p25_real, round(quantile_cont(valor_m2_base_real, 0.75), 6) AS valor_m2_p75_real,
  CAST(CAST(avg(area_referencia_m2) AS FLOAT) AS DOUBLE) AS area_media_m2, round(median(area_referencia_m2), 6) AS area_mediana_m2,
  round(quantile_cont(area_referencia_m2, 0.25), 6) AS area_p25_m2, round(quantile_cont(area_referencia_m2, 0.75), 6) AS area_p75_m2,
  round(100 * avg(CASE WHEN flag_multiunit_qc THEN 1.0 ELSE 0.0 END), 6) AS pct_multiunit"""
SECTORS = ", count(DISTINCT sector_final_code) AS n_setores"
COVERAGE = f"""coverage AS (SELECT cod_municipio, ano_analise, count(DISTINCT mes_analise) AS meses_observados, min(mes_analise) AS primeiro_mes_observado,
  max(mes_analise) AS ultimo_mes_observado, ano_analise = {AS_OF_YEAR} AS flag_ano_corrente,
  count(DISTINCT mes_analise) < 12 OR ano_analise = {AS_OF_YEAR} AS flag_ano_incompleto
  FROM latest WHERE flag_use_market_analysis AND ano_analise IS NOT NULL AND mes_analise IS NOT NULL GROUP BY cod_municipio, ano_analise)"""


def rounded(df, places: int = 6, but: dict[str, int] = {}):
    """Doubles rounded, so that sums in another order compare equal. Means, which may end on a rounding limit, are
    given with the precision of a float: its limits are no decimal fractions."""
    mean = lambda c: "_media_" in c or "_medio_" in c
    near = lambda c: F.col(c).cast("float").cast("double") if mean(c) else F.round(F.col(c), but.get(c, places))
    return df.select(*[near(c).alias(c) if k == "double" else F.col(c) for c, k in df.dtypes])


def latest(spark, sf_dir):
    """Transactions in their latest version, with period and the multi-unit flag."""
    rows = table(spark, sf_dir, "transactions_qc")
    newest = F.max(F.struct(F.col("carga_em"), *SAMPLE_COLUMNS)).alias("r")
    rows = rows.groupBy("cod_municipio", "transaction_id").agg(newest).select("cod_municipio", "transaction_id", *[f"r.{c}" for c in SAMPLE_COLUMNS])
    return indicators.with_period(rows.withColumn("flag_multiunit_qc", F.col("n_units") > 1))


def market(spark, sf_dir):
    return latest(spark, sf_dir).where(indicators.flagged("flag_use_market_analysis"))


MONEY = {"base_total_real": 2}


@MARKET.query(f"""WITH {LATEST}, {COVERAGE}, y AS (SELECT cod_municipio, ano_analise, {METRICS}{SECTORS} FROM latest WHERE flag_use_market_analysis GROUP BY ALL),
c AS (SELECT y.*, meses_observados, primeiro_mes_observado, ultimo_mes_observado, flag_ano_corrente, flag_ano_incompleto,
  NOT coalesce(flag_ano_incompleto, true) AND NOT coalesce(lag(flag_ano_incompleto) OVER w, true) AS whole,
  median_raw_base, median_raw_m2, median_raw_area, lag(n_transacoes) OVER w AS pn, lag(median_raw_base) OVER w AS pb, lag(median_raw_m2) OVER w AS pm, lag(median_raw_area) OVER w AS pa
  FROM y LEFT JOIN coverage USING (cod_municipio, ano_analise) LEFT JOIN (SELECT cod_municipio, ano_analise, median(base_de_calculo_real) AS median_raw_base, median(valor_m2_base_real) AS median_raw_m2,
    median(area_referencia_m2) AS median_raw_area FROM latest WHERE flag_use_market_analysis GROUP BY ALL) USING (cod_municipio, ano_analise)
  WINDOW w AS (PARTITION BY cod_municipio ORDER BY ano_analise))
SELECT c.* EXCLUDE (whole, median_raw_base, median_raw_m2, median_raw_area, pn, pb, pm, pa), round(CASE WHEN whole THEN 100 * (n_transacoes / nullif(pn, 0) - 1) END, 6) AS variacao_transacoes_pct,
  round(CASE WHEN whole THEN 100 * (median_raw_base / nullif(pb, 0) - 1) END, 6) AS variacao_base_mediana_real_pct,
  round(CASE WHEN whole THEN 100 * (median_raw_m2 / nullif(pm, 0) - 1) END, 6) AS variacao_valor_m2_mediano_real_pct,
  round(CASE WHEN whole THEN 100 * (median_raw_area / nullif(pa, 0) - 1) END, 6) AS variacao_area_mediana_pct FROM c""")
def city_year_indicators(spark, sf_dir):
    return rounded(indicators.city_year(market(spark, sf_dir), AS_OF_YEAR, AREA), but=MONEY)


@MARKET.query(f"""WITH {LATEST} SELECT cod_municipio, ano_analise, mes_analise, format('{{}}-{{:02d}}', ano_analise, mes_analise) AS periodo, {METRICS}{SECTORS}
FROM latest WHERE flag_use_market_analysis AND mes_analise IS NOT NULL GROUP BY ALL""")
def city_month_indicators(spark, sf_dir):
    return rounded(indicators.city_month(market(spark, sf_dir), AREA), but=MONEY)


@MARKET.query(f"""WITH {LATEST}, {COVERAGE}, lim AS (SELECT cod_municipio, arg_max(ultimo_mes_observado, ano_analise) AS mes_limite_comparavel FROM coverage GROUP BY ALL),
y AS (SELECT cod_municipio, ano_analise, mes_limite_comparavel, {METRICS}{SECTORS}, median(valor_m2_base_real) AS m2, median(base_de_calculo_real) AS mb
  FROM latest JOIN lim USING (cod_municipio) JOIN coverage USING (cod_municipio, ano_analise)
  WHERE flag_use_market_analysis AND mes_analise BETWEEN 1 AND mes_limite_comparavel AND ultimo_mes_observado >= mes_limite_comparavel GROUP BY ALL)
SELECT y.* EXCLUDE (m2, mb), format('jan-{{:02d}}', mes_limite_comparavel) AS periodo_comparavel,
  round(100 * (n_transacoes / nullif(lag(n_transacoes) OVER w, 0) - 1), 6) AS variacao_transacoes_ytd_pct, round(100 * (m2 / nullif(lag(m2) OVER w, 0) - 1), 6) AS variacao_valor_m2_mediano_ytd_pct,
  round(100 * (mb / nullif(lag(mb) OVER w, 0) - 1), 6) AS variacao_base_mediana_ytd_pct FROM y WINDOW w AS (PARTITION BY cod_municipio ORDER BY ano_analise)""")
def ytd_comparable(spark, sf_dir):
    return rounded(indicators.ytd_comparable(market(spark, sf_dir), AS_OF_YEAR, AREA), but=MONEY)


SECTOR_YEAR = f"""WITH {LATEST}, {COVERAGE}, city AS (SELECT cod_municipio, ano_analise, count(*) AS cn, sum(base_de_calculo_real) AS cb FROM latest WHERE flag_use_market_analysis GROUP BY ALL),
s AS (SELECT cod_municipio, ano_analise, sector_final_code, {METRICS}, sum(base_de_calculo_real) AS sb FROM latest WHERE flag_use_spatial_analysis AND sector_final_code IS NOT NULL AND ano_analise IS NOT NULL GROUP BY ALL),
sector_year AS (SELECT s.* EXCLUDE (sb), round(100.0 * n_transacoes / nullif(cn, 0), 6) AS participacao_transacoes_cidade_pct, round(100 * sb / nullif(cb, 0), 6) AS participacao_base_cidade_pct,
  meses_observados, ultimo_mes_observado, flag_ano_incompleto FROM s LEFT JOIN city USING (cod_municipio, ano_analise) LEFT JOIN coverage USING (cod_municipio, ano_analise))"""


@MARKET.query(SECTOR_YEAR + " SELECT * FROM sector_year")
def sector_year_indicators(spark, sf_dir):
    rows, city = latest(spark, sf_dir), market(spark, sf_dir)
    spatial = rows.where(indicators.flagged("flag_use_spatial_analysis"))
    totals = indicators.market_metrics(city, [*AREA, "ano_analise"])
    return rounded(indicators.territorial_year(spatial, totals, indicators.year_coverage(city, AS_OF_YEAR, AREA), "sector_final_code", AREA), but=MONEY)


@MARKET.query(SECTOR_YEAR + """ SELECT *, row_number() OVER (PARTITION BY cod_municipio, ano_analise ORDER BY valor_m2_mediano_real DESC NULLS LAST, sector_final_code) AS posicao
FROM sector_year WHERE n_transacoes >= 3 QUALIFY posicao <= 10""")
def top_sectors(spark, sf_dir):
    return indicators.top_territories(sector_year_indicators(spark, sf_dir), "valor_m2_mediano_real", 10, least=3, by=[*AREA, "ano_analise"])


@MARKET.query(SECTOR_YEAR + " SELECT quantile_cont(valor_m2_mediano_real, 0.02) AS scale_min, quantile_cont(valor_m2_mediano_real, 0.98) AS scale_max FROM sector_year")
def map_scales(spark, sf_dir):
    return rounded(indicators.common_scale(sector_year_indicators(spark, sf_dir), "valor_m2_mediano_real"), 6)


@MARKET.query(f"WITH {LATEST}, {COVERAGE} SELECT * FROM coverage")
def year_coverage(spark, sf_dir):
    return indicators.year_coverage(market(spark, sf_dir), AS_OF_YEAR, AREA)


UNIT_FLAGS = """SELECT unit_row_id, carga_em, NOT coalesce(base_de_calculo > 0 AND NOT isnan(base_de_calculo), false) AS flag_base_invalida,
  NOT coalesce(area_constr_privativa > 0 AND NOT isnan(area_constr_privativa), false) AS flag_area_invalida,
  coalesce(perc_transmitido IS NOT NULL AND NOT isnan(perc_transmitido) AND (perc_transmitido <= 0 OR perc_transmitido > 100), false) AS flag_percentual_invalido FROM itbi_units"""


@MARKET.query(UNIT_FLAGS)
def structural_flags(spark, sf_dir):
    rows = table(spark, sf_dir, "itbi_units")
    flagged = quality.structural_flags(rows, {"flag_base_invalida": "base_de_calculo", "flag_area_invalida": "area_constr_privativa"}, "perc_transmitido")
    return flagged.select("unit_row_id", "carga_em", "flag_base_invalida", "flag_area_invalida", "flag_percentual_invalido")


IQR = {"base_real": "base_de_calculo_real", "valor_m2_real": "valor_m2_base_real", "area": "area_referencia_m2"}
IQR_GROUPS = ["cod_municipio", "source_year", "flag_multiunit_qc"]
IQR_SQL = f"""{LATEST}, long AS (SELECT cod_municipio, source_year, flag_multiunit_qc, unnest([{{'metric': 'base_real', 'value_column': 'base_de_calculo_real', 'v': base_de_calculo_real}},
    {{'metric': 'valor_m2_real', 'value_column': 'valor_m2_base_real', 'v': valor_m2_base_real}}, {{'metric': 'area', 'value_column': 'area_referencia_m2', 'v': area_referencia_m2}}]) AS s FROM latest),
fit AS (SELECT s.metric AS metric, s.value_column AS value_column, cod_municipio, source_year, flag_multiunit_qc, count(*) AS n, quantile_cont(ln(s.v), 0.25) AS q1, quantile_cont(ln(s.v), 0.75) AS q3
  FROM long WHERE s.v > 0 AND NOT isnan(s.v) AND NOT isinf(s.v) GROUP BY ALL),
fences AS (SELECT *, n >= 50 AND q3 > q1 AS applied, CASE WHEN n < 50 THEN 'group_too_small' WHEN NOT q3 > q1 THEN 'non_positive_iqr' END AS reason_not_applied FROM fit)"""


@MARKET.query(f"""WITH {IQR_SQL} SELECT metric, value_column, cod_municipio, source_year, flag_multiunit_qc, n, applied, reason_not_applied,
  round(CASE WHEN applied THEN q1 END, 6) AS q1_log, round(CASE WHEN applied THEN q3 END, 6) AS q3_log, round(CASE WHEN applied THEN q3 - q1 END, 6) AS iqr_log,
  round(CASE WHEN applied THEN exp(q1 - 3 * (q3 - q1)) END, 6) AS lower_bound, round(CASE WHEN applied THEN exp(q3 + 3 * (q3 - q1)) END, 3) AS upper_bound FROM fences""")
def log_iqr_thresholds(spark, sf_dir):
    return rounded(quality.log_iqr_thresholds(latest(spark, sf_dir), IQR, IQR_GROUPS), 6, {"upper_bound": 3})


@MARKET.query(f"""WITH {IQR_SQL}, wide AS (SELECT cod_municipio, source_year, flag_multiunit_qc, max(CASE WHEN applied AND metric = 'base_real' THEN exp(q1 - 3 * (q3 - q1)) END) AS bl,
    max(CASE WHEN applied AND metric = 'base_real' THEN exp(q3 + 3 * (q3 - q1)) END) AS bh, max(CASE WHEN applied AND metric = 'valor_m2_real' THEN exp(q1 - 3 * (q3 - q1)) END) AS vl,
    max(CASE WHEN applied AND metric = 'valor_m2_real' THEN exp(q3 + 3 * (q3 - q1)) END) AS vh, max(CASE WHEN applied AND metric = 'area' THEN exp(q1 - 3 * (q3 - q1)) END) AS al,
    max(CASE WHEN applied AND metric = 'area' THEN exp(q3 + 3 * (q3 - q1)) END) AS ah FROM fences GROUP BY ALL),
f AS (SELECT l.cod_municipio, transaction_id, coalesce(base_de_calculo_real > 0 AND (base_de_calculo_real < bl OR base_de_calculo_real > bh), false) AS flag_outlier_base_real,
  coalesce(valor_m2_base_real > 0 AND (valor_m2_base_real < vl OR valor_m2_base_real > vh), false) AS flag_outlier_valor_m2_real,
  coalesce(area_referencia_m2 > 0 AND (area_referencia_m2 < al OR area_referencia_m2 > ah), false) AS flag_outlier_area
  FROM latest l LEFT JOIN wide w ON l.cod_municipio IS NOT DISTINCT FROM w.cod_municipio AND l.source_year IS NOT DISTINCT FROM w.source_year AND l.flag_multiunit_qc IS NOT DISTINCT FROM w.flag_multiunit_qc)
SELECT *, flag_outlier_base_real OR flag_outlier_valor_m2_real OR flag_outlier_area AS flag_outlier_estatistico FROM f""")
def log_iqr_flags(spark, sf_dir):
    rows = latest(spark, sf_dir)
    flagged = quality.log_iqr_flags(rows, quality.log_iqr_thresholds(rows, IQR, IQR_GROUPS), IQR, IQR_GROUPS)
    return flagged.select("cod_municipio", "transaction_id", *[f"flag_outlier_{m}" for m in IQR], "flag_outlier_estatistico")


NESTED = f"""WITH {LATEST}, n AS (SELECT cod_municipio, transaction_id, source_year, n_units, coalesce(flag_use_market_analysis, false) AND coalesce(base_de_calculo_real > 0, false) AND coalesce(area_referencia_m2 > 0, false) AS m,
  coalesce(flag_use_spatial_analysis, false) AS g, sector_final_code IS NULL AS ns FROM latest)"""


def _nested(spark, sf_dir):
    rows = latest(spark, sf_dir)
    rows = quality.structural_flags(
        rows, {"flag_base_real_invalida": "base_de_calculo_real", "flag_area_invalida": "area_referencia_m2"},
        flags={"flag_amostra_mercado_origem": "flag_use_market_analysis", "flag_geocode_utilizavel": "flag_use_spatial_analysis"},
    )
    rows = rows.withColumns({"flag_setor_espacial_ausente": F.col("sector_final_code").isNull(), "flag_census_matched": F.col("sector_final_code").isNotNull()})
    return quality.nested_samples(rows.drop("flag_use_market_analysis", "flag_use_spatial_analysis"), ["flag_base_real_invalida", "flag_area_invalida"])


@MARKET.query(NESTED + """ SELECT cod_municipio, transaction_id, m AS flag_use_market_analysis, m AND g AND NOT ns AS flag_use_spatial_analysis, m AND g AND NOT ns AS flag_use_socioeconomic_analysis,
  m AND g AND NOT ns AND NOT coalesce(n_units > 1, false) AS flag_use_model_preliminar FROM n""")
def nested_samples(spark, sf_dir):
    return _nested(spark, sf_dir).select(
        "cod_municipio", "transaction_id", "flag_use_market_analysis", "flag_use_spatial_analysis", "flag_use_socioeconomic_analysis", "flag_use_model_preliminar"
    )


@MARKET.query(NESTED + """ SELECT source_year, count(*) AS transactions, count(*) FILTER (m) AS use_market, count(*) FILTER (m AND g AND NOT ns) AS use_spatial,
  round(100.0 * count(*) FILTER (m) / count(*), 3) AS pct_use_market, round(100.0 * count(*) FILTER (m AND g AND NOT ns) / count(*), 3) AS pct_use_spatial FROM n GROUP BY ALL""")
def qc_summary_year(spark, sf_dir):
    flags = {"use_market": "flag_use_market_analysis", "use_spatial": "flag_use_spatial_analysis"}
    return quality.flag_summary(_nested(spark, sf_dir), ["source_year"], flags, list(flags))


QC_FULL = f"""WITH {IQR_SQL}, wide AS (SELECT cod_municipio, source_year, flag_multiunit_qc, max(CASE WHEN applied AND metric = 'base_real' THEN exp(q1 - 3 * (q3 - q1)) END) AS bl,
    max(CASE WHEN applied AND metric = 'base_real' THEN exp(q3 + 3 * (q3 - q1)) END) AS bh, max(CASE WHEN applied AND metric = 'valor_m2_real' THEN exp(q1 - 3 * (q3 - q1)) END) AS vl,
    max(CASE WHEN applied AND metric = 'valor_m2_real' THEN exp(q3 + 3 * (q3 - q1)) END) AS vh, max(CASE WHEN applied AND metric = 'area' THEN exp(q1 - 3 * (q3 - q1)) END) AS al,
    max(CASE WHEN applied AND metric = 'area' THEN exp(q3 + 3 * (q3 - q1)) END) AS ah FROM fences GROUP BY ALL),
f AS (SELECT l.*, coalesce(base_de_calculo_real > 0 AND (base_de_calculo_real < bl OR base_de_calculo_real > bh), false) AS ob, coalesce(valor_m2_base_real > 0 AND (valor_m2_base_real < vl OR valor_m2_base_real > vh), false) AS ov,
    coalesce(area_referencia_m2 > 0 AND (area_referencia_m2 < al OR area_referencia_m2 > ah), false) AS oa, NOT coalesce(base_de_calculo_real > 0, false) AS ib, NOT coalesce(area_referencia_m2 > 0, false) AS ia, NOT coalesce(valor_m2_base_real > 0, false) AS iv,
    coalesce(flag_use_market_analysis, false) AS o, coalesce(flag_use_spatial_analysis, false) AS g, sector_final_code IS NOT NULL AS c, coalesce(l.flag_multiunit_qc, false) AS mu,
    count(*) OVER (PARTITION BY l.cod_municipio, data_pagamento, base_de_calculo_real, area_referencia_m2, sector_final_code) > 1 AS d
  FROM latest l LEFT JOIN wide w ON l.cod_municipio IS NOT DISTINCT FROM w.cod_municipio AND l.source_year IS NOT DISTINCT FROM w.source_year AND l.flag_multiunit_qc IS NOT DISTINCT FROM w.flag_multiunit_qc),
u AS (SELECT *, o AND NOT (ib OR ia OR d OR ob OR ov OR oa) AS um FROM f), q AS (SELECT *, um AND g AND c AS us FROM u)"""
_QC = {
    "market_origin": "o", "census_matched": "c", "geocode_usable": "g", "invalid_base_real": "ib", "invalid_area": "ia", "invalid_value_m2_real": "iv", "exact_duplicates": "d", "multiunit": "mu", "outlier_base_real": "ob",
    "outlier_value_m2_real": "ov", "outlier_area": "oa", "outlier_any": "ob OR ov OR oa", "use_market": "um", "use_spatial": "us", "use_socioeconomic": "us", "use_model_preliminary": "us AND NOT mu",
}
_QC_COUNTS = "count(*) AS transactions, " + ", ".join(f"count(*) FILTER ({c}) AS {n}" for n, c in _QC.items())


def _audited(spark, sf_dir):
    """Transactions with every flag of the quality stage."""
    rows = latest(spark, sf_dir)
    rows = quality.log_iqr_flags(rows, quality.log_iqr_thresholds(rows, IQR, IQR_GROUPS), IQR, IQR_GROUPS)
    positive = {"flag_base_real_invalida": "base_de_calculo_real", "flag_area_invalida": "area_referencia_m2", "flag_valor_m2_real_invalido": "valor_m2_base_real"}
    rows = quality.structural_flags(rows, positive, flags={"flag_amostra_mercado_origem": "flag_use_market_analysis", "flag_geocode_utilizavel": "flag_use_spatial_analysis"})
    rows = guides.content_duplicates(rows, ["cod_municipio", "data_pagamento", "base_de_calculo_real", "area_referencia_m2", "sector_final_code"]).withColumnRenamed("flag_duplicado_exato", "flag_duplicado_qc")
    rows = rows.withColumns({"flag_setor_espacial_ausente": F.col("sector_final_code").isNull(), "flag_census_matched": F.col("sector_final_code").isNotNull()})
    return quality.nested_samples(rows.drop("flag_use_market_analysis", "flag_use_spatial_analysis"), ["flag_base_real_invalida", "flag_area_invalida"])


@MARKET.query(f"{QC_FULL} SELECT source_year, {_QC_COUNTS}, " + ", ".join(f"round(100.0 * count(*) FILTER ({_QC[n]}) / count(*), 3) AS pct_{n}" for n in quality.QC_SHARES) + " FROM q GROUP BY ALL")
def qc_year_summary(spark, sf_dir):
    """The yearly summary of the quality stage in full."""
    return quality.qc_year_summary(_audited(spark, sf_dir))


@MARKET.query(f"{QC_FULL} SELECT {_QC_COUNTS} FROM q")
def qc_metadata(spark, sf_dir):
    return quality.qc_metadata(_audited(spark, sf_dir))


@MARKET.query(SECTOR_YEAR + " SELECT 0.0::DOUBLE AS scale_min, greatest(1.0, quantile_cont(CAST(n_transacoes AS DOUBLE), 0.98)) AS scale_max FROM sector_year")
def volume_scale(spark, sf_dir):
    return indicators.common_volume_scale(sector_year_indicators(spark, sf_dir))


@MARKET.query(SECTOR_YEAR + """, y AS (SELECT DISTINCT ano_analise FROM sector_year)
SELECT m.cd_mun AS cod_municipio, m.cd_setor AS setor, y.ano_analise, s.n_transacoes, CASE WHEN NOT coalesce(n_transacoes < 5, false) THEN valor_m2_mediano_real END AS valor_m2_mediano_real
FROM census_sectors m CROSS JOIN y LEFT JOIN sector_year s ON s.cod_municipio || s.sector_final_code = m.cd_setor AND s.cod_municipio = m.cd_mun AND s.ano_analise = y.ano_analise""")
def sector_map(spark, sf_dir):
    """Every sector in every year with its count and its price, the price masked below five transactions."""
    rows = sector_year_indicators(spark, sf_dir)
    payload = rows.select("cod_municipio", F.concat("cod_municipio", "sector_final_code").alias("setor"), "ano_analise", "n_transacoes", "valor_m2_mediano_real")
    mesh = table(spark, sf_dir, "census_sectors").select(F.col("cd_mun").alias("cod_municipio"), F.col("cd_setor").alias("setor"))
    return indicators.masked(indicators.on_mesh(mesh, payload, ["cod_municipio", "setor"], rows.select("ano_analise")), "valor_m2_mediano_real", 5)


@MARKET.query(f"WITH {LATEST}, {COVERAGE} SELECT cod_municipio, CAST(coalesce(max(CASE WHEN NOT flag_ano_incompleto THEN ano_analise END), max(ano_analise)) AS INTEGER) AS ano_analise, count(*) FILTER (NOT flag_ano_incompleto) = 0 AS flag_ano_incompleto FROM coverage GROUP BY ALL")
def latest_complete_year(spark, sf_dir):
    return indicators.latest_complete_year(indicators.year_coverage(market(spark, sf_dir), AS_OF_YEAR, AREA), AREA)


@MARKET.query(f"WITH {LATEST}, {COVERAGE}, y AS (SELECT cod_municipio, ano_analise, count(*) AS n_transacoes FROM latest WHERE flag_use_market_analysis GROUP BY ALL) SELECT cod_municipio, ano_analise, n_transacoes, flag_ano_incompleto FROM y LEFT JOIN coverage USING (cod_municipio, ano_analise)")
def chart_transactions(spark, sf_dir):
    """The table behind the chart of transactions by year; the other charts' tables come from the same call."""
    m = market(spark, sf_dir)
    yearly, ytd = indicators.city_year(m, AS_OF_YEAR, AREA), indicators.ytd_comparable(m, AS_OF_YEAR, AREA)
    return indicators.chart_tables(yearly, indicators.city_month(m, AREA), ytd, sector_year_indicators(spark, sf_dir), AREA)["transactions_by_year"]


def _profile_sql(name: str, columns: dict[str, str]) -> str:
    parts = []
    for c, kind in columns.items():
        number = f"round(CAST(min({c}) AS DOUBLE), 6) AS min, round(quantile_cont(CAST({c} AS DOUBLE), 0.25), 6) AS p25, round(median(CAST({c} AS DOUBLE)), 6) AS median, round(avg(CAST({c} AS DOUBLE)), 6) AS mean, round(quantile_cont(CAST({c} AS DOUBLE), 0.75), 6) AS p75, round(CAST(max({c}) AS DOUBLE), 6) AS max"
        empty = ", ".join(f"CAST(NULL AS DOUBLE) AS {k}" for k in ("min", "p25", "median", "mean", "p75", "max"))
        flags = f"count(*) FILTER ({c}) AS n_true, count(*) FILTER (NOT {c}) AS n_false" if kind == "boolean" else "CAST(NULL AS BIGINT) AS n_true, CAST(NULL AS BIGINT) AS n_false"
        parts.append(
            f"SELECT '{c}' AS \"column\", '{kind}' AS dtype, count(*) AS n_rows, count(*) - count({c}) AS n_null, round(100.0 * (count(*) - count({c})) / count(*), 3) AS pct_null, "
            f"count(DISTINCT {c}) AS n_unique, {flags}, {number if kind in ('int', 'bigint', 'double') else empty} FROM {name}"
        )
    return " UNION ALL ".join(parts)


@MARKET.query(_profile_sql("customer", {"c_custkey": "bigint", "c_name": "string", "c_nationkey": "int", "c_acctbal": "double", "c_mktsegment": "string"}))
def column_profile(spark, sf_dir):
    return rounded(quality.column_profile(table(spark, sf_dir, "customer")))


CPI_SQL = """cpi AS (SELECT period, pct, exp(sum(ln(1 + pct / 100)) OVER (ORDER BY period)) AS level FROM (
  SELECT DISTINCT strftime(o_orderdate, '%Y-%m') AS period, ((year(o_orderdate) * 12 + month(o_orderdate)) % 7 - 2) / 10.0 AS pct FROM orders))"""


def _cpi(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    pct = ((F.year("o_orderdate") * 12 + F.month("o_orderdate")) % 7 - 2) / F.lit(10.0)
    return deflate.chained_index(o.select(F.date_format("o_orderdate", "yyyy-MM").alias("period"), pct.alias("pct")).distinct())


@MARKET.query(f"WITH {CPI_SQL} SELECT period, CAST(round(pct, 8) AS DOUBLE) AS pct, round(level, 8) AS level FROM cpi")
def cpi_chain_index(spark, sf_dir):
    return rounded(_cpi(spark, sf_dir), 8)


DEFLATED = f"""WITH {CPI_SQL}, ref AS (SELECT level AS rl FROM cpi ORDER BY period DESC LIMIT 1),
d AS (SELECT o_orderkey, year(o_orderdate) AS ano, o_totalprice, rl / level AS f, level IS NOT NULL AS there FROM orders LEFT JOIN cpi ON strftime(o_orderdate, '%Y-%m') = period CROSS JOIN ref)"""


def _deflated(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_totalprice").withColumn("ano", F.year("o_orderdate"))
    return deflate.deflate(o, _cpi(spark, sf_dir), "o_orderdate", ["o_totalprice"])


@MARKET.query(DEFLATED + " SELECT o_orderkey, round(f, 6) AS deflation_factor, round(o_totalprice * f, 2) AS o_totalprice_real, there AS flag_ipca_disponivel FROM d")
def deflate_orders(spark, sf_dir):
    rows = _deflated(spark, sf_dir).select("o_orderkey", "deflation_factor", "o_totalprice_real", "flag_ipca_disponivel")
    return rounded(rows, 6, {"o_totalprice_real": 2})


@MARKET.query(DEFLATED + """ SELECT ano, count(*) AS transactions, count(*) FILTER (there) AS matched, round(100.0 * count(*) FILTER (there) / count(*), 3) AS pct_matched,
  round(median(o_totalprice), 6) AS median_nominal, round(median(o_totalprice * f), 2) AS median_real, round(median(f), 6) AS median_factor FROM d GROUP BY ALL""")
def deflation_summary(spark, sf_dir):
    return rounded(deflate.deflation_summary(_deflated(spark, sf_dir), "ano", "o_totalprice"), 6, {"median_real": 2, "median_factor": 6})


GROUPED_EVENTS = """WITH e AS (SELECT event_id, user_id % 4 AS file, CASE WHEN event_type = 'purchase' THEN value END AS base, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS area FROM events),
k AS (SELECT *, sum(CASE WHEN base IS NOT NULL THEN 1 ELSE 0 END) OVER w AS k, row_number() OVER w AS i FROM e WINDOW w AS (PARTITION BY file ORDER BY event_id)),
g AS (SELECT event_id, file, base, area, CAST(CASE WHEN k = 0 THEN -i ELSE k END AS BIGINT) AS guide_seq, k = 0 AS orphan FROM k)"""


def _guides(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(
        "event_id", (F.col("user_id") % 4).alias("file"), F.when(F.col("event_type") == "purchase", F.col("value")).alias("base_de_calculo"),
        F.get_json_object("props", "$.k").try_cast("double").alias("area_constr_privativa"), "event_type",
    )
    return guides.infer_groups(e, ["file"], ["event_id"], "base_de_calculo")


@MARKET.query(GROUPED_EVENTS + """ SELECT event_id, file, guide_seq, orphan AS flag_group_orphan, count(*) OVER (PARTITION BY file, guide_seq) AS guide_rows,
  max(base) OVER (PARTITION BY file, guide_seq) AS guide_base FROM g""")
def guide_groups(spark, sf_dir):
    return _guides(spark, sf_dir).select("event_id", "file", "guide_seq", "flag_group_orphan", "guide_rows", "guide_base")


@MARKET.query(GROUPED_EVENTS + """, t AS (SELECT file, guide_seq, count(*) AS n_units, min(event_id) AS source_row_start, max(event_id) AS source_row_end, max(base) AS base_de_calculo,
  sum(CASE WHEN area > 0 THEN area END) AS s, count(*) FILTER (area > 0) AS n_valid FROM g GROUP BY ALL)
SELECT file, guide_seq, n_units, source_row_start, source_row_end, base_de_calculo, s AS area_constr_privativa_soma_m2, n_valid AS area_constr_privativa_n_validas, n_units > 1 AS flag_multiunit,
  CASE WHEN n_valid = n_units THEN s END AS area_referencia_m2, CASE WHEN n_valid = n_units THEN 'sum_area_constr_privativa' ELSE 'indeterminada_multiunit' END AS area_referencia_metodo,
  round(CASE WHEN base_de_calculo > 0 AND n_valid = n_units THEN base_de_calculo / s END, 6) AS valor_m2_base FROM t""")
def guide_transactions(spark, sf_dir):
    units = _guides(spark, sf_dir).withColumns({"area_constr_total": F.lit(None).cast("double"), "area_total_terreno": F.lit(None).cast("double")})
    tx = guides.build_transactions(units, ["file", "guide_seq"], "event_id", texts=["event_type"], firsts=["base_de_calculo"])
    return rounded(tx.drop("event_type", "area_constr_total_max_m2", "area_total_terreno_max_m2"))


@MARKET.query("""WITH g AS (SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, n > 1 AS flag_duplicado_exato FROM lineitem JOIN g USING (l_orderkey, l_linenumber)""")
def exact_duplicates(spark, sf_dir):
    rows = guides.content_duplicates(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "flag_duplicado_exato")


@MARKET.query("""WITH a AS (SELECT year(o_orderdate) AS ano, count(*) AS n_orders, round(median(o_totalprice), 6) AS median_price FROM orders GROUP BY ALL),
b AS (SELECT year(l_shipdate) AS ano, count(*) AS n_lines, count(DISTINCT l_orderkey) AS n_shipped FROM lineitem GROUP BY ALL) SELECT * FROM a FULL JOIN b USING (ano)""")
def full_outer_year_summary(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").withColumn("ano", F.year("o_orderdate"))
    a = with_percentiles(orders.groupBy("ano").agg(F.count(F.lit(1)).alias("n_orders")), orders, ["ano"], {"median_price": (F.col("o_totalprice"), 0.5)})
    b = table(spark, sf_dir, "lineitem").groupBy(F.year("l_shipdate").alias("ano")).agg(F.count(F.lit(1)).alias("n_lines"), F.count_distinct("l_orderkey").alias("n_shipped"))
    return rounded(guides.outer_summary(a, b, ["ano"]))


def _sql_key(c: str) -> str:
    clean = f"CASE WHEN lower(trim({c})) NOT IN ('', 'nan', 'none', 'null', 'na', 'n/a', '<na>', '-') THEN trim({c}) END"
    return f"nullif(trim(regexp_replace(regexp_replace(upper(strip_accents(replace(replace({clean}, 'º', 'o'), 'ª', 'a'))), '[^A-Z0-9 ]', ' ', 'g'), ' +', ' ', 'g')), '')"


def _sql_street(c: str) -> str:
    return f"nullif(trim(regexp_replace({_sql_key(c)}, '^((?:{'|'.join(text.STREET_TYPES)})( |$))+', '')), '')"


def _sql_number(c: str) -> str:
    k = _sql_key(c)
    return f"CASE WHEN {k} IS NULL OR {k} IN ('SN', 'S N', 'SEM NUMERO') OR regexp_extract({k}, '(\\d+)', 1) = '' THEN NULL ELSE coalesce(nullif(ltrim(regexp_extract({k}, '(\\d+)', 1), '0'), ''), '0') END"


@MARKET.query(f"""SELECT address_record_id, {_sql_key("bairro")} AS bairro_key, {_sql_street("logradouro")} AS street_key, {_sql_number("n_endereco")} AS number_key,
  CASE WHEN regexp_replace(cep, '\\D', '', 'g') <> '' THEN CASE WHEN length(regexp_replace(cep, '\\D', '', 'g')) < 8 THEN lpad(regexp_replace(cep, '\\D', '', 'g'), 8, '0') ELSE left(regexp_replace(cep, '\\D', '', 'g'), 8) END END AS cep_key
FROM address_records""")
def text_keys(spark, sf_dir):
    rows = table(spark, sf_dir, "address_records")
    return resolve.address_keys(rows, "logradouro", "n_endereco", "cep").select("address_record_id", text.text_key(F.col("bairro")).alias("bairro_key"), "street_key", "number_key", "cep_key")


@MARKET.query("SELECT doc_id, md5(upper(strip_accents(cartorio))) AS folded, CASE WHEN source IS NULL THEN NULL ELSE lower(strip_accents(trim(source))) END AS source_key FROM documents")
def accent_fold(spark, sf_dir):
    rows = table(spark, sf_dir, "documents")
    return rows.select("doc_id", F.md5(F.upper(text.fold_accents(F.col("cartorio"))).cast("binary")).alias("folded"), F.lower(text.fold_accents(text.strip(F.col("source")))).alias("source_key"))


@MARKET.query("SELECT cod_unico_endereco, count(*) AS n, max(nullif(left(regexp_replace(cod_setor, '[^0-9]', '', 'g'), 15), '')) AS sector_code FROM address_register GROUP BY ALL")
def code_digits(spark, sf_dir):
    rows = table(spark, sf_dir, "address_register").withColumn("c", text.code_digits(F.col("cod_setor")))
    return rows.groupBy("cod_unico_endereco").agg(F.count(F.lit(1)).alias("n"), F.max("c").alias("sector_code"))


@MARKET.query("SELECT l_orderkey, l_linenumber, l_partkey, round(l_extendedprice, 2) AS brazilian, round(l_extendedprice, 2) AS american, strftime(l_shipdate, '%Y-%m-%d') AS day_first FROM lineitem")
def parse_numbers_dates(spark, sf_dir):
    """Amounts and dates written in local notation and read back."""
    rows = table(spark, sf_dir, "lineitem")
    american = F.format_number("l_extendedprice", 2)
    brazilian = F.concat(F.lit("R$ "), F.translate(american, ",.", ".,"))
    return rows.select(
        "l_orderkey", "l_linenumber", "l_partkey", numbers.parse_number(brazilian).alias("brazilian"), numbers.parse_number(american).alias("american"),
        F.date_format(parse_date(F.date_format("l_shipdate", "dd/MM/yyyy")), "yyyy-MM-dd").alias("day_first"),
    )


@MARKET.query("""SELECT a.n_name AS a, b.n_name AS b, round(CASE WHEN length(a.n_name) + length(b.n_name) = 0 THEN 100.0 ELSE 200.0 * list_last(list_reduce(
    list_prepend([0 FOR x IN range(length(b.n_name) + 1)], [[ascii(c)] FOR c IN string_split(a.n_name, '')]), lambda row, ch: list_reduce(list_prepend([0], [[j] FOR j IN range(1, length(b.n_name) + 1)]),
    lambda made, j: list_append(made, CASE WHEN ascii(b.n_name[j[1]]) = ch[1] THEN row[j[1]] + 1 ELSE greatest(row[j[1] + 1], made[j[1]]) END)))) / (length(a.n_name) + length(b.n_name)) END, 4) AS ratio
FROM nation a JOIN nation b USING (n_regionkey) WHERE a.n_nationkey < b.n_nationkey""")
def indel_similarity(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    a, b = n.select("n_regionkey", F.col("n_nationkey").alias("ka"), F.col("n_name").alias("a")), n.select("n_regionkey", F.col("n_nationkey").alias("kb"), F.col("n_name").alias("b"))
    return a.join(b, "n_regionkey").where("ka < kb").select("a", "b", F.round(similarity.indel_ratio(F.col("a"), F.col("b")), 4).alias("ratio"))


def _index(spark, sf_dir):
    return resolve.build_address_index(table(spark, sf_dir, "address_register"))


def _unit_addresses(spark, sf_dir):
    rows = table(spark, sf_dir, "itbi_units").select("unit_row_id", "carga_em", "guide_group_id", "source_year", "cod_municipio", "logradouro", "n_endereco", "cep")
    return resolve.address_keys(rows, "logradouro", "n_endereco", "cep")


def _sql_plain(c: str) -> str:
    return f"CASE WHEN lower(trim({c})) NOT IN ('', 'nan', 'none', 'null', 'na', 'n/a', '<na>', '-') THEN regexp_replace(trim({c}), '\\s+', ' ', 'g') END"


def _sql_postal(c: str) -> str:
    digits = f"regexp_replace({c}, '\\D', '', 'g')"
    return f"CASE WHEN {digits} <> '' THEN CASE WHEN length({digits}) < 8 THEN lpad({digits}, 8, '0') ELSE left({digits}, 8) END END"


KEY = "cod_municipio, street_key, number_key, cep_key"
INDEX = f"""WITH r AS (SELECT cod_municipio, nullif(concat_ws(' ', {_sql_plain("nom_tipo_seglogr")}, {_sql_plain("nom_titulo_seglogr")}, {_sql_plain("nom_seglogr")}), '') AS label,
    nullif(left(regexp_replace(cod_setor, '[^0-9]', '', 'g'), 15), '') AS sector, nv_geo_coord AS lvl, try_cast(replace(trim(latitude), ',', '.') AS DOUBLE) AS lat,
    try_cast(replace(trim(longitude), ',', '.') AS DOUBLE) AS lon, num_endereco, regexp_replace(CASE WHEN lower(trim(cep)) NOT IN ('nan', 'none', 'null', '<na>') THEN cep END, '\\D', '', 'g') AS z FROM address_register),
a AS (SELECT *, {_sql_street("label")} AS street_key, {_sql_number("num_endereco")} AS number_key, CASE WHEN z <> '' THEN CASE WHEN length(z) < 8 THEN lpad(z, 8, '0') ELSE left(z, 8) END END AS cep_key
  FROM r WHERE lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180 AND lat <> 0 AND lon <> 0),
k AS (SELECT * FROM a WHERE street_key IS NOT NULL),
m AS (SELECT {KEY}, what, v, row_number() OVER (PARTITION BY {KEY}, what ORDER BY count(*) DESC, v) AS n FROM (SELECT {KEY}, 'label' AS what, label AS v FROM k UNION ALL SELECT {KEY}, 'sector', sector FROM k UNION ALL SELECT {KEY}, 'level', CAST(lvl AS VARCHAR) FROM k)
  WHERE v IS NOT NULL GROUP BY {KEY}, what, v),
w AS (SELECT {KEY}, max(v) FILTER (what = 'label') AS label, max(v) FILTER (what = 'sector') AS sector_code, CAST(max(v) FILTER (what = 'level') AS INTEGER) AS geo_level FROM m WHERE n = 1 GROUP BY ALL),
g AS (SELECT {KEY}, round(median(lat), 7) AS latitude, round(median(lon), 7) AS longitude, count(DISTINCT sector) AS n_sector_codes, count(*) AS n_records,
  round(2 * 6371008.8 * asin(sqrt(least(1, pow(sin(radians(max(lat) - min(lat)) / 2), 2) + cos(radians(min(lat))) * cos(radians(max(lat))) * pow(sin(radians(max(lon) - min(lon)) / 2), 2)))), 4) AS spread_m FROM k GROUP BY ALL)
SELECT g.*, w.label, w.sector_code, w.geo_level FROM g LEFT JOIN w ON g.cod_municipio = w.cod_municipio AND g.street_key = w.street_key AND g.number_key IS NOT DISTINCT FROM w.number_key AND g.cep_key IS NOT DISTINCT FROM w.cep_key"""


def _sql_indel(a: str, b: str) -> str:
    """``100 * 2 * LCS / (both lengths)`` of two texts of ASCII letters, by rows of the dynamic programme."""
    made = f"CASE WHEN ascii({b}[j[1]]) = ch[1] THEN row[j[1]] + 1 ELSE greatest(row[j[1] + 1], made[j[1]]) END"
    step = f"list_reduce(list_prepend([0], [[j] FOR j IN range(1, length({b}) + 1)]), lambda made, j: list_append(made, {made}))"
    first = f"list_prepend([0 FOR x IN range(length({b}) + 1)], [[ascii(c)] FOR c IN string_split({a}, '')])"
    return f"round(200.0 * list_last(list_reduce({first}, lambda row, ch: {step})) / (length({a}) + length({b})), 4)"


STREET_BLOCKS = f"""WITH i AS (SELECT DISTINCT cod_municipio, cep_key, street_key FROM ({INDEX})),
r AS (SELECT DISTINCT cod_municipio, {_sql_street("logradouro")} AS street_key,
  CASE WHEN regexp_replace(cep, '\\D', '', 'g') <> '' THEN CASE WHEN length(regexp_replace(cep, '\\D', '', 'g')) < 8 THEN lpad(regexp_replace(cep, '\\D', '', 'g'), 8, '0') ELSE left(regexp_replace(cep, '\\D', '', 'g'), 8) END END AS cep_key FROM address_records),
p AS (SELECT DISTINCT r.street_key AS a, i.street_key AS b FROM r JOIN i USING (cod_municipio, cep_key) WHERE r.street_key IS NOT NULL)"""


@MARKET.query(f"{STREET_BLOCKS} SELECT a, b, {_sql_indel('a', 'b')} AS ratio FROM p")
def street_similarity(spark, sf_dir):
    """Street names of the records scored against all of the index in their block (postal code)."""
    keys = ["cod_municipio", "cep_key", "street_key"]
    rows = table(spark, sf_dir, "address_records").select("cod_municipio", "logradouro", "n_endereco", "cep")
    asked = resolve.address_keys(rows, "logradouro", "n_endereco", "cep").select(*keys).distinct().withColumnRenamed("street_key", "a")
    known = _index(spark, sf_dir).select(*keys).distinct().withColumnRenamed("street_key", "b")
    pairs = asked.join(known, keys[:2]).where("a is not null").select("a", "b").distinct()
    return pairs.select("a", "b", F.round(similarity.indel_ratio(F.col("a"), F.col("b")), 4).alias("ratio"))


@MARKET.query()
def accent_fold_texts(spark, sf_dir):
    """Whole texts folded; ``n_left`` counts combining marks that remain, which is none."""
    folded = text.fold_accents(F.col("text"))
    rows = table(spark, sf_dir, "documents").select("doc_id", folded.alias("f"))
    return rows.select("doc_id", F.length("f").alias("n_chars"), F.md5(F.col("f").cast("binary")).alias("folded"), F.regexp_count("f", F.lit("[\\u0300-\\u036f]")).alias("n_left"))


@MARKET.query(INDEX)
def address_index(spark, sf_dir):
    return rounded(_index(spark, sf_dir), 7, {"spread_m": 4})


PLACE = "latitude, longitude, label, sector_code, n_sector_codes, geo_level, n_records, spread_m"


def _sql_spread(lat: str, lon: str) -> str:
    wide = f"pow(sin(radians(max({lon}) - min({lon})) / 2), 2)"
    return f"2 * 6371008.8 * asin(sqrt(least(1, pow(sin(radians(max({lat}) - min({lat})) / 2), 2) + cos(radians(min({lat}))) * cos(radians(max({lat}))) * {wide})))"


def _sql_fuzzy(rest: str, name: str, on: str, needs: str, least: float, margin: float, top: float, base: float, weight: float, method: str) -> str:
    """CTEs of one fuzzy step: pairs of a block, scores of distinct names, the best that leads by the margin."""
    lengths = "least(length(r.street_key), length(i.street_key)) * 200.0 / (length(r.street_key) + length(i.street_key))"
    return f"""{name}_p AS (SELECT r.cod_municipio, r.street_key, r.number_key, r.cep_key, i.street_key AS sc, i.cep_key AS cc, {PLACE} FROM {rest} r JOIN i ON r.cod_municipio = i.cod_municipio AND {on} WHERE {needs} AND {lengths} >= {least - margin}),
{name}_d AS (SELECT a, b, {_sql_indel("a", "b")} AS s FROM (SELECT DISTINCT street_key AS a, sc AS b FROM {name}_p)),
{name} AS (SELECT {KEY}, '{method}' AS geocode_method, round(least({top}, {base} + s * {weight}), 2) AS geocode_score, {PLACE} FROM (SELECT p.*, s, row_number() OVER w AS n, lead(s) OVER w AS nx FROM {name}_p p JOIN {name}_d d ON d.a = p.street_key AND d.b = p.sc
  WINDOW w AS (PARTITION BY {KEY} ORDER BY s DESC, sc, cc)) WHERE n = 1 AND s >= {least} AND (nx IS NULL OR s - nx >= {margin}))"""


def _sql_without(rest: str, found: str) -> str:
    return f"SELECT * FROM {rest} r WHERE NOT EXISTS (SELECT 1 FROM {found} f WHERE " + " AND ".join(f"f.{k} IS NOT DISTINCT FROM r.{k}" for k in KEY.split(", ")) + ")"


GEOCODED = f"""WITH u AS (SELECT unit_row_id, carga_em, guide_group_id, source_year, cod_municipio, {_sql_street("logradouro")} AS street_key, {_sql_number("n_endereco")} AS number_key, {_sql_postal("cep")} AS cep_key FROM itbi_units),
i AS MATERIALIZED ({INDEX}), todo AS MATERIALIZED (SELECT DISTINCT {KEY} FROM u), named AS (SELECT * FROM todo WHERE street_key IS NOT NULL),
s1 AS (SELECT n.*, 'exact_street_number_cep' AS geocode_method, 100.0 AS geocode_score, {PLACE} FROM named n JOIN i USING ({KEY})), r1 AS ({_sql_without("named", "s1")}),
k2 AS (SELECT * FROM (SELECT cod_municipio, street_key, number_key, median(latitude) AS latitude, median(longitude) AS longitude, arg_min(label, cep_key) AS label, min(sector_code) AS sector_code, count(DISTINCT sector_code) AS n_sector_codes,
    arg_min(geo_level, cep_key) AS geo_level, sum(n_records) AS n_records, {_sql_spread("latitude", "longitude")} AS spread_m, count(*) AS n FROM i WHERE number_key IS NOT NULL GROUP BY ALL) WHERE n = 1 OR (spread_m <= 150 AND n_sector_codes <= 1)),
s2 AS (SELECT r.*, 'exact_street_number' AS geocode_method, 96.0 AS geocode_score, {PLACE} FROM r1 r JOIN k2 USING (cod_municipio, street_key, number_key)), r2 AS ({_sql_without("r1", "s2")}),
{_sql_fuzzy("r2", "s3", "r.number_key = i.number_key AND r.cep_key = i.cep_key", "r.cep_key IS NOT NULL", 78, 4, 94, 75, 0.20, "fuzzy_street_exact_number_cep")}, r3 AS ({_sql_without("r2", "s3")}),
{_sql_fuzzy("r3", "s4", "r.number_key = i.number_key", "true", 92, 5, 92, 70, 0.22, "fuzzy_street_exact_number")}, r4 AS ({_sql_without("r3", "s4")}),
k5 AS (SELECT *, (SELECT v FROM (SELECT unnest(ls) AS v) WHERE v IS NOT NULL GROUP BY v ORDER BY count(*) DESC, v LIMIT 1) AS label, (SELECT v FROM (SELECT unnest(ss) AS v) WHERE v IS NOT NULL GROUP BY v ORDER BY count(*) DESC, v LIMIT 1) AS sector_code,
    (SELECT v FROM (SELECT unnest(gs) AS v) WHERE v IS NOT NULL GROUP BY v ORDER BY count(*) DESC, v LIMIT 1) AS geo_level FROM (SELECT cod_municipio, street_key, cep_key, median(latitude) AS latitude, median(longitude) AS longitude, list(label) AS ls, list(sector_code) AS ss,
    list(geo_level) AS gs, count(DISTINCT sector_code) AS n_sector_codes, sum(n_records) AS n_records, {_sql_spread("latitude", "longitude")} AS spread_m FROM i WHERE cep_key IS NOT NULL GROUP BY ALL)),
s5 AS (SELECT r.*, 'street_cep_centroid' AS geocode_method, 70.0 AS geocode_score, {PLACE} FROM r4 r JOIN k5 USING (cod_municipio, street_key, cep_key)),
found AS (SELECT * FROM s1 UNION ALL SELECT * FROM s2 UNION ALL SELECT * FROM s3 UNION ALL SELECT * FROM s4 UNION ALL SELECT * FROM s5), lost AS ({_sql_without("todo", "found")}),
placed AS MATERIALIZED (SELECT {KEY}, geocode_method, CAST(geocode_score AS DOUBLE) AS geocode_score, round(latitude, 9) AS latitude, round(longitude, 9) AS longitude, label, sector_code, CAST(n_sector_codes AS BIGINT) AS n_sector_codes, CAST(geo_level AS INTEGER) AS geo_level,
    CAST(n_records AS BIGINT) AS n_records, round(spread_m, 2) AS spread_m FROM found
  UNION ALL SELECT {KEY}, 'unmatched', 0.0, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM lost),
units AS (SELECT u.*, p.* EXCLUDE (cod_municipio, street_key, number_key, cep_key), coalesce(latitude IS NOT NULL AND geocode_score >= 90, false) AS flag_geocode_high, coalesce(latitude IS NOT NULL AND geocode_score >= 80 AND geocode_score < 90, false) AS flag_geocode_medium,
    coalesce(latitude IS NOT NULL AND geocode_score < 80, false) AS flag_geocode_low FROM u JOIN placed p ON {" AND ".join(f"u.{k} IS NOT DISTINCT FROM p.{k}" for k in KEY.split(", "))})"""


def _geocoded(spark, sf_dir):
    """Every distinct address of the unit rows with its place: exact, fuzzy, then the centre of its street."""
    index = rounded(_index(spark, sf_dir), 7, {"spread_m": 4})
    return rounded(resolve.geocode(_unit_addresses(spark, sf_dir), index, street_centroid=True), 9, {"spread_m": 2})


def _placed_units(spark, sf_dir):
    """GEO-08: every unit row with its place and the flags of its confidence."""
    placed = quality.null_safe_join(_unit_addresses(spark, sf_dir), _geocoded(spark, sf_dir), ["cod_municipio", "street_key", "number_key", "cep_key"])
    return resolve.confidence_flags(placed)


@MARKET.query(f"{GEOCODED} SELECT * FROM placed")
def geocode_cascade(spark, sf_dir):
    return _geocoded(spark, sf_dir)


@MARKET.query(f"{GEOCODED} SELECT unit_row_id, carga_em, geocode_method, geocode_score, latitude, longitude, sector_code, flag_geocode_high, flag_geocode_medium, flag_geocode_low FROM units")
def geocode_units(spark, sf_dir):
    return _placed_units(spark, sf_dir).select(
        "unit_row_id", "carga_em", "geocode_method", "geocode_score", "latitude", "longitude", "sector_code", "flag_geocode_high", "flag_geocode_medium", "flag_geocode_low"
    )


@MARKET.query(f"""{GEOCODED}, g AS (SELECT cod_municipio, guide_group_id, count(*) AS n_units, count(*) FILTER (latitude IS NOT NULL) AS n_geocoded, round(median(latitude), 11) AS latitude, round(median(longitude), 11) AS longitude, count(DISTINCT sector_code) AS n_sectors,
    min(sector_code) AS sc, coalesce(string_agg(DISTINCT geocode_method, ' | ' ORDER BY geocode_method) FILTER (latitude IS NOT NULL), '') AS methods, min(geocode_score) FILTER (latitude IS NOT NULL) AS score_min, avg(geocode_score) FILTER (latitude IS NOT NULL) AS mean FROM units GROUP BY ALL)
SELECT g.* EXCLUDE (sc, mean), round(mean, 4) AS score_mean, CASE WHEN n_sectors = 1 THEN sc END AS sector_code, CASE WHEN n_geocoded = 0 THEN 'unmatched' WHEN n_geocoded = n_units AND score_min >= 90 AND n_sectors <= 1 THEN 'high'
  WHEN n_geocoded * 2 >= n_units AND mean >= 80 THEN 'medium' ELSE 'low' END AS geocode_quality, round(n_geocoded / n_units * 100, 6) AS pct_geocoded FROM g""")
def geocode_tx_quality(spark, sf_dir):
    return rounded(resolve.transaction_quality(_placed_units(spark, sf_dir), ["cod_municipio", "guide_group_id"]), 6, {"score_mean": 4, "latitude": 11, "longitude": 11})


@MARKET.query(f"""{GEOCODED} SELECT source_year, geocode_method, count(*) AS n_rows, round(avg(geocode_score), 4) AS mean_score, CAST(sum(count(*)) OVER (PARTITION BY source_year) AS BIGINT) AS year_rows,
  round(count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY source_year), 4) AS pct_of_year FROM units GROUP BY source_year, geocode_method""")
def geocode_summary(spark, sf_dir):
    return rounded(resolve.method_summary(_placed_units(spark, sf_dir)), 4)


@MARKET.query("""WITH s AS (SELECT s_suppkey, nullif(s_nationkey, 0) AS k FROM supplier), n AS (SELECT n_name, nullif(n_nationkey, 0) AS k FROM nation)
SELECT s.s_suppkey, CAST(s.k AS VARCHAR) AS k, n.n_name FROM s LEFT JOIN n ON s.k IS NOT DISTINCT FROM n.k""")
def null_safe_join(spark, sf_dir):
    """Null keys meet null keys: nation 0 counts as unknown on both sides."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.nullif("s_nationkey", F.lit(0)).alias("k"))
    n = table(spark, sf_dir, "nation").select("n_name", F.nullif("n_nationkey", F.lit(0)).alias("k"))
    return quality.null_safe_join(s, n, ["k"]).select("s_suppkey", F.col("k").cast("string").alias("k"), "n_name")


@MARKET.query(f"""WITH u AS (SELECT unit_row_id, load_id, cod_municipio, {_sql_street("logradouro")} AS street_key, {_sql_number("n_endereco")} AS number_key, {_sql_postal("cep")} AS cep_key FROM itbi_units)
SELECT u.*, g.n_records, g.sector_code FROM u LEFT JOIN ({INDEX}) g ON u.cod_municipio IS NOT DISTINCT FROM g.cod_municipio AND u.street_key IS NOT DISTINCT FROM g.street_key
  AND u.number_key IS NOT DISTINCT FROM g.number_key AND u.cep_key IS NOT DISTINCT FROM g.cep_key""")
def null_safe_units(spark, sf_dir):
    """JN-01, JN-02 over whole tables: every unit row with the index row of its address, null keys meeting null keys."""
    rows = table(spark, sf_dir, "itbi_units").select("unit_row_id", "load_id", "cod_municipio", "logradouro", "n_endereco", "cep")
    units = resolve.address_keys(rows, "logradouro", "n_endereco", "cep").select("unit_row_id", "load_id", "cod_municipio", "street_key", "number_key", "cep_key")
    index = _index(spark, sf_dir).select("cod_municipio", "street_key", "number_key", "cep_key", "n_records", "sector_code")
    return quality.null_safe_join(units, index, ["cod_municipio", "street_key", "number_key", "cep_key"])


RINGS = """v AS (SELECT DISTINCT cd_mun AS grp, cd_setor AS region, round(CAST(split_part(p, ' ', 1) AS DOUBLE), 7) AS x, round(CAST(split_part(p, ' ', 2) AS DOUBLE), 7) AS y
  FROM (SELECT cd_mun, cd_setor, unnest(regexp_extract_all(geometry_wkt, '-?[0-9.]+ -?[0-9.]+')) AS p FROM census_sectors)),
e AS (SELECT DISTINCT a.grp, a.region AS src, b.region AS dst FROM v a JOIN v b USING (grp, x, y) WHERE a.region <> b.region)"""
SECTOR_COUNTS = f"""{LATEST}, n AS (SELECT ano_analise, cod_municipio || sector_final_code AS region, count(*) AS c FROM latest WHERE flag_use_market_analysis AND sector_final_code IS NOT NULL AND ano_analise IS NOT NULL GROUP BY ALL),
dense AS (SELECT y.ano_analise, cd_mun AS grp, cd_setor AS region, ln(1 + coalesce(c, 0)) AS value, coalesce(c, 0) AS c FROM census_sectors CROSS JOIN (SELECT DISTINCT ano_analise FROM n) y
  LEFT JOIN n ON n.region = cd_setor AND n.ano_analise = y.ano_analise)"""
LISA = f"""WITH {RINGS}, {SECTOR_COUNTS}, z AS (SELECT ano_analise, grp, region, value - avg(value) OVER (PARTITION BY ano_analise, grp) AS z FROM dense WHERE region IN (SELECT src FROM e)),
l AS (SELECT z.ano_analise, z.grp, z.region, z.z, avg(o.z) AS lag_z FROM z JOIN e ON e.grp = z.grp AND e.src = z.region JOIN z o ON o.grp = z.grp AND o.region = e.dst AND o.ano_analise = z.ano_analise GROUP BY ALL)"""


def _mesh(spark, sf_dir):
    return spatialstats.queen_edges(spatialstats.vertices(table(spark, sf_dir, "census_sectors"), "cd_setor", "geometry_wkt", "cd_mun"))


def _sector_counts(spark, sf_dir):
    """Transactions per year and sector over the whole mesh, zeros included (the years are a calendar's few)."""
    rows = market(spark, sf_dir).where("sector_final_code is not null and ano_analise is not null")
    counts = rows.groupBy("ano_analise", F.concat("cod_municipio", "sector_final_code").alias("region")).agg(F.count(F.lit(1)).alias("c"))
    mesh = table(spark, sf_dir, "census_sectors").select(F.col("cd_mun").alias("group"), F.col("cd_setor").alias("region"))
    years = counts.agg(F.sort_array(F.collect_set("ano_analise")).alias("years"))
    dense = mesh.crossJoin(F.broadcast(years)).select("group", "region", F.explode("years").alias("ano_analise"))
    dense = dense.join(counts, ["ano_analise", "region"], "left").withColumn("c", F.coalesce("c", F.lit(0)))
    return dense.withColumn("value", F.log1p("c"))


RING_EDGES = """r AS (SELECT cd_mun AS grp, unnest(regexp_extract_all(geometry_wkt, '\\(([^()]+)\\)', 1)) AS ring, generate_subscripts(regexp_extract_all(geometry_wkt, '\\(([^()]+)\\)', 1), 1) AS k, cd_setor FROM census_sectors),
p AS (SELECT grp, cd_setor, k, unnest(string_split(ring, ', ')) AS t, generate_subscripts(string_split(ring, ', '), 1) AS i FROM r),
v AS (SELECT grp, cd_setor, k, i, round(CAST(split_part(t, ' ', 1) AS DOUBLE), 7) AS x, round(CAST(split_part(t, ' ', 2) AS DOUBLE), 7) AS y FROM p),
e AS (SELECT grp, x AS ax, y AS ay, lead(x) OVER w AS bx, lead(y) OVER w AS "by" FROM v WINDOW w AS (PARTITION BY grp, cd_setor, k ORDER BY i)),
o AS (SELECT grp, CASE WHEN ax > bx OR (ax = bx AND ay > "by") THEN [bx, "by", ax, ay] ELSE [ax, ay, bx, "by"] END AS q FROM e WHERE bx IS NOT NULL AND (ax <> bx OR ay <> "by"))"""


@MARKET.query(f'WITH {RING_EDGES} SELECT grp AS "group", q[1] AS ax, q[2] AS ay, q[3] AS bx, q[4] AS "by" FROM o GROUP BY ALL HAVING count(*) = 1')
def mesh_outline(spark, sf_dir):
    """The border of all sectors of a municipality together."""
    return spatialstats.outline(points.ring_edges(table(spark, sf_dir, "census_sectors"), "cd_setor", "geometry_wkt", "cd_mun"))


@MARKET.query(f"WITH {RINGS} SELECT grp AS \"group\", src, dst, round(1.0 / count(*) OVER (PARTITION BY grp, src), 6) AS w FROM e")
def queen_edges(spark, sf_dir):
    return rounded(_mesh(spark, sf_dir))


@MARKET.query(LISA + """ SELECT ano_analise, grp AS "group", count(*) AS n, round(sum(z * lag_z) / nullif(sum(z * z), 0), 6) AS moran_i, round(-1.0 / (count(*) - 1), 6) AS expected_i FROM l GROUP BY ALL""")
def moran_global_i(spark, sf_dir):
    local = spatialstats.moran_local(_sector_counts(spark, sf_dir), _mesh(spark, sf_dir), ["ano_analise"])
    return rounded(spatialstats.moran_global(local, ["ano_analise"]))


@MARKET.query(LISA + """ SELECT ano_analise, grp AS "group", region, round(z, 6) AS z, round(lag_z, 6) AS lag_z,
  round((count(*) OVER w - 1) * z * lag_z / nullif(sum(z * z) OVER w, 0), 6) AS local_i,
  CASE WHEN z > 0 AND lag_z > 0 THEN 1 WHEN z <= 0 AND lag_z > 0 THEN 2 WHEN z <= 0 AND lag_z <= 0 THEN 3 ELSE 4 END AS quadrant FROM l WINDOW w AS (PARTITION BY ano_analise, grp)""")
def lisa_quadrants(spark, sf_dir):
    return rounded(spatialstats.moran_local(_sector_counts(spark, sf_dir), _mesh(spark, sf_dir), ["ano_analise"]))


@MARKET.query()
def moran_pvalues(spark, sf_dir):
    return spatialstats.moran_permutations(_sector_counts(spark, sf_dir), _mesh(spark, sf_dir), ["ano_analise"])


VALUE_LISA = f"""WITH {RINGS}, {LATEST}, val AS (SELECT ano_analise, cod_municipio AS grp, cod_municipio || sector_final_code AS region, median(valor_m2_base_real) AS value FROM latest
  WHERE flag_use_spatial_analysis AND sector_final_code IS NOT NULL AND ano_analise IS NOT NULL GROUP BY ALL HAVING count(*) >= 5 AND median(valor_m2_base_real) IS NOT NULL),
p AS (SELECT a.ano_analise, a.grp, a.region, any_value(a.value) AS value, avg(b.value) AS lag FROM val a JOIN e ON e.grp = a.grp AND e.src = a.region JOIN val b ON b.grp = e.grp AND b.region = e.dst AND b.ano_analise = a.ano_analise GROUP BY ALL),
l AS (SELECT ano_analise, grp, region, value - avg(value) OVER w AS z, lag - avg(value) OVER w AS lag_z FROM p WINDOW w AS (PARTITION BY ano_analise, grp))"""


def _sector_values(spark, sf_dir):
    """Median price per m2 of the sectors with five transactions or more, by year."""
    rows = latest(spark, sf_dir).where(indicators.flagged("flag_use_spatial_analysis")).where("sector_final_code is not null and ano_analise is not null")
    rows = rows.withColumns({"group": F.col("cod_municipio"), "region": F.concat("cod_municipio", "sector_final_code")})
    metrics = indicators.market_metrics(rows, ["ano_analise", "group", "region"])
    return spatialstats.value_frame(metrics, "valor_m2_mediano_real", ["ano_analise"])


def _both_metrics(spark, sf_dir):
    volume = spatialstats.volume_frame(_sector_counts(spark, sf_dir), ["ano_analise"], "c").withColumn("metric", F.lit("log_transacoes"))
    return volume.unionByName(_sector_values(spark, sf_dir).withColumn("metric", F.lit("valor_m2_mediano_real")))


@MARKET.query(VALUE_LISA + """ SELECT ano_analise, grp AS "group", region, round(z, 6) AS z, round(lag_z, 6) AS lag_z,
  round((count(*) OVER w - 1) * z * lag_z / nullif(sum(z * z) OVER w, 0), 6) AS local_i,
  CASE WHEN z > 0 AND lag_z > 0 THEN 1 WHEN z <= 0 AND lag_z > 0 THEN 2 WHEN z <= 0 AND lag_z <= 0 THEN 3 ELSE 4 END AS quadrant FROM l WINDOW w AS (PARTITION BY ano_analise, grp)""")
def lisa_value_quadrants(spark, sf_dir):
    """The exact part of the value branch; ``lisa_clusters`` says which of them are significant."""
    return rounded(spatialstats.moran_local(_sector_values(spark, sf_dir), _mesh(spark, sf_dir), ["ano_analise"]))


@MARKET.query()
def moran_driver(spark, sf_dir):
    """Global statistic with p-value for value and volume, by year."""
    return spatialstats.moran_permutations(_both_metrics(spark, sf_dir), _mesh(spark, sf_dir), ["metric", "ano_analise"])


@MARKET.query()
def lisa_clusters(spark, sf_dir):
    """Local clusters for value and volume, by year, NS where not significant."""
    return spatialstats.moran_clusters(_both_metrics(spark, sf_dir), _mesh(spark, sf_dir), ["metric", "ano_analise"])


@MARKET.query(f"""WITH {SECTOR_COUNTS}, r AS (SELECT ano_analise, grp, region, CAST(c AS DOUBLE) AS v, count(*) OVER w AS n, sum(c) OVER w AS t, row_number() OVER (PARTITION BY ano_analise, grp ORDER BY c) AS r
  FROM dense WINDOW w AS (PARTITION BY ano_analise, grp))
SELECT ano_analise, grp AS "group", max(n) AS n_units, count(*) FILTER (v > 0) AS n_active, CAST(max(t) AS DOUBLE) AS total, round(sum((v / t) * (v / t)), 6) AS hhi, round(1 / sum((v / t) * (v / t)), 6) AS effective_units,
  round(2 * sum(r * v) / (max(n) * max(t)) - (max(n) + 1.0) / max(n), 6) AS gini, round(100 * sum(v / t) FILTER (n - r + 1 <= 10), 6) AS pct_top_10,
  round(100 * sum(v / t) FILTER (n - r + 1 <= greatest(1, ceil(n * 0.1))), 6) AS pct_top_10_percent FROM r GROUP BY ALL""")
def spatial_concentration(spark, sf_dir):
    return rounded(spatialstats.concentration(_sector_counts(spark, sf_dir), ["ano_analise", "group"], "c"))


@MARKET.query("""WITH p AS (SELECT cod_municipio, (longitude_ / 0.001) AS gx, latitude_ / (0.001 * sqrt(3.0)) AS gy FROM (
    SELECT cod_municipio, try_cast(replace(trim(latitude), ',', '.') AS DOUBLE) AS latitude_, try_cast(replace(trim(longitude), ',', '.') AS DOUBLE) AS longitude_ FROM address_register)
  WHERE latitude_ <> 0 AND longitude_ <> 0 AND NOT isnan(latitude_) AND NOT isnan(longitude_)),
c AS (SELECT cod_municipio, pow(gx - round(gx), 2) + 3 * pow(gy - round(gy), 2) < pow(gx - floor(gx) - 0.5, 2) + 3 * pow(gy - floor(gy) - 0.5, 2) AS a, gx, gy FROM p)
SELECT cod_municipio, round(CASE WHEN a THEN round(gx) ELSE floor(gx) + 0.5 END * 0.001, 6) AS hx, round(CASE WHEN a THEN round(gy) ELSE floor(gy) + 0.5 END * (0.001 * sqrt(3.0)), 6) AS hy, count(*) AS n FROM c GROUP BY ALL""")
def hexbin_density(spark, sf_dir):
    rows = table(spark, sf_dir, "address_register").select("cod_municipio", points.coordinate(F.col("latitude")).alias("lat"), points.coordinate(F.col("longitude")).alias("lon"))
    return rounded(spatialstats.hexbin(rows.where("lat is not null and lon is not null"), "lon", "lat", 0.001, ["cod_municipio"]))


_BAND = list(census.AGE_BANDS)
_MID = " + ".join(f"{b} * {m}" for b, (_, m) in census.AGE_BANDS.items())
_WIDE = {g: " + ".join(v) for g, v in census.GROUPED.items()}
_FAMILY = " + ".join(_BAND)


@MARKET.query(f"""WITH p AS (SELECT cd_setor, CASE WHEN v0001 NOT IN ('X', 'x', '') THEN try_cast(v0001 AS BIGINT) END AS n, area_km2 FROM census_sectors),
c AS (SELECT cd_setor, area_km2, n AS populacao_total, CAST(floor(n * 0.48) AS DOUBLE) AS men, n - CAST(floor(n * 0.48) AS DOUBLE) AS women,
  {", ".join(f"CAST(n * {i + 3} % 97 AS DOUBLE) AS {b}" for i, b in enumerate(_BAND))}, CAST(n % 50 AS DOUBLE) AS sd, 1500.0 + n AS mean FROM p),
g AS (SELECT *, {", ".join(f"{v} AS {g}" for g, v in _WIDE.items())}, {_FAMILY} AS family FROM c)
SELECT cd_setor, CAST(populacao_total AS DOUBLE) AS populacao_total, round(CASE WHEN populacao_total > 0 THEN 100 * men / populacao_total END, 6) AS pct_homens, round(CASE WHEN populacao_total > 0 THEN 100 * women / populacao_total END, 6) AS pct_mulheres,
  {", ".join(_BAND)}, {", ".join(_WIDE)}, {", ".join(f"round(CASE WHEN populacao_total > 0 THEN 100 * {g} / populacao_total END, 6) AS pct_{g}" for g in _WIDE)},
  CAST(CAST(CASE WHEN family > 0 THEN ({_MID}) / family END AS FLOAT) AS DOUBLE) AS idade_media_aprox, round(CASE WHEN pop_15_29 + pop_30_59 > 0 THEN 100 * (pop_0_14 + pop_60_mais) / (pop_15_29 + pop_30_59) END, 6) AS razao_dependencia_0_14_60mais,
  floor(populacao_total / 3.0) AS responsaveis_dom_permanentes_ocupados, CAST(populacao_total AS DOUBLE) AS moradores_dom_permanentes_ocupados, CASE WHEN populacao_total % 5 > 0 THEN sqrt(CAST(populacao_total % 5 AS DOUBLE)) WHEN populacao_total % 5 = 0 THEN 0.0 END AS dp_moradores_dom_permanentes,
  mean AS renda_media_responsavel_com_rendimento_rs, sd AS dp_renda_responsavel_rs, round(CASE WHEN mean > 0 THEN sd / mean END, 6) AS cv_renda_responsavel, round(CASE WHEN area_km2 > 0 THEN populacao_total / area_km2 END, 6) AS densidade_pop_km2,
  CAST(CASE WHEN populacao_total IS NOT NULL THEN 0 END AS DOUBLE) AS dif_pop_basico_demografia, false AS flag_pop_divergente FROM g""")
def census_profile(spark, sf_dir):
    """The sectors' own inhabitants and areas; the other variables, which the table lacks, are made from the inhabitants."""
    s = table(spark, sf_dir, "census_sectors").select("cd_setor", census.census_number(F.col("v0001")).alias("V0001"), F.col("area_km2").alias("AREA_KM2"))
    n = F.col("V0001")
    men = F.floor(n * 0.48)
    bands = [((n * (i + 3)) % 97).alias(code) for i, (code, _) in enumerate(census.AGE_BANDS.values())]
    demo = s.select("cd_setor", n.alias("V01006"), men.alias("V01007"), (n - men).alias("V01008"), *bands)
    income = s.select("cd_setor", F.floor(n / 3).alias("V06001"), n.alias("V06002"), (n % 5).alias("V06003"), (n + 1500).alias("V06004"), F.pow(n % 50, F.lit(2)).alias("V06005"))
    exact = {"dp_moradores_dom_permanentes": 15, "renda_media_responsavel_com_rendimento_rs": 6}
    return rounded(census.census_profile(s, demo, income, "cd_setor"), 6, exact)


@MARKET.query("SELECT 'v0001' AS \"column\", round(100.0 * count(*) FILTER (try_cast(v0001 AS DOUBLE) IS NULL) / count(*), 6) AS pct_missing FROM census_sectors")
def census_missing(spark, sf_dir):
    rows = table(spark, sf_dir, "census_sectors").select(census.census_number(F.col("v0001")).alias("v0001"))
    return rounded(census.missing_rates(rows, ["v0001"]))


@MARKET.query("SELECT strftime(ts, '%Y-%m') AS period, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def streaming_month_counts(spark, sf_dir):
    """The monthly counts by event type, in the form that also runs on a stream."""
    daily = monthly.monthly_counts(table(spark, sf_dir, "events"), "ts", "value", ["event_type"])
    return rounded(monthly.roll_up(daily, ["event_type"]), 4)
