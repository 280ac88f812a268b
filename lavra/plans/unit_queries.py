"""Queries of the unit rows of guides over the test tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lavra.operators import deflate, units
from lavra.plans.market_queries import AS_OF_YEAR, _sql_key, _sql_plain, rounded
from lavra.plans.registry import Registry, table

UNITS = Registry()

_T = ["finalidade_construcao", "logradouro", "n_unidade", "complemento_endereco", "bairro", "n_matricula_reg_imoveis", "n_zona_reg_imoveis", "situacao"]
_N = ["base_de_calculo", "perc_transmitido", "area_total_terreno", "area_constr_total", "area_constr_privativa"]
_REF = "CASE WHEN area_constr_privativa > 0 THEN area_constr_privativa WHEN area_constr_total > 0 THEN area_constr_total ELSE area_total_terreno END"
_CONTENT = ", ".join(units.CONTENT)

CLEAN = f"""WITH plain AS (SELECT unit_row_id, load_id, source_row, source_year, cod_municipio, carga_em, data_estimativa, data_pagamento, ano_construcao,
    {", ".join(f"{_sql_plain(c)} AS {c}" for c in _T)}, {", ".join(f"CASE WHEN NOT isnan({c}) THEN {c} END AS {c}" for c in _N)},
    regexp_replace({_sql_plain("n_endereco")}, '^(-?[0-9]+)\\.0+$', '\\1') AS n_endereco, regexp_replace(regexp_replace({_sql_plain("cep")}, '^(-?[0-9]+)\\.0+$', '\\1'), '\\D', '', 'g') AS z FROM itbi_units),
typed AS (SELECT * EXCLUDE (z), CASE WHEN length(z) <= 8 THEN lpad(z, 8, '0') END AS cep FROM plain),
keyed AS (SELECT *, {_sql_key("logradouro")} AS logradouro_key, {_sql_key("bairro")} AS bairro_key, {_sql_key("situacao")} AS situacao_key, {_REF} AS area_referencia_unit_m2 FROM typed),
clean AS (SELECT *, trim(regexp_replace(coalesce(logradouro, '') || ', ' || coalesce(n_endereco, '') || coalesce(' - ' || complemento_endereco, ''), '\\s+', ' ', 'g'), ' ,-') AS endereco_full,
  concat_ws('|', coalesce(logradouro_key, ''), coalesce(n_endereco, ''), coalesce(cep, '')) AS endereco_match_key, data_pagamento IS NOT NULL AS flag_pago, situacao_key = 'CANCELADO' AS flag_cancelado,
  coalesce(base_de_calculo > 0, false) AS flag_base_valida, coalesce(area_referencia_unit_m2 > 0, false) AS flag_area_valida, perc_transmitido IS NULL OR (perc_transmitido > 0 AND perc_transmitido <= 100) AS flag_percentual_valido,
  ano_construcao IS NOT NULL AND (ano_construcao < 1700 OR ano_construcao > {AS_OF_YEAR + 1}) AS flag_ano_construcao_invalido FROM keyed),
same AS (SELECT *, count(*) OVER (PARTITION BY {_CONTENT}) > 1 AS flag_duplicado_exato FROM clean)"""

#: Unit rows in their latest version, grouped into guides by their order in the load.
GUIDES = f"""{CLEAN}, newest AS (SELECT * FROM clean QUALIFY row_number() OVER (PARTITION BY unit_row_id ORDER BY carga_em DESC) = 1),
marked AS (SELECT *, count(*) OVER (PARTITION BY {_CONTENT}) > 1 AS flag_duplicado_exato, count(base_de_calculo) OVER f AS k, row_number() OVER f AS i FROM newest WINDOW f AS (PARTITION BY load_id ORDER BY source_row, unit_row_id)),
seq AS (SELECT *, CASE WHEN k = 0 THEN -i ELSE k END AS guide_seq, k = 0 AS flag_group_orphan FROM marked),
g AS (SELECT *, count(*) OVER w AS guide_rows, max(base_de_calculo) OVER w AS guide_base FROM seq WINDOW w AS (PARTITION BY load_id, guide_seq)),
guides AS (SELECT *, CASE WHEN guide_rows = 1 THEN guide_base END AS base_de_calculo_unitaria, CASE WHEN guide_rows = 1 AND flag_area_valida AND flag_base_valida THEN guide_base / area_referencia_unit_m2 END AS valor_m2_base_unitario,
  guide_rows = 1 AND flag_pago AND NOT coalesce(flag_cancelado, false) AND flag_area_valida AND flag_base_valida AS flag_preco_unitario_confiavel FROM g)"""


def _joined(c: str) -> str:
    """The distinct texts of a guide in the order in which they come first."""
    return f"(SELECT string_agg(v, ' | ' ORDER BY first_row) FROM (SELECT v, min(r) AS first_row FROM (SELECT unnest(vs).v AS v, unnest(vs).r AS r) WHERE v IS NOT NULL AND v <> '' GROUP BY v)) AS {c}"


_TX_TEXTS = ["finalidade_construcao", "logradouro", "n_endereco", "n_unidade", "complemento_endereco", "bairro", "cep", "n_matricula_reg_imoveis", "n_zona_reg_imoveis", "situacao"]
_FIRSTS = ["source_year", "data_estimativa", "data_pagamento", "base_de_calculo", "perc_transmitido"]
TX = f"""{GUIDES}, agg AS (SELECT load_id, guide_seq, count(*) AS n_units, min(source_row) AS source_row_start, max(source_row) AS source_row_end,
    {", ".join(f"arg_min({c}, source_row) FILTER ({c} IS NOT NULL) AS {c}" for c in _FIRSTS)},
    {", ".join(f"list(struct_pack(v := trim({c}), r := source_row)) AS l_{c}" for c in _TX_TEXTS)},
    sum(CASE WHEN area_constr_privativa > 0 THEN area_constr_privativa END) AS area_constr_privativa_soma_m2, count(*) FILTER (area_constr_privativa > 0) AS area_constr_privativa_n_validas,
    max(CASE WHEN area_constr_total > 0 THEN area_constr_total END) AS area_constr_total_max_m2, max(CASE WHEN area_total_terreno > 0 THEN area_total_terreno END) AS area_total_terreno_max_m2,
    bool_or(flag_group_orphan) AS flag_group_orphan, bool_or(coalesce(flag_cancelado, false)) AS flag_cancelado, bool_or(flag_duplicado_exato) AS flag_duplicado_exato FROM guides GROUP BY ALL),
told AS (SELECT * EXCLUDE ({", ".join(f"l_{c}" for c in _TX_TEXTS)}), {", ".join(_joined(c).replace("vs", f"l_{c}") for c in _TX_TEXTS)} FROM agg),
decided AS (SELECT *, CASE WHEN area_constr_privativa_n_validas = n_units THEN area_constr_privativa_soma_m2 WHEN n_units = 1 THEN coalesce(area_constr_total_max_m2, area_total_terreno_max_m2) END AS area_referencia_m2,
  CASE WHEN area_constr_privativa_n_validas = n_units THEN 'sum_area_constr_privativa' WHEN n_units = 1 AND area_constr_total_max_m2 IS NOT NULL THEN 'area_constr_total_single_unit'
    WHEN n_units = 1 AND area_total_terreno_max_m2 IS NOT NULL THEN 'area_total_terreno_single_unit' ELSE 'indeterminada_multiunit' END AS area_referencia_metodo FROM told),
tx AS (SELECT *, n_units > 1 AS flag_multiunit, CASE WHEN base_de_calculo > 0 THEN base_de_calculo / area_referencia_m2 END AS valor_m2_base, area_referencia_m2 IS NOT NULL AS flag_area_referencia_completa,
  data_pagamento IS NOT NULL AS flag_pago, data_pagamento IS NOT NULL AND NOT flag_cancelado AND coalesce(base_de_calculo > 0, false) AND coalesce(area_referencia_m2 > 0, false) AND NOT flag_group_orphan AS flag_amostra_mercado FROM decided)"""


def _clean(spark, sf_dir, newest: bool = False):
    rows = table(spark, sf_dir, "itbi_units")
    if newest:
        first = F.row_number().over(Window.partitionBy("unit_row_id").orderBy(F.col("carga_em").desc()))
        rows = rows.withColumn("_v", first).where("_v = 1").drop("_v")
    return units.clean_units(rows.drop("guide_group_id"), AS_OF_YEAR)


def _guides(spark, sf_dir):
    return units.with_guides(_clean(spark, sf_dir, newest=True), ["load_id"], ["source_row", "unit_row_id"])


def _transactions(spark, sf_dir):
    return units.unit_transactions(_guides(spark, sf_dir), ["load_id", "guide_seq"])


@UNITS.query(f"""{CLEAN} SELECT unit_row_id, carga_em, source_year, source_row, {", ".join(_T)}, n_endereco, cep, CAST(ano_construcao AS BIGINT) AS ano_construcao, logradouro_key, bairro_key, situacao_key, endereco_full, endereco_match_key,
  area_referencia_unit_m2, flag_pago, CAST(flag_cancelado AS VARCHAR) AS flag_cancelado, flag_base_valida, flag_area_valida, flag_percentual_valido, flag_ano_construcao_invalido, flag_duplicado_exato, false AS flag_data_pagamento_parse_error FROM same""")
def unit_projection(spark, sf_dir):
    """Every unit row, cleaned, with keys and flags."""
    return _clean(spark, sf_dir).select(
        "unit_row_id", "carga_em", "source_year", "source_row", *_T, "n_endereco", "cep", "ano_construcao", "logradouro_key", "bairro_key", "situacao_key", "endereco_full", "endereco_match_key",
        "area_referencia_unit_m2", "flag_pago", F.col("flag_cancelado").cast("string").alias("flag_cancelado"), "flag_base_valida", "flag_area_valida", "flag_percentual_valido", "flag_ano_construcao_invalido", "flag_duplicado_exato",
        "flag_data_pagamento_parse_error",
    )


@UNITS.query(f"""{GUIDES} SELECT unit_row_id, load_id, guide_seq, flag_group_orphan, guide_rows, guide_base, base_de_calculo_unitaria, round(valor_m2_base_unitario, 6) AS valor_m2_base_unitario, flag_preco_unitario_confiavel FROM guides""")
def unit_guides(spark, sf_dir):
    """Unit rows in their latest version with the guide that their order in the load gives, and single-unit prices."""
    rows = _guides(spark, sf_dir).select(
        "unit_row_id", "load_id", "guide_seq", "flag_group_orphan", "guide_rows", "guide_base", "base_de_calculo_unitaria", "valor_m2_base_unitario", "flag_preco_unitario_confiavel"
    )
    return rounded(rows)


@UNITS.query(f"""{TX} SELECT load_id, guide_seq, n_units, source_row_start, source_row_end, {", ".join(_FIRSTS)}, {", ".join(_TX_TEXTS)}, round(area_constr_privativa_soma_m2, 6) AS area_constr_privativa_soma_m2, area_constr_privativa_n_validas,
  area_constr_total_max_m2, area_total_terreno_max_m2, round(area_referencia_m2, 6) AS area_referencia_m2, area_referencia_metodo, round(valor_m2_base, 6) AS valor_m2_base, flag_area_referencia_completa, flag_multiunit, flag_group_orphan,
  flag_pago, flag_cancelado, flag_duplicado_exato, flag_amostra_mercado FROM tx""")
def unit_transactions(spark, sf_dir):
    """One row per guide."""
    return rounded(_transactions(spark, sf_dir))


@UNITS.query(f"""{TX}, a AS (SELECT source_year, count(*) AS unit_rows, count(DISTINCT ({_CONTENT})) AS unique_unit_content, count(data_pagamento) AS payment_date_raw_rows, count(data_estimativa) AS estimate_date_raw_rows,
    count(*) FILTER (flag_duplicado_exato) AS exact_duplicate_rows, count(*) FILTER (flag_pago) AS paid_unit_rows, 0::BIGINT AS payment_date_parse_errors, 0::BIGINT AS estimate_date_parse_errors, count(*) FILTER (flag_base_valida) AS valid_base_unit_rows,
    count(*) FILTER (flag_area_valida) AS valid_area_unit_rows, count(*) FILTER (flag_preco_unitario_confiavel) AS single_unit_price_rows FROM guides GROUP BY ALL),
b AS (SELECT source_year, count(*) AS transactions, count(*) FILTER (flag_pago) AS paid_transactions, count(*) FILTER (flag_amostra_mercado) AS market_sample_transactions, count(*) FILTER (flag_multiunit) AS multiunit_transactions,
    count(*) FILTER (flag_group_orphan) AS orphan_transactions, round(median(base_de_calculo), 6) AS median_base, round(median(valor_m2_base), 6) AS median_base_m2 FROM tx GROUP BY ALL)
SELECT * FROM a FULL JOIN b USING (source_year)""")
def units_year_summary(spark, sf_dir):
    return rounded(units.units_year_summary(_guides(spark, sf_dir), _transactions(spark, sf_dir)))


@UNITS.query(f"""{TX} SELECT count(*) AS units_rows, count(*) FILTER (flag_duplicado_exato) AS units_exact_duplicate_rows, count(*) FILTER (flag_pago) AS units_paid_rows, count(data_pagamento) AS units_payment_date_raw_rows,
  0::BIGINT AS units_payment_date_parse_errors, count(data_estimativa) AS units_estimate_date_raw_rows, 0::BIGINT AS units_estimate_date_parse_errors, count(*) FILTER (flag_cancelado) AS units_cancelled_rows,
  count(*) FILTER (flag_ano_construcao_invalido) AS units_invalid_construction_year_rows, count(*) FILTER (guide_rows > 1) AS units_multiunit_rows, count(*) FILTER (flag_group_orphan) AS units_orphan_group_rows,
  count(*) FILTER (flag_preco_unitario_confiavel) AS units_reliable_single_unit_price_rows, (SELECT count(*) FROM tx) AS transactions_rows, (SELECT count(*) FROM tx WHERE flag_pago) AS transactions_paid,
  (SELECT count(*) FROM tx WHERE flag_cancelado) AS transactions_cancelled, (SELECT count(*) FROM tx WHERE flag_multiunit) AS transactions_multiunit, (SELECT count(*) FROM tx WHERE flag_group_orphan) AS transactions_orphan,
  (SELECT count(*) FROM tx WHERE flag_amostra_mercado) AS transactions_market_sample FROM guides""")
def units_quality_summary(spark, sf_dir):
    return units.units_quality_summary(_guides(spark, sf_dir), _transactions(spark, sf_dir))


CPI = f"""{TX}, cpi AS (SELECT period, pct, exp(sum(ln(1 + pct / 100)) OVER (ORDER BY period)) AS level FROM (
    SELECT DISTINCT strftime(data_pagamento, '%Y-%m') AS period, ((year(data_pagamento) * 12 + month(data_pagamento)) % 7 - 2) / 10.0 AS pct FROM itbi_units WHERE data_pagamento IS NOT NULL)),
ref AS (SELECT level AS rl FROM cpi ORDER BY period DESC LIMIT 1),
dated AS (SELECT *, coalesce(data_pagamento, data_estimativa) AS day FROM tx),
real AS (SELECT d.*, rl / level AS f, level IS NOT NULL AS there, base_de_calculo * rl / level AS base_de_calculo_real, valor_m2_base * rl / level AS valor_m2_base_real FROM dated d LEFT JOIN cpi ON strftime(d.day, '%Y-%m') = period CROSS JOIN ref)"""


@UNITS.query(f"""{CPI} SELECT source_year, count(*) AS transactions, count(*) FILTER (flag_amostra_mercado) AS market_sample_transactions, count(*) FILTER (day IS NOT NULL) AS correction_date_available,
  count(*) FILTER (data_pagamento IS NULL AND data_estimativa IS NOT NULL) AS correction_date_fallback, count(*) FILTER (there) AS ipca_matched, count(base_de_calculo_real) AS base_real_calculated, count(valor_m2_base_real) AS value_m2_real_calculated,
  round(median(base_de_calculo), 4) AS median_base_nominal, round(median(base_de_calculo_real), 4) AS median_base_real, round(median(valor_m2_base), 4) AS median_value_m2_nominal, round(median(valor_m2_base_real), 4) AS median_value_m2_real,
  round(100.0 * count(*) FILTER (there) / count(*), 3) AS pct_ipca_matched FROM real GROUP BY ALL""")
def unit_deflation_summary(spark, sf_dir):
    """The eleven measures of deflated transactions by year; the index covers the months of payment only, so months of
    fallback dates may be missing in it."""
    months = table(spark, sf_dir, "itbi_units").where("data_pagamento is not null").select(F.date_format("data_pagamento", "yyyy-MM").alias("period")).distinct()
    pct = ((F.substring("period", 1, 4).cast("int") * 12 + F.substring("period", 6, 2).cast("int")) % 7 - 2) / F.lit(10.0)
    rows = deflate.pick_date(_transactions(spark, sf_dir), "data_pagamento", "data_estimativa", "data_correcao")
    rows = deflate.deflate(rows, deflate.chained_index(months.withColumn("pct", pct)), "data_correcao", ["base_de_calculo", "valor_m2_base"])
    return rounded(deflate.stage_summary(rows), 4)
