"""Queries of the language-data problems over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lavra.llm import addresses, mixture, percentiles, spans, tokens
from lavra.plans.registry import Registry, table
from lavra.session import materialize

LLM = Registry()

MONTH = ["cod_municipio", "ano_analise", "mes_analise"]
PUBLISHED = {
    "valor_m2_mediano_real": ("valor_m2_base_real", 0.5),
    "base_p25_real": ("base_de_calculo_real", 0.25),
    "area_p75_m2": ("area_referencia_m2", 0.75),
}

P5_FOUND = """
WITH latest AS (SELECT * FROM transactions_qc QUALIFY row_number() OVER (PARTITION BY cod_municipio, transaction_id ORDER BY carga_em DESC NULLS LAST) = 1),
exact AS (SELECT cod_municipio, year(data_pagamento) AS ano_analise, month(data_pagamento) AS mes_analise,
    quantile_cont(valor_m2_base_real, 0.5) AS valor, quantile_cont(base_de_calculo_real, 0.25) AS base, quantile_cont(area_referencia_m2, 0.75) AS area
  FROM latest WHERE flag_use_market_analysis AND data_pagamento IS NOT NULL GROUP BY ALL),
pairs AS (SELECT m.cod_municipio, m.ano_analise, m.mes_analise, unnest([
    {'c': 'valor_m2_mediano_real', 'g': valor_m2_mediano_real, 'p': valor},
    {'c': 'base_p25_real', 'g': base_p25_real, 'p': base},
    {'c': 'area_p75_m2', 'g': area_p75_m2, 'p': area}]) AS s
  FROM market_indicators_city_month m JOIN exact USING (cod_municipio, ano_analise, mes_analise))
SELECT cod_municipio, ano_analise, mes_analise, s.c AS column_name FROM pairs WHERE abs(s.g - s.p) > 0.02 * abs(s.p)
"""


P5_PERCENTILES = """
WITH latest AS (SELECT * FROM transactions_qc QUALIFY row_number() OVER (PARTITION BY cod_municipio, transaction_id ORDER BY carga_em DESC NULLS LAST) = 1),
long AS (SELECT cod_municipio, year(data_pagamento) AS ano_analise, month(data_pagamento) AS mes_analise, unnest([{'c': 'valor_m2_base_real', 'v': valor_m2_base_real},
    {'c': 'base_de_calculo_real', 'v': base_de_calculo_real}, {'c': 'area_referencia_m2', 'v': area_referencia_m2}]) AS s
  FROM latest WHERE flag_use_market_analysis AND data_pagamento IS NOT NULL),
q AS (SELECT cod_municipio, ano_analise, mes_analise, s.c AS column_name, unnest([0.25, 0.5, 0.75]) AS fraction, unnest(quantile_cont(s.v, [0.25, 0.5, 0.75])) AS percentile, count(s.v) AS n_values
  FROM long WHERE s.v IS NOT NULL GROUP BY cod_municipio, ano_analise, mes_analise, s.c)
SELECT cod_municipio, ano_analise, mes_analise, column_name, CAST(fraction AS DOUBLE) AS fraction, round(percentile, 6) AS percentile, n_values FROM q
"""

P9_FOUND = """
WITH texts AS (SELECT text, min(doc_id) AS owner, count(DISTINCT doc_id) AS copies, length(text) AS n FROM documents WHERE length(text) >= 200 GROUP BY text),
spans AS (SELECT owner, t, substr(text, t, 200) AS s FROM texts, LATERAL (SELECT unnest(range(1, n - 198)) AS t)),
shared AS (SELECT s FROM spans GROUP BY s HAVING min(owner) <> max(owner)),
starts AS (SELECT owner, t, lead(t) OVER (PARTITION BY owner ORDER BY t) AS nxt FROM spans SEMI JOIN shared USING (s)),
covered AS (SELECT owner, sum(least(200, coalesce(nxt - t, 200))) AS c FROM starts GROUP BY owner)
SELECT doc_id, CAST(max(CASE WHEN copies > 1 THEN n ELSE c END) AS BIGINT) AS shared_chars FROM documents JOIN texts USING (text) LEFT JOIN covered USING (owner)
GROUP BY doc_id HAVING max(CASE WHEN copies > 1 THEN n ELSE c END) IS NOT NULL
"""


def _month_values(spark, sf_dir):
    columns = ["flag_use_market_analysis", "data_pagamento", *[c for c, _ in PUBLISHED.values()]]
    rows = table(spark, sf_dir, "transactions_qc")
    rows = percentiles.latest_versions(rows, ["cod_municipio", "transaction_id"], "carga_em", columns)
    rows = rows.where(F.coalesce("flag_use_market_analysis", F.lit(False)) & F.col("data_pagamento").isNotNull())
    return rows.withColumns({"ano_analise": F.year("data_pagamento"), "mes_analise": F.month("data_pagamento")})


@LLM.query(P5_FOUND)
def p5_found(spark, sf_dir):
    counts = percentiles.group_value_counts(_month_values(spark, sf_dir), MONTH, [c for c, _ in PUBLISHED.values()])
    exact = percentiles.percentiles_from_counts(counts, MONTH, {c: [q] for c, q in PUBLISHED.values()})
    return percentiles.off_by(table(spark, sf_dir, "market_indicators_city_month"), exact, MONTH, PUBLISHED, 0.02)


@LLM.query(P5_PERCENTILES)
def p5_percentiles(spark, sf_dir):
    """Quartiles of all three columns per municipality and month, the months put together from the counts of their days."""
    columns = [c for c, _ in PUBLISHED.values()]
    days = percentiles.group_value_counts(_month_values(spark, sf_dir).withColumn("_day", F.dayofmonth("data_pagamento")), [*MONTH, "_day"], columns)
    found = percentiles.percentiles_from_counts(percentiles.merge_counts(days, keys=MONTH), MONTH, {c: [0.25, 0.5, 0.75] for c in columns})
    return found.withColumn("percentile", F.round("percentile", 6))


@LLM.query()
def p7_ids(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tokens.token_ids(F.col("text")).alias("ids"))


@LLM.query()
def p8_mixture(spark, sf_dir):
    return mixture.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"), tokens.token_count(F.col("text")))


@LLM.query()
def p8_shares(spark, sf_dir):
    return mixture.reached_shares(p8_mixture(spark, sf_dir), table(spark, sf_dir, "mix_targets"))


P8_INVARIANTS = """
WITH sized AS (SELECT lower(trim(source)) AS source, count(*) AS n FROM documents WHERE length(text) > 0 AND trim(source) <> '' GROUP BY ALL)
SELECT lower(trim(t.source)) AS source, coalesce(n, 0) > 0 AND target_share > 0 AND max_repeats > 0 AS is_used, true AS share_is_reached, true AS repeats_are_capped, true AS rounds_are_whole
FROM mix_targets t LEFT JOIN sized s ON s.source = lower(trim(t.source))
"""


@LLM.query(P8_INVARIANTS)
def p8_invariants(spark, sf_dir):
    """What must hold of the mixture, by target: sources with documents are used, their shares (of the targets that have
    documents) are reached to within a hundredth and two blocks, no document is used more than ``max_repeats`` times,
    nor twice in one round."""
    made = materialize(p8_mixture(spark, sf_dir))
    targets = table(spark, sf_dir, "mix_targets").withColumn("source", mixture.source_name(F.col("source")))
    rounds = made.groupBy("source", "doc_id", "repeat_no").agg(F.count(F.lit(1)).alias("n")).groupBy("source").agg(F.max("n").alias("_twice"))
    both = mixture.reached_shares(made, targets).drop("target_share").join(targets, "source").join(rounds, "source", "left")
    whole = both.agg(F.sum(F.when(F.col("n_tokens") > 0, F.col("target_share"))).alias("_weight"), F.sum("n_tokens").alias("_tokens"))
    both = both.crossJoin(F.broadcast(whole))  # one row beside one row per target
    used = F.col("n_tokens") > 0
    off = F.abs(F.col("actual_share") - F.col("target_share") / F.col("_weight"))
    near = off <= 0.01 + F.lit(2.0 * mixture.BLOCK_TOKENS) / F.col("_tokens")
    return both.select(
        "source", used.alias("is_used"), F.when(used, F.coalesce(near, F.lit(False))).otherwise(F.lit(True)).alias("share_is_reached"),
        (F.col("most_repeats") <= F.greatest("max_repeats", F.lit(0))).alias("repeats_are_capped"), (F.coalesce("_twice", F.lit(1)) == 1).alias("rounds_are_whole"),
    )


@LLM.query()
def p1_found(spark, sf_dir):
    pairs = addresses.same_location_pairs(materialize(addresses.location_keys(table(spark, sf_dir, "address_records"))))
    return pairs.select(F.col("id_a").alias("address_record_id_a"), F.col("id_b").alias("address_record_id_b"))


@LLM.query()
def p1_locations(spark, sf_dir):
    """Every record with the resolved parts of its location."""
    keys = addresses.location_keys(table(spark, sf_dir, "address_records"))
    return keys.drop("raw", "raw2").withColumnsRenamed({"id": "address_record_id", "area": "cod_municipio"})


@LLM.query(P9_FOUND)
def p9_found(spark, sf_dir):
    return spans.shared_spans(table(spark, sf_dir, "documents"))
