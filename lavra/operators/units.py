"""The projection of unit rows, prices of single-unit guides, guides as transactions, and the summaries of both
(PRJ-01 .. PRJ-08, WIN-03, AGG-01, AGG-05, AGG-07)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lavra.contracts import require_columns
from lavra.functions.dates import parse_date
from lavra.functions.numbers import parse_number
from lavra.functions.stats import with_percentiles
from lavra.functions.text import UNIT_NULL_TOKENS, integerish, normalize_text, null_if_token, postal_code_padded, strip, text_key
from lavra.operators.guides import build_transactions, content_duplicates, infer_groups, outer_summary, reference_area

TEXTS = ("finalidade_construcao", "logradouro", "n_unidade", "complemento_endereco", "bairro", "n_matricula_reg_imoveis", "n_zona_reg_imoveis", "situacao")
NUMBERS = ("base_de_calculo", "perc_transmitido", "area_total_terreno", "area_constr_total", "area_constr_privativa", "ano_construcao")
DATES = ("data_estimativa", "data_pagamento")
#: What tells whether two unit rows say the same.
CONTENT = (*DATES, "base_de_calculo", "perc_transmitido", *TEXTS[1:2], "n_endereco", *TEXTS[2:5], "cep", *NUMBERS[2:], *TEXTS[5:])
FRONT = ("unit_row_id", "record_content_id", "source_file", "source_year", "source_row", "guide_group_id", "guide_seq", "guide_rows")


def _positive(c: str) -> Column:
    return F.coalesce((F.col(c) > 0) & ~F.isnan(F.col(c).cast("double")), F.lit(False))


def clean_units(df: DataFrame, as_of_year: int, scope: list[str] = []) -> DataFrame:
    """PRJ-01, PRJ-02, PRJ-04 .. PRJ-07: ``df`` with its columns cleaned and typed, keys, address texts, reference area
    and flags added; metadata columns first. No row goes.

    Texts and typed columns may both come in. ``<date>_raw`` is the date as written, and a flag tells that it could not be
    read. The cancelled flag is null where the status is, all others are never null. Rows that say the same within
    ``scope`` are ``flag_duplicado_exato``. Columns that ``df`` has beyond these are kept.
    """
    require_columns(df, [*TEXTS, *NUMBERS, *DATES, "n_endereco", "cep"], "unit rows")
    kinds = dict(df.dtypes)
    text = {c: normalize_text(F.col(c).cast("string")) for c in TEXTS}
    number = {c: parse_number(F.col(c)) if kinds[c] == "string" else F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in NUMBERS}
    raw = {c: strip(null_if_token(F.col(c).cast("string"), UNIT_NULL_TOKENS)) for c in DATES}
    date = {c: parse_date(F.col(c)) if kinds[c] == "string" else F.col(c) for c in DATES}
    rows = df.withColumns(
        {f"{c}_raw": v for c, v in raw.items()} | text | number | date | {"n_endereco": integerish(F.col("n_endereco").cast("string")), "cep": postal_code_padded(integerish(F.col("cep").cast("string")))}
    )
    rows = rows.withColumn("ano_construcao", F.bround("ano_construcao").cast("bigint")).withColumns({f"{c}_key": text_key(F.col(c)) for c in ("logradouro", "bairro", "situacao")})
    known = lambda c: F.coalesce(c, F.lit(""))
    full = F.concat(known("logradouro"), F.lit(", "), known("n_endereco"), known(F.concat(F.lit(" - "), "complemento_endereco")))
    rows = rows.withColumns({
        "endereco_full": F.btrim(F.regexp_replace(full, r"\s+", " "), F.lit(" ,-")),
        "endereco_match_key": F.concat_ws("|", known("logradouro_key"), known("n_endereco"), known("cep")),
        "area_referencia_unit_m2": reference_area("area_constr_privativa", "area_constr_total", "area_total_terreno"),
        **{f"flag_{c}_parse_error": F.col(f"{c}_raw").isNotNull() & F.col(c).isNull() for c in DATES},
    })
    percent, year = F.col("perc_transmitido"), F.col("ano_construcao")
    rows = rows.withColumns({
        "flag_pago": F.col("data_pagamento").isNotNull(), "flag_cancelado": F.col("situacao_key") == "CANCELADO",
        "flag_base_valida": _positive("base_de_calculo"), "flag_area_valida": _positive("area_referencia_unit_m2"),
        "flag_percentual_valido": percent.isNull() | ((percent > 0) & (percent <= 100)),
        "flag_ano_construcao_invalido": year.isNotNull() & ((year < 1700) | (year > as_of_year + 1)),
    })
    rows = content_duplicates(rows, list(CONTENT), scope)
    front = [c for c in FRONT if c in rows.columns]
    return rows.select(*front, *[c for c in rows.columns if c not in front])


def with_guides(units: DataFrame, scope: list[str], order: list[str]) -> DataFrame:
    """WIN-01 .. WIN-03: cleaned unit rows with their guide in the file, and the guide's base as the unit's price only where
    it has one unit, per m2 only where both are valid."""
    rows = infer_groups(units, scope, order, "base_de_calculo")
    single = F.col("guide_rows") == 1
    cancelled = F.coalesce("flag_cancelado", F.lit(False))
    sound = F.col("flag_area_valida") & F.col("flag_base_valida")
    return rows.withColumns({
        "base_de_calculo_unitaria": F.when(single, F.col("guide_base")),
        "valor_m2_base_unitario": F.when(single & sound, F.try_divide(F.col("guide_base"), F.col("area_referencia_unit_m2"))),
        "flag_preco_unitario_confiavel": single & F.col("flag_pago") & ~cancelled & sound,
    })


def unit_transactions(units: DataFrame, keys: list[str], order: str = "source_row") -> DataFrame:
    """AGG-01, PRJ-08: one row per guide: first known values, joined distinct texts, area decision, flags, and whether it is
    in the market sample (paid, not cancelled, with base and area, and no orphan)."""
    marked = units.withColumns({"_cancelled": F.coalesce("flag_cancelado", F.lit(False)), "_same": F.coalesce("flag_duplicado_exato", F.lit(False))})
    texts = ["finalidade_construcao", "logradouro", "n_endereco", "n_unidade", "complemento_endereco", "bairro", "cep", "n_matricula_reg_imoveis", "n_zona_reg_imoveis", "situacao"]
    firsts = [c for c in ("source_file", "source_year", "data_estimativa", "data_pagamento", "base_de_calculo", "perc_transmitido") if c in units.columns and c not in keys]
    flags = {"flag_group_orphan": F.bool_or("flag_group_orphan"), "flag_cancelado": F.bool_or("_cancelled"), "flag_duplicado_exato": F.bool_or("_same")}
    rows = build_transactions(marked, keys, order, texts=texts, firsts=firsts, more=flags)
    rows = rows.withColumns({c: F.nullif(F.col(c), F.lit("")) for c in texts})
    rows = rows.withColumns({"flag_area_referencia_completa": F.col("area_referencia_m2").isNotNull(), "flag_pago": F.col("data_pagamento").isNotNull()})
    sample = F.col("flag_pago") & ~F.col("flag_cancelado") & _positive("base_de_calculo") & _positive("area_referencia_m2") & ~F.col("flag_group_orphan")
    return rows.withColumn("flag_amostra_mercado", sample)


UNIT_COUNTS = {
    "exact_duplicate_rows": "flag_duplicado_exato", "paid_unit_rows": "flag_pago", "payment_date_parse_errors": "flag_data_pagamento_parse_error",
    "estimate_date_parse_errors": "flag_data_estimativa_parse_error", "valid_base_unit_rows": "flag_base_valida", "valid_area_unit_rows": "flag_area_valida",
    "single_unit_price_rows": "flag_preco_unitario_confiavel",
}
TX_COUNTS = {"paid_transactions": "flag_pago", "market_sample_transactions": "flag_amostra_mercado", "multiunit_transactions": "flag_multiunit", "orphan_transactions": "flag_group_orphan"}


def units_year_summary(units: DataFrame, transactions: DataFrame, year: str = "source_year") -> DataFrame:
    """AGG-05, JN-05: eleven measures of the unit rows and seven of the transactions by year, years of either side kept."""
    counts = {n: F.count_if(F.col(c)) for n, c in UNIT_COUNTS.items()}
    a = units.groupBy(year).agg(
        F.count(F.lit(1)).alias("unit_rows"), F.count_distinct("record_content_id").alias("unique_unit_content"),
        F.count("data_pagamento_raw").alias("payment_date_raw_rows"), F.count("data_estimativa_raw").alias("estimate_date_raw_rows"), *[v.alias(n) for n, v in counts.items()],
    )
    b = transactions.groupBy(year).agg(F.count(F.lit(1)).alias("transactions"), *[F.count_if(F.col(c)).alias(n) for n, c in TX_COUNTS.items()])
    b = with_percentiles(b, transactions, [year], {"median_base": (F.col("base_de_calculo"), 0.5), "median_base_m2": (F.col("valor_m2_base"), 0.5)})
    return outer_summary(a, b, [year])


def units_quality_summary(units: DataFrame, transactions: DataFrame) -> DataFrame:
    """AGG-07, AGG-23: one row of global counts of both tables."""
    n = lambda c: F.count_if(F.col(c)).alias
    a = units.agg(
        F.count(F.lit(1)).alias("units_rows"), n("flag_duplicado_exato")("units_exact_duplicate_rows"), n("flag_pago")("units_paid_rows"),
        F.count("data_pagamento_raw").alias("units_payment_date_raw_rows"), n("flag_data_pagamento_parse_error")("units_payment_date_parse_errors"),
        F.count("data_estimativa_raw").alias("units_estimate_date_raw_rows"), n("flag_data_estimativa_parse_error")("units_estimate_date_parse_errors"),
        n("flag_cancelado")("units_cancelled_rows"), n("flag_ano_construcao_invalido")("units_invalid_construction_year_rows"),
        F.count_if(F.col("guide_rows") > 1).alias("units_multiunit_rows"), n("flag_group_orphan")("units_orphan_group_rows"),
        n("flag_preco_unitario_confiavel")("units_reliable_single_unit_price_rows"),
    )
    b = transactions.agg(
        F.count(F.lit(1)).alias("transactions_rows"), n("flag_pago")("transactions_paid"), n("flag_cancelado")("transactions_cancelled"),
        n("flag_multiunit")("transactions_multiunit"), n("flag_group_orphan")("transactions_orphan"), n("flag_amostra_mercado")("transactions_market_sample"),
    )
    return a.crossJoin(F.broadcast(b))  # one row beside one row
