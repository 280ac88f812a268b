"""Quality control of transactions: structural flags, log-IQR fences, nested samples, summaries and column
profiles (PRJ-13, PRJ-14, STA-01 .. STA-03, AGG-06, AGG-07, AGG-19)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lavra.contracts import require_columns, require_range
from lavra.functions.stats import group_value_counts, percentiles_from_counts


def not_positive(c: str) -> Column:
    """Null, NaN, zero or below."""
    return ~F.coalesce((F.col(c) > 0) & ~F.isnan(F.col(c).cast("double")), F.lit(False))


def flag_or(df: DataFrame, name: str, default: bool = False) -> Column:
    """The flag with null as ``default``; ``default`` where the column is absent (PRJ-09)."""
    return F.coalesce(F.col(name), F.lit(default)) if name in df.columns else F.lit(default)


def structural_flags(df: DataFrame, positive: dict[str, str], percent: str | None = None, flags: dict[str, str] = {}, as_of_year: int | None = None) -> DataFrame:
    """Adds flags without dropping rows (PRJ-13): ``positive`` maps flag to a column that must be above zero,
    ``flags`` maps new names to inherited flags (default false); ``percent`` must be null or in (0, 100]."""
    added = {flag: not_positive(c) for flag, c in positive.items()}
    if percent:
        added["flag_percentual_invalido"] = F.coalesce(F.col(percent).isNotNull() & ~F.isnan(percent) & ((F.col(percent) <= 0) | (F.col(percent) > 100)), F.lit(False))
    added |= {new: flag_or(df, old) for new, old in flags.items()}
    if as_of_year is not None and "source_year" in df.columns:
        added["flag_ano_corrente_parcial"] = F.coalesce(F.col("source_year") == as_of_year, F.lit(False))
    return df.withColumns(added)


def usable(value: Column) -> Column:
    return F.coalesce((value > 0) & ~F.isnan(value) & (value < float("inf")), F.lit(False))


def log_iqr_thresholds(df: DataFrame, metrics: dict[str, str], groups: list[str], multiplier: float = 3.0, least: int = 50) -> DataFrame:
    """STA-02: one row per metric and group with its fences on the log scale, or why there are none.

    ``metrics`` maps metric name to column; only positive finite values count. Null group keys form a group.
    """
    require_columns(df, [*groups, *metrics.values()])
    require_range("multiplier", multiplier, low=0, open_ends=True)
    require_range("least", least, low=1)
    logs = {m: F.when(usable(F.col(c).cast("double")), F.ln(F.col(c).cast("double"))) for m, c in metrics.items()}
    found = percentiles_from_counts(group_value_counts(df, groups, logs), groups, {m: [0.25, 0.75] for m in metrics})
    at = lambda q: F.max(F.when(F.col("fraction") == F.lit(q), F.col("percentile")))
    fitted = found.groupBy(F.col("column_name").alias("metric"), *groups).agg(F.max("n_values").alias("n"), F.array(at(0.25), at(0.75)).alias("_q"))
    fitted = fitted.withColumn("value_column", F.coalesce(*[F.when(F.col("metric") == m, F.lit(c)) for m, c in metrics.items()]))
    iqr = F.col("_q")[1] - F.col("_q")[0]
    reason = F.when(F.col("n") < least, "group_too_small").when(~(iqr > 0), "non_positive_iqr")
    fitted = fitted.withColumns({"reason_not_applied": reason, "applied": reason.isNull(), "iqr_log": F.when(reason.isNull(), iqr)})
    kept = F.col("applied")
    return fitted.select(
        "metric", "value_column", *groups, "n", "applied", "reason_not_applied",
        F.when(kept, F.col("_q")[0]).alias("q1_log"), F.when(kept, F.col("_q")[1]).alias("q3_log"), "iqr_log",
        F.when(kept, F.exp(F.col("_q")[0] - multiplier * F.col("iqr_log"))).alias("lower_bound"),
        F.when(kept, F.exp(F.col("_q")[1] + multiplier * F.col("iqr_log"))).alias("upper_bound"),
    )


def log_iqr_flags(df: DataFrame, thresholds: DataFrame, metrics: dict[str, str], groups: list[str]) -> DataFrame:
    """STA-01, STA-03: adds ``flag_outlier_<metric>`` and ``flag_outlier_estatistico``. One join for all
    metrics: the fences of a group are one row of a small table."""
    fences = thresholds.groupBy(*[F.col(g).alias(f"_{g}") for g in groups]).agg(
        F.map_from_entries(F.collect_list(F.when(F.col("applied"), F.struct("metric", F.struct("lower_bound", "upper_bound"))))).alias("_f")
    )
    on = F.lit(True)
    for g in groups:
        on = on & df[g].eqNullSafe(fences[f"_{g}"])
    joined = df.join(fences, on, "left")

    def outside(metric: str, c: str) -> Column:
        fence = F.try_element_at("_f", F.lit(metric))
        value = F.col(c).cast("double")
        return F.coalesce(usable(value) & ((value < fence["lower_bound"]) | (value > fence["upper_bound"])), F.lit(False))

    flags = {f"flag_outlier_{m}": outside(m, c) for m, c in metrics.items()}
    joined = joined.withColumns(flags)
    some = F.lit(False)
    for f in flags:
        some = some | F.col(f)
    return joined.withColumn("flag_outlier_estatistico", some).select(*df.columns, *flags, "flag_outlier_estatistico")


def nested_samples(df: DataFrame, invalid: list[str]) -> DataFrame:
    """PRJ-14: market sample, then spatial, socioeconomic and preliminary model samples, each within the last."""
    flag = lambda c, default=False: flag_or(df, c, default)
    broken = flag("flag_cancelado_qc") | flag("flag_duplicado_qc") | flag("flag_outlier_estatistico") | ~flag("flag_ipca_disponivel_qc", True)
    for c in invalid:
        broken = broken | flag(c)
    market = flag("flag_amostra_mercado_origem") & ~broken
    spatial = market & flag("flag_geocode_utilizavel") & ~flag("flag_setor_espacial_ausente")
    social = spatial & flag("flag_census_matched")
    return df.withColumns({
        "flag_use_market_analysis": market, "flag_use_spatial_analysis": spatial, "flag_use_socioeconomic_analysis": social,
        "flag_use_model_preliminar": social & ~flag("flag_multiunit_qc"),
    })


def flag_summary(df: DataFrame, keys: list[str], flags: dict[str, str], percents: list[str] = []) -> DataFrame:
    """AGG-19: rows and true flags per group; ``pct_<name>`` of the rows, rounded to three places."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("transactions"), *[F.count_if(F.col(c)).alias(n) for n, c in flags.items()])
    return counts.withColumns({f"pct_{n}": F.round(F.try_divide(F.col(n) * 100.0, F.col("transactions").cast("double")), 3) for n in percents})


#: Counts of the yearly quality summary by the flag they count, and those of which shares are given.
QC_COUNTS = {
    "market_origin": "flag_amostra_mercado_origem", "census_matched": "flag_census_matched", "geocode_usable": "flag_geocode_utilizavel", "invalid_base_real": "flag_base_real_invalida",
    "invalid_area": "flag_area_invalida", "invalid_value_m2_real": "flag_valor_m2_real_invalido", "exact_duplicates": "flag_duplicado_qc", "multiunit": "flag_multiunit_qc",
    "outlier_base_real": "flag_outlier_base_real", "outlier_value_m2_real": "flag_outlier_valor_m2_real", "outlier_area": "flag_outlier_area", "outlier_any": "flag_outlier_estatistico",
    "use_market": "flag_use_market_analysis", "use_spatial": "flag_use_spatial_analysis", "use_socioeconomic": "flag_use_socioeconomic_analysis", "use_model_preliminary": "flag_use_model_preliminar",
}
QC_SHARES = ["market_origin", "census_matched", "geocode_usable", "outlier_any", "use_market", "use_spatial", "use_socioeconomic", "use_model_preliminary"]


def qc_year_summary(df: DataFrame, year: str = "source_year") -> DataFrame:
    """AGG-19 in full: seventeen counts and eight shares per year."""
    return flag_summary(df, [year], QC_COUNTS, QC_SHARES)


def qc_metadata(df: DataFrame) -> DataFrame:
    """AGG-23: one row of the same counts over the whole table, a flag that it lacks counted as never true."""
    return df.agg(F.count(F.lit(1)).alias("transactions"), *[F.count_if(flag_or(df, c)).alias(n) for n, c in QC_COUNTS.items()])


def column_profile(df: DataFrame) -> DataFrame:
    """AGG-06: one row per column: rows, nulls, distinct values; true and false of booleans; range, quartiles and
    mean of numbers. NaN counts as null.

    Everything comes from one table of value counts, so that no task holds a column.
    """
    numeric = {c for c, k in df.dtypes if k in ("tinyint", "smallint", "int", "bigint", "float", "double") or k.startswith("decimal")}

    def cell(c: str) -> Column:
        number = F.col(f"`{c}`").cast("double") if c in numeric else F.lit(None).cast("double")
        text = F.lit(None).cast("string") if c in numeric else F.col(f"`{c}`").cast("string")
        return F.struct(F.lit(c).alias("column"), F.when(~F.isnan(number), number + 0.0).alias("value"), text.alias("text"))

    counts = df.select(F.inline(F.array(*[cell(c) for c in df.columns]))).groupBy("column", "value", "text").agg(F.count(F.lit(1)).alias("n"))
    given = F.when(F.col("value").isNotNull() | F.col("text").isNotNull(), F.col("n"))
    times = lambda word: F.coalesce(F.sum(F.when(F.col("text") == word, F.col("n"))), F.lit(0))
    kinds = dict(df.dtypes)
    kind = F.coalesce(*[F.when(F.col("column") == c, F.lit(k)) for c, k in kinds.items()])
    whole = counts.groupBy("column").agg(
        F.sum("n").alias("n_rows"), (F.sum("n") - F.coalesce(F.sum(given), F.lit(0))).alias("n_null"), F.count(given).alias("n_unique"),
        times("true").alias("_t"), times("false").alias("_f"),
        F.min("value").alias("min"), F.max("value").alias("max"), (F.sum(F.col("value") * F.col("n")) / F.sum(F.when(F.col("value").isNotNull(), F.col("n")))).alias("mean"),
    )
    quarters = percentiles_from_counts(
        counts.where("value is not null").select(F.col("column").alias("column_name"), "value", "n"), [], {c: [0.25, 0.5, 0.75] for c in numeric}
    ) if numeric else None
    if quarters is not None:
        at = {name: F.max(F.when(F.col("fraction") == F.lit(q), F.col("percentile"))).alias(name) for name, q in (("p25", 0.25), ("median", 0.5), ("p75", 0.75))}
        whole = whole.join(quarters.groupBy(F.col("column_name").alias("column")).agg(*at.values()), "column", "left")
    else:
        whole = whole.withColumns({q: F.lit(None).cast("double") for q in ("p25", "median", "p75")})
    boolean = F.col("dtype") == "boolean"
    return whole.withColumn("dtype", kind).select(
        "column", "dtype", "n_rows", "n_null", F.round(F.try_divide(F.col("n_null") * 100.0, F.col("n_rows").cast("double")), 3).alias("pct_null"), "n_unique",
        F.when(boolean, F.col("_t")).alias("n_true"), F.when(boolean, F.col("_f")).alias("n_false"), "min", "p25", "median", "mean", "p75", "max",
    )


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """WIN-09: the first row per keys in the given order; null keys are a group."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_nth", F.row_number().over(w)).where("_nth = 1").drop("_nth")


def enrich(df: DataFrame, reference: DataFrame, key: str, reference_key: str, flag: str) -> DataFrame:
    """JN-08: left join to a table of unique keys, null keys equal; ``flag`` tells whether the key was there.
    Columns of the reference that the table already has get the suffix ``_ref``."""
    ref = reference.withColumnsRenamed({c: f"{c}_ref" for c in reference.columns if c in df.columns and c != reference_key})
    ref = ref.withColumnRenamed(reference_key, "_key").withColumn("_there", F.lit(True))
    joined = df.join(ref, F.col(key).eqNullSafe(F.col("_key")), "left")
    return joined.withColumn(flag, F.coalesce("_there", F.lit(False))).drop("_key", "_there")


def null_safe_join(a: DataFrame, b: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """JN-01, JN-02: join in which null keys meet null keys; the keys come once."""
    other = b.withColumnsRenamed({k: f"_{k}" for k in keys})
    on = F.lit(True)
    for k in keys:
        on = on & a[k].eqNullSafe(other[f"_{k}"])
    joined = a.join(other, on, how)
    if how in ("full", "outer", "right"):
        joined = joined.withColumns({k: F.coalesce(k, f"_{k}") for k in keys})
    return joined.drop(*[f"_{k}" for k in keys])
