"""Census profile of areas from three wide tables (CEN-01, NUM-03 .. NUM-05, JN-06, AGG-17)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lavra.functions.numbers import complete_sum, guarded_sqrt, safe_ratio, to_double, weighted_midpoint_mean
from lavra.functions.text import CENSUS_NULL_TOKENS

# Variables of the age bands and the middle years of the bands; the open band counts as 75.
AGE_BANDS = {
    "pop_0_4": ("V01031", 2.0),
    "pop_5_9": ("V01032", 7.0),
    "pop_10_14": ("V01033", 12.0),
    "pop_15_19": ("V01034", 17.0),
    "pop_20_24": ("V01035", 22.0),
    "pop_25_29": ("V01036", 27.0),
    "pop_30_39": ("V01037", 34.5),
    "pop_40_49": ("V01038", 44.5),
    "pop_50_59": ("V01039", 54.5),
    "pop_60_69": ("V01040", 64.5),
    "pop_70_mais": ("V01041", 75.0),
}
BANDS = list(AGE_BANDS)
GROUPED = {"pop_0_14": BANDS[:3], "pop_15_29": BANDS[3:6], "pop_30_59": BANDS[6:9], "pop_60_mais": BANDS[9:]}


def census_number(c: Column) -> Column:
    """A published cell: suppression marks are null, never zero; a decimal comma is null."""
    text = F.trim(c.cast("string"))
    return F.when(~text.isin(*CENSUS_NULL_TOKENS), to_double(text))


def census_profile(basic: DataFrame, demography: DataFrame, income: DataFrame, key: str, area_km2: str = "AREA_KM2") -> DataFrame:
    """One row per area of ``basic`` (V0001), with demography (V01006 .. V01008, V01031 .. V01041) and income
    (V06001 .. V06005) of the same key where there are any.

    Percentages need a positive base; sums, the mean age and the dependency ratio need every band. Without an
    area column the density is null.
    """
    joined = basic.join(demography, key, "left").join(income, key, "left")
    v = lambda name: F.col(name).cast("double")
    band = {b: v(code) for b, (code, _) in AGE_BANDS.items()}
    people = F.coalesce(v("V01006"), v("V0001"))
    grouped = {g: complete_sum([band[b] for b in bands]) for g, bands in GROUPED.items()}
    working = complete_sum([band[b] for b in BANDS[3:9]])
    gap = v("V0001") - v("V01006")
    return joined.select(
        key,
        people.alias("populacao_total"),
        safe_ratio(v("V01007"), people, 100.0).alias("pct_homens"),
        safe_ratio(v("V01008"), people, 100.0).alias("pct_mulheres"),
        *[c.alias(b) for b, c in band.items()],
        *[c.alias(g) for g, c in grouped.items()],
        *[safe_ratio(c, people, 100.0).alias(f"pct_{g}") for g, c in grouped.items()],
        weighted_midpoint_mean(list(band.values()), [m for _, m in AGE_BANDS.values()]).alias("idade_media_aprox"),
        safe_ratio(grouped["pop_0_14"] + grouped["pop_60_mais"], working, 100.0).alias("razao_dependencia_0_14_60mais"),
        v("V06001").alias("responsaveis_dom_permanentes_ocupados"),
        v("V06002").alias("moradores_dom_permanentes_ocupados"),
        guarded_sqrt(v("V06003")).alias("dp_moradores_dom_permanentes"),
        v("V06004").alias("renda_media_responsavel_com_rendimento_rs"),
        guarded_sqrt(v("V06005")).alias("dp_renda_responsavel_rs"),
        safe_ratio(guarded_sqrt(v("V06005")), v("V06004")).alias("cv_renda_responsavel"),
        (safe_ratio(people, F.col(area_km2).cast("double")) if area_km2 in joined.columns else F.lit(None).cast("double")).alias("densidade_pop_km2"),
        gap.alias("dif_pop_basico_demografia"),
        F.coalesce(F.abs(gap) > 0, F.lit(False)).alias("flag_pop_divergente"),
    )


def missing_rates(df: DataFrame, columns: list[str]) -> DataFrame:
    """AGG-17: ``column, pct_missing``."""
    one = df.agg(*[(F.avg(F.col(c).isNull().cast("double")) * 100).alias(c) for c in columns])
    return one.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("pct_missing")) for c in columns])))


# Fixed value: the descriptive columns of an area, in their published order.
AREA_COLUMNS = (
    "CD_MUN", "NM_MUN", "CD_UF", "NM_UF", "CD_BAIRRO", "NM_BAIRRO", "SITUACAO", "CD_SITUACAO", "AREA_KM2", "CD_DIST", "NM_DIST", "CD_SUBDIST", "NM_SUBDIST",
)


def area_columns(df: DataFrame, key: str) -> list[str]:
    """PRJ-19: the key and those descriptive columns that the table has, in the published order."""
    return [c for c in dict.fromkeys([key, *AREA_COLUMNS]) if c in df.columns]


def definitions() -> dict[str, str]:
    """CEN-03: what the derived columns of ``census_profile`` are, for the metadata beside the table."""
    grouped = {g: f"sum of {', '.join(bands)}; null when a band is suppressed" for g, bands in GROUPED.items()}
    return grouped | {f"pct_{g}": f"{g} of populacao_total, per cent" for g in GROUPED} | {
        "idade_media_aprox": "mean of the bands' middle years, weighted by people; the open band counts as 75",
        "razao_dependencia_0_14_60mais": "people of 0-14 and 60 or more per hundred of 15-59",
        "densidade_pop_km2": "populacao_total per square kilometre",
        "cv_renda_responsavel": "standard deviation of income over its mean",
        "dif_pop_basico_demografia": "people of the basic table less those of demography",
    }
