"""Address register index and the geocoding cascade, exact then fuzzy (AGG-08 .. AGG-13, GEO-00 .. GEO-09)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lavra.functions.similarity import indel_ratio
from lavra.functions.text import code_digits, normalize_text, number_key, postal_code_cut, street_key
from lavra.operators.points import coordinate, haversine_m
from lavra.session import materialize

# Fixed value: the sphere of the register's spread figures.
SPREAD_RADIUS_M = 6_371_008.8
PLACE = ["latitude", "longitude", "label", "sector_code", "n_sector_codes", "geo_level", "n_records", "spread_m"]


def spread_m(lat: str = "lat", lon: str = "lon") -> Column:
    """AGG-10: the diagonal of a group's bounding box; null if any coordinate is null. An aggregate."""
    whole = (F.count(lat) == F.count(F.lit(1))) & (F.count(lon) == F.count(F.lit(1)))
    return F.when(whole, haversine_m(F.min(lat), F.min(lon), F.max(lat), F.max(lon), SPREAD_RADIUS_M))


def address_keys(df: DataFrame, street: str, number: str, postal: str) -> DataFrame:
    """Adds ``street_key, number_key, cep_key`` (GEO-00)."""
    return df.withColumns({"street_key": street_key(F.col(street)), "number_key": number_key(F.col(number)), "cep_key": postal_code_cut(F.col(postal))})


def build_address_index(register: DataFrame, area: str = "cod_municipio") -> DataFrame:
    """AGG-08: one row per area, street, number and postal code: median coordinates, modal label, sector and
    level (the smallest of equals), how many records and sectors, and how far they spread."""
    label = F.concat_ws(" ", *[normalize_text(F.col(c)) for c in ("nom_tipo_seglogr", "nom_titulo_seglogr", "nom_seglogr")])
    rows = register.select(
        area, F.nullif(label, F.lit("")).alias("label"), "num_endereco", "cep", code_digits(F.col("cod_setor")).alias("sector"),
        F.col("nv_geo_coord").alias("level"), coordinate(F.col("latitude")).alias("lat"), coordinate(F.col("longitude")).alias("lon"),
    )
    rows = rows.where(F.col("lat").between(-90, 90) & F.col("lon").between(-180, 180))
    rows = address_keys(rows, "label", "num_endereco", "cep").where("street_key is not null")
    return rows.groupBy(area, "street_key", "number_key", "cep_key").agg(
        F.mode("label", True).alias("label"), F.median("lat").alias("latitude"), F.median("lon").alias("longitude"), F.mode("sector", True).alias("sector_code"),
        F.count_distinct("sector").alias("n_sector_codes"), F.mode("level", True).alias("geo_level"), F.count(F.lit(1)).alias("n_records"), spread_m().alias("spread_m"),
    )


def consolidated(index: DataFrame, area: str = "cod_municipio", max_spread_m: float = 150.0) -> DataFrame:
    """AGG-11: street and number without the postal code, where its records lie together in one sector at most."""
    box = spread_m("latitude", "longitude")
    rows = index.where("number_key is not null").groupBy(area, "street_key", "number_key").agg(
        F.median("latitude").alias("latitude"), F.median("longitude").alias("longitude"), F.min_by("label", "cep_key").alias("label"),
        F.min("sector_code").alias("sector_code"), F.count_distinct("sector_code").alias("n_sector_codes"), F.min_by("geo_level", "cep_key").alias("geo_level"),
        F.sum("n_records").alias("n_records"), box.alias("spread_m"), F.count(F.lit(1)).alias("_n"),
    )
    return rows.where((F.col("_n") == 1) | ((F.col("spread_m") <= max_spread_m) & (F.col("n_sector_codes") <= 1))).drop("_n")


def best_with_margin(pairs: DataFrame, keys: list[str], score: str, threshold: float, margin: float) -> DataFrame:
    """GEO-07: per key the candidate of best score if it reaches the threshold and leads the next by the margin;
    a lone candidate needs no margin. A window over the candidates of one key; hot keys are capped by the caller."""
    w = Window.partitionBy(*keys).orderBy(F.col(score).desc(), "street_key_c", "cep_key_c")
    ranked = pairs.withColumns({"_r": F.row_number().over(w), "_next": F.lead(score).over(w)})
    lead = F.col("_next").isNull() | (F.col(score) - F.col("_next") >= margin)
    return ranked.where((F.col("_r") == 1) & (F.col(score) >= threshold) & lead).drop("_r", "_next")


def skipped_blocks(index: DataFrame, block_cap: int, area: str = "cod_municipio") -> DataFrame:
    """``area, number_key, n_rows``: the blocks that ``geocode`` with that cap does not search by number alone."""
    return index.where("number_key is not null").groupBy(area, "number_key").agg(F.count(F.lit(1)).alias("n_rows")).where(F.col("n_rows") > block_cap)


def geocode(addresses: DataFrame, index: DataFrame, area: str = "cod_municipio", block_cap: int | None = None, street_centroid: bool = False) -> DataFrame:
    """GEO-01 .. GEO-06: distinct keyed addresses with ``geocode_method``, ``geocode_score`` and the place.

    Each step sees only what the steps before left. Fuzzy steps score distinct street names within blocks of
    one number (and postal code). By default all blocks are searched; with ``block_cap`` (500 in the published method)
    those of more index rows are left out of the search by number alone, and ``skipped_blocks`` reports them.
    """
    key = [area, "street_key", "number_key", "cep_key"]
    # Written once: each is read by several of the steps below.
    todo, index = materialize(addresses.select(*key).distinct()), materialize(index)
    named = todo.where("street_key is not null")
    place = [F.col(c) for c in PLACE]

    def step(rows: DataFrame, method: str, score: Column) -> DataFrame:
        return materialize(rows.select(*key, F.lit(method).alias("geocode_method"), score.alias("geocode_score"), *place))

    def scored(pairs: DataFrame, threshold: float, margin: float) -> DataFrame:
        # The lengths bound the score; a candidate that can neither win nor spoil the margin is not scored.
        a, b = F.length("street_key"), F.length("street_key_c")
        pairs = pairs.where(F.least(a, b) * 200.0 / (a + b) >= threshold - margin)
        # Each two names are scored once, however many addresses bring them together.
        names = pairs.select("street_key", "street_key_c").distinct().withColumn("s", indel_ratio(F.col("street_key"), F.col("street_key_c")))
        return best_with_margin(pairs.join(names, ["street_key", "street_key_c"]), key, "s", threshold, margin)

    exact = step(named.join(index.where("number_key is not null and cep_key is not null"), key), "exact_street_number_cep", F.lit(100.0))
    rest = _without(named, exact, key)
    by_number = step(rest.join(consolidated(index, area), [area, "street_key", "number_key"]), "exact_street_number", F.lit(96.0))
    rest = _without(rest, by_number, key)
    candidates = index.withColumnsRenamed({"street_key": "street_key_c", "cep_key": "cep_key_c"})
    pairs = rest.where("cep_key is not null").join(candidates.withColumn("cep_key", F.col("cep_key_c")), [area, "number_key", "cep_key"])
    near = step(scored(pairs, 78.0, 4.0), "fuzzy_street_exact_number_cep", F.round(F.least(F.lit(94.0), F.lit(75.0) + F.col("s") * 0.20), 2))
    rest = _without(rest, near, key)
    if block_cap is not None:
        candidates = candidates.join(skipped_blocks(index, block_cap, area), [area, "number_key"], "left_anti")
    wide = rest.join(candidates, [area, "number_key"])
    far = step(scored(wide, 92.0, 5.0), "fuzzy_street_exact_number", F.round(F.least(F.lit(92.0), F.lit(70.0) + F.col("s") * 0.22), 2))
    found = exact.unionByName(by_number).unionByName(near).unionByName(far)
    if street_centroid:
        rest = _without(rest, far, key)
        streets = index.where("cep_key is not null").groupBy(area, "street_key", "cep_key").agg(
            F.median("latitude").alias("latitude"), F.median("longitude").alias("longitude"), F.mode("label", True).alias("label"), F.mode("sector_code", True).alias("sector_code"),
            F.count_distinct("sector_code").alias("n_sector_codes"), F.mode("geo_level", True).alias("geo_level"), F.sum("n_records").alias("n_records"),
            spread_m("latitude", "longitude").alias("spread_m"),
        )
        found = found.unionByName(step(rest.join(streets, [area, "street_key", "cep_key"]), "street_cep_centroid", F.lit(70.0)))
    missing = _without(todo, found, key)
    empty = {c: F.lit(None).cast(found.schema[c].dataType) for c in PLACE}
    return found.unionByName(missing.withColumns({"geocode_method": F.lit("unmatched"), "geocode_score": F.lit(0.0)} | empty))


def _without(rows: DataFrame, found: DataFrame, key: list[str]) -> DataFrame:
    on = F.lit(True)
    for k in key:
        on = on & rows[k].eqNullSafe(found[k])
    return rows.join(found, on, "left_anti")


def confidence_flags(df: DataFrame) -> DataFrame:
    """PRJ-11."""
    there, s = F.col("latitude").isNotNull(), F.col("geocode_score")
    return df.withColumns({
        "flag_geocode_high": there & (s >= 90), "flag_geocode_medium": there & (s >= 80) & (s < 90), "flag_geocode_low": there & (s < 80),
    })


def transaction_quality(units: DataFrame, keys: list[str]) -> DataFrame:
    """AGG-13, GEO-09: geocoded units of a filing as one place with its quality tier."""
    hit = F.col("latitude").isNotNull()
    rows = units.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_units"), F.count_if(hit).alias("n_geocoded"), F.median("latitude").alias("latitude"), F.median("longitude").alias("longitude"),
        F.count_distinct("sector_code").alias("n_sectors"), F.min("sector_code").alias("_sector"), F.array_join(F.sort_array(F.collect_set(F.when(hit, F.col("geocode_method")))), " | ").alias("methods"),
        F.min(F.when(hit, F.col("geocode_score"))).alias("score_min"), F.avg(F.when(hit, F.col("geocode_score"))).alias("score_mean"),
    )
    share = F.col("n_geocoded") / F.col("n_units")
    tier = (
        F.when(F.col("n_geocoded") == 0, "unmatched")
        .when((share == 1) & (F.col("score_min") >= 90) & (F.col("n_sectors") <= 1), "high")
        .when((share >= 0.5) & (F.col("score_mean") >= 80), "medium")
        .otherwise("low")
    )
    return rows.withColumns({"sector_code": F.when(F.col("n_sectors") == 1, F.col("_sector")), "geocode_quality": tier, "pct_geocoded": share * 100}).drop("_sector")


def method_summary(units: DataFrame, year: str = "source_year") -> DataFrame:
    """AGG-14: rows and mean score per year and method with the year's totals."""
    rows = units.groupBy(year, "geocode_method").agg(F.count(F.lit(1)).alias("n_rows"), F.avg("geocode_score").alias("mean_score"))
    total = F.sum("n_rows").over(Window.partitionBy(year))
    return rows.withColumns({"year_rows": total, "pct_of_year": F.col("n_rows") * 100.0 / total})
