"""Queries of the general data problems over the test tables."""

from __future__ import annotations

from hashlib import sha256

from pyspark.sql import functions as F

from lavra.functions.text import code_digits
from lavra.operators import bad_rows, layouts, points, profile
from lavra.plans import data_sql
from lavra.plans.registry import Registry, table
from lavra.session import materialize, state_dir

DATA = Registry()


def _ingested(spark, sf_dir, names):
    """All records in one table, with fields approved for promotion moved out of the rescued ones."""
    rows = layouts.ingest(table(spark, sf_dir, "raw_lines"), table(spark, sf_dir, "raw_files"), names=names)
    return layouts.replay(layouts.promote(rows, {"inscricao_cadastral": "string", "fracao_ideal": "double"}))


@DATA.query(data_sql.P3_FOUND)
def p3_found(spark, sf_dir):
    """The ingested table is written whole; the changes come from it."""
    lines, files = table(spark, sf_dir, "raw_lines"), table(spark, sf_dir, "raw_files")
    names = layouts.resolve_names(lines, files)
    return layouts.layout_changes(lines, files, ingested=materialize(_ingested(spark, sf_dir, names)), names=names)


@DATA.query(data_sql.P3_INGESTED)
def p3_ingested(spark, sf_dir):
    names = layouts.resolve_names(table(spark, sf_dir, "raw_lines"), table(spark, sf_dir, "raw_files"))
    return _ingested(spark, sf_dir, names).drop("_kinds")


@DATA.query(data_sql.P6_FOUND)
def p6_found(spark, sf_dir):
    return bad_rows.parse_failures(table(spark, sf_dir, "raw_lines"), table(spark, sf_dir, "raw_files"))


@DATA.query(data_sql.P6_VALID)
def p6_valid(spark, sf_dir):
    """The valid records, loaded with the target schema."""
    lines, files = table(spark, sf_dir, "raw_lines"), table(spark, sf_dir, "raw_files")
    failed = bad_rows.parse_failures(lines, files)
    return layouts.ingest(lines, files).join(failed, ["file_id", "line_no"], "left_anti").drop("_kinds")


def _counts(spark, sf_dir, name, columns=None):
    """The count table of those columns, kept by the place of its table and brought up to date."""
    df = table(spark, sf_dir, name)
    columns = columns or [c for c in df.columns if c != "load_id"]
    of = sha256("|".join([sf_dir, *columns]).encode()).hexdigest()[:16]
    return profile.maintained_counts(df, state_dir(spark, "value_counts", f"{name}-{of}"), columns)


@DATA.query(data_sql.P2_FOUND)
def p2_found(spark, sf_dir):
    log = table(spark, sf_dir, "load_log")
    found = None
    for name, rules in (("itbi_units", profile.UNIT_RULES), ("market_indicators_city_year", profile.YEAR_RULES)):
        part = profile.findings(_counts(spark, sf_dir, name, list(rules)), log.where(F.col("table_name") == name), rules, written=True)
        found = part if found is None else found.unionByName(part)
    return found


@DATA.query(data_sql.P2_PROFILE)
def p2_profile(spark, sf_dir):
    """The profile of every column of both tables in each load, and its change from the load before."""
    log = table(spark, sf_dir, "load_log")
    parts = [
        profile.profile_with_changes(_counts(spark, sf_dir, name), log.where(F.col("table_name") == name), rules)
        for name, rules in (("itbi_units", profile.UNIT_RULES), ("market_indicators_city_year", profile.YEAR_RULES))
    ]
    places = {"entropy_bits": 6, "null_rate": 9, "null_rate_change": 9, "shift": 9}
    return parts[0].unionByName(parts[1]).withColumns({c: F.round(c, k) for c, k in places.items()})


def _register_points(spark, sf_dir):
    """Addresses with both coordinates; one that is missing, zero or no number takes no part."""
    rows = table(spark, sf_dir, "address_register").select(
        "cod_unico_endereco", "cod_municipio", "cod_setor", points.coordinate(F.col("latitude")).alias("lat"), points.coordinate(F.col("longitude")).alias("lon")
    )
    return materialize(rows.where("lat is not null and lon is not null").distinct())


def _sectors(spark, sf_dir):
    return points.wkt_edges(table(spark, sf_dir, "census_sectors"), "cd_setor", "geometry_wkt", "cd_mun")


@DATA.query(data_sql.P4_FOUND)
def p4_found(spark, sf_dir):
    rows = _register_points(spark, sf_dir)
    near = points.near_pairs(rows, 20.0, "cod_unico_endereco", group="cod_municipio").select(F.lit("near").alias("kind"), "id_a", "id_b")
    held = points.locate(rows, _sectors(spark, sf_dir), group="cod_municipio")
    recorded = code_digits(F.col("cod_setor"))
    wrong = held.where(~F.coalesce(recorded == F.col("region"), F.lit(False)))
    return near.unionByName(wrong.select(F.lit("sector").alias("kind"), F.col("cod_unico_endereco").alias("id_a"), F.col("region").cast("long").alias("id_b")).distinct())


@DATA.query(data_sql.P4_SECTORS)
def p4_sectors(spark, sf_dir):
    """Every address with the sector that contains it."""
    held = points.locate(_register_points(spark, sf_dir), _sectors(spark, sf_dir), group="cod_municipio")
    return held.select("cod_unico_endereco", "lat", "lon", F.col("region").alias("cd_setor")).distinct()


@DATA.query()
def sectors_attached(spark, sf_dir):
    """Every row of the register with its sector, null where it has none (JN-12)."""
    rows = table(spark, sf_dir, "address_register").select(
        "cod_unico_endereco", "cod_municipio", points.coordinate(F.col("latitude")).alias("lat"), points.coordinate(F.col("longitude")).alias("lon")
    )
    held = points.attach_region(materialize(rows), table(spark, sf_dir, "census_sectors"), "cd_setor", "geometry_wkt", group="cod_municipio", regions_group="cd_mun")
    return held.withColumnRenamed("region", "cd_setor")
