"""Market, quality, guide, geocoding and spatial operators on small fixtures."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from lavra.contracts import ContractError
from lavra.functions import numbers, similarity, text
from lavra.functions.dates import is_strict_date, parse_date
from lavra.operators import census, deflate, guides, indicators, quality, resolve, spatialstats
from lavra.plans import market_queries
from lavra.streaming import monthly


def values(spark, rows, make, kind="string"):
    return [r.v for r in spark.createDataFrame([(x,) for x in rows], f"t {kind}").select(make(F.col("t")).alias("v")).collect()]


def test_text_functions(spark):
    assert values(spark, [" Rua  São\tJoão ", "n/a", None, "-", "nan"], text.normalize_text) == ["Rua São João", None, None, None, None]
    assert values(spark, ["Praça D'Ávila, nº 3", "...", None], text.text_key) == ["PRACA D AVILA NO 3", None, None]
    assert values(spark, ["R. Rua das Flores", "AVENIDA", "Aveia Branca"], text.street_key) == ["DAS FLORES", None, "AVEIA BRANCA"]
    assert values(spark, ["S/N", "0012 B", "sem número", "000", None, "x"], text.number_key) == [None, "12", None, "0", None, None]
    assert values(spark, ["123", "12.345-678", "123456789", ""], text.postal_code_padded) == ["00000123", "12345678", None, None]
    assert values(spark, ["123", "123456789", "abc", None], text.postal_code_cut) == ["00000123", "12345678", None, None]
    assert values(spark, ["12.0", "12.50", " 7 "], text.integerish) == ["12", "12.50", "7"]
    assert values(spark, ["31-43 149", "", None], text.code_digits) == ["3143149", None, None]
    assert values(spark, ["ação", "ȩ́", "ÀÝñ", "漢"], text.fold_accents) == ["acao", "e", "AYn", "漢"]
    assert text.header_name("﻿'Nº Matrícula (RI)'") == "n_matricula_ri"


def test_numbers_and_dates(spark):
    lenient = ["R$ 1.234.567,89", "250,000.00", "1.234.567", "12,5", "5f", "n/a", "-3.5", None, "1e3"]
    assert values(spark, lenient, numbers.parse_number) == [1234567.89, 250000.0, None, 12.5, 5.0, None, -3.5, None, 13.0]
    strict = ["1.234", "1.234.567", "1,234.5", "1234,5", "1.23.4", "-1", "R$ 10", "R$  10", ""]
    assert values(spark, strict, numbers.strict_number) == [1.234, 1234567.0, 1234.5, 1234.5, None, None, 10.0, None, None]
    dates = ["2024/05/31 14:20:00", "31/05/2024", "1-2-2024", "31/02/2024", "2024-13-01", "", None, "now"]
    got = values(spark, dates, parse_date)
    assert got[:3] == [dt.datetime(2024, 5, 31, 14, 20), dt.datetime(2024, 5, 31), dt.datetime(2024, 2, 1)] and got[3:] == [None] * 5
    for year in (1900, 2000, 2023, 2024):
        assert values(spark, [f"29/02/{year}"], is_strict_date) == [year in (2000, 2024)]


def test_indel_ratio(spark):
    rows = [("red widget", "red wdget"), ("blue bolt", "old bolt"), ("", "abc"), ("", ""), (None, "a"), ("abc", "abc")]
    got = [r.v for r in spark.createDataFrame(rows, "a string, b string").select(F.round(similarity.indel_ratio(F.col("a"), F.col("b")), 2).alias("v")).collect()]
    assert got == [94.74, 70.59, 0.0, 100.0, None, 100.0]


def sales(spark):
    rows = []
    for y in (2023, 2024, 2025):
        for m in range(1, 13 if y < 2025 else 5):
            rows += [(f"{y}-{m:02d}-{d:02d}", y, d % 3 or None, 100.0 * m + y - 2000 + d, 10.0 + d, 5.0 * m, d > 2, f"s{d}") for d in (1, 2, 3, 4)]
    schema = "day string, source_year int, n_units int, base_de_calculo_real double, area_referencia_m2 double, valor_m2_base_real double, flag_multiunit_qc boolean, sector_final_code string"
    df = spark.createDataFrame(rows, schema).withColumn("data_pagamento", F.col("day").cast("timestamp_ntz"))
    return indicators.with_period(df)


def test_months_add_up_to_years_and_growth_mask(spark):
    df = sales(spark)
    year = {r.ano_analise: r for r in indicators.city_year(df, 2025).collect()}
    month = indicators.city_month(df).collect()
    for y, r in year.items():
        own = [m for m in month if m.ano_analise == y]
        assert sum(m.n_transacoes for m in own) == r.n_transacoes and sum(m.n_unidades for m in own) == r.n_unidades
        assert math.isclose(sum(m.base_total_real for m in own), r.base_total_real)
    assert year[2024].variacao_transacoes_pct == 0 and year[2023].variacao_transacoes_pct is None
    assert year[2025].flag_ano_incompleto and year[2025].variacao_transacoes_pct is None
    ytd = {r.ano_analise: r for r in indicators.ytd_comparable(df, 2025).collect()}
    assert ytd[2025].n_transacoes == year[2025].n_transacoes and ytd[2023].n_transacoes == 16 and ytd[2024].periodo_comparavel == "jan-04"
    assert indicators.city_year(df.limit(0), 2025).count() == 0


def test_quality(spark):
    rng = random.Random(1)
    rows = [(2020, i % 2 == 0, math.exp(rng.gauss(5, 0.3))) for i in range(300)] + [(2020, True, 1e9), (2020, True, None), (2020, True, -1.0), (2020, True, float("nan"))] + [(None, False, 5.0)] * 3
    df = spark.createDataFrame(rows, "source_year int, multi boolean, v double")
    fences = quality.log_iqr_thresholds(df, {"v": "v"}, ["source_year", "multi"])
    why = {(r.source_year, r.multi): (r.n, r.reason_not_applied) for r in fences.collect()}
    assert why == {(2020, True): (151, None), (2020, False): (150, None), (None, False): (3, "group_too_small")}
    flagged = quality.log_iqr_flags(df, fences, {"v": "v"}, ["source_year", "multi"])
    assert [r.v for r in flagged.where("flag_outlier_v").collect()] == [1e9] and flagged.count() == len(rows)
    samples = quality.nested_samples(df.withColumn("flag_amostra_mercado_origem", F.col("v") > 0), []).first()
    assert samples.flag_use_market_analysis and not samples.flag_use_spatial_analysis
    a = spark.createDataFrame([(1, None), (2, "x")], "id int, k string")
    b = spark.createDataFrame([(None, "n"), ("y", "z")], "k string, w string")
    assert sorted((str(r.id), str(r.k), str(r.w)) for r in quality.null_safe_join(a, b, ["k"], "full").collect()) == [("1", "None", "n"), ("2", "x", "None"), ("None", "y", "z")]


def test_whole_texts_are_folded_and_streets_scored(spark, tmp_path):
    import unicodedata

    plain = "Ação de usucapião, São José, ñandú, Übergröße " * 3000
    docs = [(1, plain), (2, unicodedata.normalize("NFD", plain)), (3, ""), (4, None)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in market_queries.accent_fold_texts(spark, str(tmp_path)).collect()}
    assert got[1].folded == got[2].folded and got[1].n_chars == len(plain) and got[2].n_left == 0
    assert got[3].n_chars == 0 and got[4].folded is None
    asked = [("m", "RUA DOS CRAVSO", "10", "30000001"), ("m", "RUA DOS LIRIOS", "10", "30000002"), ("m", None, "10", "30000001")]
    spark.createDataFrame(asked, "cod_municipio string, logradouro string, n_endereco string, cep string").write.parquet(str(tmp_path / "address_records.parquet"))
    register = [("m", "111", "30000001", "RUA", None, name, "10", "-20.0", "-44.0", 1) for name in ("DOS CRAVOS", "TIRADENTES")]
    schema = "cod_municipio string, cod_setor string, cep string, nom_tipo_seglogr string, nom_titulo_seglogr string, nom_seglogr string, num_endereco string, latitude string, longitude string, nv_geo_coord int"
    spark.createDataFrame(register, schema).write.parquet(str(tmp_path / "address_register.parquet"))
    scores = {(r.a, r.b): r.ratio for r in market_queries.street_similarity(spark, str(tmp_path)).collect()}
    assert set(scores) == {("DOS CRAVSO", "DOS CRAVOS"), ("DOS CRAVSO", "TIRADENTES")} and scores["DOS CRAVSO", "DOS CRAVOS"] == 90.0


def test_null_safe_units_covers_whole_tables(spark, tmp_path):
    units = [(1, 7, "m", "RUA A", "10", "30000001"), (2, 7, "m", "R. A", "10", None), (3, 7, "m", "A", "s/n", "30000001"), (4, 7, "n", "RUA A", "10", None), (5, 7, "m", None, None, None)]
    spark.createDataFrame(units, "unit_row_id long, load_id long, cod_municipio string, logradouro string, n_endereco string, cep string").write.parquet(str(tmp_path / "itbi_units.parquet"))
    register = [("m", "111", c, "RUA", None, "A", n, "-20.0", "-44.0", 1) for c, n in [("30000001", "10"), (None, "10"), ("30000001", None)]]
    schema = "cod_municipio string, cod_setor string, cep string, nom_tipo_seglogr string, nom_titulo_seglogr string, nom_seglogr string, num_endereco string, latitude string, longitude string, nv_geo_coord int"
    spark.createDataFrame(register, schema).write.parquet(str(tmp_path / "address_register.parquet"))
    got = {r.unit_row_id: r.n_records for r in market_queries.null_safe_units(spark, str(tmp_path)).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: None, 5: None}


def test_deflate(spark):
    index = deflate.chained_index(spark.createDataFrame([("2020-01", 1.0), ("2020-02", 2.0), ("2020-03", -0.5)], "period string, pct double"))
    levels = [r.level for r in index.orderBy("period").collect()]
    assert levels == pytest.approx([1.01, 1.01 * 1.02, 1.01 * 1.02 * 0.995])
    tx = spark.createDataFrame([("2020-01-15", 100.0), ("2019-12-31", 50.0), ("2020-04-01", 1.0), (None, 3.0)], "d string, a double").withColumn("d", F.to_date("d"))
    rows = {r.a: r for r in deflate.deflate(tx, index, "d", ["a"]).collect()}
    assert rows[100.0].a_real == pytest.approx(100 * 1.02 * 0.995) and rows[50.0].flag_antes_cobertura and rows[1.0].flag_depois_cobertura
    assert rows[3.0].a_real is None and not rows[3.0].flag_ipca_disponivel
    with pytest.raises(ContractError):
        deflate.deflate(tx, index, "d", ["a"], "2030-01")


def test_guides(spark):
    rows = [("f", 2, None, 40.0), ("f", 3, 100.0, 100.5), ("f", 4, None, 12.5), ("f", 5, 250.0, 0.0), ("f", 6, None, 80.0), ("g", 2, None, None), ("g", 3, None, 1.0)]
    df = spark.createDataFrame(rows, "file string, row int, base_de_calculo double, area_constr_privativa double")
    df = df.withColumns({"area_constr_total": F.lit(None).cast("double"), "area_total_terreno": F.lit(None).cast("double"), "bairro": F.concat(F.lit("b"), (F.col("row") % 2).cast("string"))})
    grouped = guides.infer_groups(df, ["file"], ["row"], "base_de_calculo")
    assert {(r.file, r.row): (r.guide_seq, r.guide_rows) for r in grouped.collect()} == {
        ("f", 2): (-1, 1), ("f", 3): (1, 2), ("f", 4): (1, 2), ("f", 5): (2, 2), ("f", 6): (2, 2), ("g", 2): (-1, 1), ("g", 3): (-2, 1),
    }
    tx = {(r.file, r.guide_seq): r for r in guides.build_transactions(grouped, ["file", "guide_seq"], "row", ["bairro"], ["base_de_calculo"]).collect()}
    assert tx["f", 1].area_referencia_m2 == 113.0 and tx["f", 1].bairro == "b1 | b0" and tx["f", 1].valor_m2_base == pytest.approx(100 / 113)
    assert tx["f", 2].area_referencia_metodo == "indeterminada_multiunit" and tx["f", 2].valor_m2_base is None
    dup = guides.content_duplicates(df, ["bairro"], ["file"]).collect()
    assert sum(r.flag_duplicado_exato for r in dup) == 5


def test_geocode(spark):
    reg = [
        ("m", "111", "30000001", "RUA", None, "DAS FLORES", "10", "-20.0", "-44.0", 1), ("m", "111", "30000001", "RUA", None, "DAS FLORES", "10", "-20.0", "-44.0", 1),
        ("m", "111", "30000002", "RUA", None, "DOS CRAVOS", "20", "-20.1", "-44.0", 1), ("m", "112", "30000003", "RUA", None, "TIRADENTES", "30", "-20.2", "-44", 2),
        ("m", "113", "30000004", "RUA", None, "LARANJEIRAS", "40", "0", "-44", 2),
    ]
    schema = "cod_municipio string, cod_setor string, cep string, nom_tipo_seglogr string, nom_titulo_seglogr string, nom_seglogr string, num_endereco string, latitude string, longitude string, nv_geo_coord int"
    index = resolve.build_address_index(spark.createDataFrame(reg, schema))
    assert {(r.street_key, r.n_records) for r in index.collect()} == {("DAS FLORES", 2), ("DOS CRAVOS", 1), ("TIRADENTES", 1)}
    asked = [("m", "R. das Flores", "10", "30000001"), ("m", "Rua dos Cravos", "20", None), ("m", "Rua dos Cravso", "20", "30000002"), ("m", "Tiradentes X", "30", "99999999"), ("m", "Outra", "30", None), ("m", None, "10", None), ("z", "R. das Flores", "10", "30000001")]
    a = resolve.address_keys(spark.createDataFrame(asked, "cod_municipio string, s string, n string, c string"), "s", "n", "c")
    got = {(r.cod_municipio, r.street_key): (r.geocode_method, r.geocode_score) for r in resolve.geocode(a, index).collect()}
    assert got["m", "DAS FLORES"] == ("exact_street_number_cep", 100.0) and got["m", "DOS CRAVOS"] == ("exact_street_number", 96.0)
    assert got["m", "DOS CRAVSO"][0] == "fuzzy_street_exact_number_cep" and 90 < got["m", "DOS CRAVSO"][1] <= 94
    assert got["m", "OUTRA"] == ("unmatched", 0.0) and got["m", None] == ("unmatched", 0.0) and got["z", "DAS FLORES"] == ("unmatched", 0.0)


def lattice(n):
    square = lambda x, y: f"POLYGON (({x} {y}, {x + 1} {y}, {x + 1} {y + 1}, {x} {y + 1}, {x} {y}))"
    return [(f"{x}{y}", "g", square(x, y)) for x in range(n) for y in range(n)] + [("far", "g", square(50, 50))]


def test_contiguity_and_moran(spark):
    regions = spark.createDataFrame(lattice(4), "r string, g string, w string")
    edges = spatialstats.queen_edges(spatialstats.vertices(regions, "r", "w", "g"))
    rows = edges.collect()
    assert len(rows) == sum(max(abs(a - c), abs(b - d)) == 1 for a in range(4) for b in range(4) for c in range(4) for d in range(4))
    assert sum(r.w for r in rows) == pytest.approx(16)
    v = spark.createDataFrame([(1, "g", r, float(int(r[0]))) for r, _, _ in lattice(4) if r != "far"] + [(1, "g", "far", 99.0)], "y int, group string, region string, value double")
    local = spatialstats.moran_local(v, edges, ["y"])
    assert local.count() == 16
    z = {f"{a}{b}": a - 1.5 for a in range(4) for b in range(4)}
    near = {k: [j for j in z if j != k and max(abs(int(k[0]) - int(j[0])), abs(int(k[1]) - int(j[1]))) == 1] for k in z}
    want = sum(z[k] * sum(z[j] for j in near[k]) / len(near[k]) for k in z) / sum(x * x for x in z.values())
    assert spatialstats.moran_global(local, ["y"]).first().moran_i == pytest.approx(want)
    p = spatialstats.moran_permutations(v, edges, ["y"], permutations=199).first()
    assert p.moran_i == pytest.approx(want) and p.p_sim <= 0.02 and p.permutations == 199
    assert p.p_sim == spatialstats.moran_permutations(v, edges, ["y"], permutations=199, per_task=7).first().p_sim


def test_local_clusters_and_value_branch(spark):
    n, rng = 5, random.Random(4)
    regions = spark.createDataFrame(lattice(n), "r string, g string, w string")
    edges = spatialstats.queen_edges(spatialstats.vertices(regions, "r", "w", "g"))
    value = {f"{x}{y}": x * x + rng.random() for x in range(n) for y in range(n)}
    rows = [(1, "g", k, 5, v) for k, v in value.items()] + [(1, "g", "far", 9, 500.0), (2, "g", "00", 5, 1.0), (2, "g", "11", 5, 3.0), (2, "g", "44", 50, 80.0), (2, "g", "01", 4, 9.0), (2, "g", "10", 9, None)]
    sectors = spark.createDataFrame(rows, "y int, group string, region string, n_transacoes int, m double")
    frame = spatialstats.value_frame(sectors, "m", ["y"])
    # Year 2: four transactions or no metric are out; what then has no neighbour is out of the mean too.
    assert {(r.region, r.z, r.lag_z) for r in spatialstats.moran_local(frame, edges, ["y"]).where("y = 2").collect()} == {("00", -1.0, 1.0), ("11", 1.0, -1.0)}
    assert {r.value for r in spatialstats.volume_frame(spark.createDataFrame([("g", "a", None), ("g", "b", 3)], "group string, region string, n_transacoes int"), []).collect()} == {0.0, math.log(4)}
    got = {(r.y, r.region): r for r in spatialstats.moran_clusters(frame, edges, ["y"]).collect()}
    assert len(got) == n * n + 2 and got[2, "00"].p_sim is None and got[2, "00"].cluster is None
    mean = sum(value.values()) / n / n
    for k, v in value.items():
        near = [j for j in value if j != k and max(abs(int(k[0]) - int(j[0])), abs(int(k[1]) - int(j[1]))) == 1]
        others, z = [j for j in value if j != k], v - mean
        lag = lambda names: sum(value[j] - mean for j in names) / len(names)
        drawn = [z * lag(rng.sample(others, len(near))) for _ in range(4000)]
        above = sum(d >= z * lag(near) for d in drawn) / 4000
        assert got[1, k].p_sim == pytest.approx(min(above, 1 - above), abs=0.06)
        assert got[1, k].cluster == ("NS" if got[1, k].p_sim > 0.05 else ["HH", "LH", "LL", "HL"][got[1, k].quadrant - 1])
    assert got[1, "42"].cluster == "HH" and {r.cluster for r in got.values()} >= {"HH", "NS"}
    again = {(r.y, r.region): r.p_sim for r in spatialstats.moran_clusters(frame, edges, ["y"], per_task=3).collect()}
    assert again == {k: r.p_sim for k, r in got.items()}
    # All others are neighbours: every draw is the observed one.
    ring = spark.createDataFrame(lattice(2), "r string, g string, w string")
    small = spark.createDataFrame([(1, "g", f"{i}{j}", float(i + 3 * j)) for i in range(2) for j in range(2)], "y int, group string, region string, value double")
    meshed = spatialstats.queen_edges(spatialstats.vertices(ring, "r", "w", "g"))
    assert {r.cluster for r in spatialstats.moran_clusters(small, meshed, ["y"]).collect()} == {"NS"}


def test_concentration_and_hexbin(spark):
    df = spark.createDataFrame([(1, x) for x in (0, 0, 1, 3, 6)], "y int, c int")
    r = spatialstats.concentration(df, ["y"], "c", 2).first()
    assert (r.n_units, r.n_active, r.total) == (5, 3, 10.0) and r.hhi == pytest.approx(0.46) and r.pct_top_2 == pytest.approx(90)
    x = [0, 0, 1, 3, 6]
    assert r.gini == pytest.approx(sum(abs(a - b) for a in x for b in x) / (2 * 25 * 2))
    pts = spark.createDataFrame([(0.0, 0.0), (0.1, 0.1), (5.0, 5.0)], "x double, y double")
    assert sorted(r.n for r in spatialstats.hexbin(pts, "x", "y", 1.0).collect()) == [1, 2]


def test_census(spark):
    codes = [c for c, _ in census.AGE_BANDS.values()]
    basic = spark.createDataFrame([("a", 100, 2.0), ("b", 50, 0.0)], "k string, V0001 int, AREA_KM2 double")
    demo = spark.createDataFrame([("a", 99, 50, 49, *[9] * 11), ("b", None, None, None, None, *[1] * 10)], "k string, V01006 int, V01007 int, V01008 int, " + ", ".join(f"{c} int" for c in codes))
    income = spark.createDataFrame([("a", 1, 1, 4.0, 2.0, 9.0)], "k string, V06001 int, V06002 int, V06003 double, V06004 double, V06005 double")
    r = {x.k: x for x in census.census_profile(basic, demo, income, "k").collect()}
    assert r["a"].populacao_total == 99 and r["a"].densidade_pop_km2 == 49.5 and r["a"].flag_pop_divergente and r["a"].cv_renda_responsavel == 1.5
    assert r["a"].razao_dependencia_0_14_60mais == pytest.approx(100 * 45 / 54)
    assert r["b"].populacao_total == 50 and r["b"].densidade_pop_km2 is None and r["b"].idade_media_aprox is None and not r["b"].flag_pop_divergente
    assert values(spark, ["X", "12", "2,8", None, "1.5"], census.census_number) == [None, 12.0, None, None, 1.5]


def test_stream_equals_batch(spark, tmp_path):
    rows = [(dt.datetime(2024, 1, d, 3), "a" if d % 2 else "b", float(d)) for d in range(1, 29)]
    spark.createDataFrame(rows, "ts timestamp, k string, v double").repartition(3).write.parquet(str(tmp_path / "in"))
    table = spark.read.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(table.schema).parquet(str(tmp_path / "in"))
    query = monthly.monthly_counts(stream, "ts", "v", ["k"]).writeStream.outputMode("complete").format("memory").queryName("daily").option("checkpointLocation", str(tmp_path / "cp")).start()
    query.processAllAvailable()
    query.stop()
    assert sorted(map(str, monthly.roll_up(spark.table("daily"), ["k"]).collect())) == sorted(map(str, monthly.roll_up(monthly.monthly_counts(table, "ts", "v", ["k"]), ["k"]).collect()))


def test_percentiles_by_counts(spark):
    """Against numpy: values of all signs and sizes, shares below one, infinities, ties, null keys, days put together."""
    import numpy as np

    from lavra.functions import stats

    rng = np.random.default_rng(3)
    groups = {"a": rng.normal(0, 1e6, 400), "b": rng.random(300) / 100, None: np.array([5.0, 5.0, 5.0]), "c": np.array([-0.0, 0.0, 1e-300, -1e300]), "d": np.array([float("inf"), 2.0, 3.0])}
    rows = [(g, int(i % 3), float(v)) for g, vs in groups.items() for i, v in enumerate(vs)] + [("a", 0, None), ("e", 0, None), ("b", 1, float("nan"))]
    df = spark.createDataFrame(rows, "g string, day int, v double")
    counts = stats.group_value_counts(df, ["g", "day"], ["v"])
    for table in (stats.group_value_counts(df, ["g"], ["v"]), stats.merge_counts(counts, keys=["g"])):
        got = {(r.g, r.fraction): (r.percentile, r.n_values) for r in stats.percentiles_from_counts(table, ["g"], {"v": [0.0, 0.25, 0.5, 0.9, 1.0]}).collect()}
        assert {g for g, _ in got} == set(groups)
        for (g, q), (p, n) in got.items():
            want = np.quantile(groups[g], q) if not np.isinf(groups[g]).any() else {0.0: 2.0, 0.25: 2.5, 0.5: 3.0}.get(q, float("inf"))
            assert n == len(groups[g]) and (p == want or abs(p - want) <= 1e-9 * abs(want)), (g, q, p, want)
    wide = stats.with_percentiles(df.groupBy("g").count(), df, ["g"], {"m": (F.col("v"), 0.5), "h": (F.col("v") * 2, 0.5)}).collect()
    assert len(wide) == 6 and all(r.h == 2 * r.m for r in wide if r.m is not None) and [r.m for r in wide if r.g == "e"] == [None]
    steps = spark.createDataFrame([(float(v),) for v in [*(-(10.0 ** np.arange(-9, 9))[::-1]), 0, *(10.0 ** np.arange(-9, 9))]], "v double").select(stats.order_bucket(F.col("v")).alias("b"))
    assert (b := [r.b for r in steps.collect()]) == sorted(b) and len(set(b)) == len(b)


def test_units_from_text_to_transactions(spark):
    """The literal rows of a unit file: orphan, guides, paid, cancelled, dates that fail, addresses, single-unit price."""
    from lavra.operators import units

    given = ["source_row", "base_de_calculo", "area_constr_privativa", "data_pagamento", "situacao", "logradouro", "n_endereco", "complemento_endereco"]
    rows = [
        (2, "", "40", "01/02/2024", "PAGO", "RUA A", "10.0", "AP 1"), (3, "R$ 1.234.567,89", "100,5", "2024/05/31 14:20:00", "PAGO", " Rua  B ", "7", None), (4, "", "12.5", "31/05/2024", "Cancelado", "RUA B", "7", "nan"),
        (5, "250,000.00", "0", "", "PAGO", None, None, None), (6, "1000", "80", "32/06/2024", "PAGO", "RUA C", "1", ""),
    ]
    df = spark.createDataFrame([(*r, "itbi_2024.csv", 2024) for r in rows], ", ".join(f"{c} {'int' if c == 'source_row' else 'string'}" for c in given) + ", source_file string, source_year int")
    rest = [c for c in (*units.TEXTS, *units.NUMBERS, *units.DATES, "cep") if c not in given]
    df = df.withColumns({c: F.lit(None).cast("string") for c in rest}).withColumn("clash", F.lit(1))
    clean = units.clean_units(df, 2026)
    made = {r.source_row: r for r in units.with_guides(clean, ["source_file"], ["source_row"]).collect()}
    assert [made[i].guide_seq for i in range(2, 7)] == [-1, 1, 1, 2, 3] and made[3].base_de_calculo == 1234567.89 and made[4].guide_rows == 2
    assert made[2].n_endereco == "10" and made[2].endereco_full == "RUA A, 10 - AP 1" and made[3].endereco_match_key == "RUA B|7|" and made[5].endereco_full == ""
    assert made[6].flag_data_pagamento_parse_error and not made[5].flag_data_pagamento_parse_error and made[6].data_pagamento_raw == "32/06/2024"
    assert made[6].valor_m2_base_unitario == 12.5 and made[3].valor_m2_base_unitario is None and made[5].base_de_calculo_unitaria == 250000.0
    tx = {r.guide_seq: r for r in units.unit_transactions(units.with_guides(clean, ["source_file"], ["source_row"]), ["source_file", "guide_seq"]).collect()}
    assert tx[1].area_referencia_m2 == 113.0 and tx[1].flag_cancelado and not tx[1].flag_amostra_mercado and tx[1].situacao == "PAGO | Cancelado" and tx[1].complemento_endereco is None
    assert tx[-1].flag_group_orphan and tx[2].area_referencia_metodo == "indeterminada_multiunit" and tx[3].flag_pago is False
    assert units.clean_units(df.limit(0), 2026).count() == 0


def test_scales_masks_years_and_labels(spark):
    rows = spark.createDataFrame([("a", 2020, 3, 5.0), ("b", 2020, None, 6.0), ("c", 2021, 900, None)], "r string, ano_analise int, n_transacoes long, v double")
    assert tuple(indicators.common_volume_scale(rows).first()) == (0.0, 3 + 0.98 * 897) and tuple(indicators.common_volume_scale(rows.limit(0)).first()) == (0.0, 1.0)
    assert {r.r: r.v for r in indicators.masked(rows, "v", 5).collect()} == {"a": None, "b": 6.0, "c": None}
    years = spark.createDataFrame([("m", 2020, False), ("m", 2021, True), ("n", 2019, True), ("n", 2020, None)], "g string, ano_analise int, flag_ano_incompleto boolean")
    assert {tuple(r) for r in indicators.latest_complete_year(years, ["g"]).collect()} == {("m", 2020, False), ("n", 2020, False)}
    assert indicators.latest_complete_year(years.limit(0)).count() == 0
    got = rows.select(indicators.labelled(F.col("n_transacoes") > 5, indicators.LABELS, "?")).collect()
    assert [r[0] for r in got] == ["nao", "?", "sim"]
    assert [r.ano_analise for r in indicators.in_order(rows, ["ano_analise"], ["v"]).collect()] == [2020, 2020, 2021]
    assert {r.r for r in quality.keep_first(rows, ["ano_analise"], ["v"]).collect()} == {"a", "c"}
    square = lambda x: [(x, 0.0, x + 1.0, 0.0), (x + 1.0, 0.0, x + 1.0, 1.0), (x + 1.0, 1.0, x, 1.0), (x, 1.0, x, 0.0)]
    edges = spark.createDataFrame([("m", *e) for x in (0.0, 1.0) for e in square(x)], "group string, ax double, ay double, bx double, by double")
    assert spatialstats.outline(edges).count() == 6


def test_lcs_against_the_table():
    rng = random.Random(6)
    for _ in range(200):
        a, b = ("".join(rng.choice("abcé😀") for _ in range(rng.randint(0, 90))) for _ in range(2))
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
            row = new
        assert similarity.lcs(a, b) == row[-1]
