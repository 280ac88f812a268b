"""File sources, shapefiles, sinks and the driver's entry points."""

import importlib.util
import json
import struct
import zipfile

import pytest

import __spark_entry__ as entry
from lavra.contracts import ContractError
from lavra.sources import files, shapefile, sinks


def test_unit_csv(spark, tmp_path):
    (tmp_path / "itbi_2021.csv").write_bytes("Logradouro;numero_endereco;BAIRRO\n'RUA A;B';10;São\n'it''s\nlong';;x\n".encode("latin-1"))
    (tmp_path / "itbi_2020.csv").write_text("logradouro,bairro,extra\nA,B,C\n", encoding="utf-8")
    (tmp_path / ".hidden.csv").write_text("x")
    rows = files.read_unit_folder(spark, tmp_path).collect()
    got = [(r.source_year, r.source_row, r.logradouro, r.n_endereco, r.bairro, r.extra) for r in sorted(rows, key=lambda r: (r.source_year, r.source_row))]
    assert got == [(2020, 2, "A", None, "B", "C"), (2021, 2, "RUA A;B", "10", "São", None), (2021, 3, "it's\nlong", None, "x", None)]
    with pytest.raises(ContractError):
        files.read_unit_csv(spark, tmp_path / "itbi_2020.csv", required=("cep",))
    assert files.canonical_names(["Nº", "n", "Área Construída Total"]) == ["n", "n_2", "area_constr_total"]


def test_projected_csv_zip_and_prices(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "r.zip", "w") as z:
        z.writestr("dir/long_name.csv", "x")
        z.writestr("a.csv", "Cod Município;CEP;outra\n3106200;1;z\n9999999;2;z\n")
    path = files.extract_member(tmp_path / "r.zip", tmp_path)
    df = files.read_projected_csv(spark, path, ["COD_MUNICIPIO", "CEP", "NOPE"], ["CEP"], "COD_MUNICIPIO", "3106200", "CEP")
    assert [tuple(r) for r in df.collect()] == [("3106200", "1", None)]
    (tmp_path / "p.json").write_text(json.dumps([{"data": "01/01/2020", "valor": "0,21"}, {"data": "01/02/2020", "valor": "0.25"}]))
    assert sorted(map(tuple, files.read_price_series(spark, str(tmp_path / "p.json")).collect())) == [("2020-01", 0.21), ("2020-02", 0.25)]
    (tmp_path / "q.json").write_text(json.dumps([{"data": "01/01/2020", "valor": "x"}]))
    with pytest.raises(ContractError):
        files.read_price_series(spark, str(tmp_path / "q.json"))
    assert files.resource_format("Planilha XLSX", "http://x/y.csv") == "csv" and files.safe_name("a b/ç.csv") == "a_b_.csv"
    assert files.detect_delimiter("a|b|c\n1|2|3\n") == "|" and files.newest(tmp_path, "nope*", "*.json").name == "q.json"


def test_shapefile(spark, tmp_path):
    def record(k, rings):
        points = [p for r in rings for p in r]
        starts, at = [], 0
        for r in rings:
            starts.append(at)
            at += len(r)
        body = struct.pack("<i4d2i", 5, 0, 0, 1, 1, len(rings), len(points)) + struct.pack(f"<{len(starts)}i", *starts) + b"".join(struct.pack("<2d", *p) for p in points)
        return struct.pack(">2i", k, len(body) // 2) + body

    outer, hole, second = [(0, 0), (0, 4), (4, 4), (4, 0), (0, 0)], [(1, 1), (2, 1), (2, 2), (1, 1)], [(9, 9), (9, 10), (10, 10), (9, 9)]
    shp = b"\0" * 100 + record(1, [outer, hole, second])
    dbf = struct.pack("<4BIHH20x", 3, 24, 1, 1, 1, 65, 11) + b"CD_SETOR\0\0\0C" + b"\0" * 4 + bytes([10, 0]) + b"\0" * 14 + b"\r" + b" 310000001 "
    with zipfile.ZipFile(tmp_path / "m.zip", "w") as z:
        z.writestr("setor.shp", shp)
        z.writestr("setor.dbf", dbf)
        z.writestr("setor.prj", "GEOGCS[]")
    row = shapefile.read_polygons(spark, tmp_path / "m.zip").first()
    assert row.CD_SETOR == "310000001"
    assert row.geometry_wkt.startswith("MULTIPOLYGON (((0.0 0.0, 0.0 4.0") and row.geometry_wkt.count("((") == 2
    assert shapefile.read_optional_polygons(spark, tmp_path / "none.zip") is None


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "<b>")], "a int, b string")
    sinks.save_table(df, str(tmp_path / "p"), str(tmp_path / "c"))
    assert spark.read.parquet(str(tmp_path / "p")).count() == 1
    sinks.save_metadata(sinks.metadata(df), tmp_path / "m.json")
    assert json.loads((tmp_path / "m.json").read_text()) == {"a": 1, "b": "<b>"}
    sinks.save_report([sinks.html_table(df, "T")], tmp_path / "r.html")
    assert "&lt;b&gt;" in (tmp_path / "r.html").read_text()


def test_entry():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries)
    assert {f"p{n}_found" for n in (2, 3, 4, 6)} <= set(queries)
    if importlib.util.find_spec("lavra.llm") and importlib.util.find_spec("lavra.llm.queries"):
        assert {"p1_found", "p5_found", "p7_ids", "p8_mixture", "p9_found"} <= set(queries)


def test_encoding_is_that_of_the_whole_file(spark, tmp_path):
    """An accent after the first 64 KiB counts; a name without a year takes the year most rows have."""
    head = "logradouro;bairro;data_estimativa\n" + "RUA A;B;01/02/2019\n" * 6000
    (tmp_path / "units.csv").write_bytes((head + "RUA;São;05/03/2021\n").encode("latin-1"))
    df = files.read_unit_csv(spark, tmp_path / "units.csv")
    assert df.where("bairro = 'São'").count() == 1 and {r.source_year for r in df.select("source_year").distinct().collect()} == {2019}
    (tmp_path / "marked.csv").write_bytes(("﻿" + head + "RUA;São;05/03/2021\n").encode("utf-8"))
    assert files.detect_encoding(spark, tmp_path / "marked.csv") == "utf-8-sig"
    assert files.detect_encoding(spark, tmp_path / "units.csv") == "cp1252"


def test_intermediate_tables(spark, monkeypatch):
    """They go on ``release``; without a shared folder a cluster is refused."""
    from lavra import session

    before = session.written()
    path = session.materialize(spark.range(3)).inputFiles()[0].rsplit("/", 1)[0]
    assert session.release(spark, before) == 1 and session.folders(spark, path, "_SUCCESS") == []

    class Conf:
        def get(self, key, default=None):
            return {"spark.master": "spark://host:7077"}.get(key, default)

    class Cluster:
        conf = Conf()

    with pytest.raises(ContractError):
        session.shared_dir(Cluster())


def test_census_levels_and_quality_outputs(spark, tmp_path):
    for part, text in {"basico": "CD_SETOR;V0001\n310000001;5\n990000001;6\n", "demografia": "CD_SETOR;V01006\n310000001;5\n", "renda_responsavel": "CD_SETOR;V06001\n310000001;2\n"}.items():
        with zipfile.ZipFile(tmp_path / f"setores_{part}.csv.zip", "w") as z:
            z.writestr(f"{part}.csv", text)
    folders = dict.fromkeys(("basic", "demography", "income"), tmp_path)
    columns = {"basic": ["V0001"], "demography": ["V01006"], "income": ["V06001"]}
    tables = files.load_level(spark, folders, "sector", tmp_path / "out", columns, "31")
    assert [tuple(r) for r in tables["basic"].collect()] == [("310000001", "5")] and tables["income"].first().V06001 == "2"
    assert files.load_level(spark, dict.fromkeys(folders, tmp_path / "none"), "neighbourhood", tmp_path, columns, required=False) is None
    with pytest.raises(ContractError):
        files.load_level(spark, dict.fromkeys(folders, tmp_path / "none"), "neighbourhood", tmp_path, columns)
    assert files.inspect_member(spark, tmp_path / "out" / "sector-basic" / "basico.csv")["delimiter"] == ";"
    rows = spark.createDataFrame([(1, True), (2, None), (3, False)], "id int, flag_use_market_analysis boolean")
    places = sinks.save_quality_outputs(rows, rows.groupBy().count(), rows.limit(1), rows.groupBy().count(), str(tmp_path / "q"))
    assert spark.read.parquet(places["sample"]).count() == 1 and spark.read.parquet(places["audited"]).count() == 3
    assert files.read_required_csv(spark, places["summary"], ["count"]).first()["count"] == 3
    with pytest.raises(ContractError):
        files.read_required_csv(spark, places["summary"], ["nope"])
    sinks.save_manifest([{"name": "a"}], [], ["g"], tmp_path / "m.json", "p", "2024-01-01")
    assert json.loads((tmp_path / "m.json").read_text())["files"] == [{"name": "a"}] and sinks.image_data_uri(b"x") == "data:image/png;base64,eA=="
