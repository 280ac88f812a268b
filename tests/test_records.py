"""Problems 3 and 6 on small fixtures, and the record splitter against a plain reader."""

import random

import pytest
from pyspark.sql import functions as F

from lavra.operators import bad_rows, layouts
from lavra.operators.records import split_record

LINES = "file_id long, line_no int, raw_text string, cod_municipio string, columns string"
FILES = "file_id long, cod_municipio string, seq_no int, file_name string, delimiter string, line_no int"


def plain_split(text, d):
    """Brute force: fields and whether the quoting is bad."""
    text, fields, i = text or "", [], 0
    while True:
        if text[i : i + 1] == "'":
            j, value = i + 1, ""
            while j < len(text):
                if text[j] == "'":
                    if text[j + 1 : j + 2] == "'":
                        value, j = value + "'", j + 2
                        continue
                    break
                value, j = value + text[j], j + 1
            if j >= len(text) or text[j + 1 : j + 2] not in ("", d):
                return fields, True
            fields.append(value)
            i = j + 1
        else:
            j = text.find(d, i)
            j = len(text) if j < 0 else j
            fields.append(text[i:j])
            i = j
        if i >= len(text):
            return fields, False
        i += 1


def test_split_against_plain_reader(spark):
    rng = random.Random(5)
    rows = [("".join(rng.choice("ab';,|\t\n' ") for _ in range(rng.randint(0, 14))), rng.choice(";,|\t")) for _ in range(1500)]
    rows += [(None, ";"), ("", ";"), ("'" + "''" * 20_000 + "'", ";"), ("a;" * 5_000, ";"), ("'x" * 3_000, ";"), ("1x2", "x")]
    df = spark.createDataFrame(rows, "t string, d string").withColumn("r", split_record(F.col("t"), F.col("d")))
    for r in df.collect():
        fields, bad = plain_split(r.t, r.d)
        assert r.r.bad_quoting == bad, r.t
        if not bad:
            assert r.r.fields == fields, (r.t, r.d)


def tables(spark, lines, files):
    return (
        spark.createDataFrame([(*x, "99", "zz") for x in lines], LINES),
        spark.createDataFrame([(*x, 7) for x in files], FILES),
    )


FILE = (1, "m", 1, "f", ";")
HEAD = "base_de_calculo;data_pagamento;area_constr_privativa;bairro"


@pytest.mark.parametrize(
    "text, reason",
    [
        ("1.234,56;31/12/2020;10;X", None),
        ("R$ 1.234.567;2020/02/29 23:59:59;1,5;X", None),
        ("R$1;;-;'a;b'", None),
        (" 12 ; 01/01/2020 01:02:03 ;n/a;", None),
        ("'1;01/01/2020;1;X", "quoting"),
        ("'1'x;01/01/2020;1;X", "quoting"),
        ("1;01/01/2020;1", "field_count"),
        ("", "field_count"),
        (None, "field_count"),
        ("1.23.456;01/01/2020;1;X", "bad_base_de_calculo"),
        ("-1;01/13/2020;x;X", "bad_base_de_calculo"),
        ("1;29/02/2021;x;X", "bad_data_pagamento"),
        ("1;2020/01/01;1;X", "bad_data_pagamento"),
        ("1;01/01/2020 24:00:00;1;X", "bad_data_pagamento"),
        ("1;01/01/0000;1;X", "bad_data_pagamento"),
        ("1;01/01/2020;1,234,56;X", "bad_area_constr_privativa"),
        ("R$  1;01/01/2020;1;X", "bad_base_de_calculo"),
        ("1;01/01/2020;10 m;X' '", "bad_area_constr_privativa"),
    ],
)
def test_reasons(spark, text, reason):
    lines, files = tables(spark, [(1, 1, HEAD), (1, 2, text), (1, 2, text)], [FILE])
    got = [(r.line_no, r.reason) for r in bad_rows.parse_failures(lines, files).collect()]
    assert got == ([(2, reason)] if reason else [])


def test_unlisted_file_missing_header_and_empty_tables(spark):
    lines, files = tables(spark, [(1, 1, HEAD), (1, 2, "1;01/01/2020;1;X"), (2, 2, "'a"), (2, 3, "a;b")], [])
    assert [(r.file_id, r.line_no, r.reason) for r in bad_rows.parse_failures(lines, files).collect()] == [(2, 2, "quoting")]
    assert bad_rows.parse_failures(lines.limit(0), files).count() == 0
    assert layouts.layout_changes(lines.limit(0), files).count() == 0
    valid = bad_rows.valid_records(lines, bad_rows.parse_failures(lines, files))
    assert sorted((r.file_id, r.line_no) for r in valid.collect()) == [(1, 2), (2, 3)]


def test_layout_changes(spark):
    rows = ["1;A", "2;B", "3;", "x;C", "5;D"]
    body = lambda f, values: [(f, i + 2, v) for i, v in enumerate(values)]
    lines, files = tables(
        spark,
        [(1, 1, "n_endereco;bairro"), *body(1, rows)]
        + [(2, 1, "BAIRRO;'Num Endereço';extra"), *body(2, ["A;1,5;9", "B;2,5;", "C;3,5;1", "D;4;2", "E;5,1;2"])]
        + [(3, 1, "bairro;numero_endereco;área_constr_total_averbada"), *body(3, ["A;1,5;9"])]
        + [(9, 1, "bairro"), (9, 2, "x")],
        [(1, "m", 1, "a", ";"), (2, "m", 2, "b", ";"), (3, "m", 3, "c", ";"), (9, "other", 1, "d", ";"), (5, "m", 4, "no header", ";")],
    )
    got = sorted((r.file_id, r.column_name, r.change_kind) for r in layouts.layout_changes(lines, files).collect())
    assert got == [
        (2, "extra", "added"),
        (2, "n_endereco", "renamed"),
        (2, "n_endereco", "type_changed"),
        (3, "area_constr_total_averbada", "added"),
        (3, "extra", "removed"),
        (3, "n_endereco", "renamed"),
    ]


def test_layout_changes_come_from_the_ingested_rows(spark, monkeypatch):
    lines, files = tables(
        spark,
        [(1, 1, "area_constr_total;fracao"), (1, 2, "1;1"), (1, 3, "broken"), (2, 1, "area_constr_total;fracao"), (2, 2, "1,5;x"), (3, 1, "area_constr_total;fracao")],
        [(1, "m", 1, "a", ";"), (2, "m", 2, "b", ";"), (3, "m", 3, "c", ";")],
    )
    read = lambda df: sorted((r.file_id, r.column_name, r.change_kind) for r in df.collect())
    want = [(2, "area_constr_total", "type_changed"), (2, "fracao", "type_changed")]
    kept = layouts.promote(layouts.ingest(lines, files), {"fracao": "double"})
    calls, ingest = [], layouts.ingest
    monkeypatch.setattr(layouts, "ingest", lambda *a: calls.append(a) or ingest(*a))
    assert read(layouts.layout_changes(lines, files, ingested=kept)) == want and not calls
    assert read(layouts.layout_changes(lines, files)) == want and len(calls) == 1
    assert read(layouts.layout_changes(lines, files, ingested=kept.where("file_id <> 2"))) == []


def test_rescue_promote_replay(spark):
    lines, files = tables(spark, [(1, 1, "area_constr_total;fracao;cep"), (1, 2, "1.5;0,25;1"), (1, 3, "10 m2;z;"), (1, 4, "broken")], [FILE])
    table = layouts.ingest(lines, files)
    rows = {r.line_no: r for r in table.collect()}
    assert rows[2].area_constr_total == 1.5 and rows[2]._rescued == '{"fracao":"0,25"}'
    assert rows[3].area_constr_total is None and '"area_constr_total":"10 m2"' in rows[3]._rescued
    assert rows[4]._rescued == '{"_record":"broken"}' and rows[4].cep is None
    promoted = {r.line_no: r for r in layouts.promote(table, {"fracao": "double"}).collect()}
    assert promoted[2].fracao == 0.25 and promoted[2]._rescued is None
    assert promoted[3].fracao is None and '"fracao":"z"' in promoted[3]._rescued
    with pytest.raises(ValueError):
        layouts.promote(table, {"CEP": "string"})
    replayed = {r.line_no: r for r in layouts.replay(table, {"area_constr_total": "double"}).collect()}
    assert replayed[3].area_constr_total == 102.0  # the lenient reader keeps digits only
    assert replayed[3]._rescued == '{"fracao":"z"}'


def test_duplicate_and_empty_headers(spark):
    lines, files = tables(spark, [(1, 1, "cep;CEP;;numero_unidade;n_unidade"), (1, 2, "1;2;3;4;5")], [FILE])
    row = layouts.ingest(lines, files).first()
    assert row.cep == "1" and row.n_unidade == "5"
    assert row._rescued == '{"cep_2":"2","_c2":"3","numero_unidade":"4"}'


def test_a_name_beside_its_own_suffix(spark):
    """``a;a;a_2``: no two columns of a file have one name, and no cell is lost."""
    lines = spark.createDataFrame([(1, 1, "a;a;a_2;A_2"), (1, 2, "1;2;3;4")], "file_id long, line_no int, raw_text string")
    files_ = spark.createDataFrame([(1, ";")], "file_id long, delimiter string")
    row = layouts.ingest(lines, files_).first()
    import json

    assert sorted(json.loads(row["_rescued"]).values()) == ["1", "2", "3", "4"]


def test_renames_that_say_nothing_alike_are_found_by_values(spark):
    """A repeating column by its values, one of ids by its notation and a word; what goes and what comes by chance stays."""
    import random

    rng = random.Random(5)
    heads = {1: "bairro;padrao;codigo_lote;andares", 2: "bairro;qualidade;cod_terreno;observacao", 3: "bairro;qualidade;cod_terreno;observacao", 4: "bairro;nivel;cod_terreno;observacao"}
    rows = []
    for f, head in heads.items():
        rows.append((f, 1, head))
        for n in range(60):
            last = str(rng.randint(1, 30)) if f == 1 else rng.choice(["sem obs", "ver processo 12", "na esquina"])
            rows.append((f, n + 2, f"B{n % 7};{rng.choice(['ALTO', 'MEDIO', 'BAIXO'])};{rng.randint(10_000, 19_999)};{last}"))
    lines = spark.createDataFrame(rows, "file_id long, line_no int, raw_text string")
    files_ = spark.createDataFrame([(f, ";", "m", f) for f in heads], "file_id long, delimiter string, cod_municipio string, seq_no int")
    got = {(r.file_id, r.column_name, r.change_kind) for r in layouts.layout_changes(lines, files_).collect()}
    assert got == {(2, "padrao", "renamed"), (2, "codigo_lote", "renamed"), (2, "andares", "removed"), (2, "observacao", "added"), (4, "padrao", "renamed")}
    assert layouts.resolve_names(lines.limit(0), files_).count() == 0
