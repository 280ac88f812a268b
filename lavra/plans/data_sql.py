"""SQL for the queries of the general data problems."""

NULL_TOKENS = "('', 'nan', 'none', 'null', 'na', 'n/a', '<na>', '-')"


def _cells(table: str, columns: dict[str, bool]) -> str:
    parts = []
    for c, number in columns.items():
        text = "CAST(NULL AS VARCHAR)" if number else f"CASE WHEN lower(trim({c})) IN {NULL_TOKENS} THEN NULL ELSE {c} END"
        num = f"CASE WHEN isnan(CAST({c} AS DOUBLE)) THEN NULL ELSE CAST({c} AS DOUBLE) END" if number else "CAST(NULL AS DOUBLE)"
        parts.append(f"SELECT load_id, '{c}' AS column_name, {text} AS tv, {num} AS nv FROM {table}")
    return " UNION ALL ".join(parts)


P2_FOUND = f"""
WITH cells AS ({_cells("itbi_units", {"bairro": False, "situacao": False, "cep": False, "area_constr_privativa": True})}
  UNION ALL {_cells("market_indicators_city_year", {"n_transacoes": True})}),
counts AS (SELECT load_id, column_name, tv, nv, count(*) AS n FROM cells GROUP BY ALL),
prof AS (SELECT load_id, column_name, sum(n) AS n_rows, coalesce(sum(n) FILTER (tv IS NULL AND nv IS NULL), 0) AS n_null,
    count(*) FILTER (tv IS NOT NULL OR nv IS NOT NULL) AS nd,
    coalesce(sum(n) FILTER (NOT regexp_full_match(tv, CASE column_name WHEN 'bairro' THEN '[A-ZÀ-Ý0-9'' .-]{{3,40}}'
      WHEN 'situacao' THEN 'PAGO|CANCELADO|EM ABERTO|PARCELADO|ISENTO' ELSE '[0-9]{{8}}' END)), 0) AS n_pattern,
    coalesce(sum(n) FILTER ((column_name = 'area_constr_privativa' AND (nv < 0 OR nv > 20000)) OR (column_name = 'n_transacoes' AND nv < 1)), 0) AS n_range
  FROM counts GROUP BY ALL),
sided AS (SELECT p.*, l.baseline_load_id AS bl, b.n_rows AS b_rows, b.n_null AS b_null, b.nd AS b_nd
  FROM prof p LEFT JOIN load_log l USING (load_id) LEFT JOIN prof b ON b.load_id = l.baseline_load_id AND b.column_name = p.column_name),
pairs AS (SELECT load_id, column_name, tv, nv, sum(a) AS a, sum(b) AS b FROM (
    SELECT c.load_id, c.column_name, tv, nv, n AS a, 0 AS b FROM counts c JOIN load_log l USING (load_id) WHERE baseline_load_id IS NOT NULL
    UNION ALL SELECT l.load_id, c.column_name, tv, nv, 0, n FROM counts c JOIN load_log l ON l.baseline_load_id = c.load_id)
  WHERE tv IS NOT NULL OR nv IS NOT NULL GROUP BY ALL),
shares AS (SELECT *, sum(a) OVER w AS na, sum(b) OVER w AS nb, sum(a) OVER o AS ca, sum(b) OVER o AS cb FROM pairs
  WINDOW w AS (PARTITION BY load_id, column_name), o AS (PARTITION BY load_id, column_name ORDER BY nv, tv ROWS UNBOUNDED PRECEDING)),
moved AS (SELECT load_id, column_name, sum(abs(a / na - b / nb)) / 2 AS l1, max(abs(ca / na - cb / nb)) AS ks FROM shares WHERE na > 0 AND nb > 0 GROUP BY ALL)
SELECT load_id, column_name, 'null_rate' AS finding FROM sided WHERE abs(n_null * b_rows - b_null * n_rows) * 25 > n_rows * b_rows
UNION ALL SELECT load_id, column_name, 'range' FROM prof WHERE n_range > 0
UNION ALL SELECT load_id, column_name, 'pattern' FROM prof WHERE column_name IN ('bairro', 'situacao', 'cep') AND n_rows > n_null AND n_pattern * 100 >= n_rows - n_null
UNION ALL SELECT load_id, column_name, 'distinct_count' FROM sided WHERE column_name IN ('bairro', 'situacao') AND (nd > 0 OR b_nd > 0) AND (nd >= 2 * b_nd OR nd * 2 <= b_nd)
UNION ALL SELECT load_id, column_name, 'distribution' FROM moved WHERE CASE WHEN column_name IN ('bairro', 'situacao') THEN l1 > 0.3 + 1e-12
  WHEN column_name IN ('area_constr_privativa', 'n_transacoes') THEN ks > 0.2 + 1e-12 ELSE false END
"""


_UNIT_COLUMNS = {c: c in ("unit_row_id", "source_row", "source_year", "guide_group_id", "base_de_calculo", "perc_transmitido", "area_total_terreno", "area_constr_total", "area_constr_privativa", "ano_construcao") for c in (
    "unit_row_id", "source_row", "source_year", "guide_group_id", "cod_municipio", "data_estimativa", "data_pagamento", "base_de_calculo", "perc_transmitido", "finalidade_construcao", "logradouro", "n_endereco", "n_unidade",
    "complemento_endereco", "bairro", "cep", "area_total_terreno", "area_constr_total", "area_constr_privativa", "ano_construcao", "n_matricula_reg_imoveis", "n_zona_reg_imoveis", "situacao", "carga_em")}
_YEAR_COLUMNS = {c: c not in ("cod_municipio", "flag_ano_incompleto") for c in (
    "cod_municipio", "ano_analise", "n_transacoes", "n_unidades", "base_mediana_real", "base_p25_real", "base_p75_real", "valor_m2_mediano_real", "area_mediana_m2", "meses_observados", "flag_ano_incompleto")}


def _profile(table: str, columns: dict[str, bool], name: str, pattern: str, in_range: str) -> str:
    """CTEs ``<name>``: the profile of each load and column of one table with its changes against the baseline load."""
    given = "tv IS NOT NULL OR nv IS NOT NULL"
    cells = _cells(table, columns).replace("lower(trim(data_estimativa))", "lower(trim(CAST(data_estimativa AS VARCHAR)))")
    for c in ("data_estimativa", "data_pagamento", "carga_em", "flag_ano_incompleto"):
        cells = cells.replace(f"lower(trim({c}))", f"lower(trim(CAST({c} AS VARCHAR)))").replace(f"ELSE {c} END", f"ELSE CAST({c} AS VARCHAR) END")
    return f"""{name}_n AS (SELECT load_id, column_name, tv, nv, count(*) AS n FROM ({cells}) GROUP BY ALL),
{name}_p AS (SELECT load_id, column_name, CAST(sum(n) AS BIGINT) AS n_rows, CAST(coalesce(sum(n) FILTER (tv IS NULL AND nv IS NULL), 0) AS BIGINT) AS n_null, count(*) FILTER ({given}) AS n_distinct, min(nv) AS num_min, max(nv) AS num_max,
    min(tv) AS text_min, max(tv) AS text_max, log2(sum(n) FILTER ({given})) - sum(n * log2(n)) FILTER ({given}) / sum(n) FILTER ({given}) AS entropy_bits,
    CAST(coalesce(sum(n) FILTER ({pattern}), 0) AS BIGINT) AS n_pattern, CAST(coalesce(sum(n) FILTER ({in_range}), 0) AS BIGINT) AS n_range FROM {name}_n GROUP BY ALL),
{name}_w AS (SELECT load_id, column_name, tv, nv, sum(a) AS a, sum(b) AS b FROM (
    SELECT c.load_id, column_name, tv, nv, n AS a, 0 AS b FROM {name}_n c JOIN load_log l USING (load_id) WHERE table_name = '{table}' AND baseline_load_id IS NOT NULL
    UNION ALL SELECT l.load_id, column_name, tv, nv, 0, n FROM {name}_n c JOIN load_log l ON l.baseline_load_id = c.load_id AND table_name = '{table}') WHERE {given} GROUP BY ALL),
{name}_c AS (SELECT *, sum(a) OVER w AS na, sum(b) OVER w AS nb, sum(a) OVER o AS ca, sum(b) OVER o AS cb FROM {name}_w
  WINDOW w AS (PARTITION BY load_id, column_name), o AS (PARTITION BY load_id, column_name ORDER BY nv, tv ROWS UNBOUNDED PRECEDING)),
{name}_s AS (SELECT load_id, column_name, CASE WHEN any_value(tv) IS NOT NULL THEN sum(abs(a / na - b / nb)) / 2 ELSE max(abs(ca / na - cb / nb)) END AS shift FROM {name}_c WHERE na > 0 AND nb > 0 GROUP BY ALL),
{name} AS (SELECT p.*, p.n_null / p.n_rows AS null_rate, l.baseline_load_id, p.n_null / p.n_rows - b.n_null / b.n_rows AS null_rate_change, p.n_distinct - b.n_distinct AS n_distinct_change, shift
  FROM {name}_p p LEFT JOIN (SELECT * FROM load_log WHERE table_name = '{table}') l USING (load_id) LEFT JOIN {name}_p b ON b.load_id = l.baseline_load_id AND b.column_name = p.column_name
  LEFT JOIN {name}_s s ON s.load_id = p.load_id AND s.column_name = p.column_name)"""


_OFF = """column_name IN ('bairro', 'situacao', 'cep') AND NOT regexp_full_match(tv, CASE column_name WHEN 'bairro' THEN '[A-ZÀ-Ý0-9'' .-]{3,40}' WHEN 'situacao' THEN 'PAGO|CANCELADO|EM ABERTO|PARCELADO|ISENTO' ELSE '[0-9]{8}' END)"""
_ROUNDED = "* REPLACE (round(entropy_bits, 6) AS entropy_bits, round(null_rate, 9) AS null_rate, round(null_rate_change, 9) AS null_rate_change, round(shift, 9) AS shift)"
P2_PROFILE = f"""WITH {_profile("itbi_units", _UNIT_COLUMNS, "u", _OFF, "column_name = 'area_constr_privativa' AND (nv < 0 OR nv > 20000)")},
{_profile("market_indicators_city_year", _YEAR_COLUMNS, "y", "false", "column_name = 'n_transacoes' AND nv < 1")}
SELECT {_ROUNDED} FROM u UNION ALL SELECT {_ROUNDED} FROM y"""


REGISTER = """reg AS (SELECT DISTINCT cod_unico_endereco AS id, cod_municipio AS m, cod_setor, la AS lat, lo AS lon FROM (
  SELECT *, try_cast(replace(trim(latitude), ',', '.') AS DOUBLE) AS la, try_cast(replace(trim(longitude), ',', '.') AS DOUBLE) AS lo FROM address_register)
  WHERE la <> 0 AND lo <> 0 AND isfinite(la) AND isfinite(lo))"""

HELD = f"""{REGISTER}, rings AS (SELECT cd_setor, cd_mun, unnest(regexp_extract_all(geometry_wkt, '\\(([^()]+)\\)', 1)) AS ring, generate_subscripts(regexp_extract_all(geometry_wkt, '\\(([^()]+)\\)', 1), 1) AS k FROM census_sectors),
pts AS (SELECT cd_setor, cd_mun, k, unnest(string_split(ring, ', ')) AS p, generate_subscripts(string_split(ring, ', '), 1) AS i FROM rings),
xy AS (SELECT cd_setor, cd_mun, k, i, CAST(split_part(p, ' ', 1) AS DOUBLE) AS x, CAST(split_part(p, ' ', 2) AS DOUBLE) AS y FROM pts),
edges AS (SELECT * FROM (SELECT cd_setor, cd_mun, x AS x1, y AS y1, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM xy WINDOW w AS (PARTITION BY cd_setor, k ORDER BY i)) WHERE x2 <> x1),
held AS (SELECT r.id, r.cod_setor, r.lat, r.lon, e.cd_setor FROM reg r JOIN edges e ON r.m = e.cd_mun AND (e.x1 <= r.lon) <> (e.x2 <= r.lon) AND r.lat < y1 + (y2 - y1) * (r.lon - x1) / (x2 - x1)
  GROUP BY r.id, r.cod_setor, r.lat, r.lon, e.cd_setor HAVING count(*) % 2 = 1)"""

P4_FOUND = f"""WITH {HELD}, near AS (SELECT DISTINCT least(a.id, b.id) AS id_a, greatest(a.id, b.id) AS id_b FROM reg a JOIN reg b ON a.m = b.m AND a.id < b.id AND b.lat BETWEEN a.lat - 0.0002 AND a.lat + 0.0002
  WHERE 2 * 6371000 * asin(sqrt(least(1, pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2)))) <= 20)
SELECT 'near' AS kind, id_a, id_b FROM near
UNION ALL SELECT DISTINCT 'sector', id, CAST(cd_setor AS BIGINT) FROM held WHERE coalesce(left(regexp_replace(cod_setor, '[^0-9]', '', 'g'), 15), '') <> cd_setor"""

P4_SECTORS = f"WITH {HELD} SELECT DISTINCT id AS cod_unico_endereco, lat, lon, cd_setor FROM held"

#: Names of the test files' headers and what they stand for.
RENAMED = {
    "percentual_transmitido": "perc_transmitido", "pct_transmitido": "perc_transmitido", "perc_transm": "perc_transmitido", "numero_endereco": "n_endereco", "num_endereco": "n_endereco",
    "numero_unidade": "n_unidade", "nr_unidade": "n_unidade", "area_construida_total": "area_constr_total", "area_total_construida": "area_constr_total", "area_constr_tot": "area_constr_total",
    "area_construida_privativa": "area_constr_privativa", "area_priv_construida": "area_constr_privativa", "numero_matricula_reg_imoveis": "n_matricula_reg_imoveis",
    "nr_matricula_ri": "n_matricula_reg_imoveis", "matricula_reg_imoveis": "n_matricula_reg_imoveis", "numero_zona_reg_imoveis": "n_zona_reg_imoveis", "zona_ri": "n_zona_reg_imoveis",
}
_FIELD = "''(?:[^'']|'''')*''|[^''' || d || '][^' || d || ']*|"
_NAME = "regexp_replace(regexp_replace(lower(strip_accents(replace(replace(x, chr(65279), ''), '''', ''))), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')"
RECORDS = f"""heads AS (SELECT file_id, delimiter AS d, list_transform(string_split(raw_text, delimiter), lambda x: {_NAME}) AS names FROM raw_lines JOIN raw_files USING (file_id) WHERE line_no = 1),
named AS (SELECT *, list_transform(names, lambda x: coalesce(MAP {{{", ".join(f"'{k}': '{v}'" for k, v in RENAMED.items())}}}[x], x)) AS cols FROM heads),
recs AS (SELECT file_id, line_no, d, names, cols, coalesce(raw_text, '') AS t FROM raw_lines JOIN named USING (file_id) WHERE line_no > 1),
split AS (SELECT *, regexp_full_match(t, '(?:{_FIELD})(?:[' || d || '](?:{_FIELD}))*') AS fine, list_transform(regexp_extract_all(t || d, '({_FIELD})[' || d || ']', 1),
  lambda x: CASE WHEN starts_with(x, '''') THEN replace(x[2:-2], '''''', '''') ELSE x END) AS fields FROM recs)"""
_NUMBER = r"(R\$ ?)?([0-9]+([.,][0-9]+)?|[0-9]{1,3}(\.[0-9]{3})+(,[0-9]+)?|[0-9]{1,3}(,[0-9]{3})+(\.[0-9]+)?)"


def _number(v: str) -> str:
    return f"regexp_full_match(trim({v}), '{_NUMBER}')"


def _date(v: str) -> str:
    shape = "[0-9]{4}/[0-9]{2}/[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}( [0-9]{2}:[0-9]{2}:[0-9]{2})?"
    return f"(regexp_full_match(trim({v}), '{shape}') AND try_strptime(trim({v}), ['%Y/%m/%d %H:%M:%S', '%d/%m/%Y', '%d/%m/%Y %H:%M:%S']) IS NOT NULL)"


def _given(v: str) -> str:
    return f"({v} IS NOT NULL AND lower(trim({v})) NOT IN {NULL_TOKENS})"


P6_FOUND = f"""WITH {RECORDS}, v AS (SELECT *, fields[list_position(cols, 'base_de_calculo')] AS base, fields[list_position(cols, 'data_pagamento')] AS pay, fields[list_position(cols, 'area_constr_privativa')] AS area FROM split),
r AS (SELECT DISTINCT file_id, line_no, CASE WHEN NOT fine THEN 'quoting' WHEN len(fields) <> len(cols) THEN 'field_count' WHEN {_given("base")} AND NOT {_number("base")} THEN 'bad_base_de_calculo'
  WHEN {_given("pay")} AND NOT {_date("pay")} THEN 'bad_data_pagamento' WHEN {_given("area")} AND NOT {_number("area")} THEN 'bad_area_constr_privativa' END AS reason FROM v)
SELECT * FROM r WHERE reason IS NOT NULL"""

P3_FOUND = f"""WITH {RECORDS}, cells AS (SELECT file_id, unnest(cols) AS column_name, unnest(fields) AS v FROM split WHERE fine AND len(fields) = len(cols)),
kinds AS (SELECT file_id, column_name, CASE WHEN count(*) FILTER (regexp_full_match(trim(v), '[0-9]+')) * 5 >= count(*) * 4 THEN 'integer' WHEN count(*) FILTER ({_number("v")}) * 5 >= count(*) * 4 THEN 'decimal'
  WHEN count(*) FILTER ({_date("v")}) * 5 >= count(*) * 4 THEN 'timestamp' ELSE 'text' END AS kind FROM cells WHERE {_given("v")} GROUP BY ALL),
described AS (SELECT n.file_id, n.column_name, n.name, kind FROM (SELECT file_id, unnest(cols) AS column_name, unnest(names) AS name FROM named) n LEFT JOIN kinds USING (file_id, column_name)),
chain AS (SELECT file_id, lag(file_id) OVER (PARTITION BY cod_municipio ORDER BY seq_no) AS before FROM raw_files WHERE file_id IN (SELECT file_id FROM heads)),
later AS (SELECT d.*, before FROM described d JOIN chain USING (file_id) WHERE before IS NOT NULL), old AS (SELECT c.file_id, d.column_name, d.name, d.kind FROM chain c JOIN described d ON d.file_id = c.before),
sides AS (SELECT coalesce(l.file_id, o.file_id) AS file_id, coalesce(l.column_name, o.column_name) AS column_name, l.name AS n1, o.name AS n0, l.kind AS k1, o.kind AS k0
  FROM later l FULL JOIN old o ON l.file_id = o.file_id AND l.column_name = o.column_name)
SELECT file_id, column_name, 'added' AS change_kind FROM sides WHERE n0 IS NULL UNION ALL SELECT file_id, column_name, 'removed' FROM sides WHERE n1 IS NULL
UNION ALL SELECT file_id, column_name, 'renamed' FROM sides WHERE n1 <> n0 UNION ALL SELECT file_id, column_name, 'type_changed' FROM sides WHERE k1 <> k0"""



#: Target columns by type, in their order.
_TEXTS = ("finalidade_construcao", "logradouro", "n_endereco", "n_unidade", "complemento_endereco", "bairro", "cep", "n_matricula_reg_imoveis", "n_zona_reg_imoveis", "situacao")
_DATES = ("data_estimativa", "data_pagamento")
_DOUBLES = ("base_de_calculo", "perc_transmitido", "area_total_terreno", "area_constr_total", "area_constr_privativa")
_INTS = ("ano_construcao",)


def _strict(v: str) -> str:
    t = f"regexp_replace({v}, '^R\\$ ?', '')"
    plain = (
        f"CASE WHEN regexp_matches({t}, '^[0-9]{{1,3}}(\\.[0-9]{{3}})+,|^[0-9]{{1,3}}(\\.[0-9]{{3}}){{2,}}$') THEN replace(replace({t}, '.', ''), ',', '.') "
        f"WHEN regexp_matches({t}, '^[0-9]{{1,3}}(,[0-9]{{3}})+\\.|^[0-9]{{1,3}}(,[0-9]{{3}}){{2,}}$') THEN replace({t}, ',', '') ELSE replace({t}, ',', '.') END"
    )
    return f"CASE WHEN {_number(v)} THEN try_cast({plain} AS DOUBLE) END"


def _lenient(v: str) -> str:
    t = f"regexp_replace({v}, '[^0-9,.+-]', '', 'g')"
    both = f"contains({t}, ',') AND contains({t}, '.')"
    plain = f"CASE WHEN {both} AND instr(reverse({t}), ',') < instr(reverse({t}), '.') THEN replace(replace({t}, '.', ''), ',', '.') WHEN {both} THEN replace({t}, ',', '') ELSE replace({t}, ',', '.') END"
    return f"CASE WHEN regexp_full_match({plain}, '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?') THEN try_cast({plain} AS DOUBLE) END"


def _day(v: str) -> str:
    iso = f"regexp_replace(regexp_replace({v}, '^([0-9]{{1,2}})[-/]([0-9]{{1,2}})[-/]([0-9]{{4}})($|[ T])', '\\3-\\2-\\1\\4'), '^([0-9]{{4}})[-/]([0-9]{{1,2}})[-/]([0-9]{{1,2}})($|[ T])', '\\1-\\2-\\3\\4')"
    return f"CASE WHEN regexp_matches({iso}, '^[0-9]{{4}}-[0-9]{{1,2}}-[0-9]{{1,2}}($|[ T])') THEN try_cast({iso} AS TIMESTAMP) END"


def _ingested(replayed: bool) -> str:
    """CTEs up to ``typed``: the records with typed columns and what could not be typed, as ``_rescued``."""
    number = (lambda v: f"coalesce({_strict(v)}, {_lenient(v)})") if replayed else _strict
    date = _day if replayed else (lambda v: f"CASE WHEN {_date(v)} THEN {_day(v)} END")

    def whole(v: str) -> str:
        strict = f"CASE WHEN {_strict(v)} = floor({_strict(v)}) THEN CAST({_strict(v)} AS INTEGER) END"
        return f"coalesce({strict}, try_cast(trunc({_lenient(v)}) AS INTEGER))" if replayed else strict

    made = {c: f"r_{c}" for c in _TEXTS} | {c: date(f"r_{c}") for c in _DATES} | {c: number(f"r_{c}") for c in _DOUBLES} | {c: whole(f"r_{c}") for c in _INTS}
    more = {"inscricao_cadastral": "r_inscricao_cadastral", "fracao_ideal": number("r_fracao_ideal")} if replayed else {}
    names = [*made, *more]
    sound = "fine AND len(fields) = len(cols)"
    raw = ", ".join(f"CASE WHEN {sound} AND {_given(f'trim(fields[list_position(cols, {chr(39)}{c}{chr(39)})])')} THEN trim(fields[list_position(cols, '{c}')]) END AS r_{c}" for c in names)
    typed = ", ".join(f"{v} AS {c}" for c, v in (made | more).items())
    failed = ", ".join(f"CASE WHEN {c} IS NULL THEN '{c}' END" for c in names if c not in _TEXTS)
    known = ", ".join(f"'{c}'" for c in names)
    return f"""{RECORDS}, raw AS (SELECT file_id, line_no, t, cols, fields, {sound} AS sound, {raw} FROM split), cast_ AS (SELECT *, {typed} FROM raw),
typed AS (SELECT file_id, line_no, {", ".join(names)}, CASE WHEN NOT sound THEN '{{"_record":' || to_json(t) || '}}' ELSE nullif('{{' || array_to_string(list_transform(list_filter(list_zip(cols, list_transform(fields, lambda f: trim(f))),
  lambda p: lower(p[2]) NOT IN {NULL_TOKENS} AND (NOT list_contains([{known}], p[1]) OR coalesce(list_contains([{failed}], p[1]), false))), lambda p: to_json(p[1]) || ':' || to_json(p[2])), ',') || '}}', '{{}}') END AS _rescued FROM cast_)"""


P3_INGESTED = f"WITH {_ingested(True)} SELECT * FROM typed"
P6_VALID = f"WITH {_ingested(False)}, bad AS ({P6_FOUND}) SELECT typed.* FROM typed ANTI JOIN bad USING (file_id, line_no)"
