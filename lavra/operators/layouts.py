"""Problem 3: files whose columns are added, removed, renamed or retyped.

Rescue-column ingestion: every record is read into one target schema; cells of unknown columns and cells that
do not cast are kept, as text, in the JSON column ``_rescued``; ``promote`` turns approved rescued fields into
typed columns and ``replay`` casts rescued cells of target columns again with a better reader. The ingested
rows also carry how each cell was written (``_kinds``), from which ``layout_changes`` reports drift.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lavra.contracts import require_columns
from lavra.functions.dates import STRICT_DATE, parse_date
from lavra.functions.numbers import STRICT_NUMBER, strict_number
from lavra.functions.text import UNIT_NULL_TOKENS, header_key, let, strip
from lavra.operators.records import FileLayout, once, parse_records, read_headers
from lavra.session import materialize

# Canonical columns of a unit file with their types, and the listed aliases.
UNIT_SCHEMA = {
    "data_estimativa": "timestamp_ntz",
    "data_pagamento": "timestamp_ntz",
    "base_de_calculo": "double",
    "perc_transmitido": "double",
    "finalidade_construcao": "string",
    "logradouro": "string",
    "n_endereco": "string",
    "n_unidade": "string",
    "complemento_endereco": "string",
    "bairro": "string",
    "cep": "string",
    "area_total_terreno": "double",
    "area_constr_total": "double",
    "area_constr_privativa": "double",
    "ano_construcao": "int",
    "n_matricula_reg_imoveis": "string",
    "n_zona_reg_imoveis": "string",
    "situacao": "string",
}
UNIT_ALIASES = {
    "percentual_transmitido": "perc_transmitido",
    "numero_endereco": "n_endereco",
    "numero_unidade": "n_unidade",
    "area_construida_total": "area_constr_total",
    "area_construida_privativa": "area_constr_privativa",
    "numero_matricula_reg_imoveis": "n_matricula_reg_imoveis",
    "numero_zona_reg_imoveis": "n_zona_reg_imoveis",
}

#: Words of header names that say the same thing; an unlisted name is the column whose words it says.
HEADER_WORDS = {
    "percentual": "perc", "pct": "perc", "porc": "perc", "transm": "transmitido", "tot": "total", "priv": "privativa",
    "privat": "privativa", "construida": "constr", "construido": "constr", "const": "constr", "ri": "reg imoveis", "registro_imoveis": "reg imoveis",
    "compl": "complemento", "end": "endereco", "ender": "endereco", "unid": "unidade", "matr": "matricula", "mat": "matricula", "dt": "data",
    "pgto": "pagamento", "pagto": "pagamento", "estim": "estimativa", "calc": "calculo", "logr": "logradouro", "sit": "situacao", "finalid": "finalidade",
}
#: Words that only say "number of" or link others.
EMPTY_WORDS = ("n", "no", "nr", "num", "nro", "numero", "de", "da", "do", "das", "dos")

KINDS = ("null", "integer", "decimal", "timestamp", "text")


@dataclass(frozen=True)
class TargetSchema:
    """Canonical columns with types, listed aliases, and the words used to recognise unlisted names."""

    columns: dict[str, str] = field(default_factory=lambda: dict(UNIT_SCHEMA))
    aliases: dict[str, str] = field(default_factory=lambda: dict(UNIT_ALIASES))
    words: dict[str, str] = field(default_factory=lambda: dict(HEADER_WORDS))
    empty_words: tuple[str, ...] = EMPTY_WORDS

    def signature(self, name: str) -> str:
        said = " ".join(self.words.get(w, w) for w in name.split("_")).split()
        return " ".join(sorted({w for w in said if w not in self.empty_words}))


UNITS = TargetSchema()


def _literal_map(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair]) if pairs else F.lit(None).cast("map<string,string>")


def signature(name: Column, schema: TargetSchema) -> Column:
    """The sorted words a header name says, abbreviations spelled out."""
    words = F.flatten(F.transform(F.split(name, "_"), lambda w: F.split(F.coalesce(F.try_element_at(_literal_map(schema.words), w), w), " ")))
    return F.array_join(F.array_sort(F.array_distinct(F.filter(words, lambda w: ~w.isin(*schema.empty_words)))), " ")


def resolve_headers(headers: DataFrame, schema: TargetSchema = UNITS) -> DataFrame:
    """One row per file and column: ``file_id, pos, name, column_name, known``.

    ``name`` is the header in snake case; ``column_name`` the target column it stands for (by its own name, by
    a listed alias, or by saying the same words), else ``name`` itself. Of several headers for one column the
    most direct one, then the first, takes it; the others keep their own names, with ``_2`` and so on where a
    name repeats (and the position where the file has that name too). An empty header is named ``_c`` and its position.
    """
    cells = headers.select("file_id", F.posexplode("headers").alias("pos", "raw"))
    own = F.coalesce(F.nullif(header_key(F.col("raw")), F.lit("")), F.concat(F.lit("_c"), F.col("pos").cast("string")))
    cells = cells.select("file_id", "pos", own.alias("name"))
    by_name = F.try_element_at(_literal_map({c: c for c in schema.columns}), F.col("name"))
    by_alias = F.try_element_at(_literal_map(schema.aliases), F.col("name"))
    by_words = F.try_element_at(_literal_map({schema.signature(c): c for c in schema.columns}), signature(F.col("name"), schema))
    cells = cells.select(
        "file_id", "pos", "name",
        F.coalesce(by_name, by_alias, by_words).alias("target"),
        F.when(by_name.isNotNull(), 0).when(by_alias.isNotNull(), 1).otherwise(2).alias("rank"),
    )
    best = Window.partitionBy("file_id", "target").orderBy("rank", "pos")
    cells = cells.withColumn("known", F.col("target").isNotNull() & (F.row_number().over(best) == 1))
    cells = cells.withColumn("column_name", F.when(F.col("known"), F.col("target")).otherwise(F.col("name")))
    nth = F.row_number().over(Window.partitionBy("file_id", "column_name").orderBy(F.col("known").desc(), "pos"))
    cells = cells.withColumn("_nth", nth)
    # A suffix that makes a name of the file again gets its position too, and underscores until it is a name of its own.
    taken = Window.partitionBy("file_id")
    suffixed = F.concat("column_name", F.lit("_"), F.col("_nth").cast("string"))
    cells = cells.withColumn("_all", F.collect_set("column_name").over(taken)).withColumn("_given", F.when(F.col("_nth") == 1, F.col("column_name")).otherwise(suffixed))
    with_place = F.concat("_given", F.lit("_c"), F.col("pos").cast("string"))
    tails = F.transform(F.sequence(F.lit(0), F.size("_all")), lambda i: F.concat(with_place, F.repeat(F.lit("_"), i)))
    free = F.element_at(F.filter(tails, lambda t: ~F.array_contains("_all", t)), 1)
    clash = (F.col("_nth") > 1) & F.array_contains("_all", F.col("_given"))
    return cells.select("file_id", "pos", "name", F.when(clash, free).otherwise(F.col("_given")).alias("column_name"), (F.col("known") & (F.col("_nth") == 1)).alias("known"))


def resolved_headers(lines: DataFrame, files: DataFrame, schema: TargetSchema = UNITS, layout: FileLayout = FileLayout(), names: DataFrame | None = None) -> DataFrame:
    """``read_headers`` with ``columns``: the resolved name of each header in file order (by ``names`` where given, as
    ``resolve_headers`` or ``resolve_names`` make it).

    Written once, so that its size is known: Spark then sends a small table of headers to the records instead of
    shuffling the records to it, and joins by shuffle when there are very many files.
    """
    headers = read_headers(lines, files, layout)
    names = resolve_headers(headers, schema) if names is None else names
    columns = names.groupBy("file_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "column_name"))), lambda s: s["column_name"]).alias("columns"))
    return materialize(headers.join(columns, "file_id", "left"))


def cell_kind(value: Column) -> Column:
    """Index into KINDS of one trimmed cell's notation; null tokens are null by then."""
    return (
        F.when(value.isNull(), 0)
        .when(value.rlike(r"\A[0-9]+\z"), 1)
        .when(value.rlike(STRICT_NUMBER), 2)
        .when(value.rlike(STRICT_DATE), 3)
        .otherwise(4)
        .cast("tinyint")
    )


def cast_cell(value: Column, kind: str) -> Column:
    """A trimmed cell in its target type; null where it does not cast. Null tokens are null in every type."""
    return _cast_given(F.when(~F.lower(value).isin(*UNIT_NULL_TOKENS), value), kind)


def _cast_given(given: Column, kind: str) -> Column:
    if kind == "string":
        return given
    if kind in ("timestamp_ntz", "timestamp"):
        return F.when(given.rlike(STRICT_DATE), parse_date(given)).cast(kind)
    if kind in ("int", "bigint"):
        number = strict_number(given)
        return F.when(number == F.floor(number), number).try_cast(kind)
    return strict_number(given).try_cast(kind)


def read_cells(lines: DataFrame, files: DataFrame, schema: TargetSchema = UNITS, layout: FileLayout = FileLayout(), names: DataFrame | None = None) -> DataFrame:
    """``file_id, line_no, raw_text, _cells``: each data record as a map of resolved column to trimmed text (null for null tokens),
    null for a record whose quoting or number of fields is wrong or whose file has no header."""
    records = parse_records(lines, resolved_headers(lines, files, schema, layout, names), layout)
    sound = ~F.col("record.bad_quoting") & (F.col("record.n_fields") == F.size("columns"))
    cells = F.when(F.coalesce(sound, F.lit(False)), F.map_from_arrays("columns", F.transform("record.fields", lambda f: let(strip(f), lambda t: F.when(~F.lower(t).isin(*UNIT_NULL_TOKENS), t)))))
    return once(records, _cells=cells).select("file_id", "line_no", "raw_text", "_cells")


def ingest(lines: DataFrame, files: DataFrame, schema: TargetSchema = UNITS, layout: FileLayout = FileLayout(), names: DataFrame | None = None) -> DataFrame:
    """All data records in one table: ``file_id, line_no``, the target columns, ``_rescued``, ``_kinds``.

    ``_rescued`` is a JSON object of the texts of unknown columns and of cells that do not cast (null when
    there are none). A record whose quoting or number of fields is wrong, or whose file has no header, has null
    target columns and the whole text rescued under ``_record``. ``_kinds`` maps column to notation and is
    null for such records. Columns of ``lines`` and ``files`` beyond those named in ``layout`` play no part, so
    their names may clash with target columns. ``names`` from ``resolve_names`` puts cells of renamed columns in place.
    """
    records = read_cells(lines, files, schema, layout, names)
    # Bound step by step, so that each cell is looked up, cast and described once.
    records = once(records, **{f"_t_{c}": F.try_element_at("_cells", F.lit(c)) for c in schema.columns})
    records = once(records, **{f"_{c}": _cast_given(F.col(f"_t_{c}"), kind) for c, kind in schema.columns.items() if kind != "string"})
    typed = {c: F.col(f"_t_{c}" if kind == "string" else f"_{c}") for c, kind in schema.columns.items()}
    uncast = F.array_compact(F.array(*[F.when(F.col(f"_t_{c}").isNotNull() & F.col(f"_{c}").isNull(), F.lit(c)) for c, kind in schema.columns.items() if kind != "string"]))
    records = once(records, _failed=uncast, _others=F.array_except(F.map_keys("_cells"), F.array(*[F.lit(c) for c in schema.columns])))
    some = (F.size("_failed") > 0) | (F.size("_others") > 0)
    kept = F.map_filter("_cells", lambda k, v: v.isNotNull() & (F.array_contains("_others", k) | F.array_contains("_failed", k)))
    records = once(records, _kept=F.when(some, kept))
    return records.select(
        "file_id", "line_no",
        *[value.alias(c) for c, value in typed.items()],
        F.when(F.col("_cells").isNull(), F.to_json(F.create_map(F.lit("_record"), F.coalesce("raw_text", F.lit("")))))
        .when(F.size("_kept") > 0, F.to_json("_kept")).alias("_rescued"),
        F.transform_values("_cells", lambda k, v: cell_kind(v)).alias("_kinds"),
    )


def _chain(files: DataFrame, names: DataFrame, group: str, order: str, layout: FileLayout) -> DataFrame:
    """``file_id, _group, _next, _first``: each file that has a header with the file after it in its group."""
    listed = files.groupBy(F.col(layout.file_id).alias("file_id")).agg(F.min(group).alias("_group"), F.min(order).alias("_order"))
    listed = listed.join(names.select("file_id").distinct(), "file_id", "left_semi")
    w = Window.partitionBy("_group").orderBy("_order", "file_id")
    return listed.select("file_id", "_group", F.lead("file_id").over(w).alias("_next"), (F.row_number().over(w) == 1).alias("_first"))


def renames_by_values(
    lines: DataFrame, files: DataFrame, names: DataFrame, group: str = "cod_municipio", order: str = "seq_no", schema: TargetSchema = UNITS, layout: FileLayout = FileLayout(),
    least: int = 20, alike: float = 0.8, shared: float = 0.5,
) -> DataFrame:
    """``_group, name, column_name``: columns that go under a new name which says nothing alike, found by their values.

    Asked of each file that lacks columns of the file before it and has others instead. The cells of those columns only are
    read: how they are written (notation with the magnitude of numbers, or the shape of texts) and what they say. Two
    columns of ``least`` cells or more are one if, where values repeat, at least ``shared`` of them are the same; else if
    at least ``alike`` are written alike and a word of the names begins alike or they follow the same column. Each must be the
    other's best match. The earlier name stands, a target column's name before any other.
    """
    chain = _chain(files, names, group, order, layout)
    left = Window.partitionBy("file_id").orderBy("pos")
    cols = names.select("file_id", "column_name", "known", F.lag("column_name").over(left).alias("after"))
    before = cols.join(chain.where("_next is not null").select("file_id", "_next"), "file_id").select(F.col("_next").alias("file_id"), F.col("file_id").alias("_from"), "column_name", "known", "after")
    gone = before.join(cols.select("file_id", "column_name"), ["file_id", "column_name"], "left_anti").withColumnsRenamed({c: f"_old_{c}" for c in ("column_name", "known", "after")})
    come = cols.join(chain.where("not _first").select("file_id", "_group"), "file_id").join(before.select("file_id", "column_name"), ["file_id", "column_name"], "left_anti")
    # Columns that go times columns that come, of one file: bounded by its header.
    asked = materialize(gone.join(come, "file_id").where("not (_old_known and known)"))
    wanted = asked.select(F.inline(F.array(F.struct(F.col("_from").alias("file_id"), F.col("_old_column_name").alias("column_name")), F.struct("file_id", "column_name")))).distinct()
    some = lines.join(wanted.select(F.col("file_id").alias(layout.file_id)).distinct(), layout.file_id, "left_semi")
    cells = read_cells(some, files, schema, layout, names).where("_cells is not null").select("file_id", F.explode("_cells").alias("column_name", "v"))
    cells = cells.join(wanted, ["file_id", "column_name"]).withColumn("k", cell_kind(F.col("v"))).where("k > 0")
    number = strict_number(F.col("v"))
    shape = F.substring(F.regexp_replace(F.regexp_replace("v", "[0-9]", "9"), r"\p{L}+", "A"), 1, 40)
    written = F.concat_ws(":", F.col("k").cast("string"), F.when(F.col("k") <= 2, F.floor(F.log2(number + 1)).cast("string")).when(F.col("k") == 4, shape))
    sides = F.array(F.struct(F.lit("written").alias("side"), written.alias("what")), F.struct(F.lit("said").alias("side"), F.col("v").alias("what")))
    counts = cells.select("file_id", "column_name", F.inline(sides)).groupBy("file_id", "column_name", "side", "what").agg(F.count(F.lit(1)).alias("n"))
    column = Window.partitionBy("file_id", "column_name", "side")
    shares = counts.select("*", (F.col("n") / F.sum("n").over(column)).alias("share"), F.sum("n").over(column).alias("cells"), F.count(F.lit(1)).over(column).alias("values"))
    shares = materialize(shares.where(F.col("cells") >= least))
    pair = ["file_id", "_from", "_old_column_name", "column_name"]
    old = shares.select(F.col("file_id").alias("_from"), F.col("column_name").alias("_old_column_name"), "side", "what", F.col("share").alias("_old_share"), (F.col("values") * 2 <= F.col("cells")).alias("_repeats"))
    both = asked.select(*pair).join(old, ["_from", "_old_column_name"]).join(shares.select("file_id", "column_name", "side", "what", "share"), ["file_id", "column_name", "side", "what"])
    same = F.least("share", "_old_share")
    scores = both.groupBy(*pair).agg(
        F.sum(F.when(F.col("side") == "written", same)).alias("written"), F.coalesce(F.sum(F.when(F.col("side") == "said", same)), F.lit(0.0)).alias("said"), F.bool_or((F.col("side") == "said") & F.col("_repeats")).alias("_some_repeat"),
    )
    repeats = shares.where("side = 'said'").select(F.col("file_id").alias("_from"), F.col("column_name").alias("_old_column_name"), (F.col("values") * 2 <= F.col("cells")).alias("_repeats")).distinct()
    words = lambda c: F.filter(F.split(c, "_"), lambda w: F.length(w) >= 3)
    says = F.exists(words("_old_column_name"), lambda x: F.exists(words("column_name"), lambda y: F.substring(x, 1, 3) == F.substring(y, 1, 3)))
    judged = asked.join(scores, pair).join(repeats, ["_from", "_old_column_name"]).withColumn("_near", says | F.coalesce(F.col("after") == F.col("_old_after"), F.lit(False)))
    judged = judged.where(F.when(F.col("_repeats"), F.col("said") >= shared).otherwise((F.col("written") >= alike) & F.col("_near")))
    score = (F.col("written") + F.col("said") + F.col("_near").cast("double")).desc()
    best = [F.row_number().over(Window.partitionBy("file_id", c).orderBy(score, "_old_column_name", "column_name")) == 1 for c in ("_old_column_name", "column_name")]
    judged = judged.withColumn("_best", best[0] & best[1]).where("_best")
    name = F.when(F.col("known"), F.col("_old_column_name")).otherwise(F.col("column_name"))
    stands = F.when(F.col("known"), F.col("column_name")).otherwise(F.col("_old_column_name"))
    found = judged.select("_group", name.alias("name"), stands.alias("column_name")).groupBy("_group", "name", "column_name").agg(F.count(F.lit(1)).alias("n"))
    found = found.groupBy("_group", "name").agg(F.max_by("column_name", F.struct("n", "column_name")).alias("column_name"))
    # A name may have been renamed again: followed to the first one, the hops doubled each round.
    while True:
        on = found.select("_group", F.col("name").alias("column_name"), F.col("column_name").alias("_first"))
        followed = found.join(on, ["_group", "column_name"], "left").where("_first is null or _first <> name")
        found = materialize(followed.select("_group", "name", F.coalesce("_first", "column_name").alias("column_name"), F.col("_first").isNotNull().alias("_moved")))
        if found.where("_moved").isEmpty():
            return found.drop("_moved")
        found = found.drop("_moved")


def resolve_names(
    lines: DataFrame, files: DataFrame, group: str = "cod_municipio", order: str = "seq_no", schema: TargetSchema = UNITS, layout: FileLayout = FileLayout()
) -> DataFrame:
    """``resolve_headers`` of all files, and then the names that ``renames_by_values`` found: a header of such a name stands
    for the column, in every file of the group that has no other header for it. Written once."""
    names = materialize(resolve_headers(read_headers(lines, files, layout), schema))
    learned = renames_by_values(lines, files, names, group, order, schema, layout)
    grouped = files.groupBy(F.col(layout.file_id).alias("file_id")).agg(F.min(group).alias("_group"))
    here = names.join(grouped, "file_id").where("not known").join(learned.withColumnsRenamed({"name": "_n", "column_name": "_stands"}), (F.col("column_name") == F.col("_n")) & grouped["_group"].eqNullSafe(learned["_group"]))
    here = here.select("file_id", F.col("column_name"), "_stands")
    here = here.join(names.select("file_id", F.col("column_name").alias("_stands")), ["file_id", "_stands"], "left_anti")
    # Of several headers for one column the first by name takes it.
    here = here.groupBy("file_id", "_stands").agg(F.min("column_name").alias("column_name"))
    both = names.join(here, ["file_id", "column_name"], "left")
    known = F.col("known") | F.coalesce(F.col("_stands").isin(*schema.columns), F.lit(False))
    return materialize(both.select("file_id", "pos", "name", F.coalesce("_stands", "column_name").alias("column_name"), known.alias("known")))


def promote(table: DataFrame, approved: dict[str, str]) -> DataFrame:
    """Approved rescued fields as typed columns. A value that does not cast stays rescued. A name that the
    table already has (in any case) raises ``ValueError``."""
    if clash := {c.lower() for c in approved} & {c.lower() for c in table.columns}:
        raise ValueError(f"columns exist already: {', '.join(sorted(clash))}")
    return _move(table, {c: (c, kind) for c, kind in approved.items()})


def replay(table: DataFrame, readers: dict[str, str] | None = None, reader=None) -> DataFrame:
    """Cast rescued cells of existing columns again, filling only nulls. ``readers`` maps column to type;
    ``reader(text, type)`` builds the cast (default: the lenient number and date readers)."""
    from lavra.functions.numbers import parse_number

    def lenient(text: Column, kind: str) -> Column:
        if kind == "string":
            return text
        return parse_date(text).cast(kind) if "timestamp" in kind else parse_number(text).try_cast(kind)

    readers = readers or {c: k for c, k in table.dtypes if c in UNIT_SCHEMA and k != "string"}
    return _move(table, {c: (c, kind) for c, kind in readers.items()}, reader or lenient)


def _move(table: DataFrame, moves: dict[str, tuple[str, str]], cast=cast_cell) -> DataFrame:
    """Values of rescued fields into columns; each is cast once, and only in rows that have something rescued."""
    made = once(table, _map=F.from_json("_rescued", "map<string,string>"))
    held = lambda name: F.try_element_at("_map", F.lit(name))
    made = once(made, **{f"_v_{c}": F.when(held(name).isNotNull(), cast(held(name), kind)) for c, (name, kind) in moves.items()})
    made = once(made, _moved=F.array_compact(F.array(*[F.when(F.col(f"_v_{c}").isNotNull(), F.lit(name)) for c, (name, _) in moves.items()])))
    kept = F.map_filter("_map", lambda k, v: ~F.array_contains("_moved", k))
    rescued = F.when(F.size("_moved") == 0, F.col("_rescued")).when(F.size(kept) > 0, F.to_json(kept))
    old = [c for c in table.columns if c not in ("_rescued", *moves)]
    new = [F.coalesce(F.col(c), F.col(f"_v_{c}")).alias(c) if c in table.columns else F.col(f"_v_{c}").alias(c) for c in moves]
    return made.select(*old, *new, rescued.alias("_rescued"))


def column_types(ingested: DataFrame) -> DataFrame:
    """``file_id, column_name, kind`` from the ``_kinds`` of ingested rows: the first of integer, decimal, timestamp,
    text that at least four in five of the non-null cells have. A column without non-null cells has no row."""
    cells = ingested.where(F.col("_kinds").isNotNull()).select("file_id", F.explode("_kinds").alias("column_name", "k"))
    n = F.count_if(F.col("k") > 0)
    share = lambda *kinds: F.count_if(F.col("k").isin(*kinds)) * 5 >= n * 4
    kind = F.when(share(1), "integer").when(share(1, 2), "decimal").when(share(3), "timestamp").otherwise("text")
    return cells.groupBy("file_id", "column_name").agg(n.alias("_n"), kind.alias("kind")).where("_n > 0").drop("_n")


def layout_changes(
    lines: DataFrame, files: DataFrame, group: str = "cod_municipio", order: str = "seq_no", schema: TargetSchema = UNITS, layout: FileLayout = FileLayout(),
    ingested: DataFrame | None = None, names: DataFrame | None = None,
) -> DataFrame:
    """``file_id, column_name, change_kind`` of each file against the one before it in its group.

    Types are those of the ingested rows' ``_kinds``; ``ingested`` is that table where it exists already (it may
    have been promoted and replayed), else ``lines`` are ingested here. ``names`` are those of ``resolve_names``. Files without a header are passed over. Files of a null group are compared among themselves; equal order
    values are ordered by ``file_id``. No files or no lines give no rows.
    """
    require_columns(files, [layout.file_id, group, order], "files")
    named = resolve_names(lines, files, group, order, schema, layout) if names is None else names
    names = named.select("file_id", "column_name", "name")
    kinds = column_types(ingest(lines, files, schema, layout, named) if ingested is None else ingested)
    described = names.join(kinds, ["file_id", "column_name"], "left")
    chain = _chain(files, names, group, order, layout).select("file_id", "_next", "_first")
    chained = described.join(chain, "file_id")
    # Each description goes to its own file as "now" and to the file after it as "before": one aggregation
    # instead of a join of the table with itself.
    facts = F.struct("name", "kind")
    sides = F.array(
        F.struct(F.when(~F.col("_first"), F.col("file_id")).alias("file_id"), facts.alias("now"), F.lit(None).cast("struct<name:string,kind:string>").alias("before")),
        F.struct(F.col("_next").alias("file_id"), F.lit(None).cast("struct<name:string,kind:string>").alias("now"), facts.alias("before")),
    )
    pairs = chained.select("column_name", F.inline(sides)).where(F.col("file_id").isNotNull())
    pairs = pairs.groupBy("file_id", "column_name").agg(F.max("now").alias("now"), F.max("before").alias("before"))
    both = F.col("now").isNotNull() & F.col("before").isNotNull()
    changes = F.array_compact(
        F.array(
            F.when(F.col("before").isNull(), "added"),
            F.when(F.col("now").isNull(), "removed"),
            F.when(both & (F.col("now.name") != F.col("before.name")), "renamed"),
            F.when(both & (F.col("now.kind") != F.col("before.kind")), "type_changed"),
        )
    )
    return pairs.select("file_id", "column_name", F.explode(changes).alias("change_kind"))
