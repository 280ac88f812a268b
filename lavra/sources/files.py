"""File sources: sniffed delimiters and encodings, all-string CSV with row order, ZIP members, JSON price series
(SRC-01 .. SRC-12, SRC-17, SRC-18, SRC-20)."""

from __future__ import annotations

import csv
import hashlib
import re
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lavra.contracts import ContractError, duplicate_keys, require_columns
from lavra.functions.dates import parse_date
from lavra.functions.text import header_name
from lavra.operators.layouts import UNITS, TargetSchema

ENCODINGS = ("utf-8-sig", "utf-8", "cp1252", "latin-1")
BYTE_ORDER_MARK = b"\xef\xbb\xbf"
FORMATS = ("csv", "zip", "pdf", "xlsx", "xls", "geojson", "json")


def read_head(spark: SparkSession, path: str | Path, size: int = 1 << 16) -> bytes:
    """The first ``size`` bytes of a file on any file system that Spark reads."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(str(path))
    stream = hadoop.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).open(hadoop)
    try:
        return bytes(stream.readNBytes(size))
    finally:
        stream.close()


def detect_encoding(spark: SparkSession, path: str | Path) -> str:
    """The first of ENCODINGS that reads every byte of the file: UTF-8 if the whole file is valid, with or without a mark,
    else one byte a character (which Spark reads as Latin-1).

    The cluster looks at all lines; no line break lies within a character of UTF-8, so the lines decide.
    """
    lines = spark.read.text(str(path), lineSep="\n")
    if lines.where(~F.is_valid_utf8("value")).limit(1).count():
        return ENCODINGS[2]
    return ENCODINGS[0] if read_head(spark, path, 3) == BYTE_ORDER_MARK else ENCODINGS[1]


def detect_delimiter(head: str, default: str = ",", quote: str = "'") -> str:
    """SRC-02: sniffed from the first 64 KiB among ``, ; | tab``."""
    try:
        return csv.Sniffer().sniff(head[: 1 << 16], delimiters=",;|\t").delimiter
    except csv.Error:
        line = head.split("\n", 1)[0]
        best = max(",;|\t", key=line.count)
        return best if line.count(best) else default


def canonical_names(headers: list[str], schema: TargetSchema = UNITS) -> list[str]:
    """SRC-06: canonical names of a file's headers; a name that repeats gets ``_2``, ``_3``."""
    seen: dict[str, int] = {}
    out = []
    for h in headers:
        name = header_name(h.strip().strip("'\""))
        name = schema.aliases.get(name, name)
        seen[name] = seen.get(name, 0) + 1
        out.append(name if seen[name] == 1 else f"{name}_{seen[name]}")
    return out


def year_of(file_name: str) -> int | None:
    """SRC-05: the year in a file name; ``with_modal_year`` is the rule for names without one."""
    found = re.search(r"20\d{2}", file_name)
    return int(found[0]) if found else None


def with_modal_year(df: DataFrame, date: str = "data_estimativa", name: str = "source_year") -> DataFrame:
    """SRC-05: adds the year that most rows of ``date`` (text) have, the earlier of equals; null without any date."""
    years = df.select(F.year(parse_date(F.col(date))).alias("_y")).where("_y is not null").groupBy("_y").agg(F.count(F.lit(1)).alias("_n"))
    most = years.agg(F.max_by("_y", F.struct("_n", -F.col("_y"))).alias(name))
    return df.crossJoin(F.broadcast(most))  # one row


def read_unit_csv(spark: SparkSession, path: str | Path, schema: TargetSchema = UNITS, required: tuple[str, ...] = (), quote: str = "'") -> DataFrame:
    """SRC-01, SRC-03 .. SRC-06: one file, all texts, canonical columns, ``source_file, source_year, source_row``.

    ``source_row`` counts records from 2 (line 1 is the header). Records of a wrong width keep what they have in
    order, with the whole text under ``_corrupt``; absent canonical columns are null.
    """
    name, encoding = Path(path).name, detect_encoding(spark, path)
    text = read_head(spark, path).decode(encoding, "replace")
    delimiter = detect_delimiter(text)
    names = canonical_names(next(csv.reader([text.split("\n", 1)[0].rstrip("\r")], delimiter=delimiter, quotechar=quote)), schema)
    if gone := sorted(set(required) - set(names)):
        raise ContractError(f"{name}: missing columns {', '.join(gone)}")
    fields = T.StructType([T.StructField(n, T.StringType()) for n in [*names, "_corrupt"]])
    df = (
        spark.read.schema(fields)
        .options(header=True, sep=delimiter, quote=quote, escape=quote, multiLine=True, enforceSchema=True, mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt")
        .option("encoding", "utf-8" if encoding.startswith("utf-8") else "iso-8859-1")
        .csv(str(path))
    )
    # A multi-line file is read by one task in file order, so the growing id gives the record's place.
    order = Window.orderBy(F.monotonically_increasing_id())
    df = df.withColumns({"source_file": F.lit(name), "source_row": F.row_number().over(order) + 1})
    missing = [c for c in schema.columns if c not in names]
    df = df.withColumns({c: F.lit(None).cast("string") for c in missing}) if missing else df
    if (year := year_of(name)) is None and "data_estimativa" in df.columns:
        return with_modal_year(df)
    return df.withColumn("source_year", F.lit(year).cast("int"))


def read_unit_folder(spark: SparkSession, folder: str | Path, **options) -> DataFrame:
    """SET-01: all files of a folder in name order, columns united by name; hidden files are left out."""
    paths = sorted(p for p in Path(folder).glob("*.csv") if not p.name.startswith("."))
    if not paths:
        raise ContractError(f"no CSV files in {folder}")
    frames = [read_unit_csv(spark, p, **options) for p in paths]
    united = frames[0]
    for frame in frames[1:]:
        united = united.unionByName(frame, allowMissingColumns=True)
    return united


def extract_member(archive: str | Path, target: str | Path, suffix: str = ".csv") -> Path:
    """SRC-08: the member with the shortest name of that suffix, written below ``target`` (a shared folder)."""
    with zipfile.ZipFile(archive) as z:
        members = sorted((m for m in z.namelist() if m.lower().endswith(suffix) and not Path(m).name.startswith(".")), key=lambda m: (len(m), m))
        if not members:
            raise ContractError(f"{archive} holds no {suffix}")
        out = Path(target) / Path(members[0]).name
        out.write_bytes(z.read(members[0]))
    return out


def newest(folder: str | Path, *patterns: str) -> Path | None:
    """SRC-07: the last file by name of the first pattern that any file matches."""
    for pattern in patterns:
        if found := sorted(Path(folder).glob(pattern)):
            return found[-1]
    return None


def read_projected_csv(
    spark: SparkSession, path: str | Path, wanted: list[str], required: list[str], code: str | None = None, prefix: str | None = None, key: str | None = None
) -> DataFrame:
    """SRC-08, SRC-10: all-string CSV with headers in upper snake case, only ``wanted`` columns (null where
    absent), rows whose ``code`` digits begin with ``prefix``; ``key`` must then be unique."""
    encoding = detect_encoding(spark, path)
    text = read_head(spark, path).decode(encoding, "replace")
    delimiter = detect_delimiter(text, ";", '"')
    names = [header_name(h, upper=True) for h in next(csv.reader([text.split("\n", 1)[0].rstrip("\r")], delimiter=delimiter))]
    df = spark.read.schema(T.StructType([T.StructField(n, T.StringType()) for n in names])).options(header=True, sep=delimiter, enforceSchema=True)
    df = df.option("encoding", "utf-8" if encoding.startswith("utf-8") else "iso-8859-1").csv(str(path))
    require_columns(df, required, Path(path).name)
    df = df.select(*[F.col(c) if c in names else F.lit(None).cast("string").alias(c) for c in wanted])
    if code and prefix:
        df = df.where(F.regexp_replace(code, r"\D", "").startswith(prefix))
    if key and duplicate_keys(df, [key]).limit(1).count():
        raise ContractError(f"{Path(path).name}: {key} repeats")
    return df


def read_price_series(spark: SparkSession, path: str) -> DataFrame:
    """SRC-12: ``[{"data": "01/01/2020", "valor": "0.21"}, ...]`` as ``period, pct``; invalid or repeated months
    raise."""
    raw = spark.read.schema("data string, valor string").json(path, multiLine=True)
    rows = raw.select(
        F.date_format(F.try_to_date("data", "dd/MM/yyyy"), "yyyy-MM").alias("period"),
        F.replace("valor", F.lit(","), F.lit(".")).try_cast("double").alias("pct"),
    )
    if rows.where("period is null or pct is null").limit(1).count():
        raise ContractError("price series: a month or a value is invalid")
    if duplicate_keys(rows, ["period"]).limit(1).count():
        raise ContractError("price series: a month repeats")
    return rows


def reuse_or_build(spark: SparkSession, path: str, build, rebuild: bool = False) -> DataFrame:
    """SRC-17: a table kept as parquet; built when absent or on demand."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)
    if rebuild or not there:
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def safe_name(text: str) -> str:
    """SRC-20: a file name of letters, digits, dots, dashes and underscores."""
    return re.sub(r"[^A-Za-z0-9._-]+", "_", text).strip("._") or "file"


def resource_format(declared: str | None, url: str) -> str | None:
    """SRC-20: the first known format named by the declaration or the address."""
    said = f"{declared or ''} {url}".lower()
    return next((f for f in FORMATS if f in said), None)


def sha256_file(path: str | Path) -> str:
    """SRC-20: by blocks, so that size does not matter."""
    digest = hashlib.sha256()
    with Path(path).open("rb") as f:
        while block := f.read(1 << 20):
            digest.update(block)
    return digest.hexdigest()


def label_column(columns: list[str], priority: list[str], keywords: list[str]) -> str | None:
    """SRC-15: a layer's label or code column: the first of the priority names, else the first that holds a keyword."""
    upper = {c.upper(): c for c in columns}
    for name in priority:
        if name.upper() in upper:
            return upper[name.upper()]
    return next((c for c in columns if any(k.upper() in c.upper() for k in keywords)), None)


def inspect_member(spark: SparkSession, path: str | Path) -> dict:
    """SRC-09: ``encoding``, ``delimiter`` and ``names`` (header as written to upper snake case) of an extracted CSV."""
    encoding = detect_encoding(spark, path)
    text = read_head(spark, path).decode(encoding, "replace")
    delimiter = detect_delimiter(text, ";", '"')
    header = next(csv.reader([text.split("\n", 1)[0].rstrip("\r")], delimiter=delimiter))
    return {"encoding": encoding, "delimiter": delimiter, "names": {h: header_name(h, upper=True) for h in header}}


#: Key and file names of the three parts of a census level; patterns in the order in which they are tried.
CENSUS_LEVELS = {
    "sector": ("CD_SETOR", {"basic": ("*setores_basico*.zip", "*basico*.zip"), "demography": ("*setores_demografia*.zip", "*demografia*.zip"), "income": ("*setores*renda*.zip",)}),
    "neighbourhood": ("CD_BAIRRO", {"basic": ("*bairros_basico*.zip", "*basico*.zip"), "demography": ("*bairros_demografia*.zip", "*demografia*.zip"), "income": ("*bairros*renda*.zip",)}),
}


def load_level(
    spark: SparkSession, folders: dict[str, str | Path], level: str, target: str | Path, columns: dict[str, list[str]], municipality: str | None = None, required: bool = True
) -> dict[str, DataFrame] | None:
    """SRC-11: the three tables ``basic``, ``demography``, ``income`` of a census level, read from the newest ZIP of each in
    its folder, members extracted below ``target`` (a shared folder), rows of one municipality if named.

    ``columns`` names the variables wanted of each part. A missing ZIP raises, or gives None where the level is not
    ``required``. An unknown level raises ``KeyError``.
    """
    key, patterns = CENSUS_LEVELS[level]
    archives = {part: newest(folders[part], *names) for part, names in patterns.items()}
    if gone := sorted(part for part, path in archives.items() if path is None):
        if required:
            raise ContractError(f"census level {level}: no archive for {', '.join(gone)}")
        return None
    tables = {}
    for part, path in archives.items():
        below = Path(target) / f"{level}-{part}"
        below.mkdir(parents=True, exist_ok=True)
        tables[part] = read_projected_csv(spark, extract_member(path, below), [key, *columns[part]], [key], key if municipality else None, municipality, key)
    return tables


def read_required_csv(spark: SparkSession, path: str | Path, required: list[str]) -> DataFrame:
    """SRC-18: a CSV with inferred types that must have the ``required`` columns."""
    return require_columns(spark.read.csv(str(path), header=True, inferSchema=True), required, Path(path).name)
