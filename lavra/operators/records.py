"""Delimited text records: split with the notation of each file, one row per record.

The text quote doubles inside a quoted field; a quote that does not begin a field is plain text. Records are
split inside the JVM: a plain ``split`` on the delimiter, and a regular expression for records that hold a
quote right at the start of a field.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lavra.contracts import require_columns
from lavra.functions.text import BOM

QUOTE = "'"
#: A whole quoted field. The possessive loops run without recursion, however long the field is.
QUOTED = "'[^']*+(?:''[^']*+)*+'"


def split_record(text: Column, delimiter: Column) -> Column:
    """``struct<fields, n_fields, bad_quoting>`` of one record, in one pass of a regular expression.

    The delimiter is the first character of ``delimiter``. An empty record has one empty field; a null record
    counts as empty. With bad quoting the fields up to the bad one are right and the rest is one piece.
    """
    text = F.coalesce(text, F.lit(""))
    mark = F.concat(F.lit(r"\x{"), F.lower(F.hex(F.ascii(delimiter))), F.lit("}"))
    plain = F.split(text, F.when(delimiter.rlike(r"\A[A-Za-z0-9]"), mark).otherwise(F.concat(F.lit("\\"), F.substring(delimiter, 1, 1))), -1)
    # A field starts the record or follows a delimiter: a quoted one, an unquoted one, or, with a quote that
    # does not close before a delimiter, all the rest.
    field = F.concat(F.lit(r"(?:\A|(?<="), mark, F.lit(f"))({QUOTED}(?="), mark, F.lit(r"|\z)|(?:[^'"), mark, F.lit("][^"), mark, F.lit(r"]*+)?(?="), mark, F.lit(r"|\z)|'[\s\S]*+)(?:"), mark, F.lit(r"|\z)"))
    found = F.regexp_extract_all(text, field, F.lit(1))
    bad = F.exists(found, lambda f: f.startswith(QUOTE) & ~f.rlike(rf"\A{QUOTED}\z"))
    bare = F.transform(found, lambda f: F.when(f.startswith(QUOTE), F.replace(F.substr(f, F.lit(2), F.length(f) - 2), F.lit("''"), F.lit("'"))).otherwise(f))
    quoted = text.startswith(QUOTE) | text.contains(F.concat(F.substring(delimiter, 1, 1), F.lit(QUOTE)))
    fields = F.when(quoted, bare).otherwise(plain)
    return F.struct(fields.alias("fields"), F.size(fields).alias("n_fields"), (quoted & bad).alias("bad_quoting"))


def once(df: DataFrame, **values: Column) -> DataFrame:
    """Add columns that are computed once per row, whatever reads them: a generator is not merged into later
    projections, so an expensive expression is not repeated in each of its uses."""
    made = F.array(F.struct(*[v.alias(k) for k, v in values.items()]))
    return df.select("*", F.inline(made))


@dataclass(frozen=True)
class FileLayout:
    """Names of the columns that describe raw files and their lines."""

    file_id: str = "file_id"
    line_no: str = "line_no"
    text: str = "raw_text"
    delimiter: str = "delimiter"


def read_headers(lines: DataFrame, files: DataFrame, layout: FileLayout = FileLayout()) -> DataFrame:
    """One row per file that has a header (line 1): ``file_id, delimiter, headers`` (array of raw names).

    Of several first lines the smallest text counts. A file that ``files`` does not list, or lists without
    delimiter, is read with ``;``.
    """
    require_columns(lines, [layout.file_id, layout.line_no, layout.text], "lines")
    require_columns(files, [layout.file_id, layout.delimiter], "files")
    first = (
        lines.where(F.col(layout.line_no) == 1)
        .groupBy(F.col(layout.file_id).alias("file_id"))
        .agg(F.min(layout.text).alias("_header"))
    )
    notation = files.groupBy(F.col(layout.file_id).alias("file_id")).agg(F.min(layout.delimiter).alias("delimiter"))
    both = first.join(notation, "file_id", "left").withColumn("delimiter", F.coalesce(F.nullif("delimiter", F.lit("")), F.lit(";")))
    text = F.regexp_replace(F.coalesce("_header", F.lit("")), f"^{BOM}", "")
    both = once(both, _parsed=split_record(text, F.col("delimiter")))
    return both.select("file_id", "delimiter", F.transform("_parsed.fields", lambda h: F.regexp_replace(h, "[\"']", "")).alias("headers"))


def parse_records(lines: DataFrame, headers: DataFrame, layout: FileLayout = FileLayout()) -> DataFrame:
    """Data records (line 2 on) with their file's header row: ``file_id, line_no, raw_text, record`` plus the
    columns of ``headers``. Records of a file without header keep a null ``headers``."""
    data = lines.where(F.col(layout.line_no) > 1).select(
        F.col(layout.file_id).alias("file_id"), F.col(layout.line_no).alias("line_no"), F.col(layout.text).alias("raw_text")
    )
    both = data.join(headers, "file_id", "left")
    return once(both, record=split_record(F.col("raw_text"), F.coalesce(F.col("delimiter"), F.lit(";"))))
