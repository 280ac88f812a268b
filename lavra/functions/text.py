"""Text normalisation as Column expressions (STR-01 .. STR-11)."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as null in the three stages that read text.
UNIT_NULL_TOKENS = ("", "nan", "none", "null", "na", "n/a", "<na>", "-")
REGISTER_NULL_TOKENS = ("", "nan", "none", "null", "<na>")
CENSUS_NULL_TOKENS = ("x", "X", "XX", "...", "-", "", "NA", "N/A", "null", "NULL")

# Street-type words that the street key drops from the front.
STREET_TYPES = (
    "R", "RUA", "AV", "AVENIDA", "AVEN", "TV", "TRAVESSA", "AL", "ALAMEDA", "EST", "ESTRADA", "ROD",
    "RODOVIA", "BC", "BECO", "PRACA", "PCA", "LARGO", "VIA", "ACESSO", "PASSAGEM",
)

#: White space as Python's str.strip sees it, for Java patterns.
SPACE = r"[\s\x0b\x1c-\x1f\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
BOM = chr(0xFEFF)


@lru_cache(maxsize=1)
def _fold_pairs() -> tuple[str, str]:
    """Letters whose compatibility form is one ASCII character plus marks, and that character."""
    src, dst = [], []
    for code in [*range(0x00A0, 0x0250), *range(0x1E00, 0x1F00)]:
        plain = "".join(c for c in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(c))
        if len(plain) == 1 and plain.isascii() and plain != chr(code):
            src.append(chr(code))
            dst.append(plain)
    return "".join(src), "".join(dst)


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once: a one-element array binds it, where a plain expression would
    repeat it in each of its uses."""
    return F.element_at(F.transform(F.array(value), use), 1)


def fold_accents(c: Column) -> Column:
    """STR-03: drop combining marks and map accented Latin letters to ASCII, inside generated code."""
    src, dst = _fold_pairs()
    return F.translate(F.regexp_replace(c, r"\p{Mn}+", ""), src, dst)


def strip(c: Column) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.regexp_replace(c, rf"\A{SPACE}+|{SPACE}+\z", "")


def is_null_token(c: Column, tokens: tuple[str, ...] = UNIT_NULL_TOKENS) -> Column:
    """True for null and for a text that is one of ``tokens`` once trimmed and in lower case."""
    return c.isNull() | F.lower(strip(c)).isin(*[t.lower() for t in tokens])


def null_if_token(c: Column, tokens: tuple[str, ...] = UNIT_NULL_TOKENS) -> Column:
    return F.when(~F.lower(strip(c)).isin(*[t.lower() for t in tokens]), c)


def normalize_text(c: Column, tokens: tuple[str, ...] = UNIT_NULL_TOKENS) -> Column:
    """STR-02: trimmed, inner white space squeezed, null tokens null."""
    known = [t.lower() for t in tokens]
    return let(strip(c), lambda t: F.when(~F.lower(t).isin(*known), F.regexp_replace(t, rf"{SPACE}+", " ")))


def text_key(c: Column) -> Column:
    """STR-04: folded, upper case, only letters, digits and single blanks; null when nothing is left."""
    flat = F.trim(F.regexp_replace(F.regexp_replace(F.upper(fold_accents(normalize_text(c))), "[^A-Z0-9 ]", " "), " +", " "))
    return F.nullif(flat, F.lit(""))


def street_key(c: Column) -> Column:
    """STR-05: the text key without any street-type words in front."""
    types = "|".join(STREET_TYPES)
    return F.nullif(F.trim(F.regexp_replace(text_key(c), rf"^(?:(?:{types})(?: |$))+", "")), F.lit(""))


def number_key(c: Column) -> Column:
    """STR-06: the first run of digits without leading zeros; null for "no number" notations."""
    digits = let(text_key(c), lambda k: F.when(~k.isin("SN", "S N", "SEM NUMERO"), F.regexp_extract(k, r"(\d+)", 1)))
    return F.nullif(F.regexp_replace(digits, r"^0+(?=\d)", ""), F.lit(""))


def integerish(c: Column) -> Column:
    """STR-07: normalised text without a ``.0`` tail."""
    return F.regexp_replace(normalize_text(c), r"^(-?\d+)\.0+$", "$1")


def postal_code_padded(c: Column) -> Column:
    """STR-08, unit files: digits padded to 8; any other length is null. A text without digits gives 00000000."""
    return let(F.regexp_replace(normalize_text(c), r"\D", ""), lambda d: F.when(F.length(d) <= 8, F.lpad(d, 8, "0")))


def postal_code_cut(c: Column) -> Column:
    """STR-08, address register: digits padded or cut to 8; null without digits."""
    digits = F.regexp_replace(normalize_text(c, REGISTER_NULL_TOKENS), r"\D", "")
    return let(digits, lambda d: F.when(d != "", F.when(F.length(d) < 8, F.lpad(d, 8, "0")).otherwise(F.substring(d, 1, 8))))


def code_digits(c: Column, length: int = 15) -> Column:
    """STR-09: digits only, at most ``length``; null when none are left."""
    return F.nullif(F.substring(F.regexp_replace(c.cast("string"), r"[^0-9]", ""), 1, length), F.lit(""))


def header_key(c: Column, upper: bool = False) -> Column:
    """STR-01 over a column of header texts: quotes, byte order mark and accents gone, snake case."""
    flat = F.regexp_replace(fold_accents(F.regexp_replace(c, f"[{BOM}º°]", "")), "[^A-Za-z0-9]+", "_")
    flat = F.regexp_replace(flat, r"^_+|_+$", "")
    return F.upper(flat) if upper else F.lower(flat)


def header_name(text: str, upper: bool = False) -> str:
    """STR-01 for one header on the driver."""
    flat = "".join(c for c in unicodedata.normalize("NFKD", re.sub(f"[{BOM}º°]", "", text)) if not unicodedata.combining(c))
    flat = re.sub(r"[^A-Za-z0-9]+", "_", flat).strip("_")
    return flat.upper() if upper else flat.lower()


def stable_hash(columns: list[Column], prefix: str = "") -> Column:
    """STR-10: prefix and the first 20 hex digits of SHA-1 over the unit-separated texts, null as empty."""
    joined = F.concat_ws("\x1f", *[F.coalesce(c.cast("string"), F.lit("")) for c in columns])
    return F.concat(F.lit(prefix), F.substring(F.sha1(joined), 1, 20))


def ordered_distinct_join(value: Column, order: Column, sep: str = " | ") -> Column:
    """AGG-04: distinct trimmed values in first-seen order, joined. An aggregate expression."""
    seen = F.array_sort(F.collect_list(F.when(value.isNotNull(), F.struct(order.alias("o"), F.trim(value).alias("v")))))
    return F.array_join(F.array_distinct(F.transform(seen, lambda s: s["v"])), sep)
