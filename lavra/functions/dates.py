"""Dates in text (DT-01, DT-02) by regular expression and try_cast: no parser policy, no exception."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lavra.functions.text import UNIT_NULL_TOKENS, let, null_if_token, strip

# Existing days as regular expressions: one match decides, and nothing is parsed that does not exist.
YEAR = r"(?!0000)[0-9]{4}"
LEAP = r"(?:[0-9]{2}(?:0[48]|[2468][048]|[13579][26])|(?:0[48]|[2468][048]|[13579][26])00)"
CLOCK = r"(?:[01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9]"
DAY_FIRST = (
    rf"(?:(?:0[1-9]|1[0-9]|2[0-8])/(?:0[1-9]|1[0-2])/{YEAR}|(?:29|30)/(?:0[13-9]|1[0-2])/{YEAR}|31/(?:0[13578]|1[02])/{YEAR}|29/02/{LEAP})"
)
YEAR_FIRST = (
    rf"(?:{YEAR}/(?:0[1-9]|1[0-2])/(?:0[1-9]|1[0-9]|2[0-8])|{YEAR}/(?:0[13-9]|1[0-2])/(?:29|30)|{YEAR}/(?:0[13578]|1[02])/31|{LEAP}/02/29)"
)
STRICT_DATE = rf"\A(?:{DAY_FIRST}(?: {CLOCK})?|{YEAR_FIRST} {CLOCK})\z"

LOOSE_DAY_FIRST = r"^(\d{1,2})[-/](\d{1,2})[-/](\d{4})(?=$|[ T])"
LOOSE_YEAR_FIRST = r"^(\d{4})[-/](\d{1,2})[-/](\d{1,2})(?=$|[ T])"


def is_strict_date(c: Column) -> Column:
    """True for an existing ``yyyy/MM/dd HH:mm:ss``, ``dd/MM/yyyy`` or ``dd/MM/yyyy HH:mm:ss``, trimmed.
    There is no year 0 and no leap second. Null stays null."""
    return strip(c).rlike(STRICT_DATE)


def parse_date(c: Column) -> Column:
    """DT-01: timestamp without zone; texts that begin with the year are year first, others day first. Null
    tokens and dates that do not exist give null. Both notations may occur in one file."""
    text = strip(null_if_token(c, UNIT_NULL_TOKENS))
    iso = F.regexp_replace(F.regexp_replace(text, LOOSE_DAY_FIRST, "$3-$2-$1"), LOOSE_YEAR_FIRST, "$1-$2-$3")
    return let(iso, lambda t: F.when(t.rlike(r"^\d{4}-\d{1,2}-\d{1,2}($|[ T])"), t.try_cast("timestamp_ntz")))


def period_of(c: Column) -> Column:
    """DT-02: ``yyyy-MM``; its text order is its time order."""
    return F.date_format(c, "yyyy-MM")
