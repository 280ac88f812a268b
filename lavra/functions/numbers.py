"""Numbers in text and guarded arithmetic (NUM-01 .. NUM-06)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from lavra.functions.text import UNIT_NULL_TOKENS, let, null_if_token, strip

PLAIN_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
# A strict amount: digits, plain or grouped in threes by one mark, a decimal part after the other mark.
STRICT_NUMBER = r"\A(?:R\$ ?)?(?:[0-9]+(?:[.,][0-9]+)?|[0-9]{1,3}(?:\.[0-9]{3})+(?:,[0-9]+)?|[0-9]{1,3}(?:,[0-9]{3})+(?:\.[0-9]+)?)\z"


def to_double(c: Column) -> Column:
    """Cast a plain number; null for anything else, also for ``5f``-like texts that a bare try_cast takes."""
    return let(c, lambda t: F.when(t.rlike(PLAIN_NUMBER), t.try_cast("double")))


def parse_number(c: Column) -> Column:
    """NUM-01: lenient amount. The last of two kinds of marks is the decimal mark, a lone comma too; a lone
    point stays decimal; whatever is then no number is null."""

    def plain(t: Column) -> Column:
        comma_last = F.instr(F.reverse(t), ",") < F.instr(F.reverse(t), ".")
        both = t.contains(",") & t.contains(".")
        brazilian = F.replace(F.replace(t, F.lit("."), F.lit("")), F.lit(","), F.lit("."))
        return F.when(both & comma_last, brazilian).when(both, F.replace(t, F.lit(","), F.lit(""))).otherwise(F.replace(t, F.lit(","), F.lit(".")))

    return to_double(let(F.regexp_replace(null_if_token(c, UNIT_NULL_TOKENS), r"[^0-9,.+-]", ""), plain))


def is_strict_number(c: Column) -> Column:
    """True for a trimmed amount without sign whose grouping is consistent."""
    return strip(c).rlike(STRICT_NUMBER)


def strict_number(c: Column) -> Column:
    """The value of a strict amount, null otherwise. ``1.234`` is read as one and a fraction: a lone mark
    is decimal, as in the lenient parser; more than one of the same mark groups."""

    def value(t: Column) -> Column:
        plain = (
            F.when(t.rlike(r"^[0-9]{1,3}(\.[0-9]{3})+,|^[0-9]{1,3}(\.[0-9]{3}){2,}$"), F.replace(F.replace(t, F.lit("."), F.lit("")), F.lit(","), F.lit(".")))
            .when(t.rlike(r"^[0-9]{1,3}(,[0-9]{3})+\.|^[0-9]{1,3}(,[0-9]{3}){2,}$"), F.replace(t, F.lit(","), F.lit("")))
            .otherwise(F.replace(t, F.lit(","), F.lit(".")))
        )
        return plain.try_cast("double")

    return let(strip(c), lambda t: F.when(t.rlike(STRICT_NUMBER), value(F.regexp_replace(t, r"^R\$ ?", ""))))


def finite(c: Column) -> Column:
    """Null for NaN and the infinities."""
    return let(c, lambda v: F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v))


def safe_float(c: Column) -> Column:
    """NUM-02: comma or point as decimal mark, finite values only."""
    return finite(to_double(F.replace(strip(c), F.lit(","), F.lit("."))))


def safe_ratio(num: Column, den: Column, multiplier: float = 1.0) -> Column:
    """NUM-03: null unless the denominator is above zero."""
    return F.when(den > 0, num / den * F.lit(multiplier))


def complete_sum(columns: list[Column]) -> Column:
    """NUM-04: null when any addend is null."""
    return reduce(lambda a, b: a + b, columns)


def weighted_midpoint_mean(counts: list[Column], midpoints: list[float]) -> Column:
    """NUM-05: mean of band midpoints weighted by complete counts with a positive total."""
    total = complete_sum(counts)
    return F.when(total > 0, complete_sum([c * F.lit(float(m)) for c, m in zip(counts, midpoints)]) / total)


def guarded_sqrt(c: Column) -> Column:
    """NUM-06: null below zero."""
    return F.when(c >= 0, F.sqrt(c))
