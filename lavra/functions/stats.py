"""Order statistics that never gather a group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lavra.contracts import require_columns, require_range


def order_bucket(value: Column, per_doubling: int = 256) -> Column:
    """A bucket number that never falls as the value grows; widths follow the magnitude (about 0.3% of the value, also
    below one), so that neither a wide range nor outliers nor shares fill one bucket. Zero, the infinities and NaN (last)
    have buckets of their own."""
    size = F.least(F.lit(1100.0), F.log2(F.abs(value)))
    at = F.floor(size * per_doubling) + 1101 * per_doubling
    return F.when(F.isnan(value), F.lit(1 << 40)).when(value == 0, F.lit(0)).when(value < 0, -at).otherwise(at).cast("bigint")


def same_keys(a: DataFrame, b: DataFrame, keys: list[str], prefix: str = "_r_") -> tuple[DataFrame, Column]:
    """``b`` with its keys renamed, and the condition under which rows of both have the same keys, null or not."""
    other = b.withColumnsRenamed({k: f"{prefix}{k}" for k in keys})
    on = F.lit(True)
    for k in keys:
        on = on & a[k].eqNullSafe(other[f"{prefix}{k}"])
    return other, on


def group_value_counts(df: DataFrame, keys: list[str], columns: list[str] | dict[str, Column]) -> DataFrame:
    """``keys, column_name, value, n``: how often each value of each numeric column (or expression by name) occurs per
    group. Nulls and NaN are left out, the infinities are values; a null key is a group of its own."""
    named = columns if isinstance(columns, dict) else {c: F.col(c) for c in columns}
    require_columns(df, [*keys, *([] if isinstance(columns, dict) else columns)])
    cells = [F.struct(F.lit(c).alias("column_name"), v.cast("double").alias("value")) for c, v in named.items()]
    long = df.select(*keys, F.inline(F.array(*cells))).where(F.col("value").isNotNull() & ~F.isnan("value"))
    # Adding 0.0 makes -0.0 and 0.0 one value.
    return long.withColumn("value", F.col("value") + 0.0).groupBy(*keys, "column_name", "value").agg(F.count(F.lit(1)).alias("n"))


def merge_counts(*tables: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The counts of all tables together, by ``keys`` and value (default: all columns): percentiles of the union of what
    they counted. With fewer keys than the tables have, finer groups are put together, days to months for instance."""
    merged = tables[0]
    for t in tables[1:]:
        merged = merged.unionByName(t)
    by = [c for c in merged.columns if c != "n"] if keys is None else [*keys, "column_name", "value"]
    return merged.groupBy(*by).agg(F.sum("n").alias("n"))


def percentiles_from_counts(counts: DataFrame, keys: list[str], fractions: dict[str, list[float]]) -> DataFrame:
    """``keys, column_name, fraction, percentile, n_values`` for the fractions wanted of each column.

    Linear interpolation between the two neighbours of rank ``(n - 1) * fraction``, so exact. Groups without values have
    no row. ``counts`` holds each value of a group once (``merge_counts`` sees to that).

    The values of a group are cut into ordered ranges. The sums of the ranges, run over, tell in which range a rank
    lies; only the values of such ranges are sorted, and their running sums get the offset of the ranges before.
    """
    for wanted in fractions.values():
        for q in wanted:
            require_range("fraction", q, 0, 1)
    group = [*keys, "column_name"]
    counts = counts.where(F.col("column_name").isin(*fractions)).withColumn("_bucket", order_bucket(F.col("value")))
    ranges = counts.groupBy(*group, "_bucket").agg(F.sum("n").alias("_in"))
    whole = Window.partitionBy(*group)
    before = whole.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select("*", F.coalesce(F.sum("_in").over(before), F.lit(0)).alias("_off"), F.sum("_in").over(whole).alias("n_values"))
    wanted = F.coalesce(*[F.when(F.col("column_name") == c, F.array(*[F.lit(float(q)) for q in qs])) for c, qs in fractions.items()])
    rank = (F.col("n_values") - 1) * F.col("fraction")
    asked = ranges.select("*", F.explode(wanted).alias("fraction")).withColumns({"_low": F.floor(rank) + 1, "_high": F.ceil(rank) + 1})
    here = lambda r: (F.col(r) > F.col("_off")) & (F.col(r) <= F.col("_off") + F.col("_in"))
    asked = asked.where(here("_low") | here("_high"))
    asked = asked.groupBy(*group, "_bucket").agg(F.max("_off").alias("_off"), F.collect_list(F.struct("fraction", "n_values", "_low", "_high")).alias("_asked"))
    held, on = same_keys(counts, asked, [*group, "_bucket"])
    rows = counts.join(held, on).select(*counts.columns, "_off", "_asked")
    up = Window.partitionBy(*group, "_bucket").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_cum", F.sum("n").over(up) + F.col("_off")).select(*group, "value", "n", "_cum", F.inline("_asked"))
    # The value that holds a rank: the running sum reaches it here and not before.
    holds = lambda r: (F.col("_cum") >= F.col(r)) & (F.col("_cum") - F.col("n") < F.col(r))
    rows = rows.where(holds("_low") | holds("_high"))
    picked = rows.groupBy(*group, "fraction").agg(
        F.max(F.when(holds("_low"), F.col("value"))).alias("lo"), F.max(F.when(holds("_high"), F.col("value"))).alias("hi"), F.max("n_values").alias("n_values")
    )
    part = (F.col("n_values") - 1) * F.col("fraction")
    value = F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise(F.col("lo") + (F.col("hi") - F.col("lo")) * (part - F.floor(part)))
    return picked.select(*group, "fraction", value.alias("percentile"), "n_values")


def with_percentiles(aggregated: DataFrame, df: DataFrame, keys: list[str], wanted: dict[str, tuple[Column, float]]) -> DataFrame:
    """``aggregated`` (one row per ``keys``) with one column per name of ``wanted``: that percentile of that expression of
    ``df`` by ``keys``, null where a group has no value. No keys: one row."""
    sources = {str(c): c for c, _ in wanted.values()}
    names = {text: f"v{i}" for i, text in enumerate(sources)}
    counts = group_value_counts(df, keys, {names[t]: c for t, c in sources.items()})
    asked: dict[str, list[float]] = {}
    for c, q in wanted.values():
        asked.setdefault(names[str(c)], []).append(q)
    found = percentiles_from_counts(counts, keys, {c: sorted(set(qs)) for c, qs in asked.items()})
    at = {name: (F.col("column_name") == names[str(c)]) & (F.col("fraction") == F.lit(float(q))) for name, (c, q) in wanted.items()}
    wide = found.groupBy(*keys).agg(*[F.max(F.when(is_it, F.col("percentile"))).alias(name) for name, is_it in at.items()])
    other, on = same_keys(aggregated, wide, keys)
    return aggregated.join(F.broadcast(other) if not keys else other, on, "left").drop(*[f"_r_{k}" for k in keys])


def running_sums(
    df: DataFrame, keys: list[str], order: str | list[str], measures: list[str], with_totals: bool = False, bucket: Column | None = None, ties: bool = False
) -> DataFrame:
    """Adds ``cum_<m>`` for each measure: its sum over the rows of the group up to this one, in order.

    The group is split by ranges of the order: sums per range, offsets by running over the ranges (at most some
    thousands a group), then running sums within a range. ``bucket`` numbers the ranges and must not fall as
    the order grows; by default it is ``order_bucket`` of the one, numeric, order column, which must not be
    null. Rows of equal order run in no fixed order, or with ``ties`` all get the sum up to the last of them. With ``with_totals`` also adds ``all_<m>``, the sum over
    the group.
    """
    order = [order] if isinstance(order, str) else order
    df = df.withColumn("_bucket", order_bucket(F.col(order[0])) if bucket is None else bucket)
    ranges = df.groupBy(*keys, "_bucket").agg(*[F.sum(m).alias(f"_in_{m}") for m in measures])
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranges.select(
        *keys,
        "_bucket",
        *[F.coalesce(F.sum(f"_in_{m}").over(before), F.lit(0)).alias(f"_off_{m}") for m in measures],
        *[F.sum(f"_in_{m}").over(Window.partitionBy(*keys)).alias(f"all_{m}") for m in measures if with_totals],
    )
    within = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    within = within.rangeBetween(Window.unboundedPreceding, Window.currentRow) if ties else within.rowsBetween(Window.unboundedPreceding, 0)
    joined = df.join(offsets, [*keys, "_bucket"])
    return joined.select(
        *[c for c in df.columns if c != "_bucket"],
        *[(F.sum(m).over(within) + F.col(f"_off_{m}")).alias(f"cum_{m}") for m in measures],
        *[f"all_{m}" for m in measures if with_totals],
    )
