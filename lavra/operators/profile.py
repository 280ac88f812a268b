"""Problem 2: column profiles from maintained value-count tables.

For every column a table of values with their counts is kept. A load changes it by signed counts (rows that
come, rows that go), and the profile is derived from the counts alone: null rate, distinct values, range,
pattern violations, entropy, and the change of the distribution against another load. Counts are additive, so
tables of separate loads, days or partitions combine by ``apply_deltas``.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lavra.contracts import require_columns
from lavra.functions.stats import running_sums
from lavra.functions.text import UNIT_NULL_TOKENS, null_if_token
from lavra.session import delete_folder, folders, materialize

NUMERIC = {"double", "float", "int", "bigint", "smallint", "tinyint"}
KEY = ["column_name", "text_value", "num_value"]


@dataclass(frozen=True)
class Rule:
    """What a column must satisfy and which changes against the baseline load are findings.

    ``pattern`` must match in full, untrimmed; ``pattern_share`` is the share of violations that counts.
    ``ratio``: findings when the number of distinct values is at least ``ratio`` times, or at most one
    ``ratio``-th of, the baseline's. ``shift``: the largest accepted change of the distribution.
    """

    low: float | None = None
    high: float | None = None
    pattern: str | None = None
    pattern_share: float = 0.01
    null_change: float | None = None
    ratio: int | None = None
    shift: float | None = None


UNIT_RULES = {
    "bairro": Rule(pattern=r"[A-ZÀ-Ý0-9' .-]{3,40}", null_change=0.04, ratio=2, shift=0.3),
    "situacao": Rule(pattern="PAGO|CANCELADO|EM ABERTO|PARCELADO|ISENTO", null_change=0.04, ratio=2, shift=0.3),
    "cep": Rule(pattern="[0-9]{8}", null_change=0.04),
    "area_constr_privativa": Rule(low=0, high=20000, null_change=0.04, shift=0.2),
}
YEAR_RULES = {"n_transacoes": Rule(low=1, null_change=0.04, shift=0.2)}


def value_counts(df: DataFrame, columns: list[str] | None = None, scope: list[str] = ["load_id"], tokens: tuple[str, ...] = UNIT_NULL_TOKENS) -> DataFrame:
    """``scope``, ``column_name``, ``text_value``, ``num_value``, ``n``: how often each value of each column
    occurs per scope, in one pass over the table.

    Numbers are counted as doubles under ``num_value``, all else as text under ``text_value``; null, NaN and
    null tokens are one null value. Texts are kept untrimmed.
    """
    columns = columns or [c for c in df.columns if c not in scope]
    require_columns(df, [*columns, *scope])
    kinds = dict(df.dtypes)

    def cell(c: str) -> Column:
        if kinds[c] in NUMERIC:
            number = F.col(f"`{c}`").cast("double")
            text, number = F.lit(None).cast("string"), F.when(~F.isnan(number), number) if kinds[c] in ("double", "float") else number
        else:
            text = null_if_token(F.col(f"`{c}`").cast("string"), tokens) if kinds[c] == "string" else F.col(f"`{c}`").cast("string")
            number = F.lit(None).cast("double")
        return F.struct(F.lit(c).alias("column_name"), text.alias("text_value"), number.alias("num_value"))

    cells = df.select(*scope, F.inline(F.array(*[cell(c) for c in columns])))
    # Adding 0.0 makes -0.0 and 0.0 one value.
    return cells.withColumn("num_value", F.col("num_value") + 0.0).groupBy(*scope, *KEY).agg(F.count(F.lit(1)).alias("n"))


def signed_deltas(added: DataFrame, removed: DataFrame) -> DataFrame:
    """Counts that come minus counts that go, values without change left out."""
    return apply_deltas(added, removed.withColumn("n", -F.col("n")))


def apply_deltas(state: DataFrame, deltas: DataFrame) -> DataFrame:
    """The count table after a load: sums per value, values that are gone left out."""
    keys = [c for c in state.columns if c != "n"]
    return state.unionByName(deltas).groupBy(*keys).agg(F.sum("n").alias("n")).where("n != 0")


def _load_prints(df: DataFrame, columns: list[str], scope: list[str]) -> DataFrame:
    """``scope, n_rows, digest``: equal for loads of equal rows, in any order."""
    cells = [F.col(f"`{c}`") for c in columns]
    # A hash passes over nulls, so where they are is hashed too.
    row = F.xxhash64(*cells, *[c.isNull() for c in cells])
    return df.groupBy(*scope).agg(F.count(F.lit(1)).alias("n_rows"), F.sum(row.cast("decimal(20,0)")).alias("digest"))


def maintained_counts(df: DataFrame, path: str, columns: list[str] | None = None, scope: list[str] = ["load_id"], tokens: tuple[str, ...] = UNIT_NULL_TOKENS) -> DataFrame:
    """``value_counts`` of ``df`` from the count table kept at ``path``, which is brought up to date.

    Loads that came, went or were replaced since the last call (their rows have another digest) are counted, and their
    signed deltas applied; without any, the table is read as it is. ``path`` belongs to one table, one list of columns
    and one list of tokens. Each state is a folder of its own, whole once its ``loads`` are written; the last two are
    kept, so that a reader of the one before can end.
    """
    spark = df.sparkSession
    columns = columns or [c for c in df.columns if c not in scope]
    require_columns(df, [*columns, *scope])
    prints = materialize(_load_prints(df, columns, scope))
    states = folders(spark, path, "loads/_SUCCESS")
    if states:
        counts, before = (spark.read.parquet(f"{path}/{states[-1]}/{part}") for part in ("counts", "loads"))
        same = prints.columns
        changed = prints.unionByName(before).groupBy(*same).agg(F.count(F.lit(1)).alias("_times")).where("_times = 1").select(*scope).distinct()
        changed = materialize(changed.select(*[F.col(c).alias(f"_{c}") for c in scope]))
        if changed.isEmpty():
            return counts

        def of_changed(rows: DataFrame) -> DataFrame:
            return rows.join(changed, [rows[c].eqNullSafe(changed[f"_{c}"]) for c in scope], "left_semi")

        new = apply_deltas(counts, signed_deltas(value_counts(of_changed(df), columns, scope, tokens), of_changed(counts)))
    else:
        new = value_counts(df, columns, scope, tokens)
    at = f"{path}/{int(states[-1].split('-')[0]) + 1 if states else 1:09d}-{uuid.uuid4().hex}"
    new.write.parquet(f"{at}/counts")
    prints.write.parquet(f"{at}/loads")
    for old in states[:-1]:
        delete_folder(spark, f"{path}/{old}")
    return spark.read.parquet(f"{at}/counts")


def _ruled(rules: dict[str, Rule], make) -> Column:
    """``make(rule)`` of the row's column; null for columns without a rule or where it gives None."""
    parts = [(c, made) for c, r in rules.items() if (made := make(r)) is not None]
    return F.coalesce(*[F.when(F.col("column_name") == c, made) for c, made in parts]) if parts else F.lit(None)


def profile_from_counts(counts: DataFrame, rules: dict[str, Rule] | None = None, scope: list[str] = ["load_id"]) -> DataFrame:
    """One row per scope and column: ``n_rows, n_null, null_rate, n_distinct, num_min, num_max, text_min,
    text_max, entropy_bits`` and, by the rules, ``n_pattern`` and ``n_range`` (rows that violate them).

    Exact, from the counts alone. A column of only nulls has entropy null and no range.
    """
    rules = rules or {}
    null = F.col("text_value").isNull() & F.col("num_value").isNull()
    given = F.when(~null, F.col("n"))
    off_pattern = F.coalesce(_ruled(rules, lambda r: ~F.col("text_value").rlike(rf"\A(?:{r.pattern})\z") if r.pattern else None), F.lit(False))
    off_range = F.coalesce(
        _ruled(rules, lambda r: (F.lit(False) if r.low is None else F.col("num_value") < r.low) | (F.lit(False) if r.high is None else F.col("num_value") > r.high)),
        F.lit(False),
    )
    total = F.sum(given)
    return counts.groupBy(*scope, "column_name").agg(
        F.sum("n").alias("n_rows"),
        F.coalesce(F.sum(F.when(null, F.col("n"))), F.lit(0)).alias("n_null"),
        F.count(given).alias("n_distinct"),
        F.min("num_value").alias("num_min"),
        F.max("num_value").alias("num_max"),
        F.min("text_value").alias("text_min"),
        F.max("text_value").alias("text_max"),
        (F.log2(total) - F.sum(given * F.log2(given)) / total).alias("entropy_bits"),
        F.coalesce(F.sum(F.when(off_pattern, F.col("n"))), F.lit(0)).alias("n_pattern"),
        F.coalesce(F.sum(F.when(off_range, F.col("n"))), F.lit(0)).alias("n_range"),
    ).withColumn("null_rate", F.col("n_null") / F.col("n_rows"))


def _sides(log: DataFrame) -> DataFrame:
    """``source, target, own``: each load that has a baseline, beside its own counts and beside its baseline's."""
    compared = log.where(F.col("baseline_load_id").isNotNull()).select("load_id", "baseline_load_id").distinct()
    sides = F.array(
        F.struct(F.col("load_id").alias("source"), F.col("load_id").alias("target"), F.lit(True).alias("own")),
        F.struct(F.col("baseline_load_id").alias("source"), F.col("load_id").alias("target"), F.lit(False).alias("own")),
    )
    return compared.select(F.inline(sides))


def distribution_change(counts: DataFrame, log: DataFrame) -> DataFrame:
    """``load_id, column_name, shift``: for texts half the sum of absolute differences of the shares among
    non-nulls, for numbers the largest difference of the two cumulative distributions.

    No row where the load or its baseline has no non-null value.

    Half the sum of the differences is one less the sum of the lesser shares, to which only values of both loads add: texts
    of one load alone, as of a key column, go no further than one shuffle by value.
    """
    keys, sides = ["load_id", "column_name"], _sides(log)
    texts, numbers = counts.where(F.col("text_value").isNotNull()), counts.where(F.col("num_value").isNotNull())
    sent = lambda rows: rows.withColumnRenamed("load_id", "source").join(sides, "source").withColumnRenamed("target", "load_id")
    part = lambda own: F.when(F.col("own") == own, F.col("n")).otherwise(0)
    totals = sent(texts.groupBy(*keys).agg(F.sum("n").alias("n"))).groupBy(*keys).agg(F.sum(part(True)).alias("all_now"), F.sum(part(False)).alias("all_base"))
    full = (F.col("all_now") > 0) & (F.col("all_base") > 0)
    several = texts.withColumn("_loads", F.count(F.lit(1)).over(Window.partitionBy("column_name", "text_value"))).where("_loads > 1")
    both = sent(several).groupBy(*keys, "text_value").agg(F.sum(part(True)).alias("now"), F.sum(part(False)).alias("base")).where("now > 0 and base > 0")
    lesser = F.least(F.col("now") / F.col("all_now"), F.col("base") / F.col("all_base"))
    common = both.join(totals, keys).groupBy(*keys).agg(F.sum(lesser).alias("_common"))
    by_text = totals.where(full).join(common, keys, "left").select(*keys, (1 - F.coalesce("_common", F.lit(0.0))).alias("shift"))
    pairs = sent(numbers).select(*keys, "num_value", part(True).alias("now"), part(False).alias("base"))
    summed = running_sums(pairs, keys, "num_value", ["now", "base"], with_totals=True, ties=True).where(full)
    gap = F.abs(F.col("cum_now") / F.col("all_now") - F.col("cum_base") / F.col("all_base"))
    return by_text.unionByName(summed.groupBy(*keys).agg(F.max(gap).alias("shift")))


def profile_with_changes(counts: DataFrame, log: DataFrame, rules: dict[str, Rule] | None = None) -> DataFrame:
    """``profile_from_counts`` by load, with ``baseline_load_id``, ``null_rate_change``, ``n_distinct_change`` and
    ``shift`` against the load's baseline; null where there is none. ``counts`` is a written table."""
    now = profile_from_counts(counts, rules)
    log = log.groupBy("load_id").agg(F.max("baseline_load_id").alias("baseline_load_id"))
    base = now.select(F.col("load_id").alias("baseline_load_id"), "column_name", F.col("null_rate").alias("_null"), F.col("n_distinct").alias("_distinct"))
    both = now.join(log, "load_id", "left").join(base, ["baseline_load_id", "column_name"], "left").join(distribution_change(counts, log), ["load_id", "column_name"], "left")
    changes = [(F.col("null_rate") - F.col("_null")).alias("null_rate_change"), (F.col("n_distinct") - F.col("_distinct")).alias("n_distinct_change")]
    return both.select(*now.columns, "baseline_load_id", *changes, "shift")


def findings(counts: DataFrame, log: DataFrame, rules: dict[str, Rule], written: bool = False) -> DataFrame:
    """``load_id, column_name, finding`` for every rule that a load breaks, alone or against its baseline.

    Shares are compared in whole numbers, so that a change of exactly the limit is no finding. Loads that the
    log does not list, or lists without baseline, are not compared. Without rows there are no findings.
    """
    # Read by the profile and by both sides of the comparison: written once, unless it is a ``written`` table.
    counts = counts if written else materialize(counts)
    now = profile_from_counts(counts, rules)
    keep = ["load_id", "column_name", "n_rows", "n_null", "n_distinct", "n_pattern", "n_range"]
    log = log.groupBy("load_id").agg(F.max("baseline_load_id").alias("baseline_load_id"))
    base = now.select(*[F.col(c).alias(f"base_{c}") for c in keep[2:]], F.col("load_id").alias("baseline_load_id"), "column_name")
    shifted = [c for c, r in rules.items() if r.shift is not None]
    change = distribution_change(counts.where(F.col("column_name").isin(*shifted)), log)
    both = (
        now.select(*keep)
        .join(log, "load_id", "left")
        .join(base, ["baseline_load_id", "column_name"], "left")
        .join(change, ["load_id", "column_name"], "left")
    )
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    null_gap = F.abs(wide("n_null") * wide("base_n_rows") - wide("base_n_null") * wide("n_rows"))
    limit = lambda x: F.lit(round(x * 10_000)).cast("decimal(5,0)")
    given = F.col("n_rows") - F.col("n_null")
    grew = lambda k: (F.col("n_distinct") >= k * F.col("base_n_distinct")) | (F.col("n_distinct") * k <= F.col("base_n_distinct"))
    some = (F.col("n_distinct") > 0) | (F.col("base_n_distinct") > 0)
    tests = {
        "null_rate": _ruled(rules, lambda r: null_gap * 10_000 > (wide("n_rows") * wide("base_n_rows")).cast("decimal(33,0)") * limit(r.null_change) if r.null_change is not None else None),
        "range": _ruled(rules, lambda r: F.col("n_range") > 0 if r.low is not None or r.high is not None else None),
        "pattern": _ruled(rules, lambda r: (given > 0) & (F.col("n_pattern") >= given * F.lit(r.pattern_share)) if r.pattern else None),
        "distinct_count": _ruled(rules, lambda r: some & grew(r.ratio) if r.ratio else None),
        "distribution": _ruled(rules, lambda r: F.col("shift") > r.shift + 1e-12 if r.shift is not None else None),
    }
    found = F.array_compact(F.array(*[F.when(F.coalesce(test.cast("boolean"), F.lit(False)), F.lit(name)) for name, test in tests.items()]))
    return both.select("load_id", "column_name", F.explode(found).alias("finding"))
