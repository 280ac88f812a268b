"""Problem 8: a mixture of sources with target shares of all tokens.

A schedule of slots of equal tokens is laid out by a low-discrepancy sequence: slot k draws the point
frac(k * golden ratio), and the cumulative target weights say which source the point belongs to, so that every
stretch of the schedule is mixed as the whole is. The r-th slot of a source takes the r-th of its blocks:
shuffled documents, cut into blocks of equal tokens; after the last block the source begins again, at most
``max_repeats`` times.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lavra.contracts import ContractError, require_columns, require_range
from lavra.functions.stats import running_sums
from lavra.functions.text import strip
from lavra.session import materialize

GOLDEN = (math.sqrt(5) - 1) / 2
#: Tokens of a block and of a slot, the same for every corpus: slots grow with the data.
BLOCK_TOKENS = 1024
#: Ranges into which a source's shuffled documents are cut, 2 to this power: so many tasks may work on one source.
RANGE_BITS = 14
SLOT_RANGE = 4096
#: Targets are planned on the driver and sent to every task; more than these are no table of targets.
MOST_TARGETS = 10_000


def source_name(c: Column) -> Column:
    """Trimmed, lower case; null and empty stay null."""
    return F.nullif(F.lower(strip(c)), F.lit(""))


def _plan(sized: DataFrame, targets: DataFrame, total_tokens: int | None, block: int) -> dict:
    """Weights and quotas. Collects one row per target, nothing that grows with the documents."""
    held = sized.groupBy("source").agg(F.sum("n_tokens").alias("tokens"))
    rows = targets.join(held, "source", "left").select("source", "target_share", "max_repeats", F.coalesce("tokens", F.lit(0)).alias("tokens")).collect()
    if len({r.source for r in rows}) != len(rows):
        raise ContractError("mix targets: a source repeats")
    usable = sorted((r for r in rows if r.tokens > 0 and (r.target_share or 0) > 0 and (r.max_repeats or 0) > 0), key=lambda r: r.source)
    weight = sum(r.target_share for r in usable)
    shares = {r.source: r.target_share / weight for r in usable}
    most = min((r.tokens * r.max_repeats / shares[r.source] for r in usable), default=0)
    total = most if total_tokens is None else min(most, total_tokens)
    return {
        "shares": shares,
        "slots": int(total // block),
        "block": block,
        "cap": {r.source: math.ceil(r.tokens / block) * r.max_repeats for r in usable},
        "blocks": {r.source: math.ceil(r.tokens / block) for r in usable},
    }


def schedule(spark, shares: dict[str, float], n_slots: int) -> DataFrame:
    """``slot, source, nth``: the source of each slot and how many slots the source had before it."""
    slots = spark.range(n_slots).select(F.col("id").alias("slot"), (F.col("id") * F.lit(GOLDEN) - F.floor(F.col("id") * F.lit(GOLDEN))).alias("point"))
    edges, at = [], 0.0
    for name, share in shares.items():
        at += share
        edges.append((name, at))
    source = F.lit(edges[-1][0])
    for name, edge in reversed(edges[:-1]):
        source = F.when(F.col("point") < edge, F.lit(name)).otherwise(source)
    placed = slots.select("slot", source.alias("source"), F.lit(1).alias("one"))
    ranked = running_sums(placed, ["source"], "slot", ["one"], bucket=F.floor(F.col("slot") / SLOT_RANGE))
    return ranked.select("slot", "source", (F.col("cum_one") - 1).alias("nth"))


def mix(
    documents: DataFrame, targets: DataFrame, n_tokens: Column, id_col: str = "doc_id", source_col: str = "source",
    total_tokens: int | None = None, block_tokens: int = BLOCK_TOKENS, seed: int = 42,
) -> DataFrame:
    """``doc_id, source, repeat_no, slot, n_tokens``: one row per use of a document, in slot order.

    ``total_tokens`` (default: as many as the targets allow) is reached to within a block per source. A target
    without documents, or with no share, gets nothing and the other shares are scaled to one; documents of
    other or null sources, and documents without tokens, are left out. ``repeat_no`` runs from 1 to at most
    ``max_repeats``. Empty tables give no rows. The same seed gives the same mixture.

    Slots and blocks have ``block_tokens`` tokens, whatever the size of the corpus. A document lies in the block in which it
    begins; one longer than a block leaves the slots of the blocks it fills empty, so that shares hold over the whole.
    """
    require_columns(documents, [id_col, source_col], "documents")
    require_columns(targets, ["source", "target_share", "max_repeats"], "targets")
    require_range("block_tokens", block_tokens, 1)
    targets = targets.select(source_name(F.col("source")).alias("source"), "target_share", "max_repeats")
    names = source_name(F.col(source_col))
    sized = documents.select(F.col(id_col).alias("doc_id"), names.alias("source"), n_tokens.alias("n_tokens"))
    # One row per source by contract, and no more than MOST_TARGETS: checked, so they may go to every task.
    if targets.limit(MOST_TARGETS + 1).count() > MOST_TARGETS:
        raise ContractError(f"mix targets: more than {MOST_TARGETS} rows")
    sized = materialize(sized.join(F.broadcast(targets.select("source").distinct()), "source", "left_semi")).where("n_tokens > 0")
    plan = _plan(sized, targets, total_tokens, block_tokens)
    spark = documents.sparkSession
    if not plan["slots"]:
        return spark.createDataFrame([], "doc_id bigint, source string, repeat_no int, slot bigint, n_tokens bigint")
    shuffled = sized.withColumn("_at", F.xxhash64("doc_id", F.lit(seed)))
    spread = F.shiftrightunsigned(F.col("_at"), 64 - RANGE_BITS)
    # xxhash64 is signed; the unsigned shift numbers its ranges from the non-negative up, so order by the same.
    ordered = shuffled.withColumns({"_range": spread, "_rest": F.col("_at").bitwiseAND(F.lit((1 << (64 - RANGE_BITS)) - 1))})
    summed = running_sums(ordered, ["source"], ["_rest", "doc_id"], ["n_tokens"], bucket=F.col("_range"))
    block = F.floor((F.col("cum_n_tokens") - F.col("n_tokens")) / plan["block"])
    blocks = summed.select("doc_id", "source", "n_tokens", block.alias("block"))
    of = lambda d: F.coalesce(*[F.when(F.col("source") == k, F.lit(v)) for k, v in d.items()])
    slots = schedule(spark, plan["shares"], plan["slots"]).where(F.col("nth") < of(plan["cap"]))
    slots = slots.select("slot", "source", (F.col("nth") % of(plan["blocks"])).alias("block"), (F.floor(F.col("nth") / of(plan["blocks"])) + 1).cast("int").alias("repeat_no"))
    return slots.join(blocks, ["source", "block"]).select("doc_id", "source", "repeat_no", "slot", "n_tokens")


def reached_shares(mixture: DataFrame, targets: DataFrame) -> DataFrame:
    """``source, target_share, actual_share, n_tokens, n_documents, most_repeats`` per target, also for those
    that got nothing."""
    targets = targets.select(source_name(F.col("source")).alias("source"), "target_share")
    used = mixture.groupBy("source").agg(
        F.sum("n_tokens").alias("n_tokens"), F.count_distinct("doc_id").alias("n_documents"), F.max("repeat_no").alias("most_repeats")
    )
    total = used.agg(F.sum("n_tokens").alias("all"))
    both = targets.join(used, "source", "left").crossJoin(F.broadcast(total))  # one row beside one row per target
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    share = F.coalesce(F.col("n_tokens") / F.col("all"), F.lit(0.0))
    return both.select("source", "target_share", share.alias("actual_share"), zero("n_tokens"), zero("n_documents"), zero("most_repeats"))
