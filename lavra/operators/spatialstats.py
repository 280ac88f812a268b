"""Contiguity, Moran statistics, concentration and density (JN-15, STA-04 .. STA-10, AGG-22, WIN-11)."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lavra.contracts import require_range
from lavra.session import materialize, ship_package


def vertices(regions: DataFrame, region: str, wkt: str, group: str) -> DataFrame:
    """``group, region, x, y``: the distinct vertices of each region, to seven places."""
    found = regions.select(F.col(group).alias("group"), F.col(region).alias("region"), F.explode(F.regexp_extract_all(wkt, F.lit(r"(-?[0-9.]+ +-?[0-9.]+)"), F.lit(1))).alias("p"))
    xy = F.split("p", " +")
    return found.select("group", "region", *[F.round(xy[i].try_cast("double"), 7).alias(c) for i, c in enumerate("xy")]).distinct()


def queen_edges(points: DataFrame) -> DataFrame:
    """JN-15, STA-05: ``group, src, dst, w`` for regions that share a vertex; the weights of a region add up to
    one. Regions without neighbours have no edge. A vertex belongs to few regions, so the join stays linear."""
    other = points.withColumnRenamed("region", "dst")
    edges = points.withColumnRenamed("region", "src").join(other, ["group", "x", "y"]).where("src <> dst").select("group", "src", "dst").distinct()
    return edges.withColumn("w", 1.0 / F.count(F.lit(1)).over(Window.partitionBy("group", "src")))


def outline(ring_edges: DataFrame) -> DataFrame:
    """AGG-25: the border of the union of regions that share whole edges, as ``group, ax, ay, bx, by``: the edges that only
    one ring has. ``ring_edges`` holds ``group, ax, ay, bx, by``; coordinates are compared to seven places."""
    at = {c: F.round(c, 7).alias(c) for c in ("ax", "ay", "bx", "by")}
    e = ring_edges.select("group", *at.values()).where("ax <> bx or ay <> by")
    turned = (F.col("ax") > F.col("bx")) | ((F.col("ax") == F.col("bx")) & (F.col("ay") > F.col("by")))
    swap = {"ax": "bx", "ay": "by", "bx": "ax", "by": "ay"}
    e = e.select("group", *[F.when(turned, F.col(o)).otherwise(F.col(c)).alias(c) for c, o in swap.items()])
    return e.groupBy("group", "ax", "ay", "bx", "by").agg(F.count(F.lit(1)).alias("_n")).where("_n = 1").drop("_n")


def moran_local(values: DataFrame, edges: DataFrame, by: list[str]) -> DataFrame:
    """STA-07, exact part (``moran_clusters`` adds significance): ``by, group, region, z, lag_z, local_i, quadrant`` over ``values`` (``by, group,
    region, value``), regions without neighbours left out. Quadrants: 1 high among high, 2 low among high,
    3 low among low, 4 high among low."""
    valued = values.where(F.col("value").isNotNull())
    pairs = edges.select("group", F.col("src").alias("region"), "dst").join(valued.select(*by, "group", F.col("region").alias("dst"), F.col("value").alias("_vn")), ["group", "dst"])
    # Neighbours without a value are no neighbours: the weights are scaled to those that have one. A region left
    # without neighbours counts for nothing, the mean included.
    lag = pairs.groupBy(*by, "group", "region").agg(F.avg("_vn").alias("_lag"))
    unit = Window.partitionBy(*by, "group")
    both = valued.join(lag, [*by, "group", "region"]).withColumn("_mean", F.avg("value").over(unit))
    both = both.withColumns({"z": F.col("value") - F.col("_mean"), "lag_z": F.col("_lag") - F.col("_mean")})
    # Variance and count are those of the regions that have a neighbour with a value.
    both = both.withColumns({"_s": F.sum(F.col("z") * F.col("z")).over(unit), "_n": F.count(F.lit(1)).over(unit)})
    local = F.try_divide((F.col("_n") - 1) * F.col("z") * F.col("lag_z"), F.col("_s"))
    quadrant = F.when((F.col("z") > 0) & (F.col("lag_z") > 0), 1).when((F.col("z") <= 0) & (F.col("lag_z") > 0), 2).when((F.col("z") <= 0) & (F.col("lag_z") <= 0), 3).otherwise(4)
    return both.select(*by, "group", "region", "z", "lag_z", local.alias("local_i"), quadrant.alias("quadrant"))


def moran_global(local: DataFrame, by: list[str]) -> DataFrame:
    """STA-06, exact part: ``moran_i = sum(z lag) / sum(z z)``, its expectation and the number of regions. Null
    where the values do not vary."""
    i = F.try_divide(F.sum(F.col("z") * F.col("lag_z")), F.sum(F.col("z") * F.col("z")))
    n = F.count(F.lit(1))
    return local.groupBy(*by, "group").agg(n.alias("n"), i.alias("moran_i"), (-F.try_divide(F.lit(1.0), n - 1.0)).alias("expected_i"))


def moran_permutations(values: DataFrame, edges: DataFrame, by: list[str], permutations: int = 999, seed: int = 42, per_task: int = 100) -> DataFrame:
    """STA-06: pseudo p-value and z-score of the global statistic by shuffling the values over the regions.

    One row per unit of analysis holds its regions (a municipality's mesh); the permutations are spread over
    tasks, each with a generator seeded by unit and permutation, so that the result does not depend on how
    the work is divided.
    """
    require_range("permutations", permutations, 99)
    ship_package()
    z = moran_local(values, edges, by).select(*by, "group", "region", "z")
    nodes = z.groupBy(*by, "group").agg(F.array_sort(F.collect_list(F.struct("region", "z"))).alias("nodes"))
    pairs = edges.select("group", "src", "dst").groupBy("group").agg(F.collect_list(F.struct("src", "dst")).alias("pairs"))
    unit = F.concat_ws("|", *[F.col(c).cast("string") for c in [*by, "group"]])
    work = nodes.join(pairs, "group").withColumn("unit", unit)
    work = work.withColumn("first", F.explode(F.sequence(F.lit(0), F.lit(permutations - 1), F.lit(per_task))))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for r in frame.itertuples():
                index = {n["region"]: i for i, n in enumerate(r.nodes)}
                value = np.array([n["z"] for n in r.nodes], float)
                ends = np.array([(index[p["src"]], index[p["dst"]]) for p in r.pairs if p["src"] in index and p["dst"] in index], int).reshape(-1, 2)
                weight = 1.0 / np.bincount(ends[:, 0], minlength=len(value))[ends[:, 0]] if len(ends) else np.zeros(0)
                scale = float((value * value).sum())
                if not scale:
                    continue
                stat = lambda v: float((v[ends[:, 0]] * v[ends[:, 1]] * weight).sum() / scale)  # noqa: B023, E731
                observed = stat(value)
                for k in range(r.first, min(r.first + per_task, permutations)):
                    rng = np.random.default_rng([seed, k, zlib.crc32(r.unit.encode())])
                    rows.append((*[getattr(r, c) for c in by], r.group, observed, stat(rng.permutation(value))))
            yield pd.DataFrame(rows, columns=[*by, "group", "observed", "simulated"])

    kinds = dict(z.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in [*by, "group"]) + ", observed double, simulated double"
    drawn = work.drop("unit").withColumn("unit", unit).mapInPandas(run, schema)
    larger = F.count_if(F.col("simulated") >= F.col("observed"))
    extreme = F.least(larger, F.count(F.lit(1)) - larger)
    return drawn.groupBy(*by, "group").agg(
        F.max("observed").alias("moran_i"), ((extreme + 1) / (F.count(F.lit(1)) + 1)).alias("p_sim"),
        F.try_divide(F.max("observed") - F.avg("simulated"), F.stddev_pop("simulated")).alias("z_sim"), F.count(F.lit(1)).alias("permutations"),
    )


def value_frame(indicators: DataFrame, metric: str, by: list[str], least: int = 5, count: str = "n_transacoes") -> DataFrame:
    """PRJ-20, value: ``by, group, region, value`` of the regions with at least ``least`` transactions and a metric."""
    return indicators.where((F.col(count) >= least) & F.col(metric).isNotNull()).select(*by, "group", "region", F.col(metric).cast("double").alias("value"))


def volume_frame(counts: DataFrame, by: list[str], count: str = "n_transacoes") -> DataFrame:
    """PRJ-20, volume: ``by, group, region, value`` of all regions, ``value = log(1 + count)``, a missing count zero."""
    return counts.select(*by, "group", "region", F.log1p(F.coalesce(F.col(count), F.lit(0))).alias("value"))


def moran_clusters(
    values: DataFrame, edges: DataFrame, by: list[str], permutations: int = 999, alpha: float = 0.05, seed: int = 42, per_task: int = 200
) -> DataFrame:
    """STA-07: ``moran_local`` with ``p_sim`` and ``cluster``: HH, LH, LL, HL, or NS where ``p_sim > alpha``.

    Conditional permutations: a region keeps its value, its neighbours' values are drawn without replacement
    from all other regions of the unit; the regions of a unit share the draws. The regions are spread over tasks, the
    draws are seeded by unit. The p-value counts the draws at least as extreme on the nearer side; a draw equal to the
    observed one counts on both, so that a region whose neighbours are all others is not significant. Units of
    fewer than three regions, or whose values do not vary, have a null p-value and cluster.
    """
    require_range("permutations", permutations, 99)
    ship_package()
    local = materialize(moran_local(values, edges, by))
    nodes = local.groupBy(*by, "group").agg(F.array_sort(F.collect_list(F.struct("region", "z"))).alias("nodes"))
    pairs = edges.select("group", "src", "dst").groupBy("group").agg(F.collect_list(F.struct("src", "dst")).alias("pairs"))
    unit = F.concat_ws("|", *[F.col(c).cast("string") for c in [*by, "group"]])
    work = nodes.where("size(nodes) > 2").join(pairs, "group").withColumn("unit", unit)
    work = work.withColumn("first", F.explode(F.sequence(F.lit(0), F.size("nodes") - 1, F.lit(per_task)))).repartition(*by, "group", "first")
    kinds = dict(local.dtypes)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for r in frame.itertuples():
                names = [n["region"] for n in r.nodes]
                index = {name: i for i, name in enumerate(names)}
                z = np.array([n["z"] for n in r.nodes], float)
                scale = float(np.abs(z).max())
                if scale <= 1e-12:
                    continue
                near: list[list[int]] = [[] for _ in names]
                for p in r.pairs:
                    if p["src"] in index and p["dst"] in index:
                        near[index[p["src"]]].append(index[p["dst"]])
                rng = np.random.default_rng([seed, zlib.crc32(r.unit.encode())])
                most = max(map(len, near))
                draws = np.stack([rng.permutation(len(z) - 1)[:most] for _ in range(permutations)])
                for i in range(r.first, min(r.first + per_task, len(z))):
                    drawn = draws[:, : len(near[i])]
                    # Without the region itself.
                    simulated = z[i] * z[drawn + (drawn >= i)].mean(axis=1)
                    observed, slack = z[i] * z[near[i]].mean(), 1e-12 * scale * scale
                    extreme = min((simulated >= observed - slack).sum(), (simulated <= observed + slack).sum())
                    rows.append((*[getattr(r, c) for c in by], r.group, names[i], (extreme + 1) / (permutations + 1)))
            yield pd.DataFrame(rows, columns=[*by, "group", "region", "p_sim"])

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in [*by, "group", "region"]) + ", p_sim double"
    tested = local.join(work.mapInPandas(run, schema), [*by, "group", "region"], "left")
    named = F.when(F.col("p_sim") > alpha, "NS").when(F.col("p_sim").isNotNull(), F.element_at(F.array(*map(F.lit, ("HH", "LH", "LL", "HL"))), F.col("quadrant")))
    return tested.withColumn("cluster", named)


def concentration(counts: DataFrame, by: list[str], value: str, top: int = 10) -> DataFrame:
    """AGG-22, STA-04: over a dense domain (zeros included): how many units, how many active, total, HHI, its
    reciprocal, Gini, and the shares of the top ``top`` units and of the top tenth of units (one at least)."""
    unit = Window.partitionBy(*by)
    ranked = counts.withColumns({
        "_v": F.coalesce(F.col(value).cast("double"), F.lit(0.0)),
        "_n": F.count(F.lit(1)).over(unit),
    })
    ranked = ranked.withColumns({"_t": F.sum("_v").over(unit), "_r": F.row_number().over(unit.orderBy("_v"))})
    from_top = F.col("_n") - F.col("_r") + 1
    share = F.try_divide(F.col("_v"), F.col("_t"))
    gini = F.try_divide(2 * F.sum(F.col("_r") * F.col("_v")), F.max("_n") * F.max("_t")) - (F.max("_n") + 1.0) / F.max("_n")
    hhi = F.sum(share * share)
    return ranked.groupBy(*by).agg(
        F.max("_n").alias("n_units"), F.count_if(F.col("_v") > 0).alias("n_active"), F.max("_t").alias("total"), hhi.alias("hhi"), F.try_divide(F.lit(1.0), hhi).alias("effective_units"),
        gini.alias("gini"), (F.sum(F.when(from_top <= top, share)) * 100).alias(f"pct_top_{top}"),
        (F.sum(F.when(from_top <= F.greatest(F.lit(1), F.ceil(F.col("_n") * 0.1)), share)) * 100).alias("pct_top_10_percent"),
    )


def hexbin(points: DataFrame, x: str, y: str, size: float, by: list[str] = []) -> DataFrame:
    """STA-10: points per hexagon of width ``size``: ``hx, hy`` (its centre) and ``n``. Two staggered grids; a
    point goes to the nearer centre."""
    h = size * 3**0.5
    gx, gy = F.col(x) / size, F.col(y) / h
    a = (F.round(gx), F.round(gy))
    b = (F.floor(gx) + 0.5, F.floor(gy) + 0.5)
    far = lambda c: F.pow(gx - c[0], 2) + 3.0 * F.pow(gy - c[1], 2)
    first = far(a) < far(b)
    cells = points.select(*by, F.when(first, a[0]).otherwise(b[0]).alias("cx"), F.when(first, a[1]).otherwise(b[1]).alias("cy"))
    return cells.groupBy(*by, "cx", "cy").agg(F.count(F.lit(1)).alias("n")).select(*by, (F.col("cx") * size).alias("hx"), (F.col("cy") * h).alias("hy"), "n")
