"""Problem 4: points near other points, and the region that contains a point.

Near points meet in cells of a grid in space (not in degrees, so that poles and the date line are no special
cases). Regions are cut into ordered slabs by a trapezoidal decomposition: between two neighbouring vertex
abscissas no edge begins or ends and none cross, so the edges of a slab are ordered; a point finds its slab
and then its edge by binary search. Slabs are rows, spread over the cluster by tile.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lavra.contracts import require_columns, require_range
from lavra.functions.numbers import PLAIN_NUMBER
from lavra.functions.text import strip
from lavra.session import materialize

EARTH_RADIUS_M = 6_371_000.0
#: Sides of its tiles that a region may be wide. Fewer mean more levels, on each of which every point is looked up.
SIDES = 8


def coordinate(c: Column) -> Column:
    """Degrees from a text with ``,`` or ``.``; null for null tokens, zero and what is no number."""
    # A one-element array binds the value, so that its expression occurs once.
    text = F.replace(strip(c.cast("string")), F.lit(","), F.lit("."))
    number = F.transform(F.array(text), lambda t: F.when(t.rlike(PLAIN_NUMBER), t.try_cast("double")))
    return F.element_at(F.transform(number, lambda v: F.when((v != 0) & (F.abs(v) < float("inf")), v)), 1)


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = EARTH_RADIUS_M) -> Column:
    """Great-circle distance (NUM-07)."""
    half = lambda a, b: F.pow(F.sin(F.radians(b - a) / 2), 2)
    h = half(lat1, lat2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half(lon1, lon2)
    return 2 * radius * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


def near_pairs(points: DataFrame, distance_m: float, id_col: str = "id", lat: str = "lat", lon: str = "lon", group: str | None = None) -> DataFrame:
    """``id_a, id_b``: each pair of different ids (smaller first) with points at most ``distance_m`` apart,
    within one ``group`` if named. Rows with a null id, coordinate or group take no part.

    Points on one spot are one point until the end; spots meet in grid cells of four times the distance: each
    spot is at home in one cell, and visits the cells that its surroundings touch, eight at most. Every pair
    comes from the home cell of one spot, so none is made twice; a crowded cell is a skewed join key, which
    adaptive execution splits.
    """
    require_columns(points, [id_col, lat, lon, *([group] if group else [])])
    require_range("distance_m", distance_m, low=0, open_ends=True)
    spot = (["g"] if group else []) + ["lat", "lon"]
    rows = points.select(
        F.col(id_col).alias("id"), *([F.col(group).alias("g")] if group else []), F.col(lat).cast("double").alias("lat"), F.col(lon).cast("double").alias("lon")
    ).where(" and ".join(f"{c} is not null" for c in ["id", *spot]))
    rows = rows.distinct()
    spots = rows.select(*spot).distinct()
    r, size = float(distance_m) * (1 + 1e-9), 4.0 * distance_m
    axes = {
        "x": F.cos(F.radians("lat")) * F.cos(F.radians("lon")),
        "y": F.cos(F.radians("lat")) * F.sin(F.radians("lon")),
        "z": F.sin(F.radians("lat")),
    }
    spots = spots.select(*spot, *[(v * EARTH_RADIUS_M).alias(k) for k, v in axes.items()])
    cell = lambda a, d=0.0: F.floor((F.col(a) + d) / size)
    group_key = ["g"] if group else []
    home = spots.select(*[F.col(c).alias(f"{c}_a") if c != "g" else "g" for c in spot], *[cell(a).alias(f"c{a}") for a in axes])
    visits = spots
    for a in axes:
        visits = visits.withColumn(f"c{a}", F.explode(F.array_distinct(F.array(cell(a, -r), cell(a, r)))))
    visits = visits.select(*[F.col(c).alias(f"{c}_b") if c != "g" else "g" for c in spot], *[f"c{a}" for a in axes])
    after = (F.col("lat_a") < F.col("lat_b")) | ((F.col("lat_a") == F.col("lat_b")) & (F.col("lon_a") < F.col("lon_b")))
    close = haversine_m(F.col("lat_a"), F.col("lon_a"), F.col("lat_b"), F.col("lon_b")) <= distance_m
    met = home.join(visits, [*group_key, *[f"c{a}" for a in axes]]).where(after & close)
    met = met.select(*group_key, "lat_a", "lon_a", "lat_b", "lon_b")
    at = lambda side: rows.select(*group_key, F.col("id").alias(f"i{side}"), F.col("lat").alias(f"lat_{side}"), F.col("lon").alias(f"lon_{side}"))
    apart = met.join(at("a"), [*group_key, "lat_a", "lon_a"]).join(at("b"), [*group_key, "lat_b", "lon_b"]).select("ia", "ib")
    crowded = rows.groupBy(*spot).agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    together = rows.join(crowded, spot, "left_semi").select(*[F.col(c) for c in spot], F.col("id").alias("ia"))
    together = together.join(together.withColumnRenamed("ia", "ib"), spot).where("ia < ib").select("ia", "ib")
    pairs = apart.unionByName(together).where("ia <> ib")
    return pairs.select(F.least("ia", "ib").alias("id_a"), F.greatest("ia", "ib").alias("id_b")).distinct()


def ring_edges(regions: DataFrame, region: str, wkt: str, group: str | None = None) -> DataFrame:
    """``group, region, ax, ay, bx, by``: all edges in ring order."""
    rings = regions.select(
        (F.col(group) if group else F.lit(0)).alias("group"), F.col(region).alias("region"), F.explode(F.regexp_extract_all(wkt, F.lit(r"\(([^()]+)\)"), F.lit(1))).alias("ring")
    )
    point = lambda t: F.transform(F.split(F.trim(t), r"\s+"), lambda v: v.try_cast("double"))
    rings = rings.select("group", "region", F.transform(F.split("ring", ","), point).alias("p"))
    nxt = F.concat(F.slice("p", F.lit(2), F.size("p") - 1), F.slice("p", 1, 1))
    edges = rings.select("group", "region", F.explode(F.arrays_zip(F.col("p").alias("a"), nxt.alias("b"))).alias("e"))
    xy = {k: F.element_at(F.col(f"e.{s}"), i) for k, (s, i) in {"ax": ("a", 1), "ay": ("a", 2), "bx": ("b", 1), "by": ("b", 2)}.items()}
    return edges.select("group", "region", *[v.alias(k) for k, v in xy.items()])


def wkt_edges(regions: DataFrame, region: str, wkt: str, group: str | None = None) -> DataFrame:
    """``group, region, x1, y1, x2, y2``: the edges of POLYGON and MULTIPOLYGON texts with ``x1 < x2``.

    Vertical edges bound no slab and are left out. Rings may be closed or not. Texts without rings give none.
    """
    edges = ring_edges(regions, region, wkt, group).where("ax <> bx")
    right = F.col("ax") < F.col("bx")
    pick = lambda a, b: F.when(right, F.col(a)).otherwise(F.col(b))
    return edges.select(
        "group", "region", pick("ax", "bx").alias("x1"), pick("ay", "by").alias("y1"), pick("bx", "ax").alias("x2"), pick("by", "ay").alias("y2")
    )


def _height(edge: Column, x: Column) -> Column:
    return edge["y1"] + (edge["y2"] - edge["y1"]) * (x - edge["x1"]) / (edge["x2"] - edge["x1"])


def slab_index(edges: DataFrame, tile: float) -> tuple[DataFrame, DataFrame]:
    """The decomposition of all regions, tile by tile.

    A region lies in tiles of its own size: level 0 has sides of ``tile`` degrees, each further level twice as long ones, and
    a region goes to the first level on which it is at most ``SIDES`` sides wide and high. So it touches nine rows and nine
    columns of tiles at most, be it a block or a whole state, and an edge goes to those rows of the columns it crosses.

    ``bounds``: ``group, level, tx, ty, xs`` with the sorted slab borders of a tile; ``slabs``: ``group, level, tx, ty, slab,
    spans`` with, for slab ``slab`` (from ``xs[slab-1]`` on), the stretches that lie inside a region, ordered
    from below: ``struct<lo, hi, region>`` of the bounding edges.
    """
    # Edges and bounds are read several times below: written once, they keep the plan small. The tiles that
    # each region's box touches; a region's edges go to the tiles of their columns.
    edges = materialize(edges)
    boxes = edges.groupBy("group", "region").agg(F.min("x1").alias("x0"), F.max("x2").alias("x9"), F.min(F.least("y1", "y2")).alias("y0"), F.max(F.greatest("y1", "y2")).alias("y9"))
    side = F.greatest(F.col("x9") - F.col("x0"), F.col("y9") - F.col("y0"))
    level = F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(side, F.lit(tile)) / (SIDES * tile)))).cast("int")
    boxes = boxes.withColumn("level", level).withColumn("size", F.pow(F.lit(2.0), F.col("level")) * tile)
    index = lambda v: F.floor(F.col(v) / F.col("size"))
    rows = boxes.select("group", "region", "level", "size", F.explode(F.sequence(index("y0"), index("y9"))).alias("ty"))
    placed = edges.join(rows, ["group", "region"]).withColumn("tx", F.explode(F.sequence(index("x1"), index("x2"))))
    key = ["group", "level", "tx", "ty"]
    left, right = F.col("tx") * F.col("size"), (F.col("tx") + 1) * F.col("size")
    xs = F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.array(F.greatest("x1", left), F.least("x2", right))))))
    bounds = materialize(placed.groupBy(*key).agg(xs.alias("xs")))
    cut = placed.join(bounds, key)
    spanned = F.filter(F.sequence(F.lit(1), F.size("xs") - 1), lambda i: (F.element_at("xs", i) >= F.col("x1")) & (F.element_at("xs", i + 1) <= F.col("x2")))
    edge = F.struct("x1", "y1", "x2", "y2")
    crossing = cut.where("size(xs) > 1").select(*key, "region", "xs", edge.alias("edge"), F.explode(spanned).alias("slab"))
    middle = (F.element_at("xs", F.col("slab")) + F.element_at("xs", F.col("slab") + 1)) / 2
    crossing = crossing.select(*key, "region", "slab", "edge", _height(F.col("edge"), middle).alias("mid"))
    stacked = crossing.groupBy(*key, "slab", "region").agg(F.array_sort(F.collect_list(F.struct("mid", "edge"))).alias("es"))
    stretch = F.transform(
        F.sequence(F.lit(1), F.floor(F.size("es") / 2).cast("int")),
        lambda i: F.struct(
            F.element_at("es", i * 2 - 1)["mid"].alias("at"), F.element_at("es", i * 2 - 1)["edge"].alias("lo"), F.element_at("es", i * 2)["edge"].alias("hi"), F.col("region").alias("region")
        ),
    )
    spans = stacked.where("size(es) > 1").select(*key, "slab", F.explode(stretch).alias("s"))
    # Stretches that do not reach into the tile's row are of no use there.
    size = F.pow(F.lit(2.0), F.col("level")) * tile
    low, high = F.col("ty") * size, (F.col("ty") + 1) * size
    reach = (F.least("s.lo.y1", "s.lo.y2") <= high) & (F.greatest("s.hi.y1", "s.hi.y2") >= low)
    return bounds, materialize(spans.where(reach).groupBy(*key, "slab").agg(F.array_sort(F.collect_list("s")).alias("spans")))


def _last_at_most(n: Column, reached) -> Column:
    """Binary search: the largest 1-based index whose ``reached(i)`` holds (it holds up to some index), or 0."""
    state = F.struct(F.lit(0).alias("lo"), n.cast("int").alias("hi"))

    def halve(s: Column, _: Column) -> Column:
        mid = F.floor((s["lo"] + s["hi"] + 1) / 2).cast("int")
        hit = reached(mid)
        narrowed = F.struct(F.when(hit, mid).otherwise(s["lo"]).alias("lo"), F.when(hit, s["hi"]).otherwise(mid - 1).alias("hi"))
        return F.when(s["lo"] < s["hi"], narrowed).otherwise(s)

    steps = F.sequence(F.lit(0), F.ceil(F.log2(n.cast("double") + 1)).cast("int"))
    return F.aggregate(steps, state, halve, lambda s: s["lo"])


def locate(points: DataFrame, edges: DataFrame, lat: str = "lat", lon: str = "lon", group: str | None = None, tile: float = 0.004, lower_border: bool = True) -> DataFrame:
    """``points`` with ``region``: the region that contains the point; points in none are left out.

    ``edges`` as ``wkt_edges`` gives them; regions do not overlap (where they do, one of them is found). A
    point on a lower border belongs to the region (unless ``lower_border`` is off), on an upper border to the next. ``tile`` is
    the side of the smallest tiles in degrees: about the size of a small region. Larger regions lie in larger tiles, and a
    point is looked up on each level that some region has (there are as many as sizes of regions have doublings). Rows
    with null coordinates or group are left out. A crowded tile is a skewed join key, which adaptive execution splits.
    """
    bounds, slabs = slab_index(edges, tile)
    # One row: the few levels in use, so it goes to every task.
    levels = bounds.agg(F.collect_set("level").alias("_levels"))
    placed = points.where(F.col(lat).isNotNull() & F.col(lon).isNotNull()).crossJoin(F.broadcast(levels))
    size = F.pow(F.lit(2.0), F.col("_level")) * tile
    placed = placed.select("*", F.explode("_levels").alias("_level")).drop("_levels").withColumns(
        {"_g": F.col(group) if group else F.lit(0), "_tx": F.floor(F.col(lon) / size), "_ty": F.floor(F.col(lat) / size)}
    )
    key = lambda t: (F.col("_g") == t["group"]) & (F.col("_level") == t["level"]) & (F.col("_tx") == t["tx"]) & (F.col("_ty") == t["ty"])
    found = placed.join(bounds, key(bounds)).drop("group", "level", "tx", "ty")
    found = found.withColumn("_slab", _last_at_most(F.size("xs"), lambda i: F.element_at("xs", i) <= F.col(lon))).drop("xs")
    found = found.join(slabs, key(slabs) & (F.col("_slab") == slabs["slab"])).drop("group", "level", "tx", "ty", "slab")
    at = _last_at_most(F.size("spans"), lambda i: _height(F.element_at("spans", i)["lo"], F.col(lon)) <= F.col(lat))
    found = found.withColumn("_span", F.try_element_at("spans", F.nullif(at, F.lit(0)))).drop("spans")
    inside = found.where(F.col("_span").isNotNull() & (F.col(lat) < _height(F.col("_span.hi"), F.col(lon))))
    if not lower_border:
        inside = inside.where(_height(F.col("_span.lo"), F.col(lon)) < F.col(lat))
    return inside.withColumn("region", F.col("_span.region")).drop("_span", "_slab", "_g", "_level", "_tx", "_ty")


def attach_region(
    points: DataFrame, regions: DataFrame, region: str, wkt: str, lat: str = "lat", lon: str = "lon", group: str | None = None, regions_group: str | None = None, tile: float = 0.004
) -> DataFrame:
    """JN-12: every row of ``points`` with ``region``, null where the coordinates are null, in no region, or on a border.

    Spots, not rows, are located. A point is on a border if it is on a vertex or vertical edge, or at the computed
    height of a slanted one.
    """
    spot = F.col(group) if group else F.lit(0)
    spots = points.select(spot.alias("_sg"), F.col(lat).alias("_slat"), F.col(lon).alias("_slon")).where("_sg is not null and _slat is not null and _slon is not null").distinct()
    held = locate(spots, wkt_edges(regions, region, wkt, regions_group), "_slat", "_slon", "_sg", tile, lower_border=False)
    ring = ring_edges(regions, region, wkt, regions_group)
    upright = ring.where("ax = bx").select("group", "ax", F.least("ay", "by").alias("low"), F.greatest("ay", "by").alias("high"))
    border = upright.unionByName(ring.select("group", "ax", F.col("ay").alias("low"), F.col("ay").alias("high"))).distinct()
    on_border = (F.col("_sg") == border["group"]) & (F.col("_slon") == border["ax"]) & F.col("_slat").between(border["low"], border["high"])
    held = held.join(border, on_border, "left_anti")
    at = [spot.eqNullSafe(F.col("_sg")), F.col(lat) == F.col("_slat"), F.col(lon) == F.col("_slon")]
    return points.join(held, at, "left").drop("_sg", "_slat", "_slon")
