"""Problems 2 and 4 on small fixtures and against brute force."""

import itertools
import math
import random

from pyspark.sql import functions as F

from lavra.operators import points, profile
from lavra.operators.profile import Rule

LOG = "load_id long, baseline_load_id long"


def test_counts_deltas_and_profile(spark):
    df = spark.createDataFrame(
        [(1, "A", 1.0, None), (1, " a ", float("nan"), None), (1, "NULL", 0.0, True), (1, None, -0.0, False), (1, "A", 1.0, None)],
        "load_id long, t string, x double, n boolean",
    )
    counts = profile.value_counts(df)
    got = {(r.column_name, r.text_value, r.num_value): r.n for r in counts.collect()}
    assert got == {
        ("t", "A", None): 2, ("t", " a ", None): 1, ("t", None, None): 2, ("x", None, 1.0): 2, ("x", None, None): 1, ("x", None, 0.0): 2,
        ("n", None, None): 3, ("n", "true", None): 1, ("n", "false", None): 1,
    }
    p = {r.column_name: r for r in profile.profile_from_counts(counts, {"t": Rule(pattern="[A-Z]"), "x": Rule(low=1)}).collect()}
    assert (p["t"].n_rows, p["t"].n_null, p["t"].n_distinct, p["t"].n_pattern) == (5, 2, 2, 1)
    assert (p["x"].num_min, p["x"].num_max, p["x"].n_range) == (0.0, 1.0, 2)
    assert math.isclose(p["t"].entropy_bits, -(2 / 3) * math.log2(2 / 3) - (1 / 3) * math.log2(1 / 3))
    less = profile.value_counts(df.where("x = 1.0"))
    back = profile.apply_deltas(profile.apply_deltas(counts, profile.signed_deltas(less.limit(0), less)), less)
    assert sorted(map(str, back.collect())) == sorted(map(str, counts.collect()))


def test_maintained_counts_follow_the_loads(spark, tmp_path, monkeypatch):
    path, schema = f"file://{tmp_path}/counts", "load_id long, t string, u string, x double"
    first = [(1, "A", None, 1.0), (1, "A", None, 1.0), (2, "B", "C", None), (None, "Z", "Z", 0.5)]
    counted = []
    count = profile.value_counts
    monkeypatch.setattr(profile, "value_counts", lambda df, *a: counted.append({r.load_id for r in df.select("load_id").distinct().collect()}) or count(df, *a))
    steps = [
        (first, {1, 2, None}),
        (first[::-1], None),
        ([*first, (1, "A", None, 1.0), (3, "N", "M", 2.0)], {1, 3}),  # a repeated row, a new load
        ([first[0], (2, "B", None, None), (2, "C", "B", 4.0), first[3]], {1, 2}),  # replaced loads, one gone
        ([first[0], (2, None, "B", None), (2, "C", "B", 4.0), (None, "Z", "Y", 0.5)], {2, None}),
    ]
    for rows, want in steps:
        df, counted[:] = spark.createDataFrame(rows, schema), []
        got = profile.maintained_counts(df, path)
        assert counted == ([want] if want else [])
        assert sorted(map(str, got.collect())) == sorted(map(str, count(df).collect()))
    assert len(list((tmp_path / "counts").iterdir())) == 2


def test_profile_gives_the_change_from_the_load_before(spark):
    df = spark.createDataFrame([(1, "A", 1.0), (1, "B", 2.0), (2, "A", 5.0), (2, None, 2.0), (2, "A", 6.0), (2, None, 7.0)], "load_id long, t string, x double")
    log = spark.createDataFrame([(1, None), (2, 1)], LOG)
    got = {(r.load_id, r.column_name): (r.null_rate_change, r.n_distinct_change, r.shift) for r in profile.profile_with_changes(profile.value_counts(df), log).collect()}
    assert got == {(1, "t"): (None, None, None), (1, "x"): (None, None, None), (2, "t"): (0.5, -1, 0.5), (2, "x"): (0.0, 2, 0.75)}


def brute_findings(rows, log, rule):
    out = set()
    for load, base in log:
        now = [v for l, v in rows if l == load]
        if not now:
            continue
        given = [v for v in now if v is not None]
        if any(v < rule.low or v > rule.high for v in given):
            out.add((load, "range"))
        old = [v for l, v in rows if l == base]
        if not old:
            continue
        if abs((len(now) - len(given)) * len(old) - sum(v is None for v in old) * len(now)) * 25 > len(now) * len(old):
            out.add((load, "null_rate"))
        before = [v for v in old if v is not None]
        if given and before:
            ks = max(abs(sum(v <= x for v in given) / len(given) - sum(v <= x for v in before) / len(before)) for x in given + before)
            if ks > rule.shift + 1e-12:
                out.add((load, "distribution"))
    return out


def test_findings_against_brute_force(spark):
    rng = random.Random(3)
    rows = [(load, rng.choice([None, *[round(rng.gauss(load % 3, 2), 1)] * 9])) for load in range(1, 9) for _ in range(rng.randint(5, 60))]
    log = [(1, None), *[(k, k - 1) for k in range(2, 9)], (20, 1)]
    rule = Rule(low=-3, high=5, null_change=0.04, shift=0.2)
    df = spark.createDataFrame(rows, "load_id long, x double")
    found = profile.findings(profile.value_counts(df), spark.createDataFrame(log, LOG), {"x": rule})
    assert {(r.load_id, r.finding) for r in found.collect()} == brute_findings(rows, log, rule)


def test_findings_text_edges(spark):
    rule = {"t": Rule(pattern="[A-Z]+", null_change=0.04, ratio=2, shift=0.3)}
    rows = [(1, "A")] * 50 + [(1, "B")] * 50 + [(2, "A")] * 96 + [(2, None)] * 4 + [(3, None)] * 3 + [(4, "A\n")] * 1 + [(4, "A")] * 99
    df = spark.createDataFrame(rows, "load_id long, t string")
    log = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 4)], LOG)
    found = {(r.load_id, r.finding) for r in profile.findings(profile.value_counts(df), log, rule).collect()}
    # Exactly 0.04 more nulls are none; half the distinct values are one; nothing to compare the nulls of load 3 by.
    assert found == {(2, "distinct_count"), (2, "distribution"), (3, "null_rate"), (3, "distinct_count"), (4, "pattern")}
    assert profile.findings(profile.value_counts(df.limit(0)), log, rule).count() == 0


def haversine(a, b):
    (la1, lo1), (la2, lo2) = [(math.radians(x), math.radians(y)) for x, y in (a, b)]
    h = math.sin((la2 - la1) / 2) ** 2 + math.cos(la1) * math.cos(la2) * math.sin((lo2 - lo1) / 2) ** 2
    return 2 * points.EARTH_RADIUS_M * math.asin(min(1, math.sqrt(h)))


def test_near_pairs_against_brute_force(spark):
    rng = random.Random(1)
    rows = []
    for i in range(250):
        lat0, lon0 = rng.choice([(-20.0, -44.0), (89.9999, 10.0), (0.0001, 179.9999), (0.0001, -179.9999)])
        rows.append((i, lat0 + rng.uniform(-5e-4, 5e-4) * (0.1 if lat0 > 80 else 1), lon0 + rng.uniform(-5e-4, 5e-4), "g"))
    rows += [(900, -20.0, -44.0, "g"), (901, -20.0, -44.0, "g"), (901, -20.0, -44.0, "g"), (902, -20.0, -44.0, "h"), (903, None, 1.0, "g"), (904, -20.0, -44.0, None)]
    df = spark.createDataFrame(rows, "id long, lat double, lon double, grp string")
    got = {(r.id_a, r.id_b) for r in points.near_pairs(df, 20.0, group="grp").collect()}
    want = {
        (min(a[0], b[0]), max(a[0], b[0]))
        for a, b in itertools.combinations(rows, 2)
        if a[0] != b[0] and a[3] and a[3] == b[3] and None not in (a[1], b[1]) and haversine(a[1:3], b[1:3]) <= 20
    }
    assert got == want
    assert points.near_pairs(df.limit(0), 20.0, group="grp").count() == 0


def inside(lat, lon, rings):
    hit = False
    for ring in rings:
        for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
            if (x1 <= lon) != (x2 <= lon) and lat < y1 + (y2 - y1) * (lon - x1) / (x2 - x1):
                hit = not hit
    return hit


def test_locate_against_ray_casting(spark):
    rng = random.Random(2)
    shapes = {}
    for i in range(4):
        for j in range(4):
            x, y = i * 0.01, j * 0.01
            if (i, j) == (1, 2):
                continue
            outer = [(x, y), (x + 0.004, y + 0.001), (x + 0.009, y), (x + 0.008, y + 0.009), (x + 0.0045, y + 0.006), (x + 0.0005, y + 0.0085)]
            hole = [(x + 0.003, y + 0.003), (x + 0.005, y + 0.0035), (x + 0.004, y + 0.005)]
            shapes[f"r{i}{j}"] = [outer, hole]
    shapes["multi"] = [[(0.05, 0.0), (0.06, 0.0), (0.06, 0.01)], [(0.07, 0.0), (0.08, 0.0), (0.08, 0.01), (0.07, 0.01)]]
    text = lambda ring: "(" + ", ".join(f"{x!r} {y!r}" for x, y in [*ring, ring[0]]) + ")"
    wkt = [(k, "m", f"POLYGON ({', '.join(map(text, v))})" if k != "multi" else f"MULTIPOLYGON ({', '.join(f'({text(r)})' for r in v)})") for k, v in shapes.items()]
    wkt += [("none", "m", None), ("empty", "m", "POLYGON EMPTY"), ("other", "n", f"POLYGON ({text([(0, 0), (1, 0), (1, 1), (0, 1)])})")]
    pts = [(i, rng.uniform(-0.001, 0.041), rng.uniform(-0.001, 0.085), "m", "clash") for i in range(1200)] + [(5000, None, 0.0, "m", "x"), (5001, 0.1, 0.1, None, "x")]
    p = spark.createDataFrame(pts, "id long, lat double, lon double, grp string, ring string")
    edges = points.wkt_edges(spark.createDataFrame(wkt, "region string, grp string, w string"), "region", "w", "grp")
    for tile in (0.004, 0.05):
        got = {r.id: r.region for r in points.locate(p, edges, group="grp", tile=tile).collect()}
        want = {i: k for i, lat, lon, g, _ in pts if g and lat is not None for k, rings in shapes.items() if inside(lat, lon, rings)}
        assert got == want


def test_attach_region_keeps_all_rows_and_leaves_borders_out(spark):
    wkt = [("a", "m", "POLYGON ((0 0, 2 0, 2 2, 0 2, 0 0), (0.5 0.5, 1 0.75, 0.5 1, 0.5 0.5))"), ("b", "m", "POLYGON ((2 0, 4 0, 4 2, 2 2, 2 0))")]
    regions = spark.createDataFrame(wkt, "region string, g string, w string")
    cases = {(1.5, 1.5): "a", (1.0, 3.0): "b", (1.0, 2.0): None, (0.0, 1.0): None, (2.0, 1.0): None, (1.0, 0.0): None, (0.75, 1.0): None, (0.75, 0.75): None, (9.0, 9.0): None, (None, 1.0): None, (0.75, 1.5): "a"}
    rows = [(i, lat, lon, "m") for i, (lat, lon) in enumerate(cases)] * 2 + [(90, 1.5, 1.5, None), (91, 1.5, 1.5, "z")]
    df = spark.createDataFrame(rows, "id long, lat double, lon double, grp string")
    got = points.attach_region(df, regions, "region", "w", group="grp", regions_group="g", tile=0.7).collect()
    want = {**dict(enumerate(cases.values())), 90: None, 91: None}
    assert len(got) == len(rows) and {r.id: r.region for r in got} == want


def test_coordinate(spark):
    rows = ["-19,5", " -19.5 ", "0", "0,0", "nan", "NULL", "", None, "12abc", "1e999", "91"]
    got = [r.v for r in spark.createDataFrame([(x,) for x in rows], "t string").select(points.coordinate(F.col("t")).alias("v")).collect()]
    assert got == [-19.5, -19.5, None, None, None, None, None, None, None, None, 91.0]


def test_large_regions_lie_in_large_tiles(spark):
    """A region of two degrees beside small ones: found right, and its edges are copied a few times, not once per small tile."""
    around = lambda x, y, w, n: [(x + w * math.cos(2 * math.pi * i / n), y + w * math.sin(2 * math.pi * i / n)) for i in range(n)]
    rings = {"big": around(10.0, 10.0, 1.0, 48), "small": around(12.5, 10.0, 0.003, 12), "mid": around(12.5, 12.0, 0.05, 20)}
    wkt = [(name, "POLYGON ((" + ", ".join(f"{x} {y}" for x, y in [*r, r[0]]) + "))") for name, r in rings.items()]
    edges = points.wkt_edges(spark.createDataFrame(wkt, "region string, wkt string"), "region", "wkt")
    asked = [(1, 10.0, 10.0), (2, 10.5, 9.5), (3, 11.2, 10.0), (4, 12.5, 10.001), (5, 12.5, 10.01), (6, 12.53, 12.0), (7, 10.99, 10.0)]
    got = {r.id: r.region for r in points.locate(spark.createDataFrame(asked, "id int, lon double, lat double"), edges).collect()}
    assert got == {1: "big", 2: "big", 4: "small", 6: "mid", 7: "big"}
    bounds, slabs = points.slab_index(edges, 0.004)
    assert bounds.count() <= 3 * 81 and bounds.select("level").distinct().count() == 3
