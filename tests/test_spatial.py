from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from careshed.functions.geo import in_ring
from careshed.operators import allocation as al
from careshed.operators import coverage as cv
from careshed.operators import spatial as sp


def km(a, b):
    p, q = math.radians(a[1]), math.radians(b[1])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[0] - a[0]) / 2) ** 2
    return 2 * 6371.0 * math.asin(math.sqrt(h))


@pytest.fixture(scope="module")
def world():
    rng = random.Random(5)
    facilities = [(i, 35 + rng.random(), 30 + rng.random(), rng.randrange(0, 50), rng.randrange(4), f"G{i % 3}") for i in range(14)]
    cells = [(i, i // 20, i % 20, 35 + (i % 20) / 19, 30 + (i // 20) / 19, rng.randrange(0, 100)) for i in range(400)]
    return facilities, cells


@pytest.fixture(scope="module")
def frames(spark, world):
    f = spark.createDataFrame(world[0], "facility_id long, lon double, lat double, volume long, climate_k int, governorate string")
    c = spark.createDataFrame(world[1], "cell_id long, grid_row int, grid_col int, lon double, lat double, pop long")
    return f, c


@pytest.mark.parametrize("radius", [3.0, 25.0, 90.0])
def test_bucket_join_equals_nested_loop(frames, world, radius):
    got = {(r.facility_id, r.cell_id) for r in sp.coverage_pairs(*frames, radius).collect()}
    assert got == {(f[0], c[0]) for f in world[0] for c in world[1] if km(f[1:3], c[3:5]) <= radius}


def test_bucket_join_at_the_date_line_and_the_poles(spark):
    rng = random.Random(21)
    points = [(i, rng.choice((-179.9, 179.9, 0.0)) + rng.uniform(-0.1, 0.1), rng.choice((0.0, 89.5, -89.8, 60.0)) + rng.uniform(-0.1, 0.1)) for i in range(150)]
    p = spark.createDataFrame(points, "id long, lon double, lat double")
    c = spark.createDataFrame([(i, x, y, rng.choice((5.0, 40.0, 900.0))) for i, x, y in points[:60]], "c long, c_lon double, c_lat double, r double")
    own = {r.c: r.r for r in c.collect()}
    for radius in (20.0, 700.0, "r"):
        got = sorted((r.c, r.id) for r in sp.range_join(p, c, radius).collect())
        assert got == sorted((a[0], b[0]) for a in points[:60] for b in points if km(a[1:], b[1:]) <= (own[a[0]] if radius == "r" else radius))


def test_running_totals_and_numbers_cross_ranges(spark):
    from careshed.core.work import running_total

    rng = random.Random(22)
    rows = [(i, rng.randrange(40), rng.randrange(9)) for i in range(500)]
    df = spark.createDataFrame(rows, "anchor_id long, allocated_patients long, n long")
    got = {r.anchor_id: r.upto for r in running_total(df, ["allocated_patients", "anchor_id"], "n", "upto").collect()}
    total = 0
    for i, _, n in sorted(rows, key=lambda r: (r[1], r[0])):
        total += n
        assert got[i] == total
    ranks = {r.anchor_id: r["rank"] for r in al.renumber(df).collect()}
    assert ranks == {r[0]: k + 1 for k, r in enumerate(sorted(rows, key=lambda r: (-r[1], r[0])))}


def test_nearest_neighbours_in_crowded_and_empty_places(spark):
    rng = random.Random(23)
    points = [(i, 10 + rng.gauss(0, 0.001), 50 + rng.gauss(0, 0.001)) for i in range(120)] + [(500, -170.0, -60.0), (501, 179.0, 10.0)]
    got = {r.id: r.nn_km for r in sp.nearest_neighbours(spark.createDataFrame(points, "id long, lon double, lat double"), "id").collect()}
    assert all(got[p[0]] == pytest.approx(min(km(p[1:], q[1:]) for q in points if q[0] != p[0])) for p in points)
    assert sp.nearest_neighbours(spark.createDataFrame(points[:1], "id long, lon double, lat double"), "id").count() == 0


def test_own_radius(frames, world):
    anchors = frames[0].withColumn("service_radius_km", F.col("volume").cast("double"))
    got = {(r.anchor_id, r.facility_id) for r in sp.facilities_in_areas(anchors, frames[0]).collect()}
    assert got == {(a[0], f[0]) for a in world[0] for f in world[0] if km(a[1:3], f[1:3]) <= a[3]}


def test_concave_ring(spark):
    corners = ((0, 0), (4, 0), (4, 4), (2, 1), (0, 4))
    ring = "array(" + ", ".join(f"struct({x}D AS lon, {y}D AS lat)" for x, y in corners) + ")"
    points = {(1.0, 0.5): True, (2.0, 3.0): False, (0.5, 2.0): True, (3.5, 2.0): True, (5.0, 1.0): False}
    for (x, y), inside in points.items():
        assert spark.sql(f"SELECT {ring} AS ring").select(in_ring(F.lit(x), F.lit(y), F.col("ring"))).first()[0] is inside


def test_nearest_neighbours(frames, world):
    got = {r.facility_id: r.nn_km for r in sp.nearest_neighbours(frames[0], "facility_id", 2.0).collect()}
    for f in world[0]:
        assert got[f[0]] == pytest.approx(min(km(f[1:3], g[1:3]) for g in world[0] if g[0] != f[0]))


def test_coarsen_drops_the_remainder(frames, world):
    got = {(r.block_row, r.block_col): r["pop"] for r in sp.coarsen(frames[1], 3).collect()}
    expected = {}
    for _, row, col, _, _, pop in world[1]:
        if row < 18 and col < 18:
            expected[(row // 3, col // 3)] = expected.get((row // 3, col // 3), 0) + pop
    assert got == expected
    assert sp.coarsen(frames[1], 30).count() == 400


def test_percentile_rank_averages_ties(spark):
    df = spark.createDataFrame([(1, 5), (2, 5), (3, 1), (4, 9)], "id int, v int")
    assert {r.id: r.pct_rank for r in sp.percentile_rank(df, "v").collect()} == {1: 0.625, 2: 0.625, 3: 0.25, 4: 1.0}


def brute_greedy(world, mode, radius, config, seeds=()):
    facilities, cells = world
    reach = {f[0]: {c[0] for c in cells if km(f[1:3], c[3:5]) <= radius[f[0]]} for f in facilities}
    pop, total = {c[0]: c[5] for c in cells}, float(sum(c[5] for c in cells))
    top, target = max(f[3] for f in facilities), int(total * config.progress_tau)
    mean = {f[0]: (sum(km(f[1:3], c[3:5]) for c in cells if c[0] in reach[f[0]]) / len(reach[f[0]]) if reach[f[0]] else 1e9) for f in facilities}
    covered, chosen, clusters = set(), [], {}
    m = config.modes[mode]

    def take(f):
        covered.update(reach[f[0]])
        chosen.append(f[0])
        clusters[f[4]] = clusters.get(f[4], 0) + 1

    for f in facilities:
        if f[0] in seeds:
            take(f)
    while len(chosen) < len(facilities):
        now = sum(pop[c] for c in covered)
        pct = 100 * now / total
        if (pct >= config.fewest_pct and len(chosen) >= config.min_areas) if mode == "fewest" else (len(chosen) >= config.max_areas or pct >= config.other_pct):
            break
        best = None
        for f in facilities:
            if f[0] in chosen:
                continue
            gain, own = sum(pop[c] for c in reach[f[0]] - covered), sum(pop[c] for c in reach[f[0]])
            seen, n, left = own - gain, clusters.get(f[4], 0), target - now
            value = config.coverage * m["coverage"] * gain / total - config.overlap * m["overlap"] * (seen / own if own else 0) + config.climate * (1.0 if n < 1 else 1 / (1 + n)) + config.volume * m["volume"] * f[3] / top + config.progress * m["progress"] * (min(gain / left, 1) if left > 0 else 0) - config.distance * m["distance"] * (min(mean[f[0]] / 100, 1) if mode == "distance" else 0)
            if best is None or value > best[0] + 1e-12:
                best = (value, f)
        take(best[1])
    return chosen, sum(pop[c] for c in covered)


@pytest.mark.parametrize(("mode", "seeds"), [("footprint", []), ("distance", []), ("fewest", [3, 7])])
def test_greedy_equals_brute_force(frames, world, mode, seeds):
    config = cv.CoverageConfig(min_areas=3, max_areas=6)
    fac = frames[0].withColumn("initial_radius_km", 10.0 + F.col("volume") / 5.0)
    picks, covered, _ = cv.greedy(fac, frames[1], mode, config=config, seeds=seeds)
    expected, people = brute_greedy(world, mode, {f[0]: 10.0 + f[3] / 5.0 for f in world[0]}, config, seeds)
    assert [r.facility_id for r in picks.orderBy("pick").collect()] == expected
    assert covered == people


def test_overlap_removal_equals_brute_force(frames, world):
    facilities, cells = world
    reach = {f[0]: {c[0] for c in cells if km(f[1:3], c[3:5]) <= 40} for f in facilities}
    kept = []
    for i, f in enumerate(sorted(facilities, key=lambda f: (-f[3], f[0]))):
        union = set().union(*(reach[k] for k in kept)) if kept else set()
        if i == 0 or (reach[f[0]] and len(reach[f[0]] & union) / len(reach[f[0]]) <= 0.8):
            kept.append(f[0])
    got = cv.remove_overlapping(frames[0], sp.coverage_pairs(*frames, 40.0), 0.8)
    assert sorted(r.facility_id for r in got.collect()) == sorted(kept)


def test_governorate_mode_covers_each_and_the_target(frames):
    picks, covered, total = cv.governorate_coverage(frames[0], frames[1], [40.0, 5.0], 0.5)
    chosen = picks.join(frames[0], "facility_id")
    assert {r.governorate for r in chosen.collect()} == {"G0", "G1", "G2"}
    assert covered >= int(total * 0.5)
    assert {r.radius_km for r in picks.collect()} == {40.0}
    named = frames[1].withColumn("governorate", F.when(F.col("lon") < 35.5, "G0").otherwise("G1"))
    shares = cv.governorate_coverage(frames[0], named, [1.0], 0.9)
    assert shares[1] < int(total * 0.9)  # no radius gets there, so all facilities with cells come back
    assert shares[0].where("governorate_share > 1").count() == 0 and shares[0].where("governorate_share > 0").count() > 0
    coded = cv.governorate_coverage(frames[0], frames[1], [25.0], 0.6, cv.CoverageConfig(tau_as_coded=True, needy_as_coded=True))
    assert coded[1] >= 0.36 * total


def test_allocation_keeps_everyone(frames, world):
    config = al.GravityConfig(max_km=30.0)
    got = al.allocate(frames[1], frames[0], config)
    rest = al.unallocated(frames[1], got)
    total = lambda df: df.agg(F.sum("pop")).first()[0] or 0
    assert total(got) + total(rest) == sum(c[5] for c in world[1])
    shares = al.candidates(frames[1], frames[0], config).groupBy("cell_id").agg(F.max(F.col("attraction")) / F.sum("attraction"))
    assert {r[0]: round(r[1], 9) for r in shares.collect()} == {r.cell_id: round(r.probability, 9) for r in got.collect()}


def test_exclusive_areas_count_a_facility_once(frames):
    anchors = frames[0].where("facility_id < 4").withColumn("service_radius_km", F.lit(60.0))
    allocations = al.allocate(frames[1], frames[0])
    inside = al.by_area(allocations, anchors, frames[0], exclusive=True)
    both = al.by_area(allocations, anchors, frames[0])
    assert inside.agg(F.sum("num_facilities")).first()[0] == sp.facilities_in_areas(anchors, frames[0]).select("facility_id").distinct().count()
    assert both.agg(F.sum("num_facilities")).first()[0] >= inside.agg(F.sum("num_facilities")).first()[0]


def rows_read(df):
    """Rows that the scans of a DataFrame's plan put out."""
    df.collect()
    rows, stack = 0, [df._jdf.queryExecution().executedPlan()]
    while stack:
        node = stack.pop()
        if node.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            stack.append(node.executedPlan())
        elif node.getClass().getSimpleName().endswith("QueryStageExec"):
            stack.append(node.plan())
        else:
            if node.getClass().getSimpleName() == "FileSourceScanExec":
                rows += node.metrics().apply("numOutputRows").value()
            stack += [node.children().apply(i) for i in range(node.children().size())]
    return rows


def test_a_pick_reads_the_pairs_around_its_new_cells_only(spark):
    rng = random.Random(8)
    facilities = spark.createDataFrame([(i, rng.uniform(35, 45), rng.uniform(25, 35), rng.randrange(50), i % 5) for i in range(400)], "facility_id long, lon double, lat double, volume long, climate_k int")
    cells = spark.createDataFrame([(i, 35 + (i % 200) / 20, 25 + (i // 200) / 20, rng.randrange(100)) for i in range(40_000)], "cell_id long, lon double, lat double, pop long")
    s = cv.Selection(facilities, cells, 25.0, 1, cv.CoverageConfig(), page_rows=500)
    total = s.pairs.count()
    gains = {r.facility_id: r.own for r in s.now.collect()}
    reach = {}
    for r in s.pairs.collect():
        reach.setdefault(r.facility_id, {})[r.cell_id] = r["pop"]
    seen = set()
    for _ in range(5):
        best = s.best({}, lambda _: F.col("gain").cast("double"))
        assert best["gain"] == max(gains.values()) == gains[best["facility_id"]]
        s.take(best)
        new = set(reach[best["facility_id"]]) - seen
        seen |= new
        touched = s.touched()
        met = touched.count()
        assert met == sum(len(new & set(own)) for own in reach.values())
        plan = touched.select("facility_id")  # the semi-join's own scans: the tiles, and the chosen facilities' pairs
        assert met <= rows_read(plan) < total / 5
        gains = {f: sum(p for c, p in own.items() if c not in seen) for f, own in reach.items() if f not in {c for c, _ in s.chosen}}
        after = s.best({}, lambda _: F.col("gain").cast("double"))
        assert {r.facility_id: r.gain for r in s.now.collect()} == gains and after["gain"] == max(gains.values())


def test_ranges_of_the_curve_hold_a_box(spark):
    from careshed.functions.geo import morton, morton_ranges

    for x0, x1, y0, y1 in ((0, 0, 0, 0), (3, 8, 5, 9), (1020, 1027, 511, 514), (65530, 65535, 65530, 65535)):
        rows = spark.createDataFrame([(x, y) for x in range(x0, x1 + 1) for y in range(y0, y1 + 1)], "x int, y int")
        codes = sorted(r.c for r in rows.select(morton(F.col("x"), F.col("y")).alias("c")).collect())
        ranges = morton_ranges(x0, x1, y0, y1)
        assert len(ranges) <= 8 and all(any(a <= c <= b for a, b in ranges) for c in codes) and ranges == sorted(ranges)


def in_polygon(x, y, ring):
    odd = False
    for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1], strict=True):
        if (ay > y) != (by > y) and x < (bx - ax) * ((y - ay) / (by - ay)) + ax:
            odd = not odd
    return odd


def star(rng, x, y, r, corners):
    turns = sorted(rng.uniform(0, 2 * math.pi) for _ in range(corners))
    return [(x + r * rng.uniform(0.3, 1) * math.cos(t), y + r * rng.uniform(0.3, 1) * math.sin(t)) for t in turns]


def test_polygon_cells_equal_brute_force(spark):
    rng = random.Random(31)
    square = lambda w, s, e, n: [(float(x), float(y)) for x, y in ((w, s), (e, s), (e, n), (w, n))]
    regions = [("b", star(rng, 10, 10, 8, 40), [star(rng, 10, 10, 1, 9), square(12, 9, 13, 10)]), ("a", star(rng, 14, 12, 6, 12), []), ("c", square(0, 0, 2, 2), []), ("c", square(2, 0, 4, 2), []), ("tiny", square(5, 5, 5.0001, 5.0001), []), ("line", [(0.0, 9.0), (4.0, 9.0), (0.0, 9.0)], []), ("none", [], []), ("wide", square(-179, -80, 179, -60), [])]
    points = [(i, rng.uniform(-1, 21), rng.uniform(-1, 21)) for i in range(3000)] + [(5000 + i, float(i % 5), float(i // 5)) for i in range(25)] + [(6000, 5.00005, 5.00005), (6001, 150.0, -70.0), (6002, None, 1.0)]
    p = spark.createDataFrame(points, "id long, lon double, lat double")
    at = "array<struct<lon double, lat double>>"
    r = spark.createDataFrame(regions, f"name string, ring {at}, holes array<{at}>")
    got = {x.id: x.region for x in sp.within_regions(p, r, "id").collect()}
    for i, x, y in points:
        inside = [] if x is None else [n for n, ring, holes in regions if in_polygon(x, y, ring) and not any(in_polygon(x, y, h) for h in holes)]
        assert got[i] == (min(inside) if inside else None), (i, x, y)


def test_many_polygons_need_no_nested_loop(spark):
    side = 120
    grid = spark.range(side * side).selectExpr("concat('r', id) AS name", f"id % {side} AS x", f"id div {side} AS y")
    rings = grid.selectExpr("name", "array(struct(x * 0.1D AS lon, y * 0.1D AS lat), struct(x * 0.1D + 0.1D AS lon, y * 0.1D AS lat), struct(x * 0.1D + 0.1D AS lon, y * 0.1D + 0.1D AS lat), struct(x * 0.1D AS lon, y * 0.1D + 0.1D AS lat)) AS ring")
    points = spark.range(2000).selectExpr("id", "(id * 37 % 1200) / 100D + 0.005D AS lon", "(id * 91 % 1200) / 100D + 0.005D AS lat")
    found = sp.within_regions(points, rings, "id")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    for r in found.collect():
        assert r.region == f"r{int(r.lat / 0.1 + 1e-9) * side + int(r.lon / 0.1 + 1e-9)}"


def test_outlines_clipped_to_a_concave_country_with_holes(spark):
    rng = random.Random(41)
    ring = star(rng, 10, 50, 3, 30)
    hole = [(9.8, 49.9), (10.2, 49.9), (10.2, 50.2), (9.8, 50.2)]
    island = [(14.0, 50.0), (15.0, 50.0), (14.5, 51.0)]
    areas = [(i, rng.uniform(7, 15), rng.uniform(47, 53), rng.uniform(30, 150)) for i in range(12)] + [(99, 60.0, 0.0, 50.0)]
    at = "array<struct<lon double, lat double>>"
    country = spark.createDataFrame([(ring, [hole]), (island, []), ([], [])], f"ring {at}, holes array<{at}>")
    a = spark.createDataFrame(areas, "facility_id long, lon double, lat double, service_radius_km double")
    outlines = cv.outlines(a)
    got = {}
    for r in sp.clip_outlines(outlines, country).collect():
        got[r.facility_id] = got.get(r.facility_id, 0) + r.km2
    for r in outlines.collect():
        corners = [(p.lon, p.lat) for p in r.outline[:-1]]
        west, east, south, north = (f(c[i] for c in corners) for i in (0, 1) for f in (min, max))
        n, hits = 250, 0
        for i in range(n):  # count the cells of a fine grid that lie in the outline and in the country
            for j in range(n):
                x, y = west + (i + 0.5) * (east - west) / n, south + (j + 0.5) * (north - south) / n
                hits += in_polygon(x, y, corners) and (in_polygon(x, y, ring) and not in_polygon(x, y, hole) or in_polygon(x, y, island))
        scale = 111.32 * math.cos(math.radians(sum(c[1] for c in corners) / len(corners))) * 110.574
        want = hits * (east - west) * (north - south) / n**2 * scale
        assert got.get(r.facility_id, 0) == pytest.approx(want, rel=0.03, abs=0.004 * (east - west) * (north - south) * scale)


def test_overlap_removal_by_table_equals_the_drivers(frames, monkeypatch):
    pairs = sp.coverage_pairs(*frames, 40.0)
    few = sorted(r.facility_id for r in cv.remove_overlapping(frames[0], pairs, 0.5).collect())
    monkeypatch.setattr(cv, "PATTERNS", 0)
    assert sorted(r.facility_id for r in cv.remove_overlapping(frames[0], pairs, 0.5).collect()) == few
