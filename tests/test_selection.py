"""Greedy selection by cells held in rows: equal to the way by pairs, and exact in the queue between reads."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from careshed.operators import coverage as cv


@pytest.fixture(scope="module")
def frames(spark):
    rng = random.Random(31)
    spots = [(35 + rng.random(), 30 + rng.random()) for _ in range(60)]
    facilities = [(i, 35 + rng.random(), 30 + rng.random(), rng.randrange(50), i % 4, 8.0 + i % 5) for i in range(80)]
    facilities.append((80, 10.0, 10.0, 20, 1, 9.0))  # has no cells
    cells = [(i, *spots[rng.randrange(60)], rng.randrange(100)) for i in range(300)]
    f = spark.createDataFrame(facilities, "facility_id long, lon double, lat double, volume long, climate_k int, initial_radius_km double")
    return f, spark.createDataFrame(cells, "cell_id long, lon double, lat double, pop long")


def gains(s):
    """(own people not covered, people covered, cells covered) of each facility by the pairs and the chosen alone."""
    taken, out = {f for f, _ in s.chosen}, {}
    pairs = s.pairs.collect()
    covered = {p.cell_id for p in pairs if p.facility_id in taken}
    for p in pairs:
        gain, seen, n = out.get(p.facility_id, (0, 0, 0))
        out[p.facility_id] = (gain, seen + p["pop"], n + p.n) if p.cell_id in covered else (gain + p["pop"], seen, n)
    return out


@pytest.mark.parametrize("queue_cells", [500_000, 40])
def test_queue_stays_exact_without_a_job(spark, frames, monkeypatch, queue_cells):
    monkeypatch.setattr(cv, "QUEUE_CELLS", queue_cells)
    total = frames[1].agg(F.sum("pop")).first()[0]
    s = cv.Selection(*frames, "initial_radius_km", total, cv.CoverageConfig())
    reads, read = [], s._read
    monkeypatch.setattr(s, "_read", lambda *a: (reads.append(len(s.chosen)), read(*a)))
    for _ in range(5):
        s.take(s.next("fewest", int(total * 0.6)))
        true = gains(s)
        assert s.lists is not None and s.told == len(s.chosen)
        assert all((c["gain"], c["seen"], c["seen_cells"]) == true.get(c["facility_id"], (0, 0, 0)) for c in s.queue)
    assert queue_cells == 40 or reads == [0]
    s.best({}, lambda _: F.col("gain").cast("double"))
    true = gains(s)
    left = {r.facility_id: (r.gain, r.seen, r.seen_cells) for r in s.now.collect()}
    assert left == {f: true.get(f, (0, 0, 0)) for f in set(range(81)) - {f for f, _ in s.chosen}}


@pytest.mark.parametrize(("mode", "seeds", "queue"), [("footprint", [80, 3, 4], 6), ("distance", None, 40)])
def test_held_rows_give_what_pairs_give(frames, monkeypatch, mode, seeds, queue):
    """In the first case a facility outside the queue wins more of the shrinking remainder than one of the greatest gain."""
    config = cv.CoverageConfig(min_areas=5, max_areas=14, overlap_as_coded=mode == "distance")
    out = []
    for most, rows in ((65_536, queue), (-1, 1)):
        monkeypatch.setattr(cv, "QUEUE", rows)
        monkeypatch.setattr(cv, "FOLD", 3)
        monkeypatch.setattr(cv, "ROW_CELLS", most)
        picks, covered, _ = cv.greedy(*frames, mode, config=config, seeds=seeds)
        out.append((covered, sorted(map(tuple, picks.collect()))))
    assert out[0] == out[1] and len(out[0][1]) >= 5


def test_rows_of_cells_are_made_without_pairs(frames, monkeypatch):
    """A footprint search over few places writes no pair, and its rows hold what the pairs do."""
    written, whole = [], cv.table
    monkeypatch.setattr(cv, "table", lambda df, name, **rest: written.append(name) or whole(df, name, **rest))
    cv.greedy(*frames, "footprint", config=cv.CoverageConfig(max_areas=4))
    assert "coverage-held" in written and "coverage-pairs" not in written and "coverage-tiles" not in written
    own = []
    for most in (65_536, -1):
        monkeypatch.setattr(cv, "ROW_CELLS", most)
        s = cv.Selection(*frames, "initial_radius_km", 1, cv.CoverageConfig())
        names = ("facility_id", "cluster", "region", "own", "cells", "mean_km", "volume_norm", *cv.BOX, "gain", "seen", "seen_cells")
        own.append((sorted(map(str, s.now.select(*names).collect())), sorted(map(tuple, s.pairs.select("facility_id", "cell_id", "pop", "n").collect())), s.n, s.most, s.largest))
    assert own[0] == own[1] and own[0][2] == 81


@pytest.mark.parametrize("plan_cells", [0, 10_000])
def test_covered_cells_in_the_plan_or_in_batches(frames, monkeypatch, plan_cells):
    monkeypatch.setattr(cv, "PLAN_CELLS", plan_cells)
    batches, whole = [], cv.in_arrow
    monkeypatch.setattr(cv, "in_arrow", lambda *a: batches.append(1) or whole(*a))
    total = frames[1].agg(F.sum("pop")).first()[0]
    s = cv.Selection(*frames, "initial_radius_km", total, cv.CoverageConfig())
    for f in (3, 4, 70):
        s.take(s.now.where(f"facility_id = {f}").first().asDict())
    s.best({}, lambda _: F.col("gain").cast("double"))
    assert bool(batches) == (plan_cells == 0)
    true = gains(s)
    assert {r.facility_id: (r.gain, r.seen, r.seen_cells) for r in s.now.collect()} == {f: true.get(f, (0, 0, 0)) for f in set(range(81)) - {3, 4, 70}}


@pytest.mark.parametrize("patterns", [0, 200_000])
def test_overlaps_are_told_from_the_selections_cells(frames, monkeypatch, patterns):
    """The areas' cells are not looked for again, and the people covered are those of the areas that stay."""
    from careshed.operators import spatial as sp

    monkeypatch.setattr(cv, "PATTERNS", patterns)
    met, whole = [], sp.range_join
    monkeypatch.setattr(sp, "range_join", lambda *a: met.append(1) or whole(*a))
    facilities = frames[0].drop("initial_radius_km")
    config = cv.CoverageConfig(max_areas=30)
    result = cv.optimize(facilities, frames[1], "distance", config=config)
    areas = result.areas.collect()
    assert len(met) == 2  # densities and the selection's cells
    ready = cv.initial_radii(facilities, frames[1], config)
    picks = cv.greedy(ready, frames[1], "distance", config=config)[0]
    all_areas = ready.join(picks, "facility_id")
    pairs = sp.place_pairs(all_areas, frames[1], "initial_radius_km")
    kept = sorted(r.facility_id for r in cv.remove_overlapping(all_areas, pairs).collect())
    assert sorted(r.facility_id for r in areas) == kept and len(kept) < picks.count()
    cells = {p.cell_id: p["pop"] for p in pairs.collect() if p.facility_id in kept}
    assert result.covered_pop == sum(cells.values()) and result.summary_df().first().covered_pop == result.covered_pop


def test_objectives_share_radii_and_rows(frames, monkeypatch):
    """The ablation and the modes make pairs once, and give what each objective gives alone."""
    from dataclasses import replace

    from careshed.operators import spatial as sp

    facilities, config = frames[0].drop("initial_radius_km"), cv.CoverageConfig(max_areas=8, min_areas=4)
    wanted = [("fewest", config), ("footprint", config), ("distance", config), ("footprint", replace(config, climate_on=False))]
    alone = [cv.optimize(facilities, frames[1], objective, config=c) for objective, c in wanted]
    met, whole = [], sp.range_join
    monkeypatch.setattr(sp, "range_join", lambda *a: met.append(1) or whole(*a))
    together = cv.optimize_each(facilities, frames[1], wanted)
    for a, b in zip(alone, together, strict=True):
        assert (a.covered_pop, a.objective) == (b.covered_pop, b.objective)
        assert sorted(map(str, a.areas.collect())) == sorted(map(str, b.areas.collect()))
    assert len(met) == 2
    rows = cv.climate_ablation(facilities, frames[1], "footprint", config).collect()
    assert len(met) == 4
    assert [(r.climate_on, r.covered_pop) for r in rows] == [(True, alone[1].covered_pop), (False, alone[3].covered_pop)]


def test_mean_distances_do_not_depend_on_order(spark):
    rng = random.Random(5)
    pairs = [(f, rng.uniform(0, 20_000), rng.randrange(1, 10**7)) for f in range(3) for _ in range(200)]
    for f in range(3):
        own = [p for p in pairs if p[0] == f]
        found = set()
        for _ in range(4):
            rng.shuffle(own)
            df = spark.createDataFrame([(*p, 1, 0, 0) for p in own], "facility_id long, dist_km double, n long, pop long, x int, y int").repartition(3)
            found.add(df.groupBy("facility_id").agg(*cv.Selection._sums()).first().mean_km)
        assert len(found) == 1
        assert found.pop() == pytest.approx(sum(d * n for _, d, n in own) / sum(n for _, _, n in own), abs=1e-9)


def test_a_seeded_search_reads_the_queue_seldom(spark, monkeypatch):
    """Facilities crowd in few places, so the best hundreds overlap: the queue is long enough to go beyond them."""
    rng = random.Random(11)
    near = [(35.2 + rng.random() / 20, 30.2 + rng.random() / 20) for _ in range(900)]
    facilities = spark.createDataFrame([(i, *(near[i] if i < 900 else (35 + rng.random(), 30 + rng.random())), 40 + i % 10, i % 4, 25.0 if i < 900 else 8.0) for i in range(1_200)], "facility_id long, lon double, lat double, volume long, climate_k int, initial_radius_km double")
    cells = spark.createDataFrame([(i, 35 + (i % 30) / 30, 30 + (i // 30) / 30, 50) for i in range(900)], "cell_id long, lon double, lat double, pop long")
    reads, read = [], cv.Selection._read
    monkeypatch.setattr(cv.Selection, "_read", lambda s, *a: (reads.append(len(s.chosen)), read(s, *a)))
    config, out = cv.CoverageConfig(min_areas=12, max_areas=12, fewest_pct=1.0), []
    for rows in (256, cv.QUEUE):
        monkeypatch.setattr(cv, "QUEUE", rows)
        reads.clear()
        picks, covered, _ = cv.greedy(facilities, cells, "fewest", config=config, seeds=[1_100])
        out.append((len(reads), covered, sorted(map(tuple, picks.collect()))))
    assert out[0][1:] == out[1][1:] and len(out[1][2]) == 12
    assert out[1][0] == 1 < out[0][0]


def test_highest_volume_sends_a_row_for_each_region(spark):
    rows = [(i, i % 3 if i % 5 else None, [None, 5, 9, 9][i % 4], f"H{i}") for i in range(200)]
    df = spark.createDataFrame(rows, "facility_id long, governorate long, volume long, name string").repartition(4)
    got = cv.highest_volume(df)
    want = {}
    for r in sorted(rows, key=lambda r: (-(r[2] or 0), r[0])):
        if r[1] is not None:
            want.setdefault(r[1], r)
    assert got.columns == df.columns and sorted(map(tuple, got.collect())) == sorted(want.values())
    assert "Window" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_governorates_write_gains_seldom(frames, monkeypatch):
    """A pick in a governorate takes the changes off as it reads; both ways choose the same."""
    facilities = frames[0].withColumn("governorate", F.concat(F.lit("G"), F.col("facility_id") % 7))
    written, whole, out = [], cv.table, []
    monkeypatch.setattr(cv, "table", lambda df, name, **rest: written.append(name) or whole(df, name, **rest))
    for most in (65_536, -1):
        monkeypatch.setattr(cv, "ROW_CELLS", most)
        written.clear()
        picks, covered, _ = cv.governorate_coverage(facilities, frames[1], [25.0], 0.6)
        out.append((covered, sorted(map(tuple, picks.collect())), written.count("coverage-now")))
    assert out[0][:2] == out[1][:2] and len(out[0][1]) >= 7
    assert out[0][2] <= 1 + len(out[0][1]) // cv.FOLD < out[1][2]
