"""Service areas: radii, scores, greedy maximum coverage, overlap removal, governorate variants."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from copy import copy
from dataclasses import dataclass, field, replace
from functools import cached_property, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from careshed.core.work import BROADCAST_ROWS, in_arrow, table
from careshed.functions.geo import circle_outline, morton, morton_ranges
from careshed.functions.scalars import clipped, scaled
from careshed.operators.moments import exact_quantiles
from careshed.operators.spatial import cell_places, density, nearest_neighbours, of_circle, percentile_rank, placed_pairs, range_join, shared_circles, tile_of, tiled_pairs


#: Covered cells that may be broadcast as ids (at most 64 MB); more are joined by a shuffle.
BROADCAST_CELLS = 1_000_000
#: Height of a tile of cells, and pairs in a page of the files, the least that a pick can read.
TILE_KM, PAGE_ROWS = 10.0, 20_000
#: Sets of areas that share a cell whose counts the driver may hold.
PATTERNS = 200_000
#: Rows of the queue of bounds, and picks whose changes are taken off the gains as they are read, before they are written.
QUEUE, FOLD = 2_048, 8
#: Cells that a facility's row may hold, facilities in a page of such rows, and cells of the queue's rows on the driver.
ROW_CELLS, PAGE_FACILITIES, QUEUE_CELLS = 65_536, 256, 500_000
#: Covered cells that a plan may name; more are looked up in Arrow batches.
PLAN_CELLS = 10_000


@dataclass(frozen=True)
class CoverageConfig:
    """Base weights, radii in km, thresholds, and the modes' multipliers and stops."""

    coverage: float = 8.0
    overlap: float = 2.0
    climate: float = 1.0
    volume: float = 3.0
    progress: float = 1.0
    distance: float = 3.0
    urban_radius: float = 12.0
    rural_radius: float = 20.0
    max_radius: float = 25.0
    urban_density: float = 1500.0
    density_radius: float = 10.0
    progress_tau: float = 0.60
    min_areas: int = 15
    max_areas: int = 22
    fewest_pct: float = 90.0
    other_pct: float = 98.0
    min_per_cluster: int = 1
    clusters: int = 8
    climate_on: bool = True
    overlap_as_coded: bool = False  # covered cells by covered people, as first written, in place of people by people
    tau_as_coded: bool = False  # the governorate mode takes tau of its target for enough
    needy_as_coded: bool = False  # and stops when no cluster below its minimum has a candidate
    modes: dict = field(default_factory=lambda: {
        "fewest": {"coverage": 1.5, "progress": 0.0, "overlap": 0.5, "volume": 2.5, "distance": 0.0},
        "footprint": {"coverage": 1.0, "progress": 8.0, "overlap": 0.01, "volume": 0.05, "distance": 0.0},
        "distance": {"coverage": 1.0, "progress": 6.0, "overlap": 0.02, "volume": 0.08, "distance": 2.5},
    })


@dataclass(frozen=True)
class CoverageResult:
    """The chosen areas in order of choice, and what they cover."""

    areas: DataFrame
    objective: str
    network_type: str
    total_pop: int
    covered_pop: int

    @property
    def coverage_pct(self) -> float:
        return 100.0 * self.covered_pop / self.total_pop if self.total_pop else 0.0

    def summary_df(self) -> DataFrame:
        row = (self.objective, self.network_type, self.total_pop, self.covered_pop, round(self.coverage_pct, 6))
        names = ("objective", "network_type", "total_pop", "covered_pop", "coverage_pct")
        return self.areas.sparkSession.createDataFrame(pa.table({n: [v] for n, v in zip(names, row, strict=True)}))


def initial_radii(facilities: DataFrame, cells: DataFrame, config: CoverageConfig = CoverageConfig(), network: float = 1.0) -> DataFrame:
    """urban_rural by population density, and initial_radius_km by that and the share of the largest volume."""
    dense = facilities.join(density(facilities, cells, config.density_radius), "facility_id")
    top = facilities.agg(F.max("volume").alias("__top"))
    dense = dense.join(F.broadcast(top))  # one row
    urban = F.col("density") > config.urban_density
    factor = F.when(F.col("__top") > 0, 0.8 + 0.4 * scaled(F.coalesce("volume", F.lit(0)), F.col("__top"))).otherwise(1.0)
    radius = F.least(F.when(urban, config.urban_radius).otherwise(config.rural_radius) * factor * network, F.lit(config.max_radius))
    return dense.withColumn("urban_rural", F.when(urban, "Urban").otherwise("Rural")).withColumn("initial_radius_km", radius).drop("__top")


def radius_candidates(facilities: DataFrame, step_km: float, low: float, high: float, base: tuple[float, ...] = (6, 8, 10, 12, 14, 16, 18, 20, 22, 24)) -> DataFrame:
    """(radius_km): base radii and quantiles of nearest-neighbour distances, snapped to steps and clipped."""
    nn = exact_quantiles(nearest_neighbours(facilities, "facility_id"), ["nn_km"], [0.2, 0.4, 0.6, 0.8]).select(F.col("value").alias("r"))
    all_ = nn.unionByName(facilities.sparkSession.createDataFrame([(float(b),) for b in base], "r double"))
    return all_.select(F.round(clipped(F.bround(F.col("r") / step_km) * step_km, low, high), 2).alias("radius_km")).distinct()


def adaptive_radii(facilities: DataFrame, urban: float = 15.0, rural: float = 25.0, low: float = 10.0, high: float = 30.0) -> DataFrame:
    """service_radius_km: the base by urban_rural, two km less to two more by percentile rank of volume."""
    base = F.when(F.col("urban_rural") == "Urban", urban).otherwise(rural) if "urban_rural" in facilities.columns else F.lit(urban)
    if "volume" not in facilities.columns:
        return facilities.withColumn("service_radius_km", base)
    ranked = percentile_rank(facilities.withColumn("__v", F.coalesce(F.col("volume").cast("double"), F.lit(0.0))), "__v", "__rank")
    top = facilities.agg(F.max("volume").alias("__top"))
    ranked = ranked.join(F.broadcast(top))  # one row
    radius = F.when(F.coalesce("__top", F.lit(0)) == 0, F.lit(urban)).otherwise(clipped(base - 2.0 + 4.0 * F.col("__rank"), low, high))
    return ranked.withColumn("service_radius_km", radius).drop("__v", "__rank", "__top")


def components(gain: Column, covered: Column, own: Column, cluster_count: Column, volume_norm: Column, mean_km: Column, total: float, remaining: float, config: CoverageConfig) -> dict[str, Column]:
    """The parts of the score, each from 0 to 1. ``remaining`` is what is left to the progress target."""
    climate = F.when(cluster_count.isNull(), 0.0).when(cluster_count < config.min_per_cluster, 1.0).otherwise(1.0 / (1.0 + cluster_count))
    return {
        "coverage_norm": gain / total,
        "overlap_frac": scaled(covered, own),
        "climate_norm": climate if config.climate_on else F.lit(0.0),
        "volume_norm": volume_norm,
        "progress_norm": F.least(gain / remaining, F.lit(1.0)) if remaining > 0 else F.lit(0.0),
        "distance_norm": F.least(mean_km / 100.0, F.lit(1.0)),
    }


def score(parts: dict[str, Column], mode: str, config: CoverageConfig) -> Column:
    m = config.modes[mode]
    return (
        config.coverage * m["coverage"] * parts["coverage_norm"]
        - config.overlap * m["overlap"] * parts["overlap_frac"]
        + config.climate * parts["climate_norm"]
        + config.volume * m["volume"] * parts["volume_norm"]
        + config.progress * m["progress"] * parts["progress_norm"]
        - config.distance * m["distance"] * parts["distance_norm"]
    )


def governorate_climate(cluster_count: Column, all_count: Column, config: CoverageConfig) -> Column:
    """The climate reward of the governorate mode: 10 below the minimum, else the inverse share."""
    return F.when(cluster_count < config.min_per_cluster, 10.0).otherwise(1.0 / F.greatest(cluster_count / F.greatest(all_count, F.lit(1)), F.lit(1e-6)))


def _meet(a: tuple[int, int, int, int], b: tuple[int, int, int, int]) -> bool:
    return a[0] <= b[1] and b[0] <= a[1] and a[2] <= b[3] and b[2] <= a[3]


#: A facility's tiles: from x0 to x1 and from y0 to y1.
BOX = ("x0", "x1", "y0", "y1")
PARTS = ("coverage_norm", "overlap_frac", "climate_norm", "volume_norm", "progress_norm", "distance_norm")


class Selection:
    """A greedy selection whose gains are kept by their changes.

    ``pairs`` (facility_id, cell_id, pop, n) have a row for each place of cells (``cell_places``), so a "cell" here is all n
    cells at one place. ``held`` has a facility's cells in its row, in pages of near facilities. With ROW_CELLS places at
    most these rows are made where facilities meet places, and ``pairs`` are read from them. With more the pairs are
    written in order of facility, where a chosen facility's cells are found by the files' statistics. ``now`` has a row for
    each facility with its gain. Up to BROADCAST_CELLS covered cells are known to the driver: then the gains near a pick
    are counted anew from the held rows, with no join or shuffle. With more cells the pairs are written in order of tile
    along a curve, and a pick reads those in the tiles of the cells that it newly covers and takes their people from the
    facilities that meet them. ``now`` is written again with
    the changes; the best row of the next pick is observed by the same job. So a pick costs the pairs near its cells and a
    row for each facility; the driver holds the chosen facilities, the cells they cover and the queue's rows.
    """

    def __init__(self, facilities: DataFrame, cells: DataFrame, radius: str | float, total_pop: int, config: CoverageConfig, regions: list[str] | None = None, tile_km: float = TILE_KM, page_rows: int = PAGE_ROWS):
        self.pages = {"parquet.page.row.count.limit": str(page_rows)}
        self.config, self.total, self.tile_km = config, float(total_pop), tile_km
        self.places = cell_places(cells)
        region = F.array_position(F.lit(regions), F.col("governorate")) if regions else F.lit(0)
        own = facilities.select("*", F.coalesce("volume", F.lit(0)).alias("__volume"), F.coalesce("climate_k", F.lit(-1)).alias("cluster"), F.coalesce(region, F.lit(0)).cast("int").alias("region"))
        self.n, top = own.agg(F.count("*"), F.max("__volume")).first()
        own = own.withColumn("volume_norm", F.col("__volume") / F.lit(top) if top and top > 0 else F.lit(0.0))
        self.n_places = self.places.count()
        if self.n_places <= ROW_CELLS:
            self.held = self._rows_of_cells(own, radius)
            rows = self.held.select("facility_id", "cluster", "region", "own", "cells", "mean_km", "volume_norm", *BOX)
        else:
            self.pairs = table(tiled_pairs(facilities, self.places, radius, tile_km).repartition("facility_id").sortWithinPartitions("facility_id"), "coverage-pairs", **self.pages)
            rows = own.join(self.pairs.groupBy("facility_id").agg(*self._sums()), "facility_id")
            rows = rows.select("facility_id", "cluster", "region", "own", "cells", "mean_km", "volume_norm", *BOX)
        begin = lambda df: df.withColumn("gain", F.col("own")).withColumn("seen", F.lit(0).cast("long")).withColumn("seen_cells", F.lit(0).cast("long"))
        self.first = begin(rows) if self.n_places <= ROW_CELLS else table(begin(rows), "coverage-now")
        met, self.most, self.largest = self.first.agg(F.count("*"), F.coalesce(F.max("own"), F.lit(0)), F.coalesce(F.max("cells"), F.lit(0))).first()
        if met < self.n:
            lone = own.join(self.first.select("facility_id"), "facility_id", "left_anti")
            none = {"own": F.lit(0).cast("long"), "cells": F.lit(0).cast("long"), "mean_km": F.lit(1e9)} | {c: F.lit(None).cast("int") for c in BOX}
            self.first = table(self.first.unionByName(begin(lone.select("facility_id", "cluster", "region", "volume_norm", *[v.alias(c) for c, v in none.items()]))), "coverage-now")
        self._begin()

    def anew(self, config: CoverageConfig) -> Selection:
        """A selection from the same rows with nothing chosen; the settings may change all but the radii."""
        other = copy(self)
        other.config = config
        other._begin()
        return other

    def _begin(self) -> None:
        self.now = self.first
        self.queue: list[dict] = []  # the best rows when they were last read, the next row's score, what was left then, and
        self.last: float | None = None  # the picks since
        self.remaining = self.since = 0
        self.chosen: list[tuple[int, dict]] = []
        self.boxes: list[tuple[int, int, int, int] | None] = []
        self.pending = 0  # the last so many of the chosen are not yet taken off the gains
        self.clusters: dict[int, int] = {}
        self.cells = 0  # at most so many cells are covered
        self.covered_pop = 0
        self.known, self.told = np.zeros(0, np.int64), 0  # cells that the first so many of the chosen cover, in order
        self.lists: tuple[np.ndarray, ...] | None = None  # facility, cell, pop and n of the queue's pairs

    @staticmethod
    def _sums() -> list[Column]:
        """own, cells, mean_km and the box of a facility's pairs."""
        ends = [f(c).alias(f"{c}{i}") for c in ("x", "y") for i, f in enumerate((F.min, F.max))]
        fixed = F.floor(F.col("dist_km") * 2.0**30 + 0.5)  # whole numbers, exact in any order, so that facilities at one place tie; two parts hold 2e10 cells at any distance
        high, low = (F.sum(part * F.col("n")) for part in (F.shiftright(fixed, 16), fixed.bitwiseAND(F.lit(65_535))))
        far = (high.cast("double") * 2.0**16 + low.cast("double")) / 2.0**30
        return [F.coalesce(F.sum("pop"), F.lit(0)).alias("own"), F.count("*").alias("cells"), (far / F.sum("n")).alias("mean_km"), *ends]

    def _rows_of_cells(self, own: DataFrame, radius: str | float) -> DataFrame:
        """``held`` where there are ROW_CELLS places at most: made where the facilities meet the places, with no pair written."""
        keep = ("cluster", "region", "volume_norm")
        x, y = tile_of(self.tile_km)
        met = placed_pairs(own, self.places, radius, *keep).withColumn("x", x).withColumn("y", y)
        cell = F.struct("cell_id", F.coalesce("pop", F.lit(0)).alias("pop"), "n")
        rows = met.groupBy("facility_id", *keep).agg(F.collect_list(cell).alias("l"), *self._sums())  # ROW_CELLS at most
        rows = rows.withColumn("gain", F.col("own")).withColumn("seen", F.lit(0).cast("long")).withColumn("seen_cells", F.lit(0).cast("long"))
        return self._in_pages(rows)

    def _in_pages(self, rows: DataFrame) -> DataFrame:
        rows = rows.select(*[c for c in rows.columns if c != "l"], *[F.col(f"l.{c}").alias(f"{c}_list") for c in ("cell_id", "pop", "n")])
        return table(rows.sortWithinPartitions(morton(F.col("x0"), F.col("y0"))), "coverage-held", **{"parquet.page.row.count.limit": str(PAGE_FACILITIES)})

    @cached_property
    def pairs(self) -> DataFrame:
        """(facility_id, cell_id, pop, n): a row for each facility and place of cells."""
        lists = F.arrays_zip(*[F.col(f"{c}_list").alias(c) for c in ("cell_id", "pop", "n")])
        return self.held.select("facility_id", F.explode(lists).alias("p")).select("facility_id", "p.cell_id", "p.pop", "p.n")

    @cached_property
    def met(self) -> DataFrame:
        """The pairs in order of tile."""
        pairs = self.pairs
        if "tile" not in pairs.columns:
            pairs = pairs.join(self.places.select("cell_id", morton(*tile_of(self.tile_km)).alias("tile")), "cell_id")
        return table(pairs.select("tile", "cell_id", "facility_id", "pop", "n").repartitionByRange("tile", "cell_id").sortWithinPartitions("tile", "cell_id"), "coverage-tiles", **self.pages)

    @cached_property
    def held(self) -> DataFrame:
        """``now`` with each facility's cells, their people and numbers in its row, near facilities in a page."""
        lists = self.pairs.groupBy("facility_id").agg(F.collect_list(F.struct("cell_id", F.coalesce("pop", F.lit(0)).alias("pop"), "n")).alias("l"))  # ROW_CELLS at most
        return self._in_pages(self.now.join(lists, "facility_id"))

    def of(self, chosen: list[int]) -> Column:
        """Rows of some facilities; each id of a few is told to the scan, which skips pages without it."""
        if len(chosen) > 64:
            return F.col("facility_id").isin(chosen)
        return F.expr(" OR ".join(f"facility_id = {f}" for f in chosen) or "false")

    def covered(self) -> DataFrame:
        """(cell_id, pop) of the cells of the chosen facilities."""
        return self.pairs.where(self.of([f for f, _ in self.chosen])).select("cell_id", "pop").distinct()

    def all_cells(self) -> DataFrame:
        """(cell_id, pop) of the cells of all facilities."""
        return self.pairs.select("cell_id", "pop").distinct()

    def touched(self) -> DataFrame | None:
        """(facility_id, pop, n) of the pairs of the cells that the pending facilities newly cover; None if they have no cells."""
        at = len(self.chosen) - self.pending
        new = [(f, box) for (f, _), box in zip(self.chosen[at:], self.boxes[at:], strict=True) if box]
        if not new:
            return None
        beside = [f for (f, _), box in zip(self.chosen[:at], self.boxes[:at], strict=True) if box and any(_meet(box, other) for _, other in new)]
        small = self.cells <= BROADCAST_CELLS
        fresh = self.pairs.where(self.of([f for f, _ in new])).select("cell_id")  # a cell may repeat, which a semi-join does not mind
        if beside:
            held = self.pairs.where(self.of(beside)).select("cell_id")
            fresh = fresh.join(F.broadcast(held) if small else held, "cell_id", "left_anti")
        x0, x1, y0, y1 = (f(box[i] for _, box in new) for i, f in enumerate((min, max, min, max)))
        boxes = [box for _, box in new] if len(new) <= 4 else [(x0, x1, y0, y1)]
        here = " OR ".join(f"tile BETWEEN {a} AND {b}" for box in boxes for a, b in morton_ranges(*box))
        fresh = F.broadcast(fresh) if small else fresh
        return self.met.where(here).join(fresh, "cell_id", "left_semi").select("facility_id", "pop", "n")

    def _tell(self) -> bool:
        """Whether covered cells are few enough for the driver to know; it reads those of the last chosen facilities."""
        if self.largest > ROW_CELLS or min(self.cells, self.n_places) > BROADCAST_CELLS:
            return False
        if self.told < len(self.chosen):
            cells = self.pairs.where(self.of([f for f, _ in self.chosen[self.told :]])).select("cell_id").toArrow()
            self.known, self.told = np.union1d(self.known, cells.column(0).to_numpy()), len(self.chosen)
        return True

    def _recounted(self, rest: DataFrame) -> DataFrame:
        """``rest`` with the facilities that meet a pending one's tiles counted anew, from their own cells."""
        boxes = [box for box in self.boxes[len(self.boxes) - self.pending :] if box]
        if not boxes:
            return rest
        near = " OR ".join(f"(x0 <= {x1} AND x1 >= {x0} AND y0 <= {y1} AND y1 >= {y0})" for x0, x1, y0, y1 in boxes)
        known, names = self.known, rest.columns
        free = f"facility_id NOT IN ({', '.join(str(f) for f, _ in self.chosen)})"
        rows = self.held.where(f"({near}) AND {free}")
        if len(known) <= PLAN_CELLS:  # a set in the plan, which needs no Python worker
            cells = ", ".join(map(str, known.tolist())) or "NULL"
            taken = lambda c: f"aggregate(zip_with(cell_id_list, {c}_list, (c, v) -> IF(c IN ({cells}), v, 0L)), 0L, (a, v) -> a + v)"
            counted = rows.selectExpr("*", f"{taken('pop')} AS __seen", f"{taken('n')} AS __cells")
            new = {"gain": "own - __seen AS gain", "seen": "__seen AS seen", "seen_cells": "__cells AS seen_cells"}
            return rest.where(f"cells = 0 OR NOT ({near})").union(counted.selectExpr(*[new.get(c, c) for c in names]))

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                cells, people, n = (batch.column(f"{c}_list") for c in ("cell_id", "pop", "n"))
                at = np.repeat(np.arange(batch.num_rows), pc.list_value_length(cells).to_numpy())
                ids = cells.flatten().to_numpy()
                taken = known[np.minimum(np.searchsorted(known, ids), len(known) - 1)] == ids if len(known) else np.zeros(len(ids), bool)
                seen, seen_cells = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
                np.add.at(seen, at[taken], people.flatten().to_numpy()[taken])
                np.add.at(seen_cells, at[taken], n.flatten().to_numpy()[taken])
                new = {"gain": pa.array(batch.column("own").to_numpy() - seen), "seen": pa.array(seen), "seen_cells": pa.array(seen_cells)}
                yield pa.RecordBatch.from_arrays([new.get(c, batch.column(c)) for c in names], names=names)

        kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rest.schema.fields)
        counted = in_arrow(rows, count, kinds)
        return rest.where(f"cells = 0 OR NOT ({near})").union(counted)

    def _changed(self) -> DataFrame:
        """``now`` without the pending facilities, and with their newly covered cells off all others' gains."""
        rest = self.now.where(~self.of([f for f, _ in self.chosen[len(self.chosen) - self.pending :]]))
        if self._tell():
            return self._recounted(rest)
        touched = self.touched()
        if touched is None:
            return rest
        stands = [(f.name, f.dataType.simpleString()) for f in rest.schema.fields if f.name != "facility_id"]
        change = {"gain": "-pop", "seen": "pop", "seen_cells": "n"}
        touched = touched.selectExpr("facility_id", *[f"CAST({change.get(c, 'NULL')} AS {kind}) AS {c}" for c, kind in stands])
        sums = rest.union(touched).groupBy("facility_id").agg(*[F.expr(f"{'sum' if c in change else 'max'}({c}) AS {c}") for c, _ in stands])
        return sums.where("cells IS NOT NULL")  # chosen facilities have pairs there too, but no row

    def cluster_count(self) -> Column:
        if not self.clusters:
            return F.lit(0)
        known = F.create_map(*[F.lit(x) for k, n in self.clusters.items() for x in (k, n)])
        return F.coalesce(F.try_element_at(known, F.col("cluster")), F.lit(0))

    def best(self, parts: dict[str, Column], value: Callable[[dict[str, Column]], Column], where: Column | None = None, write: bool = True) -> dict | None:
        """The free facility of the greatest value of its parts, the least id of equals; with its parts. Without ``write``
        changes are taken off as the gains are read, and written after FOLD picks, where covered cells are known."""
        columns = [F.col(c) for c in ("cluster", "cells", "own", "gain", *BOX)]
        worth = value(parts)
        own = F.struct(worth.alias("score"), (-F.col("facility_id")).alias("order"), "facility_id", *columns, *[c.cast("double").alias(p) for p, c in parts.items()])
        wanted = worth.isNotNull() if where is None else worth.isNotNull() & where
        top = F.max(F.when(wanted, own)).alias("best")
        if self.pending and (write or self.pending >= FOLD or not self._tell()):
            seen = Observation()
            self.now = table(self._changed().observe(seen, top), "coverage-now")
            self.pending, found = 0, seen.get["best"]
        else:
            rows = self._changed() if self.pending else self.now
            found = (rows if where is None else rows.where(where)).agg(top).first()["best"]  # others are not counted
        return found and found.asDict()

    def seed(self, facility_ids: list[int]) -> None:
        """Take these first, in order, with zero scores: one job for their rows and one for what they cover together."""
        rows = {r.facility_id: r.asDict() for r in self.now.where(F.col("facility_id").isin(facility_ids)).collect()}  # a few dozen
        for f in facility_ids:
            self.take(rows[f])
        self.covered_pop = self.covered().agg(F.coalesce(F.sum("pop"), F.lit(0))).first()[0] if facility_ids else 0

    def next(self, mode: str, target: int) -> dict:
        """The best row of a mode, the least id of equals, from a queue of stale upper bounds where that is proof enough.

        The driver holds the QUEUE best rows of a job, with their cells while these are few, whose gains then stay exact.
        Later their scores are taken again with the gains known then: gains only fall, overlaps and clusters only fill, so
        these are upper bounds, and exact where cells are held or no later pick has touched the row's tiles. All others
        scored no more than the last row of that job, and what they can win since is a greater share of a gain in the
        remainder to the target, which has shrunk. A row that is exact and beats all bounds is the best without a job;
        otherwise the queue is read anew.
        """
        remaining = target - self.covered_pop
        if self.since and self.queue:
            rated = [(score(self.parts(c, remaining, mode), mode, self.config), -c["facility_id"], c) for c in self.queue]
            top, _, row = max(rated, key=lambda r: r[:2])
            stale = self.lists is None and row["cells"] and any(box and _meet(tuple(row[c] for c in BOX), box) for box in self.boxes[len(self.boxes) - self.since :])
            if not stale and top > self._beyond(mode, remaining):
                return row | self.parts(row, remaining, mode) | {"score": top}
        self._read(mode, remaining)
        row = self.queue[0]
        return row | self.parts(row, remaining, mode)

    def _beyond(self, mode: str, remaining: int) -> float:
        """No row outside the queue can score more."""
        if self.last is None:
            return float("-inf")
        weight = self.config.progress * self.config.modes[mode]["progress"]
        gain = min(self.most, remaining)  # no other gain wins more, as its share is 1 at most
        more = gain / remaining - gain / self.remaining if remaining > 0 else 0.0
        return self.last + weight * max(more, 0.0) + 1e-9

    def parts(self, row: dict, remaining: float, mode: str) -> dict[str, float]:
        """``components`` of a row on the driver, by the same operations on doubles."""
        n = self.clusters.get(row["cluster"], 0) if row["cluster"] >= 0 else None
        seen = row["seen_cells"] if self.config.overlap_as_coded else row["seen"]
        climate = 0.0 if n is None else 1.0 if n < self.config.min_per_cluster else 1.0 / (1.0 + n)
        return {
            "coverage_norm": row["gain"] / self.total,
            "overlap_frac": seen / row["own"] if row["own"] else 0.0,
            "climate_norm": climate if self.config.climate_on else 0.0,
            "volume_norm": row["volume_norm"],
            "progress_norm": min(row["gain"] / float(remaining), 1.0) if remaining > 0 else 0.0,
            "distance_norm": min(row["mean_km"] / 100.0, 1.0) if mode == "distance" else 0.0,
        }

    def _read(self, mode: str, remaining: int) -> None:
        """The QUEUE best rows by today's scores; after FOLD picks the changes are written into ``now`` first."""
        if self.pending >= FOLD:
            self.now, self.pending = table(self._changed(), "coverage-now"), 0
        rows = self._changed() if self.pending else self.now
        rows = rows.selectExpr("*", f"{self._score_sql(mode, float(remaining))} AS score").orderBy(F.desc_nulls_last("score"), "facility_id").limit(QUEUE + 1).collect()
        weights = (self.config.coverage, self.config.overlap, self.config.climate, self.config.volume, self.config.progress, self.config.distance, *self.config.modes[mode].values())
        keep = QUEUE if min(weights) >= 0 else 1  # with a negative weight what is stale is no bound
        self.queue, self.last = [r.asDict() for r in rows[:keep]], rows[keep].score if len(rows) > keep else None
        self.since, self.remaining, self.lists = 0, remaining, None
        if keep > 1 and self._tell():
            fits = int((np.cumsum([c["cells"] for c in self.queue]) <= QUEUE_CELLS).sum()) or 1
            if fits < len(self.queue):
                self.queue, self.last = self.queue[:fits], rows[fits].score
            pairs = self.pairs.where(self.of([c["facility_id"] for c in self.queue])).select("facility_id", "cell_id", F.coalesce("pop", F.lit(0)), "n").toArrow()
            self.lists = tuple(pairs.column(i).to_numpy() for i in range(4))

    def _score_sql(self, mode: str, remaining: float) -> str:
        """``score`` of ``components`` as text, by the same operations on doubles: Spark parses it faster than it takes columns."""
        c, m, real = self.config, self.config.modes[mode], lambda x: f"double('{x!r}')"
        counts = "".join(f" WHEN {k} THEN {n}" for k, n in self.clusters.items())
        n = f"CASE cluster{counts} ELSE 0 END" if counts else "0"
        parts = {
            "coverage": f"gain / {real(self.total)}",
            "overlap": f"coalesce(try_divide(double({'seen_cells' if c.overlap_as_coded else 'seen'}), double(own)), 0D)",
            "climate": f"CASE WHEN cluster < 0 THEN 0D WHEN {n} < {c.min_per_cluster} THEN 1D ELSE 1D / (1D + {n}) END" if c.climate_on else "0D",
            "volume": "volume_norm",
            "progress": f"least(gain / {real(remaining)}, 1D)" if remaining > 0 else "0D",
            "distance": "least(mean_km / 100D, 1D)" if mode == "distance" else "0D",
        }
        weights = {"coverage": c.coverage * m["coverage"], "overlap": c.overlap * m["overlap"], "climate": c.climate, "volume": c.volume * m["volume"], "progress": c.progress * m["progress"], "distance": c.distance * m["distance"]}
        a, b, d, e, f, g = (f"{real(float(weights[k]))} * ({parts[k]})" for k in parts)
        return f"{a} - {b} + {d} + {e} + {f} - {g}"

    def take(self, row: dict, **record: float) -> None:
        self.chosen.append((row["facility_id"], record))
        self.boxes.append(tuple(row[c] for c in BOX) if row["cells"] else None)
        self.pending, self.since = self.pending + 1, self.since + 1
        if self.lists is not None and self.told == len(self.chosen) - 1:
            self._take_off(row["facility_id"])
        self.queue = [c for c in self.queue if c["facility_id"] != row["facility_id"]]
        self.cells += row["cells"]
        self.covered_pop += row["gain"]
        if row["cluster"] >= 0:
            self.clusters[row["cluster"]] = self.clusters.get(row["cluster"], 0) + 1

    def _take_off(self, facility_id: int) -> None:
        """A queue's row is taken: its newly covered cells off the gains of the queue's other rows."""
        facility, cell, pop, n = self.lists
        fresh = np.setdiff1d(cell[facility == facility_id], self.known)
        self.known, self.told = np.union1d(self.known, fresh), len(self.chosen)
        met = np.isin(cell, fresh)
        ids, at = np.unique(facility[met], return_inverse=True)
        people, cells = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
        np.add.at(people, at, pop[met])
        np.add.at(cells, at, n[met])
        off = dict(zip(ids.tolist(), zip(people.tolist(), cells.tolist(), strict=True), strict=True))
        for c in self.queue:
            p, k = off.get(c["facility_id"], (0, 0))
            c["gain"], c["seen"], c["seen_cells"] = c["gain"] - p, c["seen"] + p, c["seen_cells"] + k

    def frame(self, spark) -> DataFrame:
        names = ("score", *PARTS)
        columns = {"pick": pa.array(range(1, len(self.chosen) + 1), pa.int32()), "facility_id": pa.array([f for f, _ in self.chosen], pa.int64())}
        columns |= {n: pa.array([float(r.get(n, 0.0)) for _, r in self.chosen], pa.float64()) for n in names}
        return spark.createDataFrame(pa.table(columns))  # Arrow needs no Python worker


def greedy(facilities: DataFrame, cells: DataFrame, mode: str, radius: str = "initial_radius_km", config: CoverageConfig = CoverageConfig(), seeds: list | None = None) -> tuple[DataFrame, int, int]:
    """(picks, covered people, all people): the best-scored facility again and again, the least id on ties.

    ``fewest`` stops at its coverage with enough areas, the other modes at a number of areas or a higher coverage.
    ``seeds`` are taken first, with zero scores.
    """
    places = cell_places(cells)
    total = int(places.agg(F.sum("pop")).first()[0] or 0)
    s = Selection(facilities, places, radius, total, config)
    _search(s, mode, total, seeds)
    return s.frame(cells.sparkSession), s.covered_pop, total


def _search(s: Selection, mode: str, total: int, seeds: list | None = None) -> None:
    """``greedy`` with a selection that has nothing chosen yet."""
    config = s.config
    target = int(total * config.progress_tau)
    s.seed(seeds or [])
    while len(s.chosen) < s.n and total:
        pct = 100.0 * s.covered_pop / total
        if mode == "fewest" and pct >= config.fewest_pct and len(s.chosen) >= config.min_areas:
            break
        if mode != "fewest" and (len(s.chosen) >= config.max_areas or pct >= config.other_pct):
            break
        best = s.next(mode, target)
        s.take(best, score=best["score"], **{p: best[p] for p in PARTS})


def _kept(order: list[int], pairs: DataFrame, threshold: float) -> tuple[list[int], int]:
    """The areas of ``order`` that ``remove_overlapping`` keeps, and the people of their cells."""
    spark = pairs.sparkSession
    number = spark.createDataFrame(pa.table({"area": pa.array(range(len(order)), pa.int32()), "facility_id": pa.array(order, pa.int64())}))
    size = F.max(F.col("n") if "n" in pairs.columns else F.lit(1)).alias("n")
    cells = pairs.join(F.broadcast(number), "facility_id").groupBy("cell_id").agg(F.sort_array(F.collect_set("area")).alias("within"), size, F.max("pop").alias("pop"))  # of a few dozen numbers
    patterns = cells.groupBy("within").agg(F.sum("n").alias("n"), F.coalesce(F.sum("pop"), F.lit(0)).alias("pop"))
    few = [(set(r.within), r.n, r["pop"]) for r in patterns.limit(PATTERNS + 1).collect()]
    if len(few) > PATTERNS:
        few, patterns = None, table(patterns, "coverage-patterns")
    total = lambda c, where: F.coalesce(F.sum(F.when(where, F.col(c))), F.lit(0))

    def shares(area: int, kept: list[int]) -> tuple[int, int]:
        """Cells of an area, and those of them in any kept one."""
        if few is not None:
            mine = [(w, n) for w, n, _ in few if area in w]
            return sum(n for _, n in mine), sum(n for w, n in mine if not w.isdisjoint(kept))
        mine = patterns.where(F.array_contains("within", area))
        return tuple(mine.agg(F.coalesce(F.sum("n"), F.lit(0)), total("n", F.arrays_overlap("within", F.lit(kept)))).first())

    kept: list[int] = []
    for i in range(len(order)):
        own, shared = shares(i, kept) if i else (1, 0)
        if own and shared / own <= threshold:
            kept.append(i)
    if few is not None:
        people = sum(p for w, _, p in few if not w.isdisjoint(kept))
    else:
        people = patterns.agg(total("pop", F.arrays_overlap("within", F.lit(kept)))).first()[0]
    return [order[i] for i in kept], int(people)


def remove_overlapping(areas: DataFrame, pairs: DataFrame, threshold: float = 0.80) -> DataFrame:
    """Areas by volume, largest first, without those that have no cells, or more than ``threshold`` of them in the
    union of the larger ones kept. Rows of ``pairs`` with a column ``n`` are so many cells each.

    One job groups the cells by the set of areas they lie in; n circles cut the plane into n (n - 1) + 2 such sets at most,
    so for a few dozen areas these counts are what the fold over the areas needs. Where there are more than PATTERNS sets
    they stay a table and each area is one sum over it.
    """
    order = _by_volume(areas)
    kept = set(_kept(order, pairs, threshold)[0]) if order else set()
    gone = [f for f in order if f not in kept]
    return areas.where(~F.col("facility_id").isin(gone)) if gone else areas


def _by_volume(areas: DataFrame) -> list[int]:
    return [r.facility_id for r in areas.orderBy(F.desc("volume"), "facility_id").select("facility_id").collect()]  # a few dozen


def highest_volume(facilities: DataFrame, region: str = "governorate") -> DataFrame:
    """The facility of the highest volume in each region, the least id on ties."""
    rank = F.struct((-F.coalesce("volume", F.lit(0))).alias("volume"), "facility_id")
    best = F.min_by(F.struct(*facilities.columns), rank).alias("__best")  # combined before the shuffle: a region may hold most rows
    return facilities.where(F.col(region).isNotNull()).groupBy(region).agg(best).select("__best.*")


def governorate_coverage(facilities: DataFrame, cells: DataFrame, radii: list[float], tau: float = 0.60, config: CoverageConfig = CoverageConfig()) -> tuple[DataFrame, int, int]:
    """One area in every governorate, then greedily up to the target: the largest radius that gets there.

    With no such radius all facilities with cells are returned at the largest one, those beyond the picks without a pick
    number. (picks with radius_km and the covered share of their governorate's people, covered, all)

    ``config.tau_as_coded`` accepts a radius at tau of the target, ``config.needy_as_coded`` stops when no cluster below
    its minimum has a candidate; both keep first-written behaviour.
    """
    spark, total = cells.sparkSession, int(cells.agg(F.sum("pop")).first()[0] or 0)
    target, last = int(total * tau), None
    places = cell_places(cells)
    enough = tau * target if config.tau_as_coded else target
    cells_in = cells.select("cell_id", "lon", "lat", "pop", *[c for c in ("governorate",) if c in cells.columns])
    named = facilities.where("governorate IS NOT NULL").groupBy("governorate").agg(F.min("facility_id").alias("first")).orderBy("first")
    regions = [x.governorate for x in named.collect()]  # a row for each governorate
    for r in sorted(radii, reverse=True):
        s = Selection(facilities, places, r, total, config, regions)
        if last and (s.all_cells().agg(F.sum("pop")).first()[0] or 0) < enough:
            break  # all facilities together fall short here, and so they do at every smaller radius

        def reward(s=s) -> Column:
            known = F.when(F.col("cluster") >= 0, s.cluster_count())
            return F.coalesce(governorate_climate(known, F.lit(max(1, sum(s.clusters.values()))), config), F.lit(0.0)) if config.climate_on else F.lit(0.0)

        for g in range(len(regions)):
            worth = config.coverage * F.col("gain") + config.climate * F.when(F.col("cluster") >= 0, reward()).otherwise(0.0)
            best = s.best({}, lambda _, worth=worth: worth, F.col("region") == g + 1, False)
            if best:
                s.take(best, score=best["score"])
        while s.covered_pop < target:
            seen = F.col("seen_cells") if config.overlap_as_coded else F.col("seen")
            needy = (F.col("cluster") >= 0) & (s.cluster_count() < config.min_per_cluster)
            worth = config.coverage * F.col("gain") - config.overlap * F.try_divide(seen, F.col("own")) * s.total + config.climate * F.when(F.col("cluster") >= 0, reward()).otherwise(0.0) + config.volume * F.col("volume_norm") * s.total
            best = s.best({}, lambda _, worth=worth: worth, (F.col("own") > 0) & needy, False)
            best = best if best or config.needy_as_coded else s.best({}, lambda _, worth=worth: worth, F.col("own") > 0, False)
            if best is None or best["score"] <= 0:
                break
            s.take(best, score=best["score"])
        if s.chosen and s.covered_pop >= enough:
            return _with_shares(s.frame(spark), s.covered(), facilities, cells_in, r), s.covered_pop, total
        last = last or s
    rest = last.pairs.where(~last.of([f for f, _ in last.chosen])).groupBy("facility_id").agg(F.sum("pop").alias("own")).where("own > 0")
    picks = last.frame(spark).unionByName(rest.select(F.lit(None).cast("int").alias("pick"), "facility_id", F.lit(0.0).alias("score"), *[F.lit(0.0).alias(p) for p in PARTS]))
    covered = last.all_cells()
    return _with_shares(picks, covered, facilities, cells_in, max(radii)), int(covered.agg(F.sum("pop")).first()[0] or 0), total


def _with_shares(picks: DataFrame, covered: DataFrame, facilities: DataFrame, cells: DataFrame, radius: float) -> DataFrame:
    """radius_km, and where cells name their governorate the share of its people that is covered."""
    picks = picks.withColumn("radius_km", F.lit(float(radius)))
    if "governorate" not in cells.columns:
        return picks
    places = cells.join(covered.select("cell_id"), "cell_id", "left_semi").select("lon", "lat", F.lit(True).alias("__in"))  # one of the cells at a place stands for all
    inside = cells.join(places, ["lon", "lat"], "left").groupBy("governorate")
    shares = inside.agg((F.coalesce(F.sum(F.when(F.col("__in"), F.col("pop"))), F.lit(0)) / F.sum("pop")).alias("governorate_share"))
    return picks.join(facilities.select("facility_id", "governorate"), "facility_id", "left").join(shares, "governorate", "left").drop("governorate")


def optimize(facilities: DataFrame, cells: DataFrame, objective: str, network_type: str = "INF", config: CoverageConfig = CoverageConfig(), radii: list[float] | None = None) -> CoverageResult:
    """The service areas for an objective: fewest, footprint, distance, governorate_tau_coverage, governorate_fewest."""
    if objective != "governorate_tau_coverage":
        return optimize_each(facilities, cells, [(objective, config)], network_type)[0]
    ready = table(initial_radii(facilities, cell_places(cells), config), "coverage-radii")
    picks, covered, total = governorate_coverage(ready, cells, radii or [config.max_radius], config.progress_tau, config)
    areas = adaptive_radii(ready.join(picks, "facility_id"))
    areas = areas.withColumn("network_type", F.lit(network_type)).withColumn("optimization_mode", F.lit(objective))
    return CoverageResult(areas, objective, network_type, total, covered)


def optimize_each(facilities: DataFrame, cells: DataFrame, wanted: list[tuple[str, CoverageConfig]], network_type: str = "INF") -> list[CoverageResult]:
    """``optimize`` for several objectives (any but governorate_tau_coverage), whose settings differ in no radius: radii,
    pairs and rows of facilities are made once for all."""
    places, first = cell_places(cells), wanted[0][1]
    ready = table(initial_radii(facilities, places, first), "coverage-radii")
    total = int(places.agg(F.sum("pop")).first()[0] or 0)
    s = Selection(ready, places, "initial_radius_km", total, first)
    return [_optimized(s.anew(config), ready, objective, network_type, total) for objective, config in wanted]


def _optimized(s: Selection, ready: DataFrame, objective: str, network_type: str, total: int) -> CoverageResult:
    """``optimize`` by a search, with a selection of ``ready`` that has nothing chosen yet. The areas have the radius that
    the search is made with, so their cells are those of the selection."""
    seeds = [r.facility_id for r in highest_volume(ready).orderBy("facility_id").collect()] if objective == "governorate_fewest" else None
    _search(s, "fewest" if objective == "governorate_fewest" else objective, total, seeds)
    picks, covered = s.frame(ready.sparkSession), s.covered_pop
    areas = ready.join(F.broadcast(picks) if len(s.chosen) <= BROADCAST_ROWS else picks, "facility_id").withColumn("service_radius_km", F.col("initial_radius_km"))
    if objective in ("footprint", "distance"):
        order, covered = _by_volume(areas), 0
        if order:
            kept, covered = _kept(order, s.pairs.where(s.of(order)), 0.80)
            gone = sorted({*order} - {*kept})
            areas = areas.where(~F.col("facility_id").isin(gone)) if gone else areas
    areas = areas.withColumn("network_type", F.lit(network_type)).withColumn("optimization_mode", F.lit(objective))
    return CoverageResult(areas, objective, network_type, total, covered)


def climate_ablation(facilities: DataFrame, cells: DataFrame, objective: str, config: CoverageConfig = CoverageConfig()) -> DataFrame:
    """The summaries of an objective with and without the climate reward."""
    on, off = optimize_each(facilities, cells, [(objective, replace(config, climate_on=climate)) for climate in (True, False)])
    return on.summary_df().withColumn("climate_on", F.lit(True)).unionByName(off.summary_df().withColumn("climate_on", F.lit(False)))


def area_population(pairs: DataFrame, radius: DataFrame) -> DataFrame:
    """(facility_id, population, density) by each area's own radius (facility_id, radius_km)."""
    people = pairs.groupBy("facility_id").agg(F.sum("pop").alias("population"))
    out = radius.join(people, "facility_id", "left").withColumn("population", F.coalesce("population", F.lit(0)))
    return out.withColumn("density", F.try_divide("population", F.pi() * F.col("radius_km") * F.col("radius_km")))


def area_details(areas: DataFrame, facilities: DataFrame, pairs: DataFrame, radius: str = "service_radius_km") -> DataFrame:
    """A row for each area: own volume, facilities inside and their volume, population, radius.

    Facilities at one place meet circles as one row, and areas that share a circle are counted once.
    """
    places = table(facilities.groupBy("lon", "lat").agg(F.count("*").alias("n"), F.sum("volume").alias("volume")), "facility-places")
    circles = shared_circles(areas, radius)
    inside = range_join(places, circles, radius).groupBy("anchor_id").agg(F.sum("n").alias("n_facilities"), F.sum("volume").alias("total_volume"))
    people = pairs.groupBy("facility_id").agg(F.sum("pop").alias("population"))
    own = of_circle(areas.select("facility_id", "lon", "lat", "volume", radius), inside, circles, radius)
    own = own.select("facility_id", F.col("volume").alias("anchor_volume"), F.col(radius).alias("radius_km"), "n_facilities", "total_volume")
    return own.join(people, "facility_id", "left").fillna(0, ["n_facilities", "total_volume", "population"])


def compare_modes(details: DataFrame, mode: str = "mode") -> DataFrame:
    return details.groupBy(mode).agg(F.count("*").alias("n_areas"), F.avg("n_facilities").alias("mean_facilities"), F.sum("n_facilities").alias("sum_facilities"), F.avg("total_volume").alias("mean_volume"), F.sum("total_volume").alias("sum_volume"))


def target_population(cells: DataFrame, tau: float) -> DataFrame:
    return cells.agg(F.sum("pop").alias("total_pop"), F.floor(F.sum("pop") * tau).cast("long").alias("target_pop"))


def outlines(areas: DataFrame, radius: str = "service_radius_km", points: int = 64) -> DataFrame:
    return areas.withColumn("outline", circle_outline(F.col("lon"), F.col("lat"), F.col(radius), points))


def clipped_outlines(areas: DataFrame, west: float, south: float, east: float, north: float) -> DataFrame:
    """Outlines cut at the box of the country: points beyond it move to its edge."""
    cut = F.transform("outline", lambda p: F.struct(clipped(p["lon"], west, east).alias("lon"), clipped(p["lat"], south, north).alias("lat")))
    return areas.withColumn("outline", cut)
