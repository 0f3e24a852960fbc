"""Geography as column expressions: WGS84 degrees in, kilometres out."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0
#: Kilometres in a degree of latitude and, at the equator, of longitude.
KM_LAT, KM_LON = 110.574, 111.32


def haversine_km(lon1: Column, lat1: Column, lon2: Column, lat2: Column, cos1: Column | None = None, cos2: Column | None = None) -> Column:
    """``cos1`` and ``cos2`` are the latitudes' cosines where they are known already."""
    dlon, dlat = F.radians(lon2 - lon1), F.radians(lat2 - lat1)
    cos1, cos2 = (F.cos(F.radians(lat)) if cos is None else cos for lat, cos in ((lat1, cos1), (lat2, cos2)))
    half = F.pow(F.sin(dlat / 2), 2) + cos1 * cos2 * F.pow(F.sin(dlon / 2), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(F.lit(1.0), half)))


def degree_box(radius_km: Column, lat: Column) -> tuple[Column, Column]:
    """Half width (longitude) and half height (latitude) in degrees of a box around a circle."""
    return radius_km / (KM_LON * F.greatest(F.lit(0.1), F.cos(F.radians(lat)))), radius_km / KM_LAT


def destination(lon: Column, lat: Column, bearing: Column, distance_km: Column) -> Column:
    """The point (lon, lat) at a bearing in radians and a distance."""
    d, phi = distance_km / EARTH_KM, F.radians(lat)
    to = F.asin(F.sin(phi) * F.cos(d) + F.cos(phi) * F.sin(d) * F.cos(bearing))
    turn = F.atan2(F.sin(bearing) * F.sin(d) * F.cos(phi), F.cos(d) - F.sin(phi) * F.sin(to))
    return F.struct((lon + F.degrees(turn)).alias("lon"), F.degrees(to).alias("lat"))


def circle_outline(lon: Column, lat: Column, radius_km: Column, points: int = 64) -> Column:
    """A closed ring around a circle."""
    return F.transform(F.sequence(F.lit(0), F.lit(points)), lambda i: destination(lon, lat, (i % points) * (2 * math.pi / points), radius_km))


def morton(x: Column, y: Column) -> Column:
    """The place of a cell (whole numbers from 0 to 65535) on a Z-shaped curve: near cells are mostly near on it."""

    def spread(v: Column) -> Column:
        v = v.cast("long")
        for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
            v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask).cast("long"))
        return v

    return spread(x).bitwiseOR(F.shiftleft(spread(y), 1))


def morton_ranges(x0: int, x1: int, y0: int, y1: int, most: int = 8) -> list[tuple[int, int]]:
    """At most ``most`` ranges of the curve that hold all cells of a box, with few others: the smallest gaps are closed."""
    spread = lambda v: sum((v >> b & 1) << 2 * b for b in range(16))
    codes = sorted(spread(x) | spread(y) << 1 for x in range(x0, x1 + 1) for y in range(y0, y1 + 1))
    gaps = sorted(range(1, len(codes)), key=lambda i: codes[i - 1] - codes[i])[: most - 1]
    cuts = [0, *sorted(i for i in gaps if codes[i] - codes[i - 1] > 1), len(codes)]
    return [(codes[a], codes[b - 1]) for a, b in zip(cuts, cuts[1:], strict=False)]


def in_ring(lon: Column, lat: Column, ring: Column) -> Column:
    """Whether the point lies in the ring (array of lon, lat structs, closed or not), by even-odd ray casting."""
    after = F.concat(F.slice(ring, F.lit(2), F.size(ring)), F.slice(ring, F.lit(1), F.lit(1)))
    crosses = F.zip_with(
        ring,
        after,
        lambda a, b: ((a["lat"] > lat) != (b["lat"] > lat)) & (lon < (b["lon"] - a["lon"]) * F.try_divide(lat - a["lat"], b["lat"] - a["lat"]) + a["lon"]),
    )
    return F.size(F.filter(crosses, lambda c: c)) % 2 == 1
