"""Geometry as Columns: boxes, rings, distances. Coordinates are integers of 1e-7 degrees unless said otherwise."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Mean radius of the earth in metres (fixed value).
EARTH_M = 6_371_000.0


@dataclass(frozen=True)
class Box:
    """A box of whole units, edges included."""

    min_lat: int
    min_lon: int
    max_lat: int
    max_lon: int

    @staticmethod
    def of(text: str) -> Box:
        """``min_lon,min_lat,max_lon,max_lat`` in degrees; lower bounds are rounded down and upper ones up."""
        parts = [float(x) for x in text.split(",")]
        if len(parts) != 4 or not (parts[0] < parts[2] and parts[1] < parts[3]):
            raise ValueError(f"not a box: {text!r}")
        lo = lambda x: math.floor(x * 1e7)
        hi = lambda x: math.ceil(x * 1e7)
        return Box(lo(parts[1]), lo(parts[0]), hi(parts[3]), hi(parts[2]))

    def contains(self, lat: Column | str = "lat_e7", lon: Column | str = "lon_e7") -> Column:
        lat, lon = (F.col(c) if isinstance(c, str) else c for c in (lat, lon))
        return lat.between(self.min_lat, self.max_lat) & lon.between(self.min_lon, self.max_lon)


Ring = list[tuple[float, float]]  # (lon, lat) in degrees, closed or not


@dataclass(frozen=True)
class Region:
    """A box, or polygons: each a list of rings of which the first is the outline and the others are holes."""

    box: Box
    polygons: tuple[tuple[tuple[tuple[float, float], ...], ...], ...] = ()

    @staticmethod
    def of_polygons(polygons: list[list[Ring]]) -> Region:
        rings = tuple(tuple(tuple((float(x), float(y)) for x, y in ring) for ring in p) for p in polygons)
        xs = [x for p in rings for x, _ in p[0]]
        ys = [y for p in rings for _, y in p[0]]
        if any(crosses_antimeridian(p[0]) for p in rings):
            xs = [-180.0, 180.0]
        return Region(Box(math.floor(min(ys) * 1e7), math.floor(min(xs) * 1e7), math.ceil(max(ys) * 1e7), math.ceil(max(xs) * 1e7)), rings)

    def contains(self, lat: Column | str = "lat_e7", lon: Column | str = "lon_e7") -> Column:
        """The box test first, which reaches the scan; then, of any polygon, inside the outline and outside its holes."""
        inside = self.box.contains(lat, lon)
        if not self.polygons:
            return inside
        lat, lon = (F.col(c) if isinstance(c, str) else c for c in (lat, lon))
        x, y = lon / F.lit(1e7), lat / F.lit(1e7)
        any_of = F.lit(False)
        for outline, *holes in self.polygons:
            one = in_ring(x, y, outline)
            for hole in holes:
                one = one & ~in_ring(x, y, hole)
            any_of = any_of | one
        return inside & any_of


def crosses_antimeridian(ring) -> bool:
    closed = [*ring, ring[0]]
    return any(abs(a[0] - b[0]) > 180 for a, b in zip(closed, closed[1:], strict=False))


def unwrapped(ring) -> list[tuple[float, float]]:
    """The ring with longitudes carried on past 180 degrees instead of jumping."""
    out = [ring[0]]
    for x, y in ring[1:]:
        while x - out[-1][0] > 180:
            x -= 360
        while x - out[-1][0] < -180:
            x += 360
        out.append((x, y))
    return out


def in_ring(x: Column, y: Column, ring) -> Column:
    """Whether a point in degrees lies in a ring, by the parity of edges that a ray to the east crosses.

    The ring is a literal array of edges, folded by a higher-order function inside code generation's reach. A ring
    that jumps by over 180 degrees is unwrapped and the point tested at x, x + 360 and x - 360.
    """
    if crosses_antimeridian(ring):
        flat = unwrapped(ring)
        return _in_flat(x, y, flat) | _in_flat(x + 360, y, flat) | _in_flat(x - 360, y, flat)
    return _in_flat(x, y, list(ring))


def _in_flat(x: Column, y: Column, ring) -> Column:
    edges = [(*a, *b) for a, b in zip(ring, [*ring[1:], ring[0]], strict=True) if a[1] != b[1]]
    if not edges:
        return F.lit(False)
    rows = F.array(*[F.array(*[F.lit(float(v)) for v in e]) for e in edges])
    crossing = lambda e: ((e[1] > y) != (e[3] > y)) & (x < (e[2] - e[0]) * (y - e[1]) / (e[3] - e[1]) + e[0])
    return F.size(F.filter(rows, crossing)) % 2 == 1


def point_in_edges(x: Column, y: Column, edges: Column | str) -> Column:
    """The same test against a column of edges (x1, y1, x2, y2)."""
    crossing = lambda e: ((e["y1"] > y) != (e["y2"] > y)) & (x < (e["x2"] - e["x1"]) * (y - e["y1"]) / (e["y2"] - e["y1"]) + e["x1"])
    return F.size(F.filter(edges, crossing)) % 2 == 1


def on_edges(x: Column, y: Column, edges: Column | str) -> Column:
    """Whether a point of whole units lies on one of a column of edges; exact in 64 bits, which products of two differences fit."""
    whole = lambda c: c.cast("bigint")
    x, y = whole(x), whole(y)
    between = lambda v, a, b: (v >= F.least(a, b)) & (v <= F.greatest(a, b))

    def on(e: Column) -> Column:
        x1, y1, x2, y2 = (whole(e[k]) for k in ("x1", "y1", "x2", "y2"))
        return between(x, x1, x2) & between(y, y1, y2) & ((x2 - x1) * (y - y1) == (y2 - y1) * (x - x1))

    return F.exists(edges, on)


def distance_sq(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Squared distance in radians on a plane scaled by the cosine of the first latitude."""
    dy = F.radians((lat2 - lat1.cast("double")) / F.lit(1e7))
    dx = F.radians((lon2 - lon1.cast("double")) / F.lit(1e7)) * F.cos(F.radians(lat1 / F.lit(1e7)))
    return dx * dx + dy * dy


def metres(rad_sq: Column) -> Column:
    return F.sqrt(rad_sq) * EARTH_M


def segment_t(lat: Column, lon: Column, lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Where on a segment, from 0 to 1, the point nearest to (lat, lon) lies."""
    k = F.cos(F.radians(lat / F.lit(1e7)))
    lat, lon = lat.cast("double"), lon.cast("double")  # differences of longitudes don't fit 32 bits
    ax, ay, bx, by = (lon1 - lon) * k, lat1 - lat, (lon2 - lon) * k, lat2 - lat
    dx, dy = bx - ax, by - ay
    size = dx * dx + dy * dy
    return F.when(size == 0, F.lit(0.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), -(ax * dx + ay * dy) / size)))


def signed_area2(ring: Column | str) -> Column:
    """Twice the signed area of a closed array of (lat_e7, lon_e7), positive when counter-clockwise; exact in decimals."""
    ring = F.col(ring) if isinstance(ring, str) else ring
    wide = lambda c: c.cast("decimal(19,0)")
    terms = F.zip_with(ring, F.slice(ring, 2, F.greatest(F.size(ring), F.lit(1))), lambda a, b: F.when(b.isNull(), F.lit(0).cast("decimal(38,0)")).otherwise((wide(a["lon_e7"]) * wide(b["lat_e7"]) - wide(b["lon_e7"]) * wide(a["lat_e7"])).cast("decimal(38,0)")))
    return F.aggregate(terms, F.lit(0).cast("decimal(38,0)"), lambda s, t: (s + t).cast("decimal(38,0)"))


def degrees(e7: Column | str) -> Column:
    """Degrees as text without trailing zeros, from whole units."""
    c = F.col(e7) if isinstance(e7, str) else e7
    size = F.abs(c.cast("bigint"))
    fraction = F.rtrim(F.lpad((size % 10_000_000).cast("string"), 7, "0"), F.lit("0"))
    whole = (size - size % 10_000_000) / 10_000_000
    text = F.concat(F.when(c < 0, "-").otherwise(""), whole.cast("bigint").cast("string"))
    return F.when(F.length(fraction) > 0, F.concat(text, F.lit("."), fraction)).otherwise(text)


def cell(lat: Column, lon: Column, size: int) -> tuple[Column, Column]:
    """Row and column of the grid cell of ``size`` units."""
    return F.floor(lat / F.lit(float(size))).cast("int"), F.floor(lon / F.lit(float(size))).cast("int")
