"""Distances, polygons and grids on the earth, as native expressions.

A ring is array<struct<x, y>> in degrees, a polygon an array of rings (the first outside, the others holes), a shape an array of
polygons. Distances from edges are taken on a local plane; over a few kilometres that differs from the spheroid by under half
a per cent."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MILES, METRES_PER_MILE = 3958.8, 1609.344
METRES_PER_DEGREE = 111_195.0
RING = "array<struct<x:double,y:double>>"
SHAPE = f"array<array<{RING}>>"


def miles(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    dlat, dlng = F.radians(lat2 - lat1), F.radians(lng2 - lng1)
    h = F.pow(F.sin(dlat / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlng / 2), 2)
    return 2 * MILES * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def metres(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    return miles(lat1, lng1, lat2, lng2) * METRES_PER_MILE


def format_distance(m: Column) -> Column:
    """Miles to a tenth, from 10 on whole: the double's own value is rounded, as C's printf does, and halves go to the even digit.
    ``m`` is held against k + 1/2 tenths as 20 m against n = 2 k + 1; by 4 m against n - 16 m no digit of it is lost."""
    k = F.floor(m * 10)
    rest = (2 * k + 1).cast("double") - 16 * m
    tenths = k + F.when((4 * m > rest) | ((4 * m == rest) & (k % 2 == 1)), 1).otherwise(0)
    text = F.concat_ws("", F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit(" mi"))
    return F.when(m < 0.1, "< 0.1 mi").when(m < 10, text).otherwise(F.format_string("%.0f mi", F.rint(m)))


def bound(value: Column, f) -> Column:
    """``f`` of ``value``, which is evaluated once however often ``f`` uses it."""
    return F.transform(F.array(value), f)[0]


def edges(ring: Column) -> Column:
    """struct<a, b> of neighbouring points, the last joined to the first."""
    return bound(ring, lambda r: F.transform(r, lambda p, i: F.struct(p.alias("a"), F.get(r, F.pmod(i + 1, F.size(r))).alias("b"))))


def in_ring(x: Column, y: Column, ring: Column) -> Column:
    """Even-odd rule: crossings of a ray to the right."""
    crosses = lambda e: ((e["a"]["y"] > y) != (e["b"]["y"] > y)) & (x < (e["b"]["x"] - e["a"]["x"]) * (y - e["a"]["y"]) / F.nullif(e["b"]["y"] - e["a"]["y"], F.lit(0.0)) + e["a"]["x"])
    return F.size(F.filter(edges(ring), lambda e: F.coalesce(crosses(e), F.lit(False)))) % 2 == 1


def in_shape(x: Column, y: Column, shape: Column) -> Column:
    """In a polygon's outer ring and in none of its holes."""
    inside = lambda polygon: in_ring(x, y, polygon[0]) & ~F.exists(F.slice(polygon, F.lit(2), F.greatest(F.size(polygon) - 1, F.lit(0))), lambda r: in_ring(x, y, r))
    return F.coalesce(F.exists(shape, inside), F.lit(False))


def on_edge(x: Column, y: Column, shape: Column) -> Column:
    """On an edge of one of the rings, exactly so where the edge follows a parallel or a meridian."""
    within = lambda c, v, e: v.between(F.least(e["a"][c], e["b"][c]), F.greatest(e["a"][c], e["b"][c]))
    flat = lambda e: (e["b"]["x"] - e["a"]["x"]) * (y - e["a"]["y"]) == (e["b"]["y"] - e["a"]["y"]) * (x - e["a"]["x"])
    return F.coalesce(F.exists(F.flatten(F.transform(F.flatten(shape), edges)), lambda e: within("x", x, e) & within("y", y, e) & flat(e)), F.lit(False))


def box(shape: Column) -> Column:
    """struct<west, south, east, north>, for a cheap test before the exact one."""
    points = F.flatten(F.flatten(shape))
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("west"), F.array_min(ys).alias("south"), F.array_max(xs).alias("east"), F.array_max(ys).alias("north"))


def in_box(x: Column, y: Column, b: Column, margin: Column | float = 0.0) -> Column:
    return x.between(b["west"] - margin, b["east"] + margin) & y.between(b["south"] - margin, b["north"] + margin)


def _to_edge(x: Column, y: Column, e: Column) -> Column:
    """Metres from a point to a segment, on a plane at the point."""
    k = F.cos(F.radians(y))
    ax, ay, bx, by = (e["a"]["x"] - x) * k, e["a"]["y"] - y, (e["b"]["x"] - x) * k, e["b"]["y"] - y
    dx, dy = bx - ax, by - ay
    t = F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), -(ax * dx + ay * dy) / F.nullif(dx * dx + dy * dy, F.lit(0.0)))), F.lit(0.0))
    return F.sqrt(F.pow(ax + t * dx, 2) + F.pow(ay + t * dy, 2)) * METRES_PER_DEGREE


def metres_to_shape(x: Column, y: Column, shape: Column) -> Column:
    """0 inside, else metres to the nearest edge."""
    sides = F.flatten(F.transform(F.flatten(shape), edges))
    return F.when(in_shape(x, y, shape), 0.0).otherwise(F.array_min(F.transform(sides, lambda e: _to_edge(x, y, e))))


def _ring_area(ring: Column) -> Column:
    """Square metres, on a plane at the ring's first point."""
    k = F.cos(F.radians(ring[0]["y"]))
    twice = F.aggregate(edges(ring), F.lit(0.0), lambda s, e: s + (e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"]) * k)
    return F.abs(twice) / 2 * METRES_PER_DEGREE**2


def area(shape: Column) -> Column:
    """Square metres, holes taken off."""
    one = lambda polygon: F.aggregate(polygon, F.lit(0.0), lambda s, r: s - _ring_area(r), lambda s: s + 2 * _ring_area(polygon[0]))
    return F.aggregate(F.transform(shape, one), F.lit(0.0), lambda s, v: s + v)


def rectangle(west: Column, south: Column, east: Column, north: Column) -> Column:
    """A shape of one ring."""
    p = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    return F.array(F.array(F.array(p(west, south), p(east, south), p(east, north), p(west, north), p(west, south))))


def cardinal_parts(west: Column, south: Column, east: Column, north: Column) -> Column:
    """The five rectangles of a box: a third at the south and the north, between them west, centre and east."""
    dx, dy = (east - west) / 3, (north - south) / 3
    part = lambda zone, w, s, e, n: F.struct(F.lit(zone).alias("zone"), w.alias("west"), s.alias("south"), e.alias("east"), n.alias("north"))
    return F.array(
        part("South", west, south, east, south + dy),
        part("West", west, south + dy, west + dx, south + 2 * dy),
        part("Central", west + dx, south + dy, west + 2 * dx, south + 2 * dy),
        part("East", west + 2 * dx, south + dy, east, south + 2 * dy),
        part("North", west, south + 2 * dy, east, north),
    )


def tiles(west: Column, south: Column, east: Column, north: Column, step: float) -> Column:
    """Centres of a grid of ``step`` degrees over a box."""
    n = lambda a, b: F.greatest(F.ceil((b - a) / step).cast("int"), F.lit(1))
    rows = F.sequence(F.lit(0), n(south, north) - 1)
    columns = F.sequence(F.lit(0), n(west, east) - 1)
    return F.flatten(F.transform(rows, lambda i: F.transform(columns, lambda j: F.struct((west + (j + 0.5) * step).alias("x"), (south + (i + 0.5) * step).alias("y")))))


def place_tier(place: Column) -> Column:
    return F.when(place.isin("suburb", "city_district", "borough"), "coarse").otherwise("fine")


def recognisability(place: Column, wikidata: Column, wikipedia: Column) -> Column:
    told = lambda c: F.coalesce(c, F.lit("")) != ""
    return F.when(told(wikidata) | told(wikipedia), 2).when(place.isin("suburb", "neighbourhood", "quarter"), 1).otherwise(0)
