"""Overlay of shapes as native expressions: parts inside and outside of a convex ring, envelope, centroid, circles.

A ring is cut by one half plane after the other: of every edge the points that stay and the point where it crosses. Of a ring
that the cut splits, the parts stay one ring that runs along the cut between them; sizes, centroids and tests of points are
those of the parts. Coordinates are a plane of degrees; a ring across the antimeridian goes on beyond 180 (``unwrapped``)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from almanac.functions import geo


def _point(x: Column, y: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"))


def unwrapped(ring: Column) -> Column:
    """``ring`` with each longitude within 180 degrees of the one before."""
    empty = F.array().cast(geo.RING)
    near = lambda x, last: x - 360 * F.round((x - last) / 360)
    return F.aggregate(ring, empty, lambda out, p: F.concat(out, F.array(_point(F.when(F.size(out) == 0, p["x"]).otherwise(near(p["x"], F.get(out, F.size(out) - 1)["x"])), p["y"]))))


def signed_area(ring: Column) -> Column:
    """Square degrees, positive if the ring runs counter-clockwise."""
    return F.aggregate(geo.edges(ring), F.lit(0.0), lambda s, e: s + (e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"]) / 2)


def _kept(ring: Column, plane: Column) -> Column:
    """The part of a ring where a * x + b * y <= c."""
    over = lambda p: plane["a"] * p["x"] + plane["b"] * p["y"] - plane["c"]

    def of(e: Column) -> Column:
        one, two = over(e["a"]), over(e["b"])
        t = one / F.nullif(one - two, F.lit(0.0))
        cross = _point(e["a"]["x"] + (e["b"]["x"] - e["a"]["x"]) * t, e["a"]["y"] + (e["b"]["y"] - e["a"]["y"]) * t)
        return F.concat(F.when(one <= 0, F.array(e["a"])).otherwise(F.array().cast(geo.RING)), F.when((one < 0) & (two > 0) | (one > 0) & (two < 0), F.array(cross)).otherwise(F.array().cast(geo.RING)))

    return F.flatten(F.transform(geo.edges(ring), of))


def _cut(shape: Column, planes: Column) -> Column:
    done = F.transform(shape, lambda p: F.transform(p, lambda r: F.aggregate(planes, r, _kept)))
    real = lambda r: (F.size(r) > 2) & (F.abs(signed_area(r)) > 0)
    return F.transform(F.filter(done, lambda p: (F.size(p) > 0) & real(F.get(p, F.lit(0)))), lambda p: F.filter(p, real))


def _planes(ring: Column) -> Column:
    """The half planes whose meeting a convex ring is, whichever way it runs."""
    plane = lambda e, way: F.struct((way * (e["b"]["y"] - e["a"]["y"])).alias("a"), (way * (e["a"]["x"] - e["b"]["x"])).alias("b"), (way * ((e["b"]["y"] - e["a"]["y"]) * e["a"]["x"] + (e["a"]["x"] - e["b"]["x"]) * e["a"]["y"])).alias("c"))
    told = geo.bound(F.struct(geo.edges(ring).alias("edges"), F.signum(signed_area(ring)).alias("way")), lambda s: F.transform(s["edges"], lambda e: plane(e, s["way"])))
    return F.filter(told, lambda p: (p["a"] != 0) | (p["b"] != 0))


def inside(shape: Column, convex: Column) -> Column:
    """The part of ``shape`` inside of a convex ring; no polygons if there is none, null if the shape is null."""
    return geo.bound(_planes(convex), lambda planes: _cut(shape, planes))


def outside(shape: Column, convex: Column) -> Column:
    """The part of ``shape`` outside of a convex ring, as pieces that touch: beyond the first half plane; inside of it and beyond the
    second; and so on."""
    turned = lambda p: F.struct((-p["a"]).alias("a"), (-p["b"]).alias("b"), (-p["c"]).alias("c"))
    piece = lambda planes, p, i: geo.bound(F.concat(F.slice(planes, F.lit(1), i), F.array(turned(p))), lambda own: _cut(shape, own))
    return geo.bound(_planes(convex), lambda planes: F.flatten(F.transform(planes, lambda p, i: piece(planes, p, i))))


def envelope(shape: Column) -> Column:
    """The shape's box as a shape; null without points."""
    b = geo.box(shape)
    return F.when(b["west"].isNotNull(), geo.rectangle(b["west"], b["south"], b["east"], b["north"]))


def centroid(shape: Column) -> Column:
    """struct<x, y>: the centre of the area, holes taken off; null for a shape without area."""
    rings = F.flatten(F.transform(shape, lambda p: F.transform(p, lambda r, i: F.struct(r.alias("ring"), (F.when(i == 0, 1.0).otherwise(-1.0) * F.signum(signed_area(r))).alias("way")))))

    def add(s: Column, r: Column) -> Column:
        """Moments about the ring's first point, so that far coordinates cost no digits."""
        o = r["ring"][0]
        cross = lambda e: (e["a"]["x"] - o["x"]) * (e["b"]["y"] - o["y"]) - (e["b"]["x"] - o["x"]) * (e["a"]["y"] - o["y"])
        total = lambda f: F.aggregate(geo.edges(r["ring"]), F.lit(0.0), lambda t, e: t + f(e))
        size = total(cross) / 2 * r["way"]
        mx = total(lambda e: cross(e) * (e["a"]["x"] + e["b"]["x"] - 2 * o["x"])) / 6 * r["way"]
        my = total(lambda e: cross(e) * (e["a"]["y"] + e["b"]["y"] - 2 * o["y"])) / 6 * r["way"]
        return F.struct((s["size"] + size).alias("size"), (s["x"] + mx + size * o["x"]).alias("x"), (s["y"] + my + size * o["y"]).alias("y"))

    start = F.struct(*[F.lit(0.0).alias(c) for c in ("size", "x", "y")])
    return F.aggregate(rings, start, add, lambda s: F.when(s["size"] > 0, _point(s["x"] / s["size"], s["y"] / s["size"])))


def circle(x: Column, y: Column, metres: Column, corners: int = 64) -> Column:
    """A ring of ``corners`` points ``metres`` away from a point, on a plane at it: a buffer to cut with."""
    turn = lambda i: i * (2 * 3.141592653589793 / corners)
    r = metres / geo.METRES_PER_DEGREE
    return F.transform(F.sequence(F.lit(0), F.lit(corners - 1)), lambda i: _point(x + r * F.cos(turn(i)) / F.cos(F.radians(y)), y + r * F.sin(turn(i))))
