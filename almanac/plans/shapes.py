"""Queries of overlay, and of distances on the spheroid."""

from __future__ import annotations

from pyspark.sql import functions as F

from almanac.functions import geo, overlay, spheroid
from almanac.operators import coverage
from almanac.plans import inputs as i
from almanac.plans.catalogue import query

_CELLS = "cells AS (SELECT DISTINCT city, CAST(floor(x * 20) AS BIGINT) AS cx, CAST(floor(y * 20) AS BIGINT) AS cy FROM points)"


@query(
    "g7_dissolved_areas",
    f"""WITH {i.POINTS}, {_CELLS}, sides AS (SELECT a.city, count(*) AS n FROM cells a JOIN cells b ON a.city = b.city AND abs(a.cx - b.cx) + abs(a.cy - b.cy) = 1 GROUP BY 1)
SELECT city, count(*) AS size, 4 * count(*) - coalesce(any_value(n), 0) AS perimeter, round(avg(cx) + 0.5, 4) AS x, round(avg(cy) + 0.5, 4) AS y,
  round(min(cx) / 20.0, 4) AS west, round(min(cy) / 20.0, 4) AS south, round((max(cx) + 1) / 20.0, 4) AS east, round((max(cy) + 1) / 20.0, 4) AS north
FROM cells LEFT JOIN sides USING (city) GROUP BY city""",
)
def dissolved(s, d):
    """The cells that have a place, as one shape for each city: size and perimeter (in cells), centre and envelope."""
    at = lambda c: F.floor(F.col(c) * 20)
    cells = i.points(s, d).select("city", at("x").alias("cx"), at("y").alias("cy")).distinct()
    west, south = F.col("cx") / 20, F.col("cy") / 20
    whole = coverage.dissolved(cells.select("city", geo.rectangle(west, south, west + 0.05, south + 0.05).alias("shape")), ["city"])
    rings = F.flatten("shape")
    size = F.aggregate("shape", F.lit(0.0), lambda t, p: t + F.aggregate(p, F.lit(0.0), lambda u, r: u + overlay.signed_area(r)))
    length = F.aggregate(F.transform(rings, lambda r: F.aggregate(geo.edges(r), F.lit(0.0), lambda t, e: t + F.abs(e["a"]["x"] - e["b"]["x"]) + F.abs(e["a"]["y"] - e["b"]["y"]))), F.lit(0.0), lambda t, v: t + v)
    told = whole.select("city", size.alias("size"), length.alias("length"), overlay.centroid(F.col("shape")).alias("c"), geo.box(F.col("shape")).alias("b"))
    whole_number = lambda c: F.round(c).cast("long")
    return told.select("city", whole_number(F.col("size") * 400).alias("size"), whole_number(F.col("length") * 20).alias("perimeter"), F.round(F.col("c.x") * 20, 4).alias("x"), F.round(F.col("c.y") * 20, 4).alias("y"), *[F.round(F.col(f"b.{c}"), 4).alias(c) for c in ("west", "south", "east", "north")])


_ZONES = "zones AS (SELECT z.* FROM (VALUES ('South', 0, 0, 3, 1), ('West', 0, 1, 1, 2), ('Central', 1, 1, 2, 2), ('East', 2, 1, 3, 2), ('North', 0, 2, 3, 3)) z(zone, a, b, c, d))"


@query(
    "g7_clipped_areas",
    f"""WITH {i.AREAS}, {_ZONES}, met AS (SELECT area, zone, greatest(0, least(west + 0.55, -121.95 + 0.6 * c) - greatest(west, -121.95 + 0.6 * a)) * greatest(0, least(south + 0.55, 37.05 + 0.6 * d) - greatest(south, 37.05 + 0.6 * b)) AS size FROM areas, zones)
SELECT area, zone, round(CAST(size AS DOUBLE), 6) AS size, round(CAST(0.3025 - size AS DOUBLE), 6) AS rest FROM met WHERE size > 1e-9""",
)
def clipped(s, d):
    """The areas cut with the five zones of a box that lies across them, and what the cut leaves."""
    zones = F.explode(geo.cardinal_parts(*[F.lit(v) for v in (-121.95, 37.05, -120.15, 38.85)]))
    met = i.areas(s, d).select("area", "shape", zones.alias("z"))
    ring = geo.rectangle(F.col("z.west"), F.col("z.south"), F.col("z.east"), F.col("z.north"))[0][0]
    size = lambda shape: F.aggregate(shape, F.lit(0.0), lambda t, p: t + F.abs(overlay.signed_area(p[0])))
    return met.select("area", "z.zone", size(overlay.inside(F.col("shape"), ring)).alias("size"), F.round(size(overlay.outside(F.col("shape"), ring)), 6).alias("rest")).where("size > 1e-9").withColumn("size", F.round("size", 6))


def _turn(k: int) -> str:
    """One turn of the inverse geodesic in SQL."""
    return f"""
a{k} AS (SELECT *, sqrt(pow(cu2 * sin(l), 2) + pow(cu1 * su2 - su1 * cu2 * cos(l), 2)) AS sa, su1 * su2 + cu1 * cu2 * cos(l) AS ca FROM t{k}),
b{k} AS (SELECT *, atan2(sa, ca) AS arc, cu1 * cu2 * sin(l) / sa AS sina, 1 - pow(cu1 * cu2 * sin(l) / sa, 2) AS c2 FROM a{k}),
d{k} AS (SELECT *, ca - 2 * su1 * su2 / c2 AS mid, f / 16 * c2 * (4 + f * (4 - 3 * c2)) AS c FROM b{k}),
t{k + 1} AS (SELECT id, f, apart, su1, cu1, su2, cu2, apart + (1 - c) * f * sina * (arc + c * sa * (mid + c * ca * (-1 + 2 * mid * mid))) AS l FROM d{k}),"""


_TURNS = 12
_GEODESIC = (
    f"WITH {i.POINTS}, r AS (SELECT id, 1 / 298.257223563 AS f, radians(x + 121.00005) AS apart, atan((1 - 1 / 298.257223563) * tan(radians(38.00005))) AS u1, atan((1 - 1 / 298.257223563) * tan(radians(y))) AS u2 FROM points),"
    + " t0 AS (SELECT id, f, apart, sin(u1) AS su1, cos(u1) AS cu1, sin(u2) AS su2, cos(u2) AS cu2, apart AS l FROM r),"
    + "".join(map(_turn, range(_TURNS)))
    + f"""
g AS (SELECT *, c2 * (1 / pow(1 - f, 2) - 1) AS u FROM d{_TURNS - 1}),
h AS (SELECT *, 1 + u / 16384 * (4096 + u * (-768 + u * (320 - 175 * u))) AS big, u / 1024 * (256 + u * (-128 + u * (74 - 47 * u))) AS small FROM g)
SELECT id, round(6378137.0 * (1 - f) * big * (arc - small * sa * (mid + small / 4 * (ca * (-1 + 2 * mid * mid) - small / 6 * mid * (-3 + 4 * sa * sa) * (-3 + 4 * mid * mid)))), 3) AS metres FROM h"""
)


@query("g4_spheroid_distance", _GEODESIC)
def spheroid_distance(s, d):
    """Metres on the spheroid from a centre to every place."""
    return i.points(s, d).select("id", F.round(spheroid.metres(F.lit(38.00005), F.lit(-121.00005), F.col("y"), F.col("x")), 3).alias("metres"))
