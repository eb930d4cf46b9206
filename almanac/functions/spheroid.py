"""Distances on the WGS 84 spheroid, as native expressions.

The inverse geodesic is iterated a fixed number of times in one fold, so its plan is small; for cities it settles after a few.
The edges of a shape are taken as great circles of their points' normals, which from a geodesic of 100 km differ by less than a
centimetre. The nearest point of an edge is found by halving thirds on the straight distance through the earth, which grows
with the distance on it, and then measured once."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from almanac.functions import geo

#: Fixed values of WGS 84: the equator's radius and the flattening.
RADIUS, FLATTENING = 6378137.0, 1 / 298.257223563
POLAR = RADIUS * (1 - FLATTENING)
TURNS, THIRDS = 24, 48


def _named(**values: Column) -> Column:
    return F.struct(*[v.alias(k) for k, v in values.items()])


def metres(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Metres along the geodesic; null if a coordinate is null, or if the points are so nearly antipodal that the iteration does
    not settle (over some 19,900 km)."""
    reduced = lambda lat: F.atan((1 - FLATTENING) * F.tan(F.radians(lat)))
    apart = F.radians(lng2 - lng1)
    apart = F.atan2(F.sin(apart), F.cos(apart))
    start = _named(l=apart, was=F.lit(9.0), su1=F.sin(reduced(lat1)), cu1=F.cos(reduced(lat1)), su2=F.sin(reduced(lat2)), cu2=F.cos(reduced(lat2)), apart=apart, arc=F.lit(0.0), sa=F.lit(0.0), ca=F.lit(1.0), c2=F.lit(1.0), mid=F.lit(0.0))

    def turn(s: Column, _: Column) -> Column:
        sl, cl = F.sin(s["l"]), F.cos(s["l"])
        sin_arc = F.sqrt(F.pow(s["cu2"] * sl, 2) + F.pow(s["cu1"] * s["su2"] - s["su1"] * s["cu2"] * cl, 2))
        cos_arc = s["su1"] * s["su2"] + s["cu1"] * s["cu2"] * cl
        sin_a = F.coalesce(s["cu1"] * s["cu2"] * sl / F.nullif(sin_arc, F.lit(0.0)), F.lit(0.0))
        return geo.bound(_named(sin_arc=sin_arc, cos_arc=cos_arc, sin_a=sin_a, cos2=1 - sin_a * sin_a), lambda v: _next(s, v))

    def _next(s: Column, v: Column) -> Column:
        arc = F.atan2(v["sin_arc"], v["cos_arc"])
        mid = F.coalesce(v["cos_arc"] - 2 * s["su1"] * s["su2"] / F.nullif(v["cos2"], F.lit(0.0)), F.lit(0.0))
        c = FLATTENING / 16 * v["cos2"] * (4 + FLATTENING * (4 - 3 * v["cos2"]))
        new = s["apart"] + (1 - c) * FLATTENING * v["sin_a"] * (arc + c * v["sin_arc"] * (mid + c * v["cos_arc"] * (-1 + 2 * mid * mid)))
        return _named(l=new, was=s["l"], su1=s["su1"], cu1=s["cu1"], su2=s["su2"], cu2=s["cu2"], apart=s["apart"], arc=arc, sa=v["sin_arc"], ca=v["cos_arc"], c2=v["cos2"], mid=mid)

    def length(s: Column) -> Column:
        u = s["c2"] * (RADIUS**2 - POLAR**2) / POLAR**2
        big = 1 + u / 16384 * (4096 + u * (-768 + u * (320 - 175 * u)))
        small = u / 1024 * (256 + u * (-128 + u * (74 - 47 * u)))
        m = s["mid"]
        more = small * s["sa"] * (m + small / 4 * (s["ca"] * (-1 + 2 * m * m) - small / 6 * m * (-3 + 4 * s["sa"] * s["sa"]) * (-3 + 4 * m * m)))
        return F.when(F.abs(s["l"] - s["was"]) < 1e-10, POLAR * big * (s["arc"] - more))

    told = lat1.isNotNull() & lng1.isNotNull() & lat2.isNotNull() & lng2.isNotNull()
    return F.when(told, F.aggregate(F.sequence(F.lit(1), F.lit(TURNS)), start, turn, length))


def _normal(lng: Column, lat: Column) -> Column:
    x, y = F.radians(lng), F.radians(lat)
    return _named(x=F.cos(y) * F.cos(x), y=F.cos(y) * F.sin(x), z=F.sin(y))


def _placed(n: Column) -> Column:
    """Where the surface has the direction ``n`` (of any length) as its normal."""
    size = F.sqrt(n["x"] * n["x"] + n["y"] * n["y"] + n["z"] * n["z"])
    e2 = FLATTENING * (2 - FLATTENING)
    sin = n["z"] / size
    r = RADIUS / F.sqrt(1 - e2 * sin * sin)
    return _named(x=r * n["x"] / size, y=r * n["y"] / size, z=r * (1 - e2) * sin)


def _between(a: Column, b: Column, t: Column) -> Column:
    return _named(x=a["x"] + (b["x"] - a["x"]) * t, y=a["y"] + (b["y"] - a["y"]) * t, z=a["z"] + (b["z"] - a["z"]) * t)


def _apart(p: Column, q: Column) -> Column:
    return F.sqrt(F.pow(p["x"] - q["x"], 2) + F.pow(p["y"] - q["y"], 2) + F.pow(p["z"] - q["z"], 2))


def _foot(p: Column, a: Column, b: Column) -> Column:
    """struct<chord, n>: the straight distance of the place ``p`` to the nearest point between the normals ``a`` and ``b``, and its normal."""

    def found(v: Column) -> Column:
        far = lambda t: _apart(v["p"], geo.bound(_between(v["a"], v["b"], t), _placed))
        third = lambda s, i: s["lo"] + (s["hi"] - s["lo"]) * i / 3
        step = lambda s, _: F.when(far(third(s, 1)) <= far(third(s, 2)), _named(lo=s["lo"], hi=third(s, 2))).otherwise(_named(lo=third(s, 1), hi=s["hi"]))
        at = F.aggregate(F.sequence(F.lit(1), F.lit(THIRDS)), _named(lo=F.lit(0.0), hi=F.lit(1.0)), step, lambda s: (s["lo"] + s["hi"]) / 2)
        best = F.array_min(F.transform(F.array(F.lit(0.0), at, F.lit(1.0)), lambda t: _named(chord=far(t), t=t)))
        return geo.bound(best, lambda s: _named(chord=s["chord"], n=_between(v["a"], v["b"], s["t"])))

    return geo.bound(_named(p=p, a=a, b=b), found)


def metres_to_shape(x: Column, y: Column, shape: Column) -> Column:
    """0 inside, else metres along the geodesic to the nearest point of the edges. Null without a shape or a point, or for a shape
    without edges. Edges are shorter than a quarter of the earth."""
    edges = F.flatten(F.transform(F.flatten(shape), geo.edges))
    nearest = geo.bound(geo.bound(_normal(x, y), _placed), lambda p: F.array_min(F.transform(edges, lambda e: _foot(p, _normal(e["a"]["x"], e["a"]["y"]), _normal(e["b"]["x"], e["b"]["y"])))))
    lat = lambda n: F.degrees(F.atan2(n["z"], F.sqrt(n["x"] * n["x"] + n["y"] * n["y"])))
    lng = lambda n: F.degrees(F.atan2(n["y"], n["x"]))
    told = geo.bound(nearest, lambda s: metres(y, x, lat(s["n"]), lng(s["n"])))
    return F.when(geo.in_shape(x, y, shape), 0.0).otherwise(told)
