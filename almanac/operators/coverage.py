"""Unions of shapes that touch: their shared edges cancel, and what is left is chained to rings.

Points are snapped to a grid of integers, so lines and crossings are exact. Every edge lies on a line and covers a stretch of it,
forward or backward; a running sum along the line tells where the stretches of two neighbours cancel, also where an edge ends
in the middle of another. What is left is linked, edge to edge, and rings get their name and their order by pointer doubling:
some log2 of the longest ring's edges rounds of joins, whatever its length. Nothing but a ring's own points is ever gathered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from almanac.functions import geo, overlay
from almanac.operators import spatial
from almanac.session import cut

#: Degrees of the grid: about a centimetre.
GRID = 1e-7


def _gcd(a: Column, b: Column) -> Column:
    step = lambda s, _: F.when(s["b"] == 0, s).otherwise(F.struct(s["b"].alias("a"), F.pmod(s["a"], s["b"]).alias("b")))
    return F.aggregate(F.sequence(F.lit(1), F.lit(52)), F.struct(F.abs(a).alias("a"), F.abs(b).alias("b")), step, lambda s: s["a"])


def snapped_edges(shapes: DataFrame, by: list[str], grid: float = GRID) -> DataFrame:
    """by..., x1, y1, x2, y2 (longs) of every edge of ``shapes`` (shape and ``by``), with the inside on its left: outer rings counter-
    clockwise, holes clockwise. Edges that the grid shrinks to a point are none."""
    rings = shapes.select(*by, F.explode("shape").alias("polygon")).select(*by, F.posexplode("polygon").alias("i", "ring"))
    whole = lambda c: F.round(c / grid).cast("long")
    fixed = rings.withColumn("ring", F.transform("ring", lambda p: F.struct(whole(p["x"]).alias("x"), whole(p["y"]).alias("y"))))
    # the sign of the area, about the first point in doubles
    o = F.col("ring")[0]
    area = F.aggregate(geo.edges(F.col("ring")), F.lit(0.0), lambda s, e: s + (e["a"]["x"] - o["x"]).cast("double") * (e["b"]["y"] - o["y"]) - (e["b"]["x"] - o["x"]).cast("double") * (e["a"]["y"] - o["y"]))
    along = F.when((area >= 0) == (F.col("i") == 0), F.col("ring")).otherwise(F.reverse("ring"))
    return fixed.withColumn("ring", along).select(*by, F.explode(geo.edges(F.col("ring"))).alias("e")).select(*by, F.col("e.a.x").alias("x1"), F.col("e.a.y").alias("y1"), F.col("e.b.x").alias("x2"), F.col("e.b.y").alias("y2")).where("x1 <> x2 or y1 <> y2")


def boundary(edges: DataFrame, by: list[str]) -> DataFrame:
    """The edges (by..., x1, y1, x2, y2) that remain when stretches in opposite directions cancel; neighbours on a line are joined. Where
    shapes overlap, stretches of one direction add up and count once."""
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    told = edges.withColumn("g", _gcd(dx, dy)).withColumn("ux", F.expr("(x2 - x1) div g")).withColumn("uy", F.expr("(y2 - y1) div g"))
    back = (F.col("ux") < 0) | (F.col("ux") == 0) & (F.col("uy") < 0)
    line = told.withColumn("way", F.when(back, -1).otherwise(1)).withColumn("ux", F.col("ux") * F.col("way")).withColumn("uy", F.col("uy") * F.col("way")).withColumn("off", F.col("ux") * F.col("y1") - F.col("uy") * F.col("x1"))
    # an edge covers its line from its lesser end on, so both ends change what is covered
    ends = F.array(F.struct(F.col("x1").alias("x"), F.col("y1").alias("y"), F.lit(1).alias("change")), F.struct(F.col("x2").alias("x"), F.col("y2").alias("y"), F.lit(-1).alias("change")))
    keys = [*by, "ux", "uy", "off"]
    changes = line.select(*keys, F.inline(ends)).groupBy(*keys, "x", "y").agg(F.sum("change").alias("change")).where("change <> 0")
    order = W.partitionBy(*keys).orderBy("x", "y")
    cover = changes.withColumn("cover", F.sum("change").over(order.rowsBetween(W.unboundedPreceding, 0))).withColumn("nx", F.lead("x").over(order)).withColumn("ny", F.lead("y").over(order)).where("cover <> 0")
    ahead = F.col("cover") > 0
    pick = lambda a, b: F.when(ahead, F.col(a)).otherwise(F.col(b))
    return cover.select(*by, pick("x", "nx").alias("x1"), pick("y", "ny").alias("y1"), pick("nx", "x").alias("x2"), pick("ny", "y").alias("y2"))


def linked(edges: DataFrame, by: list[str]) -> DataFrame:
    """``edges`` with the edge that follows each as a struct ``next``: of those that begin where it ends, the one that turns most to the
    left, so that parts that touch in a point are rings of their own. An edge's struct ``e`` names it."""
    point = F.struct("x1", "y1", "x2", "y2")
    own = edges.select(*by, point.alias("e"), F.col("x2").alias("x"), F.col("y2").alias("y"))
    on = edges.select(*by, point.alias("n"), F.col("x1").alias("x"), F.col("y1").alias("y"))
    d = lambda c, a: (F.col(f"{c}.{a}2") - F.col(f"{c}.{a}1")).cast("double")
    turn = F.atan2(d("e", "x") * d("n", "y") - d("e", "y") * d("n", "x"), d("e", "x") * d("n", "x") + d("e", "y") * d("n", "y"))
    return own.join(on, [*by, "x", "y"]).groupBy(*by, "e").agg(F.max_by("n", turn).alias("next"))


def rings(edges: DataFrame, by: list[str]) -> DataFrame:
    """(by..., ring, place, x, y): the points of every ring of ``edges`` in order; ``ring`` is the struct of its least edge."""
    keys = [*by, "e"]
    state = cut(linked(edges, by).withColumn("head", F.least("e", "next")).withColumn("jump", F.col("next")))
    while True:  # every round looks twice as far; once no edge sees a lesser one, all see their ring's least
        far = state.select(*by, F.col("e").alias("jump"), F.col("head").alias("far_head"), F.col("jump").alias("far"))
        wider = state.join(far, [*by, "jump"]).select(*keys, "next", F.least("head", "far_head").alias("head"), F.col("far").alias("jump"), (F.col("far_head") < F.col("head")).alias("new"))
        state = cut(wider)
        if state.where("new").isEmpty():
            break
    rank = cut(state.select(*keys, "head", F.when(F.col("e") == F.col("head"), F.col("e")).otherwise(F.col("next")).alias("jump"), F.when(F.col("e") == F.col("head"), 0).otherwise(1).cast("long").alias("left")))
    while not rank.where("jump <> head").isEmpty():
        far = rank.select(*by, F.col("e").alias("jump"), F.col("jump").alias("far"), F.col("left").alias("more"))
        rank = cut(rank.join(far, [*by, "jump"]).select(*keys, "head", F.col("far").alias("jump"), (F.col("left") + F.col("more")).alias("left")))
    return rank.select(*by, F.col("head").alias("ring"), (-F.col("left")).alias("place"), F.col("e.x1").alias("x"), F.col("e.y1").alias("y"), (F.col("e") == F.col("head")).alias("first"))


def dissolved(shapes: DataFrame, by: list[str], grid: float = GRID) -> DataFrame:
    """(by..., shape): the union of the shapes of every group, polygons with their holes, of ``shapes`` (shape array of polygons, and
    ``by``; null keys are groups too, other columns are ignored). Shapes of a group may touch, along edges of any length, but
    their insides must not overlap. Null and empty shapes add nothing; a group of nothing else has no row. A shape alone is
    repaired: spikes, repeated points and edges that it runs over twice go, and a ring that touches itself falls apart. Holes
    that touch in one point stay one ring. Rings start at their least edge, so the result does not depend on the order."""
    grouped = shapes.select(F.struct(*by).alias("group"), "shape")  # a struct is never null, so groups of null keys are joined too
    found = cut(boundary(snapped_edges(grouped, ["group"], grid), ["group"]))
    order = F.when(F.col("first"), F.lit(-(1 << 62)).cast("long")).otherwise(F.col("place"))
    point = F.struct((F.col("x") * grid).alias("x"), (F.col("y") * grid).alias("y"))
    ring = rings(found, ["group"]).groupBy("group", "ring").agg(F.array_sort(F.collect_list(F.struct(order.alias("o"), point.alias("p")))).alias("points")).select("group", "ring", F.transform("points", lambda p: p["p"]).alias("points"))
    ring = cut(ring.withColumn("size", overlay.signed_area(F.col("points"))))
    outer = ring.where("size > 0").select("group", "ring", F.array(F.array("points")).alias("shape"), "size")
    mid = F.struct(((F.col("points")[0]["x"] + F.col("points")[1]["x"]) / 2).alias("x"), ((F.col("points")[0]["y"] + F.col("points")[1]["y"]) / 2).alias("y"))
    hole = ring.where("size < 0").select("group", F.col("ring").alias("hole"), "points", mid.alias("m")).select("group", "hole", "points", "m.x", "m.y")
    inside = spatial.near_shapes(hole, outer, 0.0, same=("group",)).where(geo.in_shape(F.col("x"), F.col("y"), F.col("shape"))).groupBy("group", "hole").agg(F.min_by(F.struct("ring", "points"), "size").alias("b"))
    holes = inside.groupBy("group", F.col("b.ring").alias("ring")).agg(F.sort_array(F.collect_list("b.points")).alias("holes"))
    polygons = outer.join(holes, ["group", "ring"], "left").withColumn("polygon", F.concat(F.col("shape")[0], F.coalesce("holes", F.array().cast(f"array<{geo.RING}>"))))
    whole = polygons.groupBy("group").agg(F.array_sort(F.collect_list("polygon")).alias("shape"))
    return whole.select(*[F.col(f"group.{c}").alias(c) for c in by], "shape")

