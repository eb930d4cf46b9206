"""Joins of points with shapes and with each other.

Pairs are found by cells of a grid, which is an equi-join that spreads with the data, and then tested exactly; nothing is
joined with everything."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from almanac.functions import geo, names, spheroid
from almanac.session import cut

SNAP, WIDE, GAP, RECOGNISABLE = 100.0, 1609.0, 500.0, 1


def cell(v: Column, size: float) -> Column:
    return F.floor(v / size).cast("long")


#: Most cells along a side of a shape's covering; larger shapes have larger cells.
ALONG = 16


def with_cells(shapes: DataFrame, size: float, margin: float) -> DataFrame:
    """``shapes`` (shape and any others) with ``box``, once for every cell (level, cx, cy) that its box, widened by ``margin`` degrees,
    touches. Cells of a level are twice as wide as those of the one below (``size`` at level 0), and a shape's level is the first
    at which it has at most some ``ALONG`` cells along a side, so any shape has a few hundred rows at most. ``inner`` tells that a
    cell lies wholly inside the shape: no edge meets it and its centre is inside."""
    b = shapes.withColumn("box", geo.box(F.col("shape")))
    wide = F.greatest(F.col("box.east") - F.col("box.west"), F.col("box.north") - F.col("box.south")) + 2 * margin
    own = b.withColumn("level", F.greatest(F.lit(0), F.ceil(F.log2(wide / (ALONG * size)))).cast("int")).withColumn("width", size * F.pow(F.lit(2.0), F.col("level")))
    span = lambda lo, hi: F.sequence(F.floor((F.col(f"box.{lo}") - margin) / F.col("width")).cast("long"), F.floor((F.col(f"box.{hi}") + margin) / F.col("width")).cast("long"))
    cells = own.withColumn("cx", F.explode(span("west", "east"))).withColumn("cy", F.explode(span("south", "north")))
    west, south = F.col("cx") * F.col("width"), F.col("cy") * F.col("width")
    past = lambda e, c, lo: (F.greatest(e["a"][c], e["b"][c]) < lo) | (F.least(e["a"][c], e["b"][c]) > lo + F.col("width"))
    side = lambda e, x, y: (e["b"]["x"] - e["a"]["x"]) * (y - e["a"]["y"]) - (e["b"]["y"] - e["a"]["y"]) * (x - e["a"]["x"])
    corners = lambda e: [side(e, x, y) for x in (west, west + F.col("width")) for y in (south, south + F.col("width"))]
    apart = lambda e: (F.least(*corners(e)) > 0) | (F.greatest(*corners(e)) < 0)
    free = F.forall(F.flatten(F.transform(F.flatten("shape"), geo.edges)), lambda e: past(e, "x", west) | past(e, "y", south) | apart(e))
    return cells.withColumn("inner", free & geo.in_shape(west + F.col("width") / 2, south + F.col("width") / 2, F.col("shape"))).drop("width")


def on_levels(points: DataFrame, cells: DataFrame, size: float) -> DataFrame:
    """``points`` (x, y and others) with their cell (level, cx, cy) on every level that ``cells`` has, some twenty at most."""
    used = sorted(r.level for r in cells.select("level").distinct().collect())
    at = lambda c, k: cell(F.col(c), size * 2.0**k)
    keys = F.array(*[F.struct(F.lit(k).alias("level"), at("x", k).alias("cx"), at("y", k).alias("cy")) for k in used]) if used else F.array().cast("array<struct<level:int,cx:bigint,cy:bigint>>")
    return points.withColumn("of", F.explode(keys)).select(*[F.col(f"`{c}`") for c in points.columns], "of.level", "of.cx", "of.cy")


def near_shapes(points: DataFrame, shapes: DataFrame, metres: float, size: float = 0.05, same: tuple[str, ...] = (), on_spheroid: bool = False) -> DataFrame:
    """Every pair of a point (x, y and others) and a shape (shape and others) at most ``metres`` apart, with ``distance`` (0
    inside and on an edge). Columns of ``same`` must be equal and are kept once. First the cells, then the box, then, but in a shape's inner cells,
    the exact distance: on a local
    plane, or ``on_spheroid`` along geodesics, whose metres differ from the plane's by up to six in a thousand. The box is widened
    by twice the distance, which holds up to 60 degrees of latitude."""
    margin = 2 * metres / geo.METRES_PER_DEGREE
    cells = cut(with_cells(shapes, size, margin))
    met = on_levels(points, cells, size).join(cells, ["level", "cx", "cy", *same]).where(geo.in_box(F.col("x"), F.col("y"), F.col("box"), margin))
    by = spheroid if on_spheroid else geo
    exact = by.metres_to_shape(F.col("x"), F.col("y"), F.col("shape")) if metres else F.when(geo.in_shape(F.col("x"), F.col("y"), F.col("shape")) | geo.on_edge(F.col("x"), F.col("y"), F.col("shape")), 0.0)
    return met.withColumn("distance", F.when(F.col("inner"), 0.0).otherwise(exact)).where(F.col("distance") <= metres).drop("level", "cx", "cy", "box", "inner")


def best_area(points: DataFrame, areas: DataFrame, metres: float = SNAP, on_spheroid: bool = False) -> DataFrame:
    """(id, area) for points (id, city, x, y) within ``metres`` of an area (area, city, tier, recognisability, shape): no obscure
    fine area if there is another, then the nearest, fine before coarse, best known, smallest, least name."""
    obscure = (F.col("tier") == "fine") & (F.col("recognisability") < RECOGNISABLE)
    order = [obscure, F.col("distance"), F.col("tier") != "fine", F.desc("recognisability"), geo.area(F.col("shape")), F.col("area")]
    found = near_shapes(points, areas, metres, same=("city",), on_spheroid=on_spheroid)
    return found.withColumn("rank", F.row_number().over(W.partitionBy("id").orderBy(*order))).where("rank = 1").select("id", "area")


def clear_area(points: DataFrame, areas: DataFrame, metres: float = WIDE, on_spheroid: bool = False) -> DataFrame:
    """(id, area): the nearest area, if no second comes close: none in reach, twice as far, or ``GAP`` metres farther."""
    by = W.partitionBy("id").orderBy("distance", "area")
    ranked = near_shapes(points, areas, metres, same=("city",), on_spheroid=on_spheroid).withColumn("rank", F.row_number().over(by)).withColumn("second", F.lead("distance").over(by)).where("rank = 1")
    return ranked.where("second is null or second >= 2 * distance or second - distance >= %f" % GAP).select("id", "area")


def assign(points: DataFrame, areas: DataFrame, on_spheroid: bool = False) -> DataFrame:
    """(id, area, stage) for every point: by the tight rule, else by the clear one, else null; distances on a plane or the spheroid."""
    tight = best_area(points, areas, on_spheroid=on_spheroid).withColumnRenamed("area", "snap")
    rest = points.join(tight, "id", "left_anti")
    wide = clear_area(rest, areas, on_spheroid=on_spheroid).withColumnRenamed("area", "fill")
    return points.join(tight, "id", "left").join(wide, "id", "left").select("id", F.coalesce("snap", "fill").alias("area"), F.when(F.col("snap").isNotNull(), "snap").when(F.col("fill").isNotNull(), "wide").alias("stage"))


def without_near_match(left: DataFrame, right: DataFrame, match: float = 150.0, located: float = 50.0) -> DataFrame:
    """Rows of ``left`` (lat, lng, name) without a row of ``right`` within ``located`` metres, or within ``match`` by a matching
    name: an equi-join on the point's cell and its neighbours, then an anti-join."""
    size = 2 * match / geo.METRES_PER_DEGREE
    around = F.expr("inline(flatten(transform(sequence(-1, 1), i -> transform(sequence(-1, 1), j -> struct(i, j)))))").alias("dx", "dy")

    def column(lng: Column, row: Column, step: Column | int = 0) -> Column:
        """A row of cells goes round the world; it has fewer, wider cells toward the poles, each as wide as the reach at least."""
        edge = F.least(F.lit(90.0), F.greatest(F.abs(row * size), F.abs((row + 1) * size)))
        n = F.greatest(F.lit(1), F.floor(360 * F.cos(F.radians(edge)) / size))
        return F.pmod(F.floor((lng + 180) * n / 360) + step, n).cast("long")

    spread = right.select(F.col("lat").alias("rlat"), F.col("lng").alias("rlng"), F.col("name").alias("rname"), around).withColumn("cy", cell(F.col("rlat"), size) + F.col("dy")).withColumn("cx", column(F.col("rlng"), F.col("cy"), F.col("dx"))).drop("dx", "dy")
    placed = left.withColumn("cy", cell(F.col("lat"), size)).withColumn("cx", column(F.col("lng"), F.col("cy")))
    metres = geo.metres(F.col("l.lat"), F.col("l.lng"), F.col("r.rlat"), F.col("r.rlng"))
    same = (F.col("l.cx") == F.col("r.cx")) & (F.col("l.cy") == F.col("r.cy")) & ((metres <= located) | (metres <= match) & names.names_match(F.col("l.name"), F.col("r.rname")))
    return placed.alias("l").join(spread.alias("r"), same, "left_anti").drop("cx", "cy")


def near_any(points: DataFrame, others: DataFrame, metres: float) -> DataFrame:
    """``points`` (id, lat, lng and others) with ``near``: whether any of ``others`` (lat, lng) is within ``metres``."""
    far = without_near_match(points.withColumn("name", F.lit("")), others.withColumn("name", F.lit("")), metres, metres).select("id").withColumn("far", F.lit(True))
    return points.join(far, "id", "left").withColumn("near", F.col("far").isNull()).drop("far")


def quadtree(tile: DataFrame, points: DataFrame, most: int, depth: int) -> DataFrame:
    """(x0, y0, size, n) of square tiles over ``points`` (x, y), each split in four while it holds ``most`` or more points, at
    most ``depth`` times. All levels are counted in one grouping: a point is in one tile of each level."""
    levels = points.join(tile, (F.col("x") >= F.col("x0")) & (F.col("x") < F.col("x0") + F.col("size")) & (F.col("y") >= F.col("y0")) & (F.col("y") < F.col("y0") + F.col("size"))).withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(depth))))
    step = F.col("size") / F.pow(F.lit(2.0), F.col("level"))
    at = lambda v, o: F.floor((F.col(v) - F.col(o)) / step).cast("long")
    counted = levels.withColumn("i", at("x", "x0")).withColumn("j", at("y", "y0")).groupBy("x0", "y0", "size", "level", "i", "j").agg(F.count(F.lit(1)).alias("n"))
    up = counted.alias("p").where(f"n >= {most}").select((F.col("level") + 1).alias("level"), F.col("i").alias("pi"), F.col("j").alias("pj"), "x0", "y0", "size", F.lit(True).alias("full"))
    own = counted.withColumn("pi", F.floor(F.col("i") / 2)).withColumn("pj", F.floor(F.col("j") / 2))
    kept = own.join(up, ["x0", "y0", "size", "level", "pi", "pj"], "left").where("(level = 0 or full) and (n < %d or level = %d)" % (most, depth))
    return kept.select((F.col("x0") + F.col("i") * F.col("size") / F.pow(F.lit(2.0), F.col("level"))).alias("x0"), (F.col("y0") + F.col("j") * F.col("size") / F.pow(F.lit(2.0), F.col("level"))).alias("y0"), (F.col("size") / F.pow(F.lit(2.0), F.col("level"))).alias("size"), "n")


def near_keys(keys: DataFrame, by: list[str], key: str = "key", least: int = 6) -> DataFrame:
    """(by..., a, b) of every two different keys of a group (rows of ``keys`` with equal ``by``) at most one edit apart, both of ``least``
    letters or more, a before b: keys that are so near share the key itself or one of the two without one letter, so an
    equi-join on the hashes of these finds them. Null keys are near to none. There are far more forms than keys, which Spark's
    estimates don't know, so the join is told to shuffle."""
    own = keys.where(F.length(key) >= least).select(*by, F.col(key).alias("a")).distinct()
    without = F.transform(F.sequence(F.lit(1), F.length("a")), lambda i: F.concat(F.substring("a", F.lit(1), i - 1), F.substring("a", i + 1, F.length("a"))))
    forms = own.select(*by, "a", F.explode(F.transform(F.array_distinct(F.concat(F.array("a"), without)), lambda f: F.xxhash64(f))).alias("form"))
    met = forms.alias("l").join(forms.withColumnRenamed("a", "b").alias("r").hint("merge"), [*by, "form"]).where("a < b")
    return met.where(F.levenshtein("a", "b") <= 1).select(*by, "a", "b").distinct()


def clusters(keys: DataFrame) -> DataFrame:
    """(city, key, host): keys of areas (city, key, venues) folded greedily, larger first, into the first accepted key that is
    one edit away, both of six letters or more; else a key is its own host. A key occurs once in a city.

    The order decides, so it goes in rounds over all cities at once: a key without an earlier undecided neighbour is accepted,
    later neighbours of accepted keys are not. Only keys with a neighbour take part; chains of neighbours are short."""
    rank = F.struct((-F.col("venues")).alias("v"), F.col("key").alias("k"))
    ranked = keys.select("city", "key", rank.alias("rank"))
    pairs = near_keys(keys, ["city"])
    of = lambda side: ranked.select("city", F.col("key").alias(side), F.col("rank").alias(f"{side}_rank"))
    told = pairs.join(of("a"), ["city", "a"]).join(of("b"), ["city", "b"])
    first = F.col("a_rank") < F.col("b_rank")
    edges = cut(told.select("city", F.when(first, F.struct(F.col("a_rank").alias("rank"), F.col("a").alias("key"))).otherwise(F.struct(F.col("b_rank").alias("rank"), F.col("b").alias("key"))).alias("early"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("key")))
    open_ = cut(edges.select("city", F.col("early.key").alias("key")).unionByName(edges.select("city", "key")).distinct())
    accepted = None
    while not open_.isEmpty():
        waits = edges.withColumn("e", F.col("early.key")).join(open_.withColumnRenamed("key", "e"), ["city", "e"], "left_semi").select("city", "key").distinct()
        new = cut(open_.join(waits, ["city", "key"], "left_anti"))
        lost = edges.withColumn("e", F.col("early.key")).join(new.withColumnRenamed("key", "e"), ["city", "e"], "left_semi").select("city", "key")
        open_ = cut(open_.join(new.unionByName(lost).distinct(), ["city", "key"], "left_anti"))
        accepted = new if accepted is None else accepted.unionByName(new)
    if accepted is None:
        return keys.select("city", "key", F.col("key").alias("host"))
    taken = edges.withColumn("e", F.col("early.key")).join(accepted.withColumnRenamed("key", "e"), ["city", "e"], "left_semi")
    hosts = taken.groupBy("city", "key").agg(F.min("early")["key"].alias("host"))
    return keys.select("city", "key").join(hosts, ["city", "key"], "left").select("city", "key", F.coalesce("host", "key").alias("host"))
