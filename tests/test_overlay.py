import math
import random

import pytest
from pyspark.sql import functions as F

from almanac.functions import geo, overlay, spheroid
from almanac.operators import coverage

SHAPE = geo.SHAPE


def box(w, s, e, n, turn=False):
    ring = [(w, s), (e, s), (e, n), (w, n)]
    return [(float(x), float(y)) for x, y in (ring[::-1] if turn else ring)]


def area(shape):
    one = lambda r: abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(r, r[1:] + r[:1]))) / 2
    return sum(one(p[0]) - sum(map(one, p[1:])) for p in shape)


def plain(shape):
    return [[[(round(p.x, 6), round(p.y, 6)) for p in r] for r in polygon] for polygon in shape]


def dissolve(spark, rows, by="g long"):
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], f"{by}, shape {SHAPE}, ring int, place int")
    return {r[0]: plain(r.shape) for r in coverage.dissolved(df, [by.split()[0]]).collect()}


def test_touching_squares(spark):
    rows = [(1, [[box(0, 0, 1, 1)]]), (1, [[box(1, 0, 2, 1, True)]]), (1, [[box(0, 1, 2, 2)]]), (2, [[box(0, 0, 1, 1)]]), (2, [[box(1, 1, 2, 2)]]), (None, [[box(5, 5, 6, 6)]]), (None, [[box(6, 5, 7, 6)]]), (3, None), (4, []), (4, [[]])]
    got = dissolve(spark, rows)
    assert set(got) == {1, 2, None}
    assert got[1] == [[[(0, 0), (2, 0), (2, 2), (0, 2)]]]  # the corner of two in the middle of the third's edge goes too
    assert [len(p[0]) for p in got[2]] == [4, 4] and area(got[None]) == 2 and len(got[None]) == 1


def test_holes_islands_and_repairs(spark):
    ring = [(1, [[box(x, y, x + 1, y + 1)]]) for x in range(5) for y in range(5) if (x, y) != (2, 2) and not (x in (1, 3) and y == 3)]
    island = [(2, [[box(0, 0, 9, 9), box(2, 2, 7, 7)]]), (2, [[box(3, 3, 5, 5)]])]
    filled = [(3, [[box(0, 0, 9, 9), box(2, 2, 7, 7)]]), (3, [[box(2, 2, 7, 7)]])]
    eight = [(4, [[[(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (2.0, 1.0), (2.0, 2.0), (1.0, 2.0), (1.0, 1.0), (0.0, 1.0)]]])]
    spike = [(5, [[[(0.0, 0.0), (4.0, 0.0), (9.0, 0.0), (4.0, 0.0), (4.0, 4.0), (4.0, 4.0), (0.0, 4.0)]]])]
    got = dissolve(spark, ring + island + filled + eight + spike)
    assert area(got[1]) == 22 and len(got[1]) == 1 and got[1][0][0] == [(0, 0), (5, 0), (5, 5), (0, 5)]
    assert sorted(map(len, got[2])) == [1, 2] and area(got[2]) == 81 - 25 + 4
    assert got[3] == [[box(0, 0, 9, 9)]]
    assert len(got[4]) == 2 and area(got[4]) == 2
    assert got[5] == [[[(0, 0), (4, 0), (4, 4), (0, 4)]]]


def test_random_cells_against_counting(spark):
    rng, rows, want = random.Random(3), [], {}
    for g in range(12):
        cells = {(x, y) for x in range(7) for y in range(7) if rng.random() < 0.6}
        shear = lambda x, y: (x * 0.37 + y * 0.11, y * 0.29 - x * 0.05)
        for x, y in cells:
            corners = [shear(*c) for c in ((x, y), (x + 1, y), (x + 1, y + 1), (x, y + 1))]
            rows.append((g, [[corners if rng.random() < 0.5 else corners[::-1]]]))
        edges = sum((x + dx, y + dy) not in cells for x, y in cells for dx, dy in ((1, 0), (-1, 0), (0, 1), (0, -1)))
        want[g] = (len(cells), edges)
    got = dissolve(spark, rows)
    unit = 0.37 * 0.29 + 0.11 * 0.05
    for g, (n, edges) in want.items():
        assert area(got[g]) == pytest.approx(n * unit, rel=1e-5)
        length = sum(math.dist(a, b) for p in got[g] for r in p for a, b in zip(r, r[1:] + r[:1]))
        sides = [math.dist((0, 0), shear(1, 0)), math.dist((0, 0), shear(0, 1))]
        assert min(sides) * edges - 1e-3 <= length <= max(sides) * edges + 1e-3


def test_a_ring_of_thousands_takes_few_rounds(spark, monkeypatch):
    n, rounds = 200, []
    monkeypatch.setattr(coverage, "cut", lambda df: rounds.append(1) or df.checkpoint(eager=True))
    ring = [(math.cos(2 * math.pi * i / n), math.sin(2 * math.pi * i / n)) for i in range(n)]
    got = dissolve(spark, [(1, [[ring]])])[1][0][0]
    start = min(range(n), key=lambda i: math.dist(got[i], ring[0]))
    assert len(got) == n and max(math.dist(a, b) for a, b in zip(got[start:] + got[:start], ring)) < 1e-5
    assert len(rounds) < 26  # twice log2(n), and a few


def test_no_shapes(spark):
    assert dissolve(spark, []) == {}


def cut_of(spark, shape, convex, f):
    df = spark.createDataFrame([(shape, convex)], f"shape {SHAPE}, convex {geo.RING}")
    return plain(df.select(f(F.col("shape"), F.col("convex")).alias("s")).first().s)


def test_parts_inside_and_outside(spark):
    rng = random.Random(8)
    shape = [[box(0, 0, 10, 10), box(4, 4, 6, 6, True)], [[(12.0, 0.0), (16.0, 0.0), (14.0, 8.0)]]]
    star = [(5 + (6 if i % 2 else 2) * math.cos(i * math.pi / 5), 5 + (6 if i % 2 else 2) * math.sin(i * math.pi / 5)) for i in range(10)]
    for s in (shape, [[star]]):
        for window in (box(3, 3, 13, 7), box(3, 3, 13, 7, True), [(0.0, 0.0), (9.0, 3.0), (5.0, 12.0)], box(-9, -9, 30, 30), box(50, 50, 60, 60)):
            a, b = cut_of(spark, s, window, overlay.inside), cut_of(spark, s, window, overlay.outside)
            assert area(a) + area(b) == pytest.approx(area(s), abs=1e-4)
            hit = n = 0
            for _ in range(4000):
                x, y = rng.uniform(-2, 18), rng.uniform(-2, 13)
                n += 1
                hit += _in(x, y, s) and _in(x, y, [[window]])
            assert area(a) == pytest.approx(hit / n * 300, abs=12)


def _in(x, y, shape):
    def ring(r):
        return sum((a[1] > y) != (b[1] > y) and x < (b[0] - a[0]) * (y - a[1]) / (b[1] - a[1]) + a[0] for a, b in zip(r, r[1:] + r[:1])) % 2

    return any(ring(p[0]) and not any(map(ring, p[1:])) for p in shape)


def test_centres_envelopes_and_the_antimeridian(spark):
    shapes = [[[box(0, 0, 4, 2)]], [[box(0, 0, 4, 4), box(0, 0, 2, 4, True)]], [[box(0, 0, 1, 1)], [box(2, 0, 3, 1)]], [[box(9, 9, 9, 9)]], [], None]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(shapes)], f"i int, shape {SHAPE}")
    got = {r.i: r for r in df.select("i", overlay.centroid(F.col("shape")).alias("c"), overlay.envelope(F.col("shape")).alias("e")).collect()}
    assert [got[i].c and (got[i].c.x, got[i].c.y) for i in range(6)] == [(2, 1), (3, 2), (1.5, 0.5), None, None, None]
    assert plain(got[2].e)[0][0][:4] == box(0, 0, 3, 1) and got[4].e is None and got[5].e is None
    ring = spark.createDataFrame([([(179.0, 0.0), (-179.0, 0.0), (-179.0, 1.0), (179.0, 1.0)],)], f"r {geo.RING}").select(overlay.unwrapped(F.col("r")).alias("r")).first().r
    assert [(p.x, p.y) for p in ring] == [(179, 0), (181, 0), (181, 1), (179, 1)]
    assert area(dissolve(spark, [(1, [[[(p.x, p.y) for p in ring]]]), (1, [[box(181, 0, 182, 1)]])])[1]) == 3


def test_a_circle_cuts_as_a_buffer(spark):
    df = spark.createDataFrame([([[box(0, 0, 1, 1)]],)], f"shape {SHAPE}")
    s = plain(df.select(overlay.inside(F.col("shape"), overlay.circle(F.lit(0.0), F.lit(0.0), F.lit(5000.0), 256)).alias("s")).first().s)
    assert area(s) == pytest.approx(math.pi / 4 * (5000 / geo.METRES_PER_DEGREE) ** 2, rel=1e-3)


# ---- distances on the spheroid: lines of textbooks and surveys (WGS 84)

#: Lat, lng, lat, lng, metres. The quarter meridian; a degree of the equator; a degree of latitude from the equator and from
#: the pole; Vincenty's line, Flinders Peak to Buninyon (on GRS 80, whose flattening differs in the tenth digit).
LINES = [
    (0.0, 0.0, 90.0, 0.0, 10_001_965.729),
    (0.0, 10.0, 0.0, 11.0, 111_319.491),
    (0.0, 5.0, 1.0, 5.0, 110_574.389),
    (89.0, 5.0, 90.0, 5.0, 111_693.865),
    (-37.95103341666667, 144.42486788888888, -37.652821138888886, 143.92649552777777, 54_972.271),
]


def test_lines_of_known_length(spark):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(LINES)], "i int, a double, b double, c double, d double, m double")
    for r in df.withColumn("got", spheroid.metres(*map(F.col, "abcd"))).withColumn("back", spheroid.metres(*map(F.col, "cdab"))).collect():
        assert r.got == pytest.approx(r.m, abs=1e-3) and r.back == pytest.approx(r.got, abs=1e-6), r


def test_odd_points(spark):
    rows = [(1.0, 2.0, 1.0, 2.0), (0.0, 179.9, 0.0, -179.9), (0.0, 0.0, 0.1, 179.95), (None, 0.0, 1.0, 1.0), (90.0, 0.0, 90.0, 77.0)]
    got = [r.m for r in spark.createDataFrame(rows, "a double, b double, c double, d double").select(spheroid.metres(*map(F.col, "abcd")).alias("m")).collect()]
    assert got[0] == 0 and got[1] == pytest.approx(0.2 * 111_319.491, abs=0.01) and got[2] is None and got[3] is None and got[4] == pytest.approx(0, abs=1e-6)


def test_distance_to_shapes_against_many_points_of_the_edge(spark):
    rng, rows = random.Random(2), []
    for i in range(12):
        lat = rng.choice([-60, 0, 37, 55, 70])
        ring = [(10 + rng.uniform(-0.2, 0.2), lat + rng.uniform(-0.1, 0.1)) for _ in range(3)]
        rows.append((i, 10 + rng.uniform(-0.5, 0.5), lat + rng.uniform(-0.3, 0.3), [[ring]]))
    df = spark.createDataFrame(rows, f"i int, x double, y double, shape {SHAPE}")
    got = {r.i: r for r in df.select("i", spheroid.metres_to_shape(F.col("x"), F.col("y"), F.col("shape")).alias("m"), geo.metres_to_shape(F.col("x"), F.col("y"), F.col("shape")).alias("flat")).collect()}
    dense = []
    for i, x, y, shape in rows:
        r = shape[0][0]
        dense += [(i, x, y, a[0] + (b[0] - a[0]) * k / 800, a[1] + (b[1] - a[1]) * k / 800) for a, b in zip(r, r[1:] + r[:1]) for k in range(801)]
    least = {r.i: r.m for r in spark.createDataFrame(dense, "i int, x double, y double, px double, py double").groupBy("i").agg(F.min(spheroid.metres(F.col("y"), F.col("x"), F.col("py"), F.col("px"))).alias("m")).collect()}
    for i, x, y, shape in rows:
        if _in(x, y, shape):
            assert got[i].m == 0
        else:  # a straight edge in degrees bends from the great circle by some metres in 40 km
            assert got[i].m == pytest.approx(least[i], rel=2e-3, abs=15) and got[i].m == pytest.approx(got[i].flat, rel=6e-3, abs=15)
