"""Operators on tables, trees and points at their edges: nulls, repeats, depth, the poles and the antimeridian."""

import math

from pyspark.sql import functions as F

from almanac.operators import spatial, tables


def test_levels_of_a_deep_tree_and_cycles(spark):
    rows = [(i, i - 1 if i else None) for i in range(40)] + [(100, 101), (101, 100), (200, 999)]
    got = {r.k: r.depth for r in tables.levels(spark.createDataFrame(rows, "k int, p int"), "k", "p").collect()}
    assert got == {i: i for i in range(40)} | {200: 0}


def test_upsert_of_null_and_repeated_keys(spark):
    old = spark.createDataFrame([(None, 1), (1, 2), (2, 3)], "k int, v int")
    new = spark.createDataFrame([(None, 9), (1, 4), (1, 5), (3, 6)], "k int, v int")
    assert sorted(map(str, tables.upsert(old, new, ["k"]).collect())) == sorted(["Row(k=None, v=9)", "Row(k=1, v=5)", "Row(k=2, v=3)", "Row(k=3, v=6)"])


def test_revert_to_the_first_image(spark):
    now = spark.createDataFrame([(1, "c", True, None)], "k int, name string, active boolean, deleted_at string")
    audit = spark.createDataFrame([(1, '{"name": "b"}', 2), (1, '{"name": "a"}', 1)], "k int, before string, at int")
    assert [tuple(r) for r in tables.revert(now, audit, "k", ["name"], "at").collect()] == [(1, "a", True, None)]


def test_near_matches_at_any_latitude(spark):
    """Against all pairs: a degree of longitude shrinks toward the poles, and longitudes meet at 180."""
    points, others = [], []
    for i, lat in enumerate((0.0, 45.0, 61.0, 75.0, 85.0, 89.9, -70.0)):
        for j, lng in enumerate((-180.0, 12.3456, 179.9999)):
            k = i * 10 + j
            points.append((k, lat, lng))
            step = (140 if j % 2 else 160) / 111_195 / math.cos(math.radians(lat))
            x = lng + step
            others.append((lat, x - 360 if x > 180 else x))
    df = spark.createDataFrame(points, "id int, lat double, lng double")
    got = {r.id: r.near for r in spatial.near_any(df, spark.createDataFrame(others, "lat double, lng double"), 150.0).collect()}

    def metres(a, b, c, d):
        a, b, c, d = map(math.radians, (a, b, c, d))
        h = math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((d - b) / 2) ** 2
        return 2 * 3958.8 * 1609.344 * math.asin(math.sqrt(h))

    assert got == {k: any(metres(lat, lng, *o) <= 150 for o in others) for k, lat, lng in points}
    assert set(got.values()) == {True, False}
