import json
import random

from pyspark.sql import functions as F

from almanac.functions import geo
from almanac.operators import spatial, tables
from tests.test_overlay import _in, box


def greedy(rows):
    """host of every (city, key), one after the other"""
    out, accepted = {}, {}
    for city, key, _ in sorted(rows, key=lambda r: (-r[2], r[1])):
        held = accepted.setdefault(city, [])
        host = next((h for h in held if len(h) >= 6 and len(key) >= 6 and near(h, key)), None)
        if host is None:
            held.append(key)
        out[city, key] = host or key
    return out


def near(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) <= 1
    small, large = sorted((a, b), key=len)
    return any(large[:i] + large[i + 1 :] == small for i in range(len(large)))


def keys(seed, n=160):
    rng, out = random.Random(seed), {}
    for _ in range(n):
        key = "".join(rng.choice("ab") for _ in range(rng.randint(5, 9)))
        out[rng.choice(["x", "y", None]), key] = rng.randint(1, 4)
    return [(c, k, v) for (c, k), v in out.items()]


def test_keys_one_edit_apart_and_their_hosts(spark):
    for seed in (1, 2):
        rows = [(c, k, v) for c, k, v in keys(seed) if c] + [("z", "alone", 1), ("z", "", 2)]
        df = spark.createDataFrame(rows, "city string, key string, venues int")
        got = {(r.city, r.a, r.b) for r in spatial.near_keys(df, ["city"]).collect()}
        assert got == {(c, a, b) for c, a, _ in rows for e, b, _ in rows if c == e and a < b and len(a) >= 6 <= len(b) and near(a, b)}
        assert {(r.city, r.key): r.host for r in spatial.clusters(df).collect()} == greedy(rows)
    assert spatial.clusters(df.where("false")).count() == 0


def test_chains_of_any_length_take_few_rounds(spark, monkeypatch):
    cuts, n = [], 1 << 17
    monkeypatch.setattr(tables, "cut", lambda df: cuts.append(1) or df.checkpoint(eager=True))
    chain = spark.range(n).select(F.col("id").alias("k"), F.when(F.col("id") > 0, F.col("id") - 1).alias("p"))
    r = tables.levels(chain, "k", "p").agg(F.count("*").alias("n"), F.sum((F.col("k") == F.col("depth")).cast("int")).alias("same")).first()
    assert (r.n, r.same) == (n, n) and len(cuts) < 3 * 25


def test_trees_with_cycles_and_several_parents(spark):
    rng = random.Random(4)
    for _ in range(3):
        rows = [(rng.randrange(40), rng.choice([None, *range(45)])) for _ in range(55)] + [(None, 1), (50, 51), (51, 50), (52, 51)]
        known, depth = {k for k, _ in rows if k is not None}, {}
        for k, p in rows:
            if k is not None and (p is None or p not in known):
                depth[k] = 0
        level = 0
        while any(d == level for d in depth.values()):
            for k, p in rows:
                if k is not None and k not in depth and depth.get(p) == level:
                    depth[k] = level + 1
            level += 1
        assert {r.k: r.depth for r in tables.levels(spark.createDataFrame(rows, "k int, p int"), "k", "p").collect()} == depth


def test_shapes_of_any_size_have_few_cells(spark):
    rng = random.Random(6)
    shapes = [(0, [[box(-120, -60, 120, 70), box(-30, -20, 10, 15, True)]]), (1, [[box(0.01, 0.01, 0.02, 0.02)]]), (2, [[[(-10.0, 0.0), (30.0, 5.0), (2.0, 40.0)]]]), (3, [[box(100, 0, 101, 1)], [box(-101, 0, -100, 1)]])]
    points = [(i, rng.uniform(-125, 125), rng.uniform(-65, 75)) for i in range(400)] + [(1000 + i, rng.uniform(0, 0.03), rng.uniform(0, 0.03)) for i in range(50)] + [(2000, 100.5, 0.5), (2001, None, 1.0)]
    s = spark.createDataFrame(shapes, f"area int, shape {geo.SHAPE}")
    p = spark.createDataFrame(points, "id int, x double, y double")
    cells = spatial.with_cells(s, 0.05, 0.0).groupBy("area").agg(F.count("*").alias("n"), F.sum(F.col("inner").cast("int")).alias("inner")).collect()
    assert all(r.n <= (spatial.ALONG + 2) ** 2 for r in cells) and {r.area for r in cells if r.inner} >= {0, 2}
    got = {(r.id, r.area) for r in spatial.near_shapes(p, s, 0.0).collect()}
    assert got == {(i, a) for i, x, y in points for a, shape in shapes if x is not None and _in(x, y, shape)}
    near = {(r.id, r.area): r.distance for r in spatial.near_shapes(p, s, 20_000.0).collect()}
    flat = {(r.id, r.area): r.d for r in p.where("x is not null").crossJoin(s).withColumn("d", geo.metres_to_shape(F.col("x"), F.col("y"), F.col("shape"))).where("d <= 20000").collect()}
    assert near.keys() == flat.keys() and all(abs(near[k] - flat[k]) < 1e-6 for k in near)
    small = s.where("area in (1, 3)")  # the edges of the others are so long that a great circle leaves their straight line by far
    round_ = {(r.id, r.area): r.distance for r in spatial.near_shapes(p, small, 2_000.0, on_spheroid=True).collect()}
    close = {k: d for k, d in flat.items() if k[1] in (1, 3)}
    assert {k for k, d in close.items() if d < 1_980} <= round_.keys() <= {k for k, d in close.items() if d < 2_020}
    assert all(abs(d - close[k]) <= 0.007 * close[k] for k, d in round_.items()) and any(0 < d for d in round_.values())
    assert spatial.near_shapes(p, s.where("false"), 0.0).count() == 0


def test_states_at_an_instant(spark):
    image = lambda n: json.dumps({"name": n, "v": 1})
    now = [(1, "now1", 9), (2, "now2", 9), (3, "now3", 9), (5, "now5", 9)]
    log = [(2, 10, image("two@9")), (2, 20, image("two@19")), (3, 15, None), (3, 30, image("three@29")), (4, 12, image("four, deleted at 12")), (5, 20, None), (5, 20, image("same time")), (None, 5, image("x"))]
    current = spark.createDataFrame(now, "id long, name string, v long")
    audit = spark.createDataFrame(log, "id long, at long, before string")
    at = lambda t: {r.id: r.name for r in tables.state_at(current, audit, "id", ["name", "v"], F.lit(t)).collect()}
    assert at(9) == {1: "now1", 2: "two@9", 4: "four, deleted at 12"}
    assert at(10) == {1: "now1", 2: "two@19", 4: "four, deleted at 12"}
    assert at(15) == {1: "now1", 2: "two@19", 3: "three@29"}
    assert at(99) == {1: "now1", 2: "now2", 3: "now3", 5: "now5"}


def test_soft_deletion_can_be_repeated(spark):
    rows = spark.createDataFrame([(1, True, None), (2, True, None), (3, False, None), (4, True, "before")], "id int, active boolean, deleted_at string")
    why = F.when(F.col("id") != 2, "junk")
    once = tables.soft_deleted(rows, why, F.lit("t1"))
    want = [(1, False, "t1"), (2, True, None), (3, False, None), (4, True, "before")]
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, tables.soft_deleted(once, why, F.lit("t2")).collect())) == want
    marked = tables.mark_reverted(spark.createDataFrame([(1, "applied"), (1, "pending"), (2, "applied"), (None, "applied")], "t int, status string"), spark.createDataFrame([(1,), (None,)], "t int"), "t")
    assert sorted(map(str, (tuple(r) for r in marked.collect()))) == sorted(map(str, [(1, "reverted"), (1, "pending"), (2, "applied"), (None, "applied")]))


SF = "/root/testdata/sf0.001"


def test_the_query_of_hosts_against_the_greedy_fold(spark):
    from almanac.functions import names
    from almanac.plans import catalogue

    part = spark.read.parquet(f"{SF}/part.parquet")
    keyed = part.select((F.col("p_partkey") % 5).cast("string").alias("city"), names.area_key(F.col("p_name")).alias("key")).groupBy("city", "key").count().collect()
    got = {(r.city, r.key): r.host for r in catalogue.queries()["g15_name_clusters"](spark, SF).collect()}
    assert got == greedy([(r.city, r.key, r["count"]) for r in keyed]) and len(got) > 50


def test_the_query_of_tiles_against_splitting(spark):
    from almanac.plans import catalogue, inputs

    def split(x0, y0, size, held, depth):
        own = [(x, y) for x, y in held if x0 <= x < x0 + size and y0 <= y < y0 + size]
        if not own:
            return []
        if len(own) < 60 or depth == 4:
            return [(round(x0, 9), round(y0, 9), size, len(own))]
        half = size / 2
        return [t for i in (0, 1) for j in (0, 1) for t in split(x0 + i * half, y0 + j * half, half, own, depth + 1)]

    for folder in (SF, "/root/testdata/sf0.01"):
        points = [(r.x, r.y) for r in inputs.points(spark, folder).select(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).collect()]
        got = sorted((round(r.x0, 9), round(r.y0, 9), r["size"], r.n) for r in catalogue.queries()["g10_quadtree"](spark, folder).collect())
        assert got == sorted(split(-122.0, 37.0, 2.0, points, 0))
