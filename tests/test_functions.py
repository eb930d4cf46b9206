import json
import math
import random

from pyspark.sql import functions as F

from almanac.functions import geo, signals, weekly
from almanac.operators import audit, budget, gates, spatial, tables, text_windows
from almanac.sources import readers


def one(spark, expression, **values):
    kinds = {bool: "boolean", int: "int", float: "double", str: "string"}
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {kinds[type(v)]}" for k, v in values.items()))
    return df.select(expression.alias("x")).first().x


# ---- text


def told(text):
    return [(w["days"], w["start"], w["end"], w["clean"], w["plausible"]) for w in text_windows.windows_of(text)]


def test_windows_in_text():
    week = [1, 2, 3, 4, 5]
    assert told("Happy Hour: Mon-Fri 3-6pm") == [(week, 900, 1080, True, True)]
    assert told("Happy hour 3pm to close, Sat & Sun") == [([6, 7], 900, None, True, True)]
    assert told("Happy hour daily open until 6") == [([1, 2, 3, 4, 5, 6, 7], None, 1080, True, True)]
    assert told("Happy hour Fri–Mon 15:00-18:00") == [([1, 5, 6, 7], 900, 1080, True, True)]
    assert told("Hours: Monday 11am-9pm") == [([1], 660, 1260, False, False)]
    assert told("Specials 3-6") == [(week, 900, 1080, True, False)]
    assert text_windows.windows_of("Specials 3-6")[0]["notes"].startswith("days assumed")
    assert told("Happy hour Mon 11am-9pm") == [([1], 660, 1260, True, False)]
    assert told("Happy hour Tue 3-5 courses") == [] and told("") == [] and told(None) == []
    assert told("Happy hour Mon 4 p.m. - 6 p.m.; Wed 5-7pm")[0] == ([1], 960, 1080, True, True)
    assert told("Happy hour 13pm-14pm Mon") == []


def test_offers_in_text():
    got = [(o["name"], o["kind"], o["category"], o["cents"], o["discount"]) for o in text_windows.offers_of("$5 draft beer and $2 off wells, wine from $6-8, half-price appetizers")]
    assert got == [("$5 draft beer", "drink", "beer", 500, None), ("$2 off wells", "drink", "spirit", None, 200), ("wine from $6-8", "drink", "wine", 600, None), ("half-price appetizers", "food", "appetizer", None, None)]
    assert len(text_windows.offers_of("$1 beer, " * 20)) == 8 and text_windows.offers_of("$10") == []


def test_parse_frame(spark):
    df = spark.createDataFrame([(1, "Happy hour Mon 3-6pm. $5 beer"), (2, None), (3, "")], "id int, text string")
    assert {r.id: len(r.windows) for r in text_windows.parse(df).collect()} == {1: 1, 2: 0, 3: 0}


# ---- gates


OFFERS = "array<struct<name:string,description:string,cents:long,kind:string>>"


def reasons(spark, start=900, end=1080, days=(1,), all_day=False, offers=(), notes=None, source=None, confidence=0.9, known=True, periods=()):
    df = spark.createDataFrame([(list(days), start, end, all_day, [(*o,) for o in offers], notes, source, list(periods))], f"days array<int>, start int, end int, all_day boolean, offers {OFFERS}, notes string, source string, periods {weekly.PERIODS}")
    w = F.struct("days", "start", "end", "all_day")
    return df.select(gates.realness(w, F.col("offers"), F.col("notes"), F.col("source"), F.col("periods"), F.lit(confidence), F.lit(known)).alias("r")).first().r


def test_realness(spark):
    beer = ("Draft beer", None, 500, "drink")
    steak = [(f"Steak {k}", None, 1800, "food") for k in range(3)]
    assert reasons(spark, offers=[beer]) == [] == reasons(spark)
    assert reasons(spark, all_day=True, start=None, end=None, days=(1, 2, 3), offers=[beer]) == ["all_day_many_days"]
    assert reasons(spark, all_day=True, start=None, end=None) == ["bare_non_hh_window"]
    assert reasons(spark, confidence=0.1) == ["low_confidence"] and reasons(spark, confidence=0.1, offers=[beer]) == []
    assert reasons(spark, known=False, offers=[beer]) == ["no_time_window"]
    assert reasons(spark, 660, 1200) == ["bare_non_hh_window", "implausible_window_duration"]
    assert reasons(spark, 660, 1200, notes="Happy hour all day") == ["implausible_window_duration"]
    assert reasons(spark, offers=[("Dinner special", None, 900, "food")]) == ["meal_special"]
    assert reasons(spark, offers=[("Dinner special", None, 900, "food")], notes="happy hour") == []
    assert reasons(spark, offers=[("Dinner menu snacks", None, 900, "food")]) == []
    assert reasons(spark, 690, 840, offers=[beer]) == ["meal_special"] and reasons(spark, 690, 840, offers=[beer], source="https://a.com/happy-hour") == []
    assert reasons(spark, offers=[("Feast", None, 4000, "food")]) == ["meal_special"]
    assert reasons(spark, 960, 1260, offers=steak, source="https://a.com/happy-hour", periods=[(1, 700, 1, 1290)]) == ["meal_special"]
    assert reasons(spark, 960, 1140, offers=steak, source="https://a.com/happy-hour", periods=[(1, 700, 1, 1290)]) == []


def test_sanitised_offers(spark):
    kind = "array<struct<name:string,cents:long,description:string,kind:string,category:string>>"
    offers = [("$5 Tacos", 500, None, "drink", "beer"), ("Tacos", 500, None, "drink", "beer"), ("Happy Hour", None, None, "other", None), ("Menu Gift Cards", None, None, "other", None), ("Well drinks", 150, None, "drink", "x"), ("Wine on Friday", 1500, None, "drink", "wine")]
    df = spark.createDataFrame([(offers, [1])], f"o {kind}, days array<int>")
    got = df.select(gates.sanitised(F.col("o"), F.col("days"), F.lit(2)).alias("x")).first().x
    assert [(o.name, o.kind, o.verdict, o.warnings) for o in got] == [("Tacos", "food", "keep", ["rekinded"]), ("Tacos", "food", "duplicate", ["rekinded"]), ("Happy Hour", "other", "heading", []), ("Menu Gift Cards", "other", "junk", []), ("Well drinks", "drink", "keep", ["cheap"]), ("Wine on Friday", "drink", "keep", ["days", "dear"])]


def test_small_rules(spark):
    df = spark.createDataFrame([([True] * 25 + [False] * 3,), ([False] * 30,)], "o array<boolean>")
    assert [r.s for r in df.select(gates.trust_score(F.col("o")).alias("s")).collect()] == [70, -100]
    assert one(spark, gates.contribution_route(F.lit(True), F.col("f"), F.lit(False), F.lit(False), F.lit(0), F.lit(0.85)), f=True) == "auto_apply"
    assert one(spark, gates.read_health(F.lit(True), F.lit(False), F.lit(False), F.lit(False), F.col("s"), F.lit(None).cast("string"), F.lit(False), F.lit(False), F.lit(False), F.lit(False)), s=404) == "dead"
    assert one(spark, gates.stub_site_action(F.lit("Zed"), F.lit("restaurant"), F.array().cast("array<string>"), F.lit(True), F.col("t"), F.lit(False)), t="Coming soon " + "x" * 300) == "hide"
    assert one(spark, signals.offer_match(F.col("t")), t="see https://happyhour.com for the Happy-Hours daily") == "Happy-Hours"


def test_audit_codes(spark):
    items = [("drink", "Tacos", None, 300), ("drink", "Wine on Friday", None, 300), ("drink", "Every first Monday flight", None, 300)]
    rows = [
        (1, 1, [1], 900, 1080, False, True, "a", None, False, items, "https://other.com/", "days assumed Mon"),
        (1, 2, [1], 960, 1140, False, True, "a", None, False, [], "https://menu.own.com/shop/x", None),
        (2, 1, [1], 600, 1200, False, True, "a", None, False, [], "https://own.com/events/x", "monthly"),
        (3, 1, [1], 600, 600, False, False, "", None, False, items, "https://own.com", None),
    ]
    windows = spark.createDataFrame(rows, "place int, pos int, days array<int>, start int, end int, all_day boolean, active boolean, offers string, area string, suspect boolean, items array<struct<kind:string,name:string,description:string,cents:int>>, source string, notes string")
    sites = spark.createDataFrame([(1, "https://own.com", None), (2, "https://x.doordash.com", None), (3, "https://own.com", None)], f"place int, website string, periods {weekly.PERIODS}")
    got = {}
    for r in audit.audit(windows, sites, 2024).collect():
        got.setdefault(r.place, {})[r.code] = r.severity
    assert set(got[1]) == {"assumed_days_avoidable", "homepage_sourced_hh", "third_party_source", "uniform_cheap_prices", "food_kinded_as_drink", "day_mismatch_offering", "monthly_event_window", "own_subdomain_source", "shop_page_source", "overlapping_windows"}
    assert set(got[2]) == {"platform_website_url", "third_party_source", "stale_event_source", "implausible_active", "monthly_event_window"}
    assert 3 not in got and got[1]["assumed_days_avoidable"] == "auto_fixable" and got[1]["third_party_source"] == "report"
    good = windows.where("place = 1 and pos = 2").withColumn("source", F.lit("https://own.com/happy-hour"))
    assert audit.confident_correction(good, 2024).first().confident and not audit.confident_correction(windows.where("place = 2"), 2024).first().confident


# ---- shapes


def test_points_in_shapes_against_a_plain_version(spark):
    rng = random.Random(4)
    ring = [(0, 0), (4, 0), (4, 3), (2, 1), (0, 3)]
    hole = [(1, 0.2), (2, 0.2), (2, 0.6), (1, 0.6)]

    def inside(x, y, r):
        odd = False
        for (ax, ay), (bx, by) in zip(r, r[1:] + r[:1]):
            odd ^= (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax
        return odd

    points = [(k, rng.uniform(-1, 5), rng.uniform(-1, 4)) for k in range(400)]
    shape = [[[{"x": float(a), "y": float(b)} for a, b in r] for r in (ring, hole)]]
    df = spark.createDataFrame(points, "id int, x double, y double")
    shapes = spark.createDataFrame([(1, shape)], f"area int, shape {geo.SHAPE}")
    got = {r.id for r in spatial.near_shapes(df, shapes, 0.0).collect()}
    assert got == {k for k, x, y in points if inside(x, y, ring) and not inside(x, y, hole)}
    square = spark.range(1).select(geo.rectangle(F.lit(10.0), F.lit(50.0), F.lit(10.01), F.lit(50.01)).alias("s"))
    r = square.select(geo.metres_to_shape(F.lit(10.02), F.lit(50.005), F.col("s")).alias("d"), geo.area(F.col("s")).alias("a")).first()
    assert abs(r.d - 0.01 * math.cos(math.radians(50.005)) * 111_195) < 1 and abs(r.a / (1111.95**2 * math.cos(math.radians(50.0))) - 1) < 0.01


def test_assignment_stages(spark):
    box = lambda w, s: geo.rectangle(F.lit(w), F.lit(s), F.lit(w + 0.01), F.lit(s + 0.01))
    rows = [(1, "fine", 0, 0.0), (2, "coarse", 0, 0.0), (3, "fine", 2, 0.02)]
    areas = spark.createDataFrame([(1, i, tier, known, w) for i, tier, known, w in rows], "city int, area long, tier string, recognisability int, w double").withColumn("shape", F.when(F.col("w") == 0.0, box(0.0, 0.0)).otherwise(box(0.02, 0.0))).drop("w")
    points = spark.createDataFrame([(1, 1, 0.005, 0.005), (2, 1, 0.0305, 0.005), (3, 1, 0.015, 0.005), (4, 1, 0.04, 0.005), (5, 1, 3.0, 3.0), (6, 2, 0.005, 0.005)], "id int, city int, x double, y double")
    got = {r.id: (r.area, r.stage) for r in spatial.assign(points, areas).collect()}
    assert got == {1: (2, "snap"), 2: (3, "snap"), 3: (None, None), 4: (3, "wide"), 5: (None, None), 6: (None, None)}


def test_quadtree_covers_every_point_once(spark):
    rng = random.Random(1)
    points = spark.createDataFrame([(rng.random() ** 2, rng.random()) for _ in range(500)], "x double, y double")
    tile = spark.createDataFrame([(0.0, 0.0, 1.0)], "x0 double, y0 double, size double")
    got = spatial.quadtree(tile, points, 40, 5).collect()
    assert sum(r.n for r in got) == 500 and all(r.n < 40 or r["size"] == 1 / 32 for r in got) and len(got) > 8


def test_name_clusters(spark):
    rows = [("c", "downtown", 9), ("c", "downtowns", 2), ("c", "downtown1", 1), ("c", "upton", 3), ("c", "uptown", 3), ("d", "downtowns", 1)]
    got = {(r.city, r.key): r.host for r in spatial.clusters(spark.createDataFrame(rows, "city string, key string, venues int")).collect()}
    assert got == {("c", "downtown"): "downtown", ("c", "downtowns"): "downtown", ("c", "downtown1"): "downtown", ("c", "upton"): "upton", ("c", "uptown"): "uptown", ("d", "downtowns"): "downtowns"}


# ---- tables and budgets


def test_budgets(spark):
    docs = spark.createDataFrame([("p", k, f"u{k}", b, s) for k, (b, s) in enumerate([(50, 1), (80, 9), (30, 5), (20, 5), (10, 0)])], "place string, pos int, url string, bytes int, score int")
    assert sorted(r.pos for r in budget.documents(docs, 120, 3).collect()) == [1, 2, 4]
    requests = spark.createDataFrame([(1, k, b) for k, b in enumerate([5, 5, 20, 3, 8, 1])], "batch int, pos int, bytes int")
    assert [r.chunk for r in budget.chunks(requests, 10).orderBy("pos").collect()] == [0, 0, 1, 2, 3, 3]
    text = "intro " + "x" * 1494 + "y" * 1500 + ("happy hour $5 " + "z" * 1486) + "w" * 900
    kept = budget.windows_of_text(spark.createDataFrame([(1, text), (2, "short"), (3, None)], "id int, text string"), 3000)
    assert {r.id: r.kept for r in kept.collect()} == {1: text[:1500] + " … " + text[3000:4500], 2: "short", 3: ""}


def test_tree_levels_and_cycles(spark):
    rows = [(1, None), (2, 1), (3, 2), (4, 99), (5, 6), (6, 5)]
    assert {r.k: r.depth for r in tables.levels(spark.createDataFrame(rows, "k int, p int"), "k", "p").collect()} == {1: 0, 2: 1, 3: 2, 4: 0}


# ---- readers and writers


def test_readers(spark, tmp_path):
    ring = [[0, 0], [1, 0], [1, 1], [0, 0]]
    polygon = {"type": "Polygon", "coordinates": [ring]}
    files = {
        "bare": polygon,
        "feature": {"type": "Feature", "properties": {"name": "A"}, "geometry": polygon},
        "many": {"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"name": n}, "geometry": {"type": "MultiPolygon", "coordinates": [[ring], [ring]]}} for n in "BC"]},
    }
    for name, body in files.items():
        (tmp_path / f"{name}.geojson").write_text(json.dumps(body))
    got = [(r.name, len(r.shape)) for name in files for r in readers.geojson(spark, str(tmp_path / f"{name}.geojson")).collect()]
    assert got == [(None, 1), ("A", 1), ("B", 2), ("C", 2)]
    (tmp_path / "x.csv").write_text('a,b\n"one, ""1""","two\nlines"\n,\n3,\n')
    rows = readers.csv(spark, str(tmp_path / "x.csv"))
    assert [tuple(r) for r in rows.collect()] == [('one, "1"', "two\nlines"), ("3", "")]
    readers.write_csv(rows, str(tmp_path / "out"))
    assert [tuple(r) for r in readers.csv(spark, str(tmp_path / "out")).orderBy("a").collect()] == [("3", ""), ('one, "1"', "two lines")]
    table = spark.createDataFrame([(1, "x|y"), (2, None)], "id int, t string")
    assert readers.from_json_lines(readers.to_json_lines(table), "id int, t string").orderBy("id").collect() == table.collect()
    readers.markdown(table, str(tmp_path / "md"))
    assert {r.value for r in spark.read.text(str(tmp_path / "md")).collect()} == {"| id | t |", "|---|---|", "| 1 | x\\|y |", "| 2 |  |"}
    (tmp_path / "p.html").write_text("<p>\nx")
    assert readers.html(spark, str(tmp_path / "p.html")).first().html == "<p>\nx"
