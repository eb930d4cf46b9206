"""The driver's tables read as places, windows, offers, votes and submissions, by rules that Spark and DuckDB both state.

nation = city, region = state, customer = place, orders = window (days, times and areas derived from its key), lineitem = offer,
part = candidate, events = votes, submissions and searches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from almanac.session import table


def windows(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    mask = (k % 127 + 1).cast("int")
    days = F.filter(F.sequence(F.lit(1), F.lit(7)), lambda i: F.expr("1") == F.pmod(F.floor(mask / F.pow(F.lit(2), i - 1)), F.lit(2)))
    all_day = k % 29 == 0
    return table(spark, d, "orders").select(
        F.col("o_custkey").alias("place"),
        k.alias("id"),
        k.alias("pos"),
        days.alias("days"),
        F.when(~all_day & ((k % 13 != 0) | (k % 11 == 0)), k * 37 % 48 * 30).cast("int").alias("start"),
        F.when(~all_day & (k % 11 != 0), k * 53 % 48 * 30).cast("int").alias("end"),
        all_day.alias("all_day"),
        F.when(k % 5 == 0, "bar").when(k % 5 == 1, "patio").otherwise("all").alias("area"),
        (F.col("o_orderstatus") != "P").alias("active"),
        F.when(k % 4 == 0, F.lit("")).otherwise(F.concat(F.lit("o"), (k % 3).cast("string"))).alias("offers"),
        (k % 17 == 0).alias("suspect"),
        F.col("o_orderdate").alias("updated_at"),
    )


WINDOWS = """windows AS (
  SELECT o_custkey AS place, o_orderkey AS id, o_orderkey AS pos,
    list_filter([1, 2, 3, 4, 5, 6, 7], lambda i: ((o_orderkey % 127 + 1) >> (i - 1)) & 1 = 1) AS days,
    CASE WHEN o_orderkey % 29 <> 0 AND (o_orderkey % 13 <> 0 OR o_orderkey % 11 = 0) THEN CAST(o_orderkey * 37 % 48 * 30 AS INTEGER) END AS start_,
    CASE WHEN o_orderkey % 29 <> 0 AND o_orderkey % 11 <> 0 THEN CAST(o_orderkey * 53 % 48 * 30 AS INTEGER) END AS end_,
    o_orderkey % 29 = 0 AS all_day,
    CASE o_orderkey % 5 WHEN 0 THEN 'bar' WHEN 1 THEN 'patio' ELSE 'all' END AS area, o_orderstatus <> 'P' AS active,
    CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE 'o' || (o_orderkey % 3) END AS offers, o_orderkey % 17 = 0 AS suspect, o_orderdate AS updated_at
  FROM orders)"""


def hours(spark: SparkSession, d: str) -> DataFrame:
    """One row per place: open on all days but one, ten hours or more, some past midnight; every ninth has no hours."""
    p = F.col("c_custkey")
    opens, close = (600 + p % 5 * 60).cast("int"), (1200 + p % 5 * 60 + p % 3 * 180).cast("int")
    days = F.filter(F.sequence(F.lit(1), F.lit(7)), lambda i: i != p % 7 + 1)
    period = lambda i: F.struct(i.alias("open_day"), opens.alias("open_min"), F.when(close >= 1440, i % 7 + 1).otherwise(i).cast("int").alias("close_day"), (close % 1440).cast("int").alias("close_min"))
    return table(spark, d, "customer").select(p.alias("place"), F.when(p % 9 != 0, F.transform(days, period)).alias("periods"))


HOURS = """hours AS (
  SELECT c_custkey AS place, CASE WHEN c_custkey % 9 <> 0 THEN list_transform(list_filter([1, 2, 3, 4, 5, 6, 7], lambda i: i <> c_custkey % 7 + 1),
    lambda i: {'open_day': i, 'open_min': 600 + c_custkey % 5 * 60,
               'close_day': CASE WHEN 1200 + c_custkey % 5 * 60 + c_custkey % 3 * 180 >= 1440 THEN i % 7 + 1 ELSE i END,
               'close_min': (1200 + c_custkey % 5 * 60 + c_custkey % 3 * 180) % 1440}) END AS periods
  FROM customer)"""


#: ``operating`` (id, operating) after WINDOWS and HOURS: whether a window is when its place is open. A day has one period at most.
OPERATING = """opened AS (SELECT place, t.open_day AS day, t.open_min AS a, CASE WHEN t.close_min <= t.open_min THEN t.close_min + 1440 ELSE t.close_min END AS b FROM (SELECT place, unnest(periods) AS t FROM hours)),
told AS (SELECT id, place, start_ AS a, CASE WHEN end_ <= start_ THEN end_ + 1440 ELSE end_ END AS b, unnest(days) AS day FROM windows),
met AS (SELECT id, count(*) AS n, count(*) FILTER (WHERE abs(w.a - o.a) <= 30) AS near, count(*) FILTER (WHERE least(w.b, o.b) - greatest(w.a, o.a) >= CAST(0.8 AS DOUBLE) * (o.b - o.a)) AS whole FROM told w JOIN opened o USING (place, day) GROUP BY id),
operating AS (SELECT id, CASE WHEN all_day OR start_ IS NULL THEN false WHEN end_ IS NULL THEN coalesce(2 * near > n, false) WHEN n > 0 THEN 2 * whole > n
    ELSE CASE WHEN end_ <= start_ THEN end_ + 1440 ELSE end_ END - start_ >= CASE WHEN start_ <= 660 THEN 360 ELSE 480 END END AS operating
  FROM windows LEFT JOIN met USING (id))"""


def offers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("id"),
        F.col("l_linenumber").alias("line"),
        F.concat(F.lit("item "), (F.col("l_partkey") % 50).cast("string")).alias("name"),
        F.when(F.col("l_quantity") < 45, F.round(F.col("l_extendedprice") * 100).cast("long") % 5000).alias("cents"),
        F.when(F.col("l_returnflag") == "R", "food").otherwise("drink").alias("kind"),
        (F.col("l_linestatus") == "O").alias("active"),
    )


OFFERS = """offers AS (
  SELECT l_orderkey AS id, l_linenumber AS line, 'item ' || (l_partkey % 50) AS name,
    CASE WHEN l_quantity < 45 THEN CAST(round(l_extendedprice * 100) AS BIGINT) % 5000 END AS cents,
    CASE WHEN l_returnflag = 'R' THEN 'food' ELSE 'drink' END AS kind, l_linestatus = 'O' AS active
  FROM lineitem)"""


def submissions(spark: SparkSession, d: str) -> DataFrame:
    e, u = F.col("event_id"), F.col("user_id")
    return table(spark, d, "events").select(
        e.alias("id"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("at_us"),
        F.col("ts"),
        F.when(u % 10 != 0, F.concat(F.lit("f"), u.cast("string"))).alias("fingerprint"),
        F.when(u % 7 != 0, F.concat(F.lit("10.0."), (u % 40).cast("string"), F.lit("."), (e % 200).cast("string"))).alias("ip"),
        F.when(e % 3 == 0, F.concat(F.lit("m"), (u % 60).cast("string"))).alias("email"),
        F.when(F.col("event_type") == "error", "critical").otherwise("low").alias("risk"),
        F.when(e % 13 == 0, e - 1).alias("parent"),
        (e % 97).alias("target"),
        F.col("event_type").alias("kind"),
        F.when(F.col("value") > 50, "deny").otherwise("confirm").alias("vote"),
    )


SUBMISSIONS = """submissions AS (
  SELECT event_id AS id, epoch_us(ts) AS at_us, ts, CASE WHEN user_id % 10 <> 0 THEN 'f' || user_id END AS fingerprint,
    CASE WHEN user_id % 7 <> 0 THEN '10.0.' || (user_id % 40) || '.' || (event_id % 200) END AS ip,
    CASE WHEN event_id % 3 = 0 THEN 'm' || (user_id % 60) END AS email, CASE WHEN event_type = 'error' THEN 'critical' ELSE 'low' END AS risk,
    CASE WHEN event_id % 13 = 0 THEN event_id - 1 END AS parent, event_id % 97 AS target, event_type AS kind,
    CASE WHEN value > 50 THEN 'deny' ELSE 'confirm' END AS vote
  FROM events)"""


def points(spark: SparkSession, d: str) -> DataFrame:
    """Places with coordinates inside two degrees, from their keys."""
    p = F.col("c_custkey")
    return table(spark, d, "customer").select(p.alias("id"), F.col("c_nationkey").alias("city"), F.col("c_name").alias("name"), (p * 7919 % 20000 / 10000.0 - 122.0).alias("x"), (p * 104729 % 20000 / 10000.0 + 37.0).alias("y"))


POINTS = """points AS (
  SELECT c_custkey AS id, c_nationkey AS city, c_name AS name, c_custkey * 7919 % 20000 / 10000.0 - 122.0 AS x, c_custkey * 104729 % 20000 / 10000.0 + 37.0 AS y
  FROM customer)"""


def areas(spark: SparkSession, d: str) -> DataFrame:
    """Nine rectangles per city, not quite touching, every other one coarse."""
    from almanac.functions import geo

    i, j, c = F.col("i"), F.col("j"), F.col("n_nationkey")
    grid = table(spark, d, "nation").withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(2)))).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(2))))
    # SQL's bounds are decimals: the doubles nearest to them, by one division of whole numbers
    west, east = (i * 6 - 1219) / 10.0, (i * 60 - 12190 + 55) / 100.0
    south, north = (j * 6 + 371) / 10.0, (j * 60 + 3710 + 55) / 100.0
    return grid.select(c.alias("city"), (c * 9 + i * 3 + j).cast("long").alias("area"), F.when((i + j) % 2 == 0, "fine").otherwise("coarse").alias("tier"), ((c + i) % 3).cast("int").alias("recognisability"), geo.rectangle(west, south, east, north).alias("shape"))


AREAS = """areas AS (
  SELECT n_nationkey AS city, n_nationkey * 9 + i * 3 + j AS area, CASE WHEN (i + j) % 2 = 0 THEN 'fine' ELSE 'coarse' END AS tier,
    i * 0.6 - 121.9 AS west, j * 0.6 + 37.1 AS south FROM nation, range(0, 3) a(i), range(0, 3) b(j))"""
