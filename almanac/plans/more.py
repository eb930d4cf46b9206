"""Further queries: listings and composites."""

from __future__ import annotations

from pyspark.sql import functions as F

from almanac.functions import geo, names, pages, urls, weekly
from almanac.operators import budget, gates, listing, spatial, tables
from almanac.plans import inputs as i
from almanac.plans.catalogue import query
from almanac.session import table

t = table


# ---- composites over the tables


@query("j12_points_near_areas", f"WITH {i.POINTS}, {i.AREAS}, d AS (SELECT id, area, cos(radians(y)) AS k, greatest(west - x, 0, x - west - 0.55) AS dx, greatest(south - y, 0, y - south - 0.55) AS dy FROM points JOIN areas USING (city)) SELECT id, area FROM d WHERE sqrt(pow(dx * k, 2) + dy * dy) * 111195 <= 1000")
def j12(s, d):
    return spatial.near_shapes(i.points(s, d), i.areas(s, d), 1000.0, same=("city",)).select("id", "area")


@query("w2_best_area", f"""WITH {i.POINTS}, {i.AREAS}, d AS (SELECT id, area, tier, (city + (area % 9) // 3) % 3 AS known, cos(radians(y)) AS k, greatest(west - x, 0, x - west - 0.55) AS dx, greatest(south - y, 0, y - south - 0.55) AS dy FROM points JOIN areas USING (city)),
m AS (SELECT *, sqrt(pow(dx * k, 2) + dy * dy) * 111195 AS dist FROM d)
SELECT id, area FROM m WHERE dist <= 100 QUALIFY row_number() OVER (PARTITION BY id ORDER BY tier = 'fine' AND known < 1, dist, tier <> 'fine', known DESC, area) = 1""")
def w2(s, d):
    """Areas of this data don't overlap within reach, so the size never decides."""
    return spatial.best_area(i.points(s, d), i.areas(s, d))


@query("g3_boxes", f"WITH {i.AREAS} SELECT area, round(CAST(west AS DOUBLE), 6) AS west, round(CAST(south AS DOUBLE), 6) AS south, round(CAST(west + 0.55 AS DOUBLE), 6) AS east, round(CAST(south + 0.55 AS DOUBLE), 6) AS north FROM areas")
def g3(s, d):
    return i.areas(s, d).select("area", geo.box(F.col("shape")).alias("b")).select("area", *[F.round(F.col(f"b.{c}"), 6).alias(c) for c in ("west", "south", "east", "north")])


@query("g6_area_sizes", f"WITH {i.AREAS} SELECT area, round(0.55 * 0.55 * cos(radians(south)) * 111195 * 111195 / 1e6, 3) AS km2 FROM areas")
def g6(s, d):
    return i.areas(s, d).select("area", F.round(geo.area(F.col("shape")) / 1e6, 3).alias("km2"))


@query("a14_implausible_by_city", f"WITH {i.WINDOWS} SELECT c_nationkey AS city, count(*) AS n FROM windows JOIN customer ON c_custkey = place WHERE start_ = end_ OR end_ > start_ AND end_ - start_ > 720 OR start_ < 360 GROUP BY 1")
def a14(s, d):
    odd = F.coalesce((F.col("start") == F.col("end")) | (F.col("end") - F.col("start") > 720) | (F.col("start") < 360), F.lit(False))
    w = i.windows(s, d).where(odd).groupBy("place").agg(F.count(F.lit(1)).alias("n"))
    return t(s, d, "customer").join(w, F.col("place") == F.col("c_custkey")).groupBy(F.col("c_nationkey").alias("city")).agg(F.sum("n").alias("n"))


@query("a24_counts_by_city", "SELECT n_name AS city, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS places, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS candidates FROM nation")
def a24(s, d):
    n = lambda name, key, out: t(s, d, name).groupBy(F.col(key).alias("k")).agg(F.count(F.lit(1)).alias(out))
    base = t(s, d, "nation").select("n_name", F.col("n_nationkey").alias("k"))
    j = base.join(n("customer", "c_nationkey", "places"), "k", "left").join(n("supplier", "s_nationkey", "candidates"), "k", "left")
    return j.select(F.col("n_name").alias("city"), F.coalesce("places", F.lit(0)).alias("places"), F.coalesce("candidates", F.lit(0)).alias("candidates"))


@query("a26_share_inside", f"WITH {i.POINTS}, {i.AREAS}, p AS (SELECT id, city, bool_or(x > west AND x < west + 0.55 AND y > south AND y < south + 0.55) AS inside FROM points JOIN areas USING (city) GROUP BY 1, 2) SELECT city, count(*) FILTER (WHERE inside) * 1.0 / nullif(count(*), 0) AS share FROM p GROUP BY city")
def a26(s, d):
    p = i.points(s, d)
    inside = spatial.near_shapes(p, i.areas(s, d), 0.0, same=("city",)).where(~geo.on_edge(F.col("x"), F.col("y"), F.col("shape"))).select("id").distinct().withColumn("hit", F.lit(1))
    return p.join(inside, "id", "left").groupBy("city").agg(F.avg(F.coalesce("hit", F.lit(0))).alias("share"))


@query("a27_verdict_tallies", f"WITH {i.WINDOWS}, l AS (SELECT place, count(*) FILTER (WHERE active) AS live FROM windows GROUP BY 1), v AS (SELECT CASE WHEN coalesce(live, 0) > 0 THEN 'keep' WHEN c_mktsegment = 'BUILDING' THEN CASE WHEN c_custkey % 3 = 0 THEN 'review' WHEN c_custkey % 3 = 1 THEN 'keep' ELSE 'drop?' END WHEN c_custkey % 3 <> 1 THEN 'drop?' ELSE 'review' END AS verdict FROM customer LEFT JOIN l ON place = c_custkey) SELECT verdict, count(*) AS n FROM v GROUP BY 1")
def a27(s, d):
    live = i.windows(s, d).where("active").groupBy("place").agg(F.count(F.lit(1)).alias("live"))
    k = F.col("c_custkey") % 3
    health = F.when(k == 0, "no-site").when(k == 1, "blocked").otherwise("dead")
    verdict = gates.quality_verdict(F.coalesce("live", F.lit(0)), F.col("c_mktsegment") == "BUILDING", health)
    return t(s, d, "customer").join(live, F.col("place") == F.col("c_custkey"), "left").groupBy(verdict.alias("verdict")).agg(F.count(F.lit(1)).alias("n"))


@query("a29_cards", f"WITH {i.WINDOWS} SELECT place, start_ AS start, end_ AS \"end\", all_day, list_sort(list_distinct(flatten(list(days)))) AS days, row_number() OVER (PARTITION BY place ORDER BY min(list_min(days)), min(id)) AS card FROM windows WHERE active GROUP BY place, start_, end_, all_day")
def a29(s, d):
    g = i.windows(s, d).where("active").groupBy("place", "start", "end", "all_day").agg(weekly.day_set(F.flatten(F.collect_list("days"))).alias("days"), F.min("id").alias("first"))
    from pyspark.sql import Window as W

    return g.withColumn("card", F.row_number().over(W.partitionBy("place").orderBy(F.array_min("days"), "first")).cast("long")).drop("first")


@query("a32_distinct_keys", "SELECT DISTINCT regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS key FROM part")
def a32(s, d):
    return t(s, d, "part").select(names.slug(F.col("p_name")).alias("key")).distinct()


@query("u3_day_relations", f"WITH {i.WINDOWS} SELECT a.id AS first, b.id AS second, list_has_any(a.days, b.days) AS shared, len(a.days) < len(b.days) AND list_has_all(b.days, a.days) AS narrower, a.days = b.days AS same FROM windows a JOIN windows b ON a.place = b.place AND a.id < b.id")
def u3(s, d):
    w = i.windows(s, d).select("place", "id", "days")
    p = w.alias("a").join(w.alias("b"), (F.col("a.place") == F.col("b.place")) & (F.col("a.id") < F.col("b.id")))
    a, b = F.col("a.days"), F.col("b.days")
    return p.select(F.col("a.id").alias("first"), F.col("b.id").alias("second"), weekly.share_a_day(a, b).alias("shared"), weekly.proper_subset(a, b).alias("narrower"), (a == b).alias("same"))


def _places(s, d):
    w = i.windows(s, d).where("active").groupBy("place").agg(F.sort_array(F.collect_list(F.struct("days", "id"))).alias("windows"), F.min("start").alias("first_start"), F.max("end").alias("last_end"))
    c = t(s, d, "customer").join(w, F.col("place") == F.col("c_custkey"), "left")
    k = F.col("c_custkey")
    return c.select(
        k.alias("id"), F.col("c_nationkey").alias("city"), F.col("c_name").alias("name"), F.when(k % 6 != 0, F.col("c_mktsegment")).alias("area"), F.when(k % 2 == 0, "pub").otherwise("wine_bar").alias("type"),
        F.array((k % 4).cast("string")).alias("tags"), F.array(F.concat(F.lit("Deal "), (k % 10).cast("string"))).alias("labels"), "windows", (k % 5 == 0).alias("live"), (k % 3 == 0).alias("today"), (k % 50 == 0).alias("promoted"),
        "first_start", "last_end", F.when(k % 2 == 0, (k % 4 + 1).cast("int")).alias("level"), F.when(k % 3 == 0, k * 7 % 3000).alias("least_cents"), (k % 100).cast("double").alias("distance"),
    )


@query("p13_listing_filter", f"WITH {i.WINDOWS} SELECT c_custkey AS id FROM customer WHERE ('deal ' || c_custkey % 10) LIKE '%deal 4%' AND c_custkey % 6 <> 0 AND c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_custkey % 2 = 0 AND c_custkey % 4 IN (0, 2) AND EXISTS (SELECT 1 FROM windows WHERE place = c_custkey AND active AND list_has_any(days, [6, 7]))")
def p13(s, d):
    return listing.matching(_places(s, d), search="DEAL 4", areas=("BUILDING", "MACHINERY"), types=("pub",), tags=("0", "2"), days=(6, 7)).select("id")


_W9 = f"WITH {i.WINDOWS}, w AS (SELECT place, min(start_) AS first_start FROM windows WHERE active GROUP BY 1)"


@query("w9_price_order", "SELECT c_custkey AS id, row_number() OVER (PARTITION BY c_nationkey ORDER BY coalesce(CASE WHEN c_custkey % 2 = 0 THEN c_custkey % 4 + 1 END, CASE WHEN c_custkey % 3 = 0 THEN least(4, ceil((c_custkey * 7 % 3000) / 700)) END, 99), c_name) AS position FROM customer")
def w9(s, d):
    return listing.ranked(_places(s, d), "price").select("id", F.col("position").cast("long").alias("position"))


@query("w10_relevance_order", _W9 + " SELECT c_custkey AS id, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey % 50 <> 0, CASE WHEN c_custkey % 5 = 0 THEN 0 WHEN c_custkey % 3 = 0 THEN 1 ELSE 2 END, first_start NULLS LAST, c_name) AS position FROM customer LEFT JOIN w ON place = c_custkey")
def w10(s, d):
    return listing.ranked(_places(s, d), "now").select("id", F.col("position").cast("long").alias("position"))


@query("w13_review_order", "SELECT c_custkey AS id, row_number() OVER (ORDER BY c_acctbal < 0 DESC, c_acctbal DESC NULLS LAST, c_custkey) AS position FROM customer QUALIFY position <= 100")
def w13(s, d):
    top = t(s, d, "customer").orderBy((F.col("c_acctbal") < 0).desc(), F.desc_nulls_last("c_acctbal"), "c_custkey").limit(100)
    from pyspark.sql import Window as W

    return top.select(F.col("c_custkey").alias("id"), F.row_number().over(W.orderBy((F.col("c_acctbal") < 0).desc(), F.desc_nulls_last("c_acctbal"), "c_custkey")).cast("long").alias("position"))


@query("c24_new_window_plan", f"WITH {i.WINDOWS}, n AS (SELECT * FROM windows WHERE id % 3 = 0), o AS (SELECT place, start_, end_, min(id) AS id, bool_or(active) AS active FROM windows WHERE id % 3 <> 0 GROUP BY 1, 2, 3) SELECT n.id, CASE WHEN o.id IS NULL THEN 'insert' WHEN o.active THEN 'attach' ELSE 'resurrect' END AS plan FROM n LEFT JOIN o ON o.place = n.place AND o.start_ IS NOT DISTINCT FROM n.start_ AND o.end_ IS NOT DISTINCT FROM n.end_")
def c24(s, d):
    """A third of the windows against the others, which are stored, under the same natural key; null times are equal."""
    w = i.windows(s, d)
    old = w.where("id % 3 <> 0").groupBy("place", "start", "end").agg(F.bool_or("active").alias("alive")).alias("b")
    plan = F.when(F.col("alive").isNull(), "insert").when(F.col("alive"), "attach").otherwise("resurrect")
    return w.where("id % 3 = 0").alias("a").join(old, tables.equal(["place", "start", "end"]), "left").select("a.id", plan.alias("plan"))


@query("c25_best_source_first_seen", f"WITH {i.WINDOWS} SELECT place, start_ AS start, arg_max(id, (suspect::INT, -id)) AS id, min(id) AS pos FROM windows GROUP BY place, start_")
def c25(s, d):
    from almanac.operators.windows import by_first_seen

    return by_first_seen(i.windows(s, d).withColumn("score", F.col("suspect").cast("int")), "score", ["place", "start"]).select("place", "start", "id", "pos")


@query("c31_kept_by_words_and_drink", f"WITH {i.OFFERS} SELECT p_partkey FROM part WHERE p_size % 2 = 0 OR NOT EXISTS (SELECT 1 FROM offers WHERE id = p_partkey AND kind = 'drink')")
def c31(s, d):
    drinks = i.offers(s, d).where("kind = 'drink'").groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    return t(s, d, "part").join(drinks, F.col("id") == F.col("p_partkey"), "left").where((F.col("p_size") % 2 == 0) | F.col("n").isNull()).select("p_partkey")


@query("f47_snippets", "WITH p AS (SELECT doc_id % 40 AS place, doc_id AS pos, trim(text) AS x FROM documents WHERE trim(text) <> ''), r AS (SELECT *, least(100, 350 - coalesce(sum(least(length(x), 100)) OVER (PARTITION BY place ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS room FROM p) SELECT place, string_agg('Source: ' || pos || chr(10) || x[1:CAST(room AS BIGINT)], chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY pos) AS snippet FROM r WHERE room > 0 GROUP BY place")
def f47(s, d):
    p = t(s, d, "documents").select((F.col("doc_id") % 40).alias("place"), F.col("doc_id").alias("pos"), F.col("doc_id").cast("string").alias("url"), "text")
    return budget.snippet(p, 100, 350)


@query("f48_chunks", "WITH RECURSIVE r AS (SELECT doc_id // 100 AS batch, doc_id AS pos, n_chars AS bytes, row_number() OVER (PARTITION BY doc_id // 100 ORDER BY doc_id) AS k FROM documents), f AS (SELECT batch, pos, bytes, k, 0 AS chunk, bytes AS used FROM r WHERE k = 1 UNION ALL SELECT r.batch, r.pos, r.bytes, r.k, CASE WHEN used + r.bytes > 20000 THEN chunk + 1 ELSE chunk END, CASE WHEN used + r.bytes > 20000 THEN r.bytes ELSE used + r.bytes END FROM f JOIN r ON r.batch = f.batch AND r.k = f.k + 1) SELECT batch, pos, bytes, chunk FROM f")
def f48(s, d):
    r = t(s, d, "documents").select(F.floor(F.col("doc_id") / 100).alias("batch"), F.col("doc_id").alias("pos"), F.col("n_chars").alias("bytes"))
    return budget.chunks(r, 20_000)


@query(
    "x15_documents_in_budget",
    """WITH RECURSIVE p AS (SELECT page_id // 30 AS place, page_id AS pos, url || CASE page_id % 4 WHEN 0 THEN '#specials' WHEN 1 THEN '#food-menu' ELSE '' END AS url, length(html) AS bytes, CASE page_id % 4 WHEN 0 THEN 70 WHEN 1 THEN 40 ELSE 0 END AS score FROM pages),
r AS (SELECT *, row_number() OVER (PARTITION BY place ORDER BY score DESC, pos) AS k FROM p),
f AS (SELECT *, bytes <= 20000 AS fits, CASE WHEN bytes <= 20000 THEN bytes ELSE 0 END AS used, CAST(bytes <= 20000 AS BIGINT) AS n FROM r WHERE k = 1
UNION ALL SELECT place, pos, url, bytes, score, k, fits, CASE WHEN fits THEN used + bytes ELSE used END, CASE WHEN fits THEN n + 1 ELSE n END FROM (SELECT r.*, used, n, n < 4 AND used + r.bytes <= 20000 AS fits FROM f JOIN r ON r.place = f.place AND r.k = f.k + 1))
SELECT place, pos, url, bytes, score FROM f WHERE fits""",
)
def x15(s, d):
    """Places of thirty pages each. What fits depends on what was taken before, so the SQL walks each place's pages by recursion."""
    k = F.col("page_id")
    url = F.concat("url", F.when(k % 4 == 0, "#specials").when(k % 4 == 1, "#food-menu").otherwise(""))
    p = t(s, d, "pages").select(F.floor(k / 30).alias("place"), k.alias("pos"), url.alias("url"), F.length("html").alias("bytes"))
    return budget.documents(p.withColumn("score", urls.url_score(F.col("url"))), 20_000, 4)


@query("w14_text_in_budget")
def w14(s, d):
    return budget.windows_of_text(t(s, d, "documents").select(F.col("doc_id").alias("id"), "text"), 4000).select("id", F.length("kept").alias("n"))


@query("x2_removal_order", "SELECT p_partkey FROM part ORDER BY p_size, p_brand, p_retailprice DESC NULLS LAST, p_partkey LIMIT 50")
def x2(s, d):
    return t(s, d, "part").orderBy("p_size", "p_brand", F.desc_nulls_last("p_retailprice"), "p_partkey").limit(50).select("p_partkey")


@query("x1_policy_crosstab", "SELECT c_nationkey AS city, policy, count(*) FILTER (WHERE CASE policy WHEN 'a' THEN c_acctbal > 0 ELSE c_acctbal > 5000 END) AS keep, count(*) FILTER (WHERE NOT CASE policy WHEN 'a' THEN c_acctbal > 0 ELSE c_acctbal > 5000 END) AS hide FROM customer, (VALUES ('a'), ('b')) v(policy) GROUP BY 1, 2")
def x1(s, d):
    both = t(s, d, "customer").withColumn("policy", F.explode(F.array(F.lit("a"), F.lit("b"))))
    keep = F.when(F.col("policy") == "a", F.col("c_acctbal") > 0).otherwise(F.col("c_acctbal") > 5000)
    return both.groupBy(F.col("c_nationkey").alias("city"), "policy").agg(F.count(F.when(keep, 1)).alias("keep"), F.count(F.when(~keep, 1)).alias("hide"))


@query("x3_root_causes", "SELECT cause, count(*) AS n FROM (SELECT CASE WHEN p_size < 5 THEN 'tiny' WHEN p_type LIKE 'S%' THEN 'type' WHEN p_retailprice > 1500 THEN 'dear' ELSE 'other' END AS cause FROM part) GROUP BY 1")
def x3(s, d):
    cause = gates.first_of((F.col("p_size") < 5, "tiny"), (F.col("p_type").like("S%"), "type"), (F.col("p_retailprice") > 1500, "dear"), otherwise="other")
    return t(s, d, "part").groupBy(cause.alias("cause")).agg(F.count(F.lit(1)).alias("n"))


@query("x8_tier_backfill", "SELECT s_suppkey, CASE WHEN s_nationkey % 2 = 0 THEN 'coarse' ELSE 'fine' END AS tier, greatest(s_nationkey % 3, 1) AS known FROM supplier")
def x8(s, d):
    return t(s, d, "supplier").select("s_suppkey", F.when(F.col("s_nationkey") % 2 == 0, "coarse").otherwise("fine").alias("tier"), F.greatest(F.col("s_nationkey") % 3, F.lit(1)).alias("known"))


@query("x18_reactivated", f"WITH {i.WINDOWS} SELECT c_custkey, CASE WHEN c_acctbal < 0 AND EXISTS (SELECT 1 FROM windows WHERE place = c_custkey AND active) THEN 'active' WHEN c_acctbal < 0 THEN 'no_happy_hour' ELSE 'active' END AS status FROM customer")
def x18(s, d):
    live = i.windows(s, d).where("active").select("place").distinct().withColumn("live", F.lit(True))
    stored = F.when(F.col("c_acctbal") < 0, "no_happy_hour").otherwise("active")
    return t(s, d, "customer").join(live, F.col("place") == F.col("c_custkey"), "left").select("c_custkey", F.when((stored == "no_happy_hour") & F.col("live"), "active").otherwise(stored).alias("status"))


@query("c33_reverted", "SELECT c_custkey AS id, CASE WHEN c_custkey % 5 = 1 THEN 'was' ELSE c_name END AS name, c_custkey % 5 <> 0 AS active, CASE WHEN c_custkey % 5 = 0 THEN 'reverted' END AS deleted_at FROM customer")
def c33(s, d):
    c = t(s, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.lit(True).alias("active"), F.lit(None).cast("string").alias("deleted_at"))
    log = t(s, d, "customer").where("c_custkey % 5 < 2").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 5 == 1, '{"name":"was"}').alias("before"))
    return tables.revert(c, log, "id", ["name"])


@query("r4_expired_flags", f"WITH {i.SUBMISSIONS} SELECT target, kind, epoch_us(TIMESTAMP '2024-01-31 00:00:00') - min(at_us) >= 14 * 86400000000 AS expired FROM submissions GROUP BY 1, 2")
def r4(s, d):
    now = F.unix_micros(F.lit("2024-01-31 00:00:00").cast("timestamp"))
    return i.submissions(s, d).groupBy("target", "kind").agg((now - F.min("at_us") >= 14 * 86_400_000_000).alias("expired"))
