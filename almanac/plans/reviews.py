"""Queries over decisions of review and plans over tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from almanac.operators import gates, review, tables
from almanac.operators.windows import window_struct
from almanac.plans import inputs as i
from almanac.plans.catalogue import query
from almanac.session import table

t = table


def _none(kind="string"):
    return F.lit(None).cast(kind)


def _no(kind):
    return F.array().cast(f"array<{kind}>")


@query("c22_hidden_window_action", f"WITH {i.WINDOWS}, {i.HOURS}, {i.OPERATING} SELECT id, CASE WHEN id % 2 = 1 AND (operating OR id % 3 = 0) THEN 'delete' ELSE 'keep_hidden' END AS action FROM windows JOIN operating USING (id) WHERE NOT active")
def c22(s, d):
    """Every hidden window. Those of even key say what they are; of the others, opening hours and windows of a meal page go."""
    w = i.windows(s, d).join(i.hours(s, d), "place").where("not active")
    source = F.when(F.col("id") % 3 == 0, "https://a.com/lunch").otherwise("https://a.com/")
    notes = F.when(F.col("id") % 2 == 0, "Happy hour!")
    why = review.delete_evidence(window_struct(), F.col("periods"), source, notes, F.lit(0))
    return w.select("id", F.when(why.isNotNull(), "delete").otherwise("keep_hidden").alias("action"))


@query("c28_evidence_files", f"WITH {i.SUBMISSIONS}, f AS (SELECT target, max(ts) AS newest, bool_or(kind = 'purchase') AS cited, bool_or(vote = 'confirm' AND kind = 'view') AS alive FROM (SELECT * REPLACE (id // 3 AS target) FROM submissions) GROUP BY target) SELECT target, CASE WHEN cited OR alive THEN 'keep' WHEN epoch_us(TIMESTAMP '2024-02-20 00:00:00') - epoch_us(newest) >= 30 * 86400000000 THEN 'delete' ELSE 'keep' END AS action FROM f")
def c28(s, d):
    """Every event, as files of three events each."""
    return evidence_files(i.submissions(s, d).withColumn("target", F.floor(F.col("id") / 3)))


@query("c28_evidence_files_whole", f"WITH {i.SUBMISSIONS}, f AS (SELECT target, max(ts) AS newest, bool_or(kind = 'purchase') AS cited, bool_or(vote = 'confirm' AND kind = 'view') AS alive FROM submissions GROUP BY target) SELECT target, CASE WHEN cited OR alive THEN 'keep' WHEN epoch_us(TIMESTAMP '2024-02-20 00:00:00') - epoch_us(newest) >= 30 * 86400000000 THEN 'delete' ELSE 'keep' END AS action FROM f")
def c28_whole(s, d):
    """Every event, as a few files of many events each."""
    return evidence_files(i.submissions(s, d))


def evidence_files(votes):
    status = F.when((F.col("vote") == "confirm") & (F.col("kind") == "view"), "applied").otherwise("rejected")
    f = votes.groupBy("target").agg(F.max("ts").alias("newest"), F.bool_or(F.col("kind") == "purchase").alias("cited"), F.collect_set(status).alias("statuses"))
    at = F.col("newest").cast("timestamp")
    return f.select("target", review.evidence_file(F.col("cited"), F.col("statuses"), at, at, F.lit("2024-02-20 00:00:00").cast("timestamp")).alias("action"))


@query("c4_all_day_rescue", f"WITH {i.WINDOWS}, v AS (SELECT *, bool_or(active AND all_day AND len(days) < 3) OVER (PARTITION BY place) AS shows FROM windows) SELECT id FROM v WHERE NOT active AND all_day AND offers <> '' AND len(days) < 3 AND shows")
def c4(s, d):
    from pyspark.sql import Window as W

    shows = F.bool_or(F.col("active") & F.col("all_day") & (F.size("days") < 3)).over(W.partitionBy("place"))
    w = i.windows(s, d).withColumn("shows", shows).where("not active")
    rescued = gates.all_day_rescue(F.array(F.lit("no_time_window")), window_struct(), (F.col("offers") != "").cast("int"), F.col("shows"))
    return w.where(rescued).select("id")


@query("c23_persist_decision", f"WITH {i.WINDOWS}, x AS (SELECT *, start_ IS NULL AND end_ IS NULL AS real_, area = 'patio' AS prov FROM windows), o AS (SELECT place, start_, end_ FROM windows WHERE NOT active GROUP BY ALL) SELECT x.id, NOT suspect AND NOT real_ AND NOT prov AND o.place IS NULL AS shown FROM x LEFT JOIN o ON o.place = x.place AND o.start_ IS NOT DISTINCT FROM x.start_ AND o.end_ IS NOT DISTINCT FROM x.end_ WHERE x.active")
def c23(s, d):
    """Shown only if no gate objects and the key was not taken down before."""
    w = i.windows(s, d)
    gone = w.where("not active").select("place", "start", "end").distinct().withColumn("gone", F.lit(True)).alias("b")
    j = w.where("active").alias("a").join(gone, tables.equal(["place", "start", "end"]), "left")
    doubtful = F.col("a.suspect") | (F.col("a.start").isNull() & F.col("a.end").isNull()) | (F.col("a.area") == "patio")
    return j.select("a.id", (~doubtful & F.col("gone").isNull()).alias("shown"))


@query("x14_chain_gaps", f"WITH {i.WINDOWS}, p AS (SELECT c_custkey AS place, c_custkey // 3 AS chain FROM customer), c AS (SELECT DISTINCT place // 3 AS chain, days, start_, end_ FROM windows) SELECT p.place, c.days, c.start_ AS start, c.end_ AS \"end\" FROM p JOIN c USING (chain) WHERE NOT EXISTS (SELECT 1 FROM windows w WHERE w.active AND w.place = p.place AND w.days = c.days AND w.start_ IS NOT DISTINCT FROM c.start_ AND w.end_ IS NOT DISTINCT FROM c.end_)")
def x14(s, d):
    """Chains of three places: what any of their windows says and one of them lacks."""
    w, chain = i.windows(s, d), lambda key: F.floor(F.col(key) / 3).alias("chain")
    places = t(s, d, "customer").select(F.col("c_custkey").alias("place"), chain("c_custkey"))
    chains = w.select(chain("place"), "days", "start", "end").distinct()
    return review.chain_gaps(places, chains, w.where("active"))


@query("x19_new_offers", f"WITH {i.OFFERS}, n AS (SELECT DISTINCT id, name, cents FROM offers WHERE kind = 'food') SELECT id, name, cents FROM n WHERE NOT EXISTS (SELECT 1 FROM offers o WHERE o.kind = 'drink' AND o.id = n.id AND o.name = n.name AND o.cents IS NOT DISTINCT FROM n.cents)")
def x19(s, d):
    o = i.offers(s, d)
    return review.new_offers(o.where("kind = 'food'").withColumn("name", F.concat(F.lit(" "), "name")), o.where("kind = 'drink'"))


@query("x22_undercaptured", f"WITH {i.WINDOWS}, p AS (SELECT doc_id AS place, len(regexp_extract_all(regexp_replace(text || repeat(' $5', CAST(doc_id % 9 AS INTEGER)), '(?i)https?://\\S+', ' ', 'g'), '\\$\\s?\\d+(?:\\.\\d{{2}})?')) AS prices FROM documents) SELECT doc_id AS place, 1 + doc_id % 4 AS captured, prices FROM documents JOIN p ON p.place = doc_id WHERE prices >= 4 AND prices > 1 + doc_id % 4 + 2")
def x22(s, d):
    docs = t(s, d, "documents")
    windows = docs.select(F.col("doc_id").alias("place"), F.lit("u").alias("url"), (1 + F.col("doc_id") % 4).alias("n_offers"))
    fetched = docs.select(F.col("doc_id").alias("place"), F.lit("u").alias("url"), F.concat("text", F.repeat(F.lit(" $5"), (F.col("doc_id") % 9).cast("int"))).alias("text"))
    return review.undercaptured(windows, fetched)


@query("x25_place_details", f"WITH {i.WINDOWS}, {i.OFFERS}, {i.SUBMISSIONS}, o AS (SELECT id, count(*) AS n FROM offers WHERE active GROUP BY id), w AS (SELECT place, count(*) AS windows, CAST(coalesce(sum(n), 0) AS BIGINT) AS offers FROM windows LEFT JOIN o USING (id) GROUP BY place), g AS (SELECT target, count(*) AS signals FROM submissions GROUP BY target) SELECT c_custkey AS place, n_name AS city, coalesce(windows, 0) AS windows, coalesce(offers, 0) AS offers, coalesce(signals, 0) AS signals FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN w ON w.place = c_custkey LEFT JOIN g ON target = c_custkey")
def x25(s, d):
    """All windows of a place, live or not, with their active offers; the listing shows live ones only."""
    w = tables.nested(i.windows(s, d), "id", items=(i.offers(s, d).where("active"), ["line", "name", "cents"]))
    places = t(s, d, "customer").select(F.col("c_custkey").alias("place"), F.col("c_nationkey").alias("k")).join(t(s, d, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("city")), "k", "left")
    doc = tables.nested(places, "place", ws=(w, ["id", "days", "start", "end", "active", "items"]))
    votes = i.submissions(s, d).groupBy(F.col("target").alias("place")).agg(F.count(F.lit(1)).alias("signals"))
    n = F.aggregate("ws", F.lit(0).cast("long"), lambda a, x: a + F.size(x["items"]))
    return doc.join(votes, "place", "left").select("place", "city", F.size("ws").cast("long").alias("windows"), n.alias("offers"), F.coalesce("signals", F.lit(0)).alias("signals"))


@query("x5_candidates_by_either_key", "SELECT s_suppkey AS id, coalesce(a.c_custkey, b.c_custkey) AS candidate FROM supplier LEFT JOIN customer a ON a.c_custkey = s_suppkey * 10 LEFT JOIN (SELECT c_nationkey, min(c_custkey) AS c_custkey FROM customer GROUP BY 1) b ON b.c_nationkey = s_nationkey")
def x5(s, d):
    """By the row it became, else by the place's outside key; the two are not interchangeable."""
    c = t(s, d, "customer")
    a = c.select((F.col("c_custkey") / 10).alias("id"), F.col("c_custkey").alias("x"))
    b = c.groupBy(F.col("c_nationkey").alias("s_nationkey")).agg(F.min("c_custkey").alias("y"))
    return t(s, d, "supplier").withColumn("id", F.col("s_suppkey").cast("double")).join(a, "id", "left").join(b, "s_nationkey", "left").select(F.col("s_suppkey").alias("id"), F.coalesce("x", "y").alias("candidate"))


@query("x11_listed_removals", "SELECT c_custkey AS id, c_custkey NOT IN (SELECT s_suppkey FROM supplier) AS active FROM customer")
def x11(s, d):
    listed = t(s, d, "supplier").select(F.col("s_suppkey").alias("c_custkey"), F.lit(True).alias("hit"))
    return t(s, d, "customer").join(listed, "c_custkey", "left").select(F.col("c_custkey").alias("id"), F.col("hit").isNull().alias("active"))


@query("x12_all_day_windows", f"WITH {i.WINDOWS} SELECT id, c_name AS place, n_name AS city FROM windows JOIN customer ON c_custkey = place JOIN nation ON n_nationkey = c_nationkey WHERE all_day")
def x12(s, d):
    return i.windows(s, d).where("all_day").join(t(s, d, "customer"), F.col("c_custkey") == F.col("place")).join(t(s, d, "nation"), F.col("n_nationkey") == F.col("c_nationkey")).select("id", F.col("c_name").alias("place"), F.col("n_name").alias("city"))


@query("x30_rejected_if_undecided", f"WITH {i.SUBMISSIONS} SELECT id, CASE WHEN vote = 'confirm' THEN 'applied' ELSE 'rejected' END AS status FROM submissions")
def x30(s, d):
    decided = F.when(F.col("vote") == "confirm", "applied")
    return i.submissions(s, d).select("id", F.coalesce(decided, F.lit("rejected")).alias("status"))


@query("x27_by_slug", "SELECT c_custkey FROM customer WHERE lower(c_name) = (SELECT min(lower(c_name)) FROM customer)")
def x27(s, d):
    c = t(s, d, "customer").withColumn("slug", F.lower("c_name"))
    return c.join(F.broadcast(c.agg(F.min("slug").alias("slug"))), "slug").select("c_custkey")
