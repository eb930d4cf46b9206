"""Queries over weekly windows, names, addresses, gates, shapes, limits and text."""

from __future__ import annotations

from pyspark.sql import functions as F

from almanac.functions import geo, names, signals, urls, weekly
from almanac.operators import gates, spatial, text_windows, windows
from almanac.operators.windows import window_struct
from almanac.plans import inputs as i
from almanac.plans.catalogue import query
from almanac.session import table
from almanac.streaming import limits

t = table

# ---- weekly windows; "now" is day id % 7 + 1, minute id * 17 % 1440

PREPARED = f"""WITH {i.WINDOWS}, {i.HOURS}, w AS (
  SELECT windows.*, periods, id % 7 + 1 AS day, id * 17 % 1440 AS minute,
    CASE WHEN end_ <= start_ THEN end_ + 1440 ELSE end_ END AS end_on, end_ < start_ AS crosses FROM windows JOIN hours USING (place))"""
OPEN_NOW = """coalesce(len(list_filter(periods, lambda p: CASE WHEN p.close_day = p.open_day AND p.close_min > p.open_min
  THEN day = p.open_day AND minute >= p.open_min AND minute < p.close_min
  ELSE day = p.open_day AND minute >= p.open_min OR day = p.close_day AND minute < p.close_min END)) > 0, false)"""


def prepared(s, d):
    w = i.windows(s, d).join(i.hours(s, d), "place")
    return w.withColumn("day", (F.col("id") % 7 + 1).cast("int")).withColumn("minute", (F.col("id") * 17 % 1440).cast("int"))


def W():
    return window_struct()


def _column(name):
    return lambda: F.col(name)


DAY, MINUTE, PERIODS, START, END = map(_column, ("day", "minute", "periods", "start", "end"))


@query("t1_local_now", "SELECT event_id, isodow(z) AS iso_day, CAST(hour(z) * 60 + minute(z) AS INTEGER) AS minutes, strftime(z, '%H:%M') AS hhmm FROM (SELECT event_id, timezone(CASE event_id % 3 WHEN 0 THEN 'America/Los_Angeles' WHEN 1 THEN 'Europe/Berlin' ELSE 'Asia/Kolkata' END, timezone('UTC', ts)) AS z FROM events)")
def t1(s, d):
    zone = F.when(F.col("event_id") % 3 == 0, "America/Los_Angeles").when(F.col("event_id") % 3 == 1, "Europe/Berlin").otherwise("Asia/Kolkata")
    return t(s, d, "events").select("event_id", weekly.local_now(zone, F.col("ts")).alias("n")).select("event_id", "n.*")


@query("t2_open_now", f"{PREPARED} SELECT id, {OPEN_NOW} AS is_open FROM w")
def t2(s, d):
    return prepared(s, d).select("id", weekly.open_at(PERIODS(), DAY(), MINUTE()).alias("is_open"))


@query(
    "t3_window_active",
    f"""{PREPARED} SELECT id, coalesce(CASE WHEN all_day OR start_ IS NULL OR end_ IS NULL THEN
    {OPEN_NOW} AND list_contains(days, day) AND CASE WHEN all_day THEN true WHEN start_ IS NULL THEN minute < end_ ELSE minute >= start_ END
  WHEN crosses THEN list_contains(days, day) AND minute >= start_ OR list_contains(days, (day + 5) % 7 + 1) AND minute < end_
  ELSE list_contains(days, day) AND minute >= start_ AND minute < end_ END, false) AS runs FROM w""",
)
def t3(s, d):
    return prepared(s, d).select("id", weekly.active(W(), DAY(), MINUTE(), PERIODS()).alias("runs"))


@query(
    "t4_next_start",
    f"""{PREPARED}, bounds AS (SELECT id, o, day, minute, days, start_, (day - 1 + o) % 7 + 1 AS iso, periods FROM w, range(0, 8) r(o)),
st AS (SELECT id, o, minute, coalesce(start_, list_min(list_transform(list_filter(periods, lambda p: p.open_day = iso), lambda p: p.open_min))) AS s FROM bounds WHERE list_contains(days, iso))
SELECT id, min(o * 10000 + s) // 10000 AS "offset", min(o * 10000 + s) % 10000 AS start FROM st WHERE s IS NOT NULL AND (o > 0 OR s > minute) GROUP BY id""",
)
def t4(s, d):
    """An all-day or open window starts when the place opens; in this data what closes is always known."""
    found = weekly.next_start(F.array(W()), DAY(), MINUTE(), PERIODS())
    return prepared(s, d).select("id", found.alias("n")).where("n is not null").select("id", F.col("n.offset").cast("long").alias("offset"), F.col("n.start").cast("long").alias("start"))


@query(
    "t5_bounds_of_day",
    f"""{PREPARED}, o AS (SELECT *, list_filter(periods, lambda p: p.open_day = day) AS own FROM w)
SELECT id, CASE WHEN all_day OR start_ IS NULL THEN own[1].open_min ELSE start_ END AS start, CASE WHEN all_day OR end_ IS NULL THEN own[1].close_min ELSE end_ END AS "end"
FROM o WHERE (all_day OR start_ IS NULL OR end_ IS NULL) AND len(own) > 0""",
)
def t5(s, d):
    return prepared(s, d).select("id", weekly.bounds_on(W(), PERIODS(), DAY()).alias("b")).where("b is not null").select("id", F.col("b.start").cast("long").alias("start"), F.col("b.end").cast("long").alias("end"))


@query("t6_minutes_left", f"{PREPARED} SELECT id, CASE WHEN all_day OR end_ IS NULL THEN NULL WHEN start_ IS NOT NULL AND crosses AND list_contains(days, day) AND minute >= start_ THEN 1440 - minute + end_ ELSE end_ - minute END AS left_ FROM w")
def t6(s, d):
    return prepared(s, d).select("id", weekly.minutes_left(W(), DAY(), MINUTE()).cast("long").alias("left_"))


@query(
    "t7_format_days",
    f"""WITH {i.WINDOWS}, runs AS (SELECT id, day, day - row_number() OVER (PARTITION BY id ORDER BY day) AS run FROM (SELECT id, unnest(days) AS day FROM windows)),
r AS (SELECT id, min(day) AS a, max(day) AS b FROM runs GROUP BY id, run), n AS (SELECT ['Mon', 'Tue', 'Wed', 'Thu', 'Fri', 'Sat', 'Sun'] AS l)
SELECT id, string_agg(CASE WHEN a = b THEN l[a] ELSE l[a] || '–' || l[b] END, ', ' ORDER BY a) AS label FROM r, n GROUP BY id""",
)
def t7(s, d):
    return i.windows(s, d).select("id", weekly.format_days(F.col("days")).alias("label"))


_TIME = lambda x: f"CASE WHEN {x} IS NULL THEN 'close' ELSE CASE WHEN {x} // 60 % 12 = 0 THEN '12' ELSE CAST({x} // 60 % 12 AS VARCHAR) END || CASE WHEN {x} % 60 = 0 THEN '' ELSE ':' || lpad(CAST({x} % 60 AS VARCHAR), 2, '0') END || CASE WHEN {x} // 60 >= 12 THEN ' PM' ELSE ' AM' END END"


@query("t8_format_window", f"WITH {i.WINDOWS} SELECT id, CASE WHEN all_day THEN 'Open to close' WHEN start_ IS NULL THEN 'Open until ' || {_TIME('end_')} ELSE {_TIME('start_')} || ' – ' || {_TIME('end_')} END AS label FROM windows")
def t8(s, d):
    return i.windows(s, d).select("id", weekly.format_window(W()).alias("label"))


@query("t8_format_price", f"WITH {i.OFFERS} SELECT id, line, cents, '$' || (cents // 100) || CASE WHEN cents % 100 = 0 THEN '' ELSE '.' || lpad(CAST(cents % 100 AS VARCHAR), 2, '0') END AS price FROM offers")
def t8p(s, d):
    return i.offers(s, d).select("id", "line", "cents", weekly.format_price(F.col("cents")).alias("price"))


@query("t9_durations", f"WITH {i.WINDOWS} SELECT id, CASE WHEN end_ <= start_ THEN end_ + 1440 - start_ ELSE end_ - start_ END AS whole, CASE WHEN end_ < start_ THEN end_ + 1440 - start_ ELSE end_ - start_ END AS zero, coalesce(end_ < start_, false) AS crosses FROM windows")
def t9(s, d):
    return i.windows(s, d).select("id", weekly.duration(START(), END()).alias("whole"), weekly.duration_or_zero(START(), END()).alias("zero"), weekly.crosses_midnight(START(), END()).alias("crosses"))


@query("t14_implausible", f"WITH {i.WINDOWS} SELECT id FROM windows WHERE CASE WHEN end_ >= start_ THEN end_ - start_ > 510 ELSE end_ + 1440 - start_ > 360 END")
def t14(s, d):
    return i.windows(s, d).where(weekly.implausible(START(), END())).select("id")


@query("t16_due_again", "SELECT o_orderkey FROM orders WHERE o_orderdate < TIMESTAMP '2000-01-01 00:00:00' - INTERVAL 60 DAY AND o_orderstatus = 'O'")
def t16(s, d):
    return t(s, d, "orders").where("o_orderdate < timestamp_ntz '2000-01-01 00:00:00' - interval 60 days and o_orderstatus = 'O'").select("o_orderkey")


@query("t18_spend_tier", "SELECT c_custkey, CASE WHEN c_custkey >= 2000 THEN 'stage1_only' WHEN c_custkey >= 1500 THEN 'critical_only' ELSE 'normal' END AS tier, NOT (c_custkey + 5 > 2000 OR c_custkey >= 1500 AND c_mktsegment <> 'BUILDING') AS allowed FROM customer")
def t18(s, d):
    spent, risk = F.col("c_custkey"), F.when(F.col("c_mktsegment") == "BUILDING", "critical").otherwise("low")
    return t(s, d, "customer").select("c_custkey", gates.spend_tier(spent).alias("tier"), gates.may_verify(spent, risk).alias("allowed"))


@query("t19_trust_score", "WITH RECURSIVE e AS (SELECT user_id, value > 60 AS ok, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events), r AS (SELECT user_id, 0 AS k, 0 AS score FROM (SELECT DISTINCT user_id FROM events) UNION ALL SELECT e.user_id, CAST(e.k AS INTEGER), greatest(-100, least(100, score + CASE WHEN ok THEN 5 ELSE -10 END)) FROM r JOIN e ON e.user_id = r.user_id AND e.k = r.k + 1) SELECT user_id, arg_max(score, k) AS score FROM r GROUP BY user_id")
def t19(s, d):
    """Held at every step, so the order counts: a user's outcomes are folded in order of time."""
    ordered = t(s, d, "events").groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("ts", "event_id", (F.col("value") > 60).alias("ok")))).alias("e"))
    return ordered.select("user_id", gates.trust_score(F.transform("e", lambda x: x["ok"])).alias("score"))


@query("t20_price_level", f"WITH {i.OFFERS} SELECT id, line, repeat('$', CAST(least(4, ceil(cents / 700)) AS INTEGER)) AS tier FROM offers")
def t20(s, d):
    return i.offers(s, d).select("id", "line", F.expr("repeat('$', cast(least(4, ceil(cents / 700)) as int))").alias("tier"))


@query("t21_accuracy", "SELECT user_id, CAST(CASE WHEN count(*) > 0 THEN floor(100.0 * count(*) FILTER (WHERE value > 50) / count(*) + 0.5) ELSE 0 END AS INTEGER) AS rate FROM events GROUP BY user_id")
def t21(s, d):
    n = t(s, d, "events").groupBy("user_id").agg(F.count(F.when(F.col("value") > 50, 1)).alias("a"), F.count(F.when(~(F.col("value") > 50), 1)).alias("b"))
    return n.select("user_id", gates.accuracy(F.col("a"), F.col("b")).alias("rate"))


# ---- names and texts


@query("f1_normalised", "SELECT p_partkey, trim(regexp_replace(replace(lower(p_name), '''', ''), '[^a-z0-9]+', ' ', 'g')) AS name, regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS slug FROM part")
def f1(s, d):
    return t(s, d, "part").select("p_partkey", names.normalised(F.col("p_name")).alias("name"), names.slug(F.col("p_name")).alias("slug"))


@query("f3_place_suffix", "SELECT c_custkey, right(regexp_replace(lower(c_name), '[^a-z0-9]', '', 'g'), 6) AS suffix FROM customer")
def f3(s, d):
    return t(s, d, "customer").select("c_custkey", names.place_suffix(F.col("c_name")).alias("suffix"))


@query("f5_area_key", "SELECT p_partkey, list_aggregate(list_filter(string_split_regex(lower(p_name), '[^a-z0-9]+'), lambda x: x <> ''), 'string_agg', '') AS key FROM part")
def f5(s, d):
    return t(s, d, "part").select("p_partkey", names.area_key(F.col("p_name")).alias("key"))


@query("f6_near_keys", "SELECT DISTINCT a.p_name AS first, b.p_name AS second FROM (SELECT DISTINCT p_name, split_part(p_name, ' ', 1) AS h FROM part) a JOIN (SELECT DISTINCT p_name, split_part(p_name, ' ', 1) AS h FROM part) b ON a.h = b.h AND a.p_name < b.p_name AND levenshtein(a.p_name, b.p_name) <= 1 AND length(a.p_name) >= 6 AND length(b.p_name) >= 6")
def f6(s, d):
    n = t(s, d, "part").select("p_name").distinct().withColumn("h", F.substring_index("p_name", " ", 1))
    return n.alias("a").join(n.alias("b"), (F.col("a.h") == F.col("b.h")) & (F.col("a.p_name") < F.col("b.p_name")) & names.near_keys(F.col("a.p_name"), F.col("b.p_name"))).select(F.col("a.p_name").alias("first"), F.col("b.p_name").alias("second"))


@query("f10_domains", "WITH h AS (SELECT page_id, regexp_replace(lower(regexp_extract(url, '^https?://([^/?#:]+)', 1)), '^www\\.', '') AS host FROM pages) SELECT page_id, host, regexp_extract(host, '([^.]+\\.[^.]+)$', 1) AS domain FROM h")
def f10(s, d):
    h = urls.host(F.col("url"))
    return t(s, d, "pages").select("page_id", h.alias("host"), urls.registrable(h).alias("domain"))


@query("f9_normalised_url", "SELECT page_id, CASE WHEN regexp_matches(url, '^https?://[^/?#]+$') THEN url || '/' ELSE url END AS url FROM pages")
def f9(s, d):
    return t(s, d, "pages").select("page_id", urls.normalise_url(F.col("url")).alias("url"))


@query("f32_page_kind", "WITH p AS (SELECT page_id, list_filter(string_split(regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1), '/'), lambda x: x <> '') AS g FROM pages) SELECT page_id, CASE WHEN len(g) = 0 THEN 'static' WHEN len(g) = 4 AND g[3] = 'venue' THEN 'venue' WHEN len(g) = 3 THEN 'area' WHEN len(g) = 2 THEN 'city' ELSE 'static' END AS kind FROM p")
def f32(s, d):
    return t(s, d, "pages").select("page_id", urls.page_kind(F.col("url"))["kind"].alias("kind"))


@query("f15_signals", "SELECT doc_id, regexp_matches(text, '(?i)\\bspecials?\\b|drink\\s*deals?|\\bdaily\\b') AS deal, len(regexp_extract_all(regexp_replace(text, '(?i)https?://\\S+', ' ', 'g'), '\\$\\s?\\d+(?:\\.\\d{2})?')) AS prices FROM documents")
def f15(s, d):
    return t(s, d, "documents").select("doc_id", F.col("text").rlike(r"(?i)\bspecials?\b|drink\s*deals?|\bdaily\b").alias("deal"), signals.price_count(F.col("text")).cast("long").alias("prices"))


@query("f17_machine_text", "WITH s AS (SELECT doc_id, text[1:3000] AS x FROM documents) SELECT doc_id, length(x) >= 200 AND ((length(x) - length(replace(x, ' ', ''))) / length(x) < 0.08 OR (length(x) - length(translate(x, '{}[]=;|/\\_', ''))) / length(x) > 0.08) AS machine FROM s")
def f17(s, d):
    return t(s, d, "documents").select("doc_id", signals.machine_text(F.col("text")).alias("machine"))


@query("f20_links", "SELECT page_id, unnest(regexp_extract_all(html, '(?i)<a\\b[^>]*?\\bhref\\s*=\\s*[\"'']([^\"'']+)[\"'']', 1)) AS link FROM pages")
def f20(s, d):
    return t(s, d, "pages").select("page_id", F.explode(urls.links(F.col("html"))).alias("link"))


@query("f42_salted_hash", "SELECT user_id, substr(sha256('salt:' || user_id), 1, 32) AS hash FROM (SELECT DISTINCT user_id FROM events)")
def f42(s, d):
    return t(s, d, "events").select("user_id").distinct().select("user_id", names.salted_hash("salt", F.col("user_id").cast("string")).alias("hash"))


@query("f44_model_cost", "SELECT o_orderkey, CAST(ceil((o_orderkey * 10.0 * CASE o_orderkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 15 ELSE 3 END + o_custkey * 100.0 * CASE o_orderkey % 3 WHEN 0 THEN 5 WHEN 1 THEN 75 ELSE 15 END) / 1e6 * CASE WHEN o_orderkey % 2 = 0 THEN 50 ELSE 100 END) AS BIGINT) AS cents FROM orders")
def f44(s, d):
    k = F.col("o_orderkey")
    model = F.when(k % 3 == 0, "a-haiku").when(k % 3 == 1, "an-OPUS").otherwise("other")
    return t(s, d, "orders").select("o_orderkey", gates.model_cents(model, k * 10, F.col("o_custkey") * 100, k % 2 == 0).alias("cents"))


# ---- gates


@query("c5_operating_hours", f"WITH {i.WINDOWS}, {i.HOURS}, {i.OPERATING} SELECT id, operating FROM operating")
def c5(s, d):
    return prepared(s, d).select("id", weekly.operating_hours(W(), PERIODS()).alias("operating"))


@query("c6_reconcile")
def c6(s, d):
    """No SQL: five passes, each over what the one before left; held against a plain version in the tests."""
    return windows.reconcile(i.windows(s, d).where("active"), i.hours(s, d))


@query(
    "c7_superseded",
    f"""WITH {i.WINDOWS}, {i.OFFERS}, n AS (SELECT id, count(*) FILTER (WHERE active AND cents > 4000) AS n FROM offers GROUP BY id),
w AS (SELECT windows.*, coalesce(n, 0) AS n, CASE WHEN all_day THEN 0 ELSE start_ END AS a,
  CASE WHEN all_day THEN 1440 WHEN start_ IS NULL THEN NULL WHEN end_ IS NULL THEN 1440 WHEN end_ <= start_ THEN end_ + 1440 ELSE end_ END AS b FROM windows LEFT JOIN n USING (id)),
gone AS (SELECT x.place, x.id FROM w x WHERE n = 0 AND a IS NOT NULL AND NOT EXISTS (SELECT 1 FROM (SELECT unnest(x.days) AS d) q WHERE NOT EXISTS (
  SELECT 1 FROM w y WHERE y.place = x.place AND y.n > 0 AND list_contains(y.days, q.d) AND y.a <= x.a AND y.b >= x.b AND NOT (x.area <> 'all' AND y.area <> 'all' AND x.area <> y.area))))
SELECT place, id FROM gone UNION ALL
SELECT x.place, x.id FROM w x WHERE n = 0 AND area <> 'all' AND id NOT IN (SELECT id FROM gone) AND EXISTS (
  SELECT 1 FROM w y WHERE y.place = x.place AND y.id <> x.id AND y.n = 0 AND y.area = 'all' AND y.id NOT IN (SELECT id FROM gone) AND y.days = x.days
    AND y.start_ IS NOT DISTINCT FROM x.start_ AND y.end_ IS NOT DISTINCT FROM x.end_ AND y.all_day = x.all_day)""",
)
def c7(s, d):
    n = i.offers(s, d).where("active and cents > 4000").groupBy("id").agg(F.count(F.lit(1)).alias("n_offers"))
    return windows.superseded(i.windows(s, d).join(n, "id", "left").withColumn("n_offers", F.coalesce("n_offers", F.lit(0))))


def _with_offers(s, d):
    lists = i.offers(s, d).groupBy("id").agg(F.sort_array(F.collect_list(F.struct("line", "name", F.lit(None).cast("string").alias("description"), "cents", "kind"))).alias("items"))
    w = prepared(s, d).join(lists, "id", "left")
    return w.withColumn("items", F.coalesce("items", F.array().cast(lists.schema["items"].dataType)))


@query(
    "c1_realness",
    f"""{PREPARED}, {i.OFFERS}, o AS (SELECT id, count(*) AS n, avg(cents) FILTER (WHERE cents > 0) AS mean, count(*) FILTER (WHERE cents > 0) AS priced, min(cents) FILTER (WHERE cents > 0) AS low FROM offers GROUP BY id),
x AS (SELECT w.*, coalesce(n, 0) AS n, mean, coalesce(priced, 0) AS priced, low, end_ > start_ AS fwd, id % 10 / 10.0 AS confidence, NOT all_day AS known FROM w LEFT JOIN o USING (id)),
f AS (SELECT id, [CASE WHEN all_day AND len(days) >= 3 THEN 'all_day_many_days' END,
  CASE WHEN all_day AND len(days) < 3 AND n = 0 THEN 'bare_non_hh_window' END, CASE WHEN NOT known THEN 'no_time_window' END,
  CASE WHEN confidence < 0.5 AND NOT (known AND n > 0) THEN 'low_confidence' END,
  CASE WHEN coalesce(mean > 1200 AND fwd AND (start_ <= 720 AND end_ <= 960 OR start_ >= 1020 AND end_ >= 1260), false) OR coalesce(n >= 1 AND fwd AND start_ BETWEEN 660 AND 840 AND end_ <= 960, false) OR priced BETWEEN 1 AND 2 AND low >= 3000 THEN 'meal_special' END,
  CASE WHEN coalesce(n = 0 AND fwd AND (end_ - start_ >= 360 OR start_ <= 720 AND end_ <= 960), false) THEN 'bare_non_hh_window' END,
  CASE WHEN coalesce(CASE WHEN end_ >= start_ THEN end_ - start_ > 510 ELSE end_ + 1440 - start_ > 360 END, false) THEN 'implausible_window_duration' END] AS r FROM x)
SELECT id, list_filter(r, lambda v: v IS NOT NULL) AS reasons FROM f""",
)
def c1(s, d):
    """All offers of this data are drinks or food at once, so no window is a menu that runs to the close."""
    none = F.lit(None).cast("string")
    kindless = F.transform("items", lambda o: F.struct(o["name"].alias("name"), o["description"].alias("description"), o["cents"].alias("cents"), F.lit("drink").alias("kind")))
    return _with_offers(s, d).select("id", gates.realness(W(), kindless, none, none, PERIODS(), F.col("id") % 10 / 10.0, ~F.col("all_day")).alias("reasons"))


@query("c9_offer_junk", "SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 'price-as-name' WHEN p_partkey % 5 = 1 THEN 'ecommerce-chrome' WHEN p_partkey % 5 = 2 THEN 'nav-boilerplate' WHEN p_partkey % 5 = 3 AND p_size > 25 THEN 'bare-soft-drink' END AS rule FROM part")
def c9(s, d):
    k = F.col("p_partkey")
    name = F.when(k % 5 == 0, F.concat(F.lit("$"), (k % 90).cast("string"), F.lit(".50"))).when(k % 5 == 1, "Add to cart now").when(k % 5 == 2, "Menu / Gift Cards").when(k % 5 == 3, "Large Iced Tea").otherwise(F.concat(F.lit("draft "), F.col("p_name")))
    kind = F.when(F.col("p_size") > 25, "drink").otherwise("food")
    return t(s, d, "part").select("p_partkey", gates.offer_junk(name, F.lit(None).cast("long"), F.lit(None).cast("string"), kind).alias("rule"))


@query("c8_sanitised")
def c8(s, d):
    items = F.transform("items", lambda o: F.struct(o["name"].alias("name"), o["cents"].alias("cents"), o["description"].alias("description"), o["kind"].alias("kind"), F.lit("other").alias("category")))
    return _with_offers(s, d).select("id", F.explode(gates.sanitised(items, F.col("days"), F.lit(2))).alias("o")).select("id", F.col("o.pos").alias("pos"), "o.verdict", F.size("o.warnings").alias("n_warnings"))


@query(
    "c18_flag_decision",
    f"""WITH {i.SUBMISSIONS}, g AS (SELECT target, kind, count(DISTINCT coalesce(fingerprint, CAST(id AS VARCHAR))) FILTER (WHERE vote = 'confirm') AS c, count(DISTINCT coalesce(fingerprint, CAST(id AS VARCHAR))) FILTER (WHERE vote = 'deny') AS x, min(ts) AS opened FROM (SELECT * REPLACE (id // 20 AS target) FROM submissions) GROUP BY 1, 2)
SELECT target, kind, CASE WHEN x >= 3 THEN 'rejected' WHEN c >= 5 THEN 'confirmed' WHEN epoch_us(TIMESTAMP '2024-01-31 00:00:00') - epoch_us(opened) >= 14 * 86400000000 THEN 'expired' ELSE 'pending' END AS decision FROM g""",
)
def c18(s, d):
    """Every vote, on small targets of twenty events each, so that all four decisions are met."""
    return flag_decisions(i.submissions(s, d).withColumn("target", F.floor(F.col("id") / 20)))


@query(
    "c18_flag_decision_whole",
    f"""WITH {i.SUBMISSIONS}, g AS (SELECT target, kind, count(DISTINCT coalesce(fingerprint, CAST(id AS VARCHAR))) FILTER (WHERE vote = 'confirm') AS c, count(DISTINCT coalesce(fingerprint, CAST(id AS VARCHAR))) FILTER (WHERE vote = 'deny') AS x, min(ts) AS opened FROM submissions GROUP BY 1, 2)
SELECT target, kind, CASE WHEN x >= 3 THEN 'rejected' WHEN c >= 5 THEN 'confirmed' WHEN epoch_us(TIMESTAMP '2024-01-31 00:00:00') - epoch_us(opened) >= 14 * 86400000000 THEN 'expired' ELSE 'pending' END AS decision FROM g""",
)
def c18_whole(s, d):
    """Every vote, on a few targets with many votes each."""
    return flag_decisions(i.submissions(s, d))


def flag_decisions(votes):
    voter = F.coalesce("fingerprint", F.col("id").cast("string"))
    n = lambda v: F.count_distinct(F.when(F.col("vote") == v, voter))
    g = votes.groupBy("target", "kind").agg(n("confirm").alias("c"), n("deny").alias("x"), F.min("ts").alias("opened"))
    decision = gates.flag_decision(F.col("kind"), F.col("c"), F.col("x"), F.col("opened").cast("timestamp"), F.lit("2024-01-31 00:00:00").cast("timestamp"))
    return g.select("target", "kind", decision.alias("decision"))


@query("c17_discovery_ladder", "SELECT p_partkey, CASE WHEN p_partkey % 11 = 0 THEN 'closed' WHEN p_partkey % 7 = 0 THEN 'chain' WHEN p_partkey % 5 = 0 THEN 'format' WHEN p_partkey % 4 = 0 THEN 'place-type' WHEN p_size = 1 THEN 'airport' WHEN p_size < 25 THEN 'low-signal' WHEN p_size > 45 THEN 'out-of-area' END AS reason FROM part")
def c17(s, d):
    k, none = F.col("p_partkey"), F.array().cast("array<string>")
    status = F.when(k % 11 == 0, "CLOSED_TEMPORARILY").otherwise("OPERATIONAL")
    name = F.when(k % 7 == 0, "McDonald’s #5").when(k % 5 == 0, "Big Buffet").otherwise(F.concat(F.lit("Joes "), F.col("p_name")))
    primary = F.when(k % 4 == 0, "bakery").otherwise("restaurant")
    reason = gates.drop_reason(status, name, F.lit(None).cast("string"), primary, none, F.col("p_size") == 1, F.col("p_size"), F.col("p_size") <= 45, F.lit(False))
    return t(s, d, "part").select("p_partkey", reason.alias("reason"))


@query("c14_stub_actions", "SELECT p_partkey, CASE WHEN p_size % 3 = 0 AND p_size % 2 = 0 THEN 'delete' WHEN p_partkey % 2 = 0 THEN 'keep' WHEN p_size % 2 = 1 THEN 'delete' WHEN p_partkey % 3 = 0 THEN 'hide' ELSE 'keep' END AS action FROM part")
def c14(s, d):
    k, z = F.col("p_partkey"), F.col("p_size")
    primary = F.when(k % 2 == 0, "pub").when(k % 3 == 0, "korean_restaurant").otherwise("restaurant")
    site = F.when(z % 2 == 0, F.when(z % 3 == 0, "http://a.menu11.com/x").otherwise("http://own.com"))
    return t(s, d, "part").select("p_partkey", gates.stub_action(F.lit("Zed"), primary, F.array().cast("array<string>"), site, F.lit("ok"), False).alias("action"))


@query("c15_site_health", "SELECT o_orderkey, CASE WHEN o_orderkey % 6 = 0 THEN 'expired_cert' WHEN o_orderkey % 6 = 1 THEN 'dns_dead' WHEN o_orderkey % 6 = 2 THEN 'parked' WHEN o_orderkey % 6 = 3 THEN 'blocked' WHEN o_orderkey % 6 = 4 THEN 'http_error' ELSE 'ok' END AS health FROM orders")
def c15(s, d):
    m = F.col("o_orderkey") % 6
    error = F.when(m == 0, "cert_has_expired").when(m == 1, "ENOTFOUND")
    status = F.when(m == 3, 403).when(m == 4, 500).otherwise(200)
    final = F.when(m == 2, "http://x.sedoparking.com/").otherwise("http://own.com/")
    return t(s, d, "orders").select("o_orderkey", gates.probe_health(status, error, final, F.lit("http://own.com")).alias("health"))


@query("c20_verdict_action", "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'correct' WHEN 1 THEN CASE WHEN o_orderkey % 5 BETWEEN 1 AND 2 THEN 'keep' ELSE 'stub' END WHEN 2 THEN CASE WHEN o_custkey % 2 = 0 THEN 'stub' ELSE 'delete_venue' END ELSE 'stub' END AS action FROM orders")
def c20(s, d):
    k = F.col("o_orderkey")
    kind = F.element_at(F.array(*map(F.lit, ("real_window", "legit_all_day", "not_happy_hour", "unconfirmable"))), (k % 4 + 1).cast("int"))
    return t(s, d, "orders").select("o_orderkey", gates.verdict_action(kind, k % 5, F.col("o_custkey") % 2 == 0).alias("action"))


@query("c35_risk_level", "SELECT event_id, CASE WHEN value >= 75 THEN 'critical' WHEN value >= 50 THEN 'high' WHEN value >= 25 THEN 'medium' ELSE 'low' END AS risk FROM events")
def c35(s, d):
    return t(s, d, "events").select("event_id", gates.risk_level(F.col("value")).alias("risk"))


@query("c10_audit")
def c10(s, d):
    """Codes per place; held against fixtures in the tests."""
    from almanac.operators.audit import audit

    source = F.when(F.col("id") % 3 == 0, "https://other.com/").when(F.col("id") % 3 == 1, "https://own.com/events/2019/x").otherwise("https://sub.own.com/shop/1")
    items = F.transform("items", lambda o: F.struct(o["kind"].alias("kind"), o["name"].alias("name"), o["description"].alias("description"), o["cents"].alias("cents")))
    w = _with_offers(s, d).withColumn("items", items).withColumn("source", source).withColumn("notes", F.when(F.col("id") % 10 == 0, "days assumed"))
    sites = i.hours(s, d).withColumn("website", F.lit("https://www.own.com/"))
    return audit(w.select("place", "pos", "days", "start", "end", "all_day", "active", "offers", "area", "suspect", "items", "source", "notes"), sites, 2024)


# ---- shapes


@query("g1_distance", f"WITH {i.POINTS} SELECT id, round(2 * 3958.8 * asin(least(1.0, sqrt(pow(sin(radians(y - 38) / 2), 2) + cos(radians(38)) * cos(radians(y)) * pow(sin(radians(x + 121) / 2), 2)))), 6) AS miles FROM points")
def g1(s, d):
    return i.points(s, d).select("id", F.round(geo.miles(F.lit(38.0), F.lit(-121.0), F.col("y"), F.col("x")), 6).alias("miles"))


@query("g2_points_in_areas", f"WITH {i.POINTS}, {i.AREAS} SELECT id, area FROM points JOIN areas USING (city) WHERE x > west AND x < west + 0.55 AND y > south AND y < south + 0.55")
def g2(s, d):
    """Points inside; those on an edge are in no area."""
    met = spatial.near_shapes(i.points(s, d), i.areas(s, d), 0.0, same=("city",))
    return met.where(~geo.on_edge(F.col("x"), F.col("y"), F.col("shape"))).select("id", "area")


@query(
    "g14_assigned_areas",
    f"""WITH {i.POINTS}, {i.AREAS}, m AS (SELECT id, area, 111195.0 * sqrt(pow(greatest(west - x, 0, x - west - 0.55) * cos(radians(y)), 2) + pow(greatest(south - y, 0, y - south - 0.55), 2)) AS metres FROM points JOIN areas USING (city)),
r AS (SELECT *, row_number() OVER w AS k, lead(metres) OVER w AS second FROM m WHERE metres <= 1609 WINDOW w AS (PARTITION BY id ORDER BY metres, area)),
a AS (SELECT id, area, CASE WHEN metres <= 100 THEN 'snap' ELSE 'wide' END AS stage FROM r WHERE k = 1 AND (metres <= 100 OR second IS NULL OR second >= 2 * metres OR second - metres >= 500))
SELECT id, area, stage FROM points LEFT JOIN a USING (id)""",
)
def g14(s, d):
    """No two of these areas are within snapping reach of a point, so the nearest is also the best."""
    return spatial.assign(i.points(s, d), i.areas(s, d))


@query("g8_cardinal_parts", "SELECT n_nationkey AS id, z.zone, CAST(z.west AS DOUBLE) AS west, CAST(z.east AS DOUBLE) AS east FROM nation, (VALUES ('South', 0.0, 3.0), ('West', 0.0, 1.0), ('Central', 1.0, 2.0), ('East', 2.0, 3.0), ('North', 0.0, 3.0)) z(zone, west, east)")
def g8(s, d):
    box = [F.lit(v) for v in (0.0, 0.0, 3.0, 3.0)]
    return t(s, d, "nation").select(F.col("n_nationkey").alias("id"), F.inline(geo.cardinal_parts(*box))).select("id", "zone", "west", "east")


@query("g9_tiles", "SELECT CAST(i * 0.5 + 0.25 AS DOUBLE) AS x, CAST(j * 0.5 + 0.25 AS DOUBLE) AS y FROM range(0, 4) a(i), range(0, 2) b(j)")
def g9(s, d):
    return s.range(1).select(F.inline(geo.tiles(F.lit(0.0), F.lit(0.0), F.lit(2.0), F.lit(1.0), 0.5)))


@query("g10_quadtree")
def g10(s, d):
    tile = s.range(1).select(F.lit(-122.0).alias("x0"), F.lit(37.0).alias("y0"), F.lit(2.0).alias("size"))
    return spatial.quadtree(tile, i.points(s, d).select("x", "y"), 60, 4)


@query("g11_near_airports", f"WITH {i.POINTS}, a AS (SELECT x AS ax, y AS ay FROM points WHERE id % 50 = 0) SELECT p.id, EXISTS (SELECT 1 FROM a WHERE 2 * 3958.8 * 1609.344 * asin(least(1.0, sqrt(pow(sin(radians(ay - y) / 2), 2) + cos(radians(y)) * cos(radians(ay)) * pow(sin(radians(ax - x) / 2), 2)))) <= 1500) AS near FROM points p")
def g11(s, d):
    p = i.points(s, d).select("id", F.col("y").alias("lat"), F.col("x").alias("lng"))
    return spatial.near_any(p, p.where("id % 50 = 0"), 1500.0).select("id", "near")


@query("j14_without_near_match", f"WITH {i.POINTS}, r AS (SELECT * FROM points WHERE id % 3 = 0), l AS (SELECT * FROM points WHERE id % 3 <> 0) SELECT l.id FROM l WHERE NOT EXISTS (SELECT 1 FROM r WHERE 2 * 3958.8 * 1609.344 * asin(least(1.0, sqrt(pow(sin(radians(r.y - l.y) / 2), 2) + cos(radians(l.y)) * cos(radians(r.y)) * pow(sin(radians(r.x - l.x) / 2), 2)))) <= 400)")
def j14(s, d):
    p = i.points(s, d).select("id", F.col("y").alias("lat"), F.col("x").alias("lng"), F.lit("same name").alias("name"))
    return spatial.without_near_match(p.where("id % 3 <> 0"), p.where("id % 3 = 0"), 400.0, 50.0).select("id")


@query("g15_name_clusters")
def g15(s, d):
    keys = t(s, d, "part").select((F.col("p_partkey") % 5).cast("string").alias("city"), names.area_key(F.col("p_name")).alias("key"))
    return spatial.clusters(keys.groupBy("city", "key").agg(F.count(F.lit(1)).alias("venues")))


# ---- limits and event time


_BEFORE = lambda key, days, extra="true": f"sum(CASE WHEN parent IS NULL AND {extra} THEN 1 ELSE 0 END) OVER (PARTITION BY {key} ORDER BY at_us RANGE BETWEEN {days} * 86400000000 PRECEDING AND CURRENT ROW) - CASE WHEN parent IS NULL AND {extra} THEN 1 ELSE 0 END"


@query(
    "r1_stored_limits",
    f"""WITH {i.SUBMISSIONS} SELECT id, CASE WHEN fingerprint IS NOT NULL AND {_BEFORE('fingerprint', 1)} >= 10 THEN 'fingerprint_day' WHEN fingerprint IS NOT NULL AND {_BEFORE('fingerprint', 7)} >= 30 THEN 'fingerprint_week'
WHEN ip IS NOT NULL AND {_BEFORE('ip', 1)} >= 20 THEN 'ip_day' WHEN ip IS NOT NULL AND {_BEFORE('ip', 7)} >= 60 THEN 'ip_week' WHEN email IS NOT NULL AND {_BEFORE('email', 1)} >= 10 THEN 'email_day'
WHEN risk = 'critical' AND fingerprint IS NOT NULL AND {_BEFORE('fingerprint', 1, "risk = 'critical'")} >= 2 THEN 'critical_day' END AS reason FROM submissions""",
)
def r1(s, d):
    return limits.limit_reason(i.submissions(s, d).withColumn("at", F.col("at_us"))).select("id", "reason")


@query(
    "r2_sliding_limiter",
    """WITH RECURSIVE e AS (SELECT user_id AS key, event_id AS id, epoch_us(ts) // 600000 AS "at" FROM events), n AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY "at", id) AS k FROM e),
w AS (SELECT key, id, "at", k, true AS allowed, ["at"] AS held FROM n WHERE k = 1
UNION ALL SELECT key, id, "at", k, few, CASE WHEN few THEN list_append(held, "at") ELSE held END FROM (SELECT n.key, n.id, n."at", n.k, held, len(list_filter(held, lambda t: n."at" - t < 60000)) < 10 AND len(list_filter(held, lambda t: n."at" - t < 3600000)) < 30 AS few FROM w JOIN n ON n.key = w.key AND n.k = w.k + 1))
SELECT key, id, "at", allowed FROM w""",
)
def r2(s, d):
    """Blocked attempts use nothing up, so no window function can state it; the SQL walks each key's attempts by recursion."""
    e = t(s, d, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("id"), F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 600_000).alias("at"))
    return limits.sliding(e)


@query("r5_bursts", f"WITH {i.SUBMISSIONS}, e AS (SELECT regexp_replace(ip, '[0-9]+$', '0/24') AS block, target, unnest(range(0, 7)) AS k, date_trunc('day', ts) AS day FROM submissions WHERE risk = 'critical' AND ip IS NOT NULL) SELECT block, day - k * INTERVAL 1 DAY AS since, count(DISTINCT target) AS targets, count(*) AS submissions FROM e GROUP BY 1, 2 HAVING count(DISTINCT target) > 3")
def r5(s, d):
    got = limits.bursts(i.submissions(s, d).select("ip", "target", "risk", F.col("ts").cast("timestamp").alias("at")))
    return got.select("block", F.col("since").cast("timestamp_ntz").alias("since"), F.col("targets").cast("long").alias("targets"), "submissions")


@query("r7_first_votes", f"WITH {i.SUBMISSIONS} SELECT DISTINCT target, kind, fingerprint FROM submissions")
def r7(s, d):
    keys = ["target", "kind", "fingerprint"]
    return limits.first_votes(i.submissions(s, d).select(*keys), keys)


@query("spark_tumbling_counts", "SELECT time_bucket(INTERVAL 6 HOUR, ts) AS since, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def tumbling(s, d):
    return limits.tumbling(t(s, d, "events"), "6 hours").withColumn("total", F.round("total", 4))


@query("spark_sessions", "WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 12 HOUR THEN 0 ELSE 1 END AS new_ FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), n AS (SELECT *, sum(new_) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS since, max(ts) + INTERVAL 12 HOUR AS until, count(*) AS n FROM n GROUP BY user_id, k")
def sessions(s, d):
    return limits.sessions(t(s, d, "events"), "12 hours")


# ---- text windows


@query(
    "c26_parsed_windows",
    "SELECT doc_id AS id, CASE doc_id % 3 WHEN 0 THEN [1, 2, 3, 4, 5] WHEN 1 THEN [6, 7] ELSE [1, 2, 3, 4, 5, 6, 7] END AS days, CAST(60 * (13 + doc_id % 5) AS INTEGER) AS start, CAST(60 * (16 + doc_id % 5) AS INTEGER) AS \"end\", true AS clean, CAST(1 + doc_id % 2 AS INTEGER) AS n_offers FROM documents",
)
def c26(s, d):
    """Windows told in whole documents, each of which ends in a sentence about an offer hour; their own texts tell of none."""
    k = F.col("doc_id")
    days = F.when(k % 3 == 0, "Mon-Fri").when(k % 3 == 1, "Sat & Sun").otherwise("daily")
    offers = F.when(k % 2 == 1, ", $5 draft beer, half-price appetizers").otherwise(", $5 draft beer")
    said = F.concat(F.coalesce("text", F.lit("")), F.lit(". Happy hour "), days, F.lit(" "), (k % 5 + 1).cast("string"), F.lit("-"), (k % 5 + 4).cast("string"), F.lit("pm"), offers)
    return text_windows.parse(t(s, d, "documents").select(k.alias("id"), said.alias("text"))).select("id", F.inline("windows")).select("id", "days", "start", "end", "clean", F.size("offers").alias("n_offers"))
