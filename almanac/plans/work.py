"""Queries of readers and writers, work lists, decisions and publishing."""

from __future__ import annotations

from pyspark.sql import functions as F

from almanac.functions import geo, names, weekly
from almanac.operators import decisions, gates, spatial, tables, windows
from almanac.plans import inputs as i
from almanac.plans.catalogue import query
from almanac.plans.evaluated import PREPARED, W, _with_offers, prepared
from almanac.plans.texts import BRACKETS, CLEAN, CUT, NAMES, NORMAL, _list, matches, name_rows
from almanac.session import table
from almanac.sources import readers

t = table

# ---- readers and writers


@query("s3_geojson_features", """SELECT n_nationkey AS k, n_name AS name, 2 AS polygons, CAST(n_nationkey % 7 AS DOUBLE) AS x, 5 AS points FROM nation WHERE n_nationkey % 3 <> 2
UNION ALL SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 2 THEN NULL END, 1, CAST(n_nationkey % 7 AS DOUBLE), 5 FROM nation WHERE n_nationkey % 3 = 2""")
def s3(s, d):
    """Collections, features and bare geometries, as the reader's text."""
    k = F.col("n_nationkey")
    x = (k % 7).cast("string")
    ring = F.concat(F.lit("[["), x, F.lit(",0],["), x, F.lit(",1],[9,1],[9,0],["), x, F.lit(",0]]"))
    multi = F.concat(F.lit('{"type":"MultiPolygon","coordinates":[['), ring, F.lit("],["), ring, F.lit("]]}"))
    feature = F.concat(F.lit('{"type":"Feature","properties":{"name":"'), F.col("n_name"), F.lit('"},"geometry":'), multi, F.lit("}"))
    text = F.when(k % 3 == 0, F.concat(F.lit('{"type":"FeatureCollection","features":['), feature, F.lit("]}"))).when(k % 3 == 1, feature).otherwise(F.concat(F.lit('{"type":"Polygon","coordinates":['), ring, F.lit("]}")))
    found = readers.features(t(s, d, "nation").select("n_nationkey", text.alias("value")), "n_nationkey")
    return found.select(k.alias("k"), "name", F.size("shape").alias("polygons"), F.expr("shape[0][0][0].x").alias("x"), F.size(F.expr("shape[0][0]")).alias("points"))


LINE = "concat_ws(',', " + ", ".join(f"""(SELECT CASE WHEN regexp_matches(x, '[",]') THEN '"' || replace(x, '"', '""') || '"' ELSE x END FROM (SELECT regexp_replace(coalesce({c}, ''), '\\r?\\n', ' ', 'g') AS x))""" for c in ("text", "lang", "source")) + ")"


@query("s7_csv_lines", f"SELECT doc_id, {LINE} AS line FROM documents")
def s7(s, d):
    return t(s, d, "documents").select("doc_id", readers.csv_line(F.col("text"), F.col("lang"), F.col("source")).alias("line"))


@query("s9_markdown_rows", "SELECT '| ' || c_custkey || ' | ' || replace(c_name, '#', '\\|') || ' | ' || c_mktsegment || ' |' AS line FROM customer")
def s9(s, d):
    return readers.markdown_rows(t(s, d, "customer").select("c_custkey", F.replace("c_name", F.lit("#"), F.lit("|")).alias("n"), "c_mktsegment"))


@query("s10_report_round_trip", "SELECT c_custkey, c_name, CASE WHEN c_custkey % 5 <> 0 THEN c_acctbal END AS c_acctbal FROM customer")
def s10(s, d):
    rows = t(s, d, "customer").select("c_custkey", "c_name", F.when(F.col("c_custkey") % 5 != 0, F.col("c_acctbal")).alias("c_acctbal"))
    return readers.from_json_lines(readers.to_json_lines(rows), "c_custkey long, c_name string, c_acctbal double")


# ---- spatial deletes and probes

IN_AREA = "x >= west AND x <= west + 0.55 AND y >= south AND y <= south + 0.55"


@query("s12_boundary_probe", f"WITH {i.POINTS}, {i.AREAS} SELECT DISTINCT id FROM points JOIN areas USING (city) WHERE {IN_AREA}")
def s12(s, d):
    return spatial.near_shapes(i.points(s, d), i.areas(s, d), 0.0, same=("city",)).select("id").distinct()


@query("s18_delete_outside", f"WITH {i.POINTS}, {i.AREAS} SELECT id, city FROM points p WHERE EXISTS (SELECT 1 FROM areas a WHERE a.city = p.city AND {IN_AREA})")
def s18(s, d):
    """What stays if all points outside of their city's areas are deleted."""
    inside = spatial.near_shapes(i.points(s, d), i.areas(s, d), 0.0, same=("city",)).select("id")
    return i.points(s, d).join(inside, "id", "left_semi").select("id", "city")


@query("g13_crossover", f"WITH {i.POINTS}, {i.AREAS}, own AS (SELECT *, (city + 1) % 25 AS sibling FROM points) SELECT id, bool_or(coalesce({IN_AREA}, false)) AS crosses FROM own LEFT JOIN (SELECT city AS sibling, west, south FROM areas) USING (sibling) GROUP BY id")
def g13(s, d):
    p = i.points(s, d).withColumn("sibling", ((F.col("city") + 1) % 25).cast("int"))
    met = spatial.near_shapes(p, i.areas(s, d).select(F.col("city").alias("sibling"), "shape"), 0.0, same=("sibling",)).select("id").distinct()
    return p.join(met.withColumn("crosses", F.lit(True)), "id", "left").select("id", F.coalesce("crosses", F.lit(False)).alias("crosses"))


# ---- predicates, ranks, keys


@query("p6_optional_predicates", "SELECT event_id FROM events WHERE event_type = 'purchase' AND value > 50")
def p6(s, d):
    return decisions.where_all(t(s, d, "events"), F.col("event_type") == "purchase", None, F.col("value") > 50, None).select("event_id")


@query("j18_chain_registry", f"""WITH {NAMES}, r AS (SELECT unnest({_list(names.CHAINS)}) AS c), n AS (SELECT k, {NORMAL} AS n FROM names)
SELECT k, list_sort(list(DISTINCT c)) AS chains FROM n JOIN r ON n = c OR n LIKE c || ' %' OR n LIKE '% ' || c || ' %' OR n LIKE '% ' || c GROUP BY k""")
def j18(s, d):
    """Every run of a name's words is a key, so names meet the registry by an equi-join. The registry is a fixed list, so it and not
    the names, whose runs Spark can't estimate, goes to every task."""
    longest = max(c.count(" ") + 1 for c in names.CHAINS)
    word = F.split(names.normalised(F.col("name")), " ")
    runs = F.flatten(F.transform(F.sequence(F.lit(1), F.size("w")), lambda a: F.transform(F.sequence(F.lit(1), F.least(F.lit(longest), F.size("w") - a + 1)), lambda n: F.array_join(F.slice("w", a, n), " "))))
    spans = name_rows(s, d).where("name is not null").select("k", word.alias("w")).select("k", F.explode(F.array_distinct(runs)).alias("c"))
    registry = F.broadcast(s.createDataFrame([(c,) for c in names.CHAINS], "c string"))
    return spans.join(registry, "c").groupBy("k").agg(F.sort_array(F.collect_set("c")).alias("chains"))


@query("w4_top_five", "SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS r FROM events) WHERE r <= 5")
def w4(s, d):
    return tables.best_per(t(s, d, "events"), ["user_id"], F.desc("value"), F.asc("event_id"), n=5).select("user_id", "event_id", "value")


@query("w6_first_rule", "SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN 'dear' WHEN o_orderstatus = 'F' THEN 'done' WHEN o_orderpriority LIKE '1%' THEN 'urgent' ELSE 'plain' END AS rule FROM orders")
def w6(s, d):
    return t(s, d, "orders").select("o_orderkey", gates.first_of((F.col("o_totalprice") > 300000, "dear"), (F.col("o_orderstatus") == "F", "done"), (F.col("o_orderpriority").like("1%"), "urgent"), otherwise="plain").alias("rule"))


@query("f34_offer_fingerprint", f"WITH {i.OFFERS} SELECT id, string_agg(o, ';' ORDER BY o) AS fingerprint FROM (SELECT id, lower(trim(name)) || '|' || coalesce(CAST(cents AS VARCHAR), '') AS o FROM offers) GROUP BY id")
def f34(s, d):
    return i.offers(s, d).groupBy("id").agg(windows.offer_key(F.collect_list(F.struct("name", "cents"))).alias("fingerprint"))


# ---- times


@query("t11_opening_periods", """SELECT c_custkey AS k, CASE WHEN c_custkey % 7 = 0 THEN 7 ELSE c_custkey % 7 END AS open_day, 60 * (8 + c_custkey % 5) + CASE WHEN c_custkey % 2 = 0 THEN 30 ELSE 0 END AS open_min,
CASE WHEN c_custkey % 11 <> 0 THEN CASE WHEN (c_custkey + 1) % 7 = 0 THEN 7 ELSE (c_custkey + 1) % 7 END END AS close_day, CASE WHEN c_custkey % 11 <> 0 THEN 60 * (c_custkey % 4) END AS close_min FROM customer WHERE c_custkey % 13 <> 0""")
def t11(s, d):
    k = F.col("c_custkey")
    when = lambda day, hour, minute: F.struct(day.cast("int").alias("day"), hour.cast("int").alias("hour"), minute.cast("int").alias("minute"))
    period = F.struct(F.when(k % 13 != 0, when(k % 7, 8 + k % 5, F.when(k % 2 == 0, 30))).alias("open"), F.when(k % 11 != 0, when((k + 1) % 7, k % 4, F.lit(None))).alias("close"))
    return t(s, d, "customer").select(k.alias("k"), F.inline(weekly.opening_periods(F.array(period))))


@query("t15_expired", "SELECT event_id, (epoch_us(TIMESTAMP '2024-02-01') - epoch_us(ts)) / 86400000000.0 >= 14 AS expired FROM events")
def t15(s, d):
    age = (F.unix_micros(F.lit("2024-02-01").cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))) / 86_400_000_000
    return t(s, d, "events").select("event_id", (age >= 14).alias("expired"))


@query("t17_month_keys", "SELECT strftime(ts, '%Y-%m-01') AS month, sum(value) AS spent FROM events GROUP BY 1")
def t17(s, d):
    return t(s, d, "events").groupBy(F.date_format(F.date_trunc("month", "ts"), "yyyy-MM-dd").alias("month")).agg(F.sum("value").alias("spent"))


@query("r6_next_runs", """SELECT event_id, CASE WHEN date_trunc('day', ts) + INTERVAL 8 HOURS > ts THEN date_trunc('day', ts) + INTERVAL 8 HOURS ELSE date_trunc('day', ts) + INTERVAL 32 HOURS END AS daily,
CASE WHEN date_trunc('week', ts) + INTERVAL 9 HOURS > ts THEN date_trunc('week', ts) + INTERVAL 9 HOURS ELSE date_trunc('week', ts) + INTERVAL 177 HOURS END AS weekly FROM events""")
def r6(s, d):
    return t(s, d, "events").withColumn("r", decisions.next_runs(F.col("ts"))).select("event_id", *[F.col(f"r.{c}").cast("timestamp_ntz").alias(c) for c in ("daily", "weekly")])


@query("r3_daily_limit", f"""WITH {i.SUBMISSIONS}, n AS (SELECT id, fingerprint, ip, count(*) OVER (PARTITION BY fingerprint ORDER BY at_us RANGE BETWEEN 86399999999 PRECEDING AND CURRENT ROW) - 1 AS f, count(*) OVER (PARTITION BY ip ORDER BY at_us RANGE BETWEEN 86399999999 PRECEDING AND CURRENT ROW) - 1 AS p FROM submissions)
SELECT id, CASE WHEN fingerprint IS NOT NULL AND f >= 10 THEN 'fingerprint_day' WHEN ip IS NOT NULL AND p >= 20 THEN 'ip_day' END AS reason FROM n""")
def r3(s, d):
    from almanac.streaming.limits import daily_reason

    return daily_reason(i.submissions(s, d).select("id", F.col("at_us").alias("at"), "fingerprint", "ip")).select("id", "reason")


# ---- gates

FACTS = f"""{PREPARED}, {i.OFFERS}, o AS (SELECT id, count(*) AS n, avg(cents) FILTER (WHERE cents > 0) AS mean, count(*) FILTER (WHERE cents > 0) AS priced, min(cents) FILTER (WHERE cents > 0) AS low FROM offers GROUP BY id),
x AS (SELECT w.*, coalesce(n, 0) AS n, mean, coalesce(priced, 0) AS priced, low, end_ > start_ AS fwd FROM w LEFT JOIN o USING (id))"""


@query("c2_meal_signs", f"""{FACTS}, f AS (SELECT id, [CASE WHEN coalesce(mean > 1200 AND fwd AND start_ <= 720 AND end_ <= 960, false) THEN 'lunch_price' END, CASE WHEN coalesce(mean > 1200 AND fwd AND start_ >= 1020 AND end_ >= 1260, false) THEN 'dinner_price' END,
CASE WHEN coalesce(n >= 1 AND fwd AND start_ BETWEEN 660 AND 840 AND end_ <= 960, false) THEN 'midday' END, CASE WHEN priced BETWEEN 1 AND 2 AND low >= 3000 THEN 'costly' END] AS r FROM x) SELECT id, list_filter(r, lambda v: v IS NOT NULL) AS signs FROM f""")
def c2(s, d):
    none = F.lit(None).cast("string")
    drinks = F.transform("items", lambda o: F.struct(o["name"].alias("name"), o["description"].alias("description"), o["cents"].alias("cents"), F.lit("drink").alias("kind")))
    return _with_offers(s, d).select("id", gates.meal_signs(W(), drinks, none, none, F.col("periods")).alias("signs"))


@query("c3_bare_windows", f"{FACTS} SELECT id, coalesce(n = 0 AND fwd AND (end_ - start_ >= 360 OR start_ <= 720 AND end_ <= 960), false) AND id % 4 <> 0 AS suspect, n = 0 AND id % 4 <> 0 AS artifact FROM x")
def c3(s, d):
    notes = F.when(F.col("id") % 4 == 0, "Happy hour daily")
    return _with_offers(s, d).select("id", gates.bare_suspect(W(), F.col("items"), notes).alias("suspect"), gates.all_day_artifact(F.col("items"), notes).alias("artifact"))


STATUS = [200, 403, 404, 410, 411, 500, 200]


@query("c16_site_verdict", f"""WITH f AS (SELECT page_id, html || CASE WHEN page_id % 5 = 0 THEN 'This domain is parked' ELSE '' END AS html, list_extract({STATUS}, CAST(page_id % 7 + 1 AS INTEGER)) AS status,
  CASE page_id % 8 WHEN 0 THEN 'timeout' WHEN 1 THEN 'blocked' WHEN 2 THEN 'unreachable' ELSE 'response' END AS outcome FROM pages),
v AS (SELECT page_id, CASE WHEN outcome IN ('timeout', 'blocked') THEN 'stub' WHEN outcome = 'unreachable' OR status >= 500 OR status BETWEEN 404 AND 410 OR (status = 200 AND contains(lower(html), 'this domain is parked')) THEN 'kill' ELSE 'extract' END AS decision,
  CASE WHEN outcome IN ('timeout', 'blocked') THEN 'timeout' WHEN outcome = 'unreachable' OR status >= 500 OR status BETWEEN 404 AND 410 THEN 'dead' WHEN status = 200 AND contains(lower(html), 'this domain is parked') THEN 'parked' ELSE 'ok' END AS reachability FROM f)
SELECT page_id, decision, reachability, CASE WHEN page_id % 3 = 0 AND page_id % 10 > 5 THEN 'extract' ELSE decision END AS action FROM v""")
def c16(s, d):
    k = F.col("page_id")
    html = F.concat("html", F.when(k % 5 == 0, "This domain is parked").otherwise(""))
    status = F.element_at(F.array(*[F.lit(x) for x in STATUS]), (k % 7 + 1).cast("int"))
    outcome = F.when(k % 8 == 0, "timeout").when(k % 8 == 1, "blocked").when(k % 8 == 2, "unreachable").otherwise("response")
    v = t(s, d, "pages").select(k, decisions.site_verdict(outcome, status, html).alias("v"))
    return v.select(k, "v.decision", "v.reachability", decisions.enrich_action(F.when(k % 3 == 0, "none").otherwise("real"), k % 10 / 10.0, F.col("v.decision")).alias("action"))


RAWS = """'{"happyHours":[{"sourceUrl":"' || CASE WHEN c_custkey % 5 = 0 THEN ' ' WHEN c_custkey % 7 = 0 THEN 'https://sirved.com/x' ELSE 'https://a.com' END || '","daysOfWeek":[' || c_custkey % 9 || ',' || c_custkey % 9 || ',2.5],"startTime":"' || c_custkey % 27 || CASE WHEN c_custkey % 3 = 0 THEN 'pm' ELSE ':30' END ||
 '","allDay":' || CASE WHEN c_custkey % 11 = 0 THEN 'true' ELSE 'false' END || ',"locationWithinVenue":"' || CASE WHEN c_custkey % 2 = 0 THEN 'bar' ELSE 'roof' END || '"}],"confidence":' || (c_custkey % 4 - 1) || '}'"""


@query("c27_coerced_extracts", f"""WITH r AS (SELECT c_custkey AS k, CAST({RAWS} AS JSON) AS j FROM customer), w AS (SELECT k, j, trim(j->>'$.happyHours[0].sourceUrl') AS source, CAST(j->>'$.happyHours[0].daysOfWeek[0]' AS INTEGER) AS day, j->>'$.happyHours[0].startTime' AS told, (j->>'$.happyHours[0].allDay') = 'true' AS whole FROM r),
h AS (SELECT *, CASE WHEN ends_with(told, 'pm') THEN CASE WHEN CAST(replace(told, 'pm', '') AS INTEGER) <= 12 THEN CAST(replace(told, 'pm', '') AS INTEGER) % 12 * 60 + 720 END ELSE CASE WHEN CAST(split_part(told, ':', 1) AS INTEGER) < 24 THEN CAST(split_part(told, ':', 1) AS INTEGER) * 60 + 30 END END AS minute FROM w)
SELECT k, least(1.0, greatest(0.0, CAST(j->>'$.confidence' AS DOUBLE))) AS confidence, CASE WHEN source NOT IN ('', 'https://sirved.com/x') AND day BETWEEN 1 AND 7 THEN concat_ws('|', day, CASE WHEN NOT whole THEN CAST(minute AS VARCHAR) END, whole OR minute IS NULL, whole OR minute IS NOT NULL, CASE WHEN k % 2 = 0 THEN 'bar' ELSE 'all' END) END AS win FROM h""")
def c27(s, d):
    got = t(s, d, "customer").select(F.col("c_custkey").alias("k"), decisions.coerced(F.expr(RAWS)).alias("x"))
    w = F.get("x.windows", F.lit(0))
    told = F.concat_ws("|", F.array_join(w["days"], ","), w["start"].cast("string"), w["all_day"].cast("string"), w["time_known"].cast("string"), w["area"])
    return got.select("k", "x.confidence", F.when(w.isNotNull(), told).alias("win"))


TARGETS = ["venue", "happy_hour", "offering", "intent", "elsewhere"]
AFTER = "'{\"name\":\"x\",\"days\":1,' || CASE WHEN event_id % 2 = 0 THEN '\"sourceUrl\":\"https://a.com\",' ELSE '' END || '\"active\":true,\"status\":\"live\"}'"


@query("c32_change_verdicts", f"""WITH c AS (SELECT event_id, list_extract({_list(TARGETS)}, CAST(event_id % 5 + 1 AS INTEGER)) AS target, CASE WHEN event_id % 7 = 0 THEN 'applied' ELSE 'pending' END AS status, {AFTER} AS after, CASE WHEN event_id % 3 = 0 THEN 'https://b.com' END AS src FROM events),
v AS (SELECT *, CASE WHEN status = 'applied' THEN 'already_decided' WHEN target = 'elsewhere' THEN 'unknown_target' WHEN target <> 'venue' AND event_id % 2 <> 0 AND src IS NULL THEN 'no_source' ELSE 'apply' END AS verdict FROM c)
SELECT event_id, verdict, CASE WHEN verdict = 'apply' THEN array_to_string(list_filter(CASE target WHEN 'venue' THEN ['name', 'status'] WHEN 'offering' THEN ['name', 'sourceUrl', 'active'] ELSE ['active', 'sourceUrl'] END, lambda f: list_contains(json_keys(after), f)), ',') END AS fields FROM v""")
def c32(s, d):
    k = F.col("event_id")
    target = F.element_at(F.array(*[F.lit(x) for x in TARGETS]), (k % 5 + 1).cast("int"))
    v = decisions.change_verdict(target, F.when(k % 7 == 0, "applied").otherwise("pending"), F.expr(AFTER), F.when(k % 3 == 0, "https://b.com"))
    return t(s, d, "events").select(k, v.alias("v")).select(k, "v.verdict", F.array_join("v.fields", ",").alias("fields"))


# ---- work lists


@query("x4_candidate_scan", "SELECT p_partkey, p_type, p_size FROM part WHERE p_type = ANY(['PROMO', 'ECONOMY']) ORDER BY p_size DESC NULLS LAST, p_partkey LIMIT 50")
def x4(s, d):
    return t(s, d, "part").where(F.col("p_type").isin("PROMO", "ECONOMY")).orderBy(F.desc_nulls_last("p_size"), "p_partkey").select("p_partkey", "p_type", "p_size").limit(50)


@query("x6_spot_check", "SELECT c_custkey, c_name FROM customer WHERE c_acctbal > 0 AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') ORDER BY c_name, c_custkey LIMIT 40")
def x6(s, d):
    """Stubs (places without a live window) that have a site, the first by name."""
    live = t(s, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return t(s, d, "customer").where("c_acctbal > 0").join(live, "c_custkey", "left_anti").orderBy("c_name", "c_custkey").select("c_custkey", "c_name").limit(40)


@query("x9_name_backfill", f"WITH {NAMES}, n AS (SELECT k, name AS before, CASE WHEN {CUT} = name THEN name WHEN {CLEAN} = '' THEN trim(name) ELSE {CLEAN} END AS after FROM names) SELECT * FROM n WHERE before <> after")
def x9(s, d):
    return name_rows(s, d).select("k", F.col("name").alias("before"), names.without_promo(F.col("name")).alias("after")).where("before <> after")


@query("x13_audit_work_list", f"""WITH {i.WINDOWS}, {i.OFFERS}, o AS (SELECT id, list({{'line': line, 'name': name}} ORDER BY line, name) AS offers FROM offers GROUP BY id),
w AS (SELECT place, list({{'id': windows.id, 'all_day': all_day, 'offers': o.offers}} ORDER BY windows.id) AS windows FROM windows LEFT JOIN o USING (id) WHERE active GROUP BY place)
SELECT c_custkey AS place, n_name AS city, windows FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN w ON place = c_custkey WHERE c_mktsegment = 'BUILDING'""")
def x13(s, d):
    """One nested document for each flagged place, with its city, live windows and their offers."""
    lists = i.offers(s, d).groupBy("id").agg(F.sort_array(F.collect_list(F.struct("line", "name"))).alias("offers"))
    w = i.windows(s, d).where("active").select("place", "id", "all_day").join(lists, "id", "left")
    per = w.groupBy("place").agg(F.sort_array(F.collect_list(F.struct("id", "all_day", "offers"))).alias("windows"))
    flagged = t(s, d, "customer").where("c_mktsegment = 'BUILDING'").join(t(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return flagged.select(F.col("c_custkey").alias("place"), F.col("n_name").alias("city")).join(per, "place", "left")


@query("x16_reverify_pairs", """SELECT o_orderkey AS id, coalesce(CASE l.o_orderstatus WHEN 'F' THEN 'confirmed' WHEN 'O' THEN 'contradicted' END, 'unconfirmable') AS kind, CASE l.o_orderstatus WHEN 'F' THEN 'keep' WHEN 'O' THEN 'hide' ELSE 'review' END AS action FROM orders l""")
def x16(s, d):
    o = t(s, d, "orders")
    kind = F.when(F.col("o_orderstatus") == "F", "confirmed").otherwise("contradicted")
    told = o.where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("id"), kind.alias("kind"))
    return decisions.paired(o.select(F.col("o_orderkey").alias("id")), told, "id", lambda k: gates.first_of((k == "confirmed", "keep"), (k == "contradicted", "hide"), otherwise="review"))


# ---- reviews and publishing

REVIEWS = f"""{i.WINDOWS}, d AS (SELECT *, id % 19 = 0 AS deleted, CASE id % 10 WHEN 1 THEN 'delete' WHEN 2 THEN 'promote' WHEN 3 THEN 'keep' END AS asked FROM windows),
a AS (SELECT *, CASE WHEN NOT deleted AND NOT (asked = 'promote' AND active) THEN asked END AS action FROM d),
z AS (SELECT id, place, active AS before, action, CASE action WHEN 'delete' THEN false WHEN 'promote' THEN true ELSE active END AS active, deleted OR coalesce(action = 'delete', false) AS deleted FROM a)"""


def _reviewed(s, d):
    w = i.windows(s, d).select("id", "place", "active", (F.col("id") % 19 == 0).alias("deleted"))
    k = F.col("id") % 10
    asked = i.windows(s, d).select("id", F.when(k == 1, "delete").when(k == 2, "promote").when(k == 3, "keep").alias("action")).where("action is not null")
    p = t(s, d, "customer").select(F.col("c_custkey").alias("place"), F.when(F.col("c_custkey") % 2 == 0, "complete").otherwise("stub").alias("completeness"))
    return decisions.reviewed(w, p, asked)


@query("x28_reviewed_windows", f"WITH {REVIEWS} SELECT id, place, active, deleted FROM z")
def x28(s, d):
    return _reviewed(s, d)[0]


@query("x28_reviewed_places", f"""WITH {REVIEWS}, p AS (SELECT place, bool_or(coalesce(action = 'delete', false)) AS lost, bool_or(coalesce(action = 'promote', false)) AS won, bool_or(active AND NOT deleted) AS live FROM z GROUP BY place),
c AS (SELECT c_custkey AS place, CASE WHEN c_custkey % 2 = 0 THEN 'complete' ELSE 'stub' END AS was FROM customer)
SELECT place, CASE WHEN lost AND NOT live AND was = 'complete' THEN 'stub' WHEN won AND live AND was = 'stub' THEN 'complete' ELSE was END AS completeness FROM c LEFT JOIN p USING (place)""")
def x28_places(s, d):
    return _reviewed(s, d)[1]


@query("x28_review_marks", f"WITH {REVIEWS} SELECT id, action, before, active AS after FROM z WHERE action IS NOT NULL")
def x28_marks(s, d):
    return _reviewed(s, d)[2]


@query("x29_flag_review", """WITH f AS (SELECT s_suppkey AS place, CASE WHEN s_suppkey % 6 = 5 THEN 'agent_fixed' END AS was, CASE WHEN s_suppkey % 2 = 0 THEN 'old' END AS n, CASE WHEN s_acctbal < 0 THEN ['debt'] WHEN s_acctbal > 5000 THEN ['rich', 'odd'] ELSE [] END AS codes, s_suppkey % 4 AS a FROM supplier)
SELECT place, CASE a WHEN 0 THEN 'operator_kept' WHEN 1 THEN 'further_review' WHEN 2 THEN 'operator_stubbed' ELSE was END AS resolution, CASE a WHEN 0 THEN n WHEN 1 THEN 'look again' ELSE n END AS note,
CASE a WHEN 0 THEN 'kept: ' || coalesce(nullif(array_to_string(codes, ', '), ''), 'none') WHEN 1 THEN 'parked' WHEN 2 THEN 'hidden' END AS reason FROM f""")
def x29(s, d):
    k, b = F.col("s_suppkey"), F.col("s_acctbal")
    codes = F.when(b < 0, F.array(F.lit("debt"))).when(b > 5000, F.array(F.lit("rich"), F.lit("odd"))).otherwise(F.array().cast("array<string>"))
    flagged = t(s, d, "supplier").select(k.alias("place"), F.when(k % 6 == 5, "agent_fixed").alias("resolution"), F.when(k % 2 == 0, "old").alias("note"), codes.alias("codes"))
    asked = t(s, d, "supplier").where("s_suppkey % 4 <> 3").select(k.alias("place"), F.when(k % 4 == 0, "keep").when(k % 4 == 1, "park").otherwise("stub").alias("action"), F.when(k % 4 == 1, "look again").alias("remark"))
    return decisions.flag_reviewed(flagged, asked)


@query("x20_pushed_deletes", f"WITH {i.WINDOWS} SELECT id FROM windows WHERE NOT active AND place IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY')")
def x20(s, d):
    chosen = t(s, d, "customer").where("c_mktsegment = 'MACHINERY'").select(F.col("c_custkey").alias("place"))
    return i.windows(s, d).where("not active").join(chosen, "place", "left_semi").select("id")


@query("x21_published_subtree", f"""WITH {i.WINDOWS}, {i.OFFERS}, {i.AREAS}, p AS (SELECT c_custkey AS place, c_nationkey AS city FROM customer WHERE c_custkey % 40 = 7), w AS (SELECT id FROM windows WHERE place IN (SELECT place FROM p))
SELECT 'areas' AS part, area AS key FROM areas WHERE city IN (SELECT city FROM p) UNION ALL SELECT 'places', place FROM p UNION ALL SELECT 'windows', id FROM w UNION ALL SELECT 'offers', id * 10 + line FROM offers WHERE id IN (SELECT id FROM w)""")
def x21(s, d):
    """Publishing takes the chosen places; which ones are chosen is the caller's, here those of a list."""
    p = t(s, d, "customer").select(F.col("c_custkey").alias("place"), F.col("c_nationkey").alias("city"))
    parts = decisions.subtree(p, i.areas(s, d), i.windows(s, d), i.offers(s, d), F.col("place") % 40 == 7)
    key = {"areas": F.col("area"), "places": F.col("place"), "windows": F.col("id"), "offers": F.col("id") * 10 + F.col("line")}
    rows = [parts[name].select(F.lit(name).alias("part"), k.cast("long").alias("key")) for name, k in key.items()]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


@query("x24_localities", f"WITH {i.AREAS} SELECT area, n_name || ' ' || tier AS name FROM areas JOIN nation ON n_nationkey = city WHERE cos(radians(south + 0.275)) * 111.195 * 111.195 * 0.55 * 0.55 >= 2900")
def x24(s, d):
    """Localities of a list as JSON, those of some size: square kilometres of a rectangle on the local plane."""
    a = i.areas(s, d).join(t(s, d, "nation"), F.col("n_nationkey") == F.col("city"))
    config = a.select("shape", F.to_json(F.struct("area", F.concat_ws(" ", "n_name", "tier").alias("name"))).alias("j")).withColumn("c", F.from_json("j", "area long, name string"))
    ring = F.expr("shape[0][0]")
    wide, high = F.array_max(F.transform(ring, lambda p: p["x"])) - F.array_min(F.transform(ring, lambda p: p["x"])), F.array_max(F.transform(ring, lambda p: p["y"])) - F.array_min(F.transform(ring, lambda p: p["y"]))
    middle = F.array_min(F.transform(ring, lambda p: p["y"])) + high / 2
    return config.where(F.cos(F.radians(middle)) * 111.195 * 111.195 * wide * high >= 2900).select("c.area", "c.name")
