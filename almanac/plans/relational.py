"""Scans, predicates, joins, aggregates, ranking and set operations."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from almanac.operators import tables
from almanac.plans import inputs as i
from almanac.plans.catalogue import query
from almanac.session import table

t = table
LATEST = "TIMESTAMP '2024-01-20 00:00:00'"


# ---- scans and sinks


@query("s1_project", "SELECT c_custkey AS id, c_name AS name FROM customer")
def s1(s, d):
    return t(s, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))


@query("s2_insertable_columns", "SELECT * EXCLUDE (n_chars), length(text) AS n_chars FROM documents")
def s2(s, d):
    docs = t(s, d, "documents")
    generated = {"n_chars": F.length("text").cast("long")}
    return docs.select(*[c for c in docs.columns if c not in generated], *[e.alias(c) for c, e in generated.items()])


@query("s11_values", "SELECT * FROM (VALUES (1, 'bar'), (2, 'pub'), (3, NULL)) v(id, name)")
def s11(s, d):
    return s.range(1).select(F.inline(F.arrays_zip(F.array(*map(F.lit, (1, 2, 3))).alias("id"), F.array(F.lit("bar"), F.lit("pub"), F.lit(None).cast("string")).alias("name"))).alias("id", "name"))


@query("s13_insert_absent", "SELECT s_suppkey AS id, s_name AS name FROM supplier UNION ALL SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier)")
def s13(s, d):
    old = t(s, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    return tables.insert_absent(old, t(s, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")), ["id"])


@query("s14_upsert", "SELECT coalesce(n.c_custkey, o.s_suppkey) AS id, coalesce(n.c_name, o.s_name) AS name, CASE WHEN n.c_custkey IS NOT NULL THEN n.c_acctbal ELSE o.s_acctbal END AS balance FROM supplier o FULL JOIN (SELECT * FROM customer WHERE c_custkey % 3 = 0) n ON n.c_custkey = o.s_suppkey")
def s14(s, d):
    old = t(s, d, "supplier").selectExpr("s_suppkey as id", "s_name as name", "s_acctbal as balance")
    return tables.upsert(old, t(s, d, "customer").where("c_custkey % 3 = 0").selectExpr("c_custkey as id", "c_name as name", "c_acctbal as balance"), ["id"])


@query("s15_or_merge", "SELECT coalesce(n.p_partkey, o.s_suppkey) AS id, coalesce(o.s_suppkey % 2 = 0, false) OR coalesce(n.p_size > 25, false) AS flag FROM supplier o FULL JOIN part n ON n.p_partkey = o.s_suppkey")
def s15(s, d):
    old = t(s, d, "supplier").selectExpr("s_suppkey as id", "s_suppkey % 2 = 0 as flag")
    return tables.upsert(old, t(s, d, "part").selectExpr("p_partkey as id", "p_size > 25 as flag"), ["id"], {"flag": tables.either("flag")})


@query("s16_set_union", "SELECT user_id, list_sort(list(DISTINCT h)) AS hashes FROM (SELECT user_id, event_type AS h FROM events WHERE event_id % 2 = 0 UNION ALL SELECT user_id, event_type || '!' FROM events WHERE event_id % 2 = 1) GROUP BY user_id")
def s16(s, d):
    e = t(s, d, "events")
    sets = lambda df, c: df.groupBy("user_id").agg(F.collect_set(c).alias("hashes"))
    return tables.upsert(sets(e.where("event_id % 2 = 0"), F.col("event_type")), sets(e.where("event_id % 2 = 1"), F.concat("event_type", F.lit("!"))), ["user_id"], {"hashes": tables.joined_set("hashes")})


@query("s17_update_from", "SELECT c.c_custkey, CASE WHEN s.s_suppkey IS NOT NULL THEN s.s_nationkey ELSE c.c_nationkey END AS c_nationkey, s.s_suppkey IS NOT NULL AND s.s_nationkey IS DISTINCT FROM c.c_nationkey AS changed FROM customer c LEFT JOIN supplier s ON s.s_suppkey = c.c_custkey")
def s17(s, d):
    source = t(s, d, "supplier").selectExpr("s_suppkey as c_custkey", "s_nationkey as c_nationkey")
    return tables.update_from(t(s, d, "customer").select("c_custkey", "c_nationkey"), source, ["c_custkey"], "c_nationkey")


@query("s19_soft_delete", f"WITH {i.WINDOWS} SELECT id, active AND area <> 'patio' AS active, CASE WHEN active AND area = 'patio' THEN TIMESTAMP '2024-01-01 00:00:00' END AS deleted_at FROM windows")
def s19(s, d):
    hide = F.col("active") & (F.col("area") == "patio")
    return i.windows(s, d).select("id", (F.col("active") & ~hide).alias("active"), F.when(hide, F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")).alias("deleted_at"))


@query("s20_audit_rows", "SELECT c_custkey, '{\"c_mktsegment\":\"' || c_mktsegment || '\"}' AS before, '{\"c_mktsegment\":\"AUTOMOBILE\"}' AS after, 'admin' AS actor, 'merge' AS reason FROM customer WHERE c_mktsegment <> 'AUTOMOBILE'")
def s20(s, d):
    c = t(s, d, "customer").select("c_custkey", "c_mktsegment")
    return tables.audit_rows(c, c.withColumn("c_mktsegment", F.lit("AUTOMOBILE")), "c_custkey", ["c_mktsegment"], "admin", "merge")


# ---- predicates


@query("p1_visible", "SELECT o_orderkey FROM orders WHERE o_orderstatus NOT IN ('P', 'X')")
def p1(s, d):
    return t(s, d, "orders").where(~F.col("o_orderstatus").isin("P", "X")).select("o_orderkey")


@query("p2_live_rows", f"WITH {i.WINDOWS} SELECT id FROM windows WHERE active AND suspect = false")
def p2(s, d):
    return i.windows(s, d).where(F.col("active") & ~F.col("suspect")).select("id")


@query("p3_coalesced", "SELECT c_custkey, coalesce(CASE WHEN c_acctbal > 0 THEN c_mktsegment END, n_name) AS zone FROM customer JOIN nation ON n_nationkey = c_nationkey")
def p3(s, d):
    return t(s, d, "customer").join(t(s, d, "nation"), F.col("n_nationkey") == F.col("c_nationkey")).select("c_custkey", F.coalesce(F.when(F.col("c_acctbal") > 0, F.col("c_mktsegment")), F.col("n_name")).alias("zone"))


@query("p4_unassigned_or_in_scope", "SELECT c_custkey FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey AND n_regionkey = 1 WHERE n_nationkey IS NULL OR n_nationkey % 2 = 0")
def p4(s, d):
    n = t(s, d, "nation").where("n_regionkey = 1")
    return t(s, d, "customer").join(n, F.col("n_nationkey") == F.col("c_nationkey"), "left").where(F.col("n_nationkey").isNull() | (F.col("n_nationkey") % 2 == 0)).select("c_custkey")


@query("p5_path_lookup", "SELECT n_nationkey, n_name FROM nation WHERE lower(n_name) = lower((SELECT min(n_name) FROM nation))")
def p5(s, d):
    n = t(s, d, "nation")
    return n.join(n.agg(F.min("n_name").alias("wanted")), F.lower("n_name") == F.lower("wanted")).select("n_nationkey", "n_name")


@query("p7_in_earlier_result", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_totalprice > 150000)")
def p7(s, d):
    return t(s, d, "lineitem").join(t(s, d, "orders").where("o_totalprice > 150000"), F.col("l_orderkey") == F.col("o_orderkey"), "left_semi").select("l_orderkey", "l_linenumber")


@query("p8_distinct_from", f"WITH {i.WINDOWS} SELECT id FROM windows WHERE start_ IS DISTINCT FROM end_")
def p8(s, d):
    return i.windows(s, d).where(~F.col("start").eqNullSafe(F.col("end"))).select("id")


@query("p9_not_all", f"WITH {i.WINDOWS} SELECT id FROM windows WHERE start_ IS NULL OR start_ NOT IN (0, 30, 60)")
def p9(s, d):
    return i.windows(s, d).where(F.col("start").isNull() | ~F.col("start").isin(0, 30, 60)).select("id")


@query("p10_word_pattern", "SELECT p_partkey FROM part WHERE regexp_matches(p_name, '(?i)\\b(red|blue|steel)\\b')")
def p10(s, d):
    return t(s, d, "part").where(F.col("p_name").rlike(r"(?i)\b(red|blue|steel)\b")).select("p_partkey")


@query("p11_like_prefix", "SELECT p_partkey FROM part WHERE p_type LIKE 'S%'")
def p11(s, d):
    return t(s, d, "part").where(F.col("p_type").like("S%")).select("p_partkey")


@query("p12_json", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events WHERE CAST(json_extract_string(props, '$.k') AS INTEGER) > 50")
def p12(s, d):
    k = F.get_json_object("props", "$.k").cast("int")
    return t(s, d, "events").where(k > 50).select("event_id", k.alias("k"))


@query("p14_indexable", f"WITH {i.WINDOWS} SELECT c_custkey FROM customer WHERE c_acctbal > 0 AND EXISTS (SELECT 1 FROM windows WHERE place = c_custkey AND active)")
def p14(s, d):
    return t(s, d, "customer").where("c_acctbal > 0").join(i.windows(s, d).where("active"), F.col("place") == F.col("c_custkey"), "left_semi").select("c_custkey")


# ---- joins


@query("j1_inner", "SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey")
def j1(s, d):
    return t(s, d, "customer").join(t(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name")


@query("j2_left", "SELECT c_custkey, s_name FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey")
def j2(s, d):
    return t(s, d, "customer").join(t(s, d, "supplier"), F.col("s_suppkey") == F.col("c_custkey"), "left").select("c_custkey", "s_name")


@query("j3_left_with_condition", "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'O' GROUP BY c_custkey")
def j3(s, d):
    o = t(s, d, "orders").where("o_orderstatus = 'O'").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    return t(s, d, "customer").join(o, F.col("o_custkey") == F.col("c_custkey"), "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n"))


@query("j4_two_hops", "SELECT DISTINCT o_custkey, p_brand FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey")
def j4(s, d):
    return t(s, d, "orders").join(t(s, d, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey")).join(t(s, d, "part"), F.col("p_partkey") == F.col("l_partkey")).select("o_custkey", "p_brand").distinct()


@query("j5_semi", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)")
def j5(s, d):
    return t(s, d, "customer").join(t(s, d, "orders").where("o_totalprice > 200000"), F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("c_custkey")


@query("j6_anti", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'O')")
def j6(s, d):
    return t(s, d, "customer").join(t(s, d, "orders").where("o_orderstatus = 'O'"), F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey")


@query("j7_semi_and_anti", f"WITH {i.WINDOWS}, {i.OFFERS} SELECT id FROM windows w WHERE active AND EXISTS (SELECT 1 FROM offers o WHERE o.id = w.id) AND NOT EXISTS (SELECT 1 FROM offers o WHERE o.id = w.id AND o.active)")
def j7(s, d):
    o = i.offers(s, d)
    return i.windows(s, d).where("active").join(o, "id", "left_semi").join(o.where("active"), "id", "left_anti").select("id")


@query("j8_self_by_parent", f"WITH {i.SUBMISSIONS} SELECT c.id, p.kind AS parent_kind FROM submissions c JOIN submissions p ON p.id = c.parent")
def j8(s, d):
    x = i.submissions(s, d)
    return x.alias("c").join(x.alias("p"), F.col("p.id") == F.col("c.parent")).select("c.id", F.col("p.kind").alias("parent_kind"))


@query("j9_correlated_count", "SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n FROM customer")
def j9(s, d):
    n = t(s, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    return t(s, d, "customer").join(n, F.col("o_custkey") == F.col("c_custkey"), "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n"))


@query("j10_correlated_first", "SELECT c_custkey, (SELECT o_orderkey FROM orders WHERE o_custkey = c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 1) AS dearest FROM customer")
def j10(s, d):
    best = t(s, d, "orders").groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_totalprice", -F.col("o_orderkey"))).alias("dearest"))
    return t(s, d, "customer").join(best, F.col("o_custkey") == F.col("c_custkey"), "left").select("c_custkey", "dearest")


@query("j11_lateral_values", f"WITH {i.WINDOWS} SELECT id, side, minute FROM windows, LATERAL (VALUES ('start', start_), ('end', end_)) v(side, minute) WHERE minute IS NOT NULL")
def j11(s, d):
    sides = F.array(F.struct(F.lit("start").alias("side"), F.col("start").alias("minute")), F.struct(F.lit("end").alias("side"), F.col("end").alias("minute")))
    return i.windows(s, d).select("id", F.inline(sides)).where("minute is not null")


@query("j13_one_row_relation", "SELECT n_nationkey FROM nation, (SELECT avg(n_nationkey) AS m FROM nation) b WHERE n_nationkey > m")
def j13(s, d):
    n = t(s, d, "nation")
    return n.join(F.broadcast(n.agg(F.avg("n_nationkey").alias("m"))), F.col("n_nationkey") > F.col("m")).select("n_nationkey")


@query(
    "j15_overlapping_pairs",
    f"""WITH {i.WINDOWS}, w AS (SELECT *, start_ AS a, CASE WHEN end_ IS NULL THEN 1440 WHEN end_ <= start_ THEN end_ + 1440 ELSE end_ END AS b FROM windows WHERE active)
SELECT x.place, x.id AS first, y.id AS second FROM w x JOIN w y ON x.place = y.place AND x.id < y.id AND list_has_any(x.days, y.days)
WHERE x.a < y.b AND y.a < x.b AND NOT (x.start_ IS NOT DISTINCT FROM y.start_ AND x.end_ IS NOT DISTINCT FROM y.end_ AND x.all_day = y.all_day)""",
)
def j15(s, d):
    from almanac.functions import weekly
    from almanac.operators.windows import window_struct

    w = i.windows(s, d).where("active")
    return w.alias("x").join(w.alias("y"), (F.col("x.place") == F.col("y.place")) & (F.col("x.id") < F.col("y.id")) & weekly.overlap(window_struct("x"), window_struct("y"))).select("x.place", F.col("x.id").alias("first"), F.col("y.id").alias("second"))


@query(
    "j16_containing_pairs",
    f"""WITH {i.WINDOWS}, w AS (SELECT *, CASE WHEN all_day THEN 0 ELSE start_ END AS a,
  CASE WHEN all_day THEN 1440 WHEN start_ IS NULL THEN NULL WHEN end_ IS NULL THEN 1440 WHEN end_ <= start_ THEN end_ + 1440 ELSE end_ END AS b FROM windows)
SELECT o.place, o.id AS outer_id, n.id AS inner_id FROM w o JOIN w n ON o.place = n.place AND o.id <> n.id AND o.a <= n.a AND o.b >= n.b""",
)
def j16(s, d):
    from almanac.functions import weekly
    from almanac.operators.windows import window_struct

    w = i.windows(s, d)
    return w.alias("o").join(w.alias("n"), (F.col("o.place") == F.col("n.place")) & (F.col("o.id") != F.col("n.id")) & weekly.contains(window_struct("o"), window_struct("n"))).select("o.place", F.col("o.id").alias("outer_id"), F.col("n.id").alias("inner_id"))


@query("j17_derived_key", "SELECT c_custkey, s_suppkey FROM customer JOIN supplier ON regexp_replace(lower(c_name), '[^0-9]', '', 'g') = regexp_replace(lower(s_name), '[^0-9]', '', 'g')")
def j17(s, d):
    key = lambda c: F.regexp_replace(F.lower(c), "[^0-9]", "")
    return t(s, d, "customer").join(t(s, d, "supplier"), key("c_name") == key("s_name")).select("c_custkey", "s_suppkey")


@query("j19_three_way_difference", "SELECT coalesce(s_suppkey, c_custkey) AS id, CASE WHEN s_suppkey IS NULL THEN 'insert' WHEN c_custkey IS NULL THEN 'deactivate' ELSE 'update' END AS action FROM (SELECT * FROM supplier) s FULL JOIN (SELECT * FROM customer WHERE c_custkey % 2 = 0) c ON s_suppkey = c_custkey WHERE CASE WHEN s_suppkey IS NULL THEN true WHEN c_custkey IS NULL THEN s_acctbal > 0 ELSE s_acctbal <= 0 OR s_nationkey <> c_nationkey END")
def j19(s, d):
    stored = t(s, d, "supplier").selectExpr("s_suppkey as id", "s_nationkey as v", "s_acctbal > 0 as active")
    return tables.three_way(stored, t(s, d, "customer").where("c_custkey % 2 = 0").selectExpr("c_custkey as id", "c_nationkey as v"), ["id"], ["v"])


@query("j20_changed_since", "SELECT l.o_orderkey AS id, l.o_orderdate AS local_at, r.at AS remote_at FROM orders l JOIN (SELECT l_orderkey AS id, min(l_shipdate) AS at FROM lineitem GROUP BY 1) r ON r.id = l.o_orderkey WHERE l.o_orderdate > r.at - INTERVAL 30 DAY AND l.o_orderdate > TIMESTAMP '1996-01-01 00:00:00' AND l.o_orderdate > r.at")
def j20(s, d):
    local = t(s, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("at"))
    remote = t(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.min("l_shipdate").alias("at"))
    return tables.changed_since(local, remote, F.lit("1996-01-01 00:00:00").cast("timestamp_ntz"))


@query("j21_new_by_either_key", "SELECT c_custkey AS id, c_nationkey AS ref FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier) AND c_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_suppkey < 20)")
def j21(s, d):
    old = t(s, d, "supplier").select(F.col("s_suppkey").alias("id"), F.when(F.col("s_suppkey") < 20, F.col("s_nationkey")).alias("ref"))
    return tables.new_by_either(t(s, d, "customer").selectExpr("c_custkey as id", "c_nationkey as ref"), old, "id", "ref")


@query("j22_owner_by_type", f"WITH {i.SUBMISSIONS} SELECT s.id, coalesce(CASE WHEN kind = 'view' THEN c_custkey END, CASE WHEN kind = 'click' THEN o_custkey END) AS place FROM submissions s LEFT JOIN customer ON c_custkey = target AND kind = 'view' LEFT JOIN orders ON o_orderkey = target AND kind = 'click'")
def j22(s, d):
    x = i.submissions(s, d)
    c = t(s, d, "customer").select(F.lit("view").alias("kind"), F.col("c_custkey").alias("target"), F.col("c_custkey").alias("place"))
    o = t(s, d, "orders").select(F.lit("click").alias("kind"), F.col("o_orderkey").alias("target"), F.col("o_custkey").alias("place"))
    return x.join(c.unionByName(o), ["kind", "target"], "left").select("id", "place")


@query("j23_latest_of_related", "SELECT id, max(z) AS at FROM (SELECT o_orderkey AS id, o_orderdate AS z FROM orders UNION ALL SELECT l_orderkey, l_shipdate FROM lineitem) GROUP BY id")
def j23(s, d):
    return tables.latest_of(t(s, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("at")), t(s, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_shipdate").alias("at")))


@query("j24_first_compatible", f"WITH {i.WINDOWS}, m AS (SELECT * FROM windows WHERE id % 2 = 0), f AS (SELECT * FROM windows WHERE id % 2 = 1) SELECT m.id, f.id AS match FROM m JOIN f ON f.place = m.place AND f.start_ = m.start_ AND list_has_any(f.days, m.days) AND (f.area = m.area OR f.area = 'all' OR m.area = 'all') QUALIFY row_number() OVER (PARTITION BY m.id ORDER BY f.id) = 1")
def j24(s, d):
    w = i.windows(s, d)
    m, f = w.where("id % 2 = 0").alias("m"), w.where("id % 2 = 1").alias("f")
    same_area = (F.col("f.area") == F.col("m.area")) | (F.col("f.area") == "all") | (F.col("m.area") == "all")
    met = m.join(f, (F.col("f.place") == F.col("m.place")) & (F.col("f.start") == F.col("m.start")) & F.arrays_overlap("f.days", "m.days") & same_area)
    return met.groupBy(F.col("m.id").alias("id")).agg(F.min("f.id").alias("match"))


@query("j25_orphans", f"WITH {i.SUBMISSIONS} SELECT id FROM submissions WHERE parent IS NOT NULL AND parent NOT IN (SELECT id FROM submissions WHERE kind <> 'view')")
def j25(s, d):
    x = i.submissions(s, d)
    return x.where("parent is not null").alias("c").join(x.where("kind <> 'view'").alias("p"), F.col("c.parent") == F.col("p.id"), "left_anti").select("id")


# ---- aggregates


@query(
    "a1_live_vs_stub_by_city",
    """SELECT n.n_name AS city, coalesce(c.with_live,0) AS with_live, coalesce(c.stubs,0) AS stubs
FROM nation n LEFT JOIN (
  SELECT c_nationkey, count(DISTINCT c_custkey) FILTER (WHERE o_orderkey IS NOT NULL) AS with_live,
         count(DISTINCT c_custkey) FILTER (WHERE o_orderkey IS NULL) AS stubs
  FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'O'
  GROUP BY 1) c ON c.c_nationkey = n.n_nationkey""",
)
def a1(s, d):
    """Whether a place has a live window is settled by one semi-join key per place, so no distinct count is needed."""
    live = t(s, d, "orders").where("o_orderstatus = 'O'").select("o_custkey").distinct()
    c = t(s, d, "customer").join(live, F.col("o_custkey") == F.col("c_custkey"), "left").groupBy("c_nationkey").agg(F.count("o_custkey").alias("with_live"), F.count(F.when(F.col("o_custkey").isNull(), 1)).alias("stubs"))
    return t(s, d, "nation").join(c, F.col("c_nationkey") == F.col("n_nationkey"), "left").select(F.col("n_name").alias("city"), F.coalesce("with_live", F.lit(0)).alias("with_live"), F.coalesce("stubs", F.lit(0)).alias("stubs"))


@query("a2_having", "SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY ALL HAVING count(*) >= 2")
def a2(s, d):
    return t(s, d, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")


@query("a3_latest", "SELECT c_nationkey, max(o_orderdate) AS at FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def a3(s, d):
    o = t(s, d, "orders").groupBy("o_custkey").agg(F.max("o_orderdate").alias("at"))
    return t(s, d, "customer").join(o, F.col("o_custkey") == F.col("c_custkey")).groupBy("c_nationkey").agg(F.max("at").alias("at"))


@query("a4_suppress_thin_groups", "SELECT c_custkey, CASE WHEN count(*) OVER (PARTITION BY c_nationkey, c_mktsegment) >= 2 THEN c_mktsegment END AS label FROM customer")
def a4(s, d):
    n = F.count(F.lit(1)).over(W.partitionBy("c_nationkey", "c_mktsegment"))
    return t(s, d, "customer").select("c_custkey", F.when(n >= 2, F.col("c_mktsegment")).alias("label"))


@query("a5_least_price", f"WITH {i.WINDOWS}, {i.OFFERS} SELECT place, min(cents) AS cents FROM windows LEFT JOIN offers USING (id) GROUP BY place")
def a5(s, d):
    least = i.offers(s, d).groupBy("id").agg(F.min("cents").alias("cents"))
    return i.windows(s, d).join(least, "id", "left").groupBy("place").agg(F.min("cents").alias("cents"))


@query("a6_labels_in_first_order", f"WITH {i.OFFERS} SELECT id, list(name ORDER BY line, name) AS labels FROM (SELECT id, name, min(line) AS line FROM offers GROUP BY 1, 2) GROUP BY id")
def a6(s, d):
    once = i.offers(s, d).groupBy("id", "name").agg(F.min("line").alias("line"))
    return once.groupBy("id").agg(F.transform(F.sort_array(F.collect_list(F.struct("line", "name"))), lambda x: x["name"]).alias("labels"))


@query("a7_bursts_by_block", f"WITH {i.SUBMISSIONS} SELECT regexp_replace(ip, '[0-9]+$', '0/24') AS block, count(DISTINCT target) AS targets, count(*) AS submissions FROM submissions WHERE risk = 'critical' AND ip IS NOT NULL AND ts > {LATEST} - INTERVAL 7 DAY AND ts <= {LATEST} GROUP BY 1 HAVING count(DISTINCT target) > 3")
def a7(s, d):
    now = F.lit("2024-01-20 00:00:00").cast("timestamp_ntz")
    recent = i.submissions(s, d).where((F.col("risk") == "critical") & F.col("ip").isNotNull() & (F.col("ts") > now - F.expr("interval 7 days")) & (F.col("ts") <= now))
    return recent.groupBy(F.concat(F.substring_index("ip", ".", 3), F.lit(".0/24")).alias("block")).agg(F.count_distinct("target").alias("targets"), F.count(F.lit(1)).alias("submissions")).where("targets > 3")


@query(
    "a8_vote_tally",
    f"""WITH {i.SUBMISSIONS} SELECT target, kind, count(DISTINCT coalesce(fingerprint, CAST(id AS VARCHAR))) FILTER (WHERE vote = 'confirm') AS confirm,
count(DISTINCT coalesce(fingerprint, CAST(id AS VARCHAR))) FILTER (WHERE vote = 'deny') AS deny, min(at_us) AS opened FROM submissions WHERE parent IS NULL GROUP BY 1, 2""",
)
def a8(s, d):
    voter = F.coalesce("fingerprint", F.col("id").cast("string"))
    return i.submissions(s, d).where("parent is null").groupBy("target", "kind").agg(F.count_distinct(F.when(F.col("vote") == "confirm", voter)).alias("confirm"), F.count_distinct(F.when(F.col("vote") == "deny", voter)).alias("deny"), F.min("at_us").alias("opened"))


@query("a9_monthly_sums", "SELECT date_trunc('month', o_orderdate)::DATE AS month, o_orderpriority AS stage, count(*) AS calls, sum(CAST(round(o_totalprice * 100) AS BIGINT))::BIGINT AS cents FROM orders GROUP BY 1, 2")
def a9(s, d):
    return t(s, d, "orders").groupBy(F.trunc("o_orderdate", "month").alias("month"), F.col("o_orderpriority").alias("stage")).agg(F.count(F.lit(1)).alias("calls"), F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).alias("cents"))


@query("a10_offers_by_price", f"WITH {i.WINDOWS}, {i.OFFERS} SELECT w.id, coalesce(list(o.name ORDER BY o.cents DESC NULLS LAST, o.line, o.name) FILTER (WHERE o.id IS NOT NULL), []) AS names FROM windows w LEFT JOIN offers o ON o.id = w.id GROUP BY w.id")
def a10(s, d):
    listed = i.offers(s, d).groupBy("id").agg(F.sort_array(F.collect_list(F.struct((-F.coalesce("cents", F.lit(-1))).alias("rank"), "line", "name"))).alias("l"))
    return i.windows(s, d).join(listed, "id", "left").select("id", F.coalesce(F.transform("l", lambda x: x["name"]), F.array().cast("array<string>")).alias("names"))


@query("a11_signature", f"WITH {i.WINDOWS} SELECT place, string_agg(coalesce(start_::VARCHAR, '-') || '/' || coalesce(end_::VARCHAR, '-'), ' | ' ORDER BY id) AS signature FROM windows WHERE active GROUP BY place")
def a11(s, d):
    one = F.concat_ws("/", F.coalesce(F.col("start").cast("string"), F.lit("-")), F.coalesce(F.col("end").cast("string"), F.lit("-")))
    return i.windows(s, d).where("active").groupBy("place").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("id", one.alias("x")))), lambda v: v["x"]), " | ").alias("signature"))


@query("a12_chain_divergence", "SELECT name, count(*) AS n, count(DISTINCT sig) AS signatures FROM (SELECT c_mktsegment || (c_custkey % 20) AS name, c_nationkey % 3 AS sig FROM customer) GROUP BY name HAVING count(*) >= 2 AND count(DISTINCT sig) > 1")
def a12(s, d):
    x = t(s, d, "customer").select(F.concat("c_mktsegment", (F.col("c_custkey") % 20).cast("string")).alias("name"), (F.col("c_nationkey") % 3).alias("sig"))
    return x.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("sig").alias("signatures")).where("n >= 2 and signatures > 1")


@query("a13_mixed_all_day", f"WITH {i.WINDOWS} SELECT place, list_sort(list(DISTINCT start_) FILTER (WHERE NOT all_day AND start_ IS NOT NULL)) AS starts FROM windows GROUP BY place HAVING bool_or(all_day) AND bool_or(NOT all_day)")
def a13(s, d):
    g = i.windows(s, d).groupBy("place").agg(F.bool_or("all_day").alias("x"), F.bool_or(~F.col("all_day")).alias("y"), F.array_sort(F.collect_set(F.when(~F.col("all_day"), F.col("start")))).alias("starts"))
    return g.where("x and y").select("place", F.when(F.size("starts") > 0, F.col("starts")).alias("starts"))


@query("a15_coverage", "SELECT c_nationkey AS city, count(*) AS total, count(*) FILTER (WHERE c_acctbal > 0) AS assigned, count(*) FILTER (WHERE c_acctbal > 0) * 1.0 / nullif(count(*) FILTER (WHERE c_mktsegment <> 'BUILDING'), 0) AS share FROM customer GROUP BY 1 HAVING count(*) > 3")
def a15(s, d):
    n = lambda c: F.count(F.when(c, 1))
    return t(s, d, "customer").groupBy(F.col("c_nationkey").alias("city")).agg(F.count(F.lit(1)).alias("total"), n(F.col("c_acctbal") > 0).alias("assigned"), (n(F.col("c_acctbal") > 0).cast("double") / F.nullif(n(F.col("c_mktsegment") != "BUILDING"), F.lit(0))).alias("share")).where("total > 3")


@query("a16_funnel", "SELECT count(*) AS candidates, count(DISTINCT p_brand) AS brands, count(*) FILTER (WHERE p_size > 10) AS sized, count(DISTINCT p_type) FILTER (WHERE p_retailprice > 1000) AS dear_types FROM part")
def a16(s, d):
    return t(s, d, "part").agg(F.count(F.lit(1)).alias("candidates"), F.count_distinct("p_brand").alias("brands"), F.count(F.when(F.col("p_size") > 10, 1)).alias("sized"), F.count_distinct(F.when(F.col("p_retailprice") > 1000, F.col("p_type"))).alias("dear_types"))


@query(
    "a17_scorecard",
    f"""WITH {i.WINDOWS} SELECT n_nationkey AS city, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS places,
(SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS suppliers,
(SELECT count(*) FROM windows JOIN customer ON c_custkey = place WHERE c_nationkey = n_nationkey AND active) AS live,
EXISTS (SELECT 1 FROM customer WHERE c_nationkey = n_nationkey AND c_acctbal < -900) AS in_debt FROM nation""",
)
def a17(s, d):
    c = t(s, d, "customer").withColumnRenamed("c_nationkey", "city")
    live = i.windows(s, d).where("active").groupBy("place").agg(F.count(F.lit(1)).alias("live"))
    per = c.join(live, F.col("place") == F.col("c_custkey"), "left").groupBy("city").agg(F.count(F.lit(1)).alias("places"), F.sum(F.coalesce("live", F.lit(0))).alias("live"), F.bool_or(F.col("c_acctbal") < -900).alias("in_debt"))
    sup = t(s, d, "supplier").groupBy(F.col("s_nationkey").alias("city")).agg(F.count(F.lit(1)).alias("suppliers"))
    zero = lambda x: F.coalesce(x, F.lit(0)).alias(x)
    return t(s, d, "nation").select(F.col("n_nationkey").alias("city")).join(per, "city", "left").join(sup, "city", "left").select("city", zero("places"), zero("suppliers"), zero("live"), F.coalesce("in_debt", F.lit(False)).alias("in_debt"))


@query("a18_yield_by_type", "SELECT p_type, count(*) AS n, count(*) FILTER (WHERE p_size > 25) AS live FROM part GROUP BY 1")
def a18(s, d):
    return t(s, d, "part").groupBy("p_type").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("p_size") > 25, 1)).alias("live"))


@query("a19_mean_of_positive", f"WITH {i.OFFERS} SELECT id, avg(cents) FILTER (WHERE cents > 0) AS mean FROM offers GROUP BY id")
def a19(s, d):
    return i.offers(s, d).groupBy("id").agg(F.avg(F.when(F.col("cents") > 0, F.col("cents"))).alias("mean"))


@query(
    "a20_page_report",
    """WITH q AS (SELECT event_type AS page, user_id AS query, count(*) AS impressions, count(*) FILTER (WHERE value > 50) AS clicks FROM events GROUP BY 1, 2)
SELECT page, sum(impressions)::BIGINT AS impressions, sum(clicks)::BIGINT AS clicks, list(query ORDER BY impressions DESC, query)[1:5] AS top_queries FROM q GROUP BY page""",
)
def a20(s, d):
    """Totals and the five best queries of a page: ranked first, so only five rows a page are gathered."""
    q = t(s, d, "events").groupBy(F.col("event_type").alias("page"), F.col("user_id").alias("query")).agg(F.count(F.lit(1)).alias("impressions"), F.count(F.when(F.col("value") > 50, 1)).alias("clicks"))
    totals = q.groupBy("page").agg(F.sum("impressions").alias("impressions"), F.sum("clicks").alias("clicks"))
    top = tables.best_per(q, ["page"], F.desc("impressions"), F.asc("query"), n=5).groupBy("page").agg(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("impressions")).alias("r"), "query"))), lambda x: x["query"]).alias("top_queries"))
    return totals.join(top, "page")


@query("a21_tallies", "SELECT o_orderstatus AS outcome, o_orderpriority AS reason, count(*) AS n FROM orders GROUP BY ALL")
def a21(s, d):
    return t(s, d, "orders").groupBy(F.col("o_orderstatus").alias("outcome"), F.col("o_orderpriority").alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("a22_rule_hits", f"WITH {i.WINDOWS}, f AS (SELECT id, active, unnest(list_filter([CASE WHEN all_day THEN 'all_day' END, CASE WHEN start_ IS NULL THEN 'no_start' END, CASE WHEN end_ IS NULL THEN 'no_end' END], lambda x: x IS NOT NULL)) AS code FROM windows) SELECT code, count(*) FILTER (WHERE active) AS kept_hits, count(*) FILTER (WHERE NOT active) AS hidden_hits FROM f GROUP BY code")
def a22(s, d):
    codes = F.array_compact(F.array(F.when(F.col("all_day"), "all_day"), F.when(F.col("start").isNull(), "no_start"), F.when(F.col("end").isNull(), "no_end")))
    return i.windows(s, d).select("active", F.explode(codes).alias("code")).groupBy("code").agg(F.count(F.when(F.col("active"), 1)).alias("kept_hits"), F.count(F.when(~F.col("active"), 1)).alias("hidden_hits"))


@query("a23_recall_over_runs", "SELECT event_type AS case_, round(avg(hit), 6) AS recall, max(hit) - min(hit) >= 0.34 AS flaky FROM (SELECT event_type, event_id % 5 AS run, avg(CASE WHEN value > 30 THEN 1.0 ELSE 0.0 END) AS hit FROM events GROUP BY 1, 2) GROUP BY 1")
def a23(s, d):
    runs = t(s, d, "events").groupBy("event_type", (F.col("event_id") % 5).alias("run")).agg(F.avg(F.when(F.col("value") > 30, 1.0).otherwise(0.0)).alias("hit"))
    return runs.groupBy(F.col("event_type").alias("case_")).agg(F.round(F.avg("hit"), 6).alias("recall"), (F.max("hit") - F.min("hit") >= 0.34).alias("flaky"))


@query("a25_facts_by_name", f"WITH {i.SUBMISSIONS} SELECT kind AS name, list_sort(list(DISTINCT vote)) AS votes, max(ts) AS newest FROM submissions GROUP BY kind")
def a25(s, d):
    return i.submissions(s, d).groupBy(F.col("kind").alias("name")).agg(F.array_sort(F.collect_set("vote")).alias("votes"), F.max("ts").alias("newest"))


@query("a28_merge_equal_windows", f"WITH {i.WINDOWS} SELECT place, min(id) AS pos, start_ AS start, end_ AS 'end', all_day, offers, list_sort(list_distinct(flatten(list(days)))) AS days, count(*) AS copies FROM windows GROUP BY place, start_, end_, all_day, offers")
def a28(s, d):
    from almanac.operators.windows import merge_duplicates

    return merge_duplicates(i.windows(s, d)).drop("area", "suspect")


@query("a30_by_state_others_last", "SELECT coalesce(r_name, 'Other') AS state, count(*) AS cities, row_number() OVER (ORDER BY (r_name IS NULL), r_name) AS position FROM nation LEFT JOIN (SELECT * FROM region WHERE r_regionkey < 4) r ON r_regionkey = n_regionkey GROUP BY r_name")
def a30(s, d):
    r = t(s, d, "region").where("r_regionkey < 4")
    g = t(s, d, "nation").join(F.broadcast(r), F.col("r_regionkey") == F.col("n_regionkey"), "left").groupBy("r_name").agg(F.count(F.lit(1)).alias("cities"))
    return g.select(F.coalesce("r_name", F.lit("Other")).alias("state"), "cities", F.row_number().over(W.orderBy(F.col("r_name").isNull(), "r_name")).cast("long").alias("position"))


@query("a31_weighted_issues", f"WITH {i.WINDOWS} SELECT place, sum(CASE WHEN all_day THEN 3 ELSE 0 END + CASE WHEN end_ IS NULL THEN 1 ELSE 0 END + CASE WHEN offers = '' THEN 2 ELSE 0 END)::BIGINT AS score FROM windows GROUP BY place")
def a31(s, d):
    score = F.when(F.col("all_day"), 3).otherwise(0) + F.when(F.col("end").isNull(), 1).otherwise(0) + F.when(F.col("offers") == "", 2).otherwise(0)
    return i.windows(s, d).groupBy("place").agg(F.sum(score).alias("score"))


# ---- ranking


@query("w1_dedupe_by_natural_key", f"WITH {i.WINDOWS}, {i.OFFERS} SELECT id FROM (SELECT w.id, row_number() OVER (PARTITION BY place, days, start_, end_, area ORDER BY coalesce(n, 0) DESC, active DESC, w.id) AS rn FROM windows w LEFT JOIN (SELECT id, count(*) AS n FROM offers GROUP BY id) o ON o.id = w.id) WHERE rn = 1")
def w1(s, d):
    n = i.offers(s, d).groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    return tables.best_per(i.windows(s, d).join(n, "id", "left"), ["place", "days", "start", "end", "area"], F.desc(F.coalesce("n", F.lit(0))), F.desc("active"), F.asc("id")).select("id")


@query("w3_two_nearest_unambiguous", "WITH r AS (SELECT o_custkey AS place, list(o_totalprice ORDER BY o_totalprice, o_orderkey)[1:2] AS p, min_by(o_orderkey, o_totalprice) AS id FROM orders GROUP BY 1) SELECT place, id FROM r WHERE len(p) < 2 OR p[2] >= 2 * p[1] OR p[2] - p[1] >= 50000")
def w3(s, d):
    two = t(s, d, "orders").groupBy(F.col("o_custkey").alias("place")).agg(F.slice(F.array_sort(F.collect_list(F.struct("o_totalprice", "o_orderkey"))), 1, 2).alias("p"))
    a, b = F.col("p")[0]["o_totalprice"], F.get("p", F.lit(1))["o_totalprice"]
    return two.where(b.isNull() | (b >= 2 * a) | (b - a >= 50000)).select("place", F.col("p")[0]["o_orderkey"].alias("id"))


@query("w5_siblings", f"WITH {i.WINDOWS} SELECT a.id, list(b.id ORDER BY b.active DESC, b.updated_at > a.updated_at DESC, b.id) AS siblings FROM windows a JOIN windows b ON a.place = b.place AND a.id <> b.id GROUP BY a.id")
def w5(s, d):
    w = i.windows(s, d).select("place", "id", "active", "updated_at")
    pairs = w.alias("a").join(w.alias("b"), (F.col("a.place") == F.col("b.place")) & (F.col("a.id") != F.col("b.id")))
    rank = F.struct((~F.col("b.active")).alias("x"), (F.col("b.updated_at") <= F.col("a.updated_at")).alias("y"), F.col("b.id").alias("id"))
    return pairs.groupBy(F.col("a.id").alias("id")).agg(F.transform(F.sort_array(F.collect_list(rank)), lambda r: r["id"]).alias("siblings"))


@query("w7_nulls_first_limit", f"WITH {i.WINDOWS} SELECT id FROM windows ORDER BY start_ ASC NULLS FIRST, id LIMIT 10")
def w7(s, d):
    return i.windows(s, d).orderBy(F.asc_nulls_first("start"), "id").limit(10).select("id")


@query("w8_related_or_city", "WITH c AS (SELECT *, count(*) OVER (PARTITION BY c_nationkey, c_mktsegment) AS n FROM customer) SELECT a.c_custkey AS id, count(*) AS related FROM c a JOIN c b ON a.c_nationkey = b.c_nationkey AND a.c_custkey <> b.c_custkey AND (a.n - 1 < 3 OR a.c_mktsegment = b.c_mktsegment) GROUP BY 1")
def w8(s, d):
    c = t(s, d, "customer")
    near = c.groupBy("c_nationkey", "c_mktsegment").agg((F.count(F.lit(1)) - 1).alias("near"))
    city = c.groupBy("c_nationkey").agg((F.count(F.lit(1)) - 1).alias("city"))
    n = F.when(F.col("near") >= 3, F.col("near")).otherwise(F.col("city"))
    return c.join(near, ["c_nationkey", "c_mktsegment"]).join(city, "c_nationkey").where(n > 0).select(F.col("c_custkey").alias("id"), n.alias("related"))


@query("w11_bounds", f"WITH {i.WINDOWS} SELECT place, min(start_) AS first_start, max(end_) AS last_end FROM windows WHERE active GROUP BY place")
def w11(s, d):
    return i.windows(s, d).where("active").groupBy("place").agg(F.min("start").alias("first_start"), F.max("end").alias("last_end"))


@query("w12_best_links", "SELECT c_nationkey, c_custkey FROM customer QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) <= 8")
def w12(s, d):
    return tables.best_per(t(s, d, "customer"), ["c_nationkey"], F.desc("c_acctbal"), F.asc("c_custkey"), n=8).select("c_nationkey", "c_custkey")


# ---- sets and documents


@query("u1_union_all", "SELECT c_custkey AS id, 'c' AS kind FROM customer UNION ALL SELECT s_suppkey, 's' FROM supplier")
def u1(s, d):
    return t(s, d, "customer").select(F.col("c_custkey").alias("id"), F.lit("c").alias("kind")).unionByName(t(s, d, "supplier").select(F.col("s_suppkey").alias("id"), F.lit("s").alias("kind")))


@query("u2_day_sets", f"WITH {i.WINDOWS} SELECT id, list_sort(list_distinct(list_concat(days, [1, 7]))) AS days FROM windows")
def u2(s, d):
    from almanac.functions import weekly

    return i.windows(s, d).select("id", weekly.day_set(F.concat("days", F.array(F.lit(7), F.lit(9), F.lit(1)))).alias("days"))


@query("u4_new_offers", f"WITH {i.OFFERS} SELECT DISTINCT name FROM offers WHERE kind = 'food' AND active EXCEPT SELECT name FROM offers WHERE cents > 4950")
def u4(s, d):
    o = i.offers(s, d)
    return o.where("kind = 'food' and active").select("name").distinct().join(o.where("cents > 4950"), "name", "left_anti")


@query("x26_nested_places", f"WITH {i.WINDOWS}, {i.OFFERS}, o AS (SELECT id, list(name ORDER BY line) AS names FROM offers GROUP BY id) SELECT c_custkey AS place, coalesce(list(w.id ORDER BY w.id) FILTER (WHERE w.id IS NOT NULL), []) AS windows, CAST(coalesce(sum(len(names)), 0) AS BIGINT) AS n_offers FROM customer LEFT JOIN (SELECT * FROM windows WHERE active) w ON w.place = c_custkey LEFT JOIN o ON o.id = w.id GROUP BY c_custkey")
def x26(s, d):
    w = tables.nested(i.windows(s, d).where("active"), "id", offered=(i.offers(s, d), ["line", "name"]))
    doc = tables.nested(t(s, d, "customer").select(F.col("c_custkey").alias("place")), "place", ws=(w, ["id", "offered"]))
    return doc.select("place", F.transform("ws", lambda x: x["id"]).alias("windows"), F.aggregate("ws", F.lit(0), lambda a, x: a + F.size(x["offered"])).cast("long").alias("n_offers"))


@query("c34_levels", f"WITH RECURSIVE {i.SUBMISSIONS}, r AS (SELECT id, 0 AS depth FROM submissions WHERE parent IS NULL OR parent < 0 UNION ALL SELECT s.id, depth + 1 FROM submissions s JOIN r ON s.parent = r.id) SELECT id, depth FROM r")
def c34(s, d):
    return tables.levels(i.submissions(s, d), "id", "parent")


@query("x7_snapshot_restore", "SELECT c_custkey, CASE WHEN s_suppkey IS NOT NULL THEN s_nationkey END AS c_nationkey FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey WHERE NOT (c_nationkey IS NOT DISTINCT FROM s_nationkey)")
def x7(s, d):
    snap = t(s, d, "supplier").select("s_suppkey", "s_nationkey")
    return t(s, d, "customer").join(snap, F.col("s_suppkey") == F.col("c_custkey"), "left").where(~F.struct("c_nationkey").eqNullSafe(F.struct(F.col("s_nationkey").alias("c_nationkey")))).select("c_custkey", F.col("s_nationkey").alias("c_nationkey"))
