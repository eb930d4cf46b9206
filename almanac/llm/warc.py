"""Not-modified revisits of web archives, resolved to the full response that they stand for.

An as-of join by canonical URL finds the latest full response before the revisit; validators are checked; where they agree,
the stored headers are updated with those that a not-modified answer may change, and the payload is the response's.

Only keys take part in the as-of join: they are range-sorted by URL and time over all partitions, looked up inside each
partition, and what a URL carries over from earlier partitions comes from a table of a few rows per partition. So a URL that
holds any share of the captures is spread over as many partitions as it needs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from almanac.llm.common import bounded, cut, ranged, spread

#: Headers that describe a connection or a payload, which a not-modified answer must not change (RFC 9110, 9111).
NOT_MERGED = (
    "connection", "content-encoding", "content-length", "content-md5", "content-range", "content-type", "keep-alive", "proxy-authenticate",
    "proxy-authentication-info", "proxy-authorization", "proxy-connection", "te", "trailer", "transfer-encoding", "upgrade",
)
URL = r"^\s*(?:[a-zA-Z][a-zA-Z0-9+.-]*)://(?:[^/?#@]*@)?([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def canonical_url(url: Column) -> Column:
    """host/path?query: no scheme, user, "www.", default port, fragment, final slash or utm_ parameters; host in lower case,
    parameters sorted. What is no such URL is only trimmed. Null stays null."""
    part = lambda i: F.regexp_extract(url, URL, i)
    host = F.regexp_replace(F.regexp_replace(F.lower(part(1)), r":(80|443)?$", ""), r"^www\.", "")
    query = F.array_join(F.array_sort(F.filter(F.split(part(3), "&"), lambda p: (p != "") & ~p.startswith("utm_"))), "&")
    whole = F.concat(host, F.regexp_replace(part(2), r"/+$", ""), F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    return F.when(host != "", whole).otherwise(F.trim(url))


def header(headers: Column, name: str) -> Column:
    """The first value of a header (array<struct<name, value>>); null if there is none."""
    return F.get(F.filter(headers, lambda h: F.lower(h["name"]) == name), F.lit(0))["value"]


def merged_headers(stored: Column, fresh: Column) -> Column:
    """The stored headers, those that the new answer may change replaced by its own; names in lower case, sorted."""
    low = lambda hs: F.transform(F.coalesce(hs, F.array().cast("array<struct<name:string,value:string>>")), lambda h: F.struct(F.lower(h["name"]).alias("name"), h["value"].alias("value")))
    new = F.filter(low(fresh), lambda h: ~h["name"].isin(*NOT_MERGED))
    names = F.transform(new, lambda h: h["name"])
    return F.array_sort(F.concat(F.filter(low(stored), lambda h: ~F.array_contains(names, h["name"])), new))


def agreement(stored: Column, fresh: Column) -> Column:
    """"merged" if the validators that both have agree (entity tags weakly compared, else modification times), "mismatch" if
    they don't, "unverified" if they have none in common."""
    tag = lambda hs: F.regexp_replace(F.trim(header(hs, "etag")), "^W/", "")
    verdict = lambda same: F.when(same, "merged").otherwise("mismatch")
    return (
        F.when(tag(stored).isNotNull() & tag(fresh).isNotNull(), verdict(tag(stored) == tag(fresh)))
        .when(header(stored, "last-modified").isNotNull() & header(fresh, "last-modified").isNotNull(), verdict(header(stored, "last-modified") == header(fresh, "last-modified")))
        .otherwise("unverified")
    )


def latest_before(records: DataFrame) -> DataFrame:
    """(canonical, at, source_id) of every revisit in ``records`` (record_id, kind, canonical, at as long) that has a URL and a time: the
    response of the same URL with the greatest (at, record_id) before it; null if there is none. It follows from URL and time
    alone, so revisits need no id of their own."""
    placed = ranged(records.where("canonical is not null and at is not null").select("canonical", "at", "record_id", (F.col("kind") == "response").alias("full")), ["canonical", "at"], "pid")
    answer = F.when(F.col("full"), F.struct("at", "record_id"))
    before = W.partitionBy("pid", "canonical").orderBy("at").rangeBetween(W.unboundedPreceding, -1)
    here = placed.withColumn("found", F.max(answer).over(before))
    # A URL goes on from an earlier partition only if it is the first of its own: a few rows for each partition.
    ends = placed.groupBy("pid").agg(F.min("canonical").alias("first"), F.max("canonical").alias("last"))
    torn = bounded(ends.select(F.explode(F.array("first", "last")).alias("canonical")).distinct())
    each = placed.join(torn, "canonical").groupBy("canonical", "pid").agg(F.max(answer).alias("best"))
    carried = each.withColumn("carried", F.max("best").over(W.partitionBy("canonical").orderBy("pid").rowsBetween(W.unboundedPreceding, -1))).where("carried is not null").select("pid", "canonical", "carried")
    return here.where("not full").join(bounded(carried), ["pid", "canonical"], "left").select("canonical", "at", F.coalesce("found", "carried")["record_id"].alias("source_id"))


#: Revisits of one response that meet its payload in one task; the payload is copied once for each so many.
MEET = 4096


def _answered(revisits: DataFrame, found: DataFrame, full: DataFrame) -> DataFrame:
    """``revisits`` (canonical, at_us and others) with the ``source_id`` that ``found`` (canonical, at_us, source_id, n revisits; a row for
    each URL and time) has for them, and its row of ``full``, or nulls. The revisits of a response are dealt into lots, and its
    payload is sent to each, so that a popular response is many keys; revisits without one are lots of their own."""
    known = found.where("source_id is not null")
    counted = cut(known.groupBy("source_id").agg(F.count(F.lit(1)).alias("n"), F.ceil(F.sum("n") / MEET).cast("int").alias("lots")))
    keyed = spread(known.withColumnRenamed("n", "revisits"), counted, ["source_id"]).withColumnRenamed("revisits", "n")
    none = found.where("source_id is null").withColumn("lots", F.lit(None).cast("int"))
    placed = F.col("canonical").isNotNull() & F.col("at_us").isNotNull()
    asked = spread(revisits.where(placed), keyed.unionByName(none), ["canonical", "at_us"])
    asked = asked.unionByName(revisits.where(~placed), allowMissingColumns=True)
    lot = F.pmod(F.xxhash64("record_id", "at", "url"), F.coalesce("lots", F.lit(1 << 30))).cast("int")
    popular = bounded(counted.where("lots > 1").select("source_id", "lots"))
    copied = full.where("source_id is not null").join(popular, "source_id", "left").withColumn("lot", F.explode(F.sequence(F.lit(0), F.coalesce("lots", F.lit(1)) - 1))).drop("lots")
    met = F.coalesce("source_id", F.xxhash64("record_id", "at", "url"))  # a key without a response, which meets nothing as its lot is beyond all
    own = asked.withColumn("lot", F.when(F.col("source_id").isNull(), -1).otherwise(lot)).withColumn("met", met)
    return own.drop("lots").join(copied.withColumnRenamed("source_id", "met"), ["met", "lot"], "left").drop("lot", "met")


def resolve(records: DataFrame) -> DataFrame:
    """One row per revisit of ``records`` (record_id long, kind "response" or "revisit", url, at timestamp, status int,
    headers array<struct<name, value>>, payload): record_id, url, canonical, at, outcome, source_id, status, headers, payload.

    ``outcome``: "merged"; "mismatch" or "unverified" (see ``agreement``); "no_earlier" without an earlier response; "no_url"
    without URL or time. Only merged rows have status, merged headers and payload of the response. A response at the same time
    is not earlier; of responses at one time the greatest record_id counts. Null headers are none; a record_id occurs once
    among responses that have one, and a response without one stands for nothing. Revisits may have repeated or null ids: each is
    resolved by its own URL and time. Other columns are ignored."""
    keyed = records.select("record_id", "kind", "url", canonical_url(F.col("url")).alias("canonical"), "at", F.unix_micros("at").alias("at_us"), "status", "headers", "payload").where("kind = 'revisit' or record_id is not null")
    found = latest_before(keyed.select("record_id", "kind", "canonical", F.col("at_us").alias("at")))
    sources = cut(found.groupBy("canonical", F.col("at").alias("at_us")).agg(F.max("source_id").alias("source_id"), F.count(F.lit(1)).alias("n")))
    revisit = keyed.where("kind = 'revisit'").drop("payload", "status", "kind")
    full = keyed.where("kind = 'response'").select(F.col("record_id").alias("source_id"), "status", F.col("headers").alias("stored"), "payload")
    linked = _answered(revisit, sources, full)
    outcome = F.when(F.col("canonical").isNull() | F.col("at").isNull(), "no_url").when(F.col("source_id").isNull(), "no_earlier").otherwise(agreement(F.col("stored"), F.col("headers")))
    whole = F.col("outcome") == "merged"
    return linked.withColumn("outcome", outcome).select(
        "record_id", "url", "canonical", "at", "outcome", "source_id",
        F.when(whole, F.col("status")).alias("status"), F.when(whole, merged_headers(F.col("stored"), F.col("headers"))).alias("headers"), F.when(whole, F.col("payload")).alias("payload"),
    )


def captures(pages: DataFrame) -> DataFrame:
    """An archive made of ``pages`` (page_id, url, html) by rule: each page as a response, a third of them again ten days later
    under another spelling of the URL and with another payload, and for each page a revisit, whose time, validators and
    headers vary with page_id so that every outcome occurs."""
    p, h = F.col("page_id"), F.coalesce("html", F.lit(""))
    start = F.timestamp_seconds(F.lit(1_700_000_000) + p * 7919 % 2_592_000)
    days = lambda n: F.timestamp_seconds(F.unix_seconds(start) + n * 86_400)
    entry = lambda name, value: F.struct(F.lit(name).alias("name"), value.cast("string").alias("value"))
    tag = lambda body: F.concat(F.lit('"'), F.substring(F.md5(body.cast("binary")), 1, 16), F.lit('"'))
    spelt = F.concat(F.regexp_replace(F.col("url"), "#.*$", ""), F.lit("#again"))
    second = F.concat(h, F.lit("<!-- 2 -->"))
    response = lambda body, v: F.array(entry("Content-Type", F.lit("text/html")), entry("Content-Length", F.octet_length(body)), entry("ETag", tag(body)), entry("Last-Modified", p % 97 + v), entry("Cache-Control", F.concat(F.lit("max-age="), p % 600)))
    of_revisit = F.filter(
        F.array(
            F.when(p % 4 != 2, entry("etag", F.when(p % 4 == 0, tag(h)).when(p % 4 == 1, F.concat(F.lit("W/"), tag(h))).otherwise(F.lit('"other"')))),
            F.when(p % 4 == 2, F.when(p % 3 != 1, entry("last-modified", p % 97 + p % 2))),
            entry("Cache-Control", F.lit("no-cache")),
            entry("Content-Length", F.lit(0)),
            entry("X-Seen", p % 10),
        ),
        lambda e: e.isNotNull(),
    )
    row = lambda i, kind, url, at, status, headers, payload: F.struct((p * 4 + i).alias("record_id"), F.lit(kind).alias("kind"), url.alias("url"), at.alias("at"), F.lit(status).alias("status"), headers.alias("headers"), payload.alias("payload"))
    rows = F.array(
        row(0, "response", F.col("url"), start, 200, response(h, 0), h),
        F.when(p % 3 == 0, row(1, "response", spelt, days(10), 200, response(second, 1), second)),
        row(2, "revisit", spelt, days(p % 5 * 4 - 1), 304, of_revisit, F.lit(None).cast("string")),
    )
    return pages.select(F.explode(F.filter(rows, lambda r: r.isNotNull())).alias("r")).select("r.*")
