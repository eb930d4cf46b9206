"""Decisions of review: what to keep, look at again, escalate or delete, as native expressions; and plans over tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from almanac.functions import pages, signals, urls, weekly
from almanac.operators.gates import first_of

#: Fixed values.
RESTRICTION = r"(?i)\b(?:18|21)\s*\+|\b(?:18|21)\s+(?:and|&)\s+(?:over|up)\b|dine[\s-]?in|no\s+to[\s-]?go|take[\s-]?out|take\s?away|in[\s-]?store\s+only|in[\s-]?restaurant|bar\s+only|bar\s+seating|bar\s*(?:&|and)\s*(?:lounge|patio)|lounge\s+only|patio\s+only|locations?\s+only"
CONSENT = ("manage your consent", "consent preferences", "we may store or access information", "cookies and similar technologies", "toasttab.com")
SHELL, GRACE_DAYS, ORPHAN_DAYS = 600, 30, 7
WALL_STATUSES = (401, 403, 406, 429)


def public_note(notes: Column) -> Column:
    """Notes that may be shown: those that state a restriction."""
    n = F.trim(notes)
    return F.when(signals.says(n, RESTRICTION), n)


def area_of_address(components: Column, city: Column) -> Column:
    """The area that an address (array<struct<text, types>>) names: a neighbourhood, else a part of the city; not the city
    itself, nor a place to park."""
    of = lambda kind: F.get(F.filter(components, lambda c: F.array_contains(c["types"], kind)), F.lit(0))["text"]
    name = F.trim(F.regexp_replace(F.coalesce(of("neighborhood"), of("sublocality"), of("sublocality_level_1")), r"\s+", " "))
    return F.when(~F.lower(name).isin("", "parking lot", "parking", "unnamed road") & (F.lower(name) != F.lower(F.trim(city))), name)


def url_variants(url: Column) -> Column:
    """The address with and without "www.", over both schemes, without itself."""
    host, bare = urls.hostname(url), urls.host(url)
    rest = F.regexp_extract(url, r"^[a-zA-Z]+://[^/?#]+([^#]*)", 1)
    rest = F.when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest))
    hosts = F.when(host.startswith("www."), F.array(host, bare)).otherwise(F.array(bare, F.concat(F.lit("www."), bare)))
    made = F.flatten(F.transform(F.array(F.lit("https://"), F.lit("http://")), lambda s: F.transform(hosts, lambda h: F.concat(s, h, rest))))
    own = F.concat(F.lower(F.regexp_extract(url, r"^([a-zA-Z]+://)", 1)), host, rest)
    return F.coalesce(F.filter(made, lambda u: u != own), F.array().cast("array<string>"))


def popmenu_routes(content: Column, base: Column) -> Column:
    """Routes of one menu platform that name an offer hour, on the same site."""
    found = F.regexp_extract_all(content, F.lit(r"(?i)((?:https?://[^\s\"'()<>]+)?/menus/web-[a-z0-9-]*happy[a-z0-9-]*\?[^\s\"'()<>]+)"), 1)
    return F.array_distinct(F.filter(F.transform(found, lambda r: pages.absolute(r, base)), lambda u: urls.hostname(u) == urls.hostname(base)))


def source_class(source: Column, website: Column) -> Column:
    s, w = urls.host(source), urls.host(website)
    return first_of(
        (urls.denied_source(source), "denylisted_aggregator"), (s.isNull(), "third_party"), (s.rlike(r"(^|\.)?(instagram|facebook|x|twitter|tiktok)\.com$"), "social"), (s == w, "own"),
        (urls.last_two(s) == urls.last_two(w), "own_subdomain"), otherwise="third_party",
    )


def delete_evidence(w: Column, periods: Column, source: Column, notes: Column, n_offers: Column) -> Column:
    """Why a hidden window may go for good; null if nothing speaks for it."""
    told = signals.offer_hour(F.coalesce(source, F.lit(""))) | signals.offer_hour(F.coalesce(notes, F.lit("")))
    meal = (n_offers == 0) & source.rlike("(?i)lunch|dinner|brunch|breakfast")
    return F.when(~told, first_of((weekly.operating_hours(w, periods), "operating hours"), (meal, "meal page")))


def evidence_file(cited: Column, statuses: Column, newest: Column, modified: Column, now: Column) -> Column:
    """"keep" or "delete": files that live rows cite or live submissions name stay; the others go after a while. Timestamps."""
    days = lambda at: (F.unix_micros(now) - F.unix_micros(at)) / 86_400_000_000
    alive = F.exists(statuses, lambda s: ~s.isin("rejected", "reverted"))
    return first_of(
        (cited | alive, "keep"),
        ((F.size(statuses) == 0) & (days(modified) >= ORPHAN_DAYS), "delete"),
        ((F.size(statuses) > 0) & (days(F.coalesce(newest, modified)) >= GRACE_DAYS), "delete"),
        otherwise="keep",
    )


def wants_browser(ok: Column, status: Column, robots: Column, document: Column, text: Column, n_media: Column) -> Column:
    """Whether a page must be rendered: blocked, code instead of text, or next to nothing and no document to follow."""
    bare = (F.length(text) < SHELL) & ~signals.offer_signal(text) & ~signals.price_signal(text)
    filled = F.coalesce(text, F.lit("")) != ""
    return (
        F.when(robots, True)
        .when(~ok, F.coalesce(status.isin(*WALL_STATUSES), F.lit(False)))
        .when(document, False)
        .when(filled, signals.machine_text(text) | (n_media == 0) & bare)
        .otherwise(n_media == 0)
    )


def wants_anti_bot(ok: Column, status: Column, walled: Column, document: Column, text: Column, n_media: Column) -> Column:
    bare = (F.length(text) < SHELL) & ~signals.offer_signal(text) & ~signals.price_signal(text)
    filled = F.coalesce(text, F.lit("")) != ""
    return (
        F.when(walled | pages.bot_wall(text), True).when(~ok, F.coalesce(status.isin(*WALL_STATUSES), F.lit(False))).when(document | (n_media > 0), False).when(filled, bare).otherwise(True)
    )


def consent_wall(text: Column) -> Column:
    return F.coalesce(F.lower(text).rlike("|".join(x.replace(".", r"\.") for x in CONSENT)), F.lit(False))


def render_escalation(confirmed: Column, read: Column, window_offers: Column) -> Column:
    """Why a place's pages must be looked at again: an offer page was not read, or was but gave windows (``window_offers``:
    their numbers of offers) without any; null if neither."""
    plain = lambda u: F.regexp_replace(u, "/+$", "")
    own = F.filter(confirmed, lambda u: (urls.url_score(u) >= 60) & ~urls.denied_source(u))
    seen = F.transform(read, plain)
    unread = F.exists(own, lambda u: ~F.array_contains(seen, plain(u)))
    empty = (F.size(window_offers) > 0) & F.forall(window_offers, lambda n: n == 0)
    return F.when(F.size(own) > 0, first_of((unread, "unread_hh_page"), (empty, "hh_page_no_offerings")))


def escalation_route(n_pages: Column, has_document: Column, windows: Column) -> Column:
    """"skip", "free", "paid" or "relevance-check" by array<struct<suspect, n_offers>> of what was found for nothing."""
    sound = F.filter(windows, lambda w: ~w["suspect"])
    return first_of((n_pages == 0, "skip"), (F.exists(sound, lambda w: w["n_offers"] > 0), "free"), ((F.size(sound) > 0) | has_document, "paid"), otherwise="relevance-check")


def undercaptured(windows: DataFrame, fetched: DataFrame) -> DataFrame:
    """Places whose windows (place, url, n_offers) hold far fewer offers than the pages (place, url, text) that they are from hold
    prices: four or more, and over two more than were captured."""
    got = windows.groupBy("place").agg(F.sum("n_offers").alias("captured"))
    priced = fetched.join(windows.select("place", "url").distinct(), ["place", "url"], "left_semi").groupBy("place").agg(F.sum(signals.price_count(F.col("text"))).alias("prices"))
    return got.join(priced, "place").where("captured > 0 and prices >= 4 and prices > captured + 2").select("place", "captured", "prices")


def new_offers(wanted: DataFrame, held: DataFrame) -> DataFrame:
    """Offers (id, name, cents) to add: named, with a price from 0 or none, not held yet under the same name and price."""
    key = lambda df: df.withColumn("_key", F.concat_ws("|", F.lower(F.trim(F.coalesce("name", F.lit("")))), F.coalesce(F.col("cents").cast("string"), F.lit(""))))
    clean = wanted.where(F.trim(F.coalesce("name", F.lit(""))) != "").select("id", F.trim("name").alias("name"), F.when(F.col("cents") >= 0, F.col("cents")).alias("cents"))
    return key(clean).join(key(held).select("id", "_key"), ["id", "_key"], "left_anti").dropDuplicates(["id", "_key"]).drop("_key")


def chain_gaps(places: DataFrame, chains: DataFrame, live: DataFrame) -> DataFrame:
    """Windows of a chain (chain, days, start, end) that its places (place, chain) don't show yet among ``live`` (place, days,
    start, end); open times are equal to open times."""
    due = places.join(chains, "chain").alias("a")
    same = (F.col("a.place") == F.col("b.place")) & (F.col("a.days") == F.col("b.days")) & F.col("a.start").eqNullSafe(F.col("b.start")) & F.col("a.end").eqNullSafe(F.col("b.end"))
    return due.join(live.alias("b"), same, "left_anti").select("place", "days", "start", "end")
