"""Decisions on fetched sites, raw extracts, submitted changes and reviews, as native expressions; and the rows they change."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from almanac.functions import signals, urls, weekly
from almanac.operators.gates import first_of

#: The fields that a change may set, by table; where in a place a window holds; what a reverification may ask for.
FIELDS = {
    "venues": "name slug address lat lng timezone neighborhoodId type chainId websiteUrl otherUrl googlePlaceId phone status dataCompleteness promotionTier".split(),
    "happy_hours": "venueId daysOfWeek startTime endTime allDay locationWithinVenue validFrom validUntil notes active sourceUrl".split(),
    "offerings": "happyHourId kind category name priceCents originalPriceCents discountCents discountPercent currencyCode description conditions locationRestriction sourceUrl active".split(),
}
TABLES = {"venue": "venues", "new_venue": "venues", "happy_hour": "happy_hours", "new_happy_hour": "happy_hours", "intent": "happy_hours", "offering": "offerings", "new_offering": "offerings"}
WITH_SOURCE = ("happy_hours", "offerings")
TERMINAL = ("applied", "rejected", "reverted")


def where_all(df: DataFrame, *tests: Column | None) -> DataFrame:
    """The rows that pass all tests that are given; None is no test."""
    given = [t for t in tests if t is not None]
    return df.where(reduce(and_, given)) if given else df


# ---- sites


def site_verdict(outcome: Column, status: Column, html: Column) -> Column:
    """struct<reachability, decision, reason> of a fetch: ``outcome`` is timeout, blocked, unreachable or response. Slow and blocked
    sites are kept as stubs; only what doesn't answer, says it is gone, or is parked goes."""
    gone = (status >= 500) | status.between(404, 410)
    made = lambda reach, decision, reason: F.struct(F.lit(reach).alias("reachability"), F.lit(decision).alias("decision"), (F.lit(reason) if isinstance(reason, str) else reason).alias("reason"))
    return (
        F.when(outcome == "timeout", made("timeout", "stub", "slow site"))
        .when(outcome == "blocked", made("timeout", "stub", "unreadable"))
        .when(outcome == "unreachable", made("dead", "kill", "unreachable"))
        .when(gone, made("dead", "kill", F.concat(F.lit("dead site "), status.cast("string"))))
        .when((status == 200) & signals.parked_html(html), made("parked", "kill", "parked domain"))
        .otherwise(made("ok", "extract", "reachable"))
    )


def enrich_action(kind: Column, likelihood: Column, decision: Column) -> Column:
    """A place without a site is looked for if it is likely enough; all others are treated as their verdict says."""
    return F.when((kind == "none") & F.coalesce(likelihood > 0.5, F.lit(False)), "extract").otherwise(decision)


# ---- raw extracts

RAW = "struct<happyHours: array<struct<sourceUrl: string, daysOfWeek: array<double>, startTime: string, endTime: string, allDay: boolean, locationWithinVenue: string>>, confidence: double, summary: string>"
PLACES = ("all", "bar", "patio", "lounge", "dining_room", "rooftop")


def coerced(raw: Column) -> Column:
    """struct<windows, confidence, summary, n_raw> of a raw extract as JSON. Windows without a source, with a denied one or without a
    day go; times that are none make a window of unknown time, which stands for the whole day."""
    x = F.from_json(raw, RAW)
    held = F.coalesce(x["happyHours"], F.from_json(F.lit("[]"), "array<" + RAW.split("array<", 1)[1].split(">>", 1)[0] + ">>"))

    def one(w: Column) -> Column:
        days = F.array_distinct(F.transform(F.filter(w["daysOfWeek"], lambda d: (d == F.floor(d)) & d.between(1, 7)), lambda d: d.cast("int")))
        start, end, all_day = weekly.normalise_time(w["startTime"]), weekly.normalise_time(w["endTime"]), F.coalesce(w["allDay"], F.lit(False))
        known = all_day | start.isNotNull() | end.isNotNull()
        return F.struct(
            (all_day | ~known).alias("all_day"),
            known.alias("time_known"),
            days.alias("days"),
            F.when(~all_day, start).alias("start"),
            F.when(~all_day, end).alias("end"),
            F.when(w["locationWithinVenue"].isin(*PLACES), w["locationWithinVenue"]).otherwise("all").alias("area"),
            F.trim(F.coalesce(w["sourceUrl"], F.lit(""))).alias("source"),
        )

    kept = F.filter(F.transform(held, one), lambda w: (w["source"] != "") & ~F.coalesce(urls.denied_source(w["source"]), F.lit(False)) & (F.size(w["days"]) > 0))
    confidence = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(x["confidence"], F.lit(0.0))))
    return F.struct(kept.alias("windows"), confidence.alias("confidence"), F.coalesce(x["summary"], F.lit("")).alias("summary"), F.size(held).alias("n_raw"))


# ---- submitted changes


def change_verdict(target: Column, status: Column, after: Column, diff_source: Column) -> Column:
    """struct<verdict, fields> of a submitted change (``after`` as JSON): refused if its status is final, its target unknown, or a
    window or offer would have no source; else the fields that it may set, in the order of the table."""
    table = first_of(*[(target == t, name) for t, name in TABLES.items()])
    keys = F.coalesce(F.json_object_keys(after), F.array().cast("array<string>"))
    allowed = F.coalesce(*[F.when(table == name, F.array(*[F.lit(f) for f in fields])) for name, fields in FIELDS.items()])
    source = F.coalesce(F.get_json_object(after, "$.sourceUrl"), diff_source, F.lit(""))
    verdict = first_of((status.isin(*TERMINAL), "already_decided"), (table.isNull(), "unknown_target"), (table.isin(*WITH_SOURCE) & (source == ""), "no_source"), otherwise="apply")
    return F.struct(verdict.alias("verdict"), F.when(verdict == "apply", F.filter(allowed, lambda f: F.array_contains(keys, f))).alias("fields"))


def paired(rows: DataFrame, verdicts: DataFrame, key: str, action) -> DataFrame:
    """``rows`` with the verdict of their key, ``unconfirmable`` where there is none, and the action that it asks for."""
    found = rows.join(verdicts, key, "left").withColumn("kind", F.coalesce("kind", F.lit("unconfirmable")))
    return found.withColumn("action", action(F.col("kind")))


# ---- reviews


def reviewed(windows: DataFrame, places: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Windows, places and audit rows after a review. ``windows``: id, place, active, deleted. ``places``: place, completeness.
    ``decisions``: id, action (keep, delete or promote), one per window at most.

    Keep only leaves a mark; delete hides a window for good, promote shows a hidden one, and a place whose last live window went
    becomes a stub, a stub that got one is complete again. Decisions on deleted windows, and promotions of live ones, are void."""
    asked = windows.join(decisions, "id", "left").withColumn("action", F.when(~F.col("deleted") & ~((F.col("action") == "promote") & F.col("active")), F.col("action")))
    now = F.when(F.col("action") == "delete", False).when(F.col("action") == "promote", True).otherwise(F.col("active"))
    after = asked.withColumn("was_active", F.col("active")).withColumn("active", now).withColumn("deleted", F.col("deleted") | F.coalesce(F.col("action") == "delete", F.lit(False)))
    touched = after.groupBy("place").agg(
        F.bool_or(F.coalesce(F.col("action") == "delete", F.lit(False))).alias("lost"), F.bool_or(F.coalesce(F.col("action") == "promote", F.lit(False))).alias("won"), F.bool_or(F.col("active") & ~F.col("deleted")).alias("live")
    )
    c = F.col("completeness")
    level = F.when(F.col("lost") & ~F.col("live") & c.isin("complete", "verified"), "stub").when(F.col("won") & F.col("live") & (c == "stub"), "complete").otherwise(c)
    told = places.join(touched, "place", "left").select("place", F.coalesce(level, c).alias("completeness"))
    marks = after.where("action is not null").select("id", "action", F.col("was_active").alias("before"), F.col("active").alias("after"))
    return after.select("id", "place", "active", "deleted"), told, marks


def flag_reviewed(flagged: DataFrame, decisions: DataFrame) -> DataFrame:
    """(place, resolution, note, reason) of flagged places (place, resolution, note, codes) after decisions (place, action, remark): keep
    settles a place and names the codes that were overruled, park leaves it for further review with its remark, stub hides it."""
    a = F.col("action")
    reason = F.when(a == "keep", F.concat(F.lit("kept: "), F.when(F.size("codes") > 0, F.array_join("codes", ", ")).otherwise("none"))).when(a == "park", "parked").when(a == "stub", "hidden")
    resolution = F.when(a == "keep", "operator_kept").when(a == "park", "further_review").when(a == "stub", "operator_stubbed").otherwise(F.col("resolution"))
    return flagged.join(decisions, "place", "left").select("place", resolution.alias("resolution"), F.when(a.isin("keep", "park"), F.coalesce("remark", "note")).otherwise(F.col("note")).alias("note"), reason.alias("reason"))


# ---- publishing


def subtree(places: DataFrame, areas: DataFrame, windows: DataFrame, offers: DataFrame, one: Column) -> dict[str, DataFrame]:
    """The rows that publishing some places takes: the places, the areas that they lie in, their windows and their offers."""
    chosen = places.where(one)
    own = windows.join(chosen.select("place"), "place", "left_semi")
    return {"areas": areas.join(chosen.select("city"), "city", "left_semi"), "places": chosen, "windows": own, "offers": offers.join(own.select("id"), "id", "left_semi")}


def next_runs(at: Column) -> Column:
    """struct<daily, weekly>: the next run at 08:00 of a day and at 09:00 of a Monday, after ``at`` (a timestamp without zone, in UTC)."""
    day = F.date_trunc("day", at)
    hours = lambda start, n: F.expr(f"INTERVAL {n} HOURS") + start
    daily = F.when(hours(day, 8) > at, hours(day, 8)).otherwise(hours(day, 32))
    monday = F.date_trunc("week", at)
    return F.struct(daily.alias("daily"), F.when(hours(monday, 9) > at, hours(monday, 9)).otherwise(hours(monday, 177)).alias("weekly"))
