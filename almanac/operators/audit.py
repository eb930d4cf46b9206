"""Anomalies of places' windows: a code for each kind, once per place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from almanac.functions import signals, urls, weekly
from almanac.operators.gates import AUTO_FIXABLE, let, which
from almanac.operators.windows import reconcile


def _implausible(source: Column) -> Column:
    start, end = F.col("start"), F.col("end")
    long = (weekly.duration(start, end) > 360) & (urls.url_score(source) < 100)
    return ~F.col("all_day") & ((start == end) | F.coalesce(long, F.lit(False)))


def _offer_codes(days: Column) -> Column:
    def codes(o: Column) -> Column:
        def of(x: Column) -> Column:
            told = F.size(x["named"]) > 0
            monthly = told & F.coalesce(x["text"].rlike(signals.MONTHLY), F.lit(False))
            match = (F.size(days) == F.size(x["named"])) & (F.size(F.array_except(x["named"], days)) == 0)
            return which(((o["kind"] == "drink") & signals.food_as_drink(x["text"]), "food_kinded_as_drink"), (monthly, "monthly_event_window"), (told & ~monthly & ~match, "day_mismatch_offering"))

        text = F.concat_ws(" ", o["name"], o["description"])
        return let(F.struct(text.alias("text"), signals.named_days(text).alias("named")), of)

    return F.flatten(F.transform("items", codes))


def audit(windows: DataFrame, sites: DataFrame, year: int) -> DataFrame:
    """(place, code, severity) for the active windows of ``windows`` (place, pos, days, start, end, all_day, active, offers, area,
    suspect, items array<struct<kind, name, description, cents>>, source, notes) and ``sites`` (place, website, periods).

    Rules on single windows are one pass of expressions; what concerns windows together is what reconciling them finds."""
    live = windows.where("active").join(sites.select("place", "website"), "place", "left")
    source, site = F.col("source"), F.col("website")
    third = urls.third_party(source, site)
    prices = F.filter(F.transform("items", lambda o: o["cents"]), lambda c: c.isNotNull())
    single = which(
        (urls.platform_site(site), "platform_website_url"),
        (F.lower("notes").contains("days assumed"), "assumed_days_avoidable"),
        (urls.home_page(source) & third, "homepage_sourced_hh"),
        (third, "third_party_source"),
        (urls.stale_event(source, F.lit(year)), "stale_event_source"),
        (urls.shop_page(source), "shop_page_source"),
        (_implausible(source), "implausible_active"),
        (urls.own_subdomain(source, site), "own_subdomain_source"),
        (F.col("notes").rlike(signals.MONTHLY), "monthly_event_window"),
        ((F.size(prices) >= 3) & (F.array_min(prices) == F.array_max(prices)) & (F.array_max(prices) <= 300), "uniform_cheap_prices"),
    )
    told = live.select("place", F.explode(F.concat(single, _offer_codes(F.col("days")))).alias("code"))
    plain = live.select("place", "pos", "days", "start", "end", "all_day", "offers", F.lit(None).cast("string").alias("area"), F.lit(False).alias("suspect"))
    together = {"overlap_conflict": "overlapping_windows", "operating_hours": "operating_hours_active", "merged_duplicate": "duplicate_windows"}
    found = reconcile(plain, sites).select("place", F.explode("reasons").alias("reason")).where(F.col("reason").isin(*together))
    joint = found.select("place", F.coalesce(*[F.when(F.col("reason") == r, c) for r, c in together.items()]).alias("code"))
    return told.unionByName(joint).distinct().withColumn("severity", F.when(F.col("code").isin(*AUTO_FIXABLE), "auto_fixable").otherwise("report"))


def confident_correction(corrected: DataFrame, year: int) -> DataFrame:
    """(place, confident): all corrected windows name their days and no stale source, one is from a page that lists offers, and
    reconciling hides none."""
    source = F.col("source")
    bad = F.coalesce(F.lower("notes").contains("days assumed"), F.lit(False)) | urls.stale_event(source, F.lit(year))
    own = corrected.groupBy("place").agg(F.bool_or(bad).alias("bad"), F.bool_or(F.coalesce(urls.url_score(source), F.lit(0)) > 0).alias("page"))
    none = corrected.select("place").distinct().withColumn("periods", F.lit(None).cast(weekly.PERIODS))
    kept = reconcile(corrected.select("place", "pos", "days", "start", "end", "all_day", "offers", F.lit(None).cast("string").alias("area"), F.lit(False).alias("suspect")), none).groupBy("place").agg(F.bool_and("active").alias("all_kept"))
    return own.join(kept, "place").select("place", (~F.col("bad") & F.col("page") & F.col("all_kept")).alias("confident"))
