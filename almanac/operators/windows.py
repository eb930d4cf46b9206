"""Merging, reconciling and superseding the weekly windows of a place, as joins and groupings by place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from almanac.functions import weekly
from almanac.session import cut


def window_struct(alias: str = "") -> Column:
    p = f"{alias}." if alias else ""
    return F.struct(F.col(f"{p}days").alias("days"), F.col(f"{p}start").alias("start"), F.col(f"{p}end").alias("end"), F.col(f"{p}all_day").alias("all_day"))


def offer_key(offers: Column) -> Column:
    """What a window offers, whatever the order: "name|cents;..." of array<struct<name, cents>>."""
    one = lambda o: F.concat(F.lower(F.trim(F.coalesce(o["name"], F.lit("")))), F.lit("|"), F.coalesce(o["cents"].cast("string"), F.lit("")))
    return F.array_join(F.array_sort(F.transform(offers, one)), ";")


def merge_duplicates(windows: DataFrame) -> DataFrame:
    """Windows (place, pos, days, start, end, all_day, offers, area, suspect) with equal times and offers become one, with the
    days of all; the rest is of the first by pos. ``copies`` counts them. Null offers are none."""
    first = F.min_by(F.struct("pos", "area", "suspect"), "pos")
    return (
        windows.withColumn("offers", F.coalesce("offers", F.lit("")))
        .groupBy("place", "start", "end", "all_day", "offers")
        .agg(weekly.day_set(F.flatten(F.collect_list("days"))).alias("days"), F.count(F.lit(1)).alias("copies"), first.alias("first"))
        .select("place", "first.pos", "days", "start", "end", "all_day", "offers", "first.area", F.coalesce("first.suspect", F.lit(False)).alias("suspect"), "copies")
    )


def covered_days(bare: DataFrame, offering: DataFrame, key: str, areas: bool = False) -> DataFrame:
    """(place, key, covering): for the windows ``bare`` (place, key, days, start, end, all_day, and area) the days on which a window of
    ``offering`` (the same columns) of their place spans their times; with ``areas``, one that is not of another area. Windows
    without such a day have no row.

    By a sweep: the windows of a place and a day in order of their start, with the latest end so far; so a place with very many
    windows costs their sort, and no pairs are made. Ties in start are seen by each other."""
    at = weekly.clock(window_struct())

    def of(df: DataFrame, is_bare: bool, number: Column) -> DataFrame:
        area = F.coalesce("area", F.lit("all")) if areas else F.lit("all")
        timed = df.select("place", number.alias("key"), F.lit(is_bare).alias("bare"), area.alias("area"), at["a"].alias("a"), at["b"].alias("b"), "days")
        return timed.where("a is not null").withColumn("day", F.explode("days")).drop("days")

    both = of(bare, True, F.col(key)).unionByName(of(offering, False, F.lit(None).cast(bare.schema[key].dataType)))
    latest = lambda by, when: F.max(F.when(~F.col("bare") & when, F.col("b"))).over(W.partitionBy("place", "day", *by).orderBy("a").rangeBetween(W.unboundedPreceding, W.currentRow))
    reach = F.when(F.col("area") == "all", latest([], F.lit(True))).otherwise(F.greatest(latest([], F.col("area") == "all"), latest(["area"], F.lit(True)))) if areas else latest([], F.lit(True))
    met = both.withColumn("reach", reach).where(F.col("bare") & (F.col("reach") >= F.col("b")))
    return met.groupBy("place", F.col("key").alias(key)).agg(F.array_sort(F.collect_set("day")).alias("covering"))


def reconcile(windows: DataFrame, hours: DataFrame) -> DataFrame:
    """What is shown of each place's windows, and why the rest isn't. ``hours``: place, periods (one row at most per place).

    In order, each step seeing what the one before left: equal windows merge; days on which the place is closed drop; windows
    that are opening hours go if they offer nothing or copy a real window's offers; windows without offers lose the days that
    an offering window covers, or go if that is most of them; of overlapping windows that contradict each other the worse
    evidenced go. Nothing is deleted: ``active`` and ``reasons`` say what became of each. Pairs that overlap are joined inside
    a place only, after merging; what covers a window is found by a sweep. What three steps read is cut with a checkpoint, so that windows are aggregated once."""
    merged = merge_duplicates(windows).join(hours.select("place", "periods"), "place", "left")
    opening = F.transform("periods", lambda p: p["open_day"])
    known = F.coalesce(F.size("periods"), F.lit(0)) > 0
    clipped = F.when(known, F.filter("days", lambda d: F.array_contains(opening, d))).otherwise(F.col("days"))
    closed = merged.withColumn("was", F.size("days")).withColumn("days", clipped).withColumn("closed_clip", F.size("days") < F.col("was")).withColumn("active", ~F.col("closed_clip") | (F.size("days") > 0))
    real = F.max(~F.col("shaped")).over(W.partitionBy("place", "offers"))
    shaped = (
        closed.withColumn("shaped", weekly.operating_hours(window_struct(), F.col("periods")))
        .withColumn("opening_hours", F.col("shaped") & ((F.col("offers") == "") | real))
        .withColumn("active", F.col("active") & ~F.col("opening_hours"))
    )
    shaped = cut(shaped)
    bare, offering = shaped.where("active and offers = ''"), shaped.where("active and offers <> '' and not shaped")
    covers = covered_days(bare, offering, "pos")
    left = shaped.join(covers, ["place", "pos"], "left").withColumn("covered", F.array_intersect("days", F.coalesce("covering", F.array().cast("array<int>"))))
    most = 2 * F.size("covered") > F.size("days")
    covered = left.withColumn("cover_clip", F.size("covered") > 0).withColumn("active", F.col("active") & ~most).withColumn("days", F.when(F.col("cover_clip") & ~most, F.array_except("days", "covered")).otherwise(F.col("days")))
    covered = cut(covered)
    a, b = "a", "b"
    live = covered.where("active").select("place", "pos", "days", "start", "end", "all_day", "offers", "area", "suspect", "shaped")
    pairs = live.alias(a).join(
        live.alias(b),
        (F.col("a.place") == F.col("b.place")) & (F.col("a.pos") < F.col("b.pos")) & weekly.overlap(window_struct(a), window_struct(b)) & ~weekly.areas_differ(F.col("a.area"), F.col("b.area")),
    )
    equal = F.col("a.offers") == F.col("b.offers")
    variant = (F.col("a.offers") != "") & (weekly.proper_subset(F.col("a.days"), F.col("b.days")) | weekly.proper_subset(F.col("b.days"), F.col("a.days")))
    loses = lambda x, y: (F.when(equal, ~variant).otherwise((F.col(f"{x}.offers") == "") & ~F.col(f"{y}.shaped"))) & (F.col(f"{x}.suspect") | ~F.col(f"{y}.suspect"))
    losers = pairs.select("a.place", F.explode(F.array_compact(F.array(F.when(loses(a, b), F.col("a.pos")), F.when(loses(b, a), F.col("b.pos"))))).alias("pos")).distinct().withColumn("conflict", F.lit(True))
    final = covered.join(losers, ["place", "pos"], "left").withColumn("active", F.col("active") & F.col("conflict").isNull())
    reasons = F.array_compact(F.array(*[F.when(c, name) for c, name in ((F.col("copies") > 1, "merged_duplicate"), (F.col("closed_clip"), "closed_day_clip"), (F.col("opening_hours"), "operating_hours"), (F.col("cover_clip"), "bare_covered_clip"), (F.col("conflict").isNotNull(), "overlap_conflict"))]))
    return final.select("place", "pos", "days", "start", "end", "all_day", "offers", "area", "active", reasons.alias("reasons"))


def superseded(windows: DataFrame, authoritative: bool = False) -> DataFrame:
    """(place, id) of windows (place, id, days, start, end, all_day, area, n_offers) without offers that others make needless:
    every day (with ``authoritative``: any day) is covered by an offering window that spans its times, or, for a window of one
    area, an equal one of the whole place stays."""
    bare = windows.where("n_offers = 0").withColumn("area", F.coalesce("area", F.lit("all")))
    offering = windows.where("n_offers > 0")
    covers = covered_days(bare, offering, "id", areas=True)
    met = bare.join(covers, ["place", "id"], "left").withColumn("covering", F.coalesce("covering", F.array().cast("array<int>")))
    whole = F.arrays_overlap("days", "covering") if authoritative else F.size(F.array_except("days", "covering")) == 0
    judged = met.withColumn("gone", weekly.clock(window_struct()).isNotNull() & F.coalesce(whole, F.lit(False)))
    left = judged.where("not gone")
    same = (F.col("x.place") == F.col("y.place")) & (F.col("x.id") != F.col("y.id")) & (weekly.day_set(F.col("x.days")) == weekly.day_set(F.col("y.days"))) & weekly.same_times(window_struct("x"), window_struct("y"))
    twins = left.where("area <> 'all'").alias("x").join(left.where("area = 'all'").alias("y"), same, "left_semi")
    return judged.where("gone").select("place", "id").unionByName(twins.select("place", "id"))


def by_first_seen(windows: DataFrame, score: str, keys: list[str]) -> DataFrame:
    """One row per key: the one of the highest score, at the place (``pos``) of the first."""
    best = W.partitionBy(*keys).orderBy(F.desc_nulls_last(score), F.asc("pos"))
    return windows.withColumn("rank", F.row_number().over(best)).withColumn("pos_first", F.min("pos").over(W.partitionBy(*keys))).where("rank = 1").drop("rank", "pos").withColumnRenamed("pos_first", "pos")
