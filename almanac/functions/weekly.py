"""Algebra of weekly windows, as native column expressions.

A window is a struct of ``days`` (array<int>, ISO 1 = Monday .. 7 = Sunday), ``start`` and ``end`` (minutes of the local day,
null = open side) and ``all_day``. Operating periods are array<struct<open_day, open_min, close_day, close_min>>; a null close
means open for all of that day. Times are local to the place and never shifted to UTC. "Now" is always a parameter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY = 1440
#: Fixed values of the gates, in minutes unless named otherwise.
COVERAGE, LONG, BUSINESS_START, BUSINESS_LONG, OPEN_TOLERANCE = 0.8, 480, 660, 360, 30
SAME_DAY_MOST, CROSSING_MOST = 510, 360

PERIODS = "array<struct<open_day:int,open_min:int,close_day:int,close_min:int>>"


def local_now(zone: Column, at: Column) -> Column:
    """struct<iso_day, minutes, hhmm> of the UTC time ``at`` (timestamp without zone) in each row's IANA zone."""
    here = F.convert_timezone(F.lit("UTC"), zone, at)
    return F.struct((F.weekday(here) + 1).alias("iso_day"), (F.hour(here) * 60 + F.minute(here)).alias("minutes"), F.date_format(here, "HH:mm").alias("hhmm"))


def minutes(text: Column) -> Column:
    """Minutes of "HH:MM" or "HH:MM:SS"; null for anything else."""
    return F.when(text.rlike(r"^\d{1,2}:\d{2}"), F.regexp_extract(text, r"^(\d{1,2}):", 1).cast("int") * 60 + F.regexp_extract(text, r"^\d{1,2}:(\d{2})", 1).cast("int"))


def hhmm(minute: Column) -> Column:
    """"HH:MM" of minutes, past midnight too."""
    return F.format_string("%02d:%02d", F.pmod(F.floor(minute / 60), F.lit(24)).cast("int"), F.pmod(minute, F.lit(60)).cast("int"))


def day_set(days: Column) -> Column:
    """Sorted, distinct days from 1 to 7."""
    return F.array_sort(F.array_distinct(F.filter(days, lambda d: d.between(1, 7))))


def crosses_midnight(start: Column, end: Column) -> Column:
    """The stored flag: the end is before the start; equal times don't cross, open sides neither."""
    return F.coalesce(end < start, F.lit(False))


def end_of(start: Column, end: Column) -> Column:
    """The end on the start's time line: at or before the start means the next day."""
    return F.when(end <= start, end + DAY).otherwise(end)


def duration(start: Column, end: Column) -> Column:
    """Minutes, where equal times are a whole day; null with an open side."""
    return end_of(start, end) - start


def duration_or_zero(start: Column, end: Column) -> Column:
    """Minutes, where equal times are nothing."""
    return F.when(end < start, end + DAY).otherwise(end) - start


def interval(w: Column) -> Column:
    """struct<a, b>: the clock interval; without an end until midnight; null without a start."""
    return F.when(w["start"].isNotNull(), F.struct(w["start"].alias("a"), F.when(w["end"].isNull(), F.lit(DAY)).otherwise(end_of(w["start"], w["end"])).alias("b")))


def clock(w: Column) -> Column:
    """As ``interval``, but an all-day window spans the day."""
    return F.when(w["all_day"], F.struct(F.lit(0).alias("a"), F.lit(DAY).alias("b"))).otherwise(interval(w))


def contains(outer: Column, inner: Column) -> Column:
    """Whether the clock of ``outer`` contains that of ``inner``, whatever the days."""
    o, i = clock(outer), clock(inner)
    return F.coalesce((o["a"] <= i["a"]) & (o["b"] >= i["b"]), F.lit(False))


def share_a_day(x: Column, y: Column) -> Column:
    return F.coalesce(F.arrays_overlap(x, y), F.lit(False))


def same_times(x: Column, y: Column) -> Column:
    return x["start"].eqNullSafe(y["start"]) & x["end"].eqNullSafe(y["end"]) & (x["all_day"] == y["all_day"])


def overlap(x: Column, y: Column) -> Column:
    """Shared day and overlapping clocks that are not the same times."""
    a, b = interval(x), interval(y)
    return share_a_day(x["days"], y["days"]) & ~same_times(x, y) & F.coalesce((a["a"] < b["b"]) & (b["a"] < a["b"]), F.lit(False))


def proper_subset(x: Column, y: Column) -> Column:
    return (F.size(x) < F.size(y)) & (F.size(F.array_except(x, y)) == 0)


def areas_differ(x: Column, y: Column) -> Column:
    """Both name an area, and not the same; null and "all" are the whole place."""
    a, b = F.coalesce(x, F.lit("all")), F.coalesce(y, F.lit("all"))
    return (a != "all") & (b != "all") & (a != b)


def open_at(periods: Column, day: Column, minute: Column) -> Column:
    def within(p: Column) -> Column:
        same = (p["close_day"] == p["open_day"]) & (p["close_min"] > p["open_min"])
        late, early = (day == p["open_day"]) & (minute >= p["open_min"]), (day == p["close_day"]) & (minute < p["close_min"])
        return F.when(p["close_day"].isNull() | p["close_min"].isNull(), day == p["open_day"]).when(same, late & (minute < p["close_min"])).otherwise(late | early)

    return F.coalesce(F.exists(periods, within), F.lit(False))


def active(w: Column, day: Column, minute: Column, periods: Column) -> Column:
    """Whether a window runs now. With an open side only if the hours are known and say open; bounded windows need no hours,
    are half open, and reach into the next day if they cross midnight."""
    on, before = F.array_contains(w["days"], day), F.array_contains(w["days"], F.when(day == 1, 7).otherwise(day - 1))
    start, end = w["start"], w["end"]
    known = (F.coalesce(F.size(periods), F.lit(0)) > 0) & open_at(periods, day, minute)
    unbounded = known & on & F.when(w["all_day"], F.lit(True)).when(start.isNull(), minute < end).otherwise(minute >= start)
    plain = on & (minute >= start) & (minute < end)
    crossing = on & (minute >= start) | before & (minute < end)
    return F.coalesce(F.when(w["all_day"] | start.isNull() | end.isNull(), unbounded).when(end < start, crossing).otherwise(plain), F.lit(False))


def bounds_on(w: Column, periods: Column, day: Column) -> Column:
    """struct<start, end> of a window with an open side on a day: the earliest opening and the latest close stand in, a close
    after midnight being later than any before. Null if bounded, or if what is needed is unknown."""
    own = F.filter(periods, lambda p: p["open_day"] == day)
    opening = F.array_min(F.transform(own, lambda p: p["open_min"]))
    ranked = F.transform(
        F.filter(own, lambda p: p["close_min"].isNotNull()),
        lambda p: F.struct(F.when(~p["close_day"].eqNullSafe(p["open_day"]) | (p["close_min"] <= p["open_min"]), p["close_min"] + DAY).otherwise(p["close_min"]).alias("rank"), p["close_min"].alias("close")),
    )
    closing = F.array_max(ranked)["close"]
    opens, closes = w["all_day"] | w["start"].isNull(), w["all_day"] | w["end"].isNull()
    start, end = F.when(opens, opening).otherwise(w["start"]), F.when(closes, closing).otherwise(w["end"])
    known = (opens | closes) & (F.coalesce(F.size(own), F.lit(0)) > 0) & (~opens | opening.isNotNull()) & (~closes | closing.isNotNull())
    return F.when(known, F.struct(start.alias("start"), end.alias("end")))


def next_start(windows: Column, day: Column, minute: Column, periods: Column) -> Column:
    """struct<offset, start>: the first start of any window after now, within seven days; null if none is known."""

    def on(offset: Column) -> Column:
        iso = F.pmod(day - 1 + offset, F.lit(7)) + 1
        starts = F.transform(windows, lambda w: F.when(F.array_contains(w["days"], iso), F.coalesce(w["start"], bounds_on(w, periods, iso)["start"])))
        later = F.filter(starts, lambda s: s.isNotNull() & ((offset > 0) | (s > minute)))
        return F.transform(later, lambda s: F.struct(offset.alias("offset"), s.alias("start")))

    return F.array_min(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(7)), on)))


def minutes_left(w: Column, day: Column, minute: Column) -> Column:
    """Minutes until an active window ends; null if it has no end."""
    start, end = F.coalesce(w["start"], F.lit(0)), w["end"]
    crossing = w["start"].isNotNull() & (end < start)
    late = F.array_contains(w["days"], day) & (minute >= start)
    return F.when(w["all_day"] | end.isNull(), None).when(crossing & late, DAY - minute + end).otherwise(end - minute)


def operating_hours(w: Column, periods: Column) -> Column:
    """Whether a window is when the place is open and not an offer: by the first period of each of its days on a strict
    majority of the days that have one, else by its length."""
    first = lambda d: F.get(F.filter(periods, lambda p: p["open_day"] == d), F.lit(0))
    start, end = w["start"], end_of(w["start"], w["end"])
    opens = F.filter(F.transform(w["days"], lambda d: first(d)["open_min"]), lambda m: m.isNotNull())
    near = F.filter(opens, lambda m: F.abs(start - m) <= OPEN_TOLERANCE)
    spans = F.filter(
        F.transform(w["days"], lambda d: F.struct(first(d)["open_min"].alias("a"), end_of(first(d)["open_min"], first(d)["close_min"]).alias("b"))),
        lambda s: s["b"].isNotNull() & (s["a"] != s["b"]),
    )
    full = F.filter(spans, lambda s: F.greatest(F.lit(0), F.least(end, s["b"]) - F.greatest(start, s["a"])) >= COVERAGE * (s["b"] - s["a"]))
    length = end - start
    by_length = (length >= LONG) | (start <= BUSINESS_START) & (length >= BUSINESS_LONG)
    n, m = F.coalesce(F.size(spans), F.lit(0)), F.coalesce(F.size(opens), F.lit(0))
    return F.coalesce(
        F.when(w["all_day"] | start.isNull(), False)
        .when(w["end"].isNull(), (m > 0) & (2 * F.size(near) > m))
        .when(n > 0, 2 * F.size(full) > n)
        .otherwise(by_length),
        F.lit(False),
    )


def implausible(start: Column, end: Column) -> Column:
    """Longer than an offer can be: over 8.5 hours in a day, or over 6 across midnight."""
    return F.coalesce(F.when(end >= start, end - start > SAME_DAY_MOST).otherwise(end + DAY - start > CROSSING_MOST), F.lit(False))


NAMES = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")


def _runs(days: Column, name, dash: str) -> Column:
    """Runs of consecutive days: a day that the set holds without its predecessor begins one."""
    own = day_set(days)
    label = lambda d: F.element_at(F.array(*[F.lit(name(n)) for n in NAMES]), d)
    starts = F.filter(own, lambda d: ~F.array_contains(own, d - 1))
    ends = F.filter(own, lambda d: ~F.array_contains(own, d + 1))
    pairs = F.zip_with(starts, ends, lambda a, b: F.when(a == b, label(a)).otherwise(F.concat(label(a), F.lit(dash), label(b))))
    return F.array_join(pairs, ", ")


def format_days(days: Column) -> Column:
    """"Mon–Wed, Fri"."""
    return _runs(days, lambda n: n[:3], "–")


def format_days_long(days: Column) -> Column:
    return _runs(days, lambda n: n, " – ")


def format_time(minute: Column) -> Column:
    """"3 PM", "3:30 PM"; null is "close"."""
    h = F.pmod(F.floor(minute / 60), F.lit(24)).cast("int")
    clock12 = F.when(h % 12 == 0, 12).otherwise(h % 12).cast("string")
    half = F.when(h >= 12, " PM").otherwise(" AM")
    tail = F.when(minute % 60 == 0, F.lit("")).otherwise(F.format_string(":%02d", (minute % 60).cast("int")))
    return F.when(minute.isNull(), "close").otherwise(F.concat(clock12, tail, half))


def format_window(w: Column) -> Column:
    return (
        F.when(w["all_day"], "Open to close")
        .when(w["start"].isNull(), F.concat(F.lit("Open until "), format_time(w["end"])))
        .otherwise(F.concat(format_time(w["start"]), F.lit(" – "), format_time(w["end"])))
    )


def format_price(cents: Column, sign: str = "$") -> Column:
    """"$5", "$5.50"; null stays null."""
    whole = F.floor(cents / 100).cast("string")
    return F.when(cents % 100 == 0, F.concat(F.lit(sign), whole)).otherwise(F.concat(F.lit(sign), whole, F.format_string(".%02d", (cents % 100).cast("int"))))


def normalise_time(raw: Column) -> Column:
    """Minutes from "5pm", "5:30 p.m.", "17:00", "17", "noon" or "midnight"; null if it is no time."""
    t = F.lower(F.trim(raw))
    part = lambda i: F.regexp_extract(t, r"^(\d{1,2})(?::?(\d{2}))?(?::\d{2})?\s*([ap])?\.?(?:m\.?)?$", i)
    h, m = F.when(part(1) != "", part(1).cast("int")), F.when(part(2) != "", part(2).cast("int")).otherwise(0)
    hour = F.when((part(3) == "p") & (h < 12), h + 12).when((part(3) == "a") & (h == 12), 0).otherwise(h)
    return F.when(t == "noon", 720).when(t == "midnight", 0).when((hour < 24) & (m < 60) & ((part(3) == "") | (h <= 12)), hour * 60 + m)


def opening_periods(periods: Column) -> Column:
    """Periods with days from Sunday = 0 (struct<open: struct<day, hour, minute>, close: ...>) as ISO periods."""
    iso = lambda d: F.when(d == 0, 7).otherwise(d)
    clock_of = lambda x: x["hour"] * 60 + F.coalesce(x["minute"], F.lit(0))
    return F.transform(
        F.filter(periods, lambda p: p["open"].isNotNull()),
        lambda p: F.struct(iso(p["open"]["day"]).alias("open_day"), clock_of(p["open"]).alias("open_min"), iso(p["close"]["day"]).alias("close_day"), clock_of(p["close"]).alias("close_min")),
    )
