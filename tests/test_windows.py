"""Reconciling and superseding against a plain version that walks one place at a time."""

import random

from almanac.functions import weekly
from almanac.operators import windows
from pyspark.sql import functions as F

DAY = 1440


def end_on(s, e):
    return e + DAY if e is not None and s is not None and e <= s else e


def operating(w, periods):
    if w["all_day"] or w["start"] is None:
        return False
    first = {}
    for p in periods or []:
        first.setdefault(p[0], p)
    own = [first[d] for d in w["days"] if d in first]
    if w["end"] is None:
        return bool(own) and 2 * sum(abs(w["start"] - p[1]) <= 30 for p in own) > len(own)
    end = end_on(w["start"], w["end"])
    spans = [(p[1], end_on(p[1], p[3])) for p in own if p[3] is not None]
    if spans:
        return 2 * sum(max(0, min(end, b) - max(w["start"], a)) >= 0.8 * (b - a) for a, b in spans) > len(spans)
    length = end - w["start"]
    return length >= 480 or w["start"] <= 660 and length >= 360


def clock(w, whole=True):
    if w["all_day"] and whole:
        return 0, DAY
    if w["start"] is None:
        return None
    return w["start"], DAY if w["end"] is None else end_on(w["start"], w["end"])


def contains(o, n):
    a, b = clock(o), clock(n)
    return bool(a and b) and a[0] <= b[0] and a[1] >= b[1]


def clash(x, y):
    a, b = clock(x, False), clock(y, False)
    same = all(x[k] == y[k] for k in ("start", "end", "all_day"))
    return bool(set(x["days"]) & set(y["days"])) and not same and bool(a and b) and a[0] < b[1] and b[0] < a[1]


def plain_reconcile(rows, periods):
    groups = {}
    for w in sorted(rows, key=lambda w: w["pos"]):
        k = (w["start"], w["end"], w["all_day"], w["offers"] or "")
        g = groups.setdefault(k, dict(w, days=set(), n=0, offers=w["offers"] or ""))
        g["days"] |= {d for d in w["days"] if 1 <= d <= 7}
        g["n"] += 1
    out = list(groups.values())
    for r in out:
        r.update(days=sorted(r["days"]), active=True, reasons=["merged_duplicate"] if r["n"] > 1 else [])
        if periods:
            kept = [d for d in r["days"] if d in {p[0] for p in periods}]
            if len(kept) < len(r["days"]):
                r["reasons"].append("closed_day_clip")
                r["days"] = kept
                r["active"] = bool(kept)
    shaped = [operating(r, periods) for r in out]
    for r, s in zip(out, shaped):
        if s and (not r["offers"] or any(o["offers"] == r["offers"] and not t for o, t in zip(out, shaped))):
            r["active"] = False
            r["reasons"].append("operating_hours")
    deals = [r for r, s in zip(out, shaped) if r["active"] and r["offers"] and not s]
    for r in out:
        if r["active"] and not r["offers"]:
            covered = {d for o in deals if contains(o, r) for d in o["days"]} & set(r["days"])
            if covered:
                r["reasons"].append("bare_covered_clip")
                if 2 * len(covered) > len(r["days"]):
                    r["active"] = False
                else:
                    r["days"] = [d for d in r["days"] if d not in covered]
    live = [(r, s) for r, s in zip(out, shaped) if r["active"]]
    lost = []
    for i, (a, sa) in enumerate(live):
        for b, sb in live[i + 1 :]:
            la, lb = a["area"] or "all", b["area"] or "all"
            if not clash(a, b) or la != "all" != lb and la != lb:
                continue
            losers = []
            if a["offers"] == b["offers"]:
                if not (a["offers"] and (set(a["days"]) < set(b["days"]) or set(b["days"]) < set(a["days"]))):
                    losers = [(a, b), (b, a)]
            elif not a["offers"] and not sb:
                losers = [(a, b)]
            elif not b["offers"] and not sa:
                losers = [(b, a)]
            lost += [x for x, y in losers if x["suspect"] or not y["suspect"]]
    for r in out:
        if any(r is x for x in lost):
            r["active"] = False
            r["reasons"].append("overlap_conflict")
    return {(r["pos"], tuple(r["days"]), r["active"], tuple(r["reasons"])) for r in out}


def corpus(seed, places=250):
    rng = random.Random(seed)
    rows, hours = [], {}
    minutes = [None, 0, 300, 600, 660, 720, 900, 960, 1020, 1080, 1200, 1260, 1380]
    for place in range(places):
        kind = rng.random()
        periods = None if kind < 0.2 else []
        if kind >= 0.3:
            for day in rng.sample(range(1, 8), rng.randint(3, 7)):
                opens = rng.choice([600, 660, 900])
                close = rng.choice([1260, 1320, 60, None])
                periods.append((day, opens, None if close is None else day if close > opens else day % 7 + 1, close))
                if rng.random() < 0.2:
                    periods.append((day, 1000, day, 1300))
        hours[place] = periods
        for pos in range(rng.randint(0, 7)):
            all_day = rng.random() < 0.1
            rows.append(
                dict(
                    place=place, pos=pos, days=[rng.randint(1, 7) for _ in range(rng.randint(0, 6))], all_day=all_day, start=None if all_day else rng.choice(minutes), end=None if all_day else rng.choice(minutes),
                    offers=rng.choice([None, "", "", "a", "b"]), area=rng.choice([None, "all", "bar", "patio"]), suspect=rng.random() < 0.2,
                )
            )
    return rows, hours


SCHEMA = "place int, pos int, days array<int>, start int, end int, all_day boolean, offers string, area string, suspect boolean"


def frames(spark, rows, hours):
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], SCHEMA), spark.createDataFrame(list(hours.items()), f"place int, periods {weekly.PERIODS}")


def test_reconcile_matches_the_plain_version(spark):
    rows, hours = corpus(11)
    got = {}
    for r in windows.reconcile(*frames(spark, rows, hours)).collect():
        got.setdefault(r.place, set()).add((r.pos, tuple(r.days), r.active, tuple(r.reasons)))
    for place in hours:
        assert got.get(place, set()) == plain_reconcile([r for r in rows if r["place"] == place], hours[place]), place
    reasons = {x for rs in got.values() for r in rs for x in r[3]}
    assert reasons == {"merged_duplicate", "closed_day_clip", "operating_hours", "bare_covered_clip", "overlap_conflict"}


def test_operating_hours(spark):
    rows, hours = corpus(5, 120)
    w, h = frames(spark, rows, hours)
    for r in w.join(h, "place").select("place", "pos", weekly.operating_hours(windows.window_struct(), F.col("periods")).alias("o")).collect():
        assert r.o == operating(next(x for x in rows if (x["place"], x["pos"]) == (r.place, r.pos)), hours[r.place])


def plain_superseded(rows, authoritative):
    gone = set()
    differ = lambda a, b: (a["area"] or "all") != "all" != (b["area"] or "all") and a["area"] != b["area"]
    for w in rows:
        if w["n"] or not clock(w):
            continue
        covers = [s for s in rows if s["n"] and contains(s, w) and not differ(s, w)]
        days = {d for s in covers for d in s["days"]}
        if (authoritative and days & set(w["days"])) or (not authoritative and set(w["days"]) <= days):
            gone.add(w["pos"])
    twins = set()
    for w in rows:
        if w["n"] or w["pos"] in gone or (w["area"] or "all") == "all":
            continue
        if any(s["pos"] not in gone and s["pos"] != w["pos"] and not s["n"] and (s["area"] or "all") == "all" and set(s["days"]) == set(w["days"]) and all(s[k] == w[k] for k in ("start", "end", "all_day")) for s in rows):
            twins.add(w["pos"])
    return gone | twins


def test_superseded_matches_the_plain_version(spark):
    rows, hours = corpus(3)
    rng = random.Random(0)
    for r in rows:
        r.update(n=rng.choice([0, 0, 2]), days=sorted(set(r["days"])))
    frame, _ = frames(spark, rows, hours)
    counts = spark.createDataFrame([(r["place"], r["pos"], r["n"]) for r in rows], "place int, pos int, n_offers int")
    df = frame.join(counts, ["place", "pos"]).withColumnRenamed("pos", "id")
    for authoritative in (False, True):
        got = {}
        for r in windows.superseded(df, authoritative).collect():
            got.setdefault(r.place, set()).add(r.id)
        for place in hours:
            assert got.get(place, set()) == plain_superseded([r for r in rows if r["place"] == place], authoritative), (place, authoritative)
