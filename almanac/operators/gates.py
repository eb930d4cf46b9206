"""Plausibility gates: verdicts about windows, offers, sites and candidates, as native expressions.

Each takes columns and returns a column, so they run inside code generation and in one pass over any number of rows. The
numbers are fixed values of the gates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from almanac.functions import names, signals, urls, weekly

LEAST_CONFIDENCE, MEAL_AVERAGE, MEAL_ITEM, MENU_ITEMS, EVENING, AT_CLOSE = 0.5, 1200, 3000, 3, 900, 45
BARE_LONG, BARE_START, BARE_END = 360, 720, 960
#: Flag type -> votes to confirm, votes to deny, days until it expires.
VOTES = {"discontinued": (5, 3, 14), "closed": (5, 3, 14), "price_increase": (3, 2, 21), "hours_changed": (3, 2, 21), "other": (5, 3, 14)}
AUTO_FIXABLE = ("assumed_days_avoidable", "duplicate_windows", "implausible_active")


def which(*tests: tuple[Column, str]) -> Column:
    """The names of the tests that hold, in order."""
    return F.array_compact(F.array(*[F.when(F.coalesce(test, F.lit(False)), name) for test, name in tests]))


def first_of(*rules: tuple[Column, str], otherwise: str | None = None) -> Column:
    """The name of the first rule that holds."""
    return F.coalesce(*[F.when(test, name) for test, name in rules], F.lit(otherwise))


def let(value: Column, body) -> Column:
    """``body`` of ``value``, which is evaluated once however often the body refers to it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _texts(offers: Column, describe: bool = True) -> Column:
    part = lambda o: F.concat_ws(" ", o["name"], o["description"]) if describe else F.coalesce(o["name"], F.lit(""))
    return F.array_join(F.transform(offers, part), " | ")


def _prices(offers: Column) -> Column:
    return F.filter(F.transform(offers, lambda o: o["cents"]), lambda c: c > 0)


def _mean(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, v: s + v, lambda s: F.when(F.size(values) > 0, s / F.size(values)))


def average_price(offers: Column) -> Column:
    """Mean of the positive prices in cents; null without any."""
    return _mean(_prices(offers))


def runs_to_close(w: Column, periods: Column) -> Column:
    """An evening window whose end is at the close, or nearly, on most of its days whose close is known."""
    first = lambda d: F.get(F.filter(periods, lambda p: p["open_day"] == d), F.lit(0))
    closes = F.filter(F.transform(w["days"], lambda d: weekly.end_of(first(d)["open_min"], first(d)["close_min"])), lambda c: c.isNotNull())
    late = F.filter(closes, lambda c: weekly.end_of(w["start"], w["end"]) >= c - AT_CLOSE)
    return F.coalesce((w["start"] >= EVENING) & (2 * F.size(late) > F.size(closes)), F.lit(False))


def _facts(offers: Column) -> Column:
    """What the gates need of a window's offers."""
    return let(
        F.struct(_prices(offers).alias("prices"), _texts(offers).alias("texts")),
        lambda x: F.struct(
            F.size(offers).alias("n"),
            x["texts"].alias("texts"),
            _texts(offers, False).alias("names"),
            F.size(x["prices"]).alias("priced"),
            F.array_min(x["prices"]).alias("least"),
            _mean(x["prices"]).alias("mean"),
            F.forall(offers, lambda o: F.coalesce(o["kind"] == "food", F.lit(False))).alias("food"),
        ),
    )


def _full_price(facts: Column) -> Column:
    # offers are told apart by bars, which no drink's name holds, so their texts can be searched as one
    dry = ~facts["texts"].rlike(signals.MEAL_ALCOHOL)
    return (facts["n"] > 0) & facts["food"] & (facts["priced"] >= MENU_ITEMS) & (facts["mean"] >= MEAL_AVERAGE) & dry


def full_price_menu(offers: Column) -> Column:
    return let(_facts(offers), _full_price)


def meal_signs(w: Column, offers: Column, notes: Column, source: Column, periods: Column) -> Column:
    """Why a window is a meal service and no offer: any of language, menu_to_close, lunch_price, dinner_price, midday, costly.
    The window's own words for an offer hour clear all, those of its source only what price and time suggest."""
    notes = F.coalesce(notes, F.lit(""))
    start, end = w["start"], w["end"]

    def signs(f: Column) -> Column:
        own = signals.offer_hour(F.concat_ws(" ", f["texts"], notes))
        page = signals.offer_hour(F.coalesce(source, F.lit("")))
        forward, dear = end > start, f["mean"] > MEAL_AVERAGE
        lunch = dear & forward & (start <= 720) & (end <= 960)
        found = which(
            (F.concat_ws(" ", f["names"], notes).rlike(signals.MEAL), "language"),
            (_full_price(f) & runs_to_close(w, periods), "menu_to_close"),
            (~page & lunch, "lunch_price"),
            (~page & ~F.coalesce(lunch, F.lit(False)) & dear & forward & (start >= 1020) & (end >= 1260), "dinner_price"),
            (~page & (f["n"] >= 1) & forward & start.between(660, 840) & (end <= 960), "midday"),
            (~page & f["priced"].between(1, 2) & (f["least"] >= MEAL_ITEM), "costly"),
        )
        return F.when(own, F.array().cast("array<string>")).otherwise(found)

    return let(_facts(offers), signs)


def bare_suspect(w: Column, offers: Column, notes: Column) -> Column:
    """Without offers or words for them: as long as opening hours, or in the middle of the day."""
    start, end = w["start"], w["end"]
    shape = (end > start) & ((end - start >= BARE_LONG) | (start <= BARE_START) & (end <= BARE_END))
    return F.coalesce((F.size(offers) == 0) & ~signals.offer_hour(F.coalesce(notes, F.lit(""))) & shape, F.lit(False))


def all_day_artifact(offers: Column, notes: Column) -> Column:
    return (F.size(offers) == 0) & ~signals.offer_hour(F.coalesce(notes, F.lit("")))


def realness(w: Column, offers: Column, notes: Column, source: Column, periods: Column, confidence: Column, time_known: Column) -> Column:
    """Why a window should be hidden; none: show it."""
    many = w["all_day"] & (F.size(w["days"]) >= 3)
    return F.array_distinct(
        which(
            (many, "all_day_many_days"),
            (w["all_day"] & ~many & all_day_artifact(offers, notes), "bare_non_hh_window"),
            (~time_known, "no_time_window"),
            ((confidence < LEAST_CONFIDENCE) & ~(time_known & (F.size(offers) > 0)), "low_confidence"),
            (F.size(meal_signs(w, offers, notes, source, periods)) > 0, "meal_special"),
            (bare_suspect(w, offers, notes), "bare_non_hh_window"),
            (weekly.implausible(w["start"], w["end"]), "implausible_window_duration"),
        )
    )


def all_day_rescue(reasons: Column, w: Column, n_offers: Column, place_has_all_day: Column) -> Column:
    """A narrow all-day offer hidden only for want of a time, at a place that shows such offers already."""
    only = (F.size(reasons) > 0) & F.forall(reasons, lambda r: r == "no_time_window")
    return place_has_all_day & w["all_day"] & (n_offers > 0) & (F.size(w["days"]) < 3) & only


def offer_name_key(name: Column) -> Column:
    low = F.lower(F.trim(F.coalesce(name, F.lit(""))))
    return F.regexp_replace(F.regexp_replace(low, r"^\$\s*\d+(\.\d+)?\s+(off\s+)?", ""), r"\s+", " ")


def without_price(name: Column, cents: Column) -> Column:
    """The name without a leading price that the price field repeats."""
    cut = F.regexp_replace(name, r"(?i)^\$\s*\d+(\.\d+)?\s+(?!off\b)", "")
    return F.when(cents.isNotNull() & (cut != ""), cut).otherwise(name)


def heading(name: Column) -> Column:
    n = F.trim(name)
    return F.coalesce(n.rlike(r"(?i)^happy\s+hour\s+at\b") | n.rlike(r"(?i)^happy\s+hour(\s+(menu|specials?|deals?|hours?|time|food|drinks?))?\s*$"), F.lit(False))


def stored_offer_action(name: Column, cents: Column) -> Column:
    clean = without_price(name, cents)
    drop = heading(clean) & (cents.isNull() | F.trim(name).rlike(r"^\$\s*\d"))
    return first_of((drop, "drop"), (clean.isNotNull() & (clean != name), "rename"), otherwise="keep")


def offer_junk(name: Column, cents: Column, description: Column, kind: Column) -> Column:
    """The rule that an offer is no offer by; null if none."""
    n = F.trim(F.coalesce(name, F.lit("")))
    low = F.regexp_replace(F.lower(n), r"\s+", " ")
    words = F.filter(F.split(low, "[^a-z0-9]+"), lambda t: t != "")
    blank = F.trim(F.coalesce(description, F.lit(""))) == ""
    core = F.trim(F.regexp_replace(F.regexp_replace(low, r"\b(seasonal|small|large|each|regular|reg|house|fresh|classic)\b", " "), r"\s+", " "))
    return first_of(
        (n.rlike(r"^\$\s*\d+(\.\d{1,2})?$") & blank, "price-as-name"),
        (n.rlike(signals.STORE_LABEL) | n.rlike(r"(?is)\bshop\b.*\bshop\b"), "ecommerce-chrome"),
        ((F.size(words) >= 2) & F.forall(words, lambda t: t.isin(*signals.NAV_WORDS)), "nav-boilerplate"),
        ((F.coalesce(kind, F.lit("")) != "food") & (n != "") & ~n.rlike(signals.JUNK_ALCOHOL) & core.isin(*signals.SOFT_DRINKS), "bare-soft-drink"),
    )


def sanitised(offers: Column, days: Column, price_level: Column) -> Column:
    """array<struct<pos, name, cents, description, kind, category, verdict, warnings>> of array<struct<name, cents, description,
    kind, category>>: "heading", "junk" and "duplicate" offers are to be dropped, the others are clean; food told as drink
    changes its kind; doubtful ones carry warnings. What is used twice is bound, so that an offer is judged once."""

    def judge(o: Column, i: Column) -> Column:
        return let(without_price(o["name"], o["cents"]), lambda name: let(F.concat_ws(" ", name, o["description"]), lambda text: told(o, i, name, text)))

    def told(o: Column, i: Column, name: Column, text: Column) -> Column:
        found = F.struct(((o["kind"] == "drink") & signals.food_as_drink(text)).alias("food"), signals.named_days(text).alias("named"))
        return let(found, lambda f: verdict_of(o, i, name, text, f["food"], f["named"]))

    def verdict_of(o: Column, i: Column, name: Column, text: Column, food: Column, named: Column) -> Column:
        kind = F.when(food, "food").otherwise(o["kind"])
        cheap, dear = (kind == "drink") & o["cents"].between(1, 200), (kind == "drink") & (o["cents"] >= 1400) & (price_level <= 2)
        warn = which((food, "rekinded"), ((F.size(named) > 0) & ~((F.size(days) == F.size(named)) & (F.size(F.array_except(named, days)) == 0)), "days"), (cheap, "cheap"), (dear, "dear"))
        verdict = first_of((heading(name), "heading"), (offer_junk(name, o["cents"], o["description"], o["kind"]).isNotNull(), "junk"), otherwise="keep")
        key = F.concat_ws("|", offer_name_key(name), F.coalesce(o["cents"].cast("string"), F.lit("")), F.lower(F.trim(F.coalesce(o["description"], F.lit("")))))
        category = F.when(food, F.when(text.rlike(signals.APPETIZER), "appetizer").otherwise("other")).otherwise(o["category"])
        return F.struct(i.alias("pos"), name.alias("name"), o["cents"].alias("cents"), o["description"].alias("description"), kind.alias("kind"), category.alias("category"), verdict.alias("verdict"), warn.alias("warnings"), key.alias("key"))

    def marked(judged: Column) -> Column:
        keys = F.transform(judged, lambda x: F.when(x["verdict"] == "keep", x["key"]))
        return let(keys, lambda k: F.transform(judged, lambda o: final(o, (o["verdict"] == "keep") & (F.array_position(k, o["key"]) <= o["pos"]))))

    def final(o: Column, repeated: Column) -> Column:
        return F.struct(*[o[f].alias(f) for f in ("pos", "name", "cents", "description", "kind", "category")], F.when(repeated, "duplicate").otherwise(o["verdict"]).alias("verdict"), o["warnings"].alias("warnings"))

    return let(F.transform(offers, judge), marked)


def passes_alcohol(serves: Column, chain_offers: Column, name: Column, primary: Column, types: Column) -> Column:
    """Only an explicit no gates, and not if a sibling offers or the name or type tells otherwise."""
    return ~(F.coalesce(serves == False, F.lit(False)) & ~F.coalesce(chain_offers, F.lit(False)) & ~names.alcohol_signal(name, primary, types))  # noqa: E712


def dead_end(serves: Column, chain_offers: Column, name: Column, primary: Column, types: Column) -> Column:
    return ~passes_alcohol(serves, chain_offers, name, primary, types) | F.coalesce(primary.isin(*signals.NEVER_TYPES), F.lit(False))


def stub_action(name: Column, primary: Column, types: Column, website: Column, health: Column, alcohol_only: bool) -> Column:
    wet, site = names.alcohol_signal(name, primary, types), F.trim(F.coalesce(website, F.lit(""))) != ""
    dead = site & F.coalesce(health.isin("dns_dead", "parked", "expired_cert", "invalid_cert", "http_error", "unreachable"), F.lit(False))
    return first_of(
        (site & urls.menu_platform(website), "delete"), (~wet & (~site | dead), "delete"), (wet, "keep"), (primary.isin(*signals.NEVER_TYPES), "hide"), otherwise="hide" if alcohol_only else "keep"
    )


def stub_site_action(name: Column, primary: Column, types: Column, reachable: Column, text: Column, unreadable: Column) -> Column:
    t = F.trim(F.coalesce(text, F.lit("")))
    return first_of(
        (names.bowling(name, primary, types), "hide"), (names.alcohol_signal(name, primary, types), "keep"), (F.coalesce(unreadable, F.lit(False)) & (t == ""), "keep"), (~reachable, "hide"),
        ((F.length(t) < 200) | signals.parked(t), "hide"), otherwise="keep",
    )


def probe_health(status: Column, error: Column, final_url: Column, url: Column) -> Column:
    code, last, start = F.upper(error), urls.hostname(final_url), urls.hostname(url)
    moved = start.isNull() | (urls.last_two(last) != urls.last_two(start))
    return first_of(
        (code == "CERT_HAS_EXPIRED", "expired_cert"),
        (code.isin("ERR_TLS_CERT_ALTNAME_INVALID", "DEPTH_ZERO_SELF_SIGNED_CERT", "SELF_SIGNED_CERT_IN_CHAIN", "UNABLE_TO_VERIFY_LEAF_SIGNATURE", "CERT_NOT_YET_VALID", "ERR_TLS_CERT_ALTNAME_FORMAT", "HOSTNAME_MISMATCH"), "invalid_cert"),
        (code.isin("ENOTFOUND", "EAI_AGAIN", "EAI_NODATA", "EAI_NONAME"), "dns_dead"),
        (F.coalesce(code, F.lit("")) != "", "unreachable"),
        (status.isNotNull() & urls.mentions(last, urls.PARKING) & moved, "parked"),
        (status.isin(401, 403, 406, 429), "blocked"),
        ((status >= 400) & urls.under(F.coalesce(last, start), urls.SOCIAL), "blocked"),
        (status >= 400, "http_error"),
        (status.isNotNull(), "ok"),
        otherwise="unreachable",
    )


def read_health(has_url, platform, social, ok, status, network, has_text, parked, squatter, broken) -> Column:
    return first_of(
        (~has_url, "no-site"), (platform, "menu-platform"), (social, "social-only"), (ok & has_text & squatter, "squatter"), (ok & has_text & parked, "parked"), (ok & has_text & broken, "broken-https"),
        (ok & has_text, "live"), (ok, "unreadable"), (network == "dead", "dead"), (network == "blocked", "blocked"), ((status >= 500) | status.between(404, 410), "dead"), otherwise="blocked",
    )


def quality_verdict(live: Column, alcohol: Column, health: Column) -> Column:
    gone = health.isin("dead", "squatter", "parked")
    return first_of((live > 0, "keep"), (alcohol & (health == "no-site"), "review"), (alcohol & ~gone, "keep"), (alcohol, "drop?"), (gone | health.isin("no-site", "menu-platform", "live", "broken-https"), "drop?"), otherwise="review")


def drop_reason(status, name, website, primary, types, near_airport, reviews, in_area, other_city) -> Column:
    """The discovery ladder: the first gate that a candidate fails; null if it passes all."""
    return first_of(
        (names.closed_business(status), "closed"), (names.denied_chain(name), "chain"), (names.no_offer_format(name, urls.hostname(website)), "format"), (names.excluded_type(primary, types), "place-type"),
        (near_airport, "airport"), (names.low_signal(reviews, name, primary, types), "low-signal"), (~in_area, "out-of-area"), (other_city, "in-other-city"),
    )


def flag_decision(kind: Column, confirm: Column, deny: Column, opened: Column, now: Column) -> Column:
    """"rejected", "confirmed", "expired" or "pending"; denials count first. Times are timestamps; ages are in fractions of days."""
    votes = lambda i: F.coalesce(names.lookup({k: v[i] for k, v in VOTES.items()}, kind), F.lit(VOTES["other"][i]))
    age = (F.unix_micros(now) - F.unix_micros(opened)) / 86_400_000_000
    return first_of((deny >= votes(1), "rejected"), (confirm >= votes(0), "confirmed"), (age >= votes(2), "expired"), otherwise="pending")


def contribution_route(enabled, own_site, critical, banned, trust, confidence, least: float = 0.85) -> Column:
    return F.when(reduce(lambda a, b: a & b, [enabled, own_site, ~critical, ~banned, trust >= 0, confidence >= least]), "auto_apply").otherwise("queue")


def verdict_action(kind: Column, n_days: Column, alcohol: Column) -> Column:
    return first_of((kind == "real_window", "correct"), ((kind == "legit_all_day") & n_days.between(1, 2), "keep"), (kind.isin("legit_all_day", "unconfirmable") | alcohol, "stub"), otherwise="delete_venue")


def spend_tier(spent: Column, cap: int = 2000, warning: int = 1500) -> Column:
    return first_of((spent >= cap, "stage1_only"), (spent >= warning, "critical_only"), otherwise="normal")


def may_verify(spent: Column, risk: Column, call: int = 5, cap: int = 2000, warning: int = 1500) -> Column:
    return ~((spent + call > cap) | (spend_tier(spent, cap, warning) == "critical_only") & (risk != "critical"))


def model_cents(model: Column, tokens_in: Column, tokens_out: Column, batch: Column) -> Column:
    """Cost by the first price whose name the model's holds, in whole cents upwards; batches cost half."""
    prices = (("glm", 0, 0), ("haiku", 1, 5), ("sonnet", 3, 15), ("opus", 15, 75))
    rate = lambda i: F.coalesce(*[F.when(F.lower(model).contains(p[0]), p[i]) for p in prices], F.lit((0, 3, 15)[i]))
    return F.ceil((tokens_in * rate(1) + tokens_out * rate(2)) / 1e6 * F.when(batch, 50).otherwise(100)).cast("long")


def risk_level(score: Column) -> Column:
    return first_of((score >= 75, "critical"), (score >= 50, "high"), (score >= 25, "medium"), otherwise="low")


def trust_score(outcomes: Column) -> Column:
    """The score after outcomes in order (array<boolean>): +5 or -10 each, held within -100 and 100 at every step."""
    return F.aggregate(outcomes, F.lit(0), lambda s, ok: F.greatest(F.lit(-100), F.least(F.lit(100), s + F.when(ok, 5).otherwise(-10))))


def accuracy(right: Column, wrong: Column) -> Column:
    """Per cent, halves upwards; 0 of none."""
    return F.when(right + wrong > 0, F.floor(100 * right / (right + wrong) + 0.5)).otherwise(0).cast("int")
