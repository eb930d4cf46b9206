"""URLs: parts, hosts and what a link is, as native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from almanac.functions import signals

#: Hosts by role.
MENU_PLATFORMS = ("kwickmenu.com", "menu11.com", "wheree.com")
MENU_HOSTS = (
    "squarespace.com", "squarespace-cdn.com", "wixsite.com", "wixstatic.com", "filesusr.com", "usrfiles.com", "weebly.com", "godaddysites.com", "wsimg.com",
    "cdn-website.com", "website-files.com", "wp.com", "shopify.com", "getbento.com", "toasttab.com", "square.site", "popmenu.com", "popmenucloud.com",
    "sagemenu.com", "clover.com", "drive.google.com", "docs.google.com", "googleusercontent.com", "dropbox.com", "dropboxusercontent.com", "amazonaws.com",
    "cloudfront.net", "qr-code-generator.com",
)
AGGREGATORS = (
    "yelp.com", "opentable.com", "tripadvisor.com", "zomato.com", "allmenus.com", "menupix.com", "foursquare.com", "restaurantguru.com", "yellowpages.com",
    "doordash.com", "ubereats.com", "grubhub.com", "seamless.com", "postmates.com",
)
NOT_OWN = (
    "instagram.com", "facebook.com", "m.facebook.com", "twitter.com", "x.com", "tiktok.com", "linktr.ee", "linktree.com", "linkin.bio", "beacons.ai",
    "google.com", "hilton.com", "marriott.com", "hyatt.com", "ihg.com", "choicehotels.com", "wyndhamhotels.com", "booking.com",
)
DENIED = (
    "ultimatehappyhours", "seattletravel", "happyhourdealfinder", "happyhour.com", "happyhours.com", "restaurantji", "sirved", "singleplatform", "cheerhop",
    "thehappyhourfinder", "happyhourmaps", "tacotuesday.com", "usmenuguide",
)
SOCIAL = ("facebook.com", "fb.com", "instagram.com", "twitter.com", "x.com", "linktr.ee", "yelp.com")
SOCIAL_SOURCES = ("instagram.com", "facebook.com", "fb.com")
OWN_CDNS = (
    "wixstatic.com", "wixsite.com", "squarespace-cdn.com", "wsimg.com", "shopify.com", "popmenucloud.com", "cdn-website.com", "website-files.com",
    "cloudfront.net", "azurefd.net", "wp.com", "godaddysites.com",
)
PLATFORM_SITES = (
    "order.online", "carrd.co", "doordash.com", "ubereats.com", "grubhub.com", "postmates.com", "seamless.com", "chownow.com", "slicelife.com", "toasttab.com",
    "clover.com", "linktr.ee", "beacons.ai",
)
PARKING = (
    "sedoparking", "sedo.com", "dan.com", "afternic", "hugedomains", "parkingcrew", "bodis.com", "above.com", "uniregistry", "domainmarket", "cashparking",
    "parklogic", "domainsponsor", "voodoo.com", "buydomains", "godaddysites-parked",
)
TWO_PART_SUFFIXES = ("co.uk", "org.uk", "com.au", "net.au", "co.nz", "com.br", "co.jp", "com.mx")
STATIC_PAGES = ("about", "faq", "for-restaurants", "submit", "styleguide", "admin", "api", "_next", "sitemap.xml", "robots.txt", "llms.txt", "manifest.webmanifest")
GUESSES = (
    "/happy-hour", "/happyhour", "/happy-hour-menu", "/menu/happy-hour", "/menus/happy-hour", "/specials", "/bar-menu", "/drink-menu", "/drinks", "/cocktails",
    "/menu", "/menus", "/food-menu",
)
MORE_GUESSES = ("/vermut-hour", "/hora-feliz", "/aperitivo", "/apericena")
MORE_GUESS_NAMES = r"(?i)spanish|mexican|latin|tapas|peruvian|argentin|cuban|spaniard|italian|trattoria|osteria|enoteca|cantina|taqueria|taco|vermut|aperitivo|apericena"
ORDERING = (
    "facebook.com", "instagram.com", "linktr.ee", "linktree", "doordash.com", "ubereats.com", "grubhub.com", "toasttab.com", "spoton.com", "orders.co",
    "order.spoton.com", "mobile-webview", "square.site", "rebrand.ly",
)


def hostname(url: Column) -> Column:
    """The host in lower case; null if there is no scheme and host."""
    return F.nullif(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


def host(url: Column) -> Column:
    return F.regexp_replace(hostname(url), r"^www\.", "")


def path(url: Column) -> Column:
    """The path, "/" if empty, percent signs decoded where they can be; null without host."""
    raw = F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+([^?#]*)", 1)
    return F.when(hostname(url).isNotNull(), F.when(raw == "", "/").otherwise(decoded(raw)))


def decoded(text: Column) -> Column:
    """Percent escapes decoded, plus signs kept; as it was if an escape is broken."""
    return F.coalesce(F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B"))), text)


def under(h: Column, hosts) -> Column:
    """The host is one of ``hosts`` or below one."""
    return F.coalesce(h.rlike(r"(^|\.)(" + "|".join(x.replace(".", r"\.") for x in hosts) + ")$"), F.lit(False))


def mentions(h: Column, parts) -> Column:
    return F.coalesce(h.rlike("|".join(x.replace(".", r"\.") for x in parts)), F.lit(False))


def last_two(h: Column) -> Column:
    """The domain by its last two labels."""
    labels = F.filter(F.split(h, r"\."), lambda x: x != "")
    return F.array_join(F.slice(labels, F.greatest(F.lit(1), F.size(labels) - 1), F.lit(2)), ".")


def registrable(h: Column) -> Column:
    """As ``last_two``, but three labels under suffixes of two."""
    labels = F.split(h, r"\.")
    three = F.array_join(F.slice(labels, F.greatest(F.lit(1), F.size(labels) - 2), F.lit(3)), ".")
    return F.when(F.size(labels) <= 2, h).when(last_two(h).isin(*TWO_PART_SUFFIXES), three).otherwise(last_two(h))


def menu_platform(url: Column) -> Column:
    return under(host(url), MENU_PLATFORMS)


def denied_source(url: Column) -> Column:
    return mentions(F.coalesce(hostname(url), F.lower(url)), DENIED)


def not_own_site(url: Column) -> Column:
    return under(host(url), AGGREGATORS + NOT_OWN)


def suspect_provenance(source: Column, website: Column) -> Column:
    """A denied or collecting host, or another domain than the place's own; unknown hosts and menu hosts give no opinion."""
    s, w = host(source), host(website)
    return F.coalesce(F.when(s.isNull(), False).when(denied_source(source) | under(s, AGGREGATORS), True).when(w.isNull() | under(s, MENU_HOSTS), False).otherwise(registrable(s) != registrable(w)), F.lit(False))


def first_party(url: Column, website: Column) -> Column:
    h, w = host(url), host(website)
    return F.coalesce(~denied_source(url) & ((h == w) | h.endswith(F.concat(F.lit("."), w))), F.lit(False))


def third_party(source: Column, website: Column) -> Column:
    s, w = hostname(source), hostname(website)
    domain = last_two(w)
    return F.coalesce(~under(s, SOCIAL_SOURCES) & ~under(s, OWN_CDNS) & (last_two(s) != domain) & ~F.contains(F.lower(path(source)), domain), F.lit(False))


def own_subdomain(source: Column, website: Column) -> Column:
    s, w = host(source), host(website)
    return F.coalesce((s != w) & (last_two(s) == last_two(w)), F.lit(False))


def home_page(url: Column) -> Column:
    return F.coalesce(F.regexp_replace(path(url), "/+$", "") == "", F.lit(False))


def _latest_year(url: Column) -> Column:
    return F.array_max(F.transform(F.regexp_extract_all(path(url), F.lit(r"(?<!\d)(20\d{2})(?!\d)"), 1), lambda y: y.cast("int")))


def stale_dated(url: Column, year: Column) -> Column:
    """The path names years, the latest two or more before ``year``."""
    return F.coalesce(_latest_year(url) <= year - 2, F.lit(False))


def stale_event(url: Column, year: Column) -> Column:
    return F.coalesce(path(url).rlike(signals.EVENT_PATH), F.lit(False)) | stale_dated(url, year)


def shop_page(url: Column) -> Column:
    return F.coalesce(path(url).rlike(signals.SHOP_PATH), F.lit(False))


def platform_site(url: Column) -> Column:
    return under(hostname(url), PLATFORM_SITES)


def url_score(url: Column) -> Column:
    """How likely a page lists offers: 110, 100, 70, 60, 40, 30 or 0."""
    u = F.replace(decoded(F.lower(url)), F.lit("+"), F.lit(" "))
    return F.coalesce(
        F.when(u.rlike(signals.OFFER_HOUR), F.when(u.contains("menu"), 110).otherwise(100))
        .when(u.contains("special"), 70)
        .when(u.rlike(r"(beer|drink|cocktail|wine)[-_ ]?menu|/(drinks|cocktails)\b"), 60)
        .when(u.rlike(r"food[-_ ]?menu"), 40)
        .when(u.rlike(r"/menus?\b"), 30),
        F.lit(0),
    )


def menu_document(url: Column) -> Column:
    return F.coalesce(F.regexp_replace(decoded(F.lower(url)), "[^a-z]+", " ").rlike(signals.MENU_DOC), F.lit(False))


def normalise_url(raw: Column) -> Column:
    """A web address without spaces, https unless it says http, host in lower case with a dot; null for anything else."""
    t = F.regexp_replace(F.coalesce(raw, F.lit("")), r"\s+", "")
    full = F.when(t.rlike("(?i)^https?://"), t).otherwise(F.concat(F.lit("https://"), F.regexp_replace(t, "^/+", "")))
    parts = lambda i: F.regexp_extract(full, r"(?i)^(https?)://([^/?#:@]+)((?::\d+)?)(.*)$", i)
    rest = F.when(parts(4).startswith("/"), parts(4)).otherwise(F.concat(F.lit("/"), parts(4)))
    port = F.when(F.concat(F.lower(parts(1)), parts(3)).isin("http:80", "https:443"), "").otherwise(parts(3))
    good = (t != "") & ~t.rlike("(?i)^(javascript|data|vbscript|file|mailto|tel|blob):") & parts(2).contains(".")
    return F.when(good, F.concat(F.lower(parts(1)), F.lit("://"), F.lower(parts(2)), port, rest))


def source_kind(url: Column) -> Column:
    p = F.regexp_extract(F.trim(url), r"^([^?#]*)", 1)
    return F.when(url.rlike("(?i)/uploads/evidence/"), "reader-photo").when(p.rlike(r"(?i)\.pdf$"), "pdf").when(p.rlike(r"(?i)\.(jpe?g|png|webp|gif|avif|heic|bmp|tiff?)$"), "image").otherwise("page")


def page_kind(url: Column) -> Column:
    """struct<kind, state, city, slug> of a site's page by the segments of its path."""
    segments = F.filter(F.split(F.coalesce(path(url), url), "/"), lambda s: s != "")
    n, at = F.size(segments), lambda i: F.get(segments, F.lit(i))
    kind = F.when((n == 0) | at(0).isin(*STATIC_PAGES), "static").when((n == 4) & (at(2) == "venue"), "venue").when(n == 3, "area").when(n == 2, "city").otherwise("static")
    return F.struct(kind.alias("kind"), F.when(kind != "static", at(0)).alias("state"), F.when(kind != "static", at(1)).alias("city"), F.when(kind == "venue", at(3)).when(kind == "area", at(2)).alias("slug"))


def city_path(state: Column, city: Column) -> Column:
    return F.concat(F.lit("/"), F.lower(state), F.lit("/"), city)


def venue_path(state: Column, city: Column, slug: Column) -> Column:
    return F.concat(city_path(state, city), F.lit("/venue/"), slug)


def guesses(url: Column, kind: Column) -> Column:
    """Addresses on the same site that often hold what is looked for; more of them if name and types (``kind``) suggest it."""
    origin = F.regexp_extract(url, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+)", 1)
    some, more = (F.array(*[F.lit(p) for p in x]) for x in (GUESSES, GUESSES + MORE_GUESSES))
    paths = F.when(F.coalesce(kind, F.lit("")).rlike(MORE_GUESS_NAMES), more).otherwise(some)
    return F.when(origin != "", F.transform(paths, lambda p: F.concat(origin, p)))


def site_kind(url: Column) -> Column:
    t = F.trim(F.coalesce(url, F.lit("")))
    return F.when(t == "", "none").when(mentions(F.coalesce(hostname(t), F.lower(t)), ORDERING), "social_only").otherwise("real")


def fetch_key(url: Column) -> Column:
    """What makes two links the same page: no fragment, scheme or "www.", no final slash."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(url, "#.*$", ""), r"(?i)^https?://(www\.)?", ""), "/$", "")


def links(html: Column) -> Column:
    """All href targets."""
    return F.regexp_extract_all(html, F.lit(r"(?i)<a\b[^>]*?\bhref\s*=\s*[\"']([^\"']+)[\"']"), 1)


def site_map(xml: Column) -> Column:
    return F.transform(F.regexp_extract_all(xml, F.lit(r"(?is)<loc>\s*(.*?)\s*</loc>"), 1), lambda u: F.replace(u, F.lit("&amp;"), F.lit("&")))


def directions(lat: Column, lng: Column, name: Column) -> Column:
    return F.concat(F.lit("https://www.google.com/maps/dir/?api=1&destination="), F.url_encode(F.concat_ws(",", lat.cast("string"), lng.cast("string"))), F.lit("&q="), F.url_encode(name))
