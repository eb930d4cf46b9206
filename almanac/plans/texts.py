"""Queries of the text, link and page functions over whole tables.

Inputs are the tables' own texts (names of parts, addresses and pages, documents) with fragments put before or after them by
key, so that every rule is met; keys of fragments are prime to each other. The SQL states each rule in DuckDB's own terms."""

from __future__ import annotations

from pyspark.sql import functions as F

from almanac.functions import geo, names, pages, signals, urls, weekly
from almanac.operators import gates, review
from almanac.plans.catalogue import query
from almanac.session import table

PREFIXES = ["", "The ", "St. ", "Mt ", "Old ", "Joe's “Best” ", "McDonald's ", "Chili's ", "North ", "Café ", "El ", "Oakdale --- "]
SUFFIXES = [
    "", " Village", " (Now Open!)", " [World Cup] – ", " & Grill", " Sports Bar", " Brewhouse", " Tavern", " Wine Bar", " Elks 1234", " Lanes", " Oakdale", " Pub (East)",
    " Taqueria", " Noodle House", " Cocktail Loaf", " Ale House St",
]
SCHEMES = ["https://", "http://", "HTTP://", "//", ""]
HOSTS = [
    "a.com", "www.own.co.uk", "menu.own.co.uk", "own.com", "menu.own.com", "notown.com", "img1.wsimg.com", "notwsimg.com", "www.sirved.com", "m.facebook.com", "yelp.com",
    "cdn.cloudfront.net", "static.wixstatic.com", "images.squarespace-cdn.com", "order.toasttab.com", "tapas.com", "www.a.com:8080", "other.co.uk", "linktr.ee",
]
PATHS = [
    "", "/", "/menu", "/Happy%20Hour+menu.pdf", "/happy_hour", "/specials", "/drink-menu", "/food_menu", "/menus2", "/%zz/menu", "/nudo_menu.png", "/team.png",
    "/uploads/2022/x.png", "/2022/2023/x", "/x20221", "/uploads/evidence/1", "/x.PDF?y", "/x.jpeg#z", "/media/ab.png/v1/fill/w_10/x.png", "/a.jpg?format=2500w",
    "/a.jpg?x=1&format=750w", "/a.jpg", "/x/#y",
]
FRAGMENTS = [
    "", "Just a moment...", "Attention Required! | Cloudflare", "This domain is PARKED", "Find Restaurants Near You", "Full Bar & patio", "for the sake of it", "Must be 21",
    "Taco Tuesdays", "wine on Friday and Sunday", "burgers and fries", " Dine-in only ", "21+ after 9", "Manage your consent here", '[1, "a]b", [2]] tail', "[1,", "[{\"a\": \"b\"}] [2]",
    "Daily specials", "$5 beer", "{}[]=;" * 60, "Happy Hour 3-6 pm", "sake bar", "bodis.com",
]
SNIPPETS = [
    "", '<a href="/menu">x</a><a href="z">Our <b>Specials</b></a><a href="//b.com/q">no</a><a class=c href=\'/menu\'>again</a>', '<a href="hh.pdf">Happy-Hour</a><a href="/menu">menu</a>',
    '{"pageUriSEO":"home"},{"pageUriSEO":"/specials"},{"pageUriSEO":"specials"},{"pageUriSEO":"bar"}',
    '<iframe src="https://x.popmenu.com/a_modal"></iframe><iframe data-src="https://order.toasttab.com/b?x=1&amp;y=2"></iframe>', '<iframe src="https://x.popmenu.com/a_modal"></iframe>',
    '<h2 class="a>b">T</h2><p>a &amp; b &ndash; c</p><svg><p>s</p></svg><br>c&nbsp;d<!-- z -->&amp;lt;', '<script>var a={"note":"<p>Happy Hour 3-6pm</p>","id":"x-1","b":"Beer  special"}</script><script src="q">"menu special"</script>',
    '<p>"/menus/web-happy-hour?location=1" /menus/web-dinner?l=1 https://b.com/menus/web-happy?x=1</p>',
    '<script>{"title":"Bar","items":[{"name":"Ale","price":"$$5"},{"name":"Pie","price":"ask"}]}</script>',
    '<script type="application/ld+json">{"name":"Happy Hour","hasMenuSection":[{"name":"Beer","hasMenuItem":[{"name":"IPA","offers":{"price":"$5.50"}},{"name":" "}]}]}</script>',
]
OFFERS = ["$5  ", "$2 off ", "Happy Hour Menu", "$5 Happy hour", "", "Happy Hour at ", "$ 12.50 "]
MAGIC = ["FFD8FFE0", "89504E470D0A", "4749463839", "524946460000000057454250", "3C737667", "52494646000000005745", ""]
ROBOTS = ["User-agent: *", "Disallow: /private", "User-agent: other", "Disallow: /", "User-agent: ourbot # us", "Disallow:", "Disallow: /priv # p"]
TIMES = ["{h}pm", "{h}:{m} p.m.", "{h}:{m}", "{h}", "noon", "{h}am", "midnight", "{h}{m}", "{h}:{m}:00", "{h} a", "x{h}"]


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _list(values) -> str:
    return "[" + ", ".join(map(_q, values)) + "]"


def _pick(values, key: str = "k") -> str:
    """SQL and, through ``_picked``, Spark: the value whose turn it is by the key."""
    return f"list_extract({_list(values)}, CAST({key} % {len(values)} + 1 AS INTEGER))"


def _picked(values, key: str = "k"):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.col(key) % len(values) + 1).cast("int"))


def matches(x: str, pattern: str) -> str:
    return f"coalesce(regexp_matches({x}, {_q(pattern)}), false)"


def swapped(x: str, pattern: str, by: str = "") -> str:
    return f"regexp_replace({x}, {_q(pattern)}, {_q(by)}, 'g')"


def any_of(values, test: str) -> str:
    """SQL: whether ``test`` holds for a value v."""
    return f"coalesce(len(list_filter({_list(values)}, lambda v: {test})) > 0, false)"


def once(items: str) -> str:
    """SQL: a list's distinct values in their order."""
    return f"list_filter({items}, lambda v, i: list_position({items}, v) = i)"


# ---- inputs

NAMES = f"""names AS (SELECT k, CASE WHEN k % 97 <> 5 THEN {_pick(PREFIXES)} || p_name || {_pick(SUFFIXES)} END AS name,
    {_pick(PREFIXES, "(k * 5)")} || p_name || {_pick(SUFFIXES, "(k * 7)")} AS other FROM (SELECT *, p_partkey AS k FROM part))"""
LINKS = f"""links AS (SELECT *, regexp_replace(hostname, '^www\\.', '') AS host FROM (SELECT *, CASE WHEN regexp_matches(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://')
    THEN nullif(lower(split_part(regexp_extract(split_part(url, '://', 2), '^[^/?#]*'), ':', 1)), '') END AS hostname FROM (
    SELECT p_partkey AS k, CASE WHEN p_partkey % 97 <> 5 THEN {_pick(SCHEMES, "p_partkey")} || {_pick(HOSTS, "p_partkey")} || {_pick(PATHS, "p_partkey")} END AS url FROM part
    UNION ALL SELECT -1 - page_id, url FROM pages)))"""
TEXTS = f"""texts AS (SELECT k, CASE WHEN k % 89 <> 7 THEN {_pick(FRAGMENTS)} || CASE WHEN k % 3 = 0 THEN '' ELSE ' ' || coalesce(text, '') END END AS text FROM (SELECT *, doc_id AS k FROM documents))"""
HTML = f"""pages_ AS (SELECT k, coalesce(html, '') || {_pick(SNIPPETS)} AS html, url, nullif(regexp_extract(url, '^(https?://[^/?#]+)', 1), '') AS origin,
    regexp_replace(regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1), '[^/]*$', '') AS folder FROM (SELECT *, page_id AS k FROM pages))"""


def name_rows(s, d):
    k = table(s, d, "part").withColumn("k", F.col("p_partkey"))
    five, seven = F.col("k") * 5, F.col("k") * 7
    k = k.withColumn("k5", five).withColumn("k7", seven)
    return k.select("k", F.when(F.col("k") % 97 != 5, F.concat(_picked(PREFIXES), "p_name", _picked(SUFFIXES))).alias("name"), F.concat(_picked(PREFIXES, "k5"), F.col("p_name"), _picked(SUFFIXES, "k7")).alias("other"))


def link_rows(s, d):
    made = table(s, d, "part").withColumn("k", F.col("p_partkey")).select("k", F.when(F.col("k") % 97 != 5, F.concat(_picked(SCHEMES), _picked(HOSTS), _picked(PATHS))).alias("url"))
    return made.unionByName(table(s, d, "pages").select((-1 - F.col("page_id")).alias("k"), "url"))


def text_rows(s, d):
    k = table(s, d, "documents").withColumn("k", F.col("doc_id"))
    own = F.when(F.col("k") % 3 == 0, "").otherwise(F.concat(F.lit(" "), F.coalesce("text", F.lit(""))))
    return k.select("k", F.when(F.col("k") % 89 != 7, F.concat(_picked(FRAGMENTS), own)).alias("text"))


def page_rows(s, d):
    k = table(s, d, "pages").withColumn("k", F.col("page_id"))
    return k.select("k", F.concat(F.coalesce("html", F.lit("")), _picked(SNIPPETS)).alias("html"), "url")


def over(name: str, rows, relation: str | None, expression, sql: str | None = None) -> None:
    """A query of one function over every row of an input; ``sql`` states it over ``relation``."""
    source = relation.split(" AS ", 1)[0] if relation else None

    @query(name, f"WITH {relation} SELECT k, {sql} AS output FROM {source}" if sql else None)
    def run(s, d):
        return rows(s, d).select("k", expression().alias("output"))


def _on(column: str, function, *more):
    return lambda: function(F.col(column), *more)


def _joined(function, by: str = " "):
    return lambda: F.array_join(function(), by)


def _none(kind: str = "array<string>"):
    return F.array().cast(kind) if kind.startswith("array") else F.lit(None).cast(kind)


# ---- names

PLAIN = "strip_accents(lower({0}))"
NORMAL = "trim(" + swapped(swapped(PLAIN.format("name"), "['‘’]"), "[^a-z0-9]+", " ") + ")"
TOKENS = "list_filter(string_split_regex(" + PLAIN + ", '[^a-z0-9]+'), lambda t: t <> '')"
BRACKETS = rf"(?i)[(\[][^()\[\]]*{signals.PROMO}[^()\[\]]*[)\]]"
CUT = swapped("name", BRACKETS)
CLEAN = "trim(" + swapped(swapped(swapped(CUT, r"\s{2,}", " "), r"\s+([,.;:])", r"\1"), r"[\s\-–—|]+$") + ")"


def has_phrase(phrases, ends: bool = False) -> str:
    return any_of(phrases, f"{NORMAL} = v OR starts_with({NORMAL}, v || ' ') OR contains({NORMAL}, ' ' || v || ' ')" + (f" OR ends_with({NORMAL}, ' ' || v)" if ends else ""))


SLUG = swapped(swapped(PLAIN.format("name"), "[^a-z0-9]+", "-"), "^-|-$")
over("f2_change_slug", name_rows, NAMES, _on("name", names.change_slug), "coalesce(nullif(left(" + swapped(swapped(swapped("lower(name)", "['\"’]"), "[^a-z0-9]+", "-"), "^-+|-+$") + ", 80), ''), CASE WHEN name IS NOT NULL THEN 'venue' END)")
over("f2_area_slug", name_rows, NAMES, _on("name", names.area_slug), swapped("lower(name)", "[^a-z0-9]+", "-"))
over("f4_without_promo", name_rows, NAMES, _on("name", names.without_promo), f"CASE WHEN {CUT} = name THEN name WHEN {CLEAN} = '' THEN trim(name) ELSE {CLEAN} END")
own = lambda c: f"list_distinct(list_filter({TOKENS.format(c)}, lambda t: NOT list_contains({_list(names.STOPWORDS)}, t)))"
over("f7_names_match", name_rows, NAMES, lambda: F.coalesce(names.names_match(F.col("name"), F.col("other")), F.lit(False)),
     f"(SELECT coalesce(len(x) > 0 AND len(y) > 0 AND (n = least(len(x), len(y)) OR 2 * n >= len(x) + len(y) - n), false) FROM (SELECT x, y, len(list_intersect(x, y)) AS n FROM (SELECT {own('name')} AS x, {own('other')} AS y)))")
WRITTEN = "list_transform(" + TOKENS.format("name") + ", lambda t, i: CASE WHEN t = 'st' THEN CASE WHEN i = 1 THEN 'saint' ELSE 'street' END " + "".join(f"WHEN t = '{a}' THEN '{b}' " for a, b in names.ABBREVIATIONS.items()) + "ELSE t END)"
over("f8_synonym_keys", name_rows, NAMES, _joined(lambda: F.array_sort(names.synonym_keys(F.col("name"), F.lit("Oakdale"))), ","),
     f"""(SELECT array_to_string(list_sort(list_distinct(list_filter([key, CASE WHEN len(t) > 1 AND t[-1] = 'village' AND NOT (len(t) = 2 AND list_contains({_list(names.ARTICLES)}, t[1])) THEN array_to_string(t[:-2], '') END,
     CASE WHEN starts_with(key, 'oakdale') AND len(key) > 7 THEN substr(key, 8) END, CASE WHEN ends_with(key, 'oakdale') AND len(key) > 7 THEN left(key, len(key) - 7) END], lambda x: x IS NOT NULL))), ',')
     FROM (SELECT t, array_to_string(t, '') AS key FROM (SELECT {WRITTEN} AS t)))""")  # fmt: skip
over("f33_paths", name_rows, NAMES, lambda: urls.venue_path(F.lit("WA"), F.lit("tacoma"), names.slug(F.col("name"))), f"'/wa/tacoma/venue/' || {SLUG}")
WET = f"""(SELECT len(list_filter({_list(signals.ALCOHOL_PHRASES)}, lambda v: contains(n, v))) > 0 OR len(list_filter(string_split(n, ' '), lambda w: list_contains({_list(signals.ALCOHOL_WORDS)}, w) OR starts_with(w, 'brew'))) > 0 FROM (SELECT coalesce({NORMAL}, '') AS n))"""
over("f38_alcohol_signal", name_rows, NAMES, lambda: names.alcohol_signal(F.col("name"), F.lit("restaurant"), _none()), WET)
OFFER_CHAIN = has_phrase(names.OFFER_CHAINS)
over("f39_formats", name_rows, NAMES,
     lambda: F.concat_ws(",", *[x.cast("string") for x in (names.denied_chain(F.col("name")), names.offer_chain(F.col("name")), names.no_offer_format(F.col("name"), _none("string")), names.bowling(F.col("name"), _none("string"), _none()))]),
     f"""concat_ws(',', {has_phrase(names.CHAINS)} AND NOT {OFFER_CHAIN}, {OFFER_CHAIN}, {has_phrase(signals.NO_OFFER_FORMATS, True)} OR {matches(NORMAL, "elks ?[0-9]|lodge no ?[0-9]")},
     {any_of(("bowling", "lanes"), f"list_contains(string_split(coalesce({NORMAL}, ''), ' '), v)")})""")  # fmt: skip
KIND = "CASE " + " ".join(f"WHEN {matches('strip_accents(name)', '(?i)' + p)} THEN '{t}'" for p, t in names.NAME_RULES) + " ELSE 'restaurant' END"
LABEL = "CASE kind " + " ".join(f"WHEN '{t}' THEN '{label}'" for t, label in names.LABELS.items()) + " END"
over("f40_place_type", name_rows, NAMES, lambda: F.concat_ws("|", names.place_type(_none("string"), _none(), F.col("name")), names.type_label(names.place_type(_none("string"), _none(), F.col("name")))), f"(SELECT kind || '|' || {LABEL} FROM (SELECT {KIND} AS kind))")
over("t22_likelihood", name_rows, NAMES, lambda: names.likelihood(F.lit("bakery"), _none(), F.col("name")), "CAST(CASE " + " ".join(f"WHEN {matches('name', p)} THEN {f}" for p, f in names.NAME_FLOORS) + " ELSE 0 END AS DOUBLE)")
over("c13_dead_end", name_rows, NAMES, lambda: F.concat_ws("|", gates.dead_end(F.lit(False), _none("boolean"), F.col("name"), F.lit("restaurant"), _none()).cast("string"), gates.dead_end(_none("boolean"), _none("boolean"), F.col("name"), F.lit("restaurant"), _none()).cast("string")), f"concat_ws('|', NOT {WET}, false)")
AREA = "CASE WHEN k % 11 = 0 THEN ' tacoma' WHEN k % 13 = 0 THEN 'Parking  Lot' ELSE name END"
over("f41_area_of_address", name_rows, NAMES, lambda: review.area_of_address(F.array(F.struct(F.expr(AREA).alias("text"), F.array(F.lit("sublocality")).alias("types"))), F.lit("Tacoma")),
     f"(SELECT CASE WHEN lower(a) NOT IN ('', 'parking lot', 'parking', 'unnamed road', 'tacoma') THEN a END FROM (SELECT trim({swapped(AREA, '[ ]+', ' ')}) AS a))")
OFFER_ROWS = f"offers AS (SELECT p_partkey AS k, {_pick(OFFERS, 'p_partkey')} || CASE WHEN p_partkey % 4 = 3 THEN '' ELSE p_name END AS name FROM part)"
PRICED = r"(?i)^\$\s*\d+(\.\d+)?\s+"
UNPRICED = f"CASE WHEN {matches('name', PRICED + 'off')} THEN name ELSE coalesce(nullif(regexp_replace(name, {_q(PRICED)}, ''), ''), name) END"


def heads(x: str) -> str:
    return f"({matches(f'trim({x})', '(?i)^happy +hour +at([^a-z]|$)')} OR {matches(f'trim({x})', '(?i)^happy +hour( +(menu|specials?|deals?|hours?|time|food|drinks?))? *$')})"


over("f35_offer_names", lambda s, d: table(s, d, "part").withColumn("k", F.col("p_partkey")).select("k", F.concat(_picked(OFFERS), F.when(F.col("k") % 4 == 3, "").otherwise(F.col("p_name"))).alias("name")), OFFER_ROWS,
     lambda: F.concat_ws("|", gates.offer_name_key(F.col("name")), gates.without_price(F.col("name"), F.lit(500)), gates.heading(F.col("name")).cast("string"), gates.stored_offer_action(F.col("name"), F.lit(500))),
     f"""concat_ws('|', {swapped(f"regexp_replace(lower(trim(name)), {_q(PRICED[4:] + '(off +)?')}, '')", ' +', ' ')}, {UNPRICED}, {heads('name')},
     CASE WHEN {heads(UNPRICED)} AND starts_with(trim(name), '$') AND {matches('trim(name)', '^[$] *[0-9]')} THEN 'drop' WHEN {UNPRICED} <> name THEN 'rename' ELSE 'keep' END)""")  # fmt: skip

# ---- links

DECODED = "url_decode(replace({0}, '+', '%2B'))"
UNDER = "host = v OR ends_with(host, '.' || v)"
DENIED = any_of(urls.DENIED, "contains(coalesce(hostname, lower(url)), v)")
PATH = "CASE WHEN hostname IS NOT NULL THEN regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+([^?#]*)', 1) END"
U = f"replace({DECODED.format('lower(url)')}, '+', ' ')"


def last_two(h: str) -> str:
    return f"array_to_string(list_slice(string_split({h}, '.'), -2, -1), '.')"


REGISTRABLE = f"CASE WHEN list_contains({_list(urls.TWO_PART_SUFFIXES)}, {last_two('host')}) THEN array_to_string(list_slice(string_split(host, '.'), -3, -1), '.') ELSE {last_two('host')} END"
over("f11_menu_host", link_rows, LINKS, lambda: urls.under(urls.host(F.col("url")), urls.MENU_HOSTS), any_of(urls.MENU_HOSTS, UNDER))
over("f12_denied_source", link_rows, LINKS, _on("url", urls.denied_source), DENIED)
SCORE = f"""CASE WHEN {matches(U, signals.OFFER_HOUR)} THEN CASE WHEN contains({U}, 'menu') THEN 110 ELSE 100 END WHEN contains({U}, 'special') THEN 70
    WHEN {matches(U, "(beer|drink|cocktail|wine)[-_ ]?menu|/(drinks|cocktails)([^a-z0-9_]|$)")} THEN 60 WHEN {matches(U, "food[-_ ]?menu")} THEN 40 WHEN {matches(U, "/menus?([^a-z0-9_]|$)")} THEN 30 ELSE 0 END"""
over("f13_url_score", link_rows, LINKS, _on("url", urls.url_score), SCORE)
over("f14_menu_document", link_rows, LINKS, _on("url", urls.menu_document), matches(swapped(DECODED.format("lower(url)"), "[^a-z]+", " "), signals.MENU_DOC))
over("f16_stale_dated", link_rows, LINKS, lambda: urls.stale_dated(F.col("url"), F.lit(2024)), f"coalesce(list_max(list_transform(list_filter(regexp_extract_all({PATH}, '[0-9]+'), lambda y: len(y) = 4 AND starts_with(y, '20')), lambda y: CAST(y AS INTEGER))) <= 2022, false)")
over("f18_site_kind", link_rows, LINKS, _on("url", urls.site_kind), f"CASE WHEN trim(coalesce(url, '')) = '' THEN 'none' WHEN {any_of(urls.ORDERING, 'contains(coalesce(hostname, lower(url)), v)')} THEN 'social_only' ELSE 'real' END")
WIX = r"(?i)^(https?://static\.wixstatic\.com/media/[^/]+\.(?:jpe?g|png|webp|gif|avif))/v1/.*$"
over("f21_full_image", link_rows, LINKS, _on("url", pages.full_image), f"""CASE WHEN hostname = 'images.squarespace-cdn.com' AND coalesce(CAST(nullif(regexp_extract(url, '[?&]format=([0-9]+)w(&|$)', 1), '') AS INTEGER), 9999) > 1500
    THEN CASE WHEN regexp_matches(url, '[?&]format=') THEN {swapped("url", "([?&])format=[^&#]*", r"\1format=1500w")} ELSE url || CASE WHEN contains(url, '?') THEN '&' ELSE '?' END || 'format=1500w' END ELSE {swapped("url", WIX, chr(92) + "1")} END""")
over("f22_guesses", link_rows, LINKS, _joined(lambda: urls.guesses(F.col("url"), F.col("url"))), f"""(SELECT CASE WHEN o <> '' THEN array_to_string(list_transform(CASE WHEN {matches('url', urls.MORE_GUESS_NAMES)} THEN {_list(urls.GUESSES + urls.MORE_GUESSES)} ELSE {_list(urls.GUESSES)} END, lambda p: o || p), ' ') END
    FROM (SELECT regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+)', 1) AS o))""")
XML = "'<urlset><url><loc> ' || replace(url, '&', '&amp;') || ' </loc></url><LOC>b' || k || '</LOC>'"
over("f27_site_map", link_rows, LINKS, _joined(lambda: urls.site_map(F.expr(XML))), f"array_to_string(list_transform(regexp_extract_all({XML}, '(?is)<loc>\\s*(.*?)\\s*</loc>', 1), lambda u: replace(u, '&amp;', '&')), ' ')")
FILE = "lower(split_part(split_part(trim(url), '?', 1), '#', 1))"
over("f30_source_kind", link_rows, LINKS, _on("url", urls.source_kind), f"CASE WHEN contains(lower(url), '/uploads/evidence/') THEN 'reader-photo' WHEN ends_with({FILE}, '.pdf') THEN 'pdf' WHEN {any_of(('jpg', 'jpeg', 'png', 'webp', 'gif', 'avif', 'heic', 'bmp', 'tif', 'tiff'), f'''ends_with({FILE}, '.' || v)''')} THEN 'image' ELSE 'page' END")
over("f45_url_variants", link_rows, LINKS, _joined(lambda: review.url_variants(F.col("url"))), """(SELECT coalesce(array_to_string(list_filter(['https://' || a || rest, 'https://' || b || rest, 'http://' || a || rest, 'http://' || b || rest], lambda u: u <> own), ' '), '')
    FROM (SELECT a, b, rest, scheme || hostname || rest AS own FROM (SELECT CASE WHEN starts_with(hostname, 'www.') THEN hostname ELSE host END AS a, CASE WHEN starts_with(hostname, 'www.') THEN host ELSE 'www.' || host END AS b,
    CASE WHEN starts_with(tail, '/') THEN tail ELSE '/' || tail END AS rest, scheme FROM (SELECT regexp_extract(url, '^[a-zA-Z]+://[^/?#]+([^#]*)', 1) AS tail, lower(regexp_extract(url, '^([a-zA-Z]+://)', 1)) AS scheme))))""")
over("f46_fetch_key", link_rows, LINKS, _on("url", urls.fetch_key), "regexp_replace(regexp_replace(split_part(url, '#', 1), '(?i)^https?://(www\\.)?', ''), '/$', '')")
over("c12_suspect_provenance", link_rows, LINKS, lambda: urls.suspect_provenance(F.col("url"), F.lit("https://www.own.co.uk")), f"coalesce(CASE WHEN host IS NULL THEN false WHEN {DENIED} OR {any_of(urls.AGGREGATORS, UNDER)} THEN true WHEN {any_of(urls.MENU_HOSTS, UNDER)} THEN false ELSE {REGISTRABLE} <> 'own.co.uk' END, false)")
over("c19_first_party", link_rows, LINKS, lambda: urls.first_party(F.col("url"), F.lit("https://own.com")), f"coalesce(NOT {DENIED} AND (host = 'own.com' OR ends_with(host, '.own.com')), false)")
over("c29_source_class", link_rows, LINKS, lambda: review.source_class(F.col("url"), F.lit("https://www.own.com")), f"""CASE WHEN {DENIED} THEN 'denylisted_aggregator' WHEN host IS NULL THEN 'third_party' WHEN {any_of(('instagram.com', 'facebook.com', 'x.com', 'twitter.com', 'tiktok.com'), UNDER)} THEN 'social'
    WHEN host = 'own.com' THEN 'own' WHEN {last_two('host')} = 'own.com' THEN 'own_subdomain' ELSE 'third_party' END""")
BARE = "regexp_replace(url, '/+$', '')"
over("c21_render_escalation", link_rows, LINKS, lambda: review.render_escalation(F.array("url"), F.when(F.col("k") % 2 == 0, F.array(F.concat("url", F.lit("/")))).otherwise(F.array(F.lit("https://a.com"))), F.array((F.col("k") % 3).cast("int"))),
     f"CASE WHEN {SCORE} >= 60 AND NOT {DENIED} THEN CASE WHEN k % 2 <> 0 AND {BARE} <> 'https://a.com' THEN 'unread_hh_page' WHEN k % 3 = 0 THEN 'hh_page_no_offerings' END END")

# ---- texts

WALL = any_of(pages.BOT_WALL, "contains(lower(text), v)")
over("f19_bot_wall", text_rows, TEXTS, _on("text", pages.bot_wall), WALL)
over("f19_parked_html", text_rows, TEXTS, _on("text", signals.parked_html), any_of(signals.PARKED_MARKERS, "contains(lower(text), v)"))
over("f19_squatter", text_rows, TEXTS, _on("text", signals.squatter), any_of(signals.SQUATTER, "contains(lower(text), v)"))
over("f31_public_note", text_rows, TEXTS, _on("text", review.public_note), f"CASE WHEN {matches('text', review.RESTRICTION)} THEN trim(text) END")
DAYS = "list_filter([" + ", ".join(f"CASE WHEN {matches('text', f'(?i){chr(92)}b{w}{chr(92)}b')} THEN {i} END" for i, w in enumerate(signals.DAY_WORDS, 1)) + "], lambda x: x IS NOT NULL)"
over("f36_named_days", text_rows, TEXTS, lambda: F.concat_ws("|", F.array_join(signals.named_days(F.col("text")), ","), signals.food_as_drink(F.col("text")).cast("string")), f"concat_ws('|', array_to_string({DAYS}, ','), {matches('text', signals.FOOD)} AND NOT {matches('text', signals.DRINK)})")
SAKE = swapped("text", r"(?i)\bsake\s+of\b", " ")
over("f37_alcohol_content", text_rows, TEXTS, _on("text", signals.alcohol_content), matches("text", "(?i)" + signals.ALCOHOL.replace(r"|\bsake\b(?!\s+of\b)", "")) + " OR " + matches(SAKE, r"(?i)\bsake\b"))
over("f43_leading_array", text_rows, TEXTS, _on("text", pages.leading_array), """(SELECT list_filter(list_transform(range(1, len(parts)), lambda j: array_to_string(parts[1:j], ']') || ']'), lambda x: json_valid(x))[1]
    FROM (SELECT CASE WHEN contains(text, '[') THEN string_split(substr(text, strpos(text, '[')), ']') ELSE [] END AS parts))""")
over("c30_consent_wall", text_rows, TEXTS, _on("text", review.consent_wall), any_of(review.CONSENT, "contains(lower(text), v)"))
BARE_URLS = swapped("text", signals.URLS, " ")
TELLING = f"({matches(BARE_URLS, signals.OFFER_HOUR)} OR {matches(BARE_URLS, signals.DEAL)} OR {matches(BARE_URLS, signals.PRICE)} OR {matches(BARE_URLS, signals.DEAL_WORDS)})"
over("f15_offer_signal", text_rows, TEXTS, _on("text", signals.offer_signal), f"({matches(BARE_URLS, signals.OFFER_HOUR)} OR {matches(BARE_URLS, signals.DEAL)})")
over("f15_price_signal", text_rows, TEXTS, _on("text", signals.price_signal), f"({matches(BARE_URLS, signals.PRICE)} OR {matches(BARE_URLS, signals.DEAL_WORDS)})")
over("f15_price_count", text_rows, TEXTS, _on("text", signals.price_count), f"CAST(len(regexp_extract_all({BARE_URLS}, {_q(signals.PRICES)})) AS INTEGER)")
over("f15_offer_match", text_rows, TEXTS, _on("text", signals.offer_match), f"coalesce(nullif(regexp_extract({BARE_URLS}, {_q(signals.OFFER_HOUR)}), ''), nullif(regexp_extract({BARE_URLS}, {_q(signals.DEAL)}), ''))")
HEAD = "left(text, 3000)"
MACHINE = f"(len({HEAD}) >= 200 AND (len({HEAD}) - len(replace({HEAD}, ' ', '')) < 0.08 * len({HEAD}) OR len({HEAD}) - len({swapped(HEAD, '[{}=;|/_' + chr(92) * 2 + chr(92) + '[' + chr(92) + ']]')}) > 0.08 * len({HEAD})))"
LITTLE = f"(len(text) < {review.SHELL} AND NOT {TELLING})"
over("c30_wants_browser", text_rows, TEXTS, lambda: review.wants_browser(F.lit(True), F.lit(200), F.lit(False), F.lit(False), F.col("text"), F.lit(0)), f"CASE WHEN coalesce(text, '') = '' THEN true ELSE {MACHINE} OR {LITTLE} END")
over("c30_wants_anti_bot", text_rows, TEXTS, lambda: review.wants_anti_bot(F.lit(True), F.lit(200), F.lit(False), F.lit(False), F.col("text"), F.lit(0)), f"CASE WHEN {WALL} THEN true WHEN coalesce(text, '') = '' THEN true ELSE {LITTLE} END")

# ---- pages

ANCHORS = f"list_zip(regexp_extract_all(html, {_q(pages.ANCHOR)}, 1), list_transform(regexp_extract_all(html, {_q(pages.ANCHOR)}, 2), lambda t: trim({swapped('t', '<[^>]+>', ' ')})))"


def full(link: str) -> str:
    return f"CASE WHEN regexp_matches({link}, '^[a-zA-Z][a-zA-Z0-9+.-]*:') THEN {link} WHEN starts_with({link}, '//') THEN regexp_extract(url, '^(https?:)', 1) || {link} WHEN starts_with({link}, '/') THEN origin || {link} ELSE origin || CASE WHEN folder = '' THEN '/' ELSE folder END || {link} END"


def links_of(test: str, most: int) -> str:
    return f"(SELECT array_to_string({once('l')}[1:{most}], ' ') FROM (SELECT list_filter(list_transform(list_filter({ANCHORS}, lambda a: {test}), lambda a: {full('a[1]')}), lambda x: x IS NOT NULL) AS l))"


over("f20_signal_links", page_rows, HTML, _joined(lambda: pages.signal_links(F.col("html"), F.col("url"))), links_of(f"regexp_matches(a[1], {_q(pages.LINK_HREF)}) OR regexp_matches(a[2], {_q(pages.LINK_WORDS)})", 8))
over("f20_offer_links", page_rows, HTML, _joined(lambda: pages.offer_links(F.col("html"), F.col("url"))), links_of("regexp_matches(a[2], '(?i)happy[- ]?hour')", 4))
over("f20_page_routes", page_rows, HTML, _joined(lambda: pages.page_routes(F.col("html"), F.col("url"))), f"""(SELECT array_to_string({once('l')}, ' ') FROM (SELECT list_transform(list_filter(list_transform(regexp_extract_all(html, '"pageUriSEO":"([^"#?]+)"', 1), lambda r: ltrim(r, '/')), lambda r: r NOT IN ('', 'home')), lambda r: origin || '/' || r) AS l))""")
FRAMES = f"""list_transform(regexp_extract_all(html, '(?i)<iframe\\b[^>]*?\\b(?:src|data-src)\\s*=\\s*["'']([^"'']+)["''][^>]*>', 1), lambda u: {full("replace(u, '&amp;', '&')")})"""
over("f20_menu_embeds", page_rows, HTML, _joined(lambda: pages.menu_embeds(F.col("html"), F.col("url"))), f"""(SELECT array_to_string(CASE WHEN len(list_filter(l, lambda u: NOT regexp_matches(u, '_modal/?$'))) > 0 THEN list_filter(l, lambda u: NOT regexp_matches(u, '_modal/?$')) ELSE l END, ' ')
    FROM (SELECT {once('f')} AS l FROM (SELECT list_filter({FRAMES}, lambda u: regexp_matches(u, '^https?://([^/]*[.])?({'|'.join(pages.EMBEDS)})(/|$)')) AS f)))""")
over("f49_popmenu_routes", page_rows, HTML, _joined(lambda: review.popmenu_routes(F.col("html"), F.col("url"))), f"""(SELECT array_to_string({once('l')}, ' ') FROM (SELECT list_filter(list_transform(regexp_extract_all(html, '(?i)((?:https?://[^\\s"''()<>]+)?/menus/web-[a-z0-9-]*happy[a-z0-9-]*\\?[^\\s"''()<>]+)', 1), lambda r: {full('r')}),
    lambda u: lower(regexp_extract(u, '^https?://([^/?#:]+)', 1)) = lower(regexp_extract(url, '^https?://([^/?#:]+)', 1))) AS l))""")


def stripped() -> str:
    t = swapped("html", "(?s)<!--.*?-->", " ")
    for tag in ("head", "script", "style", "svg", "noscript", "template", "iframe"):
        t = swapped(t, rf"(?is)<{tag}\b[^>]*>.*?</{tag}>", " ")
    t = swapped(t, r"""(?i)<h[1-6]\b(?:[^>"']|"[^"]*"|'[^']*')*>""", "\n## ")
    t = swapped(t, r"(?i)</h[1-6]>|<br\s*/?>|</(p|li|tr|div|section|article|header|footer|ul|ol|table)\s*>", "\n")
    t = swapped(t, "<[^>]+>", " ")
    for entity, char in pages.ENTITIES:
        t = swapped(t, f"(?i){entity}", char)
    return swapped(swapped(swapped(swapped(t, r"[ \t\f\v\r]+", " "), " *\n *", "\n"), "\n{3,}", "\n\n"), r"^\s+|\s+$")


over("f23_stripped", page_rows, HTML, _on("html", pages.stripped), stripped())
STRINGS = f"""list_filter(list_transform(flatten(list_transform(list_filter(list_zip(regexp_extract_all(html, '(?is)<script\\b([^>]*)>(.*?)</script>', 1), regexp_extract_all(html, '(?is)<script\\b([^>]*)>(.*?)</script>', 2)), lambda s: NOT regexp_matches(s[1], '(?i)\\bsrc *=')),
    lambda s: regexp_extract_all(s[2], '"((?:\\\\.|[^"\\\\]){{3,500}})"', 1))), lambda x: trim({swapped(swapped('x', '<[^>]+>', ' '), ' +', ' ')})), lambda x: len(x) >= 4 AND NOT regexp_full_match(x, '[A-Za-z0-9_.-]+') AND regexp_matches(x, {_q(signals.MENU)}))"""
over("f24_script_text", page_rows, HTML, _on("html", pages.script_text), f"(SELECT array_to_string({once('l')}, ' · ') FROM (SELECT {STRINGS} AS l))")
over("f25_script_menu", page_rows, HTML, _joined(lambda: F.transform(pages.script_menu(F.col("html")), lambda x: F.concat_ws("|", x["title"], x["name"], x["price"])), ";"), "CASE WHEN k % 11 = 9 THEN 'Bar|Ale|$5;Bar|Pie' ELSE '' END")
over("f26_linked_menu", page_rows, HTML, _joined(lambda: F.transform(pages.linked_menu(F.col("html")), lambda x: F.concat_ws("|", x["section"], x["offer_hour"].cast("string"), x["name"], x["cents"].cast("string"))), ";"),
     """coalesce((SELECT string_agg((s->>'$.name') || '|' || regexp_matches((j->>'$.name') || ' ' || (s->>'$.name'), '(?i)happy[-_ ]?hour') || '|' || trim(m->>'$.name') || '|' || CAST(round(100 * CAST(replace(m->>'$.offers.price', '$', '') AS DOUBLE)) AS INTEGER), ';')
     FROM (SELECT unnest(regexp_extract_all(html, '(?is)<script[^>]*ld.json[^>]*>(.*?)</script>', 1))::JSON AS j) a, unnest(CAST(j->'$.hasMenuSection' AS JSON[])) b(s), unnest(CAST(s->'$.hasMenuItem' AS JSON[])) c(m) WHERE trim(m->>'$.name') <> ''), '')""")  # fmt: skip

# ---- other inputs

IMAGES = f"images AS (SELECT p_partkey AS k, {_pick(MAGIC, 'p_partkey')} || upper(md5(p_name)) AS head FROM part)"
over("f29_image_type", lambda s, d: table(s, d, "part").withColumn("k", F.col("p_partkey")).select("k", F.concat(_picked(MAGIC), F.upper(F.md5(F.col("p_name").cast("binary")))).alias("head")), IMAGES, lambda: pages.image_type(F.unhex("head")),
     "CASE left(head, 6) WHEN 'FFD8FF' THEN 'image/jpeg' WHEN '89504E' THEN CASE WHEN substr(head, 7, 2) = '47' THEN 'image/png' END WHEN '474946' THEN CASE WHEN substr(head, 7, 2) = '38' THEN 'image/gif' END WHEN '524946' THEN CASE WHEN substr(head, 7, 2) = '46' AND substr(head, 17, 8) = '57454250' THEN 'image/webp' END END")
FILES = f"files AS (SELECT c_custkey AS k, {' || chr(10) || '.join(_pick(ROBOTS, f'(c_custkey // {7**i})') for i in range(4))} AS robots, CASE WHEN c_custkey % 2 = 0 THEN '/private/x' ELSE '/menu' END AS path FROM customer)"


def robot_rows(s, d):
    c = table(s, d, "customer").withColumn("k", F.col("c_custkey"))
    for i in range(4):
        c = c.withColumn(f"k{i}", F.floor(F.col("k") / 7**i))
    return c.select("k", F.concat_ws("\n", *[_picked(ROBOTS, f"k{i}") for i in range(4)]).alias("robots"), F.when(F.col("k") % 2 == 0, "/private/x").otherwise("/menu").alias("path"))


over("f28_robots_block", robot_rows, FILES, lambda: pages.robots_block(F.col("robots"), "OurBot", F.col("path")),
     """(SELECT bool_or(coalesce(applies, false) AND starts_with(line, 'disallow:') AND prefix <> '' AND starts_with(path, prefix)) FROM (SELECT line, trim(substr(line, 10)) AS prefix, last_value(agent IGNORE NULLS) OVER (ORDER BY i) AS applies
     FROM (SELECT i, line, CASE WHEN starts_with(line, 'user-agent:') THEN trim(substr(line, 12)) = '*' OR trim(substr(line, 12)) <> '' AND contains('ourbot', trim(substr(line, 12))) END AS agent
     FROM (SELECT i, lower(trim(split_part(string_split(robots, chr(10))[i], '#', 1))) AS line FROM range(1, 5) r(i)))))""")  # fmt: skip
CODES = [*names.STATES, " pr ", "zz", "wa", "Ca "]
over("f50_state_names", lambda s, d: table(s, d, "customer").withColumn("k", F.col("c_custkey")).select("k", _picked(CODES).alias("code")), f"codes AS (SELECT c_custkey AS k, {_pick(CODES, 'c_custkey')} AS code FROM customer)", _on("code", names.state_name),
     "CASE upper(trim(code)) " + " ".join(f"WHEN '{a}' THEN {_q(b)}" for a, b in names.STATES.items()) + " ELSE trim(code) END")
CLOCKS = "clocks AS (SELECT c_custkey AS k, replace(replace(" + _pick(TIMES, "c_custkey") + ", '{h}', CAST(c_custkey // 11 % 27 AS VARCHAR)), '{m}', lpad(CAST(c_custkey % 61 AS VARCHAR), 2, '0')) AS raw FROM customer)"
H, M, AP = (f"regexp_extract(raw, '^([0-9]{{1,2}})(?::?([0-9]{{2}}))?(?::[0-9]{{2}})?[ ]*([ap])?[.]?(?:m[.]?)?$', {i})" for i in (1, 2, 3))
over("t10_normalised_times", lambda s, d: table(s, d, "customer").withColumn("k", F.col("c_custkey")).select("k", F.replace(F.replace(_picked(TIMES), F.lit("{h}"), F.floor(F.col("k") / 11 % 27).cast("string")), F.lit("{m}"), F.lpad((F.col("k") % 61).cast("string"), 2, "0")).alias("raw")), CLOCKS, _on("raw", weekly.normalise_time),
     f"""(SELECT CASE WHEN raw = 'noon' THEN 720 WHEN raw = 'midnight' THEN 0 WHEN m < 60 AND CASE WHEN ap = '' THEN h < 24 ELSE h <= 12 END THEN 60 * CASE WHEN ap = 'p' AND h < 12 THEN h + 12 WHEN ap = 'a' AND h = 12 THEN 0 ELSE h END + m END
     FROM (SELECT TRY_CAST({H} AS INTEGER) AS h, coalesce(TRY_CAST({M} AS INTEGER), 0) AS m, {AP} AS ap))""")  # fmt: skip
over("x23_distances", lambda s, d: table(s, d, "customer").select(F.col("c_custkey").alias("k"), (F.abs("c_acctbal") / 400).alias("miles")), "far AS (SELECT c_custkey AS k, abs(c_acctbal) / 400 AS miles FROM customer)", _on("miles", geo.format_distance),
     "CASE WHEN miles < 0.1 THEN '< 0.1 mi' WHEN miles < 10 THEN printf('%.1f mi', miles) ELSE printf('%.0f mi', miles) END")
over("c21_escalation_route", lambda s, d: table(s, d, "events").select(F.col("event_id").alias("k"), "user_id", "event_type"), "found AS (SELECT event_id AS k, user_id, event_type FROM events)",
     lambda: review.escalation_route((F.col("user_id") % 3).cast("int"), F.col("event_type") == "view", F.array(F.struct((F.col("event_type") == "error").alias("suspect"), (F.col("k") % 2).cast("int").alias("n_offers")))),
     "CASE WHEN user_id % 3 = 0 THEN 'skip' WHEN event_type <> 'error' THEN CASE WHEN k % 2 = 1 THEN 'free' ELSE 'paid' END ELSE 'relevance-check' END")
KINDS = ["suburb", "city_district", "borough", "neighbourhood", "quarter", "hamlet", ""]
over("g12_recognisability", lambda s, d: table(s, d, "part").withColumn("k", F.col("p_partkey")).select("k", _picked(KINDS).alias("place"), F.when(F.col("p_size") > 40, F.concat(F.lit("Q"), F.col("p_size").cast("string"))).alias("wikidata")),
     f"kinds AS (SELECT p_partkey AS k, {_pick(KINDS, 'p_partkey')} AS place, p_size FROM part)", lambda: F.concat_ws("|", geo.recognisability(F.col("place"), F.col("wikidata"), F.lit("")).cast("string"), geo.place_tier(F.col("place"))),
     "CASE WHEN p_size > 40 THEN '2' WHEN place IN ('suburb', 'neighbourhood', 'quarter') THEN '1' ELSE '0' END || '|' || CASE WHEN place IN ('suburb', 'city_district', 'borough') THEN 'coarse' ELSE 'fine' END")
