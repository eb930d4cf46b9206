"""Text and structure of fetched pages: native expressions where they can say it, Arrow functions where a page must be walked."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from almanac.functions import signals, urls

#: Fixed values.
BOT_WALL = ("just a moment", "enable javascript and cookies to continue", "checking your browser before", "attention required! | cloudflare", "please verify you are a human", "verifying you are human")
ENTITIES = (
    ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&(nbsp|ensp|emsp|thinsp|hairsp);", " "), ("&(ndash|mdash|minus);", "-"), ("&(lsquo|rsquo|apos);", "'"),
    ("&(ldquo|rdquo);", '"'), ("&middot;", "·"), ("&hellip;", "…"), ("&(copy|reg|trade);", " "), ("&amp;", "&"),
)
EMBEDS = ("singleplatform.com", "toasttab.com", "popmenu.com", "getbento.com")
LINK_HREF = r"(?i)happy[-_ ]?hour|specials?|(beer|drink|cocktail|wine|food)[-_ ]?menu|/menus?\b|happenings?|\b(deals?|offers?)\b"
LINK_WORDS = r"(?i)happy[-\s]?hour|\bspecials?\b|\bmenus?\b|\b(drinks?|cocktails?)\b|\bhappenings?\b|\b(deals?|offers?)\b"
PAGE_NOISE = r"(?i)/(cart|checkout|account|login|sign-?in|register|privacy|terms|gift|careers?|jobs?|contact|reservations?|order-online|form-confirmation|sitemap)\b"
EDITORIAL = r"(?i)/(blog|news|press|article|story|stories|recipes?|guide|cooking|featured)\b|/20\d\d/\d|food-truck"
HINT = r"(?i)about|event|special|menu|drink|cocktail|happy|hour|deal|\bbar\b|vermut|aperitivo|apericena|hora[-_ ]?feliz"
ANCHOR = r"(?is)<a\b[^>]*href\s*=\s*[\"']([^\"']+)[\"'][^>]*>(.*?)</a>"


def stripped(html: Column) -> Column:
    """The text of a page: comments, scripts and the like dropped, headings marked, blocks on lines of their own."""
    t = F.regexp_replace(html, r"(?s)<!--.*?-->", " ")
    t = F.regexp_replace(t, r"(?is)<(script|style|svg|noscript|head|template|iframe)\b[^>]*>.*?</\1>", " ")
    t = F.regexp_replace(t, r"(?i)\bdata:[a-z0-9/;,+=._-]{60,}", " ")
    t = F.regexp_replace(t, r"(?i)<h[1-6]\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>", "\n## ")
    t = F.regexp_replace(t, r"(?i)</h[1-6]>|<br\s*/?>|</(p|li|tr|div|section|article|header|footer|ul|ol|table)\s*>", "\n")
    t = F.regexp_replace(t, r"<[^>]+>", " ")
    for entity, char in ENTITIES:
        t = F.regexp_replace(t, f"(?i){entity}", char)
    t = F.regexp_replace(F.regexp_replace(F.regexp_replace(t, r"[ \t\f\x0B\r]+", " "), " *\n *", "\n"), "\n{3,}", "\n\n")
    return F.regexp_replace(t, r"^\s+|\s+$", "")


def bot_wall(text: Column) -> Column:
    return F.coalesce(F.lower(text).rlike("|".join(re.escape(x) for x in BOT_WALL)), F.lit(False))


def absolute(link: Column, base: Column) -> Column:
    """A link as an address: as it is with a scheme, else on the site of ``base`` or beside it; null without such a base."""
    origin = F.nullif(F.regexp_extract(base, r"^(https?://[^/?#]+)", 1), F.lit(""))
    folder = F.regexp_replace(F.regexp_extract(base, r"^https?://[^/?#]+([^?#]*)", 1), "[^/]*$", "")
    return (
        F.when(link.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), link)
        .when(link.startswith("//"), F.concat(F.regexp_extract(base, r"^(https?:)", 1), link))
        .when(link.startswith("/"), F.concat(origin, link))
        .otherwise(F.concat(origin, F.when(folder == "", "/").otherwise(folder), link))
    )


def anchors(html: Column) -> Column:
    """array<struct<href, text>> of a page's links, in order."""
    clean = lambda x: F.trim(F.regexp_replace(x, "<[^>]+>", " "))
    return F.arrays_zip(F.regexp_extract_all(html, F.lit(ANCHOR), 1).alias("href"), F.transform(F.regexp_extract_all(html, F.lit(ANCHOR), 2), clean).alias("text"))


def signal_links(html: Column, base: Column, most: int = 8) -> Column:
    """The first addresses whose link or text speaks of offers."""
    hit = F.filter(anchors(html), lambda a: a["href"].rlike(LINK_HREF) | a["text"].rlike(LINK_WORDS))
    return F.slice(F.array_distinct(F.array_compact(F.transform(hit, lambda a: absolute(a["href"], base)))), 1, most)


def offer_links(html: Column, base: Column, most: int = 4) -> Column:
    hit = F.filter(anchors(html), lambda a: a["text"].rlike(r"(?i)happy[-\s]?hour"))
    return F.slice(F.array_distinct(F.array_compact(F.transform(hit, lambda a: absolute(a["href"], base)))), 1, most)


def page_routes(html: Column, base: Column) -> Column:
    routes = F.transform(F.regexp_extract_all(html, F.lit(r'"pageUriSEO":"([^"#?]+)"'), 1), lambda s: F.regexp_replace(s, "^/+", ""))
    return F.array_distinct(F.transform(F.filter(routes, lambda s: ~s.isin("", "home")), lambda s: absolute(F.concat(F.lit("/"), s), base)))


def menu_embeds(html: Column, base: Column) -> Column:
    """Frames of menu platforms; those of pop-ups only if there are no others."""
    found = F.regexp_extract_all(html, F.lit(r"(?i)<iframe\b[^>]*?\b(?:src|data-src)\s*=\s*[\"']([^\"']+)[\"'][^>]*>"), 1)
    all_ = F.array_distinct(F.filter(F.transform(found, lambda u: absolute(F.regexp_replace(u, "&amp;", "&"), base)), lambda u: urls.under(urls.hostname(u), EMBEDS)))
    plain = F.filter(all_, lambda u: ~urls.path(u).rlike("(?i)_modal/?$"))
    return F.when(F.size(plain) > 0, plain).otherwise(all_)


def full_image(url: Column, widest: int = 1500) -> Column:
    """An image's address in full, or not wider than needed, by the rules of two site builders."""
    whole = F.regexp_replace(url, r"(?i)^(https?://static\.wixstatic\.com/media/[^/]+\.(?:jpe?g|png|webp|gif|avif))/v1/.*$", "$1")
    width = F.expr("1") * F.nullif(F.regexp_extract(url, r"(?i)[?&]format=(\d+)w(?:&|$)", 1), F.lit("")).cast("int")
    capped = F.when(url.rlike("[?&]format="), F.regexp_replace(url, r"([?&])format=[^&#]*", f"$1format={widest}w")).otherwise(F.concat(url, F.when(url.contains("?"), "&").otherwise("?"), F.lit(f"format={widest}w")))
    return F.when(urls.under(urls.hostname(url), ("images.squarespace-cdn.com",)) & (width.isNull() | (width > widest)), capped).otherwise(whole)


def declared_pages(found: Column, base: Column, most: int = 6) -> Column:
    """The best addresses of a site map: of the same site, no noise, by score, the earlier first."""
    origin = F.regexp_extract(base, r"^(https?://[^/?#]+)", 1)
    own = F.filter(found, lambda u: u.startswith(origin) & ~u.rlike(PAGE_NOISE) & ~u.rlike(EDITORIAL) & ((urls.url_score(u) > 0) | u.rlike(HINT)))
    return best_urls(own, most)


def best_urls(found: Column, most: int = 8) -> Column:
    ranked = F.array_sort(F.transform(F.array_distinct(found), lambda u, i: F.struct((-urls.url_score(u)).alias("r"), i.alias("i"), u.alias("u"))))
    return F.slice(F.transform(ranked, lambda x: x["u"]), 1, most)


def image_type(data: Column) -> Column:
    """The type that the first bytes tell; null for what is no picture of the web."""
    h = F.hex(F.substring(data, 1, 12))
    return F.when(h.like("FFD8FF%"), "image/jpeg").when(h.like("89504E47%"), "image/png").when(h.like("47494638%"), "image/gif").when(h.like("52494646________57454250"), "image/webp")


def robots_block(robots: Column, bot: str, path: Column) -> Column:
    """Whether a group of robots.txt for everyone or for ``bot`` disallows a path by prefix: lines folded in order."""
    lines = F.transform(F.split(robots, r"\r?\n"), lambda x: F.trim(F.substring_index(x, "#", 1)))
    after = lambda line, word: F.trim(F.substr(line, F.lit(len(word) + 1)))

    def step(acc: Column, line: Column) -> Column:
        low = F.lower(line)
        agent = F.lower(after(line, "user-agent:"))
        applies = F.when(low.startswith("user-agent:"), (agent == "*") | (agent != "") & F.contains(F.lit(bot.lower()), agent)).otherwise(acc["applies"])
        prefix = after(line, "disallow:")
        hit = acc["applies"] & low.startswith("disallow:") & (prefix != "") & F.startswith(path, prefix)
        return F.struct(applies.alias("applies"), (acc["hit"] | hit).alias("hit"))

    return F.coalesce(F.aggregate(lines, F.struct(F.lit(False).alias("applies"), F.lit(False).alias("hit")), step)["hit"], F.lit(False))


# ---- pages that must be walked

SCRIPT = re.compile(r"<script\b([^>]*)>(.*?)</script>", re.I | re.S)
STRING = re.compile(r'"((?:\\.|[^"\\]){3,500})"')
TOLD = re.compile(signals.MENU)
MENU = "array<struct<section: string, offer_hour: boolean, name: string, description: string, cents: int>>"


def _strings(html: str, most: int) -> str:
    """Sentences about offers among the strings of inline scripts, each once."""
    out: dict[str, None] = {}
    used = 0
    for attributes, body in SCRIPT.findall(html):
        if re.search(r"\bsrc\s*=", attributes, re.I):
            continue
        for raw in STRING.findall(body):
            try:
                text = json.loads(f'"{raw}"', strict=False)
            except ValueError:
                text = raw
            text = " ".join(re.sub("<[^>]+>", " ", text).split())
            if len(text) >= 4 and text not in out and not re.fullmatch(r"[\w.\-]+", text) and TOLD.search(text):
                out[text] = None
                used += len(text) + 3
                if used >= most:
                    return " · ".join(out)
    return " · ".join(out)


def script_text(column: Column) -> Column:
    def told(values: pd.Series) -> pd.Series:
        return values.map(lambda x: _strings(x or "", 8000))

    return F.pandas_udf(told, "string")(column)


def _cents(value) -> int | None:
    try:
        price = float(value) if isinstance(value, (int, float)) else float(re.sub(r"[^0-9.]", "", str(value)))
    except ValueError:
        return None
    return round(price * 100) if 0 < price < float("inf") else None


def _menu(html: str) -> list[dict]:
    """Items of the menus that a page's linked data holds; a section is of an offer hour if it or one above it says so."""
    out: list[dict] = []

    def walk(node, inherited: bool, depth: int = 0) -> None:
        if depth > 60:
            return
        if isinstance(node, list):
            for x in node:
                walk(x, inherited, depth + 1)
        elif isinstance(node, dict):
            name, about = (node.get(k).strip() if isinstance(node.get(k), str) else None for k in ("name", "description"))
            own = inherited or bool(re.search(signals.OFFER_HOUR, f"{name or ''} {about or ''}"))
            items = node.get("hasMenuItem")
            for item in items if isinstance(items, list) else [items]:
                if isinstance(item, dict) and isinstance(item.get("name"), str) and item["name"].strip():
                    offered = item.get("offers")
                    prices = [_cents(o.get("price")) for o in (offered if isinstance(offered, list) else [offered]) if isinstance(o, dict)]
                    text = item.get("description")
                    out.append({"section": name, "offer_hour": own, "name": item["name"].strip(), "description": text.strip() if isinstance(text, str) else None, "cents": next((p for p in prices if p), None)})
            for x in node.values():
                walk(x, own, depth + 1)

    for attributes, body in SCRIPT.findall(html):
        if "ld+json" in attributes.lower():
            try:
                walk(json.loads(body), False)
            except ValueError:
                continue
    return out


def linked_menu(column: Column) -> Column:
    def told(values: pd.Series) -> pd.Series:
        return values.map(lambda x: _menu(x or ""))

    return F.pandas_udf(told, MENU)(column)


ITEMS = "array<struct<title: string, name: string, price: string>>"
TOKEN = re.compile(r'"title"\s*:\s*"([^"]{1,80})"|"name"\s*:\s*"([^"}]{1,80})"[^}]*?"price"\s*:\s*"([^"}]{0,24})"')


def _items(html: str) -> list[dict]:
    """Items with prices in a menu that scripts hold as escaped JSON, under the title before them."""
    text = html.replace('\\"', '"')
    if not re.search(r'"items"\s*:\s*\[\s*\{\s*"name"', text):
        return []
    out, title = [], None
    plain = lambda s: re.sub(r"\\u([0-9a-fA-F]{4})", lambda m: chr(int(m[1], 16)), s).strip()
    for head, name, price in TOKEN.findall(text):
        if head:
            title = plain(head)
        elif plain(name):
            cost = re.sub(r"\${2,}", "$", plain(price))
            out.append({"title": title, "name": plain(name), "price": cost if re.match(r"\$?\d", cost) else None})
    return out


def script_menu(column: Column) -> Column:
    def told(values: pd.Series) -> pd.Series:
        return values.map(lambda x: _items(x or ""))

    return F.pandas_udf(told, ITEMS)(column)


def _leading_array(text: str) -> str | None:
    """The first balanced [...] of a text, as it is, if it is JSON."""
    start = text.find("[")
    if start < 0:
        return None
    try:
        value, end = json.JSONDecoder().raw_decode(text, start)
    except ValueError:
        return None
    return text[start:end] if isinstance(value, list) else None


def leading_array(column: Column) -> Column:
    def told(values: pd.Series) -> pd.Series:
        return values.map(lambda x: _leading_array(x or ""))

    return F.pandas_udf(told, "string")(column)
