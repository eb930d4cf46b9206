"""Weekly windows and priced offers told in free text, by an Arrow function over batches of texts.

Sentences are read one by one. A range of times is bound to the nearest days named before it, else after it; a range in a
sentence about offers without any day is taken for Monday to Friday. Bare hours in such a sentence are in the afternoon."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from almanac.functions import signals
from almanac.operators import told
from almanac.operators.batches import fresh, widen

QUANTITY = re.compile(r"\s*(?:courses?|people|persons?|guests?|items?|oz|ounces?|wines?|beers?|tastings?|seats?|weeks?|months?|years?|miles?|%|percent)\b", re.I)
CONTEXT = re.compile(r"\bspecials?\b|drink\s*deals?|\bdaily\b|industry\s*night|happy\s*hr\b", re.I)
HOUR = re.compile(signals.OFFER_HOUR)
DOTTED = re.compile(r"\.\s?m", re.I)
DRINK = re.compile(r"beer|draft|draught|wine|cocktail|martini|margarita|spirit|well|pint|sangria|mimosa|shot|liquor|whiskey|tequila|vodka|drink", re.I)
FOOD = re.compile(r"appetizer|app|wing|taco|burger|slider|nacho|pizza|fries|oyster|sandwich|plate|bite|food", re.I)
CATEGORIES = ((r"beer|draft|draught|pint", "beer"), (r"wine|sangria", "wine"), (r"cocktail|martini|margarita|mimosa", "cocktail"), (r"spirit|well|liquor|whiskey|tequila|vodka|shot", "spirit"))
PRICE = r"\$(\d+(?:\.\d{2})?)(?:\s*[-–—]\s*\$?(\d+(?:\.\d{2})?))?"
LABEL = r"((?:[a-z][a-z'/-]*)(?:\s+[a-z][a-z'/-]*){0,3})?"
OFFER = re.compile(rf"\b([a-z][a-z'/-]*)\s+from\s+{PRICE}|{PRICE}\s*(off)?\s*{LABEL}|(half[-\s]?price|1/2\s*(?:off|price))\s*{LABEL}", re.I)
STOP = re.compile(r"(?:\s+(?:from|with|and|or|to|at|in|on|per|until|till|the|a|an|of|for))+$", re.I)
MOST = 8

KIND = (
    "array<struct<days: array<int>, start: int, end: int, notes: string, clean: boolean, plausible: boolean, evidence: string,"
    " offers: array<struct<name: string, kind: string, category: string, cents: int, discount: int>>>>"
)


def offers_of(text: str) -> list[dict]:
    out = []
    for m in OFFER.finditer(text):
        if m[1]:
            if not (DRINK.search(m[1]) or FOOD.search(m[1])):
                continue
            label, name, cents, discount = m[1], " ".join(m[0].split()), round(float(m[2]) * 100), None
        elif m[4]:
            label, off = STOP.sub("", (m[7] or "").strip()), bool(m[6])
            if not label and not off:
                continue
            price = f"${m[4]}" + (f"-{m[5]}" if m[5] else "")
            name = f"{price}{' off' if off else ''} {label}".strip()
            cents, discount = (None, round(float(m[4]) * 100)) if off else (round(float(m[4]) * 100), None)
        else:
            label, name, cents, discount = STOP.sub("", (m[9] or "").strip()), " ".join(m[0].split()), None, None
        told = label if label and (DRINK.search(label) or FOOD.search(label)) else text
        kind = "drink" if DRINK.search(told) else "food" if FOOD.search(told) else "other"
        category = next((c for p, c in CATEGORIES if re.search(p, told, re.I)), "appetizer" if kind == "food" else "other")
        out.append({"name": name, "kind": kind, "category": category, "cents": cents, "discount": discount})
        if len(out) == MOST:
            break
    return out


def windows_of(text: str | None) -> list[dict]:
    out, seen = [], set()
    text = text or ""
    if DOTTED.search(text):
        text = re.sub(r"\b([ap])\.\s?m\.?", r"\1m", text, flags=re.I)
    if "  " in text or "\t" in text or "\xa0" in text:
        text = re.sub(r"[ \t\xa0]+", " ", text)
    text = re.sub(r"\$\s+(?=\d)", "$", text)
    for part in re.split(r"(?:\.(?=\s)|[;·\n\r])+", text):
        if not told.may_tell_times(part):
            continue
        part = part.strip()
        tokens = told.tokens(part)
        times_ = list(told.times_in(tokens))
        if not times_:
            continue
        about = bool(HOUR.search(part) or CONTEXT.search(part))
        named = told.days_in(tokens)
        for m in times_:
            if not re.search(r"[ap]\.?m", part[m.start : m.end], re.I) and QUANTITY.match(part, m.end):
                continue
            if (times := told.meaning(m, about)) is None:
                continue
            start, end, silent = times
            before = [d.days for d in named if d.start <= m.start]
            days = before[-1] if before else named[0].days if named else None
            assumed = days is None and about
            days = [1, 2, 3, 4, 5] if assumed else days
            clean = about and days is not None and not (silent and start is not None and end is not None and start > end)
            key = (tuple(days or ()), start, end, clean)
            if key in seen:
                continue
            seen.add(key)
            length = None if start is None or end is None else (end - start) % 1440
            near = bool(HOUR.search(part[max(0, m.start - 140) : m.end + 40]))
            out.append({"days": days or [], "start": start, "end": end, "notes": "days assumed Mon–Fri (none stated)" if assumed else None, "clean": clean, "plausible": clean and near and (length is None or 0 < length <= 360), "evidence": part, "offers": offers_of(part) if clean else []})
    return out


def parse(pages: DataFrame, text: str = "text") -> DataFrame:
    """``pages`` with ``windows``, the windows that each ``text`` tells. Null and empty texts tell none."""

    name = fresh(pages.columns, "windows")
    done = widen(pages, name, KIND, lambda: lambda texts: list(map(windows_of, texts)), told.PIECE, text)
    return done if name == "windows" else done.withColumn("windows", F.col(name)).drop(name)
