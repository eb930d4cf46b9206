"""Days and times told in text: one pattern cuts a text into tokens, and tables of states read expressions from them.

Tokens are days, groups of days, hours with minutes and half of the day, joiners and list signs, openings and closings; white
space is no token, any other word or sign is one that no table knows, so an expression ends there."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from almanac.operators.batches import fresh, widen

NAMES = ("mon", "tue", "wed", "thu", "fri", "sat", "sun")
TOKENS = re.compile(
    r"""(?P<all>\b(?:daily|every\s*day|all\s*week|7\s*days)\b)|(?P<end>\bweekends?\b)|(?P<work>\bweekdays?\b)
    |(?P<day>\b(?:mon(?:day)?|tues?(?:day)?|wed(?:s|nesday)?|thur?s?(?:day)?|fri(?:day)?|sat(?:urday)?|sun(?:day)?)\b)
    |(?P<hour>(?<![$\d.])\d{1,2}(?!\d)(?::\d{2})?\s*(?:[ap]\.?m\.?)?)
    |(?P<open>\bopen(?:ing)?\b)|(?P<to>[-–—]|through|thru|until|till?|to)|(?P<close>clos(?:e|ing)|midnight|late|end)|(?P<list>[,&+/]|and)
    |(?P<other>[^\W\d_]+|\d+|\S)""",
    re.I | re.X,
)
KIND = "days array<array<int>>, times array<struct<start: int, end: int, silent: boolean>>"
#: Bytes of the texts that are told at once.
PIECE = 4 << 20
HOUR = re.compile(r"(\d{1,2})(?::(\d{2}))?\s*([ap])?", re.I)
GROUPS = {"all": [1, 2, 3, 4, 5, 6, 7], "end": [6, 7], "work": [1, 2, 3, 4, 5]}
#: (state, token) -> state of the expressions; "til" joins times but not days. A state with a capital ends one.
DAYS = {("", "day"): "day", ("day", "to"): "join", ("day", "list"): "join", ("join", "day"): "day"}
TIMES = {("", "hour"): "hour", ("hour", "to"): "from", ("from", "hour"): "Range", ("from", "close"): "Open end", ("", "open"): "open", ("open", "to"): "until", ("until", "hour"): "Open start"}


class Token(NamedTuple):
    kind: str
    text: str
    start: int
    end: int


class Days(NamedTuple):
    """ISO days that an expression at ``start`` names."""

    start: int
    end: int
    days: list[int]


class Times(NamedTuple):
    """An expression of times: its tokens of hours (None where it says open or close)."""

    start: int
    end: int
    first: Token | None
    last: Token | None


#: What each token that an expression can begin with holds, in small letters; also a digit.
STARTS = (*NAMES, "daily", "every", "all", "week", "open")
DIGIT = re.compile(r"\d")


def _small(text: str) -> str:
    """``text`` in small letters, as long as it was; letters that a pattern takes for others whatever the case are those."""
    if text.isascii():
        return text.lower()
    return text.replace("\u0130", "i").lower().replace("\u0131", "i").replace("\u017f", "s")


def may_tell_times(text: str) -> bool:
    """Whether ``text`` has what a range of times can begin with."""
    return "open" in _small(text) or bool(DIGIT.search(text))


def tokens(text: str) -> list[Token]:
    """The tokens of ``text`` that an expression can have: words that no table knows end an expression, so only the first of such a
    run is told, and the text is read on at the next word that holds the start of one. Tokens with white space inside begin with
    such a start, so a word after white space begins a token unless it was read before."""
    small, out, at = _small(text), [], 0
    starts = [m.start() for m in DIGIT.finditer(text)]
    for word in STARTS:
        found = small.find(word)
        while found >= 0:
            starts.append(found)
            found = small.find(word, found + 1)
    for start in sorted(starts):
        if start < at:
            continue
        while start > at and not text[start - 1].isspace():
            start -= 1
        if start > at and out and out[-1].kind != "other":
            out.append(Token("other", "", at, start))
        for m in TOKENS.finditer(text, start):
            out.append(Token(m.lastgroup, m[0], m.start(), m.end()))
            at = m.end()
            if m.lastgroup == "other" and (at == len(text) or text[at].isspace()):
                break
        else:
            break
    return out


def _named(run: list[Token]) -> list[int]:
    """A range of the first two days with a joiner between them, over the week's end too; else all that are listed."""
    number = lambda t: NAMES.index(_small(t.text)[:3]) + 1
    for a, by, b in zip(run, run[1:], run[2:]):
        if by.kind == "to" and a.kind == b.kind == "day":
            one, two = number(a), number(b)
            return sorted((one - 1 + k) % 7 + 1 for k in range((two - one) % 7 + 1))
    return sorted({number(t) for t in run if t.kind == "day"})


def days_in(told: list[Token]) -> list[Days]:
    """Every expression of days in order: a group, or days that are joined or listed."""
    out, i = [], 0
    while i < len(told):
        if told[i].kind in GROUPS:
            out.append(Days(told[i].start, told[i].end, GROUPS[told[i].kind]))
        elif told[i].kind == "day":
            state, j, last = "", i, i
            while j < len(told) and (state := DAYS.get((state, told[j].kind if told[j].text.lower() != "til" else ""), "")):
                last = j if state == "day" else last
                j += 1
            out.append(Days(told[i].start, told[last].end, _named(told[i : last + 1])))
            i = last
        i += 1
    return out


def times_in(told: list[Token]) -> Iterator[Times]:
    """Every range of times in order; they don't overlap."""
    state, run = "", []
    for t in told:
        after = TIMES.get((state, t.kind))
        if after is None:
            state, run = TIMES.get(("", t.kind), ""), []
        else:
            state = after
        run.append(t)
        if state[:1].isupper():
            first, last = (None, run[-1]) if state == "Open start" else (run[0], None if state == "Open end" else run[-1])
            yield Times(run[0].start, run[-1].end, first, last)
            state, run = "", []
        elif not state:
            run = []


def _clock(token: Token, half: str | None) -> int | None:
    """Minutes of the day; None if there is no such time: a half of the day has hours from 1 to 12."""
    h, m, _ = HOUR.match(token.text).groups()
    hour, minute = int(h), int(m or 0)
    if minute > 59 or half and not 1 <= hour <= 12:
        return None
    hour = hour % 12 + 12 * (half == "p") if half else hour
    return hour * 60 + minute if hour < 24 else None


def meaning(times: Times, about: bool) -> tuple[int | None, int | None, bool] | None:
    """(start, end, whether no half of the day was told) in minutes of the day, null for the opening or the close; None if a time is
    none. A half that one side tells is the other's too. Where none is told, hours from 13 on are of 24; others are in the
    afternoon if the text is ``about`` such hours, else as they stand."""
    ends = [t for t in (times.first, times.last) if t]
    halves = [h.lower() if (h := HOUR.match(t.text)[3]) else None for t in ends]
    hours = [int(HOUR.match(t.text)[1]) for t in ends]
    told = next((h for h in halves if h), None)
    late = told is None and max(hours) >= 13
    afternoon = "p" if about and not late and (times.last is not None or 1 <= hours[0] <= 11) else None
    found = [_clock(t, h or told or afternoon) for t, h in zip(ends, halves, strict=True)]
    if None in found:
        return None
    silent = told is None and not (times.last is None and late)
    return (found[0] if times.first else None, found[-1] if times.last else None, silent)


def read(texts: DataFrame, text: str = "text", about: bool = True) -> DataFrame:
    """``texts`` with ``days`` (array of the ISO days of each expression of days) and ``times`` (array of start, end, silent of each range
    of times that is one), in the order of the ``text``. Null and empty texts tell none. Columns days and times are replaced."""

    def tell(said: str) -> dict:
        found = tokens(said)
        read_ = [m for x in times_in(found) if (m := meaning(x, about))]
        return {"days": [d.days for d in days_in(found)], "times": [{"start": a, "end": b, "silent": s} for a, b, s in read_]}

    kept = [c for c in texts.columns if c.lower() not in ("days", "times")]
    name, said = fresh(texts.columns, "told"), text
    if (text, "string") not in texts.dtypes:
        said = fresh([*texts.columns, name], "said")
        texts = texts.withColumn(said, F.col(f"`{text}`").cast("string"))
    done = widen(texts, name, KIND, lambda: lambda column: list(map(tell, column)), PIECE, said)
    return done.select(*[F.col(f"`{c}`") for c in kept], f"{name}.days", f"{name}.times")
