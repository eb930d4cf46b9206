"""Tokens are read around the words that an expression begins with; what they tell is what all tokens tell."""

import random

from almanac.operators import told

PARTS = ["Mon", "tues", "WED", "Sun", "weekends", "weekdays", "daily", "every", "day", "all", "week", "7", "days", "12", ":30", "pm", "a.m.", "p", " - ", "–", "to", "through", "til", "until", "open", "close", "end", ",", "&", "and", "x", "tomato", "android", "$5", ".5", "#", "_", "\n", " ", " ", " ", "  ", "٣", "é"]


def test_as_by_all_tokens():
    every = lambda t: [told.Token(m.lastgroup, m[0], m.start(), m.end()) for m in told.TOKENS.finditer(t)]
    rng = random.Random(7)
    for _ in range(20_000):
        text = "".join(rng.choices(PARTS, k=rng.randint(1, 14)))
        a, b = told.tokens(text), every(text)
        assert told.days_in(a) == told.days_in(b) and list(told.times_in(a)) == list(told.times_in(b)), text


def test_prose_makes_no_tokens():
    assert told.tokens("words of no use " * 1000 + "Mon") == [told.Token("day", "Mon", 16_000, 16_003)]


def test_letters_that_only_case_folding_knows():
    assert told.days_in(told.tokens("ſun")) == [told.Days(0, 3, [7])]
