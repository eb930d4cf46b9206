import itertools

import pytest

from almanac.operators import told

DAYS = ["Mon", "Tuesday", "Weds", "Thurs", "fri", "SATURDAY", "Sun"]


def days(text):
    return [d.days for d in told.days_in(told.tokens(text))]


def times(text, about=True):
    return [m for x in told.times_in(told.tokens(text)) if (m := told.meaning(x, about))]


@pytest.mark.parametrize("joiner", ["-", " – ", " to ", " through ", "thru", " until "])
def test_every_range_of_days(joiner):
    for a, b in itertools.product(range(7), repeat=2):
        want, d = [], a
        while True:
            want.append(d + 1)
            if d == b:
                break
            d = (d + 1) % 7
        joined = joiner if joiner != "thru" else " thru "
        assert days(f"x {DAYS[a]}{joined}{DAYS[b]} y") == [sorted(want)]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Mon, Wed & Fri", [[1, 3, 5]]),
        ("Sun/Sat and Sat", [[6, 7]]),
        ("Mon-Wed, Fri", [[1, 2, 3]]),  # the range is the expression's meaning
        ("Mon at the bar, Fri", [[1], [5]]),
        ("weekdays, not weekends or every day", [[1, 2, 3, 4, 5], [6, 7], [1, 2, 3, 4, 5, 6, 7]]),
        ("a sunny monitor in fried satin", []),
        ("Mon til Fri", [[1], [5]]),
        ("", []),
    ],
)
def test_days(text, want):
    assert days(text) == want


@pytest.mark.parametrize(
    ("text", "about", "want"),
    [
        ("4-6pm", False, [(960, 1080, False)]),
        ("11am to 2pm", False, [(660, 840, False)]),
        ("10 p.m. – 1 a.m.", False, [(1320, 60, False)]),
        ("4:30 - 6", True, [(990, 1080, True)]),
        ("4:30 - 6", False, [(270, 360, True)]),
        ("16:00 to 18", True, [(960, 1080, True)]),
        ("open until 6", True, [(None, 1080, True)]),
        ("opening to 6am", True, [(None, 360, False)]),
        ("9pm til close", False, [(1260, None, False)]),
        ("21 - late", True, [(1260, None, False)]),
        ("3 to midnight", True, [(900, None, True)]),
        ("12am-12pm", False, [(0, 720, False)]),
        ("38-80, 14pm to 5pm, 5:75-6", True, []),
        ("$5-7 or 3.5-6", True, []),
        ("5-7-9 and 8 to 9", True, [(1020, 1140, True), (1200, 1260, True)]),
        ("5 6-8", True, [(1080, 1200, True)]),
        ("5 tomato 7", True, []),
        ("", True, []),
    ],
)
def test_times(text, about, want):
    assert times(text, about) == want


def test_frames(spark):
    rows = [(1, "Mon 4-6pm", 1, 2), (2, None, 1, 2), (3, "", 1, 2), (4, "word " * 50_000 + "Sat-Mon 9pm til close", 1, 2)]
    got = {r.id: (r.days, [tuple(t) for t in r.times]) for r in told.read(spark.createDataFrame(rows, "id int, text string, days int, told int")).collect()}
    assert got == {1: ([[1]], [(960, 1080, False)]), 2: ([], []), 3: ([], []), 4: ([[1, 6, 7]], [(1260, None, False)])}
