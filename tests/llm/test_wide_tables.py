"""Columns of tables whatever their size, and whatever else a page has."""

import re

from almanac.llm import html_text
from almanac.llm.html_text import render


def rows(n, wide="a longer cell"):
    return f"<tr><td>{wide}<td>x" + "<tr><td>a<td>b" * n


def begins(lines, sign):
    return {line.index(sign) for line in lines if sign in line}


def test_cells_stay_in_their_columns_whatever_the_number_of_rows():
    for n in (3, 300, 100_000):
        lines = render(f"<table>{rows(n)}</table>").split("\n")
        assert len(lines) == n + 1 and begins(lines, "x") == begins(lines[1:], "b") == {15}


def test_a_table_is_set_alike_whatever_tables_come_before():
    one = f"<table>{rows(400, 'w' * 900)}</table>"
    alone, many = render(one), render(f"{one}<p>next</p>" * 12)
    assert many.split("\n\nnext")[:-1] == [alone] + ["\n\n" + alone] * 11


def test_a_row_with_an_overlong_cell_goes_on_below_it_in_its_columns():
    columns = []
    for n in (1_000, 4_000):  # as many words a row, so the same columns
        lines = render(f"<table>{rows(n, 'w' * 200 * n)}</table>").split("\n")
        assert lines[0] == "w" * 200 * n and lines[1].strip(" ") == "x" and len(lines) == n + 2
        at = begins(lines, "x")
        assert at == begins(lines, "b") and len(at) == 1
        columns += at
    assert all(100 < c < 64 * 300 for c in columns)
    three = render("<table>" + f"<tr><td>{'v' * 50_000}<td>{'w' * 50_000}<td>x" + "<tr><td>a<td>b<td>c" * 5_000 + "</table>").split("\n")
    assert [line.strip(" ")[:1] for line in three[:4]] == ["v", "w", "x", "a"] and three[3].index("b") == three[1].index("w") and begins(three, "c") == {three[2].index("x")}


def test_layout_is_bounded_by_the_page():
    spans = "<table><tr>" + "<td rowspan=0>ab" * 1_000 + "<td>x" + "<tr><td>y" * 3_000
    nested = "<table><tr><td>a<td>b<tr><td>c<td>" * 1_000
    deep = f"<table><tr><td>{'w' * 3_000}<td>x" + "<tr><td>a<td>b" * 500
    for page in (spans, nested, f"<table>{rows(20_000, 'w' * 100_000)}</table>", deep + "<tr><td>c<td>" + deep, "<table>" + "<tr><td>\u0301<td>x" * 3):
        text = render(page)
        assert len(text) < (html_text.PADDING + 2) * len(page)
        assert re.sub(r"\s", "", text) == re.sub(r"\s", "", re.sub("<.*?>", "", page))


def test_cells_of_combining_signs_alone_have_a_column():
    lines = render("<table><tr><td>a<td>́<td>xx<td>y<tr><td>a<td><td>b<td>z").split("\n")
    assert lines == ["a  ́   xx  y", "a     b   z"]
