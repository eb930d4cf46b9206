import random
import re
from collections import Counter
from html.parser import HTMLParser

import pyarrow.parquet as pq
import pytest

from almanac.llm import html_text
from almanac.llm.html_text import render


class Brute(HTMLParser):
    """Words of all text outside of head, script and style."""

    def __init__(self, html):
        super().__init__()
        self.skip, self.words = None, []
        self.feed(html)
        self.close()

    def handle_starttag(self, tag, attrs):
        if tag in ("title", "script", "style") and not self.skip:
            self.skip = tag

    def handle_endtag(self, tag):
        if tag == self.skip:
            self.skip = None

    def handle_data(self, data):
        if not self.skip:
            self.words += data.split()


def test_words_of_pages_against_brute_force():
    for html in pq.read_table("/root/testdata/sf0.001/pages.parquet")["html"].to_pylist():
        marks = lambda words: Counter(w for w in words if w != "-")
        # words may be split by inline tags in the one and by blocks in the other: compare the characters too
        assert "".join(sorted(re.sub(r"\s|(?m:^ *- )", "", render(html)))) == "".join(sorted(re.sub(r"\s", "", "".join(Brute(html).words)))) or marks(render(html).split()) == marks(Brute(html).words)


def test_blocks_and_spacing():
    assert render("a<div>b</div>c") == "a\nb\nc"
    assert render("<p>a<p>b<p>c") == "a\n\nb\n\nc"
    assert render("<h1>T</h1>text<br>more<hr>end") == "T\n\ntext\nmore\n\nend"
    assert render("  x \n <b> y</b>z&nbsp;w &lt;i&gt; &#233;") == "x yz\xa0w <i> é"
    assert render("<pre>a\n  b\n\n c</pre>d") == "a\n  b\n\n c\n\nd"
    assert render("a<br><br>b") == "a\n\nb"


def test_lists():
    assert render("<ul><li>a<li>b<ol><li>c<li value=7>d</ol><li>e</ul>") == "- a\n- b\n  1. c\n  7. d\n- e"
    assert render('<ol start="9"><li>x<p>y</p></li><li>z</li></ol>') == "9. x\n\n   y\n\n10. z"
    assert render("<dl><dt>t<dd>d<dt>u</dl>") == "t\n  d\nu"


def test_tables():
    assert render("<table><tr><th>Name<th>Qty<tr><td>apples<td>10<tr><td>漢字<td>2</table>") == "Name    Qty\napples  10\n漢字    2"
    assert render("<table><td>a<td>b</table>") == "a  b"
    assert render("<table>stray<tr><td>a</table>") == "stray\n\na"
    assert render("<table><caption>C</caption><tfoot><tr><td>f</tfoot><tbody><tr><td>b</table>") == "C\nb\nf"
    assert render("<table><tr><td rowspan=2>a<td>b<tr><td>c<tr><td colspan=2>wide cell<td>d</table>") == "a  b\n   c\nwide cell  d"
    assert render("<table><tr><td>a<br>b<td>c</table>") == "a  c\nb"
    assert render("<table><tr><td>x<table><tr><td>in<td>ner</table><td>y</table>") in ("x        y\n\nin  ner", "x  y\n\nin  ner", "x        y\nin  ner")
    assert render("<td>a<td>b") == "a b"


def test_visibility():
    assert render("<head><title>t</title></head><script>x</script><style>y</style><!-- z -->v<noscript>n</noscript><template>t</template>") == "v"
    assert render('<div hidden>a</div><p style="DISPLAY: none">b</p><span style="visibility:hidden">c<i style="visibility:visible">d</i></span>e') == "de"
    assert render("<details><summary>s</summary>body</details><details open><summary>t</summary>u</details>") == "s\nt\nu"
    assert render("<dialog>a</dialog><dialog open>b</dialog><iframe>c</iframe><textarea>d &amp;</textarea>") == "b\nd &"


def test_odd_input():
    for html, want in (("", ""), ("plain  text", "plain text"), ("a < b", "a < b"), ("<p", ""), ("x<!-- open", "x"), ("<b>un<i>closed", "unclosed"), ("</p></div>a</ul>", "a"), ('<a title="x>y">t</a>', "t"), ("<a title='x>t", "t"), ("<script>never ends", ""), ("<br/>a", "a")):
        assert render(html) == want, html
    assert render("<div>" * 5000 + "deep" + "</div>" * 5000) == "deep"
    assert render("<ul><li>" * 3000 + "deep").endswith("deep")
    assert "cell" in render("<table><tr><td>" * 1000 + "cell")
    assert render("w " * 200_000).count("w") == 200_000
    rng = random.Random(0)
    parts = ["<p>", "<table>", "<tr>", "<td>", "</table>", "<li>", "<ul>", "</ul>", "text", " ", "<b>", "</b>", "<pre>", "\n", "<th colspan=3>", "<td rowspan=9>", "</div>", "<div>", "<caption>", "<select><option>", "&amp;", ">", "<h2>", "</h3>", "<tbody>", "<col>"]
    for _ in range(1500):
        made = rng.choices(parts, k=25)
        assert render("".join(made)).count("text") >= made.count("text"), made


def test_hidden_at_any_depth_and_raw_text_with_open_quotes():
    for depth in (150, 205, 3000):
        assert render("<div>" * depth + "<div hidden>SECRET</div>ok") == "ok"
        assert render("<div>" * depth + "<table><tr><td>a<td>b<tr><td>long<td>c</table>") == "a     b\nlong  c"
        assert render("<div>" * depth + "<pre>a\n  b</pre>") == "a\n  b"
    assert render("""<p>A</p><style>x{content:"<b '"}</style><p id='k'>it's ok</p><div>End</div>""") == "A\n\nit's ok\n\nEnd"
    assert render("""<script>var q='<b x="';</script><p title="t">6" pipe</p>""") == '6" pipe'
    assert render("<pre>\na<b>c</b>d\n</pre>e") == "acd\n\ne"


def test_wide_columns_and_spans():
    wide = "x" * 50
    assert render(f"<table><tr><td>{wide}<td>b<tr><td>c<td>d</table>") == f"{wide}  b\nc{' ' * 51}d"
    assert render("<table><tr><td colspan=900>a<td>z<tr>" + "<td>b" * 900 + "<td>y</table>").splitlines()[0] == "a" + " " * (900 * 3 - 1) + "z"


def test_layout_of_huge_pages_is_bounded():
    for page in ("<ul><li>x" * 20_000, "<table><tr><td>x" * 5_000, "<table><tr><td>a<td>b<tr><td>c<td>" * 300, f"<table><tr><td>{'w' * 200_000}<td>x" + "<tr><td>a<td>b" * 10_000, "<p>" * 50_000 + "</b>" * 50_000 + "x"):
        text = render(page)
        assert len(text) < 100 * len(page) + 2 * html_text.PADDING
        assert re.sub(r"\W", "", text) == re.sub(r"\W", "", re.sub("<.*?>", "", page))


# ---- a brute-force version of the layout: a tree, blocks as lists of lines that are copied into their parents


def brute_lines(tag, children, hidden=False):
    """(lines, whether an empty line must follow) of an element's content; ``children`` are strings and (tag, children)."""
    out, run, gap = [], [], False

    def put(lines):
        nonlocal gap
        if lines:
            out.extend([""] * (gap and out[-1:] not in ([], [""])) + lines)
            gap = False

    def flush():
        text = " ".join("".join(run).split())
        run.clear()
        put([text] if text else [])

    def block(lines, apart, after=None):
        nonlocal gap
        flush()
        gap |= apart
        put(lines)
        gap |= apart if after is None else after

    def visit(tag, children):
        nonlocal gap
        order = 0
        for child in children:
            if isinstance(child, str):
                run.append(child)
                continue
            name, inner = child
            if name in ("b", "i"):
                visit(name, inner)
            elif name == "br":
                if "".join(run).strip():
                    flush()
                elif out and not gap:
                    out.append("")
            elif name == "script":
                pass
            elif name == "li":
                order += 1
                mark = f"{order}. " if tag == "ol" else "- "
                lines, after = brute_lines(name, inner)
                block([((" " * len(mark) if i else mark) + x).rstrip() if x or not i else x for i, x in enumerate(lines)], False, after and bool(lines))
            elif name in ("ul", "ol"):
                block(brute_lines(name, inner)[0], tag != "li")
            elif name == "blockquote":
                block(["  " + x if x else x for x in brute_lines(name, inner)[0]], True)
            elif name == "table":
                block(brute_table(inner), True)
            else:
                flush()
                gap |= name in ("p", "h1")
                visit(name, inner)
                flush()
                gap |= name in ("p", "h1")

    visit(tag, children)
    flush()
    return out, gap


def brute_table(rows):
    cells = [[brute_lines("td", c)[0] for _, c in row] for _, row in rows]
    wide = [max((len(x) for r in cells if i < len(r) for x in r[i]), default=0) for i in range(max(map(len, cells), default=0))]
    out = []
    for row in cells:
        for i in range(max(map(len, row), default=0)):
            line = "".join((c[i] if i < len(c) else "").ljust(w + 2 if w else 0) for c, w in zip(row, wide))
            out.append(line.rstrip())
    return out


def serialise(node):
    if isinstance(node, str):
        return node
    return "<br>" if node[0] == "br" else f"<{node[0]}>{''.join(map(serialise, node[1]))}</{node[0]}>"


def grown(rng, depth, inline=False):
    """Random content that HTML's parser takes as it stands."""
    made = []
    for _ in range(rng.randint(0, 4)):
        kind = rng.choice(["text", "text", "space", "b", "br", "script"] + ([] if inline or not depth else ["div", "p", "h1", "ul", "ol", "blockquote", "table"]))
        if kind == "text":
            made.append(rng.choice(["a", "bb ", " ccc", "d  e", "\nf"]))
        elif kind == "space":
            made.append(rng.choice([" ", "\n "]))
        elif kind == "br":
            made.append(("br", []))
        elif kind == "script":
            made.append(("script", ["var x = '<p>';"]))
        elif kind in ("b", "p", "h1"):
            made.append((kind, grown(rng, depth - 1 if depth else 0, True)))
        elif kind in ("ul", "ol"):
            made.append((kind, [("li", grown(rng, depth - 1)) for _ in range(rng.randint(0, 3))]))
        elif kind == "table":
            made.append((kind, [("tr", [("td", grown(rng, depth - 1)) for _ in range(rng.randint(1, 3))]) for _ in range(rng.randint(1, 3))]))
        else:
            made.append((kind, grown(rng, depth - 1)))
    return made


def brute(children):
    lines = brute_lines("body", children)[0]
    return "\n".join(lines).strip("\n")


def test_layout_against_brute_force():
    rng = random.Random(11)
    for _ in range(4000):
        tree = grown(rng, rng.randint(0, 4))
        html = "".join(map(serialise, tree))
        assert render(html) == brute(tree), html


def brute_grid(groups):
    """Lines of a table of one-line cells: groups of rows of (text, colspan, rowspan), each cell put into every place it covers."""
    rows, base = [], 0
    places, cells = {}, []
    for group in groups:
        for r, row in enumerate(group):
            c = 0
            for text, across, down in row:
                while (base + r, c) in places:
                    c += 1
                last = len(group) if down == 0 else min(len(group), r + down)
                for y in range(r, last):
                    for x in range(c, c + across):
                        places.setdefault((base + y, x), text)
                cells.append((base + r, c, across, text))
                c += across
        base += len(group)
        rows += group
    n = max((c + a for _, c, a, _ in cells), default=0)
    width = [max([len(t) for _, c, a, t in cells if (c, a) == (x, 1)], default=0) for x in range(n)]
    if not any(c for _, c, _, _ in cells):
        width = [0] * n
    else:
        last = {r: max(c for y, c, _, _ in cells if y == r) for r, *_ in cells}
        for a, c, need in sorted({(a, c, max(len(t) for y, x, b, t in cells if (x, b) == (c, a) and x < last[y])) for r, c, a, _ in cells if a > 1 and c < last[r]}):
            own = [x for x in range(c, c + a) if width[x]]
            have = sum(width[x] + 2 for x in own) - 2 if own else 0
            width[own[-1] if own else c] += max(0, need - have)
    out = []
    for r in range(len(rows)):
        own = sorted((c, t) for y, c, _, t in cells if y == r)
        line = ""
        for c, t in own:
            if t:
                start = sum(w + 2 for w in width[:c] if w)
                line = (line.ljust(start) if start > len(line) else line + "  " * bool(line)) + t
        if any(t for _, t in own):
            out.append(own[0][1] if len(own) == 1 and own[0][0] == 0 else line)
    return out


def test_spans_against_brute_force():
    rng = random.Random(5)
    for _ in range(3000):
        groups = [[[(rng.choice(["a", "bb", "ccccc", "d" * 12, ""]), rng.choice([1, 1, 1, 2, 3]), rng.choice([1, 1, 1, 2, 3, 0])) for _ in range(rng.randint(0, 4))] for _ in range(rng.randint(1, 4))] for _ in range(rng.randint(1, 3))]
        html = "<table>" + "".join("<tbody>" + "".join("<tr>" + "".join(f"<td colspan={a} rowspan={d}>{t}" for t, a, d in row) for row in g) for g in groups) + "</table>"
        assert render(html) == "\n".join(brute_grid(groups)).strip("\n"), html


def test_columns_are_as_wide_as_what_spans_them():
    assert render("<table><tr><td colspan=2>wide cell here<td>z<tr><td>a<td>b<td>c</table>") == "wide cell here  z\na  b            c"
    assert render("<table><tbody><tr><td rowspan=3>a<td>b</tbody><tbody><tr><td>c</table>") == "a  b\nc"
    assert render("<table><tr><td rowspan=0>a<td>b<tr><td>c<tr><td>d</table>") == "a  b\n   c\n   d"


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ('<p style="display:none;display:block">x', "x"),
        ('<p style="display:block;display:none">x', ""),
        ('<p style="display:none!important;display:block">x', ""),
        ('<p style="display:none;display:nonsense">x', ""),
        ('<p style="display:none;/* ; */DISPLAY : Block ! Important">x', "x"),
        ("<p style='background:url(a;display:none)'>x", "x"),
        ('<p style="visibility:hidden; visibility:visible">x', "x"),
        ('<div style="visibility:hidden">a<b style="visibility:inherit">b</b><i style="visibility:initial">c</i></div>', "c"),
        ('<p style="color:red" style="display:none">x', "x"),
        ('<p style="display&#58;none">x', ""),
        ('<p hidden style="display:block">x', "x"),
        ("<p hidden>x", ""),
        ('<dialog style="display:block">x</dialog>', "x"),
        ('<p style="content-visibility:hidden;content-visibility:auto">x', "x"),
        ("<ol reversed><li>a<li>b<li style='display:none'>n<li>c</ol>", "3. a\n2. b\n1. c"),
        ("<ol reversed start=10><li>a<li value=4>b<li>c</ol>", "10. a\n4. b\n3. c"),
        ("<ol><li value=0>a<li>b</ol>", "0. a\n1. b"),
    ],
)
def test_what_styles_and_attributes_say(page, text):
    assert render(page) == text


class Tree(HTMLParser):
    """The trees of the test pages: a p ends a p before it; head and what is not shown are left out."""

    def __init__(self, html):
        super().__init__()
        self.open = [("body", [])]
        self.feed(html)
        self.close()

    def handle_starttag(self, tag, attrs):
        if tag == "p" and any(t == "p" for t, _ in self.open):
            self.handle_endtag("p")
        if tag in ("html", "body", "meta"):
            return
        node = ({"head": "script", "a": "b"}.get(tag, tag), [])
        self.open[-1][1].append(node)
        if tag != "br":
            self.open.append((tag, node[1]))

    def handle_endtag(self, tag):
        if any(t == tag for t, _ in self.open[1:]):
            while self.open.pop()[0] != tag:
                pass

    def handle_data(self, data):
        self.open[-1][1].append(data)


def test_query_against_brute_force(spark):
    from almanac.llm.queries import QUERIES

    pages = pq.read_table("/root/testdata/sf0.001/pages.parquet").to_pylist()
    want = {r["page_id"]: brute(Tree(r["html"]).open[0][1]) for r in pages}
    got = {r.page_id: (r.text, r.n_chars) for r in QUERIES["op1_html_text"](spark, "/root/testdata/sf0.001").collect()}
    assert got == {k: (v, len(v)) for k, v in want.items()}


def test_frames(spark):
    rows = [(1, "<p>a", "t", 1), (1, "<p>a", "t", 1), (2, None, "t", 2), (None, "", None, 3)]
    pages = spark.createDataFrame(rows, "page_id long, html string, text string, visible_text int")
    out, name = html_text.extract(pages)
    assert name == "visible_text_" and out.columns == [*pages.columns, name]
    assert sorted((str(r.page_id), r[name], str(r.text)) for r in out.collect()) == [("1", "a", "t"), ("1", "a", "t"), ("2", "", "t"), ("None", "", "None")]
    assert html_text.extract(pages.limit(0))[0].count() == 0
