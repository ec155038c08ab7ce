import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from compare import check, connect

from loomgrid.llm import html_extract as H


def test_same_as_sql(spark):
    check(H.query(spark, "/root/testdata/sf0.001"), H.sql(), connect("/root/testdata/sf0.001"))


def naive(rows, width, surge):
    size = lambda i: sum(map(len, rows[i : i + width]))
    out, i = [], 0
    while i < len(rows):
        if size(i) > surge:
            while i < len(rows) and size(i):
                out += [rows[i]] if rows[i] else []
                i += 1
        else:
            i += 1
    return out


def test_surge_and_dive():
    import random

    r = random.Random(2)
    for _ in range(300):
        rows = ["x" * r.choice([0, 0, 0, 5, 30, 90]) for _ in range(r.randrange(40))]
        for width in (1, 2, 3, 5):
            assert H.kept(rows, width, 60) == naive(rows, width, 60)


LONG = "A sentence of the main text that goes on for a while, so that its block is long enough to be a surge point of the page and not a mere label in a menu. "


def page(body):
    return f"<!DOCTYPE html><html><head><title>No</title><script>var a = '<p>no</p>';</script></head><body>{body}</body></html>"


def test_markup():
    body = f"<nav><ul><li><a href='/a>b'>Home</a></li></ul></nav><!-- <p>{LONG}</p> --><article><h1>Head &amp; more</h1><p>{LONG}<b>bold</b> &lt;i&gt;<br>{LONG}<p title=\"a>b\">{LONG}</article><footer>(c) x</footer>"
    text = H.kept(H.lines(page(body)))
    assert text == ["Head & more", LONG + "bold <i>", LONG.strip(), LONG.strip()]


def by_expressions(html, width=H.WIDTH):
    import html as entities
    import re

    for p, r in H.STEPS:
        html = re.sub(p, "\n" * (width + 1) if len(r) > 1 else r, html)
    return [x.strip(H.SPACE) for x in entities.unescape(html).split("\n")]


PIECES = ["<!--", "-->", "<script", "<SCRIPT>", "</script >", "</script", "<head>", "</head>", "<p", "</p>", "<div ", "<div/>", "<td\n", "<a href=", "<b>", "<!x", "<?", "<1", ">", '"', "'", "/", " ", "\n", "text", "&amp;", "&lt;", "é", "<"]


@settings(deadline=None, max_examples=1500)
@given(st.lists(st.sampled_from(PIECES), max_size=30).map("".join))
def test_scanner_same_as_expressions(html):
    assert H.lines(html) == by_expressions(html)


@pytest.mark.parametrize("piece", ["<!--", "<script>", "<script", "<a \"", "<a '\"", "<p \"x'", "<div ", "</script   ", "<svg><a \"'>", "&#9", "&", "<"])
def test_malformed_pages_take_time_in_proportion(piece):
    began = time.perf_counter()
    H.kept(H.lines(piece * ((1 << 20) // len(piece))))
    assert time.perf_counter() - began < 5  # an expression took hours


def test_numbers_beyond_characters():
    assert H.lines("&#" + "9" * 6000 + ";&#" + "0" * 5000 + "65;&#x" + "f" * 6000 + ";&#0;&#00000000;") == ["\ufffdA\ufffd\ufffd\ufffd"]


def test_awkward(spark):
    rows = [(1, None), (2, ""), (3, "  \n "), (None, page(f"<p>{LONG}</p>")), (4, page(f"<p>{LONG}</p>" * 5000)), (5, "<p>" + LONG), (5, "<p>" + LONG), (6, LONG + "<unclosed"), (7, "<script>" + LONG), (8, page("<p>short</p>"))]
    pages = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, html string, text string, n_lines int")
    got = sorted(map(tuple, H.extract(pages).collect()), key=str)
    by = {}
    for d, t, n, c in got:
        by.setdefault(d, []).append((t, n, c))
    assert by[1] == [(None, 0, 0)] and by[2] == [("", 0, 0)] == by[3] == by[8]
    assert by[4][0][1] == 5000 and by[5] == [(LONG.strip(), 1, len(LONG.strip()))] * 2 == by[None] * 2
    assert by[6][0][0].endswith("<unclosed") and by[7][0][0] == LONG.strip()
    assert H.extract(pages.filter("1 = 0")).count() == 0
