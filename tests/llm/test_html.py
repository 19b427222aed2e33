import re
import time
from html.parser import HTMLParser

import pytest

from lotwise.llm import htmltext


@pytest.mark.parametrize(
    "page, want",
    [
        ("", ""),
        ("plain &lt;text&gt; 1 < 2", "plain <text> 1 < 2"),
        ("<p>a<p>b<div>c</div>d", "a\n\nb\n\nc\nd"),
        ("<ul><li>a<li>b<ul><li>c</ul></ul>", "- a\n- b\n  - c"),
        ("<ol start=9><li>a<li>b</ol>", "9. a\n10. b"),
        ("<table><tr><th>n<th>count<tr><td>long name<td>5</table>", "n          count\nlong name  5"),
        ("<table><tr><td colspan=2>wide<td>x<tr><td>a<td>b<td>c</table>", "wide  x\na  b  c"),
        ("<pre>a\n  b</pre>c", "a\n  b\n\nc"),
        ("a<br>b<hr>c", "a\nb\n\nc"),
        ("<p hidden>x<p>y<span style='DISPLAY : none'>z</span>", "y"),
        ("<head><title>t</title></head><script>'</p>'</script>a<style>b</style>", "a"),
        ("<script>never closed", ""),
        ("a<!-- b", "a"),
        ("<details>x<summary>s</summary></details><details open><summary>t</summary>y</details>", "s\nt\ny"),
        ("<b><i>x</b>y</i>", "xy"),
        ('<a title="a>b">c</a><img alt=pic>', "cpic"),
        ("<p>a</p></p></div>b", "a\n\nb"),
    ],
)
def test_layout(page, want):
    assert htmltext.extract(page)[1] == want


@pytest.mark.parametrize(
    "page, want",
    [
        ("<div>" * 160 + "<div hidden>secret</div>ok", "ok"),
        ('<ol start="--5"><li>a<li>b</ol>', "1. a\n2. b"),
        ("<ol start=-3><li>a<li value=9>b<li>c</ol>", "-3. a\n9. b\n10. c"),
        ("<ol start=" + "9" * 5000 + "><li>a</ol>", "1000000000. a"),
        ("<table><tr><td colspan=" + "9" * 5000 + ">one<tr><td>a<td>b</table>", "one\na  b"),
        ("<table><tr><td colspan=x>one<td rowspan=-2>b<tr><td>a</table>", "one  b\na"),
        ("<table><tr><td rowspan=2>Mon<td>a<td>b<tr><td>c<td>d</table>", "Mon  a  b\n     c  d"),
        ("<table><tr><td>a<td rowspan=0>b<td>c<tr><td>d<td>e</table>", "a  b  c\nd     e"),
        ("<table><tbody><tr><td rowspan=9>a<td>b<tbody><tr><td>c<td>d</table>", "a  b\nc  d"),
        ("<table><tr><td>" + "x" * 70 + "<td>b<tr><td>c<td>d</table>", "x" * 70 + "  b\nc" + " " * 71 + "d"),
        ("<table><tr><td colspan=2>long heading here<td>z<tr><td>c<td>d<td>e</table>", "long heading here  z\nc  d               e"),
        ('a < b <c and "d', 'a < b <c and "d'),
        ("<a x=\"1>b<i y='>c", "bc"),
    ],
)
def test_odd_attributes_and_spans(page, want):
    assert htmltext.extract(page)[1] == want


@pytest.mark.parametrize("piece", ["<a ", '<a "', "<a '\">", '<a "><', "<table><td rowspan=9>", "<!--", "<script>", "<td rowspan=60000>x<tr>"])
def test_reading_is_linear(piece):
    """Eight times the page takes nowhere near 64 times as long."""
    took = []
    for n in (4000, 32000):
        began = time.process_time()
        htmltext.extract(piece * n)
        took.append(time.process_time() - began)
    assert took[1] < 24 * max(took[0], 0.02)


def test_padding_is_bounded():
    page = "<table><tr>" + "<td>x" * 1000 + "<tr><td colspan=1000>y<td>z" * 2000 + "</table>"
    text = htmltext.extract(page)[1]
    assert len(text) < 20 * len(page) and text.count("z") == 2000


def test_deep_and_long_pages_end():
    assert htmltext.extract("<div>" * 20000 + "x" + "</div>" * 20000)[1] == "x"
    assert htmltext.extract("<b>" * 50000 + "x")[1] == "x"
    assert htmltext.extract("<" * 100000)[1] == "<" * 100000
    assert len(htmltext.extract("<ul><li>" * 300 + "x")[1]) > 1


@pytest.mark.parametrize("tag", ["font", "span", "div", "b"])
@pytest.mark.parametrize("depth", [200, 30000])
def test_rules_hold_at_any_depth(tag, depth):
    deep = f"<{tag}>" * depth
    for page, want in [
        ("a<i style='display:none'>x</i>b", "ab"), ("a<template>x</template><noscript>y</noscript>b", "ab"),
        ("<details>x<summary>s</summary></details>", "s"), ("<ol start=9><li>a<li>b</ol>", "9. a\n10. b"),
        ("<table><tr><th>n<th>count<tr><td>long name<td>5</table>", "n          count\nlong name  5"),
        (f"<{tag}>c</{tag}><p hidden>x</p>", "c"),
    ]:
        assert htmltext.extract(deep + page)[1] == want


@pytest.mark.parametrize(
    "page, want",
    [
        ("a <math><mi>x</mi><mo>=</mo><mn>2</mn></math> b", "a x=2 b"),
        ("<math><semantics><mi>y</mi><annotation encoding='tex'>\\y</annotation></semantics></math>", "y"),
        ("<svg><title>t</title><desc>d</desc><metadata>m</metadata><defs><text>u</text></defs><text>one</text><text>two</text></svg>z", "one two z"),
        ("<svg><title/><style/><path d='M0'/><text>label</text></svg>after", "label after"),
        ("<svg><g><foreignObject><p>in</p></foreignObject></g></svg>out", "in\n\nout"),
        ("<svg><defs><p>broken out</p>", "broken out"),
        ("<desc>shown</desc><p style='display:none'><svg><text>x</text></svg></p>", "shown"),
    ],
)
def test_svg_and_math_text_is_shown(page, want):
    assert htmltext.extract(page)[1] == want


def test_lists_and_tables_at_any_depth():
    for n in (100, 190, 300, 5000):
        text = htmltext.extract("".join(f"<ul><li>x{i}" for i in range(n)))[1]
        assert [x.strip() for x in text.split("\n") if x] == [f"- x{i}" for i in range(n)]
        text = htmltext.extract("".join(f"<table><tr><td>x{i}" for i in range(n)) + "<td>y")[1]
        assert text.split() == [*(f"x{i}" for i in range(n)), "y"]
    assert htmltext.extract("<ul><li>" * 300 + "x")[1] == "- " * 300 + "x"


class Plain(HTMLParser):
    """All text of tags that are shown, by the standard library's parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.shut, self.out = 0, []

    def handle_starttag(self, tag, attrs):
        self.shut += tag in ("script", "style", "title")

    def handle_endtag(self, tag):
        self.shut -= tag in ("script", "style", "title")

    def handle_data(self, data):
        if not self.shut:
            self.out.append(data)


def test_pages_keep_their_words(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r.page_id: r.text for r in htmltext.visible_text(pages).collect()}
    for r in pages.collect():
        plain = Plain()
        plain.feed(r.html)
        marks = re.sub(r"(?m)^ *(- |\d+\. )+", "", got[r.page_id])
        assert "".join(marks.split()) == "".join("".join(plain.out).split())


def test_odd_rows(spark):
    rows = [(1, None, None, 0), (1, "u", "", 0), (None, "u", "<p>x", 0), (None, "u", "<p>x", 0)]
    got = htmltext.visible_text(spark.createDataFrame(rows, "page_id int, url string, html string, text int")).collect()
    assert sorted((r.page_id or 0, r.text, r.n_lines) for r in got) == [(0, "x", 1), (0, "x", 1), (1, "", 0), (1, "", 0)]


def nested_tables(depth, wide):
    page = "x" * 30
    for _ in range(depth):
        page = f"<table><tr><td>{'y' * wide}<td>{page}<tr><td>a<td>b</table>"
    return page


@pytest.mark.parametrize("depth, wide", [(10, 10), (40, 40), (150, 60), (199, 5)])
def test_blank_space_of_tables_in_tables_is_bounded_for_the_page(depth, wide):
    """An inner table's padding isn't text that an outer one may pad anew."""
    page = nested_tables(depth, wide)
    text = htmltext.extract(page)[1]
    assert len(text) < 4096 + 10 * len(page) and text.count("y") == depth * wide and text.count("x") == 30


def test_indents_of_lists_in_lists_are_bounded_for_the_page():
    page = "<ul><li>" * 190 + "<br>".join("x" * 3000) + "</ul>" * 190
    text = htmltext.extract(page)[1]
    assert len(text) < 4096 + 10 * len(page) and text.count("x") == 3000


@pytest.mark.parametrize(
    "page, want",
    [
        ("a<div style='visibility:hidden'>b<span style='visibility:visible'>c</span>d</div>e", "a\nc\ne"),
        ("<div style='display:none'>b<span style='display:block;visibility:visible'>c</span></div>e", "e"),
        ("a <span style='opacity:0.0'>b</span>c<i style='opacity:.5'>d</i>", "a cd"),
        ("<p hidden style='display:block'>shown</p><dialog style='display:block'>too</dialog>", "shown\n\ntoo"),
        ("<style>.x{display:none} #y , p.z{visibility:hidden}</style><p class='a x'>1<p id=y>2<p class=z>3</p><b class=z>4", "4"),
        ("<style>p{display:none}.on{display:block}</style><p>1<p class=on>2", "2"),
        ("<style>.on{display:block}p{display:none}</style><p class=on>id, class, tag, then order", "id, class, tag, then order"),
        ("<style>p{display:none !important}#i{display:block}</style><p id=i style='display:block'>1</p>2", "2"),
        ("<style>p{display:none}</style><p style='display:block'>own style</p>", "own style"),
        ("<style>a.b:hover{display:none} .c .d{display:none} @media print{.e{display:none} .f{display:none}} .g{display:none}</style><a class=b>1</a> <b class=d>2</b> <b class=e>3</b> <b class=f>4</b> <b class=g>5</b>", "1 2 3 4"),
        ("<style media=print>p{display:none}</style><style>/* p{display:none} */ <!-- .h{display:none} --></style><p>1</p><i class=h>2</i>", "1"),
        ("<style>.u{display:none}", ""),
        ("<p>x</p><style>.u{display:none</style><p class=u>y</p>", "x"),
        ("a<span style='display:block'>b</span>c", "a\nb\nc"),
        ("<ul><li style='display:inline'>a</li> <li style='display:inline-block'>b</li></ul>", "a b"),
        ("<span style='white-space:pre'>a   b\n  c</span>", "a   b\n  c"),
        ("<pre>a  b<span style='white-space:normal'>  c  </span></pre>", "a  b c"),
        ("<ol reversed><li>a<li hidden>x<li>b</ol>", "2. a\n1. b"),
        ("<ol reversed start=9><li>a<li value=3>b<li>c</ol>", "9. a\n3. b\n2. c"),
        ("<ol type=a start=26><li>a<li>b<li type=I>c<li type=1>d</ol>", "z. a\naa. b\nXXVIII. c\n29. d"),
        ("<ol type=i start=0><li>a<li>b</ol><ol type=A start=-1><li>c</ol>", "0. a\ni. b\n\n-1. c"),
        ("<table><tr><td>a<td style='visibility:hidden'>b<td>c<tr><td>dd<td>e<td>f</table>", "a      c\ndd  e  f"),
        ("<ul><li style='visibility:hidden'>a<b style='visibility:visible'>b</b><li>c</ul>", "b\n- c"),
        ("x<img alt=y style='visibility:hidden'>z", "xz"),
    ],
)
def test_styles(page, want):
    assert htmltext.extract(page)[1] == want


@pytest.mark.parametrize("many", [lambda n: "<style>" + "".join(f".c{i}{{display:none}}" for i in range(n)) + "</style>" + "<b class='d'>x</b>" * n, lambda n: "<style>" + ".a{display:none}" * n + "</style>" + "<b class='a'>x</b>" * n, lambda n: "<style>" + "@media{" * n + "/*" * n, lambda n: f"<style>.a{{visibility:hidden}}</style><b class='{'a ' * n}'>x</b>", lambda n: "<span style='visibility:hidden'>" * n + "x"])
def test_styles_are_read_in_linear_time(many):
    def seconds(n):
        page = many(n)
        began = time.perf_counter()
        htmltext.extract(page)
        return time.perf_counter() - began

    seconds(1000)
    assert seconds(40_000) < 12 * max(seconds(10_000), 0.02)
