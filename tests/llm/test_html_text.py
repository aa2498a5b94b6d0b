from __future__ import annotations

import random
import time

import pytest

from granary.llm import html_text
from granary.llm.html_text import text_of


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("", ""),
        ("plain  text\n here", "plain text here"),
        ("<p>a<p>b</p>c", "a\n\nb\n\nc"),
        ("a<br>b<br/>c", "a\nb\nc"),
        ("<div>a</div><div>b</div>", "a\nb"),
        ("<p>a <b>b<p>c</b> d", "a b\n\nc d"),
        ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", "- a\n- b\n  - c\n- d"),
        ("<ol start=9><li>a<li value=20>b<li>c</ol>", "9. a\n20. b\n21. c"),
        ("<dl><dt>t<dd>d<dt>u<dd>e</dl>", "t\n  d\nu\n  e"),
        ("<table><tr><th>Name<th>N<tr><td>x<td>10<tr><td>long one<td>2</table>", "Name      N\nx         10\nlong one  2"),
        ("<table><tr><td colspan=2>ab<td>c<tr><td>d<td>e<td>f</table>", "ab     c\nd   e  f"),
        ("<table><caption>cap</caption><thead><tr><td>a<tbody><tr><td>b</table>", "cap\na\nb"),
        ("<table><tr><td>a<br>b<td>c</table>", "a  c\nb"),
        ("<pre>  a\n   b</pre>", "  a\n   b"),
        ("x<pre>  a\n\n b</pre>", "x\n\n  a\n\n b"),
        ("<title>t</title><style>p{}</style><script>var x='</p>';</script><body>b", "b"),
        ("<head><title>t</title>visible", "visible"),
        ("a<template>n</template><noscript>n</noscript><!-- n --><span hidden>n</span><i style='x:y; display : none'>n</i>b", "ab"),
        ("<div style='visibility:hidden'>n<b style='visibility: visible'>y</b></div>", "y"),
        ("&lt;b&gt; &amp; &copy &eacute; &#x41;&nbsp;x", "<b> & © é A\u00a0x"),
        ("1 < 2 <3 </> <a", "1 < 2 <3 </>"),
        ("<a title='>'>x</a><a title=\"q>y", "xy"),
        ("<!DOCTYPE html><?xml ?><P>Up</P>", "Up"),
        ("<select><option>a<option>b</select>", "a\nb"),
        ("</p></div>x</li>", "x"),
        ("<textarea> a <b> </textarea>", "a <b>"),
    ],
)
def test_rendering(html, text):
    assert text_of(html) == text


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("<table><tr><form><td>a</td><td>b</td></form></tr></table>c", "a  b\n\nc"),
        ("<table><form><tr><td>a<td>b</tr><tr><td>c<td>d</form></table>", "a  b\nc  d"),
        ("<table><tr><center><td>a</td><td>b</td></center></tr></table>", "a  b"),
        ("<table><tr><font color=red><td>a<td>b<tr><a href=x>y<td>c<td>d</table>", "y\na  b\nc  d"),
        ("<table><tr>text<td>a</table>", "text\na"),
        ("<table><tr><td>a</td>text</tr></table>", "text\na"),
        ("<table><tr><td>a</td><p>text</tr></table>", "text\n\na"),
        ("<table><tbody>Total<tr><td>a<tbody> <b>and</b> more</table>", "Total and more\na"),
        ("<table><caption>cap</caption><thead>x<tfoot>y<tr>z<td>a</table>", "xyz\ncap\na"),
        ("<table><colgroup>x<tr><td>a</table>", "x\na"),
        ("<table><tbody><td>a<td>b<tr><td>c<td>d</table>", "a  b\nc  d"),
        ("<table><tr hidden>x<td>n</tr><tbody hidden><tr>y<td>n</table>", "xy"),
        ("<table><tr><script>n</script><b hidden>n</b><td>a<tbody><style>n</style></table>", "a"),
        ("<table><tr><noscript><td>n</td></noscript><td>a<td hidden>n</table>", "a"),
        ("<table><tr><td><table><tr>x<td>a</table><td>b</table>", "x  b\na"),
        ("<table style='visibility:hidden'>n<tr><td>n<td><b style='visibility:visible'>y</table>", "  y"),
        ("<ul><script>n</script><li>a<li>b</li><div hidden>n</div>c</ul>", "- a\n- b\nc"),
    ],
)
def test_text_outside_cells_and_items(html, text):
    assert text_of(html) == text


def test_no_text_of_nested_tables_is_lost():
    deep = "".join(f"<table><tr>r{i}<td>c{i}" for i in range(300))
    assert all(f"r{i}" in text_of(deep) and f"c{i}" in text_of(deep) for i in (0, 40, 100, 299))


def test_hostile_pages_take_linear_time():
    began = time.time()
    for html in ("<a " * 50_000, '<a "' * 20_000, "<div>" * 50_000 + "x", "<p>" * 50_000, "<script>" * 20_000, "<li>" * 20_000, "<table><tr><td>" * 3_000, "<table><tr>" + "<td rowspan=9999>a" * 5_000 + "<tr><td>b" * 20_000, "<table>" + "<tr><td rowspan=9999>a" * 3_000, "<" * 100_000, "<!--" * 50_000, "&" * 100_000):
        text_of(html)
    assert time.time() - began < 20


def test_extract(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    got = html_text.extract(pages.select("page_id", "html")).collect()
    assert len(got) == pages.count() and all(r.text and "<p" not in r.text and "track(" not in r.text for r in got)
    df = spark.createDataFrame([(1, None, "mine"), (2, "", "mine"), (3, "<p>x", "mine"), (3, "<p>x", "mine")], "page_id long, html string, text string")
    assert [(r.page_id, r.text) for r in html_text.extract(df).orderBy("page_id").collect()] == [(1, None), (2, ""), (3, "x"), (3, "x")]
    assert html_text.extract(df.limit(0)).count() == 0


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("<div style='display:NONE'>n</div><div STYLE='Display : None !important; display:block'>n</div>y", "y"),
        ("<div style='display:none;display:block'>y</div><p style='/* display:none */'>z", "y\n\nz"),
        ("<div hidden style='display:block'>y</div><div style='display:inline'>a</div><span style='display:block'>b</span>c", "y\na\nb\nc"),
        ("<table><tr><td style='visibility:hidden'>n<td>a</table>", "  a"),
        ("<ul><li style='visibility:hidden'>n<li>a<li style='visibility:collapse'>n<b style='visibility:visible'>y</b></ul>", "- a\n  y"),
        ("<table style='visibility:hidden'><caption>n</caption>n<tr><td>n</table>y", "y"),
        ("<table><caption style='visibility:hidden'>n</caption><tr><td>a</table>", "a"),
        ("<ul style='visibility:hidden'>n<li>n</ul><ol hidden>n<li>n</ol>y", "y"),
        ("<details><summary>s</summary>n<p>n</p><summary>n</summary></details><details open><summary>t</summary>y</details>", "s\nt\ny"),
        ("<dialog>n</dialog><dialog open>y</dialog>", "y"),
        ("<ol reversed><li>a<li>b<li hidden>n<li>c</ol>", "3. a\n2. b\n1. c"),
        ("<ol type=a start=26><li>a<li>b<li type=I value=4>c<li type=i>d<li type=1>e</ol>", "z. a\naa. b\nIV. c\nv. d\n6. e"),
        ("<table><tr><td rowspan=2>a<td>b<td>c<tr><td>d<td>e<tr><td>f<td>g</table>", "a  b  c\n   d  e\nf  g"),
        ("<table><tbody><tr><td rowspan=0>a<td>b<tr><td>c<tr><td>d<tbody><tr><td>e<td>f</table>", "a  b\n   c\n   d\ne  f"),
        ("<table><tr><td colspan=2 rowspan=2>a<td>b<tr><td>c<tr><td>d<td>e<td>f</table>", "a     b\n      c\nd  e  f"),
        ("<ul><ul><li>a</ul><li>b</ul>", "  - a\n- b"),
    ],
)
def test_visibility_lists_and_spans(html, text):
    assert text_of(html) == text


def test_wide_cells_line_up():
    for size in (59, 70, 3_000):
        got = text_of(f"<table><tr><td>{'x' * size}<td>a<tr><td>y<td>b</table>").split("\n")
        assert got == ["x" * size + "  a", "y".ljust(size) + "  b"]


def test_padding_that_would_dwarf_the_text_becomes_tabs():
    html = "<table><tr><td>" + "x" * 50_000 + "<td>a" + "<tr><td>y<td>b" * 1_000 + "</table>"
    assert text_of(html) == "x" * 50_000 + "\ta" + "\ny\tb" * 1_000


@pytest.mark.parametrize("deep", [100, 255, 256, 300, 500, 5_000])
def test_hidden_text_stays_hidden_at_any_depth(deep):
    assert text_of("<div>" * deep + "a<span hidden>n</span><i style='visibility:hidden'>n<b style='visibility:visible'>b</b></i>c") == "abc"
    assert text_of("<div>" * deep + "<div style='display:none'>" + "<p>n<div>" * 50 + "n" + "</div>" * 50 + "</div>y") == "y"
    assert text_of("<b>" * deep + "a<div>b</div>c<br>d" + "</b>" * deep + "e") == "a\nb\nc\nde"


def _random_page(rng, words, depth=0, shown=True, gone=False):
    """Markup of a random tree; words gets those of its words that are visible, by the tree itself."""
    out = []
    for _ in range(rng.randint(1, 4)):
        kind = rng.choice("text text inline block list table details".split()) if depth < 6 else "text"
        if kind == "text":
            word = f"w{rng.randrange(10**9)}"
            out.append(f" {word} ")
            if shown and not gone:
                words.append(word)
            continue
        how = rng.choice(["", "", "", "hidden", "none", "unseen", "seen"])
        mark = {"": "", "hidden": " HIDDEN", "none": ' style="color:red; DISPLAY:none"', "unseen": " style='Visibility: Hidden'", "seen": " style=visibility:visible"}[how]
        own = {"unseen": False, "seen": True}.get(how, shown)
        lost = gone or how in ("hidden", "none")
        inside = lambda s=own, g=lost: _random_page(rng, words, depth + 1, s, g)
        if kind == "inline":
            tag = rng.choice(["b", "span", "a", "em"])
            out.append(f"<{tag}{mark}>{inside()}</{tag}>")
        elif kind == "block":
            tag = rng.choice(["div", "section", "blockquote", "article"])
            out.append(f"<{tag}{mark}>{inside()}</{tag}>")
        elif kind == "list":
            end = rng.choice(["", "</li>"])
            out.append(f"<ul{mark}>" + "".join(f"<li>{inside()}{end}" for _ in range(rng.randint(1, 3))) + "</ul>")
        elif kind == "table":
            rows = "".join("<tr>" + "".join(f"<td>{inside()}" for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(1, 3)))
            out.append(f"<table{mark}>{rows}</table>")
        else:
            open_ = rng.random() < 0.5
            summary = f"<summary>{inside()}</summary>"
            out.append(f"<details{' open' if open_ else ''}{mark}>{summary}{inside(own, lost or not open_)}</details>")
    return "".join(out)


def test_random_pages_show_just_the_visible_words():
    rng = random.Random(5)
    for _ in range(250):
        words = []
        html = _random_page(rng, words)
        got = text_of(html).replace("- ", " ").split()
        assert sorted(got) == sorted(words), html
        if "<table" not in html:
            assert got == words, html


def test_random_tables_by_a_matrix():
    """Each cell's column by marking every field that cells take, one by one."""
    rng = random.Random(6)
    for _ in range(300):
        html, taken, texts, n_rows = "<table>", set(), {}, rng.randint(1, 6)
        for r in range(n_rows):
            html += "<tr>"
            column = 0
            for _ in range(rng.randint(0, 4)):
                while (r, column) in taken:
                    column += 1
                wide, high, text = rng.randint(1, 3), rng.randint(1, 3), "x" * rng.randint(1, 90)
                html += f"<td colspan={wide} rowspan={high}>{text}"
                texts[r, column] = text
                taken |= {(i, j) for i in range(r, min(n_rows, r + high)) for j in range(column, column + wide)}
                column += wide
        used = sorted({c for _, c in texts})
        at, starts = 0, {}
        for c in used:
            starts[c] = at
            at += max(len(t) for (_, k), t in texts.items() if k == c) + 2
        lines = []
        for r in range(n_rows):
            line = ""
            for c in used:
                if (r, c) in texts:
                    line = line.ljust(starts[c]) + texts[r, c]
            if line:
                lines.append(line)
        assert text_of(html + "</table>") == "\n".join(lines).strip("\n"), html
