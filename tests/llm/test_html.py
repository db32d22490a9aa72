import time
from collections import Counter
from html.parser import HTMLParser

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from graphloom.llm import html, queries
from graphloom.llm.common import table

CASES = {
    "": "",
    "a  b\n c": "a b c",
    "<p>one<p>two": "one\n\ntwo",
    "<div>a</div><div>b</div>c": "a\nb\nc",
    "a<br>b<br><br>c": "a\nb\n\nc",
    "<ul><li>a<li>b<ol start=3><li>c<li>d</ol><li>e</ul>f": "- a\n- b\n  3. c\n  4. d\n- e\n\nf",
    "<table><tr><th>Name<th>Qty<tr><td>apple<td>10<tr><td colspan=2>kiwi</table>": "Name   Qty\napple  10\nkiwi",
    "<table><td>a<table><td>b</table><td>c</table>": "a  c\nb",
    "<head><title>t</title></head>x<script>1<2</script><style>p{}</style>y": "xy",
    "<style>.ad, #x {display : none}</style><p class='big ad'>no<p id=x>no<p>yes": "yes",
    "<div hidden>no</div><div style='display:none'>no</div><div style='visibility:hidden'>no<b style='visibility:visible'>yes</b></div>": "yes",
    "<pre>a\n  b\n\nc</pre>d": "a\n  b\n\nc\n\nd",
    "x &lt; y &amp; &eacute;&#33;": "x < y & é!",
    "1 < 2 <3": "1 < 2 <3",
    "a<!-- b -->c<!doctype x>d<?php e ?>f": "acdf",
    "<b>bold</b> and<i> it</i>": "bold and it",
    "<blockquote>q<p>r</blockquote>s": "  q\n\n  r\n\ns",
    "<dl><dt>t<dd>d</dl>": "t\n  d",
    "</p></div>x</table>": "x",
    "<style>@media print{ .a{display:none} } b{color:red}</style><i class=a>shown </i><b>yes</b>": "shown yes",
    "<p>a<div>b</p>c": "a\n\nb\n\nc",
    "<textarea>a &amp; <b></textarea>": "a & <b>",
    "a<a href='x>y'>b</a>": "ab",
    "a<unclosed": "a",
    "<select><option>a<option>b</select>c": "a c",
    "<select><optgroup label=x><option>a<option selected>b</optgroup></select>c": "b c",
    "<select multiple><option>a<option>b</select>": "a b",
    "<input type=submit><input type=submit value=Go><input type=hidden value=x><input value='some words'><input type=reset>": "Submit Go some words Reset",
    "<math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>tex</annotation></math> <svg><title>t</title><desc>d</desc><text>label</text></svg> <object>fallback</object>": "x=2 label fallback",
    "<details><summary>more</summary>hidden part</details><details open><summary>less</summary>shown</details>": "more\nless\nshown",
    "<style>div.ad, p#x.y, *.z {display:none}</style><div class=ad>no</div><div class=b>yes</div><p class=ad>also</p><p id=x>too</p><p id=x class='w y'>no</p><i class=z>no</i>": "yes\n\nalso\n\ntoo",
    "<style>@media screen { .a{display:none} } @media not print { .b{display:none} } @supports (x:y) { .c { visibility:hidden } } /* .d{display:none} */</style><i class=a>1</i><i class=b>2</i><i class=c>3</i><i class=d>4</i>": "4",
    f'<div data-x="{"y" * 5000} > leaked words">text</div>': "text",
    "<div title='never closed>a</div> <p title=\"b\">c</p>": "a\n\nc",
    "<table><tr><td rowspan=2>a<td>b<tr><td>c<tr><td>d<td>e</table>": "a  b\n   c\nd  e",
    f"<table><tr><td>{'wide ' * 12}<td>x<tr><td>narrow<td>y</table>": f"{('wide ' * 12).strip()}  x\nnarrow{' ' * 53}  y",
    f"<table><tr><td>{'wide ' * 20}<td>x<tr><td>narrow<td>y</table>": f"{('wide ' * 16).strip()}  x\nwide wide wide wide\nnarrow{' ' * 73}  y",
    "<table><tr><td><p>one<p>two<ul><li>three</ul><td>side</table>": "one      side\ntwo\n- three",
}


@pytest.mark.parametrize("source", CASES)
def test_cases(source):
    assert html.render(source) == CASES[source]


@settings(deadline=None, max_examples=300)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<table>", "<tr>", "<td>", "</table>", "<ul>", "<li>", "</ul>", "<b>", "</b>", "<div>", "</div>", "<br>", "word", " ", "<", ">", "&amp;", "<!--", "-->", "<pre>", "</pre>", "\n", "<ol>", "</li>", "<dd>"]), max_size=60))
def test_any_tags_and_no_lost_words(parts):
    source = "".join(parts)
    out = html.render(source)
    if "<!--" not in source and "<" not in parts:
        assert out.count("word") == source.count("word")


@pytest.mark.parametrize("unit", ["<div>", "<p><table>", "<ul><li>", "<b>", "<", "<a b='", "<a '>' ", "<!--", "</p>", "<td>", "<table><tr><td>", "<style>"])
def test_time_is_linear(unit):
    start = time.time()
    html.render(unit * 20_000)
    assert time.time() - start < 20


class Words(HTMLParser):
    """The visible words of pages without hidden elements but script, style and title, and the number of list markers of
    each kind."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.words, self.off, self.lists, self.marks = [], 0, [], Counter()

    def handle_starttag(self, tag, attrs):
        self.off += tag in ("script", "style", "title")
        self.words.append(" ") if tag in html.BLOCK or tag == "br" else None
        if tag in ("ul", "ol"):
            self.lists.append([tag, int(dict(attrs).get("start") or 1)])
        if tag == "li":
            ordered = self.lists and self.lists[-1][0] == "ol"
            self.marks[f"{self.lists[-1][1]}." if ordered else "-"] += 1
            if ordered:
                self.lists[-1][1] += 1

    def handle_endtag(self, tag):
        self.off -= tag in ("script", "style", "title")
        self.words.append(" ") if tag in html.BLOCK else None
        if tag in ("ul", "ol") and self.lists:
            self.lists.pop()

    def handle_data(self, data):
        if not self.off:
            self.words.append(data)


def test_query_against_a_plain_parser(spark, sf):
    """All words, figures included, and the markers of lists; and the words in their order."""
    rows = {r["page_id"]: r["text"] for r in queries.op8_html(spark, sf).collect()}
    pages = table(spark, sf, "pages").collect()
    assert len(rows) == len(pages)
    for r in pages:
        p = Words()
        p.feed(r["html"])
        p.close()
        want, got = "".join(p.words).split(), rows[r["page_id"]].split()
        assert Counter(got) == Counter(want) + p.marks, r["page_id"]
        marks = set(p.marks)
        assert [w for w in got if w not in marks] == [w for w in want if w not in marks], r["page_id"]


def test_tables_are_aligned(spark, sf):
    """Cells of a column begin at one place."""
    made = html.render("<table>" + "".join(f"<tr><td>{'x' * (k * 7 % 60)}a<td>b{k}<td>{k * k}</tr>" for k in range(40)) + "</table>").split("\n")
    assert len(made) == 40 and len({line.index("b") for line in made}) == 1


def test_odd_pages(spark):
    df = spark.createDataFrame([(1, None, "x"), (None, "", None), (2, "<p>a" * 20_000, "y"), (2, "<p>a" * 20_000, "y")], "page_id long, html string, text string")
    out = html.extract(df)
    assert out.columns == ["page_id", "text"]
    assert sorted((str(r["page_id"]), len(r["text"])) for r in out.collect()) == [("1", 0), ("2", 59_998), ("2", 59_998), ("None", 0)]
    assert html.extract(df.limit(0)).count() == 0
    clash = df.withColumnRenamed("text", "__html").withColumn("start", F.lit(1))
    assert html.extract(clash).columns == ["page_id", "__html", "start", "text"] and html.extract(clash).count() == 4
