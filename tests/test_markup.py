"""HTML by structure, against pages whose text is known and against the standard library's parser."""

import random
import re
import time
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from gleanery.functions import markup, text
from gleanery.sources import pages

WORDS = ["plain", "a &amp; b", "1 &lt;", "caf\u00e9", "x &gt; y", "&nbsp;", "tail", "5 > 4"]
ATTRIBUTES = ["", ' class="x"', " title='a > b'", ' title="</main>"', " data-x=1", ' hidden checked', " alt='say \"hi\"'"]
VISIBLE = ["div", "p", "b", "section", "span", "ul"]
HIDDEN = ["aside", "nav", "form", "svg", "footer", "header", "noscript"]


def fragment(rnd, depth, seen):
    """(markup, words that show)"""
    parts, shown = [], []
    for _ in range(rnd.randint(1, 4)):
        kind = rnd.random()
        if depth == 0 or kind < 0.4:
            word = f"w{rnd.randrange(1000)}"
            parts.append(word + " ")
            shown += [word] if seen else []
        elif kind < 0.7:
            name = rnd.choice(VISIBLE)
            inner, words = fragment(rnd, depth - 1, seen)
            parts.append(f"<{name}{rnd.choice(ATTRIBUTES)}>{inner}</{name}>")
            shown += words
        elif kind < 0.9:
            name = rnd.choice(HIDDEN)
            inner, _ = fragment(rnd, depth - 1, False)
            parts.append(f"<{name}{rnd.choice(ATTRIBUTES)}>{inner}</{name.upper()} >")
        else:
            parts.append(rnd.choice(["<!-- <main> > no </main> -->", "<script>if (a < b) { x = '</p>' }</script>", "<style>p > b { }</style>", "<br>", "<br/>", "<!doctype x>"]))
    return "".join(parts), shown


@pytest.mark.parametrize("seed", range(40))
def test_pages_whose_text_is_known(seed):
    rnd = random.Random(seed)
    before, _ = fragment(rnd, 3, False)
    inside, shown = fragment(rnd, 5, True)
    root = rnd.choice(["main", "article"])
    nested = f"<{root}>deep</{root}>" if rnd.random() < 0.5 else ""
    page = f"<html><body>{before}<{root} class='>'>{inside} {nested} <i>end</i></{root}>after<{root}>second</{root}></body></html>"
    want = [*shown, *(["deep"] if nested else []), "end"]
    assert re.findall(r"\w+", markup.plain(markup.main_markup(page))) == want


class Reader(HTMLParser):
    def __init__(self):
        super().__init__()
        self.out, self.skip = [], 0

    def handle_starttag(self, tag, attrs):
        self.skip += tag in markup.UNSEEN
        self.out += [] if self.skip else ["\n- "] if tag == "li" else ["\n"] if tag in markup.BLOCKS else []

    def handle_startendtag(self, tag, attrs):
        self.out += [] if self.skip else ["\n"] if tag in markup.BLOCKS else []

    def handle_endtag(self, tag):
        self.out += [] if self.skip else ["\n"] if tag in markup.BLOCKS else []
        self.skip -= tag in markup.UNSEEN

    def handle_data(self, data):
        self.out += [] if self.skip else [data]


@pytest.mark.parametrize("seed", range(40))
def test_fragments_as_the_standard_parser_reads_them(seed):
    rnd = random.Random(seed)
    parts = []
    for _ in range(rnd.randint(1, 30)):
        name = rnd.choice(["p", "li", "div", "b", "h2", "br", "td"])
        parts.append(rnd.choice([rnd.choice(WORDS), f"<{name}{rnd.choice(ATTRIBUTES)}>", f"</{name}>", "<!-- a > b -->", "<script>x < y </script>", "<svg><b>no</b></svg>"]))
    page = "".join(parts).replace("&lt;", "&#60;")
    reader = Reader()
    reader.feed(page)
    reader.close()
    squeeze = lambda s: re.sub(r"[ \xa0]+", " ", s)
    assert squeeze(markup.plain(page)) == squeeze("".join(reader.out) if "<" in page else page)


def test_columns(spark):
    page = '<body><nav>Menu <nav>more</nav> rest</nav><main title="a > b"><p>One</p>\n\n<ul><li>x<li>y</ul></main><main>two</main><a href="/u?a=1&amp;b=2">l</a><!-- <a href=no> --></body>'
    df = spark.createDataFrame([(1, page), (2, None), (3, ""), (4, "no markup &amp; so"), (5, "&lt;p&gt;twice&lt;/p&gt; escaped")], "id int, html string")
    got = df.select("id", text.html_to_text(F.col("html")).alias("t"), pages.main_text(F.col("html")).alias("m"), markup.hrefs(F.col("html")).alias("h"), text.html_to_texts(F.array("html", F.lit("<b>k</b>"))).alias("e")).orderBy("id").collect()
    assert got[0].m == "One\n\n- x\n\n- y" or got[0].m.split() == ["One", "-", "x", "-", "y"]
    assert got[0].h == ["/u?a=1&b=2"] and got[0].e[1] == "k"
    assert [(r.t, r.m, r.h) for r in got[1:3]] == [("", "", [])] * 2
    assert (got[3].t, got[4].t) == ("no markup & so", "twice\nescaped")


def test_long_and_broken_markup_takes_linear_time():
    began = time.time()
    for bad in ("<a " * 100_000, '<a x="' * 50_000, "<" * 300_000, "<aside>" * 50_000, "<!--" * 80_000, "<a 'b' " * 50_000 + ">", "</p" * 100_000, "&" * 300_000):
        markup.plain(bad)
        markup.main_markup(bad)
    assert time.time() - began < 20


def test_rows_go_to_python_in_small_batches(spark):
    df = spark.createDataFrame([("<main>a<p>b</main>", ["<b>x</b>", None]), (None, None)], "html string, parts array<string>")
    each = {"lines": markup.lines("html"), "main": markup.main_lines("html"), "hrefs": markup.hrefs("html"), "parts": markup.lines_each("parts")}
    for name, column in each.items():
        plan = df.select(column.alias(name))._jdf.queryExecution().executedPlan().toString()
        assert "BatchEvalPython" in plan and "ArrowEvalPython" not in plan
    rows = df.select(*[c.alias(n) for n, c in each.items()]).collect()
    assert [tuple(r) for r in rows] == [("a\nb", "a\nb", [], ["x", ""]), ("", "", [], None)]
