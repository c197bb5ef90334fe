import pytest
from pyspark.sql import functions as F

from gleanery.functions import classify, dates, money, text, urls

col = F.col


def apply(spark, values, expression, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.out for r in df.select("i", expression(col("v")).alias("out")).orderBy("i").collect()]


def test_fold_is_nfkd(spark):
    import unicodedata

    values = [None, "", "Café Ñandú", "ﬁne ½ ™ №", "ＡＢＣ", "naïve—x", "中文 abc", "Ǆ ĳ ª", "ẞß", "İstanbul"] + ["".join(chr(p) for p in range(a, a + 64)) for a in range(0xA0, 0x250, 64)]
    want = [unicodedata.normalize("NFKD", v or "").encode("ascii", "ignore").decode().lower() for v in values]
    assert apply(spark, values, text.fold) == want


def test_clean_and_html(spark):
    assert apply(spark, [" a \t b\r\n\n\n\n c ", None], text.clean) == ["a b\n\nc", ""]
    html = ["<p>Hello <b>you</b></p><ul><li>one</li><li>two</li></ul><script>x</script>", "&lt;p&gt;x &amp;amp; y&lt;/p&gt;", "plain &amp; simple", None]
    assert apply(spark, html, text.html_to_text) == ["Hello you\n\n- one\n\n- two", "x & y", "plain & simple", ""]


def test_terms(spark):
    assert apply(spark, ["i trust c++ and .net", "rust", "no"], lambda c: text.first_term(c, ["rust", ".net", "c++"])) == [".net", "rust", None]
    assert apply(spark, ["react react native", ""], lambda c: text.hits(c, ["react native", "react", "vue"])) == [["react native", "react"], []]


def test_forms(spark):
    assert apply(spark, ["Acme Pvt. Ltd.", "The Co Company Inc", "Ltd", None, "Globex GmbH & Co"], lambda c: text.company_form(text.fold(c))) == ["acme", "the", "", "", "globex"]
    titles = ["Sr. Front-End Dev (m/f/d) [Remote]", "React.js Engineer - Fully Remote", "C++ / C# Engr", "Jr Full Stack"]
    assert apply(spark, titles, lambda c: text.title_form(text.fold(c))) == ["senior frontend developer", "react engineer", "c++ c# engineer", "junior fullstack"]
    assert apply(spark, ["Senior Développeur!", "###", None], lambda c: text.slug(text.fold(c))) == ["senior-developpeur", "unknown", "unknown"]


def brute_similarity(a, b):
    x, y = " ".join(sorted(a.split())), " ".join(sorted(b.split()))
    table = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i, c in enumerate(x):
        for j, d in enumerate(y):
            table[i + 1][j + 1] = table[i][j] + 1 if c == d else max(table[i][j + 1], table[i + 1][j])
    return 100.0 if not x and not y else 200 * table[-1][-1] / (len(x) + len(y))


def test_title_similarity(spark):
    from gleanery.operators.dedup import similarity

    names = ["frontend developer", "developer frontend", "senior react engineer", "react engineer", "", "qa", "frontend developers", "backend developer"]
    pairs = [(a, b) for a in names for b in names]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string")
    got = df.select("i", text.title_similarity(col("a"), col("b")).alias("s"), text.similar(col("a"), col("b"), 88).alias("near")).orderBy("i").collect()
    for r, (a, b) in zip(got, pairs):
        want = brute_similarity(a, b)
        assert abs(r.s - want) < 1e-9 and bool(r.near) == (want >= 88) and abs(similarity(a, b) - want) < 1e-9, (a, b)


def test_urls(spark):
    values = ["http://WWW.Example.com:80//a//b/?utm_source=x&b=2&a=1&ref=q&c=#f", "https://u:p@x.co.uk:8443/", "not a url", None]
    assert apply(spark, values, urls.canonical)[:2] == ["https://example.com/a/b?a=1&b=2", "https://x.co.uk:8443/"]
    assert apply(spark, values, urls.host) == ["example.com", "x.co.uk", "", ""]
    assert apply(spark, ["https://a.b.co.uk/x", "jobs.acme.io", "x.de", "", "https://www.example.com"], urls.registrable) == ["b.co.uk", "acme.io", "x.de", "", "example.com"]
    assert apply(spark, ["a.linkedin.com", "x.com", "notx.com"], lambda c: urls.on_domains(c, ["linkedin.com", "x.com"])) == [True, True, False]


@pytest.mark.parametrize(
    ("url", "want"),
    [
        ("https://boards.greenhouse.io/gitlab/jobs/1", ("greenhouse", "gitlab")),
        ("https://job-boards.eu.greenhouse.io/acme", ("greenhouse", "acme")),
        ("https://boards.greenhouse.io/embed/job_board?for=acme&x=1", ("greenhouse", "acme")),
        ("https://jobs.lever.co/team/abc", ("lever", "team")),
        ("https://acme.recruitee.com/o/dev", ("recruitee", "acme")),
        ("https://apply.workable.com/api/v1", None),
        ("https://example.com/jobs", None),
        ("https://jobs.lever.co/", None),
    ],
)
def test_boards(spark, url, want):
    (got,) = apply(spark, [url], urls.board)
    assert (tuple(got) if got else None) == want


def test_dates(spark):
    values = ["1767322445", "1767322445000", "2026-01-02T03:04:05Z", "2026-01-02T03:04:05.5+02:00", "2026-01-02", "2026-01-02 03:04:05", "Fri, 02 Jan 2026 03:04:05 GMT", "2 Jan 2026", "January 2, 2026", "Jan 2, 2026", "soon", "", "0", None]
    got = [str(x) if x else None for x in apply(spark, values, dates.parsed)]
    assert got == ["2026-01-02 02:54:05", "2026-01-02 02:54:05", "2026-01-02 03:04:05", "2026-01-02 01:04:05.500000", "2026-01-02 00:00:00", "2026-01-02 03:04:05", "2026-01-02 03:04:05", "2026-01-02 00:00:00", "2026-01-02 00:00:00", "2026-01-02 00:00:00", None, None, None, None]


def test_staleness(spark):
    df = spark.createDataFrame([("2026-04-01", None), (None, "2026-05-01"), ("2026-05-20", "2026-07-01"), ("2026-05-02", None)], "p string, e string")
    now = F.lit("2026-06-01").cast("timestamp")
    got = [r[0] for r in df.select(dates.staleness(col("p").cast("timestamp"), col("e").cast("timestamp"), now, 30)).collect()]
    assert got == ["Posted 61 days ago (limit 30)", "Posting expired on 2026-05-01", None, None]


def test_salary(spark):
    values = ["$80k-100k", "NPR 50,000 to 70,000 per month", "€25/hr", "Rs 900000", "£0", "none", "USD 3000", "US$ 150", "Pay: INR 5 lakh", None]
    got = [tuple(x) if x else None for x in apply(spark, values, money.salary)]
    assert got == [(80000.0, 100000.0, "USD", "year"), (50000.0, 70000.0, "NPR", "month"), (25.0, None, "EUR", "hour"), (900000.0, None, "NPR", "year"), None, None, (3000.0, None, "USD", "month"), (150.0, None, "USD", "hour"), (5.0, None, "INR", "hour"), None]
    df = spark.createDataFrame([(60000.0, "usd", "year"), (10.0, "XXX", "year"), (1.0, "NPR", None), (None, "USD", "month"), (2.0, "USD", "fortnight")], "a double, c string, p string")
    fx = {"USD": 140.0, "NPR": 1.0}
    assert [r[0] for r in df.select(money.monthly(col("a"), col("c"), col("p"), fx)).collect()] == [700000.0, None, 0.0, None, None]


def test_classes(spark):
    assert apply(spark, ["Hybrid remote", "work from home", "On-site", "in-office", "", None], lambda c: classify.work_mode(text.fold(c))) == ["hybrid", "remote", "onsite", "onsite", "unknown", "unknown"]
    assert apply(spark, ["International", "part_time contract", "Consultant", "temp", "Permanent", "x", None], lambda c: classify.employment(text.fold(c))) == ["internship", "part_time", "contract", "temporary", "full_time", "unspecified", "unspecified"]


def test_folding_of_all_characters(spark):
    import sys
    import unicodedata

    chars = [chr(p) for p in range(1, sys.maxunicode + 1) if not 0xD800 <= p <= 0xDFFF]
    texts = ["|".join(chars[i : i + 20_000]) for i in range(0, len(chars), 20_000)]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", text.fold(F.col("t")).alias("f")).collect()
    for r in got:
        assert r.f == unicodedata.normalize("NFKD", texts[r.i]).encode("ascii", "ignore").decode().lower()


def test_unescape_is_that_of_html(spark):
    import html

    texts = [f"a{'&' + n} b" for n in html.entities.html5] + [f"&#{n};x" for n in [*range(0, 700), 8217, 0x1F600, 0xD800, 0x10FFFF, 0x110000, 10**15]]
    texts += [f"&#x{n:X};" for n in range(0, 300)] + ["&", "&&amp;", "&amp;lt;", "&unknown; &notit; &ampx &rsquo;&#8217;&eacute;&#x27;", "&#;", "&#x;", "&#65", "&copy2", "no", "a && b", "&lt"]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", text.unescape(F.col("t")).alias("u")).collect()
    wrong = [(texts[r.i], r.u, html.unescape(texts[r.i])) for r in got if r.u != html.unescape(texts[r.i])]
    assert not wrong, wrong[:10]


def test_terms_in_one_scan_are_those_of_single_scans(spark):
    import random
    import re

    rng = random.Random(4)
    terms = ["react", "react native", "c++", ".net", "asp.net", "it support", "support engineer", "qa", "java", "javascript", "full stack", "full", "c#", "node js"]
    texts = ["".join(rng.choice([*terms, " ", "-", "x", ", "]) for _ in range(rng.randrange(1, 9))) for _ in range(400)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for r in df.select("i", text.first_term(F.col("t"), terms).alias("first"), text.hits(F.col("t"), terms).alias("all")).collect():
        want = [t for t in terms if re.search(rf"(?<![a-z0-9]){re.escape(t)}(?![a-z0-9])", texts[r.i])]
        assert r["all"] == want and r["first"] == (want[0] if want else None), texts[r.i]
