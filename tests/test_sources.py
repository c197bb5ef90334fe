import json

from gleanery.sources import feeds, pages

SCHEMA = "source string, url string, params string, fetched_at timestamp_ntz, body string"


def rows(spark, source, body, params=None):
    body = body if isinstance(body, str) else json.dumps(body)
    df = spark.createDataFrame([(source, "u", json.dumps(params or {}), None, body), (source, "v", "{}", None, "not json {"), (source, "w", "{}", None, None)], SCHEMA)
    return feeds.postings(df, [source]).collect()


def test_greenhouse(spark):
    (r,) = rows(spark, "greenhouse", {"jobs": [{"id": 7, "title": " Dev ", "absolute_url": "https://x/7", "location": {"name": "Remote"}, "content": "&lt;p&gt;Hi &amp;amp; bye&lt;/p&gt;", "updated_at": "2026-01-02T03:04:05Z"}, {"id": 8}]}, {"slug": "big-corp"})
    assert (r.source_external_id, r.title, r.company_name, r.remote_type, r.description) == ("big-corp:7", "Dev", "Big Corp", "remote", "Hi & bye")
    assert str(r.posted_at) == "2026-01-02 03:04:05" and r.employment_type == "unspecified"


def test_lever(spark):
    (r,) = rows(spark, "lever", [{"id": "a", "text": "Dev", "hostedUrl": "https://l/a", "categories": {"location": "Berlin", "commitment": "Full-time"}, "workplaceType": "On-site", "descriptionPlain": "One", "lists": [{"text": "Do", "content": "<li>x</li><li>y</li>"}], "additionalPlain": "End", "createdAt": 1767322445000, "salaryRange": {"min": 1, "max": 2, "currency": "EUR", "interval": "per-hour"}}], {"slug": "team"})
    assert (r.remote_type, r.employment_type, r.salary_period, r.description) == ("onsite", "full_time", "hour", "One\n\nDo\n- x\n\n- y\n\nEnd")
    assert str(r.posted_at) == "2026-01-02 02:54:05"


def test_ashby(spark):
    got = rows(spark, "ashby", {"jobs": [{"id": "1", "title": "Dev", "jobUrl": "https://a/1", "location": "Paris", "secondaryLocations": [{"location": "Lyon"}], "isRemote": True, "employmentType": "Intern", "descriptionPlain": "d", "compensation": {"compensationTierSummary": "$1"}}, {"id": "2", "jobUrl": "u", "isListed": False}]}, {"slug": "s"})
    assert [(r.location_text, r.remote_type, r.employment_type, r.salary_text) for r in got] == [("Paris, Lyon", "remote", "internship", "$1")]


def test_remotive_and_remoteok(spark):
    (r,) = rows(spark, "remotive", {"jobs": [{"id": 1, "url": "u", "title": "T", "company_name": "C", "job_type": "contract", "candidate_required_location": "USA, Remote; Asia", "salary": "", "description": "<p>d</p>"}, {"id": 2, "title": "no url"}]})
    assert (r.location_restrictions, r.salary_text, r.employment_type, r.remote_type) == (["USA", "Asia"], None, "contract", "remote")
    got = rows(spark, "remoteok", [{"legal": "x"}, {"id": 5, "position": "P", "url": "u", "location": "Worldwide", "salary_min": 0, "salary_max": 90000, "epoch": 1767322445}])
    assert [(r.location_restrictions, r.salary_min, r.salary_max, r.salary_currency, r.salary_period) for r in got] == [(["Worldwide"], None, 90000.0, "USD", "year")]


def test_first_seen_id_wins(spark):
    body = {"jobs": [{"id": 1, "url": "first", "jobTitle": "A"}, {"id": 1, "url": "second", "jobTitle": "A"}, {"id": 2, "url": "b", "jobTitle": "B"}]}
    assert sorted(r.source_url for r in rows(spark, "jobicy", body)) == ["b", "first"]


def test_himalayas_and_muse(spark):
    (r,) = rows(spark, "himalayas", {"jobs": [{"title": "T", "guid": "g", "applicationLink": "a", "locationRestrictions": ["Nepal", {"name": "India"}], "pubDate": 1767322445, "seniority": ["Senior", "Lead"]}]})
    assert (r.location_text, r.location_restrictions, r.seniority_hint, r.source_url, r.apply_url) == ("Nepal, India", ["Nepal", "India"], "Senior, Lead", "g", "a")
    body = {"results": [{"id": 1, "name": "N", "locations": [{"name": "Flexible / Remote"}], "levels": [{"name": "Entry"}], "refs": {"landing_page": "l"}}, {"id": 2, "name": "no landing"}]}
    (r,) = rows(spark, "themuse", body)
    assert (r.remote_type, r.location_restrictions, r.seniority_hint) == ("remote", [], "Entry")


def test_other_feeds(spark):
    (r,) = rows(spark, "workingnomads", [{"url": "u", "title": "T", "location": "Anywhere", "tags": "a, b"}])
    assert (r.tags, r.location_restrictions) == (["a", "b"], [])
    assert [r.title for r in rows(spark, "arbeitnow", {"data": [{"slug": "s", "url": "u", "title": "T", "remote": True, "job_types": ["Part time"]}, {"url": "v", "remote": False}]})] == ["T"]
    (r,) = rows(spark, "findwork", {"results": [{"id": 3, "url": "u", "role": "R", "remote": True, "keywords": ["k"]}]})
    assert (r.location_text, r.remote_type, r.tags) == ("Remote", "remote", ["k"])
    (r,) = rows(spark, "smartrecruiters", {"content": [{"id": "9", "name": "N", "location": {"city": "X", "country": "de", "remote": True}, "experienceLevel": {"label": "Mid"}}]}, {"slug": "co"})
    assert (r.location_text, r.location_restrictions, r.description, r.description_quality) == ("X, DE", ["DE"], "N\nMid", "partial")
    (r,) = rows(spark, "recruitee", {"offers": [{"id": 1, "careers_url": "u", "title": "T", "salary": {"min": "x", "max": "20", "period": "Monthly"}}]}, {"slug": "co"})
    assert (r.salary_min, r.salary_max, r.salary_period) == (None, 20.0, "month")
    (r,) = rows(spark, "workable", {"name": "Co", "jobs": [{"shortcode": "s", "url": "u", "title": "T", "telecommuting": True, "city": "A", "country": "B"}]}, {"slug": "co"})
    assert (r.company_name, r.location_text, r.description_quality) == ("Co", "A, B", "partial")


def test_rss(spark):
    body = "<rss><channel><item><title>Acme: Lead: Dev</title><region>Europe Only</region><type>Full-Time</type><link>https://w/1</link><pubDate>Mon, 05 Jan 2026 10:00:00 +0000</pubDate><description>&lt;p&gt;x&lt;/p&gt;</description></item><item><title>Solo</title><region>Anywhere in the World</region><link>https://w/2</link></item></channel></rss>"
    got = sorted(rows(spark, "weworkremotely", body), key=lambda r: r.source_url)
    assert [(r.company_name, r.title, r.location_restrictions) for r in got] == [("Acme", "Lead: Dev", ["Europe"]), (None, "Solo", [])]
    assert str(got[0].posted_at) == "2026-01-05 10:00:00" and got[0].description == "x"


def test_thread(spark):
    body = {"children": [{"id": 1, "author": "a", "text": "Acme | React Engineer | Remote (EU) | Full-time<p>More"}, {"id": 2, "text": "Onsite only, React"}, {"id": 3, "text": "Remote plumber"}]}
    (r,) = rows(spark, "hackernews", body)
    assert (r.company_name, r.title, r.location_text, r.remote_type, r.employment_type) == ("Acme", "React Engineer", "Remote (EU)", "remote", "full_time")


PAGE = """<html><head><script type="application/ld+json">{"@graph":[{"@type":["JobPosting","Thing"],"title":"Dev","description":"&lt;b&gt;Join&lt;/b&gt;","hiringOrganization":{"name":"Acme","sameAs":["https://acme.io"]},
"jobLocation":[{"address":{"addressLocality":"Kathmandu","addressCountry":{"name":"Nepal"}}}],"employmentType":["FULL_TIME"],"baseSalary":{"currency":"NPR","value":{"minValue":10,"maxValue":"20","unitText":"MONTH"}},"datePosted":"2026-01-05"}]}</script>
<script type="application/ld+json">{broken</script></head><body><a href="https://jobs.lever.co/acme/1">x</a><a href='https://jobs.lever.co/acme/2'>y</a></body></html>"""


def test_pages(spark):
    long = "<body><nav>skip</nav><main>" + "Responsibilities and requirements of the role. " * 20 + "</main></body>"
    df = spark.createDataFrame([("https://x/1", PAGE), ("https://x/2", long), ("https://x/3", "<p>short</p>"), ("https://x/4", None)], "url string, html string")
    (r,) = pages.from_jsonld(df).collect()
    assert (r.title, r.description, r.company_name, r.company_website, r.location_text, r.remote_type, r.employment_type) == ("Dev", "Join", "Acme", "https://acme.io", "Kathmandu, Nepal", "onsite", "full_time")
    assert (r.salary_min, r.salary_max, r.salary_period, str(r.posted_at)) == (10.0, 20.0, "month", "2026-01-05 00:00:00")
    assert {r.url[-1]: r.route for r in pages.routed(df).collect()} == {"1": "jsonld", "2": "extract", "3": "skipped", "4": "skipped"}
    assert [tuple(r)[1:] for r in pages.board_links(df).collect()] == [("https://jobs.lever.co/acme/1", "lever", "acme")]
    short = spark.createDataFrame([("http://www.x/2/", "tiny"), ("https://x/9", "own")], "source_url string, description string")
    got = {r.source_url: r.description for r in pages.enriched(short, df).collect()}
    assert got["https://x/9"] == "own" and got["http://www.x/2/"].startswith("Responsibilities")


def test_sitemaps(spark):
    from pyspark.sql import functions as F

    entry = lambda loc, mod: f"<url><loc>https://b/{loc}</loc>{f'<lastmod>{mod}</lastmod>' if mod else ''}</url>"
    dated = "".join([entry("react-developer-1", "2026-05-30"), entry("react-developer-2", "2026-05-31"), entry("nurse-3", "2026-05-31"), entry("senior-react-developer-4", "2026-05-31"), entry("web-developer-5", "2025-01-01")])
    plain = "".join([entry("php-developer-1", ""), entry("qa-2", ""), entry("it-officer-3", "")])
    maps = spark.createDataFrame([("dated", dated), ("plain", plain)], "board string, body string")
    got = pages.board_pages(pages.sitemap_entries(maps), F.lit("2026-06-01").cast("timestamp"), 2).orderBy("board", "rank").collect()
    assert [r.url.rsplit("/", 1)[1] for r in got] == ["react-developer-2", "react-developer-1", "it-officer-3", "qa-2"]
    index = spark.createDataFrame([("b", "<sitemapindex>" + "".join(f"<sitemap><loc>https://b/jobs-{i}.xml</loc></sitemap>" for i in range(5)) + "</sitemapindex>", "jobs-[1-9]")], "board string, body string, pattern string")
    assert [r.loc[-5] for r in pages.child_sitemaps(index).collect()] == ["1", "2", "3"]


def test_search(spark):
    df = spark.createDataFrame([("brave", json.dumps({"web": {"results": [{"url": "a", "title": "t", "description": "<b>d</b>"}, {"title": "no url"}]}})), ("tavily", json.dumps({"results": [{"url": "b", "content": "x" * 600}]})), ("google_cse", json.dumps({"items": [{"link": "c", "snippet": "s"}]}))], "source string, body string")
    got = sorted((r.url, r.via, len(r.snippet)) for r in feeds.search_links(df).collect())
    assert got == [("a", "search:brave", 1), ("b", "search:tavily", 500), ("c", "search:google_cse", 1)]


def test_payloads_of_many_sources_are_read_once(spark):
    """Each reader sees the files of its own source; the values are those of the readers alone."""
    import json

    from pyspark.sql import functions as F

    body = lambda i: json.dumps({"jobs": [{"id": i, "url": f"https://x.example/{i}", "title": f"Developer {i}", "company_name": "Co", "job_type": "contract", "description": "<p>Text</p>"}]})
    rows = [(["remotive", "lever", "findwork", None][i % 4], "u", "{}", None, body(i)) for i in range(40)]
    payloads = spark.createDataFrame(rows, "source string, url string, params string, fetched_at timestamp_ntz, body string")
    together = feeds.postings(payloads)
    each = [feeds.postings(payloads, [s]) for s in ("remotive", "lever", "findwork")]
    alone = each[0].unionByName(each[1]).unionByName(each[2])
    assert sorted(map(str, together.collect())) == sorted(map(str, alone.collect())) and together.count() == 10
    plan = together.groupBy("source").agg(F.count("*"))._jdf.queryExecution().toString()
    assert "Scan ExistingRDD" not in plan and "PartitionFilters" in plan
