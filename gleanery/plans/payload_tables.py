"""Payloads of all feed and board shapes, made of the derived postings in SQL that Spark and DuckDB both read.

One payload for each posting. The record's values come from the posting's columns and whole text (less the
characters that JSON would have to escape); the queries read them back out of the JSON.
"""

from __future__ import annotations

from gleanery.plans.derived import NOW_HOUR, OPPORTUNITIES, TABLES, pick

#: The text without quotes, backslashes, line breaks and markup signs.
TEXT = "translate(coalesce(description, ''), concat(chr(34), chr(92), chr(10), chr(9), chr(13), '<>&'), '        ')"
HTML = f"concat('<p>', {TEXT}, '</p><h2>Tasks &amp; duties</h2><ul><li>First&nbsp;one</li><li>Second</li></ul><script>drop()</script>')"
PLACE = "coalesce(location_text, '')"
COMPANY = "coalesce(company_name, '')"


def js(**fields: str) -> str:
    """An object of strings; a name that ends with _ takes its value as JSON."""
    parts = []
    for name, value in fields.items():
        key = name.rstrip("_")
        parts.append(f"""'"{key}":', {value}""" if name.endswith("_") else f"""'"{key}":"', {value}, '"'""")
    return "concat('{', " + ", ',', ".join(parts) + ", '}')"


def num(x: str) -> str:
    return f"CAST({x} AS STRING)"


def day(x: str) -> str:
    """A date of 2026 from a number."""
    return f"concat('2026-0', {num(f'1 + ({x}) % 5')}, '-1', {num(f'({x}) % 9')})"


def when_(x: str, then: str, other: str = "'null'") -> str:
    return f"CASE WHEN {x} THEN {then} ELSE {other} END"


def url(host: str, path: str = "") -> str:
    return f"concat('https://{host}/{path}', {num('id')})"


KIND = pick("id * 3", ["Full time", "Part-time", "Contract", "Internship", "Freelance", "", "Permanent"])
LOW, HIGH = num("(id * 7) % 5 * 1000"), num("(id * 7) % 5 * 2000 + (id % 2) * 500")
#: source: (record, where the records are in the body)
RECORDS: dict[str, tuple[str, str | None]] = {
    "remotive": (js(id_=num("id"), url=url("remotive.com"), title="title", company_name=COMPANY, job_type=KIND, publication_date=day("id"), candidate_required_location=PLACE, salary="coalesce(pay_text, '')", description=HTML, tags_="'[\"a\",\"b\"]'"), "jobs"),
    "remoteok": (js(id=num("id"), url=when_("id % 11 = 0", "''", url("remoteok.com")), position="title", company=COMPANY, location=pick("id", ["Worldwide", "anywhere", "USA, Canada", "", "Remote", "EU; UK"]), salary_min_=LOW, salary_max_=HIGH, description=HTML, apply_url=when_("id % 3 = 0", url("apply.example.com"), "''"), date=when_("id % 2 = 0", day("id"), "''"), epoch_=num("1700000000 + id * 977"), legal_=when_("id % 13 = 0", "'\"terms\"'"), tags_="'[\"x\"]'"), None),
    "jobicy": (js(id_=num("id - id % 3"), url=when_("id % 17 = 0", "''", url("jobicy.com")), jobTitle="concat('<b>', title, '</b> &amp; co')", companyName=COMPANY, jobGeo=PLACE, jobType=KIND, annualSalaryMin_=LOW, annualSalaryMax_=HIGH, salaryCurrency="'EUR'", jobDescription=when_("id % 2 = 0", HTML, "''"), jobExcerpt=TEXT, pubDate=day("id"), jobLevel=pick("id", ["Senior", "Midweight", "", "Entry"])), "jobs"),
    "himalayas": (js(title=when_("id % 19 = 0", "''", "title"), companyName=COMPANY, applicationLink=when_("id % 2 = 0", url("apply.example.com"), "''"), guid=when_("id % 5 = 0", "''", url("himalayas.app")), locationRestrictions_=pick("id", ['["India","Nepal"]', '[{"name":"Canada"},{"name":""}]', "[]", "null"]), employmentType=KIND, description=HTML, excerpt="'x'", pubDate_=num("1700000000000 + id * 977000"), expiryDate_=num("1760000000 + id * 977"), minSalary_=LOW, maxSalary_=HIGH, currency=pick("id", ["USD", ""]), salaryCurrency="'GBP'", seniority_=pick("id", ['["Senior","Lead"]', "[]", '["Entry"]'])), "jobs"),
    "workingnomads": (js(url=url("workingnomads.com"), title="title", company_name=COMPANY, location=pick("id", ["Anywhere", "Europe, Asia", "", "USA"]), tags=pick("id", ["a, b ,c", "one", ""]), description=HTML, pub_date=day("id")), None),
    "arbeitnow": (js(slug=f"concat('s-', {num('id')})", url=url("arbeitnow.com"), title="title", company_name=COMPANY, location=PLACE, remote_=pick("id", ["true", "false", "true", "null"]), job_types_=pick("id", ['["full time","x"]', "[]", '["Contract"]']), tags_="'[\"t\"]'", description=HTML, created_at_=num("1700000000 + id * 977")), "data"),
    "themuse": (js(id_=num("id - id % 2"), name="title", type=KIND, contents=HTML, publication_date=f"concat({day('id')}, 'T08:00:00Z')", company_=js(name=COMPANY), locations_=pick("id", ['[{"name":"Flexible / Remote"},{"name":"Berlin"}]', '[{"name":"Austin, TX"}]', "[]"]), levels_=pick("id", ['[{"name":"Senior Level"},{"name":"Lead"}]', "[]"]), refs_=js(landing_page=when_("id % 23 = 0", "''", url("themuse.com")))), "results"),
    "findwork": (js(id_=num("id"), url=url("findwork.dev"), role="title", company_name=COMPANY, company_url="coalesce(company_website, '')", location=pick("id", ["Remote", "Berlin, Munich", "", "Paris"]), remote_=pick("id", ["true", "false", "null", "false", "false"]), employment_type=KIND, text=HTML, date_posted=day("id"), keywords_="'[\"k\",\"l\"]'"), "results"),
    "greenhouse": (js(id_=num("id"), title="title", absolute_url=url("boards.greenhouse.io", "acme/jobs/"), location_=js(name=PLACE), content=f"replace(replace(replace({HTML}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')", updated_at=day("id + 1"), first_published=when_("id % 3 = 0", "''", day("id")), company_name=when_("id % 4 = 0", "'Named Co'", "''")), "jobs"),
    "lever": (js(id=num("id"), text="title", hostedUrl=url("jobs.lever.co", "acme/"), applyUrl=when_("id % 3 = 0", "''", url("apply.lever.co")), workplaceType=pick("id", ["remote", "hybrid", "onsite", "unspecified"]), descriptionPlain=when_("id % 4 = 0", "''", TEXT), description=HTML, additionalPlain="'Equal chances.'", lists_="'[{\"text\":\"You do\",\"content\":\"<li>A</li><li>B</li>\"},{\"text\":\"You have\",\"content\":\"C\"}]'", categories_=js(location=when_("id % 2 = 0", PLACE, "''"), allLocations_="'[\"Berlin\",\"Kathmandu\"]'", commitment=KIND), salaryRange_=when_("id % 3 = 1", f"concat('{{\"min\":', {LOW}, ',\"max\":', {HIGH}, ',\"currency\":\"USD\",\"interval\":\"', {pick('id * 5', ['per-hour-wage', 'per-month-salary', 'per-year-salary'])}, '\"}}')"), createdAt_=num("1700000000000 + id * 977000")), None),
    "ashby": (js(id=when_("id % 4 = 0", "''", num("id")), title="title", jobUrl=url("jobs.ashbyhq.com", "acme/"), applyUrl=when_("id % 3 = 0", "''", url("apply.ashbyhq.com")), location=PLACE, isRemote_=pick("id", ["true", "false", "null"]), isListed_=pick("id", ["true", "true", "true", "true", "false", "null"]), secondaryLocations_=pick("id", ['[{"location":"Pokhara"},{"location":"Berlin"}]', "[]"]), workplaceType=pick("id", ["Remote", "Hybrid", "OnSite", ""]), employmentType=KIND, descriptionPlain=when_("id % 2 = 0", TEXT, "''"), descriptionHtml=HTML, publishedAt=f"concat({day('id')}, 'T01:02:03.456+00:00')", compensation_=js(compensationTierSummary="coalesce(pay_text, '')")), "jobs"),
    "smartrecruiters": (js(id=num("id"), name="title", ref=url("api.smartrecruiters.com"), releasedDate=f"concat({day('id')}, 'T10:00:00.000Z')", location_=js(city=pick("id", ["Berlin", ""]), region=pick("id", ["", "Bagmati", "BE"]), country=pick("id", ["de", "np", "", "us"]), remote_=pick("id", ["true", "false", "true", "null", "false"])), experienceLevel_=js(label=pick("id", ["Mid-Senior Level", "Entry Level", ""])), function_=js(label="'Engineering'"), typeOfEmployment_=js(label=KIND), company_=js(name=when_("id % 3 = 0", "'Named Co'", "''"))), "content"),
    "recruitee": (js(id_=num("id"), title="title", careers_url=url("acme.recruitee.com", "o/"), careers_apply_url=when_("id % 3 = 0", url("acme.recruitee.com", "c/"), "''"), company_name=when_("id % 2 = 0", "'Named Co'", "''"), location=PLACE, remote_=pick("id", ["true", "false", "null"]), employment_type_code=KIND, description=HTML, requirements="'<p>You know things.</p>'", salary_=js(min=pick("id", ["1000", "x", ""]), max=pick("id", ["2000.5", "", "9"]), currency="'EUR'", period=pick("id", ["monthly", "per year", "hour", "weekly", ""])), published_at=when_("id % 2 = 0", day("id"), "''"), created_at=day("id + 2")), "offers"),
    "workable": (js(shortcode=when_("id % 5 = 0", "''", f"concat('W', {num('id')})"), title="title", url=when_("id % 3 = 0", "''", url("apply.workable.com", "acme/j/")), shortlink=url("apply.workable.com", "j/"), city=pick("id", ["Kathmandu", "", "Berlin"]), state=pick("id", ["", "Bagmati"]), country=pick("id", ["Nepal", "Germany", ""]), telecommuting_=pick("id", ["true", "false", "null"]), description=when_("id % 7 = 0", "'<p>Short one</p>'", HTML), employment_type=KIND, application_url=when_("id % 2 = 0", url("apply.workable.com", "a/"), "''"), published_on=when_("id % 2 = 0", day("id"), "''"), created_at=day("id + 3")), "jobs"),
}


def body(record: str, path: str | None) -> str:
    whole = f"concat('[', {record}, ']')"
    return f"""concat('{{"name":"Board Co","{path}":', {whole}, '}}')""" if path else whole


#: A body that is no JSON, in every 50th payload, must give no rows.
for _source, (_record, _path) in RECORDS.items():
    TABLES[f"payload_{_source}"] = (
        f"SELECT id, '{_source}' AS source, concat('https://feed.example.com/', CAST(id AS STRING)) AS url, '{{\"slug\":\"big-corp\"}}' AS params, {NOW_HOUR} - id % 100 AS fetched_hour, "
        f"CASE WHEN id % 50 = 49 THEN 'no {{ json' ELSE {body(_record, _path)} END AS body FROM ({OPPORTUNITIES})",
        "documents",
    )
