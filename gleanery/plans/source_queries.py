"""Queries of the feed and board adapters over payloads of every shape. The SQL reads the JSON of the payloads."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.functions.classify import MODES
from gleanery.plans import oracle as o
from gleanery.plans.derived import derived, with_tables
from gleanery.plans.payload_tables import RECORDS
from gleanery.sources import feeds

col = F.col


def payloads(spark: SparkSession, d: str, source: str) -> DataFrame:
    return derived(spark, d, f"payload_{source}").withColumn("fetched_at", F.timestamp_seconds(col("fetched_hour") * 3600))


def shown(rows: DataFrame) -> DataFrame:
    """Posting columns with lists joined and times in seconds."""
    return rows.select(
        "source_external_id", "source_url", "title", "company_name", "company_website", "location_text", F.array_join("location_restrictions", "|").alias("restrictions"), "remote_type", "employment_type",
        "salary_min", "salary_max", "salary_currency", "salary_period", "salary_text", "description", "description_quality", "apply_url", F.unix_seconds("posted_at").alias("posted"), F.unix_seconds("expires_at").alias("expires"),
        F.array_join("tags", "|").alias("tags"), "seniority_hint")


def source_postings(source: str, spark: SparkSession, d: str) -> DataFrame:
    return shown(feeds.postings(payloads(spark, d, source), [source]))


def g(path: str) -> str:
    return f"(j->>'$.{path}')"


def f(path: str) -> str:
    return f"nullif({g(path)}, '')"


def first(*paths: str) -> str:
    return "coalesce(" + ", ".join(f(p) for p in paths) + ")"


def unescaped(x: str) -> str:
    return f"replace(replace(replace(replace({x}, '&lt;', '<'), '&gt;', '>'), '&nbsp;', chr(160)), '&amp;', '&')"


def cleaned(x: str) -> str:
    x = f"regexp_replace(replace(coalesce({x}, ''), chr(160), ' '), '[ \\t]+', ' ', 'g')"
    x = f"regexp_replace(regexp_replace({x}, ' ?\\n ?', chr(10), 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g')"
    return f"trim({x}, ' ' || chr(10))"


def html(x: str) -> str:
    """Markup of the payloads: headings, paragraphs, items, scripts and a few entities."""
    x = f"coalesce({x}, '')"
    x = f"CASE WHEN contains({x}, '&lt;') THEN {unescaped(x)} ELSE {x} END"
    x = f"regexp_replace({x}, '<script>.*?</script>', '', 'g')"
    x = f"regexp_replace(regexp_replace({x}, '<li>', chr(10) || '- ', 'g'), '</?(p|li|ul|h2)>', chr(10), 'g')"
    return cleaned(unescaped(f"regexp_replace({x}, '</?[a-z]+>', '', 'g')"))


def regions(x: str) -> str:
    parts = f"list_transform(string_split_regex(coalesce({x}, ''), '[,/;|]'), lambda v: trim(v))"
    return f"array_to_string(list_filter({parts}, lambda v: lower(v) NOT IN ('', 'remote', 'remote job', 'anywhere remote')), '|')"


def amount(path: str) -> str:
    return f"nullif(try_cast({g(path)} AS DOUBLE), 0)"


def moment(x: str) -> str:
    n = f"CAST({x} AS BIGINT)"
    return f"CASE WHEN regexp_matches({x}, '^[0-9]+$') THEN CASE WHEN {n} > 100000000000 THEN {n} // 1000 ELSE {n} END WHEN {x} <> '' THEN CAST(floor(epoch(CAST({x} AS TIMESTAMP))) AS BIGINT) END"


def joined(path: str, sep: str = "|") -> str:
    return f"array_to_string(CAST(json_extract(j, '$.{path}') AS VARCHAR[]), '{sep}')"


def mode_of(x: str) -> str:
    return o.classes(o.fold(x), {k: p.replace("(?:", "(") for k, p in MODES.items()}, "unknown")


SLUG = "'big-corp:' || "
BOARD = "'Big Corp'"
PAID = "coalesce({}, {}) IS NOT NULL"


def paid(low: str, high: str, value: str) -> str:
    return f"CASE WHEN coalesce({low}, {high}) IS NOT NULL THEN {value} END"


def year_pay(low: str, high: str, currency: str) -> dict[str, str]:
    lo, hi = amount(low), amount(high)
    return {"salary_min": lo, "salary_max": hi, "salary_currency": paid(lo, hi, currency), "salary_period": paid(lo, hi, "'year'")}


_NAMES = "list_transform(CAST(json_extract(j, '$.locations') AS JSON[]), lambda v: coalesce(v->>'$.name', ''))"
_REMOTE_NAMES = f"len(list_filter({_NAMES}, lambda v: contains(lower(v), 'remote'))) > 0"
_REGIONS = "list_transform(coalesce(CAST(json_extract(j, '$.locationRestrictions') AS JSON[]), []), lambda v: coalesce(CASE WHEN json_type(v) = 'OBJECT' THEN v->>'$.name' ELSE v->>'$' END, ''))"
_FIND_REMOTE = f"(coalesce(CAST({g('remote')} AS BOOLEAN), false) OR contains(lower({g('location')}), 'remote'))"
_BLOCKS = f"list_transform(CAST(json_extract(j, '$.lists') AS JSON[]), lambda b: chr(10) || chr(10) || (b->>'$.text') || chr(10) || ({html('b->>' + chr(39) + '$.content' + chr(39))}))"
_SR_URL = f"'https://jobs.smartrecruiters.com/big-corp/' || {g('id')}"
_SR_COUNTRY = f"upper({g('location.country')})"
_SR_REMOTE = f"coalesce(CAST({g('location.remote')} AS BOOLEAN), false)"
_PERIOD = f"lower({g('salary.period')})"
_ASHBY_PLACES = "list_concat([j->>'$.location'], list_transform(CAST(json_extract(j, '$.secondaryLocations') AS JSON[]), lambda v: v->>'$.location'))"
_TITLE_CASE = "'unspecified'"


#: source: the value of each column by the record j, which records count (`keep`), and what must be unique (`unique`).
EXPECTED: dict[str, dict[str, str]] = {
    "remotive": {"keep": f"{f('url')} IS NOT NULL AND {f('title')} IS NOT NULL", "source_external_id": g("id"), "source_url": g("url"), "title": g("title"), "company_name": g("company_name"), "location_text": f("candidate_required_location"), "restrictions": regions(g("candidate_required_location")), "mode": "'remote'", "kind": g("job_type"), "salary_text": f("salary"), "description": html(g("description")), "apply_url": g("url"), "posted": g("publication_date"), "tags": joined("tags")},
    "remoteok": {"keep": f"{g('legal')} IS NULL AND {f('position')} IS NOT NULL AND {f('url')} IS NOT NULL", "source_external_id": g("id"), "source_url": g("url"), "title": g("position"), "company_name": g("company"), "location_text": f("location"), "restrictions": f"CASE WHEN lower({g('location')}) IN ('worldwide', 'anywhere') THEN {g('location')} ELSE {regions(g('location'))} END", "mode": "'remote'", "kind": "''", **year_pay("salary_min", "salary_max", "'USD'"), "description": html(g("description")), "apply_url": first("apply_url", "url"), "posted": first("date", "epoch"), "tags": joined("tags")},
    "jobicy": {"unique": g("id"), "keep": f"{f('url')} IS NOT NULL", "source_external_id": g("id"), "source_url": g("url"), "title": html(g("jobTitle")), "company_name": g("companyName"), "location_text": f("jobGeo"), "restrictions": regions(g("jobGeo")), "mode": "'remote'", "kind": g("jobType"), **year_pay("annualSalaryMin", "annualSalaryMax", g("salaryCurrency")), "description": html(first("jobDescription", "jobExcerpt")), "apply_url": g("url"), "posted": g("pubDate"), "seniority_hint": g("jobLevel")},
    "himalayas": {"keep": f"{first('applicationLink', 'guid')} IS NOT NULL AND {f('title')} IS NOT NULL", "source_external_id": first("guid", "applicationLink"), "source_url": first("guid", "applicationLink"), "title": g("title"), "company_name": g("companyName"), "location_text": f"coalesce(nullif(array_to_string({_REGIONS}, ', '), ''), 'Worldwide')", "restrictions": f"array_to_string(list_filter({_REGIONS}, lambda v: v <> ''), '|')", "mode": "'remote'", "kind": g("employmentType"), **year_pay("minSalary", "maxSalary", first("currency", "salaryCurrency")), "description": html(first("description", "excerpt")), "apply_url": first("applicationLink", "guid"), "posted": g("pubDate"), "expires": g("expiryDate"), "seniority_hint": joined("seniority", ", ")},
    "workingnomads": {"keep": f"{f('url')} IS NOT NULL AND {f('title')} IS NOT NULL", "source_url": g("url"), "title": g("title"), "company_name": g("company_name"), "location_text": f("location"), "restrictions": f"CASE WHEN lower({g('location')}) IN ('anywhere', 'worldwide', '') THEN '' ELSE {regions(g('location'))} END", "mode": "'remote'", "employment": "'unspecified'", "description": html(g("description")), "apply_url": g("url"), "posted": g("pub_date"), "tags": f"array_to_string(list_transform(string_split({g('tags')}, ','), lambda v: trim(v)), '|')"},
    "arbeitnow": {"keep": f"coalesce(CAST({g('remote')} AS BOOLEAN), false) AND {f('url')} IS NOT NULL", "source_external_id": g("slug"), "source_url": g("url"), "title": g("title"), "company_name": g("company_name"), "location_text": g("location"), "mode": "'remote'", "kind": joined("job_types", " "), "description": html(g("description")), "apply_url": g("url"), "posted": g("created_at"), "tags": joined("tags")},
    "themuse": {"unique": g("id"), "keep": f"{f('name')} IS NOT NULL AND {f('refs.landing_page')} IS NOT NULL", "source_external_id": g("id"), "source_url": g("refs.landing_page"), "title": g("name"), "company_name": g("company.name"), "location_text": f"nullif(array_to_string({_NAMES}, ', '), '')", "restrictions": f"CASE WHEN {_REMOTE_NAMES} THEN '' ELSE {regions(f'array_to_string({_NAMES}, chr(44) || chr(32))')} END", "mode": f"CASE WHEN {_REMOTE_NAMES} THEN 'remote' ELSE 'unknown' END", "kind": g("type"), "description": html(g("contents")), "apply_url": g("refs.landing_page"), "posted": g("publication_date"), "seniority_hint": "array_to_string(list_transform(CAST(json_extract(j, '$.levels') AS JSON[]), lambda v: v->>'$.name'), ', ')"},
    "findwork": {"keep": f"{f('url')} IS NOT NULL AND {f('role')} IS NOT NULL", "source_external_id": g("id"), "source_url": g("url"), "title": g("role"), "company_name": g("company_name"), "company_website": g("company_url"), "location_text": f"coalesce({f('location')}, CASE WHEN {_FIND_REMOTE} THEN 'Remote' END)", "restrictions": f"CASE WHEN {_FIND_REMOTE} THEN '' ELSE {regions(g('location'))} END", "mode": f"CASE WHEN {_FIND_REMOTE} THEN 'remote' ELSE 'unknown' END", "kind": g("employment_type"), "description": html(g("text")), "apply_url": g("url"), "posted": g("date_posted"), "tags": joined("keywords")},
    "greenhouse": {"keep": f"{f('absolute_url')} IS NOT NULL", "source_external_id": SLUG + g("id"), "source_url": g("absolute_url"), "title": g("title"), "company_name": f"coalesce({f('company_name')}, {BOARD})", "location_text": g("location.name"), "employment": "'unspecified'", "description": html(g("content")), "apply_url": g("absolute_url"), "posted": first("first_published", "updated_at")},
    "lever": {"keep": f"{f('hostedUrl')} IS NOT NULL", "source_external_id": SLUG + g("id"), "source_url": g("hostedUrl"), "title": g("text"), "company_name": BOARD, "location_text": f"coalesce({f('categories.location')}, {joined('categories.allLocations', ', ')})", "mode": f"lower({g('workplaceType')})", "kind": g("categories.commitment"), "salary_min": f"CAST({g('salaryRange.min')} AS DOUBLE)", "salary_max": f"CAST({g('salaryRange.max')} AS DOUBLE)", "salary_currency": g("salaryRange.currency"), "salary_period": f"CASE WHEN contains({g('salaryRange.interval')}, 'hour') THEN 'hour' WHEN contains({g('salaryRange.interval')}, 'month') THEN 'month' WHEN {g('salaryRange.interval')} IS NOT NULL THEN 'year' END", "description": f"trim(coalesce({f('descriptionPlain')}, nullif({html(g('description'))}, ''), ' ') || array_to_string({_BLOCKS}, '') || chr(10) || chr(10) || {g('additionalPlain')}, ' ' || chr(10))", "apply_url": first("applyUrl", "hostedUrl"), "posted": g("createdAt")},
    "ashby": {"keep": f"{f('jobUrl')} IS NOT NULL AND coalesce(CAST({g('isListed')} AS BOOLEAN), true)", "source_external_id": SLUG + first("id", "jobUrl"), "source_url": g("jobUrl"), "title": g("title"), "company_name": BOARD, "location_text": f"nullif(array_to_string(list_filter({_ASHBY_PLACES}, lambda v: coalesce(v, '') <> ''), ', '), '')", "mode": f"CASE WHEN CAST({g('isRemote')} AS BOOLEAN) THEN 'remote' ELSE lower({g('workplaceType')}) END", "kind": g("employmentType"), "salary_text": g("compensation.compensationTierSummary"), "description": f"coalesce({f('descriptionPlain')}, {html(g('descriptionHtml'))})", "apply_url": first("applyUrl", "jobUrl"), "posted": g("publishedAt")},
    "smartrecruiters": {"keep": f"{g('id')} IS NOT NULL", "source_external_id": SLUG + g("id"), "source_url": _SR_URL, "title": g("name"), "company_name": f"coalesce({f('company.name')}, {BOARD})", "location_text": f"nullif(array_to_string(list_filter([{g('location.city')}, {g('location.region')}, {_SR_COUNTRY}], lambda v: v <> ''), ', '), '')", "restrictions": f"CASE WHEN {_SR_REMOTE} THEN {_SR_COUNTRY} ELSE '' END", "mode": f"CASE WHEN {_SR_REMOTE} THEN 'remote' END", "kind": g("typeOfEmployment.label"), "description": f"array_to_string(list_filter([{g('name')}, {g('function.label')}, {g('experienceLevel.label')}], lambda v: v <> ''), chr(10))", "description_quality": "'partial'", "apply_url": _SR_URL, "posted": g("releasedDate"), "seniority_hint": g("experienceLevel.label")},
    "recruitee": {"keep": f"{f('careers_url')} IS NOT NULL", "source_external_id": SLUG + g("id"), "source_url": g("careers_url"), "title": g("title"), "company_name": f"coalesce({f('company_name')}, {BOARD})", "location_text": g("location"), "mode": f"CASE WHEN CAST({g('remote')} AS BOOLEAN) THEN 'remote' END", "kind": g("employment_type_code"), "salary_min": f"try_cast({g('salary.min')} AS DOUBLE)", "salary_max": f"try_cast({g('salary.max')} AS DOUBLE)", "salary_currency": g("salary.currency"), "salary_period": "CASE " + " ".join(f"WHEN contains({_PERIOD}, '{p}') THEN '{p}'" for p in ("hour", "day", "week", "month", "year")) + " END", "description": html(f"concat({g('description')}, chr(10), {g('requirements')})"), "apply_url": first("careers_apply_url", "careers_url"), "posted": first("published_at", "created_at")},
    "workable": {"keep": f"{first('url', 'shortlink')} IS NOT NULL", "source_external_id": SLUG + first("shortcode", "url", "shortlink"), "source_url": first("url", "shortlink"), "title": g("title"), "company_name": "'Board Co'", "location_text": f"nullif(array_to_string(list_filter([{g('city')}, {g('state')}, {g('country')}], lambda v: v <> ''), ', '), '')", "mode": f"CASE WHEN CAST({g('telecommuting')} AS BOOLEAN) THEN 'remote' END", "kind": g("employment_type"), "description": html(g("description")), "description_quality": f"CASE WHEN length({html(g('description'))}) > 300 THEN 'full' ELSE 'partial' END", "apply_url": f"coalesce({f('application_url')}, {first('url', 'shortlink')})", "posted": first("published_on", "created_at")},
}
TEXTS = ("source_external_id", "source_url", "company_website", "location_text", "salary_currency", "salary_period", "salary_text", "apply_url", "seniority_hint")


def expected_sql(source: str) -> str:
    """The postings of a payload table, read from its JSON."""
    e, path = EXPECTED[source], RECORDS[source][1]
    get = lambda name, other="CAST(NULL AS VARCHAR)": e.get(name, other)
    records = f"WITH r AS (SELECT fetched_hour, url AS payload, unnest(CAST(json_extract(body, '${'.' + path if path else ''}') AS JSON[])) AS j FROM payload_{source} WHERE json_valid(body)), k AS (SELECT * FROM r WHERE {e['keep']}"
    if "unique" in e:
        records += f" QUALIFY row_number() OVER (PARTITION BY {e['unique']} ORDER BY fetched_hour, payload) = 1"
    raw = ", ".join(f"{get(n)} AS {n}" for n in TEXTS) + f", left(trim({e['title']}), 300) AS title, left(trim({get('company_name')}), 200) AS company_name, coalesce({get('restrictions')}, '') AS restrictions, {get('mode')} AS mode, {get('kind')} AS kind, {get('employment')} AS employment"
    raw += f", {get('salary_min', 'CAST(NULL AS DOUBLE)')} AS salary_min, {get('salary_max', 'CAST(NULL AS DOUBLE)')} AS salary_max, left({e['description']}, 30000) AS description, {get('description_quality', chr(39) + 'full' + chr(39))} AS description_quality, {get('posted')} AS posted_text, {get('expires')} AS expires_text, coalesce({get('tags')}, '') AS tags"
    told = "CASE WHEN mode IN ('remote', 'hybrid', 'unknown') THEN mode WHEN mode IN ('onsite', 'on-site') THEN 'onsite' END"
    here, there = mode_of("concat_ws(' ', title, location_text)"), mode_of("left(description, 2000)")
    return f"""{records}), w AS (SELECT {raw} FROM k)
SELECT * EXCLUDE (mode, kind, employment, posted_text, expires_text), coalesce({told}, CASE WHEN {here} <> 'unknown' THEN {here} ELSE {there} END) AS remote_type,
  coalesce(employment, {o.employment('kind')}) AS employment_type, {moment('posted_text')} AS posted, {moment('expires_text')} AS expires FROM w"""


QUERIES = {f"source_{s}": (partial(source_postings, s), with_tables(expected_sql(s), f"payload_{s}")) for s in EXPECTED}
