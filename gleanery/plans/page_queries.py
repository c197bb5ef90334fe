"""Queries of pages, sitemaps, threads, searches and details over payloads made of the derived postings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.config import DEFAULT as C
from gleanery.functions import dates, money, text
from gleanery.plans import oracle as o
from gleanery.plans.derived import NOW_HOUR, OPPORTUNITIES, TABLES, derived, pick, with_tables
from gleanery.plans.payload_tables import COMPANY, HTML, KIND, PLACE, TEXT, day, js, num, url, when_
from gleanery.plans.posting_queries import RELEVANCE_CTE
from gleanery.plans.source_queries import QUERIES as SOURCES
from gleanery.plans.source_queries import cleaned, f, first, g, html, joined, mode_of, moment, payloads, unescaped
from gleanery.sources import feeds, pages

col = F.col
Q: dict[str, tuple] = {}


def query(sql: str | None, *names: str):
    def add(fn):
        Q[fn.__name__] = (fn, with_tables(sql, *names) if sql else None)
        return fn

    return add


def made(name: str, columns: str) -> None:
    """A table made of the derived postings."""
    TABLES[name] = (f"SELECT {columns} FROM ({OPPORTUNITIES})", "documents")


# --- pages with structured data -------------------------------------------------------------------------------

_PLACE_JSON = pick("id", ['{"name":"HQ","address":{"addressLocality":"Pokhara","addressRegion":"Gandaki","addressCountry":"NP"}}', '[{"address":{"addressLocality":"Berlin","addressCountry":{"name":"Germany"}}},{"name":"Remote hub"}]', '"Anywhere"', "null", '{"address":"Main Street 1"}'])
_POSTING = js(
    type_="'0'", title="concat(title, ' &amp; more')", description=f"concat('<p>', {TEXT}, '</p>')", hiringOrganization_=when_("id % 3 = 0", js(name=COMPANY, sameAs="coalesce(company_website, '')", url="'https://org.example.com'"), f"concat('\"', {COMPANY}, '\"')"),
    jobLocation_=_PLACE_JSON, applicantLocationRequirements_=pick("id", ['{"name":"Nepal"}', '[{"name":"Canada"},{"name":"Spain"}]', "null"]), jobLocationType=pick("id", ["TELECOMMUTE", "", "", ""]),
    employmentType_=pick("id", ['"FULL_TIME"', '["CONTRACTOR","PART_TIME"]', '"INTERN"', '""']), baseSalary_=when_("id % 2 = 0", js(currency="'EUR'", value_=pick("id * 3", ['{"minValue":1000,"maxValue":2000,"unitText":"MONTH"}', '{"value":35,"unitText":"hour"}', '"50000"']))),
    datePosted=day("id"), validThrough=when_("id % 4 = 0", f"concat({day('id + 3')}, 'T00:00:00Z')", "''"), url=when_("id % 5 = 0", url("jobs.example.com", "p/"), "''")).replace("'\"type\":', '0'", "'\"@type\":', CASE WHEN id % 6 = 3 THEN '[\"Thing\",\"JobPosting\"]' ELSE '\"JobPosting\"' END")
_SCRIPT = f"""CASE id % 6 WHEN 1 THEN concat('[{{"@type":"Organization"}},', {_POSTING}, ',', {_POSTING}, ']') WHEN 2 THEN concat('{{"@graph":[{{"@type":"WebPage"}},', {_POSTING}, ']}}') WHEN 4 THEN '{{ broken' ELSE {_POSTING} END"""
_SAYS = pick("id", ["About the role and requirements. Apply now.", "Qualifications and benefits: you will like it.", "Welcome to our shop.", "Responsibilities only."])
made("job_pages", f"""id, concat('https://www.site.example.com/jobs/', {num('id')}, '?utm_source=x') AS url,
  concat('<html><head><style>p {{ }}</style>', CASE WHEN id % 6 <> 5 THEN concat('<script type="application/ld+json">', {_SCRIPT}, '</script>') ELSE '' END, '</head><body><nav>Menu <nav>more</nav> rest</nav><!-- <main>old</main> --><main><h2>', title, '</h2><aside title="a > b">Ad <aside>inner</aside> tail</aside><p title="1 > 0">', {_SAYS}, '</p><p>', {TEXT}, '</p></main><footer>Foot</footer><main>Second</main>',
  '<a href="https://boards.greenhouse.io/co', {num('id % 7')}, '/jobs/1">a</a><a class="x" href="https://jobs.lever.co/team', {num('id % 5')}, '/z">b</a><a href="https://boards.greenhouse.io/co', {num('id % 7')}, '/jobs/2">again</a><a href="https://acme', {num('id % 3')}, '.recruitee.com/o/dev">c</a><a href="/own">d</a></body></html>') AS html""")  # fmt: skip

#: The nodes: one or two by the shape of the script.
NODES = """s AS (SELECT id, url, html, regexp_extract(html, 'ld\\+json">(.*?)</script>', 1) AS script FROM job_pages),
l AS (SELECT id, url, html, CASE WHEN NOT json_valid(script) THEN [] WHEN json_type(script) = 'ARRAY' THEN CAST(json_extract(script, '$') AS JSON[]) WHEN json_extract(script, '$."@graph"') IS NOT NULL THEN CAST(json_extract(script, '$."@graph"') AS JSON[]) ELSE [CAST(script AS JSON)] END AS nodes FROM s),
n AS (SELECT id, url, html, list_filter(nodes, lambda j: contains(coalesce(CAST(json_extract(j, '$."@type"') AS VARCHAR), ''), '"JobPosting"')) AS nodes FROM l)"""
_ORG = f"CASE WHEN json_type(j, '$.hiringOrganization') = 'OBJECT' THEN {g('hiringOrganization.name')} ELSE {g('hiringOrganization')} END"


def place_sql(x: str) -> str:
    """A place: a text, an address in parts, an address as a text, or a name."""
    get = lambda p: f"nullif({x}->>'$.{p}', '')"
    country = f"coalesce(nullif({x}->>'$.address.addressCountry.name', ''), nullif({x}->>'$.address.addressCountry', ''))"
    parts = f"array_to_string(list_filter([{get('address.addressLocality')}, {get('address.addressRegion')}, {country}], lambda v: v IS NOT NULL), ', ')"
    return f"CASE json_type({x}) WHEN 'VARCHAR' THEN {x}->>'$' ELSE CASE WHEN json_extract({x}, '$.address') IS NULL THEN coalesce({x}->>'$.name', '') WHEN json_type({x}, '$.address') = 'VARCHAR' THEN {x}->>'$.address' ELSE {parts} END END"


def places_sql(path: str) -> str:
    value = f"json_extract(j, '$.{path}')"
    each = f"CASE WHEN {value} IS NULL OR json_type({value}) = 'NULL' THEN [] WHEN json_type({value}) = 'ARRAY' THEN CAST({value} AS JSON[]) ELSE [{value}] END"
    return f"list_filter(list_transform({each}, lambda x: {place_sql('x')}), lambda v: v <> '')"


_PLACE = f"array_to_string({places_sql('jobLocation')}, '; ')"
_KINDS = "regexp_replace(coalesce(CAST(json_extract(j, '$.employmentType') AS VARCHAR), ''), '[\\[\\]\"]', ' ', 'g')"
_VALUE = "json_extract(j, '$.baseSalary.value')"
_TOLD = f"CASE WHEN {mode_of('concat_ws(chr(32), title, place)')} <> 'unknown' THEN {mode_of('concat_ws(chr(32), title, place)')} ELSE {mode_of('left(description, 2500)')} END"


@query(f"""WITH {NODES}, r AS (SELECT url, unnest(nodes) AS j FROM n),
w AS (SELECT coalesce({f('url')}, url) AS source_url, {html(g('title'))} AS title, {html(g('description'))} AS description, {_ORG} AS company_name, {first('hiringOrganization.sameAs', 'hiringOrganization.url')} AS company_website, {_PLACE} AS place,
  array_to_string({places_sql('applicantLocationRequirements')}, '|') AS restrictions, contains(coalesce({g('jobLocationType')}, ''), 'TELECOMMUTE') AS tele, {o.employment(_KINDS)} AS employment_type,
  try_cast(coalesce({f('baseSalary.value.minValue')}, {f('baseSalary.value.value')}, CASE WHEN json_type({_VALUE}) = 'VARCHAR' THEN {g('baseSalary.value')} END) AS DOUBLE) AS salary_min, try_cast({g('baseSalary.value.maxValue')} AS DOUBLE) AS salary_max, {g('baseSalary.currency')} AS salary_currency,
  CASE upper({g('baseSalary.value.unitText')}) WHEN 'MONTH' THEN 'month' WHEN 'HOUR' THEN 'hour' END AS salary_period, {moment(g('datePosted'))} AS posted, {moment(g('validThrough'))} AS expires FROM r),
x AS (SELECT *, CASE WHEN tele THEN 'remote' WHEN {_TOLD} = 'unknown' AND place <> '' THEN 'onsite' ELSE {_TOLD} END AS remote_type FROM w WHERE title <> '')
SELECT * EXCLUDE (place, tele), coalesce(nullif(place, ''), CASE WHEN remote_type = 'remote' THEN 'Remote' END) AS location_text FROM x""", "job_pages")
def page_postings(spark, d) -> DataFrame:
    rows = pages.from_jsonld(derived(spark, d, "job_pages"))
    return rows.select("source_url", "title", "description", "company_name", "company_website", "location_text", F.array_join("location_restrictions", "|").alias("restrictions"), "remote_type", "employment_type",
        "salary_min", "salary_max", "salary_currency", "salary_period", F.unix_seconds("posted_at").alias("posted"), F.unix_seconds("expires_at").alias("expires"))


#: The first main element outside comments, without the one outer aside in it.
_INSIDE = "regexp_replace(regexp_extract(regexp_replace(html, '<!--.*?-->', '', 'g'), '<main>(.*?)</main>', 1), '<aside.*</aside>', ' ')"
_WHOLE = cleaned(f"regexp_replace({_INSIDE}, '</?(h2|p)( [a-z]+=.[^\"]*.)?>', chr(10), 'g')")
_MAIN = f"left({_WHOLE}, 15000)"
_INDICATED = " + ".join(f"CAST(contains(low, {o.q(p)}) AS INT)" for p in pages.INDICATORS)
_LIKE = lambda shown: f"t AS (SELECT *, {shown} AS shown FROM n), k AS (SELECT *, lower(shown) AS low FROM t), v AS (SELECT *, ({_INDICATED}) >= 2 AND length(shown) BETWEEN 500 AND 60000 AS likely FROM k)"
LIKE = _LIKE(_MAIN)


@query(f"""WITH {NODES}, {LIKE} SELECT CASE WHEN len(nodes) > 0 THEN 'jsonld' WHEN likely THEN 'extract' ELSE 'skipped' END AS route,
 CASE WHEN len(nodes) > 0 THEN 'JSON-LD JobPosting' WHEN likely THEN 'Extraction needed' ELSE 'Page does not look like a single job posting' END AS note, count(*) AS n FROM v GROUP BY ALL""", "job_pages")
def page_routes(spark, d) -> DataFrame:
    return pages.routed(derived(spark, d, "job_pages")).groupBy("route", "note").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {NODES}, {_LIKE(_WHOLE)} SELECT id, shown, likely AS like_posting FROM v", "job_pages")
def page_main_texts(spark, d) -> DataFrame:
    rows = derived(spark, d, "job_pages").select("id", pages.main_text(col("html")).alias("shown"))
    return rows.select("id", "shown", pages.looks_like_posting(col("shown")).alias("like_posting"))


@query(f"""WITH {NODES}, {LIKE}, p AS (SELECT id, left(description, CAST(id % 900 AS INT)) AS description FROM opportunities),
m AS (SELECT id, CASE WHEN len(nodes) > 0 THEN {html("nodes[1]->>'$.description'")} WHEN likely THEN shown END AS found FROM v)
SELECT p.id, CASE WHEN length(found) > length(description) THEN found ELSE description END AS description FROM p LEFT JOIN m ON m.id = p.id AND p.id % 3 > 0""", "opportunities", "job_pages")
def page_enrichment(spark, d) -> DataFrame:
    """Short descriptions meet their page by address; every third posting has none."""
    rows = derived(spark, d, "opportunities").select("id", F.expr("left(description, cast(id % 900 as int))").alias("description"), F.when(col("id") % 3 > 0, F.concat(F.lit("http://site.example.com//jobs/"), "id", F.lit("/"))).otherwise("https://none.example.com/").alias("source_url"))
    return pages.enriched(rows, derived(spark, d, "job_pages")).select("id", "description")


@query("""WITH a AS (SELECT id, url AS page_url, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS link FROM job_pages),
b AS (SELECT *, CASE WHEN contains(link, 'greenhouse.io/') THEN 'greenhouse' WHEN contains(link, 'lever.co/') THEN 'lever' WHEN contains(link, '.recruitee.com') THEN 'recruitee' END AS provider,
  CASE WHEN contains(link, '.recruitee.com') THEN regexp_extract(link, '//([^.]*)\\.', 1) ELSE regexp_extract(link, '//[^/]*/([^/]*)', 1) END AS slug FROM a)
SELECT page_url, min(link) AS url, provider, slug FROM b WHERE provider IS NOT NULL GROUP BY page_url, provider, slug""", "job_pages")
def page_boards(spark, d) -> DataFrame:
    return pages.board_links(derived(spark, d, "job_pages"))


@query("""WITH a AS (SELECT url AS page_url, 'greenhouse' AS provider, concat('co', CAST(id % 7 AS STRING)) AS slug FROM job_pages) SELECT * FROM a""", "job_pages")
def first_page_board(spark, d) -> DataFrame:
    """At most one board a page: the first link wins."""
    return pages.board_links(derived(spark, d, "job_pages"), most=1).select("page_url", "provider", "slug")


# --- sitemaps -------------------------------------------------------------------------------------------------

_SLUG = "replace(replace(lower(title), ' ', '-'), '/', '-')"
_ENTRY = lambda k: f"concat('<url><loc>https://board.example.com/job/', {_SLUG}, '-', {num(f'id * 10 + {k}')}, '</loc>', CASE WHEN id % 3 > 0 THEN concat('<lastmod>', {day(f'id + {k}')}, '</lastmod>') ELSE '' END, '</url>')"
made("sitemaps", f"id, concat('b', {num('id')}) AS board, title, concat('<urlset>', {_ENTRY(0)}, {_ENTRY(1)}, {_ENTRY(2)}, '<url><loc>https://board.example.com/a</loc></url>', '</urlset>') AS body")
_ENTRIES = "e AS (SELECT id, board, title, generate_subscripts(us, 1) - 1 AS pos, unnest(us) AS u FROM (SELECT id, board, title, regexp_extract_all(body, '<url>(.*?)</url>', 1) AS us FROM sitemaps)), x AS (SELECT *, regexp_extract(u, '<loc>(.*?)</loc>', 1) AS loc, CAST(nullif(regexp_extract(u, '<lastmod>(.*?)</lastmod>', 1), '') AS TIMESTAMP) AS modified FROM e)"


@query(f"WITH {_ENTRIES} SELECT board, CAST(pos AS INT) AS \"at\", loc, CAST(epoch(modified) AS BIGINT) AS modified FROM x", "sitemaps")
def sitemap_urls(spark, d) -> DataFrame:
    return pages.sitemap_entries(derived(spark, d, "sitemaps")).withColumn("modified", F.unix_seconds("modified"))


_WORTH = RELEVANCE_CTE.replace("FROM opportunities)", "FROM c)").replace("r AS", "rel AS")
_CUT = NOW_HOUR * 3600 - 90 * 86400


@query(f"""WITH {_ENTRIES}, c AS (SELECT board, pos, loc, modified, trim(regexp_replace(regexp_replace(list_last(string_split(loc, '/')), '-[0-9]+$', ''), '[-_]+', ' ', 'g')) AS title, '' AS description, 'merojob' AS source, 'x' AS location_text FROM x), {_WORTH},
w AS (SELECT *, count(modified) OVER (PARTITION BY board) AS dated FROM (SELECT *, {o.first_term(o.fold('title'), C.blocked_title_terms)} AS blocked_term, regexp_matches({o.fold('title')}, '\\b(junior|jr|entry[- ]level|intern|internship|trainee|graduate|apprentice|associate)\\b') AS junior FROM rel)
  WHERE length(title) < 3 OR (NOT stopped AND included IS NOT NULL AND (blocked_term IS NULL OR junior))),
y AS (SELECT board, loc AS url, row_number() OVER (PARTITION BY board ORDER BY modified DESC NULLS LAST, CASE WHEN dated = 0 THEN -pos ELSE pos END) AS rank FROM w WHERE dated = 0 OR epoch(modified) >= {_CUT})
SELECT board, url, CAST(rank AS INT) AS rank FROM y WHERE rank <= 2""", "sitemaps")
def sitemap_pages(spark, d) -> DataFrame:
    now = F.timestamp_seconds(F.lit(NOW_HOUR * 3600))
    return pages.board_pages(pages.sitemap_entries(derived(spark, d, "sitemaps")), now, 2, 90)


_CHILD = lambda k: f"concat('<sitemap><loc>https://board.example.com/', {pick(f'id + {k}', ['jobs', 'news', 'jobs-old'])}, '-', {num(str(k))}, '.xml</loc></sitemap>')"
made("sitemap_indexes", f"concat('b', {num('id')}) AS board, CASE WHEN id % 4 = 0 THEN NULL ELSE 'jobs' END AS pattern, concat('<sitemapindex>', {', '.join(_CHILD(k) for k in range(6))}, '</sitemapindex>') AS body")


@query("""WITH c AS (SELECT board, pattern, generate_subscripts(ls, 1) AS pos, unnest(ls) AS loc FROM (SELECT board, pattern, regexp_extract_all(body, '<loc>(.*?)</loc>', 1) AS ls FROM sitemap_indexes))
SELECT board, loc FROM c WHERE pattern IS NULL OR contains(loc, pattern) QUALIFY row_number() OVER (PARTITION BY board ORDER BY pos) <= 3""", "sitemap_indexes")
def sitemap_children(spark, d) -> DataFrame:
    return pages.child_sitemaps(derived(spark, d, "sitemap_indexes"))


# --- feeds in other shapes ------------------------------------------------------------------------------------

_ESCAPED = f"replace(replace(replace({HTML}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
made("payload_weworkremotely", f"""id, 'weworkremotely' AS source, 'u' AS url, '{{}}' AS params, {NOW_HOUR} AS fetched_hour, concat('<rss><channel><item><title>', CASE WHEN id % 3 = 0 THEN title ELSE concat('Big: Co: ', title) END, '</title><region>', {pick('id', ['Anywhere in the World', 'USA Only', 'Europe Only, Asia', ''])}, '</region><type>', {KIND}, '</type><link>',
  CASE WHEN id % 7 = 0 THEN '' ELSE concat('https://weworkremotely.com/', {num('id')}) END, '</link><guid>', CASE WHEN id % 2 = 0 THEN concat('g', {num('id')}) ELSE '' END, '</guid><pubDate>Mon, 0', {num('1 + id % 9')}, ' Jun 2026 10:00:00 +0000</pubDate><description>', {_ESCAPED}, '</description></item><item><title>No link</title></item></channel></rss>') AS body""")  # fmt: skip
_TAG = lambda n: f"nullif(trim(regexp_extract(body, '<item>.*?<{n}>(.*?)</{n}>', 1)), '')"


@query(f"""WITH t AS (SELECT id, {_TAG('title')} AS whole, coalesce({_TAG('region')}, '') AS region, {_TAG('type')} AS kind, {_TAG('link')} AS link, {_TAG('guid')} AS guid, {_TAG('pubDate')} AS posted, {unescaped(_TAG('description'))} AS about FROM payload_weworkremotely)
SELECT coalesce(guid, link) AS source_external_id, link AS source_url, trim(CASE WHEN contains(whole, ':') THEN substr(whole, strpos(whole, ':') + 1) ELSE whole END) AS title, CASE WHEN contains(whole, ':') THEN split_part(whole, ':', 1) END AS company_name, nullif(region, '') AS location_text,
  CASE WHEN contains(lower(region), 'anywhere') THEN '' ELSE array_to_string(list_filter(list_transform(string_split(replace(region, ' Only', ''), ','), lambda v: trim(v)), lambda v: v <> ''), '|') END AS restrictions, {o.employment('kind')} AS employment_type, left({html('about')}, 30000) AS description,
  CAST(epoch(strptime(regexp_replace(posted, ' \\+0000$', ''), '%a, %d %b %Y %H:%M:%S')) AS BIGINT) AS posted FROM t WHERE link IS NOT NULL""", "payload_weworkremotely")
def source_weworkremotely(spark, d) -> DataFrame:
    rows = feeds.postings(payloads(spark, d, "weworkremotely"), ["weworkremotely"])
    return rows.select("source_external_id", "source_url", "title", "company_name", "location_text", F.array_join("location_restrictions", "|").alias("restrictions"), "employment_type", "description", F.unix_seconds("posted_at").alias("posted"))


_LINE = f"concat({pick('id', ['', 'SEEKING FREELANCER - ', ''])}, {COMPANY}, ' | ', title, ' | ', {pick('id', ['Remote (EU)', 'ONSITE Berlin', 'Hybrid, remote ok', 'Earth'])}, ' | Full-time')"
made("payload_hackernews", f"id, 'hackernews' AS source, 'u' AS url, CASE WHEN id % 5 = 0 THEN '{{\"thread\":\"freelancer\"}}' ELSE '{{}}' END AS params, {NOW_HOUR} AS fetched_hour, concat('{{\"children\":[{{\"id\":', {num('id')}, ',\"created_at\":\"', {day('id')}, '\",\"author\":\"a\",\"text\":\"', {_LINE}, '<p>', {TEXT}, '\"}}, {{\"id\":9,\"text\":null}}]}}') AS body")
_WHOLE = "trim(replace(json_extract_string(body, '$.children[0].text'), '<p>', chr(10)))"


@query(f"""WITH c AS (SELECT json_extract_string(body, '$.children[0].id') AS id, coalesce(json_extract_string(params, '$.thread'), 'who_is_hiring') AS thread, json_extract_string(body, '$.children[0].created_at') AS made_at, {cleaned(_WHOLE)} AS whole FROM payload_hackernews),
k AS (SELECT *, regexp_replace(split_part(whole, chr(10), 1), '(?i)^seeking freelancer\\s*[-:|]?\\s*', '') AS line FROM c WHERE contains(lower(whole), 'remote') AND regexp_matches(whole, '(?i)\\b(frontend|front-end|react|javascript|typescript|full[- ]?stack|web developer|software engineer|junior|intern|next\\.?js|qa|support engineer)\\b') AND (thread <> 'freelancer' OR starts_with(lower(whole), 'seeking freelancer'))),
p AS (SELECT *, list_filter(list_transform(regexp_split_to_array(line, '\\s+[|•·]\\s+'), lambda v: trim(v)), lambda v: v <> '') AS parts FROM k),
q AS (SELECT *, list_filter(parts, lambda v: regexp_matches(v, '(?i)remote|onsite|on-site|hybrid'))[1] AS place, list_filter(parts[2:], lambda v: regexp_matches(v, '(?i)\\b(engineer|developer|frontend|front-end|full[- ]?stack|react|web|qa|support|devops|intern|programmer|designer)\\b'))[1] AS role FROM p)
SELECT id AS source_external_id, coalesce(role, left(line, 140)) AS title, left(parts[1], 120) AS company_name, place AS location_text, CASE WHEN contains(lower(place), 'remote') THEN 'remote' ELSE 'unknown' END AS remote_type, CASE WHEN thread = 'freelancer' THEN 'freelance' ELSE {o.employment("array_to_string(parts, ' ')")} END AS employment_type, left(whole, 30000) AS description, {moment('made_at')} AS posted FROM q""", "payload_hackernews")
def source_hackernews(spark, d) -> DataFrame:
    rows = feeds.postings(payloads(spark, d, "hackernews"), ["hackernews"])
    return rows.select("source_external_id", "title", "company_name", "location_text", "remote_type", "employment_type", "description", F.unix_seconds("posted_at").alias("posted"))


made("thread_hits", f"id AS pos, concat('h', {num('id')}) AS objectID, concat({pick('id * 5 + 3', ['Show', 'Ask: Who is hiring?', 'Seeking freelancer?', 'Ask'])}, ' ', {num('id')}) AS title, CASE WHEN id % 9 = 8 THEN NULL ELSE concat('2026-05-', {num('10 + id % 20')}, 'T00:00:00Z') END AS created_at")


@query("SELECT objectID, created_at FROM thread_hits WHERE contains(lower(title), 'who is hiring') ORDER BY pos LIMIT 1", "thread_hits")
def hiring_thread(spark, d) -> DataFrame:
    return feeds.chosen_thread(derived(spark, d, "thread_hits"), "who_is_hiring", F.timestamp_seconds(F.lit(NOW_HOUR * 3600)))


_RESULT = {"brave": js(url=when_("id % 9 = 0", "''", url("r.example.com")), title="title", description=f"concat('<strong>', {TEXT}, '</strong>')"), "tavily": js(url=url("r.example.com"), title="title", content=TEXT), "google_cse": js(link=url("r.example.com"), title="title", snippet=TEXT)}
_BODIES = {"brave": ("'{{\"web\":{{\"results\":['", "']}}}}'"), "tavily": ("'{{\"results\":['", "']}}'"), "google_cse": ("'{{\"items\":['", "']}}'")}
made("search_payloads", f"id, {pick('id', list(_RESULT))} AS source, CASE id % 3 " + " ".join(f"WHEN {i} THEN concat({_BODIES[s][0]}, {r}, {_BODIES[s][1]})".replace("{{", "{").replace("}}", "}") for i, (s, r) in enumerate(_RESULT.items())) + " END AS body")


@query(f"""WITH r AS (SELECT source, unnest(CAST(coalesce(json_extract(body, '$.web.results'), json_extract(body, '$.results'), json_extract(body, '$.items')) AS JSON[])) AS j FROM search_payloads)
SELECT coalesce({g('url')}, {g('link')}) AS url, 'search:' || source AS via, {g('title')} AS title, CASE source WHEN 'brave' THEN {html(g('description'))} WHEN 'tavily' THEN left({g('content')}, 500) ELSE {g('snippet')} END AS snippet FROM r WHERE coalesce({g('url')}, {g('link')}) <> ''""".replace("<strong>", ""), "search_payloads")
def search_results(spark, d) -> DataFrame:
    return feeds.search_links(derived(spark, d, "search_payloads"))


made("lead_rows", f"id, CASE WHEN id % 8 = 0 THEN 'ftp://x' ELSE concat('https://lead.example.com/', {num('id')}) END AS url, title, company_name AS company, {pick('id', ['Berlin', '', None])} AS location, {pick('id * 3', ['fits', None, 'near', ''])} AS why")


@query("SELECT url, 'ai_discovery' AS via, title, array_to_string(list_filter([company, location, why], lambda v: v <> ''), ' | ') AS snippet FROM lead_rows WHERE starts_with(url, 'http')", "lead_rows")
def lead_links(spark, d) -> DataFrame:
    return pages.lead_links(derived(spark, d, "lead_rows"))


made("extracted_rows", f"id, concat('https://page.example.com/', {num('id')}) AS url, id % 9 <> 4 AS is_job_posting, CASE WHEN id % 10 = 3 THEN ' ' ELSE title END AS title, company_name, company_website, location_text, remote_type, {pick('id', ['full_time', 'unspecified'])} AS employment_type, pay_text AS salary_text, description AS text, CASE WHEN id % 2 = 0 THEN apply_url END AS apply_url, apply_email, CASE WHEN id % 3 = 0 THEN 'soon' ELSE {day('id')} END AS posted_date")
PAYS = """pay(salary_text, salary_min, salary_max, salary_currency, salary_period) AS (VALUES ('$40k - $60k per year', 40000.0::DOUBLE, 60000.0::DOUBLE, 'USD', 'year'), ('NPR 30,000 - 50,000', 30000.0, 50000.0, 'NPR', 'month'), ('€25/hour', 25.0, NULL, 'EUR', 'hour'),
 ('Rs. 800,000', 800000.0, NULL, 'NPR', 'year'), ('£1,500 per month', 1500.0, NULL, 'GBP', 'month'), ('USD 120-150k', 120.0, 150000.0, 'USD', 'year'), ('₹ 90000 monthly', 90000.0, NULL, 'INR', 'month'))"""


@query(f"""WITH {PAYS} SELECT 'web' AS source, url AS source_url, left(trim(title), 300) AS title, left(trim(company_name), 200) AS company_name, company_website, location_text, remote_type, employment_type, e.salary_text, salary_min, salary_max, salary_currency, salary_period,
 left(text, 30000) AS description, coalesce(nullif(apply_url, ''), url) AS apply_url, apply_email, CAST(epoch(try_cast(posted_date AS TIMESTAMP)) AS BIGINT) AS posted FROM extracted_rows e LEFT JOIN pay USING (salary_text) WHERE is_job_posting AND trim(title) <> ''""", "extracted_rows")
def extracted_postings(spark, d) -> DataFrame:
    rows = pages.from_extraction(derived(spark, d, "extracted_rows"))
    return rows.withColumn("posted", F.unix_seconds("posted_at")).drop("posted_at")


made("detail_payloads", f"concat('https://api.smartrecruiters.com/', {num('id')}) AS detail_url, CASE WHEN id % 6 = 5 THEN '{{}}' ELSE concat('{{\"jobAd\":{{\"sections\":{{\"companyDescription\":', {js(title=chr(39) + 'Us' + chr(39), text=HTML)}, CASE WHEN id % 2 = 0 THEN concat(',\"qualifications\":', {js(title=chr(39) + 'You' + chr(39), text=TEXT)}) ELSE '' END, '}}}}}}') END AS body")
_PART = lambda n: f"CASE WHEN json_extract(body, '$.jobAd.sections.{n}') IS NOT NULL THEN json_extract_string(body, '$.jobAd.sections.{n}.title') || chr(10) || {html(f'json_extract_string(body, {chr(39)}$.jobAd.sections.{n}.text{chr(39)})')} END"


@query(f"""WITH p AS ({SOURCES['source_smartrecruiters'][1]}), t AS (SELECT detail_url, concat_ws(chr(10) || chr(10), {_PART('companyDescription')}, {_PART('qualifications')}) AS whole FROM detail_payloads)
SELECT source_external_id, CASE WHEN length(coalesce(whole, '')) > length(description) THEN 'full' ELSE description_quality END AS description_quality, CASE WHEN length(coalesce(whole, '')) > length(description) THEN whole ELSE description END AS description
FROM p LEFT JOIN t ON detail_url = 'https://api.smartrecruiters.com/' || split_part(source_external_id, ':', 2)""", "detail_payloads")
def detail_enrichment(spark, d) -> DataFrame:
    rows = feeds.postings(payloads(spark, d, "smartrecruiters"), ["smartrecruiters"])
    return feeds.enriched(rows, derived(spark, d, "detail_payloads")).select("source_external_id", "description_quality", "description")


# --- scalar functions over columns ------------------------------------------------------------------------------

made("moments", f"id, {pick('id', ['1700000000', '1700000000123', '2026-03-04', '2026-03-04T05:06:07Z', '2026-03-04 05:06:07', 'Mon, 02 Mar 2026 01:02:03 GMT', '2 Mar 2026', 'March 2, 2026', 'Mar 2, 2026', '', '0', 'soon', None, '2026-03-04T05:06:07.250+05:45'])} AS stamp, first_seen_hour, 2010 + id % 12 AS start_year, id % 12 + 1 AS start_month, 2015 + id % 9 AS end_year, (id * 5) % 12 + 1 AS end_month")
_FORMS = " ".join(f"WHEN {o.q(k)} THEN {v}" for k, v in {"1700000000": 1700000000, "1700000000123": 1700000000}.items())


@query(f"""SELECT id, CAST(floor(CASE WHEN stamp IN ('', '0', 'soon') THEN NULL WHEN regexp_matches(stamp, '^[0-9]+$') THEN CASE WHEN CAST(stamp AS BIGINT) > 100000000000 THEN CAST(stamp AS BIGINT) // 1000 ELSE CAST(stamp AS BIGINT) END WHEN contains(stamp, '+05:45') THEN epoch(CAST(replace(stamp, '+05:45', '') AS TIMESTAMP)) - 20700
  ELSE epoch(coalesce(try_cast(replace(stamp, 'Z', '') AS TIMESTAMP), try_strptime(stamp, '%a, %d %b %Y %H:%M:%S GMT'), try_strptime(stamp, '%d %b %Y'), try_strptime(stamp, '%B %d, %Y'), try_strptime(stamp, '%b %d, %Y'))) END) AS BIGINT) AS seconds,
  CAST(TIMESTAMP '1970-01-01' + to_seconds(first_seen_hour * 3600 + 345 * 60) AS DATE) AS local_day, greatest(0, (end_year - start_year) * 12 + end_month - start_month) AS months FROM moments""", "moments")
def moment_forms(spark, d) -> DataFrame:
    at = F.timestamp_seconds(col("first_seen_hour") * 3600)
    return derived(spark, d, "moments").select("id", F.unix_seconds(dates.parsed(col("stamp"))).alias("seconds"), dates.local_day(at, C.timezone).alias("local_day"), dates.months_between_years(col("start_year"), col("start_month"), col("end_year"), col("end_month")).alias("months"))


made("title_pairs", f"id, title AS a, {pick('id * 7', ['Frontend Developer', 'Developer Frontend', 'React Engineer', 'Software Engineer II', '', 'Senior QA Engineer'])} AS b")


@query("""WITH RECURSIVE p AS (SELECT id, array_to_string(list_sort(list_filter(string_split(lower(a), ' '), lambda v: v <> '')), ' ') AS x, array_to_string(list_sort(list_filter(string_split(lower(b), ' '), lambda v: v <> '')), ' ') AS y FROM title_pairs),
d AS (SELECT DISTINCT x, y FROM p), s(x, y, i, r) AS (SELECT x, y, 0, list_transform(range(0, length(y) + 1), lambda v: 0) FROM d UNION ALL
 SELECT x, y, i + 1, list_reduce(list_prepend([0], list_transform(range(1, length(y) + 1), lambda k: [CASE WHEN x[i + 1] = y[k] THEN r[k] + 1 ELSE r[k + 1] END])), lambda acc, v: list_append(acc, greatest(acc[len(acc)], v[1]))) FROM s WHERE i < length(x)),
l AS (SELECT x, y, r[len(r)] AS common FROM s WHERE i = length(x))
SELECT id, CASE WHEN length(x) + length(y) = 0 THEN 100.0 ELSE 200.0 * common / (length(x) + length(y)) END AS likeness FROM p JOIN l USING (x, y)""", "title_pairs")
def title_likeness(spark, d) -> DataFrame:
    return derived(spark, d, "title_pairs").select("id", text.title_similarity(F.lower("a"), F.lower("b")).alias("likeness"))


@query(f"""WITH {PAYS}, q AS (SELECT id, pay_text, CASE WHEN id % 4 = 0 THEN CAST(id % 3 * 1000 AS DOUBLE) END AS low, CASE WHEN id % 6 = 0 THEN 9000.0::DOUBLE END AS high, CASE WHEN id % 4 = 0 THEN 'EUR' END AS cur, CASE WHEN id % 8 = 0 THEN 'month' END AS per FROM opportunities)
SELECT id, CASE WHEN reads THEN salary_min ELSE low END AS low, CASE WHEN reads THEN salary_max ELSE high END AS high, CASE WHEN reads THEN salary_currency ELSE cur END AS currency, coalesce(CASE WHEN reads THEN salary_period ELSE per END, 'year') AS period
FROM (SELECT *, low IS NULL AND high IS NULL AND salary_min IS NOT NULL AS reads FROM q LEFT JOIN pay ON salary_text = pay_text)""", "opportunities")
def pay_resolved(spark, d) -> DataFrame:
    rows = derived(spark, d, "opportunities")
    low, high = F.when(col("id") % 4 == 0, (col("id") % 3 * 1000).cast("double")), F.when(col("id") % 6 == 0, 9000.0)
    out = rows.select("id", money.resolved(low, high, F.when(col("id") % 4 == 0, "EUR"), F.when(col("id") % 8 == 0, "month"), col("pay_text")).alias("p"))
    return out.select("id", col("p.min").alias("low"), col("p.max").alias("high"), "p.currency", "p.period")


@query("SELECT id, (greatest(0, tokens_in - cache_read * 100) * 1.25 + 0.25 * cache_read * 100 * 1.25 + tokens_out * 10.0) / 1e6 AS cost FROM usage", "usage")
def cached_costs(spark, d) -> DataFrame:
    rows = derived(spark, d, "usage")
    return rows.select("id", money.cached_usage_cost(col("tokens_in"), col("cache_read") * 100, col("tokens_out"), F.lit(1.25), F.lit(10.0)).alias("cost"))


QUERIES = Q
