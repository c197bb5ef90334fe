"""Posting-engine tables derived from the given ones, in SQL that Spark and DuckDB both read.

Every row comes from a row of a given table, so the work of a query grows with its input. The lists have
lengths that share few factors, and multipliers that share none with their list, so that all combinations occur. Times are hours
(`*_hour`) or days since 1970, whole numbers in both engines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gleanery.session import table

#: 2026-06-01 00:00 UTC in hours.
NOW_HOUR = 494_520


def pick(expression: str, values: list[str | None]) -> str:
    """CASE that takes one of the values by the expression modulo their number."""
    lit = lambda v: "NULL" if v is None else "'" + v.replace("'", "''") + "'"
    return f"CASE ({expression}) % {len(values)} " + " ".join(f"WHEN {i} THEN {lit(v)}" for i, v in enumerate(values)) + " END"


SOURCES = ["remotive", "greenhouse", "lever", "merojob", "hackernews", "himalayas", "websearch", "kumarijob", "workable"]
LEVELS = ["", "Junior ", "Senior ", "", "Lead ", "Entry-Level ", "Sr. "]
ROLES = ["Frontend Developer", "Front-End Developer (m/f/d)", "React.js Engineer", "Software Engineer", "PHP Developer", "Full Stack Dev", "QA Engineer - Remote", "IT Officer", "Sales Manager", "Développeur React", "Graduate Programmer", "Technical Support Engineer", "C++ Developer"]
COMPANIES = ["Acme Inc.", "ACME, LLC", "Globex GmbH", "Initech Pvt. Ltd.", "Hooli", None, "Umbrella Corp", "Café Ltd", "Stark Co Limited", " "]
PLACES = ["Kathmandu, Nepal", "Remote - Worldwide", "Berlin, Germany", None, "New York, USA", "APAC", "", "Lalitpur", "Remote, Europe", "Pokhara", "Remote - Canada"]
RESTRICTIONS = [None, "NP", "Nepal;India", "USA", "Worldwide", "Asia", " ;", None]
MODES = ["remote", "unknown", "hybrid", "remote", "onsite"]
PAY = [None, "$40k - $60k per year", "NPR 30,000 - 50,000", "€25/hour", "Rs. 800,000", "£1,500 per month", "USD 120-150k", "competitive", "₹ 90000 monthly"]
PHRASES = [
    "", " Please apply with your CV to jobs@acme.io.", " 3+ years of professional experience required.", " Must be based in the United States.", " Work from anywhere. No experience needed.",
    " Pay a registration fee of $50.", " We hire worldwide but remote in Europe only.", " Experience with React and TypeScript, 1-2 years.", " Contact on telegram only.", " US only.",
    " 5 years experience preferred. Send resume to noreply@x.com or to hr@globex.com!", " We cannot hire in Nepal.",
]
APPLY = [None, "https://boards.greenhouse.io/acme/jobs/1", "mailto:jobs@hooli.com?subject=x", "https://www.linkedin.com/jobs/2", "https://careers.acme.io/apply", "https://jobs.lever.co/globex/3", None]
WEBSITES = [None, "https://www.acme.io/about", "https://hooli.com", "https://globex.co.uk"]
EMAILS = [None, None, None, "me@gmail.com", None, "jobs@globex.com", None, None, None, None, None]
HINTS = [None, "Senior", "Entry level", None, "Mid-Senior"]

OPPORTUNITIES = f"""
SELECT doc_id AS id, {pick('doc_id', SOURCES)} AS source,
  concat({pick('doc_id * 5 + 1', LEVELS)}, {pick('doc_id * 3', ROLES)}) AS title,
  {pick('doc_id * 7', COMPANIES)} AS company_name, {pick('doc_id', PLACES)} AS location_text,
  {pick('doc_id * 3', RESTRICTIONS)} AS restrictions, {pick('doc_id', MODES)} AS remote_type,
  {pick('doc_id * 4', PAY)} AS pay_text, {pick('doc_id', APPLY)} AS apply_url, {pick('doc_id * 3', WEBSITES)} AS company_website,
  {pick('doc_id', EMAILS)} AS apply_email, {pick('doc_id', HINTS)} AS seniority_hint,
  concat(coalesce(text, ''), {pick('doc_id * 5', PHRASES)}) AS description,
  CASE WHEN doc_id % 13 = 0 THEN NULL ELSE {NOW_HOUR} - (doc_id * 17) % 1200 END AS posted_hour,
  CASE WHEN doc_id % 19 = 0 THEN {NOW_HOUR} - 500 + (doc_id * 31) % 900 END AS expires_hour,
  {NOW_HOUR} - (doc_id * 29) % 1500 AS first_seen_hour,
  CAST((doc_id * 37) % 101 AS INT) AS match_score, CAST((doc_id * 53) % 101 AS INT) AS prescore_value,
  {pick('doc_id * 7', ['new', 'analyzed', 'filtered_out', 'awaiting_ai', 'duplicate', 'analyzed', 'analysis_failed', 'processing'])} AS pipeline_status,
  {pick('doc_id * 5', ['auto_apply_candidate', 'approval_required', 'ignore', 'blocked', 'manual_apply', None])} AS recommendation,
  {pick('doc_id * 11', ['none', 'pending_approval', 'ready_to_apply', 'applied', 'rejected', 'dismissed', 'auto_apply_disabled', 'approved', 'none'])} AS review_status,
  {pick('doc_id', ['eligible', 'likely_eligible', 'unclear', 'not_eligible', None])} AS eligibility,
  CAST(doc_id % 5 AS INT) AS analysis_attempts, doc_id % 40 + 1 AS run_id, CASE WHEN doc_id % 4 = 0 THEN doc_id % 40 + 1 END AS last_processed_run_id
FROM documents
"""

TASKS = f"""
SELECT event_id AS id, event_id % 40 + 1 AS run_id, {pick('event_id * 5', ['feed', 'page', 'ats_board', 'search', 'local_board', 'page'])} AS kind,
  {pick('event_id', SOURCES)} AS source, {pick('event_id * 3', ['ok', 'ok', 'failed', 'pending', 'skipped', 'running', 'blocked'])} AS status,
  CAST(event_id % 5 AS INT) AS priority, CAST((event_id * 13) % 23 AS INT) AS items_found, CAST((event_id * 13) % 23 - (event_id * 13) % 3 AS INT) AS items_new,
  CASE WHEN event_id % 8 = 6 THEN concat('timeout ', CAST(event_id % 10 AS STRING)) END AS error,
  {NOW_HOUR} - event_id % 400 AS finished_hour, {NOW_HOUR} - event_id % 400 - 1 AS created_hour, user_id, event_type, CAST(event_id % 4 AS INT) AS attempts
FROM events
"""

USAGE = f"""
SELECT l_orderkey * 8 + l_linenumber AS id, l_orderkey % 40 + 1 AS run_id, {pick('l_linenumber', ['analyze', 'extract', 'discovery', 'materials'])} AS purpose,
  {pick('l_suppkey', ['large', 'large-next-2', 'medium-1', 'small', 'other'])} AS model, l_partkey AS opportunity_id,
  CAST(l_quantity AS BIGINT) * 100 AS tokens_in, CAST(l_quantity AS BIGINT) * 7 AS tokens_out, l_suppkey % 50 AS cache_read, l_partkey % 30 AS cache_write,
  CAST(l_linenumber % 3 AS INT) AS searches, CAST(floor(l_extendedprice) AS BIGINT) AS cost_micro, {NOW_HOUR} - (l_orderkey * 8 + l_linenumber) % 1000 AS at_hour
FROM lineitem
"""

APPLICATIONS = f"""
SELECT o_orderkey AS id, o_orderkey % 500 AS opportunity_id, {pick('o_orderkey * 7', COMPANIES)} AS company_name,
  concat({pick('o_orderkey', LEVELS)}, {pick('o_orderkey * 5', ROLES)}) AS title,
  {pick('o_orderkey * 3', ['applied', 'interviewing', 'withdrawn', 'rejected', 'offer', 'odd'])} AS status, {NOW_HOUR} - (o_orderkey * 61) % 12000 AS applied_hour
FROM orders
"""

BOARDS = f"""
SELECT c_custkey AS id, {pick('c_custkey', ['greenhouse', 'lever', 'ashby', 'workable'])} AS provider, concat('company-', CAST(c_custkey AS STRING)) AS slug,
  CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE {NOW_HOUR} - c_custkey % 300 END AS last_fetched_hour, CAST(c_custkey % 7 AS INT) AS failures,
  c_custkey % 9 <> 0 AS enabled, CAST((c_custkey * 13) % 40 AS INT) AS relevant_jobs, c_nationkey, c_mktsegment
FROM customer
"""

LINKS = f"""
SELECT page_id AS id, CASE page_id % 12
    WHEN 0 THEN concat('https://boards.greenhouse.io/', CAST(page_id % 50 AS STRING), 'co/jobs/', CAST(page_id AS STRING))
    WHEN 1 THEN concat('https://jobs.lever.co/team', CAST(page_id % 30 AS STRING), '/x?lever-source=a')
    WHEN 2 THEN 'https://www.facebook.com/groups/1' WHEN 3 THEN concat(url, '.pdf')
    WHEN 4 THEN 'ftp://example.com/x' WHEN 5 THEN concat('https://company', CAST(page_id % 20 AS STRING), '.recruitee.com/o/dev')
    WHEN 6 THEN 'https://boards.greenhouse.io/embed/job_board?for=acme&b=2' ELSE url END AS url,
  {pick('page_id', ['search', 'local_board:merojob', 'page', 'hackernews'])} AS via, page_id % 40 + 1 AS run_id, {NOW_HOUR} - (page_id * 7) % 900 AS seen_hour,
  {pick('page_id * 3', ['pending', 'fetched', 'lead_only', 'failed', 'skipped'])} AS status, CAST(page_id % 5 AS INT) AS attempts
FROM pages
"""

#: Name: SQL and the given table that it reads.
TABLES = {
    "opportunities": (OPPORTUNITIES, "documents"),
    "tasks": (TASKS, "events"),
    "usage": (USAGE, "lineitem"),
    "applications": (APPLICATIONS, "orders"),
    "boards": (BOARDS, "customer"),
    "links": (LINKS, "pages"),
}


def derived(spark: SparkSession, sf_dir: str, name: str, given: DataFrame | None = None) -> DataFrame:
    """A derived table, of `given` (a stream, say) instead of the stored table where that is set."""
    sql, base = TABLES[name]
    sql = sql.replace("{", "{{").replace("}", "}}")
    return spark.sql(sql.replace(f"FROM {base}", "FROM {given}"), given=table(spark, sf_dir, base) if given is None else given)


def with_tables(sql: str, *names: str) -> str:
    """The SQL of a DuckDB query with derived tables in front."""
    ctes = ", ".join(f"{n} AS ({TABLES[n][0]})" for n in names)
    if sql.lstrip().upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {ctes}, {sql.lstrip()[15:]}"
    return f"WITH {ctes} {sql}" if not sql.lstrip().upper().startswith("WITH ") else f"WITH {ctes}, {sql.lstrip()[5:]}"
