"""Queries on single postings: forms, URLs, pay, classes, rules, decisions. Each with SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.config import DEFAULT as C
from gleanery.functions import classify, money, text, urls
from gleanery.operators import rules
from gleanery.plans import oracle as o
from gleanery.plans import postings
from gleanery.plans.derived import NOW_HOUR, PHRASES, derived, with_tables
from gleanery.plans.report_queries import SIMILAR_PRIOR
from gleanery.session import table

col = F.col


def opportunities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, "opportunities")


def posting_forms(spark, sf_dir):
    rows = postings.formed(opportunities(spark, sf_dir))
    return rows.select("id", "company_norm", "title_norm", "fingerprint", text.slug(col("title_folded")).alias("slug"))


POSTING_FORMS = f"""
SELECT id, {o.company('company_name')} AS company_norm, {o.title('title')} AS title_norm,
  sha1(concat({o.company('company_name')}, '|', {o.title('title')})) AS fingerprint,
  coalesce(nullif(left(trim(regexp_replace({o.fold('title')}, '[^a-z0-9]+', '-', 'g'), '-'), 40), ''), 'unknown') AS slug
FROM opportunities
"""


def folded_texts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.sha2(text.fold(col("text")), 256).alias("folded"), F.length(text.clean(col("text"))).cast("long").alias("clean_chars"))


FOLDED_TEXTS = f"""
SELECT doc_id, sha256({o.fold('text')}) AS folded,
  length(trim(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '[ \\t]+', ' ', 'g'), ' ?\\n ?', chr(10), 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), ' ' || chr(10))) AS clean_chars
FROM documents
"""


def url_forms(spark, sf_dir):
    rows = table(spark, sf_dir, "pages")
    u = col("url")
    return rows.select("page_id", urls.host(u).alias("host"), urls.registrable(u).alias("domain"), urls.canonical(u).alias("canonical"), urls.url_key(u).alias("url_hash"), urls.redacted(u).alias("redacted"), urls.page_label(u).alias("label"))


_QUERY = "list_sort(list_filter(string_split(regexp_extract(url, '\\?([^#]*)', 1), '&'), lambda p: regexp_matches(p, '^[^=]+=.+') AND NOT regexp_matches(lower(p), '^(utm_[^=]*|ref|source|src|via|trk|campaign|medium)=')))"
_PATH = "regexp_replace(coalesce(nullif(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), ''), '/'), '/{2,}', '/', 'g')"
URL_FORMS = f"""
WITH u AS (SELECT page_id, url, {o.host('url')} AS host, {_PATH} AS path, array_to_string({_QUERY}, '&') AS query FROM pages),
c AS (SELECT *, concat('https://', host, CASE WHEN length(path) > 1 THEN rtrim(path, '/') ELSE path END, CASE WHEN query = '' THEN '' ELSE '?' || query END) AS canonical FROM u)
SELECT page_id, host, array_to_string(list_slice(string_split(host, '.'), -2, -1), '.') AS domain, canonical, sha256(canonical) AS url_hash,
  regexp_replace(url, '[?#].*$', '') AS redacted, concat(host, left(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), 80)) AS label FROM c
"""


def board_links(spark, sf_dir):
    rows = derived(spark, sf_dir, "links").withColumn("b", urls.board(col("url")))
    return rows.select("id", "b.provider", "b.slug", urls.slug_title(col("url")).alias("title"))


#: Provider and slug of the hosts that the links name, read from the address.
BOARD = "CASE WHEN contains(url, 'greenhouse.io/embed') THEN 'greenhouse/' || regexp_extract(url, 'for=([a-z0-9]+)', 1) WHEN contains(url, 'greenhouse.io/') THEN 'greenhouse/' || regexp_extract(url, '//[^/]*/([^/?]*)', 1) WHEN contains(url, 'lever.co/') THEN 'lever/' || regexp_extract(url, '//[^/]*/([^/?]*)', 1) WHEN contains(url, '.recruitee.com') THEN 'recruitee/' || regexp_extract(url, '//([^.]*)', 1) END"
BOARD_LINKS = f"""
SELECT id, nullif(split_part({BOARD}, '/', 1), '') AS provider, nullif(split_part({BOARD}, '/', 2), '') AS slug,
  trim(regexp_replace(regexp_replace(list_last(string_split(rtrim(regexp_replace(url, '[?#].*$', ''), '/'), '/')), '-[0-9]+$', ''), '[-_]+', ' ', 'g')) AS title
FROM links
"""


def pay_monthly(spark, sf_dir):
    rows = postings.formed(opportunities(spark, sf_dir))
    return rows.select("id", "pay.currency", "pay.period", col("pay.min").alias("low"), col("pay.max").alias("high"), "pay_min", "pay_max", money.pay_label(col("pay_min"), col("pay_max")).alias("label"))


_PAY = money.SALARY.replace("(?i)", "").replace("'", "''")
_NUMBER = lambda x, k: f"try_cast(replace(nullif(p.{x}, ''), ',', '') AS DOUBLE) * CASE WHEN {k} THEN 1000 ELSE 1 END"
_SIGNS = "CASE lower(trim(p.sign)) WHEN '$' THEN 'USD' WHEN 'us$' THEN 'USD' WHEN '€' THEN 'EUR' WHEN '£' THEN 'GBP' WHEN '₹' THEN 'INR' WHEN 'rs' THEN 'NPR' WHEN 'rs.' THEN 'NPR' ELSE upper(p.sign) END"
_RATE = f"CASE currency {' '.join(f'WHEN {o.q(k)} THEN {v}' for k, v in C.fx.items())} END * CASE period WHEN 'hour' THEN 160.0 WHEN 'day' THEN 21.67 WHEN 'week' THEN 4.33 WHEN 'month' THEN 1.0 WHEN 'year' THEN 1.0 / 12 END"
PAY_MONTHLY = f"""
WITH m AS (SELECT id, regexp_extract(lower(coalesce(pay_text, '')), '{_PAY}', ['sign', 'low', 'lk', 'high', 'hk', 'tail']) AS p FROM opportunities),
n AS (SELECT id, p.tail AS tail, {_SIGNS} AS currency, {_NUMBER('low', "p.lk <> ''")} AS low, {_NUMBER('high', "coalesce(nullif(p.hk, ''), p.lk) <> ''")} AS high FROM m WHERE p.low <> ''),
g AS (SELECT *, CASE WHEN regexp_matches(tail, 'per hour|/ *hr|/ *hour|hourly') THEN 'hour' WHEN regexp_matches(tail, 'per day|/ *day|daily') THEN 'day' WHEN regexp_matches(tail, 'per week|weekly') THEN 'week' WHEN regexp_matches(tail, 'per month|/ *mo|monthly') THEN 'month' WHEN regexp_matches(tail, 'per year|/ *yr|annual|yearly') THEN 'year'
  WHEN currency = 'NPR' THEN CASE WHEN coalesce(high, low) >= 600000 THEN 'year' ELSE 'month' END WHEN coalesce(high, low) < 250 THEN 'hour' WHEN coalesce(high, low) < 20000 THEN 'month' ELSE 'year' END AS period FROM n),
h AS (SELECT *, round_even(low * {_RATE}, 0) AS pay_min, round_even(high * {_RATE}, 0) AS pay_max FROM g)
SELECT id, currency, period, low, high, pay_min, pay_max, CASE WHEN pay_min IS NULL AND pay_max IS NULL THEN '' WHEN pay_min IS NOT NULL AND pay_max IS NOT NULL AND pay_min <> pay_max THEN format('NPR {{:,}}-{{:,}}/mo', CAST(pay_min AS BIGINT), CAST(pay_max AS BIGINT)) ELSE format('NPR {{:,}}/mo', CAST(coalesce(pay_min, pay_max) AS BIGINT)) END AS label
FROM (SELECT id FROM opportunities) LEFT JOIN h USING (id)
"""


def work_classes(spark, sf_dir):
    rows = postings.folded(opportunities(spark, sf_dir))
    start = text.fold(F.substring("description", 1, 2000))
    mode = classify.work_mode_or([col("title_folded"), col("location_folded")], start)
    return rows.select("id", mode.alias("mode"), classify.employment(F.concat_ws(" ", "title_folded", "description_folded")).alias("employment"))


_MODE = lambda x: o.classes(o.fold(x), {k: p.replace("(?:", "(") for k, p in classify.MODES.items()}, "unknown")
WORK_CLASSES = f"""
SELECT id, CASE WHEN {_MODE("concat_ws(' ', title, location_text)")} <> 'unknown' THEN {_MODE("concat_ws(' ', title, location_text)")} ELSE {_MODE('left(description, 2000)')} END AS mode,
  {o.employment("concat_ws(' ', title, description)")} AS employment
FROM opportunities
"""


def posting_relevance(spark, sf_dir):
    rows = postings.folded(opportunities(spark, sf_dir))
    local = rules.home_local(col("location_folded"), col("source"))
    out = rows.select("id", local.alias("local"), rules.relevance(col("title_folded"), col("description_folded"), local).alias("r"))
    return out.select("id", "local", "r.ok", "r.reason")


_GENERIC = f"(regexp_matches({o.fold('title')}, '\\b(developer|engineer|programmer|intern|trainee|graduate)\\b') AND regexp_matches({o.fold('description')}, '\\b(react|typescript|javascript|frontend|front-end|next\\.?js)\\b'))"
RELEVANCE_CTE = f"""
f AS (SELECT *, {o.LOCAL} AS local, {o.first_term(o.fold('title'), C.exclude_title_terms)} AS excluded, {o.first_term(o.fold('title'), C.include_title_terms)} AS inc,
  {o.first_term(o.fold('title'), C.home_extra_include_terms)} AS extra, {_GENERIC} AS generic FROM opportunities),
r AS (SELECT *, excluded IS NOT NULL AND NOT (local AND excluded IN ({', '.join(map(o.q, C.home_relaxed_exclude_terms))})) AS stopped, coalesce(inc, CASE WHEN local THEN extra END) AS included FROM f)
"""
POSTING_RELEVANCE = f"""
WITH {RELEVANCE_CTE}
SELECT id, local, NOT stopped AND (included IS NOT NULL OR generic) AS ok,
  CASE WHEN stopped THEN concat('Title matches excluded term ''', excluded, '''') WHEN included IS NOT NULL THEN concat('Title matches target term ''', included, '''')
       WHEN generic THEN 'Generic technical title and posting mentions the candidate''s stack' ELSE 'Title is not related to the target roles' END AS reason
FROM r
"""


def posting_seniority(spark, sf_dir):
    rows = postings.folded(opportunities(spark, sf_dir))
    out = rows.select("id", rules.seniority(col("title_folded"), col("description_folded")).alias("s"), rules.hint_blocks(col("seniority_hint"), col("title_folded")).alias("hint_blocks"))
    return out.select("id", "s.blocked", F.array_join("s.reasons", "; ").alias("reasons"), "s.required_years", "s.junior_title", "hint_blocks")


_JUNIOR = f"regexp_matches({o.fold('title')}, '\\b(junior|jr|entry[- ]level|intern|internship|trainee|graduate|apprentice|associate)\\b')"
_RE2 = lambda p: p.replace("(?<![\\d.])", "(^|[^0-9.])").replace("(?![- ]old)", "").replace("'", "''")
#: The largest number of years in a sentence about experience that is not optional.
_YEARS = f"""list_max(list_filter(flatten(list_transform(list_filter(regexp_split_to_array({o.fold('description')}, '[.\\n;•]|\\s-\\s'), lambda v: regexp_matches(v, '{_RE2(rules.EXPERIENCE)}') AND NOT regexp_matches(v, '{_RE2(rules.OPTIONAL)}')),
  lambda v: list_transform(regexp_extract_all(v, '{_RE2(rules.YEARS)}', 2), lambda y: CAST(y AS INT)))), lambda y: y <= 20))"""
SENIORITY_CTE = f"""
s AS (SELECT *, {o.first_term(o.fold('title'), C.blocked_title_terms)} AS term, {_JUNIOR} AS junior_title, {_YEARS} AS required_years FROM opportunities)
"""
POSTING_SENIORITY = f"""
WITH {SENIORITY_CTE}
SELECT id, (term IS NOT NULL AND NOT junior_title) OR coalesce(required_years > 2, false) AS blocked,
  concat_ws('; ', CASE WHEN term IS NOT NULL AND NOT junior_title THEN concat('Senior-level title (''', term, ''')') END, CASE WHEN required_years > 2 THEN concat('Requires ', CAST(required_years AS VARCHAR), '+ years of experience (limit 2)') END) AS reasons,
  required_years, junior_title, coalesce(seniority_hint IN ('Senior', 'Mid-Senior'), false) AND NOT junior_title AS hint_blocks
FROM s
"""


def posting_eligibility(spark, sf_dir):
    rows = postings.formed(opportunities(spark, sf_dir))
    out = rows.select("id", rules.eligibility(col("location_text"), col("location_folded"), col("location_restrictions"), col("remote_type"), col("description"), col("description_folded")).alias("e"))
    return out.select("id", "e.status", "e.explicit", "e.onsite_home")


_P, _D = o.fold("location_text"), o.fold("description")
ELIGIBILITY_CTE = f"""
e0 AS (SELECT *, (id * 5) % {len(PHRASES)} AS phrase, {_P} AS place, {_D} AS folded, nullif(trim(restrictions, ' ;.,-'), '') AS regions FROM opportunities),
e1 AS (SELECT *, {o.any_term('place', C.home_terms)} AS home, regexp_matches(folded, '\\b(cannot|not) hire in nepal\\b') AS banned,
  regexp_matches(description, '\\bUS[ -]*only\\b') OR regexp_matches(folded, '\\bmust be based in the united states\\b') OR regexp_matches(folded, '\\beurope only\\b') AS restricted,
  {o.any_term('folded', C.open_terms)} AS is_open FROM e0),
e AS (SELECT *, CASE
  WHEN banned THEN 'not_eligible/1/0' WHEN remote_type IN ('onsite', 'hybrid') AND home THEN 'eligible/1/1' WHEN remote_type IN ('onsite', 'hybrid') AND place <> '' THEN 'not_eligible/1/0'
  WHEN regions IS NOT NULL THEN CASE WHEN regions IN ('Nepal;India', 'NP') OR regions = 'Worldwide' THEN 'eligible/1/0' WHEN regions = 'Asia' THEN 'likely_eligible/0/0' ELSE 'not_eligible/1/0' END
  WHEN home THEN 'eligible/1/0' WHEN {o.any_term('place', C.positive_terms)} THEN 'eligible/1/0' WHEN {o.any_term('place', C.region_includes)} THEN 'likely_eligible/0/0'
  WHEN {o.any_term('place', C.region_excludes)} THEN 'not_eligible/1/0' WHEN {o.any_term('folded', ['nepal'])} THEN 'eligible/1/0'
  WHEN restricted AND is_open THEN 'unclear/0/0' WHEN restricted THEN 'not_eligible/1/0' WHEN is_open THEN 'eligible/0/0'
  WHEN {o.any_term('folded', C.region_includes)} THEN 'likely_eligible/0/0' ELSE 'unclear/0/0' END AS verdict FROM e1)
"""
POSTING_ELIGIBILITY = f"""
WITH {ELIGIBILITY_CTE}
SELECT id, split_part(verdict, '/', 1) AS status, split_part(verdict, '/', 2) = '1' AS explicit, split_part(verdict, '/', 3) = '1' AS onsite_home FROM e
"""


def posting_apply(spark, sf_dir):
    rows = opportunities(spark, sf_dir)
    out = rows.select("id", rules.apply_method(col("apply_url"), col("apply_email"), col("description")).alias("a"), rules.domain_to_check(col("company_website"), col("apply_url"), col("source")).alias("domain"))
    return out.select("id", "a.method", "a.email", "domain")


#: The first address in a sentence about applying that is no office of its own.
_WRITTEN = f"""list_filter(flatten(list_transform(list_filter(string_split(regexp_replace(description, '([.!?])\\s+', '\\1' || chr(10), 'g'), chr(10)), lambda v: regexp_matches(lower(v), '{_RE2(rules.APPLY_WORDS)}')),
  lambda v: regexp_extract_all(v, '{text.EMAIL}'))), lambda v: NOT regexp_matches(v, '{_RE2(rules.NO_APPLY_EMAIL)}'))[1]"""
POSTING_APPLY = f"""
WITH x AS (SELECT *, {o.host('apply_url')} AS h, {o.host('company_website')} AS w FROM opportunities),
y AS (SELECT *, (apply_url IS NULL AND apply_email IS NULL) AS reads, {_WRITTEN} AS written FROM x)
SELECT id, CASE WHEN apply_email IS NOT NULL OR starts_with(apply_url, 'mailto:') THEN 'email' WHEN {o.on_domains('h', C.ats_domains)} THEN 'ats_form' WHEN h = 'linkedin.com' THEN 'login_required'
    WHEN apply_url IS NOT NULL THEN 'external_form' WHEN written IS NOT NULL THEN 'email' ELSE 'unclear' END AS method,
  CASE WHEN apply_email IS NOT NULL THEN apply_email WHEN starts_with(apply_url, 'mailto:') THEN split_part(substr(apply_url, 8), '?', 1) WHEN reads THEN written END AS email,
  CASE WHEN source NOT IN ('remotive', 'himalayas') THEN coalesce(CASE w WHEN 'acme.io' THEN 'acme.io' WHEN 'hooli.com' THEN 'hooli.com' WHEN 'globex.co.uk' THEN 'globex.co.uk' END, CASE WHEN h = 'careers.acme.io' THEN 'acme.io' END) END AS domain
FROM y
"""


def posting_legitimacy(spark, sf_dir):
    rows = postings.ruled(postings.formed(opportunities(spark, sf_dir)), NOW_HOUR)
    return rows.select("id", "legit.score", "legit.verdict", F.size("legit.flags").alias("n_flags"))


_TEXT = o.fold("concat_ws(chr(10), title, description)")
LEGITIMACY_CTE = f"""
l0 AS (SELECT *, {o.host('apply_url')} AS h, {o.host('company_website')} AS w, {_TEXT} AS whole FROM opportunities),
l1 AS (SELECT *, list_filter([
  CASE WHEN {o.on_domains('h', C.ats_domains)} THEN 20 END, CASE WHEN source IN ({', '.join(map(o.q, C.curated_sources))}) THEN 5 END, CASE WHEN w <> '' THEN 5 END,
  CASE WHEN w = 'acme.io' AND h = 'careers.acme.io' THEN 10 END, CASE WHEN trim(coalesce(company_name, '')) = '' THEN -15 END,
  {', '.join(f"CASE WHEN {o.any_term('whole', [t])} THEN -40 END" for t in C.strong_red_flags)},
  {', '.join(f"CASE WHEN {o.any_term('whole', [t])} THEN -12 END" for t in C.weak_red_flags)},
  CASE WHEN apply_email = 'me@gmail.com' THEN -10 END, CASE WHEN length(description) < 250 THEN -8 END,
  CASE WHEN pay_text = 'USD 120-150k' AND {o.any_term('whole', ['no experience'])} THEN -15 END], lambda v: v IS NOT NULL) AS deltas, {o.any_term('whole', C.strong_red_flags)} AS scam FROM l0),
l AS (SELECT *, CAST(greatest(0, least(100, 60 + coalesce(list_sum(deltas), 0))) AS INT) AS score FROM l1)
"""
POSTING_LEGITIMACY = f"""
WITH {LEGITIMACY_CTE}
SELECT id, score, CASE WHEN scam OR score < 40 THEN 'suspicious' WHEN score < 65 THEN 'uncertain' ELSE 'legitimate' END AS verdict, CAST(len(deltas) AS INT) AS n_flags FROM l
"""


def queue_scores(spark, sf_dir):
    rows = postings.ruled(postings.formed(opportunities(spark, sf_dir)), NOW_HOUR)
    return rows.select("id", "queue.score")


_T = o.fold("title")
_TIER = "CASE " + " ".join(f"WHEN {o.any_term(_T, terms)} THEN {p}" for p, terms in C.title_tiers) + " ELSE -10 END"
_STACK = " + ".join(f"CAST({o.any_term('hay', [t])} AS INT)" for t in C.stack_terms)
QUEUE_SCORES = f"""
WITH {ELIGIBILITY_CTE}, h AS (SELECT *, concat({_T}, chr(10), left(folded, 6000)) AS hay FROM e)
SELECT id, CAST(greatest(0, least(100, 40 + {_TIER}
  + CASE WHEN regexp_matches({_T}, '\\b(junior|jr|entry[- ]level|intern|internship|trainee|graduate|apprentice|associate|fresher)\\b') THEN 15
         WHEN regexp_matches({_T}, '\\b(senior|sr|staff|principal|lead|head|director|architect|manager|expert)\\b') THEN -25 ELSE 0 END
  + least(15, 3 * ({_STACK})) + CASE split_part(verdict, '/', 1) WHEN 'eligible' THEN 12 WHEN 'likely_eligible' THEN 6 WHEN 'not_eligible' THEN -30 ELSE 0 END
  + CASE WHEN remote_type = 'remote' THEN 5 ELSE 0 END + CASE WHEN {o.any_term('place', C.home_places[:5])} THEN 10 ELSE 0 END
  + CASE WHEN pay_text IS NOT NULL AND pay_text <> 'competitive' THEN 4 ELSE 0 END + CASE WHEN source IN ({', '.join(map(o.q, C.trusted_sources))}) THEN 4 ELSE 0 END
  - CASE WHEN length(folded) < 200 THEN 8 ELSE 0 END)) AS INT) AS score
FROM h
"""

#: The analysts' verdicts, derived from the documents in SQL that both engines read.
ANALYSIS = """
SELECT doc_id AS id, CAST((doc_id * 7) % 130 - 10 AS DOUBLE) AS skills_match, CAST((doc_id * 11) % 101 AS DOUBLE) AS experience_fit, CAST(60 + (doc_id * 13) % 41 AS DOUBLE) AS role_fit,
  CASE WHEN doc_id % 17 = 0 THEN NULL ELSE CAST((doc_id * 3) % 101 AS DOUBLE) END AS growth_value, doc_id % 23 <> 0 AS is_real, doc_id % 29 = 0 AS senior_mismatch,
  CASE (doc_id * 3) % 4 WHEN 0 THEN 'eligible' WHEN 1 THEN 'likely_eligible' WHEN 2 THEN 'unclear' ELSE 'not_eligible' END AS eligibility_verdict, concat('says ', CAST(doc_id % 7 AS STRING)) AS eligibility_evidence,
  CASE (doc_id * 5) % 6 WHEN 0 THEN 'uncertain' WHEN 1 THEN 'suspicious' ELSE 'legitimate' END AS legitimacy_verdict, split('thin,vague', ',') AS concerns,
  CASE doc_id % 3 WHEN 0 THEN 'remote' WHEN 1 THEN 'onsite' ELSE 'hybrid' END AS remote_verdict, CASE doc_id % 5 WHEN 0 THEN 'internship' ELSE 'full_time' END AS employment_verdict,
  CASE WHEN doc_id % 31 = 0 THEN 4 WHEN doc_id % 7 = 0 THEN 2 END AS required_years, CASE (doc_id * 11) % 4 WHEN 0 THEN 'unclear' WHEN 1 THEN 'external_form' ELSE 'email' END AS application_method,
  CASE WHEN doc_id % 5 = 4 THEN 'made@up.example' ELSE upper(regexp_extract(coalesce(text, ''), '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+[.][A-Za-z]+', 0)) END AS application_email
FROM documents
"""


def staged(spark, sf_dir):
    return postings.staged(postings.formed(opportunities(spark, sf_dir)), derived(spark, sf_dir, "applications"), NOW_HOUR)


def rule_stage(spark, sf_dir):
    """Where the rules stop each posting, by source."""
    return staged(spark, sf_dir).groupBy("source", "stop.stop_stage", "stop.status").agg(F.count(F.lit(1)).alias("postings"), F.sum("queue.score").alias("queue_total"))


def rule_outcomes(spark, sf_dir):
    """The postings that the first two stages stop."""
    return postings.first_stopped(postings.formed(opportunities(spark, sf_dir)), NOW_HOUR).select("id", "stop.stop_stage", "stop.status", "stop.recommendation")


RULE_OUTCOMES = f"""
WITH {RELEVANCE_CTE}, x AS (SELECT *, coalesce(expires_hour < {NOW_HOUR}, false) OR coalesce(posted_hour < {NOW_HOUR} - 720, false) AS is_stale, NOT stopped AND (included IS NOT NULL OR generic) AS ok FROM r)
SELECT id, CASE WHEN is_stale THEN 'stale' ELSE 'relevance' END AS stop_stage, 'filtered_out' AS status, CAST(NULL AS VARCHAR) AS recommendation FROM x WHERE is_stale OR NOT ok
"""


def decisions(spark, sf_dir):
    """Match scores and decisions of the postings that passed the rules."""
    analysis = spark.sql(ANALYSIS.replace("FROM documents", "FROM {given}"), given=table(spark, sf_dir, "documents"))
    rows = postings.open_rows(postings.formed(opportunities(spark, sf_dir)), NOW_HOUR)
    rows = postings.decided(postings.staged(rows, derived(spark, sf_dir, "applications"), NOW_HOUR), analysis)
    return rows.select("id", "match.score", "merged.status", "legit.verdict", "decision.recommendation", "next_review", F.size("blocked_by").alias("n_blockers"), F.size("decision.auto_blockers").alias("n_auto_blockers"))


#: Each rule's own SQL by posting, and where the chain of them stops.
STOPS = f"""rel AS ({POSTING_RELEVANCE}), sen AS ({POSTING_SENIORITY}), eli AS ({POSTING_ELIGIBILITY}), leg AS (WITH {LEGITIMACY_CTE} SELECT id, score AS legit_score, scam FROM l), que AS ({QUEUE_SCORES}), pri AS ({SIMILAR_PRIOR}), mon AS ({PAY_MONTHLY}), app AS ({POSTING_APPLY}),
st AS (SELECT v.*, rel.local, eli.status AS rule, eli.onsite_home, legit_score, scam, que.score AS queue_score, mon.pay_min AS low, mon.pay_max AS high, app.method, app.email, CASE WHEN coalesce(expires_hour < {NOW_HOUR}, false) OR coalesce(posted_hour < {NOW_HOUR} - 720, false) THEN 'stale' WHEN NOT rel.ok THEN 'relevance'
    WHEN sen.blocked OR sen.hint_blocks THEN 'seniority' WHEN eli.status = 'not_eligible' AND eli.explicit THEN 'eligibility' WHEN scam THEN 'scam' WHEN application_id IS NOT NULL THEN 'prior_application' ELSE 'passed' END AS stop_stage
  FROM opportunities v JOIN rel USING (id) JOIN sen USING (id) JOIN eli USING (id) JOIN leg USING (id) JOIN que USING (id) JOIN pri USING (id) JOIN mon USING (id) JOIN app USING (id))"""
RULE_STAGE = f"""WITH {STOPS} SELECT source, stop_stage, CASE WHEN stop_stage = 'passed' THEN 'awaiting_ai' ELSE 'filtered_out' END AS status, count(*) AS postings, CAST(sum(queue_score) AS BIGINT) AS queue_total FROM st GROUP BY ALL"""

_RANKED = lambda c: f"CASE {c} WHEN 'not_eligible' THEN 0 WHEN 'unclear' THEN 1 WHEN 'likely_eligible' THEN 2 ELSE 3 END"
_GRADE = lambda s: f"CASE WHEN scam OR {s} < 40 THEN 2 WHEN {s} < 65 THEN 1 ELSE 0 END"
_POINTS = lambda x: f"greatest(0, least(100, coalesce(round_even({x}, 0), 0)))"
_LOW_PAY = "kind IN ('internship', 'part_time')"
#: The analysts' verdicts merged with the rules', the score, the blockers and the decision.
DECISIONS = f"""WITH {STOPS}, an AS ({ANALYSIS}),
a AS (SELECT st.*, an.* EXCLUDE (id), CASE WHEN coalesce(remote_type, 'unknown') = 'unknown' THEN remote_verdict ELSE remote_type END AS mode, CASE WHEN {o.employment('title')} = 'unspecified' THEN employment_verdict ELSE {o.employment('title')} END AS kind,
  CASE WHEN method = 'unclear' AND application_method = 'email' AND application_email <> '' AND contains(lower(coalesce(description, '')), lower(application_email)) THEN 'email' WHEN method = 'unclear' AND application_method NOT IN ('unclear', 'email') THEN application_method ELSE method END AS way_in,
  CASE WHEN method = 'unclear' AND application_method = 'email' AND application_email <> '' AND contains(lower(coalesce(description, '')), lower(application_email)) THEN application_email ELSE email END AS mail FROM st JOIN an ON an.id = st.id WHERE stop_stage = 'passed'),
b AS (SELECT *, eligibility_verdict AS other, CAST(round_even(0.6 * legit_score + 0.4 * CASE legitimacy_verdict WHEN 'legitimate' THEN 80 WHEN 'uncertain' THEN 50 WHEN 'suspicious' THEN 15 ELSE 50 END, 0) AS INT) AS blended FROM a),
c AS (SELECT *, CASE WHEN 'not_eligible' IN (rule, other) AND 'eligible' IN (rule, other) THEN 'unclear' WHEN 'not_eligible' IN (rule, other) THEN 'not_eligible' WHEN rule = 'unclear' THEN other WHEN other = 'unclear' THEN rule WHEN {_RANKED('rule')} <= {_RANKED('other')} THEN rule ELSE other END AS status,
  CASE WHEN legitimacy_verdict = 'suspicious' THEN 'suspicious' ELSE ['legitimate', 'uncertain', 'suspicious'][1 + greatest({_GRADE('legit_score')}, {_GRADE('blended')})] END AS verdict,
  onsite_home OR (mode IN ('onsite', 'hybrid') AND {o.any_term(o.fold('location_text'), C.home_places[:5])}) AS at_home,
  CASE WHEN low IS NULL AND high IS NULL THEN 60 WHEN low >= 40000 THEN 100 WHEN high >= 40000 THEN 85 WHEN coalesce(high, low) >= 20000 THEN CASE WHEN {_LOW_PAY} THEN 75 ELSE 55 END WHEN {_LOW_PAY} THEN 50 ELSE 25 END AS pay FROM b),
e AS (SELECT *, CASE status WHEN 'eligible' THEN 100 WHEN 'likely_eligible' THEN 80 WHEN 'unclear' THEN 50 ELSE 0 END AS fit FROM c),
s AS (SELECT *, CAST({_POINTS(f"{_POINTS('skills_match')} * 35 / 100 + {_POINTS('experience_fit')} * 20 / 100 + {_POINTS('role_fit')} * 15 / 100 + fit * 10 / 100 + pay * 10 / 100 + {_POINTS('growth_value')} * 10 / 100")} AS INT) AS score,
  CAST(NOT is_real AS INT) + CASE WHEN required_years > 2 OR senior_mismatch THEN 1 ELSE 0 END + CAST(status = 'not_eligible' AS INT) + CAST(verdict = 'suspicious' AS INT) + CAST(mode IN ('onsite', 'hybrid') AND NOT at_home AS INT) AS blocks,
  CAST(status NOT IN ('eligible', 'likely_eligible') AS INT) + CAST(verdict <> 'legitimate' AS INT) + CAST(mode <> 'remote' AS INT) AS autos,
  CASE WHEN way_in = 'unclear' THEN 'unclear' WHEN way_in IN ('ats_form', 'external_form', 'login_required') THEN 'manual' WHEN coalesce(mail, '') = '' THEN 'no email' END AS way FROM e),
f AS (SELECT *, CASE WHEN blocks > 0 THEN 'blocked' WHEN score < 70 THEN 'ignore' WHEN score < 85 THEN 'approval_required' WHEN autos = 0 AND way IS NULL THEN 'auto_apply_candidate' WHEN autos = 0 AND way = 'manual' THEN 'manual_apply' ELSE 'approval_required' END AS advice FROM s),
g AS (SELECT *, CASE advice WHEN 'auto_apply_candidate' THEN 'auto_apply_disabled' WHEN 'manual_apply' THEN 'ready_to_apply' WHEN 'approval_required' THEN 'pending_approval' ELSE 'none' END AS review FROM f)
SELECT id, score, status, verdict, advice AS recommendation, CASE WHEN coalesce(review_status, 'none') IN ('none', 'pending_approval', 'ready_to_apply', 'auto_apply_disabled') THEN review ELSE review_status END AS next_review, blocks AS n_blockers,
  CAST(CASE advice WHEN 'blocked' THEN blocks WHEN 'ignore' THEN 1 WHEN 'auto_apply_candidate' THEN 0 ELSE greatest(CAST(score < 85 AS INT), autos + CAST(way IS NOT NULL AS INT)) END AS INT) AS n_auto_blockers FROM g"""

#: name: (query, SQL or None)
QUERIES = {
    "posting_forms": (posting_forms, with_tables(POSTING_FORMS, "opportunities")),
    "folded_texts": (folded_texts, FOLDED_TEXTS),
    "url_forms": (url_forms, URL_FORMS),
    "board_links": (board_links, with_tables(BOARD_LINKS, "links")),
    "pay_monthly": (pay_monthly, with_tables(PAY_MONTHLY, "opportunities")),
    "work_classes": (work_classes, with_tables(WORK_CLASSES, "opportunities")),
    "posting_relevance": (posting_relevance, with_tables(POSTING_RELEVANCE, "opportunities")),
    "posting_seniority": (posting_seniority, with_tables(POSTING_SENIORITY, "opportunities")),
    "posting_eligibility": (posting_eligibility, with_tables(POSTING_ELIGIBILITY, "opportunities")),
    "posting_apply": (posting_apply, with_tables(POSTING_APPLY, "opportunities")),
    "posting_legitimacy": (posting_legitimacy, with_tables(POSTING_LEGITIMACY, "opportunities")),
    "queue_scores": (queue_scores, with_tables(QUEUE_SCORES, "opportunities")),
    "rule_stage": (rule_stage, with_tables(RULE_STAGE, "opportunities", "applications")),
    "rule_outcomes": (rule_outcomes, with_tables(RULE_OUTCOMES, "opportunities")),
    "decisions": (decisions, with_tables(DECISIONS, "opportunities", "applications")),
}
