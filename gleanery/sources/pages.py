"""Web pages and sitemaps to postings and links. A page table has url, html."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gleanery.config import DEFAULT, Config
from gleanery.functions import classify, markup, money, text, urls
from gleanery.functions.dates import parsed
from gleanery.operators import rules
from gleanery.sources.feeds import either, filled

col = F.col
#: Phrases of job pages.
INDICATORS = ["responsibilities", "requirements", "qualifications", "about the role", "what you'll do", "what you will do", "job description", "experience with", "apply now", "how to apply", "we are looking for", "you will", "benefits"]
JSONLD = r"""(?is)<script\b[^>]*type\s*=\s*["']?[^"'>]*ld\+json[^>]*>(.*?)</script\s*>"""


def as_list(json: Column) -> Column:
    """The elements of a JSON list as JSON texts; one element for anything else; none for null."""
    listed = F.from_json(F.when(json.startswith("["), json).otherwise(F.concat(F.lit("["), json, F.lit("]"))), "array<string>")
    return F.when(json.rlike(r"^[\[{]"), listed).when(json.isNotNull(), F.array(json))


def jsonld(html: Column) -> Column:
    """The JobPosting nodes of a page's JSON-LD as JSON texts: scripts, lists and one @graph level."""
    scripts = F.transform(F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(JSONLD), F.lit(1)), lambda x: F.trim(F.regexp_replace(x, r"[\n\r\t]+", " ")))
    listed = lambda json: text.let(json, lambda j: F.coalesce(as_list(j), F.array().cast("array<string>")))
    graph = lambda n: F.when(n.contains("@graph"), listed(F.get_json_object(n, "$.@graph"))).otherwise(F.array().cast("array<string>"))
    nodes = text.let(F.flatten(F.transform(scripts, listed)), lambda some: F.concat(some, F.flatten(F.transform(some, graph))))
    posting = lambda kind: (kind == "JobPosting") | kind.contains('"JobPosting"')
    return F.filter(nodes, lambda n: n.contains("JobPosting") & text.let(F.coalesce(F.get_json_object(n, "$.@type"), F.lit("")), posting))


def place_name(place: Column) -> Column:
    """Name of a schema.org place given as JSON or as a plain text."""
    get = lambda p: filled(F.get_json_object(place, p))
    country = either(F.get_json_object(place, "$.address.addressCountry.name"), F.get_json_object(place, "$.address.addressCountry"))
    address = filled(F.concat_ws(", ", get("$.address.addressLocality"), get("$.address.addressRegion"), country))
    bare = filled(F.concat_ws(", ", get("$.addressLocality"), get("$.addressRegion"), either(F.get_json_object(place, "$.addressCountry.name"), F.get_json_object(place, "$.addressCountry"))))
    plain = F.when(~place.startswith("{"), filled(place))
    text_address = F.when(~get("$.address").startswith("{"), get("$.address"))
    return F.coalesce(plain, F.when(get("$.address").isNull(), get("$.name")), text_address, address, bare, F.lit(""))


def names(json: Column) -> Column:
    return F.filter(F.transform(F.coalesce(as_list(json), F.array().cast("array<string>")), place_name), lambda x: x != "")


#: Pay periods of structured data.
UNITS = {"HOUR": "hour", "DAY": "day", "WEEK": "week", "MONTH": "month", "YEAR": "year"}


def from_jsonld(pages: DataFrame, source: str = "web") -> DataFrame:
    """Postings of the pages' structured data: all of a page that have a title."""
    rows = pages.select("url", F.explode(jsonld(col("html"))).alias("n"))
    g = lambda path: F.get_json_object("n", f"$.{path}")
    org = g("hiringOrganization")
    place = F.array_join(names(g("jobLocation")), "; ")
    rows = rows.select(
        "url", text.html_to_text(g("title")).alias("title"), text.html_to_text(g("description")).alias("description"), place.alias("place"), names(g("applicantLocationRequirements")).alias("location_restrictions"),
        F.when(org.startswith("{"), g("hiringOrganization.name")).otherwise(org).alias("company_name"),
        either(F.when(g("hiringOrganization.sameAs").startswith("["), g("hiringOrganization.sameAs[0]")).otherwise(g("hiringOrganization.sameAs")), g("hiringOrganization.url")).alias("company_website"),
        F.upper(F.coalesce(g("jobLocationType"), F.lit(""))).contains("TELECOMMUTE").alias("tele"), F.regexp_replace(F.coalesce(g("employmentType"), F.lit("")), r'[\[\]"]', " ").alias("kind"),
        either(g("baseSalary.value.minValue"), g("baseSalary.value.value"), F.when(~g("baseSalary.value").startswith("{"), g("baseSalary.value"))).try_cast("double").alias("salary_min"),
        g("baseSalary.value.maxValue").try_cast("double").alias("salary_max"), g("baseSalary.currency").alias("salary_currency"),
        F.coalesce(*[F.when(F.upper(g("baseSalary.value.unitText")) == k, F.lit(v)) for k, v in UNITS.items()]).alias("salary_period"),
        either(g("url"), col("url")).alias("source_url"), parsed(g("datePosted")).alias("posted_at"), parsed(g("validThrough")).alias("expires_at"),
    ).where("title <> ''")
    rows = rows.withColumns({"_t": text.fold(col("title")), "_p": text.fold(col("place")), "_d": text.fold(F.substring("description", 1, 2500)), "_k": text.fold(col("kind"))})
    told = classify.work_mode_or([col("_t"), col("_p")], col("_d"))
    rows = rows.withColumn("remote_type", F.when(col("tele"), "remote").otherwise(F.when((told == "unknown") & (col("place") != ""), "onsite").otherwise(told)))
    return rows.select(
        F.lit(source).alias("source"), "source_url", "title", "company_name", "company_website", F.coalesce(filled(col("place")), F.when(col("remote_type") == "remote", "Remote")).alias("location_text"), "location_restrictions",
        "remote_type", classify.employment(col("_k")).alias("employment_type"), "salary_min", "salary_max", "salary_currency", "salary_period", "description", col("source_url").alias("apply_url"), "posted_at", "expires_at")


#: Letters of a page's main text by which it is routed, and that a description takes from it.
SHOWN = 15_000


def main_text(html: Column, limit: int | None = None) -> Column:
    """Visible text of the main part of a page, all of it or its beginning."""
    whole = text.clean(markup.main_lines(html))
    return whole if limit is None else F.substring(whole, 1, limit)


def looks_like_posting(shown: Column) -> Column:
    """Two of the phrases at least, and a length that fits."""
    count = lambda low: sum((low.contains(p).cast("int") for p in INDICATORS), F.lit(0))
    return text.let(shown, lambda s: (text.let(F.lower(s), count) >= 2) & F.length(s).between(500, 60_000))


def board_links(pages: DataFrame, most: int = 20) -> DataFrame:
    """(page_url, url, provider, slug): the first link to each board on a page, at most `most` a page."""
    rows = pages.select(col("url").alias("page_url"), F.posexplode(markup.hrefs(col("html"))).alias("at", "url")).withColumn("b", urls.board(col("url"))).where("b is not null")
    rows = rows.groupBy("page_url", "b.provider", "b.slug").agg(F.min(F.struct("at", "url")).alias("f"))
    rank = F.row_number().over(W.partitionBy("page_url").orderBy("f.at"))  # a page's own links
    return rows.withColumn("_rank", rank).where(col("_rank") <= most).select("page_url", "f.url", "provider", "slug")


def routed(pages: DataFrame, extractor: bool = True) -> DataFrame:
    """(url, route, note): structured data first, then the look of the text."""
    rows = pages.select("url", F.size(jsonld(col("html"))).alias("n"), main_text(col("html"), SHOWN).alias("shown"))
    rows = rows.select("url", "n", looks_like_posting(col("shown")).alias("like"))
    route = F.when(col("n") > 0, "jsonld").when(col("like") & F.lit(extractor), "extract").otherwise("skipped")
    note = F.when(col("n") > 0, "JSON-LD JobPosting").when(~col("like"), "Page does not look like a single job posting").when(F.lit(extractor), "Extraction needed").otherwise("No structured data; AI extraction unavailable or capped")
    return rows.select("url", route.alias("route"), note.alias("note"))


def enriched(postings: DataFrame, pages: DataFrame) -> DataFrame:
    """Postings with the longer description of their page: structured data first, else a text that looks like one.

    Of a page one part goes to Python: the description in its data, or all of it where it has none. Rows without a text
    are not filtered (the aggregate passes over them), as a filter would read the HTML once more."""
    rows = pages.select(urls.canonical(col("url")).alias("_key"), F.get(jsonld(col("html")), F.lit(0)).alias("n"), "html")
    rows = rows.select("_key", col("n").isNotNull().alias("_has"), F.get_json_object("n", "$.description").alias("_said"), F.when(col("n").isNull(), col("html")).alias("_page"))
    visible = text.let(main_text(col("_page"), SHOWN), lambda s: F.when(looks_like_posting(s), s))
    found = F.when(col("_has"), text.html_to_text(col("_said"))).otherwise(visible)
    rows = rows.select("_key", found.alias("_new")).groupBy("_key").agg(F.max_by("_new", F.length("_new")).alias("_new"))
    out = postings.withColumn("_key", urls.canonical(col("source_url"))).join(rows, "_key", "left")
    better = F.length(F.coalesce("_new", F.lit(""))) > F.length(F.coalesce("description", F.lit("")))
    return out.withColumn("description", F.when(better, col("_new")).otherwise(col("description"))).drop("_key", "_new")


def sitemap_entries(maps: DataFrame) -> DataFrame:
    """(board, at, loc, modified) of sitemap bodies (board, body)."""
    rows = maps.select("board", F.posexplode(F.regexp_extract_all("body", F.lit(r"(?is)<url\b[^>]*>(.*?)</url\s*>"), F.lit(1))).alias("at", "e"))
    tag = lambda n: filled(F.regexp_extract("e", rf"(?is)<{n}\s*>\s*(?:<!\[CDATA\[)?\s*(.*?)\s*(?:\]\]>)?\s*</{n}\s*>", 1))
    return rows.select("board", "at", text.unescape(tag("loc")).alias("loc"), parsed(tag("lastmod")).alias("modified")).where("loc is not null")


def child_sitemaps(indexes: DataFrame, most: int = 3) -> DataFrame:
    """(board, loc): the first children of sitemap indexes (board, body, pattern) that match the pattern."""
    children = F.regexp_extract_all("body", F.lit(r"(?is)<sitemap\b[^>]*>.*?<loc\s*>\s*(.*?)\s*</loc\s*>.*?</sitemap\s*>"), F.lit(1))
    rows = indexes.select("board", "pattern", F.posexplode(children).alias("at", "loc")).where(F.expr("pattern is null or loc rlike pattern"))
    rank = F.row_number().over(W.partitionBy("board").orderBy("at"))
    return rows.withColumn("_rank", rank).where(col("_rank") <= most).select("board", "loc")


def board_pages(entries: DataFrame, now: Column, most: int, most_days: int = 30, cfg: Config = DEFAULT) -> DataFrame:
    """(board, url, rank): pages worth fetching by the words of their address.

    A board that dates its pages gives the newest ones within most_days; another gives its last ones."""
    relevant = lambda folded: rules.relevance(folded, F.lit(""), F.lit(True), cfg)["ok"] & ~rules.seniority(folded, F.lit(""), cfg)["blocked"]
    worth = text.let(urls.slug_title(col("loc")), lambda title: (F.length(title) < 3) | text.let(text.fold(title), relevant))
    # `worth` is read above the window, where no filter can take its parts apart and work them out again for each use
    rows = entries.withColumn("_worth", worth).withColumn("_dated", F.count(F.when(col("_worth"), col("modified"))).over(W.partitionBy("board")))
    fresh = rows.where(col("_worth") & ((col("_dated") == 0) | (col("modified") >= now - F.make_dt_interval(days=F.lit(most_days)))))
    rank = F.row_number().over(W.partitionBy("board").orderBy(F.desc_nulls_last("modified"), F.when(col("_dated") == 0, -col("at")).otherwise(col("at"))))
    return fresh.withColumn("rank", rank).where(col("rank") <= most).select("board", col("loc").alias("url"), "rank")


def from_extraction(rows: DataFrame) -> DataFrame:
    """Postings of extracted rows (url, is_job_posting, title, company_name, company_website, location_text,
    remote_type, employment_type, salary_text, text, apply_url, apply_email, posted_date): the page's text is the
    description, the pay is read from its wording. Rows that are no posting, or have no title, are left out."""
    rows = rows.where(col("is_job_posting") & (F.trim("title") != "")).withColumn("_pay", money.salary(col("salary_text")))
    return rows.select(
        F.lit("web").alias("source"), col("url").alias("source_url"), F.substring(F.trim("title"), 1, 300).alias("title"), F.substring(F.trim("company_name"), 1, 200).alias("company_name"), "company_website", "location_text",
        "remote_type", "employment_type", "salary_text", col("_pay.min").alias("salary_min"), col("_pay.max").alias("salary_max"), col("_pay.currency").alias("salary_currency"), col("_pay.period").alias("salary_period"),
        F.substring(F.coalesce("text", F.lit("")), 1, 30_000).alias("description"), either(col("apply_url"), col("url")).alias("apply_url"), "apply_email", parsed(col("posted_date")).alias("posted_at"))


def lead_links(rows: DataFrame) -> DataFrame:
    """Leads (url, title, company, location, why) with a web address as links with one snippet."""
    rows = rows.where(col("url").startswith("http"))
    return rows.select("url", F.lit("ai_discovery").alias("via"), "title", F.concat_ws(" | ", *[filled(col(c)) for c in ("company", "location", "why")]).alias("snippet"))
