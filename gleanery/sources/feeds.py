"""Raw payloads to postings. A payload table has source, url, params (JSON), fetched_at, body.

Each adapter says which records a body holds and what they mean; `postings` runs all adapters over their
payloads and completes the rows. A body that is no JSON gives no rows, a field of a wrong type gives null.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.functions import classify, text
from gleanery.functions.dates import parsed
from gleanery.session import written

col = F.col
#: What an adapter may set; the rest is null.
FIELDS = {
    "source_external_id": "string", "source_url": "string", "title": "string", "company_name": "string", "company_website": "string", "location_text": "string",
    "location_restrictions": "array<string>", "mode": "string", "employment_text": "string", "employment": "string", "salary_min": "double", "salary_max": "double", "salary_currency": "string",
    "salary_period": "string", "salary_text": "string", "description": "string", "description_quality": "string", "apply_url": "string", "posted": "string", "expires": "string",
    "tags": "array<string>", "seniority_hint": "string", "detail_url": "string",
}


def no_list() -> Column:
    return F.array().cast("array<string>")


def filled(c: Column) -> Column:
    """Null for '' too."""
    return F.nullif(c, F.lit(""))


def either(*cs: Column) -> Column:
    return F.coalesce(*[filled(c) for c in cs])


def split_regions(c: Column) -> Column:
    """Parts between , / ; | without blanks and words that only say remote."""
    parts = F.transform(F.split(F.coalesce(c, F.lit("")), r"[,/;|]"), lambda x: F.trim(x))
    return F.filter(parts, lambda x: ~F.lower(x).isin("", "remote", "remote job", "anywhere remote"))


def amount(c: Column) -> Column:
    """A number, null for zero and for what is none."""
    return F.nullif(c.try_cast("double"), F.lit(0.0))


@dataclass(frozen=True)
class Adapter:
    schema: str  # of the body
    records: str  # path of the list of records in the parsed body
    keep: Callable[[], Column]  # on records `r`, the parsed body `b` and the payload's columns
    fields: Callable[[], dict[str, Column]]
    first_of: str | None = None  # records with an equal value of this field: the first in payload order stays


def r(name: str) -> Column:
    return col(f"r.{name}")


def slug() -> Column:
    return F.get_json_object("params", "$.slug")


def company() -> Column:
    return either(F.get_json_object("params", "$.company_name"), F.initcap(F.replace(slug(), F.lit("-"), F.lit(" "))))


def board_id(c: Column) -> Column:
    return F.concat(slug(), F.lit(":"), c)


def has(*cs: Column) -> Column:
    out = filled(cs[0]).isNotNull()
    for c in cs[1:]:
        out = out & filled(c).isNotNull()
    return out


def joined(cs: list[Column], sep: str = ", ") -> Column:
    return filled(F.array_join(F.filter(F.array(*cs), lambda x: x.isNotNull() & (x != "")), sep))


def paid(low: Column, high: Column, value: Column) -> Column:
    return F.when(low.isNotNull() | high.isNotNull(), value)


def remotive() -> dict[str, Column]:
    place = F.coalesce(r("candidate_required_location"), F.lit(""))
    return {"source_external_id": r("id"), "source_url": r("url"), "title": r("title"), "company_name": r("company_name"), "location_text": filled(place), "location_restrictions": split_regions(place), "mode": F.lit("remote"),
            "employment_text": r("job_type"), "salary_text": filled(r("salary")), "description": text.html_to_text(r("description")), "apply_url": r("url"), "posted": r("publication_date"), "tags": r("tags")}


def remoteok() -> dict[str, Column]:
    place, low, high = F.coalesce(r("location"), F.lit("")), amount(r("salary_min")), amount(r("salary_max"))
    regions = F.when(F.lower(place).isin("worldwide", "anywhere"), F.array(place)).otherwise(split_regions(place))
    return {"source_external_id": r("id"), "source_url": r("url"), "title": r("position"), "company_name": r("company"), "location_text": filled(place), "location_restrictions": regions, "mode": F.lit("remote"),
            "salary_min": low, "salary_max": high, "salary_currency": paid(low, high, F.lit("USD")), "salary_period": paid(low, high, F.lit("year")), "description": text.html_to_text(r("description")),
            "apply_url": either(r("apply_url"), r("url")), "posted": either(r("date"), r("epoch")), "tags": r("tags")}


def jobicy() -> dict[str, Column]:
    geo, low, high = F.coalesce(r("jobGeo"), F.lit("")), amount(r("annualSalaryMin")), amount(r("annualSalaryMax"))
    return {"source_external_id": r("id"), "source_url": r("url"), "title": text.html_to_text(r("jobTitle")), "company_name": r("companyName"), "location_text": filled(geo), "location_restrictions": split_regions(geo), "mode": F.lit("remote"),
            "employment_text": r("jobType"), "salary_min": low, "salary_max": high, "salary_currency": paid(low, high, r("salaryCurrency")), "salary_period": paid(low, high, F.lit("year")),
            "description": text.html_to_text(either(r("jobDescription"), r("jobExcerpt"))), "apply_url": r("url"), "posted": r("pubDate"), "seniority_hint": r("jobLevel")}


def himalayas() -> dict[str, Column]:
    named = lambda x: F.when(x.startswith("{"), F.coalesce(F.get_json_object(x, "$.name"), F.lit(""))).otherwise(x)
    regions = F.transform(F.coalesce(r("locationRestrictions"), no_list()), named)
    low, high, url = amount(r("minSalary")), amount(r("maxSalary")), either(r("applicationLink"), r("guid"))
    return {"source_external_id": either(r("guid"), url), "source_url": either(r("guid"), url), "title": r("title"), "company_name": r("companyName"), "location_text": F.coalesce(filled(F.array_join(regions, ", ")), F.lit("Worldwide")),
            "location_restrictions": F.filter(regions, lambda x: x != ""), "mode": F.lit("remote"), "employment_text": r("employmentType"), "salary_min": low, "salary_max": high,
            "salary_currency": paid(low, high, either(r("currency"), r("salaryCurrency"))), "salary_period": paid(low, high, F.lit("year")), "description": text.html_to_text(either(r("description"), r("excerpt"))), "apply_url": url,
            "posted": r("pubDate"), "expires": r("expiryDate"), "seniority_hint": F.array_join(r("seniority"), ", ")}


def workingnomads() -> dict[str, Column]:
    place, tags = F.coalesce(r("location"), F.lit("")), F.coalesce(r("tags"), F.lit(""))
    listed = F.when(tags.startswith("["), F.from_json(tags, "array<string>")).otherwise(F.transform(F.split(tags, ","), lambda x: F.trim(x)))
    regions = F.when(F.lower(place).isin("anywhere", "worldwide", ""), no_list()).otherwise(split_regions(place))
    return {"source_url": r("url"), "title": r("title"), "company_name": r("company_name"), "location_text": filled(place), "location_restrictions": regions, "mode": F.lit("remote"), "employment": F.lit("unspecified"),
            "description": text.html_to_text(r("description")), "apply_url": r("url"), "posted": r("pub_date"), "tags": listed}


def arbeitnow() -> dict[str, Column]:
    return {"source_external_id": r("slug"), "source_url": r("url"), "title": r("title"), "company_name": r("company_name"), "location_text": r("location"), "mode": F.lit("remote"), "employment_text": F.array_join(r("job_types"), " "),
            "description": text.html_to_text(r("description")), "apply_url": r("url"), "posted": r("created_at"), "tags": r("tags")}


def themuse() -> dict[str, Column]:
    names = F.transform(F.coalesce(col("r.locations.name"), no_list()), lambda x: F.coalesce(x, F.lit("")))
    remote, place = F.exists(names, lambda x: F.lower(x).contains("remote")), filled(F.array_join(names, ", "))
    return {"source_external_id": r("id"), "source_url": r("refs.landing_page"), "title": r("name"), "company_name": r("company.name"), "location_text": place, "location_restrictions": F.when(remote, no_list()).otherwise(split_regions(place)),
            "mode": F.when(remote, "remote").otherwise("unknown"), "employment_text": r("type"), "description": text.html_to_text(r("contents")), "apply_url": r("refs.landing_page"), "posted": r("publication_date"),
            "seniority_hint": F.array_join(col("r.levels.name"), ", ")}


def findwork() -> dict[str, Column]:
    place = F.coalesce(r("location"), F.lit(""))
    remote = F.coalesce(r("remote"), F.lit(False)) | F.lower(place).contains("remote")
    return {"source_external_id": r("id"), "source_url": r("url"), "title": r("role"), "company_name": r("company_name"), "company_website": r("company_url"), "location_text": F.coalesce(filled(place), F.when(remote, "Remote")),
            "location_restrictions": F.when(remote, no_list()).otherwise(split_regions(place)), "mode": F.when(remote, "remote").otherwise("unknown"), "employment_text": r("employment_type"), "description": text.html_to_text(r("text")),
            "apply_url": r("url"), "posted": r("date_posted"), "tags": r("keywords")}


def greenhouse() -> dict[str, Column]:
    return {"source_external_id": board_id(r("id")), "source_url": r("absolute_url"), "title": r("title"), "company_name": either(r("company_name"), company()), "location_text": r("location.name"),
            "description": text.html_to_text(r("content")), "apply_url": r("absolute_url"), "posted": either(r("first_published"), r("updated_at")), "employment": F.lit("unspecified")}


def lever() -> dict[str, Column]:
    listed = F.coalesce(col("r.lists"), F.array().cast("array<struct<text:string,content:string>>"))
    texts = text.html_to_texts(F.transform(listed, lambda b: b["content"]))
    blocks = F.zip_with(listed, texts, lambda b, shown: F.concat(F.lit("\n\n"), F.coalesce(b["text"], F.lit("")), F.lit("\n"), shown))
    whole = F.concat(either(r("descriptionPlain"), text.html_to_text(r("description")), F.lit(" ")), F.array_join(blocks, ""), F.lit("\n\n"), F.coalesce(r("additionalPlain"), F.lit("")))
    interval = F.lower(F.coalesce(r("salaryRange.interval"), F.lit("")))
    return {"source_external_id": board_id(r("id")), "source_url": r("hostedUrl"), "title": r("text"), "company_name": company(), "location_text": either(r("categories.location"), F.array_join(r("categories.allLocations"), ", ")),
            "mode": F.lower(r("workplaceType")), "employment_text": r("categories.commitment"), "salary_min": r("salaryRange.min"), "salary_max": r("salaryRange.max"), "salary_currency": r("salaryRange.currency"),
            "salary_period": F.when(interval.contains("hour"), "hour").when(interval.contains("month"), "month").when(col("r.salaryRange").isNotNull(), "year"), "description": F.regexp_replace(whole, r"^\s+|\s+$", ""),
            "apply_url": either(r("applyUrl"), r("hostedUrl")), "posted": r("createdAt")}


def ashby() -> dict[str, Column]:
    place = filled(F.array_join(F.filter(F.concat(F.array(r("location")), F.coalesce(col("r.secondaryLocations.location"), no_list())), lambda x: F.coalesce(x, F.lit("")) != ""), ", "))
    return {"source_external_id": board_id(either(r("id"), r("jobUrl"))), "source_url": r("jobUrl"), "title": r("title"), "company_name": company(), "location_text": place, "mode": F.when(r("isRemote"), "remote").otherwise(F.lower(r("workplaceType"))),
            "employment_text": r("employmentType"), "salary_text": r("compensation.compensationTierSummary"), "description": either(r("descriptionPlain"), text.html_to_text(r("descriptionHtml"))), "apply_url": either(r("applyUrl"), r("jobUrl")),
            "posted": r("publishedAt")}


def smartrecruiters() -> dict[str, Column]:
    country, level = F.upper(F.coalesce(r("location.country"), F.lit(""))), r("experienceLevel.label")
    remote = F.coalesce(r("location.remote"), F.lit(False))
    url = F.concat(F.lit("https://jobs.smartrecruiters.com/"), slug(), F.lit("/"), r("id"))
    return {"source_external_id": board_id(r("id")), "source_url": url, "title": r("name"), "company_name": either(r("company.name"), company()), "location_text": joined([r("location.city"), r("location.region"), country]),
            "location_restrictions": F.when(remote & (country != ""), F.array(country)), "mode": F.when(remote, "remote"), "employment_text": r("typeOfEmployment.label"), "description": joined([r("name"), r("function.label"), level], "\n"),
            "description_quality": F.lit("partial"), "apply_url": url, "posted": r("releasedDate"), "seniority_hint": level, "detail_url": r("ref")}


def recruitee() -> dict[str, Column]:
    period = F.lower(F.coalesce(r("salary.period"), F.lit("")))
    return {"source_external_id": board_id(r("id")), "source_url": r("careers_url"), "title": r("title"), "company_name": either(r("company_name"), company()), "location_text": r("location"), "mode": F.when(r("remote"), "remote"),
            "employment_text": r("employment_type_code"), "salary_min": r("salary.min").try_cast("double"), "salary_max": r("salary.max").try_cast("double"), "salary_currency": r("salary.currency"),
            "salary_period": F.coalesce(*[F.when(period.contains(p), F.lit(p)) for p in ("hour", "day", "week", "month", "year")]), "description": text.html_to_text(F.concat_ws("\n", F.coalesce(r("description"), F.lit("")), F.coalesce(r("requirements"), F.lit("")))),
            "apply_url": either(r("careers_apply_url"), r("careers_url")), "posted": either(r("published_at"), r("created_at"))}


def workable() -> dict[str, Column]:
    url, body = either(r("url"), r("shortlink")), text.html_to_text(r("description"))
    return {"source_external_id": board_id(either(r("shortcode"), url)), "source_url": url, "title": r("title"), "company_name": either(col("b.name"), company()), "location_text": joined([r("city"), r("state"), r("country")]),
            "mode": F.when(r("telecommuting"), "remote"), "employment_text": r("employment_type"), "description": body, "description_quality": F.when(F.length(body) > 300, "full").otherwise("partial"), "apply_url": either(r("application_url"), url),
            "posted": either(r("published_on"), r("created_at"))}


def _strings(names: str, rest: str = "") -> str:
    return ",".join([*(f"{n}:string" for n in names.split()), *([rest] if rest else [])])


ADAPTERS: dict[str, Adapter] = {
    "remotive": Adapter(f"struct<jobs:array<struct<{_strings('id url title company_name job_type publication_date candidate_required_location salary description category', 'tags:array<string>')}>>>", "b.jobs", lambda: has(r("url"), r("title")), remotive),
    "remoteok": Adapter(f"array<struct<{_strings('id url position company location salary_min salary_max description apply_url date epoch legal', 'tags:array<string>')}>>", "b", lambda: r("legal").isNull() & has(r("position"), r("url")), remoteok),
    "jobicy": Adapter(f"struct<jobs:array<struct<{_strings('id url jobTitle companyName jobGeo jobType annualSalaryMin annualSalaryMax salaryCurrency jobDescription jobExcerpt pubDate jobLevel')}>>>", "b.jobs", lambda: has(r("url")), jobicy, "r.id"),
    "himalayas": Adapter(f"struct<jobs:array<struct<{_strings('title companyName applicationLink guid employmentType description excerpt pubDate expiryDate minSalary maxSalary currency salaryCurrency', 'locationRestrictions:array<string>,seniority:array<string>')}>>>", "b.jobs", lambda: has(either(r("applicationLink"), r("guid")), r("title")), himalayas),
    "workingnomads": Adapter(f"array<struct<{_strings('url title company_name location tags description pub_date')}>>", "b", lambda: has(r("url"), r("title")), workingnomads),
    "arbeitnow": Adapter(f"struct<data:array<struct<{_strings('slug url title company_name location description created_at', 'remote:boolean,job_types:array<string>,tags:array<string>')}>>>", "b.data", lambda: F.coalesce(r("remote"), F.lit(False)) & has(r("url")), arbeitnow),
    "themuse": Adapter(f"struct<results:array<struct<{_strings('id name type contents publication_date', 'company:struct<name:string>,locations:array<struct<name:string>>,levels:array<struct<name:string>>,refs:struct<landing_page:string>')}>>>", "b.results", lambda: has(r("id"), r("name"), r("refs.landing_page")), themuse, "r.id"),
    "findwork": Adapter(f"struct<results:array<struct<{_strings('id url role company_name company_url location employment_type text date_posted', 'remote:boolean,keywords:array<string>')}>>>", "b.results", lambda: has(r("url"), r("role")), findwork),
    "greenhouse": Adapter(f"struct<jobs:array<struct<{_strings('id title absolute_url content updated_at first_published company_name', 'location:struct<name:string>')}>>>", "b.jobs", lambda: has(r("absolute_url")), greenhouse),
    "lever": Adapter(f"array<struct<{_strings('id text hostedUrl applyUrl workplaceType descriptionPlain description additionalPlain createdAt', 'lists:array<struct<text:string,content:string>>,categories:struct<location:string,allLocations:array<string>,commitment:string>,salaryRange:struct<min:double,max:double,currency:string,interval:string>')}>>", "b", lambda: has(r("hostedUrl")), lever),
    "ashby": Adapter(f"struct<jobs:array<struct<{_strings('id title jobUrl applyUrl location employmentType workplaceType descriptionPlain descriptionHtml publishedAt', 'isRemote:boolean,isListed:boolean,secondaryLocations:array<struct<location:string>>,compensation:struct<compensationTierSummary:string>')}>>>", "b.jobs", lambda: F.coalesce(r("isListed"), F.lit(True)) & has(r("jobUrl")), ashby),
    "smartrecruiters": Adapter(f"struct<content:array<struct<{_strings('id name ref releasedDate', 'location:struct<city:string,region:string,country:string,remote:boolean>,experienceLevel:struct<label:string>,function:struct<label:string>,typeOfEmployment:struct<label:string>,company:struct<name:string>')}>>>", "b.content", lambda: r("id").isNotNull(), smartrecruiters),
    "recruitee": Adapter(f"struct<offers:array<struct<{_strings('id title careers_url careers_apply_url company_name location employment_type_code description requirements published_at created_at', 'remote:boolean,salary:struct<min:string,max:string,currency:string,period:string>')}>>>", "b.offers", lambda: has(r("careers_url")), recruitee),
    "workable": Adapter(f"struct<name:string,jobs:array<struct<{_strings('shortcode title url shortlink city state country description employment_type application_url published_on created_at', 'telecommuting:boolean')}>>>", "b.jobs", lambda: has(either(r("url"), r("shortlink"))), workable),
}


def projected(rows: DataFrame, fields: dict[str, Column]) -> DataFrame:
    return rows.select("source", *[(fields[n] if n in fields else F.lit(None)).cast(t).alias(n) for n, t in FIELDS.items()])


def read(payloads: DataFrame, source: str) -> DataFrame:
    """The records of one source as raw posting fields."""
    a = ADAPTERS[source]
    rows = payloads.where(col("source") == source).withColumn("b", F.from_json("body", a.schema))
    rows = rows.select("source", "url", "params", "fetched_at", "b", F.posexplode(a.records).alias("at", "r")).where(a.keep())
    if a.first_of:
        first = F.min_by(F.struct(*rows.columns), F.struct("fetched_at", "url", "at")).alias("first")
        rows = rows.groupBy(col(a.first_of).alias("_key")).agg(first).select("first.*")
    return projected(rows, a.fields())


def read_rss(payloads: DataFrame, source: str = "weworkremotely") -> DataFrame:
    """Items of RSS bodies; a title is `company: role`, split at the first colon."""
    items = payloads.where(col("source") == source).select("source", F.explode(F.regexp_extract_all("body", F.lit(r"(?is)<item\b[^>]*>(.*?)</item>"), F.lit(1))).alias("item"))

    def tag(name: str) -> Column:
        inner = F.regexp_extract("item", rf"(?is)<{name}\b[^>]*>\s*(?:<!\[CDATA\[)?(.*?)(?:\]\]>)?\s*</{name}>", 1)
        return filled(text.unescape(inner))

    items = items.select("source", *[tag(n).alias(n) for n in ("title", "region", "type", "link", "guid", "pubDate", "description")])
    named = F.regexp_like("title", F.lit(r"(?s)^[^:]*:.*\S"))
    region = F.coalesce("region", F.lit(""))
    fields = {
        "source_external_id": either(col("guid"), col("link")), "source_url": col("link"), "title": F.trim(F.when(named, F.regexp_replace("title", r"^[^:]*:", "")).otherwise(col("title"))),
        "company_name": F.when(named, filled(F.trim(F.substring_index("title", ":", 1)))), "location_text": filled(region),
        "location_restrictions": F.when(F.lower(region).contains("anywhere"), no_list()).otherwise(split_regions(F.replace(region, F.lit(" Only"), F.lit("")))), "mode": F.lit("remote"), "employment_text": col("type"),
        "description": text.html_to_text(col("description")), "apply_url": col("link"), "posted": col("pubDate"),
    }
    return projected(items, fields).where("source_url is not null and title <> ''")


#: What makes a comment of a hiring thread a posting.
RELEVANT = r"(?i)\b(?:frontend|front-end|react|javascript|typescript|full[- ]?stack|web developer|software engineer|junior|intern|next\.?js|qa|support engineer)\b"
ROLE = r"(?i)\b(?:engineer|developer|frontend|front-end|full[- ]?stack|react|web|qa|support|devops|intern|programmer|designer)\b"
NEEDLES = {"who_is_hiring": "who is hiring", "freelancer": "seeking freelancer"}


def chosen_thread(hits: DataFrame, thread: str, now: Column, most_days: int = 40) -> DataFrame:
    """The first hit (pos, objectID, title, created_at) of the thread's kind, none if it is too old."""
    fit = hits.where(F.lower("title").contains(NEEDLES[thread])).agg(F.min_by(F.struct("objectID", "created_at"), "pos").alias("h")).where("h is not null").select("h.*")
    return fit.where(F.coalesce(parsed(col("created_at")) >= now - F.make_dt_interval(days=F.lit(most_days)), F.lit(True)))


def read_thread(payloads: DataFrame, source: str = "hackernews") -> DataFrame:
    """Comments of a hiring thread: `company | role | place | ...` in the first line."""
    rows = payloads.where(col("source") == source).select("source", F.coalesce(F.get_json_object("params", "$.thread"), F.lit("who_is_hiring")).alias("thread"),
        F.explode(F.from_json("body", "struct<children:array<struct<id:string,created_at:string,author:string,text:string>>>")["children"]).alias("c"))
    rows = rows.select("source", "thread", "c", text.html_to_text(col("c.text")).alias("whole"))
    seeking = F.lower("whole").startswith("seeking freelancer")
    rows = rows.where(F.lower("whole").contains("remote") & col("whole").rlike(RELEVANT) & ((col("thread") != "freelancer") | seeking))
    line = F.regexp_replace(F.substring_index("whole", "\n", 1), r"(?i)^seeking freelancer\s*[-:|]?\s*", "")
    parts = F.filter(F.transform(F.split(line, r"\s+[|•·]\s+"), lambda p: F.trim(p)), lambda p: p != "")
    rows = rows.withColumns({"line": line, "parts": parts})
    place = F.get(F.filter("parts", lambda p: p.rlike("(?i)remote|onsite|on-site|hybrid")), F.lit(0))
    role = F.get(F.filter(F.slice("parts", F.lit(2), F.greatest(F.size("parts") - 1, F.lit(0))), lambda p: p.rlike(ROLE)), F.lit(0))
    return projected(rows, {
        "source_external_id": col("c.id"), "source_url": F.concat(F.lit("https://news.ycombinator.com/item?id="), col("c.id")), "title": F.coalesce(role, F.substring("line", 1, 140)), "company_name": F.substring(F.get("parts", F.lit(0)), 1, 120),
        "location_text": place, "mode": F.when(F.lower(place).contains("remote"), "remote").otherwise("unknown"), "employment": F.when(col("thread") == "freelancer", "freelance"), "employment_text": F.array_join("parts", " "),
        "description": col("whole"), "posted": col("c.created_at"),
    })


def completed(rows: DataFrame) -> DataFrame:
    """Raw fields to postings: classes, dates, trimmed texts."""
    rows = rows.withColumns({"title": F.substring(F.trim("title"), 1, 300), "description": F.substring(F.coalesce("description", F.lit("")), 1, 30_000), "company_name": F.substring(F.trim("company_name"), 1, 200)})
    rows = rows.withColumns({"_t": text.fold(col("title")), "_p": text.fold(col("location_text")), "_d": text.fold(F.substring("description", 1, 2000)), "_e": text.fold(col("employment_text"))})
    told = F.when(col("mode").isin("remote", "hybrid", "unknown"), col("mode")).when(col("mode").isin("onsite", "on-site"), "onsite")
    return rows.withColumns({
        "remote_type": F.coalesce(told, classify.work_mode_or([col("_t"), col("_p")], col("_d"))),
        "employment_type": F.coalesce("employment", classify.employment(col("_e"))),
        "posted_at": parsed(col("posted")), "expires_at": parsed(col("expires")),
        "location_restrictions": F.coalesce("location_restrictions", no_list()), "tags": F.coalesce("tags", no_list()), "description_quality": F.coalesce("description_quality", F.lit("full")),
    }).drop("_t", "_p", "_d", "_e", "mode", "employment", "employment_text", "posted", "expires")


def postings(payloads: DataFrame, sources: list[str] | None = None) -> DataFrame:
    """All sources' postings. The payloads are read once, and laid out by source, so that each reader gets its own
    alone; those of one source, or of a stream, are filtered as they come."""
    readers: dict[str, Callable[[DataFrame], DataFrame]] = {s: (lambda p, s=s: read(p, s)) for s in ADAPTERS} | {"weworkremotely": read_rss, "hackernews": read_thread}
    sources, out = sources or list(readers), None
    if len(sources) > 1 and not payloads.isStreaming:
        payloads = written(payloads.where(col("source").isin(sources)), "payloads", by="source")
    for name in sources:
        rows = readers[name](payloads)
        out = rows if out is None else out.unionByName(rows)
    return completed(out)


def enriched(rows: DataFrame, details: DataFrame) -> DataFrame:
    """Partial postings with the fuller description of their detail payload (detail_url, body), if longer."""
    names = ("companyDescription", "jobDescription", "qualifications", "additionalInformation")
    part = lambda n: F.when(F.get_json_object("body", f"$.jobAd.sections.{n}").isNotNull(), F.concat(F.coalesce(F.get_json_object("body", f"$.jobAd.sections.{n}.title"), F.lit("")), F.lit("\n"), text.html_to_text(F.get_json_object("body", f"$.jobAd.sections.{n}.text"))))
    full = details.select("detail_url", F.concat_ws("\n\n", *[part(n) for n in names]).alias("_full"))
    out = rows.join(full, "detail_url", "left")
    better = F.length(F.coalesce("_full", F.lit(""))) > F.length("description")
    return out.withColumns({"description_quality": F.when(better, "full").otherwise(col("description_quality")), "description": F.when(better, col("_full")).otherwise(col("description"))}).drop("_full")


def search_links(payloads: DataFrame) -> DataFrame:
    """(url, via, title, snippet) of search results in their three shapes."""
    shapes = {
        "brave": ("struct<web:struct<results:array<struct<url:string,title:string,description:string>>>>", "b.web.results", "url", lambda: text.html_to_text(r("description"))),
        "tavily": ("struct<results:array<struct<url:string,title:string,content:string>>>", "b.results", "url", lambda: F.substring(F.coalesce(r("content"), F.lit("")), 1, 500)),
        "google_cse": ("struct<items:array<struct<link:string,title:string,snippet:string>>>", "b.items", "link", lambda: r("snippet")),
    }
    out = None
    for source, (schema, path, url, snippet) in shapes.items():
        rows = payloads.where(col("source") == source).select(F.from_json("body", schema).alias("b")).select(F.explode(path).alias("r")).where(has(r(url)))
        rows = rows.select(r(url).alias("url"), F.lit(f"search:{source}").alias("via"), r("title").alias("title"), snippet().alias("snippet"))
        out = rows if out is None else out.unionByName(rows)
    return out
