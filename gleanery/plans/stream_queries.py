"""Streaming queries, drained over the given tables, and feed adapters over payloads made of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.functions import text
from gleanery.plans.derived import derived
from gleanery.session import table
from gleanery.sources import feeds, pages
from gleanery.streaming import jobs
from gleanery.streaming.drain import drain

col = F.col


def stream_daily_counts(spark, d) -> DataFrame:
    return drain(jobs.daily_counts(jobs.events(spark, d), "ts"), "complete")


STREAM_DAILY = "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, max(value) AS most FROM events GROUP BY 1, 2"


def stream_first_seen(spark, d) -> DataFrame:
    return drain(jobs.first_seen(jobs.events(spark, d), "user_id", "ts", "3650 days").select("user_id"))


def stream_near_duplicates(spark, d) -> DataFrame:
    """Arrival decides, so the tests check it against a sequential scan."""
    schema = spark.read.parquet(f"{d}/documents.parquet").schema
    stream = spark.readStream.schema(schema).parquet(f"{d}/documents.parquet*")
    rows = derived(spark, d, "opportunities", stream).withColumns({"company_folded": text.fold(col("company_name")), "title_folded": text.fold(col("title"))})
    rows = rows.select("id", text.company_form(col("company_folded")).alias("company_norm"), text.title_form(col("title_folded")).alias("title_norm"), F.timestamp_seconds(col("first_seen_hour") * 3600).alias("first_seen"))
    return drain(jobs.near_duplicates(rows))


#: Documents of one payload.
BATCH = 20


def payloads(spark, d) -> DataFrame:
    """Documents as payloads of four sources, BATCH records each."""
    docs = table(spark, d, "documents").select(
        "doc_id", F.coalesce("text", F.lit("")).alias("text"), "lang",
        F.element_at(F.array(*map(F.lit, ("remotive", "greenhouse", "lever", "arbeitnow"))), (F.floor(col("doc_id") / BATCH) % 4 + 1).cast("int")).alias("source"), F.floor(col("doc_id") / BATCH).alias("batch"))
    url = F.concat(F.lit("https://jobs.example.com/"), col("doc_id"))
    title = F.concat(F.lit("Developer "), col("doc_id"))
    record = {
        "remotive": F.struct(col("doc_id").alias("id"), url.alias("url"), title.alias("title"), col("lang").alias("candidate_required_location"), F.lit("Full time").alias("job_type"), col("text").alias("description")),
        "greenhouse": F.struct(col("doc_id").alias("id"), url.alias("absolute_url"), title.alias("title"), F.struct(col("lang").alias("name")).alias("location"), col("text").alias("content")),
        "lever": F.struct(col("doc_id").alias("id"), url.alias("hostedUrl"), title.alias("text"), F.struct(col("lang").alias("location")).alias("categories"), F.lit("hybrid").alias("workplaceType"), col("text").alias("descriptionPlain")),
        "arbeitnow": F.struct(col("doc_id").alias("slug"), url.alias("url"), title.alias("title"), col("lang").alias("location"), (col("doc_id") % 2 == 0).alias("remote"), col("text").alias("description")),
    }
    parts = {"remotive": "jobs", "greenhouse": "jobs", "lever": None, "arbeitnow": "data"}
    json = F.coalesce(*[F.when(col("source") == s, F.to_json(r)) for s, r in record.items()])
    whole = F.concat(F.lit("["), F.array_join(F.sort_array(F.collect_list("json")), ","), F.lit("]"))
    rows = docs.select("source", "batch", json.alias("json")).groupBy("source", "batch").agg(whole.alias("list"))  # BATCH records a group
    body = F.coalesce(*[F.when(col("source") == s, F.concat(F.lit(f'{{"{p}":'), col("list"), F.lit("}")) if p else col("list")) for s, p in parts.items()])
    return rows.select("source", F.lit("u").alias("url"), F.lit('{"slug":"big-corp"}').alias("params"), F.lit(None).cast("timestamp_ntz").alias("fetched_at"), body.alias("body"))


def feed_postings(spark, d) -> DataFrame:
    rows = feeds.postings(payloads(spark, d), ["remotive", "greenhouse", "lever", "arbeitnow"])
    return rows.select("source", "source_external_id", "source_url", "title", "company_name", "location_text", "remote_type", "employment_type", F.array_join("location_restrictions", ",").alias("restrictions"))


FEED_POSTINGS = f"""
WITH s AS (SELECT * EXCLUDE (source), ['remotive', 'greenhouse', 'lever', 'arbeitnow'][(doc_id // {BATCH}) % 4 + 1] AS source, lower(coalesce(text, '')) AS low FROM documents)
SELECT source, CASE WHEN source IN ('greenhouse', 'lever') THEN 'big-corp:' ELSE '' END || CAST(doc_id AS STRING) AS source_external_id, 'https://jobs.example.com/' || CAST(doc_id AS STRING) AS source_url, 'Developer ' || CAST(doc_id AS STRING) AS title,
  CASE WHEN source IN ('greenhouse', 'lever') THEN 'Big Corp' END AS company_name, lang AS location_text, CASE source WHEN 'lever' THEN 'hybrid' WHEN 'greenhouse' THEN 'unknown' ELSE 'remote' END AS remote_type,
  CASE WHEN source = 'remotive' THEN 'full_time' ELSE 'unspecified' END AS employment_type, CASE WHEN source = 'remotive' THEN coalesce(lang, '') ELSE '' END AS restrictions
FROM s WHERE source <> 'arbeitnow' OR doc_id % 2 = 0
"""


def page_texts(spark, d) -> DataFrame:
    rows = table(spark, d, "pages").select("page_id", pages.main_text(col("html")).alias("shown"))
    return rows.select("page_id", F.length("shown").alias("chars"), pages.looks_like_posting(col("shown")).alias("like_posting"))


QUERIES = {
    "stream_daily_counts": (stream_daily_counts, STREAM_DAILY),
    "stream_first_seen": (stream_first_seen, "SELECT DISTINCT user_id FROM events"),
    "stream_near_duplicates": (stream_near_duplicates, None),
    "feed_postings": (feed_postings, FEED_POSTINGS),
    "page_texts": (page_texts, None),
}
