"""Ingest as one plan: postings that come in meet what is stored.

incoming: postings as the sources give them (source, source_external_id, source_url, title, company_name,
company_website, location_text, location_restrictions, remote_type, employment_type, salary_min, salary_max,
salary_currency, salary_period, salary_text, description, description_quality, apply_url, apply_email,
posted_at, expires_at, tags), with `id` (the ids that new rows get, in order of arrival) and `seen_hour`.
stored: id, url_hash, source, external_id, company_norm, title_norm, fingerprint, duplicate_of, first_seen_hour.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.config import DEFAULT, Config
from gleanery.functions import money, text, urls
from gleanery.operators import joins, rules
from gleanery.operators.dedup import near_duplicates
from gleanery.operators.store import Store
from gleanery.session import written

col = F.col
#: Columns of a stored posting, in order.
ROW = [
    "id", "first_run_id", "last_run_id", "source", "source_external_id", "source_url", "canonical_url", "url_hash", "fingerprint", "duplicate_of", "title", "title_norm", "company_name", "company_norm", "company_website",
    "location_text", "location_restrictions", "remote_type", "employment_type", "salary_min", "salary_max", "salary_currency", "salary_period", "pay_min", "pay_max", "description", "description_quality", "apply_url", "apply_email",
    "posted_at", "expires_at", "raw", "pipeline_status", "prescore", "prescore_reasons", "first_seen_hour",
]


def valid() -> Column:
    """A title, and a web address."""
    return F.coalesce((F.trim("title") != "") & col("source_url").rlike("^https?://"), F.lit(False))


def rows_of(incoming: DataFrame, run_id: int, cfg: Config = DEFAULT) -> DataFrame:
    """incoming as rows to store, but for duplicate_of and pipeline_status. Projections only."""
    rows = incoming.withColumns({
        "first_run_id": F.lit(run_id).cast("long"), "last_run_id": F.lit(run_id).cast("long"), "canonical_url": urls.canonical(col("source_url")), "url_hash": urls.url_key(col("source_url")), "first_seen_hour": col("seen_hour").cast("long"),
        "_t": text.fold(col("title")), "_d": text.fold(col("description")), "_p": text.fold(col("location_text")), "_c": text.fold(col("company_name")), "_pay": money.salary(col("salary_text"), cfg.base_currency),
        "raw": F.to_json(F.struct("tags", "salary_text")),
    })
    reads = col("salary_min").isNull() & col("salary_max").isNull() & col("_pay").isNotNull()
    read = lambda own, said: F.when(reads, col(f"_pay.{said}")).otherwise(col(own))
    rows = rows.withColumns({"company_norm": text.company_form(col("_c")), "title_norm": text.title_form(col("_t")), "salary_min": read("salary_min", "min"), "salary_max": read("salary_max", "max"), "salary_currency": read("salary_currency", "currency"), "salary_period": read("salary_period", "period")})
    stated = (F.coalesce("salary_min", F.lit(0.0)) != 0) | (F.coalesce("salary_max", F.lit(0.0)) != 0)
    rows = rows.withColumns({"salary_period": F.when(stated, F.coalesce(F.nullif("salary_period", F.lit("")), F.lit("year"))).otherwise(col("salary_period")), "fingerprint": text.fingerprint(col("company_norm"), col("title_norm"))})
    monthly = lambda c: money.monthly(col(c), col("salary_currency"), col("salary_period"), cfg.fx)
    rows = rows.withColumns({"pay_min": monthly("salary_min"), "pay_max": monthly("salary_max"), "_start": F.concat_ws("\n", "_t", F.substring("_d", 1, 6000))})
    queue = rules.queue_score(cfg, t=col("_t"), d=col("_d"), text=col("_start"), place=col("_p"), mode=col("remote_type"), source=col("source"), pay_min=col("pay_min"), pay_max=col("pay_max"), eligible=F.lit(None).cast("string"))
    return rows.withColumn("_queue", queue).withColumns({"prescore": col("_queue.score"), "prescore_reasons": col("_queue.reasons")})


def first_stored(rows: DataFrame) -> DataFrame:
    """(id, seen_as) of the rows (id, url_hash, source, external_id) that are seen once earlier ones are stored, in
    the order of the ids: a row is stored unless its url_hash, or its source and external_id, is that of a stored row.

    Rounds over the rows that are open. The first row by both of its keys is stored, as no earlier row can hold it
    up; rows that share a key with a stored one are seen. What is left waits for rows that are seen now. Nearly
    all rows are decided in the first round; a further one takes a chain of rows that meet by turns in one key and the
    other. Keys are grouped before they are joined, so a page that comes very often is one row of a group."""
    by_ext = ["source", "external_id"]
    given = rows.select("id", "url_hash", *by_ext)
    still, all_stored = given, None

    def met(some: DataFrame, stored: DataFrame) -> DataFrame:
        """some with the stored rows that share a key."""
        by_url = stored.select("url_hash", col("id").alias("_url"))
        by_id = stored.where("external_id is not null").select(*by_ext, col("id").alias("_ext"))
        return some.join(by_url, "url_hash", "left").join(by_id, by_ext, "left")

    while True:
        url = still.groupBy("url_hash").agg(F.min("id").alias("_url"))
        ext = still.where("external_id is not null").groupBy(*by_ext).agg(F.min("id").alias("_ext"))
        firsts = still.join(url, "url_hash").join(ext, by_ext, "left")
        stored = written(firsts.where((col("_url") == col("id")) & (F.coalesce("_ext", "id") == col("id"))).select("id", "url_hash", *by_ext), "stored")
        all_stored = stored if all_stored is None else all_stored.unionByName(stored)
        still = written(met(still, stored).where("_url is null and _ext is null").select("id", "url_hash", *by_ext), "still_open")
        if still.isEmpty():
            # which of the stored ones a row is seen as: the earliest by either key, whatever round it came from
            return met(given, all_stored).withColumn("seen_as", F.least("_url", "_ext")).where("seen_as < id").select("id", "seen_as")


def outcomes(incoming: DataFrame, stored: DataFrame, run_id: int, now_hour: int, cfg: Config = DEFAULT) -> DataFrame:
    """(id, source, source_url, seen_hour, outcome, duplicate_of, pipeline_status, sighting_of): outcome is invalid,
    seen, duplicate or new, sighting_of the posting that was sighted (the original of a duplicate).

    In order of arrival a posting is `seen` if its address or its (source, external id) is that of a stored one,
    be it stored before or earlier in this run; else it is stored, as a duplicate of the original that
    `near_duplicates` finds among all stored and earlier rows, or as new. A row that is seen lends its keys to none.

    Only ids and keys are joined; company and title are folded for the rows that are stored alone."""
    narrow = incoming.select("id", "source", "source_url", "seen_hour", urls.url_key(col("source_url")).alias("url_hash"), F.nullif("source_external_id", F.lit("")).alias("external_id"), valid().alias("_valid"))
    narrow = written(joins.known(narrow, stored), "arrived")
    seen = first_stored(narrow.where("_valid and known_id is null"))
    rows = narrow.join(seen, "id", "left").withColumn("seen_as", F.coalesce("known_id", "seen_as"))
    new = rows.where("_valid and seen_as is null").select("id")
    shape = ["id", "company_norm", "title_norm", "first_seen_hour"]
    named = rows_of(incoming.join(new, "id", "left_semi"), run_id, cfg).select(*shape)
    found = near_duplicates(stored.where("duplicate_of is null").select(*shape).unionByName(named), now_hour, cfg, whole=True).withColumnRenamed("duplicate_of", "_original")
    rows = rows.join(found, "id", "left")
    outcome = F.when(~col("_valid"), "invalid").when(col("seen_as").isNotNull(), "seen").when(col("_original").isNotNull(), "duplicate").otherwise("new")
    rows = rows.withColumn("outcome", outcome)
    rows = rows.withColumns({"duplicate_of": F.when(col("outcome") == "duplicate", col("_original")), "pipeline_status": F.when(col("outcome").isin("duplicate", "new"), col("outcome"))})
    sighted = F.when(col("outcome") != "invalid", F.coalesce("seen_as", "duplicate_of", "id"))
    return rows.select("id", "source", "source_url", "seen_hour", "outcome", "duplicate_of", "pipeline_status", sighted.alias("sighting_of"))


def additions(incoming: DataFrame, found: DataFrame, run_id: int, cfg: Config = DEFAULT) -> DataFrame:
    """The rows to add to the stored postings. found: the outcomes of incoming."""
    stored = found.where("outcome in ('new', 'duplicate')").select("id", "duplicate_of", "pipeline_status")
    return rows_of(incoming.join(stored, "id"), run_id, cfg).select(*ROW)


def sightings(found: DataFrame, run_id: int) -> DataFrame:
    """(opportunity_id, run_id, source, url): one for each posting and source, the first address in order of arrival."""
    seen = found.where("sighting_of is not null").groupBy(col("sighting_of").alias("opportunity_id"), "source").agg(F.min_by("source_url", "id").alias("url"))
    return seen.select("opportunity_id", F.lit(run_id).cast("long").alias("run_id"), "source", "url")


def touched(stored: DataFrame, found: DataFrame, run_id: int) -> DataFrame:
    """stored postings with the run and hour at which they were last seen (last_run_id, last_seen_hour)."""
    last = found.where("outcome = 'seen'").groupBy(col("sighting_of").alias("id")).agg(F.max("seen_hour").cast("long").alias("_at"))
    out = stored.join(last, "id", "left")
    hit = col("_at").isNotNull()
    return out.withColumns({"last_run_id": F.when(hit, F.lit(run_id)).otherwise(col("last_run_id")), "last_seen_hour": F.greatest("last_seen_hour", "_at")}).drop("_at")


#: What the store keeps of a posting besides the columns of ROW.
KEPT = [*ROW, "external_id", "last_seen_hour"]


def ingest_into(store: Store, incoming: DataFrame, run_id: int, now_hour: int, batch: str, cfg: Config = DEFAULT) -> bool:
    """Stores what comes in and touches what is seen again; a batch that was ingested before changes nothing, and is
    not worked out again."""
    if store.has_batch(batch):
        return False
    incoming, stored = written(incoming, "incoming"), store.read()
    found = written(outcomes(incoming, stored, run_id, now_hour, cfg), "outcomes")
    added = additions(incoming, found, run_id, cfg).withColumns({"external_id": F.nullif("source_external_id", F.lit("")), "last_seen_hour": col("first_seen_hour")})
    # only postings that are new or were seen again are written
    again = stored.join(found.where("outcome = 'seen'").select(col("sighting_of").alias("id")).distinct(), "id", "left_semi")
    return store.upsert(touched(again.select(*KEPT).unionByName(added.select(*KEPT)), found, run_id), batch)
