"""What belongs to a posting: its row in lists, its children and original, its materials, events and sightings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.operators.joins import bundles

col = F.col
#: Columns of a list of postings.
LIST = [
    "id", "title", "company_name", "source", "source_url", "location_text", "remote_type", "employment_type", "pay_min", "pay_max", "match_score", "recommendation", "review_status", "pipeline_status", "eligibility",
    "legitimacy_verdict", "apply_method", "apply_email", "materials_status", "first_seen_hour", "posted_hour", "filter_reasons", "duplicate_of", "prescore",
]


def listed(postings: DataFrame) -> DataFrame:
    """The columns of a list; those that the table lacks are null."""
    have = set(postings.columns)
    return postings.select(*[col(c) if c in have else F.lit(None).cast("string").alias(c) for c in LIST])


def with_materials(materials: DataFrame, postings: DataFrame) -> DataFrame:
    """materials (id, opportunity_id, version, ...) with the company of their posting."""
    return materials.join(postings.select(col("id").alias("opportunity_id"), "company_name"), "opportunity_id")


def with_titles(events: DataFrame, postings: DataFrame) -> DataFrame:
    """events (.., opportunity_id) with title and company of their posting, null where there is none."""
    return events.join(postings.select(col("id").alias("opportunity_id"), "title", "company_name"), "opportunity_id", "left")


def children(postings: DataFrame) -> DataFrame:
    """(id, duplicates): the duplicates of each original, by id."""
    rows = postings.where("duplicate_of is not null").select(col("duplicate_of").alias("of"), F.struct("id", "title", "company_name", "source").alias("d"))
    return rows.groupBy(col("of").alias("id")).agg(F.sort_array(F.collect_list("d")).alias("duplicates"))


def with_originals(postings: DataFrame) -> DataFrame:
    """postings with `original`: id, title, company and source of what they are duplicates of."""
    known = postings.select(col("id").alias("duplicate_of"), F.struct("id", "title", "company_name", "source").alias("original"))
    return postings.join(known, "duplicate_of", "left")


def bundle(postings: DataFrame, materials: DataFrame, events: DataFrame, sightings: DataFrame, applications: DataFrame, most_events: int = 100, most_sightings: int = 50) -> DataFrame:
    """postings with `materials` (newest version first), `events` and `sightings` (newest first, at most so many),
    the first `application`, `duplicates` and `original`. Each part is aggregated before it meets the postings."""

    def part(rows: DataFrame, name: str, fields: list[str], order: list, most: int) -> DataFrame:
        return bundles(rows, "opportunity_id", fields, F.struct(*order), most).select(col("opportunity_id").alias("id"), col("items").alias(name))

    newest = lambda *cs: [(-col(c)).alias(f"o{i}") for i, c in enumerate(cs)]
    application = applications.groupBy(col("opportunity_id").alias("id")).agg(F.min_by(F.struct("id", "status", "applied_hour"), "id").alias("application"))
    parts = [
        part(materials, "materials", ["id", "version"], newest("version"), 1 << 30),
        part(events, "events", ["id", "level", "message"], newest("at_hour", "id"), most_events),
        part(sightings, "sightings", ["source", "url", "seen_hour"], [*newest("seen_hour"), col("source"), col("url")], most_sightings),
        application, children(postings),
    ]
    out = with_originals(postings)
    for p in parts:
        out = out.join(p, "id", "left")
    return out


def run_errors(events: DataFrame) -> DataFrame:
    """(run_id, errors): the errors of each run."""
    return events.groupBy("run_id").agg(F.count_if(col("level") == "error").alias("errors"))
