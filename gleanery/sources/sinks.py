"""Sinks: CSV export, the audit log, record schemas."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: The columns of an export, in order; columns that a table lacks are left out.
EXPORT = [
    "id", "first_seen_hour", "source", "title", "company_name", "location_text", "remote_type", "employment_type", "match_score", "recommendation", "review_status", "pipeline_status", "eligibility", "legitimacy_verdict",
    "apply_method", "pay_min", "pay_max", "source_url", "apply_url", "apply_email",
]


def export_csv(postings: DataFrame, path: str) -> None:
    """Newest first. Spark sorts by range, so the files in order of their names are the export."""
    columns = [c for c in EXPORT if c in postings.columns]
    postings.select(*columns).orderBy(F.desc("first_seen_hour"), "id").write.options(header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)


def read_export(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """An export as a table. A quoted empty value is an empty text, one without quotes is missing: what is read for the
    latter must not be an empty text too."""
    fields = StructType([schema[c] for c in EXPORT if c in schema.names])
    return spark.read.options(header=True, escape='"', multiLine=True, nullValue="\0").csv(path, schema=fields)


def event_rows(events: DataFrame) -> DataFrame:
    """Audit events as they are stored: level info by default, message cut to 4,000 characters."""
    return events.withColumns({"level": F.coalesce("level", F.lit("info")), "message": F.substring(F.coalesce("message", F.lit("")), 1, 4000)})


def append_events(events: DataFrame, path: str) -> None:
    event_rows(events).write.mode("append").parquet(path)


def record_schema(df: DataFrame, title: str) -> str:
    """A JSON Schema of a table's rows."""
    kinds = {"string": "string", "long": "integer", "integer": "integer", "double": "number", "boolean": "boolean", "timestamp": "string", "date": "string"}

    def node(t) -> dict:
        if isinstance(t, str):
            return {"type": kinds.get(t, "string")}
        if t["type"] == "array":
            return {"type": "array", "items": node(t["elementType"])}
        if t["type"] == "map":
            return {"type": "object", "additionalProperties": node(t["valueType"])}
        return {"type": "object", "properties": {f["name"]: node(f["type"]) for f in t["fields"]}}

    return json.dumps({"title": title} | node(json.loads(df.schema.json())), indent=1)
