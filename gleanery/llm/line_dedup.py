"""Line dedup by site-relative frequency.

For each host: the pages that contain a line, divided by the host's pages. Lines above the ratio, on
`min_pages` pages at least, are boilerplate and are dropped from every page of the host.

A host's boilerplate has fewer lines than its mean lines a page divided by the ratio, so it fits in an
array a host; that table is broadcast if small (measured), else joined by host, which adaptive execution
splits for a hot host. Counting aggregates (host, line hash) before it shuffles. A hash of 64 bits stands
for a line; a clash matters only with a boilerplate line of the same host.

Null texts and hosts count as empty. Blank lines are never dropped. A line that a page repeats counts once
for the page, and all its places go. Repeated rows count as pages each. An empty table gives an empty
result. Columns other than doc_id, text and the host don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.llm.common import BROADCAST_BYTES, cut

RATIO = 0.02
MIN_PAGES = 5


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def boilerplate(docs: DataFrame, host: str = "source", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, drop): the hashes of each host's boilerplate lines, for hosts that have some."""
    pages = docs.select(F.coalesce(F.col(host), F.lit("")).alias("host"), "text")
    filled = F.filter(lines_of(F.col("text")), lambda x: F.trim(x) != "")
    hashes = pages.select("host", F.explode(F.array_distinct(F.transform(filled, lambda x: F.xxhash64(x)))).alias("line"))
    counts = hashes.groupBy("host", "line").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_pages)
    totals = pages.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    over = cut(counts, "lines").join(cut(totals, "hosts"), "host").where(F.col("n") > F.col("pages") * ratio)
    return cut(over.groupBy("host").agg(F.collect_list("line").alias("drop")), "boilerplate")


def clean(docs: DataFrame, host: str = "source", ratio: float = RATIO, min_pages: int = MIN_PAGES, limit: int = BROADCAST_BYTES) -> DataFrame:
    """(doc_id, text, n_lines, n_dropped) for each row of docs."""
    table = boilerplate(docs, host, ratio, min_pages)
    lines = table.agg(F.sum(F.size("drop")), F.count(F.lit(1))).first()
    small = (lines[0] or 0) * 8 + lines[1] * 64 <= limit
    rows = docs.select("doc_id", "text", F.coalesce(F.col(host), F.lit("")).alias("host"))
    marked = rows.join(F.broadcast(table) if small else table.hint("merge"), "host", "left")
    marked = marked.select("doc_id", lines_of(F.col("text")).alias("lines"), "drop")
    kept = F.when(F.col("drop").isNull(), F.col("lines")).otherwise(
        F.filter("lines", lambda x: (F.trim(x) == "") | ~F.array_contains(F.col("drop"), F.xxhash64(x)))
    )
    marked = marked.select("doc_id", F.size("lines").alias("n_lines"), kept.alias("kept"))
    return marked.select("doc_id", F.array_join("kept", "\n").alias("text"), F.col("n_lines").cast("long"), (F.col("n_lines") - F.size("kept")).cast("long").alias("n_dropped"))
