"""What a run is to do: feeds, boards, searches and pending pages as one table of tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.config import DEFAULT, Config
from gleanery.functions.urls import page_label

col = F.col
#: The order of kinds in a run.
PRIORITY = {"feed": 10, "local_board": 12, "hn": 15, "ats_board": 20, "ats_board_discovered": 25, "search": 30, "ai_discovery": 40, "page": 60}


def priority(kind: Column) -> Column:
    return F.coalesce(*[F.when(kind == k, F.lit(v)) for k, v in PRIORITY.items()], F.lit(50))


def page_source(via: Column) -> Column:
    """Pages found by a local board belong to the board, others to the web."""
    return F.when(via.startswith("local_board:"), F.substring_index(via, ":", -1)).otherwise("web")


def boards(rows: DataFrame, most: int, most_failures: int = 5) -> DataFrame:
    """Never fetched boards first, then those with many relevant jobs, then the oldest fetch."""
    fit = rows.where(col("enabled") & (col("failures") < most_failures))
    return fit.orderBy(F.desc(col("last_fetched_hour").isNull()), F.desc("relevant_jobs"), F.asc_nulls_last("last_fetched_hour"), "id").limit(most)


def searches(queries: DataFrame, providers: DataFrame, run_id: int, most: int) -> DataFrame:
    """(query, provider, rank): every query with every provider, queries rotated by the run, the first `most`.

    Both are short configured lists (pos, value)."""
    n = queries.count()
    turn = F.pmod(col("q.pos") - F.lit(run_id % max(1, n)), F.lit(max(1, n)))
    pairs = queries.alias("q").crossJoin(F.broadcast(providers.alias("p"))).select(col("q.value").alias("query"), col("p.value").alias("provider"), (turn * 1000 + col("p.pos")).alias("rank"))
    return pairs.orderBy("rank").limit(most)


def pending_pages(links: DataFrame, budget: int, share: float = 0.5, most_attempts: int = 3) -> DataFrame:
    """The oldest pending pages, up to their share of the budget, one at least."""
    fit = links.where((col("status") == "pending") & (col("attempts") < most_attempts))
    return fit.orderBy("seen_hour", "id").limit(max(1, int(budget * share)))


def plan(feeds: DataFrame, board_rows: DataFrame, pairs: DataFrame, pages: DataFrame) -> DataFrame:
    """(kind, source, label, url, priority): the union of all, one task for each (kind, url)."""
    parts = [
        feeds.select("kind", "source", "label", "url"),
        board_rows.select(F.lit("ats_board").alias("kind"), col("provider").alias("source"), F.concat_ws(": ", "provider", "slug").alias("label"), F.concat_ws("/", F.lit("board:/"), "provider", "slug").alias("url")),
        pairs.select(F.lit("search").alias("kind"), col("provider").alias("source"), F.concat_ws(": ", "provider", "query").alias("label"), F.concat(F.lit("search://"), "provider", F.lit("/"), "query").alias("url")),
        pages.select(F.lit("page").alias("kind"), page_source(col("via")).alias("source"), F.substring("url", 1, 120).alias("label"), "url"),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.dropDuplicates(["kind", "url"]).withColumn("priority", priority(col("kind")))


def page_tasks(links: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    return links.select("id", page_source(col("via")).alias("source"), page_label(col("url")).alias("label"))


def materials_queue(postings: DataFrame, size: int, least: int = 85) -> DataFrame:
    """The best matches that can be applied to and have no materials yet."""
    fit = col("recommendation").isin("auto_apply_candidate", "manual_apply") & (col("match_score") >= least) & ~col("review_status").isin("rejected", "dismissed", "applied")
    return postings.where(fit & (col("materials_status") == "none")).orderBy(F.desc("match_score"), "id").limit(size)
