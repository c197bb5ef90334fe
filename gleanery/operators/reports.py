"""Aggregates of the dashboards: counts, funnels, health, spend, run statistics. Hours are since 1970."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

col = F.col
PASSED = ["analyzed", "awaiting_ai", "analysis_failed"]
ACTIONABLE = ["auto_apply_candidate", "manual_apply", "approval_required"]


def since(column: str, now_hour: int, days: int) -> Column:
    return col(column) > now_hour - 24 * days


def kpis(postings: DataFrame, now_hour: int) -> DataFrame:
    return postings.agg(
        F.count_if(since("first_seen_hour", now_hour, 1)).alias("discovered_24h"),
        F.count_if(since("first_seen_hour", now_hour, 7)).alias("discovered_7d"),
        F.count_if(col("review_status") == "pending_approval").alias("needs_approval"),
        F.count_if(col("review_status").isin("ready_to_apply", "approved", "auto_apply_disabled")).alias("ready_to_apply"),
        F.count_if(col("review_status") == "applied").alias("applied"),
        F.count_if(col("pipeline_status").isin("new", "awaiting_ai", "analysis_failed")).alias("awaiting_analysis"),
        F.count(F.lit(1)).alias("total"),
    )


def funnel(postings: DataFrame, now_hour: int, approval_min: int, strong_min: int, days: int = 7) -> DataFrame:
    return postings.where(since("first_seen_hour", now_hour, days)).agg(
        F.count(F.lit(1)).alias("discovered"),
        F.count_if(col("pipeline_status") != "duplicate").alias("unique_postings"),
        F.count_if(col("pipeline_status").isin(PASSED)).alias("passed_filters"),
        F.count_if(col("pipeline_status") == "analyzed").alias("analyzed"),
        F.count_if((col("match_score") >= approval_min) & col("recommendation").isin(ACTIONABLE)).alias("matches"),
        F.count_if((col("match_score") >= strong_min) & col("recommendation").isin(ACTIONABLE[:2])).alias("strong_matches"),
    )


def shares(df: DataFrame, of: str) -> DataFrame:
    """Each counter as a percentage of one of them, rounded to one digit."""
    return df.select(*[F.round(100.0 * col(c) / F.nullif(col(of), F.lit(0)), 1).alias(f"{c}_pct") for c in df.columns])


def local_day(hour: str, offset_minutes: int) -> Column:
    """Days since 1970 in a zone of fixed offset."""
    return F.floor((col(hour) * 60 + offset_minutes) / 1440)


def daily(postings: DataFrame, now_hour: int, offset_minutes: int, days: int = 14) -> DataFrame:
    """Postings a local day, zero-filled: the calendar is made, not read, and has `days` rows."""
    last = (now_hour * 60 + offset_minutes) // 1440
    spine = postings.sparkSession.range(last - days + 1, last + 1).select(col("id").alias("day"))
    counts = postings.groupBy(local_day("first_seen_hour", offset_minutes).alias("day")).agg(F.count(F.lit(1)).alias("discovered"), F.count_if(col("recommendation").isin(ACTIONABLE)).alias("matches"))
    zero = F.lit(0).cast("long")
    return F.broadcast(spine).join(counts, "day", "left").select("day", F.coalesce("discovered", zero).alias("discovered"), F.coalesce("matches", zero).alias("matches"))


def source_name(kind: Column, source: Column) -> Column:
    return (
        F.when(kind == "ats_board", "ATS company boards").when(kind == "page", "Web pages")
        .when(kind == "search", F.concat(F.lit("Search: "), source)).when(kind == "ai_discovery", "Claude web search").otherwise(source)
    )


def outcome_counts() -> list[Column]:
    return [F.count_if(col("status") == s).alias(s) for s in ("ok", "failed", "blocked", "skipped")] + [F.sum("items_found").alias("found"), F.sum("items_new").alias("new"), F.max("finished_hour").alias("last_run")]


def source_buckets(tasks: DataFrame, now_hour: int, days: int = 7) -> DataFrame:
    return tasks.where(since("created_hour", now_hour, days)).groupBy(source_name(col("kind"), col("source")).alias("name")).agg(*outcome_counts())


def source_health(tasks: DataFrame, now_hour: int, days: int = 7) -> DataFrame:
    """Outcomes of each source's recent tasks, with its latest error."""
    recent = tasks.where(since("created_hour", now_hour, days) & col("kind").isin("feed", "hn", "local_board"))
    return recent.groupBy("source").agg(*outcome_counts(), F.max_by("error", F.when(col("error").isNotNull(), col("id"))).alias("last_note"))


def health_verdict(enabled: Column) -> Column:
    """What a source's counters say."""
    failed = (col("failed") > 0) | (col("blocked") > 0)
    return (
        F.when(~enabled, "Off").when((col("ok") == 0) & (col("skipped") > 0), "Skipped").when((col("ok") == 0) & failed, "Failing")
        .when(col("ok") == 0, "Not run yet").when(col("found") == 0, "No results").when(col("failed") > col("ok"), "Unreliable").otherwise("Healthy")
    )


def sources_overview(config: DataFrame, health: DataFrame, stored: DataFrame) -> DataFrame:
    """Every configured source with health and stored postings; zero where there are none."""
    counters = ["ok", "failed", "blocked", "skipped", "found", "new", "stored"]
    return config.join(health, "source", "left").join(stored, "source", "left").na.fill(0, counters)


def spend(usage: DataFrame, now_hour: int, offset_minutes: int) -> DataFrame:
    """Cost of the local day, of 7 and of 30 days."""
    today = local_day("at_hour", offset_minutes) == (now_hour * 60 + offset_minutes) // 1440
    part = lambda when: F.coalesce(F.sum(F.when(when, col("cost_micro"))), F.lit(0))
    return usage.agg(part(today).alias("today"), part(since("at_hour", now_hour, 7)).alias("last_7d"), part(since("at_hour", now_hour, 30)).alias("last_30d"))


def over_budget(usage: DataFrame, now_hour: int, offset_minutes: int, daily_micro: int) -> DataFrame:
    """Spent today against a daily budget; zero or less means no limit."""
    spent = spend(usage, now_hour, offset_minutes).select(col("today").alias("spent"))
    return spent.withColumn("exceeded", F.lit(daily_micro > 0) & (col("spent") >= daily_micro))


def by_source(postings: DataFrame) -> DataFrame:
    return postings.groupBy("source").agg(F.count(F.lit(1)).alias("n"))


def progress(tasks: DataFrame, postings: DataFrame) -> DataFrame:
    """How far each run is: its tasks, and what it discovered and processed."""
    over = F.count_if(~col("status").isin("pending", "running"))
    done = tasks.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("total"), over.alias("done"), *[F.count_if(col("status") == s).alias(s) for s in ("ok", "failed", "blocked", "running")],
        F.round(over / F.count(F.lit(1)), 3).alias("fraction"))
    first = postings.groupBy("run_id").agg(F.count(F.lit(1)).alias("discovered"))
    later = postings.where("last_processed_run_id is not null").groupBy(col("last_processed_run_id").alias("run_id")).agg(
        F.count(F.lit(1)).alias("processed"), F.count_if(col("pipeline_status") == "analyzed").alias("analyzed"), F.count_if(col("recommendation").isin(ACTIONABLE)).alias("matches"))
    return done.join(first, "run_id", "left").join(later, "run_id", "left").na.fill(0, ["discovered", "processed", "analyzed", "matches"])


def usage_by(usage: DataFrame, *keys: str) -> DataFrame:
    sums = [F.sum(c).alias(c) for c in ("tokens_in", "tokens_out", "searches", "cost_micro")]
    return usage.groupBy(*keys).agg(F.count(F.lit(1)).alias("calls"), *sums, F.countDistinct("opportunity_id").alias("postings"))


def run_stats(tasks: DataFrame) -> DataFrame:
    """Per run a map of kind to a map of status to count."""
    counts = tasks.groupBy("run_id", "kind", "status").agg(F.count(F.lit(1)).alias("n"))
    kinds = counts.groupBy("run_id", "kind").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("status", "n")))).alias("statuses"))
    return kinds.groupBy("run_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("kind", F.to_json("statuses").alias("s"))))).alias("kinds")).select("run_id", F.to_json("kinds").alias("stats"))


def response_rate(applications: DataFrame) -> DataFrame:
    """Applications by status (unknown ones count as applied) and the percentage that got an answer."""
    known = ["applied", "interviewing", "offer", "rejected", "withdrawn"]
    status = F.when(col("status").isin(known), col("status")).otherwise("applied")
    rows = applications.select(status.alias("status"))
    answered = col("status").isin("interviewing", "offer", "rejected")
    rate = F.floor(100.0 * F.count_if(answered) / F.count(F.lit(1)) + 0.5)
    return rows.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(col("status") == s).alias(s) for s in known], F.coalesce(rate, F.lit(0)).alias("response_rate"))


def run_costs(runs: DataFrame, usage: DataFrame) -> DataFrame:
    """Cost of each run, zero for runs without calls: aggregated before the join."""
    cost = usage.groupBy("run_id").agg(F.sum("cost_micro").alias("cost_micro"))
    return runs.join(cost, "run_id", "left").na.fill(0, ["cost_micro"])


def remaining(postings: DataFrame, run_id: int) -> DataFrame:
    from gleanery.operators.views import claimable

    return postings.agg(F.count_if(claimable(run_id)).alias("remaining"))


def search_health(tasks: DataFrame, now_hour: int, days: int = 7) -> DataFrame:
    recent = tasks.where(since("created_hour", now_hour, days) & (col("kind") == "search"))
    return recent.groupBy("source").agg(F.count_if(col("status") == "ok").alias("ok"), F.count_if(col("status") != "ok").alias("problems"), F.sum("items_found").alias("found"))


def page_health(tasks: DataFrame, now_hour: int, days: int = 7) -> DataFrame:
    recent = tasks.where(since("created_hour", now_hour, days) & (col("kind") == "page"))
    return recent.agg(*[F.count_if(col("status") == s).alias(s) for s in ("ok", "blocked", "failed", "skipped")])


def processed_stats(postings: DataFrame, usage: DataFrame) -> DataFrame:
    """For each run: what it processed, how that ended, and its cost."""
    status = {"filtered_out": "filtered_out", "analyzed": "analyzed", "awaiting_ai": "awaiting_ai", "analysis_failed": "analysis_failed"}
    advice = {"blocked": "blocked", "auto_apply_candidates": "auto_apply_candidate", "manual_apply": "manual_apply", "approval_required": "approval_required", "ignored": "ignore"}
    done = postings.where("last_processed_run_id is not null").groupBy(col("last_processed_run_id").alias("run_id")).agg(
        F.count(F.lit(1)).alias("processed"), *[F.count_if(col("pipeline_status") == v).alias(k) for k, v in status.items()], *[F.count_if(col("recommendation") == v).alias(k) for k, v in advice.items()])
    return run_costs(done, usage)


def warnings(spent: Column, budget: Column, last_status: Column, last_error: Column) -> Column:
    """What the overview warns about."""
    error = F.lower(F.coalesce(last_error, F.lit("")))
    quota = (last_status == "failed") & (error.contains("quota") | error.contains("429"))
    return F.array_compact(F.array(F.when(quota, "AI API Quota Exceeded"), F.when((budget > 0) & (spent >= budget), "Daily AI budget cap reached")))


def digest_line(mode: Column, eligibility: Column, pay: Column, materials: Column) -> Column:
    """The details of a digest item, joined by dots; empty parts are left out."""
    note = F.when(materials == "generated", "materials ✓").when(materials == "needs_review", "materials need review")
    parts = F.array(mode, F.replace(eligibility, F.lit("_"), F.lit(" ")), pay, note)
    return F.array_join(F.filter(parts, lambda x: x.isNotNull() & (x != "")), " · ")
