"""Named views of the posting table, search, orders and pages, and who is claimed next."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gleanery.config import DEFAULT, Config

col = F.col
ACTIONABLE = ["auto_apply_candidate", "manual_apply", "approval_required"]


#: The named views as predicates.
VIEWS: dict[str, Callable[[], Column]] = {
    "ready": lambda: col("review_status").isin("ready_to_apply", "approved", "auto_apply_disabled"),
    "needs_approval": lambda: col("review_status") == "pending_approval",
    "applied": lambda: col("review_status") == "applied",
    "analyzed": lambda: col("pipeline_status") == "analyzed",
    "awaiting": lambda: col("pipeline_status").isin("new", "processing", "awaiting_ai", "analysis_failed"),
    "filtered": lambda: (col("pipeline_status") == "filtered_out") | col("recommendation").isin("blocked", "ignore"),
    "rejected": lambda: col("review_status").isin("rejected", "dismissed"),
    "duplicates": lambda: col("pipeline_status") == "duplicate",
    "all": lambda: F.lit(True),
}
#: The orders, nulls last, ties by id.
ORDERS: dict[str, list[Callable[[], Column]]] = {
    "score": [lambda: F.desc_nulls_last("match_score"), lambda: F.desc("first_seen_hour")],
    "newest": [lambda: F.desc_nulls_last("first_seen_hour")],
    "posted": [lambda: F.desc_nulls_last("posted_hour"), lambda: F.desc("first_seen_hour")],
    "prescore": [lambda: F.desc_nulls_last("prescore"), lambda: F.desc("first_seen_hour")],
}


def view(postings: DataFrame, name: str, query: str | None = None, source: str | None = None) -> DataFrame:
    out = postings.where(VIEWS[name]())
    if query:
        out = out.where(col("title").ilike(f"%{query}%") | col("company_name").ilike(f"%{query}%"))
    return out.where(col("source") == source) if source else out


def page(postings: DataFrame, order: str, size: int, number: int = 0) -> DataFrame:
    """One page of an order: the top rows, no full sort."""
    return postings.orderBy(*[o() for o in ORDERS[order]], "id").offset(size * number).limit(size)


def view_counts(postings: DataFrame) -> DataFrame:
    return postings.agg(*[F.count_if(p()).alias(n) for n, p in VIEWS.items()])


def claimable(run_id: int, retry: bool = True, most_attempts: int = 3) -> Column:
    """New, or to be tried again; not yet processed in this run."""
    again = col("pipeline_status").isin("awaiting_ai", "analysis_failed") & (col("analysis_attempts") < most_attempts)
    fresh = (col("pipeline_status") == "new") | (again if retry else F.lit(False))
    return fresh & ~col("last_processed_run_id").eqNullSafe(F.lit(run_id))


def claim(postings: DataFrame, run_id: int, size: int) -> DataFrame:
    """The best rows first, by queue score."""
    best = [F.coalesce("prescore", F.lit(40)).desc(), F.desc_nulls_last("posted_hour"), F.desc("first_seen_hour"), F.asc("id")]
    return postings.where(claimable(run_id)).orderBy(*best).limit(size)


def claimed(postings: DataFrame, run_id: int, size: int) -> DataFrame:
    """`claim` with the place of each row. The batch is bounded, so its order fits one window."""
    best = [F.coalesce("prescore", F.lit(40)).desc(), F.desc_nulls_last("posted_hour"), F.desc("first_seen_hour"), F.asc("id")]
    return claim(postings, run_id, size).withColumn("place", F.row_number().over(W.partitionBy(F.lit(0)).orderBy(*best)))


def active_run(runs: DataFrame) -> DataFrame:
    """The newest running run, else the newest."""
    return runs.orderBy((col("status") == "running").desc(), F.desc("id")).limit(1)


def current_task(tasks: DataFrame, run_id: int) -> DataFrame:
    """The running task of a run that started first."""
    return tasks.where((col("run_id") == run_id) & (col("status") == "running")).orderBy("created_hour", "id").limit(1)


#: The sentences of the blockers are results that other systems compare.
def auto_apply_blockers(cfg: Config = DEFAULT, submitter: bool = False) -> Column:
    """Why a posting cannot be applied to automatically. Needs the columns recommendation, match_score,
    eligibility, legitimacy_verdict, apply_method, apply_email, materials_verified, prior_application."""
    note = lambda when, text: F.when(when, F.lit(text) if isinstance(text, str) else text)
    return F.array_compact(F.array(
        note(F.lit(not cfg.auto_apply_enabled), "applications.auto_apply_enabled is false in the configuration"),
        note(~col("recommendation").eqNullSafe(F.lit("auto_apply_candidate")), F.concat(F.lit("Recommendation is '"), F.coalesce("recommendation", F.lit("None")), F.lit("', not auto_apply_candidate"))),
        note(F.coalesce("match_score", F.lit(0)) < cfg.auto_apply_min, "Match score is below the automatic-application threshold"),
        note(~F.coalesce(col("eligibility").isin("eligible", "likely_eligible"), F.lit(False)), f"{cfg.home_label} eligibility is not confirmed"),
        note(~col("legitimacy_verdict").eqNullSafe(F.lit("legitimate")), "Company legitimacy is not confirmed"),
        note(~col("apply_method").eqNullSafe(F.lit("email")) | (F.coalesce("apply_email", F.lit("")) == ""), "No clear email application method (web forms and logins always need you)"),
        note(~F.coalesce("materials_verified", F.lit(False)), "No fact-checked tailored materials"),
        note(col("prior_application").isNotNull(), "An application to this company for a similar role already exists"),
        note(F.lit(not submitter), "No application submitter is installed"),
    ))


def capped(items: DataFrame, group: str, order: list[str], total: int, per_kind: dict[str, int]) -> DataFrame:
    """items with `admitted`: within the total of their group first, then within their kind's cap.

    order: columns by which a group's items come; together they must tell them apart. Only the first `total`
    items of each group are ever ranked: the caps bound them, and each partition finds its own first."""
    cap = F.coalesce(*[F.when(col("kind") == k, F.lit(v)) for k, v in per_kind.items()], F.lit(total))
    first = W.partitionBy(group).orderBy(*order)
    head = items.select(group, "kind", *order).withColumn("_rank", F.row_number().over(first)).where(col("_rank") <= total)  # a group limit, applied before the shuffle
    kinds = F.row_number().over(W.partitionBy(group, "kind").orderBy(*order))
    admitted = head.withColumn("_of_kind", kinds).where(col("_of_kind") <= cap).select(group, *order, F.lit(True).alias("_in"))
    return items.join(admitted, [group, *order], "left").withColumn("admitted", F.coalesce("_in", F.lit(False))).drop("_in").select(*items.columns, "admitted")


def feed(tasks: DataFrame, events: DataFrame, size: int) -> DataFrame:
    """The newest of two kinds of activity, one labelled list."""
    done = tasks.select(
        F.col("finished_hour").alias("at_hour"), F.col("id"),
        F.when(col("status") == "failed", "task_failed").when(col("status") == "done", "task_done").otherwise("task").alias("label"), F.col("source").alias("subject"))
    scored = events.select("at_hour", "id", F.lit("scored").alias("label"), "subject")
    return done.unionByName(scored).orderBy(F.desc("at_hour"), "label", "id", "subject").limit(size)
