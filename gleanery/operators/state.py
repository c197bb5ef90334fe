"""State transitions: each takes a table and what happened to it, and gives the table's next state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

col = F.col


def latest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key."""
    return rows.withColumn("_rank", F.row_number().over(W.partitionBy(key).orderBy(F.desc(order)))).where("_rank = 1").drop("_rank")


def board_health(boards: DataFrame, results: DataFrame) -> DataFrame:
    """Failure counters: reset by success, raised by failure, boards disabled where they are gone.

    results (id, ok, gone, at_hour): one row for each board fetched."""
    out = boards.join(results.select("id", "ok", "gone", col("at_hour").alias("_at")), "id", "left")
    return out.withColumns({
        "failures": F.when(col("ok"), 0).when(~col("ok"), col("failures") + 1).otherwise(col("failures")),
        "enabled": col("enabled") & ~F.coalesce(col("gone"), F.lit(False)),
        "last_fetched_hour": F.coalesce("_at", "last_fetched_hour"),
    }).drop("ok", "gone", "_at")


def frontier(links: DataFrame, results: DataFrame, most_attempts: int = 3) -> DataFrame:
    """URL states after a run: one more attempt each; failed ones wait until they were tried often enough."""
    out = links.join(results.select("id", col("status").alias("_status")), "id", "left")
    tried = col("_status").isNotNull()
    attempts = col("attempts") + tried.cast("int")
    again = (col("_status") == "failed") & (attempts < most_attempts)
    return out.withColumns({"status": F.when(again, "pending").when(tried, col("_status")).otherwise(col("status")), "attempts": attempts}).drop("_status")


def reset_stale(rows: DataFrame, now_hour: int, status: str, at: str, rules: dict[str, tuple[float, str]]) -> DataFrame:
    """Rows that stayed in a state longer than its hours go to another: {state: (hours, next)}."""
    out = col(status)
    for state, (hours, following) in rules.items():
        out = F.when((col(status) == state) & (col(at) < now_hour - hours), following).otherwise(out)
    return rows.withColumn(status, out)


def filtered(postings: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Postings with the rule stage's outcome; what a verdict leaves null keeps its value."""
    renamed = verdicts.select("id", *[col(c).alias(f"_{c}") for c in ("status", "recommendation", "reason")])
    out = postings.join(renamed, "id", "left")
    return out.withColumns({"pipeline_status": F.coalesce("_status", "pipeline_status"), "recommendation": F.coalesce("_recommendation", "recommendation"), "filter_reason": col("_reason")}).drop("_status", "_recommendation", "_reason")


def failed_analysis(postings: DataFrame, failures: DataFrame) -> DataFrame:
    """Failed analyses count an attempt and keep 500 characters of the error."""
    out = postings.join(failures.select("id", F.substring("error", 1, 500).alias("_error")), "id", "left")
    hit = col("_error").isNotNull()
    return out.withColumns({"pipeline_status": F.when(hit, "analysis_failed").otherwise(col("pipeline_status")), "analysis_attempts": col("analysis_attempts") + hit.cast("int"), "last_error": col("_error")}).drop("_error")


PROTECTED = ["applied", "ready_to_apply", "pending_approval", "approved"]


def retained(postings: DataFrame, now_hour: int, days: int = 14) -> DataFrame:
    """Without old postings, but for those in a protected state of review."""
    return postings.where((col("first_seen_hour") >= now_hour - 24 * days) | col("review_status").isin(PROTECTED))


def retained_tasks(tasks: DataFrame, now_hour: int, days: int = 14) -> DataFrame:
    return tasks.where(col("created_hour") >= now_hour - 24 * days)


def retained_links(links: DataFrame, now_hour: int, days: int = 14) -> DataFrame:
    """Without old addresses, but for leads."""
    return links.where((col("seen_hour") >= now_hour - 24 * days) | (col("status") == "lead_only"))


def retained_runs(runs: DataFrame, now_hour: int, days: int = 30) -> DataFrame:
    return runs.where(col("started_hour") >= now_hour - 24 * days)


def application_updates(applications: DataFrame, changes: DataFrame) -> DataFrame:
    """applications after changes (id, status, notes, at_hour) in order of time: what a change leaves null stays."""
    filled = lambda c: F.max_by(c, F.when(col(c).isNotNull(), col("at_hour"))).alias(f"_{c}")
    last = changes.groupBy("id").agg(filled("status"), filled("notes"), F.max("at_hour").alias("_at"))
    out = applications.join(last, "id", "left")
    return out.withColumns({"status": F.coalesce("_status", "status"), "notes": F.coalesce("_notes", "notes"), "updated_hour": F.coalesce("_at", "updated_hour")}).drop("_status", "_notes", "_at")


def board_upserts(boards: DataFrame, seeds: DataFrame) -> DataFrame:
    """boards and the configured seeds (provider, slug) that aren't stored yet; stored ones stay as they are."""
    fresh = seeds.select("provider", "slug").distinct().join(boards.select("provider", "slug"), ["provider", "slug"], "left_anti")
    return boards.unionByName(fresh, allowMissingColumns=True)


#: What a person's decision makes of the review state; reopening goes by the recommendation.
DECISIONS = {"approve": "approved", "reject": "rejected", "dismiss": "dismissed"}
REOPENED = {"auto_apply_candidate": "auto_apply_disabled", "manual_apply": "ready_to_apply", "approval_required": "pending_approval"}


def decided(postings: DataFrame, decisions: DataFrame) -> DataFrame:
    """Review states and notes after the last decision about each posting; a note alone keeps the state."""
    last = latest(decisions, "id", "at_hour").select("id", "decision", col("note").alias("_note"))
    out = postings.join(last, "id", "left")
    reopened = F.coalesce(*[F.when(col("recommendation") == k, F.lit(v)) for k, v in REOPENED.items()], F.lit("none"))
    to = F.coalesce(*[F.when(col("decision") == k, F.lit(v)) for k, v in DECISIONS.items()], F.when(col("decision") == "reopen", reopened), col("review_status"))
    note = F.when(col("decision") == "note", col("_note")).otherwise(F.coalesce("_note", "note"))
    return out.withColumns({"review_status": to, "note": note}).drop("decision", "_note")


def finished(tasks: DataFrame, run_id: int) -> DataFrame:
    """What a finished run leaves pending or running is skipped."""
    left = (col("run_id") == run_id) & col("status").isin("pending", "running")
    note = F.lit("Run finished before this task executed")
    return tasks.withColumns({"status": F.when(left, "skipped").otherwise(col("status")), "error": F.when(left, note).otherwise(col("error"))})


def outcomes(results: DataFrame) -> DataFrame:
    """(task_id, found, new): counts of each task's outcomes."""
    return results.groupBy("task_id").agg(F.count(F.lit(1)).alias("found"), F.count_if(col("outcome") == "new").alias("new"))


def next_versions(requests: DataFrame, materials: DataFrame) -> DataFrame:
    """requests with the version that each will have: after the stored ones, in order of the requests."""
    top = materials.groupBy("opportunity_id").agg(F.max("version").alias("_top"))
    place = F.row_number().over(W.partitionBy("opportunity_id").orderBy("id"))
    return requests.join(top, "opportunity_id", "left").withColumn("version", F.coalesce("_top", F.lit(0)) + place).drop("_top")


def prescored(postings: DataFrame, scores: DataFrame, statuses: tuple[str, ...] = ("new", "awaiting_ai", "analysis_failed")) -> DataFrame:
    """Postings without a queue score get theirs in the waiting states."""
    out = postings.join(scores.select("id", col("score").alias("_score")), "id", "left")
    fill = col("prescore").isNull() & col("pipeline_status").isin(*statuses)
    return out.withColumn("prescore", F.when(fill, col("_score")).otherwise(col("prescore"))).drop("_score")


def slotted(claimed: DataFrame, slots: int) -> DataFrame:
    """claimed rows (with `place`, their order of claim from 1) with `analysed`: the first ones get the slots."""
    return claimed.withColumn("analysed", col("place") <= slots)


def awaiting(postings: DataFrame, deferred: DataFrame) -> DataFrame:
    """Postings whose analysis was put off wait for it; the reason is kept."""
    out = postings.join(deferred.select("id", col("reason").alias("_reason")), "id", "left")
    return out.withColumns({"pipeline_status": F.when(col("_reason").isNotNull(), "awaiting_ai").otherwise(col("pipeline_status")), "wait_reason": col("_reason")}).drop("_reason")


def reprocessed(postings: DataFrame, ids: list[int]) -> DataFrame:
    """A person's selection goes back to the start."""
    again = col("id").isin(ids)
    return postings.withColumns({"pipeline_status": F.when(again, "new").otherwise(col("pipeline_status")), "analysis_attempts": F.when(again, 0).otherwise(col("analysis_attempts"))})


def notified(postings: DataFrame, digest: DataFrame, at_hour: int) -> DataFrame:
    """The digest's postings are marked with its time."""
    sent = digest.select("id", F.lit(True).alias("_sent"))  # a digest is short
    return postings.join(F.broadcast(sent), "id", "left").withColumn("notified_hour", F.when(col("_sent"), F.lit(at_hour)).otherwise(col("notified_hour"))).drop("_sent")


def run_closed(runs: DataFrame, run_id: int, added: dict[str, int]) -> DataFrame:
    """The run is completed; new statistics replace old ones of the same name."""
    mine = col("id") == run_id
    extra = F.create_map(*[F.lit(x) for k, v in added.items() for x in (k, v)])
    kept = F.map_filter("stats", lambda k, v: ~k.isin(*added))
    return runs.withColumns({"status": F.when(mine & (col("status") == "running"), "completed").otherwise(col("status")), "stats": F.when(mine, F.map_concat(kept, extra)).otherwise(col("stats"))})


def counter_bumped(runs: DataFrame, run_id: int, key: str) -> DataFrame:
    """One more in a named counter of a run."""
    kept = F.map_filter("stats", lambda k, v: k != key)
    one = F.create_map(F.lit(key), F.coalesce(F.element_at("stats", key), F.lit(0)) + 1)
    return runs.withColumn("stats", F.when(col("id") == run_id, F.map_concat(kept, one)).otherwise(col("stats")))


def run_failed(runs: DataFrame, error: str, run_id: int | None = None) -> DataFrame:
    """A running run fails; without an id the latest running one."""
    if run_id is None:
        latest_run = runs.where("status = 'running'").agg(F.max("id").alias("_id"))
        marked = runs.join(F.broadcast(latest_run), runs["id"] == col("_id"), "left")
        hit = col("_id").isNotNull()
    else:
        marked, hit = runs.withColumn("_id", F.lit(None)), (col("id") == run_id) & (col("status") == "running")
    return marked.withColumns({"error": F.when(hit, F.lit(error[:1000])).otherwise(col("error")), "status": F.when(hit, "failed").otherwise(col("status"))}).drop("_id")


def materials_done(postings: DataFrame, outcomes: DataFrame) -> DataFrame:
    """materials_status after attempts (id, outcome): deferred ones can be tried again."""
    to = {"deferred": "none", "failed": "failed", "verified": "generated", "unverified": "needs_review"}
    out = postings.join(outcomes.select("id", col("outcome").alias("_o")), "id", "left")
    return out.withColumn("materials_status", F.coalesce(*[F.when(col("_o") == k, F.lit(v)) for k, v in to.items()], col("materials_status"))).drop("_o")


def without_ids(rows: DataFrame, gone: DataFrame) -> DataFrame:
    return rows.join(gone.select("id"), "id", "left_anti")


def applied(requests: DataFrame, prior: DataFrame) -> DataFrame:
    """requests (id, company_norm, title_norm) with `accepted` and a reason: not where an application is known,
    and the first of a company and title among the requests."""
    first = requests.where("company_norm <> ''").groupBy("company_norm", "title_norm").agg(F.min("id").alias("_first"))
    out = requests.join(prior.select("id", "application_id"), "id", "left").join(first, ["company_norm", "title_norm"], "left")
    known = F.concat(F.lit("Already applied to this company for a similar role (application #"), col("application_id").cast("string"), F.lit(")"))
    reason = F.when(col("application_id").isNotNull(), known).when(col("_first") < col("id"), "An application for this company and role is already recorded")
    return out.withColumns({"reason": reason, "accepted": reason.isNull()}).drop("_first", "application_id")
