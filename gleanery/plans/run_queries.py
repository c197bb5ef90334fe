"""Queries on runs: plans, queues, logs, closing transitions. Each with SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.config import DEFAULT as C
from gleanery.functions import money
from gleanery.operators import joins, planning, reports, state, views
from gleanery.plans import postings
from gleanery.plans.derived import NOW_HOUR as NOW
from gleanery.plans.derived import derived, with_tables
from gleanery.plans.report_queries import ACTIONABLE, RUN, opps
from gleanery.session import table
from gleanery.sources import sinks

col = F.col
Q: dict[str, tuple] = {}


def query(sql: str | None = None, *names: str):
    def add(f):
        Q[f.__name__] = (f, (with_tables(sql, *names) if names else sql) if sql else None)
        return f

    return add


@query("""WITH b AS (SELECT provider, slug FROM boards WHERE enabled AND failures < 5 ORDER BY (last_fetched_hour IS NULL) DESC, relevant_jobs DESC, last_fetched_hour ASC, id LIMIT 40),
 p AS (SELECT DISTINCT url FROM (SELECT url FROM links WHERE status = 'pending' AND attempts < 3 ORDER BY seen_hour, id LIMIT 85)), f AS (SELECT DISTINCT source FROM tasks WHERE kind = 'feed'),
 q AS (SELECT row_number() OVER (ORDER BY n_name) - 1 AS pos, n_name FROM nation), s AS (SELECT n_name, prov FROM q, (VALUES (0, 'brave'), (1, 'tavily')) v(k, prov) ORDER BY ((pos - 7) % 25 + 25) % 25 * 1000 + k LIMIT 20)
 SELECT 'ats_board' AS kind, count(*) AS n, 20 AS priority FROM b UNION ALL SELECT 'page', count(*), 60 FROM p UNION ALL SELECT 'feed', count(*), 10 FROM f UNION ALL SELECT 'search', count(*), 30 FROM s""", "boards", "links", "tasks")
def run_plan(spark, d) -> DataFrame:
    """Planned tasks by kind; names of nations stand for search queries."""
    from pyspark.sql import Window as W

    feeds = derived(spark, d, "tasks").where("kind = 'feed'").select("kind", "source", col("source").alias("label"), F.concat(F.lit("feed://"), "source").alias("url")).distinct()
    names = table(spark, d, "nation").select((F.row_number().over(W.orderBy("n_name")) - 1).alias("pos"), col("n_name").alias("value"))  # 25 nations
    providers = spark.createDataFrame([(0, "brave"), (1, "tavily")], "pos int, value string")
    links = derived(spark, d, "links")
    out = planning.plan(feeds, planning.boards(derived(spark, d, "boards"), C.max_boards_per_run), planning.searches(names, providers, RUN, 20), planning.pending_pages(links, C.max_pages_per_run))
    return out.groupBy("kind", "priority").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT id, CASE WHEN starts_with(via, 'local_board:') THEN split_part(via, ':', 2) ELSE 'web' END AS source FROM links", "links")
def page_attribution(spark, d):
    return planning.page_tasks(derived(spark, d, "links")).select("id", "source")


@query(f"SELECT source, count(*) FILTER (status = 'ok') AS ok, count(*) FILTER (status <> 'ok') AS problems, CAST(sum(items_found) AS BIGINT) AS found FROM tasks WHERE created_hour > {NOW} - 168 AND kind = 'search' GROUP BY source", "tasks")
def search_health(spark, d):
    return reports.search_health(derived(spark, d, "tasks"), NOW)


@query(f"SELECT count(*) FILTER (status = 'ok') AS ok, count(*) FILTER (status = 'blocked') AS blocked, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'skipped') AS skipped FROM tasks WHERE created_hour > {NOW} - 168 AND kind = 'page'", "tasks")
def page_health(spark, d):
    return reports.page_health(derived(spark, d, "tasks"), NOW)


@query("""WITH u AS (SELECT run_id, sum(cost_micro) AS c FROM usage GROUP BY run_id)
 SELECT last_processed_run_id AS run_id, count(*) AS processed, count(*) FILTER (pipeline_status = 'filtered_out') AS filtered_out, count(*) FILTER (pipeline_status = 'analyzed') AS analyzed, count(*) FILTER (pipeline_status = 'awaiting_ai') AS awaiting_ai,
 count(*) FILTER (pipeline_status = 'analysis_failed') AS analysis_failed, count(*) FILTER (recommendation = 'blocked') AS blocked, count(*) FILTER (recommendation = 'auto_apply_candidate') AS auto_apply_candidates, count(*) FILTER (recommendation = 'manual_apply') AS manual_apply,
 count(*) FILTER (recommendation = 'approval_required') AS approval_required, count(*) FILTER (recommendation = 'ignore') AS ignored, CAST(coalesce(max(c), 0) AS BIGINT) AS cost_micro
 FROM opportunities o LEFT JOIN u ON u.run_id = last_processed_run_id WHERE last_processed_run_id IS NOT NULL GROUP BY last_processed_run_id""", "opportunities", "usage")
def processed_stats(spark, d):
    return reports.processed_stats(opps(spark, d), derived(spark, d, "usage"))


@query("SELECT id, run_id, kind FROM tasks WHERE status = 'failed' AND kind = 'page' ORDER BY finished_hour DESC, id LIMIT 200", "tasks")
def event_log(spark, d):
    rows = derived(spark, d, "tasks").where("status = 'failed' and kind = 'page'")
    return rows.orderBy(F.desc("finished_hour"), "id").limit(200).select("id", "run_id", "kind")


@query("SELECT id, url FROM links WHERE status = 'lead_only' ORDER BY seen_hour DESC, id LIMIT 300", "links")
def lead_list(spark, d):
    return derived(spark, d, "links").where("status = 'lead_only'").orderBy(F.desc("seen_hour"), "id").limit(300).select("id", "url")


@query("SELECT id, slug FROM boards ORDER BY enabled DESC, last_fetched_hour DESC NULLS FIRST, id LIMIT 1000", "boards")
def board_list(spark, d):
    return derived(spark, d, "boards").orderBy(F.desc("enabled"), F.desc_nulls_first("last_fetched_hour"), "id").limit(1000).select("id", "slug")


@query("SELECT id, kind, status FROM tasks WHERE run_id = 7 ORDER BY priority, id", "tasks")
def run_tasks(spark, d):
    return derived(spark, d, "tasks").where(col("run_id") == RUN).orderBy("priority", "id").select("id", "kind", "status")


@query("SELECT id, match_score FROM opportunities WHERE recommendation IN ('auto_apply_candidate', 'manual_apply') AND match_score >= 85 AND review_status NOT IN ('rejected', 'dismissed', 'applied') AND id % 5 > 0 ORDER BY match_score DESC, id LIMIT 12", "opportunities")
def materials_queue(spark, d):
    """The best matches without materials; every fifth posting has some."""
    rows = opps(spark, d).withColumn("materials_status", F.when(col("id") % 5 == 0, "generated").otherwise("none"))
    return planning.materials_queue(rows, 12).select("id", "match_score")


@query("SELECT id, title, source FROM opportunities", "opportunities")
def exported_rows(spark, d):
    return opps(spark, d).select(*[c for c in sinks.EXPORT if c in ("id", "title", "source")])


@query("SELECT event_id AS id, CASE WHEN event_id % 3 = 0 THEN 'warn' ELSE 'info' END AS level, left(repeat(event_type, 700), 4000) AS message FROM events")
def audit_events(spark, d):
    rows = table(spark, d, "events").select(col("event_id").alias("id"), F.when(col("event_id") % 3 == 0, "warn").alias("level"), F.repeat("event_type", F.lit(700)).alias("message"))
    return sinks.event_rows(rows)


@query("SELECT id, CASE WHEN prescore_value <= 5 AND pipeline_status IN ('new', 'awaiting_ai', 'analysis_failed') THEN CAST(id % 90 AS INT) WHEN prescore_value > 5 THEN prescore_value END AS prescore FROM opportunities", "opportunities")
def prescore_backfill(spark, d):
    rows = opps(spark, d)
    return state.prescored(rows, rows.select("id", (col("id") % 90).cast("int").alias("score"))).select("id", "prescore")


@query("SELECT id, CASE WHEN id % 10 = 3 THEN 'awaiting_ai' WHEN id % 10 = 4 THEN 'analysis_failed' WHEN id IN (5, 15) THEN 'new' ELSE pipeline_status END AS pipeline_status, CAST(CASE WHEN id IN (5, 15) THEN 0 ELSE analysis_attempts + CASE WHEN id % 10 = 4 THEN 1 ELSE 0 END END AS INT) AS analysis_attempts FROM opportunities", "opportunities")
def analysis_transitions(spark, d):
    rows = opps(spark, d)
    rows = state.awaiting(rows, rows.where("id % 10 = 3").select("id", F.lit("no slots").alias("reason")))
    rows = state.failed_analysis(rows, rows.where("id % 10 = 4").select("id", F.lit("boom").alias("error")))
    return state.reprocessed(rows, [5, 15]).select("id", "pipeline_status", "analysis_attempts")


@query(f"""WITH t AS (SELECT id FROM opportunities WHERE pipeline_status = 'analyzed' AND recommendation IN {ACTIONABLE} AND review_status NOT IN ('rejected', 'dismissed', 'applied') ORDER BY match_score DESC, id LIMIT 25)
 SELECT count(*) AS n, count(*) FILTER (id IN (SELECT id FROM t)) AS notified FROM opportunities""", "opportunities")
def notified_items(spark, d):
    rows = opps(spark, d).withColumn("notified_hour", F.lit(None).cast("int"))
    fit = rows.where((col("pipeline_status") == "analyzed") & col("recommendation").isin(views.ACTIONABLE) & ~col("review_status").isin("rejected", "dismissed", "applied"))
    digest = fit.orderBy(F.desc("match_score"), "id").limit(25)
    return state.notified(rows, digest, NOW).agg(F.count(F.lit(1)).alias("n"), F.count("notified_hour").alias("notified"))


@query("""SELECT id, concat_ws(' · ', remote_type, nullif(replace(coalesce(eligibility, ''), '_', ' '), ''), CASE pay_text WHEN '$40k - $60k per year' THEN 'NPR 466,667-700,000/mo' WHEN 'NPR 30,000 - 50,000' THEN 'NPR 30,000-50,000/mo' WHEN '€25/hour' THEN 'NPR 632,000/mo' WHEN 'Rs. 800,000' THEN 'NPR 66,667/mo'
 WHEN '£1,500 per month' THEN 'NPR 277,500/mo' WHEN 'USD 120-150k' THEN 'NPR 1,400-1,750,000/mo' WHEN '₹ 90000 monthly' THEN 'NPR 144,000/mo' END, CASE WHEN id % 3 = 0 THEN 'materials ✓' WHEN id % 3 = 1 THEN 'materials need review' END) AS line FROM opportunities""", "opportunities")
def digest_lines(spark, d):
    rows = postings.formed(opps(spark, d))
    made = F.when(col("id") % 3 == 0, "generated").when(col("id") % 3 == 1, "needs_review").otherwise("none")
    return rows.select("id", reports.digest_line(col("remote_type"), col("eligibility"), money.pay_label(col("pay_min"), col("pay_max")), made).alias("line"))


RUNS_SQL = "SELECT c_custkey AS id, CASE c_custkey % 3 WHEN 0 THEN 'running' WHEN 1 THEN 'completed' ELSE 'failed' END AS status, CAST(NULL AS STRING) AS error FROM customer"


def runs(spark, d) -> DataFrame:
    rows = spark.sql(RUNS_SQL.replace("FROM customer", "FROM {given}"), given=table(spark, d, "customer"))
    return rows.withColumn("stats", F.create_map(F.lit("fetch"), (col("id") % 5).cast("int"), F.lit("found"), F.lit(3)))


@query(f"""WITH r AS ({RUNS_SQL}), m AS (SELECT max(id) AS latest FROM r WHERE status = 'running')
 SELECT id, CASE WHEN id = latest THEN 'failed' WHEN id = 12 AND status = 'running' THEN 'completed' ELSE status END AS status, CASE WHEN id = latest THEN 'quota' END AS error,
 CAST(id % 5 + CASE WHEN id = 9 THEN 1 ELSE 0 END AS INT) AS fetch, CASE WHEN id = 12 THEN 8 ELSE 3 END AS found FROM r, m""")
def run_closing(spark, d):
    rows = state.run_failed(runs(spark, d), "quota")
    rows = state.counter_bumped(state.run_closed(rows, 12, {"found": 8}), 9, "fetch")
    return rows.select("id", "status", "error", F.element_at("stats", "fetch").alias("fetch"), F.element_at("stats", "found").alias("found"))


@query("SELECT id, CASE id % 7 WHEN 0 THEN 'none' WHEN 1 THEN 'failed' WHEN 2 THEN 'generated' WHEN 3 THEN 'needs_review' ELSE 'generating' END AS materials_status FROM opportunities WHERE id % 11 <> 5", "opportunities")
def materials_outcomes(spark, d):
    rows = opps(spark, d).withColumn("materials_status", F.lit("generating"))
    said = rows.select("id", F.get(F.array(*map(F.lit, ("deferred", "failed", "verified", "unverified"))), (col("id") % 7).cast("int")).alias("outcome")).where("outcome is not null")
    return state.without_ids(state.materials_done(rows, said), rows.where("id % 11 = 5")).select("id", "materials_status")


@query("""WITH r AS (SELECT id, coalesce(company_name, '') AS c, title AS t FROM opportunities), f AS (SELECT c, t, min(id) AS first FROM r WHERE c <> '' GROUP BY c, t)
 SELECT id, NOT (id % 9 = 0 OR coalesce(first < id, false)) AS accepted FROM r LEFT JOIN f USING (c, t)""", "opportunities")
def applied_requests(spark, d):
    rows = opps(spark, d).select("id", F.coalesce("company_name", F.lit("")).alias("company_norm"), col("title").alias("title_norm"))
    prior = rows.where("id % 9 = 0").select("id", F.lit(1).cast("long").alias("application_id"))
    return state.applied(rows, prior).select("id", "accepted")


@query("WITH r AS (SELECT opportunity_id, arg_max(id, applied_hour * 1000000 + id) AS id FROM applications GROUP BY opportunity_id) SELECT * FROM r", "applications")
def latest_per_posting(spark, d):
    rows = derived(spark, d, "applications").withColumn("order", col("applied_hour") * 1_000_000 + col("id"))
    return state.latest(rows, "opportunity_id", "order").select("opportunity_id", "id")


@query("SELECT run_id, kind, CAST(sum(items_found) AS BIGINT) AS found FROM tasks WHERE status = 'ok' GROUP BY run_id, kind", "tasks")
def found_by_kind(spark, d):
    return derived(spark, d, "tasks").where("status = 'ok'").groupBy("run_id", "kind").agg(F.sum("items_found").alias("found"))


@query("SELECT id, min(seen) AS seen FROM (SELECT sha256(url) AS k, id, min(id) OVER (PARTITION BY sha256(url)) AS seen FROM links) WHERE id = seen GROUP BY id", "links")
def first_arrivals(spark, d):
    rows = derived(spark, d, "links").withColumn("k", F.sha2("url", 256))
    return joins.first_arrivals(rows, ["k"], ["id"]).select("id", col("id").alias("seen"))


QUERIES = Q
