"""Queries on the derived tables: dashboards, views, joins, transitions. Each with SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.config import DEFAULT as C
from gleanery.functions import text, urls
from gleanery.operators import dedup, joins, reports, state, views
from gleanery.plans import oracle as o
from gleanery.plans.derived import NOW_HOUR as NOW
from gleanery.plans.derived import derived, with_tables

col = F.col
ZONE = 345  # minutes: the configured zone has no summer time
RUN = 7


def opps(spark, d) -> DataFrame:
    return derived(spark, d, "opportunities").withColumn("prescore", F.when(col("prescore_value") > 5, col("prescore_value")))


ACTIONABLE = "('auto_apply_candidate', 'manual_apply', 'approval_required')"
Q: dict[str, tuple] = {}


def query(sql: str | None = None, *names: str):
    """Registers a query under its function's name."""

    def add(f):
        Q[f.__name__] = (f, with_tables(sql, *names) if sql else None)
        return f

    return add


@query(f"""SELECT count(*) FILTER (first_seen_hour > {NOW} - 24) AS discovered_24h, count(*) FILTER (first_seen_hour > {NOW} - 168) AS discovered_7d, count(*) FILTER (review_status = 'pending_approval') AS needs_approval,
 count(*) FILTER (review_status IN ('ready_to_apply', 'approved', 'auto_apply_disabled')) AS ready_to_apply, count(*) FILTER (review_status = 'applied') AS applied,
 count(*) FILTER (pipeline_status IN ('new', 'awaiting_ai', 'analysis_failed')) AS awaiting_analysis, count(*) AS total FROM opportunities""", "opportunities")
def kpis(spark, d):
    return reports.kpis(opps(spark, d), NOW)


FUNNEL = f"""SELECT count(*) AS discovered, count(*) FILTER (pipeline_status <> 'duplicate') AS unique_postings, count(*) FILTER (pipeline_status IN ('analyzed', 'awaiting_ai', 'analysis_failed')) AS passed_filters,
 count(*) FILTER (pipeline_status = 'analyzed') AS analyzed, count(*) FILTER (match_score >= 70 AND recommendation IN {ACTIONABLE}) AS matches,
 count(*) FILTER (match_score >= 85 AND recommendation IN ('auto_apply_candidate', 'manual_apply')) AS strong_matches FROM opportunities WHERE first_seen_hour > {NOW} - 168"""


@query(FUNNEL, "opportunities")
def funnel(spark, d):
    return reports.funnel(opps(spark, d), NOW, C.approval_min, C.auto_apply_min)


@query("SELECT " + ", ".join(f"round(100.0 * {c} / nullif(discovered, 0), 1) AS {c}_pct" for c in ("discovered", "unique_postings", "passed_filters", "analyzed", "matches", "strong_matches")) + f" FROM ({FUNNEL})", "opportunities")
def funnel_shares(spark, d):
    return reports.shares(funnel(spark, d), "discovered")


@query(f"""SELECT day, count(id) AS discovered, count(id) FILTER (recommendation IN {ACTIONABLE}) AS matches
 FROM (SELECT unnest(range(({NOW} * 60 + {ZONE}) // 1440 - 13, ({NOW} * 60 + {ZONE}) // 1440 + 1)) AS day) LEFT JOIN opportunities ON (first_seen_hour * 60 + {ZONE}) // 1440 = day GROUP BY day""", "opportunities")
def daily(spark, d):
    return reports.daily(opps(spark, d), NOW, ZONE)


_COUNTS = ", ".join(f"count(*) FILTER (status = '{s}') AS {s}" for s in ("ok", "failed", "blocked", "skipped")) + ", CAST(sum(items_found) AS BIGINT) AS found, CAST(sum(items_new) AS BIGINT) AS new, max(finished_hour) AS last_run"


@query(f"""SELECT CASE WHEN kind = 'ats_board' THEN 'ATS company boards' WHEN kind = 'page' THEN 'Web pages' WHEN kind = 'search' THEN concat('Search: ', source) ELSE source END AS name, {_COUNTS}
 FROM tasks WHERE created_hour > {NOW} - 168 GROUP BY 1""", "tasks")
def source_buckets(spark, d):
    return reports.source_buckets(derived(spark, d, "tasks"), NOW)


HEALTH = f"SELECT source, {_COUNTS}, arg_max(error, id) FILTER (error IS NOT NULL) AS last_note FROM tasks WHERE created_hour > {NOW} - 168 AND kind IN ('feed', 'hn', 'local_board') GROUP BY source"


@query(HEALTH, "tasks")
def source_health(spark, d):
    return reports.source_health(derived(spark, d, "tasks"), NOW)


@query(f"""WITH health AS ({HEALTH}), stored AS (SELECT source, count(*) AS stored FROM opportunities GROUP BY source), c AS (SELECT DISTINCT source, source <> 'lever' AS enabled FROM opportunities),
 j AS (SELECT source, enabled, {', '.join(f'coalesce({x}, 0) AS {x}' for x in ('ok', 'failed', 'blocked', 'skipped', 'found', 'new', 'stored'))} FROM c LEFT JOIN health USING (source) LEFT JOIN stored USING (source))
 SELECT *, CASE WHEN NOT enabled THEN 'Off' WHEN ok = 0 AND skipped > 0 THEN 'Skipped' WHEN ok = 0 AND failed + blocked > 0 THEN 'Failing' WHEN ok = 0 THEN 'Not run yet' WHEN found = 0 THEN 'No results' WHEN failed > ok THEN 'Unreliable' ELSE 'Healthy' END AS verdict FROM j""", "opportunities", "tasks")
def sources_overview(spark, d):
    postings = opps(spark, d)
    config = postings.select("source").distinct().withColumn("enabled", col("source") != "lever")
    stored = reports.by_source(postings).withColumnRenamed("n", "stored")
    health = source_health(spark, d).drop("last_run", "last_note")
    return reports.sources_overview(config, health, stored).withColumn("verdict", reports.health_verdict(col("enabled")))


@query(f"""SELECT coalesce(CAST(sum(cost_micro) FILTER ((at_hour * 60 + {ZONE}) // 1440 = ({NOW} * 60 + {ZONE}) // 1440) AS BIGINT), 0) AS today, coalesce(CAST(sum(cost_micro) FILTER (at_hour > {NOW} - 168) AS BIGINT), 0) AS last_7d,
 coalesce(CAST(sum(cost_micro) FILTER (at_hour > {NOW} - 720) AS BIGINT), 0) AS last_30d FROM usage""", "usage")
def spend(spark, d):
    return reports.spend(derived(spark, d, "usage"), NOW, ZONE)


@query(f"SELECT CAST(sum(cost_micro) AS BIGINT) AS spent, sum(cost_micro) >= 5000000 AS exceeded FROM usage WHERE (at_hour * 60 + {ZONE}) // 1440 = ({NOW} * 60 + {ZONE}) // 1440", "usage")
def budget_guard(spark, d):
    return reports.over_budget(derived(spark, d, "usage"), NOW, ZONE, 5_000_000)


@query("""SELECT count(*) FILTER (review_status IN ('ready_to_apply', 'approved', 'auto_apply_disabled')) AS ready, count(*) FILTER (review_status = 'pending_approval') AS needs_approval, count(*) FILTER (review_status = 'applied') AS applied,
 count(*) FILTER (pipeline_status = 'analyzed') AS analyzed, count(*) FILTER (pipeline_status IN ('new', 'processing', 'awaiting_ai', 'analysis_failed')) AS awaiting, count(*) FILTER (pipeline_status = 'filtered_out' OR recommendation IN ('blocked', 'ignore')) AS filtered,
 count(*) FILTER (review_status IN ('rejected', 'dismissed')) AS rejected, count(*) FILTER (pipeline_status = 'duplicate') AS duplicates, count(*) AS "all" FROM opportunities""", "opportunities")
def view_counts(spark, d):
    return views.view_counts(opps(spark, d))


@query("SELECT source, count(*) AS n FROM opportunities GROUP BY source", "opportunities")
def postings_by_source(spark, d):
    return reports.by_source(opps(spark, d))


@query(f"""WITH t AS (SELECT run_id, count(*) AS total, count(*) FILTER (status NOT IN ('pending', 'running')) AS done, count(*) FILTER (status = 'ok') AS ok, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'blocked') AS blocked, count(*) FILTER (status = 'running') AS running FROM tasks GROUP BY run_id),
 f AS (SELECT run_id, count(*) AS discovered FROM opportunities GROUP BY run_id), p AS (SELECT last_processed_run_id AS run_id, count(*) AS processed, count(*) FILTER (pipeline_status = 'analyzed') AS analyzed, count(*) FILTER (recommendation IN {ACTIONABLE}) AS matches FROM opportunities WHERE last_processed_run_id IS NOT NULL GROUP BY 1)
 SELECT run_id, total, done, ok, failed, blocked, running, round(done / total, 3) AS fraction, coalesce(discovered, 0) AS discovered, coalesce(processed, 0) AS processed, coalesce(analyzed, 0) AS analyzed, coalesce(matches, 0) AS matches FROM t LEFT JOIN f USING (run_id) LEFT JOIN p USING (run_id)""", "tasks", "opportunities")
def run_progress(spark, d):
    return reports.progress(derived(spark, d, "tasks"), opps(spark, d))


_USAGE = "count(*) AS calls, CAST(sum(tokens_in) AS BIGINT) AS tokens_in, CAST(sum(tokens_out) AS BIGINT) AS tokens_out, CAST(sum(searches) AS BIGINT) AS searches, CAST(sum(cost_micro) AS BIGINT) AS cost_micro, count(DISTINCT opportunity_id) AS postings"


@query(f"SELECT run_id, purpose, {_USAGE} FROM usage GROUP BY run_id, purpose", "usage")
def usage_by_purpose(spark, d):
    return reports.usage_by(derived(spark, d, "usage"), "run_id", "purpose")


_PRICES = ", ".join(f"('{k}', {a}, {b})" for k, (a, b) in C.prices.items() if k != "default")


@query(f"""WITH p(prefix, price_in, price_out) AS (VALUES {_PRICES}),
 m AS (SELECT model, arg_max(price_in, length(prefix)) AS price_in, arg_max(price_out, length(prefix)) AS price_out FROM (SELECT DISTINCT model FROM usage) JOIN p ON starts_with(model, prefix) GROUP BY model)
 SELECT purpose, model, round(sum(((tokens_in + 1.25 * cache_write + 0.1 * cache_read) * coalesce(price_in, {C.prices['default'][0]}) + tokens_out * coalesce(price_out, {C.prices['default'][1]})) / 1e6 + searches * 10.0 / 1000), 2) AS cost FROM usage LEFT JOIN m USING (model) GROUP BY purpose, model""", "usage")
def usage_costs(spark, d):
    from gleanery.functions.money import usage_cost

    prices = spark.createDataFrame([(k, *v) for k, v in C.prices.items()], "prefix string, price_in double, price_out double")
    rows = joins.priced(derived(spark, d, "usage"), prices)
    cost = usage_cost(col("tokens_in"), col("cache_write"), col("cache_read"), col("tokens_out"), col("searches"), col("price_in"), col("price_out"), C.search_price_per_1000)
    return rows.groupBy("purpose", "model").agg(F.round(F.sum(cost), 2).alias("cost"))


@query("""WITH runs AS (SELECT DISTINCT run_id FROM tasks), u AS (SELECT run_id, sum(cost_micro) AS c FROM usage WHERE purpose = 'extract' GROUP BY run_id)
 SELECT run_id, CAST(coalesce(c, 0) AS BIGINT) AS cost_micro FROM runs LEFT JOIN u USING (run_id)""", "tasks", "usage")
def run_costs(spark, d):
    return reports.run_costs(derived(spark, d, "tasks").select("run_id").distinct(), derived(spark, d, "usage").where("purpose = 'extract'"))


@query("""WITH k AS (SELECT run_id, kind, string_agg(concat('"', status, '":', CAST(n AS STRING)), ',' ORDER BY status) AS s FROM (SELECT run_id, kind, status, count(*) AS n FROM tasks GROUP BY ALL) GROUP BY run_id, kind)
 SELECT run_id, concat('{', string_agg(concat('"', kind, '":"{', replace(s, '"', chr(92) || '"'), '}"'), ',' ORDER BY kind), '}') AS stats FROM k GROUP BY run_id""", "tasks")
def run_stats(spark, d):
    return reports.run_stats(derived(spark, d, "tasks"))


@query("""WITH a AS (SELECT CASE WHEN status = 'odd' THEN 'applied' ELSE status END AS status FROM applications)
 SELECT count(*) AS total, count(*) FILTER (status = 'applied') AS applied, count(*) FILTER (status = 'interviewing') AS interviewing, count(*) FILTER (status = 'offer') AS offer, count(*) FILTER (status = 'rejected') AS rejected, count(*) FILTER (status = 'withdrawn') AS withdrawn,
 CAST(floor(100.0 * count(*) FILTER (status IN ('interviewing', 'offer', 'rejected')) / count(*) + 0.5) AS BIGINT) AS response_rate FROM a""", "applications")
def response_rate(spark, d):
    return reports.response_rate(derived(spark, d, "applications"))


@query("SELECT eligibility, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 1) AS pct FROM opportunities GROUP BY eligibility", "opportunities")
def eligibility_shares(spark, d):
    from pyspark.sql import Window as W

    counts = opps(spark, d).groupBy("eligibility").agg(F.count(F.lit(1)).alias("n"))  # a handful of verdicts
    return counts.withColumn("pct", F.round(100.0 * col("n") / F.sum("n").over(W.partitionBy(F.lit(1))), 1))


@query("SELECT (SELECT count(*) FROM links WHERE status = 'lead_only') AS leads, (SELECT count(*) FROM boards WHERE enabled) AS boards", "links", "boards")
def lead_and_board_counts(spark, d):
    leads = derived(spark, d, "links").agg(F.count_if(col("status") == "lead_only").alias("leads"))
    return leads.crossJoin(F.broadcast(derived(spark, d, "boards").agg(F.count_if(col("enabled")).alias("boards"))))  # one row each


_CLAIM = f"(pipeline_status = 'new' OR (pipeline_status IN ('awaiting_ai', 'analysis_failed') AND analysis_attempts < 3)) AND last_processed_run_id IS DISTINCT FROM {RUN}"
_PRE = "CASE WHEN prescore_value > 5 THEN prescore_value END"


@query(f"SELECT id, pipeline_status, {_PRE} AS prescore FROM opportunities WHERE {_CLAIM} ORDER BY coalesce({_PRE}, 40) DESC, posted_hour DESC NULLS LAST, first_seen_hour DESC, id LIMIT 25", "opportunities")
def claimed(spark, d):
    return views.claim(opps(spark, d), RUN, 25).select("id", "pipeline_status", "prescore")


@query(f"SELECT count(*) FILTER ({_CLAIM}) AS remaining FROM opportunities", "opportunities")
def remaining(spark, d):
    return reports.remaining(opps(spark, d), RUN)


def _paged(order: str, sql_order: str):
    @query(f"SELECT id, title, match_score FROM opportunities WHERE title ILIKE '%developer%' OR company_name ILIKE '%developer%' ORDER BY {sql_order}, id LIMIT 20 OFFSET 20", "opportunities")
    def page(spark, d):
        return views.page(views.view(opps(spark, d), "all", "developer"), order, 20, 1).select("id", "title", "match_score")

    Q[f"page_by_{order}"] = Q.pop("page")


_paged("score", "match_score DESC NULLS LAST, first_seen_hour DESC")
_paged("newest", "first_seen_hour DESC")
_paged("posted", "posted_hour DESC NULLS LAST, first_seen_hour DESC")
_paged("prescore", f"{_PRE} DESC NULLS LAST, first_seen_hour DESC")


@query(f"SELECT id, match_score FROM opportunities WHERE recommendation IN {ACTIONABLE} AND review_status NOT IN ('rejected', 'dismissed', 'applied') ORDER BY match_score DESC, first_seen_hour DESC, id LIMIT 6", "opportunities")
def top_matches(spark, d):
    rows = opps(spark, d).where(col("recommendation").isin(views.ACTIONABLE) & ~col("review_status").isin("rejected", "dismissed", "applied"))
    return views.page(rows, "score", 6).select("id", "match_score")


@query(f"""WITH t AS (SELECT * FROM opportunities WHERE recommendation IN {ACTIONABLE} AND review_status NOT IN ('rejected', 'dismissed', 'applied') ORDER BY match_score DESC, id LIMIT 25)
 SELECT recommendation, string_agg(CAST(id AS STRING), ',' ORDER BY match_score DESC, id) AS ids FROM t GROUP BY recommendation""", "opportunities")
def digest_groups(spark, d):
    rows = opps(spark, d).where(col("recommendation").isin(views.ACTIONABLE) & ~col("review_status").isin("rejected", "dismissed", "applied"))
    top = rows.orderBy(F.desc("match_score"), "id").limit(25)  # a digest of 25
    items = F.sort_array(F.collect_list(F.struct((-col("match_score")).alias("s"), "id")))
    return top.groupBy("recommendation").agg(F.array_join(F.transform(items, lambda x: x["id"].cast("string")), ",").alias("ids"))


@query("SELECT id, provider, slug FROM boards WHERE enabled AND failures < 5 ORDER BY (last_fetched_hour IS NULL) DESC, relevant_jobs DESC, last_fetched_hour ASC, id LIMIT 40", "boards")
def board_plan(spark, d):
    rows = derived(spark, d, "boards").where("enabled and failures < 5")
    return rows.orderBy(F.desc(col("last_fetched_hour").isNull()), F.desc("relevant_jobs"), F.asc_nulls_last("last_fetched_hour"), "id").limit(C.max_boards_per_run).select("id", "provider", "slug")


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY priority, id) AS n, row_number() OVER (PARTITION BY run_id, kind ORDER BY priority, id) AS k FROM tasks)
 SELECT id, n <= 30 AND k <= CASE kind WHEN 'page' THEN 8 WHEN 'ats_board' THEN 5 ELSE 30 END AS admitted FROM r""", "tasks")
def capped_tasks(spark, d):
    return views.capped(derived(spark, d, "tasks"), "run_id", ["priority", "id"], 30, {"page": 8, "ats_board": 5}).select("id", "admitted")


@query(f"""SELECT * FROM (SELECT finished_hour AS at_hour, id, CASE status WHEN 'failed' THEN 'task_failed' WHEN 'done' THEN 'task_done' ELSE 'task' END AS label, source AS subject FROM tasks
 UNION ALL SELECT first_seen_hour, id, 'scored', title FROM opportunities WHERE pipeline_status = 'analyzed') ORDER BY at_hour DESC, label, id, subject LIMIT 60""", "tasks", "opportunities")
def activity_feed(spark, d):
    scored = opps(spark, d).where("pipeline_status = 'analyzed'").select(col("first_seen_hour").alias("at_hour"), "id", col("title").alias("subject"))
    return views.feed(derived(spark, d, "tasks"), scored, 60)


@query(f"""WITH p AS (SELECT id, {o.company('company_name')} AS c, {o.title('title')} AS t FROM opportunities), a AS (SELECT id, opportunity_id, {o.company('company_name')} AS c, {o.title('title')} AS t FROM applications WHERE status <> 'withdrawn' AND applied_hour > {NOW} - 24 * 365)
 SELECT p.id, min(a.id) AS application_id FROM p LEFT JOIN a ON p.c = a.c AND p.c <> '' AND (p.t = a.t OR p.id = a.opportunity_id) GROUP BY p.id""", "opportunities", "applications")
def exact_prior_applications(spark, d):
    return joins.prior_applications(derived(spark, d, "opportunities"), derived(spark, d, "applications"), NOW, C.duplicate_window_days, 100.0)


SIMILAR_PRIOR = f"""WITH RECURSIVE p AS (SELECT id, {o.company('company_name')} AS c, {o.title('title')} AS t FROM opportunities WHERE company_name IS NOT NULL), a AS (SELECT id, opportunity_id, {o.company('company_name')} AS c, {o.title('title')} AS t FROM applications WHERE status <> 'withdrawn' AND applied_hour > {NOW} - 24 * {C.duplicate_window_days}),
 {o.likes("p", "a", C.duplicate_title_similarity)}, m AS (SELECT p.id, min(a.id) AS by_title FROM p JOIN alike ON alike.t = p.t JOIN a ON a.c = p.c AND a.t = alike.u WHERE p.c <> '' GROUP BY p.id),
 n AS (SELECT p.id, min(a.id) AS same FROM p JOIN a ON a.c = p.c AND a.opportunity_id = p.id WHERE p.c <> '' GROUP BY p.id)
 SELECT v.id, least(by_title, same) AS application_id FROM opportunities v LEFT JOIN m USING (id) LEFT JOIN n USING (id)"""


@query(SIMILAR_PRIOR, "opportunities", "applications")
def similar_prior_applications(spark, d):
    """Applications to the company for a title that is alike, not equal alone."""
    return joins.prior_applications(derived(spark, d, "opportunities"), derived(spark, d, "applications"), NOW, C.duplicate_window_days, float(C.duplicate_title_similarity))


#: A scan in order of arrival: a title leads if it is like no leader of its company before it.
NEAR_DUPLICATES = f"""WITH RECURSIVE p AS (SELECT id, {o.company('company_name')} AS c, {o.title('title')} AS t, first_seen_hour * 10000000 + id AS seen FROM opportunities WHERE company_name IS NOT NULL AND first_seen_hour > {NOW} - 24 * {C.posting_window_days}),
 w AS (SELECT * FROM p WHERE c <> '' AND t <> ''), {o.likes("w", "w", C.posting_title_similarity)},
 sets AS (SELECT t, list(u) AS us FROM alike GROUP BY t), turn AS (SELECT c, t, us, seen, row_number() OVER (PARTITION BY c ORDER BY seen) AS n FROM (SELECT c, t, min(seen) AS seen FROM w GROUP BY ALL) JOIN sets USING (t)),
 walk AS (SELECT DISTINCT c, CAST(0 AS BIGINT) AS n, CAST([] AS STRUCT(t VARCHAR, seen BIGINT)[]) AS held FROM turn UNION ALL
  SELECT turn.c, turn.n, CASE WHEN len(held) < 200 AND len(list_filter(held, lambda h: list_contains(us, h.t))) = 0 THEN list_append(held, {{'t': turn.t, 'seen': turn.seen}}) ELSE held END FROM walk JOIN turn ON turn.c = walk.c AND turn.n = walk.n + 1),
 led AS (SELECT c, unnest(held) AS h FROM (SELECT c, held FROM walk QUALIFY n = max(n) OVER (PARTITION BY c))),
 best AS (SELECT w.id, arg_min(h.seen % 10000000, {{'a': -likeness, 'b': h.seen}}) AS duplicate_of FROM w JOIN alike ON alike.t = w.t JOIN led ON led.c = w.c AND h.t = alike.u WHERE h.seen < w.seen GROUP BY w.id)
 SELECT v.id, duplicate_of FROM opportunities v LEFT JOIN best USING (id)"""


@query(NEAR_DUPLICATES, "opportunities")
def near_duplicate_postings(spark, d):
    rows = derived(spark, d, "opportunities").withColumns({"company_folded": text.fold(col("company_name")), "title_folded": text.fold(col("title"))})
    rows = rows.select("id", text.company_form(col("company_folded")).alias("company_norm"), text.title_form(col("title_folded")).alias("title_norm"), "first_seen_hour")
    return dedup.near_duplicates(rows, NOW)


@query("""WITH s AS (SELECT sha256(url) AS url_hash, * FROM links) SELECT url_hash, min(seen_hour) AS seen_hour, max(seen_hour) AS last_seen_hour, count(*) AS sightings FROM s GROUP BY url_hash""", "links")
def exact_sightings(spark, d):
    rows = derived(spark, d, "links").withColumn("url_hash", F.sha2("url", 256))
    return dedup.exact(rows).select("url_hash", "seen_hour", "last_seen_hour", "sightings")


@query("""WITH i AS (SELECT id, sha256(url) AS h, via, id % 30 AS ext FROM links WHERE id % 2 = 1), s AS (SELECT id, sha256(url) AS h, via, CASE WHEN id % 4 = 0 THEN id % 30 END AS ext FROM links WHERE id % 2 = 0)
 SELECT i.id, coalesce((SELECT min(s.id) FROM s WHERE s.h = i.h), (SELECT min(s.id) FROM s WHERE s.via = i.via AND s.ext = i.ext)) AS known_id FROM i""", "links")
def known_postings(spark, d):
    rows = derived(spark, d, "links").select("id", F.sha2("url", 256).alias("url_hash"), col("via").alias("source"), (col("id") % 30).alias("external_id"))
    stored = rows.where("id % 2 = 0").withColumn("external_id", F.when(col("id") % 4 == 0, col("external_id")))
    return joins.known(rows.where("id % 2 = 1"), stored).select("id", "known_id")


@query("""WITH r AS (SELECT id, id % 3 = 0 AS ok, id % 11 = 0 AS gone FROM boards WHERE id % 2 = 0)
 SELECT b.id, CAST(CASE WHEN ok THEN 0 WHEN NOT ok THEN failures + 1 ELSE failures END AS INT) AS failures, enabled AND NOT coalesce(gone, false) AS enabled, CASE WHEN r.id IS NOT NULL THEN 494520 ELSE last_fetched_hour END AS last_fetched_hour FROM boards b LEFT JOIN r USING (id)""", "boards")
def board_health(spark, d):
    boards = derived(spark, d, "boards")
    results = boards.where("id % 2 = 0").select("id", (col("id") % 3 == 0).alias("ok"), (col("id") % 11 == 0).alias("gone"), F.lit(NOW).alias("at_hour"))
    return state.board_health(boards, results).select("id", "failures", "enabled", "last_fetched_hour")


@query("""WITH r AS (SELECT id, CASE id % 4 WHEN 0 THEN 'fetched' WHEN 1 THEN 'failed' WHEN 2 THEN 'blocked' ELSE 'skipped' END AS s FROM links WHERE id % 3 <> 0)
 SELECT l.id, CAST(attempts + CASE WHEN s IS NOT NULL THEN 1 ELSE 0 END AS INT) AS attempts, CASE WHEN s = 'failed' AND attempts + 1 < 3 THEN 'pending' WHEN s IS NOT NULL THEN s ELSE status END AS status FROM links l LEFT JOIN r USING (id)""", "links")
def url_frontier(spark, d):
    links = derived(spark, d, "links")
    results = links.where("id % 3 <> 0").select("id", F.when(col("id") % 4 == 0, "fetched").when(col("id") % 4 == 1, "failed").when(col("id") % 4 == 2, "blocked").otherwise("skipped").alias("status"))
    return state.frontier(links, results).select("id", "attempts", "status")


@query(f"SELECT id, CASE WHEN pipeline_status = 'processing' AND first_seen_hour < {NOW} - 0.5 THEN 'new' ELSE pipeline_status END AS pipeline_status FROM opportunities", "opportunities")
def stale_resets(spark, d):
    return state.reset_stale(opps(spark, d), NOW, "pipeline_status", "first_seen_hour", {"processing": (0.5, "new")}).select("id", "pipeline_status")


@query(f"SELECT review_status, count(*) AS kept FROM opportunities WHERE first_seen_hour >= {NOW} - 336 OR review_status IN ('applied', 'ready_to_apply', 'pending_approval', 'approved') GROUP BY review_status", "opportunities")
def retention(spark, d):
    return state.retained(opps(spark, d), NOW).groupBy("review_status").agg(F.count(F.lit(1)).alias("kept"))


@query("""WITH x AS (SELECT opportunity_id AS id, arg_max(CASE status WHEN 'applied' THEN 'approve' WHEN 'offer' THEN 'reopen' WHEN 'rejected' THEN 'reject' WHEN 'odd' THEN 'note' ELSE 'dismiss' END, id) AS decision FROM applications GROUP BY opportunity_id)
 SELECT o.id, CASE decision WHEN 'approve' THEN 'approved' WHEN 'reject' THEN 'rejected' WHEN 'dismiss' THEN 'dismissed' WHEN 'reopen' THEN coalesce(CASE recommendation WHEN 'auto_apply_candidate' THEN 'auto_apply_disabled' WHEN 'manual_apply' THEN 'ready_to_apply' WHEN 'approval_required' THEN 'pending_approval' END, 'none') ELSE review_status END AS review_status
 FROM opportunities o LEFT JOIN x USING (id)""", "opportunities", "applications")
def user_decisions(spark, d):
    made = {"applied": "approve", "offer": "reopen", "rejected": "reject", "odd": "note"}
    decision = F.coalesce(*[F.when(col("status") == k, F.lit(v)) for k, v in made.items()], F.lit("dismiss"))
    said = derived(spark, d, "applications").select(col("opportunity_id").alias("id"), decision.alias("decision"), F.lit(None).cast("string").alias("note"), col("id").alias("at_hour"))
    return state.decided(opps(spark, d).withColumn("note", F.lit(None).cast("string")), said).select("id", "review_status")


@query(f"SELECT run_id, status, count(*) AS n FROM (SELECT run_id, CASE WHEN run_id = {RUN} AND status IN ('pending', 'running') THEN 'skipped' ELSE status END AS status FROM tasks) GROUP BY run_id, status", "tasks")
def finished_run(spark, d):
    return state.finished(derived(spark, d, "tasks"), RUN).groupBy("run_id", "status").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH m AS (SELECT opportunity_id, max(id % 7) AS top FROM applications WHERE id % 2 = 0 GROUP BY 1)
 SELECT a.id, CAST(coalesce(top, 0) + row_number() OVER (PARTITION BY a.opportunity_id ORDER BY a.id) AS BIGINT) AS version FROM applications a LEFT JOIN m USING (opportunity_id) WHERE a.id % 2 = 1""", "applications")
def material_versions(spark, d):
    rows = derived(spark, d, "applications")
    stored = rows.where("id % 2 = 0").select("opportunity_id", (col("id") % 7).alias("version"))
    return state.next_versions(rows.where("id % 2 = 1").select("id", "opportunity_id"), stored).select("id", col("version").cast("long").alias("version"))


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY opportunity_id ORDER BY applied_hour DESC, id) AS n FROM applications)
 SELECT opportunity_id, string_agg(CAST(id AS STRING), ',' ORDER BY n) AS ids FROM r WHERE n <= 5 GROUP BY opportunity_id""", "applications")
def detail_bundles(spark, d):
    rows = derived(spark, d, "applications")
    order = F.struct((-col("applied_hour")).alias("a"), "id")
    found = joins.bundles(rows, "opportunity_id", ["id"], order, 5)
    return found.select("opportunity_id", F.array_join(F.transform("items", lambda x: x["id"].cast("string")), ",").alias("ids"))


@query("SELECT a.id, a.status, p.title FROM applications a JOIN opportunities p ON p.id = a.opportunity_id", "applications", "opportunities")
def application_list(spark, d):
    return derived(spark, d, "applications").alias("a").join(opps(spark, d).alias("p"), col("p.id") == col("a.opportunity_id")).select("a.id", "a.status", "p.title")


@query("SELECT provider, slug FROM boards WHERE id % 3 <> 0", "boards")
def conflict_free_insert(spark, d):
    boards = derived(spark, d, "boards")
    return joins.absent(boards, boards.where("id % 3 = 0"), ["provider", "slug"]).select("provider", "slug")


QUERIES = Q
