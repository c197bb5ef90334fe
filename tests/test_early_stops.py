"""The first two stages stop a posting whatever the later rules say."""

from oracle import DATA

from gleanery.plans import posting_queries, postings
from gleanery.plans.derived import NOW_HOUR


def test_early_stops_run_no_later_rule(spark):
    rows = postings.first_stopped(postings.formed(posting_queries.opportunities(spark, DATA)), NOW_HOUR).select("id", "stop.*")
    assert "Join" not in rows._jdf.queryExecution().optimizedPlan().toString()
    chain = posting_queries.staged(spark, DATA).where("stop.stop_stage in ('stale', 'relevance')").select("id", "stop.*")
    assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, chain.collect())) != []
