"""Pages of boards are judged and counted in one pass."""

from pyspark.sql import functions as F

from gleanery.sources import pages


def test_entries_are_judged_once(spark):
    rows = [("a", 0, "https://x.io/job/react-developer-1", "2026-05-30"), ("a", 1, "https://x.io/job/react-developer-2", None), ("a", 2, "https://x.io/job/react-developer-3", "2026-01-01"), ("a", 3, "https://x.io/job/nurse-4", "2026-05-31"),
            ("b", 0, "https://x.io/job/react-developer-5", None), ("b", 1, "https://x.io/job/senior-react-developer-6", None), ("b", 2, "https://x.io/job/qa-engineer-7", None), ("b", 3, "https://x.io/job/nurse-8", "2026-05-31")]
    entries = spark.createDataFrame(rows, "board string, at int, loc string, modified string").withColumn("modified", F.to_timestamp("modified"))
    found = pages.board_pages(entries, F.lit("2026-06-01").cast("timestamp"), 2)
    assert [(r.board, r.url[-1], r["rank"]) for r in found.orderBy("board", "rank").collect()] == [("a", "1", 1), ("b", "7", 1), ("b", "5", 2)]
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
