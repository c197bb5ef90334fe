import pandas as pd

from gleanery.operators import dedup
from gleanery.streaming import jobs
from gleanery.streaming.drain import drain


def stream(spark, folder, frames, schema):
    for i, frame in enumerate(frames):
        frame = [tuple(x.to_pydatetime() if isinstance(x, pd.Timestamp) else x for x in row) for row in frame]
        spark.createDataFrame(frame, schema).coalesce(1).write.parquet(f"{folder}/{i}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")


def test_first_seen(spark, tmp_path):
    t = pd.Timestamp("2026-01-01")
    rows = stream(spark, tmp_path, [[("a", t), ("b", t), ("a", t)], [("a", t), ("c", t)]], "k string, at timestamp")
    assert sorted(r.k for r in drain(jobs.first_seen(rows, "k", "at", "1 day")).collect()) == ["a", "b", "c"]


def test_near_duplicates_across_batches(spark, tmp_path):
    day = lambda n: pd.Timestamp("2026-01-01") + pd.Timedelta(days=n)
    frames = [[(1, "acme", "frontend developer", day(0)), (2, "acme", "qa engineer", day(0))], [(3, "acme", "developer frontend", day(1)), (4, "globex", "frontend developer", day(1))], [(5, "acme", "frontend developer", day(100)), (6, "", "x", day(1))]]
    rows = stream(spark, tmp_path, frames, "id long, company_norm string, title_norm string, first_seen timestamp")
    got = {r.id: r.duplicate_of for r in drain(jobs.near_duplicates(rows)).collect()}
    assert got == {1: None, 2: None, 3: 1, 4: None, 5: None}


def test_stale_claims(spark, tmp_path):
    at = lambda m: pd.Timestamp("2026-01-01") + pd.Timedelta(minutes=m)
    frames = [[(1, "claim", at(0)), (2, "claim", at(0))], [(2, "done", at(10))], [(3, "claim", at(100))], [(4, "claim", at(101))]]
    rows = stream(spark, tmp_path, frames, "claim_id long, action string, at timestamp")
    got = {r.claim_id: r.outcome for r in drain(jobs.stale_claims(rows)).collect()}
    assert got[1] == "expired" and got[2] == "done" and 3 not in got


def test_stale_claims_have_no_python_state_and_end_by_the_stream_own_time(spark, tmp_path):
    at = lambda m, ms=0: pd.Timestamp("2026-01-01") + pd.Timedelta(minutes=m, milliseconds=ms)
    # 5 is claimed again after its end, 6 ends a day late, 7 is due at the watermark and not behind it, 8 a millisecond before
    frames = [[(5, "claim", at(0)), (5, "done", at(5)), (5, "claim", at(20)), (6, "claim", at(0)), (6, "done", at(90))], [(7, "claim", at(70)), (8, "claim", at(69, 59_999))], [(9, "done", at(100))]]
    rows = stream(spark, tmp_path, frames[:1], "claim_id long, action string, at timestamp")
    plan = jobs.stale_claims(rows)._jdf.queryExecution().analyzed().toString()
    assert "PandasWithState" not in plan and "TransformWithState" not in plan
    assert sorted(tuple(r) for r in drain(jobs.stale_claims(rows)).collect()) == [(5, "done"), (5, "expired"), (6, "done"), (6, "expired")]
    rows = stream(spark, tmp_path / "more", frames[1:], "claim_id long, action string, at timestamp")
    assert sorted(tuple(r) for r in drain(jobs.stale_claims(rows)).collect()) == [(8, "expired"), (9, "done")]


def test_stream_agrees_with_batch(spark, tmp_path):
    import random

    rng = random.Random(2)
    words = ["react", "developer", "engineer", "engineers", "qa", "senior"]
    rows = [(i, rng.choice("ab"), " ".join(rng.sample(words, 2)), 500_000 + i) for i in range(80)]
    batch = dedup.near_duplicates(spark.createDataFrame(rows, "id long, company_norm string, title_norm string, first_seen_hour long"), 500_100)
    timed = [(i, c, t, pd.Timestamp(h * 3600, unit="s")) for i, c, t, h in rows]
    got = drain(jobs.near_duplicates(stream(spark, tmp_path, [timed], "id long, company_norm string, title_norm string, first_seen timestamp")))
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in batch.collect()}
