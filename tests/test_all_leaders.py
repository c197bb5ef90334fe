"""All leaders of a company, not its first ones alone."""

import random

import pytest
from test_ingest import stored_rows
from test_likeness import SHAPE, scan, titles

from gleanery.operators import dedup, ingest


@pytest.mark.parametrize(("seed", "block"), [(1, 200), (2, 4), (3, 1)])
def test_leaders_without_a_cap(spark, monkeypatch, seed, block):
    monkeypatch.setattr(dedup, "LEADERS", block)
    rnd = random.Random(seed)
    pool = [t for t in titles(rnd, 90) if t]
    rows = [(i, rnd.choice(["acme", "acme", "acme", "globex"]), rnd.choice(pool), 1000 + rnd.randrange(40)) for i in range(300)]
    got = {r.id: r.duplicate_of for r in dedup.near_duplicates(spark.createDataFrame(rows, SHAPE), 1100, whole=True).collect()}
    assert got == scan(rows, limit=10**9)


def test_ingest_compares_with_all_postings_of_a_company(spark):
    rnd = random.Random(7)
    names = ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(14)) for _ in range(450)]
    rows = [(i, "s", "", f"https://a.example/{i}", t, "Acme", 100 + i) for i, t in enumerate(names)] + [(1000 + i, "s", "", f"https://a.example/{1000 + i}", names[i][:-1] + "9", "Acme", 900) for i in (3, 199, 200, 449)]
    blank = "cast(null as string)"
    more = {c: blank for c in ("company_website", "location_text", "remote_type", "employment_type", "salary_currency", "salary_period", "salary_text", "description", "description_quality", "apply_url", "apply_email")}
    more |= {c: "cast(null as double)" for c in ("salary_min", "salary_max")} | {c: "cast(null as timestamp)" for c in ("posted_at", "expires_at")} | {c: "cast(array() as array<string>)" for c in ("tags", "location_restrictions")}
    incoming = spark.createDataFrame(rows, "id long, source string, source_external_id string, source_url string, title string, company_name string, seen_hour long").selectExpr("*", *[f"{e} as {c}" for c, e in more.items()])
    found = ingest.outcomes(incoming, stored_rows(spark), 7, 1000)
    assert {r.id: r.duplicate_of for r in found.where("duplicate_of is not null").collect()} == {1003: 3, 1199: 199, 1200: 200, 1449: 449}
