"""Ingest against a scan in order of arrival."""

import random

import pytest

from gleanery.operators import ingest


def scan(rows):
    """In order: seen if a stored row has the address or the (source, id)."""
    stored, out = [], {}
    for row_id, url, source, ext in sorted(rows):
        hits = [i for i, u, s, e in stored if u == url or (ext is not None and (s, e) == (source, ext))]
        if hits:
            out[row_id] = min(hits)
        else:
            stored.append((row_id, url, source, ext))
    return out


SHAPE = "id long, url_hash string, source string, external_id string"


@pytest.mark.parametrize("seed", range(4))
def test_rows_that_share_either_key(spark, seed):
    rnd = random.Random(seed)
    ids = rnd.sample(range(10**6), 400)
    rows = [(i, f"u{rnd.randrange(150)}", rnd.choice("ab"), rnd.choice([None, f"x{rnd.randrange(120)}"])) for i in ids]
    found = ingest.first_stored(spark.createDataFrame(rows, SHAPE)).collect()
    assert {r.id: r.seen_as for r in found} == scan(rows) and len(found) == len(scan(rows))


def test_a_seen_row_lends_its_keys_to_none(spark):
    rows = [(1, "A", "s", None), (2, "A", "s", "x9"), (3, "B", "s", "x9")]
    assert [tuple(r) for r in ingest.first_stored(spark.createDataFrame(rows, SHAPE)).collect()] == [(2, 1)]


def test_a_chain_of_turns(spark):
    """Each row shares its address with the one before or its id with the one after."""
    rows = [(i, f"u{(i + 1) // 2}", "s", f"x{i // 2}") for i in range(12)]
    found = {r.id: r.seen_as for r in ingest.first_stored(spark.createDataFrame(rows, SHAPE)).collect()}
    assert found == scan(rows) and len(found) == 6


def test_empty(spark):
    assert ingest.first_stored(spark.createDataFrame([], SHAPE)).count() == 0


def stored_rows(spark):
    shape = "id long, url_hash string, source string, external_id string, company_norm string, title_norm string, fingerprint string, duplicate_of long, first_seen_hour long, last_seen_hour long, last_run_id long"
    return spark.createDataFrame([], shape)


def test_outcomes_and_additions(spark):
    rows = [
        (1, "s", "", "https://a.example/1", "Chef", "Acme", 100), (2, "s", "9", "https://a.example/1", "Chef", "Acme", 101), (3, "s", "9", "https://a.example/2", "Baker", "Acme", 102), (4, "s", "", "https://a.example/3", "chef", "ACME Inc.", 103),
        (5, "s", "", "ftp://x", "Chef", "Acme", 104), (6, "s", "", "https://a.example/6", " ", "Acme", 105), (7, "s", "9", "https://a.example/9", "Chef", "Other", 106), (8, "t", "9", "https://a.example/10", None, "Other", 106),
    ]
    blank = "cast(null as string)"
    more = {c: blank for c in ("company_website", "location_text", "remote_type", "employment_type", "salary_currency", "salary_period", "salary_text", "description", "description_quality", "apply_url", "apply_email")}
    more |= {c: "cast(null as double)" for c in ("salary_min", "salary_max")} | {c: "cast(null as timestamp)" for c in ("posted_at", "expires_at")} | {c: "cast(array() as array<string>)" for c in ("tags", "location_restrictions")}
    incoming = spark.createDataFrame(rows, "id long, source string, source_external_id string, source_url string, title string, company_name string, seen_hour long").selectExpr("*", *[f"{e} as {c}" for c, e in more.items()])
    found = ingest.outcomes(incoming, stored_rows(spark), 7, 110)
    got = {r.id: (r.outcome, r.duplicate_of, r.sighting_of) for r in found.collect()}
    assert got == {1: ("new", None, 1), 2: ("seen", None, 1), 3: ("new", None, 3), 4: ("duplicate", 1, 1), 5: ("invalid", None, None), 6: ("invalid", None, None), 7: ("seen", None, 3), 8: ("invalid", None, None)}
    added = ingest.additions(incoming, found, 7)
    assert added.columns == ingest.ROW and sorted((r.id, r.pipeline_status, r.company_norm) for r in added.collect()) == [(1, "new", "acme"), (3, "new", "acme"), (4, "duplicate", "acme")]
