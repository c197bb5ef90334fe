"""The similarity join, and leaders by it, against comparing all pairs in order."""

import random

import pytest
from pyspark.sql import functions as F

from gleanery.operators import dedup, joins, likeness

WORDS = ["senior", "frontend", "developer", "engineer", "engineers", "qa", "react", "c++", "web", "developers", "full", "stack", "a", "lead", "platform", "reliability"]


def titles(rnd, n):
    out = []
    for _ in range(n):
        t = " ".join(rnd.sample(WORDS, rnd.randint(1, 5)))
        if rnd.random() < 0.4:
            k = rnd.randrange(len(t) + 1)
            t = t[:k] + rnd.choice("xyz") + t[k + rnd.randrange(2) :]
        out.append(t)
    return [*out, "a", "b", "", "ab", "ba", "aaaaaaaaaaaaaaaaaaaab", "aaaaaaaaaaaaaaaaaaaac"]


@pytest.mark.parametrize(("seed", "least"), [(1, 90.0), (2, 80.0), (3, 95.0)])
def test_no_alike_pair_is_lost(spark, seed, least):
    rnd = random.Random(seed)
    left, right = [(rnd.choice("kl"), t) for t in titles(rnd, 250)], [(rnd.choice("kl"), t) for t in titles(rnd, 120)]
    one, two = spark.createDataFrame(left, "c string, t string"), spark.createDataFrame(right, "c string, u string")
    got = [tuple(r) for r in likeness.alike(one, two, ["c"], "t", "u", least).collect()]
    want = {(c, t, u) for c, t in left for k, u in right if c == k and dedup.similarity(t, u) >= least}
    assert set(got) == want and len(got) == len(want)
    pairs = sum(len({t for k, t in left if k == c}) * len({u for k, u in right if k == c}) for c in "kl")
    if least > 80:
        assert likeness.candidates(one, two, ["c"], "t", "u", least).count() < pairs / 3  # what is aligned


def test_unlike_titles_are_not_aligned(spark):
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(8))
    rows = spark.createDataFrame([("k", f"{word()} {word()} {word()}") for _ in range(1000)], "c string, t string")
    assert likeness.candidates(rows, rows.withColumnRenamed("t", "u"), ["c"], "t", "u", 90.0).count() < 1000 * 999 / 20


def scan(rows, least=90.0, limit=dedup.LEADERS):
    held, out = {}, {}
    for i, company, title, seen in sorted(rows, key=lambda r: (r[3], r[0])):
        mine = held.setdefault(company, [])
        best = max(((100.0 if t == title else dedup.similarity(title, t), -k, i2) for k, (i2, t) in enumerate(mine)), default=None)
        equal = next((i2 for i2, t in mine if t == title), None)
        out[i] = equal if equal is not None else best[2] if best and best[0] >= least else None
        if out[i] is None and len(mine) < limit:
            mine.append((i, title))
    return out


SHAPE = "id long, company_norm string, title_norm string, first_seen_hour long"


@pytest.mark.parametrize(("seed", "limit"), [(1, 200), (2, 7), (3, 3), (4, 1)])
def test_leaders_in_rounds(spark, monkeypatch, seed, limit):
    """Few leaders at a time, so that companies take many rounds."""
    monkeypatch.setattr(dedup, "LEADERS", limit)
    rnd = random.Random(seed)
    pool = [t for t in titles(rnd, 90) if t]
    rows = [(i, rnd.choice(["acme", "acme", "acme", "globex"]), rnd.choice(pool), 1000 + rnd.randrange(40)) for i in range(300)]
    got = {r.id: r.duplicate_of for r in dedup.near_duplicates(spark.createDataFrame(rows, SHAPE), 1100).collect()}
    assert got == scan(rows, limit=limit)


def test_a_company_with_most_titles(spark):
    """Beyond the leaders of a company its titles are originals, wherever they are; one company has nearly all rows."""
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6))
    rows = [(i, "hot" if i % 10 else "cold", f"{word()} {word()} {word()}", 2000 + i) for i in range(900)]
    rows += [(5000 + i, "hot", rows[i][2][:-1] + "x", 3000) for i in range(1, 400) if i % 10]
    got = {r.id: r.duplicate_of for r in dedup.near_duplicates(spark.createDataFrame(rows, SHAPE), 3100).collect()}
    assert got == scan(rows)


def test_prior_applications(spark):
    rnd = random.Random(6)
    pool = [t for t in titles(rnd, 150) if t]
    posted = [(i, rnd.choice(["a", "b", ""]), rnd.choice(pool)) for i in range(200)]
    applied = [(1000 + i, rnd.choice(["a", "b"]), rnd.choice(pool), rnd.randrange(300), 90) for i in range(60)]
    jobs = spark.createDataFrame(posted, "id long, company_norm string, title_norm string")
    done = spark.createDataFrame(applied, "id long, company_norm string, title_norm string, opportunity_id long, applied_hour long").withColumn("status", F.lit("sent"))
    want = {i: min((a for a, k, u, o, _ in applied if k == c and (o == i or dedup.similarity(t, u) >= 85.0)), default=None) for i, c, t in posted}
    assert {r.id: r.application_id for r in joins.prior_applications(jobs, done, 100, 30, 85.0).collect()} == want
