"""Periodic runs against comparing all words with all periods."""

import hashlib
import os
import random
import re
import zlib
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from gleanery.llm import periodic_runs as R
from gleanery.llm import queries
from gleanery.session import table

DATA = "/root/testdata/sf0.001"


def brute(a, squares=False):
    out, n = set(), len(a)
    for q in range(1, n // R.LEAST_TURNS + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and a[j] == a[j + q]:
                j += 1
            if j - i + q >= max(R.LEAST_WORDS, R.LEAST_TURNS * q):
                smaller = any(all(a[k] == a[k + p] for k in range(i, j + q - p)) for p in range(1, q))
                out |= set() if smaller else {(i, j - i + q, q)}
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def words(rnd, most, letters="abc"):
    out = []
    while len(out) < most and rnd.random() < 0.85:
        part = [rnd.choice(letters) for _ in range(rnd.randint(1, 6))]
        out += (part * 9)[: rnd.randint(len(part), len(part) * 9)] if rnd.random() < 0.5 else part
    return out


@pytest.mark.parametrize("seed", range(10))
def test_runs_of_many_texts_at_once(seed):
    rnd = random.Random(seed)
    for _ in range(120):
        texts = [words(rnd, 80, rnd.choice(["ab", "abc", "abcdefgh"])) for _ in range(rnd.randint(0, 5))]
        assert R.judged(texts) == [brute(t) for t in texts]


@pytest.mark.parametrize("seed", range(10))
def test_primitive_squares(seed):
    """The automaton reports each square whose root is no power, once for each place where it ends."""
    rnd = random.Random(seed)
    for _ in range(100):
        a = words(rnd, 40)
        want = set()
        for i in range(len(a)):
            for p in range(1, (i + 1) // 2 + 1):
                root = a[i - p + 1 : i + 1]
                if a[i - 2 * p + 1 : i - p + 1] == root and not any(p % d == 0 and root == root[:d] * (p // d) for d in range(1, p)):
                    want.add((i, p))
        found = list(R.squares(a))
        assert len(found) == len(set(found)) and set(found) == want


def test_long_texts_take_near_linear_time():
    rnd = random.Random(1)
    half = [rnd.choice("abcdefghij") for _ in range(2500)]
    for text, want in ((["a"] * 60_000, [(0, 60_000, 1)]), (half * 8 + ["z"], [(0, 20_000, 2500)])):
        assert [r for r in R.judged([text])[0] if r[1] > 100] == want


def test_rows(spark):
    long = " ".join(["one two three"] * 5000)
    rows = [(1, "a a a a a a b", "x"), (None, None, None), (2, "", "x"), (1, "a a a a a a b", "x"), (3, long, "y"), (4, " \t\r plain text\n here ", "z"), (5, "A a A a A a A a", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_runs string")
    got = sorted(R.detect(docs).collect(), key=str)
    want = [(1, "x", "a b", [(0, 6, 1)])] * 2 + [(2, "x", "", [])] + [(3, "y", "one two three", [(0, 15_000, 3)])] + [(4, "z", "plain text here", [])] + [(5, "z", "A a", [(0, 8, 2)])] + [(None, None, "", [])]
    assert [(r.doc_id, r.n_runs, r.text, [tuple(x) for x in r.runs]) for r in got] == want
    assert R.collapse(docs).columns == docs.columns and R.detect(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        R.detect(docs.withColumn("runs", F.lit(1)))
    assert R.collapse(docs.withColumn("_runs", F.lit(1))).columns == [*docs.columns, "_runs"]


def test_sharpest_compares_exactly(spark):
    runs = [(0, 10**9 + 1, 10**8), (5, 10**9 + 1, 10**8), (7, 10**9 + 2, 10**8), (8, 2 * 10**9 + 4, 2 * 10**8)]
    df = spark.createDataFrame([(runs,), ([],), (runs[:2],)], f"runs {R.RUN_SCHEMA}")
    assert [r[0] and tuple(r[0]) for r in df.select(R.sharpest(F.col("runs"))).collect()] == [runs[2], None, runs[0]]


def expected(doc_id, text):
    a = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(a)
    if h % 10 == 0 and n:
        start = g % n
        p = 1 + (n - start) // (3 + g % 8)
        a = [a[i] if i < start else a[start + (i - start) % p] for i in range(n)]
    runs = brute(a) if n < 400 else R.judged([a])[0]
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    dropped = {i for s, length, q in runs for i in range(s + q, s + length)}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    figures = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *figures, sha("".join("%d,%d,%d\n" % r for r in runs)), sha(" ".join(w for i, w in enumerate(a) if i not in dropped)))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
def test_query(spark):
    want = [expected(r.doc_id, r.text) for r in table(spark, DATA, "documents").collect()]
    got = queries.op13_periodic_runs(spark, DATA)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(tuple, got.collect())) == sorted(want) and any(w[1] for w in want)
