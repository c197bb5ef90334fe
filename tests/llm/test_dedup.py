import hashlib
import random

import numpy as np
import pytest

from gleanery.llm import exact_dedup, simhash_dedup
from gleanery.llm.common import connected_components

SCHEMA = "doc_id long, text string, kept string, _h int"


def lower(text):
    return (text or "").encode().lower().decode()


TEXTS = ["A b", "a B", None, "", "É x", "é x", "long " * 5000, "LONG " * 5000, "solo", "A b"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "x", 1) for i, t in enumerate(TEXTS)] + [(9, "A b", "x", 1), (None, "null id", "x", 1)]
    return spark.createDataFrame(rows, SCHEMA), rows


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_exact_annotate(docs, limit):
    df, rows = docs
    groups = {}
    for i, t, *_ in rows:
        groups.setdefault(lower(t), []).append(i)
    got = sorted(map(tuple, exact_dedup.annotate(df, limit).collect()), key=str)
    want = []
    for i, t, *_ in rows:
        ids = groups[lower(t)]
        keep = max((x for x in ids if x is not None), default=None)
        want.append((i, keep, len(ids), i == keep, hashlib.sha256(lower(t).encode()).hexdigest()))
    assert got == sorted(want, key=str)


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_exact_drop(docs, limit):
    df, rows = docs
    got = exact_dedup.drop_copies(df, limit)
    assert got.columns == df.columns
    assert sorted(str(r.doc_id) for r in got.collect()) == sorted(map(str, [9, 3, 4, 5, 7, 8, None]))


def test_rows_that_are_alone_stay_in_place_at_any_size(spark, monkeypatch):
    """20,000 texts stand twice, 1,000 once; a filter of all rows takes five ranges, one of the repeated texts two."""
    rows = [(i, f"text {i % 20_000 if i < 40_000 else i}", "x", 1) for i in range(41_000)]
    limit = 5 * exact_dedup.BLOCK_BYTES
    plans = []
    write = exact_dedup.cut
    monkeypatch.setattr(exact_dedup, "cut", lambda d, *a, **k: plans.append((a[0], d._jdf.queryExecution().executedPlan().toString())) or write(d, *a, **k))
    source = write(spark.createDataFrame(rows, SCHEMA).repartition(3))
    got = exact_dedup.drop_copies(source, limit)
    assert sorted(r.doc_id for r in got.collect()) == list(range(20_000, 41_000))
    assert sum(name == "marked" for name, _ in plans) == 5 + 4 + 2
    for name, plan in plans:
        moved = [x for x in plan.splitlines() if "Exchange" in x and "BroadcastExchange" not in x]
        if name in ("digests", "ranges", "marked", "left"):  # all rows pass here
            assert not moved, plan
    kept = sorted((r.doc_id, r.keep_id, r.group_size) for r in exact_dedup.annotate(source, limit).collect())
    assert kept == [(i, i + 20_000 if i < 20_000 else i, 1 if i >= 40_000 else 2) for i in range(41_000)]


def test_exact_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert exact_dedup.annotate(df).count() == 0 and exact_dedup.drop_copies(df).count() == 0


def test_connected_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(110)] + [(300, i) for i in range(301, 360)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: find(x) for x in linked}


def brute_components(fps, budget=4):
    n = len(fps)
    label = list(range(n))
    changed = True
    pairs = [(i, j) for i in range(n) for j in range(i) if bin(fps[i] ^ fps[j]).count("1") <= budget]
    while changed:
        changed = False
        for i, j in pairs:
            m = min(label[i], label[j])
            if (label[i], label[j]) != (m, m):
                label[i] = label[j] = m
                changed = True
    return label


def planted(n, seed):
    rng = random.Random(seed)
    base = [rng.getrandbits(64) for _ in range(n // 8)]
    out = set(base)
    while len(out) < n:
        x = rng.choice(base)
        for _ in range(rng.randrange(1, 8)):
            x ^= 1 << rng.randrange(64)
        out.add(x)
    return sorted(out)


@pytest.mark.parametrize("chunk", [1 << 18, 16])
def test_trie_links_match_all_pairs(chunk):
    fps = planted(400, 1)
    i, j = simhash_dedup.trie_links(np.zeros(400, np.int64), np.array(fps, np.uint64), 4, chunk)
    label = np.arange(400)
    for a, b in zip(i, j):
        label[a] = min(label[a], b)
    want = brute_components(fps)
    assert [want[x] for x in label] == want and len(set(label.tolist())) == len(set(want))
    assert all(want[a] == want[b] for a, b in zip(i.tolist(), j.tolist()))


def test_dense_group_stays_linear():
    fps = np.unique(np.random.default_rng(0).integers(0, 1 << 14, 9000).astype(np.uint64))
    i, _ = simhash_dedup.trie_links(np.zeros(len(fps), np.int64), fps, 4)
    assert len(i) == len(fps) - 1


def py_fingerprint(text):
    import xxhash

    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", lower(text)) if w]
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs)) if hs else 0


@pytest.mark.parametrize("most", [50_000, 3])
def test_components_match_brute_force(spark, most):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(40):
        body = [rng.choice(words) for _ in range(150)]
        rows.append(" ".join(body))
        for _ in range(rng.randrange(3)):
            copy = list(body)
            copy[rng.randrange(150)] = "Edit"
            rows.append(" ".join(copy))
    rows += [None, "", "  ", "one", "ONE two", rows[0].upper(), rows[0]]
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(rows)], "doc_id long, text string, fp int")
    fps = [py_fingerprint(t) for t in rows]
    got = sorted(map(tuple, simhash_dedup.components(df, most=most).collect()))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    assert got == [(i, signed[i], c) for i, c in enumerate(brute_components(fps))]
    kept = sorted(r.doc_id for r in simhash_dedup.drop_near_copies(df).collect())
    assert kept == sorted(set(brute_components(fps)))


def test_components_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert simhash_dedup.components(df).count() == 0
