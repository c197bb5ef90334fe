"""Collocation mining against counting everything."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from gleanery.llm import collocations as C


def brute(rows, threshold, top):
    count, total = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            words = [w for w in re.split(r"[\x20\x09]+", piece) if w]
            total[lang] += len(words)
            for k in range(1, 5):
                for i in range(len(words) - k + 1):
                    count[lang, tuple(words[i : i + k])] += 1
    out = []
    for lang in total:
        found = {p: a for (g, p), a in count.items() if g == lang and a >= threshold and len(p) > 1}
        kept = []
        for p, a in found.items():
            inner = lambda q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
            if any(len(q) > len(p) and inner(q) and 100 * f >= 80 * a for q, f in found.items()):
                continue
            cuts = [(2_000_000 * a // (count[lang, p[:k]] + count[lang, p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            kept.append((-score, -a, " ".join(p).encode(), count[lang, p[:k]], count[lang, p[k:]]))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(kept)[:top], 1):  # noqa: E741
            out.append((lang, rank, phrase.decode(), -a, l, r, total[lang], -score))
    return sorted(out)


def texts(seed, n=150):
    rnd = random.Random(seed)
    words = ["new", "York", "city", "the", "of", "bank", "é", "Über", "日本", "a b", "x" * 40, "\U0001f600"]
    rows = []
    for _ in range(n):
        parts = [rnd.choice(words[: rnd.choice([3, 6, 12])]) + rnd.choice(["", "", "", ",", ". ", "\n", "\r", "\t", "!?"]) for _ in range(rnd.randint(0, 40))]
        rows.append((" ".join(parts), rnd.choice(["en", "en", "de", None, ""])))
    return [*rows, (None, "en"), ("", None), (" ".join(["new york city"] * 3000), "en"), rows[0], rows[0]]


@pytest.mark.parametrize(("threshold", "top", "options"), [(3, 50, {}), (5, 7, {"held": 0}), (4, 1000, {"chunk_bytes": 300, "slot_counters": 10}), (2, 20, {"chunk_bytes": 1, "held": 40})])
def test_agrees_with_counting_everything(spark, threshold, top, options):
    rows = texts(threshold)
    docs = spark.createDataFrame([(i, t, g, "x") for i, (t, g) in enumerate(rows)], "doc_id long, text string, lang string, n string")
    got = C.collocations(docs, top=top, threshold=threshold, **options).collect()
    assert sorted(map(tuple, got)) == brute(rows, threshold, top)
    assert [f.dataType.typeName() for f in C.collocations(docs.limit(0)).schema] == ["string", "long", "string"] + ["long"] * 5


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert C.collocations(docs).count() == 0
    assert C.collocations(spark.createDataFrame([(1, None, None)], "doc_id long, text string, lang string")).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_every_frequent_key_survives_the_summary(seed):
    rnd = np.random.default_rng(seed)
    keys = rnd.zipf(1.3, 60_000) % 20_000
    parts = [np.unique(p, return_counts=True) for p in np.split(keys, 60)]
    threshold = 30
    summary = C.Summary(len(keys) // threshold + 1)
    for key, n in parts:
        summary.keys.append(key.astype(np.int64))
        summary.counts.append(n.astype(np.int64))
        summary.merge()
        assert len(summary.keys[0]) <= summary.capacity
    assert summary.taken < threshold
    values, n = np.unique(keys, return_counts=True)
    survived = set(summary.survivors(threshold).tolist())
    assert set(values[n >= threshold].tolist()) <= survived < set(values.tolist())


def test_scores_are_exact_beyond_64_bits(spark):
    big = 10**17 + 1
    rows = [("en", 1, "a", 3 * big), ("en", 1, "b", 3 * big + 7), ("en", 2, "a b", 3 * big - 5)]
    (row,) = C.scored(spark.createDataFrame(rows, "lang string, size int, phrase string, n long")).collect()
    assert row.score == 2_000_000 * (3 * big - 5) // (6 * big + 7) and (row.l, row.r) == (3 * big, 3 * big + 7)
    rows = [("en", 2, "a b", 10**18 + 1), ("en", 3, "a b c", 8 * 10**17), ("en", 2, "b c", 10**18)]
    gone = C.outgrown(spark.createDataFrame(rows, "lang string, size int, phrase string, n long")).collect()
    assert [r.phrase for r in gone] == ["b c"]


def test_a_shuffled_join_gives_the_same_scores(spark):
    rows = [("en", 1, w, 50 + i) for i, w in enumerate("abc")] + [("en", 2, "a b", 40), ("en", 2, "b c", 41), ("en", 3, "a b c", 33)]
    phrases = spark.createDataFrame(rows, "lang string, size int, phrase string, n long")
    assert sorted(map(str, C.scored(phrases, 0).collect())) == sorted(map(str, C.scored(phrases).collect()))


def test_with_more_survivors_than_are_held_not_all_phrases_travel(spark):
    """Words alone are frequent, twice as many as the filter is made for: next to no longer phrase is sent."""
    rnd = random.Random(9)
    docs = spark.createDataFrame([(" ".join(f"w{rnd.randrange(2000)}" for _ in range(400)), "en") for _ in range(500)], "text string, lang string").repartition(4).cache()
    store, jvm = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._jvm
    stages = lambda: store.stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    before = {stages().apply(i).stageId() for i in range(stages().size())} if docs.count() else None
    found = C.frequent_phrases(docs, held=1000)
    now = [stages().apply(i) for i in range(stages().size())]
    sent = sum(s.shuffleWriteBytes() for s in now if s.stageId() not in before)
    assert found.where("size = 1").count() == 2000 and found.where("size > 1").isEmpty()
    assert 0 < sent < 10 * 200_000  # bytes for each word; all phrases of up to four words are 60 and more


@pytest.mark.parametrize("held", [0, 100, 5000])
def test_the_filter_loses_none(spark, held):
    rnd = np.random.default_rng(held)
    codes = rnd.integers(0, 2**64, 3000, np.uint64)
    for slots in (1, 7, 64, 1344):
        rows = spark.createDataFrame([(int(k),) for k in C.reduced(codes, slots)], "h long").repartition(3)
        known = C.survivors(rows, held, slots)
        assert known.has(codes).all()
        assert held < 3000 or known.has(rnd.integers(0, 2**64, 20_000, np.uint64)).mean() < 0.03


def test_numbers_come_back_from_their_packs():
    values = np.array([0, 1, 255, 256, 2**40, 2**62, 3], np.int64)
    assert (C.unpacked(C.packed(values), len(values)) == values).all()
    keys = np.sort(C.reduced(np.random.default_rng(1).integers(0, 2**64, 150_000, np.uint64), 100))
    slot = C.slot_of(keys, 100)
    assert slot[0] == 0 and slot[-1] == 99 and (np.diff(slot) >= 0).all() and np.bincount(slot).max() < 2000
    assert sum(len(C.packed(np.diff(keys[slot == s], prepend=keys[slot == s][0]))) for s in range(100)) < 4 * len(keys)
