"""Decontamination where copies are many: a dump of the benchmark, stock phrases, equal items, large corpora."""

import random

import numpy as np
import pytest

from gleanery.llm import decontaminate as D


def expected(items, bits, total):
    """Seeds as a corpus of `total` words gives them, each n-gram as often as its words' shares say."""
    grams = D.Grams(items)
    edge = np.concatenate([[0.0], np.cumsum(bits[grams.ids])])
    often = {}
    for size in grams.sizes:
        at = np.flatnonzero(grams.number[size] >= 0)
        often[size] = np.zeros(len(grams.codes[size]))
        often[size][grams.number[size][at]] = total * 2.0 ** (edge[at] - edge[at + size])
    return D.Seeds(grams, often, bits, D.most_often(total), D.SEED_BITS)


@pytest.mark.parametrize("total", [10**5, 17 * 10**6, 10**9, 10**13])
@pytest.mark.parametrize(("low", "high"), [(3.8, 4.5), (5.5, 6.5), (9, 12)])
def test_recall_of_edited_copies_in_any_corpus(total, low, high):
    rnd = random.Random(2)
    bits = np.array([0.0, *(rnd.uniform(low, high) for _ in range(400))])
    items = [np.array(rnd.sample(range(1, 401), 24)) for _ in range(200)]
    seeds, found = expected(items, bits, total), 0
    for i, item in enumerate(items):
        copy = item.copy()
        copy[rnd.sample(range(24), 4)] = 0
        _, which, _, words, size = seeds.windows([np.concatenate([np.zeros(50, np.int64), copy, np.zeros(50, np.int64)])])
        edge = np.concatenate([[0], np.cumsum(size)])
        found += any(k == i and D.align(item, words[edge[j] : edge[j + 1]])[0] >= 12 for j, k in enumerate(which.tolist()))
    assert found >= 0.95 * len(items)


def test_windows_of_a_dump_grow_with_its_length_alone():
    rnd = random.Random(3)
    for n in (500, 4000):
        items = [np.array(rnd.choices(range(1, 5000), k=24)) for _ in range(n)]
        grams = D.Grams(items)
        seeds = D.Seeds(grams, {s: np.zeros(len(c)) for s, c in grams.codes.items()}, np.full(5001, 10.0), 32, 24.0)
        text, which, _, words, size = seeds.windows([np.concatenate(items)])
        assert len(which) == n == len(set(which.tolist())) and size.max() <= 72 and len(words) <= 72 * n


def test_a_stock_phrase_of_many_items_meets_none():
    rnd = random.Random(4)
    stock = list(range(1, 10))
    items = [np.array(stock + rnd.choices(range(10, 5000), k=15)) for _ in range(2000)]
    grams = D.Grams(items)
    seeds = D.Seeds(grams, {s: np.zeros(len(c)) for s, c in grams.codes.items()}, np.full(5001, 10.0), 32, 24.0)
    assert len(seeds.windows([np.array([0, *stock, 0])])[0]) == 0
    for i in range(0, 2000, 100):
        which = seeds.windows([items[i]])[1]
        assert i in which and len(which) <= 3
        assert i in seeds.windows([items[i][:13]])[1]  # the phrase and little more


def test_a_phrase_that_the_corpus_is_full_of_is_no_seed():
    items = [np.arange(1, 25), np.arange(30, 50)]
    grams = D.Grams(items)
    often = {s: np.zeros(len(c)) for s, c in grams.codes.items()}
    for size in (3, 5, 8):
        often[size][grams.number[size][:2]] = 10**6
    seeds = D.Seeds(grams, often, np.full(60, 10.0), 32, 24.0)
    assert len(seeds.windows([np.array([0, *range(1, 9), 0, 0])])[0]) > 0  # its other places are seeds
    assert len(seeds.windows([np.array([0, *range(1, 5), 0, 0])])[0]) == 0  # the phrase alone
    for size in grams.sizes:  # all of the item leaked into very much: it is found still
        often[size][:] = 10**6
    seeds = D.Seeds(grams, often, np.full(60, 10.0), 32, 24.0)
    assert len(seeds.windows([np.arange(1, 10)])[0]) == 1


def test_dump_and_equal_items(spark):
    rnd = random.Random(5)
    words = [f"w{i}" for i in range(3000)]
    texts = [" ".join(rnd.choices(words, k=24)) for _ in range(3000)]
    items = [*enumerate(texts), (5000, texts[7]), (5001, None), (5002, ""), (5003, "solitary"), (5004, "two words")]
    docs = [(1, "\n".join(texts), "x"), (2, "nothing here " * 50_000, "x"), (None, f"see {texts[7]} there", "x"), (3, None, None), (4, "a solitary line", ""), (5, "no two", ""), (6, "or two words", "")]
    df = spark.createDataFrame(docs, "doc_id long, text string, words string").repartition(4)
    got = {(r.doc_id, r.item_id): r.score for r in D.matches(df, spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = {(1, i): 1.0 for i in range(3000)} | {(1, 5000): 1.0, (None, 7): 1.0, (None, 5000): 1.0, (4, 5003): 1.0, (6, 5004): 1.0}
    assert {k: v for k, v in got.items() if v == 1.0} == want and all(v >= 0.5 for v in got.values())
    kept = {r.doc_id for r in D.drop_contaminated(df, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert kept == {d[0] for d in docs} - {k[0] for k in got} == {2, 3, 5}
