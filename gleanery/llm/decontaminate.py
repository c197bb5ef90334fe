"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Words are runs of letters and digits in lower case. One pass over the corpus counts the items' words and all their
3-, 5-, 8-, 13- and 21-grams. Each place of an item takes the shortest n-gram around it that is rare: it occurs at
most once in a million words of the corpus (`most_often`) and in few items (ITEMS_EACH). So a stock phrase is no
seed, but a longer n-gram at its place is. A place that has none, as its passage leaked into very much of the
corpus, takes the shortest n-gram in few items whose words are improbable together (SEED_BITS, by the product of
their shares); an item that differs from many others nowhere its longest n-grams. Each place of an item has a
seed, so an item is found by any of its parts. Equal items are one item until the end.

A second pass takes windows: an item and the words of a text around its seed, as far as the item is long; windows of
one item that overlap are one, windows of different items never. So a document that holds the whole benchmark
has a window for each item, dealt over all tasks, and none grows with the number of items. Equal windows are
aligned once, those only that have enough of the item's words. The score is the best local alignment (match 1,
mismatch and gap -1) over the item's words: 1 for a verbatim copy, less for each word edited, 0.5 for half of an
item. Pairs from MIN_SCORE are contaminated. So are pairs whose alignment has LOCAL_WORDS net matches, however
long the item is, if the words in it are improbable together (LOCAL_BITS).

The items of a block (BLOCK_WORDS words at most) go to every task: their words and n-grams are bounded by that
parameter. A larger benchmark takes two more passes for each further block. No document text is shuffled, only
counts and windows.

Null texts count as empty; items without words match nothing. Repeated rows are reported once for each
doc_id and item. Empty tables give an empty result. Columns other than the id and text don't matter.
`drop_contaminated` drops rows, not ids: a clean row stays beside a leak with its doc_id.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.llm.common import BROADCAST_BYTES, cut, row_keys, small_batches, without

NGRAMS = (3, 5, 8, 13, 21)
#: A seed occurs at most so often, or once in so many words of the corpus; and in so many different items.
LEAST_OFTEN = 32
ONCE_IN = 1 << 20
ITEMS_EACH = 16
SEED_BITS = 24.0
MIN_SCORE = 0.5
LOCAL_WORDS = 20
LOCAL_BITS = 80.0
#: Words of a block of items.
BLOCK_WORDS = 1_000_000
#: Words of texts that a task takes at a time (or one text), windows that it sends at a time.
CHUNK_WORDS = 500_000
SENT = 5_000
WORD = re.compile(r"[^\W_]+")
ODD = np.uint64(0x9E3779B97F4A7C15)
OUT = "doc_id long, key long, item_id long, score double, first_word long, last_word long"


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def most_often(total: int) -> int:
    """How often a rare n-gram occurs at most in a corpus of so many words."""
    return max(LEAST_OFTEN, total // ONCE_IN)


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int, int]:
    """Best local alignment of two arrays of word numbers: score, first and last word in the passage."""
    n = len(passage)
    steps = np.arange(1, n + 1)
    row, start = np.zeros(n + 1, np.int64), np.arange(n + 1)  # start: where the best alignment that ends here begins
    best = (0, 0, 0)
    for word in item:
        diagonal = row[:-1] + np.where(passage == word, 1, -1)
        up = row[1:] - 1
        score = np.maximum(np.maximum(diagonal, up), 0)
        origin = np.where(diagonal >= up, start[:-1], start[1:])
        origin = np.where(score == 0, steps, origin)
        # a gap in the item: the best score to the left less one for each step
        lifted = score + steps
        reach = np.maximum.accumulate(lifted)
        source = np.maximum.accumulate(np.where(lifted == reach, steps - 1, 0))
        filled = reach - steps
        origin = np.where(filled > score, origin[source], origin)
        row = np.concatenate([[0], filled])
        start = np.concatenate([[0], origin])
        at = int(filled.argmax())
        if filled[at] > best[0]:
            best = (int(filled[at]), int(origin[at]), at)
    return best


def places(known: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Where the values are in the sorted array known, -1 for those that aren't."""
    if not len(known):
        return np.full(len(values), -1)
    at = np.minimum(np.searchsorted(known, values), len(known) - 1)
    return np.where(known[at] == values, at, -1)


class Index:
    """Sorted codes of n-grams by size; looks them up."""

    def __init__(self, codes: dict[int, np.ndarray]):
        self.codes = codes

    def found(self, ids: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(size, places, n-grams) of the block's n-grams in ids. A longer one begins with a shorter one."""
        at, done = np.flatnonzero(ids), 0
        h = np.zeros(len(at), np.uint64)
        for size in sorted(self.codes):
            for k in range(done, size):
                inside = at + k < len(ids)
                at, h = at[inside], h[inside]
                word = ids[at + k]
                known = word > 0
                at = at[known]
                h = mixed(h[known], word[known])
            done = size
            number = places(self.codes[size], closed(h))
            hit = number >= 0
            yield size, at[hit], number[hit]
            if size >= NGRAMS[0]:
                at, h = at[hit], h[hit]


class Grams:
    """All n-grams of a block of items, by size; items are arrays of word numbers (from 1; 0 is no word of an item)."""

    def __init__(self, items: list[np.ndarray]):
        self.lengths = np.array([len(x) for x in items], np.int64)
        self.ids = np.concatenate(items)
        self.start = np.cumsum(self.lengths) - self.lengths
        self.owner = np.repeat(np.arange(len(items)), self.lengths)
        own = np.unique(self.lengths[self.lengths < NGRAMS[0]]).tolist()  # items that are shorter are n-grams of their own
        self.sizes = sorted({*own, *(n for n in NGRAMS if n <= self.lengths.max())})
        self.codes: dict[int, np.ndarray] = {}
        self.number: dict[int, np.ndarray] = {}  # by place, of the n-gram that begins there; -1: none
        room = self.lengths[self.owner] - (np.arange(len(self.ids)) - self.start[self.owner])
        h, done = np.zeros(len(self.ids), np.uint64), 0
        for size in self.sizes:
            for k in range(done, size):
                h[room > k] = mixed(h[room > k], self.ids[np.flatnonzero(room > k) + k])
            done = size
            whole = room >= size
            if size < NGRAMS[0]:
                whole &= self.lengths[self.owner] == size
            self.codes[size], inverse = np.unique(closed(h[whole]), return_inverse=True)
            self.number[size] = np.full(len(self.ids), -1)
            self.number[size][whole] = inverse
        self.index = Index(self.codes)

    def around(self, size: int) -> np.ndarray:
        """By place, the n-gram that begins there, or is the item's last; -1 if the item is shorter."""
        place = np.arange(len(self.ids))
        last = (self.start + self.lengths)[self.owner] - size
        begin = np.minimum(place, last)
        return np.where(begin >= self.start[self.owner], self.number[size][np.maximum(begin, 0)], -1)

    def items_each(self, size: int) -> np.ndarray:
        """How many items have each n-gram."""
        has = self.number[size] >= 0
        pairs = np.unique(np.stack([self.number[size][has], self.owner[has]]), axis=1)
        return np.bincount(pairs[0], minlength=len(self.codes[size]))


def mixed(h: np.ndarray, words: np.ndarray) -> np.ndarray:
    return (h ^ words.astype(np.uint64)) * ODD


def closed(h: np.ndarray) -> np.ndarray:
    return h ^ h >> np.uint64(29)


class Seeds:
    """The seeds of a block: by size, for each n-gram the items that take it (none for most)."""

    def __init__(self, grams: Grams, often: dict[int, np.ndarray], bits: np.ndarray, limit: int, least: float):
        """often: how often each n-gram occurs, at least where that is above the limit. bits: of each word number."""
        self.index, self.lengths, n = grams.index, grams.lengths, len(grams.ids)
        total = np.concatenate([[0.0], np.cumsum(bits[grams.ids])])
        taken, rest = np.zeros(n, np.int64), np.zeros(n, np.int64)
        for size in grams.sizes:
            number = grams.around(size)
            here = number >= 0
            few = here & (grams.items_each(size)[number] <= ITEMS_EACH)
            begin = np.minimum(np.arange(n), (grams.start + grams.lengths)[grams.owner] - size)
            improbable = few & (total[np.minimum(begin + size, n)] - total[np.maximum(begin, 0)] >= least)
            taken[(taken == 0) & few & (often[size][number] <= limit)] = size
            rest[(rest == 0) & improbable] = size
        longest = np.zeros(n, np.int64)
        for size in grams.sizes:
            longest[grams.around(size) >= 0] = size
        taken = np.where(taken > 0, taken, np.where(rest > 0, rest, longest))
        self.first: dict[int, np.ndarray] = {}
        self.items: dict[int, np.ndarray] = {}
        for size in grams.sizes:
            mine = taken == size
            number, owner = np.unique(np.stack([grams.around(size)[mine], grams.owner[mine]]), axis=1) if mine.any() else np.empty((2, 0), np.int64)
            self.first[size] = np.searchsorted(number, np.arange(len(grams.codes[size]) + 1))
            self.items[size] = owner

    def windows(self, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(text, item, first word, words one behind the other, their number) of the windows. The texts are taken as
        one array, with a word of no item between them."""
        sizes = np.array([len(x) for x in texts], np.int64)
        start = np.cumsum(sizes + 1) - sizes - 1
        gap = np.zeros(1, np.int64)
        ids = np.concatenate([y for x in texts for y in (x, gap)]) if texts else gap
        spots, ends, items = [], [], []
        for size, at, number in self.index.found(ids):
            each = self.first[size][number + 1] - self.first[size][number]
            spot = np.repeat(at, each)
            within = np.arange(len(spot)) - np.repeat(np.cumsum(each) - each, each)
            spots.append(spot)
            ends.append(spot + size)
            items.append(self.items[size][np.repeat(self.first[size][number], each) + within])
        spot, end, item = map(np.concatenate, (spots, ends, items))
        text = np.searchsorted(start, spot, "right") - 1
        lo = np.maximum(start[text], spot - self.lengths[item])
        hi = np.minimum(start[text] + sizes[text], end + self.lengths[item])
        order = np.lexsort((lo, item, text))
        lo, hi, item, text = lo[order], hi[order], item[order], text[order]
        other = np.diff(item, prepend=-1).astype(bool) | np.diff(text, prepend=-1).astype(bool)
        lift = np.cumsum(other) * (len(ids) + 1)  # so that ends of one item and text don't count for the next
        reach = np.maximum.accumulate(hi + lift)
        new = np.flatnonzero(other | (lo + lift > np.concatenate([[0], reach[:-1]])))
        lo, hi = lo[new], (reach - lift)[np.append(new[1:], len(reach)) - 1] if len(new) else hi[new]
        length = hi - lo
        inside = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
        return text[new], item[new], lo - start[text[new]], ids[np.repeat(lo, length) + inside], length


def chunks(batches: Iterator[pa.RecordBatch], number: dict[str, int]) -> Iterator[tuple[pa.RecordBatch, int, list[np.ndarray], int]]:
    """(batch, first row, word numbers of the texts from there on, words) by about CHUNK_WORDS words."""
    for batch in batches:
        texts, at = batch.column("text").to_pylist(), 0
        while at < len(texts):
            held, size, first = [], 0, at
            while at < len(texts) and size < CHUNK_WORDS:
                held.append(np.array(list(map(number.get, words_of(texts[at]), repeat(0))), np.int64))
                size += len(held[-1])
                at += 1
            yield batch, first, held, size


def counts(texts: DataFrame, index: Index, number: dict[str, int]) -> DataFrame:
    """(size, number, n): how often the block's n-grams occur; size 0 for its words, -1 for all words."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = {0: np.zeros(len(number) + 1, np.int64)} | {size: np.zeros(len(codes), np.int64) for size, codes in index.codes.items()}
        total = 0
        for _, _, held, size in chunks(batches, number):
            ids = np.concatenate([y for x in held for y in (x, np.zeros(1, np.int64))])
            total += size
            often[0] += np.bincount(ids, minlength=len(number) + 1)
            for n, _, which in index.found(ids):
                often[n] += np.bincount(which, minlength=len(often[n]))
        often[0][0] = 0
        for n, sums in (*often.items(), (-1, np.array([total]))):
            some = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), n, np.int32)), pa.array(some), pa.array(sums[some])], ["size", "number", "n"])

    sums = texts.mapInArrow(counted, "size int, number long, n long").groupBy("size", "number").agg(F.sum("n").alias("n"))
    return cut(sums, "counts")


def seeds_of(texts: DataFrame, items: list[np.ndarray], number: dict[str, int]) -> tuple[Seeds, np.ndarray]:
    """The seeds of distinct items, and the bits of each word number. To the driver come the counts of the block's
    words, and of its n-grams that are too frequent."""
    grams = Grams(items)
    sums = counts(texts, grams.index, number)
    total = sums.where("size = -1").agg(F.sum("n")).first()[0] or 0
    limit = most_often(total)
    held = sums.where((F.col("size") == 0) | (F.col("size") > 0) & (F.col("n") > limit)).toPandas()
    often = {size: np.zeros(len(codes), np.int64) for size, codes in (grams.codes | {0: np.empty(len(number) + 1)}).items()}
    for size, rows in held.groupby("size"):
        often[size][rows["number"].to_numpy()] = rows["n"].to_numpy()
    bits = np.log2((total + 1) / (often.pop(0) + 0.5))
    bits[0] = 0.0
    return Seeds(grams, often, bits, limit, min(SEED_BITS, math.log2(total + 2))), bits


def block_pairs(docs: DataFrame, items: list[tuple[int, list[str]]], min_score: float, local_words: int) -> DataFrame:
    """(doc_id, key, item_id, score, first_word, last_word) of the pairs of one block of items."""
    spark = docs.sparkSession
    number = {w: i for i, w in enumerate(dict.fromkeys(w for _, words in items for w in words), 1)}
    distinct = {words: i for i, words in enumerate(dict.fromkeys(tuple(words) for _, words in items))}
    numbered = [np.array([number[w] for w in words], np.int64) for words in distinct]
    rows = docs.select(F.col("doc_id").cast("long"), row_keys(F.col("text"))[1].alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    seeds, bits = seeds_of(rows.select("text"), numbered, number)

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, first, held, _ in chunks(batches, number):
            text, item, at, words, length = seeds.windows(held)
            edge = np.concatenate([[0], np.cumsum(length)])
            for lo in range(0, len(text), SENT):
                some = slice(lo, lo + SENT)
                rows = pa.array(text[some] + first)
                values = words[edge[lo] : edge[min(lo + SENT, len(text))]].astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array((edge[lo : lo + SENT + 1] - edge[lo]).astype(np.int32)), pa.array(values))
                columns = [batch.column("doc_id").take(rows), batch.column("key").take(rows), pa.array(item[some]), pa.array(at[some]), lists]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "key", "number", "at", "words"])

    found = rows.mapInArrow(windows, "doc_id long, key long, number long, at long, words array<int>")
    found = cut(found.withColumns({"a": F.xxhash64("words"), "b": F.xxhash64(F.lit(1), "words")}), "windows")

    def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["number", "a", "b", "score", "first", "last"]
        for batch in batches:
            out = []
            for which, a, b, words in zip(*(batch.column(c).to_pylist() for c in ("number", "a", "b", "words"))):
                item, words = numbered[which], np.array(words, np.int64)
                least = min(min_score * len(item), local_words)
                if np.isin(item, words).sum() < least:
                    continue
                score, first, last = align(item, words)
                if score < least:
                    continue
                shared = words[first : last + 1]
                local = score >= local_words and bits[shared[np.isin(shared, item)]].sum() >= LOCAL_BITS
                if local or score >= min_score * len(item):
                    out.append((which, a, b, score / len(item), first, last))
            kinds = [pa.int64()] * 3 + [pa.float64()] + [pa.int64()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out)) or [()] * 6, kinds)], names)

    # equal windows once; what is left is few bytes but much work, dealt over as many tasks as a shuffle has
    same = ["number", "a", "b"]
    once = found.select(*same, "words").dropDuplicates(same).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *same)
    scores = cut(once.mapInArrow(aligned, "number long, a long, b long, score double, first long, last long"), "aligned")
    small = scores.count() * 64 <= BROADCAST_BYTES
    hits = found.drop("words").join(F.broadcast(scores) if small else scores.hint("merge"), same)
    # the block's items: as many rows as it has items
    named = spark.createDataFrame([(distinct[tuple(words)], item_id) for item_id, words in items], "number long, item_id long")
    out = hits.join(F.broadcast(named), "number")
    return cut(out.select("doc_id", "key", "item_id", "score", (F.col("at") + F.col("first")).alias("first_word"), (F.col("at") + F.col("last")).alias("last_word")), "pairs")


def pairs(docs: DataFrame, benchmark: DataFrame, min_score: float = MIN_SCORE, block_words: int = BLOCK_WORDS, local_words: int = LOCAL_WORDS) -> DataFrame:
    """(doc_id, key, item_id, score, first_word, last_word) of the contaminated passages; doc_id and key tell rows apart."""
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    letters = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-letters // (2 * block_words)))  # a word and its separator are two characters at least
    docs = docs.select("doc_id", "text")
    out = None
    with small_batches(spark):
        for b in range(blocks):
            part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).toLocalIterator()
            held = [(r.item_id, words) for r in part if (words := words_of(r.text))]
            if held:
                found = block_pairs(docs, held, min_score, local_words)
                out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], OUT) if out is None else out


def matches(docs: DataFrame, benchmark: DataFrame, min_score: float = MIN_SCORE, block_words: int = BLOCK_WORDS, local_words: int = LOCAL_WORDS) -> DataFrame:
    """(doc_id, item_id, score, first_word, last_word): the best alignment of each contaminated pair."""
    best = F.max_by(F.struct("score", "first_word", "last_word"), F.struct(F.col("score"), -F.col("first_word"))).alias("best")
    return pairs(docs, benchmark, min_score, block_words, local_words).groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.*")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """docs, all columns, without the documents that hold a test item."""
    gone = pairs(docs, benchmark, min_score).select(F.coalesce("doc_id", F.lit(-1)).alias("doc_id"), "key").distinct()
    return without(docs, cut(gone, "contaminated"), row_keys(F.col("text")))
