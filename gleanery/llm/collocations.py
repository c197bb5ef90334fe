"""Phrase collocation mining with mergeable Misra-Gries summaries.

Texts are lower-cased (A-Z), cut into pieces at punctuation and line ends, and pieces into words; phrases are runs of
1 to 4 words within a piece, counted for each language. Three passes over the texts:

1. words and pairs are mined: each task counts them exactly within CHUNK_BYTES bytes, adds up what its chunks have until
   TALLY hashes wait, and sends hashes and counts, as one row for each hash partition (`slot`). Each partition has a
   Misra-Gries summary with a capacity over its mass divided by
   the threshold: what it takes off the counters in all is below the threshold, so every frequent phrase keeps a
   counter. Counters that can't reach the threshold with what was taken off are dropped at the end.
   A task sends the mass of a partition before its counts, so the capacity is known when the counts come.
2. phrases of 3 and 4 words are mined likewise, those only whose pairs survived the first pass.
3. the survivors are counted exactly, by their words, and those below the threshold go.

What is sent is small: hashes have 32 bits within their partition and travel sorted, as differences, about three bytes each;
words travel as compressed lists. Phrases are combined within a task before they are sent, so one that a third of all texts share is one
entry for each task. As many partitions are made as keep a summary within SLOT_COUNTERS on average, so memory is bounded at
any size of the corpus. Every task knows the survivors by a Bloom filter, which loses none: BITS bits for each of them up to HELD
survivors (30 MB); more of them share these bits, so that more phrases pass that need not, in no case all at once. A clash of hashes, or
in the filter, makes a phrase survive that need not; the third pass counts words, not hashes.

A phrase's score is 2,000,000 a / (l + r) rounded down, for the cut into two parts (l and r times) where it is
lowest. Phrases that lie within a longer one with 80 % or more of their count are dropped. Products and
quotients are exact (decimals and integers of 64 bits).

Null and empty texts have no words; a null language is `und`. Repeated rows count each. An empty table gives an
empty result. Columns other than the text and the language don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gleanery.llm.common import BROADCAST_BYTES, cut, small_batches

LONGEST = 4
THRESHOLD = 30
#: Bytes of texts that a task counts at a time, counters of a summary on average, and entries that a task adds up before it sends them.
CHUNK_BYTES = 12_000_000
SLOT_COUNTERS = 250_000
TALLY = 3_000_000
#: Bits of the filter for each survivor, places that each of them sets, and survivors that it is made for at most.
BITS = 12
PROBES = 4
HELD = 20_000_000
#: Percentage of a phrase's count from which a longer one that holds it replaces it; rows for each language.
WITHIN = 80
TOP = 2000

#: What separates words, and what ends a piece.
SPACES, BREAKS = b" \t", b".,;:!?\n\x0b\x0c\r"
#: By byte: 0 for words, 1 for spaces, 2 for breaks; and the byte with A-Z lower-cased.
KINDS = np.array([1 if b in SPACES else 2 if b in BREAKS else 0 for b in range(256)], np.uint8)
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
ODD = np.uint64(0x9E3779B97F4A7C15)


def mixed(codes: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Hashes of phrases and of the word after each, as hashes of the longer phrases."""
    codes = (codes ^ words) * ODD
    return codes ^ codes >> np.uint64(32)


def reduced(codes: np.ndarray, slots: int) -> np.ndarray:
    """Hashes of 32 bits within their partition: their order is that of the partitions."""
    return (codes >> np.uint64(32 - slots.bit_length())).view(np.int64)


def slot_of(keys: np.ndarray, slots: int) -> np.ndarray:
    """The partitions of reduced hashes."""
    return (keys >> slots.bit_length()) * slots >> 32


def packed(values: np.ndarray) -> bytes:
    """Whole numbers, compressed: the first byte of all, then the second of all, and so on; the upper ones are nearly all zero."""
    return pa.compress(np.ascontiguousarray(values.astype("<i8").view(np.uint8).reshape(-1, 8).T), codec="zstd", asbytes=True)


def unpacked(data: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, 8 * n, codec="zstd"), np.uint8)
    return np.ascontiguousarray(planes.reshape(8, n).T).view("<i8").ravel()


def edges_of(ordered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values of an array in order, and the edges between them."""
    start = np.flatnonzero(np.diff(ordered, prepend=-1))
    return ordered[start], np.append(start, len(ordered))


def added_up(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The different keys in order, with the sums of their counts."""
    key, count = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(key)
    key, edges = edges_of(key[order])
    return key, np.add.reduceat(count[order], edges[:-1]) if len(key) else count


class Survivors:
    """Which hashes survived: a Bloom filter with a part of equal size for each partition."""

    def __init__(self, part: int, slots: int):
        self.part, self.slots = part, slots
        self.bits = np.zeros(part * slots // 8, np.uint8)

    def places(self, keys: np.ndarray, probe: int) -> np.ndarray:
        """The bit, counted within its part, that reduced hashes set at a probe."""
        mix = keys.view(np.uint64) * (ODD + np.uint64(2 * (probe // 2)))
        mix = (mix ^ mix >> np.uint64(29)) * ODD
        half = mix >> np.uint64(32) if probe % 2 else mix & np.uint64(0xFFFFFFFF)
        return (half * np.uint64(self.part) >> np.uint64(32)).view(np.int64)

    def part_of(self, keys: np.ndarray) -> np.ndarray:
        """The part that has these reduced hashes of one partition."""
        flags = np.zeros(self.part, bool)
        for probe in range(PROBES):
            flags[self.places(keys, probe)] = True
        return np.packbits(flags, bitorder="little")

    def has(self, codes: np.ndarray) -> np.ndarray:
        keys = reduced(codes, self.slots)
        base = slot_of(keys, self.slots) * self.part
        out = np.ones(len(keys), bool)
        left = np.arange(len(keys))
        for probe in range(PROBES):
            place = base[left] + self.places(keys[left], probe)
            hit = self.bits[place >> 3] >> (place & 7).astype(np.uint8) & 1 > 0
            out[left[~hit]] = False
            left = left[hit]
        return out


class Chunk:
    """Texts of one language, counted together. They are taken as bytes: what separates words is ASCII, so no
    character is cut. Words are numbered from 1."""

    def __init__(self, lang: str):
        self.lang, self.data = lang, []

    def add(self, texts: pa.StringArray) -> int:
        """Texts that end with a line end each; their bytes."""
        edges = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
        self.data.append(np.frombuffer(texts.buffers()[2], np.uint8)[edges[0] : edges[-1]])
        return int(edges[-1] - edges[0])

    def close(self) -> None:
        data = LOWER[np.concatenate(self.data)]
        kind = KINDS[data]
        inside = kind == 0
        edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
        start, end = edge[::2], edge[1::2]
        offsets = np.concatenate([[0], np.cumsum(end - start)])
        words = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(offsets), pa.py_buffer(data[inside]))
        coded = words.dictionary_encode()
        self.words = coded.dictionary.cast(pa.string())
        names = ["", *self.words.to_pylist()]
        breaks = np.cumsum(kind == 2)
        self.ids = np.zeros(len(start) + int(breaks[-1]) + 1, np.int64)  # a zero for each break
        self.ids[np.arange(len(start)) + breaks[start]] = coded.indices.to_numpy() + 1
        self.hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in names), np.uint64, len(names))
        self.data = []

    def texts(self, place: np.ndarray, size: int) -> pa.StringArray:
        """The phrases of this size at these places."""
        words = [self.words.take(pa.array(self.ids[place + i] - 1)) for i in range(size)]
        return pc.binary_join_element_wise(*words, " ") if size > 1 else words[0]

    def phrases(self, sizes: range, frequent: Survivors | None, pruned: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(size, a place, count, hash) of the distinct phrases of these sizes. Up to the size `pruned` frequent has
        all phrases that matter: others are left out, and so are longer ones that hold them."""
        ids, width = self.ids, len(self.hashes)
        seed = np.full(1, xxhash.xxh64_intdigest(self.lang, 1), np.uint64)
        at = np.flatnonzero(ids)
        rank, codes = np.zeros(len(at), np.int64), seed
        for size in range(1, sizes.stop):
            key = rank * width + ids[at + size - 1]
            order = np.argsort(key)
            ordered = key[order]
            start = np.flatnonzero(np.diff(ordered, prepend=-1))
            values, count = ordered[start], np.diff(start, append=len(ordered))
            codes = mixed(codes[values // width], self.hashes[values % width])
            place = at[order[start]]
            rank = np.empty(len(at), np.int64)
            rank[order] = np.repeat(np.arange(len(start)), count)
            good = np.zeros(len(ids), bool)  # places where such a phrase begins
            if frequent is None or size > pruned:
                good[at] = True
                keep = slice(None)
            else:
                keep = frequent.has(codes)
                good[at] = keep[rank]
            if size in sizes:
                yield size, place[keep], count[keep], codes[keep]
            longer = good[at] & (at + size < len(ids))
            longer[longer] = ids[at[longer] + size] > 0
            longer[longer] = good[at[longer] + 1]
            at, rank = at[longer], rank[longer]


def chunks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[Chunk]:
    """The batches' texts by language, of about `most` bytes together."""
    held: dict[str, Chunk] = {}
    size = 0
    for batch in batches:
        langs = batch.column("lang")
        for lang in langs.unique().to_pylist():
            mine = batch.column("text").filter(pc.equal(langs, lang))
            size += (held.get(lang) or held.setdefault(lang, Chunk(lang))).add(mine)
        if size >= most:
            yield from held.values()
            held, size = {}, 0
    yield from held.values()


class Summary:
    """A Misra-Gries summary: each counter is at most `taken` below the count, and so is what has none."""

    def __init__(self, capacity: int):
        self.capacity, self.taken, self.waiting = capacity, 0, 0
        self.keys, self.counts = [np.empty(0, np.int64)], [np.empty(0, np.int64)]

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.keys.append(keys)
        self.counts.append(counts)
        self.waiting += len(keys)
        if self.waiting > max(self.capacity, 65_536):
            self.merge()

    def merge(self) -> None:
        keys, counts = added_up(self.keys, self.counts)
        if len(keys) > self.capacity:
            spare = len(keys) - self.capacity - 1
            least = int(np.partition(counts, spare)[spare])  # the largest that has no place: each place pays as much
            self.taken += least
            keys, counts = keys[counts > least], counts[counts > least] - least
        self.keys, self.counts, self.waiting = [keys], [counts], 0

    def survivors(self, threshold: int) -> np.ndarray:
        self.merge()
        return self.keys[0][self.counts[0] + self.taken >= threshold]


def mine(texts: DataFrame, sizes: range, frequent: Survivors | None, pruned: int, threshold: int, slots: int, chunk_bytes: int) -> DataFrame:
    """(h): reduced hashes of the phrases of these sizes that may be frequent, all that are among them."""
    # a row has a task's counts for one partition. place: twice the partition's number for their mass, one more for themselves
    schema, names = "place int, mass long, size int, h binary, n binary", ["place", "mass", "size", "h", "n"]

    def sent(keys: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        some, edges = edges_of(slot_of(keys, slots))
        spans = list(zip(edges[:-1].tolist(), edges[1:].tolist()))
        none, zero = pa.nulls(len(some), pa.binary()), pa.array(np.zeros(len(some), np.int32))
        yield pa.RecordBatch.from_arrays([pa.array((some * 2).astype(np.int32)), pa.array(np.add.reduceat(counts, edges[:-1])), zero, none, none], names)
        h, n = (pa.array([packed(x) for x in parts], pa.binary()) for parts in ([np.diff(keys[i:j], prepend=0) for i, j in spans], [counts[i:j] for i, j in spans]))
        yield pa.RecordBatch.from_arrays([pa.array((some * 2 + 1).astype(np.int32)), pa.array(np.zeros(len(some), np.int64)), pa.array(np.diff(edges).astype(np.int32)), h, n], names)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, waiting = [], [], 0
        for chunk in chunks(batches, chunk_bytes):
            chunk.close()
            for _, _, count, codes in chunk.phrases(sizes, frequent, pruned):
                keys.append(reduced(codes, slots))
                counts.append(count)
                waiting += len(codes)
            if waiting > TALLY:
                key, count = added_up(keys, counts)
                keys, counts, waiting = [key], [count], len(key)
                if waiting > TALLY // 2:
                    yield from sent(key, count)
                    keys, counts, waiting = [], [], 0
        if waiting:
            yield from sent(*added_up(keys, counts))

    def summarised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, total, summary = None, 0, None
        for batch in batches:
            for place, mass, size, h, n in zip(*(batch.column(c).to_pylist() for c in names)):
                if place // 2 != current:
                    if summary:
                        yield pa.RecordBatch.from_arrays([pa.array(summary.survivors(threshold))], ["h"])
                    current, total, summary = place // 2, 0, None
                if place % 2 == 0:
                    total += mass
                else:
                    summary = summary or Summary(total // threshold + 1)
                    summary.add(np.cumsum(unpacked(h, size)), unpacked(n, size))
        if summary:
            yield pa.RecordBatch.from_arrays([pa.array(summary.survivors(threshold))], ["h"])

    with small_batches(texts.sparkSession, 200):
        rows = texts.mapInArrow(partial, schema)
        rows = rows.repartition(slots, F.shiftright("place", 1)).sortWithinPartitions("place")
        return cut(rows.mapInArrow(summarised, "h long"), "frequent")


def survivors(found: DataFrame, most: int, slots: int) -> Survivors:
    """The filter of the hashes found, made for `most` of them at most. Tasks fill its parts, the driver puts them together."""
    out = Survivors(max(8, -(-BITS * min(found.count(), most) // slots) + 7 & ~7), slots)
    empty = Survivors(out.part, slots)

    def filled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, np.ndarray] = {}
        for batch in batches:
            keys = np.sort(batch.column("h").to_numpy())
            some, edges = edges_of(slot_of(keys, slots))
            for slot, i, j in zip(some.tolist(), edges[:-1].tolist(), edges[1:].tolist()):
                part = empty.part_of(keys[i:j])
                parts[slot] = parts[slot] | part if slot in parts else part
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array(list(parts), pa.int32()), pa.array([p.tobytes() for p in parts.values()], pa.binary())], ["slot", "part"])

    own = out.bits.reshape(slots, -1)
    for batch in found.mapInArrow(filled, "slot int, part binary").toArrow().to_batches():
        for slot, part in zip(batch.column("slot").to_pylist(), batch.column("part")):
            own[slot] |= np.frombuffer(part.as_buffer(), np.uint8)
    return out


def counted(texts: DataFrame, frequent: Survivors, threshold: int, slots: int, chunk_bytes: int) -> DataFrame:
    """(lang, size, phrase, n) of the phrases with at least `threshold` occurrences; size 0 for all words of a language."""
    # a row has a task's phrases of a language for one partition, by lines (no word has a line end), and their counts
    schema, names = "slot int, lang string, size int, bytes long, phrases binary, n binary", ["slot", "lang", "size", "bytes", "phrases", "n"]
    kinds = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("n", pa.int64())])

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[pa.Table]] = {}

        def sums(lang: str) -> pa.Table:
            return pa.concat_tables(held[lang]).group_by("phrase").aggregate([("h", "min"), ("n", "sum")]).rename_columns(["phrase", "h", "n"])

        def sent(lang: str, rows: pa.Table) -> pa.RecordBatch:
            slot = slot_of(rows["h"].to_numpy(), slots)
            order = np.argsort(slot, kind="stable")
            some, edges = edges_of(slot[order])
            spans = list(zip(edges[:-1].tolist(), edges[1:].tolist()))
            phrases = rows["phrase"].combine_chunks().take(pa.array(order))
            lines = pc.binary_join(pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), phrases), "\n")
            count = rows["n"].to_numpy()[order]
            packs = pa.array([pa.compress(x.as_buffer(), codec="zstd", asbytes=True) for x in lines], pa.binary())
            columns = [pa.array(some.astype(np.int32)), pa.array([lang] * len(some), pa.string()), pa.array(np.diff(edges).astype(np.int32)), pc.binary_length(lines).cast(pa.int64()), packs]
            return pa.RecordBatch.from_arrays([*columns, pa.array([packed(count[i:j]) for i, j in spans], pa.binary())], names)

        def entries(phrases: pa.Array, codes: np.ndarray, count: np.ndarray) -> pa.Table:
            return pa.table({"phrase": phrases, "h": reduced(codes, slots), "n": count.astype(np.int64)})

        waiting = 0
        for chunk in chunks(batches, chunk_bytes):
            chunk.close()
            mine = held.setdefault(chunk.lang, [])
            mine.append(entries(pa.array([""]), np.array([xxhash.xxh64_intdigest(chunk.lang)], np.uint64), np.array([np.count_nonzero(chunk.ids)])))
            for size, place, count, codes in chunk.phrases(range(1, LONGEST + 1), frequent, LONGEST):
                mine.append(entries(chunk.texts(place, size), codes, count))
                waiting += len(codes)
            if waiting > TALLY:
                held = {lang: [sums(lang)] for lang in held}
                waiting = sum(len(rows) for (rows,) in held.values())
                if waiting > TALLY // 2:
                    for lang, (rows,) in held.items():
                        yield sent(lang, rows)
                    held, waiting = {}, 0
        for lang in held:
            yield sent(lang, sums(lang))

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sums by lang and phrase within a partition."""
        current, waiting, size, most = None, [], 0, 1_000_000

        def sums() -> pa.Table:
            return pa.concat_tables(waiting).group_by(["lang", "phrase"]).aggregate([("n", "sum")]).rename_columns(kinds.names)

        def told() -> Iterator[pa.RecordBatch]:
            if waiting:
                out = sums()
                words = pc.if_else(pc.equal(out["phrase"], ""), 0, pc.add(pc.count_substring(out["phrase"], " "), 1)).cast(pa.int32())
                out = pa.table({"lang": out["lang"], "size": words, "phrase": out["phrase"], "n": out["n"]})
                yield from out.filter(pc.or_(pc.greater_equal(out["n"], threshold), pc.equal(out["size"], 0))).to_batches()

        for batch in batches:
            for slot, lang, many, raw, lines, n in zip(*(batch.column(c).to_pylist() for c in names)):
                if slot != current:
                    yield from told()
                    current, waiting, size, most = slot, [], 0, 1_000_000
                phrases = pc.split_pattern(pa.array([pa.decompress(lines, raw, codec="zstd").to_pybytes()], pa.binary()).cast(pa.string()), "\n").values
                waiting.append(pa.table([pa.array([lang], pa.string()).take(pa.array(np.zeros(many, np.int64))), phrases, unpacked(n, many)], schema=kinds))
                size += many
                if size > most:
                    waiting = [sums()]
                    size = len(waiting[0])
                    most = max(most, 2 * size)
        yield from told()

    with small_batches(texts.sparkSession, 200):
        out = texts.mapInArrow(exact, schema).repartition(slots, "slot").sortWithinPartitions("slot")
        return cut(out.mapInArrow(added, "lang string, size int, phrase string, n long"), "phrases")


def frequent_phrases(docs: DataFrame, text: str = "text", lang: str = "lang", threshold: int = THRESHOLD, held: int = HELD, chunk_bytes: int = CHUNK_BYTES, slot_counters: int = SLOT_COUNTERS) -> DataFrame:
    """(lang, size, phrase, n): the exact counts of all phrases of up to LONGEST words with at least `threshold`
    occurrences, and the words of each language (size 0)."""
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"), F.concat(F.coalesce(F.col(text), F.lit("")), F.lit("\n")).alias("text"))
    letters = docs.agg(F.sum(F.length(text))).first()[0] or 0
    # a word and its space have two letters at least, and one phrase of each size begins with it
    slots = max(int(spark.conf.get("spark.sql.shuffle.partitions")), letters // (threshold * slot_counters))
    short = mine(texts, range(1, 3), None, 0, threshold, slots, chunk_bytes)
    long = mine(texts, range(3, LONGEST + 1), survivors(short, held, slots), 2, threshold, slots, chunk_bytes)
    return counted(texts, survivors(short.union(long), held, slots), threshold, slots, chunk_bytes)


def scored(phrases: DataFrame, limit: int = BROADCAST_BYTES // 16) -> DataFrame:
    """(lang, phrase, size, a, l, r, score) of the phrases of two words or more, at the cut with the lowest score."""
    words = F.split("phrase", " ")
    part = lambda start, n: F.array_join(F.slice("words", start, n), " ")
    cuts = phrases.where("size > 1").select("lang", "phrase", "size", F.col("n").alias("a"), words.alias("words"), F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "size", "a", "k", part(F.lit(1), F.col("k")).alias("left"), part(F.col("k") + 1, F.col("size") - F.col("k")).alias("right"))
    parts = phrases.where(F.col("size").between(1, LONGEST - 1))
    bytes_ = parts.agg(F.sum(F.octet_length("phrase") + F.octet_length("lang") + 64)).first()[0] or 0
    offer = lambda df: F.broadcast(df) if bytes_ <= limit else df.hint("merge")
    for side, n in (("left", "l"), ("right", "r")):
        cuts = cuts.join(offer(parts.select("lang", F.col("phrase").alias(side), F.col("n").alias(n))), ["lang", side])
    # at most a million: a is in both l and r
    score = F.expr("cast(2000000 * cast(a as decimal(20, 0)) as decimal(28, 0)) div (l + r)")
    cuts = cuts.withColumn("score", score)
    best = F.min_by(F.struct("l", "r", "score"), F.struct("score", "k")).alias("best")
    return cuts.groupBy("lang", "phrase", "size", "a").agg(best).select("lang", "phrase", "size", "a", "best.*")


def outgrown(phrases: DataFrame, share: int = WITHIN) -> DataFrame:
    """(lang, phrase) of the phrases that lie within a longer one with `share` percent or more of their count."""
    longer = phrases.where("size > 2").select("lang", "n", "size", F.split("phrase", " ").alias("words"))
    starts = F.flatten(F.transform(F.sequence(F.lit(2), F.col("size") - 1), lambda k: F.transform(F.sequence(F.lit(1), F.col("size") - k + 1), lambda i: F.array_join(F.slice("words", i, k), " "))))
    most = longer.select("lang", "n", F.explode(starts).alias("phrase")).groupBy("lang", "phrase").agg(F.max("n").alias("most"))
    return most.join(phrases.where("size > 1"), ["lang", "phrase"]).where(F.col("most").cast("decimal(20,0)") * 100 >= F.col("n").cast("decimal(20,0)") * share).select("lang", "phrase")


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", top: int = TOP, **options: int) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's `top` phrases by score, count and phrase."""
    phrases = frequent_phrases(docs, text, lang, **options)
    kept = scored(phrases).join(outgrown(phrases), ["lang", "phrase"], "left_anti")
    order = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)  # limited within each task first
    totals = phrases.where("size = 0").select("lang", F.col("n").alias("n"))
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
