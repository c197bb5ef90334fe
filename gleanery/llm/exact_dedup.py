"""Exact dedup with a two-pass Bloom filter. DataFrame functions only.

The texts are read once, into a narrow table of ids, digests and 64-bit hashes. Pass 1 counts, for each bit
of a filter, the hashes that set it; bits set by two rows or more are kept. Rows with an unset bit are the
only ones with their text. Pass 2 does the same with another hash function over the rows that are left, so
that few of these are alone. Rows that fail either pass go straight through; the others are possibly
repeated: only they are shuffled, and grouped by their exact digest. What building a filter moves are counts
of bits, added up before the shuffle: neither ids, digests nor texts.

A filter is a table of (block, 4 KB bitmap). It is broadcast in ranges of blocks of FILTER_BYTES each, one
after the other, whatever the number of rows: with more than one range, the rows are first laid out in files
by range (each task writes its own rows), so that each pass reads its range alone. `drop_copies` builds such
a filter of the texts that are known to be repeated, and lets the whole rows that miss it through in place.

Null texts count as empty. An empty table gives an empty result. Rows that repeat a doc_id with an equal
text all count in group_size; `annotate` returns and marks each of them alike, `drop_copies` keeps one.
A null doc_id stays only if its whole group has null ids. Other columns don't matter.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.llm.common import BROADCAST_BYTES, ascii_lower, cut, fresh

BLOCK_BITS = 32768
BLOCK_BYTES = BLOCK_BITS // 8
BITS_PER_ROW = 16
#: Bytes of bitmaps that are broadcast at a time.
FILTER_BYTES = 64 << 20


def text_digest(text: Column) -> Column:
    """SHA-256 of the text in UTF-8 after lower-casing A-Z."""
    return F.sha2(ascii_lower(text), 256)


def coarse_hash(text: Column) -> Column:
    """Texts that are equal after lower-casing A-Z have equal hashes, so the filter misses no copy."""
    return F.xxhash64(F.lower(F.coalesce(text, F.lit(""))))


class BloomFilter:
    """The bits that `least` rows or more of hashes (a table with the column h) set, one bit a row."""

    def __init__(self, hashes: DataFrame, rows: int, least: int, seed: int, limit: int = FILTER_BYTES):
        self.seed = seed
        self.blocks = max(1, -(-rows * BITS_PER_ROW // BLOCK_BITS))
        self.blocks_each = max(1, limit // BLOCK_BYTES)
        self.ranges = -(-self.blocks // self.blocks_each)
        slots = hashes.groupBy(self.slot(F.col("h")).alias("slot")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
        block, bit = (F.col("slot") / BLOCK_BITS).cast("long"), F.pmod("slot", F.lit(BLOCK_BITS))
        bitmaps = slots.select(block.alias("block"), bit.alias("bit")).groupBy("block").agg(F.bitmap_construct_agg("bit").alias("bitmap"))
        self.table = cut(bitmaps, "bloom")

    def slot(self, h: Column) -> Column:
        """The bit of a hash, by number. Below 2^52, so that the division into blocks is exact."""
        return F.pmod(F.xxhash64(h, F.lit(self.seed)), F.lit(self.blocks * BLOCK_BITS))

    def test(self, df: DataFrame, h: str, possible: str, number: int | None = None) -> DataFrame:
        """df with a boolean column that is true where the bit of the row's hash is set."""
        block, bitmap = fresh(df, "_block"), fresh(df, "_bitmap")
        table = self.table if number is None else self.table.where((F.col("block") / self.blocks_each).cast("int") == number)
        table = F.broadcast(table.select(F.col("block").alias(block), F.col("bitmap").alias(bitmap)))
        slot = self.slot(F.col(h))
        joined = df.withColumn(block, (slot / BLOCK_BITS).cast("long")).join(table, block, "left")
        bit = F.pmod(slot, F.lit(BLOCK_BITS))
        byte = F.conv(F.hex(F.substring(F.col(bitmap), (bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        hit = F.col(bitmap).isNotNull() & (F.getbit(byte, (bit % 8).cast("int")) == 1)
        return joined.withColumn(possible, F.coalesce(hit, F.lit(False))).drop(block, bitmap)

    def mark(self, df: DataFrame, h: str, possible: str) -> DataFrame:
        """`test`, one range of blocks after the other, so that one range's bitmaps are held at a time."""
        if self.ranges == 1:
            return self.test(df, h, possible)
        number = fresh(df, "_range")
        laid = cut(df.withColumn(number, (self.slot(F.col(h)) / (BLOCK_BITS * self.blocks_each)).cast("int")), "ranges", by=number)
        parts = [cut(self.test(laid.where(F.col(number) == i).drop(number), h, possible, i), "marked") for i in range(self.ranges)]
        return reduce(DataFrame.unionByName, parts)


def digests(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, text_sha256, h), written once: the only pass that reads the texts."""
    return cut(docs.select("doc_id", text_digest(F.col(text)).alias("text_sha256"), coarse_hash(F.col(text)).alias("h")), "digests")


def sifted(rows: DataFrame, limit: int = FILTER_BYTES) -> tuple[DataFrame, DataFrame]:
    """The rows (with a column h) that are alone with their hash, and those that are possibly repeated."""
    first = BloomFilter(rows, rows.count(), 2, 7, limit).mark(rows, "h", "possible")
    left = cut(first.where("possible").drop("possible"), "left")
    second = BloomFilter(left, left.count(), 2, 11, limit).mark(left, "h", "possible")
    alone = first.where("not possible").unionByName(second.where("not possible"))
    return alone.drop("possible"), second.where("possible").drop("possible")


def repeated_groups(candidates: DataFrame) -> DataFrame:
    """(text_sha256, h, keep_id, group_size) of the texts with two rows or more, from (doc_id, text_sha256, h)."""
    groups = candidates.groupBy("text_sha256").agg(F.first("h").alias("h"), F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    return cut(groups.where("group_size > 1"), "groups")


def annotate(docs: DataFrame, limit: int = FILTER_BYTES) -> DataFrame:
    """One row for each row of docs: doc_id, keep_id, group_size, kept, text_sha256."""
    alone, candidates = sifted(digests(docs.select("doc_id", "text")), limit)
    alone = alone.select("doc_id", "text_sha256", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
    groups = repeated_groups(candidates).drop("h")
    # the groups are a written table: both sides of the join have a shuffle, and a hot digest is split
    found = candidates.join(groups, "text_sha256", "left").select(
        "doc_id", "text_sha256", F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size")
    )
    return alone.unionByName(found).select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def marked_repeats(docs: DataFrame, groups: DataFrame, h: str, possible: str, limit: int = FILTER_BYTES) -> DataFrame:
    """docs with the hash of the text, and whether it may be one of the repeated texts. No row moves."""
    known = BloomFilter(groups, groups.count(), 1, 13, limit)
    return known.mark(docs.withColumn(h, coarse_hash(F.col("text"))), h, possible)


def drop_copies(docs: DataFrame, limit: int = FILTER_BYTES, broadcast: int = BROADCAST_BYTES) -> DataFrame:
    """docs, all columns, without all but one row of each text. Rows whose text is alone are never shuffled.

    Possibly repeated rows stay if their text is none of the repeated ones, or if they are its keeper. They
    meet the keepers on digest and id together, so the copies of one text spread over all tasks."""
    _, candidates = sifted(digests(docs.select("doc_id", "text")), limit)
    groups = repeated_groups(candidates)
    h, possible, digest, keep_digest, keep_id = (fresh(docs, x) for x in ("_h", "_possible", "_digest", "_keep_digest", "_keep_id"))
    marked = marked_repeats(docs, groups, h, possible, limit)
    small = groups.count() * 100 <= broadcast  # rows of a digest and an id
    offer = lambda df: F.broadcast(df) if small else df.hint("merge")
    named = groups.select(F.col("text_sha256").alias(keep_digest), F.col("keep_id").alias(keep_id))
    maybe = marked.where(F.col(possible)).withColumn(digest, text_digest(F.col("text")))
    keepers = maybe.join(offer(named), (F.col(digest) == F.col(keep_digest)) & F.col("doc_id").eqNullSafe(F.col(keep_id)), "left_semi")
    others = maybe.join(offer(named.select(keep_digest)), F.col(digest) == F.col(keep_digest), "left_anti")
    once = keepers.dropDuplicates(["doc_id", digest])
    rows = [df.select(*docs.columns) for df in (marked.where(~F.col(possible)), others, once)]
    return reduce(DataFrame.unionByName, rows)
