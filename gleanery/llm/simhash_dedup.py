"""SimHash near-dedup by a self-join of binary tries.

Each text becomes a 64-bit fingerprint of its 4-word shingles. Distinct fingerprints are dealt into
buckets that agree on one of (budget + 1) groups of bits: two fingerprints within the budget agree on one
such group at least, so no pair is lost. A bucket that is too large for a task is dealt again in the same
way on the bits that are left, as often as needed. Within a task the sorted fingerprints of a bucket are a
binary trie: node pairs are traversed together from the top, the bits in which they differ are added up,
and a pair is given up once the error budget is exceeded, or once both nodes lie in one component already.
What a task emits is one edge for each fingerprint at most; the edges of all tasks make the components.

Null texts count as empty. Texts without words have fingerprint zero and link like any other. Repeated
rows are reported each. A null doc_id is never a representative unless its group has no other. Rows that
share a doc_id are told apart by their texts: `drop_near_copies` keeps one text of a component, and the rows
that repeat it with its doc_id. Other columns don't matter. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.llm.common import connected_components, cut, row_keys, small_batches, without

SHINGLE = 4
SEED = 42
BUDGET = 4
#: Fingerprints of one bucket that a task takes.
BUCKET_ROWS = 50_000


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """Signed 64-bit SimHash; bit i is 1 if set in over half of the shingles' XXH64."""
    words = (text or "").encode().lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    size = min(size, len(words))
    ends, at = [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    starts = [0, *(e + 1 for e in ends[:-1])]
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    counts, n, step = np.zeros(64, np.int64), len(words) - size + 1, 1 << 15
    for lo in range(0, n, step):
        hi = min(n, lo + step)
        hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[lo:hi], ends[lo + size - 1 : hi + size - 1])], np.uint64)
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(counts * 2 > n, bitorder="little")
    return int(bits.view(np.int64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, key, fp), written once; doc_id and key tell rows apart."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), pa.array(fps, pa.int64())], ["doc_id", "key", "fp"])

    docs = docs.select(F.col("doc_id").cast("long"), row_keys(F.col("text"))[1].alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    with small_batches(docs.sparkSession):
        return cut(docs.mapInArrow(hashed, "doc_id long, key long, fp long"), "fingerprints")


def split_bits(bits: list[int], parts: int) -> list[int]:
    """Masks (signed) that share out the given bits in runs."""
    runs = [list(x) for x in np.array_split(np.array(bits, np.int64), parts)]
    return [int(np.uint64(sum(1 << int(b) for b in run)).view(np.int64)) for run in runs if run]


def bucketed(fps: DataFrame, budget: int, most: int) -> DataFrame:
    """(mask, val, fp): each fp once for each bucket that it is in."""
    parts = budget + 1
    deal = lambda df, masks: df.select(F.explode(F.array(*[F.lit(m) for m in masks])).alias("mask"), "fp")
    level = deal(fps, split_bits(list(range(64)), parts)).withColumn("val", F.col("fp").bitwiseAND(F.col("mask")))
    done = None
    while True:
        hot = cut(level.groupBy("mask", "val").count().where(F.col("count") > most).select("mask", "val"), "hot")
        if hot.isEmpty():
            return level if done is None else done.unionByName(level)
        cold = level.join(hot, ["mask", "val"], "left_anti")
        done = cold if done is None else done.unionByName(cold)
        finer = None
        for (mask,) in hot.select("mask").distinct().collect():  # masks come from the rule above: few
            left = [b for b in range(64) if not (mask >> b) & 1]
            rows = deal(level.where(F.col("mask") == mask).join(hot, ["mask", "val"], "left_semi").select("fp", F.col("mask").alias("old")).select("fp"), [mask | m for m in split_bits(left, parts)])
            finer = rows if finer is None else finer.unionByName(rows)
        level = cut(finer.withColumn("val", F.col("fp").bitwiseAND(F.col("mask"))), "level")


def trie_links(group: np.ndarray, fps: np.ndarray, budget: int, chunk: int = 1 << 18) -> tuple[np.ndarray, np.ndarray]:
    """Spanning edges (positions) of the pairs of one group within `budget` bits.

    group: bucket numbers, fps: uint64, sorted by both, distinct within a bucket. A node is a range
    [lo, hi) of rows that share a bucket and their first bits."""
    n = len(fps)
    parent = np.arange(n)
    same = np.zeros(n + 1, np.int64)  # same[i]: changes of component before row i

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def relabel() -> None:
        nonlocal parent
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up
        same[1:n] = np.cumsum(parent[1:] != parent[:-1])

    def merged(i: np.ndarray, j: np.ndarray) -> None:
        open_ = parent[i] != parent[j]
        if open_.any():
            for a, b in zip(i[open_].tolist(), j[open_].tolist()):
                a, b = find(a), find(b)
                if a != b:
                    parent[max(a, b)] = min(a, b)
            relabel()

    if n == 0:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    relabel()
    edge = np.flatnonzero(np.diff(group, prepend=group[0] - 1))
    lo, hi = edge, np.append(edge[1:], n)
    wide = hi - lo > 1
    stack = [(0, lo[wide], hi[wide], lo[wide], hi[wide], np.zeros(wide.sum(), np.int64))]
    ones: dict[int, np.ndarray] = {}
    while stack:
        depth, alo, ahi, blo, bhi, err = stack.pop()
        if len(alo) > chunk:
            half = len(alo) // 2
            stack.append((depth, alo[half:], ahi[half:], blo[half:], bhi[half:], err[half:]))
            stack.append((depth, alo[:half], ahi[:half], blo[:half], bhi[:half], err[:half]))
            continue
        joined = (same[ahi - 1] == same[alo]) & (same[bhi - 1] == same[blo]) & (parent[alo] == parent[blo])
        if joined.any():
            alo, ahi, blo, bhi, err = (x[~joined] for x in (alo, ahi, blo, bhi, err))
        # small pairs of nodes: compare their rows
        leaf = (ahi - alo) * (bhi - blo) <= 8
        if leaf.any():
            la, lb, wa, wb = alo[leaf], blo[leaf], (ahi - alo)[leaf], (bhi - blo)[leaf]
            count = wa * wb
            at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            wide_b = np.repeat(wb, count)
            i, j = np.repeat(la, count) + at // wide_b, np.repeat(lb, count) + at % wide_b
            near = (i != j) & (np.bitwise_count(fps[i] ^ fps[j]) <= budget)
            merged(i[near], j[near])
            alo, ahi, blo, bhi, err = (x[~leaf] for x in (alo, ahi, blo, bhi, err))
        if not len(alo):
            continue
        if depth not in ones:
            bit = (fps >> np.uint64(63 - depth)) & np.uint64(1)
            ones[depth] = np.concatenate([[0], np.cumsum(bit.astype(np.int64))])
        c = ones[depth]
        amid, bmid = ahi - (c[ahi] - c[alo]), bhi - (c[bhi] - c[blo])  # zeros come first
        own = alo == blo
        kids = [
            (alo, amid, blo, bmid, err, None),
            (amid, ahi, bmid, bhi, err, None),
            (alo, amid, bmid, bhi, err + 1, None),
            (amid, ahi, blo, bmid, err + 1, ~own),  # of a node with itself: the same pair as above
        ]
        out = []
        for a0, a1, b0, b1, e, keep in kids:
            ok = (a1 > a0) & (b1 > b0) & (e <= budget) & ~((a0 == b0) & (a1 - a0 < 2))
            ok = ok if keep is None else ok & keep
            out.append(tuple(x[ok] for x in (a0, a1, b0, b1, e)))
        cross, inner = ([np.concatenate(x) for x in zip(*part)] for part in (out[2:], out[:2]))
        for part in (cross, inner):  # the inner pairs come off the stack first: they join rows early
            if len(part[0]):
                stack.append((depth + 1, *part))
    rows = np.flatnonzero(parent != np.arange(n))
    return rows, parent[rows]


def near_edges(buckets: DataFrame, budget: int, batch_rows: int = 200_000) -> DataFrame:
    """(a, b): edges that connect whatever is within the budget in each bucket."""

    def edges(rows: pd.DataFrame) -> pd.DataFrame:
        group = rows.groupby(["mask", "val"], sort=False).ngroup().to_numpy()
        fps = rows["fp"].to_numpy().view(np.uint64)
        order = np.lexsort((fps, group))
        group, fps = group[order], fps[order]
        i, j = trie_links(group, fps, budget)
        return pd.DataFrame({"a": fps[i].view(np.int64), "b": fps[j].view(np.int64)})

    def joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for batch in batches:
            held.append(batch)
            if sum(map(len, held)) >= batch_rows:
                rows = pd.concat(held, ignore_index=True)
                last = (rows["mask"] == rows["mask"].iloc[-1]) & (rows["val"] == rows["val"].iloc[-1])
                if not last.all():
                    yield edges(rows[~last])
                held = [rows[last]]
        if held:
            yield edges(pd.concat(held, ignore_index=True))

    spark = buckets.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return buckets.repartition(n, "mask", "val").sortWithinPartitions("mask", "val").mapInPandas(joined, "a long, b long")


def placed(docs: DataFrame, budget: int = BUDGET, most: int = BUCKET_ROWS) -> DataFrame:
    """(doc_id, key, fp, root, component_id) for each row of docs: root is a fingerprint of its component."""
    rows = fingerprints(docs)
    fps = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("rep")), "fps")
    roots = connected_components(near_edges(bucketed(fps.select("fp"), budget, most), budget), "a", "b")
    rooted = cut(fps.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp")), "placed")
    least = cut(rooted.groupBy("root").agg(F.min("rep").alias("component_id")), "least")
    ids = cut(rooted.join(least, "root").select("fp", "root", "component_id"), "components")
    return rows.join(ids, "fp").select("doc_id", "key", "fp", "root", "component_id")


def components(docs: DataFrame, budget: int = BUDGET, most: int = BUCKET_ROWS) -> DataFrame:
    """(doc_id, fp, component_id) for each row of docs."""
    return placed(docs, budget, most).select("doc_id", "fp", "component_id")


def drop_near_copies(docs: DataFrame, budget: int = BUDGET) -> DataFrame:
    """docs, all columns, with one text of each component: of its smallest doc_id."""
    found = cut(placed(docs.select("doc_id", "text"), budget), "rows")
    stays = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("root").agg(F.min("key").alias("stays"))
    gone = found.join(cut(stays, "stays"), "root").where(~(F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("key") == F.col("stays"))))
    gone = gone.select(F.coalesce("doc_id", F.lit(-1)).alias("doc_id"), "key").distinct()
    return without(docs, cut(gone, "dropped"), row_keys(F.col("text")))
