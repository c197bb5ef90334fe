"""URL rules by a sort-merge range join.

A host becomes a key of its labels from the right, each with a dot behind: blog.example.com gives
`com.example.blog.`. A rule's host is then a prefix of the keys of the host and its subdomains, that is an
interval of the sorted keys. Rows and rules are dealt to the same key ranges (a rule to each range that its
interval meets), sorted, and swept once: rules open in key order and lie on a stack while their interval
lasts, so the stack holds the nested rules around the current row and nothing else. Of the rules on the
stack whose path starts the row's path the longest text wins, then the longer host, then block.

Key ranges are cut at quantiles of a bounded sample of (key, path, id), so a host with a third of all rows
spans many ranges. A row goes through one shuffle; no partition is held in memory.

A null url or one without `://` has empty host and path; only a rule with an empty host fits it. An empty
table of rows or rules gives no rows or default verdicts. Repeated rows are each judged. Other columns
don't matter.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.llm.common import ascii_lower

#: Sampled keys for each range; the driver holds ranges x SAMPLE keys at most (in expectation).
SAMPLE = 40
#: The character after the dot: ends the interval of a host key.
AFTER_DOT = chr(ord(".") + 1)


def url_host(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def url_path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def host_key(host: Column) -> Column:
    return F.when(host == "", F.lit("")).otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit(".")))


def table_of(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)


class Sweep:
    """The stack of open rules at one key."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, dict[str, tuple[str, str]], list[int]]] = []

    def close(self, key: str) -> None:
        while self.stack and not key.startswith(self.stack[-1][0]):
            self.stack.pop()

    def open(self, key: str, path: str, rule: str, action: str) -> None:
        self.close(key)
        if not self.stack or self.stack[-1][0] != key:
            self.stack.append((key, {}, []))
        _, paths, lengths = self.stack[-1]
        if path not in paths or action == "block":
            paths[path] = (rule, action)
        if len(path) not in lengths:
            lengths.append(len(path))
            lengths.sort(reverse=True)

    def judge(self, key: str, path: str) -> tuple[str, str] | None:
        self.close(key)
        best: tuple[tuple[int, int], tuple[str, str]] | None = None
        for host, paths, lengths in self.stack:
            for n in lengths:
                if n <= len(path) and (hit := paths.get(path[:n])):
                    rank = (len(hit[0]), len(host))
                    if best is None or rank > best[0]:
                        best = (rank, hit)
                    break
        return best and best[1]


def judge(urls: DataFrame, rules: DataFrame, default: str = "allow", ranges: int | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict) for urls (page_id, url) under rules (host, path, action)."""
    spark = urls.sparkSession
    n = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = urls.select(F.col("page_id").cast("long").alias("page_id"), url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    rows = rows.withColumn("key", host_key(F.col("host")))
    share = min(1.0, n * SAMPLE / max(1, urls.count()))
    keys = sorted((r.key, r.path, -1 if r.page_id is None else r.page_id) for r in rows.select("key", "path", "page_id").sample(share, seed=11).collect())
    bounds = [keys[len(keys) * i // n] for i in range(1, n)] if keys else []

    names = ["page_id", "host", "path", "key", "part", "kind", "rule", "action"]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string()]

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys, paths = (batch.column(c).to_pylist() for c in ("page_id", "key", "path"))
            parts = [bisect_right(bounds, (key, path, -1 if i is None else i)) for i, key, path in zip(ids, keys, paths)]
            none = pa.nulls(len(parts), pa.string())
            columns = [*(batch.column(c) for c in names[:4]), pa.array(parts, pa.int32()), pa.array([1] * len(parts), pa.int32()), none, none]
            yield pa.RecordBatch.from_arrays(columns, names)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for host, path, key, rule, action in zip(*(batch.column(c).to_pylist() for c in ("host", "path", "key", "rule", "action"))):
                last = bisect_right(bounds, (key[:-1] + AFTER_DOT,)) if key else n - 1
                out += [(None, host, path, key, part, 0, rule, action) for part in range(bisect_right(bounds, (key,)), last + 1)]
            yield table_of(out, names, kinds)

    schema = "page_id long, host string, path string, key string, part int, kind int, rule string, action string"
    named = rules.select(ascii_lower(F.col("host")).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "action")
    named = named.withColumn("key", host_key(F.col("host"))).withColumn("rule", F.concat("host", "path"))
    both = rows.mapInArrow(dealt, schema).unionByName(named.mapInArrow(spread, schema))

    def swept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, sweep = None, Sweep()
        for batch in batches:
            out = []
            for page_id, host, path, key, part, kind, rule, action in zip(*(batch.column(c).to_pylist() for c in names)):
                if part != current:
                    current, sweep = part, Sweep()
                if kind == 0:
                    sweep.open(key, path, rule, action)
                else:
                    out.append((page_id, host, path, *(sweep.judge(key, path) or (None, default))))
            yield table_of(out, ["page_id", "host", "path", "rule", "verdict"], [pa.int64(), *[pa.string()] * 4])

    # a partition for each range, by its number
    ordered = both.repartitionById(n, F.col("part")).sortWithinPartitions("part", "key", "kind")
    return ordered.mapInArrow(swept, "page_id long, host string, path string, rule string, verdict string")
