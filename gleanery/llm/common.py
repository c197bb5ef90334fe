"""Helpers that several corpus operators share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.session import scratch

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: Sides of a join up to this many bytes are broadcast; larger ones are shuffled.
BROADCAST_BYTES = 16 << 20


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z only; null counts as empty. Pure ASCII takes the faster built-in."""
    c = F.coalesce(c, F.lit(""))
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(F.translate(c, UPPER, UPPER.lower()))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def cut(df: DataFrame, name: str = "step", by: str | None = None) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: later work neither repeats what
    made it nor depends on the executors that made it. One folder for each application holds them all.
    With `by` each value of that column has files of its own, so that a filter on it reads no others."""
    spark = df.sparkSession
    path = f"{scratch(spark)}/{name}-{uuid.uuid4().hex}"
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def row_keys(*columns: Column) -> list[Column]:
    """Two numbers that stand for a row's doc_id and the given columns: rows that differ in these differ in the
    keys (but for a chance of 2^-64 among rows of one doc_id). Nulls have keys of their own."""
    flags = [c.isNull() for c in (F.col("doc_id"), *columns)]
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)), F.xxhash64(*flags, *columns)]


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """Caps the rows that Spark sends to Python at a time, for what is planned within: rows that hold whole
    texts make batches of tens of MB otherwise, which JVM and Python hold several times over."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, min(rows, int(before)) if int(before) > 0 else rows)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def without(df: DataFrame, rows: DataFrame, keys: list[Column], limit: int = BROADCAST_BYTES) -> DataFrame:
    """df without the rows whose keys are in rows (a table that is cheap to read again, as many integers).

    They are counted first: up to `limit` bytes of them are broadcast, so that df stays where it is;
    more are joined by a shuffle of both sides."""
    small = rows.count() * 32 <= limit
    named = [fresh(df, f"_key{i}") for i in range(len(keys))]
    rows = rows.toDF(*named)
    marked = df.withColumns({f"{n}_": k for n, k in zip(named, keys)})
    same = reduce(and_, [marked[f"{n}_"] == rows[n] for n in named])
    return marked.join(F.broadcast(rows) if small else rows.hint("merge"), same, "left_anti").select(*df.columns)


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for each node of the undirected edges, root the smallest node of its component.

    Alternates large-star and small-star steps until the set of edges no longer changes. Each step
    aggregates before it shuffles, and joins written tables, so that adaptive execution can split the
    partition of a node with very many neighbours."""

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())

    e = cut(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "edges")
    before = state(e)
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = cut(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")), "least")
        large = cut(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        least = cut(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = cut(small.union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "edges")
        after = state(e)
        if after == before:
            break
        before = after
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
