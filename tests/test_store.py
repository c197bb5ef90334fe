"""The stored table: partial rewrites, versions, batches that come twice, streams into it."""

import os

import pytest
from oracle import DATA

from gleanery.operators import ingest
from gleanery.operators.store import Store
from gleanery.plans import detail_queries as q
from gleanery.streaming import jobs

SHAPE = "id long, v string"


def rows_of(store):
    return {r.id: r.v for r in store.read().collect()}


def files(path):
    return {os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet") and "/manifest" not in d}


def test_partial_rewrites(spark, tmp_path):
    first = spark.createDataFrame([(i, f"a{i}") for i in range(200)], SHAPE)
    store = Store(spark, str(tmp_path / "t"), "id", first.schema, 8)
    assert rows_of(store) == {} and store.upsert(first, "one")
    before, (_, folders) = files(store.path), store.state()
    change = spark.createDataFrame([(3, "new"), (1000, "more")], SHAPE)
    assert store.upsert(change, "two") and not store.upsert(change.limit(0), "two")
    assert rows_of(store) == {i: f"a{i}" for i in range(200)} | {3: "new", 1000: "more"}
    _, after = store.state()
    moved = {p for p in after if after[p] != folders.get(p)}
    assert 1 <= len(moved) <= 2 and before <= files(store.path)  # what was not touched has its old name
    assert store.remove(spark.createDataFrame([(i, "") for i in range(200) if i != 7], SHAPE), "three") and rows_of(store) == {7: "a7", 1000: "more"}
    assert store.remove(spark.createDataFrame([(7, ""), (1000, "")], SHAPE), "four") and rows_of(store) == {}
    assert store.upsert(first.limit(0), "five") and rows_of(store) == {}


def test_a_change_that_fails_is_not_read(spark, tmp_path):
    first = spark.createDataFrame([(1, "a"), (2, "b")], SHAPE)
    store = Store(spark, str(tmp_path / "t"), "id", first.schema, 4)
    store.upsert(first, "one")

    def fails(old):
        old.withColumn("_part", store.partition(old.id)).write.partitionBy("_part").parquet(f"{store.path}/data/2-left")
        raise RuntimeError

    with pytest.raises(RuntimeError):
        store.change("two", first, fails)
    assert rows_of(store) == {1: "a", 2: "b"} and store.upsert(first.limit(1).selectExpr("id", "'c' as v"), "two") and rows_of(store) == {1: "c", 2: "b"}


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
def test_a_stream_into_the_store_is_the_batches(spark, tmp_path):
    incoming, before = q.arrivals(spark, DATA)
    before = before.selectExpr("*").withColumn("pipeline_status", before.title).select(*ingest.KEPT)
    one, two = (Store(spark, str(tmp_path / n), "id", before.schema, 8) for n in ("one", "two"))
    parts = [incoming.where("id < 90"), incoming.where("id >= 90")]
    for i, part in enumerate(parts):
        part.coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
        os.utime(tmp_path / f"in/{i}", (i, i))
    for store in (one, two):
        store.upsert(before, "load")
    for i, part in enumerate(parts):
        ingest.ingest_into(one, part, 7, q.NOW, f"ingest {i}")
    for i in range(2):  # the second part comes with the second start of the stream, the first is not read again
        stream = spark.readStream.schema(incoming.schema).parquet(str(tmp_path / f"in/[0-{i}]"))
        jobs.ingest_stream(stream, two, 7, q.NOW, str(tmp_path / "state"))
    assert sorted(map(str, one.read().collect())) == sorted(map(str, two.read().collect()))
    version, _ = two.state()
    ingest.ingest_into(two, parts[0], 7, q.NOW, "ingest 0")  # tried again
    assert two.state()[0] == version
