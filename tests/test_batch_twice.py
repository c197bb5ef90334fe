"""A batch that comes again is not worked out again."""

from oracle import DATA

from gleanery.operators import ingest
from gleanery.operators.store import Store
from gleanery.plans import detail_queries as q


def test_a_known_batch_is_left_at_once(spark, tmp_path, monkeypatch):
    incoming, before = q.arrivals(spark, DATA)
    store = Store(spark, str(tmp_path / "t"), "id", before.withColumn("pipeline_status", ingest.F.lit("new")).select(*ingest.KEPT).schema, 4)
    assert ingest.ingest_into(store, incoming, q.RUN, q.NOW, "one")
    state = store.state()
    monkeypatch.setattr(ingest, "outcomes", None)  # would fail if it were called
    assert not ingest.ingest_into(store, incoming, q.RUN, q.NOW, "one") and store.state() == state
