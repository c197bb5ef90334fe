import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from oracle import DATA, compare  # noqa: E402

import corpus_pipeline  # noqa: E402
from gleanery.llm import queries  # noqa: E402
from gleanery.session import table  # noqa: E402

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_agrees_with_sql(spark, name):
    compare(queries.queries()[name](spark, DATA), queries.oracle_sql()[name])


@pytest.mark.parametrize("name", ["op3_pii", "op6_mixing", "op10_secret_scan"])
def test_a_row_for_each_document(spark, name):
    docs = sorted(r.doc_id for r in table(spark, DATA, "documents").select("doc_id").collect())
    assert sorted(r.doc_id for r in queries.queries()[name](spark, DATA).select("doc_id").collect()) == docs


def test_language_query_covers_documents_and_pages(spark):
    rows = queries.queries()["op7_language_id"](spark, DATA).collect()
    docs, pages = (table(spark, DATA, n).count() for n in ("documents", "pages"))
    assert sum(r.doc_id is not None for r in rows) == docs and sum(r.page_id is not None for r in rows) == pages
    known = [r for r in rows if r.declared and r.language != "und"]
    assert sum(r.language == r.declared for r in known) > 0.95 * len(known)


def test_pipeline(spark):
    docs = table(spark, DATA, "documents").limit(0)
    before = {r.doc_id: r for r in table(spark, DATA, "documents").collect()}
    current = table(spark, DATA, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, current, DATA)
        assert after.columns == docs.columns, name
        ids = [r.doc_id for r in after.collect()]
        assert len(ids) == len(set(ids)) and set(ids) <= {r.doc_id for r in current.collect()}, name
        current = spark.createDataFrame([before[i] for i in ids], docs.schema)
    texts = [(r.text or "").encode().lower() for r in current.collect()]
    assert len(texts) == len(set(texts))
    final = corpus_pipeline.run(spark, DATA).collect()
    assert {r.doc_id for r in final} <= {r.doc_id for r in current.collect()}
    assert all(r.n_tokens == len((r.text or "").split()) for r in final)


def test_pipeline_stages_on_odd_tables(spark):
    """Nulls in every column, repeated rows, shared ids, very long and empty texts, columns whose names clash."""
    docs = table(spark, DATA, "documents").limit(60).collect()
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars, 1, 2, 3, "x") for r in docs]
    clean = rows[0][1] + " of its own"
    rows += [(None, None, None, None, None, None, None, None, None), (None, clean + " id", None, None, None, 0, 0, 0, ""), (rows[0][0], clean + " shared", "en", None, 1, 0, 0, 0, "")]
    rows += [(900, "", "en", "s", 0, 0, 0, 0, ""), (901, "%%% 123", "en", "s", 0, 0, 0, 0, ""), (902, "The of and to in that is " * 20_000, "en", "s", 0, 0, 0, 0, ""), rows[1], rows[1]]
    schema = "doc_id long, text string, lang string, source string, n_chars long, `key` int, n_tokens int, _h int, _topic string"
    odd = spark.createDataFrame(rows, schema)
    current = odd
    for name, stage in corpus_pipeline.STAGES:
        for given in (odd, odd.limit(0)):
            assert stage(spark, given, DATA).columns[: len(odd.columns)] == odd.columns, name
        assert stage(spark, odd.limit(0), DATA).count() == 0, name
        if name == "mixing":
            continue
        before = [tuple(r) for r in current.collect()]
        after = [tuple(r) for r in stage(spark, current, DATA).collect()]
        assert not [r for r in after if r not in before], name
        if name == "language":
            assert {r[0] for r in before if r not in after} <= {None, 900, 901} and (None, clean + " id", None, None, None, 0, 0, 0, "") in after
        if name == "exact_dedup":
            texts = [(r[1] or "").encode().lower() for r in after]
            assert len(texts) == len(set(texts)) and set(texts) == {(r[1] or "").encode().lower() for r in before}
        current = spark.createDataFrame(after, schema)
    assert 902 in {r.doc_id for r in current.collect()}
