"""Pages are read to their end."""

import oracle
from pyspark.sql import functions as F

from gleanery import registry
from gleanery.sources import pages


def test_main_texts_are_whole(spark, tmp_path, monkeypatch):
    rows = [(i, f"{i} requirements " + "word " * n + "benefits end", "en", "a", 0) for i, n in enumerate([0, 200, 2990, 3000, 6000, 11_900, 12_100])]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(oracle, "DATA", str(tmp_path))
    monkeypatch.setattr(oracle, "TABLES", ["documents"])
    for name in ("page_main_texts", "page_routes", "page_enrichment"):
        oracle.compare(registry.queries()[name](spark, str(tmp_path)), registry.oracle_sql()[name])
    got = {r.id: r for r in registry.queries()["page_main_texts"](spark, str(tmp_path)).collect()}
    assert all("benefits end" in got[i].shown for i in got) and len(got[6].shown) > 60_000
    assert [got[i].like_posting for i in (0, 4, 5, 6)] == [False, True, True, False]


def test_a_given_limit_holds(spark):
    html = "<main>" + "word " * 9000 + "</main>"
    (r,) = spark.range(1).select(F.length(pages.main_text(F.lit(html))).alias("all"), F.length(pages.main_text(F.lit(html), pages.SHOWN)).alias("some")).collect()
    assert (r.all, r.some) == (44_999, 15_000)


def test_all_postings_of_a_page_count(spark):
    nodes = ",".join(f'{{"@type":"JobPosting","title":"{"" if i == 4 else f"Chef {i}"}"}}' for i in range(30))
    scripts = [f"[{nodes}]", f'{{"@graph":[{{"@type":"WebPage"}},{nodes}]}}', f"[{nodes[: nodes.index('},') + 1]}]"]
    rows = [(f"https://x.io/{k}", f'<script type="application/ld+json">{s}</script>') for k, s in enumerate(scripts)]
    rows.append(("https://x.io/3", "".join(h for _, h in rows)))
    found = pages.from_jsonld(spark.createDataFrame(rows, "url string, html string")).groupBy("source_url").count().collect()
    assert {r.source_url[-1]: r["count"] for r in found} == {"0": 29, "1": 29, "2": 1, "3": 59}
