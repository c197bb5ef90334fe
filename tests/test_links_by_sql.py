"""Links whose addresses differ by a fragment, a parameter or their spelling, against the SQL."""

import oracle

from gleanery import registry


def test_links_are_told_apart_as_in_sql(spark, tmp_path, monkeypatch):
    tails = ["", "#top", "/", "/#top", "//?utm_source=feed", "?utm_source=feed", "?b=2&a=1", "?a=1&b=2", "/?x=a//", "//www.b/c", "#a\nb"]
    heads = ["https://x.example.net/de/1", "http://www.x.example.net/de/1", "https://X.example.net/de/1", "http://x.example.net:80/de//1"]
    pages = [h + t for h in heads for t in tails]
    rows = [(i, f" {pages[i % len(pages)]}" if i % 5 == 0 else pages[i % len(pages)], "") for i in range(1500)] + [(2004, None, "")]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    monkeypatch.setattr(oracle, "DATA", str(tmp_path))
    monkeypatch.setattr(oracle, "TABLES", ["pages"])
    oracle.compare(registry.queries()["link_routing"](spark, str(tmp_path)), registry.oracle_sql()["link_routing"])
