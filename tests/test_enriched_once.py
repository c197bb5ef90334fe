"""A page goes to Python once, and only the part of it that is needed."""

from gleanery.sources import pages


def test_pages_go_to_python_once(spark):
    said = "You will like it. Requirements: " + "much to say " * 60
    html = [("https://x.io/1", '<script type="application/ld+json">{"@graph":[{"@type":"WebPage"},{"@type":["Thing","JobPosting"],"description":"<p>Longer text</p>"}]}</script><main>' + said + "</main>"), ("https://x.io/2", f"<main>{said}</main>"), ("https://x.io/3", "<main>Shop</main>"), ("https://x.io/4", None)]
    jobs = spark.createDataFrame([(i, f"https://x.io/{i}", "short") for i in range(1, 6)], "id int, source_url string, description string")
    found = pages.enriched(jobs, spark.createDataFrame(html, "url string, html string"))
    assert {r.id: r.description for r in found.collect()} == {1: "Longer text", 2: said.strip(), 3: "short", 4: "short", 5: "short"}
    assert found._jdf.queryExecution().optimizedPlan().toString().count("EvalPython") == 1
