"""Prior applications by names as they are written."""

from gleanery.operators import joins


def test_names_are_grouped_before_they_are_folded(spark):
    jobs = spark.createDataFrame([(1, "Acme Inc.", "Sr. React.js Engineer"), (2, None, "Chef"), (3, "Hooli", "Chef"), (4, "Café Ltd", "Cook")], "id long, company_name string, title string")
    done = [(7, 90, "ACME, LLC", "Senior React Engineer"), (5, 91, "acme", "senior react engineer"), (8, 3, "Hooli", "Baker"), (9, 2, " ", "Chef"), (6, None, "Cafe", "Cook")]
    done = spark.createDataFrame([(*r, "applied", 99) for r in done] + [(1, 1, "Acme", "Senior React Engineer", "withdrawn", 99)], "id long, opportunity_id long, company_name string, title string, status string, applied_hour int")
    found = joins.prior_applications(jobs, done, 100, 30, 100.0)
    assert {r.id: r.application_id for r in found.collect()} == {1: 5, 2: None, 3: 8, 4: 6}
