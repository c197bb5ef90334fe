"""Joins of postings with what is known: seen rows, applications, boards, prices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gleanery.functions import text
from gleanery.operators.likeness import alike
from gleanery.session import written

col = F.col


def first_arrivals(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key, where the key is complete; rows with a null in it all stay."""
    whole = None
    for k in keys:
        whole = col(k).isNotNull() if whole is None else whole & col(k).isNotNull()
    first = rows.where(whole).withColumn("_rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_rank = 1").drop("_rank")
    return first.unionByName(rows.where(~whole))


def known(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """incoming with known_id: the stored posting with its url_hash, else with its (source, external_id).

    Two equi-joins instead of one on either key, which would compare all pairs."""
    by_url = stored.groupBy("url_hash").agg(F.min("id").alias("_by_url"))
    by_ext = stored.where("external_id is not null").groupBy("source", "external_id").agg(F.min("id").alias("_by_ext"))
    out = incoming.join(by_url, "url_hash", "left").join(by_ext, ["source", "external_id"], "left")
    return out.withColumn("known_id", F.coalesce("_by_url", "_by_ext")).drop("_by_url", "_by_ext")


def named(rows: DataFrame) -> DataFrame:
    """rows with company_norm, and title_norm if they have a title; as they are if they have company_norm."""
    if "company_norm" in rows.columns:
        return rows
    forms = {"company": ("company_name", text.company_form)} | ({"title": ("title", text.title_form)} if "title" in rows.columns else {})
    folded = rows.withColumns({f"{n}_folded": text.fold(col(c)) for n, (c, _) in forms.items()})
    return folded.withColumns({f"{n}_norm": form(col(f"{n}_folded")) for n, (_, form) in forms.items()})


def prior_applications(postings: DataFrame, applications: DataFrame, now_hour: int, window_days: int, least: float) -> DataFrame:
    """(id, application_id): the first live application to the posting's company within the window that is
    for the same posting or for a title at least so similar.

    Both tables have company_norm and title_norm, or company_name and title to make them of. Applications are grouped by
    their names as they are written before these are folded: a name is folded once, not once for each application. The
    distinct titles of both sides are written, as the comparison reads them several times.

    Distinct titles are compared, not rows, and of these only those that an index of runs of letters brings together
    (`likeness`), so neither a company with very many rows nor one with very many titles compares them all."""
    company, title = ("company_norm", "title_norm") if "company_norm" in applications.columns else ("company_name", "title")
    live = applications.where((col("status") != "withdrawn") & (col("applied_hour") > now_hour - 24 * window_days))
    firsts = named(live.groupBy(company, title).agg(F.min("id").alias("_first"))).where("company_norm <> ''")
    firsts = written(firsts.groupBy("company_norm", col("title_norm").alias("applied_title")).agg(F.min("_first").alias("application_id")), "applied_titles")
    postings = named(postings)
    titles = written(postings.where("company_norm <> ''").select("company_norm", "title_norm").distinct(), "titles")
    near = alike(titles, firsts, ["company_norm"], "title_norm", "applied_title", least).join(firsts, ["company_norm", "applied_title"])
    by_title = near.groupBy("company_norm", "title_norm").agg(F.min("application_id").alias("_by_title"))
    same = named(live.groupBy(company, col("opportunity_id").alias("id")).agg(F.min("id").alias("_first"))).where("company_norm <> ''")
    same = same.groupBy("company_norm", "id").agg(F.min("_first").alias("_same"))
    out = postings.join(by_title, ["company_norm", "title_norm"], "left").join(same, ["company_norm", "id"], "left")
    return out.select("id", F.coalesce(F.least("_by_title", "_same"), "_by_title", "_same").alias("application_id"))


def priced(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """usage with the price of the longest model prefix, else of `default`.

    prices (prefix, price_in, price_out) is a short configured list; it is matched with the distinct models
    only, so the prefix comparison sees names, not calls."""
    models = usage.select("model").distinct()
    fits = models.join(F.broadcast(prices.where("prefix <> 'default'")), col("model").startswith(col("prefix")), "left")
    best = fits.groupBy("model").agg(F.max_by(F.struct("price_in", "price_out"), F.length("prefix")).alias("price"))
    default = prices.where("prefix = 'default'").select(F.struct("price_in", "price_out").alias("fallback"))
    table = best.crossJoin(F.broadcast(default.limit(1))).select("model", F.coalesce("price", "fallback").alias("price"))
    return usage.join(table, "model").select(*usage.columns, "price.price_in", "price.price_out")


def absent(incoming: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """incoming rows whose key is not stored: insert, or ignore on conflict."""
    return incoming.join(stored.select(*keys).distinct(), keys, "left_anti")


def bundles(rows: DataFrame, key: str, fields: list[str], order: Column, most: int) -> DataFrame:
    """(key, items): at most `most` newest rows of each key as an array. Ranked before they are gathered."""
    ranked = rows.withColumn("_rank", F.row_number().over(W.partitionBy(key).orderBy(order))).where(col("_rank") <= most)
    return ranked.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("_rank", *fields))), lambda x: F.struct(*[x[f].alias(f) for f in fields])).alias("items"))
