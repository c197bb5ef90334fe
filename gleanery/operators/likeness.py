"""Similarity joins of titles: pairs of equal keys whose titles are alike, found by an index of runs of letters.

Two titles are alike if twice the longest common subsequence of their word-sorted forms is `least` percent of their
lengths together. Then at most D = (100 - least) % of these letters are outside it, and each of them spoils at most q
runs of q letters. So of g different runs g - q D at least are in both; with the runs of each title in one order,
rarest first, the first q D + 1 of each must meet in one. Only titles that meet so, and whose lengths allow it, are
aligned. Runs have three letters where the threshold is high enough, else two. A title so short that all its runs may be
spoilt is weak: weak titles meet each other by keys and lengths alone. At 90 % these have up to eight letters; from
80 % down all titles are weak.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gleanery.functions.text import similar, sorted_words

col = F.col


def span(least: float) -> int:
    """Letters of a run: three if titles have runs that are not spoilt, else two."""
    return 3 if 3 * spoilt_share(least) <= 0.75 else 2


def spoilt_share(least: float) -> float:
    """D by the letters of a title: the longest one alike has (200 - least) / least of them."""
    return 2 * (100.0 - least) / least


def runs(c: Column, q: int) -> Column:
    """The different runs of q letters."""
    return F.when(F.length(c) >= q, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - q + 1), lambda i: F.substring(c, i, q))))


def candidates(left: DataFrame, right: DataFrame, keys: list[str], a: str, b: str, least: float) -> DataFrame:
    """(keys, a, b): the pairs of different titles a of left and b of right that have to be aligned."""
    q, sides = span(least), {}
    for name, df in ((a, left), (b, right)):
        rows = df.select(*keys, name).distinct().withColumn("_s", sorted_words(col(name)))
        sides[name] = rows.select(*keys, name, F.length("_s").alias("_n"), F.explode_outer(runs(col("_s"), q)).alias("_run"))
    often = sides[a].select("_run").unionAll(sides[b].select("_run")).groupBy("_run").agg(F.count(F.lit(1)).alias("_often"))

    spoilt = F.floor(col("_n") * spoilt_share(least) + F.lit(1e-9)) * q

    def firsts(name: str) -> DataFrame:
        title = W.partitionBy(*keys, name)  # the runs of one title
        rows = sides[name].where("_run is not null").join(often, "_run").withColumn("_rank", F.row_number().over(title.orderBy("_often", "_run")))
        return rows.where(col("_rank") <= spoilt + 1).select(*keys, name, col("_n").alias(f"_n_{name}"), "_run")

    def weak(name: str) -> DataFrame:
        return sides[name].where(col("_n") - q + 1 - spoilt < 1).select(*keys, name, col("_n").alias(f"_n_{name}")).distinct()

    met = firsts(a).join(firsts(b), [*keys, "_run"]).drop("_run").unionByName(weak(a).join(weak(b), keys))
    x, y = col(f"_n_{a}"), col(f"_n_{b}")
    fits = 200.0 * F.least(x, y) >= least * (x + y) - 1e-9
    return met.where(fits & (col(a) != col(b))).select(*keys, a, b).distinct()


def alike(left: DataFrame, right: DataFrame, keys: list[str], a: str, b: str, least: float) -> DataFrame:
    """(keys, a, b): the pairs of titles a of left and b of right with equal keys whose similarity is `least` or more."""
    different = candidates(left, right, keys, a, b, least).where(similar(col(a), col(b), least))
    same = left.select(*keys, a).distinct().join(right.select(*keys, col(b).alias(a)).distinct(), [*keys, a]).select(*keys, a, col(a).alias(b))
    return different.unionByName(same)
