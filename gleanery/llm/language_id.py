"""Language identification by Bayesian evidence fusion.

For each row and language the log-probabilities of four kinds of evidence are added:
- the text, by character n-grams of the letters (1 to 3), under models fitted on all distinct texts with a
  declared language, each taken whole and once. Which languages there are is counted over all rows: those with
  LEAST_ROWS distinct texts, or LEAST_SHARE of all. A caller of `fit` may ask for fewer texts (model_rows).
  The mean of the n-grams counts as EFFECTIVE n-grams at most, so that long texts don't drown the rest. A
  uniform model stands for all other languages (`und`);
- the declared language (markup or metadata), right with probability RELIABILITY. Where it has no model, it
  names the uniform one;
- the address suffix and the host, as a prior: the share of a language among the other rows of the host,
  smoothed towards its domain's share, that towards its suffix's share, and that towards the share of all
  rows. The shares count the languages that the texts alone suggest, in grouped aggregations over all rows;
  a row's own text is taken out at each level, so that it doesn't count twice.

One pass scores the texts and writes a table without them; counts, priors and the decision come from that.
The priors are joined by host and suggested language from a written table, so that adaptive execution can
split a hot host.
The models are buckets x languages, sent to every task (128 KB a language): at most MOST_LANGUAGES, those
with most texts; of the others the declared language is the only evidence.

Null texts count as empty. A text without letters is `und` with probability 1 and is rejected. Null hosts
and addresses are one host without a suffix. Repeated rows are each judged. Empty tables give empty results.
`drop_unidentified` drops rows, not ids: rows that share a doc_id are told apart by text, language and host.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.llm.common import BROADCAST_BYTES, cut, row_keys, small_batches, without

BUCKETS = 1 << 15
LANGUAGE_ROWS = 500
MOST_LANGUAGES = 400
LEAST_ROWS = 10
LEAST_SHARE = 0.005
EFFECTIVE = 100
RELIABILITY = 0.9
SMOOTHING = 20.0
UNKNOWN = "und"
UNKNOWN_PRIOR = 1e-4
MIN_PROBABILITY = 0.5


def grams(text: str) -> np.ndarray:
    """The buckets of the character n-grams; runs of other characters than letters count as one space."""
    points = np.frombuffer((" " + text.lower() + " ").encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    letter = ((points >= 97) & (points <= 122)) | ((points >= 0xAA) & (points != 0xD7) & (points != 0xF7) & ((points < 0x2000) | (points > 0x206F)))
    points = np.where(letter, points, np.uint64(32))
    points = points[letter | np.concatenate([[True], letter[:-1]])]
    if not letter.any():
        return np.empty(0, np.int64)
    mix = lambda x: ((x * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(49)).astype(np.int64)
    two = points[:-1] << np.uint64(21) | points[1:]
    three = two[:-1] << np.uint64(21) | points[2:]
    return np.concatenate([mix(points[points != 32] + np.uint64(1 << 63)), mix(two), mix(three)])


def code(language: Column) -> Column:
    """The primary part of a language tag in lower case; '' for none."""
    return F.lower(F.regexp_extract(F.coalesce(language, F.lit("")), r"^\s*([A-Za-z]{2,3})(?:$|[^A-Za-z])", 1))


def host_levels(host: Column) -> dict[str, Column]:
    """host, domain (last two labels) and suffix (last label behind a dot)."""
    host = F.lower(F.coalesce(host, F.lit("")))
    return {"host": host, "domain": F.substring_index(host, ".", -2), "suffix": F.when(host.contains("."), F.substring_index(host, ".", -1)).otherwise("")}


def markup_language(html: Column) -> Column:
    return F.regexp_extract(F.coalesce(html, F.lit("")), r"""(?is)<html\b[^>]{0,2000}?\blang\s{0,9}=\s{0,9}["']?([A-Za-z]{2,3})""", 1)


def markup_text(html: Column) -> Column:
    """The text of a page: no scripts, styles, comments or tags."""
    html = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    return F.regexp_replace(F.regexp_replace(html, r"<[^<>]*>", " "), r"&[A-Za-z0-9#]{1,9};", " ")


class Models:
    """Log-probabilities of the buckets for each language, the last one for unknown languages."""

    def __init__(self, counts: dict[str, np.ndarray]):
        self.languages = [*sorted(counts), UNKNOWN]
        table = [np.log((counts[x] + 0.5) / (counts[x].sum() + 0.5 * BUCKETS)) for x in self.languages[:-1]]
        # the uniform model is over a typical part of the buckets: it wins where all others find nothing they know
        self.table = np.array([*table, np.full(BUCKETS, -math.log(BUCKETS / 4))]).T.astype(np.float32)

    def score(self, text: str) -> list[float] | None:
        """The weighed log-likelihood of each language, None for a text without letters."""
        found = grams(text)
        if not len(found):
            return None
        if len(found) < 4 * BUCKETS:
            total = self.table[found].sum(axis=0, dtype=np.float64)
        else:
            total = np.bincount(found, minlength=BUCKETS) @ self.table.astype(np.float64)
        return (total / len(found) * min(len(found), EFFECTIVE)).tolist()


def fit(rows: DataFrame, model_rows: int | None = None, language_rows: int = LANGUAGE_ROWS) -> Models:
    """Models from all distinct texts of rows (text, declared). With model_rows, from a hashed part of them: so many
    in expectation, and language_rows of each language where it has them."""
    spark = rows.sparkSession
    rows = rows.where(f"declared <> '' and declared <> '{UNKNOWN}' and text <> ''").select("declared", "text", F.xxhash64("text").alias("key"))
    keys = cut(rows.groupBy("declared", "key").agg(F.count(F.lit(1)).alias("n")), "text_keys")
    # one row for each code of two or three letters
    texts = {r.declared: r.n for r in keys.groupBy("declared").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(texts.values())
    keep = [x for x, n in texts.items() if n >= LEAST_ROWS or n >= LEAST_SHARE * total]
    keep = sorted(keep, key=lambda x: (-texts[x], x))[:MOST_LANGUAGES]
    share = lambda n: 1 if model_rows is None or n <= language_rows or total <= model_rows else max(model_rows / total, language_rows / n)
    parts = spark.createDataFrame([(x, min(1_000_000, math.ceil(1e6 * share(texts[x])))) for x in keep], "declared string, part long")
    taken = rows.join(F.broadcast(parts), "declared").where(F.pmod("key", F.lit(1_000_000)) < F.col("part")).select("declared", "text", "key")
    # texts that are alone stay where they are; of the others one each, copies are met before they move
    copied = cut(keys.where("n > 1").select("declared", "key"), "copied_keys")
    alone = without(taken, copied, [F.col("declared"), F.col("key")])
    small = copied.count() * 32 <= BROADCAST_BYTES
    again = taken.join(F.broadcast(copied) if small else copied.hint("merge"), ["declared", "key"], "left_semi")
    again = again.groupBy("declared", "key").agg(F.first("text").alias("text"))
    sample = alone.select("declared", "text").union(again.select("declared", "text"))

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: dict[str, np.ndarray] = {}

        def told() -> Iterator[pd.DataFrame]:
            for language, c in counts.items():
                at = np.flatnonzero(c)
                yield pd.DataFrame({"declared": language, "bucket": at, "n": c[at]})
            counts.clear()

        held: dict[str, list[np.ndarray]] = {}  # n-grams that are not counted yet

        def count(language: str) -> None:
            counts[language] += np.bincount(np.concatenate(held.pop(language)), minlength=BUCKETS)

        for batch in batches:
            for language, text in zip(batch["declared"], batch["text"]):
                if language not in counts:
                    if len(counts) == 100:
                        for full in list(held):
                            count(full)
                        yield from told()
                    counts[language] = np.zeros(BUCKETS, np.int64)
                waiting = held.setdefault(language, [])
                waiting.append(grams(text))
                if len(waiting) == 32:
                    count(language)
            for language in list(held):
                count(language)
        yield from told()

    parts = sample.mapInPandas(counted, "declared string, bucket int, n long")
    with small_batches(spark):
        parts = cut(parts.groupBy("declared", "bucket").agg(F.sum("n").alias("n")), "models")
    counts: dict[str, np.ndarray] = {}
    lists = parts.groupBy("declared").agg(F.collect_list("bucket").alias("bucket"), F.collect_list("n").alias("n"))
    for row in lists.toLocalIterator():  # a row for each modelled language, of BUCKETS numbers at most
        counts[row.declared] = np.zeros(BUCKETS, np.int64)
        counts[row.declared][row.bucket] = row.n
    return Models(counts)


def scored(rows: DataFrame, models: Models) -> DataFrame:
    """rows (key, text, ...) without the text, plus likely: an array of log-likelihoods, null without letters."""
    others = [f for f in rows.schema.fields if f.name != "text"]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            likely = pa.array([models.score(t) for t in batch.column("text").to_pylist()], pa.list_(pa.float64()))
            kept = [n for n in batch.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), likely], [*kept, "likely"])

    kept = rows.select(*[f.name for f in others], "text")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in others) + ", likely array<double>"
    with small_batches(rows.sparkSession):
        return cut(kept.mapInArrow(each, schema), "likelihoods")


def argmax(values: Column) -> Column:
    return F.array_position(values, F.array_max(values)).cast("int") - 1


def suggested(count: int) -> Column:
    """The number of the known language that the text suggests, null without letters."""
    return argmax(F.slice("likely", 1, count))


def priors(rows: DataFrame, count: int, smoothing: float = SMOOTHING) -> DataFrame:
    """(host, best, prior): smoothed log-shares of the known languages for the rows of a host whose texts suggest
    `best`, by grouped counts of what the texts suggest, without the row itself."""
    seen = rows.where("likely is not null").select("host", "domain", "suffix", suggested(count).alias("best"))
    sums = [F.sum(F.when(F.col("best") == i, 1).otherwise(0)).alias(f"c{i}") for i in range(count)]
    names = [f"c{i}" for i in range(count)]
    hosts = cut(seen.groupBy("host", "domain", "suffix").agg(*sums), "hosts")
    again = [F.sum(c).alias(c) for c in names]
    domains = cut(hosts.groupBy("domain", "suffix").agg(*again), "domains")
    suffixes = cut(domains.groupBy("suffix").agg(*again), "suffixes")
    totals = suffixes.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in names]).first()
    whole = F.array(*[F.lit(c) for c in totals])
    held = lambda df, name: df.select(*[c for c in df.columns if c not in names], F.array(*names).alias(name))

    def others(counts: Column) -> Column:
        """The counts without the row itself."""
        return F.transform(counts, lambda c, i: c - F.when(i == F.col("best"), 1).otherwise(0))

    def share(counts: Column, parent: Column) -> Column:
        both = F.array(F.struct(others(counts).alias("c"), parent.alias("up")))
        # bound once: written out in each share they would make an expression of count^2 parts
        total = lambda b: F.aggregate(b["c"], F.lit(0).cast("long"), lambda a, c: a + c)
        split = lambda b: F.transform(F.array(total(b)), lambda t: F.zip_with(b["c"], b["up"], lambda c, u: (c + smoothing * u) / (t + smoothing)))
        return F.flatten(F.flatten(F.transform(both, split)))

    rest = sum(totals) - 1
    top = F.transform(others(whole), lambda c: (c + 1.0) / F.lit(float(rest + count)))
    level = held(hosts, "own").select("*", F.posexplode("own").alias("best", "n")).where("n > 0").drop("n")
    level = level.join(held(domains, "of_domain"), ["domain", "suffix"]).join(held(suffixes, "of_suffix"), "suffix")
    level = level.withColumn("up", share(F.col("of_suffix"), top)).withColumn("up", share(F.col("of_domain"), F.col("up")))
    return cut(level.select("host", "best", F.transform(share(F.col("own"), F.col("up")), lambda x: F.log(x)).alias("prior")), "priors")


def fuse(rows: DataFrame, models: Models, reliability: float = RELIABILITY) -> DataFrame:
    """rows (.., declared, host, domain, suffix, likely) plus language, probability and text_language."""
    known = models.languages[:-1]
    n = len(known)
    languages = F.array(*map(F.lit, models.languages))
    # without any declared language there is nothing to count
    joined = rows.withColumn("best", suggested(n)).join(priors(rows, n), ["host", "best"], "left") if n else rows.withColumn("prior", F.array().cast("array<double>"))
    flat = math.log(1 / max(1, n))
    prior = F.concat(F.coalesce("prior", F.array_repeat(F.lit(flat), n)), F.array(F.lit(math.log(UNKNOWN_PRIOR))))
    wrong = (1 - reliability) / max(1, n - 1)
    silent = F.col("declared").isin("", UNKNOWN)
    modelled = F.col("declared").isin(known) if n else F.lit(False)
    meant = F.when(modelled, F.col("declared")).otherwise(UNKNOWN)
    says = F.transform(languages, lambda x: F.when(x == meant, math.log(reliability)).otherwise(math.log(wrong)))
    says = F.when(silent, F.array_repeat(F.lit(0.0), n + 1)).otherwise(says)
    log_odds = F.zip_with(F.zip_with("likely", prior, lambda a, b: a + b), says, lambda a, b: a + b)
    out = joined.withColumn("log_odds", log_odds)
    scale = F.aggregate("log_odds", F.lit(0.0), lambda acc, x: acc + F.exp(x - F.array_max("log_odds")))
    none = F.col("likely").isNull()
    best = argmax(F.col("log_odds"))
    return out.select(
        *rows.columns,
        F.when(none, UNKNOWN).when((best == n) & ~silent & ~modelled, F.col("declared")).otherwise(F.get(languages, best)).alias("language"),
        F.when(none, 1.0).otherwise(1 / scale).alias("probability"),
        F.when(none, UNKNOWN).otherwise(F.get(languages, argmax(F.col("likely")))).alias("text_language"),
    ).drop("likely")


def identify(rows: DataFrame, models: Models | None = None, model_rows: int | None = None) -> DataFrame:
    """rows (text, declared, host and any key columns) without the text, plus domain, suffix, language,
    probability, text_language."""
    rows = rows.withColumns({"text": F.coalesce("text", F.lit("")), "declared": code(F.col("declared"))})
    rows = rows.withColumns(host_levels(F.col("host")))
    models = models or fit(rows, model_rows)
    return fuse(scored(rows, models), models)


def rejected() -> Column:
    """Rows without letters, of an unknown language, or too uncertain."""
    return (F.col("language") == UNKNOWN) | (F.col("probability") < MIN_PROBABILITY)


def drop_unidentified(docs: DataFrame, declared: str = "lang", host: str = "source") -> DataFrame:
    """docs, all columns, without the rejected rows."""
    keys = row_keys(F.col("text"), F.col(declared), F.col(host))
    rows = docs.select(keys[0].alias("id"), keys[1].alias("key"), "text", F.col(declared).alias("declared"), F.col(host).alias("host"))
    gone = identify(rows).where(rejected()).select("id", "key").distinct()
    return without(docs, cut(gone, "rejected"), keys)
