"""The registered queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.llm import bpe, collocations, decontaminate, exact_dedup, language_id, license_scan, line_dedup, mixing, periodic_runs, pii, secret_scan, simhash_dedup, url_filter
from gleanery.session import table

Query = Callable[[SparkSession, str], DataFrame]

LOWER_SQL = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.annotate(table(spark, sf_dir, "documents"))


OP2_SQL = f"""
WITH d AS (SELECT doc_id, sha256({LOWER_SQL.format('text')}) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op4_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_dedup.components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.clean(table(spark, sf_dir, "documents"))


OP5_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS host, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
totals AS (SELECT host, count(*) AS pages FROM d GROUP BY host),
each AS (SELECT host, unnest(list_distinct(lines)) AS line FROM d),
over_ratio AS (
  SELECT host, line FROM each JOIN totals USING (host) WHERE trim(line) <> ''
  GROUP BY host, line, pages HAVING count(*) >= {line_dedup.MIN_PAGES} AND count(*) > pages * {line_dedup.RATIO}),
bad AS (SELECT host, list(line) AS dropped FROM over_ratio GROUP BY host),
kept AS (SELECT doc_id, lines, list_filter(lines, lambda x: NOT list_contains(coalesce(dropped, []), x)) AS rest FROM d LEFT JOIN bad USING (host))
SELECT doc_id, array_to_string(rest, chr(10)) AS text, CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(rest) AS BIGINT) AS n_dropped FROM kept
"""

def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of sources and languages as in `mixing.TARGETS`, topics by clusters."""
    rows = mixing.mix_weights(table(spark, sf_dir, "documents"), drop=("text",))
    return rows.select("doc_id", "source", "lang", F.element_at(F.split("cell", "\x1f"), 3).alias("topic"), "n_tokens", "factor", "probability", "weight", "sampled")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents declare a language and name a source; pages have markup, an address and a host."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.lit(None).cast("long").alias("page_id"), "text", F.col("lang").alias("declared"), F.col("source").alias("host"))
    pages = table(spark, sf_dir, "pages").select(
        F.lit(None).cast("long").alias("doc_id"), "page_id", language_id.markup_text(F.col("html")).alias("text"), language_id.markup_language(F.col("html")).alias("declared"), url_filter.url_host(F.col("url")).alias("host")
    )
    return language_id.identify(docs.unionByName(pages)).withColumn("kept", ~language_id.rejected())


#: The rules of the query.
URL_RULES = [
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
]


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, action string")
    return url_filter.judge(table(spark, sf_dir, "pages").select("page_id", "url"), rules)


OP8_SQL = f"""
WITH cutoff AS (SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw_host, rest FROM cutoff),
p AS (SELECT page_id, {LOWER_SQL.format('raw_host')} AS host, regexp_extract(substr(rest, length(raw_host) + 1), '^[^?#]*') AS path FROM parts),
r AS (SELECT * FROM (VALUES {', '.join(str(x) for x in URL_RULES)}) t(rule_host, rule_path, action)),
m AS (SELECT page_id, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule, arg_max(action, length(rule_host || rule_path)) AS action
  FROM p JOIN r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM p LEFT JOIN m USING (page_id)
"""


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def license_sql() -> str:
    """SQL counts the words of each template in each block of a text that has enough of them at all."""
    not_word = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    words = lambda x: f"list_filter(string_split_regex({x}, '{not_word}'), lambda w: w <> '')"
    starts, base = [], []
    for phrase, label in license_scan.PHRASES.items():
        parts = phrase.split()
        here = " AND ".join(f"words[i + {k + 1}] = '{w}'" for k, w in enumerate(parts))
        starts.append(f"list_filter(range(0, len(words) - {len(parts) - 1}), lambda i: {here})")
        base.append(f"CASE WHEN len(places[{len(base) + 1}]) > 0 THEN '{label}' END")
    templates = []
    for i, (label, text) in enumerate(license_scan.TEMPLATES):
        listed = [w.decode() for w in license_scan.words_of(text)]
        own, at = sorted(set(listed)), license_scan.THRESHOLD
        templates.append(f"({i}, '{label}', {own}, {license_scan.needed(len(own), at)}, {license_scan.block_words(len(listed), at)})")
    return f"""
WITH d AS (SELECT doc_id, {LOWER_SQL.format('text')} AS low FROM documents),
w AS (SELECT doc_id, {words('low')} AS words FROM d),
s AS (SELECT doc_id, len(words) AS n_words, [{', '.join(starts)}] AS places FROM w),
b AS (SELECT doc_id, n_words, flatten(places) AS places, list_filter([{', '.join(base)}], lambda x: x IS NOT NULL) AS base FROM s),
t AS (SELECT * FROM (VALUES {', '.join(templates)}) v(tid, label, own, need, block)),
c AS (SELECT doc_id, words, tid, label, own, need, block FROM w JOIN t ON len(list_intersect(list_distinct(words), own)) >= need),
p AS (SELECT doc_id, tid, label, own, need, block, unnest(words) AS word, unnest(range(len(words))) AS at FROM c),
h AS (SELECT * FROM p WHERE list_contains(own, word)),
o AS (SELECT x.doc_id, x.label, count(DISTINCT y.word) / len(x.own) AS share
  FROM h x JOIN h y ON x.doc_id = y.doc_id AND x.tid = y.tid AND y.at BETWEEN x.at AND x.at + x.block - 1
  GROUP BY x.doc_id, x.tid, x.label, x.own, x.need, x.at HAVING count(DISTINCT y.word) >= x.need),
m AS (SELECT doc_id, list(DISTINCT label) AS found, max(share) AS score FROM o GROUP BY doc_id)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(len(places) AS BIGINT) AS n_base, CAST(list_min(places) AS BIGINT) AS first_word, CAST(list_max(places) AS BIGINT) AS last_word,
       array_to_string(list_sort(base), ',') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(base, coalesce(found, [])))), ',') AS labels, coalesce(score, 0.0) AS score
FROM b LEFT JOIN m USING (doc_id)
"""


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.find(table(spark, sf_dir, "documents"))


def op11_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The file's place is a parameter of the operator; this is where the public tokenizers are."""
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    ids = bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), path)
    rows = bpe.decode(ids.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), "ids"), path)
    return rows.select("doc_id", "n_tokens", "ids_sha256", F.sha2("text", 256).alias("decoded_sha256"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def collocation_sql() -> str:
    """SQL counts every phrase of up to four words."""
    at = lambda words, start, size: f"array_to_string({words}[{start}:{start} + {size} - 1], ' ')"
    grams = " UNION ALL ".join(f"SELECT lang, {k} AS size, unnest(list_transform(range(1, len(words) - {k - 2}), lambda i: {at('words', 'i', k)})) AS phrase FROM w" for k in range(1, collocations.LONGEST + 1))
    cuts = " UNION ALL ".join(f"SELECT lang, phrase, n, {k} AS k, {at('words', 1, k)} AS left_part, {at('words', k + 1, f'size - {k}')} AS right_part FROM c WHERE size > {k}" for k in range(1, collocations.LONGEST))
    inner = " UNION ALL ".join(f"SELECT lang, n, unnest(list_transform(range(1, size - {k - 2}), lambda i: {at('words', 'i', k)})) AS phrase FROM c WHERE size > {k}" for k in range(2, collocations.LONGEST))
    return f"""
WITH t AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({LOWER_SQL.format('text')}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS words FROM t),
totals AS (SELECT lang, sum(len(words)) AS total FROM w GROUP BY lang),
f AS (SELECT lang, size, phrase, count(*) AS n FROM ({grams}) GROUP BY ALL HAVING count(*) >= {collocations.THRESHOLD}),
c AS (SELECT lang, size, phrase, n, string_split(phrase, ' ') AS words FROM f WHERE size > 1),
s AS (SELECT x.lang, x.phrase, x.n AS a, k, l.n AS l, r.n AS r, (2000000::HUGEINT * x.n) // (l.n + r.n) AS score
  FROM ({cuts}) x JOIN f l ON l.lang = x.lang AND l.phrase = left_part JOIN f r ON r.lang = x.lang AND r.phrase = right_part),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
m AS (SELECT lang, phrase, max(n) AS most FROM ({inner}) GROUP BY ALL),
k AS (SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank
  FROM b LEFT JOIN m ON m.lang = b.lang AND m.phrase = b.phrase WHERE most IS NULL OR 100::HUGEINT * most < {collocations.WITHIN}::HUGEINT * a)
SELECT k.lang, rank, phrase, a, l, r, CAST(total AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM k JOIN totals USING (lang) WHERE rank <= {collocations.TOP}
"""


def looped(docs: DataFrame) -> DataFrame:
    """(doc_id, text), where the end of every tenth document (by a hash of its id) repeats itself."""
    h = F.crc32(F.col("doc_id").cast("string"))
    rows = docs.select("doc_id", "text", (F.coalesce(h % 10, F.lit(1)) == 0).alias("chosen"), F.floor(h / 10).alias("g"))
    rows = rows.withColumn("words", F.when(F.col("chosen"), F.filter(F.split("text", r"[ \t-\r]+"), lambda w: w != "")))
    n, g = F.size("words"), F.col("g")
    rows = rows.withColumn("n", n).withColumn("a", (g % F.col("n")).cast("int"))
    rows = rows.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + g % 8))).cast("int"))
    a, p = F.col("a"), F.col("p")
    tail = F.transform(F.sequence(a, F.col("n") - 1), lambda i: F.get("words", a + (i - a) % p))
    text = F.when(F.col("chosen") & (F.col("n") > 0), F.array_join(F.concat(F.slice("words", F.lit(1), a), tail), " ")).otherwise(F.col("text"))
    return rows.select("doc_id", text.alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.detect(looped(table(spark, sf_dir, "documents")))
    line = lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), F.concat(r["period"].cast("string"), F.lit("\n")))
    rows = found.select("doc_id", "runs", "text", periodic_runs.sharpest(F.col("runs")).alias("best"))
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"), F.sha2("text", 256).alias("collapsed_sha256"),
    )


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Query]:
    return {
        "op1_decontaminate": op1_decontaminate,
        "op2_exact_dedup": op2_exact_dedup,
        "op3_pii": op3_pii,
        "op4_simhash_dedup": op4_simhash_dedup,
        "op5_line_dedup": op5_line_dedup,
        "op6_mixing": op6_mixing,
        "op7_language_id": op7_language_id,
        "op8_url_filter": op8_url_filter,
        "op9_license_scan": op9_license_scan,
        "op10_secret_scan": op10_secret_scan,
        "op11_bpe": op11_bpe,
        "op12_collocations": op12_collocations,
        "op13_periodic_runs": op13_periodic_runs,
        "pipeline": pipeline,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_exact_dedup": OP2_SQL,
        "op5_line_dedup": OP5_SQL,
        "op8_url_filter": OP8_SQL,
        "op9_license_scan": license_sql(),
        "op12_collocations": collocation_sql(),
    }
