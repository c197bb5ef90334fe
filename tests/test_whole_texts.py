"""Long texts are searched with patterns only where a word of the pattern stands in them."""

import unicodedata

from pyspark.sql import functions as F

from gleanery.functions import text
from gleanery.operators import rules


def values(spark, texts, *uses):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [tuple(r)[1:] for r in df.select("i", *[u(F.col("t")) for u in uses]).orderBy("i").collect()]


def test_folding_with_few_and_many_characters(spark):
    many = "".join(chr(c) for c in range(0x20, 0x600))
    texts = ["Café … ﬁn ½", many, "中文 Ä \U0001f110 \U0001d400", "plain", None, ""]
    want = [(unicodedata.normalize("NFKD", t or "").encode("ascii", "ignore").decode().lower(),) for t in texts]
    assert values(spark, texts, text.fold) == want


def test_words_of_patterns(spark):
    samples = ["usa only", "only in canada", "must be based in europe", "authorized to work in the us", "not able to hire anyone outside of the us", "remote - germany", "we cannot hire in nepal", "nepal is not supported", "no signs"]
    found = lambda patterns: lambda c: rules.found(c, patterns)
    plain = lambda patterns: lambda c: F.coalesce(*[F.regexp_substr(c, F.lit(p)) for p in patterns])
    asked = dict(zip(rules.RESTRICTIONS, ([w] for w in rules.RESTRICTION_WORDS), strict=True)) | {p: ["nepal"] for p in rules.home_exclusions("nepal")}
    got = values(spark, samples, found(asked), plain(list(asked)))
    assert all(a == b for a, b in got) and [a is None for a, _ in got] == [False] * 8 + [True]


def test_terms_of_whole_texts(spark):
    terms = ["react native", "react", "next.js", "git", "github"]
    texts = ["react native and github", "digital reactor", "git next.js", "", None]
    pairs = [(lambda c, w=w, f=f: f(c, terms, whole=w)) for f in (text.first_term, text.hits) for w in (False, True)]
    for first, first_whole, hits, hits_whole in values(spark, texts, *pairs):
        assert first == first_whole and hits == hits_whole
