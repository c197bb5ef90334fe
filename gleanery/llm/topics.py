"""Topics of documents: clusters of their words, fitted on all of them.

Words (runs of other characters than white space, in lower case) are hashed to WIDTH counts, weighed by inverse
document frequency and scaled to length 1; k-means finds TOPICS centres among all rows with words. A copy counts
as a row, as its tokens do in the mix. The hashed counts are written once, and the frequencies and rounds work on
that table. Every document takes the nearest centre. Spark's own feature transformers and k-means do the work
inside executors; the model is TOPICS x WIDTH numbers.

Null texts and texts without words have the topic NONE. Empty tables give empty results. Repeated rows and
rows with an equal text have the same topic. Other columns are kept; their names may clash.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import IDF, HashingTF, Normalizer, RegexTokenizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.llm.common import cut, fresh

TOPICS = 16
WIDTH = 1024
NONE = "none"
PARTS = ("words", "counts", "weighed", "scaled", "topic")


def fit(docs: DataFrame, topics: int = TOPICS, seed: int = 3) -> tuple[PipelineModel | None, list[str]]:
    """The model fitted on all rows, None if no text has words, and the names of its columns."""
    names = [fresh(docs, f"_topic_{x}") for x in PARTS]
    words, counts, weighed, scaled, topic = names
    hashing = [
        RegexTokenizer(inputCol="text", outputCol=words, pattern=r"\s+", toLowercase=True),
        HashingTF(inputCol=words, outputCol=counts, numFeatures=WIDTH),
    ]
    hashed = cut(PipelineModel(hashing).transform(docs.where(r"text rlike '\\S'").select("text")).select(counts), "topic_counts")
    found = hashed.count()
    if not found:
        return None, names
    clusters = [
        IDF(inputCol=counts, outputCol=weighed),
        Normalizer(inputCol=weighed, outputCol=scaled),
        KMeans(featuresCol=scaled, predictionCol=topic, k=max(2, min(topics, found)), seed=seed, maxIter=15),
    ]
    return PipelineModel([*hashing, *Pipeline(stages=clusters).fit(hashed).stages]), names


def assign(docs: DataFrame, name: str, topics: int = TOPICS) -> DataFrame:
    """docs with the topic under the given name: `t0`, `t1`, ... or NONE."""
    model, names = fit(docs, topics)
    if model is None:
        return docs.withColumn(name, F.lit(NONE))
    null = fresh(docs, "_topic_null")  # a null text comes back as null
    rows = model.transform(docs.withColumns({null: F.col("text").isNull(), "text": F.coalesce("text", F.lit(""))}))
    found = F.when(F.col("text").rlike(r"\S"), F.concat(F.lit("t"), F.col(names[-1]))).otherwise(NONE)
    rows = rows.withColumn(name, found).withColumn("text", F.when(~F.col(null), F.col("text")))
    return rows.select(*docs.columns, name)
