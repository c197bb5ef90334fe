"""Runs a stream over what is there and gives the result as a table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from gleanery.session import scratch


def drain(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Processes all available input and returns what was written. The sink and the stream's checkpoint lie in
    the shared folder, so a lost executor or driver can resume. Each batch has a folder of its own, which a batch
    that is tried again replaces; `complete` keeps the last result only."""
    spark: SparkSession = stream.sparkSession
    base = f"{scratch(spark)}/stream-{uuid.uuid4().hex}"
    written = set()

    def write(batch: DataFrame, number: int) -> None:
        path = f"{base}/out/{'all' if mode == 'complete' else f'batch-{number}'}"
        batch.write.mode("overwrite").parquet(path)
        written.add(path)

    query = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(*sorted(written)) if written else spark.createDataFrame([], stream.schema)
