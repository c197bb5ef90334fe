"""A stored table that merges rewrite in part: partitions by key, versions by manifest.

Rows lie in partitions by a hash of their key, each partition in one folder. A change writes the partitions that it
touches to new folders and then a manifest, one small file that names the folder of each partition; it holds from the
moment this file is there. So a reader sees the table before a change or after it, a change that fails leaves
nothing that is read, and files of untouched partitions stay as they are. A manifest also names its batch: a batch that comes
again, as streams may send it, changes nothing. One writer at a time.

Keys are null for no row. A table without a manifest is empty; so is a partition without a folder.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gleanery.session import written

col = F.col
MANIFEST = "version long, batch string, partition int, folder string"


class Store:
    """`parts` is a bound of what a manifest lists and the driver reads; a partition should fit a few tasks."""

    def __init__(self, spark: SparkSession, path: str, key: str, schema: StructType, parts: int = 64):
        self.spark, self.path, self.key, self.schema, self.parts = spark, path.rstrip("/"), key, schema, parts

    def partition(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.parts)).cast("int")

    def manifests(self) -> DataFrame:
        try:
            return self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifest")
        except AnalysisException:
            return self.spark.createDataFrame([], MANIFEST)

    def state(self) -> tuple[int, dict[int, str]]:
        """The last version, and the folder of each partition that has rows."""
        rows = self.manifests()
        last = rows.agg(F.max("version")).first()[0] or 0
        return last, {r.partition: r.folder for r in rows.where((col("version") == last) & col("folder").isNotNull()).collect()}

    def read(self, parts: list[int] | None = None) -> DataFrame:
        """The table, or those partitions of it."""
        _, folders = self.state()
        named = [f for p, f in sorted(folders.items()) if parts is None or p in parts]
        return self.spark.read.schema(self.schema).parquet(*named) if named else self.spark.createDataFrame([], self.schema)

    def has_batch(self, batch: str) -> bool:
        return not self.manifests().where(col("batch") == batch).isEmpty()

    def change(self, batch: str, keys: DataFrame, how: Callable[[DataFrame], DataFrame]) -> bool:
        """Replaces the partitions of the keys by how(their rows); False if the batch was applied before.

        how may use rows of these partitions alone, and give rows of them alone."""
        if self.has_batch(batch):
            return False
        last, folders = self.state()
        parts = sorted(r[0] for r in keys.select(self.partition(col(self.key)).alias("p")).distinct().collect())
        version = f"{self.path}/data/{last + 1}-{uuid.uuid4().hex}"
        new = how(self.read(parts)).select(*self.schema.names).withColumn("_part", self.partition(col(self.key)))
        new.repartition(max(1, len(parts)), "_part").write.partitionBy("_part").parquet(version)
        has = {r[0] for r in self.spark.read.parquet(version).select("_part").distinct().collect()} if parts and not self._empty(version) else set()
        folders = {p: f for p, f in folders.items() if p not in parts} | {p: f"{version}/_part={p}" for p in has}
        rows = [(last + 1, batch, p, folders.get(p)) for p in range(self.parts)]
        self.spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")
        return True

    def _empty(self, folder: str) -> bool:
        """Whether a written folder has no rows (and so no files that tell a schema)."""
        try:
            return self.spark.read.parquet(folder).isEmpty()
        except AnalysisException:
            return True

    def upsert(self, rows: DataFrame, batch: str) -> bool:
        """Rows replace those with their key, others are added."""
        rows = written(rows.select(*self.schema.names), "upsert")
        return self.change(batch, rows, lambda old: old.join(rows.select(self.key), self.key, "left_anti").unionByName(rows))

    def remove(self, keys: DataFrame, batch: str) -> bool:
        keys = written(keys.select(self.key).distinct(), "remove")
        return self.change(batch, keys, lambda old: old.join(keys, self.key, "left_anti"))
