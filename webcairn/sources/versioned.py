"""A table of Parquet folders in hash buckets that changes only by rows of a manifest.

A commit writes its rows under a folder of its own and then, as one small file, the manifest rows that
name it; readers follow the manifest, so a commit is seen whole or not at all, and what a
failed attempt left behind is never read.  A commit has an id and happens once, however
often it is repeated.  One writer at a time; keys must not be null.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from webcairn.session import materialize

BUCKETS = 256
MANIFEST = "seq bigint, commit string, bucket int, folder string"


class VersionedTable:
    def __init__(self, spark: SparkSession, path: str, schema: StructType, keys: Sequence[str], buckets: int = BUCKETS):
        self.spark, self.path, self.schema, self.keys, self.buckets = spark, path, schema, list(keys), buckets
        spark.createDataFrame([], MANIFEST).write.mode("ignore").parquet(self._manifest)

    @property
    def _manifest(self) -> str:
        return f"{self.path}/manifest"

    def manifest(self) -> DataFrame:
        """One row per commit and bucket it replaced; a null bucket stands for added rows of any bucket."""
        return self.spark.read.schema(MANIFEST).parquet(self._manifest)

    def committed(self, commit: str) -> bool:
        return not self.manifest().where(F.col("commit") == commit).isEmpty()

    def _bucketed(self, rows: DataFrame) -> DataFrame:
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        return rows.select(*self.schema.names).withColumn("__bucket", bucket)

    def _write(self, rows: DataFrame, commit: str, replaced: list[int | None]) -> None:
        folder = f"{self.path}/data/{uuid.uuid4().hex}"
        rows.repartition("__bucket").write.partitionBy("__bucket").parquet(folder)
        seq = (self.manifest().agg(F.max("seq")).first()[0] or 0) + 1
        entries = self.spark.createDataFrame([(seq, commit, b, folder) for b in replaced], MANIFEST)
        entries.coalesce(1).write.mode("append").parquet(self._manifest)

    def read(self, buckets: Sequence[int] | None = None) -> DataFrame:
        """The rows as of the newest manifest, of all buckets or of some."""
        rows = self.manifest().where("seq IS NOT NULL")
        kept = rows.where("bucket >= 0").groupBy("bucket").agg(F.max_by("folder", "seq").alias("folder")).collect()
        paths = [f"{r.folder}/__bucket={r.bucket}" for r in kept if buckets is None or r.bucket in set(buckets)]
        out = self.spark.createDataFrame([], self.schema)
        if paths:
            out = self.spark.read.schema(self.schema).parquet(*paths)
        for r in rows.where("bucket IS NULL").select("folder").collect():
            added = self.spark.read.schema(self.schema).parquet(r.folder)
            if buckets is not None:
                added = added.where(F.col("__bucket").isin(list(buckets)))
            out = out.unionByName(added.select(*self.schema.names))
        return out

    def append(self, rows: DataFrame, commit: str) -> bool:
        """Add rows; false when the commit is there already."""
        if self.committed(commit):
            return False
        self._write(self._bucketed(rows), commit, [None])
        return True

    def merge(self, rows: DataFrame, commit: str) -> bool:
        """Put rows (one per key) in place of those with their keys; only buckets of such keys are written.

        Not for tables that also get added rows.
        """
        if self.committed(commit):
            return False
        rows = materialize(self._bucketed(rows))
        # at most as many numbers as there are buckets
        touched = [r[0] for r in rows.select("__bucket").distinct().collect()]
        old = self._bucketed(self.read(touched)).join(rows.select(*self.keys), self.keys, "left_anti")
        self._write(old.unionByName(rows), commit, touched or [-1])
        return True
