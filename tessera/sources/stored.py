"""Stored tables that merges are written back to: Parquet in buckets of the key, of which a batch rewrites those it touches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import IntegerType, StructType

from tessera.cluster import checkpointed
from tessera.operators import merge

BUCKETS = 64


class StoredTable:
    """Rows of one key, each in the folder ``bucket=N`` of its key's hash.

    A batch reads and rewrites only the buckets of its own keys, by dynamic partition overwrite of rows that were written
    down before, so no file is read while it is replaced.  A merge takes the newest stored row and the batch to a new row
    that depends on nothing else, so a batch that broke off between two buckets is simply run again.
    """

    def __init__(self, spark: SparkSession, folder: str, key: str, schema: StructType, buckets: int = BUCKETS):
        self.spark, self.folder, self.key, self.buckets = spark, folder, key, buckets
        self.schema = schema

    @classmethod
    def create(cls, rows: DataFrame, folder: str, key: str, buckets: int = BUCKETS) -> StoredTable:
        out = cls(rows.sparkSession, folder, key, rows.schema, buckets)
        out._write(rows)
        return out

    def _bucketed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("bucket", F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int"))

    def _write(self, rows: DataFrame) -> None:
        # a bucket is written by as many tasks as its size asks for
        dealt = self._bucketed(rows).hint("rebalance", "bucket").sortWithinPartitions("bucket", self.key)
        dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(self.folder)

    def _stored(self) -> DataFrame:
        return self.spark.read.schema(StructType([*self.schema.fields]).add("bucket", IntegerType())).parquet(self.folder)

    def read(self) -> DataFrame:
        return self._stored().drop("bucket")

    def upsert(self, drafts: DataFrame, hash_col: str, keep_if_blank: list[str]) -> dict[str, int]:
        """Merges drafts, of which each key has one, into the table; how many were new, updated and unchanged."""
        drafts = checkpointed(self._bucketed(drafts))
        touched = [r.bucket for r in drafts.select("bucket").distinct().collect()]  # at most all buckets
        if not touched:
            return {}
        current = self._stored().where(F.col("bucket").isin(touched)).drop("bucket")
        merged = checkpointed(merge.upsert(current, drafts.drop("bucket"), self.key, hash_col, keep_if_blank))
        counts = {r.outcome: r.n for r in merged.groupBy("outcome").agg(F.count("*").alias("n")).collect()}
        if counts.keys() - {"absent", "unchanged"}:
            self._write(merged.drop("outcome"))
        return {k: counts.get(k, 0) for k in ("new", "updated", "unchanged")}
