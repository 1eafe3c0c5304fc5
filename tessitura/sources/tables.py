"""Tables that are changed: versions by key bucket, committed by one small file.

A version's rows lie in folders by a hash of their key. A merge reads and writes only the buckets in which a key has changed, under the new
version's number, and then writes a manifest: which version holds each bucket. A reader takes the newest manifest; Spark's writer shows a
file only once it is whole, so a merge that fails or is killed changes nothing, and older versions stay readable. There is one
writer at a time. A manifest is as large as the number of buckets, which is fixed when the table is made; no rows reach the driver.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class KeyedTable:
    """A table below a folder that all executors share; key: a column that no two rows share."""

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str, buckets: int = 64):
        self.spark, self.path, self.schema, self.key, self.buckets = spark, path, schema, key, buckets

    def _manifests(self) -> DataFrame:
        try:
            rows = self.spark.read.schema("value string").text(f"{self.path}/manifests/*")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            rows = self.spark.createDataFrame([], "value string")
        return rows.select(F.from_json("value", "version int, held map<string,int>").alias("m")).select("m.*")

    def manifest(self, version: int | None = None) -> tuple[int, dict[int, int]]:
        """The newest version, or a given one, and which version holds each bucket; 0 and none for a table that isn't there."""
        rows = self._manifests() if version is None else self._manifests().filter(F.col("version") == version)
        last = rows.orderBy(F.desc("version")).limit(1).collect()
        return (last[0]["version"], {int(b): v for b, v in (last[0]["held"] or {}).items()}) if last else (0, {})

    def _of(self, held: dict[int, int], buckets: list[int]) -> DataFrame:
        paths = [f"{self.path}/rows/version={held[b]}/bucket={b}" for b in buckets if b in held]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def read(self, version: int | None = None) -> DataFrame:
        held = self.manifest(version)[1]
        return self._of(held, sorted(held))

    def merge(self, changes: DataFrame, change: Callable[[DataFrame, DataFrame], DataFrame]) -> int:
        """change: the rows of the touched buckets and the changes, which have the key too, to the rows that stand there afterwards. The new
        version's number; without changes the old one."""
        version, held = self.manifest()
        own = F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")
        touched = sorted(r[0] for r in changes.select(own).distinct().collect())
        if not touched:
            return version
        new = version + 1
        rows = change(self._of(held, touched), changes).select(*(F.col(f.name) for f in self.spark.createDataFrame([], self.schema).schema))
        rows = rows.withColumn("bucket", own).repartition("bucket")
        rows.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/rows/version={new}")
        try:
            filled = {r[0] for r in self.spark.read.parquet(f"{self.path}/rows/version={new}").select("bucket").distinct().collect()}
        except AnalysisException:  # nothing is left in any of them
            filled = set()
        after = {b: v for b, v in held.items() if b not in touched} | dict.fromkeys(filled, new)
        text = json.dumps({"version": new, "held": {str(b): v for b, v in sorted(after.items())}})
        self.spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.path}/manifests/{new}")
        return new

    def upsert(self, rows: DataFrame) -> int:
        """Rows of the table's schema in place of those with their keys."""
        return self.merge(rows, lambda old, new: old.join(new.select(self.key), self.key, "left_anti").unionByName(new))

    def delete(self, keys: DataFrame) -> int:
        return self.merge(keys.select(self.key).distinct(), lambda old, gone: old.join(gone, self.key, "left_anti"))

    def patch(self, patches: DataFrame) -> int:
        """patches: the key and some columns; values that aren't null take the place of the row's, others stay. Keys that aren't there are passed over."""
        columns = [c for c in patches.columns if c != self.key]

        def change(old: DataFrame, new: DataFrame) -> DataFrame:
            both = old.join(new.select(self.key, *(F.col(c).alias(f"_{c}") for c in columns)), self.key, "left")
            return both.withColumns({c: F.coalesce(f"_{c}", c) for c in columns}).drop(*(f"_{c}" for c in columns))

        return self.merge(patches, change)
