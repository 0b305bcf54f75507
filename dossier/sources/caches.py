"""Caches of computed values as bucketed tables that keep themselves up.

A row has the key of everything its value depends on, the value, a checksum and
the time it was made.  The table is bucketed by the key, so that a lookup moves the
asked keys only.  A row whose checksum does not fit is no hit; its value is made
anew and the new row stands beside it.  Misses are computed, appended in one job
and then read back like all others.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dossier.sources.stored import release, stored


class CacheTable:
    """A cache at ``path`` for values of the SQL type ``kind``, under a name in the session's catalog."""

    def __init__(self, spark: SparkSession, name: str, path: str, kind: str, buckets: int = 16):
        self.spark, self.name, self.kind = spark, name, kind
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {name} (key STRING, value {kind}, checksum BIGINT, made DOUBLE) USING parquet "
            f"CLUSTERED BY (key) SORTED BY (key) INTO {buckets} BUCKETS LOCATION '{path}'")

    def rows(self) -> DataFrame:
        """Sound rows, the newest one of each key."""
        newest = Window.partitionBy("key").orderBy(F.desc("made"), "checksum")  # on the buckets: no shuffle
        return self._sound().withColumn("place", F.row_number().over(newest)).where("place = 1").select("key", "value")

    def _sound(self) -> DataFrame:
        return self.spark.table(self.name).where(F.col("value").isNotNull() & (F.col("checksum") == F.xxhash64("key", "value")))

    def damaged(self) -> DataFrame:
        """Keys without a sound row."""
        return self.spark.table(self.name).select("key").distinct().join(self._sound().select("key"), "key", "left_anti")

    def put(self, rows: DataFrame) -> None:
        """Append (key, value)."""
        value = F.col("value").cast(self.kind)
        made = rows.select("key", value.alias("value"), F.xxhash64("key", value).alias("checksum"), F.lit(time.time()).alias("made"))
        made.write.insertInto(self.name)
        self.spark.catalog.refreshTable(self.name)

    def fill(self, asked: DataFrame, compute: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, int]:
        """``asked`` (key and other columns) with value, and how many keys were computed.

        ``compute`` gets the rows of the missing keys, one each, and returns key and value; what it returns is written.
        """
        first = Window.partitionBy("key").orderBy(*[c for c in asked.columns if c != "key"] or ["key"])
        missing = asked.join(self.rows().select("key"), "key", "left_anti").withColumn("place", F.row_number().over(first)).where("place = 1").drop("place")
        many = missing.count()
        if many:
            self.put(compute(missing))
        return asked.join(self.rows(), "key", "left"), many

    def forget(self, keys: DataFrame) -> None:
        """Write the table anew without the rows of some keys."""
        kept = stored(self.spark.table(self.name).join(keys.select("key").distinct(), "key", "left_anti").select("key", "value", "checksum", "made"), "cache-kept")
        kept.write.insertInto(self.name, overwrite=True)  # a table cannot be overwritten by a plan that reads it
        self.spark.catalog.refreshTable(self.name)
        release(kept)
