"""Materialised intermediate tables that survive the loss of any executor, rows told apart, names that are free."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.sources.stored import release, shared_root
from dossier.sources.stored import stored as durable

__all__ = ["durable", "fresh", "numbered", "release", "row_hash", "settle", "shared_root"]


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that no column of ``df`` has, whatever the case of its letters."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def numbered(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """A durable copy of ``df`` whose rows carry a number, and the name of its column.

    The numbers are written once, so that every later read tells the same rows apart by them.
    """
    row = fresh(df, "row")[0]
    return durable(df.withColumn(row, F.monotonically_increasing_id()), name), row


def row_hash(df: DataFrame) -> Column:
    """A 64-bit hash of a row of ``df``; columns that hold maps count by their JSON text."""
    kinds = df.schema
    return F.xxhash64(*[F.to_json(F.struct(c)) if "map<" in kinds[c].dataType.simpleString() else F.col(c) for c in df.columns])


def settle(spark: SparkSession) -> None:
    """Let the driver drop shuffle files of frames that are no longer referenced."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()
