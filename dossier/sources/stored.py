"""Intermediate tables, written once and read back: they cut lineage and outlive any executor.

They lie in the folder that the cluster shares (``spark.checkpoint.dir``).  Only
a local master may run without that setting; it then gets a folder of its own.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL_ROOT: list[str] = []
_WRITTEN: list[tuple[SparkSession, str]] = []


def shared_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _LOCAL_ROOT:
        _LOCAL_ROOT.append("file://" + tempfile.mkdtemp(prefix="dossier-"))
    return _LOCAL_ROOT[0]


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and return a scan of what was written."""
    spark = df.sparkSession
    path = f"{shared_root(spark)}/dossier/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._dossier_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete tables made by :func:`stored` that no later result reads."""
    for t in tables:
        path = getattr(t, "_dossier_path", None)
        if path:
            _remove(t.sparkSession, path)
            _WRITTEN[:] = [w for w in _WRITTEN if w[1] != path]


@atexit.register
def _cleanup() -> None:
    for spark, path in _WRITTEN:
        try:
            if spark.sparkContext._jsc is not None:
                _remove(spark, path)
        except Exception:  # the JVM may be gone already; nothing is left to do then
            return
