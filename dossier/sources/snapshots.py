"""Tables as versioned folders behind a manifest.

A version is a folder of Parquet files and a small JSON manifest that names it.
The manifest is written beside its place and renamed into it without overwriting:
readers see the old version or the whole new one, and of two writers that start
from one version the later one fails.  Rows leave a table by a version without
them; folders that no kept manifest names are deleted afterwards.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Conflict(Exception):
    """Another writer has published the next version."""


def _files(spark: SparkSession, root: str):
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(root)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


def versions(spark: SparkSession, root: str) -> list[int]:
    """Published versions, oldest first."""
    fs, path = _files(spark, root)
    folder = path(f"{root}/manifests")
    if not fs.exists(folder):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(folder)]
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith("."))


def manifest(spark: SparkSession, root: str, version: int | None = None) -> dict | None:
    """The manifest of a version, the newest by default; None for a table without one."""
    known = versions(spark, root)
    if not known:
        return None
    version = known[-1] if version is None else version
    return json.loads(spark.read.text(f"{root}/manifests/{version:012d}.json", wholetext=True).first()[0])


def read(spark: SparkSession, root: str, version: int | None = None) -> DataFrame | None:
    """The rows of a version; later ones do not change what this frame reads until its folder is vacuumed."""
    m = manifest(spark, root, version)
    return None if m is None else spark.read.schema(m["schema"]).parquet(f"{root}/{m['folder']}")


def publish(df: DataFrame, root: str, partition_by: tuple[str, ...] = (), parent: int | None = None) -> int:
    """Write ``df`` as the next version.  ``parent``: the version it was made from, if it must still be the newest."""
    spark = df.sparkSession
    known = versions(spark, root)
    last = known[-1] if known else 0
    if parent is not None and parent != last:
        raise Conflict(f"version {last} follows {parent}")
    folder = f"data/{uuid.uuid4().hex}"
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    writer.parquet(f"{root}/{folder}")
    fs, path = _files(spark, root)
    jvm = spark.sparkContext._jvm
    body = json.dumps({"version": last + 1, "parent": last, "folder": folder, "schema": _ddl(df, partition_by)})
    draft, final = path(f"{root}/manifests/.{uuid.uuid4().hex}"), path(f"{root}/manifests/{last + 1:012d}.json")
    out = fs.create(draft, True)
    out.write(bytearray(body.encode()))
    out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    none = spark.sparkContext._gateway.new_array(getattr(jvm, "org.apache.hadoop.fs.Options$Rename"), 0)
    try:
        context.rename(draft, final, none)
    except Exception as e:
        fs.delete(draft, False)
        fs.delete(path(f"{root}/{folder}"), True)
        if "FileAlreadyExists" in str(e):
            raise Conflict(f"version {last + 1} is there already") from None
        raise
    return last + 1


def _ddl(df: DataFrame, last: tuple[str, ...]) -> str:
    own = [c for c in df.columns if c not in last] + list(last)
    return ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in own)


def upsert(new: DataFrame, root: str, key: list[str], partition_by: tuple[str, ...] = ()) -> int:
    """The next version: rows of ``new``, and the old rows whose key it does not have."""
    old, last = read(new.sparkSession, root), manifest(new.sparkSession, root)
    if old is None:
        return publish(new, root, partition_by, 0)
    kept = old.join(new.select(*key).distinct(), key, "left_anti")
    return publish(kept.unionByName(new, allowMissingColumns=True), root, partition_by, last["version"])


def replace(new: DataFrame, root: str, key: str, partition_by: tuple[str, ...] = ()) -> tuple[int, DataFrame]:
    """The next version holds ``new`` alone; (its number, the keys that the old version had and it has not)."""
    spark = new.sparkSession
    before = read(spark, root)
    version = publish(new, root, partition_by)
    now = read(spark, root, version)
    gone = now.select(key).limit(0) if before is None else before.select(key).distinct().join(now.select(key), key, "left_anti")
    return version, gone


def delete(spark: SparkSession, root: str, keys: DataFrame, key: list[str], partition_by: tuple[str, ...] = ()) -> int:
    """The next version, without the rows of ``keys``."""
    last = manifest(spark, root)
    if last is None:
        raise ValueError("there is no table")
    return publish(read(spark, root).join(keys.select(*key).distinct(), key, "left_anti"), root, partition_by, last["version"])


def vacuum(spark: SparkSession, root: str, keep: int = 1) -> int:
    """Delete all but the newest ``keep`` versions, and folders that none of them names; the number of folders deleted."""
    if keep < 1:
        raise ValueError("one version must stay")
    fs, path = _files(spark, root)
    known = versions(spark, root)
    named = {manifest(spark, root, v)["folder"].split("/")[1] for v in known[-keep:]}
    for v in known[:-keep]:
        fs.delete(path(f"{root}/manifests/{v:012d}.json"), False)
    folder = path(f"{root}/data")
    lost = [s.getPath() for s in (fs.listStatus(folder) if fs.exists(folder) else []) if s.getPath().getName() not in named]
    for p in lost:
        fs.delete(p, True)
    return len(lost)


def history(spark: SparkSession, root: str) -> DataFrame:
    """version, parent, folder of every version that is kept."""
    rows = [(m["version"], m["parent"], m["folder"]) for m in (manifest(spark, root, v) for v in versions(spark, root))]
    return spark.createDataFrame(rows, "version long, parent long, folder string").orderBy(F.col("version"))
