"""Files in and out: binary and JSON scans, idempotent writes, integrity manifests, stale rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from dossier.functions.canonical import row_digest
from dossier.functions.ids import record_digest
from dossier.sources import snapshots


def read_binary(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, length, content, sha256."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.select("path", "length", "content", F.sha2("content", 256).alias("sha256"))


def read_json(spark: SparkSession, path: str, schema: StructType | str, pattern: str = "*.json") -> DataFrame:
    """One row per (multi-line) JSON file, with a fixed schema."""
    return spark.read.schema(schema).option("multiLine", "true").option("pathGlobFilter", pattern).json(path)


def spread(df: DataFrame, most_bytes: int = 64 << 20) -> DataFrame:
    """``df``, dealt to all cores where it is a small scan of fewer files than those.

    A small file is one row group, which one task reads; what follows would run in
    that task alone.  Larger tables have row groups enough and stay as they are.
    """
    if int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) > most_bytes:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def frame_sha256(df: DataFrame) -> str:
    """Order-free content hash of a frame: the sum and XOR of its row hashes, and its size."""
    h = F.xxhash64(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}))
    r = df.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(h).alias("x"), F.sum(h.cast("decimal(38,0)")).alias("s")).first()
    import hashlib

    return hashlib.sha256(f"{r.n}:{r.x}:{r.s}".encode()).hexdigest()


def write_once(df: DataFrame, root: str, name: str, file_format: str = "parquet") -> str:
    """Write under a folder named by the content; the same content is not written twice.

    Spark commits a job's files together and leaves _SUCCESS last, so a folder
    with it is whole.
    """
    spark = df.sparkSession
    path = f"{root.rstrip('/')}/{name}-{frame_sha256(df)[:16]}"
    jvm = spark.sparkContext._jvm
    done = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    fs = done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(done):
        df.write.mode("overwrite").format(file_format).save(path)
    return path


def write_vectors(df: DataFrame, root: str, name: str) -> str:
    """Vectors (id, vector) as float arrays in Parquet."""
    return write_once(df.select("id", F.col("vector").cast("array<float>").alias("vector")), root, name)


def retain_payloads(payloads: DataFrame, root: str) -> DataFrame:
    """Keep raw payloads (ticker, json) under their own hash before anything is derived from them; ticker, sha256.

    A payload that is there already is not written again.  Payloads are stored whole, as a column, and dealt
    by the head of their hash.
    """
    spark = payloads.sparkSession
    named = payloads.select("ticker", "json", F.sha2("json", 256).alias("sha256")).where("json is not null")
    new = named.dropDuplicates(["ticker", "sha256"])
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    if target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
        new = new.join(spark.read.parquet(root).select("ticker", "sha256"), ["ticker", "sha256"], "left_anti")
    new.withColumn("head", F.substring("sha256", 1, 2)).repartition("head").write.mode("append").partitionBy("head").parquet(root)
    return named.select("ticker", "sha256").distinct()


def kept_payloads(spark: SparkSession, root: str) -> DataFrame:
    """ticker, sha256, json of all retained payloads, and whether the text still has its hash."""
    return spark.read.parquet(root).select("ticker", "sha256", "json", (F.sha2("json", 256) == F.col("sha256")).alias("whole"))


def manifest_differences(found: DataFrame, manifest: DataFrame) -> DataFrame:
    """path, problem (missing, unexpected, changed) of ``found`` (path, sha256) against a manifest."""
    m = found.select("path", F.col("sha256").alias("f")).join(manifest.select("path", F.col("sha256").alias("w")), "path", "full_outer")
    problem = F.when(F.col("f").isNull(), "missing").when(F.col("w").isNull(), "unexpected").when(F.col("f") != F.col("w"), "changed")
    return m.withColumn("problem", problem).where("problem is not null").select("path", "problem")


def stale_ids(old: DataFrame, new: DataFrame, key: str = "trace_id") -> DataFrame:
    """Ids of a stored set that a new set does not have."""
    return old.select(key).distinct().join(new.select(key).distinct(), key, "left_anti")


def save_traces(traces: DataFrame, path: str) -> DataFrame:
    """Replace the stored traces, partitioned by source kind, by a new version; the trace ids that went."""
    return snapshots.replace(traces, path, "trace_id", ("source_kind",))[1]


def load_trace(spark: SparkSession, path: str, trace_id: str) -> DataFrame:
    stored = snapshots.read(spark, path)
    return spark.createDataFrame([], "trace_id string") if stored is None else stored.where(F.col("trace_id") == trace_id)


def chunk_violations(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """chunk_id, rule: chunks that do not fit their documents (slice, offsets, order, repeated ids)."""
    d = documents.select("document_id", F.col("text").alias("whole"))
    m = chunks.join(d, "document_id", "left")
    part = F.substring(F.col("whole"), F.col("start_char") + 1, F.col("end_char") - F.col("start_char"))
    rules = F.array_compact(F.array(
        F.when(F.col("whole").isNull(), "unknown_document"), F.when(F.col("whole").isNotNull() & (part != F.col("text")), "slice"),
        F.when(F.col("end_char") - F.col("start_char") != F.length("text"), "offsets"),
    ))
    own = m.select("chunk_id", F.explode(rules).alias("rule"))
    twice = chunks.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("chunk_id", F.lit("repeated_id").alias("rule"))
    bare = documents.where(F.length("text") > 0).join(chunks.select("document_id").distinct(), "document_id", "left_anti")
    return own.unionByName(twice).unionByName(bare.select(F.col("document_id").cast("string").alias("chunk_id"), F.lit("uncovered_document").alias("rule")))


def validate_chunks(chunks: DataFrame, documents: DataFrame, manifest: dict, provenance: tuple[str, ...] = ()) -> DataFrame:
    """chunk_id, rule: every stored chunk that does not fit its manifest and its parsed document.

    ``chunks``: the columns of ``chunking.chunk_documents`` with parsed_document_sha256, version, experiment_id and
    strategy; ``documents``: document_id, text and the columns that the digest covers; ``manifest``: version,
    experiment_id, strategy, digest (names of those columns) and total_chunks.
    """
    parsed = documents.withColumn("parsed_now", row_digest(documents, *manifest["digest"]))
    own = [c for c in ("sections",) if c in documents.columns]
    d = parsed.select("document_id", F.col("text").alias("whole"), "parsed_now", *[F.col(c).alias(f"d_{c}") for c in (*provenance, *own)])
    m = chunks.join(d, "document_id", "left")
    c = F.col
    known, start, end = c("whole").isNotNull(), c("start_char"), c("end_char")
    identity = record_digest(
        {k: c(k).cast("string") for k in ("version", "experiment_id", "parsed_document_sha256", "document_id")}, {k: c(k) for k in ("chunk_index", "start_char", "end_char")})
    rules = {
        "unknown_document": known, "experiment": (c("experiment_id") == manifest["experiment_id"]) & (c("version") == manifest["version"]), "strategy": c("strategy") == manifest["strategy"],
        "parsed_document": ~known | (c("parsed_document_sha256") == c("parsed_now")), "offsets": ~known | ((start >= 0) & (start < end) & (end <= F.length("whole"))),
        "slice": ~known | (F.substring(c("whole"), start + 1, end - start) == c("text")), "chunk_id": c("chunk_id") == identity,
    }
    rules |= {f"provenance:{p}": ~known | c(p).eqNullSafe(c(f"d_{p}")) for p in provenance}
    if own and "sections" in chunks.columns:
        met = F.transform(F.filter("d_sections", lambda s: (s["start_char"] < end) & (s["end_char"] > start)), lambda s: s["section_id"])
        has = F.transform("sections", lambda s: s["section_id"])
        rules["sections"] = ~known | (F.size(F.array_except(met, has)) + F.size(F.array_except(has, met)) == 0)
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(n)) for n, ok in rules.items()]))
    found = m.select("chunk_id", F.explode(broken).alias("rule"))
    twice = chunks.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("chunk_id", F.lit("repeated_id").alias("rule"))
    bare = documents.where(F.length("text") > 0).join(chunks.select("document_id").distinct(), "document_id", "left_anti").select(c("document_id").cast("string").alias("chunk_id"), F.lit("uncovered_document").alias("rule"))
    count = chunks.agg(F.count(F.lit(1)).alias("n")).where(c("n") != manifest["total_chunks"]).select(F.lit("*").alias("chunk_id"), F.lit("total_chunks").alias("rule"))
    return found.unionByName(twice).unionByName(bare).unionByName(count)
