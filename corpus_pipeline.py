"""A corpus pipeline of five stages; each is one of the operators of dossier.llm.

Every stage takes (spark, docs, sf_dir), works on all rows its predecessor
kept, and returns a frame that :func:`run` writes as Parquet and reads again.
All but the last return the columns of documents.

Each stage takes null ids, null and empty texts, repeated rows, repeated ids and
extra columns of any name, keeps the columns it gets, and gives an empty table
for an empty one.

SQL cannot express the chain (a trained classifier, a latent index and a
knapsack), so ORACLE_SQL is None and tests check each stage against a plain
version on small inputs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.llm import decontaminate, jaccard_join, mixing, quality, sharding
from dossier.llm.durable import durable, numbered

ORACLE_SQL = None
#: Numbers of leaked rows are sent to the tasks up to this many, a few MB.
MOST_ROWS_SENT = 200_000


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps; every row is judged by itself."""
    scored = quality.score_documents(docs, _table(spark, sf_dir, "labels"))
    return scored.where("kept").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group: the one with the smallest doc_id, a null one last.

    Rows are told apart by a written number, so different texts of one doc_id
    and texts without a doc_id are documents like all others.  Rows without a
    word are linked with nothing and stay.
    """
    rows, row = numbered(docs, "stage-rows")
    linked = jaccard_join.link_documents(rows.select(F.col(row).alias("doc_id"), "text"), count_links=False)
    named = rows.select(F.col(row).alias("r"), F.col("doc_id").alias("d"), F.xxhash64(*docs.columns).alias("h"))
    met = linked.select(F.col("doc_id").alias("r"), "component_id").join(named, "r")
    first = met.groupBy("component_id").agg(F.min(F.struct(F.col("d").isNull().alias("n"), "d", "h", "r")).alias("least"))
    return rows.join(first.select(F.col("least.r").alias(row)), row, "left_semi").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text holds no benchmark item; every row is judged by itself."""
    rows, row = numbered(docs, "stage-rows")
    leaks = decontaminate.find_leaks(rows.select(F.col(row).alias("doc_id"), "text"), _table(spark, sf_dir, "benchmark"))
    bad = durable(leaks.where("contaminated").select(F.col("doc_id").alias(row)), "leaked")
    if bad.count() <= MOST_ROWS_SENT:  # else a shuffled join
        bad = F.broadcast(bad)
    return rows.join(bad, row, "left_anti").select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that the mix takes, each as often as it takes them; null sources are a source."""
    return mixing.apply_mix(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows with their shard."""
    return sharding.assign_shards(docs)


STAGES = [
    ("quality classifier", classify),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing sources", mix),
    ("sharding", shard),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = _table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = durable(stage(spark, docs, sf_dir), f"stage-{k}")
    return docs
