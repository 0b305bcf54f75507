"""Connected components by alternating large-star and small-star rounds.

Blocks of at most ``BLOCK`` edges first shrink to spanning forests of their own;
the rounds then join the forests.  Each round rewrites the edge table with two
grouped minima and joins; a node with very many edges only meets a grouped
minimum (combined before the shuffle) and an equi-join that adaptive execution
can split.  No table is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.llm.durable import durable, release


BLOCK = 500_000


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star round over edges (a, b) with a > b."""
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges
    low = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    joined = both.join(low.withColumnRenamed("a", "n"), F.col("a") == F.col("n")).drop("n")
    if large:  # link every larger neighbour to the minimum
        out = joined.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:  # link the node and all its smaller neighbours to the minimum
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
    return out.where(F.col("a") > F.col("b")).distinct()


def _is_star(edges: DataFrame) -> bool:
    """Whether every node has one parent and no parent has one."""
    several = edges.groupBy("a").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    chained = edges.select(F.col("b").alias("p")).join(edges.select(F.col("a").alias("p")), "p", "left_semi")
    return several.isEmpty() and chained.isEmpty()


def _local_forest(batches):
    """Star forest of a block's edges: every node with the smallest id it reaches."""
    import pyarrow as pa

    up: dict[int, int] = {}

    def root(x):
        while (p := up.get(x, x)) != x:
            up[x] = up.get(p, p)
            x = p
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = root(a), root(b)
            if a != b:
                up[max(a, b)] = min(a, b)
    nodes = list(up)
    for at in range(0, len(nodes), 1 << 16):
        part = nodes[at : at + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([root(x) for x in part], pa.int64())], names=["a", "b"])


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b: long); component is the smallest id reachable."""
    edges = links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    blocks = 1 + edges.count() // BLOCK
    now = durable(edges.coalesce(blocks).mapInArrow(_local_forest, "a long, b long"), "links")
    while not _is_star(now):
        new = durable(_star(_star(now, True), False), "links")
        release(now)
        now = new
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
