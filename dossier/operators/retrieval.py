"""One entry to all ranking modes: the k best chunks with rank, score and the kind of score."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.operators import dense, lexical, postings

# The modes and what their scores are called.
MODES = {"bm25": "bm25", "dense": "cosine", "hybrid": "rrf"}
FUSED_DEPTH = 50


def retrieve(mode: str, k: int, chunks: DataFrame, questions: DataFrame | None = None, index: postings.Index | None = None, vectors: DataFrame | None = None, asked: DataFrame | None = None) -> DataFrame:
    """qid, chunk_id, rank, score, score_type and the other columns of ``chunks`` (chunk_id, ...).

    Lexical modes need ``questions`` (qid, tokens) and an ``index`` of the chunks;
    dense ones ``vectors`` (id, vector) and ``asked`` (qid, vector).
    """
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}")
    if isinstance(k, bool) or not isinstance(k, int) or k < 1:
        raise ValueError("k must be a positive integer")
    if mode != "dense" and (questions is None or index is None) or mode != "bm25" and (vectors is None or asked is None):
        raise ValueError(f"mode {mode} lacks an index or its questions")
    depth = k if mode != "hybrid" else max(k, FUSED_DEPTH)
    found = []
    if mode != "dense":
        found.append(postings.top_k(postings.ask(index, questions), depth).select("qid", "id", "score", "rank"))
    if mode != "bm25":
        found.append(dense.cosine_top(vectors, asked, depth).select("qid", "id", "score", "rank"))
    top = lexical.fuse_rankings(found, depth=depth) if mode == "hybrid" else found[0]
    best = top.where(F.col("rank") <= k).withColumnRenamed("id", "chunk_id").withColumn("score_type", F.lit(MODES[mode]))
    return best.join(chunks, "chunk_id")
