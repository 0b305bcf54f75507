"""Reranking of bounded candidate pools, its cache, and what it changes."""

from __future__ import annotations

from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dossier.functions.text import answer_tokens


class PairScorer(Protocol):
    """Scores (question, passage) pairs; ``signature`` names the model."""

    signature: str

    def score(self, questions: list[str], passages: list[str]) -> list[float]: ...


def pool(ranked: DataFrame, depth: int) -> DataFrame:
    """The first ``depth`` candidates of every (system, question)."""
    if isinstance(depth, bool) or not isinstance(depth, int) or depth < 1:
        raise ValueError("depth must be a positive integer")
    return ranked.where(F.col("rank") <= depth)


def pairs_to_score(pools: DataFrame) -> DataFrame:
    """Distinct (qid, chunk_id) over all pools, so a shared pair is scored once."""
    return pools.select("qid", "chunk_id").dropDuplicates()


def _counted(texts: DataFrame, key: str, text: str) -> DataFrame:
    """key, token, times, size: every text is read once."""
    tokens = texts.select(key, answer_tokens(F.col(text)).alias("tokens")).withColumn("size", F.size("tokens"))
    return tokens.select(key, "size", F.explode("tokens").alias("token")).groupBy(key, "token").agg(F.count(F.lit(1)).alias("times"), F.first("size").alias("size"))


def overlap_scores(pairs: DataFrame, questions: DataFrame, passages: DataFrame) -> DataFrame:
    """``pairs`` (qid, chunk_id) plus score, the offline scorer: overlap F1 of answer tokens.

    ``questions``: qid, question; ``passages``: chunk_id, text.  Texts meet by
    counts of their tokens, so the work follows their lengths, not the products.
    """
    own = pairs.select("qid", "chunk_id").distinct()
    asked = _counted(questions, "qid", "question").select("qid", "token", F.col("times").alias("asked"), F.col("size").alias("q_size"))
    read = _counted(passages.join(own.select("chunk_id").distinct(), "chunk_id", "left_semi"), "chunk_id", "text")
    met = own.join(asked, "qid").join(read, ["chunk_id", "token"]).groupBy("qid", "chunk_id").agg(
        F.sum(F.least("asked", "times")).alias("common"), (F.first("q_size") + F.first("size")).alias("both"))
    score = F.coalesce(F.round(2.0 * F.col("common") / F.col("both"), 6), F.lit(0.0))
    return own.join(met, ["qid", "chunk_id"], "left").select("qid", "chunk_id", score.alias("score"))


def model_scores(pairs: DataFrame, scorer: PairScorer) -> DataFrame:
    """``pairs`` (qid, chunk_id, question, text) plus score, one model load per worker."""

    def run(batches):
        for pdf in batches:
            got = scorer.score(pdf["question"].tolist(), pdf["text"].tolist())
            if len(got) != len(pdf):
                raise ValueError("the scorer returned another number of scores")
            yield pd.DataFrame({"qid": pdf["qid"], "chunk_id": pdf["chunk_id"], "score": got})

    kinds = dict(pairs.dtypes)
    return pairs.select("qid", "chunk_id", "question", "text").mapInPandas(run, f"qid {kinds['qid']}, chunk_id {kinds['chunk_id']}, score double")


def cached_scores(pairs: DataFrame, cache: DataFrame, scorer: PairScorer) -> DataFrame:
    """Scores from ``cache`` (key, score) where question, passage and model agree, else from the scorer."""
    key = F.sha2(F.concat_ws("\u0001", F.lit(scorer.signature), "question", F.col("chunk_id").cast("string"), F.sha2("text", 256)), 256)
    keyed = pairs.withColumn("key", key)
    sound = cache.where("score is not null and not isnan(score)").select("key", "score")
    hit = keyed.join(sound, "key").select("qid", "chunk_id", "score")
    return hit.unionByName(model_scores(keyed.join(sound.select("key"), "key", "left_anti"), scorer))


def reorder(candidates: DataFrame, scores: DataFrame) -> DataFrame:
    """system, qid, chunk_id, old_rank, score, rank: by score, then chunk_id."""
    met = candidates.select("system", "qid", "chunk_id", F.col("rank").alias("old_rank")).join(scores, ["qid", "chunk_id"])
    w = Window.partitionBy("system", "qid").orderBy(F.desc("score"), "chunk_id")
    return met.withColumn("rank", F.row_number().over(w))


def movement(reranked: DataFrame, relevant: DataFrame) -> DataFrame:
    """Counts of relevant chunks moved into the top 1, 3, 5 and out of the top 5, per system."""
    rel = reranked.join(relevant.select("qid", "chunk_id").dropDuplicates(), ["qid", "chunk_id"])
    into = [F.count_if((F.col("old_rank") > k) & (F.col("rank") <= k)).alias(f"into_top{k}") for k in (1, 3, 5)]
    return rel.groupBy("system").agg(*into, F.count_if((F.col("old_rank") <= 5) & (F.col("rank") > 5)).alias("out_of_top5"))


def failure_class(required: Column, available: Column, recovered: Column) -> Column:
    """Where evidence is lost: in the candidate pool, in the reranking, both, or nowhere."""
    pool_loss = F.size(F.array_except(required, available)) > 0
    rank_loss = F.size(F.array_except(available, recovered)) > 0
    return F.when(pool_loss & rank_loss, "both").when(pool_loss, "candidate_generation").when(rank_loss, "reranking").otherwise("complete")


def analyze(before: DataFrame, after: DataFrame, required: DataFrame) -> DataFrame:
    """Per question: oracle coverage, losses, failure class and metric changes.

    ``before``/``after``: rows of question_metrics over the pool and its new order; ``required``: qid, required.
    """
    b = before.select("system", "qid", F.col("matchable").alias("available"), F.col("recall_10").alias("recall_before"), F.col("reciprocal_rank").alias("rr_before"))
    a = after.select("system", "qid", F.col("recovered_10").alias("recovered"), F.col("recall_10").alias("recall_after"), F.col("reciprocal_rank").alias("rr_after"))
    m = b.join(a, ["system", "qid"]).join(required, "qid")
    return m.select(
        "system", "qid", F.try_divide(F.size("available"), F.size("required")).alias("oracle_recall"),
        F.array_sort(F.array_except("required", "available")).alias("missing_from_pool"),
        F.array_sort(F.array_except("available", "recovered")).alias("missed_at_10"),
        failure_class(F.col("required"), F.col("available"), F.col("recovered")).alias("failure_class"),
        (F.col("recall_after") - F.col("recall_before")).alias("recall_delta"), (F.col("rr_after") - F.col("rr_before")).alias("rr_delta"),
    )


def change_summary(analysis: DataFrame) -> DataFrame:
    """Per system: mean oracle recall, failure classes, questions improved, harmed, unchanged."""
    sign = F.signum("recall_delta")
    classes = [F.count_if(F.col("failure_class") == c).alias(c) for c in ("both", "candidate_generation", "reranking", "complete")]
    return analysis.groupBy("system").agg(
        F.round(F.avg("oracle_recall"), 6).alias("oracle_recall"), *classes,
        F.count_if(sign > 0).alias("improved"), F.count_if(sign < 0).alias("harmed"), F.count_if(sign == 0).alias("unchanged"),
    )
