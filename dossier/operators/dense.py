"""Exact cosine ranking of stored vectors, and the encoder interface.

Queries are a stated set: they go to the tasks in blocks of ``QUERY_BLOCK``, each
of which is multiplied with the Arrow batches of the index.  A task keeps only
its k best per query, so the shuffle holds k rows per query and task.
"""

from __future__ import annotations

import hashlib
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dossier.functions.arrow import small

QUERY_BLOCK = 1024
INDEX_ROWS = 512
SCORE_DIGITS = 6


class Encoder(Protocol):
    """Turns texts into vectors; ``signature`` names everything that determines them."""

    signature: dict
    dimensions: int

    def encode(self, texts: list[str], role: str) -> np.ndarray: ...


class HashingEncoder:
    """Deterministic offline encoder: signed hashed term counts, unit norm."""

    def __init__(self, dimensions: int = 64, query_prefix: str = ""):
        self.dimensions, self.query_prefix = dimensions, query_prefix
        self.signature = {"implementation": "hashed_terms", "dimensions": dimensions, "query_prefix": query_prefix}

    def encode(self, texts: list[str], role: str = "document") -> np.ndarray:
        out = np.zeros((len(texts), self.dimensions), np.float32)
        for i, t in enumerate(texts):
            for w in ((self.query_prefix if role == "query" else "") + (t or "")).lower().split():
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                out[i, h % self.dimensions] += 1.0 if h >> 63 else -1.0
            if not out[i].any():
                out[i, 0] = 1.0
        return out / np.linalg.norm(out, axis=1, keepdims=True)


def squared_norm(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Native cosine, clipped to [-1, 1]."""
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / (F.sqrt(squared_norm(a)) * F.sqrt(squared_norm(b)))))


def unit(v: Column) -> Column:
    """``v`` with norm 1."""
    n = F.sqrt(squared_norm(v))
    return F.transform(v, lambda x: (x / n).cast("float"))


def is_sound(v: Column) -> Column:
    """Finite and not zero."""
    return F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & (squared_norm(v) > 0), F.lit(False))


def _query_blocks(queries: DataFrame):
    """(qids, unit vectors) of at most QUERY_BLOCK queries; the driver holds one block at a time."""
    held: list = []

    def block():
        q = np.array([r.vector for r in held], np.float64)
        norm = np.linalg.norm(q, axis=1)
        if not np.isfinite(q).all() or (norm == 0).any():
            raise ValueError("query vectors must be finite and not zero")
        return np.array([r.qid for r in held]), q / norm[:, None]

    for row in queries.select("qid", "vector").orderBy("qid").toLocalIterator():
        held.append(row)
        if len(held) == QUERY_BLOCK:
            yield block()
            held = []
    if held:
        yield block()


def best_rows(query: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best rows of every query: by score, then by the smaller id."""
    order = np.lexsort((ids, -score, query))
    q = query[order]
    first = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]])) if len(q) else np.zeros(0, np.int64)
    place = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
    return order[place < k]


def cosine_top(index: DataFrame, queries: DataFrame, k: int, exclude_self: bool = False) -> DataFrame:
    """qid, id, score, rank <= k.  ``index``: id, vector; ``queries``: qid, vector.

    Ties go to the smaller id; scores are rounded to ``SCORE_DIGITS`` first.
    """
    def search(qids: np.ndarray, unit_q: np.ndarray) -> DataFrame:
        shared = index.sparkSession.sparkContext.broadcast((qids, unit_q))  # QUERY_BLOCK vectors at most

        def best(batches):
            import pyarrow as pa

            names, q = shared.value
            kind = {"int": pa.int32(), "string": pa.string()}.get(of_query, pa.int64())
            held = (np.zeros(0, np.int64), None, np.zeros(0))
            for batch in small(batches, rows=INDEX_ROWS):
                x = np.array(batch.column("vector").to_pylist(), np.float64)
                ids = batch.column("id").to_numpy(zero_copy_only=False)
                size = np.linalg.norm(x, axis=1)
                if not np.isfinite(x).all() or (size == 0).any():
                    raise ValueError("index vectors must be finite and not zero")
                s = np.round(np.clip((x @ q.T) / size[:, None], -1, 1), SCORE_DIGITS)
                if exclude_self:
                    s[ids[:, None] == names[None, :]] = -np.inf
                least = np.partition(s, len(s) - k, axis=0)[len(s) - k] if len(s) > k else np.full(s.shape[1], -1.0)
                row, column = np.nonzero((s >= least) & (s > -np.inf))  # ties with the k-th all stay
                query, here = np.concatenate([held[0], column]), ids[row] if held[1] is None else np.concatenate([held[1], ids[row]])
                score = np.concatenate([held[2], s[row, column]])
                keep = best_rows(query, here, score, k)
                held = (query[keep], here[keep], score[keep])
            if len(held[0]):
                yield pa.RecordBatch.from_arrays([pa.array(names[held[0]], kind), pa.array(held[1], batch.column("id").type), pa.array(held[2])], names=["qid", "id", "score"])

        return index.select("id", "vector").mapInArrow(best, f"qid {dict(queries.dtypes)['qid']}, id {dict(index.dtypes)['id']}, score double")

    of_query = dict(queries.dtypes)["qid"]
    part = None
    for qids, unit_q in _query_blocks(queries):
        found = search(qids, unit_q)
        part = found if part is None else part.unionByName(found)
    if part is None:
        return queries.select("qid").limit(0).join(index.select("id").limit(0)).select("qid", "id", F.lit(0.0).alias("score"), F.lit(0).alias("rank"))
    w = Window.partitionBy("qid").orderBy(F.desc("score"), "id")
    return part.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def encode_texts(records: DataFrame, encoder: Encoder, role: str = "document") -> DataFrame:
    """``records`` (id, text) plus vector, in Arrow batches."""

    def run(batches):
        for pdf in batches:
            v = encoder.encode(pdf["text"].tolist(), role)
            if v.shape != (len(pdf), encoder.dimensions) or not np.isfinite(v).all() or not np.linalg.norm(v, axis=1).all():
                raise ValueError("the encoder returned vectors that do not fit its records")
            yield pdf.assign(vector=list((v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)))

    kind = dict(records.dtypes)["id"]
    return records.select("id", "text").mapInPandas(run, f"id {kind}, text string, vector array<float>")


def cache_key(signature: str, role: str, id_: Column, text: Column) -> Column:
    """Name of a cached vector: everything its value depends on."""
    return F.sha2(F.concat_ws("\u0001", F.lit(signature), F.lit(role), id_.cast("string"), F.sha2(text, 256)), 256)


def cache_plan(records: DataFrame, cache: DataFrame, signature: str, role: str = "document") -> tuple[DataFrame, DataFrame]:
    """(hits with their vectors, records to encode).  A cached vector must have unit norm to count."""
    keyed = records.withColumn("key", cache_key(signature, role, F.col("id"), F.col("text")))
    good = cache.where(is_sound(F.col("vector")) & (F.abs(F.sqrt(squared_norm(F.col("vector"))) - 1) < 1e-5)).select("key", "vector")
    return keyed.join(good, "key"), keyed.join(good.select("key"), "key", "left_anti")


def encode_cached(records: DataFrame, cache: DataFrame, encoder: Encoder, signature: str, role: str = "document") -> DataFrame:
    """id, text, vector, hit: cached vectors where they hold, new ones elsewhere."""
    hits, misses = cache_plan(records, cache, signature, role)
    new = encode_texts(misses.select("id", "text"), encoder, role)
    return hits.select("id", "text", "vector", F.lit(True).alias("hit")).unionByName(new.withColumn("hit", F.lit(False)))


def misaligned(manifest: DataFrame, records: DataFrame, key: str = "id") -> DataFrame:
    """Rows of either side without an equal row on the other."""
    both = manifest.withColumn("in_manifest", F.lit(True)).join(records.select(key).withColumn("in_records", F.lit(True)), key, "full_outer")
    return both.where("in_manifest is null or in_records is null").select(key, F.coalesce("in_manifest", F.lit(False)).alias("in_manifest"))
