"""Vector code compression: product codes over integer codebooks, assigned exactly.

Components become integers (``floor(256 * x)``), vectors are cut into ``PARTS``
equal parts, and each part has a codebook that starts as that part of the first
vectors and is moved to the floored means of its parts for ``ROUNDS`` rounds.

The nearest entry is screened in float32: one matrix product gives
``|c|^2 - 2 x.c`` of all entries, and the error of every such value is bounded
by ``(d + 6) * 2^-24 * (|c|^2 + 2 |x| |c|)`` with some room (conversion, products,
sums in any order, final rounding).  An entry whose interval lies wholly above
the least upper end cannot be nearest; all others are evaluated again in int64,
and the smallest index wins among equal distances.

A round adds up each task's parts to one fixed-size vector of sums and counts;
these are summed by a tree, so the driver handles the codebooks and nothing
that grows with the rows.  Labels held by a thousandth of all rows or more are
at most a thousand and are broadcast with their sums; the others meet theirs in
a shuffled join, where none of them is large.

Defined results
* a vector that is null or holds a null or non-finite component is left out
* null vec_ids come after all others, equal ones are ordered by their integers
* shorter vectors, or a length that ``PARTS`` does not divide: filled up with zero components
* components beyond +-2^17 count as that, so that distances stay exact in int64
* fewer vectors than ``ENTRIES``: as many entries as vectors; an empty table gives an empty table
* sums beyond the range of a long are null
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.llm import textcore
from dossier.llm.durable import durable

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256
MOST = 1 << 25  # largest integer component
HOT_SHARE = 1000


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Index of the nearest entry of ``book`` for each row of ``x`` (both int64), the squared distance, and how many entries were evaluated again."""
    xf, bf = x.astype(np.float32), book.astype(np.float32)
    norms = (book * book).sum(axis=1).astype(np.float64)
    rough = norms.astype(np.float32) - np.float32(2) * (xf @ bf.T)
    length = np.sqrt((x.astype(np.float64) ** 2).sum(axis=1))
    error = (x.shape[1] + 6) * 2.0**-24 * 1.01 * (norms + 2 * length[:, None] * np.sqrt(norms))
    rough = rough.astype(np.float64)
    open_ = rough - error <= (rough + error).min(axis=1)[:, None]
    best = open_.argmax(axis=1)
    row, entry = np.nonzero(open_ & (open_.sum(axis=1) > 1)[:, None])
    if len(row):
        apart = ((x[row] - book[entry]) ** 2).sum(axis=1)
        first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
        least = np.minimum.reduceat(apart, first)
        hit = np.flatnonzero(apart == np.repeat(least, np.diff(np.append(first, len(row)))))
        rows, at = np.unique(row[hit], return_index=True)  # entries ascend within a row
        best[rows] = entry[hit[at]]
    return best, ((x - book[best]) ** 2).sum(axis=1), len(row)


def integers(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """Durable (vec_id, label, v): the vectors kept, as integers."""
    numbers = F.transform(F.col(column), lambda c: c.cast("double"))
    sound = F.col(column).isNotNull() & F.forall(numbers, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    own = vectors.where(sound).select("vec_id", "label", F.transform(numbers, lambda c: F.least(F.greatest(F.floor(c * SCALE), F.lit(-MOST)), F.lit(MOST)).cast("int")).alias("v"))
    return durable(own, "integer-vectors")


def _matrix(column, size: int) -> np.ndarray:
    """The rows of an Arrow list column, filled up with zeros to ``size``."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    lengths = np.asarray(column.value_lengths()).astype(np.int64)
    if (lengths == size).all():
        return flat.reshape(-1, size)
    out = np.zeros((len(lengths), size), np.int64)
    out[np.repeat(np.arange(len(lengths)), lengths), np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


def _moved(own: DataFrame, books: np.ndarray, many: int) -> np.ndarray:
    """The codebooks after one round of assignment and means."""
    parts, entries, width = books.shape

    def add(batches):
        import pyarrow as pa

        acc = np.zeros((parts, entries, width + 1), np.int64)
        for batch in batches:
            x = _matrix(batch.column(0), parts * width)
            for p in range(parts):
                part = x[:, p * width : (p + 1) * width]
                code, _, _ = nearest(part, books[p])
                np.add.at(acc[p, :, :width], code, part)
                acc[p, :, width] += np.bincount(code, minlength=entries)
        yield pa.RecordBatch.from_arrays([pa.array([acc.tobytes()], pa.binary())], names=["sums"])

    total = textcore.summed(own.select("v").mapInArrow(add, "sums binary"), "sums", np.int64, many).reshape(parts, entries, width + 1)
    count = total[:, :, width:]
    return np.where(count > 0, total[:, :, :width] // np.maximum(count, 1), books)


def train(own: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray | None:
    """Codebooks (parts x entries x width) of the integer vectors ``own``; None without vectors."""
    size = own.agg(F.max(F.size("v"))).first()[0]
    if size is None:
        return None
    width = max(1, -(-size // parts))
    first = own.orderBy(F.col("vec_id").asc_nulls_last(), "v").select("v").limit(entries).collect()
    start = np.zeros((len(first), parts * width), np.int64)
    for row, r in zip(start, first):
        row[: len(r.v)] = r.v
    books = start.reshape(len(first), parts, width).transpose(1, 0, 2).copy()
    many = own.rdd.getNumPartitions()
    for _ in range(rounds):
        books = _moved(own, books, many)
    return books


def encode(own: DataFrame, books: np.ndarray) -> DataFrame:
    """(vec_id, label, code, error) of every integer vector; ``own`` keeps its label's type."""
    parts, _, width = books.shape
    label = own.schema["label"].dataType.simpleString()

    def code(batches):
        import pyarrow as pa

        for batch in batches:
            x = _matrix(batch.column("v"), parts * width)
            codes, error = np.empty((len(x), parts), np.uint8), np.zeros(len(x), np.int64)
            for p in range(parts):
                codes[:, p], apart, _ = nearest(x[:, p * width : (p + 1) * width], books[p])
                error += apart
            text = codes.tobytes().hex()
            hexed = [text[i : i + 2 * parts] for i in range(0, len(text), 2 * parts)]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(hexed, pa.string()), pa.array(error)], names=["vec_id", "label", "code", "error"])

    return own.mapInArrow(code, f"vec_id {own.schema['vec_id'].dataType.simpleString()}, label {label}, code string, error long")


def books_digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def with_label_error(coded: DataFrame) -> DataFrame:
    """``coded`` (with label and error) and the sum of error over the rows of its label; null is a label."""
    sums = durable(coded.groupBy("label").agg(F.try_sum("error").alias("label_error"), F.count("*").alias("rows")), "label-sums")
    total = sums.agg(F.sum("rows")).first()[0] or 0
    hot = sums.where(F.col("label").isNull() | (F.col("rows") * HOT_SHARE >= total)).drop("rows")  # at most HOT_SHARE labels and null
    rest = sums.where(F.col("label").isNotNull() & (F.col("rows") * HOT_SHARE < total)).drop("rows")
    of, error = hot.select(F.col("label").alias("of"), "label_error"), "label_error"
    common = coded.join(F.broadcast(of), F.col("label").eqNullSafe(F.col("of"))).drop("of")
    others = coded.join(F.broadcast(of.select("of")), F.col("label").eqNullSafe(F.col("of")), "left_anti")
    return common.unionByName(others.join(rest, "label").select(*coded.columns, error))


def compress(vectors: DataFrame) -> DataFrame:
    """Per kept vector of ``vectors`` (vec_id, label, embedding): vec_id, code, error, label_error, codebooks_sha256."""
    own = integers(vectors)
    books = train(own)
    if books is None:
        return own.select("vec_id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    coded = durable(encode(own, books), "vector-codes")
    return with_label_error(coded).select("vec_id", "code", "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256"))
