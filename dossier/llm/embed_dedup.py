"""Embedding near-dedup by iterative quantisation and multi-index Hamming tables.

Rotations learned from a bounded sample (``FIT_ROWS`` vectors with the smallest
hashes) turn vectors into balanced binary codes.  A code is cut into parts and
each part indexes a table; vectors that share a part meet there.  Pairs whose
first ``BITS`` bits are within a Hamming distance that a pair at the threshold
stays below but for ``SIGMAS`` standard deviations are compared by cosine over the
original vectors.  A pair counts only in the first table that joins it.  The
width of a part grows with the number of vectors, so that cells do not, and the
number of parts follows from ``RECALL`` at the threshold, where two vectors at
angle ``a`` differ in a bit with probability ``a / pi``.

Equal vectors form one class first, so a cell holds distinct vectors only.  The
vectors of a cell of more than ``TILE`` are dealt into blocks, and every two
blocks meet in a tile of their own: no cell is cut short and none fills a task.

Defined results
* null, zero or non-finite vectors (or components): no links, a component of their own
* vectors of different length link with nothing; null vec_id: no links
* repeated vectors link with each other; an empty table gives an empty table
* rows of one vec_id are one vector: they share their component and the links of all their values
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.llm.components import components
from dossier.llm.durable import durable

BITS = 64
FIT_ROWS = 10_000
RECALL = 0.97
SIGMAS = 6
MOST_WIDTH = 28
TILE = 1024


def learn_rotation(x: np.ndarray, seed: int, bits: int = BITS, rounds: int = 30) -> np.ndarray:
    """Projection of iterative quantisation: alternate sign codes and the best rotation.

    Nothing is centred: a cosine is an angle at the origin, and only planes
    through the origin part two vectors by that angle.
    """
    rng = np.random.default_rng(seed)
    values, vectors = np.linalg.eigh(x.T @ x)
    basis = vectors[:, np.argsort(values)[::-1][:bits]]
    if basis.shape[1] < bits:  # more bits than dimensions: random directions for the rest
        basis = np.concatenate([basis, rng.normal(size=(x.shape[1], bits - basis.shape[1])) / math.sqrt(x.shape[1])], axis=1)
    v = x @ basis
    turn, _ = np.linalg.qr(rng.normal(size=(bits, bits)))
    for _ in range(rounds):
        code = np.where(v @ turn >= 0, 1.0, -1.0)
        left, _, right = np.linalg.svd(code.T @ v)
        turn = (left @ right).T
    return basis @ turn


def table_shape(n: int, threshold: float) -> tuple[int, int]:
    """(bits of a part, number of parts) for ``n`` vectors."""
    width = min(MOST_WIDTH, max(6, n.bit_length() - 4))
    same = (1 - math.acos(threshold) / math.pi) ** width
    return width, math.ceil(math.log(1 - RECALL) / math.log(1 - same))


def code_parts(x: np.ndarray, rotations: list, width: int, parts: int) -> np.ndarray:
    """n x parts table keys."""
    weights = 1 << np.arange(width)
    out = []
    for projection in rotations:
        bits = x @ projection >= 0
        for k in range(BITS // width):
            out.append(bits[:, k * width : (k + 1) * width] @ weights)
    return np.stack(out[:parts], axis=1).astype(np.uint32)


def head_codes(x: np.ndarray, projection: np.ndarray) -> np.ndarray:
    """The BITS bits of the first rotation as one integer a vector."""
    return np.packbits(x @ projection >= 0, axis=1, bitorder="little").view(np.uint64).ravel()


def hamming_limit(threshold: float, bits: int = BITS) -> int:
    """The distance that codes of a pair at the threshold exceed only beyond SIGMAS standard deviations."""
    p = math.acos(threshold) / math.pi
    return math.ceil(bits * p + SIGMAS * math.sqrt(bits * p * (1 - p)))


def _unit(raw: list[bytes], kind: str) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1).astype(np.float64)
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def _near(x: np.ndarray, codes: np.ndarray, left: np.ndarray, right: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs of left and right reach the threshold, by Hamming distance and then by cosine."""
    close = np.bitwise_count(codes[left][:, None] ^ codes[right][None, :]) <= hamming_limit(threshold)
    if np.count_nonzero(close) * 16 > close.size:  # most pairs: one product is cheaper
        return close & (x[left] @ x[right].T >= threshold)
    a, b = np.nonzero(close)
    for at in range(0, len(a), 1 << 16):
        p, q = a[at : at + (1 << 16)], b[at : at + (1 << 16)]
        close[p, q] = np.einsum("nd,nd->n", x[left[p]], x[right[q]]) >= threshold
    return close


def _compare(x, codes, parts, ids, mult, block, i, j, table, threshold):
    """(ids, link counts) and (id, root) of one tile; blocks ``i`` and ``j`` meet, or i with itself."""
    left, right = (np.flatnonzero(block == i), np.flatnonzero(block == j)) if i != j else (np.arange(len(ids)),) * 2
    links = _near(x, codes, left, right, threshold)
    if i == j:
        np.fill_diagonal(links, False)
    a, b = np.nonzero(links)
    counts = np.zeros(len(ids), np.int64)
    for at in range(0, len(a), 1 << 20):
        p, q = left[a[at : at + (1 << 20)]], right[b[at : at + (1 << 20)]]
        first = np.argmax(parts[p] == parts[q], axis=1) == table
        np.add.at(counts, p[first], mult[q[first]])
        if i != j:
            np.add.at(counts, q[first], mult[p[first]])
    root = np.full(len(ids), -1)
    to, back = ([] for _ in range(2))
    square = np.zeros((len(ids), len(ids)), bool)
    square[np.ix_(left, right)] = links
    if i != j:
        square |= square.T
    for s in range(len(ids)):
        if root[s] >= 0 or not square[s].any():
            continue
        group = np.zeros(len(ids), bool)
        edge = np.zeros(len(ids), bool)
        group[s] = edge[s] = True
        while edge.any():
            edge = square[edge].any(axis=0) & ~group
            group |= edge
        root[group] = s
        members = np.flatnonzero(group)
        to.append(ids[members])
        back.append(np.full(len(members), ids[members].min()))
    return counts, (np.concatenate(to) if to else np.zeros(0, np.int64)), (np.concatenate(back) if back else np.zeros(0, np.int64))


def _links(classes: DataFrame, threshold: float, kind: str) -> DataFrame:
    """Rows (id, links, root): link counts by tile (root null) or edges (links null).

    ``classes``: id, mult, raw (bytes of numbers of ``kind``) of distinct vectors of one length.
    """
    spark = classes.sparkSession
    sample = classes.orderBy(F.xxhash64("raw"), "id").limit(FIT_ROWS).select("raw").collect()
    if not sample:
        return spark.createDataFrame([], "id long, links long, root long")
    fit = _unit([r.raw for r in sample], kind)
    width, parts = table_shape(classes.count(), threshold)
    rotations = spark.sparkContext.broadcast([learn_rotation(fit, seed) for seed in range(math.ceil(parts / (BITS // width)))])

    def index(batches):
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                b = batch.slice(at, 1024)
                keys = code_parts(_unit(b.column("raw").to_pylist(), kind), rotations.value, width, parts)
                n = b.num_rows
                take = pa.array(np.repeat(np.arange(n), parts))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.tile(np.arange(parts, dtype=np.int32), n)), pa.array(keys.ravel().astype(np.int32)),
                        b.column("id").take(take), b.column("mult").take(take), b.column("raw").take(take),
                        pa.array([k.tobytes() for k in keys], pa.binary()).take(take),
                    ],
                    names=["part", "key", "id", "mult", "raw", "parts"],
                )

    coded = classes.select("id", "mult", "raw").mapInArrow(index, "part int, key int, id long, mult long, raw binary, parts binary")
    cells = coded.groupBy("part", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    blocks = F.ceil(F.col("n") / F.lit(TILE)).cast("int")
    dealt = coded.join(cells, ["part", "key"]).withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    tiles = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "part", "key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "id", "mult", "raw", "parts"
    )
    count = max(16, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def compare(batches):
        import pyarrow as pa

        def done(key, rows):
            if len(rows) < 2:
                return None
            block = np.array([r[0] for r in rows])
            ids, mult = np.array([r[1] for r in rows], np.int64), np.array([r[2] for r in rows], np.int64)
            keys = np.frombuffer(b"".join(r[4] for r in rows), np.uint32).reshape(len(rows), -1)
            x = _unit([r[3] for r in rows], kind)
            counts, to, back = _compare(x, head_codes(x, rotations.value[0]), keys, ids, mult, block, key[2], key[3], key[0], threshold)
            some = counts > 0
            n, m = int(some.sum()), len(to)
            if not n + m:
                return None
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([ids[some], to])),
                    pa.concat_arrays([pa.array(counts[some]), pa.nulls(m, pa.int64())]),
                    pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(back)]),
                ],
                names=["id", "links", "root"],
            )

        key, rows = None, []
        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("part", "key", "i", "j", "block", "id", "mult", "raw", "parts")]
            for row in zip(*cols):
                if row[:4] != key:
                    if (out := done(key, rows)) is not None:
                        yield out
                    key, rows = row[:4], []
                rows.append(row[4:])
        if (out := done(key, rows)) is not None:
            yield out

    met = tiles.repartition(count, "part", "key", "i", "j").sortWithinPartitions("part", "key", "i", "j")
    return met.mapInArrow(compare, "id long, links long, root long")


def link_embeddings(vectors: DataFrame, threshold: float = 0.9) -> DataFrame:
    """vec_id, n_links, component_id, kept.  ``vectors``: vec_id, embedding (array of float or double)."""
    e = F.transform("embedding", lambda x: x.cast("double"))
    sound = F.coalesce(
        F.col("vec_id").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & (F.aggregate(e, F.lit(0.0), lambda s, x: s + F.abs(x)) > 0),
        F.lit(False),
    )
    rows = vectors.select("vec_id", "embedding").withColumn("sound", sound)
    good = rows.where("sound")
    single = dict(vectors.dtypes)["embedding"] == "array<float>"  # kept as they are; all arithmetic is in double precision
    kind = "<f4" if single else "<f8"

    def pack(batches):
        import pyarrow as pa

        for batch in batches:
            column = batch.column("e")
            size = np.diff(np.asarray(column.offsets)).astype(np.int32)
            flat = np.asarray(column.flatten()).astype(kind) + np.zeros(1, kind)  # -0.0 is 0.0
            cut = np.concatenate([[0], np.cumsum(size)])
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(size), pa.array([flat[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:])], pa.binary())], names=["vec_id", "dims", "raw"])

    packed = good.select("vec_id", (F.col("embedding") if single else e).alias("e")).mapInArrow(pack, "vec_id long, dims int, raw binary")
    packed = packed.withColumn("digest", F.sha2("raw", 256))
    classes = durable(packed.groupBy("dims", "digest").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("mult"), F.first("raw").alias("raw")), "vector-classes")
    found = None
    for dims in [r.dims for r in classes.select("dims").distinct().orderBy("dims").collect()]:
        part = _links(classes.where(F.col("dims") == dims), threshold, kind)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    found = durable(found, "vector-links")
    count = found.where("links is not null").groupBy("id").agg(F.sum("links").alias("links"))
    comp = components(found.where("root is not null").select(F.col("id").alias("a"), F.col("root").alias("b")))
    named = (
        classes.select("id", "mult", "dims", "digest").join(count, "id", "left")
        .join(comp.withColumnRenamed("node", "id"), "id", "left")
        .select("dims", "digest", (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    )
    linked = packed.select("vec_id", "dims", "digest").join(named, ["dims", "digest"]).select("vec_id", "n_links", "component_id")
    alone = rows.where("not sound").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"))
