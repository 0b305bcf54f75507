"""LM scoring: a log-bilinear model trained with noise-contrastive estimation.

Words are 64-bit hashes of their lower-cased bytes.  The model predicts classes
from the two classes before: the ``CLASSES - 2`` most frequent training words,
the end of a document, and one class for all other words, inside which words
follow the add-one unigram rate.  Class scores are normalised over all classes
by matrix products over the distinct contexts of a batch.  Every training token
is counted and trained on once: each partition trains from the same start and
the parameters are averaged by tokens.  So ``score`` depends on how the rows lie
in partitions, though not on the order in which tasks run; all other columns do not.

Counts live in hash buckets.  Words above a count threshold (at most
``FREQUENT`` of them, so the table has a fixed bound) are looked up where the
text is read; all rarer ones travel to the bucket that holds their counts.

Defined results
* null text: no words, only the end token; null doc_id: hashed as the empty string, so a training row
* equal doc_ids are scored row by row; an empty table gives an empty table
* no training rows at all: every word is unknown and the model is uniform over classes
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.llm import textcore
from dossier.llm.durable import durable, release

CLASSES = 1024
WIDTH = 16
NOISE = 48
FREQUENT = 1 << 18
HELD = (7, 2)
END = np.uint64(0x0E4D0E4D0E4D0E4D)
_FLUSH = 1 << 21


def held_out(doc_ids: list) -> np.ndarray:
    """Whether crc32 of the id's text leaves the held-out remainder."""
    return np.array([zlib.crc32(b"" if d is None else str(d).encode()) % HELD[0] == HELD[1] for d in doc_ids], bool)


def _tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes with an end token after each document, first token of each document)."""
    h, bounds = textcore.words(data, offsets)
    n = len(offsets) - 1
    return np.insert(h, bounds[1:], END), bounds + np.arange(n + 1)


def _runs(h: np.ndarray, c: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct sorted hashes and their summed counts."""
    if not len(h):
        return h, np.zeros(0, np.int64)
    if c is None:
        h = np.sort(h)
        at = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        return h[at], np.diff(np.append(at, len(h)))
    order = np.argsort(h)
    h, c = h[order], c[order]
    at = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    return h[at], np.add.reduceat(c, at)


def _by_bucket(h: np.ndarray, buckets: int):
    """(bucket, slice) of sorted hashes; a bucket is a range of hashes."""
    edges = np.array([(k << 64) // buckets for k in range(1, buckets)], dtype=np.uint64)
    cut = np.concatenate([[0], np.searchsorted(h, edges), [len(h)]])
    for k in range(buckets):
        if cut[k + 1] > cut[k]:
            yield k, slice(int(cut[k]), int(cut[k + 1]))


def count_words(docs: DataFrame, buckets: int) -> DataFrame:
    """Durable table (bucket, hashes, counts, distinct, total) over the training rows."""

    def count(batches):
        import pyarrow as pa

        held, size = [], 0

        def flush():
            h, c = _runs(np.concatenate(held))
            rows = [(k, h[s].tobytes(), c[s].astype(np.int64).tobytes()) for k, s in _by_bucket(h, buckets)]
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], names=["bucket", "h", "c"])

        for batch, i, j, data, offsets in textcore.text_pieces(batches):
            h, first = _tokens(data, offsets)
            train = ~held_out(batch.column("doc_id").slice(i, j - i).to_pylist())
            h = h[np.repeat(train, np.diff(first))]
            if len(h):
                held.append(h)
                size += len(h)
            if size >= _FLUSH:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    def merge(batches):
        import pyarrow as pa

        parts: dict[int, list] = {}
        for batch in batches:
            for k, h, c in zip(batch.column("bucket").to_pylist(), batch.column("h").to_pylist(), batch.column("c").to_pylist()):
                parts.setdefault(k, []).append((np.frombuffer(h, np.uint64), np.frombuffer(c, np.int64)))
        for k, got in parts.items():
            h, c = _runs(np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got]))
            yield pa.RecordBatch.from_arrays(
                [pa.array([k], pa.int32()), pa.array([h.tobytes()], pa.binary()), pa.array([c.tobytes()], pa.binary()), pa.array([len(h)], pa.int64()), pa.array([int(c.sum())], pa.int64())],
                names=["bucket", "h", "c", "distinct", "total"],
            )

    partial = docs.select("doc_id", "text").mapInArrow(count, "bucket int, h binary, c binary")
    return durable(partial.repartition(buckets, "bucket").mapInArrow(merge, "bucket int, h binary, c binary, distinct long, total long"), "lm-counts")


def _frequent(counts: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes and counts of all words above the smallest threshold that leaves at most ``most``."""

    def histogram(batches):
        import pyarrow as pa

        for batch in batches:
            for c in batch.column("c").to_pylist():
                v, n = np.unique(np.minimum(np.frombuffer(c, np.int64), 1 << 16), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(v), pa.array(n.astype(np.int64))], names=["v", "n"])

    rows = counts.mapInArrow(histogram, "v long, n long").groupBy("v").agg(F.sum("n").alias("n")).collect()  # at most 65,537 rows
    left, least = most, (1 << 62)
    for v, n in sorted(((r.v, r.n) for r in rows), reverse=True):
        if n > left:
            break
        left, least = left - n, v

    def above(batches):
        import pyarrow as pa

        for batch in batches:
            for h, c in zip(batch.column("h").to_pylist(), batch.column("c").to_pylist()):
                h, c = np.frombuffer(h, np.uint64), np.frombuffer(c, np.int64)
                keep = c >= least
                yield pa.RecordBatch.from_arrays([pa.array([h[keep].tobytes()], pa.binary()), pa.array([c[keep].tobytes()], pa.binary())], names=["h", "c"])

    got = counts.mapInArrow(above, "h binary, c binary").collect()  # at most ``most`` words
    h = np.concatenate([np.frombuffer(r.h, np.uint64) for r in got] or [np.zeros(0, np.uint64)])
    c = np.concatenate([np.frombuffer(r.c, np.int64) for r in got] or [np.zeros(0, np.int64)])
    order = np.argsort(h)
    return h[order], c[order]


class LogBilinear:
    """P(class | two classes before) with class vectors, diagonal context matrices and biases."""

    def __init__(self, classes: int = CLASSES, width: int = WIDTH, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.context = rng.normal(0, 0.1, (classes + 1, width)).astype(np.float32)  # the last row stands before a text
        self.position = np.ones((2, width), np.float32)
        self.output = rng.normal(0, 0.1, (classes, width)).astype(np.float32)
        self.bias = np.full(classes, -np.log(classes), np.float32)

    NAMES = ("context", "position", "output", "bias")

    def to_bytes(self) -> bytes:
        return b"".join(getattr(self, n).astype(np.float32).tobytes() for n in self.NAMES)

    def load(self, flat: np.ndarray) -> LogBilinear:
        at = 0
        for n in self.NAMES:
            a = getattr(self, n)
            setattr(self, n, flat[at : at + a.size].reshape(a.shape).astype(np.float32))
            at += a.size
        return self

    def hidden(self, before: np.ndarray) -> np.ndarray:
        return self.context[before[:, 0]] * self.position[0] + self.context[before[:, 1]] * self.position[1]

    def train(self, before: np.ndarray, target: np.ndarray, noise_p: np.ndarray, rng, rate: float, noise: int = NOISE) -> None:
        """One step of NCE; the noise words are shared by the batch."""
        n = len(target)
        sample = np.searchsorted(np.cumsum(noise_p), rng.random(noise) * (1 - 1e-7)).astype(np.int64)
        q = self.hidden(before)
        log_kp = np.log(noise * noise_p).astype(np.float32)
        s = np.einsum("nd,nd->n", q, self.output[target]) + self.bias[target]
        d_true = 1 / (1 + np.exp(s - log_kp[target])) / n  # ascent on log sigmoid
        z = q @ self.output[sample].T + self.bias[sample]
        d_noise = -1 / (1 + np.exp(log_kp[sample] - z)) / n
        dq = d_true[:, None] * self.output[target] + d_noise @ self.output[sample]
        d_out = np.zeros_like(self.output)
        _add_rows(d_out, target, d_true[:, None] * q)
        np.add.at(d_out, sample, d_noise.T @ q)
        d_bias = np.bincount(target, weights=d_true, minlength=len(self.bias)) + np.bincount(sample, weights=d_noise.sum(axis=0), minlength=len(self.bias))
        d_ctx, d_pos = np.zeros_like(self.context), np.zeros_like(self.position)
        for k in (0, 1):
            _add_rows(d_ctx, before[:, k], dq * self.position[k])
            d_pos[k] = (dq * self.context[before[:, k]]).sum(axis=0)
        for a, d in ((self.output, d_out), (self.bias, d_bias), (self.context, d_ctx), (self.position, d_pos)):
            g = self._second.setdefault(id(a), np.full(a.shape, 1e-8, np.float32))
            g += (d * d).astype(np.float32)
            a += (rate * d / np.sqrt(g)).astype(np.float32)

    def start_training(self) -> None:
        self._second: dict[int, np.ndarray] = {}

    def log_norm(self, before: np.ndarray) -> np.ndarray:
        """Log of the sum over all classes, per context."""
        z = self.hidden(before) @ self.output.T + self.bias
        top = z.max(axis=1)
        z -= top[:, None]
        return top + np.log(np.exp(z, out=z).sum(axis=1))

    def log_prob(self, before: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Natural log probability of ``target`` classes, normalised."""
        key = before[:, 0].astype(np.int64) * len(self.context) + before[:, 1]
        distinct, at = np.unique(key, return_inverse=True)
        pair = np.stack([distinct // len(self.context), distinct % len(self.context)], axis=1)
        norm = np.concatenate([self.log_norm(pair[i : i + 4096]) for i in range(0, len(pair), 4096)] or [np.zeros(0, np.float32)])
        s = np.einsum("nd,nd->n", self.hidden(before), self.output[target]) + self.bias[target]
        return s.astype(np.float64) - norm[at]


def _add_rows(out: np.ndarray, rows: np.ndarray, values: np.ndarray) -> None:
    order = np.argsort(rows, kind="stable")
    r = rows[order]
    at = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]]))
    out[r[at]] += np.add.reduceat(values[order], at, axis=0)


def _lookup(table: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in the sorted table, whether it is there)."""
    if not len(table):
        return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
    at = np.minimum(np.searchsorted(table, h), len(table) - 1)
    return at, table[at] == h


def _contexts(cls: np.ndarray, first: np.ndarray, start: int) -> np.ndarray:
    """The two classes before each token; ``start`` before a text's first."""
    before = np.full((len(cls), 2), start, np.int64)
    before[1:, 1] = cls[:-1]
    before[2:, 0] = cls[:-2]
    head = first[:-1]
    before[head, :] = start
    second = head + 1
    second = second[second < first[1:]]
    before[second, 0] = start
    return before


def score_documents(docs: DataFrame, classes: int = CLASSES, buckets: int | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    buckets = buckets or max(16, int(spark.conf.get("spark.sql.shuffle.partitions")))
    counts = count_words(docs, buckets)
    size = counts.agg(F.sum("distinct"), F.sum("total")).first()
    v, n = int(size[0] or 0), int(size[1] or 0)
    freq_h, freq_c = _frequent(counts, FREQUENT)
    top = np.lexsort((freq_h, -freq_c))
    top = top[freq_h[top] != END][: classes - 2]
    class_of = np.full(len(freq_h), classes - 1, np.int64)
    class_of[top] = np.arange(len(top))
    class_of[freq_h == END] = classes - 2
    ends = int(freq_c[freq_h == END].sum())
    rate = np.ones(classes)
    rate[: len(top)] += freq_c[top]
    rate[classes - 2] += ends
    other_n, other_v = n - int(freq_c[top].sum()) - ends, v - len(top) - (1 if ends else 0)
    rate[classes - 1] += other_n
    rate /= rate.sum()
    shared = spark.sparkContext.broadcast((freq_h, freq_c, class_of, rate))
    other = classes - 1

    def classify(h, f):
        at, there = _lookup(f[0], h)
        return at, there, np.where(there, f[2][at] if len(f[0]) else 0, np.where(h == END, other - 1, other))

    def train(batches):
        import pyarrow as pa

        f = shared.value
        model, rng, seen = LogBilinear(classes), np.random.default_rng(17), 0
        model.start_training()
        model.bias = np.log(f[3]).astype(np.float32)
        for batch, i, j, data, offsets in textcore.text_pieces(batches):
            h, first = _tokens(data, offsets)
            keep = ~held_out(batch.column("doc_id").slice(i, j - i).to_pylist())
            cls = classify(h, f)[2]
            before = _contexts(cls, first, classes)
            use = np.repeat(keep, np.diff(first))
            before, target = before[use], cls[use]
            for a in range(0, len(target), 8192):
                model.train(before[a : a + 8192], target[a : a + 8192], f[3], rng, 0.05)
            seen += len(target)
        if seen:  # the parameters weigh by tokens, whose number comes last
            own = np.append(np.frombuffer(model.to_bytes(), np.float32).astype(np.float64) * seen, seen)
            yield pa.RecordBatch.from_arrays([pa.array([own.tobytes()], pa.binary())], names=["p"])

    local = durable(docs.select("doc_id", "text").mapInArrow(train, "p binary"), "lm-replicas")
    model = LogBilinear(classes)
    total = textcore.summed(local, "p", np.float64, local.count())
    if total is not None:
        model.load(total[:-1] / total[-1])
    release(local)
    fitted = spark.sparkContext.broadcast(model)

    def score(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        f, m = shared.value, fitted.value
        log_c = np.log10(f[1] + 1.0)
        row, part = 0, TaskContext.get().partitionId()
        for batch, i, j, data, offsets in textcore.text_pieces(batches):
            h, first = _tokens(data, offsets)
            ids = batch.column("doc_id").slice(i, j - i)
            at, there, cls = classify(h, f)
            model_log = m.log_prob(_contexts(cls, first, classes), cls) / np.log(10)
            base = np.where(there, log_c[at] if len(log_c) else 0.0, 0.0)
            inside = (cls == other) & there
            sums = [np.add.reduceat(x, first[:-1]) for x in (there.astype(np.int64), base, model_log, np.where(inside, base, 0.0), (cls == other).astype(np.int64))]
            rows = (np.int64(part) << 36) + row + np.arange(j - i)
            row += j - i
            k = j - i
            none = pa.nulls(k, pa.binary())
            cols = [pa.nulls(k, pa.int32()), none, none, ids, pa.array(rows), pa.array(held_out(ids.to_pylist())), pa.array(np.diff(first).astype(np.int64)), pa.array(sums[0]), pa.array(sums[1]), pa.array(sums[2] + sums[3]), pa.array(sums[4])]
            yield pa.RecordBatch.from_arrays(cols, names=names)
            rare = np.flatnonzero(~there)
            if len(rare):
                order = np.argsort(h[rare])
                hr, rr = h[rare][order], np.repeat(rows, np.diff(first))[rare][order]
                got = [(b, hr[s].tobytes(), rr[s].tobytes()) for b, s in _by_bucket(hr, buckets)]
                g = len(got)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x[0] for x in got], pa.int32()), pa.array([x[1] for x in got], pa.binary()), pa.array([x[2] for x in got], pa.binary()), pa.nulls(g, pa.int64()), pa.nulls(g, pa.int64()), pa.nulls(g, pa.bool_()), *[pa.nulls(g, pa.int64())] * 2, *[pa.nulls(g, pa.float64())] * 2, pa.nulls(g, pa.int64())],
                    names=names,
                )

    names = ["bucket", "h", "r", "doc_id", "row", "held_out", "n_tokens", "known", "base", "model", "others"]
    scored = durable(docs.select("doc_id", "text").mapInArrow(score, "bucket int, h binary, r binary, doc_id long, row long, held_out boolean, n_tokens long, known long, base double, model double, others long"), "lm-scored")

    def look_up(batches):
        import pyarrow as pa

        table: dict[int, tuple] = {}
        waiting: list = []

        def answer(b, h, r):
            th, tc = table.get(b, (np.zeros(0, np.uint64), np.zeros(0, np.int64)))
            h, r = np.frombuffer(h, np.uint64), np.frombuffer(r, np.int64)
            at, there = _lookup(th, h)
            if not there.any():
                return None
            order = np.argsort(r[there], kind="stable")
            rows, logs = r[there][order], np.log10(tc[at][there][order] + 1.0)
            cut = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
            return pa.RecordBatch.from_arrays([pa.array(rows[cut]), pa.array(np.diff(np.append(cut, len(rows)))), pa.array(np.add.reduceat(logs, cut))], names=["row", "known", "logs"])

        for batch in batches:
            for b, h, r, c in zip(batch.column("bucket").to_pylist(), batch.column("h").to_pylist(), batch.column("r").to_pylist(), batch.column("c").to_pylist()):
                if c is not None:
                    table[b] = (np.frombuffer(h, np.uint64), np.frombuffer(c, np.int64))
                elif (out := answer(b, h, r)) is not None:
                    yield out

    rare = scored.where("bucket is not null").select("bucket", "h", "r", F.lit(None).cast("binary").alias("c"), F.lit(1).alias("kind"))
    held = counts.select("bucket", "h", F.lit(None).cast("binary").alias("r"), "c", F.lit(0).alias("kind"))
    asked = held.unionByName(rare).repartition(buckets, "bucket").sortWithinPartitions("bucket", "kind").drop("kind")
    found = asked.mapInArrow(look_up, "row long, known long, logs double").groupBy("row").agg(F.sum("known").alias("more"), F.sum("logs").alias("logs"))
    main = scored.where("bucket is null")
    logs, more = F.coalesce("logs", F.lit(0.0)), F.coalesce("more", F.lit(0))
    return main.join(found, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + more).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + logs - F.col("n_tokens") * F.log10(F.lit(float(n + v + 1)))).alias("base_score"),
        (F.col("model") + logs - F.col("others") * F.log10(F.lit(float(other_n + other_v + 1)))).alias("score"),
    )
