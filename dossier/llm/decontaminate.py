"""Benchmark decontamination by latent semantic retrieval and subsequence checks.

1. Every document becomes a row of 32-bit word hashes (letters and digits only,
   lower case).  The same pass counts, over all passages of ``PASSAGE`` words, in
   how many each of ``FEATURES`` hashed terms occurs.
2. A randomised SVD of the TF-IDF passages gives the latent basis.  Each
   partition adds its share of A'(A R) for a random R; a small eigenproblem on the
   driver finishes it.  All passages fit the basis, in blocks of ``FIT_ROWS``; at
   most ``FIT_PARTS`` tasks each send one sum of 1.3 MB.
3. Every window of 2 x ``HALF`` words of every document is projected (sums of
   half windows, since the projection is linear) and compared by cosine with the
   benchmark items, the stated query set, in blocks of ``ITEM_BLOCK``.  Windows
   that the cosine misses are found exactly: where ``need`` words of an item of m
   stand in order, one of its m - need + 1 rarest stands too, so every window
   around such a word that has enough words of the item is a candidate.
4. A candidate counts when the longest common subsequence of the item and the
   words around the window covers ``LCS_SHARE`` of the item, and that of the item's
   answer (its last quarter, at least four words) ``ANSWER_SHARE`` of the answer.
   Words of the item that stand unbroken over ``LCS_SHARE`` of it count without the answer.

Defined results
* null or empty text: not contaminated; items without words match nothing
* documents shorter than a window form one window
* repeated rows are judged each; ties between items go to the smallest item_id
* item_ids lists all items that a document holds, each once; equal item_ids are items of their own until then
* an empty corpus or benchmark: nothing is contaminated; extra columns are ignored
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.llm import textcore
from dossier.llm.durable import durable, numbered, release

FEATURES = 4096
LATENT = 64
PASSAGE = 64
HALF = 16
FIT_ROWS = 256
FIT_PARTS = 64
ITEM_BLOCK = 1024
COSINE = 0.42
LCS_SHARE = 0.7
ANSWER_SHARE = 0.6

_LETTER = np.ones(256, bool)
_LETTER[:48] = _LETTER[58:65] = _LETTER[91:97] = _LETTER[123:128] = False


def word_ids(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(32-bit word hashes, first word of each document); punctuation parts words."""
    h, bounds = textcore.words(np.where(_LETTER[data], data, np.uint8(32)), offsets)
    return (h >> np.uint64(32)).astype(np.uint32), bounds


def _passages(bounds: np.ndarray) -> np.ndarray:
    """Passage number of every word; passages never cross documents."""
    size = np.diff(bounds)
    many = -(-size // PASSAGE)
    base = np.cumsum(many) - many
    inside = np.arange(bounds[-1] - bounds[0]) - np.repeat(bounds[:-1] - bounds[0], size)
    return np.repeat(base, size) + inside // PASSAGE


def _distinct(passage: np.ndarray, feature: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(passage, feature, count) of the distinct pairs, sorted."""
    key = np.sort(passage.astype(np.int64) * FEATURES + feature)
    at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return key[at] // FEATURES, key[at] % FEATURES, np.diff(np.append(at, len(key)))


def _read_words(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, words) and, with doc_id null and tally set, the term counts of each partition."""

    def run(batches):
        import pyarrow as pa

        tally = np.zeros((2, FEATURES), np.int64)
        total = 0
        for batch, i, j, data, offsets in textcore.text_pieces(batches):
            w, bounds = word_ids(data, offsets)
            f = (w % FEATURES).astype(np.int64)
            p = _passages(bounds)
            tally[0] += np.bincount(_distinct(p, f)[1], minlength=FEATURES)
            tally[1] += np.bincount(f, minlength=FEATURES)
            total += int(-(-np.diff(bounds) // PASSAGE).sum()) if len(w) else 0
            k = j - i
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, k), pa.array([w[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:])], pa.binary()), pa.nulls(k, pa.binary()), pa.nulls(k, pa.int64())], names=names)
        if total:
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([tally.tobytes()], pa.binary()), pa.array([total], pa.int64())], names=names)

    names = ["doc_id", "words", "tally", "passages"]
    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, words binary, tally binary, passages long")


def _term_counts(read: DataFrame) -> tuple[np.ndarray, int]:
    """(2 x FEATURES counts, passages) of the whole corpus."""
    tallies = read.where("tally is not null")
    acc = textcore.summed(tallies, "tally", np.int64, tallies.count())
    passages = tallies.agg(F.sum("passages")).first()[0] or 0
    return (np.zeros((2, FEATURES), np.int64) if acc is None else acc.reshape(2, FEATURES)), passages


def _fit_basis(read: DataFrame, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Randomised SVD in one pass: (FEATURES x LATENT right vectors, singular values) of the TF-IDF passages of all ``read`` words."""
    wide = LATENT + 16
    probe = np.linalg.qr(np.random.default_rng(21).normal(size=(FEATURES, wide)))[0]
    shared = read.sparkSession.sparkContext.broadcast((idf.astype(np.float32), probe.astype(np.float32)))

    def part(batches):
        import pyarrow as pa

        weights, r = shared.value
        acc, share = np.zeros((FEATURES, wide), np.float64), np.empty((FEATURES, wide), np.float32)
        rows = np.zeros((FIT_ROWS, FEATURES), np.float32)
        for batch in batches:
            data, offsets = textcore.buffers(batch.column("words"))
            w, bounds = data.view(np.uint32), offsets // 4
            for i, j in textcore.pieces(bounds, FIT_ROWS * PASSAGE):
                own = bounds[i : j + 1]
                p, f, c = _distinct(_passages(own), (w[own[0] : own[-1]] % FEATURES).astype(np.int64))
                if not len(p):
                    continue
                a = c * weights[f]
                a = (a / np.maximum(np.sqrt(np.bincount(p, a * a)), 1e-30)[p]).astype(np.float32)
                for n in range(0, int(p[-1]) + 1, FIT_ROWS):
                    x, y = np.searchsorted(p, (n, n + FIT_ROWS))
                    at, f_, a_ = p[x:y] - n, f[x:y], a[x:y]
                    met = np.take(r, f_, axis=0)
                    met *= a_[:, None]
                    met = np.add.reduceat(met, np.flatnonzero(np.diff(at, prepend=-1)), axis=0)
                    own_rows = rows[: len(met)]
                    own_rows[at, f_] = a_
                    acc += np.matmul(own_rows.T, met, out=share)
                    own_rows[at, f_] = 0
            del data, w
            textcore.tidy()
        yield pa.RecordBatch.from_arrays([pa.array([acc.astype(np.float32).tobytes()], pa.binary())], names=["y"])

    corpus = read.where("words is not null").select("words").coalesce(FIT_PARTS)
    acc = textcore.summed(corpus.mapInArrow(part, "y binary"), "y", np.float32, FIT_PARTS)
    shared.unpersist()
    return nystrom(np.zeros((FEATURES, wide)) if acc is None else acc.reshape(FEATURES, wide).astype(np.float64), probe)


def nystrom(y: np.ndarray, probe: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(LATENT eigenvectors, square roots of their values) of the matrix whose product with ``probe`` is ``y``."""
    core = probe.T @ y
    values, turn = np.linalg.eigh((core + core.T) / 2)
    left, size, _ = np.linalg.svd((y @ turn) / np.sqrt(np.maximum(values, 1e-5 * max(values[-1], 1e-9))), full_matrices=False)
    return left[:, :LATENT], np.maximum(size[:LATENT], 1e-9)


def lcs_length(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence, one bit of a big integer per word of ``a``."""
    place: dict[int, int] = {}
    for i, x in enumerate(a.tolist()):
        place[x] = place.get(x, 0) | 1 << i
    full = row = (1 << len(a)) - 1
    for x in b.tolist():
        if m := place.get(x):
            u = row & m
            row = (row + u | row - u) & full
    return len(a) - row.bit_count()


def need(m: int) -> int:
    """Least common subsequence of an item of ``m`` words that reaches LCS_SHARE."""
    return next(k for k in range(m + 1) if k / m >= LCS_SHARE)


def anchors(items: list, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, item number) of the words of which a match holds one at least, by word, and a filter over their low 16 bits.

    ``counts`` holds how often each hashed term occurs; rare words make few candidates.
    """
    pairs = [(x, n) for n, (_, w) in enumerate(items) for x in set(w[np.lexsort((w, counts[w % FEATURES]))[: len(w) - need(len(w)) + 1]].tolist())]
    pairs.sort()
    word, number = np.array([p[0] for p in pairs], np.uint32), np.array([p[1] for p in pairs], np.int64)
    maybe = np.zeros(1 << 16, bool)
    maybe[word & 0xFFFF] = True
    return word, number, maybe


def _anchored(group: list[int], words: list[np.ndarray], anchor: tuple, listed: list[list[int]], hits: list[dict]) -> None:
    """Note for every document of the group all windows that can reach LCS_SHARE of an item."""
    key, number, maybe = anchor
    if not len(key):
        return
    every = np.concatenate([words[k] for k in group])
    start = np.cumsum([0] + [len(words[k]) for k in group])
    place = np.flatnonzero(maybe[every & 0xFFFF])
    lo, hi = np.searchsorted(key, every[place]), np.searchsorted(key, every[place], side="right")
    place, lo, hi = place[hi > lo], lo[hi > lo], hi[hi > lo]
    owner = np.searchsorted(start, place, side="right") - 1
    met: dict[int, dict[int, list[int]]] = {}
    for d, p, x, y in zip(owner.tolist(), (place - start[owner]).tolist(), lo.tolist(), hi.tolist()):
        of_doc = met.setdefault(d, {})
        for n in number[x:y].tolist():
            of_doc.setdefault(n, []).append(p)
    for d, of_doc in met.items():
        w = words[group[d]]
        whole = set(w.tolist())
        for n, places in of_doc.items():
            item = listed[n]
            m, least = len(item), need(len(item))
            if sum(x in whole for x in item) < least:
                continue
            windows = set()
            for p in places:
                near = set(w[max(0, p - 2 * (m + HALF)) : p + 2 * (m + HALF)].tolist())
                if sum(x in near for x in item) >= least:  # windows that hold place p
                    windows.update(range(max(0, -(-(p - 2 * HALF - m + 1) // HALF)) * HALF, min(p + m + 1, len(w)), HALF))
            if windows:
                found = hits[group[d]]
                found[n] = sorted(windows.union(found.get(n, ())))


def longest_run(a: np.ndarray, b: np.ndarray) -> int:
    """Most words of ``a`` that stand unbroken in ``b``."""
    best, row = 0, np.zeros(len(b) + 1, np.int64)
    for x in a:
        row[1:] = np.where(b == x, row[:-1] + 1, 0)
        best = max(best, int(row.max()))
    return best


def _judge(words: np.ndarray, at: int, item: np.ndarray, listed: list[int]) -> tuple[bool, float, float]:
    """(leak, share of the item, share of its answer) found in order around a window."""
    m = len(item)
    near = words[max(0, at - m) : at + 2 * HALF + m]
    seen = set(near.tolist())
    if sum(x in seen for x in listed) < LCS_SHARE * m:  # no subsequence can be longer
        return False, 0.0, 0.0
    answer = item[-max(4, m // 4) :]
    share, told = lcs_length(item, near) / m, lcs_length(answer, near) / len(answer)
    return share >= LCS_SHARE and (told >= ANSWER_SHARE or longest_run(item, near) >= LCS_SHARE * m), share, told


def _item_blocks(benchmark: DataFrame):
    """Lists of at most ITEM_BLOCK (item_id, words); the driver holds one at a time."""
    block: list = []
    for r in benchmark.select("item_id", "text").where("item_id is not null and text is not null").orderBy("item_id", "text").toLocalIterator():
        raw = np.frombuffer(r.text.encode(), np.uint8)
        w, _ = word_ids(raw, np.array([0, len(raw)]))
        if len(w):
            block.append((r.item_id, w))
        if len(block) == ITEM_BLOCK:
            yield block
            block = []
    yield block


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, contaminated, item_id, item_share, answer_share (of the best item) and item_ids (all that leak) of every document."""
    spark = docs.sparkSession
    read, row = numbered(_read_words(docs), "decon-words")
    (df, cf), passages = _term_counts(read)
    idf = np.log((1 + passages) / (1 + df))
    vectors, sigma = _fit_basis(read, idf)
    table = idf[:, None] * vectors / (sigma / sigma[0] + 1e-3)
    table = (table - (cf[:, None] * table).sum(axis=0) / max(cf.sum(), 1)).astype(np.float32)
    found = []
    for block in _item_blocks(benchmark):
        if block or not found:
            found.append(durable(_search(read, row, table, cf, block, spark), "decon-result"))
    release(read)
    out = found[0]
    if len(found) > 1:
        for part in found[1:]:
            out = out.unionByName(part)
        best = F.struct("contaminated", "item_share", (-F.col("item_id")).alias("i"), "item_id", "answer_share")
        out = out.groupBy(row).agg(F.first("doc_id").alias("doc_id"), F.max(best).alias("b"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("item_ids"))
        out = out.select("doc_id", "b.contaminated", "b.item_id", "b.item_share", "b.answer_share", "item_ids")
    return out.select("doc_id", "contaminated", "item_id", "item_share", "answer_share", "item_ids")


def _search(read: DataFrame, row: str, table: np.ndarray, counts: np.ndarray, items: list, spark) -> DataFrame:
    """row, doc_id, contaminated, item_id, item_share, answer_share, item_ids over the ``items``."""
    latent = np.stack([table[w % FEATURES].sum(axis=0) for _, w in items]) if items else np.zeros((0, LATENT), np.float32)
    latent /= np.maximum(np.sqrt((latent * latent).sum(axis=1)), 1e-9)[:, None]
    padded = np.concatenate([table, np.zeros((1, table.shape[1]), np.float32)])
    shared = spark.sparkContext.broadcast((padded, latent.astype(np.float32), items, anchors(items, counts)))

    def run(batches):
        import pyarrow as pa

        t, q, asked, anchor = shared.value
        listed = [item.tolist() for _, item in asked]
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                b = batch.slice(at, 256)
                raw = b.column("words").to_pylist()
                words = [np.frombuffer(x, np.uint32) for x in raw]
                hits: list[dict] = [{} for _ in words]
                group, size = [], 0
                for k, w in enumerate(words):  # about a million words at a time
                    group.append(k)
                    size += len(w)
                    if size >= 1 << 18 or k == len(words) - 1:
                        _candidates(group, words, t, q, hits)
                        _anchored(group, words, anchor, listed, hits)
                        group, size = [], 0
                out = []
                for w, found in zip(words, hits):
                    best, held = (False, None, 0.0, 0.0), set()
                    for n in sorted(found):
                        item_id, item = asked[n]
                        leak, share, told = max((_judge(w, p, item, listed[n]) for p in found[n]), default=(False, 0.0, 0.0))
                        if leak:
                            held.add(item_id)
                        if (leak, share) > (best[0], best[2]):
                            best = (leak, item_id, share, told)
                    out.append((*best, sorted(held)))
                kinds = (pa.bool_(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([b.column("row"), b.column("doc_id"), *[pa.array([o[k] for o in out], kind) for k, kind in enumerate(kinds)]], names=names)

    names = [row, "doc_id", "contaminated", "item_id", "item_share", "answer_share", "item_ids"]
    return read.where("words is not null").select(F.col(row).alias("row"), "doc_id", "words").mapInArrow(
        run, f"{row} long, doc_id long, contaminated boolean, item_id long, item_share double, answer_share double, item_ids array<long>")


def _candidates(group: list[int], words: list[np.ndarray], table: np.ndarray, q: np.ndarray, hits: list[dict]) -> None:
    """Note for every document of the group the windows whose cosine with an item is high."""
    some = [k for k in group if len(words[k])]
    if not some or not len(q):
        return
    size = np.array([len(words[k]) for k in some])
    halves = -(-size // HALF)
    owner = np.repeat(np.arange(len(some)), halves)
    inside = np.arange(halves.sum()) - np.repeat(np.cumsum(halves) - halves, halves)
    feature = np.full(halves.sum() * HALF, FEATURES, np.int64)  # the row past the table is zero
    first = np.cumsum(halves * HALF) - halves * HALF
    feature[np.arange(size.sum()) + np.repeat(first - (np.cumsum(size) - size), size)] = np.concatenate([words[k] for k in some]) % FEATURES
    feature = feature.reshape(-1, HALF)
    z = table[feature[:, 0]]
    row = np.empty_like(z)
    for k in range(1, HALF):
        z += np.take(table, feature[:, k], axis=0, out=row)
    pair = np.zeros_like(z)
    pair[:-1] = z[1:]
    pair[np.cumsum(halves) - 1] = 0  # the last half of a document stands alone
    z = z + pair
    z /= np.maximum(np.sqrt((z * z).sum(axis=1)), 1e-9)[:, None]
    for a in range(0, len(z), 8192):
        x, n = np.nonzero(z[a : a + 8192] @ q.T >= COSINE)
        for w, item in zip((x + a).tolist(), n.tolist()):
            hits[some[owner[w]]].setdefault(item, []).append(int(inside[w]) * HALF)
