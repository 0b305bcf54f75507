"""Suffix-array dedup: a distributed, common-prefix-aware merge sort of text suffixes.

A byte goes when it lies in a string of ``SPAN`` bytes that also starts in a
document with a smaller doc_id.  Any such string has, among its grams of ``GRAM``
bytes, one of least hash, at the same place in both documents; so it is enough
to sort the suffixes that start at those anchors.

1. Every document's anchors go to hash buckets; an anchor stays when its gram
   occurs in two different texts.  (A gram that does not cannot be part of a
   shared string.)
2. The texts that keep anchors send, for each, the suffix from it on (cut at SPAN)
   and the bytes before it, as runs sorted by suffix and front coded: every entry
   holds only what differs from the one before it.  Entries with the same bytes
   on both sides collapse into the one of the smallest document.
3. A bucket merges its runs with a loser tree whose nodes remember the prefix
   each entry shares with the last winner, so no byte is compared twice.  The
   shared prefixes of neighbours in the merged order are the suffix array's LCP
   table; stretches of it with enough prefix, parted by the bytes to the left,
   are the sets of equal strings, and their smallest document keeps the string.

Equal texts are one text with the smallest of their doc_ids.

Defined results
* null text: no bytes; null doc_id: compared with nothing and kept whole
* texts shorter than SPAN bytes are kept; equal doc_ids never remove each other's bytes
* an empty table gives an empty table; extra columns are ignored
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.llm import textcore
from dossier.llm.durable import durable, release, settle

SPAN = 50
GRAM = 26
LEFT = SPAN - GRAM
_WIDTH = LEFT + 1  # grams in a string of SPAN bytes
_RUN = 1 << 18  # entries of a sorted run


def _slide(x: np.ndarray, width: int, op) -> np.ndarray:
    """``op`` (minimum or maximum) over every ``width`` neighbours."""
    step = 1
    while step * 2 <= width:
        x = op(x[:-step], x[step:])
        step *= 2
    return op(x[: len(x) - (width - step)], x[width - step :]) if step < width else x


def find_anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(byte position, gram hash) of the grams that are least within some SPAN bytes."""
    n = len(data)
    if n < SPAN:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    up, down = textcore._powers(n + 1)
    c = np.empty(n + 1, np.uint64)
    c[0] = 0
    np.cumsum(textcore._VALUE[data] * up[:n], out=c[1:])
    gram = textcore.mix((c[GRAM:] - c[:-GRAM]) * down[: n - GRAM + 1])
    short = (gram >> np.uint64(32)).astype(np.uint32)
    low = _slide(short, _WIDTH, np.minimum)
    pad = np.zeros(_WIDTH - 1, np.uint32)
    at = np.flatnonzero(_slide(np.concatenate([pad, low, pad]), _WIDTH, np.maximum) == short)
    end = offsets[1:][np.searchsorted(offsets[1:], at, side="right")]
    at = at[at + GRAM <= end]
    return at, gram[at]


def _digest(data) -> int:
    """The head of a text's SHA-256, as :func:`_named` has it natively."""
    return int(hashlib.sha256(data).hexdigest()[:15], 16)


def _named(docs: DataFrame, buckets: int, *more: str) -> DataFrame:
    """Long enough texts with their digest and text bucket: kind 1, bucket, blob (null), digest, text."""
    head = F.conv(F.substring(F.sha2("text", 256), 1, 15), 16, 10).cast("long")
    long_ = docs.where(f"doc_id is not null and octet_length(text) >= {SPAN}").withColumn("digest", head)
    bucket = F.pmod(F.xxhash64("digest"), F.lit(buckets)).cast("int")
    return long_.select(F.lit(1).alias("kind"), bucket.alias("bucket"), F.lit(None).cast("binary").alias("blob"), *more, "digest", "text")


_POST = np.dtype([("g", np.uint64), ("d", np.int64)])
_CUT = np.dtype([("d", np.int64), ("a", np.int64), ("b", np.int64)])


def _split(rows: np.ndarray, bucket: np.ndarray):
    order = np.argsort(bucket, kind="stable")
    b = bucket[order]
    at = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]])) if len(b) else np.zeros(0, np.int64)
    for x, y in zip(at, np.append(at[1:], len(b))):
        yield int(b[x]), rows[order[x:y]]


def _packed(pa, parts):
    import zstandard

    pack = zstandard.ZstdCompressor(level=1)
    rows = [(b, pack.compress(r if isinstance(r, bytes) else r.tobytes())) for b, r in parts]
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["bucket", "blob"])


def _unpacked(blob: bytes, dtype=None):
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(blob)
    return raw if dtype is None else np.frombuffer(raw, dtype)


def _shared_anchors(docs: DataFrame, buckets: int) -> DataFrame:
    """Durable rows (digest, blob of grams): the anchors whose gram is in two different texts."""

    def emit(batches):
        import pyarrow as pa

        held, size, seen = [], 0, set()

        def flush():
            rows = np.concatenate(held)
            return _packed(pa, _split(rows, (textcore.mix(rows["g"]) % np.uint64(buckets)).astype(np.int64)))

        for batch, i, j, data, offsets in textcore.text_pieces(batches):
            digest = np.array([_digest(data[a:b]) for a, b in zip(offsets[:-1], offsets[1:])], np.int64)
            fresh = np.ones(j - i, bool)
            for x, d in enumerate(digest.tolist()):  # a copy met in this partition adds nothing
                if d in seen:
                    fresh[x] = False
                elif len(seen) < 1 << 20:
                    seen.add(d)
            at, gram = find_anchors(data, offsets)
            of = np.searchsorted(offsets[1:], at, side="right")
            keep = fresh[of]
            rows = np.empty(int(keep.sum()), _POST)
            rows["g"], rows["d"] = gram[keep], digest[of[keep]]
            held.append(rows)
            size += len(rows)
            if size >= 1 << 20:
                yield flush()
                held, size = [], 0
        if size:
            yield flush()

    def shared(batches):
        import pyarrow as pa

        parts: dict[int, list] = {}
        for batch in batches:
            for b, x in zip(batch.column("bucket").to_pylist(), batch.column("blob").to_pylist()):
                parts.setdefault(b, []).append(x)
        for b in list(parts):
            rows = np.concatenate([_unpacked(x, _POST) for x in parts.pop(b)])
            order = np.lexsort((rows["d"], rows["g"]))
            g, d = rows["g"][order], rows["d"][order]
            first = np.concatenate([[True], (g[1:] != g[:-1]) | (d[1:] != d[:-1])])
            g, d = g[first], d[first]
            same = g[1:] == g[:-1]
            keep = np.concatenate([same, [False]]) | np.concatenate([[False], same])
            g, d = g[keep], d[keep]
            if not len(d):
                continue
            order = np.argsort(d, kind="stable")
            g, d = g[order], d[order]
            edge = np.flatnonzero(np.concatenate([[True], d[1:] != d[:-1]]))
            yield pa.RecordBatch.from_arrays([pa.array(d[edge]), pa.array([g[x:y].tobytes() for x, y in zip(edge, np.append(edge[1:], len(d)))], pa.binary())], names=["digest", "blob"])

    texts = docs.where(f"doc_id is not null and octet_length(text) >= {SPAN}").select("text")
    blobs = texts.mapInArrow(emit, "bucket int, blob binary").repartition(buckets, "bucket")
    return durable(blobs.mapInArrow(shared, "digest long, blob binary"), "suffix-anchors")


class Entries:
    """Anchor suffixes: right bytes (padded), left bytes (padded at the front), their lengths, document, position."""

    def __init__(self, right, left, nr, nl, rep, digest, pos):
        self.right, self.left, self.nr, self.nl, self.rep, self.digest, self.pos = right, left, nr, nl, rep, digest, pos

    COLUMNS = (("nr", np.uint8), ("nl", np.uint8), ("rep", np.int64), ("digest", np.int64), ("pos", np.int64))

    @classmethod
    def cut(cls, data: np.ndarray, begin: np.ndarray, end: np.ndarray, at: np.ndarray, rep, digest) -> Entries:
        """Entries at byte positions ``at`` of ``data``; begin and end bound each one's text."""
        pad = np.concatenate([np.zeros(LEFT, np.uint8), data, np.zeros(SPAN, np.uint8)])
        window = np.lib.stride_tricks.sliding_window_view(pad, LEFT + SPAN)[at]
        left, right = window[:, :LEFT].copy(), window[:, LEFT:].copy()
        nr, nl = np.minimum(end - at, SPAN), np.minimum(at - begin, LEFT)
        right[np.arange(SPAN)[None, :] >= nr[:, None]] = 0
        left[np.arange(LEFT)[None, :] < LEFT - nl[:, None]] = 0
        return cls(right, left, nr.astype(np.uint8), nl.astype(np.uint8), rep, digest, at - begin)

    def take(self, k) -> Entries:
        return Entries(self.right[k], self.left[k], self.nr[k], self.nl[k], self.rep[k], self.digest[k], self.pos[k])

    @staticmethod
    def join(parts: list[Entries]) -> Entries:
        return Entries(*[np.concatenate([getattr(p, n) for p in parts]) for n in ("right", "left", "nr", "nl", "rep", "digest", "pos")])

    def sorted(self) -> tuple[Entries, np.ndarray]:
        """(entries by right bytes, then left bytes, lengths and document; where both sides equal the entry before)."""
        wide = np.concatenate([self.right, self.left[:, ::-1], self.nr[:, None], self.nl[:, None]], axis=1)
        short = -wide.shape[1] % 8
        words = np.concatenate([wide, np.zeros((len(wide), short), np.uint8)], axis=1).view(">u8").astype(np.uint64)
        order = np.lexsort([self.rep, *[words[:, k] for k in range(words.shape[1] - 1, -1, -1)]])
        words = words[order]
        same = np.concatenate([[False], (words[1:] == words[:-1]).all(axis=1)]) if len(words) else np.zeros(0, bool)
        return self.take(order), same

    def to_run(self) -> bytes:
        """A front-coded run of sorted entries."""
        n = len(self.rep)
        lcp = _neighbour_lcp(self.right)
        kept = np.arange(SPAN)[None, :] >= lcp[:, None]
        head = np.array([n], np.int64).tobytes() + lcp.astype(np.uint8).tobytes()
        return head + b"".join(getattr(self, c).astype(t).tobytes() for c, t in self.COLUMNS) + self.left.tobytes() + self.right[kept].tobytes()

    @classmethod
    def from_run(cls, raw: bytes) -> tuple[Entries, np.ndarray]:
        """(entries, prefix each shares with the one before)."""
        n, at = int(np.frombuffer(raw, np.int64, 1)[0]), 8
        lcp = np.frombuffer(raw, np.uint8, n, at).astype(np.int64)
        at += n
        cols = {}
        for c, t in cls.COLUMNS:
            cols[c] = np.frombuffer(raw, t, n, at)
            at += n * np.dtype(t).itemsize
        left = np.frombuffer(raw, np.uint8, n * LEFT, at).reshape(n, LEFT)
        at += n * LEFT
        rest = np.frombuffer(raw, np.uint8, -1, at)
        begin = np.cumsum(SPAN - lcp) - (SPAN - lcp)
        right = np.empty((n, SPAN), np.uint8)
        source = np.zeros(n, np.int64)
        for k in range(SPAN):  # byte k was last spelt out by the latest entry that shares less than k + 1
            spelt = np.flatnonzero(lcp <= k)
            source[:] = 0
            source[spelt] = spelt
            who = np.maximum.accumulate(source)
            right[:, k] = rest[begin[who] + k - lcp[who]]
        return cls(right, left, cols["nr"], cols["nl"], cols["rep"], cols["digest"], cols["pos"]), lcp


def _neighbour_lcp(right: np.ndarray) -> np.ndarray:
    """Bytes each sorted entry shares with the one before (0 for the first)."""
    if not len(right):
        return np.zeros(0, np.int64)
    differ = right[1:] != right[:-1]
    lcp = np.where(differ.any(axis=1), differ.argmax(axis=1), SPAN)
    return np.concatenate([[0], lcp])


def merge_runs(runs: list[np.ndarray], lcps: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Loser-tree merge of sorted byte matrices: (run, index in it, prefix shared with the entry before).

    Every waiting entry carries the length it shares with the last winner.  Of
    two entries the one sharing more is the smaller; only where they share the
    same are bytes compared, and only from there on.
    """
    k = len(runs)
    total = sum(map(len, runs))
    out_run, out_at, out_lcp = np.empty(total, np.int32), np.empty(total, np.int64), np.empty(total, np.int64)
    if k == 1:
        return np.zeros(total, np.int32), np.arange(total), lcps[0]
    text = [r.tobytes() for r in runs]
    lcps = [x.tolist() for x in lcps]
    sizes = [len(r) for r in runs]
    leaves = 1
    while leaves < k:
        leaves *= 2
    at = [0] * k
    share = [0] * leaves  # with the last winner; -1: run is used up
    for r in range(leaves):
        if r >= k or not sizes[r]:
            share[r] = -1
    full = SPAN

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser) of two runs' entries; the loser's share becomes that with the winner."""
        x, y = share[a], share[b]
        if x > y:
            return a, b
        if y > x:
            return b, a
        if x < 0:
            return a, b
        pa, pb = at[a] * full, at[b] * full
        ta, tb = text[a][pa + x : pa + full], text[b][pb + x : pb + full]
        if ta == tb:
            share[max(a, b)] = full
            return (a, b) if a < b else (b, a)
        n = len(ta)
        same = n - ((int.from_bytes(ta, "big") ^ int.from_bytes(tb, "big")).bit_length() + 7) // 8
        if ta < tb:
            share[b] = x + same
            return a, b
        share[a] = x + same
        return b, a

    losers = [0] * leaves
    level = list(range(leaves))
    node = leaves // 2
    while node:
        winners = []
        for i in range(node):
            w, lost = play(level[2 * i], level[2 * i + 1])
            losers[node + i] = lost
            winners.append(w)
        level = winners
        node //= 2
    w = level[0]
    for n in range(total):
        out_run[n], out_at[n], out_lcp[n] = w, at[w], share[w]
        at[w] += 1
        if at[w] < sizes[w]:
            share[w] = s = lcps[w][at[w]]
        else:
            share[w] = s = -1
        node = (w + leaves) >> 1
        while node:
            lost = losers[node]
            x = share[lost]
            if x > s:
                losers[node], w, s = w, lost, x
            elif x == s and s >= 0:
                won, lost = play(w, lost)
                losers[node], w = lost, won
                s = share[w]
            node >>= 1
    return out_run, out_at, out_lcp


def shared_spans(e: Entries, lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(entry, first byte, end byte relative to the anchor) of what smaller documents hold too.

    ``e`` is in merged order and ``lcp`` its table.  For every split of SPAN into
    bytes left and right of the anchor, equal strings are a stretch of the order
    with that much shared prefix whose left bytes agree.
    """
    n = len(e.rep)
    most, least = np.full(n, -1), np.full(n, LEFT + 1)
    group = np.cumsum(lcp < GRAM)
    busy = np.zeros(n, bool)
    if n:
        edge = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        spread = np.minimum.reduceat(e.rep, edge) < np.maximum.reduceat(e.rep, edge)
        busy = np.repeat(spread, np.diff(np.append(edge, n)))
    k = np.flatnonzero(busy)
    lcp = lcp.copy()
    # entries that are alone in their group fall out; what is left keeps its neighbours' prefixes
    rep, nr, nl, left, lcp = e.rep[k], e.nr[k], e.nl[k], e.left[k], lcp[k]
    name = np.zeros(len(k), np.uint64)
    for a in range(LEFT + 1):
        if a:
            name = textcore.mix(name + left[:, LEFT - a].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(a))
        fits = np.flatnonzero((nl >= a) & (nr >= SPAN - a))
        if not len(fits):
            continue
        stretch = np.cumsum(lcp < SPAN - a)
        key = textcore.mix(name[fits] ^ textcore.mix(stretch[fits].astype(np.uint64)))
        order = np.argsort(key)
        s = key[order]
        edge = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
        low = np.repeat(np.minimum.reduceat(rep[fits][order], edge), np.diff(np.append(edge, len(s))))
        gone = k[fits[order[low < rep[fits][order]]]]
        most[gone] = np.maximum(most[gone], a)
        least[gone] = np.minimum(least[gone], a)
    hit = np.flatnonzero(most >= 0)
    return hit, -most[hit], SPAN - least[hit]


def _sorted_runs(docs: DataFrame, anchors: DataFrame, buckets: int) -> DataFrame:
    """(kind, bucket, blob): kind 1, front-coded runs by gram bucket; kind 2, spans already known."""

    def run(batches):
        import pyarrow as pa

        wanted: dict[int, list] = {}
        held, size = [], 0

        def flush():
            rows = Entries.join([h[0] for h in held])
            of = np.concatenate([h[1] for h in held])
            runs, cuts = [], []
            order = np.argsort(of, kind="stable")
            b = of[order]
            edge = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]]))
            for x, y in zip(edge, np.append(edge[1:], len(b))):
                e, same = rows.take(order[x:y]).sorted()
                if same.any():  # the same bytes on both sides: later documents lose all of them
                    lead = np.maximum.accumulate(np.where(same, 0, np.arange(len(same))))
                    later = np.flatnonzero(same & (e.rep > e.rep[lead]))
                    fits = (e.nl[later].astype(int) + e.nr[later]) >= SPAN
                    later = later[fits]
                    c = np.empty(len(later), _CUT)
                    c["d"], c["a"], c["b"] = e.digest[later], e.pos[later] - e.nl[later], e.pos[later] + e.nr[later]
                    cuts.append(c)
                    e = e.take(np.flatnonzero(~(same & (e.rep > e.rep[lead]))))
                runs.append((int(b[x]), e.to_run()))
            got = [_packed(pa, runs)]
            c = np.concatenate(cuts) if cuts else np.zeros(0, _CUT)
            out = [pa.RecordBatch.from_arrays([pa.array([1] * got[0].num_rows, pa.int32()), *got[0].columns], names=["kind", "bucket", "blob"])]
            if len(c):
                g = _packed(pa, [(0, c)])
                out.append(pa.RecordBatch.from_arrays([pa.array([2] * g.num_rows, pa.int32()), *g.columns], names=["kind", "bucket", "blob"]))
            return out

        for batch in batches:
            kinds = batch.column("kind").to_numpy(zero_copy_only=False)
            grams = batch.filter(pa.array(kinds == 0))
            for d, x in zip(grams.column("digest").to_pylist(), grams.column("blob").to_pylist()):
                wanted.setdefault(d, []).append(x)
            texts = batch.filter(pa.array(kinds == 1))
            if not texts.num_rows:
                continue
            for piece, i, j, data, offsets in textcore.text_pieces([texts]):
                digest = piece.column("digest").slice(i, j - i).to_numpy()
                ids = piece.column("doc_id").slice(i, j - i).to_numpy()
                at, gram = find_anchors(data, offsets)
                of = np.searchsorted(offsets[1:], at, side="right")
                edges = np.searchsorted(of, np.arange(j - i + 1))
                keep = np.zeros(len(at), bool)
                for x, d in enumerate(digest.tolist()):
                    # The first of equal texts has the smallest doc_id; it takes the anchors, its copies find none.
                    if (table := wanted.pop(d, None)) is not None:
                        keep[edges[x] : edges[x + 1]] = np.isin(gram[edges[x] : edges[x + 1]], np.frombuffer(b"".join(table), np.uint64))
                at, gram, of = at[keep], gram[keep], of[keep]
                if len(at):
                    held.append((Entries.cut(data, offsets[of], offsets[of + 1], at, ids[of], digest[of]), (textcore.mix(gram) % np.uint64(buckets)).astype(np.int64)))
                    size += len(at)
                if size >= _RUN:
                    yield from flush()
                    held, size = [], 0
        if size:
            yield from flush()

    null = F.lit(None)
    bucket = F.pmod(F.xxhash64("digest"), F.lit(buckets)).cast("int")
    known = anchors.select(F.lit(0).alias("kind"), bucket.alias("bucket"), "blob", null.cast("long").alias("doc_id"), "digest", null.cast("string").alias("text"))
    met = known.unionByName(_named(docs, buckets, "doc_id")).repartition(buckets, "bucket").sortWithinPartitions("bucket", "kind", "doc_id")
    return met.mapInArrow(run, "kind int, bucket int, blob binary")


def _merged_spans(runs: DataFrame, buckets: int) -> DataFrame:
    """Durable rows (digest, blob of spans): what smaller documents hold, span by span."""

    def by_text(c):
        import pyarrow as pa

        c = c[np.argsort(c["d"], kind="stable")]
        edge = np.flatnonzero(np.concatenate([[True], c["d"][1:] != c["d"][:-1]]))
        blobs = [np.stack([c["a"][x:y], c["b"][x:y]]).tobytes() for x, y in zip(edge, np.append(edge[1:], len(c)))]
        return pa.RecordBatch.from_arrays([pa.array(c["d"][edge]), pa.array(blobs, pa.binary())], names=["digest", "blob"])

    def run(batches):
        parts: dict[int, list] = {}
        for batch in batches:
            for kind, b, x in zip(batch.column("kind").to_pylist(), batch.column("bucket").to_pylist(), batch.column("blob").to_pylist()):
                if kind == 2:
                    yield by_text(_unpacked(x, _CUT))
                else:
                    parts.setdefault(b, []).append(x)
        for b in list(parts):
            got = [Entries.from_run(_unpacked(x)) for x in parts.pop(b)]
            which, at, lcp = merge_runs([g[0].right for g in got], [g[1] for g in got])
            base = np.cumsum([0] + [len(g[0].rep) for g in got])[:-1]
            e = Entries.join([g[0] for g in got]).take(base[which] + at)
            hit, a, z = shared_spans(e, lcp)
            if len(hit):
                c = np.empty(len(hit), _CUT)
                c["d"], c["a"], c["b"] = e.digest[hit], e.pos[hit] + a, e.pos[hit] + z
                yield by_text(c)

    # Known spans belong to no gram bucket; a hash of theirs deals them out.
    to = F.when(F.col("kind") == 1, F.col("bucket")).otherwise(F.pmod(F.xxhash64("blob"), F.lit(buckets)).cast("int"))
    dealt = runs.withColumn("to", to).repartition(buckets, "to").drop("to")
    return durable(dealt.mapInArrow(run, "digest long, blob binary"), "suffix-spans")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    spark = docs.sparkSession
    buckets = max(16, int(spark.conf.get("spark.sql.shuffle.partitions")))
    anchors = _shared_anchors(docs, buckets)
    settle(spark)
    spans = _merged_spans(_sorted_runs(docs, anchors, buckets), buckets)
    release(anchors)
    settle(spark)

    def cut(batches):
        import pyarrow as pa

        table: dict[int, list] = {}
        for batch in batches:
            kinds = batch.column("kind").to_numpy(zero_copy_only=False)
            found = batch.filter(pa.array(kinds == 0))
            for d, x in zip(found.column("digest").to_pylist(), found.column("blob").to_pylist()):
                table.setdefault(d, []).append(np.frombuffer(x, np.int64).reshape(2, -1))
            texts = batch.filter(pa.array(kinds == 1))
            if not texts.num_rows:
                continue
            out = []
            data, offsets = textcore.buffers(texts.column("text"))
            for x, d in enumerate(texts.column("digest").to_pylist()):
                if (cuts := table.pop(d, None)) is None:  # nothing to cut, or a copy already answered for
                    continue
                rows = np.concatenate(cuts, axis=1)
                rows = rows[:, np.lexsort(rows[::-1])]
                a, z = rows[0], np.maximum.accumulate(rows[1])
                first = np.flatnonzero(np.concatenate([[True], a[1:] > z[:-1]]))
                a, z = a[first], z[np.append(first[1:], len(z)) - 1]
                raw = data[offsets[x] : offsets[x + 1]].tobytes()
                kept, prior = hashlib.sha256(), 0
                for p, q in zip(a.tolist(), z.tolist()):
                    kept.update(raw[prior:p])
                    prior = q
                kept.update(raw[prior:])
                out.append((d, int((z - a).sum()), len(a), kept.hexdigest()))
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], pa.int64()), pa.array([o[3] for o in out])],
                    names=["digest", "removed", "spans", "kept"],
                )

    bucket = F.pmod(F.xxhash64("digest"), F.lit(buckets)).cast("int")
    known = spans.select(F.lit(0).alias("kind"), bucket.alias("bucket"), "blob", "digest", F.lit(None).cast("string").alias("text"))
    met = known.unionByName(_named(docs, buckets)).repartition(buckets, "bucket").sortWithinPartitions("bucket", "kind")
    partly = met.mapInArrow(cut, "digest long, removed long, spans long, kept string")
    whole_text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.octet_length(whole_text).cast("long").alias("n_bytes"), F.sha2(whole_text, 256).alias("sha"))
    rows = rows.withColumn("digest", F.conv(F.substring("sha", 1, 15), 16, 10).cast("long"))
    least = rows.where("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("rep"))
    per_text = least.join(partly, "digest", "left")
    met = rows.join(per_text, "digest", "left")
    long_, copy = F.col("n_bytes") >= SPAN, F.coalesce(F.col("doc_id") > F.col("rep"), F.lit(False))
    whole, part = long_ & copy, F.col("doc_id").isNotNull() & F.col("removed").isNotNull()
    return met.select(
        "doc_id", "n_bytes",
        F.when(whole, F.col("n_bytes")).when(part, F.col("removed")).otherwise(0).alias("n_removed"),
        F.when(whole, 1).when(part, F.col("spans")).otherwise(0).cast("long").alias("n_spans"),
        F.when(whole, hashlib.sha256().hexdigest()).when(part, F.col("kept")).otherwise(F.col("sha")).alias("kept_sha256"),
    )
