"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes.

Both tokenizers encode one byte string.  Packed bitsets mark the bytes at which
their tokens end; their AND holds the shared cuts and their OR the ends of all
links, since between two neighbouring ends lies one token of each side.
Popcounts over 64-bit words with a running total (rank) turn a byte position
into a token number, and the positions of set bits (select) are the cuts
themselves, so token ranges and links follow without a search.

Texts are cut before runs of spaces, where neither tokenizer joins, and such
segments recur: each is encoded once while it is remembered, and a block of
documents aligns each of its distinct segments once.  A block stores its
distinct id pairs, the pairs of its segments and the segments of its documents.
The pairs' numbers are summed over all blocks; every block then gets back the
counts of the pairs that it holds and adds them up by document.  Nothing but
the highest count of each id of the second tokenizer, at most as many rows as
its vocabulary has, is broadcast.

Defined results
* null or empty text, or one that a tokenizer does not give back byte by byte
  (as U+2581, which the second one takes for a space): no tokens, zeros, ''
* every row is a document, also with a null or repeated doc_id
* an empty table gives an empty table; other columns are ignored
"""

from __future__ import annotations

import gc
import hashlib
import re
from itertools import chain, repeat

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.llm import textcore
from dossier.llm.durable import durable

BLOCK_BYTES = 2 << 20
TOGETHER = 64
#: Segments that are encoded or aligned at a time; what lies between texts and ids is held for so many.
SEGMENTS = 1 << 13
RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
_BLOCKS = (
    "block long, doc_id array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, groups_sha256 array<string>, "
    "pair array<long>, many array<long>, segment_sizes binary, segment_pairs binary, doc_sizes binary, doc_segments binary"
)


class Bits:
    """A packed bitset over byte positions with a rank directory."""

    def __init__(self, at: np.ndarray | None, size: int, words: np.ndarray | None = None):
        if words is None:
            flags = np.zeros(-(-size // 64) * 64, np.uint8)
            flags[at] = 1
            words = np.packbits(flags, bitorder="little").view(np.uint64)
        self.size, self.words = size, words
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])

    def __and__(self, other: Bits) -> Bits:
        return Bits(None, self.size, self.words & other.words)

    def __or__(self, other: Bits) -> Bits:
        return Bits(None, self.size, self.words | other.words)

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Number of set bits before each position."""
        word = at >> 6
        below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        inside = np.bitwise_count(self.words[np.minimum(word, len(self.words) - 1)] & below)
        return self.before[word] + np.where(word < len(self.words), inside, 0)

    def select(self) -> np.ndarray:
        """Positions of all set bits."""
        return np.flatnonzero(np.unpackbits(self.words.view(np.uint8), bitorder="little"))


def align(a_ends: np.ndarray, b_ends: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ends of A and B tokens in bytes, as sorted offsets up to ``size`` -> the alignment.

    Returns the ends of the shared groups as numbers of A and of B tokens, the A and B token of each link, and
    the number of groups that end before each link.
    """
    a, b = Bits(a_ends - 1, size), Bits(b_ends - 1, size)  # bit i: a token ends after byte i
    shared = a & b
    cuts = shared.select() + 1
    links = (a | b).select()
    return a.rank(cuts), b.rank(cuts), a.rank(links), b.rank(links), shared.rank(links)


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... of each range, on end."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


class _Table:
    """Bytes of every id of a tokenizer."""

    def __init__(self, tokens: list[bytes]):
        self.size = np.fromiter(map(len, tokens), np.int64, len(tokens))
        self.start = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        return self.flat[ranges(self.start[ids], self.size[ids])]


def _byte_level() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable bytes themselves, others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class _Ragged:
    """Growing list of id lists."""

    def __init__(self):
        self.start, self.size, self.flat, self.used = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64), np.zeros(1 << 14, np.int32), 0

    def put(self, at: int, order: np.ndarray, ids: np.ndarray, cut: np.ndarray) -> None:
        """List ``at + order[k]`` is the slice ``cut[k]`` of ``ids``."""
        while len(self.start) < at + len(order):
            self.start, self.size = np.concatenate([self.start, self.start]), np.concatenate([self.size, self.size])
        while len(self.flat) < self.used + len(ids):
            self.flat = np.concatenate([self.flat, self.flat])
        cut = cut.reshape(-1, 2)
        self.start[at + order], self.size[at + order] = self.used + cut[:, 0], cut[:, 1] - cut[:, 0]
        self.flat[self.used : self.used + len(ids)] = ids
        self.used += len(ids)

    def get(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the lists on end, size of each)."""
        return self.flat[ranges(self.start[at], self.size[at])].astype(np.int64), self.size[at]


class SegmentPairs:
    """Texts as numbers of remembered segments, with the ids that both tokenizers give each segment.

    A segment begins with a space and ends before the next run of spaces.  No piece of the second vocabulary holds a
    space after another character (checked here; otherwise texts stay whole), and the first pre-tokenizer joins none.
    """

    _INNER = re.compile(r" \s")
    _CUT = re.compile(r"(?<=\S)(?= )")

    def __init__(self, a_path: str, b_path: str, most: int = 200_000):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a, self.b, self.most = Tokenizer.from_file(a_path), SentencePieceProcessor(model_file=b_path), most
        self.a.encode_special_tokens = True  # their strings inside texts are plain text
        byte = _byte_level()
        special = {x.content for x in self.a.get_added_tokens_decoder().values()}
        names = [self.a.id_to_token(i) or "" for i in range(self.a.get_vocab_size())]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.a_bytes = _Table([n.encode() if n in special else bytes(byte[c] for c in n) for n in names])
        self.b_bytes = _Table([bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)])
        self.cuts = not any(re.search("[^▁]▁", p) for p in pieces)
        self.lone = [self.b.piece_to_id("▁")]
        # texts of ids with what follows them: a comma inside a side, | or ; at its end
        self.marks = [f"{i}{c}" for end in ("|", ";") for c in (",", end) for i in range(len(names if end == "|" else pieces))]
        self.index: dict = {}
        self.a_ids, self.b_ids, self.sound = _Ragged(), _Ragged(), np.zeros(0, bool)
        self.kept = (0, 0, 0)  # segments, A ids and B ids that are remembered; what lies beyond serves one call

    def _keys(self, text: str) -> list:
        """A string key stands for a space and itself, a tuple for its string."""
        whole = " " + text
        if not self.cuts:
            return [(whole,)]
        return [(s,) for s in self._CUT.split(whole)] if self._INNER.search(whole) else text.split(" ")

    def segments(self, texts: list) -> tuple[np.ndarray, np.ndarray]:
        """(segment numbers of all texts on end, number of segments of each text); valid until the next call."""
        kept, self.a_ids.used, self.b_ids.used = self.kept
        self.sound = self.sound[:kept]
        keys: list = []
        first = np.zeros(len(texts) + 1, np.int64)
        for i, t in enumerate(texts):
            if t:
                keys += self._keys(t)
            first[i + 1] = len(keys)
        found = np.fromiter(map(self.index.get, keys, repeat(-1)), np.int64, len(keys))
        miss = np.flatnonzero(found < 0)
        new: dict = {}
        found[miss] = np.fromiter((kept + new.setdefault(keys[i], len(new)) for i in miss.tolist()), np.int64, len(miss))
        fresh = [k[0] if type(k) is tuple else " " + k for k in new]
        for at in range(0, len(fresh), SEGMENTS):
            self._learn(fresh[at : at + SEGMENTS])
        if kept < self.most:
            self.index.update((k, kept + v) for k, v in new.items())
            self.kept = (len(self.sound), self.a_ids.used, self.b_ids.used)
        return found, np.diff(first)

    def _learn(self, new: list[str]) -> None:
        """Encode segments.  Those that end in a character other than white space are encoded on end, ``TOGETHER`` at a time."""
        at, own = len(self.sound), [s.encode() for s in new]
        sizes = np.fromiter(map(len, own), np.int64, len(own))
        alone = [i for i, s in enumerate(new) if s[-1].isspace() or not self.cuts]
        rest = sorted(set(range(len(new))).difference(alone)) if alone else list(range(len(new)))
        runs = [[i] for i in alone] + [rest[i : i + TOGETHER] for i in range(0, len(rest), TOGETHER)]
        order = np.fromiter(chain.from_iterable(runs), np.int64, len(new))
        texts = ["".join([new[i] for i in run]) for run in runs]
        a = [e.ids for e in self.a.encode_batch_fast(texts, add_special_tokens=False)]
        b = [self.lone if s == " " else ids for s, ids in zip(texts, self.b.encode([s[1:] for s in texts], num_threads=1))]
        sound = np.zeros(len(new), bool)
        many = np.fromiter(map(len, runs), np.int64, len(runs))
        cut_a, fine_a = self._parted(a, self.a_bytes, own, sizes, order, many)
        cut_b, fine_b = self._parted(b, self.b_bytes, own, sizes, order, many)
        fine = fine_a & fine_b
        for ids, lists, cut in ((self.a_ids, a, cut_a), (self.b_ids, b, cut_b)):
            ids.put(at, order, np.fromiter(chain.from_iterable(lists), np.int32), cut)
        sound[order[np.repeat(fine, many)]] = True
        self.sound = np.concatenate([self.sound, sound])
        again = [run for run, ok in zip(runs, fine.tolist()) if not ok and len(run) > 1]
        for i in chain.from_iterable(again):  # some segment of a run does not come back byte by byte
            a1, b1 = self.a.encode(new[i], add_special_tokens=False).ids, self.b.encode(new[i][1:])
            if all(bytes(t.joined(np.array(x, np.int64))) == own[i] for x, t in ((a1, self.a_bytes), (b1, self.b_bytes))):
                for ids, x in ((self.a_ids, a1), (self.b_ids, b1)):
                    ids.put(at + i, np.zeros(1, np.int64), np.array(x, np.int32), np.array([0, len(x)]))
                self.sound[at + i] = True

    @staticmethod
    def _parted(lists: list, table: _Table, own: list[bytes], sizes: np.ndarray, order: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of each segment begin and end within all ids of the runs, and the runs that come back byte by byte."""
        flat = np.fromiter(chain.from_iterable(lists), np.int64)
        ids = np.concatenate([[0], np.cumsum(np.fromiter(map(len, lists), np.int64, len(lists)))])
        ends = np.concatenate([[0], np.cumsum(table.size[flat])])
        want = np.concatenate([[0], np.cumsum(sizes[order])])
        last = np.cumsum(many)
        if not np.array_equal(ends[ids[1:]], want[last]):  # lengths differ somewhere: bring each run to its own length
            fine = np.diff(ends[ids]) == np.diff(want[np.concatenate([[0], last])])
            bytes_of = [bytes(table.joined(flat[i:j])) if ok else b"" for i, j, ok in zip(ids[:-1], ids[1:], fine)]
            shift = np.repeat(ends[ids[:-1]] - want[last - many], many)
            target = want[1:] + shift
            cut = np.searchsorted(ends, np.concatenate([[0], target]))
            fine &= np.add.reduceat(ends[np.minimum(cut[1:], len(ends) - 1)] != target, last - many) == 0
            parts = np.split(order, last[:-1])
            fine = np.array([ok and raw == b"".join([own[k] for k in part]) for ok, raw, part in zip(fine.tolist(), bytes_of, parts)], bool)
            bad = np.repeat(~fine, many)
            cut = np.stack([np.concatenate([[0], cut[1:-1]]), cut[1:]], axis=1)
            first = np.cumsum(many) - many
            cut[first, 0] = ids[:-1]
            cut[bad] = 0
            return cut, fine
        cut = np.searchsorted(ends, want)
        raw = np.frombuffer(b"".join([own[i] for i in order.tolist()]), np.uint8)
        same = np.concatenate([[0], np.cumsum(table.joined(flat) != raw)])[want[last]]
        fine = np.diff(same, prepend=0) == 0
        ok = ends[cut[1:]] == want[1:]  # a token that runs over a segment's end
        fine &= np.add.reduceat(~ok, last - many) == 0
        cut = np.stack([cut[:-1], cut[1:]], axis=1)
        cut[np.repeat(~fine, many)] = 0
        return cut, fine

    def aligned(self, segments: np.ndarray) -> dict:
        """For sound segments: their numbers of tokens, groups and links, the id pair of each link, and the groups' texts."""
        a, n_a = self.a_ids.get(segments)
        b, n_b = self.b_ids.get(segments)
        a_ends, b_ends = np.cumsum(self.a_bytes.size[a]), np.cumsum(self.b_bytes.size[b])
        group_a, group_b, link_a, link_b, _ = align(a_ends, b_ends, int(a_ends[-1]) if len(a_ends) else 0)
        last_a, last_b = np.cumsum(n_a), np.cumsum(n_b)
        ends = np.searchsorted(group_a, last_a) + 1  # a segment ends with a group
        last_link = np.searchsorted(link_a, last_a)
        # the tokens in the order of the groups, each with the mark that follows it
        many_a, many_b = np.diff(group_a, prepend=0), np.diff(group_b, prepend=0)
        place_a = np.arange(len(a)) + np.repeat(group_b - many_b, many_a)
        place_b = np.arange(len(b)) + np.repeat(group_a, many_b)
        closes_a, closes_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        closes_a[group_a - 1] = 1
        closes_b[group_b - 1] = 1
        order = np.empty(len(a) + len(b), np.int64)
        order[place_a] = a + closes_a * len(self.a_bytes.size)
        order[place_b] = b + closes_b * len(self.b_bytes.size) + 2 * len(self.a_bytes.size)
        marks = list(map(self.marks.__getitem__, order.tolist()))
        cut = (last_a + last_b).tolist()
        texts = ["".join(marks[i:j]) for i, j in zip([0, *cut], cut)]
        return {
            "n_a": n_a, "n_b": n_b, "n_groups": np.diff(ends, prepend=0), "n_links": np.diff(last_link, prepend=0),
            "pair": a[link_a] * len(self.b_bytes.size) + b[link_b], "texts": texts,
        }

    def block(self, texts: list) -> tuple[dict, list[str], np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Figures and group digests of documents; distinct id pairs and their numbers; pairs of segments; segments of documents."""
        flat, sizes = self.segments(texts)
        ends = np.cumsum(sizes)
        wrong = np.concatenate([[0], np.cumsum(~self.sound[flat])])
        good = (sizes > 0) & (wrong[ends] == wrong[ends - sizes])
        if not good.all():
            flat = flat[np.repeat(good, sizes)]
            sizes = np.where(good, sizes, 0)
            ends = np.cumsum(sizes)
        times = np.bincount(flat, minlength=len(self.sound))
        own = np.flatnonzero(times)
        local = np.zeros(len(times), np.int64)
        local[own] = np.arange(len(own))
        flat, times = local[flat], times[own]
        parts = [self.aligned(own[at : at + SEGMENTS]) for at in range(0, max(len(own), 1), SEGMENTS)]
        names = list(chain.from_iterable(p.pop("texts") for p in parts))
        got = {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}
        sums = {}
        for k in ("n_a", "n_b", "n_groups", "n_links"):
            run = np.concatenate([[0], np.cumsum(got[k][flat])])
            sums[k] = run[ends] - run[ends - sizes]
        shas = [hashlib.sha256("".join([names[k] for k in flat[e - n : e].tolist()])[:-1].encode()).hexdigest() if n else "" for e, n in zip(ends.tolist(), sizes.tolist())]
        pairs, where = np.unique(got["pair"], return_inverse=True)
        many = np.bincount(where, weights=np.repeat(times, got["n_links"]), minlength=len(pairs)).astype(np.int64)
        return sums, shas, pairs, many, got["n_links"], where, sizes, flat


_CODERS: dict[tuple[str, str], SegmentPairs] = {}


def _coder(a_path: str, b_path: str) -> SegmentPairs:
    if (a_path, b_path) not in _CODERS:
        _CODERS[a_path, b_path] = SegmentPairs(a_path, b_path)
    return _CODERS[a_path, b_path]


def _narrow(x: np.ndarray) -> bytes:
    """Numbers as 16 or 32 bits each, after the width."""
    wide = len(x) and int(x.max()) >= 1 << 16
    return (b"\4" if wide else b"\2") + x.astype(np.uint32 if wide else np.uint16).tobytes()


def _widen(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.uint32 if raw[0] == 4 else np.uint16, offset=1).astype(np.int64)


def align_blocks(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """A durable table with one row for each block of documents, of about ``BLOCK_BYTES`` of text or one longer text."""

    def encode(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        coder, block = _coder(a_path, b_path), TaskContext.get().partitionId() << 32
        for batch in batches:
            names, column = batch.column("doc_id").to_pylist(), batch.column("text")
            for i, j in textcore.pieces(textcore.buffers(column)[1], BLOCK_BYTES):
                gc.disable()  # millions of short-lived strings, none in cycles
                try:
                    sums, shas, pairs, many, per_segment, where, sizes, flat = coder.block(column.slice(i, j - i).to_pylist())
                finally:
                    gc.enable()
                one = [block, names[i:j], *(sums[k] for k in ("n_a", "n_b", "n_groups", "n_links")), shas, pairs, many, _narrow(per_segment), _narrow(where), _narrow(sizes), _narrow(flat)]
                kinds = [pa.int64(), *[pa.list_(pa.int64())] * 5, pa.list_(pa.string()), *[pa.list_(pa.int64())] * 2, *[pa.binary()] * 4]
                yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(one, kinds)], names=[c.split(" ")[0] for c in _BLOCKS.split(", ")])
                block += 1
                del sums, shas, pairs, many, per_segment, where, sizes, flat, one
                textcore.tidy()
            del batch, names, column
            textcore.tidy()

    return durable(docs.select("doc_id", "text").mapInArrow(encode, _BLOCKS), "align-blocks")


def pair_counts(blocks: DataFrame, b_size: int) -> DataFrame:
    """pair (A id * b_size + B id), many (links in the whole corpus), best (no pair of its B id has more)."""
    each = blocks.select(F.explode(F.arrays_zip("pair", "many")).alias("p")).select("p.pair", "p.many")
    counts = durable(each.groupBy("pair").agg(F.sum("many").alias("many")), "pair-counts")
    b = F.pmod("pair", F.lit(b_size)).alias("b")
    most = counts.groupBy(b).agg(F.max("many").alias("most"))  # at most b_size rows
    return counts.withColumn("b", b).join(F.broadcast(most), "b").select("pair", "many", (F.col("many") == F.col("most")).alias("best"))


def align_documents(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Per document (doc_id, text) of ``docs``: the columns of ``RESULT``."""
    from sentencepiece import SentencePieceProcessor

    blocks = align_blocks(docs, a_path, b_path)
    counts = pair_counts(blocks, SentencePieceProcessor(model_file=b_path).get_piece_size())
    held = blocks.select("block", F.posexplode("pair").alias("at", "pair"))
    known = held.join(counts, "pair").groupBy("block").agg(F.collect_list(F.struct("at", "many", "best")).alias("known"))
    asked = blocks.drop("pair", "many").join(known, "block", "left")

    def add_up(batches):
        import pyarrow as pa

        for batch in batches:
            for i in range(batch.num_rows):
                row = lambda name: batch.column(name)[i]
                links, where, sizes, flat = (_widen(row(c).as_py()) for c in ("segment_sizes", "segment_pairs", "doc_sizes", "doc_segments"))
                many, best = np.zeros(0, np.int64), np.zeros(0, np.int64)
                if row("known").is_valid:
                    known = row("known").values
                    at = known.field("at").to_numpy()
                    many, best = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
                    many[at] = known.field("many").to_numpy()
                    best[at] = known.field("best").to_numpy(zero_copy_only=False)
                out = []
                for x in (best, many):
                    run = np.concatenate([[0], np.cumsum(x[where])])
                    ends = np.cumsum(links)
                    by_segment = run[ends] - run[ends - links]
                    run = np.concatenate([[0], np.cumsum(by_segment[flat])])
                    ends = np.cumsum(sizes)
                    out.append(run[ends] - run[ends - sizes])
                own = [row(c).values for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")]
                yield pa.RecordBatch.from_arrays([*own[:5], *map(pa.array, out), own[5]], names=[c.split(" ")[0] for c in RESULT.split(", ")])

    return asked.mapInArrow(add_up, RESULT)


