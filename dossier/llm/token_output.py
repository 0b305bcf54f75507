"""Token-id output: concatenated ids with Elias-Fano coded document boundaries.

A block file holds the ids of consecutive documents (16 bits each while the
vocabulary allows it, else 32), an Elias-Fano code of the documents' end
offsets and one of their ids.  A boundary costs about 2 + log2(ids/documents)
bits; sampled ones of the upper bitmap answer ``select`` without a 64-bit
offset table.  Blocks are rows of a Parquet table in the shared folder, so they
can be written and read wherever Spark can.

Defined results
* null text: the empty document, which has only its end id
* null doc_id: before all others; equal doc_ids: ordered by text
* an empty table: no blocks; other columns are ignored
"""

from __future__ import annotations

import gc
import struct
import zlib
from itertools import chain, repeat

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dossier.llm import textcore
from dossier.llm.durable import durable

END_ID = 2
BLOCK_IDS = 1 << 19
SAMPLE = 256
_MAGIC = b"EFB1"


class EliasFano:
    """A non-decreasing sequence of integers in [0, universe]."""

    def __init__(self, n: int, universe: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.universe, self.low_bits, self.low, self.high, self.samples = n, universe, low_bits, low, high, samples

    @classmethod
    def encode(cls, values: np.ndarray, universe: int) -> EliasFano:
        values = values.astype(np.uint64)
        n = len(values)
        low_bits = max(0, (universe // n).bit_length() - 1) if n else 0
        top = (values >> np.uint64(low_bits)).astype(np.int64)
        ones = top + np.arange(n)
        bits = np.zeros((universe >> low_bits) + n + 1, dtype=np.uint8)
        bits[ones] = 1
        parts = ((values[:, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
        return cls(n, universe, low_bits, np.packbits(parts.ravel(), bitorder="little"), np.packbits(bits, bitorder="little"), ones[::SAMPLE].astype(np.uint32))

    def to_bytes(self) -> bytes:
        head = struct.pack("<QQBQQQ", self.n, self.universe, self.low_bits, len(self.low), len(self.high), len(self.samples))
        return head + self.low.tobytes() + self.high.tobytes() + self.samples.tobytes()

    @classmethod
    def from_bytes(cls, raw: memoryview) -> tuple[EliasFano, int]:
        """The sequence and the number of bytes it took."""
        n, universe, low_bits, a, b, c = struct.unpack_from("<QQBQQQ", raw)
        at = struct.calcsize("<QQBQQQ")
        low = np.frombuffer(raw, np.uint8, a, at)
        high = np.frombuffer(raw, np.uint8, b, at + a)
        samples = np.frombuffer(raw, np.uint32, c, at + a + b)
        return cls(n, universe, low_bits, low, high, samples), at + a + b + 4 * c

    def select(self, i: int) -> int:
        """Value ``i``: scan the upper bitmap from the nearest sampled one."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at = int(self.samples[i // SAMPLE])
        left, byte = i % SAMPLE, at >> 3
        word = int(self.high[byte]) >> (at & 7) << (at & 7)
        while (ones := word.bit_count()) <= left:
            left -= ones
            byte += 1
            word = int(self.high[byte])
        for _ in range(left):
            word &= word - 1
        top = byte * 8 + (word & -word).bit_length() - 1 - i
        first, value = i * self.low_bits, 0
        for k in range(self.low_bits):
            value |= (int(self.low[(first + k) >> 3]) >> ((first + k) & 7) & 1) << k
        return top << self.low_bits | value

    def values(self) -> np.ndarray:
        """All values at once."""
        ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n]
        top = (ones - np.arange(self.n)).astype(np.uint64)
        if not self.low_bits:
            return top.astype(np.int64)
        bits = np.unpackbits(self.low, count=self.n * self.low_bits, bitorder="little").reshape(self.n, self.low_bits)
        low = (bits.astype(np.uint64) << np.arange(self.low_bits, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
        return (top << np.uint64(self.low_bits) | low).astype(np.int64)


def pack_block(doc_ids: list, counts: np.ndarray, ids: np.ndarray, wide: bool) -> bytes:
    """One block file; ``doc_ids`` ascend, nulls first."""
    nulls = sum(d is None for d in doc_ids)
    known = np.array(doc_ids[nulls:], dtype=np.int64)
    first = int(known[0]) if len(known) else 0
    ends = EliasFano.encode(np.cumsum(counts), int(counts.sum()))
    names = EliasFano.encode(known - first, int(known[-1]) - first if len(known) else 0)
    head = _MAGIC + struct.pack("<BQqQ", 4 if wide else 2, nulls, first, len(ids))
    return head + ends.to_bytes() + names.to_bytes() + ids.astype(np.uint32 if wide else np.uint16).tobytes()


def read_block(raw: bytes) -> tuple[list, EliasFano, np.ndarray]:
    """(doc ids, end offsets, ids) of a block file."""
    if raw[:4] != _MAGIC:
        raise ValueError("not a block of token ids")
    width, nulls, first, n = struct.unpack_from("<BQqQ", raw, 4)
    at, view = 4 + struct.calcsize("<BQqQ"), memoryview(raw)
    ends, used = EliasFano.from_bytes(view[at:])
    names, more = EliasFano.from_bytes(view[at + used :])
    ids = np.frombuffer(raw, np.uint16 if width == 2 else np.uint32, n, at + used + more)
    return [None] * nulls + (names.values() + first).tolist(), ends, ids


# What a byte says of its character: 0 nothing sure, 1 no white space, 2 letter, 3 digit, 4 other sign, 5 white space but a blank, 6 blank.
_KIND = np.zeros(256, np.uint8)
_KIND[0x21:0x7F] = 4
_KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = 2
_KIND[0x30:0x3A] = 3
_KIND[[0x09, 0x0A, 0x0D]] = 5
_KIND[0x20] = 6
_KIND[[*range(0xC3, 0xE1), *range(0xE4, 0xF5)]] = 1  # first bytes of characters; white space starts with C2, E1, E2 or E3


def cut_points(data: np.ndarray, offsets: np.ndarray, whole: tuple[bytes, ...] = ()) -> np.ndarray:
    """Where segments of UTF-8 texts start: places at which the byte-level pre-tokenizer always cuts, whatever follows.

    ``offsets`` bound the texts; no cut falls into one of the strings ``whole``, and what lies before one counts as a text's end.
    """
    kind = _KIND[data]
    raw = data.tobytes() if whole else b""
    for name in whole:
        at = raw.find(name)
        while at >= 0:
            kind[at : at + len(name)] = 0
            at = raw.find(name, at + 1)
    first = offsets[:-1][offsets[:-1] < len(data)]
    blank, plain = kind >= 5, (kind >= 2) & (kind <= 4)
    sure = (kind >= 1) & (kind <= 4)
    sure[first] = False
    cut = np.zeros(len(data), bool)
    cut[1:-1] = blank[1:-1] & sure[2:]  # the last white space before a character stands alone or goes with it
    cut[1:] |= blank[1:] & plain[:-1]  # white space begins
    cut[1:] |= (kind[:-1] == 5) & sure[1:]  # only a blank goes with what follows
    cut[1:] |= plain[1:] & plain[:-1] & (kind[1:] != kind[:-1]) & (data[:-1] != 0x27)  # after ' may stand 's, 't, 're
    cut[first] = True
    return np.flatnonzero(cut)


class SegmentEncoder:
    """Exact encoding of whole texts that runs the tokenizer once per distinct segment.

    Texts are cut where the byte-level pre-tokenizer always cuts.  Segments
    recur: those of one call are told apart by Arrow's dictionary encoding, and
    up to ``most`` are remembered.
    """

    def __init__(self, path: str, most: int = 700_000):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self.wide = self.tokenizer.get_vocab_size() > 1 << 16
        self.whole = tuple(t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values())
        self.index: dict = {}
        self.start, self.size, self.flat = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int32), np.zeros(1 << 18, np.uint32)
        self.used = 0

    def _room(self, segments: int, ids: int) -> None:
        while len(self.start) < segments:
            self.start, self.size = np.concatenate([self.start, self.start]), np.concatenate([self.size, self.size])
        while len(self.flat) < ids:
            self.flat = np.concatenate([self.flat, self.flat])

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts on end, number of ids of each text); ``data`` holds the texts' UTF-8 bytes, bounded by ``offsets``."""
        gc.disable()  # many short-lived lists, none in cycles
        try:
            return self._encode(data, offsets)
        finally:
            gc.enable()

    def _encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        import pyarrow as pa

        begin = cut_points(data, offsets, self.whole)
        bounds = np.append(begin, len(data)).astype(np.int32)
        coded = pa.StringArray.from_buffers(len(begin), pa.py_buffer(bounds), pa.py_buffer(data)).dictionary_encode()
        keys = coded.dictionary.to_numpy(zero_copy_only=False).tolist()  # faster than to_pylist
        found = np.fromiter(map(self.index.get, keys, repeat(-1)), np.int64, len(keys))
        kept, kept_ids = len(self.index), self.used
        miss = np.flatnonzero(found < 0)
        if len(miss):
            new = [keys[i] for i in miss.tolist()]
            found[miss] = kept + np.arange(len(new))
            ids = [e.ids for e in self.tokenizer.encode_batch_fast(new, add_special_tokens=False)]
            sizes = np.fromiter(map(len, ids), np.int32, len(ids))
            total = int(sizes.sum())
            self._room(kept + len(new), kept_ids + total)
            self.size[kept : kept + len(new)] = sizes
            self.start[kept : kept + len(new)] = kept_ids + np.cumsum(sizes) - sizes
            self.flat[kept_ids : kept_ids + total] = np.fromiter(chain.from_iterable(ids), np.uint32, total)
            if kept < self.most:
                self.index.update(zip(new, range(kept, kept + len(new))))
                self.used += total
        found = found[coded.indices.to_numpy()]
        sizes = self.size[found].astype(np.int64)
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        out = self.flat[np.repeat(self.start[found] - (ends - sizes), sizes) + np.arange(total)]
        return out, np.diff(np.concatenate([[0], ends])[np.searchsorted(begin, offsets)])


_ENCODERS: dict[str, SegmentEncoder] = {}


def _encoder(path: str) -> SegmentEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = SegmentEncoder(path)
    return _ENCODERS[path]


def write_blocks(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID, block_ids: int = BLOCK_IDS) -> DataFrame:
    """Encode ``docs`` (doc_id, text) in ascending doc_id order into a durable table of blocks.

    Columns: part, seq (together the order), n_docs, n_ids, block.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = docs.select("doc_id", "text").repartitionByRange(parts, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first())

    def encode(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        coder, part, seq = _encoder(tokenizer_path), TaskContext.get().partitionId(), 0
        names, counts, chunks, held = [], [], [], 0

        def flush():
            ids = np.concatenate(chunks)
            block = pack_block(names, np.array(counts, np.int64), ids, coder.wide)
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([len(names)], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([block], pa.binary())],
                names=["part", "seq", "n_docs", "n_ids", "block"],
            )

        for batch in batches:
            data, offsets = textcore.buffers(batch.column("text"))
            for at, to in textcore.pieces(offsets, 4 << 20):
                ids, sizes = coder.encode(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
                cut = np.cumsum(sizes)
                ids = np.insert(ids, cut, end_id)
                for name, a, n in zip(batch.column("doc_id").slice(at, to - at).to_pylist(), np.cumsum(sizes + 1) - sizes - 1, sizes + 1):
                    names.append(name)
                    counts.append(int(n))
                    chunks.append(ids[a : a + n])
                    held += int(n)
                    if held >= block_ids:
                        yield flush()
                        names, counts, chunks, held, seq = [], [], [], 0, seq + 1
        if names:
            yield flush()

    return durable(ordered.mapInArrow(encode, "part int, seq int, n_docs long, n_ids long, block binary"), "token-blocks")


def read_documents(blocks: DataFrame) -> DataFrame:
    """Per document, from the block files: doc_id, start, n_tokens, ids_crc32."""
    size = blocks.select("part", "seq", "n_ids")
    by_part = size.groupBy("part").agg(F.sum("n_ids").alias("n"))
    ahead = by_part.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("ahead"))
    inner = size.withColumn("inside", F.sum("n_ids").over(Window.partitionBy("part").orderBy("seq")) - F.col("n_ids"))
    starts = inner.join(ahead, "part").select("part", "seq", (F.col("ahead") + F.col("inside")).alias("base"))

    def decode(batches):
        import pyarrow as pa

        for batch in batches:
            for i in range(batch.num_rows):
                base = batch.column("base")[i].as_py()
                names, ends, ids = read_block(batch.column("block")[i].as_py())
                raw, crc, at = ids.astype("<u4"), [], [0]
                for k in range(ends.n):
                    at.append(ends.select(k))  # the boundary, from the coded block
                    crc.append(zlib.crc32(raw[at[k] : at[k + 1]]))
                at = np.array(at, np.int64)
                begin, ends = at[:-1], at[1:]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names, pa.int64()), pa.array(begin + base), pa.array(ends - begin), pa.array(crc, pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    placed = blocks.select("part", "seq", "block").join(starts, ["part", "seq"]).select("base", "block")
    return placed.mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long")
