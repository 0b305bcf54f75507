"""Words and shingles of whole text columns as 64-bit hashes, vectorised over Arrow buffers.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D, with A-Z
lower-cased; UTF-8 continuation bytes never fall into those ranges, so this is
the same as matching characters.  A hash is a polynomial over random 64-bit
values of the bytes, finished by a bijective mixer.
"""

from __future__ import annotations

import math

import numpy as np

from dossier.functions.arrow import tidy

U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """SplitMix64 finaliser (a bijection of 64-bit values)."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def _stream(seed: int, n: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=U) * U(0x9E3779B97F4A7C15) + U(seed))


_B = np.arange(256)
SPACE = (_B == 0x20) | ((_B >= 0x09) & (_B <= 0x0D))
LOWER = np.where((_B >= 65) & (_B <= 90), _B + 32, _B).astype(np.uint8)
_VALUE = _stream(11, 256)
_LOWER_VALUE = _VALUE[LOWER]
_BASE = U(0x2545F4914F6CDD1D)
_BASE_INV = U(pow(0x2545F4914F6CDD1D, -1, 1 << 64))
SHINGLE = _stream(23, 8) | U(1)

_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _POWERS or len(_POWERS["up"]) < n:
        size = max(n, 1 << 16)
        for name, base in (("up", _BASE), ("down", _BASE_INV)):
            p = np.full(size, base, dtype=U)
            p[0] = 1
            _POWERS[name] = np.cumprod(p, dtype=U)
    return _POWERS["up"], _POWERS["down"]


def buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string or binary array; a null is empty."""
    import pyarrow as pa

    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offs, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offs, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    if column.null_count:  # a null slot may cover bytes
        keep = column.is_valid().to_numpy(zero_copy_only=False)
        sizes = np.where(keep, np.diff(offsets), 0)
        if sizes.sum() != offsets[-1] - offsets[0]:
            raw = np.concatenate([raw[a:b] for a, b, k in zip(offsets[:-1], offsets[1:], keep) if k] or [np.zeros(0, np.uint8)])
            offsets = np.concatenate([[0], np.cumsum(sizes)])
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(offsets: np.ndarray, most: int = 1 << 20):
    """Consecutive runs (i, j) of documents of about ``most`` bytes; a longer document stands alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end byte of every word; words never cross documents."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    solid = ~SPACE[data]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = solid[:-1]
    cut = offsets[:-1]
    before[cut[cut < n]] = False
    starts = np.flatnonzero(solid & ~before)
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = solid[1:]
    cut = offsets[1:]
    after[cut[cut > 0] - 1] = False
    return starts, np.flatnonzero(solid & ~after) + 1


def hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of the lower-cased bytes of every word."""
    n = len(data)
    up, down = _powers(n + 1)
    c = np.empty(n + 1, dtype=U)
    c[0] = 0
    np.cumsum(_LOWER_VALUE[data] * up[:n], out=c[1:])
    return mix((c[ends] - c[starts]) * down[starts] + U(1))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word hashes, index of each document's first word and one past the last)."""
    if len(data) > 1 << 23 and len(offsets) == 2:  # one very long document, in blocks
        at, parts = 0, []
        while at < len(data):
            end = min(at + (1 << 22), len(data))
            while end < len(data) and not SPACE[data[end]]:
                step = data[end : end + 4096]
                gap = np.flatnonzero(SPACE[step])
                end += int(gap[0]) if len(gap) else len(step)
            block = data[at:end]
            s, e = word_bounds(block, np.array([0, len(block)]))
            parts.append(hash_words(block, s, e))
            at = end
        h = np.concatenate(parts)
        return h, np.array([0, len(h)])
    s, e = word_bounds(data, offsets)
    return hash_words(data, s, e), np.searchsorted(s, offsets)


def shingle_sums(h: np.ndarray, k: int = 5) -> np.ndarray:
    """Hash of the k words from each position on (shorter by k-1 than ``h``)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    s = h[:n] * SHINGLE[0]
    for i in range(1, k):
        s += h[i : i + n] * SHINGLE[i]
    return mix(s)


def shingle_sets(h: np.ndarray, bounds: np.ndarray, k: int = 5) -> list[np.ndarray]:
    """Each document's distinct k-word shingles, sorted; fewer words form one shingle."""
    s = shingle_sums(h, k)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        m = b - a
        if m >= k:
            x = np.sort(s[a : b - k + 1])
            if len(x) > 1:
                x = x[np.concatenate([[True], x[1:] != x[:-1]])]
        elif m:
            x = mix((h[a:b] * SHINGLE[:m]).sum(dtype=U, keepdims=True) + U(m))
        else:
            x = np.zeros(0, U)
        out.append(x)
    return out


def text_pieces(batches, column: str = "text", most: int = 1 << 19):
    """For every Arrow batch and run of documents: (batch, first row, last row + 1, bytes, offsets)."""
    for batch in batches:
        data, offsets = buffers(batch.column(column))
        for i, j in pieces(offsets, most):
            yield batch, i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        del batch, data, offsets
        tidy()


def summed(rows, column: str, kind, many: int) -> np.ndarray | None:
    """Sum of ``many`` equally long binary vectors, one a row, by a tree whose inner nodes read about as many rows each."""

    def add(batches):
        import pyarrow as pa

        acc = None
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                x = np.frombuffer(raw, kind)
                acc = x.copy() if acc is None else acc.__iadd__(x)
        if acc is not None:
            yield pa.RecordBatch.from_arrays([pa.array([acc.tobytes()], pa.binary())], names=[column])

    one = rows.select(column)
    while many > 16:
        many = math.isqrt(many - 1) + 1
        one = one.repartition(many).mapInArrow(add, f"{column} binary")
    left = [np.frombuffer(r[0], kind) for r in one.collect()]  # at most 16 of fixed size
    return sum(left[1:], left[0]) if left else None
