"""Retrieval tokens of plain texts, found in their bytes a batch at a time.

A text is plain if it holds no character that needs folding (:data:`dossier.functions.text.NEEDS_FOLDING`) and no number
with grouped digits.  Its letters are then ASCII or two bytes of Latin-1, its dashes and quotes are known, and tokens are
runs of bytes: the result is that of :func:`dossier.functions.text.retrieval_tokens`.  Other texts are told apart.
"""

from __future__ import annotations

import numpy as np

# They follow from RETRIEVAL_TOKEN and NEEDS_FOLDING.
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_WORD = _DIGIT.copy()
_WORD[97:123] = _WORD[95] = True
_JOINER = np.zeros(256, bool)
_JOINER[list(b".-'")] = True


def _of(*ranges: tuple[int, int]) -> np.ndarray:
    out = np.zeros(256, bool)
    for a, b in ranges:
        out[a : b + 1] = True
    return out


_SIGNS = _of((0xA1, 0xA7), (0xA9, 0xA9), (0xAB, 0xAE), (0xB0, 0xB1), (0xB6, 0xB7), (0xBB, 0xBB), (0xBF, 0xBF))  # after C2
_MARKS = _of((0x90, 0x90), (0x92, 0x95), (0x98, 0x9E), (0xA0, 0xA2))  # after E2 80
_BLANK, _APOSTROPHE, _DASH, _PERCENT, _S = b" '-%s"


def find_tokens(text):
    """(whether each text of an Arrow array without nulls is plain, the tokens of the plain ones, their texts' places)."""
    import pyarrow as pa

    rows = len(text)
    edges = np.frombuffer(text.buffers()[1], np.int32, rows + 1, text.offset * 4)
    raw = np.frombuffer(text.buffers()[2] or b"", np.uint8)[edges[0] : edges[-1]]
    edges = edges.astype(np.int64) - edges[0]
    # a blank before each text and some at the end, so that no two touch and none is read past
    d = _LOWER[np.concatenate([np.insert(raw, edges, _BLANK), np.full(4, _BLANK, np.uint8)])]
    edges = edges + np.arange(rows + 1)  # of the blanks
    of = lambda at: np.searchsorted(edges, at, side="right") - 1
    plain = np.ones(rows, bool)

    lead = np.flatnonzero(d >= 0xC0)
    head, second, third = d[lead], d[lead + 1], d[lead + 2]
    letters, dashes = head == 0xC3, (head == 0xE2) & (second == 0x80) & _MARKS[third]
    plain[of(lead[~(letters | dashes | (head == 0xC2) & _SIGNS[second] | (head == 0xE2) & (second == 0x82) & (third == 0xAC))])] = False
    letter, after = lead[letters], second[letters]
    sharp = letter[after == 0x9F]
    d[sharp] = d[sharp + 1] = _S
    capital = (after < 0x9F) & (after != 0x97)
    d[letter[capital] + 1] += 32
    letter = letter[(after != 0x97) & (after != 0xB7)]  # the signs of multiplication and division
    comma = np.flatnonzero(d == 44)
    plain[of(comma[_DIGIT[d[comma - 1]] & _DIGIT[d[comma + 1]] & _DIGIT[d[comma + 2]] & _DIGIT[d[comma + 3]]])] = False

    word = _WORD[d]
    word[letter] = word[letter + 1] = True
    gone = [np.zeros(0, np.int64)]
    for sign, byte in ((_APOSTROPHE, 0x99), (_DASH, 0x90)):  # of the three bytes, the last stands for the sign
        at = lead[dashes & (third == byte)]
        d[at + 2] = sign
        gone += [at, at + 1]
    gone = np.sort(np.concatenate(gone))
    if len(gone):
        kept = np.ones(len(d), bool)
        kept[gone] = False
        d, word, edges = d[kept], word[kept], edges - np.searchsorted(gone, edges)

    inner = np.zeros(len(d), bool)
    inner[1:-1] = _JOINER[d[1:-1]] & word[:-2] & word[2:]
    held = word | inner
    starts = held.copy()
    starts[1:] &= ~held[:-1]
    share = np.flatnonzero(d == _PERCENT)
    held[share[held[share - 1]]] = True
    first = np.flatnonzero(starts)
    row = of(first)
    if not plain.all():  # the others' tokens are dropped whole
        bad = np.flatnonzero(~plain)
        for lo, hi in zip(edges[bad], edges[bad + 1]):
            held[lo:hi] = False
        first, row = first[keep := plain[row]], row[keep]
    before = np.cumsum(held) - held
    offsets = np.append(before[first], np.count_nonzero(held)).astype(np.int32)
    return plain, pa.StringArray.from_buffers(len(first), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(d[held]))), row
