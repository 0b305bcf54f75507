"""Segments of the token-id output: few of them, and the same ids as whole texts give."""

import random

import numpy as np
import pytest

from dossier.llm import token_output


@pytest.fixture(scope="module")
def path():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _encode(coder, texts):
    raw = [t.encode() for t in texts]
    ids, sizes = coder.encode(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    return [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])]


def test_a_word_is_encoded_once_whatever_stands_beside_it(path):
    words = [f"{a}{b}ing" for a in ("str", "bl", "pl", "qu") for b in ("o", "ea", "i", "u", "ou")]
    rnd = random.Random(5)
    text = "".join(rnd.choice((" ", "\n", ", ", ".\n", "!! ", " (", ") ", "; 7 ")) + rnd.choice(words) for _ in range(4000))
    coder = token_output.SegmentEncoder(path)
    assert _encode(coder, [text]) == [coder.tokenizer.encode(text, add_special_tokens=False).ids]
    assert len(coder.index) <= 2 * len(words) + 20  # each with and without a blank; before, one for each pair of words around a line's end


def test_cut_texts_give_the_ids_of_whole_texts(path):
    parts = [" ", " ", " ", "  ", "\n", "\n\n", "\t", "\r\n", "\x0b", "\x1c", "\0", "\x7f", "\x85", "\xa0", "\u1680", "\u2003", "\u2028", "\u3000", "\u180e", "\ufeff"]
    parts += ["'", "'s", "'re", "a", "B", "foo", "the", "1", "23", "\u0663", "\xb2", "\xe9", "\xc8", "\u0441\u043b\u043e\u0432\u043e", "\u4e2d", "\u201c", "\u2014"]
    parts += ["!", ".", "...", "-", "_", "<|endoftext|>", "<|endof", "text|>", "\U0001f600", "\u0301", "\u200b", "\xaa", "\xd7"]
    rnd = random.Random(8)
    coder = token_output.SegmentEncoder(path, most=500)  # most segments are not remembered
    for _ in range(4):
        texts = ["".join(rnd.choice(parts) for _ in range(rnd.choice((0, 1, 2, 3, 5, 8, 20)))) for _ in range(3000)]
        assert _encode(coder, texts) == [e.ids for e in coder.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    assert _encode(coder, ["", ""]) == [[], []]
