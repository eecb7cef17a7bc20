from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest

from salesmart.llm.succinct import EliasFano, from_buffer, to_file
from salesmart.llm.texts import ANY_WORD, LINE, PLAIN_WORD, pieces

from . import brute

ALPHABET = list("abcXYZ09 .,;\n\t\r\x0b\x00éß日") + ["  ", "word", " "]


def random_texts(seed, count=300):
    draw = random.Random(seed)
    texts = ["".join(draw.choices(ALPHABET, k=draw.randrange(40))) for _ in range(count)]
    return [None if draw.random() < 0.05 else t for t in texts]


@pytest.mark.parametrize("kind", [pa.string(), pa.large_string()])
def test_words_are_those_of_the_pattern(kind):
    texts = random_texts(1)
    column = pa.chunked_array([pa.array(texts[:100], kind), pa.array(texts[100:], kind).slice(0)])
    for word_class, words in ((PLAIN_WORD, brute.plain_words), (ANY_WORD, brute.any_words)):
        by_hash = {}
        for piece in pieces(column, limit=64):
            found = word_class.words(piece)
            for row in range(piece.rows):
                own = found.hashes[found.text == row].tolist()
                want = words(texts[piece.row + row])
                assert len(own) == len(want)
                for h, w in zip(own, want):
                    assert by_hash.setdefault(h, w) == w
        assert len(set(by_hash.values())) == len(by_hash)


def test_windows_stay_within_a_text():
    piece = next(pieces(pa.array(["a b c d", "a b", None, "", "c d a b c"])))
    first, hashes = PLAIN_WORD.words(piece).windows(3)
    assert PLAIN_WORD.words(piece).text[first].tolist() == [0, 0, 4, 4, 4]
    assert hashes[0] == hashes[4] and len(set(hashes.tolist())) == 4


def test_lines_are_told_apart_byte_by_byte():
    piece = next(pieces(pa.array(["a \n a\na \n\n\n", "a "])))
    lines = LINE.words(piece)
    assert lines.text.tolist() == [0, 0, 0, 1]
    assert lines.hashes[0] == lines.hashes[2] == lines.hashes[3] != lines.hashes[1]


@pytest.mark.parametrize(("size", "top"), [(0, 1), (1, 0), (1, 1 << 40), (1000, 50), (1000, 1 << 45), (5000, 5000)])
def test_elias_fano_gets_and_finds(size, top):
    draw = np.random.default_rng(size + top)
    values = np.sort(draw.integers(0, top + 1, size))
    made = EliasFano.of(values)
    again = EliasFano.from_arrays("x", from_buffer(np.frombuffer(to_file(made.arrays("x")), dtype=np.uint8)))
    assert again.get(np.arange(size)).tolist() == values.tolist()
    asked = np.concatenate([values, draw.integers(0, top + 2, 200)])
    begin = draw.integers(0, size + 1, len(asked))
    end = np.minimum(size, begin + draw.integers(0, size + 1, len(asked)))
    found = again.find(asked, begin, end)
    for value, low, high, at in zip(asked, begin, end, found):
        inside = np.flatnonzero(values[low:high] == value)
        assert (at >= 0) == (len(inside) > 0)
        assert at < 0 or values[at] == value and low <= at < high
