"""Words of whole Arrow text columns as flat numpy arrays.

Tasks never loop over words in Python. A column is cut into pieces of about half a megabyte (at
least one whole text), a piece is one byte array with the bounds of its texts, and words are
runs of bytes between separators, each with a 64-bit polynomial hash. Memory per task is a
few dozen times the longer of that and the longest text.

Texts are UTF-8, so a word class whose separators are ASCII can be told byte by byte.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa

PIECE_BYTES = 1 << 19

WHITE_SPACE = bytes([0x20, *range(0x09, 0x0E)])
NOT_ALPHANUMERIC = bytes([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])

_STEP = 0x9E3779B97F4A7C15
_STEP_INVERSE = pow(_STEP, -1, 1 << 64)
_BYTE_VALUES = np.random.Generator(np.random.PCG64(20_240_501)).integers(0, 1 << 64, 256, dtype=np.uint64)


@dataclass(frozen=True)
class Piece:
    """Consecutive rows of a column: bytes, where each text begins, and the first row."""

    row: int
    data: np.ndarray
    bounds: np.ndarray

    @property
    def rows(self) -> int:
        return len(self.bounds) - 1

    def totals(self, per_byte: np.ndarray) -> np.ndarray:
        """Sum of a value per byte over each text."""
        running = np.zeros(len(per_byte) + 1, dtype=np.int64)
        np.cumsum(per_byte, out=running[1:])
        return running[self.bounds[1:]] - running[self.bounds[:-1]]


@dataclass(frozen=True)
class Words:
    """Where each word of a piece begins, the text it is in, and its hash."""

    starts: np.ndarray
    text: np.ndarray
    hashes: np.ndarray

    def counts(self, rows: int) -> np.ndarray:
        return np.bincount(self.text, minlength=rows)

    def windows(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """First word and hash of every run of `length` words within one text."""
        last = len(self.text) - length + 1
        if last <= 0:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
        first = np.flatnonzero(self.text[:last] == self.text[length - 1 :])
        return first, mix(rolled(self.hashes, length)[first])


def rolled(hashes: np.ndarray, length: int) -> np.ndarray:
    """Hash of every `length` neighbours, without regard to texts."""
    size = len(hashes) - length + 1
    factors = _powers(length)[0]
    total = hashes[:size] * factors[0]
    for k in range(1, length):
        total += hashes[k : k + size] * factors[k]
    return total


def pieces(column: pa.Array | pa.ChunkedArray, limit: int = PIECE_BYTES) -> Iterator[Piece]:
    """A text column in pieces; a null is an empty text."""
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    row = 0
    for chunk in chunks:
        if not len(chunk):
            continue
        if chunk.null_count:
            chunk = chunk.fill_null("")
        wide = pa.types.is_large_string(chunk.type)
        _, offsets, data = chunk.buffers()
        kind = np.int64 if wide else np.int32
        bounds = np.frombuffer(offsets, dtype=kind)[chunk.offset : chunk.offset + len(chunk) + 1].astype(np.int64)
        raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
        begin = 0
        while begin < len(chunk):
            end = int(np.searchsorted(bounds, bounds[begin] + limit, side="right")) - 1
            end = min(max(end, begin + 1), len(chunk))
            own = bounds[begin : end + 1]
            yield Piece(row + begin, raw[own[0] : own[-1]], own - own[0])
            begin = end
        row += len(chunk)


class WordClass:
    """Words are the runs of bytes that are no separators. `fold` reads A-Z as a-z."""

    def __init__(self, separators: bytes, fold: bool):
        self.inside = np.ones(256, dtype=bool)
        self.inside[list(separators)] = False
        values = _BYTE_VALUES.copy()
        if fold:
            values[65:91] = values[97:123]
        values[~self.inside] = 0
        self._values = values

    def words(self, piece: Piece) -> Words:
        inside = self.inside[piece.data]
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        first = piece.bounds[:-1][piece.bounds[:-1] < piece.bounds[1:]]
        begins[first] = inside[first]
        starts = np.flatnonzero(begins)
        if not len(starts):
            none = np.zeros(0, dtype=np.int64)
            return Words(none, none, none.astype(np.uint64))
        powers, inverse = _powers(len(piece.data))
        values = self._values[piece.data]
        values *= powers[: len(values)]
        hashes = mix(np.add.reduceat(values, starts) * inverse[starts])
        return Words(starts, np.searchsorted(piece.bounds, starts, side="right") - 1, hashes)

    def hashes_of(self, texts: list[str]) -> np.ndarray:
        """Hash of each text's first word; every text must have one."""
        whole = next(pieces(pa.array(texts, type=pa.string()), limit=1 << 62))
        words = self.words(whole)
        return words.hashes[np.searchsorted(words.text, np.arange(len(texts)))]


def hashes_from(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Hash of the bytes from each start to the next; the bytes before the first are left out."""
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    powers, inverse = _powers(len(data))
    values = _BYTE_VALUES[data]
    values *= powers[: len(values)]
    return mix(np.add.reduceat(values, starts) * inverse[starts])


def mix(values: np.ndarray) -> np.ndarray:
    """Spread the entropy of 64-bit hashes over all bits; no two values meet."""
    out = values ^ (values >> np.uint64(30))
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(27)
    out *= np.uint64(0x94D049BB133111EB)
    out ^= out >> np.uint64(31)
    return out


def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    return _power_tables(max(20, int(size).bit_length()))


@lru_cache(maxsize=1)
def _power_tables(bits: int) -> tuple[np.ndarray, np.ndarray]:
    tables = []
    for factor in (_STEP, _STEP_INVERSE):
        table = np.full(1 << bits, factor, dtype=np.uint64)
        table[0] = 1
        tables.append(np.multiply.accumulate(table))
    return tables[0], tables[1]


ANY_WORD = WordClass(WHITE_SPACE, fold=False)
FOLDED_WORD = WordClass(WHITE_SPACE, fold=True)
PLAIN_WORD = WordClass(NOT_ALPHANUMERIC, fold=True)
LINE = WordClass(b"\n", fold=False)
