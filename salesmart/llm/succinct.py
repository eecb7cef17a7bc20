"""Elias-Fano sequences over arrays that may be mapped from a file, queried in bulk."""

from __future__ import annotations

import json
import struct

import numpy as np

_BYTES = np.arange(256, dtype=np.uint8)
_ONES = np.bitwise_count(_BYTES)
#: Position of the k-th one of a byte.
_SELECT = np.zeros((256, 8), dtype=np.uint8)
for _byte in range(256):
    _at = [b for b in range(8) if _byte >> b & 1]
    _SELECT[_byte, : len(_at)] = _at


def select_in_words(words: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Position of the rank-th one (from 0) of each 64-bit word."""
    parts = np.ascontiguousarray(words).view(np.uint8).reshape(-1, 8)
    ends = np.cumsum(_ONES[parts], axis=1, dtype=np.int64)
    byte = (ends <= rank[:, None]).sum(axis=1)
    row = np.arange(len(words))
    before = np.where(byte > 0, ends[row, np.maximum(byte - 1, 0)], 0)
    return 8 * byte + _SELECT[parts[row, byte], rank - before]


def _packed(bits: np.ndarray) -> np.ndarray:
    raw = np.packbits(bits, bitorder="little")
    return np.concatenate([raw, np.zeros(-len(raw) % 8 + 8, dtype=np.uint8)]).view(np.uint64)


class EliasFano:
    """A sequence that never falls: low bits packed, high bits in unary, with ranks."""

    def __init__(self, size: int, low_bits: int, low: np.ndarray, high: np.ndarray, ones: np.ndarray):
        self.size, self.low_bits = size, low_bits
        self.low, self.high, self.ones = low, high, ones
        self._zeros = 64 * np.arange(len(ones), dtype=np.int64) - ones
        self._places: tuple[np.ndarray, np.ndarray] | None = None

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        size = len(values)
        top = int(values[-1]) if size else 0
        low_bits = max(0, ((top + 1) // max(size, 1)).bit_length() - 1)
        low = np.zeros((size, low_bits), dtype=bool)
        for bit in range(low_bits):
            low[:, bit] = (values >> bit) & 1
        high = np.zeros(size + (top >> low_bits) + 2, dtype=bool)
        high[(values >> low_bits) + np.arange(size)] = True
        words = _packed(high)
        ones = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])[:-1]
        return cls(size, low_bits, _packed(low.ravel()), words, ones.astype(np.int64))

    def prepared(self) -> EliasFano:
        """The same sequence with the place of every one and zero of the high bits at hand, 4 bytes
        each: for more queries than it has values."""
        bits = np.unpackbits(self.high.view(np.uint8), bitorder="little").view(bool)
        kind = np.int32 if len(bits) < 1 << 31 else np.int64
        self._places = np.flatnonzero(bits).astype(kind), np.flatnonzero(~bits).astype(kind)
        return self

    def _select(self, at: np.ndarray, one: bool) -> np.ndarray:
        """Place of each one, or zero, of the high bits by its number."""
        if self._places is not None:
            return self._places[0 if one else 1][at].astype(np.int64)
        ranks = self.ones if one else self._zeros
        # Words without ones repeat a rank; the last of them holds the one looked for.
        word = np.searchsorted(ranks, at, side="right") - 1
        return 64 * word + select_in_words(self.high[word] if one else ~self.high[word], at - ranks[word])

    def _low(self, at: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(at), dtype=np.int64)
        bit = at * self.low_bits
        word, shift = bit >> 6, (bit & 63).astype(np.uint64)
        value = self.low[word] >> shift
        # Shifting by 64 isn't defined: in two steps.
        value |= (self.low[word + 1] << (np.uint64(63) - shift)) << np.uint64(1)
        return (value & np.uint64((1 << self.low_bits) - 1)).astype(np.int64)

    def get(self, at: np.ndarray) -> np.ndarray:
        return ((self._select(at, True) - at) << self.low_bits) | self._low(at)

    def _below(self, high: np.ndarray) -> np.ndarray:
        """How many values have a high part below."""
        zero = np.maximum(high - 1, 0)
        return np.where(high > 0, self._select(zero, False) - zero, 0)

    def find(self, values: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Successor search: where in [begin, end) each value is, or -1."""
        out = np.full(len(values), -1, dtype=np.int64)
        if not self.size:
            return out
        top = (int(self.get(np.array([self.size - 1]))[0])) >> self.low_bits
        own = np.flatnonzero((begin < end) & (values >= 0) & ((values >> self.low_bits) <= top))
        values, begin, end = values[own], begin[own], end[own]
        high = values >> self.low_bits
        begin = np.maximum(begin, self._below(high))
        end = np.minimum(end, self._below(high + 1))
        low = values & ((1 << self.low_bits) - 1)
        left, right = begin.copy(), np.maximum(begin, end)
        while True:
            open_ = np.flatnonzero(left < right)
            if not len(open_):
                break
            middle = (left[open_] + right[open_]) >> 1
            less = self._low(middle) < low[open_]
            left[open_[less]] = middle[less] + 1
            right[open_[~less]] = middle[~less]
        inside = np.flatnonzero(left < end)
        hit = inside[self._low(left[inside]) == low[inside]]
        out[own[hit]] = left[hit]
        return out

    def arrays(self, name: str) -> dict[str, np.ndarray]:
        return {f"{name}.size": np.array([self.size, self.low_bits], dtype=np.int64), f"{name}.low": self.low, f"{name}.high": self.high, f"{name}.ones": self.ones}

    @classmethod
    def from_arrays(cls, name: str, arrays: dict[str, np.ndarray]) -> EliasFano:
        size, low_bits = arrays[f"{name}.size"].tolist()
        return cls(size, low_bits, arrays[f"{name}.low"], arrays[f"{name}.high"], arrays[f"{name}.ones"])


def to_file(arrays: dict[str, np.ndarray]) -> bytes:
    """Arrays one after the other, behind a header that says where each begins."""
    places, at = {}, 0
    for name, array in arrays.items():
        places[name] = [array.dtype.str, at, len(array)]
        at += (array.nbytes + 7) // 8 * 8
    head = json.dumps(places).encode()
    head += b" " * (-len(head) % 8)
    parts = [struct.pack("<q", len(head)), head]
    for array in arrays.values():
        raw = np.ascontiguousarray(array).tobytes()
        parts += [raw, b"\0" * (-len(raw) % 8)]
    return b"".join(parts)


def from_buffer(buffer: np.ndarray) -> dict[str, np.ndarray]:
    """The arrays of a file, as views of its bytes."""
    (length,) = struct.unpack("<q", buffer[:8].tobytes())
    places = json.loads(buffer[8 : 8 + length].tobytes())
    start = 8 + length
    return {name: buffer[start + at :][: count * np.dtype(kind).itemsize].view(kind) for name, (kind, at, count) in places.items()}
