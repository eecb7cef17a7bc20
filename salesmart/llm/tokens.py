"""Token ids of whole texts, by the tokenizers library, a stretch at a time.

The byte-level vocabularies this is for end a token wherever a single blank or line feed
stands between other characters, and between a letter and a sign such as a comma. Texts are
cut into stretches there, and the library encodes each distinct stretch once per worker;
the ids put together are those of the whole text, which a test holds against the library's
own, white space of all kinds included. Strings of special tokens are ordinary text.

The stretches seen so far are kept as arrays (hash, place and number of ids), at most
`limit` of them; beyond that the store starts anew.
"""

from __future__ import annotations

import os
from array import array
from functools import lru_cache

import numpy as np

from .texts import Piece, hashes_from

LIMIT = 1 << 21

_SIGN = np.isin(np.arange(256), list(b".,;:!?*#%&$|"))
_LETTER = np.isin(np.arange(256), list(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"))
_BLANK = np.isin(np.arange(256), [*range(9, 14), *range(28, 33)])
# White space beyond ASCII, as UTF-8.
_WIDE_BLANKS = [chr(c).encode() for c in (0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]


def stretches(piece: Piece) -> np.ndarray:
    """Where the stretches of all texts of a piece begin; a non-empty text begins one."""
    data = piece.data
    size = len(data)
    blank = _BLANK[data]
    for lead in {w[0] for w in _WIDE_BLANKS}:
        at = np.flatnonzero(data == lead)
        for wide in (w for w in _WIDE_BLANKS if w[0] == lead):
            here = at[at + len(wide) <= size]
            for k in range(1, len(wide)):
                here = here[data[here + k] == wide[k]]
            for k in range(len(wide)):
                blank[here + k] = True
    begins, ends = piece.bounds[:-1], piece.bounds[1:] - 1
    begins, ends = begins[begins <= ends], ends[begins <= ends]
    clear_before, clear_after = np.zeros(size, dtype=bool), np.zeros(size, dtype=bool)
    clear_before[1:], clear_after[:-1] = ~blank[:-1], ~blank[1:]
    clear_before[begins], clear_after[ends] = False, False
    alone = clear_before & clear_after
    feed = alone & (data == 10)
    start = feed | (alone & (data == 32))
    start[1:] |= feed[:-1]
    # The end of a letter for certain: ASCII, or the Latin letters of two bytes.
    letter, sign = _LETTER[data], _SIGN[data]
    letter_end = letter.copy()
    letter_end[1:] |= (data[:-1] == 0xC3) & (data[1:] != 0x97) & (data[1:] != 0xB7)
    start[1:] |= (sign[1:] & letter_end[:-1]) | (letter[1:] & sign[:-1])
    start[begins] = True
    return np.flatnonzero(start)


class Encoder:
    """Encodes the texts of pieces. Grows to `limit` stretches, some 80 MB."""

    def __init__(self, path: str, limit: int = LIMIT):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.encode_special_tokens = True
        self._limit = limit
        self._bits = max(10, (2 * limit - 1).bit_length())
        self._clear()

    def _clear(self) -> None:
        self._slots = np.full(1 << self._bits, -1, dtype=np.int32)
        self._keys = np.zeros(0, dtype=np.uint64)
        self._offsets = np.zeros(1, dtype=np.int64)
        self._flat = np.zeros(0, dtype=np.uint32)

    def encode(self, piece: Piece, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the piece, each text's followed by the end id; ids per text."""
        starts = stretches(piece)
        text = np.searchsorted(piece.bounds, starts, side="right") - 1
        keys = hashes_from(piece.data, starts)
        found = self._find(keys)
        if (found < 0).any():
            self._add(piece, starts, keys, found < 0)
            found = self._find(keys)
        sizes = self._offsets[found + 1] - self._offsets[found]
        per_text = np.bincount(text, sizes, piece.rows).astype(np.int64)
        total = int(sizes.sum())
        own = np.repeat(self._offsets[found] - (np.cumsum(sizes) - sizes), sizes) + np.arange(total)
        out = np.full(total + piece.rows, end_id, dtype="<u4")
        ends = np.cumsum(per_text + 1) - 1
        inside = np.ones(len(out), dtype=bool)
        inside[ends] = False
        out[inside] = self._flat[own]
        return out, per_text + 1

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """Place of each key in the store, or -1."""
        out = np.full(len(keys), -1, dtype=np.int64)
        if not len(self._keys):
            return out
        slot = (keys >> np.uint64(64 - self._bits)).astype(np.int64)
        pending = np.arange(len(keys))
        while len(pending):
            at = self._slots[slot[pending]]
            there = at >= 0
            hit = there & (self._keys[at] == keys[pending])
            out[pending[hit]] = at[hit]
            pending = pending[there & ~hit]
            slot[pending] = (slot[pending] + 1) & ((1 << self._bits) - 1)
        return out

    def _add(self, piece: Piece, starts: np.ndarray, keys: np.ndarray, missing: np.ndarray) -> None:
        distinct, first = np.unique(keys[missing], return_index=True)
        if len(self._keys) + len(distinct) > self._limit:
            self._clear()
            distinct, first = np.unique(keys, return_index=True)
            missing = np.ones(len(keys), dtype=bool)
        ends = np.append(starts[1:], len(piece.data))[missing][first]
        begins = starts[missing][first]
        raw = piece.data.tobytes()
        texts = [raw[b:e].decode("utf-8", "replace") for b, e in zip(begins.tolist(), ends.tolist())]
        ids = [array("I", f.ids) for f in self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        sizes = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
        place = len(self._keys)
        self._keys = np.concatenate([self._keys, distinct])
        self._offsets = np.concatenate([self._offsets, self._offsets[-1] + np.cumsum(sizes)])
        self._flat = np.concatenate([self._flat, np.frombuffer(b"".join(i.tobytes() for i in ids), dtype=np.uint32)])
        if len(self._keys) * 2 > len(self._slots):  # one piece alone holds more than the limit
            self._bits = (2 * len(self._keys)).bit_length()
            self._slots = np.full(1 << self._bits, -1, dtype=np.int32)
            distinct, place = self._keys, 0
        slot = (distinct >> np.uint64(64 - self._bits)).astype(np.int64)
        waiting = np.arange(len(distinct))
        while len(waiting):
            free = waiting[self._slots[slot[waiting]] < 0]
            self._slots[slot[free]] = (free + place).astype(np.int32)
            waiting = waiting[self._slots[slot[waiting]] != waiting + place]
            slot[waiting] = (slot[waiting] + 1) & ((1 << self._bits) - 1)


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """One encoder per worker process."""
    return Encoder(path)
