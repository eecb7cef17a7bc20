"""Byte-pair encoding of whole texts over a trie of their distinct words, and decoding.

The encoding of a prefix is that of a shorter prefix and one more token: its last. So a
prefix needs no more than its last token, and one that several words begin with needs it
once. Distinct words of a run of texts become a trie, whose edges hold stretches of letters;
depth first, each letter on the way gets its last token from those above it, and a word reads
its tokens off its own way up.

The last token of a prefix is the one suffix in the vocabulary that stays as it is behind the
last token of what is before it: sequences are encodings if every two neighbours are. Two
tokens side by side stay if no merge crosses between them, which is told by taking both apart
along the edge they share, from the latest merge back. Tests hold all of this against
the tokenizers library on its own vocabulary.

Texts come in stretches (see `tokens`); each worker keeps the ids of those it has met,
`limit` at most, and begins anew beyond. Nothing is shuffled, and a lost executor costs its
tasks. Strings of special tokens become those tokens, as they do in the library, unless
`special` is False.

Defined cases: a null or empty text has no tokens and decodes to an empty text; long texts
and long words take memory in proportion; repeated rows are encoded each; empty tables give
no rows. Ids outside the vocabulary decode to nothing, bytes that are no UTF-8 to U+FFFD.
Columns of the input other than those named come along only if they are named in `keep`, and
may have any name.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .columns import quoted
from .storage import ship
from .texts import Piece, hashes_from, pieces
from .tokens import stretches

LIMIT = 1 << 19
PAIRS = 1 << 19
NEVER = 1 << 40


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: itself where it can be
    seen, else the next one from 256 on."""
    seen = [chr(b).isprintable() and b not in (0x20, 0xAD) for b in range(256)]
    hidden = iter(range(256, 512))
    return [chr(b) if seen[b] else chr(next(hidden)) for b in range(256)]


class Node:
    """A place of the trie: the first `end` letters of `word`, which begin with those above."""

    __slots__ = ("word", "end", "children", "number")

    def __init__(self, word: str, end: int, number: int = -1):
        self.word, self.end, self.children, self.number = word, end, [], number


def build_trie(words: list[str]) -> Node:
    """The trie of distinct words; `number` of a node is the word's place in the list, or -1."""
    root = Node("", 0)
    way, before = [root], ""
    for number in sorted(range(len(words)), key=words.__getitem__):
        word = words[number]
        shared, most = 0, min(len(before), len(word))
        while shared < most and before[shared] == word[shared]:
            shared += 1
        below = None
        while way[-1].end > shared:
            below = way.pop()
        if way[-1].end < shared:  # the branch begins within an edge
            fork = Node(word, shared)
            fork.children.append(below)
            way[-1].children[-1] = fork
            way.append(fork)
        if len(word) == way[-1].end:
            way[-1].number = number
        else:
            leaf = Node(word, len(word), number)
            way[-1].children.append(leaf)
            way.append(leaf)
        before = word
    return root


class Vocabulary:
    """Merges of a tokenizer file. Only byte-level files whose tokens come from one merge each
    are taken."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            told = json.load(file)
        model, added = told["model"], told.get("added_tokens") or []
        if model.get("type", "BPE") != "BPE" or (told.get("pre_tokenizer") or {}).get("type") != "ByteLevel" or told.get("normalizer"):
            raise ValueError("not a byte-level BPE file")
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in added):
            raise ValueError("special tokens that take in their surroundings are not supported")
        self.split = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
        self.special = {t["content"]: t["id"] for t in added}
        ids = model["vocab"]
        self.names = dict(zip(ids.values(), ids))
        self.merges: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        for rank, merge in enumerate(model["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            pair, made = (ids[left], ids[right]), ids[left + right]
            if made in self.parts:
                raise ValueError("a token comes from more than one merge")
            self.merges[pair], self.parts[made] = rank, (rank, *pair)
        letters = {ids[letter] for letter in byte_letters() if letter in ids}
        #: Tokens that encoding can come to, and the sizes of those by their last three letters,
        #: or by two where no token has more of the ending.
        self.tokens: dict[str, int] = {}
        for name, token in sorted(ids.items(), key=lambda item: len(item[0])):
            if token in letters:
                self.tokens[name] = token
            elif token in self.parts:
                rank, left, right = self.parts[token]
                if self.names[left] in self.tokens and self.names[right] in self.tokens and not self.crossed(left, right, rank):
                    self.tokens[name] = token
        self.sizes: dict[str, tuple[int, ...]] = {name: (2,) for name in self.tokens if len(name) == 2}
        longer: dict[str, set[int]] = {}
        for name in self.tokens:
            if len(name) > 2:
                longer.setdefault(name[-3:], set()).add(len(name))
        for end, own in longer.items():
            self.sizes[end] = (*sorted(own, reverse=True), *self.sizes.get(end[1:], ()))

    def crossed(self, a: int, b: int, before: int = NEVER) -> bool:
        """Whether a merge crosses between neighbours a and b, earlier than at rank `before`."""
        a_ends = b_ends = before  # when a and b go up in larger tokens
        while True:
            rank = self.merges.get((a, b), NEVER)
            # Of equal pairs that share a token, the left one is merged.
            if rank < a_ends and rank <= b_ends and rank < before:
                return True
            a_made, b_made = self.parts.get(a), self.parts.get(b)
            if b_made and (not a_made or b_made[0] >= a_made[0]):
                b_ends, b = b_made[0], b_made[1]
            elif a_made:
                a_ends, a = a_made[0], a_made[2]
            else:
                return False

    def spelled(self) -> list[bytes]:
        """Bytes of every id."""
        byte_of = {letter: b for b, letter in enumerate(byte_letters())}
        out = [b""] * (max([*self.names, *self.special.values()]) + 1)
        for token, name in self.names.items():
            out[token] = bytes(byte_of[c] for c in name)
        for name, token in self.special.items():
            out[token] = name.encode()
        return out


class TrieEncoder:
    """Encodes the texts of pieces, stretch by stretch."""

    def __init__(self, path: str, special: bool = True, limit: int = LIMIT):
        self.vocabulary = Vocabulary(path)
        self._special = self.vocabulary.special if special else {}
        longest = sorted(self._special, key=len, reverse=True)
        self._pattern = re.compile(b"|".join(re.escape(s.encode()) for s in longest)) if longest else None
        self._limit = limit
        self._stay: dict[int, bool] = {}
        self._clear()

    def _clear(self) -> None:
        self._number: dict[int, int] = {}
        self._flat, self._offsets = array("I"), array("q", [0])

    def words(self, words: list[str]) -> list[list[int]]:
        """Ids of distinct words in the letters of the vocabulary."""
        out: list[list[int]] = [[] for _ in words]
        tokens, names, sizes, stay = self.vocabulary.tokens, self.vocabulary.names, self.vocabulary.sizes, self._stay
        last = array("q", [-1]) * (1 + max(map(len, words), default=0))
        waiting = [(build_trie(words), 0)]
        while waiting:
            node, begin = waiting.pop()
            word = node.word
            for depth in range(begin + 1, node.end + 1):
                found = -1
                own_sizes = sizes.get(word[depth - 3 : depth]) if depth > 2 else None
                for size in own_sizes or sizes.get(word[max(depth - 2, 0) : depth], ()):
                    if size > depth:
                        continue
                    token = tokens.get(word[depth - size : depth], -1)
                    if token < 0:
                        continue
                    if size == depth:
                        found = token
                        break
                    before = last[depth - size]
                    pair = before << 32 | token
                    whole = stay.get(pair)
                    if whole is None:
                        if len(stay) >= PAIRS:
                            stay.clear()
                        whole = stay[pair] = not self.vocabulary.crossed(before, token)
                    if whole:
                        found = token
                        break
                # No longer token stays, so the letter itself does.
                last[depth] = tokens[word[depth - 1]] if found < 0 else found
            if node.number >= 0:
                at, own = node.end, out[node.number]
                while at:
                    own.append(last[at])
                    at -= len(names[last[at]])
                own.reverse()
            waiting.extend((child, node.end) for child in reversed(node.children))
        return out

    def encode(self, piece: Piece) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the piece, and ids per text."""
        starts = self._starts(piece)
        text = np.searchsorted(piece.bounds, starts, side="right") - 1
        distinct, first, inverse = np.unique(hashes_from(piece.data, starts), return_index=True, return_inverse=True)
        keys = distinct.tolist()
        new = [k for k, key in enumerate(keys) if key not in self._number]
        if new:
            if len(self._number) + len(new) > self._limit:
                self._clear()
                new = list(range(len(keys)))
            ends = np.append(starts[1:], len(piece.data))
            raw = piece.data.tobytes()
            self._add([keys[k] for k in new], [raw[starts[k] : ends[k]].decode("utf-8", "replace") for k in first[new].tolist()])
        number = np.fromiter(map(self._number.__getitem__, keys), dtype=np.int64, count=len(keys))[inverse]
        offsets = np.frombuffer(self._offsets, dtype=np.int64).copy()
        sizes = offsets[number + 1] - offsets[number]
        at = np.repeat(offsets[number] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        ids = np.frombuffer(self._flat, dtype=np.uint32)[at] if len(at) else np.zeros(0, dtype=np.uint32)
        return ids, np.bincount(text, sizes, piece.rows).astype(np.int64)

    def _starts(self, piece: Piece) -> np.ndarray:
        spans = [m.span() for m in self._pattern.finditer(piece.data.tobytes())] if self._pattern else []
        # A match over the end of a text is none.
        spans = [(b, e) for b, e in spans if np.searchsorted(piece.bounds, b, side="right") == np.searchsorted(piece.bounds, e - 1, side="right")]
        if not spans:
            return stretches(piece)
        begins, ends = (np.array(s, dtype=np.int64) for s in zip(*spans))
        starts = stretches(Piece(piece.row, piece.data, np.union1d(piece.bounds, np.union1d(begins, ends))))
        at = np.searchsorted(begins, starts, side="left") - 1  # the last one that begins before
        return starts[(at < 0) | (starts >= ends[np.maximum(at, 0)])]

    def _add(self, keys: list[int], texts: list[str]) -> None:
        place: dict[str, int] = {}
        split = []
        for text in texts:
            if text in self._special:
                split.append(text)
            else:
                split.append([place.setdefault(word, len(place)) for word, _ in self.vocabulary.split(text)])
        encoded = self.words(list(place))
        for key, parts in zip(keys, split):
            if isinstance(parts, str):
                self._flat.append(self._special[parts])
            else:
                for word in parts:
                    self._flat.extend(encoded[word])
            self._number[key] = len(self._offsets) - 1
            self._offsets.append(len(self._flat))


@lru_cache(maxsize=1)
def encoder(path: str, special: bool) -> TrieEncoder:
    """One encoder per worker process."""
    return TrieEncoder(path, special)


@lru_cache(maxsize=1)
def spelling(path: str) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all ids in a row, and where those of each begin."""
    own = Vocabulary(path).spelled()
    return np.frombuffer(b"".join(own), dtype=np.uint8), np.concatenate([[0], np.cumsum([len(s) for s in own])])


def encode(documents: DataFrame, tokenizer: str, keep: list[str], text: str = "text", special: bool = True) -> DataFrame:
    """The columns to keep and ids, an array, of every row."""
    ship(documents.sparkSession)
    source = documents.select(*[quoted(c).alias(f"k{i}") for i, c in enumerate(keep)], quoted(text).alias("text"))
    schema = T.StructType([*source.schema.fields[:-1], T.StructField("ids", T.ArrayType(T.IntegerType(), False), False)])

    def run(batches):
        own = encoder(tokenizer, special)
        for batch in batches:
            for piece in pieces(batch.column(batch.num_columns - 1)):
                ids, sizes = own.encode(piece)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(ids.view(np.int32)))
                kept = batch.slice(piece.row, piece.rows).columns[:-1]
                yield pa.RecordBatch.from_arrays([*kept, lists], names=schema.names)

    return source.mapInArrow(run, schema).toDF(*keep, "ids")


def decoded(ids: np.ndarray, offsets: np.ndarray, flat: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Texts of lists of ids; `flat` and `bounds` are their spelling."""
    known = (ids >= 0) & (ids < len(bounds) - 1)
    safe = np.where(known, ids, 0)
    sizes = np.where(known, bounds[safe + 1] - bounds[safe], 0)
    ends = np.concatenate([[0], np.cumsum(sizes)])
    data = flat[np.repeat(bounds[safe] - ends[:-1], sizes) + np.arange(ends[-1])]
    cuts = ends[offsets]
    try:
        data.tobytes().decode("utf-8")
        inner = cuts[(cuts > 0) & (cuts < len(data))]
        clean = not ((data[inner] & 0xC0) == 0x80).any()
    except UnicodeDecodeError:
        clean = False
    if clean:
        return pa.Array.from_buffers(pa.large_string(), len(cuts) - 1, [None, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))]).cast(pa.string())
    return pa.array([data[b:e].tobytes().decode("utf-8", "replace") for b, e in zip(cuts, cuts[1:])], pa.string())


def decode(tokens: DataFrame, tokenizer: str, ids: str = "ids", to: str = "decoded") -> DataFrame:
    """All columns, and the text that the ids spell, special tokens included."""
    ship(tokens.sparkSession)
    place = tokens.columns.index(ids)
    schema = T.StructType([*tokens.schema.fields, T.StructField(to, T.StringType(), False)])

    def run(batches):
        flat, bounds = spelling(tokenizer)
        for batch in batches:
            lists = batch.column(place).fill_null([]) if batch.column(place).null_count else batch.column(place)
            offsets = lists.offsets.to_numpy()
            values = lists.values.to_numpy()[offsets[0] : offsets[-1]].astype(np.int64)
            # Rows whose texts are a few megabytes together are spelled at once.
            at, parts = 0, []
            while at < len(lists):
                end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + (1 << 19), side="right")) - 1)
                own = offsets[at : end + 1] - offsets[0]
                parts.append(decoded(values[own[0] : own[-1]], own - own[0], flat, bounds))
                at = end
            texts = pa.concat_arrays(parts) if parts else pa.array([], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, texts], names=schema.names)

    return tokens.mapInArrow(run, schema)
