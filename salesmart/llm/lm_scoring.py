"""Language-model scores from an Elias-Fano n-gram trie.

Training counts every token of every training text, by hash and exactly, in one
aggregation. A number stands for each token in n-grams: the most frequent (`numbered` at
most) get small ones, in a file that tasks map; all others take 62 bits of their hash. Two
tokens in a hundred million then share a number with a chance of about one in a thousand.

The trie holds every bigram and trigram that occurs twice at least, whatever the corpus:
once is no evidence, as with the discount it would leave a context most of its mass anyway,
and most n-grams of a corpus occur once. `head_share` and `gram_share`, 0 unless set, ask for
more. Tasks count n-grams in sorted runs, cut by hash, so that no frequent word or pair brings
its n-grams to one task; a run is shuffled as one block of bytes with its own dictionary, and
each part is merged and pruned on its own. What is left is dealt out by the hash of its
context to shards, in blocks of bytes again, as many as it takes, each written as a file. A level of a shard is an
Elias-Fano sequence of words of the shard, made monotone by adding the last value of the range
before; others of contexts and of pointers to where the children of each begin; and a byte
each for the discounted probability and for the mass left to shorter contexts, on a
logarithmic scale.

    p(w | u v) = a(uvw) + m(uv) * (a(vw) + m(v) * p(w)),  p(w) = (count + 1) / (N + V + 1)

with a = (count - discount) / count of the context for entries of the trie, else 0, and m
what the entries of a context leave over, else 1. Probabilities so add up to one, but for
rounding to a byte. Tokens without a small number are the tail. Their counts come through a
join, for the base score and, as a factor, for the score; where entries may hold them, shards
answer with their counts and the factor is taken out again.

Scoring writes each run of texts as numbers, sends its distinct n-grams to the shards of
their contexts, and the answers back to the run; no task sees more than one shard at a time.
A bit table turns most misses away, then successor search finds the token within the range of
its context.

Defined cases: a null or empty text is its end alone; without training texts every token
has probability one; repeated rows count and are scored once each; an empty table gives no
rows. Columns of the input other than those named are not looked at.
"""

from __future__ import annotations

import os
import uuid
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import quoted
from .storage import removed, shared_folder, ship, shuffles_removed, written
from .succinct import EliasFano, from_buffer, to_file
from .texts import FOLDED_WORD, mix, pieces
from .token_files import _file_system

END_HASH = np.uint64(0xE5D0_7E87_0000_0001)
#: Words of a run have at most 2**21 distinct ones, so that three fit in 63 bits.
ID_BITS = 21
MASK = np.uint64((1 << ID_BITS) - 1)
#: Numbers of tokens from here on are hashes.
HASHED = 1 << 62
#: Runs have at most 2**19 tokens and two that lead in.
PLACE_BITS = 20


@dataclass(frozen=True)
class LmSettings:
    """Shares are of all training tokens; 0 keeps whatever occurs twice. `numbered` is how
    many tokens get small numbers, `part_tokens` the number of n-grams that are merged in one
    go, `held` how many n-grams a task holds before it passes them on, and `shard_grams` about
    how many kept n-grams go to a shard."""

    head_share: float = 0.0
    gram_share: float = 0.0
    discount: float = 0.75
    part_tokens: int = 4_000_000
    numbered: int = 1 << 20
    held: int = 1 << 21
    shard_grams: int = 2_000_000


@dataclass(frozen=True)
class Trained:
    """What scoring needs: totals, the folder with the file of numbered tokens and the shards
    (place, number of shards, path), and all counts."""

    tokens: int
    distinct: int
    folder: str
    head: str
    shards: list[tuple[int, int, str]]
    counts: DataFrame


def _lowest_count(share: float, tokens: int) -> int:
    return max(2, int(np.ceil(share * tokens)))


def _token_counts(documents: DataFrame, text: str, settings: LmSettings) -> DataFrame:
    """h and c of every distinct token, ends included."""
    ship(documents.sparkSession)

    def run(batches):
        keys, numbers, size = [], [], 0

        def merged():
            distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
            return distinct, np.bincount(at, np.concatenate(numbers), len(distinct)).astype(np.int64)

        def batch_of(distinct, counts):
            return pa.RecordBatch.from_arrays([pa.array(distinct.view(np.int64)), pa.array(counts)], names=["h", "c"])

        for batch in batches:
            for piece in pieces(batch["text"]):
                distinct, counts = np.unique(FOLDED_WORD.words(piece).hashes, return_counts=True)
                keys += [distinct, np.array([END_HASH])]
                numbers += [counts, np.array([piece.rows])]
                size += len(distinct) + 1
                if size > 2 * settings.held:
                    distinct, counts = merged()
                    keys, numbers, size = [distinct], [counts], len(distinct)
                    if size > settings.held:
                        yield batch_of(distinct, counts)
                        keys, numbers, size = [], [], 0
        if keys:
            yield batch_of(*merged())

    counted = documents.select(quoted(text).alias("text")).mapInArrow(run, "h long, c long")
    return counted.groupBy("h").agg(F.sum("c").alias("c"))


def _save(folder: str, name: str, content: bytes) -> str:
    system, root = _file_system(folder)
    system.create_dir(root, recursive=True)
    path = f"{root}/{name}-{uuid.uuid4().hex}"
    with system.open_output_stream(path) as stream:
        stream.write(content)
    return path


@lru_cache(maxsize=4096)
def _mapped(folder: str, path: str) -> dict[str, np.ndarray]:
    """Arrays of a file: mapped if it is on a file system of this machine, else read."""
    if os.path.exists(path):
        return from_buffer(np.asarray(np.memmap(path, dtype=np.uint8, mode="r")))
    system, _ = _file_system(folder)
    with system.open_input_file(path) as stream:
        return from_buffer(np.frombuffer(stream.read(), dtype=np.uint8))


def _head(counts: DataFrame, tokens: int, folder: str, settings: LmSettings) -> tuple[str, bool]:
    """The file of numbered tokens: hashes in order, with count and number by falling count
    (from 1); and whether these are all that n-grams may hold.

    At most `numbered` rows come to the driver, or 1 / head_share where that is asked for.
    """
    lowest = _lowest_count(settings.head_share, tokens)
    own = counts.where(F.col("c") >= lowest)
    whole = True
    # Tokens of kept n-grams are as frequent as these: no need to know all of them.
    if lowest <= _lowest_count(settings.gram_share, tokens) and own.count() > settings.numbered:
        own, whole = own.orderBy(F.desc("c"), "h").limit(settings.numbered), False
    rows = own.toArrow()
    hashes, numbers = rows["h"].to_numpy().view(np.uint64), rows["c"].to_numpy()
    order = np.argsort(hashes)
    hashes, numbers = hashes[order], numbers[order].astype(np.int64)
    rank = np.empty(len(hashes), dtype=np.int64)
    rank[np.lexsort((hashes, -numbers))] = np.arange(1, len(hashes) + 1)
    by_rank = np.zeros(len(hashes) + 1, dtype=np.int64)
    by_rank[rank] = numbers
    return _save(folder, "head", to_file({"hashes": hashes, "counts": numbers, "rank": rank, "by_rank": by_rank, "whole": np.array([whole])})), whole


class _Head:
    """Numbers of tokens: 0 begins a text, numbered tokens are 1 and on, -1 is the tail."""

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.hashes, self.counts, self.rank, self.by_rank = (arrays[n] for n in ("hashes", "counts", "rank", "by_rank"))
        self.whole = bool(arrays["whole"][0])
        # Where hashes with each beginning start, with more beginnings than hashes.
        bits = min(22, max(10, len(self.hashes).bit_length() + 1))
        self.shift = np.uint64(64 - bits)
        sizes = np.bincount((self.hashes >> self.shift).astype(np.int64), minlength=1 << bits)
        self.starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Place of each hash among the head's, or -1."""
        top = (hashes >> self.shift).astype(np.int64)
        at, end = self.starts[top], self.starts[top + 1]
        out = np.full(len(hashes), -1, dtype=np.int64)
        left = np.flatnonzero(at < end)
        while len(left):
            there = self.hashes[at[left]]
            hit = there == hashes[left]
            out[left[hit]] = at[left[hit]]
            left = left[there < hashes[left]]
            at[left] += 1
            left = left[at[left] < end[left]]
        return out


class _Stream:
    """Tokens of a piece in one row of numbers: per text 0, its words, its end."""

    def __init__(self, piece, head: _Head):
        words = FOLDED_WORD.words(piece)
        counts = words.counts(piece.rows)
        size = int(counts.sum()) + 2 * piece.rows
        begins = np.concatenate([[0], np.cumsum(counts + 2)])[:-1]
        at = begins[words.text] + 1 + np.arange(len(words.text)) - np.concatenate([[0], np.cumsum(counts)])[:-1][words.text]
        self.rows, self.sizes = piece.rows, counts + 1
        self.text = np.repeat(np.arange(piece.rows), counts + 2)
        self.hashes = np.full(size, END_HASH, dtype=np.uint64)
        self.hashes[at] = words.hashes
        self.begin = np.zeros(size, dtype=bool)
        self.begin[begins] = True
        place = head.find(self.hashes)
        place[self.begin] = -1
        self.place = place
        self.number = np.where(place >= 0, head.rank[place] if len(head.rank) else -1, -1)
        self.number[self.begin] = 0
        # What stands for the token in n-grams; -1 is in none.
        self.gram = self.number if head.whole else np.where(self.number < 0, _hashed(self.hashes), self.number)


def _hashed(hashes: np.ndarray) -> np.ndarray:
    """Numbers of tokens that have no small one."""
    return ((hashes >> np.uint64(2)) | np.uint64(HASHED)).astype(np.int64)


def _distinct(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct numbers in order, and where among them each is."""
    small = n < HASHED
    most = int(n[small].max(initial=-1))
    if most > 8 * len(n):
        return np.unique(n, return_inverse=True)
    used = np.zeros(most + 2, dtype=bool)
    used[n[small] + 1] = True
    words = np.flatnonzero(used) - 1
    rank = np.cumsum(used, dtype=np.int32) - 1
    if small.all():
        return words, rank[n + 1].astype(np.int64)
    at = np.empty(len(n), dtype=np.int64)
    at[small] = rank[n[small] + 1]
    far, place = np.unique(n[~small], return_inverse=True)
    at[~small] = place + len(words)
    return np.concatenate([words, far]), at


def _grouped(group: np.ndarray, number: int) -> tuple[np.ndarray, np.ndarray]:
    """An order that brings groups together and else keeps the old one, and where each begins."""
    group = group.astype(np.uint16 if number <= 1 << 16 else np.int64)  # short ones are sorted by their digits
    order = np.argsort(group, kind="stable")
    return order, np.concatenate([[0], np.cumsum(np.bincount(group, minlength=number))])


def _one_spot(token: np.ndarray) -> np.ndarray:
    """32 bits of the hash of a context of one token."""
    return (mix(token.astype(np.uint64)) >> np.uint64(32)).astype(np.int64)


def _two_spot(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return _one_spot(mix(first.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15) + second.astype(np.uint64))


def _planes(values: np.ndarray) -> bytes:
    """Rising values as differences, in planes of bytes."""
    steps = np.diff(values.astype(np.uint64), prepend=np.uint64(0)).astype("<u8")
    return np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).tobytes()


def _from_planes(data: np.ndarray, size: int) -> np.ndarray:
    steps = np.ascontiguousarray(data[: 8 * size].reshape(8, size).T).view("<u8").ravel()
    return np.cumsum(steps, dtype=np.uint64)


def _split(keys: np.ndarray, length: int) -> list[np.ndarray]:
    """The words of packed n-grams."""
    return [((keys >> np.uint64(ID_BITS * k)) & MASK).astype(np.int64) for k in reversed(range(length))]


def _packed(columns: list[np.ndarray]) -> np.ndarray:
    out = columns[0].astype(np.uint64)
    for column in columns[1:]:
        out = (out << np.uint64(ID_BITS)) | column.astype(np.uint64)
    return out


def _columns_out(values: np.ndarray, size: int) -> bytes:
    return np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T[:size]).tobytes()


def _columns_in(data: np.ndarray, size: int, count: int) -> np.ndarray:
    out = data[:count].astype(np.uint32)
    for k in range(1, size):
        plane = data[k * count : (k + 1) * count]
        if plane.any():
            out |= plane.astype(np.uint32) << np.uint32(8 * k)
    return out


def _changes(columns: list[np.ndarray]) -> np.ndarray:
    """Whether each row differs from the one before."""
    new = np.ones(len(columns[0]), dtype=bool)
    if len(new):
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return new


def _block(words: np.ndarray, grams: dict[int, np.ndarray], packer, counts: dict[int, np.ndarray] | None = None) -> bytes:
    """Rising packed n-grams by length, with the words that they hold, and their counts.

    A word of an n-gram is told as its step from the one above, where what stands before it
    is the same, in planes of bytes. Bigrams are compressed with the trigrams that they begin.
    """
    split = {length: _split(keys, length) for length, keys in grams.items()}
    every = np.concatenate([c for columns in split.values() for c in columns])
    if len(words) <= 8 * len(every):
        held = np.zeros(len(words), dtype=bool)
        held[every] = True
        used = np.flatnonzero(held)
        rank = np.cumsum(held, dtype=np.int32) - 1
    else:
        used, rank = np.unique(every), None
    out = [np.array([len(used), *[len(grams[k]) for k in (1, 2, 3)]], dtype="<i8").tobytes(), _planes(words[used] + 1)]
    for length in (1, 2, 3):
        own = [rank[c] if rank is not None else np.searchsorted(used, c) for c in split[length]]
        for k, column in enumerate(own):
            steps = np.diff(column, prepend=0)
            out.append(_columns_out(np.where(_changes(own[:k]), column, steps) if k else steps, 3))
    for length in counts or {}:
        out.append(_columns_out(counts[length], 4))
    return packer.compress(b"".join(out))


def _restored(steps: np.ndarray, new: np.ndarray) -> np.ndarray:
    """Values from their steps, which begin anew where told."""
    sums = np.cumsum(steps, dtype=np.int64)
    begins = np.flatnonzero(new)
    return sums - np.repeat(sums[begins] - steps[begins], np.diff(np.append(begins, len(steps))))


def _opened(raw: bytes) -> tuple[list[int], np.ndarray]:
    """How many words and n-grams of each length a block has, and what follows."""
    data = np.frombuffer(zstandard.decompress(raw), dtype=np.uint8)
    return data[:32].view("<i8").tolist(), data[32:]


def _words_of(opened: tuple[list[int], np.ndarray]) -> np.ndarray:
    sizes, data = opened
    return _from_planes(data, sizes[0]).astype(np.int64) - 1


def _grams_of(opened: tuple[list[int], np.ndarray], length: int, counted: bool = False) -> tuple[list[np.ndarray], np.ndarray | None]:
    """N-grams as columns of places among the words, and their counts if the block has them."""
    sizes, data = opened
    size, columns = sizes[length], []
    begins = 8 * sizes[0] + 3 * np.cumsum([0, 0, sizes[1], 2 * sizes[2], 3 * sizes[3]])
    for k in range(length):
        steps = _columns_in(data[begins[length] + 3 * k * size :], 3, size)
        columns.append(_restored(steps, _changes(columns)) if k else np.cumsum(steps, dtype=np.int64))
    return columns, _columns_in(data[begins[4] + 4 * sum(sizes[1:length]) :], 4, size) if counted else None


def _unblock(raw: bytes) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    opened = _opened(raw)
    return _words_of(opened), {length: _packed(_grams_of(opened, length)[0]) for length in (1, 2, 3)}


def _runs(n: np.ndarray, limit: int):
    """A stream cut where it is long: each part, and how many of its places only lead in."""
    yield n[:limit], 0
    for begin in range(limit, len(n), limit):
        yield n[begin - 2 : begin + limit], 2


def _grams(documents: DataFrame, text: str, folder: str, head: str, parts_wanted: int, settings: LmSettings) -> DataFrame:
    """part and a block of n-grams with counts, from every training text."""
    limit = max(16, min(settings.held // 2, 1 << 19))

    def run(batches):
        own = _Head(_mapped(folder, head))
        packer = zstandard.ZstdCompressor(level=1)
        waiting, size = [], 0

        def blocks(n, skip):
            words, at = _distinct(n)
            # A text begins with 0, which follows nothing.
            two = (n[:-1] >= 0) & (n[1:] > 0)
            three = two[:-1] & two[1:]
            two[: max(skip - 1, 0)] = False
            found = {1: np.zeros(0, np.uint64), 2: _packed([at[:-1][two], at[1:][two]]), 3: _packed([at[:-2][three], at[1:-1][three], at[2:][three]])}
            cut = {}
            for length, keys in found.items():
                distinct, counts = np.unique(keys, return_counts=True)
                spot = np.zeros(len(distinct), dtype=np.uint64)
                for column in _split(distinct, length)[:2]:  # a trigram goes where its context goes
                    spot = mix(spot * np.uint64(0x9E3779B97F4A7C15) + words[column].astype(np.uint64))
                order, bounds = _grouped(spot % np.uint64(parts_wanted), parts_wanted)  # still rising within a part
                cut[length] = distinct[order], counts[order], bounds.tolist()
            parts, packed = [], []
            for part in range(parts_wanted):
                spans = {k: slice(bounds[part], bounds[part + 1]) for k, (_, _, bounds) in cut.items()}
                if any(x.start < x.stop for x in spans.values()):
                    parts.append(part)
                    packed.append(_block(words, {k: cut[k][0][x] for k, x in spans.items()}, packer, {k: cut[k][1][x] for k, x in spans.items()}))
            return pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(packed, pa.binary())], names=["part", "block"])

        for batch in batches:
            for piece in pieces(batch["text"]):
                n = _Stream(piece, own).gram
                if size + len(n) > limit and size:
                    yield blocks(np.concatenate(waiting), 0)
                    waiting, size = [], 0
                if len(n) > limit:
                    for part, skip in _runs(n, limit):
                        yield blocks(part, skip)
                else:
                    waiting.append(n)
                    size += len(n)
        if size:
            yield blocks(np.concatenate(waiting), 0)

    return documents.select(quoted(text).alias("text")).mapInArrow(run, "part int, block binary")


def _code(values: np.ndarray, name: str) -> dict[str, np.ndarray]:
    """Shares in (0, 1] as bytes on a logarithmic scale between their extremes."""
    logs = np.log10(np.maximum(values, 1e-12))
    low, high = (float(logs.min()), float(logs.max())) if len(logs) else (0.0, 0.0)
    step = (high - low) / 255 or 1.0
    return {f"{name}.code": np.rint((logs - low) / step).astype(np.uint8), f"{name}.scale": np.array([low, step])}


def _frequent(keys: np.ndarray, counts: np.ndarray, lowest: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys whose counts add up to enough, in order, and the sums."""
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    del order
    begins = np.flatnonzero(np.diff(keys, prepend=-1))
    totals = np.add.reduceat(counts, begins, dtype=np.int64) if len(begins) else np.zeros(0, dtype=np.int64)
    own = totals >= lowest
    return keys[begins[own]], totals[own]


def _merged(blocks: list[bytes], lowest: int) -> dict[int, tuple]:
    """By length: columns of tokens of the n-grams frequent enough, in order, and counts; for
    trigrams also those of their contexts.

    Blocks are read once for each length, one at a time. A trigram is no more frequent than its
    context, so those of other contexts than the frequent ones are left out as they are read.
    """
    words = np.sort(np.concatenate([_words_of(_opened(raw)) for raw in blocks]))
    words = words[_changes([words])]

    def read(length):
        for raw in blocks:
            opened = _opened(raw)
            at = np.searchsorted(words, _words_of(opened))
            columns, counts = _grams_of(opened, length, counted=True)
            first, second, *third = (at[c] for c in columns)
            yield (first << 32) | second, third, counts

    pairs, counts = zip(*[(pair, count) for pair, _, count in read(2)])
    pairs, counts = np.concatenate(pairs), np.concatenate(counts)
    contexts, totals = _frequent(pairs, counts, lowest)
    del pairs, counts
    keys, counts = [], []
    for pair, (last,), count in read(3):
        at = _placed(pair, contexts)
        own = at >= 0
        keys.append((at[own] << 32) | last[own])
        counts.append(count[own])
    keys, counts = np.concatenate(keys), np.concatenate(counts)
    keys, own_totals = _frequent(keys, counts, lowest)
    low = (1 << 32) - 1
    parent = keys >> 32
    first, second = words[contexts >> 32], words[contexts & low]
    return {2: ([first, second], totals), 3: ([first[parent], second[parent], words[keys & low]], own_totals, totals[parent])}


def _monotone(numbers: np.ndarray, pointers: np.ndarray) -> np.ndarray:
    """Numbers, which rise within each range, plus the last value before their range."""
    sizes = np.diff(pointers)
    filled = np.flatnonzero(sizes)
    lasts = numbers[pointers[filled + 1] - 1]
    bases = np.zeros(len(sizes), dtype=np.int64)
    bases[filled] = np.cumsum(lasts) - lasts
    return numbers + np.repeat(bases, sizes)


def _bit_filter(keys: np.ndarray) -> np.ndarray:
    """One bit for each key, in a table of 16 to 32 bits a key."""
    bits = max(6, int(16 * len(keys)).bit_length())
    table = np.zeros(1 << bits, dtype=bool)
    table[(mix(keys) >> np.uint64(64 - bits)).astype(np.int64)] = True
    return np.packbits(table, bitorder="little")


def _may_hold(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    bits = (8 * len(table)).bit_length() - 1
    at = (mix(keys) >> np.uint64(64 - bits)).astype(np.int64)
    return (table[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0


def _level(name: str, key: np.ndarray, counts: np.ndarray, parent_counts: np.ndarray, discount: float) -> dict[str, np.ndarray]:
    """Arrays of a level: the words after each context, and what they are worth. `key`: the place
    of the context, then 32 bits of the word's."""
    order = np.argsort(key)
    key, counts = key[order], counts[order]
    del order
    parent = key >> 32
    share = (counts - discount) / parent_counts[parent]
    left = 1 - np.bincount(parent, share, len(parent_counts))
    pointers = np.searchsorted(parent, np.arange(len(parent_counts) + 1))
    out = _code(share, f"a{name}") | _code(left, f"m{name}")
    del parent, share, left, counts
    out |= EliasFano.of(pointers.astype(np.int64)).arrays(f"p{name}")
    out |= EliasFano.of(_monotone(key & ((1 << 32) - 1), pointers)).arrays(f"g{name}")
    out[f"f{name}"] = _bit_filter(key.astype(np.uint64))
    return out


def build_shard(rows: dict[int, list[np.ndarray]], counts_of, discount: float) -> dict[str, np.ndarray]:
    """Trie of the n-grams whose contexts are dealt to the shard.

    `rows`, columns of tokens and then of counts: 1 has tokens without a small number, 2
    bigrams, 3 trigrams, with the counts of their contexts last; the latter two are taken out.
    `counts_of`: how often each of some tokens has a token after it.
    """
    single, counts = rows[1]
    order = np.argsort(single)
    words = np.unique(np.concatenate([*map(np.unique, rows[2][:2]), *map(np.unique, rows[3][:3])]))
    out = {"words": words, "single": single[order], "counts": counts[order]}
    # Rows go as soon as places stand for their tokens.
    first, second, counts = rows.pop(2)
    contexts, parent = np.unique(np.searchsorted(words, first), return_inverse=True)
    key = (parent << 32) | np.searchsorted(words, second)
    del first, second, parent
    out |= EliasFano.of(contexts).arrays("c2")
    out |= _level("2", key, counts, np.maximum(counts_of(words[contexts]), 1), discount)
    first, second, third, counts, context_counts = rows.pop(3)
    pairs = np.searchsorted(words, first) * len(words) + np.searchsorted(words, second)
    del first, second
    contexts, at, parent = np.unique(pairs, return_index=True, return_inverse=True)
    del pairs
    context_counts = context_counts[at]
    key = (parent << 32) | np.searchsorted(words, third)
    del third, parent, at
    out |= EliasFano.of(contexts).arrays("c3")
    return out | _level("3", key, counts, context_counts, discount)


def _placed(values: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Place of each value among rising ones, or -1."""
    at = np.minimum(np.searchsorted(among, values), max(len(among) - 1, 0))
    return np.where(among[at] == values, at, -1) if len(among) else np.full(len(values), -1, dtype=np.int64)


class Shard:
    """The shard at a place among a number of them."""

    def __init__(self, place: int, number: int, arrays: dict[str, np.ndarray]):
        self.place, self.number, self.arrays = place, number, arrays
        self.contexts, self.pointers, self.grams = ({n: EliasFano.from_arrays(f"{k}{n}", arrays) for n in (2, 3)} for k in "cpg")

    def prepared(self) -> Shard:
        """For many blocks of n-grams."""
        for held in (self.contexts, self.pointers, self.grams):
            for sequence in held.values():
                sequence.prepared()
        return self

    def codes(self, level: int, context: np.ndarray, which: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What contexts leave, and a of words (-1 is none) after one of them each, as codes; -1
        says there is nothing."""
        left, a = np.full(len(context), -1, dtype=np.int16), np.full(len(word), -1, dtype=np.int16)
        held, pointers, grams = self.contexts[level], self.pointers[level], self.grams[level]
        parent = held.find(context, np.zeros(len(context), dtype=np.int64), np.full(len(context), held.size, dtype=np.int64))
        own = np.flatnonzero(parent >= 0)
        left[own] = self.arrays[f"m{level}.code"][parent[own]]
        begin, end, base = (np.zeros(len(context), dtype=np.int64) for _ in range(3))
        begin[own], end[own] = pointers.get(parent[own]), pointers.get(parent[own] + 1)
        own = own[begin[own] > 0]
        base[own] = grams.get(begin[own] - 1)
        asked = np.flatnonzero((parent[which] >= 0) & (word >= 0))
        asked = asked[_may_hold(self.arrays[f"f{level}"], (parent[which[asked]].astype(np.uint64) << np.uint64(32)) | word[asked].astype(np.uint64))]
        own = which[asked]
        at = grams.find(word[asked] + base[own], begin[own], end[own])
        a[asked[at >= 0]] = self.arrays[f"a{level}.code"][at[at >= 0]]
        return a, left

    def answer(self, words: np.ndarray, grams: dict[int, np.ndarray]) -> Answer:
        at = _placed(words[grams[1].astype(np.int64)], self.arrays["single"])
        counts = np.zeros(len(at), dtype=np.int64)
        counts[at >= 0] = self.arrays["counts"][at[at >= 0]]
        local = _placed(words, self.arrays["words"])
        codes = []
        for level in (2, 3):
            begins, which = _contexts(grams[level])
            *before, word = _split(grams[level], level)
            before = [local[c[begins]] for c in before]
            context = before[0] if level == 2 else np.where((before[0] >= 0) & (before[1] >= 0), before[0] * len(self.arrays["words"]) + before[1], -1)
            codes += self.codes(level, context, which, local[word])
        return Answer(counts, codes, [self.arrays[f"{name}.scale"].tolist() for name in ("a2", "m2", "a3", "m3")])


def _contexts(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each context of rising packed n-grams begins, and which each n-gram has."""
    new = _changes([keys >> np.uint64(ID_BITS)])
    return np.flatnonzero(new), np.cumsum(new) - 1


@dataclass(frozen=True)
class Answer:
    """Counts of single tokens; then a of bigrams, what their contexts leave, and both for
    trigrams, as codes of the shard's scales, -1 for none. Contexts come once each."""

    counts: np.ndarray
    codes: list[np.ndarray]
    scales: list[list[float]]

    def values(self) -> list[np.ndarray]:
        tables = [np.append(10.0 ** (low + step * np.arange(256)), none) for (low, step), none in zip(self.scales, (0, 1, 0, 1))]
        return [self.counts, *[table[code] for table, code in zip(tables, self.codes)]]

    def to_bytes(self, packer) -> bytes:
        parts = [np.array([len(a) for a in (self.counts, *self.codes)], dtype="<i8").tobytes(), np.array(self.scales, dtype="<f8").tobytes()]
        parts.append(self.counts.astype("<i8").tobytes())
        for code in self.codes:
            parts += [np.packbits(code >= 0).tobytes(), code[code >= 0].astype(np.uint8).tobytes()]
        return packer.compress(b"".join(parts))

    @classmethod
    def of(cls, raw: bytes) -> Answer:
        data = np.frombuffer(zstandard.decompress(raw), dtype=np.uint8)
        sizes, scales, data = data[:40].view("<i8").tolist(), data[40:104].view("<f8").reshape(4, 2).tolist(), data[104:]
        counts, data, codes = data[: 8 * sizes[0]].view("<i8"), data[8 * sizes[0] :], []
        for size in sizes[1:]:
            there, data = np.unpackbits(data[: (size + 7) // 8], count=size).view(bool), data[(size + 7) // 8 :]
            code, found = np.full(size, -1, dtype=np.int16), int(there.sum())
            code[there], data = data[:found], data[found:]
            codes.append(code)
        return cls(counts, codes, scales)


def _ranked(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of 44 bits at most in order, and where among them each is."""
    places = np.arange(len(keys), dtype=np.uint64)
    both = np.sort((keys << np.uint64(PLACE_BITS)) | places)
    own, at = both >> np.uint64(PLACE_BITS), (both & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)
    new = _changes([own])
    rank = np.empty(len(keys), dtype=np.int64)
    rank[at] = np.cumsum(new) - 1
    return own[new], rank


class _Probes:
    """The distinct n-grams of a run that shards are asked for, by length.

    Runs are numbers of tokens, as places in a list of distinct ones; the first `skip` places
    only lead in.
    """

    def __init__(self, words: np.ndarray, at: np.ndarray, skip: int, shards: int):
        n = words[at]
        inside = n != 0  # a beginning is no token
        inside[:skip] = False
        two = np.flatnonzero(inside[1:] & (n[:-1] >= 0)) + 1
        three = two[two > 1]
        three = three[(n[three - 1] > 0) & (n[three - 2] >= 0)]
        self.size, self.words, self.shards = len(n), words, shards
        self.places = {2: two, 3: three}
        single = np.flatnonzero(words >= HASHED)
        self.keys, self.inverse = {1: single.astype(np.uint64)}, {}
        # Pairs by number, so that a trigram and its place fit in 64 bits and sort without an index.
        pairs, pair = _ranked(_packed([at[:-1], at[1:]]))
        for length, own, first in ((2, two, 0), (3, three, 1)):
            keys, self.inverse[length] = _ranked((pair[own - 1 - first].astype(np.uint64) << np.uint64(ID_BITS * first)) | (at[own].astype(np.uint64) if first else np.uint64(0)))
            self.keys[length] = (pairs[(keys >> np.uint64(ID_BITS)).astype(np.int64)] << np.uint64(ID_BITS)) | (keys & MASK) if first else pairs[keys.astype(np.int64)]
        first, (second, third) = words[_split(self.keys[2], 2)[0]], (words[c] for c in _split(self.keys[3], 3)[:2])
        self.order, self.bounds = {}, {}
        for length, spot in {1: _one_spot(words[single]), 2: _one_spot(first), 3: _two_spot(second, third)}.items():
            self.order[length], self.bounds[length] = _grouped((spot * shards) >> 32, shards)

    def _at(self, length: int, shard: int) -> np.ndarray:
        return self.order[length][self.bounds[length][shard] : self.bounds[length][shard + 1]]

    def of(self, shard: int) -> dict[int, np.ndarray]:
        return {k: keys[self._at(k, shard)] for k, keys in self.keys.items()}

    def filled(self, answers) -> tuple[np.ndarray, ...]:
        """For every place: a and mass left from its bigram, then from its trigram; and for
        every word the count that a shard has of it. `answers`: shards and what they said."""
        counts, a2, m1, a3, m2 = (np.full(len(self.keys[k]), fill) for k, fill in ((1, 0), (2, 0.0), (2, 1.0), (3, 0.0), (3, 1.0)))
        for shard, answer in answers:
            counts[self._at(1, shard)] = answer[0]
            for length, a, m, (own, left) in ((2, a2, m1, answer[1:3]), (3, a3, m2, answer[3:])):
                at = self._at(length, shard)
                a[at], m[at] = own, left[_contexts(self.keys[length][at])[1]]
        whole = []
        for length, values, fill in ((2, a2, 0.0), (2, m1, 1.0), (3, a3, 0.0), (3, m2, 1.0)):
            out = np.full(self.size, fill)
            out[self.places[length]] = values[self.inverse[length]]
            whole.append(out)
        by_word = np.zeros(len(self.words), dtype=np.int64)
        by_word[self.keys[1].astype(np.int64)] = counts
        return *whole, by_word


def _lookups(shards: list[Shard], n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For every place of a stream: a and mass left from its bigram, then from its trigram."""
    words, at = _distinct(n)
    probes = _Probes(words, at, 0, shards[0].number if shards else 1)
    return probes.filled((s.place, s.answer(words, probes.of(s.place)).values()) for s in shards)[:4]


def _run_block(n: np.ndarray, first_row: int, skip: int, packer) -> bytes:
    """A run of texts, or of a part of one, as distinct tokens and places among them."""
    words, at = _distinct(n)
    planes = np.ascontiguousarray(at.astype("<u4").view(np.uint8).reshape(-1, 4).T[:3]).tobytes()
    return packer.compress(np.array([len(words), len(n), first_row, skip], dtype="<i8").tobytes() + _planes(words + 1) + planes)


def _read_run(raw: bytes) -> tuple[np.ndarray, np.ndarray, int, int]:
    data = np.frombuffer(zstandard.decompress(raw), dtype=np.uint8)
    count, size, first_row, skip = data[:32].view("<i8").tolist()
    words, planes = _from_planes(data[32:], count).astype(np.int64) - 1, data[32 + 8 * count :].reshape(3, size).astype(np.int64)
    return words, planes[0] | planes[1] << 8 | planes[2] << 16, first_row, skip


ROWS = "kind int, spot long, a long, b long, c long, n long, context long"


def _rows(found: list[tuple[int, np.ndarray, list[np.ndarray], np.ndarray, np.ndarray | None]]) -> dict[str, np.ndarray]:
    """Columns of ROWS from kinds, spots, tokens, counts and counts of contexts."""
    out: dict[str, list[np.ndarray]] = {name: [] for name in ("kind", "spot", "a", "b", "c", "n", "context")}
    for kind, spot, columns, counts, contexts in found:
        none = np.zeros(len(counts), dtype=np.int64)
        values = np.full(len(counts), kind, dtype=np.int32), spot, *[*columns, none, none][:3], counts, none if contexts is None else contexts
        for name, column in zip(out, values):
            out[name].append(column)
    return {name: np.concatenate(values) for name, values in out.items()}


#: The columns that rows of each kind have.
KINDS = {1: ("a", "n"), 2: ("a", "b", "n"), 3: ("a", "b", "c", "n", "context")}


def _dealt(source: DataFrame, number: int, held: int, reader=None) -> DataFrame:
    """shard, how many rows of each kind, and their columns as one block of bytes.

    `source` has ROWS, or what `reader` gives makes them of its batches: in the same Python
    worker, as two in a row would both keep their memory.
    """

    def run(batches):
        packer = zstandard.ZstdCompressor(level=1)
        rows_of = reader() if reader else lambda batch: batch
        waiting, size = [], 0

        def blocks(table):
            columns = {name: table[name].to_numpy() for name in table.column_names}
            group = 4 * ((columns["spot"] * number) >> 32) + columns["kind"]
            order = np.argsort(group, kind="stable")
            groups, begins = np.unique(group[order], return_index=True)
            spans = {int(g): order[x:y] for g, x, y in zip(groups, begins, np.append(begins[1:], len(order)))}
            for shard in sorted({g >> 2 for g in spans}):
                own = [spans.get(4 * shard + kind, order[:0]) for kind in KINDS]
                planes = [columns[name][at].view(np.uint8).reshape(-1, 8).T.tobytes() for at, names in zip(own, KINDS.values()) for name in names]
                yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "sizes": [list(map(len, own))], "block": [packer.compress(b"".join(planes))]})

        for batch in batches:
            waiting.append(rows_of(batch))
            size += waiting[-1].num_rows
            if size >= held:
                yield from blocks(pa.Table.from_batches(waiting))
                waiting, size = [], 0
        if size:
            yield from blocks(pa.Table.from_batches(waiting))

    return source.mapInArrow(run, "shard int, sizes array<long>, block binary")


def _gathered(sizes: list[list[int]], blocks) -> dict[int, list[np.ndarray]]:
    """By kind, the columns of all rows of a shard's blocks."""
    out = {kind: [np.empty(sum(own), dtype=np.int64) for _ in names] for (kind, names), own in zip(KINDS.items(), zip(*sizes))}
    begins = dict.fromkeys(KINDS, 0)
    for own, raw in zip(sizes, blocks):
        data = np.frombuffer(zstandard.decompress(raw.as_py()), dtype=np.uint8)
        for kind, size in zip(KINDS, own):
            for column in out[kind]:
                column[begins[kind] : begins[kind] + size] = np.ascontiguousarray(data[: 8 * size].reshape(8, size).T).view("<i8").ravel()
                data = data[8 * size :]
            begins[kind] += size
    return out


def train(documents: DataFrame, text: str = "text", settings: LmSettings | None = None) -> Trained:
    """Count all texts of `documents` and write the model to the shared folder."""
    settings = settings or LmSettings()
    spark = documents.sparkSession
    ship(spark)
    folder = shared_folder(spark)
    with shuffles_removed(spark):
        counts = written(_token_counts(documents, text, settings))
    total = counts.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v"), F.max(F.when(F.col("h") == int(END_HASH.astype(np.int64)), F.col("c"))).alias("texts")).first()
    tokens, distinct, texts = total["n"] or 0, total["v"], total["texts"] or 0
    head, whole = _head(counts, tokens, folder, settings)
    lowest = _lowest_count(settings.gram_share, tokens)
    discount = settings.discount
    parts = max(1, int(np.ceil(2 * tokens / settings.part_tokens)))
    blocks = _grams(documents, text, folder, head, parts, settings)

    def merge(group):
        found = _merged(group["block"].to_pylist(), lowest)
        (u, v), n2 = found[2]
        (x, y, z), n3, context = found[3]
        return pa.table(_rows([(2, _one_spot(u), [u, v], n2, None), (3, _two_spot(x, y), [x, y, z], n3, context)]))

    with shuffles_removed(spark):
        kept = written(blocks.groupBy("part").applyInArrow(merge, ROWS))
    number = max(1, int(np.ceil(kept.count() / settings.shard_grams)))

    def singles():
        own = _Head(_mapped(folder, head))

        def rows_of(batch):
            hashes, numbers = batch["h"].to_numpy().view(np.uint64), batch["c"].to_numpy()
            rest = own.find(hashes) < 0
            token = _hashed(hashes[rest])
            return pa.RecordBatch.from_pydict(_rows([(1, _one_spot(token), [token], numbers[rest], None)]))

        return rows_of

    # Rows meet in blocks: neither the JVM nor Python holds them one by one.
    dealt = _dealt(kept, number, settings.held // 2)
    if not whole:  # n-grams may hold tokens of which no file has the counts
        dealt = dealt.unionByName(_dealt(counts.where(F.col("c") >= 2).select("h", "c"), number, settings.held // 2, singles))

    def build(key, group):
        shard = key[0].as_py()
        by_rank = _mapped(folder, head)["by_rank"]
        rows = _gathered(group["sizes"].to_pylist(), group["block"])
        single, numbers = rows[1]
        order = np.argsort(single)

        def counts_of(token):
            out = np.where(token == 0, texts, by_rank[np.where(token < HASHED, token, 0)])
            far = token >= HASHED
            out[far] = numbers[order][np.searchsorted(single[order], token[far])]
            return out

        made = build_shard(rows, counts_of, discount)
        return pa.table({"shard": pa.array([shard], pa.int32()), "path": [_save(folder, f"shard-{shard:04d}", to_file(made))]})

    with shuffles_removed(spark):
        made = written(dealt.groupBy("shard").applyInArrow(build, "shard int, path string"))
    shards = [(r["shard"], number, r["path"]) for r in sorted(made.collect())]
    removed(kept)
    return Trained(tokens, distinct, folder, head, shards, counts)


def _trie_scores(runs: DataFrame, model: Trained) -> DataFrame:
    """row and the score of its tokens, without p(w) of the tail, in parts of long texts.

    `runs`: run and block. A group of runs meets one shard at a time.
    """
    folder, head, whole = model.folder, model.head, float(np.log10(model.tokens + model.distinct + 1))
    files = {place: path for place, _, path in model.shards}
    number = model.shards[0][1] if model.shards else 1

    def asked(batches):
        packer = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for run, raw in zip(batch["run"].to_pylist(), batch["block"]):
                words, at, _, skip = _read_run(raw.as_py())
                probes = _Probes(words, at, skip, number)
                grams = {shard: probes.of(shard) for shard in files}
                grams = {shard: g for shard, g in grams.items() if any(map(len, g.values()))}
                blocks = [_block(words, g, packer) for g in grams.values()]
                yield pa.RecordBatch.from_arrays([pa.array(list(grams), pa.int32()), pa.array([run] * len(grams), pa.int64()), pa.array(blocks, pa.binary())], names=["shard", "run", "block"])

    def answered(key, group):
        place = key[0].as_py()
        shard = Shard(place, number, _mapped(folder, files[place])).prepared()
        packer = zstandard.ZstdCompressor(level=1)
        out = [shard.answer(*_unblock(raw.as_py())).to_bytes(packer) for raw in group["block"]]
        return pa.table({"run": group["run"], "shard": group["shard"], "answer": pa.array(out, pa.binary())})

    def finished(left, right):
        by_rank = _mapped(folder, head)["by_rank"]
        answers = [(s, Answer.of(raw.as_py()).values()) for s, raw in zip(right["shard"].to_pylist(), right["answer"])]
        words, at, first_row, skip = _read_run(left["block"][0].as_py())
        a2, m1, a3, m2, far = _Probes(words, at, skip, number).filled(answers)
        # -1 and tokens that no shard counts enter as a factor.
        counts = np.where((words > 0) & (words < HASHED), by_rank[np.where((words > 0) & (words < HASHED), words, 0)], far)[at]
        unigram = (counts + 1) / 10.0**whole
        p = np.where(counts > 0, a3 + m2 * (a2 + m1 * unigram), m2 * m1)
        logs = np.log10(np.maximum(p, 1e-300))
        n = words[at]
        tail = (far[at] > 0) & (n >= HASHED)
        logs[tail] -= np.log10(unigram[tail])
        begin = n == 0
        row = np.cumsum(begin) - begin[0]
        own = np.flatnonzero(~begin[skip:]) + skip
        rows, local = np.unique(row[own], return_inverse=True)
        return pa.table({"row": rows + first_row, "score": np.bincount(local, logs[own], len(rows)).astype(np.float64)})

    requests = runs.mapInArrow(asked, "shard int, run long, block binary")
    # A task takes the shard's part of as many runs as make it worth to prepare the shard, and no
    # more than some hundred, however frequent a context is.
    slices = -(-runs.count() // min(4 * number, 512)) or 1
    answers = requests.groupBy("shard", F.pmod(F.xxhash64("run"), F.lit(slices)).alias("slice")).applyInArrow(answered, "run long, shard int, answer binary")
    with shuffles_removed(runs.sparkSession):
        answers = written(answers)
    return runs.groupBy("run").cogroup(answers.groupBy("run")).applyInArrow(finished, "row long, score double")


def score(documents: DataFrame, model: Trained, keep: list[str], text: str = "text", settings: LmSettings | None = None) -> DataFrame:
    """The columns to keep, n_tokens, n_known, base_score and score of every row."""
    settings = settings or LmSettings()
    limit = max(16, min(settings.held // 4, 1 << 19))
    spark = documents.sparkSession
    ship(spark)
    folder, head = model.folder, model.head
    whole = float(np.log10(model.tokens + model.distinct + 1))
    source = documents.select(*[quoted(c).alias(f"k{i}") for i, c in enumerate(keep)], quoted(text).alias("text"))
    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in source.schema][:-1])
    schema += ", row long, n_tokens long, head_known long, head_score double, tail array<long>, tail_counts array<int>, blocks array<binary>"

    def run(batches):
        from pyspark import TaskContext

        own_head = _Head(_mapped(folder, head))
        packer = zstandard.ZstdCompressor(level=1)
        row = TaskContext.get().partitionId() << 40
        waiting, size, first_row, pending = [], 0, row, None

        def with_blocks(arrays, names, blocks):
            held = [blocks or None] + [None] * (len(arrays[0]) - 1)
            return pa.RecordBatch.from_arrays([*arrays, pa.array(held, pa.list_(pa.binary()))], names=[*names, "blocks"])

        def gathered():
            return [_run_block(np.concatenate(waiting), first_row, 0, packer)] if waiting else []

        for batch in batches:
            for piece in pieces(batch.column(batch.num_columns - 1)):
                s = _Stream(piece, own_head)
                n = s.gram
                blocks = []
                if size + len(n) > limit:
                    blocks, waiting, size = gathered(), [], 0
                if pending:
                    yield with_blocks(*pending, blocks)
                    blocks = []
                if not waiting:
                    first_row = row
                if len(n) > limit:
                    at = 0
                    for part, skip in _runs(n, limit):
                        blocks.append(_run_block(part, row + int(s.text[at]), skip, packer))
                        at += len(part) - 2 - skip if not skip else len(part) - skip
                else:
                    waiting.append(n)
                    size += len(n)
                known = s.place >= 0
                count = np.where(known, own_head.counts[s.place] if len(own_head.counts) else 0, 0)
                token = ~s.begin
                base_logs = np.log10(count + 1.0) - whole
                tail = np.flatnonzero(token & ~known)
                order = np.lexsort((s.hashes[tail], s.text[tail]))
                tail = tail[order]
                new = np.ones(len(tail), dtype=bool)
                new[1:] = (s.text[tail][1:] != s.text[tail][:-1]) | (s.hashes[tail][1:] != s.hashes[tail][:-1])
                at = np.flatnonzero(new)
                numbers = np.diff(np.append(at, len(tail)))
                offsets = pa.array(np.searchsorted(s.text[tail[at]], np.arange(s.rows + 1)).astype(np.int32))
                own = batch.slice(piece.row, piece.rows)
                arrays = [
                    *own.columns[:-1],
                    pa.array(np.arange(row, row + s.rows)),
                    pa.array(s.sizes.astype(np.int64)),
                    pa.array(np.bincount(s.text[token & known], minlength=s.rows)),
                    pa.array(np.bincount(s.text[token & known], base_logs[token & known], s.rows).astype(np.float64)),
                    pa.ListArray.from_arrays(offsets, pa.array(s.hashes[tail[at]].view(np.int64))),
                    pa.ListArray.from_arrays(offsets, pa.array(numbers.astype(np.int32))),
                ]
                pending = arrays, [*own.schema.names[:-1], "row", "n_tokens", "head_known", "head_score", "tail", "tail_counts"]
                if blocks:
                    yield with_blocks(*pending, blocks)
                    pending = None
                row += s.rows
        if pending:
            yield with_blocks(*pending, gathered())

    part = written(source.mapInArrow(run, schema))
    # A run goes by the row that its blocks came with, and its place among them.
    runs = part.where(F.col("blocks").isNotNull()).select("row", F.posexplode("blocks").alias("at", "block")).select(F.xxhash64("row", "at").alias("run"), "block")
    tails = part.select("row", F.explode(F.arrays_zip("tail", "tail_counts")).alias("t")).select("row", F.col("t.tail").alias("h"), F.col("t.tail_counts").alias("n"))
    met = tails.join(model.counts, "h", "left")
    known: Column = F.when(F.col("c").isNotNull(), F.col("n")).otherwise(0)
    term = F.col("n") * (F.log10(F.coalesce("c", F.lit(0)) + F.lit(1.0)) - F.lit(whole))
    found = met.select("row", known.cast("long").alias("tail_known"), term.alias("tail_score"), F.lit(0.0).alias("trie_score"))
    told = _trie_scores(runs, model).select("row", F.lit(0).cast("long").alias("tail_known"), F.lit(0.0).alias("tail_score"), F.col("score").alias("trie_score"))
    sums = found.unionByName(told).groupBy("row").agg(*[F.sum(c).alias(c) for c in ("tail_known", "tail_score", "trie_score")])
    out = part.drop("tail", "tail_counts", "blocks").join(sums, "row", "left")
    tail = F.coalesce("tail_score", F.lit(0.0))
    return out.select(
        *[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)],
        "n_tokens",
        (F.col("head_known") + F.coalesce("tail_known", F.lit(0))).cast("long").alias("n_known"),
        (F.col("head_score") + tail).alias("base_score"),
        (F.coalesce("trie_score", F.lit(0.0)) + tail).alias("score"),
    )
