"""Spelling variants, grouped by a trie over letter-group frequencies.

Words of a corpus are counted, and two are near if they differ by exactly one letter that is
put in, left out or replaced. Such words have nearly the same letters: in the counts of
letter groups, one group may have one more (surplus) and one may have one less (deficit).

1. One pass over all texts counts words where they are read; tasks hand on sums.
2. The upper levels of the trie are counts of `UPPER` wide groups. Words with the same ones
   are a cell; a word asks the cells that it reaches with a budget of one deficit and one
   surplus, in one direction only, so that each pair is met once: from the longer word to the
   shorter, between equal lengths from the cell that has more in the first group that differs.
   Cells are sized by counting them: one with many words or many askers is cut into
   blocks and slices, every block meeting every slice, so no cell overloads a task.
3. Within a cell, the trie goes on by counts of single letters, one level each. A depth-first
   search walks it with all askers at once, each with what is left of its budget; askers that
   can't pay for a branch stay behind. Words at the leaves are verified letter by letter.
4. Tasks hand on, per word, how many near words there are and the most frequent of them.
   Forms are followed to their root by doubling: each is `ratio` times as frequent as the word at least, so
   chains are short.

Anagrams share a leaf, where all of them are compared with all askers of the leaf, in blocks.

Defined cases: a null text has no words and a null id counts as empty text in what the
rule for deletions hashes; long texts take memory in proportion, and words of any length count;
of forms equally frequent the smallest word is taken; repeated rows count each; an empty
table has no words. Columns of the input other than those named are not looked at.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass
from math import ceil, log, log2

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import quoted
from .storage import ship, written
from .texts import Piece, hashes_from, pieces

#: Letters by frequency, dealt out so that groups are about equally frequent.
BY_FREQUENCY = "etaoinsrhldcumfpgwybvkxjqz"
UPPER = 4
#: One group for each letter from a to z, the others by code point.
OTHERS = 6
GROUPS = len(BY_FREQUENCY) + OTHERS
FIRST_OTHER, LAST_OTHER = 0xC0, 0xFF

_LETTER = np.isin(np.arange(256), [*range(65, 91), *range(97, 123)])
_LOWER = np.where(np.isin(np.arange(256), np.arange(65, 91)), np.arange(256) + 32, np.arange(256)).astype(np.uint8)
#: Words up to here are compared as rows of a matrix.
WIDE = 64


@dataclass(frozen=True)
class SpellingSettings:
    """`least`: letters of a word; `occurrences`: of words that count; `ratio`: how many times
    as frequent a form is, 2 at least; `deleted`: a run loses a letter if this divides the crc32 of its
    document's id and itself. `block` and `slice` bound the words and the askers of a cell's
    part, `task_rows` is about how many of both a task gets, `pairs` how many are compared at
    a time, `held` how many counted words a task holds."""

    least: int = 7
    occurrences: int = 2
    ratio: int = 10
    deleted: int = 31
    block: int = 1 << 15
    slice: int = 1 << 16
    task_rows: int = 1 << 17
    pairs: int = 1 << 14
    held: int = 1 << 20


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1).astype(np.uint32)
    return table


_CRC = _crc_table()


def crc32_after(before: np.ndarray, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """crc32 of stretches of bytes, each going on from the crc32 of what stands before it."""
    out = before.astype(np.uint32)
    for k in np.flatnonzero(sizes > WIDE).tolist():
        out[k] = zlib.crc32(data[starts[k] : starts[k] + sizes[k]].tobytes(), int(before[k]))
    order = np.argsort(-sizes, kind="stable")
    order = order[sizes[order] <= WIDE]
    own, begins = ~out[order], starts[order]
    left = np.searchsorted(-sizes[order], -np.arange(1, WIDE + 1), side="right")
    for k in range(WIDE):
        n = left[k]
        if not n:
            break
        own[:n] = _CRC[(own[:n] ^ data[begins[:n] + k]) & np.uint32(0xFF)] ^ (own[:n] >> np.uint32(8))
    out[order] = ~own
    return out


def runs_of(piece: Piece, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Begin, end, text and letters of every run of so many letters at least.

    The letters beyond a-z are those of two bytes that begin with C3: U+00C0 to U+00FF.
    """
    lead = piece.data == 0xC3
    inside = _LETTER[piece.data] | lead
    inside[1:] |= lead[:-1]
    edge = np.zeros(len(piece.data) + 1, dtype=bool)
    edge[1:-1] = inside[1:] != inside[:-1]
    edge[piece.bounds] = True
    edge[-1] = True
    cuts = np.flatnonzero(edge)
    starts, ends = cuts[:-1], cuts[1:]
    own = inside[starts] if len(starts) else np.zeros(0, dtype=bool)
    starts, ends = starts[own], ends[own]
    leads = np.concatenate([[0], np.cumsum(lead)])
    letters = ends - starts - (leads[ends] - leads[starts])
    long = letters >= least
    starts, ends = starts[long], ends[long]
    return starts, ends, np.searchsorted(piece.bounds, starts, side="right") - 1, letters[long]


def _strings(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    flat = data[np.repeat(starts - offsets[:-1], sizes) + np.arange(offsets[-1])]
    return pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(flat))])


def counted_in(piece: Piece, ids: list[str], settings: SpellingSettings) -> pa.Table:
    """word and n of the words of a piece whose texts have these ids."""
    starts, ends, text, letters = runs_of(piece, settings.least)
    lower = _LOWER[piece.data]
    # Begins and ends in turn: every other stretch is a run.
    cuts = np.stack([starts, ends], axis=1).ravel()
    hashes = hashes_from(np.append(lower, np.uint8(0)), cuts)[::2]
    order = np.lexsort((hashes, text))
    new = np.ones(len(order), dtype=bool)
    new[1:] = (text[order][1:] != text[order][:-1]) | (hashes[order][1:] != hashes[order][:-1])
    at = np.flatnonzero(new)
    number = np.diff(np.append(at, len(order)))
    own = order[at]
    starts, sizes, letters, hashes = starts[own], (ends - starts)[own], letters[own], hashes[own]
    before = np.array([zlib.crc32(f"{i}:".encode()) for i in ids], dtype=np.uint32)[text[own]]
    h = crc32_after(before, lower, starts, sizes).astype(np.int64)
    cut = h % settings.deleted == 0
    shorter, n = [], []
    for k in np.flatnonzero(cut & (letters > settings.least)).tolist():
        word = lower[starts[k] : starts[k] + sizes[k]].tobytes().decode()
        place = int(h[k] % letters[k])
        shorter.append(word[:place] + word[place + 1 :])
        n.append(int(number[k]))
    kept = np.flatnonzero(~cut)
    _, first, inverse = np.unique(hashes[kept], return_index=True, return_inverse=True)
    totals = np.bincount(inverse, number[kept], len(first)).astype(np.int64)
    words = pa.concat_arrays([_strings(lower, starts[kept][first], sizes[kept][first]), pa.array(shorter, pa.large_string())])
    return pa.table({"word": words, "n": np.concatenate([totals, np.array(n, dtype=np.int64)])})


def count_words(documents: DataFrame, key: str, text: str, settings: SpellingSettings) -> DataFrame:
    """word and n of every word that occurs often enough."""
    ship(documents.sparkSession)
    source = documents.select(F.coalesce(quoted(key).cast("string"), F.lit("")).alias("key"), quoted(text).alias("text"))

    def run(batches):
        tables, size, merged = [], 0, 0

        def summed():
            return pa.concat_tables(tables).group_by("word").aggregate([("n", "sum")]).rename_columns(["word", "n"])

        def passed(table):
            for batch in table.cast(pa.schema([("word", pa.string()), ("n", pa.int64())])).to_batches(1 << 16):
                yield batch

        for batch in batches:
            ids = batch["key"].to_pylist()
            for piece in pieces(batch["text"]):
                tables.append(counted_in(piece, ids[piece.row : piece.row + piece.rows], settings))
                size += len(tables[-1])
                if size > merged + settings.held:
                    tables = [summed()]
                    size = merged = len(tables[0])
                    if size > settings.held:
                        yield from passed(tables[0])
                        tables, size, merged = [], 0, 0
        if tables:
            yield from passed(summed())

    counted = source.mapInArrow(run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= settings.occurrences)


def wide_groups() -> list[str]:
    """The letters of each wide group."""
    every = BY_FREQUENCY + "".join(map(chr, range(FIRST_OTHER, LAST_OTHER + 1)))
    return [every[k::UPPER] for k in range(UPPER)]


def upper_counts(word: Column) -> Column:
    """How many letters of each wide group the word has."""
    counts = [F.length(word) - F.length(F.translate(word, own, "")) for own in wide_groups()[:-1]]
    rest = F.length(word)
    for count in counts:
        rest = rest - count
    return F.array(*counts, rest)


def moves() -> list[list[int]]:
    """What a word's upper counts may change by on the way to the cells it asks."""
    out = [[0] * UPPER]
    for less in range(UPPER):
        fewer = [-(k == less) for k in range(UPPER)]
        out.append(fewer)
        for more in range(less + 1, UPPER):
            out.append([x + (k == more) for k, x in enumerate(fewer)])
    return out


def letter_counts(words: list[bytes]) -> np.ndarray:
    """Counts of single letters and of the groups of others, per word of Latin-1 letters."""
    group = np.zeros(256, dtype=np.int64)
    for code in range(FIRST_OTHER, LAST_OTHER + 1):
        group[code] = len(BY_FREQUENCY) + code % OTHERS
    for k, letter in enumerate(BY_FREQUENCY):
        group[ord(letter)] = k
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    flat = group[np.frombuffer(b"".join(words), dtype=np.uint8)]
    at = np.repeat(np.arange(len(words)), sizes) * GROUPS + flat
    return np.bincount(at, minlength=len(words) * GROUPS).reshape(-1, GROUPS).astype(np.int32)


def one_apart(longer: bytes, other: bytes) -> bool:
    """Whether one letter is replaced between them, or left out of the longer one."""
    shared, most = 0, len(other)
    while shared < most and longer[shared] == other[shared]:
        shared += 1
    if len(longer) == len(other):
        return shared < most and longer[shared + 1 :] == other[shared + 1 :]
    return len(longer) == len(other) + 1 and longer[shared + 1 :] == other[shared:]


class FrequencyTrie:
    """Words by their counts. In that order the words of a node are next to each other, so a node
    is a stretch of it, and its children are the stretches of equal counts at the next level."""

    def __init__(self, words: list[bytes], counts: np.ndarray, pairs: int):
        self.words, self.counts, self.most = words, counts, pairs
        self.sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        self.letters = np.zeros((len(words), WIDE), dtype=np.uint8)
        short = self.sizes <= WIDE
        sizes = np.where(short, self.sizes, 0)
        rows = np.repeat(np.arange(len(words)), sizes)
        columns = np.arange(len(rows)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        self.letters[rows, columns] = np.frombuffer(b"".join(w for w, s in zip(words, short.tolist()) if s), dtype=np.uint8)

    def search(self, leaves: np.ndarray, askers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (asker, word of a leaf) that are near; leaves are equally long.

        Between words with the same upper counts, the smaller of two askers finds the other.
        """
        leaves = leaves[np.lexsort(self.counts[leaves].T[::-1])]
        length = self.sizes[leaves[0]]
        missing = self.sizes[askers] - length
        asked = askers[(missing == 0) | (missing == 1)]
        # A shorter word has a deficit only.
        waiting = [(0, len(leaves), 0, asked, np.ones(len(asked), np.int8), (self.sizes[asked] == length).astype(np.int8))]
        found: list[tuple[np.ndarray, np.ndarray]] = []
        while waiting:
            begin, end, level, own, deficit, surplus = waiting.pop()
            if level == GROUPS or (end - begin) * len(own) <= self.most:
                step = max(1, self.most // (end - begin))
                for k in range(0, len(own), step):
                    part = slice(k, k + step)
                    found.append(self._leaf(leaves[begin:end], level, own[part], deficit[part], surplus[part]))
                continue
            column = self.counts[leaves[begin:end], level]
            cuts = begin + np.concatenate([[0], np.flatnonzero(column[1:] != column[:-1]) + 1, [end - begin]])
            wanted = self.counts[own, level]
            for b, e in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                more = self.counts[leaves[b], level] - wanted
                less_left, more_left = deficit - (more == -1), surplus - (more == 1)
                pays = (np.abs(more) <= 1) & (less_left >= 0) & (more_left >= 0)
                if pays.any():
                    waiting.append((b, e, level + 1, own[pays], less_left[pays], more_left[pays]))
        if not found:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        asker, word = (np.concatenate(f) for f in zip(*found))
        near = self._near(asker, word)
        return asker[near], word[near]

    def _leaf(self, leaves, level, askers, deficit, surplus):
        """Pairs whose counts below the level the budget pays for."""
        more = self.counts[None, leaves, level:] - self.counts[askers, None, level:]
        pays = (np.maximum(-more, 0).sum(axis=2) <= deficit[:, None]) & (np.maximum(more, 0).sum(axis=2) <= surplus[:, None])
        a, w = np.nonzero(pays)
        return askers[a], leaves[w]

    def _near(self, asker: np.ndarray, word: np.ndarray) -> np.ndarray:
        out = np.zeros(len(asker), dtype=bool)
        size = self.sizes[asker]
        for k in np.flatnonzero(size > WIDE).tolist():
            out[k] = one_apart(self.words[asker[k]], self.words[word[k]])
        same, shorter = (np.flatnonzero((size <= WIDE) & (self.sizes[word] == size - d)) for d in (0, 1))
        for begin in range(0, len(same), 1 << 16):
            part = same[begin : begin + (1 << 16)]
            out[part] = (self.letters[asker[part]] != self.letters[word[part]]).sum(axis=1) == 1
        for begin in range(0, len(shorter), 1 << 16):
            part = shorter[begin : begin + (1 << 16)]
            a, w = self.letters[asker[part]], self.letters[word[part]]
            alike = np.logical_and.accumulate(a == w, axis=1)
            after = np.zeros_like(alike)
            after[:, :-1] = a[:, 1:] == w[:, :-1]
            after[:, -1] = w[:, -1] == 0
            out[part] = (alike | after).all(axis=1)
        return out


def near_in(table: pa.Table, settings: SpellingSettings) -> pa.Table:
    """Per word: near words found here, and the most frequent of them.

    `table` has cell, word, n, asks: whether the word is an asker of the cell, and same: whether
    it asks the cell that it is in itself.
    """
    names = pc.unique(table["word"])
    names = names.take(pc.sort_indices(names))
    place = pc.index_in(table["word"], names).to_numpy().astype(np.int64)
    n = np.zeros(len(names), dtype=np.int64)
    n[place] = table["n"].to_numpy()
    words = [w.encode("latin-1") for w in names.to_pylist()]
    trie = FrequencyTrie(words, letter_counts(words), settings.pairs)
    asks, same = (table[c].combine_chunks().to_numpy(zero_copy_only=False) for c in ("asks", "same"))
    cell = pc.dictionary_encode(table["cell"]).combine_chunks().indices.to_numpy()
    order = np.argsort(cell, kind="stable")
    cuts = np.flatnonzero(np.diff(cell[order], prepend=-1))
    left, right = [], []
    for own in np.split(order, cuts[1:]) if len(order) else []:
        leaves, askers = place[own[~asks[own]]], place[own[asks[own]]]
        if not len(leaves) or not len(askers):
            continue
        at_home = same[own[asks[own]]]
        for group, within in ((askers[at_home], True), (askers[~at_home], False)):
            if len(group):
                a, w = trie.search(leaves, group)
                once = a < w if within else np.ones(len(a), dtype=bool)
                left.append(a[once])
                right.append(w[once])
    if not left:
        return pa.table({c: pa.array([], t) for c, t in (("word", pa.string()), ("n_near", pa.int64()), ("best_n", pa.int64()), ("best", pa.string()))})
    a, w = np.concatenate(left), np.concatenate(right)
    word, other = np.concatenate([a, w]), np.concatenate([w, a])
    order = np.lexsort((other, -n[other], word))
    word, other = word[order], other[order]
    first = np.flatnonzero(np.diff(word, prepend=-1))
    return pa.table(
        {
            "word": names.take(pa.array(word[first])),
            "n_near": np.diff(np.append(first, len(word))),
            "best_n": n[other[first]],
            "best": names.take(pa.array(other[first])),
        }
    )


def near_words(vocabulary: DataFrame, settings: SpellingSettings) -> DataFrame:
    """word, n_near, best_n and best of every word (with n) that has near words."""
    ship(vocabulary.sparkSession)
    words = written(vocabulary.select("word", "n", upper_counts(F.col("word")).alias("upper")))
    cells = words.groupBy("upper").agg(F.count(F.lit(1)).alias("words"))
    changes = F.explode(F.array(*[F.array(*map(F.lit, m)) for m in moves()]))
    to = F.zip_with("upper", "change", lambda a, b: a + b)
    routes = cells.select("upper", F.col("words").alias("asking"), changes.alias("change")).select("upper", "asking", to.alias("to"))
    routes = routes.join(cells.select(F.col("upper").alias("to"), "words"), "to")
    asked = routes.groupBy("to").agg(F.max("words").alias("words"), F.sum("asking").alias("asking"))
    part = lambda rows, bound: F.ceil(F.col(rows) / bound).cast("int")
    asked = written(asked.select("to", part("words", settings.block).alias("blocks"), part("asking", settings.slice).alias("slices"), (F.col("words") + F.col("asking")).alias("rows")))
    routes = written(routes.select("upper", "to").join(asked, "to"))
    total = asked.agg(F.sum(F.col("rows") * F.greatest("blocks", "slices"))).first()[0] or 0
    tasks = max(1, ceil(total / settings.task_rows))
    spot = F.xxhash64("word")
    every = lambda number: F.explode(F.sequence(F.lit(0), F.col(number) - 1))
    leaves = words.join(asked.withColumnRenamed("to", "upper"), "upper").select(
        F.col("upper").alias("to"), F.pmod(spot, F.col("blocks")).cast("int").alias("block"), every("slices").alias("slice"), "word", "n", F.lit(False).alias("asks"), F.lit(False).alias("same")
    )
    askers = words.join(routes, "upper").select(
        "to", every("blocks").alias("block"), F.pmod(spot, F.col("slices")).cast("int").alias("slice"), "word", "n", F.lit(True).alias("asks"), (F.col("upper") == F.col("to")).alias("same")
    )
    cell = F.concat_ws(",", F.array_join(F.col("to").cast("array<string>"), ","), F.col("block").cast("string"), F.col("slice").cast("string"))
    rows = leaves.unionByName(askers).select(cell.alias("cell"), "word", "n", "asks", "same")
    dealt = rows.withColumn("task", F.pmod(F.xxhash64("cell"), F.lit(tasks)))
    found = dealt.groupBy("task").applyInArrow(lambda t: near_in(t, settings), "word string, n_near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("best"))).alias("b")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", (-F.col("b.less")).alias("best_n"), F.col("b.best").alias("best"))


def roots(forms: DataFrame, chain: int) -> DataFrame:
    """word and root of words with forms (word, form); no chain is longer than `chain` forms."""
    reached = written(forms.select("word", F.col("form").alias("root")))
    for _ in range(ceil(log2(chain)) if chain > 1 else 0):
        further = reached.select(F.col("word").alias("root"), F.col("root").alias("next"))
        reached = written(reached.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root")))
    return reached


def spelling_forms(documents: DataFrame, key: str = "doc_id", text: str = "text", settings: SpellingSettings | None = None) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word."""
    settings = settings or SpellingSettings()
    vocabulary = written(count_words(documents, key, text, settings))
    near = written(near_words(vocabulary, settings))
    known = vocabulary.join(near, "word", "left")
    is_form = F.col("best_n") >= settings.ratio * F.col("n")
    known = written(known.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(is_form, F.col("best")).alias("form"), F.when(is_form, F.col("best_n")).alias("form_n")))
    most = vocabulary.agg(F.max("n")).first()[0] or 1
    chain = int(log(most) / log(settings.ratio)) + 1
    followed = roots(known.where(F.col("form").isNotNull()).select("word", "form"), chain)
    out = known.join(followed, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
