"""Quality rules: plain counts, then divergence from language references.

A first pass over whole texts reduces each document to counts: words, symbols, repeated
lines, repeated five-word windows, a histogram of character classes and one of common
words. Summed per language over all documents the histograms become the references. A
document fails if it breaks a base rule, or if it is long enough to tell and its histograms
lie further from every reference, by Jensen-Shannon distance, than the limits allow.

Defined cases: a null or empty text has no words and fails the base rule on length;
long texts are counted whole; repeated rows are judged alike, each on its own; documents of a
null or unlisted language form a reference of their own; references are over all documents, odd
ones too, and of references equally near any decides alike; an empty table gives an empty result. Columns of the input
other than those named are not looked at, so their names can't clash.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .columns import quoted
from .storage import ship, written
from .texts import ANY_WORD, LINE, PLAIN_WORD, Piece, mix, pieces

# Frequent words of each language.
COMMON_WORDS = {
    "en": "the of and to in a is that for it was on with as be at by this from or are an he his not but you which",
    "fr": "le la les de des du un une et est en que qui dans pour par sur pas au avec ce il elle ne se plus",
    "de": "der die das und ist in zu den von mit dem des ein eine nicht auf für als auch es sich an im er so",
    "es": "el la los las de del un una y es en que por con para no se su al lo como más pero o sus le",
}
# Bytes of each character class; all other first bytes are letters beyond ASCII.
CLASSES = {
    "lower": b"abcdefghijklmnopqrstuvwxyz",
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "digit": b"0123456789",
    "space": b" \t\n\v\f\r",
    "stop": b".,;:!?'\"()-",
    "symbol": b"#*$%&|<>",
    "other": bytes(set(range(128)) - set(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789 \t\n\v\f\r.,;:!?'\"()-#*$%&|<>")),
}
SYMBOLS = CLASSES["symbol"]
OTHER_LANGUAGE = "other"


@dataclass(frozen=True)
class QualityRules:
    """Limits. Distances are in [0, 1]; the guards say from what length on they are used."""

    min_words: int = 10
    max_repeat_percent: int = 20
    window: int = 5
    guard_chars: int = 400
    max_class_distance: float = 0.28
    guard_words: int = 200
    max_word_distance: float = 0.30


FEATURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, class_counts array<long>, word_counts array<int>"


def measure(documents: DataFrame, keep: list[str], text: str = "text", window: int = 5) -> DataFrame:
    """The columns to keep, renamed k0, k1, ..., and per row the counts of its text."""
    ship(documents.sparkSession)
    kept = documents.select(*map(quoted, keep))
    source = documents.select(*[quoted(c).alias(f"k{i}") for i, c in enumerate(keep)], quoted(text).alias("text"))
    schema = ", ".join([f"k{i} {f.dataType.simpleString()}" for i, f in enumerate(kept.schema)] + [FEATURES])
    counter = _Counter(window)

    def run(batches):
        for batch in batches:
            for piece in pieces(batch.column(batch.num_columns - 1)):
                own = batch.slice(piece.row, piece.rows)
                counts = counter.counts(piece)
                yield pa.RecordBatch.from_arrays([*own.columns[:-1], *counts], names=[*own.schema.names[:-1], *_FEATURE_NAMES])

    return source.mapInArrow(run, schema)


_FEATURE_NAMES = [part.split()[0] for part in FEATURES.split(", ")]


class _Counter:
    """Counts of every text of a piece, as Arrow arrays in the order of FEATURES."""

    def __init__(self, window: int):
        self.window = window
        self.common = common_words()
        hashes = PLAIN_WORD.hashes_of(self.common)
        self.order = np.argsort(hashes)
        self.sorted_hashes = hashes[self.order]
        self.symbol = np.isin(np.arange(256), list(SYMBOLS)).astype(np.int8)
        self.begins_char = (np.arange(256) & 0xC0) != 0x80
        lanes = np.zeros((4, 256), dtype=np.int64)
        for k, of_class in enumerate([*CLASSES.values(), bytes(range(0xC0, 0x100))]):
            lanes[k // 2, list(of_class)] = 1 << (31 * (k % 2))
        self.lanes = lanes

    def counts(self, piece: Piece) -> list[pa.Array]:
        rows = piece.rows
        words = ANY_WORD.words(piece)
        characters = piece.totals(ANY_WORD.inside[piece.data] & self.begins_char[piece.data])
        classes = np.empty((rows, 8), dtype=np.int64)
        for k in range(4):
            pair = piece.totals(self.lanes[k][piece.data])
            classes[:, 2 * k], classes[:, 2 * k + 1] = pair & ((1 << 31) - 1), pair >> 31
        plain = PLAIN_WORD.words(piece)
        at = np.minimum(np.searchsorted(self.sorted_hashes, plain.hashes), len(self.common) - 1)
        known = self.sorted_hashes[at] == plain.hashes
        width = len(self.common) + 1
        column = np.where(known, self.order[at], width - 1)
        common = np.bincount(plain.text * width + column, minlength=rows * width).astype(np.int32)
        return [
            pa.array(words.counts(rows)),
            pa.array(characters),
            pa.array(piece.totals(self.symbol[piece.data])),
            pa.array(_repeated_lines(piece)),
            pa.array(self._repeated_words(words, rows)),
            _lists(classes),
            _lists(common.reshape(rows, width)),
        ]

    def _repeated_words(self, words, rows: int) -> np.ndarray:
        first, hashes = words.windows(self.window)
        twice = first[_seen_twice(hashes ^ mix(words.text[first].astype(np.uint64)))]
        covered = np.zeros(len(words.text) + 1, dtype=np.int32)
        np.add.at(covered, twice, 1)
        np.add.at(covered, twice + self.window, -1)
        return np.bincount(words.text[np.cumsum(covered[:-1]) > 0], minlength=rows)


def common_words() -> list[str]:
    """All listed words, each once, in the order listed."""
    return list(dict.fromkeys(word for words in COMMON_WORDS.values() for word in words.split()))


def _seen_twice(keys: np.ndarray) -> np.ndarray:
    order = np.argsort(keys)
    same = keys[order][1:] == keys[order][:-1]
    twice = np.zeros(len(keys), dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    return twice


def _repeated_lines(piece: Piece) -> np.ndarray:
    lines = LINE.words(piece)
    if not len(lines.starts):
        return np.zeros(piece.rows, dtype=np.int64)
    worded = np.logical_or.reduceat(ANY_WORD.inside[piece.data], lines.starts)
    text = lines.text[worded]
    keys = lines.hashes[worded] ^ mix(text.astype(np.uint64))
    _, first = np.unique(keys, return_index=True)
    return np.bincount(text, minlength=piece.rows) - np.bincount(text[first], minlength=piece.rows)


def _lists(matrix: np.ndarray) -> pa.Array:
    offsets = pa.array(np.arange(0, matrix.size + 1, matrix.shape[1], dtype=np.int32))
    return pa.ListArray.from_arrays(offsets, pa.array(matrix.ravel()))


def references(measured: DataFrame, language: str) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Histograms over all documents of each listed language, and of the rest.

    One row per listed language comes to the driver, whatever the input.
    """
    known = F.col(language).isin(list(COMMON_WORDS))
    width = len(common_words()) + 1
    sums = [F.sum(F.col("class_counts")[k]).alias(f"c{k}") for k in range(8)]
    sums += [F.sum(F.col("word_counts")[k].cast("long")).alias(f"w{k}") for k in range(width)]
    rows = measured.groupBy(F.when(known, F.col(language)).otherwise(OTHER_LANGUAGE).alias("l")).agg(*sums).collect()
    out = {}
    for row in sorted(rows):
        classes, words = np.array(row[1:9], dtype=float), np.array(row[9:], dtype=float)
        if classes.sum() and words.sum():
            out[row[0]] = classes, words
    return out


def distance(counts: np.ndarray, reference: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance (base 2) of each row from the reference; 0 for empty rows."""
    totals = counts.sum(axis=1, keepdims=True)
    p = counts / np.maximum(totals, 1)
    q = reference / reference.sum()
    middle = (p + q) / 2

    def part(x):
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(x > 0, x * np.log2(x / middle), 0.0).sum(axis=1)

    out = np.sqrt(np.clip((part(p) + part(np.broadcast_to(q, p.shape))) / 2, 0, 1))
    return np.where(totals[:, 0] > 0, out, 0.0)


def judged(measured: DataFrame, language: str, rules: QualityRules) -> DataFrame:
    """Adds base_failed, class_distance, word_distance and kept to measured documents."""
    known = references(measured, language)
    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in measured.schema][:-2])
    schema += ", base_failed boolean, class_distance double, word_distance double, kept boolean"

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            classes = batch["class_counts"].flatten().to_numpy().reshape(batch.num_rows, -1).astype(float)
            words = batch["word_counts"].flatten().to_numpy().reshape(batch.num_rows, -1).astype(float)
            by_class = np.stack([distance(classes, r[0]) for r in known.values()]) if known else np.zeros((1, batch.num_rows))
            by_word = np.stack([distance(words, r[1]) for r in known.values()]) if known else np.zeros((1, batch.num_rows))
            best = np.argmin(by_class + by_word, axis=0)
            at = np.arange(batch.num_rows)
            by_class, by_word = by_class[best, at], by_word[best, at]
            n_words = batch["n_words"].to_numpy()
            repeated = batch["n_repeat_words"].to_numpy()
            failed = (n_words < rules.min_words) | (100 * repeated > rules.max_repeat_percent * n_words)
            odd = (classes.sum(axis=1) >= rules.guard_chars) & (by_class > rules.max_class_distance)
            odd |= (words.sum(axis=1) >= rules.guard_words) & (by_word > rules.max_word_distance)
            columns = [*batch.columns[:-2], pa.array(failed), pa.array(by_class), pa.array(by_word), pa.array(~failed & ~odd)]
            names = [*batch.schema.names[:-2], "base_failed", "class_distance", "word_distance", "kept"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return measured.mapInArrow(run, schema)


def quality_rules(documents: DataFrame, key: str = "doc_id", text: str = "text", language: str = "lang", rules: QualityRules | None = None) -> DataFrame:
    """Counts, distances and verdict per row of `documents`.

    The counts are written once, since references and verdicts both read them.
    """
    rules = rules or QualityRules()
    measured = written(measure(documents, [key, language], text, rules.window))
    return judged(measured, "k1", rules).drop("k1").withColumnRenamed("k0", key)


def kept_documents(documents: DataFrame, text: str = "text", language: str = "lang", rules: QualityRules | None = None) -> DataFrame:
    """The documents that pass, with all their columns.

    The columns are carried along while the text is measured, so that each row keeps its
    own verdict, whatever its id.
    """
    rules = rules or QualityRules()
    columns = documents.columns
    measured = written(measure(documents, columns, text, rules.window))
    kept = judged(measured, f"k{columns.index(language)}", rules).where("kept")
    return kept.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(columns)])
