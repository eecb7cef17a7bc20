"""Benchmark decontamination by winnowing.

Items and documents are cut into words; every run of `gram` words has a hash, and of each
`window - gram + 1` neighbouring hashes the smallest is kept as a fingerprint (all of them
on ties). A span of `window` words that both sides share holds one such neighbourhood, so
both keep the same fingerprint from it: no shared span of that length escapes. Document
fingerprints meet those of the items, each hit is extended to the `window`-word spans
around it, and these are joined with the items' spans word for word.

The fingerprints of the items reach the tasks as a bit table of fixed size, which only
saves work: what passes it by accident falls out of the exact join, so a larger benchmark
needs no other way. An item with fewer words than a window is one span of its own length
and is looked up at that length through a second table of the same size.

Defined cases: a null or empty text has no words, so nothing in it is hit and an empty item
never occurs; long texts are searched whole; repeated documents are judged alike, each on its own; items of the same id
count once; a null item id is left out of the digest but its hits count; empty tables give
no rows or no hits. Columns of the inputs other than those named are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .columns import quoted
from .storage import ship, written
from .texts import PLAIN_WORD, Piece, Words, pieces

WINDOW = 10
GRAM = 5
TABLE_BITS = 23


def fingerprints(words: Words, gram: int, span: int) -> tuple[np.ndarray, np.ndarray]:
    """First word and hash of the winnowed grams: the least of every `span` neighbours."""
    first, hashes = words.windows(gram)
    if span > 1 and len(first):
        text = words.text[first]
        size = len(first) - span + 1
        chosen = np.zeros(len(first), dtype=bool)
        if size > 0:
            least = hashes[:size].copy()
            for k in range(1, span):
                np.minimum(least, hashes[k : k + size], out=least)
            whole = text[:size] == text[span - 1 :]
            for k in range(span):
                chosen[k : k + size] |= whole & (hashes[k : k + size] == least)
        return first[chosen], hashes[chosen]
    return first, hashes


def _word_texts(piece: Piece, words: Words) -> tuple[np.ndarray, np.ndarray]:
    """A-Z lowered bytes of the piece, and where each word ends."""
    data = piece.data.copy()
    upper = (data >= 65) & (data <= 90)
    data[upper] += 32
    outside = np.flatnonzero(~PLAIN_WORD.inside[piece.data])
    bounds = piece.bounds[words.text + 1]
    if not len(outside):
        return data, bounds
    at = np.searchsorted(outside, words.starts)
    ends = np.where(at < len(outside), outside[np.minimum(at, len(outside) - 1)], len(data))
    return data, np.minimum(ends, bounds)


class _Spelled:
    """Words of a piece as text, spelled out only where asked for."""

    def __init__(self, piece: Piece, words: Words):
        self.starts = words.starts
        self.data, self.ends = _word_texts(piece, words)

    def span(self, first: int, length: int) -> str:
        words = range(first, first + length)
        return b" ".join(self.data[self.starts[k] : self.ends[k]].tobytes() for k in words).decode("utf-8", "replace")


def item_spans(benchmark: DataFrame, item: str, text: str, window: int, gram: int) -> DataFrame:
    """Spans of every item: item_id (string), span, words in it, and fingerprints within."""
    source = benchmark.select(quoted(item).cast("string").alias("item_id"), quoted(text).alias("text"))
    schema = "item_id string, span string, length int, marks array<long>"

    def run(batches):
        for batch in batches:
            for piece in pieces(batch["text"]):
                ids = batch["item_id"].slice(piece.row, piece.rows)
                words = PLAIN_WORD.words(piece)
                spelled = _Spelled(piece, words)
                counts = words.counts(piece.rows)
                begins = np.concatenate([[0], np.cumsum(counts)])
                at, hashes = fingerprints(words, gram, window - gram + 1)
                rows, spans, lengths, marks = [], [], [], []
                for row in np.flatnonzero(counts):
                    size = min(int(counts[row]), window)
                    for first in range(begins[row], begins[row + 1] - size + 1):
                        rows.append(int(row))
                        spans.append(spelled.span(first, size))
                        lengths.append(size)
                        if size < window:
                            marks.append(_whole(words.hashes[first : first + size]).view(np.int64).tolist())
                        else:
                            low, high = np.searchsorted(at, [first, first + size - gram + 1])
                            marks.append(hashes[low:high].view(np.int64).tolist())
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(rows, pa.int64())), pa.array(spans, pa.string()), pa.array(lengths, pa.int32()), pa.array(marks, pa.list_(pa.int64()))],
                    names=["item_id", "span", "length", "marks"],
                )

    return source.mapInArrow(run, schema)


def _whole(hashes: np.ndarray) -> np.ndarray:
    """Hash of a short item, taken as one gram."""
    none = np.zeros(len(hashes), dtype=np.int64)
    return Words(none, none, hashes).windows(len(hashes))[1]


def _bit_table(values: np.ndarray, bits: int) -> np.ndarray:
    table = np.zeros(1 << bits, dtype=bool)
    table[(values.view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64)] = True
    return np.packbits(table)


def _in_table(table: np.ndarray, hashes: np.ndarray, bits: int) -> np.ndarray:
    at = hashes >> np.uint64(64 - bits)
    byte = table[(at >> np.uint64(3)).astype(np.int64)]
    return (byte >> (np.uint64(7) - (at & np.uint64(7))).astype(np.uint8)) & 1 > 0


def _tables(spans: DataFrame, window: int, bits: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Bit tables of window fingerprints and of short items, and the short lengths.

    The driver gets at most 2**bits positions, whatever the size of the benchmark.
    """
    marks = spans.select((F.col("length") < window).alias("short"), F.explode("marks").alias("m"))
    places = marks.select("short", F.expr(f"shiftrightunsigned(m, {64 - bits})").alias("p")).distinct()
    found = places.toPandas()
    lengths = [r[0] for r in spans.where(F.col("length") < window).select("length").distinct().collect()]
    tables = []
    for short in (False, True):
        values = found.loc[found["short"] == short, "p"].to_numpy(dtype=np.uint64) << np.uint64(64 - bits)
        tables.append(_bit_table(values, bits))
    return tables[0], tables[1], sorted(lengths)


def mark(
    documents: DataFrame,
    benchmark: DataFrame,
    keep: list[str],
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    gram: int = GRAM,
    table_bits: int = TABLE_BITS,
) -> tuple[DataFrame, DataFrame]:
    """The columns to keep (renamed k0, k1, ...) with the candidate spans of each row, and
    the spans of the items.

    One pass over the texts writes each row with its candidates, most often none; all
    shuffles after that move candidate spans and counts only.
    """
    spark = documents.sparkSession
    ship(spark)
    spans = written(item_spans(benchmark, item, item_text, window, gram))
    plain, short, lengths = _tables(spans, window, table_bits)
    shared = spark.sparkContext.broadcast((plain, short))

    source = documents.select(*[quoted(c).alias(f"k{i}") for i, c in enumerate(keep)], quoted(text).alias("text"))
    kept = [f"{f.name} {f.dataType.simpleString()}" for f in source.schema][:-1]
    schema = ", ".join([*kept, "row long", "n_words long", "at array<long>", "spans array<string>"])
    neighbours = window - gram + 1

    def run(batches):
        from pyspark import TaskContext

        plain_table, short_table = shared.value
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for piece in pieces(batch.column(batch.num_columns - 1)):
                own = batch.slice(piece.row, piece.rows)
                words = PLAIN_WORD.words(piece)
                found = []
                at, hashes = fingerprints(words, gram, neighbours)
                hit = at[_in_table(plain_table, hashes, table_bits)]
                if len(hit):
                    first = np.unique((hit[:, None] - np.arange(neighbours)).ravel())
                    first = first[(first >= 0) & (first + window <= len(words.text))]
                    first = first[words.text[first] == words.text[first + window - 1]]
                    found.append((first, np.full(len(first), window)))
                for length in lengths:
                    first, hashes = words.windows(length)
                    first = first[_in_table(short_table, hashes, table_bits)]
                    found.append((first, np.full(len(first), length)))
                first = np.concatenate([f[0] for f in found]) if found else np.zeros(0, dtype=np.int64)
                size = np.concatenate([f[1] for f in found]) if found else np.zeros(0, dtype=np.int64)
                order = np.argsort(words.text[first], kind="stable") if len(first) else first
                first, size = first[order], size[order]
                spelled = _Spelled(piece, words) if len(first) else None
                texts = [spelled.span(f, s) for f, s in zip(first.tolist(), size.tolist())]
                counts = words.counts(piece.rows)
                begins = np.concatenate([[0], np.cumsum(counts)])
                row_of = words.text[first]
                offsets = pa.array(np.searchsorted(row_of, np.arange(piece.rows + 1)).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        *own.columns[:-1],
                        pa.array(np.arange(row, row + piece.rows)),
                        pa.array(counts),
                        pa.ListArray.from_arrays(offsets, pa.array(first - begins[row_of])),
                        pa.ListArray.from_arrays(offsets, pa.array(texts, pa.string())),
                    ],
                    names=[*own.schema.names[:-1], "row", "n_words", "at", "spans"],
                )
                row += piece.rows

    marked = written(source.mapInArrow(run, schema))
    return marked, spans


def decontaminate(documents: DataFrame, benchmark: DataFrame, keep: list[str], **options) -> DataFrame:
    """The columns to keep, and per row what of its text lies in item windows.

    Adds n_words, n_hit, n_items, items_sha256 and contaminated. `options` are those of
    `mark`.
    """
    marked, spans = mark(documents, benchmark, keep, **options)
    out = marked.drop("at", "spans").join(_hits(marked, spans), "row", "left")
    return out.select(
        *[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)],
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce("items", F.lit("")), 256).alias("items_sha256"),
        F.col("n_hit").isNotNull().alias("contaminated"),
    )


def clean_documents(documents: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents without a hit, with all their columns.

    Rows without a candidate are clean at once; only the others are joined.
    """
    columns = documents.columns
    marked, spans = mark(documents, benchmark, columns, **options)
    clean = marked.join(_hits(marked, spans).select("row"), "row", "left_anti")
    return clean.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(columns)])


def _hits(marked: DataFrame, spans: DataFrame) -> DataFrame:
    """Per document row with a real hit: words hit, items, and the items' ids joined."""
    candidates = marked.where(F.size("spans") > 0).select("row", F.explode(F.arrays_zip("at", "spans")).alias("c"))
    candidates = candidates.select("row", F.col("c.at").alias("at"), F.col("c.spans").alias("span"))
    # Written, so that both sides of the join are plain scans: a span that many documents
    # share is split, or broadcast against, by what Spark sees of the sizes.
    items = written(spans.groupBy("span").agg(F.first("length").alias("length"), F.collect_set("item_id").alias("items")))
    found = candidates.join(items, "span")
    # Spans of a document come back as begin and length. Words are hit in the union of the
    # spans: sorted by begin, each adds what lies beyond the furthest end before it.
    hits = found.groupBy("row").agg(
        F.array_sort(F.collect_list(F.struct("at", "length"))).alias("hit"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("ids"),
    )
    union = F.aggregate(
        "hit",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end")),
        lambda a, h: F.struct(
            (a["n"] + F.greatest(F.lit(0), h["at"] + h["length"] - F.greatest(h["at"], a["end"]))).alias("n"),
            F.greatest(a["end"], h["at"] + h["length"]).alias("end"),
        ),
        lambda a: a["n"],
    )
    return hits.select("row", union.alias("n_hit"), F.size("ids").alias("n_items"), F.array_join("ids", ",").alias("items"))
