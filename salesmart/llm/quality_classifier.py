"""Quality scores by votes of the nearest labelled documents.

A text becomes counts of hashed byte trigrams, once of its bytes and once of their shapes
(lower case, upper case, digit, white space, beyond ASCII; other signs stay themselves).
Damped, weighted by rarity and brought to unit length, the counts are projected on the
leading singular vectors of a bounded labelled sample. Every document is compared with
every labelled vector: exact cosines in blocks of a piece of documents by all labelled
rows. Its score is the mean label of its nearest neighbours, weighted by similarity.

The labelled vectors are broadcast; their number and length are parameters, so their size
is bounded.

Defined cases: a null or empty text has no direction and gets the share of good labels;
ties in similarity go to the smaller labelled id; long texts are counted whole; repeated rows get
equal scores, and of labelled rows with one id the least text counts; without labels the score
is 0.5; an empty table gives no rows. Columns of the input other than those named come along
only if they are named in `keep`, and may have any name.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .columns import quoted
from .labelled import labelled_texts
from .storage import ship
from .texts import Piece, pieces


@dataclass(frozen=True)
class KnnSettings:
    """max_labelled bounds the labelled vectors, `width` their length."""

    bits: int = 11
    width: int = 64
    neighbours: int = 15
    sharpness: float = 8.0
    max_labelled: int = 4096
    seed: int = 5


@dataclass(frozen=True)
class Neighbours:
    rarity: np.ndarray
    projection: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray

    @property
    def share(self) -> float:
        return float(self.labels.mean()) if len(self.labels) else 0.5


def _shapes() -> np.ndarray:
    shape = np.arange(256, dtype=np.uint32)
    shape[97:123], shape[65:91], shape[48:58] = 97, 65, 48
    shape[[9, 10, 11, 12, 13, 32]] = 32
    shape[128:] = 97
    return shape


_SHAPE = _shapes()

#: Counts from here on don't fit in two bytes with the others.
FULL = 65_535


def trigram_counts(piece: Piece, bits: int) -> np.ndarray:
    """Per text: counts of hashed byte trigrams, then of shape trigrams."""
    size = 1 << bits
    out = np.zeros((piece.rows, 2 * size), dtype=np.float32)
    if len(piece.data) < 3:
        return out
    row = np.repeat(np.arange(piece.rows, dtype=np.int64), np.diff(piece.bounds))
    same = row[:-2] == row[2:]
    at = row[:-2][same] * size
    for k, codes in enumerate((piece.data.astype(np.uint32), _SHAPE[piece.data])):
        hashed = codes[:-2] * np.uint32(0x9E3779B1) + codes[1:-1] * np.uint32(0x85EBCA77) + codes[2:] * np.uint32(0xC2B2AE3D)
        hashed ^= hashed >> np.uint32(15)
        hashed *= np.uint32(0x2C1B3C6D)
        place = (hashed >> np.uint32(32 - bits)).astype(np.int64)[same]
        out[:, k * size : (k + 1) * size] = np.bincount(at + place, minlength=piece.rows * size).reshape(piece.rows, size)
    return out


def weighted(counts: np.ndarray, rarity: np.ndarray) -> np.ndarray:
    """Damped counts times rarity; bytes and shapes at unit length each."""
    return _scaled(np.log1p(counts, dtype=np.float32), rarity)


def _scaled(out: np.ndarray, rarity: np.ndarray) -> np.ndarray:
    """The same from counts that are damped already, in place."""
    out *= rarity
    half = out.shape[1] // 2
    for part in (out[:, :half], out[:, half:]):
        part /= np.maximum(np.linalg.norm(part, axis=1, keepdims=True), 1e-12)
    return out


def _unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)


def fit_arrays(counts: np.ndarray, labels: np.ndarray, settings: KnnSettings, large: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None) -> Neighbours:
    """`large`: rows and places of counts that are not in `counts` as a whole, and these."""
    rows, size = counts.shape
    rarity = np.log((1 + rows) / (1 + (counts > 0).sum(axis=0))).astype(np.float32) + 1
    if not rows:
        return Neighbours(rarity, np.zeros((size, settings.width), np.float32), np.zeros((0, settings.width), np.float32), labels)
    matrix = np.log1p(counts, dtype=np.float32)
    if large is not None:
        matrix[large[:2]] = np.log1p(large[2], dtype=np.float32)
    matrix = _scaled(matrix, rarity)
    random = np.random.Generator(np.random.PCG64(settings.seed))
    width = min(settings.width, rows)
    # Leading right singular vectors: a few rounds of subspace iteration.
    basis = random.standard_normal((size, width + 10)).astype(np.float32)
    for _ in range(4):
        basis = np.linalg.qr(matrix.T @ (matrix @ basis))[0]
    _, _, turn = np.linalg.svd(matrix @ basis, full_matrices=False)
    projection = (basis @ turn.T)[:, :width].astype(np.float32)
    return Neighbours(rarity, projection, _unit(matrix @ projection), labels.astype(np.float32))


def votes(piece: Piece, fitted: Neighbours, settings: KnnSettings) -> np.ndarray:
    """Score of each text of the piece."""
    out = np.full(piece.rows, fitted.share)
    if not len(fitted.labels):
        return out
    for begin in range(0, piece.rows, 256):
        end = min(begin + 256, piece.rows)
        own = Piece(0, piece.data[piece.bounds[begin] : piece.bounds[end]], piece.bounds[begin : end + 1] - piece.bounds[begin])
        counts = trigram_counts(own, settings.bits)
        told = counts.any(axis=1)
        similar = _unit(weighted(counts, fitted.rarity) @ fitted.projection) @ fitted.vectors.T
        k = min(settings.neighbours, similar.shape[1])
        # The k-th largest is the bar: all above it, then ties in order of the labelled id.
        bar = np.partition(similar, similar.shape[1] - k, axis=1)[:, -k][:, None]
        above = similar > bar
        tied = similar == bar
        room = k - above.sum(axis=1, keepdims=True)
        chosen = above | (tied & (np.cumsum(tied, axis=1) <= room))
        weight = np.where(chosen, np.maximum(similar, 1e-3) ** settings.sharpness, 0)
        score = (weight @ fitted.labels) / weight.sum(axis=1)
        out[begin:end][told] = score[told]
    return np.clip(out, 0, 1)


def fit(documents: DataFrame, sample: DataFrame, key: str = "doc_id", text: str = "text", settings: KnnSettings | None = None) -> Neighbours:
    """Fit on the texts of the sampled labels (key, label)."""
    settings = settings or KnnSettings()
    ship(documents.sparkSession)

    def run(batches):
        for batch in batches:
            for piece in pieces(batch["text"]):
                counts = trigram_counts(piece, settings.bits)
                own = batch.slice(piece.row, piece.rows)
                packed = [c.tobytes() for c in np.minimum(counts, FULL).astype("<u2")]
                # Counts that two bytes don't hold follow as a whole, each with its place.
                over = [[(int(k), int(c[k])) for k in np.flatnonzero(c >= FULL)] for c in counts]
                pairs = pa.array([[x for pair in row for x in pair] for row in over], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([own["key"], own["label"].cast(pa.int32()), pa.array(packed, pa.binary()), pairs], names=["key", "label", "counts", "large"])

    kind = sample.schema["key"].dataType.simpleString()
    rows = labelled_texts(documents, sample, key, text).mapInArrow(run, f"key {kind}, label int, counts binary, large array<long>").toArrow()
    # Held as they came, two bytes a count and the large ones apart; in the order of the ids for the sake of ties.
    order = np.argsort(rows["key"].to_numpy(), kind="stable")
    counts = np.empty((len(rows), 2 << settings.bits), dtype=np.uint16)
    at = 0
    for chunk in rows["counts"].chunks:
        if len(chunk):
            own = np.frombuffer(chunk.buffers()[2], dtype="<u2").reshape(-1, counts.shape[1])
            counts[at : at + len(chunk)] = own[chunk.offset : chunk.offset + len(chunk)]
            at += len(chunk)
    labels = rows["label"].to_numpy().astype(np.float32)
    sizes = pa.compute.list_value_length(rows["large"]).to_numpy().astype(np.int64) // 2
    pairs = pa.compute.list_flatten(rows["large"]).to_numpy().reshape(-1, 2)
    place = np.empty(len(order), dtype=np.int64)
    place[order] = np.arange(len(order))
    large = np.repeat(place, sizes), pairs[:, 0], pairs[:, 1]
    del rows
    return fit_arrays(counts[order], labels[order], settings, large)


def score(documents: DataFrame, fitted: Neighbours, keep: list[str], text: str = "text", settings: KnnSettings | None = None, score_column: str = "score") -> DataFrame:
    """The columns to keep and the score of each row's text."""
    settings = settings or KnnSettings()
    spark = documents.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(fitted)
    source = documents.select(*[quoted(c).alias(f"k{i}") for i, c in enumerate(keep)], quoted(text).alias("text"))
    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in source.schema][:-1] + ["score double"])

    def run(batches):
        for batch in batches:
            for piece in pieces(batch.column(batch.num_columns - 1)):
                own = batch.slice(piece.row, piece.rows)
                found = pa.array(votes(piece, shared.value, settings))
                yield pa.RecordBatch.from_arrays([*own.columns[:-1], found], names=[*own.schema.names[:-1], "score"])

    return source.mapInArrow(run, schema).select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], F.col("score").alias(score_column))
