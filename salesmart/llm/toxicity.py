"""Toxicity scores of a factorization machine over hashed terms.

The score is the logistic of a bias, one weight per term present, and the products of
latent vectors of every two terms present, so that a pair can count for more than its
parts. Terms are words with A-Z lowered, hashed to 2**bits places. Every place that enough
labelled rows have gets a vector, also one that tells nothing alone and much together with
another; after some epochs, a penalty on whole vectors takes those back to zero that no pair
needs, places without a weight and a vector leave, and the rest is fitted anew. Weights are for places that
tell something alone (a likelihood-ratio test), so that rare words of a few rows don't add up.
Fitted on a bounded sample of labelled rows on the driver, then sent to the tasks, which score
whole texts. Model size is bounded by the number of places.

Defined cases: a null or empty text gets the score of the bias alone; long texts are scored
whole; repeated rows get equal scores, and of labelled rows with one id the least text counts;
without labelled rows of both kinds every score is the share of positives, or 0 without labels;
an empty table gives no rows. Columns of the input other than those named come along only if
they are named in `keep`, and may have any name.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .columns import quoted
from .labelled import labelled_texts_in_place
from .storage import ship, written
from .texts import PLAIN_WORD, Piece, pieces


@dataclass(frozen=True)
class FmSettings:
    """`max_labelled` bounds the rows the model is fitted on, and `max_terms` their terms; a place
    needs `least_rows` labelled rows, and `least_ratio`, in G-test units, for a weight. Vectors
    learn at `pair_rate`; from epoch `shrink_from` on, each step takes `shrink` off their length
    unless the place tells alone."""

    bits: int = 20
    factors: int = 8
    epochs: int = 16
    batch: int = 256
    rate: float = 0.1
    pair_rate: float = 0.06
    penalty: float = 2e-4
    pair_penalty: float = 2e-2
    shrink: float = 1e-2
    shrink_from: int = 8
    least_rows: int = 3
    least_ratio: float = 6.6
    max_labelled: int = 20_000
    max_terms: int = 1 << 24
    seed: int = 11


@dataclass(frozen=True)
class Model:
    """places: sorted hash places with weights; one weight and one vector for each."""

    places: np.ndarray
    bias: float
    weights: np.ndarray
    vectors: np.ndarray


def terms(piece: Piece, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Text and place of every distinct term of each text."""
    words = PLAIN_WORD.words(piece)
    place = (words.hashes >> np.uint64(64 - bits)).astype(np.int64)
    both = np.unique((words.text.astype(np.int64) << bits) | place)
    return both >> bits, both & ((1 << bits) - 1)


def fit(documents: DataFrame, sample: DataFrame, key: str = "doc_id", text: str = "text", settings: FmSettings | None = None) -> Model:
    """Fit on the texts of the sampled labels (key, label)."""
    settings = settings or FmSettings()
    ship(documents.sparkSession)
    bits = settings.bits

    def run(batches):
        for batch in batches:
            for piece in pieces(batch["text"]):
                row, place = terms(piece, bits)
                offsets = pa.array(np.searchsorted(row, np.arange(piece.rows + 1)).astype(np.int32))
                own = batch.slice(piece.row, piece.rows)
                lists = pa.ListArray.from_arrays(offsets, pa.array(place.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([own["key"], own["label"].cast(pa.int32()), lists], names=["key", "label", "places"])

    kind = sample.schema["key"].dataType.simpleString()
    listed = written(labelled_texts_in_place(documents, sample, key, text).mapInArrow(run, f"key {kind}, label int, places array<int>"))
    total = listed.agg(F.sum(F.size("places"))).first()[0] or 0
    if total > settings.max_terms:
        listed = listed.where(F.abs(F.xxhash64("key", F.lit("terms"))) < int(settings.max_terms / total * (1 << 63)))
    rows = listed.toArrow()
    rows = rows.take(pa.compute.sort_indices(rows["key"]))
    labels = rows["label"].to_numpy().astype(np.float64)
    lists = rows["places"].combine_chunks()
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    sizes = pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64) if len(lists) else np.zeros(0, dtype=np.int64)
    return fit_arrays(labels, np.repeat(np.arange(len(labels)), sizes), lists.flatten().to_numpy().astype(np.int64), settings)


def fit_arrays(labels: np.ndarray, row: np.ndarray, place: np.ndarray, settings: FmSettings) -> Model:
    """`row` ascends; each (row, place) is there once."""
    empty = np.zeros(0, dtype=np.int64)
    share = labels.mean() if len(labels) else 0.0
    if not 0 < share < 1:
        return Model(empty, np.inf if share == 1 else -np.inf, empty.astype(float), np.zeros((0, settings.factors)))
    distinct, local = np.unique(place, return_inverse=True)
    chosen = distinct[np.bincount(local, minlength=len(distinct)) >= settings.least_rows]
    if not len(chosen):
        return Model(empty, float(np.log(share / (1 - share))), empty.astype(float), np.zeros((0, settings.factors)))
    telling = _telling(labels, row, place, settings)
    # First all together, to see which places some pair needs; then those alone, so that what
    # the others picked up by chance on the way has no part in it.
    *_, vectors = _descended(labels, *_within(chosen, row, place), np.isin(chosen, telling), settings, True)
    chosen = chosen[np.isin(chosen, telling) | (vectors != 0).any(axis=1)]
    return Model(chosen, *_descended(labels, *_within(chosen, row, place), np.isin(chosen, telling), settings, False))


def _within(chosen: np.ndarray, row: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and numbers of the chosen places."""
    if not len(chosen):
        return row[:0], row[:0]
    at = np.minimum(np.searchsorted(chosen, place), len(chosen) - 1)
    known = chosen[at] == place
    return row[known], at[known]


def _descended(labels: np.ndarray, row: np.ndarray, feature: np.ndarray, alone: np.ndarray, settings: FmSettings, shrinking: bool) -> tuple[float, np.ndarray, np.ndarray]:
    """Bias, weights and vectors by adaptive gradient steps; `alone`: places that have a weight."""
    share, size = labels.mean(), len(alone)
    random = np.random.Generator(np.random.PCG64(settings.seed))
    bias = np.log(share / (1 - share))
    weights = np.zeros(size)
    vectors = random.normal(0, 0.01, (size, settings.factors))
    seen_b, seen_w, seen_v = 1e-6, np.full(size, 1e-6), np.full(vectors.shape, 1e-6)
    begins = np.searchsorted(row, np.arange(len(labels) + 1))
    for epoch in range(settings.epochs):
        order = random.permutation(len(labels))
        for begin in range(0, len(order), settings.batch):
            rows = order[begin : begin + settings.batch]
            sizes = begins[rows + 1] - begins[rows]
            own = np.repeat(np.arange(len(rows)), sizes)
            places = feature[np.repeat(begins[rows] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())]
            logit, sums = _logits(len(rows), own, places, bias, weights, vectors)
            error = _logistic(logit) - labels[rows]
            step = error.mean()
            seen_b += step * step
            bias -= settings.rate * step / np.sqrt(seen_b)
            distinct, local = np.unique(places, return_inverse=True)
            slope_w = np.bincount(local, error[own], len(distinct)) / len(rows) + settings.penalty * weights[distinct]
            slope_w[~alone[distinct]] = 0
            pulls = [np.bincount(local, error[own] * (sums[own, k] - vectors[places, k]), len(distinct)) for k in range(settings.factors)]
            slope_v = np.stack(pulls, axis=1) / len(rows) + settings.pair_penalty * vectors[distinct]
            seen_w[distinct] += slope_w**2
            seen_v[distinct] += slope_v**2
            weights[distinct] -= settings.rate * slope_w / np.sqrt(seen_w[distinct])
            vectors[distinct] -= settings.pair_rate * slope_v / np.sqrt(seen_v[distinct])
            if shrinking and epoch >= settings.shrink_from:
                length = np.sqrt((vectors[distinct] ** 2).sum(axis=1))
                left = np.maximum(0, 1 - settings.shrink / np.maximum(length, 1e-12))
                left[alone[distinct]] = 1
                vectors[distinct] *= left[:, None]
    return float(bias), weights, vectors


def _telling(labels: np.ndarray, row: np.ndarray, place: np.ndarray, settings: FmSettings) -> np.ndarray:
    """Places whose presence and label depend on each other, by the likelihood ratio."""
    distinct, local = np.unique(place, return_inverse=True)
    there = np.bincount(local, minlength=len(distinct)).astype(float)
    good = np.bincount(local, labels[row], len(distinct))
    rows, positive = len(labels), labels.sum()

    def part(observed, expected):
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(observed > 0, observed * np.log(observed / expected), 0.0)

    ratio = 2 * (
        part(good, there * positive / rows)
        + part(there - good, there * (rows - positive) / rows)
        + part(positive - good, (rows - there) * positive / rows)
        + part(rows - positive - there + good, (rows - there) * (rows - positive) / rows)
    )
    return distinct[(there >= settings.least_rows) & (ratio >= settings.least_ratio)]


def _logits(rows: int, row: np.ndarray, feature: np.ndarray, bias: float, weights: np.ndarray, vectors: np.ndarray):
    linear = np.bincount(row, weights[feature], rows)
    sums = np.stack([np.bincount(row, v[feature], rows) for v in vectors.T], axis=1)
    squares = np.bincount(row, (vectors**2).sum(axis=1)[feature], rows)
    return bias + linear + ((sums**2).sum(axis=1) - squares) / 2, sums


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def scores(piece: Piece, model: Model, bits: int) -> np.ndarray:
    row, place = terms(piece, bits)
    if not len(model.places):
        share = 0.0 if model.bias == -np.inf else 1.0 if model.bias == np.inf else _logistic(np.array([model.bias]))[0]
        return np.full(piece.rows, share)
    at = np.minimum(np.searchsorted(model.places, place), len(model.places) - 1)
    known = model.places[at] == place
    return _logistic(_logits(piece.rows, row[known], at[known], model.bias, model.weights, model.vectors)[0])


def score(documents: DataFrame, model: Model, keep: list[str], text: str = "text", settings: FmSettings | None = None) -> DataFrame:
    """The columns to keep and the score of each row's text."""
    settings = settings or FmSettings()
    spark = documents.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)
    source = documents.select(*[quoted(c).alias(f"k{i}") for i, c in enumerate(keep)], quoted(text).alias("text"))
    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in source.schema][:-1] + ["score double"])
    bits = settings.bits

    def run(batches):
        for batch in batches:
            for piece in pieces(batch.column(batch.num_columns - 1)):
                own = batch.slice(piece.row, piece.rows)
                found = pa.array(scores(piece, shared.value, bits))
                yield pa.RecordBatch.from_arrays([*own.columns[:-1], found], names=[*own.schema.names[:-1], "score"])

    return source.mapInArrow(run, schema).select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "score")
