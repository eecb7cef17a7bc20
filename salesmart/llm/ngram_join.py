"""N-gram Jaccard self-join with Bayesian candidate pruning.

Documents are sets of five-word shingles, and every two with a Jaccard similarity of the
threshold or more are linked. Documents of one set are copies; each distinct set is joined
once, with its number of copies.

1. One pass over all texts gives each document a digest of its set and MinHash values, in
   bands. Sets that agree in a band are candidates. With 40 bands of 6 values a pair at the
   threshold of 0.8 meets in one but for 5 cases in a million, a pair at 0.85 but for 6 in
   a thousand million.
2. A band value that many sets share would give the square of their number in pairs: its
   sets form a family instead. The pairs of other band values are pruned: their MinHash
   values are compared a few at a time, and a pair goes as soon as the posterior
   probability of reaching the threshold, under a uniform prior, falls below the tolerance.
   What is left joins families too, through connected components.
3. The sets of a family meet in blocks: every two blocks of it are one group of bounded
   size, whatever the size of the family. There all pairs are pruned in the same way and
   the rest verified exactly, from the shingles themselves. A group returns per set the
   number of documents linked to it and the least set it hangs together with, never pairs.
4. Links add up per set; components over what hangs together are the classes.

Defined cases: a text of fewer words than a shingle is one shingle; a null text or one
without words is in no link and a class of its own; ties of the least document go to the
smaller text digest; repeated rows are copies of one another; the class of documents that
all have null ids is null; long texts are shingled whole; empty tables give no rows. Columns of the input other than those
named are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass
from fractions import Fraction
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .columns import private_name, quoted
from .components import components
from .storage import ship, written
from .texts import PLAIN_WORD, mix, pieces


@dataclass(frozen=True)
class JoinSettings:
    """`crowd`: band values with more sets than this make families at once. `block` and
    `block_shingles` bound the groups of verification; up to `spread` blocks of a family are
    made of `fine_block` sets already, so that families of a few thousand are spread as well.
    `compared` MinHash values at most are compared, `step` at a time, before a pair is
    verified."""

    shingle: int = 5
    threshold: Fraction = Fraction(4, 5)
    bands: int = 40
    rows: int = 6
    step: int = 24
    compared: int = 72
    tolerance: float = 1e-6
    crowd: int = 32
    block: int = 1024
    block_shingles: int = 1 << 20
    fine_block: int = 128
    spread: int = 32
    seed: int = 97

    @property
    def hashes(self) -> int:
        return self.bands * self.rows


def least_matches(settings: JoinSettings) -> list[int]:
    """After each step: the fewest equal values that leave a pair in.

    Values are kept to a byte, so unequal ones agree in one of 256 cases. With `m` of `n`
    equal, the posterior of a uniform prior reaches the threshold with the probability that
    n + 1 tosses at the threshold give m heads at most.
    """
    t = float(settings.threshold)
    t += (1 - t) / 256
    out = []
    for n in range(settings.step, settings.compared + 1, settings.step):
        below, m = 0.0, -1
        while below < settings.tolerance:
            m += 1
            below += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        out.append(m)
    return out


class _Hasher:
    def __init__(self, settings: JoinSettings):
        self.settings = settings
        random = np.random.Generator(np.random.PCG64(settings.seed))
        self.factors = random.integers(0, 1 << 63, settings.hashes, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.terms = random.integers(0, 1 << 63, settings.hashes, dtype=np.uint64)

    def sets(self, piece) -> tuple[np.ndarray, np.ndarray]:
        """Text and hash of every distinct shingle, by text and then hash."""
        words = PLAIN_WORD.words(piece)
        first, hashes = words.windows(self.settings.shingle)
        text = words.text[first]
        counts = words.counts(piece.rows)
        begins = np.concatenate([[0], np.cumsum(counts)])
        short = np.flatnonzero((counts > 0) & (counts < self.settings.shingle))
        if len(short):
            whole = []
            for row in short:
                own = words.hashes[begins[row] : begins[row + 1]]
                value = np.zeros(1, dtype=np.uint64)
                for h in own:
                    value = mix(value * np.uint64(3) + h)
                whole.append(value)
            text, hashes = np.concatenate([text, short]), np.concatenate([hashes, *whole])
        order = np.lexsort((hashes, text))
        text, hashes = text[order], hashes[order]
        new = np.ones(len(text), dtype=bool)
        new[1:] = (text[1:] != text[:-1]) | (hashes[1:] != hashes[:-1])
        return text[new], hashes[new]

    def digests(self, starts: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """16 bytes for each set: two sums over its shingles."""
        salt = np.uint64(0xD6E8FEB86659FD93)
        return np.stack([np.add.reduceat(mix(hashes), starts), np.add.reduceat(mix(hashes ^ salt), starts)], axis=1)

    def signatures(self, starts: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per set: band values, and the MinHash values cut to a byte."""
        s = self.settings
        values = np.empty((len(starts), s.hashes), dtype=np.uint64)
        for k in range(s.hashes):
            values[:, k] = np.minimum.reduceat(hashes * self.factors[k] + self.terms[k], starts)
        values = mix(values)
        bands = np.empty((len(starts), s.bands), dtype=np.uint64)
        for b in range(s.bands):
            total = np.full(len(starts), b + 1, dtype=np.uint64)
            for k in range(b * s.rows, (b + 1) * s.rows):
                total = mix(total * np.uint64(0x9E3779B97F4A7C15) + values[:, k])
            bands[:, b] = total
        return bands.view(np.int64), (values >> np.uint64(56)).astype(np.uint8)


def _binary(rows: np.ndarray) -> pa.Array:
    """Equal stretches of bytes, one per row."""
    raw = np.ascontiguousarray(rows).view(np.uint8).reshape(len(rows), -1)
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * raw.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(raw.ravel())])


def _signed(documents: DataFrame, key: str, text: str, settings: JoinSettings) -> DataFrame:
    """doc_id, text_key, set (null without words), n, bands and signature of every row."""
    ship(documents.sparkSession)
    source = documents.select(quoted(key).alias("doc_id"), F.md5(F.coalesce(quoted(text), F.lit("")).cast("binary")).alias("text_key"), quoted(text).alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    hasher = _Hasher(settings)

    def run(batches):
        for batch in batches:
            for piece in pieces(batch["text"]):
                own = batch.slice(piece.row, piece.rows)
                row, hashes = hasher.sets(piece)
                present, starts = np.unique(row, return_index=True)
                if len(present):
                    digests, (bands, signature) = hasher.digests(starts, hashes), hasher.signatures(starts, hashes)
                else:
                    digests, bands, signature = np.zeros((0, 2), np.uint64), np.zeros((0, settings.bands), np.int64), np.zeros((0, settings.hashes), np.uint8)
                place = np.full(piece.rows, -1, dtype=np.int64)
                place[present] = np.arange(len(present))
                at = pa.array(place, mask=place < 0)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(present) + 1, dtype=np.int32) * settings.bands), pa.array(bands.ravel()))
                yield pa.RecordBatch.from_arrays(
                    [own["doc_id"], own["text_key"], _binary(digests).take(at), lists.take(at), _binary(signature).take(at)],
                    names=["doc_id", "text_key", "set", "bands", "signature"],
                )

    return source.mapInArrow(run, f"doc_id {kind}, text_key string, set binary, bands array<long>, signature binary")


def _survivors(a: np.ndarray, b: np.ndarray, settings: JoinSettings) -> np.ndarray:
    """Which rows of two signature tables may still reach the threshold."""
    alive = np.arange(len(a))
    equal = np.zeros(len(a), dtype=np.int32)
    for k, least in enumerate(least_matches(settings)):
        part = slice(k * settings.step, (k + 1) * settings.step)
        equal[alive] += (a[alive, part] == b[alive, part]).sum(axis=1)
        alive = alive[equal[alive] >= least]
    return alive


def _pruned(pairs: DataFrame, signatures: DataFrame, settings: JoinSettings) -> DataFrame:
    """The pairs (a, b) of sets that the comparison of their signatures leaves."""
    left = signatures.select(F.col("set").alias("a"), F.col("signature").alias("left"))
    right = signatures.select(F.col("set").alias("b"), F.col("signature").alias("right"))
    full = pairs.join(left, "a").join(right, "b").select("a", "b", "left", "right")

    def run(batches):
        for batch in batches:
            tables = [np.frombuffer(b"".join(batch[c].to_pylist()), dtype=np.uint8).reshape(batch.num_rows, -1) for c in ("left", "right")]
            alive = _survivors(*tables, settings) if batch.num_rows else np.zeros(0, dtype=np.int64)
            yield batch.select(["a", "b"]).take(pa.array(alive))

    return full.mapInArrow(run, "a binary, b binary")


def _families(sets: DataFrame, settings: JoinSettings) -> DataFrame:
    """set and family of every set that has a candidate partner."""
    bands = sets.select("set", F.explode("bands").alias("band"))
    shared = bands.groupBy("band").agg(F.count(F.lit(1)).alias("size"), F.min("set").alias("least")).where(F.col("size") > 1)
    shared = written(shared)
    members = written(bands.join(shared, "band"))
    crowded = F.col("size") > settings.crowd
    # A set and the least one of each crowd it is in are of one family, so two sets that have a
    # crowd's least one in common need not be compared.
    stars = members.where(crowded & (F.col("set") != F.col("least"))).select("set", "least").distinct()
    stars = written(stars)
    crowds = stars.groupBy("set").agg(F.min("least").alias("crowd"))
    few = members.where(~crowded).join(crowds, "set", "left")
    few = written(few.select("band", "set", F.coalesce("crowd", "set").alias("crowd")))
    other = few.select("band", F.col("set").alias("b"), F.col("crowd").alias("other"))
    met = few.withColumnRenamed("set", "a").join(other, "band").where((F.col("a") < F.col("b")) & (F.col("crowd") != F.col("other")))
    pairs = written(met.select("a", "b").distinct())
    near = _pruned(pairs, sets.select("set", "signature"), settings)
    links = stars.select(F.col("set").alias("a"), F.col("least").alias("b")).unionByName(near)
    return components(links).select(F.col("node").alias("set"), F.col("root").alias("family"))


def _shingled(documents: DataFrame, key: str, text: str, needed: DataFrame, settings: JoinSettings) -> DataFrame:
    """The needed sets with their shingles, read again from one document each."""
    hasher = _Hasher(settings)
    own = documents.select(quoted(key).alias("doc_id"), F.md5(F.coalesce(quoted(text), F.lit("")).cast("binary")).alias("text_key"), quoted(text).alias("text"))
    place = needed.select(F.col("place.doc_id").alias("d"), F.col("place.text_key").alias("t"), "set", "copies", "family", "signature")
    found = own.join(place, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_key") == F.col("t")))
    found = found.select("set", "copies", "family", "signature", "text")

    def run(batches):
        for batch in batches:
            for piece in pieces(batch["text"]):
                own = batch.slice(piece.row, piece.rows)
                row, hashes = hasher.sets(piece)
                offsets = np.searchsorted(row, np.arange(piece.rows + 1))
                packed = pa.Array.from_buffers(pa.binary(), piece.rows, [None, pa.py_buffer((8 * offsets).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(hashes))])
                sizes = pa.array(np.diff(offsets))
                yield pa.RecordBatch.from_arrays([*own.columns[:-1], sizes, packed], names=[*own.schema.names[:-1], "size", "shingles"])

    out = found.mapInArrow(run, "set binary, copies long, family binary, signature binary, size long, shingles binary")
    return out.dropDuplicates(["set"])


def overlaps(owner: np.ndarray, hashes: np.ndarray, count: int) -> np.ndarray:
    """Size of the intersection of every two sets, exactly.

    Shingles that few sets have are counted pair by pair, the others by a product of 0-1
    matrices, a few thousand shingles at a time.
    """
    order = np.argsort(hashes, kind="stable")
    owner, hashes = owner[order], hashes[order]
    first = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]]))
    sizes = np.diff(np.append(first, len(hashes)))
    column = np.repeat(np.arange(len(first)), sizes)
    out = np.zeros((count, count), dtype=np.float32)
    few = (sizes > 1) & (sizes <= 24)
    part = few[column]
    own, col = owner[part], column[part]
    pairs = np.zeros(count * count, dtype=np.int64)
    for step in range(1, 24):
        same = np.flatnonzero(col[step:] == col[:-step])
        if not len(same):
            break
        pairs += np.bincount(own[same].astype(np.int64) * count + own[same + step], minlength=count * count)
    few_counts = pairs.reshape(count, count)
    out += few_counts + few_counts.T
    many = np.flatnonzero(sizes > 24)
    for begin in range(0, len(many), 2048):
        chosen = many[begin : begin + 2048]
        at = np.full(len(first), -1, dtype=np.int64)
        at[chosen] = np.arange(len(chosen))
        part = at[column] >= 0
        matrix = np.zeros((count, len(chosen)), dtype=np.float32)
        matrix[owner[part], at[column[part]]] = 1
        out += matrix @ matrix.T
    return out


def _linked(signature: np.ndarray, block: np.ndarray, across: bool, sizes: np.ndarray, owner: np.ndarray, hashes: np.ndarray, settings: JoinSettings) -> np.ndarray:
    """Which two sets of a group are linked; `across`: only pairs of different blocks."""
    count = len(block)
    alive = np.zeros((count, count), dtype=bool)
    for begin in range(0, count, 64):
        rows = np.arange(begin, min(begin + 64, count))
        open_ = (block[rows, None] != block[None, :]) if across else np.ones((len(rows), count), dtype=bool)
        equal = np.zeros((len(rows), count), dtype=np.int16)
        for k, least in enumerate(least_matches(settings)):
            part = slice(k * settings.step, (k + 1) * settings.step)
            equal += (signature[rows, None, part] == signature[None, :, part]).sum(axis=2, dtype=np.int16)
            open_ &= equal >= least
            if not open_.any():
                break
        alive[rows] = open_
    np.fill_diagonal(alive, False)
    if not alive.any():
        return alive
    common = overlaps(owner, hashes, count).astype(np.int64)
    top, bottom = settings.threshold.numerator, settings.threshold.denominator
    return alive & (common * (top + bottom) >= top * (sizes[:, None] + sizes[None, :]))


def _roots(linked: np.ndarray) -> np.ndarray:
    """Least member that each member of a group hangs together with."""
    labels = np.arange(len(linked))
    while True:
        least = np.where(linked, labels[None, :], len(linked)).min(axis=1)
        new = np.minimum(labels, least)
        new = new[new]
        if (new == labels).all():
            return labels
        labels = new


def _verified(sets: DataFrame, settings: JoinSettings) -> DataFrame:
    """set, n_links (documents linked in one group of blocks) and root (a set)."""
    total = sets.groupBy("family").agg(F.count(F.lit(1)).alias("members"), F.sum("size").alias("shingle_sum"))
    fine = F.least(F.col("members") / settings.fine_block, F.lit(float(settings.spread)))
    blocks = F.ceil(F.greatest(fine, F.col("members") / settings.block, F.col("shingle_sum") / settings.block_shingles)).cast("int")
    total = written(total.where(F.col("members") > 1).select("family", blocks.alias("blocks")))
    placed = sets.join(total, "family").withColumn("block", F.pmod(F.xxhash64("set"), F.col("blocks")).cast("int"))
    cells = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = cells.select(
        "family", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "set", "copies", "signature", "size", "shingles", "block"
    )

    def run(group):
        group = group.combine_chunks().sort_by("set")
        raw = group["shingles"].to_pylist()
        hashes = np.frombuffer(b"".join(raw), dtype=np.uint64)
        sizes = group["size"].to_numpy()
        owner = np.repeat(np.arange(len(raw), dtype=np.int64), sizes)
        signature = np.frombuffer(b"".join(group["signature"].to_pylist()), dtype=np.uint8).reshape(len(raw), -1)
        across = group["i"][0].as_py() != group["j"][0].as_py()
        linked = _linked(signature, group["block"].to_numpy(), across, sizes, owner, hashes, settings)
        has = np.flatnonzero(linked.any(axis=1))
        number = linked @ group["copies"].to_numpy()
        roots = _roots(linked)
        names = group["set"]
        return pa.table({"set": names.take(pa.array(has)), "n_links": pa.array(number[has]), "root": names.take(pa.array(roots[has]))})

    # A cell of one block against another leaves the pairs within a block to its own cell.
    return cells.groupBy("family", "i", "j").applyInArrow(run, "set binary, n_links long, root binary")


def _joined(documents: DataFrame, key: str, text: str, settings: JoinSettings) -> tuple[DataFrame, DataFrame]:
    """All rows (doc_id, text_key, set), and per set its root, links and copies."""
    signed = written(_signed(documents, key, text, settings))
    worded = signed.where(F.col("set").isNotNull())
    sets = worded.groupBy("set").agg(F.min(F.struct("doc_id", "text_key")).alias("place"), F.count(F.lit(1)).alias("copies"), F.first("bands").alias("bands"), F.first("signature").alias("signature"))
    sets = written(sets)
    families = written(_families(sets, settings))
    needed = sets.drop("bands").join(families, "set")
    full = written(_shingled(documents, key, text, needed, settings))
    found = written(_verified(full, settings))
    roots = components(found.select("set", "root")).select(F.col("node").alias("set"), "root")
    links = found.groupBy("set").agg(F.sum("n_links").alias("n_links"))
    known = sets.select("set", "place", "copies").join(links, "set", "left").join(roots, "set", "left")
    known = written(known.select("set", "place", "copies", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("root", "set").alias("root")))
    # The least document of a class stands for it.
    leads = written(known.groupBy("root").agg(F.min("place").alias("lead"), F.min("place.doc_id").alias("class_id")))
    known = known.join(leads, "root").select("set", "lead", "class_id", (F.col("n_links") + F.col("copies") - 1).alias("n_links"))
    return signed.select("doc_id", "text_key", "set"), written(known)


def near_duplicates(documents: DataFrame, key: str = "doc_id", text: str = "text", settings: JoinSettings | None = None) -> DataFrame:
    """One row per document: key, class_id and n_links.

    class_id is the least id of the documents it hangs together with through links, and
    n_links the number of other documents, copies included, at the threshold or above.
    """
    rows, known = _joined(documents, key, text, settings or JoinSettings())
    out = rows.join(known.select("set", "class_id", "n_links"), "set", "left")
    alone = F.col("set").isNull()
    return out.select(
        F.col("doc_id").alias(key),
        F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
    )


def distinct_documents(documents: DataFrame, key: str = "doc_id", text: str = "text", settings: JoinSettings | None = None) -> DataFrame:
    """One document of each class, the least, with all its columns.

    Texts without words stay; rows with one id and one text stay once.
    """
    rows, known = _joined(documents, key, text, settings or JoinSettings())
    leads = known.select("lead.*").unionByName(rows.where(F.col("set").isNull()).select("doc_id", "text_key")).distinct()
    digest, lead, lead_text = (private_name(documents, stem) for stem in ("text_key", "lead", "lead_text"))
    leads = written(leads.select(F.col("doc_id").alias(lead), F.col("text_key").alias(lead_text)))
    own = documents.withColumn(digest, F.md5(F.coalesce(quoted(text), F.lit("")).cast("binary")))
    kept = own.join(leads, quoted(key).eqNullSafe(quoted(lead)) & (quoted(digest) == quoted(lead_text)), "left_semi")
    return kept.dropDuplicates([key, digest]).select(*map(quoted, documents.columns))
