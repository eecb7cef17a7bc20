"""Packing by concatenating and cutting.

First pass: texts become token ids with an end id, written once with each document's place
among the ids of its partition. Partition totals, summed up in partition order, turn these
places into global offsets, and fixed windows over the offsets are the sequences. Second
pass: each written document is cut where a window ends, giving one boundary record per
piece. Nothing is shuffled but the partition totals, and only the last sequence is padded.

The written partition number and place decide the order, so lost executors or another
split of the files on reading change nothing.

Defined cases: a null or empty text is its end id alone; a text longer than a window takes
several sequences; repeated rows are packed once each; an empty table gives no pieces.
Columns of the input other than those named are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .columns import quoted
from .storage import ship, written
from .texts import pieces
from .tokens import encoder

LENGTH = 2048


def tokenized(documents: DataFrame, tokenizer: str, end_id: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, part, place (ids before it in its part), n_tokens and ids (little-endian)."""
    ship(documents.sparkSession)
    source = documents.select(quoted(key).alias("key"), quoted(text).alias("text"))
    schema = f"key {source.schema['key'].dataType.simpleString()}, part int, place long, n_tokens long, ids binary"

    def run(batches):
        from pyspark import TaskContext

        part, place = TaskContext.get().partitionId(), 0
        own = encoder(tokenizer)
        for batch in batches:
            for piece in pieces(batch["text"]):
                ids, sizes = own.encode(piece, end_id)
                ends = np.cumsum(sizes)
                offsets = pa.py_buffer(np.concatenate([[0], 4 * ends]).astype(np.int32))
                packed = pa.Array.from_buffers(pa.binary(), piece.rows, [None, offsets, pa.py_buffer(ids)])
                parts = pa.array(np.full(piece.rows, part, dtype=np.int32))
                keys = batch["key"].slice(piece.row, piece.rows)
                yield pa.RecordBatch.from_arrays(
                    [keys, parts, pa.array(place + ends - sizes), pa.array(sizes), packed],
                    names=["key", "part", "place", "n_tokens", "ids"],
                )
                place += int(ends[-1])

    return source.mapInArrow(run, schema)


def global_offsets(tokens: DataFrame) -> DataFrame:
    """part and the ids in all parts before it; one row per task of the first pass."""
    totals = tokens.groupBy("part").agg(F.max(F.col("place") + F.col("n_tokens")).alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))


def cut(tokens: DataFrame, length: int, with_ids: bool = False) -> DataFrame:
    """Pieces of written documents: where they begin in document and sequence, and a crc32."""
    # One row per task of the first pass: bounded by the task count, not by the data.
    placed = tokens.join(F.broadcast(global_offsets(tokens)), "part")
    placed = placed.withColumn("begin", F.col("base") + F.col("place"))
    first = F.floor(F.col("begin") / length).cast("long")
    last = F.floor((F.col("begin") + F.col("n_tokens") - 1) / length).cast("long")

    def piece(k):
        begin = F.greatest(F.col("begin"), k * length)
        end = F.least(F.col("begin") + F.col("n_tokens"), (k + 1) * length)
        start = begin - F.col("begin")
        ids = F.substring("ids", (start * 4 + 1).cast("int"), ((end - begin) * 4).cast("int"))
        fields = [start.alias("start"), (end - begin).alias("length"), F.crc32(ids).alias("ids_crc32"), k.alias("sequence_id"), (begin - k * length).alias("offset")]
        return F.struct(*fields, *([ids.alias("ids")] if with_ids else []))

    pieces = placed.select("key", F.col("n_tokens").alias("doc_tokens"), F.explode(F.transform(F.sequence(first, last), piece)).alias("p"))
    return pieces.select("key", "p.start", "p.length", "p.ids_crc32", "doc_tokens", "p.sequence_id", "p.offset", *(["p.ids"] if with_ids else []))


def pack(documents: DataFrame, tokenizer: str, end_id: int = 1, length: int = LENGTH, key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece; with_ids adds the ids themselves."""
    tokens = written(tokenized(documents, tokenizer, end_id, key, text))
    return cut(tokens, length, with_ids).withColumnRenamed("key", key)


def sequences(pieces: DataFrame) -> DataFrame:
    """sequence_id and its ids, from pieces with ids. A sequence holds `length` ids at most."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(parts, F.lit(b""), lambda a, p: F.concat(a, p["ids"]))
    return pieces.groupBy("sequence_id").agg(joined.alias("ids"))
