"""Connected components of a table of links, by large and small stars.

First each task contracts the links it reads: what hangs together there becomes a star
around its least node. Most links end so before any shuffle.

Alternately every node hands its larger neighbours, then its smaller ones, over to the
least of them, until all links of a component end in its least node. A node may have links
to a large share of all nodes: minima are aggregated on the map side and written, so the
join that hands neighbours over is between plain scans and can be split.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import ship, written

#: Links that a task contracts at once.
HELD = 1 << 19


def _stars(a: pa.ChunkedArray, b: pa.ChunkedArray) -> pa.RecordBatch:
    """Links a, b of the same components: every node with the least one it hangs together with."""
    nodes = pc.unique(pa.chunked_array([*a.chunks, *b.chunks]))
    nodes = nodes.take(pc.sort_indices(nodes))
    first, second = (pc.index_in(c, nodes).to_numpy().astype(np.int64) for c in (a, b))
    labels = np.arange(len(nodes))
    while True:
        least = np.minimum(labels[first], labels[second])
        new = labels.copy()
        np.minimum.at(new, first, least)
        np.minimum.at(new, second, least)
        new = new[new]
        if (new == labels).all():
            break
        labels = new
    own = np.flatnonzero(labels < np.arange(len(nodes)))
    return pa.RecordBatch.from_arrays([nodes.take(pa.array(own)), nodes.take(pa.array(labels[own]))], names=["a", "b"])


def _contracted(links: DataFrame) -> DataFrame:
    """a, b with a > b, of the same components as the links that each task reads."""
    ship(links.sparkSession)

    def run(batches):
        waiting, size = [], 0
        for batch in batches:
            waiting.append(batch)
            size += batch.num_rows
            if size >= HELD:
                found = _stars(*pa.Table.from_batches(waiting).columns)
                waiting, size = [found], found.num_rows
                if size >= HELD // 2:
                    yield found
                    waiting, size = [], 0
        if size:
            yield _stars(*pa.Table.from_batches(waiting).columns)

    return links.mapInArrow(run, links.schema)


def _star(links: DataFrame, large: bool) -> DataFrame:
    """links: a, b with a > b. Returns links of the same kind."""
    both = links.select("a", "b")
    if large:
        both = both.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = written(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("least")))
    moved = both.join(least, "a")
    if large:
        out = moved.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("least").alias("b"))
    else:
        out = moved.select(F.col("b").alias("a"), F.col("least").alias("b")).unionByName(least.select("a", F.col("least").alias("b")))
    return out.where(F.col("a") > F.col("b")).distinct()


def _settled(links: DataFrame) -> bool:
    """Whether every node has one link at most to a smaller one, and that one has none."""
    down = links.select(F.col("a").alias("node"), F.lit(1).alias("links"), F.lit(0).alias("linked"))
    up = links.select(F.col("b").alias("node"), F.lit(0).alias("links"), F.lit(1).alias("linked"))
    nodes = down.unionByName(up).groupBy("node").agg(F.sum("links").alias("links"), F.max("linked").alias("linked"))
    return nodes.where("links > 1 OR links + linked > 1").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """node and root (the least node of its component) of every linked node.

    `links` has two columns of one orderable type, in any direction, repeated or not.
    """
    first, second = links.columns
    own = links.select(F.greatest(first, second).alias("a"), F.least(first, second).alias("b"))
    own = written(_contracted(own.where(F.col("a") > F.col("b"))).distinct())
    while not _settled(own):
        own = written(_star(written(_star(own, large=True)), large=False))
    roots = own.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("root"))
    return own.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
