"""Merkle manifest of a dataset, kept as postorder append logs.

Leaves stand in order within their group, and every two neighbours become a node, a last one
alone too, until one is left: the subroot of the group. Subroots, in the order of their
groups, are the leaves of one more tree, whose top is the root.

Builders are aligned: each takes 2**block_bits consecutive nodes, from a multiple of that
number on, and appends every node to its log when it is complete: leaves as they come,
parents right behind their last child, nodes without all children at the end. The tops of
the blocks are the leaves of the next tier, so a tree over any number of leaves is a few
rounds of groups of bounded size. Nothing in a log says where a node is. Subtrees of 2**l
leaves have 2**(l+1) - 1 nodes, so a node of level l whose last leaf is number j (from 0)
stands at 2j - popcount(j) + l, and open ones follow all of these from the lowest up.
Proofs read siblings at these places.

Places of leaves come from a sort by range, counts per sorted part, and their prefix sums:
no group meets in one task, however large it is. Texts are hashed where they are read;
what moves is digests.

Defined cases: nulls in a column have their own encoding, and the null group comes first;
long texts are hashed by Spark, one at a time; of leaves with one key the one of the smaller
digest comes first, and repeated rows are a leaf each; null keys come first; a lone leaf is
its own subroot, a lone subroot is the root; an empty table has no leaves and no root (None).
Columns of the input other than those named are not looked at.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .columns import quoted
from .storage import ship, written

SIZE = 32
BLOCK_BITS = 12


def leaf_digest(columns: list[Column]) -> Column:
    """Lowercase hex sha256 of the values: `-` for null, else bytes of UTF-8, `:`, value."""
    parts = []
    for column in columns:
        text = column.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def node(*children: bytes) -> bytes:
    """Digest over the hex text of its children."""
    return hashlib.sha256("".join(c.hex() for c in children).encode()).digest()


def tree_height(leaves: int) -> int:
    return (leaves - 1).bit_length()


def append_log(leaves: list[bytes], height: int) -> list[bytes]:
    """All nodes up to `height` in the order in which they are complete."""
    log: list[bytes] = []
    waiting: dict[int, bytes] = {}  # by level: the left child that waits for its sibling
    for number, leaf in enumerate(leaves):
        log.append(leaf)
        current, level = leaf, 0
        while level < height and number >> level & 1:
            current, level = node(waiting[level], current), level + 1
            log.append(current)
        waiting[level] = current
    count = len(leaves)
    level = _trailing_zeros(count)
    current = waiting[level] if level < height else b""
    while level < height:
        odd = (count - 1) >> level & 1
        current, level = node(waiting[level], current) if odd else node(current), level + 1
        log.append(current)
    return log


def _trailing_zeros(count: int) -> int:
    return (count & -count).bit_length() - 1


def place_in_log(level: int, index: np.ndarray, leaves: int) -> np.ndarray:
    """Where in the log of so many leaves the nodes of a level stand."""
    last = ((index + 1) << level) - 1
    whole = 2 * last - np.bitwise_count(last).astype(np.int64) + level
    # An open node is the last of its level, and so are all above it.
    open_ = 2 * leaves - leaves.bit_count() + level - _trailing_zeros(leaves) - 1
    return np.where(last < leaves, whole, open_)


def sibling_paths(log: np.ndarray, leaves: int, height: int) -> tuple[np.ndarray, np.ndarray]:
    """Siblings of every leaf by level (leaves x height x SIZE), and which of them exist."""
    own = np.zeros((leaves, height, SIZE), dtype=np.uint8)
    there = np.zeros((leaves, height), dtype=bool)
    for level in range(height):
        sibling = (np.arange(leaves, dtype=np.int64) >> level) ^ 1
        exists = sibling < -(-leaves >> level)
        own[exists, level] = log[place_in_log(level, sibling[exists], leaves)]
        there[:, level] = exists
    return own, there


def fold(leaf: bytes, trees: list[tuple[int, int]], path: bytes) -> bytes:
    """What a leaf and the siblings on its way up come to. `trees`: its place in each tree,
    from the lowest, and the number of leaves of that tree."""
    current, at = leaf, 0
    for index, count in trees:
        while count > 1:
            if index & 1:
                current, at = node(path[at : at + SIZE], current), at + SIZE
            elif index + 1 < count:
                current, at = node(current, path[at : at + SIZE]), at + SIZE
            else:
                current = node(current)
            index, count = index >> 1, (count + 1) >> 1
    return current


def placed(rows: DataFrame) -> DataFrame:
    """Rows (grp, key, digest and others) with pos, the place in the group, and size, its rows."""
    # The number of the row splits equal rows over the ranges.
    tied = rows.withColumn("tie", F.monotonically_increasing_id())
    order = [F.asc_nulls_first(c) for c in ("grp", "key", "digest", "tie")]
    ranged = tied.repartitionByRange(*order).sortWithinPartitions(*order).drop("tie")
    ranged = written(ranged.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("row")))
    spans = ranged.groupBy("grp", "part").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("rows"))
    whole = Window.partitionBy("grp")  # one row per part that has rows of the group
    before = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select("grp", "part", (F.coalesce(F.sum("rows").over(before), F.lit(0)) - F.col("first")).alias("shift"), F.sum("rows").over(whole).alias("size"))
    return ranged.join(spans, ["grp", "part"]).withColumn("pos", F.col("row") + F.col("shift")).drop("part", "row", "shift")


@dataclass(frozen=True)
class Tier:
    """`nodes`: grp, pos, size, digest and others; `logs`: grp, block, count, size and log."""

    nodes: DataFrame
    logs: DataFrame


def _tier(nodes: DataFrame, bits: int) -> DataFrame:
    """The logs of all blocks: one group per block, of 2**bits nodes at most."""

    def build(group):
        group = group.sort_by("pos")
        pos, size = group["pos"][0].as_py(), group["size"][0].as_py()
        leaves = group["digest"].to_pylist()
        height = bits if size > 1 << bits else tree_height(len(leaves))
        log = b"".join(append_log(leaves, height))
        return pa.table(
            {
                "grp": group["grp"].slice(0, 1),
                "block": pa.array([pos >> bits], pa.int64()),
                "count": pa.array([len(leaves)], pa.int32()),
                "height": pa.array([height], pa.int32()),
                "size": pa.array([size], pa.int64()),
                "log": pa.array([log], pa.binary()),
            }
        )

    cut = nodes.select("grp", "pos", "size", "digest", F.shiftright("pos", bits).alias("block"))
    return cut.groupBy("grp", "block").applyInArrow(build, "grp binary, block long, count int, height int, size long, log binary")


def _grown(nodes: DataFrame, bits: int) -> tuple[list[Tier], DataFrame]:
    """The tiers over placed nodes, and the top of every group: grp, digest."""
    tiers, tops = [], None
    top = F.substring("log", F.length("log") - SIZE + 1, SIZE).alias("digest")
    while True:
        logs = written(_tier(nodes, bits))
        tiers.append(Tier(nodes, logs))
        done = logs.where(F.col("size") <= 1 << bits).select("grp", top)
        tops = done if tops is None else tops.unionByName(done)
        open_ = logs.where(F.col("size") > 1 << bits)
        if open_.isEmpty():
            return tiers, tops
        blocks = F.floor((F.col("size") + (1 << bits) - 1) / (1 << bits)).cast("long")
        nodes = open_.select("grp", F.col("block").alias("pos"), blocks.alias("size"), top)


def _paths(tiers: list[Tier], above: DataFrame, keep: list[str], bits: int) -> DataFrame:
    """The nodes of the lowest tier with their siblings up to the top, and what `above` has.

    `above`: grp, path (the siblings above the top of the group) and others.
    """
    more = [f for f in above.schema.fields if f.name not in ("grp", "path")]

    def joined(names):
        def run(left, right):
            # Names are told by place: cogroups keep the order of columns.
            left = left.sort_by("pos")
            log = np.frombuffer(right["log"][0].as_py(), dtype=np.uint8).reshape(-1, SIZE)
            own, there = sibling_paths(log, right["count"][0].as_py(), right["height"][0].as_py())
            rest = np.frombuffer(right["path"][0].as_py(), dtype=np.uint8).reshape(-1, SIZE)
            full = np.concatenate([own, np.broadcast_to(rest, (len(own), *rest.shape))], axis=1)
            there = np.concatenate([there, np.ones((len(own), len(rest)), dtype=bool)], axis=1)
            offsets = np.concatenate([[0], np.cumsum(SIZE * there.sum(axis=1))]).astype(np.int32)
            path = pa.Array.from_buffers(pa.binary(), len(own), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(full[there]))])
            out = {name: left[name] for name in ("grp", "pos", "size", *names)} | {"path": path}
            first = pa.array(np.zeros(len(own), dtype=np.int64))
            return pa.table(out | {f.name: right[f.name].take(first) for f in more})

        return run

    upper = None
    for number in reversed(range(len(tiers))):
        tier, names = tiers[number], keep if number == 0 else []
        topped = tier.logs.where(F.col("size") <= 1 << bits).join(above, "grp")
        if upper is not None:
            below = tier.logs.where(F.col("size") > 1 << bits).join(upper, ["grp", "block"])
            topped = topped.unionByName(below)
        nodes = tier.nodes.select("grp", "pos", "size", *names, F.shiftright("pos", bits).alias("block"))
        fields = [*nodes.drop("block").schema.fields, T.StructField("path", T.BinaryType()), *more]
        met = nodes.groupBy("grp", "block").cogroup(topped.groupBy("grp", "block")).applyInArrow(joined(names), T.StructType(fields))
        if number == 0:
            return met
        upper = written(met.select("grp", F.col("pos").alias("block"), "path", *[f.name for f in more]))


@dataclass(frozen=True)
class Manifest:
    """`tiers` of the groups, `crown` those of the tree over subroots; `subroots` by grp and
    pos; `root` as hex, None without leaves. `keep` are columns that leaves brought along."""

    tiers: list[Tier]
    crown: list[Tier]
    subroots: DataFrame
    root: str | None
    keep: list[str]
    bits: int

    def proofs(self) -> DataFrame:
        """Per leaf: the kept columns, digest, subroot, path (binary), and pos and size in its
        group and, as crown_pos and crown_size, of the group among the groups."""
        start = self.subroots.sparkSession.range(1).select(F.lit(b"").alias("grp"), F.lit(b"").alias("path"))
        crowns = _paths(self.crown, start, ["key", "digest"], self.bits)
        above = written(crowns.select(F.col("key").alias("grp"), "path", F.col("digest").alias("subroot"), F.col("pos").alias("crown_pos"), F.col("size").alias("crown_size")))
        names = ["digest", *[f"k{i}" for i in range(len(self.keep))]]
        own = _paths(self.tiers, above, names, self.bits)
        renamed = [F.col(f"k{i}").alias(c) for i, c in enumerate(self.keep)]
        return own.select(*renamed, "digest", "subroot", "path", "pos", "size", "crown_pos", "crown_size")


def build(rows: DataFrame, group: str, key: str, digest: str, keep: list[str], bits: int = BLOCK_BITS) -> Manifest:
    """The manifest over rows that are leaves: `group` is text, `digest` is hex."""
    ship(rows.sparkSession)
    # Null first, then bytes of UTF-8.
    grp = F.coalesce(F.concat(F.lit(b"\x01"), quoted(group).cast("string").cast("binary")), F.lit(b"\x00"))
    own = [quoted(c).alias(f"k{i}") for i, c in enumerate(keep)]
    leaves = written(rows.select(grp.alias("grp"), quoted(key).alias("key"), F.unhex(quoted(digest)).alias("digest"), *own))
    nodes = written(placed(leaves).drop("key"))
    tiers, tops = _grown(nodes, bits)
    subroots = written(placed(tops.select(F.lit(b"").alias("grp"), F.col("grp").alias("key"), "digest")))
    crown, root = _grown(subroots, bits)
    found = root.first()
    return Manifest(tiers, crown, subroots, found and bytes(found["digest"]).hex(), list(keep), bits)


def folded(proofs: DataFrame, claim: Column) -> DataFrame:
    """Proofs with folded_root (hex): what the claimed digests (hex) come to."""
    ship(proofs.sparkSession)
    names = ["path", "pos", "size", "crown_pos", "crown_size"]
    schema = T.StructType([*proofs.schema.fields, T.StructField("folded_root", T.StringType())])

    def run(batches):
        for batch in batches:
            columns = [batch[c].to_pylist() for c in ("claimed", *names)]
            out = [fold(leaf, [(pos, size), (upper, groups)], path).hex() for leaf, path, pos, size, upper, groups in zip(*columns)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out, pa.string())], names=schema.names)

    return proofs.withColumn("claimed", F.unhex(claim)).mapInArrow(run, schema)
