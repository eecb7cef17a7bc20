"""Exact identity of a set of ids, and the ids in which two sets differ.

Ids are cut into ranges of 2**12; a range's digest is over its sorted ids, and 256 neighbours
make a digest one level up, until all 64 bits are used up. Two sets have the same root if and
only if they are the same (but for collisions of sha256), and a difference is looked for in the
ranges whose digests differ. A group has 4096 ids or 256 digests at most, so no task holds a
set, and the number of levels is fixed, so the tree is one plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RANGE_BITS, FAN_BITS, ID_BITS = 12, 8, 64


def range_digests(df: DataFrame, key: str) -> DataFrame:
    """place of every range that has ids, its digest, and how many; repeated and null ids do not count."""
    ids = df.select(F.col(key).cast("long").alias("id")).where("id IS NOT NULL").distinct()
    held = ids.groupBy(F.shiftright("id", RANGE_BITS).alias("place")).agg(F.array_sort(F.collect_list("id")).alias("ids"))
    digest = F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256)
    return held.select("place", digest.alias("digest"), F.size("ids").cast("long").alias("num_ids"))


def tree_digest(df: DataFrame, key: str) -> DataFrame:
    """One row: num_ids and the root; of no ids, the digest of nothing."""
    nodes = range_digests(df, key)
    for _ in range((ID_BITS - RANGE_BITS + FAN_BITS - 1) // FAN_BITS):
        nodes = nodes.groupBy(F.shiftright("place", FAN_BITS).alias("place")).agg(_joined(), F.sum("num_ids").alias("num_ids"))
    # What is left is one node for ids from 0 on and one for those below.
    return nodes.agg(F.coalesce(F.sum("num_ids"), F.lit(0)).alias("num_ids"), _joined().alias("digest"))


def plain_digest(df: DataFrame, key: str) -> DataFrame:
    """One row: md5 over all ids, sorted as text. For sets that fit into one task only."""
    ids = df.select(F.col(key).cast("string").alias("id")).where("id IS NOT NULL")
    return ids.agg(F.md5(F.array_join(F.array_sort(F.collect_set("id")), ",")).alias("digest"))


def differing_ids(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """id and in_left of every id that only one of the sets has."""
    a, b = range_digests(left, key).select("place", F.col("digest").alias("a")), range_digests(right, key).select("place", F.col("digest").alias("b"))
    places = a.join(b, "place", "full").where(~F.col("a").eqNullSafe(F.col("b"))).select("place")

    def within(df: DataFrame, side: bool) -> DataFrame:
        ids = df.select(F.col(key).cast("long").alias("id")).where("id IS NOT NULL").withColumn("place", F.shiftright("id", RANGE_BITS))
        return ids.join(places, "place", "left_semi").select("id", F.lit(side).alias("side")).distinct()

    sides = within(left, True).unionByName(within(right, False)).groupBy("id").agg(F.count(F.lit(1)).alias("sides"), F.first("side").alias("in_left"))
    return sides.where("sides = 1").select("id", "in_left")


def _joined() -> Column:
    parts = F.array_sort(F.collect_list(F.struct("place", "digest")))
    return F.sha2(F.array_join(F.transform(parts, lambda p: F.concat(p["place"].cast("string"), F.lit(":"), p["digest"])), ","), 256).alias("digest")
