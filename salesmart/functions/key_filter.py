"""A Bloom filter over keys, as an expression that scans can apply.

A join on a key that few rows of the larger side have still shuffles all of that side,
unless what has no chance is left out where it is read. Keys of the smaller side set bits of
words; the words come together as one array, a scalar of the plan. Its size follows that of
the table the keys come from, as its files tell without a job, up to a fixed bound. Rows of the larger side whose bits are not all set
have no partner. Others mostly have one, so a join must follow.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits set per key, all in one word: one place of the array is looked at per row.
BITS_SET = 3
WORD_BITS, BITS_PER_KEY = 64, 10
#: Eight megabytes at most, enough for six million keys. With more, more rows pass by chance,
#: which costs a shuffle of these.
MOST_WORDS = 1 << 20
#: Where the plan can't tell a size, as for rows given by hand.
UNTOLD_WORDS = 1 << 12


def told_bytes(table: DataFrame) -> int | None:
    """Bytes of a table's files as its plan tells them, without a job."""
    size = int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return None if size >= 1 << 60 else size


def words_for(table: DataFrame) -> int:
    """Words for the keys of a table, one a row, from the size its plan tells."""
    size = told_bytes(table)
    if size is None:
        return UNTOLD_WORDS
    row = table._jdf.schema().defaultSize()
    return min(MOST_WORDS, 1 << max(4, (size // row * BITS_PER_KEY // WORD_BITS).bit_length()))


@dataclass(frozen=True)
class KeyFilter:
    """`words`: a scalar of the plan, an array of longs."""

    words: Column
    number: int

    def may_hold(self, key: str) -> Column:
        """False only for values that are no key."""
        hashed = F.xxhash64(key)
        bits = _bits(hashed)
        return F.get(self.words, _word(hashed, self.number)).bitwiseAND(bits) == bits


def key_filter(keys: DataFrame, key: str, number: int = UNTOLD_WORDS) -> KeyFilter:
    """The filter over a column; `number` of words is a power of two."""
    if number & (number - 1):
        raise ValueError("the number of words must be a power of two")
    held = keys.select(_word(F.xxhash64(key), number).alias("word"), _bits(F.xxhash64(key)).alias("bits"))
    # A word of each number, so that places in the array are numbers.
    blank = keys.sparkSession.range(number).select(F.col("id").cast("int").alias("word"), F.lit(0).cast("long").alias("bits"))
    words = held.unionByName(blank).groupBy("word").agg(F.bit_or("bits").alias("bits"))
    ordered = F.array_sort(F.collect_list(F.struct("word", "bits")))
    return KeyFilter(words.agg(F.transform(ordered, lambda w: w["bits"]).alias("words")).scalar(), number)


def _word(hashed: Column, number: int) -> Column:
    return hashed.bitwiseAND(F.lit(number - 1).cast("long")).cast("int")


def _bits(hashed: Column) -> Column:
    one, out = F.lit(1).cast("long"), F.lit(0).cast("long")
    for k in range(BITS_SET):  # six bits of the hash tell one of 64
        place = F.shiftrightunsigned(hashed, 58 - 6 * k).bitwiseAND(F.lit(63).cast("long")).cast("int")
        out = out.bitwiseOR(F.call_function("shiftleft", one, place))
    return out
