"""A bounded sample of labelled rows, the only part of the input a classifier is fitted on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import quoted
from .storage import written


def label_sample(labels: DataFrame, key: str, label: str, bound: int, usable: Column | None = None) -> DataFrame:
    """About `bound` labelled ids at most, as key and label: all of them if there are fewer.

    Ids are picked by hash, so the choice depends on nothing but the ids. Rows of one id
    count once, with the larger label; null ids and labels are left out.
    """
    rows = labels.where(quoted(key).isNotNull() & quoted(label).isNotNull())
    if usable is not None:
        rows = rows.where(usable)
    rows = rows.groupBy(quoted(key).alias("key")).agg(F.max(quoted(label)).alias("label"))
    found = rows.count()
    if found <= bound:
        return rows
    # Four standard deviations below the bound, so that it holds.
    share = max(0.0, bound - 4 * bound**0.5) / found
    return rows.where(F.abs(F.xxhash64("key", F.lit("sample"))) < int(share * (1 << 63)))


def labelled_texts(documents: DataFrame, sample: DataFrame, key: str, text: str) -> DataFrame:
    """key, label and text of each sampled id: of rows with one id the least text, if any has one.

    `sample` is bounded: broadcast.
    """
    own = documents.select(quoted(key).alias("key"), quoted(text).alias("text"))
    return own.join(F.broadcast(sample), "key").groupBy("key", "label").agg(F.min("text").alias("text"))


def labelled_texts_in_place(documents: DataFrame, sample: DataFrame, key: str, text: str) -> DataFrame:
    """The rows of `labelled_texts`, where they are read: only texts of repeated ids are shuffled.

    Aggregating all texts would sort them, in as many tasks, and files, as a shuffle has.
    """
    own = documents.select(quoted(key).alias("key"), quoted(text).alias("text")).join(F.broadcast(sample), "key")
    counted = own.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    repeated = written(counted.where(F.col("n") > 1).select("key").coalesce(1))
    if repeated.isEmpty():
        return own.select("key", "label", "text")
    least = labelled_texts(documents, sample.join(F.broadcast(repeated), "key", "left_semi"), key, text)
    return own.join(F.broadcast(repeated), "key", "left_anti").select("key", "label", "text").unionByName(least)
