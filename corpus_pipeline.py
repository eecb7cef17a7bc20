"""From raw documents to packed token sequences, stage by stage.

Each stage takes what its predecessor kept, written as Parquet and read again, so lost
executors cost a part of one stage at most.

Defined cases are those of the operators: a null, empty or very long text is judged whole as
any other; null ids and repeated rows go through the stages row by row until the join, where
one row of equal ids and texts stays, and of equal texts the one with the least id; without
labels every document passes the classifier; empty tables give no pieces. All columns of the
documents, whatever their names, stay with them until packing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from salesmart.llm import decontamination, ngram_join, packing, quality_classifier, quality_rules
from salesmart.llm.columns import private_name, quoted
from salesmart.llm.labelled import label_sample
from salesmart.llm.queries import table, tokenizer_path
from salesmart.llm.storage import shared_folder


def classify_quality(spark: SparkSession, documents: DataFrame, directory: str) -> DataFrame:
    """Documents that score below one half for quality go."""
    settings = quality_classifier.KnnSettings()
    sample = label_sample(table(spark, directory, "labels"), "doc_id", "quality", settings.max_labelled)
    fitted = quality_classifier.fit(documents, sample, settings=settings)
    scored = quality_classifier.score(documents, fitted, documents.columns, settings=settings, score_column=(score := private_name(documents, "score")))
    return scored.where(quoted(score) >= 0.5).select(*map(quoted, documents.columns))


def apply_rules(spark: SparkSession, documents: DataFrame, directory: str) -> DataFrame:
    """Documents that break a rule or diverge from every language reference go."""
    return quality_rules.kept_documents(documents)


def join_ngrams(spark: SparkSession, documents: DataFrame, directory: str) -> DataFrame:
    """One document of each class of near duplicates stays."""
    return ngram_join.distinct_documents(documents)


def decontaminate(spark: SparkSession, documents: DataFrame, directory: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontamination.clean_documents(documents, table(spark, directory, "benchmark"))


def pack(spark: SparkSession, documents: DataFrame, directory: str) -> DataFrame:
    """The pieces of packed sequences."""
    return packing.pack(documents, tokenizer_path())


STAGES = [
    ("quality classifier", classify_quality),
    ("quality rules", apply_rules),
    ("n-gram Jaccard join", join_ngrams),
    ("benchmark decontamination", decontaminate),
    ("packing", pack),
]

#: Votes of nearest neighbours and token ids can't be said in SQL; tests hold the stages
#: against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, directory: str) -> DataFrame:
    """All stages over the documents of a directory."""
    documents = table(spark, directory, "documents")
    for _, stage in STAGES:
        folder = shared_folder(spark)
        stage(spark, documents, directory).write.parquet(folder)
        documents = spark.read.parquet(folder)
    return documents
