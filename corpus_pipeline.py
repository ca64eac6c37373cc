"""A corpus pipeline of five of the llm operators, from raw documents to packed sequences.

Each stage takes documents with at least doc_id, text, lang and source, and all but the last give back rows of them with
all their columns, extra ones included, whatever their names. Nulls in any column, empty and very long texts, repeated
rows and empty tables are allowed; the stages say what becomes of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ffspark.llm import exact_dedup, mixing, ngram_join, packing, quality_knn
from ffspark.llm.queries import table, tokenizer_path
from ffspark.llm.shared import scratch_path
from ffspark.sources.storage import remove


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts. It learns from the labelled documents of the whole table. Null and
    empty texts get the sample's share of good labels as score; very long ones are scored whole; without labels all
    documents stay."""
    model = quality_knn.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return quality_knn.accepted(docs, model)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts (A-Z lower-cased), the one with the largest id. Null and empty texts are
    one group; very long texts are compared whole; a null id stays only where all ids of its group are null; of repeated
    rows one stays."""
    return exact_dedup.drop_exact_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, Jaccard 0.8 or more), the smallest id. Texts
    without words stay; very long ones are shingled whole; a null id stays only where all ids of its group are null; of
    repeated rows one stays."""
    return ngram_join.drop_near_copies(docs, words=5, num=80, den=100)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn by probabilities calibrated to the target marginals. Null sources and languages are values of their
    own; texts without words stay; very long ones are counted whole; rows that repeat an id share one draw."""
    return mixing.sample(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents, packed into sequences of at most 2048 tokens. Null and empty texts are one end id;
    very long ones are cut into pieces; repeated rows and null ids are packed like others."""
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [("quality classifier", quality), ("exact dedup", exact), ("n-gram Jaccard join", near), ("mixing", mixed), ("packing", packed)]
#: Neither the classifier nor the tokenizer can be expressed in SQL; tests compare every stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's result is written as Parquet and read again by the next, after which it
    goes. The last stage's result still reads what the one before it wrote, so that stays."""
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = scratch_path(spark, f"stage{k}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
            if before:
                remove(spark, before)
            before = path
    return docs
