"""Exact deduplication by skew-safe combining.

Three combining steps, every one of them keyed by the digest *and* the full normalised text:

1. local: Spark's partial aggregation folds copies inside each input partition;
2. salted: the copies of one text meet in ``salts`` separate groups, so a text that is a third of the corpus is
   spread over that many reducers;
3. global: the at most ``salts`` winners of each text are combined.

Each salt winner then carries the verdict back to its own documents by (digest, salt), which no key dominates either.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ffspark.llm.shared import fold_ascii, fresh, materialise

SALTS = 64


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal if identical after lower-casing A-Z; null counts as the empty text, so null and empty texts form
    one group. The row with the largest id stays. Ids are expected to be unique; where an id is repeated with the
    same text, its rows are counted in ``group_size`` and exactly one of them can be kept. A null id loses against
    any other and stays only in a group of null ids; rows without id are salted by their other columns. Very long texts are
    compared whole; ties can't arise between unique ids. An empty table gives an empty
    result. Other columns are ignored, whatever their names.
    """
    rest = [docs[f"`{c}`"] for c in docs.columns if c != text_col] if len(set(docs.columns)) == len(docs.columns) else [F.col(id_col)]
    deal = F.when(F.col(id_col).isNull(), F.xxhash64(*rest)).otherwise(F.xxhash64(id_col))
    rows = docs.select(F.col(id_col).alias("doc_id"), fold_ascii(F.coalesce(F.col(text_col), F.lit(""))).alias("norm"), deal.alias("deal")).select(
        "doc_id", "norm", F.sha2("norm", 256).alias("sha"), F.pmod("deal", F.lit(salts)).cast("int").alias("salt")
    )
    salted = rows.groupBy("sha", "norm", "salt").agg(F.max("doc_id").alias("top"), F.count(F.lit(1)).alias("n"))
    text, digest = Window.partitionBy("sha", "norm"), Window.partitionBy("sha")
    combined = salted.repartition("sha").select(
        "sha", "norm", "salt", "top", F.max("top").over(text).alias("keep_id"), F.sum("n").over(text).alias("group_size")
    )
    held = F.when(F.col("top").eqNullSafe(F.col("keep_id")), F.col("salt"))
    combined = combined.withColumn("held", F.min(held).over(text)).drop("top")  # the salt that the kept row comes from
    clash = F.min("norm").over(digest) != F.max("norm").over(digest)
    winners = materialise(combined.withColumn("clash", clash).withColumn("norm", F.when(F.col("clash"), F.col("norm"))), "winners")
    joined = rows.drop("norm").join(winners.where(~F.col("clash")).drop("norm", "clash"), ["sha", "salt"])
    clashing = winners.where("clash").drop("clash")
    if not clashing.isEmpty():  # different texts with one SHA-256 digest; none is known
        joined = joined.unionByName(rows.join(clashing, ["sha", "norm", "salt"]).drop("norm"))
    once = Window.partitionBy("sha", "salt", "doc_id").orderBy("keep_id")
    return joined.withColumn("nth", F.row_number().over(once)).select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("salt") == F.col("held")) & (F.col("nth") == 1)).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """The rows of ``docs`` that stay, all columns unchanged; of rows with one id and text, one stays. Of rows that
    repeat an id with other texts, those whose text is kept under that id stay."""
    return keep_rows(docs, exact_groups(docs, id_col, text_col, salts).where("kept").select("doc_id", "text_sha256"), F.col(id_col), F.col(text_col))


def keep_rows(docs: DataFrame, kept: DataFrame, doc_id: Column, text: Column) -> DataFrame:
    """Rows of ``docs`` whose id and text ``kept`` names, each pair once. Both steps use one partitioning, so the texts
    are shuffled once."""
    key, sha = fresh(docs, "key", "sha")
    name = lambda c: F.coalesce(F.concat(F.lit("i"), c.cast("string")), F.lit("n"))
    right = kept.select(name(F.col("doc_id")).alias(key), F.col("text_sha256").alias(sha))
    tagged = docs.withColumn(key, name(doc_id)).withColumn(sha, F.sha2(fold_ascii(F.coalesce(text, F.lit(""))), 256))
    return tagged.join(right, [key, sha], "left_semi").dropDuplicates([key, sha]).select(*[F.col(f"`{c}`") for c in docs.columns])


ORACLE_SQL = """
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm
           FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept,
       sha256(norm) AS text_sha256
FROM t WINDOW g AS (PARTITION BY norm)
"""
