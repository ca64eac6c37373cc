"""Small helpers of the llm operators: shared storage, word patterns, text folding."""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ffspark.sources.storage import scratch_path

#: A word is a run of characters other than these six (space, tab, \n, \v, \f, \r).
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD_CLASS = r"[^\x20\x09-\x0D]"

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: lineage ends there, on storage that
    outlives any executor."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete the files of tables that ``materialise`` wrote and that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        for folder in {file.rpartition("/")[0] for file in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextlib.contextmanager
def arrow_batches(spark: SparkSession, size: str) -> Iterator[None]:
    """Jobs that run inside hand rows to Python in Arrow batches of about ``size``; whole texts fill large ones."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, size)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for helper columns, none of which ``df`` has."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


#: Parts that the rows of one key are dealt to.
PARTS = 64


def lookup(rows: DataFrame, key: str, table: DataFrame, how: str = "inner", parts: int = PARTS) -> DataFrame:
    """``rows`` joined with ``table``, which has one row for each ``key``; ``how`` is inner or left.

    A key may be that of a third of all rows, so they are dealt to ``parts`` by their other columns, and a key's table
    row is copied to those parts only that need it."""
    (part,) = fresh(rows, "part")
    dealt = rows.withColumn(part, F.pmod(F.xxhash64(*[c for c in rows.columns if c != key]), F.lit(parts)).cast("int"))
    copies = dealt.select(key, part).distinct().join(table, key)
    return dealt.join(copies, [key, part], how).drop(part)


def fold_ascii(text: Column) -> Column:
    """Lower-case A-Z only. Pure ASCII texts take Spark's byte-wise ``lower``; in others ``translate`` leaves
    accented letters alone."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))
