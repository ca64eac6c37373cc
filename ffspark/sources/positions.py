"""Numbered samples on shared storage: drawn rows are found by file, and a lost executor changes no row's number."""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ffspark.sources.storage import claim, text_of

#: Column by which the stored rows are found: the row's number, or its partition and place where it had no number.
KEY = "__key"
INDEX_SCHEMA = "file string, low long, high long, first long, n long"


class PositionedSamples:
    """Samples numbered from 0, as Parquet files with an index of (file, row range, first number).

    The numbers are those that were given at writing, so later jobs, retries and sessions see the same rows under them.
    A draw reads only the files that hold drawn rows, and within these the filter on the row range reaches the scan."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        about = json.loads(text_of(spark, f"{self.path}/_complete"))
        self.schema, self.numbered, self.n = StructType.fromJson(about["schema"]), about["numbered"], about["n"]
        index = spark.read.schema(INDEX_SCHEMA).parquet(f"{self.path}/index").orderBy("first").collect()
        self.files = [r.file for r in index]
        self.low, self.high, self.first = (np.array([r[c] for r in index], np.int64) for c in ("low", "high", "first"))

    @classmethod
    def write(cls, df: DataFrame, path: str) -> PositionedSamples:
        """Store ``df``. A column ``sample_idx`` gives the numbers, each once and without gaps; otherwise rows are numbered
        in the order of partitions and places that this one job meets. The path must be new; what a broken write leaves
        there is never read, because the mark of completeness comes last."""
        spark, numbered = df.sparkSession, "sample_idx" in df.columns
        if numbered:
            placed = df.withColumnRenamed("sample_idx", KEY).repartitionByRange(KEY).sortWithinPartitions(KEY)
        else:
            placed = df.withColumn(KEY, F.monotonically_increasing_id())
        placed.write.parquet(f"{path}/rows")
        stored = spark.read.schema(placed.schema).parquet(f"{path}/rows")
        found = stored.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.min(KEY).alias("low"), F.max(KEY).alias("high"), F.count(F.lit(1)).alias("n")).collect()
        rows, at = [], 0
        for r in sorted(found, key=lambda r: r.low):
            first = r.low if numbered else at
            if first != at or r.high - r.low + 1 != r.n:
                raise ValueError("sample_idx must number the rows from 0 without gaps")
            rows.append((r.file, r.low, r.high, first, r.n))
            at += r.n
        spark.createDataFrame(rows, INDEX_SCHEMA).coalesce(1).write.parquet(f"{path}/index")
        claim(spark, f"{path}/_complete", json.dumps({"schema": placed.schema.jsonValue(), "numbered": numbered, "n": at}))
        return cls(spark, path)

    def _numbered(self, files: list[str]) -> DataFrame:
        """The rows of these files; ``sample_idx`` comes from the index, one row a file, joined on the file's name."""
        rows = self.spark.read.schema(self.schema).parquet(*files)
        if self.numbered:
            return rows.withColumnRenamed(KEY, "sample_idx")
        shift = [(int(self.low[k]) >> 33, int(self.first[k] - self.low[k])) for k in (self.files.index(f) for f in files)]
        table = self.spark.createDataFrame(shift, "__part long, __shift long")
        return rows.join(table, F.shiftright(KEY, 33) == F.col("__part")).withColumn("sample_idx", F.col(KEY) + F.col("__shift")).drop(KEY, "__part", "__shift")

    def rows(self) -> DataFrame:
        """All samples with ``sample_idx``."""
        return self._numbered(self.files) if self.files else self._none()

    def _none(self) -> DataFrame:
        return self.spark.createDataFrame([], self.schema).withColumnRenamed(KEY, "sample_idx")

    def files_of(self, numbers: np.ndarray) -> list[str]:
        """The files that hold the rows of these numbers."""
        inside = numbers[(numbers >= 0) & (numbers < self.n)]
        return [self.files[k] for k in np.unique(np.searchsorted(self.first, inside, "right") - 1)]

    def drawn(self, draws: DataFrame, bound: int) -> DataFrame:
        """The drawn samples with iter and mult. Of the draws, at most ``bound``, the numbers come to the driver, which picks
        the files; more draws than that are an error."""
        found = draws.select("iter", "sample_idx", "mult").limit(bound + 1).toArrow()
        if found.num_rows > bound:
            raise ValueError(f"more than {bound} draws at once")
        numbers = found.column("sample_idx").to_numpy()
        files = self.files_of(numbers)
        if not files:
            return self._none().withColumn("iter", F.lit(0)).withColumn("mult", F.lit(0).cast("long"))
        chosen = self.spark.createDataFrame(found.to_pandas(), "iter int, sample_idx long, mult long")
        rows = self._numbered(files)
        if self.numbered:
            rows = rows.where(F.col("sample_idx").between(int(numbers.min()), int(numbers.max())))
        return rows.join(F.broadcast(chosen), "sample_idx")
