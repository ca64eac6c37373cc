"""Evaluation of samples."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.ml.evaluation import Evaluator
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ffspark.functions.activations import sample_cost
from ffspark.functions.params import Params
from ffspark.operators.forward import Shipped, layer_values, matrix


def evaluation_cost(df: DataFrame, params: Params) -> DataFrame:
    """One row: the mean of all squared differences of labels and outputs, and the number of samples. The tasks hand on
    one sum for each batch."""
    shipped = Shipped(df.sparkSession, params).lend()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shipped.get()
        for batch in batches:
            if batch.num_rows:
                cost = ((matrix(batch.column(1)) - layer_values(p, matrix(batch.column(0)))[1][-1]) ** 2).sum()
                yield pa.RecordBatch.from_arrays([pa.array([float(cost)]), pa.array([batch.num_rows], pa.int64())], names=["cost", "n"])

    sums = df.select("features", "labels").mapInArrow(run, "cost double, n long").agg(F.sum("cost").alias("cost"), F.coalesce(F.sum("n"), F.lit(0).cast("long")).alias("n"))
    return sums.select((F.col("cost") / F.col("n") / params.layers[-1]).alias("cost"), "n")


def class_counts(scored: DataFrame, n_classes: int) -> DataFrame:
    """class, n for each of the ``n_classes`` output nodes, 0 where no row fell."""
    found = scored.groupBy("class").agg(F.count(F.lit(1)).alias("n"))
    every = scored.sparkSession.range(n_classes).select(F.col("id").cast("int").alias("class"))
    return every.join(found, "class", "left").select("class", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


class CostEvaluator(Evaluator, DefaultParamsWritable, DefaultParamsReadable):
    """The mean of all squared differences of ``labels`` and ``output`` of scored samples, for model selection: less is
    better."""

    def _evaluate(self, dataset: DataFrame) -> float:
        return dataset.agg(F.avg(sample_cost("labels", "output") / F.size("labels"))).first()[0]

    def isLargerBetter(self) -> bool:
        return False
