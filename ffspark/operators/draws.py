"""Drawing mini-batches: uniform, independent, with replacement."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Draws of one call are broadcast only up to this number of rows; more are joined by shuffle.
BROADCAST_DRAWS = 1_000_000


def make_draws(spark: SparkSession, n: int, batch_size: int, first_iter: int = 0, iterations: int = 1, seed: int = 0) -> DataFrame:
    """iter, sample_idx, mult: ``batch_size`` draws per iteration from 0 .. n-1. A draw is the first 60 bits of an MD5 digest
    of the seed and its number, modulo n, so it depends on those only and any engine can repeat it."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")).cast("binary"))
    slots = spark.range(first_iter * batch_size, (first_iter + iterations) * batch_size).select(
        F.floor(F.col("id") / batch_size).cast("int").alias("iter"), (F.conv(F.substring(digest, 1, 15), 16, 10).cast("long") % F.lit(n)).alias("sample_idx")
    )
    return slots.groupBy("iter", "sample_idx").agg(F.count(F.lit(1)).alias("mult"))


def draw_rows(samples: DataFrame, draws: DataFrame, n_draws: int | None = None) -> DataFrame:
    """The drawn samples with iter and mult. ``n_draws`` bounds the rows of ``draws``; without it they are counted."""
    n_draws = draws.count() if n_draws is None else n_draws
    return samples.join(F.broadcast(draws) if n_draws <= BROADCAST_DRAWS else draws, "sample_idx")
