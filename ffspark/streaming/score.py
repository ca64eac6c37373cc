"""Scoring streams: the forward pass keeps no state, so a streaming DataFrame goes through as it is."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ffspark.functions.activations import class_of
from ffspark.functions.params import Params
from ffspark.operators.forward import transform


def score_stream(stream: DataFrame, params: Params) -> DataFrame:
    """``stream`` (with ``features``) and its ``output`` and ``class``."""
    return transform(stream, params).withColumn("class", class_of("output"))


def write_scores(scored: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append scores to Parquet files, partitioned by class, for all data there is now; exactly once per input file."""
    return scored.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).partitionBy("class").trigger(availableNow=True).start()
