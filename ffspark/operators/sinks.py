"""Classifying a data set into one folder per class."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ffspark.functions.activations import class_of
from ffspark.functions.params import Params
from ffspark.operators.evaluate import class_counts
from ffspark.operators.forward import transform
from ffspark.sources.registry import ModelRegistry, next_free
from ffspark.sources.samples import validate_samples
from ffspark.sources.storage import claim, names_in


class Classified(NamedTuple):
    scored: DataFrame  # as read back from the class folders
    manifest: DataFrame  # class, n: every output node, also those without rows
    path: str


def next_run(spark: SparkSession, out: str, model: str) -> str:
    """``<out>/sorted_by_<model>_<k>`` with the first free k from 0, reserved for the caller: runs that ask at once get
    numbers of their own."""
    prefix = f"sorted_by_{model}_"
    taken = {n for folder in (out, f"{out.rstrip('/')}/_claims") for n in names_in(spark, folder)}
    k = next_free(spark.createDataFrame([(n,) for n in taken], "name string"), prefix, "")
    while f"{prefix}{k}" in taken or not claim(spark, f"{out.rstrip('/')}/_claims/{prefix}{k}"):
        k += 1
    return f"{out.rstrip('/')}/{prefix}{k}"


def write_classes(scored: DataFrame, path: str, n_classes: int) -> Classified:
    """One partition directory per class that has rows, and a manifest of all classes. The path must be new. Rows are
    rebalanced by class first: few files for small classes, several for one that holds most rows."""
    scored.hint("rebalance", "class").write.mode("errorifexists").partitionBy("class").parquet(f"{path}/rows")
    spark = scored.sparkSession
    back = spark.read.schema(scored.schema).parquet(f"{path}/rows").select(*scored.columns)
    class_counts(back, n_classes).coalesce(1).write.parquet(f"{path}/manifest")
    return Classified(back, spark.read.parquet(f"{path}/manifest"), path)


def classify(df: DataFrame, params: Params, out: str, model: str = "model") -> Classified:
    """Check widths, score all rows, write them into class folders of a fresh run directory."""
    validate_samples(df, params.layers[0])
    scored = transform(df, params).withColumn("class", class_of("output"))
    return write_classes(scored, next_run(df.sparkSession, out, model), params.layers[-1])


def classify_with(registry: ModelRegistry, df: DataFrame, model: str, out: str, version: int | None = None) -> Classified:
    """``classify`` with a saved model, the latest version unless one is given."""
    return classify(df, registry.load(model, version), out, model)
