"""Gradients by back-propagation, vectorised over Arrow batches, with one partial row per partition."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ffspark.functions.params import Params, unflatten
from ffspark.operators.forward import Shipped, layer_values, lists, matrix

#: Beyond so many partitions partial rows are first summed in groups.
DIRECT_PARTIALS, FAN_IN = 256, 32
#: Size of the gradients of single samples that a task makes at once.
SLICE_BYTES = 16 << 20


class Gradient(NamedTuple):
    grad: Params  # mean over the samples, each counted ``mult`` times
    cost: float  # mean of the samples' costs, each divided by the output width
    n: int


def batch_deltas(params: Params, x: np.ndarray, y: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """Outputs of each layer's input side, deltas of each layer, and the samples' costs."""
    pre, act = layer_values(params, x)
    out = act[-1]
    deltas = [out * (1 - out) * (out - y)]
    for l in range(len(params.weights) - 1, 0, -1):
        deltas.insert(0, (deltas[0] @ params.weights[l].T) * np.where(pre[l] < 0, 0.0, 1.0))
    return act[:-1], deltas, ((y - out) ** 2).sum(axis=1)


def summed_gradient(params: Params, x: np.ndarray, y: np.ndarray, mult: np.ndarray | None = None) -> tuple[np.ndarray, float, int]:
    inputs, deltas, cost = batch_deltas(params, x, y)
    m = np.ones(len(x)) if mult is None else mult.astype(float)
    parts = [p.ravel() for a, d in zip(inputs, deltas, strict=True) for p in (a.T @ (d * m[:, None]), (d * m[:, None]).sum(axis=0))]
    return np.concatenate(parts), float((cost * m).sum()), int(m.sum())


PARTIAL = "part int, n long, cost double, grad array<double>"


def partials(df: DataFrame, shipped: Shipped) -> DataFrame:
    """One row per partition that has samples: its number, sample count, cost sum and flat gradient sum."""
    weighted = "mult" in df.columns
    source = df.select("features", "labels", *(["mult"] if weighted else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, total, cost, n = shipped.get(), None, 0.0, 0
        for batch in batches:
            if batch.num_rows:
                mult = batch.column(2).to_numpy(zero_copy_only=False) if weighted else None
                g, c, k = summed_gradient(p, matrix(batch.column(0)), matrix(batch.column(1)), mult)
                total, cost, n = g if total is None else total + g, cost + c, n + k
        if n:
            part = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([n], pa.int64()), pa.array([cost]), pa.array([total], pa.list_(pa.float64()))], names=["part", "n", "cost", "grad"])

    return source.mapInArrow(run, PARTIAL)


def levels(df: DataFrame) -> int:
    """How often partial sums must be grouped until the driver gets ``DIRECT_PARTIALS`` rows at most; 0 if it takes those of
    the partitions one by one."""
    parts, out = (df.select(F.spark_partition_id().alias("p")).agg(F.max("p")).first()[0] or 0) + 1, 0
    while parts > DIRECT_PARTIALS:
        parts, out = -(-parts // FAN_IN), out + 1
    return out


def _sum_group(table: pa.Table) -> pa.Table:
    table = table.sort_by("part")
    grad = np.sum(np.stack(table.column("grad").to_numpy()), axis=0)
    return pa.table({"part": table.column("part")[:1], "n": [sum(table.column("n").to_pylist())], "cost": [float(np.sum(table.column("cost").to_numpy()))], "grad": [grad]})


def summed_in_groups(rows: DataFrame, depth: int) -> DataFrame:
    """Partial rows added up over groups of ``FAN_IN`` partitions, then over groups of groups, ``depth`` times in all."""
    for level in range(1, depth + 1):
        rows = rows.groupBy(F.floor(F.col("part") / FAN_IN**level).alias("g")).applyInArrow(_sum_group, PARTIAL)
    return rows


def is_wide(df: DataFrame) -> bool:
    """More partitions than whose partial sums the driver takes one by one."""
    return levels(df) > 0


def mean_gradient(df: DataFrame, params: Params, wide: bool | int = True) -> Gradient:
    """Mean gradient and cost over all samples of ``df``, weighted by ``mult`` if there is such a column.

    Only partial sums reach the driver, and they are added in partition order, so a fixed partitioning gives the same
    floats again. They are first summed in groups of partitions, and those in groups again, as often as ``levels`` finds;
    ``wide`` False does without, and a number says how often where the caller knows.
    """
    depth = levels(df) if wide is True else int(wide)
    shipped = Shipped(df.sparkSession, params)
    rows = summed_in_groups(partials(df, shipped), depth)
    found = sorted(rows.collect(), key=lambda r: r.part)
    shipped.close()
    if not found:
        raise ValueError("the sample set is empty")
    n = sum(r.n for r in found)
    flat = np.sum(np.stack([np.array(r.grad) for r in found]), axis=0) / n
    return Gradient(unflatten(flat, params.layers), sum(r.cost for r in found) / n / params.layers[-1], n)


def sample_gradients(df: DataFrame, params: Params) -> DataFrame:
    """sample_id, cost and the flat gradient of every sample by itself, in batches of about ``SLICE_BYTES``."""
    shipped = Shipped(df.sparkSession, params).lend()
    rows = max(1, SLICE_BYTES // (8 * len(params.flat())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shipped.get()
        for whole in batches:
            for at in range(0, whole.num_rows, rows):
                batch = whole.slice(at, rows)
                inputs, deltas, cost = batch_deltas(p, matrix(batch.column(1)), matrix(batch.column(2)))
                k = batch.num_rows
                parts = [x for a, d in zip(inputs, deltas, strict=True) for x in ((a[:, :, None] * d[:, None, :]).reshape(k, -1), d)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cost), lists(np.hstack(parts))], names=["sample_id", "cost", "grad"])

    return df.select("sample_id", "features", "labels").mapInArrow(run, "sample_id long, cost double, grad array<double>")
