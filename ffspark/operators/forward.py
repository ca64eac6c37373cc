"""The forward pass: ReLU on hidden layers, sigmoid on the output layer.

Two engines: ``arrow`` multiplies whole Arrow batches with NumPy inside the tasks, ``expr`` builds the same from array
expressions only and never leaves the JVM. Samples must have passed ``validate_samples``: equal widths, no nulls.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ffspark.functions.activations import relu, sigmoid
from ffspark.functions.params import Params

#: Parameters above this size go out as a broadcast variable, smaller ones with the task.
CLOSURE_BYTES = 1 << 20


#: Broadcast parameters that lazy results may still need; of those before them the executors' copies are dropped.
HELD = 4
_held: list = []


class Shipped:
    """Parameters on their way to the tasks."""

    def __init__(self, spark, params: Params):
        large = params.flat().nbytes > CLOSURE_BYTES
        self.own, self.shared = (None, spark.sparkContext.broadcast(params)) if large else (params, None)

    def get(self) -> Params:
        return self.own if self.shared is None else self.shared.value

    def close(self) -> None:
        """No job will need them any more."""
        if self.shared is not None:
            self.shared.destroy()

    def lend(self) -> Shipped:
        """For a result that is computed later: only the last ``HELD`` stay on the executors; a job on an older one fetches
        its copy again."""
        if self.shared is not None:
            _held.append(self.shared)
            while len(_held) > HELD:
                _held.pop(0).unpersist()
        return self


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column of equal widths and no nulls."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return flat.reshape(len(column), -1)


def layer_values(params: Params, x: np.ndarray, upto: int | None = None) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Pre-activations and outputs of all layers, the input first in both; ``upto`` stops before that layer."""
    pre, act, last = [x], [x], len(params.weights)
    for l, (w, b) in enumerate(zip(params.weights, params.biases, strict=True), 1):
        if upto is not None and l >= upto:
            break
        z = act[-1] @ w + b
        with np.errstate(over="ignore", invalid="ignore"):
            act.append(1 / (1 + np.exp(-z)) if l == last else np.where(z < 0, 0.0, z))
        pre.append(z)
    return pre, act


def lists(a: np.ndarray) -> pa.Array:
    offsets = np.arange(0, a.size + 1, max(1, a.shape[1]), dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(a).ravel()))


def _nested(layers: list[np.ndarray]) -> pa.Array:
    """One list of lists for each row, of the row's values in each of ``layers``, by offsets alone."""
    rows, ends = len(layers[0]), np.cumsum([0, *(a.shape[1] for a in layers)])
    inner = (np.arange(rows)[:, None] * ends[-1] + ends[None, :-1]).ravel()
    values = pa.array(np.hstack(layers).ravel())
    lists = pa.ListArray.from_arrays(pa.array(np.append(inner, rows * ends[-1]), pa.int32()), values)
    return pa.ListArray.from_arrays(pa.array(np.arange(rows + 1) * len(layers), pa.int32()), lists)


def dense(df: DataFrame, weights: np.ndarray, biases: np.ndarray, column: str = "features", out: str = "z") -> DataFrame:
    """One dense layer without activation, as array expressions."""
    return df.withColumn(out, _dense(F.col(column), weights, biases))


def _dense(a: Column, w: np.ndarray, b: np.ndarray) -> Column:
    numbers = lambda v: F.array(*[F.lit(float(x)) for x in v])
    dot = lambda col: F.aggregate(F.zip_with(a, numbers(col), lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)
    return F.array(*[dot(w[:, j]) + F.lit(float(b[j])) for j in range(w.shape[1])])


def transform(df: DataFrame, params: Params, layers: str | int | None = None, engine: str = "arrow", column: str = "features") -> DataFrame:
    """``df`` with ``output array<double>``; with layers="all" with ``pre`` and ``act``, arrays of one array per layer
    (input first); with a whole number k, ``output`` holds the values after layers 1 .. k-1 (0 and 1: the input).

    All columns of ``df`` travel with the row, so select only what is needed. Works on streams too.
    """
    depth = len(params.weights)
    upto = None
    if isinstance(layers, bool) or (layers is not None and layers != "all" and not isinstance(layers, int)):
        raise TypeError('layers must be "all", a whole number or None')
    if isinstance(layers, int):
        if not 0 <= layers <= depth + 1:
            raise ValueError(f"layers must lie between 0 and {depth + 1}")
        upto = layers
    if engine == "expr":
        return _transform_expr(df, params, layers, upto, column)
    if engine != "arrow":
        raise ValueError("engine must be arrow or expr")
    shipped = Shipped(df.sparkSession, params).lend()
    new = [c for c in ("pre", "act")] if layers == "all" else ["output"]
    kept = [c for c in df.columns if c not in new]
    source = df.select(*kept)
    kind = "array<array<double>>" if layers == "all" else "array<double>"
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema), *(f"{c} {kind}" for c in new)])
    at = kept.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shipped.get()
        for batch in batches:
            if not batch.num_rows:
                continue
            pre, act = layer_values(p, matrix(batch.column(at)), upto)
            if layers == "all":
                more = [_nested(pre), _nested(act)]
            else:
                more = [lists(act[-1])]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*kept, *new])

    return source.mapInArrow(run, schema)


def _transform_expr(df: DataFrame, params: Params, layers: str | int | None, upto: int | None, column: str) -> DataFrame:
    step = df.withColumn("__a0", F.col(column).cast("array<double>")).withColumn("__z0", F.col("__a0"))
    depth = len(params.weights)
    reached = 0
    for l, (w, b) in enumerate(zip(params.weights, params.biases, strict=True), 1):
        if upto is not None and l >= upto:
            break
        step = step.withColumn(f"__z{l}", _dense(F.col(f"__a{l - 1}"), w, b))
        step = step.withColumn(f"__a{l}", F.transform(f"__z{l}", (lambda v: sigmoid(v)) if l == depth else (lambda v: relu(v))))
        reached = l
    if layers == "all":
        step = step.withColumn("pre", F.array(*[F.col(f"__z{l}") for l in range(reached + 1)])).withColumn("act", F.array(*[F.col(f"__a{l}") for l in range(reached + 1)]))
    else:
        step = step.withColumn("output", F.col(f"__a{reached}"))
    return step.drop(*[f"__{k}{l}" for k in "az" for l in range(reached + 1)])
