"""Column functions: activations, per-sample cost, class of an output vector."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def relu(x: Column | str) -> Column:
    """0 below 0, else x. NaN stays NaN, because Spark orders NaN above every number."""
    x = _col(x)
    return F.when(x < 0, F.lit(0.0)).otherwise(x)


def relu_derivative(x: Column | str) -> Column:
    """0 below 0, else 1, so 1 at 0."""
    x = _col(x)
    return F.when(x < 0, F.lit(0.0)).otherwise(F.when(x.isNotNull(), F.lit(1.0)))


def sigmoid(x: Column | str) -> Column:
    """1 / (1 + exp(-x)); saturates at 0 and 1 without error."""
    return 1.0 / (1.0 + F.exp(-_col(x)))


def sigmoid_derivative(x: Column | str) -> Column:
    """s (1 - s) from the pre-activation."""
    s = sigmoid(x)
    return s * (1.0 - s)


def sample_cost(labels: Column | str, output: Column | str) -> Column:
    """Sum of squared differences of two arrays."""
    squares = F.zip_with(_col(labels), _col(output), lambda y, o: (y - o) * (y - o))
    return F.aggregate(squares, F.lit(0.0), lambda s, v: s + v)


def class_of(output: Column | str) -> Column:
    """Index of the largest value; the first of ties; a NaN wins."""
    out = _col(output)
    return F.array_position(out, F.array_max(out)).cast("int") - 1
