"""Network parameters: driver-side arrays, and their long table form."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession

#: Row of the parameter table; biases have i = 0.
PARAM_SCHEMA = "model string, version int, layer int, kind string, i int, j int, value double"


@dataclass
class Params:
    """weights[l] has shape (N[l], N[l+1]), biases[l] shape (N[l+1],)."""

    weights: list[np.ndarray]
    biases: list[np.ndarray]

    @property
    def layers(self) -> list[int]:
        return [self.weights[0].shape[0], *(len(b) for b in self.biases)]

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for pair in zip(self.weights, self.biases, strict=True) for x in pair])

    def copy(self) -> Params:
        return Params([w.copy() for w in self.weights], [b.copy() for b in self.biases])


def check_layers(layers: list[int]) -> list[int]:
    """Node counts of every layer, input first; at least an input and an output layer of one node or more."""
    if not isinstance(layers, (list, tuple, np.ndarray)) or not all(isinstance(n, (int, np.integer)) and not isinstance(n, bool) for n in layers):
        raise TypeError("layers must be a list of whole numbers")
    if len(layers) < 2 or min(layers) < 1:
        raise ValueError("layers needs at least two entries, all positive")
    return [int(n) for n in layers]


def zeros(layers: list[int]) -> Params:
    n = check_layers(layers)
    return Params([np.zeros((a, b)) for a, b in zip(n, n[1:])], [np.zeros(b) for b in n[1:]])


def unflatten(flat: np.ndarray, layers: list[int]) -> Params:
    out, at = zeros(layers), 0
    for w, b in zip(out.weights, out.biases, strict=True):
        w[...] = flat[at : at + w.size].reshape(w.shape)
        b[...] = flat[at + w.size : at + w.size + b.size]
        at += w.size + b.size
    return out


def init_sigmas(layers: list[int]) -> list[float]:
    """Standard deviation of the initial weights of layer l = 1, 2, ...: 2 / sqrt(a + b) while the layer's number is
    below the output width, else sqrt(2 / (a + b)), for a inputs and b outputs. The comparison of a number with a
    width is part of the method."""
    n = check_layers(layers)
    return [2 / np.sqrt(n[k] + n[k - 1]) if k < n[-1] else np.sqrt(2 / (n[k] + n[k - 1])) for k in range(1, len(n))]


def random_params(layers: list[int], seed: int = 0, biases: list[np.ndarray] | None = None) -> Params:
    """Normal weights; biases are zero, or those given (a repeated fit carries them over)."""
    rng, out = np.random.default_rng(seed), zeros(layers)
    out.weights = [rng.normal(0, s, w.shape) for s, w in zip(init_sigmas(layers), out.weights, strict=True)]
    if biases is not None:
        out.biases = [np.array(b, float) for b in biases]
    return out


def fixed_params(layers: list[int]) -> Params:
    """Reproducible parameters whose irrational parts keep pre-activations away from exactly 0."""
    out = zeros(layers)
    for l, (w, b) in enumerate(zip(out.weights, out.biases, strict=True), 1):
        i, j = np.indices(w.shape)
        w[...] = ((31 * i + 17 * j + 7 * l) % 21 - 10) / 50 + np.sqrt(2 + i + 3 * j + 5 * l) / 97
        k = np.arange(len(b))
        b[...] = ((13 * k + 5 * l) % 11 - 5) / 50 + np.sqrt(3 + k + 2 * l) / 89
    return out


def to_frame(spark: SparkSession, params: Params, model: str = "model", version: int = 1) -> DataFrame:
    """The parameter table of one model: its size is that of the model, not of the data."""
    rows = []
    for l, (w, b) in enumerate(zip(params.weights, params.biases, strict=True), 1):
        rows += [(model, version, l, "w", i, j, float(w[i, j])) for i in range(w.shape[0]) for j in range(w.shape[1])]
        rows += [(model, version, l, "b", 0, j, float(b[j])) for j in range(len(b))]
    return spark.createDataFrame(rows, PARAM_SCHEMA)


def from_frame(frame: DataFrame) -> Params:
    """Arrays from the parameter table of one model; the architecture follows from the largest indices."""
    rows = frame.select("layer", "kind", "i", "j", "value").collect()
    if not rows:
        raise ValueError("no parameters")
    depth = max(r.layer for r in rows)
    width = {l: max(r.j for r in rows if r.layer == l) + 1 for l in range(1, depth + 1)}
    out = zeros([max(r.i for r in rows if r.layer == 1 and r.kind == "w") + 1, *width.values()])
    for r in rows:
        if r.kind == "w":
            out.weights[r.layer - 1][r.i, r.j] = r.value
        else:
            out.biases[r.layer - 1][r.j] = r.value
    return out
