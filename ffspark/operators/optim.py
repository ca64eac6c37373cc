"""Update rules on the driver's parameter arrays."""

from __future__ import annotations

import numpy as np

from ffspark.functions.params import Params, zeros


class Momentum:
    """delta = eta * g + gamma * delta; p -= delta. Used by full-batch and single-sample descent."""

    def __init__(self, layers: list[int], eta: float = 0.005, gamma: float = 0.9):
        self.eta, self.gamma, self.state = eta, gamma, zeros(layers)

    def step(self, params: Params, grad: Params) -> float:
        """Update in place; returns the mean effective rate, over layers of weights, taken after delta's update."""
        rates = []
        for p, g, d, is_weight in _together(params, grad, self.state):
            d[...] = self.eta * g + self.gamma * d
            p -= d
            if is_weight:
                rates.append(np.mean((self.eta * g + self.gamma * d) / (g + 1e-4)))
        return float(np.mean(rates))


class RMSprop:
    """r = (1 - gamma) g^2 + gamma r; p -= rate / (sqrt(r) + rate) * g. Used by mini-batches; the learning rate eta has
    no part in it."""

    def __init__(self, layers: list[int], rate: float = 0.001, gamma: float = 0.9):
        self.rate, self.gamma, self.state = rate, gamma, zeros(layers)

    def step(self, params: Params, grad: Params) -> float:
        rates = []
        for p, g, r, is_weight in _together(params, grad, self.state):
            r[...] = (1 - self.gamma) * g**2 + self.gamma * r
            p -= self.rate / (np.sqrt(r) + 0.001) * g
            if is_weight:
                rates.append(np.mean(self.rate / (np.sqrt(r) + 1e-5)))
        return float(np.mean(rates))


def _together(params: Params, grad: Params, state: Params):
    for kind in ("weights", "biases"):
        for p, g, s in zip(getattr(params, kind), getattr(grad, kind), getattr(state, kind), strict=True):
            yield p, g, s, kind == "weights"
