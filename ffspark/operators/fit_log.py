"""A training log on shared storage, from which a fit that stopped goes on as if it had not."""

from __future__ import annotations

import json
from typing import NamedTuple

import numpy as np
from pyspark.sql import SparkSession

from ffspark.sources.storage import claim, names_in, remove, text_of

STEP_SCHEMA = "iteration int, params array<double>, state array<double>, iters array<int>, costs array<double>, rates array<double>, best array<double>, elapsed array<double>"


class Step(NamedTuple):
    """Where a fit stood: iterations done, flat parameters, flat state of the update rule, and its trace so far."""

    iteration: int
    params: np.ndarray
    state: np.ndarray
    trace: list[tuple]


class FitLog:
    """Steps of one fit under a path. A step is one Parquet row in a folder of its own and counts once the writer's
    ``_SUCCESS`` is there, which comes last: a step that broke off is never read. Only the last two are kept."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def check(self, settings: dict) -> None:
        """ValueError if the log belongs to a fit with other settings."""
        text = json.dumps(settings, sort_keys=True)
        if not claim(self.spark, f"{self.path}/settings.json", text) and text_of(self.spark, f"{self.path}/settings.json") != text:
            raise ValueError(f"the log at {self.path} belongs to a fit with other settings")

    def _steps(self) -> list[int]:
        found = [n.partition("=")[2] for n in names_in(self.spark, self.path) if n.startswith("step=")]
        return sorted(int(k) for k in found if k.isdigit() and "_SUCCESS" in names_in(self.spark, f"{self.path}/step={k}"))

    def latest(self) -> Step | None:
        steps = self._steps()
        if not steps:
            return None
        r = self.spark.read.schema(STEP_SCHEMA).parquet(f"{self.path}/step={steps[-1]}").first()
        trace = [tuple(x) for x in zip(r.iters, r.costs, r.rates, r.best, r.elapsed, strict=True)]
        return Step(r.iteration, np.array(r.params), np.array(r.state), trace)

    def write(self, step: Step) -> None:
        columns = [list(x) for x in zip(*step.trace, strict=True)] or [[]] * 5
        row = (step.iteration, step.params.tolist(), step.state.tolist(), *columns)
        frame = self.spark.createDataFrame([row], STEP_SCHEMA).coalesce(1)
        frame.write.mode("overwrite").parquet(f"{self.path}/step={step.iteration}")
        for old in self._steps()[:-2]:
            remove(self.spark, f"{self.path}/step={old}")
