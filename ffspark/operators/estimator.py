"""Training as a ``pyspark.ml`` Estimator, scoring as a Model."""

from __future__ import annotations

import math
import time
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params as MLParams
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ffspark.functions.params import Params, check_layers, from_frame, random_params, to_frame, unflatten
from ffspark.operators.draws import draw_rows, make_draws
from ffspark.operators.fit_log import FitLog, Step
from ffspark.operators.forward import transform
from ffspark.operators.gradient import levels, mean_gradient, summed_gradient
from ffspark.operators.optim import Momentum, RMSprop
from ffspark.sources.positions import PositionedSamples
from ffspark.sources.registry import ModelRegistry
from ffspark.sources.samples import sample_widths, validate_samples
from ffspark.sources.storage import names_in, remove, scratch_path

#: Both spellings of the three modes.
MODES = {"batch": "batch", "Batch": "batch", "mini_b": "mini_b", "Mini Batch": "mini_b", "Mini batch": "mini_b", "stochastic": "stochastic", "Stochastic": "stochastic"}
HISTORY_SCHEMA = "iter int, cost double, l_rate double, best_cost double, elapsed_s double"
#: Mini-batches up to this size are drawn for many iterations in one job; larger ones take a job per iteration.
PREFETCH_ROWS = 10_000
#: Draws of one such job, whatever ``prefetch`` says, and its iterations where it says nothing.
PREFETCH_TOTAL, PREFETCH_STEPS = 100_000, 200
#: With a time limit or ``progress``, a job's iterations take about this long, or as long as the job's own start.
LIVE_SECONDS = 1.0


def _number(name: str, value: object, whole: bool = False, zero: bool = False) -> None:
    kinds = (int, np.integer) if whole else (int, float, np.integer, np.floating)
    if isinstance(value, bool) or not isinstance(value, kinds):
        raise TypeError(f"{name} must be a {'whole ' if whole else ''}number")
    if value < 0 or (value == 0 and not zero):
        raise ValueError(f"{name} must be {'0 or more' if zero else 'positive'}")


def _param(name: str, text: str) -> Param:
    return Param(MLParams._dummy(), name, text)


class _Writer(MLWriter):
    """Parameters as ``pyspark.ml`` keeps them; a model's network and trace as tables beside them."""

    def __init__(self, instance: FeedForwardClassifier | FeedForwardModel):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        spark = self.sparkSession
        DefaultParamsWriter.saveMetadata(self.instance, path, spark)
        if isinstance(self.instance, FeedForwardModel):
            self.instance.param_frame(spark).coalesce(1).write.parquet(f"{path}/params")
            self.instance.history(spark).coalesce(1).write.parquet(f"{path}/history")


class _Reader(MLReader):
    def __init__(self, kind: type):
        super().__init__()
        self.kind = kind

    def load(self, path: str) -> FeedForwardClassifier | FeedForwardModel:
        spark = self.sparkSession
        about = DefaultParamsReader.loadMetadata(path, spark, f"{self.kind.__module__}.{self.kind.__name__}")
        given = about["paramMap"]
        if self.kind is FeedForwardModel:
            trace = [tuple(r) for r in spark.read.schema(HISTORY_SCHEMA).parquet(f"{path}/history").orderBy("iter").collect()]
            out = FeedForwardModel(from_frame(spark.read.parquet(f"{path}/params")), trace, given.get("model_name", "model"))
        else:
            out = FeedForwardClassifier(**given)
        out._resetUid(about["uid"])
        return out


class FeedForwardClassifier(Estimator, MLWritable, MLReadable):
    """Trains a fully connected network: ReLU on hidden layers, sigmoid output, squared error.

    ``layers``: nodes per layer; None in the first or last place is taken from the data's widths. ``mode``: batch
    (full gradient, momentum), mini_b (RMSprop; ``eta`` has no part in it) or stochastic (one sample, momentum).
    Training ends after ``fixed_iter`` iterations if that is not 0, otherwise once the cost is at most ``threshold`` or
    NaN, or ``time_limit`` seconds have passed; the update of that iteration still counts. One of the three must be
    given. These and the other numbers are ``pyspark.ml`` parameters: grids, ``copy`` and ``save`` know them.

    Samples may have a column ``sample_idx`` that numbers them from 0 without gaps (leave it out for cross validation).
    ``draws`` (iter, sample_idx, mult) replaces the seeded draws; ``progress`` is called with the iteration, its
    cost and the best cost so far. With ``save_to`` the fitted parameters and the trace are saved there under
    ``model_name``, ``overwrite`` as in ``ModelRegistry.save``. With ``log_to`` the fit keeps a log at that path every
    ``log_every`` iterations and, started again, goes on from it: the end is that of an unbroken fit. Further keywords are
    ignored. Objects (``initial``, ``carry_biases``, ``draws``, ``progress``, ``save_to``, ``log_to``) are not written by
    ``save``.
    """

    layers = _param("layers", "nodes per layer, None at the ends: from the data")
    mode = _param("mode", "batch, mini_b or stochastic")
    threshold = _param("threshold", "end once the cost is at most this")
    time_limit = _param("time_limit", "end after so many seconds")
    batch_size = _param("batch_size", "draws of a mini-batch")
    eta = _param("eta", "learning rate of the modes with momentum")
    fixed_iter = _param("fixed_iter", "iterations, 0: until threshold or time limit")
    seed = _param("seed", "of initial weights and draws")
    gamma = _param("gamma", "decay of the update rule's state")
    rate = _param("rate", "learning rate of mini-batches")
    prefetch = _param("prefetch", "iterations drawn in one job, 0: a job each, None: by size")
    model_name = _param("model_name", "name under which the fit is saved")
    log_every = _param("log_every", "iterations between steps of the log")

    def __init__(
        self,
        layers: list[int | None],
        mode: str = "mini_b",
        threshold: float | None = None,
        time_limit: float = math.inf,
        batch_size: int = 50,
        eta: float = 0.005,
        fixed_iter: int = 0,
        seed: int = 0,
        gamma: float = 0.9,
        rate: float = 0.001,
        initial: Params | None = None,
        carry_biases: list[np.ndarray] | None = None,
        draws: DataFrame | None = None,
        prefetch: int | None = None,
        progress: Callable[[int, float, float], None] | None = None,
        model_name: str = "model",
        save_to: ModelRegistry | None = None,
        overwrite: bool | int = True,
        log_to: str | None = None,
        log_every: int = 10,
        **_: object,
    ):
        super().__init__()
        numbers = {"layers": layers, "mode": mode, "threshold": threshold, "time_limit": time_limit, "batch_size": batch_size, "eta": eta, "fixed_iter": fixed_iter, "seed": seed}
        numbers |= {"gamma": gamma, "rate": rate, "prefetch": prefetch, "model_name": model_name, "log_every": log_every}
        for name, value in numbers.items():
            self._paramMap[self.getParam(name)] = value
        self.initial, self.carry_biases, self.draws, self.progress = initial, carry_biases, draws, progress
        self.save_to, self.overwrite, self.log_to = save_to, overwrite, log_to
        self._check()

    def get(self, name: str) -> object:
        """The value of a parameter."""
        return self.getOrDefault(self.getParam(name))

    def _check(self) -> None:
        if self.get("mode") not in MODES:
            raise ValueError(f"mode must be one of {', '.join(MODES)}")
        for name in ("batch_size", "log_every"):
            _number(name, self.get(name), whole=True)
        for name in ("fixed_iter",) + (("prefetch",) if self.get("prefetch") is not None else ()):
            _number(name, self.get(name), whole=True, zero=True)
        for name in ("eta", "time_limit") + (("threshold",) if self.get("threshold") is not None else ()):
            _number(name, self.get(name))
        layers = self.get("layers")
        if not isinstance(layers, (list, tuple)):
            raise TypeError("layers must be a list")
        if len(layers) < 2 or any(n is None for n in layers[1:-1]):
            raise ValueError("only the first and the last layer may be left to the data")
        check_layers([n if n is not None else 1 for n in layers])
        if not self.get("fixed_iter") and self.get("threshold") is None and math.isinf(self.get("time_limit")):
            raise ValueError("give fixed_iter, threshold or time_limit: training would have no end")

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader(cls)

    def _resolve(self, df: DataFrame) -> list[int]:
        layers = list(self.get("layers"))
        if None not in layers:
            return check_layers(layers)
        widths = sample_widths(df)
        first = layers[0] if layers[0] is not None else widths["features"][1]
        last = layers[-1] if layers[-1] is not None else widths["labels"][1]
        if first is None or last is None:
            raise ValueError("the sample set is empty")
        return check_layers([first, *layers[1:-1], last])

    def _fit(self, dataset: DataFrame) -> FeedForwardModel:
        self._check()
        run = _Run(self, self._resolve(dataset), dataset)
        try:
            params, trace = run.train()
        finally:
            run.close()
        if self.save_to is not None:
            self.save_to.save(self.get("model_name"), params, self.overwrite, trace)
        return FeedForwardModel(params, trace, self.get("model_name"))


class _Run:
    """One fit: its samples where the tasks find them, and the loop over its iterations."""

    def __init__(self, by: FeedForwardClassifier, layers: list[int], dataset: DataFrame):
        self.by, self.layers, self.spark = by, layers, dataset.sparkSession
        self.mode = MODES[by.get("mode")]
        self.batch_size = 1 if self.mode == "stochastic" else by.get("batch_size")
        self.fixed_iter, self.threshold, self.time_limit, self.seed = by.get("fixed_iter"), by.get("threshold") or 1e-12, by.get("time_limit"), by.get("seed")
        self.live = by.progress is not None or not (self.fixed_iter or math.isinf(self.time_limit))
        self.ahead = self._ahead()
        own = "sample_idx" in dataset.columns
        chosen = dataset.select(*["sample_idx"] * own, "features", "labels")
        once = own and 0 < self.fixed_iter <= self.ahead and not self.live and by.log_to is None  # a single draw reads all files at most once
        self.stored, self.path, self.held = None, None, None
        if self.mode == "batch" or once:
            self.held = self.data = chosen.persist()
        else:
            self.stored = self._stored(chosen, own)
            self.data = self.stored.rows()
            if not self.ahead:
                self.held = self.data = self.data.persist()

    def _stored(self, chosen: DataFrame, own: bool) -> PositionedSamples:
        """The samples with their numbers, in the shared folder for this run; with a log and rows that have no numbers of
        their own beside the log, so that a fit that goes on finds the same rows under them."""
        if self.by.log_to is None or own:
            self.path = scratch_path(self.spark, "samples")
            return PositionedSamples.write(chosen, self.path)
        path = f"{self.by.log_to.rstrip('/')}/samples"
        if "_complete" not in names_in(self.spark, path):
            remove(self.spark, path)
            PositionedSamples.write(chosen, path)
        return PositionedSamples(self.spark, path)

    def close(self) -> None:
        if self.held is not None:
            self.held.unpersist()
        if self.path is not None:
            remove(self.spark, self.path)

    def _ahead(self) -> int:
        """Most iterations drawn in one job: never more than ``PREFETCH_TOTAL`` draws; 0 for a job each."""
        given = self.by.get("prefetch")
        if self.mode == "batch" or given == 0 or (given is None and self.batch_size > PREFETCH_ROWS):
            return 0
        if self.by.draws is not None and self.by.draws.limit(PREFETCH_TOTAL + 1).count() > PREFETCH_TOTAL:
            return 0
        return min(PREFETCH_STEPS if given is None else given, PREFETCH_TOTAL // self.batch_size)

    def _more(self, k: int, cost: float, elapsed: float) -> bool:
        if self.fixed_iter:
            return k < self.fixed_iter
        return cost > self.threshold and elapsed < self.time_limit

    def train(self) -> tuple[Params, list[tuple]]:
        by = self.by
        n = validate_samples(self.data, self.layers[0], self.layers[-1])
        params = by.initial.copy() if by.initial is not None else random_params(self.layers, self.seed, by.carry_biases)
        if params.layers != self.layers:
            raise ValueError(f"initial parameters are for {params.layers}, not {self.layers}")
        rule = RMSprop(self.layers, by.get("rate"), by.get("gamma")) if self.mode == "mini_b" else Momentum(self.layers, by.get("eta"), by.get("gamma"))
        log, trace, elapsed = None, [], 0.0
        if by.log_to is not None:
            log = FitLog(self.spark, by.log_to)
            log.check({"layers": self.layers, "mode": self.mode, "batch_size": self.batch_size, "n": n} | {c: by.get(c) for c in ("eta", "gamma", "rate", "seed")})
            if (step := log.latest()) is not None:
                params, rule.state, trace = unflatten(step.params, self.layers), unflatten(step.state, self.layers), step.trace
                elapsed = trace[-1][4] if trace else 0.0
        k, cost, best = len(trace), trace[-1][1] if trace else 999.0, trace[-1][3] if trace else math.inf
        depth = levels(self.data) if not self.ahead else 0
        began, every, steps = time.time() - elapsed, by.get("log_every"), 1 if self.live else self.ahead
        while self._more(k, cost, time.time() - began):
            if self.ahead:
                steps = min(steps, self.ahead, self.fixed_iter - k if self.fixed_iter else self.ahead, every - k % every if log else self.ahead)
                started = time.time()
                found = self._drawn_steps(n, params, rule, k, steps, began + self.time_limit)
                spent = found[-1][2] - found[0][3]
                start = max(LIVE_SECONDS, time.time() - started - spent)
                steps = max(1, int(len(found) * start / max(spent, 1e-6))) if self.live else self.ahead
            else:
                g = mean_gradient(self.data if self.mode == "batch" else draw_rows(self.data, self._draws(n, k, 1), self._bound(1)), params, depth)
                found = [(g.cost, rule.step(params, g.grad), time.time())]
            for cost, l_rate, at, *_ in found:
                best = min(best, cost)
                trace.append((k, cost, l_rate, best, at - began))
                if by.progress:
                    by.progress(k, cost, best)
                k += 1
            if log and (k % every == 0 or not self._more(k, cost, time.time() - began)):
                log.write(Step(k, params.flat(), rule.state.flat(), trace))
        return params, trace

    def _bound(self, steps: int) -> int | None:
        return self.batch_size * steps if self.by.draws is None else None

    def _draws(self, n: int, k: int, steps: int) -> DataFrame:
        if self.by.draws is not None:
            return self.by.draws.where((F.col("iter") >= k) & (F.col("iter") < k + steps))
        return make_draws(self.spark, n, self.batch_size, k, steps, self.seed)

    def _drawn_steps(self, n: int, params: Params, rule: Momentum | RMSprop, k: int, steps: int, deadline: float) -> list[tuple]:
        """Draw the rows of ``steps`` iterations in one job and run their recurrence, serial by nature, in one task: at most
        ``PREFETCH_TOTAL`` draws. Parameters and the rule's state go in and come back, with cost, rate, end and begin of each
        iteration. Beyond the first, an iteration begins only before ``deadline`` (seconds of the clock)."""
        layers, stop = self.layers, None if self.fixed_iter else (self.threshold, deadline)

        def run(table: pa.Table) -> pa.Table:
            found = []
            table = table.sort_by([("iter", "ascending"), ("sample_idx", "ascending")])
            its = table.column("iter").to_numpy()
            x, y = (np.array(table.column(c).to_pylist(), float) for c in ("features", "labels"))
            mult = table.column("mult").to_numpy()
            for it in range(k, k + steps):
                begun, at = time.time(), its == it
                if not at.any():
                    raise ValueError(f"no draws for iteration {it}")
                flat, cost, m = summed_gradient(params, x[at], y[at], mult[at])
                cost = cost / m / layers[-1]
                rate = rule.step(params, unflatten(flat / m, layers))
                found.append((cost, rate, time.time(), begun))
                if stop and not (cost > stop[0] and time.time() < stop[1]):
                    break
            lists = dict(zip(("costs", "rates", "ends", "begins"), ([list(c)] for c in zip(*found, strict=True)), strict=True))
            return pa.table({"params": [params.flat()], "state": [rule.state.flat()]} | lists)

        drawn = self._draws(n, k, steps)
        rows = draw_rows(self.data, drawn, self._bound(steps)) if self.stored is None else self.stored.drawn(drawn, PREFETCH_TOTAL)
        schema = ", ".join(f"{c} array<double>" for c in ("params", "state", "costs", "rates", "ends", "begins"))
        out = rows.withColumn("g", F.lit(0)).groupBy("g").applyInArrow(run, schema).first()
        if out is None:
            raise ValueError(f"no draws for iteration {k}")
        new = unflatten(np.array(out.params), layers)
        params.weights, params.biases, rule.state = new.weights, new.biases, unflatten(np.array(out.state), layers)
        return list(zip(out.costs, out.rates, out.ends, out.begins, strict=True))


class FeedForwardModel(Model, MLWritable, MLReadable):
    """A trained network. ``transform`` adds ``output`` and ``class``."""

    model_name = _param("model_name", "name of the model")

    def __init__(self, params: Params, trace: list[tuple] | None = None, name: str = "model"):
        super().__init__()
        self.network, self.trace, self.name = params, trace or [], name
        self._paramMap[self.model_name] = name

    @property
    def layers(self) -> list[int]:
        return self.network.layers

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader(cls)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        from ffspark.functions.activations import class_of

        return transform(dataset, self.network).withColumn("class", class_of("output"))

    def param_frame(self, spark: SparkSession, version: int = 1) -> DataFrame:
        return to_frame(spark, self.network, self.name, version)

    def history(self, spark: SparkSession) -> DataFrame:
        """One row per iteration: cost before the update, mean effective rate, best cost so far, seconds."""
        return spark.createDataFrame(self.trace, HISTORY_SCHEMA)


def best_cost(cost: str = "cost", order: str = "iter") -> Column:
    """Running minimum over the iterations. A history has one row per iteration, so one window partition holds it."""
    return F.min(cost).over(Window.orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
