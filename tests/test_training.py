"""Fits that stop and go on, stored samples, model selection, concurrent writers, and layers in long form."""

import json
import os
import time
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pytest
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import functions as F

from ffspark.functions.params import fixed_params, random_params, to_frame
from ffspark.operators import estimator
from ffspark.operators import gradient as gradient_module
from ffspark.operators.estimator import FeedForwardClassifier, FeedForwardModel
from ffspark.operators.evaluate import CostEvaluator
from ffspark.operators.fit_log import FitLog
from ffspark.operators.forward import layer_values
from ffspark.operators.long_form import dense_long, forward_long, sample_runs, values_runs
from ffspark.operators.sinks import next_run
from ffspark.sources.positions import PositionedSamples
from ffspark.sources.registry import ModelRegistry
from ffspark.sources.storage import claim, names_in, text_of
from test_network import LAYERS, data, frame

# stored samples


def test_stored_samples_keep_their_numbers(spark, tmp_path):
    """Rows that come in another order each time they are computed still have one number each, once stored."""
    shuffled = spark.range(0, 400, 1, 5).select(F.col("id").alias("k")).repartition(7).orderBy(F.rand())
    stored = PositionedSamples.write(shuffled, str(tmp_path / "s"))
    first = {r.sample_idx: r.k for r in stored.rows().collect()}
    spark.catalog.clearCache()
    again = PositionedSamples(spark, str(tmp_path / "s"))
    assert first == {r.sample_idx: r.k for r in again.rows().collect()} and sorted(first) == list(range(400)) and sorted(first.values()) == list(range(400))
    draws = spark.createDataFrame([(0, 3, 2), (0, 399, 1), (1, 3, 1)], "iter int, sample_idx long, mult long")
    got = sorted((r.iter, r.sample_idx, r.mult, r.k) for r in again.drawn(draws, 10).collect())
    assert got == [(0, 3, 2, first[3]), (0, 399, 1, first[399]), (1, 3, 1, first[3])]


@pytest.mark.parametrize("own", [True, False])
def test_a_draw_reads_only_its_files(spark, tmp_path, own):
    df = spark.range(0, 1000, 1, 20).select(*[F.col("id").alias("sample_idx")] * own, (F.col("id") * 2).alias("v"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    stored = PositionedSamples.write(df, str(tmp_path / "s"))
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert stored.n == 1000 and len(stored.files) >= 4
    draws = spark.createDataFrame([(0, k, 1) for k in (17, 18, 19)], "iter int, sample_idx long, mult long")
    drawn = stored.drawn(draws, 3)
    base = lambda files: {os.path.basename(f) for f in files}
    assert base(drawn.inputFiles()) == base(stored.files_of(np.array([17, 18, 19]))) and len(drawn.inputFiles()) <= 2
    assert {r.sample_idx: r.v for r in drawn.collect()} == {k: 2 * k for k in (17, 18, 19)}
    for name in os.listdir(tmp_path / "s/rows"):  # other files are never opened
        if name.startswith("part-") and not any(f.endswith(name) for f in drawn.inputFiles()):
            os.rename(tmp_path / "s/rows" / name, tmp_path / name)
    assert {r.sample_idx: r.v for r in stored.drawn(draws, 3).collect()} == {k: 2 * k for k in (17, 18, 19)}
    with pytest.raises(ValueError):
        stored.drawn(draws, 2)
    assert stored.drawn(draws.limit(0), 2).count() == 0


def test_stored_samples_reject(spark, tmp_path):
    for k, numbers in enumerate(([0, 1, 3], [0, 1, 1], [1, 2])):
        with pytest.raises(ValueError):
            PositionedSamples.write(spark.createDataFrame([(n,) for n in numbers], "sample_idx long"), str(tmp_path / str(k)))
    empty = PositionedSamples.write(spark.range(0).select(F.col("id").alias("v")), str(tmp_path / "e"))
    assert empty.n == 0 and empty.rows().count() == 0 and "sample_idx" in empty.rows().columns
    os.remove(tmp_path / "e/_complete")
    with pytest.raises(Exception):
        PositionedSamples(spark, str(tmp_path / "e"))


def test_prefetch_is_bounded(spark, monkeypatch):
    x, y = data()
    monkeypatch.setattr(estimator, "PREFETCH_TOTAL", 21)
    sizes = []
    real = PositionedSamples.drawn
    monkeypatch.setattr(PositionedSamples, "drawn", lambda self, draws, bound: sizes.append(draws.agg(F.sum("mult")).first()[0]) or real(self, draws, bound))
    model = FeedForwardClassifier(LAYERS, batch_size=7, fixed_iter=8, prefetch=100).fit(frame(spark, x, y))
    assert len(model.trace) == 8 and sizes == [21, 21, 14]
    one = FeedForwardClassifier(LAYERS, batch_size=7, fixed_iter=8, prefetch=0).fit(frame(spark, x, y))
    assert np.allclose(model.network.flat(), one.network.flat(), atol=1e-14)


# restart


@pytest.mark.parametrize("mode", ["batch", "mini_b", "stochastic"])
def test_a_stopped_fit_goes_on(spark, tmp_path, mode):
    x, y = data()
    df, path = frame(spark, x, y), str(tmp_path / "log")

    class Stop(Exception):
        pass

    def stop(k, *_):
        if k == 4:
            raise Stop

    settings = dict(layers=LAYERS, mode=mode, batch_size=7, seed=3, eta=0.1, log_every=2)
    whole = FeedForwardClassifier(**settings, fixed_iter=7).fit(df)
    with pytest.raises(Stop):
        FeedForwardClassifier(**settings, fixed_iter=7, log_to=path, progress=stop).fit(df)
    assert FitLog(spark, path).latest().iteration == 4
    os.makedirs(tmp_path / "log/step=6")  # a step that broke off: no mark of success
    (tmp_path / "log/step=6/part-0.parquet").write_bytes(b"half")
    resumed = FeedForwardClassifier(**settings, fixed_iter=7, log_to=path).fit(df)
    assert np.allclose(resumed.network.flat(), whole.network.flat(), atol=1e-14)
    assert np.allclose([t[:4] for t in resumed.trace], [t[:4] for t in whole.trace], atol=1e-14) and len(resumed.trace) == 7
    elapsed = [t[4] for t in resumed.trace]
    assert elapsed == sorted(elapsed)
    again = FeedForwardClassifier(**settings, fixed_iter=7, log_to=path).fit(df)
    assert np.array_equal(again.network.flat(), resumed.network.flat())
    with pytest.raises(ValueError):
        FeedForwardClassifier(**(settings | {"seed": 4}), fixed_iter=7, log_to=path).fit(df)
    assert len([n for n in names_in(spark, path) if n.startswith("step=")]) <= 2


def test_a_resumed_fit_keeps_its_numbers(spark, tmp_path):
    """Rows without numbers that come in another order each time: the second start finds those of the first."""
    x, y = data()
    df, path = frame(spark, x, y).drop("sample_idx").orderBy(F.rand()), str(tmp_path / "log")
    settings = dict(layers=LAYERS, batch_size=7, seed=3, log_every=2)
    os.makedirs(tmp_path / "log/samples/rows")  # a write that broke off
    (tmp_path / "log/samples/rows/part-0.parquet").write_bytes(b"half")
    FeedForwardClassifier(**settings, fixed_iter=2, log_to=path).fit(df)
    spark.catalog.clearCache()
    resumed = FeedForwardClassifier(**settings, fixed_iter=5, log_to=path).fit(df)
    numbered = PositionedSamples(spark, f"{path}/samples").rows()
    whole = FeedForwardClassifier(**settings, fixed_iter=5).fit(numbered)
    assert np.allclose(resumed.network.flat(), whole.network.flat(), atol=1e-14)


# live limits


def test_time_limit_and_live_progress(spark, monkeypatch):
    """No iteration begins after the limit, and progress comes while the fit goes on."""
    x, y = data()
    seen = []
    model = FeedForwardClassifier(LAYERS, batch_size=7, time_limit=6.0, progress=lambda k, *_: seen.append((k, time.time()))).fit(frame(spark, x, y))
    elapsed = [t[4] for t in model.trace]
    assert elapsed == sorted(elapsed) and elapsed[-1] >= 6.0 and sum(e >= 6.0 for e in elapsed) == 1
    assert [k for k, _ in seen] == list(range(len(model.trace)))
    assert seen[-1][1] - seen[0][1] > 1.0 and len({round(t, 1) for _, t in seen}) > 2
    monkeypatch.setattr(estimator, "PREFETCH_STEPS", 3)
    costs = [t[1] for t in FeedForwardClassifier(LAYERS, batch_size=7, fixed_iter=5, seed=1).fit(frame(spark, x, y)).trace]
    stopped = FeedForwardClassifier(LAYERS, batch_size=7, threshold=costs[3] * 1.0000001, seed=1).fit(frame(spark, x, y))
    first = next(k for k, c in enumerate(costs) if c <= costs[3] * 1.0000001)
    assert len(stopped.trace) == first + 1


# model selection and persistence


def test_parameters_copy_save_and_load(spark, tmp_path):
    x, y = data()
    df = frame(spark, x, y)
    est = FeedForwardClassifier([None, 4, None], mode="Batch", fixed_iter=3, eta=0.5, seed=2)
    assert {p.name for p in est.params} >= {"layers", "mode", "eta", "seed", "fixed_iter", "log_every"}
    other = est.copy({est.eta: 0.25})
    assert (est.get("eta"), other.get("eta")) == (0.5, 0.25) and other.uid == est.uid
    assert np.allclose(est.fit(df, {est.eta: 0.25}).network.flat(), other.fit(df).network.flat(), atol=1e-15)
    with pytest.raises(ValueError):
        est.fit(df, {est.mode: "newton"})
    with pytest.raises(TypeError):
        est.fit(df, {est.eta: "x"})
    est.write().overwrite().save(str(tmp_path / "est"))
    back = FeedForwardClassifier.load(str(tmp_path / "est"))
    assert back.uid == est.uid and {p.name: back.getOrDefault(p) for p in back.params} == {p.name: est.getOrDefault(p) for p in est.params}
    model = back.fit(df)
    model.save(str(tmp_path / "model"))
    loaded = FeedForwardModel.load(str(tmp_path / "model"))
    assert np.array_equal(loaded.network.flat(), model.network.flat()) and loaded.trace == model.trace and loaded.uid == model.uid and loaded.layers == [3, 4, 2]
    with pytest.raises(Exception):
        model.save(str(tmp_path / "model"))


def test_cross_validation(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(90, 3))
    y = np.stack([x[:, 0] > 0, x[:, 0] <= 0], axis=1).astype(float)
    df = frame(spark, x, y).drop("sample_idx")
    est = FeedForwardClassifier([None, 6, None], mode="batch", fixed_iter=6, seed=1)
    grid = ParamGridBuilder().addGrid(est.eta, [1e-6, 2.0]).build()
    done = CrossValidator(estimator=est, estimatorParamMaps=grid, evaluator=CostEvaluator(), numFolds=2, seed=5).fit(df)
    assert len(done.avgMetrics) == 2 and done.avgMetrics[1] < done.avgMetrics[0]
    assert np.allclose(done.bestModel.network.flat(), est.copy({est.eta: 2.0}).fit(df).network.flat(), atol=1e-12)
    cost = CostEvaluator().evaluate(done.bestModel.transform(df))
    assert np.isclose(cost, np.mean((y - layer_values(done.bestModel.network, x)[1][-1]) ** 2))


# commits and claims


def test_one_claim_wins(spark, tmp_path):
    with ThreadPoolExecutor(8) as pool:
        won = list(pool.map(lambda k: claim(spark, f"{tmp_path}/c/x", str(k)), range(32)))
    assert sum(won) == 1 and text_of(spark, f"{tmp_path}/c/x") == str(won.index(True))


def test_two_writers_get_two_versions(spark, tmp_path):
    reg = ModelRegistry(spark, str(tmp_path / "reg"))
    sets = [random_params([3, 4, 2], k) for k in range(6)]
    with ThreadPoolExecutor(6) as pool:
        versions = list(pool.map(lambda p: reg.save("m", p, overwrite=False, history=[(0, 0.5, 0.1, 0.5, 1.0)]), sets))
    assert sorted(versions) == [1, 2, 3, 4, 5, 6] == reg.versions("m")
    for p, v in zip(sets, versions, strict=True):
        assert np.array_equal(reg.load("m", v).flat(), p.flat())
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda p: reg.save("m", p, overwrite=3), sets[:4]))
    assert any(np.array_equal(reg.load("m", 3).flat(), p.flat()) for p in sets[:4]) and reg.histories().count() == 5
    reg.tidy("m")
    assert len(names_in(spark, f"{tmp_path}/reg/data/m/3")) == 1 and reg.params().select("version").distinct().count() == 6


def test_a_broken_save_is_never_seen(spark, tmp_path, monkeypatch):
    reg = ModelRegistry(spark, str(tmp_path / "reg"))
    a, b = random_params([3, 2], 1), random_params([3, 2], 2)
    reg.save("m", a)
    with pytest.raises(TypeError):
        reg.save("m", b, overwrite=False, history=[("no", "trace", "at", "all", "!")])  # params are written, then it breaks
    with pytest.raises(TypeError):
        reg.save("m", b, history=[("no", "trace", "at", "all", "!")])
    assert reg.versions("m") == [1] and np.array_equal(reg.load("m").flat(), a.flat()) and reg.params().select("version").distinct().count() == 1
    assert reg.save("m", b, overwrite=False) > 1


def test_two_runs_get_two_folders(spark, tmp_path):
    out = str(tmp_path / "out")
    with ThreadPoolExecutor(6) as pool:
        runs = list(pool.map(lambda _: next_run(spark, out, "m").rpartition("_")[2], range(6)))
    assert sorted(runs) == list("012345")
    os.makedirs(f"{out}/sorted_by_n_0")
    assert next_run(spark, out, "n").endswith("sorted_by_n_1") and next_run(spark, out, "m").endswith("_6")


# sums over many partitions


def test_sums_are_grouped_until_few_are_left(spark, monkeypatch):
    monkeypatch.setattr(gradient_module, "DIRECT_PARTIALS", 4)
    monkeypatch.setattr(gradient_module, "FAN_IN", 3)
    df = spark.range(0, 100, 1, 100)
    assert gradient_module.levels(df) == 3
    rows = df.select(F.col("id").cast("int").alias("part"), F.lit(1).cast("long").alias("n"), F.lit(0.5).alias("cost"), F.array(F.col("id").cast("double"), F.lit(1.0)).alias("grad"))
    got = gradient_module.summed_in_groups(rows, 3).collect()
    assert len(got) == 4 and sum(r.n for r in got) == 100 and sum(r.grad[0] for r in got) == 4950 and sum(r.grad[1] for r in got) == 100
    monkeypatch.undo()
    depth, parts = 0, 100_000
    while parts > gradient_module.DIRECT_PARTIALS:
        parts, depth = -(-parts // gradient_module.FAN_IN), depth + 1
    assert parts <= 256 and depth == 2


# long form


@pytest.mark.parametrize("block, rows", [(4, 5), (7, 1000), (256, 4096)])
def test_dense_long(spark, block, rows):
    """Layers wider and narrower than a tile, and ids that all share a remainder."""
    rng = np.random.default_rng(2)
    layers = [11, 17, 5]
    p, x = random_params(layers, 3), rng.normal(size=(23, 11))
    p.biases = [rng.normal(size=17), rng.normal(size=5)]
    df = spark.createDataFrame([(64 * k, list(map(float, v))) for k, v in enumerate(x)], "sample_id long, features array<double>")
    table = to_frame(spark, p)
    z = {(r.sample_id // 64, r.j): r.z for r in dense_long(sample_runs(df, block=block), table, 1, 23, block, rows).collect()}
    want = layer_values(p, x)[0][1]
    assert len(z) == 23 * 17 and all(np.isclose(z[k, j], want[k, j]) for k in range(23) for j in range(17))
    out = {(r.sample_id // 64, r.j): r.output for r in forward_long(df, table, block=block, rows=rows).collect()}
    want = layer_values(p, x)[1][-1]
    assert len(out) == 23 * 5 and all(np.isclose(out[k, j], want[k, j]) for k in range(23) for j in range(5))


def test_dense_long_edges(spark):
    p = fixed_params([3, 2])
    none = spark.createDataFrame([], "sample_id long, features array<double>")
    assert forward_long(none, to_frame(spark, p)).count() == 0
    values = spark.createDataFrame([(1, j, float(j)) for j in range(3)], "sample_id long, j int, v double")
    got = sorted((r.j, r.z) for r in dense_long(values_runs(values, "v", 2), to_frame(spark, p).where("kind = 'w'"), 1, 1, 2).collect())
    assert np.allclose([z for _, z in got], np.arange(3.0) @ p.weights[0])
    plan = dense_long(sample_runs(none), to_frame(spark, p), 1, 10)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert json.dumps(names_in(spark, "/no/such/folder")) == "[]"
