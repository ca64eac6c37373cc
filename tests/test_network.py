"""Operators against a per-sample NumPy version of the formulas, and their properties."""

import math

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ffspark.functions import activations as act
from ffspark.functions.params import fixed_params, from_frame, init_sigmas, random_params, to_frame, unflatten, zeros
from ffspark.operators import gradient as gradient_module
from ffspark.operators.estimator import FeedForwardClassifier, best_cost
from ffspark.operators.evaluate import class_counts, evaluation_cost
from ffspark.operators.forward import layer_values, transform
from ffspark.operators.gradient import mean_gradient, sample_gradients
from ffspark.operators.optim import Momentum, RMSprop
from ffspark.sources.registry import ModelRegistry

LAYERS = [3, 5, 4, 2]


def data(n=40, seed=3, layers=LAYERS):
    rng = np.random.default_rng(seed)
    return rng.normal(size=(n, layers[0])), rng.random((n, layers[-1]))


def frame(spark, x, y=None, parts=3):
    rows = [(k, k, list(map(float, x[k])), *([list(map(float, y[k]))] if y is not None else [])) for k in range(len(x))]
    names = "sample_id long, sample_idx long, features array<double>" + (", labels array<double>" if y is not None else "")
    return spark.createDataFrame(rows, names).repartition(parts, "sample_id")


def one_forward(p, x):
    pre, out = [x], [x]
    for l, (w, b) in enumerate(zip(p.weights, p.biases)):
        z = np.array([sum(out[-1][i] * w[i, j] for i in range(w.shape[0])) + b[j] for j in range(w.shape[1])])
        pre.append(z)
        out.append(np.array([1 / (1 + math.exp(-v)) if l == len(p.weights) - 1 else max(v, 0.0) for v in z]))
    return pre, out


def one_gradient(p, x, y):
    pre, out = one_forward(p, x)
    d = out[-1] * (1 - out[-1]) * (out[-1] - y)
    gw, gb = [], []
    for l in range(len(p.weights) - 1, -1, -1):
        gw.insert(0, np.outer(out[l], d))
        gb.insert(0, d)
        if l:
            d = (p.weights[l] @ d) * np.where(pre[l] < 0, 0.0, 1.0)
    return gw, gb, float(((y - out[-1]) ** 2).sum())


def test_activation_edges(spark):
    x = [-1.0, -0.0, 0.0, 1.0, float("nan"), -1000.0, 1000.0, None]
    df = spark.createDataFrame([(k, v) for k, v in enumerate(x)], "k int, x double")
    rows = df.select("k", act.relu("x").alias("r"), act.relu_derivative("x").alias("d"), act.sigmoid("x").alias("s")).orderBy("k").collect()
    assert [r.r for r in rows[:4]] == [0.0, 0.0, 0.0, 1.0] and math.isnan(rows[4].r) and rows[7].r is None
    assert [r.d for r in rows] == [0.0, 1.0, 1.0, 1.0, 1.0, 0.0, 1.0, None]
    assert rows[5].s == 0.0 and rows[6].s == 1.0


def test_class_edges(spark):
    rows = [([0.5, 0.5, 0.1],), ([0.1, float("nan"), 0.9],), ([0.0, -0.0],), ([0.2, 0.9],)]
    got = [r.c for r in spark.createDataFrame(rows, "o array<double>").select(act.class_of("o").alias("c")).collect()]
    assert got == [0, 1, 0, 1]


@pytest.mark.parametrize("engine", ["arrow", "expr"])
@pytest.mark.parametrize("parts", [1, 60])
def test_forward(spark, engine, parts):
    x, _ = data()
    p = fixed_params(LAYERS)
    rows = transform(frame(spark, x, parts=parts), p, engine=engine).collect()
    for r in rows:
        assert np.allclose(r.output, one_forward(p, x[r.sample_id])[1][-1], atol=1e-12)
    deep = transform(frame(spark, x), p, layers="all", engine=engine).collect()
    for r in deep:
        pre, out = one_forward(p, x[r.sample_id])
        assert all(np.allclose(a, b) for a, b in zip(r.pre, pre)) and all(np.allclose(a, b) for a, b in zip(r.act, out))
    for k in range(len(LAYERS) + 1):
        for r in transform(frame(spark, x), p, layers=k, engine=engine).collect():
            assert np.allclose(r.output, one_forward(p, x[r.sample_id])[1][max(0, k - 1)])


def test_forward_rejects(spark):
    df = frame(spark, data()[0])
    with pytest.raises(TypeError):
        transform(df, fixed_params(LAYERS), layers=True)
    with pytest.raises(ValueError):
        transform(df, fixed_params(LAYERS), layers=9)
    with pytest.raises(ValueError):
        transform(df, fixed_params(LAYERS), engine="gpu")


@pytest.mark.parametrize("parts", [1, 7, 50])
def test_gradient(spark, parts):
    x, y = data()
    p = fixed_params(LAYERS)
    g = mean_gradient(frame(spark, x, y, parts), p)
    each = [one_gradient(p, a, b) for a, b in zip(x, y)]
    for l in range(len(p.weights)):
        assert np.allclose(g.grad.weights[l], np.mean([e[0][l] for e in each], axis=0), atol=1e-14)
        assert np.allclose(g.grad.biases[l], np.mean([e[1][l] for e in each], axis=0), atol=1e-14)
    assert g.n == len(x) and np.isclose(g.cost, np.mean([e[2] for e in each]) / LAYERS[-1])
    for r in sample_gradients(frame(spark, x, y, parts), p).collect():
        gw, gb, cost = each[r.sample_id]
        assert np.allclose(r.grad, np.concatenate([v.ravel() for pair in zip(gw, gb) for v in pair])) and np.isclose(r.cost, cost)


def test_two_level_combine(spark, monkeypatch):
    x, y = data()
    p = fixed_params(LAYERS)
    plain = mean_gradient(frame(spark, x, y, 9), p, wide=False)
    assert not gradient_module.is_wide(frame(spark, x, y, 9))
    monkeypatch.setattr(gradient_module, "DIRECT_PARTIALS", 2)
    monkeypatch.setattr(gradient_module, "FAN_IN", 3)
    assert gradient_module.is_wide(frame(spark, x, y, 9))
    again = mean_gradient(frame(spark, x, y, 9), p)
    assert np.allclose(plain.grad.flat(), again.grad.flat(), atol=1e-15) and again.n == plain.n


def test_gradient_is_the_finite_difference(spark):
    x, y = data(12)
    p = fixed_params(LAYERS)
    flat = p.flat()
    g = mean_gradient(frame(spark, x, y), p).grad.flat()

    def half_cost(v):
        return sum(((b - layer_values(unflatten(v, LAYERS), a[None])[1][-1][0]) ** 2).sum() for a, b in zip(x, y)) / 2 / len(x)

    for k in range(0, len(flat), 5):
        e = np.zeros_like(flat)
        e[k] = 1e-6
        assert abs((half_cost(flat + e) - half_cost(flat - e)) / 2e-6 - g[k]) < 1e-7


def test_every_row_drawn_once_is_the_batch_gradient(spark):
    x, y = data()
    p = fixed_params(LAYERS)
    df = frame(spark, x, y)
    assert np.allclose(mean_gradient(df.withColumn("mult", F.lit(1)), p).grad.flat(), mean_gradient(df, p).grad.flat(), atol=1e-15)
    twice = mean_gradient(df.withColumn("mult", F.when(F.col("sample_id") == 0, 3).otherwise(1)), p)
    assert twice.n == len(x) + 2


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(parts=st.integers(1, 12), seed=st.integers(0, 99))
def test_partitions_do_not_matter(spark, parts, seed):
    x, y = data(15, seed)
    p = random_params(LAYERS, seed)
    a, b = mean_gradient(frame(spark, x, y, parts), p), mean_gradient(frame(spark, x, y, 1), p)
    assert np.allclose(a.grad.flat(), b.grad.flat(), atol=1e-13) and np.isclose(a.cost, b.cost)


def test_update_rules():
    rng = np.random.default_rng(1)
    g = unflatten(rng.normal(size=len(zeros(LAYERS).flat())), LAYERS)
    p, rule = fixed_params(LAYERS), Momentum(LAYERS, eta=0.1)
    before = p.flat()
    rule.step(p, g)
    assert np.allclose(p.flat(), before - 0.1 * g.flat())
    rate = rule.step(p, g)
    assert np.allclose(p.flat(), before - 0.1 * g.flat() - 0.19 * g.flat())
    assert np.isclose(rate, np.mean([np.mean((0.1 * w + 0.9 * 0.19 * w) / (w + 1e-4)) for w in g.weights]))
    p, rule = fixed_params(LAYERS), RMSprop(LAYERS)
    rate = rule.step(p, g)
    r = 0.1 * g.flat() ** 2
    assert np.allclose(p.flat(), before - 0.001 / (np.sqrt(r) + 0.001) * g.flat())
    assert np.isclose(rate, np.mean([np.mean(0.001 / (np.sqrt(0.1) * abs(w) + 1e-5)) for w in g.weights]))


@pytest.mark.parametrize("mode", ["mini_b", "stochastic"])
def test_prefetch_equals_single_steps(spark, mode):
    x, y = data()
    df = frame(spark, x, y)
    fit = lambda ahead: FeedForwardClassifier(LAYERS, mode=mode, batch_size=7, fixed_iter=5, seed=4, prefetch=ahead).fit(df)
    one, many = fit(0), fit(3)
    assert np.allclose(one.network.flat(), many.network.flat(), atol=1e-14)
    assert np.allclose([t[1:4] for t in one.trace], [t[1:4] for t in many.trace])


def test_rows_without_index_and_saving(spark, tmp_path):
    """Rows that the library numbers itself give what given numbers give; the fit saves what it returns."""
    x, y = data()
    df = frame(spark, x, y, 1).orderBy("sample_id").coalesce(1)
    reg = ModelRegistry(spark, str(tmp_path / "reg"))
    fit = lambda d, **more: FeedForwardClassifier(LAYERS, batch_size=7, fixed_iter=3, seed=4, **more).fit(d)
    own, given = fit(df.drop("sample_idx"), save_to=reg, model_name="m"), fit(df)
    assert np.allclose(own.network.flat(), given.network.flat(), atol=1e-14)
    assert np.array_equal(reg.load("m").flat(), own.network.flat()) and reg.histories().count() == 3
    assert not spark.sparkContext._jsc.getPersistentRDDs()


def test_many_given_draws_take_a_job_each(spark, monkeypatch):
    from ffspark.operators import estimator

    x, y = data()
    df = frame(spark, x, y)
    drawn = spark.createDataFrame([(it, k, 1 + k % 2) for it in range(2) for k in range(40)], "iter int, sample_idx long, mult long")
    fit = lambda: FeedForwardClassifier(LAYERS, batch_size=60, fixed_iter=2, draws=drawn, initial=fixed_params(LAYERS)).fit(df).network.flat()
    together = fit()
    monkeypatch.setattr(estimator, "PREFETCH_TOTAL", 70)
    assert np.allclose(fit(), together, atol=1e-14)


def test_slices_of_sample_gradients(spark, monkeypatch):
    x, y = data()
    p = fixed_params(LAYERS)
    want = {r.sample_id: r.grad for r in sample_gradients(frame(spark, x, y), p).collect()}
    monkeypatch.setattr(gradient_module, "SLICE_BYTES", 8 * len(p.flat()) * 3)
    got = {r.sample_id: r.grad for r in sample_gradients(frame(spark, x, y), p).collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k], atol=1e-14) for k in want)


def test_fit_lowers_the_cost_and_keeps_history(spark):
    x, y = data()
    seen = []
    model = FeedForwardClassifier([None, 4, None], mode="Batch", fixed_iter=6, eta=0.5, seed=2, progress=lambda *a: seen.append(a)).fit(frame(spark, x, y))
    assert model.layers == [3, 4, 2] and model.trace[-1][1] < model.trace[0][1] and len(seen) == 6
    h = model.history(spark).withColumn("best", best_cost()).collect()
    assert all(r.best == r.best_cost for r in h)
    scored = model.transform(frame(spark, x)).select("class", "output").collect()
    assert all(r["class"] == int(np.argmax(r.output)) for r in scored)


def test_stop_rules(spark):
    x, y = data()
    df = frame(spark, x, y)
    costs = [t[1] for t in FeedForwardClassifier(LAYERS, mode="batch", fixed_iter=4, eta=0.5, initial=fixed_params(LAYERS)).fit(df).trace]
    for prefetch in (0, 2):
        got = FeedForwardClassifier(LAYERS, mode="batch", threshold=(costs[1] + costs[2]) / 2, eta=0.5, initial=fixed_params(LAYERS), prefetch=prefetch).fit(df).trace
        assert len(got) == 3
    stopped = FeedForwardClassifier(LAYERS, mode="stochastic", threshold=900, time_limit=60, prefetch=10).fit(df)
    assert len(stopped.trace) == 1
    assert 1 <= len(FeedForwardClassifier(LAYERS, mode="batch", time_limit=0.01).fit(df).trace) <= 2


@pytest.mark.parametrize(
    "bad, error",
    [
        (dict(mode="newton"), ValueError), (dict(batch_size=0), ValueError), (dict(batch_size=1.5), TypeError), (dict(eta="x"), TypeError), (dict(eta=-1), ValueError),
        (dict(threshold=0), ValueError), (dict(fixed_iter=-1), ValueError), (dict(time_limit=True), TypeError), (dict(fixed_iter=0), ValueError), (dict(layers=[3]), ValueError),
        (dict(layers=[3, None, 2]), ValueError), (dict(layers="3,2"), TypeError), (dict(layers=[3, 0]), ValueError), (dict(layers=[3, 2.5]), TypeError),
    ],
)
def test_parameter_checks(spark, bad, error):
    with pytest.raises(error):
        FeedForwardClassifier(**({"layers": LAYERS, "fixed_iter": 1} | bad))


def test_both_spellings_and_unknown_keywords(spark):
    for mode in ("Mini Batch", "Mini batch", "mini_b", "Stochastic", "Batch"):
        FeedForwardClassifier(LAYERS, mode=mode, fixed_iter=1, live_monitor=True)
    with pytest.raises(ValueError):
        FeedForwardClassifier(LAYERS)


def test_init():
    assert np.allclose(init_sigmas([64, 8, 12, 3]), [2 / np.sqrt(72), 2 / np.sqrt(20), np.sqrt(2 / 15)])
    p = random_params([400, 300, 5], 1)
    assert abs(p.weights[0].std() - 2 / np.sqrt(700)) < 1e-3 and not p.biases[0].any()
    assert np.array_equal(random_params([4, 3], 1, [np.ones(3)]).biases[0], np.ones(3))
    assert np.array_equal(random_params([4, 3], 5).flat(), random_params([4, 3], 5).flat())


def test_param_frame_round_trip(spark):
    p = random_params(LAYERS, 9)
    back = from_frame(to_frame(spark, p))
    assert back.layers == LAYERS and np.array_equal(back.flat(), p.flat())


def test_evaluation(spark):
    x, y = data()
    p = fixed_params(LAYERS)
    row = evaluation_cost(frame(spark, x, y), p).first()
    assert np.isclose(row.cost, np.mean([(b - one_forward(p, a)[1][-1]) ** 2 for a, b in zip(x, y)])) and row.n == len(x)
    counts = {r["class"]: r.n for r in class_counts(spark.createDataFrame([(1,), (1,)], "class int"), 3).collect()}
    assert counts == {0: 0, 1: 2, 2: 0}
