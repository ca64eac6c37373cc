"""The registered queries of the core library and their DuckDB counterparts. Results are in long form: scalars only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ffspark.functions import activations as act
from ffspark.functions.params import Params, fixed_params, init_sigmas, to_frame
from ffspark.operators.draws import draw_rows
from ffspark.operators.estimator import FeedForwardClassifier, best_cost
from ffspark.operators.evaluate import class_counts, evaluation_cost
from ffspark.operators.forward import dense, transform
from ffspark.operators.gradient import mean_gradient, sample_gradients
from ffspark.operators.long_form import dense_long, forward_long, sample_runs
from ffspark.operators.sinks import classify, classify_with
from ffspark.plans import fixtures as fx
from ffspark.plans import oracle as sql
from ffspark.sources.registry import ModelRegistry, next_free_frame
from ffspark.sources.samples import sample_widths, violations
from ffspark.sources.storage import scratch_path
from ffspark.streaming.score import score_stream, write_scores

EMB, DEEP, LI, EV, DOC, SERIES = [64, 8, 10], [64, 6, 6, 10], [3, 5, 3], [3, 6, 5], [2, 4, 2], [30, 4, 2]
BATCH = 50


def r6(c) -> F.Column:
    return (F.round(c, 6) + F.lit(0.0)).alias("value")


def long_form(df: DataFrame, column: str, key: str = "sample_id", at: str = "j") -> DataFrame:
    return df.select(key, F.posexplode(column).alias(at, "v")).select(key, F.col(at).cast("int").alias(at), r6(F.col("v")))


def param_rows(spark: SparkSession, params: Params) -> DataFrame:
    return to_frame(spark, params).select("layer", "kind", "i", "j", r6(F.col("value")))


def draws(spark: SparkSession, n: int, batch: int, iterations: int) -> DataFrame:
    """The draws that the oracles use: arithmetic both engines share."""
    k = F.pmod(F.col("id"), F.lit(batch))
    it = F.floor(F.col("id") / batch)
    rows = spark.range(batch * iterations).select(it.cast("int").alias("iter"), ((7919 * it + 104729 * k + 13) % n).alias("sample_idx"))
    return rows.groupBy("iter", "sample_idx").agg(F.count(F.lit(1)).alias("mult"))


def indexed(df: DataFrame) -> DataFrame:
    """Sample ids of these tables are dense from 0, so they serve as draw index."""
    return df.withColumn("sample_idx", F.col("sample_id"))


# sources, validation


def q_samples_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return long_form(fx.embeddings(spark, sf_dir), "features", at="i").withColumn("part", F.lit("x")).unionByName(long_form(fx.embeddings(spark, sf_dir), "labels", at="i").withColumn("part", F.lit("y")))


def q_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that a network of widths 2 and 2 can't use, after nulls and wrong widths were put in by rule."""
    d = fx.documents(spark, sf_dir)
    bad = F.when(F.col("sample_id") % 11 == 0, F.lit(None)).when(F.col("sample_id") % 7 == 0, F.slice("features", 1, 1)).when(F.col("sample_id") % 5 == 0, F.array(F.lit(None).cast("double"), F.lit(1.0))).otherwise(F.col("features"))
    return violations(d.withColumn("features", bad), 2, 2).select("sample_id", "reason")


def q_widths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inputs and outputs of each layer of a fitted network whose ends were left to the data."""
    model = FeedForwardClassifier([None, 8, None], mode="batch", fixed_iter=1).fit(fx.embeddings(spark, sf_dir))
    rows = model.param_frame(spark).where("kind = 'w'").groupBy("layer")
    return rows.agg((F.max("i") + 1).alias("n_in"), (F.max("j") + 1).alias("n_out"))


# functions and forward pass


def q_relu_sigmoid(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("value") / 50 - 1
    t = fx.table(spark, sf_dir, "events").select("event_id", x.alias("x"))
    fs = {"relu": act.relu("x"), "relu_d": act.relu_derivative("x"), "sigmoid": act.sigmoid("x"), "sigmoid_d": act.sigmoid_derivative("x")}
    return t.select("event_id", *[(F.round(c, 6) + F.lit(0.0)).alias(k) for k, c in fs.items()])


def q_dense_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = fixed_params(EMB)
    return long_form(dense(fx.embeddings(spark, sf_dir).select("sample_id", "features"), p.weights[0], p.biases[0]), "z")


def _saved_params(spark: SparkSession) -> DataFrame:
    """The fixed parameters of the embeddings' network as a committed table of a registry."""
    reg = ModelRegistry(spark, scratch_path(spark, "registry"))
    reg.save("fixed", fixed_params(EMB))
    return reg.params("fixed")


def _long_rows(df: DataFrame, column: str) -> DataFrame:
    return df.select("sample_id", F.col("j").cast("int").alias("j"), r6(F.col(column)))


def q_dense_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dense layer whose weights stay a table, in tiles of 16 x 16."""
    d = fx.embeddings(spark, sf_dir).select("sample_id", "features")
    return _long_rows(dense_long(sample_runs(d, block=16), _saved_params(spark), 1, d.count(), block=16), "z")


def q_forward_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long_rows(forward_long(fx.embeddings(spark, sf_dir), _saved_params(spark)), "output")


def q_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    return long_form(transform(fx.embeddings(spark, sf_dir).select("sample_id", "features"), fixed_params(EMB)), "output")


def q_forward_expr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return long_form(transform(fx.events(spark, sf_dir).select("sample_id", "features"), fixed_params(EV), engine="expr"), "output")


def q_forward_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = transform(fx.embeddings(spark, sf_dir).select("sample_id", "features"), fixed_params(DEEP), layers="all").drop("features")
    d = d.select("sample_id", F.posexplode(F.arrays_zip("pre", "act")).alias("layer", "p")).where("layer > 0")
    d = d.select("sample_id", F.col("layer").cast("int").alias("layer"), F.posexplode(F.arrays_zip("p.pre", "p.act")).alias("j", "q"))
    return d.select("sample_id", "layer", F.col("j").cast("int").alias("j"), (F.round("q.pre", 6) + F.lit(0.0)).alias("pre"), (F.round("q.act", 6) + F.lit(0.0)).alias("act"))


def q_forward_upto(spark: SparkSession, sf_dir: str) -> DataFrame:
    return long_form(transform(fx.embeddings(spark, sf_dir).select("sample_id", "features"), fixed_params(DEEP), layers=3), "output")


def q_sample_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transform(fx.embeddings(spark, sf_dir), fixed_params(EMB)).select("sample_id", (F.round(act.sample_cost("labels", "output"), 6) + F.lit(0.0)).alias("cost"))


def q_eval_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation_cost(fx.lineitems(spark, sf_dir), fixed_params(LI)).select((F.round("cost", 6) + F.lit(0.0)).alias("cost"), "n")


# classes


def q_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written into class folders and read back."""
    done = classify(fx.embeddings(spark, sf_dir).select("sample_id", "features"), fixed_params(EMB), scratch_path(spark, "classify"))
    return done.scored.select("sample_id", "class")


def q_class_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = classify(fx.events(spark, sf_dir).select("sample_id", "features"), fixed_params(EV), scratch_path(spark, "classify"))
    return done.manifest.select("class", "n")


def q_class_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = transform(fx.embeddings(spark, sf_dir).select("features"), fixed_params(EMB)).select(act.class_of("output").alias("class"))
    return class_counts(d, EMB[-1])


# gradients


def q_gradient_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return param_rows(spark, mean_gradient(fx.lineitems(spark, sf_dir), fixed_params(LI)).grad)


def q_gradient_multihot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return param_rows(spark, mean_gradient(fx.documents(spark, sf_dir), fixed_params(DOC)).grad)


def q_gradient_minibatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = indexed(fx.embeddings(spark, sf_dir))
    return param_rows(spark, mean_gradient(draw_rows(d, draws(spark, d.count(), BATCH, 1), BATCH), fixed_params(EMB)).grad)


def q_gradient_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gradient of every sample by itself: cost and Euclidean length."""
    g = sample_gradients(fx.events(spark, sf_dir), fixed_params(EV))
    length = F.sqrt(F.aggregate("grad", F.lit(0.0), lambda s, v: s + v * v))
    return g.select("sample_id", (F.round("cost", 6) + F.lit(0.0)).alias("cost"), (F.round(length, 6) + F.lit(0.0)).alias("length"))


def q_gradient_each(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole gradient of every sample by itself."""
    g = sample_gradients(fx.documents(spark, sf_dir), fixed_params(DOC)).select("sample_id", F.posexplode("grad").alias("at", "v"))
    places, at = [], 0
    for l, (a, b) in enumerate(zip(DOC, DOC[1:]), 1):
        places += [(at + i * b + j, l, "w", i, j) for i in range(a) for j in range(b)] + [(at + a * b + j, l, "b", 0, j) for j in range(b)]
        at += a * b + b
    return g.join(spark.createDataFrame(places, "at int, layer int, kind string, i int, j int"), "at").select("sample_id", "layer", "kind", "i", "j", r6(F.col("v")))


# training


def _fit_batch(spark: SparkSession, sf_dir: str, iterations: int = 3):
    return FeedForwardClassifier(LI, mode="batch", fixed_iter=iterations, initial=fixed_params(LI)).fit(fx.lineitems(spark, sf_dir))


def _fit_drawn(spark: SparkSession, sf_dir: str, mode: str, iterations: int, **more: object):
    d = indexed(fx.embeddings(spark, sf_dir))
    size = BATCH if mode == "mini_b" else 1
    drawn = draws(spark, d.count(), size, iterations)
    return FeedForwardClassifier(EMB, mode=mode, fixed_iter=iterations, batch_size=size, initial=fixed_params(EMB), draws=drawn, **more).fit(d)


def q_fit_batch_3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return param_rows(spark, _fit_batch(spark, sf_dir).network)


def q_fit_minibatch_2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return param_rows(spark, _fit_drawn(spark, sf_dir, "mini_b", 2).network)


def q_fit_stochastic_3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return param_rows(spark, _fit_drawn(spark, sf_dir, "stochastic", 3).network)


def q_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = _fit_drawn(spark, sf_dir, "mini_b", 2, prefetch=0).history(spark)
    return h.select("iter", (F.round("cost", 6) + F.lit(0.0)).alias("cost"), (F.round("l_rate", 6) + F.lit(0.0)).alias("l_rate"))


def q_best_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = _fit_batch(spark, sf_dir).history(spark).select("iter", "cost", "l_rate")
    return h.select("iter", (F.round("cost", 6) + F.lit(0.0)).alias("cost"), (F.round(best_cost(), 6) + F.lit(0.0)).alias("best"), (F.round("l_rate", 6) + F.lit(0.0)).alias("l_rate"))


def q_fit_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stops at the first cost not above the threshold, which lies between the costs of iterations 1 and 2."""
    costs = [r.cost for r in _fit_batch(spark, sf_dir).history(spark).collect()]
    model = FeedForwardClassifier(LI, mode="batch", threshold=(costs[1] + costs[2]) / 2, initial=fixed_params(LI)).fit(fx.lineitems(spark, sf_dir))
    return model.history(spark).agg(F.count(F.lit(1)).alias("iterations"))


def q_fit_time_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What holds for any number of iterations that the time allows: numbers without gaps, the first cost, the best cost so
    far, and an end with the first iteration that passes the limit."""
    limit = 2.0
    h = FeedForwardClassifier(EV, mode="Batch", time_limit=limit, initial=fixed_params(EV)).fit(fx.events(spark, sf_dir)).history(spark)
    h = h.withColumn("running", best_cost())
    return h.agg(
        (F.max("iter") + 1 == F.count_distinct("iter")).alias("numbered"),
        (F.round(F.max(F.when(F.col("iter") == 0, F.col("cost"))), 6) + F.lit(0.0)).alias("first_cost"),
        F.bool_and(F.col("running") == F.col("best_cost")).alias("best_holds"),
        (F.max("elapsed_s") >= limit).alias("limit_reached"),
        (F.count_if(F.col("elapsed_s") >= limit) == 1).alias("one_beyond"),
    )


def q_fit_resumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fit that stopped after one iteration and goes on from its log to the second."""
    log = scratch_path(spark, "fit-log")
    _fit_drawn(spark, sf_dir, "mini_b", 1, log_to=log, log_every=1)
    return param_rows(spark, _fit_drawn(spark, sf_dir, "mini_b", 2, log_to=log, log_every=1).network)


SEED = 5


def q_fit_seeded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two iterations on seeded draws from rows that the library numbers itself, in the order of the table."""
    d = fx.embeddings(spark, sf_dir).coalesce(1).sortWithinPartitions("sample_id").drop("sample_id")
    return param_rows(spark, FeedForwardClassifier([None, 8, None], fixed_iter=2, batch_size=BATCH, seed=SEED, initial=fixed_params(EMB)).fit(d).network)


def q_init_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Initial standard deviation per layer of a network whose ends have the data's widths."""
    w = sample_widths(fx.embeddings(spark, sf_dir))
    layers = [w["features"][1], 8, 12, w["labels"][1]]
    return spark.createDataFrame([(l, float(s)) for l, s in enumerate(init_sigmas(layers), 1)], "layer int, sigma double").select("layer", (F.round("sigma", 6) + F.lit(0.0)).alias("sigma"))


# registry


def _registry(spark: SparkSession, sf_dir: str) -> ModelRegistry:
    """Versions 1 and 10 of a model fitted for one and for two iterations."""
    reg = ModelRegistry(spark, scratch_path(spark, "registry"))
    for version, iterations in ((1, 1), (10, 2)):
        reg.save("007", _fit_batch(spark, sf_dir, iterations).network, overwrite=version)
    return reg


def q_registry_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return param_rows(spark, _registry(spark, sf_dir).load("007"))


def q_registry_clear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Version 1 is cleared and 10 survives; a save without overwriting then becomes version 11."""
    reg = _registry(spark, sf_dir)
    reg.clear("007", [1])
    reg.save("007", reg.load("007"), overwrite=False)
    return reg.params().select("version", "layer", "kind", "i", "j", r6(F.col("value")))


def q_params_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Saved, exported as text, and read back from there."""
    reg = _registry(spark, sf_dir)
    path = scratch_path(spark, "text")
    reg.export_text("007", 1, path)
    back = spark.read.csv(path, header=True, schema="layer int, kind string, i int, j int, value double")
    return back.select("layer", "kind", "i", "j", r6(F.col("value")))


def q_next_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First free number among names made from order keys."""
    names = fx.table(spark, sf_dir, "orders").select(F.concat(F.lit("model"), F.when(F.col("o_orderkey") % 101 == 100, F.lit("X")).otherwise(F.col("o_orderkey").cast("string")), F.lit(".model")).alias("name"))
    return next_free_frame(names).select(F.col("k").cast("int").alias("k"))


def q_classify_saved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trained and saved in one call, loaded by name, and used for two runs, each in a folder of its own."""
    reg, out = ModelRegistry(spark, scratch_path(spark, "registry")), scratch_path(spark, "sorted")
    _fit_drawn(spark, sf_dir, "mini_b", 2, save_to=reg, model_name="007")
    d = fx.embeddings(spark, sf_dir).select("sample_id", "features")
    runs = [classify_with(reg, d, "007", out) for _ in range(2)]
    rows = [r.manifest.select(F.lit(r.path.rpartition("/")[2]).alias("run"), "class", "n") for r in runs]
    return rows[0].unionByName(rows[1])


# extensions


def q_stream_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream of files, scored and written, then read back."""
    landing, out = scratch_path(spark, "landing"), scratch_path(spark, "scores")
    fx.events(spark, sf_dir).select("sample_id", "features").write.parquet(landing)
    stream = spark.readStream.schema("sample_id long, features array<double>").parquet(landing)
    scored = score_stream(stream, fixed_params(EV)).select("sample_id", "class")
    write_scores(scored, out, scratch_path(spark, "stream-checkpoint")).awaitTermination()
    return spark.read.schema("sample_id long, class int").parquet(out).select("sample_id", "class")


def q_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return long_form(transform(fx.series(spark, sf_dir), fixed_params(SERIES)), "output")


QUERIES = [
    q_samples_long, q_validate, q_widths, q_relu_sigmoid, q_dense_layer, q_dense_long, q_forward, q_forward_long, q_forward_expr, q_forward_layers, q_forward_upto, q_sample_cost, q_eval_cost,
    q_classify, q_class_manifest, q_class_counts, q_gradient_batch, q_gradient_multihot, q_gradient_minibatch, q_gradient_one, q_gradient_each, q_fit_batch_3, q_fit_minibatch_2,
    q_fit_stochastic_3, q_history, q_best_cost, q_fit_threshold, q_fit_time_limit, q_fit_seeded, q_fit_resumed, q_init_scale, q_registry_latest, q_registry_clear, q_params_roundtrip, q_next_name,
    q_classify_saved, q_stream_scores, q_series,
]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


def _batch_fit(iterations: int) -> list[str]:
    parts = sql.samples("lineitems") + sql.fixed_params(LI)
    for k in range(iterations):
        parts += sql.gradient(LI, str(k)) + sql.momentum(LI, k)
    return parts


def _drawn_fit(iterations: int, batch: int, rule: Callable, seed: int | None = None) -> list[str]:
    parts, n = sql.samples("embeddings") + sql.fixed_params(EMB), "(SELECT count(*) FROM embeddings)"
    for k in range(iterations):
        parts += [sql.drawn(n, k, batch) if seed is None else sql.seeded(n, k, batch, seed), sql.drawn_samples(k)]
        parts += sql.gradient(EMB, str(k), f"x_{k}", f"y_{k}", f"m_{k}") + rule(EMB, k)
    return parts


def oracle_sql() -> dict[str, str]:
    r6 = sql.r6
    emb, ev = sql.samples("embeddings") + sql.fixed_params(EMB) + sql.forward(EMB), sql.samples("events") + sql.fixed_params(EV) + sql.forward(EV)
    deep = sql.samples("embeddings") + sql.fixed_params(DEEP) + sql.forward(DEEP)
    out = lambda a, extra="": f"SELECT sid AS sample_id, i::INT AS j, {r6('v')} AS value FROM {a} {extra}"
    top = lambda a: f"SELECT sid AS sample_id, first(i ORDER BY v DESC, i)::INT AS class FROM {a} GROUP BY sid"
    counts = lambda a, n: f"SELECT c::INT AS class, count(class)::BIGINT AS n FROM range({n}) t(c) LEFT JOIN ({top(a)}) s ON s.class = c GROUP BY 1"
    one = sql.gradient(EV)
    lengths = " UNION ALL ".join(
        x for l in (1, 2) for x in (f"SELECT d.sid, sum(p.v * p.v * d.v * d.v) AS s FROM {'x' if l == 1 else 'a1_0'} p JOIN d{l}_0 d ON p.sid = d.sid GROUP BY 1", f"SELECT sid, sum(v * v) FROM d{l}_0 GROUP BY 1")
    )
    series_x = f"x AS MATERIALIZED (SELECT u AS sid, d AS i, count(e.ts)::DOUBLE AS v FROM (SELECT DISTINCT user_id AS u FROM events WHERE ts >= DATE '{fx.FIRST_DAY}' AND ts < DATE '{fx.FIRST_DAY}' + {fx.DAYS}) CROSS JOIN range({fx.DAYS}) t(d) LEFT JOIN events e ON e.user_id = u AND e.ts::DATE = DATE '{fx.FIRST_DAY}' + d::INT GROUP BY 1, 2)"
    shifted = "value / 50 - 1"
    each = " UNION ALL ".join(
        x
        for l in (1, 2)
        for x in (
            f"SELECT d.sid AS sample_id, {l}::INT AS layer, 'w' AS kind, p.i::INT AS i, d.j::INT AS j, {r6('p.v * d.v')} AS value FROM {'x' if l == 1 else 'a1_0'} p JOIN d{l}_0 d ON p.sid = d.sid",
            f"SELECT sid, {l}::INT, 'b', 0::INT, j::INT, {r6('v')} FROM d{l}_0",
        )
    )
    return {
        "q_samples_long": sql.query(sql.samples("embeddings"), f"SELECT sid AS sample_id, i::INT AS i, {r6('v')} AS value, 'x' AS part FROM x UNION ALL SELECT sid, j::INT, {r6('v')}, 'y' FROM y"),
        "q_validate": """SELECT doc_id AS sample_id, CASE WHEN doc_id % 11 = 0 THEN 'features is null' WHEN doc_id % 7 = 0 THEN 'features has width 1, not 2' ELSE 'features has a null' END AS reason
            FROM documents SEMI JOIN labels USING (doc_id) WHERE doc_id % 11 = 0 OR doc_id % 7 = 0 OR doc_id % 5 = 0""",
        "q_widths": "SELECT l::INT AS layer, CASE l WHEN 1 THEN n ELSE 8 END::INT AS n_in, CASE l WHEN 1 THEN 8 ELSE 10 END::INT AS n_out FROM (SELECT max(len(embedding)) AS n FROM embeddings), range(1, 3) t(l)",
        "q_relu_sigmoid": f"""SELECT event_id, {r6('CASE WHEN x < 0 THEN 0.0 ELSE x END')} AS relu, {r6('CASE WHEN x < 0 THEN 0.0 ELSE 1.0::DOUBLE END')} AS relu_d, {r6('1 / (1 + exp(-x))')} AS sigmoid,
            {r6('1 / (1 + exp(-x)) * (1 - 1 / (1 + exp(-x)))')} AS sigmoid_d FROM (SELECT event_id, {shifted} AS x FROM events)""",
        "q_dense_layer": sql.query(emb, out("z1_0")),
        "q_dense_long": sql.query(emb, out("z1_0")),
        "q_forward": sql.query(emb, out("a2_0")),
        "q_forward_long": sql.query(emb, out("a2_0")),
        "q_forward_expr": sql.query(ev, out("a2_0")),
        "q_forward_layers": sql.query(deep, " UNION ALL ".join(f"SELECT z.sid AS sample_id, {l}::INT AS layer, z.i::INT AS j, {r6('z.v')} AS pre, {r6('a.v')} AS act FROM z{l}_0 z JOIN a{l}_0 a ON z.sid = a.sid AND z.i = a.i" for l in (1, 2, 3))),
        "q_forward_upto": sql.query(deep, out("a2_0")),
        "q_sample_cost": sql.query(emb, f"SELECT a.sid AS sample_id, {r6('sum((y.v - a.v) * (y.v - a.v))')} AS cost FROM a2_0 a JOIN y ON a.sid = y.sid AND a.i = y.j GROUP BY 1"),
        "q_eval_cost": sql.query(sql.samples("lineitems") + sql.fixed_params(LI) + sql.forward(LI), f"SELECT {r6('avg((y.v - a.v) * (y.v - a.v))')} AS cost, (SELECT count(*) FROM lineitem) AS n FROM a2_0 a JOIN y ON a.sid = y.sid AND a.i = y.j"),
        "q_classify": sql.query(emb, top("a2_0")),
        "q_class_manifest": sql.query(ev, counts("a2_0", EV[-1])),
        "q_class_counts": sql.query(emb, counts("a2_0", EMB[-1])),
        "q_gradient_batch": sql.query(sql.samples("lineitems") + sql.fixed_params(LI) + sql.gradient(LI), sql.param_rows(LI, 0, "g")),
        "q_gradient_multihot": sql.query(sql.samples("documents") + sql.fixed_params(DOC) + sql.gradient(DOC), sql.param_rows(DOC, 0, "g")),
        "q_gradient_minibatch": sql.query(_drawn_fit(1, BATCH, sql.rmsprop), sql.param_rows(EMB, 0, "g")),
        "q_gradient_one": sql.query(sql.samples("events") + sql.fixed_params(EV) + one, f"SELECT c.sid AS sample_id, {r6('c.cost')} AS cost, {r6('sqrt(s.s)')} AS length FROM (SELECT a.sid, sum((y.v - a.v) * (y.v - a.v)) AS cost FROM a2_0 a JOIN y ON a.sid = y.sid AND a.i = y.j GROUP BY 1) c JOIN (SELECT sid, sum(s) AS s FROM ({lengths}) GROUP BY 1) s ON s.sid = c.sid"),
        "q_gradient_each": sql.query(sql.samples("documents") + sql.fixed_params(DOC) + sql.gradient(DOC), each),
        "q_fit_batch_3": sql.query(_batch_fit(3), sql.param_rows(LI, 3)),
        "q_fit_minibatch_2": sql.query(_drawn_fit(2, BATCH, sql.rmsprop), sql.param_rows(EMB, 2)),
        "q_fit_resumed": sql.query(_drawn_fit(2, BATCH, sql.rmsprop), sql.param_rows(EMB, 2)),
        "q_fit_stochastic_3": sql.query(_drawn_fit(3, 1, sql.momentum), sql.param_rows(EMB, 3)),
        "q_history": sql.query(_drawn_fit(2, BATCH, sql.rmsprop), " UNION ALL ".join(f"SELECT {k}::INT AS iter, {r6(f'(SELECT v FROM cost_{k})')} AS cost, {r6(f'(SELECT v FROM rate_{k})')} AS l_rate" for k in range(2))),
        "q_best_cost": sql.query(_batch_fit(3), f"SELECT iter, {r6('cost')} AS cost, {r6('min(cost) OVER (ORDER BY iter)')} AS best, {r6('rate')} AS l_rate FROM (" + " UNION ALL ".join(f"SELECT {k}::INT AS iter, (SELECT v FROM cost_{k}) AS cost, (SELECT v FROM rate_{k}) AS rate" for k in range(3)) + ")"),
        "q_fit_threshold": sql.query(_batch_fit(3), "SELECT count(*) AS iterations FROM (SELECT * FROM cost_0 UNION ALL SELECT * FROM cost_1 UNION ALL SELECT * FROM cost_2) c WHERE c.v >= (SELECT v FROM cost_2)"),
        "q_fit_time_limit": sql.query(sql.samples("events") + sql.fixed_params(EV) + sql.gradient(EV), f"SELECT true AS numbered, (SELECT {r6('v')} FROM cost_0) AS first_cost, true AS best_holds, true AS limit_reached, true AS one_beyond"),
        "q_fit_seeded": sql.query(_drawn_fit(2, BATCH, sql.rmsprop, SEED), sql.param_rows(EMB, 2)),
        "q_classify_saved": sql.query(_drawn_fit(2, BATCH, sql.rmsprop) + sql.forward(EMB, "2"), f"SELECT 'sorted_by_007_' || k AS run, c.class, c.n FROM ({counts('a2_2', EMB[-1])}) c, range(2) t(k)"),
        "q_init_scale": "SELECT l::INT AS layer, round(CASE WHEN l < n[4] THEN 2 / sqrt(n[l] + n[l + 1]) ELSE sqrt(2 / (n[l] + n[l + 1])) END, 6) + 0.0 AS sigma FROM (SELECT [max(len(embedding))::DOUBLE, 8::DOUBLE, 12::DOUBLE, 10::DOUBLE] AS n FROM embeddings), range(1, 4) t(l)",
        "q_registry_latest": sql.query(_batch_fit(2), sql.param_rows(LI, 2)),
        "q_registry_clear": sql.query(_batch_fit(2), f"SELECT v::INT AS version, p.* FROM (SELECT unnest([10, 11]) AS v), ({sql.param_rows(LI, 2)}) p"),
        "q_params_roundtrip": sql.query(_batch_fit(1), sql.param_rows(LI, 1)),
        "q_next_name": """WITH u AS (SELECT DISTINCT o_orderkey AS k FROM orders WHERE o_orderkey % 101 <> 100) SELECT min(k)::INT AS k FROM (SELECT k + 1 AS k FROM u UNION ALL SELECT 0) t ANTI JOIN u USING (k)""",
        "q_stream_scores": sql.query(ev, top("a2_0")),
        "q_series": sql.query([series_x] + sql.fixed_params(SERIES) + sql.forward(SERIES), out("a2_0")),
    }
