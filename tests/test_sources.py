import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from ffspark.functions.params import fixed_params, random_params
from ffspark.operators.sinks import classify, classify_with, next_run
from ffspark.sources.registry import ModelRegistry, model_file_name, next_free
from ffspark.sources.samples import one_hot, read_samples, series_samples, validate_samples, violations, with_dense_index
from ffspark.streaming.score import score_stream, write_scores


def samples(spark, rows, kind="features array<double>, labels array<double>"):
    return spark.createDataFrame(rows, kind)


def test_read_samples_prunes(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([(1, 2.5, 3, "a", "long text")], "k int, x double, y int, c string, unused string").write.parquet(path)
    df = read_samples(spark.read.parquet(path), ["x", "y"], one_hot("c", ["a", "b"]), "k")
    assert df.first().asDict() == {"sample_id": 1, "features": [2.5, 3.0], "labels": [1.0, 0.0]}
    assert "unused" not in df._jdf.queryExecution().executedPlan().toString()


def test_validate(spark):
    good = samples(spark, [([1.0, float("nan")], [1.0]), ([2.0, float("inf")], [0.0])])
    assert validate_samples(good, 2, 1) == 2
    for rows, error in (
        ([], ValueError), ([(None, [1.0])], ValueError), ([([1.0, None], [1.0])], ValueError), ([([1.0], [1.0])], ValueError), ([([1.0, 2.0], [1.0, 2.0])], ValueError), ([([1.0, 2.0], None)], ValueError),
    ):
        with pytest.raises(error):
            validate_samples(samples(spark, rows), 2, 1)
    with pytest.raises(TypeError):
        validate_samples(spark.createDataFrame([("x",)], "features string"), 2)
    with pytest.raises(TypeError):
        validate_samples(good.drop("labels"), 2, 1)
    assert violations(good, 2, 1).count() == 0
    assert {r.reason for r in violations(samples(spark, [(None, [1.0]), ([1.0], [1.0]), ([1.0, None], [1.0]), ([1.0, 2.0], [])]), 2, 1).collect()} == {
        "features is null", "features has width 1, not 2", "features has a null", "labels has width 0, not 1",
    }


def test_dense_index(spark):
    df = spark.range(0, 100, 1, 7).select((F.col("id") * 3).alias("k"))
    got = with_dense_index(df).collect()
    assert {(r.k, r.sample_idx) for r in got} == {(3 * k, k) for k in range(100)}
    holes = with_dense_index(df.where("k < 30 OR k > 200")).collect()
    assert sorted(r.sample_idx for r in holes) == list(range(len(holes))) and [r.k for r in sorted(holes, key=lambda r: r.sample_idx)] == sorted(r.k for r in holes)
    assert with_dense_index(df.limit(0)).count() == 0


def test_series(spark):
    rows = [(1, "2024-01-01 03:00:00"), (1, "2024-01-01 05:00:00"), (1, "2024-01-03 00:00:00"), (2, "2024-02-01 00:00:00")]
    df = spark.createDataFrame(rows, "u int, t string").withColumn("t", F.to_timestamp("t"))
    got = {r.sample_id: r.features for r in series_samples(df, "u", "t", "2024-01-01", 3).collect()}
    assert got == {1: [2.0, 0.0, 1.0]}


def test_series_filter_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "events")
    spark.sql("SELECT 1 AS u, TIMESTAMP_NTZ '2024-01-02 00:00:00' AS t, 'x' AS unused").write.parquet(path)
    plan = series_samples(spark.read.parquet(path), "u", "t", "2024-01-01", 3)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(t" in plan and "LessThan(t" in plan and "unused" not in plan


def test_names(spark):
    names = spark.createDataFrame([("model0.model",), ("model1.model",), ("model3.model",), ("modelX.model",), ("model02.model.bak",)], "name string")
    assert next_free(names) == 2 and model_file_name(None, names) == "model2.model"
    assert model_file_name("a") == "a.model" and model_file_name("a.model") == "a.model" and model_file_name(None) == "model0.model"
    assert next_free(names.limit(0)) == 0


def test_registry(spark, tmp_path):
    reg = ModelRegistry(spark, str(tmp_path / "reg"))
    assert reg.current_version("007") == 0 and reg.next_name() == "model0.model"
    with pytest.raises(ValueError):
        reg.load("007")
    a, b = random_params([3, 4, 2], 1), random_params([3, 4, 2], 2)
    assert reg.save("007", a, history=[(0, 0.5, 0.1, 0.5, 1.0)]) == 1
    assert reg.save("007", b, overwrite=10) == 10
    assert reg.save("other", a, overwrite=False) == 1
    assert np.array_equal(reg.load("007").flat(), b.flat()) and np.array_equal(reg.load("007", 1).flat(), a.flat())
    assert reg.save("007", a) == 10 and np.array_equal(reg.load("007", 10).flat(), a.flat())
    assert reg.save("007", b, overwrite=False) == 11
    assert reg.architecture("007", 11) == [3, 4, 2]
    reg.clear("007", [1])
    assert {r.version for r in reg.params().where("model = '007'").select("version").distinct().collect()} == {10, 11}
    assert reg.histories().count() == 0 and reg.current_version("other") == 1
    with pytest.raises(ValueError):
        reg.load("007", 1)
    reg.export_text("007", 10, str(tmp_path / "text"))
    assert spark.read.csv(str(tmp_path / "text"), header=True).count() == 26
    odd = "a/b=c d%"
    reg.save(odd, a, overwrite=3)
    before = {f: os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(tmp_path / "reg") for f in fs if "other" in d}
    reg.clear(odd, [3, 4])
    assert reg.current_version(odd) == 0
    assert before == {f: os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(tmp_path / "reg") for f in fs if "other" in d}
    reg.clear("007")
    assert reg.current_version("007") == 0 and reg.current_version("other") == 1
    with pytest.raises(TypeError):
        reg.save("x", a, overwrite="yes")


def test_classify(spark, tmp_path):
    layers, out = [3, 4, 5], str(tmp_path / "out")
    p = fixed_params(layers)
    df = spark.range(50).select(F.col("id").alias("sample_id"), F.array(*[F.sin(F.col("id") * k) for k in (1, 2, 3)]).alias("features"))
    done = classify(df, p, out, "m")
    assert done.path.endswith("sorted_by_m_0") and done.scored.count() == 50
    counts = {r["class"]: r.n for r in done.manifest.collect()}
    assert len(counts) == 5 and sum(counts.values()) == 50
    folders = {d for d in os.listdir(f"{done.path}/rows") if d.startswith("class=")}
    assert folders == {f"class={k}" for k, n in counts.items() if n}
    reg = ModelRegistry(spark, str(tmp_path / "reg"))
    reg.save("m", p)
    assert classify_with(reg, df, "m", out).path.endswith("sorted_by_m_1")
    assert next_run(spark, out, "m").endswith("sorted_by_m_2")
    with pytest.raises(ValueError):
        classify(df, fixed_params([4, 2]), out)


def test_stream(spark, tmp_path):
    layers = [3, 4, 5]
    df = spark.range(60).select(F.col("id").alias("sample_id"), F.array(*[F.sin(F.col("id") * k) for k in (1, 2, 3)]).alias("features"))
    df.repartition(5).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    write_scores(score_stream(stream, fixed_params(layers)), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    batch = {(r.sample_id, r["class"]) for r in score_stream(df, fixed_params(layers)).collect()}
    assert {(r.sample_id, r["class"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == batch
