"""Dense layers as a relational matrix product: parameters stay a distributed table, however wide a layer is.

Samples and weights are cut into blocks: a sample's values into runs of ``block`` inputs, the weights into square tiles.
Runs and tiles meet by a join on the run's number, dealt to parts by sample, so a task holds one tile and a bounded slice
of samples; each pair gives a partial sum for every sample and output of the tile, and Spark adds these up.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ffspark.functions.activations import relu, sigmoid
from ffspark.operators.forward import matrix

#: Inputs and outputs of a tile, and samples that meet a tile in one task.
BLOCK, ROWS = 256, 4096


def sample_runs(samples: DataFrame, column: str = "features", block: int = BLOCK) -> DataFrame:
    """sample_id, bi, xs: each sample's values in runs of ``block``."""
    starts = F.sequence(F.lit(0), F.floor((F.size(column) - 1) / block).cast("int"))
    runs = F.transform(starts, lambda k: F.struct(k.alias("bi"), F.slice(F.col(column), k * block + 1, block).alias("xs")))
    return samples.select("sample_id", F.explode(runs).alias("r")).select("sample_id", "r.bi", "r.xs")


def values_runs(values: DataFrame, column: str, block: int = BLOCK) -> DataFrame:
    """The same from one row a value: sample_id, j and ``column``."""
    bi = F.floor(F.col("j") / block).cast("int")
    runs = values.groupBy("sample_id", bi.alias("bi")).agg(F.array_sort(F.collect_list(F.struct("j", F.col(column).alias("x")))).alias("r"))
    return runs.select("sample_id", "bi", F.transform("r", lambda r: r["x"]).alias("xs"))


def weight_tiles(params: DataFrame, layer: int, block: int = BLOCK) -> DataFrame:
    """bi, bj, ii, jj, ws: the weights of a layer of a parameter table, in tiles of places inside the tile and values."""
    own = params.where((F.col("layer") == layer) & (F.col("kind") == "w"))
    at = lambda c: F.floor(F.col(c) / block).cast("int")
    inside = F.collect_list(F.struct((F.col("i") % block).alias("i"), (F.col("j") % block).alias("j"), F.col("value").alias("w")))
    tiles = own.groupBy(at("i").alias("bi"), at("j").alias("bj")).agg(inside.alias("t"))
    return tiles.select("bi", "bj", F.col("t.i").alias("ii"), F.col("t.j").alias("jj"), F.col("t.w").alias("ws"))


def _product(left: pa.Table, right: pa.Table) -> pa.Table:
    """Partial sums of one slice of samples with one tile."""
    names = {"sample_id": pa.int64(), "bj": pa.int32(), "zs": pa.list_(pa.float64())}
    if not left.num_rows or not right.num_rows:
        return pa.table({k: pa.array([], t) for k, t in names.items()})
    x = matrix(left.column("xs").combine_chunks())
    ii, jj, ws = (np.array(right.column(c)[0].values) for c in ("ii", "jj", "ws"))
    w = np.zeros((x.shape[1], int(jj.max()) + 1))
    w[ii, jj] = ws
    z = x @ w
    offsets = pa.array(np.arange(0, z.size + 1, z.shape[1], dtype=np.int32))
    bj = pa.array(np.full(len(x), right.column("t_bj")[0].as_py(), np.int32))
    return pa.table({"sample_id": left.column("sample_id"), "bj": bj, "zs": pa.ListArray.from_arrays(offsets, pa.array(z.ravel()))})


def dense_long(runs: DataFrame, params: DataFrame, layer: int, n_samples: int, block: int = BLOCK, rows: int = ROWS) -> DataFrame:
    """sample_id, j, z: one dense layer without activation, for every sample and output.

    ``runs`` is from ``sample_runs`` or ``values_runs``; sample ids must be unique and not null, and ``params`` the table of
    one model, of which nothing comes to the driver. ``n_samples`` decides into how many parts the samples are dealt, so
    that a task meets about ``rows`` of them, whatever their ids; a tile is copied to each part. A layer whose table lacks
    a weight counts it as 0.
    """
    parts = max(1, -(-n_samples // rows))
    tiles = weight_tiles(params, layer, block)
    dealt = F.pmod(F.xxhash64("sample_id"), F.lit(parts)).cast("int")
    places = tiles.select("bi", "bj")
    left = runs.withColumn("part", dealt).join(places, "bi").select("part", "bi", "bj", "sample_id", F.col("xs").cast("array<double>").alias("xs"))
    right = tiles.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).select(F.col("part").alias("t_part"), F.col("bi").alias("t_bi"), F.col("bj").alias("t_bj"), "ii", "jj", "ws")
    partial = left.groupBy("part", "bi", "bj").cogroup(right.groupBy("t_part", "t_bi", "t_bj")).applyInArrow(_product, "sample_id long, bj int, zs array<double>")
    each = partial.select("sample_id", "bj", F.posexplode("zs").alias("k", "z")).select("sample_id", (F.col("bj") * block + F.col("k")).alias("j"), "z")
    biases = params.where((F.col("layer") == layer) & (F.col("kind") == "b")).select("j", F.col("value").alias("b"))
    summed = each.groupBy("sample_id", "j").agg(F.sum("z").alias("z"))
    return summed.join(biases, "j", "left").select("sample_id", "j", (F.col("z") + F.coalesce("b", F.lit(0.0))).alias("z"))


def forward_long(samples: DataFrame, params: DataFrame, column: str = "features", block: int = BLOCK, rows: int = ROWS) -> DataFrame:
    """sample_id, j, output: the whole forward pass in this form, ReLU on hidden layers and sigmoid on the last. The number
    of layers and of samples are two aggregates; no parameter reaches the driver or a broadcast variable of ours."""
    depth, n = params.agg(F.max("layer")).first()[0] or 0, samples.count()
    runs = sample_runs(samples.select("sample_id", column), column, block)
    for layer in range(1, depth + 1):
        z = dense_long(runs, params, layer, n, block, rows)
        out = z.select("sample_id", "j", (sigmoid("z") if layer == depth else relu("z")).alias("output"))
        runs = values_runs(out, "output", block) if layer < depth else runs
    return out
