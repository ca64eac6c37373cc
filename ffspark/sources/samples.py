"""Sample frames: sample_id, features array<double>, optionally labels array<double>."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _vector(x: str | Column | Sequence[str | Column]) -> Column:
    if isinstance(x, Column):
        return x.cast("array<double>")
    if isinstance(x, str):
        return F.col(x).cast("array<double>")
    return F.array(*[(F.col(c) if isinstance(c, str) else c).cast("double") for c in x])


def read_samples(df: DataFrame, features: str | Column | Sequence, labels: str | Column | Sequence | None = None, sample_id: str | Column | None = None) -> DataFrame:
    """Samples from an array column or from scalar columns. All other columns are pruned, also at the scan."""
    key = [] if sample_id is None else [(F.col(sample_id) if isinstance(sample_id, str) else sample_id).cast("long").alias("sample_id")]
    target = [] if labels is None else [_vector(labels).alias("labels")]
    return df.select(*key, _vector(features).alias("features"), *target)


def one_hot(category: str | Column, values: Sequence) -> Column:
    """1.0 at the place of the row's value, 0.0 elsewhere; all 0.0 for other values and null."""
    c = F.col(category) if isinstance(category, str) else category
    return F.array(*[F.coalesce((c == v).cast("double"), F.lit(0.0)) for v in values])


def violations(df: DataFrame, n_in: int, n_out: int | None = None) -> DataFrame:
    """The rows that no network of these widths can use, with the reason. NaN and infinities are allowed."""
    checks = [("features", n_in)] + ([("labels", n_out)] if n_out is not None else [])
    reason = F.lit(None).cast("string")
    for name, width in reversed(checks):
        c = F.col(name)
        reason = (
            F.when(c.isNull(), f"{name} is null")
            .when(F.size(c) != width, F.concat(F.lit(f"{name} has width "), F.size(c).cast("string"), F.lit(f", not {width}")))
            .when(F.exists(c, lambda v: v.isNull()), f"{name} has a null")
            .otherwise(reason)
        )
    return df.withColumn("reason", reason).where("reason IS NOT NULL")


def sample_widths(df: DataFrame) -> dict[str, tuple[int, int]]:
    """Smallest and largest width of each vector column, in one aggregate."""
    names = [c for c in ("features", "labels") if c in df.columns]
    row = df.agg(*[f(F.size(c)).alias(f"{k}_{c}") for c in names for k, f in (("lo", F.min), ("hi", F.max))]).first()
    return {c: (row[f"lo_{c}"], row[f"hi_{c}"]) for c in names}


def validate_samples(df: DataFrame, n_in: int, n_out: int | None = None) -> int:
    """Number of samples, after one aggregate over all of them. TypeError if a column is no numeric array; ValueError
    for an empty set, a null vector or element, or a wrong width."""
    names = ["features"] + (["labels"] if n_out is not None else [])
    kinds = dict(df.dtypes)
    for c in names:
        if c not in kinds:
            raise TypeError(f"no column {c}")
        if kinds[c] not in ("array<double>", "array<float>", "array<int>", "array<bigint>"):
            raise TypeError(f"{c} must be a numeric array, not {kinds[c]}")
    parts = [F.count(F.lit(1)).alias("n")]
    for c in names:
        parts += [F.min(F.size(c)).alias(f"lo_{c}"), F.max(F.size(c)).alias(f"hi_{c}"), F.count_if(F.col(c).isNull()).alias(f"null_{c}"), F.count_if(F.exists(c, lambda v: v.isNull())).alias(f"holes_{c}")]
    row = df.agg(*parts).first()
    if not row["n"]:
        raise ValueError("the sample set is empty")
    for c, width in zip(names, (n_in, n_out)):
        if row[f"null_{c}"] or row[f"holes_{c}"]:
            raise ValueError(f"{row[f'null_{c}']} null {c}, {row[f'holes_{c}']} {c} with a null element")
        if row[f"lo_{c}"] != width or row[f"hi_{c}"] != width:
            raise ValueError(f"{c} must have width {width}; found {row[f'lo_{c}']} to {row[f'hi_{c}']}")
    return row["n"]


def with_row_place(df: DataFrame, name: str) -> DataFrame:
    """Rows with their partition's number in the upper bits and their place in it in the lower 33. Persist the result: the
    places are those of the moment at which a partition is computed."""
    return df.withColumn(name, F.monotonically_increasing_id())


def dense_index(placed: DataFrame, place: str, name: str = "sample_idx") -> DataFrame:
    """``placed`` (see ``with_row_place``) numbered from 0 without gaps, in order of partition and place, as column ``name``
    instead of ``place``. One aggregate counts the rows of each partition; their first numbers, one row a partition, go
    back to the tasks."""
    part = F.shiftright(place, 33)
    sizes = sorted(placed.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect())
    firsts, at = [], 0
    for p, n in sizes:
        firsts.append((p, at - (p << 33)))
        at += n
    table = placed.sparkSession.createDataFrame(firsts, "__part long, __first long")
    numbered = placed.join(F.broadcast(table), part == F.col("__part"))
    return numbered.withColumn(name, F.col(place) + F.col("__first")).drop(place, "__part", "__first")


def with_dense_index(df: DataFrame, name: str = "sample_idx") -> DataFrame:
    """Rows numbered from 0 without gaps. ``df`` should be persisted or a stable scan: its partitions are gone through
    twice and both times must be the same."""
    return dense_index(with_row_place(df, "__place"), "__place", name)


def series_samples(events: DataFrame, key: str, time: str, first_day: str, days: int, features_from: Column | None = None) -> DataFrame:
    """One sample per key: a fixed-width series of daily counts (or sums of ``features_from``), zeros where no event
    fell. Two aggregations, the first with partial sums, so a busy key is no hot spot. The time span is a filter on the
    column itself, so it reaches the scan."""
    kind = events.schema[time].dataType
    start = date.fromisoformat(first_day)
    inside = (F.col(time) >= F.lit(start.isoformat()).cast(kind)) & (F.col(time) < F.lit((start + timedelta(days=days)).isoformat()).cast(kind))
    day = F.datediff(F.to_date(time), F.to_date(F.lit(first_day)))
    value = F.count(F.lit(1)).cast("double") if features_from is None else F.sum(features_from.cast("double"))
    daily = events.where(inside).groupBy(F.col(key).cast("long").alias("sample_id"), day.alias("day")).agg(value.alias("v"))
    packed = daily.groupBy("sample_id").agg(F.map_from_entries(F.collect_list(F.struct("day", "v"))).alias("m"))
    return packed.select("sample_id", F.transform(F.sequence(F.lit(0), F.lit(days - 1)), lambda d: F.coalesce(F.try_element_at("m", d), F.lit(0.0))).alias("features"))
