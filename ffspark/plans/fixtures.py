"""The sample sets of the registered queries, each over a whole table, in Spark and in DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ffspark.sources.samples import one_hot, read_samples, series_samples

FLAGS = ["A", "N", "R"]
EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]
FIRST_DAY, DAYS = "2024-01-01", 30


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_samples(table(spark, sf_dir, "embeddings"), "embedding", one_hot("label", list(range(10))), "vec_id")


def lineitems(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "lineitem")
    return read_samples(t, [F.col("l_quantity").cast("double") / 50, F.col("l_discount").cast("double") * 10, F.col("l_tax").cast("double") * 10], one_hot("l_returnflag", FLAGS))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "events")
    return read_samples(t, [F.col("value") / 100, F.hour("ts") / 24, F.col("user_id") % 7 / 7], one_hot("event_type", EVENT_TYPES), "event_id")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang").join(table(spark, sf_dir, "labels"), "doc_id")
    return read_samples(t, [F.col("n_chars") / 10000, (F.col("lang") == "en").cast("double")], ["quality", "toxic"], "doc_id")


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series_samples(table(spark, sf_dir, "events").select("user_id", "ts"), "user_id", "ts", FIRST_DAY, DAYS)


#: SQL of x (sid, i, v) and y (sid, j, v) for each sample set.
SQL = {
    "embeddings": (
        "SELECT vec_id AS sid, i, embedding[i + 1]::DOUBLE AS v FROM embeddings, range(64) t(i)",
        "SELECT vec_id AS sid, j, coalesce((label = j)::INT, 0)::DOUBLE AS v FROM embeddings, range(10) t(j)",
    ),
    "lineitems": (
        "SELECT sid, unnest([0, 1, 2]) AS i, unnest([l_quantity::DOUBLE / 50, l_discount::DOUBLE * 10, l_tax::DOUBLE * 10]) AS v FROM src",
        "SELECT sid, unnest([0, 1, 2]) AS j, unnest([(l_returnflag = 'A')::INT::DOUBLE, (l_returnflag = 'N')::INT::DOUBLE, (l_returnflag = 'R')::INT::DOUBLE]) AS v FROM src",
    ),
    "events": (
        "SELECT event_id AS sid, unnest([0, 1, 2]) AS i, unnest([value / 100, hour(ts)::DOUBLE / 24, (user_id % 7)::DOUBLE / 7]) AS v FROM events",
        "SELECT event_id AS sid, j, (event_type = ['click', 'error', 'purchase', 'signup', 'view'][j + 1])::INT::DOUBLE AS v FROM events, range(5) t(j)",
    ),
    "documents": (
        "SELECT doc_id AS sid, unnest([0, 1]) AS i, unnest([n_chars::DOUBLE / 10000, (lang = 'en')::INT::DOUBLE]) AS v FROM documents SEMI JOIN labels USING (doc_id)",
        "SELECT doc_id AS sid, unnest([0, 1]) AS j, unnest([quality::DOUBLE, toxic::DOUBLE]) AS v FROM labels SEMI JOIN documents USING (doc_id)",
    ),
}
#: Table expressions that come before x and y.
SOURCE = {"lineitems": "src AS MATERIALIZED (SELECT row_number() OVER () AS sid, * FROM lineitem), "}
