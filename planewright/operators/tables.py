"""Geometry drawn from the driver's tables, in row form and in array form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from planewright.functions import geometry as G


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df`` over as many partitions as there are cores, for work on single rows that costs far more than the shuffle."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)


def trajectories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, idx, x, y): hours since 2024-01-01 and value, in order of time."""
    e = read(spark, sf_dir, "events")
    hours = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'2024-01-01 00:00:00', ts) / 3.6e9D")
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return e.select("user_id", (F.row_number().over(order) - 1).cast("int").alias("idx"), hours.alias("x"), F.col("value").alias("y"))


def polylines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, line array<struct<x, y>>)."""
    return trajectories(spark, sf_dir).groupBy("user_id").agg(G.line_from_rows("idx", "x", "y").alias("line"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, label, e array<double>, p struct<x, y>) of the embeddings' first dimensions."""
    e = read(spark, sf_dir, "embeddings")
    d = F.transform(F.slice("embedding", 1, 8), lambda v: v.cast("double"))
    return e.select(F.col("vec_id").alias("id"), "label", d.alias("e")).withColumn("p", G.point(F.col("e")[0], F.col("e")[1]))


#: DuckDB definitions of the same tables, to stand before a twin's SELECT.
SQL = """traj AS (SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INTEGER) AS idx,
 date_diff('microsecond', TIMESTAMP '2024-01-01 00:00:00', ts) / 3.6e9 AS x, value AS y FROM events),
pts AS (SELECT vec_id AS id, label, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, list_transform(embedding[1:8], lambda v: CAST(v AS DOUBLE)) AS e FROM embeddings)"""
