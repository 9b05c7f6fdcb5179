"""The driver's tables in the roles of the event engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulselake.functions import arrays as A

LENGTH, HEAD, SEARCH = 64, 8, (12, 25)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, label, x: 64 samples each."""
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", A.doubles(F.col("embedding")).alias("x"))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, t (microseconds), channel, kind, value, tpa (amplitude of a test pulse)."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("t"),
        (F.col("user_id") % 8).alias("channel"),
        F.col("event_type").alias("kind"),
        "value",
        (F.get_json_object("props", "$.k").cast("double") / 10).alias("tpa"),
    )


SQL_TRACES = "tr AS (SELECT vec_id, label, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS x FROM embeddings), b AS (SELECT vec_id, label, x, list_transform(x, lambda v: v - list_avg(x[1:8])) AS b FROM tr)"
SQL_RECORDS = r"r AS (SELECT event_id AS id, epoch_us(ts) AS t, user_id % 8 AS channel, event_type AS kind, value, CAST(regexp_extract(props, '(\d+)', 1) AS DOUBLE) / 10 AS tpa FROM events)"
