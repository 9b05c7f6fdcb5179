"""Joins of records by time: coincidence windows, nearest record. Times are whole microseconds.

Range conditions are joined on time buckets, so they shuffle on a hash instead of comparing all pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def coincidence(a: DataFrame, b: DataFrame, low: int, high: int, key: str | None = None) -> DataFrame:
    """b_id, a_id for each row of b with a time in [t + low, t + high) of a row of a (both: id, t, and key if given).

    Both sides are filed under buckets as wide as the interval; a row of a under the (at most two) that its
    interval touches.
    """
    width = max(1, high - low)
    on = ["bucket_"] + ([key] if key else [])
    left = a.select(F.col("id").alias("a_id"), F.col("t").alias("a_t"), *([key] if key else []), F.explode(F.sequence(F.floor((F.col("t") + low) / width), F.floor((F.col("t") + high - 1) / width))).alias("bucket_"))
    right = b.select(F.col("id").alias("b_id"), F.col("t").alias("b_t"), *([key] if key else []), F.floor(F.col("t") / width).alias("bucket_"))
    return right.join(left, on).where((F.col("b_t") >= F.col("a_t") + low) & (F.col("b_t") < F.col("a_t") + high)).select("b_id", "a_id")


def not_coincident(a: DataFrame, b: DataFrame, low: int, high: int, key: str | None = None) -> DataFrame:
    """Rows of b that no interval of a holds."""
    return b.join(coincidence(a, b, low, high, key).select(F.col("b_id").alias("id")).distinct(), "id", "left_anti")


def nearest(a: DataFrame, b: DataFrame, key: str, chunk: int = 3_600_000_000) -> DataFrame:
    """a_id, b_id, dt: for each row of a the nearest row of b of its key; ties to the earlier time, then the smaller id.

    Within a key and chunk of time one sort holds both sides: the last row of b before and the first after are the
    only candidates. Chunks without such a row take them from the nearest chunk that has one.
    """
    both = a.select(key, "t", "id", F.lit(0).alias("side")).unionByName(b.select(key, "t", "id", F.lit(1).alias("side"))).withColumn("chunk_", F.floor(F.col("t") / chunk))
    mark = F.when(F.col("side") == 1, F.struct("t", "id"))
    ends = both.where("side = 1").groupBy(key, "chunk_").agg(F.max_by(F.struct("t", "id"), F.struct("t", -F.col("id"))).alias("top"), F.min(F.struct("t", "id")).alias("bottom"))
    ends = both.select(key, "chunk_").distinct().join(ends, [key, "chunk_"], "left")
    chunks = W.partitionBy(key).orderBy("chunk_")
    ends = ends.select(key, "chunk_", F.last("top", ignorenulls=True).over(chunks.rowsBetween(W.unboundedPreceding, -1)).alias("earlier_"), F.first("bottom", ignorenulls=True).over(chunks.rowsBetween(1, W.unboundedFollowing)).alias("later_"))
    line = W.partitionBy(key, "chunk_")
    up = line.orderBy("t", F.col("side").desc(), F.col("id").desc()).rowsBetween(W.unboundedPreceding, 0)
    down = line.orderBy(F.col("t").desc(), F.col("side").desc(), F.col("id").desc()).rowsBetween(W.unboundedPreceding, 0)
    found = both.withColumn("b_", F.last(mark, ignorenulls=True).over(up)).withColumn("a_", F.last(mark, ignorenulls=True).over(down)).where("side = 0").join(ends, [key, "chunk_"])
    found = found.withColumn("before", F.coalesce("b_", "earlier_")).withColumn("after", F.coalesce("a_", "later_"))
    gap = lambda c: F.abs(F.col(f"{c}.t") - F.col("t"))
    pick = F.when(F.col("after").isNull() | (gap("before") <= gap("after")), F.col("before")).otherwise(F.col("after"))
    return found.withColumn("pick", pick).where("pick is not null").select(F.col("id").alias("a_id"), F.col("pick.id").alias("b_id"), (F.col("pick.t") - F.col("t")).alias("dt"))


def exclude_near(triggers: DataFrame, pulses: DataFrame, key: str, most: int, chunk: int = 3_600_000_000) -> DataFrame:
    """triggers with keep: false for the trigger nearest to each pulse if closer than `most`, and outside the span of pulses."""
    hit = nearest(pulses, triggers, key, chunk).where(F.abs("dt") < most).select(F.col("b_id").alias("id")).distinct().withColumn("hit", F.lit(True))
    span = pulses.groupBy(key).agg(F.min("t").alias("first"), F.max("t").alias("last"))
    joined = triggers.join(hit, "id", "left").join(span, key, "left")
    return joined.select(*triggers.columns, (F.col("hit").isNull() & F.coalesce(F.col("t").between(F.col("first"), F.col("last")), F.lit(False))).alias("keep"))


def coincident_channels(records: DataFrame, key: str, channel: str) -> DataFrame:
    """channels, n: the channel tuples that fired under one trigger count, and how often."""
    fired = records.groupBy(key).agg(F.array_sort(F.collect_set(channel)).alias("channels"))
    return fired.groupBy("channels").agg(F.count(F.lit(1)).alias("n"))
