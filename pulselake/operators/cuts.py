"""Rate and stability cuts with the spans of time they leave or exclude."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pulselake.operators.ordered import CHUNK, numbered


def normal_cdf(z: float) -> float:
    return 0.5 * math.erfc(-z / math.sqrt(2))


def poisson_quantile(q: float, mu: float) -> int:
    """The smallest count whose cumulative probability is q or more."""
    total, k, term = 0.0, 0, math.exp(-mu)
    while total + term < q and k < 100 + 20 * mu:
        total, k = total + term, k + 1
        term = math.exp(k * math.log(mu) - mu - math.lgamma(k + 1)) if mu > 0 else 0.0
    return k


def rate_slots(df: DataFrame, time: str, control: Column, interval: int, origin: int, low: int, high: int, sigma: float, poisson: bool = True) -> DataFrame:
    """slot, n, n_control, good: slots of `interval` from `origin` on whose count lies in [low, high], with over half the median of
    control records, and within sigma deviations of such slots: by Poisson quantiles about the median, or about the mean.

    The slot that the last event falls to is not whole and not listed. Two numbers (median, count of slots) pass the driver.
    """
    since = F.col(time) - origin
    last = df.where(~control).agg(F.max(since)).first()[0]
    whole = -(-last // interval) - 1 if last is not None else 0
    slot = F.when(since == whole * interval, F.lit(whole - 1)).otherwise(F.floor(since / interval))
    slots = df.groupBy(slot.alias("slot")).agg(F.count_if(~control).alias("n"), F.count_if(control).alias("n_control")).where((F.col("slot") >= 0) & (F.col("slot") < whole))
    middle = slots.where("n_control > 0").agg(F.percentile("n_control", 0.5)).first()[0] or 0.0
    usable = F.col("n").between(low, high) & (F.col("n_control") > middle / 2)
    if poisson:
        median = slots.where(usable).agg(F.percentile("n", 0.5)).first()[0] or 0.0
        near = F.col("n").between(poisson_quantile(normal_cdf(-sigma), median), poisson_quantile(normal_cdf(sigma), median))
    else:
        mean, sd = slots.where(usable).agg(F.avg("n"), F.stddev_pop("n")).first()
        near = F.abs(F.col("n") - (mean or 0.0)) <= sigma * (sd or 0.0)
    return slots.withColumn("good", usable & near)


def spans_of_slots(slots: DataFrame, interval: int, origin: int) -> DataFrame:
    """start, stop: runs of good slots, one row a run. Slots are far fewer than records and are ordered in one task."""
    line = W.orderBy("slot")
    runs = slots.where("good").select("slot", (F.col("slot") - F.row_number().over(line)).alias("run"))
    return runs.groupBy("run").agg((F.min("slot") * interval + origin).alias("start"), ((F.max("slot") + 1) * interval + origin).alias("stop")).drop("run")


def in_good_slots(df: DataFrame, time: str, slots: DataFrame, interval: int, origin: int) -> DataFrame:
    """df with good: whether a row's time lies in a good slot; both ends of a run of slots belong to it."""
    since = F.col(time) - origin
    slot = F.floor(since / interval)
    good = slots.where("good").select(F.col("slot").alias("slot_"))
    at = df.withColumn("own_", slot).withColumn("before_", F.when(since % interval == 0, slot - 1))
    met = at.join(good, F.col("own_") == F.col("slot_"), "left").withColumn("good", F.col("slot_").isNotNull()).drop("slot_")
    met = met.join(good, F.col("before_") == F.col("slot_"), "left")
    return met.withColumn("good", F.col("good") | F.col("slot_").isNotNull()).drop("slot_", "own_", "before_")


def within_deviations(pulses: DataFrame, groups: list[str], height: str, sigma: float, low: float | None = None, high: float | None = None) -> DataFrame:
    """pulses with good: the height lies between the bounds and closer than sigma deviations to the mean of such pulses of its group."""
    inside = (F.col(height) > low if low is not None else F.lit(True)) & (F.col(height) < high if high is not None else F.lit(True))
    stats = pulses.where(inside).groupBy(*groups).agg(F.avg(height).alias("mean_"), F.stddev_pop(height).alias("sd_"))
    met = pulses.join(stats.withColumnsRenamed({g: f"{g}_of_" for g in groups}), [F.col(g).eqNullSafe(F.col(f"{g}_of_")) for g in groups], "left")
    good = F.coalesce(inside & (F.abs(F.col(height) - F.col("mean_")) < sigma * F.col("sd_")), F.lit(False))
    return met.withColumn("good", good).drop("mean_", "sd_", *[f"{g}_of_" for g in groups])


def unstable_spans(pulses: DataFrame, key: str, time: str, ident: str, most: int, chunk: int = CHUNK) -> DataFrame:
    """key, start, stop: from the first of a run of pulses that are not good to the next good one, and between good neighbours more
    than `most` apart; spans that touch are one. The first and last pulse of a key count as good.

    A good pulse and the bad ones up to the next good one are a group, so no window runs over the pulses; spans are few.
    """
    order = F.struct(F.col(time), F.col(ident))
    ends = pulses.groupBy(key).agg(F.min(order).alias("first_"), F.max(order).alias("last_")).withColumnRenamed(key, "end_key_")
    held = pulses.join(ends, F.col(key).eqNullSafe(F.col("end_key_"))).withColumn("good_", F.col("good") | (order == F.col("first_")) | (order == F.col("last_")))
    groups = numbered(held.select(key, time, ident, "good_"), key, time, ident, F.col("good_"), "group_", chunk)
    groups = groups.groupBy(key, "group_").agg(F.min(F.when(F.col("good_"), F.col(time))).alias("good_t"), F.min(F.when(~F.col("good_"), F.col(time))).alias("bad_t"))
    after = groups.select(F.col(key).alias("next_key_"), (F.col("group_") - 1).alias("next_group_"), F.col("good_t").alias("next_t"))
    met = groups.join(after, F.col(key).eqNullSafe(F.col("next_key_")) & (F.col("group_") == F.col("next_group_")))
    spans = met.where(F.col("bad_t").isNotNull() | (F.col("next_t") - F.col("good_t") > most)).select(key, F.coalesce("bad_t", "good_t").alias("start"), F.col("next_t").alias("stop"))
    line = W.partitionBy(key).orderBy("start", "stop")
    new = F.coalesce((F.lag("stop").over(line) != F.col("start")).cast("int"), F.lit(1))
    run = F.sum(F.col("new_")).over(line.rowsBetween(W.unboundedPreceding, 0))
    return spans.withColumn("new_", new).withColumn("run_", run).groupBy(key, "run_").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).drop("run_")


def outside_spans(df: DataFrame, key: str, time: str, ident: str, spans: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """df with stable: false strictly inside a span of its key. Spans are filed under the chunks of time they touch."""
    filed = spans.select(F.col(key).alias("span_key_"), "start", "stop", F.explode(F.sequence(F.floor(F.col("start") / chunk), F.floor(F.col("stop") / chunk))).alias("chunk_"))
    on = F.col(key).eqNullSafe(F.col("span_key_")) & (F.floor(F.col(time) / chunk) == F.col("chunk_")) & (F.col(time) > F.col("start")) & (F.col(time) < F.col("stop"))
    hit = df.join(filed, on).select(F.col(ident).alias("hit_")).distinct()
    return df.join(hit, F.col(ident) == F.col("hit_"), "left").withColumn("stable", F.col("hit_").isNull()).drop("hit_")
