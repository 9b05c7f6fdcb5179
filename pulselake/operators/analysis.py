"""Reports on events: times, histograms, resolutions, exposure, channels side by side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pulselake.operators.ordered import since_previous

HOUR = 3_600_000_000


def with_hours(df: DataFrame, time: str = "t") -> DataFrame:
    """df with hours since its first record and the time as whole seconds and microseconds (time_s, time_mus)."""
    start = df.agg(F.min(time).alias("t0_")).withColumn("one_", F.lit(1))
    met = df.withColumn("one_", F.lit(1)).join(F.broadcast(start), "one_")  # one row
    return met.withColumns({"hours": (F.col(time) - F.col("t0_")) / HOUR, "time_s": F.floor(F.col(time) / 1_000_000), "time_mus": F.pmod(F.col(time), F.lit(1_000_000))}).drop("one_", "t0_")


def start_stop(df: DataFrame, origin: str, time: Column, ident: str) -> DataFrame:
    """origin, t_first, t_last, first_key, last_key of each file or part."""
    at = F.struct(time.alias("t"), F.col(ident).alias("k"))
    ends = df.groupBy(origin).agg(F.min(at).alias("a"), F.max(at).alias("b"))
    return ends.select(origin, F.col("a.t").alias("t_first"), F.col("b.t").alias("t_last"), F.col("a.k").alias("first_key"), F.col("b.k").alias("last_key"))


def histogram(df: DataFrame, value: Column, width: float, keys: list[str] = (), low: float = 0.0) -> DataFrame:
    """keys, bin, n: counts in bins of a width from `low` on."""
    return df.groupBy(*keys, F.floor((value - low) / width).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def density(df: DataFrame, x: Column, y: Column, width: float, height: float) -> DataFrame:
    """x, y, n, log_n: counts on a grid of two columns."""
    return df.groupBy(F.floor(x / width).alias("x"), F.floor(y / height).alias("y")).agg(F.count(F.lit(1)).alias("n"), F.log10(F.count(F.lit(1))).alias("log_n"))


def efficiency(df: DataFrame, value: Column, width: float, left: Column) -> DataFrame:
    """bin, n_all, n_left, efficiency: the share of events that a cut leaves by height."""
    binned = df.groupBy(F.floor(value / width).alias("bin")).agg(F.count(F.lit(1)).alias("n_all"), F.count_if(left).alias("n_left"))
    return binned.withColumn("efficiency", F.col("n_left") / F.col("n_all"))


def counts_above(df: DataFrame, value: Column, width: float) -> DataFrame:
    """bin, n, n_above: counts by bin and from each bin on; one row a bin."""
    return histogram(df, value, width).withColumn("n_above", F.sum("n").over(W.orderBy(F.col("bin").desc()).rowsBetween(W.unboundedPreceding, 0)))


def resolution(df: DataFrame, amplitude: str, height: str) -> DataFrame:
    """amplitude, n, mean, sd, resolution: the deviation of heights in units of the amplitude that makes them."""
    g = df.groupBy(amplitude).agg(F.count(F.lit(1)).alias("n"), F.avg(height).alias("mean"), F.stddev_pop(height).alias("sd"))
    return g.withColumn("resolution", F.col("sd") * F.col(amplitude) / F.col("mean"))


def exposure(df: DataFrame, key: str, time: str, ident: str, most: int, mass: float = 1.0, dead: int = 0) -> DataFrame:
    """key, live_hours, n_gaps, kg_days: time between neighbouring pulses, gaps over `most` counted as that, less `dead` for each pulse."""
    since = since_previous(df, key, time, ident)
    near = F.greatest(F.least(F.col("since_"), F.lit(most)) - dead, F.lit(0))
    live = since.groupBy(key).agg((F.sum(F.when(F.col("since_").isNotNull(), near)) / HOUR).alias("live_hours"), F.count_if(F.col("since_") > most).alias("n_gaps"))
    return live.withColumn("kg_days", F.col("live_hours") / 24 * mass)


def side_by_side(df: DataFrame, event: str, channel: str, value: str, channels: dict[int, str]) -> DataFrame:
    """event and a column for each named channel, of events that have them all; of several rows of a channel the largest value."""
    wide = df.where(F.col(channel).isin(list(channels))).groupBy(event).agg(*[F.max(F.when(F.col(channel) == c, F.col(value))).alias(name) for c, name in channels.items()])
    return wide.where(" and ".join(f"`{name}` is not null" for name in channels.values()))


def correlated_heights(df: DataFrame, event: str, channel: str, trace: str, lead: int, others: list[int], reach: int) -> DataFrame:
    """event, at_sample, ph, ph_{c}: the leading channel's highest sample and its place, and the highest sample of each other channel within
    `reach` samples of it (from reach before to reach after)."""
    wide = side_by_side(df, event, channel, trace, {lead: "lead_", **{c: f"trace_{c}" for c in others}})
    wide = wide.withColumn("at_", F.array_position("lead_", F.array_max("lead_")).cast("int"))
    low = F.greatest(F.lit(1), F.col("at_") - reach)
    near = lambda c: F.array_max(F.slice(f"trace_{c}", low, F.least(F.size(f"trace_{c}"), F.col("at_") + reach) - low + 1)).alias(f"ph_{c}")
    return wide.select(event, (F.col("at_") - 1).alias("at_sample"), F.array_max("lead_").alias("ph"), *map(near, others))


def between_knots(df: DataFrame, value: str, knots: DataFrame, width: float) -> DataFrame:
    """df with `at`: linear interpolation of knots (h, at), of the rows between the first and last one. Both sides meet in buckets of a
    width, so knots may be many; they are ordered in one task."""
    line = W.orderBy("h")
    pieces = knots.select(F.col("h").alias("h1_"), F.lead("h").over(line).alias("h2_"), F.col("at").alias("a1_"), F.lead("at").over(line).alias("a2_")).where("h2_ is not null")
    filed = pieces.withColumn("bucket_", F.explode(F.sequence(F.floor(F.col("h1_") / width), F.floor(F.col("h2_") / width))))
    met = df.withColumn("bucket_", F.floor(F.col(value) / width)).join(filed, "bucket_").where((F.col(value) >= F.col("h1_")) & (F.col(value) < F.col("h2_")))
    at = F.col("a1_") + (F.col(value) - F.col("h1_")) * (F.col("a2_") - F.col("a1_")) / (F.col("h2_") - F.col("h1_"))
    return met.withColumn("at", at).drop("bucket_", "h1_", "h2_", "a1_", "a2_")


def class_of_amplitude(tpa: Column, most_test: float = 10.0) -> Column:
    """What a test pulse amplitude makes of a record: noise, particle, test pulse or control pulse."""
    return F.when(tpa == -1, "noise").when(tpa == 0, "particle").when(tpa <= most_test, "test pulse").otherwise("control pulse")


def class_of_amplitudes(tpas: Column, low: float, high: float, every: bool = False) -> Column:
    """The same for records of several channels (an array of amplitudes): a test pulse if any (or every) channel's amplitude lies in (low, high],
    a control pulse if any (or every) lies over that, else a particle."""
    meets = F.forall if every else F.exists
    return F.when(meets(tpas, lambda a: a > high), "control pulse").when(meets(tpas, lambda a: (a > low) & (a <= high)), "test pulse").otherwise("particle")


def noise_windows(df: DataFrame, key: str, time: str, ident: str, length: int, margin: int, share: float = 1.0, seed: int = 1) -> DataFrame:
    """key, start: windows of `length` between neighbouring records, `margin` away from both, that do not overlap; a share of them, drawn by a
    hash of seed, key and place."""
    gaps = since_previous(df, key, time, ident).where(F.col("since_") >= 2 * margin + length)
    n = F.floor((F.col("since_") - 2 * margin) / length)
    windows = gaps.select(key, (F.col(time) - F.col("since_") + margin).alias("first_"), F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("i_"))
    windows = windows.select(key, (F.col("first_") + F.col("i_") * length).alias("start"))
    drawn = F.pmod(F.xxhash64(F.lit(seed), F.col(key), F.col("start")), F.lit(1 << 53)) / float(1 << 53)
    return windows if share >= 1 else windows.where(drawn < share)


def label_counts(df: DataFrame, *labels: str) -> DataFrame:
    return df.groupBy(*labels).agg(F.count(F.lit(1)).alias("n"))


def confusion(df: DataFrame, label: str, prediction: str, classes: list[int]) -> DataFrame:
    """label and predicted_{c}: a row of the confusion matrix for each label."""
    return df.groupBy(label).agg(*[F.count_if(F.col(prediction) == c).alias(f"predicted_{c}") for c in classes])


def blank_labels(events: DataFrame) -> DataFrame:
    """channel, event_idx, label: zero for every event."""
    return events.select("channel", "event_idx", F.lit(0).alias("label")).distinct()
