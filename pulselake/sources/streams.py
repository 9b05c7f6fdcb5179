"""Continuous streams of several channels as one table of chunks: channel, start (number of the first sample), samples (volts)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulselake.operators.triggering import cut_windows, triggers, deviation_score
from pulselake.sources.interleaved import read_interleaved
from pulselake.sources.records import read_stream


class StreamTime:
    """Times of samples: microseconds from the first sample's time and the step."""

    def __init__(self, start: int, step: int, length: int):
        self.start, self.step, self.length = start, step, length

    def __getitem__(self, place: int) -> int:
        if not -self.length <= place < self.length:
            raise IndexError(f"no sample {place} of {self.length}")
        return self.start + (place % self.length) * self.step

    def stamp_of(self, place: Column) -> Column:
        return place * self.step + self.start

    def place_of(self, stamp: Column, check: bool = True) -> Column:
        """Number of the sample at or before a time; with `check` a time outside the stream is an error, else null."""
        at = F.floor((stamp - self.start) / self.step)
        inside = (at >= 0) & (at < self.length)
        miss = F.raise_error(F.concat(F.lit("outside the stream: "), stamp.cast("string"))) if check else F.lit(None)
        return F.when(stamp.isNull() | inside, at).otherwise(miss.cast("long"))

    @staticmethod
    def as_datetime(stamp: Column) -> Column:
        return F.timestamp_micros(stamp)

    @staticmethod
    def as_stamp(time: Column) -> Column:
        return F.unix_micros(time)


class Stream:
    """A stream. Indexing gives chunks cut to the asked samples; nothing is read before that is collected."""

    def __init__(self, chunks: DataFrame, size: int, time: StreamTime):
        self.chunks, self.size, self.time = chunks, size, time

    def keys(self) -> list:
        return [r["channel"] for r in self.chunks.select("channel").distinct().orderBy("channel").collect()]

    def __getitem__(self, key) -> DataFrame:
        """stream[channel] or stream[channel, samples]: the chunks, or a sample or slice of them as one row (channel, start, samples)."""
        name, idx = key if isinstance(key, tuple) else (key, slice(None))
        found = self.chunks.where(F.col("channel") == F.lit(name))
        if idx == slice(None):
            return found
        if isinstance(idx, int):
            low = self.time.length + idx if idx < 0 else idx
            low, high, step = low, low + 1, 1
            if not 0 <= low < self.time.length:
                raise IndexError(f"no sample {idx} of {self.time.length}")
        else:
            low, high, step = idx.indices(self.time.length)
            if step < 0:
                raise IndexError("streams are cut forwards")
        touched = found.where((F.col("start") < high) & (F.col("start") + F.size("samples") > low))
        lo = F.greatest(F.lit(low) - F.col("start"), F.lit(0)).cast("int")
        hi = F.least(F.lit(high) - F.col("start"), F.size("samples")).cast("int")
        # A slice is a window that fits in memory; the step counts from its own first sample.
        parts = touched.select("channel", F.struct("start", F.slice("samples", lo + 1, hi - lo).alias("x")).alias("p"))
        whole = parts.groupBy("channel").agg(F.flatten(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["x"])).alias("samples"))
        picked = F.col("samples") if step == 1 else F.filter("samples", lambda _, i: i % step == 0)
        return whole.select("channel", F.lit(low).cast("long").alias("start"), picked.alias("samples"))

    def windows(self, places: DataFrame, length: int, before: int, pad: bool = False) -> DataFrame:
        """places (channel, place and more) with window; with `pad`, windows over the ends repeat the end samples."""
        if not pad:
            return cut_windows(self.chunks, places, self.size, length, before)
        n = self.time.length
        low = F.least(F.greatest(F.col("place") - before, F.lit(0)), F.lit(max(n - length, 0)))
        moved = places.withColumn("want_", F.col("place") - before).withColumn("have_", low)
        cut = cut_windows(self.chunks, moved.withColumnRenamed("place", "asked_").withColumn("place", F.col("have_")), self.size, length, 0)
        at = lambda i: F.get("window", F.least(F.greatest(i + (F.col("want_") - F.col("have_")).cast("int"), F.lit(0)), F.lit(length - 1)))
        return cut.withColumn("window", F.transform("window", lambda _, i: at(i))).drop("place", "want_", "have_").withColumnRenamed("asked_", "place")

    def sum(self, *channels) -> Stream:
        """One channel more, "sum": the sum of some (or all) channels sample by sample."""
        some = self.chunks.where(F.col("channel").isin(*channels)) if channels else self.chunks
        added = some.groupBy("start").agg(F.collect_list("samples").alias("parts"))
        total = F.aggregate(F.slice("parts", 2, F.greatest(F.size("parts") - 1, F.lit(0))), F.get("parts", F.lit(0)), lambda a, b: F.zip_with(a, b, lambda x, y: x + y))
        return Stream(added.select(F.lit("sum").alias("channel"), "start", total.alias("samples")), self.size, self.time)

    def pulser_triggers(self, threshold: float, length: int) -> DataFrame:
        """channel, place, tpa: test pulses on channels that carry the pulser's own signal, as deviations of its square; tpa is the root of the square above the record's first samples."""
        squared = self.chunks.withColumn("samples", F.transform(F.col("samples").cast("array<double>"), lambda v: v * v))
        found = triggers(squared, self.size, length, threshold, deviation_score)
        cut = cut_windows(squared, found.select("channel", "place"), self.size, length, length // 4)
        head = F.aggregate(F.slice("window", 1, length // 8), F.lit(0.0), lambda a, v: a + v) / (length // 8)
        return cut.select("channel", "place", F.sqrt(F.greatest(F.array_max("window") - head, F.lit(0.0))).alias("tpa"))


def open_stream(spark: SparkSession, hardware: str, files: dict[str, str] | str, start: int, step: int, chunk: int = 65536, volts: tuple[float, float] = (-10.0, 10.0)) -> Stream:
    """A stream by its hardware: "int16" (a file for each channel name) or "interleaved" (one file that holds all channels)."""
    if hardware == "int16":
        low, high = volts
        scaled = lambda df: df.withColumn("samples", F.transform("samples", lambda n: F.lit(low) + (n.cast("double") + 32768) * ((high - low) / 65536)))
        chunks = reduce(DataFrame.unionByName, [scaled(read_stream(spark, path, chunk)).select(F.lit(name).alias("channel"), "start", "samples") for name, path in files.items()])
    elif hardware == "interleaved":
        wide = read_interleaved(spark, files, chunk)
        names = [c for c in wide.columns if c != "place"]
        long = wide.select("place", F.explode(F.array(*[F.struct(F.lit(n).alias("channel"), F.col(n).cast("double").alias("v")) for n in names])).alias("c"))
        grouped = long.groupBy("c.channel", (F.floor(F.col("place") / chunk) * chunk).alias("start")).agg(F.array_sort(F.collect_list(F.struct("place", "c.v"))).alias("s"))
        chunks = grouped.select("channel", "start", F.transform("s", lambda r: r["v"]).alias("samples"))
    else:
        raise ValueError(f"no reader for streams of {hardware}")
    length = chunks.agg(F.max(F.col("start") + F.size("samples"))).first()[0] or 0
    return Stream(chunks, chunk, StreamTime(start, step, length))
