"""From triggers of single channels to events of all channels: one line of triggers, test pulses told apart, windows cut from the stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulselake.operators.joins import exclude_near, nearest
from pulselake.operators.ordered import dead_time_fold, numbered
from pulselake.operators.triggering import cut_windows


def aligned_amplitudes(triggers: DataFrame, block: int, chunk: int | None = None) -> DataFrame:
    """t, id, tpas of the triggers (channel, t, id, tpa) that start a record when those of all channels stand in one line, each blocking
    those up to `block` after it. tpas holds for each channel, in order, the amplitude of its trigger nearest in time (the earlier of
    two, then the smaller id). Ids are numbers that no two triggers share; of triggers at one time the smallest starts the record.

    Every record meets every channel, which is what it holds; each channel's nearest trigger is looked up in chunks of time.
    """
    line = triggers.select("t", "id").withColumn("line_", F.lit(0))
    leads = dead_time_fold(line, "line_", "t", "id", block, closed=True).select("t", "id")
    channels = triggers.select("channel").distinct().agg(F.array_sort(F.collect_list("channel")).alias("channels_"))
    asked = leads.crossJoin(F.broadcast(channels)).select("t", "id", F.explode("channels_").alias("channel"))  # one row, the channels of a detector
    found = nearest(asked, triggers.select("channel", "t", "id"), "channel", chunk or 3_600_000_000)
    valued = found.select(F.col("a_id").alias("id"), "b_id").join(triggers.select("channel", F.col("id").alias("b_id"), "tpa"), "b_id")
    tpas = valued.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("channel", "tpa"))), lambda p: p["tpa"]).alias("tpas"))
    return leads.join(tpas, "id").select("t", "id", "tpas")


def sorted_triggers(triggers: DataFrame, stamps: DataFrame, most: int, least_test: float, least_control: float, chunk: int = 1 << 24) -> DataFrame:
    """kind, event_idx, place, tpa: the triggers (place, id) that are no test pulses as "events" (tpa null), and the pulser's stamps (place, tpa)
    as "testpulses" from `least_test` and "controlpulses" from `least_control` on; numbered by place within each kind.

    A trigger goes if it is the nearest one to a stamp and closer than `most`, or lies outside the span of the stamps. Stamps under
    `least_test`, and stamps or triggers without a place, are left out.
    """
    stamps = stamps.where(F.col("place").isNotNull() & (F.col("tpa") >= least_test)).withColumn("line", F.lit(0)).withColumn("id", F.monotonically_increasing_id())
    placed = triggers.where(F.col("place").isNotNull()).select(F.lit(0).alias("line"), F.col("place").alias("t"), "id")
    kept = exclude_near(placed, stamps.select("line", F.col("place").alias("t"), "id"), "line", most, chunk).where("keep")
    events = kept.select(F.lit("events").alias("kind"), F.col("t").alias("place"), F.lit(None).cast("double").alias("tpa"), F.col("id").cast("string").alias("id"))
    kind = F.when(F.col("tpa") >= least_control, "controlpulses").otherwise("testpulses")
    pulses = stamps.select(kind.alias("kind"), "place", F.col("tpa").cast("double").alias("tpa"), F.col("tpa").cast("string").alias("id"))
    every = numbered(events.unionByName(pulses), "kind", "place", "id", F.lit(True), "number_", chunk)
    return every.select("kind", (F.col("number_") - 1).alias("event_idx"), "place", "tpa")


def imported_events(chunks: DataFrame, size: int, found: DataFrame, length: int) -> DataFrame:
    """kind, event_idx, place, tpa, channel, event, pulse_height: the window of every channel around each row of `sorted_triggers`, with the place at
    its quarter. Control pulses have no event, only their height over the mean of the first eighth. Windows over the ends are left out.
    """
    channels = chunks.select("channel").distinct().agg(F.array_sort(F.collect_list("channel")).alias("channels_"))
    asked = found.crossJoin(F.broadcast(channels)).select("*", F.explode("channels_").alias("channel")).drop("channels_")  # one row, the channels of a detector
    cut = cut_windows(chunks, asked, size, length, length // 4)
    head = F.aggregate(F.slice("window", 1, length // 8), F.lit(0.0), lambda a, v: a + v) / (length // 8)
    control = F.col("kind") == "controlpulses"
    return cut.select("kind", "event_idx", "place", "tpa", "channel", F.when(~control, F.col("window")).alias("event"), F.when(control, F.array_max("window") - head).alias("pulse_height"))


def write_imported(groups, events: DataFrame) -> None:
    """Puts each kind of `imported_events` into its group of the catalog."""
    for kind, idle in (("events", ["kind", "tpa", "pulse_height"]), ("testpulses", ["kind", "pulse_height"]), ("controlpulses", ["kind", "event"])):
        groups.put(kind, events.where(F.col("kind") == kind).drop(*idle))
