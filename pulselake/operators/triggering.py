"""Triggers on continuous streams that are stored in chunks: channel, start (number of the first sample), samples.

All chunks but a channel's last have one length, `size`, of at least one record. Each is filtered by itself with the
ends of its neighbours beside it; what it yields is folded in order. Results do not depend on `size`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulselake.functions import arrays as A
from pulselake.operators.ordered import RUNS, gap_islands

Score = Callable[[np.ndarray, int], np.ndarray]


def with_neighbours(chunks: DataFrame, size: int, halo: int) -> DataFrame:
    """channel, start, n, total, x, skip: each chunk's n samples with up to `halo` more at both sides; skip of them come first.

    A chunk sends its ends to its neighbours, so three parts at most meet under one (channel, start).
    """
    x = F.col("samples").cast("array<double>")
    body = F.struct(F.lit(1).alias("at"), x.alias("x"))
    head = F.struct(F.lit(2).alias("at"), F.slice(x, 1, halo).alias("x"))
    tail = F.struct(F.lit(0).alias("at"), F.slice(x, F.greatest(F.size("samples") - halo + 1, F.lit(1)), halo).alias("x"))
    sent = F.array(F.struct(F.col("start").alias("to"), body.alias("part")), F.struct((F.col("start") - size).alias("to"), head.alias("part")), F.struct((F.col("start") + size).alias("to"), tail.alias("part")))
    parts = chunks.select("channel", F.explode(sent).alias("s")).select("channel", "s.to", "s.part")
    met = parts.groupBy("channel", F.col("to").alias("start")).agg(F.array_sort(F.collect_list("part")).alias("parts")).where(F.exists("parts", lambda p: p["at"] == 1))
    length = lambda at: F.aggregate(F.filter("parts", lambda p: p["at"] == at), F.lit(0), lambda a, p: a + F.size(p["x"]))
    totals = chunks.groupBy("channel").agg(F.max(F.col("start") + F.size("samples")).alias("total"))
    return met.join(totals, "channel").select("channel", "start", length(1).alias("n"), "total", F.flatten(F.transform("parts", lambda p: p["x"])).alias("x"), length(0).alias("skip"))


def spans_over(y: np.ndarray, first: int, stop: int, threshold: float, length: int) -> Iterator[tuple[int, int, int]]:
    """(low, high, peak): every place in [first, stop) with y over the threshold lies in one span, and the highest of the
    `length` samples from any such place of the span on is at `peak`."""
    over = np.flatnonzero(y[first:stop] > threshold) + first
    at = 0
    while at < len(over):
        low = int(over[at])
        peak = low + int(np.argmax(y[low : low + length]))
        after = np.flatnonzero(y[low + length : peak + length] > y[peak])
        last = min(peak, low + int(after[0])) if len(after) else peak
        next_at = int(np.searchsorted(over, last, "right"))
        yield low, int(over[next_at - 1]), peak
        at = next_at


def triggers(chunks: DataFrame, size: int, length: int, threshold: float, score: Score) -> DataFrame:
    """channel, place, height: triggers of each channel's scored stream.

    From the first sample after one record, up to one record and a sample before the end: the first score over the
    threshold opens a record of `length` samples whose highest score is the trigger; the search goes on half a record
    and one sample after it.
    """
    if size < length:
        raise ValueError(f"chunks of {size} samples are shorter than a record of {length}")
    kind = chunks.schema["channel"].dataType.simpleString()

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in range(batch.num_rows):
                channel, start, n, total, skip = (batch.column(c)[row] for c in (0, 1, 2, 3, 5))
                start, n, total, skip = start.as_py(), n.as_py(), total.as_py(), skip.as_py()
                if skip < length and start:
                    raise ValueError(f"no whole chunk before sample {start} of channel {channel.as_py()}")
                y = score(np.asarray(batch.column(4)[row].values, float), length)
                first, stop = max(skip, skip + length - start), skip + min(n, total - length - 1 - start)
                out += [(channel.as_py(), start - skip + a, start - skip + b, start - skip + p, float(y[p])) for a, b, p in spans_over(y, first, max(stop, first), threshold, length)]
            names = ["channel", "low", "high", "place", "height"]
            types = [batch.schema.field(0).type, pa.int64(), pa.int64(), pa.int64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names=names)

    spans = with_neighbours(chunks, size, length).mapInArrow(find, f"channel {kind}, low long, high long, place long, height double")

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("low")
        kept, free = [], -1
        for at, (high, place) in enumerate(zip(rows["high"].to_numpy(), rows["place"].to_numpy())):
            if high >= free:
                kept.append(at)
                free = place + length // 2 + 1
        return rows.iloc[kept][["channel", "place", "height"]]

    runs = gap_islands(spans, "channel", "low", "low", 3 * length, 4096 * length)
    return runs.groupBy("channel", F.floor(F.col("island") / RUNS)).applyInPandas(fold, f"channel {kind}, place long, height double")


def sliding_peaks(x: np.ndarray, width: int) -> np.ndarray:
    """Place of the highest (the first of equal ones) of the `width` samples from each place on, where there are so many: from the running
    highest of blocks of that width, forwards and backwards."""
    n = len(x) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    padded = np.full(-(-len(x) // width) * width, -np.inf)
    padded[: len(x)] = x
    rows, at = padded.reshape(-1, width), np.arange(len(padded)).reshape(-1, width)

    def running(v: np.ndarray, where: np.ndarray, later_wins: bool) -> np.ndarray:
        top = np.maximum.accumulate(v, axis=1)
        before = np.concatenate([np.full((len(v), 1), -np.inf), top[:, :-1]], axis=1)
        new = (v >= before) if later_wins else (v > before)
        new[:, 0] = True
        last = np.maximum.accumulate(np.where(new, np.arange(v.shape[1]), 0), axis=1)
        return np.take_along_axis(where, last, axis=1)

    ahead = running(rows, at, False).reshape(-1)
    behind = running(rows[:, ::-1], at[:, ::-1], True)[:, ::-1].reshape(-1)
    left, right = behind[:n], ahead[width - 1 : width - 1 + n]
    return np.where(padded[left] >= padded[right], left, right)


def record_triggers(chunks: DataFrame, size: int, length: int, threshold: float, overlap: float = 0.125, block: int | None = None) -> DataFrame:
    """channel, place, height: the stream is looked at in records that overlap, each without the mean of its first half overlap. Where the highest
    sample between the overlaps passes the threshold, the record is moved so that this sample is the first one searched, the highest
    sample then is the trigger, and the next record is searched from `block` samples (a record, if not given) after it on.

    Where a record begins hangs on all before it. For each place at which a chunk can be entered it says where the search leaves it; these
    are chained, one row a chunk, and the chunks are then searched from where they are entered.
    """
    edge, head, block = int(length * overlap), int(length * overlap / 2), block or length
    if not 0 < overlap <= 0.25 or head < 1 or block < length:
        raise ValueError("the overlap must be over 0 and up to a quarter, with a sample in its half, and the block a record at least")
    if size < 2 * length:
        raise ValueError(f"chunks of {size} samples are shorter than two records of {length}")
    width, kind = length - 2 * edge, chunks.schema["channel"].dataType.simpleString()

    def steps(x: np.ndarray, skip: int, start: int, n: int, total: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each place of the chunk: the next one, the trigger on the way (or -1) and its height; places from the chunk's first sample."""
        x = x[skip:]
        last = max(0, min(n, total - length - start))
        sums = np.concatenate([[0.0], np.cumsum(x)])
        peaks = sliding_peaks(x, width)
        at = np.arange(last)
        level = lambda p: (sums[p + head] - sums[p]) / head
        peak = peaks[at + edge]
        passed = x[peak] - level(at) > threshold
        moved = peak - edge
        inside = passed & (start + moved < total - length)
        again = np.where(inside, moved, 0)
        second = peaks[again + edge]
        place = np.where(inside, second, -1)
        step = np.where(passed, np.where(inside, second - edge + block, n + 2 * length + block), at + width)
        return step, place, np.where(inside, x[second] - level(again), 0.0)

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most = 2 * width + block
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                step, _, _ = steps(np.array(row["x"], float), row["skip"], row["start"], row["n"], row["total"])
                to = np.minimum(step, len(step))
                last = np.where(to < len(step), to, np.arange(len(step)))
                for _ in range(len(step).bit_length()):
                    last = last[last]
                out.append((row["channel"], row["start"], (row["start"] + step[last])[:most].tolist()))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], batch.schema.field("channel").type), pa.array([r[1] for r in out], pa.int64()), pa.array([r[2] for r in out], pa.list_(pa.int64()))], names=["channel", "start", "leave"])

    def chained(part: pd.DataFrame) -> pd.DataFrame:
        part, at, out = part.sort_values("start").reset_index(drop=True), 0, []
        for start, leave in zip(part["start"], part["leave"]):
            out.append(at)
            if start <= at < start + len(leave):
                at = int(leave[at - start])
        return pd.DataFrame({"chain_": part["channel"], "start_": part["start"], "enter": out})

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                step, place, height = steps(np.array(row["x"], float), row["skip"], row["start"], row["n"], row["total"])
                at = row["enter"] - row["start"]
                while 0 <= at < len(step):
                    if place[at] >= 0:
                        out.append((row["channel"], row["start"] + int(place[at]), float(height[at])))
                    at = int(step[at])
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], batch.schema.field("channel").type), pa.array([r[1] for r in out], pa.int64()), pa.array([r[2] for r in out], pa.float64())], names=["channel", "place", "height"])

    near = with_neighbours(chunks, size, 2 * length)
    leaves = near.mapInArrow(told, f"channel {kind}, start long, leave array<long>")
    enters = leaves.groupBy("channel").applyInPandas(chained, f"chain_ {kind}, start_ long, enter long")
    met = near.join(enters, F.col("channel").eqNullSafe(F.col("chain_")) & (F.col("start") == F.col("start_"))).drop("chain_", "start_")
    return met.mapInArrow(search, f"channel {kind}, place long, height double")


def filter_score(transfer: np.ndarray) -> Score:
    """The stream convolved with the impulse response of a transfer function of a record."""

    def score(x: np.ndarray, length: int) -> np.ndarray:
        n = 1 << int(np.ceil(np.log2(len(x) + length)))
        return np.fft.irfft(np.fft.rfft(x, n) * np.fft.rfft(np.fft.irfft(transfer, length), n), n)[: len(x)]

    return score


def deviation_score(x: np.ndarray, length: int) -> np.ndarray:
    """Each sample in standard deviations of the `length` before it; nothing where there are fewer or they do not differ."""
    out = np.full(len(x), -np.inf)
    if len(x) > length:
        before = np.lib.stride_tricks.sliding_window_view(x, length)[:-1]
        for at in range(0, len(before), 4096):
            w = before[at : at + 4096]
            sd = w.std(axis=1)
            gap = x[length + at : length + at + len(w)] - w.mean(axis=1)
            out[length + at : length + at + len(w)] = np.where(sd > 0, gap / np.where(sd > 0, sd, 1), -np.inf)
    return out


def cut_windows(chunks: DataFrame, places: DataFrame, size: int, length: int, before: int) -> DataFrame:
    """places (channel, place and more) with window: the samples in [place - before, place - before + length) where all are there.

    A window touches few chunks; each gives its slice, so samples are never rows.
    """
    low = F.col("place") - before
    asked = places.withColumn("low_", low).where("low_ >= 0")
    asked = asked.withColumn("chunk_", F.explode(F.sequence(F.floor(F.col("low_") / size), F.floor((F.col("low_") + length - 1) / size))))
    asked = asked.withColumn("start", F.col("chunk_") * size).drop("chunk_")
    met = asked.join(chunks.select("channel", "start", "samples"), ["channel", "start"])
    lo = F.greatest(F.col("low_") - F.col("start"), F.lit(0))
    hi = F.least(F.col("low_") + length - F.col("start"), F.size("samples").cast("long"))
    met = met.where(hi > lo).withColumn("part_", F.struct("start", F.slice("samples", (lo + 1).cast("int"), (hi - lo).cast("int")).alias("x")))
    cut = met.groupBy(*places.columns).agg(F.flatten(F.transform(F.array_sort(F.collect_list("part_")), lambda p: p["x"])).alias("window"))
    return cut.where(F.size("window") == length)


def pulse_heights(chunks: DataFrame, found: DataFrame, size: int, length: int) -> DataFrame:
    """found (channel, place and more) with pulse_height: of the record with the place at its quarter, the highest sample from a fifth to
    two fifths of it, over the mean of its first eighth. Records over the stream's ends are left out."""
    cut = cut_windows(chunks, found, size, length, length // 4)
    head = F.aggregate(F.slice("window", 1, length // 8), F.lit(0.0), lambda a, v: a + v) / (length // 8)
    return cut.withColumn("pulse_height", F.array_max(F.slice("window", length // 5 + 1, 2 * length // 5 - length // 5)) - head).drop("window")


def median_filtered(x: np.ndarray, width: int = 51) -> np.ndarray:
    """The median of `width` samples around each one; beyond the ends are zeros."""
    return np.median(np.lib.stride_tricks.sliding_window_view(np.pad(x, width // 2), width), axis=1)


def highest_filtered(length: int, edge: int, transfer: np.ndarray | None, down: int, window: bool, square: bool) -> Callable[[np.ndarray, int], tuple[int, float]]:
    """Place and height of a record's highest sample between its edges, from a given one on: averaged over `down` samples, squared if asked for,
    without the mean of its first half edge, then through a transfer function (under a window) or a running median."""
    n, rim = length // down, edge // down
    taper = np.array(A.tukey(n)) if window else np.ones(n)

    def highest(record: np.ndarray, blocked: int) -> tuple[int, float]:
        x = record.reshape(n, down).mean(axis=1)
        x = x**2 if square else x
        x = x - x[: rim // 2].mean()
        y = median_filtered(x) if transfer is None else np.fft.irfft(np.fft.rfft(x * taper) * transfer, n)
        first = max(rim, blocked // down)
        at = first + int(y[first : n - rim].argmax())
        return at * down, float(y[at])

    return highest


class RecordSearch:
    """The search along one stretch of a stream. `at` is the record to look at next, `blocked` the number of its first samples that cannot
    trigger; no more samples are held than the records still to come need."""

    def __init__(self, highest: Callable[[np.ndarray, int], tuple[int, float]], start: int, length: int, edge: int, block: int, threshold: float):
        self.highest, self.length, self.edge, self.block, self.threshold = highest, length, edge, block, threshold
        self.held, self.base, self.at, self.blocked = np.zeros(0), start, start + length, 0

    def end(self) -> int:
        return self.base + len(self.held)

    def _record(self) -> np.ndarray:
        return self.held[self.at - self.base : self.at - self.base + self.length]

    def _look(self) -> tuple[int, float, int, int] | None:
        """What the next record triggers, if anything; moves on to the one after it."""
        found = None
        if self.blocked < self.length - self.edge:
            place, height = self.highest(self._record(), self.blocked)
            if height > self.threshold:
                self.at += place - self.edge - 1
                if self.at + self.length > self.end():
                    return None
                place, height = self.highest(self._record(), self.blocked)
                if height > self.threshold:
                    found = (self.at + place, height, self.at, self.blocked)
                    self.blocked += place + self.block
        step = self.length - 2 * self.edge
        self.at, self.blocked = self.at + step, max(self.blocked - step, 0)
        return found

    def feed(self, samples: np.ndarray, last: bool = False) -> Iterator[tuple[int, float, int, int]]:
        """place, height, record, blocked of each trigger that these samples settle; `last` says that none follow."""
        self.held = np.concatenate([self.held, samples])
        reach = self.length + 1 if last else 2 * self.length
        while self.at + reach <= self.end():
            found = self._look()
            if found:
                yield found
        # A record that is looked at again may begin one sample earlier.
        spent = min(max(self.at - 1 - self.base, 0), len(self.held))
        self.held, self.base = self.held[spent:], self.base + spent


def filtered_record_triggers(chunks: DataFrame, length: int, threshold: float, transfer: np.ndarray | None = None, overlap: float = 0.125, block: int | None = None, down: int = 1, window: bool = True, square: bool = False, by: tuple[str, ...] = ("channel",)) -> DataFrame:
    """by, place, height, record, blocked: the stream is looked at in records that overlap, each filtered by itself. Where the highest sample
    between the overlaps passes the threshold, the record is moved so that it comes first and searched again; what is highest then
    triggers, and the next `block` samples (a record, if not given) cannot. The first record's length of a stream is left out.

    Filtered heights hang on where a record begins, and that on all records before. So each stream is one task that reads its chunks in
    order and holds few records at a time; name the files in `by` to have one for each file. Where samples are missing between two
    chunks the search begins anew; records with a null sample find nothing; null chunks are skipped.
    """
    edge, block = int(length * overlap), block or length
    if not 0 < overlap <= 0.25 or edge // down < 2 or length % down:
        raise ValueError("the overlap must be over 0 and up to a quarter, with two samples at least, and the record a multiple of them")
    highest = highest_filtered(length, edge, transfer, down, window, square)
    kinds = [f"`{c}` {chunks.schema[c].dataType.simpleString()}" for c in by]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search, key = None, None

        def told(rows: list, schema: pa.Schema) -> pa.RecordBatch:
            keys = [pa.array([r[0][i] for r in rows], schema.field(c).type) for i, c in enumerate(by)]
            rest = [pa.array([r[1][i] for r in rows], kind) for i, kind in enumerate((pa.int64(), pa.float64(), pa.int64(), pa.int64()))]
            return pa.RecordBatch.from_arrays([*keys, *rest], names=[*by, "place", "height", "record", "blocked"])

        schema = None
        for batch in batches:
            rows, schema = [], batch.schema
            names = list(zip(*[batch.column(c).to_pylist() for c in by], strict=True))
            starts, samples = batch.column("start").to_pylist(), batch.column("samples")
            for i, start in enumerate(starts):
                x = samples[i].values.to_numpy(zero_copy_only=False).astype(float)
                if search is None or names[i] != key or start != search.end():
                    if search is not None:
                        rows += [(key, f) for f in search.feed(np.zeros(0), last=True)]
                    search, key = RecordSearch(highest, start, length, edge, block, threshold), names[i]
                rows += [(key, f) for f in search.feed(x)]
            yield told(rows, schema)
        if search is not None:
            yield told([(key, f) for f in search.feed(np.zeros(0), last=True)], schema)

    ordered = chunks.select(*by, F.col("start").cast("long").alias("start"), F.col("samples").cast("array<double>").alias("samples")).where("size(samples) > 0")
    ordered = ordered.repartition(*by).sortWithinPartitions(*by, "start")
    return ordered.mapInArrow(run, ", ".join([*kinds, "place long, height double, record long, blocked long"]))
