"""Simulated traces. Every draw comes from a seed and the event's number, so reruns and retried tasks agree."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def noise(rng: np.random.Generator, nps: np.ndarray, length: int) -> np.ndarray:
    """A trace whose mean squared spectrum is nps, with random phases."""
    phase = np.exp(2j * np.pi * rng.random(len(nps)))
    spectrum = np.sqrt(nps) * phase
    spectrum[0] = abs(spectrum[0])
    if length % 2 == 0:
        spectrum[-1] = abs(spectrum[-1])
    return np.fft.irfft(spectrum, length)


def simulate(spark: SparkSession, n: int, template: np.ndarray, nps: np.ndarray, heights: tuple[float, float], jitter: int = 0, seed: int = 1) -> DataFrame:
    """event_idx, height, shift, x: a scaled and moved template on noise; heights uniform in a range."""
    length = len(template)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, h, s, x = batch.column(0).to_pylist(), [], [], []
            for i in ids:
                rng = np.random.default_rng([seed, i])
                h.append(rng.uniform(*heights))
                s.append(int(rng.integers(-jitter, jitter + 1)))
                x.append((noise(rng, nps, length) + h[-1] * np.roll(template, s[-1])).tolist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(h, pa.float64()), pa.array(s, pa.int64()), pa.array(x, pa.list_(pa.float64()))], names=["event_idx", "height", "shift", "x"])

    return spark.range(n).withColumnRenamed("id", "event_idx").mapInArrow(run, "event_idx long, height double, shift long, x array<double>")


def uniform(ident: Column, seed: int) -> Column:
    """A number in [0, 1) from a seed and an event's number."""
    return F.pmod(F.xxhash64(F.lit(seed), ident), F.lit(1 << 53)) / float(1 << 53)


def sampled_height(ident: Column, share: float, scale: float, high: float, seed: int = 1) -> Column:
    """Exponential with `scale` for a share of events, else uniform up to `high`."""
    return F.when(uniform(ident, seed) < share, -scale * F.log(1 - uniform(ident, seed + 1))).otherwise(high * uniform(ident, seed + 2))


def rise(x: Column, start: int, slope: float) -> Column:
    return F.transform(x, lambda v, i: v + F.greatest(i - start, F.lit(0)) * slope)


def spike(x: Column, start: int, stop: int, height: float) -> Column:
    return F.transform(x, lambda v, i: v + F.when((i >= start) & (i < stop), height).otherwise(0.0))


def jump(x: Column, start: int, height: float, decay: float) -> Column:
    return F.transform(x, lambda v, i: v + F.when(i >= start, height * F.exp(-(i - start) / decay)).otherwise(0.0))


def saturated(x: Column, scale: float, slope: float) -> Column:
    """A logistic curve through zero."""
    return F.transform(x, lambda v: scale * (1 / (1 + F.exp(-slope * v)) - 0.5))


def square_wave(x: Column, height: float, spans: list[tuple[int, int]]) -> Column:
    """x with `height` added in each span of samples, ends included."""
    return F.transform(x, lambda v, i: v + sum((F.when((i >= a) & (i <= b), float(height)).otherwise(0.0) for a, b in spans), F.lit(0.0)))


def ramp_jump(x: Column, start: int, height: float, width: int) -> Column:
    """x with a jump of `height` that takes `width` samples from `start` on."""
    return F.transform(x, lambda v, i: v + height * F.least(F.greatest((i - start) / width, F.lit(0.0)), F.lit(1.0)))


def scaled_back(x: Column, mean: float, sigma: float) -> Column:
    """The value whose distance from the mean in deviations is x."""
    return x * sigma + mean
