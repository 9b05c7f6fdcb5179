"""Averages over traces: mean pulse, noise power, matched filter. Each Arrow batch is summed before anything is shuffled."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulselake.functions import arrays as A


def stacked(column: pa.Array) -> np.ndarray:
    """Traces as rows; they must be of one length, without missing samples."""
    lengths = np.asarray(column.value_lengths())
    if len(lengths) and (lengths != lengths[0]).any():
        raise ValueError(f"traces of {lengths.min()} and {lengths.max()} samples in one table")
    return np.asarray(column.flatten()).astype(np.float64).reshape(len(column), -1)


def whole(value: str) -> Column:
    """Whether a trace is there with all its samples; others take no part in any spectrum or fit."""
    return F.col(value).isNotNull() & F.forall(value, lambda v: v.isNotNull())


def quiet(traces: DataFrame, value: str, head: int, share: float) -> DataFrame:
    """The traces whose deviation is among the lowest `share`: those that hold no pulse."""
    spread = traces.withColumn("spread_", A.deviation(A.remove_constant(A.doubles(F.col(value)), head)))
    limit = spread.where(whole(value)).agg(F.percentile("spread_", share).alias("limit_")).withColumn("one_", F.lit(1))
    kept = spread.withColumn("one_", F.lit(1)).join(F.broadcast(limit), "one_").where("spread_ <= limit_")  # one row
    return kept.drop("spread_", "limit_", "one_")


def _mean_of(traces: DataFrame, key: str, value: str, of_rows) -> DataFrame:
    """key, k, mean over traces of of_rows(trace)[k], from sums for each batch and key."""
    kind = traces.schema[key].dataType.simpleString()

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            rows, keys = of_rows(stacked(batch.column(1))), batch.column(0).to_pandas()
            at = keys.groupby(keys).indices
            yield pa.RecordBatch.from_arrays([pa.array(list(at), batch.schema.field(0).type), pa.array([rows[i].sum(axis=0).tolist() for i in at.values()]), pa.array([len(i) for i in at.values()], pa.int64())], names=["key", "sums", "n"])

    parts = traces.select(key, value).where(whole(value) & F.col(key).isNotNull()).mapInArrow(sums, f"key {kind}, sums array<double>, n long")
    return parts.select("key", "n", F.posexplode("sums").alias("k", "s")).groupBy(F.col("key").alias(key), "k").agg((F.sum("s") / F.sum("n")).alias("mean"))


def noise_power(traces: DataFrame, key: str, value: str, head: int, window: np.ndarray | None = None) -> DataFrame:
    """key, k, nps: mean squared modulus of the real Fourier transform of traces without their first samples' mean, under a window if
    one is given, whose loss of power is made good."""
    w = np.ones(1) if window is None else window / np.sqrt((window**2).mean())
    return _mean_of(traces, key, value, lambda x: np.abs(np.fft.rfft((x - x[:, :head].mean(axis=1, keepdims=True)) * w)) ** 2).withColumnRenamed("mean", "nps")


def mean_pulse(traces: DataFrame, key: str, value: str, head: int) -> DataFrame:
    """key, k, sev: mean trace without baseline, scaled to a highest sample of one."""
    mean = _mean_of(traces, key, value, lambda x: x - x[:, :head].mean(axis=1, keepdims=True))
    top = mean.groupBy(F.col(key).alias("top_key")).agg(F.max("mean").alias("top"))
    return mean.join(top, F.col(key) == F.col("top_key")).select(key, "k", (F.col("mean") / F.col("top")).alias("sev"))


def matched_filter(sev: np.ndarray, nps: np.ndarray, place: int) -> np.ndarray:
    """Transfer function that gives the scaled mean pulse a filtered maximum of one at `place`."""
    spectrum = np.fft.rfft(sev)
    weight = np.where(nps > 0, 1 / np.maximum(nps, 1e-300), 0.0)
    h = np.conj(spectrum) * weight * np.exp(-2j * np.pi * np.arange(len(spectrum)) * place / len(sev))
    h[0] = 0
    return h / np.fft.irfft(spectrum * h, len(sev)).max()


def amplitudes(traces: DataFrame, ident: str, value: str, transfer: np.ndarray, low: int, high: int) -> DataFrame:
    """ident, amplitude, place: highest sample in [low, high) of filtered traces."""
    kind = traces.schema[ident].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = stacked(batch.column(1))
                y = np.fft.irfft(np.fft.rfft(x) * transfer, x.shape[1])[:, low:high]
                at = y.argmax(axis=1)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(y[np.arange(len(y)), at]), pa.array(at + low, pa.int64())], names=[ident, "amplitude", "place"])

    return traces.select(ident, value).where(whole(value)).mapInArrow(run, f"{ident} {kind}, amplitude double, place long")
