"""Trace operators that need linear algebra or transforms: numpy over whole Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulselake.functions.fits import fit_pulse
from pulselake.operators.spectra import stacked, whole


def per_batch(traces: DataFrame, ident: str, value: str, schema: dict[str, str], f: Callable[[np.ndarray], list[np.ndarray]]) -> DataFrame:
    """ident and the columns that f makes of a matrix of traces, each as long as it has rows. Traces that lack samples have no row."""
    kind = traces.schema[ident].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                columns = [pa.array(c.tolist()) if c.ndim > 1 else pa.array(c) for c in f(stacked(batch.column(1)))]
                yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=[ident, *schema])

    read = traces.select(ident, value).where(whole(value))
    return read.mapInArrow(run, ", ".join([f"{ident} {kind}", *[f"{k} {v}" for k, v in schema.items()]]))


def polynomial_baseline(traces: DataFrame, ident: str, value: str, order: int, head: int) -> DataFrame:
    """coefficients (lowest first, in samples) and rms of the polynomial through the first `head` samples."""

    def fit(x: np.ndarray) -> list[np.ndarray]:
        basis = np.vander(np.arange(head), order + 1, increasing=True).astype(float)
        c, *_ = np.linalg.lstsq(basis, x[:, :head].T, rcond=None)
        return [c.T, np.sqrt(((basis @ c - x[:, :head].T) ** 2).sum(axis=0))]

    return per_batch(traces, ident, value, {"coefficients": "array<double>", "rms": "double"}, fit)


def lags(traces: DataFrame, ident: str, value: str, template: np.ndarray) -> DataFrame:
    """lag: shift of each trace against a template at the highest cross-correlation."""
    n = len(template)

    def find(x: np.ndarray) -> list[np.ndarray]:
        full = np.fft.irfft(np.fft.rfft(x, 2 * n) * np.conj(np.fft.rfft(template, 2 * n)), 2 * n)
        at = full.argmax(axis=1)
        return [np.where(at >= n, at - 2 * n, at)]

    return per_batch(traces, ident, value, {"lag": "long"}, find)


def array_fit(traces: DataFrame, ident: str, value: str, template: np.ndarray, order: int, reach: int) -> DataFrame:
    """height, shift, rms: the template, moved by up to `reach` samples, and a polynomial of `order`, fitted to each trace by least squares."""
    n = len(template)
    base = np.vander(np.linspace(-1, 1, n), order + 1, increasing=True)

    def fit(x: np.ndarray) -> list[np.ndarray]:
        best = np.full(len(x), np.inf)
        height, shift = np.zeros(len(x)), np.zeros(len(x), np.int64)
        for by in range(-reach, reach + 1):
            moved = np.roll(template, by)
            if by > 0:
                moved[:by] = template[0]
            elif by < 0:
                moved[by:] = template[-1]
            a = np.column_stack([moved, base])
            c, *_ = np.linalg.lstsq(a, x.T, rcond=None)
            rest = ((a @ c - x.T) ** 2).mean(axis=0)
            better = rest < best - 1e-15
            best[better], height[better], shift[better] = rest[better], c[0][better], by
        return [height, shift, np.sqrt(best)]

    return per_batch(traces, ident, value, {"height": "double", "shift": "long", "rms": "double"}, fit)


def peak_counts(traces: DataFrame, ident: str, value: str, head: int, sigma: float, apart: int) -> DataFrame:
    """n_peaks: excursions over sigma deviations of the first samples, at least `apart` samples from start to start."""

    def count(x: np.ndarray) -> list[np.ndarray]:
        over = x - x[:, :head].mean(axis=1, keepdims=True) > sigma * x[:, :head].std(axis=1, keepdims=True)
        n, free = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
        for i in range(head, x.shape[1]):
            new = over[:, i] & ~over[:, i - 1] & (free <= i)
            n += new
            free = np.where(new, i + apart, free)
        return [n]

    return per_batch(traces, ident, value, {"n_peaks": "long"}, count)


def filtered(traces: DataFrame, ident: str, value: str, transfer: np.ndarray) -> DataFrame:
    """y: traces through a transfer function."""
    return per_batch(traces, ident, value, {"y": "array<double>"}, lambda x: [np.fft.irfft(np.fft.rfft(x) * transfer, x.shape[1])])


def template_fits(traces: DataFrame, ident: str, value: str, template: np.ndarray, order: int, reach: int, truncation: float | None = None, head: int = 8) -> DataFrame:
    """height, shift, rms: as `array_fit`, with shifts between samples and, given a truncation level, without the samples from the first
    to the last that stand over it (above the mean of the first `head`).

    Whole shifts are tried first; a parabola through the best one's residual and its neighbours' gives the part of a sample.
    """
    n = len(template)
    base, at = np.vander(np.linspace(-1, 1, n), order + 1, increasing=True), np.arange(n)

    def solved(x: np.ndarray, use: np.ndarray, by: float) -> tuple[float, float]:
        a = np.column_stack([np.interp(at - by, at, template), base])[use]
        c = np.linalg.lstsq(a, x[use], rcond=None)[0]
        return float(c[0]), float(((a @ c - x[use]) ** 2).mean())

    def fit(rows: np.ndarray) -> list[np.ndarray]:
        out = []
        for x in rows:
            use = np.ones(n, bool)
            over = np.flatnonzero(x - x[:head].mean() > truncation) if truncation is not None else []
            if len(over) and over[-1] - over[0] + 1 < n - order - 2:
                use[over[0] : over[-1] + 1] = False
            tried = {by: solved(x, use, by) for by in range(-reach, reach + 1)}
            best = min(tried, key=lambda by: (tried[by][1], by))
            by, found = float(best), tried[best]
            if -reach < best < reach:
                left, middle, right = (tried[best + d][1] for d in (-1, 0, 1))
                bend = left - 2 * middle + right
                if bend > 0:
                    between = best + (left - right) / (2 * bend)
                    other = solved(x, use, between)
                    by, found = (between, other) if other[1] <= found[1] else (by, found)
            out.append((found[0], by, np.sqrt(found[1])))
        return [np.array(c, float) for c in zip(*out, strict=True)]

    return per_batch(traces, ident, value, {"height": "double", "shift": "double", "rms": "double"}, fit)


def pulse_fits(traces: DataFrame, ident: str, value: str, step_ms: float, onset: tuple[float, float] = (-10.0, 5.0)) -> DataFrame:
    """numbers (t0, A_n, A_t, tau_n, tau_in, tau_t; milliseconds from a quarter of the record) and rms of the pulse through each trace."""

    def fit(rows: np.ndarray) -> list[np.ndarray]:
        t = (np.arange(rows.shape[1]) - rows.shape[1] // 4) * step_ms
        found = [fit_pulse(x, t, onset=onset) for x in rows]
        return [np.array([f[0] for f in found]), np.array([f[1] for f in found])]

    return per_batch(traces, ident, value, {"numbers": "array<double>", "rms": "double"}, fit)


def peak_triggers(traces: DataFrame, ident: str, value: str, lag: int, threshold: float, ahead: int, mean: float | None = None, variance: float | None = None, fixed: float = 0.0) -> DataFrame:
    """places, heights: samples over `threshold` deviations of the `lag` samples before them (of the first `lag` ones at the begin, or of a
    given start). The highest of the next `ahead` samples is the peak, and as many samples are blocked; its height is over the
    mean and two deviations."""

    def find(x: np.ndarray) -> list[np.ndarray]:
        n, length = x.shape
        frames = np.lib.stride_tricks.sliding_window_view(x, lag, axis=1)
        means = np.concatenate([np.repeat(frames[:, :1].mean(axis=2) if mean is None else np.full((n, 1), mean), lag, axis=1), frames[:, :-1].mean(axis=2)], axis=1)
        spread = np.concatenate([np.repeat(frames[:, :1].var(axis=2, ddof=1) if variance is None else np.full((n, 1), variance), lag, axis=1), frames[:, :-1].var(axis=2, ddof=1)], axis=1)
        sd = np.sqrt(np.full_like(spread, fixed) if fixed > 0 else spread)
        out = [np.empty(n, object) for _ in range(2)]
        for row in range(n):
            places, heights, at = [], [], 0
            over = np.flatnonzero(x[row] - means[row] > threshold * sd[row])
            while (k := np.searchsorted(over, at)) < len(over):
                i = int(over[k])
                peak = i + int(x[row, i : i + ahead].argmax())
                places.append(peak)
                heights.append(float(x[row, peak] - 2 * sd[row, i] - means[row, i]))
                at = i + ahead
            out[0][row], out[1][row] = places, heights
        return out

    return per_batch(traces, ident, value, {"places": "array<long>", "heights": "array<double>"}, find)
