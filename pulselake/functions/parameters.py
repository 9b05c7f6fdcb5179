"""Numbers of traces in numpy, for whole matrices of traces at once (a row each)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from pulselake.functions.signal import per_batch

MAIN = {"pulse_height": "double", "t_zero": "long", "t_rise": "long", "t_max": "long", "t_decaystart": "long", "t_half": "long", "t_end": "long", "offset": "double", "linear_drift": "double", "quadratic_drift": "double"}
ADDITIONAL = {"top": "double", "bottom": "double", "var_start": "double", "mean_start": "double", "var_end": "double", "mean_end": "double", "var": "double", "mean": "double", "skew": "double", "top_step": "double", "top_step_at": "long", "bottom_step": "double", "bottom_step_at": "long", "filtered_top": "double", "filtered_at": "long", "filtered_skew": "double"}


def moving_mean(x: np.ndarray, width: int) -> np.ndarray:
    """Mean over `width` samples with the edge samples repeated; an even width reaches one sample further to the left."""
    before = width // 2
    padded = np.pad(x, ((0, 0), (before, width - 1 - before)), "edge")
    return np.lib.stride_tricks.sliding_window_view(padded, width, axis=1).mean(axis=2)


def smoothed(x: np.ndarray, down: int, smooth: int) -> np.ndarray:
    """The moving mean, or the means of blocks of `down` samples if that is over one."""
    return moving_mean(x, smooth) if down == 1 else x[:, : x.shape[1] // down * down].reshape(len(x), -1, down).mean(axis=2)


def _first(mask: np.ndarray, default: np.ndarray) -> np.ndarray:
    return np.where(mask.any(axis=1), mask.argmax(axis=1), default)


def _last(mask: np.ndarray, default: np.ndarray) -> np.ndarray:
    return np.where(mask.any(axis=1), mask.shape[1] - 1 - mask[:, ::-1].argmax(axis=1), default)


def main_numbers(x: np.ndarray, down: int, search: tuple[int, int], edge: int, smooth: int, quadratic: bool) -> list[np.ndarray]:
    """The columns MAIN. Drift is the difference of the means of the last and first `edge` samples over the length; where the
    peak is not above one deviation and `quadratic` is set, a parabola through all samples gives offset and drifts."""
    n, length = x.shape
    offset = x[:, : length // 8].mean(axis=1)
    s = smoothed(x - offset[:, None], down, smooth)
    size, at = s.shape[1], np.arange(s.shape[1])
    low, high = search[0] // down, search[1] // down
    height, few = s[:, low:high].max(axis=1), max(1, edge // down)
    drift, bend = (s[:, -few:].mean(axis=1) - s[:, :few].mean(axis=1)) / length, np.zeros(n)
    if quadratic and (flat := height <= s.std(axis=1)).any():
        fit = np.linalg.lstsq(np.vander(at.astype(float), 3, increasing=True), s[flat].T, rcond=None)[0]
        offset[flat], drift[flat], bend[flat] = offset[flat] + fit[0], fit[1], fit[2]
    straight = s - drift[:, None] * at - bend[:, None] * at**2
    peak = straight[:, low:high].argmax(axis=1) + low
    level = s[np.arange(n), peak][:, None]
    onset = _last((at < peak[:, None]) & (s < 0.2 * level), np.zeros(n, int))
    risen = _first((at >= onset[:, None]) & (s > 0.8 * level), onset)
    end = _first((at >= peak[:, None]) & (s < 0.368 * level), np.full(n, size - 1))
    half = _last((at <= end[:, None]) & (s > 0.736 * level), end)
    falls = _last((at <= half[:, None]) & (s > 0.9 * level), half)
    return [height, *[(t * down).astype(np.int64) for t in (onset, risen, peak, falls, half, end)], offset, drift, bend]


def main_parameters(traces: DataFrame, ident: str, value: str, search: tuple[int, int], down: int = 1, edge: int = 500, smooth: int = 50, quadratic: bool = False) -> DataFrame:
    """ident and the columns MAIN of each trace; times in samples of the trace."""
    return per_batch(traces, ident, value, MAIN, lambda x: main_numbers(x, down, search, edge, smooth, quadratic))


def window_skew(y: np.ndarray) -> np.ndarray:
    """Third moment of each row taken as a density over its places, where each moment is divided by their number once more."""
    d = y / y.sum(axis=1, keepdims=True)
    at, n = np.arange(y.shape[1]), y.shape[1]
    mean = (d * at).sum(axis=1, keepdims=True) / n
    spread = (d * (at - mean) ** 2).sum(axis=1, keepdims=True) / n
    return (d * ((at - mean) / spread) ** 3).sum(axis=1) / n


def additional_numbers(x: np.ndarray, transfer: np.ndarray | None, down: int, smooth: int) -> list[np.ndarray]:
    """The columns ADDITIONAL; zeros for the filtered ones without a transfer function."""
    n, length = x.shape
    x = x - x[:, : length // 8].mean(axis=1, keepdims=True)
    s = smoothed(x, down, smooth)
    part, step, off = s.shape[1] // 8, np.diff(s, axis=1), s - s.mean(axis=1, keepdims=True)
    with np.errstate(all="ignore"):
        skew = (off**3).mean(axis=1) / (off**2).mean(axis=1) ** 1.5
    out = [s.max(axis=1), s.min(axis=1), s[:, :part].var(axis=1), s[:, :part].mean(axis=1), s[:, -part:].var(axis=1), s[:, -part:].mean(axis=1), s.var(axis=1), s.mean(axis=1), skew]
    out += [step.max(axis=1), step.argmax(axis=1), step.min(axis=1), step.argmin(axis=1)]
    if transfer is None:
        return [*out, np.zeros(n), np.zeros(n, np.int64), np.zeros(n)]
    y = np.fft.irfft(np.fft.rfft(x) * transfer, length)
    edge, reach = length // 8, length // 32
    at = y[:, edge:-edge].argmax(axis=1) + edge
    around = np.take_along_axis(y, at[:, None] + np.arange(-reach, reach), axis=1)
    with np.errstate(all="ignore"):
        return [*out, y[np.arange(n), at], at, window_skew(around)]


def additional_parameters(traces: DataFrame, ident: str, value: str, transfer: np.ndarray | None = None, down: int = 1, smooth: int = 50) -> DataFrame:
    """ident and the columns ADDITIONAL of each trace."""
    return per_batch(traces, ident, value, ADDITIONAL, lambda x: additional_numbers(x, transfer, down, smooth))


def residual_rms(traces: DataFrame, ident: str, value: str, transfer: np.ndarray, template: np.ndarray, around: int | None = None) -> DataFrame:
    """ident, amplitude, place, rms: mean squared distance of the filtered trace from the filtered template, scaled to its highest
    sample and rolled to its place; `around` takes that many samples at both sides of the peak only."""
    pulse = np.fft.irfft(np.fft.rfft(template) * transfer, len(template))
    home = int(pulse.argmax())

    def measure(x: np.ndarray) -> list[np.ndarray]:
        y = np.fft.irfft(np.fft.rfft(x) * transfer, x.shape[1])
        at = y.argmax(axis=1)
        height = y[np.arange(len(y)), at]
        moved = np.arange(y.shape[1]) - (at - home)[:, None]
        rest = y - height[:, None] * pulse[moved % len(pulse)]
        if around is not None:
            rest = np.take_along_axis(rest, (at[:, None] + np.arange(-around, around)) % y.shape[1], axis=1)
        return [height, at, (rest**2).mean(axis=1)]

    return per_batch(traces, ident, value, {"amplitude": "double", "place": "long", "rms": "double"}, measure)


def filter_norm(template: np.ndarray, nps: np.ndarray) -> float:
    """One over the sum of the template's squared spectrum over the noise power."""
    power = np.abs(np.fft.rfft(template)) ** 2
    return float(1 / np.sum(np.where(nps > 0, power / np.where(nps > 0, nps, 1), 0)))


def longer_filter(transfer: np.ndarray, length: int) -> np.ndarray:
    """A transfer function for records of `length` samples: its impulse response, padded with zeros between its two ends."""
    short = np.fft.irfft(transfer)
    half = len(short) // 2
    return np.fft.rfft(np.concatenate([short[:half], np.zeros(length - len(short)), short[half:]]))


def longer_noise(nps: np.ndarray, length: int) -> np.ndarray:
    """Noise power for records of `length` samples, from the padded correlation of the shorter ones; never under zero."""
    return np.maximum(longer_filter(nps, length).real, 0) * (length / (2 * (len(nps) - 1)))
