"""Simulated events of named classes. Every draw comes from a seed and the event's number, so reruns and retried tasks agree."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from pulselake.functions.fits import pulse_shape
from pulselake.operators.simulate import noise

#: What each class of events is made of. pulses: numbers of pulses and their shares; shape: index of the pulse shape;
#: onset: range of the onset in seconds.
NEAR = (-0.02, 0.02)


@dataclass(frozen=True)
class EventClass:
    pulses: tuple[tuple[int, float], ...] = ((0, 1.0),)
    shape: int | None = None
    parts: frozenset[str] = field(default_factory=frozenset)
    onsets: tuple[tuple[float, float], ...] = (NEAR,)


_ONE = ((1, 1.0),)
CLASSES = {
    "Event Pulse": EventClass(_ONE, 0),
    "Noise": EventClass(),
    "Decaying Baseline": EventClass(parts=frozenset({"decay"})),
    "Temperature Rise": EventClass(parts=frozenset({"rise"})),
    "Spike": EventClass(parts=frozenset({"spike"})),
    "Squid Jump": EventClass(parts=frozenset({"jump"})),
    "Reset": EventClass(_ONE, 0, frozenset({"reset"})),
    "Cosinus Tail": EventClass(_ONE, 0, frozenset({"tail"})),
    "Decaying Baseline with Event Pulse": EventClass(_ONE, 0, frozenset({"decay"})),
    "Decaying Baseline with Tail Event": EventClass(_ONE, 0, frozenset({"decay", "tail"})),
    "Pile Up": EventClass(((2, 0.4), (3, 0.3), (4, 0.2), (5, 0.1)), 0),
    "Early or late Trigger": EventClass(_ONE, 0, onsets=((-0.16, -0.04), (0.04, 0.4))),
    "Carrier Event": EventClass(_ONE, 1),
}
#: Pulse shapes (t0, A_n, A_t, tau_n, tau_in, tau_t; seconds) that are used where none are given.
SHAPES = ((0.0, 1.0, 0.5, 0.003, 0.0008, 0.02), (0.0, 1.2, 0.1, 0.0015, 0.0004, 0.005))


@dataclass(frozen=True)
class Settings:
    """What events are drawn with. Times in seconds, heights in volts."""

    length: int = 16384
    rate: float = 25_000.0
    shapes: tuple[tuple[float, ...], ...] = SHAPES
    resolution: tuple[float, float] = (0.0005, 0.01)
    height_scale: float = 0.2
    height_top: float = 10.0
    height_share: float = 0.5
    drifts: bool = True
    square: bool = False
    saturation: bool = True
    digits: bool = True


def class_of(label: str) -> EventClass:
    if label not in CLASSES:
        raise KeyError(f"no class {label}")
    return CLASSES[label]


def drawn_height(rng: np.random.Generator, s: Settings) -> float:
    """Exponential for a share of events, else uniform."""
    return float(rng.exponential(s.height_scale) if rng.random() < s.height_share else rng.uniform(0, s.height_top))


def drawn_noise_power(rng: np.random.Generator, length: int, rate: float, resolution: float) -> np.ndarray:
    """Two power laws behind a low pass, with lines at 50, 150 and 250 Hz, scaled to a resolution; no power at zero."""
    f = np.fft.rfftfreq(length, 1 / rate)
    flat = rng.uniform(0, 0.3)
    power = sum(100.0**-other / (f + 1) ** own for own, other in ((flat, 2 - 2 * flat), (2 - 2 * flat, flat)))
    power = power / np.sqrt(1 + (f / 1e4 * 2 * np.pi) ** 2 / (2 * np.pi) ** 2)
    t = np.arange(length) / rate
    shift = rng.random()
    lines = sum(2e-5 * a * rng.uniform(0.2, 1) * np.cos(2 * np.pi * g * (t - shift)) for g, a in ((50, 1.0), (150, 0.333), (250, 0.2)))
    power = power + np.abs(np.fft.rfft(lines)) ** 2
    power[0] = 0
    return power * (0.65 * resolution / np.std(np.sqrt(power / length))) ** 2


def superposed_noise(rng: np.random.Generator, nps: np.ndarray, density: float = 0.01) -> np.ndarray:
    """A Poisson number of noise traces with gaussian weights, each rolled to a random place."""
    length = 2 * (len(nps) - 1)
    n, out = max(1, int(rng.poisson(1 / density))), np.zeros(length)
    for _ in range(n):
        out += rng.normal(0, np.sqrt(1 / density / length)) * np.roll(noise(rng, nps, length), int(rng.integers(length)))
    return out


def drawn_drift(rng: np.random.Generator, resolution: float) -> np.ndarray:
    """Four coefficients of a cubic baseline."""
    return rng.normal(0, resolution, 4)


def drawn_saturation(rng: np.random.Generator) -> tuple[float, float, float, float, float, float]:
    """(A, K, C, Q, B, nu) of a logistic curve through zero whose top lies between 0.1 and 10 volts."""
    while True:
        k = 10 - rng.exponential(5)
        c, q, b, nu = rng.gamma(3.3, 0.3, 4)
        with np.errstate(all="ignore"):
            a = k / (1 - (c + q) ** (1 / nu))
            top = a + (k - a) / c ** (1 / nu)
        if 0.1 <= top <= 10:
            return a, k, c, q, b, nu


def drawn_decay(rng: np.random.Generator, window: float, least: float, heights: tuple[float, float] = (5.0, 30.0)) -> tuple[float, ...]:
    """(t0, A_n, A_t, tau_n, tau_in, tau_t) of a pulse from before the record that still stands `least` high where it begins."""
    t0 = rng.uniform(-window, -window * 0.375)
    while True:
        height, mix, slow = rng.uniform(*heights), rng.random(), rng.uniform(0.01, 0.2)
        fast, shared = rng.uniform(0.0005, 0.9 * slow, 2)
        numbers = (height * mix * np.sign(shared - fast), height * (1 - mix), shared, fast, slow)
        if pulse_shape(np.array([-window / 4]), t0, *numbers)[0] >= least:
            return (t0, *numbers)


def drawn_square(rng: np.random.Generator, window: float, heights: tuple[float, float]) -> tuple[float, list[tuple[float, float]]]:
    """Height (of either sign) and the intervals of a square wave, of 10 to 300 ms each."""
    height, at, spans = rng.choice([-1, 1]) * rng.uniform(*heights), -window / 4, []
    while at < 0.75 * window:
        stop = at + rng.uniform(0.01, 0.3)
        spans.append((at, stop))
        at = stop + rng.uniform(0.01, 0.3)
    return height, spans


def square(t: np.ndarray, height: float, spans: list[tuple[float, float]]) -> np.ndarray:
    """A wave that is up in each span, ends included."""
    return height * sum((t >= a) & (t <= b) for a, b in spans) if spans else np.zeros(len(t))


def step(t: np.ndarray, t0: float, height: float, width: float) -> np.ndarray:
    """A jump with a straight edge of a width."""
    return height * np.clip((t - t0) / width, 0, 1)


def drawn_event(rng: np.random.Generator, kind: EventClass, s: Settings) -> tuple[np.ndarray, float, list[float], list[float]]:
    """(trace, resolution, heights, onsets) of one event."""
    window = s.length / s.rate
    t = (np.arange(s.length) - s.length / 4) / s.rate
    resolution = rng.uniform(*s.resolution)
    x = superposed_noise(rng, drawn_noise_power(rng, s.length, s.rate, resolution), rng.uniform(0.01, 0.1))
    if s.drifts:
        x += np.polynomial.polynomial.polyval(t, drawn_drift(rng, resolution))
    if s.square:
        x += square(t, *drawn_square(rng, window, (resolution / 2, 2 * resolution)))
    begin, end = -window / 4, window / 3
    if "decay" in kind.parts:
        x += pulse_shape(t, *drawn_decay(rng, window, 10 * resolution))
    if "rise" in kind.parts:
        x += rng.uniform(0.15, 1.5) * np.maximum(t - rng.uniform(begin, end), 0)
    if "spike" in kind.parts:
        at = rng.uniform(begin, end)
        x += rng.uniform(-2, 2) * ((t >= at) & (t <= at + rng.uniform(1e-4, 1e-3)))
    if "jump" in kind.parts:
        x += step(t, rng.uniform(begin, end), rng.choice([-1, 1]) * rng.uniform(0.1, 10), rng.uniform(5e-5, 1e-3))
    numbers, shares = zip(*kind.pulses, strict=True)
    heights, onsets = [], []
    for i in range(int(rng.choice(numbers, p=shares))):
        low, high = kind.onsets[int(rng.integers(len(kind.onsets)))] if not i else (begin, end)
        onsets.append(float(rng.uniform(low, high)))
        heights.append(drawn_height(rng, s))
        t0, *rest = s.shapes[kind.shape % len(s.shapes)]
        pulse = pulse_shape(t, t0 + onsets[-1], *rest)
        pulse = heights[-1] * pulse / max(pulse.max(), 1e-12)
        if "reset" in kind.parts:
            # The readout falls back to zero some time after the peak.
            pulse[int(pulse.argmax()) + int(rng.uniform(0.01, 0.1) * s.rate) :] = 0
        if "tail" in kind.parts:
            after = np.maximum(t - onsets[-1], 0)
            pulse = pulse * (1 + 0.3 * np.cos(2 * np.pi * rng.uniform(5, 30) * after) * (after > 0))
        x += pulse
    if s.saturation and heights:
        a, k, c, q, b, nu = drawn_saturation(rng)
        slope = b * q * (k - a) * (c + q) ** (-1 / nu - 1) / nu
        with np.errstate(over="ignore"):
            x = a + (k - a) / (c + q * np.exp(-b * x / slope)) ** (1 / nu)
    if s.digits:
        x = np.clip(np.round(x * 65536 / 20), -32768, 32767) * 20 / 65536
    return x, resolution, heights, onsets


def sample_events(spark: SparkSession, label: str, n: int, settings: Settings = Settings(), seed: int = 1, first: int = 0) -> DataFrame:
    """event_idx, label, resolution, heights, onsets, x of n events of a class."""
    kind = class_of(label)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            drawn = [drawn_event(np.random.default_rng([seed, i]), kind, settings) for i in ids]
            lists = pa.list_(pa.float64())
            columns = [batch.column(0), pa.array([label] * len(ids)), pa.array([d[1] for d in drawn], pa.float64()), pa.array([d[2] for d in drawn], lists), pa.array([d[3] for d in drawn], lists), pa.array([d[0].tolist() for d in drawn], lists)]
            yield pa.RecordBatch.from_arrays(columns, names=["event_idx", "label", "resolution", "heights", "onsets", "x"])

    return spark.range(first, first + n).withColumnRenamed("id", "event_idx").mapInArrow(run, "event_idx long, label string, resolution double, heights array<double>, onsets array<double>, x array<double>")


def sample_sets(spark: SparkSession, groups, sizes: dict[str, tuple[str, int]], settings: Settings = Settings(), seed: int = 1) -> None:
    """Writes simulated sets to a catalog of groups: sizes names each group's class and number of events."""
    for at, (group, (label, n)) in enumerate(sorted(sizes.items())):
        groups.put(group, sample_events(spark, label, n, settings, seed + at))


#: Means and deviations of the parameters of a phonon detector's pulses, for heights of the given mean and deviation.
HEIGHT, ONSET, NON_THERMAL, SPREAD, INTRINSIC, THERMAL = (0.89, 0.57), (-1.36, 0.29), (112.64, 38.04), (0.718, 0.709), (2.52, 0.058), (21.45, 1.46)


def drawn_shapes(rng: np.random.Generator, heights: np.ndarray) -> np.ndarray:
    """(t0, A_n, A_t, tau_n, tau_in, tau_t) in milliseconds for pulses of some heights, rows as parameters."""
    h, n = (heights - HEIGHT[0]) / HEIGHT[1], len(heights)
    width = np.sqrt(3) * np.abs(SPREAD[0] - 0.312 * h * SPREAD[1])
    slow = -0.134 + rng.uniform(-1, 1, n) * width
    t0 = (h - 0.455) / (0.504 * h + 1.103) + rng.normal(0, 0.644, n)
    intrinsic = 0.23 * slow**2 - slow - 0.331 + rng.normal(0, 0.5454978 / 2, n)
    thermal = -0.468 * slow**2 + slow + 0.372 + rng.normal(0, 1.0354906 / 2, n)
    back = lambda x, of: of[0] + of[1] * x
    return np.array([back(t0, ONSET), heights / 0.705, heights / 0.858, back(slow, NON_THERMAL), back(intrinsic, INTRINSIC), back(thermal, THERMAL)])
