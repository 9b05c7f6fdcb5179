"""Files of a made-up run, in the formats that the readers take: triggered records with their header and control pulses, a stream for each
channel, and the stamps of the pulser and the clock. For tests and for trying the library; written on one machine."""

from __future__ import annotations

from dataclasses import dataclass
from pathlib import Path

import numpy as np

from pulselake.functions.fits import pulse_shape
from pulselake.sources.records import CONTROL, CONTROL_HEADER, STAMPS, TEST_STAMPS, dtype_of, triggered_layout

#: The cycle of amplitudes that the pulser goes through (over 10: control pulse, 0: particle, -1: noise), and the clock in Hz.
AMPLITUDES = (20.0, 0.1, -1.0, 20.0, 0.3, 0.0, 20.0, 0.5, 1.0, 20.0, 3.0, -1.0, 20.0, 0.0, 10.0)
CLOCK = 10_000_000


@dataclass(frozen=True)
class Run:
    """What a run is made with. Times in seconds, resolutions in volts."""

    duration: float = 92.0
    interval: float = 3.0
    rate: int = 25_000
    length: int = 1024
    channels: tuple[int, ...] = (0, 1)
    amplitudes: tuple[float, ...] = AMPLITUDES
    resolution: float = 0.002
    start: int = 1_600_000_000
    offset: int = 1_000
    seed: int = 1


def pulses(run: Run) -> list[tuple[float, float]]:
    """(time, amplitude) of every pulse whose record lies within the run."""
    times = np.arange(run.interval, run.duration - run.length / run.rate, run.interval)
    return [(float(t), run.amplitudes[i % len(run.amplitudes)]) for i, t in enumerate(times)]


def _height(amplitude: float) -> float:
    """Volts: particles are one volt, noise is none, the rest saturates slowly."""
    return 1.0 if amplitude == 0 else 0.0 if amplitude < 0 else 8 * amplitude / (amplitude + 8)


def _counts(volts: np.ndarray) -> np.ndarray:
    return np.clip(np.round((volts + 10) * 65536 / 20 - 32768), -32768, 32767).astype("<i2")


def write_run(folder: str, name: str = "run", run: Run = Run()) -> dict[str, str]:
    """Writes {name}.rdt, .par, .con, _ch{c}.csmpl, .dig_stamps and .test_stamps; gives their paths by ending (streams by channel)."""
    out, rng = Path(folder), np.random.default_rng(run.seed)
    found = pulses(run)
    t = (np.arange(run.length) - run.length / 4) * 1000 / run.rate
    shape = pulse_shape(t, 0.0, 1.0, 0.5, 2.0, 0.5, 6.0)
    shape /= shape.max()
    kept = [(time, a) for time, a in found if a <= 10]
    rows = np.zeros(len(kept) * len(run.channels), dtype_of(triggered_layout(run.length)))
    for i, (time, a) in enumerate(kept):
        for j, channel in enumerate(run.channels):
            row, ticks = rows[i * len(run.channels) + j], int(time * CLOCK)
            row["detector_nmbr"], row["trig_count"], row["coincide_pulses"] = channel, i, len(run.channels)
            row["abs_time_s"], row["abs_time_mus"] = run.start + int(time), round(time % 1 * 1e6)
            row["time_low"], row["time_high"], row["hours"] = ticks & 0x7FFFFFFF, ticks >> 32, time / 3600
            row["test_pulse_amplitude"] = a
            row["samples"] = _counts(_height(a) * shape + rng.normal(0, run.resolution, run.length))
    rows.tofile(out / f"{name}.rdt")
    stop = run.start + int(run.duration)
    header = [f"Timeofday at start  [s]: {run.start}", "Timeofday at start [us]: 0", f"Timeofday at stop   [s]: {stop}", "Timeofday at stop  [us]: 0", f"Measuring time    [h] : {run.duration / 3600}", "Integers in header             : 7", "DVM channels                   : 0", f"Record length                  : {run.length}", f"Time base [us]                 : {1_000_000 // run.rate}"]
    (out / f"{name}.par").write_text("\n".join(header) + "\n")
    control = [(c, _height(a), int(time * CLOCK) & 0xFFFFFFFF, int(time * CLOCK) >> 32, 0.0, 0) for time, a in found if a > 10 for c in run.channels]
    (out / f"{name}.con").write_bytes(bytes(CONTROL_HEADER) + np.array(control, dtype_of(CONTROL)).tobytes())
    paths = {end: str(out / f"{name}.{end}") for end in ("rdt", "par", "con", "dig_stamps", "test_stamps")}
    for channel in run.channels:
        stream = rng.normal(0, run.resolution, int(run.duration * run.rate))
        for time, a in found:
            low = int(time * run.rate) - run.length // 4
            stream[low : low + run.length] += _height(a) * shape[: len(stream[low : low + run.length])]
        paths[f"ch{channel}"] = str(out / f"{name}_ch{channel}.csmpl")
        _counts(stream).tofile(paths[f"ch{channel}"])
    banks = np.array([(run.offset, 0, 0), (3 * run.offset, 1, 1)], dtype_of(STAMPS))
    banks.tofile(paths["dig_stamps"])
    stamps = [(int(time * CLOCK) + run.offset, a, c) for time, a in found if a > 0 for c in run.channels]
    np.array(stamps, dtype_of(TEST_STAMPS)).tofile(paths["test_stamps"])
    return paths
