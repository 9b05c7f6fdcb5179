"""Adaptive straight-line segments of traces, and small pictures of them; numpy over whole Arrow batches."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from pulselake.functions.signal import per_batch


def distance(x: np.ndarray, low: int, high: int) -> float:
    """Mean absolute distance of x[low:high] from the line from its first sample at `low` to its last at `high`."""
    part = x[low:high]
    line = part[0] + (part[-1] - part[0]) * np.arange(len(part)) / len(part)
    return float(np.abs(line - part).mean())


def segments(x: np.ndarray, most: float) -> list[tuple[int, int]]:
    """The trace halved until no piece is further than `most` from its line. A piece of one sample is never halved; of an odd
    piece both halves take the middle sample's place rounded down from either side."""
    done, line = [], [(0, len(x))]
    while line:
        low, high = line.pop()
        half = (high - low) / 2
        if high - low > 1 and distance(x, low, high) > most:
            line += [(int(high - half), high), (low, int(low + half))]
        else:
            done.append((low, high))
    return sorted(done)


def segmented(traces: DataFrame, ident: str, value: str, most: float) -> DataFrame:
    """ident, starts, ends (of the segments) and worst (largest distance of any)."""

    def cut(x: np.ndarray) -> list[np.ndarray]:
        found = [segments(row, most) for row in x]
        out = [np.empty(len(x), object) for _ in range(2)]
        for i, s in enumerate(found):
            out[0][i], out[1][i] = [a for a, _ in s], [b for _, b in s]
        return [*out, np.array([max(distance(row, a, b) for a, b in s) for row, s in zip(x, found, strict=True)])]

    return per_batch(traces, ident, value, {"starts": "array<long>", "ends": "array<long>", "worst": "double"}, cut)


def pictures(traces: DataFrame, ident: str, value: str, size: int, alpha: float = 1.0) -> DataFrame:
    """ident, icon: size * size shades (rows from the top), each sample adding alpha to its pixel up to one, scaled to a darkest pixel of one."""

    def draw(x: np.ndarray) -> list[np.ndarray]:
        n, length = x.shape
        across = (np.arange(length) / length * (size - 1)).astype(int)
        y = x - x.min(axis=1, keepdims=True)
        top = y.max(axis=1, keepdims=True)
        up = (y / np.where(top > 0, top, 1) * (size - 1)).astype(int)
        image = np.zeros((n, size, size))
        np.add.at(image, (np.arange(n)[:, None], size - 1 - up, across[None, :]), alpha)
        image = np.minimum(image, 1)
        return [(image / image.max(axis=(1, 2), keepdims=True)).reshape(n, -1)]

    return per_batch(traces, ident, value, {"icon": "array<double>"}, draw)
