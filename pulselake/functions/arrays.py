"""Column functions on traces: arrays of doubles with one sample at each place.

All are higher-order SQL functions, so they run in the JVM next to the scan and leave the event axis alone.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(x: Column) -> Column:
    return x.cast("array<double>")


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def mean(x: Column) -> Column:
    return total(x) / F.size(x)


def places(n: int) -> Column:
    return F.sequence(F.lit(0), F.lit(n - 1))


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once for a row, also where f uses it for every sample."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def head_mean(x: Column, n: int) -> Column:
    """Mean of the first n samples."""
    return mean(F.slice(x, 1, n))


def remove_constant(x: Column, n: int) -> Column:
    """x without the mean of its first n samples."""
    return let(head_mean(x, n), lambda m: F.transform(x, lambda v: v - m))


def line_fit(x: Column, n: int) -> Column:
    """Struct (intercept, slope) of the straight line through the first n samples, by the normal equations."""
    mid, spread = (n - 1) / 2, sum((i - (n - 1) / 2) ** 2 for i in range(n))
    head = F.slice(x, 1, n)
    slope = total(F.transform(head, lambda v, i: v * (i - mid))) / spread
    return F.struct((mean(head) - slope * mid).alias("intercept"), slope.alias("slope"))


def remove_line(x: Column, n: int) -> Column:
    """x without the straight line through its first n samples."""
    return let(line_fit(x, n), lambda fit: F.transform(x, lambda v, i: v - (fit["intercept"] + fit["slope"] * i)))


def block_means(x: Column, length: int, factor: int) -> Column:
    """Means of consecutive blocks of `factor` samples."""
    return F.transform(places(length // factor), lambda i: mean(F.slice(x, i * factor + 1, F.lit(factor))))


def truncated(x: Column, low: int, high: int) -> Column:
    """Samples low to high - 1."""
    return F.slice(x, low + 1, high - low)


def rolled(x: Column, by: int) -> Column:
    """x moved right by `by` samples, with what falls out coming in on the other side."""
    return F.transform(x, lambda _, i: F.get(x, F.pmod(i - by, F.size(x))))


def shifted(x: Column, by: int) -> Column:
    """x moved right by `by` samples, null where nothing comes in."""
    return F.transform(x, lambda _, i: F.when((i - by >= 0) & (i - by < F.size(x)), F.get(x, F.greatest(i - by, F.lit(0)))))


def tukey(n: int, alpha: float = 0.25) -> list[float]:
    """The tapered cosine window."""
    edge = alpha * (n - 1) / 2
    weight = lambda i: 0.5 * (1 + math.cos(math.pi * (i / edge - 1))) if i < edge else 1.0
    return [weight(min(i, n - 1 - i)) for i in range(n)]


def weighted(x: Column, weights: list[float]) -> Column:
    return F.zip_with(x, F.lit(weights).cast("array<double>"), lambda v, w: v * w)


def box_car(x: Column, length: int, width: int) -> Column:
    """Moving mean over `width` samples, with the edge samples repeated beyond the trace; an even width reaches one sample further to the left."""
    before = width // 2
    at = lambda i, d: F.get(x, F.least(F.greatest(i + d, F.lit(0)), F.lit(length - 1)))
    return F.transform(places(length), lambda i: F.aggregate(F.sequence(F.lit(-before), F.lit(width - 1 - before)), F.lit(0.0), lambda a, d: a + at(i, d)) / width)


def power(x: Column) -> Column:
    """Sum of squares."""
    return total(F.transform(x, lambda v: v * v))


def deviation(x: Column) -> Column:
    """Population standard deviation of the samples."""
    return let(mean(x), lambda m: F.sqrt(power(F.transform(x, lambda v: v - m)) / F.size(x)))


def line_residual(x: Column, n: int) -> Column:
    """Root of the summed squares of the first n samples about their straight line."""
    return F.sqrt(power(F.slice(remove_line(x, n), 1, n)))


def min_max_scaled(x: Column) -> Column:
    """From 0 to 1."""
    ends = F.struct(F.array_min(x).alias("low"), F.array_max(x).alias("high"))
    return let(ends, lambda e: F.transform(x, lambda v: (v - e["low"]) / (e["high"] - e["low"])))


def standardised(x: Column) -> Column:
    """In deviations from the trace's own mean."""
    both = F.struct(mean(x).alias("m"), deviation(x).alias("s"))
    return let(both, lambda b: F.transform(x, lambda v: (v - b["m"]) / b["s"]))


def one_hot(code: Column, codes: list[int]) -> Column:
    """An array with a one at the place of the code among `codes`, and one more place for all others."""
    return F.array(*[(code == c).cast("int") for c in codes], F.coalesce((~code.isin(codes)).cast("int"), F.lit(0)))


def close_pairs(x: Column, most: float) -> Column:
    """Number of pairs of samples (in both orders, and of each with itself) closer than `most`."""
    return F.aggregate(x, F.lit(0), lambda n, a: n + F.size(F.filter(x, lambda c: F.abs(a - c) < most)))


def recurrence(x: Column, length: int, most: float) -> Column:
    """The matrix of close pairs as rows of zeros and ones."""
    return F.transform(places(length), lambda i: F.transform(x, lambda v: (F.abs(v - F.get(x, i)) < most).cast("int")))


def first_where(test: Column, low: Column, high: Column) -> Column:
    """First place in [low, high) of an array of booleans that holds, else null."""
    return F.get(F.filter(F.sequence(low, F.greatest(low, high - 1)), lambda i: F.get(test, i) & (i < high)), F.lit(0))


def to_volts(n: Column, bits: int = 16, low: float = -10.0, high: float = 10.0) -> Column:
    """ADC counts as volts."""
    return F.lit(low) + (n + 2 ** (bits - 1)) * ((high - low) / 2**bits)


def to_counts(v: Column, bits: int = 16, low: float = -10.0, high: float = 10.0) -> Column:
    """Volts as ADC counts, unrounded."""
    return (v - low) * (2**bits / (high - low)) - 2 ** (bits - 1)


def main_parameters(x: Column, length: int, smooth: int, edge: int, search: tuple[int, int]) -> Column:
    """Struct of nine numbers of a pulse, from its smoothed trace without baseline.

    ph and t_max: highest sample in [search). t_0: last sample before the peak under a fifth of it (else the last
    place); t_rise: first one from there over four fifths (else 0); t_decaystart, t_half, t_end: first ones from the
    peak under 0.9, 0.736 and 0.368 of it (else the last place). offset: mean of the first `edge` raw samples; drift:
    difference of the last and first `edge` smoothed samples' means over the length.
    """
    last = length - 1
    s = box_car(x, length, smooth)
    low, high = search
    staged = F.transform(F.array(F.struct(s.alias("s"))), lambda r: F.struct(r["s"].alias("s"), remove_constant(r["s"], edge).alias("b")))
    staged = F.transform(staged, lambda r: F.struct(r["s"].alias("s"), r["b"].alias("b"), (F.array_position(F.slice(r["b"], low + 1, high - low), F.array_max(F.slice(r["b"], low + 1, high - low))).cast("int") - 1 + low).alias("t")))

    def numbers(r: Column) -> Column:
        b, t = r["b"], r["t"]
        ph = F.get(b, t)
        before = F.filter(F.sequence(F.lit(0), F.lit(last)), lambda i: (i < t) & (F.get(b, i) < 0.2 * ph))
        t0 = F.coalesce(F.array_max(before), F.lit(last))
        over = F.filter(F.sequence(F.lit(0), F.lit(last)), lambda i: (i >= t0) & (i < t) & (F.get(b, i) > 0.8 * ph))
        after = lambda share: F.coalesce(F.array_min(F.filter(F.sequence(F.lit(0), F.lit(last)), lambda i: (i >= t) & (F.get(b, i) < share * ph))), F.lit(last))
        drift = (mean(F.slice(r["s"], length - edge + 1, edge)) - mean(F.slice(r["s"], 1, edge))) / length
        return F.struct(ph.alias("ph"), t0.alias("t_0"), F.coalesce(F.array_min(over), F.lit(0)).alias("t_rise"), t.alias("t_max"), after(0.9).alias("t_decaystart"), after(0.736).alias("t_half"), after(0.368).alias("t_end"), mean(F.slice(x, 1, edge)).alias("offset"), drift.alias("lin_drift"))

    return F.get(F.transform(staged, numbers), F.lit(0))
