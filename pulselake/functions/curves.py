"""Model curves as column expressions: pulses, baselines, gaussians, saturation."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def exponential_decay(x: Column, height: float, rate: float, level: float) -> Column:
    return height * F.exp(-rate * x) + level


def exponential_baseline(t: Column, level: float, rate: float) -> Column:
    return level + F.exp(t * rate)


def gauss(x: Column, area: float, mean: float, sigma: float) -> Column:
    """A gaussian whose integral is `area`."""
    return F.exp(-((x - mean) ** 2) / (2 * sigma**2)) * (area / (sigma * math.sqrt(2 * math.pi)))


def cubic(t: Column, coefficients: tuple[float, ...]) -> Column:
    """A polynomial, lowest coefficient first."""
    out = F.lit(float(coefficients[-1]))
    for c in reversed(coefficients[:-1]):
        out = out * t + float(c)
    return out


def components(t: Column, t0: float, heights: tuple[float, ...], times: tuple[float, ...], shared: float) -> Column:
    """A pulse of components that all rise (or fall) with the time `shared`, zero up to t0; the first one counts down."""
    s = t - t0
    parts = [(-a if i == 0 else a) * (F.exp(-s / tau) - F.exp(-s / shared)) for i, (a, tau) in enumerate(zip(heights, times, strict=True))]
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return F.when(t > t0, total).otherwise(0.0)


def pulse(t: Column, *numbers: float) -> Column:
    """Six numbers (t0, A_n, A_t, tau_n, tau_in, tau_t) are the pulse of two components; 2 (k + 1) of them (t0, k heights, k times, tau_n)
    that of k components from three on."""
    if len(numbers) == 6:
        t0, a_n, a_t, tau_n, tau_in, tau_t = numbers
        return components(t, t0, (a_n, a_t), (tau_in, tau_t), tau_n)
    k = len(numbers) // 2 - 1
    if len(numbers) % 2 or k < 3:
        raise ValueError("a pulse of k components, from three on, has 2 (k + 1) numbers")
    return components(t, numbers[0], numbers[1 : k + 1], numbers[k + 1 : 2 * k + 1], numbers[-1])


def pulse_on_baseline(t: Column, height: float, shift: float, baseline: tuple[float, float, float, float], t0: float, *rest: float) -> Column:
    """A scaled and moved pulse of two components (t0, A_n, A_t, tau_n, tau_in, tau_t) on a cubic baseline."""
    return cubic(t, baseline) + height * pulse(t, t0 + shift, *rest)


def logistic(x: Column, a: float, k: float, c: float, q: float, b: float, nu: float) -> Column:
    """The generalised logistic curve."""
    return a + (k - a) / (c + q * F.exp(-b * x)) ** (1 / nu)


def level_at_zero(k: float, c: float, q: float, nu: float) -> float:
    """The lower asymptote that takes the curve through zero at zero."""
    return k / (1 - (c + q) ** (1 / nu))


def slope_at_zero(a: float, k: float, c: float, q: float, b: float, nu: float) -> float:
    return b * q * (k - a) * (c + q) ** (-1 / nu - 1) / nu


def logistic_through_zero(x: Column, k: float, c: float, q: float, b: float, nu: float) -> Column:
    return logistic(x, level_at_zero(k, c, q, nu), k, c, q, b, nu)


def logistic_of_unit_slope(x: Column, a: float, k: float, c: float, q: float, b: float, nu: float) -> Column:
    """The curve over x divided by its slope at zero."""
    return logistic(x / slope_at_zero(a, k, c, q, b, nu), a, k, c, q, b, nu)


def mixed_energy(phonon: Column, light: Column, share: float) -> Column:
    """Energy of an event from both channels, of which `share` goes to light."""
    return share * light + (1 - share) * phonon


def between(x: Column, knots: list[float], values: list[float]) -> Column:
    """Linear interpolation, with the end values beyond the ends."""
    out = F.lit(float(values[-1]))
    for x0, x1, y0, y1 in reversed(list(zip(knots, knots[1:], values, values[1:], strict=False))):
        out = F.when(x < x1, y0 + (x - x0) * ((y1 - y0) / (x1 - x0))).otherwise(out)
    return F.when(x <= knots[0], float(values[0])).otherwise(out)


def outside(x: Column, y: Column, knots: list[float], lower: list[float], upper: list[float]) -> Column:
    """Whether a point lies outside the region between two polylines over the same knots; its border is inside."""
    if not len(knots) == len(lower) == len(upper):
        raise ValueError("knots and bounds differ in number")
    return ~(x.between(knots[0], knots[-1]) & (y <= between(x, knots, upper)) & (y >= between(x, knots, lower)))
