"""Numeric helpers in numpy: simplex search, error function, pulse shapes, noise thresholds, maximum gap."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np


def simplex(f: Callable[[np.ndarray], float], start: np.ndarray, step: float = 0.1, rounds: int = 2000, near: float = 1e-10) -> np.ndarray:
    """The downhill simplex method."""
    start = np.asarray(start, float)
    points = [start] + [start + np.eye(len(start))[i] * (step * abs(start[i]) or step) for i in range(len(start))]
    values = [f(p) for p in points]
    for _ in range(rounds):
        order = np.argsort(values, kind="stable")
        points, values = [points[i] for i in order], [values[i] for i in order]
        if abs(values[-1] - values[0]) <= near * (abs(values[0]) + near):
            break
        middle = np.mean(points[:-1], axis=0)
        across = lambda t: middle + t * (middle - points[-1])
        p = across(1.0)
        v = f(p)
        if v < values[0]:
            further = across(2.0)
            w = f(further)
            points[-1], values[-1] = (further, w) if w < v else (p, v)
        elif v < values[-2]:
            points[-1], values[-1] = p, v
        else:
            inner = across(0.5 if v < values[-1] else -0.5)
            w = f(inner)
            if w < min(v, values[-1]):
                points[-1], values[-1] = inner, w
            else:
                points = [points[0]] + [(p + points[0]) / 2 for p in points[1:]]
                values = [values[0]] + [f(p) for p in points[1:]]
    return points[int(np.argmin(values))]


erf = np.vectorize(math.erf, otypes=[float])


def pulse_shape(t: np.ndarray, t0: float, a_n: float, a_t: float, tau_n: float, tau_in: float, tau_t: float) -> np.ndarray:
    """A pulse with a non-thermal and a thermal component, zero before t0."""
    s = np.maximum(t - t0, 0)
    rise = np.exp(-s / tau_n)
    return np.where(t > t0, a_n * (rise - np.exp(-s / tau_in)) + a_t * (np.exp(-s / tau_t) - rise), 0.0)


def efficiency(x: np.ndarray, height: float, threshold: float, width: float) -> np.ndarray:
    """Share of pulses of height x that pass a threshold under gaussian noise."""
    return 0.5 * height * (1 + erf((x - threshold) / (math.sqrt(2) * width)))


def fit_efficiency(x: np.ndarray, share: np.ndarray, threshold: float, width: float) -> np.ndarray:
    """(height, threshold, width) by least squares."""
    return simplex(lambda p: float(((efficiency(x, p[0], p[1], max(abs(p[2]), 1e-9)) - share) ** 2).sum()), np.array([1.0, threshold, width]))


def largest_of(x: np.ndarray, mu: float, sigma: float, d: float) -> np.ndarray:
    """Density of the largest of d gaussian samples."""
    z = (x - mu) / sigma
    return d * np.exp(-z * z / 2) / (sigma * math.sqrt(2 * math.pi)) * np.maximum(0.5 * (1 + erf(z / math.sqrt(2))), 1e-300) ** (d - 1)


def noise_threshold(mu: float, sigma: float, d: float, per_record: float, grid: int = 3000) -> float:
    """The lowest threshold over which at most `per_record` of the largest noise samples lie."""
    x = np.linspace(mu, mu + 12 * sigma, grid)
    above = np.cumsum((largest_of(x, mu, sigma, d) * (x[1] - x[0]))[::-1])[::-1]
    return float(x[np.argmax(above <= per_record)])


def gap_confidence(x: float, mu: float) -> float:
    """Probability that the largest gap holds fewer than x expected events, of mu in all."""
    if mu <= 0 or x <= 0:
        return 0.0
    total = 1.0
    for k in range(1, int(mu / x + 1e-9) + 1):
        rest = k * x - mu
        total += math.exp(-k * x - math.lgamma(k + 1)) * (rest ** (k - 1) if k > 1 else 1.0) * (rest - k)
    return min(max(total, 0.0), 1.0)


def gap_upper_limit(gaps: np.ndarray, confidence: float = 0.9, low: float = 1e-3, high: float = 1e3) -> float:
    """The scale of a spectrum at which its largest share without an event (of gaps, shares of the spectrum) is excluded."""
    widest = float(np.max(gaps))
    for _ in range(200):
        middle = math.sqrt(low * high)
        low, high = (low, middle) if gap_confidence(middle * widest, middle) > confidence else (middle, high)
    return math.sqrt(low * high)


def fit_pulse(x: np.ndarray, t: np.ndarray, start: np.ndarray | None = None, onset: tuple[float, float] = (-10.0, 5.0), least_tau: float = 0.01) -> tuple[np.ndarray, float]:
    """(parameters, root mean squared residual) of the pulse of two components (see pulse_shape) through a trace, by simplex search.

    Outside the bounds of the onset and under the least time constant the loss grows with the distance from them.
    """
    top = float(x.max())
    if start is None:
        start = np.array([t[int(x.argmax())] - 1.0, top, top / 2, 20.0, 3.0, 60.0])
        start[0] = min(max(start[0], onset[0] + 0.1), onset[1] - 0.1)

    def loss(p: np.ndarray) -> float:
        over = max(onset[0] - p[0], p[0] - onset[1], 0.0) + sum(max(least_tau - tau, 0.0) for tau in p[3:])
        inside = np.array([min(max(p[0], onset[0]), onset[1]), *p[1:3], *np.maximum(p[3:], least_tau)])
        return float(np.sqrt(np.mean((pulse_shape(t, *inside) - x) ** 2))) + 1e3 * over * (1 + abs(top))

    best = simplex(loss, start, 0.2, 3000, 1e-9)
    return best, loss(best)


def saturation_curve(x: np.ndarray, k: float, c: float, q: float, b: float, nu: float) -> np.ndarray:
    """The generalised logistic curve through zero."""
    a = k / (1 - (c + q) ** (1 / nu))
    return a + (k - a) / (c + q * np.exp(-b * x)) ** (1 / nu)


def fit_saturation(amplitude: np.ndarray, height: np.ndarray) -> np.ndarray:
    """(K, C, Q, B, nu) of the saturation curve by least squares; the parameters are searched by their logarithms."""
    scale = float(np.max(amplitude)) or 1.0

    def loss(p: np.ndarray) -> float:
        with np.errstate(all="ignore"):
            rest = saturation_curve(amplitude, *np.exp(np.clip(p, -20, 20))) - height
            value = float((rest**2).sum())
        return value if np.isfinite(value) else 1e300

    return np.exp(simplex(loss, np.log([max(float(np.max(height)), 1e-6), 1.0, 1.0, 2.0 / scale, 1.0]), 0.3, 6000, 1e-14))


def orthogonal_polynomials(x: np.ndarray, y: np.ndarray, x_sigma: np.ndarray, order: int, through_zero: bool = True, y_sigma: float = 1.0, rounds: int = 200) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row of points: coefficients (of x^0 or x^1 on), their covariance in units of the residuals' variance, and that variance.

    Points may move along x too, at the cost of their own uncertainty there: the sum of squares of both moves, each over its uncertainty, is
    least. Moves are eliminated from each linear step, which leaves a weighted fit of the coefficients; steps are halved while they lead
    uphill. Where x_sigma is zero points only move along y. With fewer points than coefficients the shortest solution is taken.
    """
    powers = np.arange(0 if not through_zero else 1, order + 1)
    unit = np.maximum(np.abs(x).max(axis=1, keepdims=True), 1e-300)
    x, s, y = x / unit, x_sigma / unit / y_sigma, y / y_sigma
    free = s > 0
    move, b = np.zeros_like(x), np.zeros((len(x), len(powers)))
    b[:, list(powers).index(1)] = (x * y).sum(axis=1) / np.maximum((x**2).sum(axis=1), 1e-300)

    def raised(t: np.ndarray) -> np.ndarray:
        return t[..., None] ** powers

    def cost(b: np.ndarray, move: np.ndarray) -> np.ndarray:
        rest = (raised(x + move) * b[:, None, :]).sum(axis=2) - y
        return (rest**2).sum(axis=1) + (np.where(free, move / np.where(free, s, 1), 0.0) ** 2).sum(axis=1)

    def weighted() -> tuple[np.ndarray, ...]:
        t = x + move
        v = raised(t)
        slope = (powers * t[..., None] ** np.maximum(powers - 1, 0) * b[:, None, :]).sum(axis=2)
        w = 1 / (1 + slope**2 * s**2)
        inverse = np.linalg.pinv(np.sqrt(w)[..., None] * v)
        return v, slope, w, inverse

    now = cost(b, move)
    for _ in range(rounds):
        v, slope, w, inverse = weighted()
        offset = (v * b[:, None, :]).sum(axis=2) - y - slope * move
        step = -(inverse @ (np.sqrt(w) * offset)[..., None])[..., 0]
        to = -(offset + (v * step[:, None, :]).sum(axis=2)) * slope * s**2 * w - move
        part = np.ones((len(x), 1))
        for _ in range(30):
            new = cost(b + part * step, move + part * to)
            uphill = new > now
            if not uphill.any():
                break
            part[uphill] /= 2
        part[uphill] = 0.0
        b, move = b + part * step, move + part * to
        before, now = now, cost(b, move)
        if (before - now <= 1e-15 * before).all():
            break
    inverse = weighted()[3]
    back = unit ** -powers.astype(float)
    covariance = inverse @ inverse.transpose(0, 2, 1) * back[:, :, None] * back[:, None, :]
    spare = x.shape[1] - len(powers)
    return b * back * y_sigma, covariance * y_sigma**2, now / spare if spare > 0 else np.zeros(len(x))
