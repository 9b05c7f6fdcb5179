"""Densities of the largest sample of a record of noise, their fit and the trigger threshold that follows.

Each model says how one sample is distributed, and whether a record holds one polluted sample among gaussian ones or all
its samples are a mixture. The density of the largest follows from that by the product of the distributions.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulselake.functions.fits import erf, simplex

#: Parameters of each model after the number of independent samples.
MODELS = {"gauss": ("sigma",), "pollution_exponential": ("sigma", "rate"), "fraction_exponential": ("sigma", "rate", "weight"), "pollution_gauss": ("sigma", "mu", "sigma_2"), "fraction_gauss": ("sigma", "mu", "sigma_2", "weight")}
FLOOR = 1e-300


def _normal(x: np.ndarray, mu: float, sigma: float) -> tuple[np.ndarray, np.ndarray]:
    z = (x - mu) / sigma
    return np.exp(-z * z / 2) / (sigma * math.sqrt(2 * math.pi)), 0.5 * (1 + erf(z / math.sqrt(2)))


def _exponential(x: np.ndarray, rate: float) -> tuple[np.ndarray, np.ndarray]:
    s = np.maximum(x, 0)
    return np.where(x >= 0, rate * np.exp(-rate * s), 0.0), -np.expm1(-rate * s)


def density(model: str, x: np.ndarray, d: float, **p: float) -> np.ndarray:
    """Of the largest of d samples."""
    pdf, cdf = _normal(x, 0.0, p["sigma"])
    if model == "gauss":
        return d * pdf * cdf ** (d - 1)
    other = _exponential(x, p["rate"]) if model.endswith("exponential") else _normal(x, p["mu"], p["sigma_2"])
    if model.startswith("pollution"):
        return other[0] * cdf ** (d - 1) + other[1] * (d - 1) * pdf * cdf ** (d - 2)
    w = p["weight"]
    return d * (w * pdf + (1 - w) * other[0]) * (w * cdf + (1 - w) * other[1]) ** (d - 1)


def binned(df: DataFrame, value: str, width: float) -> tuple[np.ndarray, np.ndarray]:
    """Middles and counts of the bins of a column: rows as wide as the range over `width`, however many rows there are."""
    rows = df.where(F.col(value).isNotNull()).groupBy(F.floor(F.col(value) / width).alias("b")).count().orderBy("b").collect()
    return (np.array([r["b"] for r in rows]) + 0.5) * width, np.array([r["count"] for r in rows], float)


def fit(model: str, x: np.ndarray, counts: np.ndarray, d: float, **start: float) -> dict[str, float]:
    """The parameters (d included) of highest likelihood, by simplex in their logarithms; a weight by its logit."""
    names = ("d", *MODELS[model])
    to = lambda n, v: math.log(v / (1 - v)) if n == "weight" else v if n == "mu" else math.log(v)
    back = lambda n, v: 1 / (1 + math.exp(-min(max(v, -50), 50))) if n == "weight" else v if n == "mu" else math.exp(min(max(v, -50), 50))

    def loss(q: np.ndarray) -> float:
        p = {n: back(n, v) for n, v in zip(names, q)}
        with np.errstate(all="ignore"):
            found = density(model, x, p.pop("d"), **p)
        return float(-(counts * np.log(np.maximum(np.nan_to_num(found), FLOOR))).sum() / counts.sum())

    best = simplex(loss, np.array([to(n, {"d": d, **start}[n]) for n in names]))
    return {n: back(n, v) for n, v in zip(names, best)}


def threshold(model: str, per_record: float, high: float, grid: int = 3000, **p: float) -> float:
    """The lowest threshold up to `high` over which at most `per_record` of the largest samples lie."""
    x = np.linspace(0, high, grid)
    over = np.cumsum((density(model, x, **p) * (x[1] - x[0]))[::-1])[::-1]
    return float(x[np.argmax(over <= per_record)]) if (over <= per_record).any() else float(high)
