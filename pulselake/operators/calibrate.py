"""Heights to amplitudes of reference pulses, with drift over time."""

from __future__ import annotations

import math
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulselake.functions.fits import orthogonal_polynomials
from pulselake.operators.ordered import gap_islands, last_known


def pulser_fits(pulses: DataFrame, gap: int, unit: float, saturation: float | None = None, exclude: tuple[float, ...] = ()) -> DataFrame:
    """channel, island, t_first, t_last, tpa, slope, intercept, n, mean_x, sxx, residual: a straight line through the heights of each amplitude in each run of pulses.

    pulses: channel, t, id, tpa, value. Runs end at gaps over `gap`; lines are over (t - t_first) / unit. Of a run, amplitudes from the
    first one on whose mean height reaches `saturation` are left out, as are those of `exclude`. residual: deviation about the line.
    """
    runs = gap_islands(pulses, "channel", "t", "id", gap)
    spans = runs.groupBy("channel", "island").agg(F.min("t").alias("t_first"), F.max("t").alias("t_last"))
    joined = runs.join(spans, ["channel", "island"])
    if exclude:
        joined = joined.where(~F.round("tpa", 4).isin([round(e, 4) for e in exclude]))
    hours = (F.col("t") - F.col("t_first")) / unit
    fits = joined.groupBy("channel", "island", "t_first", "t_last", "tpa").agg(
        F.regr_slope("value", hours).alias("s_"), F.avg("value").alias("m_"), F.avg(hours).alias("h_"), F.count("value").alias("n"), F.regr_sxx("value", hours).alias("sxx"), F.regr_syy("value", hours).alias("syy_"), F.regr_sxy("value", hours).alias("sxy_")
    )
    if saturation is not None:
        first = fits.where(F.col("m_") >= saturation).groupBy(F.col("channel").alias("c_"), F.col("island").alias("i_")).agg(F.min("tpa").alias("first_"))
        fits = fits.join(first, F.col("channel").eqNullSafe(F.col("c_")) & (F.col("island") == F.col("i_")), "left").where("first_ is null or tpa < first_").drop("c_", "i_", "first_")
    slope = F.coalesce("s_", F.lit(0.0))
    residual = F.when(F.col("n") > 2, F.sqrt(F.greatest(F.col("syy_") - slope * F.col("sxy_"), F.lit(0.0)) / (F.col("n") - 2))).otherwise(0.0)
    return fits.select("channel", "island", "t_first", "t_last", "tpa", slope.alias("slope"), (F.col("m_") - slope * F.col("h_")).alias("intercept"), "n", F.col("h_").alias("mean_x"), "sxx", residual.alias("residual"))


def height_sigma(fit: Column, hours: Column) -> Column:
    """Uncertainty of a line's height at a time: its own and that of single pulses about it, in quadrature."""
    lever = 1 / fit["n"] + F.when(fit["sxx"] > 0, (hours - fit["mean_x"]) ** 2 / fit["sxx"]).otherwise(0.0)
    return F.sqrt(fit["residual"] ** 2 * (1 + lever))


def _with_knots(events: DataFrame, fits: DataFrame, unit: float, through_zero: bool) -> DataFrame:
    """id, value and ks: (h, tpa, sigma) of the amplitudes of each event's run at its time, by height."""
    starts = fits.select("channel", F.col("t_first").alias("t"), F.lit(None).cast("long").alias("id"), F.lit(None).cast("double").alias("value"), "island").distinct()
    both = starts.unionByName(events.select("channel", "t", "id", "value").withColumn("island", F.lit(None).cast("long")))
    placed = last_known(both, "channel", "t", [F.col("island").isNull(), F.col("id")], F.col("island"), "run").where("id is not null")
    earliest = fits.groupBy(F.col("channel").alias("c_")).agg(F.min("island").alias("least_"))
    placed = placed.join(earliest, F.col("channel").eqNullSafe(F.col("c_"))).select("channel", "t", "id", "value", F.coalesce("run", "least_").alias("island"))
    knots = fits.groupBy("channel", "island", "t_first").agg(F.collect_list(F.struct("tpa", "slope", "intercept", "n", "mean_x", "sxx", "residual")).alias("fits"))
    met = placed.join(knots, ["channel", "island"])
    hours = (F.col("t") - F.col("t_first")) / unit
    ks = F.transform("fits", lambda f: F.struct((f["intercept"] + f["slope"] * hours).alias("h"), f["tpa"].alias("tpa"), height_sigma(f, hours).alias("sigma")))
    zero = F.array(F.struct(F.lit(0.0).alias("h"), F.lit(0.0).alias("tpa"), F.lit(0.0).alias("sigma")))
    return met.select("id", "value", F.array_sort(F.concat(zero, ks) if through_zero else ks).alias("ks"))


def amplitudes(events: DataFrame, fits: DataFrame, unit: float) -> DataFrame:
    """id, tpa, sigma: each event's height (channel, t, value) on the piecewise line through zero and its run's amplitudes at its time.

    An event outside all runs takes the last run that began before it, or the first one. Above the highest
    reference height the last piece goes on. sigma: the heights' uncertainty between the two knots, over the piece's slope.
    """
    met = _with_knots(events, fits, unit, True)
    at = F.least(F.greatest(F.size(F.filter("ks", lambda k: k["h"] <= F.col("value"))) - 1, F.lit(0)), F.size("ks") - 2)
    met = met.withColumn("a", F.get("ks", at)).withColumn("b", F.get("ks", at + 1))
    run, rise = F.col("b.h") - F.col("a.h"), F.col("b.tpa") - F.col("a.tpa")
    part = (F.col("value") - F.col("a.h")) / run
    tpa = F.when(run != 0, F.col("a.tpa") + part * rise).otherwise(F.col("a.tpa"))
    sigma = F.when(run != 0, F.abs(rise / run) * (F.col("a.sigma") + part * (F.col("b.sigma") - F.col("a.sigma")))).otherwise(0.0)
    return met.select("id", tpa.alias("tpa"), sigma.alias("sigma"))


def polynomial_amplitudes(events: DataFrame, fits: DataFrame, unit: float, order: int, through_zero: bool = True, orthogonal: bool = False) -> DataFrame:
    """id, tpa, sigma: as `amplitudes`, but on the polynomial of `order` in the height, fitted through the amplitudes of the run: by least
    squares (sigma null), or by orthogonal distances with the reference heights' uncertainties.

    The variance is then the fit's at the height and the height's own (between its two neighbours, whose line goes on beyond them), times
    the polynomial's absolute slope. A run of one amplitude has that one's uncertainty everywhere.
    """
    kind = events.schema["id"].dataType.simpleString()
    powers = np.arange(1 if through_zero else 0, order + 1)

    def of_size(value: np.ndarray, h: np.ndarray, tpa: np.ndarray, sigma: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The values and sigmas of rows with as many knots each."""
        raised, rows = value[:, None] ** powers, np.arange(len(value))
        if not orthogonal:
            b = (np.linalg.pinv(h[..., None] ** powers) @ tpa[..., None])[..., 0]
            return (raised * b).sum(axis=1), np.full(len(value), np.nan)
        b, covariance, variance = orthogonal_polynomials(h, tpa, sigma, order, through_zero)
        slope = (powers * value[:, None] ** np.maximum(powers - 1, 0) * b).sum(axis=1)
        own = sigma[:, 0]
        if h.shape[1] > 1:
            low = np.clip((h <= value[:, None]).sum(axis=1) - 1, 0, h.shape[1] - 2)
            run = h[rows, low + 1] - h[rows, low]
            part = np.where(run != 0, (value - h[rows, low]) / np.where(run != 0, run, 1), 0.0)
            own = sigma[rows, low] + part * (sigma[rows, low + 1] - sigma[rows, low])
        fitted = variance * np.einsum("ri,rij,rj->r", raised, covariance, raised)
        return (raised * b).sum(axis=1), np.sqrt(np.abs(slope) * own**2 + fitted)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in parts:
            tpa, sigma = np.full(len(rows), np.nan), np.full(len(rows), np.nan)
            sizes = np.array([len(ks) for ks in rows["ks"]], int)
            for size in np.unique(sizes):
                at = np.flatnonzero(sizes == size)
                knots = np.array([[(k["h"], k["tpa"], k["sigma"]) for k in rows["ks"].iloc[i]] for i in at], float)
                tpa[at], sigma[at] = of_size(rows["value"].to_numpy(float)[at], knots[..., 0], knots[..., 1], knots[..., 2])
            null = lambda v: pd.array(np.where(np.isnan(v), None, v), "Float64")
            yield pd.DataFrame({"id": rows["id"], "tpa": null(tpa), "sigma": null(sigma)})

    return _with_knots(events, fits, unit, False).mapInPandas(run, f"id {kind}, tpa double, sigma double")


class EnergyCalibration:
    """Heights to energies: fitted once to reference pulses, then called on events. cpe: energy of one unit of amplitude."""

    def __init__(self, pulses: DataFrame, gap: int, unit: float, saturation: float | None = None, exclude: tuple[float, ...] = (), cpe: float = 1.0, order: int | None = None, orthogonal: bool = False):
        self.fits, self.unit, self.cpe, self.order, self.orthogonal = pulser_fits(pulses, gap, unit, saturation, exclude), unit, cpe, order, orthogonal

    def __call__(self, events: DataFrame) -> DataFrame:
        """id, tpa, sigma, energy and energy_sigma."""
        if self.order:
            found = polynomial_amplitudes(events, self.fits, self.unit, self.order, orthogonal=self.orthogonal)
        else:
            found = amplitudes(events, self.fits, self.unit)
        return found.withColumn("energy", F.col("tpa") * self.cpe).withColumn("energy_sigma", F.col("sigma") * self.cpe)


def line_bands(points: DataFrame, key: str, x: str, y: str) -> DataFrame:
    """key, n, slope, intercept, mean_x, sxx, residual: the straight line of each key and the deviation of its residuals."""
    g = points.groupBy(key).agg(F.regr_count(y, x).alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_avgx(y, x).alias("mean_x"), F.regr_sxx(y, x).alias("sxx"), F.regr_syy(y, x).alias("syy_"), F.regr_sxy(y, x).alias("sxy_"))
    rest = F.greatest(F.col("syy_") - F.col("slope") * F.col("sxy_"), F.lit(0.0))
    return g.withColumn("residual", F.sqrt(rest / (F.col("n") - 2))).drop("syy_", "sxy_").where("n > 2")


def student_quantile(confidence: float, n: int) -> float:
    """The quantile of Student's t with n degrees of freedom that leaves (1 - confidence) / 2 above it, by bisection of its integral."""
    norm = math.exp(math.lgamma((n + 1) / 2) - math.lgamma(n / 2)) / math.sqrt(n * math.pi)
    # With x = sqrt(n) tan(a) the density is a power of the cosine.
    grid = np.linspace(0, math.pi / 2, 20_001)
    inside = np.concatenate([[0.0], np.cumsum((np.cos(grid[1:]) ** (n - 1) + np.cos(grid[:-1]) ** (n - 1)) / 2 * (grid[1] - grid[0]))]) * norm * math.sqrt(n)
    return math.sqrt(n) * math.tan(float(np.interp(confidence / 2, inside, grid)))


def student_column(confidence: float, degrees: Column, most: int = 200) -> Column:
    """The same by a row's own degrees of freedom; beyond `most` it hardly changes and follows the normal one's expansion."""
    known = F.array(*[F.lit(student_quantile(confidence, n)) for n in range(1, most + 1)])
    z = NormalDist().inv_cdf((1 + confidence) / 2)
    return F.when(degrees <= most, F.get(known, (degrees - 1).cast("int"))).otherwise(z + (z**3 + z) / (4 * degrees))


def band_at(x: Column, z: float | Column = 1.0) -> tuple[Column, Column, Column]:
    """Value, half width of the confidence band and of the prediction band of a row of line_bands at x, for z deviations (a number, or
    `student_column` of n - 2)."""
    lever = 1 / F.col("n") + (x - F.col("mean_x")) ** 2 / F.col("sxx")
    return F.col("intercept") + F.col("slope") * x, z * F.col("residual") * F.sqrt(lever), z * F.col("residual") * F.sqrt(1 + lever)


def polynomial_without_constant(points: DataFrame, key: str, x: str, y: str, order: int) -> DataFrame:
    """key, coefficients (of x, x^2, ...): least squares through zero. Sums of powers are aggregated; each key's small system is solved beside them."""
    sums = [F.sum(F.pow(F.col(x), k)).alias(f"x{k}") for k in range(2, 2 * order + 1)] + [F.sum(F.pow(F.col(x), k) * F.col(y)).alias(f"y{k}") for k in range(1, order + 1)]
    summed = points.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(key).agg(*sums)

    def solve(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in parts:
            a = np.array([[rows[f"x{i + j}"] for j in range(1, order + 1)] for i in range(1, order + 1)], float).transpose(2, 0, 1)
            b = np.array([rows[f"y{k}"] for k in range(1, order + 1)], float).T
            yield pd.DataFrame({key: rows[key], "coefficients": [np.linalg.lstsq(m, v, rcond=None)[0].tolist() for m, v in zip(a, b)]})

    return summed.mapInPandas(solve, f"{key} {points.schema[key].dataType.simpleString()}, coefficients array<double>")
