"""Recoil spectra of dark matter on nuclei, as Column functions: energies in keV, masses in GeV, rates per kg, day and keV.

The halo is a truncated Maxwellian; the form factor is Helm's in the parametrisation of Lewin and Smith.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Speed of light (m/s), elementary charge (C), proton mass (GeV), local density (GeV/cm3), escape, most
#: probable and solar speed (km/s), hbar c (MeV fm), skin and surface thickness (fm).
LIGHT, CHARGE, PROTON, DENSITY = 299792458.0, 1.60217662e-19, 0.9382720, 0.3
ESCAPE, PROBABLE, SUN = 544.0, 220.0, 231.0
HBAR_C, SKIN, SURFACE = 197.326960, 0.52, 0.9


def erf(x: Column) -> Column:
    """The error function by its power series up to |x| = 3 and its continued fraction beyond; within 1e-12."""
    z = F.abs(x)
    terms = F.aggregate(F.sequence(F.lit(1), F.lit(60)), F.struct(z.alias("t"), z.alias("s")), lambda a, n: F.struct((a["t"] * 2 * z * z / (2 * n + 1)).alias("t"), (a["s"] + a["t"] * 2 * z * z / (2 * n + 1)).alias("s")), lambda a: a["s"])
    series = 2 / math.sqrt(math.pi) * F.exp(-z * z) * terms
    tail = F.aggregate(F.sequence(F.lit(60), F.lit(1), F.lit(-1)), z, lambda a, k: z + k / 2 / a)
    return F.signum(x) * F.when(z <= 3, series).otherwise(1 - F.exp(-z * z) / (math.sqrt(math.pi) * tail))


def form_factor(energy: Column, nucleons: int) -> Column:
    q = F.sqrt(2 * PROTON * nucleons * energy) / HBAR_C
    size = 1.23 * nucleons ** (1 / 3) - 0.6
    radius = math.sqrt(size**2 + 7 / 3 * math.pi**2 * SKIN**2 - 5 * SURFACE**2)
    u = q * radius
    return F.when(energy <= 0, F.lit(1.0)).otherwise(3 * (F.sin(u) - u * F.cos(u)) / F.pow(u, 3) * F.exp(-q * q * SURFACE**2 / 2))


def speed_integral(energy: Column, nucleons: int, mass: float) -> Column:
    """Mean inverse speed (s/km) of the particles that can give a recoil of an energy."""
    nucleus = PROTON * nucleons
    reduced = nucleus * mass / (nucleus + mass)
    escape, drift = ESCAPE / PROBABLE, SUN / PROBABLE
    least = LIGHT / 1000 * F.sqrt(nucleus * energy * 1e-6 / 2) / reduced / PROBABLE
    cut, half = math.exp(-escape**2), math.sqrt(math.pi) / 2
    norm = math.erf(escape) - 2 / math.sqrt(math.pi) * escape * cut
    whole = half * (erf(least + drift) - erf(least - drift)) - 2 * drift * cut
    partly = half * (math.erf(escape) - erf(least - drift)) - (escape + drift - least) * cut
    scale = 1 / (norm * drift * math.sqrt(math.pi) * PROBABLE)
    return scale * F.when(least < escape - drift, whole).when(least < escape + drift, partly).otherwise(0.0)


#: Cross section of one unit in cm2, and what takes 1 / (GeV/c2 s GeV) to 1 / (kg day keV).
UNIT_AREA = 1e-36
PER_KG_DAY_KEV = LIGHT**2 / (1e9 * CHARGE) * 86400 * 1e-6


def interaction_rate(energy: Column, nucleons: int, mass: float | Column) -> Column:
    """Differential rate at a cross section of UNIT_AREA on a proton: rho sigma A^2 F^2 <1/v> / (2 m mu^2)."""
    reduced = PROTON * mass / (PROTON + mass)
    seconds_per_cm = speed_integral(energy, nucleons, mass) * 1e-5
    flux = (LIGHT * 100) ** 2 * DENSITY * UNIT_AREA * seconds_per_cm / (2 * mass * reduced * reduced)
    return flux * (nucleons * form_factor(energy, nucleons)) ** 2 * PER_KG_DAY_KEV


def compound_rate(parts: dict[int, float], mass: float | Column, energy: Column, efficiency: Column | float = 1.0) -> Column:
    """Rate of a compound: mass shares by number of nucleons, times a cut efficiency."""
    total = F.lit(0.0)
    for n, share in parts.items():
        total = total + share * interaction_rate(energy, n, mass)
    return total * efficiency


def recoil_spectrum(spark: SparkSession, parts: dict[int, float], mass: float, low: float, high: float, steps: int = 200) -> DataFrame:
    """energy, rate, share: the rate of a compound (mass share by number of nucleons) and its running share of the whole, on a grid."""
    return spectra(spark, parts, [mass], low, high, steps).drop("mass")


def spectra(spark: SparkSession, parts: dict[int, float], masses: list[float], low: float, high: float, steps: int = 200, efficiencies: DataFrame | None = None) -> DataFrame:
    """mass, energy, rate, share of each mass on a grid. efficiencies (energy, efficiency, few rows): the one nearest in energy counts.

    A mass is one task at most; its rows are the grid's.
    """
    grid = spark.createDataFrame([(float(m),) for m in masses], "mass double").withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))))
    grid = grid.withColumn("energy", low + (F.col("i") + 0.5) * (high - low) / steps)
    efficiency = F.lit(1.0)
    if efficiencies is not None:
        listed = efficiencies.agg(F.array_sort(F.collect_list(F.struct("energy", "efficiency"))).alias("known_")).withColumn("one_", F.lit(1))
        grid = grid.withColumn("one_", F.lit(1)).join(F.broadcast(listed), "one_").drop("one_")
        near = F.array_min(F.transform("known_", lambda k: F.struct(F.abs(k["energy"] - F.col("energy")).alias("d"), k["efficiency"].alias("e"))))
        efficiency = near["e"]
    rated = grid.withColumn("rate", compound_rate(parts, F.col("mass"), F.col("energy"), efficiency))
    line = W.partitionBy("mass").orderBy("energy")
    return rated.select("mass", "energy", "rate", (F.sum("rate").over(line.rowsBetween(W.unboundedPreceding, 0)) / F.sum("rate").over(W.partitionBy("mass"))).alias("share"))


def read_numbers(spark: SparkSession, path: str, names: tuple[str, ...]) -> DataFrame:
    """Columns of numbers from text files with white space between them: ("energy",) of observed events, ("energy", "efficiency") of a cut."""
    parts = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).where("trim(value) <> '' and not startswith(trim(value), '#')")
    return rows.select(*[F.get(parts, F.lit(i)).cast("double").alias(n) for i, n in enumerate(names)])


def log_masses(low: float, high: float, steps: int) -> list[float]:
    return [low * (high / low) ** (i / (steps - 1)) for i in range(steps)]


def upper_limits(spectrum: DataFrame, observed: DataFrame, exposure: float, step: float, confidence: float = 0.9) -> DataFrame:
    """mass, expected (events at the limit), cross_section (in units of UNIT_AREA): the largest share of each mass's spectrum between
    observed energies (energy) gives the number of expected events that `confidence` excludes. exposure in kg days, step of the grid in keV."""
    import numpy as np
    import pandas as pd

    from pulselake.functions.fits import gap_upper_limit

    cells = observed.select(F.col("energy").alias("seen"))
    upper = spectrum.join(F.broadcast(cells), F.col("energy") <= F.col("seen")).groupBy("mass", "seen").agg(F.max("share").alias("at"))
    points = upper.groupBy("mass").agg(F.array_sort(F.collect_list("at")).alias("at"))
    totals = spectrum.groupBy(F.col("mass").alias("m_")).agg((F.sum("rate") * step).alias("total"))
    both = totals.join(points, F.col("m_") == F.col("mass"), "left").select(F.col("m_").alias("mass"), "total", F.coalesce("at", F.array().cast("array<double>")).alias("at"))

    def limits(parts):
        for rows in parts:
            widest = [np.diff(np.concatenate([[0.0], at, [1.0]])) for at in rows["at"]]
            expected = np.array([gap_upper_limit(g, confidence) for g in widest], float)
            yield pd.DataFrame({"mass": rows["mass"], "expected": expected, "cross_section": expected / (exposure * rows["total"])})

    return both.mapInPandas(limits, "mass double, expected double, cross_section double")
