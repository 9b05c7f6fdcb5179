"""Queries on fits, simulation, calibration and evaluation, with their SQL twins."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from pulselake.functions import arrays as A
from pulselake.functions import fits, signal
from pulselake.operators import calibrate, evaluate, imports, ordered, simulate
from pulselake.operators.events import EventSet, LogicalCut
from pulselake.plans.tables import HEAD, LENGTH, SQL_RECORDS, SQL_TRACES, records, table, traces

QUERIES: dict = {}
ORACLES: dict = {}
HOUR = 3_600_000_000
TEMPLATE = fits.pulse_shape(np.arange(float(LENGTH)), LENGTH / 4, 1.0, 0.5, 2.0, 6.0, 15.0)


def r6(c, name):
    return F.round(c, 6).alias(name)


def sql_round(c, digits):
    """c rounded in doubles as SQL does: halves away from zero, and what is rounded to zero keeps its sign."""
    scaled = c * F.lit(10.0**digits)
    size = F.abs(scaled)
    whole = F.signum(scaled) * (F.floor(size) + F.when(size - F.floor(size) >= 0.5, 1.0).otherwise(0.0))
    return F.when(size < float("inf"), F.when(size < 2.0**52, whole).otherwise(scaled) / F.lit(10.0**digits)).otherwise(c)


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


@query("polynomial_baseline", f"WITH {SQL_TRACES}, u AS (SELECT vec_id, unnest(range(8)) AS i, unnest(x[1:8]) AS v FROM tr) SELECT vec_id, round(regr_intercept(v, i), 6) AS c0, round(regr_slope(v, i), 6) AS c1, round(sqrt(greatest(0, regr_syy(v, i) - regr_slope(v, i) * regr_sxy(v, i))), 6) AS rms FROM u GROUP BY vec_id")
def polynomial_baseline(spark, d):
    out = signal.polynomial_baseline(traces(spark, d), "vec_id", "x", 1, HEAD)
    return out.select("vec_id", r6(F.get("coefficients", F.lit(0)), "c0"), r6(F.get("coefficients", F.lit(1)), "c1"), r6(F.col("rms"), "rms"))


_CUBIC = np.linalg.pinv(np.vander(np.arange(float(LENGTH)), 4, increasing=True))


@query("cubic_baseline", f"""WITH {SQL_TRACES}, m AS (SELECT {[[float(v) for v in row] for row in _CUBIC]}::DOUBLE[][] AS p), c AS (SELECT vec_id, x, list_transform(p, lambda q: list_inner_product(q, x)) AS c FROM tr, m)
SELECT vec_id, list_transform(c, lambda v: round(v, 9)) AS coefficients, round(sqrt(list_sum(list_transform(range(64), lambda i: (x[i + 1] - c[1] - c[2] * i - c[3] * i ** 2 - c[4] * i ** 3) ** 2))), 6) AS rms FROM c""")
def cubic_baseline(spark, d):
    out = signal.polynomial_baseline(traces(spark, d), "vec_id", "x", 3, LENGTH)
    return out.select("vec_id", F.transform("coefficients", lambda c: sql_round(c, 9)).alias("coefficients"), sql_round(F.col("rms"), 6).alias("rms"))


@query("template_lags", f"""WITH {SQL_TRACES}, k AS (SELECT {[float(v) for v in TEMPLATE]}::DOUBLE[] AS s), c AS (SELECT vec_id, lag_, list_sum(list_transform(range(greatest(0, lag_), least(64, 64 + lag_)), lambda i: x[i + 1] * s[i - lag_ + 1])) AS c FROM tr, k, (SELECT unnest(range(-63, 64)) AS lag_))
SELECT vec_id, arg_max(lag_, c) AS lag FROM c GROUP BY vec_id""")
def template_lags(spark, d):
    return signal.lags(traces(spark, d), "vec_id", "x", TEMPLATE)


def _shift_tables(reach: int):
    """For each shift of the template: the shift, the row that gives the height, and an orthonormal basis of what is fitted."""
    base = np.vander(np.linspace(-1, 1, LENGTH), 2, increasing=True)
    for by in range(-reach, reach + 1):
        moved = TEMPLATE[np.clip(np.arange(LENGTH) - by, 0, LENGTH - 1)]
        a = np.column_stack([moved, base])
        yield by, np.linalg.pinv(a)[0].tolist(), np.linalg.qr(a)[0].T.tolist()


_SHIFTS = ", ".join(f"({by}, {height}::DOUBLE[], {basis}::DOUBLE[][])" for by, height, basis in _shift_tables(4))


@query("array_fit", f"""WITH {SQL_TRACES}, k(shift, h, basis) AS (VALUES {_SHIFTS}), c AS (SELECT vec_id, x, shift, list_inner_product(h, x) AS height, list_transform(basis, lambda q: list_inner_product(q, x)) AS part, basis FROM tr, k),
e AS (SELECT vec_id, shift, height, sqrt(list_avg(list_transform(range(64), lambda i: (x[i + 1] - basis[1][i + 1] * part[1] - basis[2][i + 1] * part[2] - basis[3][i + 1] * part[3]) ** 2))) AS rms FROM c)
SELECT vec_id, round(height, 6) AS height, shift, round(rms, 6) AS rms FROM e QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY rms, shift) = 1""")
def array_fit(spark, d):
    out = signal.array_fit(traces(spark, d), "vec_id", "x", TEMPLATE, 1, 4)
    return out.select("vec_id", r6(F.col("height"), "height"), "shift", r6(F.col("rms"), "rms"))


@query("peak_counts", f"""WITH {SQL_TRACES}, o AS (SELECT vec_id, i, b[i + 1] > 2 * list_stddev_pop(x[1:8]) AS o, b[i] > 2 * list_stddev_pop(x[1:8]) AS p FROM (SELECT *, unnest(range(8, 64)) AS i FROM b)),
f AS (SELECT vec_id, len(list_reduce(list([i] ORDER BY i), lambda acc, y: CASE WHEN y[1] >= acc[-1] + 6 THEN list_concat(acc, y) ELSE acc END)) AS n FROM o WHERE o AND NOT p GROUP BY vec_id)
SELECT vec_id, coalesce(n, 0) AS n_peaks FROM tr LEFT JOIN f USING (vec_id)""")
def peak_counts(spark, d):
    return signal.peak_counts(traces(spark, d), "vec_id", "x", HEAD, 2.0, 6)


@query("simulated_fit")
def simulated_fit(spark, d):
    """Simulated events fitted with their own template: heights come back."""
    n = table(spark, d, "events").count()
    sim = simulate.simulate(spark, n, TEMPLATE, np.full(LENGTH // 2 + 1, 1e-4), (0.5, 2.0), 3, 11)
    fit = signal.array_fit(sim, "event_idx", "x", TEMPLATE, 1, 4)
    return sim.select("event_idx", r6(F.col("height"), "true_height"), F.col("shift").alias("true_shift")).join(fit.select("event_idx", r6(F.col("height"), "height"), "shift"), "event_idx")


@query("distorted_traces", f"WITH {SQL_TRACES} SELECT vec_id, round(list_sum(list_transform(range(64), lambda i: x[i + 1] + greatest(i - 40, 0) * 0.01)), 6) AS risen, round(list_sum(x) + 4 * 0.5, 6) AS spiked, round(list_sum(list_transform(range(64), lambda i: x[i + 1] + CASE WHEN i >= 32 THEN 0.3 * exp(-(i - 32) / 10.0) ELSE 0 END)), 6) AS jumped, round(list_sum(list_transform(x, lambda v: 2 * (1 / (1 + exp(-1.5 * v)) - 0.5))), 6) AS curbed FROM tr")
def distorted_traces(spark, d):
    x = F.col("x")
    return traces(spark, d).select("vec_id", r6(A.total(simulate.rise(x, 40, 0.01)), "risen"), r6(A.total(simulate.spike(x, 10, 14, 0.5)), "spiked"), r6(A.total(simulate.jump(x, 32, 0.3, 10.0)), "jumped"), r6(A.total(simulate.saturated(x, 2.0, 1.5)), "curbed"))


_PULSER = f"""WITH {SQL_RECORDS}, p AS (SELECT *, CASE WHEN t - lag(t) OVER w > 14400000000 OR lag(t) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM r WHERE kind = 'purchase' WINDOW w AS (PARTITION BY channel ORDER BY t, id)),
i AS (SELECT *, CAST(sum(new) OVER (PARTITION BY channel ORDER BY t, id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS island FROM p),
q AS (SELECT *, min(t) OVER (PARTITION BY channel, island) AS t_first FROM i), z AS (SELECT *, (t - t_first) / 3600000000.0 AS h FROM q)"""


@query("pulser_drift", _PULSER + " SELECT channel, island, floor(tpa) AS tpa, round((CASE WHEN var_pop(h) > 0 THEN regr_slope(value, h) ELSE 0 END), 6) AS slope, round(avg(value) - (CASE WHEN var_pop(h) > 0 THEN regr_slope(value, h) ELSE 0 END) * avg(h), 6) AS intercept FROM z GROUP BY channel, island, floor(tpa)")
def pulser_drift(spark, d):
    pulses = records(spark, d).where("kind = 'purchase'").withColumn("tpa", F.floor("tpa").cast("double"))
    return calibrate.pulser_fits(pulses, 4 * HOUR, float(HOUR)).select("channel", "island", "tpa", r6(F.col("slope"), "slope"), r6(F.col("intercept"), "intercept"))


@query("hash_split", "SELECT part, count(*) AS n FROM (SELECT CASE WHEN p < 0.6 THEN 'train' WHEN p < 0.8 THEN 'validation' ELSE 'test' END AS part FROM (SELECT CAST('0x' || substr(md5('1:' || event_id), 1, 8) AS BIGINT) / 4294967296.0 AS p FROM events)) GROUP BY part")
def hash_split(spark, d):
    part = evaluate.split(F.col("event_id"), {"train": 0.6, "validation": 0.2, "test": 0.2})
    return table(spark, d, "events").groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))


_NAMES = ", ".join(f"({k}, '{v}')" for k, v in evaluate.LABELS.items())


@query("label_names", f"SELECT name, count(*) AS n FROM embeddings LEFT JOIN (VALUES {_NAMES}) AS l(code, name) ON label = code GROUP BY name")
def label_names(spark, d):
    return table(spark, d, "embeddings").groupBy(evaluate.label_name(F.col("label")).alias("name")).agg(F.count(F.lit(1)).alias("n"))


@query("scaled_features", "SELECT event_id, round((value - avg(value) OVER ()) / stddev_pop(value) OVER (), 6) AS value FROM events")
def scaled_features(spark, d):
    return evaluate.scaled(table(spark, d, "events").select("event_id", "value"), ["value"]).select("event_id", r6(F.col("value"), "value"))


@query("principal_components")
def principal_components(spark, d):
    out = evaluate.principal_components(traces(spark, d), "vec_id", "x", 3)
    return out.select("vec_id", F.transform("pc", lambda v: F.round(F.abs(v), 5)).alias("pc"), F.round("error", 5).alias("error"))


@query("accuracy_by_label", "SELECT quality, count(*) AS n, round(avg(CASE WHEN quality = toxic THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM labels GROUP BY quality")
def accuracy_by_label(spark, d):
    return evaluate.accuracy_by_label(table(spark, d, "labels"), "quality", "toxic").select("quality", "n", r6(F.col("accuracy"), "accuracy"))


@query("aligned_triggers", f"WITH {SQL_RECORDS}, f AS (SELECT unnest(list_reduce(list([t] ORDER BY t), lambda acc, x: CASE WHEN x[1] > acc[-1] + 600000000 THEN list_concat(acc, x) ELSE acc END)) AS t FROM r) SELECT min(id) AS id FROM f JOIN r USING (t) GROUP BY t")
def aligned_triggers(spark, d):
    """The triggers of all channels as one line, each blocking those up to ten minutes after it."""
    every = records(spark, d).select("t", "id").withColumn("line", F.lit(0))
    return ordered.dead_time_fold(every, "line", "t", "id", 600_000_000, closed=True).select("id")


_LEADS = "f AS (SELECT unnest(list_reduce(list([t] ORDER BY t), lambda acc, x: CASE WHEN x[1] > acc[-1] + 600000000 THEN list_concat(acc, x) ELSE acc END)) AS t FROM r)"


@query("aligned_amplitudes", f"""WITH {SQL_RECORDS}, {_LEADS}, l AS (SELECT min(id) AS id, t FROM f JOIN r USING (t) GROUP BY t),
a AS (SELECT l.id, r.channel, r.tpa FROM l, r QUALIFY row_number() OVER (PARTITION BY l.id, r.channel ORDER BY abs(r.t - l.t), r.t, r.id) = 1)
SELECT id, list(tpa ORDER BY channel) AS tpas FROM a GROUP BY id""")
def aligned_amplitudes(spark, d):
    """Triggers of all channels in one line, each with the amplitude of the nearest trigger of every channel."""
    return imports.aligned_amplitudes(records(spark, d), 600_000_000).select("id", "tpas")


@query("event_set_algebra", f"WITH {SQL_TRACES}, u AS (SELECT vec_id AS event_idx, b FROM b WHERE label < 5 UNION ALL SELECT vec_id + 1 + (SELECT max(vec_id) FROM tr WHERE label < 5), b FROM b WHERE label >= 5) SELECT event_idx, round(list_max(b), 6) AS top FROM u WHERE b[1] < 0.5")
def event_set_algebra(spark, d):
    x = traces(spark, d).withColumn("channel", F.lit(0)).withColumnRenamed("vec_id", "event_idx")
    sets = [EventSet(x.where(c).drop("label"), 40, LENGTH) for c in ("label < 5", "label >= 5")]
    both = (sets[0] + sets[1]).with_processing(lambda c: A.remove_constant(c, HEAD)).where(F.get("x", F.lit(0)) < 0.5)
    return both.apply(top=lambda c: F.round(F.array_max(c), 6)).drop("channel")


@query("logical_cut", f"WITH {SQL_RECORDS} SELECT count(*) AS total, count(*) FILTER (((value > 30 AND tpa < 9) OR kind = 'signup') AND channel <> 3) AS n_kept FROM r")
def logical_cut(spark, d):
    r = records(spark, d)
    cut = LogicalCut(F.col("value") > 30).add_condition(F.col("tpa") < 9).force_true(r.where("kind = 'signup'")).force_false(r.where("channel = 3"))
    return cut.counts(r, "id")
