"""Queries on traces, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulselake.functions import arrays as A
from pulselake.operators import analysis as R
from pulselake.operators import spectra as S
from pulselake.plans.tables import HEAD, LENGTH, SEARCH, SQL_TRACES, table, traces

QUERIES: dict = {}
ORACLES: dict = {}


def r6(c, name):
    return F.round(c, 6).alias(name)


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = f"WITH {SQL_TRACES} {sql}"
        return f

    return keep


_PEAK = "p AS (SELECT *, list_max(b[13:25]) AS ph, list_position(b[13:25], list_max(b[13:25])) + 11 AS t_max FROM b)"


@query("mp_peak_by_label", f", {_PEAK} SELECT label, count(*) AS n, round(avg(ph), 6) AS avg_ph, round(stddev_pop(ph), 6) AS sd_ph, round(avg(t_max), 6) AS avg_t_max FROM p GROUP BY label")
def mp_peak_by_label(spark, d):
    low, high = SEARCH
    peak = traces(spark, d).select("label", F.slice(A.remove_constant(F.col("x"), HEAD), low + 1, high - low).alias("s"))
    found = peak.select("label", F.array_max("s").alias("ph"), (F.array_position("s", F.array_max("s")) + low - 1).alias("t_max"))
    return found.groupBy("label").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("ph"), "avg_ph"), r6(F.stddev_pop("ph"), "sd_ph"), r6(F.avg("t_max"), "avg_t_max"))


@query("mp_full", """, s AS (SELECT vec_id, x, list_transform(range(64), lambda i: list_avg(list_transform(range(i - 2, i + 3), lambda j: x[1 + greatest(0, least(63, j))]))) AS s FROM tr),
c AS (SELECT *, list_transform(s, lambda v: v - list_avg(s[1:8])) AS c FROM s),
p AS (SELECT *, list_max(c[13:25]) AS ph, list_position(c[13:25], list_max(c[13:25])) + 11 AS t_max FROM c),
q AS (SELECT *, coalesce(list_max(list_filter(range(63), lambda i: i < t_max AND c[i + 1] < 0.2 * ph)), 63) AS t_0 FROM p)
SELECT vec_id, round(ph, 6) AS ph, CAST(t_0 AS INTEGER) AS t_0, CAST(t_max AS INTEGER) AS t_max,
 CAST(coalesce(list_min(list_filter(range(64), lambda i: i >= t_0 AND i < t_max AND c[i + 1] > 0.8 * ph)), 0) AS INTEGER) AS t_rise,
 CAST(coalesce(list_min(list_filter(range(64), lambda i: i >= t_max AND c[i + 1] < 0.9 * ph)), 63) AS INTEGER) AS t_decaystart,
 CAST(coalesce(list_min(list_filter(range(64), lambda i: i >= t_max AND c[i + 1] < 0.736 * ph)), 63) AS INTEGER) AS t_half,
 CAST(coalesce(list_min(list_filter(range(64), lambda i: i >= t_max AND c[i + 1] < 0.368 * ph)), 63) AS INTEGER) AS t_end,
 round(list_avg(x[1:8]), 6) AS off_set, round((list_avg(s[57:64]) - list_avg(s[1:8])) / 64, 6) AS lin_drift FROM q""")
def mp_full(spark, d):
    mp = traces(spark, d).select("vec_id", A.main_parameters(F.col("x"), LENGTH, 5, HEAD, SEARCH).alias("m"))
    whole = [F.col(f"m.{c}").cast("int").alias(c) for c in ("t_0", "t_max", "t_rise", "t_decaystart", "t_half", "t_end")]
    return mp.select("vec_id", r6(F.col("m.ph"), "ph"), *whole, r6(F.col("m.offset"), "off_set"), r6(F.col("m.lin_drift"), "lin_drift"))


@query("remove_baseline_constant", "SELECT vec_id, round(list_sum(list_transform(b, lambda v: v * v)), 6) AS power, round(b[64], 6) AS last_sample FROM b")
def remove_baseline_constant(spark, d):
    y = traces(spark, d).select("vec_id", A.remove_constant(F.col("x"), HEAD).alias("y"))
    return y.select("vec_id", r6(A.power(F.col("y")), "power"), r6(F.get("y", F.lit(63)), "last_sample"))


_LINE = ", u AS (SELECT vec_id, any_value(x) AS x, regr_slope(v, i) AS slope, regr_intercept(v, i) AS intercept, regr_syy(v, i) - regr_slope(v, i) * regr_sxy(v, i) AS ssr FROM (SELECT vec_id, x, unnest(range(8)) AS i, unnest(x[1:8]) AS v FROM tr) GROUP BY vec_id)"


@query("remove_baseline_linear", _LINE + " SELECT vec_id, round(x[64] - intercept - 63 * slope, 6) AS last_sample, round(slope, 6) AS slope, round(intercept, 6) AS intercept FROM u")
def remove_baseline_linear(spark, d):
    y = traces(spark, d).select("vec_id", A.remove_line(F.col("x"), HEAD).alias("y"), A.line_fit(F.col("x"), HEAD).alias("f"))
    return y.select("vec_id", r6(F.get("y", F.lit(63)), "last_sample"), r6(F.col("f.slope"), "slope"), r6(F.col("f.intercept"), "intercept"))


@query("fit_baseline_rms", _LINE + " SELECT vec_id, round(list_avg(x[1:8]), 6) AS level, round(list_stddev_pop(x[1:8]), 6) AS sd, round(sqrt(greatest(ssr, 0)), 6) AS line_rms FROM u")
def fit_baseline_rms(spark, d):
    y = traces(spark, d).select("vec_id", "x", F.slice(F.col("x"), 1, HEAD).alias("h"))
    return y.select("vec_id", r6(A.mean(F.col("h")), "level"), r6(A.deviation(F.col("h")), "sd"), r6(A.line_residual(F.col("x"), HEAD), "line_rms"))


@query("downsample_mean", "SELECT vec_id, CAST(i AS INTEGER) AS i, round(list_avg(x[4 * i + 1 : 4 * i + 4]), 6) AS v FROM (SELECT vec_id, x, unnest(range(16)) AS i FROM tr)")
def downsample_mean(spark, d):
    return traces(spark, d).select("vec_id", F.posexplode(A.block_means(F.col("x"), LENGTH, 4)).alias("i", "v")).select("vec_id", "i", r6(F.col("v"), "v"))


@query("truncate_trace", "SELECT vec_id, len(x[9:40]) AS n, round(list_sum(x[9:40]), 6) AS area FROM tr")
def truncate_trace(spark, d):
    y = traces(spark, d).select("vec_id", A.truncated(F.col("x"), 8, 40).alias("y"))
    return y.select("vec_id", F.size("y").cast("long").alias("n"), r6(A.total(F.col("y")), "area"))


_WEIGHTS = A.tukey(LENGTH)


@query("tukey_window", f"SELECT vec_id, round(list_inner_product(x, {_WEIGHTS}::DOUBLE[]), 6) AS area FROM tr")
def tukey_window(spark, d):
    return traces(spark, d).select("vec_id", r6(A.total(A.weighted(F.col("x"), _WEIGHTS)), "area"))


@query("box_car", "SELECT vec_id, i, round(list_avg(list_transform(range(i - 4, i + 4), lambda j: x[1 + greatest(0, least(63, j))])), 6) AS v FROM (SELECT vec_id, x, CAST(unnest(range(64)) AS INTEGER) AS i FROM tr)")
def box_car(spark, d):
    return traces(spark, d).select("vec_id", F.posexplode(A.box_car(F.col("x"), LENGTH, 8)).alias("i", "v")).select("vec_id", "i", r6(F.col("v"), "v"))


@query("roll_trace", "SELECT vec_id, round(y[1], 6) AS first_sample, round(list_sum(list_transform(range(64), lambda i: i * y[i + 1])), 6) AS moment FROM (SELECT vec_id, list_concat(x[60:64], x[1:59]) AS y FROM tr)")
def roll_trace(spark, d):
    y = traces(spark, d).select("vec_id", A.rolled(F.col("x"), 5).alias("y"))
    return y.select("vec_id", r6(F.get("y", F.lit(0)), "first_sample"), r6(A.total(F.transform("y", lambda v, i: v * i)), "moment"))


@query("shift_trace", "SELECT vec_id, 3 AS n_missing, round(list_sum(x[4:64]), 6) AS area FROM tr")
def shift_trace(spark, d):
    y = traces(spark, d).select("vec_id", A.shifted(F.col("x"), -3).alias("y"))
    return y.select("vec_id", F.size(F.filter("y", lambda v: v.isNull())).alias("n_missing"), r6(A.total(F.filter("y", lambda v: v.isNotNull())), "area"))


@query("correlated_height", """, q AS (SELECT vec_id // 2 AS pair, max(b) FILTER (vec_id % 2 = 0) AS a, max(b) FILTER (vec_id % 2 = 1) AS c FROM b GROUP BY 1),
p AS (SELECT *, list_position(a, list_max(a)) AS pos FROM q) SELECT pair, CAST(pos - 1 AS INTEGER) AS at_sample, round(list_max(a), 6) AS ph, round(list_max(c[greatest(1, pos - 4) : least(64, pos + 4)]), 6) AS ph_other FROM p""")
def correlated_height(spark, d):
    y = traces(spark, d).select(F.floor(F.col("vec_id") / 2).alias("pair"), (F.col("vec_id") % 2).alias("side"), A.remove_constant(F.col("x"), HEAD).alias("y"))
    out = R.correlated_heights(y, "pair", "side", "y", 0, [1], 4)
    return out.select("pair", "at_sample", r6(F.col("ph"), "ph"), r6(F.col("ph_1"), "ph_other"))


@query("additional_parameters", """SELECT vec_id, round(list_max(b), 6) AS top, round(list_min(b), 6) AS bottom, round(list_avg(b), 6) AS mean, round(list_var_pop(b), 6) AS var,
 round(list_max(d), 6) AS top_step, round(list_min(d), 6) AS bottom_step, round(list_avg(list_transform(b, lambda v: (v - list_avg(b)) ** 3)) / (list_var_pop(b) ** 1.5), 6) AS skew
FROM (SELECT *, list_transform(range(1, 64), lambda i: b[i + 1] - b[i]) AS d FROM b)""")
def additional_parameters(spark, d):
    y = traces(spark, d).select("vec_id", A.remove_constant(F.col("x"), HEAD).alias("y"))
    y = y.withColumn("m", A.mean(F.col("y"))).withColumn("step", F.transform(F.sequence(F.lit(1), F.lit(63)), lambda i: F.get("y", i) - F.get("y", i - 1)))
    moment = lambda p: A.mean(F.transform("y", lambda v: F.pow(v - F.col("m"), F.lit(p))))
    return y.select("vec_id", r6(F.array_max("y"), "top"), r6(F.array_min("y"), "bottom"), r6(F.col("m"), "mean"), r6(moment(2), "var"), r6(F.array_max("step"), "top_step"), r6(F.array_min("step"), "bottom_step"), r6(moment(3) / F.pow(moment(2), F.lit(1.5)), "skew"))


_DFT = """, w AS (SELECT vec_id, label, k, sum(v * cos(2 * pi() * i * k / 64)) AS re, sum(v * sin(2 * pi() * i * k / 64)) AS im
 FROM (SELECT vec_id, label, unnest(range(64)) AS i, unnest(b) AS v FROM b), (SELECT CAST(unnest(range(33)) AS INTEGER) AS k) GROUP BY ALL)"""


@query("noise_power", _DFT + " SELECT k, round(avg(re * re + im * im), 6) AS nps FROM w GROUP BY k")
def noise_power(spark, d):
    return S.noise_power(traces(spark, d).withColumn("one", F.lit(1)), "one", "x", HEAD).select("k", r6(F.col("nps"), "nps"))


_CUT = ", q AS (SELECT quantile_cont(list_stddev_pop(b), 0.7) AS lim FROM b), b2 AS (SELECT b.* FROM b, q WHERE list_stddev_pop(b) <= lim)"


@query("quiet_noise_power", _CUT + _DFT.replace("FROM b)", "FROM b2)") + " SELECT k, round(avg(re * re + im * im), 6) AS nps FROM w GROUP BY k")
def quiet_noise_power(spark, d):
    kept = S.quiet(traces(spark, d).withColumn("one", F.lit(1)), "x", HEAD, 0.7)
    return S.noise_power(kept, "one", "x", HEAD).select("k", r6(F.col("nps"), "nps"))


_SCALE = (sum(v * v for v in _WEIGHTS) / LENGTH) ** 0.5


@query("windowed_noise_power", f", b2 AS (SELECT vec_id, label, list_transform(range(64), lambda i: b[i + 1] * ({_WEIGHTS}::DOUBLE[])[i + 1] / {_SCALE!r}) AS b FROM b)" + _DFT.replace("FROM b)", "FROM b2)") + " SELECT k, round(avg(re * re + im * im), 6) AS nps FROM w GROUP BY k")
def windowed_noise_power(spark, d):
    import numpy as np

    x = traces(spark, d).withColumn("one", F.lit(1))
    return S.noise_power(x, "one", "x", HEAD, np.array(_WEIGHTS)).select("k", r6(F.col("nps"), "nps"))


@query("noise_power_by_label", _DFT + " SELECT label, k, round(avg(re * re + im * im), 6) AS nps FROM w GROUP BY label, k")
def noise_power_by_label(spark, d):
    return S.noise_power(traces(spark, d), "label", "x", HEAD).select("label", "k", r6(F.col("nps"), "nps"))


@query("mean_pulse_by_label", ", m AS (SELECT label, i, avg(v) AS m FROM (SELECT label, CAST(unnest(range(64)) AS INTEGER) AS i, unnest(b) AS v FROM b) GROUP BY label, i) SELECT label, i AS k, round(m / max(m) OVER (PARTITION BY label), 6) AS sev FROM m")
def mean_pulse_by_label(spark, d):
    return S.mean_pulse(traces(spark, d), "label", "x", HEAD).select("label", "k", r6(F.col("sev"), "sev"))


_ANGLE = "2 * pi() * k * (j - 16) / 64"


@query("recurrence_rows", "SELECT vec_id, i, CAST(list_sum(list_transform(range(64), lambda j: (j + 1) * CASE WHEN abs(x[j + 1] - x[i + 1]) < 0.1 THEN 1 ELSE 0 END)) AS BIGINT) AS weight FROM (SELECT vec_id, x, CAST(unnest(range(64)) AS INTEGER) AS i FROM tr)")
def recurrence_rows(spark, d):
    rows = traces(spark, d).select("vec_id", F.posexplode(A.recurrence(F.col("x"), LENGTH, 0.1)).alias("i", "row"))
    return rows.select("vec_id", "i", F.aggregate(F.transform("row", lambda v, j: v * (j + 1)), F.lit(0), lambda a, v: a + v).cast("long").alias("weight"))


_OF = _DFT + f""", nps AS (SELECT k, avg(re * re + im * im) AS n FROM w GROUP BY k), m AS (SELECT i, avg(v) AS m FROM (SELECT unnest(range(64)) AS i, unnest(b) AS v FROM b) GROUP BY i), s AS (SELECT i, m / (SELECT max(m) FROM m) AS s FROM m),
st AS (SELECT k, sum(s * cos(2 * pi() * i * k / 64)) AS a, -sum(s * sin(2 * pi() * i * k / 64)) AS c FROM s, (SELECT unnest(range(33)) AS k) GROUP BY k),
g AS (SELECT j, sum(CASE WHEN k IN (0, 32) THEN 1 ELSE 2 END * CASE WHEN k > 0 THEN 1 / n ELSE 0 END * (a * cos({_ANGLE}) + c * sin({_ANGLE}))) / 64 AS g FROM st JOIN nps USING (k), (SELECT unnest(range(64)) AS j) GROUP BY j),
gl AS (SELECT list(g ORDER BY j) AS g FROM g), sl AS (SELECT list(s ORDER BY i) AS s FROM s),
top AS (SELECT max(y) AS t FROM (SELECT unnest(list_transform(range(64), lambda i: list_sum(list_transform(range(64), lambda j: g[j + 1] * s[1 + (i - j + 64) % 64])))) AS y FROM gl, sl)),
f AS (SELECT vec_id, list_transform(range(64), lambda i: list_sum(list_transform(range(64), lambda j: g[j + 1] / t * x[1 + (i - j + 64) % 64]))) AS y FROM tr, gl, top)"""


@query("matched_amplitudes", _OF + " SELECT vec_id, round(list_max(y[9:56]), 6) AS amplitude, CAST(list_position(y[9:56], list_max(y[9:56])) + 7 AS BIGINT) AS place FROM f")
def matched_amplitudes(spark, d):
    import numpy as np

    x = traces(spark, d).withColumn("one", F.lit(1))
    curve = lambda df, c: np.array([r[0] for r in df.orderBy("k").select(c).collect()])  # noqa: E731  64 and 33 rows
    h = S.matched_filter(curve(S.mean_pulse(x, "one", "x", HEAD), "sev"), curve(S.noise_power(x, "one", "x", HEAD), "nps"), LENGTH // 4)
    found = S.amplitudes(x, "vec_id", "x", h, LENGTH // 8, LENGTH - LENGTH // 8)
    return found.select("vec_id", r6(F.col("amplitude"), "amplitude"), "place")


@query("normalised_features", "SELECT vec_id, round((list_max(x) - list_min(x)), 6) AS span, round(list_avg(list_transform(x, lambda v: (v - list_min(x)) / (list_max(x) - list_min(x)))), 6) AS mean_scaled, round((x[1] - list_avg(x)) / list_stddev_pop(x), 6) AS first_z FROM tr")
def normalised_features(spark, d):
    x = F.col("x")
    return traces(spark, d).select("vec_id", r6(F.array_max(x) - F.array_min(x), "span"), r6(A.mean(A.min_max_scaled(x)), "mean_scaled"), r6(F.get(A.standardised(x), F.lit(0)), "first_z"))


@query("recurrence_share", "SELECT vec_id, CAST(len(list_filter(flatten(list_transform(x, lambda a: list_transform(x, lambda c: abs(a - c) < 0.1))), lambda t: t)) AS INTEGER) AS n_close FROM tr")
def recurrence_share(spark, d):
    return traces(spark, d).select("vec_id", A.close_pairs(F.col("x"), 0.1).alias("n_close"))


@query("one_hot_labels", "SELECT vec_id, CASE WHEN label = 0 THEN 1 ELSE 0 END AS is_0, CASE WHEN label = 1 THEN 1 ELSE 0 END AS is_1, CASE WHEN label > 1 THEN 1 ELSE 0 END AS is_more FROM tr")
def one_hot_labels(spark, d):
    hot = table(spark, d, "embeddings").select("vec_id", A.one_hot(F.col("label"), [0, 1]).alias("h"))
    return hot.select("vec_id", *[F.get("h", F.lit(i)).alias(n) for i, n in enumerate(("is_0", "is_1", "is_more"))])
