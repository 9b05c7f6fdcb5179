"""Queries on pulse parameters, curves, cuts with spans, streams and datasets, with their SQL twins."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from pulselake.functions import arrays as A
from pulselake.functions import curves, parameters, segments, signal
from pulselake.operators import calibrate, cuts, datasets, ordered, simulate
from pulselake.operators.events import EventSet, LogicalCut
from pulselake.plans.tables import HEAD, LENGTH, SEARCH, SQL_RECORDS, SQL_TRACES, records, table, traces
from pulselake.sources.streams import Stream, StreamTime

QUERIES: dict = {}
ORACLES: dict = {}
HOUR, MINUTE, SECOND, START = 3_600_000_000, 60_000_000, 1_000_000, 1_704_067_200_000_000
#: The kernel of a filter for the tests' records: a decaying pulse without its mean.
KERNEL = np.exp(-np.arange(LENGTH) / 6.0) - np.exp(-np.arange(LENGTH) / 6.0).mean()
TRANSFER = np.fft.rfft(KERNEL)


def r6(c, name):
    return F.round(c, 6).alias(name)


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


def numbers(values) -> str:
    return "[" + ", ".join(repr(float(v)) for v in values) + "]::DOUBLE[]"


_SMOOTH = "s AS (SELECT vec_id, x, b, list_transform(range(64), lambda i: list_avg(list_transform(range(i - 2, i + 3), lambda j: b[1 + greatest(0, least(63, j))]))) AS s FROM b)"
_LEGACY = f"""WITH {SQL_TRACES}, {_SMOOTH}, d AS (SELECT *, list_avg(x[1:8]) AS off_set, (list_avg(s[57:64]) - list_avg(s[1:8])) / 64 AS drift, list_max(s[13:25]) AS ph FROM s),
n AS (SELECT *, list_transform(range(64), lambda i: s[i + 1] - drift * i) AS nd FROM d), m AS (SELECT *, list_position(nd[13:25], list_max(nd[13:25])) + 11 AS t_max FROM n), l AS (SELECT *, s[t_max + 1] AS lv FROM m),
a AS (SELECT *, coalesce(list_max(list_filter(range(64), lambda i: i < t_max AND s[i + 1] < 0.2 * lv)), 0) AS t_zero, coalesce(list_min(list_filter(range(64), lambda i: i >= t_max AND s[i + 1] < 0.368 * lv)), 63) AS t_end FROM l),
c AS (SELECT *, coalesce(list_min(list_filter(range(64), lambda i: i >= t_zero AND s[i + 1] > 0.8 * lv)), t_zero) AS t_rise, coalesce(list_max(list_filter(range(64), lambda i: i <= t_end AND s[i + 1] > 0.736 * lv)), t_end) AS t_half FROM a),
e AS (SELECT *, coalesce(list_max(list_filter(range(64), lambda i: i <= t_half AND s[i + 1] > 0.9 * lv)), t_half) AS t_decaystart FROM c)"""


def _main(spark, d):
    return parameters.main_parameters(traces(spark, d), "vec_id", "x", (SEARCH[0], SEARCH[1]), edge=8, smooth=5)


@query("legacy_parameters", _LEGACY + " SELECT vec_id, round(ph, 6) AS ph, t_zero, t_rise, t_max, t_decaystart, t_half, t_end, round(off_set, 6) AS off_set, round(drift, 6) AS drift FROM e")
def legacy_parameters(spark, d):
    return _main(spark, d).select("vec_id", r6(F.col("pulse_height"), "ph"), "t_zero", "t_rise", "t_max", "t_decaystart", "t_half", "t_end", r6(F.col("offset"), "off_set"), r6(F.col("linear_drift"), "drift"))


@query("phase_lengths", _LEGACY + " SELECT vec_id, t_rise - t_zero AS rise, t_decaystart - t_rise AS peak, t_half - t_decaystart AS first_half, t_end - t_half AS second_half, t_end - t_decaystart AS decay FROM e")
def phase_lengths(spark, d):
    gap = lambda a, b: F.col(a) - F.col(b)
    return _main(spark, d).select("vec_id", gap("t_rise", "t_zero").alias("rise"), gap("t_decaystart", "t_rise").alias("peak"), gap("t_half", "t_decaystart").alias("first_half"), gap("t_end", "t_half").alias("second_half"), gap("t_end", "t_decaystart").alias("decay"))


_FILTERED = f"k AS (SELECT {numbers(KERNEL)} AS g), f AS (SELECT q.*, list_transform(range(64), lambda i: list_sum(list_transform(range(64), lambda j: g[j + 1] * b[1 + (i - j + 64) % 64]))) AS y FROM s q, k)"


@query("additional_numbers", f"""WITH {SQL_TRACES}, {_SMOOTH}, {_FILTERED}, t AS (SELECT *, list_transform(range(63), lambda i: s[i + 2] - s[i + 1]) AS st FROM f),
p AS (SELECT *, list_position(y[9:56], list_max(y[9:56])) + 7 AS pk FROM t)
SELECT vec_id, round(list_max(s), 6) AS top, round(list_min(s), 6) AS bottom, round(list_var_pop(s[1:8]), 6) AS var_start, round(list_avg(s[1:8]), 6) AS mean_start, round(list_var_pop(s[57:64]), 6) AS var_end, round(list_avg(s[57:64]), 6) AS mean_end,
 round(list_var_pop(s), 6) AS var, round(list_avg(s), 6) AS mean, round(list_avg(list_transform(s, lambda c: (c - list_avg(s)) ** 3)) / list_var_pop(s) ** 1.5, 6) AS skew, round(list_max(st), 6) AS top_step, CAST(list_position(st, list_max(st)) - 1 AS BIGINT) AS top_step_at,
 round(list_min(st), 6) AS bottom_step, CAST(list_position(st, list_min(st)) - 1 AS BIGINT) AS bottom_step_at, round(list_max(y[9:56]), 6) AS filtered_top, CAST(pk AS BIGINT) AS filtered_at FROM p""")
def additional_numbers(spark, d):
    """All but the skewness of the filtered samples, which is of any size where they are not positive; a test holds that against plain numpy."""
    out = parameters.additional_parameters(traces(spark, d), "vec_id", "x", TRANSFER, 1, 5)
    return out.select("vec_id", *[F.col(c) if c.endswith("_at") else r6(F.col(c), c) for c in parameters.ADDITIONAL if c != "filtered_skew"])


@query("filter_residuals", f"""WITH {SQL_TRACES}, k AS (SELECT {numbers(KERNEL)} AS g), p AS (SELECT g, list_transform(range(64), lambda i: list_sum(list_transform(range(64), lambda j: g[j + 1] * g[1 + (i - j + 64) % 64]))) AS w FROM k),
f AS (SELECT vec_id, w, list_position(w, list_max(w)) - 1 AS home, list_transform(range(64), lambda i: list_sum(list_transform(range(64), lambda j: g[j + 1] * x[1 + (i - j + 64) % 64]))) AS y FROM tr, p),
h AS (SELECT *, list_max(y) AS top, list_position(y, list_max(y)) - 1 AS pk FROM f)
SELECT vec_id, round(top, 6) AS amplitude, CAST(pk AS BIGINT) AS place, round(list_avg(list_transform(range(64), lambda i: (y[i + 1] - top * w[1 + (i - pk + home + 128) % 64]) ** 2)), 4) AS rms FROM h""")
def filter_residuals(spark, d):
    out = parameters.residual_rms(traces(spark, d), "vec_id", "x", TRANSFER, KERNEL)
    return out.select("vec_id", r6(F.col("amplitude"), "amplitude"), "place", F.round("rms", 4).alias("rms"))


@query("curve_values", f"""WITH {SQL_RECORDS}, v AS (SELECT id, value AS x, tpa AS t FROM r)
SELECT id, round(3 * exp(-0.05 * x) + 1, 6) AS decay, round(0.5 + exp(-0.2 * t), 6) AS baseline, round(100 / (12 * sqrt(2 * pi())) * exp(-((x - 50) ** 2) / (2 * 12 ** 2)), 6) AS bell, round(1 + 0.5 * t - 0.02 * t ** 2 + 0.001 * t ** 3, 6) AS cubic,
 round(CASE WHEN t > 2 THEN 1.5 * (exp(-(t - 2) / 1.0) - exp(-(t - 2) / 0.4)) + 0.7 * (exp(-(t - 2) / 5.0) - exp(-(t - 2) / 1.0)) ELSE 0 END, 6) AS two,
 round(CASE WHEN t > 1 THEN -1.0 * (exp(-(t - 1) / 0.3) - exp(-(t - 1) / 2.0)) + 0.5 * (exp(-(t - 1) / 3.0) - exp(-(t - 1) / 2.0)) + 0.25 * (exp(-(t - 1) / 8.0) - exp(-(t - 1) / 2.0)) ELSE 0 END, 6) AS three,
 round(0.1 + 0.2 * t + 2 * (CASE WHEN t > 2.5 THEN 1.5 * (exp(-(t - 2.5) / 1.0) - exp(-(t - 2.5) / 0.4)) + 0.7 * (exp(-(t - 2.5) / 5.0) - exp(-(t - 2.5) / 1.0)) ELSE 0 END), 6) AS on_baseline FROM v""")
def curve_values(spark, d):
    x, t = F.col("value"), F.col("tpa")
    shape = (1.5, 0.7, 1.0, 0.4, 5.0)
    columns = {"decay": curves.exponential_decay(x, 3.0, 0.05, 1.0), "baseline": curves.exponential_baseline(t, 0.5, -0.2), "bell": curves.gauss(x, 100.0, 50.0, 12.0), "cubic": curves.cubic(t, (1.0, 0.5, -0.02, 0.001))}
    columns |= {"two": curves.pulse(t, 2.0, *shape), "three": curves.pulse(t, 1.0, 1.0, 0.5, 0.25, 0.3, 3.0, 8.0, 2.0), "on_baseline": curves.pulse_on_baseline(t, 2.0, 0.5, (0.1, 0.2, 0.0, 0.0), 2.0, *shape)}
    return records(spark, d).select("id", *[r6(c, name) for name, c in columns.items()])


_LOGIT = "({a} + ({k} - {a}) / ({c} + {q} * exp(-{b} * {x})) ** (1 / {nu}))"
_P = {"k": "8.0", "c": "1.2", "q": "0.9", "b": "0.4", "nu": "1.5"}
_A0, _S0 = "(8.0 / (1 - (1.2 + 0.9) ** (1 / 1.5)))", "(0.4 * 0.9 * (8.0 - 0.5) * (1.2 + 0.9) ** (-1 / 1.5 - 1) / 1.5)"


@query("logistic_family", f"WITH {SQL_RECORDS} SELECT id, round({_LOGIT.format(a='0.5', x='tpa', **_P)}, 6) AS plain, round({_LOGIT.format(a=_A0, x='tpa', **_P)}, 6) AS through_zero, round({_LOGIT.format(a='0.5', x=f'(tpa / {_S0})', **_P)}, 6) AS unit_slope FROM r")
def logistic_family(spark, d):
    t, p = F.col("tpa"), (8.0, 1.2, 0.9, 0.4, 1.5)
    return records(spark, d).select("id", r6(curves.logistic(t, 0.5, *p), "plain"), r6(curves.logistic_through_zero(t, *p), "through_zero"), r6(curves.logistic_of_unit_slope(t, 0.5, *p), "unit_slope"))


@query("adaptive_segments", f"""WITH RECURSIVE {SQL_TRACES}, seg AS (SELECT vec_id, x, 0 AS a, 64 AS b, 0 AS level FROM tr UNION ALL
 SELECT vec_id, x, unnest([a, CAST(b - (b - a) // 2 AS INTEGER)]) AS a, unnest([CAST(a + (b - a) // 2 AS INTEGER), b]) AS b, level + 1 FROM (SELECT *, list_avg(list_transform(range(b - a), lambda i: abs(x[a + 1] + (x[b] - x[a + 1]) * i / (b - a) - x[a + i + 1]))) AS far FROM seg) WHERE far > 0.15 AND b - a > 1)
SELECT vec_id, count(*) AS n, CAST(sum(a * b) AS BIGINT) AS places FROM (SELECT *, list_avg(list_transform(range(b - a), lambda i: abs(x[a + 1] + (x[b] - x[a + 1]) * i / (b - a) - x[a + i + 1]))) AS far FROM seg) WHERE far <= 0.15 OR b - a = 1 GROUP BY vec_id""")
def adaptive_segments(spark, d):
    cut = segments.segmented(traces(spark, d), "vec_id", "x", 0.15)
    products = F.aggregate(F.zip_with("starts", "ends", lambda a, b: a * b), F.lit(0).cast("long"), lambda t, v: t + v)
    return cut.select("vec_id", F.size("starts").cast("long").alias("n"), products.alias("places"))


@query("trace_icons", f"""WITH {SQL_TRACES}, u AS (SELECT vec_id, x, list_transform(x, lambda v: v - list_min(x)) AS y FROM tr), p AS (SELECT vec_id, CAST(floor(i / 64.0 * 15) AS BIGINT) AS px, 15 - CAST(floor(y[i + 1] / list_max(y) * 15) AS BIGINT) AS py FROM (SELECT *, unnest(range(64)) AS i FROM u)),
c AS (SELECT vec_id, px, py, least(1.0, 0.25 * count(*)) AS shade FROM p GROUP BY ALL)
SELECT vec_id, px, py, CAST(round(shade / max(shade) OVER (PARTITION BY vec_id), 6) AS DOUBLE) AS shade FROM c""")
def trace_icons(spark, d):
    drawn = segments.pictures(traces(spark, d), "vec_id", "x", 16, 0.25)
    pixels = drawn.select("vec_id", F.posexplode("icon").alias("i", "shade")).where("shade > 0")
    return pixels.select("vec_id", (F.col("i") % 16).cast("long").alias("px"), F.floor(F.col("i") / 16).alias("py"), r6(F.col("shade"), "shade"))


_SLOT, _ZERO = 600 * SECOND, "1704067200000000"
_RATE = f"""WITH {SQL_RECORDS}, w AS (SELECT CAST(ceil((max(t) - {_ZERO}) / {float(_SLOT)}) AS BIGINT) - 1 AS n FROM r WHERE kind <> 'click'),
s AS (SELECT CASE WHEN t - {_ZERO} = n * {_SLOT} THEN n - 1 ELSE (t - {_ZERO}) // {_SLOT} END AS slot, count(*) FILTER (kind <> 'click') AS n, count(*) FILTER (kind = 'click') AS n_control FROM r, w WHERE t - {_ZERO} <= w.n * {_SLOT} GROUP BY 1),
m AS (SELECT quantile_cont(n_control, 0.5) AS med FROM s WHERE n_control > 0), u AS (SELECT s.*, n BETWEEN 1 AND 60 AND n_control > med / 2 AS usable FROM s, m),
q AS (SELECT quantile_cont(n, 0.5) AS mu FROM u WHERE usable), c AS (SELECT k, sum(p) OVER (ORDER BY k) AS cdf FROM (SELECT k, exp(k * ln(mu) - mu - lgamma(k + 1)) AS p FROM q, (SELECT unnest(range(400)) AS k))),
lim AS (SELECT min(k) FILTER (cdf >= {cuts.normal_cdf(-1.0)!r}) AS lo, min(k) FILTER (cdf >= {cuts.normal_cdf(1.0)!r}) AS hi FROM c),
g AS (SELECT slot, n, n_control, usable AND n BETWEEN lo AND hi AS good FROM u, lim)"""
_SPANS = f", runs AS (SELECT min(slot) * {_SLOT} + {_ZERO} AS start, (max(slot) + 1) * {_SLOT} + {_ZERO} AS stop FROM (SELECT slot, slot - row_number() OVER (ORDER BY slot) AS run FROM g WHERE good) GROUP BY run)"


def _slots(spark, d):
    return cuts.rate_slots(records(spark, d), "t", F.col("kind") == "click", _SLOT, START, 1, 60, 1.0)


@query("poisson_rate_slots", _RATE + " SELECT slot, n, n_control, good FROM g")
def poisson_rate_slots(spark, d):
    return _slots(spark, d)


@query("poisson_rate_spans", _RATE + _SPANS + " SELECT * FROM runs")
def poisson_rate_spans(spark, d):
    return cuts.spans_of_slots(_slots(spark, d), _SLOT, START)


@query("poisson_rate_flags", _RATE + _SPANS + " SELECT id, EXISTS (SELECT 1 FROM runs WHERE t >= start AND t <= stop) AS good FROM r")
def poisson_rate_flags(spark, d):
    return cuts.in_good_slots(records(spark, d), "t", _slots(spark, d), _SLOT, START).select("id", "good")


_UNSTABLE = f"""WITH {SQL_RECORDS}, p AS (SELECT id, channel, t, value FROM r WHERE kind = 'click'), st AS (SELECT channel, avg(value) AS m, stddev_pop(value) AS sd FROM p WHERE value > 2 AND value < 140 GROUP BY channel),
q AS (SELECT p.*, value > 2 AND value < 140 AND abs(value - m) < 1.2 * sd AS good FROM p LEFT JOIN st USING (channel)),
o AS (SELECT *, good OR row_number() OVER w = 1 OR row_number() OVER (PARTITION BY channel ORDER BY t DESC, id DESC) = 1 AS g FROM q WINDOW w AS (PARTITION BY channel ORDER BY t, id)),
n AS (SELECT *, lag(g) OVER w AS pg, lag(t) OVER w AS pt, min(CASE WHEN g THEN t END) OVER (PARTITION BY channel ORDER BY t, id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nt FROM o WINDOW w AS (PARTITION BY channel ORDER BY t, id)),
iv AS (SELECT channel, t AS start, nt AS stop FROM n WHERE NOT g AND pg UNION ALL SELECT channel, pt, t FROM n WHERE g AND pg AND t - pt > 7200000000),
k AS (SELECT *, CASE WHEN lag(stop) OVER (PARTITION BY channel ORDER BY start, stop) = start THEN 0 ELSE 1 END AS new FROM iv), z AS (SELECT *, sum(new) OVER (PARTITION BY channel ORDER BY start, stop ROWS UNBOUNDED PRECEDING) AS run FROM k),
spans AS (SELECT channel, min(start) AS start, max(stop) AS stop FROM z GROUP BY channel, run)"""


def _spans(spark, d):
    pulses = cuts.within_deviations(records(spark, d).where("kind = 'click'"), ["channel"], "value", 1.2, 2.0, 140.0)
    return cuts.unstable_spans(pulses, "channel", "t", "id", 2 * HOUR)


@query("unstable_spans", _UNSTABLE + " SELECT * FROM spans")
def unstable_spans(spark, d):
    return _spans(spark, d)


@query("stable_events", _UNSTABLE + " SELECT id, NOT EXISTS (SELECT 1 FROM spans s WHERE s.channel = r.channel AND t > start AND t < stop) AS stable FROM r WHERE kind = 'view'")
def stable_events(spark, d):
    return cuts.outside_spans(records(spark, d).where("kind = 'view'"), "channel", "t", "id", _spans(spark, d)).select("id", "stable")


@query("stable_test_pulses", f"""WITH {SQL_RECORDS}, p AS (SELECT id, floor(tpa) AS tpa, value FROM r WHERE kind = 'purchase' AND value > 3), s AS (SELECT tpa, avg(value) AS m, stddev_pop(value) AS sd FROM p GROUP BY tpa)
SELECT id, coalesce(abs(value - m) < 1.5 * sd, false) AS good FROM p LEFT JOIN s USING (tpa)""")
def stable_test_pulses(spark, d):
    pulses = records(spark, d).where("kind = 'purchase' and value > 3").withColumn("tpa", F.floor("tpa"))
    return cuts.within_deviations(pulses, ["tpa"], "value", 1.5).select("id", "good")


def _interpolated(x: str, knots: list[float], values: list[float]) -> str:
    parts = [f"WHEN {x} < {b} THEN {p} + ({x} - {a}) * {(q - p) / (b - a)!r}" for a, b, p, q in zip(knots, knots[1:], values, values[1:])]
    return f"CASE WHEN {x} <= {knots[0]} THEN {values[0]} {' '.join(parts)} ELSE {values[-1]} END"


_REGION = ([1.0, 4.0, 9.0], [5.0, 20.0, 10.0], [70.0, 120.0, 60.0])


@query("outside_polyline", f"WITH {SQL_RECORDS} SELECT id, NOT (tpa BETWEEN 1 AND 9 AND value <= {_interpolated('tpa', _REGION[0], _REGION[2])} AND value >= {_interpolated('tpa', _REGION[0], _REGION[1])}) AS is_outside FROM r")
def outside_polyline(spark, d):
    return records(spark, d).select("id", curves.outside(F.col("tpa"), F.col("value"), *_REGION).alias("is_outside"))


@query("event_slices", f"WITH {SQL_TRACES}, e AS (SELECT vec_id AS i, x[1] AS v, (SELECT max(vec_id) FROM tr) + 1 AS n FROM tr) SELECT 'slice' AS part, count(*) AS n, round(sum(v), 6) AS total FROM e WHERE i >= 10 AND i < n - 5 AND (i - 10) % 3 = 0 UNION ALL SELECT 'numbers', count(*), round(sum(v), 6) FROM e WHERE i IN (0, 7, n - 1, n - 2) UNION ALL SELECT 'flags', count(*), round(sum(v), 6) FROM e WHERE i % 2 = 0 UNION ALL SELECT 'sum', count(*), round(sum(v), 6) FROM (SELECT * FROM e WHERE i < 20 UNION ALL SELECT * FROM e WHERE i < 20 UNION ALL SELECT * FROM e WHERE i < 20)")
def event_slices(spark, d):
    x = traces(spark, d).select(F.lit(0).alias("channel"), F.col("vec_id").alias("event_idx"), "x")
    events = EventSet(x, 40, LENGTH)
    n, few = events.count(), EventSet(x, 40, LENGTH)[0, :20]
    parts = {"slice": events[0, 10:-5:3], "numbers": events[0, [0, 7, -1, -2]], "flags": events[0, [i % 2 == 0 for i in range(n)]], "sum": sum([few, few, few])}
    out = [e.df.agg(F.lit(name).alias("part"), F.count(F.lit(1)).alias("n"), r6(F.sum(F.get("x", F.lit(0))), "total")) for name, e in parts.items()]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


@query("cut_complement", f"WITH {SQL_RECORDS} SELECT id FROM r WHERE NOT coalesce(((value > 30 AND tpa < 9) OR kind = 'signup') AND channel <> 3, false)")
def cut_complement(spark, d):
    r = records(spark, d)
    cut = LogicalCut(F.col("value") > 30).add_condition(F.col("tpa") < 9).force_true(r.where("kind = 'signup'").select("id")).force_false(r.where("channel = 3").select("id"))
    return cut.numbers(r, False, "id")


@query("averaged_rows", f"WITH {SQL_RECORDS}, p AS (SELECT *, (row_number() OVER (PARTITION BY channel ORDER BY t, id) - 1) // 8 AS place FROM r) SELECT channel, place, min(t) AS first, max(t) AS last, round(avg(value), 6) AS value FROM p GROUP BY channel, place HAVING count(*) = 8")
def averaged_rows(spark, d):
    out = ordered.averaged(records(spark, d), "channel", ("t", "id"), "value", 8)
    return out.select("channel", "place", "first", "last", r6(F.col("value"), "value"))


@query("peak_triggers", f"""WITH {SQL_TRACES}, i AS (SELECT vec_id, x, unnest(range(64)) AS i FROM tr),
m AS (SELECT vec_id, x, i, x[i + 1] AS v, CASE WHEN i < 12 THEN x[1:12] ELSE x[i - 11 : i] END AS w FROM i), o AS (SELECT vec_id, i, x, v, list_avg(w) AS m, list_stddev_samp(w) AS sd FROM m), c AS (SELECT * FROM o WHERE v - m > 1.8 * sd),
f AS (SELECT vec_id, unnest(list_reduce(list([i] ORDER BY i), lambda acc, y: CASE WHEN y[1] >= acc[-1] + 6 THEN list_concat(acc, y) ELSE acc END)) AS i FROM c GROUP BY vec_id),
h AS (SELECT c.vec_id, c.i, list_max(x[c.i + 1 : c.i + 6]) AS top, list_position(x[c.i + 1 : c.i + 6], list_max(x[c.i + 1 : c.i + 6])) - 1 + c.i AS place, m, sd FROM c JOIN f ON c.vec_id = f.vec_id AND c.i = f.i)
SELECT vec_id, CAST(place AS BIGINT) AS place, round(top - 2 * sd - m, 6) AS height FROM h""")
def peak_triggers(spark, d):
    out = signal.peak_triggers(traces(spark, d), "vec_id", "x", 12, 1.8, 6)
    return out.select("vec_id", F.explode(F.arrays_zip("places", "heights")).alias("p")).select("vec_id", F.col("p.places").alias("place"), r6(F.col("p.heights"), "height"))


#: The records as a stream of two channels in chunks: heights, and amplitudes of test pulses.
CHUNK = 512


def _stream(spark, d) -> Stream:
    placed = records(spark, d).select("id", F.explode(F.array(F.struct(F.lit("height").alias("channel"), F.col("value").alias("v")), F.struct(F.lit("pulser").alias("channel"), F.col("tpa").alias("v")))).alias("c"))
    cut = placed.groupBy("c.channel", (F.floor(F.col("id") / CHUNK) * CHUNK).alias("start")).agg(F.array_sort(F.collect_list(F.struct("id", "c.v"))).alias("s"))
    n = records(spark, d).agg(F.max("id")).first()[0] or 0
    return Stream(cut.select("channel", "start", F.transform("s", lambda r: r["v"]).alias("samples")), CHUNK, StreamTime(START, 40, n + 1))


@query("channel_sum_samples", f"WITH {SQL_RECORDS} SELECT id, round(value + tpa, 6) AS total FROM r")
def channel_sum_samples(spark, d):
    added = _stream(spark, d).sum().chunks
    at = added.select("start", F.posexplode("samples").alias("i", "v"))
    base = records(spark, d).agg(F.min("id").alias("first_")).first()["first_"] % CHUNK
    return at.select((F.col("start") + F.col("i") + F.when(F.col("start") == 0, base).otherwise(0)).alias("id"), r6(F.col("v"), "total"))


@query("stream_slice", f"WITH {SQL_RECORDS}, o AS (SELECT id - (SELECT min(id) FROM r) AS i, value FROM r) SELECT count(*) AS n, round(sum(value), 6) AS total FROM o WHERE i >= 600 AND i < 900 AND (i - 600) % 7 = 0")
def stream_slice(spark, d):
    first = records(spark, d).agg(F.min("id")).first()[0]
    moved = _stream_from_zero(spark, d, first)
    cut = moved["height", 600:900:7]
    return cut.select(F.size("samples").cast("long").alias("n"), r6(A.total(F.col("samples")), "total"))


def _stream_from_zero(spark, d, first: int) -> Stream:
    """The heights as a stream whose first sample is the first record."""
    placed = records(spark, d).select((F.col("id") - first).alias("i"), "value")
    cut = placed.groupBy((F.floor(F.col("i") / CHUNK) * CHUNK).alias("start")).agg(F.array_sort(F.collect_list(F.struct("i", "value"))).alias("s"))
    n = placed.agg(F.max("i")).first()[0] + 1
    return Stream(cut.select(F.lit("height").alias("channel"), "start", F.transform("s", lambda r: r["value"]).alias("samples")), CHUNK, StreamTime(START, 40, n))


@query("padded_windows", f"""WITH {SQL_RECORDS}, o AS (SELECT id - (SELECT min(id) FROM r) AS i, value, kind FROM r), n AS (SELECT count(*) AS n FROM o), p AS (SELECT i FROM o WHERE kind = 'purchase'),
w AS (SELECT p.i AS place, j, greatest(least(p.i - 8, n - 32), 0) AS low, p.i - 8 AS want FROM p, n, (SELECT unnest(range(32)) AS j)), a AS (SELECT place, j, low + greatest(least(j + want - low, 31), 0) AS i FROM w)
SELECT place, round(sum(value), 6) AS area FROM a JOIN o USING (i) GROUP BY place""")
def padded_windows(spark, d):
    first = records(spark, d).agg(F.min("id")).first()[0]
    stream = _stream_from_zero(spark, d, first)
    asked = records(spark, d).where("kind = 'purchase'").select(F.lit("height").alias("channel"), (F.col("id") - first).alias("place"))
    return stream.windows(asked, 32, 8, pad=True).select("place", r6(A.total(F.col("window")), "area"))


@query("stream_times", f"WITH {SQL_RECORDS} SELECT id, (t - {_ZERO}) // 40 AS place, make_timestamp(t) AS time, t AS stamp FROM r")
def stream_times(spark, d):
    time = StreamTime(START, 40, 1 << 62)
    t = F.col("t")
    return records(spark, d).select("id", time.place_of(t).alias("place"), time.as_datetime(t).cast("timestamp_ntz").alias("time"), time.as_stamp(time.as_datetime(t)).alias("stamp"))


@query("event_samples", """SELECT l_orderkey AS event_idx, max(l_quantity) FILTER (l_linenumber = 1) AS l_quantity_ch1, max(CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END) FILTER (l_linenumber = 1) AS l_returnflag_ch1_is_A,
 max(l_quantity) FILTER (l_linenumber = 2) AS l_quantity_ch2, max(CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END) FILTER (l_linenumber = 2) AS l_returnflag_ch2_is_A FROM lineitem WHERE l_linenumber IN (1, 2) GROUP BY l_orderkey""")
def event_samples(spark, d):
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("event_idx"), F.col("l_linenumber").alias("channel"), "l_quantity", "l_returnflag")
    return datasets.samples(lines, {"l_quantity": None, "l_returnflag": None}, [1, 2], {"l_returnflag": ["A"]})


@query("prediction_confusion", "SELECT quality AS label, toxic AS prediction, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY quality), 6) AS share FROM labels GROUP BY 1, 2")
def prediction_confusion(spark, d):
    events = table(spark, d, "labels").select(F.lit(0).alias("channel"), F.col("doc_id").alias("event_idx"), F.array(F.col("quality").cast("double")).alias("features"), F.col("quality").alias("label"), "toxic")
    found = datasets.Evaluation().add_events(events, 0).with_prediction("rule", events.select(F.lit(0).alias("file_nbr"), "event_idx", F.col("toxic").alias("prediction")))
    return found.confusion("rule").select("label", "prediction", "n", r6(F.col("share"), "share"))


@query("feature_vectors", f"WITH {SQL_TRACES} SELECT vec_id, len(x) + 2 AS n, round(list_sum(x) + label + vec_id, 6) AS total FROM tr")
def feature_vectors(spark, d):
    x = traces(spark, d)
    both = x.select("vec_id", datasets.stacked_features(x, ["label", "x", "vec_id"]).alias("v"))
    return both.select("vec_id", F.size("v").cast("long").alias("n"), r6(A.total(F.col("v")), "total"))


@query("square_and_ramp", f"WITH {SQL_TRACES} SELECT vec_id, round(list_sum(x) + 0.5 * (11 + 5), 6) AS squared, round(list_sum(list_transform(range(64), lambda i: x[i + 1] + 0.8 * least(greatest((i - 30) / 6.0, 0), 1))), 6) AS ramped, round(list_sum(list_transform(x, lambda v: v * 2.5 + 1)), 6) AS scaled FROM tr")
def square_and_ramp(spark, d):
    x = F.col("x")
    return traces(spark, d).select("vec_id", r6(A.total(simulate.square_wave(x, 0.5, [(10, 20), (40, 44)])), "squared"), r6(A.total(simulate.ramp_jump(x, 30, 0.8, 6)), "ramped"), r6(A.total(F.transform(x, lambda v: simulate.scaled_back(v, 1.0, 2.5))), "scaled"))


_PULSES = f"""WITH {SQL_RECORDS}, p AS (SELECT *, CASE WHEN t - lag(t) OVER w > 14400000000 OR lag(t) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM r WHERE kind = 'purchase' WINDOW w AS (PARTITION BY channel ORDER BY t, id)),
i AS (SELECT *, CAST(sum(new) OVER (PARTITION BY channel ORDER BY t, id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS island FROM p), z AS (SELECT *, (t - min(t) OVER (PARTITION BY channel, island)) / 3600000000.0 AS h, min(t) OVER (PARTITION BY channel, island) AS t_first FROM i),
f AS (SELECT channel, island, any_value(t_first) AS t_first, floor(tpa) + 1 AS tpa, avg(value) AS m, coalesce(CASE WHEN var_pop(h) > 0 THEN regr_slope(value, h) END, 0) AS slope, avg(h) AS mh FROM z GROUP BY channel, island, floor(tpa) + 1)"""


@query("unsaturated_fits", _PULSES + """, s AS (SELECT channel, island, min(tpa) AS first FROM f WHERE tpa <> 3 AND m >= 80 GROUP BY channel, island)
SELECT channel, island, tpa, round(slope, 6) AS slope, round(m - slope * mh, 6) AS intercept FROM f LEFT JOIN s USING (channel, island) WHERE tpa <> 3 AND (first IS NULL OR tpa < first)""")
def unsaturated_fits(spark, d):
    pulses = records(spark, d).where("kind = 'purchase'").withColumn("tpa", F.floor("tpa").cast("double") + 1)
    fits = calibrate.pulser_fits(pulses, 4 * HOUR, float(HOUR), 80.0, (3.0,))
    return fits.select("channel", "island", "tpa", r6(F.col("slope"), "slope"), r6(F.col("intercept"), "intercept"))


@query("calibrated_amplitudes", _PULSES + """, e AS (SELECT r.id, r.channel, r.t, r.value, coalesce((SELECT max(island) FROM f WHERE f.channel = r.channel AND f.t_first <= r.t), (SELECT min(island) FROM f WHERE f.channel = r.channel)) AS island FROM r WHERE kind = 'view'),
k AS (SELECT e.id, e.value, list_sort(list_concat([{'h': 0.0::DOUBLE, 'tpa': 0.0::DOUBLE}], list({'h': m - slope * mh + slope * (e.t - t_first) / 3600000000.0, 'tpa': f.tpa::DOUBLE}))) AS ks FROM e JOIN f ON e.channel = f.channel AND e.island = f.island GROUP BY e.id, e.value, e.t),
a AS (SELECT *, least(greatest(len(list_filter(ks, lambda q: q.h <= value)) - 1, 0), len(ks) - 2) + 1 AS pk FROM k)
SELECT id, round(CASE WHEN ks[pk + 1].h <> ks[pk].h THEN ks[pk].tpa + (value - ks[pk].h) / (ks[pk + 1].h - ks[pk].h) * (ks[pk + 1].tpa - ks[pk].tpa) ELSE ks[pk].tpa END, 6) AS tpa FROM a""")
def calibrated_amplitudes(spark, d):
    pulses = records(spark, d).where("kind = 'purchase'").withColumn("tpa", F.floor("tpa").cast("double") + 1)
    found = calibrate.EnergyCalibration(pulses, 4 * HOUR, float(HOUR))(records(spark, d).where("kind = 'view'"))
    return found.select("id", r6(F.col("tpa"), "tpa"))


_T = "[" + ", ".join(repr(calibrate.student_quantile(0.68, n)) for n in range(1, 201)) + "]::DOUBLE[]"


@query("student_bands", f"""WITH {SQL_RECORDS}, h AS (SELECT floor(tpa) AS tpa, value, (t - {_ZERO}) / 3600000000.0 AS h FROM r WHERE kind = 'purchase'),
f AS (SELECT tpa, regr_count(value, h) AS n, regr_slope(value, h) AS b, regr_intercept(value, h) AS a, regr_avgx(value, h) AS mx, regr_sxx(value, h) AS sxx, regr_syy(value, h) AS syy, regr_sxy(value, h) AS sxy FROM h GROUP BY tpa),
g AS (SELECT *, sqrt(greatest(syy - b * sxy, 0) / (n - 2)) AS s, CASE WHEN n - 2 <= 200 THEN ({_T})[n - 2] ELSE 0.994457883209753 + (0.994457883209753 ** 3 + 0.994457883209753) / (4 * (n - 2)) END AS q FROM f WHERE n > 2)
SELECT tpa, round(a + b * 12, 6) AS middle, round(q * s * sqrt(1.0 / n + (12 - mx) ** 2 / sxx), 5) AS confidence, round(q * s * sqrt(1 + 1.0 / n + (12 - mx) ** 2 / sxx), 5) AS prediction FROM g""")
def student_bands(spark, d):
    hours = records(spark, d).where("kind = 'purchase'").select(F.floor("tpa").alias("tpa"), "value", ((F.col("t") - START) / HOUR).alias("h"))
    middle, confidence, prediction = calibrate.band_at(F.lit(12.0), calibrate.student_column(0.68, F.col("n") - 2))
    return calibrate.line_bands(hours, "tpa", "h", "value").select("tpa", r6(middle, "middle"), F.round(confidence, 5).alias("confidence"), F.round(prediction, 5).alias("prediction"))


@query("frames", f"WITH {SQL_RECORDS} SELECT id // 4000 AS frame, (id % 4000) // 10 AS place, value FROM r WHERE (id % 4000) % 10 = 0")
def frames(spark, d):
    """Every frame of 4000 samples, of each tenth sample; a viewer picks one."""
    at = F.col("id") % 4000
    return records(spark, d).where(at % 10 == 0).select(F.floor(F.col("id") / 4000).alias("frame"), F.floor(at / 10).alias("place"), "value")
