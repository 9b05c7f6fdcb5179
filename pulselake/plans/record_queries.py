"""Queries on records, with their SQL twins."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pulselake.functions import arrays as A
from pulselake.functions import curves
from pulselake.operators import analysis as R
from pulselake.operators import calibrate, evaluate, imports, triggering
from pulselake.operators import joins as J
from pulselake.operators import ordered as O
from pulselake.plans.tables import SQL_RECORDS, records, table
from pulselake.sources.streams import StreamTime

QUERIES: dict = {}
ORACLES: dict = {}
HOUR, MINUTE, SECOND = 3_600_000_000, 60_000_000, 1_000_000


def r6(c, name):
    return F.round(c, 6).alias(name)


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = f"WITH RECURSIVE {SQL_RECORDS} {sql}"
        return f

    return keep


def kind(spark, d, name):
    return records(spark, d).where(F.col("kind") == name)


@query("adc_round_trip", "SELECT id, round(value / 20 * 65536 + 0.0, 6) + 0 AS counts, round(value, 6) AS volts FROM (SELECT id, value + 10 - 10 AS value FROM r)")
def adc_round_trip(spark, d):
    n = records(spark, d).withColumn("n", A.to_counts(F.col("value")))
    return n.select("id", r6(F.col("n"), "counts"), r6(A.to_volts(F.col("n")), "volts"))


@query("stamps_to_time", ", m AS (SELECT min(t) AS t0 FROM r) SELECT id, round((t - t0) / 3600000000.0, 6) AS hours, t // 1000000 AS time_s, t % 1000000 AS time_mus FROM r, m")
def stamps_to_time(spark, d):
    return R.with_hours(records(spark, d)).select("id", r6(F.col("hours"), "hours"), "time_s", "time_mus")


@query("stream_time_index", "SELECT id, (t - 1704067200000000) // 40 AS place, 1704067200000000 + ((t - 1704067200000000) // 40) * 40 AS stamp FROM r")
def stream_time_index(spark, d):
    time = StreamTime(1_704_067_200_000_000, 40, 1 << 62)
    place = time.place_of(F.col("t"))
    return records(spark, d).select("id", place.alias("place"), time.stamp_of(place).alias("stamp"))


@query("coincidence_inside", "SELECT b.id AS b_id, a.id AS a_id FROM r a JOIN r b ON a.kind = 'purchase' AND b.kind = 'view' AND b.t >= a.t - 5000000 AND b.t < a.t + 20000000")
def coincidence_inside(spark, d):
    return J.coincidence(kind(spark, d, "purchase"), kind(spark, d, "view"), -5 * SECOND, 20 * SECOND)


@query("coincidence_outside", "SELECT b.id FROM r b WHERE b.kind = 'view' AND NOT EXISTS (SELECT 1 FROM r a WHERE a.kind = 'purchase' AND b.t >= a.t - 5000000 AND b.t < a.t + 20000000)")
def coincidence_outside(spark, d):
    return J.not_coincident(kind(spark, d, "purchase"), kind(spark, d, "view"), -5 * SECOND, 20 * SECOND).select("id")


_NEAR = "near AS (SELECT a.id AS a_id, b.id AS b_id, b.t - a.t AS dt, row_number() OVER (PARTITION BY a.id ORDER BY abs(b.t - a.t), b.t, b.id) AS place FROM r a JOIN r b ON a.channel = b.channel AND a.kind = '{}' AND b.kind = '{}')"


@query("nearest_trigger", f", {_NEAR.format('view', 'purchase')} SELECT a_id, b_id, dt FROM near WHERE place = 1")
def nearest_trigger(spark, d):
    return J.nearest(kind(spark, d, "view"), kind(spark, d, "purchase"), "channel")


@query("exclude_test_pulses", f""", {_NEAR.format('purchase', 'view')}, span AS (SELECT channel, min(t) AS f, max(t) AS l FROM r WHERE kind = 'purchase' GROUP BY channel)
SELECT id, id NOT IN (SELECT b_id FROM near WHERE place = 1 AND abs(dt) < 600000000) AND coalesce(t BETWEEN f AND l, false) AS keep FROM r LEFT JOIN span USING (channel) WHERE kind = 'view'""")
def exclude_test_pulses(spark, d):
    return J.exclude_near(kind(spark, d, "view"), kind(spark, d, "purchase"), "channel", 600 * SECOND).select("id", "keep")


@query("coincident_channels", "SELECT channels, count(*) AS n FROM (SELECT list_sort(list_distinct(list(l_linenumber))) AS channels FROM lineitem GROUP BY l_orderkey) GROUP BY channels")
def coincident_channels(spark, d):
    return J.coincident_channels(table(spark, d, "lineitem"), "l_orderkey", "l_linenumber")


@query("trigger_windows", "SELECT a.id, round(sum(b.value), 6) AS area, round(max(b.value), 6) AS top, count(*) AS n FROM r a JOIN r b ON a.kind = 'purchase' AND b.id >= a.id - 8 AND b.id < a.id + 24 GROUP BY a.id HAVING count(*) = 32")
def trigger_windows(spark, d):
    asked = kind(spark, d, "purchase").select(F.lit(0).alias("channel"), F.col("id").alias("place"))
    cut = triggering.cut_windows(_stream(spark, d), asked, CHUNK, 32, 8)
    return cut.select(F.col("place").alias("id"), r6(A.total(F.col("window")), "area"), r6(F.array_max("window"), "top"), F.size("window").cast("long").alias("n"))


_Z = "z AS (SELECT *, CASE WHEN count(value) OVER w = 20 AND stddev_pop(value) OVER w > 0 THEN (value - avg(value) OVER w) / stddev_pop(value) OVER w END AS z FROM r WINDOW w AS (PARTITION BY channel ORDER BY t, id ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING))"


@query("rolling_zscore", f", {_Z} SELECT id, round(z, 6) AS z FROM z WHERE z > 2.5")
def rolling_zscore(spark, d):
    return O.rolling_zscore(records(spark, d), "channel", ["t", "id"], "value", 20).where("z > 2.5").select("id", r6(F.col("z"), "z"))


@query("dead_time_fold")
def dead_time_fold(spark, d):
    return O.dead_time_fold(records(spark, d).select("channel", "t", "id"), "channel", "t", "id", HOUR).select("id", "channel")


ORACLES["dead_time_fold"] = f"""WITH {SQL_RECORDS}, f AS (SELECT channel, unnest(list_reduce(list([t] ORDER BY t), lambda acc, x: CASE WHEN x[1] >= acc[-1] + 3600000000 THEN list_concat(acc, x) ELSE acc END)) AS t FROM r GROUP BY channel)
SELECT min(id) AS id, channel FROM f JOIN r USING (channel, t) GROUP BY channel, t"""


@query("exponential_trigger", f""", o AS (SELECT id, channel, value, row_number() OVER (PARTITION BY channel ORDER BY t, id) AS n FROM r), e AS (
 SELECT id, channel, n, value AS fast, value AS slow, 0.0::DOUBLE AS var, false AS fired FROM o WHERE n = 1 UNION ALL
 SELECT o.id, o.channel, o.n, {math.exp(-1 / 5)!r} * fast + {1 - math.exp(-1 / 5)!r} * value, {math.exp(-1 / 50)!r} * slow + {1 - math.exp(-1 / 50)!r} * value, {math.exp(-1 / 50)!r} * var + {1 - math.exp(-1 / 50)!r} * (value - slow) ** 2,
  var > 0 AND abs({math.exp(-1 / 5)!r} * fast + {1 - math.exp(-1 / 5)!r} * value - slow) > 2 * sqrt(var) FROM e JOIN o ON o.channel = e.channel AND o.n = e.n + 1)
SELECT id, round(fast, 6) AS fast, round(slow, 6) AS slow, fired FROM e""")
def exponential_trigger(spark, d):
    out = O.exponential_trigger(records(spark, d).select("channel", "t", "id", "value"), "channel", ["t", "id"], "value", 5.0, 50.0, 2.0)
    return out.select("id", r6(F.col("fast"), "fast"), r6(F.col("slow"), "slow"), "fired")


@query("rate_cut", """, s AS (SELECT t // 600000000 AS slot, count(*) FILTER (kind <> 'click') AS n, count(*) FILTER (kind = 'click') AS c FROM r GROUP BY 1),
m AS (SELECT quantile_cont(c, 0.5) AS med FROM s WHERE c > 0), u AS (SELECT s.*, n BETWEEN 1 AND 60 AND c > med / 2 AS ok FROM s, m), v AS (SELECT avg(n) AS a, stddev_pop(n) AS sd FROM u WHERE ok)
SELECT slot, n, ok AND abs(n - a) <= 1.5 * sd AS good FROM u, v""")
def rate_cut(spark, d):
    return O.rate_cut(records(spark, d), "t", F.col("kind") == "click", 600 * SECOND, 1, 60, 1.5)


def _stable(name, key):
    return f"""SELECT id, abs(value - m) <= 1.5 * sd AND coalesce(t - p, 0) <= 7200000000 AS good
FROM (SELECT *, avg(value) OVER (PARTITION BY {key}) AS m, stddev_pop(value) OVER (PARTITION BY {key}) AS sd, lag(t) OVER (PARTITION BY {key} ORDER BY t, id) AS p FROM r WHERE kind = '{name}')"""


@query("control_pulse_stability", _stable("click", "channel"))
def control_pulse_stability(spark, d):
    return O.stable_runs(kind(spark, d, "click"), "channel", "t", "id", "value", 1.5, 2 * HOUR).select("id", "good")


@query("test_pulse_stability", _stable("purchase", "tpa"))
def test_pulse_stability(spark, d):
    return O.stable_runs(kind(spark, d, "purchase"), "tpa", "t", "id", "value", 1.5, 2 * HOUR).select("id", "good")


@query("outside_band", "SELECT id, NOT (tpa BETWEEN 1 AND 9 AND value BETWEEN 10 + 2 * tpa AND 60 + 5 * tpa) AS is_outside FROM r")
def outside_band(spark, d):
    return records(spark, d).select("id", curves.outside(F.col("tpa"), F.col("value"), [1.0, 9.0], [12.0, 28.0], [65.0, 105.0]).alias("is_outside"))


@query("logical_cut_counts", "SELECT channel, count(*) AS total, count(*) FILTER (ok) AS n_kept, count(*) FILTER (NOT ok) AS n_cut FROM (SELECT channel, value > 20 AND tpa < 8 AND kind <> 'error' AS ok FROM r) GROUP BY channel")
def logical_cut_counts(spark, d):
    ok = (F.col("value") > 20) & (F.col("tpa") < 8) & (F.col("kind") != "error")
    return records(spark, d).groupBy("channel").agg(F.count(F.lit(1)).alias("total"), F.count_if(ok).alias("n_kept"), F.count_if(~ok).alias("n_cut"))


@query("forced_flags", "SELECT id FROM r WHERE (value > 50 OR id IN (SELECT id FROM r WHERE tpa = 5)) AND id NOT IN (SELECT id FROM r WHERE tpa > 9)")
def forced_flags(spark, d):
    r = records(spark, d)
    kept = r.where("value > 50").select("id").unionByName(r.where("tpa = 5").select("id")).distinct()
    return kept.join(r.where("tpa > 9").select("id"), "id", "left_anti")


@query("start_stop_by_origin", "SELECT o_orderpriority AS origin, min(epoch_us(o_orderdate)) AS t_first, max(epoch_us(o_orderdate)) AS t_last, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS first_key, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS last_key FROM orders GROUP BY 1")
def start_stop_by_origin(spark, d):
    t = F.unix_micros(F.col("o_orderdate").cast("timestamp"))
    return R.start_stop(table(spark, d, "orders").withColumnRenamed("o_orderpriority", "origin"), "origin", t, "o_orderkey")


_ISLES = "g AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY channel ORDER BY t, id) > 1800000000 OR lag(t) OVER (PARTITION BY channel ORDER BY t, id) IS NULL THEN 1 ELSE 0 END AS new FROM r), i AS (SELECT *, CAST(sum(new) OVER (PARTITION BY channel ORDER BY t, id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS island FROM g)"


@query("interval_split", f", {_ISLES} SELECT channel, island, min(t) AS t_first, max(t) AS t_last, count(*) AS n FROM i GROUP BY channel, island")
def interval_split(spark, d):
    return O.split_at_gaps(records(spark, d), "channel", "t", "id", 1800 * SECOND)


@query("pulser_linear_fit", "SELECT tpa, count(*) AS n, round(regr_slope(value, (t - 1704067200000000) / 3600000000.0), 6) AS slope, round(regr_intercept(value, (t - 1704067200000000) / 3600000000.0), 6) AS intercept FROM r WHERE kind = 'purchase' GROUP BY tpa HAVING count(*) > 2")
def pulser_linear_fit(spark, d):
    hours = (F.col("t") - 1_704_067_200_000_000) / HOUR
    fit = kind(spark, d, "purchase").groupBy("tpa").agg(F.count(F.lit(1)).alias("n"), r6(F.regr_slope("value", hours), "slope"), r6(F.regr_intercept("value", hours), "intercept"))
    return fit.where("n > 2")


_KNOTS = "k AS (SELECT *, lead(h) OVER (ORDER BY h) AS h2, lead(tpa) OVER (ORDER BY h) AS tpa2 FROM (SELECT tpa, 20 * tpa + count(*) / 1000.0 AS h FROM r WHERE kind = 'purchase' GROUP BY tpa))"


@query("pulser_predict", f", {_KNOTS} SELECT r.id, round(k.tpa + (r.value - h) * (tpa2 - k.tpa) / (h2 - h), 6) AS tpa_equivalent FROM r JOIN k ON r.kind = 'view' AND r.value >= h AND r.value < h2")
def pulser_predict(spark, d):
    knots = kind(spark, d, "purchase").groupBy("tpa").agg((F.count(F.lit(1)) / 1000.0).alias("c")).select((20 * F.col("tpa") + F.col("c")).alias("h"), F.col("tpa").alias("at"))
    return R.between_knots(kind(spark, d, "view"), "value", knots, 2.0).select("id", r6(F.col("at"), "tpa_equivalent"))


_LY = "SELECT p.l_orderkey, round({}, 6) AS {} FROM lineitem p JOIN lineitem l ON p.l_orderkey = l.l_orderkey AND p.l_linenumber = 1 AND l.l_linenumber = 2"


def _channels(spark, d):
    side = lambda n, name: table(spark, d, "lineitem").where(F.col("l_linenumber") == n).select("l_orderkey", F.col("l_extendedprice").alias(name))
    return side(1, "p").join(side(2, "l"), "l_orderkey")


@query("light_correction", ", z AS (" + _LY.format("0.1 * l.l_extendedprice + 0.9 * p.l_extendedprice", "energy") + ") SELECT * FROM z")
def light_correction(spark, d):
    return _channels(spark, d).select("l_orderkey", r6(curves.mixed_energy(F.col("p"), F.col("l"), 0.1), "energy"))


@query("light_yield", ", z AS (" + _LY.format("l.l_extendedprice / p.l_extendedprice", "light_yield") + ") SELECT * FROM z")
def light_yield(spark, d):
    return _channels(spark, d).select("l_orderkey", r6(F.col("l") / F.col("p"), "light_yield"))


@query("efficiency_histogram", "SELECT CAST(floor(value / 25) AS BIGINT) AS bin, count(*) AS n_all, count(*) FILTER (tpa < 5) AS n_left, round(count(*) FILTER (tpa < 5) / count(*), 6) AS efficiency FROM r GROUP BY 1")
def efficiency_histogram(spark, d):
    out = R.efficiency(records(spark, d), F.col("value"), 25.0, F.col("tpa") < 5)
    return out.withColumn("efficiency", F.round("efficiency", 6))


@query("density_2d", "SELECT CAST(floor(l_quantity / 5) AS BIGINT) AS x, CAST(floor(l_extendedprice / 5000) AS BIGINT) AS y, count(*) AS n, round(log10(count(*)), 6) AS log_n FROM lineitem GROUP BY 1, 2")
def density_2d(spark, d):
    out = R.density(table(spark, d, "lineitem"), F.col("l_quantity"), F.col("l_extendedprice"), 5.0, 5000.0)
    return out.withColumn("log_n", F.round("log_n", 6))


@query("histogram_by_kind", "SELECT kind, CAST(floor(value / 10) AS BIGINT) AS bin, count(*) AS n FROM r GROUP BY 1, 2")
def histogram_by_kind(spark, d):
    return R.histogram(records(spark, d), F.col("value"), 10.0, ["kind"])


@query("resolution", "SELECT tpa, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS sd, round(stddev_pop(value) * tpa / avg(value), 6) AS resolution FROM r WHERE kind = 'purchase' GROUP BY tpa")
def resolution(spark, d):
    out = R.resolution(kind(spark, d, "purchase"), "tpa", "value")
    return out.select("tpa", "n", r6(F.col("mean"), "mean"), r6(F.col("sd"), "sd"), r6(F.col("resolution"), "resolution"))


@query("exposure", "SELECT channel, round(sum(CASE WHEN p IS NOT NULL THEN least(t - p, 600000000) END) / 3600000000.0, 6) AS live_hours, count(*) FILTER (t - p > 600000000) AS n_gaps FROM (SELECT channel, t, lag(t) OVER (PARTITION BY channel ORDER BY t, id) AS p FROM r WHERE kind = 'click') GROUP BY channel")
def exposure(spark, d):
    live = R.exposure(kind(spark, d, "click"), "channel", "t", "id", 600 * SECOND)
    return live.select("channel", r6(F.col("live_hours"), "live_hours"), "n_gaps")


@query("largest_gap", "SELECT channel, round(max(value - p), 6) AS gap FROM (SELECT channel, value, lag(value, 1, 0) OVER (PARTITION BY channel ORDER BY value, id) AS p FROM r) GROUP BY channel")
def largest_gap(spark, d):
    gaps = O.since_previous(records(spark, d), "channel", "value", "id", 10)
    return gaps.select("channel", F.coalesce("since_", "value").alias("g")).groupBy("channel").agg(r6(F.max("g"), "gap"))


@query("noise_rate_curve", ", h AS (SELECT CAST(floor(value / 5) AS BIGINT) AS bin, count(*) AS n FROM r WHERE kind = 'error' GROUP BY 1) SELECT bin, n, CAST(sum(n) OVER (ORDER BY bin DESC) AS BIGINT) AS n_above FROM h")
def noise_rate_curve(spark, d):
    return R.counts_above(kind(spark, d, "error"), F.col("value"), 5.0)


@query("noise_gaps", "SELECT channel, id, t - p - 120000000 AS room FROM (SELECT channel, id, t, lag(t) OVER (PARTITION BY channel ORDER BY t, id) AS p FROM r) WHERE t - p >= 240000000")
def noise_gaps(spark, d):
    since = O.since_previous(records(spark, d), "channel", "t", "id").withColumnRenamed("since_", "since")
    return since.where(F.col("since") >= 240 * SECOND).select("channel", "id", (F.col("since") - 120 * SECOND).alias("room"))


@query("noise_windows", """SELECT channel, p + 120000000 + i * 60000000 AS start FROM (SELECT *, unnest(range((t - p - 240000000) // 60000000)) AS i FROM (SELECT channel, t, lag(t) OVER (PARTITION BY channel ORDER BY t, id) AS p FROM r) WHERE t - p >= 300000000)""")
def noise_windows(spark, d):
    return R.noise_windows(records(spark, d), "channel", "t", "id", 60 * SECOND, 120 * SECOND)


@query("routed_records", """, a AS (SELECT l_orderkey, list(l_tax * 100) AS a FROM lineitem GROUP BY 1) SELECT l_orderkey, CASE WHEN len(list_filter(a, lambda v: v > 7)) > 0 THEN 'control pulse' WHEN len(list_filter(a, lambda v: v > 3 AND v <= 7)) > 0 THEN 'test pulse' ELSE 'particle' END AS any_class,
 CASE WHEN len(list_filter(a, lambda v: v > 7)) = len(a) THEN 'control pulse' WHEN len(list_filter(a, lambda v: v > 3 AND v <= 7)) = len(a) THEN 'test pulse' ELSE 'particle' END AS every_class FROM a""")
def routed_records(spark, d):
    tpas = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.col("l_tax") * 100).alias("a"))
    return tpas.select("l_orderkey", R.class_of_amplitudes(F.col("a"), 3.0, 7.0).alias("any_class"), R.class_of_amplitudes(F.col("a"), 3.0, 7.0, True).alias("every_class"))


@query("confusion_matrix", "SELECT quality, count(*) FILTER (toxic = 0) AS predicted_0, count(*) FILTER (toxic = 1) AS predicted_1 FROM labels GROUP BY quality")
def confusion_matrix(spark, d):
    return R.confusion(table(spark, d, "labels"), "quality", "toxic", [0, 1])


@query("label_distribution", "SELECT quality, toxic, count(*) AS n FROM labels GROUP BY 1, 2")
def label_distribution(spark, d):
    return R.label_counts(table(spark, d, "labels"), "quality", "toxic")


@query("accuracy_by_height", ", h AS (SELECT toxic = 1 - quality AS hit, n_chars, (row_number() OVER (ORDER BY n_chars, doc_id) - 1) // 40 AS bin FROM labels JOIN documents USING (doc_id)) SELECT bin, count(*) AS n, round(avg(n_chars), 6) AS mean_height, round(avg(CASE WHEN hit THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM h GROUP BY bin")
def accuracy_by_height(spark, d):
    h = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    out = evaluate.equal_count_accuracy(h, "n_chars", "doc_id", F.col("toxic") == 1 - F.col("quality"), 40)
    return out.select("bin", "n", r6(F.col("mean_height"), "mean_height"), r6(F.col("accuracy"), "accuracy"))


@query("union_with_origin", ", u AS (SELECT 'first' AS origin, id, value FROM r WHERE id % 2 = 0 UNION ALL SELECT 'second', id + 1000000, value FROM r WHERE id % 2 = 1) SELECT origin, count(*) AS n, max(id) AS last_id, round(sum(value), 4) AS total FROM u GROUP BY origin")
def union_with_origin(spark, d):
    r = records(spark, d).select("id", "value")
    both = r.where("id % 2 = 0").withColumn("origin", F.lit("first")).unionByName(r.where("id % 2 = 1").select((F.col("id") + 1_000_000).alias("id"), "value").withColumn("origin", F.lit("second")))
    return both.groupBy("origin").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("last_id"), F.round(F.sum("value"), 4).alias("total"))


@query("shrink_by_flag", "SELECT id, kind, value FROM r WHERE value > 100 AND kind IN ('view', 'purchase')")
def shrink_by_flag(spark, d):
    return records(spark, d).where((F.col("value") > 100) & F.col("kind").isin("view", "purchase")).select("id", "kind", "value")


@query("moment_peaks", "SELECT id, CASE WHEN value > m + 2 * s THEN 1 WHEN value < m - 2 * s THEN -1 ELSE 0 END AS peak FROM (SELECT id, value, avg(value) OVER w AS m, stddev_samp(value) OVER w AS s, count(*) OVER w AS n FROM r WINDOW w AS (PARTITION BY channel ORDER BY t, id ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING)) WHERE n = 30")
def moment_peaks(spark, d):
    rows, by = O.framed(records(spark, d), "channel", "t", "id", 30)
    frame = W.partitionBy(*by).orderBy("place_").rowsBetween(-30, -1)
    m = rows.withColumn("m", F.avg("value").over(frame)).withColumn("s", F.stddev_samp("value").over(frame)).withColumn("n", F.count(F.lit(1)).over(frame)).where("n = 30 and own_")
    return m.select("id", F.when(F.col("value") > F.col("m") + 2 * F.col("s"), 1).when(F.col("value") < F.col("m") - 2 * F.col("s"), -1).otherwise(0).alias("peak"))


@query("record_classes", "SELECT CASE WHEN tpa = 0 THEN 'particle' WHEN tpa <= 5 THEN 'test pulse' ELSE 'control pulse' END AS class, count(*) AS n, round(avg(value), 6) AS mean FROM r GROUP BY 1")
def record_classes(spark, d):
    return records(spark, d).groupBy(R.class_of_amplitude(F.col("tpa"), 5.0).alias("class")).agg(F.count(F.lit(1)).alias("n"), r6(F.avg("value"), "mean"))


@query("logistic_saturation", "SELECT id, round(10 / (1 + exp(-0.05 * (value - 60))) - 10 / (1 + exp(0.05 * 60)), 6) AS height FROM r WHERE kind = 'purchase'")
def logistic_saturation(spark, d):
    return kind(spark, d, "purchase").select("id", r6(10 / (1 + F.exp(-0.05 * (F.col("value") - 60))) - F.lit(10) / (1 + F.exp(F.lit(3.0))), "height"))


#: The heights of the records in order, as one stream in chunks.
CHUNK, RECORD = 512, 32


def _stream(spark, d):
    placed = records(spark, d).select(F.lit(0).alias("channel"), (F.floor(F.col("id") / CHUNK) * CHUNK).alias("start"), "id", "value")
    cut = placed.groupBy("channel", "start").agg(F.array_sort(F.collect_list(F.struct("id", "value"))).alias("s"))
    return cut.select("channel", "start", F.transform("s", lambda r: r["value"]).alias("samples"))


#: From scores s(id, y): each place over the threshold with its record's peak (q), then the chain of records from the first one on (c).
_CHAIN = """n AS (SELECT count(*) AS n FROM r), o AS (SELECT id FROM s, n WHERE y > {0} AND id >= 32 AND id < n - 33),
p AS (SELECT o.id, first(s.id ORDER BY s.y DESC, s.id) AS peak, max(s.y) AS y FROM o JOIN s ON s.id >= o.id AND s.id < o.id + 32 GROUP BY o.id),
q AS (SELECT p.*, o.id AS later FROM p ASOF LEFT JOIN o ON p.peak + 17 <= o.id), c AS (SELECT min(id) AS id FROM q UNION ALL SELECT later FROM c JOIN q USING (id) WHERE later IS NOT NULL)"""
_RESPONSE = np.fft.irfft(np.conj(np.fft.rfft(np.exp(-np.arange(RECORD) / 4.0))) * (np.arange(RECORD // 2 + 1) > 0), RECORD)


@query("filter_trigger", f""", s AS (SELECT id, list_inner_product(list(value) OVER (ORDER BY id ROWS 31 PRECEDING), {[float(v) for v in _RESPONSE[::-1]]}::DOUBLE[]) AS y FROM r QUALIFY count(*) OVER (ORDER BY id ROWS 31 PRECEDING) = 32), {_CHAIN.format(60)}
SELECT 0 AS channel, peak AS place, round(y, 6) AS height FROM c JOIN q USING (id)""")
def filter_trigger(spark, d):
    """Records whose stream, through a matched filter of a decaying pulse, passes a threshold; tested against a plain loop."""
    transfer = np.conj(np.fft.rfft(np.exp(-np.arange(RECORD) / 4.0)))
    transfer[0] = 0
    found = triggering.triggers(_stream(spark, d), CHUNK, RECORD, 60.0, triggering.filter_score(transfer))
    return found.select("channel", "place", r6(F.col("height"), "height"))


@query("deviation_trigger", f""", s AS (SELECT id, value, CASE WHEN stddev_pop(value) OVER w > 0 THEN (value - avg(value) OVER w) / stddev_pop(value) OVER w ELSE -1e300 END AS y FROM r WINDOW w AS (ORDER BY id ROWS BETWEEN 32 PRECEDING AND 1 PRECEDING)), {_CHAIN.format(2.5)},
h AS (SELECT q.peak, max(s.value) FILTER (s.id BETWEEN q.peak - 2 AND q.peak + 3) - avg(s.value) FILTER (s.id < q.peak - 4) AS height FROM q JOIN s ON s.id >= q.peak - 8 AND s.id < q.peak + 24 GROUP BY q.id, q.peak HAVING count(*) = 32)
SELECT 0 AS channel, peak AS place, round(y, 6) AS score, round(height, 6) AS pulse_height FROM c JOIN q USING (id) LEFT JOIN (SELECT DISTINCT * FROM h) AS h USING (peak)""")
def deviation_trigger(spark, d):
    """Records that stand out from those before them, with the height of the pulse around them where the stream holds it whole."""
    stream = _stream(spark, d)
    found = triggering.triggers(stream, CHUNK, RECORD, 2.5, triggering.deviation_score)
    heights = triggering.pulse_heights(stream, found.select("channel", "place"), CHUNK, RECORD)
    return found.join(heights, ["channel", "place"], "left").select("channel", "place", r6(F.col("height"), "score"), r6(F.col("pulse_height"), "pulse_height"))


@query("chunk_windows", "SELECT a.id, round(sum(b.value), 6) AS area, round(arg_max(b.value, b.id), 6) AS last_sample FROM r a JOIN r b ON a.kind = 'purchase' AND b.id >= a.id - 8 AND b.id < a.id + 24 GROUP BY a.id HAVING count(*) = 32")
def chunk_windows(spark, d):
    asked = kind(spark, d, "purchase").select(F.lit(0).alias("channel"), F.col("id").alias("place"))
    cut = triggering.cut_windows(_stream(spark, d), asked, CHUNK, RECORD, 8)
    return cut.select(F.col("place").alias("id"), r6(A.total(F.col("window")), "area"), r6(F.element_at("window", -1), "last_sample"))


_IMPORTED = """, v AS (SELECT * FROM r WHERE kind = 'view' AND tpa >= 0.5), z AS (SELECT a.id, row_number() OVER (PARTITION BY v.id ORDER BY abs(a.id - v.id), a.id) AS place, abs(a.id - v.id) AS apart FROM v JOIN r a ON a.kind = 'purchase' AND abs(a.id - v.id) < 3),
e AS (SELECT 'events' AS kind, id, CAST(NULL AS DOUBLE) AS tpa FROM r WHERE kind = 'purchase' AND id NOT IN (SELECT id FROM z WHERE place = 1) AND id BETWEEN (SELECT min(id) FROM v) AND (SELECT max(id) FROM v)
 UNION ALL SELECT CASE WHEN tpa >= 9 THEN 'controlpulses' ELSE 'testpulses' END, id, tpa FROM v), k AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY id) - 1 AS event_idx FROM e)
SELECT k.kind, event_idx, k.id AS place, k.tpa, round(CASE WHEN k.kind <> 'controlpulses' THEN sum(r.value) END, 6) AS area, round(CASE WHEN k.kind = 'controlpulses' THEN max(r.value) - avg(r.value) FILTER (r.id < k.id - 4) END, 6) AS pulse_height
FROM k JOIN r ON r.id >= k.id - 8 AND r.id < k.id + 24 GROUP BY k.kind, event_idx, k.id, k.tpa HAVING count(*) = 32"""


@query("imported_events", _IMPORTED)
def imported_events(spark, d):
    """A stream's purchases as triggers and its views as the pulser's stamps: events, test pulses and control pulses with their windows."""
    found = imports.sorted_triggers(kind(spark, d, "purchase").select(F.col("id").alias("place"), "id"), kind(spark, d, "view").select(F.col("id").alias("place"), "tpa"), 3, 0.5, 9.0)
    cut = imports.imported_events(_stream(spark, d), CHUNK, found, RECORD)
    return cut.select("kind", "event_idx", "place", "tpa", r6(A.total(F.col("event")), "area"), r6(F.col("pulse_height"), "pulse_height"))


@query("filtered_record_trigger")
def filtered_record_trigger(spark, d):
    """Records of a stream, each filtered by itself, that pass a threshold; tested against a plain search."""
    transfer = np.conj(np.fft.rfft(np.exp(-np.arange(RECORD) / 4.0)))
    found = triggering.filtered_record_triggers(_stream(spark, d), RECORD, 60.0, transfer, overlap=0.25)
    return found.select("channel", "place", r6(F.col("height"), "height"), "record", "blocked")


@query("scatter_raster", """, p AS (SELECT CAST(round_even(tpa / 10 * 40, 0) AS BIGINT) AS px, CAST(round_even((1 - value / 200) * 50, 0) AS BIGINT) AS py FROM r)
SELECT px, py, least(1.0, 0.3 * count(*))::DOUBLE AS shade FROM p WHERE px BETWEEN 1 AND 40 AND py BETWEEN 1 AND 50 GROUP BY px, py""")
def scatter_raster(spark, d):
    out = evaluate.raster(records(spark, d), F.col("tpa"), F.col("value"), (0.0, 10.0, 0.0, 200.0), 40, 50)
    return out.select("px", "py", r6(F.col("shade"), "shade"))


@query("line_bands", """, h AS (SELECT tpa, value, (t - 1704067200000000) / 3600000000.0 AS h FROM r WHERE kind = 'purchase'),
f AS (SELECT tpa, regr_count(value, h) AS n, regr_slope(value, h) AS b, regr_intercept(value, h) AS a, regr_avgx(value, h) AS mx, regr_sxx(value, h) AS sxx, regr_syy(value, h) AS syy, regr_sxy(value, h) AS sxy FROM h GROUP BY tpa),
g AS (SELECT *, sqrt(greatest(syy - b * sxy, 0) / (n - 2)) AS s FROM f WHERE n > 2)
SELECT tpa, round(a + b * 12, 6) AS middle, round(s * sqrt(1.0 / n + (12 - mx) ** 2 / sxx), 6) AS confidence, round(s * sqrt(1 + 1.0 / n + (12 - mx) ** 2 / sxx), 6) AS prediction FROM g""")
def line_bands(spark, d):
    hours = kind(spark, d, "purchase").withColumn("h", (F.col("t") - 1_704_067_200_000_000) / HOUR)
    middle, confidence, prediction = calibrate.band_at(F.lit(12.0))
    return calibrate.line_bands(hours, "tpa", "h", "value").select("tpa", r6(middle, "middle"), r6(confidence, "confidence"), r6(prediction, "prediction"))


@query("quadratic_through_zero", """, s AS (SELECT channel, sum(tpa ** 2) AS a, sum(tpa ** 3) AS b, sum(tpa ** 4) AS c, sum(tpa * value) AS p, sum(tpa ** 2 * value) AS q FROM r GROUP BY channel)
SELECT channel, round((p * c - q * b) / (a * c - b * b), 6) AS c1, round((q * a - p * b) / (a * c - b * b), 6) AS c2 FROM s""")
def quadratic_through_zero(spark, d):
    out = calibrate.polynomial_without_constant(records(spark, d), "channel", "tpa", "value", 2)
    return out.select("channel", r6(F.get("coefficients", F.lit(0)), "c1"), r6(F.get("coefficients", F.lit(1)), "c2"))
