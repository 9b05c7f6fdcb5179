"""The event engine: every query against its SQL twin, golden values of the joins, sources, catalog and stream."""

import math
import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pulselake.functions import arrays as A
from pulselake.functions import fits, noise, recoil
from pulselake.operators import evaluate, joins, ordered, spectra, triggering
from pulselake.plans import catalog
from pulselake.sources import interleaved, records
from pulselake.sources.groups import Groups

SF = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        p = f"{SF}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 5) + 0.0
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    names = sorted(df.columns)
    got = sorted((tuple(plain(v) for v in r) for r in df.select(*names).collect()), key=str)
    assert got
    if name in catalog.ORACLES:
        found = duck.execute(f"SELECT {', '.join(names)} FROM ({catalog.ORACLES[name]})").fetchall()
        assert got == sorted((tuple(plain(v) for v in r) for r in found), key=str)


def stamps(spark, values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id long, t long")


@pytest.mark.parametrize("a, b, low, high, inside, outside", [
    ([10, 20, 30, 40], [1, 11, 35, 42, 45], -1, 2, [(1, 0)], [0, 2, 3, 4]),
    ([10, 20, 30, 40], [1, 11, 35, 42, 45], -1, 3, [(1, 0), (3, 3)], [0, 2, 4]),
    ([10, 20, 30, 40], [7, 8, 11, 35, 42, 45], -3, -1, [(0, 0), (1, 0)], [2, 3, 4, 5]),
])
def test_coincidence_golden_values(spark, a, b, low, high, inside, outside):
    a, b = stamps(spark, a), stamps(spark, b)
    assert sorted(map(tuple, joins.coincidence(a, b, low, high).collect())) == inside
    out = joins.not_coincident(a, b, low, high)
    assert sorted(r.id for r in out.collect()) == outside


def test_coincidence_is_no_nested_loop(spark):
    plan = joins.coincidence(stamps(spark, [1]), stamps(spark, [2]), -1, 3)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_nearest_takes_the_closer_side(spark):
    a = spark.createDataFrame([(1, 0, 10), (2, 0, 20), (3, 1, 5)], "id long, c int, t long")
    b = spark.createDataFrame([(7, 0, 13), (8, 0, 27), (9, 0, 7)], "id long, c int, t long")
    assert sorted(map(tuple, joins.nearest(a, b, "c").collect())) == [(1, 9, -3), (2, 7, -7)]


def test_dead_time_batch_equals_stream(spark, tmp_path):
    from pulselake.streaming.dead_time import dead_time_stream

    rng = np.random.default_rng(1)
    rows = sorted((int(t), int(c)) for t, c in zip(np.cumsum(rng.integers(1, 30, 600)), rng.integers(0, 3, 600)))
    df = spark.createDataFrame([(c, t, i) for i, (t, c) in enumerate(rows)], "c long, t long, id long")
    want = []
    for c in range(3):
        last = None
        for i, (t, k) in enumerate(rows):
            if k == c and (last is None or t >= last + 100):
                want.append(i)
                last = t
    assert sorted(r.id for r in ordered.dead_time_fold(df, "c", "t", "id", 100).collect()) == sorted(want)
    for part in range(4):
        df.where((F.col("id") >= 150 * part) & (F.col("id") < 150 * part + 150)).coalesce(1).write.parquet(f"{tmp_path}/in/p{part}")
        os.utime(f"{tmp_path}/in/p{part}", (part + 1, part + 1))
    files = sorted((f"{d}/{f}" for d, _, fs in os.walk(f"{tmp_path}/in") for f in fs if f.endswith(".parquet")), key=lambda p: p)
    for at, f in enumerate(files):
        os.utime(f, (1000 + at, 1000 + at))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    q = dead_time_stream(stream, "c", "t", "id", 100).writeStream.format("memory").queryName("fold").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r.id for r in spark.table("fold").collect()) == sorted(want)


def test_matched_filter_peaks_at_one():
    t = np.arange(256.0)
    pulse = fits.pulse_shape(t, 64, 1.0, 0.5, 3, 10, 40)
    pulse /= pulse.max()
    h = spectra.matched_filter(pulse, np.ones(129), 64)
    filtered = np.fft.irfft(np.fft.rfft(pulse) * h, 256)
    assert filtered.max() == pytest.approx(1.0) and filtered.argmax() == 64


def test_counts_and_volts_are_inverse(spark):
    row = spark.range(5).select(A.to_counts(A.to_volts(F.col("id").cast("double"))).alias("n"), F.col("id")).collect()
    assert all(r.n == pytest.approx(r.id) for r in row)


def test_triggered_records_round_trip(spark, tmp_path):
    layout = records.triggered_layout(32)
    data = np.zeros(10, records.dtype_of(layout))
    data["detector_nmbr"], data["trig_count"] = np.arange(10) % 2, np.arange(10) // 2
    data["abs_time_s"], data["abs_time_mus"] = 100 + np.arange(10), 7
    data["test_pulse_amplitude"] = [0, 0, -1, -1, 1, 1, 20, 20, 0, 0]
    data["samples"] = np.arange(320).reshape(10, 32)
    data.tofile(f"{tmp_path}/a.rdt")
    lines = ["Timeofday at start  [s]: 100", "Timeofday at start [us]: 0", "Timeofday at stop   [s]: 200", "Timeofday at stop  [us]: 5", "Measuring time    [h] : 0.5", "Integers in header             : 7", "DVM channels                   : 0", "Record length                  : 32", "Time base [us]                 : 40"]
    (tmp_path / "a.par").write_text("\n".join(lines))
    got = records.read_triggered(spark, f"{tmp_path}/a.rdt", f"{tmp_path}/a.par").orderBy("record").collect()
    assert [r.group for r in got] == ["events"] * 2 + ["noise"] * 2 + ["testpulses"] * 2 + ["controlpulses"] * 2 + ["events"] * 2
    assert got[3].samples == list(range(96, 128)) and got[3].t == 103_000_007
    assert got[1].volts[0] == pytest.approx(-10 + (32 + 32768) * 20 / 65536)
    many = records.read_records(spark, f"{tmp_path}/a.rdt", layout, records=3)
    assert many.rdd.getNumPartitions() == 4 and many.count() == 10


def test_stamps_and_control_files(spark, tmp_path):
    data = np.array([(2**63 + 5, 1.5, 3)], records.dtype_of(records.TEST_STAMPS))
    data.tofile(f"{tmp_path}/x.test_stamps")
    row = records.read_records(spark, f"{tmp_path}/x.test_stamps", records.TEST_STAMPS).first()
    assert int(row.stamp) == 2**63 + 5 and row.tpa == 1.5
    body = np.array([(1, 2.5, 10, 1, 0.0, 4)], records.dtype_of(records.CONTROL)).tobytes()
    (tmp_path / "x.con").write_bytes(b"0" * 12 + body)
    assert records.read_control(spark, f"{tmp_path}/x.con").first().hours == pytest.approx((2**32 + 10) / 1e7 / 3600)


def test_groups(spark, tmp_path):
    g = Groups(spark, f"{tmp_path}/m")
    df = spark.createDataFrame([(0, 1.0), (1, 2.0)], "event_idx long, ph double")
    g.put("events", df)
    g.set("events", df.select("event_idx", (F.col("ph") * 2).alias("twice")))
    assert g.get("events").columns == ["event_idx", "ph", "twice"] and g.keys() == ["events"]
    with pytest.raises(ValueError):
        g.set("events", df)
    g.rename("events", twice="double_ph")
    g.drop("events", "ph")
    assert g.get("events").columns == ["event_idx", "double_ph"]
    g.merge("all", [("a", df), ("b", df)])
    assert sorted((r.event_idx, r.origin) for r in g.get("all").collect()) == [(0, "a"), (1, "a"), (2, "b"), (3, "b")]
    with pytest.raises(ValueError):
        g.merge("bad", [("a", df), ("b", df.drop("ph"))])
    g.drop("all")
    assert g.keys() == ["events"]


def test_fits_find_known_parameters():
    x = np.linspace(0, 10, 200)
    found = fits.fit_efficiency(x, fits.efficiency(x, 0.9, 4.0, 0.7), 3.0, 1.0)
    assert found == pytest.approx([0.9, 4.0, 0.7], abs=1e-3)
    assert fits.noise_threshold(0.0, 1.0, 1.0, 0.15865) == pytest.approx(1.0, abs=0.02)
    assert fits.gap_upper_limit(np.array([1.0])) == pytest.approx(-np.log(0.1), rel=0.05)
    assert fits.simplex(lambda p: (p[0] - 3) ** 2 + (p[1] + 1) ** 2, np.array([0.0, 0.0])) == pytest.approx([3, -1], abs=1e-4)


def test_panel_and_monitor_files(spark, tmp_path):
    data = np.zeros(2, records.dtype_of(records.PANELS))
    data["time_low"], data["time_high"], data["number_channels"], data["panel"] = 5, [0, 1], 21, np.arange(42).reshape(2, 21)
    data.tofile(f"{tmp_path}/a.qdc")
    rows = records.read_panels(spark, f"{tmp_path}/a.qdc").orderBy("record").collect()
    assert rows[1].panel == list(range(21, 42)) and rows[1].hours == pytest.approx((2**32 + 5) / 1e7 / 3600)
    head = np.array([(b"v1", 10, 20, 2)], records.MONITOR_HEADER).tobytes() + b"heater".ljust(48, b"\0") + b"cold stage".ljust(48, b"\0")
    body = np.array([(3, 4, [1.5, 2.5]), (5, 6, [3.5, 4.5])], np.dtype([("a", "<i8"), ("b", "<i8"), ("v", "<f4", (2,))])).tobytes()
    (tmp_path / "a.mon").write_bytes(head + body)
    got = records.read_monitor(spark, f"{tmp_path}/a.mon").orderBy("t").collect()
    assert got[0].asDict() == {"t": 3_000_004, "heater": 1.5, "cold stage": 2.5} and len(got) == 2


def test_stream_chunks(spark, tmp_path):
    np.arange(250, dtype="<i2").tofile(f"{tmp_path}/s.csmpl")
    chunks = records.read_stream(spark, f"{tmp_path}/s.csmpl", 100)
    assert [v for r in chunks.orderBy("start").collect() for v in r.samples] == list(range(250))


@pytest.mark.parametrize("chunk", [1, 7, 50, 10_000])
def test_chunks_do_not_show(spark, chunk):
    rng = np.random.default_rng(3)
    rows = [(int(k), int(t), i) for i, (k, t) in enumerate(zip(rng.integers(0, 2, 120), rng.integers(0, 400, 120)))] + [(None, 5, 900), (None, 9, 901)]
    df = spark.createDataFrame(rows, "k long, t long, id long")
    since, last = {}, {}
    for k, t, i in sorted(rows, key=lambda r: (str(r[0]), r[1], r[2])):
        since[i], last[k] = (t - last[k]) if k in last else None, t
    assert {r.id: r.since_ for r in ordered.since_previous(df, "k", "t", "id", chunk).collect()} == since
    numbers = {}
    for n, (k, t, i) in enumerate(sorted(rows, key=lambda r: (str(r[0]), r[1], r[2]))):
        numbers[i] = sum(1 for r in rows if r[0] == k and (r[1], r[2]) <= (t, i) and r[2] % 3 == 0)
    assert {r.id: r.n for r in ordered.numbered(df, "k", "t", "id", F.col("id") % 3 == 0, "n", chunk).collect()} == numbers
    order = {i: n for n, (_, t, i) in enumerate(sorted(rows, key=lambda r: (r[1], r[2])))}
    assert {r.id: r.place for r in ordered.ranked(df, "t", "id", "place", chunk).collect()} == order
    got = {r.a_id: r.b_id for r in joins.nearest(df.where("id % 2 = 0"), df.where("id % 2 = 1"), "k", chunk).collect()}
    want = {a: min((abs(u - t), u, b) for j, u, b in rows if j == k and b % 2)[2] for k, t, a in rows if k is not None and a % 2 == 0}
    assert got == want


@pytest.mark.parametrize("block", [4, 9, 1000])
def test_frames_cross_blocks(spark, block):
    rows = [(i % 2, i, i, float(i * i % 17)) for i in range(60)]
    df, by = ordered.framed(spark.createDataFrame(rows, "k long, t long, id long, v double"), "k", "t", "id", 3, block)
    summed = df.withColumn("s", F.sum("v").over(W.partitionBy(*by).orderBy("place_").rowsBetween(-3, -1))).where("own_")
    got = {r.id: r.s for r in summed.collect()}
    assert got == {i: sum(r[3] for r in rows if r[0] == i % 2 and i - 6 <= r[1] < i) or (None if i < 2 else 0.0) for i in range(60)}


def found_by_hand(y, length, threshold, n):
    out, i = [], length
    while i < n - length - 1:
        if y[i] > threshold:
            p = i + int(np.argmax(y[i : i + length]))
            out.append(p)
            i = p + length // 2 + 1
        else:
            i += 1
    return out


@pytest.mark.parametrize("size", [16, 50, 400, 5000])
@pytest.mark.parametrize("how", ["filter", "deviation"])
def test_triggers_do_not_depend_on_chunks(spark, size, how):
    rng, length, n = np.random.default_rng(8), 16, 3011
    x = rng.normal(0, 1, n)
    for at in rng.integers(0, n - 12, 60):
        x[at : at + 12] += rng.uniform(2, 9) * np.exp(-np.arange(12) / 4)
    transfer = np.fft.rfft(np.exp(-np.arange(length) / 4)[::-1])
    score, threshold = (triggering.filter_score(transfer), 6.0) if how == "filter" else (triggering.deviation_score, 2.5)
    rows = [(c, s, x[::step][s : s + size].tolist()) for c, step in ((1, 1), (2, -1)) for s in range(0, n, size)]
    chunks = spark.createDataFrame(rows, "channel long, start long, samples array<double>")
    found = triggering.triggers(chunks, size, length, threshold, score)
    got = {(r.channel, r.place): r.height for r in found.collect()}
    want = {}
    for c, step in ((1, 1), (2, -1)):
        y = np.convolve(x[::step], np.fft.irfft(transfer, length))[:n] if how == "filter" else np.array([(x[::step][i] - x[::step][i - length : i].mean()) / x[::step][i - length : i].std() if i >= length else -9 for i in range(n)])
        want |= {(c, p): y[p] for p in found_by_hand(y, length, threshold, n)}
    assert len(want) > 40 and got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)
    cut = triggering.cut_windows(chunks, found.select("channel", "place"), size, length, 4)
    assert {(r.channel, r.place): r.window for r in cut.collect()} == {(c, p): x[:: 1 if c == 1 else -1][p - 4 : p + 12].tolist() for c, p in want if p + 12 <= n}


def test_noise_models_are_densities_and_fit(spark):
    x = np.linspace(-2, 60, 60_001)
    values = {"sigma": 1.0, "rate": 0.4, "weight": 0.9, "mu": 2.0, "sigma_2": 1.5}
    for model, names in noise.MODELS.items():
        y = noise.density(model, x, 50.0, **{n: values[n] for n in names})
        assert abs(float(y.sum() * (x[1] - x[0])) - 1) < 1e-3, model
    drawn = np.random.default_rng(1).normal(0, 1.3, (4000, 100)).max(axis=1)
    at, counts = noise.binned(spark.createDataFrame([(float(v),) for v in drawn], "v double"), "v", 0.05)
    found = noise.fit("gauss", at, counts, 60.0, sigma=1.0)
    assert counts.sum() == 4000 and abs(found["sigma"] - 1.3) < 0.15
    cut = noise.threshold("gauss", 0.01, 12.0, **found)
    assert 0.004 < (drawn > cut).mean() < 0.02


def test_recoil_rates(spark):
    e = [0.01, 0.3, 1.0, 5.0, 20.0]
    got = spark.createDataFrame([(v,) for v in e], "e double").select("e", recoil.erf(F.col("e")).alias("erf"), recoil.form_factor(F.col("e"), 184).alias("f"), recoil.speed_integral(F.col("e"), 16, 10.0).alias("i")).collect()
    for r in got:
        assert abs(r.erf - math.erf(r.e)) < 1e-11
        m = 0.938272 * 16
        least = 299792.458 * math.sqrt(m * r.e * 1e-6 / 2) / (m * 10 / (m + 10))
        v = np.linspace(max(least, 1e-3), 800, 400_001)
        # the speeds in the galaxy's frame cut at the escape speed, seen from the sun
        top = lambda s: np.exp(-np.minimum((v + s * 231) ** 2, 544.0**2) / 220**2)
        shape = np.where(v < 544 + 231, top(-1) - top(1), 0.0)
        z = 544 / 220
        norm = math.erf(z) - 2 / math.sqrt(math.pi) * z * math.exp(-z * z)
        want = float(np.trapezoid(shape, v)) / (math.sqrt(math.pi) * 220 * 231 * norm)
        assert abs(r.i - want) < 1e-3 * want + 1e-9
    assert abs(got[0].f - 1) < 0.01 and abs(got[-1].f) < 1
    spectrum = recoil.recoil_spectrum(spark, {16: 0.22, 40: 0.14, 184: 0.64}, 10.0, 0.1, 20.0).orderBy("energy").collect()
    assert abs(spectrum[-1].share - 1) < 1e-9 and spectrum[0].rate > spectrum[-1].rate >= 0


def test_interleaved_and_24_bit_files(spark, tmp_path):
    word = 1 | 1 << 6 | 1 << 7 | 1 << interleaved.WIDE_ADC
    row = np.dtype([("Time", "<u8"), ("ADC1", "<i4"), ("ADC2", "<i4")])
    data = np.array([(i, i * 1000, -i) for i in range(500)], row)
    (tmp_path / "a.bin").write_bytes(np.array([(1, 0, 1, word, 7)], interleaved.HEADER).tobytes() + data.tobytes())
    got = interleaved.read_interleaved(spark, str(tmp_path / "a.bin"), 64).orderBy("place").collect()
    assert [r.place for r in got] == list(range(500)) and all(abs(r.ADC1 - r.place * 1000 * interleaved.SWING / 2**24) < 1e-9 and int(r.Time) == r.place for r in got)
    counts = [0, 1, -1, 40_000, -40_000, 2**23 - 1, -(2**23)]
    (tmp_path / "b.bin").write_bytes(b"".join(c.to_bytes(3, "little", signed=True) for c in counts))
    volts = [r.volts for r in interleaved.read_24_bit(spark, str(tmp_path / "b.bin"), swing=2.0**24).orderBy("place").collect()]
    assert volts == counts


def test_text_tables(spark, tmp_path):
    points = spark.createDataFrame([(float(i), i * 0.5) for i in range(20)], "x double, y double")
    interleaved.write_xy(points, str(tmp_path / "xy"), "a title", ["x", "y", "z"])
    assert sorted(map(tuple, interleaved.read_xy(spark, str(tmp_path / "xy"), ["x", "y"]).collect())) == [(float(i), i * 0.5) for i in range(20)]
    labels = spark.createDataFrame([(0, 1, 3), (1, 1, 7), (0, 4, 7)], "channel int, event_idx long, label int")
    interleaved.write_labels(labels, str(tmp_path / "labels"))
    back = interleaved.read_labels(spark, str(tmp_path / "labels"))
    events = spark.createDataFrame([(0, 1), (0, 2)], "channel int, event_idx long")
    assert sorted(map(tuple, interleaved.with_labels(events, back).select("event_idx", "label").collect())) == [(1, 3), (2, 0)]
    assert sorted(r.event_idx for r in interleaved.labelled(back, 7).collect()) == [1, 4]


def test_models_predict_in_batches(spark):
    df = spark.createDataFrame([(i, [float(i), 2.0]) for i in range(50)] + [(99, None)], "id long, x array<double>")
    got = evaluate.predicted(df, "id", "x", lambda: lambda rows: rows @ np.array([3.0, 1.0]))
    assert {r.id: r.prediction for r in got.collect()} == {i: 3.0 * i + 2 for i in range(50)}


@pytest.mark.parametrize("block", [5, 64, 10_000])
def test_exponential_means_cross_blocks(spark, block):
    rng = np.random.default_rng(4)
    v = rng.normal(100, 1, 200)
    v[::23] += 15
    rows = [(0, i // 2, i, float(x)) for i, x in enumerate(v)] + [(1, 3, 900, None)]
    df = spark.createDataFrame(rows, "k long, t long, id long, v double")
    got = {r.id: (r.fast, r.slow, r.fired) for r in ordered.exponential_trigger(df, "k", ("t", "id"), "v", 5.0, 50.0, 2.0, block).collect()}
    a, b = math.exp(-1 / 5), math.exp(-1 / 50)
    fast = slow = v[0]
    var = 0.0
    for i, x in enumerate(v):
        fast = a * fast + (1 - a) * x
        fired = var > 0 and abs(fast - slow) > 2 * math.sqrt(var)
        var, slow = b * var + (1 - b) * (x - slow) ** 2, b * slow + (1 - b) * x
        assert abs(got[i][0] - fast) < 1e-8 and abs(got[i][1] - slow) < 1e-8 and got[i][2] == fired
    assert got[900] == (None, None, None) and sum(1 for g in got.values() if g[2]) > 3


@pytest.mark.parametrize("closed", [False, True])
@pytest.mark.parametrize("chunk", [100, 130, 1000, 10**6])
def test_dead_times_cross_chunks(spark, closed, chunk):
    rng = np.random.default_rng(11)
    rows = [(int(k), int(t), i) for i, (k, t) in enumerate(zip(rng.integers(0, 2, 500), rng.integers(0, 4000, 500)))]
    rows += [(0, 10_000, 900), (0, 10_100, 901), (0, 10_200, 902)]
    df = spark.createDataFrame(rows, "k long, t long, id long")
    want = []
    for key in (0, 1):
        last = None
        for k, t, i in sorted(rows, key=lambda r: (r[1], r[2])):
            if k == key and (last is None or (t > last + 100 if closed else t >= last + 100)):
                want.append(i)
                last = t
    got = [r.id for r in ordered.dead_time_fold(df, "k", "t", "id", 100, closed, chunk).collect()]
    assert sorted(got) == sorted(want) and (902 in got and 901 not in got) == closed or not closed


@pytest.mark.parametrize("chunk", [1, 40, 10_000])
def test_last_known_value_crosses_chunks(spark, chunk):
    rng = np.random.default_rng(5)
    rows = [(int(k), int(t), i, int(v) if v > 3 else None) for i, (k, t, v) in enumerate(zip(rng.integers(0, 2, 150), rng.integers(0, 300, 150), rng.integers(0, 9, 150)))]
    df = spark.createDataFrame(rows, "k long, t long, id long, v long")
    got = {r.id: r.last for r in ordered.last_known(df, "k", "t", [F.col("id")], F.col("v"), "last", chunk).collect()}
    want, last = {}, {}
    for k, t, i, v in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        last[k] = v if v is not None else last.get(k)
        want[i] = last[k]
    assert got == want


def test_ranks_over_wide_values(spark):
    rng = np.random.default_rng(6)
    rows = [(int(v), i) for i, v in enumerate(rng.integers(-(2**40), 2**40, 300))] + [(7, 900), (7, 901), (None, 902)]
    got = {r.id: r.place for r in ordered.ranked(spark.createDataFrame(rows, "v long, id long"), "v", "id", "place").collect()}
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert got == {i: n for n, (_, i) in enumerate(order)}


def plain_main(x, down, search, edge, smooth):
    """One trace at a time, from the definition."""
    length = len(x)
    offset = np.mean(x[: length // 8])
    if down == 1:
        padded = np.concatenate([[x[0]] * (smooth // 2), x, [x[-1]] * (smooth - 1 - smooth // 2)])
        s = np.array([padded[i : i + smooth].mean() for i in range(length)]) - offset
    else:
        s = np.array([x[i * down : (i + 1) * down].mean() for i in range(length // down)]) - offset
    low, high = search[0] // down, search[1] // down
    drift = (s[-(edge // down) :].mean() - s[: edge // down].mean()) / length
    peak = max(range(low, high), key=lambda i: s[i] - drift * i)
    level = s[peak]
    zero = max((i for i in range(peak) if s[i] < 0.2 * level), default=0)
    rise = min((i for i in range(zero, len(s)) if s[i] > 0.8 * level), default=zero)
    end = min((i for i in range(peak, len(s)) if s[i] < 0.368 * level), default=len(s) - 1)
    half = max((i for i in range(end + 1) if s[i] > 0.736 * level), default=end)
    falls = max((i for i in range(half + 1) if s[i] > 0.9 * level), default=half)
    return [s[low:high].max(), *[i * down for i in (zero, rise, peak, falls, half, end)], offset, drift]


@pytest.mark.parametrize("down", [1, 4])
def test_main_parameters_follow_the_definition(spark, down):
    from pulselake.functions import parameters

    rng, t = np.random.default_rng(2), np.arange(256.0)
    x = np.array([h * fits.pulse_shape(t, 70, 1, 0.5, 3, 9, 40) + rng.normal(0, 0.02, 256) + rng.normal() for h in rng.uniform(0.5, 5, 30)])
    df = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "i long, x array<double>")
    got = {r.i: list(r)[1:10] for r in parameters.main_parameters(df, "i", "x", (40, 140), down, 32, 6).collect()}
    assert all(got[i] == pytest.approx(plain_main(row, down, (40, 140), 32, 6)) for i, row in enumerate(x))
    flat = spark.createDataFrame([(0, (1.0 + 0.001 * t + 1e-5 * t**2).tolist())], "i long, x array<double>")
    bent = parameters.main_parameters(flat, "i", "x", (40, 60), 1, 32, 6, True).first()
    assert bent.quadratic_drift == pytest.approx(1e-5, rel=0.05)
    skewed = parameters.window_skew(np.array([[1.0, 2.0, 5.0, 1.0]]))[0]
    d = np.array([1, 2, 5, 1]) / 9
    mu = (np.arange(4) @ d) / 4
    sg = ((np.arange(4) - mu) ** 2 @ d) / 4
    assert skewed == pytest.approx((((np.arange(4) - mu) / sg) ** 3 @ d) / 4)


def test_filters_of_longer_records():
    from pulselake.functions import parameters

    kernel = np.exp(-np.arange(64) / 5.0)
    long = np.fft.irfft(parameters.longer_filter(np.fft.rfft(kernel), 256))
    assert long[:32] == pytest.approx(kernel[:32]) and long[-32:] == pytest.approx(kernel[32:]) and abs(long[32:-32]).max() < 1e-12
    assert parameters.longer_noise(np.ones(33), 256) == pytest.approx(np.ones(129) * 4)
    assert parameters.filter_norm(kernel, np.ones(33)) == pytest.approx(1 / np.sum(np.abs(np.fft.rfft(kernel)) ** 2))


def test_array_fits_against_plain_least_squares(spark):
    from pulselake.functions import signal

    rng, n = np.random.default_rng(3), 64
    template = fits.pulse_shape(np.arange(float(n)), 16, 1, 0.5, 2, 6, 15)
    x = [1.7 * np.roll(template, s) + 0.2 + rng.normal(0, 0.01, n) for s in (-2, 0, 3)]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "i long, x array<double>")
    base = np.vander(np.linspace(-1, 1, n), 2, increasing=True)
    for r in signal.array_fit(df, "i", "x", template, 1, 4).collect():
        tried = []
        for by in range(-4, 5):
            moved = np.array([template[min(max(k - by, 0), n - 1)] for k in range(n)])
            a = np.column_stack([moved, base])
            c = np.linalg.lstsq(a, x[r.i], rcond=None)[0]
            tried.append((np.sqrt(np.mean((a @ c - x[r.i]) ** 2)), by, c[0]))
        rms, by, height = min(tried)
        assert (r.shift, r.height, r.rms) == (by, pytest.approx(height), pytest.approx(rms))
    between = [2.0 * np.interp(np.arange(n) - 1.5, np.arange(n), template), np.minimum(4 * template, 1.5)]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(between)], "i long, x array<double>")
    got = {r.i: r for r in signal.template_fits(df, "i", "x", template, 0, 4, 1.4).collect()}
    assert got[0].shift == pytest.approx(1.5, abs=0.2) and got[0].height == pytest.approx(2.0, rel=0.1)
    assert got[1].height == pytest.approx(4.0, rel=0.05)


def test_principal_components_against_plain_algebra(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(80, 3)) @ rng.normal(size=(3, 10)) + rng.normal(0, 0.01, (80, 10))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "i long, x array<double>")
    centred = x - x.mean(axis=0)
    u, s, _ = np.linalg.svd(centred, full_matrices=False)
    for r in evaluate.principal_components(df, "i", "x", 2).collect():
        assert np.abs(r.pc) == pytest.approx(np.abs(u[r.i, :2] * s[:2]), abs=1e-6)
        rest = centred[r.i] - (u[:, :2] * s[:2])[r.i] @ np.linalg.svd(centred, full_matrices=False)[2][:2]
        assert r.error == pytest.approx(np.sqrt(np.mean(rest**2)), abs=1e-6)


def test_simulated_heights_come_back(spark):
    rows = catalog.QUERIES["simulated_fit"](spark, SF).collect()
    assert len(rows) == 1000 and all(abs(r.height - r.true_height) < 0.05 * r.true_height + 0.05 and abs(r["shift"] - r.true_shift) <= 1 for r in rows)


def test_pulse_and_saturation_fits_find_known_parameters(spark):
    from pulselake.functions import signal

    t = (np.arange(256) - 64) * 0.4
    x = fits.pulse_shape(t, -0.5, 3.0, 1.0, 8.0, 1.0, 30.0)
    got = signal.pulse_fits(spark.createDataFrame([(0, x.tolist())], "i long, x array<double>"), "i", "x", 0.4).first()
    assert got.rms < 0.02 * x.max() and abs(got.numbers[0] + 0.5) < 0.5
    a = np.linspace(0.1, 10, 30)
    found = fits.fit_saturation(a, fits.saturation_curve(a, 8.0, 1.2, 0.9, 0.4, 1.5))
    assert fits.saturation_curve(a, *found) == pytest.approx(fits.saturation_curve(a, 8.0, 1.2, 0.9, 0.4, 1.5), abs=0.05)


def test_poisson_quantiles():
    from pulselake.operators import cuts

    assert [cuts.poisson_quantile(q, 3.0) for q in (0.04, 0.05, 0.5, 0.99)] == [0, 1, 3, 8]
    assert cuts.poisson_quantile(0.5, 0.0) == 0 and cuts.normal_cdf(1.959964) == pytest.approx(0.975)


def test_event_indexing(spark):
    from pulselake.operators.events import EventSet

    x = spark.createDataFrame([(c, i, [float(i), float(c)]) for c in (0, 1) for i in range(10)], "channel int, event_idx long, x array<double>")
    e = EventSet(x, 40, 2)
    numbers = lambda s: sorted({(r.channel, r.event_idx) for r in s.df.collect()})
    for key in (slice(None), slice(2, 7), slice(-4, None), slice(None, None, 3), slice(8, 2, -2), [1, -1], 4, -2):
        want = np.arange(10)[key]
        assert numbers(e[1, key]) == [(1, int(i)) for i in np.sort(np.atleast_1d(want))], key
    assert numbers(e[[0, 1], [True] + [False] * 8 + [True]]) == [(0, 0), (0, 9), (1, 0), (1, 9)]
    assert numbers(e[0]) == [(0, i) for i in range(10)] and numbers(e[0, F.col("event_idx") > 7]) == [(0, 8), (0, 9)]
    with pytest.raises(IndexError):
        e[0, [-11]]
    with pytest.raises(IndexError):
        e[0, [True]]
    assert EventSet(x.limit(0), 40, 2).count() == 0 and sum([e, e]).count() == 20
    with pytest.raises(ValueError):
        e + EventSet(x, 20, 2)


def test_streams(spark, tmp_path):
    from pulselake.sources.streams import open_stream

    data = {name: (np.arange(1000) * k % 700 - 300).astype("<i2") for name, k in (("a", 1), ("b", 3))}
    for name, v in data.items():
        v.tofile(f"{tmp_path}/{name}.csmpl")
    s = open_stream(spark, "int16", {n: f"{tmp_path}/{n}.csmpl" for n in data}, 5_000, 40, 128, (-32768.0, 32768.0))
    assert s.keys() == ["a", "b"] and s.time.length == 1000 and s.time[3] == 5_120 and s.time[-1] == 5_000 + 999 * 40
    for key in (slice(100, 400), slice(None, 10), slice(-20, None), slice(3, 900, 50), 7, -1):
        assert s["b", key].first().samples == np.atleast_1d(data["b"][key]).tolist()
    whole = {r.start: r.samples for r in s.sum().chunks.collect()}
    assert [v for k in sorted(whole) for v in whole[k]] == (data["a"].astype(int) + data["b"]).tolist()
    with pytest.raises(IndexError):
        s["a", 1000]
    with pytest.raises(IndexError):
        s.time[1000]
    at = spark.createDataFrame([(5_000,), (5_079,), (44_999,), (None,)], "t long")
    assert [r.p for r in at.select(s.time.place_of(F.col("t")).alias("p")).collect()] == [0, 1, 999, None]
    with pytest.raises(Exception, match="outside the stream"):
        spark.createDataFrame([(45_000,)], "t long").select(s.time.place_of(F.col("t"))).collect()
    assert spark.createDataFrame([(4_999,)], "t long").select(s.time.place_of(F.col("t"), False).alias("p")).first().p is None
    asked = spark.createDataFrame([("a", 500), ("a", 1), ("a", 995)], "channel string, place long")
    assert [r.place for r in s.windows(asked, 16, 4).collect()] == [500]
    padded = {r.place: r.window for r in s.windows(asked, 16, 4, pad=True).collect()}
    assert padded == {p: [float(data["a"][min(max(i, 0), 999)]) for i in range(p - 4, p + 12)] for p in (500, 1, 995)}
    with pytest.raises(ValueError):
        open_stream(spark, "other", {}, 0, 40)
    word = 1 << 6 | 1 << 7
    rows = np.array([(i, 2 * i) for i in range(300)], np.dtype([("ADC1", "<i2"), ("ADC2", "<i2")]))
    (tmp_path / "a.bin").write_bytes(np.array([(1, 0, 1, word, 7)], interleaved.HEADER).tobytes() + rows.tobytes())
    wide = open_stream(spark, "interleaved", str(tmp_path / "a.bin"), 0, 40, 64)
    assert wide.keys() == ["ADC1", "ADC2"] and wide["ADC2", 100].first().samples[0] == pytest.approx(200 * interleaved.SWING / 2**16)


def test_pulser_triggers(spark):
    from pulselake.sources.streams import Stream, StreamTime

    rng = np.random.default_rng(1)
    x = rng.normal(0, 0.01, 4000)
    places = [700, 1600, 2900]
    for p, h in zip(places, (1.0, 2.0, 3.0)):
        x[p : p + 20] += h
    chunks = spark.createDataFrame([("dac", s, x[s : s + 500].tolist()) for s in range(0, 4000, 500)], "channel string, start long, samples array<double>")
    found = sorted(Stream(chunks, 500, StreamTime(0, 40, 4000)).pulser_triggers(30.0, 64).collect(), key=lambda r: r.place)
    assert len(found) == 3 and all(abs(r.place - p) < 20 and abs(r.tpa - h) < 0.1 for r, p, h in zip(found, places, (1.0, 2.0, 3.0)))


def triggered_file(tmp_path, n=24):
    layout = records.triggered_layout(32)
    data = np.zeros(n, records.dtype_of(layout))
    data["detector_nmbr"] = np.where(np.arange(n) % 5 == 4, 2, np.arange(n) % 2)
    data["trig_count"] = np.arange(n) // 2
    data["abs_time_s"], data["abs_time_mus"] = 100 + np.arange(n), 7
    data["time_low"] = np.arange(n) * 10_000_000
    data["test_pulse_amplitude"] = np.array([0, 0, -1, -1, 1, 1, 20, 20])[np.arange(n) % 8]
    data["samples"] = np.arange(32 * n).reshape(n, 32)
    data.tofile(f"{tmp_path}/a.rdt")
    lines = ["Timeofday at start  [s]: 100", "Timeofday at start [us]: 0", "Timeofday at stop   [s]: 200", "Timeofday at stop  [us]: 5", "Measuring time    [h] : 0.5", "Integers in header             : 7", "DVM channels                   : 0", "Record length                  : 32", "Time base [us]                 : 40"]
    (tmp_path / "a.par").write_text("\n".join(lines))
    return data


def test_channels_of_triggered_files(spark, tmp_path):
    data = triggered_file(tmp_path)
    rows = records.read_triggered(spark, f"{tmp_path}/a.rdt", f"{tmp_path}/a.par")
    tuples = {}
    for count in set(data["trig_count"].tolist()):
        key = tuple(sorted(set(data["detector_nmbr"][data["trig_count"] == count].tolist())))
        tuples[key] = tuples.get(key, 0) + 1
    got = {tuple(r.channels): r.n for r in records.channel_tuples(rows).collect()}
    singles = {(c,): len(set(data["trig_count"][data["detector_nmbr"] == c].tolist())) for c in (0, 1, 2)}
    assert got == {k: v for k, v in tuples.items() if len(k) > 1} | singles
    assert [r.tpa for r in records.amplitudes_of(rows).collect()] == [-1.0, 0.0, 1.0, 20.0]
    both = records.events_of(rows, [0, 1]).orderBy("event_idx", "channel").collect()
    counts = [c for c in range(12) if tuple(sorted(set(data["detector_nmbr"][data["trig_count"] == c].tolist()))) == (0, 1)]
    assert [(r.event_idx, r.channel) for r in both] == [(i, c) for i in range(len(counts)) for c in (0, 1)]
    assert both[2].x == data["samples"][2 * counts[1]].astype(float).tolist()
    assert records.clock_frequency(rows) == pytest.approx(1e7)
    assert [r.record for r in records.first_records(rows, 3).collect()] == [0, 1, 2]


def test_runs_are_converted_and_included(spark, tmp_path):
    triggered_file(tmp_path)
    g = Groups(spark, f"{tmp_path}/m")
    assert not g.exists()
    g.create()
    assert g.exists() and g.keys() == []
    assert records.convert(spark, f"{tmp_path}/a.rdt", f"{tmp_path}/a.par", g, [0, 1]) == ["events", "testpulses", "controlpulses", "noise"]
    n = g.get("events").count()
    assert n and g.location("events").endswith("v1")
    content = {(r.group, r.column): (r.n, r.length) for r in g.content().collect()}
    assert content["events", "x"] == (n, 32) and {k for k, _ in content} == {"events", "noise", "testpulses", "controlpulses"}
    g.get("events").write.parquet(f"{tmp_path}/more")
    more = spark.read.parquet(f"{tmp_path}/more")
    records.include(g, "events", more, "second")
    records.include(g, "events", more, "second")
    assert g.get("events").groupBy("origin").count().count() == 2 and g.get("events").count() == 2 * n
    g.repack("events", 1)
    assert g.get("events").rdd.getNumPartitions() == 1
    with pytest.raises(KeyError):
        g.location("none")


def test_derived_columns_and_consistency(spark, tmp_path):
    from pulselake.sources import groups

    g = Groups(spark, f"{tmp_path}/m")
    df = spark.createDataFrame([(0, 0, (1.5, 10, 14, 20, 25, 40)), (0, 1, (2.5, 11, 15, 22, 30, 50))], "channel int, event_idx long, mainpar struct<pulse_height: double, t_zero: long, t_rise: long, t_decaystart: long, t_half: long, t_end: long>")
    g.put("events", df)
    take = lambda name: [r[name] for r in g.derived("events", name).orderBy("event_idx").collect()]
    assert take("pulse_height") == [1.5, 2.5] and take("length_rise") == [4, 4] and take("length_secondhalfdecay") == [15, 20] and take("length_decay") == [20, 28]
    parts = [("a", df), ("b", df.drop("channel")), ("c", df.withColumn("event_idx", F.col("event_idx").cast("int")))]
    assert groups.inconsistencies(parts) == ["channel is missing in b", "event_idx has types bigint, int"] and groups.inconsistencies(parts[:1]) == []
    assert {(r.origin, r.n) for r in groups.properties(parts).collect()} == {("a", 2), ("b", 2), ("c", 2)}
    written = spark.read.parquet(g.location("events"))
    assert groups.available(written)
    g.drop("events")
    assert not groups.available(written)


def test_stamps_and_offsets(spark, tmp_path):
    np.array([(1000, 0, 0), (5000, 1, 1), (9000, 0, 0)], records.dtype_of(records.STAMPS)).tofile(f"{tmp_path}/a.dig_stamps")
    offset = records.clock_offset(records.read_records(spark, f"{tmp_path}/a.dig_stamps", records.STAMPS))
    assert offset == 3000
    rows = np.array([(3000, 0.5, 0), (3000 + 36_000_000_000, 0.5, 0), (3000 + 72_000_000_000, 20.0, 1)], records.dtype_of(records.TEST_STAMPS))
    rows.tofile(f"{tmp_path}/a.test_stamps")
    read = lambda **k: sorted((round(r.hours, 6), r.tpa, r.tpch) for r in records.test_stamps(spark, f"{tmp_path}/a.test_stamps", offset, **k).collect())
    assert read() == [(1.0, 0.5, 0), (2.0, 20.0, 1)] and read(control=True) == [(2.0, 20.0, 1)] and read(control=False) == read(channels=[0]) == [(1.0, 0.5, 0)]
    files = spark.createDataFrame([("0", "bck_001", 0, "2020-01-02 03:04:05"), ("0", "bck_001", 1, "2021-01-01 00:00:00")], "CH string, LABEL string, TYPE int, CREATED string")
    assert records.start_time(files, "0", "bck_001") == 1577934245 and records.start_time(files, "9", "bck_001") is None


def test_unsigned_numbers_of_64_bits(spark, tmp_path):
    values = [0, 1, 2**63, 2**64 - 1]
    np.array(values, "<u8").tofile(f"{tmp_path}/u.bin")
    assert [int(r.v) for r in records.read_records(spark, f"{tmp_path}/u.bin", [("v", "<u8", 1)]).orderBy("record").collect()] == values


def test_simulated_classes(spark, tmp_path):
    from pulselake.operators import sampler

    s = sampler.Settings(length=512, saturation=False)
    for label, kind in sampler.CLASSES.items():
        rows = sampler.sample_events(spark, label, 6, s, 3).orderBy("event_idx").collect()
        again = sampler.sample_events(spark, label, 3, s, 3, first=2).orderBy("event_idx").collect()
        assert [r.x for r in rows[2:5]] == [r.x for r in again], label
        counts = {n for n, _ in kind.pulses}
        assert all(len(r.x) == 512 and len(r.heights) in counts and np.isfinite(r.x).all() for r in rows), label
        assert all(any(a <= r.onsets[0] <= b for a, b in kind.onsets) for r in rows if r.onsets), label
    with pytest.raises(KeyError):
        sampler.class_of("no such")
    rng = np.random.default_rng(1)
    assert 0.1 <= (lambda a, k, c, q, b, nu: a + (k - a) / c ** (1 / nu))(*sampler.drawn_saturation(rng)) <= 10
    decay = sampler.drawn_decay(rng, 0.65, 0.05)
    assert fits.pulse_shape(np.array([-0.1625]), *decay)[0] >= 0.05
    t = np.linspace(-1, 1, 201)
    assert sampler.square(t, 2.0, [(-0.5, 0.0)]).sum() == pytest.approx(2.0 * 51) and sampler.step(t, 0.0, -3.0, 0.5)[-1] == -3.0
    shapes = sampler.drawn_shapes(rng, np.full(4000, 0.89))
    assert shapes.shape == (6, 4000) and shapes[1] == pytest.approx(0.89 / 0.705) and abs(shapes[3].mean() - (112.64 - 0.134 * 38.04)) < 2
    power = sampler.drawn_noise_power(rng, 512, 25_000.0, 0.003)
    noise_rows = np.array([sampler.superposed_noise(rng, power, 0.05) for _ in range(200)])
    assert (np.abs(np.fft.rfft(noise_rows)) ** 2).mean(axis=0)[1:-1] == pytest.approx(power[1:-1], rel=0.6)
    g = Groups(spark, f"{tmp_path}/sim")
    sampler.sample_sets(spark, g, {"events": ("Event Pulse", 5), "noise": ("Noise", 4)}, s)
    assert g.get("events").count() == 5 and g.get("noise").where("size(heights) = 0").count() == 4


def test_datasets(spark, tmp_path):
    from pulselake.operators import datasets

    df = spark.createDataFrame([(c, i, float(10 * c + i), [1.0 * i, 2.0 * i, 3.0]) for c in (0, 1) for i in range(50)], "channel int, event_idx long, ph double, mp array<double>")
    wide = datasets.samples(df, {"ph": None, "mp": 2}, [0, 1])
    assert wide.columns == ["event_idx", "ph_ch0", "mp_ch0_fe0", "mp_ch0_fe1", "ph_ch1", "mp_ch1_fe0", "mp_ch1_fe1"]
    row = wide.where("event_idx = 7").first()
    assert (row.ph_ch0, row.ph_ch1, row.mp_ch1_fe1) == (7.0, 17.0, 14.0)
    split = datasets.Splits(wide, {"train": 0.6, "test": 0.4})
    sizes = [split.part(n).count() for n in ("train", "test")]
    assert sum(sizes) == 50 and min(sizes) > 5
    batches = list(split.batches("train", 8))
    assert sum(len(b["ph_ch0"]) for b in batches) == sizes[0] and all(len(b["ph_ch0"]) == 8 for b in batches[:-1])
    with pytest.raises(KeyError):
        split.part("none")
    models = datasets.Models("a test")
    models.add(0, lambda rows: rows.sum(axis=1), (np.zeros(3), np.ones(3)))
    models.add(1, lambda rows: rows[:, 0])
    models.rename(1, 5)
    models.rename(5, 1)
    got = {(r.channel, r.event_idx): r.prediction for r in models.predict(df, "mp").collect()}
    assert got[0, 4] == 15.0 and got[1, 4] == 4.0 and len(got) == 100


def test_saved_models_come_back(spark, tmp_path):
    from functools import partial

    from pulselake.operators import datasets

    models = datasets.Models("kept")
    models.add(2, partial(np.sum, axis=1))
    models.save(spark, f"{tmp_path}/models")
    back = datasets.Models.load(spark, f"{tmp_path}/models")
    assert back.info == "kept" and back.models[2](np.ones((2, 3))).tolist() == [3.0, 3.0]


def test_evaluation_sets(spark):
    from pulselake.operators import datasets

    df = spark.createDataFrame([(c, i, [float(i)], i % 3) for c in (0, 1) for i in range(30)], "channel int, event_idx long, features array<double>, label int")
    e = datasets.Evaluation().add_events(df, 0).add_events(df, 1, only=[1, 2, 3], only_labelled=True)
    assert {(r.file_nbr, r.n) for r in e.df.groupBy("file_nbr").agg(F.count(F.lit(1)).alias("n")).collect()} == {(0, 30), (1, 2)}
    pred = e.df.select("file_nbr", "event_idx", (F.col("event_idx") % 3).cast("int").alias("prediction"))
    e = e.with_prediction("rule", pred)
    assert all(r.label == r.prediction for r in e.confusion("rule").collect())
    assert e.predictions("rule", "train").count() + e.predictions("rule", "test").count() == e.predictions("rule").count() == 32
    with pytest.raises(ValueError):
        e.with_prediction("rule", pred)
    with pytest.raises(KeyError):
        e.predictions("none")
    with pytest.raises(ValueError):
        e.with_features(pred.limit(1).withColumn("features", F.array(F.lit(1.0))))
    other = e.with_features(e.df.select("file_nbr", "event_idx", F.array(F.lit(2.0)).alias("features")))
    assert {tuple(r.features) for r in other.df.collect()} == {(2.0,)}


def test_limits_over_masses(spark):
    masses = recoil.log_masses(1.0, 100.0, 5)
    assert masses[0] == 1.0 and masses[-1] == pytest.approx(100.0) and len(masses) == 5
    parts, step = {16: 0.22, 40: 0.14, 184: 0.64}, 20.0 / 200
    spectrum = recoil.spectra(spark, parts, masses, 0.0, 20.0, 200)
    one = {round(r.energy, 6): r.rate for r in recoil.recoil_spectrum(spark, parts, masses[3], 0.0, 20.0, 200).collect()}
    assert all(r.rate == pytest.approx(one[round(r.energy, 6)]) for r in spectrum.where(F.abs(F.col("mass") - masses[3]) < 1e-9).collect())
    half = spark.createDataFrame([(0.0, 0.5), (20.0, 0.5)], "energy double, efficiency double")
    cut = {(r.mass, round(r.energy, 6)): r.rate for r in recoil.spectra(spark, parts, masses, 0.0, 20.0, 200, half).collect()}
    assert all(cut[r.mass, round(r.energy, 6)] == pytest.approx(0.5 * r.rate) for r in spectrum.collect())
    seen = spark.createDataFrame([(0.5,), (3.0,), (9.0,)], "energy double")
    limits = recoil.upper_limits(spectrum, seen, 10.0, step).orderBy("mass").collect()
    for r in limits:
        rows = sorted((s.energy, s.share, s.rate) for s in spectrum.where(F.abs(F.col("mass") - r.mass) < 1e-9).collect())
        at = [0.0, *[max((sh for e, sh, _ in rows if e <= v), default=0.0) for v in (0.5, 3.0, 9.0)], 1.0]
        assert r.expected == pytest.approx(fits.gap_upper_limit(np.diff(at)), rel=1e-6)
        assert r.cross_section == pytest.approx(r.expected / (10.0 * step * sum(x[2] for x in rows)))
    none = recoil.upper_limits(spectrum, seen.limit(0), 10.0, step).collect()
    assert all(r.expected == pytest.approx(-math.log(0.1), rel=0.05) for r in none)


def test_student_quantiles():
    from pulselake.operators import calibrate

    for confidence, n, want in ((0.95, 1, 12.7062), (0.95, 5, 2.5706), (0.9, 30, 1.6973), (0.68, 3, 1.1889)):
        assert calibrate.student_quantile(confidence, n) == pytest.approx(want, abs=2e-3)


def test_calibration_by_polynomials(spark):
    from pulselake.operators import calibrate

    pulses = spark.createDataFrame([(0, 1000 * k + 10 * j, 100 * k + j, float(k), 2.0 * k + 0.01 * k * k) for j in range(5) for k in (1, 2, 3, 4)], "channel long, t long, id long, tpa double, value double")
    events = spark.createDataFrame([(0, 2500, i, v) for i, v in enumerate((1.0, 2.5, 5.0))], "channel long, t long, id long, value double")
    straight = calibrate.EnergyCalibration(pulses, 10**9, 1.0, cpe=3.0)(events).orderBy("id").collect()
    curved = calibrate.EnergyCalibration(pulses, 10**9, 1.0, cpe=3.0, order=2)(events).orderBy("id").collect()
    for a, b, v in zip(straight, curved, (1.0, 2.5, 5.0)):
        want = (-2 + math.sqrt(4 + 0.04 * v)) / 0.02
        assert a.tpa == pytest.approx(want, abs=0.02) and b.tpa == pytest.approx(want, abs=0.01) and a.energy == pytest.approx(3 * a.tpa) and a.energy_sigma >= 0


def test_traces_that_lack_samples(spark):
    from pulselake.functions import signal

    x = [[1.0, 2.0, 4.0, 1.0], None, [1.0, None, 2.0, 3.0], [0.0, 1.0, 0.0, 1.0]]
    df = spark.createDataFrame(list(enumerate(x)), "i long, x array<double>").withColumn("one", F.lit(1))
    assert [r.i for r in signal.lags(df, "i", "x", np.array([0.0, 1.0, 0.0, 0.0])).orderBy("i").collect()] == [0, 3]
    want = np.mean([np.abs(np.fft.rfft(np.array(x[i]) - np.mean(x[i][:2]))) ** 2 for i in (0, 3)], axis=0)
    assert [r.nps for r in spectra.noise_power(df, "one", "x", 2).orderBy("k").collect()] == pytest.approx(list(want))
    with pytest.raises(Exception, match="samples in one table"):
        signal.lags(spark.createDataFrame([(0, [1.0]), (1, [1.0, 2.0])], "i long, x array<double>").coalesce(1), "i", "x", np.array([1.0])).collect()


def test_reports(spark):
    from pulselake.operators import analysis

    df = spark.createDataFrame([(e, c, [float(e), float(c), 5.0 - c]) for e in range(3) for c in (0, 1, 2) if not (e == 2 and c == 1)], "e long, c int, x array<double>")
    got = analysis.correlated_heights(df, "e", "c", "x", 0, [1, 2], 1).orderBy("e").collect()
    assert [tuple(r) for r in got] == [(0, 2, 5.0, 4.0, 3.0), (1, 2, 5.0, 4.0, 3.0)]
    pulses = spark.createDataFrame([(0, i * 3_600_000_000, i) for i in range(5)] + [(0, 40 * 3_600_000_000, 9)], "c int, t long, id long")
    live = analysis.exposure(pulses, "c", "t", "id", 7_200_000_000, 2.0).first()
    assert (live.live_hours, live.n_gaps, live.kg_days) == (6.0, 1, 0.5)
    some = analysis.noise_windows(pulses, "c", "t", "id", 60_000_000, 0, 0.5)
    every = analysis.noise_windows(pulses, "c", "t", "id", 60_000_000, 0).count()
    starts = sorted(r.start for r in some.collect())
    assert every == 240 + 36 * 60 and 0.4 * every < len(starts) < 0.6 * every and min(b - a for a, b in zip(starts, starts[1:])) >= 60_000_000
    labels = analysis.blank_labels(df.select(F.col("c").alias("channel"), F.col("e").alias("event_idx")))
    assert labels.count() == 8 and labels.where("label <> 0").count() == 0


def test_made_up_runs_are_read_back(spark, tmp_path):
    from pulselake.sources import sample_files
    from pulselake.sources.streams import open_stream

    run = sample_files.Run()
    paths = sample_files.write_run(str(tmp_path), "r", run)
    rows = records.read_triggered(spark, paths["rdt"], paths["par"])
    assert [r.tpa for r in records.amplitudes_of(rows).collect()] == [-1.0, 0.0, 0.1, 0.3, 0.5, 1.0, 3.0, 10.0]
    assert {tuple(r.channels) for r in records.channel_tuples(rows).collect()} == {(0,), (1,), (0, 1)}
    pulses = sample_files.pulses(run)
    assert rows.count() == 2 * sum(a <= 10 for _, a in pulses)
    control = records.read_control(spark, paths["con"])
    assert sorted({round(r.hours * 3600, 3) for r in control.collect()}) == [round(t, 3) for t, a in pulses if a > 10]
    offset = records.clock_offset(records.read_records(spark, paths["dig_stamps"], records.STAMPS))
    assert offset == run.offset
    stamps = records.test_stamps(spark, paths["test_stamps"], offset, channels=[0], control=False)
    assert [round(r.hours * 3600, 3) for r in stamps.orderBy("hours").collect()] == [round(t, 3) for t, a in pulses if 0 < a < 10.1]
    stream = open_stream(spark, "int16", {"0": paths["ch0"], "1": paths["ch1"]}, run.start * 1_000_000, 40, 8192)
    places = stamps.select(F.lit("0").alias("channel"), F.round(F.col("hours") * 3600 * run.rate).cast("long").alias("place"), "tpa")
    tops = {round(r.tpa, 4): r.top for r in stream.windows(places, run.length, run.length // 4).select("tpa", F.array_max("window").alias("top")).collect()}
    assert all(abs(top - 8 * tpa / (tpa + 8)) < 0.03 for tpa, top in tops.items()) and len(tops) == 6


def test_number_files(spark, tmp_path):
    (tmp_path / "e.txt").write_text("# energy efficiency\n0.5 0.1\n 2.0\t0.9 \n\n")
    assert sorted(map(tuple, recoil.read_numbers(spark, f"{tmp_path}/e.txt", ("energy", "efficiency")).collect())) == [(0.5, 0.1), (2.0, 0.9)]


def test_sliding_peaks():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 6, 203).astype(float)
    for width in (1, 2, 7, 50, 203):
        assert triggering.sliding_peaks(x, width).tolist() == [i + int(np.argmax(x[i : i + width])) for i in range(203 - width + 1)]
    assert len(triggering.sliding_peaks(x, 204)) == 0


@pytest.mark.parametrize("size", [64, 70, 333, 5000])
@pytest.mark.parametrize("block", [None, 50])
def test_record_triggers_do_not_depend_on_chunks(spark, size, block):
    rng, length, n, overlap, threshold = np.random.default_rng(8), 32, 3011, 0.125, 3.0
    x = rng.normal(0, 1, n)
    for at in rng.integers(0, n - 12, 50):
        x[at : at + 12] += rng.uniform(2, 9) * np.exp(-np.arange(12) / 4)
    edge, head, want, cur, again = 4, 2, [], 0, False
    while cur < n - length:
        trace = x[cur : cur + length] - x[cur : cur + head].mean()
        peak = int(np.argmax(trace[edge:-edge]))
        value = trace[edge + peak]
        if again:
            want.append((cur + edge + peak, value))
            cur, again = cur + peak + (block or length), False
        elif value > threshold:
            cur, again = cur + peak, True
        else:
            cur += length - 2 * edge
    chunks = spark.createDataFrame([(c, s, x[s : s + size].tolist()) for c in (1, 2) for s in range(0, n, size)], "channel long, start long, samples array<double>")
    got = sorted((r.channel, r.place, r.height) for r in triggering.record_triggers(chunks, size, length, threshold, overlap, block).collect())
    assert [(c, p) for c, p, _ in got] == [(c, p) for c in (1, 2) for p, _ in want] and len(want) > 30
    assert [h for _, _, h in got] == pytest.approx([h for _ in (1, 2) for _, h in want])


@pytest.mark.parametrize("size", [64, 333, 5000])
@pytest.mark.parametrize("transfer, down, square", [(True, 1, False), (True, 2, True), (False, 1, False)])
def test_filtered_record_triggers_match_a_plain_search(spark, size, transfer, down, square):
    rng, length, n, edge, threshold, block = np.random.default_rng(8), 64, 4011, 8, 2.0, 40
    x = rng.normal(0, 0.5, n)
    for at in rng.integers(0, n - 12, 50):
        x[at : at + 12] += rng.uniform(2, 9) * np.exp(-np.arange(12) / 4)
    pulse = np.exp(-np.arange(length // down) / 4)
    tf = np.conj(np.fft.rfft(pulse)) / (pulse**2).sum() if transfer else None
    taper = np.array(A.tukey(length // down))

    def top(at, blocked):
        rec = np.array([x[at + i : at + i + down].mean() for i in range(0, length, down)])
        rec = rec**2 if square else rec
        rec = rec - rec[: edge // down // 2].mean()
        if tf is None:
            padded = np.concatenate([np.zeros(25), rec, np.zeros(25)])
            y = [np.median(padded[i : i + 51]) for i in range(len(rec))]
        else:
            y = np.fft.irfft(np.fft.rfft(rec * taper) * tf, len(rec))
        allowed = range(max(edge // down, blocked // down), length // down - edge // down)
        best = max(allowed, key=lambda i: (y[i], -i))
        return best * down, float(y[best])

    want, at, blocked = [], length, 0
    limit = 0.3 if tf is None else threshold
    while at < n - length:
        if blocked < length - edge:
            place, height = top(at, blocked)
            if height > limit:
                at += place - edge - 1
                if at > n - length:
                    break
                place, height = top(at, blocked)
                if height > limit:
                    want.append((at + place, height, at, blocked))
                    blocked += place + block
        at, blocked = at + length - 2 * edge, max(blocked - length + 2 * edge, 0)
    rows = [(c, s, x[s : s + size].tolist()) for c in (1, None) for s in range(0, n, size)] + [(1, -7, None), (2, 0, [])]
    chunks = spark.createDataFrame(rows, "channel long, start long, samples array<double>")
    got = triggering.filtered_record_triggers(chunks, length, limit, tf, block=block, down=down, square=square).collect()
    for channel in (1, None):
        mine = sorted((r.place, r.height, r.record, r.blocked) for r in got if r.channel == channel)
        assert [(p, r, b) for p, _, r, b in mine] == [(p, r, b) for p, _, r, b in sorted(want)] and len(want) > 5
        assert [h for _, h, _, _ in mine] == pytest.approx([h for _, h, _, _ in sorted(want)])
    assert len(got) == 2 * len(want)
    empty = triggering.filtered_record_triggers(chunks.where("false"), length, limit, tf)
    assert empty.count() == 0


def test_missing_samples_split_a_stream(spark):
    x = np.zeros(600)
    x[[150, 450]] = 9.0
    pulse = np.exp(-np.arange(32) / 4)
    tf = np.conj(np.fft.rfft(pulse)) / (pulse**2).sum()
    rows = [(1, s, x[s : s + 100].tolist()) for s in (0, 100, 300, 400, 500)]
    chunks = spark.createDataFrame(rows, "channel long, start long, samples array<double>")
    assert sorted(r.place for r in triggering.filtered_record_triggers(chunks, 32, 3.0, tf).collect()) == [150, 450]
    bad = spark.createDataFrame([(1, 0, [None if i == 150 else float(v) for i, v in enumerate(x)])], chunks.schema)
    assert [r.place for r in triggering.filtered_record_triggers(bad, 32, 3.0, tf).collect()] == [450]


def test_made_up_runs_are_imported(spark, tmp_path):
    from pulselake.operators import imports
    from pulselake.sources import sample_files
    from pulselake.sources.streams import open_stream

    run = sample_files.Run()
    paths = sample_files.write_run(str(tmp_path), "r", run)
    stream = open_stream(spark, "int16", {"0": paths["ch0"], "1": paths["ch1"]}, run.start * 1_000_000, 40, 8192)
    pulses = [(round(t * run.rate), a) for t, a in sample_files.pulses(run)]
    stamps = spark.createDataFrame([(p, a) for p, a in pulses if a > 0] + [(None, 3.0), (5, 1e-9)], "place long, tpa double")
    mine = [p for p, a in pulses if a == 0] + [p + 3 for p, a in pulses if a > 0]
    triggers = spark.createDataFrame(list(zip(mine, range(len(mine)))) + [(None, -1)], "place long, id long")
    found = imports.sorted_triggers(triggers, stamps, 100, 0.001, 10.1).cache()
    first, last = min(p for p, a in pulses if a > 0), max(p for p, a in pulses if a > 0)
    kinds = {k: sorted(r.place for r in found.where(F.col("kind") == k).collect()) for k in ("events", "testpulses", "controlpulses")}
    # The trigger after the last stamp is no event even where no stamp hides it.
    assert kinds["events"] == [p for p, a in pulses if a == 0 and first <= p <= last]
    assert kinds["testpulses"] == [p for p, a in pulses if 0 < a < 10.1] and kinds["controlpulses"] == [p for p, a in pulses if a >= 10.1]
    events = imports.imported_events(stream.chunks, stream.size, found, run.length)
    groups = Groups(spark, str(tmp_path / "groups"))
    imports.write_imported(groups, events)
    whole = lambda p: p - run.length // 4 >= 0 and p - run.length // 4 + run.length <= stream.time.length
    for kind in ("events", "testpulses"):
        got = groups.get(kind)
        assert got.count() == 2 * sum(map(whole, kinds[kind])) and got.where(F.size("event") != run.length).count() == 0
    assert groups.get("controlpulses").where("pulse_height > 1").count() > 0
    none = imports.sorted_triggers(triggers, stamps.where("false"), 100, 0.001, 10.1)
    assert none.count() == 0


def test_aligned_amplitudes_take_the_nearest_of_each_channel(spark):
    from pulselake.operators import imports

    rng = np.random.default_rng(4)
    rows = [(int(c), int(t), i, float(i % 7)) for i, (c, t) in enumerate(zip(rng.integers(0, 3, 400), rng.integers(0, 40000, 400)))]
    want, free = [], -1
    for t, i in sorted((t, i) for _, t, i, _ in rows):
        if t > free:
            near = [min((abs(u - t), u, j, a) for d, u, j, a in rows if d == c)[3] for c in range(3)]
            want.append((t, i, near))
            free = t + 150
    triggers = spark.createDataFrame(rows, "channel long, t long, id long, tpa double")
    for chunk in (700, 10**9):
        got = sorted((r.t, r.id, r.tpas) for r in imports.aligned_amplitudes(triggers, 150, chunk).collect())
        assert got == want
    assert imports.aligned_amplitudes(triggers.where("false"), 150).count() == 0


def test_orthogonal_polynomials_find_the_least_distances():
    rng = np.random.default_rng(5)
    x = np.sort(rng.uniform(0.5, 9, (6, 12)), axis=1)
    y = 1.7 * x + rng.normal(0, 0.4, x.shape)
    b, covariance, variance = fits.orthogonal_polynomials(x, y, np.full_like(x, 0.3), 1)
    for row in range(6):
        # A line through zero by total least squares, with x in units of its uncertainty.
        least = np.linalg.svd(np.column_stack([x[row] / 0.3, y[row]]))[2][-1]
        assert b[row, 0] == pytest.approx(-least[0] / least[1] / 0.3, rel=1e-9)
        w = 1 / (1 + b[row, 0] ** 2 * 0.09)
        assert variance[row] == pytest.approx(w * ((y[row] - b[row, 0] * x[row]) ** 2).sum() / 11, rel=1e-9) and covariance[row, 0, 0] > 0
    s = rng.uniform(0.05, 0.4, x.shape)
    y = 0.5 + 2 * x - 0.1 * x**2 + rng.normal(0, 0.3, x.shape)
    b, _, variance = fits.orthogonal_polynomials(x, y, s, 2, through_zero=False)
    moves = np.linspace(-3, 3, 4001)[:, None]

    def cost(p, row):
        t = x[row] + moves * s[row]
        return ((np.polyval(p[::-1], t) - y[row]) ** 2 + moves**2).min(axis=0).sum()

    for row in range(6):
        best = cost(b[row], row)
        assert variance[row] * 9 == pytest.approx(best, rel=1e-4)
        for _ in range(40):
            assert cost(b[row] * (1 + rng.normal(0, 0.02, 3)), row) >= best - 1e-4
    flat, _, _ = fits.orthogonal_polynomials(x, y, np.zeros_like(x), 2, through_zero=False)
    assert flat[0] == pytest.approx(np.polyfit(x[0], y[0], 2)[::-1])


def test_orthogonal_calibration(spark):
    from pulselake.operators import calibrate

    rng = np.random.default_rng(6)
    rows = [(1, 60 * i, i, float(1 + i % 4), float(1 + i % 4) * 1.5 - 0.05 * (1 + i % 4) ** 2 + rng.normal(0, 0.01)) for i in range(200)]
    pulses = spark.createDataFrame(rows, "channel long, t long, id long, tpa double, value double")
    events = spark.createDataFrame([(1, 100 * i, i, 0.5 + 0.4 * i) for i in range(12)] + [(1, 5, 99, None)], "channel long, t long, id long, value double")
    plain = {r.id: r for r in calibrate.EnergyCalibration(pulses, 10**6, 3600.0, order=3)(events).collect()}
    found = {r.id: r for r in calibrate.EnergyCalibration(pulses, 10**6, 3600.0, order=3, orthogonal=True)(events).collect()}
    assert len(found) == 13 and found[99].tpa is None and plain[3].sigma is None
    assert all(found[i].tpa == pytest.approx(plain[i].tpa, abs=0.02) and 0 < found[i].sigma < 0.1 for i in range(12))


def test_cubic_baseline_equals_its_sql_to_the_sign_of_zero(spark, tmp_path):
    rng = np.random.default_rng(8)
    rows = [(i, "a", (rng.normal(size=64) * 10.0 ** -(i % 6)).tolist()) for i in range(120)]
    spark.createDataFrame(rows, "vec_id long, label string, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    found = {r.vec_id: repr((r.coefficients, r.rms)) for r in catalog.QUERIES["cubic_baseline"](spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = {r[0]: repr((r[1], r[2])) for r in con.execute(catalog.ORACLES["cubic_baseline"]).fetchall()}
    assert any("-0.0," in w or "-0.0]" in w for w in want.values())
    assert found == want
