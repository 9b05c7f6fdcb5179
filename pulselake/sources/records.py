"""A Python data source for files of fixed binary records, and the record layouts that detectors write.

`spark.read.format("records")` plans partitions of whole records within a file, so a large file is read by many tasks;
each maps its bytes to columns with numpy. Options: path (a file or folder), layout (JSON of name, numpy type and count),
skip (header bytes), records (of a partition).
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Fixed values of the formats: field names, types and counts.
STAMPS = [("stamp", "<u8", 1), ("bank", "<u4", 1), ("bank2", "<u4", 1)]
TEST_STAMPS = [("stamp", "<u8", 1), ("tpa", "<f4", 1), ("tpch", "<u4", 1)]
CONTROL = [("detector_nmbr", "<i4", 1), ("pulse_height", "<f4", 1), ("time_stamp_low", "<u4", 1), ("time_stamp_high", "<u4", 1), ("dead_time", "<f4", 1), ("mus_since_last_tp", "<i4", 1)]
CONTROL_HEADER = 12
_SPARK = {"i1": "byte", "i2": "short", "i4": "int", "u4": "long", "u8": "decimal(20,0)", "i8": "long", "f4": "float", "f8": "double"}
_ARROW = {"i1": pa.int8(), "i2": pa.int16(), "i4": pa.int32(), "u4": pa.int64(), "u8": pa.decimal128(20), "i8": pa.int64(), "f4": pa.float32(), "f8": pa.float64()}


def triggered_layout(record_length: int, ints_in_header: int = 7, dvm_channels: int = 0) -> list[tuple[str, str, int]]:
    """The layout of hardware-triggered records."""
    ints = ["detector_nmbr", "coincide_pulses", "trig_count", "trig_delay", "abs_time_s", "abs_time_mus"]
    ints += ["delay_ch_tp"] * (ints_in_header == 7) + ["time_low", "time_high", "qcd_events"]
    reals = ["hours", "dead_time", "test_pulse_amplitude", "dac_output"]
    fields = [(n, "<i4", 1) for n in ints] + [(n, "<f4", 1) for n in reals]
    if dvm_channels:
        fields.append(("dvm_channels", "<f4", -dvm_channels))
    return [*fields, ("samples", "<i2", -record_length)]


def dtype_of(layout: list) -> np.dtype:
    """A negative count is an array of that length."""
    return np.dtype([(n, t, (-c,)) if c < 0 else (n, t) for n, t, c in layout])


def _whole_numbers(x: np.ndarray) -> pa.Array:
    """Unsigned 64-bit numbers as decimals: 128 bits each, the upper half zero."""
    wide = np.zeros((len(x), 2), "<u8")
    wide[:, 0] = x
    return pa.Array.from_buffers(_ARROW["u8"], len(x), [None, pa.py_buffer(wide.tobytes())])


class RecordRange(InputPartition):
    def __init__(self, path: str, first: int, count: int):
        self.path, self.first, self.count = path, first, count


def _file_system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))


class RecordReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.layout = options["path"], json.loads(options["layout"])
        self.skip, self.most = int(options.get("skip", 0)), int(options.get("records", 4096))
        self.dtype = dtype_of(self.layout)
        #: Only what is left of each file after whole blocks of so many records.
        self.after = int(options.get("after", 0))

    def partitions(self) -> Sequence[InputPartition]:
        from pyarrow import fs

        system, path = _file_system(self.path)
        info = system.get_file_info(path)
        files = [info] if info.is_file else [f for f in system.get_file_info(fs.FileSelector(path)) if f.is_file]
        found = []
        for f in sorted(files, key=lambda x: x.path):
            n = max(0, f.size - self.skip) // self.dtype.itemsize
            low = n // self.after * self.after if self.after else 0
            found += [RecordRange(f.path, at, min(self.most, n - at)) for at in range(low, n, self.most)]
        return found or [RecordRange("", 0, 0)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if not partition.count:
            return
        system, _ = _file_system(self.path)
        with system.open_input_file(partition.path) as file:
            file.seek(self.skip + partition.first * self.dtype.itemsize)
            rows = np.frombuffer(file.read(partition.count * self.dtype.itemsize), self.dtype)
        columns = [pa.array(np.arange(partition.first, partition.first + len(rows))), pa.array([partition.path] * len(rows))]
        for name, kind, count in self.layout:
            flat = np.ascontiguousarray(rows[name]).reshape(-1)
            values = _whole_numbers(flat) if kind[1:] == "u8" else pa.array(flat.astype("i8") if kind[1:] == "u4" else flat, _ARROW[kind[1:]])
            columns.append(pa.FixedSizeListArray.from_arrays(values, -count).cast(pa.list_(values.type)) if count < 0 else values)
        yield pa.RecordBatch.from_arrays(columns, names=["record", "file", *[f[0] for f in self.layout]])


class RecordSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "records"

    def schema(self) -> str:
        kinds = [f"{n} array<{_SPARK[t[1:]]}>" if c < 0 else f"{n} {_SPARK[t[1:]]}" for n, t, c in json.loads(self.options["layout"])]
        return ", ".join(["record long", "file string", *kinds])

    def reader(self, schema) -> DataSourceReader:
        return RecordReader(dict(self.options))


def read_records(spark: SparkSession, path: str, layout: list, skip: int = 0, records: int = 4096, after: int = 0) -> DataFrame:
    """record, file and the layout's columns; `after` reads only what is left of each file after whole blocks of so many records."""
    spark.dataSource.register(RecordSource)
    return spark.read.format("records").option("layout", json.dumps(layout)).option("skip", skip).option("records", records).option("after", after).load(path)


#: Fixed names of the run header's lines.
HEADER = {
    "start_s": r"Timeofday at start\s*\[s\]",
    "start_us": r"Timeofday at start\s*\[us\]",
    "stop_s": r"Timeofday at stop\s*\[s\]",
    "stop_us": r"Timeofday at stop\s*\[us\]",
    "measuring_time_h": r"Measuring time\s*\[h\]",
    "ints_in_header": "Integers in header",
    "dvm_channels": "DVM channels",
    "record_length": "Record length",
    "time_base_us": r"Time base\s*\[us\]",
}


def run_header(spark: SparkSession, path: str) -> dict[str, float]:
    """The numbers of a run header, a small text file."""
    text = "\n".join(r["value"] for r in spark.read.text(path).collect())
    found = {k: re.search(p + r"\s*:\s*([0-9.]+)", text) for k, p in HEADER.items()}
    if missing := [k for k, m in found.items() if not m]:
        raise ValueError(f"{path} has no {', '.join(missing)}")
    return {k: float(m[1]) if "." in m[1] else int(m[1]) for k, m in found.items()}


def read_triggered(spark: SparkSession, path: str, header: str) -> DataFrame:
    """Hardware-triggered records with t (microseconds), volts, and the group that the test pulse amplitude names."""
    head = run_header(spark, header)
    rows = read_records(spark, path, triggered_layout(head["record_length"], head["ints_in_header"], head["dvm_channels"]))
    tpa = F.col("test_pulse_amplitude")
    group = F.when(tpa == 0, "events").when(tpa == -1, "noise").when(tpa > 10, "controlpulses").otherwise("testpulses")
    volts = F.transform("samples", lambda n: F.lit(-10.0) + (n.cast("double") + 32768) * (20 / 65536))
    return rows.withColumn("t", F.col("abs_time_s").cast("long") * 1_000_000 + F.col("abs_time_mus")).withColumn("group", group).withColumn("volts", volts)


def read_stream(spark: SparkSession, path: str, chunk: int = 65536) -> DataFrame:
    """A continuous int16 stream as chunks: file, start (number of the first sample), samples. The last chunk of a file is shorter;
    its samples alone are read one by one."""
    whole = read_records(spark, path, [("samples", "<i2", -chunk)], records=64)
    whole = whole.select("file", (F.col("record") * chunk).alias("start"), "samples")
    rest = read_records(spark, path, [("sample", "<i2", 1)], records=chunk, after=chunk)
    tail = rest.groupBy("file").agg(F.min("record").alias("start"), F.array_sort(F.collect_list(F.struct("record", "sample"))).alias("s"))
    return whole.unionByName(tail.select("file", "start", F.transform("s", lambda r: r["sample"]).alias("samples")))


def first_records(df: DataFrame, n: int = 100) -> DataFrame:
    """The first n records of a file in order, for a look."""
    return df.orderBy("record").limit(n)


def clock_frequency(triggered: DataFrame, last: int = 10) -> float:
    """Ticks a second of the clock of triggered records (time_high, time_low, abs_time_s, abs_time_mus): over the last records, ticks
    over the time since the first record, which starts at zero ticks."""
    ticks = F.col("time_high") * 4294967296.0 + F.col("time_low")
    time = F.col("abs_time_s") + F.col("abs_time_mus") / 1e6
    begin = triggered.orderBy("record").select(time.alias("t0"), ticks.alias("k0")).first()
    rows = triggered.orderBy(F.col("record").desc()).limit(last)
    return float(rows.agg(F.avg((ticks - begin["k0"]) / (time - begin["t0"]))).first()[0])


def clock_offset(stamps: DataFrame) -> int:
    """Ticks between the start of the stream and that of the clock, from the first two bank stamps: the second less twice the first."""
    a, b = (int(r["stamp"]) for r in stamps.orderBy("record").limit(2).collect())
    return b - 2 * a


def test_stamps(spark: SparkSession, path: str, offset: int = 0, clock: float = 1e7, channels: list[int] | None = None, control: bool | None = None, least_control: float = 10.1) -> DataFrame:
    """hours (since the stream's start), tpa, tpch of test pulse stamps after it; control pulses only, without them, or both."""
    rows = read_records(spark, path, TEST_STAMPS).select(((F.col("stamp").cast("decimal(20,0)") - F.lit(offset).cast("decimal(20,0)")).cast("double") / clock / 3600).alias("hours"), "tpa", "tpch")
    rows = rows.where("hours > 0")
    if channels is not None:
        rows = rows.where(F.col("tpch").isin(channels))
    return rows if control is None else rows.where(F.col("tpa") > least_control if control else F.col("tpa") < least_control)


def start_time(files: DataFrame, channel: str, label: str) -> int | None:
    """Seconds (UTC) at which the stream file of a channel was created, from a table of files (CH, LABEL, TYPE, CREATED)."""
    found = files.where((F.col("CH") == channel) & (F.col("LABEL") == label) & (F.col("TYPE").cast("string") == "0"))
    row = found.select(F.unix_timestamp(F.col("CREATED"), "yyyy-MM-dd HH:mm:ss").alias("s")).first()
    return row["s"] if row else None


def coincident_records(triggered: DataFrame) -> DataFrame:
    """record, detector_nmbr and channels: the sorted tuple of detectors that share the record's trigger count."""
    groups = triggered.groupBy("trig_count").agg(F.array_sort(F.collect_set("detector_nmbr")).alias("channels")).withColumnRenamed("trig_count", "count_of_")
    return triggered.join(groups, F.col("trig_count").eqNullSafe(F.col("count_of_"))).drop("count_of_")


def channel_tuples(triggered: DataFrame) -> DataFrame:
    """channels, n: single detectors and tuples of detectors that a file holds, with their triggers."""
    tuples = coincident_records(triggered).select("trig_count", "channels").distinct().groupBy("channels").agg(F.count(F.lit(1)).alias("n"))
    singles = triggered.groupBy(F.array("detector_nmbr").alias("channels")).agg(F.count_distinct("trig_count").alias("n"))
    return tuples.where(F.size("channels") > 1).unionByName(singles)


def amplitudes_of(triggered: DataFrame) -> DataFrame:
    """tpa: the distinct test pulse amplitudes in order."""
    return triggered.select(F.round(F.col("test_pulse_amplitude").cast("double"), 4).alias("tpa")).distinct().orderBy("tpa")


def events_of(triggered: DataFrame, channels: list[int]) -> DataFrame:
    """channel, event_idx, t, tpa, x of the triggers that exactly these detectors share, numbered by trigger count in order."""
    from pulselake.operators.ordered import ranked

    wanted = F.array(*[F.lit(c) for c in sorted(channels)])
    rows = triggered.where(F.col("detector_nmbr").isin(channels)) if len(channels) == 1 else coincident_records(triggered).where(F.col("channels") == wanted)
    numbers = ranked(rows.select("trig_count").distinct(), "trig_count", "trig_count", "event_idx").withColumnRenamed("trig_count", "count_of_")
    met = rows.join(numbers, F.col("trig_count") == F.col("count_of_"))
    t = F.col("abs_time_s").cast("long") * 1_000_000 + F.col("abs_time_mus")
    return met.select(F.col("detector_nmbr").alias("channel"), "event_idx", t.alias("t"), F.col("test_pulse_amplitude").alias("tpa"), F.col("samples").cast("array<double>").alias("x"))


def convert(spark: SparkSession, path: str, header: str, groups, channels: list[int], amplitudes: tuple[float, ...] = (0.0, 1.0, -1.0)) -> list[str]:
    """Writes the records of a run, split by what their test pulse amplitude names, to a catalog of groups; amplitude 1.0 stands for all test
    and control pulses. Gives the groups written."""
    rows = read_triggered(spark, path, header).where(F.col("detector_nmbr").isin(channels))
    kinds = {0.0: ["events"], -1.0: ["noise"], 1.0: ["testpulses", "controlpulses"]}
    names = [g for a in amplitudes for g in kinds[float(a)]]
    for name in names:
        part = rows.where(F.col("group") == name)
        groups.put(name, events_of(part, channels).withColumn("hours", (F.col("t") - F.lit(run_header(spark, header)["start_s"] * 1_000_000)) / 3.6e9))
    return names


def include(groups, group: str, more: DataFrame, origin: str) -> None:
    """Adds records to a group under the name of their file, in place of what that file gave before; event numbers go on."""
    old = groups.get(group)
    kept = old.where(F.col("origin") != origin) if "origin" in old.columns else old.withColumn("origin", F.lit("first"))
    after = (kept.agg(F.max("event_idx")).first()[0] or -1) + 1
    groups.put(group, kept.unionByName(more.withColumn("event_idx", F.col("event_idx") + after).withColumn("origin", F.lit(origin)), allowMissingColumns=True))


def read_control(spark: SparkSession, path: str, clock: float = 1e7) -> DataFrame:
    """Control pulses with hours since the clock's start."""
    rows = read_records(spark, path, CONTROL, CONTROL_HEADER)
    return rows.withColumn("hours", (F.col("time_stamp_high") * 4294967296.0 + F.col("time_stamp_low")) / clock / 3600)


#: Fixed values of the muon panel's records and of the monitor file's header.
PANELS = [("time_low", "<u4", 1), ("time_high", "<u4", 1), ("number_channels", "<i2", 1), ("panel", "<i2", -21), ("panel_id", "<i2", -21)]
MONITOR_HEADER = np.dtype([("version", "S12"), ("time_s", "<i8"), ("time_mus", "<i8"), ("n", "<i4")])
MONITOR_NAME = 48


def read_panels(spark: SparkSession, path: str, clock: float = 1e7) -> DataFrame:
    """Muon panel records with hours since the clock's start."""
    rows = read_records(spark, path, PANELS)
    return rows.withColumn("hours", (F.col("time_high") * 4294967296.0 + F.col("time_low")) / clock / 3600)


def read_monitor(spark: SparkSession, path: str) -> DataFrame:
    """Slow control: t (microseconds) and one column for each name that the file's own header lists."""
    system, inner = _file_system(path)
    with system.open_input_file(inner) as file:
        head = np.frombuffer(file.read(MONITOR_HEADER.itemsize), MONITOR_HEADER)[0]
        n = int(head["n"])
        names = [file.read(MONITOR_NAME).split(b"\0")[0].decode("latin-1").strip() for _ in range(n)]
    layout = [("time_s", "<i8", 1), ("time_mus", "<i8", 1), ("values", "<f4", -n)]
    rows = read_records(spark, path, layout, MONITOR_HEADER.itemsize + n * MONITOR_NAME)
    return rows.select((F.col("time_s") * 1_000_000 + F.col("time_mus")).alias("t"), *[F.get("values", F.lit(i)).alias(name) for i, name in enumerate(names)])
