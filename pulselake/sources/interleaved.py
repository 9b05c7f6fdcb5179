"""Interleaved stream files with a bit-mask header, 24-bit streams, and small text tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulselake.sources.records import _file_system, read_records

#: Fixed values of the file header, and the columns that the bits of its format word stand for.
HEADER = np.dtype([("id", "<i4"), ("n_bytes", "<i4"), ("down", "<i4"), ("format", "<i4"), ("timestamp", "<u8")])
BITS = {0: "Time", 1: "Settings", 2: "DAC1", 3: "DAC2", 4: "DAC3", 5: "DAC4", 6: "ADC1", 7: "ADC2", 8: "ADC3"}
WIDE_DAC, WIDE_ADC = 16, 17
SWING = 39.3216


def columns_of(format_word: int) -> list[tuple[str, str, int]]:
    """The layout of a row of samples."""
    wide = {"DAC": format_word >> WIDE_DAC & 1, "ADC": format_word >> WIDE_ADC & 1}
    kinds = {"Time": "<u8", "Settings": "<i4"}
    return [(name, kinds.get(name) or ("<i4" if wide[name[:3]] else "<i2"), 1) for bit, name in BITS.items() if format_word >> bit & 1]


def read_interleaved(spark: SparkSession, path: str, rows: int = 1 << 20) -> DataFrame:
    """place (row of the file) and one column of samples for each channel of the file's header; ADC and DAC columns in volts."""
    system, inner = _file_system(path)
    with system.open_input_file(inner) as file:
        head = np.frombuffer(file.read(HEADER.itemsize), HEADER)[0]
    layout = columns_of(int(head["format"]))
    if not layout:
        raise ValueError(f"{path} names no channels")
    out = read_records(spark, path, layout, HEADER.itemsize, rows)
    volts = lambda name, kind: F.col(name) * (SWING / (2**24 if kind == "<i4" else 2**16))
    return out.select(F.col("record").alias("place"), *[(volts(n, k) if n[:3] in ("ADC", "DAC") else F.col(n)).alias(n) for n, k, _ in layout])


def read_24_bit(spark: SparkSession, path: str, skip: int = 0, swing: float = SWING, rows: int = 1 << 20) -> DataFrame:
    """file, place, volts of a stream of signed 24-bit little-endian samples."""
    raw = read_records(spark, path, [("low", "<i2", 1), ("high", "|i1", 1)], skip, rows)
    count = F.col("high").cast("long") * 65536 + F.pmod(F.col("low").cast("long"), F.lit(65536))
    return raw.select("file", F.col("record").alias("place"), (count * (swing / 2**24)).alias("volts"))


def read_xy(spark: SparkSession, path: str, names: list[str], skip: int = 4, separator: str = "\t") -> DataFrame:
    """Columns of numbers after `skip` lines of a small text file; a file is one row until it is split."""
    whole = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("line", "text"))
    parts = F.split(F.col("text"), separator)
    kept = whole.where((F.col("line") >= skip) & (F.trim("text") != ""))
    return kept.select("line", *[F.trim(F.get(parts, F.lit(i))).cast("double").alias(n) for i, n in enumerate(names)]).orderBy("line").drop("line")


def write_xy(df: DataFrame, path: str, title: str, axes: list[str]) -> None:
    """A title, a line for each axis and tab-separated rows, as one text file in a folder. For plots: the rows are aggregates."""
    head = df.sparkSession.createDataFrame([(-1, "\n".join([title, *axes]))], "at long, value string")
    line = F.concat_ws("\t", *[F.col(c).cast("string") for c in df.columns])
    head.unionByName(df.select(F.monotonically_increasing_id().alias("at"), line.alias("value"))).coalesce(1).sortWithinPartitions("at").select("value").write.mode("overwrite").text(path)


def write_labels(labels: DataFrame, path: str, ident: str = "event_idx") -> None:
    """Labels or predictions with their event numbers, as CSV."""
    labels.select("channel", ident, "label").write.mode("overwrite").csv(path, header=True)


def read_labels(spark: SparkSession, path: str, ident: str = "event_idx") -> DataFrame:
    return spark.read.csv(path, header=True, schema=f"channel int, {ident} long, label int")


def with_labels(events: DataFrame, labels: DataFrame, name: str = "label", ident: str = "event_idx", missing: int = 0) -> DataFrame:
    """events with a label or prediction by channel and number, `missing` where there is none."""
    side = labels.select("channel", ident, F.col("label").alias(name))
    return events.join(side, ["channel", ident], "left").withColumn(name, F.coalesce(name, F.lit(missing)))


def labelled(labels: DataFrame, code: int, column: str = "label", ident: str = "event_idx") -> DataFrame:
    """The events of which any channel has a code."""
    return labels.where(F.col(column) == code).select(ident).distinct()
