"""What the corpus operators share: tables, the shared folder, and words as numpy arrays."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
ASCII_SPACE = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Hadoop's checksummed local file system starts a process for the permissions of each file, and one more for the file of its checksums.
#: Files of the shared folder are written by the plain one, without that second file; Parquet's own checksums stay. Other file systems are
#: not concerned.
PLAIN_FILES = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true", "parquet.page.write-checksum.enabled": "true"}
#: What reads such files checks their pages.
CHECKED_PAGES = {"parquet.page.verify-checksum.enabled": "true"}


def shared_dir(spark: SparkSession) -> str:
    """The folder all machines see, from spark.checkpoint.dir; on a single machine a local one where none is set."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines see")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="pulselake-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read back: its lineage ends there."""
    path = shared_path(df.sparkSession, name)
    df.write.options(**PLAIN_FILES).parquet(path)
    return df.sparkSession.read.options(**CHECKED_PAGES).schema(df.schema).parquet(path)


def even_keys(spark: SparkSession, most: int) -> list[int]:
    """At least `most` whole numbers that Spark's hash partitioning deals evenly, the same count to each shuffle partition."""
    parts, size = partitions(spark), 64
    each = -(-most // parts)
    while True:
        size *= 4
        dealt = spark.range(size * parts).select(F.col("id").cast("int").alias("k"))
        dealt = dealt.groupBy(F.pmod(F.hash("k"), F.lit(parts)).alias("p")).agg(F.slice(F.array_sort(F.collect_list("k")), 1, each).alias("k")).collect()
        if len(dealt) == parts and all(len(r["k"]) == each for r in dealt):
            return [r["k"][i] for i in range(each) for r in sorted(dealt, key=lambda r: r["p"])]


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fresh(name: str, *frames: DataFrame) -> str:
    """name, with underscores added until none of the frames has a column of that name."""
    taken = {c.lower() for f in frames for c in f.columns}
    while name.lower() in taken:
        name += "_"
    return name


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, all other characters as they are; pure ASCII takes the fast path."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


# --- words as numpy arrays -------------------------------------------------

#: Bytes of text that are hashed at once. Bounds the memory of the arrays, not the length of a text.
BLOCK_BYTES = 1 << 20
#: Fixed values of the rolling hash: an odd base and its inverse modulo 2^64, and the finaliser's factors.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_MIX1, _MIX2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_SHIFT = np.uint64(33)
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}

SPACE_LUT = np.zeros(256, bool)
SPACE_LUT[[0x20, *range(0x09, 0x0E)]] = True


def _power(kind: str, n: int) -> np.ndarray:
    if len(_powers[kind]) < n:
        size = max(n, 1 << 16, min(2 * len(_powers[kind]), n + (1 << 20)))
        steps = np.full(size, _BASE if kind == "up" else _INVERSE, np.uint64)
        steps[0] = 1
        _powers[kind] = np.cumprod(steps)
    return _powers[kind][:n]


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> _SHIFT)
    h *= _MIX1
    h ^= h >> _SHIFT
    h *= _MIX2
    h ^= h >> _SHIFT
    return h


def _rolling(values: np.ndarray) -> np.ndarray:
    sums = np.empty(len(values) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(values * _power("up", len(values)), out=sums[1:])
    return sums


def sequence_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k word hashes, by its first position."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    sums = _rolling(words)
    return mixed((sums[k:] - sums[:n]) * _power("down", n))


class Ranges:
    """Hashes of ranges of word hashes, by their words and their number; the sums over the words are made once."""

    def __init__(self, words: np.ndarray):
        self.sums = _rolling(words)

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mixed((self.sums[ends] - self.sums[starts]) * _power("down", len(self.sums))[starts] + (ends - starts).astype(np.uint64))


class Words:
    """The words of a block of texts: byte ranges, 64-bit hashes, and the first word of each text."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lut: np.ndarray = SPACE_LUT):
        self.data, self.offsets = data, offsets
        apart = lut[data]
        before, after = np.empty(len(data), bool), np.empty(len(data), bool)
        before[:1], after[-1:] = True, True
        before[1:], after[:-1] = apart[:-1], apart[1:]
        full = offsets[:-1] < offsets[1:]
        before[offsets[:-1][full]] = True
        after[offsets[1:][full] - 1] = True
        word = ~apart
        self.starts = np.flatnonzero(word & before)
        self.ends = np.flatnonzero(word & after) + 1
        #: Word i of text d is at first[d] + i.
        self.first = np.searchsorted(self.starts, offsets)

    def hashes(self) -> np.ndarray:
        sums = _rolling(self.data.astype(np.uint64) + np.uint64(1))
        return mixed((sums[self.ends] - sums[self.starts]) * _power("down", len(self.data) + 1)[self.starts] + (self.ends - self.starts).astype(np.uint64))


def text_blocks(column: pa.Array | pa.ChunkedArray, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of consecutive texts with up to about `most` bytes; a longer text is a block of its own. Null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = (column if column.null_count == 0 else column.fill_null("")).cast(pa.large_string())
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + most, "right")) - 1)
        yield at, to, data[ends[at] : ends[to]], ends[at : to + 1] - ends[at]
        at = to
