"""WARC archives: a Python data source that writes records with revisits and reads headers first.

Writing: a record is a gzip member of its own (as the format asks), whose header carries the member's length in the extra
field "sl"; beside each archive file an index file lists where a record starts in every INDEX_BYTES of it. A task writes its
files under new names; a manifest that names them is written when all tasks are done, so files of failed or repeated
tasks are never read. Uncompressed archives have the same index.

Reading plans partitions of RANGE_BYTES within a file: a task looks up the first record that starts in its range and
reads on to the first that starts past it. It reads a record's header block, decides by the pushed-down
comparisons on record_type and the other header columns, and only then touches the payload: an unwanted one is
skipped by seeking, is not inflated and never becomes a value. `payload=false`
skips all of them. Archives of other writers (no index, no lengths) are read too: a partition for each file, inflated in passing.

Defined results of `write_warc`: a null html is an empty payload; of equal payloads of at least `least` bytes
the rows with the largest id are responses and the others revisits of it; a null id is always a response;
a null url has no target header; an empty table writes no records; other columns are not read.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from bisect import bisect_left
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, WriterCommitMessage

END = "\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SCHEMA = "record_type string, record_id string, target_uri string, payload_digest string, refers_to string, payload_length long, content_length long, file string, payload binary"
#: Header of each column that filters may be pushed down to.
HEADERS = {"record_type": "warc-type", "record_id": "warc-record-id", "target_uri": "warc-target-uri", "payload_digest": "warc-payload-digest", "refers_to": "warc-refers-to"}
#: Bytes of payload in one batch of rows.
BATCH_BYTES = 8 << 20
#: Bytes of an archive file between two entries of its index, of a partition, and of a file.
INDEX_BYTES, RANGE_BYTES, FILE_BYTES = 1 << 18, 32 << 20, 1 << 30
#: The start of a gzip member with an extra field, and that field's name and size.
GZIP, EXTRA = b"\x1f\x8b\x08\x04\x00\x00\x00\x00\x00\x03", struct.Struct("<H2sHII")
MANIFEST, INDEX = "_manifest.json", ".idx"


def urn(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("null")), F.lit(">"))


def page_of(record_id: Column) -> Column:
    return F.regexp_extract(record_id, r"^<urn:page:(-?\d+)>$", 1).try_cast("long")


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 1000, compression: str = "gzip") -> None:
    """Writes a record for each row of pages to files under path, a folder that is not there yet."""
    payload = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(F.col(id_col).alias("id"), F.regexp_replace(F.col(url_col), r"\s", "%20").alias("url"), payload.alias("payload"))
    keyed = rows.select("id", F.sha1("payload").alias("digest"), F.octet_length("payload").alias("size")).where((F.col("size") >= least) & F.col("id").isNotNull()).drop("size")
    firsts = keyed.groupBy("digest").agg(F.max("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    revisits = keyed.join(firsts, "digest").where("id < first").select(F.col("id").alias("r_id"), F.col("digest").alias("r_digest"), "first").distinct()
    digest = F.sha1("payload")
    joined = rows.join(revisits, (F.col("id") == F.col("r_id")) & (digest == F.col("r_digest")), "left")
    again = F.col("first").isNotNull()
    block = F.when(again, F.lit("")).otherwise(F.col("payload"))
    lines = F.concat_ws(
        "\r\n",
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(again, F.lit("revisit")).otherwise(F.lit("response"))),
        F.concat(F.lit("WARC-Record-ID: "), urn(F.col("id"))),
        F.lit(f"WARC-Date: {DATE}"),
        F.concat(F.lit("WARC-Target-URI: "), F.col("url")),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), digest),
        F.when(again, F.concat(F.lit(f"WARC-Profile: {PROFILE}\r\nWARC-Refers-To: "), urn(F.col("first")))),
        F.concat(F.lit("WARC-Payload-Length: "), F.octet_length("payload").cast("string")),
        F.lit("Content-Type: text/html; charset=utf-8"),
        F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
    )
    records = joined.select(F.concat(lines, F.lit(END)).alias("head"), block.alias("block"))
    pages.sparkSession.dataSource.register(WarcSource)
    records.write.format("warc").option("path", path).option("compression", compression).mode("append").save()


def member(head: bytes, block: bytes, level: int = 6) -> bytes:
    """A record as a gzip member that knows its own length."""
    data = head + block + END.encode()
    squeeze = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = squeeze.compress(data) + squeeze.flush()
    size = len(GZIP) + EXTRA.size + len(body) + 8
    return GZIP + EXTRA.pack(12, b"sl", 8, size, len(data) & 0xFFFFFFFF) + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class WarcWriter(DataSourceArrowWriter):
    """Rows (head, block) to archive files with their indexes."""

    def __init__(self, options: dict):
        self.path, self.gzip = options["path"].rstrip("/"), options.get("compression", "gzip") == "gzip"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, path = _opened(self.path)
        system.create_dir(path, recursive=True)
        files, file, index, at, marked = [], None, [], 0, 0
        try:
            for batch in iterator:
                for head, block in zip(batch.column(0), batch.column(1), strict=True):
                    if file is None or at >= FILE_BYTES:
                        self._close(system, path, files, file, index)
                        files.append(f"part-{uuid.uuid4().hex}.warc" + ".gz" * self.gzip)
                        file, index, at, marked = system.open_output_stream(f"{path}/{files[-1]}", compression=None), [0], 0, 0
                    if at - marked >= INDEX_BYTES:
                        index.append(at)
                        marked = at
                    parts = (head.as_py().encode(), block.as_py().encode())
                    data = member(*parts) if self.gzip else b"".join((*parts, END.encode()))
                    file.write(data)
                    at += len(data)
        finally:
            self._close(system, path, files, file, index)
        return Written(files)

    def _close(self, system, path: str, files: list[str], file, index: list[int]) -> None:
        if file is not None:
            file.close()
            with system.open_output_stream(f"{path}/{files[-1]}{INDEX}", compression=None) as out:
                out.write(json.dumps(index).encode())

    def commit(self, messages: list[Written | None]) -> None:
        system, path = _opened(self.path)
        system.create_dir(path, recursive=True)
        with system.open_output_stream(f"{path}/{MANIFEST}") as out:
            out.write(json.dumps(sorted(f for m in messages if m for f in m.files)).encode())

    def abort(self, messages: list[Written | None]) -> None:
        system, path = _opened(self.path)
        for name in (f for m in messages if m for f in m.files):
            for full in (f"{path}/{name}", f"{path}/{name}{INDEX}"):
                if system.get_file_info(full).is_file:
                    system.delete_file(full)


class _Stream:
    """Bytes of a file, inflated if gzipped, with skipping. buffer[at:] is not consumed yet."""

    def __init__(self, file, gzipped: bool, size: int = 1 << 18):
        self.file, self.size, self.buffer, self.at, self.over = file, size, b"", 0, False
        #: Bytes (inflated ones of a gzipped file) that are consumed.
        self.passed = 0
        self.inflate = zlib.decompressobj(31) if gzipped else None

    def _more(self) -> bool:
        raw = b"" if self.over else self.file.read(self.size)
        if not raw:
            self.over = True
            return False
        parts = [self.buffer[self.at :]]
        self.at = 0
        while raw and self.inflate:
            parts.append(self.inflate.decompress(raw))
            raw = self.inflate.unused_data if self.inflate.eof else b""
            if self.inflate.eof:
                self.inflate = zlib.decompressobj(31)
        self.buffer = b"".join(parts if self.inflate else [*parts, raw])
        return True

    def until(self, mark: bytes) -> bytes | None:
        """The bytes before mark, which is passed too; None at the end."""
        seen = 0
        while (to := self.buffer.find(mark, self.at + max(0, seen - len(mark)))) < 0:
            seen = len(self.buffer) - self.at
            if not self._more():
                return None
        found = self.buffer[self.at : to]
        self.at = to + len(mark)
        self.passed += len(found) + len(mark)
        return found

    def take(self, n: int) -> bytes:
        self.passed += n
        parts, have = [self.buffer[self.at : self.at + n]], min(n, len(self.buffer) - self.at)
        self.at += have
        while have < n:
            if not self._more():
                raise EOFError("a WARC record ends early")
            parts.append(self.buffer[: n - have])
            self.at = len(parts[-1])
            have += self.at
        return b"".join(parts)

    def skip(self, n: int) -> None:
        self.passed += n
        left = len(self.buffer) - self.at
        if n > left and self.inflate is None and self.file.seekable():
            self.file.seek(n - left, 1)
            self.buffer, self.at = b"", 0
            return
        while n > left:
            n -= left
            self.at = len(self.buffer)
            if not self._more():
                raise EOFError("a WARC record ends early")
            left = len(self.buffer)
        self.at += n


def _headers(head: bytes) -> dict[str, str]:
    """Header fields by lower-case name."""
    lines = head.decode("utf-8", "replace").lstrip("\r\n").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:80]!r}")
    return {name.strip().lower(): value.strip() for name, _, value in (line.partition(":") for line in lines[1:])}


def records(stream: _Stream, wanted, payloads: bool = True, most: int | None = None) -> Iterator[tuple[dict[str, str], bytes | None]]:
    """(headers by lower-case name, payload or None) of the records that wanted(headers) holds for and that start before byte `most`."""
    while (most is None or stream.passed < most) and (head := stream.until(b"\r\n\r\n")) is not None:
        headers = _headers(head)
        n = int(headers.get("content-length", 0))
        if not wanted(headers):
            stream.skip(n)
        elif payloads:
            yield headers, stream.take(n)
        else:
            stream.skip(n)
            yield headers, None
        stream.skip(4)


def _read_exactly(file, n: int) -> bytes:
    data = file.read(n)
    if len(data) < n:
        raise EOFError("a WARC record ends early")
    return data


def members(file, low: int, high: int, wanted, payloads: bool = True) -> Iterator[tuple[dict[str, str], bytes | None]]:
    """What `records` gives, of gzip members that know their length and start in [low, high): of unwanted ones only the header is inflated."""
    at = low
    while at < high:
        file.seek(at)
        start = _read_exactly(file, len(GZIP) + EXTRA.size)
        _, name, _, size, _ = EXTRA.unpack_from(start, len(GZIP))
        if start[:4] != GZIP[:4] or name != b"sl":
            raise ValueError(f"no member with a length at byte {at}")
        rest, inflate, head = size - len(start), zlib.decompressobj(-15), b""
        raw = _read_exactly(file, min(rest, 1024))
        rest -= len(raw)
        while (to := head.find(b"\r\n\r\n")) < 0:
            if not raw:
                raw = _read_exactly(file, min(rest, 1024))
                rest -= len(raw)
            if not raw or inflate.eof:
                raise EOFError("a WARC record ends early")
            head += inflate.decompress(raw, 2048)
            raw = inflate.unconsumed_tail
        headers = _headers(head[:to])
        if wanted(headers):
            payload = None
            if payloads:
                n = int(headers.get("content-length", 0))
                block = head[to + 4 :] + inflate.decompress(raw) + inflate.decompress(_read_exactly(file, rest)) + inflate.flush()
                if len(block) < n:
                    raise EOFError("a WARC record ends early")
                payload = block[:n]
            yield headers, payload
        at += size


class WarcRange(InputPartition):
    """Records of a file that start in [low, high); indexed: whether its index tells where records start."""

    def __init__(self, path: str, low: int, high: int, indexed: bool):
        self.path, self.low, self.high, self.indexed = path, low, high, indexed


def _opened(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.payloads = options["path"], str(options.get("payload", "true")).lower() != "false"
        self.tests: list[tuple[str, tuple]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            name = f.attribute[0] if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 else None
            if name in HEADERS:
                self.tests.append((HEADERS[name], (f.value,) if isinstance(f, EqualTo) else tuple(f.value)))
            else:
                yield f

    def partitions(self) -> Sequence[InputPartition]:
        from pyarrow import fs

        system, path = _opened(self.path)
        info = system.get_file_info(path)
        found = [info] if info.is_file else system.get_file_info(fs.FileSelector(path, recursive=True))
        sizes = {f.path: f.size for f in found if f.is_file}
        names = sorted(f for f in sizes if not f.rsplit("/", 1)[-1].startswith(("_", ".")) and not f.endswith(INDEX))
        if f"{path}/{MANIFEST}" in sizes:
            with system.open_input_file(f"{path}/{MANIFEST}") as file:
                names = [f"{path}/{name}" for name in json.loads(file.read())]
        scheme, out = self.path.split("://")[0] + "://" if "://" in self.path else "", []
        for name in names:
            indexed = name + INDEX in sizes
            step = RANGE_BYTES if indexed else max(1, sizes[name])
            out += [WarcRange(scheme + name, low, min(low + step, sizes[name]), indexed) for low in range(0, sizes[name], step)]
        return out

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if partition is None:
            return
        system, path = _opened(partition.path)
        wanted = lambda h: all(h.get(name) in values for name, values in self.tests)
        with system.open_input_file(path) as file:
            gzipped = file.read(2) == b"\x1f\x8b"
            low, high = 0, None
            if partition.indexed:
                with system.open_input_file(path + INDEX) as index:
                    starts = json.loads(index.read())
                size = file.size()
                low, high = ([*starts, size][bisect_left(starts, at)] if at < size else size for at in (partition.low, partition.high))
            file.seek(low)
            found = members(file, low, high, wanted, self.payloads) if gzipped and partition.indexed else records(_Stream(file, gzipped), wanted, self.payloads, None if high is None else high - low)
            rows, size = [], 0
            for h, payload in found:
                length = h.get("warc-payload-length")
                rows.append((*[h.get(n) for n in HEADERS.values()], int(length) if length else None, int(h.get("content-length", 0)), partition.path, payload))
                size += len(payload or b"") + 500
                if size > BATCH_BYTES:
                    yield _rows(rows)
                    rows, size = [], 0
            if rows:
                yield _rows(rows)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [*[pa.string()] * 5, pa.int64(), pa.int64(), pa.string(), pa.binary()]
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


class WarcSource(DataSource):
    """`spark.read.format("warc")`; options: path (a file or folder), payload (false: headers only)."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return WarcReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(dict(self.options))


def read_warc(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)
