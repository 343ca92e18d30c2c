"""Operator 12: WARC archives as a Spark data source with a splittable reader.

An archive file is a row of gzip members, one a record. A task of the reader has a range of bytes: it scans for the magic of
gzip, takes a candidate where the member decodes to a WARC header, and owns the records that start inside its range.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.window import Window

from .common import bounded_broadcast, materialize, own_names, shared_dir

MAGIC = b"\x1f\x8b\x08"
#: Payloads of fewer bytes are stored each time.
REVISIT_BYTES = 100
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RANGE_BYTES, FILE_BYTES = 128 << 20, 1 << 30
_CHUNK, _HEAD_BYTES, _BATCH_ROWS, _BATCH_BYTES = 1 << 18, 1 << 16, 2_000, 32 << 20

_RECORD = "file string, range_no long, offset long, next_offset long, whole boolean, record_type string, record_id string, target_uri string, date string, refers_to string, payload_digest string, declared_bytes long, read_bytes long, read_sha256 string, payload binary"
_ARROW = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}
_FIELDS = [(c.split()[0], _ARROW[c.split()[1]]) for c in _RECORD.split(", ")]


def record_bytes(record_id: str, record_type: str, target_uri: str, date: str, digest: str, refers_to: str | None, payload: bytes | None, payload_bytes: int) -> bytes:
    """One record before compression. A revisit has the HTTP head of its payload, length included, and no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {payload_bytes}\r\n\r\n".encode()
    block = http if record_type == "revisit" else http + (payload or b"")
    head = {"WARC-Type": record_type, "WARC-Record-ID": f"<{record_id}>", "WARC-Date": date, "WARC-Target-URI": quote(target_uri, safe="%!#$&'()*+,/:;=?@[]~\"<>\\^`{|}"), "WARC-Payload-Digest": f"sha256:{digest}"}
    if record_type == "revisit":
        head |= {"WARC-Profile": REVISIT_PROFILE, "WARC-Refers-To": f"<{refers_to}>"}
    head |= {"Content-Type": "application/http; msgtype=response", "Content-Length": str(len(block))}
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()) + "\r\n").encode() + block + b"\r\n\r\n"


class _Bytes:
    """Reads at offsets of a file through a small buffer."""

    def __init__(self, file, size: int):
        self.file, self.size, self.start, self.buffer = file, size, 0, b""

    def at(self, offset: int) -> bytes:
        """Some bytes from `offset` on, three at least; none at the end."""
        if not self.start <= offset < self.start + len(self.buffer) - 2:
            self.file.seek(offset)
            self.start, self.buffer = offset, self.file.read(min(_CHUNK, self.size - offset))
        return self.buffer[offset - self.start :]


def next_magic(source: _Bytes, offset: int, stop: int) -> int | None:
    """The first place from `offset` on and before `stop` where the magic stands."""
    while offset < min(stop, source.size - 2):
        found = (chunk := source.at(offset)).find(MAGIC)
        if found >= 0:
            return offset + found if offset + found < stop else None
        offset += max(1, len(chunk) - 2)
    return None


class _Member:
    """What one gzip member decodes to, in pieces; `end` is the offset after it once it is read whole."""

    def __init__(self, source: _Bytes, offset: int):
        self.source, self.next, self.stream, self.end = source, offset, zlib.decompressobj(31), None

    def pieces(self) -> Iterator[bytes]:
        """Pieces of at most _CHUNK bytes; raises zlib.error where the bytes are no member or the file ends inside it."""
        raw = b""
        while not self.stream.eof:
            if not raw:
                raw = self.source.at(self.next) if self.next < self.source.size else b""
                if not raw:
                    raise zlib.error("cut off")
                self.next += len(raw)
            piece = self.stream.decompress(raw, _CHUNK)
            raw = self.stream.unconsumed_tail
            if piece:
                yield piece
        self.end = self.next - len(self.stream.unused_data)


def _fields(head: bytes) -> dict[str, str]:
    """Named fields by their lower-cased names; lines that begin with white space go on with the one before."""
    out, last = {}, None
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and last:
            out[last] += " " + line.strip()
        elif ":" in line:
            name, value = line.split(":", 1)
            out[last := name.strip().lower()] = value.strip()
    return out


def read_record(source: _Bytes, offset: int, payload: bool) -> dict | None:
    """The record whose member begins at `offset`; None where what stands there is no member or has no WARC header.

    `whole` is false where the header is good and the rest is not. Payloads are hashed piece by piece, and kept on demand only.
    """
    member, buffer = _Member(source, offset), b""
    pieces = member.pieces()
    try:
        while (cut := buffer.find(b"\r\n\r\n")) < 0:
            if len(buffer) > _HEAD_BYTES or not b"WARC/".startswith(buffer[:5]):
                return None
            buffer += next(pieces)
    except (zlib.error, StopIteration):
        return None
    head = _fields(buffer[:cut])
    length = head.get("content-length", "")
    if not buffer.startswith(b"WARC/1.") or not head.get("warc-type") or not length.isdecimal():
        return None
    plain = lambda name: head.get(name, "").strip("<>") or None
    found = {"record_type": head["warc-type"], "record_id": plain("warc-record-id"), "target_uri": head.get("warc-target-uri"), "date": head.get("warc-date"), "refers_to": plain("warc-refers-to"), "payload_digest": head.get("warc-payload-digest"), "declared_bytes": None, "payload": None}
    # The block of a response begins with an HTTP head, whose length stands for that of the payload.
    is_http, left, buffer = head.get("content-type", "").startswith("application/http"), int(length), buffer[cut + 4 :]
    digest, read, kept, http = hashlib.sha256(), 0, [], b""
    try:
        while True:
            part, buffer = buffer[:left], buffer[left:]
            left -= len(part)
            if is_http:
                http += part
                at, part = http.find(b"\r\n\r\n"), b""
                if at >= 0 or left == 0 or len(http) > _HEAD_BYTES:
                    declared = _fields(http[:at]).get("content-length", "") if at >= 0 else ""
                    found["declared_bytes"] = int(declared) if declared.isdecimal() else None
                    is_http, part = False, http[at + 4 :] if at >= 0 else http
            if part:
                digest.update(part)
                read += len(part)
                if payload:
                    kept.append(part)
            if left == 0:
                break
            buffer = next(pieces)
        rest = buffer + b"".join(pieces)
        whole = rest == b"\r\n\r\n"
    except (zlib.error, StopIteration):
        whole = False
    return found | {"offset": offset, "next_offset": member.end if member.end is not None else offset + 1, "whole": whole, "read_bytes": read, "read_sha256": digest.hexdigest(), "payload": b"".join(kept) if payload else None}


def records_in(file, size: int, start: int, stop: int, payload: bool) -> Iterator[dict]:
    """The records that start in [start, stop). The last may end beyond."""
    source, at = _Bytes(file, size), start
    while (found := next_magic(source, at, stop)) is not None:
        record = read_record(source, found, payload)
        at = found + 1 if record is None else record["next_offset"]
        if record is not None:
            yield record


@dataclass
class Range(InputPartition):
    file: str
    number: int
    start: int
    stop: int
    size: int


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.step, self.payload = options["path"], int(options.get("rangeBytes", RANGE_BYTES)), options.get("payload", "true") == "true"

    def partitions(self) -> list[Range]:
        """Ranges of the files at the path. Names that begin with a dot or an underscore are not read."""
        files, root = pafs.FileSystem.from_uri(self.path)
        at = files.get_file_info(root)
        listed = [at] if at.is_file else files.get_file_info(pafs.FileSelector(root, recursive=True))
        kept = sorted((f.path, f.size) for f in listed if f.is_file and f.size and not f.base_name.startswith((".", "_")))
        return [Range(p, k, k * self.step, min(size, (k + 1) * self.step), size) for p, size in kept for k in range(-(-size // self.step))] or [Range("", 0, 0, 0, 0)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        files, _ = pafs.FileSystem.from_uri(self.path)
        rows, held = [], 0
        if part.size:
            with files.open_input_file(part.file) as file:
                for record in records_in(file, part.size, part.start, part.stop, self.payload):
                    rows.append(record | {"file": part.file, "range_no": part.number})
                    held += len(record["payload"] or b"")
                    if len(rows) == _BATCH_ROWS or held >= _BATCH_BYTES:
                        yield self._batch(rows)
                        rows, held = [], 0
        yield self._batch(rows)

    @staticmethod
    def _batch(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in _FIELDS], names=[n for n, _ in _FIELDS])


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class WarcWriter(DataSourceArrowWriter):
    """Each attempt of a task writes hidden files of its own; those of the attempts that count get their names on commit."""

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.most, self.overwrite = options["path"], int(options.get("fileBytes", FILE_BYTES)), overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files, root = pafs.FileSystem.from_uri(self.path)
        files.create_dir(root, recursive=True)
        out, names, size = None, [], 0
        columns = ("record_id", "record_type", "target_uri", "date", "payload_digest", "refers_to", "payload", "payload_bytes")
        try:
            for batch in iterator:
                for row in zip(*[batch.column(c) for c in columns], strict=True):
                    if out is None or size >= self.most:
                        if out is not None:
                            out.close()
                        names.append(f"{uuid.uuid4().hex}.warc.gz")
                        out, size = files.open_output_stream(f"{root}/.{names[-1]}", compression=None), 0
                    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
                    member = packer.compress(record_bytes(*[v.as_py() for v in row])) + packer.flush()
                    out.write(member)
                    size += len(member)
        finally:
            if out is not None:
                out.close()
        return Written(names)

    def commit(self, messages: list[Written | None]) -> None:
        files, root = pafs.FileSystem.from_uri(self.path)
        files.create_dir(root, recursive=True)
        if self.overwrite:
            for old in files.get_file_info(pafs.FileSelector(root)):
                if old.is_file and not old.base_name.startswith((".", "_")):
                    files.delete_file(old.path)
        for name in (n for m in messages if m is not None for n in m.files):
            files.move(f"{root}/.{name}", f"{root}/{name}")

    def abort(self, messages: list[Written | None]) -> None:
        files, root = pafs.FileSystem.from_uri(self.path)
        for name in (n for m in messages if m is not None for n in m.files):
            files.delete_file(f"{root}/.{name}")


class WarcSource(DataSource):
    """`spark.read.format("warc")` and `df.write.format("warc")`, after `spark.dataSource.register(WarcSource)`.

    Options: path, a folder that all executors reach (a local or mounted path, or a URI that Arrow's filesystems know);
    rangeBytes and payload ("false" leaves payloads out, hashes and lengths stay) to read; fileBytes to write.
    """

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return _RECORD

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options)

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options, overwrite)


def page_records(pages: DataFrame, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Records of `pages` (page_id, url, html) for the writer.

    Of pages with equal payloads of at least REVISIT_BYTES, that with the smallest page_id is a response and the others
    revisit it; of rows that share that id too, one is. Null html is empty; a null page_id comes after all others. Rows are numbered, and
    record ids are urn:page:<page_id>:<number>, so rows that share an id stay apart. Pages are written once with
    numbers and digests; only digests that occur more than once are joined, and are broadcast when counted to be few.
    """
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    slim = own_names(pages).select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"), F.monotonically_increasing_id().alias("row"))
    slim = materialize(slim.withColumn("payload_digest", F.sha2("payload", 256)).withColumn("payload_bytes", F.octet_length("payload").cast("long")), "pages")
    order = F.struct(F.col("page_id").isNull().alias("none"), "page_id", "row")
    firsts = slim.where(F.col("payload_bytes") >= REVISIT_BYTES).groupBy("payload_digest").agg(F.min(order).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    firsts = materialize(firsts, "firsts")
    rows = slim.join(bounded_broadcast(firsts, firsts.count()), "payload_digest", "left")
    name = lambda page, row: F.concat(F.lit("urn:page:"), F.coalesce(page.cast("string"), F.lit("")), F.lit(":"), row.cast("string"))
    again = F.col("first").isNotNull() & (F.col("first.row") != F.col("row"))
    own = name(F.col("page_id"), F.col("row"))
    return rows.select(
        own.alias("record_id"),
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        F.when(F.length("url") > 0, F.col("url")).otherwise(own).alias("target_uri"),
        F.lit(date).alias("date"),
        "payload_digest",
        F.when(again, name(F.col("first.page_id"), F.col("first.row"))).alias("refers_to"),
        F.when(~again, F.col("payload")).alias("payload"),
        "payload_bytes",
    )


def write_archive(records: DataFrame, path: str, file_bytes: int = FILE_BYTES) -> None:
    """Adds `records` to the archive at `path`. A task that is lost and run again leaves no second copy."""
    records.sparkSession.dataSource.register(WarcSource)
    records.write.format("warc").mode("append").option("fileBytes", file_bytes).save(path)


def read_archive(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES, payload: bool = False) -> DataFrame:
    """The records of the archive at `path`.

    A payload may hold archives itself, whose members a range that starts inside it takes for records. They lie before the
    end of a record of an earlier range of the file, and go. A record whose header is good and whose rest is not raises.
    """
    spark.dataSource.register(WarcSource)
    source = lambda with_payload: spark.read.format("warc").option("rangeBytes", range_bytes).option("payload", str(with_payload).lower()).load(path)
    slim = materialize(source(False), "records")
    ends = slim.where("whole").groupBy("file", "range_no").agg(F.max("next_offset").alias("__end"))
    before = Window.partitionBy("file").orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)
    ranges = slim.select("file", "range_no").distinct().join(ends, ["file", "range_no"], "left")
    ranges = ranges.select(F.col("file").alias("__file"), F.col("range_no").alias("__no"), F.coalesce(F.max("__end").over(before), F.lit(0)).alias("__reach"))
    rows = (source(True) if payload else slim).join(ranges, (F.col("file") == F.col("__file")) & (F.col("range_no") == F.col("__no")))
    rows = rows.where(F.col("offset") >= F.col("__reach")).drop("__file", "__no", "__reach")
    broken = F.raise_error(F.concat(F.lit("broken record in "), F.col("file"), F.lit(" at "), F.col("offset").cast("string"))).cast("boolean")
    return rows.withColumn("whole", F.when(F.col("whole"), True).otherwise(broken))


def archived_pages(pages: DataFrame, path: str | None = None, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Writes `pages` as an archive, at `path` or in the shared folder, and gives a row a page as read back.

    page_id, payload_bytes, payload_digest, record_type, refers_to and the file, offset and length of its record. Those of a response are
    counted and hashed over what was read; a revisit names them in its heads. Empty tables give empty ones.
    """
    spark = pages.sparkSession
    if path is None:
        path = f"{shared_dir(spark)}/plumbline/warc-{uuid.uuid4().hex}"
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    write_archive(page_records(pages), path)
    again = F.col("record_type") == "revisit"
    page = lambda c: F.expr(f"try_cast(split({c}, ':')[2] as long)")
    return read_archive(spark, path, range_bytes).where("whole").select(
        page("record_id").alias("page_id"),
        F.when(again, F.col("declared_bytes")).otherwise(F.col("read_bytes")).alias("payload_bytes"),
        F.when(again, F.regexp_replace("payload_digest", "^sha256:", "")).otherwise(F.col("read_sha256")).alias("payload_digest"),
        "record_type",
        page("refers_to").alias("refers_to"),
        "file",
        "offset",
        (F.col("next_offset") - F.col("offset")).alias("record_bytes"),
    )


__all__ = ["WarcSource", "archived_pages", "page_records", "read_archive", "records_in", "write_archive"]
