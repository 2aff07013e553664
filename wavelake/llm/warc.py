"""WARC archives as a Spark data source `warc`: partitions of whole files, predicates on headers, payloads only where asked.

Reading: the driver lists files and packs them into partitions of about `partition_bytes`. A task inflates or reads a
record up to the end of its headers, parses those, and tests the pushed predicates (equality, membership and prefixes
on record_type, record_id, target_uri, refers_to and payload_digest; others are left to Spark); a record that fails is
skipped by a seek, without decoding its block: in plain files by its length, in gzip members that tell their length in
the header's `sl` (skip lengths) field by that, as those written here do, and only in other members by inflating. Option
`payload` is `all` (default), `verify` (digests are checked, payloads not returned) or `none` (payloads are skipped, but
for the HTTP head).

Writing: each task writes one archive (a gzip member for each record) under a name with its job and attempt; commit
removes files of this job's attempts that did not win, so a lost executor leaves no second copy. Mode append adds
archives, overwrite removes those that were there.

Defined results: null payloads are empty; records of a null id have the id `<urn:page:>`, come back null and, if others
share their payload, revisit them; rows that repeat an id and its payload are all written; a null url has no header; an
empty table writes no file and reads as no record. payload_bytes is the length of what follows a response's HTTP head,
and what a revisit's HTTP head tells, if it does (null if not).
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, IsNotNull, StringStartsWith, WriterCommitMessage

SCHEMA = "record_id string, record_type string, target_uri string, refers_to string, payload_digest string, payload_bytes bigint, payload binary"
TYPES = pa.schema([(n, pa.binary() if n == "payload" else pa.int64() if n == "payload_bytes" else pa.string()) for n in ("record_id", "record_type", "target_uri", "refers_to", "payload_digest", "payload_bytes", "payload")])
HEADERS = {"record_id": "warc-record-id", "record_type": "warc-type", "target_uri": "warc-target-uri", "refers_to": "warc-refers-to", "payload_digest": "warc-payload-digest"}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
URN = "<urn:page:{}>"


def filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: str, record_id: str, uri: str | None, refers_to: str | None, payload: bytes, date: str) -> bytes:
    """One record's bytes. A revisit keeps the HTTP header, with the full payload's length, and drops the payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if kind == "revisit" else http + payload
    lines = [f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id}", f"WARC-Date: {date}", f"WARC-Payload-Digest: sha1:{digest(payload)}"]
    if uri is not None:
        lines.append("WARC-Target-URI: " + uri.replace("\r", "%0D").replace("\n", "%0A"))
    if refers_to is not None:
        lines += [f"WARC-Refers-To: {refers_to}", f"WARC-Profile: {PROFILE}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return ("WARC/1.1\r\n" + "\r\n".join(lines) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def planned(pages: DataFrame, page_id: str = "page_id", url: str = "url", payload: str = "html", least: int = 0) -> DataFrame:
    """Rows to write: of equal payloads of at least `least` bytes that with the largest id is a response, the others revisit it.

    Digests meet in a partial aggregate; only payloads that occur again take part in the join's other side, whose
    hot keys AQE splits.
    """
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("target_uri"), F.coalesce(F.col(payload), F.lit("")).alias("payload"))
    rows = rows.withColumn("sha", F.unhex(F.sha1(F.col("payload"))))
    again = rows.where(F.octet_length("payload") >= least).groupBy("sha").agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    later = F.col("first").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") < F.col("first")))
    urn = lambda c: F.format_string("<urn:page:%s>", F.coalesce(c.cast("string"), F.lit("")))
    return rows.join(again, "sha", "left").select(
        urn(F.col("page_id")).alias("record_id"),
        F.when(later, "revisit").otherwise("response").alias("record_type"),
        "target_uri",
        F.when(later, urn(F.col("first"))).alias("refers_to"),
        F.col("payload").cast("binary").alias("payload"),
    )


def page_of(urn):
    """The id in a record's name."""
    return F.regexp_extract(urn, "^<urn:page:(-?[0-9]*)>$", 1).try_cast("long")


def member(raw: bytes, level: int) -> bytes:
    """A gzip member whose header tells its own length and the data's (extra field `sl`)."""
    squeeze = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = squeeze.compress(raw) + squeeze.flush()
    size = 24 + len(body) + 8
    if max(size, len(raw)) >= 1 << 32:  # too long for the field
        squeeze = zlib.compressobj(level, zlib.DEFLATED, 31)
        return squeeze.compress(raw) + squeeze.flush()
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H2sHII", 12, b"sl", 8, size, len(raw)) + body + struct.pack("<II", zlib.crc32(raw), len(raw))


@dataclass
class Archive(WriterCommitMessage):
    name: str
    records: int


class Writer(DataSourceArrowWriter):
    def __init__(self, path: str, date: str, level: int, overwrite: bool):
        self.path, self.date, self.level, self.overwrite, self.job = path.rstrip("/"), date, level, overwrite, uuid.uuid4().hex[:12]

    def write(self, batches: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        from pyspark import TaskContext

        ctx = TaskContext.get()
        name = f"part-{self.job}-{ctx.partitionId():06d}-{ctx.taskAttemptId()}.warc.gz"
        fs, at = filesystem(self.path)
        fs.create_dir(at, recursive=True)
        n, out = 0, None
        try:
            for batch in batches:
                for row in batch.to_pylist():
                    out = out or fs.open_output_stream(f"{at}/{name}", compression=None)
                    out.write(member(record(row["record_type"], row["record_id"], row["target_uri"], row["refers_to"], row["payload"] or b"", self.date), self.level))
                    n += 1
        finally:
            if out:
                out.close()
        return Archive(name, n)

    def remove(self, unwanted) -> None:
        from pyarrow import fs as pfs

        fs, at = filesystem(self.path)
        fs.create_dir(at, recursive=True)
        for f in fs.get_file_info(pfs.FileSelector(at)):
            if f.base_name.endswith((".warc", ".warc.gz")) and unwanted(f.base_name):
                fs.delete_file(f.path)

    def commit(self, messages: list) -> None:
        won = {m.name for m in messages if m}
        self.remove(lambda name: name not in won and (self.overwrite or name.startswith(f"part-{self.job}-")))

    def abort(self, messages: list) -> None:
        self.remove(lambda name: name.startswith(f"part-{self.job}-"))


@dataclass
class Files(InputPartition):
    paths: list[str] = field(default_factory=list)


class Source:
    """Bytes of an archive in order, plain or in gzip members."""

    def __init__(self, file, gz: bool):
        self.file, self.gz, self.held, self.inflate = file, gz, b"", None
        self.raw, self.at = b"", 0  # bytes read from the file and not yet used, and their place in it
        self.size = self.length = None  # what the member tells of itself: its length, and that of its data
        self.begin = self.produced = 0

    def fill(self, n: int) -> bool:
        while len(self.raw) < n:
            got = self.file.read(1 << 16)
            if not got:
                return False
            self.raw += got
        return True

    def used(self, n: int) -> None:
        self.raw, self.at = self.raw[n:], self.at + n

    def seek(self, to: int) -> None:
        if to <= self.at + len(self.raw):
            self.used(to - self.at)
        else:
            self.file.seek(to)
            self.raw, self.at = b"", to

    def open_member(self) -> None:
        self.inflate, self.begin, self.produced, self.size, self.length = zlib.decompressobj(31), self.at, 0, None, None
        if self.fill(24) and self.raw[:4] == b"\x1f\x8b\x08\x04" and self.raw[10:16] == struct.pack("<H2sH", 12, b"sl", 8):
            self.size, self.length = struct.unpack("<II", self.raw[16:24])

    def more(self, most: int = 1 << 16) -> bool:
        if not self.gz:
            if not self.fill(1):
                return False
            self.held += self.raw
            self.used(len(self.raw))
            return True
        while True:
            if not self.fill(1):
                return False
            if self.inflate is None or self.inflate.eof:
                self.open_member()
            got = self.inflate.decompress(self.raw, most)
            self.used(len(self.raw) - len(self.inflate.unused_data if self.inflate.eof else self.inflate.unconsumed_tail))
            if got:
                self.held += got
                self.produced += len(got)
                return True

    def headers(self) -> dict[str, str] | None:
        """The next record's headers, names in lower case; None at the end."""
        while True:
            self.held = self.held.lstrip(b"\r\n") if self.held[:1] in (b"\r", b"\n") else self.held
            end = self.held.find(b"\r\n\r\n")
            if end >= 0:
                break
            if not self.more(1 << 11):  # little of a record that may be skipped
                if self.held.strip():
                    raise ValueError("an archive ends inside a record's headers")
                return None
        head, self.held = self.held[:end].decode("utf-8", "replace"), self.held[end + 4 :]
        version, *lines = head.split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError(f"no WARC record: {version[:40]!r}")
        return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}

    def take(self, n: int) -> bytes:
        pieces, got = [self.held[:n]], min(n, len(self.held))
        self.held = self.held[n:]
        while got < n:
            if not self.more():
                raise ValueError("an archive ends inside a record")
            pieces.append(self.held[: n - got])
            self.held, got = self.held[n - got :], got + len(pieces[-1])
        return b"".join(pieces)

    def skip(self, n: int) -> None:
        """Past n bytes: by a seek in plain files, and in gzip members that tell their length if nothing but line ends follow; else inflated and let go."""
        if not self.gz and n > len(self.held):
            self.seek(self.at + n - len(self.held))
            self.held = b""
            return
        if self.gz and self.size and n > len(self.held) and 0 <= self.length - (self.produced - len(self.held) + n) <= 4:
            self.seek(self.begin + self.size)
            self.held, self.inflate = b"", None
            return
        while n > len(self.held):
            n -= len(self.held)
            self.held = b""
            if not self.more():
                raise ValueError("an archive ends inside a record")
        self.held = self.held[n:]

    def upto(self, mark: bytes, n: int) -> bytes:
        """At most n bytes, up to and with the first mark."""
        got = b""
        while len(got) < n:
            if not self.held and not self.more(1 << 11):
                raise ValueError("an archive ends inside a record")
            take = self.held[: n - len(got)]
            at = (got + take).find(mark)
            take = take if at < 0 else take[: at + len(mark) - len(got)]
            got, self.held = got + take, self.held[len(take) :]
            if at >= 0:
                break
        return got


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"].rstrip("/")
        self.payload = options.get("payload", "all")
        self.partition_bytes = int(options.get("partition_bytes", 128 << 20))
        self.tests: list[tuple[str, str, tuple]] = []

    def pushFilters(self, filters: list) -> Iterator:
        for f in filters:
            at = getattr(f, "attribute", ())  # a negation has a child instead
            name = at[0] if len(at) == 1 else None
            if name in HEADERS and isinstance(f, EqualTo):
                self.tests.append((name, "in", (f.value,)))
            elif name in HEADERS and isinstance(f, In):
                self.tests.append((name, "in", tuple(f.value)))
            elif name in HEADERS and isinstance(f, StringStartsWith):
                self.tests.append((name, "prefix", (f.value,)))
            elif name in HEADERS and isinstance(f, IsNotNull):
                self.tests.append((name, "there", ()))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs as pfs

        fs, at = filesystem(self.path)
        info = fs.get_file_info(at)
        found = [info] if info.is_file else sorted(fs.get_file_info(pfs.FileSelector(at, recursive=True)), key=lambda f: f.path)
        out, held = [Files()], 0
        for f in found:
            if f.is_file and f.path.endswith((".warc", ".warc.gz")):
                if out[-1].paths and held + f.size > self.partition_bytes:
                    out.append(Files())
                    held = 0
                out[-1].paths.append(f.path)
                held += f.size
        return out

    def wanted(self, row: dict) -> bool:
        for name, kind, values in self.tests:
            got = row[name]
            if got is None or kind == "in" and got not in values or kind == "prefix" and not got.startswith(values[0]):
                return False
        return True

    def read(self, part: Files) -> Iterator[pa.RecordBatch]:
        fs, _ = filesystem(self.path)
        rows, held = [], 0
        for path in part.paths:
            with fs.open_input_file(path) as file:
                source = Source(file, path.endswith(".gz"))
                while (head := source.headers()) is not None:
                    row = {name: head.get(h) for name, h in HEADERS.items()}
                    if row["payload_digest"]:
                        row["payload_digest"] = row["payload_digest"].removeprefix("sha1:")
                    size = int(head.get("content-length", 0))
                    if not self.wanted(row):
                        source.skip(size)
                        continue
                    row |= self.block(source, head, size, row)
                    rows.append(row)
                    held += len(row["payload"] or b"") + 400
                    if held > 8 << 20:
                        yield pa.RecordBatch.from_pylist(rows, TYPES)
                        rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, TYPES)

    def block(self, source: Source, head: dict, size: int, row: dict) -> dict:
        """The payload and its full length (a revisit's is in the HTTP header that it keeps)."""
        if not head.get("content-type", "").startswith("application/http"):
            body = source.take(size) if self.payload != "none" else source.skip(size)
            return {"payload": body if self.payload == "all" else None, "payload_bytes": size}
        http = source.upto(b"\r\n\r\n", size)
        rest = size - len(http)
        if row["record_type"] == "revisit":
            source.skip(rest)
            said = next((int(x.partition(b":")[2]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")), None)
            return {"payload": None, "payload_bytes": said}
        if self.payload == "none":
            source.skip(rest)
            return {"payload": None, "payload_bytes": rest}
        body = source.take(rest)
        if self.payload == "verify" and row["payload_digest"] and digest(body) != row["payload_digest"]:
            raise ValueError(f"the payload of {row['record_id']} doesn't match its digest")
        return {"payload": body if self.payload == "all" else None, "payload_bytes": rest}


class Warc(DataSource):
    """spark.read.format("warc").load(path); df.write.format("warc").option("path", path)."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return Reader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return Writer(self.options["path"], self.options.get("date", "2024-01-01T00:00:00Z"), int(self.options.get("level", 1)), overwrite)


def register(spark) -> None:
    """Makes the format known and lets Spark push predicates into Python data sources."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Warc)
