"""WARC archives as a PySpark Python data source, and an archive of pages.

Reading plans partitions from whole files, packed up to a size. Predicates on
record type and other header columns can be pushed down: a task parses a record's
headers first and goes past the payload of a record that does not match. An
uncompressed payload is passed by a seek. Compressed records are gzip members
of their own whose header has the lengths of the member (the field ``sl``), so
they are passed by a seek as well and never inflated beyond their headers.
Payloads are decoded only if the ``payload`` column is asked for.
"""

from __future__ import annotations

import io
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F
from pyspark.sql import types as T

from billwright.llm import common
from billwright.session import shared_folder, staged

_TEXT = ["record_id", "record_type", "target_uri", "warc_date", "refers_to", "payload_digest", "content_type"]
SCHEMA = T.StructType(
    [T.StructField(c, T.StringType()) for c in _TEXT]
    + [T.StructField("content_length", T.LongType()), T.StructField("payload_length", T.LongType()), T.StructField("payload", T.BinaryType())]
    + [T.StructField("file", T.StringType()), T.StructField("offset", T.LongType())]
)

#: Columns that are header fields of a record as they stand (fixed names of the format).
HEADERS = {
    "record_id": "WARC-Record-ID",
    "record_type": "WARC-Type",
    "target_uri": "WARC-Target-URI",
    "warc_date": "WARC-Date",
    "refers_to": "WARC-Refers-To",
    "payload_digest": "WARC-Payload-Digest",
    "content_type": "Content-Type",
}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = "application/http; msgtype=response"

#: Bytes of files that one task reads, and after which a writer begins a new file.
PARTITION_BYTES = 64 << 20
#: Bytes of one batch of records.
BATCH_BYTES = 4 << 20
#: Longest block of header lines.
MAX_HEADER = 1 << 20
#: Groups of equal payloads that are broadcast (about 50 bytes each, 10 MB); more are joined by a shuffle.
BROADCAST_GROUPS = 200_000

_MEMBER = b"\x1f\x8b\x08\x04\x00\x00\x00\x00\x00\xff\x0c\x00sl\x08\x00"  # gzip header with room for one field of 8 bytes


def _filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


# reading


@dataclass
class WarcFiles(ds.InputPartition):
    paths: list[str]


class _Member(io.RawIOBase):
    """The content of the gzip member at the place of ``file``, inflated as far as it is read."""

    def __init__(self, file: io.BufferedReader) -> None:
        self.file, self.start, self.sizes = file, file.tell(), None
        head = file.read(10)
        if len(head) < 10 or head[:3] != b"\x1f\x8b\x08":
            raise ValueError(f"no gzip member at {self.start}")
        flags = head[3]
        if flags & 4:
            extra = file.read(int.from_bytes(file.read(2), "little"))
            while len(extra) >= 4:
                size = int.from_bytes(extra[2:4], "little")
                if extra[:2] == b"sl" and size == 8:
                    self.sizes = int.from_bytes(extra[4:8], "little"), int.from_bytes(extra[8:12], "little")
                extra = extra[4 + size :]
        for bit in (8, 16):  # name and comment, each ended by a zero
            while flags & bit and file.read(1) not in (b"\x00", b""):
                pass
        if flags & 2:
            file.read(2)
        self.inflate, self.kept, self.end, self.check = zlib.decompressobj(-15), b"", None, 0

    def readable(self) -> bool:
        return True

    def readinto(self, out) -> int:
        while not self.kept and self.end is None:
            data = self.inflate.unconsumed_tail or self.file.read1(1 << 14)
            if not data:
                raise ValueError(f"the gzip member at {self.start} has no end")
            try:
                self.kept = self.inflate.decompress(data, 1 << 16)
            except zlib.error as problem:
                raise ValueError(str(problem)) from None
            self.check = zlib.crc32(self.kept, self.check)
            if self.inflate.eof:
                self.end = self.file.tell() - len(self.inflate.unused_data) + 8
                trailer = self.inflate.unused_data[:4]
                if int.from_bytes(trailer + self.file.read(4 - len(trailer)), "little") != self.check:
                    raise ValueError("the gzip member's checksum differs")
        n = min(len(out), len(self.kept))
        out[:n], self.kept = self.kept[:n], self.kept[n:]
        return n

    def next_place(self) -> int:
        """Where the next member begins; without its length the rest has to be inflated to know."""
        if self.sizes:
            return self.start + self.sizes[0]
        while self.end is None or self.kept:
            if not self.readinto(bytearray(1 << 16)):
                break
        return self.end


def _header_lines(body: io.BufferedReader, limit: int) -> tuple[list[bytes], int]:
    """The lines before the next empty one, and the bytes read with it."""
    lines, used = [], 0
    while used < limit:
        line = body.readline(limit - used)
        used += len(line)
        if line in (b"\r\n", b"\n", b""):
            break
        lines.append(line.rstrip(b"\r\n"))
    return lines, used


def _fields(lines: list[bytes]) -> dict[str, str]:
    """Header fields by lower-cased name; the first of a name counts, folded lines are joined."""
    out: dict[str, str] = {}
    name = ""
    for line in lines:
        if line[:1] in (b" ", b"\t") and name:
            out[name] += " " + line.decode("utf-8", "replace").strip()
            continue
        key, _, value = line.decode("utf-8", "replace").partition(":")
        name = key.strip().lower()
        out.setdefault(name, value.strip())
    return out


def _whole_number(text: str | None) -> int | None:
    return int(text) if text is not None and text.isascii() and text.isdigit() else None


def _truth(condition: ds.Filter, row: dict) -> bool | None:
    """What a predicate says of a row of header columns; None if it can't be said, as in SQL."""
    if isinstance(condition, ds.Not):
        inner = _truth(condition.child, row)
        return None if inner is None else not inner
    value = row[condition.attribute[0]]
    if isinstance(condition, ds.IsNull):
        return value is None
    if isinstance(condition, ds.IsNotNull):
        return value is not None
    if isinstance(condition, ds.EqualNullSafe):
        return value == condition.value
    if value is None or (not isinstance(condition, ds.In) and condition.value is None):
        return None
    if isinstance(condition, ds.In):
        return True if value in [x for x in condition.value if x is not None] else None if None in condition.value else False
    return {
        ds.EqualTo: lambda a, b: a == b,
        ds.GreaterThan: lambda a, b: a > b,
        ds.GreaterThanOrEqual: lambda a, b: a >= b,
        ds.LessThan: lambda a, b: a < b,
        ds.LessThanOrEqual: lambda a, b: a <= b,
        ds.StringStartsWith: lambda a, b: a.startswith(b),
        ds.StringEndsWith: lambda a, b: a.endswith(b),
        ds.StringContains: lambda a, b: b in a,
    }[type(condition)](value, condition.value)


def _pushable(condition: ds.Filter) -> bool:
    if isinstance(condition, ds.Not):
        return _pushable(condition.child)
    known = (
        ds.EqualTo, ds.EqualNullSafe, ds.In, ds.IsNull, ds.IsNotNull, ds.GreaterThan, ds.GreaterThanOrEqual,
        ds.LessThan, ds.LessThanOrEqual, ds.StringStartsWith, ds.StringEndsWith, ds.StringContains,
    )
    return isinstance(condition, known) and condition.attribute in {(c,) for c in (*HEADERS, "content_length")}


class WarcReader(ds.DataSourceReader):
    def __init__(self, options: dict, schema: T.StructType) -> None:
        options = {k.lower(): v for k, v in options.items()}
        self.path = options["path"]
        self.partition_bytes = int(options.get("maxpartitionbytes", PARTITION_BYTES))
        self.schema = schema
        unknown = set(schema.names) - set(SCHEMA.names)
        if unknown:
            raise ValueError(f"no such columns of a WARC record: {sorted(unknown)}")
        self.conditions: list[ds.Filter] = []

    def partitions(self) -> list[WarcFiles]:
        """Files in order of path, small ones together; a file is never split, writers keep files small."""
        system, root = _filesystem(self.path)
        info = system.get_file_info(root)
        found = [info] if info.is_file else system.get_file_info(pafs.FileSelector(root, recursive=True, allow_not_found=True))
        hidden = lambda p: any(x.startswith(("_", ".")) for x in p[len(root) :].split("/"))
        files = sorted((f.path, f.size) for f in found if f.is_file and f.path.endswith((".warc", ".warc.gz")) and not hidden(f.path))
        out, held = [WarcFiles([])], 0
        for path, size in files:
            if out[-1].paths and held + size > self.partition_bytes:
                out.append(WarcFiles([]))
                held = 0
            out[-1].paths.append(path)
            held += size
        return out

    def read(self, partition: WarcFiles) -> Iterator[pa.RecordBatch]:
        system, _ = _filesystem(self.path)
        kinds = {"content_length": pa.int64(), "payload_length": pa.int64(), "offset": pa.int64(), "payload": pa.binary()}
        names = self.schema.names
        rows: list[tuple] = []
        held = 0
        for path in partition.paths:
            with system.open_input_file(path) as raw:
                file = io.BufferedReader(raw, 1 << 18)
                for row in self._records(file, path):
                    rows.append(tuple(row[c] for c in names))
                    held += 500 + len(row["payload"] or b"")
                    if held > BATCH_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds.get(c, pa.string())) for i, c in enumerate(names)], names=names)
                        rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds.get(c, pa.string())) for i, c in enumerate(names)], names=names)

    def _records(self, file: io.BufferedReader, path: str) -> Iterator[dict]:
        place, wanted = 0, set(self.schema.names)
        while True:
            file.seek(place)
            if not file.peek(1):
                return
            try:
                member = _Member(file) if path.endswith(".gz") else None
                row, after = self._record(io.BufferedReader(member, 1 << 14) if member else file, wanted)
                place, began = (member.next_place() if member else after), place
            except ValueError as problem:
                raise ValueError(f"{path}, record at {place}: {problem}") from None
            if row is not None:
                yield row | {"file": path, "offset": began}

    def _record(self, body: io.BufferedReader, wanted: set[str]) -> tuple[dict | None, int]:
        """The record at the place of ``body``, None if a predicate is against it, and where an uncompressed one ends."""
        plain = not isinstance(body.raw, _Member)
        lines, _ = _header_lines(body, MAX_HEADER)
        if not lines or not lines[0].startswith(b"WARC/"):
            raise ValueError("no WARC version line")
        fields = _fields(lines[1:])
        length = _whole_number(fields.get("content-length"))
        if length is None:
            raise ValueError("no Content-Length")
        row = {c: fields.get(h.lower()) for c, h in HEADERS.items()} | {"content_length": length}
        for c in ("record_id", "refers_to"):
            row[c] = row[c].removeprefix("<").removesuffix(">") if row[c] is not None else None
        after = body.tell() + length + 4 if plain else 0
        if any(_truth(c, row) is not True for c in self.conditions):
            return None, after
        row |= {"payload_length": None, "payload": None}
        if wanted & {"payload", "payload_length"}:
            rest, whole = length, None
            if (row["content_type"] or "").lower().startswith("application/http"):
                head, used = _header_lines(body, min(length, MAX_HEADER))
                rest, whole = length - used, _whole_number(_fields(head[1:]).get("content-length"))
            revisit = row["record_type"] == "revisit"
            # a revisit has no payload of its own: its length is what the message said
            row["payload_length"] = whole if revisit else rest
            if "payload" in wanted and not revisit:
                row["payload"] = body.read(rest)
                if len(row["payload"]) < rest or body.read(4) != b"\r\n\r\n":
                    raise ValueError("the record is cut short")
                if not plain:
                    body.read(1)  # to the end of the member, where its checksum is
        return row, after


class PushingReader(WarcReader):
    """A reader that takes predicates on header columns over from Spark."""

    def pushFilters(self, filters: list[ds.Filter]) -> Iterator[ds.Filter]:
        for one in filters:
            if _pushable(one):
                self.conditions.append(one)
            else:
                yield one


# writing


@dataclass
class WrittenFiles(ds.WriterCommitMessage):
    names: list[str]


def _clean(value: str) -> str:
    """A header value on one line: control characters as percent escapes."""
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in value)


def record_bytes(row: dict, date: str) -> tuple[bytes, bytes]:
    """Headers and block of a record. Responses and revisits are HTTP messages; a revisit has the message's head alone."""
    payload = row.get("payload") or b""
    kind = row["record_type"]
    http = kind in ("response", "revisit")
    block = payload
    if http:
        size = len(payload) if kind == "response" else int(row.get("payload_length") or 0)
        head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
        block = head + payload if kind == "response" else head
    values = {
        "WARC-Type": kind,
        "WARC-Record-ID": f"<{row['record_id']}>",
        "WARC-Date": row.get("warc_date") or date,
        "WARC-Target-URI": row.get("target_uri"),
        "WARC-Payload-Digest": row.get("payload_digest"),
        "WARC-Refers-To": f"<{row['refers_to']}>" if row.get("refers_to") else None,
        "WARC-Profile": PROFILE if kind == "revisit" else None,
        "Content-Type": row.get("content_type") or (HTTP if http else "application/octet-stream"),
        "Content-Length": str(len(block)),
    }
    lines = [f"{k}: {_clean(v)}" for k, v in values.items() if v is not None]
    return "\r\n".join(["WARC/1.1", *lines, "", ""]).encode(), block


def gzip_member(data: bytes, level: int) -> bytes:
    """One gzip member with its own and its content's length in its header (left out from 4 GB on)."""
    deflate = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = deflate.compress(data) + deflate.flush()
    end = zlib.crc32(data).to_bytes(4, "little") + (len(data) & 0xFFFFFFFF).to_bytes(4, "little")
    size = len(_MEMBER) + 8 + len(body) + 8
    if max(size, len(data)) >= 1 << 32:
        return _MEMBER[:3] + b"\x00" + _MEMBER[4:10] + body + end
    return _MEMBER + size.to_bytes(4, "little") + len(data).to_bytes(4, "little") + body + end


class WarcWriter(ds.DataSourceArrowWriter):
    """Tasks write below a folder of the job; what the job commits is then moved into place.

    Files of attempts that were lost or ran twice are in no commit message and
    go with that folder.
    """

    def __init__(self, options: dict, schema: T.StructType, overwrite: bool) -> None:
        options = {k.lower(): v for k, v in options.items()}
        self.path, self.overwrite = options["path"].rstrip("/"), overwrite
        self.packed = options.get("compression", "gzip").lower() == "gzip"
        self.level = int(options.get("level", "1"))
        self.file_bytes = int(options.get("maxfilebytes", PARTITION_BYTES))
        self.date = options.get("date", "1970-01-01T00:00:00Z")
        self.job = f"_job-{uuid.uuid4().hex}"
        unknown = set(schema.names) - {*HEADERS, "payload", "payload_length"}
        missing = {"record_id", "record_type"} - set(schema.names)
        if unknown or missing:
            raise ValueError(f"a WARC record can't be written: columns unknown {sorted(unknown)}, missing {sorted(missing)}")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WrittenFiles:
        system, root = _filesystem(self.path)
        system.create_dir(f"{root}/{self.job}", recursive=True)
        names, out, size = [], None, 0
        try:
            for batch in iterator:
                for row in batch.to_pylist():
                    if out is None:
                        names.append(f"part-{uuid.uuid4().hex}.warc{'.gz' if self.packed else ''}")
                        out, size = system.open_output_stream(f"{root}/{self.job}/{names[-1]}", compression=None), 0
                    for c in ("payload",):
                        if isinstance(row.get(c), str):
                            row[c] = row[c].encode()
                    head, block = record_bytes(row, self.date)
                    data = head + block + b"\r\n\r\n"
                    data = gzip_member(data, self.level) if self.packed else data
                    out.write(data)
                    size += len(data)
                    if size >= self.file_bytes:
                        out.close()
                        out = None
        finally:
            if out is not None:
                out.close()
        return WrittenFiles(names)

    def commit(self, messages: list[WrittenFiles | None]) -> None:
        system, root = _filesystem(self.path)
        system.create_dir(root, recursive=True)
        if self.overwrite:
            for info in system.get_file_info(pafs.FileSelector(root)):
                if info.is_file:
                    system.delete_file(info.path)
        for message in messages:
            for name in message.names if message else []:
                system.move(f"{root}/{self.job}/{name}", f"{root}/{name}")
        self.abort(messages)

    def abort(self, messages: list[WrittenFiles | None]) -> None:
        system, root = _filesystem(self.path)
        if system.get_file_info(f"{root}/{self.job}").type != pafs.FileType.NotFound:
            system.delete_dir(f"{root}/{self.job}")


class WarcDataSource(ds.DataSource):
    """``spark.read.format("warc")``; a schema of fewer columns reads only those, payloads among them.

    Options: ``maxPartitionBytes`` of files for a task to read; ``pushdown``,
    off unless it is true, for predicates of the plan; to write ``compression``
    (gzip or none), ``level``, ``maxFileBytes`` and ``date``.

    Spark keeps what a plan pushed into a loaded frame and applies it to every
    other use of that frame, so a frame with pushdown is for one use: load
    again for another. ``read_warc`` does so for its predicate.
    """

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> T.StructType:
        return SCHEMA

    def reader(self, schema: T.StructType) -> WarcReader:
        pushes = str(self.options.get("pushdown", "false")).lower() == "true"
        return (PushingReader if pushes else WarcReader)(dict(self.options), schema)

    def writer(self, schema: T.StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(dict(self.options), schema, overwrite)


def register(spark: SparkSession) -> None:
    """Make the format ``warc`` known to the session and let predicates reach Python sources."""
    common.ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


def read_warc(spark: SparkSession, path: str, columns: list[str] | None = None, where: str | None = None) -> DataFrame:
    """The records of the archives below ``path``, of ``columns`` alone if they are given.

    ``where`` is a predicate on header columns that tasks decide by a record's
    headers. A frame with one is for one use in one plan; without one it may be
    used at will.
    """
    register(spark)
    wanted = columns or SCHEMA.names
    if where is None:
        return spark.read.format("warc").schema(T.StructType([SCHEMA[c] for c in wanted])).load(path)
    read = T.StructType([f for f in SCHEMA if f.name in wanted or f.name in (*HEADERS, "content_length")])
    return spark.read.format("warc").schema(read).option("pushdown", "true").load(path).where(where).select(*wanted)


# an archive of pages


def page_records(pages: DataFrame, least: int = 100, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """A WARC record for every page: a response, or a revisit of the response with the same payload.

    Of pages with equal payloads of at least ``least`` bytes that with the
    smallest id is the response; rows that share it all are. A null page has
    an empty payload. A null id is larger than any other; pages of one payload
    that have no other id are all responses. Other columns are not read.
    """
    payload = F.encode(F.coalesce(F.col(html_col).cast("string"), F.lit("")), "UTF-8")
    rows = pages.select(F.col(id_col).cast("long").alias("_id"), F.col(url_col).alias("target_uri"), payload.alias("payload"))
    rows = rows.withColumns({"digest": F.unhex(F.sha2("payload", 256)), "size": F.octet_length("payload").cast("long")})
    firsts = staged(
        rows.where(F.col("size") >= least)
        .groupBy("digest")
        .agg(F.min("_id").alias("first"), F.count(F.lit(1)).alias("n"))
        .where("n > 1 AND first IS NOT NULL")
        .select("digest", "first"),
        "payload-groups",
    )
    few = firsts.count() <= BROADCAST_GROUPS
    again = F.col("first").isNotNull() & (F.col("size") >= least) & (F.col("_id").isNull() | (F.col("_id") > F.col("first")))
    urn = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(c.cast("string"), F.lit("")))
    return rows.join(F.broadcast(firsts) if few else firsts, "digest", "left").select(
        urn(F.col("_id")).alias("record_id"),
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        "target_uri",
        F.when(again, urn(F.col("first"))).alias("refers_to"),
        F.concat(F.lit("sha256:"), F.lower(F.hex("digest"))).alias("payload_digest"),
        F.when(~again, F.col("payload")).alias("payload"),
        F.col("size").alias("payload_length"),
    )


def archive_pages(pages: DataFrame, path: str, least: int = 100, compression: str = "gzip", **columns: str) -> DataFrame:
    """Write the pages as archives below ``path`` and read them back: one row per page.

    ``payload_bytes`` and ``payload_digest`` of a response are worked out from
    the bytes that came back; those of a revisit are in its headers. Revisits
    and responses are read apart by a predicate on the record type that the
    source takes over, and revisits without payloads. The rows are written to
    a table before they are given out.
    """
    spark = pages.sparkSession
    register(spark)
    page_records(pages, least, **columns).write.format("warc").mode("append").option("compression", compression).save(path)
    number = lambda c: F.regexp_extract(c, "^urn:page:(-?[0-9]+)$", 1).try_cast("long")
    response = read_warc(spark, path, ["record_id", "record_type", "payload"], "record_type = 'response'")
    revisit = read_warc(spark, path, ["record_id", "record_type", "refers_to", "payload_digest", "payload_length"], "record_type = 'revisit'")
    rows = response.select(
        number("record_id").alias("page_id"),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_digest"),
        "record_type",
        F.lit(None).cast("long").alias("refers_to"),
    ).unionByName(
        revisit.select(
            number("record_id").alias("page_id"),
            F.col("payload_length").alias("payload_bytes"),
            F.regexp_extract("payload_digest", "^sha256:([0-9a-f]{64})$", 1).alias("payload_digest"),
            "record_type",
            number("refers_to").alias("refers_to"),
        )
    )
    return staged(rows, "archived")


def archive_folder(spark: SparkSession) -> str:
    return shared_folder(spark, "warc")
