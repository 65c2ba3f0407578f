"""Web archives as a Spark data source, and pages kept in them with copies as revisits.

``read`` (``spark.read.format("warc")``) plans partitions of whole files, takes conditions on record types
and other named fields, and reads a record's named fields before anything else.
A record that is not wanted is stepped over: in plain files by its ``Content-Length``, in
files with one gzip member a record by the member's length from its ``SL`` extra field (the
skip-lengths of the WARC standard), so its payload is neither inflated nor copied.  Members
without that field are inflated to find their end and thrown away.  The schema asked for
decides what is decoded: without ``payload`` in it, payloads of wanted records are not copied.

Conditions are an option of the frame, not caught from Spark's filters: Spark 4.1.2 keeps the
filters it pushed into a Python source with the relation, so a frame that was counted once with a
filter and once without gave the filtered count both times, and the union of two filters of one
frame lost rows.  Filters on the frame still hold, after the records are read.

``df.write.format("warc")`` writes files of ``file_bytes`` at most (or one record), each task its
own.  Which files count is said by a manifest written once all tasks are done, so attempts that
were lost or ran twice leave files that nobody reads.

Options of reading: ``path``; ``where``, a JSON list of (column, comparison, value); ``partition_bytes`` (128 MiB); ``torn`` = ``fail`` or ``skip`` what follows
the first broken record of a file.  Of writing: ``path``; ``file_bytes`` (256 MiB, packed);
``compression`` = ``gzip`` or ``none``; ``date``, of all records (now).

Files are reached through ``pyarrow.fs``, so folders may lie in any store it knows by URI.

Defined cases for pages: a null html is empty; a null url leaves out ``WARC-Target-URI``; blanks and
control characters in it are percent-encoded; a null ``page_id`` is smaller than any, gets a record
id from the page's content and comes back null; rows with the largest ``page_id`` of their payload are
all responses, also if they repeat.  A page is one record, however long.  No pages, no records,
and a folder with a manifest of no files.  Other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timezone

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import datasource as ds
from pyspark.sql.types import StructType

from palisade.llm.common import stash

VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SCHEMA = (
    "record_type string, record_id string, target_uri string, date string, content_type string, content_length bigint, "
    "payload_digest string, refers_to string, headers map<string,string>, payload_length bigint, payload binary"
)
#: What writing takes; the payload of a revisit is digested and measured, not stored.
WRITTEN = "record_type string, record_id string, target_uri string, refers_to string, payload binary"

#: Columns that come from named fields, and so can be filtered before the block is looked at.
_FIELDS = {
    "record_type": "warc-type", "record_id": "warc-record-id", "target_uri": "warc-target-uri", "date": "warc-date",
    "content_type": "content-type", "content_length": "content-length", "payload_digest": "warc-payload-digest",
    "refers_to": "warc-refers-to",
}
_END = b"\r\n\r\n"
#: Bytes looked at first for named fields, read from a file at once, and held for a batch of rows.
_FIRST, _CHUNK, _BATCH = 4096, 1 << 20, 8 << 20
_MANIFEST = "_manifest-"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


# --- reading records -------------------------------------------------------------------------


class Torn(ValueError):
    """A record that is cut off or is none."""


class _Window:
    """The bytes of a file from ``at`` on, read a chunk at a time; steps beyond the chunk read nothing."""

    def __init__(self, file, size: int):
        self.file, self.size, self.at, self._chunk, self._start = file, size, 0, b"", 0

    def peek(self, n: int) -> bytes:
        """The next ``n`` bytes, fewer at the end of the file."""
        held = self.at - self._start
        if not 0 <= held <= len(self._chunk) or len(self._chunk) - held < n:
            self.file.seek(self.at)
            self._chunk, self._start, held = self.file.read(max(n, _CHUNK)), self.at, 0
        return self._chunk[held : held + n]

    def over(self) -> bool:
        return self.at >= self.size


def _skip_length(member: bytes) -> int | None:
    """Packed length of a gzip member by its ``SL`` field."""
    if len(member) < 12 or not member[3] & 4:
        return None
    end = 12 + struct.unpack_from("<H", member, 10)[0]
    at = 12
    while at + 4 <= min(end, len(member)):
        name, n = member[at : at + 2], struct.unpack_from("<H", member, at + 2)[0]
        if name == b"SL" and n == 8 and at + 12 <= len(member):
            return struct.unpack_from("<I", member, at + 4)[0] or None
        at += 4 + n
    return None


def _fields(head: bytes) -> dict[str, str]:
    """Named fields of a header block, names lower-cased; folded lines joined, repeated names too."""
    lines = re.split(r"\r?\n", re.sub(rb"\r?\n[ \t]+", b" ", head).decode("utf-8", "replace"))
    out: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if colon:
            name, value = name.strip().lower(), value.strip()
            out[name] = f"{out[name]}, {value}" if name in out else value
    return out


def _warc_fields(head: bytes) -> dict[str, str]:
    if not head.startswith(b"WARC/"):
        raise Torn("no version line")
    fields = _fields(head)
    if not fields.get("content-length", "").isdigit():
        raise Torn("no content length")
    return fields


def _plain_record(window: _Window, wanted) -> tuple[dict[str, str], bytes | None]:
    n = _FIRST
    while (end := (seen := window.peek(n)).find(_END)) < 0:
        if len(seen) < n:
            raise Torn("named fields are cut off")
        n *= 4
    fields = _warc_fields(seen[:end])
    start, length = window.at + end + len(_END), int(fields["content-length"])
    after = start + length
    if after > window.size:
        raise Torn("the block is cut off")
    block = None
    if wanted(fields):
        window.at = start
        block = window.peek(length)
    window.at = min(after + len(_END), window.size)
    return fields, block


def _packed_record(window: _Window, wanted) -> tuple[dict[str, str], bytes | None]:
    length = _skip_length(window.peek(64))
    unpack, start = zlib.decompressobj(31), window.at
    given = 0

    def more(data: bytes, most: int = 0) -> bytes:
        """Up to ``most`` more bytes of the record."""
        nonlocal given
        if not data:
            data = window.peek(_CHUNK if length is None else min(_CHUNK, max(length - given, 0)))
            if not data:
                raise Torn("the member is cut off")
            window.at += len(data)
            given += len(data)
        return unpack.decompress(data, most)

    try:
        seen = more(b"", _FIRST)
        while (end := seen.find(_END)) < 0:
            if unpack.eof:
                raise Torn("named fields are cut off")
            seen += more(unpack.unconsumed_tail, _FIRST)
        fields = _warc_fields(seen[:end])
        keep = wanted(fields)
        if length is not None and not keep:
            if start + length > window.size:
                raise Torn("the member is cut off")
            window.at = start + length
            return fields, None
        parts = [seen[end + len(_END) :]]
        while not unpack.eof:
            part = more(unpack.unconsumed_tail, _CHUNK)
            if keep:
                parts.append(part)
    except zlib.error as e:
        raise Torn(str(e)) from e
    window.at = start + given - len(unpack.unused_data)
    if not keep:
        return fields, None
    block = b"".join(parts)
    n = int(fields["content-length"])
    if len(block) < n:
        raise Torn("the block is cut off")
    return fields, block[:n]


def records(file, size: int, wanted=lambda fields: True) -> Iterator[tuple[dict[str, str], bytes]]:
    """Named fields and block of each record of a file that is ``wanted`` by its named fields."""
    window = _Window(file, size)
    while not window.over():
        at = window.at
        record = _packed_record if window.peek(2) == b"\x1f\x8b" else _plain_record
        try:
            fields, block = record(window, wanted)
        except Torn as e:
            raise Torn(f"{e}, in the record at byte {at}") from e
        if block is not None:
            yield fields, block


def _http(fields: dict[str, str], block: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and body of the HTTP message in a block; a block of another kind is all body."""
    if not fields.get("content-type", "").startswith("application/http"):
        return {}, block
    head, end, body = block.partition(_END)
    return _fields(head), body if end else b""


def _row(fields: dict[str, str], block: bytes, columns: list[str]) -> list:
    out = []
    http = body = None
    for name in columns:
        if name == "headers":
            value = list(fields.items())
        elif name in ("payload", "payload_length"):
            if body is None:
                http, body = _http(fields, block)
            full = fields.get("warc-type") != "revisit"
            if name == "payload":
                value = body if full else None
            else:
                said = http.get("content-length", "")
                value = len(body) if full else int(said) if said.isdigit() else None
        else:
            value = _field(fields, name)
        out.append(value)
    return out


def _field(fields: dict[str, str], name: str):
    value = fields.get(_FIELDS[name])
    if value is None:
        return None
    if name == "content_length":
        return int(value)
    if name == "payload_digest":
        return value.removeprefix("sha1:")
    return value


# --- the data source -------------------------------------------------------------------------

#: Strings compare by code point, which is their order in UTF-8, and so Spark's.
_COMPARE = {
    "=": lambda x, y: x == y, "!=": lambda x, y: x != y, "<": lambda x, y: x < y, "<=": lambda x, y: x <= y,
    ">": lambda x, y: x > y, ">=": lambda x, y: x >= y, "in": lambda x, y: x in y, "not in": lambda x, y: x not in y,
    "starts": str.startswith, "ends": str.endswith, "contains": lambda x, y: y in x,
}


def _check(condition: tuple) -> tuple:
    """``(column, comparison, value)``, with a column that comes from named fields."""
    column, how, value = condition
    if column not in _FIELDS and not column.startswith("headers."):
        raise ValueError(f"{column} is not known before the block is read")
    if how not in _COMPARE and how not in ("null", "not null"):
        raise ValueError(f"no comparison {how}")
    kind = int if column == "content_length" else str
    values = [] if how.endswith("null") else value if how in ("in", "not in") else [value]
    if not all(isinstance(v, kind) for v in values):
        raise ValueError(f"{column} {how} {value}: a value is no {kind.__name__}")
    return column, how, value


def _holds(condition: tuple, fields: dict[str, str]) -> bool:
    """As in SQL, a field that is not there compares with nothing."""
    column, how, wanted = condition
    value = fields.get(column[8:].lower()) if column.startswith("headers.") else _field(fields, column)
    if how.endswith("null"):
        return (value is None) == (how == "null")
    return value is not None and _COMPARE[how](value, wanted)


@dataclass
class Files(ds.InputPartition):
    """A partition: whole files, with their sizes."""

    files: list[tuple[str, int]]


class WarcReader(ds.DataSourceReader):
    def __init__(self, schema: StructType, options):
        self.columns = [f.name for f in schema.fields]
        strange = [c for c in self.columns if c not in _FIELDS and c not in ("headers", "payload", "payload_length")]
        if strange:
            raise ValueError(f"no such columns of a web archive: {strange}")
        self.path = options["path"]
        self.partition_bytes = int(options.get("partition_bytes", 128 << 20))
        self.skip_torn = options.get("torn", "fail") == "skip"
        self.where = [_check(tuple(c)) for c in json.loads(options.get("where", "[]"))]

    def partitions(self) -> list[Files]:
        """Files in order of name, packed until ``partition_bytes`` are full."""
        parts: list[Files] = []
        full = self.partition_bytes
        for name, size in listed(self.path):
            if not parts or full + size > self.partition_bytes:
                parts.append(Files([]))
                full = 0
            parts[-1].files.append((name, size))
            full += size
        return parts or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        types = {"content_length": pa.int64(), "payload_length": pa.int64(), "payload": pa.binary(), "headers": pa.map_(pa.string(), pa.string())}
        schema = pa.schema([(c, types.get(c, pa.string())) for c in self.columns])
        store, root = fs.FileSystem.from_uri(self.path)
        wanted = lambda fields: all(_holds(c, fields) for c in self.where)
        rows: list[list] = []
        held = 0

        def batch() -> pa.RecordBatch:
            columns = zip(*rows) if rows else ([] for _ in self.columns)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

        for name, size in partition.files:
            with store.open_input_file(f"{root}/{name}") as file:
                try:
                    for fields, block in records(file, size, wanted):
                        rows.append(_row(fields, block, self.columns))
                        held += 500 + (len(block) if "payload" in self.columns else 0)
                        if held > _BATCH:
                            yield batch()
                            rows, held = [], 0
                except Torn as e:
                    if not self.skip_torn:
                        raise Torn(f"{name}: {e}") from e
        if rows:
            yield batch()


def listed(path: str) -> list[tuple[str, int]]:
    """Names below ``path`` and sizes of archive files: those in manifests, or all if there is no manifest."""
    store, root = fs.FileSystem.from_uri(path)
    found = [f for f in store.get_file_info(fs.FileSelector(root, recursive=True)) if f.type == fs.FileType.File]
    manifests = [f.path for f in found if f.base_name.startswith(_MANIFEST)]
    if not manifests:
        names = [(f.path[len(root.rstrip("/")) + 1 :], f.size) for f in found if f.base_name.endswith((".warc", ".warc.gz"))]
        return sorted(names)
    out = []
    for manifest in manifests:
        with store.open_input_stream(manifest) as file:
            out += [(name, size) for name, size in json.loads(file.read())]
    return sorted(out)


@dataclass
class Written(ds.WriterCommitMessage):
    files: list[tuple[str, int]]


def _member(record: bytes) -> bytes:
    """One gzip member, with its packed and unpacked length (mod 2^32) in an ``SL`` field."""
    pack = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = pack.compress(record) + pack.flush()
    length = 10 + 2 + 12 + len(body) + 8
    extra = b"SL" + struct.pack("<HII", 8, length if length < 1 << 32 else 0, len(record) & 0xFFFFFFFF)
    head = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", len(extra)) + extra
    return head + body + struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)


def _header(fields: list[tuple[str, str | None]]) -> bytes:
    return "".join([VERSION, "\r\n", *(f"{name}: {value}\r\n" for name, value in fields if value is not None), "\r\n"]).encode()


def _uri(url: str | None) -> str | None:
    """The url without characters that would end a named field or that no URI has."""
    return url and re.sub(r"[\x00-\x20\x7f-\x9f]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url)


def record(kind: str, record_id: str, uri: str | None, refers_to: str | None, payload: bytes, date: str) -> bytes:
    """A response or revisit with the HTTP message that bears ``payload``."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if kind == "revisit" else http + payload
    block_digest = base32_sha1(block)
    return b"".join([
        _header([
            ("WARC-Type", kind), ("WARC-Record-ID", record_id), ("WARC-Date", date), ("WARC-Target-URI", _uri(uri)),
            ("WARC-Payload-Digest", f"sha1:{base32_sha1(payload)}"), ("WARC-Block-Digest", f"sha1:{block_digest}"),
            ("WARC-Profile", REVISIT_PROFILE if kind == "revisit" else None), ("WARC-Refers-To", refers_to),
            ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block))),
        ]),
        block, _END,
    ])


def _info(date: str, name: str) -> bytes:
    block = b"software: palisade\r\nformat: WARC File Format 1.1\r\n"
    return b"".join([
        _header([
            ("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", date), ("WARC-Filename", name),
            ("Content-Type", "application/warc-fields"), ("Content-Length", str(len(block))),
        ]),
        block, _END,
    ])


class WarcWriter(ds.DataSourceArrowWriter):
    def __init__(self, options, overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite
        self.file_bytes = int(options.get("file_bytes", 256 << 20))
        self.packed = options.get("compression", "gzip") == "gzip"
        self.date = options.get("date") or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, root = fs.FileSystem.from_uri(self.path)
        done: list[tuple[str, int]] = []
        file = name = None
        size = 0
        pack = _member if self.packed else bytes
        for batch in iterator:
            columns = [batch.column(c) for c in ("record_type", "record_id", "target_uri", "refers_to", "payload")]
            for i in range(batch.num_rows):
                kind, record_id, uri, refers_to, payload = (c[i].as_py() for c in columns)
                data = pack(record(kind, record_id, uri, refers_to, payload or b"", self.date))
                if file is not None and size + len(data) > self.file_bytes:
                    file.close()
                    done.append((name, size))
                    file = None
                if file is None:
                    if not done:
                        store.create_dir(root, recursive=True)
                    name = f"part-{uuid.uuid4().hex}.warc{'.gz' if self.packed else ''}"
                    # packed by the member, not by the stream
                    file, size = store.open_output_stream(f"{root}/{name}", compression=None), 0
                    size += file.write(pack(_info(self.date, name)))
                size += file.write(data)
        if file is not None:
            file.close()
            done.append((name, size))
        return Written(done)

    def commit(self, messages: list[Written | None]) -> None:
        store, root = fs.FileSystem.from_uri(self.path)
        store.create_dir(root, recursive=True)
        old = [f.path for f in store.get_file_info(fs.FileSelector(root)) if f.type == fs.FileType.File] if self.overwrite else []
        files = [f for m in messages if m for f in m.files]
        with store.open_output_stream(f"{root}/{_MANIFEST}{uuid.uuid4().hex}.json", compression=None) as out:
            out.write(json.dumps(files).encode())
        new = {f"{root}/{name}" for name, _ in files}
        # manifests first: without one, files that are still there would count
        for path in sorted(old, key=lambda p: _MANIFEST not in p):
            if path not in new:
                store.delete_file(path)

    def abort(self, messages: list[Written | None]) -> None:
        store, root = fs.FileSystem.from_uri(self.path)
        for name, _ in (f for m in messages if m for f in m.files):
            store.delete_file(f"{root}/{name}")


class WarcSource(ds.DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(schema, self.options)

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options, overwrite)


def read(spark: SparkSession, path: str, *columns: str, where: list[tuple] = (), **options: str) -> DataFrame:
    """Records of the archives below ``path`` that meet all conditions; only what ``columns`` need is decoded (all, if none is named)."""
    spark.dataSource.register(WarcSource)
    reader = spark.read.format("warc").options(where=json.dumps([_check(c) for c in where]), **options)
    if columns:
        kinds = dict(part.split(" ") for part in SCHEMA.split(", "))
        reader = reader.schema(", ".join(f"{c} {kinds[c]}" for c in columns))
    return reader.load(path)


def write(rows: DataFrame, path: str, overwrite: bool = False, **options: str) -> None:
    """Write rows of ``WRITTEN`` as archives below ``path``."""
    rows.sparkSession.dataSource.register(WarcSource)
    names = [part.split(" ")[0] for part in WRITTEN.split(", ")]
    rows.select(*names).write.format("warc").mode("overwrite" if overwrite else "append").options(**options).save(path)


# --- pages -----------------------------------------------------------------------------------

#: Last group of the record ids of pages, which marks them.
_MARK = "706167650000"


def record_id(page_id: Column, otherwise: Column) -> Column:
    """The record id of a page: a version 8 UUID that holds the 64 bits of ``page_id``; of null, from the hex digits ``otherwise``."""
    digits = F.lower(F.lpad(F.hex(page_id), 16, "0"))
    cut = lambda of, *spans: [F.substring(of, a, n) for a, n in spans]
    a, b, c, d = cut(digits, (1, 8), (9, 4), (13, 3), (16, 1))
    own = F.concat(a, F.lit("-"), b, F.lit("-8"), c, F.lit("-8"), d, F.lit(f"00-{_MARK}"))
    a, b, c, d, e = cut(F.lower(otherwise), (1, 8), (9, 4), (13, 3), (16, 3), (19, 12))
    none = F.concat(a, F.lit("-"), b, F.lit("-8"), c, F.lit("-9"), d, F.lit("-"), e)
    return F.concat(F.lit("<urn:uuid:"), F.coalesce(own, none), F.lit(">"))


def page_of(identifier: Column) -> Column:
    """The ``page_id`` in a record id; null if it holds none."""
    own = rf"^<urn:uuid:([0-9a-f]{{8}})-([0-9a-f]{{4}})-8([0-9a-f]{{3}})-8([0-9a-f])00-{_MARK}>$"
    digits = F.concat(*(F.regexp_extract(identifier, own, i) for i in range(1, 5)))
    return F.when(digits != "", F.conv(digits, 16, -10).cast("bigint"))


def page_records(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Rows to write: of pages with one payload, of ``min_bytes`` at least, the one with the largest ``page_id`` is the response."""
    payload = F.coalesce("html", F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", payload.alias("payload"), F.sha2(payload, 256).alias("same"))
    copies = rows.filter(F.octet_length("payload") >= min_bytes).groupBy("same").agg(F.max("page_id").alias("last"), F.count("*").alias("n"))
    copies = stash(copies.filter("n > 1 and last is not null").select(F.col("same").alias("copied"), "last"), "copies")
    revisit = F.col("last").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("last"))
    own = record_id(F.col("page_id"), F.sha2(F.concat_ws("\n", "url", "same"), 256))
    return rows.join(copies, F.col("same") == F.col("copied"), "left").select(
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        own.alias("record_id"),
        F.col("url").alias("target_uri"),
        F.when(revisit, record_id(F.col("last"), F.lit(""))).alias("refers_to"),
        "payload",
    )


def base32(digest: Column) -> Column:
    """The RFC 4648 form, upper case, of 160 bits given as hex digits."""
    digits = [F.lpad(F.conv(F.substring(digest, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*digits), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def archived_pages(spark: SparkSession, path: str) -> DataFrame:
    """``(page_id, payload_bytes, payload_digest, record_type, refers_to)`` of archived pages.

    Size and digest of a response are taken from the payload that was read; a revisit has
    them in its fields only, and its payload is never looked for.
    """
    responses = read(spark, path, "record_type", "record_id", "payload", where=[("record_type", "=", "response")])
    bare = ("record_type", "record_id", "refers_to", "payload_digest", "payload_length")
    revisits = read(spark, path, *bare, where=[("record_type", "=", "revisit")])
    return responses.select(
        page_of(F.col("record_id")).alias("page_id"), F.octet_length("payload").cast("bigint").alias("payload_bytes"),
        base32(F.sha1("payload")).alias("payload_digest"), "record_type", F.lit(None).cast("bigint").alias("refers_to"),
    ).unionAll(revisits.select(
        page_of(F.col("record_id")), "payload_length", "payload_digest", "record_type", page_of(F.col("refers_to")),
    ))
