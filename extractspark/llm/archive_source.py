"""A Spark data source over folders of tar archives: ``spark.read.format("media_archive")``.

Writing: each task streams its members into archives below ``path`` and a table of members beside each; the committed
archives are named in a manifest, so files of failed or repeated attempts are never read. Reading: the archives are cut
into byte ranges of about ``split_bytes``; a task opens its archive once and streams the members whose header starts in
its range in batches of about ``batch_bytes``. It finds them in the table of members by bisection, reading no more of the
table than its own entries.

A folder without a manifest is one of ordinary tar files (``*.tar``: ustar, GNU long names, pax paths and sizes). They
have no table, so a task walks the headers from the archive's start to its range, a header read a member; payloads are
never taken for headers. After a damaged header, which is a row of its own, the walk goes on at the next sound one.

A member that can't be read, whatever the reason, is tried again by itself, at its own offset, with a new handle and after
a pause that doubles (``pause_ms``); after ``retries`` it becomes a row with the reason, and the others are unaffected.

Rows: member string, doc_id long, n_bytes long, offset long, media binary, error string (doc_id is null and n_bytes the
member's size where there is no table). An empty folder gives no rows. Stores: those of Arrow's file systems (local
paths, file://, hdfs://, s3://, gs://). This module imports nothing of the package: it is sent to the workers by value.
"""

from __future__ import annotations

import json
import struct
import sys
import time
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SCHEMA = "member string, doc_id long, n_bytes long, offset long, media binary, error string"
#: A member's entry: header offset, size, checksum, doc_id, n_bytes, whether doc_id is there.
ENTRY = "<qqIqqB"
BLOCK = 512


def store(path: str):  # noqa: ANN201
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def tar_header(name: str, size: int) -> bytes:
    """A ustar header; sizes beyond eight octal GiB take the base-256 form."""
    field = b"%011o\0" % size if size < 8**11 else b"\x80" + size.to_bytes(11, "big")
    head = bytearray(BLOCK)
    head[0:100] = name.encode()[:100].ljust(100, b"\0")
    head[100:124] = b"0000644\0" + b"0000000\0" * 2
    head[124:148] = field + b"%011o\0" % 0
    head[148:156] = b" " * 8
    head[156:157] = b"0"
    head[257:265] = b"ustar\x0000"
    head[148:156] = b"%06o\0 " % sum(head)
    return bytes(head)


@dataclass
class Written(WriterCommitMessage):
    archives: list[list]


class ArchiveWriter(DataSourceArrowWriter):
    def __init__(self, options: dict) -> None:
        self.path = options["path"]
        self.limit = int(options.get("archive_bytes", 256 << 20))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files, top = store(self.path)
        files.create_dir(top, recursive=True)
        done, out, entries, name = [], None, [], ""

        def close() -> None:
            out.write(bytes(2 * BLOCK))
            size = out.tell()
            out.close()
            with files.open_output_stream(f"{top}/{name}.members") as beside:
                beside.write(b"".join(entries))
            done.append([name, size, len(entries)])

        try:
            for batch in iterator:
                for row in batch.to_pylist():
                    if out is None:
                        name, entries = f"{uuid.uuid4().hex}.tar", []
                        out = files.open_output_stream(f"{top}/{name}", compression=None)
                    media = row["media"] or b""
                    entries.append(struct.pack(ENTRY, out.tell(), len(media), zlib.crc32(media), row["doc_id"] or 0, row["n_bytes"] or 0, row["doc_id"] is not None))
                    out.write(tar_header(f"{len(entries):08d}-{row['doc_id']}.{row.get('kind') or 'bin'}", len(media)))
                    out.write(media)
                    out.write(bytes(-len(media) % BLOCK))
                    if out.tell() >= self.limit:
                        close()
                        out = None
            if out is not None:
                close()
                out = None
        finally:
            if out is not None:  # the attempt failed: nothing names this file
                out.close()
        return Written(done)

    def commit(self, messages: list) -> None:
        files, top = store(self.path)
        files.create_dir(top, recursive=True)
        with files.open_output_stream(f"{top}/_manifest.json") as out:
            out.write(json.dumps([a for m in messages if m is not None for a in m.archives]).encode())

    def abort(self, messages: list) -> None:
        files, top = store(self.path)
        for name, *_ in [a for m in messages if m is not None for a in m.archives]:
            for x in (name, f"{name}.members"):
                files.delete_file(f"{top}/{x}")


@dataclass
class Range(InputPartition):
    archive: str
    start: int
    stop: int
    indexed: bool


@dataclass
class Member:
    """What is known of a member before its payload is read."""

    offset: int
    size: int
    data: int  # where the payload starts
    name: str | None = None
    checksum: int | None = None
    doc_id: int | None = None
    n_bytes: int | None = None
    error: str | None = None


def _number(field: bytes) -> int:
    """An octal field, or a base-256 one."""
    if field[:1] in (b"\x80", b"\xff"):
        return int.from_bytes(field[1:], "big")
    return int(field.strip(b"\0 ") or b"0", 8)


def _sound(head: bytes) -> bool:
    """Whether this block is a header: its checksum holds."""
    try:
        return len(head) == BLOCK and any(head) and _number(head[148:156]) == sum(head[:148]) + 8 * 32 + sum(head[156:])
    except ValueError:
        return False


def walk(source, stop: int) -> Iterator[Member]:  # noqa: ANN001
    """The members of an ordinary archive whose headers start before stop, and a member with an error for each gap."""
    size, at, name, longer = source.size(), 0, None, None
    while at < min(stop, size):
        source.seek(at)
        head = source.read(BLOCK)
        if not any(head):
            at += BLOCK
            continue
        if not _sound(head):
            gap, at = at, at + BLOCK
            while at < size and not _sound(head):
                source.seek(at)
                head = source.read(BLOCK)
                at += BLOCK
            at = at - BLOCK if _sound(head) else size
            yield Member(gap, 0, gap, error="OSError: the header is damaged")
            name = longer = None
            continue
        length, kind = _number(head[124:136]), head[156:157]
        data, extra = at + BLOCK, b""
        if kind in b"Lx" and kind:
            extra = source.read(length)
            if kind == b"L":
                name = extra.rstrip(b"\0").decode(errors="replace")
            else:
                pairs = dict(p.split(b" ", 1)[1].split(b"=", 1) for p in extra.splitlines() if b" " in p and b"=" in p)
                name, longer = pairs[b"path"].decode(errors="replace") if b"path" in pairs else name, int(pairs.get(b"size", b"0")) or longer
        else:
            length = longer if longer is not None else length
            if kind in (b"0", b"\0", b"7"):
                own = head[:100].rstrip(b"\0").decode(errors="replace")
                prefix = head[345:500].rstrip(b"\0").decode(errors="replace") if head[257:263] == b"ustar\0" else ""
                yield Member(at, length, data, name or (f"{prefix}/{own}" if prefix else own), n_bytes=length)
            name = longer = None
        at = data + length + -length % BLOCK


def listed(table, start: int, stop: int) -> Iterator[Member]:  # noqa: ANN001
    """The members in a table of members whose headers start in the range, found by bisection."""
    width = struct.calcsize(ENTRY)
    low, high = 0, table.size() // width
    while low < high:
        middle = (low + high) // 2
        table.seek(middle * width)
        if struct.unpack(ENTRY, table.read(width))[0] < start:
            low = middle + 1
        else:
            high = middle
    table.seek(low * width)
    while True:
        many = table.read(1024 * width)
        for offset, size, checksum, doc_id, n_bytes, known in struct.iter_unpack(ENTRY, many):
            if offset >= stop:
                return
            yield Member(offset, size, offset + BLOCK, None, checksum, doc_id if known else None, n_bytes)
        if len(many) < 1024 * width:
            return


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path = options["path"]
        self.split = int(options.get("split_bytes", 8 << 20))
        self.batch = int(options.get("batch_bytes", 2 << 20))
        self.retries = int(options.get("retries", 3))
        self.pause = int(options.get("pause_ms", 50)) / 1000

    def partitions(self) -> list[Range]:
        from pyarrow import fs

        files, top = store(self.path)
        if files.get_file_info(f"{top}/_manifest.json").type == fs.FileType.File:
            with files.open_input_stream(f"{top}/_manifest.json") as listing:
                archives = [(name, size, True) for name, size, _ in json.loads(listing.read())]
        else:
            found = files.get_file_info(fs.FileSelector(top, recursive=False))
            archives = sorted((f.base_name, f.size, False) for f in found if f.type == fs.FileType.File and f.base_name.endswith(".tar"))
        return [Range(name, at, min(at + self.split, size), table) for name, size, table in archives for at in range(0, size, self.split)] or [Range("", 0, 0, True)]

    def members(self, files, where: str, part: Range) -> Iterator[Member]:  # noqa: ANN001
        if part.indexed:
            with files.open_input_file(f"{where}.members") as table:
                yield from listed(table, part.start, part.stop)
        else:
            with files.open_input_file(where) as source:
                yield from (m for m in walk(source, part.stop) if m.offset >= part.start)

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.archive:
            return
        files, top = store(self.path)
        where = f"{top}/{partition.archive}"
        names = ["member", "doc_id", "n_bytes", "offset", "media", "error"]
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string()]
        rows, held, source = [], 0, None
        try:
            for m in self.members(files, where, partition):
                media, error = None, m.error
                for attempt in range(1 + self.retries if error is None else 0):
                    if attempt:
                        time.sleep(self.pause * 2 ** (attempt - 1))
                    try:
                        source = source or files.open_input_file(where)
                        media, m.name = self.payload(source, m)
                        error = None
                        break
                    except Exception as found:  # noqa: BLE001  whatever it is, it is this member's alone
                        media, error = None, f"{type(found).__name__}: {found}"
                        if source is not None:
                            source.close()
                            source = None
                rows.append((m.name, m.doc_id, m.n_bytes, m.offset, media, error))
                held += m.size if media is not None else 0
                if held >= self.batch or len(rows) >= 4096:
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                    rows, held = [], 0
        finally:
            if source is not None:
                source.close()
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    @staticmethod
    def payload(source, m: Member) -> tuple[bytes, str | None]:  # noqa: ANN001
        """The payload and the name; OSError if they aren't what was written."""
        name = m.name
        source.seek(m.offset if m.checksum is not None else m.data)
        if m.checksum is not None:
            head = source.read(BLOCK)
            if not _sound(head) or head[257:262] != b"ustar":
                raise OSError("the header is damaged")
            name = head[:100].rstrip(b"\0").decode()
        media = source.read(m.size)
        if len(media) != m.size:
            raise OSError(f"the archive ends after {len(media)} of {m.size} bytes")
        if m.checksum is not None and zlib.crc32(media) != m.checksum:
            raise OSError("the bytes are not those that were written")
        return media, name


class MediaArchive(DataSource):
    @classmethod
    def name(cls) -> str:
        return "media_archive"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ArchiveReader:  # noqa: ANN001
        return ArchiveReader(self.options)

    def writer(self, schema, overwrite: bool) -> ArchiveWriter:  # noqa: ANN001
        return ArchiveWriter(self.options)
