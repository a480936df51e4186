"""Texts as media columns: stored losslessly as images of 8-bit samples, read back from archives by byte range.

A payload is the text's UTF-8 bytes with zeros up to a positive multiple of 64; it is stored as a greyscale PNG, 64
samples a row. ``store`` writes the images to archives (see archive_source), ``load`` plans byte ranges over them and
decodes what it reads, member by member.

Defined results: a null or empty text is 64 zero samples, n_bytes 0; repeated rows are repeated members; a null doc_id
stays null; an empty table gives an empty archive folder and no rows; further columns are ignored; equal texts, whatever
their ids, give equal figures; a text of any length is one member (of 2 GiB at most, the most an Arrow value holds); a
member that stays unreadable is a row with its error and null figures.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..deploy import ship
from .archive_source import MediaArchive
from .common import column, lean, new_folder, slices

WIDTH = 64
SIGNATURE = b"\x89PNG\r\n\x1a\n"


def payload(text: str | None) -> tuple[bytes, int]:
    """Padded bytes, and how many there were."""
    data = (text or "").encode()
    return data + bytes(max(WIDTH if not data else 0, -len(data) % WIDTH)), len(data)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(samples: bytes) -> bytes:
    """Rows of 64 samples, each after its filter byte 0."""
    rows = np.zeros((len(samples) // WIDTH, WIDTH + 1), np.uint8)
    rows[:, 1:] = np.frombuffer(samples, np.uint8).reshape(-1, WIDTH)
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), 1)) + _chunk(b"IEND", b"")


def from_png(media: bytes) -> bytes:
    """The samples of an image that ``to_png`` made; ValueError for anything else."""
    if media[:8] != SIGNATURE:
        raise ValueError("no PNG")
    at, data, size = 8, [], (0, 0)
    while at < len(media):
        (n,) = struct.unpack_from(">I", media, at)
        kind, body = media[at + 4 : at + 8], media[at + 8 : at + 8 + n]
        if struct.unpack_from(">I", media, at + 8 + n)[0] != zlib.crc32(kind + body):
            raise ValueError("a chunk's checksum is wrong")
        if kind == b"IHDR":
            size = struct.unpack_from(">II", body)
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + n
    rows = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(-1, WIDTH + 1)
    if size != (WIDTH, len(rows)) or rows[:, 0].any():
        raise ValueError("not rows of 64 unfiltered samples")
    return rows[:, 1:].tobytes()


def feature(samples: bytes) -> str:
    """Mean, spread, zero crossings about 128, peak, and the entropy of the samples in bits."""
    x = np.frombuffer(samples, np.uint8)
    counts = np.bincount(x, minlength=256)
    values = np.arange(256)
    mean = float(counts @ values) / len(x)
    spread = max(0.0, float(counts @ (values * values)) / len(x) - mean * mean) ** 0.5
    high = x >= 128
    crossings = int(np.count_nonzero(high[1:] != high[:-1]))
    p = counts[counts > 0] / len(x)
    return f"mean={mean:.4f};spread={spread:.4f};crossings={crossings};peak={int(x.max())};entropy={float(-(p * np.log2(p)).sum()) + 0.0:.4f}"


def store(docs: DataFrame, path: str, archive_bytes: int = 256 << 20) -> None:
    """Write the texts' images to archives below path."""
    spark = docs.sparkSession
    ship(spark)
    spark.dataSource.register(MediaArchive)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 2 << 20):
            made = [payload(t) for t in column(batch, "text").to_pylist()]
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array([n for _, n in made], pa.int64()), pa.array([to_png(p) for p, _ in made], pa.binary()), pa.array(["png"] * len(made))], names=["doc_id", "n_bytes", "media", "kind"])

    images = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(lean(encode), "doc_id long, n_bytes long, media binary, kind string")
    images.write.format("media_archive").mode("append").option("path", path).option("archive_bytes", archive_bytes).save()


def load(spark: SparkSession, path: str, **options: int) -> DataFrame:
    """A row for each stored member: its digests and features, or the reason why it can't be read."""
    ship(spark)
    spark.dataSource.register(MediaArchive)
    reader = spark.read.format("media_archive").option("path", path)
    for k, v in options.items():
        reader = reader.option(k, v)
    names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "member", "error"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string()]

    def read_one(media: bytes | None, member: str | None, error: str | None) -> tuple:
        if error is None:
            try:
                x = from_png(media)
                return len(x), hashlib.sha256(x).hexdigest(), zlib.crc32(x[-WIDTH:]), len(media), hashlib.sha256(media).hexdigest(), feature(x), member, None
            except (ValueError, struct.error, zlib.error) as found:
                error = f"{type(found).__name__}: {found}"
        return *[None] * 6, member, error

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                rows = [read_one(*x) for x in zip(*(column(batch, n).to_pylist() for n in ("media", "member", "error")), strict=True)]
                yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), column(batch, "n_bytes"), *(pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True))], names=["doc_id", "n_bytes", *names])

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, member string, error string"
    return reader.load().select("member", "doc_id", "n_bytes", "media", "error").mapInArrow(lean(decode), schema)


def round_trip(docs: DataFrame) -> DataFrame:
    """Store all texts in a new folder below the shared one and read them back."""
    path = new_folder(docs.sparkSession, "media")
    store(docs, path)
    return load(docs.sparkSession, path)
