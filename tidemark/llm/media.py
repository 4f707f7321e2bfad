"""Content-addressed media payloads in tar shards.

A payload is a text's UTF-8 bytes followed by zero bytes up to a positive multiple
of 64.  It is stored losslessly as an 8-bit greyscale PNG, 64 samples wide, one
row per 64 bytes.  Every task appends the distinct payloads it meets to tar shards
of about ``shard_bytes`` in the shared folder, under the payload's digest, and
emits one small row per document: digest, shard, offset, length.  The copy of a
digest that all rows refer to is the first by (shard, offset).

Metadata columns (width, height, bit depth, colour type) come from range reads of
the PNG header alone; payload features come from full reads of the stored bytes.
Shard names carry a unique token of the task attempt, so a repeated or speculative
task never overwrites a shard that rows refer to; rows are settled before reading.

Null text counts as empty (64 zero bytes); repeated rows and equal texts share one
object; extra columns are ignored; an empty input writes no shard.
"""

from __future__ import annotations

import hashlib
import io
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import remove, scratch_path, settle

WIDTH = 64
HEADER_BYTES = 33  # signature and IHDR chunk
PNG_SIGNATURE = b"\x89PNG\r\n\x1a\n"
SHARD_BYTES = 64 << 20


def payload_of(text: str | None) -> tuple[bytes, int]:
    raw = (text or "").encode()
    size = max(WIDTH, -(-len(raw) // WIDTH) * WIDTH)
    return raw.ljust(size, b"\0"), len(raw)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(payload: bytes, level: int = 6) -> bytes:
    rows = len(payload) // WIDTH
    lines = bytearray(rows * (WIDTH + 1))
    for k in range(WIDTH):  # one filter byte (none) before each row
        lines[k + 1 :: WIDTH + 1] = payload[k::WIDTH]
    header = struct.pack(">IIBBBBB", WIDTH, rows, 8, 0, 0, 0, 0)
    return PNG_SIGNATURE + _chunk(b"IHDR", header) + _chunk(b"IDAT", zlib.compress(bytes(lines), level)) + _chunk(b"IEND", b"")


def png_header(head: bytes) -> tuple[int, int, int, int]:
    """(width, height, bit depth, colour type) from the first 33 bytes."""
    if head[:8] != PNG_SIGNATURE or head[12:16] != b"IHDR":
        raise ValueError("not a PNG")
    return struct.unpack(">IIBB", head[16:26])


def from_png(media: bytes) -> bytes:
    width, rows, depth, colour = png_header(media[:HEADER_BYTES])
    if (width, depth, colour) != (WIDTH, 8, 0):
        raise ValueError("unexpected layout")
    at, data = HEADER_BYTES, b""
    while at < len(media):
        size, kind = struct.unpack(">I4s", media[at : at + 8])
        if kind == b"IDAT":
            data += media[at + 8 : at + 8 + size]
        at += 12 + size
    lines = zlib.decompress(data)
    out = bytearray(rows * WIDTH)
    for k in range(WIDTH):
        out[k::WIDTH] = lines[k + 1 :: WIDTH + 1]
    return bytes(out)


class ShardWriter:
    """Appends objects to tar shards through the shared folder's file system."""

    def __init__(self, folder: str, shard_bytes: int):
        from pyarrow import fs

        self.fs, self.root = fs.FileSystem.from_uri(folder)
        self.fs.create_dir(self.root, recursive=True)
        self.shard_bytes, self.out, self.at, self.name = shard_bytes, None, 0, ""

    def put(self, digest: str, media: bytes) -> tuple[str, int, int]:
        if self.out is None:
            self.name, self.at = f"shard-{uuid.uuid4().hex}.tar", 0
            self.out = self.fs.open_output_stream(f"{self.root}/{self.name}")
        info = tarfile.TarInfo(f"{digest}.png")
        info.size = len(media)
        head = info.tobuf(tarfile.USTAR_FORMAT)
        place = (self.name, self.at + len(head), len(media))
        pad = -len(media) % tarfile.BLOCKSIZE
        self.out.write(head + media + b"\0" * pad)
        self.at += len(head) + len(media) + pad
        if self.at >= self.shard_bytes:
            self.close()
        return place

    def close(self) -> None:
        if self.out is not None:
            self.out.write(b"\0" * (2 * tarfile.BLOCKSIZE))
            self.out.close()
            self.out = None


def store(docs: DataFrame, folder: str, *, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Write the tar shards; a settled row (id, n_bytes, digest, shard, offset,
    length) per document."""
    kind = docs.schema[id_col].dataType.simpleString()
    src = docs.selectExpr(f"`{id_col}` AS id", f"`{text_col}` AS text")
    names = ["id", "n_bytes", "digest", "shard", "offset", "length"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = ShardWriter(folder, shard_bytes)
        known: dict[str, tuple] = {}
        for batch in batches:
            sizes, digests, places = [], [], []
            for text in batch.column("text"):
                payload, n = payload_of(text.as_py())
                digest = hashlib.sha256(payload).hexdigest()
                if digest not in known:
                    if len(known) >= 200_000:
                        known.clear()
                    known[digest] = writer.put(digest, to_png(payload))
                sizes.append(n)
                digests.append(digest)
                places.append(known[digest])
            shard, offset, length = zip(*places, strict=True) if places else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sizes, pa.int64()), pa.array(digests, pa.string()), pa.array(shard, pa.string()), pa.array(offset, pa.int64()), pa.array(length, pa.int64())], names)
        writer.close()

    rows = src.mapInArrow(run, f"id {kind}, n_bytes bigint, digest string, shard string, offset bigint, length bigint")
    return settle(rows, "media-index")


def objects(index: DataFrame) -> DataFrame:
    """One row per stored payload: its digest and the copy that counts."""
    place = F.min(F.struct("shard", "offset", "length")).alias("place")
    return index.groupBy("digest").agg(place).select("digest", "place.shard", "place.offset", "place.length")


def _read(objs: DataFrame, folder: str, schema: str, one, whole: bool) -> DataFrame:
    """Add the columns ``one(bytes)`` gives for each object's range of its shard; rows
    keep their columns, order and partition."""
    fields = [x.split() for x in schema.split(", ")]
    names = [*objs.columns, *(n for n, _ in fields)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        files, root = fs.FileSystem.from_uri(folder)
        held, opened = None, ""
        for batch in batches:
            rows = []
            for shard, offset, length in zip(batch.column("shard").to_pylist(), batch.column("offset").to_pylist(), batch.column("length").to_pylist(), strict=True):
                if shard != opened:
                    if held:
                        held.close()
                    held, opened = files.open_input_file(f"{root}/{shard}"), shard
                rows.append(one(held.read_at(length if whole else min(length, HEADER_BYTES), offset)))
            cols = list(zip(*rows, strict=True)) or [()] * len(fields)
            added = [pa.array(c, pa.string() if t == "string" else pa.int64()) for c, (_, t) in zip(cols, fields, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], names)

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in objs.schema.fields)
    return objs.mapInArrow(run, f"{kept}, {schema}")


def by_shard(objs: DataFrame) -> DataFrame:
    """Objects placed so that a task reads neighbouring ranges in order."""
    return objs.repartition(F.xxhash64("shard", F.shiftright("offset", 20))).sortWithinPartitions("shard", "offset")


def header_columns(objs: DataFrame, folder: str) -> DataFrame:
    """Adds each object's metadata, from its header bytes only."""
    return _read(objs, folder, "width bigint, height bigint, bit_depth bigint, colour_type bigint", lambda b: tuple(map(int, png_header(b))), False)


def payload_columns(objs: DataFrame, folder: str) -> DataFrame:
    """Adds digests and features of each object's stored and decoded bytes."""

    def one(media: bytes) -> tuple:
        payload = from_png(media)
        return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]), len(media), hashlib.sha256(media).hexdigest()

    return _read(objs, folder, "payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string", one, True)


def media_table(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES, keep_shards: bool = True) -> DataFrame:
    """Per document: place, header metadata and payload features of its media.

    ``feature`` is ``png:<width>x<height>x<bits>`` from the header.  With
    ``keep_shards`` false the shards are removed once all columns are settled.
    """
    spark = docs.sparkSession
    folder = scratch_path(spark, "media")
    index = store(docs, folder, id_col=id_col, text_col=text_col, shard_bytes=shard_bytes)
    feature = F.concat(F.lit("png:"), "width", F.lit("x"), "height", F.lit("x"), "bit_depth")
    read = payload_columns(header_columns(by_shard(objects(index)), folder), folder)
    found = settle(read.withColumn("feature", feature).drop("width", "height", "bit_depth", "colour_type"), "media-columns")
    if not keep_shards:
        remove(spark, folder)
    out = index.select(F.col("id").alias(id_col), "n_bytes", "digest").join(found, "digest")
    return out
