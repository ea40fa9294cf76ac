"""Content-addressed media payloads in tar shards.

A text's UTF-8 bytes, padded with bytes 255 to a positive multiple of 576, become the 8-bit grey
samples of a lossless PNG of width 576. Each task appends its images to tar shards in the shared
folder; a member's name is the SHA-256 of its bytes and a shard holds each content once. Rows carry
digest, offset and length. Shards are written under a temporary name and moved to a name that
follows from their members, so a repeated task attempt yields the same file. Nothing is shuffled.

Copies that fall into different shards are stored once per shard.
"""

from __future__ import annotations

import hashlib
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import text_buffers
from .scratch import materialize, scratch_path

WIDTH = 576
SHARD_BYTES = 256 << 20
BLOCK = 512
PNG = b"\x89PNG\r\n\x1a\n"
#: PNG signature and IHDR chunk.
HEAD = 33
LOCATION = "id long, n_bytes long, digest string, shard string, offset long, length long"
COLUMNS = "digest string, shard string, offset long, length long, media_bytes long, width long, height long, payload_bytes long"


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode(raw: bytes) -> bytes:
    """PNG of the padded bytes."""
    payload = raw + b"\xff" * (-len(raw) % WIDTH if raw else WIDTH)
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), np.uint8)
    lines[:, 1:] = rows
    header = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return PNG + _chunk(b"IHDR", header) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 6)) + _chunk(b"IEND", b"")


def decode(image: bytes) -> bytes:
    """The samples of an image of `encode`."""
    width, height = struct.unpack(">II", image[16:24])
    at, body = HEAD, b""
    while at < len(image):
        size, kind = struct.unpack(">I4s", image[at : at + 8])
        if kind == b"IDAT":
            body += image[at + 8 : at + 8 + size]
        at += size + 12
    lines = np.frombuffer(zlib.decompress(body), np.uint8).reshape(height, width + 1)
    return lines[:, 1:].tobytes()


def _tar_header(name: str, size: int) -> bytes:
    """A ustar header; the size is octal, or binary from 8 GiB."""
    octal = b"%011o\0" % size if size < 8 << 30 else b"\x80" + size.to_bytes(11, "big")
    fields = [name.encode().ljust(100, b"\0"), b"0000644\0", b"0000000\0", b"0000000\0", octal, b"00000000000\0", b" " * 8, b"0", b"\0" * 100, b"ustar\x0000"]
    head = b"".join(fields).ljust(BLOCK, b"\0")
    return head[:148] + b"%06o\0 " % sum(head) + head[156:]


def tar_entry(head: bytes) -> tuple[str, int]:
    """(name, size) of a ustar header."""
    size = head[124:136]
    return head[:100].rstrip(b"\0").decode(), int.from_bytes(size[1:], "big") if size[0] & 0x80 else int(size.rstrip(b"\0 ") or b"0", 8)


def _store(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a folder's address; Hadoop's names of S3 stand for s3."""
    uri = re.sub("^s3[an]://", "s3://", uri)
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


class _Shard:
    def __init__(self, folder: str) -> None:
        self.files, self.folder = _store(folder)
        self.files.create_dir(self.folder, recursive=True)
        self.temporary = f"{self.folder}/.{uuid.uuid4().hex}"
        self.out = self.files.open_output_stream(self.temporary)
        self.at, self.known, self.names = 0, {}, hashlib.sha256()

    def add(self, raw: bytes) -> tuple[str, int, int]:
        key = hashlib.sha256(raw).digest()
        if key not in self.known:
            image = encode(raw)
            digest = hashlib.sha256(image).hexdigest()
            self.out.write(_tar_header(f"{digest}.png", len(image)))
            self.out.write(image + b"\0" * (-len(image) % BLOCK))
            self.names.update(digest.encode())
            self.known[key] = digest, self.at + BLOCK, len(image)
            self.at += BLOCK + len(image) + -len(image) % BLOCK
        return self.known[key]

    def close(self) -> str:
        self.out.write(b"\0" * 2 * BLOCK)
        self.out.close()
        name = f"{self.names.hexdigest()}.tar"
        try:
            self.files.move(self.temporary, f"{self.folder}/{name}")
        except OSError:  # some stores refuse to replace; another attempt has written the same shard
            if self.files.get_file_info(f"{self.folder}/{name}").type != fs.FileType.File:
                raise
            self.files.delete_file(self.temporary)
        return name


def write_shards(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Store every text; LOCATION rows. Null texts are empty: one row of bytes 255."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, rows = None, []

        def close() -> pa.RecordBatch:
            name = shard.close()
            i, n, digest, at, size = zip(*rows, strict=True)
            arrays = [pa.array(i, pa.int64()), pa.array(n, pa.int64()), pa.array(digest), pa.array([name] * len(rows)), pa.array(at, pa.int64()), pa.array(size, pa.int64())]
            return pa.RecordBatch.from_arrays(arrays, ["id", "n_bytes", "digest", "shard", "offset", "length"])

        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            for k, doc in enumerate(batch.column(0).to_pylist()):
                shard = shard or _Shard(folder)
                raw = data[offsets[k] : offsets[k + 1]].tobytes()
                rows.append((doc, len(raw), *shard.add(raw)))
                if shard.at >= shard_bytes:
                    yield close()
                    shard, rows = None, []
        if rows:
            yield close()

    picked = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return materialize(picked.mapInArrow(write, LOCATION), "media-rows")


class _Reader:
    """Range reads of one shard after another."""

    def __init__(self, folder: str) -> None:
        self.files, self.folder = _store(folder)
        self.name, self.source = None, None

    def read(self, shard: str, at: int, size: int) -> bytes:
        if shard != self.name:
            if self.source:
                self.source.close()
            self.name, self.source = shard, self.files.open_input_file(f"{self.folder}/{shard}")
        self.source.seek(at)
        return self.source.read(size)

    def header(self, shard: str, offset: int) -> tuple[str, int, int, int]:
        """(digest, media bytes, width, height) from the tar header and the first 33 bytes alone."""
        head = self.read(shard, offset - BLOCK, BLOCK + HEAD)
        name, size = tar_entry(head)
        if head[BLOCK : BLOCK + 8] != PNG:
            raise ValueError(f"no image at {offset} of {shard}")
        return name.removesuffix(".png"), size, *struct.unpack(">II", head[BLOCK + 16 : BLOCK + 24])


def media_columns(locations: DataFrame, folder: str) -> DataFrame:
    """Metadata columns of the rows' images, by range reads of headers only."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _Reader(folder)
        for batch in batches:
            digest, shard, offset, length = (batch.column(c).to_pylist() for c in range(4))
            rows = [reader.header(s, o)[1:] for s, o in zip(shard, offset, strict=True)]
            size, width, height = zip(*rows, strict=True) if rows else ((), (), ())
            extra = [size, width, height, [w * h for w, h in zip(width, height, strict=True)]]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(x, pa.int64()) for x in extra)], [c.split()[0] for c in COLUMNS.split(", ")])

    return locations.select("digest", "shard", "offset", "length").mapInArrow(read, COLUMNS)


def _feature(samples: bytes) -> str:
    """Mean, deviation and an 8-step histogram of the samples."""
    counts = np.bincount(np.frombuffer(samples, np.uint8), minlength=256)
    n, grey = counts.sum(), np.arange(256)
    mean = float((counts * grey).sum() / n)
    spread = float(np.sqrt(max((counts * grey * grey).sum() / n - mean * mean, 0.0)))
    return f"mean={mean:.4f};sd={spread:.4f};hist=" + ",".join(map(str, counts.reshape(8, 32).sum(1)))


def media_features(locations: DataFrame, folder: str, id_col: str = "doc_id") -> DataFrame:
    """Read each row's stored bytes back: sizes, digests and features. Copies in a shard are read once.

    Sizes come from a header-only read, the rest from the payload, whose digest must match.
    """
    schema = "id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, shard string, offset long, length long"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _Reader(folder)
        known: dict[str, tuple] = {}
        present = None
        for batch in batches:
            ids, sizes, digest, shard, offset, length = (batch.column(c) for c in range(6))
            rows = []
            for d, s, o, n in zip(digest.to_pylist(), shard.to_pylist(), offset.to_pylist(), length.to_pylist(), strict=True):
                if s != present:
                    known, present = {}, s
                if d not in known:
                    _, media_bytes, width, height = reader.header(s, o)
                    image = reader.read(s, o, n)
                    found = hashlib.sha256(image).hexdigest()
                    if found != d:
                        raise ValueError(f"stored bytes of {d} have digest {found}")
                    payload = decode(image)
                    known[d] = width * height, hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), media_bytes, found, _feature(payload)
                rows.append(known[d])
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            cols = zip(*rows, strict=True) if rows else [()] * 6
            yield pa.RecordBatch.from_arrays([ids, sizes, *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True)), shard, offset, length], [c.split()[0] for c in schema.split(", ")])

    return locations.mapInArrow(read, schema).withColumnRenamed("id", id_col)


def media_table(docs: DataFrame, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store the texts of docs under folder (default: the shared folder) and return media_features.

    Null texts are empty; ids may be null or repeat, each row gives one row; no rows give none.
    """
    folder = folder or scratch_path(docs.sparkSession, "media")
    return media_features(write_shards(docs, folder, id_col, text_col), folder, id_col)
