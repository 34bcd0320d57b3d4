"""Media columns: payloads as 8-bit grey PNG images in content-addressed tar shards.

Each task streams its payloads into one tar shard in the shared folder, one member per
digest; rows carry digest, shard, offset and length.  ``canonical`` picks one location per
digest, ``headers`` fills width, height and depth from a range read of the image header
alone, and ``features`` reads whole members back.

A shard is written under a name of its own task attempt and its rows are written as a
table once it is closed, so a retried task writes another shard and no row points to a
half-written one.

Edge cases: null text is empty; an empty payload is 64 zero bytes; equal texts share a
digest and so every value; of several places of a digest the least shard and offset counts; a
text of any length is one member; repeated rows stay; an empty table writes no shard; other
columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
import io
import struct
import tarfile
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import materialize, new_path

WIDTH = 64
SIGNATURE = b"\x89PNG\r\n\x1a\n"
HEADER = 33  # signature and IHDR chunk
ROWS = "doc_id long, n_bytes long, digest string, shard string, offset long, length long"
META = "digest string, shard string, offset long, length long, width int, height int, depth int"
FEATURES = META + ", payload_bytes long, payload_sha256 string, tail_crc32 long, media_sha256 string, feature string"


def padded(data: bytes) -> bytes:
    """``data`` and zero bytes up to a positive multiple of 64."""
    return data + bytes(-len(data) % WIDTH if data else WIDTH)


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def to_png(payload: bytes, level: int = 6) -> bytes:
    """An 8-bit grey image, 64 samples a line, unfiltered."""
    lines = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    raw = np.concatenate([np.zeros((len(lines), 1), np.uint8), lines], axis=1).tobytes()
    head = struct.pack(">IIBBBBB", WIDTH, len(lines), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(raw, level)) + _chunk(b"IEND", b"")


def png_header(head: bytes) -> tuple[int, int, int]:
    """(width, height, bit depth) from the first HEADER bytes."""
    if head[:8] != SIGNATURE or head[12:16] != b"IHDR":
        raise ValueError("not a PNG header")
    return struct.unpack(">IIB", head[16:25])


def from_png(image: bytes) -> bytes:
    """The samples of an image made by ``to_png``."""
    width, height, _ = png_header(image[:HEADER])
    at, packed = HEADER, []
    while at < len(image):
        size, kind = struct.unpack(">I4s", image[at : at + 8])
        if kind == b"IDAT":
            packed.append(image[at + 8 : at + 8 + size])
        at += 12 + size
    lines = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(height, width + 1)
    if lines[:, 0].any():
        raise ValueError("filtered lines")
    return lines[:, 1:].tobytes()


def _store(folder: str):
    """(Arrow file system, path in it) of a folder URI."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


def store(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """Write every text's payload into tar shards; one row of ROWS per document, as a table."""
    folder = folder or new_path(docs.sparkSession, "shards")

    def write(batches):
        system, root = _store(folder)
        name = f"shard-{uuid.uuid4().hex}.tar"
        sink = tar = None
        known: dict[bytes, tuple[str, int, int]] = {}
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = (text.as_py() or "").encode()
                key = hashlib.sha256(data).digest()
                if key not in known:
                    if tar is None:
                        system.create_dir(root, recursive=True)
                        sink = system.open_output_stream(f"{root}/{name}")
                        tar = tarfile.open(fileobj=sink, mode="w|", format=tarfile.USTAR_FORMAT, bufsize=1 << 20)
                    image = to_png(padded(data))
                    digest = hashlib.sha256(image).hexdigest()
                    member = tarfile.TarInfo(f"{digest}.png")
                    member.size = len(image)
                    offset = tar.offset + 512
                    tar.addfile(member, io.BytesIO(image))
                    known[key] = (digest, offset, len(image))
                digest, offset, length = known[key]
                out.append((doc_id, len(data), digest, name, offset, length))
            if out:
                columns = list(zip(*out))
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [f.split()[0] for f in ROWS.split(", ")])
        if tar is not None:
            tar.close()
            sink.close()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(write, ROWS)
    return materialize(rows, "media-rows").withColumn("shard", F.concat(F.lit(f"{folder}/"), "shard"))


def canonical(rows: DataFrame) -> DataFrame:
    """(digest, shard, offset, length): one location per digest, however many rows have it."""
    at = F.min(F.struct("shard", "offset", "length")).alias("at")
    return rows.groupBy("digest").agg(at).select("digest", "at.shard", "at.offset", "at.length")


def _ranges(batch, size=None):
    """(row, bytes) of range reads in shard order, one open file at a time."""
    shards, offsets, lengths = (batch.column(k).to_pylist() for k in (1, 2, 3))
    shard = source = None
    for i in sorted(range(len(shards)), key=lambda k: (shards[k], offsets[k])):
        if shards[i] != shard:
            if source is not None:
                source.close()
            shard = shards[i]
            folder, _, name = shard.rpartition("/")
            system, root = _store(folder)
            source = system.open_input_file(f"{root}/{name}")
        yield i, source.read_at(min(size or lengths[i], lengths[i]), offsets[i])
    if source is not None:
        source.close()


def headers(places: DataFrame) -> DataFrame:
    """META: width, height and depth of each place, from its first 33 bytes."""
    def read(batches):
        for batch in batches:
            found = [(0, 0, 0)] * batch.num_rows
            for i, head in _ranges(batch, HEADER):
                found[i] = png_header(head)
            more = [pa.array([x[k] for x in found], pa.int32()) for k in range(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], [f.split()[0] for f in META.split(", ")])

    return places.select("digest", "shard", "offset", "length").mapInArrow(read, META)


def feature_of(payload: bytes) -> str:
    """Mean, deviation and entropy of the samples and of their differences along a line."""
    counts = np.bincount(np.frombuffer(payload, np.uint8), minlength=256)
    share = counts[counts > 0] / len(payload)
    values = np.arange(256)
    mean = float((counts * values).sum() / len(payload))
    spread = float((counts * (values - mean) ** 2).sum() / len(payload)) ** 0.5
    entropy = float(-(share * np.log2(share)).sum())
    return f"mean={mean:.4f};std={spread:.4f};entropy={entropy:.4f};distinct={len(share)}"


def features(places: DataFrame) -> DataFrame:
    """FEATURES: digests and features of the payloads, read back from the shards."""
    def read(batches):
        for batch in batches:
            digests = batch.column(0).to_pylist()
            for lo in range(0, batch.num_rows, 256):  # bounds what is held at once
                part = batch.slice(lo, 256)
                found = [None] * part.num_rows
                for i, image in _ranges(part):
                    media = hashlib.sha256(image).hexdigest()
                    if media != digests[lo + i]:
                        raise ValueError(f"stored bytes of {digests[lo + i]} differ")
                    payload = from_png(image)
                    found[i] = (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), media, feature_of(payload))
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string())
                more = [pa.array([x[k] for x in found], t) for k, t in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([*part.columns, *more], [f.split()[0] for f in FEATURES.split(", ")])

    return places.mapInArrow(read, FEATURES)


def media_columns(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """Rows of ROWS with the metadata and features of their payload."""
    rows = store(docs, folder)
    places = canonical(rows).repartition("shard").sortWithinPartitions("shard", "offset")
    known = features(headers(places))
    return rows.join(known.drop("shard", "offset", "length"), "digest")
