"""Deletion vectors: Puffin files whose blobs are 64-bit Roaring bitmaps of deleted positions (public file formats)."""

from __future__ import annotations

import json
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tarn.errors import LakeError

# Fixed values of the formats: file magic, vector magic, and the two cookies of a portable 32-bit Roaring bitmap.
MAGIC = b"PFA1"
VECTOR_MAGIC = b"\xd1\xd3\x39\x64"
COOKIE_PLAIN, COOKIE_RUNS = 12346, 12347
ARRAY_LIMIT = 4096


def _roaring32(values: np.ndarray) -> bytes:
    high = values >> 16
    keys, starts = np.unique(high, return_index=True)
    parts = np.split((values & 0xFFFF).astype("<u2"), starts[1:])
    head = struct.pack("<II", COOKIE_PLAIN, len(keys)) + b"".join(struct.pack("<HH", int(k), len(p) - 1) for k, p in zip(keys, parts, strict=True))
    bodies = []
    for p in parts:
        if len(p) <= ARRAY_LIMIT:
            bodies.append(p.tobytes())
        else:
            bits = np.zeros(1 << 16, np.uint8)
            bits[p] = 1
            bodies.append(np.packbits(bits, bitorder="little").tobytes())
    at, offsets = len(head) + 4 * len(keys), []
    for b in bodies:
        offsets.append(at)
        at += len(b)
    return head + struct.pack(f"<{len(keys)}I", *offsets) + b"".join(bodies)


def _read_roaring32(data: bytes, at: int) -> tuple[np.ndarray, int]:
    (cookie,) = struct.unpack_from("<I", data, at)
    runs = b""
    if cookie & 0xFFFF == COOKIE_RUNS:
        n = (cookie >> 16) + 1
        runs = data[at + 4 : at + 4 + (n + 7) // 8]
        at += 4 + len(runs)
    elif cookie == COOKIE_PLAIN:
        (n,) = struct.unpack_from("<I", data, at + 4)
        at += 8
    else:
        raise LakeError("not a roaring bitmap")
    heads = [struct.unpack_from("<HH", data, at + 4 * k) for k in range(n)]
    at += 4 * n
    if not runs or n >= 4:
        at += 4 * n
    out = []
    for k, (key, size) in enumerate(heads):
        if runs and runs[k // 8] >> (k % 8) & 1:
            (count,) = struct.unpack_from("<H", data, at)
            pairs = np.frombuffer(data, "<u2", 2 * count, at + 2).astype(np.int64).reshape(-1, 2)
            low = np.concatenate([np.arange(a, a + b + 1) for a, b in pairs]) if count else np.zeros(0, np.int64)
            at += 2 + 4 * count
        elif size + 1 <= ARRAY_LIMIT:
            low = np.frombuffer(data, "<u2", size + 1, at).astype(np.int64)
            at += 2 * (size + 1)
        else:
            low = np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8, 8192, at), bitorder="little"))
            at += 8192
        out.append(low + (key << 16))
    return np.concatenate(out) if out else np.zeros(0, np.int64), at


def encode_vector(positions) -> bytes:
    """One deletion vector: length, magic, bitmap, checksum."""
    values = np.unique(np.asarray(positions, np.int64))
    keys = np.unique(values >> 32)
    body = VECTOR_MAGIC + struct.pack("<Q", len(keys))
    for k in keys:
        body += struct.pack("<I", int(k)) + _roaring32(values[values >> 32 == k] & 0xFFFFFFFF)
    return struct.pack(">I", len(body)) + body + struct.pack(">I", zlib.crc32(body))


def decode_vector(data: bytes) -> np.ndarray:
    """The positions of a deletion vector; a bare bitmap without frame is understood too."""
    if data[4:8] == VECTOR_MAGIC:
        (size,) = struct.unpack_from(">I", data)
        body = data[4 : 4 + size]
        if struct.unpack_from(">I", data, 4 + size)[0] != zlib.crc32(body):
            raise LakeError("a deletion vector's checksum does not match")
        data = body[4:]
    (n,) = struct.unpack_from("<Q", data)
    at, out = 8, []
    for _ in range(n):
        (key,) = struct.unpack_from("<I", data, at)
        values, at = _read_roaring32(data, at + 4)
        out.append(values + (key << 32))
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def pack(vectors) -> bytes:
    """A Puffin file of (file id, data file, positions)."""
    return packed([(file_id, path, encode_vector(positions), len(positions)) for file_id, path, positions in vectors])


def packed(vectors) -> bytes:
    """A Puffin file of (file id, data file, encoded vector, number of positions)."""
    out, at, blobs = [MAGIC], len(MAGIC), []
    for file_id, path, blob, n in vectors:
        properties = {"referenced-data-file": path, "cardinality": str(n), "file-id": str(file_id)}
        blobs.append({"type": "deletion-vector-v1", "fields": [], "snapshot-id": -1, "sequence-number": -1, "offset": at, "length": len(blob), "properties": properties})
        out.append(blob)
        at += len(blob)
    payload = json.dumps({"blobs": blobs}).encode()
    return b"".join([*out, MAGIC, payload, struct.pack("<I", len(payload)), b"\0\0\0\0", MAGIC])


def vectors_of(data: bytes):
    """(file id, positions as an array) of each vector of a Puffin file, one after the other."""
    if data[:4] != MAGIC or data[-4:] != MAGIC:
        raise LakeError("not a puffin file")
    (size,) = struct.unpack_from("<I", data, len(data) - 12)
    footer = json.loads(data[len(data) - 12 - size : len(data) - 12])
    for b in footer["blobs"]:
        yield int(b["properties"]["file-id"]), decode_vector(data[b["offset"] : b["offset"] + b["length"]])


def read(data: bytes) -> list[tuple[int, list[int]]]:
    """(file id, positions) of each vector of a Puffin file."""
    return [(file_id, at.tolist()) for file_id, at in vectors_of(data)]


def positions(spark: SparkSession, path: str) -> DataFrame:
    """(_file_id, _pos) of a Puffin file, decoded by an executor."""

    def run(batches):
        for batch in batches:
            for content in batch.column(0):
                for file_id, at in vectors_of(content.as_py()):
                    for i in range(0, len(at), 500_000):
                        part = at[i : i + 500_000]
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), file_id, np.int64)), pa.array(part)], names=["_file_id", "_pos"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "_file_id long, _pos long")


def vectors(positions: DataFrame) -> DataFrame:
    """(file_id, blob, n) of positions (file_id, pos): the encoded vector of each data file, made by the executors."""

    def run(table: pa.Table) -> pa.Table:
        at = np.unique(table["pos"].to_numpy())
        return pa.table([table["file_id"][:1].combine_chunks(), pa.array([encode_vector(at)], pa.binary()), pa.array([len(at)])], names=["file_id", "blob", "n"])

    return positions.groupBy("file_id").applyInArrow(run, "file_id long, blob binary, n long")
