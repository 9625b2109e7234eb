"""Partition transforms: identity, calendar parts, whole units since 1970, and buckets by 32-bit Murmur3."""

from __future__ import annotations

import re
import struct

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from tarn.errors import LakeError

CALENDAR = ("year", "month", "day", "hour")
EPOCH = ("epoch_year", "epoch_month", "epoch_day", "epoch_hour")
_M = 0xFFFFFFFF


def murmur3_bytes(data: bytes, seed: int = 0) -> int:
    """Murmur3 x86 32-bit of bytes, unsigned."""
    h = seed
    body = len(data) // 4 * 4

    def scrambled(k: int) -> int:
        k = k * 0xCC9E2D51 & _M
        return ((k << 15 | k >> 17) & _M) * 0x1B873593 & _M

    for (k,) in struct.iter_unpack("<I", data[:body]):
        h ^= scrambled(k)
        h = ((h << 13 | h >> 19) & _M) * 5 + 0xE6546B64 & _M
    if len(data) > body:
        h ^= scrambled(int.from_bytes(data[body:], "little"))
    h ^= len(data)
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        h = (h ^ h >> shift) * factor & _M
    return h ^ h >> 16


def murmur3_value(value, kind: str) -> int | None:
    """The hash of a Python value of a Spark type, as bucket() uses it."""
    if value is None:
        return None
    if kind in ("boolean", "tinyint", "smallint", "int", "bigint"):
        return murmur3_bytes(struct.pack("<q", int(value)))
    if kind in ("float", "double"):
        return murmur3_bytes(struct.pack("<d", float(value) + 0.0))
    return murmur3_bytes(value if isinstance(value, (bytes, bytearray)) else str(value).encode())


def murmur3_spans(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """murmur3_bytes of each span of a byte buffer (n + 1 offsets): four bytes of all spans a round."""
    start, size = offsets[:-1].astype(np.int64), np.diff(offsets).astype(np.int64)
    padded = np.zeros(len(data) + 4, np.uint8)
    padded[: len(data)] = data
    fours = np.ndarray(len(data) + 1, "<u4", padded, strides=(1,))
    h, full = np.zeros(len(size), np.uint32), size // 4
    turned = lambda x, n: (x << np.uint32(n)) | (x >> np.uint32(32 - n))
    mixed = lambda k: turned(k * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593)
    rows, k = np.flatnonzero(full > 0), 0
    while len(rows):
        h[rows] = turned(h[rows] ^ mixed(fours[start[rows] + 4 * k]), 13) * np.uint32(5) + np.uint32(0xE6546B64)
        k += 1
        rows = rows[full[rows] > k]
    rows = np.flatnonzero(size % 4)
    tail = fours[start[rows] + 4 * full[rows]] & ((np.uint32(1) << (8 * (size[rows] % 4)).astype(np.uint32)) - np.uint32(1))
    h[rows] ^= mixed(tail)
    h ^= size.astype(np.uint32)
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        h = (h ^ (h >> np.uint32(shift))) * np.uint32(factor)
    return (h ^ (h >> np.uint32(16))).view(np.int32)


def murmur3_32(column: Column, kind: str) -> Column:
    """The signed 32-bit hash of a column. Numbers stay in the JVM, floats by their bits; others are hashed by their text, a
    batch at a time over its byte buffer."""
    if kind in ("float", "double"):
        # Adding 0 makes -0.0 the same value as 0.0.
        bits = F.call_function("reflect", F.lit("java.lang.Double"), F.lit("doubleToLongBits"), F.coalesce(column.cast("double"), F.lit(0.0)) + F.lit(0.0)).cast("bigint")
        call = F.call_function("reflect", F.lit("org.apache.spark.unsafe.hash.Murmur3_x86_32"), F.lit("hashLong"), bits, F.lit(0))
        return F.when(column.isNotNull(), call.cast("int"))
    if kind in ("boolean", "tinyint", "smallint", "int", "bigint"):
        number = column.cast("int").cast("bigint") if kind == "boolean" else column.cast("bigint")
        call = F.call_function("reflect", F.lit("org.apache.spark.unsafe.hash.Murmur3_x86_32"), F.lit("hashLong"), F.coalesce(number, F.lit(0).cast("bigint")), F.lit(0))
        return F.when(column.isNotNull(), call.cast("int"))

    @F.pandas_udf("int")
    def hashed(values: pd.Series) -> pd.Series:
        raw = pa.array(values, pa.binary() if kind == "binary" else pa.string(), from_pandas=True).cast(pa.large_binary())
        found = pd.Series(murmur3_spans(*_buffers(raw)), dtype="Int32")
        return found.mask(values.isna().to_numpy())

    return hashed(column if kind in ("string", "binary") else column.cast("string"))


def _buffers(column) -> tuple[np.ndarray, np.ndarray]:
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), offsets


def parse(text: str) -> dict:
    """{transform, column, arg} of 'col', 'year(col)' or 'bucket(8, col)'."""
    text = text.strip()
    if m := re.fullmatch(r"bucket\s*\(\s*(\d+)\s*,\s*([\w.]+)\s*\)", text, re.I):
        n = int(m[1])
        if not 1 <= n < 1 << 31:
            raise LakeError("the number of buckets must be between 1 and 2147483647")
        return {"transform": "bucket", "column": m[2], "arg": n}
    if m := re.fullmatch(r"(\w+)\s*\(\s*([\w.]+)\s*\)", text):
        name = m[1].lower()
        if name not in (*CALENDAR, *EPOCH, "identity"):
            raise LakeError(f'unknown partition transform "{name}"')
        return {"transform": name, "column": m[2], "arg": None}
    if re.fullmatch(r"[\w.]+", text):
        return {"transform": "identity", "column": text, "arg": None}
    raise LakeError(f"not a partition expression: {text}")


def apply(transform: str, column: Column, kind: str, arg: int | None = None) -> Column:
    """The partition value of a column. Units since 1970 count boundaries, so they floor before 1970; zoned times count in UTC."""
    if transform == "identity":
        return column
    if transform == "bucket":
        return F.pmod(murmur3_32(column, kind).bitwiseAND(0x7FFFFFFF), F.lit(arg)).cast("bigint")
    if kind == "timestamp":
        column = F.to_utc_timestamp(column, F.current_timezone()).cast("timestamp_ntz")
    year, month = F.year(column).cast("bigint"), F.month(column).cast("bigint")
    days = F.datediff(F.to_date(column), F.lit("1970-01-01").cast("date")).cast("bigint")
    return {
        "year": year,
        "month": month,
        "day": F.dayofmonth(column).cast("bigint"),
        "hour": F.hour(column).cast("bigint") if transform.endswith("hour") else None,
        "epoch_year": year - 1970,
        "epoch_month": (year - 1970) * 12 + month - 1,
        "epoch_day": days,
        "epoch_hour": days * 24 + F.hour(column) if transform == "epoch_hour" else None,
    }[transform]


def key_names(spec: list[dict]) -> list[str]:
    """A directory name for each key: the transform's (the column's for identity), with the column on a clash, then numbers."""
    out: list[str] = []
    for key in spec:
        column = key["column"].replace(".", "_")
        name = column if key["transform"] == "identity" else key["transform"]
        if name in out:
            name = f"{name}_{column}"
        n, base = 2, name
        while name in out:
            name, n = f"{base}_{n}", n + 1
        out.append(name)
    return out
