"""Row counts and column statistics from the footers of Parquet files, through the reader that Spark itself brings."""

from __future__ import annotations

import datetime
import json

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import SparkSession
from pyspark.sql import types as T

_INTEGERS = ("tinyint", "smallint", "int", "bigint")
_EPOCH = datetime.datetime(1970, 1, 1)
LONGEST = 256


READERS = 16  # footers that are read at once


def opened(spark: SparkSession, paths: list[str]) -> list[tuple]:
    """(footer, schema as Spark reads it, size) of each file: a footer is read once, many at a time."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    converter = jvm.org.apache.spark.sql.execution.datasources.parquet.ParquetToSparkSchemaConverter(spark._jsparkSession.sessionState().conf())

    def one(path):
        file = jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(jvm.org.apache.hadoop.fs.Path(path), conf)
        reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(file)
        try:
            footer = reader.getFooter()
        finally:
            reader.close()
        told = footer.getFileMetaData().getKeyValueMetaData().get("org.apache.spark.sql.parquet.row.metadata")
        kind = told or converter.convert(footer.getFileMetaData().getSchema()).json()
        return footer, T.StructType.fromJson(json.loads(kind)), file.getLength()

    with ThreadPoolExecutor(READERS) as pool:
        return list(pool.map(one, paths))


def statistics(footer, kinds: dict[str, str]) -> tuple[int, dict[str, tuple]]:
    """(rows, {column: (nulls or None, min or None, max or None, may hold NaN)}) of the top-level columns in kinds.

    A bound that a writer left out, one of a long string, a NaN or one of an unknown encoding is None.
    """
    rows, out = 0, {}
    for block in footer.getBlocks():
        rows += block.getRowCount()
        for chunk in block.getColumns():
            name = chunk.getPath().toDotString()
            if name not in kinds:
                continue
            nulls, low, high = _bounds(chunk, kinds[name], block.getRowCount())
            nan = kinds[name] in ("float", "double")
            if name in out:
                n, a, b, _ = out[name]
                empty_old, empty_new = n is not None and n == rows - block.getRowCount(), nulls == block.getRowCount()
                low = a if empty_new else low if empty_old else None if a is None or low is None else min(a, low)
                high = b if empty_new else high if empty_old else None if b is None or high is None else max(b, high)
                nulls = None if n is None or nulls is None else n + nulls
            out[name] = (nulls, low, high, nan)
    return rows, out


def _bounds(chunk, kind: str, rows: int):
    stats = chunk.getStatistics()
    if stats is None or stats.isEmpty():
        return None, None, None
    nulls = stats.getNumNulls() if stats.isNumNullsSet() else None
    if not stats.hasNonNullValue():
        return nulls, None, None
    return nulls, *(_value(x, kind, chunk) for x in (stats.genericGetMin(), stats.genericGetMax()))


def _value(x, kind: str, chunk):
    if kind in _INTEGERS and isinstance(x, int) and not isinstance(x, bool):
        return x
    if kind == "boolean" and isinstance(x, bool):
        return x
    if kind in ("float", "double") and isinstance(x, float):
        return None if x != x else x
    if kind == "string" and hasattr(x, "toStringUsingUTF8"):
        text = x.toStringUsingUTF8()
        return text if len(text) <= LONGEST else None
    if kind == "date" and isinstance(x, int):
        return _EPOCH.date() + datetime.timedelta(days=x)
    if kind == "timestamp_ntz" and isinstance(x, int):
        unit = str(chunk.getPrimitiveType().getLogicalTypeAnnotation())
        scale = 1 if "MICROS" in unit else 1000 if "MILLIS" in unit else None
        return None if scale is None else _EPOCH + datetime.timedelta(microseconds=x * scale)
    return None
