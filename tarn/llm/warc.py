"""WARC archives with a two-level capture index.

Pages become WARC records, payloads seen before become revisits of their first capture; Spark's text sink writes the files
(records end in an empty line, which is what its line separator is set to), so any store that Spark reaches will do. The
capture index sorts the records' reversed-host keys into compressed blocks; a sparse directory holds one row per block. A
lookup searches the directory, reads the blocks it names and finds the lines in them by bisection; reading records then seeks
to those ranges of the files and reads nothing else. Archives must be where pyarrow can open files too (a shared folder, hdfs,
s3, gs): Spark itself has no reader of byte ranges.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.llm import common as C

DATE = "2024-01-01T00:00:00Z"
BLOCK_LINES = 2_000
DIRECTORY_BYTES = 64 << 20  # what a directory may take to be sent to all executors at once
FILE_RECORDS = 4_000
FILTER_BYTES = 16 << 20  # that the filter telling payloads that may repeat takes at most
HOT_SHARE = 500  # a payload that so great a part of the rows hold is hot; there are no more such payloads than this
READ_BYTES = 4 << 20  # that one read spans at most, if a single range is no longer
SCAN_BYTES = 1 << 20  # that indexing reads at once
GAP_BYTES = 16 << 10  # between ranges that one read spans
DEALT_URLS = 2_000  # asked of one index block in one row
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_END = b"\r\n\r\n"


def sha1_base32(text: Column) -> Column:
    """The upper-case base32 SHA-1 of a text's UTF-8: 8 times 20 bits of the hex form, 5 at a time."""
    twenty = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: F.conv(F.substring(F.sha1(text), k * 5 + 1, F.lit(5)), 16, 10).cast("int"))
    letter = lambda v, s: F.substring(F.lit(_BASE32), F.shiftright(v, s).bitwiseAND(31) + 1, F.lit(1))
    return F.array_join(F.transform(twenty, lambda v: F.concat(*(letter(v, s) for s in (15, 10, 5, 0)))), "")


def surt(url: str) -> str:
    """The key of a URL: host reversed, scheme, user and default port dropped; a text that is no URL is its own key."""
    try:
        parts = urlsplit(url)
        host, port = (parts.hostname or ""), parts.port
    except ValueError:
        return url
    if not host:
        return url
    key = ",".join(reversed(host.lower().split("."))) + (f":{port}" if port and port not in (80, 443) else "") + ")"
    return key + (parts.path or "/") + (f"?{parts.query}" if parts.query else "")


def _places(digests: list[bytes], size: int) -> np.ndarray:
    """Two places of each digest among the bits of a filter of so many bytes."""
    head = np.frombuffer(b"".join(x[:8] for x in digests), "<u4").reshape(-1, 2)
    return head % np.uint32(8 * size)


def _may_repeat(first: DataFrame, rows: int):
    """A function of a digest: false only for those not in first. The filter has 2 bytes a digest and FILTER_BYTES at most;
    when first outgrows that, more rows are taken for possible repeats and none is missed."""
    import pandas as pd

    size = min(FILTER_BYTES, max(1 << 16, 1 << (2 * rows).bit_length()))

    def collect(batches):
        from pyspark import TaskContext

        bits = np.zeros(8 * size, bool)
        for batch in batches:
            bits[_places(batch.column(0).to_pylist(), size).ravel()] = True
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() % 8]), pa.array([np.packbits(bits).tobytes()], pa.binary())], names=["g", "bits"])

    def merge(table: pa.Table) -> pa.Table:
        bits = np.zeros(size, np.uint8)
        for x in table["bits"].to_pylist():
            bits |= np.frombuffer(x, np.uint8)
        return pa.table([pa.array([bits.tobytes()], pa.binary())], names=["bits"])

    parts = first.select("digest").mapInArrow(collect, "g long, bits binary").groupBy("g").applyInArrow(merge, "bits binary").collect()
    bits = np.zeros(size, np.uint8)
    for (x,) in parts:
        bits |= np.frombuffer(x, np.uint8)
    sent = first.sparkSession.sparkContext.broadcast(bits)

    def held(digests):
        at = _places(digests.tolist(), size)
        return pd.Series(((sent.value[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).all(1).astype(bool))

    held.__annotations__ = {"digests": pd.Series, "return": pd.Series}
    return F.pandas_udf(held, "boolean")


def written_url(url: Column) -> Column:
    """A URL as archives hold it: control characters are blanks, null is empty."""
    return F.regexp_replace(F.coalesce(url, F.lit("")), r"[\x00-\x1F]", " ")


def write_archive(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0) -> None:
    """Write a record for each row of pages under path, as files that hold plain WARC 1.0.

    Of rows with equal payloads of at least min_bytes bytes, those with the smallest id are responses and others revisits
    that name it; a row without an id is a revisit if any row with its payload has one. A null payload is empty. Control
    characters in URLs are written as blanks; a null URL is an empty one. No rows give no records.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("id"), written_url(F.col(url_col)).alias("url"), F.coalesce(F.col(payload_col), F.lit("")).alias("payload"))
    C.bound_batches(pages.sparkSession)
    rows = rows.withColumn("digest", F.unhex(F.sha1("payload")))
    first = rows.where(F.octet_length("payload") >= min_bytes).groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1")
    first = C.materialise(first, "repeated")
    repeats, digests = first.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    # Most payloads occur once: a filter tells them, and only the others meet their first capture. Payloads that a great part of
    # the rows hold, HOT_SHARE at most, are sent to where those rows are; the rows of the rest are shuffled.
    is_hot = F.col("n") * HOT_SHARE > repeats
    hot, cold = (first.where(x).select("digest", F.lit(True).alias("seen"), "first") for x in (is_hot, ~is_hot))
    rows = rows.withColumn("maybe", _may_repeat(first, digests)(F.col("digest"))).join(F.broadcast(hot), "digest", "left")
    met = rows.where("maybe and seen is null").drop("seen", "first").join(cold, "digest", "left")
    rows = rows.where("not maybe or seen").unionByName(met)
    revisit = F.coalesce(F.col("seen"), F.lit(False)) & ~F.col("id").eqNullSafe(F.col("first"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length("payload").cast("string"), F.lit("\r\n\r\n"))
    block = F.concat(http, F.when(revisit, F.lit("")).otherwise(F.col("payload")))
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    record = F.concat(
        F.lit("WARC/1.0\r\n"),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", name(F.col("id"))),
        line("WARC-Target-URI", F.col("url")),
        line("WARC-Date", F.lit(DATE)),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), sha1_base32(F.col("payload")))),
        F.when(revisit, F.concat(line("WARC-Refers-To", name(F.col("first"))), line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.0/revisit/identical-payload-digest")))).otherwise(""),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit("\r\n"),
        block,
    )
    rows.select(record.alias("value")).write.option("lineSep", _END.decode()).option("maxRecordsPerFile", FILE_RECORDS).text(path)


def headers(raw: bytes) -> dict[str, str]:
    return {k.decode().lower(): v.decode() for k, _, v in (x.partition(b": ") for x in raw.split(b"\r\n")[1:])}


def records(content: bytes | memoryview, at: int = 0):
    """(offset, length, headers, body) of each record of a file from an offset on."""
    content = bytes(content)
    while at < len(content):
        end = content.index(_END, at)
        head = headers(content[at:end])
        size = int(head["content-length"])
        length = end - at + len(_END) + size + len(_END)
        yield at, length, head, memoryview(content)[end + 4 : end + 4 + size]
        at += length


def _opened(path: str):
    """A file to seek in, by its path as Spark names it."""
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem().open_input_file("/" + path[5:].lstrip("/"))
    store, name = fs.FileSystem.from_uri(path)
    return store.open_input_file(name)


def record_ranges(file, size: int):
    """(headers, offset, length) of each record of an open file; payloads of more than a read's bytes are skipped by seeking."""
    at, base, chunk = 0, 0, b""
    while at < size:
        end = chunk.find(_END, at - base) if at - base < len(chunk) else -1
        if end < 0:
            file.seek(at)
            base, chunk = at, file.read(SCAN_BYTES)
            while (end := chunk.find(_END)) < 0 and at + len(chunk) < size:
                chunk += file.read(SCAN_BYTES)
            if end < 0:
                raise ValueError(f"no end of a record's headers at {at}")
        head = headers(chunk[at - base : end])
        length = base + end - at + 2 * len(_END) + int(head["content-length"])
        yield head, at, length
        at += length


def build_index(spark: SparkSession, archive: str, path: str, block_lines: int = BLOCK_LINES) -> None:
    """Index the archive: path/blocks (part, nth, first, last, lines, data) sorted by key, path/directory without data."""

    def scan(batches):
        for batch in batches:
            for name, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with _opened(name) as file:
                    rows = [(surt(h["warc-target-uri"]), at, n) for h, at, n in record_ranges(file, size)]
                for i in range(0, len(rows), 20_000):
                    key, at, n = zip(*rows[i : i + 20_000], strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(key, pa.string()), pa.array([name] * len(key), pa.string()), pa.array(at, pa.int64()), pa.array(n, pa.int64())], names=["key", "file", "at", "length"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(archive).select("path", "length")
    lines = C.materialise(files.mapInArrow(scan, "key string, file string, at long, length long"), "captures")
    count = lines.count()
    ordered = lines.repartitionByRange(C.parts_for(count, 20 * block_lines), "key", "file", "at").sortWithinPartitions("key", "file", "at")

    def pack(batches):
        from pyspark import TaskContext

        part, nth, kept = TaskContext.get().partitionId(), 0, []

        def block(rows):
            nonlocal nth
            nth += 1
            text = "\n".join(f"{k.encode('unicode_escape').decode()}\t{f}\t{a}\t{n}" for k, f, a, n in rows)
            return pa.RecordBatch.from_arrays(
                [pa.array([part]), pa.array([nth]), pa.array([rows[0][0]], pa.string()), pa.array([rows[-1][0]], pa.string()), pa.array([len(rows)]), pa.array([zlib.compress(text.encode())], pa.binary())],
                names=["part", "nth", "first", "last", "lines", "data"],
            )

        for batch in batches:
            kept += zip(*(c.to_pylist() for c in batch.columns), strict=True)
            while len(kept) >= block_lines:
                yield block(kept[:block_lines])
                kept = kept[block_lines:]
        if kept:
            yield block(kept)

    ordered.mapInArrow(pack, "part long, nth long, first string, last string, lines long, data binary").write.parquet(f"{path}/blocks")
    blocks = spark.read.parquet(f"{path}/blocks")
    blocks.drop("data").write.parquet(f"{path}/directory")


_LINES = "key string, file string, at long, length long"


def _unpack(data: bytes) -> list[tuple[str, str, int, int]]:
    rows = (x.split("\t") for x in zlib.decompress(data).decode().split("\n"))
    return [(k.encode().decode("unicode_escape"), f, int(a), int(n)) for k, f, a, n in rows]


def captures(spark: SparkSession, index: str) -> DataFrame:
    """All lines of an index."""

    def unpack(batches):
        for batch in batches:
            for data in batch.column(0):
                key, file, at, n = zip(*_unpack(data.as_py()), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(key, pa.string()), pa.array(file, pa.string()), pa.array(at, pa.int64()), pa.array(n, pa.int64())], names=["key", "file", "at", "length"])

    return spark.read.parquet(f"{index}/blocks").select("data").mapInArrow(unpack, _LINES)


def lookup(index: str, urls: DataFrame, url_col: str = "url", directory_bytes: int = DIRECTORY_BYTES) -> DataFrame:
    """(url, key, file, at, length) of every capture of each URL's key. Null URLs and unknown ones give no row; a URL asked
    for several times is answered as often.

    The directory is sent to the executors in slices of at most directory_bytes; each is searched by bisection.
    """
    spark = urls.sparkSession
    directory = spark.read.parquet(f"{index}/directory")
    size = directory.agg(F.coalesce(F.sum(F.length("first") + F.length("last") + 160), F.lit(0))).first()[0]
    asked = urls.where(F.col(url_col).isNotNull()).select(F.col(url_col).cast("string").alias("url"))
    slices = C.parts_for(size, directory_bytes, least=1)
    found = None
    for k in range(slices):
        rows = directory.where(F.pmod(F.xxhash64("part", "nth"), F.lit(slices)) == k).orderBy("part", "nth").collect()
        firsts, lasts = np.array([r["first"].encode() for r in rows], object), np.array([r["last"].encode() for r in rows], object)
        sent = spark.sparkContext.broadcast((firsts, lasts, np.array([(r["part"], r["nth"]) for r in rows], np.int64).reshape(-1, 2)))

        def search(batches, sent=sent):
            firsts, lasts, names = sent.value
            for batch in batches:
                url = batch.column(0).to_pylist()
                key = [surt(u) for u in url]
                raw = np.array([x.encode() for x in key], object)
                a, b = np.searchsorted(lasts, raw, "left"), np.searchsorted(firsts, raw, "right")
                n = np.maximum(0, b - a)
                at, who = C.ranges(a, n), np.repeat(np.arange(len(url)), n)
                yield pa.RecordBatch.from_arrays([pa.array([url[w] for w in who], pa.string()), pa.array([key[w] for w in who], pa.string()), pa.array(names[at, 0]), pa.array(names[at, 1])], names=["url", "key", "part", "nth"])

        part = asked.mapInArrow(search, "url string, key string, part long, nth long")
        found = part if found is None else found.unionAll(part)
    blocks = spark.read.parquet(f"{index}/blocks").select("part", "nth", "data")
    wanted = found.groupBy("part", "nth", "key", "url").count()
    # A block goes with the URLs asked of it, DEALT_URLS or so in a row however many there are.
    loads = wanted.groupBy("part", "nth").agg(F.ceil(F.count("*") / DEALT_URLS).alias("rows"))
    dealt = wanted.join(loads, ["part", "nth"]).withColumn("row", F.pmod(F.xxhash64("url"), "rows"))
    dealt = dealt.groupBy("part", "nth", "row").agg(F.collect_list(F.struct("url", "key", "count")).alias("asked"))

    def lines(batches):
        import bisect

        for batch in batches:
            for asked, data in zip(batch.column(0), batch.column(1), strict=True):
                rows, out = _unpack(data.as_py()), []
                keys = [r[0].encode() for r in rows]
                for own in asked.as_py():
                    key = own["key"].encode()
                    out += [(own["url"], *r) for r in rows[bisect.bisect_left(keys, key) : bisect.bisect_right(keys, key)] for _ in range(own["count"])]
                c = list(zip(*out, strict=True)) or [[]] * 5
                yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.string()) for x in c[:3]), *(pa.array(x, pa.int64()) for x in c[3:])], names=["url", "key", "file", "at", "length"])

    return dealt.join(blocks, ["part", "nth"]).select("asked", "data").mapInArrow(lines, "url string, " + _LINES)


_READ = "url string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload string"


def _number(name: str | None) -> int | None:
    name = (name or "")[len("<urn:page:") : -1]
    return int(name) if name else None


def _row(head: dict, body: bytes, payload: bool) -> tuple:
    cut = body.index(_END)
    http, own = headers(body[:cut]), body[cut + 4 :]
    if head["warc-type"] == "response":
        digest, size, text = base64.b32encode(hashlib.sha1(own).digest()).decode(), len(own), own.decode() if payload else None
        if head["warc-payload-digest"] != "sha1:" + digest:
            raise ValueError(f"broken record {head['warc-record-id']}")
    else:
        digest, size, text = head["warc-payload-digest"][5:], int(http["content-length"]), None
    return head["warc-target-uri"], _number(head["warc-record-id"]), size, digest, head["warc-type"], _number(head.get("warc-refers-to")), text


def read_ranges(file, ranges: list[tuple[int, int]]):
    """The bytes of each range (start, length; in order of start) of an open file; ranges that are close to each other are
    read at once, READ_BYTES at most unless a single one is longer."""
    i = 0
    while i < len(ranges):
        start, size = ranges[i]
        end, j = start + size, i + 1
        while j < len(ranges) and ranges[j][0] <= end + GAP_BYTES and ranges[j][0] + ranges[j][1] <= start + READ_BYTES:
            end, j = max(end, ranges[j][0] + ranges[j][1]), j + 1
        file.seek(start)
        content = memoryview(file.read(end - start))
        for at, size in ranges[i:j]:
            yield content[at - start : at - start + size]
        i = j


def read_records(spark: SparkSession, lines: DataFrame, payload: bool = True) -> DataFrame:
    """The records at the lines' ranges (file, at, length): url, page_id, payload_bytes and payload_digest (of the full
    payload), record_type, refers_to, payload (null of revisits). A range named several times gives a record once.

    Ranges are dealt in order of file and place; a task opens each of its files once, seeks and reads the ranges. A file that
    is gone or a broken record is an error; no lines give no rows.
    """
    wanted = C.materialise(lines.select("file", "at", "length").distinct(), "ranges")
    size = wanted.agg(F.coalesce(F.sum(F.col("length") + 200), F.lit(0))).first()[0]
    dealt = wanted.repartitionByRange(C.parts_for(size, 16 << 20, least=1), "file", "at").sortWithinPartitions("file", "at")
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
    names = [x.split()[0] for x in _READ.split(", ")]

    def read(batches):
        for batch in batches:
            files, ats, sizes = (c.to_pylist() for c in batch.columns)
            i = 0
            while i < len(files):
                j = i
                while j < len(files) and files[j] == files[i]:
                    j += 1
                rows, held = [], 0
                with _opened(files[i]) as file:
                    for raw in read_ranges(file, list(zip(ats[i:j], sizes[i:j], strict=True))):
                        _, _, head, body = next(records(raw))
                        rows.append(_row(head, bytes(body), payload))
                        held += len(raw) if payload else 200
                        if held > C.ARROW_BYTES:
                            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                i = j

    return dealt.mapInArrow(read, _READ)
