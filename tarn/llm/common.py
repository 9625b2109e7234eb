"""What the operators share: the shared folder, byte buffers of text columns, hashing, components."""

from __future__ import annotations

import atexit
import ctypes
import functools
import hashlib
import shutil
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SLICE_BYTES = 2 << 20  # text that one numpy pass holds
ARROW_BYTES = 8 << 20  # text that one Arrow batch holds


@functools.cache
def _own_folder() -> str:
    path = tempfile.mkdtemp(prefix="tarn-shared-")
    atexit.register(shutil.rmtree, path, True)
    return path


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir; a temporary one only where that is unset (tests)."""
    return (spark.conf.get("spark.checkpoint.dir", None) or "file://" + _own_folder()).rstrip("/")


_RUN = uuid.uuid4().hex


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, in a folder of this driver that its JVM deletes when it ends."""
    folder = f"{shared_dir(spark)}/tarn/{_RUN}"
    _delete_at_end(spark.sparkContext.applicationId, folder, spark)
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def _delete_at_end(application: str, folder: str, spark: SparkSession) -> None:
    if (application, folder) not in _DELETED:
        _DELETED.add((application, folder))
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        store = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        store.mkdirs(path)
        store.deleteOnExit(path)


_DELETED: set[tuple[str, str]] = set()


def materialise(df: DataFrame, name: str, few: bool = True) -> DataFrame:
    """Write df as Parquet in the shared folder and read it again: cuts the lineage, survives lost executors.

    At most a file for FILE_BYTES of what df reads: where Hadoop has no native library, each file and folder made in a local
    store starts a process from the JVM (chmod), as which the JVM's memory shows once more for a moment. few: False where rows
    depend on the number of their partition, which those written by one task would share.
    """
    path = fresh_path(df.sparkSession, name)
    written = df.coalesce(parts_for(_bytes_read(df), FILE_BYTES, least=12)) if few else df
    written.write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


FILE_BYTES = 1 << 20


def _bytes_read(df: DataFrame) -> int:
    """The bytes of the tables that df is made of, as often as it reads them; very many where one's are unknown."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(int(str(leaves.apply(k).stats().sizeInBytes())) for k in range(leaves.size()))


def bound_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches that Python workers get by bytes, not only by rows."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


#: What a task leaves to the next ones of its worker, by name: the broadcast value it was made of, and itself.
_REMEMBERED: dict[str, tuple] = {}


def of_worker(name: str, value, make):
    """make(), once for all tasks of a worker that come with the same broadcast value. What other names had is dropped."""
    if _REMEMBERED.get(name, (None,))[0] is not value:
        tidy()
        _REMEMBERED[name] = (value, make())
    return _REMEMBERED[name][1]


_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", lambda _: None)


def tidy(keep: str | None = None) -> None:
    """Drop what this worker remembers under other names, and give freed memory back to the system: a worker lives on from one
    operator to the next, and shares its executor's room with the JVM and other workers."""
    for name in [x for x in _REMEMBERED if x != keep]:
        del _REMEMBERED[name]
    pa.default_memory_pool().release_unused()
    _TRIM(0)


def unused(df: DataFrame, name: str) -> str:
    """A name for a helper column that df has no column of."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def input_bytes(df: DataFrame) -> int:
    """About how many bytes df holds: Catalyst's estimate (file sizes at the leaves), or, where that is unknown or past a
    terabyte (rows from Python, products of joins), the bytes of its texts counted. Only sets partition counts."""
    n = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if n <= 1 << 40:
        return n
    texts = [F.coalesce(F.octet_length(F.col(f"`{c}`")), F.lit(0)) for c, kind in df.dtypes if kind in ("string", "binary")]
    return int(df.agg(F.sum(sum(texts, F.lit(8)))).first()[0] or 0)


def parts_for(n_bytes: int, each: int, least: int = 8, most: int = 1 << 20) -> int:
    return int(min(most, max(least, -(-n_bytes // each))))


def buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and n + 1 offsets of an Arrow string column; null reads as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    column = pc.fill_null(column, "").cast(pa.large_string())
    raw = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(raw[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(raw[2], np.uint8)[offsets[0] : offsets[-1]] if raw[2] is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES, rows: int = 20_000):
    """Ranges of at most `rows` rows whose bytes stay under limit (a longer single row is a range of its own)."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1
        j = min(max(j, i + 1), n, i + rows)
        yield i, j
        i = j


_ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


LONG = 256  # bytes of a span from which on it is handled by itself
_KEPT = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)  # masks of the first k of 8 bytes


def _eights(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place of data on as one number, zeros beyond its end; unaligned and without a copy for each."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans [start, end) of data: 8 bytes a round, each mixed into what came before; BLAKE2b of
    spans over LONG. They depend on nothing but the bytes. Two spans may clash by chance, so users compare the bytes or say
    what a clash does."""
    size = ends - starts
    view = _eights(data)
    out = mix(size.astype(np.uint64) * _ODD + np.uint64(1))
    at, left, h = starts, size, out
    rows = None  # all of them
    while len(at):
        go = left > 0
        if rows is None:
            go &= size <= LONG
        if not go.all():
            rows = np.flatnonzero(go) if rows is None else rows[go]
            at, left, h = at[go], left[go], h[go]
        if not len(at):
            break
        h = mix(h ^ (view[at] & _KEPT[np.minimum(left, 8)]))
        if rows is None:
            out = h
        else:
            out[rows] = h
        at, left = at + 8, left - 8
    for i in np.flatnonzero(size > LONG).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return out


def same_spans(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, other: np.ndarray, other_starts: np.ndarray, other_sizes: np.ndarray) -> np.ndarray:
    """Whether each span of data has the bytes of the span of other beside it."""
    same = sizes == other_sizes
    x, y = _eights(data), _eights(other)
    rows = np.flatnonzero(same & (sizes <= LONG))
    a, b, left = starts[rows], other_starts[rows], sizes[rows]
    while len(rows):
        kept = _KEPT[np.minimum(left, 8)]
        equal = (x[a] & kept) == (y[b] & kept)
        same[rows[~equal]] = False
        go = equal & (left > 8)
        rows, a, b, left = rows[go], a[go] + 8, b[go] + 8, left[go] - 8
    for i in np.flatnonzero(same & (sizes > LONG)).tolist():
        same[i] = np.array_equal(data[starts[i] : starts[i] + sizes[i]], other[other_starts[i] : other_starts[i] + sizes[i]])
    return same


class Memo:
    """An open-addressing table from 64-bit hashes to numbers, asked and filled a whole array at a time."""

    def __init__(self, bits: int):
        self.bits, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values, self.n = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int32), 0

    def find(self, h: np.ndarray) -> np.ndarray:
        """The number of each hash, -1 if it has none."""
        out = np.full(len(h), -1, np.int32)
        left, slot = np.arange(len(h)), (h >> self.bits).astype(np.int64)
        while len(left):
            key = self.keys[slot]
            hit = key == h[left]
            out[left[hit]] = self.values[slot[hit]]
            go = ~hit & (key != 0)
            left, slot = left[go], (slot[go] + 1) & self.mask
        return out

    def add(self, h: np.ndarray, values: np.ndarray) -> None:
        """h: distinct and new."""
        self.n += len(h)
        slot, left = (h >> self.bits).astype(np.int64), np.arange(len(h))
        while len(left):
            free = self.keys[slot[left]] == 0
            _, first = np.unique(slot[left[free]], return_index=True)
            won = left[free][first]
            self.keys[slot[won]], self.values[slot[won]] = h[won], values[won]
            rest = np.ones(len(h), bool)
            rest[won] = False
            left = left[rest[left]]
            slot[left] = (slot[left] + 1) & self.mask


class WordTable:
    """Numbers for words, up to 2 * limit of them remembered. Words are found by their hashes and told apart by their bytes."""

    def __init__(self, limit: int, hashes=span_hashes):
        self.limit, self.hashes = limit, hashes
        self.memo, self.size = Memo((2 * limit).bit_length()), 0
        self.bytes, self.used = np.zeros(1 << 16, np.uint8), 0
        self.starts, self.sizes = np.zeros(0, np.int64), np.zeros(0, np.int64)

    @property
    def full(self) -> bool:
        return self.memo.n > self.limit

    def number(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number of each span, and which spans stand first for the new numbers, in their order."""
        h = self.hashes(data, starts, ends) | np.uint64(1)
        sizes = ends - starts
        at = self.memo.find(h)
        hit = np.flatnonzero(at >= 0)
        odd = hit[~same_spans(data, starts[hit], sizes[hit], self.bytes, self.starts[at[hit]], self.sizes[at[hit]])]
        new = np.flatnonzero(at < 0)
        keys, first, back = np.unique(h[new], return_index=True, return_inverse=True)
        rep = new[first]
        at[new] = self.size + back
        clash = ~same_spans(data, starts[new], sizes[new], data, starts[rep][back], sizes[rep][back])
        odd = np.concatenate([odd, new[clash]])
        kept = min(len(keys), max(0, 2 * self.limit - self.memo.n))
        self.memo.add(keys[:kept], np.arange(self.size, self.size + kept, dtype=np.int32))
        self._keep(data, starts[rep[:kept]], sizes[rep[:kept]])
        self.size += len(keys)
        if len(odd):  # words whose hash another word has are numbered by their bytes, for this call only
            own: dict[bytes, int] = {}
            firsts = []
            for i in odd.tolist():
                word = data[starts[i] : ends[i]].tobytes()
                if word not in own:
                    own[word] = self.size + len(own)
                    firsts.append(i)
                at[i] = own[word]
            rep = np.append(rep, np.array(firsts, np.int64))
            self.size += len(own)
        return at, rep

    def _keep(self, data, starts, sizes) -> None:
        """Remember the bytes of the next numbers. Numbers not remembered get no place: none is ever found for them."""
        total = int(sizes.sum())
        if self.used + total > len(self.bytes):
            grown = np.zeros(2 * (self.used + total), np.uint8)
            grown[: self.used] = self.bytes[: self.used]
            self.bytes = grown
        self.bytes[self.used : self.used + total] = data[ranges(starts, sizes)]
        need = self.size + len(sizes)
        if need > len(self.starts):
            more = np.zeros(2 * need, np.int64)
            more[: len(self.starts)] = self.starts
            self.starts = more
            more = np.full(2 * need, -1, np.int64)
            more[: len(self.sizes)] = self.sizes
            self.sizes = more
        self.starts[self.size : need], self.sizes[self.size : need] = self.used + np.cumsum(sizes) - sizes, sizes
        self.used += total


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1 ... of each range, one after the other."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(counts)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - counts), counts)


HUBS = 500
ONE_TASK = 500_000  # edges: 16 MB


def join_skewed(rows: DataFrame, keyed: DataFrame, key: str, total: int) -> DataFrame:
    """rows joined with keyed, which has one row a key, n telling how many of the `total` rows have that key; without n.

    A key with more than 1 / HUBS of the rows would bring them into one task. There are HUBS such keys at most: they are sent to
    where the rows are. The rows of the other keys are shuffled.
    """
    hot, cold = (keyed.where(x).drop("n") for x in (F.col("n") * HUBS > total, F.col("n") * HUBS <= total))
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key)
    return rows.join(F.broadcast(hot), key).unionByName(rest)


def components_of(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of edges between a and b, sorted, and the smallest node that each reaches."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    comp = np.arange(len(nodes))
    while True:
        # Every root beside a smaller one goes to the smallest; two such rounds halve the roots at least.
        u, v, new = comp[x], comp[y], comp.copy()
        np.minimum.at(new, np.maximum(u, v), np.minimum(u, v))
        while not np.array_equal(up := new[new], new):
            new = up
        if np.array_equal(new, comp):
            return nodes, nodes[comp]
        comp = new


def _joined_up(batches):
    """Batches of all edges to (node, comp)."""
    every = [(x.column(0).to_numpy(), x.column(1).to_numpy()) for x in batches]
    if every:
        nodes, comp = components_of(*(np.concatenate(c) for c in zip(*every, strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(comp)], names=["node", "comp"])


def connected_components(edges: DataFrame, name: str, rounds: int = 60) -> DataFrame:
    """(node, comp) for every node of edges (a, b): comp is the smallest node reachable.

    Edges that one task can hold are joined by one, in numpy. More alternate large-star and small-star; each round is a written
    table, so no lineage grows and nothing is gathered. A round takes several shuffles, and each leaves the driver a thread for
    a minute, so small graphs are spared them.
    """
    now = materialise(
        edges.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).where("hi <> lo").distinct(), name
    )

    def state(df):
        return df.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(20,0)"))).first()

    seen = state(now)
    if 2 * seen[0] <= ONE_TASK:
        return materialise(now.coalesce(1).mapInArrow(_joined_up, "node long, comp long"), name)
    for _ in range(rounds):
        both = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionAll(now.select("lo", "hi"))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        large = join_skewed(both.where("v > u"), least, "u", 2 * seen[0])
        large = large.select(F.col("v").alias("hi"), F.col("m").alias("lo")).where("hi <> lo")
        low = large.groupBy("hi").agg(F.min("lo").alias("m"), F.count("*").alias("n"))
        small = join_skewed(large, low, "hi", 2 * seen[0])
        new = small.select(F.explode(F.array(F.struct("hi", F.col("m").alias("lo")), F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")))).alias("e"))
        now = materialise(new.select("e.hi", "e.lo").where("hi <> lo").distinct(), name)
        last, seen = seen, state(now)
        if last == seen:
            break
    else:
        raise RuntimeError("components did not settle")
    # At the fixed point every edge leads from a node straight to the smallest node of its component.
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("comp")).unionAll(now.select("lo", "lo").distinct())
