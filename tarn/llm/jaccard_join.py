"""N-gram Jaccard join: an exact metric-space join over word shingles.

d(x, y) = 1 - |x & y| / |x | y| is a metric, and two sets link when d is at most the radius r = 0.2. Pivots cut the space:

* Equal shingle sets are one *class*; everything below works on classes.
* Whatever the order of all shingles, partners share some of the first two fifths of each set (`_deal_leading` tells how
  many). In the order of their hashes, these meet by hash range as byte blocks; only classes that share enough there are gone
  on with. A mask of bits tells those classes to all tasks; some others pass it too.
* A shingle that only one class holds can't be in an intersection. Shingles of the classes left are dealt in the same way,
  counted, and only the shared ones return to their class, ranked rarest first. A class with fewer than 80 % shared shingles
  links with nothing. Shingles that very many documents hold are told beforehand (`_hot`); they go to their classes without
  meeting in one task. Partners share at least one of a class's leading (rarest) shingles, |x| - ceil(0.8 |x|) + 1 of them.
* *Rounds of pivots.* In the list of each leading shingle the most central class (the one whose shingles most classes hold)
  is a pivot. Each class goes to the region of its most central pivot not tried yet, and its exact distance from it is
  taken: within r the two link. Lists whose members are all in one component by now are done and drop out. A region is
  dealt to tasks in slices, its pivot being sent to each, so a region of any size is joined by many tasks.
* *Voronoi regions.* What the rounds leave apart falls into the connected parts of the lists still open; no link leaves one.
  A part that fits a task is joined there (`pivot_join`). A larger one gets pivots, the distances of all its members from all
  of them, and becomes a cell for each pivot: members nearest to it, and boundary members of other cells which the triangle
  inequality lets link to one of those (`cells_of`). Members too far from every pivot make up a cell of their own. Cells are
  joined recursively in the same way; cells which the inequality can't make smaller are joined by pairs of blocks.
* Inside a task, pivots are taken one after the other: distances to all members through an inverted index; members within r
  join its component; by the triangle inequality only members whose distance differs from that of a foreign component's
  member by at most r can link to it, and only members with such a partner become pivots.

Shingles are 64-bit hashes, made of 64-bit hashes of words; classes are 64-bit digests of sets. Two shingles of a pair of
documents that clash by chance would count as a common one; documents are told apart by all their shingles.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm import common as C

WORDS = 5
REGION_BYTES = 16 << 20  # of sets that a task joins
RANGE_BYTES = 9 << 20  # of shingles of one hash range
ROUNDS = 2  # of pivots before regions are cut
PIVOTS = 32  # of a region that is cut
CORE = 0.5  # a cell's own members are at most so far from its pivot
DEPTH = 6  # cuts of a region before its blocks are joined by pairs
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_PLACES = C.mix(np.arange(11, 11 + 64, dtype=np.uint64)) | np.uint64(1)


def shingles(data: np.ndarray, offsets: np.ndarray, words: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each document (UTF-8 bytes and n + 1 offsets)."""
    n, size = len(offsets) - 1, len(data)
    if not size:
        return [np.zeros(0, np.uint64)] * n
    data = _LOWER[data]
    space = _SPACE[data]
    first, last = np.empty(size, bool), np.empty(size, bool)
    first[0] = last[-1] = True
    first[1:], last[:-1] = space[:-1], space[1:]
    first[offsets[:-1][offsets[:-1] < size]] = True
    last[offsets[1:][offsets[1:] > 0] - 1] = True
    starts, ends = np.flatnonzero(~space & first), np.flatnonzero(~space & last) + 1
    if not len(starts):
        return [np.zeros(0, np.uint64)] * n
    word = C.span_hashes(data, starts, ends)
    bounds = np.searchsorted(starts, offsets)
    counts = np.diff(bounds)
    runs = max(0, len(word) - words + 1)
    grams = np.zeros(runs, np.uint64)
    for k in range(words):
        grams += word[k : k + runs] * _PLACES[k]
    grams = C.mix(grams)
    out = []
    for i in range(n):
        a, c = int(bounds[i]), int(counts[i])
        if c >= words:
            x = np.sort(grams[a : a + c - words + 1])
            if len(x) > 1:
                x = x[np.concatenate(([True], x[1:] != x[:-1]))]
            out.append(x)
        elif c:
            out.append(C.mix(np.array([(word[a : a + c] * _PLACES[words : words + c]).sum() + np.uint64(c)], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def set_keys(sets: list[np.ndarray]) -> np.ndarray:
    """A 64-bit digest of each set as int64, 0 for the empty one."""
    out = np.zeros(len(sets), np.uint64)
    for i, x in enumerate(sets):
        if len(x):
            out[i] = C.mix(x ^ np.uint64(0x5851F42D4C957F2D)).sum() + np.uint64(len(x))
    keys = C.mix(out)
    keys[[len(x) == 0 for x in sets]] = 0
    return keys.view(np.int64)


HOT_PART, HOT_ROWS, HOT_LEAST = 0.02, 4_000_000, 20
HOT_MOST = 4_000_000  # shingles that are sent to all executors: 32 MB
SALTS = 16
SAMPLED = 2_000


def _hot(docs: DataFrame, words: int) -> np.ndarray:
    """Shingles that are held by a great part of docs (text): by HOT_PART of them, or by HOT_ROWS where that is less.

    Told by a sample, a forty-thousandth of large tables: only how entries travel depends on it, never what links. Of more than
    HOT_MOST the most frequent ones. A task counts SAMPLED rows and tells those that come up a quarter as often as hot ones would.
    """
    rows = max(1, docs.count())
    part = min(HOT_PART, HOT_ROWS / rows)
    taken = min(1.0, 100 / part / rows)

    def run(batches):
        values, n, seen = np.zeros(0, np.uint64), np.zeros(0, np.int64), 0
        for batch in batches:
            data, offsets = C.buffers(batch.column(0))
            for i, j in C.slices(offsets):
                more, times = np.unique(np.concatenate(shingles(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], words)), return_counts=True)
                values, back = np.unique(np.concatenate([values, more]), return_inverse=True)
                n, seen = np.bincount(back, np.concatenate([n, times]), len(values)).astype(np.int64), seen + j - i
        told = n >= part * seen / 4
        C.tidy()
        yield pa.RecordBatch.from_arrays([pa.array(values[told].view(np.int64)), pa.array(n[told])], names=["s", "n"])

    sample = docs.sample(taken, seed=7).select("text").repartition(C.parts_for(int(taken * rows), SAMPLED, least=1))
    counted = sample.mapInArrow(run, "s long, n long").groupBy("s").agg(F.sum("n").alias("n"))
    found = counted.where(F.col("n") >= max(HOT_LEAST, part * taken * rows)).orderBy(F.desc("n"), "s").limit(HOT_MOST).select("s").toArrow()
    return np.sort(found["s"].to_numpy().astype(np.int64).view(np.uint64))


def _labels_of_partitions(spark, n: int) -> np.ndarray:
    """A number for each of n partitions which Spark's hash deals to that one, so that n groups go to n tasks, one each."""
    tried = int(n * (np.log(n) + 12))
    found = spark.range(tried).groupBy(F.pmod(F.hash("id"), F.lit(n)).alias("p")).agg(F.min("id").alias("id")).toArrow()
    out = np.arange(tried, tried + n)
    out[found["p"].to_numpy()] = found["id"].to_numpy()
    return out


_HOT = -(1 << 60)  # groups from here up, to 0, hold hot shingles by range of classes and salt; groups further below hold rows' ids
_DEALT = "grp long, keys binary, sizes binary, counts binary, values binary"
GATHERED = 1 << 20  # shingles of a task's texts that are cut into blocks together


def _classes_of(batches, words: int, take):
    """Text batches (the text last, ids before it) to parts: (ids, keys, sizes) of all their rows, and by key the shingles that
    take(keys, sets) tells of a slice's classes, about GATHERED of a part."""
    told, held, n = [], {}, 0
    for batch in batches:
        data, offsets = C.buffers(batch.column(batch.num_columns - 1))
        ids = batch.column(0).to_pylist() if batch.num_columns > 1 else None
        for i, j in C.slices(offsets):
            sets = shingles(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], words)
            keys, sizes = set_keys(sets), np.array([len(x) for x in sets], np.uint32)
            told.append((ids and ids[i:j], keys, sizes))
            _, own = np.unique(keys, return_index=True)
            own = [k for k in own[sizes[own] > 0].tolist() if int(keys[k]) not in held]
            if own:
                for key, x in take(keys[own], [sets[k] for k in own]):
                    held[key] = x
                    n += len(x)
            if n >= GATHERED:
                yield told, held
                told, held, n = [], {}, 0
    if told:
        yield told, held
    C.tidy()


def _tag(told) -> int:
    """A number for a part, told by what is in it."""
    at = sum(int(keys.view(np.uint64).sum()) + len(keys) for _, keys, _ in told) % (1 << 64)
    return int(C.mix(np.array([at], np.uint64))[0] >> np.uint64(24))


def _cut(bucket: np.ndarray, of: np.ndarray, x: np.ndarray, keys: np.ndarray, sizes: np.ndarray | None) -> list[tuple]:
    """Blocks (grp, keys, sizes, counts, values), one for each bucket of the shingles x, which belong to keys[of], in of's order."""
    order = np.argsort(bucket, kind="stable")
    x, of, bucket = x[order], of[order], bucket[order]
    cuts = np.concatenate(([0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)])) if len(x) else np.zeros(1, np.int64)
    rows = []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        run_of = np.concatenate(([0], np.flatnonzero(np.diff(of[a:b])) + 1))
        who, count = of[a:b][run_of], np.diff(np.append(run_of, b - a)).astype(np.uint32)
        rows.append((int(bucket[a]), keys[who].tobytes(), b"" if sizes is None else sizes[who].tobytes(), count.tobytes(), x[a:b].tobytes()))
    return rows


def _is_hot(every: np.ndarray, hot: np.ndarray) -> np.ndarray:
    if not len(hot):
        return np.zeros(len(every), bool)
    return hot[np.minimum(np.searchsorted(hot, every), len(hot) - 1)] == every




def _more(sizes: np.ndarray, share: int) -> np.ndarray:
    """By how much the shingles that lead a set are more than would do for one common one, and one."""
    return np.maximum(1, (100 - share) * sizes // 100)


_LED = "grp long, ids array<long>, keys binary, sizes binary, counts binary, values binary"


def _deal_leading(bits: int, words: int, share: int, hot, labels):
    """(id, text) batches to a block with the rows' ids, keys and sizes, and one for each range of hashes with the shingles that
    lead the classes' sets when hot ones come last and the others go by their hashes, and a block with each class's number of
    leading hot ones, which others surely hold, less what it needs.

    Of partners x, y with m >= max(least(x), least(y)) common shingles, least(x) = ceil(0.8 |x|), the i-th common one stands at
    most at |x| - m + i in x and |y| - m + i in y. So the first min(more(x), more(y)) are among the |x| - least(x) + more(x)
    leading ones of x and those of y. As |y| >= least(x), a class that has a partner shares more(least(x)) of its leading ones at
    least. Ranges go by the low bits, as the leading ones are those with low high bits.
    """
    names = ["grp", "ids", "keys", "sizes", "counts", "values"]
    kinds = [pa.int64(), pa.list_(pa.int64()), *[pa.binary()] * 4]

    def run(batches):
        bases: list[tuple[np.ndarray, np.ndarray]] = []

        def take(keys, sets):
            sizes = np.array([len(x) for x in sets], np.int64)
            every, of = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
            last = _is_hot(every, hot.value)
            if last.any():
                order = np.argsort(2 * of + last, kind="stable")
                every, last = every[order], last[order]
            least = -(-share * sizes // 100)
            at = C.ranges(np.cumsum(sizes) - sizes, np.minimum(sizes, sizes - least + _more(sizes, share)))
            x, of, last = every[at], of[at], last[at]
            bases.append((keys, np.bincount(of[last], minlength=len(sets)) - _more(least, share)))
            x, n = x[~last], np.bincount(of[~last], minlength=len(sets))
            return zip(keys.tolist(), np.split(x, np.cumsum(n)[:-1]), strict=True)

        for told, held in _classes_of(batches, words, take):
            tag = _HOT - 1 - _tag(told)
            rows = [(tag, ids, keys.tobytes(), sizes.tobytes(), b"", b"") for ids, keys, sizes in told]
            if bases:
                k, n = (np.concatenate(c) for c in zip(*bases, strict=True))
                rows.append((tag, None, k.tobytes(), b"", n.astype(np.int64).tobytes(), b""))
            bases.clear()
            if held:
                x, of = np.concatenate(list(held.values())), np.repeat(np.arange(len(held), dtype=np.int32), [len(x) for x in held.values()])
                bucket = labels.value[(x & np.uint64((1 << bits) - 1)).astype(np.int64)]
                rows += [(r[0], None, *r[1:]) for r in _cut(bucket, of, x, np.array(list(held), np.int64), None)]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return run


_MET = "ids array<long>, keys array<long>, sizes array<long>, key long, n long, told boolean"


def _met(table: pa.Table) -> pa.Table:
    """One range of leading shingles: by class how many of them other classes lead with too. Ids, and the classes' numbers less
    what they need, pass."""
    kinds = [pa.list_(pa.int64())] * 3 + [pa.int64()] * 2
    names = ["ids", "keys", "sizes", "key", "n", "told"]
    arrays: list[list] = [[], [], []]
    if table["grp"][0].as_py() < _HOT:
        told, base = table.filter(table["ids"].is_valid()), table.filter(table["ids"].is_null())
        found, times = _joined(base["keys"], np.int64), _joined(base["counts"], np.int64)
        arrays = [told["ids"].to_pylist(), *([np.frombuffer(x, k).tolist() for x in told[n].to_pylist()] for n, k in (("keys", np.int64), ("sizes", np.uint32)))]
    else:
        keys, counts, x = _joined(table["keys"], np.int64), _joined(table["counts"], np.uint32), _joined(table["values"], np.uint64)
        of = np.repeat(keys, counts)
        order = np.lexsort((of, x))
        of, x = of[order], x[order]
        first = np.concatenate(([True], (x[1:] != x[:-1]) | (of[1:] != of[:-1])))  # of copies in several parts
        of, x = of[first], x[first]
        beside = x[1:] == x[:-1]
        found, times = np.unique(of[np.concatenate(([False], beside)) | np.concatenate((beside, [False]))], return_counts=True)
    n, m = len(arrays[0]), len(found)
    none = [None] * n
    return pa.table([*(pa.array([*v, *[None] * m], k) for v, k in zip(arrays, kinds, strict=False)), *(pa.array([*none, *v.tolist()], pa.int64()) for v in (found, times)), pa.array([table["grp"][0].as_py() < _HOT] * (n + m), pa.bool_())], names=names)


MASK_BITS = 1 << 28  # at most, of keys that are sent to all executors: 32 MB


def _mask(met: DataFrame, rows: int) -> np.ndarray:
    """A bit for the low bits of each key told: 16 bits a row, as far as MASK_BITS go. Keys that share a bit only mean more work."""
    bits = min(MASK_BITS, 1 << max(16, (16 * rows).bit_length()))
    n = met.where("key is not null").groupBy("key").agg(F.expr("coalesce(sum(n) filter (where not told), 0)").alias("n"), F.expr("max(n) filter (where told)").alias("base"))
    at = n.where("n + base >= 0").select(F.expr(f"key & {bits - 1}L").alias("at"))
    found = at.groupBy(F.expr("shiftright(at, 6)").alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(at & 63 as int)))").alias("b")).toArrow()
    out = np.zeros(bits // 64, np.uint64)
    out[found["w"].to_numpy()] = found["b"].to_numpy().astype(np.int64).view(np.uint64)
    return out


def _in_mask(keys: np.ndarray, mask: np.ndarray) -> np.ndarray:
    at = keys.view(np.uint64) & np.uint64(64 * len(mask) - 1)
    return (mask[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)


def _held(mask):
    """(keys, sizes) to the number of shingles of rows in the mask."""

    def run(batches):
        for batch in batches:
            keys, sizes = (np.asarray(batch.column(k).flatten().to_numpy(), np.int64) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array([int(sizes[_in_mask(keys, mask.value)].sum())], pa.int64())], names=["n"])

    return run


def _deal(bits: int, words: int, hot, labels, mask):
    """Text batches to blocks of the classes in the mask: one for each hash range with their shingles, and one for each range of
    classes with their hot ones."""
    shift = np.uint64(64 - bits)

    def run(batches):
        def take(keys, sets):
            at = np.flatnonzero(_in_mask(keys, mask.value))
            return [(int(keys[k]), sets[k]) for k in at]

        for told, held in _classes_of(batches, words, take):
            if not held:
                continue
            keys, sets = np.array(list(held), np.int64), list(held.values())
            sizes = np.array([len(x) for x in sets], np.uint32)
            every, of = np.concatenate(sets), np.repeat(np.arange(len(keys), dtype=np.int32), sizes)
            bucket = labels.value[(every >> shift).astype(np.int64)]
            last = _is_hot(every, hot.value)
            if last.any():
                to = (keys.view(np.uint64) % np.uint64(1 << bits)).astype(np.int64)
                bucket = np.where(last, _HOT + to[of] * SALTS + _tag(told) % SALTS, bucket)
            c = list(zip(*_cut(bucket, of, every, keys, sizes), strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.int64()), *(pa.array(x, pa.binary()) for x in c[1:])], names=["grp", "keys", "sizes", "counts", "values"])

    return run


def _joined(column, kind) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind)


_SHARED = "grp long, keys binary, sizes binary, counts binary, values binary, dfs binary"
_STEPS = 16  # parts of a hash range that are counted one after the other, so that little stands in memory at once


def _counted(x: np.ndarray, of: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The values that stand for two classes at least, whose they are, and how many hold each (65,535 stands for more)."""
    found = []
    step = (x >> np.uint64(64 - bits - 4)) & np.uint64(_STEPS - 1)
    for k in range(_STEPS):
        at = np.flatnonzero(step == k)
        at = at[np.argsort(x[at], kind="stable")]
        y = x[at]
        run_at = np.flatnonzero(np.concatenate(([True], y[1:] != y[:-1]))) if len(y) else np.zeros(0, np.int64)
        df = np.diff(np.append(run_at, len(y)))
        df = np.repeat(np.minimum(df, 65535).astype(np.uint16), df)
        keep = df >= 2
        found.append((y[keep], of[at[keep]], df[keep]))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def _shared(bits: int, labels):
    """One hash range: keep the shingles that at least two classes hold, with their frequency, by range of classes."""
    names = ["grp", "keys", "sizes", "counts", "values", "dfs"]
    kinds = [pa.int64(), *[pa.binary()] * 5]

    def run(table: pa.Table) -> pa.Table:
        grp = table["grp"][0].as_py()
        keys, sizes, counts = _joined(table["keys"], np.int64), _joined(table["sizes"], np.uint32), _joined(table["counts"], np.uint32)
        x = _joined(table["values"], np.uint64)
        own = np.sort(np.unique(keys, return_index=True)[1])
        if grp < 0:  # hot shingles: each class's once
            starts = np.cumsum(counts, dtype=np.int64) - counts
            x = x[C.ranges(starts[own], counts[own].astype(np.int64))]
            row = [int(labels.value[(grp - _HOT) // SALTS]), keys[own].tobytes(), sizes[own].tobytes(), counts[own].tobytes(), x.tobytes(), np.full(len(x), 65535, np.uint16).tobytes()]
            return pa.table([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=names)
        if len(own) < len(keys):  # copies in other slices
            starts = np.cumsum(counts, dtype=np.int64) - counts
            x = x[C.ranges(starts[own], counts[own].astype(np.int64))]
        x, of, df = _counted(x, np.repeat(np.arange(len(own), dtype=np.int32), counts[own]), bits)
        if not len(x):
            return pa.table([pa.array([], k) for k in kinds], names=names)
        order = np.argsort(of, kind="stable")
        x, of, df = x[order], of[order], df[order]
        starts = np.concatenate(([0], np.flatnonzero(of[1:] != of[:-1]) + 1))
        who, count = own[of[starts]], np.diff(np.append(starts, len(of))).astype(np.uint32)
        to = labels.value[(keys[who].view(np.uint64) % np.uint64(len(labels.value))).astype(np.int64)]
        rows = []
        order = np.argsort(to, kind="stable")
        cuts = np.concatenate(([0], np.flatnonzero(np.diff(to[order])) + 1, [len(order)]))
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            k = order[a:b]
            at = C.ranges(starts[k], count[k].astype(np.int64))
            rows.append((int(to[k[0]]), keys[who[k]].tobytes(), sizes[who[k]].tobytes(), count[k].tobytes(), x[at].tobytes(), df[at].tobytes()))
        c = list(zip(*rows, strict=True))
        return pa.table([pa.array(v, k) for v, k in zip(c, kinds, strict=True)], names=names)

    return run


_CLASSES = "key long, size long, weight long, marks binary"


def _assembled(share: int):
    """One range of classes: the classes that may link, each with its shared shingles, rarest first, and their mean frequency."""

    def run(table: pa.Table) -> pa.Table:
        keys, sizes, counts, values, dfs = (_joined(table[n], k) for n, k in (("keys", np.int64), ("sizes", np.uint32), ("counts", np.uint32), ("values", np.uint64), ("dfs", np.uint16)))
        starts = np.cumsum(counts, dtype=np.int64) - counts
        order = np.argsort(keys, kind="stable")
        cuts = np.concatenate(([0], np.flatnonzero(np.diff(keys[order])) + 1, [len(order)]))
        shared = np.add.reduceat(counts[order].astype(np.int64), cuts[:-1])
        size = sizes[order[cuts[:-1]]].astype(np.int64)
        out = []
        for k in np.flatnonzero(100 * shared >= share * size):
            own = order[cuts[k] : cuts[k + 1]]
            at = C.ranges(starts[own], counts[own].astype(np.int64))
            x, df = values[at], dfs[at]
            order_of = np.lexsort((x, df))
            x, df = x[order_of], df[order_of]
            first = np.concatenate(([True], x[1:] != x[:-1]))  # hot ones come from several salts
            if 100 * int(first.sum()) >= share * size[k]:
                out.append((int(keys[own[0]]), int(size[k]), int(1000 * df[first].sum(dtype=np.int64) // size[k]), x[first].tobytes()))
        c = list(zip(*out, strict=True)) or [[], [], [], []]
        return pa.table([pa.array(v, k) for v, k in zip(c, [*[pa.int64()] * 3, pa.binary()], strict=True)], names=["key", "size", "weight", "marks"])

    return run


def _leading(share: int):
    """(s, key, weight) of the leading shingles of each class: the rarest of its set, as many as any partner must meet."""

    def run(batches):
        for batch in batches:
            keys, weights, out, who = batch.column(0).to_numpy(), batch.column(3).to_numpy(), [], []
            for i, (size, blob) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                marks = np.frombuffer(blob, np.uint64)
                n = size - -(-share * size // 100) + 1 - (size - len(marks))
                out.append(marks[:n])
                who.append(np.full(len(out[-1]), i))
            if out:
                at = np.concatenate(who)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out).view(np.int64)), pa.array(keys[at]), pa.array(weights[at])], names=["s", "key", "weight"])

    return run


def pivot_join(sets: list[np.ndarray], sizes: np.ndarray, share: int, component: np.ndarray | None = None) -> np.ndarray:
    """Components (as smallest positions) of sets under 100 * |x & y| >= share * |x | y|, found through pivots.

    sets hold shared members only, sizes the whole sizes. component: links known so far. Exact: a pair is left out only if
    both are in one component or a pivot's distances prove that it is too far apart.
    """
    n = len(sets)
    comp = np.arange(n) if component is None else component.copy()
    if n < 2:
        return comp
    every = np.concatenate(sets)
    of = np.repeat(np.arange(n, dtype=np.int64), [len(x) for x in sets])
    values, place = np.unique(every, return_inverse=True)
    order = np.argsort(place, kind="stable")
    posting = of[order]
    starts = np.searchsorted(place[order], np.arange(len(values) + 1))
    own = np.concatenate(([0], np.cumsum([len(x) for x in sets])))
    radius = 1 - share / 100 + 1e-9
    known: list[np.ndarray] = []
    for p in np.argsort(-sizes, kind="stable"):
        foreign = comp != comp[p]
        if not foreign.any():
            if not (comp != comp[0]).any():
                break
            continue
        for d in known:  # the triangle inequality
            foreign &= np.abs(d - d[p]) <= radius
            if not foreign.any():
                break
        if not foreign.any():
            continue
        v = place[own[p] : own[p + 1]]
        both = np.bincount(posting[C.ranges(starts[v], starts[v + 1] - starts[v])], minlength=n)
        union = sizes + sizes[p] - both
        near = np.flatnonzero(100 * both >= share * union)
        labels = np.unique(comp[near])
        if len(labels) > 1:
            comp[np.isin(comp, labels)] = labels[0]
        if len(known) < 16:
            known.append(1 - both / union)
    return comp


_LINKS = "a long, b long"


def _overlaps(sets: list[np.ndarray], pivots: list[np.ndarray]) -> np.ndarray:
    """|x & p| for each set x (row) and pivot p (column)."""
    values, place = np.unique(np.concatenate(pivots), return_inverse=True)
    holder = np.repeat(np.arange(len(pivots)), [len(p) for p in pivots])
    order = np.argsort(place, kind="stable")
    holder, starts = holder[order], np.searchsorted(place[order], np.arange(len(values) + 1))
    out = np.zeros((len(sets), len(pivots)), np.int64)
    for i, x in enumerate(sets):
        at = np.searchsorted(values, x)
        at[at == len(values)] = 0
        at = at[values[at] == x] if len(values) else at[:0]
        out[i] = np.bincount(holder[C.ranges(starts[at], starts[at + 1] - starts[at])], minlength=len(pivots))
    return out


def _sets(table: pa.Table) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint64) for x in table["marks"].to_pylist()]


def _pivot_links(share: int):
    """Members and the pivots of their regions (rows whose key is the pivot): links between them."""

    def run(table: pa.Table) -> pa.Table:
        key, pivot, size, sets = table["key"].to_numpy(), table["pivot"].to_numpy(), table["size"].to_numpy(), _sets(table)
        a, b = [], []
        order = np.argsort(pivot, kind="stable")
        for at in np.split(order, np.flatnonzero(np.diff(pivot[order])) + 1):
            own = at[key[at] == pivot[at]][:1]
            rest = at[key[at] != pivot[at]]
            both = _overlaps([sets[i] for i in rest], [sets[own[0]]])[:, 0]
            near = rest[100 * both >= share * (size[rest] + size[own[0]] - both)]
            a.append(key[near])
            b.append(pivot[near])
        return pa.table([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

    return run


def _in_regions(share: int):
    """Whole regions, several in a group: links between the components known so far, enough to join those that are one."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by([("region", "ascending"), ("key", "ascending")])
        region, known, size, sets = table["region"].to_numpy(), table["comp"].to_numpy(), table["size"].to_numpy(), _sets(table)
        cuts = np.concatenate(([0], np.flatnonzero(np.diff(region)) + 1, [len(region)]))
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            _, first, label = np.unique(known[i:j], return_index=True, return_inverse=True)
            found = pivot_join(sets[i:j], size[i:j], share, first[label])
            at = first[found[first] != first]
            a.append(known[i:j][at])
            b.append(known[i:j][found[at]])
        return pa.table([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

    return run


_CELLS = "cell long, key long, size long, comp long, marks binary, a long, b long"


def cells_of(both: np.ndarray, sizes: np.ndarray, pivot_sizes: np.ndarray, share: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the overlaps of sets (rows) with pivots (columns): which link, in which pivots' cells each set belongs, and which
    sets are far from all pivots.

    With r = 1 - share / 100 and d(x, p) the distance from a pivot, x is at home with its nearest pivot h if d(x, h) <= CORE. For
    a link o, x with o at home in p: d(x, p) <= d(o, p) + r <= CORE + r, and, p being nearest to o, d(o, p) <= d(x, h) + r; so
    x belongs in p's cell too where d(x, p) <= min(d(x, h) + 2 r, CORE + r). A link between two sets far from all pivots stays
    among those.
    """
    union = sizes[:, None] + pivot_sizes[None, :] - both
    far = 1 - both / union
    home = far.min(1)
    r = 1 - share / 100
    return 100 * both >= share * union, far <= np.minimum(home + 2 * r, CORE + r)[:, None] + 1e-9, home > CORE


def _dealt_to_cells(share: int):
    """A slice of a region with all its pivots: links to the pivots, and the members dealt to their cells. Pivots are done."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by([("pivot", "ascending"), ("key", "ascending")])
        is_pivot, key, size, comp = (table[c].to_numpy(zero_copy_only=False) for c in ("pivot", "key", "size", "comp"))
        sets, cell = _sets(table), table["cell"][0].as_py()
        p, m = np.flatnonzero(is_pivot), np.flatnonzero(~is_pivot)
        m = np.concatenate([m[~np.isin(key[m], key[p])], p])  # pivots meet each other, but go to no cell
        if len(p):
            near, among, far = cells_of(_overlaps([sets[i] for i in m], [sets[i] for i in p]), size[m], size[p], share)
        else:
            near = among = np.zeros((len(m), 0), bool)
            far = np.ones(len(m), bool)
        among[is_pivot[m]] = far[is_pivot[m]] = False
        x, y = np.nonzero(near & (comp[m][:, None] != comp[p][None, :]))
        who, q = np.nonzero(among)
        names = C.mix(key[p].view(np.uint64) ^ C.mix(np.array([cell], np.int64).view(np.uint64))).view(np.int64)
        rest = C.mix(np.array([cell], np.int64).view(np.uint64) + np.uint64(1)).view(np.int64)[0]
        at = np.concatenate([m[who], m[far]])
        cells = np.concatenate([names[q], np.full(int(far.sum()), rest)])
        none, blobs = [None] * len(x), table["marks"].to_pylist()
        return pa.table(
            [
                *(pa.array([*v.tolist(), *none], pa.int64()) for v in (cells, key[at], size[at], comp[at])),
                pa.array([*(blobs[i] for i in at.tolist()), *none], pa.binary()),
                *(pa.array([*[None] * len(at), *v.tolist()], pa.int64()) for v in (comp[m[x]], comp[p[y]])),
            ],
            names=["cell", "key", "size", "comp", "marks", "a", "b"],
        )

    return run


def _block_pairs(share: int):
    """Two blocks of one region: links between components that both hold."""

    def run(table: pa.Table) -> pa.Table:
        _, first = np.unique(table["key"].to_numpy(), return_index=True)
        known, sets = table["comp"].to_numpy()[first], _sets(table)
        _, lead, label = np.unique(known, return_index=True, return_inverse=True)
        found = pivot_join([sets[i] for i in first], table["size"].to_numpy()[first], share, lead[label])
        at = lead[found[lead] != lead]
        return pa.table([pa.array(known[at]), pa.array(known[found[at]])], names=["a", "b"])

    return run


def _weight():
    """Bytes that a class stands for."""
    return F.length("marks") + 64


def _labels(links: list[DataFrame], name: str) -> DataFrame | None:
    """(key, comp) of what links join; None where there are no links."""
    if not links:
        return None
    every = functools.reduce(DataFrame.unionAll, links)
    return None if every.isEmpty() else C.connected_components(every, name).select(F.col("node").alias("key"), "comp")


def _relabelled(df: DataFrame, labels: DataFrame | None, col: str = "comp") -> DataFrame:
    """df with the component in col replaced by the one that it has become part of."""
    if labels is None:
        return df
    to = labels.select(F.col("key").alias(col), F.col("comp").alias("_to"))
    return df.join(to, col, "left").withColumn(col, F.coalesce("_to", col)).drop("_to")


def _open(entries: DataFrame) -> DataFrame:
    """Entries of the lists that still hold several components."""
    held = entries.groupBy("s").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("n")).where("lo <> hi").select("s", "n")
    return C.join_skewed(entries, held, "s", entries.count())


def _round(nth: int, entries: DataFrame, sets: DataFrame, share: int, slice_bytes: int) -> DataFrame:
    """Links that one round of pivots finds. entries: s, key, weight, comp of the open lists.

    A list's pivot is its most central class at first, in later rounds one picked by hash, so that other classes get a turn.
    """
    rank = F.col("weight") if nth == 0 else F.xxhash64("key", F.lit(nth))
    pivots = entries.groupBy("s").agg(F.max(F.struct(rank.alias("rank"), "key", "comp")).alias("p"), F.count("*").alias("n"))
    met = C.join_skewed(entries, pivots, "s", entries.count()).where("comp <> p.comp")
    chosen = met.groupBy("key").agg(F.max(F.struct("p.rank", "p.key")).alias("p")).select("key", F.col("p.key").alias("pivot"))
    chosen = C.materialise(chosen.join(sets.select("key", _weight().alias("bytes")), "key"), "chosen")
    totals = chosen.groupBy("pivot").agg(F.sum("bytes").alias("total"))
    dealt = chosen.join(totals, "pivot").withColumn("slice", F.pmod(F.xxhash64("key"), F.ceil(F.col("total") / slice_bytes)))
    groups = C.parts_for(chosen.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0], 2 << 20, least=12)
    dealt = dealt.select("key", "pivot", F.pmod(F.xxhash64("pivot", "slice"), F.lit(groups)).alias("grp"))
    both = dealt.unionAll(dealt.select(F.col("pivot").alias("key"), "pivot", "grp").distinct())
    rows = both.join(sets.select("key", "size", "marks"), "key").select("grp", "pivot", "key", "size", "marks")
    return C.materialise(rows.groupBy("grp").applyInArrow(_pivot_links(share), _LINKS), "links")


def _join_small(regions: DataFrame, share: int) -> DataFrame:
    """Links in regions (region, key, size, comp, marks) that fit a task."""
    groups = C.parts_for(regions.agg(F.coalesce(F.sum(_weight()), F.lit(0))).first()[0], 4 << 20, least=12)
    dealt = regions.withColumn("grp", F.pmod(F.xxhash64("region"), F.lit(groups)))
    return C.materialise(dealt.groupBy("grp").applyInArrow(_in_regions(share), _LINKS), "links")


def _totals(regions: DataFrame) -> DataFrame:
    """(region, bytes, n) of the regions that hold several components."""
    found = regions.groupBy("region").agg(F.sum(_weight()).alias("bytes"), F.count("*").alias("n"), F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    return found.where("lo <> hi").select("region", "bytes", "n")


def _join_regions(regions: DataFrame, share: int, region_bytes: int, depth: int = DEPTH) -> list[DataFrame]:
    """Links in regions (region, key, size, comp, marks) of any size, by Voronoi cells of pivots, joined recursively."""
    from pyspark.sql import Window

    links, before = [], None
    for level in range(depth + 1):
        regions = C.materialise(regions, "regions")
        totals = C.materialise(_totals(regions), "totals")
        if not (left := totals.agg(F.sum("bytes"), F.sum("n"), F.max("bytes")).first())[0]:
            return links
        small = totals.where(F.col("bytes") <= region_bytes)
        links.append(_join_small(regions.join(small.select("region"), "region", "left_semi"), share))
        if left[2] <= region_bytes:
            return links
        large = regions.join(totals.where(F.col("bytes") > region_bytes), "region")
        if level == depth or (before is not None and left[0] > 2 * before):  # boundaries are copied about more than cells get smaller
            break
        before = left[0]
        large = large.withColumn("slices", F.ceil(2 * F.col("bytes") / region_bytes).cast("long"))
        draw = F.xxhash64("key", F.lit(level))
        few = large.where(F.pmod(draw, F.lit(1 << 30)) <= F.lit(3.0 * PIVOTS * (1 << 30)) / F.col("n"))
        few = few.withColumn("nth", F.row_number().over(Window.partitionBy("region").orderBy(draw, "key"))).where(F.col("nth") <= PIVOTS)
        kept = ["region", "slice", "pivot", "key", "size", "comp", "marks"]
        members = large.withColumn("slice", F.pmod(F.xxhash64("key", F.lit(3)), "slices")).withColumn("pivot", F.lit(False)).select(kept)
        pivots = few.withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1))).withColumn("pivot", F.lit(True)).select(kept)
        rows = members.unionAll(pivots).withColumnRenamed("region", "cell")
        dealt = C.materialise(rows.groupBy("cell", "slice").applyInArrow(_dealt_to_cells(share), _CELLS), "cells")
        links.append(dealt.where("a is not null").select("a", "b"))
        regions = _relabelled(dealt.where("cell is not null").select(F.col("cell").alias("region"), "key", "size", "comp", "marks"), _labels(links, "cell-components"))
    return [*links, _join_blocks(large, share, region_bytes // 2)]


def _join_blocks(regions: DataFrame, share: int, block_bytes: int) -> DataFrame:
    """Links in regions that cells can't make smaller (region, key, size, comp, marks, bytes): pairs of blocks, each in a task.
    Blocks hold neighbours by size, so that pairs of too different sizes are not joined."""
    step = F.floor(F.log(F.col("size").cast("double")) / np.log(1.25)).cast("long")
    rows = regions.withColumn("step", step)
    totals = rows.groupBy("region", "step").agg(F.sum(_weight()).alias("own"))
    rows = rows.join(totals, ["region", "step"]).withColumn("block", F.xxhash64("step", F.pmod(F.xxhash64("key", F.lit(7)), F.ceil(F.col("own") / block_bytes))))
    rows = C.materialise(rows.select("region", "block", "key", "size", "comp", "marks"), "blocks")
    span = C.materialise(rows.groupBy("region", "block").agg(F.min("size").alias("lo"), F.max("size").alias("hi")), "spans")
    pairs = span.alias("a").join(span.alias("b"), F.expr(f"a.region = b.region and a.block <= b.block and 100 * a.hi >= {share} * b.lo and 100 * b.hi >= {share} * a.lo"))
    sides = pairs.select("a.region", F.col("a.block").alias("i"), F.col("b.block").alias("j")).select("*", F.explode(F.array_distinct(F.array("i", "j"))).alias("block"))
    return C.materialise(sides.join(rows, ["region", "block"]).groupBy("region", "i", "j").applyInArrow(_block_pairs(share), _LINKS).distinct(), "links")


def join_ngrams(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: int = 80, words: int = WORDS, region_bytes: int = REGION_BYTES) -> DataFrame:
    """(id, n_shingles, class_id, component_id) of every row of docs; other columns of docs are not read.

    Two rows link when 100 * |x & y| >= share * |x | y| over their sets of distinct shingles of `words` lower-cased words; a
    text of fewer words is one shingle; a null or empty text, or one of white space, has none and links with nothing.
    class_id: the smallest id with the same set; component_id: the smallest id reachable by links, itself included. A null
    id stays null and is never a smallest id unless there is no other. Repeated ids keep a row each. An empty table
    gives no rows.
    """
    rows, labels = _labelled(docs, id_col, text_col, share, words, region_bytes)
    found = rows.where("size > 0").join(labels.drop("comp"), "key", "left").select("id", F.col("size").alias("n_shingles"), "class_id", "component_id")
    return found.unionAll(rows.where("size = 0").select("id", "size", "id", "id")).withColumnRenamed("id", id_col)


def _labelled(docs: DataFrame, id_col: str, text_col: str, share: int, words: int, region_bytes: int) -> tuple[DataFrame, DataFrame]:
    """(id, key, size) of every row, key standing for its set, and (key, class_id, comp, component_id) of the sets that aren't empty."""
    spark = docs.sparkSession
    C.bound_batches(spark)
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    send, parts = spark.sparkContext.broadcast, lambda n_bytes, each: 1 << (C.parts_for(n_bytes, each) - 1).bit_length()
    hot = send(_hot(docs, words))
    # A set's leading shingles are two fifths of it: what they rule out is dealt no further.
    n = parts(C.input_bytes(docs), 12 << 20)
    led = docs.mapInArrow(_deal_leading(n.bit_length() - 1, words, share, hot, send(_labels_of_partitions(spark, n))), _LED).repartition(n, "grp")
    met = C.materialise(led.groupBy("grp").applyInArrow(_met, _MET), "met")
    told = met.where("ids is not null")
    rows = told.select(F.explode(F.arrays_zip("ids", "keys", "sizes")).alias("x")).select(F.col("x.ids").alias("id"), F.col("x.keys").alias("key"), F.col("x.sizes").alias("size"))
    mask = send(_mask(met, told.agg(F.coalesce(F.sum(F.size("ids")), F.lit(0))).first()[0]))
    total = told.select("keys", "sizes").mapInArrow(_held(mask), "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    n = parts(8 * total, RANGE_BYTES)
    labels = send(_labels_of_partitions(spark, n))
    dealt = (docs if total else docs.where("false")).select("text").mapInArrow(_deal(n.bit_length() - 1, words, hot, labels, mask), _DEALT).repartition(n, "grp")
    shared = dealt.groupBy("grp").applyInArrow(_shared(n.bit_length() - 1, labels), _SHARED).repartition(n, "grp")
    sets = C.materialise(shared.groupBy("grp").applyInArrow(_assembled(share), _CLASSES), "classes")
    entries = sets.select("key", "size", "marks", "weight").mapInArrow(_leading(share), "s long, key long, weight long")
    entries = C.materialise(entries, "leading")
    entries = C.materialise(_open(entries.withColumn("comp", F.col("key"))), "entries")
    links: list[DataFrame] = []
    for nth in range(ROUNDS):
        if entries.isEmpty():
            break
        links.append(_round(nth, entries, sets, share, region_bytes // 4))
        entries = C.materialise(_relabelled(entries.withColumn("comp", F.col("key")), _labels(links, "round")), "relabelled")
        entries = C.materialise(_open(entries), "entries")
    if not entries.isEmpty():
        lists = entries.groupBy("s").agg(F.min("key").alias("b"), F.count("*").alias("n"))
        near = C.join_skewed(entries, lists, "s", entries.count()).select(F.col("key").alias("a"), "b").where("a <> b").distinct()
        parts = C.connected_components(near, "regions").select(F.col("node").alias("key"), F.col("comp").alias("region"))
        regions = _relabelled(sets.select("key", "size", "marks").join(parts, "key").withColumn("comp", F.col("key")), _labels(links, "round"))
        links += _join_regions(regions.select("region", "key", "size", "comp", "marks"), share, region_bytes)
    comps = _labels(links, "components")
    if comps is None:
        comps = spark.createDataFrame([], "key long, comp long")
    least = rows.where("size > 0").groupBy("key").agg(F.min("id").alias("class_id"))
    labels = least.join(comps, "key", "left").withColumn("comp", F.coalesce("comp", "key"))
    labels = C.materialise(labels, "labels")
    best = labels.groupBy("comp").agg(F.min("class_id").alias("component_id"))
    return rows, labels.join(best, "comp").select("key", "class_id", "comp", "component_id")


def _set_key(words: int):
    """The key of a text's set of shingles, as in _deal."""
    import pandas as pd
    from collections.abc import Iterator

    def run(texts):
        for column in texts:
            data, offsets = C.buffers(pa.array(column, pa.string(), from_pandas=True))
            parts = [set_keys(shingles(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], words)) for i, j in C.slices(offsets)]
            yield pd.Series(np.concatenate(parts or [np.zeros(0, np.int64)]))

    run.__annotations__ = {"texts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "long")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: int = 80) -> DataFrame:
    """docs with one row of each component: the one with the smallest id. Rows without an id are kept.

    Rows of one component that repeat its smallest id count as copies too: the first of them by its columns stays. Rows that
    share an id but not a component have nothing to do with each other. A text without shingles links only with itself under
    the same id.
    """
    from pyspark.sql import Window

    rows, labels = _labelled(docs, id_col, text_col, share, WORDS, REGION_BYTES)
    labels = C.materialise(labels, "components-of-sets")
    joined = rows.where("size > 0").join(labels, "key", "left").select("id", "component_id").unionAll(rows.where("size = 0").select("id", "id"))
    counted = joined.groupBy("id").agg(F.count("*").alias("n"), F.max(F.col("id") == F.col("component_id")).alias("least")).where("least")
    kept_name, nth, key = C.unused(docs, "_kept"), C.unused(docs, "_nth"), C.unused(docs, "_key")
    kept = counted.select(F.col("id").alias(kept_name), "n")
    of = lambda ids: docs.join(ids.select(kept_name), F.col(id_col) == F.col(kept_name), "left_semi")
    out = of(kept.where("n = 1")).unionAll(docs.where(F.col(id_col).isNull()))
    # A row whose id is its alone is told by the id; of the others the component of each row's own text counts.
    repeated = kept.where("n > 1")
    if repeated.isEmpty():
        return out
    comp, least = C.unused(docs, "_comp"), C.unused(docs, "_least")
    own = labels.select(F.col("key").alias(key + "_of"), F.col("comp").alias(comp), F.col("component_id").alias(least))
    met = of(repeated).withColumn(key, _set_key(WORDS)(F.col(text_col))).join(own, F.col(key) == F.col(key + "_of"), "left")
    met = met.where(F.col(least).isNull() | (F.col(least) == F.col(id_col)))
    order = Window.partitionBy(id_col, comp, F.when(F.col(least).isNull(), F.col(text_col))).orderBy(*(F.col(f"`{c}`").asc_nulls_last() for c, k in docs.dtypes if not k.startswith(("map", "variant"))))
    met = met.withColumn(nth, F.row_number().over(order)).where(F.col(nth) == 1)
    return out.unionAll(met.select(*(f"`{c}`" for c in docs.columns)))
