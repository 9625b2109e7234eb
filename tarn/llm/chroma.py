"""Chroma audio fingerprints and their alignment.

A recording becomes frames of 12 pitch classes; rectangular filters over the frames, summed through an integral image, give
two bits each, packed into one 32-bit integer per frame. Two recordings are aligned by a histogram of the offsets at which
they hold equal integers; of the offsets at which enough agree and few bits differ over the overlap the one with most equal
ones is kept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarn.llm import common as C

RATE, FRAME, HOP = 4_000, 512, 128
BANDS, FILTERS, SPAN = 12, 16, 12  # pitch classes, filters of two bits, frames that a filter may span
VOTES, BIT_ERROR = 8, 0.2
BLOCK = 1024  # frames of a recording that are transformed at once
SAMPLES = 1 << 18  # that are fingerprinted at once, unless a recording is longer
LEVELS = (-0.15, 0.0, 0.15)  # where a filter's log ratio changes its two bits
_GRAY = np.array([0, 1, 3, 2])


def _pitch_classes() -> np.ndarray:
    """FRAME bins x BANDS: the pitch class of each bin between 60 Hz and half the rate."""
    bins = np.fft.rfftfreq(FRAME, 1 / RATE)
    out = np.zeros((len(bins), BANDS))
    use = bins >= 60
    out[np.flatnonzero(use), np.round(12 * np.log2(bins[use] / 440)).astype(int) % 12] = 1
    return out


_CLASSES = _pitch_classes()
_WINDOW = np.hanning(FRAME)


def chroma(samples: np.ndarray) -> np.ndarray:
    """Recordings x frames x BANDS of recordings of one length (rows), each frame of length 1 (a silent one 0)."""
    if samples.shape[1] < FRAME:
        return np.zeros((len(samples), 0, BANDS))
    frames = np.lib.stride_tricks.sliding_window_view(samples, FRAME, axis=1)[:, ::HOP]
    power = np.empty((*frames.shape[:2], BANDS))
    for i in range(0, frames.shape[1], BLOCK):  # a product for each recording's block, so equal recordings stay equal
        power[:, i : i + BLOCK] = np.abs(np.fft.rfft(frames[:, i : i + BLOCK] * _WINDOW)) ** 2 @ _CLASSES
    size = np.sqrt((power * power).sum(2, keepdims=True))
    return np.where(size > 1e-6, power / np.maximum(size, 1e-6), 0)


def filters() -> list[tuple[int, int, int, int]]:
    """(kind, first band, bands, frames) of each filter, from a rule: all widths and heights, each kind in turn."""
    return [(k % 4, (5 * k) % (BANDS - 3), 2 + (k % 3) * 2 if (5 * k) % (BANDS - 3) + 2 + (k % 3) * 2 <= BANDS else 2, (4, 8, SPAN)[k // 4 % 3]) for k in range(FILTERS)]


def fingerprint(samples: np.ndarray) -> np.ndarray:
    """The packed integers (uint32) of recordings of one length (rows), one for each frame at which the longest filter fits."""
    c = chroma(np.asarray(samples, np.float64))
    n = c.shape[1] - SPAN + 1
    if n < 1:
        return np.zeros((len(c), 0), np.uint32)
    image = np.zeros((len(c), c.shape[1] + 1, BANDS + 1))
    image[:, 1:, 1:] = c.cumsum(1).cumsum(2)
    at = np.arange(n)
    box = lambda t0, t1, b0, b1: image[:, at + t1, b1] - image[:, at + t0, b1] - image[:, at + t1, b0] + image[:, at + t0, b0]
    out = np.zeros((len(c), n), np.uint32)
    for k, (kind, b, h, w) in enumerate(filters()):
        if kind == 0:  # lower against upper bands
            x, y = box(0, w, b, b + h // 2), box(0, w, b + h // 2, b + h)
        elif kind == 1:  # earlier against later
            x, y = box(0, w // 2, b, b + h), box(w // 2, w, b, b + h)
        elif kind == 2:  # crosswise
            x = box(0, w // 2, b, b + h // 2) + box(w // 2, w, b + h // 2, b + h)
            y = box(0, w // 2, b + h // 2, b + h) + box(w // 2, w, b, b + h // 2)
        else:  # middle against both sides in time
            y = box(w // 4, 3 * w // 4, b, b + h)
            x = box(0, w, b, b + h) - y
        ratio = np.log1p(np.maximum(x, 0)) - np.log1p(np.maximum(y, 0))
        out |= (_GRAY[np.searchsorted(LEVELS, ratio, "right")].astype(np.uint32)) << np.uint32(2 * k)
    return out


def bit_error(a: np.ndarray, b: np.ndarray, offset: int) -> float:
    """The share of different bits where b, moved by offset (a's place minus b's), lies over a."""
    lo, hi = max(0, offset), min(len(a), len(b) + offset)
    if hi <= lo:
        return 1.0
    return float(np.bitwise_count(a[lo:hi] ^ b[lo - offset : hi - offset]).sum()) / (32 * (hi - lo))


def offset_votes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many prints are equal at each offset (a's place minus b's) from 1 - len(b) to len(a) - 1; by runs, as in align."""
    at = [np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1]))) for x in (a, b)]
    run = [np.diff(np.append(k, len(x))) for k, x in zip(at, (a, b), strict=True)]
    order = np.argsort(b[at[1]], kind="stable")
    held = b[at[1]][order]
    lo, hi = (np.searchsorted(held, a[at[0]], side) for side in ("left", "right"))
    i, j = np.repeat(np.arange(len(at[0])), hi - lo), order[C.ranges(lo, hi - lo)]
    bends, begin = np.zeros(len(a) + len(b) + 1, np.int64), at[0][i] - at[1][j] - run[1][j] + len(b)
    for by, d in ((0, 1), (run[1][j], -1), (run[0][i], -1), (run[0][i] + run[1][j], 1)):
        np.add.at(bends, begin + by, d)
    return bends.cumsum().cumsum()[: len(a) + len(b) - 1]


def fingerprints(media: DataFrame, id_col: str, audio_col: str) -> DataFrame:
    """id and prints (packed integers as little-endian bytes) of recordings: mono 16-bit PCM at RATE in a binary column.

    A null recording, one shorter than a frame and the filters, and an odd last byte give nothing for what is missing: prints
    of no length. Ids stay as they are, repeated and null ones too.
    """
    C.bound_batches(media.sparkSession)

    def run(batches):
        for batch in batches:
            raw = [x.as_py() or b"" for x in batch.column(1)]
            lengths = np.array([len(x) // 2 for x in raw], np.int64)
            out = [b""] * len(raw)
            for n in np.unique(lengths[lengths >= FRAME]).tolist():  # recordings of one length go together, SAMPLES or so at once
                own = np.flatnonzero(lengths == n)
                step = max(1, SAMPLES // n)
                for i in range(0, len(own), step):
                    at = own[i : i + step].tolist()
                    prints = fingerprint(np.stack([np.frombuffer(raw[k][: 2 * n], "<i2") for k in at])).astype("<u4")
                    for k, x in zip(at, prints, strict=True):
                        out[k] = x.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["id", "prints"])

    return media.select(F.col(id_col).cast("long").alias("id"), F.col(audio_col).alias("audio")).mapInArrow(run, "id long, prints binary")


def _runs(batches):
    """(cid, prints) to (print, cid, at, run, n): the runs of equal prints, where each begins and how long it is; n is the
    number of the recording's prints."""
    for batch in batches:
        cid, blobs = batch.column(0).to_numpy(), batch.column(1).to_pylist()
        for i, x in enumerate(np.frombuffer(b, "<u4") for b in blobs):
            at = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1])))
            run = np.diff(np.append(at, len(x)))
            yield pa.RecordBatch.from_arrays([pa.array(x[at].astype(np.int64)), pa.array(np.full(len(at), cid[i])), pa.array(at), pa.array(run), pa.array(np.full(len(at), len(x)))], names=["print", "cid", "at", "run", "n"])


_RUNS = "print long, cid long, at long, run long, n long"
SALTS = 16  # tasks that the recordings holding one print are dealt to


def align(prints: DataFrame, asked, votes: int = VOTES, most: float = BIT_ERROR) -> DataFrame:
    """For each asked row (a condition on id) the recordings that align with it: id, match_id, n_rows, offset, votes, bit_error.

    Equal fingerprints are one class: match_id is its smallest id and n_rows its number of rows, so copies are not expanded;
    a row's own class is listed as well. A pair needs `votes` equal prints at one offset, or all of the shorter recording's if
    that has fewer. Of the offsets with so many votes and few enough different bits the one with most votes
    counts, of those with equally many the one nearest to 0, of two the positive.
    A null id is never asked for; recordings without prints align with nothing.
    """
    rows = C.materialise(prints.where(F.length("prints") > 0).withColumn("cid", F.xxhash64("prints")), "prints")
    classes = rows.groupBy("cid", "prints").agg(F.min("id").alias("match_id"), F.count("*").alias("n_rows"))
    classes = C.materialise(classes, "classes")
    queries = C.materialise(rows.where(asked & F.col("id").isNotNull()).select("id", "cid"), "queries")
    wanted = queries.select("cid").distinct()
    every = classes.select("cid", "prints").mapInArrow(_runs, _RUNS).withColumn("salt", F.pmod(F.xxhash64("cid"), F.lit(SALTS)).cast("int"))
    own = classes.select("cid", "prints").join(wanted, "cid", "left_semi").mapInArrow(_runs, _RUNS)
    own = own.withColumnsRenamed({"cid": "q", "at": "q_at", "run": "q_run", "n": "q_n"}).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    met = own.join(every, ["print", "salt"])
    # Two runs of a and b equal prints agree at a + b - 1 neighbouring offsets, rising to the shorter's length and falling again:
    # four changes of slope, whatever their lengths. The histogram is their sum, summed up twice.
    begin = F.col("q_at") - F.col("at") - F.col("run") + 1
    changes = F.array(*(F.struct((begin + by).alias("o"), F.lit(d).cast("long").alias("d")) for by, d in ((F.lit(0), 1), (F.col("run"), -1), (F.col("q_run"), -1), (F.col("run") + F.col("q_run"), 1))))
    bends = met.select("q", "cid", F.least("q_n", "n").alias("least"), F.explode(changes).alias("c")).groupBy("q", "cid", "c.o").agg(F.sum("c.d").alias("d"), F.min("least").alias("least"))
    order = W.partitionBy("q", "cid").orderBy("o")
    bends = bends.withColumn("slope", F.sum("d").over(order.rowsBetween(W.unboundedPreceding, 0))).withColumn("next", F.lead("o").over(order))
    # Between bends votes change evenly: they are `votes` at o - 1, and slope more at each offset up to next - 1.
    grown = F.coalesce(F.sum(F.col("slope") * (F.col("next") - F.col("o"))).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    level = F.when((F.col("slope") == 0) & (F.col("o") <= 1) & (F.col("next") >= 1), F.lit(0).cast("long")).otherwise(F.col("o") - 1)
    offsets = bends.select("q", "cid", "least", grown.cast("long").alias("votes"), level.cast("int").alias("offset")).where(F.col("votes") >= F.least(F.lit(votes), "least"))
    best = offsets.groupBy("q", "cid").agg(F.max(F.struct("votes", -F.abs("offset"), "offset")).alias("b")).select("q", "cid", "b.votes", "b.offset")
    sides = best.join(classes.select(F.col("cid").alias("q"), F.col("prints").alias("a")), "q").join(classes.withColumnRenamed("prints", "z"), "cid")

    def errors(batches):
        for batch in batches:
            c = {n: batch.column(n) for n in ("a", "z", "offset")}
            out = []
            for a, z, o, v in zip(*(x.to_pylist() for x in (*c.values(), batch.column("votes"))), strict=True):
                a, z = np.frombuffer(a, "<u4"), np.frombuffer(z, "<u4")
                error = bit_error(a, z, o)
                if error > most:  # another offset with votes enough may do
                    every = offset_votes(a, z)
                    places = np.flatnonzero(every >= min(votes, len(a), len(z)))
                    by = places - (len(z) - 1)
                    for k in np.lexsort((-by, np.abs(by), -every[places])).tolist():
                        if (e := bit_error(a, z, int(by[k]))) <= most:
                            o, v, error = int(by[k]), int(every[places[k]]), e
                            break
                out.append((o, v, error))
            told = [pa.array(x, k) for x, k in zip(zip(*out, strict=True), (pa.int32(), pa.int64(), pa.float64()), strict=True)] if out else [pa.array([], k) for k in (pa.int32(), pa.int64(), pa.float64())]
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in ("q", "match_id", "n_rows")] + told, names=["q", "match_id", "n_rows", "offset", "votes", "bit_error"])

    found = sides.select("q", "match_id", "n_rows", "offset", "votes", "a", "z").mapInArrow(errors, "q long, match_id long, n_rows long, offset int, votes long, bit_error double")
    found = found.where(F.col("bit_error") <= most)
    return queries.join(found, F.col("cid") == F.col("q")).select("id", "match_id", "n_rows", "offset", "votes", "bit_error")


def render(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Recordings made from vectors: each component is a note of HOP samples, its pitch among 24 by its value in terms of the
    vector's length. Null vectors are null recordings; null and non-finite components are rests."""
    C.bound_batches(vectors.sparkSession)
    t = np.arange(HOP) / RATE
    notes = np.concatenate([(8000 * np.sin(2 * np.pi * 220 * 2 ** (np.arange(24)[:, None] / 12) * t)), np.zeros((1, HOP))]).astype("<i2")

    def run(batches):
        for batch in batches:
            out = []
            for v in batch.column(1):
                if not v.is_valid:
                    out.append(None)
                    continue
                x = np.array([np.nan if c is None else c for c in v.as_py()], float)
                size = np.sqrt(np.nansum(np.where(np.isfinite(x), x, 0) ** 2) / max(1, len(x))) or 1
                with np.errstate(invalid="ignore"):
                    note = np.where(np.isfinite(x), np.clip(np.floor(12 + 5 * np.where(np.isfinite(x), x, 0) / size), 0, 23), 24).astype(int)
                out.append(notes[note].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["id", "audio"])

    return vectors.select(F.col(id_col).cast("long").alias("id"), vector_col).mapInArrow(run, "id long, audio binary").withColumnRenamed("id", id_col)
