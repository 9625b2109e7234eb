"""Quality classifier from weak labels.

Overlapping heuristic labellers vote on every document. How often each combination of votes occurs is counted over all
documents (at most 3^labellers rows); expectation-maximisation on these counts estimates each labeller's accuracies and, for
each combination, the probability that its documents are good. These posteriors train a hashed linear scorer on a bounded
sample of the documents; the scorer reads whole texts: their words, hashed, and the forms of their characters.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm import common as C

FORMS, WORDS = 1022, 1024  # slots of triples of character classes, and of words
DIMS = FORMS + WORDS + 2
TRAIN_ROWS = 4_000
ROWS = 1_000  # documents whose features stand in memory at once
LABELLERS = ("capitals", "symbols", "repeats", "top_word", "separators", "word_length", "vocabulary", "sentences", "variety")
EXPECTED, PRIOR = 0.9, 0.05  # of a labeller before any vote, and how much of the documents that outweighs
FEW_WORDS = 10  # a text of so many words is scored half by the prior

# Classes of bytes: 0 blank, 1 line end, 2 lower, 3 upper, 4 digit, 5 beyond ASCII, 6 sentence mark, 7 comma and the like, 8 rest,
# 9 to 19 marks that junk is made of.
_CLASS = np.full(256, 8, np.uint8)
_CLASS[[9, 11, 12, 13, 32]] = 0
_CLASS[10] = 1
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 2, 3, 4, 5
_CLASS[[ord(x) for x in ".?"]] = 6
_CLASS[[ord(x) for x in ",;:'\"()-"]] = 7
for _i, _x in enumerate("!|#$%&*<>={"):
    _CLASS[ord(_x)] = 9 + _i
_CODE = (C.mix(np.arange(1, 8001, dtype=np.uint64)) % np.uint64(FORMS)).astype(np.int32)


def measure(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Votes (1 good, -1 bad, 0 none; a column for each labeller) and hashed features of the documents."""
    n, size = len(offsets) - 1, len(data)
    votes, features = np.zeros((n, len(LABELLERS)), np.int8), np.zeros((n, DIMS))
    if not size:
        return votes, features
    kind = _CLASS[data]
    of = np.repeat(np.arange(n, dtype=np.int32), np.diff(offsets))  # the arrays of a slice stand side by side: keep them narrow
    count = np.bincount(of * 20 + kind, minlength=20 * n).reshape(n, 20).astype(float)
    code = kind[:-2].astype(np.int32) * 400 + kind[1:-1].astype(np.int32) * 20 + kind[2:] if size > 2 else np.zeros(0, np.int32)
    inside = of[:-2] == of[2:] if size > 2 else np.zeros(0, bool)
    if size > 2:
        forms = np.bincount(of[:-2][inside] * FORMS + _CODE[code[inside]], minlength=n * FORMS).reshape(n, FORMS)
        features[:, :FORMS] = forms / np.maximum(1, forms.sum(1))[:, None]
    # Words
    white = kind <= 1
    first, last = np.ones(size, bool), np.ones(size, bool)
    first[1:] = white[:-1]
    last[:-1] = white[1:]
    first[offsets[:-1][offsets[:-1] < size]] = True
    last[offsets[1:][offsets[1:] > 0] - 1] = True
    starts, ends = np.flatnonzero(~white & first), np.flatnonzero(~white & last) + 1
    word_of = of[starts]
    words = np.bincount(word_of, minlength=n).astype(float)
    some = np.maximum(words, 1)
    h = C.span_hashes(data, starts, ends)
    slots = np.bincount(word_of * WORDS + (h % np.uint64(WORDS)).astype(np.int32), minlength=n * WORDS).reshape(n, WORDS)
    features[:, FORMS : FORMS + WORDS] = slots / some[:, None]
    same = (h[1:] == h[:-1]) & (word_of[1:] == word_of[:-1])
    repeats = np.bincount(word_of[1:][same], minlength=n) / some
    top, distinct = np.zeros(n), np.zeros(n)
    order = np.lexsort((h, word_of))
    if len(order):
        cut = np.flatnonzero(np.concatenate(([True], (h[order][1:] != h[order][:-1]) | (word_of[order][1:] != word_of[order][:-1]))))
        distinct = np.bincount(word_of[order][cut], minlength=n)
        np.maximum.at(top, word_of[order][cut], np.diff(np.append(cut, len(order))))
    top /= some
    features[:, DIMS - 2], features[:, DIMS - 1] = repeats, top
    letters = np.maximum(1, count[:, 2] + count[:, 3] + count[:, 5] / 2)
    capitals, marks = count[:, 3] / letters, (count[:, 8] + count[:, 9:].sum(1)) / some
    closing, length = count[:, 6] / some, count[:, 2:].sum(1) / some
    enough, many = words >= 5, words >= 20
    for k, (good, bad) in enumerate(
        (
            (False, enough & (capitals > 0.4)),
            (False, enough & (marks > 0.4)),
            (False, enough & (repeats > 0.25)),
            (False, many & (top > 0.3)),
            (False, enough & (count[:, 10:].sum(1) / some > 0.25)),
            (False, enough & ((length < 2.5) | (length > 14))),
            (False, many & (distinct < 1.5 * np.sqrt(words))),
            (enough & (closing > 0.02) & (closing < 0.5) & (capitals < 0.15) & (marks < 0.1) & (repeats < 0.05), False),
            (many & (repeats < 0.03) & (top < 0.2) & (marks < 0.1), False),
        )
    ):
        votes[:, k] = np.where(bad, -1, np.where(good, 1, 0))
    return votes, np.sqrt(features)


def estimate(votes: np.ndarray, counts: np.ndarray, rounds: int = 500) -> tuple[np.ndarray, np.ndarray, float]:
    """EM over counted vote combinations: P(good | votes), each labeller's accuracy and the share of good documents.

    votes: combinations by labellers in -1, 0, 1. A labeller that does not vote says nothing; one that votes is right with
    its accuracy, be that below one half: then its votes count against themselves. Accuracies have a Beta prior with mean
    EXPECTED and the weight of PRIOR of all documents, so that what all know outweighs it, while a kind of junk that only
    one labeller knows, which the others' silence or praise can't refute, is still believed. Starts from the majority;
    without votes the prior stands.
    """
    voted, total = votes != 0, max(1.0, counts.sum())
    good = np.clip(0.5 + 0.4 * np.sign(votes.sum(1)), 0.1, 0.9)
    accuracy, prior, weight = np.full(votes.shape[1], EXPECTED), 0.5, PRIOR * total
    for _ in range(rounds):
        right = np.where(votes > 0, good[:, None], 1 - good[:, None]) * voted
        accuracy = (counts @ right + EXPECTED * weight) / (counts @ voted + weight)
        prior = float((counts @ good + 1) / (total + 2))
        logs = np.log(prior / (1 - prior)) + votes @ np.log(accuracy / (1 - accuracy))
        new = 1 / (1 + np.exp(-logs))
        if np.abs(new - good).max() < 1e-9:
            break
        good = new
    return good, accuracy, prior


def fit_linear(x: np.ndarray, p: np.ndarray, rounds: int = 400, ridge: float = 1e-4) -> np.ndarray:
    """Logistic regression on soft labels by accelerated gradient descent; the last weight is the constant."""
    x = np.concatenate([x, np.ones((len(x), 1), x.dtype)], axis=1)
    step = 4 / max(1e-9, np.einsum("ij,ij->", x, x, dtype=np.float64) / max(1, len(x)) + 4 * ridge)  # rows' mean square bounds the curvature
    w = v = np.zeros(x.shape[1])
    for k in range(rounds):
        error = 1 / (1 + np.exp(-np.clip(x @ v.astype(x.dtype), -30, 30))) - p
        gradient = (error.astype(x.dtype) @ x).astype(np.float64) / max(1, len(x)) + ridge * v
        new = v - step * gradient
        v = new + k / (k + 3) * (new - w)
        w = new
    return w


@dataclass
class Model:
    weights: np.ndarray
    accuracy: np.ndarray
    prior: float


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_rows: int = TRAIN_ROWS) -> Model:
    """Estimate the labellers over all of docs and train the scorer on train_rows documents.

    Those have the smallest hashes of id, text and place among the rows equal in both, so neither null ids nor repeated ones
    nor copies lead to more rows or favour some votes. Equal rows have equal features, which are kept once.
    """
    spark = docs.sparkSession
    C.bound_batches(spark)
    text, own_hash = F.col(text_col).cast("string"), F.xxhash64(F.col(id_col), F.col(text_col).cast("string"))
    run_of = 4096
    equal = docs.select(own_hash.alias("h")).groupBy("h").agg(F.count("*").alias("n"))
    runs = equal.select("h", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {run_of}"))).alias("r"))
    places = runs.select("h", F.explode(F.sequence(F.col("r") * run_of + 1, F.least("n", (F.col("r") + 1) * run_of))).alias("place"))
    ids = places.select("h", F.xxhash64("h", "place").alias("rank")).orderBy("rank", "h").limit(train_rows)
    times = {r["h"]: r["n"] for r in ids.groupBy("h").agg(F.count("*").alias("n")).collect()}
    sent = spark.sparkContext.broadcast(np.array(sorted(times), np.int64))
    base = 3 ** np.arange(len(LABELLERS))

    def run(batches):
        C.tidy()
        done: set[int] = set()
        for batch in batches:
            hashes = batch.column(1).to_numpy()
            _, firsts = np.unique(hashes, return_index=True)
            chosen = np.zeros(len(hashes), bool)
            chosen[[k for k in firsts[np.isin(hashes[firsts], sent.value)] if hashes[k] not in done]] = True
            done.update(hashes[chosen].tolist())
            data, offsets = C.buffers(batch.column(0))
            for i, j in C.slices(offsets, rows=ROWS):
                votes, features = measure(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                code, count = np.unique((votes.astype(np.int64) + 1) @ base, return_counts=True)
                own = np.flatnonzero(chosen[i:j])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([code, (votes[own].astype(np.int64) + 1) @ base])),
                        pa.array([*count.tolist(), *[0] * len(own)], pa.int64()),
                        pa.array([*[None] * len(code), *hashes[i + own].tolist()], pa.int64()),
                        pa.array([*[None] * len(code), *[features[k].astype(np.float16).tobytes() for k in own]], pa.binary()),
                    ],
                    names=["code", "n", "h", "features"],
                )
        C.tidy()

    seen = C.materialise(docs.select(text, own_hash).mapInArrow(run, "code long, n long, h long, features binary"), "votes")
    counted = seen.where("features is null").groupBy("code").agg(F.sum("n").alias("n")).orderBy("code").collect()
    code = np.array([r[0] for r in counted], np.int64)
    if not len(code):
        return Model(np.zeros(DIMS + 1), np.full(len(LABELLERS), 0.8), 0.5)
    votes = code[:, None] // base % 3 - 1
    good, accuracy, prior = estimate(votes, np.array([r[1] for r in counted], float))
    posterior = dict(zip(code.tolist(), good.tolist(), strict=True))
    rows = seen.where("features is not null").dropDuplicates(["h"]).orderBy("h").select("code", "h", "features").toArrow()
    weight = [times[h] for h in rows["h"].to_pylist()]
    x = np.stack([np.frombuffer(f.as_buffer(), np.float16) for f in rows["features"]]).astype(np.float32)
    p = np.array([posterior[c] for c in rows["code"].to_pylist()])
    return Model(fit_linear(np.repeat(x, weight, axis=0), np.repeat(p, weight)), accuracy, prior)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", score_col: str = "quality_score") -> DataFrame:
    """docs with the column score_col, the probability that the whole text is good.

    A text without words (null too) scores 0; the score of one of few words leans on the share of good documents. Ids may be
    null or repeat; a column of the new one's name is replaced.
    """
    C.bound_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast((model.weights, float(np.log(model.prior / (1 - model.prior)))))

    def run(texts):
        for column in texts:
            data, offsets = C.buffers(pa.array(column, pa.string(), from_pandas=True))
            yield _scores(data, offsets, *sent.value)
        C.tidy()

    import pandas as pd
    from collections.abc import Iterator

    run.__annotations__ = {"texts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return docs.withColumn(score_col, F.pandas_udf(run, "double")(F.col(text_col).cast("string")))


def _scores(data, offsets, weights, prior):
    import pandas as pd

    out = np.zeros(len(offsets) - 1)
    for i, j in C.slices(offsets, rows=ROWS):
        part, cuts = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        _, x = measure(part, cuts)
        first = _CLASS[part] > 1
        first[1:] &= (_CLASS[part][:-1] <= 1) | np.isin(np.arange(1, len(part)), cuts)
        full = np.concatenate(([0], np.cumsum(first)))
        words = full[cuts[1:]] - full[cuts[:-1]]
        sure = words / (words + FEW_WORDS)
        logs = sure * (x @ weights[:-1] + weights[-1]) + (1 - sure) * prior
        out[i:j] = np.where(words > 0, 1 / (1 + np.exp(-np.clip(logs, -30, 30))), 0)
    return pd.Series(out)


def classify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5, train_rows: int = TRAIN_ROWS, score_col: str = "quality_score", kept_col: str = "kept") -> DataFrame:
    """docs with score_col and kept_col (score of at least `least`), by a model fitted to docs themselves.

    Rows, their null ids and other columns stay as they are; columns of the new ones' names are replaced.
    """
    model = fit(docs, id_col, text_col, train_rows)
    return score(docs, model, id_col, text_col, score_col).withColumn(kept_col, F.col(score_col) >= least)


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """The rows of docs that classify() keeps, with the columns of docs alone, whatever they are called."""
    names = {"score_col": C.unused(docs, "_score"), "kept_col": C.unused(docs, "_kept")}
    return classify(docs, id_col, text_col, least, train_rows, **names).where(F.col(names["kept_col"])).select(*(f"`{c}`" for c in docs.columns))
