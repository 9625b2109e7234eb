"""Token counts without tokens: Viterbi over a unigram vocabulary.

An Aho-Corasick automaton lists every vocabulary piece that ends at each character of a word; dynamic programming keeps, for
each end, the best score and the number of pieces on its path. Ties and unknown characters follow the tokenizers library's
unigram model with Metaspace(split=True): each blank starts a word, so every blank of a run counts and the vocabulary's pieces
of several blanks are unreachable; Viterbi over the whole text would count fewer tokens there. Paths are tried by where their last piece starts, a later one must score strictly more; a character at which
no one-character piece starts may stand as unknown, 10 below the worst score, and neighbouring unknowns are one token.
"""

from __future__ import annotations

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm import common as C
from tarn.llm.bpe import MEMO_WORDS

SPACE = "▁"
UNKNOWN_PENALTY = 10.0


def load_vocabulary(path: str | None = None) -> list[tuple[str, float]]:
    """The plain pieces of a sentencepiece file with their stored scores."""
    import sentencepiece

    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]


class Counter:
    """Counts of words, remembered; a worker keeps one for all its tasks."""

    def __init__(self, vocabulary: list[tuple[str, float]], limit: int = MEMO_WORDS):
        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary:
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min((s for _, s in vocabulary), default=0.0) - UNKNOWN_PENALTY
        self.limit = limit
        self.reset()

    def reset(self):
        self.table, self.counts = C.WordTable(self.limit), np.zeros(0, np.int64)

    def word(self, text: str) -> int:
        """The number of tokens of one word, its blank written as SPACE.

        The automaton lists the pieces by where they end, of those with one end the longest first: by where they start.
        """
        best, pieces, open_ = [0.0], [0], [False]  # of each place: the best score, its pieces, whether its last is unknown
        at, top, kept, single = 0, None, 0, False  # the place whose piece is sought; its best so far, where that starts

        def settle(upto: int) -> None:
            nonlocal at, top, kept, single
            while at < upto:
                unknown = not single and (top is None or best[at] + self.unknown > top)
                if unknown:
                    top, kept = best[at] + self.unknown, at
                best.append(top)
                pieces.append(pieces[kept] + (not (unknown and kept > 0 and open_[kept])))
                open_.append(unknown)
                at, top, single = at + 1, None, False

        if len(self.automaton):
            for end, (size, score) in self.automaton.iter(text):
                if at < end:
                    settle(end)
                start = end + 1 - size
                total = best[start] + score
                if top is None or total > top:
                    top, kept = total, start
                if size == 1:
                    single = True
        settle(len(text))
        return pieces[-1]

    def texts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The number of tokens of each text: words start at blanks (or SPACE) and at the start of a text."""
        n, size = len(offsets) - 1, len(data)
        if not size:
            return np.zeros(n, np.int64)
        first = data == 32
        if (lower := data == 0x81).any():
            mark = lower.copy()
            mark[:2] = False
            mark[2:] &= (data[1:-1] == 0x96) & (data[:-2] == 0xE2)
            first[:-2] |= mark[2:]
        first[offsets[:-1][offsets[:-1] < size]] = True
        starts = np.flatnonzero(first)
        ends = np.append(starts[1:], size)
        if self.table.full:
            self.reset()
        at, new = self.table.number(data, starts, ends)
        if len(new):
            raw, made = data.tobytes(), []
            for a, b in zip(starts[new].tolist(), ends[new].tolist(), strict=True):
                text = raw[a:b].decode().replace(" ", SPACE)
                made.append(self.word(text if text.startswith(SPACE) else SPACE + text))
            self.counts = np.concatenate([self.counts, np.array(made, np.int64)])
        of = np.searchsorted(offsets, starts, "right") - 1
        return np.bincount(of, self.counts[at], n).astype(np.int64)


def count_tokens(docs: DataFrame, vocabulary: list[tuple[str, float]] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id column and n_tokens of each row of docs, over whole texts.

    A null or empty text has 0. Ids, null and repeated ones too, are kept; other columns are not read; no rows give none.
    """
    spark = docs.sparkSession
    C.bound_batches(spark)
    sent = spark.sparkContext.broadcast(load_vocabulary() if vocabulary is None else vocabulary)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        counter = C.of_worker("counter", sent.value, lambda: Counter(sent.value))
        for batch in batches:
            data, offsets = C.buffers(batch.column(1))
            parts = [counter.texts(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]) for i, j in C.slices(offsets)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(parts or [np.zeros(0, np.int64)]))], names=["id", "n_tokens"])

    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string")).mapInArrow(run, f"id {kind}, n_tokens long")
    return out.withColumnRenamed("id", id_col)
