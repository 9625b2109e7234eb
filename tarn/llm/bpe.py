"""BPE encoding and decoding with a minimal acyclic transducer as lexicon.

The frequent words of the corpus, already merged, are compiled into a minimal acyclic automaton over bytes: common suffixes
share their states, each edge carries how many words sort before those behind it, so a walk adds up to a word's number and
with it to its ids. The automaton is one flat file that each worker maps into memory. Words it does not hold are merged
exactly, many at a time in numpy. Encoding and decoding give what the tokenizers library gives for a byte-level BPE file
with add_special_tokens=False and no truncation or padding: special tokens inside a text are recognised.
"""

from __future__ import annotations

import hashlib
import json
import operator
import os
import tempfile
import unicodedata
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm import common as C

LEXICON_WORDS = 32_768
MEMO_WORDS = 250_000
_LETTER, _NUMBER, _OTHER, _WHITE = 1, 2, 3, 0


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


# --- the vocabulary -----------------------------------------------------------------------------------------------


def _byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in byte-level vocabularies: printable Latin-1 itself, the rest from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Merges and bytes of a byte-level BPE file, as arrays: small (bounded by the file) and quick to send."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters, ids = _byte_letters(), spec["model"]["vocab"]
        self.special = {t["content"].encode(): t["id"] for t in spec["added_tokens"]}
        self.size = max([*ids.values(), *self.special.values()]) + 1
        self.pieces = [b""] * self.size
        for token, i in ids.items():
            if token.encode() not in self.special:
                self.pieces[i] = bytes(letters[x] for x in token)
        for token, i in self.special.items():
            self.pieces[i] = token
        self.byte_ids = np.array([ids[x] for x, _ in sorted(letters.items(), key=lambda p: p[1])], np.int64)
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.pairs = np.array([ids[a] * self.size + ids[b] for a, b in merges], np.uint64)
        self.into = np.array([ids[a + b] for a, b in merges], np.int64)


def merge_words(words: list[bytes], vocabulary: Vocabulary, ranks: C.Memo) -> list[np.ndarray]:
    """The ids of each word by BPE's rule: the lowest-ranked pair first, of equal ones the leftmost."""
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(words)
    lengths = np.array([len(w) for w in words], np.int64)
    none = np.int64(1 << 40)
    size = np.uint64(vocabulary.size)

    def rank(a, b):
        r = np.full(len(a), none, np.int64)
        ok = (a >= 0) & (b >= 0)
        # The table has hashes of pairs; a pair's own number is checked, so a found rank is exact.
        pair = a[ok].astype(np.uint64) * size + b[ok].astype(np.uint64)
        at = ranks.find(C.mix(pair + np.uint64(1)))
        r[ok] = np.where((at >= 0) & (vocabulary.pairs[np.maximum(at, 0)] == pair), at, none)
        return r

    for limit in (8, 16, 32, 64, 256, 1024, 1 << 62):
        rows = np.flatnonzero((lengths <= limit) & (lengths > (0 if limit == 8 else limit // (4 if limit >= 256 else 2))))
        if limit == 1 << 62:
            rows = np.flatnonzero(lengths > 1024)
        for part in np.array_split(rows, max(1, -(-len(rows) * min(limit, 4096) // (1 << 19)))) if len(rows) else []:
            width = int(lengths[part].max())
            text = np.frombuffer(b"".join(words[i].ljust(width, b"\0") for i in part), np.uint8).reshape(len(part), width)
            a = vocabulary.byte_ids[text]
            a[np.arange(width)[None, :] >= lengths[part][:, None]] = -1
            n = lengths[part].copy()
            r = np.full(a.shape, none, np.int64)
            if width > 1:
                r[:, :-1] = rank(a[:, :-1].ravel(), a[:, 1:].ravel()).reshape(len(part), width - 1)
            live = np.arange(len(part))
            steps = np.arange(width)
            while len(live):
                best = r[live].argmin(1)
                low = r[live, best]
                go = low < none
                live, best, low = live[go], best[go], low[go]
                if not len(live):
                    break
                x, y = a[live], r[live]
                idx = np.minimum(steps[None, :] + (steps[None, :] > best[:, None]), width - 1)
                x, y = np.take_along_axis(x, idx, 1), np.take_along_axis(y, idx, 1)
                every = np.arange(len(live))
                x[every, best] = vocabulary.into[low]
                n[live] -= 1
                x[every, n[live]] = -1
                y[every, n[live]] = none
                y[every, best] = rank(x[every, best], x[every, np.minimum(best + 1, width - 1)])
                y[every, best] = np.where(best + 1 < n[live], y[every, best], none)
                before = np.maximum(best - 1, 0)
                again = rank(x[every, before], x[every, best])
                y[every, before] = np.where(best > 0, again, y[every, before])
                a[live], r[live] = x, y
            for k, i in enumerate(part):
                out[i] = a[k, : n[k]].copy()
    return out


def rank_table(vocabulary: Vocabulary) -> C.Memo:
    table = C.Memo(max(8, int(len(vocabulary.pairs)).bit_length() + 2))
    table.add(C.mix(vocabulary.pairs + np.uint64(1)), np.arange(len(vocabulary.pairs), dtype=np.int32))
    return table


# --- the transducer -----------------------------------------------------------------------------------------------


def compile_lexicon(words: dict[bytes, Iterable[int]]) -> bytes:
    """A minimal acyclic automaton over the sorted words, numbering them, with the ids of each number; as one flat file."""
    order = sorted(w for w in words if w)
    register: dict[tuple, int] = {}
    final: list[bool] = []
    edges: list[list[tuple[int, int]]] = []

    def settled(state: list) -> int:
        key = (state[0], tuple(state[1]))
        if key not in register:
            register[key] = len(edges)
            final.append(state[0])
            edges.append(state[1])
        return register[key]

    path: list[list] = [[False, []]]  # open states: [final, settled edges]; the last edge of each is still open
    last = b""
    for word in order:
        k = 0
        while k < min(len(last), len(word)) and last[k] == word[k]:
            k += 1
        while len(path) > k + 1:
            state = settled(path.pop())
            path[-1][1].append((last[len(path) - 1], state))
        path.extend([False, []] for _ in word[k:])
        path[-1][0] = True
        last = word
    while len(path) > 1:
        state = settled(path.pop())
        path[-1][1].append((last[len(path) - 1], state))
    root = settled(path[0])
    reach = np.zeros(len(edges), np.int64)
    keys, to, add = [], [], []
    for s, own in enumerate(edges):  # a state comes after those it leads to
        total = int(final[s])
        for label, t in own:
            keys.append(s << 8 | label)
            to.append(t)
            add.append(total)
            total += int(reach[t])
        reach[s] = total
    ids = [list(words[w]) for w in order]
    parts = [
        np.array([root, len(edges), len(keys), len(order), sum(map(len, ids))], np.int64),
        np.array(keys, np.int64), np.array(to, np.int64), np.array(add, np.int64), np.array(final, np.int64),
        np.cumsum([0, *map(len, ids)], dtype=np.int64), np.array([i for x in ids for i in x], np.int64),
    ]
    return b"".join(p.tobytes() for p in parts)


class Lexicon:
    """The compiled automaton, mapped into memory from a file."""

    def __init__(self, blob: bytes, folder: str | None = None):
        handle, path = tempfile.mkstemp(dir=folder)
        try:
            with os.fdopen(handle, "wb") as f:
                f.write(blob)
            flat = np.memmap(path, np.int64, "r")
        finally:
            os.unlink(path)  # the mapping keeps the file's pages; nothing stays in the folder
        self.root, states, edges, words, total = (int(x) for x in flat[:5])
        cuts = np.cumsum([5, edges, edges, edges, states, words + 1, total])
        self.keys, self.to, self.add, self.final, self.starts, self.ids = (flat[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True))

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """The number of each word, -1 for those not held; all words walk in step."""
        lengths = np.array([len(w) for w in words], np.int64)
        text = np.frombuffer(b"".join(words), np.uint8)
        starts = np.cumsum(lengths) - lengths
        state, number = np.full(len(words), self.root), np.zeros(len(words), np.int64)
        live, step = np.flatnonzero(lengths > 0), 0
        state[lengths == 0] = -1
        while len(live) and len(self.keys):
            want = state[live] << 8 | text[starts[live] + step]
            at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
            ok = self.keys[at] == want
            state[live[~ok]] = -1
            live, at = live[ok], at[ok]
            number[live] += self.add[at]
            state[live] = self.to[at]
            step += 1
            live = live[lengths[live] > step]
        found = (state >= 0) & (self.final[np.maximum(state, 0)] != 0) if len(self.keys) else np.zeros(len(words), bool)
        return np.where(found, number, -1)

    def lookup(self, number: int) -> np.ndarray:
        return self.ids[self.starts[number] : self.starts[number + 1]]


# --- words --------------------------------------------------------------------------------------------------------


def _classes() -> np.ndarray:
    out = np.full(0x110000, _OTHER, np.uint8)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))[0]
        if kind == "L":
            out[c] = _LETTER
        elif kind == "N":
            out[c] = _NUMBER
    out[[*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = _WHITE
    return out


def word_bounds(data: np.ndarray, offsets: np.ndarray, classes: np.ndarray, special: Iterable[bytes] = ()) -> np.ndarray:
    """The byte positions at which the words of the documents start, as the byte-level pattern of the vocabulary cuts them.

    An optional blank and a run of letters, of digits or of others; the contractions after an apostrophe; white space, of
    which the last character stands apart when a word follows.
    """
    raw = data.tobytes()
    points = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), np.uint32)
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    width = 1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF)
    place = np.zeros(n + 1, np.int64)
    np.cumsum(width, out=place[1:])
    kind = classes[points]
    edge = np.zeros(n + 1, bool)  # where a text starts or ends
    simple = n == len(raw)
    edge[offsets if simple else np.searchsorted(place, offsets)] = True
    spans = []
    for token in special:
        at = raw.find(token)
        while at >= 0:
            inside = np.searchsorted(offsets, at, "right") == np.searchsorted(offsets, at + len(token) - 1, "right")
            if inside:
                spans.append((int(np.searchsorted(place, at)), int(np.searchsorted(place, at + len(token)))))
            at = raw.find(token, at + (len(token) if inside else 1))
    for a, b in spans:
        edge[a] = edge[b] = True
    white = kind == _WHITE
    start = np.ones(n, bool)
    start[1:] = kind[1:] != kind[:-1]
    start |= edge[:-1]
    # The last of a run of white space starts a word of its own if more text follows; a blank takes the next run along.
    follows = np.zeros(n, bool)
    follows[:-1] = white[:-1] & ~white[1:] & ~edge[1:-1]
    start |= follows
    blank = follows & (points == 32)
    start[1:] &= ~blank[:-1]
    quote = np.flatnonzero(start & (points == 39))
    if len(quote):
        start = _contract(points, kind, edge, start, quote)
    for a, b in spans:
        start[a + 1 : b] = False
    return place[:-1][start]


def _contract(points, kind, edge, start, quote):
    n = len(points)
    after = lambda k: np.where((quote + k < n) & ~np.any([edge[np.minimum(quote + j, n)] for j in range(1, k + 1)], axis=0), points[np.minimum(quote + k, n - 1)], 0)
    one, two = after(1), after(2)
    short = np.isin(one, [ord(x) for x in "stmd"])
    long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
    for which, size in ((short, 2), (long & ~short, 3)):
        at = quote[which]
        start[at + 1] = False
        end = at + size
        # A boundary at the end of the contraction, unless a blank-led or white run rule already set what is there.
        end = end[end < n]
        start[end] = True
    return start


class Words:
    """Texts to numbers of words, with all words seen so far; a worker keeps one for all its batches."""

    def __init__(self, vocabulary: Vocabulary, limit: int = MEMO_WORDS):
        self.vocabulary, self.limit, self.classes = vocabulary, limit, _classes()
        self.reset()

    def reset(self):
        self.table, self.words, self.size = C.WordTable(self.limit), [], 0

    def fresh(self, words: list[bytes]) -> None:
        """Take up new words."""
        self.words += words
        self.size += len(words)

    def numbers(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number of each word of the texts, and n + 1 bounds of the texts among them."""
        starts = word_bounds(data, offsets, self.classes, self.vocabulary.special)
        ends = np.append(starts[1:], len(data))
        if not len(starts):
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        if self.table.full:
            self.reset()
        at, new = self.table.number(data, starts, ends)
        if len(new):
            raw = data.tobytes()
            self.fresh([raw[a:b] for a, b in zip(starts[new].tolist(), ends[new].tolist(), strict=True)])
        return at, np.searchsorted(starts, offsets)


def _count_words(vocabulary, keep: int):
    """Batches to (word, count): a Misra-Gries summary of a partition, which loses at most its smallest kept count."""

    def run(batches):
        words = C.of_worker("words", vocabulary.value, lambda: Words(vocabulary.value))
        counts = np.zeros(0, np.int64)

        def summary():
            nonlocal counts
            top = np.argsort(-counts, kind="stable")[: keep + 1]
            cut = counts[top[keep]] if len(top) > keep else 0
            top = top[:keep][counts[top[:keep]] > cut]
            for i in range(0, len(top), 20_000):
                t = top[i : i + 20_000]
                yield pa.RecordBatch.from_arrays([pa.array([words.words[k] for k in t], pa.binary()), pa.array(counts[t] - cut)], names=["word", "n"])
            counts = np.zeros(0, np.int64)

        for batch in batches:
            data, offsets = C.buffers(batch.column(0))
            for i, j in C.slices(offsets):
                if words.table.full:  # the words are about to be numbered anew
                    yield from summary()
                    words.reset()
                at, _ = words.numbers(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                add = np.bincount(at, minlength=len(words.words))
                add[: len(counts)] += counts
                counts = add
        yield from summary()
        C.tidy("words")

    return run


def build_lexicon(docs: DataFrame, vocabulary: Vocabulary, text_col: str = "text", words: int = LEXICON_WORDS) -> bytes:
    """Compile the most frequent words of all of docs (at most `words`) with their ids.

    Words are taken by classes of frequency (16 to a factor of two), as many whole classes as fit, so only a histogram and the
    words themselves come to the driver, however many partitions there are.
    """
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(vocabulary)
    counted = docs.select(F.col(text_col)).mapInArrow(_count_words(sent, 2 * words), "word binary, n long")
    summed = C.materialise(counted.groupBy("word").agg(F.floor(F.log2(F.sum("n")) * 16).alias("level")), "words")
    cut, total = None, 0
    for level, n in summed.groupBy("level").count().orderBy(F.desc("level")).collect():
        total += n
        if total > words:
            break
        cut = level
    top = [] if cut is None else summed.where(F.col("level") >= cut).select("word").collect()
    top = [bytes(r[0]) for r in top if r[0] and bytes(r[0]) not in vocabulary.special]
    merged = merge_words(top, vocabulary, rank_table(vocabulary))
    return compile_lexicon(dict(zip(top, merged, strict=True)))


class Encoder(Words):
    """Texts to ids: words by the transducer, others merged."""

    def __init__(self, vocabulary: Vocabulary, lexicon: bytes, keep: Iterable[str] = ("ids", "texts", "bytes"), limit: int = MEMO_WORDS):
        self.lexicon, self.ranks, self.keep = Lexicon(lexicon), rank_table(vocabulary), frozenset(keep)
        self.decimals = [b"%d," % i for i in range(vocabulary.size)]
        super().__init__(vocabulary, limit)

    def reset(self):
        self.ids: list[bytes] = []
        self.texts: list[bytes] = []
        self.bytes: list[bytes] = []
        super().reset()

    def fresh(self, words: list[bytes]) -> None:
        at = self.lexicon.numbers(words)
        missing = [k for k in np.flatnonzero(at < 0).tolist() if words[k] not in self.vocabulary.special]
        merged = merge_words([words[k] for k in missing], self.vocabulary, self.ranks)
        ids: list = [None] * len(words)
        for k, x in zip(missing, merged, strict=True):
            ids[k] = x
        for k in np.flatnonzero(at >= 0).tolist():
            ids[k] = self.lexicon.lookup(at[k])
        own = [[self.vocabulary.special[w]] if x is None else x.tolist() for w, x in zip(words, ids, strict=True)]
        if "ids" in self.keep:  # packed: an array object for each word would take several times the room
            self.ids += [np.array(x, "<i4").tobytes() for x in own]
        if "texts" in self.keep:
            table = self.decimals
            self.texts += [b"".join([table[i] for i in x]) for x in own]
        if "bytes" in self.keep:
            pieces = self.vocabulary.pieces
            self.bytes += [b"".join([pieces[i] for i in x]) for x in own]
        self.size += len(words)


def _take(things: list, at: list) -> tuple:
    return operator.itemgetter(*at)(things) if len(at) > 1 else tuple(things[i] for i in at)


#: Spark and Arrow types of the columns that can be asked for.
_KINDS = {"n_tokens": ("long", pa.int64()), "ids": ("array<int>", pa.list_(pa.int32())), "ids_sha256": ("string", pa.string()), "decoded_sha256": ("string", pa.string()), "decoded": ("string", pa.string())}


def encode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", columns: tuple[str, ...] = ("n_tokens", "ids"), lexicon_words: int = LEXICON_WORDS) -> DataFrame:
    """The id column and, of each whole text, the asked columns: n_tokens, ids, ids_sha256 (of the decimal ids joined by
    commas), decoded (the ids turned back into text), decoded_sha256 (of its UTF-8).

    A null or empty text has no ids. Ids, null ones too, and repeated rows are kept as they are; other columns are not read.
    An empty table gives no rows.
    """
    spark = docs.sparkSession
    C.bound_batches(spark)
    vocabulary = Vocabulary(path or default_path())
    lexicon = build_lexicon(docs, vocabulary, text_col, lexicon_words)
    sent = spark.sparkContext.broadcast((vocabulary, lexicon))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        needs = {"n_tokens": "texts", "ids_sha256": "texts", "ids": "ids", "decoded": "bytes", "decoded_sha256": "bytes"}
        encoder = C.of_worker("encoder", sent.value, lambda: Encoder(*sent.value, {needs[c] for c in columns}))
        for batch in batches:
            data, offsets = C.buffers(batch.column(1))
            for i, j in C.slices(offsets):
                at, bounds = encoder.numbers(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                at, rows = at.tolist(), {c: [] for c in columns}
                for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                    own = at[a:b]
                    if "n_tokens" in rows or "ids_sha256" in rows:
                        text = b"".join(_take(encoder.texts, own))
                        if "n_tokens" in rows:
                            rows["n_tokens"].append(text.count(b","))
                        if "ids_sha256" in rows:
                            rows["ids_sha256"].append(hashlib.sha256(text[:-1]).hexdigest())
                    if "ids" in rows:
                        rows["ids"].append(np.frombuffer(b"".join(_take(encoder.ids, own)), "<i4"))
                    if "decoded" in rows or "decoded_sha256" in rows:
                        whole = b"".join(_take(encoder.bytes, own)).decode("utf-8", "replace")
                        if "decoded" in rows:
                            rows["decoded"].append(whole)
                        if "decoded_sha256" in rows:
                            rows["decoded_sha256"].append(hashlib.sha256(whole.encode()).hexdigest())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *(pa.array(rows[c], _KINDS[c][1]) for c in columns)], names=["id", *columns])
        C.tidy("encoder")

    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, ", ".join([f"id {kind}", *(f"{c} {_KINDS[c][0]}" for c in columns)]))
    return out.withColumnRenamed("id", id_col)


def decode(tokens: DataFrame, path: str | None = None, ids_col: str = "ids") -> DataFrame:
    """tokens with a column `decoded`: the text of each array of ids, special tokens included, broken UTF-8 replaced.

    Null gives null. Ids outside the vocabulary and null ids are an error. A column named decoded is replaced.
    """
    vocabulary = Vocabulary(path or default_path())
    sent = tokens.sparkSession.sparkContext.broadcast(vocabulary.pieces)

    @F.pandas_udf("string")
    def text(ids):
        return ids.map(lambda x: None if x is None else b"".join([sent.value[i] for i in x]).decode("utf-8", "replace"))

    return tokens.withColumn("decoded", text(F.col(ids_col)))
