"""Tokens, personal data and quality over texts: against the tokenizers library, plain patterns and labels."""

import hashlib
import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tarn.llm import bpe, mixing, pii, token_counts, weak_quality
from tarn.llm import common as C

SF = "/root/testdata/sf0.001"
_ODD = [" ", "  ", "\n", "\t", "'", "'s", "'re", "'ll", "'ve", "a", "re", "é", "日本", "9", "٣", "!", "<|endoftext|>", "<|endo", "😀", "'t", "\r\n", "_", "\x1c", "\x85", " ", "ß", "@", "+1 (2"]


@pytest.fixture(scope="session")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.default_path())


@pytest.fixture(scope="session")
def encoder():
    v = bpe.Vocabulary(bpe.default_path())
    words = [b"the", b" the", b" and", b"\n", b" therhean", "日本".encode()]
    return bpe.Encoder(v, bpe.compile_lexicon(dict(zip(words, bpe.merge_words(words, v, bpe.rank_table(v)), strict=True))))


def ids_of(encoder, texts):
    data, offsets = C.buffers(pa.array(texts, pa.string()))
    at, bounds = encoder.numbers(data, offsets)
    return [np.frombuffer(b"".join(encoder.ids[k] for k in at[a:b]), "<i4").tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=40), st.lists(st.sampled_from(_ODD), max_size=20).map("".join)), min_size=1, max_size=6))
def test_bpe_ids(encoder, library, texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    assert ids_of(encoder, texts) == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_lexicon_is_minimal_and_exact():
    words = {b"abcing": [1, 2], b"xyzing": [3], b"ing": [4], b"a": [5], b"": [6]}
    lexicon = bpe.Lexicon(bpe.compile_lexicon(words))
    ask = [b"abcing", b"xyzing", b"ing", b"a", b"", b"ab", b"abcings", b"q"]
    got = lexicon.numbers(ask)
    assert [lexicon.lookup(k).tolist() if k >= 0 else None for k in got] == [[1, 2], [3], [4], [5], None, None, None, None]
    assert len(lexicon.final) < sum(map(len, words))  # suffixes are shared
    assert bpe.Lexicon(bpe.compile_lexicon({})).numbers([b"a"]).tolist() == [-1]


def test_bpe_documents(spark, library):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    rows += [(None, "null id"), (-1, None), (-2, ""), (-3, "x" * 5000 + " tail"), (-3, "x" * 5000 + " tail"), (-4, "<|endoftext|>!")]
    df = spark.createDataFrame([(k, t, 1) for k, t in rows], "doc_id long, text string, n_tokens int")
    got = bpe.encode(df, columns=("n_tokens", "ids", "ids_sha256", "decoded_sha256", "decoded"), lexicon_words=500)
    own = {(r.doc_id, r.ids_sha256): r for r in got.collect()}
    assert got.count() == len(rows)
    for k, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        r = own[k, hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()]
        text = library.decode(ids, skip_special_tokens=False)
        assert (r.n_tokens, r.ids, r.decoded, r.decoded_sha256) == (len(ids), ids, text, hashlib.sha256(text.encode()).hexdigest())
    back = bpe.decode(got.select("doc_id", "ids", F.col("decoded").alias("want")))
    assert back.where("decoded <> want").count() == 0
    assert bpe.encode(df.where("false")).count() == 0


@pytest.mark.parametrize("vocabulary", [None, [("a", -1.0), ("b", -1.0), ("ab", -2.0), ("aa", -2.0), ("▁", -1.0), ("▁a", -2.0), ("bab", -3.0), ("aab", -3.0)]])
def test_token_counts(spark, vocabulary):
    from tokenizers import Tokenizer, models, pre_tokenizers

    v = vocabulary or token_counts.load_vocabulary()
    lib = Tokenizer(models.Unigram([("<unk>", min(s for _, s in v)), *v], unk_id=0, byte_fallback=False))
    lib.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    rng = random.Random(2)
    texts = ["", " ", "  ", "▁", "a" * 3000, "ab " * 2000] + ["".join(rng.choice([*"aab c▂▁é日\n😀", "  ", "the"]) for _ in range(rng.randint(0, 20))) for _ in range(1500)]
    rows = [(k, t) for k, t in enumerate(texts)] + [(None, "a"), (3, None), (0, "")]
    df = spark.createDataFrame([(k, t, 0) for k, t in rows], "doc_id long, text string, n_tokens int")
    got = sorted(((r.doc_id, r.n_tokens) for r in token_counts.count_tokens(df, vocabulary).collect()), key=repr)
    assert got == sorted(((k, len(lib.encode(t or "", add_special_tokens=False).ids)) for k, t in rows), key=repr)
    assert token_counts.count_tokens(df.where("false"), vocabulary).count() == 0


# --- personal data ---


@pytest.fixture(scope="session")
def field(spark):
    return pii.train(pii.labelled_table(spark))


def plain(text):
    out = []
    email = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
    ip = r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
    for kind, pattern, right in ((0, email, lambda x: True), (1, ip, pii._is_ip), (2, r"[0-9]([\x20-]?[0-9])+", pii._is_card), (3, r"\+[0-9][\x20().0-9-]+[0-9]", pii._is_phone)):
        pattern = re.compile(pattern)
        out += [(m.start(), kind, m.end()) for m in pattern.finditer(text) if right(m.group())]
    return sorted(out)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([*"0123456789....--  ()+@aA%\n é٣", "4111 1111 1111 1111", "a.b@c.d", "256.1.1.1", "+1 (555) 123-4567"]), max_size=30).map("".join))
def test_base_spans_are_the_plain_patterns(text):
    assert pii.base_spans(text) == plain(text)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="a.@-_%1+ ", max_size=40))
def test_base_spans_of_addresses(text):
    assert pii.base_spans(text) == plain(text)


@pytest.mark.parametrize("run", ["7", "a", "a@", "@", "1.", "1.2.3.", "+", "+1 ", "a.", "(", "a@b", "4 ", "-", "[at] dot "])
def test_long_runs_take_linear_time(field, run):
    """Of long runs of each kind; a quadratic scan would take minutes."""
    begin = time.process_time()
    pii.find_spans([run * (60_000 // len(run)) + end for end in ("", "@", "x")], field)
    assert time.process_time() - begin < 15


def test_field_on_held_out_lines(field):
    lines = pii.labelled_lines(700)[400:]
    hit = want = got = 0
    for (_, spans), (_, every) in zip(lines, pii.find_spans([x for x, _ in lines], field), strict=True):
        a, b = {(s, k, e) for s, e, k in spans}, {(s, pii.KINDS[k], e) for s, k, e in every}
        hit, want, got = hit + len(a & b), want + len(a), got + len(b)
    assert hit / want > 0.9 and hit / got > 0.9


def test_viterbi_is_the_best_path(field):
    """Against all paths of short sequences."""
    import itertools

    rng = np.random.default_rng(5)
    for _ in range(20):
        n = int(rng.integers(1, 4))
        x = rng.integers(0, 2 * pii.SHAPES, (1, n))
        e = pii.emissions(field, x)[0]
        best = max((p for p in itertools.product(range(pii.TAGS), repeat=n) if p[0] == 0 or p[0] % 2), key=lambda p: sum(e[i, t] for i, t in enumerate(p)) + sum(field.pair[a, b] for a, b in zip(p, p[1:], strict=False)))
        assert tuple(pii.viterbi(field, x, np.array([n]))[0]) == best


def test_pii_table(spark, field):
    long_text = "word " * 30_000 + "last@example.org"
    rows = [(1, "mail me at joe [at] site [dot] com or a.b@c.example", "x"), (2, None, "x"), (None, "", None), (3, "10.0.0.1 and 4111 1111 1111 1111, +1 (555) 123-4567!", "x"), (3, long_text, "y"), (4, "nothing here, version 2.0.", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    out = sorted(pii.detect(df, field, redact=True).collect(), key=lambda r: (str(r.doc_id), r.text or ""))
    assert len(out) == len(rows)
    for r in out:
        base = plain(r.text or "")
        assert r.base_sha256 == hashlib.sha256(pii.written(base).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == s[1] for s in base) for k in range(4)]
        assert set(pii.written(base).split(",")) <= set(r.spans.split(","))
    by_text = {r.text: r for r in out}
    assert by_text[rows[3][1]].redacted == "[IP] and [CARD], [PHONE]!"
    assert by_text[long_text].redacted.endswith("word [EMAIL]")
    assert by_text[rows[5][1]].spans == "" and by_text[None].redacted is None
    assert "email:" in by_text[rows[0][1]].spans and by_text[rows[0][1]].n_email == 1


def test_addresses_without_digits_or_signs(spark, field):
    """An address of letters is found by itself, across line ends and far from any digit; prose with its words is not one."""
    prose = "We met at the station. That is the dot at the end (of the line).\n" * 40
    texts = ["joe [at] site [dot] com", "write to joe [at] site [dot] com please", "mail\njoe [at]\nsite [dot] com\nthanks", prose, prose + "joe [at] site [dot] com\n" + prose]
    out = {r.doc_id: r for r in pii.detect(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), field, redact=True).collect()}
    assert [out[k].redacted for k in range(5)] == ["[EMAIL]", "write to [EMAIL] please", "mail\n[EMAIL]\nthanks", prose, prose + "[EMAIL]\n" + prose]
    assert all(out[k].n_email == 0 for k in range(5))


def test_decoding_is_viterbi_over_whole_texts(field, monkeypatch):
    monkeypatch.setattr(pii, "_plausible", lambda kind, text: True)
    monkeypatch.setattr(pii, "base_spans", lambda text: [])
    monkeypatch.setattr(pii, "_BLOCK", 100)
    texts = [x for x, _ in pii.labelled_lines(60)] + ["", " ", "a", "1", "\n".join(x for x, _ in pii.labelled_lines(30))]
    for text, (_, every) in zip(texts, pii.find_spans(texts, field), strict=True):
        starts, ends, kinds, _ = pii.tokens([text])
        tags = pii.viterbi(field, kinds[None], np.array([len(kinds)]))[0] if len(kinds) else []
        firsts = [k for k, t in enumerate(tags) if t % 2]
        want = [(starts[k], tags[k] // 2, ends[next((j for j in range(k + 1, len(tags)) if tags[j] != tags[k] + 1), len(tags)) - 1]) for k in firsts]
        assert every == [x for x in want if not (text[x[0] - 1 : x[0]].isalnum() or text[x[2] : x[2] + 1].isalnum())]


# --- quality ---


def test_label_model_finds_known_accuracies():
    rng = np.random.default_rng(0)
    good = rng.random(20_000) < 0.85
    accuracy = np.array([0.95, 0.9, 0.85, 0.8])
    right = rng.random((len(good), 4)) < accuracy
    votes = np.where(right, np.where(good[:, None], 1, -1), np.where(good[:, None], -1, 1)) * (rng.random((len(good), 4)) < 0.8)
    kinds, back, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    posterior, found, prior = weak_quality.estimate(kinds, counts.astype(float))
    assert np.abs(found - accuracy).max() < 0.03 and abs(prior - 0.85) < 0.02
    assert ((posterior[back.ravel()] > 0.5) == good)[(votes != 0).any(1)].mean() > 0.95


def plain_em(votes, expected=weak_quality.EXPECTED, share=weak_quality.PRIOR):
    """Expectation-maximisation document by document, from the same start."""
    good = [min(0.9, max(0.1, 0.5 + 0.4 * ((sum(v) > 0) - (sum(v) < 0)))) for v in votes]
    for _ in range(500):
        accuracy = []
        for k in range(len(votes[0])):
            right, cast = expected * share * len(votes), share * len(votes)
            for v, g in zip(votes, good, strict=True):
                if v[k]:
                    cast += 1
                    right += g if v[k] > 0 else 1 - g
            accuracy.append(right / cast)
        prior = (sum(good) + 1) / (len(votes) + 2)
        new = []
        for v in votes:
            odds = prior / (1 - prior)
            for k, x in enumerate(v):
                odds *= (accuracy[k] / (1 - accuracy[k])) ** x
            new.append(odds / (1 + odds))
        done = max(abs(a - b) for a, b in zip(good, new, strict=True)) < 1e-9
        good = new
        if done:
            break
    return good, accuracy, prior


def test_label_model_against_brute_force():
    rng = random.Random(4)
    votes = []
    for _ in range(400):
        good = rng.random() < 0.7
        votes.append([0 if rng.random() < 0.3 else (1 if (rng.random() < a) == good else -1) for a in (0.9, 0.8, 0.7, 0.25)])
    kinds, back, counts = np.unique(np.array(votes), axis=0, return_inverse=True, return_counts=True)
    posterior, accuracy, prior = weak_quality.estimate(kinds, counts.astype(float))
    want, want_accuracy, want_prior = plain_em(votes)
    assert np.abs(posterior[back.ravel()] - want).max() < 1e-6 and np.abs(accuracy - want_accuracy).max() < 1e-6 and abs(prior - want_prior) < 1e-6
    assert accuracy[3] < 0.45  # a labeller that is mostly wrong is found to be


def test_scorer_against_newton():
    """The gradient descent ends where Newton's method does, on soft labels."""
    rng = np.random.default_rng(3)
    x = rng.random((300, 12))
    p = np.clip(x[:, 0] * 0.8 + rng.random(300) * 0.2, 0, 1)
    got = weak_quality.fit_linear(x, p, rounds=20_000, ridge=1e-3)
    z, w = np.concatenate([x, np.ones((300, 1))], axis=1), np.zeros(13)
    for _ in range(50):
        q = 1 / (1 + np.exp(-z @ w))
        w -= np.linalg.solve(z.T @ (z * (q * (1 - q))[:, None]) / 300 + 1e-3 * np.eye(13), z.T @ (q - p) / 300 + 1e-3 * w)
    assert np.abs(got - w).max() < 1e-3


def test_scorer_reads_words(spark):
    """Texts of one form whose words alone differ are told apart."""
    words = {1: ["lamp", "tree", "door"], 0: ["gold", "fish", "moon"]}
    rng = random.Random(1)
    texts = [(y, " ".join(rng.choice(words[y]) for _ in range(30))) for y in (0, 1) for _ in range(60)]
    data, offsets = C.buffers(pa.array([t for _, t in texts], pa.string()))
    _, x = weak_quality.measure(data, offsets)
    w = weak_quality.fit_linear(x, np.array([float(y) for y, _ in texts]))
    assert all((s > 0) == (y == 1) for s, (y, _) in zip(x @ w[:-1] + w[-1], texts, strict=True))


def test_quality_against_labels(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = weak_quality.classify(docs).join(labels, "doc_id").select("quality", "kept").collect()
    clean = [r.kept for r in rows if r.quality == 1]
    junk = [not r.kept for r in rows if r.quality == 0]
    assert sum(clean) / len(clean) > 0.98 and sum(junk) / len(junk) > 0.9


def test_quality_edges(spark):
    rows = [(1, "", "a"), (2, None, "a"), (None, "A plain sentence of a few words. And another one.", "b"), (3, "!!! ### $$$ %%% &&& " * 200, "b"), (3, "The same text twice here.", "c"), (3, "The same text twice here.", "c"), (4, "word", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept string")
    out = weak_quality.classify(df).collect()
    assert len(out) == len(rows)
    assert {r.doc_id: r.kept for r in out if r.doc_id in (1, 2)} == {1: False, 2: False}
    assert weak_quality.classify(df.where("false")).count() == 0


def test_quality_sample_is_bounded_and_fair_without_ids(spark, monkeypatch):
    """Null ids, and one row that makes up a third of the table: the sample has train_rows rows with the table's mix of votes."""
    good = ["The people of the town came to see the old house, and it was a good day for all of them. We walked to the river " + f"with friend number {k} and had a long talk about what they have done in the year." for k in range(200)]
    junk = ["!!! ### $$$ %%% &&& " * 20 + str(k) for k in range(200)]
    seen = []
    fit_linear = weak_quality.fit_linear
    monkeypatch.setattr(weak_quality, "fit_linear", lambda x, p: seen.append((x, p)) or fit_linear(x, p))
    for more in ([], [(8, junk[0])] * 200):
        rows = [(None, t) for t in good + junk] + more
        weak_quality.fit(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), train_rows=120)
        x, p = seen.pop()
        assert len(x) == len(p) == 120
        assert abs((p > 0.5).mean() - len(good) / len(rows)) < 0.15


# --- mixing ---


def levels(sizes):
    """Targets by resharing until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    target, total = {}, float(sum(sizes.values()))
    free = list(order)
    while True:
        left = total - sum(target.values())
        share = {s: left * weight[s] / sum(weight[f] for f in free) for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s]]
        if not over:
            return target | share
        for s in over:
            target[s] = 3.0 * sizes[s]
            free.remove(s)
        if not free:
            return target


def test_mixing(spark):
    rng = random.Random(3)
    rows = [(k, rng.choice(["a", "b", "b", "b", "c", "d", None, "é"]) if k % 40 else "tiny", " ".join("w" for _ in range(rng.choice([0, 1, 3, 20, 200])))) for k in range(900)]
    rows += [(5, "b", "one two three")] * 40 + [(None, "c", "x y"), (77, "empty", None), (78, "empty", ""), (79, "d", "w " * 5000)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, source string, text string, size int")
    out = mixing.mix(df).collect()
    assert len(out) == len(rows)
    sizes: dict = {}
    for _, s, t in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = levels(sizes)
    taken, largest = {}, {}
    for r in out:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 * max(1, want[r.source])
        assert 0 <= r.taken <= 3 * r["size"] and r.taken == r.copies * r["size"]
        rate = want[r.source] / sizes[r.source] if sizes[r.source] else 0
        assert r["size"] == 0 or int(rate - 1e-9) <= r.copies <= int(rate + 1e-9) + 1
        taken[r.source] = taken.get(r.source, 0) + r.taken
        largest[r.source] = max(largest.get(r.source, 0), r["size"])
    assert all(abs(taken[s] - want[s]) <= largest[s] / 2 + 1e-6 for s in taken)
    again = mixing.mix(df.repartition(7)).collect()
    key = lambda r: (str(r.doc_id), str(r.source), r["size"], r.copies)
    assert sorted(map(key, out)) == sorted(map(key, again))
    repeated = mixing.repeat(df)
    assert repeated.columns == df.columns and repeated.count() == sum(r.copies for r in out)
    assert mixing.mix(df.where("false")).count() == 0 and mixing.repeat(df.where("false")).count() == 0


def test_mixing_keeps_expectations(spark):
    """Over many seeds a document is taken as often as its source's rate says."""
    df = spark.createDataFrame([(k, "a" if k < 30 else "b", "w " * (1 + k % 7)) for k in range(60)], "doc_id long, source string, text string")
    total: dict = {}
    for seed in range(8):
        for r in mixing.mix(df, seed=seed).collect():
            total.setdefault(r.source, []).append(r.copies - r.target / r.source_size)
    assert all(abs(np.mean(x)) < 0.06 for x in total.values())


def thue_morse(n, a=b"a", b=b"b"):
    """A word of n letters and its complement: equal under every polynomial hash modulo 2^64 from 1,024 letters on."""
    return tuple(b"".join((a, b)[(bin(i).count("1") + k) % 2] for i in range(n)).decode() for k in (0, 1))


@pytest.mark.parametrize("n", [8, 64, 255, 256, 257, 1024, 4096])
def test_hashes_of_thue_morse_words_differ(n):
    data = np.frombuffer("".join(thue_morse(n)).encode(), np.uint8)
    h = C.span_hashes(data, np.array([0, n]), np.array([n, 2 * n]))
    assert h[0] != h[1]
    assert C.span_hashes(data[3:], np.array([n - 3]), np.array([2 * n - 3]))[0] == h[1]


@pytest.mark.parametrize("hashes", [C.span_hashes, lambda d, s, e: np.zeros(len(s), np.uint64), lambda d, s, e: (e - s).astype(np.uint64) * np.uint64(1 << 60)])
@pytest.mark.parametrize("limit", [2, 1000])
def test_word_table_tells_words_apart_whatever_the_hash(hashes, limit):
    rng = random.Random(5)
    words = ["".join(rng.choice("ab") for _ in range(rng.choice([1, 2, 3, 9, 17, 300]))).encode() for _ in range(400)]
    table, seen = C.WordTable(limit, hashes), {}
    for k in range(0, 400, 40):
        part = words[k : k + 40]
        ends = np.cumsum([len(w) for w in part])
        before = table.size
        at, new = table.number(np.frombuffer(b"".join(part), np.uint8), ends - [len(w) for w in part], ends)
        seen.update((before + i, part[j]) for i, j in enumerate(new.tolist()))
        assert table.size == before + len(new)
        assert [seen[i] for i in at.tolist()] == part


def test_token_counts_and_ids_of_colliding_words(spark, library):
    texts = list(thue_morse(4096))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    got = {r.doc_id: r.ids for r in bpe.encode(df).collect()}
    assert [got[0], got[1]] == [library.encode(t, add_special_tokens=False).ids for t in texts]
    counts = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(df).collect()}
    alone = token_counts.Counter(token_counts.load_vocabulary())
    assert [counts[0], counts[1]] == [alone.word(token_counts.SPACE + t) for t in texts]
